import hashlib
import random
from collections import Counter

from corpusloom.llm.substring_dedup import WINDOW, remove_repeats


def brute(rows):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = Counter(tuple(w[p : p + WINDOW]) for _, w in words for p in range(len(w) - WINDOW + 1))
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - WINDOW + 1) if seen[tuple(w[p : p + WINDOW])] > 1 for q in range(p, p + WINDOW)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", " ", "averylongwordofmanybytes"]
    text = lambda n: [random.choice(vocabulary) for _ in range(n)]
    base = text(400)
    rows = [(0, None), (1, ""), (2, "a " * 1000), (3, "a " * 36), (None, " ".join(base)), (4, " ".join(base[50:120])), (4, " ".join(base[50:84])), (5, " ".join(text(30) + base[100:140] + text(20))), (6, " ".join(text(50) * 5)), (7, "a " * 36), (7, "a " * 36), (8, "x"), (8, "b c " * 60)]
    for i in range(9, 60):
        near = list(base)
        for _ in range(random.randint(0, 4)):
            near[random.randrange(400)] = f"e{random.randrange(100)}"
        at = random.randrange(300)
        rows.append((i, random.choice(" \t\n\v\f\r").join(text(random.randint(0, 60)) + near[at : at + random.randint(10, 400)] + text(random.randint(0, 60)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as k1", "1 as places")
    assert sorted(map(tuple, remove_repeats(df).collect()), key=str) == brute(rows)
    assert remove_repeats(df.limit(0)).collect() == []
