import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import suffix_dedup
from corpusloom.llm.queries import oracle_sql
from corpusloom.llm.suffix_arrays import permuted_common_prefixes, suffix_array
from corpusloom.llm.suffix_dedup import LENGTH, remove_repeats


def plain_order(t):
    return sorted(range(len(t)), key=lambda i: bytes(t[i:]) if t.dtype == np.uint8 else t[i:].tolist())


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(1, 4), max_size=120))
def test_suffix_arrays_and_prefixes(top, symbols):
    t = np.array([min(x, top) for x in symbols] * 2 + [0], np.uint8)
    sa = suffix_array(t)
    assert sa.tolist() == plain_order(t)
    shared = permuted_common_prefixes(t, sa)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        x, y = bytes(t[a:]), bytes(t[b:])
        assert shared[b] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_suffix_arrays_of_words_and_of_many_names():
    rng = np.random.default_rng(1)
    words = [rng.integers(60, 120, 40) for _ in range(30)]
    for t in (np.concatenate([words[i] for i in rng.integers(0, 30, 80)] + [[0]]).astype(np.uint8), np.r_[rng.integers(1, 5000, 600), rng.integers(1, 9, 900), 0], np.r_[np.tile(rng.integers(1, 3000, 50), 9), 0]):
        assert suffix_array(t).tolist() == plain_order(t)


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[p : p + LENGTH] for _, d in data for p in range(len(d) - LENGTH + 1))
    out = []
    for i, d in data:
        gone = {q for p in range(len(d) - LENGTH + 1) if seen[d[p : p + LENGTH]] > 1 for q in range(p, p + LENGTH)}
        kept = bytes(x for q, x in enumerate(d) if q not in gone)
        out.append((i, len(d), len(gone), sum(q - 1 not in gone for q in gone), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def made():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh éß\n\0") for _ in range(n))
    base, passage = text(1500), text(230)
    rows = [(0, None), (1, ""), (2, "a" * 700), (3, "a" * 199), (None, base), (4, base[300:900]), (4, base[300:550]), (5, text(100) + base[500:720] + text(90)), (6, text(260) * 4), (7, "ab" * 300), (7, "ab" * 300), (8, "x" * 200), (9, "ab" * 250 + "c")]
    for i in range(10, 60):
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(1500)] = rng.choice("XYZ")
        at = rng.randrange(1200)
        rows.append((i, text(rng.randint(0, 150)) + "".join(near[at : at + rng.randint(100, 1500)]) + text(rng.randint(0, 150))))
    return rows + [(i, text(rng.randint(0, 300)) + passage + text(rng.randint(0, 300))) for i in range(60, 100)]


@pytest.mark.parametrize("hot, shard, part", [(4096, 1 << 21, 1 << 19), (3, 2000, 600)])
def test_against_brute_force(spark, monkeypatch, hot, shard, part):
    for name, value in (("HOT", hot), ("SHARD", shard), ("PART", part)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as anchor", "1 as places")
    got = remove_repeats(df).collect()
    assert sorted((tuple(r)[:5] + (bytes(r["kept"]),) for r in got), key=str) == brute(rows)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"] for r in got)


def test_a_very_long_text_and_an_empty_table(spark):
    rng = random.Random(8)
    long_ = "".join(rng.choices("abcdefghijklmnop ", k=1_300_000))
    rows = [(1, long_), (2, long_[1_000_000:1_000_400]), (3, "no"), (4, long_[524_088:524_488])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert [(s["start"], s["stop"]) for s in got[1]["spans"]] == [(524_088, 524_488), (1_000_000, 1_000_400)] and got[2]["n_removed"] == got[4]["n_removed"] == 400 and got[3]["n_removed"] == 0
    assert remove_repeats(df.limit(0)).collect() == []


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    rows = [(i, t) for i, t in made() if i is not None and i not in (4, 7)]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, None if t is None else t.replace("\0", "~")) for i, t in rows])
    want = [r[:5] for r in brute([(i, None if t is None else t.replace("\0", "~")) for i, t in rows])]
    assert sorted(con.execute(oracle_sql()["op13_suffix_dedup"]).fetchall(), key=str) == want
