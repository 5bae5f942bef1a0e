import random
from collections import defaultdict

import numpy as np
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.components import components


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(keys):
    """Smallest index of each key's component; keys within 4 bits are linked."""
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(keys, np.uint64)
    for k in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= 4):
            x, y = find(k), find(int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(keys))]


def test_masks_cover_every_pair_in_the_radius():
    random.seed(1)
    for open_bits in ((1 << 64) - 1, random.getrandbits(64), 0b1011 << 20):
        table = simhash.masks(open_bits)
        bits = [b for b in range(64) if open_bits >> b & 1]
        for _ in range(300):
            differ = sum(1 << b for b in random.sample(bits, min(4, len(bits))))
            assert any(differ & m == 0 for m in table)
    assert simhash.mask_of(0) == 0
    path = 3 << 5 | 7
    first = simhash.masks((1 << 64) - 1)[2]
    assert simhash.mask_of(path) == first | simhash.masks(~first & (1 << 64) - 1)[6]


def test_rows_against_plain(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(random.choice(words) for _ in range(random.randint(1, 300))) for _ in range(25)]
    rows = [(None, "", "a"), (5, None, "a"), (90, " \n", "b"), (91, "One Two", "c"), (91, "one two", "c"), (92, "ÉÀ ſ K", "c")]
    for i in range(100, 260):
        text = random.choice(base).split()
        for _ in range(random.choice([0, 0, 1, 2])):
            text[random.randrange(len(text))] = random.choice(words).upper()
        rows.append((i, random.choice(["  ", " "]).join(text), "d"))
    rows.append((300, "x y z " * 50_000, "e"))
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    prints = [plain_print(t) for _, t, _ in rows]
    roots = plain_components(prints)
    least = defaultdict(lambda: None)
    for (i, _, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = i if least[r] is None else min(least[r], i)
    want = [(i, f"{p:016x}", least[r]) for (i, _, _), p, r in zip(rows, prints, roots, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = simhash.keep_one(df.withColumnRenamed("fp", "extra")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values())) and kept[0].__fields__ == ["doc_id", "text", "extra"]
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_a_hot_run_is_dealt_out_again_without_losing_links(spark):
    random.seed(3)
    centre = random.getrandbits(64)
    keys = {centre}
    while len(keys) < 3000:
        keys.add(centre ^ sum(1 << b for b in random.sample(range(64), random.randint(1, 3))))
    for _ in range(800):
        keys.add(random.choice(tuple(keys)) ^ sum(1 << b for b in random.sample(range(64), random.randint(3, 7))))
    keys = sorted(keys)
    signed = [int(np.uint64(k).view(np.int64)) for k in keys]
    found = {r.node: r.label for r in components(simhash.links(spark.createDataFrame([(k,) for k in signed], "fp long"))).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for k, root in zip(signed, plain_components(keys), strict=True):
        groups[found.get(k, k)].add(k)
        want[root].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    random.seed(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 2001), (2001, 2000)]
    random.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one_with_columns_of_its_own_names(spark):
    rows = [(1, "a b c d e", "p", 1, 1), (1, "a b c d e", "p", 1, 1), (2, "a b c d e", "q", 2, 2), (3, None, "r", 3, 3), (None, "", "s", 4, 4), (9, "x y z w v", "t", 5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept_id string, kept_key int, fp int").selectExpr("*", "0 as KEPT_ID", "'x' as label", "1 as __kept_key")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 9]
