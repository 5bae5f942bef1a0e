import random
import zlib

from corpusloom.llm.sharding import shard_by_bytes


def test_against_plain_sums(spark):
    random.seed(4)
    rows = [(random.choice([None, *range(300)]), random.choice([None, "", "é" * random.randint(1, 400), "x" * random.randint(1, 3000)]), "s") for _ in range(800)]
    rows += [(7, "same", "s")] * 50
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    order = sorted(raw, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1]), len(r[1])))
    total, at, slots, want = sum(len(t) + 1 for _, t in raw), 0, {}, []
    for i, t in order:
        shard = at * 8 // total
        slots[shard] = slots.get(shard, -1) + 1
        want.append((i, len(t) + 1, zlib.crc32(t), "bytes", shard, slots[shard], None))
        at += len(t) + 1
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in shard_by_bytes(df).collect()] == [(1, 1, 0, "bytes", 0, 0, None)]
    assert shard_by_bytes(df.limit(0)).collect() == []


def test_hot_and_very_long_texts(spark):
    """Half of the rows are one text and one row is larger than all others together."""
    rows = [(i, "copy " * 20) for i in range(0, 400, 2)] + [(i, f"text {i}") for i in range(1, 400, 2)] + [(150, "y" * 300_000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as part", "3 as row")).collect()
    assert len(got) == len(rows) and [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == sorted(i for i, _ in rows)
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
