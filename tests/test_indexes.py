import itertools
import random
import shutil
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import facets, search, text_index


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma ray", "Ägypten", "über", "a.b", "", "xyz", "aaaa", "日本語", "🙂🙂x"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randrange(0, 6))), i) for i in range(400)]
    return spark.createDataFrame(rows, "row_id long, text string, ids int")


def test_the_index_finds_what_the_scan_finds(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 50)
    path = str(tmp_path / "index")
    text_index.build(texts, F.col("text"), path)
    for needle in ("alpha", " GAMMA ", "a ray", "aaa", "ÜBER", "ägy", "日本語", "🙂🙂x", "a.b", "nothing", "xyz alpha", "ta", "", "  "):
        want = [r.row_id for r in search.keyword_search(texts, needle, F.col("text")).collect()]
        got = [tuple(r) for r in text_index.search(spark, path, needle, F.col("text")).collect()]
        assert [r[0] for r in got] == want, needle
    assert len(text_index.search(spark, path, "alpha", F.col("text"), limit=3).collect()) == 3


def test_only_blocks_with_candidates_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 10)
    df = spark.createDataFrame([(i, "needle" if i == 37 else f"hay {i}") for i in range(100)], "row_id long, text string")
    path = str(tmp_path / "index")
    text_index.build(df, F.col("text"), path)
    assert [tuple(r) for r in text_index.candidates(spark, path, "needle").collect()] == [(3, 37)]
    plan = text_index.search(spark, path, "needle", F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    for other in Path(path, "rows").glob("__block=*"):
        if other.name != "__block=3":  # their content is never asked for
            for file in other.glob("*.parquet"):
                shutil.copyfile(__file__, file)
    spark.catalog.clearCache()
    schema = df.withColumn("__block", F.lit(0)).schema
    found = spark.read.schema(schema).parquet(f"{path}/rows").join(text_index.candidates(spark, path, "needle"), [F.col("__block") == F.col("block"), F.col("row_id") == F.col("id")], "left_semi")
    assert [r.row_id for r in found.collect()] == [37]


def test_bitmaps_say_what_filters_say(spark):
    rng = random.Random(3)
    rows = [(i * 331, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"]), rng.choice(["1", "2"])) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, f string, g string, bits string")
    index = facets.build(df, ["f", "g", "bits"]).cache()
    for one, two in itertools.product(["a", "b", None], ["x", "y", "z", None]):
        chosen = {"f": one, "g": two}
        want = {r[0] for r in rows if one in (None, r[1]) and two in (None, r[2])}
        got = facets.filter_rows(df, facets.selected(index, chosen)).collect()
        assert {r.row_id for r in got} == want and len(got) == len(want)
        counted = {(r.facet, r.value): r.n for r in facets.counts(index, chosen).collect()}
        open_ = [(n, k) for n, k in (("f", 1), ("g", 2), ("bits", 3)) if chosen.get(n) is None]
        assert counted == {(n, v): c for n, k in open_ for v in {r[k] for r in rows} if (c := sum(r[k] == v for r in rows if r[0] in want))}
    pairs = {(r.f, r.g): r.n for r in facets.pair_counts(index, "f", "g").collect()}
    assert pairs == {(a, b): c for a in ("a", "b", None) for b in "xyz" if (c := sum(r[1] == a and r[2] == b for r in rows))}
    index.unpersist()
    assert facets.selected(index, {"f": "none"}).collect() == []


def test_parts_of_posting_lists(monkeypatch):
    """A task gives a list for each trigram and block, not a row for each trigram of each text."""
    texts = {i: ["abcabc", "ab", "", "xüüü𝒳y", "bcabca"][i % 5] for i in range(40)}
    batch = pa.RecordBatch.from_pydict({"id": list(texts), "text": list(texts.values())}, pa.schema([("id", pa.int64()), ("text", pa.string())]))
    want = {}
    for i, t in texts.items():
        for gram in {t[k : k + 3] for k in range(len(t) - 2)}:
            want.setdefault((gram, i // 10), []).append(i)
    rows = [r for b in text_index._lists(iter([batch]), 10) for r in b.to_pylist()]
    assert {(r["gram"], r["block"]): r["ids"] for r in rows} == want and len(rows) == len(want)
    monkeypatch.setattr(text_index, "HELD", 5)
    parts = [r for b in text_index._lists(iter([batch]), 10) for r in b.to_pylist()]
    assert sorted((r["gram"], r["block"], i) for r in parts for i in r["ids"]) == sorted((*key, i) for key, ids in want.items() for i in ids)
