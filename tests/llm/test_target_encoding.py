import random
import zlib
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import target_encoding
from corpusloom.llm.queries import OP11_SQL
from corpusloom.llm.runtime import CLEAN_SHUFFLES
from corpusloom.operators.rows import run_dir

TABLES = {
    "sale_lines": "sale_id long, item_id long, vendor_id long, flag string, fold int",
    "sales": "sale_id long, client_id long, sold_at timestamp_ntz, fold string",
    "items": "item_id long, kind string, key long",
    "vendors": "vendor_id long, nation_id int, chunk int",
    "clients": "client_id long, segment string, nation_id int",
}


def shop(hot: float):
    rng = random.Random(3)
    pick = lambda n, none=0.05: None if rng.random() < none else 0 if rng.random() < hot else rng.randrange(n)
    sales = [(i, pick(20), None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(400)), "x") for i in range(300)]
    lines = [(None if rng.random() < 0.02 else 7 if rng.random() < hot else rng.randrange(320), pick(40), pick(6, 0), rng.choice(["returned", "kept", None]), 1) for _ in range(3000)]
    return {
        "sale_lines": lines + lines[:200],
        "sales": sales,
        "items": [(i, rng.choice(["a", "b", None]), i) for i in range(35)],
        "vendors": [(i, rng.choice([1, 2, None]), i) for i in range(5)],
        "clients": [(i, rng.choice(["p", "q", None]), i) for i in range(15)],
    }


def frames(spark, data):
    return [spark.createDataFrame(data[t], s) for t, s in TABLES.items()]


def by_sql(data):
    con = duckdb.connect()
    for t, schema in TABLES.items():
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}
        con.execute(f"CREATE TABLE {t} ({', '.join(f'{c.split()[0]} {kinds[c.split()[1]]}' for c in schema.split(', '))})")
        con.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(names))})", data[t])
    return con.execute(OP11_SQL)


def same(df, answer):
    columns = sorted(df.columns)
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == columns
    want = sorted(([r[theirs.index(c)] for c in columns] for r in answer.fetchall()), key=str)
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=str) == want
    return want


@pytest.mark.parametrize("hot, cell, part", [(0.4, 16_384, 262_144), (0.4, 40, 64)])
def test_equals_sql_also_with_cut_keys(spark, monkeypatch, hot, cell, part):
    monkeypatch.setattr(target_encoding, "CELL", cell)
    monkeypatch.setattr(target_encoding, "PART", part)
    data = shop(hot)
    rows = same(target_encoding.encode_sales(*frames(spark, data)), by_sql(data))
    assert len(rows) > 500 and len({r[1] for r in rows}) > 50


def test_against_plain_loops_with_a_gap(spark, monkeypatch):
    monkeypatch.setattr(target_encoding, "CELL", 30)
    monkeypatch.setattr(target_encoding, "PART", 50)
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([0, 0, 0, 1, 2, None]), rng.randrange(100), rng.randrange(3), rng.randrange(1, 4), rng.randrange(2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, kind string, item int, at long, fold int, n long, s long").withColumn("key_of_0", F.lit(1))
    got = target_encoding.encode(df, [["", "kind", "item"]], at="at", fold="fold", n="n", s="s", prior=F.lit(500).cast("long"), gap=7, weight=10, scale=1000)
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == 600 and got.columns == df.columns + [f"{c}_{x}" for c in ("all", "kind", "item") for x in ("n", "s")] + [f"{c}_rate" for c in ("all", "kind", "item")]
    for i, kind, item, at, fold, *_ in rows:
        rate = 500
        for name, match in (("all", lambda r: True), ("kind", lambda r: r[1] == kind), ("item", lambda r: r[2] == item)):
            past = [r for r in rows if r[4] != fold and r[3] + 7 < at and match(r)]
            n, s = sum(r[5] for r in past), sum(r[6] for r in past)
            rate = rate if n < 1 else (1000 * s + 10 * rate) // (n + 10)
            assert (found[i][f"{name}_n"], found[i][f"{name}_s"], found[i][f"{name}_rate"]) == (n, s, rate)


@pytest.mark.parametrize("gap", [0, 7])
@pytest.mark.parametrize("few", [0, 256])
def test_hot_instants_and_many_cells(spark, monkeypatch, gap, few):
    """Facts of one instant go to their cell as one sum, whether columns share their cells or not."""
    for name, value in (("CELL", 5), ("KEYS", 100), ("FULL", 1), ("FEW", few), ("PART", 20)):
        monkeypatch.setattr(target_encoding, name, value)
    rng = random.Random(9)
    rows = [(i, rng.choice(["x", "y", None]), 50 if rng.random() < 0.4 else rng.randrange(90), rng.randrange(2), rng.randrange(1, 4), rng.randrange(2)) for i in range(300)]
    joined = []
    keep = target_encoding.rewritten
    monkeypatch.setattr(target_encoding, "rewritten", lambda df, label, spent=(): joined.append(label) or keep(df, label, spent))
    got = target_encoding.encode(spark.createDataFrame(rows, "id int, kind string, at int, fold long, n int, s long"), [["", "kind"]], at="at", fold="fold", n="n", s="s", prior=F.lit(500).cast("long"), gap=gap)
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == 300 and "history-with-sums" in joined
    for i, kind, at, fold, *_ in rows:
        for name, match in (("all", lambda r: True), ("kind", lambda r: r[1] == kind)):
            past = [r for r in rows if r[3] != fold and r[2] + gap < at and match(r)]
            assert (found[i][f"{name}_n"], found[i][f"{name}_s"]) == (sum(r[4] for r in past), sum(r[5] for r in past))


def test_disk_is_that_of_one_step(spark):
    """Facts are shuffled once for each pass, nothing is joined back, and of the passes' tables only the last is left."""
    data = shop(0.2)
    before = {p.name for p in Path(run_dir(spark).removeprefix("file:")).glob("*")}
    out = target_encoding.encode_sales(*frames(spark, data))
    left = [p.name.split("-")[0] for p in Path(run_dir(spark).removeprefix("file:")).glob("*") if p.name not in before]
    assert left.count("facts") == 0 and left.count("history") == 1
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert len(out.collect()) > 500 and spark.conf.get(CLEAN_SHUFFLES) == "false"


def test_odd_inputs(spark):
    at = datetime(2024, 1, 2)
    empty = {t: [] for t in TABLES}
    assert target_encoding.encode_sales(*frames(spark, empty)).collect() == []
    one = empty | {"sale_lines": [(1, None, None, "returned", 1)] * 2 + [(2, None, None, None, 1), (9, 1, 1, "kept", 1), (None, 1, 1, "kept", 1)], "sales": [(1, None, at, "x")] * 2 + [(2, None, at + timedelta(seconds=1), "x"), (None, 1, at, "x")]}
    got = {r["sale_id"]: r for r in target_encoding.encode_sales(*frames(spark, one)).collect()}
    assert set(got) == {1, 2} and (got[1]["n_lines"], got[1]["n_returned"], got[1]["item_id"], got[1]["vendor_id"]) == (4, 4, -1, None)
    other = zlib.crc32(b"1") % 5 != zlib.crc32(b"2") % 5
    assert got[2]["item_n"] == got[2]["vendor_n"] == got[2]["client_n"] == (4 if other else 0)


def test_equals_sql_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = same(target_encoding.encode_sales(*[spark.read.parquet(f"{sf}/{t}.parquet") for t in TABLES]), con.execute(OP11_SQL))
    assert Counter(r[-1] is None for r in rows)[False] > 100 and not pd.isna(rows[0][0])
