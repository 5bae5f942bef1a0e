"""Every catalog query against its SQL in DuckDB."""

import duckdb
import numpy as np
import pytest

from corpusloom.operators import gate, neighbors, reduce, rows
from corpusloom.plans.catalog import CATALOG
from corpusloom.sources import synthetic

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", [n for n, e in CATALOG.items() if e.sql])
def test_equals_sql(spark, duck, name):
    df = CATALOG[name].run(spark, SF)
    columns = sorted(df.columns)
    answer = duck.execute(CATALOG[name].sql)
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == columns
    want = sorted(([plain(r[theirs.index(c)]) for c in columns] for r in answer.fetchall()), key=str)
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str) == want


def test_gate_passes_where_clusters_are(spark):
    e = rows.materialise(synthetic.make_embeddings(spark, 400, 32, 4, seed=3, spread=0.25), "synthetic")
    layout = lambda x: reduce.apply_pca(x, reduce.fit_pca(x, "embedding", 3), "embedding", "coords")
    mixed = rows.materialise(neighbors.shuffle_columns(e, "row_id", "embedding"), "shuffled").join(e.select("row_id", "label"), "row_id")
    row = gate.run_gate(layout(e), layout(mixed)).first()
    assert row["passed"] and row["reasons"] == [] and row["purity_3d"] > 0.9 and row["purity_3d_shuffled"] < 0.45


def test_the_gate_query_ranks_nothing_that_it_does_not_return(spark, monkeypatch):
    from corpusloom.operators import ranks

    called = []
    monkeypatch.setattr(ranks, "trustworthiness", lambda *a, **o: called.append(a))
    assert "trustworthiness" not in CATALOG["gate_result"].run(spark, SF).columns and not called


def test_layouts(spark, tmp_path):
    from pyspark.sql import functions as F

    e = synthetic.make_embeddings(spark, 300, 24, 4, seed=5, spread=0.3)
    layout, state = reduce.project(e, "row_id", "embedding", 10, reduce.UmapSpec(neighbors=12, epochs=80))
    near = neighbors.knn(layout.withColumn("c", F.array("x", "y", "z")), 10, "row_id", "c", metric="euclidean")
    assert neighbors.label_purity(near, e.select("row_id", "label")).first()[0] > 0.9
    assert layout.count() == 300 and state.components.shape == (10, 24)
    state.save(spark, str(tmp_path / "pca"))
    again = reduce.PcaState.load(spark, str(tmp_path / "pca"))
    assert all(np.array_equal(getattr(state, f), getattr(again, f)) for f in ("components", "mean", "explained"))
    largest = np.abs(state.components).argmax(axis=1)
    assert (state.components[np.arange(10), largest] > 0).all() and (np.diff(state.explained) <= 1e-12).all()
    graph = reduce.fuzzy_graph(neighbors.knn(e, 8, "row_id", "embedding", metric="euclidean")).toPandas()
    assert (graph.a < graph.b).all() and not graph.duplicated(["a", "b"]).any() and graph.weight.between(0, 1 + 1e-9).all()
    p = CATALOG["pca_project"].run(spark, SF).agg(*[F.abs(F.avg(a)) for a in "xyz"]).first()
    assert max(p) < 1e-6


def test_trustworthiness_takes_every_row(spark, tmp_path):
    rng = np.random.default_rng(1)
    n, k = 5300, 5
    e = rng.normal(size=(n, 6)).astype("float32")
    e[:40] = e[40:80]
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(e)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    beyond = 0
    for i in range(n):
        d = np.round(np.sqrt(((e.astype(float) - e[i].astype(float)) ** 2).cumsum(axis=1)[:, [2, 5]]), 9)
        d[i] = -1.0
        order = np.argsort(d[:, 0], kind="stable")[1 : k + 1]
        rank = np.empty(n, int)
        rank[np.argsort(d[:, 1], kind="stable")] = np.arange(n)
        beyond += np.maximum(rank[order] - k, 0).sum()
    got = CATALOG["trustworthiness"].run(spark, str(tmp_path)).first()[0]
    assert abs(got - (1 - 2.0 * beyond / (n * k * (2.0 * n - 3 * k - 1)))) < 1e-6
