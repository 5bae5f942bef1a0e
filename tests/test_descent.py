import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import descent, neighbors, ranks, reduce
from corpusloom.operators.rows import materialise
from corpusloom.sources import synthetic


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, v array<double>")


def clusters(n, dim, count, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(count, dim))[rng.integers(0, count, n)] + rng.normal(scale=spread, size=(n, dim))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_recall_and_scores(spark, metric):
    df = materialise(frame(spark, clusters(3000, 24, 12)), "points")
    near = descent.descent_knn(df, 10, "row_id", "v", metric=metric, block=128)
    exact = materialise(neighbors.knn(df, 10, "row_id", "v", metric=metric), "exact")
    assert near.columns == exact.columns and near.count() == 30_000
    assert neighbors.overlap(exact, near, 10).first()[0] >= 0.95
    both = exact.withColumnRenamed("score", "want").join(near, ["row_id", "neighbor_id"])
    assert both.where(F.abs(F.col("want") - F.col("score")) > 2e-9).count() == 0
    assert near.groupBy("row_id").agg(F.count_distinct("neighbor_id").alias("n"), F.max("rank").alias("m"), F.count_if(F.col("row_id") == F.col("neighbor_id")).alias("own")).where("n <> 10 OR m <> 10 OR own > 0").count() == 0


def test_a_hub_and_equal_rows(spark):
    x = np.r_[np.zeros((1, 6)), np.random.default_rng(1).normal(size=(900, 6)), np.ones((300, 6))]
    df = frame(spark, x)
    near = descent.descent_knn(df, 5, "row_id", "v", metric="euclidean", block=64)
    assert near.count() == 1201 * 5 and near.where("row_id > 900").agg(F.max("score")).first()[0] == 0
    few = descent.descent_knn(df.limit(3), 5, "row_id", "v")
    assert few.count() == 6 and descent.descent_knn(df.limit(0), 5, "row_id", "v").collect() == []


def test_ranks_by_counting_lists(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS", 32)
    monkeypatch.setattr(ranks, "BLOCK", 100)
    x = clusters(900, 8, 10, seed=3).round(2)
    x[:60] = x[100:160]
    df = frame(spark, x)
    pairs = neighbors.knn(df.withColumn("low", F.slice("v", 1, 2)), 4, "row_id", "low", metric="euclidean")
    got = {(r.row_id, r.neighbor_id): (r.rank, r.compared) for r in ranks.neighbor_ranks(df.select(F.col("row_id").alias("id"), "v"), pairs).collect()}
    assert len(got) == 3600
    for i in range(900):
        d = np.round(np.sqrt(((x - x[i]) ** 2).cumsum(axis=1)[:, -1]), 9)
        order = [j for j in np.lexsort((np.arange(900), d)) if j != i]
        place = {j: n + 1 for n, j in enumerate(order)}
        assert all(got[i, j][0] == place[j] for a, j in got if a == i)
    assert sum(c for _, c in got.values()) / 4 < 0.6 * 900 * 900


def test_rows_without_structure_go_once_to_a_block(spark, monkeypatch):
    """Where every list is across, a row is sent to each block once, not to each list."""
    monkeypatch.setattr(ranks, "ROWS", 8)
    monkeypatch.setattr(ranks, "BLOCK", 200)
    monkeypatch.setattr(ranks, "CLOSE", 50)
    written = {}
    keep = ranks.materialise
    monkeypatch.setattr(ranks, "materialise", lambda df, label: written.setdefault(label, keep(df, label)))
    x = np.random.default_rng(8).normal(size=(600, 16))
    x[:50] = x[300]
    df = frame(spark, x)
    pairs = materialise(neighbors.knn(df.withColumn("low", F.slice("v", 1, 2)), 3, "row_id", "low", metric="euclidean"), "pairs")
    got = {(r.row_id, r.neighbor_id): r["rank"] for r in ranks.neighbor_ranks(df.select(F.col("row_id").alias("id"), "v"), pairs).collect()}
    for i in range(600):
        d = np.round(np.sqrt(((x - x[i]) ** 2).cumsum(axis=1)[:, -1]), 9)
        place = {j: n + 1 for n, j in enumerate(j for j in np.lexsort((np.arange(600), d)) if j != i)}
        assert all(rank == place[j] for (a, j), rank in got.items() if a == i)
    assert written["rank-plan"].agg(F.sum(F.size("blocks"))).first()[0] <= 600 * 6


def test_work_of_ranks_is_below_all_pairs(spark):
    x = clusters(3000, 6, 30, seed=5, spread=0.05)
    df = frame(spark, x).withColumn("low", F.slice("v", 1, 3))
    row = ranks.trustworthiness(df, 5, "row_id", "v", "low").first()
    assert 0.5 < row["trustworthiness"] < 1 and row["compared"] < 3000 * 3000 / 2


def test_landmarks_keep_what_the_kernel_keeps(spark):
    e = materialise(synthetic.make_embeddings(spark, 2000, 24, 6, seed=5, spread=0.4), "synthetic")
    unit = reduce.apply_pca(e, reduce.fit_pca(e, "embedding", 10), "embedding", "p")
    unit = materialise(unit.select("row_id", "p"), "reduced")
    measured = []
    for most in (2000, 500):
        spec = reduce.UmapSpec(neighbors=15, epochs=100, max_points=most)
        laid = materialise(reduce.umap(unit, "row_id", "p", spec), "laid").withColumn("c", F.array("x", "y", "z"))
        assert laid.count() == laid.select("row_id").distinct().count() == 2000
        low = materialise(neighbors.knn(laid, 10, "row_id", "c", metric="euclidean"), "low")
        both = laid.join(unit, "row_id")
        measured.append((neighbors.label_purity(low, e.select("row_id", "label")).first()[0], ranks.trustworthiness(both, 10, "row_id", "p", "c", low=low).first()[0]))
    (purity, trust), (purity_l, trust_l) = measured
    assert purity > 0.9 and purity_l > purity - 0.03 and trust_l > trust - 0.03


def test_one_graph_for_all(spark):
    e = synthetic.make_embeddings(spark, 150, 12, 3, seed=1)
    layout, _, graph = reduce.project_with_graph(e, "row_id", "embedding", 6, reduce.UmapSpec(neighbors=8, epochs=30), 12)
    assert layout.count() == 150 and graph.agg(F.max("rank"), F.count("*")).first() == (12, 1800)
    again, _ = reduce.project(e, "row_id", "embedding", 6, reduce.UmapSpec(neighbors=8, epochs=30))
    one, two = ({r.row_id: (r.x, r.y, r.z) for r in x.collect()} for x in (layout, again))
    assert all(np.allclose(one[i], two[i]) for i in one)


def test_recall_without_structure(spark):
    """The search goes on with more neighbours until the stated part of them is found."""
    df = materialise(frame(spark, np.random.default_rng(2).normal(size=(3000, 64))), "points")
    exact = materialise(neighbors.knn(df, 4, "row_id", "v"), "exact")
    assert neighbors.overlap(exact, descent.descent_knn(df, 4, "row_id", "v", block=64), 4).first()[0] < 0.95
    near = descent.descent_knn(df, 4, "row_id", "v", block=64, recall=0.95)
    assert near.count() == 12_000 and neighbors.overlap(exact, near, 4).first()[0] >= 0.95


def test_no_search_that_costs_more_than_all_pairs(spark, monkeypatch):
    """A search that gains too little is given up, and the exact neighbours that the caller has are the answer; with structure the search is."""
    searched, wrote = [], []
    once, keep = descent._search, descent.materialise
    monkeypatch.setattr(descent, "_search", lambda *a, **kw: searched.append(a[5]) or once(*a, **kw))
    monkeypatch.setattr(descent, "materialise", lambda df, label: wrote.append(label) or keep(df, label))
    for x, hopeless in ((np.random.default_rng(2).normal(size=(3000, 64)), True), (clusters(3000, 16, 30, seed=5, spread=0.2), False)):
        searched.clear(), wrote.clear()
        df = materialise(frame(spark, x), "points")
        exact = materialise(neighbors.knn(df, 4, "row_id", "v"), "exact")
        near = descent.descent_knn(df, 4, "row_id", "v", block=64, recall=0.95, exact=exact)
        assert near.count() == 12_000 and neighbors.overlap(exact, near, 4).first()[0] >= 0.95
        assert searched == [12] and (near is exact) == hopeless and ("descent-graph" in wrote) != hopeless and "descent-exact" not in wrote
        assert not hopeless or "descent-6" not in wrote


def test_gain_of_recall():
    assert descent._hopeless([0.1, 0.4, 0.5, 0.55], 3, 0.955) and not descent._hopeless([0.1, 0.6, 0.9], 3, 0.955)
    assert not descent._hopeless([0.1, 0.4], 5, 0.955) and not descent._hopeless([0.0, 0.1, 0.3], 4, 0.955) and descent._hopeless([0.5, 0.6, 0.6], 4, 0.955)


def test_rounds_are_the_same_whether_tasks_hold_the_vectors(spark, monkeypatch):
    """Vectors are looked up or joined; ids are negative and in steps."""
    x = clusters(1500, 12, 15, seed=4, spread=0.3)
    df = materialise(frame(spark, x).withColumn("row_id", F.col("row_id") * 97 - 5000), "points")
    found = []
    for held in (descent.HELD, 0):
        monkeypatch.setattr(descent, "HELD", held)
        found.append(sorted(map(tuple, descent.descent_knn(df, 5, "row_id", "v", block=128).collect())))
    assert found[0] == found[1] and len(found[0]) == 7500
