"""Neighbours against full sorts in numpy, and the measures that reuse them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import gate, neighbors, ranks
from corpusloom.sources import synthetic


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


def plain(x, k, queries=None, metric="euclidean"):
    """{(query, rank): (neighbour, score)}; a row is not its own neighbour, ties go to the smaller id."""
    out = {}
    for i, q in enumerate(x if queries is None else queries):
        if metric == "euclidean":
            total = np.zeros(len(x))
            for j in range(x.shape[1]):
                total += (q[j] - x[:, j]) ** 2
            score = np.round(np.sqrt(total), 9)
            cost = score.copy()
        else:
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
            score = np.round(np.divide(x @ q, size, out=np.zeros(len(x)), where=size > 0), 9)
            cost = -score
        if queries is None:
            cost[i] = np.inf
        order = [j for j in np.argsort(cost, kind="stable")[:k] if np.isfinite(cost[j])]
        out |= {(i if queries is None else -i - 1, r + 1): (int(j), float(score[j])) for r, j in enumerate(order)}
    return out


def found(df):
    return {(r.row_id, r["rank"]): (r.neighbor_id, r.score) for r in df.collect()}


def points(n, dim, seed=0):
    """Gaussian points with clusters, copies, and a heap of equal ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[: n // 10] = x[n // 10 : 2 * (n // 10)]
    x[n // 2 : n // 2 + n // 20] = 0
    x[-n // 5 :] = x[-1] + rng.normal(size=x[-n // 5 :].shape) * 0.01
    return x


def test_lists_give_what_blocks_give(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 300)
    monkeypatch.setattr(neighbors, "LIST_ROWS", 100)
    x = points(2500, 3)
    df = frame(spark, x)
    want = plain(x, 7)
    assert found(neighbors.knn(df, 7, "id", "v", metric="euclidean", lists=True)) == want
    assert found(neighbors.knn(df, 7, "id", "v", metric="euclidean", lists=False)) == want
    q = np.random.default_rng(1).normal(size=(60, 3)) * 2
    asks = frame(spark, q).withColumn("id", -F.col("id") - 1)
    assert found(neighbors.knn(df, 4, "id", "v", metric="euclidean", queries=asks, lists=True)) == plain(x, 4, q)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_of_many_dimensions(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbors, "BLOCK", 150)
    monkeypatch.setattr(neighbors, "PART", 40)
    x = points(400, 20).round(3)
    got, want = found(neighbors.knn(frame(spark, x), 9, "id", "v", metric=metric)), plain(x, 9, metric=metric)
    assert got.keys() == want.keys()
    assert all(abs(got[key][1] - want[key][1]) <= 1.1e-9 for key in want) and sum(got[key][0] != want[key][0] for key in want) <= len(want) // 500


@pytest.mark.parametrize("lists", [True, False])
def test_few_rows_nulls_and_none(spark, lists):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, [1.0, 0.0])], "id long, v array<double>")
    got = found(neighbors.knn(df, 5, "id", "v", metric="euclidean", lists=lists))
    assert got == {(1, 1): (2, 1.0), (1, 2): (4, 1.0), (2, 1): (4, 0.0), (2, 2): (1, 1.0), (4, 1): (2, 0.0), (4, 2): (1, 1.0)}
    none = neighbors.knn(df.limit(0), 5, "id", "v", metric="euclidean", lists=lists)
    assert none.collect() == [] and none.columns == ["row_id", "rank", "neighbor_id", "score"]
    assert neighbors.knn(df, 5, "id", "v", queries=df.limit(0), metric="euclidean", lists=lists).collect() == []


def test_shuffled_columns_keep_their_values(spark):
    x = np.random.default_rng(2).normal(size=(500, 5))
    got = {r.id: r.v for r in neighbors.shuffle_columns(frame(spark, x, start=7), "id", "v", seed=3).collect()}
    y = np.array([got[i + 7] for i in range(500)])
    assert np.array_equal(np.sort(x, axis=0), np.sort(y, axis=0)) and ((x == y).mean(axis=0) < 0.05).all()
    assert abs(np.corrcoef(np.argsort(np.argsort(y[:, 0])), np.argsort(np.argsort(y[:, 1])))[0, 1]) < 0.2


def test_the_gate_reuses_neighbours(spark):
    e = synthetic.make_embeddings(spark, 200, 12, 4, seed=2, spread=0.3).withColumn("coords", F.slice("embedding", 1, 3))
    low = neighbors.knn(e, 10, "row_id", "coords", metric="euclidean")
    one, two = (ranks.trustworthiness(e, 10, "row_id", "embedding", "coords", low=x).first()[0] for x in (None, low))
    assert one == two and gate.run_gate(e, spec=gate.GateSpec(k=10)).first()["trustworthiness"] == one


def test_overlap_reads_its_tables_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    high = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)], "row_id long, neighbor_id long").mapInArrow(count, "row_id long, neighbor_id long")
    low = spark.createDataFrame([(1, 2), (1, 4), (2, 1), (2, 3), (4, 1)], "row_id long, neighbor_id long")
    assert abs(neighbors.overlap(high, low, 2).first()[0] - 0.5) < 1e-12
    assert read.value == 6


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_bounds_are_carried_over_parts_of_a_block(monkeypatch, metric):
    for name, value in (("FIRST", 20), ("BLOCK", 50), ("PART", 30)):
        monkeypatch.setattr(neighbors, name, value)
    rng = np.random.default_rng(4)
    y = rng.normal(size=(333, 5)).round(1)
    y[:40] = y[100:140]
    y[7] = np.nan
    if metric == "cosine":
        y /= np.linalg.norm(y, axis=1)[:, None]
    ids = np.arange(333) * 3
    parts = [*neighbors._best((ids[:150], y[:150]), (ids, y), 6, metric, 9)]
    got = list(zip(*[np.concatenate(c).tolist() for c in zip(*parts, strict=True)], strict=True))
    want = []
    for i in range(150):
        score = np.round((y * y[i]).sum(1) if metric == "cosine" else np.sqrt(((y - y[i]) ** 2).sum(1)), 9)
        order = sorted((j for j in range(333) if j != i and np.isfinite(score[j])), key=lambda j: (-score[j] if metric == "cosine" else score[j], j))
        want += [(i * 3, j * 3, score[j]) for j in order[:6]]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-9)
