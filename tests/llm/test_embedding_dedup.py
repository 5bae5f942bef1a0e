import numpy as np
import pyspark.sql.functions as F

from corpusloom.llm.embedding_dedup import Index, Pq, near_duplicates


def brute(rows):
    fit = [(k, np.array(v, float), label) for k, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = {}
    for k, v, label in fit:
        groups.setdefault((label, len(v)), []).append((k, v))
    for own in groups.values():
        x = np.array([v for _, v in own])
        size = np.linalg.norm(x, axis=1)
        near = x @ x.T / (size[:, None] * size[None, :]) >= 0.98
        for a, b in zip(*np.nonzero(near), strict=True):
            if a != b:
                links[own[a][0]] += 1
                p, q = find(own[a][0]), find(own[b][0])
                parent[max(p, q)] = min(p, q)
    members = {}
    for k, (i, _, _) in enumerate(rows):
        members.setdefault(find(k), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return sorted(((i, links[k], least[find(k)], i is not None and i == least[find(k)]) for k, (i, _, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    rows = []
    for i in range(1000):
        v = centre[rng.integers(40)] * rng.choice([1, 2]) + rng.normal(size=16) * rng.choice([0, 0.02, 0.12, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [None] + [1.0] * 15, 1), (5003, [float("nan")] * 16, 1), (5004, rows[3][1], None), (5005, *rows[3][1:]), (5005, *rows[3][1:]), (5006, [1.0, 2.0], 1), (5007, [1.0, 2.0], 1), (5008, [], 1), (5009, [float("inf")] + [0.0] * 15, 1), (None, *rows[4][1:]), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x")).withColumn("list", F.lit(1))
    got = near_duplicates(df, Pq(list_size=100, block=50)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert near_duplicates(df.limit(0)).collect() == []


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in df.collect()]
    got = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    want = {i: n for i, n, _, _ in brute(rows)}
    assert sum(got.values()) >= 0.9 * sum(want.values()) and all(got[i] <= want[i] for i in want)


def test_many_lists_and_a_hot_label(spark):
    """Over 30 lists, two of three vectors in one label, a hot list cut into blocks of members and of queries: recall is 1."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).round(4).tolist(), 0 if i % 3 else int(rng.integers(1, 4))) for i in range(1500)]
    hot = rng.normal(size=16)
    rows += [(i, (hot + rng.normal(size=16) * 0.05).round(4).tolist(), 0) for i in range(1500, 2100)]
    rows += [(i, (np.array(rows[i - 2100][1]) + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])).round(4).tolist(), rows[i - 2100][2]) for i in range(2100, 2600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = near_duplicates(df, Pq(list_size=60, block=64, query_block=100)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_probes_miss_no_list_that_holds_a_neighbour():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 24)) * 0.12
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    index = Index(unit[::3], len(unit), Pq(list_size=60))
    own, _, _, reach = index.place(unit)
    assert len(index.coarse) >= 30 and own.max() >= 29
    widest = np.zeros(len(index.coarse))
    np.maximum.at(widest, own, reach)
    asks = [{int(l) for l, d in zip(*p, strict=True) if d <= widest[l] + index.radius} for p in index.probes(unit, own)]
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))
    assert len(a) > 300 and all(own[j] in asks[i] or own[i] in asks[j] for i, j in zip(a, b, strict=True))


def test_columns_of_the_operator_in_the_input(spark):
    rows = [(1, [1.0, 2.0], "a", 1), (2, [1.0, 2.0], "a", 2), (2, [1.0, 2.0], "b", 3), (None, [1.0, 2.001], "a", 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, cid int").selectExpr("*", "1 as list", "1 as block", "1 as own", "1 as raw", "1 as component_id", "true as kept")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [("1", 2, 1, True), ("2", 0, 2, True), ("2", 2, 1, False), ("None", 2, 1, False)]
