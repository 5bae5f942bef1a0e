"""Exact nearest neighbours in lists or blocks, and the measures built on them.

All neighbour tables have the columns (row_id, rank, neighbor_id, score); rank
starts at 1, a row is never its own neighbour, ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.vectors import l2_normalize
from corpusloom.operators.rows import dense_ids, materialise

#: Rows of a block; a task holds two blocks and, for a part of the queries at a time, their product.
BLOCK = 8192
#: Queries compared at once, and rows that they are compared with first.
PART, FIRST = 512, 1024
#: Rows of a block of queries and of rows, and bytes of either, where every block meets every block; and how many blocks a side is cut to at least, if they keep SMALL rows.
QUERY_ROWS, BASE_ROWS, SIDE_BYTES, SIDE_BLOCKS, SMALL = 16_384, 65_536, 64 << 20, 6, 2048
#: Up to so many dimensions, rows are dealt to lists that let most of the others be skipped.
LIST_DIMS = 8
#: Rows from which lists are worth their extra passes.
LIST_MIN = 4 * BLOCK
#: Rows of a list, lists, and rows that the lists' centres are fitted on, at most.
LIST_ROWS, MAX_LISTS, LIST_SAMPLE = 2048, 4096, 20_000

_FOUND = "row_id long, neighbor_id long, score double"


def _distances(x: np.ndarray, y: np.ndarray, digits: int = 9) -> np.ndarray:
    """Euclidean distances, summed dimension by dimension so that equal rows are at exactly 0."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        total += (x[:, [j]] - y[:, j][None, :]) ** 2
    return np.round(np.sqrt(total), digits)


def _pack(df: DataFrame) -> DataFrame:
    """(id, raw) of (id, v): the vector's bytes, which tasks read without a step per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            cuts, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).astype("<f8")
            raw = flat[cuts[0] : cuts[-1]].tobytes()
            cuts = ((cuts - cuts[0]) * 8).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["id", "raw"])

    return df.select("id", "v").mapInArrow(run, "id long, raw binary")


def _unpack(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors."""
    ids = table.column("id").to_numpy()
    x = np.frombuffer(b"".join(table.column("raw").to_pylist()), "<f8").reshape(len(ids), dim)
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _best(q: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int, metric: str, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, neighbour ids, scores), the k best of ``b`` for each of ``q``, by part; ties go to the smaller id.

    Candidates come from matrix products with some rows of ``b`` at a time: the
    first give a bound of the k-th, and later ones only add what is within an
    error of it.  Only candidates are measured exactly and sorted.  Unit vectors
    are multiplied in single precision, whose error is part of the bound.
    """
    (q_ids, x_all), (b_ids, y_all) = q, b
    if not len(b_ids):
        return
    cosine = metric == "cosine"
    y_size = (y_all * y_all).sum(1)
    y_most = y_size.max(initial=0, where=np.isfinite(y_size))
    fast = np.float32 if cosine else np.float64
    y_fast = np.ascontiguousarray(y_all, fast)
    # the first rows are few, so that the bound costs little
    cuts = sorted({0, *range(max(FIRST, 4 * k), len(b_ids), BLOCK), len(b_ids)})
    for start in range(0, len(q_ids), PART):
        ids, x = q_ids[start : start + PART], x_all[start : start + PART]
        x_fast, x_size = np.ascontiguousarray(x, fast), (x * x).sum(1)
        # of products and of rounded scores; in the slack of a distance near 0 lie squares up to about the slack itself
        slack = 2 * 10.0**-digits + 2.0**-22 * (x.shape[1] + 2) if cosine else 1e-9 * (1 + x_size.max(initial=0, where=np.isfinite(x_size)) + y_most)
        at = np.minimum(np.searchsorted(b_ids, ids), len(b_ids) - 1)
        own = np.flatnonzero(b_ids[at] == ids)
        limit = np.full(len(ids), np.inf)
        row, col, cost = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, fast)
        for low, high in zip(cuts, cuts[1:], strict=False):
            here = x_fast @ y_fast[low:high].T
            if cosine:
                np.negative(here, out=here)
            else:
                here = x_size[:, None] + y_size[None, low:high] - 2 * here
            mine = own[(at[own] >= low) & (at[own] < high)]
            here[mine, at[mine] - low] = np.inf
            if not low and k <= high:
                kth = np.partition(here, k - 1, axis=1)[:, k - 1].astype(np.float64)
                limit = np.where(np.isnan(kth), np.inf, _reach(kth, slack, cosine, digits))
            r, c = np.nonzero(here <= limit[:, None].astype(fast))
            v = here[r, c]
            sound = np.isfinite(v)
            row, col, cost = np.concatenate([row, r[sound]]), np.concatenate([col, c[sound] + low]), np.concatenate([cost, v[sound]])
            order = np.lexsort((cost, row))
            row, col, cost = row[order], col[order], cost[order]
            first = np.searchsorted(row, np.arange(len(ids)))
            full = np.diff(np.r_[first, len(row)]) >= k
            limit[full] = np.minimum(limit[full], _reach(cost[first[full] + k - 1].astype(np.float64), slack, cosine, digits))
            near = cost <= limit[row]
            row, col, cost = row[near], col[near], cost[near]
        if cosine:
            score = np.round(np.einsum("ij,ij->i", x[row], y_all[col]), digits)
            key = -score
        else:
            total = np.zeros(len(row))
            for j in range(x.shape[1]):
                total += (x[row, j] - y_all[col, j]) ** 2
            score = key = np.round(np.sqrt(total), digits)
        order = np.lexsort((b_ids[col], key, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        yield ids[row[place < k]], b_ids[col[place < k]], score[place < k]


def _reach(kth: np.ndarray, slack: float, cosine: bool, digits: int) -> np.ndarray:
    """Up to what costs a row may be among the k best, given the k-th cost as computed."""
    return kth + slack if cosine else kth + slack + 2 * np.sqrt(np.maximum(kth, 0)) * 10.0**-digits


def _found(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    parts = [*parts] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    row, neighbor, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.table({"row_id": pa.array(row, pa.int64()), "neighbor_id": pa.array(neighbor, pa.int64()), "score": pa.array(score, pa.float64())})


def knn(df: DataFrame, k: int, id_col: str, vector_col: str, *, metric: str = "cosine", queries: DataFrame | None = None, digits: int = 9, lists: bool | None = None) -> DataFrame:
    """The k nearest rows of ``df`` for every row of ``queries`` (default: of ``df``), exactly.

    Vectors of up to LIST_DIMS dimensions are dealt to lists by distance, and a
    query only meets the lists that can hold one of its neighbours
    (``_list_knn``); beyond that bounds no longer tell lists apart, so every
    block of queries meets every block of rows in one task each, which keeps only
    its k best.  ``lists`` forces one way.  A pair is never a row.  ``score`` is
    the cosine, or the Euclidean distance, rounded so that ties do not depend on
    the order of a sum.  Null ids and vectors are left out; vectors have to be of
    one length.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")

    def valid(rows: DataFrame) -> DataFrame:
        vector = l2_normalize(F.col(vector_col)) if metric == "cosine" else F.col(vector_col).cast("array<double>")
        return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where("id is not null and v is not null")

    rows, asked = valid(df), None if queries is None else valid(queries)
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "row_id long, rank int, neighbor_id long, score double")
    n_q = n if asked is None else asked.count()
    # both sides of a join are told apart by what one of them has written; rows of a block or less are as soon made again
    base = materialise(_pack(rows), "knn-rows") if asked is None or n > BLOCK else _pack(rows)
    asks = base if asked is None else materialise(_pack(asked), "knn-queries")
    if lists is None:
        lists = metric == "euclidean" and dim <= LIST_DIMS and n > LIST_MIN
    found = _list_knn(base, asks, n, dim, k, digits) if lists else _block_knn(base, asks, n, n_q, dim, k, metric, digits)
    order = [F.desc("score") if metric == "cosine" else F.asc("score"), F.asc("neighbor_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("row_id", "rank", "neighbor_id", "score")


def _block_knn(base: DataFrame, asks: DataFrame, n: int, n_q: int, dim: int, k: int, metric: str, digits: int) -> DataFrame:
    """Every block of queries against every block of rows; a row is shuffled once per block of the other side."""

    def sides(rows: int, most: int) -> int:
        return max(1, -(-rows // max(SMALL, min(most, SIDE_BYTES // (8 * dim)))), min(SIDE_BLOCKS, -(-rows // SMALL)))

    base_blocks, query_blocks = sides(n, BASE_ROWS), sides(n_q, QUERY_ROWS)

    def block(blocks: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    left = asks.withColumn("qb", block(query_blocks)).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(base_blocks - 1))))
    right = base.withColumn("bb", block(base_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        return _found(_best(_unpack(q, dim), _unpack(b, dim), k, metric, digits))

    return left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(run, _FOUND)


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """A few rounds of k-means; every list is bounded by its own radius, so any centres are right."""
    rng = np.random.default_rng(0)
    mean = sample[rng.choice(len(sample), min(max(1, n // LIST_ROWS), MAX_LISTS, len(sample)), replace=False)].copy()
    for _ in range(4):
        near = _nearest(sample, mean)[0]
        count, total = np.bincount(near, minlength=len(mean)), np.zeros_like(mean)
        np.add.at(total, near, sample)
        mean[count > 0] = total[count > 0] / count[count > 0, None]
    return mean


def _nearest(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest mean of each row, and its distance."""
    near = np.empty(len(x), np.int64)
    for k in range(0, len(x), 2048):
        part = x[k : k + 2048]
        near[k : k + 2048] = ((mean * mean).sum(1)[None, :] - 2 * part @ mean.T).argmin(1)
    return near, np.linalg.norm(x - mean[near], axis=1)


def _list_knn(base: DataFrame, asks: DataFrame, n: int, dim: int, k: int, digits: int) -> DataFrame:
    """Euclidean neighbours by lists with an exact bound.

    A row belongs to the list of its nearest centre; long lists are cut into
    blocks.  A query first meets a block of its own list, which gives it an upper
    bound of its k-th distance; then every other block whose list's centre is not
    further than that bound and the list's radius together.
    """
    spark = base.sparkSession
    share = min(2**63 - 1, -(2**63) + int(min(1.0, 1.2 * LIST_SAMPLE / n) * 2**64))
    sample = np.frombuffer(b"".join(bytes(r["raw"]) for r in base.where(F.xxhash64("id") <= share).select("raw").limit(LIST_SAMPLE).collect()), "<f8").reshape(-1, dim)
    if not len(sample):
        sample = np.frombuffer(bytes(base.first()["raw"]), "<f8").reshape(-1, dim)
    centres = spark.sparkContext.broadcast(_centres(sample, n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, reach = _nearest(np.frombuffer(b"".join(batch.column("raw").to_pylist()), "<f8").reshape(-1, dim), centres.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(reach)], names=["id", "raw", "own", "reach"])

    def placed(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(place, "id long, raw binary, own long, reach double")

    members = materialise(placed(base), "knn-lists")
    table = members.groupBy("own").agg(F.max("reach").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).collect()  # MAX_LISTS rows
    radius, blocks = np.full(len(centres.value), -np.inf), np.zeros(len(centres.value), np.int64)
    for r in table:
        radius[r["own"]], blocks[r["own"]] = r["radius"], r["blocks"]
    shape = spark.sparkContext.broadcast((radius, blocks))
    many = spark.createDataFrame([(r["own"], r["blocks"]) for r in table], "own long, blocks int")
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    members = members.join(F.broadcast(many), "own").select("id", "raw", F.col("own").alias("list"), block.alias("block"))
    mine = placed(asks).join(F.broadcast(many), "own", "left").select("id", "raw", F.col("own").alias("list"), block.alias("block"))

    def first(q: pa.Table, b: pa.Table) -> pa.Table:
        ids, x = _unpack(q, dim)
        near = _found(_best((ids, x), _unpack(b, dim), k, "euclidean", digits))
        row = np.searchsorted(ids, near.column("row_id").to_numpy())
        have, bound = np.bincount(row, minlength=len(ids)), np.zeros(len(ids))
        np.maximum.at(bound, row, near.column("score").to_numpy())
        bound[have < k] = np.inf
        cuts = pa.array(np.concatenate([[0], np.cumsum(have)]), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, near.column(c).combine_chunks()) for c in ("neighbor_id", "score")]
        own = [pa.array(np.full(len(ids), q.column(c)[0].as_py() if len(ids) else 0), t) for c, t in (("list", pa.int64()), ("block", pa.int32()))]
        return pa.table({"id": pa.array(ids, pa.int64()), "raw": pa.array([v.tobytes() for v in x], pa.binary()), "list": own[0], "block": own[1], "near": lists[0], "score": lists[1], "bound": pa.array(bound)})

    schema = "id long, raw binary, list long, block int, near array<long>, score array<double>, bound double"
    # many queries can lie in one list
    mine = materialise(mine, "knn-mine")
    crowd = mine.groupBy("list", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cut = mine.join(crowd, ["list", "block"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int"))
    copied = members.join(crowd, ["list", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = ["list", "block", "part"]
    begun = cut.select("id", "raw", *own).groupBy(*own).cogroup(copied.select("id", "raw", *own).groupBy(*own)).applyInArrow(first, schema)
    begun = materialise(begun, "knn-own")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, blocks = shape.value
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("raw").to_pylist()), "<f8").reshape(-1, dim)
            bound, own, at = (batch.column(c).to_numpy() for c in ("bound", "list", "block"))
            for start in range(0, len(x), PART):
                part = slice(start, start + PART)
                far = np.sqrt(((x[part, None, :] - centres.value[None, :, :]) ** 2).sum(2))
                row, list_ = np.nonzero(far - radius[None, :] <= bound[part, None] + 1e-6)
                row, list_ = np.repeat(row, blocks[list_]), np.repeat(list_, blocks[list_])
                number = np.arange(len(row)) - np.searchsorted(row * len(radius) + list_, row * len(radius) + list_)
                other = (list_ != own[part][row]) | (number != at[part][row])
                row, list_, number = row[other], list_[other], number[other]
                pick = pa.array(row + start)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("raw").take(pick), pa.array(list_, pa.int64()), pa.array(number, pa.int32())], names=["id", "raw", "list", "block"])

    probes = materialise(begun.select("id", "raw", "list", "block", "bound").mapInArrow(probe, "id long, raw binary, list long, block int"), "knn-probes")
    # a block that very many queries ask meets them in several tasks
    asked = probes.groupBy("list", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    left = probes.join(asked, ["list", "block"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    right = members.join(asked, ["list", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["list", "block", "part"]

    def rest(q: pa.Table, b: pa.Table) -> pa.Table:
        return _found(_best(_unpack(q, dim), _unpack(b, dim), k, "euclidean", digits))

    more = left.select("id", "raw", *keys).groupBy(*keys).cogroup(right.select("id", "raw", *keys).groupBy(*keys)).applyInArrow(rest, _FOUND)
    own = begun.select(F.col("id").alias("row_id"), F.explode(F.arrays_zip("near", "score")).alias("x")).select("row_id", F.col("x.near").alias("neighbor_id"), F.col("x.score").alias("score"))
    return own.unionByName(more)


def label_purity(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the mean agreement of a row's label with its neighbours' (labels: row_id, label)."""
    own = labels.select("row_id", F.col("label").alias("own"))
    other = labels.select(F.col("row_id").alias("neighbor_id"), F.col("label").alias("other"))
    return neighbors.join(own, "row_id").join(other, "neighbor_id").agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("purity"))


def overlap(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of neighbours that two tables have in common."""
    # one pass, as either table may be a search that nobody has written
    common = high.join(low.select("row_id", "neighbor_id", F.lit(1).alias("hit")), ["row_id", "neighbor_id"], "left").groupBy("row_id").agg(F.count("hit").alias("common"))
    return common.agg(F.avg(F.col("common") / F.lit(float(k))).alias("overlap"))


def chance_level(labels: DataFrame) -> DataFrame:
    """One row: the purity of random neighbours, the sum of squared label shares."""
    sizes = labels.groupBy("label").count()
    return sizes.agg((F.sum(F.pow(F.col("count").cast("double"), 2.0)) / F.pow(F.sum("count").cast("double"), 2.0)).alias("chance"))


def shuffle_columns(df: DataFrame, id_col: str, vector_col: str, seed: int = 0) -> DataFrame:
    """(id, vector) with every dimension permuted by itself: marginals stay, structure goes.

    A dimension's values in id order meet the ids in hash order.  Both orders
    come from one global numbering each, so that no task holds a dimension;
    vectors have to be of one length.
    """
    ids = dense_ids(df.select(F.col(id_col).alias("id")), "id", id_col="place")
    values = ids.join(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "id").select("id", "place", F.posexplode("v").alias("dim", "value"))
    values = materialise(values, "column-values")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("dim").cast("string"), F.col("id").cast("string")))
    n = ids.count()
    goal = dense_ids(values.select("dim", key.alias("key"), "id"), "dim", "key", "id", id_col="number")
    goal = goal.select("id", "dim", (F.col("number") - F.col("dim").cast("long") * n).alias("place"))
    moved = goal.join(values.select("dim", "place", "value"), ["dim", "place"])
    return moved.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vector")).select(F.col("id").alias(id_col), F.col("vector").alias(vector_col))
