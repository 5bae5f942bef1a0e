"""Ranks of stated neighbours among all rows, by counting whole lists.

Rows are dealt to lists by their nearest centre.  For a row and one of its
neighbours a list lies wholly nearer, wholly farther, or across the neighbour's
distance: the distance to the centre and the list's radius tell which.  Lists that
are wholly nearer count with their size; only members of lists across are compared.
Near lists lie in one block, and a row goes once to each block that has a list
across, so that rows without structure, where all lists are, are not sent more
often than there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.descent import _vectors, whole_groups
from corpusloom.operators.neighbors import LIST_ROWS, LIST_SAMPLE, _centres, _nearest, _pack, knn
from corpusloom.operators.rows import materialise

#: Rows of a list on average, of a block in which rows are compared, and queries that meet a block in one task and at once.
ROWS, BLOCK, ASKS, PART = 256, 32_768, 8192, 128
#: Rows that some queries are compared with at once, so that their squares stay in a cache, and pairs that are measured again at once.
TILE, CLOSE = 2048, 1 << 18

_COUNT = "row_id long, neighbor_id long, before long, compared long"


def _counts(row: np.ndarray, near: np.ndarray, before: np.ndarray, compared: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(row, near.shape[1])), *[pa.array(x.ravel().astype(np.int64)) for x in (near, before, compared)]], names=["row_id", "neighbor_id", "before", "compared"])


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def neighbor_ranks(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_id, neighbor_id, rank, compared) for pairs of equally many neighbours a row.

    ``rows`` are (id, v); rank 1 is the nearest other row by Euclidean distance,
    rounded to nine digits; ties go to the smaller id.  ``compared`` is how many
    rows had to be compared with the pair's distance.
    """
    spark = rows.sparkSession
    packed = materialise(_pack(rows.select("id", "v")), "rank-rows")
    n, size = packed.agg(F.count("*"), F.max(F.length("raw"))).first()
    dim = (size or 8) // 8
    share = min(2**63 - 1, -(2**63) + int(min(1.0, 1.2 * LIST_SAMPLE / max(n, 1)) * 2**64))
    sample = _vectors(pa.array([bytes(r["raw"]) for r in packed.where(F.xxhash64("id") <= share).select("raw").limit(LIST_SAMPLE).collect()], pa.binary()), "<f8", dim)
    if not len(sample):
        sample = _vectors(pa.array([bytes(r["raw"]) for r in packed.select("raw").limit(1).collect()], pa.binary()), "<f8", dim)
    centres = spark.sparkContext.broadcast(_centres(sample, n * (LIST_ROWS // ROWS)) if n else np.zeros((1, dim)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, reach = _nearest(_vectors(batch.column("raw"), "<f8", dim), centres.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(reach)], names=["id", "raw", "own", "reach"])

    members = materialise(packed.mapInArrow(place, "id long, raw binary, own long, reach double"), "rank-lists")
    table = members.groupBy("own").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).collect()  # a row for each list
    radius, sizes = np.full(len(centres.value), -np.inf), np.zeros(len(centres.value), np.int64)
    for r in table:
        radius[r["own"]], sizes[r["own"]] = r["radius"], r["n"]
    order, group, first, units = _blocks(centres.value, sizes)
    shape = spark.sparkContext.broadcast((radius, sizes, order, group, first, units))
    place_of = spark.createDataFrame([(r["own"], int(first[group[r["own"]]]), int(units[group[r["own"]]])) for r in table], "own long, first int, units int")

    both = pairs.select("row_id", F.col("neighbor_id").alias("id")).unionByName(pairs.select("row_id", F.col("row_id").alias("id")).distinct())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first in whole_groups(batches, "row_id"):
            row, ids = (part.column(c).to_numpy() for c in ("row_id", "id"))
            x = _vectors(part.column("raw"), "<f8", dim)
            own, other = np.flatnonzero(row == ids), np.flatnonzero(row != ids)
            gap = np.zeros(len(other))
            at = own[np.searchsorted(row[own], row[other])]
            for j in range(dim):
                gap += (x[other, j] - x[at, j]) ** 2
            k = len(other) // len(own)
            cuts = pa.array(np.arange(len(own) + 1) * k, pa.int32())
            near, apart = (pa.ListArray.from_arrays(cuts, pa.array(c)) for c in (ids[other], np.round(np.sqrt(gap), 9)))
            yield pa.RecordBatch.from_arrays([pa.array(row[own]), part.column("raw").combine_chunks().take(pa.array(own)), near, apart], names=["id", "raw", "near", "apart"])

    asks = both.join(packed, "id").select("row_id", "id", "raw").repartition("row_id").sortWithinPartitions("row_id").mapInArrow(measured, "id long, raw binary, near array<long>, apart array<double>")
    asks = materialise(asks, "rank-asks")

    def bounds(x: np.ndarray, apart: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row, list and neighbour whether the list lies wholly nearer, or across."""
        mean, radius = centres.value[lists], shape.value[0][lists]
        far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (mean * mean).sum(1)[None, :] - 2 * x @ mean.T, 0))
        slack = 1e-6 * (1 + far.max(initial=0) + apart.max(initial=0))  # of the product and of rounded distances
        inside = (far + radius)[:, :, None] < apart[:, None, :] - slack
        return inside, ((far - radius)[:, :, None] <= apart[:, None, :] + slack) & ~inside

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks that each row has to meet, and how many rows of the others' lists are nearer than each neighbour."""
        _, sizes, order, group, first, units = shape.value
        starts = np.searchsorted(group[order], np.arange(len(first)))
        for whole in batches:
            for start in range(0, whole.num_rows, PART):
                batch = whole.slice(start, PART)
                x, apart = _vectors(batch.column("raw"), "<f8", dim), _matrix(batch.column("apart"), batch.num_rows)
                inside, across = bounds(x, apart, np.arange(len(sizes)))
                met = np.logical_or.reduceat(across.any(2)[:, order], starts, axis=1)
                quiet = inside & ~met[:, group][:, :, None]
                own = _nearest(x, centres.value)[0]
                before = np.einsum("rlk,l->rk", quiet, sizes) - quiet[np.arange(len(x)), own]  # not the row itself
                row, block = np.nonzero(met)
                times = units[block]
                number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                lists = []
                for counts, values in ((np.full(len(x), before.shape[1]), pa.array(before.ravel().astype(np.int64))), (np.bincount(np.repeat(row, times), minlength=len(x)), pa.array(np.repeat(first[block], times) + number, pa.int32()))):
                    lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "raw", "near", "apart")], pa.array(own, pa.int64()), *lists], names=["id", "raw", "near", "apart", "own", "before", "blocks"])

    plan = materialise(asks.mapInArrow(planned, "id long, raw binary, near array<long>, apart array<double>, own long, before array<long>, blocks array<int>"), "rank-plan")
    probes = plan.select("id", "raw", "near", "apart", "own", F.explode("blocks").alias("block"))
    # a block that very many rows ask meets them in several tasks
    asked = materialise(plan.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts")), "rank-asked")
    left = probes.join(F.broadcast(asked), "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    block = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("units"))).cast("int")
    right = members.join(F.broadcast(place_of), "own").select("id", "raw", "own", block.alias("block")).join(F.broadcast(asked), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["block", "part"]

    def met(q: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and b.num_rows:
            # near rows together, so that they need the same lists
            q, b = q.sort_by("own"), b.sort_by("own")
            x, y, own, ids, list_of = _vectors(q.column("raw"), "<f8", dim), _vectors(b.column("raw"), "<f8", dim), q.column("id").to_numpy(), b.column("id").to_numpy(), b.column("own").to_numpy()
            near, apart = (_matrix(q.column(c), len(x)) for c in ("near", "apart"))
            lists, sizes = np.unique(list_of, return_counts=True)
            number = np.repeat(np.arange(len(lists)), sizes)
            there = np.isin(own, ids)
            middle = y.mean(0)
            short, y_size = (y - middle).astype(np.float32), ((y - middle) ** 2).sum(1)
            for start in range(0, len(x), PART):
                part = slice(start, start + PART)
                inside, across = bounds(x[part], apart[part], lists)
                open_ = across.any((0, 2))
                shut = inside & ~open_[None, :, None]
                count = np.einsum("rlk,l->rk", shut, sizes)
                mine = np.minimum(np.searchsorted(lists, q.column("own").to_numpy()[part]), len(lists) - 1)
                count -= shut[np.arange(len(count)), mine] & (there[part] & (lists[mine] == q.column("own").to_numpy()[part]))[:, None]  # not the row itself
                pick = slice(None) if open_.all() else open_[number]
                count += _nearer(x[part], y[pick], own[part], ids[pick], near[part], apart[part], middle, short[pick], y_size[pick])
                out.append(_counts(own[part], near[part], count, np.einsum("rlk,l->rk", across, sizes)))
        return pa.Table.from_batches(out, _counts(*[np.zeros(0, np.int64)], *[np.zeros((0, 1))] * 3).schema)

    compared = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, _COUNT)
    settled = plan.select(F.col("id").alias("row_id"), F.explode(F.arrays_zip("near", "before")).alias("x")).select("row_id", F.col("x.near").alias("neighbor_id"), F.col("x.before").alias("before"), F.lit(0).cast("long").alias("compared"))
    return settled.unionByName(compared).groupBy("row_id", "neighbor_id").agg((F.sum("before") + 1).alias("rank"), F.sum("compared").alias("compared"))


def _blocks(mean: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists in order, the group of each list, and each group's first block and number of blocks.

    Lists lie along their centres' main axis, as many in a group as make a block;
    a longer list is a group of several blocks.
    """
    centred = mean - mean.mean(0)
    order = np.argsort(centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1], kind="stable")
    group, units, held = np.zeros(len(mean), np.int64), [1], 0
    for i in order:
        if held and held + sizes[i] > BLOCK:
            units.append(1)
            held = 0
        group[i] = len(units) - 1
        held += sizes[i]
        units[-1] = max(1, -(-int(held) // BLOCK))
    units = np.array(units)
    return order, group, np.cumsum(units) - units, units


def _nearer(x: np.ndarray, y: np.ndarray, own: np.ndarray, ids: np.ndarray, near: np.ndarray, apart: np.ndarray, middle: np.ndarray, short: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """How many rows of ``y`` are nearer than each distance; on ties those with the smaller id.

    Squares come from a product in single precision (``short`` is y without its
    ``middle``); those within its error of a distance are measured again as the
    distance was.
    """
    count = np.zeros(near.shape, np.int64)
    xs = x - middle
    x_size = (xs * xs).sum(1)
    twice = (-2 * xs).astype(np.float32)
    error = 2.0**-23 * ((x.shape[1] + 8) * (np.sqrt(x_size) + np.sqrt(y_size.max(initial=0)))[:, None] ** 2 + apart * apart)
    # squares less that of the query
    low = np.ascontiguousarray((np.maximum(apart - 1e-9, 0) ** 2 - error - x_size[:, None]).T, np.float32)
    high = np.ascontiguousarray(((apart + 1e-9) ** 2 + error - x_size[:, None]).T, np.float32)
    sorted_ = np.argsort(own)
    at = sorted_[np.minimum(np.searchsorted(own, ids, sorter=sorted_), len(own) - 1)]
    mine = np.flatnonzero(own[at] == ids)

    def number(flags: np.ndarray) -> np.ndarray:
        return np.bitwise_count(flags.view(np.uint64)).sum(1, dtype=np.int64)

    close: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if close:
            row, col, of = (np.concatenate(z) for z in zip(*close, strict=True))
            gap = np.zeros(len(row))
            for j in range(x.shape[1]):
                gap += (x[row, j] - y[col, j]) ** 2
            gap, d = np.round(np.sqrt(gap), 9), apart[row, of]
            nearer = (gap < d) | ((gap == d) & (ids[col] < near[row, of]))
            np.add.at(count, (row[nearer], of[nearer]), 1)
            close.clear()

    for start in range(0, len(y), TILE):
        stop = min(start + TILE, len(y))
        far = np.full((len(x), (stop - start + 7) // 8 * 8), np.inf, np.float32)  # eight flags are counted at once
        far[:, : stop - start] = twice @ short[start:stop].T
        far[:, : stop - start] += y_size[start:stop].astype(np.float32)
        self_ = mine[(mine >= start) & (mine < stop)]
        far[at[self_], self_ - start] = np.inf
        for c in range(near.shape[1]):
            sure = number(far < low[c, :, None])
            count[:, c] += sure
            rows = np.flatnonzero(number(far <= high[c, :, None]) > sure)
            row, col = np.nonzero((far[rows] >= low[c, rows, None]) & (far[rows] <= high[c, rows, None]))
            close.append((rows[row], col + start, np.full(len(row), c)))
            if sum(len(r) for r, _, _ in close) > CLOSE:
                settle()
    settle()
    return count


def trustworthiness(df: DataFrame, k: int, id_col: str, high_col: str, low_col: str, *, cap: int | None = None, seed: int = 0, low: DataFrame | None = None) -> DataFrame:
    """One row: how far low-dimensional neighbours are neighbours in the original space (Venna and Kaski 2001), and the pairs compared for it.

    All rows take part.  A neighbour's rank comes from counting lists of rows
    that lie wholly nearer; ``compared`` are the pairs of rows that had to be
    compared, at most the square of the rows.  A caller may ask for a sample:
    ``cap`` rows chosen by a hash.  ``low`` are the k neighbours in ``low_col`` of
    all rows, where a caller has them already.  Null for k of half the rows or more.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(high_col).cast("array<double>").alias("high"), F.col(low_col).alias("low"))
    if cap is not None:
        rows = rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("trust"), F.col("id").cast("string"))), "id").limit(cap)
    rows = materialise(rows, "trust-rows")
    n = rows.count()
    if n <= k + 1 or 2 * k >= n:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("trustworthiness"), F.lit(0).cast("long").alias("compared"))
    # written, as ranks read them twice
    low = materialise(knn(rows, k, "id", "low", metric="euclidean"), "trust-low") if low is None or cap is not None else low
    low = low.select("row_id", "neighbor_id")
    ranks = neighbor_ranks(rows.select("id", F.col("high").alias("v")), low)
    beyond = F.coalesce(F.sum(F.greatest(F.col("rank") - k, F.lit(0))), F.lit(0))
    return ranks.agg((1 - beyond * 2.0 / (n * k * (2.0 * n - 3.0 * k - 1.0))).alias("trustworthiness"), F.floor(F.sum("compared") / k).alias("compared"))
