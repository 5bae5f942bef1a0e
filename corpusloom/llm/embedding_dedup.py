"""Near-duplicate vectors with product quantisation and inverted lists.

Coarse centroids and the codebooks of the residuals' subspaces are fitted on a
bounded sample; every vector is then indexed: its list, the codes of its
residual, and the length of what the codes leave out.  A vector probes each list
whose border with its own list, and whose outermost member, lie within the
radius, so no neighbour can hide in a list that is not probed.  Lists are cut
into blocks of members and of queries, so that no list is too much for a task.
In a list, distances come from a lookup table per
query and subspace; a candidate passes if that distance is within the radius plus
what its codes leave out (triangle inequality), so none is lost.  Candidates are
reranked by the exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusloom.llm.components import components
from corpusloom.llm.runtime import materialise, tidy


@dataclass(frozen=True)
class Pq:
    """``sample`` bounds the vectors that centroids and codebooks are fitted on, chosen by a hash."""

    threshold: float = 0.98
    sample: int = 20_000
    list_size: int = 1_500
    max_lists: int = 4_096
    subspaces: int = 8
    codes: int = 256
    block: int = 4_096
    query_block: int = 32_768
    seed: int = 7


#: Queries whose lookup tables are held at once.
QUERIES = 128


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means; an empty mean takes a random row."""
    mean = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, mean)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(mean)
        np.add.at(total, near, x)
        full = count > 0
        mean[full] = total[full] / count[full, None]
        mean[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return mean


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[k : k + 4096], mean).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    """Coarse centroids and codebooks; all its arrays together are bounded by the parameters."""

    def __init__(self, sample: np.ndarray, n: int, params: Pq):
        rng = np.random.default_rng(params.seed)
        self.params, dim = params, sample.shape[1]
        self.coarse = _means(sample, max(1, min(n // params.list_size, params.max_lists, len(sample))), rng)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, dim, min(params.subspaces, dim) + 1).astype(int)
        self.books = [_means(np.ascontiguousarray(rest[:, a:b]), min(params.codes, len(sample)), rng) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * params.threshold))) + 1e-6

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, length of what the codes leave out, and distance from the list's centre, of unit vectors."""
        own = _nearest(unit, self.coarse)
        rest = unit - self.coarse[own]
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        left = np.zeros(len(unit))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            codes[:, m] = _nearest(rest[:, a:b], book)
            left += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1)
        return own, codes, np.sqrt(left), np.linalg.norm(rest, axis=1)

    def probes(self, unit: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector the lists, from its own upwards, that a neighbour can be in, and how far their centres are."""
        apart = np.sqrt(_distances(self.coarse, self.coarse))
        for k in range(0, len(unit), 4096):
            d = _distances(unit[k : k + 4096], self.coarse)
            mine = own[k : k + 4096]
            least = d[np.arange(len(d)), mine][:, None]
            near = d - least <= 2 * apart[mine] * self.radius + 1e-9
            near &= np.arange(d.shape[1])[None, :] >= mine[:, None]
            near[np.arange(len(d)), mine] = True
            for x, far in zip(near, np.sqrt(d), strict=True):
                at = np.flatnonzero(x)
                yield at, far[at]

    def tables(self, unit: np.ndarray, list_: int) -> np.ndarray:
        """Squared distances [query, subspace, code] from the queries to the codes of a list."""
        rest = unit - self.coarse[list_]
        out = np.zeros((len(unit), len(self.books), max(len(b) for b in self.books)), np.float32)
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            out[:, m, : len(book)] = _distances(rest[:, a:b], book)
        return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors in double precision; the bytes are single precision where the input was."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * dim else "<f8").reshape(-1, dim).astype(np.float64) if raw else np.zeros((0, dim))


def _join(members: list[pa.RecordBatch], queries: pa.RecordBatch, index: Index, dim: int, seen: np.ndarray) -> Iterator[tuple]:
    """Compares a block's members with queries; adds the members' links to ``seen``, yields the queries' and forest links."""
    cid = np.concatenate([b.column("cid").to_numpy() for b in members])
    times = np.concatenate([b.column("times").to_numpy() for b in members])
    raw = np.concatenate([_vectors(b.column("raw"), dim) for b in members])
    codes = np.frombuffer(b"".join(x for b in members for x in b.column("codes").to_pylist()), np.uint8).reshape(len(cid), -1)
    bound = (np.concatenate([b.column("left").to_numpy() for b in members]) + index.radius).astype(np.float32) + np.float32(1e-4)
    norm = np.linalg.norm(raw, axis=1)
    list_ = members[0].column("list")[0].as_py()
    for k in range(0, queries.num_rows, QUERIES):
        part = queries.slice(k, QUERIES)
        q_cid, q_times, q_own = (part.column(c).to_numpy() for c in ("cid", "times", "own"))
        q_raw = _vectors(part.column("raw"), dim)
        q_norm = np.linalg.norm(q_raw, axis=1)
        table = index.tables(q_raw / q_norm[:, None], list_)
        total = np.zeros((len(q_cid), len(cid)), np.float32)
        for m in range(codes.shape[1]):
            total += table[:, m, :][:, codes[:, m]]
        near = total <= bound[None, :] ** 2
        # in a query's own list every pair shows twice; the smaller class asks
        near &= (q_own[:, None] != list_) | (q_cid[:, None] < cid[None, :])
        a, b = np.nonzero(near)
        hit = np.concatenate([(q_raw[a[j : j + 65536]] * raw[b[j : j + 65536]]).sum(1) / (q_norm[a[j : j + 65536]] * norm[b[j : j + 65536]]) >= index.params.threshold for j in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
        a, b = a[hit], b[hit]
        if not len(a):
            continue
        np.add.at(seen, b, q_times[a])
        linked = np.bincount(a, times[b], len(q_cid)).astype(np.int64)
        asked = np.flatnonzero(linked)
        yield q_cid[asked], np.full(len(asked), -1), linked[asked]
        node, label = np.concatenate([q_cid, cid]), np.arange(len(q_cid) + len(cid))
        b = b + len(q_cid)
        while not (label[a] == label[b]).all():
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield node[moved], node[label[moved]], np.zeros(len(moved), np.int64)


def _links(classes: DataFrame, dim: int, width: int, params: Pq) -> DataFrame:
    """(cid, other, n): forest links with n = 0; with n > 0 the number of rows that a class links to in some block."""
    spark = classes.sparkSession
    n = classes.count()
    low = -(2**63)
    chosen = classes.where(F.col("cid") <= min(low + int(min(1.0, 1.1 * params.sample / max(n, 1)) * 2**64), 2**63 - 1)).limit(params.sample).select("raw").collect()  # params.sample rows
    sample = np.frombuffer(b"".join(bytes(r["raw"]) for r in chosen), f"<f{width}").reshape(-1, dim).astype(np.float64)
    schema = "cid long, other long, n long"
    if n < 2 or not len(sample):
        return spark.createDataFrame([], schema)
    index = spark.sparkContext.broadcast(Index(sample / np.linalg.norm(sample, axis=1)[:, None], n, params))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _vectors(batch.column("raw"), dim)
            unit = raw / np.linalg.norm(raw, axis=1)[:, None]
            own, codes, left, reach = index.value.place(unit)
            lists, far = zip(*index.value.probes(unit, own), strict=True) if len(own) else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "label", "times", "raw")), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), pa.array(reach), pa.array(lists, pa.list_(pa.int32())), pa.array(far, pa.list_(pa.float64()))], names=["cid", "label", "times", "raw", "own", "codes", "left", "reach", "probes", "far"])

    placed = materialise(classes.mapInArrow(tidy(place), f"cid long, label {classes.schema['label'].dataType.simpleString()}, times long, raw binary, own int, codes binary, left double, reach double, probes array<int>, far array<double>"), "vectors")
    # one row for each list of a label: how far it reaches, and how many blocks it takes
    lists = placed.groupBy("label", F.col("own").alias("list")).agg(F.max("reach").alias("reach"), F.ceil(F.count("*") / params.block).cast("int").alias("blocks"))
    asked = placed.select("label", F.explode(F.arrays_zip("probes", "far")).alias("p")).select("label", F.col("p.probes").alias("list"), F.col("p.far").alias("far")).join(lists, ["label", "list"]).where(F.col("far") <= F.col("reach") + index.value.radius)
    blocks = materialise(lists.join(asked.groupBy("label", "list").agg(F.ceil(F.count("*") / params.query_block).cast("int").alias("query_blocks")), ["label", "list"]), "vector-lists", compact=True)
    common = ["label", "list", "block", "query_block", "cid", "times", "raw", "own"]
    part = lambda salt, of: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    members = placed.withColumn("list", F.col("own")).join(blocks.drop("reach"), ["label", "list"]).withColumn("block", part(0, "blocks")).withColumn("query_block", each("query_blocks")).select(*common, F.lit(0).alias("asks"), "codes", "left")
    queries = placed.withColumn("p", F.explode(F.arrays_zip("probes", "far"))).withColumn("list", F.col("p.probes")).join(blocks.withColumnRenamed("reach", "list_reach"), ["label", "list"]).where(F.col("p.far") <= F.col("list_reach") + index.value.radius)
    queries = queries.withColumn("query_block", part(1, "query_blocks")).withColumn("block", each("blocks")).select(*common, F.lit(1).alias("asks"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("left"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b, c):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], names=["cid", "other", "n"])

        members: list[pa.RecordBatch] = []
        block, seen = None, None

        def close():
            if seen is not None and seen.any():
                own = np.concatenate([b.column("cid").to_numpy() for b in members])
                at = np.flatnonzero(seen)
                yield rows(own[at], np.full(len(at), -1), seen[at])

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("label", "list", "block", "query_block", "asks")), strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)] if key else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if key[a][:4] != block:
                    yield from close()
                    block, members, seen = key[a][:4], [], None
                if key[a][4] == 0:
                    members.append(part)
                elif members:
                    if seen is None:
                        seen = np.zeros(sum(m.num_rows for m in members), np.int64)
                    for found in _join(members, part, index.value, dim, seen):
                        yield rows(*found)
        yield from close()

    return members.unionByName(queries).repartition("label", "list", "block", "query_block").sortWithinPartitions("label", "list", "block", "query_block", "asks").mapInArrow(tidy(compare), schema)


def near_duplicates(df: DataFrame, params: Pq = Pq(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine is at
    least ``params.threshold``.  Null, empty and zero vectors, vectors with null
    or non-finite components and vectors without a label link with nothing;
    vectors of different lengths do not link either.  Equal vectors of a label
    are one class, compared once; ``n_links`` counts the other rows, copies
    included.  ``component_id`` is the smallest id reachable, the row's own
    included, ``kept`` tells whether it is the row's own.  Repeated ids are
    separate rows.  Further columns are ignored, an empty table gives an empty
    one.
    """
    vector = df[vector_col].cast("array<double>")
    fit = df[label_col].isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].alias("label"), F.when(F.coalesce(fit, F.lit(False)), vector).alias("vector"))
    rows = rows.withColumn("cid", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    classes = rows.where("vector is not null").groupBy("cid", "label", "vector").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    # bytes of a component: what the input has is kept, not more
    width = 4 if isinstance(df.schema[vector_col].dataType, ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, FloatType) else 8

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "label", "times", "least")), pa.array([flat[a:b].astype(f"<f{width}").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["cid", "label", "times", "least", "raw"])

    label_type = df.schema[label_col].dataType.simpleString()
    classes = materialise(classes.select("cid", "label", "times", "least", "vector").mapInArrow(tidy(pack), f"cid long, label {label_type}, times long, least long, raw binary"), "vector-classes", compact=True)
    # lengths that more than one vector has; a table of embeddings has one or a few
    dims = [r[0] // width for r in classes.groupBy(F.length("raw")).count().where("count > 1").collect()]
    found = df.sparkSession.createDataFrame([], "cid long, other long, n long")
    for dim in sorted(dims):
        found = found.union(_links(classes.where(F.length("raw") == width * dim), dim, width, params))
    found = materialise(found, "vector-links", compact=True)
    linked = found.where("n > 0").groupBy("cid").agg(F.sum("n").alias("linked"))
    labels = components(found.where("n = 0").select(F.col("cid").alias("a"), F.col("other").alias("b"))).toDF("cid", "root")
    joined = materialise(classes.select("cid", "times", "least").join(linked, "cid", "left").join(labels, "cid", "left").select("cid", "least", (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "vector-roots", compact=True)
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.select("vec_id", "cid").join(joined.join(ids, "root").select("cid", "n_links", "component_id"), "cid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
