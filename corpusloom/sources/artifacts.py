"""Binary artefacts for a viewer: writing, manifest, verification.

Headerless little-endian arrays in row order.  Rows are packed where they lie and
put at their places of a file by the tasks (``packed``); check sums and compressed
twins are made by a task for each file, a piece at a time.  The driver writes the
manifest, last and at once, and never sees the files' content.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import platform
import struct
import subprocess
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.functions.coords import AXES, BOX, I16, normalize, palette, quantize, spec
from corpusloom.operators.rows import materialise
from corpusloom.sources import packed

# File names and limits of the contract.
COORDS, COLORS, LABELS, NEIGHBORS, EMBEDDINGS, FACETS, TEXT, OFFSETS, MANIFEST = "coords.i16.bin", "colors.u8.bin", "labels.u16.bin", "neighbors.u32.bin", "embeddings.f32.npy", "facets.u8.bin", "text.bin", "text_offsets.u32.bin", "manifest.json"
#: Instead of OFFSETS where the texts are longer than four bytes can say.
LONG_OFFSETS, MAX_U32 = "text_offsets.u64.bin", 2**32 - 1
SCHEMA_VERSION = 1
GZIP_MIN_SAVING, GZIP_MIN_BYTES = 0.15, 64 * 1024
MAX_LABELS, MAX_FACETS, MAX_VALUES = 65_535, 255, 255
#: Bytes that are read at once, that a task compresses in one part, and that a part knows of the one before; most tasks that compress.
CHUNK, ZIPPED, WINDOW, MAX_ZIPPERS = 1 << 20, 8 << 20, 1 << 15, 512
#: Deflate, no name, no time, unknown system.
GZIP_HEAD = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255])


class ArtifactError(RuntimeError):
    """An artefact set is incomplete or breaks the contract."""


def pieces(df: DataFrame, columns: list[str], dtype: str, head: int = 0) -> DataFrame:
    """(offset, raw): the columns (numbers or arrays of them) as rows of a dense array, whose row ids are 0, 1, 2, ..."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after = None
        for batch in batches:
            if not len(batch):
                continue
            values = np.column_stack([np.stack(batch[c].to_numpy()) if batch[c].dtype == object else batch[c].to_numpy() for c in columns])
            low, high = (np.iinfo(dtype).min, np.iinfo(dtype).max) if np.dtype(dtype).kind in "iu" else (-np.inf, np.inf)
            if values.min() < low or values.max() > high:
                raise ArtifactError(f"{columns} do not fit {dtype}")
            first = int(batch["row_id"].iloc[0])
            if after not in (None, first) or not np.array_equal(batch["row_id"].to_numpy(), np.arange(first, first + len(batch))):
                raise ArtifactError("row ids have gaps or repeat")
            after = first + len(batch)
            yield pd.DataFrame({"offset": [head + first * values.shape[1] * np.dtype(dtype).itemsize], "raw": [np.ascontiguousarray(values, dtype).tobytes()]})

    return df.select("row_id", *columns).repartitionByRange("row_id").sortWithinPartitions("row_id").mapInPandas(run, packed.PIECES)


def digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _digests(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(name, bytes, sha256, crc) of the files that exist, a task each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["name"]:
                path = Path(folder) / name
                if path.exists():
                    sha, crc = hashlib.sha256(), 0
                    with open(path, "rb") as f:
                        while raw := f.read(CHUNK):
                            sha.update(raw)
                            crc = zlib.crc32(raw, crc)
                    yield pd.DataFrame([{"name": name, "bytes": path.stat().st_size, "sha256": sha.hexdigest(), "crc": crc}])

    return spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)), "name").mapInPandas(run, "name string, bytes long, sha256 string, crc long")


def _deflated(spark: SparkSession, folder: str, sizes: dict[str, int]) -> DataFrame:
    """(name, at, raw): parts of the files, compressed each by a task, that are one stream when joined in order.

    A part begins with the bytes before it as its dictionary and ends at a whole
    byte; the last one ends the stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, at in zip(batch["name"], batch["at"], strict=True):
                with open(Path(folder) / name, "rb") as f:
                    f.seek(max(0, at - WINDOW))
                    before = f.read(min(at, WINDOW))
                    z = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, zlib.Z_DEFAULT_STRATEGY, *[before] * bool(before))
                    last = at + ZIPPED >= sizes[name]
                    raw = z.compress(f.read(ZIPPED)) + z.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)
                yield pd.DataFrame({"name": [name], "at": [at], "raw": [raw]})

    parts = [(name, at) for name, size in sizes.items() for at in range(0, size, ZIPPED)]
    return spark.createDataFrame(parts, "name string, at long").repartitionByRange(min(len(parts), MAX_ZIPPERS), "name", "at").mapInPandas(run, "name string, at long, raw binary")


def examined(spark: SparkSession, folder: str, names: list[str], twins: bool) -> DataFrame:
    """(name, bytes, sha256, gzip_bytes, gzip_sha256) of the files that exist; ``twins``: compressed ones are made where they save enough, and stale ones removed."""
    own = _digests(spark, folder, names)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("gzip_bytes", "long"), ("gzip_sha256", "string"))]
    if not twins:
        return own.select("name", "bytes", "sha256", *none)
    found = {r["name"]: r for r in own.collect()}  # a row for each file
    for name in names:
        Path(folder, f"{name}.gz").unlink(missing_ok=True)
    large = {n: r["bytes"] for n, r in found.items() if r["bytes"] >= GZIP_MIN_BYTES}
    kept = []
    if large:
        parts = materialise(_deflated(spark, folder, large), "deflated")
        ends = Window.partitionBy("name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        placed = parts.select("name", "at", F.octet_length("raw").alias("size")).withColumn("offset", F.coalesce(F.sum("size").over(ends), F.lit(0)) + len(GZIP_HEAD))  # a row for each part
        for r in placed.groupBy("name").agg(F.sum("size").alias("size")).collect():
            name, whole = r["name"], len(GZIP_HEAD) + r["size"] + 8
            if whole > large[name] * (1 - GZIP_MIN_SAVING):
                continue
            tail = struct.pack("<LL", found[name]["crc"], large[name] & 0xFFFFFFFF)
            body = parts.where(F.col("name") == name).join(placed.where(F.col("name") == name).select("at", "offset"), "at").select("offset", "raw")
            end = spark.createDataFrame([(whole - 8, tail)], packed.PIECES)
            packed.write_pieces(body.unionByName(end), str(Path(folder, f"{name}.gz")), whole, GZIP_HEAD)
            kept.append(name)
    zipped = {r["name"]: r for r in _digests(spark, folder, [f"{n}.gz" for n in kept]).collect()} if kept else {}
    rows = [(n, r["bytes"], r["sha256"], *([zipped[f"{n}.gz"][c] for c in ("bytes", "sha256")] if n in kept else (None, None))) for n, r in found.items()]
    return spark.createDataFrame(rows, "name string, bytes long, sha256 string, gzip_bytes long, gzip_sha256 string")


class ArtifactWriter:
    """Writes one artefact set into a folder that driver and tasks share, and its manifest last."""

    def __init__(self, folder: str | Path, n: int):
        self.folder, self.n = Path(folder), n
        self.files: list[dict] = []
        self.meta: dict = {}
        self.folder.mkdir(parents=True, exist_ok=True)

    def _listed(self, name: str, dtype: str, width: tuple[int, ...], rows: int | None = None) -> None:
        self.files.append({"name": name, "dtype": dtype, "shape": [self.n if rows is None else rows, *width]})

    def _put(self, name: str, df: DataFrame, columns: list[str], dtype: str, width: tuple[int, ...]) -> None:
        """An array with a row for each row id; the manifest's entry is completed at the end."""
        self._place(name, pieces(df, columns, dtype), self.n * int(np.prod(width, dtype=int)) * np.dtype(dtype).itemsize, df.sparkSession)
        self._listed(name, dtype, width)

    def _place(self, name: str, parts: DataFrame, size: int, spark: SparkSession, head: bytes = b"") -> None:
        self.spark = spark
        try:
            packed.write_pieces(parts, str(self.folder / name), size, head)
        except PySparkException as e:
            raise ArtifactError(f"{name} is not written: {e}") from e

    def add_coords(self, df: DataFrame, box: float = BOX) -> None:
        flat = normalize(df.select("row_id", *AXES), box)
        one = spec(flat).first()
        self._put(COORDS, quantize(flat).withColumn("pad", F.lit(0).cast("short")), ["qx", "qy", "qz", "pad"], "<i2", (4,))
        self.meta["coords"] = {n: [one[f"{n}_{a}"] for a in AXES] for n in ("offset", "half", "min", "max")} | {"radius": one["radius"], "box": box, "i16_scale": I16, "coord_stride": 4, "color_stride": 4}

    def add_labels(self, df: DataFrame, label: str) -> None:
        names = [r["value"] for r in T.vocabulary(df, label).orderBy("code").limit(MAX_LABELS + 1).collect()]
        if len(names) > MAX_LABELS:
            raise ArtifactError(f"{label} has more than {MAX_LABELS} values")
        coded = T.label_encode(df.select("row_id", label), label, "code")
        self._put(LABELS, coded, ["code"], "<u2", ())
        self._put(COLORS, coded.select("row_id", *palette(F.col("code"))), ["r", "g", "b", "a"], "<u1", (4,))
        self.meta["label_names"] = names

    def add_neighbors(self, neighbors: DataFrame, k: int) -> None:
        lists = neighbors.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id"))), lambda s: s["neighbor_id"]).alias("n"))
        self._put(NEIGHBORS, lists, ["n"], "<u4", (k,))

    def add_embeddings(self, df: DataFrame, vector_col: str, origin: str) -> None:
        """The vectors as a NumPy file; where they come from goes with them into the manifest."""
        dim = df.select(F.size(vector_col)).first()[0]
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (self.n, dim)})
        first = head.getvalue()
        self._place(EMBEDDINGS, pieces(df, [vector_col], "<f4", len(first)), len(first) + self.n * dim * 4, df.sparkSession, first)
        self._listed(EMBEDDINGS, "", (dim,))
        self.meta["embeddings"] = {"origin": origin, "dim": dim}

    def add_metadata(self, df: DataFrame, facets: list[str], fields: list[str]) -> None:
        if len(facets) > MAX_FACETS:
            raise ArtifactError("too many facets")
        values, plain = {}, df
        for facet in facets:
            found = [r["value"] for r in T.vocabulary(df, facet).orderBy("code").limit(MAX_VALUES + 1).collect()]
            if len(found) > MAX_VALUES:
                raise ArtifactError(f"{facet} has more than {MAX_VALUES} values; cap it first")
            values[facet] = found
            df = T.label_encode(df, facet, f"code_{facet}")
        self._put(FACETS, df, [f"code_{f}" for f in facets], "<u1", (len(facets),))
        spark = df.sparkSession
        # cleaned behind the shuffle, as its sampling would clean all texts too; written once, so that the parts of the prefix sums are those of the pieces
        record = T.record_text([T.collapse(F.col(c)) for c in fields])
        texts = materialise(plain.select("row_id", *fields).repartitionByRange("row_id").sortWithinPartitions("row_id").select("row_id", F.encode(record, "UTF-8").alias("raw"), F.spark_partition_id().alias("part")), "records")
        totals = texts.groupBy("part").agg(F.sum(F.octet_length("raw")).alias("size"))
        before = totals.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each part
        total = totals.agg(F.sum("size")).first()[0] or 0
        name, dtype = (OFFSETS, "<u4") if total <= MAX_U32 else (LONG_OFFSETS, "<u8")
        # sums within a part, which a sort of the part gives, and of the parts before it
        inside = Window.partitionBy("part").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
        placed = texts.withColumn("start", F.coalesce(F.sum(F.octet_length("raw")).over(inside), F.lit(0))).join(F.broadcast(before), "part").select("row_id", "raw", (F.col("start") + F.col("before")).alias("start"))
        placed = materialise(placed, "placed-records")
        self._place(TEXT, placed.select(F.col("start").alias("offset"), "raw"), total, spark)
        self._listed(TEXT, "", ())
        ends = placed.select((F.col("row_id") + 1).alias("row_id"), (F.col("start") + F.octet_length("raw")).alias("end")).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("row_id"), F.lit(0).cast("long").alias("end")))
        self._place(name, pieces(ends, ["end"], dtype), (self.n + 1) * np.dtype(dtype).itemsize, spark)
        self._listed(name, dtype, (), self.n + 1)
        self.meta["metadata"] = {"facet_fields": facets, "facet_values": values, "text_fields": fields, "field_separator": T.FIELD_SEPARATOR, "record_separator": T.RECORD_SEPARATOR}

    def finish(self, **parts) -> dict:
        """The manifest: written beside the files under another name and renamed at once, when all files are there."""
        found = {r["name"]: r for r in examined(self.spark, str(self.folder), [f["name"] for f in self.files], True).collect()} if self.files else {}
        for f in self.files:
            if f["name"] not in found:
                raise ArtifactError(f"{f['name']} is missing")
            f |= {c: found[f["name"]][c] for c in ("bytes", "sha256", "gzip_bytes", "gzip_sha256")}
        manifest = {"schema_version": SCHEMA_VERSION, "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "n": self.n, **self.meta, **parts, "files": self.files, "provenance": provenance()}
        part = self.folder / f"{MANIFEST}.part"
        part.write_text(json.dumps(manifest, indent=2, ensure_ascii=False), encoding="utf-8")
        part.replace(self.folder / MANIFEST)
        return manifest


def provenance() -> dict:
    import pyarrow
    import pyspark

    commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip() or None
    return {"git_commit": commit, "libraries": {"python": platform.python_version(), "numpy": np.__version__, "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__}}


def read_manifest(folder: str | Path) -> dict:
    try:
        manifest = json.loads((Path(folder) / MANIFEST).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise ArtifactError(f"no manifest in {folder}") from e
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise ArtifactError("unknown schema_version")
    return manifest


def read_array(folder: str | Path, name: str, dtype: str, shape: tuple[int, ...]) -> np.ndarray:
    values = np.frombuffer((Path(folder) / name).read_bytes(), dtype)
    if values.size != int(np.prod(shape)):
        raise ArtifactError(f"{name} has {values.size} elements, not {shape}")
    return values.reshape(shape)


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The set as lazy tables by row_id: points (coordinates, label, facets), neighbors, records.

    The files are read where tasks run; a part of a table is only decoded if it is used.
    """
    manifest = read_manifest(folder)
    listed = {f["name"]: f for f in manifest["files"]}
    c = manifest["coords"]

    def table(name: str, columns: str, decode) -> DataFrame:
        shape, dtype = tuple(listed[name]["shape"]), listed[name]["dtype"]

        width = int(np.prod(shape[1:], dtype=int)) * np.dtype(dtype).itemsize
        size = os.path.getsize(f"{folder}/{name}")
        if size != shape[0] * width:
            raise ArtifactError(f"{name} has {size} bytes, not {shape}")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for first, raw in zip(batch["first"], batch["raw"], strict=True):
                    yield decode(np.frombuffer(raw, dtype).reshape(-1, *shape[1:]), first)

        return packed.read_rows(spark, f"{folder}/{name}", width, shape[0]).mapInPandas(run, f"row_id long, {columns}")

    def frame(values: dict, first: int) -> pd.DataFrame:
        return pd.DataFrame({"row_id": np.arange(first, first + len(next(iter(values.values())))), **values})

    points = table(COORDS, "x double, y double, z double", lambda q, first: frame({a: q[:, k] / c["i16_scale"] * c["half"][k] + c["offset"][k] for k, a in enumerate(AXES)}, first))
    if LABELS in listed:
        names = np.array(manifest["label_names"], object)
        points = points.join(table(LABELS, "label string", lambda q, first: frame({"label": names[q]}, first)), "row_id")
    out = {}
    if FACETS in listed:
        meta = manifest["metadata"]
        values = [(f"facet_{f}", np.array(meta["facet_values"][f], object)) for f in meta["facet_fields"]]
        points = points.join(table(FACETS, ", ".join(f"`{n}` string" for n, _ in values), lambda q, first: frame({n: v[q[:, k]] for k, (n, v) in enumerate(values)}, first)), "row_id")
        offsets = LONG_OFFSETS if LONG_OFFSETS in listed else OFFSETS
        record = F.regexp_replace(F.decode("raw", "UTF-8"), f"{T.RECORD_SEPARATOR}$", "")
        out["records"] = packed.read_records(spark, f"{folder}/{TEXT}", f"{folder}/{offsets}", manifest["n"], np.dtype(listed[offsets]["dtype"]).itemsize).select(F.col("first").alias("row_id"), record.alias("r")).select("row_id", *T.record_fields(F.col("r"), meta["text_fields"]))
    if NEIGHBORS in listed:
        k = listed[NEIGHBORS]["shape"][1]
        out["neighbors"] = table(NEIGHBORS, "rank int, neighbor_id long", lambda q, first: pd.DataFrame({"row_id": np.repeat(np.arange(first, first + len(q)), k), "rank": np.tile(np.arange(1, k + 1), len(q)), "neighbor_id": q.ravel().astype(np.int64)}))
    return {"points": points, **out}


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problem) for every listed file or compressed twin that is missing, resized, altered or of the wrong length."""
    manifest = read_manifest(folder)
    rows = [(f["name"], int(f["bytes"]), f["sha256"], int(f["shape"][0]) if f["dtype"] and f["name"] != EMBEDDINGS else None, f["name"] in (OFFSETS, LONG_OFFSETS)) for f in manifest["files"]]
    rows += [(f["name"] + ".gz", int(f["gzip_bytes"]), f["gzip_sha256"], None, False) for f in manifest["files"] if f["gzip_bytes"] is not None]
    listed = spark.createDataFrame(rows, "name string, bytes long, sha string, rows long, more boolean")
    there = examined(spark, folder, [r[0] for r in rows], False).select("name", F.col("bytes").alias("length"), F.col("sha256").alias("found"))
    problem = F.when(F.coalesce("length", F.lit(0)) == 0, F.when(F.col("bytes") > 0, "missing or empty")).when(F.col("length") != F.col("bytes"), "size").when(F.col("found") != F.col("sha"), "checksum").when(F.col("rows") != F.lit(manifest["n"]) + F.col("more").cast("int"), "rows")
    return listed.join(there, "name", "left").select("name", problem.alias("problem")).where("problem is not null")
