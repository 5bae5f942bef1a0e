"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over a text's shingle hashes.
Texts with equal fingerprints are one class; distinct fingerprints within the
radius are found with structured bit masks (Pagh 2016): bit i carries a vector
m(i) of radius+1 bits, and the mask of a vector v keeps the bits whose m(i) has
an odd product with v.  For any set of at most ``radius`` bits some v is
orthogonal to all of their vectors, so two fingerprints that differ in them
agree under that mask: every pair in the radius meets in some table.

A table's buckets are runs of sorted rows.  A run yields a forest of links, not
its pairs.  A run of more than HOT fingerprints is dealt out again by masks on
the bits that its mask leaves open, with the same guarantee, until runs are
short; the third level has at most 2**8 fingerprints in a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.runtime import materialise, text_rows, tidy, unused

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a run that are compared with each other; longer runs are dealt out again.
HOT = 2048
#: Runs up to this length are compared together, lag by lag.
SHORT = 32


def fingerprint(text: str) -> int:
    """64-bit SimHash of the text's word shingles; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    begin = np.r_[0, end[:-1] + 1]
    width = min(SHINGLE, len(words))
    hash_ = xxhash.xxh64_intdigest
    h = np.array([hash_(joined[a:b], SEED) for a, b in zip(begin[: len(words) - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) for every row: xxhash64 of the text, and a long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return text_rows(df, id_col, text_col).withColumn("text_key", F.xxhash64("text")).mapInArrow(tidy(run), "doc_id long, text_key long, fp long")


def masks(open_bits: int) -> list[int]:
    """Covering masks over the bits set in ``open_bits``."""
    bits = [b for b in range(64) if open_bits >> b & 1]
    top = 1 << (RADIUS + 1)
    vector = {b: k % (top - 1) + 1 for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, top)]


def mask_of(path: int) -> int:
    """All bits that the masks along a path keep; a path has five bits a level, the first level uppermost."""
    kept = 0
    for level in reversed(range(0, path.bit_length(), RADIUS + 1)):
        kept |= masks(~kept & (1 << 64) - 1)[(path >> level & (1 << (RADIUS + 1)) - 1) - 1]
    return kept


def _dealt(path: int, fps: np.ndarray, under: list[int], kept: int) -> Iterator[pa.RecordBatch]:
    """The rows of the next level for the fingerprints of one run."""
    for v, mask in enumerate(under, 1):
        key = fps & np.uint64(kept | mask)
        yield _rows(np.full(len(fps), path << (RADIUS + 1) | v), key, fps)


def _rows(path: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], names=["path", "a", "b"])


def _links(fps: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest links (fingerprint, least fingerprint joined to it in its run); ``run`` ascends."""
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    length = np.diff(np.r_[first, len(run)])
    label = np.arange(len(fps))
    short = np.flatnonzero(np.repeat(length <= SHORT, length))
    pairs_a, pairs_b = [], []
    for lag in range(1, min(SHORT, len(short))):
        a, b = short[:-lag], short[lag:]
        near = (run[a] == run[b]) & (np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS)
        pairs_a.append(a[near])
        pairs_b.append(b[near])
    if pairs_a:
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        while len(a):
            least = np.minimum(label[a], label[b])
            if (label[a] == least).all() and (label[b] == least).all():
                break
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
    for k in np.flatnonzero(length > SHORT):
        own = fps[first[k] : first[k] + length[k]]
        near = np.bitwise_count(own[:, None] ^ own[None, :]) <= RADIUS
        part = np.arange(len(own))
        while True:
            least = np.where(near, part[None, :], len(own)).min(axis=1)
            if (least == part).all():
                break
            part = least
        label[first[k] : first[k] + length[k]] = first[k] + part
    joined = np.flatnonzero(label != np.arange(len(fps)))
    return fps[joined], fps[label[joined]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, key, fp) to links (path -1) and rows of the next level (path of that level)."""
    hot: tuple[int, int] | None = None
    under: list[int] = []
    kept = 0
    rest: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]

    def settle(path: np.ndarray, key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        run = np.cumsum(np.r_[False, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
        many = np.repeat(np.bincount(run), np.bincount(run)) > 1 if len(run) else np.zeros(0, bool)
        if many.any():
            a, b = _links(fps[many], run[many])
            if len(a):
                yield _rows(np.full(len(a), -1), a, b)

    for batch in batches:
        path = np.r_[rest[0], batch.column("path").to_numpy()]
        key = np.r_[rest[1], batch.column("a").to_numpy().view(np.uint64)]
        fps = np.r_[rest[2], batch.column("b").to_numpy().view(np.uint64)]
        if hot:  # a hot run goes on
            same = int(np.argmin(np.r_[(path == hot[0]) & (key == np.uint64(hot[1])), False]))
            if same:
                yield from _dealt(hot[0], fps[:same], under, kept)
            path, key, fps = path[same:], key[same:], fps[same:]
            if not len(path):
                rest = [path, key, fps]
                continue
            hot = None
        change = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])]) if len(path) else np.zeros(0, int)
        if not len(change):
            continue
        length = np.diff(np.r_[change, len(path)])
        cold = np.ones(len(path), bool)
        for k in np.flatnonzero(length > HOT):
            span = slice(change[k], change[k] + length[k])
            hot = (int(path[change[k]]), int(key[change[k]]))
            kept = mask_of(hot[0])
            under = masks(~kept & (1 << 64) - 1)
            yield from _dealt(hot[0], fps[span], under, kept)
            cold[span] = False
        last = change[-1]
        if not cold[-1]:  # the hot run may go on in the next batch
            last = len(path)
        else:
            hot = None
        head = np.flatnonzero(cold[:last])
        yield from settle(path[head], key[head], fps[head])
        rest = [path[last:], key[last:], fps[last:]]
    yield from settle(*rest)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints (column fp, each once) within the radius, transitively."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under = masks((1 << 64) - 1)
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            yield from _dealt(0, fps, under, 0)

    schema = "path int, a long, b long"
    rows = distinct.select("fp").mapInArrow(tidy(deal), schema)
    found = None
    while True:
        out = materialise(rows.repartition("path", "a").sortWithinPartitions("path", "a").mapInArrow(tidy(_compare), schema), "simhash-links", compact=True)
        part = out.where("path < 0").select("a", "b")
        found = part if found is None else found.union(part)
        rows = out.where("path >= 0")
        if rows.isEmpty():
            return found


def _labelled(prints: DataFrame) -> DataFrame:
    """(fp, label) for each distinct fingerprint: fingerprints with equal labels are linked."""
    distinct = materialise(prints.select("fp").distinct(), "fingerprint-classes", compact=True)
    labels = components(links(distinct))
    return materialise(distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label")), "fingerprint-labels", compact=True)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id reachable by links, the row's own
    included; without any id in a component it is null.  Texts without words
    have fingerprint zero and link like others.  Texts of any length are read
    whole.  Repeated rows give repeated results, further columns are ignored,
    an empty table gives an empty one.
    """
    prints = materialise(fingerprints(df, id_col, text_col), "fingerprints")
    labels = _labelled(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = materialise(labels.join(least, "fp"), "fingerprint-ids", compact=True)
    component = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = joined.join(component, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns.

    Null ids come last; of rows with the smallest id one is kept, also where
    whole rows are repeated.  Null and empty texts have fingerprint zero and are
    one group with whatever links to it.  Texts of any length are read whole,
    columns of any names pass through, an empty table stays empty.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    labels = _labelled(prints)
    kept_id, kept_key = unused(docs, "kept_id", "kept_key")
    # by fingerprint first, so that a fingerprint shared by very many rows is summed where they lie
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"))
    chosen = first.join(labels, "fp").groupBy("label").agg(F.min("first").alias("first"))
    chosen = materialise(chosen.select(F.col("first.doc_id").alias(kept_id), F.col("first.text_key").alias(kept_key)), "kept-texts", compact=True)
    mine = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    kept = docs.join(chosen, docs[id_col].cast("long").eqNullSafe(chosen[kept_id]) & (mine == chosen[kept_key]), "left_semi")
    same = prints.join(chosen, prints["doc_id"].eqNullSafe(chosen[kept_id]) & (prints["text_key"] == chosen[kept_key])).groupBy("doc_id", "text_key").count().where("count > 1")
    if same.isEmpty():
        return kept
    return kept.withColumn(kept_key, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([id_col, kept_key]).drop(kept_key)
