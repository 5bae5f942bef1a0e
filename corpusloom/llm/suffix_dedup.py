"""Removal of long repeated byte strings by suffix arrays of shards.

A shard has to hold every copy of what it compares.  So texts are cut into paths:
consecutive windows of LENGTH bytes with the same anchor, the leftmost least hash
of ANCHOR bytes inside the window.  Equal windows have equal anchors at equal
offsets, so they meet where paths of one anchor meet.

1. Anchors that occur once carry no repeat; their paths fall out (an aggregate
   with partial sums, then a join).
2. Paths that are the same byte for byte are one string with a flag that it came
   more than once.
3. Strings are dealt to shards by anchor.  A shard sorts all suffixes of its
   strings by induced sorting and computes their permuted common prefixes: a
   window is repeated where at least LENGTH bytes are common with the suffix
   before or behind it, or where its string came more than once.
4. An anchor with over HOT different strings would be an unbounded part of one
   shard (a frequent passage with other surroundings each time): its windows are
   dealt out one by one and compared by two 64-bit hashes.
5. Repeated windows go back to all paths of their string and cover the bytes that
   are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.runtime import materialise, partitions, text_rows, tidy
from corpusloom.llm.substring_dedup import BASES, Spans
from corpusloom.llm.suffix_arrays import lanes_of, permuted_common_prefixes, suffix_array
from corpusloom.llm.words import mix

LENGTH = 200
#: Bytes of an anchor.
ANCHOR = 64
#: Different strings of an anchor, and bytes of a shard, at most (a shard: on average).
HOT, SHARD = 4096, 1 << 21
#: Bytes of text that a task hashes at a time.
PART = 1 << 19

#: UTF-8 has no bytes 254 and 255; moved by two, these values end the whole and each string.
_SENTINEL, _SEPARATOR = 0, 1

_HASH_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, start in its text and first byte of each piece): pieces of texts, LENGTH - 1 bytes of overlap, about PART bytes at a time."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    pieces: list[tuple[int, int, int]] = []
    held = 0

    def part() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, starts, sizes = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        joined = np.concatenate([data[offsets[r] + a : offsets[r] + a + n] for r, a, n in pieces])
        return joined, rows, starts, np.r_[0, np.cumsum(sizes)]

    for row, size in enumerate(np.diff(offsets).tolist()):
        for start in range(0, max(1, size - LENGTH + 1), PART):
            n = min(PART + LENGTH - 1, size - start)
            if n < LENGTH:
                continue
            pieces.append((row, start, n))
            held += n
            if held >= PART:
                yield part()
                pieces, held = [], 0
    if pieces:
        yield part()


def least_anchors(h: np.ndarray) -> np.ndarray:
    """For each window of the hashes of k-mers the place of its leftmost least; one less than LENGTH - ANCHOR windows follow the last."""
    width = LENGTH - ANCHOR + 1
    places = np.uint64((1 << 24) - 1)
    keys = (mix(h) & ~places) | np.arange(len(h), dtype=np.uint64)
    n = -(-len(keys) // width) * width
    padded = np.full(n, ~np.uint64(0))
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = len(keys) - width + 1
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & places).astype(np.int64)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, row, start, first in _parts(batch.column("text")):
            spans = Spans(_HASH_OF_BYTE[data], BASES[0])
            at = np.arange(len(data) - ANCHOR + 1)
            h = spans(at, at + ANCHOR)
            piece = np.repeat(np.arange(len(row)), np.diff(first))
            last = first[1:][piece] - LENGTH
            window = np.flatnonzero(np.arange(len(data)) <= last)
            anchor, of = least_anchors(h)[window], piece[window]
            begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])])
            count = np.diff(np.r_[begin, len(window)])
            a, of = window[begin], of[begin]
            digest = spans(a, a + count + LENGTH - 1)
            own = pa.array(row[of])
            place = (start[of] + a - first[of]) << 16 | count
            yield pa.RecordBatch.from_arrays([pa.array(h[anchor[begin]].view(np.int64)), pa.array(digest.view(np.int64)), batch.column("k1").take(own), batch.column("k2").take(own), pa.array(place)], names=["anchor", "digest", "k1", "k2", "place"])


def _chosen(batch: pa.RecordBatch) -> Iterator[tuple[dict, bytes]]:
    for text, paths in zip(batch.column("text"), batch.column("paths"), strict=True):
        data = text.as_buffer()
        for path in paths.as_py():
            start = path["place"] >> 16
            yield path, data[start : start + (path["place"] & 0xFFFF) + LENGTH - 1].to_pybytes()


def _strings(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                found = list(_chosen(batch.slice(i, 64)))
                anchor = np.array([p["anchor"] for p, _ in found], np.int64)
                shard = (mix(anchor.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(anchor), pa.array([p["digest"] for p, _ in found], pa.int64()), pa.array([p["again"] for p, _ in found], pa.bool_()), pa.array([s for _, s in found], pa.binary())], names=["shard", "anchor", "digest", "again", "string"])

    return run


def repeated_windows(strings: list[bytes], again: np.ndarray) -> list[np.ndarray]:
    """For each string the places whose LENGTH bytes also start at another place of a string, or all of them where it came more than once."""
    sizes = np.array([len(s) + 1 for s in strings])
    t = np.frombuffer(b"".join(s + b"\xff" for s in strings) + b"\xfe", np.uint8) + np.uint8(2)
    lanes = lanes_of(t)
    sa = suffix_array(t, lanes)
    shared = permuted_common_prefixes(t, sa, lanes)
    marked = shared >= LENGTH
    marked[sa[:-1]] |= marked[sa[1:]]  # the other one of each pair
    owner = np.repeat(np.arange(len(strings)), sizes)
    ends = np.cumsum(sizes)[owner] - 1
    place = np.arange(len(owner))
    marked = (marked[: len(owner)] | again[owner]) & (ends - place >= LENGTH)
    found = np.flatnonzero(marked)
    return np.split(found - (np.cumsum(sizes) - sizes)[owner[found]], np.searchsorted(owner[found], np.arange(1, len(strings))))


def _runs(places: np.ndarray) -> list[int]:
    """Runs of consecutive places, first << 16 | count."""
    if not len(places):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(places) != 1])
    return (places[first] << 16 | np.diff(np.r_[first, len(places)])).tolist()


def _marked(shard: pa.Table) -> pa.Table:
    runs = [_runs(x) for x in repeated_windows(shard.column("string").to_pylist(), np.asarray(shard.column("again").to_pylist(), bool))]
    return pa.table({"anchor": shard.column("anchor"), "digest": shard.column("digest"), "runs": pa.array(runs, pa.list_(pa.int32()))})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of every window of the chosen paths."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            found = list(_chosen(batch.slice(i, 64)))
            data = np.frombuffer(b"".join(s for _, s in found), np.uint8)
            sizes = np.array([len(s) for _, s in found])
            count = sizes - LENGTH + 1
            own = np.repeat(np.arange(len(found)), count)
            offset = np.arange(len(own)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
            a = (np.cumsum(sizes) - sizes)[own] + offset
            one, two = (Spans(_HASH_OF_BYTE[data], base)(a, a + LENGTH) for base in BASES)
            anchor, digest = (np.array([p[c] for p, _ in found], np.int64)[own] for c in ("anchor", "digest"))
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(anchor), pa.array(digest), pa.array((offset << 16 | 1).astype(np.int32))], names=["h1", "h2", "anchor", "digest", "run"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            n_bytes, n_removed, spans, sha, kept = [], [], [], [], []
            for text, places in zip(part.column("text"), part.column("places"), strict=True):
                data, cut = text.as_buffer().to_pybytes(), []
                if places.is_valid:
                    place = np.asarray(places.values, np.int64)
                    order = np.argsort(place)
                    start, stop = (place >> 16)[order], ((place >> 16) + (place & 0xFFFF) + LENGTH - 1)[order]
                    reach = np.maximum.accumulate(stop)
                    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
                    cut = list(zip(start[first].tolist(), reach[np.r_[first[1:], len(place)] - 1].tolist(), strict=True))
                edges = [0, *[x for span in cut for x in span], len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(left))
                spans.append([{"start": a, "stop": b} for a, b in cut])
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop), kept.

    Texts are UTF-8 bytes.  Every byte goes that is covered by LENGTH bytes which
    also start at another place of any text, the same one included and overlaps
    allowed; matches never cross texts, and every copy is removed, the first one
    too.  What is kept can be cut inside a character, so it is binary.  Null and
    empty texts and texts under LENGTH bytes keep all (no) bytes.  Rows with equal
    texts, with or without equal ids, are copies of each other.  Texts of any
    length are read whole, further columns are ignored, an empty table gives an
    empty one.
    """
    spark = df.sparkSession
    # a text's key: rows that agree in both have the same text, and so the same repeats
    keyed = text_rows(df, id_col, text_col).select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"))
    found = keyed.select("k1", "k2", "text").mapInArrow(tidy(_paths), "anchor long, digest long, k1 long, k2 long, place long")
    # written, so that the join below shuffles both sides anew and a hot anchor can be split
    anchors = materialise(found.groupBy("anchor").count().where("count > 1").select("anchor"), "repeated-anchors", compact=True)
    repeated = materialise(found.join(anchors, "anchor"), "repeated-paths", compact=True)
    groups = repeated.groupBy("anchor", "digest").agg((F.count("*") > 1).alias("again"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    groups = materialise(groups.select("anchor", "digest", "again", "one.*"), "strings", compact=True)
    hot = materialise(groups.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")), "hot-anchors", compact=True)
    groups = groups.join(hot, "anchor", "left")
    size = groups.where("hot IS NULL").agg(F.sum(F.col("place").bitwiseAND(0xFFFF) + LENGTH)).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD))

    def texts(paths: DataFrame) -> DataFrame:
        chosen = paths.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "anchor", "digest", "again")).alias("paths"))
        return keyed.select("doc_id", "text", "k1", "k2").join(chosen, ["k1", "k2"]).select("text", "paths")

    strings = texts(groups.where("hot IS NULL")).mapInArrow(tidy(_strings(shards)), "shard long, anchor long, digest long, again boolean, string binary")
    marks = strings.groupBy("shard").applyInArrow(_marked, "anchor long, digest long, runs array<int>")
    windows = texts(groups.where("hot AND NOT again")).mapInArrow(tidy(_windows), "h1 long, h2 long, anchor long, digest long, run int")
    # windows of strings that came again count too
    others = texts(groups.where("hot AND again")).mapInArrow(tidy(_windows), "h1 long, h2 long, anchor long, digest long, run int")
    # a path holds no window twice, and paths differ, so a window's other place is in another path
    twice = windows.unionByName(others).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("t1"), F.col("h2").alias("t2"))
    equal = (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")) & (F.col("h1") % 2 == F.col("t1") % 2)
    one_by_one = windows.join(twice, equal, "left_semi").groupBy("anchor", "digest").agg(F.collect_list("run").alias("runs"))
    whole = groups.where("hot AND again").select("anchor", "digest", F.array(F.col("place").bitwiseAND(0xFFFF).cast("int")).alias("runs"))
    marks = marks.where(F.size("runs") > 0).unionByName(one_by_one).unionByName(whole).select(F.col("anchor").alias("a"), F.col("digest").alias("d"), "runs")
    # a third key as above: both sides are shuffled for the join
    same = (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d")) & (F.col("digest") % 2 == F.col("d") % 2)
    start = F.col("place") - F.col("place").bitwiseAND(0xFFFF)
    covered = repeated.join(marks, same).select("k1", "k2", F.transform("runs", lambda r: start + r.cast("long")).alias("runs"))
    places = covered.groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("places"))
    return keyed.select("doc_id", "text", "k1", "k2").join(places, ["k1", "k2"], "left").select("doc_id", "text", "places").mapInArrow(tidy(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>, kept binary")
