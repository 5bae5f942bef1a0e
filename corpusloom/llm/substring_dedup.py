"""Removal of long repeated word sequences by compacting a de Bruijn graph.

The graph's edges are the windows of WINDOW consecutive words.  Listing every
edge would shuffle several times the text, so edges are compacted before they
leave the task that reads a text: consecutive windows with the same anchor (the
leftmost least k-mer hash inside the window) form one path.  Equal windows have
equal anchors at equal offsets, so equal edges only meet in paths of one anchor,
and no path holds an edge twice.

1. Anchors that occur once carry no repeated edge and fall out (one aggregate
   with partial sums, then a join that keeps the paths of repeated anchors).
2. An anchor all of whose occurrences have one and the same path is
   nonbranching: the whole path repeats.  So does any path that occurs twice.
3. For branching anchors one occurrence of each distinct path goes back to its
   source coordinates; its windows are read from the text there and compared by
   128-bit hashes.
4. The repeated coordinates of a text, at most a few for every window length of
   words, meet the text again, and the covered words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.runtime import materialise, tidy
from corpusloom.llm.words import BLANKS, Words, batches_of, mix, split

WINDOW = 35
#: Words of an anchor.
ANCHOR = 8

# Odd multipliers of the two polynomial hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Spans:
    """64-bit hashes of word sequences [a, b) of a batch, one for each base."""

    def __init__(self, word_hashes: np.ndarray, base: np.uint64):
        n = len(word_hashes)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes * _powers(base, n + 1)[:n], out=self.prefix[1:])
        self.back = _powers(_inverse(base), n + 1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.back[a])


def paths(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor hash) of every path; windows count over the batch."""
    n = len(h) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none.astype(np.uint64)
    k_mer = np.zeros(len(h) - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        k_mer = k_mer * BASES[0] + h[j : j + len(k_mer)]
    least, at = mix(k_mer), np.arange(len(k_mer), dtype=np.int64)
    span, want = 1, WINDOW - ANCHOR + 1
    while span < want:  # the leftmost least of `span` k-mers, by doubling
        step = min(span, want - span)
        other, other_at = least[step:], at[step:]
        least, at = least[:-step], at[:-step]
        less = other < least
        least, at = np.where(less, other, least), np.where(less, other_at, at)
        span += step
    text = words.text_of_word()
    window = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    if not len(window):
        return none, none, none, none.astype(np.uint64)
    at, of = at[window], text[window]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
    return of[first], window[first], np.diff(np.r_[first, len(window)]), least[window[first]]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batches_of(batch):
            words = split(part.column("text"), BLANKS)
            h = words.hashes()
            text, start, count, anchor = paths(words, h)
            digest = Spans(h, BASES[0])(start, start + count + WINDOW - 1)
            own = pa.array(text)
            place = (start - words.first[text]) << 32 | count
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), part.column("k1").take(own), part.column("k2").take(own), pa.array(place)], names=["anchor", "digest", "k1", "k2", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the paths at the given places of each text, with both hashes."""
    for batch in batches:
        for part in batches_of(batch):
            words = split(part.column("text"), BLANKS)
            h = words.hashes()
            lists = part.column("places")
            place, times = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            text = np.repeat(np.arange(part.num_rows), times)
            count = place & 0xFFFFFFFF
            own = np.repeat(np.arange(len(place)), count)
            start = (place >> 32)[own] + np.arange(len(own)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
            a = start + words.first[text[own]]
            one, two = (Spans(h, base)(a, a + WINDOW) for base in BASES)
            row = pa.array(text[own])
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), part.column("k1").take(row), part.column("k2").take(row), pa.array(start << 32 | 1)], names=["h1", "h2", "k1", "k2", "place"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, sha, kept = [], [], [], []
        for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            left = words
            if places.is_valid:
                place = np.asarray(places.values, np.int64)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, place >> 32, 1)
                np.add.at(change, (place >> 32) + (place & 0xFFFFFFFF) + WINDOW - 1, -1)
                left = [w for w, c in zip(words, np.cumsum(change).tolist(), strict=False) if not c]
            joined = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            sha.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are runs of bytes other than space, tab, newline, vertical tab, form
    feed and carriage return.  Every word goes that a window of WINDOW words
    covers whose words also start at another place of any text.  Windows are
    those of the input; every copy is removed, the first one too.  Null texts
    and texts of fewer words than a window keep all (no) words.  Rows with equal
    texts, with or without equal ids, are copies of each other.  Texts of any
    length are read whole, further columns are ignored, an empty table gives an
    empty one.
    """
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    # a text's key: rows that agree in both have the same text, and so the same repeats
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"))
    found = keyed.select("k1", "k2", "text").mapInArrow(tidy(_paths), "anchor long, digest long, k1 long, k2 long, place long")
    # written, so that the join below shuffles both sides anew and a hot anchor can be split
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("branching"))
    anchors = materialise(anchors, "repeated-anchors", compact=True)
    open_ = lambda c: F.when(F.col("branching"), F.col(c)).alias(c)
    repeated = materialise(found.join(anchors, "anchor").select(open_("anchor"), open_("digest"), "k1", "k2", "place", "branching"), "repeated-paths", compact=True)
    branching = repeated.where("branching")
    groups = materialise(branching.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one")), "branching-paths", compact=True)
    whole = repeated.where("not branching").select("k1", "k2", "place").unionByName(branching.join(groups.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("k1", "k2", "place"))
    chosen = groups.select("one.*").groupBy("k1", "k2").agg(F.collect_list("place").alias("places"))
    windows = keyed.select("doc_id", "text", "k1", "k2").join(chosen, ["k1", "k2"]).select("k1", "k2", "text", "places").mapInArrow(tidy(_windows), "h1 long, h2 long, k1 long, k2 long, place long")
    # the chosen paths differ and hold no window twice, so a window's other place is in another chosen path
    # with a third key, here a bit of the first, the counts are shuffled for the join as well, so that a hot window can be split
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("t1"), F.col("h2").alias("t2"))
    equal = (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")) & (F.col("h1") % 2 == F.col("t1") % 2)
    single = windows.join(twice, equal, "left_semi").select("k1", "k2", "place")
    places = whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_list("place").alias("places"))
    return keyed.select("doc_id", "text", "k1", "k2").join(places, ["k1", "k2"], "left").select("doc_id", "text", "places").mapInArrow(tidy(_cut), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
