"""Toxicity scores: logistic regression trained with FTRL-proximal on hashed n-grams.

Features are single words, pairs of neighbours and pairs with one word between
(skip-grams), hashed into 2**BITS places; a text has a feature or has it not.
Per-coordinate learning rates and the L1 term (McMahan et al. 2013) leave a
small set of weights, which is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.llm.runtime import materialise, tidy, unused
from corpusloom.llm.words import LETTERS, batches_of, mix, split

BITS = 20


@dataclass(frozen=True)
class Ftrl:
    """Training parameters.

    The labelled rows that are used are chosen by a hash of the id and bounded in
    two ways: ``max_rows`` ids, and ``max_bytes`` of their texts together.  An id
    whose texts exceed ``max_text_bytes`` is passed over.  Features take up to
    six times the bytes of a text, so the training task holds
    6 * ``max_bytes`` at most, and the model's three arrays of 2**BITS places.
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0
    epochs: int = 5
    max_rows: int = 20_000
    max_bytes: int = 64 << 20
    max_text_bytes: int = 4 << 20


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram place of a batch, repeats included."""
    words = split(batch.column("text"), LETTERS)
    h, text = words.hashes(), words.text_of_word()
    shift = np.uint64(64 - BITS)
    found, of = [h], [text]
    for gap, salt in ((1, 0xA5A5A5A5), (2, 0x5A5A5A5A)):
        if len(h) > gap:
            same = text[:-gap] == text[gap:]
            found.append(mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(salt))[same])
            of.append(text[:-gap][same])
    return np.concatenate(of), (np.concatenate(found) >> shift).astype(np.int64)


def fit(rows: Iterator[tuple[np.ndarray, int]], params: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not zero; the last place, 2**BITS, is the bias."""
    n_places = (1 << BITS) + 1
    z, n = np.zeros(n_places), np.zeros(n_places)
    rows = list(rows)
    for _ in range(params.epochs):
        for at, label in rows:
            zi, root = z[at], np.sqrt(n[at])
            l1 = np.where(at == n_places - 1, 0.0, params.l1)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((params.beta + root) / params.alpha + params.l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] = zi + g - (np.sqrt(n[at] + g * g) - root) / params.alpha * w
            n[at] += g * g
    l1 = np.full(n_places, params.l1)
    l1[-1] = 0.0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((params.beta + np.sqrt(n)) / params.alpha + params.l2))
    at = np.flatnonzero(w)
    return at, w[at]


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from training: crc32 of the id's digits divides by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from a bounded number of labelled rows (see Ftrl) that are not held out.

    An id with several labels counts as toxic if one of them says so; null ids
    and labels are left out.  Features are taken where the texts lie; one task
    then sees the bounded sample in the order of a hash.  Without any label the
    model scores everything just under 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("doc_id", F.lit("toxicity")))
    count = known.count()
    share = min(1.0, params.max_rows / max(count, 1))
    low = -(2**63)
    sample = known.where(F.col("order") <= min(low + int(share * 2**64), 2**63 - 1)).orderBy("order").limit(params.max_rows)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "order", "label").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("rows"))
    # max_rows rows at most, so that one task can add them up
    sizes = sizes.where((F.col("bytes") <= params.max_text_bytes) & (F.col("rows") <= params.max_rows)).orderBy("order", "doc_id").limit(params.max_rows)
    so_far = Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = (F.sum("bytes").over(so_far) <= params.max_bytes) & (F.sum("rows").over(so_far) <= params.max_rows)
    sample = materialise(sizes.select("doc_id", "order", "label", within.alias("within")).where("within").drop("within"), "toxicity-sample")
    texts = texts.join(F.broadcast(sample), "doc_id")  # max_rows ids

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch):
                of, at = features(part)
                key = np.unique(of << 32 | at)
                cuts = np.searchsorted(key, np.arange(part.num_rows + 1) << 32)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((key & 0xFFFFFFFF).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), lists], names=["order", "label", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((np.append(places.values.to_numpy(), np.int32(1 << BITS)), label.as_py()) for batch in batches for places, label in zip(batch.column("places"), batch.column("label"), strict=True))
        at, w = fit(rows, params)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["place", "weight"])

    rows = texts.select("order", "label", "text").mapInArrow(tidy(take), "order long, label int, places array<int>")
    weights = rows.repartition(1).sortWithinPartitions("order", "label").mapInArrow(tidy(learn), "place long, weight double").collect()  # 2**BITS + 1 rows at most
    if not weights:
        return np.array([1 << BITS], np.int64), np.array([-1e-6])
    return np.array([r["place"] for r in weights], np.int64), np.array([r["weight"] for r in weights], np.float64)


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; all other columns stay as they are.

    Null and empty texts get the bias alone, texts of any length are read whole,
    a few megabytes at a time.  Repeated rows stay repeated, an empty table stays
    empty.  ``out_col`` must not be a column of ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        for batch in batches:
            texts = batch.column(names.index(text_col)).fill_null("")
            for part in batches_of(pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, "\0"]), "\0"):
                of, place = features(pa.RecordBatch.from_arrays([part.column(len(names))], names=["text"]))
                live = dense[place] != 0
                key = np.unique(of[live] << 32 | place[live])
                total = dense[-1] + np.bincount(key >> 32, dense[key & 0xFFFFFFFF], part.num_rows)
                value = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], value], names=[*names, out_col])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(out_col, DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns.

    Null and empty texts score the bias, so they stay unless most labels are
    toxic.  Texts of any length are read whole; repeated rows go or stay
    together; columns of any names pass through; an empty table stays empty, and
    without labels every row stays.
    """
    (out_col,) = unused(docs, "toxicity")
    return score(docs, train(docs, labels, params, id_col, text_col), id_col, text_col, out_col).where(F.col(out_col) < 0.5).select(docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from 0.5).

    Null and empty texts get the bias alone.  Texts of any length are read
    whole.  Repeated rows give repeated results, further columns are ignored,
    an empty table gives an empty one.  Ids, labels and other columns are no
    inputs of a score.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    scored = score(rows, train(docs, labels, params, id_col, text_col))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
