"""A cleaning pipeline over the documents table.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept and returns the columns of documents; the last one returns token ids.

Common to all stages: texts of any length are read whole; a null text is an
empty one and stays null where the stage keeps texts; repeated rows are rows,
null ids are allowed; further columns of any names pass through all stages but
the last; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, secrets, sentencepiece_bpe, simhash, toxicity
from corpusloom.llm.queries import tokenizer_path
from corpusloom.llm.runtime import materialise


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5; without any label, all.

    Ids that are null or have no label are scored like others.  Equal texts get
    equal scores, so copies go or stay together.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of SimHash near-duplicates.

    Fingerprints, shingles of four words and the radius of four bits are those of
    op5.  Null ids come last in a group; of rows that share the smallest id one
    stays.  Null and empty texts are one group with what links to it.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item, as op6 finds them.

    Null and empty texts hold none.  Null ids are judged by their own text.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True, chained=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks and n_chars following where it holds whole numbers."""
    return secrets.redact_column(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of ids and decoded text, and the ids; one row for each row, others dropped."""
    return sentencepiece_bpe.encode_texts(docs, tokenizer_path())


STAGES = [("toxicity", reject_toxic), ("simhash_dedup", one_of_each_group), ("decontamination", decontaminate), ("secret_scan", redact_secrets), ("sentencepiece", tokenize)]

#: Trained weights, fingerprints and BPE merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
