"""Readers and writers of tables: metadata CSV, corpus Parquet, journals."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import csv_ranges

# The columns that are read, and their names from then on.
COLUMNS = {
    "Object ID": "object_id",
    "Object Number": "object_number",
    "Is Public Domain": "is_public_domain",
    "Department": "department",
    "Object Name": "object_name",
    "Title": "title",
    "Culture": "culture",
    "Period": "period",
    "Artist Display Name": "artist",
    "Object Date": "object_date",
    "Object Begin Date": "begin_date",
    "Object End Date": "end_date",
    "Medium": "medium",
    "Classification": "classification",
    "Link Resource": "link",
}

# Texts that stand for null in the CSV, quoted or not.
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")

JOURNAL = "id string, status string, detail string, src_ord long"


class SourceError(RuntimeError):
    """An input is missing or not what it should be."""


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The fifteen text columns of the metadata CSV and ``src_ord``, which ascends in file order.

    Columns are chosen by name and nothing is inferred.  Records may span lines;
    each byte range of a file is a task (``csv_ranges``).  src_ord has no gaps.
    """
    try:
        rows = csv_ranges.scan(spark, path)
    except AnalysisException as e:
        raise SourceError(f"no metadata at {path}") from e
    if missing := [c for c in COLUMNS if c not in rows.columns]:
        raise SourceError(f"columns are missing: {', '.join(missing)}")
    chosen = [F.when(~F.col(f"`{c}`").isin(*NULLS), F.col(f"`{c}`")).alias(n) for c, n in COLUMNS.items()]
    return rows.select("src_ord", *chosen)


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        raise SourceError(f"no corpus at {path}: run `fetch` first") from e


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each id; lines that are no JSON or were cut off are passed over."""
    lines = spark.read.schema("id string, status string, detail string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return latest(lines.where("_corrupt is null and id is not null").select("id", "status", "detail", F.monotonically_increasing_id().alias("src_ord")))


def latest(entries: DataFrame) -> DataFrame:
    """(id, status, detail) of the last entry of each id."""
    last = F.max_by(F.struct("status", "detail"), "src_ord").alias("e")
    return entries.groupBy("id").agg(last).select("id", "e.status", "e.detail")


def pending(ids: DataFrame, journal: DataFrame) -> DataFrame:
    """Ids without an entry, and those whose last entry is an error."""
    return ids.join(journal.where("status <> 'error'").select("id"), "id", "left_anti")


def journal_stats(ids: DataFrame, journal: DataFrame) -> DataFrame:
    """One row: requested, downloaded, skipped, failed."""
    return ids.join(journal, "id", "left").agg(F.count("*").alias("requested"), F.count_if(F.col("status") == "ok").alias("downloaded"), F.count_if(F.col("status") == "no_image").alias("skipped"), F.count_if(F.col("status") == "error").alias("failed"))


def available_images(spark: SparkSession, folder: str, corpus: DataFrame) -> DataFrame:
    """(row_id, object_id, path) of corpus rows whose image file exists."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select("path", F.regexp_extract("path", r"([^/]+)\.jpg$", 1).alias("object_id"))
    return corpus.select("row_id", "object_id").join(files, "object_id").select("row_id", "object_id", "path")
