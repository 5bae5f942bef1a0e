"""Cleaning and derivation of metadata fields, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words of the data contract.
UNKNOWN = "unbekannt"
OTHER = "Andere"
PERIOD_EARLY = "vor 500 v. Chr."
PERIOD_BEFORE = "500 v. Chr. – 0"
PERIOD_CENTURY = ". Jh."
FIELD_SEPARATOR = "\x1f"
RECORD_SEPARATOR = "\x1e"

#: A number as both Python's float() and SQL casts read it.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?\s*$"


def _each_other(values: pa.Array, plain: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """``plain`` with the changed texts of ``values`` where they are not ASCII; only these are taken one by one."""
    other = pc.fill_null(pc.invert(pc.string_is_ascii(values)), False)
    if not pc.any(other, min_count=0).as_py():
        return plain
    return pc.replace_with_mask(plain, other, pa.array([change(v.as_py()) for v in values.filter(other)], pa.string()))


@F.arrow_udf(StringType())
def _nfc(values: pa.Array) -> pa.Array:
    return _each_other(values, values, lambda v: unicodedata.normalize("NFC", v))


@F.arrow_udf(StringType())
def _casefold(values: pa.Array) -> pa.Array:
    return _each_other(values, pc.ascii_lower(values), str.casefold)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used; used in one another, copies would multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(value: Column) -> Column:
    """Runs of white space, separators included, become one space; ends are trimmed; a lone ``|`` is empty."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.regexp_replace(text, r"\A\|\z", "")


def clean(value: Column) -> Column:
    """NFC, then ``collapse``; null becomes empty."""
    return collapse(_nfc(value))


def first_segment(value: Column) -> Column:
    """The part before the first ``|``, cleaned."""
    return collapse(F.substring_index(value, "|", 1))


def or_unknown(value: Column) -> Column:
    return _once(value, lambda v: F.when(v != "", v).otherwise(F.lit(UNKNOWN)))


def year(value: Column) -> Column:
    """A whole year, toward zero; null if it is no finite number, or 0."""
    number = _once(value, lambda v: F.when(v.rlike(NUMBER), F.trim(v).try_cast("double")))
    return _once(number, lambda n: F.when((F.abs(n) >= 1) & (F.abs(n) < 1e15), n.try_cast("bigint")))


def bucket_period(begin: Column, end: Column, period: Column) -> Column:
    """Century of the first usable year, else the period's first segment, else unknown."""
    century = _once(F.coalesce(year(begin), year(end)), lambda y: F.when(y < -500, PERIOD_EARLY).when(y < 0, PERIOD_BEFORE).when(y > 0, F.concat((F.floor(y / 100) + 1).cast("string"), F.lit(PERIOD_CENTURY))))
    return F.coalesce(century, or_unknown(first_segment(period)))


def dedup_key(*fields: Column, folded: bool = True) -> Column:
    """Fields joined by ``|`` with case folded; ``folded=False`` only lowers case and stays in the JVM."""
    joined = F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields])
    return _casefold(joined) if folded else F.lower(joined)


def label_encode(df: DataFrame, column: str, code: str) -> DataFrame:
    """``df`` with the position of its value among the sorted distinct values (code-point order); null stays null."""
    return df.join(vocabulary(df, column).select(F.col("value").alias(column), F.col("code").alias(code)), column, "left")


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of the distinct values; one row each, so as many rows as the dictionary has entries."""
    from corpusloom.operators.rows import dense_ids

    return dense_ids(df.select(F.col(column).alias("value")).where("value is not null").distinct(), "value", id_col="code")


def record_text(fields: list[Column]) -> Column:
    """Fields joined by the unit separator, ended by the record separator; the fields must be clean."""
    return F.concat(F.concat_ws(FIELD_SEPARATOR, *[F.coalesce(f, F.lit("")) for f in fields]), F.lit(RECORD_SEPARATOR))


def record_fields(text: Column, names: list[str]) -> list[Column]:
    """The named fields of a record; a missing one is empty."""
    parts = F.split(F.rtrim(text, F.lit(RECORD_SEPARATOR)), FIELD_SEPARATOR)
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]


def multi_value(value: Column) -> Column:
    """Values separated by ``|`` as one line, empty ones left out."""
    return F.array_join(F.filter(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: x != ""), " · ")
