"""CSV files with line ends inside quotes, read by many tasks a file.

Whether a line begins a record depends on every quote before it.  Files are read
as lines, in byte ranges as Spark cuts them.  A line is a function of two states,
outside or inside a quoted field, before and behind it; such functions compose,
so a range is one as well.  Ranges first follow both states; a running
composition over the ranges of a file then tells which one was true, and records
are numbered and cut accordingly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.rows import run_dir

_QUOTED = r'(?:[^"]++|"")*+'
#: Closed fields, then an open quote up to the end of the line.
_OPENS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+"{_QUOTED}$'


def _behind(line: Column) -> tuple[Column, Column]:
    """Whether a quoted field is open behind a line, if none or one was open before it."""
    return F.rlike(line, F.lit(f"^{_OPENS}")), F.rlike(line, F.lit(f"^{_QUOTED}$")) | F.rlike(line, F.lit(f'^{_QUOTED}"[^,]*+,{_OPENS}'))


def _before(none: Column, one: Column, along, entry: Column) -> Column:
    """The state before each element of a sequence of functions, given that before the first.

    The last constant function tells the state behind it; each later exchange of
    the two states turns it round.
    """
    constant, turn = none == one, F.when(none & ~one, 1).otherwise(0)
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(turn).over(past), F.lit(0))
    upto = F.sum(turn).over(along.rowsBetween(Window.unboundedPreceding, 0))
    last = F.last(F.when(constant, F.struct(none.alias("state"), upto.alias("turns"))), ignorenulls=True)
    return F.struct(turns.alias("turns"), last.over(past).alias("last"), entry.alias("entry"))


def _state(x: Column) -> Column:
    since = x["turns"] - F.coalesce(x["last"]["turns"], F.lit(0))
    return F.coalesce(x["last"]["state"], x["entry"]) != (since % 2 == 1)


def records(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(file, number, record) of one CSV file or of a folder's files, numbered from 0 in each file; blank lines are left out.

    A record is cut at line feeds outside of quoted fields and comes without its
    line end.  Quotes inside fields that do not begin with one are ordinary.
    ``range_bytes`` bounds the ranges (default: the session's setting).
    """
    setting = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(setting)
    # each range in a partition of its own, so that the bound holds
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    none, one = _behind(F.col("value"))
    along = Window.partitionBy("file", "block").orderBy("at")
    told = lines.withColumns({"none": none, "one": one, "blank": F.col("value").isin("", "\r")})
    both = told.withColumns({name: _before(F.col("none"), F.col("one"), along, F.lit(entry)) for name, entry in (("x0", False), ("x1", True))}).withColumns({f"s{e}": _state(F.col(f"x{e}")) for e in (0, 1)}).drop("x0", "x1")
    begins = lambda e: (~F.col(f"s{e}") & ~F.col("blank")).cast("long")
    both = both.withColumns({f"n{e}": F.sum(begins(e)).over(along) for e in (0, 1)})
    table = f"{run_dir(spark)}/csv-lines-{uuid.uuid4().hex}"
    try:
        if range_bytes:
            spark.conf.set(setting, str(range_bytes))
        both.write.parquet(table)
    finally:
        spark.conf.set(setting, usual)
    both = spark.read.parquet(table)
    behind = lambda e: F.when(F.col(f"s{e}"), F.col("one")).otherwise(F.col("none"))
    ranges = both.groupBy("file", "block").agg(*[F.max_by(behind(e), "at").alias(c) for e, c in ((0, "none"), (1, "one"))], F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    over = Window.partitionBy("file").orderBy("block")
    ranges = ranges.withColumn("entry", _before(F.col("none"), F.col("one"), over, F.lit(False))).withColumn("entry", _state(F.col("entry")))
    ranges = ranges.withColumn("n", F.when(F.col("entry"), F.col("n1")).otherwise(F.col("n0"))).select("file", "block", "entry", (F.sum("n").over(over) - F.col("n")).alias("before"))
    pick = lambda c: F.when(F.col("entry"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    true = both.join(ranges, ["file", "block"]).withColumns({"inside": pick("s"), "number": F.col("before") + pick("n") - 1}).withColumn("open", F.when(F.col("inside"), F.col("one")).otherwise(F.col("none")))
    true = true.where("inside OR NOT blank")
    whole = true.where("NOT inside AND NOT open").select("file", "number", F.col("value").alias("record"))
    cut = true.where("inside OR open").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("record"))
    return whole.unionByName(cut).withColumn("record", F.regexp_replace("record", r"\r$", ""))


def scan(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """``src_ord`` and the text columns that the header names; src_ord ascends without gaps in order of file name and record."""
    columns = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    found = records(spark, path, range_bytes)
    # a row for each file
    files = found.groupBy("file").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum(F.col("n") - 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "start")
    schema = ", ".join("`{}` string".format(c.replace("`", "``")) for c in columns)
    parsed = F.from_csv("record", schema, {"escape": '"', "maxCharsPerColumn": "-1"})
    rows = found.where("number > 0").join(files, "file").select((F.col("start") + F.col("number") - 1).alias("src_ord"), parsed.alias("r"))
    return rows.select("src_ord", *[F.col("r")[c].alias(c) for c in columns])
