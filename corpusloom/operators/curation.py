"""From raw metadata to a corpus: funnel, first-wins dedup, class selection, sampling, capped facets.

Random choices are orders of md5 hashes of seed and id, so they are the same on
any cluster and in any SQL engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.operators.rows import dense_ids, first_by, materialise

#: Dropped classes that the counters name; all of them are counted.
REPORTED_CLASSES = 1000

FACETS = ("department", "classification", "culture", "period")


class CorpusError(RuntimeError):
    """A corpus cannot be built from the given rows."""


@dataclass(frozen=True)
class CorpusSpec:
    n: int
    label: str = "department"
    seed: int = 0
    min_class_size: int = 20
    max_label_classes: int = 8
    facet_cap: int = 16
    facets: tuple[str, ...] = FACETS
    stats: dict = field(default_factory=dict, compare=False)


def shuffled(seed: int, salt: str, id_: Column) -> Column:
    """The key of a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), id_.cast("string")))


def derive(raw: DataFrame) -> DataFrame:
    """Public, titled rows with the twelve corpus fields, their dedup key and place; flags are kept as columns.

    ``raw`` has the fifteen text columns and ``src_ord``, the place in the source.
    """
    c = {name: T.clean(F.col(name)) for name in ("title", "artist", "object_date", "medium", "object_id", "object_number", "object_name", "department", "culture", "classification", "is_public_domain")}
    rows = raw.select("src_ord", *[v.alias(k) for k, v in c.items()], *[T.clean(F.col(x)).alias(x) for x in ("begin_date", "end_date", "period", "link")])
    return rows.select(
        "src_ord", "object_id", "object_number", "title", "artist", "object_name", "object_date",
        T.or_unknown(F.col("department")).alias("department"),
        T.or_unknown(T.first_segment(F.col("culture"))).alias("culture"),
        T.bucket_period(F.col("begin_date"), F.col("end_date"), F.col("period")).alias("period"),
        T.or_unknown(T.first_segment(F.col("classification"))).alias("classification"),
        "medium", "link",
        (F.lower("is_public_domain") == "true").alias("public"),
        (F.col("title") != "").alias("titled"),
        T.dedup_key(F.col("title"), F.col("artist"), F.col("object_date"), F.col("medium")).alias("dedup_key"),
    )


def class_ranks(df: DataFrame, label: str, order: str, min_size: int, max_classes: int) -> DataFrame:
    """(label, size, first, rank, reason): classes by size, ties by first appearance; reason is null for kept ones."""
    sizes = df.groupBy(label).agg(F.count("*").alias("size"), F.min(order).alias("first"))
    ordered = sizes.withColumns({"__small": (F.col("size") < min_size).cast("int"), "__less": -F.col("size")})
    ranked = dense_ids(ordered, "__small", "__less", "first", id_col="rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    return ranked.select(*sizes.columns, "rank", F.when(F.col("__small") == 1, "too small").when(F.col("rank") > max_classes, "beyond the limit").alias("reason"))


def stratified_sample(df: DataFrame, label: str, id_col: str, n: int, seed: int, min_size: int = 20, max_classes: int = 8) -> DataFrame:
    """Up to n rows of the kept classes, equally many of each as far as they go, in a random global order.

    Columns of ``df`` and ``row_id``, dense from 0.  Rows that the classes cannot
    fill equally are filled from what is left of all of them.
    """
    kept = materialise(class_ranks(df, label, id_col, min_size, max_classes).where("reason is null").select(label), "classes")
    classes = kept.count()  # max_classes at most
    if not classes:
        raise CorpusError(f"no class of {label} has {min_size} rows")
    quota = max(1, n // classes)
    rows = df.join(F.broadcast(kept), label, "left_semi").withColumn("__key", shuffled(seed, "class", F.col(id_col)))
    # a rank that is only compared with a constant lets Spark drop rows before the shuffle
    own = Window.partitionBy(label).orderBy("__key", id_col)
    even = materialise(rows.withColumn("__rank", F.row_number().over(own)).where(F.col("__rank") <= quota).drop("__rank"), "even")
    found = even.count()
    if found >= n:
        picked = even.orderBy(shuffled(seed, "cut", F.col(id_col)), id_col).limit(n)
    else:
        last = even.groupBy(label).agg(F.max(F.struct("__key", id_col)).alias("__last"))
        left = rows.join(F.broadcast(last), label).where(F.struct("__key", id_col) > F.col("__last")).select(rows.columns)
        picked = even.unionByName(left.orderBy(shuffled(seed, "fill", F.col(id_col)), id_col).limit(n - found))
    return dense_ids(picked.withColumn("__order", shuffled(seed, "order", F.col(id_col))).select(*df.columns, "__order"), "__order", id_col).drop("__order")


def facet_vocabulary(df: DataFrame, column: str, order: str, cap: int) -> DataFrame:
    """(value, size, rank) of the values that stay: the most frequent ``cap``, ties by first appearance."""
    sizes = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("size"), F.min(order).alias("first"))
    top = sizes.orderBy(F.desc("size"), "first").limit(cap)  # cap rows, so that one task can number them
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "first"))).where(F.col("value") != T.OTHER).select("value", "size", "rank")


def cap_facet(df: DataFrame, column: str, order: str, cap: int = 16) -> DataFrame:
    """``df`` with values beyond the most frequent ``cap`` as OTHER.  The kept values, at most ``cap``, are broadcast."""
    kept = facet_vocabulary(df, column, order, cap).select(F.col("value").alias("__value"))
    joined = df.join(F.broadcast(kept), F.col(column) == F.col("__value"), "left")
    return joined.withColumn(column, F.when(F.col("__value").isNull(), T.OTHER).otherwise(F.col(column))).drop("__value")


def funnel(derived: DataFrame) -> DataFrame:
    """One row: total, public_domain, with_title, after_dedup."""
    used = F.col("public") & F.col("titled")
    return derived.agg(F.count("*").alias("total"), F.count_if("public").alias("public_domain"), F.count_if(used).alias("with_title"), F.count_distinct(F.when(used, F.col("dedup_key"))).alias("after_dedup"))


def build_corpus(raw: DataFrame, spec: CorpusSpec) -> DataFrame:
    """The corpus table with ``row_id``; counters go to ``spec.stats``.

    Filters come before the dedup, the class limit before the sample, and facets
    other than the label are capped after it.  ``dropped_classes`` lists the
    largest REPORTED_CLASSES dropped classes, ``dropped_class_count`` counts all;
    ``class_ranks`` has every one of them as a row.
    """
    if spec.label not in spec.facets:
        raise CorpusError(f"{spec.label} is none of the facets {', '.join(spec.facets)}")
    derived = materialise(derive(raw), "derived")
    unique = materialise(first_by(derived.where("public and titled").drop("public", "titled"), ["dedup_key"], ["src_ord"]).drop("dedup_key"), "unique")
    spec.stats.update(funnel(derived).first().asDict())
    if not spec.stats["after_dedup"]:
        raise CorpusError("no row is left after the filters")
    sample = stratified_sample(unique, spec.label, "src_ord", spec.n, spec.seed, spec.min_class_size, spec.max_label_classes)
    sample = materialise(sample, "sample")
    dropped = materialise(class_ranks(unique, spec.label, "src_ord", spec.min_class_size, spec.max_label_classes).where("reason is not null"), "dropped-classes")
    listed = dropped.orderBy("rank").limit(REPORTED_CLASSES).collect()
    spec.stats.update(selected=sample.count(), label_classes=sample.select(spec.label).distinct().count(), dropped_class_count=dropped.count(), dropped_classes=[(r[spec.label], r["reason"]) for r in listed])
    for facet in spec.facets:
        if facet != spec.label:
            sample = cap_facet(sample, facet, "row_id", spec.facet_cap)
    return sample.drop("src_ord")
