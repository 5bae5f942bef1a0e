import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import curation
from corpusloom.operators.rows import dense_ids
from corpusloom.sources.metadata import COLUMNS

#: A row that passes every filter; tests change what they are about.
BASE = {"object_id": "40", "object_number": "K 17/3", "is_public_domain": "True", "department": "Textiles", "object_name": "Ribbon", "title": "Blue ribbon", "culture": "Lakeside", "period": "Middle Phase", "artist": "", "object_date": "about 640", "begin_date": "630", "end_date": "650", "medium": "Silk and linen", "classification": "Bands", "link": "https://museum.invalid/items/40"}


def raw(spark, rows):
    full = [(i, *[{**BASE, "object_id": str(i), **r}[c] for c in COLUMNS.values()]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "src_ord long, " + ", ".join(f"{c} string" for c in COLUMNS.values()))


def build(spark, rows, n=1000, **options):
    spec = curation.CorpusSpec(n, **options)
    return curation.build_corpus(raw(spark, rows), spec).collect(), spec.stats


def unique(n, **fields):
    return [{"title": f"{fields.get('department', 'x')} {i}", **fields} for i in range(n)]


# years on both sides of every bound of the rule, then what is no year
EDGES = [(-501, "vor 500 v. Chr."), (-500, "500 v. Chr. – 0"), (-1, "500 v. Chr. – 0"), (1, "1. Jh."), (99, "1. Jh."), (100, "2. Jh."), (101, "2. Jh."), (1999, "20. Jh."), (2000, "21. Jh.")]
OTHERS = [("0", "", "", "unbekannt"), ("0", "-0.5", "Early|x", "Early"), ("", "640", "ignored", "7. Jh."), ("640", "-900", "ignored", "7. Jh."), ("two", "3 ad", " | ", "unbekannt"), ("-inf", "nan", "", "unbekannt"), (None, None, None, "unbekannt"), ("2.5e2", "", "", "3. Jh."), ("-500.9", "", "", "500 v. Chr. – 0")]


@pytest.mark.parametrize(("begin", "end", "period", "want"), [(str(y), "", "", w) for y, w in EDGES] + [("", str(y), "x", w) for y, w in EDGES] + OTHERS)
def test_periods(spark, begin, end, period, want):
    df = spark.createDataFrame([(begin, end, period)], "b string, e string, p string")
    assert df.select(T.bucket_period(F.col("b"), F.col("e"), F.col("p"))).first()[0] == want


def test_cleaning(spark):
    values = [None, "|", "  a \t\n b c\x1e\x1fd ", "é", "", "a|b", " | x"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(T.clean(F.col("v")).alias("c"), T.first_segment(F.col("v")).alias("s"), T.multi_value(F.col("v")).alias("m")).collect()
    assert [r.c for r in got] == ["", "", "a b c d", "é", "", "a|b", "| x"]
    assert [r.s for r in got][5:] == ["a", ""] and got[5].m == "a · b"


def test_casefold_is_not_lower(spark):
    df = spark.createDataFrame([("Straße", "STRASSE")], "a string, b string")
    same = lambda folded: df.select(T.dedup_key(F.col("a"), folded=folded) == T.dedup_key(F.col("b"), folded=folded)).first()[0]
    assert same(True) and not same(False)


def test_funnel_and_dedup(spark):
    rows = unique(30) + [{"title": f"p{i}", "is_public_domain": "False"} for i in range(10)] + [{"title": t} for t in ("", "|")] + [{"title": "SERIES" if i % 2 else "series"} for i in range(25)] + [{"title": "series", "artist": "other"}]
    got, stats = build(spark, rows)
    assert (stats["total"], stats["public_domain"], stats["with_title"], stats["after_dedup"], stats["selected"]) == (68, 58, 56, 32, 32)
    assert sorted(r.row_id for r in got) == list(range(32)) and {r.object_id for r in got if r.title.lower() == "series"} == {"42", "67"}


def test_classes_are_even_and_limited(spark):
    rows = sum((unique(n, department=d) for d, n in (("A", 300), ("B", 60), ("C", 60), ("D", 3))), [])
    got, stats = build(spark, rows, 90)
    sizes = {d: sum(r.department == d for r in got) for d in "ABCD"}
    assert sizes == {"A": 30, "B": 30, "C": 30, "D": 0} and stats["dropped_classes"] == [("D", "too small")]
    by_id = [r.department for r in sorted(got, key=lambda r: r.row_id)]
    assert sum(a != b for a, b in zip(by_id, by_id[1:], strict=False)) > len(by_id) / 2
    assert build(spark, rows, 90)[0] == got
    _, stats = build(spark, rows, 400, max_label_classes=2)
    assert stats["label_classes"] == 2 and stats["dropped_classes"] == [("C", "beyond the limit"), ("D", "too small")] and stats["selected"] == 360


def test_facets_are_capped_but_not_the_label(spark):
    rows = sum((unique(25, department=f"D{k}", culture=f"c{k}") for k in range(6)), [])
    got, _ = build(spark, rows, facet_cap=2)
    assert len({r.department for r in got}) == 6 and len({r.culture for r in got}) == 3 and sum(r.culture == "Andere" for r in got) == 100
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["Andere"] * 5 + ["a"] * 4 + ["b"] * 3)], "i long, v string")
    assert {r.v for r in curation.cap_facet(df, "v", "i", 2).collect()} == {"Andere", "a"}


def test_nothing_left(spark):
    with pytest.raises(curation.CorpusError):
        build(spark, [{"is_public_domain": "False"}] * 5)
    with pytest.raises(curation.CorpusError):
        build(spark, unique(5))
    with pytest.raises(curation.CorpusError):
        build(spark, unique(30), label="medium")


def test_dense_ids_are_dense_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = dense_ids(df, "k").collect()
    assert all(r.k == r.row_id for r in got) and len(got) == 1000


def test_shared_expressions_are_computed_once(spark):
    derived = curation.derive(raw(spark, [BASE]))._jdf.queryExecution().executedPlan().toString()
    assert derived.count("regexp_replace") < 150  # copies of a cleaned year inside of one another made thousands
    assert spark.range(1).select(T.or_unknown(F.lit(None).cast("string")), T.year(F.lit("0.9")), T.year(F.lit("1e999")), T.collapse(F.lit(" | ")), T.collapse(F.lit("||"))).first()[:] == ("unbekannt", None, None, "", "||")
