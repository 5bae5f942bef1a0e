"""Named queries over the driver's tables, each with the SQL that has to give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import coords as C
from corpusloom.functions import picking
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import curation, descent, facets, gate, moments, neighbors, placement, ranks, raster, reduce, rows, search, text_index
from corpusloom.sources import artifacts, csv_ranges, metadata, synthetic
from corpusloom.streaming import journal

Query = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(sql: str | None):
    def keep(run: Query) -> Query:
        CATALOG[run.__name__] = Entry(run, sql)
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their first three dimensions as coordinates."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), "embedding", "label", *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


# -- parts of the SQL ---------------------------------------------------------------------------

UNIT = "u AS (SELECT vec_id AS row_id, label, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings)"
POINT = "p AS (SELECT vec_id AS row_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def sql_high(k: int, name: str = "high", unit: str = "u") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT row_id, neighbor_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, neighbor_id) AS rank FROM (
        SELECT a.row_id, b.row_id AS neighbor_id, round(list_dot_product(a.e, b.e), 9) AS score FROM {unit} a, {unit} b WHERE a.row_id <> b.row_id)) WHERE rank <= {k})"""


def sql_low(k: int, name: str = "low", point: str = "p") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT row_id, neighbor_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score, neighbor_id) AS rank FROM (
        SELECT a.row_id, b.row_id AS neighbor_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) AS score FROM {point} a, {point} b WHERE a.row_id <> b.row_id)) WHERE rank <= {k})"""


def sql_purity(near: str, labels: str = "u") -> str:
    return f"(SELECT avg((a.label = b.label)::INT) FROM {near} n JOIN {labels} a ON n.row_id = a.row_id JOIN {labels} b ON n.neighbor_id = b.row_id)"


def sql_overlap(high: str, low: str, k: int) -> str:
    return f"(SELECT count(*) FROM {high} h JOIN {low} l ON h.row_id = l.row_id AND h.neighbor_id = l.neighbor_id) / ({k}.0 * (SELECT count(DISTINCT row_id) FROM {high}))"


CHANCE = "(SELECT sum(c * c) / (sum(c) * sum(c)) FROM (SELECT count(*)::DOUBLE AS c FROM embeddings GROUP BY label))"
NORMAL = f"""{POINT}, centre AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p),
    moved AS (SELECT row_id, label, x - cx AS x, y - cy AS y, z - cz AS z FROM p, centre), most AS (SELECT max(greatest(abs(x), abs(y), abs(z))) AS m FROM moved),
    flat AS (SELECT row_id, label, x * (50 / m) AS x, y * (50 / m) AS y, z * (50 / m) AS z FROM moved, most)"""
SPEC = "spec AS (SELECT " + ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}, (max({a}) + min({a})) / 2 AS offset_{a}, CASE WHEN max({a}) = min({a}) THEN 1 ELSE (max({a}) - min({a})) / 2 END AS half_{a}" for a in "xyz") + ", max(sqrt(x * x + y * y + z * z)) AS radius FROM flat)"
QUANTIZED = "quantized AS (SELECT row_id, x, y, z, " + ", ".join(f"greatest(-32767, least(32767, round_even((({a} - offset_{a}) / half_{a}) * 32767, 0)))::SMALLINT AS q{a}, offset_{a}, half_{a}" for a in "xyz") + " FROM flat, spec)"
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_clean(value: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(coalesce({value}, '')), '{BLANK}', ' ', 'g'))"


# -- neighbours and measures --------------------------------------------------------------------


@query(f"WITH {UNIT}, {sql_high(10)} SELECT count(*) AS edges, round({sql_purity('high')}, 6) AS purity FROM high")
def cosine_knn_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = points(spark, sf_dir)
    near = rows.materialise(neighbors.knn(e, 10, "row_id", "embedding"), "near")
    return near.agg(F.count("*").alias("edges")).crossJoin(neighbors.label_purity(near, e.select("row_id", "label"))).select("edges", F.round("purity", 6).alias("purity"))


@query(f"WITH {UNIT}, {sql_high(15)} SELECT row_id, rank::INT AS rank, neighbor_id, score FROM high")
def knn_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.knn(points(spark, sf_dir), 15, "row_id", "embedding")


@query(f"WITH {POINT}, {sql_low(15)} SELECT row_id, rank::INT AS rank, neighbor_id, score FROM low")
def knn_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("c", F.array("x", "y", "z"))
    return neighbors.knn(p, 15, "row_id", "c", metric="euclidean")


@query(f"""WITH {UNIT} SELECT row_id, rank::INT AS rank, neighbor_id, score FROM (SELECT a.row_id, b.row_id AS neighbor_id, round(list_dot_product(a.e, b.e), 9) AS score,
    row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.row_id) AS rank FROM u a, u b WHERE a.row_id % 100 = 0 AND a.row_id <> b.row_id) WHERE rank <= 12""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of queries against all rows."""
    e = points(spark, sf_dir)
    return neighbors.knn(e, 12, "row_id", "embedding", queries=e.where("row_id % 100 = 0"))


@query("SELECT count(*) * 10 AS edges, count(*) AS rows, true AS enough FROM embeddings")
def knn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph by descent, and whether it has 0.95 of the exact neighbours or more, in blocks small enough to need descent."""
    e = points(spark, sf_dir)
    exact = rows.materialise(neighbors.knn(e, 10, "row_id", "embedding"), "exact")
    near = descent.descent_knn(e, 10, "row_id", "embedding", block=64, recall=0.95, exact=exact)
    recall = neighbors.overlap(exact, near, 10)
    return near.agg(F.count("*").alias("edges"), F.count_distinct("row_id").alias("rows")).crossJoin(recall).select("edges", "rows", (F.col("overlap") >= 0.95).alias("enough"))


@query(f"SELECT round({CHANCE}, 9) AS chance")
def chance_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.chance_level(points(spark, sf_dir)).select(F.round("chance", 9).alias("chance"))


@query(f"WITH {UNIT}, {POINT}, {sql_high(15)}, {sql_low(15)} SELECT round({sql_overlap('high', 'low', 15)}, 6) AS overlap")
def knn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("c", F.array("x", "y", "z"))
    return neighbors.overlap(neighbors.knn(p, 15, "row_id", "embedding"), neighbors.knn(p, 15, "row_id", "c", metric="euclidean"), 15).select(F.round("overlap", 6).alias("overlap"))


@query(f"WITH {UNIT}, {POINT}, {sql_low(15)} SELECT round({sql_purity('low')}, 6) AS purity FROM (SELECT 1)")
def label_purity_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("c", F.array("x", "y", "z"))
    return neighbors.label_purity(neighbors.knn(p, 15, "row_id", "c", metric="euclidean"), p.select("row_id", "label")).select(F.round("purity", 6).alias("purity"))


@query(f"""WITH {POINT}, {sql_low(5)}, d AS (SELECT a.vec_id AS row_id, b.vec_id AS neighbor_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    r AS (SELECT row_id, neighbor_id, row_number() OVER (PARTITION BY row_id ORDER BY s, neighbor_id) AS rank FROM d), n AS (SELECT count(*) AS n FROM embeddings)
    SELECT round(1 - 2.0 / (n * 5 * (2.0 * n - 3 * 5 - 1)) * (SELECT coalesce(sum(r.rank - 5), 0) FROM low JOIN r ON low.row_id = r.row_id AND low.neighbor_id = r.neighbor_id WHERE r.rank > 5), 6) AS trustworthiness FROM n""")
def trustworthiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("c", F.array("x", "y", "z"))
    return ranks.trustworthiness(p, 5, "row_id", "embedding", "c", cap=None).select(F.round("trustworthiness", 6).alias("trustworthiness"))


SHUFFLED = """vals AS (SELECT vec_id AS row_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings),
    placed AS (SELECT row_id, dim, value, row_number() OVER (PARTITION BY dim ORDER BY row_id) AS place FROM vals),
    goal AS (SELECT row_id, dim, row_number() OVER (PARTITION BY dim ORDER BY md5('0:' || dim || ':' || row_id), row_id) AS place FROM vals),
    mixed AS (SELECT g.row_id, list(v.value ORDER BY g.dim) AS e FROM goal g JOIN placed v ON g.dim = v.dim AND g.place = v.place GROUP BY g.row_id)"""


@query(f"WITH {SHUFFLED} SELECT row_id, generate_subscripts(e, 1)::INT - 1 AS dim, unnest(list_transform(e, lambda v: round(v, 6) + 0.0::DOUBLE)) AS value FROM mixed")
def shuffle_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = neighbors.shuffle_columns(points(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>")), "row_id", "embedding")
    return components(e, "embedding")


def components(df: DataFrame, vector_col: str) -> DataFrame:
    """A row for each component of each vector."""
    return df.select("row_id", F.posexplode(vector_col).alias("dim", "v")).select("row_id", "dim", (F.round("v", 6) + 0.0).alias("value"))


@query(f"""WITH {UNIT}, {POINT}, {SHUFFLED}, ms AS (SELECT row_id, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS e FROM mixed), mp AS (SELECT row_id, e[1] AS x, e[2] AS y, e[3] AS z FROM mixed),
    {sql_high(15)}, {sql_low(15)}, {sql_high(15, 'high_s', 'ms')}, {sql_low(15, 'low_s', 'mp')},
    m AS (SELECT {sql_overlap('high', 'low', 15)} AS o, {sql_purity('low')} AS p3, {sql_purity('high')} AS ph, {CHANCE} AS ch, {sql_overlap('high_s', 'low_s', 15)} AS os, {sql_purity('low_s')} AS ps FROM (SELECT 1))
    SELECT 15 AS k, (SELECT count(*) FROM embeddings) AS n, round(o, 6) AS overlap, round(p3, 6) AS purity_3d, round(ph, 6) AS purity_high, round(ch, 6) AS chance, round(os, 6) AS overlap_shuffled, round(ps, 6) AS purity_3d_shuffled,
    (o < 0.05)::INT + (p3 <= ch + 0.05)::INT + (ph <= ch + 0.05)::INT + (p3 <= ps + 0.05)::INT AS n_reasons, (o >= 0.05 AND p3 > ch + 0.05 AND ph > ch + 0.05 AND p3 > ps + 0.05) AS passed FROM m""")
def gate_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = points(spark, sf_dir).select("row_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    coords = F.slice("embedding", 1, 3).alias("coords")
    mixed = rows.materialise(neighbors.shuffle_columns(e, "row_id", "embedding"), "shuffled").join(e.select("row_id", "label"), "row_id")
    out = gate.run_gate(e.select("*", coords), mixed.select("*", coords), trust=False)
    names = ("overlap", "purity_3d", "purity_high", "chance", "overlap_shuffled", "purity_3d_shuffled")
    return out.select("k", "n", *[F.round(c, 6).alias(c) for c in names], F.size("reasons").alias("n_reasons"), "passed")


# -- vectors and coordinates --------------------------------------------------------------------


@query(f"WITH {UNIT} SELECT row_id, generate_subscripts(e, 1)::INT - 1 AS dim, unnest(list_transform(e, lambda v: round(v, 6) + 0.0::DOUBLE)) AS value FROM u")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(points(spark, sf_dir).select("row_id", V.l2_normalize(F.col("embedding")).alias("e")), "e")


@query(f"WITH {NORMAL} SELECT row_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM flat")
def coords_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalize(points(spark, sf_dir).select("row_id", *"xyz")).select("row_id", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(f"WITH {NORMAL}, {SPEC}, {QUANTIZED} SELECT row_id, qx, qy, qz FROM quantized")
def coords_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quantize(C.normalize(points(spark, sf_dir).select("row_id", *"xyz"))).select("row_id", "qx", "qy", "qz")


@query(f"WITH {NORMAL}, {SPEC} SELECT " + ", ".join(f"round({n}_{a}, 6) AS {n}_{a}" for a in "xyz" for n in ("min", "max", "offset", "half")) + ", round(radius, 6) AS radius FROM spec")
def coords_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = C.spec(C.normalize(points(spark, sf_dir).select("row_id", *"xyz")))
    return one.select(*[F.round(f"{n}_{a}", 6).alias(f"{n}_{a}") for a in "xyz" for n in ("min", "max", "offset", "half")], F.round("radius", 6).alias("radius"))


@query(f"WITH {NORMAL}, {SPEC}, {QUANTIZED} SELECT " + ", ".join(f"round(max(abs(q{a} / 32767.0::DOUBLE * half_{a} + offset_{a} - {a})), 6) AS error_{a}, bool_and(abs(q{a} / 32767.0::DOUBLE * half_{a} + offset_{a} - {a}) <= half_{a} / 32767 * 0.5000001) AS within_{a}" for a in "xyz") + " FROM quantized")
def coords_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = C.quantize(C.normalize(points(spark, sf_dir).select("row_id", *"xyz")))
    error = {a: F.abs(C.dequantize(F.col(f"q{a}"), F.col(f"offset_{a}"), F.col(f"half_{a}")) - F.col(a)) for a in "xyz"}
    return q.agg(*[f for a in "xyz" for f in (F.round(F.max(error[a]), 6).alias(f"error_{a}"), F.bool_and(error[a] <= F.col(f"half_{a}") / C.I16 * 0.5000001).alias(f"within_{a}"))])


PALETTE_SQL = "[" + ", ".join(f"[{', '.join(map(str, c))}]" for c in C.PALETTE) + "]"


@query(f"SELECT vec_id AS row_id, ({PALETTE_SQL})[label % 8 + 1][1] AS r, ({PALETTE_SQL})[label % 8 + 1][2] AS g, ({PALETTE_SQL})[label % 8 + 1][3] AS b, 255 AS a FROM embeddings")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("row_id", *C.palette(F.col("label")))


@query(f"WITH {NORMAL}, {SPEC} SELECT round(2 * radius / cbrt((SELECT count(*) FROM flat)), 6) AS spacing, round(0.25 * 2 * radius / cbrt((SELECT count(*) FROM flat)), 6) AS point_size FROM spec")
def mean_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = C.normalize(points(spark, sf_dir).select("row_id", *"xyz"))
    one = flat.agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("radius"), F.count("*").alias("n"))
    spacing = C.mean_spacing(F.col("radius"), F.col("n"))
    return one.select(F.round(spacing, 6).alias("spacing"), F.round(0.25 * spacing, 6).alias("point_size"))


# -- placement and selection --------------------------------------------------------------------

PLACED = f"""{UNIT}, {NORMAL}, ask AS (SELECT * FROM u WHERE row_id % 50 = 0), near AS (SELECT * FROM (SELECT a.row_id AS query_id, b.row_id AS neighbor_id, round(list_dot_product(a.e, b.e), 9) AS s,
    row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.row_id) AS rank FROM ask a, u b) WHERE rank <= 12),
    ends AS (SELECT *, max(s) OVER q AS top, max(s) OVER q - min(s) OVER q AS span FROM near WINDOW q AS (PARTITION BY query_id)),
    raw AS (SELECT *, exp((s - top) / greatest(CASE WHEN span > 0 THEN greatest(span, 1e-6) ELSE 1 END, 1e-6)) AS w FROM ends),
    weighed AS (SELECT query_id, neighbor_id, rank, s, w / sum(w) OVER (PARTITION BY query_id) AS w FROM raw),
    pos AS (SELECT query_id, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z FROM weighed JOIN flat ON neighbor_id = row_id GROUP BY query_id),
    radius AS (SELECT max(sqrt(x * x + y * y + z * z)) AS r FROM flat)"""


@query(f"WITH {PLACED} SELECT query_id, rank::INT AS rank, neighbor_id, round(s, 6) AS similarity, round(w, 6) AS weight FROM weighed")
def softmax_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    one = placed.select("query_id", F.posexplode(F.arrays_zip("neighbors", "similarities", "weights")).alias("at", "e"))
    return one.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.neighbors").alias("neighbor_id"), F.round("e.similarities", 6).alias("similarity"), F.round("e.weights", 6).alias("weight"))


@query(f"""WITH {PLACED}, far AS (SELECT w.query_id, avg(sqrt((f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y) + (f.z - p.z) * (f.z - p.z))) AS d FROM weighed w JOIN flat f ON w.neighbor_id = f.row_id JOIN pos p ON w.query_id = p.query_id GROUP BY w.query_id)
    SELECT p.query_id, round(p.x, 6) AS x, round(p.y, 6) AS y, round(p.z, 6) AS z, round(d / r, 6) AS spread, d / r <= 0.55 AS confident FROM pos p JOIN far USING (query_id), radius""")
def place_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("query_id", *[F.round(a, 6).alias(a) for a in "xyz"], F.round("spread", 6).alias("spread"), "confident")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    flat = C.normalize(p.select("row_id", "embedding", *"xyz"))
    return placement.place(p.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), "embedding"), flat)


@query(f"""WITH {UNIT}, {POINT}, {sql_high(10)}, far AS (SELECT n.row_id, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d FROM high n JOIN p a ON n.row_id = a.row_id JOIN p b ON n.neighbor_id = b.row_id GROUP BY n.row_id),
    r AS (SELECT max(sqrt(x * x + y * y + z * z)) AS r FROM p) SELECT row_id, round(d, 6) AS farthest, round(d / r, 6) AS share, d / r > 0.6 AS lost FROM far, r""")
def neighbor_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    out = search.neighbor_verdict(neighbors.knn(p, 10, "row_id", "embedding"), p.select("row_id", *"xyz"))
    return out.select("row_id", F.round("farthest", 6).alias("farthest"), F.round("share", 6).alias("share"), "lost")


@query(f"WITH {UNIT}, {sql_high(10)} SELECT row_id, rank::INT AS rank, round(0.25 + 0.6 * (1 - (rank - 1) / 9.0::DOUBLE), 6) AS intensity FROM high")
def line_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.line_intensity(neighbors.knn(points(spark, sf_dir), 10, "row_id", "embedding"))
    return near.select("row_id", "rank", F.round("intensity", 6).alias("intensity"))


# -- text and derivation ------------------------------------------------------------------------


@query(f"SELECT doc_id, md5(CASE WHEN t = '|' THEN '' ELSE t END) AS digest, length(CASE WHEN t = '|' THEN '' ELSE t END) AS chars FROM (SELECT doc_id, {sql_clean('text')} AS t FROM documents)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


@query(f"SELECT doc_id, md5({sql_clean("split_part(text, '|', 1)")}) AS first FROM documents")
def first_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.first_segment(F.col("text"))).alias("first"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split(text, '|'), lambda v: v <> ''), ' · ')) AS line FROM documents")
def multi_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.multi_value(F.col("text"))).alias("line"))


YEARS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'ca. 1850' ELSE (p_partkey * 37 % 4500 - 2400)::VARCHAR END AS b, CASE p_partkey % 5 WHEN 0 THEN '0' WHEN 1 THEN ((p_partkey * 11 % 4000 - 1900) + 0.5)::VARCHAR ELSE 'x' END AS e, CASE p_partkey % 3 WHEN 0 THEN p_type || '|' || p_brand WHEN 1 THEN '' END AS t FROM part"


@query(f"""WITH s AS ({YEARS}), y AS (SELECT *, coalesce(nullif(CASE WHEN regexp_matches(b, '^[+-]?[0-9.]+$') THEN trunc(try_cast(b AS DOUBLE)) END, 0), nullif(CASE WHEN regexp_matches(e, '^[+-]?[0-9.]+$') THEN trunc(try_cast(e AS DOUBLE)) END, 0)) AS y FROM s)
    SELECT p_partkey, CASE WHEN y < -500 THEN '{T.PERIOD_EARLY}' WHEN y < 0 THEN '{T.PERIOD_BEFORE}' WHEN y > 0 THEN (floor(y / 100) + 1)::BIGINT || '{T.PERIOD_CENTURY}' ELSE coalesce(nullif(trim(split_part(coalesce(t, ''), '|', 1)), ''), '{T.UNKNOWN}') END AS period FROM y""")
def bucket_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    begin = F.when(k % 6 == 0, "").when(k % 6 == 1, "0").when(k % 6 == 2, "ca. 1850").otherwise((k * 37 % 4500 - 2400).cast("string"))
    end = F.when(k % 5 == 0, "0").when(k % 5 == 1, ((k * 11 % 4000 - 1900) + 0.5).cast("string")).otherwise("x")
    period = F.when(k % 3 == 0, F.concat("p_type", F.lit("|"), "p_brand")).when(k % 3 == 1, "")
    return table(spark, sf_dir, "part").select("p_partkey", T.bucket_period(begin, end, period).alias("period"))


FIELDS = ("source", "lang", "text")


@query("SELECT doc_id, octet_length(encode(r)) AS bytes, (sum(octet_length(encode(r))) OVER (ORDER BY doc_id))::BIGINT - octet_length(encode(r)) AS start_byte FROM (SELECT doc_id, source || chr(31) || lang || chr(31) || trim(regexp_replace(text, '" + BLANK + "', ' ', 'g')) || chr(30) AS r FROM documents)")
def text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    record = d.select("doc_id", F.octet_length(T.record_text([T.collapse(F.col(c)) for c in FIELDS])).cast("long").alias("bytes"))
    # written first: range partitioning reads its input twice, once for the bounds
    return running_start(rows.materialise(record, "record-bytes"), "doc_id", "bytes")


def running_start(df: DataFrame, order: str, size: str) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows before: sums within ranges, plus the totals of the ranges before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.materialise(df.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "offsets")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum(size).alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))  # one row per partition
    inside = F.sum(size).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("inside", inside).join(F.broadcast(totals), "part").select(*df.columns, (F.col("base") + F.col("inside") - F.col(size)).alias("start_byte"))


@query("SELECT doc_id, source, lang, md5(trim(regexp_replace(text, '" + BLANK + "', ' ', 'g'))) AS text_digest, '' AS absent FROM documents")
def record_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    record = d.select("doc_id", T.record_text([T.collapse(F.col(c)) for c in FIELDS]).alias("r"))
    return record.select("doc_id", *T.record_fields(F.col("r"), [*FIELDS, "absent"])).select("doc_id", "source", "lang", F.md5("text").alias("text_digest"), "absent")


# -- curation -----------------------------------------------------------------------------------


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(T.dedup_key(F.col("text"), folded=False).alias("key"), "doc_id", "source", "lang")
    # the key is as long as the text, its digest is not
    return rows.first_by(d.withColumn("key", F.sha2("key", 256)), ["key"], ["doc_id"]).select("doc_id", "source", "lang")


@query("SELECT count(*) AS total, count(*) FILTER (lang <> 'es') AS public_domain, count(*) FILTER (lang <> 'es' AND length(text) >= 200) AS with_title, count(DISTINCT CASE WHEN lang <> 'es' AND length(text) >= 200 THEN lower(text) END) AS after_dedup FROM documents")
def corpus_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return curation.funnel(d.select((F.col("lang") != "es").alias("public"), (F.length("text") >= 200).alias("titled"), F.sha2(F.lower("text"), 256).alias("dedup_key")))


CLASSES = "classes AS (SELECT lang, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY lang), ranked AS (SELECT *, row_number() OVER (ORDER BY size >= 110 DESC, size DESC, first) AS rank FROM classes)"


@query(f"WITH {CLASSES} SELECT lang, size, first, rank::INT AS rank, CASE WHEN size < 110 THEN 'too small' WHEN rank > 2 THEN 'beyond the limit' END AS reason FROM ranked")
def class_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.class_ranks(table(spark, sf_dir, "documents"), "lang", "doc_id", 110, 2)


@query("""WITH classes AS (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 20), q AS (SELECT greatest(1, 300 // (SELECT count(*) FROM classes)) AS q),
    ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:class:' || doc_id), doc_id) AS r FROM documents WHERE lang IN (SELECT lang FROM classes)),
    picked AS (SELECT doc_id, lang FROM ranked, q ORDER BY r > q, CASE WHEN r > q THEN md5('7:fill:' || doc_id) ELSE md5('7:cut:' || doc_id) END, doc_id LIMIT 300)
    SELECT row_number() OVER (ORDER BY md5('7:order:' || doc_id), doc_id) - 1 AS row_id, doc_id, lang FROM picked""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return curation.stratified_sample(d, "lang", "doc_id", 300, 7).select("row_id", "doc_id", "lang")


SIZES = "sizes AS (SELECT source, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY source), top AS (SELECT *, row_number() OVER (ORDER BY size DESC, first) AS rank FROM sizes)"


@query(f"WITH {SIZES} SELECT doc_id, CASE WHEN rank <= 6 THEN source ELSE '{T.OTHER}' END AS source FROM documents JOIN top USING (source)")
def facet_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.cap_facet(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 6)


@query(f"WITH {SIZES} SELECT source AS value, size, rank::INT AS rank FROM top WHERE rank <= 6")
def facet_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.facet_vocabulary(table(spark, sf_dir, "documents"), "source", "doc_id", 6)


@query("SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.label_encode(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "code").select("doc_id", "code")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet_filter(table(spark, sf_dir, "documents"), {"lang": "en", "source": "src1", "n_chars": None}).select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') ORDER BY doc_id LIMIT 5000")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.record_text([F.col(c) for c in ("source", "text")]).alias("t"))
    return search.keyword_search(d, "  LICENSE ", F.col("t"), order="doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'all rights') OR contains(lower(source), 'all rights') ORDER BY doc_id LIMIT 5000")
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by trigrams; the index is written first."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.record_text([F.col(c) for c in ("source", "text")]).alias("t"))
    path = f"{rows.run_dir(spark)}/trigrams-{uuid.uuid4().hex}"
    text_index.build(d, F.col("t"), path, "doc_id")
    return text_index.search(spark, path, " All Rights", F.col("t"), order="doc_id").select("doc_id")


@query("SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY source UNION ALL SELECT 'size', (n_chars // 1000)::VARCHAR, count(*) FROM documents WHERE lang = 'de' GROUP BY ALL")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each value of the open facets would leave, under the choice of one."""
    d = table(spark, sf_dir, "documents").withColumn("size", F.expr("n_chars div 1000"))
    index = rows.materialise(facets.build(d, ["lang", "source", "size"], "doc_id"), "facet-bitmaps")
    return facets.counts(index, {"lang": "de", "source": None})


@query("SELECT lang, source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY lang, source")
def facet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every combination of two facets, counted by bitmaps, and the ids that one filter by bitmaps leaves of each language."""
    d = table(spark, sf_dir, "documents")
    index = rows.materialise(facets.build(d, ["lang", "source"], "doc_id"), "facet-bitmaps")
    left = facets.filter_rows(d, facets.selected(index, {}), "doc_id").groupBy("lang", "source").agg(F.sum("doc_id").alias("ids"))
    n = facets.pair_counts(index, "lang", "source")
    return n.join(left, n["lang"].eqNullSafe(left["lang"]) & n["source"].eqNullSafe(left["source"])).select(n["lang"], n["source"], "n", "ids")


CAMERA = picking.times(picking.perspective(60, 1.5, 0.1, 100), picking.look_at([0.4, 0.3, 0.5], [0.0, 0.0, 0.0]))


def _sql_clip(i: int) -> str:
    return f"(x * {CAMERA[i][0]!r} + y * {CAMERA[i][1]!r} + z * {CAMERA[i][2]!r} + {CAMERA[i][3]!r})"


@query(f"""WITH {POINT}, c AS (SELECT row_id, {_sql_clip(3)} AS w, {_sql_clip(0)} AS cx, {_sql_clip(1)} AS cy, {_sql_clip(2)} AS cz FROM p),
    s AS (SELECT row_id, cx / w AS cx, cy / w AS cy, cz / w AS depth FROM c WHERE w > 0), v AS (SELECT floor((cx + 1) / 2 * 900 / 60)::INT AS cell_x, floor((1 - cy) / 2 * 600 / 60)::INT AS cell_y, depth, row_id FROM s WHERE greatest(abs(cx), abs(cy), abs(depth)) <= 1)
    SELECT cell_x, cell_y, arg_min(row_id, depth) AS id, count(*) AS n FROM v GROUP BY cell_x, cell_y""")
def screen_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest point in each cell of a screen, as a camera inside the layout sees it."""
    return picking.grid_hits(picking.project(points(spark, sf_dir), CAMERA, 900, 600), 60)


@query(f"""WITH {POINT}, b AS (SELECT min(x) AS ax, max(x) AS zx, min(y) AS ay, max(y) AS zy FROM p), q AS (SELECT least(39, floor((x - ax) / (zx - ax) * 40))::INT AS px, (29 - least(29, floor((y - ay) / (zy - ay) * 30)))::INT AS py, label FROM p, b),
    e AS (SELECT px, py, label, count(*) AS n FROM q GROUP BY ALL) SELECT px, py, (sum(n) OVER (PARTITION BY px, py))::BIGINT AS n, label FROM e QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY n DESC, label NULLS FIRST) = 1""")
def layout_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout as a picture of 40 by 30 pixels: points and their most frequent label."""
    p = points(spark, sf_dir)
    return raster.pixels(p, 40, 30, raster.bounds_of(p), "label")


@query("SELECT label AS shard, sum(n)::BIGINT AS n, round(sum(v), 6) AS spread FROM (SELECT label, d, count(*) FILTER (d = 1) AS n, var_pop(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d) GROUP BY label")
def shard_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and total variance of every shard, from the state that principal components are computed from."""
    e = table(spark, sf_dir, "embeddings")
    dims = F.sequence(F.lit(0), F.size("mean") - 1)
    trace = F.aggregate(F.transform(dims, lambda k: F.get("scatter", k * (F.size("mean") + 1))), F.lit(0.0), lambda a, b: a + b)
    return moments.shard_moments(e, "embedding", "label").select("shard", "n", F.round(trace / F.col("n"), 6).alias("spread"))


@query("SELECT doc_id, (CASE WHEN lang = 'en' THEN 1 ELSE 0 END) + (CASE WHEN contains(text, 'license') THEN 2 ELSE 0 END) + (CASE WHEN doc_id = 5 THEN 4 ELSE 0 END) + (CASE WHEN doc_id % 7 = 0 THEN 8 ELSE 0 END) AS flags FROM documents")
def point_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return search.flags(d, F.col("lang") == "en", F.contains("text", F.lit("license")), F.col("doc_id") == 5, F.col("doc_id") % 7 == 0).select("doc_id", "flags")


@query("SELECT doc_id AS row_id, 0 AS position, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id, 1, 'source', source FROM documents UNION ALL SELECT doc_id, 2, 'n_chars', n_chars::VARCHAR FROM documents")
def detail_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.details(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id"), "lang", ["lang", "source"], ["source", "n_chars"])


@query("SELECT user_id::VARCHAR AS id, event_type AS status, arg_max(event_id, event_id)::VARCHAR AS detail FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY ALL")
def journal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return metadata.latest(e.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.col("event_id").cast("string").alias("detail"), F.col("event_id").alias("src_ord")))


@query("SELECT DISTINCT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last <> 'error')")
def journal_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return metadata.pending(ids, journal_latest(spark, sf_dir))


@query("SELECT count(*) AS requested, count(*) FILTER (last = 'click') AS downloaded, count(*) FILTER (last = 'view') AS skipped, count(*) FILTER (last = 'error') AS failed FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) ON c_custkey = user_id")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks stand for downloads and views for objects without an image."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    journal = journal_latest(spark, sf_dir).withColumn("status", F.when(F.col("status") == "click", "ok").when(F.col("status") == "view", "no_image").otherwise(F.col("status")))
    return metadata.journal_stats(ids, journal)


@query("SELECT vec_id AS row_id, printf('cluster-%02d', label) AS name, printf('cluster-%02d #%06d', label, vec_id) AS title FROM embeddings")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = synthetic.cluster_name(F.col("label"))
    return points(spark, sf_dir).select("row_id", name.alias("name"), synthetic.make_title(name, F.col("row_id")).alias("title"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END, ''), 'unbekannt') AS lang FROM documents")
def default_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", T.or_unknown(F.when(k == 0, "").when(k == 1, F.col("lang"))).alias("lang"))


@query(f"WITH {UNIT} SELECT a.row_id, round(list_dot_product(a.e, b.e), 6) AS cosine FROM u a JOIN u b ON b.row_id = a.row_id + 1")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = points(spark, sf_dir).select("row_id", V.l2_normalize(F.col("embedding")).alias("e"))
    after = u.select((F.col("row_id") - 1).alias("row_id"), F.col("e").alias("f"))
    return u.join(after, "row_id").select("row_id", F.round(V.dot(F.col("e"), F.col("f")), 6).alias("cosine"))


@query(f"WITH {UNIT}, {sql_high(10)} SELECT a.label, count(*) AS edges, sum((a.label = b.label)::INT)::BIGINT AS equal FROM high n JOIN u a ON n.row_id = a.row_id JOIN u b ON n.neighbor_id = b.row_id GROUP BY a.label")
def neighbor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that share the label, by label."""
    e = points(spark, sf_dir)
    label = e.select("row_id", "label")
    near = neighbors.knn(e, 10, "row_id", "embedding").join(label, "row_id").join(label.toDF("neighbor_id", "other"), "neighbor_id")
    return near.groupBy("label").agg(F.count("*").alias("edges"), F.count_if(F.col("label") == F.col("other")).alias("equal"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.streaming.ingest import windowed_counts

    out = windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# -- sources and sinks: written, read again and compared ------------------------------------------


#: Columns of the metadata CSV, made from parts.
RAW = {
    "Object ID": "p_partkey::VARCHAR", "Object Number": "'N ' || p_partkey || ', \"' || p_size || '\"'", "Is Public Domain": "CASE WHEN p_size % 7 = 0 THEN 'False' ELSE 'True' END",
    "Department": "p_brand", "Object Name": "'part' || chr(10) || p_size", "Title": "CASE WHEN p_size % 11 = 0 THEN '' ELSE p_name END", "Culture": "p_type || '| from ' || p_brand",
    "Period": "CASE WHEN p_size % 3 = 0 THEN p_type END", "Artist Display Name": "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'n/a' END", "Object Date": "'' || p_size",
    "Object Begin Date": "CASE WHEN p_size % 5 = 0 THEN '' ELSE '' || (p_size * 40 - 900) END", "Object End Date": "'NULL'", "Medium": "p_type", "Classification": "'class ' || p_size % 9 || '|'", "Link Resource": "'http://parts.invalid/' || p_partkey",
}
NULL_WORDS = ", ".join(f"'{w}'" for w in metadata.NULLS)
RAW_SQL = "raw AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN {e} NOT IN ({NULL_WORDS}) THEN {e} END AS {metadata.COLUMNS[c]}" for c, e in RAW.items()) + " FROM part)"


def metadata_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a metadata CSV, with quotes and line ends in its fields as the export has, in files of ascending keys, read again."""
    p = table(spark, sf_dir, "part")
    text = {c: F.expr(e.replace("::VARCHAR", "::STRING")) for c, e in RAW.items()}
    path = f"{rows.run_dir(spark)}/csv-{uuid.uuid4().hex}"
    p.orderBy("p_partkey").select(*[e.alias(c) for c, e in text.items()]).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return metadata.read_metadata(spark, path)


@query(f"WITH {RAW_SQL} SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS src_ord, * EXCLUDE p_partkey FROM raw")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_csv(spark, sf_dir)


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, md5(coalesce(text, '')) AS text, coalesce(source, '') AS source, coalesce(n_chars::VARCHAR, '') AS n_chars FROM documents")
def csv_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV, with line ends and quotes in their texts, read in ranges of 64 KB."""
    names = ["doc_id", "lang", "text", "source", "n_chars"]
    path = f"{rows.run_dir(spark)}/documents-csv-{uuid.uuid4().hex}"
    options = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, sf_dir, "documents").select(*[F.col(c).cast("string") for c in names]).write.options(**options).csv(path)
    found = csv_ranges.scan(spark, path, 1 << 16).select(*[F.coalesce(c, F.lit("")).alias(c) for c in names])
    return found.withColumn("text", F.md5("text"))


@query(f"""WITH {RAW_SQL}, d AS (SELECT p_partkey AS k, object_id, coalesce(title, '') AS title, coalesce(department, '{T.UNKNOWN}') AS department, split_part(culture, '|', 1) AS culture, split_part(classification, '|', 1) AS classification,
        nullif(try_cast(begin_date AS BIGINT), 0) AS y, coalesce(period, '{T.UNKNOWN}') AS per, lower(coalesce(title, '') || '|' || coalesce(artist, '') || '|' || coalesce(object_date, '') || '|' || medium) AS dk FROM raw WHERE is_public_domain = 'True'),
    p AS (SELECT *, CASE WHEN y < -500 THEN '{T.PERIOD_EARLY}' WHEN y < 0 THEN '{T.PERIOD_BEFORE}' WHEN y > 0 THEN (floor(y / 100) + 1)::BIGINT || '{T.PERIOD_CENTURY}' ELSE per END AS period FROM d WHERE title <> ''),
    uniq AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dk ORDER BY k) = 1), s AS (SELECT *, (SELECT count(*) FROM raw r WHERE r.p_partkey < uniq.k) AS ord FROM uniq),
    classes AS (SELECT department FROM s GROUP BY department HAVING count(*) >= 3 ORDER BY count(*) DESC, min(ord) LIMIT 5), q AS (SELECT greatest(1, 60 // (SELECT count(*) FROM classes)) AS q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY department ORDER BY md5('7:class:' || ord), ord) AS r FROM s WHERE department IN (SELECT department FROM classes)),
    picked AS (SELECT * FROM ranked, q ORDER BY r > q, CASE WHEN r > q THEN md5('7:fill:' || ord) ELSE md5('7:cut:' || ord) END, ord LIMIT 60),
    c AS (SELECT *, row_number() OVER (ORDER BY md5('7:order:' || ord), ord) - 1 AS row_id FROM picked),
    top AS (SELECT 'culture' AS f, culture AS v FROM (SELECT culture FROM c GROUP BY 1 ORDER BY count(*) DESC, min(row_id) LIMIT 4) UNION ALL SELECT 'classification', classification FROM (SELECT classification FROM c GROUP BY 1 ORDER BY count(*) DESC, min(row_id) LIMIT 4) UNION ALL SELECT 'period', period FROM (SELECT period FROM c GROUP BY 1 ORDER BY count(*) DESC, min(row_id) LIMIT 4))
    SELECT row_id, object_id, title, department, CASE WHEN culture IN (SELECT v FROM top WHERE f = 'culture') THEN culture ELSE '{T.OTHER}' END AS culture, CASE WHEN classification IN (SELECT v FROM top WHERE f = 'classification') THEN classification ELSE '{T.OTHER}' END AS classification,
        CASE WHEN period IN (SELECT v FROM top WHERE f = 'period') THEN period ELSE '{T.OTHER}' END AS period FROM c""")
def build_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the CSV to a corpus table, written and read again."""
    spec = curation.CorpusSpec(60, "department", 7, 3, 5, 4)
    path = f"{rows.run_dir(spark)}/corpus-{uuid.uuid4().hex}"
    metadata.write_corpus(curation.build_corpus(metadata_csv(spark, sf_dir), spec), path)
    return metadata.read_corpus(spark, path).select("row_id", "object_id", "title", "department", "culture", "classification", "period")


@query("SELECT user_id::VARCHAR AS id, event_type AS status, event_id::VARCHAR AS detail FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def journal_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, among lines that were cut off, read as a journal."""
    e = table(spark, sf_dir, "events").orderBy("event_id")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.col("event_id").cast("string").alias("detail")))
    path = f"{rows.run_dir(spark)}/journal-{uuid.uuid4().hex}"
    e.select(line.alias("value"), "event_id").select(F.when(F.col("event_id") % 5 == 0, F.concat("value", F.lit("\n"), F.substring("value", 1, 20))).otherwise(F.col("value")).alias("value")).coalesce(1).write.text(path)
    return metadata.read_journal(spark, path)


@query("SELECT user_id::VARCHAR AS id, event_type AS status, event_id::VARCHAR AS detail, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS tries FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, event_id::VARCHAR DESC) = 1")
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal entries, taken up by a stream with state, a file at a time."""
    folder = f"{rows.run_dir(spark)}/journal-stream-{uuid.uuid4().hex}"
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("at")
    table(spark, sf_dir, "events").repartitionByRange(4, "event_id").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.col("event_id").cast("string").alias("detail"), at).write.json(f"{folder}/in")
    journal.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", files_per_batch=1, late="3650 days")
    return journal.current(spark, f"{folder}/out")


def artifact_set(spark: SparkSession, sf_dir: str) -> str:
    """Documents as an artefact set: layout, labels, neighbours, facets and records."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    d = rows.materialise(rows.dense_ids(d, "doc_id"), "artifact-rows")
    at = d.select("row_id", F.sin(F.col("row_id").cast("double")).alias("x"), F.cos(F.col("row_id").cast("double")).alias("y"), F.col("row_id").cast("double").alias("z"))
    # written by the driver as files, so the shared folder has to be mounted
    folder = f"{rows.run_dir(spark).removeprefix('file://')}/artifacts-{uuid.uuid4().hex}"
    if not folder.startswith("/"):
        raise artifacts.ArtifactError(f"{folder} is no mounted folder")
    writer = artifacts.ArtifactWriter(folder, d.count())
    writer.add_coords(at)
    writer.add_labels(d, "lang")
    near = d.select("row_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), F.lit(writer.n).alias("n")).select("row_id", "rank", ((F.col("row_id") + F.col("rank")) % F.col("n")).alias("neighbor_id"))
    writer.add_neighbors(near, 2)
    writer.add_metadata(d.withColumn("n_chars", F.col("n_chars").cast("string")), ["source", "lang"], ["n_chars", "text"])
    writer.finish(corpus={"id": "documents"})
    return folder


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, lang AS label, source AS facet_source, lang AS facet_lang, n_chars::VARCHAR AS n_chars, md5({sql_clean('text')}) AS text, [(row_number() OVER (ORDER BY doc_id)) % (SELECT count(*) FROM documents), (row_number() OVER (ORDER BY doc_id) + 1) % (SELECT count(*) FROM documents)]::VARCHAR AS near FROM documents")
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = artifacts.load(spark, artifact_set(spark, sf_dir))
    near = found["neighbors"].groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id"))), lambda s: s["neighbor_id"]).alias("n"))
    joined = found["points"].join(found["records"], "row_id").join(near, "row_id")
    return joined.select("row_id", "label", "facet_source", "facet_lang", "n_chars", F.md5("text").alias("text"), F.concat(F.lit("["), F.array_join(F.transform("n", lambda x: x.cast("string")), ", "), F.lit("]")).alias("near"))


@query("SELECT 'colors.u8.bin' AS name, 'checksum' AS problem UNION ALL SELECT 'labels.u16.bin', 'missing or empty' UNION ALL SELECT 'neighbors.u32.bin', 'size'")
def artifact_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check says of a set with one file altered, one gone and one cut."""
    folder = Path(artifact_set(spark, sf_dir))
    raw = (folder / artifacts.COLORS).read_bytes()
    (folder / artifacts.COLORS).write_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    (folder / artifacts.LABELS).unlink()
    (folder / artifacts.NEIGHBORS).write_bytes((folder / artifacts.NEIGHBORS).read_bytes()[:-4])
    return artifacts.verify(spark, str(folder)).where("not endswith(name, '.gz')")


# -- beyond SQL: numeric kernels and encoders -----------------------------------------------------


@query(None)
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = points(spark, sf_dir).select("row_id", V.l2_normalize(F.col("embedding")).alias("unit"))
    return reduce.apply_pca(e, reduce.fit_pca(e, "unit", 3), "unit", "p").select("row_id", *[F.round(F.col("p")[k], 6).alias(a) for k, a in enumerate("xyz")])


@query(None)
def umap_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = points(spark, sf_dir).select("row_id", "embedding")
    return reduce.project(e, "row_id", "embedding", 16, reduce.UmapSpec(neighbors=15, epochs=100))[0]


@query(None)
def stub_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", synthetic.stub_encoder(16)("text").alias("embedding"))
