"""The operators applied to the driver's whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import conversation_repair, decontamination, embedding_dedup, licenses, secrets, sentencepiece_bpe, sharding, simhash, substring_dedup, suffix_dedup, target_encoding, toxicity, url_filter


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents")).drop("found")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_copies(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True, chained=True).drop("text_key")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("places")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_encoding.encode_sales(*[_table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(conversations), conversations)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans", "kept")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: the counts of the base kinds."""
    return secrets.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: hosts, paths, rules, and the verdicts of rules."""
    judged = url_filter.judge(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def shard_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: all but the checksum."""
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents")).select("doc_id", "size", "law", "shard", "slot")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: words, and places of the base phrases."""
    return licenses.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secret_scan, op2_url_filter, op3_substring_dedup, op4_sentencepiece, op5_simhash, op6_decontamination, op7_embedding_dedup, op8_sharding, op9_license_scan, op10_toxicity, op11_target_encoding, op12_conversation_repair, op13_suffix_dedup, secret_counts, url_rules, shard_places, license_phrases)
    return {f.__name__: f for f in found}


#: The words of a text, their repeated windows of 35, and what is left of each text.
OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\x0c\r]+') AS ws FROM documents),
place AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w),
win AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 34), ' ') AS s FROM place),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, p + o AS q FROM win JOIN dup USING (s), range(35) AS r(o)),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS t FROM word ANTI JOIN hit USING (doc_id, q) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

#: Pairs of equal label with a cosine from 0.98, and what can be reached over them.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

SECRET_COUNTS_SQL = f"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '({_KEYS})["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 6)) AS n_assign,
    len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24)) AS n_hex FROM documents
"""

#: The longest rule first.
_RULES = sorted(url_filter.RULES, key=lambda r: -len(r.host + r.path))
_FITS = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in _RULES]

URL_RULES_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
part AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{r.host}{r.path}'" for f, r in zip(_FITS, _RULES, strict=True))} END AS rule,
    CASE {" ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(_FITS, _RULES, strict=True))} END AS rule_verdict FROM part
"""

SHARD_PLACES_SQL = """
WITH s AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
placed AS (SELECT doc_id, size, ((sum(size) OVER (ORDER BY doc_id) - size) * 8 // (SELECT sum(size) FROM s))::INT AS shard FROM s)
SELECT doc_id, size, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot FROM placed
"""

LICENSE_PHRASES_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1)::BIGINT - 1 AS p FROM w),
three AS (SELECT doc_id, p, a, lead(a) OVER each AS b, lead(a, 2) OVER each AS c FROM word WINDOW each AS (PARTITION BY doc_id ORDER BY p)),
hit AS (SELECT doc_id, p, CASE WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' WHEN a = 'all' AND b = 'rights' AND c = 'reserved' THEN 'reserved' END AS label FROM three),
found AS (SELECT doc_id, count(*) AS n, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN found USING (doc_id)
"""

#: What SQL needs for a CRC-32: the table of 256 entries, by the polynomial.
CRC_TABLE = "table_ AS (SELECT list(c ORDER BY i) AS t FROM (WITH RECURSIVE s(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM s WHERE k < 8) SELECT i, c FROM s WHERE k = 8))"


def sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII text; t holds the 256 table entries."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: xor(r >> 8, t[(xor(r, c) & 255) + 1])), 4294967295)"


def _sql_history(column: str, name: str, source: str = "f") -> str:
    past = "ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    each = lambda x: f"(coalesce(sum({x}) OVER (PARTITION BY {column} {past}), 0) - coalesce(sum({x}) OVER (PARTITION BY {column}, fold {past}), 0))::BIGINT"
    return f"{each('n')} AS {name}_n, {each('s')} AS {name}_s"


def _sql_rate(name: str, prior: str) -> str:
    return f"CASE WHEN {name}_n < 1 THEN {prior} ELSE (1000000 * {name}_s + 50 * {prior}) // ({name}_n + 50) END::BIGINT"


OP11_SQL = f"""
WITH {CRC_TABLE}, l AS (SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, count(*) AS n, count(*) FILTER (flag = 'returned') AS s FROM sale_lines GROUP BY ALL),
f AS (SELECT l.*, coalesce(client_id, -1) AS client_id, sold_at, epoch_us(sold_at) AS us, {sql_crc32('l.sale_id::VARCHAR')} % 5 AS fold FROM l JOIN sales USING (sale_id), table_ WHERE sold_at IS NOT NULL),
d AS (SELECT f.*, kind, vendors.nation_id, segment, 0 AS one FROM f LEFT JOIN items USING (item_id) LEFT JOIN vendors USING (vendor_id) LEFT JOIN clients USING (client_id)),
h AS (SELECT *, {", ".join(_sql_history(c, k) for c, k in (("one", "all"), ("kind", "kind"), ("nation_id", "nation"), ("segment", "segment"), ("item_id", "item"), ("vendor_id", "vendor"), ("client_id", "client")))} FROM d),
a AS (SELECT *, {_sql_rate("all", "500000")} AS p FROM h),
g AS (SELECT *, {", ".join(f"{_sql_rate(k, 'p')} AS {k}_rate" for k in ("kind", "nation", "segment"))} FROM a)
SELECT sale_id, item_id, vendor_id, n AS n_lines, s AS n_returned, {", ".join(f"{k}_n, {_sql_rate(k, up + '_rate')} AS {k}_rate" for k, up in (("item", "kind"), ("vendor", "nation"), ("client", "segment")))}, client_id, sold_at FROM g
"""


#: The lattice by turns: of each state, what insertions before and after a turn lead to, and what edits of the turn do.
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations, table_),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE d <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM dam),
flt AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM num),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ins(q, q2, cost, w, rows) AS (VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')),
edit(q, q2, c, cost, w, role) AS (VALUES (0, 0, NULL, 3, 'D', NULL), (1, 1, NULL, 3, 'D', NULL), (2, 2, NULL, 3, 'D', NULL), (3, 3, NULL, 3, 'D', NULL), (0, 1, 's', 0, 'K', NULL), (0, 2, 'u', 0, 'K', NULL), (1, 2, 'u', 0, 'K', NULL), (2, 3, 'a', 0, 'K', NULL), (3, 2, 'u', 0, 'K', NULL), (0, 2, NULL, 2, 'R', 'user'), (1, 2, NULL, 2, 'R', 'user'), (2, 3, NULL, 2, 'R', 'assistant'), (3, 2, NULL, 2, 'R', 'user')),
step AS (SELECT conv_id, 0::BIGINT AS i, q2 AS q, {{'cost': cost::BIGINT, 'audit': w, 'out': rows}} AS s FROM ids, ins WHERE q = 0
    UNION ALL SELECT conv_id, i, q, min(s) AS s FROM (SELECT step.conv_id, flt.i, ins.q2 AS q, {{'cost': step.s.cost + edit.cost + ins.cost + CASE WHEN edit.w <> 'D' AND flt.f = 't' THEN 1 ELSE 0 END, 'audit': step.s.audit || edit.w || ins.w, 'out': step.s.out || CASE WHEN edit.w = 'D' THEN '' ELSE chr(10) || coalesce(edit.role, flt.role) || ':' || flt.text END || ins.rows}} AS s
        FROM step JOIN flt ON flt.conv_id IS NOT DISTINCT FROM step.conv_id AND flt.i = step.i + 1 JOIN edit ON edit.q = step.q AND (edit.c IS NULL OR edit.c = flt.c) AND (edit.w = 'D' OR flt.f NOT IN ('b', 'd')) JOIN ins ON ins.q = edit.q2) GROUP BY conv_id, i, q),
best AS (SELECT conv_id, arg_max(s, i) AS s FROM (SELECT conv_id, i, min(s) AS s FROM step WHERE q IN (0, 3) GROUP BY ALL) GROUP BY conv_id),
num_of AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT ids.conv_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, best.s.cost AS cost, best.s.audit AS audit, sha256(substr(best.s.out, 2)) AS repaired_sha256
FROM ids LEFT JOIN num_of ON num_of.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
"""



def _sql_doubled(width: int) -> str:
    return f"h{2 * width} AS (SELECT *, hash(h{width}, lead(h{width}, {width}) OVER (PARTITION BY doc_id ORDER BY i)) AS h{2 * width} FROM h{width})"


#: Hashes of 1, 2, 4, ... bytes from every byte on, those of 128, 64 and 8 joined to 200.
OP13_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents),
b AS (SELECT doc_id, len(bs) AS n, unnest(bs) AS c, generate_subscripts(bs, 1) AS i FROM d), h1 AS (SELECT *, hash(c) AS h1 FROM b), {", ".join(_sql_doubled(2**k) for k in range(7))},
h200 AS (SELECT doc_id, c, i, CASE WHEN i + 199 <= n THEN hash(h128, lead(h64, 128) OVER w, lead(h8, 192) OVER w) END AS h FROM h128 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT doc_id, c, i, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS hit FROM h200),
cov AS (SELECT doc_id, c, i, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i) >= i - 199, false) AS gone FROM hit),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM cov),
cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(c, '' ORDER BY i) FILTER (NOT gone) AS kept FROM run GROUP BY doc_id)
SELECT doc_id, len(bs) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op7_embedding_dedup": OP7_SQL, "secret_counts": SECRET_COUNTS_SQL, "url_rules": URL_RULES_SQL, "shard_places": SHARD_PLACES_SQL, "license_phrases": LICENSE_PHRASES_SQL, "op11_target_encoding": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_suffix_dedup": OP13_SQL}
