import re

import sentencepiece

import __spark_entry__
import corpus_pipeline
from corpusloom.llm import toxicity
from corpusloom.llm.queries import tokenizer_path
from tests.llm.test_secrets import brute as brute_secrets
from tests.llm.test_simhash import plain_components, plain_print

KINDS = ("ASSIGN", "ACCESS", "HEX")


def redacted(text):
    parts, at = [], 0
    for start, kind, end in brute_secrets(text):
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def holds(text, item):
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    doc, item = words(text), words(item)
    windows = {tuple(item[p : p + 8]) for p in range(len(item) - 7)}
    return any(tuple(doc[p : p + 8]) in windows for p in range(len(doc) - 7))


def test_run_against_plain_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if score[r.doc_id] < 0.5)
    roots = plain_components([plain_print(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    items = [r.text for r in bench.collect()]
    rows = [(i, redacted(t)) for i, t in rows if not any(holds(t, x) for x in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = {i: library.encode(t) for i, t in rows}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, "plain text", None, "s", 10, 0.5), (1, "plain text", None, "s", 10, 0.5), (None, None, None, None, None, None), (2, "", "en", "s", 0, 1.0), (3, "token = abcdefgh", "en", "s", 16, 1.0)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "sentencepiece":
            assert out.count() == docs.count()
        else:
            assert out.schema.names == docs.schema.names, name
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    # the two empty texts are near-duplicates, and so are the repeated rows
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in docs.collect()) == [("1", "plain text", 10), ("2", "", 0), ("3", "<ASSIGN>", 8)]


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
