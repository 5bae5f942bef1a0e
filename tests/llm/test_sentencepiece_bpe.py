import hashlib

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import sentencepiece_bpe
from corpusloom.llm.queries import tokenizer_path
from corpusloom.llm.sentencepiece_bpe import encode_texts, load_model

CASES = ["", " ", "  ", "a  b\n\nc", "▁a ▁", "\x00x", " lead", "tail ", "á é 中", "<s> <0x0A> </s>", "𝔘", "a" * 3000, " " * 501 + "x" + " " * 77, "\n\n \n", "¿qué? 日本語 😀😀", "aaaa" * 99 + "bbb ab" * 50, "\t\r\n x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_cases_equal_the_library(library):
    model = load_model(tokenizer_path())
    for text in CASES:
        ids = library.encode(text)
        assert model.encode(text) == ids, text[:50]
        assert model.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdehinorst  ▁\n.,AZ09éü中😀"), st.characters(codec="utf-8")), max_size=120))
def test_any_text_equals_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    ids = library.encode(text)
    assert load_model(tokenizer_path()).encode(text) == ids
    assert load_model(tokenizer_path()).decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(3, 258), st.integers(0, 31999)), max_size=40))
def test_any_ids_decode_as_the_library(ids):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    assert load_model(tokenizer_path()).decode(ids) == library.decode(ids)


def test_rows(spark, library):
    rows = [(1, t, "x") for t in CASES] + [(None, None, "y"), (1, None, None)]
    got = encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string"), tokenizer_path(), keep_text=True).collect()
    want = [(i, library.encode(t or "")) for i, t, _ in rows]
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), ids) for i, ids in want)
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded == library.decode(list(r.ids)) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


def test_a_batch_of_long_texts_is_held_in_portions(monkeypatch, library):
    class Tasks:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(sentencepiece_bpe, "text_rows", lambda *a: Tasks())
    texts = ["ab " * 150_000, "", "c d", "é" * 700_000, *["word "] * 5, "x" * 600_000]
    whole = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    got = list(encode_texts(None, tokenizer_path())(iter([whole])))
    assert [b.num_rows for b in got] == [4, 6] and list(encode_texts(None, tokenizer_path())(iter([whole.slice(0, 0)]))) == []
    assert [n for b in got for n in b.column("n_tokens").to_pylist()] == [len(library.encode(t)) for t in texts]
