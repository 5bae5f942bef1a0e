import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.toxicity import BITS, Ftrl, drop_toxic, fit, score, toxicity, train
from corpusloom.llm.words import BLANKS, LETTERS, batches_of, split

SF = "/root/testdata/sf0.1"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n é,Zlongerwords", max_size=40), max_size=8))
def test_words_are_those_of_bytes_split(texts):
    words = split(pa.array(["skipped", *texts], pa.string()).slice(1), BLANKS)
    found = [[bytes(words.data[a:b]) for a, b in zip(words.start[i:j], words.end[i:j], strict=True)] for i, j in zip(words.first, words.first[1:], strict=False)]
    assert found == [t.encode().split() for t in texts]
    assert len(set(zip(words.hashes().tolist(), sum(found, []), strict=True))) == len(set(sum(found, [])))
    assert sum(b.num_rows for b in batches_of(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), limit=10)) == len(texts)


def test_letters_fold_case_and_drop_signs():
    words = split(pa.array(["It's ÉTÉ-x9!"]), LETTERS)
    assert [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end, strict=True)] == ["it", "s", "ÉtÉ", "x9"]


def test_l1_keeps_only_what_tells():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.r_[rng.integers(100, 5000, 30), [7] if y else [8], 1 << BITS]), int(y)) for y in rng.random(600) < 0.3]
    at, w = fit(iter(rows), Ftrl())
    assert {7, 8} <= set(at.tolist()) and len(at) < 60 and w[at == 7][0] > 1 > w[at == 8][0]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.96
    assert (out[out.toxic == 0].predicted == 0).mean() > 0.99
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_ids_langs_and_held_out_labels_do_not_count(spark):
    rows = [(i, "bad word here" if i % 2 else "good word there") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = [(i, i % 2) for i, _ in rows]
    flipped = [(i, 1 - y if i in out else y) for i, y in labels]
    scores = [{r.doc_id: r.score for r in toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1] and all((scores[0][i] > 0.5) == bool(i % 2) for i, _ in rows)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a", "q"), (1, "a", "q"), (None, None, None), (2, "", "z"), (9, "x y " * 100_000, "z")], "doc_id long, text string, score string")
    got = toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity(docs.limit(0), labels).collect() == [] and len(toxicity(docs, labels.limit(0)).collect()) == 5
    assert drop_toxic(docs, labels.limit(0)).columns == docs.columns


M = (1 << 64) - 1


def plain_mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def plain_hash(word):
    h = plain_mix((len(word) + 0x9E3779B97F4A7C15) & M)
    for k in range(0, len(word), 8):
        h = plain_mix(h ^ int.from_bytes(word[k : k + 8], "little"))
    return h


def plain_features(text):
    """The places of words, pairs of neighbours and pairs around one word of a text."""
    words = [plain_hash(w) for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode().lower())]
    found = set(words)
    for gap, salt in ((1, 0xA5A5A5A5), (2, 0x5A5A5A5A)):
        found |= {plain_mix((a * 0x9E3779B97F4A7C15 + b + salt) & M) for a, b in zip(words, words[gap:], strict=False)}
    return sorted({h >> 64 - BITS for h in found})


def plain_ftrl(rows, params):
    """FTRL-proximal (McMahan et al. 2013) with dictionaries, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == 1 << BITS else params.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((params.beta + math.sqrt(n[i])) / params.alpha + params.l2)

    for _ in range(params.epochs):
        for places, label in rows:
            w = {i: weight(i) for i in [*places, 1 << BITS]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i, wi in w.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / params.alpha
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_weights_and_scores_against_plain_ftrl(spark):
    random.seed(9)
    vocabulary = ["bad", "worse", "Fine", "good", "é-mail", "x9", "averyveryverylongword", "the", "of"]
    rows = [(i, " ".join(random.choices(vocabulary, [1 + 6 * (i % 3 == 0)] * 2 + [2] * 7, k=random.randint(0, 25)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    params = Ftrl(l1=0.5, epochs=3)
    at, w = train(docs, labels, params)
    order = {r.doc_id: r.o for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 'toxicity') o").collect()}
    used = sorted((i for i, _ in rows if zlib.crc32(str(i).encode()) % 5), key=order.get)
    want = plain_ftrl([(plain_features(rows[i][1]), int(i % 3 == 0)) for i in used], params)
    assert set(at.tolist()) == set(want) and len(want) > 20
    assert all(abs(v - want[i]) < 1e-9 for i, v in zip(at.tolist(), w.tolist(), strict=True))
    for r in score(docs, (at, w)).collect():
        total = want.get(1 << BITS, 0.0) + sum(want.get(i, 0.0) for i in plain_features(r.text))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_training_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 50) for i in range(200)] + [(300, "long " * 100_000)] + [(301, "many")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(200), 300, 301]], "doc_id long, toxic int")
    all_, few = (train(docs, labels, Ftrl(l1=0.0, epochs=1, **b))[0] for b in ({"max_text_bytes": 10_000}, {"max_text_bytes": 10_000, "max_bytes": 2_000, "max_rows": 400}))
    long_place = plain_features("long")[0]
    assert long_place not in all_ and 150 < len(all_) and len(few) < 60
    assert long_place in train(docs, labels, Ftrl(l1=0.0, epochs=1))[0]


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a", 0.1), (1, "a", 0.1), (None, None, None), (2, "", 1.0)], "doc_id long, text string, toxicity double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted(map(str, drop_toxic(docs, none).collect())) == sorted(map(str, docs.collect()))
    assert drop_toxic(docs.limit(0), none).collect() == []
