import random

import numpy as np
from tables import rows

from tidemerge.llm import langid, quality, toxicity
from tidemerge.llm.common import held_out_fold
from tidemerge.llm.word_hashes import hashed, slices


def held_out(df):
    return {r.doc_id for r in df.where(held_out_fold(df.doc_id)).collect()}


def test_language_of_held_out_documents(spark, small):
    docs = small[0]
    model = langid.fit(docs)
    assert model.languages == ["aa", "bb"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    truth = {r.doc_id: r["lang"] for r in docs.collect()}
    fold = held_out(docs)
    assert 40 < len(fold) < 120 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].lang_pred == truth[i] for i in fold]) > 0.97


def test_language_backs_off_to_shorter_grams():
    model = langid.LanguageModel(["x", "y"], [{"known": np.array([1, -1], np.float32)}, {"a": np.array([-1, 1], np.float32)}, {"ab": np.array([2, -2], np.float32)}])
    assert model.score("known")[0] == 1 and model.score("ab")[0] == 2 and model.score("ca")[1] == 1 and not model.score("zz").any()


def test_language_of_odd_rows(spark, odd, small):
    out = langid.identify(odd, langid.fit(small[0])).collect()
    assert len(out) == 8 and {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 5)} <= {"und"}
    predict = langid.fit(small[0]).predictor()
    assert predict("\u00bd \u2167 12 !")[0] == "und" and predict("ba")[0] == "aa"
    nothing = langid.fit(odd.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(odd.limit(0), nothing).count() == 0


def test_toxicity_of_held_out_documents(spark, small):
    docs, labels = small
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    fold = held_out(docs)
    hits = [(got[i].predicted, truth[i]) for i in fold]
    assert sum(p == t for p, t in hits) / len(hits) > 0.95
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_labels_of_the_held_out_fold_are_never_learned(spark, small):
    docs, labels = small
    from pyspark.sql import functions as F

    wrong = labels.withColumn("toxic", F.when(held_out_fold(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(toxicity.score(docs, toxicity.fit(docs, labels))) == rows(toxicity.score(docs, toxicity.fit(docs, wrong)))


def test_toxicity_of_odd_rows(spark, small, odd):
    model = toxicity.fit(*small)
    out = toxicity.score(odd, model).collect()
    assert len(out) == 8 and all(0 <= r.score < 0.3 and r.predicted == 0 for r in out)
    none = toxicity.fit(odd, spark.createDataFrame([(4, None), (None, 1)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_texts_are_windowed_whole():
    word = bytes(97 + k % 26 for k in range(500))
    assert set().union(*({w[k : k + 16] for k in range(len(w) - 15)} for w in toxicity.words_of(word.decode()))) == {word[k : k + 16] for k in range(485)}
    for n in range(1, 20):
        words = [b"w%d" % k for k in range(n)]
        assert {w for x in toxicity.windows_of(words, 2) for w in x.split()} == set(words)
    assert toxicity.windows_of([], 2) == []


def test_toxic_phrases_of_ordinary_words():
    rng = random.Random(17)
    common = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))).encode() for _ in range(150)]
    phrases = [[b"gobacktoyour", b"swamp"], [b"nobodywants", b"youhere"], [b"whata", b"wasteofspace"]]

    def text(toxic):
        words = rng.choices(common, k=rng.randrange(30, 90))
        for phrase in rng.choices(phrases, k=3 if toxic else 0):
            words[(at := rng.randrange(len(words))) : at] = phrase
        return words

    read = [(i, text(i % 4 == 0), int(i % 4 == 0), i % 3 + (i % 3 == 2)) for i in range(600)]
    model = toxicity.fit_texts(read, 0.25)
    score = model.scorer()
    test = [(score(b" ".join(text(k)).decode()) >= 0.3, k) for k in [True, False] * 100]
    assert model.toxic and np.mean([p == t for p, t in test]) > 0.95


def test_quality_of_held_out_documents(spark, small):
    docs, labels = small
    graded = labels.selectExpr("doc_id", "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS grade")
    model = quality.fit(docs, graded)
    assert list(np.diff(model.thresholds) > 0) == [True] and model.grades == [0, 1, 2]
    got = {r.doc_id: r for r in quality.grade(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    fold = held_out(docs)
    assert np.mean([got[i].selected == truth[i] for i in fold]) > 0.95
    for r in got.values():
        assert r.tails[0] >= r.tails[1] and abs(r.expected_grade - sum(r.tails)) < 1e-9


def test_ordinal_fit_finds_ordered_grades():
    rng = np.random.default_rng(3)
    x = rng.random((600, 4))
    latent = x @ np.array([4.0, -4.0, 2.0, 0.0]) + rng.logistic(size=600) * 0.2
    grades = np.searchsorted([-1.0, 1.0, 2.5], latent)
    model = quality.fit_ordinal([(np.arange(10, 14), v) for v in x], grades, 4)
    z = x @ model.weights[10:14]
    assert np.corrcoef(z, latent)[0, 1] > 0.97 and (np.diff(model.thresholds) > 0).all()
    assert np.mean(np.searchsorted(model.thresholds, z) == grades) > 0.8


def test_quality_of_odd_rows(spark, small, odd):
    assert quality.fit(odd, spark.createDataFrame([(4, 1)], "doc_id long, grade int")) is None
    out = quality.grade(odd, None).collect()
    assert len(out) == 8 and {r.selected for r in out if r.doc_id in (1, 2, 3)} == {0} and {r.selected for r in out if r.doc_id in (4, 5, 6)} == {1}
    model = quality.fit(small[0], small[1].selectExpr("doc_id", "quality AS grade"))
    graded = quality.grade(odd, model).collect()
    assert len(graded) == 8 and {(r.selected, r.expected_grade, *r.tails) for r in graded if r.doc_id in (1, 2, 3)} == {(0, 0.0, 0.0)}
    assert quality.grade(odd.limit(0), model).count() == 0


def test_word_hashes_equal_words():
    import re

    import pyarrow as pa

    rng = random.Random(8)
    texts = ["".join(rng.choices("abC É漢1 .,\n-", k=rng.randrange(60))) for _ in range(400)] + [None, "", "a", "x" * 700]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    words, counts, codes = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts], [], []
    for part in slices(batch, limit=500):
        h, n = hashed(part.column("text"))
        counts += n.tolist()
        codes += h.tolist()
    assert counts == [len(w) for w in words]
    seen = {}
    for word, code in zip([w for ws in words for w in ws], codes, strict=True):
        assert seen.setdefault(word, code) == code
    assert len(set(seen.values())) == len(seen)
