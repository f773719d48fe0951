"""Quality and language: held-out accuracy on the driver data, and the defined odd cases."""

import duckdb
import numpy as np
import pytest

from emberline.llm.languages import LanguageModel, detect_language, fit_languages, ngram_features
from emberline.llm.queries import QUERIES
from emberline.llm.quality import FEATURES, AdditiveModel, fit_quality, note_features, score_notes

SF = "/root/testdata/sf0.01"


def table(sql):
    return duckdb.connect().execute(sql).fetchall()


def test_language_held_out_accuracy(spark):
    truth = dict(table(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'"))
    rows = QUERIES["op5_language_id"](spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 300 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_quality_held_out_accuracy(spark):
    truth = dict(table(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'"))
    rows = QUERIES["op8_quality"](spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good = [r.score for r in held if truth[r.doc_id] == 1]
    bad = [r.score for r in held if truth[r.doc_id] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97


ODD = [(1, None), (2, ""), (3, "123 !!"), (3, "123 !!"), (None, "the and of the"), (5, "é" * 40_000), (6, "\n\n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in ODD], "obs_id long, note string, score double, lang_pred string")


def test_language_odd_rows(spark, odd):
    train = spark.createDataFrame([(i, "the and of this that was", "en") for i in range(8)] + [(50 + i, "der die und das nicht", "de") for i in range(8)]
                                  + [(90, None, "fr"), (91, "le la", None)], "obs_id long, note string, language string")
    model = fit_languages(train)
    got = detect_language(odd, model).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.obs_id in (1, 2, 3, 6):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.obs_id is None:
            assert r.lang_pred == "en" and r.score > 0.5
    assert {r.lang_pred for r in detect_language(odd, None).collect()} == {"und"}
    assert fit_languages(train.limit(0)) is None
    one = fit_languages(train.where("language = 'de'"))
    assert {r.lang_pred for r in detect_language(odd, one).collect()} == {"und", "de"}
    assert detect_language(odd.limit(0), model).count() == 0


def test_families_group_close_languages():
    rng = np.random.default_rng(0)
    names, x = [], []
    for k, lang in enumerate(["aa", "ab", "za", "zb"]):
        stem = "qwer tyqw werty qutr" if k < 2 else "mnbv cxmn bvnm vcnb"
        for _ in range(40):
            extra = "xyz"[k % 2] * 3
            words = rng.permutation([*stem.split(), "go" + extra, extra]).tolist() * 3
            names.append(lang)
            x.append(" ".join(words).encode())
    model = LanguageModel.fit(ngram_features(x), np.array(names, object))
    assert sorted(model.families) == [["aa", "ab"], ["za", "zb"]]
    assert (model.predict(ngram_features(x))[0] == np.array(names)).mean() > 0.95


def test_features_do_not_leak_between_notes():
    a, b = b"the cat sat", "über die".encode()
    both = ngram_features([a, b"", b])
    assert np.allclose(both[0], ngram_features([a])[0]) and np.allclose(both[2], ngram_features([b])[0]) and not both[1].any()


def test_quality_odd_rows(spark, odd):
    ratings = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (7, None), (4, 1)], "obs_id long, reliable int")
    notes = spark.createDataFrame([(i, "fine words here" if i % 2 else "&&& *** &&&") for i in range(20)], "obs_id long, note string")
    model = fit_quality(notes, ratings)
    got = score_notes(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    scores = {r.obs_id: r.score for r in got}
    assert scores[1] == scores[2]
    assert {r.score for r in score_notes(odd, fit_quality(notes, ratings.limit(0))).collect()} == {0.5}
    assert score_notes(odd.limit(0), model).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel.fit(x, y, np.ones(len(y)))
    assert {(0, 1)} <= {(a, b) for a, b, _ in model.pairs}
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_note_features_are_finite():
    x = note_features([b"", b" ", b"a", "ç ç ç".encode(), b"!!\n!!\n"])
    assert x.shape == (5, len(FEATURES)) and np.isfinite(x).all()
