import zlib

import numpy as np
import pytest

from cairn.llm import langid, queries
from tests.llm.data import docs, rows

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    data = rows(n=80)
    got = {r.doc_id: r for r in langid.identify(docs(spark, data)).collect()}
    assert len(langid.identify(docs(spark, data)).collect()) == len(data)
    for i in (0, 1, 2, 3):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[8].lang_pred in {"en", "fr", "de"}


def test_lang_source_and_id_are_no_inputs(spark):
    data = [(i, "le la les été avec pour" if i % 2 else "the and of with for", "fr" if i % 2 else "en", "s", 0) for i in range(90)]
    model = langid.train(docs(spark, data))
    moved = [(i + 1000, t, None, None, None) for i, t, *_ in data]
    a = [(r.lang_pred, r.score) for r in langid.predict(docs(spark, data), model).orderBy("doc_id").collect()]
    b = [(r.lang_pred, r.score) for r in langid.predict(docs(spark, moved), model).orderBy("doc_id").collect()]
    assert a == b and {x for x, _ in a} == {"en", "fr"}


@pytest.mark.parametrize("data", [[], [(1, "some words", None, None, None)]])
def test_no_labels(spark, data):
    got = langid.identify(docs(spark, data)).collect()
    assert [r.lang_pred for r in got] == ["und"] * len(data)


def test_kernel_counts_shared_ngrams():
    """Against sets of n-grams in plain Python (no collisions among so few)."""
    a, b = "abcabd", "abde"
    grams = lambda s: {s[i : i + n] for n in langid.GRAMS for i in range(len(s) - n + 1)}
    x = langid.presences([a, b])
    assert x[0] @ x[1] == pytest.approx(len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5, abs=1e-6)


def test_whole_long_text_counts(monkeypatch):
    text = "abc " * 5000 + "ß"
    one = langid.presences([text])
    monkeypatch.setattr(langid, "PART", 1000)
    assert (langid.presences([text]) == one).all()
    assert (langid.presences([text]) != langid.presences(["abc " * 5000])).any()


def test_sample_is_bounded(spark):
    data = [(i, "word here", "en", "s", 0) for i in range(2000)]
    texts, langs = langid.sample(docs(spark, data), id_col="doc_id", text_col="text", lang_col="lang", per_language=50, max_languages=3, max_bytes=100)
    assert 20 <= len(texts) <= 100 and set(langs) == {"en"}


def test_landmarks_and_ridge_equal_the_dual_solve():
    """With every text a landmark the Nystroem features are exact: scores equal kernel ridge regression in the dual, weighted by class."""
    rng = np.random.default_rng(2)
    words = {"en": ["the", "and", "river", "stone"], "fr": ["avec", "pour", "les", "été"], "de": ["und", "für", "straße", "nicht"]}
    langs = ["en"] * 30 + ["fr"] * 20 + ["de"] * 10
    texts = [" ".join(rng.choice(words[x], 6)) + f" {i}" for i, x in enumerate(langs)]
    model = langid.fit(texts, langs, landmarks=3 * 60, ridge=1e-2)
    new = [" ".join(rng.choice(sum(words.values(), []), 5)) for _ in range(40)]
    sets = lambda s: {(n, s.lower().encode()[i : i + n]) for n in langid.GRAMS for i in range(len(s.encode()) - n + 1)}
    x, z = langid.presences(texts).astype(np.float64), langid.presences(new).astype(np.float64)
    a, b = sets(texts[0]), sets(texts[1])
    assert x[0] @ x[1] == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, abs=0.01)
    names = sorted(words)
    y = (np.array(langs)[:, None] == np.array(names)).astype(float)
    weight = len(langs) / 3 / y.sum(axis=0)[[names.index(v) for v in langs]]
    # (W^1/2 K W^1/2 + r I) dual: minimises sum of w (f - y)^2 + r |f|^2
    root = np.sqrt(weight)
    dual = np.linalg.solve(root[:, None] * (x @ x.T) * root + 1e-2 * len(langs) / 100 * np.eye(len(langs)), root[:, None] * y) * root[:, None]
    f = z @ x.T @ dual
    assert np.abs(z @ model.landmarks @ model.coefficients - f).max() < 2e-3
    e = np.exp(model.sharpness * f)
    assert np.allclose(model.scores(new), e / e.sum(axis=1, keepdims=True), atol=0.02)


def test_nothing_goes_where_no_language_is_known(spark):
    data = [(1, "some words", None, None, None), (2, "123", None, None, None), (3, None, None, None, None)]
    kept = langid.keep_known(docs(spark, data), langid.train(docs(spark, data)))
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == docs(spark, data).columns
