import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import toxicity as tx
from tests.llm.data import docs, rows

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    rng = np.random.default_rng(3)
    plain = ["the", "and", "of", "river", "stone", "cloud", "walks", "green", "seven", "over"]
    out, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(5, 60)))
        bad = i % 4 == 0
        if bad:
            for w in rng.choice(["vilex", "grotish", "snarl"], 2):
                words.insert(rng.integers(0, len(words)), str(w))
        out.append((i, " ".join(words), "en" if i % 3 else "fr", "s", 0))
        labels.append((i, 1, int(bad)))
    return out, labels


def test_learns_and_holds_out(spark):
    data, labels = corpus()
    got = tx.classify(docs(spark, data), spark.createDataFrame(labels, LABELS)).collect()
    y = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out]
    assert len(got) == len(data) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_labels_of_the_held_out_third_change_nothing(spark):
    data, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (sorted(map(tuple, tx.classify(docs(spark, data), spark.createDataFrame(x, LABELS)).collect())) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(4, 1, 0), (5, 0, 0)], [(4, 1, 1), (4, 1, None), (9, 1, 1)]])
def test_awkward_rows_and_few_labels(spark, labels):
    data = rows()
    got = tx.classify(docs(spark, data), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    assert tx.classify(docs(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_batches_and_parts_equal_single_documents(monkeypatch):
    """Laying documents end to end, and joining the maxima of parts, gives what each document gives alone."""
    rng = np.random.default_rng(1)
    net = tx.Network(kernels=[rng.normal(size=(w, tx.DIM, tx.FILTERS)).astype(np.float32) for w in tx.WIDTHS])
    net.table[:-1] = rng.normal(size=(tx.ROWS, tx.DIM)).astype(np.float32)
    net.out = rng.normal(size=net.out.shape).astype(np.float32)
    some = [tx.word_ids(t) for t in ["", "one", "one two", "a b c d e", "x y " * 500, "!!", None]]

    def alone(ids):
        x = np.zeros((max(1, len(ids)) + 2, tx.DIM), np.float32)
        x[: len(ids)] = net.rows(ids)
        y = net.responses(x, max(1, len(ids)))
        return float(np.maximum(y.max(axis=0) + net.bias, 0) @ net.out + net.offset)

    want = [1 / (1 + np.exp(-np.clip(alone(d), -40, 40))) for d in some]
    assert np.allclose(net.scores(some), want, atol=1e-4)
    monkeypatch.setattr(tx, "BATCH_WORDS", 64)
    assert np.allclose(net.scores(some), want, atol=1e-4)


def test_gradients_equal_finite_differences(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(np, "float32", np.float64)  # differences need the precision
    net = tx.Network(table=np.zeros((tx.ROWS + 1, tx.DIM)), kernels=[rng.normal(size=(w, tx.DIM, tx.FILTERS)) for w in tx.WIDTHS], bias=rng.normal(size=24), out=rng.normal(size=24))
    net.table[:-1] = rng.normal(size=(tx.ROWS, tx.DIM))
    some = [tx.word_ids(t) for t in ["a b c d e f a b", "one", "", "x y z x", "b c one z"]]
    y, weight = np.array([1, 0, 1, 0, 1]), np.array([1.0, 2, 0.5, 1, 3])
    loss, grads, g_off, where, moved = tx.gradients(net, some, y, weight)
    at = lambda: tx.gradients(net, some, y, weight)[0]
    step = 1e-6

    def slope(p, i):
        was = p[i]
        p[i] = was + step
        up = at()
        p[i] = was - step
        down = at()
        p[i] = was
        return (up - down) / (2 * step)

    for p, g in zip([*net.kernels, net.bias, net.out], grads, strict=True):
        for _ in range(15):
            i = tuple(rng.integers(0, n) for n in p.shape)
            assert abs(slope(p, i) - g[i]) < 1e-5
    used = np.unique(np.concatenate([d.ravel() for d in some if len(d)]))
    by = dict(zip(where.tolist(), moved, strict=True))
    for r in used:
        d = int(rng.integers(0, tx.DIM))
        assert abs(slope(net.table, (r, d)) - by.get(int(r), np.zeros(tx.DIM))[d]) < 1e-5
    net.offset += step
    up = at()
    net.offset -= 2 * step
    assert abs((up - at()) / (2 * step) - g_off) < 1e-5


def test_columns_of_other_names(spark):
    data, labels = corpus(240)
    want = tx.classify(docs(spark, data, clash=False), spark.createDataFrame(labels, LABELS)).collect()
    other = docs(spark, data, clash=False).toDF("doc_id", "body", "tongue", "source", "n_chars").withColumns({"text": F.lit("vilex"), "lang": F.lit("xx")})
    got = tx.classify(other, spark.createDataFrame(labels, LABELS), text_col="body", lang_col="tongue").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_learns_from_long_texts_and_all_rows(spark, monkeypatch):
    """Toxic texts are all long; training sees every labelled row, in several shards, and agrees with itself."""
    data, labels = corpus(320)
    toxic = {i for i, _, t in labels if t}
    data = [(i, text + " stone river over the cloud" * 1300 if i in toxic else text, *rest) for i, text, *rest in data]
    assert min(len(r[1]) for r in data if r[0] in toxic) > 1 << 15
    monkeypatch.setattr(tx, "SHARD_ROWS", 64)
    monkeypatch.setattr(tx, "BATCH_WORDS", 4096)  # parts of a text
    trained, was = [], tx.fit
    monkeypatch.setattr(tx, "fit", lambda rows, *a, **k: (trained.append(rows.count()), was(rows, *a, **k))[1])
    marked = spark.createDataFrame(labels, LABELS)
    got, again = (sorted(map(tuple, tx.classify(docs(spark, data, clash=False), marked).collect())) for _ in range(2))
    assert got == again
    assert trained[0] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in labels)
    assert np.mean([predicted == (i in toxic) for i, held, _, predicted, _ in got if held]) > 0.95


def test_weights_travel_little(spark, monkeypatch):
    """Rows of several shards are read whole; all rates are tried for a few epochs, then one goes on; a shard sends its state once an epoch."""
    data, labels = corpus(320)
    monkeypatch.setattr(tx, "SHARD_ROWS", 64)
    rates, was = [], tx.one_epoch
    monkeypatch.setattr(tx, "one_epoch", lambda rows, state, *a: (rates.append((len(state), rows.select("shard").distinct().count())), was(rows, state, *a))[1])
    tx.train(docs(spark, data, clash=False), spark.createDataFrame(labels, LABELS))
    assert rates[0] == (3, 5) and len(rates) > tx.TRIAL + 1
    assert all(n == 1 for n, _ in rates[tx.TRIAL + 1 :])
