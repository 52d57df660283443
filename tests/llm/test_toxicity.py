"""The classifier: held-out accuracy, gradients, thresholds, edges."""

import random

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import toxicity as tx

DOCS = "doc_id long, text string, lang string, source string, toxic int"


def made(n=1500, seed=0):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "in", "ea", "ti", "st", "wh", "ed"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = [word() for _ in range(rng.randint(8, 150))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["Idiot!", "scum", "moron,"]) if lang == "en" else "lowei" + word())
        rows.append((i, " ".join(text), lang, "s", 5))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = made()
    df = spark.createDataFrame(rows, DOCS)
    net = tx.train(df, spark.createDataFrame(labels[:1200] + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int"))
    return df, dict(labels), net


def test_held_out_accuracy(trained):
    df, truth, net = trained
    said = {r.doc_id: r.toxic for r in tx.score(df, net).collect() if r.doc_id >= 1200}
    right = sum(said[i] == bool(truth[i]) for i in said)
    assert len(said) == 300 and right / 300 > 0.95
    assert set(net.thresholds) >= {None, "en", "de"}


def test_rejected_documents_go(trained):
    df, _, net = trained
    said = {r.doc_id for r in tx.score(df, net).collect() if not r.toxic}
    kept = tx.clean(df, net)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == said


def test_edges(spark, trained):
    net = trained[2]
    rows = [(1, None, "en", None, 1), (2, "", "en", None, 1), (None, "scum moron idiot", "xx", None, 1), (3, "?! --", None, None, 1), (4, "an er " * 60_000 + "scum moron idiot", "en", None, 1), (4, "an er", "en", None, 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = tx.score(df, net).collect()
    assert len(got) == 6 and [r.toxicity is None for r in got] == [True, False, False, False, False, False]
    assert [r.toxic for r in got] == [False, False, True, False, True, False]
    assert tx.clean(df, net).count() == 4
    assert tx.score(spark.createDataFrame([], DOCS), net).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    df = spark.createDataFrame(made(5)[0], DOCS)
    for labels in ([], [(1, 0), (2, 0)], [(999, 1)]):
        net = tx.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not any(r.toxic for r in tx.score(df, net).collect())
    assert not tx.train(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int")).table.any()


def test_pooling_is_over_the_whole_text():
    net = tx.fit(["bad word here", "good word here", "bad thing now", "good thing now"] * 20, np.array([1, 0, 1, 0] * 20))
    z = tx.predict(net, pa.array(["good", "word " * 30_000 + "bad", "word " * 30_000]))
    assert z[1] > 0 > z[0] and z[2] < z[1] - 1


def test_neighbours_in_a_batch_play_no_part(trained):
    net = trained[2]
    texts = ["an er", "", "?! --", "scum moron idiot", "er", "", "Idiot! an", "an " * 500]
    alone = [tx.predict(net, pa.array([t]))[0] for t in texts]
    assert np.allclose(tx.predict(net, pa.array(texts)), alone, atol=1e-4)
    assert np.allclose(tx.predict(net, pa.array(texts[::-1]))[::-1], alone, atol=1e-4)


def test_thresholds():
    assert 1 < tx.calibrated(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1]), np.ones(4)) < 2
    assert tx.calibrated(np.array([1.0, 1.0]), np.array([0, 1]), np.ones(2)) < 1


def small(seed=0):
    """A random net over a few words, in double precision."""
    rng = np.random.default_rng(seed)
    net = tx.Net(np.zeros((1, tx.DIMS)), [rng.normal(size=(w, tx.DIMS, tx.FILTERS)) for w in tx.WIDTHS], rng.normal(size=tx.FILTERS * len(tx.WIDTHS)), rng.normal(size=tx.FILTERS * len(tx.WIDTHS)), 0.3, {None: 0.0})
    embedded = np.vstack([rng.normal(size=(9, tx.DIMS)), np.zeros((1, tx.DIMS))])
    lengths = np.array([4, 1, 0, 7, 2])
    codes = rng.integers(0, 9, lengths.sum())
    return net, embedded, np.concatenate([[0], np.cumsum(lengths)]), codes


def slow(net, embedded, words):
    """The logit of one document, window by window."""
    hidden = []
    for width, f in zip(tx.WIDTHS, net.filters):
        rows = [embedded[w] for w in words] + [np.zeros(tx.DIMS)] * max(tx.WIDTHS)
        responses = [[sum(float(rows[i + j] @ f[j, :, k]) for j in range(width)) for k in range(tx.FILTERS)] for i in range(len(words) + 1)]
        hidden += [max(r[k] for r in responses) for k in range(tx.FILTERS)]
    return sum(max(0.0, h + b) * o for h, b, o in zip(hidden, net.bias, net.out)) + net.offset


def test_forward_pass_against_loops():
    net, embedded, offsets, codes = small()
    got = net.logits(offsets, codes, embedded[:-1])
    want = [slow(net, embedded, codes[a:b]) for a, b in zip(offsets, offsets[1:])]
    assert np.allclose(got, want)


def test_gradients_against_differences():
    net, embedded, offsets, codes = small(3)
    y, weight = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 0.5, 1, 1])
    starts, ends, padded = tx.pad(offsets, codes, len(embedded) - 1)
    padded = np.append(padded, np.full(tx._PAD, len(embedded) - 1))

    def loss():
        z = np.array([slow(net, embedded, codes[a:b]) for a, b in zip(offsets, offsets[1:])])
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / len(y))

    g = tx.gradients(net, embedded, starts, ends, padded, y, weight)
    for value, grad in [*zip(net.filters, g.filters), (net.bias, g.bias), (net.out, g.out), (embedded[:-1], g.words[:-1])]:
        for at in [tuple(i) for i in np.random.default_rng(1).integers(0, value.shape, (12, value.ndim))]:
            held = value[at]
            value[at] = held + 1e-6
            up = loss()
            value[at] = held - 1e-6
            down = loss()
            value[at] = held
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-5
    net.offset += 1e-6
    up = loss()
    net.offset -= 2e-6
    assert abs((up - loss()) / 2e-6 - g.offset) < 1e-5


def test_thresholds_are_drawn_to_the_common_one(spark, trained):
    df, truth, _ = trained
    labels = spark.createDataFrame([(i, t) for i, t in truth.items() if i < 1200], "doc_id long, toxic int")
    own, common = tx.train(df, labels, prior=0), tx.train(df, labels, prior=1e12)
    assert common.thresholds["de"] == pytest.approx(common.thresholds[None]) and own.thresholds["de"] != own.thresholds[None]
    between = tx.train(df, labels).thresholds
    assert min(own.thresholds["de"], own.thresholds[None]) <= between["de"] <= max(own.thresholds["de"], own.thresholds[None])


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows, labels = made(400, 3)
    rows.append((5000, "scum " * 50_000, "en", "s", 5))
    taken = []
    real = tx.fit
    monkeypatch.setattr(tx, "fit", lambda texts, *a, **k: taken.append(texts) or real(texts, *a, **k))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5000, 1)], "doc_id long, toxic int")
    tx.train(docs, known, class_bytes=6000)
    tx.train(docs, known, per_class=7)
    assert 10 < len(taken[0]) < 120 and sum(map(len, taken[0])) <= 4 * 6000 and max(map(len, taken[0])) < 6000
    assert len(taken[1]) <= 4 * 7


def test_all_labelled_documents_take_part(spark, monkeypatch):
    rows = [(i, f"word{i % 50} " + ("scum" if i % 40 == 0 else "fine"), "en", "s", 5) for i in range(3000)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 40 == 0)) for i in range(3000)], "doc_id long, toxic int")
    learnt, judged, real_fit, real_calibrated = [], [], tx.fit, tx.calibrated
    monkeypatch.setattr(tx, "fit", lambda texts, *a, **k: learnt.append(len(texts)) or real_fit(texts, *a, **k))
    monkeypatch.setattr(tx, "calibrated", lambda z, y, w: judged.append((len(z), set(w))) or real_calibrated(z, y, w))
    tx.train(docs, known)
    assert learnt[0] + judged[0][0] == 3000 and judged[0][1] == {1.0}

    # the same split where tasks train, in every round
    real_average = tx._average
    monkeypatch.setattr(tx, "_average", lambda net, spent, done: learnt.append(sum(r.docs for r in done.collect() if r.rest is not None)) or real_average(net, spent, done))
    tx.train(docs, known, at_once=0, chain_bytes=8000)
    assert learnt[1:] == learnt[:1] * 8 and judged[2] == judged[0]


def test_tasks_train_as_the_driver_does(spark, trained):
    df, truth, _ = trained
    labels = spark.createDataFrame([(i, t) for i, t in truth.items() if i < 1200], "doc_id long, toxic int")
    net = tx.train(df, labels, at_once=0, chain_bytes=100_000)
    said = {r.doc_id: r.toxic for r in tx.score(df, net).collect() if r.doc_id >= 1200}
    assert sum(said[i] == bool(truth[i]) for i in said) / 300 > 0.95


def test_an_embedding_is_averaged_over_the_tasks_that_moved_it(spark):
    net, spent = tx.blank(np.random.default_rng(1))
    rows = []
    for docs, moved in ((10, [3]), (30, [3, 70_000])):
        other, used = tx.blank(np.random.default_rng(1))
        other.table[moved], used[0][moved], other.offset = docs, 2.0, float(docs)
        rows += [r for b in tx._changes(net, spent, other, used, docs) for r in b.to_pylist()]
    tx._average(net, spent, spark.createDataFrame(rows, tx._CHANGES))
    assert net.table[3, 0] == 20 and net.table[70_000, 0] == 30 and np.count_nonzero(net.table) == 2 * tx.DIMS
    assert spent[0][3, 0] == 2 and net.offset == 25
