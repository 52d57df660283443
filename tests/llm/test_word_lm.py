"""The word model against interpolated Kneser-Ney in plain Python."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import common as c
from folio.llm import queries, word_lm
from folio.llm.elias_fano import Sequence, encode

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "ñandú über  straße", "a a a a", "a", "", None, " ", "the the the cat sat"]


class Brute:
    def __init__(self, texts, order):
        self.order = order
        top = Counter()
        for t in texts:
            w = [None] * (order - 1) + t.split()
            top.update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
        self.count = {order - 1: top}
        for k in range(order - 2, -1, -1):
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])

    def p(self, gram, k):
        if k < 0:
            return 1 / (len(self.count[0]) + 1)
        gram = gram[len(gram) - k - 1 :]
        same = [v for g, v in self.count[k].items() if g[:-1] == gram[:-1]]
        low = self.p(gram, k - 1)
        if not same:
            return low
        return max(self.count[k][gram] - 0.75, 0) / sum(same) + 0.75 * len(same) / sum(same) * low

    def bits(self, t):
        w = [None] * (self.order - 1) + t.split()
        return -sum(math.log2(self.p(tuple(w[i - self.order + 1 : i + 1]), self.order - 1)) for i in range(self.order - 1, len(w))) / len(t.split())


@pytest.mark.parametrize("order", [2, 3, 5])
def test_against_plain_python(spark, order):
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = word_lm.train(corpus, order)
    brute = Brute([t for t in TEXTS if t], order)
    rows = [*enumerate(TEXTS), (100, "the bat sat"), (101, "never seen"), (None, "the mat sat on the cat"), (1, "the dog")]
    got = sorted(word_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect(), key=repr)
    want = sorted(((i, None if t is None else len(t.split()), brute.bits(t) if t and t.split() else None) for i, t in rows), key=lambda r: repr(r[:2]))
    got = sorted(got, key=lambda r: repr(tuple(r)[:2]))
    assert [tuple(r)[:2] for r in got] == [r[:2] for r in want]
    assert all((g[2] is None) == (w[2] is None) and (w[2] is None or abs(g[2] - w[2]) < 0.05) for g, w in zip(got, want))


@pytest.mark.parametrize("order", [3, 5])
def test_hot_words_are_dealt_to_several_shards(spark, monkeypatch, order):
    monkeypatch.setattr(word_lm, "_HOT", 0.2)
    rng = np.random.default_rng(order)
    texts = [" ".join("the" if rng.random() < 0.4 else f"w{int(k)}" for k in rng.zipf(1.4, 40) % 60) for _ in range(50)] + ["the the the the the", "", None]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, brute = word_lm.train(corpus, order), Brute([t for t in texts if t], order)
    assert len(model.deal.hot) > 1 and model.deal.splits.max() > 2
    other = [(100, "the w1 the w2 unknown the"), (101, "w3 w3 the the w9")]
    want = {i: brute.bits(t) for i, t in [*enumerate(texts), *other] if t and i % 10 < 2}
    for got in (word_lm.scored(corpus, order), word_lm.score(corpus.union(spark.createDataFrame(other, corpus.schema)), model)):
        rows = {r.doc_id: r.bits_per_word for r in got.collect()}
        assert all(abs(rows[i] - b) < 0.05 for i, b in want.items() if i in rows) and len(rows) in (53, 55)


@pytest.mark.parametrize("hot", [0.2, 4.0])
def test_long_words_are_dealt_to_several_files(spark, monkeypatch, hot):
    monkeypatch.setattr(word_lm, "_HOT", hot)
    monkeypatch.setattr(word_lm, "_LONG", 40)
    rng = np.random.default_rng(4)
    texts = [" ".join("the" if rng.random() < 0.4 else f"w{int(k)}" for k in rng.zipf(1.4, 40) % 60) for _ in range(50)] + ["the the the the the", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, brute = word_lm._begun(docs, 5, long=True), Brute([t for t in texts if t], 5)
    assert len(model.deal.long) > 1 and model.deal.pieces.max() > 2
    rows = {r.doc_id: r.bits_per_word for r in word_lm.scored(docs, 5).collect()}
    assert len(rows) == len(texts) and all(abs(rows[i] - brute.bits(t)) < 0.05 for i, t in enumerate(texts) if t and i % 10 < 2)
    # the same n-grams as a task has them: a file takes a part of those of one word only
    ids = rng.integers(1, 9, (4000, 5))
    ids[:3000, 1] = 3
    columns = [x.astype(np.uint32) for x in ids.T]
    columns[2] = rng.integers(1, 500, 4000).astype(np.uint32)
    deal = word_lm.Deal(1, np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([3]), np.array([10]))
    files = list(word_lm._parts(columns, deal))
    assert sorted(np.concatenate([rows for _, rows, _ in files])) == list(range(4000)) and len({name for name, _, _ in files}) == len(files)
    assert max((some[1] == 3).sum() for _, _, some in files) < 1000


def test_query_knows_the_order_of_words(spark, tmp_path):
    words = [f"{i % 40:04d}-a-long-word" for i in range(400)]
    shuffled = [words[i] for i in np.random.default_rng(2).permutation(400)]
    spark.createDataFrame([(i, " ".join(words)) for i in range(5)] + [(9, " ".join(shuffled))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op1_ngram_lm(spark, str(tmp_path)).collect()}
    assert got[9].bits_per_word > 10 * got[0].bits_per_word


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = word_lm.train(empty)
    assert word_lm.score(empty, model).count() == 0 and word_lm.scored(empty).count() == 0
    assert word_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first().n_words == 2
    with pytest.raises(ValueError):
        word_lm.train(empty, 6)


@pytest.mark.parametrize("order", [2, 5])
def test_a_corpus_by_its_own_model(spark, order):
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, n) % 5000) for n in rng.integers(0, 120, 40)]
    texts += [texts[3], None, "", "x " * 3000, "\u00a0".join("abc"), "the the the"]
    docs = spark.createDataFrame([(i, t, 1, b"") for i, t in enumerate(texts)] + [(None, "a b c", 1, b"")], "doc_id long, text string, shard int, rows binary").repartition(3)
    tries = lambda: {str(p) for p in Path(word_lm.c.local_path(word_lm.c.shared_dir(spark))).rglob("*.trie")}
    before = tries()
    one = {repr(r.doc_id): r for r in word_lm.scored(docs, order).collect()}
    assert tries() == before
    two = {repr(r.doc_id): r for r in word_lm.score(docs, word_lm.train(docs, order)).collect()}
    assert len(one) == len(two) == len(texts) + 1
    for k, r in one.items():
        assert r.n_words == two[k].n_words and (r.bits_per_word is None) == (two[k].bits_per_word is None)
        assert r.bits_per_word is None or abs(r.bits_per_word - two[k].bits_per_word) < 1e-6
    brute = Brute([t for t in texts if t] + ["a b c"], order)
    for k in range(0, 40, 13):
        if one[repr(k)].n_words:
            assert abs(one[repr(k)].bits_per_word - brute.bits(texts[k])) < 0.05


def test_rows_of_the_exchanges_grow_no_faster_than_the_input(spark):
    # neither a row for each batch and shard nor one for each document and shard
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(k)}" for k in rng.integers(0, 300, 40)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = {x.jobId() for x in _all(store.jobsList(None))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert len(word_lm.scored(docs, 3).collect()) == 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for x in _all(store.jobsList(None)) if x.jobId() not in jobs for s in _all(x.stageIds())}
    assert stages and 0 < sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 100


def _all(seq):
    return [seq.apply(k) for k in range(seq.size())]


def test_distinct_of_few_and_of_many_ids():
    rng = np.random.default_rng(8)
    for size in (9, 1 << 13, 1 << 21, (1 << 32) - 1):
        some = np.sort(rng.integers(0, size, 6))
        columns = [some[rng.integers(0, 6, 5000)].astype(np.uint32) for _ in range(5)]
        got, n, inverse = word_lm._distinct(columns, size)
        want, count = np.unique(np.stack([*columns[1:], columns[0]], axis=1), axis=0, return_counts=True)
        assert (np.stack([*got[1:], got[0]], axis=1) == want).all() and (n == count).all()
        assert all((x[inverse] == y).all() for x, y in zip(got, columns))


def test_slices_go_over_batches_and_grow_with_the_shards():
    assert c.slice_bytes(10) == c.SLICE_BYTES < c.slice_bytes(500) < c.slice_bytes(5000) == c.slice_bytes(50_000) == c.MOST_SLICE_BYTES
    texts = ["", None, "ab", "c" * 30, "d" * 5000, "e", *["f" * 10] * 300]
    batches = [pa.RecordBatch.from_pydict({"k": [i], "text": pa.array([t], pa.string())}) for i, t in enumerate(texts)]
    got = list(c.gathered(iter(batches), 1000))
    assert [k for b in got for k in b.column("k").to_pylist()] == list(range(len(texts))) and len(got) < 20
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    words = pa.array(["", "a", "ñandú", "über", "a"], pa.large_string())
    for some in (words, words[1:4], words[:0], words[:1]):
        assert (c.hash_strings(some) == c.hash_words(some.to_pylist())).all()


def test_probabilities_sum_to_one(spark):
    texts = [t for t in TEXTS if t and t.strip()]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = word_lm.train(corpus, 3)
    words = sorted({w for t in texts for w in t.split()}) + ["never-seen"]
    contexts = ["the cat", "sat on the", "a", "unknown words", "the"]
    rows = [(i, c) for i, c in enumerate(contexts)] + [(1000 * (i + 1) + k, f"{c} {w}") for i, c in enumerate(contexts) for k, w in enumerate(words)]
    bits = {r.doc_id: r.n_words * r.bits_per_word for r in word_lm.score(spark.createDataFrame(rows, corpus.schema), model).collect()}
    for i in range(len(contexts)):
        assert abs(sum(2 ** (bits[i] - bits[1000 * (i + 1) + k]) for k in range(len(words))) - 1) < 0.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=200), st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200), st.integers(0, 2**40)), max_size=20))
def test_elias_fano(values, searches):
    v = np.sort(np.array(values, np.uint64))
    s = Sequence(*encode(v))
    assert (s.get(np.arange(len(v))) == v).all() and (s.all() == v).all()
    if searches:
        a, b, t = (np.array(x) for x in zip(*searches))
        a, b = np.minimum(a, len(v)), np.minimum(b, len(v))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        want = [x + np.searchsorted(v[x:y], np.uint64(z)) for x, y, z in zip(lo, hi, t)]
        assert s.successor(lo, hi, t.astype(np.uint64)).tolist() == want
