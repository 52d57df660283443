"""Packing: every word lies in one bin, no bin overflows, large pieces pair, waste is small."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import best_fit as bf
from folio.llm import common as c


def slow(sizes, capacity):
    """The same rule without bitsets: the fill of each bin, sorted."""
    large = sorted((s for s in sizes if 3 * s > capacity), reverse=True)
    bins = []
    while large:
        first = large.pop(0)
        mate = next((s for s in large if s <= capacity - first), None)
        if mate is not None:
            large.remove(mate)
        bins.append(first + (mate or 0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fits = [i for i, b in enumerate(bins) if b + s <= capacity]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += s
        else:
            bins.append(s)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_same_bins_as_brute_force(case):
    capacity, sizes = case
    bins = bf.pack(np.array(sizes, np.int64), capacity)
    fill = Counter()
    large = Counter()
    for b, s in zip(bins.tolist(), sizes):
        fill[b] += s
        large[b] += 3 * s > capacity
    assert sorted(fill.values()) == slow(sizes, capacity)
    assert not fill or (max(fill.values()) <= capacity and max(large.values()) <= 2)


def test_pieces_cover_every_word(spark):
    rng = np.random.default_rng(2)
    texts = {i: " ".join(["w"] * int(n)) for i, n in enumerate(rng.integers(1, 400, 120))}
    texts |= {1000: "w " * 5003, 1001: "", 1002: None, 1003: " \n ", 1004: "w " * 200, 1005: "\tw\n\nw "}
    rows = [(i, t, 1) for i, t in texts.items()] + [(None, "w w w", 1), (3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    out = bf.packed(df, 100).collect()
    fill, words = Counter(), defaultdict(list)
    for r in out:
        fill[r.bin_id] += r.n_words
        words[r.doc_id] += range(r.start_word, r.start_word + r.n_words)
    assert max(fill.values()) <= 100
    for i, t, _ in rows:
        n = len(t.split()) if t else 0
        assert sorted(words[i]) == sorted(list(range(n)) * (2 if i == 3 else 1))
    assert sum(fill.values()) / (100 * len(fill)) > 0.9


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from(["a", "b", " ", "\n", "\u00a0", "\x1c", "\u2003", "\u200b"]), max_size=12), max_size=6))
def test_counts_the_words_that_all_operators_count(texts):
    column = pa.array(texts, pa.string())
    offsets, _, _ = c.word_codes(column)
    assert c.word_counts(column).tolist() == np.diff(offsets).tolist() == [len((t or "").split()) for t in texts]


def test_words_joined_by_other_white_space(spark):
    df = spark.createDataFrame([(1, "\u00a0".join(["w"] * 200)), (2, "\u2003".join(["w"] * 70))], "doc_id long, text string")
    out = bf.packed(df, 100).collect()
    assert sum(r.n_words for r in out) == 270 and max(r.n_words for r in out) == 100


def test_edges(spark):
    assert bf.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        bf.packed(spark.createDataFrame([], "doc_id long, text string"), 0)
