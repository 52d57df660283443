"""Token blocks: exact round trips, also of every block by itself."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import token_blocks as tb

TEXTS = ["Hello world", "", None, " a  b\n\tc ", "don't ñ 你好🌍 <|endoftext|>", "x" * 3000, "word " * 60_000, "\x00"]


def test_round_trip(spark):
    df = spark.createDataFrame([*[(i, t, 1) for i, t in enumerate(TEXTS)], (None, "null id", 1), (0, "Hello world", 1)], "doc_id long, text string, data int")
    rows = tb.encode(df).collect()
    assert len(rows) == len(TEXTS) + 2
    enc = tb.encoding()
    for r in rows:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id]
        if text is None:
            assert r.n_tokens is None and r.starts is None and r.data is None
            continue
        want = enc.encode_ordinary(text)
        assert tb.decode(bytes(r.data), r.starts) == want and r.n_tokens == len(want) and enc.decode(want) == text
        assert len(r.starts) == -(-len(want) // tb.BLOCK)
        for k, start in enumerate(r.starts):
            assert tb.decode_block(bytes(r.data), start).tolist() == want[k * tb.BLOCK : (k + 1) * tb.BLOCK]
    assert {(r.doc_id, r.text) for r in tb.decoded(tb.encode(df)).collect()} == {(r.doc_id, r.text) for r in df.collect()}
    assert tb.encode(spark.createDataFrame([], df.schema)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "\n", "\u00a0", "\x1c", "\u3000", "a", "!", "7", " a", "'s", "é"]), st.integers(1, 12)), max_size=12))
def test_cut_runs_give_the_ids_of_the_uncut_text(parts):
    text = "".join(c * n for c, n in parts)
    enc, before = tb.encoding(), (tb._RUN, tb._long_runs)
    try:
        tb._RUN, tb._long_runs = 0, re.compile(f"(?<![{tb._SPACE}])[{tb._SPACE}]{{2,}}").finditer
        assert tb.text_ids(enc, text).tolist() == enc.encode_ordinary(text)
    finally:
        tb._RUN, tb._long_runs = before


def test_runs_of_a_million(spark):
    enc = tb.encoding()
    texts = [f"a{c * 1_000_000}{end}" for c in (" ", "\n", "x", "!", "\u2003", "7") for end in ("b", "", "\nb")]
    texts.append("a" + " " * 5000 + "b" + "\n" * 5000 + " c" + "\t" * 2000)
    rows = tb.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        ids = tb.decode(bytes(r.data), r.starts)
        assert len(ids) == r.n_tokens and enc.decode(ids) == texts[r.doc_id]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300), min_size=1, max_size=6), st.sampled_from([0.01, 0.5, 0.9, 1.0]))
def test_blocks(docs, percentile):
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    out, starts, first = tb.encode_blocks(offsets, np.array([x for d in docs for x in d], np.uint32), percentile)
    data = out.tobytes()
    assert [tb.decode(data, starts[a:b].tolist()) for a, b in zip(first, first[1:])] == docs


def test_outliers_are_exceptions():
    ids = np.array([5] * 120 + [50_000] * 8, np.uint32)
    out, _, _ = tb.encode_blocks(np.array([0, 128]), ids)
    assert out[4] == 0 and out[5] == 8 and len(out) == tb.HEAD + 8 * 5


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken"])
def test_other_vocabulary(spark, name):
    path = f"/opt/tokenizers/{name}"
    r = tb.encode(spark.createDataFrame([(1, "straße über")], "doc_id long, text string"), tokenizer=path).first()
    assert tb.encoding(path).decode(tb.decode(bytes(r.data), r.starts)) == "straße über"
