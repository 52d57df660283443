"""Repeated spans against a dictionary of all windows."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from folio.llm import block_anchors, repeats, suffix_family

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, width):
    """Each repeated window, with the least occurrence of its text."""
    first, again = {}, {}
    for doc, words in sorted({(d, tuple(t.split())) for d, t in rows if d is not None and t is not None}, key=lambda x: (x[0], len(x[1]))):
        for p in range(len(words) - width + 1):
            key, at = words[p : p + width], (doc, len(words), p)
            if first.setdefault(key, at) != at:
                again[at] = (first[key][0], first[key][2])
    return again


def windows(spans, width):
    return {(s.doc_id, s.n_words, s.start_word + k): (s.ref_doc_id, s.ref_start_word + k) for s in spans for k in range(s.length - width + 1)}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choices(words, k=rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = rng.choices(words, k=rng.choice([0, 1, 3, 9, 30, 200]))
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, len(s) // 2)
            at = rng.randint(0, len(text))
            text[at:at] = s[cut:]
        rows.append((rng.randint(-50, 10**12) if i % 7 else i, " ".join(text)))
    rows += [(rows[3][0], rows[3][1]), (10**13, rows[5][1]), (10**13 + 1, rows[5][1]), (None, rows[5][1]), (77, None), (78, ""), (79, " \n\t "), (80, "a " * 60)]
    return rows


@pytest.mark.parametrize("find", [suffix_family.repeated_spans, block_anchors.repeated_spans])
@pytest.mark.parametrize("width", [2, 7, 10])
def test_against_brute_force(spark, find, width):
    rows = corpus(width)
    spans = find(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert windows(spans, width) == brute(rows, width)
    assert all(s.length >= width for s in spans)


@pytest.mark.parametrize("find", [suffix_family.repeated_spans, block_anchors.repeated_spans])
@pytest.mark.parametrize("most", [1_000_000, 0])
def test_a_third_of_all_rows_are_copies(spark, monkeypatch, find, most):
    monkeypatch.setattr(repeats.c, "BROADCAST_ROWS", most)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([4, 12, 60]))) for _ in range(30)]
    copied = " ".join(texts[1].split()[:9] + texts[2].split() + texts[1].split()[:9] + ["x"] * 30)
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(rng.randint(0, 10**6), copied) for _ in range(20)] + [(50, texts[4]), (51, texts[4]), (7, "short text"), (8, "short text")]
    # one id with two texts, of which one is a copy
    rows += [(60, texts[5]), (60, "other " * 3 + texts[6])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, h int, first int")
    for width in (3, 8):
        assert windows(find(df, width).collect(), width) == brute(rows, width)


def test_planted_passage_of_51_words(spark):
    rng = random.Random(1)
    make = lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    passage = make(51)
    texts = [make(20) + passage + make(33), make(7) + passage, make(300), passage + make(5), make(40) + passage[:49] + make(40)]
    df = spark.createDataFrame([(i, "  ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {(1, 7, 51, 0, 20), (3, 0, 51, 0, 20)}
    for find in (suffix_family.repeated_spans, block_anchors.repeated_spans):
        assert {(s.doc_id, s.start_word, s.length, s.ref_doc_id, s.ref_start_word) for s in find(df, 50).collect()} == want


def test_family_levels_are_geometric():
    rng = np.random.default_rng(0)
    family, seen, want = suffix_family.Family(), {}, set()
    for n in range(1, 14):
        key, doc = rng.integers(0, 300, 40).astype(np.uint64), rng.integers(0, 50, 40)
        size, pos = np.full(40, 9, np.uint32), rng.integers(0, 1000, 40).astype(np.uint32)
        family.add(key, doc, size, pos)
        assert [r for r, _ in family.levels] == sorted({b for b in range(5) if n >> b & 1}, reverse=True)
        for k, d, p in zip(key.tolist(), doc.tolist(), pos.tolist()):
            seen.setdefault(k, set()).add((d, p))
    for k, at in seen.items():
        want |= {(*x, *min(at)) for x in at if x != min(at)}
    doc, _, pos, ref, shift = family.found()
    assert {(int(a), int(b), int(r), int(b + s)) for a, b, r, s in zip(doc, pos, ref, shift)} == want


def test_batches_added_in_several_calls(spark, tmp_path):
    rows = corpus(5)
    random.Random(2).shuffle(rows)
    folder, width = str(tmp_path / "family"), 7
    index = suffix_family.Index(spark, folder, width, shards=3)
    assert index.spans().count() == 0
    for n, at in enumerate(range(0, len(rows), 15), 1):
        index.add(spark.createDataFrame(rows[at : at + 15], "doc_id long, text string"))
        if n in (2, 3):
            assert windows(index.spans().collect(), width) == brute(rows[: at + 15], width)
            index = suffix_family.Index.open(spark, folder)
        ranks = [r.rank for r in spark.read.parquet(index._at(index.version)).where("kind = 0 AND shard = 0").collect()]
        assert sorted(ranks) == [b for b in range(5) if n >> b & 1]
    assert windows(index.spans().collect(), width) == brute(rows, width)
    index.add(spark.createDataFrame([], "doc_id long, text string"))
    index.add(spark.createDataFrame(rows[:20], "doc_id long, text string"))  # known already
    assert windows(index.spans().collect(), width) == brute(rows, width)
    with pytest.raises(ValueError):
        suffix_family.Index(spark, folder, 1)


def test_cutting(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, f"one two\n{passage} three.", "en", "s", 0), (2, f"four {passage}\nfive", "en", "s", 0), (3, passage, None, None, None), (4, None, "en", "s", 3), (None, passage, "en", "s", 3), (5, "", "en", "s", 0), (6, "clean text", "en", "s", 77)]
    df = spark.createDataFrame([(*r, 9) for r in rows], DOCS + ", length long")  # a column named like one of ours
    out = suffix_family.without_repeats(df, 10)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=repr)
    want = [(1, f"one two\n{passage} three.", "en", "s", 0, 9), (2, "four five", "en", "s", 9, 9), (4, None, "en", "s", 3, 9), (None, passage, "en", "s", 3, 9), (5, "", "en", "s", 0, 9), (6, "clean text", "en", "s", 77, 9)]
    assert got == sorted(want, key=repr)
    assert suffix_family.repeated_spans(out.where("doc_id IS NOT NULL"), 10).count() == 0


def test_without():
    assert repeats.without("a b  c d", [{"__words": 4, "__cut": [{"start_word": 1, "length": 2}]}]) == "a d"
    assert repeats.without("a b", [{"__words": 3, "__cut": [{"start_word": 0, "length": 2}]}]) is None
    assert repeats.without("a b", [{"__words": 2, "__cut": [{"start_word": 0, "length": 2}]}]) == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert suffix_family.repeated_spans(df).count() == 0 and block_anchors.repeated_spans(df).count() == 0
    assert suffix_family.without_repeats(df).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"{i % 700}x{i * i % 9973}" for i in range(120_000))
    df = spark.createDataFrame([(1, text), (2, "zz " + text)], "doc_id long, text string")
    a, b = (sorted(map(tuple, f(df, 50).collect())) for f in (suffix_family.repeated_spans, block_anchors.repeated_spans))
    assert a == b and sum(s[3] for s in a if s[0] == 2) >= 119_000


_HELD = """
import re
import numpy as np, pyarrow as pa
from folio.llm import common, repeats

class Rows:
    def mapInArrow(self, run, schema):
        return run

def anon():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

repeats.searched = lambda docs: docs
run = repeats.windows(Rows(), 50, lambda words: repeats.fingerprints(words, 50), 51)
rng = np.random.default_rng(3)
texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, 1000)) for _ in range(2600)]
batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": texts})
del texts
common.trim()
before = anon()
windows = sum(len(repeats.unpack_windows(x)[0]) for out in run([batch]) for x in out.column("rows").to_pylist())
assert windows == 2600 * 951, windows
print(anon() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_a_worker_gives_back_what_a_task_took():
    run = subprocess.run([sys.executable, "-c", _HELD], capture_output=True, text=True, timeout=120)
    assert not run.returncode, run.stderr
    assert float(run.stdout) < 40
