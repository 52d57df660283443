"""The pipeline: each stage on its own input, against brute force, and the whole."""

import random
from collections import Counter

import corpus_pipeline as cp
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, labels = [], []
    passage = [word() for _ in range(60)]
    for i in range(260):
        text = [word() for _ in range(rng.randint(30, 90))]
        bad = i % 5 == 0
        if bad:
            text[3:3] = ["scum", "moron"]
        if i in (201, 202, 203):
            text[10:10] = passage
        rows.append([i, text, "en", f"s{min(i % 9, 3)}"])
        labels.append((i, int(bad)))
    for i, of in ((300, 251), (301, 251), (302, 256)):
        copy = list(rows[of][1])
        copy[7] = "changed"
        rows.append([i, copy, "en", "s0"])
    rows = [(i, " ".join(t), la, s, len(" ".join(t))) for i, t, la, s in rows]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in labels if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}, dict(labels)


def test_stages(spark, folder):
    path, rows, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(cp.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "repeats", "mix", "packing"]
    clean = stage["toxicity"](spark, docs, path)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i in rows if not toxic.get(i)}
    single = stage["near_duplicates"](spark, clean, path)
    assert {r.doc_id for r in clean.collect()} - {r.doc_id for r in single.collect()} == {300, 301, 302} - ({302} if toxic[256] else set())
    cut = {r.doc_id: r for r in stage["repeats"](spark, single, path).collect()}
    changed = {i for i, r in cut.items() if r.text != rows[i][1]}
    assert changed == {202, 203} - {i for i in (201, 202, 203) if toxic[i]}
    assert all(cut[i].n_chars == len(cut[i].text) and len(cut[i].text.split()) == len(rows[i][1].split()) - 60 for i in changed)
    mixed = stage["mix"](spark, single, path)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in single.collect()}
    n, m = Counter(r.source for r in single.collect()), Counter(r.source for r in mixed.collect())
    assert all(abs(m[s] - n[s] * (n[s] / max(n.values())) ** -0.3) < 1 for s in n)
    fill = Counter()
    for r in stage["packing"](spark, mixed, path).collect():
        fill[r.bin_id] += r.n_words
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(len(r.text.split()) for r in mixed.collect())


def test_run(spark, folder):
    path, rows, toxic = folder
    out = cp.run(spark, path)
    assert out.columns == ["bin_id", "doc_id", "start_word", "n_words"]
    assert {r.doc_id for r in out.collect()} == {i for i in rows if not toxic.get(i) and i not in (300, 301, 302)} | ({302} if toxic[256] else set())


def test_registered():
    import __spark_entry__ as entry_point

    names = list(entry_point.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_stages_take_empty_tables(spark, folder):
    path = folder[0]
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_stages_agree_on_words(spark, folder):
    """Words joined by no-break spaces are words to dedup and to packing."""
    path = folder[0]
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, "\u00a0".join(passage + [f"a{i}" for i in range(90)])), (2, "\u00a0".join([f"b{i}" for i in range(70)] + passage + ["end"])), (3, "\u2003".join(f"c{i}" for i in range(200)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    stage = dict(cp.STAGES)
    cut = stage["repeats"](spark, docs, path)
    assert {r.doc_id: len(r.text.split()) for r in cut.collect()} == {1: 150, 2: 71, 3: 200}
    words = Counter()
    for r in stage["packing"](spark, cut, path).collect():
        words[r.doc_id] += r.n_words
    assert words == {1: 150, 2: 71, 3: 200}


def test_stages_take_odd_rows(spark, folder):
    path = folder[0]
    odd = [(None, None, None, None, None), (1, "", None, None, None), (2, None, "xx", "s", 4), (3, "w " * 40_000, "en", None, 80_000), (3, "w " * 40_000, "en", None, 80_000), (4, "plain", "en", "s", 5)]
    clashing = ["bands", "shard", "__doc", "__cuts", "__gone", "__row", "__source", "__copies", "__copy"]
    docs = spark.createDataFrame([(*r, *clashing) for r in odd], COLUMNS + "".join(f", {x} string" for x in clashing))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, path)
        ids = {r.doc_id for r in out.collect()}
        assert 4 in ids
        if name != "packing":
            assert out.columns == docs.columns and all([r[x] for x in clashing] == clashing for r in out.collect())
