"""Vector searches against full distance matrices."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folio.llm import pivot_index, voronoi_knn

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 1) for i, r in zip(ids if ids is not None else range(len(x)), x)], SCHEMA)


def brute(x, ids, k):
    out = {}
    x = x.astype(np.float32).astype(float)
    for i, q in zip(ids, x):
        d = sorted((round(float(np.sqrt(((q - v) ** 2).sum())), 9), int(j)) for j, v in zip(ids, x) if j != i)
        out[int(i)] = [(j, r + 1) for r, (_, j) in enumerate(d[:k])]
    return out


@pytest.mark.parametrize("shape", ["clusters", "noise", "line", "ties"])
def test_knn_is_exact(spark, shape):
    rng = np.random.default_rng(4)
    x = {
        "clusters": lambda: rng.normal(size=(12, 8)).repeat(40, axis=0) * 5 + rng.normal(size=(480, 8)) * 0.1,
        "noise": lambda: rng.normal(size=(300, 16)),
        "line": lambda: np.stack([np.arange(300.0) ** 1.5, np.zeros(300)], axis=1),
        "ties": lambda: rng.integers(0, 3, (250, 3)).astype(float),
    }[shape]()
    ids = rng.permutation(10_000)[: len(x)]
    got = {}
    for r in voronoi_knn.neighbours(table(spark, x, ids), k=7).collect():
        got.setdefault(r.query_id, []).append((r.neighbor_id, r["rank"]))
    assert {q: sorted(v, key=lambda p: p[1]) for q, v in got.items()} == brute(x, ids, 7)


@pytest.mark.parametrize("vectors, asking", [(40, 1 << 14), (1 << 16, 9), (25, 16)])
def test_knn_in_blocks(spark, monkeypatch, vectors, asking):
    monkeypatch.setattr(voronoi_knn, "BLOCK_VECTORS", vectors)
    monkeypatch.setattr(voronoi_knn, "BLOCK_QUERIES", asking)
    rng = np.random.default_rng(6)
    # a third of all lies in one place
    x = np.vstack([rng.normal(size=(100, 6)) * 0.01, rng.normal(size=(200, 6)), rng.integers(0, 2, (40, 6))]).astype(np.float32)
    ids = np.arange(len(x)) * 3 - 200
    got = {}
    for r in voronoi_knn.neighbours(table(spark, x, ids), k=6, every=4).collect():
        got.setdefault(r.query_id, []).append((r.neighbor_id, r["rank"]))
    want = {i: found for i, found in brute(x, ids, 6).items() if i % 4 == 0}
    assert {q: sorted(f, key=lambda p: p[1]) for q, f in got.items()} == want


def test_knn_sends_less_than_everything():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 4)).repeat(50, axis=0) * 50 + rng.normal(size=(1000, 4)) * 0.01
    centres = x[::50]
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(axis=2))
    cell = d.argmin(axis=1)
    between = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    radius = np.array([d[cell == i, i].max() for i in range(20)])
    least = [np.sort(d[cell == i, i])[:6] for i in range(20)]
    limit = voronoi_knn.bounds(between, radius, least, 5)
    assert (voronoi_knn.lower(d, cell, between, radius) <= limit[None]).mean() < 0.1


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (2, [1.0, 0.001], 0), (3, [0.0, 0.0], 0), (None, [1.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [1.0], 0), (7, [math.nan, 1.0], 0), (8, [math.inf, 1.0], 0), (9, [None, 1.0], 0), (10, [1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", id int, v int")
    assert {tuple(r) for r in pivot_index.near_duplicates(df).collect()} == {(1, 1, 2), (2, 1, 2), (10, 1, 2), (6, 6, 0)}
    knn = voronoi_knn.neighbours(df, k=10).collect()
    assert {(r.query_id, r.neighbor_id) for r in knn} == {(a, b) for a in (1, 2, 3, 10) for b in (1, 2, 3, 10) if a != b}
    assert [r.neighbor_id for r in sorted(knn, key=lambda r: r["rank"]) if r.query_id == 1] == [10, 2, 3]
    for n in (0, 1):
        small = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(n)], SCHEMA)
        assert voronoi_knn.neighbours(small).count() == 0 and [tuple(r) for r in pivot_index.near_duplicates(small).collect()] == [(0, 0, 0)] * n
    with pytest.raises(ValueError):
        voronoi_knn.neighbours(df, k=0)


def test_each_dimension_by_itself(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for dim, at in ((4, 0), (7, 1000), (2, 2000)):
        x = np.vstack([rng.normal(size=(40, dim)), np.ones((3, dim))]).astype(np.float32)
        rows += [(at + i, [float(f) for f in r], 1) for i, r in enumerate(x)]
        want |= {q: found for q, found in brute(x, np.arange(at, at + 43), 5).items() if q % 10 == 0}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in voronoi_knn.neighbours(df, k=5, every=10).collect():
        got.setdefault(r.query_id, []).append((r.neighbor_id, r["rank"]))
    assert {q: sorted(f, key=lambda p: p[1]) for q, f in got.items()} == want
    found = {r.vec_id: r for r in pivot_index.near_duplicates(df, 0.9999).collect()}
    assert len(found) == 129 and all(found[at + i].class_id == at + 40 and found[at + i].links >= 2 for at in (0, 1000, 2000) for i in (40, 41, 42) if at != 2000)


def classes(hit):
    """The least member of each row's component."""
    least = np.arange(len(hit))
    while True:
        new = np.array([least[h].min() if h.any() else m for h, m in zip(hit | np.eye(len(hit), dtype=bool), least)])
        if (new == least).all():
            return least
        least = new


@pytest.mark.parametrize("part", [4096, 40])
@pytest.mark.parametrize("noise", [0.02, 0.15, 0.28])
def test_near_duplicate_recall(spark, monkeypatch, noise, part):
    monkeypatch.setattr(pivot_index, "PART", part)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    x = np.vstack([base, base[:400] + rng.normal(size=(400, 64)) * noise, base[:3].repeat(30, axis=0)]).astype(np.float32)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    hit = np.round(unit @ unit.T, 6) >= 0.95
    np.fill_diagonal(hit, False)
    rows = {r.vec_id: r for r in pivot_index.near_duplicates(table(spark, x), 0.95).collect()}
    assert sorted(rows) == list(range(len(x)))
    links = np.array([rows[i].links for i in range(len(x))])
    want = hit.sum(axis=1)
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum() and want.sum() > 800
    found, true = np.array([rows[i].class_id for i in range(len(x))]), classes(hit)
    assert (true[found] == true).all() and (found == true).mean() > 0.95
    if (links == want).all():
        assert (found == true).all()


def test_near_duplicate_recall_in_a_dense_group(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    x = rng.normal(size=(20_000, 64))
    x[:2000] = centre + rng.normal(size=(2000, 64)) * 0.14
    x = x.astype(np.float32)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    want = (unit[:2000] @ unit[:2000].T >= 0.95).sum() - 2000
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "x.parquet")
    found = pivot_index.near_duplicates(spark.read.parquet(str(tmp_path / "x.parquet")), 0.95)
    row = found.selectExpr("count(*) AS n", "sum(links) AS links", "count_if(vec_id < 2000 AND class_id = 0) AS joined", "count_if(vec_id >= 2000 AND class_id = vec_id) AS alone").first()
    assert want > 3_800_000 and 0.9 * want <= row.links <= want + 200 and (row.n, row.joined, row.alone) == (20_000, 2000, 18_000)
