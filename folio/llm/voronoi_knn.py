"""Exact k nearest neighbours of queries by a Voronoi join.

Pivots cut the space into cells, and cells are put together in groups of about equal numbers of queries. From a
summary of each cell (its radius and its least distances to the pivot) follows a bound on how far the k-th neighbour
of any query in a cell can be. A vector is sent to a group only if it may lie within that bound of one of the
group's cells, by the cell's radius or by the plane between the two pivots. A group that may get many vectors, or has
many queries, is cut into blocks of either, which are solved by themselves; what they find is merged by query.

The pivots are MAX_PIVOTS at most, so what is broadcast has a size bound, whatever the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import common as c
from folio.llm import vectors as v

MAX_PIVOTS = 1024
#: Vectors, and queries, that one block holds.
BLOCK_VECTORS, BLOCK_QUERIES = 1 << 16, 1 << 14
_BLOCK = 1 << 21
_SLACK = 1e-6
_FOUND = "query_id long, neighbor_id long, rank int, distance double"
_OUT = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("rank", pa.int32()), ("distance", pa.float64())])


@dataclass
class Plan:
    """What every task knows of the cells: at most MAX_PIVOTS squared numbers."""

    centres: np.ndarray
    between: np.ndarray  # of pivots
    radius: np.ndarray  # of the queries in each cell; -inf where there are none
    limit: np.ndarray  # within which each query of a cell has k others
    group: np.ndarray  # of each cell; -1 where it has no queries
    blocks: np.ndarray  # for each group: of vectors
    parts: np.ndarray  # for each group: of queries
    first: np.ndarray  # the first task of each group


def bounds(between: np.ndarray, radius: np.ndarray, least: list[np.ndarray], k: int, near: int = 16) -> np.ndarray:
    """For each cell, a distance within which each of its queries has k others. between: of pivots; radius: of the
    queries; least: each cell's k + 1 least distances to its pivot. The vectors of the nearest cells that hold enough
    serve as witnesses."""
    out = np.full(len(radius), np.inf)
    for i in np.flatnonzero(np.isfinite(radius)):
        order = np.argsort(between[i], kind="stable")
        far = [between[i, j] + least[j] for j in order[:near]]
        take = near
        while sum(map(len, far)) <= k and take < len(order):
            far.append(between[i, order[take]] + least[order[take]])
            take += 1
        all_ = np.sort(np.concatenate(far)) if far else np.zeros(0)
        if len(all_) > k:  # one of the k + 1 is the vector itself
            out[i] = radius[i] + all_[k]
    return out


def lower(to_pivots: np.ndarray, own: np.ndarray, between: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How near each vector may be to any query of each cell: rows of vectors, columns of cells."""
    gap = to_pivots - radius[None]
    width = 2 * between[own]
    mine = np.take_along_axis(to_pivots, own[:, None], axis=1)
    plane = np.where(width > 0, (to_pivots**2 - mine**2) / np.where(width > 0, width, 1), 0)
    return np.maximum(np.maximum(gap, plane), 0)


def grouped(between: np.ndarray, sizes: np.ndarray, groups: int) -> np.ndarray:
    """A group for each cell of some size: neighbours together, groups of about equal size."""
    out = np.full(len(sizes), -1, np.int64)
    share = sizes.sum() / max(1, groups)
    left = sizes > 0
    for g in range(groups):
        if not left.any():
            break
        seed = int(np.flatnonzero(left)[0])
        filled = 0.0
        for j in np.argsort(np.where(left, between[seed], np.inf), kind="stable"):
            if not left[j] or (filled and filled + sizes[j] / 2 > share and g < groups - 1):
                break
            out[j], left[j] = g, False
            filled += sizes[j]
    return out


def planned(centres: np.ndarray, summary: list, k: int, tasks: int) -> Plan:
    """No more groups than the queries need, since each may get every vector; blocks enough to keep ``tasks`` busy."""
    m = len(centres)
    sizes, asks, reach = np.zeros(m), np.zeros(m), np.zeros(m)
    radius, least = np.full(m, -np.inf), [np.zeros(0)] * m
    for row in summary:
        i = row["cell"]
        sizes[i], reach[i], least[i], asks[i] = row["n"], row["radius"], np.array(row["least"], float), row["asks"]
        if row["asks"]:
            radius[i] = row["ask_radius"]
    between = v.distances(centres, centres) if m else np.zeros((0, 0))
    limit = bounds(between, radius, least, k)
    group = grouped(between, asks, max(1, math.ceil(asks.sum() / BLOCK_QUERIES)))
    n = int(group.max()) + 1 if m else 0
    blocks, parts = np.ones(n, np.int64), np.ones(n, np.int64)
    for g in range(n):
        mine = np.flatnonzero(group == g)
        may = (between[mine] - reach[None] - (radius[mine] + limit[mine])[:, None] <= _SLACK).any(axis=0)
        blocks[g] = max(1, math.ceil(sizes[may].sum() / BLOCK_VECTORS), tasks // n)
        parts[g] = max(1, math.ceil(asks[mine].sum() / BLOCK_QUERIES))
    return Plan(centres, between, radius, limit, group, blocks, parts, np.concatenate([[0], np.cumsum(blocks * parts)])[:-1])


def neighbours(embeddings: DataFrame, k: int = 10, every: int = 1, n_pivots: int | None = None) -> DataFrame:
    """The k nearest other vectors of each query, by Euclidean distance: query_id, neighbor_id, rank from 1, distance
    (6 places). Queries are the vectors whose vec_id is divisible by ``every``; all vectors answer.

    Equal distances rank by the lesser id, so ranks are definite. With fewer than k others all are given. Vectors of each
    dimension are searched among themselves. Null ids and vectors and vectors with null, infinite or NaN entries neither
    ask nor answer. Rows that repeat a vec_id are one vector, the least; a vector is never its own neighbour. Other columns
    are ignored; an empty table gives no rows.
    """
    if k < 1 or every < 1:
        raise ValueError("k and every must be at least 1")
    rows = c.keep(v.valid(embeddings), "knn-vectors")
    return v.by_dimension(rows, lambda some: _neighbours(some, k, every, n_pivots))


def _neighbours(rows: DataFrame, k: int, every: int, n_pivots: int | None) -> DataFrame:
    spark = rows.sparkSession
    shards = c.partitions(spark)
    n = rows.count()
    centres = v.pivots(rows, n_pivots or min(MAX_PIVOTS, max(4, math.ceil(math.sqrt(n)))))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            step = max(1, _BLOCK // max(1, len(p)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                d = v.distances(v.matrix(part.column("v")).astype(np.float64), p)
                cell = d.argmin(axis=1)
                ask = part.column("id").to_numpy() % every == 0
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array(ask)], names=["id", "v", "cell", "d", "ask"])

    cells = c.keep(rows.mapInArrow(assign, "id long, v array<float>, cell int, d double, ask boolean"), "knn-cells")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for batch in batches:
            cell, d, ask = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "d", "ask"))
            order = np.lexsort((d, cell))
            cuts = np.append(np.flatnonzero(np.diff(cell[order], prepend=-1)), len(order))
            for a, b in zip(cuts, cuts[1:]):
                at = order[a:b]
                asking = d[at][ask[at]]
                old = known.setdefault(int(cell[at[0]]), [0, 0.0, 0, 0.0, np.zeros(0)])
                old[0] += len(at)
                old[1] = max(old[1], float(d[at[-1]]))
                if len(asking):
                    old[2] += len(asking)
                    old[3] = max(old[3], float(asking[-1]))
                old[4] = np.sort(np.append(old[4], d[at[: k + 1]]))[: k + 1]
        if known:
            a, b, e, f, g = zip(*known.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.float64()), pa.array(e, pa.int64()), pa.array(f, pa.float64()), pa.array([x.tolist() for x in g], pa.list_(pa.float64()))], names=["cell", "n", "radius", "asks", "ask_radius", "least"])

    parts = cells.select("cell", "d", "ask").mapInArrow(summed, "cell int, n long, radius double, asks long, ask_radius double, least array<double>")
    for keys in (["cell", "salt"], ["cell"]):  # in two steps, so that no row grows with the number of tasks
        parts = parts.withColumn("salt", F.spark_partition_id() % 64) if "salt" in keys else parts
        parts = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("asks").alias("asks"), F.max("ask_radius").alias("ask_radius"), F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, k + 1).alias("least"))
    # MAX_PIVOTS rows of k + 1 numbers at most
    found = planned(centres, parts.collect(), k, shards)
    plan = spark.sparkContext.broadcast(found)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        live = np.flatnonzero(p.group >= 0)
        if not len(live):
            return
        by = live[np.argsort(p.group[live], kind="stable")]
        first = np.flatnonzero(np.diff(p.group[by], prepend=-1))
        names = p.group[by[first]]
        for batch in batches:
            step = max(1, _BLOCK // max(1, len(p.centres)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                own, ids = part.column("cell").to_numpy().astype(np.int64), part.column("id").to_numpy()
                spread = (c.mix(ids.view(c.U64)) >> c.U64(1)).astype(np.int64)
                d = v.distances(v.matrix(part.column("v")).astype(np.float64), p.centres)
                may = lower(d, own, p.between, p.radius)[:, by] <= p.limit[by][None] + _SLACK
                i, j = np.nonzero(np.logical_or.reduceat(may, first, axis=1))
                g = names[j]
                # vectors go to every part of the group's queries, queries to every block of its vectors
                of = np.repeat(np.arange(len(i)), p.parts[g])
                data, g = i[of], g[of]
                to = p.first[g] + c.ranges(p.parts[names[j]]) * p.blocks[g] + spread[data] % p.blocks[g]
                asking = np.flatnonzero(part.column("ask").to_numpy(zero_copy_only=False))
                h = p.group[own[asking]]
                ask = np.repeat(asking, p.blocks[h])
                h2 = p.group[own[ask]]
                to_ask = p.first[h2] + (spread[ask] % p.parts[h2]) * p.blocks[h2] + c.ranges(p.blocks[h])
                rows = pa.array(np.concatenate([data, ask]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([to, to_ask])), *(part.column(x).take(rows) for x in ("id", "v", "cell")), pa.array(np.arange(len(rows)) >= len(data))],
                    names=["task", "id", "v", "cell", "home"],
                )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for table in c.runs_of(batches, "task"):
            yield from _solved(p, table, k)

    sent = cells.mapInArrow(send, "task long, id long, v array<float>, cell int, home boolean")
    if int((found.blocks * found.parts).sum()) <= shards:
        sent = sent.repartitionById(shards, F.col("task").cast("int"))
    else:
        sent = sent.repartition(shards, "task").sortWithinPartitions("task")
    out = sent.mapInArrow(solve, _FOUND)
    if len(found.blocks) and found.blocks.max() > 1:
        best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
        out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.withColumn("distance", F.round("distance", 6))


def _solved(p: Plan, table: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    ids, cell = table.column("id").to_numpy(), table.column("cell").to_numpy().astype(np.int64)
    home = table.column("home").to_numpy()
    x = v.matrix(table.column("v").combine_chunks()).astype(np.float64)
    square = (x * x).sum(axis=1)
    answers = np.flatnonzero(~home)
    mine = np.sqrt(((x[answers] - p.centres[cell[answers]]) ** 2).sum(axis=1))
    for i in np.unique(cell[home]):
        queries = np.flatnonzero(home & (cell == i))
        to = v.distances(x[answers], p.centres[i : i + 1])[:, 0]
        width = 2 * p.between[cell[answers], i]
        plane = np.where(width > 0, (to**2 - mine**2) / np.where(width > 0, width, 1), 0)
        data = answers[np.maximum(to - p.radius[i], plane) <= p.limit[i] + _SLACK]
        step = max(1, _BLOCK // max(1, len(data)))
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            d2 = square[q][:, None] + square[data][None] - 2 * (x[q] @ x[data].T)
            d2[ids[q][:, None] == ids[data][None]] = np.inf
            some = min(k, len(data)) - 1
            if some < 0:
                continue
            kth = np.partition(d2, some, axis=1)[:, some]
            near = d2 <= (kth + 1e-9 * (1 + np.abs(kth)))[:, None]
            near &= np.isfinite(d2)
            r, s = np.nonzero(near)
            dist = np.sqrt(((x[q[r]] - x[data[s]]) ** 2).sum(axis=1))
            order = np.lexsort((ids[data[s]], dist, r))
            r, s, dist = r[order], s[order], dist[order]
            rank = c.ranges(np.bincount(r, minlength=len(q)))
            ok = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[r[ok]]]), pa.array(ids[data[s[ok]]]), pa.array((rank[ok] + 1).astype(np.int32)), pa.array(dist[ok])], schema=_OUT)
