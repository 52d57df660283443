"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the ordered list of its nearest pivots, and equal vectors are one. The inverted list of a
pivot holds the vectors that have it among theirs; of two vectors in a list their shared pivots are counted, from
bits, and pairs that share at least two are candidates. A pair is a candidate in the list of its least shared pivot
only. Candidates alone are verified by their cosine. No pair leaves a task: a list gives each vector's number of links
and a spanning forest of what it links.

The pivots number 2 sqrt(n) at most, MAX_PIVOTS in any case, so what is broadcast has a size bound. No two pivots lie
within twice the angle of the threshold: a dense group of near copies has one pivot or few, which all its members
list, and not many among which noise would choose. A long list is cut into parts, and each pair of parts is a task's
work of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common as c
from folio.llm import vectors as v
from folio.llm.components import components

NEAREST, MAX_PIVOTS = 6, 1 << 15
#: Vectors of one list that one part holds.
PART = 4096
_CANDIDATES = 4
_BLOCK = 1 << 21
_LINKS = "a long, b long, links long"
_LINK_ROWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, nearest: int = NEAREST, n_pivots: int | None = None) -> DataFrame:
    """One row for each vector: vec_id, class_id (the least vec_id that a chain of links leads to, its own without
    any) and links, the number of other vectors whose cosine to it, to 6 places, is at least ``threshold``.

    Vectors of each dimension are compared among themselves. A link is found if its vectors share two of their ``nearest`` pivots (one, if there is one pivot in all); equal vectors are always linked. Null ids and
    vectors, vectors with null, infinite or NaN entries and those of length zero are left out. Rows that repeat a vec_id are
    one vector, the least. Other columns are ignored; an empty table gives no rows.
    """
    rows = c.keep(v.valid(embeddings).where(F.exists("v", lambda x: x != 0)), "vectors")
    return v.by_dimension(rows, lambda some: _classes(some, threshold, nearest, n_pivots))


def _classes(rows: DataFrame, threshold: float, nearest: int, n_pivots: int | None) -> DataFrame:
    same = rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    units = c.keep(same.select(F.col("rep").alias("id"), "v", "n"), "vector-units")
    copies = rows.join(same.select("v", "rep", "n"), "v").select("id", "rep", "n")
    found = c.keep(_linked(units, threshold, nearest, n_pivots), "vector-links")
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("found"))
    classes = components(found.where("links = 0").select("a", "b")).select(F.col("node").alias("rep"), "component")
    joined = copies.join(links, "rep", "left").join(classes, "rep", "left")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("component", "rep").alias("class_id"), (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("links"))


def _linked(units: DataFrame, threshold: float, nearest: int, n_pivots: int | None) -> DataFrame:
    """Rows of two kinds: (a, null, links) adds links to a vector, (a, b, 0) joins two into a class."""
    spark = units.sparkSession
    shards = c.partitions(spark)
    count = n_pivots or min(MAX_PIVOTS, max(8, math.ceil(2 * math.sqrt(units.count()))))
    anchors = v.pivots(units, _CANDIDATES * count)
    if len(anchors):
        anchors = _apart(anchors / np.linalg.norm(anchors, axis=1, keepdims=True), count, max(2 * threshold**2 - 1, 0.5))
    shared = spark.sparkContext.broadcast(anchors.astype(np.float32))
    width = min(nearest, len(anchors))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            step = max(1, _BLOCK // max(1, len(p)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                x = v.matrix(part.column("v")).astype(np.float64)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                # ties between pivots go to the lower number
                order = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :width].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), v.lists(x), v.lists(order)], names=["id", "n", "x", "near"])

    described = c.keep(units.mapInArrow(describe, "id long, n long, x array<float>, near array<int>"), "vector-pivots")
    sizes = described.select(F.explode("near").alias("pivot")).groupBy("pivot").count()
    # one number for each pivot, MAX_PIVOTS at most
    parts = np.ones(max(1, len(anchors)), np.int64)
    for r in sizes.collect():
        parts[r["pivot"]] = -(-r["count"] // PART)
    first = np.concatenate([[0], np.cumsum(parts * (parts + 1) // 2)])
    lists = spark.sparkContext.broadcast((parts, first[:-1]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first = lists.value
        for batch in batches:
            near = v.matrix(batch.column("near"))
            if not near.size:
                continue
            spread = (c.mix(batch.column("id").to_numpy().view(c.U64)) >> c.U64(1)).astype(np.int64)
            row, pivot = np.repeat(np.arange(len(near)), near.shape[1]), near.reshape(-1).astype(np.int64)
            s = parts[pivot]
            again = np.repeat(np.arange(len(row)), s)
            other, row, pivot, s = c.ranges(s), row[again], pivot[again], s[again]
            own = (spread[row] + pivot) % s
            low, high = np.minimum(own, other), np.maximum(own, other)
            task = first[pivot] + low * s - low * (low - 1) // 2 + high - low
            for a in range(0, len(row), 1 << 16):
                at = slice(a, a + (1 << 16))
                some = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task[at]), pa.array(pivot[at].astype(np.int32)), pa.array(np.where(low == high, 0, 1 + (own == high))[at].astype(np.int32)), *(batch.column(k).take(some) for k in ("id", "n", "x", "near"))],
                    names=["task", "pivot", "side", "id", "n", "x", "near"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in c.runs_of(batches, "task"):
            if table.num_rows > 1:
                yield from _verified(table, threshold, min(2, width))

    sent = described.mapInArrow(send, "task long, pivot int, side int, id long, n long, x array<float>, near array<int>")
    return sent.repartition(shards, "task").sortWithinPartitions("task").mapInArrow(verify, _LINKS)


def _verified(table: pa.Table, threshold: float, enough: int) -> Iterator[pa.RecordBatch]:
    pivot = table.column("pivot")[0].as_py()
    side, ids, n = (table.column(k).to_numpy() for k in ("side", "id", "n"))
    x, near = v.matrix(table.column("x").combine_chunks()), v.matrix(table.column("near").combine_chunks())
    bits, below = _bits(near, pivot)
    links = np.zeros(len(ids), np.int64)
    hits = np.zeros((len(ids), len(ids)), bool)
    # within a part (side 0) every pair once, between two parts those with a vector of each
    rows, columns = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if side.any() else (np.arange(len(ids)),) * 2
    step = max(1, _BLOCK // max(1, len(columns)))
    for a in range(0, len(rows), step):
        some = rows[a : a + step]
        counted = np.zeros((len(some), len(columns)), np.uint8)
        lesser = np.zeros(counted.shape, bool)
        for w in range(bits.shape[1]):
            both = bits[some, w][:, None] & bits[columns, w][None]
            counted += np.bitwise_count(both)
            if below[w]:
                lesser |= (both & below[w]) != 0
        may = (counted >= enough) & ~lesser
        if not side.any():
            may &= some[:, None] < columns[None]
        i, j = np.nonzero(may)
        if not len(i):
            continue
        if 8 * len(i) > may.size:  # where most are candidates a matrix product is cheaper; it may round by a little
            may &= x[some] @ x[columns].T >= threshold - 1e-4
            i, j = np.nonzero(may)
        for at in range(0, len(i), 1 << 16):
            one, two = some[i[at : at + (1 << 16)]], columns[j[at : at + (1 << 16)]]
            cos = np.round(np.einsum("ij,ij->i", x[one], x[two], dtype=np.float64), 6)
            one, two = one[cos >= threshold], two[cos >= threshold]
            hits[one, two] = hits[two, one] = True
            links += np.bincount(one, n[two], len(ids)).astype(np.int64) + np.bincount(two, n[one], len(ids)).astype(np.int64)
    some = np.flatnonzero(links)
    if not len(some):
        return
    a, b = _forest(hits[np.ix_(some, some)])
    none = pa.nulls(len(some), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), none, pa.array(links[some])], schema=_LINK_ROWS)
    yield pa.RecordBatch.from_arrays([pa.array(ids[some[a]]), pa.array(ids[some[b]]), pa.array(np.zeros(len(a), np.int64))], schema=_LINK_ROWS)


def _bits(near: np.ndarray, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """The pivots of each vector as bits over those of the whole list; the bits of pivots below ``pivot``."""
    known, at = np.unique(near, return_inverse=True)
    at = at.reshape(near.shape)
    words = -(-len(known) // 64)
    bits = np.zeros((len(near), words), np.uint64)
    for k in range(near.shape[1]):
        bits[np.arange(len(near)), at[:, k] >> 6] |= c.U64(1) << (at[:, k] & 63).astype(np.uint64)
    lesser = np.flatnonzero(known < pivot)
    below = np.zeros(words, np.uint64)
    np.bitwise_or.at(below, lesser >> 6, c.U64(1) << (lesser & 63).astype(np.uint64))
    return bits, below


def _forest(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric relation in which every row has a partner."""
    rest = np.ones(len(hits), bool)
    a: list[int] = []
    b: list[int] = []
    for seed in range(len(hits)):
        if not rest[seed]:
            continue
        rest[seed], front = False, [seed]
        while front and rest.any():
            at = front.pop()
            new = np.flatnonzero(hits[at] & rest).tolist()
            rest[new] = False
            a += [at] * len(new)
            b += new
            front += new
    return np.array(a, np.int64), np.array(b, np.int64)


def _apart(unit: np.ndarray, count: int, limit: float) -> np.ndarray:
    """The first ``count`` unit vectors whose cosines to all that were taken before are below ``limit``."""
    taken, n = np.empty((count, unit.shape[1])), 0
    for x in unit:
        if n < count and (not n or (taken[:n] @ x).max() < limit):
            taken[n] = x
            n += 1
    return taken[:n]
