"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents each expect the same number of copies, most often a fraction. The whole part is given;
fractions are rounded in pairs: mass moves at random from one document of a pair to the other until one of them has
0 or 1, and the other goes on to the next. Each expectation is kept and a source's total differs from its target by
less than one document. Tasks round their share of every source and leave at most one open document of each; a
tree of wider and wider tasks pairs these until one is left, which is drawn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common as c

FAN_IN = 16
_EPS = 1e-9
_SETTLED = "doc_id long, source string, whole long, part double, node long"


def pivotal(p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities in order, one draw each: values of 0 and 1, and the place of the open one (-1: none)."""
    out = p.astype(float).copy()
    held = -1
    for i in range(len(out)):
        if out[i] < _EPS or out[i] > 1 - _EPS:
            out[i] = round(out[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held], out[i]
        total = a + b
        if total <= 1:
            wins = draws[i] * total < b
            out[held], out[i] = (0.0, total) if wins else (total, 0.0)
        else:
            wins = draws[i] * (2 - total) < 1 - b
            out[held], out[i] = (1.0, total - 1) if wins else (total - 1, 1.0)
        open_ = i if wins else held
        if out[open_] < _EPS or out[open_] > 1 - _EPS:
            out[open_] = round(out[open_])
            open_ = -1
        held = open_
    return out, held


def _settle(rows: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Round the rows of each source in one node. A row that stays open keeps its fraction in ``part``."""
    rows = rows.sort_values(["source", "doc_id"], na_position="first", kind="stable").reset_index(drop=True)
    names = rows["source"].astype(object).where(rows["source"].notna(), None)
    part = rows["part"].to_numpy(float).copy()
    cuts = np.flatnonzero(np.append(True, names[1:].to_numpy() != names[:-1].to_numpy())) if len(rows) else np.zeros(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(rows))):
        # draws hang on the rows alone, so a task that runs again decides alike
        key = f"{seed}|{names[a]!r}|{rows['node'][a]}|{rows['doc_id'][a]}|{rows['doc_id'][b - 1]}|{b - a}"
        draws = np.random.default_rng(xxhash.xxh3_64_intdigest(key)).random(b - a + 1)
        part[a:b], held = pivotal(part[a:b], draws)
        if last and held >= 0:
            part[a + held] = float(draws[-1] < part[a + held])
    return rows.assign(part=part, source=names)


def _settler(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _settle(rows, seed, last)


def expected(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, total: float | None = None) -> DataFrame:
    """source, n (distinct documents) and expected copies of each. See copies()."""
    spark = docs.sparkSession
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        n = n.join(given, n["source"].eqNullSafe(given["s"]), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    least = n.agg(F.max(F.when(F.col("w") > 0, F.col("n") / F.col("w"))).alias("least"), F.sum("w").alias("all_w"))
    scale = F.col("least") if total is None else F.lit(float(total)) / F.col("all_w")
    return n.crossJoin(least).select("source", "n", F.coalesce(F.col("w") * scale / F.col("n"), F.lit(0.0)).alias("expected"))


def copies(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, total: float | None = None, seed: int = 11) -> DataFrame:
    """doc_id, source and the copies each document gets, so that sources occur as ``weights``.

    weights: of each source (others get none), or None for n ** alpha, n being the source's documents. total: rows
    to give in all, or None for the least that gives every document of a weighted source a copy or more.

    A null source is a source. Rows with a null doc_id get no decision; rows that repeat (doc_id, source) are one
    document. Texts and other columns play no part; an empty table gives no rows. Equal input, partitions and seed
    give equal results.
    """
    spark = docs.sparkSession
    shards = c.partitions(spark)
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")).where("doc_id IS NOT NULL").distinct()
    units = c.keep(units, "mix-units")
    rates = expected(units, weights, alpha, total).select(F.col("source").alias("s"), "expected")
    rows = units.join(rates, units["source"].eqNullSafe(rates["s"])).select(
        "doc_id", "source", F.floor(F.col("expected") + _EPS).cast("long").alias("whole"),
        F.greatest(F.lit(0.0), F.col("expected") - F.floor(F.col("expected") + _EPS)).alias("part"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("node"),
    )

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            yield from _arrow(_settle(table.to_pandas(), seed, shards == 1))

    done = c.keep(c.to_shards(rows.withColumn("node", F.col("node").cast("int")), "node").mapInArrow(leaf, _SETTLED), "mix-leaves")
    result, level, nodes = [], done, shards
    is_open = (F.col("part") > 0) & (F.col("part") < 1)
    while nodes > 1:
        result.append(level.where(~is_open))
        nodes = -(-nodes // FAN_IN)
        last = nodes == 1
        level = c.keep(
            level.where(is_open).withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
            .groupBy("node").applyInPandas(_settler(seed, last), _SETTLED), "mix-tree",
        )
    for other in result:
        level = level.unionByName(other)
    return level.select("doc_id", "source", (F.col("whole") + F.round("part").cast("long")).alias("copies"))


def _arrow(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("whole", pa.int64()), ("part", pa.float64()), ("node", pa.int64())])
    yield from pa.Table.from_pandas(rows, schema, preserve_index=False).to_batches(max_chunksize=50_000)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, total: float | None = None, seed: int = 11) -> DataFrame:
    """Each row as often as copies() says; a row with a null doc_id once. Columns stay as they are.

    Only documents that do not occur just once are joined. Texts are not shuffled while these are few enough to broadcast
    (c.BROADCAST_ROWS).
    """
    doc, source, times, copy = (c.unused(docs, x) for x in ("__doc", "__source", "__copies", "__copy"))
    n = copies(docs, weights, alpha, total, seed).where("copies <> 1").select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("copies").alias(times))
    n = c.few(c.keep(n, "mix-copies"))
    rows = docs.join(n, (F.col("doc_id").cast("long") == F.col(doc)) & F.col("source").cast("string").eqNullSafe(F.col(source)), "left")
    known = F.coalesce(F.col(times), F.lit(1)).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), known))).drop(doc, source, times, copy)
