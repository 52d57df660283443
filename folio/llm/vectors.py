"""What the vector operators share: valid vectors, pivots, Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and v of every usable vector: those with an id and with finite entries only, one or more. Of rows that repeat an
    id the least vector counts."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def by_dimension(rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` gives for the vectors of each dimension, put together. A table has one dimension, or few."""
    dims = [r["dim"] for r in rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()]
    parts = [work(rows.where(F.size("v") == d)) for d in dims] if len(dims) > 1 else [work(rows)]
    return reduce(DataFrame.union, parts)


def pivots(df: DataFrame, count: int) -> np.ndarray:
    """``count`` vectors chosen by a hash of their ids, fewer if there are fewer."""
    rows = df.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(count).collect()
    return np.array([r["v"] for r in rows], np.float64)


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] if x.ndim > 1 and x.shape[1] else 1), pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))
