"""Best-fit packing of documents into training sequences by large-item matching.

Lengths are words between Unicode white space, as in all operators of this package. A document longer than a bin fills bins of its own; what is left over
is packed like a document. Pieces above a third of the capacity, of which a bin holds two at most, are matched
greedily: the largest takes the largest that still fits. The others go, longest first, each into the bin it fills
best. Documents are dealt by a hash into as many groups as there are shuffle partitions; a group leaves about one
bin unfilled, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common as c

CAPACITY = 2048
_PLACED = pa.schema([("bin_id", pa.int64()), ("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64())])


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece of 1 to ``capacity`` words. Bitsets over sizes and gaps find each best fit at once."""
    bins = np.full(len(sizes), -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    large = order[3 * sizes[order] > capacity]
    waiting: dict[int, list[int]] = {}
    mask = 0
    for i in large[::-1].tolist():
        waiting.setdefault(int(sizes[i]), []).append(i)
        mask |= 1 << int(sizes[i])
    gaps: dict[int, list[int]] = {}
    open_ = 0
    count = 0

    def take(size: int) -> int:
        nonlocal mask
        i = waiting[size].pop()
        if not waiting[size]:
            mask ^= 1 << size
        return i

    def leave(gap: int, b: int) -> None:
        nonlocal open_
        if gap:
            gaps.setdefault(gap, []).append(b)
            open_ |= 1 << gap

    while mask:
        size = mask.bit_length() - 1
        bins[take(size)] = count
        gap = capacity - size
        mate = (mask & (1 << gap + 1) - 1).bit_length() - 1
        if mate > 0:
            bins[take(mate)] = count
            gap -= mate
        leave(gap, count)
        count += 1
    for i in order[len(large) :].tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            gap = (fits & -fits).bit_length() - 1 + size
            b = gaps[gap].pop()
            if not gaps[gap]:
                open_ ^= 1 << gap
        else:
            gap, b, count = capacity, count, count + 1
        bins[i] = b
        leave(gap - size, b)
    return bins


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """bin_id, doc_id, start_word and n_words of every piece; no bin holds more than ``capacity`` words.

    A null or empty text, or one of white space only, has no words and no piece. Repeated rows, such as the copies
    that mixing made, are packed each; a null doc_id is packed and stays null. A text of any length is packed whole, in as
    many bins as it takes. Other columns are ignored; an empty table gives no bins. bin_id tells bins apart, no more.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    shards = c.partitions(spark)

    @c.tidy
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(c.word_counts(part.column("text")))], names=["doc_id", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = rows.mapInArrow(sizes, "doc_id long, n long").where("n > 0")
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        table = pa.Table.from_batches(batches) if batches else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("n", "descending"), ("doc_id", "ascending")])
        shard = table.column("shard")[0].as_py()
        n, ids = table.column("n").to_numpy(), table.column("doc_id").combine_chunks()
        full, rest = n // capacity, n % capacity
        of_full, of_rest = np.repeat(np.arange(len(n)), full), np.flatnonzero(rest)
        bins = pack(rest[of_rest], capacity)
        of = np.concatenate([of_full, of_rest])
        start = np.concatenate([c.ranges(full) * capacity, full[of_rest] * capacity])
        size = np.concatenate([np.full(len(of_full), capacity, np.int64), rest[of_rest]])
        bin_id = np.concatenate([np.arange(len(of_full)), len(of_full) + bins]) + (shard << 40)
        out = pa.table([pa.array(bin_id), ids.take(pa.array(of)), pa.array(start), pa.array(size)], schema=_PLACED)
        yield from out.to_batches(max_chunksize=50_000)

    return c.to_shards(items, "shard").mapInArrow(run, "bin_id long, doc_id long, start_word long, n_words long")
