"""Substring dedup by fixed-block anchors.

Every document's words fall into non-overlapping blocks, the reference index. A repeat of ``min_words`` words
covers a whole block of either copy if a block has at most (min_words + 1) / 2 words, so probing the index with
every rolling window of every document finds an anchor inside each repeat. Only anchored places are extended: the
windows of ``min_words`` words around an anchor are compared exactly by 64-bit fingerprints, and neighbours that
follow one original join into a maximal repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common as c
from folio.llm import repeats as r

_HITS = pa.schema([("hit_doc", pa.int64()), ("hits", pa.binary())])


def repeated_spans(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Maximal spans of at least ``min_words`` white-space words that repeat an earlier occurrence.

    The result, and what happens to nulls, empty and very long texts, repeated rows, exact copies, other columns and
    empty tables, is that of suffix_family.repeated_spans; the two find it in different ways.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    return r.with_copies(docs, min_words, lambda some: _spans(some, min_words))


def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    spark = docs.sparkSession
    shards, block = c.partitions(spark), (min_words + 1) // 2

    def key_of(words: np.ndarray) -> r.Columns:
        f = c.rolling(words, block)
        # 32 bits and the shard choose an anchor; a false one does not survive the extension
        return (f & c.U64(0xFFFFFFFF)).astype(np.uint32), f >> c.U64(32)

    probes = c.to_shards(r.windows(docs, block, key_of), "shard")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column("rows").to_pylist()]
        index = []
        for blob in blobs:
            key, _, _, pos = r.unpack_windows(blob)
            index.append(key[pos % block == 0])
        if not index or not sum(map(len, index)):
            return
        index = np.unique(np.concatenate(index))
        seen = np.zeros(len(index), np.int64)
        hits = []
        for blob in blobs:
            columns = r.unpack_windows(blob)
            at = np.searchsorted(index, columns[0])
            at[at == len(index)] = 0
            hit = np.flatnonzero(index[at] == columns[0])
            seen += np.bincount(at[hit], minlength=len(index))
            hits.append((at[hit], *(x[hit] for x in columns[1:])))
        at, doc, size, pos = (np.concatenate(x) for x in zip(*hits))
        several = seen[at] > 1
        if several.any():
            yield r.by_document((doc[several], size[several], pos[several]), shards)

    anchors = c.to_shards(probes.mapInArrow(probe, r.PACKED), "shard")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column("rows").to_pylist()]
        if not blobs:
            return
        doc, size, pos = r.from_document(blobs)
        at = np.append(np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)), len(doc))
        rows = [(int(doc[a]), c.pack(size[a:b], np.diff(pos[a:b], prepend=0))) for a, b in zip(at, at[1:])]
        for a in range(0, len(rows), 1000):
            ids, hits = zip(*rows[a : a + 1000])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.binary())], schema=_HITS)

    hits = anchors.mapInArrow(gather, "hit_doc long, hits binary")
    anchored = r.searched(docs).join(hits, F.col("doc_id") == F.col("hit_doc")).select("doc_id", "text", "hits")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                offsets, codes, words = c.word_codes(part.column("text"))
                near = np.zeros(int(offsets[-1]) + 1, np.int64)
                for start, n, blob in zip(offsets, np.diff(offsets), part.column("hits").to_pylist()):
                    size, pos = c.unpack(blob)
                    pos = np.cumsum(pos)[size == n]
                    last = n - min_words
                    if last >= 0 and len(pos):
                        low, high = np.maximum(0, pos - (min_words - block)), np.minimum(pos, last)
                        ok = low <= high
                        np.add.at(near, start + low[ok], 1)
                        np.add.at(near, start + high[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                if len(at):
                    keys, spread = r.fingerprints(c.hash_words(words)[codes], min_words)
                    yield r.packed(r.pack_windows(part.column("doc_id").to_numpy(), offsets, at, keys[at], spread[at], shards))

    extended = c.to_shards(anchored.mapInArrow(extend, r.PACKED), "shard")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [r.unpack_windows(x.as_py()) for batch in batches for x in batch.column("rows")]
        if not parts:
            return
        own, again = r.classes(*(np.concatenate(x) for x in zip(*parts)))
        if len(again[0]):
            at = np.searchsorted(own[0], again[0])
            yield r.by_document((*again[1:], own[1][at], own[3][at].astype(np.int64) - again[3]), shards)

    return r.runs(extended.mapInArrow(match, r.PACKED), min_words)
