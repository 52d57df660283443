"""Suffix-array dedup by a logarithmic family of indexes.

The suffix space is split into shards by the text of a suffix, so equal suffixes meet in one task whatever
document they come from. In each shard the slices of the corpus arrive as batches. A batch's suffixes are sorted
into a suffix array cut at ``min_words`` words, ordered by the fingerprints of the first and the second half of
that prefix; the sorted array is merge-scanned against every level of the family; what is new joins the family as
a level, and levels of equal rank merge, so n batches leave log2 n levels and each suffix is merged log2 n times.
repeated_spans() does this for one corpus; an Index keeps the family in a folder and takes more batches in later calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common as c
from folio.llm import repeats as r


class Family:
    """Levels of sorted, distinct keys with the least occurrence of each."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, r.Columns]] = []  # (rank, (key, doc, size, pos))
        self.repeated: list[r.Columns] = []

    def add(self, key: np.ndarray, doc: np.ndarray, size: np.ndarray, pos: np.ndarray) -> None:
        own, again = r.classes(key, doc, size, pos)
        self.repeated.append(again)
        for _, level in self.levels:
            if not len(own[0]):
                break
            own = self._scan(level, own)
        rank = 0
        while self.levels and self.levels[-1][0] <= rank:
            own = self._merge(self.levels.pop()[1], own)
            rank += 1
        self.levels.append((rank, own))

    def _scan(self, level: r.Columns, own: r.Columns) -> r.Columns:
        if not len(level[0]):
            return own
        at = np.searchsorted(level[0], own[0])
        at[at == len(level[0])] = 0
        hit = np.flatnonzero(level[0][at] == own[0])
        if not len(hit):
            return own
        new, old = [x[hit] for x in own], [x[at[hit]] for x in level]
        order = [np.sign(a.astype(np.int64) - b.astype(np.int64)) if k else (a > b).astype(np.int64) - (a < b) for k, (a, b) in enumerate(zip(new[1:], old[1:]))]
        sign = np.where(order[0] != 0, order[0], np.where(order[1] != 0, order[1], order[2]))
        later, earlier = sign > 0, sign < 0
        self.repeated.append(tuple(x[later] for x in new))
        self.repeated.append(tuple(x[earlier] for x in old))
        for x, y in zip(level[1:], new[1:]):
            x[at[hit[earlier]]] = y[earlier]
        rest = np.ones(len(own[0]), bool)
        rest[hit] = False
        return tuple(x[rest] for x in own)

    @staticmethod
    def _merge(a: r.Columns, b: r.Columns) -> r.Columns:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate(x)[order] for x in zip(a, b))

    def found(self) -> r.Columns:
        """Each repeated occurrence: doc, size, pos, the original's doc and how far it lies from pos."""
        key, doc, size, pos = (np.concatenate(x) for x in zip(*self.repeated)) if self.repeated else [np.zeros(0, np.int64)] * 4
        ref, ref_pos = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        for _, level in self.levels:
            if len(level[0]):
                at = np.minimum(np.searchsorted(level[0], key), len(level[0]) - 1)
                hit = level[0][at] == key
                ref[hit], ref_pos[hit] = level[1][at[hit]], level[3][at[hit]]
        return doc, size, pos, ref, ref_pos - pos.astype(np.int64)


def repeated_spans(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Maximal spans of at least ``min_words`` white-space words that repeat an earlier occurrence.

    docs needs doc_id and text. One row for each span of each later copy: doc_id, n_words (of the document),
    start_word, length, ref_doc_id, ref_start_word (the original; the least (doc_id, n_words, position) of the equal
    texts). Spans with different originals are separate and may overlap. Repeats inside one document count.

    Null doc_id or text, empty texts and texts of fewer than min_words words have no spans; texts of any length are
    searched whole; rows that repeat a document (same doc_id and number of words) count once; other columns, of
    whatever name, are ignored; an empty table gives none. Exact copies are searched once (repeats.with_copies).
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    return r.with_copies(docs, min_words, lambda some: _spans(some, min_words))


def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    spark = docs.sparkSession
    shards = c.partitions(spark)
    suffixes = r.windows(docs, min_words, lambda words: r.fingerprints(words, min_words))

    @c.tidy
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for batch in batches:
            for blob in batch.column("rows"):
                family.add(*r.unpack_windows(blob.as_py()))
        columns = family.found()
        if len(columns[0]):
            yield r.by_document(columns, shards)

    found = c.to_shards(suffixes, "shard").mapInArrow(match, r.PACKED)
    return r.runs(found, min_words)


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Documents with every repeated span cut out but its original; see repeated_spans and repeats.cut."""
    return r.cut(docs, c.keep(repeated_spans(docs, min_words), "suffix-spans"))


_ROWS = "shard int, kind int, rank int, rows binary"
_STORED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("rank", pa.int32()), ("rows", pa.binary())])
_LEVEL, _REPEATED, _BATCH = 0, 1, 2


def _loaded(batches: Iterator[pa.RecordBatch]) -> tuple[int, Family, list[bytes]]:
    """A shard's number, its family and the packed rows of a new batch."""
    shard, family, new = -1, Family(), []
    for batch in batches:
        for s, kind, rank, rows in zip(*(batch.column(k).to_pylist() for k in ("shard", "kind", "rank", "rows"))):
            shard = s
            if kind == _BATCH:
                new.append(rows)
            elif kind == _LEVEL:
                family.levels.append((rank, tuple(c.unpack(rows))))
            else:
                family.repeated.append(tuple(c.unpack(rows)))
    family.levels.sort(key=lambda level: -level[0])
    return shard, family, new


class Index:
    """A family in a folder, to which batches are added in calls of their own.

    Each call writes a version of the folder: the levels of every shard and what was found to repeat so far. A batch is
    scanned against all levels and becomes a level; equal ranks merge, so n batches leave log2 n levels. What spans()
    gives is that of repeated_spans() over all batches together, whatever their number and order. A version is complete
    once it is written; one that was not is passed over by open().
    """

    def __init__(self, spark: SparkSession, folder: str, min_words: int = 50, shards: int | None = None) -> None:
        if min_words < 2:
            raise ValueError("min_words must be at least 2")
        self.spark, self.folder, self.min_words, self.shards, self.version = spark, folder.rstrip("/"), min_words, shards or c.partitions(spark), 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        """The newest complete version in a folder."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        version, shards, words = max(tuple(map(int, n[1:].split("-"))) for n in names)
        found = cls(spark, folder, words, shards)
        found.version = version
        return found

    def _at(self, version: int) -> str:
        return f"{self.folder}/v{version}-{self.shards}-{self.min_words}"

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(self._at(self.version)) if self.version else self.spark.createDataFrame([], _ROWS)

    def add(self, docs: DataFrame) -> None:
        """Add a batch. Nulls, empty and very long texts and repeated rows count as in repeated_spans(); an empty batch
        changes nothing."""
        width = self.min_words

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, family, new = _loaded(batches)
            if new:
                family.add(*(np.concatenate(x) for x in zip(*map(r.unpack_windows, new))))
            for rank, columns in family.levels:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_LEVEL], pa.int32()), pa.array([rank], pa.int32()), pa.array([c.pack(*columns)])], schema=_STORED)
            if family.repeated:
                columns = [np.concatenate(x) for x in zip(*family.repeated)]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_REPEATED], pa.int32()), pa.array([0], pa.int32()), pa.array([c.pack(*columns)])], schema=_STORED)

        batch = r.windows(docs, width, lambda words: r.fingerprints(words, width), self.shards).select("shard", F.lit(_BATCH).alias("kind"), F.lit(0).alias("rank"), "rows")
        rows = batch.union(self._stored()).repartitionById(self.shards, F.col("shard"))
        rows.mapInArrow(step, _ROWS).write.mode("overwrite").parquet(self._at(self.version + 1))
        self.version += 1

    def spans(self) -> DataFrame:
        """The repeated spans of all batches so far; see repeated_spans()."""
        shards = self.shards

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = _loaded(batches)[1].found()
            if len(columns[0]):
                yield r.by_document(columns, shards)

        rows = self._stored().repartitionById(shards, F.col("shard"))
        return r.runs(rows.mapInArrow(found, r.PACKED), self.min_words, shards)
