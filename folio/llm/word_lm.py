"""A word n-gram model with interpolated Kneser-Ney smoothing in sharded Elias-Fano tries.

Counts cover every white-space word of every document, and the model grows with the corpus. Two exchanges make it. The
first counts word pairs, which gives the vocabulary: ids by falling frequency, and before how many different words each
word stands after. The second sends every n-gram, as ids, to the shard of its context. A context is read backwards; a
shard holds all contexts whose last word is dealt to it, so a context lies beside its back-off contexts; contexts that end
in a hot word are dealt by two words, and the counts of that word alone are made apart. Each shard is a few files: its levels hold pointers, labels and ranks of successors within those of the shorter context in Elias-Fano form,
shares and back-off weights in one byte each. A corpus that is to be scored by its own model takes the second exchange
once: each task builds its shard, maps it, scores what came with it and drops the files.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common as c
from folio.llm.elias_fano import Sequence, encode

DISCOUNT = 0.75
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS = pa.schema([("shard", pa.int32()), ("rows", pa.binary())])
#: What comes back from the shards: of a slice of documents either their ids and numbers of words, or packed sums of some.
_PARTS = pa.schema([("to", pa.int32()), ("base", pa.int64()), ("rows", pa.binary()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
_SUMS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("bits", pa.float64())])
#: Packed rows in an Arrow batch.
_BATCH = 256
#: Files of the vocabulary at most; classes of words, by the powers of two in their counts, of which the commonest come first.
_FILES, _CLASSES = 64, 48
#: A word that stands before so many times a shard's share of all words is hot, and its contexts are dealt to several shards;
#: how many candidates for that a vocabulary file names.
_HOT, _TOP = 4.0, 256
#: Shards for each shuffle partition, and parts of a shard, by its contexts' last words; one file at a time is built or read.
_SHARDS, _PARTS_OF_SHARD = 2, 8
#: n-grams of one last word in a file, about, where a corpus is scored by its own model. A word that has more in a shard is
#: long there, and its contexts are dealt to several files by the word before.
_LONG = 1 << 19


def windows(texts: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Offsets of texts; columns of codes: each word, the word before it and so on; the hash of each code. The last
    code, with hash 0, stands before a text."""
    offsets, codes, words = c.coded_words(texts)
    hashes = np.append(np.maximum(c.hash_strings(words), c.U64(1)), c.U64(0))
    lengths = np.diff(offsets)
    at = np.arange(len(codes)) + np.repeat(np.arange(1, len(lengths) + 1) * (order - 1), lengths)
    padded = np.full(len(codes) + len(lengths) * (order - 1), len(words), np.int32)
    padded[at] = codes
    return offsets, [padded[at - back] for back in range(order)], hashes


def _rows(rows: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_ROWS)


def _taken(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[bytes]]:
    """The shard of a task and all its packed rows."""
    shard, blobs = -1, []
    for batch in batches:
        if batch.num_rows:
            shard = batch.column("shard")[0].as_py()
            blobs += batch.column("rows").to_pylist()
    return shard, blobs


class Vocabulary:
    """Ids of words, from 1 by falling frequency, in files that tasks map: sorted hashes, the place of each among the
    file's words by class, and, by place, how many different words a word stands after."""

    def __init__(self, folder: str, sizes: np.ndarray, ahead: int, total: int, top: dict[int, int]) -> None:
        # sizes: (files, classes); total: of all counts; top: the counts of the commonest words, by hash
        self.folder, self.sizes, self.ahead, self.total, self.top = folder, sizes, ahead, total, top
        self.words = int(sizes.sum())
        # classes one after the other, in each the files one after the other
        self.bases = 1 + (np.cumsum(sizes.T.reshape(-1)) - sizes.T.reshape(-1)).reshape(sizes.T.shape).T
        self.begins = np.cumsum(sizes, axis=1) - sizes
        self._open: dict[int, tuple[np.ndarray, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _file(self, k: int) -> tuple[np.ndarray, ...]:
        if k not in self._open:
            n = int(self.sizes[k].sum())
            raw = np.memmap(f"{self.folder}/{k}.words", np.uint8, "r") if n else np.zeros(0, np.uint8)
            self._open[k] = raw[: 8 * n].view(np.uint64), raw[8 * n : 12 * n].view(np.uint32), raw[12 * n :].view(np.uint32)
        return self._open[k]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """0 for hash 0, words + 1 for unknown words."""
        out = np.full(len(hashes), self.words + 1, np.uint32)
        files = len(self.sizes)
        by, bounds = c.split_by((c.mix(hashes) % c.U64(files)).astype(np.int64), files)
        for k in range(files):
            m = by[bounds[k] : bounds[k + 1]]
            known, places, _ = self._file(k) if len(m) else ((), (), ())
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[m]), len(known) - 1)
                hit = known[at] == hashes[m]
                place = places[at[hit]].astype(np.int64)
                kind = np.searchsorted(self.begins[k], place, "right") - 1
                out[m[hit]] = self.bases[k][kind] + place - self.begins[k][kind]
        out[hashes == 0] = 0
        return out

    def alone(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities of words without context; a word never seen has the share of one more word."""
        total, ahead, files = max(1, self.ahead), np.zeros(len(ids)), len(self.sizes)
        real = (ids > 0) & (ids <= self.words)
        # an empty slot has the base of the next one: the last of equals is meant
        slot = np.searchsorted(self.bases.T.reshape(-1), ids, "right") - 1
        by, bounds = c.split_by(np.where(real, slot % files, 0), files)
        for k in range(files):
            m = by[bounds[k] : bounds[k + 1]]
            m = m[real[m]]
            if len(m):
                kind = slot[m] // files
                ahead[m] = self._file(k)[2][self.begins[k][kind] + ids[m].astype(np.int64) - self.bases[k][kind]]
        rest = DISCOUNT * self.words / total if self.words else 1.0
        return np.maximum(ahead - DISCOUNT, 0) / total + rest / (self.words + 1)


def vocabulary(docs: DataFrame, folder: str) -> Vocabulary:
    """Count the word pairs of all texts. Pairs are dealt by both words, and only sums by word go on from there."""
    spark = docs.sparkSession
    shards = c.partitions(spark)
    files = min(shards, _FILES)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.gathered(batches, c.slice_bytes(shards)):
            _, (word, before), hashes = windows(part.column("text"), 2)
            if not len(word):
                continue
            key, n = np.unique(before.astype(np.int64) * len(hashes) + word, return_counts=True)
            before, word = key // len(hashes), key % len(hashes)
            by, bounds = c.split_by((c.mix(hashes[before] * c.U64(3) + hashes[word]) % c.U64(shards)).astype(np.int64), shards)
            yield _rows(_coded(by, bounds, hashes, [before, word], c.narrow(n), shards))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, blobs = _taken(batches)
        if not blobs:
            return
        parts = [c.unpack(b) for b in blobs]
        blobs.clear()
        known = c.uniques(np.concatenate([p[0] for p in parts]))
        before, word, n = [], [], []
        for p in parts:
            at = np.searchsorted(known, p[0])
            before.append(np.cumsum(p[1], dtype=np.int64))
            before[-1] = at[before[-1]]
            word.append(at[p[2]])
            n.append(p[3])
        word = np.concatenate(word)
        count = np.bincount(word, np.concatenate(n), len(known)).astype(np.uint64)
        ahead = np.bincount(c.uniques(np.concatenate(before) * len(known) + word) % len(known), minlength=len(known)).astype(np.uint32)
        some = np.flatnonzero(ahead)
        by, bounds = c.split_by((c.mix(known[some]) % c.U64(files)).astype(np.int64), files)
        mine = [some[by[bounds[k] : bounds[k + 1]]] for k in range(files)]
        yield _rows((k, c.pack(known[m], c.narrow(ahead[m]), c.narrow(count[m]))) for k, m in enumerate(mine) if len(m))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, blobs = _taken(batches)
        if not blobs:
            return
        parts = [c.unpack(b) for b in blobs]
        known, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        ahead, count = (np.bincount(inverse, np.concatenate([p[i] for p in parts])) for i in (1, 2))
        by, bounds = c.split_by(_CLASSES - np.frexp(count)[1], _CLASSES)
        place = np.empty(len(by), np.uint32)
        place[by] = np.arange(len(by))
        _write(f"{folder}/{k}.words", known.tobytes() + place.tobytes() + ahead[by].astype(np.uint32).tobytes())
        most = np.argsort(-count, kind="stable")[:_TOP]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k]), pa.array([np.diff(bounds).tolist()]), pa.array([int(ahead.sum())]), pa.array([int(count.sum())]), pa.array([known[most].view(np.int64).tolist()]), pa.array([count[most].astype(int).tolist()])],
            names=["file", "sizes", "ahead", "total", "top", "counts"],
        )

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    sums = c.to_shards(texts.mapInArrow(pairs, "shard int, rows binary"), "shard").mapInArrow(counted, "shard int, rows binary")
    sizes, ahead, total, top = np.zeros((files, _CLASSES), np.int64), 0, 0, {}
    # one row for each of _FILES files at most, with _TOP words
    for r in _without_leftovers(spark, lambda: sums.repartitionById(files, F.col("shard")).mapInArrow(stored, "file long, sizes array<long>, ahead long, total long, top array<long>, counts array<long>").collect()):
        sizes[r["file"]] = r["sizes"]
        ahead += r["ahead"]
        total += r["total"]
        top |= dict(zip(r["top"], r["counts"]))
    return Vocabulary(folder, sizes, ahead, total, top)


def _coded(by: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, columns: list[np.ndarray], n: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Pairs for each shard: the hashes they use, codes for these (the first column ascends), and how many of each."""
    code = np.empty(len(hashes), np.int64)
    for s in range(shards):
        m = by[bounds[s] : bounds[s + 1]]
        if len(m):
            # by what the shard gets, not by all hashes of the slice
            used = c.uniques(np.concatenate([x[m] for x in columns]))
            code[used] = np.arange(len(used))
            yield s, c.pack(hashes[used], c.narrow(np.diff(code[columns[0][m]], prepend=0)), c.narrow(code[columns[1][m]]), n[m])


def _without_leftovers(spark: SparkSession, job: Callable[[], object]) -> object:
    """Plan and run a job whose shuffle files go when it ends; what it exchanged lies in the shared folder then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return job()
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


class Deal:
    """Which shard holds a context, and which of its files: by the last word, for hot words (shards) and long ones (files)
    by the one before that as well."""

    def __init__(self, shards: int, hot: np.ndarray, splits: np.ndarray, long: np.ndarray, pieces: np.ndarray) -> None:
        self.shards, self.hot, self.splits, self.long, self.pieces = shards, hot, splits, long, pieces  # hot, long: ids, ascending

    @staticmethod
    def of(known: Vocabulary, shards: int, order: int, long: bool = False) -> Deal:
        """long: whether n-grams of long words are to go to several files."""
        share = max(1.0, known.total / shards)
        hashes = np.array([h for h, n in known.top.items() if n > max(1.0, _HOT) * share] if order > 2 else [], np.int64).view(np.uint64)
        ids = known.ids(hashes)
        by = np.argsort(ids)
        deal = Deal(shards, ids[by].astype(np.int64), np.array([math.ceil(known.top[int(h)] / share) for h in hashes.view(np.int64)], np.int64)[by], *[np.zeros(0, np.int64)] * 2)
        some = [(h, n) for h, n in known.top.items() if n > _LONG] if long and order > 2 else []
        ids = known.ids(np.array([h for h, _ in some], np.int64).view(np.uint64)).astype(np.int64)
        pieces = -(-np.array([n for _, n in some], np.int64) // (_LONG * deal.split(ids)))
        by = np.argsort(ids)
        by = by[pieces[by] > 1]
        deal.long, deal.pieces = ids[by], pieces[by]
        return deal

    def piece(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Which file of its part each n-gram is in; ids of the last word of its context and of the one before."""
        out = np.zeros(len(last), np.uint32)
        if len(self.long):
            at = np.minimum(np.searchsorted(self.long, last), len(self.long) - 1)
            hit = np.flatnonzero(self.long[at] == last)
            # other bits than those that choose the shard
            out[hit] = (c.mix(before[hit].astype(np.uint64)) >> c.U64(40)).astype(np.int64) % self.pieces[at[hit]]
        return out

    def split(self, ids: np.ndarray) -> np.ndarray:
        """How many shards the contexts are dealt to that end in each word."""
        out = np.ones(len(ids), np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, ids), len(self.hot) - 1)
            hit = self.hot[at] == ids
            out[hit] = self.splits[at[hit]]
        return out

    def shard(self, ids: np.ndarray, last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """ids of codes; codes of the last word of each context and of the one before."""
        mixed = c.mix(ids.astype(np.uint64))
        out = (mixed % c.U64(self.shards)).astype(np.int64)[last]
        if len(self.hot):
            splits = self.split(ids)[last]
            some = np.flatnonzero(splits > 1)
            out[some] = (out[some] + (mixed[before[some]] >> c.U64(20)).astype(np.int64) % splits[some]) % self.shards
        return out


def _grams(texts: pa.Array, order: int, known: Vocabulary, deal: Deal) -> tuple[np.ndarray, Iterator[tuple[int, bytes]]]:
    """Offsets of texts; for each shard the n-grams of the contexts that it holds, as ids, with the text of each."""
    offsets, columns, hashes = windows(texts, order)
    ids = known.ids(hashes)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def packed() -> Iterator[tuple[int, bytes]]:
        by, bounds = c.split_by(deal.shard(ids, columns[1], columns[2] if order > 2 else None), deal.shards)
        for s in range(deal.shards):
            m = by[bounds[s] : bounds[s + 1]]
            if len(m):
                # words of one context together: the column of the word before shrinks to almost nothing
                m = m[np.argsort(ids[columns[1][m]], kind="stable")]
                before = ids[columns[1][m]]
                yield s, c.pack(np.diff(before, prepend=np.uint32(0)), *(ids[columns[k][m]] for k in (0, *range(2, order))), c.narrow(of[m]))

    return offsets, packed()


def _received(blobs: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of ids of all n-grams of a shard, and the texts that those of each blob are in."""
    parts = [c.unpack(b) for b in blobs]
    blobs.clear()
    of = [p.pop() for p in parts]
    others = []
    for _ in range(1, order):
        # what is joined goes, so that no column is there twice for long
        others.append(np.concatenate([p.pop() for p in parts]))
    first = np.concatenate([np.cumsum(p.pop(), dtype=np.uint32) for p in parts])
    return [others.pop(), first, *others[::-1]], of


def _parts(columns: list[np.ndarray], deal: Deal) -> Iterator[tuple[str, np.ndarray, list[np.ndarray]]]:
    """The n-grams of each file of a shard, what the file is called after the shard, and which rows they are."""
    most = int(max(deal.pieces, default=1))
    file = np.empty(len(columns[0]), np.uint32)
    for a in range(0, len(file), _LONG):
        some = columns[1][a : a + _LONG]
        part = c.mix(some.astype(np.uint64)) // c.U64(deal.shards) % c.U64(_PARTS_OF_SHARD)
        file[a : a + _LONG] = part.astype(np.uint32) * np.uint32(most) + (deal.piece(some, columns[2][a : a + _LONG]) if most > 1 else np.uint32(0))
    by, bounds = c.split_by(file, _PARTS_OF_SHARD * most)
    del file
    for k in np.flatnonzero(np.diff(bounds)):
        rows = by[bounds[k] : bounds[k + 1]]
        yield f"{k // most}" + (f".{k % most}" if k % most else ""), rows, [x[rows] for x in columns]


def _pairs(columns: list[np.ndarray], model: Model) -> dict[int, str | np.ndarray]:
    """What hot_pairs() stores, of hot words as files; of the other long words of a shard, which has all their contexts, as
    arrays."""
    out: dict[int, str | np.ndarray] = dict(model.pairs)
    for word in model.deal.long.tolist():
        rows = np.flatnonzero(columns[1] == word) if word not in out else ()
        if len(rows):
            pairs = c.uniques(columns[2][rows].astype(np.uint64) << c.U64(32) | columns[0][rows].astype(np.uint64))
            out[word] = np.stack([x.astype(np.uint32) for x in np.unique(pairs & c.U64(0xFFFFFFFF), return_counts=True)])
    return out


def _distinct(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct n-grams in the order of contexts read backwards, then the word; how many of each; where each row is."""
    key, most = columns[1].astype(np.int64), size
    for x in [*columns[2:], columns[0]]:
        if most * size >= 1 << 63:
            # places among what there is take fewer bits, and leave room for another id
            _, key, n = _grouped(key)
            most = len(n)
        key, most = key * size + x, most * size
    first, inverse, n = _grouped(key)
    return [x[first] for x in columns], n, inverse


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct key, ascending, a row that has it; which of them each row has; how many rows have each."""
    by = np.argsort(key)
    at = key[by]
    new = np.ones(len(key), bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    inverse = np.empty(len(key), np.int64)
    inverse[by] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return by[begin], inverse, np.diff(np.append(begin, len(key)))


def hot_pairs(docs: DataFrame, known: Vocabulary, deal: Deal) -> None:
    """Of each hot word a file in the vocabulary's folder: the words after it and before how many different words each such
    pair stands after. No shard has all contexts of such a word, so none could count them. Pairs are dealt by both words, and
    what goes on to the task of a hot word is a row for each different word after it."""
    spark, shards = docs.sparkSession, deal.shards

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.gathered(batches, c.slice_bytes(shards)):
            _, (word, last, before), hashes = windows(part.column("text"), 3)
            ids = known.ids(hashes)
            m = np.flatnonzero((deal.split(ids) > 1)[last])
            if len(m):
                (before, last, word), _, _ = _distinct([before[m], last[m], word[m]], len(ids))
                spread = c.mix(ids[last].astype(np.uint64) << c.U64(32) | ids[word].astype(np.uint64)) % c.U64(shards)
                by, bounds = c.split_by(spread.astype(np.int64), shards)
                mine = [by[bounds[s] : bounds[s + 1]] for s in range(shards)]
                yield _rows((s, c.pack(*(ids[x[at]] for x in (last, word, before)))) for s, at in enumerate(mine) if len(at))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, blobs = _taken(batches)
        if blobs:
            last, word, before = (np.concatenate(x) for x in zip(*(c.unpack(b) for b in blobs)))
            # in the order of last, word, before
            (_, last, word), _, _ = _distinct([before, last, word], known.words + 2)
            pair = np.flatnonzero(np.append(True, (last[1:] != last[:-1]) | (word[1:] != word[:-1])))
            last, word, n = last[pair], word[pair], np.diff(np.append(pair, len(last)))
            begin = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
            for a, b in zip(begin, np.append(begin[1:], len(last))):
                yield _rows([(int(np.searchsorted(deal.hot, last[a])), c.pack(word[a:b], n[a:b].astype(np.uint32)))])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, blobs = _taken(batches)
        if blobs:
            word, n = (np.concatenate(x) for x in zip(*(c.unpack(b) for b in blobs)))
            by = np.argsort(word)
            _write(f"{known.folder}/{deal.hot[k]}.pairs", np.stack([word[by], n[by]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([len(word)])], names=["n"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = "shard int, rows binary"
    _without_leftovers(spark, lambda: texts.mapInArrow(send, rows).repartitionById(shards, F.col("shard")).mapInArrow(count, rows).repartitionById(len(deal.hot), F.col("shard")).mapInArrow(store, "n long").agg(F.sum("n")).collect())


def build(columns: list[np.ndarray], n: np.ndarray, size: int, hot: dict[int, str | np.ndarray] | None = None) -> bytes:
    """A file of a shard; columns and n: from _distinct; size: more than any id; hot: of words dealt to several files, see _pairs."""
    order = len(columns)
    node, parents, labels = np.zeros(len(n), np.int64), [], []
    new = np.zeros(len(n), bool)
    new[:1] = True
    for x in columns[1:]:
        # n-grams with one context lie together
        new[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(new)
        parents.append(node[first])
        labels.append(x[first].astype(np.int64))
        node = np.cumsum(new) - 1
    keys, values = [node * size + columns[0]] * order, [n] * order
    for k in range(order - 2, -1, -1):
        longer = keys[k + 1]
        keys[k], values[k] = np.unique(parents[k][longer // size] * size + longer % size, return_counts=True)
    mine = np.flatnonzero(np.isin(labels[0], list(hot))) if hot else ()
    more = {int(u): np.fromfile(x, np.uint32).reshape(2, -1) if isinstance(x := hot[int(labels[0][u])], str) else x for u in mine}
    for u, (word, after) in more.items():
        # this file has some of the contexts only, but their shorter one whole
        a, b = np.searchsorted(keys[1], (u * size, u * size + size))
        keys[1] = np.concatenate([keys[1][:a], u * size + word.astype(np.int64), keys[1][b:]])
        values[1] = np.concatenate([values[1][:a], after.astype(np.int64), values[1][b:]])
    if more:
        keys[0] = c.uniques(np.concatenate([keys[0], *(word.astype(np.int64) for word, _ in more.values())]))
    heads: list[dict] = []
    blobs: list[np.ndarray] = []

    def put(head: dict, arrays: list[np.ndarray]) -> None:
        heads.append(head | {"arrays": [[a.dtype.str, len(a)] for a in arrays]})
        blobs.extend(arrays)

    def ranged(begin: np.ndarray, inside: np.ndarray) -> np.ndarray:
        base = np.concatenate([[0], np.cumsum(inside[np.append(begin[1:], len(inside)) - 1])[:-1]])
        return inside + np.repeat(base, np.diff(np.append(begin, len(inside))))

    put({"size": size}, [])
    put(*encode(keys[0]))
    above, above_begin = keys[0], np.zeros(1, np.int64)
    for k in range(1, order):
        key, v = keys[k], values[k].astype(np.float64)
        node, word = key // size, key % size
        begin = np.flatnonzero(np.diff(node, prepend=-1))
        sizes = np.diff(np.append(begin, len(key)))
        up = parents[k - 1][node]
        rank = np.searchsorted(above, up * size + word) - above_begin[up]
        first = np.flatnonzero(np.diff(parents[k - 1], prepend=-1))
        put(*encode(np.append(first, len(parents[k - 1]))))
        put(*encode(ranged(first, labels[k - 1])))
        put(*encode(np.append(begin, len(key))))
        put(*encode(ranged(begin, rank)))
        total = np.add.reduceat(v, begin)
        for x in ((v - DISCOUNT) / total[node], DISCOUNT * sizes / total):
            head, code = _quantised(np.log2(x))
            put(head, [code])
        above, above_begin = key, begin
    head = json.dumps(heads).encode()
    out, at = [np.array([len(head)], "<u8").tobytes(), head], 8 + len(head)
    for a in blobs:
        pad = -at % 8
        out += [bytes(pad), a.tobytes()]
        at += pad + a.nbytes
    return b"".join(out)


def _quantised(x: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    low, step = float(x.min()), max(float(np.ptp(x)) / 255, 1e-12)
    return {"low": low, "step": step}, np.rint((x - low) / step).astype(np.uint8)


class Shard:
    """A shard's file, mapped. A level has contexts (parent, label) and successors (context, rank among the parent's)."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        at = 8 + int(raw[:8].view("<u8")[0])
        self._parts = []
        for head in json.loads(raw[8:at].tobytes()):
            arrays = []
            for kind, n in head["arrays"]:
                at += -at % 8
                end = at + n * np.dtype(kind).itemsize
                arrays.append(raw[at:end].view(kind))
                at = end
            self._parts.append((head, arrays))
        self.size = self._parts[0][0]["size"]
        self.words = self._all(1)

    def _all(self, part: int) -> np.ndarray:
        return Sequence(*self._parts[part]).all()

    def _inside(self, begin: np.ndarray, part: int) -> np.ndarray:
        values = self._all(part)
        return values - np.repeat(np.where(begin[:-1] > 0, values[begin[:-1] - 1], 0), np.diff(begin))

    def _levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each level: its first part, the parent of each context, the context of each successor and the place of the
        same word in the level above, what the two quantised columns stand for."""
        begins = np.array([0])
        for i in range(2, len(self._parts), 6):
            first, begin = self._all(i), self._all(i + 2)
            parent = np.repeat(np.arange(len(first) - 1), np.diff(first))
            node = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            place = begins[parent[node]] + self._inside(begin, i + 3)
            share, back = (np.exp2(h["low"] + h["step"] * np.arange(256))[a[0]] for h, a in self._parts[i + 4 : i + 6])
            yield i, first, parent, node, place, (share, back)
            begins = begin[:-1]

    def stored(self, alone: np.ndarray) -> np.ndarray:
        """Probabilities of all n-grams of the longest level in their order; alone: those of ``words`` without context.
        Pointers and ranks lead from each to the same word after the shorter context."""
        p = alone
        for _, _, _, node, place, (share, back) in self._levels():
            p = share + back[node] * p[place]
        return p

    def p(self, columns: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams by ids; lower: those of the words without context."""
        size, p, words = self.size, lower.copy(), self.words
        live, node = np.arange(len(p)), np.zeros(len(p), np.int64)
        for i, first, parent, of, place, (share, back) in self._levels():
            at = _find(parent * size + self._inside(first, i + 1), node * size + columns[1 + (i - 2) // 6][live])
            live, node = live[at >= 0], at[at >= 0]
            words = words[place]
            at = _find(of * size + words, node * size + columns[0][live])
            p[live] = np.where(at >= 0, share[at], 0) + back[node] * p[live]
        return p


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Model:
    """A trained model: its vocabulary, where its contexts are and the folder of its shards."""

    def __init__(self, folder: str, order: int, words: Vocabulary, deal: Deal) -> None:
        self.folder, self.order, self.words, self.deal, self.shards = folder, order, words, deal, deal.shards
        self.pairs = {int(word): f"{words.folder}/{word}.pairs" for word in deal.hot}


def _write(path: str, data: bytes) -> None:
    # a task that runs again leaves the same file
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def _begun(docs: DataFrame, order: int, long: bool = False) -> Model:
    if not 2 <= order <= 5:
        raise ValueError("order must be from 2 to 5")
    folder = c.local_path(c.fresh_dir(docs.sparkSession, "word-model"))
    os.makedirs(folder, exist_ok=True)
    words = vocabulary(docs, folder)
    deal = Deal.of(words, _SHARDS * c.partitions(docs.sparkSession), order, long)
    if len(deal.hot):
        hot_pairs(docs, words, deal)
    return Model(folder, order, words, deal)


def train(docs: DataFrame, order: int = 3) -> Model:
    """Count, smooth and store a model of ``order`` words (2 to 5) in the shared folder, which workers must see as a path.

    Null and empty texts add nothing, texts of any length count whole; repeated rows count each time; other columns are
    ignored; of an empty table the model knows no word.
    """
    model = _begun(docs, order)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in c.gathered(batches, c.slice_bytes(model.shards)):
            yield _rows(_grams(part.column("text"), order, model.words, model.deal)[1])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blobs = _taken(batches)
        if blobs:
            size = model.words.words + 2
            for k, _, columns in _parts(_received(blobs, order)[0], model.deal):
                columns, n, _ = _distinct(columns, size)
                _write(f"{model.folder}/{shard}-{k}.trie", build(columns, n, size, model.pairs))
                yield pa.RecordBatch.from_arrays([pa.array([len(n)])], names=["n"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    _without_leftovers(docs.sparkSession, lambda: texts.mapInArrow(send, "shard int, rows binary").repartitionById(model.shards, F.col("shard")).mapInArrow(store, "n long").agg(F.sum("n")).collect())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words and bits_per_word (mean negative log2 probability of a word) of every row.

    A text without words has 0 words and null bits; a null text has null for both; a null doc_id stays null. Texts of any
    length are scored whole, repeated rows each; other columns, of whatever name, are ignored; an empty table gives no
    rows. Words never seen in training share one word's rest.
    """

    def known(name: str, columns: list[np.ndarray], *_: object) -> np.ndarray:
        words, at = np.unique(columns[0], return_inverse=True)
        lower = model.words.alone(words)[at]
        path = f"{model.folder}/{name}.trie"
        return Shard(path).p(columns, lower) if os.path.exists(path) else lower

    return _scored(docs, model, known)


def scored(docs: DataFrame, order: int = 3) -> DataFrame:
    """What score(docs, train(docs, order)) gives, in one exchange of n-grams; no model stays but its vocabulary."""
    # every n-gram that is looked up is in the files, so each finds the file that has its context
    model = _begun(docs, order, long=True)

    def known(name: str, columns: list[np.ndarray], n: np.ndarray, pairs: dict[int, str | np.ndarray]) -> np.ndarray:
        # a file of the task's own: another attempt at it may run at the same time
        path = f"{model.folder}/{name}-{uuid.uuid4().hex}.trie"
        _write(path, build(columns, n, model.words.words + 2, pairs))
        try:
            trie = Shard(path)
            return trie.stored(model.words.alone(trie.words))
        finally:
            os.unlink(path)

    return _scored(docs, model, known)


def _scored(docs: DataFrame, model: Model, known: Callable[[str, list[np.ndarray], np.ndarray, dict], np.ndarray]) -> DataFrame:
    """known: the probabilities of the distinct n-grams of a file of a shard, from its name, their columns and counts, and
    the shard's _pairs."""
    order, shards = model.order, model.shards

    back = c.partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, task = 0, TaskContext.get().partitionId()
        names = ["shard", "rows", "base", "ids", "n"]

        def dealt(some: list[tuple[int, bytes]], base: int) -> pa.RecordBatch:
            none = pa.nulls(len(some), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*_rows(some).columns, pa.array([base] * len(some), pa.int64()), none, none], names=names)

        for part in c.gathered(batches, c.slice_bytes(shards)):
            offsets, packed = _grams(part.column("text"), order, model.words, model.deal)
            base = (task << 40) + row
            while some := list(islice(packed, _BATCH)):
                yield dealt(some, base)
            # one row has the ids and the numbers of words
            absent = pc.is_null(part.column("text")).to_numpy(zero_copy_only=False)
            n = pa.array(np.diff(offsets), pa.int64(), mask=absent)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column("doc_id"), n)]
            yield pa.RecordBatch.from_arrays([pa.array([(base + task) % shards], pa.int32()), pa.nulls(1, pa.binary()), pa.array([base]), *lists], names=names)
            row += part.num_rows

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blobs, bases = -1, [], []
        for batch in batches:
            for s, blob, base, ids, n in zip(*(batch.column(k) for k in ("shard", "rows", "base", "ids", "n"))):
                if blob.is_valid:
                    shard = s.as_py()
                    blobs.append(blob.as_py())
                    bases.append(base.as_py())
                else:
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x.values)], pa.int32()), x.values) for x in (ids, n)]
                    yield pa.RecordBatch.from_arrays([to([base.as_py()]), pa.array([base.as_py()]), pa.nulls(1, pa.binary()), *lists], schema=_PARTS)
        if not blobs:
            return
        c.trim()  # what the tasks before this one left would stay beside what this one needs
        columns, of = _received(blobs, order)
        bits, pairs = np.empty(len(columns[0])), _pairs(columns, model)
        for k, rows, some in _parts(columns, model.deal):
            some, n, inverse = _distinct(some, model.words.words + 2)
            bits[rows] = -np.log2(known(f"{shard}-{k}", some, n, pairs))[inverse]
        columns.clear()
        ends = np.cumsum([len(x) for x in of])
        for a in range(0, len(bases), _BATCH):
            some = bases[a : a + _BATCH]
            sums = [_summed(x, bits[end - len(x) : end]) for x, end in zip(of[a : a + _BATCH], ends[a : a + _BATCH])]
            none = pa.nulls(len(some), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([to(some), pa.array(some, pa.int64()), pa.array(sums, pa.binary()), none, none], schema=_PARTS)

    def to(bases: list[int]) -> pa.Array:
        return pa.array((c.mix(np.array(bases, np.uint64)) % c.U64(back)).astype(np.int32))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of some slices, each with the sum of what all shards have of it."""
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, tuple[pa.Array, pa.Array]] = {}
        for batch in batches:
            for base, blob, ids, n in zip(*(batch.column(k) for k in ("base", "rows", "ids", "n"))):
                base = base.as_py()
                if not blob.is_valid:
                    # a copy, or all of its batch would stay
                    rows[base] = tuple(x.values.take(pa.array(np.arange(len(x.values)))) for x in (ids, n))
                    continue
                row, bits = c.unpack(blob.as_py())
                row = np.cumsum(row, dtype=np.int64)
                if len(held := sums.get(base, bits[:0])) <= row[-1]:
                    held = sums[base] = np.append(held, np.zeros(int(row[-1]) + 1 - len(held)))
                held[row] += bits
        for base, (ids, n) in rows.items():
            bits = sums.pop(base, np.zeros(0))
            yield pa.RecordBatch.from_arrays([ids, n, pa.array(np.append(bits, np.zeros(len(ids) - len(bits))))], schema=_SUMS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = rows.mapInArrow(send, "shard int, rows binary, base long, ids array<long>, n array<long>")
    # the number of shards is the model's, whatever the session has now
    parts = sent.repartitionById(shards, F.col("shard")).mapInArrow(look, "to int, base long, rows binary, ids array<long>, n array<long>")
    sums = parts.repartitionById(back, F.col("to")).mapInArrow(whole, "doc_id long, n_words long, bits double")
    return sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("bits") / F.col("n_words")).alias("bits_per_word"))


def _summed(of: np.ndarray, bits: np.ndarray) -> bytes:
    """The sums by text of what a shard has of a slice: distances of the texts, and sums."""
    sums, n = np.bincount(of, bits), np.bincount(of)
    row = np.flatnonzero(n)
    return c.pack(c.narrow(np.diff(row, prepend=0)), sums[row])
