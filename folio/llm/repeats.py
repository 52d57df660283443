"""Word positions whose text repeats in the corpus: fingerprints to shards, classes of equal text, maximal runs.

An occurrence is (doc_id, number of words of the document, word position); rows that repeat a document are one
occurrence. Of equal texts the least occurrence is the original, all others repeat it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common as c

PACKED = "shard int, rows binary"
_PACKED = pa.schema([("shard", pa.int32()), ("rows", pa.binary())])
SPANS = "doc_id long, n_words long, start_word long, length long, ref_doc_id long, ref_start_word long"
_SPANS = pa.schema([(x.split()[0], pa.int64()) for x in SPANS.split(", ")])

Columns = tuple[np.ndarray, ...]


def fingerprints(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order keys of the suffixes cut at ``width`` words, and bits independent of them that choose the shard.

    A key compares the first half of the window, then the second: equal keys mean ``width`` equal words, equal
    upper halves mean width // 2 of them.
    """
    half = width // 2
    first = c.rolling(words, half)[: max(0, len(words) - width + 1)]
    second = c.rolling(words, width - half)[half:]
    keys = (first >> c.U64(32) << c.U64(32)) | (second >> c.U64(32))
    return keys, (first + second * c.U64(31)) & c.U64(0xFFFFFFFF)


def pack_windows(ids: np.ndarray, offsets: np.ndarray, at: np.ndarray, keys: np.ndarray, spread: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Windows at flat positions ``at`` (ascending), as one packed row for each shard, with the documents that it needs."""
    order, bounds = c.split_by(spread % c.U64(shards), shards)
    of = np.searchsorted(offsets, at, "right") - 1
    starts, sizes = offsets[:-1], np.diff(offsets)
    for s in range(shards):
        mine = order[bounds[s] : bounds[s + 1]]
        if len(mine):
            held = of[mine]
            held = held[np.append(True, np.diff(held) != 0)]
            # the keys are noise: only the other columns gain by compression
            yield s, c.pack(np.diff(ids[held], prepend=0), c.narrow(np.diff(starts[held], prepend=0)), c.narrow(sizes[held]), c.narrow(np.diff(at[mine], prepend=0)), keys[mine])


def unpack_windows(blob: bytes) -> Columns:
    """keys, doc_id, number of words, position in the document."""
    ids, starts, sizes, at, keys = c.unpack(blob)
    ids, starts, at = np.cumsum(ids), np.cumsum(starts, dtype=np.int64), np.cumsum(at, dtype=np.int64)
    of = np.searchsorted(starts, at, "right") - 1
    return keys, ids[of], sizes[of].astype(np.uint32), (at - starts[of]).astype(np.uint32)


def searched(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def windows(docs: DataFrame, width: int, key_of: Callable[[np.ndarray], Columns], shards: int | None = None) -> DataFrame:
    """Every window of ``width`` words of every document, packed for the shard of its text."""
    shards = shards or c.partitions(docs.sparkSession)

    def rows(part: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        # columns go as soon as they have been used, and all of them before the next slice
        offsets, codes, words = c.word_codes(part.column("text"))
        at = c.starts_of_windows(offsets, width)
        if not len(at):
            return iter(())
        hashes = c.hash_words(words)[codes]
        del codes, words
        keys, spread = key_of(hashes)
        del hashes
        keys = keys[at]
        spread = spread[at]
        return pack_windows(part.column("doc_id").to_numpy(), offsets, at, keys, spread, shards)

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, most=c.slice_bytes(shards)):
                if (found := packed(rows(part))).num_rows:
                    yield found

    return searched(docs).mapInArrow(run, PACKED)


def packed(rows: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)


def by_document(columns: Columns, shards: int) -> pa.RecordBatch:
    """Occurrences (doc_id, words, position, then any others), packed for the shard of their document."""
    spread = c.mix(columns[0].astype(np.int64).view(c.U64)) % c.U64(shards)
    order = np.lexsort((columns[2], columns[1], columns[0], spread))
    bounds = np.searchsorted(spread[order], np.arange(shards + 1, dtype=c.U64))

    def rows() -> Iterator[tuple[int, bytes]]:
        for s in range(shards):
            mine = order[bounds[s] : bounds[s + 1]]
            if len(mine):
                doc, size, pos, *more = (x[mine] for x in columns)
                yield s, c.pack(np.diff(doc, prepend=0), size, np.diff(pos.astype(np.int64), prepend=0), *more)

    return packed(rows())


def from_document(blobs: list[bytes]) -> list[np.ndarray]:
    """What by_document packed, sorted by occurrence, each once."""
    parts = []
    for blob in blobs:
        doc, size, pos, *more = c.unpack(blob)
        parts.append([np.cumsum(doc), size, np.cumsum(pos), *more])
    columns = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    columns = [x[order] for x in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(x) != 0 for x in columns[:3]], axis=0)
    return [x[new] for x in columns]


def classes(key: np.ndarray, doc: np.ndarray, size: np.ndarray, pos: np.ndarray) -> tuple[Columns, Columns]:
    """The least occurrence of each key, keys ascending; and every other occurrence, with its key in front."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    lone = first.copy()
    lone[:-1] &= first[1:]
    again = np.flatnonzero(~lone)
    if len(again):
        # only classes of several need the occurrences in order
        o = order[again]
        order[again] = o[np.lexsort((pos[o], size[o], doc[o], key[again]))]
    doc, size, pos = doc[order], size[order], pos[order]
    owner = np.flatnonzero(first)[np.cumsum(first) - 1] if len(key) else order
    other = ~first & ((doc != doc[owner]) | (size != size[owner]) | (pos != pos[owner]))
    return tuple(x[first] for x in (key, doc, size, pos)), tuple(x[other] for x in (key, doc, size, pos))


def runs(found: DataFrame, width: int, shards: int | None = None) -> DataFrame:
    """Neighbouring repeated windows that follow one original become one maximal span. shards: of ``found``."""

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column("rows").to_pylist()]
        if not blobs:
            return
        doc, size, pos, ref, shift = from_document(blobs)
        cut = np.ones(len(doc), bool)
        cut[1:] = np.any([np.diff(x) != 0 for x in (doc, size, ref, shift)] + [np.diff(pos) != 1], axis=0)
        at = np.flatnonzero(cut)
        length = np.diff(np.append(at, len(doc))) + width - 1
        out = [doc[at], size[at], pos[at], length, ref[at], pos[at] + shift[at]]
        for a in range(0, len(at), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 20_000].astype(np.int64)) for x in out], schema=_SPANS)

    return found.repartitionById(shards or c.partitions(found.sparkSession), F.col("shard")).mapInArrow(run, SPANS)


def with_copies(docs: DataFrame, width: int, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The spans that ``find`` gives for all documents, found among those that are no exact copy of another.

    Of texts that are equal (by a 64-bit hash and their length) the one of the least doc_id is searched. The others have
    its spans, and repeat it wherever it repeats nothing; so a text that a third of all rows hold is searched once.
    """
    rows = searched(docs).withColumn("h", F.xxhash64("text")).withColumn("n", F.length("text"))
    several = rows.groupBy("h", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    several = c.few(c.keep(several, "copied-texts"))
    if several.isEmpty():
        return find(docs)
    found = c.keep(find(rows.join(several, ["h", "n"], "left").where("first IS NULL OR first = doc_id").select("doc_id", "text")), "spans-of-firsts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(c.word_counts(part.column("text")))], names=["doc_id", "n_words"])

    members = rows.select("doc_id", "h", "n").join(several, ["h", "n"]).where("doc_id <> first").select("doc_id", "first").distinct()
    firsts = rows.join(several, ["h", "n"]).where("doc_id = first").select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long").distinct()
    # a document's spans are no more than its words
    held = found.groupBy("doc_id", "n_words").agg(F.collect_list(F.struct("start_word", "length", "ref_doc_id", "ref_start_word")).alias("spans"))
    held = firsts.where(F.col("n_words") >= width).join(held, ["doc_id", "n_words"], "left").withColumnRenamed("doc_id", "first")

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for doc, first, size, spans in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "first", "n_words", "spans"))):
                free = np.ones(size - width + 3, bool)
                free[[0, -1]] = False
                for x in spans or ():
                    out.append([doc, size, *x.values()])
                    free[1 + x["start_word"] : 2 + x["start_word"] + x["length"] - width] = False
                edges = np.flatnonzero(np.diff(free)).reshape(-1, 2)
                out += [[doc, size, int(a), int(b - a) + width - 1, first, int(a)] for a, b in edges]
            for a in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[a : a + 20_000])], schema=_SPANS)

    return found.union(members.join(held, "first").select("doc_id", "first", "n_words", "spans").mapInArrow(copied, SPANS))


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents without the words of their spans; a document that had words and keeps none goes.

    ``n_chars`` follows the text where a text changes. Rows without doc_id or text stay as they are. Columns other
    than doc_id, text and n_chars pass through.
    """
    doc_name, cuts_name = c.unused(docs, "__doc"), c.unused(docs, "__cuts")
    per = spans.groupBy(F.col("doc_id").alias(doc_name), F.col("n_words").alias("__words")).agg(F.collect_list(F.struct("start_word", "length")).alias("__cut"))
    per = per.groupBy(doc_name).agg(F.collect_list(F.struct("__words", "__cut")).alias(cuts_name))
    joined = docs.join(per, F.col("doc_id").cast("long") == F.col(doc_name), "left").drop(doc_name)
    schema = docs.schema

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(cuts_name)
            names = [n for n in batch.schema.names if n != cuts_name]
            touched = np.flatnonzero(pc.is_valid(cuts).to_numpy(zero_copy_only=False))
            plain = batch.select(names)
            if not len(touched):
                yield plain
                continue
            texts = plain.column("text")
            kept = np.ones(batch.num_rows, bool)
            new: dict[int, str] = {}
            for i in touched:
                text = texts[i].as_py()
                left = without(text, cuts[i].as_py())
                if left is not None:
                    new[int(i)] = left
                    kept[i] = bool(left.strip())
            columns = {n: plain.column(n) for n in names}
            columns["text"] = replaced(columns["text"], new)
            if "n_chars" in columns:
                columns["n_chars"] = replaced(columns["n_chars"], {i: len(t) for i, t in new.items()})
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=plain.schema).filter(pa.array(kept))

    return joined.mapInArrow(run, schema)


def replaced(column: pa.Array, new: dict[int, object]) -> pa.Array:
    mask = np.zeros(len(column), bool)
    mask[list(new)] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in sorted(new)], column.type)) if new else column


def without(text: str, cuts: list[dict]) -> str | None:
    """The text less its cut words, or None if no cut belongs to a text of so many words."""
    bounds = word_bounds(text)
    mine = [x for entry in cuts if entry["__words"] == len(bounds) for x in entry["__cut"]]
    if not mine:
        return None
    gone = np.zeros(len(bounds) + 1, np.int64)
    for x in mine:
        gone[x["start_word"]] += 1
        gone[min(len(bounds), x["start_word"] + x["length"])] -= 1
    stays = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    if not len(stays):
        return ""
    edges = np.flatnonzero(np.diff(stays) != 1)
    ends = np.append(bounds, len(text))
    pieces = [text[ends[stays[a]] : ends[stays[b] + 1]] for a, b in zip(np.append(0, edges + 1), np.append(edges, len(stays) - 1))]
    return "".join(pieces)


def word_bounds(text: str) -> np.ndarray:
    import re

    return np.fromiter((m.start() for m in re.finditer(r"\S+", text)), np.int64)
