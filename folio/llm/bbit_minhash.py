"""Near-duplicate documents by b-bit MinHash.

A document is the set of its word 3-grams (words in lower case, without punctuation). Of each of 128 minima four low
bits are kept, 64 bytes a document; two documents match in a share of nibbles that, corrected for chance collisions,
estimates their Jaccard similarity. Candidates are documents that agree in all full minima of one of 32 bands.
Long buckets are found from a sample and searched in blocks. Inside a bucket the matching candidates are joined by searching outward from one document after another, so
a tight group of m copies costs m comparisons, not m * m, and no pair that could join two groups is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common as c
from folio.llm.components import components
from folio.llm.repeats import searched

BITS, PERMUTATIONS, BANDS, SHINGLE = 4, 128, 32, 3
#: Candidates from which a bucket is long, and the share of candidates that is looked at to see which are.
LONG, _SAMPLE = 4096, 0.02
_ROWS = PERMUTATIONS // BANDS
_LOW = c.U64(0x1111111111111111)
_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_BAND = _rng.integers(0, 1 << 63, _ROWS, dtype=np.uint64) | c.U64(1)
_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
_strip = re.compile(r"[\W_]+").sub


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and 32-bit hashes of each text's shingles; fewer words than a shingle count as one shingle."""
    offsets, codes, words = c.word_codes(texts)
    plain = [_strip("", w.lower()) for w in words]
    hashes = c.hash_words(plain)
    real = np.fromiter((bool(w) for w in plain), bool, len(plain))[codes]
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    hashed = hashes[codes[real]]
    n = np.diff(offsets)
    counts = np.where(n > 0, np.maximum(1, n - SHINGLE + 1), 0)
    out = np.zeros(int(counts.sum()), np.uint64)
    ends = np.cumsum(counts)
    whole = np.repeat(n >= SHINGLE, counts)
    out[whole] = c.rolling(hashed, SHINGLE)[c.starts_of_windows(offsets, SHINGLE)] if whole.any() else 0
    for width in range(1, SHINGLE):
        short = n == width
        if short.any():
            out[(ends - counts)[short]] = c.rolling(hashed, width)[offsets[:-1][short]]
    return np.concatenate([[0], ends]), (out >> c.U64(32)).astype(np.uint32)


def minima(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation for each document that has shingles."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), PERMUTATIONS), np.uint32)
    if len(starts):
        work = np.empty_like(hashes)
        for k in range(PERMUTATIONS):
            np.multiply(hashes, _MUL[k], out=work)
            np.add(work, _ADD[k], out=work)
            out[:, k] = np.minimum.reduceat(work, starts)
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] | low[:, 1::2] << 4


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(len(least), BANDS, _ROWS).astype(np.uint64)
    return c.mix((rows * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * c.U64(0x9E3779B97F4A7C15)).view(np.int64)


def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates from packed signatures, given as rows of eight 64-bit words."""
    x = one ^ others
    x = x | x >> c.U64(1)
    x = (x | x >> c.U64(2)) & _LOW
    match = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / PERMUTATIONS
    chance = 2.0**-BITS
    return (match - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, the packed signature and the band keys of every document that has words."""

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                offsets, hashes = shingles(part.column("text"))
                least = minima(offsets, hashes)
                some = np.diff(offsets) > 0
                sig = packed_bits(least)
                keys = band_keys(least)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1)))
                width = pa.array(np.arange(0, sig.size + 1, sig.shape[1]), pa.int32())
                packed = pa.Array.from_buffers(pa.binary(), len(sig), [None, width.buffers()[1], pa.py_buffer(np.ascontiguousarray(sig).tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(k).filter(pa.array(some)) for k in ("doc_id", "text_hash")), packed, bands], schema=_SIGNED)

    return searched(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, sig binary, bands array<long>")


def links(ids: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the matches among candidates."""
    rest = np.arange(len(ids))
    a: list[int] = []
    b: list[int] = []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = similarity(sig[at], sig[rest]) >= threshold
            for j in rest[near]:
                a.append(int(ids[at]))
                b.append(int(ids[j]))
            front += rest[near].tolist()
            rest = rest[~near]
    return a, b


def groups(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Near-duplicate groups of at least two documents: doc_id, group_id (the least doc_id), keep (the first of all).

    docs needs doc_id and text. Two documents are near duplicates if they share a band and their estimated Jaccard
    similarity reaches ``threshold``; groups are the connected components.

    Null doc_id or text and texts without a letter or digit are in no group; rows that repeat a doc_id are one
    document if their signatures are equal and else join the groups of each; texts of any length count whole; other
    columns are ignored; an empty table has no groups.
    """
    return _groups(c.keep(signatures(docs), "minhash"), threshold)


def _groups(signed: DataFrame, threshold: float) -> DataFrame:
    spark = signed.sparkSession
    # documents with the same minima throughout are one candidate
    same = c.keep(signed.groupBy("sig", "bands").agg(F.min("doc_id").alias("rep")), "minhash-same")
    copies = signed.select("doc_id", "sig", F.xxhash64("bands").alias("h")).join(same.select("rep", "sig", F.xxhash64("bands").alias("h")), ["sig", "h"])
    banded = same.select("rep", F.explode("bands").alias("band"))
    # a sample only says which buckets are long and go in blocks; either way all of their pairs are searched
    sampled = same.sample(fraction=_SAMPLE, seed=5).select(F.explode("bands").alias("band")).groupBy("band").count()
    hot = c.keep(sampled.where(F.col("count") >= max(2, _SAMPLE * LONG)).select("band"), "minhash-long")
    some = not hot.isEmpty()
    buckets = (
        (banded.join(hot, "band", "left_anti") if some else banded)
        .groupBy("band").agg(F.sort_array(F.collect_set("rep")).alias("reps"))
        .where(F.size("reps") > 1).select("reps").distinct()
        .select(F.xxhash64("reps").alias("bucket"), F.explode("reps").alias("rep"))
    )
    filled = buckets.join(same.select("rep", "sig"), "rep").groupBy("bucket").agg(F.collect_list(F.struct("rep", "sig")).alias("found")).select("found")

    @c.tidy
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for found in batch.column("found"):
                ids = found.values.field("rep").to_numpy()
                sig = np.frombuffer(b"".join(found.values.field("sig").to_pylist()), np.uint64).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                x, y = links(ids[order], sig[order], threshold)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    near = filled.mapInArrow(match, "a long, b long")
    if some:
        near = near.union(_in_blocks(same, hot, threshold, c.partitions(spark)))
    found = components(near.union(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))).where("a <> b").distinct())
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"), (F.col("node") == F.col("component")).alias("keep"))


def _in_blocks(same: DataFrame, hot: DataFrame, threshold: float, shards: int) -> DataFrame:
    """Links within long buckets: each is dealt into parts of about LONG candidates, and each pair of parts is searched by
    itself, so that no bucket is one task's."""
    rows = same.select("rep", "sig", F.explode("bands").alias("band")).join(hot, "band")
    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / LONG).cast("long").alias("parts"))
    own = F.pmod(F.xxhash64("rep", "band"), F.col("parts"))
    cells = rows.join(sizes, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "rep", "sig")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in c.runs_of(batches, "cell"):
            ids = table.column("rep").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            x, y = links(ids[order], sig[order], threshold)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return cells.repartition(shards, "cell").sortWithinPartitions("cell").mapInArrow(match, "a long, b long")


def first_of_each(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of each near-duplicate group, the one of the least doc_id, and all rows in none.

    Rows that repeat a doc_id with another text are documents of their own; of rows that repeat both the least stays, in
    the order of their columns. Rows with a null doc_id all stay, and so do null and empty texts. Texts of any length
    count whole. Columns stay as they are; an empty table gives no rows. Texts are not shuffled while what goes is few
    enough to broadcast (c.BROADCAST_ROWS).
    """
    signed = c.keep(signatures(docs), "minhash")
    texts = signed.select("doc_id", "text_hash").distinct()
    # an id with several texts: its least keeps the id, each other one gets a new id above all
    least = texts.groupBy("doc_id").agg(F.min("text_hash").alias("least"), F.count("*").alias("n")).where("n > 1")
    others = texts.join(least, "doc_id").where("text_hash <> least").select("doc_id", "text_hash")
    others = c.keep(others.orderBy("doc_id", "text_hash").withColumn("unit", F.monotonically_increasing_id()), "minhash-rows")
    if others.isEmpty():
        units = signed.select("doc_id", "text_hash", F.col("doc_id").alias("unit"), "sig", "bands")
        gone = _groups(signed.select("doc_id", "sig", "bands"), threshold).where("NOT keep").select(F.col("doc_id").alias("unit"))
        gone = gone.join(units.select("doc_id", "text_hash", "unit"), "unit")
    else:
        above = signed.agg(F.max("doc_id") + 1).first()[0]
        units = c.keep(signed.join(others, ["doc_id", "text_hash"], "left").withColumn("unit", F.coalesce(F.col("unit") + above, "doc_id")), "minhash-units")
        gone = _groups(units.select(F.col("unit").alias("doc_id"), "sig", "bands"), threshold).where("NOT keep").select(F.col("doc_id").alias("unit"))
        gone = gone.join(units.select("doc_id", "text_hash", "unit"), "unit")
    hash_name, id_name = c.unused(docs, "__hash"), c.unused(docs, "__id")
    key = [F.col("doc_id").cast("long").alias(id_name), F.xxhash64(F.col("text").cast("string")).alias(hash_name)]
    gone = c.few(c.keep(gone.select(F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)).distinct(), "minhash-gone"))
    left = docs.select("*", *key).join(gone, [id_name, hash_name], "left_anti")
    again = docs.select(*key).where(F.col(id_name).isNotNull()).groupBy(id_name, hash_name).count().where("count > 1").select(id_name, hash_name)
    again = c.few(c.keep(again, "minhash-again"))
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(again, [id_name, hash_name], "left_anti").select(*docs.columns)
    rows = F.struct(*docs.columns)
    repeated = left.join(again, [id_name, hash_name], "left_semi").groupBy(id_name, hash_name, F.col("text").alias(c.unused(docs, "__text"))).agg(F.min_by(rows, F.to_json(rows)).alias("row"))
    return once.union(repeated.select("row.*"))
