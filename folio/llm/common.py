"""What the training-data operators share: the shared folder, text slicing, word codes, rolling hashes, packed rows.

Packed rows are the exchange format of the position-level operators. One row carries thousands of records for
one target shard as compressed numpy columns, so a record costs a few bytes in the shuffle and no JVM object.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on. Bounds a worker's memory; results don't depend on it.
SLICE_BYTES = 4 << 20
#: For slices whose rows are dealt to many shards: text bytes for each shard, and text bytes at most.
SHARD_BYTES, MOST_SLICE_BYTES = 16 << 10, 16 << 20

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may go without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def fresh_dir(spark: SparkSession, name: str, outside: bool = False) -> str:
    """A new path in the shared folder, inside the current scope if there is one and ``outside`` isn't said."""
    base = None if outside else _scope.get()
    return f"{base or shared_dir(spark) + '/folio'}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once and outlives any executor."""
    spark = df.sparkSession
    path = fresh_dir(spark, name, outside)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(df: DataFrame) -> None:
    """Delete what keep() wrote for ``df``; it and what is made of it can't be read after that."""
    _delete(df.sparkSession, df.kept_at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept inside go at the end; what is to stay must be kept outside by then."""
    path = fresh_dir(spark, "scope")
    token = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of at most two numbers that may be broadcast: about 100 MB in an executor.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """A kept table of ids, to be broadcast in joins if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def trim(collect: bool = True) -> None:
    """Give memory that is free inside this process back to the system, where the C library can."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task that gives back at its end what it has freed: a worker lives on and waits beside others for later stages,
    whose tasks, and the JVM's, need the memory."""

    @functools.wraps(run)
    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        trim(collect=False)

    return tidied


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {x.lower() for x in df.columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def to_shards(df: DataFrame, column: str) -> DataFrame:
    """One task for each value 0..partitions-1 of ``column``."""
    return df.repartitionById(partitions(df.sparkSession), F.col(column))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``most`` text bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def slice_bytes(shards: int) -> int:
    """Text bytes of a slice that is dealt to so many shards: each slice makes a row for each shard, and rows that don't
    grow with the shards would make work that grows as the square of the input."""
    return min(max(SLICE_BYTES, shards * SHARD_BYTES), MOST_SLICE_BYTES)


def gathered(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` text bytes, which go over batches: those of short texts are small."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, most):
            # empty texts count too
            n = (pc.sum(pc.binary_length(part.column(column))).as_py() or 0) + 8 * part.num_rows
            if held and size + n > 2 * most:
                yield _joined(held)
                held, size = [], 0
            held.append(part)
            size += n
            if size >= most // 2:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """White-space words of each text: offsets (n+1), one code for each word, and the words the codes stand for."""
    offsets, codes, words = coded_words(texts)
    return offsets, codes, words.to_pylist()


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """word_codes, with the words as Arrow has them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.utf8_split_whitespace(texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    offsets = offsets - offsets[0]
    if not len(flat):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32), pa.array([], pa.large_string())
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    if (none := pc.index(words, pa.scalar("", pa.large_string())).as_py()) >= 0:  # white space at either end of a text leaves an empty word
        real = codes != none
        before = np.concatenate([[0], np.cumsum(real)])
        codes, offsets = codes[real], before[offsets]
    return offsets.astype(np.int64), codes, words


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many words word_codes finds in each text; 0 for a null."""
    texts = pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = pc.list_value_length(pc.utf8_split_whitespace(texts)).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0, n, 0)


def hash_words(words: list[str], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in words), U64, len(words))


def hash_strings(words: pa.LargeStringArray) -> np.ndarray:
    """hash_words of words as Arrow has them, without a Python string of each."""
    _, offsets, data = words.buffers()
    if not len(words) or data is None:
        return hash_words(words.to_pylist())
    h, data = xxhash.xxh3_64_intdigest, data.to_pybytes()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    return np.fromiter((h(data[a:b]) for a, b in zip(ends, ends[1:])), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(m, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit fingerprint of ``values[i:i+width]`` for each i; windows may run over document ends."""
    n = len(values)
    if n < width:
        return np.zeros(0, U64)
    up, down = _power(n)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values * up, dtype=U64)])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def starts_of_windows(offsets: np.ndarray, width: int) -> np.ndarray:
    """Flat positions at which a whole window lies inside its document."""
    n = int(offsets[-1])
    ok = np.ones(n + 1, bool)
    lengths = np.diff(offsets)
    tails = np.minimum(lengths, width - 1)
    back = np.repeat(offsets[1:] - tails, tails) + ranges(tails)
    ok[back] = False
    return np.flatnonzero(ok[:n])


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def uniques(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending. A plain sort is several times as fast as a table of hashes."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


_MAGIC = "<u4"
_of_thread = threading.local()


def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Made once in a thread: for a small row, making them takes longer than their work."""
    if not hasattr(_of_thread, "zstd"):
        _of_thread.zstd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _of_thread.zstd


def pack(*columns: np.ndarray) -> bytes:
    """Columns as zstd frames; sort a column beforehand and pass differences where that shrinks it."""
    z = _zstd()[0]
    out = []
    for c in columns:
        # bytes of one significance lie together, which is what the entropy coder needs
        raw = np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes()
        code = z.compress(raw)
        head = f"{c.dtype.str}:{len(c)}".encode()
        out += [np.array([len(head), len(code)], _MAGIC).tobytes(), head, code]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    z, at, out = _zstd()[1], 0, []
    while at < len(blob):
        h, c = np.frombuffer(blob, _MAGIC, 2, at)
        at += 8
        kind, n = bytes(blob[at : at + h]).decode().split(":")
        at += int(h)
        raw = z.decompress(blob[at : at + int(c)]) if int(n) else b""
        at += int(c)
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, int(n)).T).reshape(-1).view(kind))
    return out


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each run of one value of ``column``, which may go over batches; one run at a time is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(column)[0].as_py() != int(key[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def split_by(shard: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that sorts by shard, and the bounds of each shard in it."""
    small = shard.astype(np.uint16 if count <= 1 << 16 else np.uint32)
    order = np.argsort(small, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(small, minlength=count))])


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the values."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def local_path(uri: str) -> str:
    """The path under which workers see the shared folder."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped levels need a mounted shared folder, not {uri}")
    return os.path.abspath(uri)
