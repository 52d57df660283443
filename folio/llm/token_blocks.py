"""Token ids in patched frame-of-reference blocks.

Texts are encoded by a public byte-level BPE vocabulary. A document's ids are cut into blocks of 128; a block keeps
its least id, the differences to it in a width that fits ``percentile`` of them, and the rest as exceptions: their
places and high bits. ``starts`` holds where each block begins in ``data``, so a block can be read by itself.

Block layout (little endian): base u32, width u8, exceptions u8, count-1 u8, then the packed low bits, the exceptions'
places (u8 each) and their high parts (u32 each).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import common as c

BLOCK, HEAD = 128, 7
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: a run of white space (Unicode's White_Space, as in the pattern) that the pattern's look-ahead could not walk back over
_RUN = 1000
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_long_runs = re.compile(f"(?<![{_SPACE}])[{_SPACE}]{{{_RUN},}}").finditer
_NONE = np.zeros(0, np.uint32)
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("starts", pa.list_(pa.int32())), ("data", pa.binary())])


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of one text. Long runs of white space, on which the pattern fails, are cut out as it would cut them:
    all of a run at the end of a text is one piece; elsewhere its last character belongs to what follows."""
    if len(text) < _RUN:
        return enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
    parts, at = [], 0
    for m in _long_runs(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        parts.append(enc.encode_to_numpy(text[at : m.start()], allowed_special=set(), disallowed_special=()))
        parts.append(np.array(enc._encode_single_piece(text[m.start() : end]), np.uint32))
        at = end
    parts.append(enc.encode_to_numpy(text[at:], allowed_special=set(), disallowed_special=()))
    return np.concatenate(parts)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the ids of all texts; strings of special tokens are ordinary text."""
    enc = encoding(path)
    found = [text_ids(enc, t) if t else _NONE for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]).astype(np.int64)
    return offsets, np.concatenate(found) if found else _NONE


def encode_blocks(offsets: np.ndarray, ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all documents' blocks; where each block starts; which block is each document's first (n+1)."""
    n = np.diff(offsets)
    blocks = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), first
    place = np.repeat(first[:-1] * BLOCK, n) + c.ranges(n)
    grid = np.zeros(total * BLOCK, np.int64)
    used = np.zeros(total * BLOCK, bool)
    grid[place], used[place] = ids, True
    grid, used = grid.reshape(total, BLOCK), used.reshape(total, BLOCK)
    count = used.sum(axis=1)
    base = np.where(used, grid, 1 << 62).min(axis=1)
    diff = np.where(used, grid - base[:, None], 0)
    ranked = np.sort(np.where(used, diff, 1 << 62), axis=1)
    pick = np.minimum(np.ceil(count * percentile).astype(np.int64), count) - 1
    width = bits(ranked[np.arange(total), np.maximum(pick, 0)])
    high = np.where(used, diff >> width[:, None], 0)
    exceptions = (high > 0).sum(axis=1)
    packed = -(-count * width // 8)
    sizes = HEAD + packed + 5 * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(4):
        out[starts + k] = base >> 8 * k & 255
    out[starts + 4], out[starts + 5], out[starts + 6] = width, exceptions, count - 1
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            low = (diff[mine][:, :, None] >> np.arange(w) & 1).astype(np.uint8).reshape(len(mine), -1)
            raw = np.packbits(low, axis=1, bitorder="little")
            size = packed[mine]
            out[np.repeat(starts[mine] + HEAD, size) + c.ranges(size)] = raw[np.repeat(np.arange(len(mine)), size), c.ranges(size)]
    row, col = np.nonzero(high)
    if len(row):
        inside = c.ranges(exceptions[exceptions > 0])
        at = (starts + HEAD + packed)[row]
        out[at + inside] = col
        value = high[row, col]
        for k in range(4):
            out[at + exceptions[row] + 4 * inside + k] = value >> 8 * k & 255
    return out, starts, first


def bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of values below 2**53."""
    return np.where(x > 0, np.frexp(x.astype(float))[1], 0).astype(np.int64)


def decode_block(data: bytes, start: int = 0) -> np.ndarray:
    base = int.from_bytes(data[start : start + 4], "little")
    width, exceptions, count = data[start + 4], data[start + 5], data[start + 6] + 1
    at = start + HEAD
    packed = -(-count * width // 8)
    low = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), bitorder="little")[: count * width].reshape(count, width)
    value = (low.astype(np.int64) << np.arange(width)).sum(axis=1)
    at += packed
    places = np.frombuffer(data, np.uint8, exceptions, at)
    value[places] |= np.frombuffer(data, "<u4", exceptions, at + exceptions).astype(np.int64) << width
    return value + base


def decode(data: bytes, starts: list[int]) -> list[int]:
    return [int(x) for s in starts for x in decode_block(data, s)]


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, percentile: float = 0.9) -> DataFrame:
    """doc_id, n_tokens, starts (of the blocks in data) and data of every row.

    A null text gives null n_tokens, starts and data; an empty one 0 tokens, no starts, empty data; a null doc_id stays
    null. Text is encoded as it stands, so strings of special tokens are ordinary text. A text of any length is encoded
    whole, long runs of one kind of character included. Repeated rows are encoded each; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                offsets, ids = token_ids(part.column("text"), tokenizer)
                out, starts, first = encode_blocks(offsets, ids, percentile)
                begin = np.append(starts, len(out))[first]
                absent = pc.is_null(part.column("text")).to_numpy(zero_copy_only=False)
                inside = (starts - np.repeat(begin[:-1], np.diff(first))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(inside), mask=pa.array(absent))
                valid = pa.array(~absent).buffers()[1]
                data = pa.Array.from_buffers(pa.binary(), len(absent), [valid, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64(), mask=absent), lists, data], schema=_ROWS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, starts array<int>, data binary")


def decoded(blocks: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and text of what encode() gave; a null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for batch in batches:
            texts = [None if data is None else enc.decode(decode(data, starts)) for data, starts in zip(batch.column("data").to_pylist(), batch.column("starts").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return blocks.select("doc_id", "starts", "data").mapInArrow(run, "doc_id long, text string")
