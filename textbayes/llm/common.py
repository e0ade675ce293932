"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbayes.storage import discard, materialize

__all__ = ["discard", "materialize", "fresh", "small", "utf8", "blocks", "texts", "mixed", "signed", "Hashes", "BlockWords", "runs"]

#: Text bytes that a numpy kernel takes at once; bounds a worker's memory (one longer text is taken alone).
BLOCK_BYTES = 1 << 20
#: Most rows of one or two longs that are ever broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, which are counted; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offset of each row in them, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `limit` bytes of text each: (rows, their bytes, offsets from 0)."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            stop = min(stop, batch.num_rows)
            at = offsets[start : stop + 1]
            yield batch.slice(start, stop - start), data[at[0] : at[-1]], at - at[0]
            start = stop


def texts(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64, kept for the next block."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(n + 1, b, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers


class Hashes:
    """Hashes of any range of the bytes, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def fixed(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]


class BlockWords:
    """The words of a block of texts: where they stand, their hashes, and the first word of each text.

    lower maps each byte to itself, to its small letter, or to 0x20 if it separates words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: np.ndarray):
        self.low = lower[data]
        there = self.low != 0x20
        cut = np.zeros(len(data) + 1, bool)  # before a byte: no word goes over it
        cut[0] = cut[-1] = True
        cut[offsets] = True
        cut[1:-1] |= there[1:] != there[:-1]
        self.begin = np.flatnonzero(there & cut[:-1])
        self.end = np.flatnonzero(there & cut[1:]) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.hash = mixed(Hashes(self.low)(self.begin, self.end))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, np.uint64).view(np.int64)


def runs(batches, keys: list[str]) -> Iterator[list[dict]]:
    """Rows of batches that are sorted by keys, one list for each distinct key; only one group is held at a time."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now and rows:
                yield rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield rows
