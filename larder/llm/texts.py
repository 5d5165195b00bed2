"""Columns of text as byte arrays, split into words and lines with whole-array operations.

A batch is cut into chunks of bounded size, so that the arrays of a task stay small
whatever the number of rows of a batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a missing text counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunked(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES
            ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, of about ``limit`` bytes of text each; only a slice is held as Python objects."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.zeros(len(column), np.int64) if pa.types.is_null(column.type) else pc.fill_null(pc.binary_length(column), 0).to_numpy()
        block = np.cumsum(sizes + 1) // limit
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(block) else []
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(int(start), int(stop - start))
            yield part, encoded(part.column(batch.schema.get_field_index(text)))
        pa.default_memory_pool().release_unused()


class Flat:
    """The texts of a chunk in one byte array, each followed by one ``separator`` byte."""

    def __init__(self, raw: list[bytes], separator: bytes = b"\n"):
        self.n = len(raw)
        self.data = np.frombuffer(separator.join(raw) + separator, np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, self.n) + 1
        self.stops = np.cumsum(lengths)
        self.starts = self.stops - lengths

    def runs(self, member: np.ndarray) -> Runs:
        """Maximal runs of bytes for which the 256-entry table ``member`` holds; it must not hold for the separator."""
        inside = member[self.data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        return Runs(self, inside, edge[0::2], edge[1::2])


class Runs:
    """Words or lines of a chunk: places, owning text, and hashes."""

    def __init__(self, flat: Flat, inside: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.flat, self.inside, self.starts, self.stops = flat, inside, starts, stops
        self.doc = np.searchsorted(flat.stops, starts, "right")
        self.per_doc = np.bincount(self.doc, minlength=flat.n).astype(np.int64)
        self.doc_starts = np.cumsum(self.per_doc) - self.per_doc

    def __len__(self) -> int:
        return len(self.starts)

    def bytes_at(self, i: int) -> bytes:
        return self.flat.data[self.starts[i]:self.stops[i]].tobytes()

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of the bytes of each run; ``data`` replaces the bytes (case-folded, say)."""
        if not len(self):
            return np.zeros(0, np.uint64)
        data = (self.flat.data if data is None else data)[self.inside]
        lengths = self.stops - self.starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(data), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.full(int(lengths.max()), _MULTIPLIER))
            value = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
            return mix(np.add.reduceat(value, first) ^ lengths.astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values; entry i starts at value i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total = total * _MULTIPLIER + hashes[j:j + n]
        return mix(total)


def positions(doc_starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Places of the windows that lie within one text, given each text's first entry and number of entries."""
    per = np.maximum(counts - width + 1, 0)
    total = int(per.sum())
    before = np.cumsum(per) - per
    return np.repeat(doc_starts - before, per) + np.arange(total)
