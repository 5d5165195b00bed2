"""Benchmark decontamination by Wu-Manber search over words.

Every 10 consecutive words of a benchmark item form a pattern (an item of fewer words is
one pattern). Patterns of one length are searched together: a shift table over blocks of
two words says how far the search may jump, positions with shift 0 look up the patterns
that end in that block, and a candidate is confirmed by comparing its bytes. The texts of
a chunk are searched in step, one array operation moving every search at once; long texts
are cut into stretches of window ends, so that one long text does not make many steps.

Benchmark items are broadcast in blocks of bounded size (``BLOCK_BYTES`` of item text);
each block is searched against all documents and the hits are united, so a large
benchmark takes more passes and never more memory.

Null texts have no words, and neither do texts of separators only. Null items are skipped.
Rows with equal doc_id are separate rows of the result. Empty tables give empty results,
or results without hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.texts import Flat, Runs, chunked, mix, windows

WIDTH = 10
BLOCK_BYTES = 1 << 20
STRETCH = 256
WORD_BYTE = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def lowered(raw: list[bytes]) -> Flat:
    flat = Flat(raw)
    flat.data = LOWER[flat.data]
    return flat


def phrase(words: Runs, first: int, length: int) -> bytes:
    return b" ".join(words.bytes_at(i) for i in range(first, first + length))


@dataclass
class Patterns:
    """Shift table, suffix buckets and owners of the patterns of one length."""

    length: int
    block: int
    shift: np.ndarray
    suffix: np.ndarray   # sorted block hash at the end of each pattern
    prefix: np.ndarray   # block hash at its start
    whole: np.ndarray
    text: list[bytes]
    owners: list[list[int]]

    @classmethod
    def build(cls, length: int, found: dict[bytes, tuple[np.ndarray, list[int]]]) -> Patterns:
        block = min(2, length)
        texts = list(found)
        hashes = np.stack([found[t][0] for t in texts])
        ends = np.stack([blocks_at(hashes.ravel(), np.arange(len(texts)) * length + j, block)
                         for j in range(block - 1, length)], axis=1)
        size = 1 << max(12, int(ends.size * 8).bit_length())
        shift = np.full(size, length - block + 1, np.int32)
        np.minimum.at(shift, (ends & np.uint64(size - 1)).astype(np.int64),
                      np.arange(ends.shape[1] - 1, -1, -1, dtype=np.int32)[None, :])
        order = np.argsort(ends[:, -1], kind="stable")
        whole = np.array([windows(h, length)[0] for h in hashes], np.uint64)
        return cls(length, block, shift, ends[order, -1], ends[order, 0], whole[order],
                   [texts[i] for i in order], [found[texts[i]][1] for i in order])

    def search(self, words: Runs, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern number of every occurrence."""
        n = np.maximum(words.per_doc - self.length + 1, 0)
        pieces = -(-n // STRETCH)
        doc = np.repeat(np.arange(len(n)), pieces)
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = words.doc_starts[doc] + self.length - 1 + step * STRETCH
        stop = np.minimum(at + STRETCH, words.doc_starts[doc] + words.per_doc[doc])
        mask = np.uint64(len(self.shift) - 1)
        hits = []
        while len(at):
            jump = self.shift[(blocks_at(hashes, at, self.block) & mask).astype(np.int64)]
            hits.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        end = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        return self.confirmed(words, hashes, end)

    def confirmed(self, words: Runs, hashes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = blocks_at(hashes, end, self.block)
        low, high = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        n = high - low
        first = np.repeat(end - self.length + 1, n)
        pattern = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        same = blocks_at(hashes, first + self.block - 1, self.block) == self.prefix[pattern]
        first, pattern = first[same], pattern[same]
        total = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.length):
                total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[first + j]
        same = mix(total) == self.whole[pattern]
        first, pattern = first[same], pattern[same]
        same = np.array([phrase(words, f, self.length) == self.text[p] for f, p in zip(first, pattern, strict=True)], bool)
        return first[same], pattern[same]


def blocks_at(hashes: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Hash of the ``block`` words that end at each position."""
    if block == 1:
        return hashes[at]
    with np.errstate(over="ignore"):
        return mix(hashes[at - 1] * _PAIR + hashes[at])


def compiled(texts: list[str | None], width: int = WIDTH) -> list[Patterns]:
    """Patterns by length; the owner of a pattern is the place of its item in ``texts``."""
    words = lowered([(t or "").encode() for t in texts]).runs(WORD_BYTE)
    hashes = words.hashes()
    by_length: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = {}
    for item, (start, n) in enumerate(zip(words.doc_starts, words.per_doc, strict=True)):
        length = int(min(n, width))
        for first in range(start, start + n - length + 1) if n else ():
            found = by_length.setdefault(length, {})
            owners = found.setdefault(phrase(words, first, length), (hashes[first:first + length], []))[1]
            if not owners or owners[-1] != item:
                owners.append(item)
    return [Patterns.build(length, found) for length, found in sorted(by_length.items())]


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items as lists of bounded text size. An item stays whole."""
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [tuple(row) for row in part.collect()]


def occurrences(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                item_id: str = "item_id", item_text: str = "text", width: int = WIDTH,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, the places of its hit words, the ids (as strings) of the items with occurring windows."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_words long, hit_words array<long>, items array<string>"
    parts = [source.mapInArrow(_searcher(block, width), schema)
             for block in item_blocks(items, item_id, item_text, block_bytes)]
    parts = parts or [source.mapInArrow(_searcher([], width), schema)]
    return (parts[0] if len(parts) == 1 else _united(parts)).drop("text_hash")


def _united(parts: list[DataFrame]) -> DataFrame:
    """Hits of several blocks together. Repeated rows have one result, given as often as they occur."""
    total = parts[0].withColumn("copies", F.lit(1))
    for part in parts[1:]:
        total = total.unionByName(part.where(F.size("hit_words") > 0).withColumn("copies", F.lit(0)))
    merged = total.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sum("copies").alias("copies"))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def _search(names: list[str], tables: list[Patterns], raw: list[bytes]):
    """Words of each text, places of the hit words of the chunk, and the names of the items found by text."""
    words = lowered(raw).runs(WORD_BYTE)
    hashes = words.hashes()
    change = np.zeros(len(words) + 1, np.int64)
    owners: dict[int, set[str]] = {}
    for table in tables:
        first, pattern = table.search(words, hashes)
        np.add.at(change, first, 1)
        np.add.at(change, first + table.length, -1)
        for d, p in {*zip(words.doc[first].tolist(), pattern.tolist(), strict=True)}:
            owners.setdefault(d, set()).update(names[o] for o in table.owners[p])
    return words, np.flatnonzero(np.cumsum(change[:-1]) > 0), owners


def _searcher(block: list[tuple], width: int):
    names, tables = [item for item, _ in block], compiled([t for _, t in block], width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, "text"):
            words, hit, owners = _search(names, tables, raw)
            doc = words.doc[hit]
            edges = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(raw)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(words.per_doc),
                pa.ListArray.from_arrays(pa.array(edges), pa.array(hit - words.doc_starts[doc])),
                pa.array([sorted(owners.get(d, ())) for d in range(len(raw))], pa.list_(pa.string()))],
                names=["doc_id", "text_hash", "n_words", "hit_words", "items"])

    return search


def _cleaner(block: list[tuple], text: str, width: int):
    names, tables = [item for item, _ in block], compiled([t for _, t in block], width)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, text):
            words, hit, _ = _search(names, tables, raw)
            keep = np.ones(len(raw), bool)
            keep[words.doc[hit]] = False
            yield batch.filter(pa.array(keep))

    return clean


def digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the item list for each document of ``occurrences``."""
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns kept, in which no benchmark window occurs."""
    for block in item_blocks(items, item_id, item_text, block_bytes):
        docs = docs.mapInArrow(_cleaner(block, text, width), docs.schema)
    return docs
