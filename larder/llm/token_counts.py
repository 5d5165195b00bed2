"""Token counts by byte-pair merging with a heap and a linked list.

A word starts as its bytes. The heap holds adjacent pairs that the vocabulary merges, by
rank and then place; popping one joins its two symbols in a doubly linked list and pushes
the pairs that arise. A popped pair whose symbols have changed since is stale and is
skipped. The count is the number of bytes less the number of merges; no identifiers are
made. Counts of words seen are kept per worker process in tables of bounded size.

Null texts count as empty: 0 bytes, 0 tokens. Strings of the vocabulary's added tokens
count as one token wherever they stand, as its library has it by default.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.lettering import byte_level_words
from larder.llm.texts import encoded

KEPT_WORDS = 500_000
LIMIT = 512


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Rank of each mergeable pair and the symbol it becomes; symbols are numbered from the 256 bytes upwards."""

    def __init__(self, merges: list):
        letters = byte_letters()
        number = {bytes([b]): b for b in range(256)}
        self.rank: dict[int, int] = {}
        self.joined: list[int] = []
        for merge in merges:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (bytes(letters[c] for c in part) for part in (left, right))
            self.joined.append(number.setdefault(a + b, len(number)))
            self.rank.setdefault(number[a] << 24 | number[b], len(self.joined) - 1)

    def count(self, word: bytes) -> int:
        """Initial symbols less merges."""
        n = left = len(word)
        rank_of, joined, push, pop = self.rank.get, self.joined, heapq.heappush, heapq.heappop
        symbol = [*word, -1]
        rank = [rank_of(symbol[i] << 24 | symbol[i + 1], -1) for i in range(n - 1)] + [-1, -1]
        heap = [rank[i] << 32 | i for i in range(n - 1) if rank[i] >= 0]
        heapq.heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n)]
        while heap:
            lowest = pop(heap)
            i, lowest = lowest & 0xFFFFFFFF, lowest >> 32
            if rank[i] != lowest:  # one of its symbols has been merged since
                continue
            left -= 1
            j = after[i]
            new = symbol[i] = joined[lowest]
            rank[j] = -1
            k = after[i] = after[j]
            before[k] = i
            r = rank[i] = rank_of(new << 24 | symbol[k], -1) if k < n else -1
            if r >= 0:
                push(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank[h] = rank_of(symbol[h] << 24 | new, -1)
                if r >= 0:
                    push(heap, r << 32 | h)
        return left


class Counter(dict):
    """Tokens of a word, counted when first asked for.

    When the table is full it becomes the older of two, and words asked for again move
    back: frequent words stay, and memory is bounded.
    """

    def __init__(self, path: str, kept: int):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        self.merges, self.kept, self.older = Merges(vocabulary["model"]["merges"]), kept, {}
        self.words = byte_level_words()
        added = sorted((t["content"] for t in vocabulary["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def __missing__(self, word: str) -> int:
        n = self.older.get(word) or self.merges.count(word.encode())
        if len(word) <= 64:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return sum(map(self.__getitem__, self.words(text)))
        parts = self.added.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words(part))) for part in parts)


@functools.lru_cache(maxsize=2)
def counter(path: str, kept: int) -> Counter:
    """One per worker process and vocabulary."""
    return Counter(path, kept)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                 kept: int = KEPT_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row. ``vocabulary`` is a file that every executor has."""
    path = vocabulary or default_vocabulary()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path, kept)
        for batch in batches:
            raw = encoded(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.fromiter(map(len, raw), np.int64, len(raw))),
                pa.array([counts.count(x.decode()) for x in raw], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return source.mapInArrow(count, schema)


def with_limit(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
