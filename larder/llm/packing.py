"""Packing documents into sequences: first-fit decreasing with a tournament tree.

Tokenising cuts every document into full sequences and one rest; the rests are packed.
They are dealt at random into groups of bounded expected size, and each group is packed by
itself: rests in decreasing length, each into the first open bin with room for it. A
tournament tree over the bins' free room finds that bin in as many steps as the tree is
high. Only lengths and checksums move between tasks; the ids stay where they arise.

Null texts count as empty; every document ends with the id 2, so none is without pieces.
Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.lettering import word_level_words
from larder.llm.staging import staged
from larder.llm.texts import chunked

SEQUENCE = 4096
END_ID = 2
GROUP_PIECES = 20_000
KEPT_WORDS = 300_000
TOGETHER = 500  # words given to the library at a time


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of each word, words not seen before given to the library all at once.

    The vocabulary splits a text into words by a pattern before any merging, so a word's ids
    do not depend on its neighbours. The table is one dictionary of places and one flat array of
    ids, of at most ``kept`` words beside those of the chunk at hand; when it is full, the half used most stays.
    """

    def __init__(self, path: str, kept: int):
        from tokenizers import Tokenizer
        self.library, self.kept = Tokenizer.from_file(path), kept
        self.words = word_level_words()
        with open(path, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
        # Words hold no space: with one in front the added tokens have places of their own, which are never given up.
        self.added = len(added)
        self.place = {" " + text: i for i, text in enumerate(added)}
        self.flat, self.stops = np.array(list(added.values()), "<u4"), np.arange(1, self.added + 1)
        self.uses = np.zeros(self.added, np.int32)

    def parts(self, text: str) -> list[str]:
        """Words of each stretch between added tokens, and those tokens."""
        pieces = self.split(text)
        if len(pieces) == 1:
            return self.words(self.normal(text))
        return [word for i, part in enumerate(pieces) for word in ([" " + part] if i % 2 else self.words(self.normal(part)))]

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Character by character a capital sigma has one lower case, wherever it stands.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's place in the table, unknown words learnt."""
        known = self.place.get
        at = np.fromiter(map(known, words, itertools.repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        new = list(dict.fromkeys(words[i] for i in missing.tolist()))
        if len(self.place) + len(new) > self.kept and len(self.place) > self.added:
            self.shrink()
            return self.places(words)
        self.learn(new)
        at[missing] = np.fromiter((known(words[i]) for i in missing.tolist()), np.int32, len(missing))
        return at

    def shrink(self) -> None:
        """Half as many words as may be kept, the most used ones, and of the others none if they were used just once."""
        often = self.uses.copy()
        often[:self.added] = np.iinfo(np.int32).max
        least = max(2, int(np.sort(often)[-max(self.kept // 2, self.added):][0]))
        stay = np.flatnonzero(often >= least)[:max(self.kept // 2, self.added)]
        words = list(self.place)
        self.flat, lengths = self.gathered(stay)
        self.place = {words[i]: k for k, i in enumerate(stay.tolist())}
        self.stops, self.uses = np.cumsum(lengths), np.zeros(len(stay), np.int32)

    def learn(self, new: list[str]) -> None:
        ids, stops, size = [self.flat], [self.stops], len(self.flat)
        for i in range(0, len(new), TOGETHER):
            some = new[i:i + TOGETHER]
            encoding = self.library.encode(" ".join(some), add_special_tokens=False)
            of = np.array(encoding.word_ids, np.int64)
            if int(of[-1]) != len(some) - 1:
                raise ValueError("the vocabulary splits text otherwise than by its words")
            ids.append(np.array(encoding.ids, "<u4"))
            stops.append(size + np.searchsorted(of, np.arange(1, len(some) + 1)))
            size += len(of)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.flat, self.stops = np.concatenate(ids), np.concatenate(stops)
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])

    def gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after another, and how many each has."""
        starts = np.concatenate([[0], self.stops[:-1]])[at]
        lengths = self.stops[at] - starts
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))], lengths

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.parts(text) for text in texts]
        at = self.places(list(itertools.chain.from_iterable(split)))
        self.uses += np.bincount(at, minlength=len(self.uses)).astype(np.int32)
        found, lengths = self.gathered(at)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, split)])].tolist()
        return [found[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def word_ids(path: str, kept: int) -> WordIds:
    return WordIds(path, kept)


class Bins:
    """Open bins with a tournament tree of their free room."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.used = capacity, 1, 0
        self.room = [0, 0]

    def first_fit(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length``, and the offset there; a new bin if there is none."""
        if self.room[1] < length:
            return self._opened(length), 0
        node = 1
        while node < self.leaves:
            node *= 2
            if self.room[node] < length:
                node += 1
        offset = self.capacity - self.room[node]
        self._set(node, self.room[node] - length)
        return node - self.leaves, offset

    def _opened(self, length: int) -> int:
        if self.used == self.leaves:
            free = self.room[self.leaves:] + [0] * self.leaves
            self.leaves *= 2
            self.room = [0] * self.leaves + free
            for node in range(self.leaves - 1, 0, -1):
                self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])
        self.used += 1
        self._set(self.leaves + self.used - 1, self.capacity - length)
        return self.used - 1

    def _set(self, node: int, room: int) -> None:
        self.room[node] = room
        while node > 1:
            node //= 2
            best = max(self.room[2 * node], self.room[2 * node + 1])
            if self.room[node] == best:
                return
            self.room[node] = best


def first_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given."""
    bins, place = Bins(capacity), np.zeros((2, len(lengths)), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        place[:, i] = bins.first_fit(int(lengths[i]))
    return place[0], place[1]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           sequence: int = SEQUENCE, kept: int = KEPT_WORDS) -> DataFrame:
    """Each document's ids cut into full sequences and a rest."""
    path = vocabulary or default_vocabulary()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = (f"doc_id {source.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, "
              "doc_tokens long")
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path, kept)
        for batch, raw in chunked(batches, "text"):
            rows = []
            for i, packed in enumerate(ids.ids([x.decode() for x in raw])):
                packed += end
                total = len(packed) // 4
                rows += [(i, at, min(sequence, total - at), zlib.crc32(packed[4 * at:4 * (at + sequence)]), total)
                         for at in range(0, total, sequence)]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0])), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return source.mapInArrow(cut, schema)


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with their sequence and offset. Sequence ids are unique, not gapless."""
    cut = staged(pieces(docs, doc_id, text, vocabulary, sequence), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    # The row number tells repeated rows apart; over the written stage it is the same when a task is run again.
    salt = F.xxhash64("doc_id", "start", F.monotonically_increasing_id())
    dealt = cut.withColumn("group_no", F.pmod(salt, F.lit(groups)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start"], kind="stable", ignore_index=True)
        number, offset = first_fit_decreasing(rows["length"].to_numpy(), sequence)
        group = int(rows["group_no"].iloc[0])
        return rows.drop(columns="group_no").assign(sequence_id=number * groups + group, offset=offset)

    return dealt.groupBy("group_no").applyInPandas(fill, f"{kinds}, sequence_id long, offset long")
