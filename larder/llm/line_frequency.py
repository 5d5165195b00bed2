"""Quality rules with cross-document line frequency.

Lines are normalised (ASCII letters lower-cased, digits made 0, white space between words
made one space), hashed, and counted per host by the number of different texts that hold
them, so that copies of one document don't make its lines frequent. Lines that more than
``MOST_TEXTS`` of a host's texts hold are removed, however many texts the host has; a document that keeps less
than ``LEFT`` of its words is depleted and is rejected, as is one that fails the base rules.

Counts are summed before rows move, first by text and then by host and line, so neither a host nor a
line with a large part of all rows meets in one task. The frequent lines are joined by host
and line; what comes back to a text is the list of its own frequent lines.

Null texts have no words and fail the base rules. A null host is a host like any other.
Repeated rows are judged alike, each giving a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import sent_if_small, staged
from larder.llm.texts import Flat, Runs, chunked, mix, positions, windows

MOST_TEXTS, LEFT = 20, 0.3
LEAST_WORDS, REPEATED_PERCENT = 50, 50
WINDOW = 3
_NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
_IN_LINE = np.array([b != 0x0A for b in range(256)])
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256)], np.uint8)


def _per_doc(flat: Flat, marked: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[flat.stops] - total[flat.starts]


def _duplicated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur more than once in their text, and which of those are not the first there."""
    with np.errstate(over="ignore"):
        key = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return any_, later


def measured(raw: list[bytes]) -> tuple[dict[str, np.ndarray], Runs, np.ndarray, np.ndarray]:
    """Counts of each text; its lines that have a word, with their number of words and normalised hash."""
    flat = Flat(raw)
    words = flat.runs(_NOT_SPACE)
    at = positions(words.doc_starts, words.per_doc, WINDOW)
    repeated, _ = _duplicated(words.doc[at], windows(words.hashes(), WINDOW)[at]) if len(at) else (np.zeros(0, bool), None)
    marked = np.zeros(len(words), bool)
    for j in range(WINDOW):
        marked[at[repeated] + j] = True
    lines = flat.runs(_IN_LINE)
    first = np.searchsorted(words.starts, lines.starts)
    n_words = np.searchsorted(words.starts, lines.stops) - first
    full = n_words > 0
    _, later = _duplicated(lines.doc[full], lines.hashes()[full])
    lead = words.inside & ((flat.data & 0xC0) != 0x80)
    counts = {
        "n_words": words.per_doc, "word_chars": _per_doc(flat, lead), "n_symbols": _per_doc(flat, _SYMBOL[flat.data]),
        "n_dup_lines": np.bincount(lines.doc[full][later], minlength=flat.n),
        "n_repeat_words": np.bincount(words.doc[marked], minlength=flat.n)}
    lines = Runs(flat, lines.inside, lines.starts[full], lines.stops[full])
    n_words, first = n_words[full], first[full]
    folded = windows_of(words.hashes(_FOLD[flat.data]), first, n_words)
    return counts, lines, n_words, folded


def windows_of(hashes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each line's sequence of word hashes."""
    if not len(first):
        return np.zeros(0, np.uint64)
    place = np.arange(len(hashes)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(lengths.max()), np.uint64(0xD6E8FEB86659FD93)))
        return mix(np.add.reduceat(hashes * powers[place], first))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, hash of the text, counts, and the different lines with their words."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"),
                         F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = (f"doc_id {kind}, host string, text_hash long, {', '.join(f'{n} long' for n in names)}, "
              "lines array<struct<hash:long,words:long>>")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, "text"):
            counts, lines, n_words, folded = measured(raw)
            edges = np.concatenate([[0], np.cumsum(lines.per_doc)]).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array(folded.view(np.int64)), pa.array(n_words.astype(np.int64))], ["hash", "words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array(counts[n].astype(np.int64)) for n in names),
                 pa.ListArray.from_arrays(pa.array(edges), inner)],
                names=["doc_id", "host", "text_hash", *names, "lines"])

    return source.mapInArrow(measure, schema)


def frequent_lines(found: DataFrame, most: int = MOST_TEXTS) -> DataFrame:
    """(of, often): the lines (hashes) that more than ``most`` different texts of a host hold."""
    held = (found.select("host", "text_hash", F.explode("lines.hash").alias("hash")).distinct()
            .groupBy("host", "hash").agg(F.count("*").alias("held")))
    return staged(held.where(F.col("held") > most).select(F.col("host").alias("of"), F.col("hash").alias("often")), "frequent-lines")


def to_remove(found: DataFrame, most: int = MOST_TEXTS) -> DataFrame:
    """(drop_host, drop_text, drop): each text's own frequent lines; texts without any have no row."""
    often = sent_if_small(frequent_lines(found, most))
    lines = found.select("host", "text_hash", F.explode("lines.hash").alias("hash"))
    met = lines.join(often, lines["host"].eqNullSafe(often["of"]) & (lines["hash"] == often["often"]), "left_semi").distinct()
    drops = met.groupBy(F.col("host").alias("drop_host"), F.col("text_hash").alias("drop_text")).agg(F.collect_list("hash").alias("drop"))
    return sent_if_small(staged(drops, "lines-to-remove"), weight="drop")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
           most: int = MOST_TEXTS, left: float = LEFT) -> DataFrame:
    """Counts and verdict of every document; ``removed_words`` are those in frequent lines."""
    found = staged(measures(docs, doc_id, text, host), "measures")
    drops = to_remove(found, most)
    both = found.join(drops, (found["text_hash"] == drops["drop_text"]) & found["host"].eqNullSafe(drops["drop_host"]), "left")
    hit = F.filter("lines", lambda line: F.array_contains(F.coalesce("drop", F.array().cast("array<bigint>")), line["hash"]))
    removed = F.aggregate(hit, F.lit(0).cast("long"), lambda total, line: total + line["words"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", removed.alias("removed_words"),
        failed.alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= left * F.col("n_words")))


def without_frequent(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", most: int = MOST_TEXTS,
                     n_chars: str = "n_chars") -> DataFrame:
    """The documents, all columns kept, without the lines that more than ``most`` texts of their host hold.

    The same lines go that ``judged`` counts as removed. A column ``n_chars`` follows the text.
    """
    found = staged(measures(docs, doc_id, text, host).select("host", "text_hash", "lines"), "measures")
    drops = to_remove(found, most).select(F.col("drop_host").alias("__host"), F.col("drop_text").alias("__hash"), F.col("drop").alias("__drop"))
    names = docs.columns
    both = docs.join(drops, (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == drops["__hash"])
                     & docs[host].cast("string").eqNullSafe(drops["__host"]), "left").select(*(docs[c] for c in names), "__drop")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, text):
            drop = batch.column(len(names)).to_pylist()
            cut = [_without(x, set(d)) if d else x for x, d in zip(raw, drop, strict=True)]
            columns = []
            for name, column in zip(names, batch.columns, strict=False):
                if name == text:
                    column = pa.array([y if known else None for y, known in zip(cut, column.is_valid().to_pylist(), strict=True)], pa.binary()).cast(column.type)
                elif name == n_chars:
                    column = pa.array([old if x == y else len(y.decode()) for old, x, y in zip(column.to_pylist(), raw, cut, strict=True)], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(clean, docs.schema)


def _without(raw: bytes, drop: set[int]) -> bytes:
    """The text without the lines of those normalised hashes."""
    folded = iter(measured([raw])[3].view(np.int64).tolist())
    return b"\n".join([line for line in raw.split(b"\n") if not line.split() or next(folded) not in drop])
