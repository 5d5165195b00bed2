"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its prefixes, so
words that share a stem share most of it. Filters of several widths run over the words of
the whole text, each filter's largest response is kept, and a logistic unit joins them.
The first coordinate of an embedding starts as the evidence that the training rows give for
its feature (a shrunken z-score of the log odds of texts with it), the others at zero, so a
feature never seen in training adds nothing, however long a text is.

Training uses at most ``TRAIN_ROWS`` labelled rows of each class, chosen by a hash of the
id; this bound keeps what the driver holds small. Each row's whole text is used. Where the bound
cuts a class, the bias is moved back to the odds of the classes among all labelled rows. Scores are
computed from the text alone. All labelled rows outside the held-out fold are scored on the
executors and counted by language and score (``BINS`` of them); from these counts comes a threshold
for each language, which gives the ``toxic`` column that the filter goes by.

Null texts count as empty and get the score of a text without words. Labels without a
document, or with a null, are ignored; without labels of both classes every score is the
share of toxic labels (0 without labels). Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import BROADCAST_ROWS
from larder.llm.texts import Flat, chunked, mix

TRAIN_ROWS = 3000
FOLDS, HELD_OUT = 5, 0
BUCKETS, DIMENSIONS = 1 << 18, 4
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH, RATE = 6, 64, 0.02
CHUNK = 1 << 19
BINS, LEAST_ROWS = 1000, 20
_WORD = np.array([chr(b).isalnum() and b < 0x80 or b >= 0x80 or chr(b) == "'" for b in range(256)])
_SEEDS = mix(np.arange(1, len(PREFIXES) + 2, dtype=np.uint64))


def features(raw: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of every word (a row each), and the number of words of each text.

    Feature 0 stands for a prefix that the word doesn't have.
    """
    flat = Flat([x.decode().lower().encode() for x in raw])
    words = flat.runs(_WORD)
    n = len(words)
    out = np.zeros((n, len(PREFIXES) + 1), np.int32)
    if not n:
        return out, words.per_doc
    data = flat.data[words.inside]
    lengths = words.stops - words.starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(lengths.max()), np.uint64(0x9E3779B97F4A7C15)))
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64)])
        for j, k in enumerate((*PREFIXES, None)):
            long_enough = np.ones(n, bool) if k is None else lengths > k
            stop = first + (lengths if k is None else np.minimum(lengths, k))
            number = mix((total[stop] - total[first]) ^ _SEEDS[j]) % np.uint64(buckets - 1) + np.uint64(1)
            out[:, j] = np.where(long_enough, number, 0)
    return out, words.per_doc


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def padded(self, feats: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with empty words after each text, so that no window reaches the next text; its first row and number of windows."""
        windows = np.maximum(counts, 1)
        size = windows + max(WIDTHS) - 1
        starts = np.cumsum(size) - size
        rows = np.zeros((int(size.sum()), feats.shape[1]), np.int32)
        rows[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(feats))] = feats
        return rows, starts, windows

    def pooled(self, feats: np.ndarray, counts: np.ndarray, places: bool = False):
        rows, starts, windows = self.padded(feats, counts)
        words = self.embedding[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            words = words + self.embedding[rows[:, j]]
        bounds = np.stack([starts, starts + windows], axis=1).ravel()[:-1]
        best, where = [], []
        for width, filters, offset in zip(WIDTHS, self.filters, self.offsets, strict=True):
            n = len(words) - max(WIDTHS) + 1
            value = sum(words[j:n + j] @ filters[j] for j in range(width)) + offset
            top = np.maximum.reduceat(value, bounds, axis=0)[::2]
            best.append(top)
            if places:
                where.append(self.places(value, top, starts, windows))
        pooled = np.maximum(np.concatenate(best, axis=1), 0)
        return (pooled, where, rows, words) if places else pooled

    @staticmethod
    def places(value: np.ndarray, top: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Row of the first window with the largest response, by text and filter."""
        owner = np.repeat(np.arange(len(starts)), windows)
        row = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        out = np.empty(top.shape, np.int64)
        for f in range(top.shape[1]):
            hit = np.flatnonzero(value[row, f] == top[owner, f])[::-1]
            out[owner[hit], f] = row[hit]
        return out

    def scores(self, raw: list[bytes]) -> np.ndarray:
        if not self.filters:
            return np.full(len(raw), self.prior)
        feats, counts = features(raw, len(self.embedding))
        return 1 / (1 + np.exp(-np.clip(self.pooled(feats, counts) @ self.weights + self.bias, -30, 30)))


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, value, gradient):
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.99 * self.v + 0.01 * gradient ** 2
        return value - self.rate * self.m / (1 - 0.9 ** self.t) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-8)


def evidence(feats: np.ndarray, stops: np.ndarray, toxic: np.ndarray, buckets: int) -> np.ndarray:
    """For each feature how far the log odds of texts that have it lie from those of all, in standard errors, less 2."""
    held = np.zeros((2, buckets))
    for start, stop, label in zip(np.r_[0, stops[:-1]], stops, toxic, strict=True):
        held[label, np.unique(feats[start:stop])] += 1
    n = np.bincount(toxic, minlength=2)[:, None]
    a, b = held[1] + 0.5 * n[1] / n.sum(), held[0] + 0.5 * n[0] / n.sum()
    z = (np.log(a / b) - np.log(n[1] / n[0])) / np.sqrt(1 / (held[1] + 0.5) + 1 / (held[0] + 0.5))
    shrunk = np.sign(z) * np.maximum(np.abs(z) - 2, 0)
    shrunk[0] = 0
    return shrunk


def trained(raw: list[bytes], toxic: np.ndarray, buckets: int = BUCKETS, seed: int = 7) -> Network:
    """A network fitted to texts and 0/1 labels."""
    toxic = np.asarray(toxic, np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return Network(np.zeros((1, 1)), [], [], np.zeros(0), 0.0, float(toxic.mean()) if len(toxic) else 0.0)
    draw = np.random.default_rng(seed)
    # One array for all texts: freed at once, it goes back to the system.
    parts = [features(raw[at:at + 100], buckets) for at in range(0, len(raw), 100)]
    feats, counts = np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts])
    del parts
    stops = np.cumsum(counts)
    start = np.zeros((buckets, DIMENSIONS), np.float32)
    start[:, 0] = np.clip(evidence(feats, stops, toxic, buckets) / 3, -1, 2)
    scale = [draw.normal(0, 0.3, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    for one in scale:
        one[:, 0] = np.abs(one[:, 0]) + 0.2
    net = Network(start, [s.astype(np.float32) for s in scale], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  np.full(len(WIDTHS) * FILTERS, 0.2), -1.0)
    hands = {"weights": _Adam(net.weights.shape, RATE), "bias": _Adam((), RATE)}
    hands |= {("f", i): _Adam(f.shape, RATE) for i, f in enumerate(net.filters)} | {("o", i): _Adam(o.shape, RATE) for i, o in enumerate(net.offsets)}
    squared = np.full(buckets, 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = draw.permutation(len(raw))
        for at in range(0, len(order), BATCH):
            drawn = order[at:at + BATCH]
            _step(net, np.concatenate([feats[stops[i] - counts[i]:stops[i]] for i in drawn]), counts[drawn], toxic[drawn], hands, squared)
    return net


def _step(net: Network, feats: np.ndarray, counts: np.ndarray, toxic: np.ndarray, hands: dict, squared: np.ndarray) -> None:
    pooled, where, rows, words = net.pooled(feats, counts, places=True)
    score = 1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.bias, -30, 30)))
    slope = (score - toxic) / len(toxic)
    back = slope[:, None] * net.weights * (pooled > 0)
    net.weights = hands["weights"].step(net.weights, pooled.T @ slope + 1e-4 * net.weights)
    net.bias = float(hands["bias"].step(net.bias, slope.sum()))
    moved, change = [], []
    for i, (width, filters) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        part = back[:, i * FILTERS:(i + 1) * FILTERS]
        gradient = np.zeros(filters.shape)
        for j in range(width):
            gradient[j] = np.einsum("nf,nfd->df", part, words[where[i] + j])
            moved.append((where[i] + j).ravel())
            change.append((part[:, :, None] * filters[j].T[None]).reshape(-1, filters.shape[1]))
        net.filters[i] = hands["f", i].step(filters, gradient).astype(np.float32)
        net.offsets[i] = hands["o", i].step(net.offsets[i], part.sum(0)).astype(np.float32)
    # Embeddings of the words that won a filter: one step each, smaller for features moved often.
    moved, change = rows[np.concatenate(moved)], np.concatenate(change)
    number, inverse = np.unique(moved, return_inverse=True)
    total = np.zeros((len(number), change.shape[1]))
    np.add.at(total, inverse.reshape(moved.shape), change[:, None, :])
    squared[number] += (total ** 2).sum(1)
    total[number == 0] = 0
    net.embedding[number] -= (0.05 * total / np.sqrt(squared[number])[:, None]).astype(np.float32)


def threshold(bins: np.ndarray, toxic: np.ndarray, rows: np.ndarray, least: int = LEAST_ROWS) -> float:
    """Where precision and recall balance best, from the rows and toxic rows of each bin of scores; 0.5 with fewer
    than ``least`` rows of a class."""
    if min(toxic.sum(), rows.sum() - toxic.sum()) < least:
        return 0.5
    order = np.argsort(-bins)
    f1 = 2 * np.cumsum(toxic[order]) / (np.cumsum(rows[order]) + toxic.sum())
    best = int(np.argmax(f1))
    below = bins[order[best + 1]] + 1 if best + 1 < len(order) else 0
    return float(np.clip((bins[order[best]] + below) / 2 / BINS, 0.1, 0.9))


def outside_held_out(labels: DataFrame) -> DataFrame:
    """(label_id, toxic) of the labelled rows that training and calibration may see."""
    named = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    return named.where(fold("label_id") != HELD_OUT).groupBy("label_id").agg(F.max("toxic").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  rows: int = TRAIN_ROWS):
    """At most ``rows`` labelled rows of each class outside the held-out fold: texts, labels, languages."""
    named = outside_held_out(labels)
    chosen = [named.where(F.col("toxic") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(rows) for k in (0, 1)]
    # At most 2 x rows pairs of an id and a label: a bounded side.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang"))
    found = narrow.join(picked, narrow["doc_id"] == picked["label_id"]).drop("doc_id")
    found = found.orderBy("label_id", "text").limit(2 * rows)
    return found.select("text", "lang", "toxic").toArrow()


def fold(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           rows: int = TRAIN_ROWS) -> Network:
    sample = training_rows(docs, labels, doc_id, text, lang, rows)
    raw = [x.encode() for x in sample.column("text").to_pylist()]
    toxic = np.array(sample.column("toxic").to_pylist(), np.int64)
    net = trained(raw, toxic)
    if not net.filters:
        return net
    named = outside_held_out(labels)
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    n = dict(ids.join(named, ids["doc_id"] == named["label_id"]).groupBy("toxic").count().collect())
    net.bias += float(np.log(n[1] / n[0]) - np.log(toxic.sum() / (len(toxic) - toxic.sum())))
    net.thresholds = calibrated(docs, named, net, doc_id, text, lang)
    return net


def calibrated(docs: DataFrame, named: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, float]:
    """The threshold of each language over all documents that ``named`` labels."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"))
    # Texts don't move: counted few, the labels go out and other texts aren't scored; else all are, and scores move.
    if named.count() <= BROADCAST_ROWS:
        source = source.join(F.broadcast(named.select("label_id")), F.col("doc_id") == F.col("label_id"), "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, "text", CHUNK):
            bins = np.minimum(shared.value.scores(raw) * BINS, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins)], names=["doc_id", "lang", "bin"])

    found = source.mapInArrow(binned, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang string, bin int")
    counts = found.join(named, found["doc_id"] == named["label_id"]).groupBy("lang", "bin").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows"))
    known = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "toxic", "rows")).alias("bins"), F.sum("toxic").alias("t"), F.sum("rows").alias("n"))
    enough = known.where(F.least(F.col("t"), F.col("n") - F.col("t")) >= LEAST_ROWS)
    return {r.lang: threshold(*np.array(r.bins, np.int64).T) for r in enough.select("lang", "bins").collect()}


def scored(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted, and toxic by the threshold of the language."""
    source = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == HELD_OUT).alias("held_out"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, toxic boolean"
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, "text", CHUNK):
            values, toxic = _judged(shared.value, raw, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values), pa.array((values >= 0.5).astype(np.int32)), pa.array(toxic)],
                names=["doc_id", "held_out", "score", "predicted", "toxic"])

    return source.mapInArrow(score, schema)


def _judged(net: Network, raw: list[bytes], langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = net.scores(raw)
    return values, values >= np.array([net.thresholds.get(x or "", 0.5) for x in langs.to_pylist()])


def without_toxic(docs: DataFrame, net: Network, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, all columns kept, whose score is below their language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, text, CHUNK):
            _, toxic = _judged(shared.value, raw, batch.column(batch.schema.get_field_index(lang)))
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(keep, docs.schema)
