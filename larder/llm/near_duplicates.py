"""Near-duplicate documents by BagMinHash.

A document is its bag of 5-word shingles (lower-cased words; a text of fewer words is one
shingle). Its signature comes from Poisson processes over the weight axis: for each shingle
the axis is cut into the dyadic stretches (0,1], (1,2], (2,4], ..., each with a process of
its own whose points carry a time, a signature place and a level within the stretch; points
above the shingle's weight don't count. The earliest point at each place is the signature,
so two signatures agree at a place with probability of the weighted Jaccard similarity of
the bags. A process ends as soon as it is later than all places of its document.

Bands of the signature give buckets. Each member of a bucket is compared with the bucket's
hub by exact multiset overlap. Buckets whose members are not all of one class after that
are joined into clusters, and within a cluster all pairs of different classes are compared,
in blocks of bounded size, each block giving no more links than it has documents. So no
candidate is dropped, and no group is expanded into rows for all its pairs.

Equal texts are copies of each other whatever they hold, and a null text counts as empty.
Nodes are texts (by a 128-bit hash), so repeated rows, and repeated or null ids, take the
class of their text. The class id is the least doc_id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.staging import removed, sent_if_small, staged
from larder.llm.texts import Flat, chunked, mix, positions, windows

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
BLOCK = 256
_WORD = np.array([chr(b).isalnum() and b < 0x80 or b >= 0x80 for b in range(256)])
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(raw: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and weight, sorted by text and hash."""
    flat = Flat([x.decode().lower().encode() for x in raw])
    words = flat.runs(_WORD)
    hashes = words.hashes()
    at = positions(words.doc_starts, words.per_doc, width)
    doc, shingle = [words.doc[at]], [windows(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)]
    for n in range(1, width):
        short = np.flatnonzero(words.per_doc == n)
        if len(short):
            doc.append(short)
            shingle.append(windows(hashes, n)[words.doc_starts[short]] ^ np.uint64(n))
    doc, shingle = np.concatenate(doc).astype(np.int64), np.concatenate(shingle)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[first], shingle[first], np.diff(np.append(first, len(doc)))


def occurrences(raw: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Bags as sets: the i-th occurrence of a shingle is an element of its own. Sorted."""
    doc, shingle, weight = bags(raw, width)
    number = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        element = mix(np.repeat(shingle, weight) + number.astype(np.uint64) * _GOLDEN)
    per_doc = np.bincount(np.repeat(doc, weight), minlength=len(raw))
    return [np.sort(x) for x in np.split(element, np.cumsum(per_doc)[:-1])] if raw else []


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, places: int = BANDS * ROWS) -> np.ndarray:
    """Earliest time at each place of each of ``n`` texts; infinite for texts without shingles."""
    owner, seed, low = [doc], [shingle], [np.zeros(len(doc), np.int64)]
    size = [np.ones(len(doc), np.int64)]
    stretch = 1
    while (heavy := np.flatnonzero(weight > stretch)).size:
        owner.append(doc[heavy])
        with np.errstate(over="ignore"):
            seed.append(mix(shingle[heavy] + np.uint64(stretch)))
        low.append(np.full(len(heavy), stretch))
        size.append(np.full(len(heavy), stretch))
        stretch *= 2
    limit = np.concatenate([weight] + [weight[weight > s] for s in (1 << np.arange(len(owner) - 1))])
    owner, seed, low, size = map(np.concatenate, (owner, seed, low, size))
    first = np.full(n * places, np.inf)
    latest = np.full(n, np.inf)
    time = np.zeros(len(owner))
    step = 0
    while len(owner):
        step += 1
        with np.errstate(over="ignore"):
            draw = mix(seed + np.uint64(step) * _GOLDEN)
            other = mix(draw ^ _GOLDEN)
        time = time - np.log1p(-((draw >> np.uint64(11)) * 2.0 ** -53)) / size
        place = ((other >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
        counts = low + (((other & np.uint64(0xFFFFFFFF)) * size.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) < limit
        np.minimum.at(first, (owner * places + place.astype(np.int64))[counts], time[counts])
        if step <= 8 or step % 8 == 0:
            open_ = np.unique(owner)
            latest[open_] = first.reshape(n, places)[open_].max(1)
            live = time <= latest[owner]
            owner, seed, low, size, limit, time = (x[live] for x in (owner, seed, low, size, limit, time))
    return first.reshape(n, places)


def bands(signature: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band, the band's number included."""
    bits = signature.view(np.uint64).reshape(len(signature), n_bands, rows)
    with np.errstate(over="ignore"):
        total = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64)[None], bits.shape[:2]) * _GOLDEN
        for j in range(rows):
            total = mix(total ^ bits[:, :, j])
    return total.view(np.int64)


def link(text: str) -> Column:
    """A text's node."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, link and bands (none for texts without words)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), link(text).alias("link"), F.col(text).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, link binary, bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, "text"):
            doc, shingle, weight = bags(raw)
            full = np.bincount(doc, minlength=len(raw)) > 0
            found = bands(signatures(doc, shingle, weight, len(raw)))[full]
            edges = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edges), pa.array(found.ravel()))],
                names=["doc_id", "link", "bands"])

    return source.mapInArrow(sign, schema)


def bucket_members(found: DataFrame) -> DataFrame:
    """(band, link, hub) for every text in a bucket of two or more texts."""
    rows = found.where(F.size("bands") > 0).dropDuplicates(["link"]).select("link", F.explode("bands").alias("band"))
    rows = staged(rows, "bands")
    shared = rows.groupBy(F.col("band").alias("of")).agg(F.min("link").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = staged(rows.join(shared, rows["band"] == shared["of"]).select("band", "link", "hub"), "buckets")
    removed(rows)
    return members


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of links whose texts' bags overlap enough."""
    left = texts.select(F.col("link").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("link").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, "text_a"):
            other = [x.encode() for x in batch.column(3).to_pylist()]
            keep = [overlap(x, y) >= similarity for x, y in zip(occurrences(raw), occurrences(other), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "a binary, b binary")


def _rest_of_clusters(members: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between classes that meet in a bucket of three or more, found by comparing all pairs of their clusters."""
    known = members.join(classes, members["link"] == classes["node"], "left").select(
        "band", "link", "hub", F.coalesce("root", "link").alias("class"))
    mixed = known.groupBy(F.col("band").alias("of")).agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    rest = known.join(mixed.where("n > 2 AND low <> high"), F.col("band") == F.col("of")).select("link", "hub", "class")
    rest = staged(rest.distinct(), "unsettled")
    if rest.isEmpty():
        return classes.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)
    clusters = components(rest.select(F.col("link").alias("a"), F.col("hub").alias("b")))
    nodes = rest.select("link", "class").distinct().join(clusters, F.col("link") == F.col("node")).select("link", "class", F.col("root").alias("cluster"))
    sizes = nodes.groupBy(F.col("cluster").alias("of")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = nodes.join(sizes, F.col("cluster") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("link"), F.col("blocks")).cast("int"))
    # A block meets every other one: a member goes to each pair of blocks that holds its own.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "link", "class")
    mixed_pairs = dealt.groupBy("cluster", "i", "j").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").drop("low", "high")
    dealt = dealt.join(mixed_pairs, ["cluster", "i", "j"]).join(texts, "link")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(list(rows["link"]), list(rows["class"]), [x.encode() for x in rows["text"]], similarity), columns=["a", "b"])

    return dealt.groupBy("cluster", "i", "j").applyInPandas(compare, "a binary, b binary")


def block_links(links: list[bytes], classes: list[bytes], raw: list[bytes], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that join classes: enough to connect all classes that any pair of these texts connects, no more."""
    sets = occurrences(raw)
    sizes = np.array([len(s) for s in sets])
    element, inverse, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    names, of = np.unique(np.array(classes, object), return_inverse=True)
    largest = np.bincount(of).argmax()
    minor = np.flatnonzero(of != largest)
    row_of = np.full(len(sets), -1)
    row_of[minor] = np.arange(len(minor))
    common = np.zeros((len(minor), len(sets)), np.float32)
    shared = np.flatnonzero(held > 1)
    column = np.full(len(element), -1)
    for at in range(0, len(shared), 4096):
        column[:] = -1
        part = shared[at:at + 4096]
        column[part] = np.arange(len(part))
        c = column[inverse]
        here = c >= 0
        matrix = np.zeros((len(sets), len(part)), np.float32)
        matrix[owner[here], c[here]] = 1
        common += matrix[minor] @ matrix.T
    union = sizes[minor][:, None] + sizes[None] - common
    parent = list(range(len(names)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(common >= similarity * np.maximum(union, 1)), strict=True):
        a, b = top(of[minor[i]]), top(of[j])
        if a != b:
            parent[a] = b
            out.append((links[minor[i]], links[j]))
    return out


def classes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The (doc_id, link) rows of the documents, and (node, root) of the texts that have near duplicates."""
    found = staged(signed(docs, doc_id, text), "signatures")
    members = bucket_members(found)
    pairs = staged(members.where("link <> hub").select(F.col("hub").alias("a"), F.col("link").alias("b")).distinct(), "candidates")
    wanted = staged(pairs.select(F.col("a").alias("link")).unionByName(pairs.select(F.col("b").alias("link"))).distinct(), "wanted")
    texts = docs.select(link(text).alias("link"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = staged(texts.join(sent_if_small(wanted), "link", "left_semi").dropDuplicates(["link"]), "candidate-texts")
    first = staged(verified(pairs, texts, similarity), "links")
    by_hub = components(first)
    more = _rest_of_clusters(members, by_hub, texts, similarity)
    # What hangs on hubs has been settled: only the links between classes are new.
    nodes = components(by_hub.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(staged(more, "more-links")))
    for done in (members, pairs, wanted, texts):
        removed(done)
    return found.select("doc_id", "link"), nodes


def classed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, size of the class, and whether the row stays if one document of each class does."""
    return _classed(*classes_of(docs, doc_id, text, similarity))


def _classed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    rooted = rows.join(nodes, rows["link"] == nodes["node"], "left").select("doc_id", "link", F.coalesce("root", "link").alias("root"))
    chosen = rooted.groupBy(F.col("root").alias("of")).agg(F.min(F.struct("doc_id", "link")).alias("first"), F.count("*").alias("class_size"))
    both = rooted.join(chosen, rooted["root"] == chosen["of"])
    return both.select("doc_id", "link", F.col("first.doc_id").alias("class_id"), "class_size",
                       F.struct("doc_id", "link").eqNullSafe(F.col("first")).alias("stays"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, all columns kept; of rows that repeat id and text, one."""
    rows, nodes = classes_of(docs, doc_id, text, similarity)
    judged = _classed(rows, nodes).groupBy(F.col("doc_id").alias("__id"), F.col("link").alias("__link")).agg(
        F.bool_or("stays").alias("__stays"), F.count("*").alias("__times"))
    # Most documents stay, once: only the others have to be known.
    special = staged(judged.where("NOT __stays OR __times > 1"), "special")
    for done in (rows, nodes):
        removed(done)
    repeats = not special.where("__times > 1").isEmpty()
    special = sent_if_small(special)
    both = docs.join(special, docs[doc_id].eqNullSafe(special["__id"]) & (link(text) == special["__link"]), "left")
    plain = both.where("__stays IS NULL")
    if repeats:
        plain = plain.unionByName(both.where("__stays").dropDuplicates(["__id", "__link"]))
    return plain.select(*docs.columns)
