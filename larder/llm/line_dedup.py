"""Line dedup: lines that repeat across unrelated documents go, by classes of the edit join.

Every text that holds a line of a class is judged by itself: the text that keeps the line and its
near copies (verified, and in one class of the near-duplicate operator) keep it, all others lose
it. Near copies keep their lines since that operator, which leaves one of them, needs to see them.
A line stays in the text with the least doc_id, null ids first, among those that the near-duplicate
operator would keep; only if there is none, among their copies.

Null texts stay null and empty ones empty; a text that had words and loses them all goes.
Repeated rows are one text: they keep and lose the same lines. Other columns are kept as
they are, whatever their names; a column ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.line_join import digest, lines, links
from larder.llm.near_duplicates import classes_of
from larder.llm.staging import removed, sent_if_small, staged
from larder.llm.texts import chunked

SPACE = b" \t\r\x0b\x0c"
THRESHOLD, LEAST_WORDS = 3, 5


def held_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_link, links): each text's different lines of at least ``LEAST_WORDS`` words."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, "text"):
            own = [list({digest(x) for x in lines(t) if len(x.split()) >= LEAST_WORDS}) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(t) for t in raw], pa.binary()), pa.array(own, pa.list_(pa.binary()))],
                names=["doc_id", "text_link", "links"])

    return source.mapInArrow(hold, f"doc_id {kind}, text_link binary, links array<binary>")


def repeated_lines(held: DataFrame, nodes: DataFrame, copies: DataFrame) -> DataFrame:
    """(text_link, drop): the lines to drop from each text.

    ``nodes`` has the classes of near-equal lines, ``copies`` those of near-duplicate texts. A class
    of lines goes from every text that is not in the class of the text that keeps it.
    """
    texts = held.groupBy("text_link").agg(F.min("doc_id").alias("first_doc"))
    texts = texts.join(copies.select(F.col("node").alias("text_link"), F.col("root").alias("class")), "text_link", "left")
    texts = staged(texts, "held-texts")
    heads = texts.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("first_doc", "text_link"))["text_link"].alias("text_link"))
    texts = texts.join(heads.select("text_link", F.lit(True).alias("head")), "text_link", "left").select(
        "text_link", "first_doc", F.coalesce("class", "text_link").alias("class"), (F.col("class").isNotNull() & F.col("head").isNull()).alias("copy"))
    one = held.dropDuplicates(["text_link"]).drop("doc_id")
    flat = one.join(texts, "text_link").select("text_link", "first_doc", "class", "copy", F.explode("links").alias("link"))
    flat = flat.join(nodes, flat["link"] == nodes["node"], "left").withColumn("root", F.coalesce("root", "link")).drop("node")
    flat = staged(flat, "held-lines")
    kept = flat.groupBy(F.col("root").alias("of")).agg(
        F.min(F.struct("copy", "first_doc", "text_link", "class"))["class"].alias("stays"), F.min("class").alias("low"), F.max("class").alias("high"))
    kept = staged(kept.where("low <> high").select("of", "stays"), "holders")
    going = flat.join(kept, (flat["root"] == kept["of"]) & (flat["class"] != kept["stays"]))
    found = staged(going.groupBy("text_link").agg(F.collect_set("link").alias("drop")), "repeated-lines")
    for done in (flat, kept):
        removed(done)
    return found


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, n_chars: str = "n_chars") -> DataFrame:
    """The documents, all columns kept, without lines that repeat in the document or in unrelated ones.

    Documents that lose all their words go. A column ``n_chars`` follows the text.
    """
    rows, copies = classes_of(docs, doc_id, text)
    removed(rows)
    found = links(docs, text, threshold)
    nodes = staged(components(found), "line-classes")
    held = staged(held_lines(docs, doc_id, text), "text-lines")
    drops = repeated_lines(held, nodes, copies)
    for done in (copies, found, nodes, held):
        removed(done)
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    both = docs.withColumn("__text_link", key).join(sent_if_small(drops, weight="drop").select(F.col("text_link").alias("__drop_link"), F.col("drop").alias("__drop")),
                                                    F.col("__text_link") == F.col("__drop_link"), "left").drop("__text_link", "__drop_link")
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, text):
            drop = batch.column(len(names)).to_pylist()
            cut = [_without(x, set(d or ())) for x, d in zip(raw, drop, strict=True)]
            keep = [x == y or bool(y.strip()) for x, y in zip(raw, cut, strict=True)]
            columns = []
            for name, column in zip(names, batch.columns, strict=False):
                if name == text:
                    column = pa.array([y if known else None for y, known in zip(cut, column.is_valid().to_pylist(), strict=True)], pa.binary()).cast(column.type)
                elif name == n_chars:
                    column = pa.array([old if x == y else len(y.decode()) for old, x, y in zip(column.to_pylist(), raw, cut, strict=True)], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(clean, docs.schema)


def _without(raw: bytes, drop: set[bytes]) -> bytes:
    """The text without the dropped lines and without later repeats of a line; the rest as it is."""
    if b"\n" not in raw and not drop:
        return raw
    seen, out = set(), []
    for line in raw.split(b"\n"):
        bare = line.strip(SPACE)
        if bare:
            link = digest(bare)
            if link in drop or link in seen and len(bare.split()) >= LEAST_WORDS:
                continue
            seen.add(link)
        out.append(line)
    return b"\n".join(out)
