"""Filter interaction audit: what each filter does at each place of each order, from wide packed counters.

Every document gets a mask of the filters that it fails. For each mask one big integer holds,
in a field of ``WIDTH`` bits each, what happens at all 600 steps (120 orders of five filters):
kept, removed here, or failing but removed earlier. The integers of a part's documents are
summed; equal ones are counted first, by Spark's own aggregate, so a part meets in one task
as at most 128 rows (mask, quality, toxicity) whatever its size. No field can run into its
neighbour: it counts rows of a part, and those fit into a long.

Filters: A under 100 words; B 100 x different words < 80 x words; C 100 x capitals A-Z > 10 x
code points; D any of ``#$%&*|``; E a text that a smaller doc_id has too, table-wide.

Defined results: a null text is empty; a null part is the empty string; a row without a
doc_id is neither smaller nor larger than another, so it never fails E and has no labels;
repeated rows are counted each, and none of the rows with a text's least doc_id fails E.
Several label rows of a document count as one that holds if any holds. No documents, no parts.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.staging import staged

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
STEPS = len(ORDERS) * len(FILTERS)
KINDS = ("kept", "removed", "redundant")
WIDTH = 64
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "[^A-Z]+"
SYMBOLS = "[#$%&*|]"
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def own_mask(text: Column) -> Column:
    """Bits of the filters that look at one text only: A is 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, CAPITALS, ""))
    fails = [n < 100, F.lit(100) * different < F.lit(80) * n, F.lit(100) * capitals > F.lit(10) * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters that they fail and by label."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = staged(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                              own_mask(whole).alias("mask"), F.unhex(F.sha2(whole, 256)).alias("key")), "masks")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = rows.where("id IS NOT NULL")
    marked = known.join(marks, known["id"] == marks["of"], "left").select(
        "id", "part", "mask", "key", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # Repeated rows first, then the rows of a text: both sums start before the rows move, so a common text is a row per task.
    cell = ["key", "part", "mask", "good", "toxic"]
    once = marked.groupBy("id", *cell).agg(F.count("*").alias("n"))
    cells = once.groupBy(*cell).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("key"))  # over a row per part and label of the text
    split = cells.withColumn("own", F.when(F.col("first.id") == least, F.col("first.n")).otherwise(F.lit(0)))
    counted = split.groupBy("part", "mask", "good", "toxic").agg(F.sum("own").alias("own"), F.sum(F.col("n") - F.col("own")).alias("later"))
    nameless = rows.where("id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("own")).select(
        "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "own", F.lit(0).cast("long").alias("later"))
    both = F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("later").alias("n")))
    return (counted.unionByName(nameless).select("part", "good", "toxic", F.inline(both)).where("n > 0")
            .groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")))


@lru_cache(maxsize=32)
def outcomes(mask: int) -> dict[str, int]:
    """For each kind, one integer of ``STEPS`` fields: 1 where the step (order by order) has that outcome for the mask."""
    fields = dict.fromkeys(KINDS, 0)
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            fails = bool(mask >> FILTERS.index(letter) & 1)
            kind = ("redundant" if fails else None) if gone else ("removed" if fails else "kept")
            gone = gone or fails
            if kind:
                fields[kind] |= 1 << WIDTH * (o * len(FILTERS) + s)
    return fields


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of ``outcomes``."""
    return np.frombuffer(total.to_bytes(STEPS * WIDTH // 8, "little"), "<i8")


def audit_of(mask: list[int], good: list[bool], toxic: list[bool], n: list[int]) -> dict[str, np.ndarray]:
    """All steps' counts of one part from its documents by mask and label."""
    total = dict.fromkeys([*KINDS, "good_lost", "toxic_lost"], 0)
    alone = dict.fromkeys(FILTERS, 0)
    for m, g, t, count in zip(mask, good, toxic, n, strict=True):
        fields = outcomes(m)
        for kind in KINDS:
            total[kind] += count * fields[kind]
        total["good_lost"] += g * count * fields["removed"]
        total["toxic_lost"] += t * count * fields["removed"]
        if m and not m & (m - 1):
            alone[FILTERS[m.bit_length() - 1]] += count
    out = {kind: unpacked(x) for kind, x in total.items()}
    letters = np.array([letter for order in ORDERS for letter in order])
    shapley = {letter: int(out["removed"][letters == letter].sum()) for letter in FILTERS}
    return out | {"unique_fails": np.array([alone[x] for x in letters]), "shapley": np.array([shapley[x] for x in letters])}


def audit(counted: DataFrame) -> DataFrame:
    """Per part, order and step what the step's filter does, from ``masks``."""
    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        found = audit_of(*[rows[c].tolist() for c in ("mask", "good", "toxic", "n")])
        places = pd.DataFrame({"part": rows["part"].iloc[0], "filter_order": np.repeat(ORDERS, len(FILTERS)),
                               "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))})
        return places.assign(**found)[[x.split()[0] for x in RESULT.split(", ")]]

    return counted.groupBy("part").applyInPandas(steps, RESULT)
