"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of a group (equal texts, in the query) are linked with each other. Linked
documents start in shards dealt by hash and then move, a round at a time, to the shard
where most of their group is. A round is a join of documents with their group's counts by
shard. Every shard has a capacity, its even share of all rows, so moves from one shard to
another are let in by gain, largest first, as far as moves the other way and the target's
free room allow; where to stop is read off a small table of candidates by gain and bucket.
Documents without links fill what is left, which keeps row counts at most one apart (law
``rows``) and cuts no group.

Equal texts weigh alike, so the counts by group and shard stand for all pairs within the
group, and a group of any size is never expanded. Sums are made map-side before shuffling;
a group that holds a large part of all rows meets its counts in a join that Spark can split.

Null texts count as empty texts, of size 1. Rows are told apart by position in the written
stage, so repeated rows and repeated or null ids are sharded as rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.staging import removed, staged

SHARDS, ROUNDS = 8, 3
LEVELS, BUCKETS = 32, 256       # of gain, and of hashed documents, in the table of candidates
RANK_ROWS = 50_000              # expected rows ranked by one task


def linked_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A narrow row for each document: what links it (a hash of its text), its size and checksum."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("link"))


def _hash(*columns: str, below: int, seed: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(below)).cast("int")


def shares(total: int, shards: int) -> list[int]:
    return [(s + 1) * total // shards - s * total // shards for s in range(shards)]


def propagated(rows: DataFrame, shares_: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Rows (row, link, shard) after label propagation under the shards' quotas."""
    shards = len(shares_)
    state = rows.withColumn("shard", _hash("row", below=shards, seed="start"))
    for k in range(rounds):
        nxt = staged(_moved(state, shares_), f"shard-round-{k}")
        if k:
            removed(state)
        state = nxt
    return state


def _moved(state: DataFrame, shares_: list[int]) -> DataFrame:
    shards = range(len(shares_))
    # One row per group: how many of it each shard holds, and where most are; ties go by a hash
    # of group and shard, so that all of a group agree.
    counts = [F.count_if(F.col("shard") == s).alias(f"n{s}") for s in shards]
    best = F.greatest(*(F.struct(F.col(f"n{s}").alias("n"), F.xxhash64("link", F.lit(s)).alias("tie"), F.lit(s).alias("shard")) for s in shards))
    groups = state.groupBy("link").agg(*counts).select(
        F.col("link").alias("group"), best["shard"].alias("target"), F.array(*(F.col(f"n{s}") for s in shards)).alias("held"))
    wish = state.join(groups, state["link"] == groups["group"]).withColumn(
        "gain", F.get("held", F.col("target")) - F.get("held", F.col("shard"))).drop("held", "group")
    wish = wish.withColumn("level", F.least(F.lit(LEVELS - 1), F.floor(F.log2(F.col("gain") + 1) * 2)).cast("int"))
    wish = wish.withColumn("bucket", _hash("row", below=BUCKETS, seed="move"))
    moving = F.col("shard") != F.col("target")
    table = wish.groupBy("shard", "target", "level", "bucket").agg(F.count("*").alias("n"))
    # The table has at most shards x shards x LEVELS x BUCKETS rows, whatever the input.
    limits = _let_in(table, moving, shares_)
    pair = (wish["shard"] == limits["out_of"]) & (wish["target"] == limits["into"])
    joined = wish.join(F.broadcast(limits), pair, "left")
    order = F.col("level") * BUCKETS + F.col("bucket")
    goes = moving & (order >= F.coalesce("least", F.lit(1 << 30)))
    return joined.select("row", "link", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard"))


def _let_in(table: DataFrame, moving: Column, shares_: list[int]) -> DataFrame:
    """For each pair of shards the least order of moves let in (a row per pair).

    A pair's quota is what wants to go the other way, which keeps both even, and the pair's part of the
    target's free room.
    """
    share = F.element_at(F.array(*map(F.lit, shares_)), F.col("into") + 1)
    present = table.groupBy(F.col("shard").alias("at")).agg(F.sum("n").alias("present"))
    wishes = table.where(moving).groupBy(F.col("shard").alias("out_of"), F.col("target").alias("into"),
                                         (F.col("level") * BUCKETS + F.col("bucket")).alias("order")).agg(F.sum("n").alias("n"))
    volume = wishes.groupBy("out_of", "into").agg(F.sum("n").alias("volume"))
    back = volume.select(F.col("out_of").alias("back_into"), F.col("into").alias("back_from"), F.col("volume").alias("back"))
    quotas = volume.join(back, (F.col("out_of") == F.col("back_into")) & (F.col("into") == F.col("back_from")), "left")
    quotas = quotas.join(present, F.col("into") == F.col("at"), "left")
    part = F.col("volume") / F.sum("volume").over(Window.partitionBy("into"))
    room = F.greatest(share - F.coalesce("present", F.lit(0)), F.lit(0))
    quota = F.least("volume", F.coalesce("back", F.lit(0))) + F.floor(room * part)
    quotas = quotas.select(F.col("out_of").alias("q_from"), F.col("into").alias("q_into"), quota.alias("quota"))
    running = wishes.withColumn("running", F.sum("n").over(Window.partitionBy("out_of", "into").orderBy(F.desc("order"))))
    fits = running.join(quotas, (F.col("out_of") == F.col("q_from")) & (F.col("into") == F.col("q_into"))).where(F.col("running") <= F.col("quota"))
    return fits.groupBy("out_of", "into").agg(F.min("order").alias("least"))


def ranked(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` with an exact 0-based ``rank`` within ``class``, rows of a group side by side.

    Rows are dealt into cells of class and hash bucket, numbered within the cell, and shifted by the
    rows in the cells before; only the cells (one for about RANK_ROWS rows) meet in one window.
    """
    before = F.sum("n").over(Window.partitionBy("class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    shift = cells.select(F.col("class").alias("of_class"), F.col("cell").alias("of_cell"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "cell").orderBy("link", "row")) - 1
    numbered = rows.withColumn("within", within)
    joined = numbered.join(shift, (F.col("class") == F.col("of_class")) & (F.col("cell") == F.col("of_cell")))
    return joined.withColumn("rank", F.col("before") + F.col("within")).drop("of_class", "of_cell", "before", "within")


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), and the number of equal texts."""
    base = staged(linked_rows(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = base.count()
    shares_ = shares(total, shards)
    groups = base.groupBy("link").agg(F.count("*").alias("copies"))
    grouped = staged(base.join(groups.withColumnRenamed("link", "group"), F.col("link") == F.col("group")).drop("group"), "shard-groups")
    linked = propagated(grouped.where("copies > 1").select("row", "link"), shares_, rounds)
    places = linked.select(F.col("row").alias("of_row"), F.col("shard").alias("class"))
    both = grouped.join(places, F.col("row") == F.col("of_row"), "left").drop("of_row")
    # Class ``shards`` holds the documents without links. A large group takes several cells.
    wide = F.least(F.lit(1 << 16), F.ceil(F.col("copies") / RANK_ROWS)).cast("int")
    span = max(1, -(-total // RANK_ROWS))
    cell = _hash("link", below=span, seed="cell").cast("long") * (1 << 16) + F.pmod(F.xxhash64("row"), wide)
    both = both.withColumn("class", F.coalesce("class", F.lit(shards))).withColumn("cell", cell)
    cells = both.groupBy("class", "cell").agg(F.count("*").alias("n"))
    sums = cells.groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("class") == s, F.col("n"))), F.lit(0)).alias(f"t{s}") for s in range(shards + 1)))
    done = _placed(ranked(both, cells).crossJoin(F.broadcast(sums)), shares_)  # one row of totals
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "copies")


def _placed(ranks: DataFrame, shares_: list[int]) -> DataFrame:
    """Shard and slot from class and rank: linked rows stay where the shard has room, all others fill what is free, in order."""
    n = len(shares_)
    have = [F.col(f"t{s}") for s in range(n)]
    over = [F.greatest(h - c, F.lit(0)) for h, c in zip(have, shares_, strict=True)]
    free = [F.greatest(F.lit(c) - h, F.lit(0)) for h, c in zip(have, shares_, strict=True)]
    before_over, before_free = [F.lit(0)], [F.lit(0)]
    for s in range(n):
        before_over.append(before_over[-1] + over[s])
        before_free.append(before_free[-1] + free[s])
    arrays = ranks.withColumns({"share": F.array(*map(F.lit, shares_)), "have": F.array(*have), "over_before": F.array(*before_over),
                                "free_before": F.array(*before_free)})
    of = F.col("class")
    stays = (of < n) & (F.col("rank") < F.get("share", of))
    spill = F.when(of < n, F.get("over_before", of) + F.col("rank") - F.get("share", of)).otherwise(F.get("over_before", F.lit(n)) + F.col("rank"))
    marked = arrays.withColumn("spill", spill).withColumn("stays", stays)
    into = F.size(F.filter("free_before", lambda x: x <= F.col("spill"))) - 1
    marked = marked.withColumn("shard", F.when(F.col("stays"), of).otherwise(into).cast("int"))
    start = F.least(F.get("have", F.col("shard")), F.get("share", F.col("shard")))
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(start + F.col("spill") - F.get("free_before", F.col("shard")))
    return marked.withColumn("slot", slot.cast("long"))
