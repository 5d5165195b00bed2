"""Near-equal lines by a segment-partition edit join.

Two lines within ``threshold`` edits agree in at least one of threshold + 1 segments of the shorter one,
at a place that differs by few positions. So each line is indexed by its segments, and probes the
indexes of its own and of slightly smaller lengths with the substrings at the places that can matter.
Lengths are taken in classes of a few: segments are as long as the least length of the class has them,
half of them counted from the line's start and half from its end, so that one substring serves for every
length of a class. Lines that meet and are about as long are compared by edit distance: per number of edits
and diagonal the furthest place reached, by runs of equal letters (many pairs in step).

How many edits are few depends on the length: a line of n code points may differ by n // ``EVERY`` edits,
``threshold`` at most, from one that is as long or longer. Very short lines are near only if equal.

What moves is a key and the number of a line, 16 bytes, and then the texts of lines that met
another. A bucket of up to ``CROWD`` lines gives its pairs. In a larger one the lines are dealt to blocks, and
each two blocks are compared in a task, which gets their texts and gives only links. There counts of letters and of
letters next to each other come first, as an edit changes those by two and four at most; only pairs that
pass, and that no smaller key brings together, go on to the edit distance. A key that is common within
one task's texts is marked there, and its rows are spread over all tasks instead of meeting in one. No
candidate is dropped.

A line is the text between newlines, without white space at its ends. Empty lines
are lines too, but belong to no class. Null texts have no lines; neither have empty ones.
Repeated rows give repeated lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.staging import removed, sent_if_small, staged
from larder.llm.texts import chunked, mix

THRESHOLD, EVERY = 3, 10
CROWD, BLOCK = 8, 512
CHUNK = 1 << 19
LETTERS, NEIGHBOURS = 32, 96  # counts of a sketch: of letters, and of two letters next to each other
_M = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_M, -1, 1 << 64))
_SPACE = b" \t\r\x0b\x0c"
LENGTHS = 64  # a line's number has its length modulo this; more than the lengths that meet by a key
MARK = -1  # in place of a line: its key is common
MET = "key long, a long, b long"


def lines(raw: bytes) -> list[bytes]:
    return [x.strip(_SPACE) for x in raw.split(b"\n")] if raw else []


def digest(line: bytes) -> bytes:
    return hashlib.md5(line, usedforsecurity=False).digest()


def number(digests: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Names of lines that fit into a long: 57 bits of the digest, the length modulo ``LENGTHS``, and a bit to spare."""
    found = np.frombuffer(b"".join(x[:8] for x in digests), "<i8") & ~(2 * LENGTHS - 1) | lengths % LENGTHS * 2
    return np.where(found == MARK & ~1, LENGTHS * 2 - 2, found)


def as_long(a: int, b: int, threshold: int) -> bool:
    """Whether the lengths of two lines, by their numbers, may differ by so few."""
    return ((a >> 1) - (b >> 1) + threshold) % LENGTHS <= 2 * threshold


def allowed(length: np.ndarray, threshold: int) -> np.ndarray:
    """Edits by which a line of that length may differ from one that is no shorter."""
    return np.minimum(length // EVERY, threshold)


class Letters:
    """Code points of strings in one array, with hashes of any substring."""

    def __init__(self, strings: list[str]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
        with np.errstate(over="ignore"):
            size = len(points) + 1
            powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(_M))]))
            self.back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[:-2], dtype=np.uint64)])

    def hashes(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        a, b = self.starts[row] + low, self.starts[row] + high
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.back[a] + (high - low).astype(np.uint64) * np.uint64(_M))


def least_length(length: np.ndarray) -> np.ndarray:
    """The least length of a length's class; classes are 16 wide, of lengths below 64 a quarter of the power of two below."""
    wide = np.select([length < 16, length < 32, length < 64], [2, 4, 8], 16)
    return length - length % wide


def places(i: int, delta: int, edits: int) -> range:
    """Shifts of segment ``i`` (from 0) that matter in a line ``delta`` longer, if it is the first agreeing segment or the
    last; later segments are counted from the end."""
    low, high = max(-i, delta - (edits - i)), min(i, delta + (edits - i))
    back = delta if 2 * i > edits else 0
    return range(low - back, high - back + 1)


def meetings(letters: Letters, threshold: int, probes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and role (0 index, 1 probe) of every substring by which a line can meet others, or of the index only."""
    out = []
    for edits in range(1, threshold + 1):
        for delta in range(edits + 1 if probes else 1):
            # Lines that probe lines ``delta`` shorter which allow so many edits.
            row = np.flatnonzero((letters.lengths > delta) & (allowed(letters.lengths - delta, threshold) == edits))
            length = letters.lengths[row]
            least = least_length(length - delta)
            longer = length - delta + 1
            known = (delta > 0) & (least_length(longer) == least) & (allowed(longer, threshold) == edits)
            size = least // (edits + 1)
            for i in range(edits + 1):
                start = length - size * (edits + 1 - i) if 2 * i > edits else size * i
                with np.errstate(over="ignore"):
                    name = mix(least.astype(np.uint64) << np.uint64(12) | np.uint64(edits << 6 | i))
                for shift in places(i, delta, edits) if probes else (0,):
                    ok = (start + shift >= 0) & (start + shift + size <= length)
                    if delta and shift in places(i, delta - 1, edits):
                        ok &= ~known  # the same substring, for longer lines of the class
                    r = row[ok]
                    with np.errstate(over="ignore"):
                        key = mix(letters.hashes(r, (start + shift)[ok], (start + shift + size)[ok]) ^ name[ok])
                    key = np.maximum(key, np.uint64(1))  # 0 stands for none
                    out.append((r, key, np.full(len(r), int(delta > 0 or shift != 0))))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def routed(key: np.ndarray, link: np.ndarray, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(route, link, key) of one task's rows. Rows meet by ``route``, which is their key, and then need none (0). A key
    that more than ``crowd`` of these rows have is only marked there, and its rows go wherever their line's number leads."""
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    hot = counts[where] > crowd
    marks = np.unique(key[hot])
    route = np.concatenate([np.where(hot, mix(link.astype(np.uint64)), key), marks])
    return route, np.concatenate([link, np.full(len(marks), MARK)]), np.concatenate([np.where(hot, key, np.uint64(0)), marks])


def _meeting_rows(threshold: int, crowd: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in chunked(batches, "text", CHUNK):
            here = {digest(x): x.decode() for text in raw for x in lines(text)}
            letters = Letters(list(here.values()))
            row, key, role = meetings(letters, threshold)
            route, link, key = routed(key, number(list(here), letters.lengths)[row] | role, crowd)
            yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(link), pa.array(key.view(np.int64), mask=key == 0)],
                                             names=["route", "link", "key"])

    return emit


def _met(threshold: int, crowd: int):
    """Through rows sorted by route: pairs of small buckets that are about as long, and the rows (key, line, role) of crowded ones."""
    def flush(run: list[int], crowded: bool, key: int | None, out: dict) -> None:
        if crowded:
            for x in run:
                add(out, key, x & ~1, x & 1)
            return
        roles: dict[int, int] = {}
        for link in run:
            roles[link & ~1] = min(link & 1, roles.get(link & ~1, 1))
        for a in [x for x, role in roles.items() if role == 0]:
            for b, role in roles.items():
                if b != a and (role or a < b) and as_long(a, b, threshold):
                    add(out, None, min(a, b), max(a, b))

    def add(out: dict, key: int | None, a: int, b: int) -> None:
        for column, value in zip(out.values(), (key, a, b), strict=True):
            column.append(value)

    def batch_of(out: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, key_of_run, crowded = [], None, False
        for batch in batches:
            out: dict = {"key": [], "a": [], "b": []}
            route, link = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            spread = batch.column(2).is_valid().to_numpy(zero_copy_only=False) & (link != MARK)
            if spread.any():  # what goes by its line's number is not to meet here
                rows = batch.filter(pa.array(spread))
                yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(link[spread] & ~1), pa.array(link[spread] & 1)], names=list(out))
                route, link = route[~spread], link[~spread]
            # Rows alone with their key go no further; the ends of a batch may go on in the next.
            same = route[1:] == route[:-1]
            shared = np.r_[True, same] | np.r_[same, True] if len(route) else np.zeros(0, bool)
            for k, x in zip(route[shared].tolist(), link[shared].tolist(), strict=True):
                if k != key_of_run:
                    flush(run, crowded, key_of_run, out)
                    run, key_of_run, crowded = [], k, False
                if x == MARK:
                    crowded = True
                    continue
                run.append(x)
                if len(run) > crowd:
                    run = list(dict.fromkeys(run))  # the same lines from many tasks
                    if crowded or len({x & ~1 for x in run}) > crowd:
                        flush(run, True, k, out)
                        run, crowded = [], True
            yield batch_of(out)
        out = {"key": [], "a": [], "b": []}
        flush(run, crowded, key_of_run, out)
        yield batch_of(out)

    return walk


def bucketed(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """Pairs of lines (a, b) that met in a small bucket, with no key; (key, line, role) of those in crowded ones."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_meeting_rows(threshold, crowd), "route long, link long, key long")
    dealt = rows.repartition("route").sortWithinPartitions("route")  # one long: a radix sort
    return staged(dealt.mapInArrow(_met(threshold, crowd), MET).distinct(), "line-buckets")


def sketches(letters: Letters, points: np.ndarray) -> np.ndarray:
    """Counts of classes of letters and of pairs of neighbours, capped. One edit changes the sum of the letter
    counts' differences by two at most, and that of the neighbours' by four."""
    n = len(letters.lengths)
    row = np.repeat(np.arange(n), letters.lengths)
    with np.errstate(over="ignore"):
        one = mix(points.astype(np.uint64) + np.uint64(1))
        inside = row[1:] == row[:-1]
        two = mix(one[:-1] * np.uint64(_M) + one[1:])[inside]
        kind = (one % np.uint64(LETTERS)).astype(np.int64)
        pair = (two % np.uint64(NEIGHBOURS)).astype(np.int64) + LETTERS
    size = LETTERS + NEIGHBOURS
    at = np.concatenate([row * size + kind, row[1:][inside] * size + pair])
    return np.minimum(np.bincount(at, minlength=n * size).reshape(n, size), 127).astype(np.int8)


def may_be_near(one: np.ndarray, two: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Whether two rows of sketches allow so few edits."""
    near = np.abs(one[:, :LETTERS] - two[:, :LETTERS]).sum(1) <= 2 * few
    left = np.flatnonzero(near)
    near[left] = np.abs(one[left, LETTERS:] - two[left, LETTERS:]).sum(1) <= 4 * few[left]
    return near


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line of a chunk that may be near another, with its number."""
    for _, raw in chunked(batches, "text", CHUNK):
        here = {digest(x): x.decode() for t in raw for x in lines(t)}
        here = {k: x for k, x in here.items() if len(x) >= EVERY}
        lengths = np.fromiter(map(len, here.values()), np.int64, len(here))
        yield pa.RecordBatch.from_arrays([pa.array(number(list(here), lengths)), pa.array(list(here.values()), pa.string())], names=["link", "line"])


def spelt_lines(docs: DataFrame, met: DataFrame, text: str = "text") -> DataFrame:
    """(link, line) of the lines that met another."""
    wanted = met.select(F.col("a").alias("link")).unionByName(met.where("key IS NULL").select(F.col("b").alias("link"))).distinct()
    wanted = staged(wanted, "wanted-lines")
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_spell, "link long, line string")
    return staged(rows.join(sent_if_small(wanted), "link", "left_semi").dropDuplicates(["link", "line"]), "lines")


def crowded_links(met: DataFrame, spelt: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Near lines of crowded buckets, block against block: a line's text goes to each block pair once, and only links leave it."""
    members = met.where("key IS NOT NULL").groupBy("key", F.col("a").alias("link")).agg(F.min("b").alias("role"))
    members = staged(members, "crowds")
    sizes = members.groupBy(F.col("key").alias("of")).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = members.join(sizes, F.col("key") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("link"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(spelt, "link").select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "role", "line")

    def compare(rows: pa.Table) -> pa.Table:
        found = near_in_bucket(rows.column("key")[0].as_py(), rows.column("line").to_pylist(), rows.column("role").to_numpy(), rows.column("block").to_numpy(),
                               rows.column("i")[0].as_py(), rows.column("j")[0].as_py(), threshold)
        return pa.table([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary")


def near_in_bucket(key: int, strings: list[str], role: np.ndarray, block: np.ndarray, one: int, two: int, threshold: int) -> list[list[bytes]]:
    """Digests of the near pairs, one line of block ``one`` and one of block ``two``, that no smaller key has."""
    letters = Letters(strings)
    sketch = sketches(letters, np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")).astype(np.int16)
    # Index keys below this one: of two lines that share one, the bucket of that key takes care.
    row, keys, _ = meetings(letters, threshold, probes=False)
    below = np.flatnonzero(keys.view(np.int64) < key)
    held = np.full((len(strings), threshold + 1), -1, np.int64)
    order = below[np.argsort(row[below], kind="stable")]
    per = np.bincount(row[order], minlength=len(strings))
    held[row[order], np.arange(len(order)) - np.repeat(np.cumsum(per) - per, per)] = np.unique(keys[order], return_inverse=True)[1]
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    found: list[list[bytes]] = []
    for at in np.array_split(left, max(1, len(left) // 64)):
        edits = allowed(np.minimum(letters.lengths[at, None], letters.lengths[None, right]), threshold)
        near = ((role[at, None] + role[None, right]) < 2) & (np.abs(letters.lengths[at, None] - letters.lengths[None, right]) <= edits)
        if one == two:
            near &= at[:, None] < right[None, :]
        i, j = np.nonzero(near)
        few = edits[i, j]
        i, j = at[i], right[j]
        free = np.ones(len(i), bool)
        for x in range(threshold + 1):
            for y in range(threshold + 1):
                free &= (held[i, x] < 0) | (held[i, x] != held[j, y])
        i, j, few = i[free], j[free], few[free]
        free = may_be_near(sketch[i], sketch[j], few)
        i, j, few = i[free], j[free], few[free]
        found += verified([strings[k] for k in i.tolist()], [strings[k] for k in j.tolist()], few)
    return found


def verified(left: list[str], right: list[str], edits: np.ndarray) -> list[list[bytes]]:
    """Digests, the smaller first, of those different pairs that are within the edits allowed to each."""
    found = []
    for few in np.unique(edits).tolist():
        here = [i for i in np.flatnonzero(edits == few).tolist() if left[i] != right[i]]
        near = within([left[i] for i in here], [right[i] for i in here], few)
        found += [sorted((digest(left[i].encode()), digest(right[i].encode()))) for i, ok in zip(here, near.tolist(), strict=True) if ok]
    return found


def agreeing(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many code points from p[i] and from q[j] on are equal, at most so many: all pairs a block at a time, blocks growing."""
    got = np.zeros(len(i), np.int64)
    live, width = np.flatnonzero(most > 0), 16
    while len(live):
        width = max(16, min(width, (1 << 18) // len(live)))
        span = np.arange(width)
        left = most[live] - got[live]
        same = p.take((i[live] + got[live])[:, None] + span, mode="clip") == q.take((j[live] + got[live])[:, None] + span, mode="clip")
        same &= span < left[:, None]
        run = np.where(same.all(1), width, same.argmin(1))
        got[live] += run
        live, width = live[(run == width) & (left > width)], width * 4
    return got


def within(left: list[str], right: list[str], threshold: int) -> np.ndarray:
    """Whether each pair is within ``threshold`` edits: the furthest places that so many edits reach, all pairs at a time.

    Entry d of ``reach`` is the place in the left string furthest along diagonal d - threshold - 1, where the place in the
    right one is that much more.
    """
    result = np.zeros(len(left), bool)
    a, b = Letters(left), Letters(right)
    p = np.frombuffer("".join(left).encode("utf-32-le", "surrogatepass"), "<u4")
    q = np.frombuffer("".join(right).encode("utf-32-le", "surrogatepass"), "<u4")
    live = np.flatnonzero(np.abs(a.lengths - b.lengths) <= threshold)
    nowhere = -1 << 40
    reach = np.full((2 * threshold + 3, len(live)), nowhere)
    for edits in range(threshold + 1):
        new = np.full_like(reach, nowhere)
        long_a, long_b = a.lengths[live], b.lengths[live]
        for diagonal in range(-edits, edits + 1):
            d = diagonal + threshold + 1
            # Another letter, one dropped, one put in; at the ends of the strings there is nothing further.
            at = np.maximum(np.maximum(reach[d], reach[d + 1]) + 1, reach[d - 1]) if edits else np.zeros(len(live), np.int64)
            end = np.minimum(long_a, long_b - diagonal)
            at = np.minimum(at, end)
            there = np.flatnonzero(at >= max(0, -diagonal))
            i = at[there]
            new[d, there] = i + agreeing(p, q, a.starts[live[there]] + i, b.starts[live[there]] + i + diagonal, end[there] - i)
        done = new[long_b - long_a + threshold + 1, np.arange(len(live))] == long_a
        result[live[done]] = True
        live, reach = live[~done], new[:, ~done]
    return result


def linked(pairs: DataFrame, spelt: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Those of the pairs that are within the edits they are allowed, by the lines' digests, the smaller first."""
    left = spelt.select(F.col("link").alias("a"), F.col("line").alias("line_a"))
    right = spelt.select(F.col("link").alias("b"), F.col("line").alias("line_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in chunked(batches, "line_a", CHUNK):
            one, two = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shorter = np.minimum(*(np.fromiter(map(len, x), np.int64, len(x)) for x in (one, two)))
            found = verified(one, two, allowed(shorter, threshold))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("line_a", "line_b").mapInArrow(compare, "a binary, b binary")


def links(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """Every pair (a, b) of different lines, by their digests, within the edits they are allowed, once."""
    if threshold < 1:
        return docs.sparkSession.createDataFrame([], "a binary, b binary")
    met = bucketed(docs, text, threshold, crowd)
    spelt = spelt_lines(docs, met, text)
    near = linked(met.where("key IS NULL").select("a", "b"), spelt, threshold).unionByName(crowded_links(met, spelt, threshold))
    found = staged(near.distinct(), "line-links")
    for done in (met, spelt):
        removed(done)
    return found


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, link, n_words) of every line; empty lines have a null link."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, "text"):
            found = [lines(x) for x in raw]
            counts = np.array([len(x) for x in found])
            flat = [x for one in found for x in one]
            number = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(raw)), counts))), pa.array(number),
                 pa.array([digest(x) if x else None for x in flat], pa.binary()), pa.array([len(x.split()) for x in flat], pa.int64())],
                names=["doc_id", "line_no", "link", "n_words"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(split, f"doc_id {kind}, line_no long, link binary, n_words long")


def classed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Every line with its class (the class's first line: least doc_id, then line number), the class's number of
    lines, and the line's number of links to different lines."""
    found = links(docs, text, threshold)
    nodes = components(found)
    ends = found.select(F.col("a").alias("end")).unionByName(found.select(F.col("b").alias("end")))
    degrees = ends.groupBy("end").agg(F.count("*").alias("n_links"))
    known = nodes.join(degrees, F.col("node") == F.col("end")).select("node", "root", "n_links")
    rows = line_rows(docs, doc_id, text)
    rooted = rows.join(known, rows["link"] == known["node"], "left").select(
        "doc_id", "line_no", "link", "n_words", F.coalesce("root", "link").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rooted = staged(rooted, "line-rows")
    first = rooted.where("root IS NOT NULL").groupBy(F.col("root").alias("of")).agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("class_lines"))
    both = rooted.join(first, rooted["root"] == first["of"], "left")
    return both.select("doc_id", "line_no", "n_words", "root", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"),
                       F.coalesce("class_lines", F.lit(0)).alias("class_lines"), "n_links")
