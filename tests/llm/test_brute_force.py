"""Stages of the pipeline, the classifier and the sharding against plain versions of themselves."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from larder.llm import near_duplicates, sharding, toxicity

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\r\x0b\x0c"


# --- the classifier ---------------------------------------------------------------

def plain_score(net, text: bytes) -> float:
    """One text, word by word and window by window."""
    feats, counts = toxicity.features([text], len(net.embedding))
    words = [sum(net.embedding[f].astype(float) for f in row) for row in feats]
    nothing = net.embedding[0].astype(float) * feats.shape[1]
    n = max(1, int(counts[0]))
    words += [nothing] * (n + max(toxicity.WIDTHS) - 1 - len(words))
    pooled = []
    for width, filters, offset in zip(toxicity.WIDTHS, net.filters, net.offsets, strict=True):
        for f in range(filters.shape[2]):
            values = [sum(float(words[i + j] @ filters[j, :, f]) for j in range(width)) + float(offset[f]) for i in range(n)]
            pooled.append(max(0.0, max(values)))
    return 1 / (1 + np.exp(-(float(np.dot(pooled, net.weights)) + net.bias)))


TEXTS = [b"good day to you", b"vile rotten words here", b"nice", b"", b"vile thing of a rotten day", b"calm words about a nice thing"] * 6
LABELS = np.array([0, 1, 0, 0, 1, 0] * 6)


def test_forward_pass():
    net = toxicity.trained(TEXTS, LABELS)
    texts = [*TEXTS[:6], b"a", b"one two three four five six seven eight nine ten vile", "é ß ñandú".encode()]
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=1e-5)


class Noted:
    """Keeps the gradient and moves nothing."""

    def step(self, value, gradient):
        self.gradient = gradient
        return value


def test_gradient():
    """Against differences of the loss."""
    net = toxicity.trained(TEXTS, LABELS)
    net.embedding, net.filters, net.offsets = net.embedding.astype(float), [f.astype(float) for f in net.filters], [o.astype(float) for o in net.offsets]
    net.weights, net.bias = net.weights * 0.05, 0.1  # unsure scores, steep loss
    feats, counts = toxicity.features(TEXTS[:6], len(net.embedding))
    toxic = LABELS[:6]

    def loss() -> float:
        score = 1 / (1 + np.exp(-(net.pooled(feats, counts) @ net.weights + net.bias)))
        return float(-np.mean(toxic * np.log(score) + (1 - toxic) * np.log(1 - score)))

    def slope(array: np.ndarray, at: tuple) -> float:
        kept, out = array[at], []
        for d in (1e-5, -1e-5):
            array[at] = kept + d
            out.append(loss())
        array[at] = kept
        return (out[0] - out[1]) / 2e-5

    hands = {key: Noted() for key in ("weights", "bias", *[(k, i) for k in "fo" for i in range(len(net.filters))])}
    weights = net.weights.copy()
    frozen, net.embedding = net.embedding, net.embedding.copy()
    toxicity._step(net, feats, counts, toxic, hands, np.full(len(net.embedding), 1e30))
    net.embedding, net.weights = frozen, weights
    net.filters, net.offsets = [f.astype(float) for f in net.filters], [o.astype(float) for o in net.offsets]
    assert np.allclose(hands["weights"].gradient - 1e-4 * weights, [slope(net.weights, (i,)) for i in range(len(weights))], atol=1e-6)
    draw = random.Random(1)
    for i, filters in enumerate(net.filters):
        for at in draw.sample(list(np.ndindex(filters.shape)), 12):
            assert hands["f", i].gradient[at] == pytest.approx(slope(filters, at), abs=1e-5)
        for f in range(len(net.offsets[i])):
            assert hands["o", i].gradient[f] == pytest.approx(slope(net.offsets[i], (f,)), abs=1e-5)


# --- sharding ---------------------------------------------------------------------

def cut(groups: list[int], side: list[int]) -> int:
    return sum(groups[i] == groups[j] and side[i] != side[j] for i, j in itertools.combinations(range(len(groups)), 2))


@pytest.mark.parametrize("sizes", [[3, 3, 2, 2, 1, 1], [5, 3, 2, 1, 1], [6, 6], [9, 1, 1, 1], [4, 4, 4]])
def test_shards_against_every_assignment(spark, sizes):
    """Two shards of six rows each: the quota holds, and of all 924 assignments few cut less than it does on the whole."""
    groups = [g for g, n in enumerate(sizes) for _ in range(n)]
    docs = spark.createDataFrame([(i, f"group {g}") for i, g in enumerate(groups)], "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.sharded(docs, shards=2).collect()}
    side = [got[i] for i in range(12)]
    assert sorted(Counter(side).values()) == [6, 6]
    every = [cut(groups, [int(i in half) for i in range(12)]) for half in itertools.combinations(range(12), 6)]
    assert min(every) <= cut(groups, side) <= np.mean(every)


# --- the pipeline -----------------------------------------------------------------

def words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def joined(pairs, nodes) -> dict:
    """Each node's class, named by its least member."""
    parent = {x: x for x in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {x: top(x) for x in nodes}


def text_classes(texts) -> dict:
    """Classes of different texts of which some are near duplicates; others have none."""
    each = sorted(set(texts))
    bags = near_duplicates.occurrences([t.encode() for t in each])
    pairs = [(each[i], each[j]) for i in range(len(each)) for j in range(i) if near_duplicates.overlap(bags[i], bags[j]) >= 0.8]
    found = joined(pairs, {x for p in pairs for x in p})
    return found


def plain_line_dedup(docs: list[tuple[int, str]]) -> dict:
    md5 = lambda x: hashlib.md5(x.encode()).digest()
    split = {t: [x.strip(SPACE) for x in t.split("\n")] for _, t in docs}
    each = sorted({x for ls in split.values() for x in ls if x})
    counts = [Counter(x) for x in each]
    pairs = []
    by_length = sorted(range(len(each)), key=lambda i: len(each[i]))
    for at, i in enumerate(by_length):
        few = min(3, len(each[i]) // 10)
        for j in by_length[at + 1:] if few else ():
            if len(each[j]) - len(each[i]) > few:
                break
            if sum((counts[i] - counts[j]).values()) <= few and sum((counts[j] - counts[i]).values()) <= few and distance(each[i], each[j]) <= few:
                pairs.append((each[i], each[j]))
    line_class = joined(pairs, each)
    near = text_classes(split)
    first = {t: min(i for i, x in docs if x == t) for t in split}
    head = {}
    for t, c in near.items():
        head[c] = min(head.get(c, (first[t], md5(t), t)), (first[t], md5(t), t))
    heads = {x[2] for x in head.values()}
    class_of = {t: near.get(t, t) for t in split}
    holders: dict = {}
    for t, ls in split.items():
        for x in ls:
            if len(x.split()) >= 5:
                holders.setdefault(line_class[x], set()).add(t)
    out = {}
    keeper = {c: class_of[min(ts, key=lambda t: (t in near and t not in heads, first[t], md5(t)))] for c, ts in holders.items()}
    for i, t in docs:
        seen, kept = set(), []
        for raw, x in zip(t.split("\n"), split[t], strict=True):
            if len(x.split()) >= 5 and (keeper[line_class[x]] != class_of[t] or x in seen):
                continue
            seen.add(x)
            kept.append(raw)
        text = "\n".join(kept)
        if text == t or text.strip():
            out[i] = text
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of each stage but the last, as (name, before, after)."""
    import corpus_pipeline

    out, docs = [], spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        out.append((name, docs, after))
        docs = after
    return {name: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for name, a, b in out}


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    net = toxicity.fitted(docs, labels)
    import zlib

    score = {i: plain_score(net, (r.text or "").encode()) for i, r in before.items()}
    marked = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in before}
    for lang in {r.lang for r in before.values()}:
        here = [(score[i], t) for i, t in marked.items() if before[i].lang == lang]
        if min(sum(t for _, t in here), sum(1 - t for _, t in here)) < toxicity.LEAST_ROWS:
            assert lang not in net.thresholds
            continue
        f1 = lambda limit, here=here: 2 * sum(t for s, t in here if s >= limit) / (sum(s >= limit for s, _ in here) + sum(t for _, t in here))
        assert f1(net.thresholds[lang]) >= max(f1(k / 1000) for k in range(100, 901)) - 0.02
    limit = {i: net.thresholds.get(r.lang or "", 0.5) for i, r in before.items()}
    sure = {i for i in before if abs(score[i] - limit[i]) > 1e-4}
    assert {i for i in after if i in sure} == {i for i in sure if score[i] < limit[i]} and len(sure) >= len(before) - 1
    assert all(after[i] == before[i] for i in after)


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    want = plain_line_dedup([(i, r.text or "") for i, r in before.items()])
    assert {i: r.text or "" for i, r in after.items()} == want
    assert sum(len(want.get(i, "")) < len(r.text or "") for i, r in before.items()) > 5  # something was there to do


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    near = text_classes({r.text or "" for r in before.values()})
    by: dict = {}
    for i, r in before.items():
        by.setdefault(near.get(r.text or "", r.text or ""), []).append(i)
    assert set(after) == {min(x) for x in by.values()} and all(after[i] == before[i] for i in after)


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text or "")
        n = min(10, len(w))
        windows |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
    lengths = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[i:i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
    assert set(after) == {i for i, r in before.items() if not hit(words(r.text or ""))} and all(after[i] == before[i] for i in after)
