"""Filter audit and hard negatives on odd inputs and against brute force."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import filter_audit, hard_negatives


def failing(text: str) -> set[str]:
    words = text.encode().split()
    fails = {"A"} if len(words) < 100 else set()
    fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
    return fails | ({"D"} if set(text) & set("#$%&*|") else set())


def brute_audit(docs, labels):
    """Filter after filter over the rows themselves."""
    least: dict = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text = text or ""
        fails = failing(text) | ({"E"} if i is not None and i > least[text] else set())
        mine = [(q, t) for d, q, t in labels if d is not None and d == i]
        rows.append((part or "", fails, any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                earlier = [r for r in here if letter in r[1] and any(x in r[1] for x in order[:step - 1])]
                left = [r for r in left if letter not in r[1]]
                shapley[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(earlier), sum(r[1] == {letter} for r in here),
                                          sum(r[2] for r in gone), sum(r[3] for r in gone), letter]
        for key, values in out.items():
            if key[0] == part:
                values[6] = shapley[values[6]]
    return {k: tuple(v) for k, v in out.items()}


class TestFilterAudit:
    def audit(self, spark, docs, labels):
        d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("good", F.lit("x")).withColumn("mask", F.lit("x"))
        found = filter_audit.audit(filter_audit.masks(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
        return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
                for r in found.collect()}

    def test_against_brute_force(self, spark):
        draw = random.Random(2)
        texts = [" ".join(draw.choice(["a", "Bee", "CCC", "d#", "e\x0bf", f"w{draw.randrange(500)}"][:draw.randint(1, 6)]) for _ in range(draw.choice([5, 99, 100, 130]))) for _ in range(40)]
        texts += [" ".join(f"w{i}" for i in range(n)) for n in (99, 100, 101)] + ["", "\u00a0 x", "é" * 50, "word " * 40_000]
        docs = [(draw.randrange(90), draw.choice(texts), draw.choice(["en", "fr", None, ""])) for _ in range(150)]
        docs += [(None, texts[0], "en"), (None, texts[0], "en"), (200, None, "de"), (201, None, "de"), (201, None, "de"), *docs[:3]]
        labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
        assert self.audit(spark, docs, labels) == brute_audit(docs, labels)

    def test_one_common_text(self, spark):
        """A text that a third of all rows share is one row per task before it moves; only its least id passes E."""
        docs = [(i, "same text" if i % 3 == 0 else f"text {i}", "en") for i in range(3000)]
        found = self.audit(spark, docs, [])
        assert found["en", "EABCD", 1] == (2001, 999, 0, 0, 0, 0, found["en", "EABCD", 1][-1])
        assert found["en", "AEBCD", 2][:3] == (0, 0, 999)

    def test_empty(self, spark):
        assert self.audit(spark, [], []) == {}

    def test_fields_do_not_overflow(self):
        n = (1 << 63) - 1
        found = filter_audit.audit_of([0, 31], [True, False], [False, True], [n - 5, 5])
        assert (found["kept"] == n - 5).all() and found["removed"].reshape(120, 5)[:, 0].tolist() == [5] * 120
        assert found["redundant"].reshape(120, 5)[:, 1:].min() == 5


def brute_negatives(rows, anchors):
    """rows: (id, label, ints); all scores of every anchor."""
    out = []
    for a, label, x in rows:
        if not anchors(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), b, m) for b, m, y in rows if b != a)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            far = [(t, b) for t, b, m in scored if m != label and -30 * s <= -100 * t <= -90 * s][:10]
            out += [(a, p, k, b, -s, -t) for k, (t, b) in enumerate(far, 1)]
    return sorted(out)


def mined(spark, data, anchors=lambda i: i % 10 == 0, block=50):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("ints", F.lit("x")).withColumn("block", F.lit("x"))
    rows = hard_negatives.vectors(df, F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mined(rows, F.col("id") % 10 == 0, block=block).collect())


class TestHardNegatives:
    @pytest.mark.parametrize("seed", range(3))
    def test_against_brute_force(self, spark, seed):
        draw = np.random.default_rng(seed)
        centres = draw.normal(size=(6, 12))
        data = []
        for i in range(400):
            label = int(draw.integers(0, 4))
            x = centres[label] + draw.normal(size=12) * [0.3, 1, 3][seed]
            x[draw.random(12) < 0.2] = 0
            data.append((i, x.tolist() if i % 41 else [0.0] * 12, label))
        want = brute_negatives([(i, m, [math.floor(256 * v) for v in x]) for i, x, m in data], lambda i: i % 10 == 0)
        assert len(want) > 50 and mined(spark, data) == want

    def test_ties(self, spark):
        """Few different vectors: most scores are equal, and ids decide, across blocks too."""
        draw = random.Random(5)
        data = [(i, [draw.choice([0.5, 1.0]), draw.choice([-0.5, 1.0])], i % 3) for i in range(300)]
        want = brute_negatives([(i, m, [math.floor(256 * v) for v in x]) for i, x, m in data], lambda i: i % 10 == 0)
        assert mined(spark, data) == want

    def test_stops_before_the_end(self):
        """Where one dimension tells the rows apart, the lists are left early."""
        draw = np.random.default_rng(1)
        ints = draw.integers(-5, 5, (8192, 8))
        ints[:, 0] = draw.permutation(8192)
        lists = hard_negatives.SortedLists(np.arange(8192), ints)
        anchor = np.array([50, 1, -1, 0, 0, 0, 0, 0])
        best, seen = lists.search(anchor, np.ones(8192, bool), [(-(1 << 62), 1 << 62)], 10)
        score = ints @ anchor
        want = sorted(zip((-score).tolist(), range(8192), strict=True))[:10]
        assert [(-s, b) for s, b in best[0].tolist()] == want and seen < 2000

    def test_large_components(self):
        """Beyond what floating point holds exactly scores are integer sums, and past 64 bits an error."""
        lists = hard_negatives.SortedLists(np.arange(3), np.array([[1 << 30, 1], [1 << 30, 2], [1 << 30, 0]]))
        best, _ = lists.search(np.array([1 << 30, 1]), np.ones(3, bool), [(0, 1 << 62)], 3)
        assert best[0].tolist() == [[(1 << 60) + 2, 1], [(1 << 60) + 1, 0], [1 << 60, 2]]
        with pytest.raises(ValueError, match="64 bits"):
            lists.search(np.array([1 << 40, 1]), np.ones(3, bool), [(0, 1 << 62)], 3)

    def test_odd(self, spark):
        nan, inf = float("nan"), float("inf")
        data = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.5, 0.5], 2), (3, [0.5], 2), (4, None, 2), (5, [0.5, None], 2),
                (6, [0.5, nan], 2), (7, [inf, 0.5], 2), (8, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (9, [], 2), (10, [], 1)]
        rows = [(0, 1, [256, 256]), (1, 1, [256, 230]), (2, 2, [128, 128]), (3, 2, [128, 0]), (9, 2, [0, 0]), (10, 1, [0, 0])]
        assert mined(spark, data) == brute_negatives(rows, lambda i: i % 10 == 0)
        assert mined(spark, []) == [] and mined(spark, [(3, [1.0], 1)]) == []
