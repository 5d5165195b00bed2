"""Token counts, packing, toxicity and sharding on odd inputs and against the libraries or brute force."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from larder.llm import packing, sharding, token_counts, toxicity

CHARS = "ab Z'st\n\t 12²½é̀ñß中\x1c\x85 !?<|>😀 　ΣİÉ\x00r _l"


def strange(n: int) -> list[str]:
    draw = random.Random(1)
    return ["".join(draw.choice(CHARS) for _ in range(draw.randint(0, 60))) for _ in range(n)] + [
        "x<|endoftext|>y <|endoftext|>", "<|startoftext|>", "a" * 3000, "  " * 500 + "x", "'S'LL'll've", ""]


class TestTokens:
    def test_like_the_library(self):
        path = token_counts.default_vocabulary()
        ours, theirs = token_counts.Counter(path, 50), Tokenizer.from_file(path)
        texts = strange(3000)
        assert [ours.count(x) for x in texts] == [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]

    def test_odd(self, rows):
        docs = rows("doc_id long, text string, n_tokens string", (1, None, "x"), (2, "", "x"), (3, "word " * 30_000, "x"), (3, "é", "x"), (None, "a b", "x"))
        got = sorted((r.doc_id or 0, r.n_bytes, r.over_limit) for r in token_counts.with_limit(token_counts.token_counts(docs)).collect())
        assert got == [(0, 3, False), (1, 0, False), (2, 0, False), (3, 2, False), (3, 150_000, True)]
        assert token_counts.token_counts(docs.limit(0)).count() == 0


class TestPacking:
    def test_ids_like_the_library(self):
        path = packing.default_vocabulary()
        ours, theirs = packing.WordIds(path, 50), Tokenizer.from_file(path)
        texts = strange(3000)
        found = [x for at in range(0, len(texts), 100) for x in ours.ids(texts[at:at + 100])]
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]

    def test_first_fit_decreasing(self):
        lengths = np.random.default_rng(0).integers(1, 101, 500)
        number, offset = packing.first_fit_decreasing(lengths, 100)
        bins: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            at = next((k for k, used in enumerate(bins) if used + lengths[i] <= 100), len(bins))
            if at == len(bins):
                bins.append(0)
            assert (number[i], offset[i]) == (at, bins[at])
            bins[at] += lengths[i]

    def test_whole(self, rows):
        docs = rows("doc_id long, text string, start string", (1, None, "x"), (2, "", "x"), (3, "word " * 9000, "x"), (4, "a", "x"), (4, "a", "x"), (None, "b c", "x"))
        got = packing.packed(docs, group_pieces=3).collect()
        assert sum(r.length for r in got if r.doc_id == 3) == 9001 == max(r.doc_tokens for r in got)
        assert sorted((r.doc_id or 0, r.start) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 4096), (3, 8192), (4, 0), (4, 0)]
        by: dict[int, list] = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        assert packing.packed(docs.limit(0)).count() == 0


def _sample(docs, labels, n):
    found = toxicity.training_rows(docs, labels, rows=n)
    return [x.encode() for x in found.column("text").to_pylist()], np.array(found.column("toxic").to_pylist())


class TestToxicity:
    def test_held_out(self, spark):
        docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
        scored = toxicity.scored(docs, toxicity.fitted(docs, labels))
        rows = scored.where("held_out").drop("toxic").join(labels, "doc_id").select("predicted", "toxic").collect()
        assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93

    def test_odd(self, rows):
        docs = rows("doc_id long, text string, lang string, toxic string", (1, None, None, "x"), (2, "", "en", "x"), (2, "", "en", "x"),
                    (None, "fine " * 30_000, "en", "x"), (4, "bad thing", "en", "x"))
        labels = rows("doc_id long, toxic int", (1, 0), (2, 1), (4, 1), (None, 1), (9, None), (77, 1))
        net = toxicity.fitted(docs, labels)
        got = toxicity.scored(docs, net).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert toxicity.without_toxic(docs, net).columns == docs.columns
        empty = toxicity.fitted(docs, labels.limit(0))
        assert {r.score for r in toxicity.scored(docs, empty).collect()} == {0.0}
        assert toxicity.scored(docs.limit(0), net).count() == 0

    def test_whole_labels_decide(self, rows):
        """The bound on training rows changes neither the odds of the classes nor what thresholds are set from."""
        docs = [(i, f"vile rotten thing {i}" if i % 10 == 0 else f"nice calm day {i}", "fr" if i % 4 == 0 else "en") for i in range(800)]
        table = rows("doc_id long, text string, lang string", *docs)
        labels = rows("doc_id long, toxic int", *[(i, int(i % 10 == 0)) for i in range(800)])
        net = toxicity.fitted(table, labels, rows=30)
        assert set(net.thresholds) == {"fr", "en"}  # of either, 20 or more rows of each class only among all labels
        even = toxicity.trained(*_sample(table, labels, 30))
        share = np.mean([i % 10 == 0 for i in range(800) if zlib.crc32(str(i).encode()) % 5])
        assert abs(net.bias - even.bias - np.log(share / (1 - share))) < 1e-6

    def test_threshold_of_counts(self):
        bins, toxic, n = np.array([0, 300, 700, 900]), np.array([0, 2, 30, 30]), np.array([500, 90, 31, 30])
        assert toxicity.threshold(bins, toxic, n) == (700 + 301) / 2 / toxicity.BINS
        assert toxicity.threshold(bins, toxic // 4, n) == 0.5

    def test_gradient_free_of_neighbours(self):
        """A text's score does not depend on the texts around it."""
        net = toxicity.trained([b"good day", b"vile words", b"nice words", b"vile thing"] * 10, np.array([0, 1, 0, 1] * 10))
        alone = [net.scores([x])[0] for x in (b"vile", b"", b"good vile day")]
        assert np.allclose(net.scores([b"vile", b"", b"good vile day"]), alone)
        assert alone[0] > 0.5 > alone[1]


class TestSharding:
    def check(self, got, n):
        shards: dict[int, list[int]] = {}
        for r in got:
            shards.setdefault(r.shard, []).append(r.slot)
        sizes = [len(shards.get(s, [])) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
        assert all(sorted(x) == list(range(len(x))) for x in shards.values())

    def test_groups_stay_together(self, rows):
        docs = [(i, f"text {i}") for i in range(400)] + [(1000 + i, f"twin {i // 3}") for i in range(120)] + [(2000 + i, "hot") for i in range(250)]
        got = sharding.sharded(rows("doc_id long, text string", *docs)).collect()
        self.check(got, 770)
        where: dict[int, set] = {}
        for r in got:
            where.setdefault(r.text_crc32, set()).add(r.shard)
        assert sum(len(s) > 1 for s in where.values()) <= 6
        assert len(max(where.values(), key=len)) <= 5  # a third of the rows needs three shards

    def test_all_linked(self, rows):
        got = sharding.sharded(rows("doc_id long, text string", *[(i, f"twin {i // 2}") for i in range(400)])).collect()
        self.check(got, 400)
        where: dict[int, set] = {}
        for r in got:
            where.setdefault(r.text_crc32, set()).add(r.shard)
        assert sum(len(s) > 1 for s in where.values()) < 40

    def test_odd(self, rows):
        docs = rows("doc_id long, text string, shard string", (1, None, "x"), (1, "", "x"), (None, "é" * 5, "x"), (2, "a" * 100_000, "x"), (2, "a" * 100_000, "x"))
        got = sharding.sharded(docs).collect()
        self.check(got, 5)
        assert sorted(r["size"] for r in got) == [1, 1, 11, 100_001, 100_001]
        assert sharding.sharded(docs.limit(0)).count() == 0
