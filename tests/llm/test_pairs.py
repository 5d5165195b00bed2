"""Near duplicates, the edit join, line dedup and the pipeline on odd inputs and against brute force."""

import random

import numpy as np
import pytest

from larder.llm import components, line_dedup, line_join, near_duplicates


def prose(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))


def edited(draw: random.Random, text: str, n: int) -> str:
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = prose(draw, 1) + "zz"
    return " ".join(words)


def classes(pairs, nodes):
    parent = {x: x for x in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[top(a)] = top(b)
    out: dict = {}
    for x in nodes:
        out.setdefault(top(x), set()).add(x)
    return {frozenset(x) for x in out.values()}


class TestComponents:
    def test_random(self, spark):
        draw = random.Random(4)
        edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)]
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
        by: dict = {}
        for r in got:
            by.setdefault(r.root, set()).add(r.node)
        nodes = {x for a, b in edges if a != b for x in (a, b)}
        assert {frozenset(x) for x in by.values()} == classes([e for e in edges if e[0] != e[1]], nodes)
        assert all(root == min(held) for root, held in by.items())

    def test_empty(self, spark):
        assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0

    @pytest.mark.parametrize(("edges", "most"), [([(1, 5), (6, 1), (2, 9), (9, 2), (3, 3)], 1), ([(k, k + 1) for k in range(30)], 6)])
    def test_ends_without_a_round_that_changes_nothing(self, spark, monkeypatch, edges, most):
        written = []
        staged = components.staged
        monkeypatch.setattr(components, "staged", lambda df, name: written.append(name) or staged(df, name))
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(written) <= most
        nodes = {x for a, b in edges for x in (a, b) if a != b}
        want = {x: min(one) for one in classes([(a, b) for a, b in edges if a != b], nodes) for x in one}
        assert sorted((r.node, r.root) for r in got) == sorted(want.items())

    def test_shuffles_of_a_round(self, spark):
        round_ = components._small_star(components._large_star(spark.createDataFrame([(2, 1)], "a long, b long")))
        assert round_._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 7


class TestNearDuplicates:
    def test_signature_is_unbiased(self):
        draw = np.random.default_rng(0)
        n, places = 300, 4096
        shingle = np.sort(draw.integers(0, 2 ** 63, n).astype(np.uint64))
        a = draw.integers(1, 40, n)
        b = np.where(draw.random(n) < 0.5, a, draw.integers(1, 40, n))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        one, two = (near_duplicates.signatures(np.zeros(n, np.int64), shingle, w, 1, places) for w in (a, b))
        assert abs((one == two).mean() - true) < 0.03

    def test_against_brute_force(self, spark):
        draw = random.Random(6)
        base = prose(draw, 150)
        texts = [edited(draw, base, draw.randint(1, 7)) for _ in range(150)]
        for _ in range(40):
            one = prose(draw, draw.choice([1, 3, 5, 40, 120]))
            texts += [one, one, edited(draw, one, 1), one + " " + one]
        got = near_duplicates.classed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        bags = near_duplicates.occurrences([t.encode() for t in texts])
        pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near_duplicates.overlap(bags[i], bags[j]) >= 0.8]
        by: dict = {}
        for r in got:
            by.setdefault(r.class_id, set()).add(r.doc_id)
        assert {frozenset(x) for x in by.values()} == classes(pairs, range(len(texts)))
        assert sum(r.stays for r in got) == len(by) and all(r.class_id == min(by[r.class_id]) for r in got)

    def test_blocks_connect_what_pairs_connect(self):
        draw = random.Random(8)
        base = prose(draw, 100)
        texts = [edited(draw, base, 3) for _ in range(60)]
        links = [str(i).encode() for i in range(60)]
        found = near_duplicates.block_links(links, links, [t.encode() for t in texts], 0.8)
        bags = near_duplicates.occurrences([t.encode() for t in texts])
        pairs = [(i, j) for i in range(60) for j in range(i) if near_duplicates.overlap(bags[i], bags[j]) >= 0.8]
        assert classes([(int(a), int(b)) for a, b in found], range(60)) == classes(pairs, range(60)) and len(found) < 60

    def test_odd(self, rows):
        docs = rows("doc_id long, text string, link string, class_id string", (1, None, "x", "y"), (2, "", "x", "y"), (3, "...", "x", "y"),
                    (4, "a b", "x", "y"), (4, "a b", "x", "y"), (None, "A b!", "x", "y"), (7, "w " * 30_000, "x", "y"))
        kept = near_duplicates.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "7", "None"]
        assert near_duplicates.classed(docs).count() == 7
        assert near_duplicates.one_of_each(docs.limit(0)).count() == 0


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def typos(draw: random.Random, text: str, n: int) -> str:
    letters = list(text)
    for _ in range(n):
        if not letters:
            break
        at, kind = draw.randrange(len(letters)), draw.randrange(3)
        letters[at:at + (kind > 0)] = draw.choice("xyé") if kind < 2 else ""
    return "".join(letters).strip()


def few(a: str, b: str, threshold: int) -> int:
    return min(threshold, min(len(a), len(b)) // 10)


class TestLineJoin:
    def test_distance(self):
        draw = random.Random(3)
        left = ["".join(draw.choice("abé") for _ in range(draw.randint(0, 12))) for _ in range(600)]
        right = [typos(draw, x, draw.randint(0, 4)) if x else "a" for x in left]
        for threshold in (1, 2, 3):
            want = [distance(x, y) <= threshold for x, y in zip(left, right, strict=True)]
            assert line_join.within(left, right, threshold).tolist() == want

    def test_segments_meet(self):
        """Every pair within the edits it is allowed shares a key, one side indexed."""
        draw = random.Random(9)
        for threshold in (1, 2, 3):
            strings = []
            for _ in range(400):
                one = "".join(draw.choice("abc") for _ in range(draw.randint(5, 45)))
                strings += [one, typos(draw, one, draw.randint(1, threshold))]
            row, key, role = line_join.meetings(line_join.Letters(strings), threshold)
            index, every = {}, {}
            for r, k, p in zip(row.tolist(), key.tolist(), role.tolist(), strict=True):
                every.setdefault(r, set()).add(k)
                if not p:
                    index.setdefault(r, set()).add(k)
            for a in range(0, len(strings), 2):
                b = a + 1
                if 0 < distance(strings[a], strings[b]) <= few(strings[a], strings[b], threshold):
                    assert index[a] & every[b] or index[b] & every[a]

    def test_length_classes_meet(self):
        """Pairs on both sides of the bounds between classes of lengths share a key, one side indexed, and pass by their numbers."""
        draw = random.Random(31)
        for threshold in (1, 2, 3):
            strings = []
            for n in [*range(10, 36), *range(60, 84), *range(125, 147)] * 8:
                one = "".join(draw.choice("abcdefgh") for _ in range(n))
                strings += [one, typos(draw, one, draw.randint(1, threshold))]
            letters = line_join.Letters(strings)
            numbers = line_join.number([line_join.digest(x.encode()) for x in strings], letters.lengths).tolist()
            row, key, role = line_join.meetings(letters, threshold)
            held = {*zip(row.tolist(), key.tolist(), strict=True)}
            index = {*zip(row[role == 0].tolist(), key[role == 0].tolist(), strict=True)}
            only, same, _ = line_join.meetings(letters, threshold, probes=False)
            assert index == {*zip(only.tolist(), same.tolist(), strict=True)}
            keys: dict = {}
            for r, k in held:
                keys.setdefault(r, set()).add(k)
            for a in range(0, len(strings), 2):
                b = a + 1
                if 0 < distance(strings[a], strings[b]) <= few(strings[a], strings[b], threshold):
                    assert any((a, k) in index or (b, k) in index for k in keys[a] & keys[b])
                    assert line_join.as_long(numbers[a], numbers[b], threshold)

    def test_few_rows_a_line(self):
        """One substring serves for all lengths of a class: at three edits 8 rows, a second class's where lengths border on it."""
        draw = random.Random(32)
        strings = ["".join(draw.choice("abcdefgh") for _ in range(n)) for n in range(100, 420)]
        row, _, _ = line_join.meetings(line_join.Letters(strings), 3)
        assert len(row) <= 10 * len(strings) and np.bincount(row).max() <= 16

    def test_lines_of_other_lengths_make_no_pairs(self, spark):
        """Lines of one start whose lengths differ by more than the edits meet by a key, but are no candidates."""
        start = prose(random.Random(33), 40)[:144]
        docs = spark.createDataFrame([(i, start + "xyzuv"[i] * (5 * i)) for i in range(4)], "doc_id long, text string")
        assert line_join.bucketed(docs).count() == 0

    def test_long_runs_of_equal_letters(self):
        """Edits far apart in long strings, and none: the runs between them end where they should."""
        draw = random.Random(34)
        base = prose(draw, 2000)
        one = "é" + base[1:4000] + base[4001:-1]
        left, right = [base, base, "", base, "a" * 5000], [base, one, "", base[4:], "a" * 4997]
        assert [line_join.within(left, right, t).tolist() for t in (2, 3)] == [[True, False, True, False, False], [True, True, True, False, True]]

    def test_letter_counts_bound_edits(self):
        draw = random.Random(10)
        strings = ["".join(draw.choice("abcdé") for _ in range(draw.randint(0, 300))) for _ in range(200)]
        strings += [typos(draw, x, 3) for x in strings]
        letters = line_join.Letters(strings)
        found = line_join.sketches(letters, np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")).astype(int)
        assert line_join.may_be_near(found[:200], found[200:], np.full(200, 3)).all()
        assert not line_join.may_be_near(found[:100], found[100:200], np.full(100, 3)).any()

    @staticmethod
    def found(spark, lines, threshold, **options):
        docs = spark.createDataFrame([(i, "\n".join(lines[i * 10:i * 10 + 10])) for i in range(-(-len(lines) // 10))], "doc_id long, text string")
        return {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in line_join.links(docs, threshold=threshold, **options).collect()}

    @staticmethod
    def wanted(lines, threshold):
        each = sorted(set(lines))
        return {tuple(sorted((line_join.digest(x.encode()), line_join.digest(y.encode())))) for i, x in enumerate(each) for y in each[:i]
                if abs(len(x) - len(y)) <= threshold and distance(x, y) <= few(x, y, threshold)}

    @pytest.mark.parametrize("threshold", [1, 2, 3])
    def test_crowded_against_brute_force(self, spark, threshold):
        draw = random.Random(3)
        base = prose(draw, 12)
        lines = [typos(draw, base, draw.choice([0, 1, 2, 5])) for _ in range(120)] + [f"line number {draw.randrange(300)} of the same kind" for _ in range(100)]
        lines += ["".join(draw.choice("ab") for _ in range(draw.randint(8, 14))) for _ in range(150)]
        lines = [x for x in lines if x]
        assert self.found(spark, lines, threshold) == self.wanted(lines, threshold)
        assert self.found(spark, lines, threshold, crowd=4) == self.wanted(lines, threshold)

    def test_near_equal_lines_stay_few_rows(self, spark):
        """400 lines of 200 characters, two edits from one base, at three edits: all links, and no more rows than keys."""
        draw = random.Random(14)
        base = prose(draw, 60)[:200]
        lines = sorted({typos(draw, base, 2) for _ in range(400)})
        docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
        met = line_join.bucketed(docs)
        assert met.count() < 100 * len(lines) and met.where("key IS NULL").count() < 40 * len(lines)
        got = {(bytes(r.a), bytes(r.b)) for r in line_join.links(docs).collect()}
        x, y = np.triu_indices(len(lines), 1)
        near = line_join.within([lines[i] for i in x], [lines[i] for i in y], 3)
        want = {tuple(sorted((line_join.digest(lines[i].encode()), line_join.digest(lines[j].encode())))) for i, j in zip(x[near], y[near], strict=True)}
        assert len(want) > 1500 and got == want
        for i, j in list(zip(x, y, strict=True))[::997]:
            assert (tuple(sorted((line_join.digest(lines[i].encode()), line_join.digest(lines[j].encode())))) in want) == (distance(lines[i], lines[j]) <= 3)

    def test_common_keys_are_spread(self):
        """Rows of a key that is common in a task don't go by that key; one mark does."""
        key = np.array([7] * 50 + [8] * 3, np.uint64)
        route, link, kept = line_join.routed(key, np.arange(53) * 2, 32)
        assert len(set(route[:50].tolist())) == 50 and route[50:].tolist() == [8, 8, 8, 7] and (kept[:50] == 7).all()
        assert link.tolist() == [*range(0, 106, 2), line_join.MARK] and kept[50:].tolist() == [0, 0, 0, 7]

    def test_odd(self, rows):
        docs = rows("doc_id long, text string, n_links string", (1, None, "x"), (2, "", "x"), (3, "short\n\nshort", "x"), (3, "short", "x"),
                    (None, "this is a line of words\n" + "v" * 200_000, "x"), (5, " this is a line of wordz ", "x"))
        got = sorted((str(r.doc_id), r.line_no, r.class_lines, r.n_links) for r in line_join.classed(docs).collect())
        assert got == [("3", 0, 3, 0), ("3", 0, 3, 0), ("3", 1, 0, 0), ("3", 2, 3, 0), ("5", 0, 2, 1), ("None", 0, 2, 1), ("None", 1, 1, 0)]
        assert line_join.classed(docs.limit(0)).count() == 0


class TestLineDedup:
    def test_boilerplate_goes_and_copies_stay(self, rows):
        draw = random.Random(12)
        passage, twin = prose(draw, 55), prose(draw, 120)
        docs = [(i, prose(draw, 80) + "\n" + typos(draw, passage, i % 2), "en", 0) for i in range(6)]
        docs += [(10, twin + "\n" + prose(draw, 90), "en", 0)]
        docs += [(11, docs[6][1] + " end", "en", 0), (12, "only one line of words here\nonly one line of words here", "en", 0), (13, None, "en", 0), (14, passage, "en", 0)]
        got = {r.doc_id: r for r in line_dedup.deduplicated(rows("doc_id long, text string, lang string, n_chars long", *docs)).collect()}
        assert got[0].text == docs[0][1] and all("\n" not in got[i].text for i in range(1, 6))
        assert got[1].n_chars == len(got[1].text)
        assert (got[10].text, got[11].text) == (docs[6][1], docs[7][1])
        assert got[12].text == "only one line of words here" and got[13].text is None
        assert 14 not in got  # nothing but the passage

    def test_holders_are_judged_one_by_one(self, rows):
        """A passage that three near copies and one other text hold goes from the other text, though most holders are alike."""
        draw = random.Random(21)
        passage, twin, other = prose(draw, 30), prose(draw, 150), prose(draw, 150)
        docs = [(i, f"{twin} {i}\n{passage}") for i in range(3)] + [(9, f"{passage}\n{prose(draw, 90)}")]
        docs += [(20 + i, f"{other} {i}\n{passage}") for i in range(3)]
        got = {r.doc_id: r.text for r in line_dedup.deduplicated(rows("doc_id long, text string", *docs)).collect()}
        assert all(got[i] == docs[i][1] for i in range(3))
        assert passage not in got[9] and not any(passage in got[20 + i] for i in range(3))

    def test_stays_where_near_duplicates_leave_it(self, rows):
        """A copy that is to go anyway doesn't keep the line for the others."""
        draw = random.Random(22)
        passage, twin = prose(draw, 20), prose(draw, 150)
        docs = [(1, twin), (2, f"{twin}\n{passage}"), (3, f"{prose(draw, 90)}\n{passage}")]
        got = {r.doc_id: r.text for r in line_dedup.deduplicated(rows("doc_id long, text string", *docs)).collect()}
        assert passage in got[3] and passage not in got[2]

    def test_three_typos(self, rows):
        draw = random.Random(23)
        passage = prose(draw, 40)
        docs = [(i, prose(draw, 80) + "\n" + typos(draw, passage, i)) for i in range(4)]
        got = {r.doc_id: r.text for r in line_dedup.deduplicated(rows("doc_id long, text string", *docs)).collect()}
        assert got[0] == docs[0][1] and all("\n" not in got[i] for i in (1, 2, 3))

    def test_empty(self, rows):
        assert line_dedup.deduplicated(rows("doc_id long, text string", (1, "a")).limit(0)).count() == 0


class TestPipeline:
    def test_stages_against_brute_force(self, spark):
        import corpus_pipeline
        folder = "/root/testdata/sf0.001"
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, folder)
            assert after.columns == docs.columns
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
            docs = spark.createDataFrame(after.collect(), docs.schema)
        ids = {r.doc_id for r in docs.collect()}
        packed = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in packed} == ids and sum(r.start == 0 for r in packed) == len(ids)
        bags = near_duplicates.occurrences([(r.text or "").encode() for r in docs.collect()])
        assert not any(near_duplicates.overlap(a, b) >= 0.8 for i, a in enumerate(bags) for b in bags[:i])
