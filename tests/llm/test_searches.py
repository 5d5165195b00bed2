"""Decontamination, secret scan, line frequency and main text on odd inputs and against brute force."""

import random
import re

import pyarrow as pa
import pytest

from larder.llm import decontaminate, line_frequency, main_text, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string"


@pytest.fixture
def odd(rows):
    """Nulls, an empty and a long text, repeated rows, and columns named like results."""
    long = "word " * 20_000 + "one two three four five six seven eight nine ten " + "more " * 5_000
    return rows(DOCS, (1, None, None, None, None, 7, "x"), (2, "", "en", "h", 0, 7, "x"), (3, long, "en", "h", len(long), 7, "x"),
                (4, "A b", "en", "h", 3, 7, "x"), (4, "A b", "en", "h", 3, 7, "x"), (None, "one two", "fr", None, 7, 7, "x"))


class TestDecontamination:
    @pytest.fixture
    def items(self, rows):
        return rows("item_id long, text string, n_hit long", (10, "One two THREE four five six seven eight nine ten", 1), (9, "a B", 1),
                    (11, None, 1), (12, "...", 1), (13, "a b", 1))

    @pytest.mark.parametrize("block_bytes", [1 << 20, 80])
    def test_odd(self, odd, items, block_bytes):
        found = decontaminate.digest(decontaminate.occurrences(odd, items, block_bytes=block_bytes))
        got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect())
        assert got == [(0, 2, 0, 0, False), (1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 25_010, 10, 1, True),
                       (4, 2, 2, 2, True), (4, 2, 2, 2, True)]

    def test_filter_keeps_columns(self, odd, items):
        kept = decontaminate.decontaminated(odd, items)
        assert kept.columns == odd.columns
        assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]

    def test_empty_tables(self, odd, items):
        none = decontaminate.digest(decontaminate.occurrences(odd, items.limit(0)))
        assert none.where("contaminated").count() == 0 and none.count() == 6
        assert decontaminate.occurrences(odd.limit(0), items).count() == 0
        assert decontaminate.decontaminated(odd, items.limit(0)).count() == 6

    def test_random(self):
        draw = random.Random(5)
        word = lambda: draw.choice(["a", "b", "é", "cc"])
        items = [" ".join(word() for _ in range(draw.choice([1, 3, 10, 14]))) for _ in range(30)]
        docs = [", ".join(word() for _ in range(draw.randint(0, 900))).encode() for _ in range(20)]
        words, hit, owners = decontaminate._search([str(i) for i in range(30)], decontaminate.compiled(items), docs)
        flat = [d.decode().split(", ") if d else [] for d in docs]
        for d, text in enumerate(flat):
            marked, own = set(), set()
            for i, item in enumerate(items):
                w = item.split()
                n = min(len(w), 10)
                for s in range(len(w) - n + 1):
                    for p in range(len(text) - n + 1):
                        if text[p:p + n] == w[s:s + n]:
                            marked |= set(range(p, p + n))
                            own.add(str(i))
            assert {h - words.doc_starts[d] for h in hit if words.doc[h] == d} == marked
            assert owners.get(d, set()) == own


class TestSecrets:
    def test_against_regexes(self):
        scanner, draw = secret_scan.Scanner(), random.Random(2)
        assign = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
        parts = [b"token", b"Api_Key", b"secret", b"=", b":", b" ", b'"', b"AKIA", b"ABCDEFGH12345678", b"deadbeef01234567", b"abc",
                 b"9" * 10, b"\n", "é".encode(), b"PASSWORD", b"AK"]
        for _ in range(3000):
            x = b"".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
            want = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 6]
            want += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
            want += [(m.start(), 2, m.end()) for m in re.finditer(rb"[0-9a-f]+", x) if len(m[0]) >= 24]
            assert [s for s in scanner.spans(x) if s[1] < 3] == sorted(want)

    def test_odd(self, odd):
        found = secret_scan.digest(secret_scan.found(odd))
        assert found.count() == 6 and {r.spans for r in found.collect()} == {""}
        assert secret_scan.found(odd.limit(0)).count() == 0

    def test_code_points(self, rows):
        docs = rows("doc_id long, text string", (1, "éé token=abcdef é -----BEGIN RSA PRIVATE KEY-----"))
        assert secret_scan.digest(secret_scan.found(docs)).first().spans == "assign:3:15,pem:18:49"


class TestLineFrequency:
    def test_odd(self, odd):
        got = line_frequency.judged(odd).collect()
        assert len(got) == 6 and not any(r.kept for r in got)
        assert line_frequency.judged(odd.limit(0)).count() == 0

    def test_depleted(self, rows):
        common = "\n".join(" ".join(f"terms{chr(97 + i)}{chr(97 + j)}" for j in range(11)) for i in range(9))
        own = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + j // 8)}{chr(97 + j % 8)}" for j in range(60))
        docs = [(i, f"{common}\nnumber {i}" if i < 8 else own(i), "h") for i in range(16)]
        copies = [(100 + i, own(25), "h") for i in range(30)]  # copies of one text don't make its lines frequent
        table = rows("doc_id long, text string, source string", *docs, *copies)
        assert all(r.removed_words == 0 for r in line_frequency.judged(table).collect())  # 8 texts are not over the limit
        got = {r.doc_id: r for r in line_frequency.judged(table, most=5).collect()}
        assert [got[i].kept for i in range(16)] == [False] * 8 + [True] * 8
        assert not got[0].base_failed and got[0].removed_words >= 99
        assert all(got[100 + i].kept for i in range(30))


    def test_lines_above_an_absolute_limit_go(self, rows):
        """A line in 7 of 100 texts of a host goes, however many texts that host has, but stays in a host with 5 such texts."""
        docs = [(i, f"own {chr(97 + i // 10)}{chr(97 + i % 10)}\n\n Call  US {i}\nend", "h", 9) if i < 7 else (i, f"own {chr(97 + i // 10)}{chr(97 + i % 10)}", "h", 5) for i in range(100)]
        docs += [(200 + i, f"{chr(97 + i)}\ncall us 1", "g", 1) for i in range(5)] + [(300, None, None, None)]
        table = rows("doc_id long, text string, source string, n_chars long", *docs)
        counted = {r.doc_id: r.removed_words for r in line_frequency.judged(table, most=5).collect()}
        assert all(n == (4 if i < 7 else 0) for i, n in counted.items())
        got = {r.doc_id: r for r in line_frequency.without_frequent(table, most=5).collect()}
        assert line_frequency.without_frequent(table.limit(0)).count() == 0
        assert [got[i].text for i in range(7)] == [f"own a{chr(97 + i)}\n" for i in range(7)] and got[0].n_chars == 7
        assert all((got[i].text, got[i].n_chars) == (t, n) for i, t, _, n in docs[7:])


class TestMainText:
    PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
<!-- x --><div class="ad">Buy <b>now</b></div><article><h1>Short &amp; sweet</h1><p><b>One<br>two&nbsp;three<p>four
 five</p><form><input>go</form><aside>side</aside><div class="reader-comments"><p>nice</p></div><p>six</p></article><footer>&copy;</footer>"""

    def test_article(self):
        assert main_text.main_text(self.PAGE) == "Short & sweet\nOne two three\nfour five\nsix"

    def test_without_article(self):
        body = "".join(f"<p>{'long text here ' * 10}{i}</p>" for i in range(5))
        page = f"<body><div id='nav'><a>Home</a></div><p>ad</p><hr><div></div><div></div><div></div>{body}<div></div><div></div><div></div><p>bye</p>"
        assert main_text.main_text(page).count("long text") == 50 and "bye" not in main_text.main_text(page)

    def test_a_container_without_a_surge_gives_nothing(self):
        """Windows choose among a page's articles, and what they choose is whole, also behind an advert."""
        text = "".join(f"<p>{'long text here ' * 9}{i}</p>" for i in range(3))
        page = (f"<body><article><h2>Teaser</h2><p>more</p></article><article><h1>Head</h1><p>By me</p><div></div><div></div>{text}"
                f"<div class='ad'><p>a</p><p>b</p><p>c</p><p>d</p></div><p>The end.</p></article><article>Other teaser</article>")
        got = main_text.main_text(page)
        assert got.startswith("Head\nBy me\nlong") and got.endswith("2\nThe end.") and "easer" not in got

    def test_same_rule_with_and_without_an_article(self):
        """Names only say what lies outside: without them, windows and what completes them find the same lines."""
        text = "".join(f"<p>{'long text here ' * 9}{i}</p>" for i in range(3))
        for name in ("article", "div"):
            page = f"<body><nav><li>a</li><li>b</li><li>c</li></nav><{name}><h1>Head</h1><p>By me</p>{text}<p>end</p></{name}><footer><p>x</p></footer>"
            assert main_text.main_text(page).split("\n")[:2] == ["Head", "By me"] and main_text.main_text(page).endswith("2\nend")

    def test_long_page(self):
        page = "<article>" + "<p>word word</p>" * 120_000 + "</article>"
        assert main_text.main_text(page) == "\n".join(["word word"] * 120_000)

    def test_odd(self, rows):
        pages = rows("page_id long, url string, html string, text string", (1, None, None, "x"), (None, "u", "", "x"), (3, "u", "just words", "x"),
                     (3, "u", "just words", "x"), (4, "u", "<nav>open<article><p>in", "x"))
        got = sorted((r.page_id or 0, r.text, r.n_chars) for r in main_text.extracted(pages).collect())
        assert got == [(0, "", 0), (1, "", 0), (3, "just words", 10), (3, "just words", 10), (4, "in", 2)]
        assert main_text.extracted(pages.limit(0)).count() == 0


def test_null_typed_column():
    from larder.llm.texts import encoded
    assert encoded(pa.nulls(2)) == [b"", b""]
