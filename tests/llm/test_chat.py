"""The template language and chat formatting on odd inputs and against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from larder.llm import chat_format, chat_template
from larder.llm.chat_format import MARKED, Escaper
from larder.llm.chat_template import Const, Print, Template, TemplateError


def rendered(source: str, turns=(), **names) -> str:
    return "".join(x for x, _ in Template(source).render(list(turns), **names))


class TestTemplate:
    @pytest.mark.parametrize(("source", "want"), [
        ("a{# x }} #}b", "ab"),
        ("{{ 1 + 2 - 4 }} {{ 'a' ~ 1 ~ none ~ true }}", "-1 a1true"),
        ("{{ '%}' }}{{ \"it's\\n\" }}", "%}it's\n"),
        ("x  {%- if a == 'q' -%}  y  {%- elif a in ['r', 's'] %}z{% else %}w{% endif %}", "xz"),
        ("{{ 'b' if 1 > 2 else ' c ' | trim | upper }}", "C"),
        ("{% for x in [1, 2, 3] %}{{ loop.index }}{{ ',' if not loop.last }}{% if loop.first %}!{% endif %}{% endfor %}", "1,!2,3"),
        ("{% set n = 'k' %}{{ d[n] }}{{ d.k }}{{ d.absent }}{{ l[-1] }}{{ l[9] }}", "vv8"),
        ("{{ a and 'yes' or 'no' }}{{ 'x' not in 'abc' }}{{ not a }}", "yestruefalse"),
        ("{% for m in messages %}{{ m.text | length }};{% endfor %}{% for m in messages %}{{ m.role }}{% endfor %}", "2;0;ub"),
        ("{{ 2 == true }}{{ 'a' < 'b' }}{{ (1 + 1) <= 2 }}", "falsetruetrue"),
    ])
    def test_renders(self, source, want):
        assert rendered(source, [{"role": "u", "text": "hi"}, {"role": "b", "text": ""}], a="r", d={"k": "v"}, l=[7, 8]) == want

    def test_constants_are_folded(self):
        source = "{% set a = 1 + 2 %}x{{ 'y' | upper }}{% if 1 < 2 and not false %}z{{ 'p' ~ 'q' }}{% else %}{{ b }}{% endif %}{% if none %}n{% endif %}"
        assert Template(source).tree == (chat_template.Set("a", Const(3)), Print(Const("xYzpq")))
        assert Template("{{ 'a' if true else b }}{{ '' }}").tree == (Print(Const("a")),)

    @pytest.mark.parametrize("source", [
        "{{ x.__class__ }}", "{{ _x }}", "{{ x['a'].__len__ }}", "{{ x() }}", "{{ x.y() }}", "{% import os %}", "{{ 'a' | eval }}", "{{ 'a' * 9 }}",
        "{{ 1 ** 2 }}", "{% if x %}", "{{ x", "{% for x in y %}{% endif %}", "{{ a b }}", "{{ 'a' + 1 }}", "{% else %}", "{{ 'a }}", "{{ 1 < 'a' }}"])
    def test_refused(self, source):
        with pytest.raises(TemplateError):
            rendered(source, x={"a": "b"}, y=[1])

    @pytest.mark.parametrize("source", ["{{ nothing }}", "{{ x }}", "{% for a in 'text' %}{% endfor %}", "{{ s.upper }}", "{{ 'a' | upper(1) }}"])
    def test_errors(self, source):
        with pytest.raises(TemplateError):
            rendered(source, x={"a": "b"}, s="text")

    def test_text_is_bounded(self):
        doubling = "{% set a = '0123456789abcdef' %}" + "{% set a = a ~ b ~ a %}" * 30
        with pytest.raises(TemplateError, match="too long"):
            rendered(doubling, b="-")

    def test_streams(self):
        assert MARKED.template.streams
        assert not Template("{% if messages[0].role == 'system' %}s{% endif %}{% for m in messages %}{% endfor %}").streams
        assert not Template("{% for x in [1, 2] %}{% for m in messages %}{% endfor %}{% endfor %}").streams
        taken = []

        def turns():
            for i in range(5):
                taken.append(i)
                yield {"role": "user", "text": str(i)}

        out = MARKED.template.render(turns())
        next(out)
        assert taken == [0, 1]  # one turn ahead, to know the last

    def test_generation(self):
        source = "{% for m in messages %}{{ m.role }}:{% generation %}{{ m.text }}{% if m.role == 'b' %}!{% endif %}{% endgeneration %};{% endfor %}"
        parts = list(Template(source).render([{"role": "a", "text": "x"}, {"role": "b", "text": "y"}]))
        assert "".join(x for x, marked in parts if marked) == "xy!" and sum(marked is None for _, marked in parts) == 2


class TestEscaper:
    def test_round_trip(self):
        """Whatever the text, no control string begins in it or at its end, and the backslashes can be taken away."""
        draw = random.Random(4)
        escape = Escaper(MARKED.controls)
        bits = ["<", "/", "turn", ">", "#", "### ", "User", ":", "\\", "Assistant", "\n", "x", "</turn>", "é😀"]
        for _ in range(4000):
            text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 9)))
            out = escape(text)
            assert escape.back(out) == text
            for closing in ("", "turn>", "/turn>", "## User:", " User:", MARKED.closes):
                unescaped = chat_format._ESCAPED.sub("\0", out) + closing
                assert sum(unescaped.count(c) for c in MARKED.controls) == sum(closing.count(c) for c in MARKED.controls)

    def test_plain_text_stays(self):
        assert Escaper(MARKED.controls)("a < b # c ### d <turns>") == "a < b # c ### d <turns>"


def expected(rows):
    by: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {conv: (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(len(t) for r, t in turns if r == "assistant"),
                   sha("".join(t for r, t in turns if r == "assistant"))) for conv, turns in by.items()}


class TestChatFormat:
    ROWS = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, 1, "assistant", None), (2, 0, None, ""),
            (2, 2, "tool:\n=x\\", "<"), (2, 2, "tool:\n=x\\", "<"), (3, None, "assistant", "é😀" * 40_000), (3, 5, "assistant", "### "), (3, 5, "user", "a\n\nb"),
            (None, 0, "user", "x"), (None, 1, "Assistant", "y <turn>### User:\n</turn"), (4, 0, "system", "### User:\n")]

    def digests(self, spark, rows, **options):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("loss", F.lit(2))
        pieces = chat_format.formatted(df, **options)
        return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(pieces).collect()}, pieces

    @pytest.mark.parametrize("piece", [1, 50, chat_format.PIECE])
    def test_read_back(self, spark, piece):
        got, pieces = self.digests(spark, self.ROWS, piece=piece)
        assert got == expected(self.ROWS)
        held = pieces.collect()
        assert sorted(r.piece for r in held if r.conv_id == 2) == list(range({1: 4, 50: 2}.get(piece, 1)))
        texts = [Escaper.back(r.formatted[s.start:s.stop]) for r in held for s in r.loss if r.conv_id == 1]
        assert texts == ["\\### Assistant: </turn> ok"]

    def test_random(self, spark):
        draw = random.Random(8)
        bits = ["<turn>", "</turn>\n", "### User:", "\\", "#", "<", "word ", "\n", "é"]
        rows = [(draw.randrange(40), draw.randrange(6), draw.choice(["user", "assistant", "system", "", "=x", ":"]), "".join(draw.choice(bits) for _ in range(draw.randint(0, 12))))
                for _ in range(600)]
        assert self.digests(spark, rows)[0] == expected(rows)

    def test_long_conversation_in_pieces(self, spark):
        rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i} " * 20) for i in range(3000)]
        got, pieces = self.digests(spark, rows, piece=10_000)
        assert got == expected(rows)
        sizes = [len(r.formatted) for r in pieces.collect()]
        assert len(sizes) > 40 and max(sizes) < 11_000

    def test_from_files(self, spark, tmp_path):
        rows = [(i % 9, i, "assistant", f"{i} </turn>") for i in range(200)]
        _, pieces = self.digests(spark, rows, piece=30)
        pieces.repartition(5).write.parquet(str(tmp_path / "p"))
        again = chat_format.read_back(chat_format.arranged(spark.read.parquet(str(tmp_path / "p"))))
        assert {r.conv_id: r.turns_sha256 for r in again.collect()} == {k: v[1] for k, v in expected(rows).items()}

    def test_empty(self, spark):
        assert self.digests(spark, [])[0] == {}

    def test_damaged_output_is_refused(self):
        for bad in ("<turn>### User:\nx", "x</turn>\n", "<turn>### User:\nx\\</turn>\n"):
            with pytest.raises(ValueError):
                list(MARKED.read(bad))
