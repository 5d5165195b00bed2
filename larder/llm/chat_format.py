"""Conversations as training text, by a compiled template, with the stretches to learn marked.

Rows are dealt by conversation, sorted by turn, and streamed: the template's closures write
turn after turn, and a conversation's text leaves in pieces of about ``PIECE`` characters, cut between
turns only. So no conversation is held whole, however long; one is written by one task, since a
template may look at the turns in order and a checksum of all turns is sequential. (A template that does
more than loop over the turns once has each conversation's turns in memory.)

Control strings inside texts are escaped: each place where one begins gets a backslash in front, as
every backslash does, also a beginning of one at a text's end, where the template might complete
it. Dropping the backslashes gives the text back, so what was formatted can be read again.

Defined results: null texts and roles are empty; a null conversation id is an id like any other; turns go
by turn (null first), then role, then text, and repeated rows are turns of their own; roles other
than system, user and assistant are written as they are, behind a ``=``. No rows, no pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.chat_template import Template
from larder.llm.texts import chunked

PIECE = 1 << 18
ESCAPE = "\\"
_ESCAPED = re.compile(r"\\(.)", re.S)
PIECES = "piece int, formatted string, loss array<struct<start: int, stop: int>>"


class Escaper:
    """Puts the escape character before every beginning of a control string; ``back`` takes it away."""

    def __init__(self, controls: tuple[str, ...]):
        if any(not c or ESCAPE in c for c in controls):
            raise ValueError("control strings are not empty and hold no escape character")
        whole = [re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in controls]
        ends = {c[:i] for c in controls for i in range(1, len(c))}
        parts = [re.escape(e[0]) + f"(?={re.escape(e[1:])}\\Z)" for e in sorted(ends)]
        self.pattern = re.compile("|".join([re.escape(ESCAPE), *whole, *parts]))

    def __call__(self, text: str) -> str:
        return self.pattern.sub(lambda m: ESCAPE + m[0], text)

    @staticmethod
    def back(text: str) -> str:
        return _ESCAPED.sub(lambda m: m[1], text)


@dataclass(frozen=True)
class ChatFormat:
    """A template, its control strings, and how its turns are read again.

    A turn is ``opens``, a name, ``parts``, a text and ``closes``; ``names`` are the names of the usual roles.
    """

    source: str
    opens: str
    parts: str
    closes: str
    names: tuple[tuple[str, str], ...]
    controls: tuple[str, ...]

    @cached_property
    def template(self) -> Template:
        more = Escaper((*self.controls, *(self.parts[:1],)))
        return Template(self.source, {"escape": Escaper(self.controls), "escape_name": more})

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn; raises unless the whole of it is turns."""
        at, roles = 0, {name: role for role, name in self.names}
        while at < len(formatted):
            if not formatted.startswith(self.opens, at):
                raise ValueError(f"no turn begins at {at}")
            start = at + len(self.opens)
            name, start = self._until(formatted, start, self.parts)
            text, at = self._until(formatted, start, self.closes)
            role = roles.get(name)
            yield Escaper.back(name[1:]) if role is None else role, Escaper.back(text)

    @staticmethod
    def _until(formatted: str, at: int, end: str) -> tuple[str, int]:
        """What stands before the next ``end`` that is not escaped, and the place behind it."""
        for m in re.compile(r"\\.|" + re.escape(end), re.S).finditer(formatted, at):
            if m[0] == end:
                return formatted[at:m.start()], m.end()
        raise ValueError(f"no {end!r} after {at}")


NAMES = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
MARKED = ChatFormat(
    source=("{% for m in messages %}<turn>### "
            "{% if m.role == 'system' %}System{% elif m.role == 'user' %}User{% elif m.role == 'assistant' %}Assistant"
            "{% else %}={{ m.role | escape_name }}{% endif %}:\n"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
            "</turn>\n{% endfor %}"),
    opens="<turn>### ", parts=":\n", closes="</turn>\n", names=NAMES,
    controls=("<turn>", "</turn>", *(f"### {name}:" for _, name in NAMES)))


def _rows(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple]:
    """Rows one by one, about a megabyte of text as Python objects at a time."""
    for part, _ in chunked(batches, text):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def written(template: Template, turns: Iterator[dict], piece: int = PIECE) -> Iterator[tuple[str, list[dict]]]:
    """(text, stretches to learn) of the pieces of one conversation; stretches are by code points of the piece."""
    parts, loss, size = [], [], 0
    for text, marked in template.render(turns):
        if marked is None:
            if size >= piece:
                yield "".join(parts), loss
                parts, loss, size = [], [], 0
            continue
        if marked:
            if loss and loss[-1]["stop"] == size and parts:
                loss[-1]["stop"] += len(text)
            else:
                loss.append({"start": size, "stop": size + len(text)})
        parts.append(text)
        size += len(text)
    if parts:
        yield "".join(parts), loss


def formatted(rows: DataFrame, form: ChatFormat = MARKED, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              piece: int = PIECE) -> DataFrame:
    """(conv_id, piece, formatted, loss): each conversation's text in pieces, which lie next to each other and in order."""
    used = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = used.schema["conv_id"].dataType.simpleString()
    dealt = used.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, kinds = form.template, None
        out, size = [], 0

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [kinds, pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)],
                                              names=["conv_id", "piece", "formatted", "loss"])

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = batch.schema.field(0).type
                yield batch

        for conv, turns in groupby(_rows(noted(), "text"), key=lambda row: row[0]):
            messages = ({"role": r, "text": t} for _, r, t in turns)
            for number, (body, loss) in enumerate(written(template, messages, piece)):
                out.append((conv, number, body, loss))
                size += len(body)
                if size >= piece:
                    yield flushed()
                    out, size = [], 0
        if out:
            yield flushed()

    return dealt.mapInArrow(write, f"conv_id {kind}, {PIECES}")


def arranged(pieces: DataFrame) -> DataFrame:
    """Pieces, from a file say, as ``formatted`` gives them: those of a conversation in one partition and in order."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")


def read_back(pieces: DataFrame, form: ChatFormat = MARKED) -> DataFrame:
    """A row per conversation with counts and checksums of its turns and of the text to learn, from the output alone.

    ``pieces`` as from ``formatted`` or ``arranged``. Checksums are fed piece by piece.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = None, []

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = batch.schema.field(0).type
                yield batch

        def flushed() -> pa.RecordBatch:
            types = [kinds, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for conv, parts in groupby(_rows(noted(), "formatted"), key=lambda row: row[0]):
            turns, learnt, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, body, loss in parts:
                size += len(body)
                for role, text in form.read(body):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in loss:
                    text = Escaper.back(body[span["start"]:span["stop"]])
                    learnt.update(text.encode())
                    chars += len(text)
            out.append((conv, n, turns.hexdigest(), chars, learnt.hexdigest(), size))
            if len(out) >= 4096:
                yield flushed()
                out = []
        if out:
            yield flushed()

    return pieces.select("conv_id", "piece", "formatted", "loss").mapInArrow(
        read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
