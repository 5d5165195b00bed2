"""Secret scan with one automaton for all rules.

The rules' regular expressions are parsed over bytes, joined into one nondeterministic
automaton, made deterministic by subset construction and minimised into a transition array
over byte classes. It is built for the reversed expressions with anything in front, so one
backward pass over a text marks every place where a match of any rule begins. From such a
place the rule's own forward automaton runs to the longest end. Going through the starts
from left to right and skipping those inside the last match gives each rule's leftmost,
longest, non-overlapping matches.

Null texts count as empty. Offsets are code points, the end exclusive. Repeated rows give
repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.texts import encoded

ALL = (1 << 256) - 1


@dataclass(frozen=True)
class Rule:
    """``head``: what of a match doesn't count towards ``least`` bytes, which shorter matches fail."""

    kind: str
    pattern: str
    head: str = ""
    least: int = 0


_KEYS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_HEAD = _KEYS + r"""["']?\x20*[:=]\x20*["']?"""
# In the access and hex rules the least length stands in the pattern: a run's first match takes
# the whole run, so the runs that are long enough are the same.
BASE_RULES = (Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", _HEAD, 6), Rule("access", "AKIA[A-Z0-9]{16,}"),
              Rule("hex", "[0-9a-f]{24,}"))
MORE_RULES = (Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
              Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"))
RULES = BASE_RULES + MORE_RULES


class _Parser:
    """Literals, escapes, classes, groups, alternatives and counts, as nested tuples."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern.encode("latin-1"), 0

    def peek(self) -> bytes:
        return self.text[self.at:self.at + 1]

    def take(self) -> bytes:
        self.at += 1
        return self.text[self.at - 1:self.at]

    def alternatives(self) -> tuple:
        found = [self.sequence()]
        while self.peek() == b"|":
            self.take()
            found.append(self.sequence())
        return ("any", *found)

    def sequence(self) -> tuple:
        found = []
        while self.peek() not in (b"", b"|", b")"):
            found.append(self.counted(self.atom()))
        return ("all", *found)

    def atom(self) -> tuple:
        c = self.take()
        if c == b"(":
            inner = self.alternatives()
            if self.take() != b")":
                raise ValueError("a group is not closed")
            return inner
        if c == b"[":
            return ("set", self.members())
        if c == b".":
            return ("set", ALL & ~(1 << 10))
        return ("set", 1 << (self.escaped() if c == b"\\" else c[0]))

    def escaped(self) -> int:
        c = self.take()
        if c == b"x":
            self.at += 2
            return int(self.text[self.at - 2:self.at], 16)
        return {b"n": 10, b"t": 9, b"r": 13}.get(c, c[0])

    def members(self) -> int:
        negated, mask = self.peek() == b"^", 0
        if negated:
            self.take()
        while self.peek() != b"]":
            c = self.take()
            low = high = self.escaped() if c == b"\\" else c[0]
            if self.peek() == b"-" and self.text[self.at + 1:self.at + 2] != b"]":
                self.take()
                c = self.take()
                high = self.escaped() if c == b"\\" else c[0]
            mask |= ((1 << (high + 1)) - 1) & ~((1 << low) - 1)
        self.take()
        return ALL & ~mask if negated else mask

    def counted(self, node: tuple) -> tuple:
        while self.peek() in (b"?", b"*", b"+", b"{"):
            c = self.take()
            if c == b"{":
                end = self.text.index(b"}", self.at)
                low, comma, high = self.text[self.at:end].partition(b",")
                self.at = end + 1
                bounds = int(low), (int(high) if high else None) if comma else int(low)
            else:
                bounds = {b"?": (0, 1), b"*": (0, None), b"+": (1, None)}[c]
            node = ("times", node, *bounds)
        return node


def parsed(pattern: str) -> tuple:
    return _Parser(pattern).alternatives()


def reversed_(node: tuple) -> tuple:
    if node[0] == "set":
        return node
    if node[0] == "times":
        return ("times", reversed_(node[1]), *node[2:])
    parts = [reversed_(x) for x in node[1:]]
    return (node[0], *(parts[::-1] if node[0] == "all" else parts))


class Nondeterministic:
    """States with byte sets to others, and free moves."""

    def __init__(self):
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node: tuple, start: int) -> int:
        """Grow from ``start``; the state reached after the node."""
        if node[0] == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if node[0] == "all":
            for part in node[1:]:
                start = self.add(part, start)
            return start
        if node[0] == "any":
            end = self.state()
            for part in node[1:]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for x in self.free[left.pop()]:
                if x not in seen:
                    seen.add(x)
                    left.append(x)
        return frozenset(x for x in seen if self.moves[x] or x in self.final)

    final: dict[int, int] = {}


@dataclass
class Automaton:
    """Deterministic and minimal. ``step`` is flat, states premultiplied by the number of byte classes;
    states from ``accepting`` on accept the rules in ``rules``."""

    classes: bytes
    step: list[int]
    start: int
    accepting: int
    rules: dict[int, tuple[int, ...]]
    dead: int

    @classmethod
    def build(cls, nodes: list[tuple], anywhere: bool) -> Automaton:
        nfa = Nondeterministic()
        start = nfa.state()
        if anywhere:
            nfa.moves[start].append((ALL, start))
        nfa.final = {}
        for rule, node in enumerate(nodes):
            first = nfa.state()
            nfa.free[start].append(first)
            nfa.final[nfa.add(node, first)] = rule
        sets = {mask for moves in nfa.moves for mask, _ in moves}
        kinds: dict[tuple, int] = {}
        classes = bytes(kinds.setdefault(tuple(mask >> b & 1 for mask in sets), len(kinds)) for b in range(256))
        sample = [classes.index(k) for k in range(len(kinds))]
        known = {nfa.closed([start]): 0}
        order, table = list(known), []
        for subset in order:
            row = []
            for b in sample:
                target = nfa.closed({to for s in subset for mask, to in nfa.moves[s] if mask >> b & 1})
                if target not in known:
                    known[target] = len(order)
                    order.append(target)
                row.append(known[target])
            table.append(row)
        accepted = [tuple(sorted({nfa.final[s] for s in subset if s in nfa.final})) for subset in order]
        return cls.minimal(classes, np.array(table), accepted)

    @classmethod
    def minimal(cls, classes: bytes, table: np.ndarray, accepted: list[tuple[int, ...]]) -> Automaton:
        """Split blocks of states until all of a block go to the same blocks."""
        marks = {a: i for i, a in enumerate(sorted(set(accepted)))}  # the empty tuple sorts first
        block, count = np.array([marks[a] for a in accepted]), len(marks)
        while True:
            rows = np.column_stack([block, block[table]])
            _, finer = np.unique(rows, axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() + 1 == count:
                break
            block, count = finer, int(finer.max()) + 1
        # Blocks are numbered by their accepted rules first, so the accepting ones come last.
        width = table.shape[1]
        step, rules, accepting, dead = [0] * (count * width), {}, count * width, -1
        for state, b in enumerate(finer.tolist()):
            step[b * width:(b + 1) * width] = (finer[table[state]] * width).tolist()
            if accepted[state]:
                rules[b * width] = accepted[state]
                accepting = min(accepting, b * width)
            elif np.all(finer[table[state]] == b):
                dead = b * width
        return cls(classes, step, int(finer[0]) * width, accepting, rules, dead)

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that begins at ``at``, or -1."""
        state, step, classes, end = self.start, self.step, self.classes, -1
        if state >= self.accepting:
            end = at
        for i in range(at, len(data)):
            state = step[state + classes[data[i]]]
            if state >= self.accepting:
                end = i + 1
            elif state == self.dead:
                break
        return end


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nodes = [parsed(r.pattern) for r in rules]
        self.starts = Automaton.build([reversed_(n) for n in nodes], anywhere=True)
        self.forward = [Automaton.build([n], anywhere=False) for n in nodes]
        self.heads = [Automaton.build([parsed(r.head)], anywhere=False) if r.head else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of every match, in bytes, by start and rule."""
        step, state, accepting = self.starts.step, self.starts.start, self.starts.accepting
        last, marks = len(data) - 1, []
        for i, c in enumerate(data.translate(self.starts.classes)[::-1]):
            state = step[state + c]
            if state >= accepting:
                marks.append((last - i, state))
        if not marks:
            return []
        taken, found = [0] * len(self.rules), []
        for at, state in reversed(marks):
            for rule in self.starts.rules[state]:
                if at < taken[rule]:
                    continue
                end = taken[rule] = self.forward[rule].longest(data, at)
                head = self.heads[rule]
                counted = end - (head.longest(data, at) if head else at)
                if counted >= self.rules[rule].least:
                    found.append((at, rule, end))
        return sorted(found)


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id and its matches as an array of (start, rule number, end, kind), in that order."""
    scanner, kinds = Scanner(rules), [r.kind for r in rules]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    inner = pa.struct([("start", pa.int64()), ("rule", pa.int32()), ("end", pa.int64()), ("kind", pa.string())])
    schema = (f"doc_id {source.schema['doc_id'].dataType.simpleString()}, "
              "spans array<struct<start:long,rule:int,end:long,kind:string>>")

    def points(data: bytes, spans: list) -> list[dict]:
        if spans and not data.isascii():
            lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            spans = [(int(lead[a]) - 1, r, int(lead[b - 1])) for a, r, b in spans]
        return [{"start": a, "rule": r, "end": b, "kind": kinds[r]} for a, r, b in spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [points(x, scanner.spans(x)) for x in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(inner))], names=["doc_id", "spans"])

    return source.mapInArrow(scan, schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_rule(number: int) -> Column:
    return F.filter("spans", lambda s: s["rule"] == number)


def digest(matches: DataFrame, base: int = len(BASE_RULES)) -> DataFrame:
    """Counts and a hash of the first ``base`` rules' spans, and all spans as text."""
    of_base = F.filter("spans", lambda s: s["rule"] < base)
    counts = [F.size(_of_rule(k)).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(BASE_RULES)]
    return matches.select("doc_id", *counts, F.sha2(_listed(of_base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
