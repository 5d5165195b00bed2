"""A sandboxed template language: parsed to a syntax tree, constants folded, compiled to Python closures.

Text stands for itself. ``{{ expression }}`` prints, ``{# … #}`` is a comment, and statements are
``{% if e %} {% elif e %} {% else %} {% endif %}``, ``{% for x in e %} {% endfor %}``, ``{% set x = e %}`` and
``{% generation %} {% endgeneration %}``, which marks what a model should learn to write. A dash
inside a bracket (``{%-``, ``-}}``) strips the white space beside it.

Expressions: strings, integers, ``true false none``, lists, names, ``a.b``, ``a['b']``, filters
``a | f(b)``, ``not and or``, ``== != < <= > >= in``, ``+ -``, ``~`` (joins as text), ``a if c else b``. In a loop,
``loop.index``, ``loop.first`` and ``loop.last`` are known.

The sandbox: a template sees strings, integers, booleans, none, lists and dictionaries with text keys,
reads them by key only (never a Python attribute) and calls nothing but the filters it is given. Names may not
begin with an underscore. What is set in a loop ends with the iteration, every loop runs over given
data, and no text may grow beyond ``MOST_CHARS``: every rendering ends. An absent key is none, which prints as
nothing; an unknown name is an error.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

MOST_CHARS = 1 << 28
CUT = ("", None)  # yielded after each turn of an outermost loop: here the output may be divided


class TemplateError(ValueError):
    pass


# The syntax tree.

@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    id: str


@dataclass(frozen=True)
class Items:
    each: tuple


@dataclass(frozen=True)
class Key:
    base: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    base: Any
    name: str
    args: tuple


@dataclass(frozen=True)
class Op:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Print:
    of: Any


@dataclass(frozen=True)
class If:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# Parsing.

_ENDS = {"{": "}}", "%": "%}", "#": "#}"}
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[-+~|.,=<>()\[\]]))""", re.S)
_COMPARISONS = {"==", "!=", "<", "<=", ">", ">=", "in"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(kind, content): "text", "{" for an expression, "%" for a statement."""
    at, strip = 0, False
    while True:
        start = min((i for i in (source.find(x, at) for x in ("{{", "{%", "{#")) if i >= 0), default=-1)
        text = source[at:] if start < 0 else source[at:start]
        if strip:
            text = text.lstrip()
        if start < 0:
            yield "text", text
            return
        kind = source[start + 1]
        stop = _closing(source, start + 2, _ENDS[kind])
        inside = source[start + 2:stop]
        if inside.startswith("-"):
            text, inside = text.rstrip(), inside[1:]
        strip = inside.endswith("-")
        yield "text", text
        if kind != "#":
            yield kind, inside.removesuffix("-")
        at = stop + 2


def _closing(source: str, at: int, end: str) -> int:
    """Where ``end`` stands, outside of strings."""
    quote = ""
    while at < len(source):
        c = source[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif source.startswith(end, at):
            return at
        elif c in "'\"" and end != "#}":
            quote = c
        at += 1
    raise TemplateError(f"no {end}")


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while code[at:].strip():
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"cannot read {code[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent over the tokens of one bracket."""

    def __init__(self, code: str):
        self.tokens, self.at = _tokens(code), 0

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("mark", "name") and value in values

    def take(self, *values: str) -> bool:
        self.at += (hit := self.peek(*values))
        return hit

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, {self.tokens[self.at][1]!r} found")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"not a name: {value!r}")
        self.at += 1
        return value

    def end(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")

    def whole(self):
        found = self.choice()
        self.end()
        return found

    def choice(self):
        yes = self.disjunction()
        if not self.take("if"):
            return yes
        test = self.disjunction()
        return Choice(test, yes, self.choice() if self.take("else") else Const(None))

    def disjunction(self):
        left = self.conjunction()
        while self.take("or"):
            left = Op("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = Op("and", left, self.negation())
        return left

    def negation(self):
        return Not(self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.sum()
        if self.peek(*_COMPARISONS):
            op = self.tokens[self.at][1]
            self.at += 1
            return Op(op, left, self.sum())
        if self.take("not"):
            self.need("in")
            return Not(Op("in", left, self.sum()))
        return left

    def sum(self):
        left = self.filtered()
        while self.peek("+", "-", "~"):
            op = self.tokens[self.at][1]
            self.at += 1
            left = Op(op, left, self.filtered())
        return left

    def filtered(self):
        found = self.primary()
        while True:
            if self.take("."):
                found = Key(found, Const(self.name()))
            elif self.take("["):
                found = Key(found, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                found = Filter(found, name, self.items(")") if self.take("(") else ())
            else:
                return found

    def items(self, end: str) -> tuple:
        out = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.choice())
        return tuple(out)

    def primary(self):
        kind, value = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return Const(int(value))
        if self.take("-"):
            return Op("-", Const(0), self.primary())
        if self.take("("):
            found = self.choice()
            self.need(")")
            return found
        if self.take("["):
            return Items(self.items("]"))
        name = self.name()
        fixed = {"true": True, "false": False, "none": None}
        return Const(fixed[name]) if name in fixed else Name(name)


def parse(source: str) -> tuple:
    """The statements of a template."""
    pieces = list(_pieces(source))
    at = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        out = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                if content:
                    out.append(Print(Const(content)))
                continue
            if kind == "{":
                out.append(Print(_Expression(content).whole()))
                continue
            word, _, rest = content.strip().partition(" ")
            if word in ends:
                return tuple(out), word, rest
            out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return tuple(out), "", ""

    def statement(word: str, rest: str):
        if word == "if":
            return branches(rest)
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            return For(name, e.whole(), block("endfor")[0])
        if word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            return Set(name, e.whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    def branches(test: str) -> If:
        yes, word, rest = block("elif", "else", "endif")
        no = (branches(rest),) if word == "elif" else block("endif")[0] if word == "else" else ()
        return If(_Expression(test).whole(), yes, no)

    return block()[0]


# Values.

def text_of(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} cannot be printed")


def _bounded(text: str) -> str:
    if len(text) > MOST_CHARS:
        raise TemplateError("text too long")
    return text


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str):
        return _bounded(a + b)
    return _number(a) + _number(b)


def _number(a: Any) -> int:
    if isinstance(a, bool) or not isinstance(a, int):
        raise TemplateError(f"not a number: {a!r}")
    return a


def _ordered(compare: Callable) -> Callable:
    def run(a: Any, b: Any) -> bool:
        return compare(a, b) if isinstance(a, str) and isinstance(b, str) else compare(_number(a), _number(b))
    return run


def _within(a: Any, b: Any) -> bool:
    if isinstance(b, str) and isinstance(a, str) or isinstance(b, (list, Mapping)):
        return a in b
    raise TemplateError("'in' needs a text, list or dictionary")


_BINARY: dict[str, Callable] = {
    "+": _plus, "-": lambda a, b: _number(a) - _number(b), "~": lambda a, b: _bounded(text_of(a) + text_of(b)),
    "==": lambda a, b: type(a) is type(b) and a == b, "!=": lambda a, b: not (type(a) is type(b) and a == b), "in": _within,
    "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt), ">=": _ordered(operator.ge)}


def _at(base: Any, key: Any) -> Any:
    if isinstance(base, Mapping):
        return base.get(key) if isinstance(key, str) else None
    if isinstance(base, list) and isinstance(key, int) and not isinstance(key, bool):
        return base[key] if -len(base) <= key < len(base) else None
    raise TemplateError(f"no keys in a {type(base).__name__}")


FILTERS: dict[str, Callable] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len}


# Folding.

def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The node with everything computed that no rendering can change."""
    if isinstance(node, tuple):
        return _joined([x for one in node for x in _statements(one, filters)])
    if isinstance(node, Items):
        return Items(tuple(fold(x, filters) for x in node.each))
    if isinstance(node, Key):
        base, key = fold(node.base, filters), fold(node.key, filters)
        return Key(base, key)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        base, args = fold(node.base, filters), tuple(fold(x, filters) for x in node.args)
        if all(isinstance(x, Const) for x in (base, *args)):
            return Const(_called(filters[node.name], base.value, [x.value for x in args]))
        return Filter(base, node.name, args)
    if isinstance(node, Op):
        left, right = fold(node.left, filters), fold(node.right, filters)
        if node.op in ("and", "or"):
            if isinstance(left, Const):
                return right if bool(left.value) == (node.op == "and") else left
        elif isinstance(left, Const) and isinstance(right, Const):
            return Const(_BINARY[node.op](left.value, right.value))
        return Op(node.op, left, right)
    if isinstance(node, Not):
        of = fold(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Choice):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no, filters)
        return Choice(test, fold(node.yes, filters), fold(node.no, filters))
    return node


def _statements(node: Any, filters: Mapping[str, Callable]) -> tuple:
    """What a statement comes to: none, one, or the branch that a constant test takes."""
    if isinstance(node, Print):
        of = fold(node.of, filters)
        return (Print(Const(text_of(of.value))),) if isinstance(of, Const) and text_of(of.value) else () if isinstance(of, Const) else (Print(of),)
    if isinstance(node, If):
        test, yes, no = fold(node.test, filters), fold(node.yes, filters), fold(node.no, filters)
        if isinstance(test, Const):
            return yes if test.value else no
        return (If(test, yes, no),) if yes or no else ()
    if isinstance(node, For):
        return (replace(node, over=fold(node.over, filters), body=fold(node.body, filters)),)
    if isinstance(node, Set):
        return (replace(node, value=fold(node.value, filters)),)
    return (Generation(fold(node.body, filters)),)


def _joined(nodes: list) -> tuple:
    """Neighbouring constant texts as one."""
    out: list = []
    for node in nodes:
        if out and isinstance(node, Print) and isinstance(node.of, Const) and isinstance(out[-1], Print) and isinstance(out[-1].of, Const):
            out[-1] = Print(Const(out[-1].of.value + node.of.value))
        else:
            out.append(node)
    return tuple(out)


def _called(f: Callable, base: Any, args: list) -> Any:
    try:
        return f("" if base is None else base, *args)
    except TypeError as error:
        raise TemplateError(str(error)) from None


# Closures.

def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A function from the known names to the expression's value."""
    go = lambda x: _value(x, filters)
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        def look(scope, name=node.id):
            if name not in scope:
                raise TemplateError(f"unknown name {name!r}")
            return scope[name]
        return look
    if isinstance(node, Items):
        each = [go(x) for x in node.each]
        return lambda scope: [f(scope) for f in each]
    if isinstance(node, Key):
        base, key = go(node.base), go(node.key)
        return lambda scope: _at(base(scope), key(scope))
    if isinstance(node, Filter):
        base, f, args = go(node.base), filters[node.name], [go(x) for x in node.args]
        return lambda scope: _called(f, base(scope), [a(scope) for a in args])
    if isinstance(node, Not):
        of = go(node.of)
        return lambda scope: not of(scope)
    if isinstance(node, Choice):
        test, yes, no = go(node.test), go(node.yes), go(node.no)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    left, right = go(node.left), go(node.right)
    if node.op == "and":
        return lambda scope: left(scope) and right(scope)
    if node.op == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope, f=_BINARY[node.op]: f(left(scope), right(scope))


Writer = Callable[[dict, bool], Iterator[tuple[str, bool | None]]]


def _writer(nodes: tuple, filters: Mapping[str, Callable], depth: int = 0) -> Writer:
    """A function from the known names to (text, whether generated) in order."""
    steps = [_step(x, filters, depth) for x in nodes]

    def run(scope: dict, marked: bool):
        for step in steps:
            yield from step(scope, marked)

    return run


def _step(node: Any, filters: Mapping[str, Callable], depth: int) -> Writer:
    if isinstance(node, Print):
        of = _value(node.of, filters)

        def write(scope, marked):
            yield text_of(of(scope)), marked
        return write
    if isinstance(node, If):
        test, yes, no = _value(node.test, filters), _writer(node.yes, filters, depth), _writer(node.no, filters, depth)
        return lambda scope, marked: yes(scope, marked) if test(scope) else no(scope, marked)
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def put(scope, marked, name=node.name):
            scope[name] = value(scope)
            yield from ()
        return put
    if isinstance(node, Generation):
        body = _writer(node.body, filters, depth + 1)
        return lambda scope, marked: body(scope, True)
    over, body = _value(node.over, filters), _writer(node.body, filters, depth + 1)

    def loop(scope, marked, name=node.name):
        for index, last, value in _with_last(_looped(over(scope))):
            yield from body(scope | {name: value, "loop": {"index": index, "first": index == 1, "last": last}}, marked)
            if not depth:
                yield CUT
    return loop


def _looped(value: Any) -> Iterable:
    if isinstance(value, (list, Turns)):
        return value
    raise TemplateError("only lists can be looped over")


def _with_last(values: Iterable) -> Iterator[tuple[int, bool, Any]]:
    index, held = 0, None
    for value in values:
        if index:
            yield index, False, held
        index, held = index + 1, value
    if index:
        yield index, True, held


class Turns:
    """A conversation's turns as they come: they can be looped over once, and are never all held."""

    def __init__(self, turns: Iterable[dict]):
        self.turns = iter(turns)

    def __iter__(self) -> Iterator[dict]:
        return self.turns


def _names(node: Any) -> Iterator[str]:
    if isinstance(node, Name):
        yield node.id
    elif isinstance(node, tuple):
        for x in node:
            yield from _names(x)
    elif hasattr(node, "__dataclass_fields__"):
        for field in node.__dataclass_fields__:
            yield from _names(getattr(node, field))


class Template:
    """A compiled template. ``streams``: its turns are looped over just once, outermost, so they need not be held."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None, turns: str = "messages"):
        filters = FILTERS | dict(filters or {})
        self.tree = fold(parse(source), filters)
        self.turns = turns
        self.write = _writer(self.tree, filters)
        self.streams = list(_names(self.tree)).count(turns) == 1 and any(isinstance(x, For) and x.over == Name(turns) for x in self.tree)

    def render(self, turns: Iterable[dict], **names: Any) -> Iterator[tuple[str, bool | None]]:
        """(text, whether generated) in order, with ``CUT`` between the turns of an outermost loop."""
        return self.write({self.turns: Turns(turns) if self.streams else list(turns), **names}, False)
