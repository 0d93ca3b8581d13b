"""A small template language for chats, compiled: source, syntax tree, folded tree, Python closures.

    {{ expression }}                                   its text
    {% for m in messages %} ... {% endfor %}           loop.first, loop.last, loop.index0 inside
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}           what a model is trained to produce
    {# a remark #}

Expressions: 'text', whole numbers, true, false, none, names, a.b and a['b'] (keys of mappings only), + (texts or
numbers), %, == != < <= > >=, in, not in, and, or, not, (...), and filters: value | name. A dash inside a brace
({{- or -%}) takes the white space on that side away. Nothing else can be reached: no attributes, calls or imports.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """A template that cannot be compiled, or a value that it cannot render."""


# --- syntax tree -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: str


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Unary:
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Put:
    name: str
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Choice:
    cases: tuple  # of (condition, body); the last condition may be Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- source to tree --------------------------------------------------------------------------------------------

_PIECES = re.compile(r"\{([{%#])(-?)(.*?)(-?)([}%#])\}", re.S)
_TOKENS = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>[=!<>]=|[<>+%|().\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_CONSTANTS = {"true": True, "false": False, "none": None}
_CLOSES = {"{": "}", "%": "%", "#": "#"}


class Expression:
    """A recursive-descent reader of one expression; the weakest operators come first."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            found = _TOKENS.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("sign", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()[1]!r}")

    def whole(self):
        found = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return found

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Binary("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Binary("and", left, self.negated())
        return left

    def negated(self):
        return Unary(self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.sum()
        if op := self.take(*_COMPARE):
            return Binary(op, left, self.sum())
        if self.take("in"):
            return Binary("in", left, self.sum())
        if self.take("not"):
            self.need("in")
            return Unary(Binary("in", left, self.sum()))
        return left

    def sum(self):
        left = self.rest()
        while self.take("+"):
            left = Binary("+", left, self.rest())
        return left

    def rest(self):
        left = self.filtered()
        while self.take("%"):
            left = Binary("%", left, self.filtered())
        return left

    def filtered(self):
        value = self.atom()
        while True:
            if self.take("."):
                value = Item(value, self.name())
            elif self.take("["):
                kind, key = self.peek()
                if kind != "text":
                    raise TemplateError("only a text can stand in brackets")
                self.at += 1
                self.need("]")
                value = Item(value, self.text(key))
            elif self.take("|"):
                value = Filter(self.name(), value)
            else:
                return value

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    @staticmethod
    def text(token: str) -> str:
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "text":
            return Const(self.text(value))
        if kind == "number":
            return Const(int(value))
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Const(_CONSTANTS[value]) if value in _CONSTANTS else Name(value)
        if value == "(":
            inner = self.either()
            self.need(")")
            return inner
        raise TemplateError(f"unexpected {value!r}")


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(kind, content): text, { for an output, % for a statement."""
    at, strip = 0, False
    for m in _PIECES.finditer(source):
        if _CLOSES[m[1]] != m[5]:
            raise TemplateError(f"{m[0]!r} is closed by another kind of brace")
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[2] else text
        if text:
            yield "text", text
        if m[1] != "#":
            yield m[1], m[3].strip()
        at, strip = m.end(), bool(m[4])
    text = source[at:].lstrip() if strip else source[at:]
    if text:
        yield "text", text


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces = list(_pieces(source))
    at = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        """Nodes up to one of the ends, which end it was and what stood behind it."""
        nonlocal at
        nodes = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                nodes.append(Output(Const(content)))
                continue
            if kind == "{":
                nodes.append(Output(Expression(content).whole()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(nodes), word, rest.strip()
            nodes.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), "", ""

    def statement(word: str, rest: str):
        if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.S)):
            return Put(m[1], Expression(m[2]).whole())
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)):
            return Loop(m[1], Expression(m[2]).whole(), block("endfor")[0])
        if word == "generation" and not rest:
            return Generation(block("endgeneration")[0])
        if word == "if":
            cases, condition = [], Expression(rest).whole()
            while True:
                body, end, behind = block("elif", "else", "endif")
                cases.append((condition, body))
                if end == "elif":
                    condition = Expression(behind).whole()
                elif end == "else":
                    cases.append((Const(True), block("endif")[0]))
                    return Choice(tuple(cases))
                else:
                    return Choice(tuple(cases))
        raise TemplateError(f"unknown statement: {word} {rest}".strip())

    return block()[0]


# --- folding ---------------------------------------------------------------------------------------------------


def _truth(value: Any) -> bool:
    return bool(value)


def _text(value: Any) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} has no text")


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    return _text(a) + _text(b)


def _remainder(a: Any, b: Any) -> int:
    if not (isinstance(a, int) and isinstance(b, int)) or b == 0:
        raise TemplateError("% needs whole numbers, the second not 0")
    return a % b


def _ordered(op: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    def compare(a: Any, b: Any) -> bool:
        try:
            return op(a, b)
        except TypeError as e:
            raise TemplateError(str(e)) from None

    return compare


def _within(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    if isinstance(b, Mapping):
        return a in b
    raise TemplateError("in needs a text or a mapping on its right")


_BINARY = {op: _ordered(f) for op, f in _COMPARE.items()} | {"+": _plus, "%": _remainder, "in": _within}


def fold(node: Any, filters: Mapping[str, Callable[[str], str]]) -> Any:
    """An expression with everything worked out that does not depend on the conversation."""
    match node:
        case Unary(of):
            of = fold(of, filters)
            return Const(not _truth(of.value)) if isinstance(of, Const) else Unary(of)
        case Filter(name, of):
            if name not in filters:
                raise TemplateError(f"unknown filter: {name}")
            of = fold(of, filters)
            return Const(filters[name](_text(of.value))) if isinstance(of, Const) else Filter(name, of)
        case Item(of, key):
            return Item(fold(of, filters), key)
        case Binary("and" | "or" as op, left, right):
            left, right = fold(left, filters), fold(right, filters)
            if isinstance(left, Const):
                return right if _truth(left.value) == (op == "and") else left
            return Binary(op, left, right)
        case Binary(op, left, right):
            left, right = fold(left, filters), fold(right, filters)
            if isinstance(left, Const) and isinstance(right, Const):
                return Const(_BINARY[op](left.value, right.value))
            return Binary(op, left, right)
    return node


def folded(nodes: Iterable, filters: Mapping[str, Callable[[str], str]]) -> tuple:
    """Statements with their expressions folded, constant choices decided and neighbouring texts made one."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, Output) and isinstance(node.value, Const):
            text = _text(node.value.value)
            if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                out[-1] = Output(Const(out[-1].value.value + text))
            elif text:
                out.append(Output(Const(text)))
        else:
            out.append(node)

    for node in nodes:
        match node:
            case Output(value):
                add(Output(fold(value, filters)))
            case Put(name, value):
                add(Put(name, fold(value, filters)))
            case Loop(name, over, body):
                add(Loop(name, fold(over, filters), folded(body, filters)))
            case Generation(body):
                add(Generation(folded(body, filters)))
            case Choice(cases):
                kept = []
                for condition, body in cases:
                    condition = fold(condition, filters)
                    if isinstance(condition, Const) and not _truth(condition.value):
                        continue
                    kept.append((condition, folded(body, filters)))
                    if isinstance(condition, Const):
                        break
                if kept and isinstance(kept[0][0], Const):
                    for inner in kept[0][1]:
                        add(inner)
                elif kept:
                    add(Choice(tuple(kept)))
    return tuple(out)


# --- closures --------------------------------------------------------------------------------------------------

#: What closures yield beside texts: marks around what is generated, and the end of a turn of the outermost loop.
BEGIN, END, TURN = object(), object(), object()
Scope = dict[str, Any]


def _evaluator(node: Any, filters: Mapping[str, Callable[[str], str]]) -> Callable[[Scope], Any]:
    match node:
        case Const(value):
            return lambda scope: value
        case Name(name):

            def named(scope: Scope) -> Any:
                if name not in scope:
                    raise TemplateError(f"unknown name: {name}")
                return scope[name]

            return named
        case Item(of, key):
            inner = _evaluator(of, filters)

            def item(scope: Scope) -> Any:
                value = inner(scope)
                if not isinstance(value, Mapping) or key not in value:
                    raise TemplateError(f"no {key} here")
                return value[key]

            return item
        case Filter(name, of):
            inner, apply = _evaluator(of, filters), filters[name]
            return lambda scope: apply(_text(inner(scope)))
        case Unary(of):
            inner = _evaluator(of, filters)
            return lambda scope: not _truth(inner(scope))
        case Binary("and", left, right):
            a, b = _evaluator(left, filters), _evaluator(right, filters)
            return lambda scope: b(scope) if _truth(v := a(scope)) else v
        case Binary("or", left, right):
            a, b = _evaluator(left, filters), _evaluator(right, filters)
            return lambda scope: v if _truth(v := a(scope)) else b(scope)
        case Binary(op, left, right):
            a, b, run = _evaluator(left, filters), _evaluator(right, filters), _BINARY[op]
            return lambda scope: run(a(scope), b(scope))
    raise TemplateError(f"no expression: {node!r}")


def _with_last(items: Iterable) -> Iterator[tuple[Any, bool]]:
    """Every item, and whether it is the last; one item is held back."""
    rows = iter(items)
    try:
        held = next(rows)
    except StopIteration:
        return
    for row in rows:
        yield held, False
        held = row
    yield held, True


def _runner(nodes: tuple, filters: Mapping[str, Callable[[str], str]], depth: int = 0) -> Callable[[Scope], Iterator]:
    """Statements as one closure over the scope, which yields texts and marks as it goes."""
    steps = [_step(node, filters, depth) for node in nodes]

    def run(scope: Scope) -> Iterator:
        for step in steps:
            yield from step(scope)

    return steps[0] if len(steps) == 1 else run


def _step(node: Any, filters: Mapping[str, Callable[[str], str]], depth: int) -> Callable[[Scope], Iterator]:
    match node:
        case Output(Const(value)):
            constant = (value,)
            return lambda scope: iter(constant)
        case Output(value):
            shown = _evaluator(value, filters)
            return lambda scope: iter((_text(shown(scope)),))
        case Put(name, value):
            put = _evaluator(value, filters)

            def assign(scope: Scope) -> Iterator:
                scope[name] = put(scope)
                return iter(())

            return assign
        case Generation(body):
            inside = _runner(body, filters, depth)

            def generation(scope: Scope) -> Iterator:
                yield BEGIN
                yield from inside(scope)
                yield END

            return generation
        case Choice(cases):
            ways = [(_evaluator(condition, filters), _runner(body, filters, depth)) for condition, body in cases]

            def choice(scope: Scope) -> Iterator:
                for condition, way in ways:
                    if _truth(condition(scope)):
                        return way(scope)
                return iter(())

            return choice
        case Loop(name, over, body):
            source, inside = _evaluator(over, filters), _runner(body, filters, depth + 1)

            def loop(scope: Scope) -> Iterator:
                items = source(scope)
                if isinstance(items, (str, bytes, Mapping)) or not isinstance(items, Iterable):
                    raise TemplateError("for needs a list of messages")
                outer = {k: scope[k] for k in (name, "loop") if k in scope}
                for i, (item, last) in enumerate(_with_last(items)):
                    scope[name], scope["loop"] = item, {"first": i == 0, "last": last, "index0": i}
                    yield from inside(scope)
                    if depth == 0:
                        yield TURN
                for k in (name, "loop"):
                    scope.pop(k, None)
                scope.update(outer)

            return loop
    raise TemplateError(f"no statement: {node!r}")


@dataclass(frozen=True)
class Template:
    """A compiled template. Rendering pulls messages one at a time and hands out texts and marks one at a time."""

    source: str
    filters: Mapping[str, Callable[[str], str]] = field(default_factory=dict)

    def tree(self) -> tuple:
        return folded(parse(self.source), self.filters)

    def compiled(self) -> Callable[[Scope], Iterator]:
        nodes = self.tree()
        return _runner(nodes, self.filters) if nodes else lambda scope: iter(())
