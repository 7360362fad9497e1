r"""Chat formatting with a compiled template.

Templates are a small sandboxed language: ``{{ expression }}``, ``{% for m in
messages %}``, ``{% if %} / {% elif %} / {% else %}``, ``{% set name = expression %}``
and ``{% generation %} .. {% endgeneration %}``, which marks the text under the
loss mask.  Expressions have literals, names, ``m.field``, ``loop.index``, ``loop.first``,
``==``, ``!=``, ``and``, ``or``, ``not``, ``~``, filters (``trim``, ``upper``, ``lower``,
``escape``, ``escape_line``) and nothing else: no calls, no attributes of Python
objects.  A template becomes a syntax tree, constants are folded, and the tree
becomes Python closures that yield (text, under the mask) piece by piece, so a
conversation of any length is formatted turn by turn.

``escape`` puts a backslash before backslashes and before control strings;
``escape_line`` before line ends too.  ``unescape`` takes it back: a backslash
stands for the character after it.

Defined results: turns are in order of turn, then role and text, nulls first;
null role and text are empty; rows without conv_id are one conversation;
repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

OPEN, CLOSE_LINE = "<turn>", "</turn>\n"
TEMPLATE = "{% for m in messages %}<turn>{{ m.role | escape_line }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"

_ESCAPE = re.compile(r"\\|(?=</?turn>)")
_ESCAPE_LINE = re.compile(r"\\|(?=</?turn>|\n)")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_line(text: str) -> str:
    return _ESCAPE_LINE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": escape, "escape_line": escape_line}


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    cases: tuple[tuple[object, tuple], ...]


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Let:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_PARTS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|.()=]))", re.S)


def lex(source: str) -> list[str]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


class Parser:
    """Expressions: or < and < not < comparison < ~ < filter < atom."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.at = words, 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def take(self, *wanted: str) -> str | None:
        if (w := self.peek()) is not None and (not wanted or w in wanted):
            self.at += 1
            return w
        return None

    def need(self, *wanted: str) -> str:
        if (w := self.take(*wanted)) is None:
            raise TemplateError(f"expected {' or '.join(wanted) or 'more'}, got {self.peek()!r}")
        return w

    def whole(self) -> object:
        e = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return e

    def either(self) -> object:
        e = self.both()
        while self.take("or"):
            e = Op("or", (e, self.both()))
        return e

    def both(self) -> object:
        e = self.negated()
        while self.take("and"):
            e = Op("and", (e, self.negated()))
        return e

    def negated(self) -> object:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> object:
        e = self.joined()
        while w := self.take("==", "!="):
            e = Op(w, (e, self.joined()))
        return e

    def joined(self) -> object:
        e = self.filtered()
        while self.take("~"):
            e = Op("~", (e, self.filtered()))
        return e

    def filtered(self) -> object:
        e = self.atom()
        while self.take("|"):
            if (name := self.need()) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = Op("filter", (name, e))
        return e

    def atom(self) -> object:
        w = self.need()
        if w == "(":
            e = self.either()
            self.need(")")
            return e
        if w[0] in "'\"":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), w[1:-1], flags=re.S))
        if w.isdigit():
            return Const(int(w))
        if w in ("true", "false"):
            return Const(w == "true")
        if not re.fullmatch(r"[A-Za-z]\w*", w):
            raise TemplateError(f"unexpected {w!r}")
        path = [w]
        while self.take("."):
            path.append(self.need())
            if path[-1].startswith("_"):
                raise TemplateError("no private names")
        return Name(tuple(path))


def _text(v: object) -> str:
    return "" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


def _apply(kind: str, args: list) -> object:
    if kind == "filter":
        return FILTERS[args[0]](_text(args[1]))
    if kind == "~":
        return _text(args[0]) + _text(args[1])
    if kind == "not":
        return not args[0]
    return {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}[kind](*args)


def fold(e: object) -> object:
    """Constant folding of an expression."""
    if isinstance(e, Op):
        args = [fold(a) if not isinstance(a, str) else a for a in e.args]
        if all(isinstance(a, (Const, str)) for a in args):
            return Const(_apply(e.kind, [a if isinstance(a, str) else a.value for a in args]))
        return Op(e.kind, tuple(args))
    return e


def parse(template: str) -> tuple:
    """The syntax tree of a template, constants folded, neighbouring texts joined."""
    stack: list[tuple[str, list, list]] = [("", [], [])]  # what is open, its nodes, finished cases
    at = 0
    trim = False

    def add(node: object) -> None:
        nodes = stack[-1][1]
        if isinstance(node, Out) and isinstance(node.value, Const):
            text = _text(node.value.value)
            if nodes and isinstance(nodes[-1], Out) and isinstance(nodes[-1].value, Const):
                nodes[-1] = Out(Const(nodes[-1].value.value + text))
            elif text:
                nodes.append(Out(Const(text)))
        else:
            nodes.append(node)

    for m in [*_PARTS.finditer(template), None]:
        text = template[at : m.start() if m else len(template)]
        if trim:
            text = text.lstrip()
        if m and (m[1] or m[4]):
            text = text.rstrip()
        add(Out(Const(text)))
        if m is None:
            break
        at, trim = m.end(), bool(m[3] or m[6])
        if m[2] is not None:
            add(Out(fold(Parser(lex(m[2])).whole())))
        elif m[5] is not None:
            words = lex(m[5])
            p = Parser(words)
            kind = p.need()
            if kind == "for":
                name = p.need()
                p.need("in")
                p.need("messages")
                if any(k == "for" for k, _, _ in stack):
                    raise TemplateError("one loop inside another")
                stack.append((f"for {name}", [], []))
            elif kind == "if":
                stack.append(("if", [], [fold(p.whole())]))
            elif kind in ("elif", "else"):
                if stack[-1][0] != "if":
                    raise TemplateError(f"{kind} outside if")
                _, nodes, cases = stack.pop()
                cases[-1] = (cases[-1], tuple(nodes))
                cases.append(fold(p.whole()) if kind == "elif" else Const(True))
                stack.append(("if", [], cases))
            elif kind == "set":
                name = p.need()
                p.need("=")
                add(Let(name, fold(p.whole())))
            elif kind == "generation":
                stack.append(("generation", [], []))
            elif kind in ("endfor", "endif", "endgeneration"):
                opened, nodes, cases = stack.pop()
                if opened.split(" ")[0] != kind[3:]:
                    raise TemplateError(f"{kind} closes {opened or 'nothing'}")
                if kind == "endfor":
                    add(For(opened[4:], tuple(nodes)))
                elif kind == "endgeneration":
                    add(Generation(tuple(nodes)))
                else:
                    cases[-1] = (cases[-1], tuple(nodes))
                    # cases that can't hold go; one that always holds ends the list
                    kept = []
                    for test, body in cases:
                        if isinstance(test, Const) and not test.value:
                            continue
                        kept.append((test, body))
                        if isinstance(test, Const):
                            break
                    if kept and isinstance(kept[0][0], Const):
                        for node in kept[0][1]:
                            add(node)
                    elif kept:
                        add(If(tuple(kept)))
            else:
                raise TemplateError(f"no statement {kind!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return tuple(stack[0][1])


# ---------------------------------------------------------------- closures


def _value(e: object) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        first, rest = e.path[0], e.path[1:]

        def look(env: dict) -> object:
            v = env.get(first)
            for k in rest:
                v = v.get(k) if isinstance(v, dict) else None
            return v

        return look
    if e.kind in ("and", "or"):
        a, b = map(_value, e.args)
        return (lambda env: a(env) and b(env)) if e.kind == "and" else (lambda env: a(env) or b(env))
    if e.kind == "filter":
        f, a = FILTERS[e.args[0]], _value(e.args[1])
        return lambda env: f(_text(a(env)))
    args = [_value(a) for a in e.args]
    return lambda env: _apply(e.kind, [a(env) for a in args])


Piece = tuple[str, bool]


def _body(nodes: tuple, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_node(n, masked) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for s in steps:
            yield from s(env)

    return run


def _node(n: object, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(n, Out):
        v = _value(n.value)
        return lambda env: iter(((_text(v(env)), masked),))
    if isinstance(n, Generation):
        return _body(n.body, True)
    if isinstance(n, Let):
        v = _value(n.value)

        def put(env: dict) -> Iterator[Piece]:
            env[n.name] = v(env)
            return iter(())

        return put
    if isinstance(n, If):
        cases = [(_value(t), _body(b, masked)) for t, b in n.cases]

        def choose(env: dict) -> Iterator[Piece]:
            for test, body in cases:
                if test(env):
                    return body(env)
            return iter(())

        return choose
    body = _body(n.body, masked)

    def loop(env: dict) -> Iterator[Piece]:
        for k, message in enumerate(env["messages"]):
            env[n.name], env["loop"] = message, {"index": k + 1, "index0": k, "first": k == 0}
            yield from body(env)

    return loop


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (dicts with role and text, consumed one by one) to pieces (text, under the loss mask)."""
    body = _body(parse(template), False)
    return lambda messages, **env: (p for p in body({**env, "messages": messages}) if p[0])


# ---------------------------------------------------------------- conversations


def rows_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: whole conversations in one partition each, turns in order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its messages) one by one; messages have to be consumed before the next."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
    held = next(rows, None)

    def messages(conv: int | None) -> Iterator[dict]:
        nonlocal held
        while held is not None and held[0] == conv:
            message = {"role": held[1], "text": held[2]}
            held = next(rows, None)
            yield message

    while held is not None:
        conv = held[0]
        mine = messages(conv)
        yield conv, mine
        for _ in mine:
            pass


def _format(batches: Iterator[pa.RecordBatch], template: str, piece: int) -> Iterator[pa.RecordBatch]:
    run = compile_template(template)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def out(conv: int | None, part: int, at: int, text: str, spans: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([at], pa.int64()), pa.array([text], pa.string()), pa.array([spans], kind)], names=["conv_id", "part", "offset", "formatted", "loss"])

    for conv, messages in _conversations(batches):
        text, spans, size, offset, part = [], [], 0, 0, 0
        for p, masked in run(messages):
            if masked:
                spans.append({"start": offset + size, "end": offset + size + len(p)})
            text.append(p)
            size += len(p)
            if size >= piece:
                yield out(conv, part, offset, "".join(text), spans)
                text, spans, offset, size, part = [], [], offset + size, 0, part + 1
        if text or not part:
            yield out(conv, part, offset, "".join(text), spans)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, piece: int = 1 << 20) -> DataFrame:
    """conv_id, part, offset, formatted, loss: the formatted conversations, and the spans under the loss mask (offsets in the conversation).

    A conversation is one row; one of over ``piece`` characters goes on in rows of further parts.
    """
    ship(conversations.sparkSession)
    parse(template)
    return rows_in_order(conversations).mapInArrow(lambda it: _format(it, template, piece), "conv_id long, part long, offset long, formatted string, loss array<struct<start:bigint,end:bigint>>")


class Reader:
    """Reads formatted text back, fed in parts of any size."""

    _CONTROL = re.compile(r"\\.|<turn>|</turn>\n", re.S)

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.turn_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.rest = ""

    def feed(self, text: str) -> None:
        self.chars += len(text)
        self.rest += text
        at = done = 0
        while m := self._CONTROL.search(self.rest, at):
            at = m.end()
            if m[0] == CLOSE_LINE:
                role, body = self._split(self.rest[done + len(OPEN) : m.start()])
                self.turn_sha.update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                self.turns += 1
                done = at
        self.rest = self.rest[done:]

    @staticmethod
    def _split(turn: str) -> tuple[str, str]:
        m = re.compile(r"(?:\\.|[^\\\n])*", re.S).match(turn)
        return turn[: m.end()], turn[m.end() + 1 :]

    def loss(self, text: str) -> None:
        raw = unescape(text)
        self.loss_chars += len(raw)
        self.loss_sha.update(raw.encode("utf-8", "surrogatepass"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of formatted conversations; rows come in order of (conv_id, part)."""
    reader, now, started = Reader(), None, False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([reader.turns], pa.int64()), pa.array([reader.turn_sha.hexdigest()]), pa.array([reader.loss_chars], pa.int64()), pa.array([reader.loss_sha.hexdigest()]), pa.array([reader.chars], pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        for conv, part, offset, text, loss in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if part == 0:
                if started:
                    yield out()
                reader, now, started = Reader(), conv, True
            for s in loss:
                reader.loss(text[s["start"] - offset : s["end"] - offset])
            reader.feed(text)
    if started:
        yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the output of ``format_conversations`` alone.

    Parts of a conversation follow each other in a partition as they were made, which this keeps.
    """
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
