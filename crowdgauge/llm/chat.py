"""Chat formatting: a compiler for a small, closed template language, and its use on conversations.

The language has text, ``{{ expression }}``, ``{% for x in messages %}``, ``{% if %} / {% elif %} / {% else %}``,
``{% set %}`` and ``{% generation %}``. Expressions are literals, names, attributes of a message or of ``loop``
(``first``, ``last``, ``index``, ``index0``), ``+``, comparisons, ``and / or / not``, ``in``, and the filters of FILTERS. There
are no calls, no subscripts and no other attributes, so a template can't reach Python. A template is parsed
to a tree, constant parts are folded, and each node becomes a Python closure that yields pieces of text and
whether a model is to learn them.

The loop asks for one message at a time, so a conversation is rendered as its rows stream by in turn order:
memory holds one message, however long the conversation is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of

TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[().|+]))")
STATEMENT = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}|\{#.*?#\}", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

# Turns are marked by a header and an end; ``escaped`` keeps texts from holding either.
TURN_END = "</turn>"
TEMPLATE = """{% for message in messages %}{% if message.role == 'user' %}### User: {{ message.text | escaped }}{% elif message.role == 'assistant' %}\
### Assistant: {% generation %}{{ message.text | escaped }}{% endgeneration %}{% elif message.role == 'system' %}\
### System: {{ message.text | escaped }}{% else %}### Role {{ message.role | escaped }}: {{ message.text | escaped }}{% endif %}</turn>
{% endfor %}"""


class TemplateError(ValueError):
    """A template that isn't in the language."""


def escaped(s: str) -> str:
    """Reversible: a backslash stands before every backslash, angle bracket, number sign and colon."""
    return re.sub(r"([\\<#:])", r"\\\1", s)


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {
    "escaped": escaped, "trim": str.strip, "upper": str.upper, "lower": str.lower, "capitalize": str.capitalize}
FIELDS = {"message": ("role", "text", "turn"), "loop": ("first", "last", "index", "index0")}

Piece = tuple[str, bool]
Expr = Callable[[dict], object]


@dataclass(frozen=True)
class Node:
    """A tree node: ``kind`` and its parts."""

    kind: str
    parts: tuple = ()


class ExpressionParser:
    """Recursive descent over one expression; the result is a tree of Nodes."""

    def __init__(self, source: str):
        self.items, at = [], 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if value is not None and item[1] != value or item[0] == "end":
            raise TemplateError(f"expected {value or 'more'}, found {item[1]!r}")
        self.at += 1
        return item

    def whole(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def chain(self, word: str, below: Callable[[], Node]) -> Node:
        parts = [below()]
        while self.peek() == ("name", word):
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(word, tuple(parts))

    def either(self) -> Node:
        return self.chain("or", lambda: self.chain("and", self.negated))

    def negated(self) -> Node:
        if self.peek() == ("name", "not"):
            self.take()
            return Node("not", (self.negated(),))
        left = self.added()
        kind, value = self.peek()
        if value in ("==", "!=") or (kind, value) == ("name", "in"):
            self.take()
            return Node(value, (left, self.added()))
        return left

    def added(self) -> Node:
        node = self.filtered()
        while self.peek()[1] == "+":
            self.take()
            node = Node("+", (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek()[1] == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", (name, node))
        return node

    def atom(self) -> Node:
        kind, value = self.take()
        if value == "(":
            node = self.either()
            self.take(")")
            return node
        if kind == "str":
            return Node("const", (re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S),))
        if kind == "num":
            return Node("const", (int(value),))
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false", "none"):
            return Node("const", ({"true": True, "false": False, "none": None}[value],))
        if self.peek()[1] == ".":
            self.take()
            return Node("field", (value, self.take()[1]))
        return Node("name", (value,))


def parse(source: str) -> list[Node]:
    """The tree of a template; raises TemplateError for anything outside the language."""
    stack: list[tuple[str, list]] = [("top", [])]

    def text(s: str) -> None:
        if s:
            stack[-1][1].append(Node("text", (s,)))

    def close(*kinds: str) -> list:
        kind, body = stack.pop() if len(stack) > 1 else ("top", [])
        if kind not in kinds:
            raise TemplateError(f"nothing open to close here but {kind!r}")
        return body

    at = 0
    for m in STATEMENT.finditer(source):
        text(source[at:m.start()])
        at = m.end()
        if m[2] is not None:
            stack[-1][1].append(Node("out", (ExpressionParser(m[2]).whole(),)))
        elif m[1] is not None:
            word, _, rest = m[1].partition(" ")
            if word == "for":
                got = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if not got or got[1] in ("loop", "messages") or any(k.startswith("for ") for k, _ in stack):
                    raise TemplateError(f"not a loop over messages: {rest!r}")
                stack.append((f"for {got[1]}", []))
            elif word == "if":
                stack.append(("if", [[ExpressionParser(rest).whole(), []]]))
                stack.append(("branch", stack[-1][1][-1][1]))
            elif word in ("elif", "else"):
                close("branch")
                stack[-1][1].append([ExpressionParser(rest).whole() if word == "elif" else Node("const", (True,)), []])
                stack.append(("branch", stack[-1][1][-1][1]))
            elif word == "endif":
                close("branch")
                branches = close("if")
                stack[-1][1].append(Node("if", tuple((c, tuple(b)) for c, b in branches)))
            elif word == "generation":
                if any(k == "generation" for k, _ in stack):
                    raise TemplateError("generation inside generation")
                stack.append(("generation", []))
            elif word == "endgeneration":
                body = close("generation")
                stack[-1][1].append(Node("generation", (tuple(body),)))
            elif word == "endfor":
                kind = stack[-1][0]
                body = close(kind if kind.startswith("for ") else "for")
                stack[-1][1].append(Node("for", (kind[4:], tuple(body))))
            elif word == "set":
                got = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.*)", rest, re.S)
                if not got or got[1] in ("loop", "messages"):
                    raise TemplateError(f"not an assignment: {rest!r}")
                stack[-1][1].append(Node("set", (got[1], ExpressionParser(got[2]).whole())))
            else:
                raise TemplateError(f"no statement {word!r}")
    text(source[at:])
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is never closed")
    return stack[0][1]


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: shown(a) in shown(b), "not": lambda a: not a,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else shown(a) + shown(b)}


def shown(v: object) -> str:
    return "" if v is None else str(v)


def folded(node: Node) -> Node:
    """Expressions of constants become constants; branches that can't be taken go; texts side by side join."""
    if node.kind in ("text", "const", "name", "field"):
        return node
    if node.kind == "if":
        left: list[tuple] = []
        for condition, body in ((folded(c), folded_body(b)) for c, b in node.parts):
            if condition.kind == "const" and not condition.parts[0]:
                continue
            left.append((condition, body))
            if condition.kind == "const":
                break
        if not left:
            return Node("text", ("",))
        return Node("body", left[0][1]) if left[0][0].kind == "const" else Node("if", tuple(left))
    if node.kind in ("for", "set"):
        inner = node.parts[1]
        return Node(node.kind, (node.parts[0], folded_body(inner) if node.kind == "for" else folded(inner)))
    if node.kind == "generation":
        return Node("generation", (folded_body(node.parts[0]),))
    if node.kind == "filter":
        inner = folded(node.parts[1])
        return Node("const", (FILTERS[node.parts[0]](shown(inner.parts[0])),)) if inner.kind == "const" else Node("filter", (node.parts[0], inner))
    parts = tuple(map(folded, node.parts))
    if node.kind == "out":
        return Node("text", (shown(parts[0].parts[0]),)) if parts[0].kind == "const" else Node("out", parts)
    if all(p.kind == "const" for p in parts):
        values = [p.parts[0] for p in parts]
        if node.kind in ("and", "or"):
            return Node("const", ((all if node.kind == "and" else any)(values),))
        return Node("const", (OPERATIONS[node.kind](*values),))
    return Node(node.kind, parts)


def folded_body(body: tuple | list) -> tuple:
    out: list[Node] = []
    for node in map(folded, body):
        for n in node.parts if node.kind == "body" else (node,):
            if n.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", (out[-1].parts[0] + n.parts[0],))
            elif n != Node("text", ("",)):
                out.append(n)
    return tuple(out)


def expression(node: Node, loop_name: str) -> Expr:
    """A closure that gives the value of an expression."""
    if node.kind == "const":
        value = node.parts[0]
        return lambda env: value
    if node.kind == "name":
        name = node.parts[0]
        if name in ("messages", "loop", loop_name):
            raise TemplateError(f"{name!r} has no value of its own")
        return lambda env: env.get(name)
    if node.kind == "field":
        owner, name = node.parts
        fields = FIELDS["loop"] if owner == "loop" else FIELDS["message"] if owner == loop_name else ()
        if name not in fields:
            raise TemplateError(f"no field {owner}.{name}")
        return lambda env: env[owner].get(name)
    if node.kind == "filter":
        apply, inner = FILTERS[node.parts[0]], expression(node.parts[1], loop_name)
        return lambda env: apply(shown(inner(env)))
    parts = [expression(p, loop_name) for p in node.parts]
    if node.kind == "and":
        return lambda env: all(p(env) for p in parts)
    if node.kind == "or":
        return lambda env: any(p(env) for p in parts)
    apply = OPERATIONS[node.kind]
    return lambda env: apply(*(p(env) for p in parts))


def looped(messages: Iterator[dict]) -> Iterator[tuple[dict, dict]]:
    """Each message with its ``loop``; looks one message ahead."""
    index, ahead = 0, next(messages, None)
    while ahead is not None:
        message, ahead = ahead, next(messages, None)
        yield message, {"first": index == 0, "last": ahead is None, "index": index + 1, "index0": index}
        index += 1


def body_of(nodes: tuple, loop_name: str = "", learn: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """A closure that yields the pieces of a list of nodes."""
    made = [closure(n, loop_name, learn) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for f in made:
            yield from f(env)

    return run


def closure(node: Node, loop_name: str, learn: bool) -> Callable[[dict], Iterator[Piece]]:
    if node.kind == "text":
        piece = (node.parts[0], learn)
        return lambda env: iter((piece,))
    if node.kind == "out":
        value = expression(node.parts[0], loop_name)
        return lambda env: iter(((shown(value(env)), learn),))
    if node.kind == "set":
        name, value = node.parts[0], expression(node.parts[1], loop_name)

        def assign(env: dict) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

        return assign
    if node.kind == "generation":
        return body_of(node.parts[0], loop_name, True)
    if node.kind == "if":
        branches = [(expression(c, loop_name), body_of(b, loop_name, learn)) for c, b in node.parts]

        def choose(env: dict) -> Iterator[Piece]:
            return next((body(env) for condition, body in branches if condition(env)), iter(()))

        return choose
    name, body = node.parts[0], body_of(node.parts[1], node.parts[0], learn)

    def loop(env: dict) -> Iterator[Piece]:
        for message, place in looped(env["messages"]):
            env[name], env["loop"] = message, place
            yield from body(env)

    return loop


def compiled(source: str) -> Callable[[Iterator[dict]], Iterator[Piece]]:
    """A function from a stream of messages ({role, text, turn}) to a stream of (text, is learnt) pieces."""
    run = body_of(folded_body(parse(source)))
    return lambda messages: run({"messages": iter(messages)})


def conversations_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, its messages) from batches sorted by conversation and turn; each stream must be used up
    before the next is asked for."""
    rows = ({"conv_id": c, "turn": t, "role": r, "text": x} for b in batches for c, t, r, x in zip(*(v.to_pylist() for v in b.columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        current = ahead["conv_id"]

        def messages() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead["conv_id"] == current:
                yield ahead
                ahead = next(rows, None)

        stream = messages()
        yield current, stream
        for _ in stream:
            pass


def formatted(conversations: DataFrame, template: str = TEMPLATE, piece_chars: int = 1_000_000) -> DataFrame:
    """(conv_id, part, text, learn): the formatted conversations as pieces in order, those a model is to learn
    marked. Pieces of one kind are joined up to ``piece_chars`` characters.

    Messages are taken by turn; equal turns by role and text; null turns first. Null roles and texts are
    empty. Repeated rows are messages of their own. Rows with a null conv_id form one conversation. Other
    columns are not read; an empty table gives no rows."""
    compiled(template)  # a wrong template fails here, not in a task
    schema = arrow_schema("conv_id long, part long, text string, learn boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows, size = compiled(template), [], 0
        for conv_id, messages in conversations_in_order(batches):
            part, held, chars, kind = 0, [], 0, None
            for text, learn in render(messages):
                if kind is not None and (learn != kind or chars >= piece_chars):
                    rows.append((conv_id, part, "".join(held), kind))
                    part, held, chars = part + 1, [], 0
                held.append(text)
                kind, chars, size = learn, chars + len(text), size + len(text)
                if size > 4_000_000 and rows:
                    yield batch_of(schema, list(zip(*rows, strict=True)))
                    rows, size = [], 0
            if kind is not None:
                rows.append((conv_id, part, "".join(held), kind))
        if rows:
            yield batch_of(schema, list(zip(*rows, strict=True)))

    ordered = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, part long, text string, learn boolean")


HEADER = re.compile(r"### (?:(User|Assistant|System): |Role ((?:\\.|[^\\:])*): )", re.S)
TURN = re.compile(r"((?:\\.|[^\\<])*)</turn>\n", re.S)


def turns_of(text: str) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of every whole turn at the start of ``text``, and what is left after them."""
    turns, at = [], 0
    while m := HEADER.match(text, at):
        end = TURN.match(text, m.end())
        if not end:
            break
        turns.append((m[1].lower() if m[1] else unescaped(m[2]), unescaped(end[1])))
        at = end.end()
    return turns, text[at:]


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from ``formatted`` pieces of TEMPLATE.

    Digests are fed turn by turn. A conversation that does not read as whole turns is an error."""
    schema = arrow_schema(ddl := "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        from itertools import groupby

        rows = (r for b in batches for r in zip(*(v.to_pylist() for v in b.columns), strict=True))
        out = []
        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            turns, loss, n, chars, learnt, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            cut = ""
            for _, _, text, learn in group:
                chars += len(text)
                if learn:
                    cut += text
                    whole = cut if not re.search(r"(?<!\\)(?:\\\\)*\\$", cut) else cut[:-1]
                    said = unescaped(whole)
                    learnt, cut = learnt + len(said), cut[len(whole):]
                    loss.update(said.encode())
                found, rest = turns_of(rest + text)
                for role, said in found:
                    turns.update(f"{role}\n{said}\n".encode())
                n += len(found)
            if rest:
                raise ValueError(f"conversation {conv_id} does not read as whole turns")
            out.append((conv_id, n, turns.hexdigest(), learnt, loss.hexdigest(), chars))
            if len(out) >= 5_000:
                yield batch_of(schema, list(zip(*out, strict=True)))
                out = []
        if out:
            yield batch_of(schema, list(zip(*out, strict=True)))

    ordered = pieces.select("conv_id", "part", "text", "learn").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, ddl)
