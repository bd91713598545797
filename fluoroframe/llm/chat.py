"""Chat formatting with a compiled, sandboxed template language.

A template is text with ``{{ expression }}`` and ``{% statement %}`` parts:

* statements: ``for x in e`` / ``endfor``, ``if e`` / ``elif e`` / ``else`` / ``endif``, ``set x = e``,
  ``generation`` / ``endgeneration`` (the text between is under the loss mask);
* expressions: names, ``x.field``, ``x['field']``, strings, integers, ``true`` / ``false`` / ``none``, ``+``, ``~``,
  comparisons, ``in``, ``and`` / ``or`` / ``not``, brackets, and filters ``e | trim``, ``upper``, ``lower``, ``length``, ``escape``, ``line``.

Fields are looked up in mappings only, and there are no calls, so a template cannot
reach Python objects.  The parser builds a syntax tree, constant parts of it are
folded, and each node becomes one Python closure that writes to a sink.  Loops take
any iterator and look one item ahead, so a conversation is never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fluoroframe.llm.common import filled, worker_memo

# Strings that steer a model and therefore may not stand in a text.
CONTROLS = (
    "<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>", "<pad>",
)
TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>{% endfor %}"
)
#: Characters of a conversation that one output row may gather before the next turn opens another row.
CHUNK_CHARS = 1 << 18

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""Doubles backslashes and parts control strings with one."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


FILTERS: dict[str, Callable] = {
    "trim": lambda v: str(v).strip(), "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "length": len, "escape": lambda v: escape(_text(v)),
    "line": lambda v: escape(_text(v)).replace("\n", "\\\n"),  # also keeps line ends from ending the line
}


class TemplateError(ValueError):
    """A template that the language does not allow."""


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# Expressions: ("const", v) | ("name", n) | ("field", e, k) | ("op", symbol, e, ...) | ("filter", name, e)

_TOKENS = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~<>().|\[\]=]))")
_ENDS = {"\\n": "\n", "\\t": "\t", "\\r": "\r"}


class _Parser:
    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"cannot read {self.tokens[self.at][1]!r} here")
        return tree

    def _left(self, below: Callable, *signs: str) -> tuple:
        tree = below()
        while sign := self.take(*signs):
            tree = ("op", sign, tree, below())
        return tree

    def either(self) -> tuple:
        return self._left(self.both, "or")

    def both(self) -> tuple:
        return self._left(self.negated, "and")

    def negated(self) -> tuple:
        return ("op", "not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        return self._left(self.added, "==", "!=", "<=", ">=", "<", ">", "in")

    def added(self) -> tuple:
        return self._left(self.filtered, "+", "~")

    def filtered(self) -> tuple:
        tree = self.fields()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def fields(self) -> tuple:
        tree = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                tree = ("field", tree, ("const", self.word()))
            else:
                tree = ("field", tree, self.either())
                self.need("]")
        return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ENDS.get(m[0], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value.lower()]) if value.lower() in fixed else ("name", value)
        raise TemplateError(f"cannot read {value!r} here")


_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not": lambda a: not a,
}


def _fold(tree: tuple) -> tuple:
    """Constant parts of an expression worked out."""
    if tree[0] in ("const", "name"):
        return tree
    if tree[0] == "field":
        return ("field", _fold(tree[1]), _fold(tree[2]))
    args = [_fold(t) for t in tree[2:]]
    fixed = all(a[0] == "const" for a in args)
    if tree[0] == "filter":
        return ("const", FILTERS[tree[1]](args[0][1])) if fixed else ("filter", tree[1], *args)
    if tree[1] in ("and", "or"):
        if args[0][0] == "const":
            return args[1] if bool(args[0][1]) == (tree[1] == "and") else args[0]
        return ("op", tree[1], *args)
    return ("const", _OPS[tree[1]](*[a[1] for a in args])) if fixed else ("op", tree[1], *args)


def _closure(tree: tuple) -> Callable[[dict], object]:
    if tree[0] == "const":
        value = tree[1]
        return lambda scope: value
    if tree[0] == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if tree[0] == "field":
        inner, key = _closure(tree[1]), _closure(tree[2])

        def field(scope: dict) -> object:
            holder = inner(scope)
            return holder.get(key(scope)) if isinstance(holder, dict) else None

        return field
    args = [_closure(t) for t in tree[2:]]
    if tree[0] == "filter":
        call, (one,) = FILTERS[tree[1]], args
        return lambda scope: call(one(scope))
    if tree[1] == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if tree[1] == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    call = _OPS[tree[1]]
    if len(args) == 1:
        return lambda scope: call(args[0](scope))
    return lambda scope: call(args[0](scope), args[1](scope))


# Statements: ("text", s) | ("print", e) | ("set", n, e) | ("for", n, e, body) | ("if", [(e, body), ...]) | ("mask", body)

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def parse(source: str) -> list[tuple]:
    """Syntax tree of a template, constants folded and neighbouring texts joined."""
    root: list[tuple] = []
    stack: list[tuple[str, list, list]] = [("", root, [])]
    at = 0

    def add(node: tuple) -> None:
        body = stack[-1][1]
        if node[0] == "print" and node[1][0] == "const":
            node = ("text", _text(node[1][1]))
        if node[0] == "text" and body and body[-1][0] == "text":
            body[-1] = ("text", body[-1][1] + node[1])
        elif node != ("text", ""):
            body.append(node)

    def close(kind: str) -> tuple[str, list, list]:
        if stack[-1][0] != kind:
            raise TemplateError(f"no open {kind!r} here")
        return stack.pop()

    for part in _PARTS.finditer(source):
        add(("text", source[at : part.start()]))
        at = part.end()
        if part[1] is not None:
            add(("print", _fold(_Parser(part[1]).whole())))
            continue
        word, _, rest = part[2].strip().partition(" ")
        if word == "for":
            p = _Parser(rest)
            name = p.word()
            p.need("in")
            stack.append(("for", [], [name, _fold(p.whole())]))
        elif word == "if":
            stack.append(("if", [], [[], _fold(_Parser(rest).whole())]))
        elif word in ("elif", "else"):
            _, body, (arms, test) = close("if")
            stack.append(("if", [], [[*arms, (test, body)], _fold(_Parser(rest).whole()) if word == "elif" else ("const", True)]))
        elif word == "generation":
            stack.append(("generation", [], []))
        elif word == "set":
            p = _Parser(rest)
            name = p.word()
            p.need("=")
            add(("set", name, _fold(p.whole())))
        elif word == "endfor":
            _, body, (name, over) = close("for")
            add(("for", name, over, body))
        elif word == "endif":
            _, body, (arms, test) = close("if")
            kept = []
            for test, body in [*arms, (test, body)]:
                if test[0] != "const" or test[1]:
                    kept.append((test, body))
                if test[0] == "const" and test[1]:
                    break
            if kept and kept[0][0][0] == "const":
                for node in kept[0][1]:
                    add(node)
            elif kept:
                add(("if", kept))
        elif word == "endgeneration":
            add(("mask", close("generation")[1]))
        else:
            raise TemplateError(f"no statement {word!r}")
    add(("text", source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    return root


Sink = Callable[[str, bool], None]


def _block(nodes: list[tuple]) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [_statement(n) for n in nodes]

    def run(scope: dict, masked: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope, masked)

    return run


def _statement(node: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, masked: ((text, masked),)
    if kind == "print":
        value = _closure(node[1])
        return lambda scope, masked: ((_text(value(scope)), masked),)
    if kind == "set":
        name, value = node[1], _closure(node[2])

        def assign(scope: dict, masked: bool) -> tuple:
            scope[name] = value(scope)
            return ()

        return assign
    if kind == "mask":
        inside = _block(node[1])
        return lambda scope, masked: inside(scope, True)
    if kind == "if":
        arms = [(_closure(test), _block(body)) for test, body in node[1]]

        def choose(scope: dict, masked: bool) -> Iterable:
            return next((body(scope, masked) for test, body in arms if test(scope)), ())

        return choose
    name, over, body = node[1], _closure(node[2]), _block(node[3])

    def loop(scope: dict, masked: bool) -> Iterator[tuple[str, bool]]:
        items = iter(over(scope) or ())
        nothing = object()
        item, index, outer = next(items, nothing), 0, scope.get("loop")
        while item is not nothing:
            after = next(items, nothing)
            scope[name] = item
            scope["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": after is nothing}
            yield from body(scope, masked)
            item, index = after, index + 1
        scope["loop"] = outer

    return loop


def compile_template(source: str = TEMPLATE) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A renderer: values by name -> pieces of text, each with whether it is under the loss mask."""
    run = _block(parse(source))
    return lambda values: run(dict(values), False)


def _conversations(batches: Iterator[pd.DataFrame], key: str, columns: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Groups of neighbouring rows with one key, across batches; each group is read before the next."""
    from itertools import groupby

    rows = chain.from_iterable(zip(f[key], *[f[c] for c in columns]) for f in batches)
    for k, group in groupby(rows, key=lambda r: None if pd.isna(r[0]) else r[0]):
        yield k, (r[1:] for r in group)


FORMATTED = "conv_id long, part long, start long, n_turns long, formatted string, masks array<struct<start:long,end:long>>"


def format_conversations(
    turns: DataFrame, template: str = TEMPLATE, id_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """Formatted conversations in rows of at most about CHUNK_CHARS characters: ``conv_id``, ``part``, ``start`` (its
    place in the conversation), ``n_turns``, ``formatted`` and ``masks`` (spans under the loss mask within the part).

    Rows count by turn, then role and text; null ids form one conversation, a null turn comes first, null roles and
    texts are empty, repeated rows stay.  Other columns are left behind.  A conversation is streamed through one task
    in its order, a turn at a time, so its length is bounded by time only, not by memory.
    """
    parse(template)  # an error belongs to the caller, not to a task
    rows = turns.select(
        F.col(f"`{id_column}`").cast("long").alias("conv_id"), F.col(f"`{turn_column}`").cast("long").alias("turn"),
        filled(role_column).alias("role"), filled(text_column).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = worker_memo(("chat", template), lambda: compile_template(template))
        out: list[tuple] = []
        for key, group in _conversations(batches, "conv_id", ["role", "text"]):
            begun = [0]

            def messages(group=group, begun=begun) -> Iterator[dict]:
                for role, text in group:
                    begun[0] += 1
                    yield {"role": role, "text": text}

            part = start = size = seen = 0
            pieces, masks, opened = [], [], None
            for piece, masked in run({"messages": messages()}):
                if masked and opened is None:
                    opened = size
                elif not masked and opened is not None:
                    masks.append({"start": opened, "end": size})
                    opened = None
                pieces.append(piece)
                size += len(piece)
                # a loop has read one message ahead, so begun - 1 turns are complete or running
                if size >= CHUNK_CHARS and opened is None and begun[0] - 1 > seen and piece.endswith("<|end|>"):
                    out.append((key, part, start, begun[0] - 1 - seen, "".join(pieces), masks))
                    yield _rows(out)
                    seen, out = begun[0] - 1, []
                    part, start, size, pieces, masks = part + 1, start + size, 0, [], []
            if opened is not None:
                masks.append({"start": opened, "end": size})
            for _ in group:  # turns that the template did not ask for
                pass
            out.append((key, part, start, begun[0] - seen, "".join(pieces), masks))
            if len(out) >= 256:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return ordered.mapInPandas(render, FORMATTED)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "part", "start", "n_turns", "formatted", "masks"])
    frame["conv_id"] = pd.array([r[0] if r[0] is None else int(r[0]) for r in rows], dtype="Int64")
    return frame


_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|end\|>", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a part formatted with TEMPLATE."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the rows of ``format_conversations`` in their order: ``n_turns``,
    ``turns_sha256``, ``loss_chars``, ``loss_sha256`` and ``formatted_chars``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, parts in _conversations(batches, "conv_id", ["formatted", "masks"]):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for text, masks in parts:
                chars += len(text)
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in masks:
                    under = unescape(text[span["start"] : span["end"]])
                    loss.update(under.encode("utf-8", "surrogatepass"))
                    loss_chars += len(under)
            out.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 1024:
                yield _digest_rows(out)
                out = []
        if out:
            yield _digest_rows(out)

    return formatted.mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digest_rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    frame["conv_id"] = pd.array([r[0] if r[0] is None else int(r[0]) for r in rows], dtype="Int64")
    return frame
