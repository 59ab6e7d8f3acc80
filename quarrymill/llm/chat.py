"""Chat formatting: a compiler for a small sandboxed template language.

`compile_template` parses a template into a syntax tree, folds constants and turns the tree into Python
closures. A compiled template renders a stream of (text, generated) pieces, where `generated` marks what
stands between {% generation %} and {% endgeneration %}: the loss mask. The language has literals, names,
`a.b` and `a['b']` on dictionaries, `a[0]` on lists, + - * / // % ~, comparisons, in, is (not) defined, none, string,
number, and or not, conditional expressions, filters (trim, upper, lower, length, default, tojson and the caller's), for
with loop.index, index0, first and last, if/elif/else, set, generation, and white space control by `{%-` and `-%}`. A set in
a loop ends with its turn. Nothing else can be reached from a template: no Python attributes, calls or imports. What the
language doesn't have is a TemplateError when a template is compiled, not an empty text when it is rendered: calls,
slices, other tags, tests and fields of loop, and any use of `messages` but as what a for runs over, because messages are
a stream of turns. Values of unlike kinds are unequal, and neither is less than, nor in, the other.

`format_conversations` sorts the rows of a conversation by turn and renders them as a stream, one turn at a
time, so a conversation of any length needs the memory of one turn. Cases: null text is empty, null role is
an empty role, null turns come first, equal turns are ordered by role and then text, repeated rows are
repeated turns, rows with a null conv_id form one conversation. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pieces = Iterator[tuple[str, bool]]


class TemplateError(ValueError):
    """The template isn't in the language."""


# ---- syntax tree: tuples (kind, ...) ---------------------------------------------------------------

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>().\[\]|,]))", re.S)
_WORDS = {"and", "or", "not", "in", "is", "if", "else"}
STREAMS = {"messages"}
_LOOP_FIELDS = {"index", "index0", "first", "last"}
_TESTS: dict[str, Callable] = {"none": lambda v: v is None, "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool)}
_CONSTANTS = {"true": True, "false": False, "none": None}
_SLASHES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, wanted: str | None = None) -> str:
        if self.at >= len(self.tokens) or wanted and self.peek() != wanted:
            raise TemplateError(f"expected {wanted or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        value = self.either()
        if self.peek() == "if":
            self.take()
            test = self.either()
            self.take("else")
            value = ("cond", test, value, self.whole())
        return value

    def either(self):
        value = self.both()
        while self.peek() == "or":
            self.take()
            value = ("or", value, self.both())
        return value

    def both(self):
        value = self.negated()
        while self.peek() == "and":
            self.take()
            value = ("and", value, self.negated())
        return value

    def negated(self):
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self):
        value = self.summed()
        while (sign := self.peek()) in ("==", "!=", "<", "<=", ">", ">=", "in", "not", "is"):
            self.take()
            if sign == "is":
                turned = self.peek() == "not" and bool(self.take())
                name = self.take()
                if name == "defined":
                    if value[0] not in ("name", "get"):
                        raise TemplateError("only names and fields can be tested for being defined")
                    test = ("defined", value)
                elif name in _TESTS:
                    test = ("test", name, value)
                else:
                    raise TemplateError(f"unknown test {name!r}")
                value = ("not", test) if turned else test
            elif sign == "not":
                self.take("in")
                value = ("not", ("in", value, self.summed()))
            else:
                value = (sign, value, self.summed())
        return value

    def summed(self):
        value = self.multiplied()
        while self.peek() in ("+", "-", "~"):
            value = (self.take(), value, self.multiplied())
        return value

    def multiplied(self):
        value = self.signed()
        while self.peek() in ("*", "/", "//", "%"):
            value = (self.take(), value, self.signed())
        return value

    def signed(self):
        if self.peek() == "-":
            self.take()
            return ("-", ("const", 0), self.signed())
        return self.filtered()

    def filtered(self):
        value = self.reached()
        while self.peek() == "|":
            self.take()
            name, given = self.take(), None
            if self.peek() == "(":
                self.take()
                given = self.whole()
                self.take(")")
            if (given is not None) != (name == "default"):
                raise TemplateError(f"filter {name!r} {'takes a value' if given is None else 'takes no value'}")
            value = ("default", value, given) if name == "default" else ("filter", name, value)
        return value

    def reached(self):
        value = self.atom()
        while self.peek() in (".", "["):
            if self.take() == ".":
                value = ("get", value, ("const", self.take()))
            else:
                value = ("get", value, self.whole())
                self.take("]")
            if value[1] == ("name", "loop") and (value[2][0] != "const" or value[2][1] not in _LOOP_FIELDS):
                raise TemplateError(f"unknown field of loop: {value[2]!r}")
        return value

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _SLASHES.get(m[1], m[1]), token[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(token))
        if kind == "name" and token not in _WORDS:
            return ("const", _CONSTANTS[token]) if token in _CONSTANTS else ("name", token)
        if token == "(":
            value = self.whole()
            self.take(")")
            return value
        raise TemplateError(f"unexpected {token!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts = _TAG.split(source)
    for i in range(1, len(parts), 2):  # text stands at even places
        if parts[i][2] == "-" and parts[i][1] != "#":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-" and parts[i][1] != "#" and len(parts[i]) > 5:
            parts[i + 1] = parts[i + 1].lstrip()
    at = 0

    def expression(text: str) -> tuple:
        e = _Expression(text)
        value = e.whole()
        e.done()
        return value

    def body(until: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal at
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if at % 2:  # text stands at even places
                if part:
                    out.append(("text", part))
                continue
            inner = part[2:-2].strip("-").strip()
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                out.append(("print", expression(inner)))
                continue
            word, _, rest = inner.partition(" ")
            if word in until:
                return ("block", tuple(out)), inner
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad for: {rest!r}")
                if m[1] in _WORDS | STREAMS | {"loop"}:
                    raise TemplateError(f"bad for: {rest!r}")
                inside, _ = body(("endfor",))
                out.append(("for", m[1], expression(m[2]), inside))
            elif word == "if":
                branches, test, ended = [], expression(rest), ""
                while ended != "endif":
                    inside, ended = body(("elif", "else", "endif") if test is not None else ("endif",))
                    branches.append((test, inside))
                    test = expression(ended[5:]) if ended.startswith("elif ") else None
                out.append(("if", tuple(branches)))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest.strip(), re.S)
                if not m or m[1] in STREAMS | {"loop"}:
                    raise TemplateError(f"bad set: {rest!r}")
                out.append(("set", m[1], expression(m[2])))
            elif word == "generation":
                inside, _ = body(("endgeneration",))
                out.append(("generation", inside))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if until:
            raise TemplateError(f"missing {until[-1]}")
        return ("block", tuple(out)), ""

    return body(())[0]


# ---- constant folding ------------------------------------------------------------------------------

def _plus(a, b):
    return a + b if _number(a) and _number(b) else _text(a) + _text(b)


def _number(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _arithmetic(run: Callable) -> Callable:
    def apply(a, b):
        if not (_number(a) and _number(b)):
            raise TemplateError(f"no arithmetic on {a!r} and {b!r}")
        if b == 0 and run in (_divide, _whole, _rest):
            raise TemplateError("division by zero")
        return run(a, b)

    return apply


def _divide(a, b):
    return a / b


def _whole(a, b):
    return a // b


def _rest(a, b):
    return a % b


def _ordered(run: Callable) -> Callable:
    return lambda a, b: (_number(a) and _number(b) or isinstance(a, str) and isinstance(b, str)) and run(a, b)


def _within(a, b) -> bool:
    return isinstance(a, str) and a in b if isinstance(b, str) else a in b if isinstance(b, list | tuple | dict) and not isinstance(a, list | dict) else False


_OPERATORS: dict[str, Callable] = {
    "+": _plus,
    "~": lambda a, b: _text(a) + _text(b),
    "-": _arithmetic(lambda a, b: a - b),
    "*": _arithmetic(lambda a, b: a * b),
    "/": _arithmetic(_divide),
    "//": _arithmetic(_whole),
    "%": _arithmetic(_rest),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "in": _within,
}
_ABSENT = object()


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def checked(tree: tuple, streamed: bool = False) -> None:
    """Raise where a stream is used as anything but what a for runs over."""
    if tree[0] == "name" and tree[1] in STREAMS and not streamed:
        raise TemplateError(f"{tree[1]} is a stream: only a for can run over it")
    if tree[0] == "const":
        return
    if tree[0] == "if":
        for test, inside in tree[1]:
            if test is not None:
                checked(test)
            checked(inside)
        return
    for k, part in enumerate(tree[1:]):
        if isinstance(part, tuple) and part and isinstance(part[0], str):
            checked(part, tree[0] == "for" and k == 1)
        elif isinstance(part, tuple):
            for x in part:
                checked(x)


def _uses(tree, wanted: tuple) -> bool:
    return tree == wanted or isinstance(tree, tuple) and any(_uses(t, wanted) for t in tree)


def fold(tree: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constant expressions evaluated, constant branches chosen and adjoining texts joined."""
    kind = tree[0]
    if kind in ("const", "name", "text"):
        return tree
    if kind in _OPERATORS:
        a, b = fold(tree[1], filters), fold(tree[2], filters)
        return ("const", _OPERATORS[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind in ("and", "or"):
        a, b = fold(tree[1], filters), fold(tree[2], filters)
        return (b if bool(a[1]) == (kind == "and") else a) if a[0] == "const" else (kind, a, b)
    if kind == "not":
        a = fold(tree[1], filters)
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "cond":
        test, a, b = (fold(t, filters) for t in tree[1:])
        return (a if test[1] else b) if test[0] == "const" else ("cond", test, a, b)
    if kind == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"unknown filter {tree[1]!r}")
        a = fold(tree[2], filters)
        return ("const", _applied(filters, tree[1])(a[1])) if a[0] == "const" else ("filter", tree[1], a)
    if kind == "default":
        return ("default", fold(tree[1], filters), fold(tree[2], filters))
    if kind == "defined":
        return ("defined", fold(tree[1], filters))
    if kind == "test":
        a = fold(tree[2], filters)
        return ("const", _TESTS[tree[1]](a[1])) if a[0] == "const" else ("test", tree[1], a)
    if kind == "set":
        return ("set", tree[1], fold(tree[2], filters))
    if kind == "get":
        return ("get", fold(tree[1], filters), fold(tree[2], filters))
    if kind == "print":
        a = fold(tree[1], filters)
        return ("text", _text(a[1])) if a[0] == "const" else ("print", a)
    if kind == "for":
        return ("for", tree[1], fold(tree[2], filters), fold(tree[3], filters))
    if kind == "generation":
        return ("generation", fold(tree[1], filters))
    if kind == "if":
        left = []
        for test, inside in tree[1]:
            test = None if test is None else fold(test, filters)
            if test and test[0] == "const":
                if not test[1]:
                    continue
                test = None
            left.append((test, fold(inside, filters)))
            if test is None:
                break
        return left[0][1] if left and left[0][0] is None else ("if", tuple(left))
    flat: list[tuple] = []
    for part in (fold(t, filters) for t in tree[1]):
        for x in part[1] if part[0] == "block" else (part,):
            if x[0] == "text" and flat and flat[-1][0] == "text":
                flat[-1] = ("text", flat[-1][1] + x[1])
            elif x != ("text", ""):
                flat.append(x)
    return ("block", tuple(flat))


# ---- closures --------------------------------------------------------------------------------------


_WHOLE_VALUES: dict[str, Callable] = {"tojson": lambda v: json.dumps(v, ensure_ascii=False), "length": lambda v: len(v) if isinstance(v, str | list | tuple | dict) else 0}


def _applied(filters: dict[str, Callable], name: str) -> Callable:
    """A filter as a function of any value: most see it as a text."""
    if name in _WHOLE_VALUES:
        return _WHOLE_VALUES[name]
    apply = filters[name]
    return lambda v: apply(_text(v))


def _member(holder, key, otherwise=None):
    if isinstance(holder, dict):
        return holder.get(key, otherwise) if isinstance(key, str | int) else otherwise
    if isinstance(holder, list | tuple) and isinstance(key, int) and -len(holder) <= key < len(holder):
        return holder[key]
    return otherwise


def _value(tree: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "test":
        check, inner = _TESTS[tree[1]], _value(tree[2], filters)
        return lambda scope: check(inner(scope))
    if kind == "defined":
        if tree[1][0] == "name":
            wanted = tree[1][1]
            return lambda scope: wanted in scope
        if tree[1][0] != "get":
            return lambda scope: True
        holder, key = _value(tree[1][1], filters), _value(tree[1][2], filters)
        return lambda scope: _member(holder(scope), key(scope), _ABSENT) is not _ABSENT
    if kind == "default":
        inner, instead = _value(tree[1], filters), _value(tree[2], filters)
        return lambda scope: instead(scope) if (v := inner(scope)) is None else v
    if kind == "const":
        constant = tree[1]
        return lambda scope: constant
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "filter":
        apply, inner = _applied(filters, tree[1]), _value(tree[2], filters)
        return lambda scope: apply(inner(scope))
    if kind == "not":
        inner = _value(tree[1], filters)
        return lambda scope: not inner(scope)
    a, b = _value(tree[1], filters), _value(tree[2], filters)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "cond":
        c = _value(tree[3], filters)
        return lambda scope: b(scope) if a(scope) else c(scope)
    if kind == "get":
        return lambda scope: _member(a(scope), b(scope))
    operator = _OPERATORS[kind]
    return lambda scope: operator(a(scope), b(scope))


def _printer(tree: tuple, filters: dict[str, Callable]) -> Callable[[dict, bool], Pieces]:
    kind = tree[0]
    if kind == "text":
        text = tree[1]
        return lambda scope, generated: iter(((text, generated),))
    if kind == "print":
        value = _value(tree[1], filters)
        return lambda scope, generated: iter(((_text(value(scope)), generated),))
    if kind == "set":
        target, given = tree[1], _value(tree[2], filters)

        def assign(scope: dict, generated: bool) -> Pieces:
            scope[target] = given(scope)
            return iter(())

        return assign
    if kind == "generation":
        inner = _printer(tree[1], filters)
        return lambda scope, generated: inner(scope, True)
    if kind == "for":
        name, items, inside = tree[1], _value(tree[2], filters), _printer(tree[3], filters)

        ahead = _uses(tree[3], ("get", ("name", "loop"), ("const", "last")))  # only then a turn waits for the one after it

        def loop(scope: dict, generated: bool) -> Pieces:
            found = items(scope)
            rest = iter(found if found is not None else ())
            item = next(rest, _ABSENT)
            index = 0
            while item is not _ABSENT:
                after = next(rest, _ABSENT) if ahead else None
                yield from inside(scope | {name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": after is _ABSENT}}, generated)
                item, index = after if ahead else next(rest, _ABSENT), index + 1

        return loop
    if kind == "if":
        branches = [(_value(test, filters) if test else None, _printer(inside, filters)) for test, inside in tree[1]]

        def choose(scope: dict, generated: bool) -> Pieces:
            for test, inside in branches:
                if test is None or test(scope):
                    yield from inside(scope, generated)
                    return

        return choose
    parts = [_printer(t, filters) for t in tree[1]]

    def block(scope: dict, generated: bool) -> Pieces:
        for part in parts:
            yield from part(scope, generated)

    return block


def compile_template(source: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[[dict], Pieces]:
    """A function from the template's variables to the stream of (text, generated) pieces."""
    filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower, **dict.fromkeys(_WHOLE_VALUES, str)} | (filters or {})
    tree = parse(source)
    checked(tree)
    run = _printer(fold(tree, filters), filters)
    return lambda variables: run(dict(variables), False)


# ---- the production template -----------------------------------------------------------------------

# Control strings never occur in escaped text: each of them is a backslash and a letter there.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_ESCAPED = re.compile(r"\\|###|</turn>")
_BACK = {v: k for k, v in ESCAPES.items()}
_UNESCAPED = re.compile(r"\\[\\ht]")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: _BACK[m[0]], text)


TURN_END = " </turn>\n"
TEMPLATE = (
    "{% for m in messages %}{{ '### ' + (m.role|role) }}{{ ': ' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}{{ ' </turn>\\n' }}{% endfor %}"
)
FILTERS = {"escape": escape, "role": lambda r: escape(r).replace(":", "\\c")}


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    role, _, text = formatted[4 : -len(TURN_END)].partition(": ")
    return unescape(role.replace("\\c", ":")) if "\\c" in role else unescape(role), unescape(text)


def read_back(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the loss mask, length) of every turn of a formatted stream."""
    held, masked = [], []
    for text, generated in pieces:
        held.append(text)
        if generated:
            masked.append(text)
        if text.endswith(TURN_END):
            whole = "".join(held)
            if not generated and whole.endswith(TURN_END):
                yield *read_turn(whole), unescape("".join(masked)), len(whole)
                held, masked = [], []


def digest(messages: Iterable[dict], render: Callable[[dict], Pieces]) -> dict:
    """Counts and digests of one conversation, from its formatted form read back."""
    turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for role, text, masked, length in read_back(render({"messages": messages})):
        turns.update(f"{role}\n{text}\n".encode())
        loss.update(masked.encode())
        n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + length
    return {"n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _sorted_rows(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def render_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted text and loss spans (code point offsets) of every conversation: the training rows themselves."""

    def run(batches):
        render = compile_template(template, FILTERS)
        for key, rows in itertools.groupby(_rows(batches), key=lambda r: r["conv_id"]):
            text, spans, at = [], [], 0
            for piece, generated in render({"messages": ({"role": r["role"] or "", "text": r["text"] or ""} for r in rows)}):
                if generated and piece:
                    spans.append({"start": at, "end": at + len(piece)})
                text.append(piece)
                at += len(piece)
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "formatted": "".join(text), "loss_spans": spans}], schema=_RENDERED)

    return _sorted_rows(conversations).mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


_RENDERED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Format every conversation and return what can be read back from the formatted stream (see `digest`)."""

    def run(batches):
        render = compile_template(template, FILTERS)
        held = []
        for key, rows in itertools.groupby(_rows(batches), key=lambda r: r["conv_id"]):
            held.append({"conv_id": key} | digest(({"role": r["role"] or "", "text": r["text"] or ""} for r in rows), render))
            if len(held) >= 4096:
                yield pa.RecordBatch.from_pylist(held, schema=_DIGEST)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_DIGEST)

    return _sorted_rows(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS body FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(4 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + 2 + length(body) + 9)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""
