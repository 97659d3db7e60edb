"""Chat formatting by compiled templates.

A template of a small sandboxed language is parsed into a syntax tree, constants are folded, and each node becomes a
Python closure. Expressions reach only the given values by key or index; there are no calls but the named filters, so a
template cannot touch Python objects. A generation block marks what the model is to learn.

Control strings inside texts are escaped by a backslash before them (and before each backslash), so what a
conversation says can always be told from the marks and read back unchanged.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE = "{% for m in messages %}### {{ m.role|escape_role }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}</turn>\n{% endfor %}"

_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPE_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def escape_role(text: str) -> str:
    return _ESCAPE_ROLE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": lambda v: escape(str(v)), "escape_role": lambda v: escape_role(str(v)), "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "trim": lambda v: str(v).strip(), "length": len, "string": str}


class TemplateError(ValueError):
    """The template is not of the language, or reaches for what it may not."""


# Syntax tree: tuples of a kind and its parts.
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+\-*~|.,()\[\]]))""", re.S)
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
_BINARY = _COMPARE | {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: _times(a, b), "~": lambda a, b: _show(a) + _show(b)}


def _times(a: Any, b: Any) -> Any:
    if not all(isinstance(x, (int, float)) for x in (a, b)):
        raise TemplateError("only numbers are multiplied")
    return a * b


def _show(value: Any) -> str:
    return "" if value is None else str(value)


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"not understood: {text[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in values

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.items) or kind and self.items[self.at][0] != kind:
            raise TemplateError(f"{kind or 'more'} expected")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at != len(self.items):
            raise TemplateError(f"not understood: {self.items[self.at][1]!r}")
        return tree

    def choice(self) -> tuple:
        value = self.either()
        if self.peek("if"):
            self.take()
            test = self.either()
            other = ("const", None)
            if self.peek("else"):
                self.take()
                other = self.choice()
            return ("choice", test, value, other)
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.peek("or"):
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negation()
        while self.peek("and"):
            self.take()
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negation())
        left = self.sum()
        while self.peek(*_COMPARE):
            left = ("binary", self.take(), left, self.sum())
        return left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek("+", "-", "~"):
            left = ("binary", self.take(), left, self.product())
        return left

    def product(self) -> tuple:
        left = self.filtered()
        while self.peek("*"):
            left = ("binary", self.take(), left, self.filtered())
        return left

    def filtered(self) -> tuple:
        value = self.reach()
        while self.peek("|"):
            self.take()
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            value = ("filter", name, value)
        return value

    def reach(self) -> tuple:
        value = self.atom()
        while self.peek(".", "["):
            if self.take() == ".":
                value = ("get", value, ("const", self.take("name")))
            else:
                value = ("get", value, self.choice())
                if not self.peek("]"):
                    raise TemplateError("] expected")
                self.take()
        return value

    def atom(self) -> tuple:
        if self.peek("("):
            self.take()
            value = self.choice()
            if not self.peek(")"):
                raise TemplateError(") expected")
            self.take()
            return value
        if self.at >= len(self.items):
            raise TemplateError("an expression ends too soon")
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "num":
            return ("const", float(text) if "." in text else int(text))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[text]) if text in fixed else ("name", text)
        raise TemplateError(f"not understood: {text!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S)
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        body: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                body.append(("show", _Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    at -= 1
                    return body, word
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"not a loop: {rest}")
                    inner, _ = block(("endfor",))
                    at += 1
                    body.append(("for", m[1], _Expression(m[2]).whole(), inner))
                elif word == "if":
                    arms, test = [], _Expression(rest).whole()
                    while True:
                        inner, end = block(("elif", "else", "endif"))
                        arms.append((test, inner))
                        rest = parts[at][2:-2].strip().partition(" ")[2]
                        at += 1
                        if end == "endif":
                            break
                        test = _Expression(rest).whole() if end == "elif" else ("const", True)
                    body.append(("if", arms))
                elif word == "generation":
                    inner, _ = block(("endgeneration",))
                    at += 1
                    body.append(("generation", inner))
                elif word == "set":
                    name, _, value = rest.partition("=")
                    if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                        raise TemplateError(f"no name: {name}")
                    body.append(("set", name.strip(), _Expression(value).whole()))
                else:
                    raise TemplateError(f"no such block: {word}")
            elif part and not part.startswith("{#"):
                body.append(("text", part))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return body, ""

    return block(())[0]


def fold(tree: tuple) -> tuple:
    """The expression with all that does not depend on the values worked out."""
    kind, *rest = tree
    if kind in ("const", "name"):
        return tree
    parts = [fold(x) if isinstance(x, tuple) else x for x in rest]
    inner = [x for x in parts if isinstance(x, tuple)]
    if kind == "choice" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    folded = (kind, *parts)
    if all(x[0] == "const" for x in inner):
        return ("const", _expression(folded)({}))
    return folded


def fold_block(body: list[tuple]) -> list[tuple]:
    """The nodes with constants folded, decided branches taken and neighbouring texts joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "show":
            value = fold(node[1])
            add(("text", _show(value[1])) if value[0] == "const" else ("show", value))
        elif kind == "for":
            add(("for", node[1], fold(node[2]), fold_block(node[3])))
        elif kind == "generation":
            add(("generation", fold_block(node[1])))
        elif kind == "set":
            add(("set", node[1], fold(node[2])))
        elif kind == "if":
            arms = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_block(inner)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        else:
            add(node)
    return out


def _get(value: Any, key: Any) -> Any:
    """Only keys of mappings and places of lists; never an attribute."""
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    if value is None:
        return None
    raise TemplateError(f"{key!r} of a {type(value).__name__}")


def _expression(tree: tuple) -> Callable[[dict], Any]:
    kind, *rest = tree
    if kind == "const":
        value = rest[0]
        return lambda env: value
    if kind == "name":
        name = rest[0]
        return lambda env: env.get(name)
    if kind == "get":
        of, key = map(_expression, rest)
        return lambda env: _get(of(env), key(env))
    if kind == "filter":
        f, of = FILTERS[rest[0]], _expression(rest[1])
        return lambda env: f(of(env))
    if kind == "not":
        of = _expression(rest[0])
        return lambda env: not of(env)
    if kind == "and":
        a, b = map(_expression, rest)
        return lambda env: a(env) and b(env)
    if kind == "or":
        a, b = map(_expression, rest)
        return lambda env: a(env) or b(env)
    if kind == "choice":
        test, a, b = map(_expression, rest)
        return lambda env: a(env) if test(env) else b(env)
    f, a, b = _BINARY[rest[0]], _expression(rest[1]), _expression(rest[2])
    return lambda env: f(a(env), b(env))


def _block(body: list[tuple]) -> Callable[[dict, Callable[[str, bool], None], bool], None]:
    steps = [_step(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, put: Callable[[str, bool], None], learn: bool) -> None:
        for step in steps:
            step(env, put, learn)

    return run


def _step(node: tuple) -> Callable[[dict, Callable[[str, bool], None], bool], None]:
    kind, *rest = node
    if kind == "text":
        text = rest[0]
        return lambda env, put, learn: put(text, learn)
    if kind == "show":
        of = _expression(rest[0])
        return lambda env, put, learn: put(_show(of(env)), learn)
    if kind == "generation":
        inner = _block(rest[0])
        return lambda env, put, learn: inner(env, put, True)
    if kind == "set":
        name, value = rest[0], _expression(rest[1])
        return lambda env, put, learn: env.__setitem__(name, value(env))
    if kind == "if":
        arms = [(_expression(test), _block(inner)) for test, inner in rest[0]]

        def branch(env: dict, put: Callable[[str, bool], None], learn: bool) -> None:
            for test, inner in arms:
                if test(env):
                    return inner(env, put, learn)

        return branch
    name, of, inner = rest[0], _expression(rest[1]), _block(rest[2])

    def loop(env: dict, put: Callable[[str, bool], None], learn: bool) -> None:
        outer = {k: env.get(k) for k in (name, "loop")}
        items, none = iter(of(env) or ()), object()
        item, index = next(items, none), 0
        while item is not none:  # one value ahead, so that messages can be a stream
            after = next(items, none)
            env[name] = item
            env["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": after is none}
            inner(env, put, learn)
            item, index = after, index + 1
        env.update(outer)

    return loop


class Template:
    """A compiled template. render gives a text and the spans to learn from; stream hands out its pieces one by one."""

    def __init__(self, source: str = TEMPLATE):
        self.tree = fold_block(parse(source))
        self._run = _block(self.tree)

    def stream(self, put: Callable[[str, bool], None], **values: Any) -> None:
        self._run(dict(values), put, False)

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        parts, spans, size = [], [], 0

        def put(text: str, learn: bool) -> None:
            nonlocal size
            if text:
                if learn:
                    spans.append((size, size + len(text)))
                parts.append(text)
                size += len(text)

        self.stream(put, **values)
        return "".join(parts), spans


_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn of a text formatted by TEMPLATE."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


#: A formatted conversation comes in parts of whole turns; a part is closed once it is so long.
PART_CHARS = 1 << 18
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", _SPANS)])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _batched(rows: Iterable[dict], schema: pa.Schema, weigh: Callable[[dict], int] = lambda r: 1, limit: int = 2000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weigh(r)
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _format_parts(source: str):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source)
        turn = Template.__new__(Template)  # the body of the loop over messages, to hand out parts between turns
        loops = [n for n in template.tree if n[0] == "for" and n[2] == ("name", "messages")]
        split = len(template.tree) == 1 and len(loops) == 1
        if split:
            turn.tree, turn._run = loops[0][3], _block(loops[0][3])

        def convs() -> Iterator[dict]:
            for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r["conv_id"]):
                messages = ({"role": r["role"] or "", "text": r["text"] or ""} for r in rows)
                if not split:
                    text, loss = template.render(messages=messages)
                    yield {"conv_id": conv, "part": 0, "text": text, "loss": [{"start": a, "end": b} for a, b in loss]}
                    continue
                part, out, loss, size, index = 0, [], [], 0, 0
                none = object()
                item = next(messages, none)
                while item is not none:
                    after = next(messages, none)
                    text, spans = turn.render(**{loops[0][1]: item, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": after is none}})
                    loss += [{"start": size + a, "end": size + b} for a, b in spans]
                    out.append(text)
                    size += len(text)
                    item, index = after, index + 1
                    if size >= PART_CHARS or item is none:
                        yield {"conv_id": conv, "part": part, "text": "".join(out), "loss": loss}
                        part, out, loss, size = part + 1, [], [], 0

        yield from _batched(convs(), _PARTS, lambda r: len(r["text"]) + 100, 1 << 20)

    return parts


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Rows (conv_id, part, text, loss): each conversation's formatted text, in parts of whole turns, and in each part
    the spans (code points) to learn from.

    conversations has conv_id, turn, role and text; others are not read. Rows go by turn, and within a turn by role and
    text, nulls first; repeated rows are turns of their own. Null role or text is empty; rows with a null conv_id are
    one conversation. A conversation's rows are sorted by Spark and streamed, so its length needs no memory; parts of
    one conversation come in order in one partition. An empty table gives none. A template whose only top node is the
    loop over messages is given out in parts; any other conversation is one part.
    """
    Template(template)  # an error shows here, not in a task
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format_parts(template), "conv_id long, part long, text string, loss array<struct<start: long, end: long>>")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def convs() -> Iterator[dict]:
        for conv, parts in itertools.groupby(_rows(batches), key=lambda r: r["conv_id"]):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for p in parts:
                size += len(p["text"])
                for role, text in read_turns(p["text"]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in p["loss"]:
                    plain = unescape(p["text"][span["start"] : span["end"]])
                    chars += len(plain)
                    loss.update(plain.encode())
            yield {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

    yield from _batched(convs(), _READ)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    formatted = format_conversations(given.unionByName(extra))
    # What was written is read back where it is: the parts of a conversation follow each other in their partition.
    return formatted.mapInArrow(_read_parts, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, length(role) + length(text)
    + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, ':', ''))
    + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###'))
    + length('### ') + length(': ') + length('</turn>') + 1 AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
