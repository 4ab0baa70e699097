"""Chat formatting with a small template compiler.

The template language has text, {{ expression }}, {% for x in messages %}, {% if %}/{% elif %}/{% else %}, {% set %}
and {% generation %}, each block closed by its {% end... %}. Expressions have literals, names, attributes of the
message, ==, !=, and, or, not, in, +, parentheses and the filters escape, escape_line, trim, upper, lower, length. There is nothing
else: no calls, no imports, no access to Python objects. A template is parsed into a tree, expressions of constants are
folded (and so are tests and adjoining texts), and the tree becomes nested Python closures. These are generators: they
take messages from an iterator and give out (text, under the loss mask) pieces, so that a conversation of any length is
rendered turn by turn.

`escape` makes a text free of control strings, reversibly: backslash, '<' and '[' become backslash and a letter each.

Rows: conversations are the rows of one conv_id (null is one of its own) by turn, then role and text; null text and null
role count as empty. Rows with the same turn all stay. A conversation without rows does not exist; an empty table gives
no rows. Rows are spread by conv_id and sorted; a task holds one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, struct

TEMPLATE = (
    "{% for m in messages %}{% if m.role == 'assistant' %}<|assistant|>\n{% generation %}{{ m.text | escape }}{% endgeneration %}</s>\n"
    "{% else %}<|role|>{{ m.role | escape_line }}\n[INST] {{ m.text | escape }} [/INST]\n{% endif %}{% endfor %}"
)

_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_TABLE = str.maketrans(_ESCAPES)
_BACK = {v[1]: k for k, v in _ESCAPES.items()} | {"n": "\n"}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.translate(_TABLE)


def escape_line(text: str) -> str:
    """Also free of line feeds."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


class TemplateError(ValueError):
    """The template is not of the language."""


Node = tuple  # (kind, ...)
_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_][A-Za-z_0-9]*)|(==|!=|[.|()+]))")
_FILTERS: dict[str, Callable] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}
_FIELDS = ("role", "text", "index")


def _expression(source: str) -> Node:
    tokens, at = [], 0
    while at < len(source.rstrip()):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"not understood: {source[at:]!r}")
        tokens.append((("text", "number", "name", "sign")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    tokens.append(("end", ""))

    def peek(*words: str) -> bool:
        return tokens[0][1] in words and tokens[0][0] in ("name", "sign")

    def binary(words: dict[str, str], below: Callable[[], Node]) -> Node:
        left = below()
        while peek(*words):
            left = ("op", words[tokens.pop(0)[1]], left, below())
        return left

    def disjunction() -> Node:
        return binary({"or": "or"}, lambda: binary({"and": "and"}, negation))

    def negation() -> Node:
        if peek("not"):
            tokens.pop(0)
            return ("not", negation())
        return binary({"==": "==", "!=": "!=", "in": "in"}, lambda: binary({"+": "+"}, filtered))

    def filtered() -> Node:
        left = atom()
        while peek("|"):
            tokens.pop(0)
            name = tokens.pop(0)[1]
            if name not in _FILTERS:
                raise TemplateError(f"no such filter: {name}")
            left = ("filter", name, left)
        return left

    def atom() -> Node:
        kind, value = tokens.pop(0)
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            return ("const", int(value))
        if value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name":
            if not peek("."):
                return ("name", value)
            tokens.pop(0)
            field = tokens.pop(0)[1]
            if field not in _FIELDS:
                raise TemplateError(f"no such field: {field}")
            return ("field", value, field)
        if value == "(":
            inner = disjunction()
            if tokens.pop(0)[1] != ")":
                raise TemplateError("no closing parenthesis")
            return inner
        raise TemplateError(f"not understood: {value!r}")

    out = disjunction()
    if tokens[0][0] != "end":
        raise TemplateError(f"not understood: {tokens[0][1]!r}")
    return out


def parse(template: str) -> list[Node]:
    parts, at = [], 0
    for m in _TAGS.finditer(template):
        parts.append(("text", template[at : m.start()]))
        parts.append(("emit", m[1].strip()) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", template[at:]))

    def body(*ends: str) -> tuple[list[Node], str]:
        out: list[Node] = []
        while parts:
            kind, value = parts.pop(0)
            word, _, rest = value.partition(" ")
            if kind == "text":
                out.append(("emit", ("const", value)))
            elif kind == "emit":
                out.append(("emit", _expression(value)))
            elif word in ends:
                return out, value
            elif word == "for":
                m = re.fullmatch(r"(\w+) in messages", rest.strip())
                if not m:
                    raise TemplateError(f"loops go over messages: {value!r}")
                out.append(("for", m[1], body("endfor")[0]))
            elif word == "if":
                out.append(branch(rest))
            elif word == "set":
                name, _, source = rest.partition("=")
                out.append(("set", name.strip(), _expression(source)))
            elif word == "generation":
                out.append(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"not understood: {value!r}")
        if ends:
            raise TemplateError(f"no {ends[0]}")
        return out, ""

    def branch(source: str) -> Node:
        then, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            other = [branch(end.partition(" ")[2])]
        else:
            other = body("endif")[0] if end == "else" else []
        return ("if", _expression(source), then, other)

    return body()[0]


_OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def _worked_out(work: Callable, *values: object) -> object:
    """What an operator or a filter makes of constants; an error of the template if they don't go with it."""
    try:
        return work(*values)
    except (TypeError, AttributeError) as e:
        raise TemplateError(f"can't be worked out with {', '.join(map(repr, values))}") from e


def fold(node: Node) -> Node:
    """An expression with its constant parts worked out."""
    if node[0] == "op":
        left, right = fold(node[2]), fold(node[3])
        done = left[0] == right[0] == "const"
        return ("const", _worked_out(_OPS[node[1]], left[1], right[1])) if done else ("op", node[1], left, right)
    if node[0] in ("not", "filter"):
        inner = fold(node[-1])
        if inner[0] == "const":
            return ("const", not inner[1] if node[0] == "not" else _worked_out(_FILTERS[node[1]], inner[1]))
        return (*node[:-1], inner)
    return node


def fold_body(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for node in nodes:
        if node[0] == "emit":
            value = fold(node[1])
            if value[0] == "const" and out and out[-1][0] == "emit" and out[-1][1][0] == "const":
                out[-1] = ("emit", ("const", str(out[-1][1][1]) + str(value[1])))
            elif value != ("const", ""):
                out.append(("emit", value))
        elif node[0] == "if":
            test = fold(node[1])
            if test[0] == "const":
                out += fold_body(node[2] if test[1] else node[3])
            else:
                out.append(("if", test, fold_body(node[2]), fold_body(node[3])))
        elif node[0] == "set":
            out.append(("set", node[1], fold(node[2])))
        else:
            out.append((*node[:-1], fold_body(node[-1])))
    return out


def _value(node: Node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env[n]
    if kind == "field":
        return lambda env, n=node[1], f=node[2]: env[n][f]
    if kind == "not":
        return lambda env, f=_value(node[1]): not f(env)
    if kind == "filter":
        return lambda env, g=_FILTERS[node[1]], f=_value(node[2]): g(f(env))
    left, right = _value(node[2]), _value(node[3])
    if node[1] == "and":
        return lambda env: left(env) and right(env)
    if node[1] == "or":
        return lambda env: left(env) or right(env)
    return lambda env, op=_OPS[node[1]]: op(left(env), right(env))


Piece = tuple[str, bool]


def _steps(nodes: list[Node], learn: bool) -> Callable[[dict], Iterator[Piece]]:
    made = []
    for node in nodes:
        if node[0] == "emit":
            made.append(lambda env, f=_value(node[1]): iter(((str(f(env)), learn),)))
        elif node[0] == "for":
            made.append(lambda env, n=node[1], f=_steps(node[2], learn): (p for m in env["messages"] for p in f(env | {n: m})))
        elif node[0] == "if":
            made.append(lambda env, t=_value(node[1]), f=_steps(node[2], learn), g=_steps(node[3], learn): f(env) if t(env) else g(env))
        elif node[0] == "generation":
            made.append(_steps(node[1], True))
        else:

            def assign(env: dict, n: str = node[1], f: Callable = _value(node[2])) -> Iterator[Piece]:
                env[n] = f(env)
                return iter(())

            made.append(assign)
    if len(made) == 1:
        return made[0]

    def run(env: dict) -> Iterator[Piece]:
        for f in made:
            yield from f(env)

    return run


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """messages (dicts of role, text, index) -> pieces, one after the other as messages are taken."""
    run = _steps(fold_body(parse(template)), False)
    return lambda messages: run({"messages": iter(messages)})


def format_conversations(rows: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rendered conversations, a row per stretch: conv_id, segment (from 0), text, learn (under the loss mask).

    A conversation's text is that of its segments in order. They come sorted, in one partition for a conversation.
    """
    named = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    spread = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        turns = ((c, r, t) for b in batches for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3))))
        ahead = next(turns, None)

        def messages(conv: int | None) -> Iterator[dict]:
            nonlocal ahead
            index = 0
            while ahead is not None and ahead[0] == conv:
                _, role, text = ahead
                ahead = next(turns, None)
                yield {"role": role, "text": text, "index": index}
                index += 1

        out: list[tuple] = []
        size = 0
        while ahead is not None:
            conv, n = ahead[0], 0
            taken = messages(conv)
            for text, learn in render(taken):
                out.append((conv, n, text, learn))
                size, n = size + len(text), n + 1
                if size > 4 << 20 or len(out) > 20_000:
                    yield _batch(out)
                    out, size = [], 0
            for _ in taken:  # a template need not take all messages
                pass
        if out:
            yield _batch(out)

    return spread.mapInArrow(run, struct("conv_id long, segment long, text string, learn boolean"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "segment", "text", "learn"])


_HEAD = re.compile(r"<\|(assistant|role)\|>")


class _Reader:
    """Reads the turns of TEMPLATE back from stretches of its output."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.n_turns, self.loss_chars, self.chars, self.held = conv, 0, 0, 0, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, text: str, learn: bool) -> None:
        self.chars += len(text)
        self.held += text
        if learn:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        if self.held.endswith(("</s>\n", " [/INST]\n")):
            self._turn()

    def _turn(self) -> None:
        role, _, rest = self.held.partition("\n")
        if role == "<|assistant|>":
            role, text = "assistant", rest.removesuffix("</s>\n")
        else:
            role, text = unescape(role.removeprefix("<|role|>")), rest.removeprefix("[INST] ").removesuffix(" [/INST]\n")
        self.turns.update(f"{role}\n{unescape(text)}\n".encode())
        self.n_turns += 1
        self.held = ""

    def row(self) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what format_conversations gives."""
    schema = struct("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            done = []
            for conv, n, text, learn in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if reader is None or n == 0:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.take(text, learn)
            yield _rows(done)
        if reader is not None:
            yield _rows([reader.row()])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done) if done else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return segments.mapInArrow(run, schema)
