"""Chat formatting by a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constant parts are folded and the rest becomes Python closures; nothing is
evaluated as Python source, and values are reached by the names that the caller passes, fields by dictionary keys.
Rendering yields pieces while it walks over the messages, so a conversation of any length streams through a worker.

Language: ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in y %} {% endfor %}`` (with
``loop.first`` and ``loop.index0``), ``{% generation %} {% endgeneration %}`` around what a model is trained on, and
comments ``{# #}``. A hyphen inside a tag's mark (``{%-``, ``-%}``, ``{{-``, ``-}}``) drops the white space on that side. Expressions have strings, integers, true, false, none, names, ``a.b`` and ``a['b']``, ``+ ~ == != < > <= >=
and or not``, parentheses and the filters escape, escape_line, trim, upper, lower and length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common as C

#: Strings with a meaning for chat models, and what stands for each inside a text.
ESCAPE = "\x1a"
CONTROLS = {
    "<|im_start|>": "b",
    "<|im_end|>": "e",
    "<s>": "s",
    "</s>": "t",
    "[INST]": "i",
    "[/INST]": "j",
}
TEMPLATE = (
    "{# turns between marks; assistants' texts are what a model learns #}"
    "{{ '<s>' }}"
    "{% for m in messages %}"
    "{{ '<|im_start|>' + (m.role | escape_line) + '\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}"
    "{% else %}{{ m.content | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\n' }}"
    "{% endfor %}"
    "{{ '</s>' }}"
)
_CONTROL = re.compile("|".join(map(re.escape, [ESCAPE, *sorted(CONTROLS, key=len, reverse=True)])))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
_BACK = {code: text for text, code in CONTROLS.items()} | {"z": ESCAPE, "n": "\n"}


def escape(text: str) -> str:
    """The text without any control string; ``unescape`` gives it back."""
    return _CONTROL.sub(lambda m: ESCAPE + CONTROLS.get(m[0], "z"), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text) if ESCAPE in text else text


class TemplateError(ValueError):
    """The template isn't well formed, or asks for something that it may not."""


# ---------------------------------------------------------------- syntax

_TAG = re.compile(r"\{#.*?#\}|\{\{(?P<before>-?)(?P<output>.*?)(?P<after>-?)\}\}|\{%(?P<ahead>-?)\s*(?P<tag>.*?)\s*(?P<behind>-?)%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().\[\]|]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(str(v)),
    "escape_line": lambda v: escape(str(v)).replace("\n", ESCAPE + "n"),
    "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": len,
}
_COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "string":
            text = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1], flags=re.DOTALL)
        out.append((kind, int(text) if kind == "int" else text))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression; nodes are tuples."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0
        self.tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, text: str | None = None):
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or text not in (None, self.tokens[self.at][1]):
            raise TemplateError(f"expected {text or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while op := self.take(*_COMPARE):
            left = ("compare", op, left, self.joined())
        return left

    def joined(self):
        left = self.filtered()
        while op := self.take("+", "~"):
            left = ("join", op, left, self.filtered())
        return left

    def filtered(self):
        value = self.reached()
        while self.take("|"):
            name = self.need("name")
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name}")
            value = ("filter", name, value)
        return value

    def reached(self):
        value = self.single()
        while True:
            if self.take("."):
                value = ("field", value, ("const", self.need("name")))
            elif self.take("["):
                value = ("field", value, self.either())
                self.need("op", "]")
            else:
                return value

    def single(self):
        if self.take("("):
            value = self.either()
            self.need("op", ")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind in ("string", "int"):
            return ("const", text)
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: text, output, if, for and generation nodes."""
    root: list[tuple] = []
    stack: list[tuple[str, list, list]] = [("", root, [])]
    at, trim = 0, False
    for m in _TAG.finditer(source):
        body, text = stack[-1][1], source[at : m.start()]
        text = text.lstrip() if trim else text
        text = text.rstrip() if m["before"] or m["ahead"] else text
        if text:
            body.append(("text", text))
        at, trim = m.end(), bool(m["after"] or m["behind"])
        if m["output"] is not None:
            body.append(("output", _Expression(m["output"]).tree))
        elif m["tag"] is not None:
            word, _, rest = m["tag"].partition(" ")
            if word == "if":
                stack.append(("if", own := [], [(_Expression(rest).tree, own)]))
            elif word in ("elif", "else"):
                if stack[-1][0] == "else":
                    raise TemplateError("a branch after else")
                if stack[-1][0] != "if":
                    raise TemplateError(f"{word} outside if")
                branches, own = stack[-1][2], []
                branches.append((_Expression(rest).tree, own) if word == "elif" else (("const", True), own))
                stack[-1] = (word.replace("elif", "if"), own, branches)
            elif word == "for":
                found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                if not found:
                    raise TemplateError("for needs a name and in")
                stack.append(("for", [], [found[1], _Expression(found[2]).tree]))
            elif word == "generation":
                stack.append(("generation", [], []))
            elif word in ("endif", "endfor", "endgeneration"):
                kind, own, more = stack.pop()
                kind = "if" if kind == "else" else kind
                if kind != word.removeprefix("end") or not stack:
                    raise TemplateError(f"{word} closes nothing")
                stack[-1][1].append(("if", more) if kind == "if" else ("for", *more, own) if kind == "for" else ("generation", own))
            else:
                raise TemplateError(f"unknown tag {word}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    if rest := source[at:].lstrip() if trim else source[at:]:
        root.append(("text", rest))
    return root


# ---------------------------------------------------------------- folding and closures


def _fold(tree):
    """An expression with its constant parts computed."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    parts = [_fold(x) if isinstance(x, tuple) else x for x in tree[1:]]
    folded = (kind, *parts)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _closure(folded)({}))
    # constants at the seam of two joins meet; what stands before them is joined as it was
    if kind == "join" and parts[2][0] == "const" and parts[1][0] == "join" and parts[1][3][0] == "const" and all(isinstance(x[1], str) for x in (parts[2], parts[1][3])):
        return ("join", parts[1][1], parts[1][2], ("const", parts[1][3][1] + parts[2][1]))
    return folded


def _closure(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        def name(env, key=tree[1]):
            if key not in env:
                raise TemplateError(f"no value for {key}")
            return env[key]
        return name
    if kind == "field":
        base, key = _closure(tree[1]), _closure(tree[2])

        def field(env):
            value = base(env)
            if not isinstance(value, dict):
                raise TemplateError("only fields of messages can be reached")
            return value.get(key(env))
        return field
    if kind == "filter":
        return lambda env, f=_FILTERS[tree[1]], v=_closure(tree[2]): f(v(env))
    if kind == "compare":
        return lambda env, f=_COMPARE[tree[1]], a=_closure(tree[2]), b=_closure(tree[3]): f(a(env), b(env))
    if kind == "join":
        a, b = _closure(tree[2]), _closure(tree[3])
        return (lambda env: f"{a(env)}{b(env)}") if tree[1] == "~" else (lambda env: a(env) + b(env))
    if kind == "not":
        return lambda env, v=_closure(tree[1]): not v(env)
    a, b = _closure(tree[1]), _closure(tree[2])
    return (lambda env: a(env) or b(env)) if kind == "or" else (lambda env: a(env) and b(env))


def fold(nodes: list[tuple]) -> list[tuple]:
    """The tree with constants computed, dead branches removed and neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "output":
            tree = _fold(node[1])
            # a constant at the head or tail of a join is plain text
            own = [("text", str(tree[1]))] if tree[0] == "const" else [("output", tree)]
        elif kind == "if":
            branches = []
            for test, body in node[1]:
                test = _fold(test)
                if test[0] != "const" or test[1]:
                    branches.append((test, fold(body)))
                if test[0] == "const" and test[1]:
                    break
            own = branches[0][1] if branches and branches[0][0][0] == "const" else [("if", branches)] if branches else []
        elif kind == "for":
            own = [("for", node[1], _fold(node[2]), fold(node[3]))]
        elif kind == "generation":
            own = [("generation", fold(node[1]))]
        else:
            own = [node]
        for x in own:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


Piece = tuple[str, bool]


def _body(nodes: list[tuple], learned: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(x, learned) for x in nodes]

    def run(env):
        for step in steps:
            yield from step(env)

    return run


def _step(node: tuple, learned: bool) -> Callable[[dict], Iterable[Piece]]:
    kind = node[0]
    if kind == "text":
        return lambda env, piece=((node[1], learned),): piece
    if kind == "output":
        return lambda env, v=_closure(node[1]): ((str(v(env)), learned),)
    if kind == "generation":
        return _body(node[1], True)
    if kind == "if":
        branches = [(_closure(test), _body(body, learned)) for test, body in node[1]]

        def choose(env):
            for test, body in branches:
                if test(env):
                    return body(env)
            return ()
        return choose
    name, values, body = node[1], _closure(node[2]), _body(node[3], learned)

    def loop(env):
        for i, value in enumerate(values(env)):
            yield from body({**env, name: value, "loop": {"first": i == 0, "index0": i}})

    return loop


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A function of the template's names that yields (text, learned) pieces; iterables are walked lazily."""
    body = _body(fold(parse(source)), False)
    return lambda **env: body(env)


# ---------------------------------------------------------------- operator


def _formatted(source: str):
    """Rows (conv_id, turn, role, text), a conversation's in a row, become pieces (conv_id, place, text, learned)."""

    def run(batches):
        render = compile_template(source)

        def rows():
            for batch in batches:
                for i, j in C.slices(C.utf8(batch.column("text"))[1]):
                    part = batch.slice(i, j - i)
                    yield from zip(*(part.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True)

        feed = rows()
        ahead = next(feed, None)
        out: list[list] = [[], [], [], []]
        size = 0
        while ahead is not None:
            conv = ahead[0]

            def messages(conv=conv):
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    _, role, text = ahead
                    ahead = next(feed, None)
                    yield {"role": role or "", "content": text or ""}

            for place, (text, learned) in enumerate(render(messages=messages())):
                for column, value in zip(out, (conv, place, text, learned), strict=True):
                    column.append(value)
                size += len(text)
                if size > C.CHUNK_BYTES:
                    yield _pieces(out)
                    out, size = [[], [], [], []], 0
            while ahead is not None and ahead[0] == conv:  # a template that doesn't walk over all messages
                ahead = next(feed, None)
        if out[0]:
            yield _pieces(out)

    return run


def _pieces(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["conv_id", "place", "text", "learned"])


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted conversations as pieces in order: conv_id, place, text, learned.

    Joined by place, a conversation's pieces are its text; ``learned`` is the loss mask. Turns follow ``turn``, then
    role and text (nulls first). Conversations are dealt by id and sorted within a partition, where they stream, so
    memory is bounded by the longest turn. Null roles and texts are empty.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition(C.partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatted(template), "conv_id long, place long, text string, learned boolean")


class _Reader:
    """Reads the text of one conversation in the format of ``TEMPLATE``, piece by piece, and digests it."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.held, self.masked = "", []

    def feed(self, text: str, learned: bool) -> None:
        self.chars += len(text)
        if learned:
            own = unescape(text)
            self.loss_chars += len(own)
            self.loss.update(own.encode("utf-8", "surrogatepass"))
        self.held += text
        while (end := self.held.find("<|im_end|>\n")) >= 0:
            turn, self.held = self.held[:end], self.held[end + len("<|im_end|>\n") :]
            turn = turn.removeprefix("<s>") if not self.turns else turn
            if not turn.startswith("<|im_start|>"):
                raise ValueError(f"conversation {self.conv}: a turn doesn't begin with its mark")
            role, line, text = turn.removeprefix("<|im_start|>").partition("\n")
            if not line:
                raise ValueError(f"conversation {self.conv}: a turn has no role")
            self.turns += 1
            self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        if self.held not in ("</s>", "<s></s>"):
            raise ValueError(f"conversation {self.conv}: {self.held[:40]!r} is left over")
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_ROW = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    reader, out = None, []

    def batch():
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _ROW.split(", ")])

    for pieces in batches:
        for conv, place, text, learned in zip(*(pieces.column(k).to_pylist() for k in ("conv_id", "place", "text", "learned")), strict=True):
            if reader is None or place == 0:
                if reader is not None:
                    out.append(reader.row())
                reader = _Reader(conv)
            reader.feed(text, learned)
        if len(out) >= 10_000:
            yield batch()
            out = []
    if reader is not None:
        out.append(reader.row())
    if out:
        yield batch()


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted text says: turns, learned text and length of each conversation.

    Reads from the text alone; the mask says which characters are learned. Expects the pieces as
    ``format_conversations`` gives them, each conversation's in order.
    """
    return pieces.mapInArrow(_read_back, _ROW)


def round_trip(turns: DataFrame) -> DataFrame:
    """Format every conversation and read it back; null ids are one conversation, an empty table gives no rows."""
    return read_back(format_conversations(turns))


#: The conversation that every run adds.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return round_trip(turns.unionByName(extra.select(*[F.col(n).cast(t) for n, t in turns.dtypes])))


def _sql_escaped(column: str) -> str:
    """Length of an escaped text: every control string gives two code points."""
    out = f"length({column}) + (length({column}) - length(replace({column}, chr(26), '')))"
    for control in CONTROLS:
        out += f" - {len(control) - 2} * ((length({column}) - length(replace({column}, '{control}', ''))) // {len(control)})"
    return out


ORACLE = f"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(24 + length(role) + {_sql_escaped('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
