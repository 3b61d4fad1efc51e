"""Chat formatting with a compiled template language.

A template says how a conversation's turns become text and which parts a model is
trained to generate.  It is parsed into a syntax tree, constants are folded, and the
tree is turned into Python closures; nothing is evaluated as Python source, and names
reach only what the renderer hands them (no attributes, calls or imports).

The language::

    {{ expression }}                 text of a value
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for message in messages %} ... {% endfor %}     once, at the top level
    {% set name = expression %}      within the rest of its block
    {% generation %} ... {% endgeneration %}           text under the loss mask
    {# comment #}
    expressions: 'text', numbers, true, false, none, message.role, message.text,
      loop.index, loop.index0, loop.first, loop.last, names set before, ( ),
      ~ (joins texts), + - %, == != < <= > >=, in, not, and, or, value if e else value,
      filters value | upper | lower | trim | length | default('x') | escape

``escape`` makes control strings inside a text harmless and is undone by ``unescape``:
a backslash goes in behind the first character of each control string, and one more
where backslashes stand there already.  A template's control strings are declared with
it; literal text may only be made of them and of white space, values are put out escaped
and with a control string between any two, so the output can be read back: outside
control strings there is nothing but escaped text.

Distribution: turns are sorted by range of (conversation, turn), so that a
conversation with a large share of all rows is spread over many tasks.  Runs of a
conversation's turns are packed into rows of at most ``PIECE_TURNS`` turns or
``PIECE_CHARS`` characters; each piece is rendered by itself, with the numbers of its
first turn and of its conversation's last.  These come from counts by (conversation,
sorted part), at most two of which a part shares with others.

Cases: a null role or text is ''; null conversation ids are one conversation, null
turns come first; ties in turn are ordered by role, then by a hash of the text, so repeated
rows are repeated turns; texts may be of any length; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.store import materialize

PIECE_TURNS, PIECE_CHARS = 256, 64_000
BATCH_ROWS, BATCH_CHARS = 1000, 1_000_000       # of pieces that a task hands on at once
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ANSWER]", "[ROLE]", "[/ROLE]")
TEMPLATE = """{% set open = '[' %}<s>{% for message in messages %}
{%- if message.role == 'user' %}[INST]{{ message.text | escape }}{{ open ~ '/INST]' }}
{%- elif message.role == 'assistant' %}[ANSWER]{% generation %}{{ message.text | escape }}{% endgeneration %}</s>
{%- else %}[ROLE]{{ message.role | escape }}[/ROLE]{{ message.text | escape }}</s>
{%- endif %}{% endfor %}"""

MARK = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
LEX = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)"""
                 r"""|(?P<op>==|!=|<=|>=|[-+%~<>().,|=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
VALUES = {"true": True, "false": False, "none": None}
FIELDS = {"message": ("role", "text"), "loop": ("index", "index0", "first", "last")}


class TemplateError(ValueError):
    pass


# --- syntax tree -------------------------------------------------------------------
class Const(NamedTuple):
    value: object


class Name(NamedTuple):
    name: str


class Apply(NamedTuple):
    """A pure function of its arguments; ``escape`` needs the control strings."""
    what: str
    args: tuple


class Choice(NamedTuple):
    """An expression's value, or a block's nodes, by the first condition that holds."""
    cases: tuple        # (condition, expression or nodes)
    block: bool


class Put(NamedTuple):
    value: object


class Assign(NamedTuple):
    name: str
    value: object


class Mask(NamedTuple):
    body: tuple


class Loop(NamedTuple):
    body: tuple


def text_of(x) -> str:
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


FUNCTIONS: dict[str, Callable] = {
    "~": lambda a, b: text_of(a) + text_of(b), "+": lambda a, b: a + b, "-": lambda a, b: a - b, "%": lambda a, b: a % b,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: text_of(a) in text_of(b),
    "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
    "upper": lambda a: text_of(a).upper(), "lower": lambda a: text_of(a).lower(), "trim": lambda a: text_of(a).strip(),
    "length": lambda a: len(text_of(a)), "default": lambda a, b: b if a is None or a == "" else a,
}
FILTERS = {"upper": 0, "lower": 0, "trim": 0, "length": 0, "default": 1, "escape": 0}
LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("%",))


class Parser:
    """Recursive descent over the marks of a template, and over a mark's expression."""

    def __init__(self, source: str):
        # a dash inside a mark eats the white space beside it
        source = re.sub(r"\s*(\{[{%#])-", r"\1", re.sub(r"-([}%#]\})\s*", r"\1", source))
        self.parts = [p for p in MARK.split(source) if p]
        self.at = 0
        self.names: list[set[str]] = [set()]

    def block(self, ends: tuple[str, ...], top: bool = False, in_loop: bool = False) -> tuple[tuple, str]:
        """Nodes up to one of the closing words, and that word with its rest."""
        nodes: list = []
        self.names.append(set(self.names[-1]))
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                nodes.append(Put(self.whole(part[2:-2], in_loop)))
            elif not part.startswith("{%"):
                nodes.append(Put(Const(part)))
            else:
                body = part[2:-2].strip()
                word, _, rest = body.partition(" ")
                if word in ends:
                    self.names.pop()
                    return tuple(nodes), body
                nodes.append(self.statement(word, rest, top, in_loop))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        self.names.pop()
        return tuple(nodes), ""

    def statement(self, word: str, rest: str, top: bool, in_loop: bool):
        if word == "if":
            cases, condition = [], self.whole(rest, in_loop)
            while True:
                body, end = self.block(("elif", "else", "endif"), in_loop=in_loop)
                cases.append((condition, body))
                if end == "endif":
                    return Choice(tuple(cases), True)
                if end == "else":
                    body, _ = self.block(("endif",), in_loop=in_loop)
                    return Choice((*cases, (Const(True), body)), True)
                condition = self.whole(end.partition(" ")[2], in_loop)
        if word == "for":
            if not top or rest.split() != ["message", "in", "messages"]:
                raise TemplateError("the one loop is 'for message in messages', at the top level")
            return Loop(self.block(("endfor",), in_loop=True)[0])
        if word == "generation" and not rest:
            return Mask(self.block(("endgeneration",), in_loop=in_loop)[0])
        if word == "set":
            name, eq, value = (x.strip() for x in rest.partition("="))
            if not eq or not name.isidentifier() or name in (*FIELDS, *VALUES, "messages"):
                raise TemplateError(f"can't set {rest}")
            got = Assign(name, self.whole(value, in_loop))
            self.names[-1].add(name)
            return got
        raise TemplateError(f"unknown statement {word}")

    # expressions
    def whole(self, source: str, in_loop: bool):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = LEX.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.place, self.in_loop = 0, in_loop
        got = self.choice()
        if self.place < len(self.tokens):
            raise TemplateError(f"can't read {self.tokens[self.place][1]} in {source}")
        return got

    def peek(self) -> str | None:
        kind, text = self.tokens[self.place] if self.place < len(self.tokens) else (None, None)
        return None if kind == "str" else text

    def take(self, *want: str) -> str | None:
        if self.peek() in want:
            self.place += 1
            return self.tokens[self.place - 1][1]
        return None

    def need(self, want: str) -> None:
        if not self.take(want):
            raise TemplateError(f"{want} is missing")

    def choice(self):
        value = self.level(0)
        if self.take("if"):
            condition = self.level(0)
            self.need("else")
            return Choice(((condition, value), (Const(True), self.choice())), False)
        return value

    def level(self, n: int):
        if n == 2 and self.take("not"):
            return Apply("not", (self.level(2),))
        if n == len(LEVELS):
            return self.filtered()
        left = self.level(n + 1)
        while op := self.take(*LEVELS[n]):
            left = Apply(op, (left, self.level(n + 1)))
        return left

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            self.place += 1
            args = [value]
            if FILTERS[name]:
                self.need("(")
                args.append(self.choice())
                self.need(")")
            value = Apply(name, tuple(args))
        return value

    def atom(self):
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.place >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.place]
        self.place += 1
        if kind == "num":
            return Const(int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind != "name":
            raise TemplateError(f"can't read {text}")
        if text in VALUES:
            return Const(VALUES[text])
        if text in FIELDS and self.in_loop:
            self.need(".")
            if self.peek() not in FIELDS[text]:
                raise TemplateError(f"{text} has no {self.peek()}")
            return Name(f"{text}.{self.take(*FIELDS[text])}")
        if text in self.names[-1]:
            return Name(text)
        raise TemplateError(f"unknown name {text}")


def fold(node, functions: dict, known: dict):
    """The tree with constant expressions worked out, settled conditions taken, names
    of constants replaced and neighbouring literal text joined."""
    if isinstance(node, Name):
        return Const(known[node.name]) if node.name in known else node
    if isinstance(node, Apply):
        args = tuple(fold(a, functions, known) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(functions[node.what](*(a.value for a in args)))
        return Apply(node.what, args)
    if isinstance(node, Choice):
        cases = []
        for condition, value in node.cases:
            condition = fold(condition, functions, known)
            if isinstance(condition, Const) and not condition.value:
                continue
            value = fold_block(value, functions, dict(known)) if node.block else fold(value, functions, known)
            cases.append((condition, value))
            if isinstance(condition, Const):
                break
        if not node.block and isinstance(cases[0][0], Const):
            return cases[0][1]
        return Choice(tuple(cases), node.block)
    if isinstance(node, Put):
        value = fold(node.value, functions, known)
        escaped = isinstance(node.value, Apply) and node.value.what == "escape"
        if not escaped:
            functions["literal"](value)
        return Put(Const(text_of(value.value)) if isinstance(value, Const) else value)
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value, functions, known))
    if isinstance(node, (Mask, Loop)):
        return type(node)(fold_block(node.body, functions, dict(known)))
    return node


def fold_block(nodes: tuple, functions: dict, known: dict) -> tuple:
    out: list = []
    for node in nodes:
        node = fold(node, functions, known)
        if isinstance(node, Assign):
            known.pop(node.name, None)
            if isinstance(node.value, Const):
                known[node.name] = node.value.value
                continue
        if isinstance(node, Choice) and node.block and (not node.cases or isinstance(node.cases[0][0], Const)):
            inner = node.cases[0][1] if node.cases else ()
            if not any(isinstance(x, Assign) for x in inner):   # its names end with its block
                out.extend(inner)
                continue
        if isinstance(node, Put) and isinstance(node.value, Const):
            if not node.value.value:
                continue
            if out and isinstance(out[-1], Put) and isinstance(out[-1].value, Const):
                out[-1] = Put(Const(out[-1].value.value + node.value.value))
                continue
        out.append(node)
    return tuple(out)


# --- closures ----------------------------------------------------------------------
def value_closure(node, functions: dict) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env[name]
    if isinstance(node, Choice):
        cases = [(value_closure(c, functions), value_closure(v, functions)) for c, v in node.cases]
        return lambda env: next(v(env) for c, v in cases if c(env))
    args = [value_closure(a, functions) for a in node.args]
    if node.what in ("and", "or"):
        left, right = args
        return (lambda env: left(env) and right(env)) if node.what == "and" else (lambda env: left(env) or right(env))
    f = functions[node.what]
    if len(args) == 1:
        one = args[0]
        return lambda env: f(one(env))
    left, right = args
    return lambda env: f(left(env), right(env))


def block_closure(nodes: tuple, functions: dict, masked: bool = False) -> Callable[[dict, list], None]:
    """A function of (names, output) that appends (text, under the mask) pairs."""
    steps: list[Callable] = []

    def put(value):
        def step(env, out):
            out.append((text_of(value(env)), masked))
        return step

    def assign(name, value):
        def step(env, out):
            env[name] = value(env)
        return step

    def choose(cases):
        def step(env, out):
            for condition, body in cases:
                if condition(env):
                    return body(dict(env), out)
        return step

    for node in nodes:
        if isinstance(node, Put):
            steps.append(put(value_closure(node.value, functions)))
        elif isinstance(node, Assign):
            steps.append(assign(node.name, value_closure(node.value, functions)))
        elif isinstance(node, Choice):
            steps.append(choose([(value_closure(c, functions), block_closure(b, functions, masked)) for c, b in node.cases]))
        else:
            body = block_closure(node.body, functions, True)
            steps.append(lambda env, out, body=body: body(dict(env), out))

    def run(env, out):
        for step in steps:
            step(env, out)
    return run


class Template:
    """A compiled template.  ``piece`` renders some neighbouring turns of a conversation."""

    def __init__(self, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS):
        self.source, self.controls = source, tuple(controls)
        firsts = {c[0] for c in controls if c}
        if any(len(c) < 2 or "\\" in c or firsts & set(c[1:]) or re.search(r"\s", c) for c in controls) or any(
                a != b and a.startswith(b) for a in controls for b in controls):
            raise TemplateError("a control string has two characters or more, no white space or backslash, no control "
                                "string's first character behind its own, and no other one at its begin")
        ends = "|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in sorted(controls))
        back = "|".join(f"({re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in sorted(controls))
        escape, unescape = re.compile(ends), re.compile(back)
        self.escape = lambda text: escape.sub(lambda m: m[0] + "\\", text_of(text))
        self.unescape = lambda text: unescape.sub(lambda m: m[0][0], text)
        self.control = re.compile("|".join(map(re.escape, sorted(controls, key=len, reverse=True))))
        functions = {**FUNCTIONS, "escape": self.escape, "literal": self._literal}
        nodes, _ = Parser(source).block((), top=True)
        self.tree = fold_block(nodes, functions, {})
        loops = [k for k, n in enumerate(self.tree) if isinstance(n, Loop)]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over the messages")
        k = loops[0]
        self._head = block_closure(self.tree[:k], functions)
        self._turn = block_closure(self.tree[k].body, functions)
        self._tail = block_closure(self.tree[k + 1:], functions)

    def _literal(self, value) -> None:
        """What is put out unescaped is made of control strings and white space."""
        if not isinstance(value, Const):
            raise TemplateError("a value that is put out ends in the filter escape")
        if self.control.sub("", text_of(value.value)).strip():
            raise TemplateError(f"{value.value!r} is more than declared control strings")

    def piece(self, turns: list[tuple[str, str]], first: int, total: int) -> tuple[str, list[tuple[int, int]]]:
        """Text and loss spans (code points) of turns (role, text) from number ``first`` on
        of a conversation of ``total`` turns; its head and tail with its ends."""
        out: list[tuple[str, bool]] = []
        env: dict = {}
        if first == 0:
            self._head(env, out)
        else:
            self._head(env, [])     # the names that it sets
        for k, (role, text) in enumerate(turns, first):
            self._turn({**env, "message.role": role, "message.text": text, "loop.index0": k, "loop.index": k + 1,
                        "loop.first": k == 0, "loop.last": k == total - 1}, out)
        if first + len(turns) == total:
            self._tail(env, out)
        spans, at = [], 0
        for text, masked in out:
            if masked:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            at += len(text)
        return "".join(t for t, _ in out), spans


def read_turns(template: Template, text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a text that ``TEMPLATE`` gave, from the text alone."""
    at, role = 0, None
    for m in template.control.finditer(text):
        held, c = template.unescape(text[at:m.start()]), m[0]
        if c == "[INST]":
            role = "user"
        elif c == "[ANSWER]":
            role = "assistant"
        elif c == "[/ROLE]":
            role = held
        elif c in ("[/INST]", "</s>"):
            yield role, held
        at = m.end()


# --- on Spark ------------------------------------------------------------------------
def _pieces(turns: DataFrame) -> DataFrame:
    """Rows of a conversation's neighbouring turns: (conv, part, seq, before, open, roles,
    texts).  ``open``: the conversation may go on in another row."""
    kind = turns.schema["conv"].dataType.simpleString()
    names = ["conv", "part", "seq", "before", "open", "roles", "texts"]

    def run(batches):
        part, conv_type = TaskContext.get().partitionId(), pa.int64()
        state = {"conv": None, "seq": 0, "before": 0, "first": True}
        roles, texts, size, begun, held, weight = [], [], 0, False, [], 0

        def close(is_open):
            held.append((state["conv"], part, state["seq"], state["before"], is_open, roles, texts))

        def batch_of():
            types = (conv_type, pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held.clear()
            return out

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if begun and conv != state["conv"]:
                    close(state["first"] or state["seq"] > 0)
                    state.update(seq=0, before=0, first=False)
                    roles, texts, size = [], [], 0
                elif len(roles) >= PIECE_TURNS or size >= PIECE_CHARS:
                    close(True)
                    state.update(seq=state["seq"] + 1, before=state["before"] + len(roles))
                    roles, texts, size = [], [], 0
                if weight >= BATCH_CHARS or len(held) >= BATCH_ROWS:
                    yield batch_of()
                    weight = 0
                state["conv"], begun = conv, True
                roles.append(role)
                texts.append(text)
                size += len(role) + len(text)
                weight += len(role) + len(text)
        if begun:
            close(True)     # the next part may go on with it
            yield batch_of()

    return turns.mapInArrow(run, f"conv {kind}, part int, seq long, before long, open boolean, "
                                 "roles array<string>, texts array<string>")


def format_conversations(conversations: DataFrame, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS,
                         conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """(conv, first, n_turns, total, text, spans) of every piece of a formatted
    conversation: the number of its first turn, its turns, those of the conversation, its
    text, and the loss mask as [start, end) pairs of code points.  Pieces of a
    conversation, joined in the order of ``first``, are its text; most have one."""
    spark = conversations.sparkSession
    Template(source, controls)      # errors show here
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"),
                                 blank(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = (turns.withColumn("tie", F.xxhash64("role", "text")).repartitionByRange(n, "conv", "turn", "role", "tie")
              .sortWithinPartitions("conv", "turn", "role", "tie", "text"))
    pieces = materialize(_pieces(ranges.select("conv", "role", "text")), "chat-pieces")

    # an open conversation's turns in each part, and how many come before: few rows a conversation
    share = pieces.where("open").groupBy("conv", "part").agg(F.sum(F.size("roles")).alias("n"))
    order = Window.partitionBy("conv").orderBy("part")
    share = share.select("conv", "part", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                                    F.lit(0)).alias("offset"),
                         F.sum("n").over(Window.partitionBy("conv")).alias("total"))
    share = share.select(F.col("conv").alias("of"), F.col("part").alias("of_part"), "offset", "total")
    opened = pieces.where("open").join(share, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    placed = opened.select("conv", (F.col("offset") + F.col("before")).alias("first"), "total", "roles", "texts").unionByName(
        pieces.where("not open").select("conv", "before", F.size("roles").cast("long").alias("total"), "roles", "texts")
        .withColumnRenamed("before", "first"))
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches):
        template = Template(source, controls)
        for batch in batches:
            firsts, totals, roles, texts = (batch.column(c).to_pylist() for c in ("first", "total", "roles", "texts"))
            made = [template.piece(list(zip(r, t)), a, n) for a, n, r, t in zip(firsts, totals, roles, texts)]
            yield pa.RecordBatch.from_arrays([
                batch.column("conv"), batch.column("first"), pa.array([len(r) for r in roles], pa.int64()),
                batch.column("total"), pa.array([m[0] for m in made], pa.string()),
                pa.array([[list(s) for s in m[1]] for m in made], pa.list_(pa.list_(pa.int64())))],
                ["conv", "first", "n_turns", "total", "text", "spans"])

    return placed.mapInArrow(run, f"conv {kind}, first long, n_turns long, total long, text string, "
                                  "spans array<array<bigint>>")


def read_back(formatted: DataFrame, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every
    conversation, from the pieces' texts and masks alone.  A conversation in one piece is
    done where it lies; of the others each piece is reduced to the bytes that the two
    digests take, which follow one another in a single stream: that is SHA-256's nature."""
    kind = formatted.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(text, spans, template):
        turns = list(read_turns(template, text))
        loss = [template.unescape(text[a:b]) for a, b in spans]
        return (len(turns), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), sum(map(len, loss)),
                "".join(loss).encode(), len(text))

    def reduce(batches):
        """Digests of whole conversations, the bytes of pieces."""
        template = Template(source, controls)
        for batch in batches:
            whole = [n == t for n, t in zip(batch.column("n_turns").to_pylist(), batch.column("total").to_pylist())]
            got = [read(t, s, template) for t, s in zip(*(batch.column(c).to_pylist() for c in ("text", "spans")))]
            data = lambda k: pa.array([sha256(g[k]).hexdigest().encode() if w else g[k] for g, w in zip(got, whole)], pa.binary())
            number = lambda k: pa.array([g[k] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("first"), batch.column("total"),
                                              number(0), data(1), number(2), data(3), number(4)],
                                             ["conv", "first", "total", "n_turns", "turns", "loss_chars", "loss", "chars"])

    def stream(batches):
        """A conversation's pieces follow one another; only digests and sums are held."""
        at = None
        for batch in batches:
            out = []
            rows = [batch.column(c).to_pylist() for c in ("conv", "first", "total", "n_turns", "turns", "loss_chars", "loss", "chars")]
            for conv, first, total, n, turns, loss_chars, loss, chars in zip(*rows):
                if n == total:
                    out.append((conv, n, turns.decode(), loss_chars, loss.decode(), chars))
                    continue
                if first == 0:
                    at = [0, sha256(), 0, sha256(), 0]
                at[0], at[2], at[4] = at[0] + n, at[2] + loss_chars, at[4] + chars
                at[1].update(turns)
                at[3].update(loss)
                if first + n == total:
                    out.append((conv, at[0], at[1].hexdigest(), at[2], at[3].hexdigest(), at[4]))
            if out:
                types = (batch.schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    parts = formatted.select("conv", "first", "n_turns", "total", "text", "spans").mapInArrow(
        reduce, f"conv {kind}, first long, total long, n_turns long, turns binary, loss_chars long, loss binary, chars long")
    return parts.repartition("conv").sortWithinPartitions("conv", "first").mapInArrow(
        stream, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
