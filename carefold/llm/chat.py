"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants in it are folded, and the tree becomes Python
closures that render one message at a time. There is no attribute, call, import or index beyond the fields of ``message``
and a fixed set of filters, so a template cannot reach anything else.

    {{ expression }}                     text of an expression
    {% if a %}..{% elif b %}..{% else %}..{% endif %}
    {% set name = expression %}          a local name, for this message
    {% generation %}..{% endgeneration %}   what is rendered inside is under the loss mask

Expressions: 'text', true, false, message.role, message.text, names, ``a ~ b`` (joined), ``a == b``, ``a != b``, ``not a``,
``a and b``, ``a or b``, ``a | filter``, parentheses. Filters: escape, upper, lower, trim.

``escape`` puts a backslash before every backslash and every control string of the template, which ``unescape`` undoes,
so texts may hold the template's own marks and still come back exactly.

Rendering is row-local; conversations are put together by a sort within partitions, in parts of bounded size, so that a
conversation with most of the rows is neither held in memory nor rendered in one task. Null texts count as empty, a null
role as ``""``; turns are ordered by turn (nulls first), then role and text; repeated rows stay; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.llm import common

#: Marks that the default template writes; inside texts they are escaped.
CONTROLS = ("<turn>", "</turn>", "### ", ": ")
TEMPLATE = (
    "<turn>### {{ (message.role == 'assistant' and 'Assistant' or message.role == 'user' and 'User' or '=' ~ message.role) | escape }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}</turn>\n"
)
#: Characters of a stored part, about; a single longer message makes a longer part.
PART_CHARS = 1 << 16

Scope = dict[str, object]
Render = Callable[[Scope, "Output"], None]


def escaper(controls: tuple[str, ...]) -> Callable[[str], str]:
    marks = re.compile("|".join([r"\\", *map(re.escape, controls)]))
    return lambda text: marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """Every backslash is the one before a mark or before another backslash."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


# --- syntax tree -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter over its operands."""

    kind: str
    operands: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Choose:
    """Pairs of a condition and the nodes rendered for the first that holds."""

    branches: tuple


@dataclass(frozen=True)
class Masked:
    body: tuple


class TemplateError(ValueError):
    """A template that does not follow the language."""


TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|(message\.(?:role|text))\b|([A-Za-z_]\w*)|(==|!=|[~|()=]))", re.S)
CONTROL_TEXT = {"n": "\n", "t": "\t"}
FIELDS = ("message.role", "message.text")


class Expression:
    """Reads one expression by precedence: or, and, not, comparison, join, filter."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            text, field, word, mark = found.groups()
            if text is not None:
                self.tokens.append(("text", re.sub(r"\\(.)", lambda m: CONTROL_TEXT.get(m[1], m[1]), text)))
            else:
                self.tokens.append(("name", field) if field else ("word", word) if word else ("mark", mark))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> bool:
        kind, value = self.peek()
        if kind in ("word", "mark") and value in wanted:
            self.at += 1
            return True
        return False

    def whole(self):
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Apply("or", (node, self.both()))
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = Apply("and", (node, self.negated()))
        return node

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        for mark in ("==", "!="):
            if self.take(mark):
                return Apply(mark, (node, self.joined()))
        return node

    def joined(self):
        node = self.filtered()
        while self.take("~"):
            node = Apply("~", (node, self.filtered()))
        return node

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "word" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = Apply(name, (node,))
        return node

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "text":
            return Const(value)
        if kind == "name":
            return Name(value)
        if kind == "word" and value in ("true", "false"):
            return Const(value == "true")
        if kind == "word":
            return Name(value)
        if (kind, value) == ("mark", "("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return node
        raise TemplateError(f"an operand is missing before {value!r}")


FILTERS = ("escape", "upper", "lower", "trim")
TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for found in TAG.finditer(source):
        if found.start() > at:
            pieces.append(("text", source[at : found.start()]))
        pieces.append(("value", found[1]) if found[1] is not None else ("tag", found[2]))
        at = found.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    nodes, rest, closed = _block(pieces, 0, set())
    if closed or rest < len(pieces):
        raise TemplateError(f"{closed!r} closes nothing")
    return nodes


def _block(pieces: list, at: int, masked: set) -> tuple[tuple, int, str]:
    """Nodes up to a tag that closes or parts the block; that tag."""
    nodes = []
    while at < len(pieces):
        kind, text = pieces[at]
        at += 1
        if kind == "text":
            nodes.append(Emit(Const(text)))
        elif kind == "value":
            nodes.append(Emit(Expression(text).whole()))
        elif text in ("else", "endif", "endgeneration") or text.startswith("elif "):
            return tuple(nodes), at, text
        elif text.startswith("if "):
            branches, condition = [], Expression(text[3:]).whole()
            while True:
                body, at, closed = _block(pieces, at, masked)
                branches.append((condition, body))
                if closed == "endif":
                    break
                if closed == "else":
                    body, at, closed = _block(pieces, at, masked)
                    branches.append((Const(True), body))
                    if closed != "endif":
                        raise TemplateError("'if' is not closed")
                    break
                if not closed.startswith("elif "):
                    raise TemplateError("'if' is not closed")
                condition = Expression(closed[5:]).whole()
            nodes.append(Choose(tuple(branches)))
        elif text == "generation":
            if masked:
                raise TemplateError("'generation' inside 'generation'")
            body, at, closed = _block(pieces, at, {1})
            if closed != "endgeneration":
                raise TemplateError("'generation' is not closed")
            nodes.append(Masked(body))
        elif found := re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(?!=)\s*(.*)", text, re.S):
            nodes.append(Assign(found[1], Expression(found[2]).whole()))
        else:
            raise TemplateError(f"no tag {text!r}")
    return tuple(nodes), at, ""


# --- folding and closures ----------------------------------------------------------------------------------------------


class Compiler:
    """Folds constants and turns the tree into closures."""

    def __init__(self, controls: tuple[str, ...]):
        self.filters = {"escape": escaper(controls), "upper": str.upper, "lower": str.lower, "trim": str.strip}

    def apply(self, kind: str, values: list) -> object:
        if kind in self.filters:
            return self.filters[kind](str(values[0]))
        if kind == "~":
            return str(values[0]) + str(values[1])
        if kind in ("==", "!="):
            return (values[0] == values[1]) == (kind == "==")
        return not values[0]

    def fold(self, node):
        """The same expression with everything that does not depend on a message computed."""
        if not isinstance(node, Apply):
            return node
        operands = tuple(self.fold(x) for x in node.operands)
        if node.kind in ("and", "or"):
            left, right = operands
            if isinstance(left, Const):
                return right if bool(left.value) == (node.kind == "and") else left
        elif all(isinstance(x, Const) for x in operands):
            return Const(self.apply(node.kind, [x.value for x in operands]))
        return Apply(node.kind, operands)

    def fold_block(self, nodes: tuple) -> tuple:
        """Folds expressions, drops branches that cannot be taken, joins neighbouring constant texts."""
        out: list = []
        for node in nodes:
            if isinstance(node, Emit):
                node = Emit(self.fold(node.value))
                if isinstance(node.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(str(out[-1].value.value) + str(node.value.value)))
                    continue
            elif isinstance(node, Assign):
                node = Assign(node.name, self.fold(node.value))
            elif isinstance(node, Masked):
                node = Masked(self.fold_block(node.body))
            elif isinstance(node, Choose):
                branches = []
                for condition, body in node.branches:
                    condition = self.fold(condition)
                    if isinstance(condition, Const) and not condition.value:
                        continue
                    branches.append((condition, self.fold_block(body)))
                    if isinstance(condition, Const):
                        break
                if branches and isinstance(branches[0][0], Const):
                    out += branches[0][1]
                    continue
                node = Choose(tuple(branches))
            out.append(node)
        return tuple(out)

    def value(self, node) -> Callable[[Scope], object]:
        if isinstance(node, Const):
            return lambda scope, value=node.value: value
        if isinstance(node, Name):
            return lambda scope, name=node.name: scope.get(name, "")
        parts = [self.value(x) for x in node.operands]
        if node.kind == "and":
            return lambda scope: parts[0](scope) and parts[1](scope)
        if node.kind == "or":
            return lambda scope: parts[0](scope) or parts[1](scope)
        return lambda scope, kind=node.kind: self.apply(kind, [p(scope) for p in parts])

    def block(self, nodes: tuple) -> Render:
        steps = [self.node(n) for n in nodes]

        def render(scope: Scope, out: "Output") -> None:
            for step in steps:
                step(scope, out)

        return render

    def node(self, node) -> Render:
        if isinstance(node, Emit):
            value = self.value(node.value)
            return lambda scope, out: out.write(str(value(scope)))
        if isinstance(node, Assign):
            value = self.value(node.value)
            return lambda scope, out, name=node.name: scope.__setitem__(name, value(scope))
        if isinstance(node, Masked):
            body = self.block(node.body)

            def masked(scope: Scope, out: Output) -> None:
                begin = out.length
                body(scope, out)
                out.spans.append((begin, out.length))

            return masked
        branches = [(self.value(c), self.block(b)) for c, b in node.branches]

        def choose(scope: Scope, out: Output) -> None:
            for condition, body in branches:
                if condition(scope):
                    body(scope, out)
                    return

        return choose


class Output:
    """Rendered text of one message and its spans under the loss mask, in code points."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def compile_template(source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> Callable[[str, str], tuple[str, list[tuple[int, int]]]]:
    """A function of role and text that gives the rendered message and its masked spans."""
    compiler = Compiler(controls)
    render = compiler.block(compiler.fold_block(parse(source)))

    def message(role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        render({"message.role": role, "message.text": text}, out)
        return "".join(out.parts), out.spans

    return message


# --- conversations -----------------------------------------------------------------------------------------------------

#: Message columns that the operator itself makes.
_PARTS = "conv_id long, part long, text string, mask array<struct<begin:int,end:int>>"


def render_turns(turns: DataFrame, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """conv_id, turn, role, body and the rendered text with its mask of every message; row-local."""
    schema = "conv_id long, turn long, role string, body string, text string, mask array<struct<begin:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(source, controls)
        for batch in common.slices(batches):
            roles = batch.column(2).fill_null("").to_pylist()
            texts = common.text_column(batch).to_pylist()
            made = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            masks = [[{"begin": a, "end": b} for a, b in spans] for _, spans in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array([m[0] for m in made], pa.string()),
                 pa.array(masks, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                ["conv_id", "turn", "role", "body", "text", "mask"])

    return common.map_arrow(common.plain(turns, "conv_id", "turn", "role", "text"), run, schema)


def format_conversations(turns: DataFrame, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """The formatted conversations in parts: conv_id, part (0, 1, ..), text, and the mask in code points of the part.

    Messages are rendered where they lie and only then sorted; a part is closed at about ``PART_CHARS`` characters.
    """
    first = lambda c: F.col(c).asc_nulls_first()
    rendered = render_turns(turns, source, controls)
    dealt = rendered.repartition(F.col("conv_id")).sortWithinPartitions(first("conv_id"), first("turn"), "role", "body").select("conv_id", "text", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None, "part": 0, "texts": [], "size": 0, "mask": [], "open": False}
        done: list[tuple] = []

        def close() -> None:
            if state["texts"]:
                done.append((state["key"], state["part"], "".join(state["texts"]), state["mask"]))
                state.update(part=state["part"] + 1, texts=[], size=0, mask=[])

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "text", "mask"])
            done.clear()
            return made

        for batch in common.slices(batches):
            for key, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not state["open"] or key != state["key"]:
                    close()
                    state.update(key=key, part=0, open=True)
                state["mask"] += [{"begin": m["begin"] + state["size"], "end": m["end"] + state["size"]} for m in mask]
                state["texts"].append(text)
                state["size"] += len(text)
                if state["size"] >= PART_CHARS:
                    close()
            yield emit()
        close()
        yield emit()

    return common.map_arrow(dealt, run, _PARTS)


def turn_reader(controls: tuple[str, ...] = CONTROLS) -> Callable[[str], list[tuple[str, str]]]:
    """Reads (role, text) of the turns of a part that the default template wrote."""
    heads = re.escape("".join(sorted({c[0] for c in controls})))
    plain = r"((?:[^\\%s]+|\\.|(?!%s)[%s])*+)" % (heads, "|".join(map(re.escape, controls)), heads)
    turn = re.compile(rf"<turn>### {plain}: {plain}</turn>\n", re.S)

    def read(text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            found = turn.match(text, at)
            if not found:
                raise ValueError(f"no turn at {at}: {text[at : at + 60]!r}")
            label, body = unescape(found[1]), unescape(found[2])
            out.append((label[1:] if label.startswith("=") else label.lower(), body))
            at = found.end()
        return out

    return read


def read_digests(parts: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """Counts and digests of every formatted conversation, from the formatted text and mask alone.

    Parts of a conversation are read in order with running digests, so one part is in memory at a time.
    """
    dealt = parts.repartition(F.col("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = turn_reader(controls)
        done: list[tuple] = []
        key, state = None, None

        def close() -> None:
            if state is not None:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            done.clear()
            return made

        for batch in common.slices(batches):
            for conv, _, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in mask:
                    learned = unescape(text[span["begin"] : span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            yield emit()
        close()
        yield emit()

    return common.map_arrow(dealt, run, schema)
