"""Templates compiled into one Spark projection over a table of contexts.

Actions: `{{ .a.b }}`, `{{ . }}`, pipelines `{{ .a | trim | upper }}`, calls
`{{ join .list ", " }}`, text and number literals, `if` / `else if` / `else`,
`range` and `with` (both with `else`), comments and `{{-` `-}}`. Functions:
lower, upper, trim, join, len, eq, ne, not, and, or. Names are columns of the
table and fields of its structs, known when the template is compiled; an
unknown name, a function that does not fit and a block that is left open are
errors with their place.

An empty text, list or null, zero and false are false. A null prints as
`<no value>`, a boolean as true or false.

The compiled column is struct(content, spans): spans are (start, end, source,
line) of every printed piece, in characters, through all branches and loops.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, NumericType, StringType, StructType

_ACTION = re.compile(r"\{\{(-(?=\s))?\s*(/\*.*?\*/|(?:\"(?:\\.|[^\"\\])*\"|`[^`]*`|[^`\"])*?)\s*((?<=\s)-)?\}\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>\"(?:\\.|[^\"\\])*\"|`[^`]*`)|(?P<number>-?\d+(?:\.\d+)?)|(?P<field>(?:\.\w+)+|\.)|(?P<name>\w+)|(?P<mark>[|()]))")
_SPACE = " \t\r\n"


class TemplateError(ValueError):
    """A template that cannot be compiled; names the source and line."""


@dataclass
class _Node:
    kind: str
    at: int
    body: str = ""
    then: list = field(default_factory=list)
    other: list = field(default_factory=list)


@dataclass(frozen=True)
class _Value:
    column: Column
    type: DataType


class Template:
    """Sources (path, text), joined as they stand; places in the result are those of the sources."""

    def __init__(self, *sources: tuple[str, str]):
        self.text, self.starts = "", []
        for path, text in sources:
            self.starts.append((len(self.text), path))
            self.text += text
        self.nodes = self._parse()

    def place(self, at: int) -> tuple[str, int]:
        start, path = max(s for s in self.starts if s[0] <= at) if self.starts else (0, "")
        # Of empty sources that begin at one place, the last has the text.
        path = [p for s, p in self.starts if s == start][-1] if self.starts else path
        return path, self.text.count("\n", start, at) + 1

    def error(self, at: int, what: str) -> TemplateError:
        path, line = self.place(at)
        return TemplateError(f"{path}:{line}: {what}")

    def _parse(self) -> list[_Node]:
        top: list[_Node] = []
        open_: list[tuple[_Node, list[_Node], int]] = []
        into, done, strip = top, 0, False
        for m in _ACTION.finditer(self.text):
            text, at = self.text[done : m.start()], done
            if strip:
                at, text = at + len(text) - len(text.lstrip(_SPACE)), text.lstrip(_SPACE)
            if m[1]:
                text = text.rstrip(_SPACE)
            if text:
                into.append(_Node("text", at, text))
            done, strip, body = m.end(), bool(m[3]), m[2].strip()
            word, _, rest = body.partition(" ")
            if body.startswith("/*"):
                continue
            if not body:
                raise self.error(m.start(), "an action is empty")
            if word in ("if", "range", "with"):
                node = _Node(word, m.start(), rest.strip())
                into.append(node)
                open_.append((node, into, 1))
                into = node.then
            elif word == "else":
                if not open_ or into is open_[-1][0].other:
                    raise self.error(m.start(), "else without a block")
                node, outer, depth = open_[-1]
                into = node.other
                if rest.strip():
                    kind, _, cond = rest.strip().partition(" ")
                    if kind != "if" or node.kind != "if":
                        raise self.error(m.start(), "only if may follow else")
                    inner = _Node("if", m.start(), cond.strip())
                    into.append(inner)
                    open_[-1] = (inner, outer, depth)
                    into = inner.then
            elif word == "end":
                if not open_:
                    raise self.error(m.start(), "end without a block")
                _, into, _ = open_.pop()
            else:
                into.append(_Node("print", m.start(), body))
        if open_:
            raise self.error(open_[-1][0].at, f"{open_[-1][0].kind} has no end")
        rest = self.text[done:].lstrip(_SPACE) if strip else self.text[done:]
        if "{{" in rest:
            raise self.error(done + self.text[done:].index("{{"), "an action is not closed")
        if rest:
            top.append(_Node("text", len(self.text) - len(rest), rest))
        return top

    # --- Values ------------------------------------------------------------------

    def _field(self, node: _Node, dot: _Value, path: str) -> _Value:
        value = dot
        for name in path.split(".")[1:] if path != "." else ():
            fields = {f.name: f for f in value.type.fields} if isinstance(value.type, StructType) else {}
            if name not in fields:
                raise self.error(node.at, f"no field {name!r}")
            value = _Value(F.col(f"`{name}`") if value.column is None else value.column[name], fields[name].dataType)
        if value.column is None:
            raise self.error(node.at, "the whole context has no text")
        return value

    def _pipeline(self, node: _Node, dot: _Value) -> _Value:
        tokens, at = [], 0
        body = node.body
        while at < len(body.rstrip()):
            m = _TOKEN.match(body, at)
            if not m:
                raise self.error(node.at, f"cannot read {body[at:].strip()!r}")
            tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        value, rest = self._command(node, dot, tokens, None)
        while rest and rest[0] == ("mark", "|"):
            value, rest = self._command(node, dot, rest[1:], value)
        if rest:
            raise self.error(node.at, f"unexpected {rest[0][1]!r}")
        return value

    def _operand(self, node: _Node, dot: _Value, tokens: list) -> tuple[_Value, list]:
        kind, word = tokens[0]
        if kind == "text":
            raw = word[1:-1] if word[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1])
            return _Value(F.lit(raw), StringType()), tokens[1:]
        if kind == "number":
            return _Value(F.lit(float(word) if "." in word else int(word)), IntegerType()), tokens[1:]
        if kind == "field":
            return self._field(node, dot, word), tokens[1:]
        if (kind, word) == ("mark", "("):
            value, rest = self._command(node, dot, tokens[1:], None)
            while rest and rest[0] == ("mark", "|"):
                value, rest = self._command(node, dot, rest[1:], value)
            if not rest or rest[0] != ("mark", ")"):
                raise self.error(node.at, "a parenthesis is not closed")
            return value, rest[1:]
        raise self.error(node.at, f"unexpected {word!r}")

    def _command(self, node: _Node, dot: _Value, tokens: list, piped: _Value | None) -> tuple[_Value, list]:
        if not tokens:
            raise self.error(node.at, "an expression is missing")
        if tokens[0][0] != "name":
            if piped is not None:
                raise self.error(node.at, "a value takes no input")
            return self._operand(node, dot, tokens)
        name, rest, args = tokens[0][1], tokens[1:], []
        if name in ("true", "false"):
            return _Value(F.lit(name == "true"), BooleanType()), rest
        while rest and rest[0] not in (("mark", "|"), ("mark", ")")):
            value, rest = self._operand(node, dot, rest)
            args.append(value)
        if piped is not None:
            args.append(piped)
        return self._call(node, name, args), rest

    def _call(self, node: _Node, name: str, args: list[_Value]) -> _Value:
        text = all(isinstance(a.type, StringType) for a in args)
        one = {"lower": F.lower, "upper": F.upper, "trim": lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")}
        if name in one and len(args) == 1 and text:
            return _Value(one[name](args[0].column), StringType())
        if name == "join" and len(args) == 2 and isinstance(args[0].type, ArrayType) and isinstance(args[1].type, StringType):
            return _Value(F.call_function("array_join", args[0].column, args[1].column), StringType())
        if name == "len" and len(args) == 1 and isinstance(args[0].type, StringType | ArrayType):
            return _Value((F.octet_length if text else F.size)(args[0].column), IntegerType())
        if name in ("eq", "ne") and len(args) == 2:
            same = args[0].column.eqNullSafe(args[1].column)
            return _Value(same if name == "eq" else ~same, BooleanType())
        if name == "not" and len(args) == 1:
            return _Value(~self._truth(args[0]), BooleanType())
        if name in ("and", "or") and len(args) >= 2:
            if len({type(a.type) for a in args}) > 1:
                # Values of several types have no common one; what is left of them is whether they are true.
                args = [_Value(self._truth(a), BooleanType()) for a in args]
            # The first false one, or the last; the first true one, or the last.
            chosen = args[-1].column
            for a in reversed(args[:-1]):
                t = self._truth(a)
                chosen = F.when(~t if name == "and" else t, a.column).otherwise(chosen)
            return _Value(chosen, args[-1].type)
        raise self.error(node.at, f"no function {name!r} for {len(args)} such values")

    @staticmethod
    def _truth(v: _Value) -> Column:
        c = v.column
        if isinstance(v.type, BooleanType):
            full = c
        elif isinstance(v.type, StringType):
            full = c != ""
        elif isinstance(v.type, NumericType):
            full = c != 0
        elif isinstance(v.type, ArrayType):
            full = F.size(c) > 0
        else:
            full = c.isNotNull()
        return F.coalesce(full, F.lit(False))

    # --- Output ------------------------------------------------------------------

    def _body(self, node: _Node, item: DataType):
        return lambda x: self._emit(node.then, _Value(x, item))

    def _emit(self, nodes: list[_Node], dot: _Value) -> Column:
        """array<struct<text, at>> of the nodes' output."""
        piece = lambda c, at: F.array(F.struct(c.alias("text"), F.lit(at).alias("at")))
        none = F.array().cast("array<struct<text: string, at: int>>")
        out = []
        for n in nodes:
            if n.kind == "text":
                out.append(piece(F.lit(n.body), n.at))
                continue
            value = self._pipeline(n, dot)
            if n.kind == "print":
                if isinstance(value.type, ArrayType | StructType):
                    raise self.error(n.at, "lists and records have no text; use join or a field")
                out.append(piece(F.coalesce(value.column.cast("string"), F.lit("<no value>")), n.at))
            elif n.kind == "range":
                if not isinstance(value.type, ArrayType):
                    raise self.error(n.at, "range needs a list")
                each = F.flatten(F.transform(value.column, self._body(n, value.type.elementType)))
                out.append(F.when(self._truth(value), each).otherwise(self._emit(n.other, dot)))
            else:
                inner = value if n.kind == "with" else dot
                out.append(F.when(self._truth(value), self._emit(n.then, inner)).otherwise(self._emit(n.other, dot)))
        return F.concat(*out) if len(out) > 1 else out[0] if out else none

    def column(self, schema: StructType) -> Column:
        """struct(content, spans) for rows of this schema."""
        pieces = F.filter(self._emit(self.nodes, _Value(None, schema)), lambda p: p["text"] != "")
        places = sorted({p for n in _walk(self.nodes) for p in [n.at]})
        known = F.create_map(*[x for at in places for x in (F.lit(at), F.struct(F.lit(self.place(at)[0]).alias("source"), F.lit(self.place(at)[1]).alias("line")))]) if places else None
        if known is None:
            return F.struct(F.lit("").alias("content"), F.array().cast("array<struct<start: int, end: int, source: string, line: int>>").alias("spans"))
        ends = F.aggregate(pieces, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.char_length(p["text"]))))
        span = lambda p, end: F.struct((end - F.char_length(p["text"])).alias("start"), end.alias("end"), known[p["at"]]["source"].alias("source"), known[p["at"]]["line"].alias("line"))
        return F.struct(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("content"), F.zip_with(pieces, ends, span).alias("spans"))


def _walk(nodes: list[_Node]):
    for n in nodes:
        yield n
        yield from _walk(n.then)
        yield from _walk(n.other)


def render(contexts, *sources: tuple[str, str], name: str = "rendered"):
    """contexts with the rendered template as a struct column."""
    return contexts.withColumn(name, Template(*sources).column(contexts.schema))
