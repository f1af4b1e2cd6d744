"""The record filter language, compiled to a Catalyst expression.

    paired && !duplicate && (mapping_quality >= 30 || re(rec_name, "^MX"))

Integers (decimal, 0x, 0o, 0b), strings, names of the record's fields, ``re(field, "pattern")``, ``! && ||``,
``== != < <= > >=`` and parentheses.  The whole must be a condition.  Nothing is evaluated in Python: the result is
a Column that Spark pushes down where it can.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import align

STRING_FIELDS = {"ref_name": "ref_name", "mate_ref_name": "mate_ref_name", "rec_name": "read_name"}
INT_FIELDS = {
    "ref_id": "ref_id",
    "position": "pos",
    "mate_ref_id": "mate_ref_id",
    "mate_position": "mate_pos",
    "mapping_quality": "mapq",
    "template_length": "template_length",
}


class FilterError(ValueError):
    """The expression isn't valid."""


@dataclass(frozen=True)
class _Token:
    kind: str
    text: str
    at: int


_LEXER = re.compile(
    r"""\s*(?:(?P<int>0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+|[0-9]+)
      |(?P<string>"(?:[^"\\]|\\.)*"|`[^`]*`)
      |(?P<name>[A-Za-z_][A-Za-z_0-9]*)
      |(?P<op>&&|\|\||==|!=|<=|>=|[!<>(),\-]))""",
    re.X,
)


def _tokens(text: str) -> list[_Token]:
    out, at = [], 0
    while text[at:].strip():
        m = _LEXER.match(text, at)
        if not m:
            raise FilterError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        out.append(_Token(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    return [*out, _Token("end", "", len(text))]


@dataclass(frozen=True)
class _Typed:
    kind: str
    column: Column


class _Parser:
    """Recursive descent: or, and, comparison, unary, primary."""

    def __init__(self, text: str):
        self.tokens, self.i = _tokens(text), 0

    @property
    def now(self) -> _Token:
        return self.tokens[self.i]

    def take(self, *ops: str) -> str | None:
        if self.now.kind == "op" and self.now.text in ops:
            self.i += 1
            return self.tokens[self.i - 1].text
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise FilterError(f"expected {op!r} at {self.now.at}")

    @staticmethod
    def want(value: _Typed, kind: str, what: str) -> Column:
        if value.kind != kind:
            raise FilterError(f"{what} needs a {kind}, not a {value.kind}")
        return value.column

    def whole(self) -> Column:
        value = self.either()
        if self.now.kind != "end":
            raise FilterError(f"unexpected {self.now.text!r} at {self.now.at}")
        return self.want(value, "bool", "a filter")

    def either(self) -> _Typed:
        left = self.both()
        while self.take("||"):
            left = _Typed("bool", self.want(left, "bool", "||") | self.want(self.both(), "bool", "||"))
        return left

    def both(self) -> _Typed:
        left = self.comparison()
        while self.take("&&"):
            left = _Typed("bool", self.want(left, "bool", "&&") & self.want(self.comparison(), "bool", "&&"))
        return left

    def comparison(self) -> _Typed:
        left = self.unary()
        op = self.take("==", "!=", "<=", ">=", "<", ">")
        if not op:
            return left
        right = self.unary()
        if left.kind != right.kind:
            raise FilterError(f"{op} compares a {left.kind} with a {right.kind}")
        if left.kind == "bool" and op not in ("==", "!="):
            raise FilterError(f"{op} doesn't order conditions")
        a, b = left.column, right.column
        return _Typed("bool", {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])

    def unary(self) -> _Typed:
        if self.take("!"):
            return _Typed("bool", ~self.want(self.unary(), "bool", "!"))
        if self.take("-"):
            return _Typed("int", -self.want(self.unary(), "int", "-"))
        return self.primary()

    def primary(self) -> _Typed:
        token = self.now
        if self.take("("):
            value = self.either()
            self.need(")")
            return value
        self.i += 1
        if token.kind == "int":
            text = token.text
            return _Typed("int", F.lit(int(text, 8 if re.fullmatch("0[0-7]+", text) else 0)).cast("bigint"))
        if token.kind == "string":
            return _Typed("string", F.lit(_unescaped(token.text)))
        if token.kind == "name":
            return self.call() if token.text == "re" else _field(token)
        raise FilterError(f"unexpected {token.text or 'end'!r} at {token.at}")

    def call(self) -> _Typed:
        self.need("(")
        subject = self.want(self.either(), "string", "re()")
        self.need(",")
        if self.now.kind != "string":
            raise FilterError("the pattern of re() must be a string")
        pattern = _unescaped(self.now.text)
        self.i += 1
        self.need(")")
        return _Typed("bool", subject.rlike(pattern))


def _unescaped(text: str) -> str:
    return text[1:-1] if text[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}.get(m[1], m[0]), text[1:-1])


def _field(token: _Token) -> _Typed:
    name = token.text
    if name in STRING_FIELDS:
        return _Typed("string", F.col(STRING_FIELDS[name]))
    if name in INT_FIELDS:
        return _Typed("int", F.col(INT_FIELDS[name]).cast("bigint"))
    if name == "sequence_length":
        return _Typed("int", F.when(F.col("seq") == "*", 0).otherwise(F.length("seq")).cast("bigint"))
    if name in align.FLAG_NAMES:
        return _Typed("bool", align.has_flag(F.col("flags"), align.FLAG_NAMES[name]))
    if name == "chimeric":
        return _Typed("bool", align.chimeric(F.col("flags"), F.col("ref_id"), F.col("mate_ref_id")))
    raise FilterError(f"unknown name {name!r} at {token.at}")


def compile_filter(text: str) -> Column:
    """The condition that the text states; raises FilterError if it states none.

    Fields that are null make a comparison null, so such records don't pass.
    """
    return _Parser(text).whole()


# Regions

#: The end of a region without one.
MAX_POS = 2_147_483_646


def parse_region(text: str) -> tuple[str, int, int]:
    """`ref`, `ref:pos` or `ref:first-last` (from 1, both ends included) as (ref, start, end), from 0, end excluded."""
    m = re.fullmatch(r"([^:]+)(?::(\d[\d,]*)(?:-(\d[\d,]*))?)?", text)
    if not m:
        raise FilterError(f"no region: {text!r}")
    if m[2] is None:
        return m[1], 0, MAX_POS
    first = int(m[2].replace(",", ""))
    last = int(m[3].replace(",", "")) if m[3] else first
    if first < 1 or last < first or (m[3] and last == first):
        raise FilterError(f"no positions: {text!r}")
    return m[1], first - 1, last


_CLOSED = re.compile(r"([^:,]*):(\d+)-(\d+)")
_HALF_OPEN = re.compile(r"([^:,]*):(\d+)(?::(\d+))?-([^:,]*):(\d+)(?::(\d+))?")


def compile_regions(text: str, references: list[str]) -> Column:
    """A condition on (ref_id, pos): any of the comma-separated regions.

    `chr:begin-end` counts from 1 and includes both ends; `chr:pos-chr:pos` (each with an optional `:seq`, which
    needs a column ``seq_no`` if not 0) counts from 0 and excludes the end.  An empty or `*` name is the unmapped
    region, after all references.
    """
    numbers = {name: i for i, name in enumerate(references)} | {"": -1, "*": -1}
    here = align.coordinate(F.col("ref_id"), align.record_position(F.col("ref_id"), F.col("pos")))
    out = None
    for part in text.split(","):
        if m := _CLOSED.fullmatch(part):
            low, high = (m[1], int(m[2]) - 1, 0), (m[1], int(m[3]), 0)
        elif m := _HALF_OPEN.fullmatch(part):
            low, high = (m[1], int(m[2]), int(m[3] or 0)), (m[4], int(m[5]), int(m[6] or 0))
        else:
            raise FilterError(f"no region: {part!r}")
        if low[0] not in numbers or high[0] not in numbers:
            raise FilterError(f"unknown reference in {part!r}")
        at = here if not (low[2] or high[2]) else align.coordinate(F.col("ref_id"), align.record_position(F.col("ref_id"), F.col("pos")), F.col("seq_no"))
        bounds = [align.coordinate(F.lit(numbers[name]), F.lit(pos), F.lit(seq)) for name, pos, seq in (low, high)]
        same = numbers[low[0]] == numbers[high[0]]
        # Plain comparisons on the columns reach the scan; the struct decides.
        scan = (F.col("ref_id") == numbers[low[0]]) if same else F.lit(True)
        inside = scan & (at >= bounds[0]) & (at < bounds[1])
        out = inside if out is None else out | inside
    return out
