"""Loading of delimited lines that may be damaged: a minimum-cost error parse.

A line is read by an automaton over three kinds of characters (quote, delimiter, any other).  Inserting or deleting
a quote or a delimiter costs 1; dynamic programming over (field, state) finds the cheapest way to well-quoted fields of
any number, and to the wanted number.  Lines of cost 0 whose fields have valid types are loaded.  Of the others the
edits state the reason: a line that needs any for its quoting fails for that, else one that needs any for the number of
fields; the type check of the fields follows.  The programme runs on many lines at once, a token of each at a step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, DELIMITER, OTHER = 0, 1, 2
#: States: at a field's start, in an unquoted field, in a quoted one, after a quote within a quoted one, error.
START, PLAIN, QUOTED, CLOSED, ERROR = range(5)
#: By state and kind of character: the next state.  A delimiter that leads to START begins the next field.
NEXT = np.array(
    [
        [QUOTED, START, PLAIN],
        [ERROR, START, PLAIN],
        [CLOSED, QUOTED, QUOTED],
        [QUOTED, START, ERROR],
        [ERROR, ERROR, ERROR],
    ],
    dtype=np.uint8,
)
#: Cost of what can't be.
FAR = 1 << 20
#: Cells of a block of lines that are read together; longer lines are read by themselves.
CELLS = 1 << 22
LONG = 1 << 15
#: Bytes of the way back of lines that are parsed together; a longer line is parsed by itself.
TRAIL = 1 << 25

_TOKENS = re.compile(r'"|,|[^",]+', re.S)


def _tokens(line: str) -> list[tuple[int, int]]:
    """(kind, position) of each quote, delimiter and run of other characters."""
    return [(QUOTE if m[0] == '"' else DELIMITER if m[0] == "," else OTHER, m.start()) for m in _TOKENS.finditer(line)]


def _zero_cost_single(line: str) -> tuple[int, list[int]]:
    state, cuts = START, []
    for kind, at in _tokens(line):
        if kind == DELIMITER and NEXT[state, kind] == START:
            cuts.append(at)
        state = int(NEXT[state, kind])
    return state, cuts


def zero_cost(lines: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray | list[int]]]:
    """Of each line the state at its end when nothing is edited, and the positions of the delimiters between fields.

    This is the layer of cost 0 of the dynamic programme, for many lines at once.
    """
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    states = np.zeros(len(lines), dtype=np.uint8)
    cuts: list = [[] for _ in lines]
    order = np.argsort(sizes, kind="stable")
    begin = 0
    while begin < len(order):
        if sizes[order[begin]] > LONG:
            for i in order[begin:]:
                states[i], cuts[i] = _zero_cost_single(lines[i])
            break
        end = begin + 1
        while end < len(order) and sizes[order[end]] <= LONG and (end + 1 - begin) * (sizes[order[end]] + 1) <= CELLS:
            end += 1
        rows = order[begin:end]
        width = int(sizes[rows[-1]])
        codes = np.frombuffer("".join(lines[i] for i in rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = np.arange(width)[None, :] < sizes[rows][:, None]
        kinds = np.full((len(rows), width), 3, dtype=np.uint8)
        kinds[inside] = np.where(codes == 34, QUOTE, np.where(codes == 44, DELIMITER, OTHER))
        table = np.concatenate([NEXT, np.arange(5, dtype=np.uint8)[:, None]], axis=1)  # kind 3: past the end
        state = np.zeros(len(rows), dtype=np.uint8)
        breaks = np.zeros((width, len(rows)), dtype=bool)
        columns = np.ascontiguousarray(kinds.T)
        for j in range(width):
            after = table[state, columns[j]]
            breaks[j] = (columns[j] == DELIMITER) & (after == START)
            state = after
        states[rows] = state
        row, at = np.nonzero(breaks.T)
        for i, found in zip(rows, np.split(at, np.searchsorted(row, np.arange(1, len(rows)))), strict=True):
            cuts[i] = found
        begin = end
    return states, cuts


class Programme(NamedTuple):
    """The steps of the dynamic programme for lines of ``fields`` fields.

    A place is 4 * fields read + state; behind the wanted fields all further ones share four places.  ``begin`` is the
    cost of each place before the first token, ``step`` by kind of token, place before and place after it that of the
    token and of what is inserted behind it.
    """

    fields: int
    begin: np.ndarray
    step: np.ndarray
    insertion: np.ndarray  # by place before and after: the first place on the cheapest way of insertions, and what

    def accepted(self, all_numbers: bool) -> list[int]:
        numbers = range(self.fields + 1) if all_numbers else [self.fields - 1]
        return [4 * f + s for f in numbers for s in (START, PLAIN, CLOSED)]


def _after(place: int, kind: int, fields: int) -> int | None:
    f, s = divmod(place, 4)
    t = int(NEXT[s, kind])
    return None if t == ERROR else 4 * min(f + (kind == DELIMITER and t == START), fields) + t


@cache
def programme(fields: int) -> Programme:
    n = 4 * (fields + 1)
    reach = np.full((n, n), FAR, dtype=np.int32)
    np.fill_diagonal(reach, 0)
    way = np.zeros((n, n, 2), dtype=np.int16)
    for x in range(n):
        layer = [x]
        while layer:  # a quote is tried first
            following = []
            for y in layer:
                for kind in (QUOTE, DELIMITER):
                    z = _after(y, kind, fields)
                    # An inserted delimiter must end a field.
                    if z is None or (kind == DELIMITER and z % 4 != START) or reach[x, z] < FAR:
                        continue
                    reach[x, z] = reach[x, y] + 1
                    way[x, z] = way[x, y] if y != x else (z, kind)
                    following.append(z)
            layer = following
    step = np.full((3, n, n), FAR, dtype=np.int32)
    for kind in (QUOTE, DELIMITER, OTHER):
        for x in range(n):
            z = _after(x, kind, fields)
            if z is not None:
                step[kind, x] = reach[z]
            if kind != OTHER:
                step[kind, x] = np.minimum(step[kind, x], reach[x] + 1)
    return Programme(fields, reach[0].copy(), np.minimum(step, FAR), way)


def _inserted(p: Programme, x: int, y: int) -> list[str]:
    out = []
    while x != y:
        x, kind = p.insertion[x, y].tolist()
        out.append("insert quote" if kind == QUOTE else "insert delimiter")
    return out


@cache
def _step_edits(fields: int, kind: int, x: int, y: int) -> tuple[str | None, tuple[str, ...]]:
    """What a step does: the token's deletion, if it is deleted, and what is inserted behind it."""
    p = programme(fields)
    z = _after(x, kind, fields)
    kept = [] if z is None else _inserted(p, z, y) if z == y or p.insertion[z, y].any() else None
    if z is not None and kept is not None and len(kept) == p.step[kind, x, y]:
        return None, tuple(kept)
    return ("delete quote" if kind == QUOTE else "delete delimiter"), tuple(_inserted(p, x, y))


def parse_costs(lines: Sequence[str], fields: int, edits: bool = True) -> list[tuple[int, int, list[str]]]:
    """Of each line (the least edits for well-quoted fields of any number, those for ``fields`` fields, these edits).

    Edits are in order, such as ``delete quote at 7`` or ``insert delimiter at 31`` (characters from 0, of the line as it
    was).  Where several ways are the cheapest, the one over the lowest places is taken; without ``edits`` none are
    listed, and only one row of costs is held a line.
    """
    p = programme(fields)
    tokens = [_tokens(x) for x in lines]
    order = sorted(range(len(lines)), key=lambda i: len(tokens[i]))
    out: list = [None] * len(lines)
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * (len(tokens[order[end]]) + 1) * len(p.begin) <= TRAIL:
            end += 1
        for i, found in zip(order[begin:end], _parse_block([tokens[i] for i in order[begin:end]], [len(lines[i]) for i in order[begin:end]], p, edits), strict=True):
            out[i] = found
        begin = end
    return out


def _parse_block(tokens: list[list[tuple[int, int]]], sizes: list[int], p: Programme, edits: bool) -> list[tuple[int, int, list[str]]]:
    """The lines of one block, by rising number of tokens."""
    n, counts = len(tokens), np.array([len(t) for t in tokens])
    width = int(counts[-1])
    kinds = np.zeros((width, n), dtype=np.uint8)
    for i, t in enumerate(tokens):
        kinds[: len(t), i] = [k for k, _ in t]
    cost = np.tile(p.begin, (n, 1))
    back = np.zeros((width if edits else 0, n, len(p.begin)), dtype=np.uint8)
    for j in range(width):
        live = int(np.searchsorted(counts, j, side="right"))  # lines before it have ended
        ways = cost[live:, :, None] + p.step[kinds[j, live:]]
        if edits:
            came = ways.argmin(axis=1)
            back[j, live:] = came
            cost[live:] = np.take_along_axis(ways, came[:, None, :], axis=1)[:, 0]
        else:
            cost[live:] = ways.min(axis=1)
    quoted = cost[:, p.accepted(True)].min(axis=1)
    last = np.array(p.accepted(False))
    at = last[cost[:, last].argmin(axis=1)]
    exact = cost[np.arange(n), at]
    if not edits:
        return [(int(q), int(e), []) for q, e in zip(quoted, exact, strict=True)]
    path = np.zeros((width + 1, n), dtype=np.uint8)
    for j in range(width, 0, -1):
        ended = counts < j
        path[j] = at
        at = np.where(ended, at, back[j - 1, np.arange(n), at])
    path[0] = at
    out = []
    for i, t in enumerate(tokens):
        spots = [x for _, x in t] + [sizes[i]]
        found = [f"{e} at 0" for e in _inserted(p, 0, int(path[0, i]))]
        mine = path[: len(t) + 1, i]
        paid = np.flatnonzero(p.step[kinds[: len(t), i], mine[:-1], mine[1:]]) if t else []
        for j in paid:
            gone, put = _step_edits(p.fields, int(kinds[j, i]), int(mine[j]), int(mine[j + 1]))
            found += ([f"{gone} at {spots[j]}"] if gone else []) + [f"{e} at {spots[j + 1]}" for e in put]
        out.append((int(quoted[i]), int(exact[i]), found))
    return out


def cheapest_edits(line: str, fields: int) -> tuple[int, list[str]]:
    """The cost and the edits of one line."""
    _, cost, found = parse_costs([line], fields)[0]
    return cost, found


def _unquoted(field: str) -> str:
    return field[1:-1].replace('""', '"') if field[:1] == '"' else field


_GOOD_QUAL = re.compile(r"[!-~]*\Z")

#: The reasons, in the order in which they are looked for.
REASONS = ["quoting", "columns", "id", "unk", "qual"]


def _type_reason(fields: list[str]) -> str | None:
    name, seq, unk, qual = fields
    if not name.startswith("@"):
        return "id"
    if not unk.startswith("+"):
        return "unk"
    if len(qual) != len(seq) or not _GOOD_QUAL.match(qual):
        return "qual"
    return None


PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "seq", "unk", "qual", "reason")]
    + [T.StructField(n, T.IntegerType()) for n in ("quote_cost", "edit_cost")]
    + [T.StructField("edits", T.ArrayType(T.StringType()))]
)
#: Fields of a good line.
FIELDS = 4


def _parse(lines: list[str | None], want_edits: bool) -> dict[str, list]:
    texts = [(x[:-1] if x.endswith("\r") else x) if x is not None else "" for x in lines]
    states, cuts = zero_cost(texts)
    out: dict[str, list] = {f.name: [None] * len(texts) for f in PARSED.fields}
    damaged = []
    for i, (text, state, at) in enumerate(zip(texts, states.tolist(), cuts, strict=True)):
        if state in (QUOTED, ERROR) or len(at) != FIELDS - 1:
            damaged.append(i)
            continue
        a, b, c = at
        fields = [_unquoted(x) for x in (text[:a], text[a + 1 : b], text[b + 1 : c], text[c + 1 :])]
        reason = out["reason"][i] = _type_reason(fields)
        out["quote_cost"][i], out["edit_cost"][i], out["edits"][i] = 0, 0, []
        if reason is None:
            out["id"][i], out["seq"][i], out["unk"][i], out["qual"][i] = fields
    for i, (quoted, cost, edits) in zip(damaged, parse_costs([texts[i] for i in damaged], FIELDS, want_edits), strict=True):
        out["reason"][i] = "quoting" if quoted else "columns"
        out["quote_cost"][i], out["edit_cost"][i], out["edits"][i] = quoted, cost, edits
    return out


def _parser(want_edits: bool):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = _parse(part.column(1).to_pylist(), want_edits)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *[pa.array(found[n], pa.string()) for n in ("id", "seq", "unk", "qual", "reason")],
                    *[pa.array(found[n], pa.int32()) for n in ("quote_cost", "edit_cost")],
                    pa.array(found["edits"], pa.list_(pa.string())),
                ],
                names=["key", *[f.name for f in PARSED.fields]],
            )

    return batches


def parse_reads(lines: DataFrame, key: str = "raw_id", line: str = "raw_line", edits: bool = True) -> DataFrame:
    """Each line as (key, id, seq, unk, qual, reason, quote_cost, edit_cost, edits).

    A good line has a null reason and its four fields; one that fails has null fields and the first reason that
    holds of: quoting, columns, id, unk, qual.  Null and empty lines fail for columns.  One carriage return at the
    end isn't part of a line.  Repeated lines and keys stay as they are.  quote_cost is the least number of edits that
    make the quoting good, edit_cost that for four fields; a line that needs the first fails for quoting, one that needs
    only the second for columns.  One pass, no shuffle; without ``edits`` they are counted but not listed.
    """
    schema = T.StructType([T.StructField("key", lines.schema[key].dataType), *PARSED.fields])
    parsed = lines.select(F.col(f"`{key}`").alias("key"), F.col(f"`{line}`").alias("line")).mapInArrow(_parser(edits), schema)
    return parsed.withColumnRenamed("key", key)


def good(parsed: DataFrame) -> Column:
    return F.col("reason").isNull()
