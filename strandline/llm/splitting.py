"""Cutting of oversized items by a recursive hierarchy of separators, and greedy packing with overlap.

An item is a row of units with a size each; before a unit stands a separator of some level, the coarsest 1, or none.
Runs between separators of a level are divided at the next level as long as they are too large (or, if pieces must be
filled up, as far as separators go); the runs are then packed in order.  Texts are cut at sections, paragraphs,
sentences, words and characters; other items bring their own levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of the separators of a text.
SECTION, PARAGRAPH, SENTENCE, WORD, CHARACTER = 1, 2, 3, 4, 5


def runs(sizes: Sequence[int], levels: Sequence[int | None], whole: int, deepest: int) -> Iterator[tuple[int, int]]:
    """[begin, end) of the runs of units that aren't divided: those of at most ``whole``, or without a separator.

    Each unit is looked at once a level.
    """

    def divided(begin: int, end: int, level: int) -> Iterator[tuple[int, int]]:
        if level > deepest or end - begin < 2 or sum(sizes[begin:end]) <= whole:
            yield begin, end
            return
        first = begin
        for i in range(begin + 1, end + 1):
            if i == end or levels[i] == level:
                yield from divided(first, i, level + 1)
                first = i

    if sizes:
        yield from divided(0, len(sizes), 1)


def packed(sizes: Sequence[int], found: Sequence[tuple[int, int]], limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """[begin, end) of the pieces: runs in order as long as they fit; a run that is larger than ``limit`` is a piece.

    A piece begins with the last runs of the one before it that together keep within ``overlap`` and leave room for
    the next run.
    """
    lengths = [sum(sizes[a:b]) for a, b in found]
    out: list[tuple[int, int]] = []
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > limit:
            out.append((found[begin][0], found[i][0]))
            begin, total = i, 0
            back = 0
            while begin and back + lengths[begin - 1] <= overlap and back + lengths[begin - 1] + n <= limit and found[begin - 1][0] > out[-1][0]:
                begin -= 1
                back += lengths[begin]
            total = back
        total += n
    if found:
        out.append((found[begin][0], found[-1][1]))
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def filled_cuts(sizes: pa.Array, levels: pa.Array, limit: pa.Array) -> pa.Array:
    """The numbers (from 0) of the units before which a piece begins, but the first: pieces are filled to the limit, so runs
    are divided at every separator."""
    out = []
    for s, v, m in zip(sizes.to_pylist(), levels.to_pylist(), limit.to_pylist(), strict=True):
        depth = max((x for x in v if x is not None), default=0)
        out.append([a for a, _ in packed(s, list(runs(s, v, -1, depth)), m)][1:])
    return pa.array(out, pa.list_(pa.int32()))


_SECTION = re.compile(r"\n[ \t\r]*\n\s*")
_UNIT = re.compile(r"\S+\s*|\s+")
_SENTENCE_END = re.compile(r"[.!?;:]['\")\]]*\s+$")


def units_of(text: str, limit: int) -> tuple[list[int], list[int | None]]:
    """Sizes in characters and levels of a text's units: words with the white space behind them, long ones by character."""
    sizes: list[int] = []
    levels: list[int | None] = []
    before: int | None = None
    for m in _UNIT.finditer(text):
        unit = m[0]
        if len(unit) > limit:
            sizes += [1] * len(unit)
            levels += [before] + [CHARACTER] * (len(unit) - 1)
        else:
            sizes.append(len(unit))
            levels.append(before)
        tail = unit[len(unit.rstrip()) :]
        before = SECTION if _SECTION.search(tail) else PARAGRAPH if "\n" in tail else SENTENCE if _SENTENCE_END.search(unit) else WORD
    return sizes, levels


def pieces_of(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """[begin, end) in characters of a text's pieces, each of at most ``limit``; together they cover the text."""
    sizes, levels = units_of(text, limit)
    places = [0]
    for n in sizes:
        places.append(places[-1] + n)
    return [(places[a], places[b]) for a, b in packed(sizes, list(runs(sizes, levels, limit, CHARACTER)), limit, overlap)]


def text_pieces(documents: DataFrame, limit: int, overlap: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece_no, begin, piece): every text in pieces of at most ``limit`` characters, whole texts included.

    Consecutive pieces share up to ``overlap`` characters, cut at separators too.  Null and empty texts have no pieces;
    null and repeated ids keep theirs; other columns aren't read.  One pass, no shuffle; a text is held as a whole.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("piece", T.StringType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, body in enumerate(part.column(1).to_pylist()):
                spans = pieces_of(body, limit, overlap)
                ids = part.column(0).take(pa.array([i] * len(spans), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(spans)), pa.int32()), pa.array([a for a, _ in spans], pa.int32()), pa.array([body[a:b] for a, b in spans])], names=schema.names)

    rows = documents.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("__text")).where(F.col("__text") != "")
    return rows.mapInArrow(batches, schema)
