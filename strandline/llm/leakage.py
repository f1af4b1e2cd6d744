"""Evaluation passages in training texts: winnowed fingerprints, a join, and extension of the hits.

Every text keeps the least hash of k words in each window of w such hashes; two texts that share k + w - 1 words
in a row keep a common hash.  The fingerprints of documents and items are joined, and each hit is extended word
by word to both sides.  Items too short for a window give one fingerprint of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.wordgrams import Known, chunked, grams, grams_of, winnow, words_of
from strandline.session import cut_lineage

#: Words in a row that make a case.
SPAN = 13
#: Words of a fingerprint; the window follows: SPAN - GRAM + 1 fingerprints.
GRAM = 5
#: Item fingerprints up to this number, of passages of so many bytes, are met in the scan (30 MB at most); more are joined.
BROADCAST_FINGERPRINTS, SCAN_BYTES = 200_000, 8 << 20
#: Hits that are extended together.
HITS = 1 << 19
#: Bytes of passages, and texts with hits, up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES, BROADCAST_TEXTS = 64 << 20, 500_000
#: Parts into which the rows of one fingerprint are divided when they are joined.
SALTS = 8

_PRINTS = T.ArrayType(T.StructType([T.StructField("print", T.LongType()), T.StructField("at", T.IntegerType())]))


def _spans(words: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed fingerprints of one text; none if it has fewer words than a span."""
    if len(words) < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = grams(words, gram)
    at = winnow(hashes, span - gram + 1)
    return at, hashes[at]


def item_fingerprints(items: DataFrame, item_id: str, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(item, words, print, at) of each item; an item of fewer words than ``span`` has one print of all its words.

    Items without words have none.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0), part.column(1).to_pylist()
            rows, counts, prints, ats = [], [], [], []
            for begin, end in chunked(texts):
                hashes, bounds = words_of(texts[begin:end])
                for i in range(begin, end):
                    own = hashes[bounds[i - begin] : bounds[i - begin + 1]]
                    at, found = (np.zeros(1, dtype=np.int64), grams(own, len(own))) if 0 < len(own) < span else _spans(own, span, gram)
                    rows.append(np.full(len(at), i))
                    counts.append(np.full(len(at), len(own)))
                    prints.append(found)
                    ats.append(at)
            take = np.concatenate(rows or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(take)), pa.array(_joined(counts, np.int64).astype(np.int32)), pa.array(_joined(prints, np.uint64).view(np.int64)), pa.array(_joined(ats, np.int64).astype(np.int32))],
                names=["item", "words", "print", "at"],
            )

    schema = T.StructType([T.StructField("item", items.schema[item_id].dataType), T.StructField("words", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("at", T.IntegerType())])
    return items.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull()).mapInArrow(batches, schema)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, dtype=kind)


def _prints_in(texts: list, span: int, gram: int, lengths: list[int], known: dict[int, Known] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, fingerprint) of the winnowed fingerprints and of all ``lengths`` words in a row; words and bounds.

    With ``known`` (by number of words; the winnowed ones under 0) only those that items have; a text none of whose
    words in a row is known isn't winnowed.  Places count through the words of all texts.
    """
    hashes, bounds = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    prints, ats = [], []
    found = grams_of(hashes, sorted({gram, *lengths}))
    due = range(len(texts)) if known is None else np.unique(owner[known[0].spots(found[gram])]).tolist() if 0 in known else []
    for i in due:
        begin, end = bounds[i], bounds[i + 1]
        if end - begin >= span:
            own = found[gram][begin : end - gram + 1]
            at = winnow(own, span - gram + 1)
            if known is not None:
                at = at[known[0].spots(own[at])]
            ats.append(begin + at)
            prints.append(own[at])
    for n in lengths:
        at = np.arange(len(found[n])) if known is None else known[n].spots(found[n])
        at = at[owner[at] == owner[at + n - 1]]
        ats.append(at)
        prints.append(found[n][at])
    place = _joined(ats, np.int64)
    return owner[place], place, _joined(prints, np.uint64), hashes, bounds


def _document_prints(span: int, gram: int, lengths: list[int]):
    """An Arrow function text -> fingerprints with their places."""

    def of_chunk(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place, values, _, bounds = _prints_in(texts, span, gram, lengths, None)
        order = np.argsort(row, kind="stable")
        return np.bincount(row, minlength=len(texts)), (place - bounds[row])[order].astype(np.int32), values[order].view(np.int64)

    @F.arrow_udf(_PRINTS)
    def prints_of(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        parts = [of_chunk(texts[a:b]) for a, b in chunked(texts)]
        values = pa.StructArray.from_arrays([pa.array(_joined([p[2] for p in parts], np.int64)), pa.array(_joined([p[1] for p in parts], np.int32))], names=["print", "at"])
        return pa.ListArray.from_arrays(_offsets([p[0] for p in parts], len(texts)), values)

    return prints_of


def _offsets(counts: list[np.ndarray], n: int) -> pa.Array:
    out = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(_joined(counts, np.int64), out=out[1:])
    return pa.array(out)


class Passages:
    """The words of few passages with their fingerprints, small enough to go to every scan of texts."""

    def __init__(self, passages: list[str], span: int, gram: int):
        self.span, self.gram = span, gram
        self.words, self.bounds = words_of(passages)
        sizes = np.diff(self.bounds)
        items, ats, prints, kinds = [], [], [], []
        for i, n in enumerate(sizes.tolist()):
            own = self.words[self.bounds[i] : self.bounds[i + 1]]
            at, found = (np.zeros(1, dtype=np.int64), grams(own, n)) if 0 < n < span else _spans(own, span, gram)
            items.append(np.full(len(at), i))
            ats.append(at + self.bounds[i])
            prints.append(found)
            kinds.append(np.full(len(at), n if n < span else 0))
        prints_all, kinds_all = _joined(prints, np.uint64), _joined(kinds, np.int64)
        order = np.argsort(prints_all, kind="stable")
        self.prints, self.items, self.places = prints_all[order], _joined(items, np.int64)[order], _joined(ats, np.int64)[order]
        self.known = {int(n): Known(prints_all[kinds_all == n]) for n in np.unique(kinds_all)}
        self.lengths = [n for n in sorted(self.known) if n]

    def found_in(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(text, passage) of each passage that leaked into a text: hits of fingerprints, extended word by word."""
        row, place, values, words, bounds = _prints_in(texts, self.span, self.gram, self.lengths, self.known)
        first, last = (np.searchsorted(self.prints, values, side=s) for s in ("left", "right"))
        done: list[np.ndarray] = []
        ends = np.cumsum(last - first)
        begin = 0
        while begin < len(values):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS)))
            n = (last - first)[begin:end]
            doc = np.repeat(place[begin:end], n)
            own = np.repeat(first[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows, items, at = np.repeat(row[begin:end], n), self.items[own], self.places[own]
            shared = _run(words, doc - 1, self.words, at - 1, -1, self.span, bounds[rows], self.bounds[items])
            shared += _run(words, doc, self.words, at, 1, self.span, bounds[rows + 1], self.bounds[items + 1])
            good = shared >= np.minimum(self.span, self.bounds[items + 1] - self.bounds[items])
            done.append(np.unique(rows[good] * len(self.bounds) + items[good]))
            begin = end
        pairs = np.unique(_joined(done, np.int64))
        return pairs // len(self.bounds), pairs % len(self.bounds)


def _run(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, way: int, most: int, i_end: np.ndarray, j_end: np.ndarray) -> np.ndarray:
    """Equal words from i and j on, in one direction, up to ``most`` and to the bounds of both texts."""
    out = np.zeros(len(i), dtype=np.int64)
    live = np.arange(len(i))
    for step in range(most):
        a, b = i[live] + way * step, j[live] + way * step
        inside = (a < i_end[live]) & (b < j_end[live]) if way > 0 else (a >= i_end[live]) & (b >= j_end[live])
        live, a, b = live[inside], a[inside], b[inside]
        live = live[x[a] == y[b]]
        if not len(live):
            break
        out[live] += 1
    return out


def _leaked(passages: Passages):
    """An Arrow function text -> the numbers of the passages that leaked into it."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def leaked(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        counts, numbers = [], []
        for a, b in chunked(texts):
            row, item = passages.found_in(texts[a:b])
            counts.append(np.bincount(row, minlength=b - a))
            numbers.append(item)
        return pa.ListArray.from_arrays(_offsets(counts, len(texts)), pa.array(_joined(numbers, np.int64).astype(np.int32)))

    return leaked


def _extend(doc: np.ndarray, item: np.ndarray, doc_at: int, item_at: int, most: int) -> int:
    """Words in a row that both texts share around a hit, counted up to ``most`` on either side."""
    left = min(doc_at, item_at, most)
    same = doc[doc_at - left : doc_at][::-1] == item[item_at - left : item_at][::-1]
    before = left if same.all() else int(np.argmin(same))
    right = min(len(doc) - doc_at, len(item) - item_at, most)
    same = doc[doc_at : doc_at + right] == item[item_at : item_at + right]
    return before + (right if same.all() else int(np.argmin(same)))


def _extension(schema: T.StructType, span: int, gram: int):
    names = [f.name for f in schema.fields]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[str, np.ndarray] = {}
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for part in parts:
            docs, texts, item_ids, item_texts = (part.column(i) for i in range(4))
            doc_at, item_at = part.column(4).to_pylist(), part.column(5).to_pylist()
            doc_list, item_list = docs.to_pylist(), item_ids.to_pylist()
            keep, seen = [], set()
            for i in range(part.num_rows):
                if (doc_list[i], item_list[i]) in seen:
                    continue
                text = texts[i].as_py()
                if text != last[0]:
                    last = (text, words_of([text])[0])
                passage = item_texts[i].as_py()
                if passage not in items:
                    if len(items) > 10_000:
                        items.clear()
                    items[passage] = words_of([passage])[0]
                own = items[passage]
                if _extend(last[1], own, doc_at[i], item_at[i], span) >= min(span, len(own)):
                    seen.add((doc_list[i], item_list[i]))
                    keep.append(i)
            take = pa.array(np.array(keep, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([docs.take(take), item_ids.take(take)], names=names)

    return batches


def _digest(text: str) -> Column:
    return F.sha2(text, 256).substr(1, 32)


def _salted_hits(found: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of both with one print.  A print of a third of all texts is divided into SALTS parts."""
    parts = found.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int"))
    copies = target.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return parts.join(copies, ["print", "salt"]).drop("salt")


def _hit_texts(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(text_key, doc, text) of the documents whose text has a hit; texts without one aren't shuffled if few have any."""
    keyed = docs.withColumn("text_key", _digest("text"))
    keys = hits.select("text_key").distinct()
    few = keys.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    return keyed.join(F.broadcast(keys) if few else keys, "text_key", "left_semi")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, item_id) of each document that holds ``span`` words in a row of an item, or all of a shorter item.

    Null texts and texts without words are in no pair.  Repeated ids give one row, null ids are ids of their own.  Other
    columns of either table aren't read.  The items' fingerprints and bytes are counted first.  While they are few, the
    scan of the texts meets them in memory and extends the hits, so that only leaks leave it.  Beyond that fingerprints
    are joined, a frequent one in parts, and the texts with hits are found by a second scan.  Hits agree in 64-bit
    hashes of words, so a false pair has a chance of some 2^-60.
    """
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text")).where(F.col("text") != "")
    tests = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("passage")).where(F.col("passage").isNotNull())
    tests = tests.withColumn("key", _digest("passage")).dropDuplicates(["item", "passage"])
    prints = item_fingerprints(tests.select("key", "passage").distinct(), "key", "passage", span, gram)
    sizes = prints.groupBy(F.when(F.col("words") < span, F.col("words")).otherwise(0).alias("n")).agg(F.count(F.lit(1)).alias("prints")).collect()
    lengths = sorted(row["n"] for row in sizes if row["n"])
    target = prints.select(F.col("item").alias("key"), "print", F.col("at").alias("item_at")).distinct()
    schema = T.StructType([T.StructField(doc_id, docs.schema["doc"].dataType), T.StructField(item_id, tests.schema["item"].dataType)])
    heavy = tests.agg(F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("bytes")).first()["bytes"]
    if sum(row["prints"] for row in sizes) <= BROADCAST_FINGERPRINTS and heavy <= SCAN_BYTES:
        passages = sorted(r["passage"] for r in tests.select("passage").distinct().collect())
        numbers = docs.sparkSession.createDataFrame(list(enumerate(passages)), "number int, passage string")
        named = tests.join(F.broadcast(numbers), "passage").select("number", "item")
        found = docs.select("doc", F.explode(_leaked(Passages(passages, span, gram))("text")).alias("number"))
        return found.join(F.broadcast(named), "number").select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()
    texts = F.broadcast(tests) if heavy <= BROADCAST_BYTES else tests
    found = docs.select(_digest("text").alias("text_key"), F.inline(_document_prints(span, gram, lengths)("text")).alias("print", "at"))
    met = cut_lineage(_salted_hits(found, target).distinct())
    hits = met.join(texts, "key").join(_hit_texts(docs, met), "text_key")
    rows = hits.select("doc", "text", "item", "passage", F.col("at").alias("doc_at"), "item_at").mapInArrow(_extension(schema, span, gram), schema)
    return rows.distinct()
