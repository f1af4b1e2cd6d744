"""Plans of shards: by the bytes that an index tells of, by blocks of a shard index, by positions; their validation.

Plans are lists of small size, so they are made of plain numbers; the plans of many files at once run as streams over
sorted partitions that hold one open shard each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandline.functions import align
from strandline.session import shuffle_partitions
from strandline.sources.binary import BinIndex, Entry

#: The unmapped reference sorts behind all others.
LAST = 2_147_483_647


@dataclass(frozen=True)
class Shard:
    """[start, limit) of coordinates (ref, pos), a number, and the positions by which it is widened; ref -1 is unmapped."""

    start_ref: int
    start: int
    limit_ref: int
    limit: int
    number: int = 0
    padding: int = 0

    def range(self) -> tuple[tuple[int, int], tuple[int, int]]:
        """Both ends as numbers that compare as coordinates do."""
        return (_rank(self.start_ref), self.start), (_rank(self.limit_ref), self.limit)

    def holds(self, ref: int, pos: int, padded: bool = False) -> bool:
        """Whether a coordinate lies in the shard, or in it and its padding."""
        (a, start), (b, limit) = self.range()
        wide = self.padding if padded else 0
        return (a, max(start - wide, 0)) <= (_rank(ref), pos) < (b, limit + wide)

    def in_start_padding(self, ref: int, pos: int) -> bool:
        return self.holds(ref, pos, padded=True) and (_rank(ref), pos) < self.range()[0]


def _rank(ref: int) -> int:
    return ref if ref >= 0 else LAST


def unmapped_shard(number: int) -> Shard:
    return Shard(-1, 0, -1, LAST, number)


def validated(shards: Sequence[Shard]) -> list[Shard]:
    """The shards, if each one isn't empty, begins behind the one before it, and has no negative padding."""
    before = None
    for s in shards:
        start, limit = s.range()
        if start >= limit:
            raise ValueError(f"shard {s.number} is empty or inverted")
        if before is not None and start <= before:
            raise ValueError(f"shard {s.number} doesn't begin behind the one before it")
        if s.padding < 0:
            raise ValueError("padding must not be negative")
        before = start
    return list(shards)


def _finished(bounds: Sequence[tuple[int, int]], lengths: Sequence[int], last_ref: int, padding: int, unmapped: bool) -> list[Shard]:
    ends = [*bounds[1:], (last_ref, lengths[last_ref])] if bounds else []
    shards = [Shard(*a, *b, i, padding) for i, (a, b) in enumerate(zip(bounds, ends, strict=True))]
    return validated(shards + ([unmapped_shard(len(shards))] if unmapped else []))


def cuts_of_entries(entries: Iterable[Entry], lengths: Sequence[int], bytes_per_shard: int, least_bases: int) -> Iterator[Entry]:
    """The entries at which a shard begins: the first one (at position 0 of its reference), and each that lies enough
    compressed bytes and enough bases behind the last such entry.  Unmapped entries begin none."""
    before = [0]
    for n in lengths:
        before.append(before[-1] + n)
    last: tuple[int, int] | None = None
    for e in entries:
        if e.ref_id < 0:
            continue
        if last is None:
            last = (before[e.ref_id], e.offset >> 16)
            yield e._replace(pos=0)
            continue
        here = (before[e.ref_id] + e.pos, e.offset >> 16)
        if here[0] - last[0] >= least_bases and here[1] - last[1] >= bytes_per_shard:
            last = here
            yield e


def shards_of_entries(entries: Sequence[Entry], lengths: Sequence[int], bytes_per_shard: int, least_bases: int, padding: int = 0, unmapped: bool = False) -> list[Shard]:
    """Shards of about ``bytes_per_shard`` compressed bytes and at least ``least_bases`` bases, by the entries of an index."""
    bounds = [(e.ref_id, e.pos) for e in cuts_of_entries(entries, lengths, bytes_per_shard, least_bases)]
    last = max((e.ref_id for e in entries), default=-1)
    return _finished(bounds, lengths, last, padding, unmapped)


class _Bound(NamedTuple):
    ref: int
    pos: int
    at: int


def shards_of_bins(index: BinIndex, coordinate: Callable[[int], tuple[int, int]], lengths: Sequence[int], bytes_per_shard: int, least_bases: int, padding: int = 0, unmapped: bool = False) -> list[Shard]:
    """Shards by the offsets of a binned index; ``coordinate`` tells which record lies at an offset.

    A bound is set once more than ``bytes_per_shard`` bytes have passed.  Stretches of over twice as many are divided
    evenly by position, as often as bytes and ``least_bases`` allow; bounds closer than that are dropped, but the last.
    """
    coarse: list[_Bound] = []
    for ref, offsets in enumerate(index.offsets()):
        for i, offset in enumerate(offsets):
            if coarse and (offset >> 16) - coarse[-1].at <= bytes_per_shard:
                continue
            found, pos = coordinate(offset)
            if found != ref:
                break
            coarse.append(_Bound(ref, pos if i else 0, offset >> 16))
    if not coarse:
        if not any(index.offsets()):
            raise ValueError("an index without chunks")
        return _finished([], lengths, 0, padding, unmapped)
    fine = coarse[:1]
    for a, b in zip(coarse, coarse[1:], strict=False):
        bases, size = b.pos - a.pos, b.at - a.at
        if a.ref == b.ref and size > 2 * bytes_per_shard:
            parts = max(min(bases // least_bases, size // bytes_per_shard), 1)
            fine += [_Bound(a.ref, a.pos + i * (bases // parts), -1) for i in range(1, parts)]
        fine.append(b)
    kept = fine[:1]
    for i, b in enumerate(fine[1:], 1):
        if b.ref != kept[-1].ref or b.pos - kept[-1].pos >= least_bases or i == len(fine) - 1:
            kept.append(b)
    return _finished([(b.ref, b.pos) for b in kept], lengths, len(lengths) - 1, padding, unmapped)


#: Bytes and bases of a shard where nothing else is asked for.
DEFAULT_BYTES, DEFAULT_BASES = 128 << 20, 10_000


def strategy(kind: str, wanted: str = "automatic", padding: int = 0, split_mapped: bool = False, split_unmapped: bool = False) -> str:
    """``byte`` or ``position``: automatic is bytes for columnar files and positions for binary ones."""
    if wanted not in ("automatic", "byte", "position"):
        raise ValueError(f"unknown strategy {wanted}")
    if padding and (split_mapped or split_unmapped):
        raise ValueError("shards with padding can't split a position")
    return wanted if wanted != "automatic" else "position" if kind == "bam" else "byte"


# Plans of many files as streams


def _coordinate(ref: str, pos: str) -> Column:
    return F.struct(align.ref_order(F.col(ref)).alias("r"), F.col(pos).alias("p"))


def index_blocks(index: DataFrame) -> DataFrame:
    """(file_id, index_id, entry, place, last, start_ref, start_pos, start_seq, end_ref, end_pos, limit_ref, limit_pos) of the
    blocks of each file's index entries.

    Entries of a file stand in the order of their ranges (ties by index_id), the blocks of one by their number, each
    once.  ``place`` counts from 0 over the blocks of an entry; ``last`` marks its last one.  Entries without blocks come
    out with a null place.
    """
    rows = index.select("file_id", "index_id", "range_start_ref", "range_start_pos", "range_limit_ref", "range_limit_pos", "approx_file_bytes", F.filter("blocks", lambda b: b["block_no"].isNotNull()).alias("blocks"))
    ordered = F.array_sort(F.array_distinct(F.coalesce("blocks", F.array().cast(rows.schema["blocks"].dataType))))
    each = rows.withColumn("blocks", ordered).select("*", F.size("blocks").alias("n"), F.posexplode_outer("blocks").alias("place", "b"))
    return each.select(
        "file_id",
        "index_id",
        _coordinate("range_start_ref", "range_start_pos").alias("entry"),
        "place",
        (F.coalesce("place", F.lit(0)) >= F.col("n") - 1).alias("last"),
        *[F.col(f"b.{c}").alias(c) for c in ("start_ref", "start_pos", "start_seq", "end_ref", "end_pos")],
        F.col("range_limit_ref").alias("limit_ref"),
        F.col("range_limit_pos").alias("limit_pos"),
    )


_BOUNDS = T.StructType([T.StructField("file_id", T.LongType()), *[T.StructField(f"limit_{c}", T.IntegerType()) for c in ("ref", "pos", "seq")]])


def _read_bounds(split_mapped: bool, split_unmapped: bool):
    """Bounds of read shards of blocks that arrive in order, file by file."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen, made, before, limit = object(), 0, 0, None, (0, 0, 0)
        for part in parts:
            out: list[tuple] = []
            for r in part.to_pylist():
                if r["file_id"] != file:
                    file, seen, made, before, limit = r["file_id"], 0, 0, None, (0, 0, 0)
                ends = []
                if r["place"] is not None:
                    skip = False
                    if r["place"] and seen > (made + 1) * r["blocks"] // r["shards"]:
                        inside = before == (r["start_ref"], r["start_pos"])
                        skip = inside and not (split_mapped if r["start_ref"] >= 0 else split_unmapped)
                        ends += [] if skip else [(r["start_ref"], r["start_pos"], r["start_seq"])]
                    seen += not skip
                    before = (r["end_ref"], r["end_pos"])
                if r["last"]:
                    before = None
                    ends.append((r["limit_ref"], r["limit_pos"], 0))
                for end in ends:
                    if end != limit:
                        limit = end
                        made += 1
                        out.append((file, *end))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if not i else pa.int32()) for i, c in enumerate(columns)], names=_BOUNDS.names)

    return batches


def read_shards(index: DataFrame, shards_per_file: int, split_mapped: bool = False, split_unmapped: bool = False) -> DataFrame:
    """(file_id, limit_ref, limit_pos, limit_seq): where the read shards of each file end.

    Each holds about a ``shards_per_file``-th of the file's blocks and never crosses the end of an index entry.  A bound
    between blocks that share a coordinate is put off to the next block, unless splitting positions is allowed.  The
    blocks of a file stream through one task in order, which holds one open shard; totals come from an aggregation.
    """
    if shards_per_file < 1:
        raise ValueError("at least one shard is needed")
    blocks = index_blocks(index.where(F.col("file_id").isNotNull()))
    totals = blocks.groupBy("file_id").agg(F.count("place").alias("blocks")).withColumn("shards", F.lit(shards_per_file))
    rows = blocks.join(totals, "file_id").repartition(shuffle_partitions(index.sparkSession), "file_id").sortWithinPartitions("file_id", "entry", "index_id", "place")
    wanted = rows.select("file_id", "place", "last", "start_ref", "start_pos", "start_seq", "end_ref", "end_pos", "limit_ref", "limit_pos", "blocks", "shards")
    return wanted.mapInArrow(_read_bounds(split_mapped, split_unmapped), _BOUNDS)


def _entry_cuts(lengths: Sequence[int], bytes_per_shard: int, least_bases: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple[int, Entry]]:
            for part in parts:
                for r in part.to_pylist():
                    yield r["file_id"], Entry(r["ref_id"], r["pos"], 0, r["offset"])

        from itertools import groupby

        for file, rows in groupby(entries(), key=lambda x: x[0]):
            found = list(cuts_of_entries((e for _, e in rows), lengths, bytes_per_shard, least_bases))
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.int64()), pa.array([e.ref_id for e in found], pa.int32()), pa.array([e.pos for e in found], pa.int32())], names=["file_id", "start_ref", "start_pos"])

    return batches


def byte_shards(entries: DataFrame, lengths: Sequence[int], bytes_per_shard: int, least_bases: int) -> DataFrame:
    """(file_id, start_ref, start_pos): where the byte shards of each file begin, of index entries (file_id, ref_id, pos, offset)."""
    rows = entries.select("file_id", F.col("ref_id").cast("int").alias("ref_id"), F.col("pos").cast("int").alias("pos"), F.col("offset").cast("bigint").alias("offset"))
    ordered = rows.repartition(shuffle_partitions(entries.sparkSession), "file_id").sortWithinPartitions("file_id", "offset")
    schema = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("start_ref", T.IntegerType()), T.StructField("start_pos", T.IntegerType())])
    return ordered.mapInArrow(_entry_cuts(lengths, bytes_per_shard, least_bases), schema)


def sparse_entries(records: DataFrame, interval: int) -> DataFrame:
    """(file_id, ref_id, pos, offset): records (the same columns) at which an index has an entry.

    The first record of each reference, and the first of a position whose offset lies in another stretch of ``interval``
    bytes than the position before it; so entries are at most two stretches apart, and windows decide each by itself.
    """
    along = W.partitionBy("file_id", "ref_id").orderBy("offset")
    first = records.groupBy("file_id", "ref_id", "pos").agg(F.min("offset").alias("offset"))
    before = F.lag("offset").over(along)
    keep = before.isNull() | (F.floor(F.col("offset") / interval) != F.floor(before / interval))
    return first.withColumn("__keep", keep).where("__keep").drop("__keep")


# Adjacent pairs


def adjacent_pairs(reads: DataFrame, place: str = "read_id", shard: int | None = None) -> DataFrame:
    """(read_name, first_id, second_id): records that follow each other as mates, every even one with the next.

    ``place`` numbers the records from 0 without gaps, so that mates meet by half of it and no order over all records
    is needed.  ``shard`` (an even number) only adds the number of the shard of so many records.  A record without
    its neighbour, positions that don't cross, or flags other than one first and one second are an error.
    """
    if shard is not None and shard % 2:
        raise ValueError("a shard needs an even number of records")
    mine = F.struct("read_id", "read_name", "flags", "pos", "mate_pos")
    both = reads.groupBy(F.expr(f"{place} div 2").alias("__pair")).agg(F.max(F.when(F.col(place) % 2 == 0, mine)).alias("a"), F.max(F.when(F.col(place) % 2 == 1, mine)).alias("b"))

    def failed(text: str) -> Column:
        return F.raise_error(F.concat(F.coalesce("a.read_name", "b.read_name", F.lit("null")), F.lit(text))).cast("boolean")

    crossed = F.col("a.pos").eqNullSafe(F.col("b.mate_pos")) & F.col("b.pos").eqNullSafe(F.col("a.mate_pos"))

    def firsts(x: str, y: str) -> Column:
        return align.has_flag(F.col(f"{x}.flags"), align.READ1) & align.has_flag(F.col(f"{y}.flags"), align.READ2)

    good = F.when(F.col("a").isNull() | F.col("b").isNull(), failed(" has no neighbour")).when(~crossed, failed(": positions don't match")).when(~firsts("a", "b") & ~firsts("b", "a"), failed(" isn't of a first and a second read")).otherwise(True)
    ordered = F.when(firsts("a", "b"), F.struct("a.read_id", F.col("b.read_id").alias("other"))).otherwise(F.struct("b.read_id", F.col("a.read_id").alias("other")))
    rows = both.where(good).select("__pair", F.col("a.read_name").alias("read_name"), ordered.alias("p"))
    extra = [] if shard is None else [F.expr(f"__pair * 2 div {shard}").alias("shard")]
    return rows.select("read_name", F.col("p.read_id").alias("first_id"), F.col("p.other").alias("second_id"), *extra)


def left_most(ref: Column, pos: Column, flags: Column, mate_ref: Column, mate_pos: Column) -> Column:
    """Whether a read comes before its mate: the smaller reference, then position, then the first of the pair."""
    a, b = align.ref_order(ref), align.ref_order(mate_ref)
    return F.when(a != b, a < b).when(pos != mate_pos, pos < mate_pos).otherwise(align.has_flag(flags, align.READ1))


def renumbered(shards: Sequence[Shard]) -> list[Shard]:
    return [replace(s, number=i) for i, s in enumerate(shards)]
