"""Interval algebra on half-open intervals (ref, start, limit).

Overlap joins are equi-joins on fixed-width bins with a residual condition; a pair is reported in the bin of the
greater start only, so no distinct is needed and no cross product arises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bases of a bin of the overlap joins.
BIN = 1 << 14
#: The ends of a complement.
LOWEST, HIGHEST = -1, 2_147_483_647


def union(intervals: DataFrame) -> DataFrame:
    """(ref, start, limit) of the union: overlapping and touching intervals merged, empty and null ones left out.

    Built on run bitmaps per reference and shard, so one long reference isn't one task.
    """
    from strandline.operators.periods import merged_and_gaps

    closed = intervals.where(F.col("start") < F.col("limit")).select("ref", F.col("start").cast("bigint").alias("a"), (F.col("limit").cast("bigint") - 1).alias("b"))
    return merged_and_gaps(closed, ["ref"], "a", "b").where(F.col("kind") == "merged").select("ref", F.col("a").alias("start"), (F.col("b") + 1).alias("limit"))


def complement(intervals: DataFrame, low: int = LOWEST, high: int = HIGHEST, references: DataFrame | None = None) -> DataFrame:
    """What the union of each mentioned reference leaves of [low, high); ``references`` (ref) without intervals are left whole."""
    from strandline.operators.periods import merged_and_gaps

    if references is not None:
        named = intervals.where(F.col("start") < F.col("limit")).select("ref").distinct()
        empty = references.select("ref").distinct().join(named, "ref", "left_anti").select("ref", F.lit(low).cast("bigint").alias("start"), F.lit(high).cast("bigint").alias("limit"))
        return complement(intervals, low, high).unionByName(empty)

    closed = intervals.where(F.col("start") < F.col("limit")).select("ref", F.greatest(F.col("start").cast("bigint"), F.lit(low)).alias("a"), F.least(F.col("limit").cast("bigint") - 1, F.lit(high - 1)).alias("b"))
    found = merged_and_gaps(closed, ["ref"], "a", "b")
    gaps = found.where(F.col("kind") == "gap").select("ref", F.col("a").alias("start"), (F.col("b") + 1).alias("limit"))
    ends = found.where(F.col("kind") == "merged").groupBy("ref").agg(F.min("a").alias("first"), (F.max("b") + 1).alias("last"))
    outer = ends.select("ref", F.inline(F.array(F.struct(F.lit(low).cast("bigint").alias("start"), F.col("first").alias("limit")), F.struct(F.col("last").alias("start"), F.lit(high).cast("bigint").alias("limit")))))
    return gaps.unionByName(outer).where(F.col("start") < F.col("limit"))


def subset(intervals: DataFrame, ref: str, start: int, limit: int) -> DataFrame:
    """The intervals cut to one region, as a union."""
    cut = intervals.where((F.col("ref") == ref) & (F.col("limit") > start) & (F.col("start") < limit))
    return union(cut.select("ref", F.greatest("start", F.lit(start)).alias("start"), F.least("limit", F.lit(limit)).alias("limit")))


def within(intervals: DataFrame, references: DataFrame, start: tuple[str, int], limit: tuple[str, int]) -> DataFrame:
    """The union's part in [start, limit), a stretch over one or more references in the order of ``references`` (ref, ref_id).

    A stretch that isn't increasing is an error; intervals of unknown references are left out.
    """
    numbers = {r.ref: r.ref_id for r in references.where(F.col("ref").isin(start[0], limit[0])).collect()}
    if (numbers[start[0]], start[1]) >= (numbers[limit[0]], limit[1]):
        raise ValueError("a region must not be empty or inverted")
    first, last = numbers[start[0]], numbers[limit[0]]
    known = intervals.join(F.broadcast(references.where(F.col("ref_id").between(first, last)).select("ref", "ref_id")), "ref")
    low = F.when(F.col("ref_id") == first, F.greatest(F.col("start"), F.lit(start[1]))).otherwise(F.col("start"))
    high = F.when(F.col("ref_id") == last, F.least(F.col("limit"), F.lit(limit[1]))).otherwise(F.col("limit"))
    return union(known.select("ref", low.alias("start"), high.alias("limit")))


def endpoints(intervals: DataFrame) -> DataFrame:
    """(ref, n, first, last): of each reference how many ends its union has, the least and the greatest."""
    return union(intervals).groupBy("ref").agg((2 * F.count(F.lit(1))).alias("n"), F.min("start").alias("first"), F.max("limit").alias("last"))


def block_meets(start: Column, end: Column, low: Column, limit: Column) -> Column:
    """Whether a block from ``start`` to ``end``, both included, meets [low, limit); coordinates as structs."""
    return (start < limit) & (low <= end)


def covered_bases(intervals: DataFrame) -> DataFrame:
    """(ref, bases) that the union covers."""
    return union(intervals).groupBy("ref").agg(F.sum(F.col("limit") - F.col("start")).alias("bases"))


def positions(intervals: DataFrame) -> DataFrame:
    """(ref, pos): every covered position once."""
    return union(intervals).select("ref", F.explode(F.sequence(F.col("start"), F.col("limit") - 1)).alias("pos"))


def _bins(start: str, limit: str, width: int) -> Column:
    return F.expr(f"explode(sequence(CAST({start} AS BIGINT) div {width}, (CAST({limit} AS BIGINT) - 1) div {width}))")


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Every pair of a left and a right interval of one reference that share a base.

    Both sides have ref, start, limit (from 0) and further columns; the right side's all get the prefix ``r_``.
    Empty intervals meet nothing.  A bin that is hot on one side is split by the adaptive skew join.
    """
    a = left.where((F.col("start") < F.col("limit")) & F.col("ref").isNotNull()).withColumn("__bin", _bins("start", "limit", width))
    b = right.where((F.col("start") < F.col("limit")) & F.col("ref").isNotNull()).select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns])
    b = b.withColumn("__r_bin", _bins("r_start", "r_limit", width))
    meet = (F.col("ref") == F.col("r_ref")) & (F.col("__bin") == F.col("__r_bin")) & (F.col("start") < F.col("r_limit")) & (F.col("r_start") < F.col("limit"))
    once = F.col("__bin") == F.expr(f"CAST(greatest(start, r_start) AS BIGINT) div {width}")
    return a.join(b, meet & once).drop("__bin", "__r_bin")


def intersections(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """``overlap_join`` with the shared part as shared_start, shared_limit."""
    return overlap_join(left, right, width).withColumns({"shared_start": F.greatest("start", "r_start"), "shared_limit": F.least("limit", "r_limit")})


def semi_overlap(left: DataFrame, right: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Left rows (with a unique ``key``) that meet any right interval, each once."""
    hits = overlap_join(left.select(key, "ref", "start", "limit"), union(right), width).select(key).distinct()
    return left.join(hits, key, "left_semi")


def containing(points: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """Points (ref, pos and further columns) that lie in the union of the intervals."""
    merged = union(intervals).withColumn("__bin", _bins("start", "limit", width)).select(F.col("ref").alias("__ref"), "start", "limit", "__bin")
    # The merged intervals are disjoint, so a point meets at most one row.
    inside = (F.col("ref") == F.col("__ref")) & (F.expr(f"CAST(pos AS BIGINT) div {width}") == F.col("__bin")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("limit"))
    return points.join(merged, inside, "left_semi")


def floor_lookup(left: DataFrame, right: DataFrame, keys: list[str], at: str, key_at: str, value: str, width: int = BIN) -> DataFrame:
    """As-of join: to each left row the ``value`` of the right row with the greatest ``key_at`` not above ``at``.

    Left rows before every right row, and those with a null key or position, get null.  Ties of ``key_at`` go to the
    greatest value.  Both sides are sorted within bins of ``width`` positions, so a hot key is many tasks; what a bin
    takes over from earlier ones comes from a table of bins.
    """
    names, kind = [c for c in left.columns if c not in keys], right.schema[value].dataType
    k = [f"__k{i}" for i in range(len(keys))]
    one = left.select(*[F.col(c).alias(x) for c, x in zip(keys, k, strict=True)], F.col(at).cast("bigint").alias("__at"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"), F.lit(None).cast(kind).alias("__value"))
    two = right.groupBy(*[F.col(c).alias(x) for c, x in zip(keys, k, strict=True)], F.col(key_at).cast("bigint").alias("__at")).agg(F.max(value).alias("__value")).where(F.col("__at").isNotNull())
    two = two.select(*k, "__at", F.lit(0).alias("__side"), F.lit(None).cast(one.schema["__row"].dataType).alias("__row"), "__value")
    both = one.unionByName(two).withColumn("__bin", F.expr(f"(__at - pmod(__at, {width})) div {width}"))
    here = F.when(F.col("__side") == 0, F.struct("__value"))
    within = W.partitionBy(*k, "__bin").orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__found", F.last(here, ignorenulls=True).over(within)).where(F.col("__side") == 1)
    bins = both.groupBy(*k, "__bin").agg(F.max_by(here, F.when(F.col("__side") == 0, F.col("__at"))).alias("__last"))
    earlier = W.partitionBy(*k).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    carried = bins.withColumn("__carried", F.last("__last", ignorenulls=True).over(earlier)).select(*k, "__bin", "__carried")
    joined = found.join(carried, [*k, "__bin"], "left")
    return joined.select(*[F.col(x).alias(c) for c, x in zip(keys, k, strict=True)], "__row.*", F.coalesce("__found", "__carried")["__value"].alias(value))
