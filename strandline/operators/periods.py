"""Merging of overlapping intervals into continuous periods, and the gaps between them.

Exact units (bases, microseconds) are discretised into shards of fixed length; within an entity and shard the
covered units form a compressed bitmap, kept as sorted runs.  Union of the bitmaps gives the set runs; the clear
runs between them are the gaps.  Runs that meet at a shard's edge are joined through a summary of the shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.session import col

#: Units of a shard: the bits of one bitmap.
SHARD = 1 << 16


def run_bitmaps(intervals: DataFrame, keys: Sequence[str], start: str, stop: str, shard: int = SHARD) -> DataFrame:
    """(keys as k0.., shard, runs): of each entity and shard the covered units as sorted, disjoint, non-touching runs.

    Both ends belong to an interval.  Of intervals with one start only the longest matters, which the first
    aggregation keeps before the shuffle; so a bitmap is built from at most ``shard`` rows, however many intervals
    an entity has.  An interval costs a row a shard that it touches.
    """
    k = [f"k{i}" for i in range(len(keys))]
    clean = intervals.select(*[col(c).alias(a) for c, a in zip(keys, k, strict=True)], col(start).cast("bigint").alias("a"), col(stop).cast("bigint").alias("b")).where("a <= b")
    cut = clean.select(*k, "a", "b", F.expr(f"explode(sequence((a - pmod(a, {shard})) div {shard}, (b - pmod(b, {shard})) div {shard}))").alias("shard"))
    low = F.col("shard") * shard
    bits = cut.select(*k, "shard", F.greatest("a", low).alias("a"), F.least("b", low + (shard - 1)).alias("b"))
    longest = bits.groupBy(*k, "shard", "a").agg(F.max("b").alias("b"))
    order = W.partitionBy(*k, "shard").orderBy("a")
    seen = longest.withColumn("reach", F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)))
    fresh = (F.col("reach").isNull() | (F.col("a") > F.col("reach") + 1)).cast("int")
    runs = seen.withColumn("run", F.sum(fresh).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    united = runs.groupBy(*k, "shard", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return united.groupBy(*k, "shard").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def merged_and_gaps(intervals: DataFrame, keys: Sequence[str], start: str, stop: str, shard: int = SHARD) -> DataFrame:
    """(keys, kind, start, stop): ``merged`` are the largest ranges without a missing unit, ``gap`` those between.

    Intervals include both ends; touching ones are one range.  Intervals with a null bound or start after stop are
    left out.  Null keys form an entity of their own.  Repeated rows change nothing; other columns are ignored; no
    intervals, no rows.  The types of start and stop are kept.  A task of the joining step gets one row for each
    shard of an entity, not its intervals.
    """
    k = [f"k{i}" for i in range(len(keys))]
    bitmaps = run_bitmaps(intervals, keys, start, stop, shard)
    size = F.size("runs")
    shards = bitmaps.select(*k, "shard", "runs", F.get("runs", F.lit(0))["a"].alias("first_a"), F.get("runs", size - 1)["b"].alias("last_b"))
    along = W.partitionBy(*k).orderBy("shard")
    linked = shards.withColumn("before", F.lag("last_b").over(along))
    joins = F.coalesce(F.col("first_a") == F.col("before") + 1, F.lit(False))
    linked = linked.withColumn("joins", joins.cast("int"))
    islands = F.coalesce(F.sum(size - F.col("joins")).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    linked = linked.withColumn("islands", islands)
    each = linked.select(*k, "islands", "joins", "before", "runs", F.posexplode("runs").alias("i", "run"))
    previous = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("runs", F.col("i") - 1)["b"])
    each = each.select(*k, (F.col("islands") + F.col("i") + 1 - F.col("joins")).alias("island"), F.col("run.a").alias("a"), F.col("run.b").alias("b"), previous.alias("previous"))
    # An island's gap lies before its first run, whose predecessor is the only one not joined to it.
    whole = each.groupBy(*k, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("previous").alias("previous"))
    kinds = F.array(
        F.struct(F.lit("merged").alias("kind"), F.col("a").alias("a"), F.col("b").alias("b")),
        F.when(F.col("previous") + 1 < F.col("a"), F.struct(F.lit("gap").alias("kind"), (F.col("previous") + 1).alias("a"), (F.col("a") - 1).alias("b"))),
    )
    rows = whole.select(*k, F.inline(F.filter(kinds, lambda x: x.isNotNull())))
    bounds = intervals.schema
    return rows.select(*[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)], "kind", F.col("a").cast(bounds[start].dataType).alias(start), F.col("b").cast(bounds[stop].dataType).alias(stop))


def exon_periods(gtf_records: DataFrame) -> DataFrame:
    """Continuous exon ranges of each gene and chrom and the gaps between them, of the latest rows."""
    from strandline.session import latest_rows

    rows = latest_rows(gtf_records.select("record_id", "chrom", "feature", "range_start", "range_stop", "gene_id", "loaded_at"), ["record_id"], "loaded_at")
    return merged_and_gaps(rows.where(F.col("feature") == "exon"), ["gene_id", "chrom"], "range_start", "range_stop")
