"""Statistics, order, sharding and pairing of alignment records.

Records are rows with read_id, read_name, flags, ref_id, pos, mapq, cigar, mate_ref_id, mate_pos, seq, qual (only
those that an operator names are read).  References have numbers; -1 is unmapped and sorts last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.functions import align
from strandline.session import col

FLAGSTAT = ["total", "mapped", "duplicate", "secondary", "supplementary", "paired", "good_pair", "single", "pair_map", "diff_chr", "diff_high", "r1", "r2"]


def flagstat(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of reads by their flags, for each quality class (qc_fail) and the further columns ``by``.

    Secondary, supplementary and paired exclude each other in this order; mapped and duplicate don't.  A null flag
    counts as 0.  No reads, no rows.  One partial aggregation before the shuffle.
    """
    f = F.coalesce(F.col("flags"), F.lit(0))

    def has(bits: int) -> Column:
        return align.has_flag(f, bits)

    pair = ~has(align.SECONDARY) & ~has(align.SUPPLEMENTARY) & has(align.PAIRED)
    both = pair & ~has(align.UNMAPPED) & ~has(align.MATE_UNMAPPED)
    apart = both & (F.col("ref_id") != F.col("mate_ref_id"))
    conditions = {
        "mapped": ~has(align.UNMAPPED),
        "duplicate": has(align.DUPLICATE),
        "secondary": has(align.SECONDARY),
        "supplementary": ~has(align.SECONDARY) & has(align.SUPPLEMENTARY),
        "paired": pair,
        "good_pair": pair & has(align.PROPER_PAIR) & ~has(align.UNMAPPED),
        "single": pair & has(align.MATE_UNMAPPED) & ~has(align.UNMAPPED),
        "pair_map": both,
        "diff_chr": apart,
        "diff_high": apart & (F.col("mapq") >= 5),
        "r1": pair & has(align.READ1),
        "r2": pair & has(align.READ2),
    }
    counts = [F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]]
    out = reads.groupBy(*by, has(align.QC_FAIL).alias("qc_fail")).agg(*counts)
    return out.select(*by, "qc_fail", *FLAGSTAT)


def merge_flagstat(partial: DataFrame) -> DataFrame:
    """Sums partial counts by quality class; null counts are 0."""
    return partial.groupBy("qc_fail").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in FLAGSTAT])


def flagstat_text(stats: DataFrame) -> DataFrame:
    """(line_no, line): the counts as lines `pass + fail label`, with percentages where they are usual."""
    wide = stats.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("qc_fail") == q, F.col(c))), F.lit(0)).alias(f"{c}_{int(q)}") for q in (False, True) for c in FLAGSTAT])

    def share(part: str, whole: str) -> Column:
        one = [F.when(F.col(f"{whole}_{q}") > 0, F.format_string("%.2f%%", 100.0 * F.col(f"{part}_{q}") / F.col(f"{whole}_{q}"))).otherwise("N/A") for q in (0, 1)]
        return F.concat(F.lit(" ("), one[0], F.lit(":"), one[1], F.lit(")"))

    none = F.lit("")
    # The labels of the report, in its order.
    lines = [
        ("total", "in total (QC-passed reads + QC-failed reads)", none),
        ("secondary", "secondary", none),
        ("supplementary", "supplementary", none),
        ("duplicate", "duplicates", none),
        ("mapped", "mapped", share("mapped", "total")),
        ("paired", "paired in sequencing", none),
        ("r1", "read1", none),
        ("r2", "read2", none),
        ("good_pair", "properly paired", share("good_pair", "paired")),
        ("pair_map", "with itself and mate mapped", none),
        ("single", "singletons", share("single", "paired")),
        ("diff_chr", "with mate mapped to a different chr", none),
        ("diff_high", "with mate mapped to a different chr (mapQ>=5)", none),
    ]
    structs = [F.struct(F.lit(i).alias("line_no"), F.concat(F.col(f"{c}_0").cast("string"), F.lit(" + "), F.col(f"{c}_1").cast("string"), F.lit(f" {label}"), extra).alias("line")) for i, (c, label, extra) in enumerate(lines)]
    return wide.select(F.inline(F.array(*structs)))


CHECKED = {
    "sum_flags": lambda: F.col("flags").cast("string"),
    "sum_mapq": lambda: F.col("mapq").cast("string"),
    "sum_mate": lambda: F.concat_ws(":", F.col("mate_ref_id").cast("string"), F.col("mate_pos").cast("string")),
    "sum_name": lambda: F.col("read_name"),
    "sum_seq": lambda: F.col("seq"),
    "sum_qual": lambda: F.array_join(F.transform("qual", lambda q: q.cast("string")), ","),
    "sum_cigar": lambda: F.col("cigar"),
}


def checksum(reads: DataFrame, fields: Sequence[str] = tuple(CHECKED)) -> DataFrame:
    """Order-insensitive checksums of each reference: (ref_name, n_recs, sum_pos, and a sum of hashes per field).

    A field's hash takes in reference and position; sums are taken modulo 2^64 (decimal(20,0)), so the order and
    the partitioning of the records don't matter.  Null and unknown references count as unmapped, `*`; null values
    hash as empty texts.
    """
    where = F.concat_ws(":", F.col("ref_id").cast("string"), F.col("pos").cast("string"))

    def total(value: Column) -> Column:
        digest = F.md5(F.concat_ws("|", where, F.coalesce(value, F.lit(""))).cast("binary"))
        number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
        return F.pmod(F.sum(number), F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(20,0)")

    sums = [total(CHECKED[f]()).cast("string").alias(f) for f in fields]
    name = F.when(F.col("ref_id") < 0, F.lit("*")).otherwise(F.col("ref_name")).alias("ref_name")
    return reads.groupBy(name).agg(F.count(F.lit(1)).alias("n_recs"), F.sum(F.greatest(F.col("pos"), F.lit(0)).cast("bigint")).alias("sum_pos"), *sums)


def checksum_json(sums: DataFrame) -> str:
    """The checksums, one object a reference (of which there are few), as JSON; unmapped reads under `*`."""
    import json

    rows = [r.asDict() for r in sums.orderBy("ref_name").collect()]
    return json.dumps({r.pop("ref_name") or "*": r for r in rows}, indent=2, sort_keys=True)


# Order


#: Values of the order column whose records are numbered by one task.
STRETCH = 1 << 16


def with_sequence_number(reads: DataFrame, order: str = "read_id", stretch: int = STRETCH) -> DataFrame:
    """Adds seq_no: 0, 1, ... among the records of one (ref_id, pos), in the order of ``order`` (whole numbers).

    Unmapped records without a position stand at 0, and share one group, as in the file's order.  Groups are numbered
    within stretches of ``order``, and the records of earlier stretches are added; so a group that holds a third of all
    records is many tasks.
    """
    pos = align.record_position(F.col("ref_id"), F.col("pos"))
    keys = ["ref_id", "__pos", "__part"]
    rows = reads.withColumns({"__pos": pos, "__part": F.floor(F.col(order) / stretch)})
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("ref_id", "__pos").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")).where(F.col("__before") > 0)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    inner = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    joined = rows.withColumn("__inner", inner).join(starts, same[0] & same[1] & same[2], "left")
    return joined.withColumn("seq_no", (F.col("__inner") + F.coalesce("__before", F.lit(0))).cast("int")).select(*[col(c) for c in reads.columns], "seq_no")


def coordinate_sorted(reads: DataFrame, tie: Sequence[str] = ("read_id",)) -> DataFrame:
    """By reference, position and strand, unmapped last; ties by the columns ``tie``.  A range-partitioned sort."""
    return reads.orderBy(align.sort_key(F.col("ref_id"), F.col("pos"), F.col("flags")), *tie)


def merged_sorted(parts: Sequence[DataFrame], tie: Sequence[str] = ("read_id",)) -> DataFrame:
    """Several files as one sorted one; equal records of different files all stay.  Their columns must agree."""
    out = parts[0]
    for part in parts[1:]:
        if set(part.columns) != set(out.columns):
            raise ValueError("the files' columns differ")
        out = out.unionByName(part)
    return coordinate_sorted(out, tie)


# Shards


def position_shards(references: DataFrame, width: int, padding: int = 0, unmapped: bool = False) -> DataFrame:
    """Fixed-width shards of each reference (ref_id, length): shard_no, ref_id, start, limit, padded_start, padded_limit."""
    if width < 1 or padding < 0:
        raise ValueError("a shard's width must be positive and its padding not negative")
    cut = references.where(F.col("length") > 0).select("ref_id", F.col("length").cast("bigint").alias("length"), F.explode(F.expr(f"sequence(0L, length - 1L, {width}L)")).alias("start"))
    rows = cut.select("ref_id", "start", F.least(F.col("start") + width, "length").alias("limit"), "length")
    rows = rows.select("ref_id", "start", "limit", F.greatest(F.col("start") - padding, F.lit(0)).alias("padded_start"), F.least(F.col("limit") + padding, "length").alias("padded_limit"))
    if unmapped:
        most = F.lit(2_147_483_647).cast("bigint")
        extra = references.sparkSession.range(1).select(F.lit(-1).alias("ref_id"), F.lit(0).cast("bigint").alias("start"), most.alias("limit"), F.lit(0).cast("bigint").alias("padded_start"), most.alias("padded_limit"))
        rows = rows.unionByName(extra)
    # The list of shards is small by nature: one row per width bases.
    return rows.withColumn("shard_no", (F.row_number().over(W.orderBy(align.ref_order(F.col("ref_id")), "start")) - 1).cast("int"))


def shard_counts(reads: DataFrame, width: int) -> DataFrame:
    """(ref_id, shard, n_reads, first_index): reads of each shard, and how many lie before it in coordinate order.

    The running sum is over shards, of which there are few, not over reads.
    """
    counts = reads.where(F.col("ref_id") >= 0).groupBy("ref_id", F.floor(F.col("pos") / width).cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n_reads"))
    before = W.orderBy("ref_id", "shard").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first_index", F.coalesce(F.sum("n_reads").over(before), F.lit(0)))


# Pairs


def _mates(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and second primary reads of pairs, one of each name (the one of least id)."""
    fields = [c for c in reads.columns if c != "read_name"]
    primary = reads.where(align.has_flag(F.col("flags"), align.PAIRED) & align.is_primary(F.col("flags")) & F.col("read_name").isNotNull())

    def of(bit: int, other: int, suffix: str) -> DataFrame:
        one = primary.where(align.has_flag(F.col("flags"), bit) & ~align.has_flag(F.col("flags"), other))
        least = one.groupBy("read_name").agg(F.min_by(F.struct(*[col(c) for c in fields]), "read_id").alias("x"))
        return least.select("read_name", *[F.col("x").getField(c).alias(f"{c}_{suffix}") for c in fields])

    return of(align.READ1, align.READ2, "1"), of(align.READ2, align.READ1, "2")


def read_pairs(reads: DataFrame) -> DataFrame:
    """Both mates of each name in one row: read_name and every other column with _1 and _2.

    Only primary reads of pairs take part; names without the other mate are left out (see ``missing_mates``).
    """
    one, two = _mates(reads)
    return one.join(two, "read_name")


def missing_mates(reads: DataFrame) -> DataFrame:
    """(read_name, has_first): primary reads of pairs whose mate isn't there."""
    one, two = _mates(reads)
    both = one.select("read_name", F.lit(True).alias("a")).join(two.select("read_name", F.lit(True).alias("b")), "read_name", "full")
    return both.where(F.col("a").isNull() | F.col("b").isNull()).select("read_name", F.col("a").isNotNull().alias("has_first"))


def bounded_pairs(reads: DataFrame, most_span: int = 1000) -> DataFrame:
    """Pairs on one reference whose ends lie at most ``most_span`` apart: read_name, ref_id, start, limit, read_id_1, read_id_2."""
    pairs = read_pairs(reads.select("read_id", "read_name", "flags", "ref_id", "pos", "cigar"))
    start, limit = F.least("pos_1", "pos_2"), F.greatest(align.alignment_end(F.col("pos_1"), F.col("cigar_1")), align.alignment_end(F.col("pos_2"), F.col("cigar_2")))
    near = pairs.where((F.col("ref_id_1") >= 0) & (F.col("ref_id_1") == F.col("ref_id_2")) & ~align.has_flag(F.col("flags_1"), align.UNMAPPED) & ~align.has_flag(F.col("flags_2"), align.UNMAPPED))
    return near.select("read_name", F.col("ref_id_1").alias("ref_id"), start.alias("start"), limit.alias("limit"), "read_id_1", "read_id_2").where(F.col("limit") - F.col("start") <= most_span)


def pairs_by_shard(pairs: DataFrame, width: int) -> DataFrame:
    """(shard, ...): bounded pairs once for each shard of ``width`` bases that they touch."""
    first, last = F.floor(F.col("start") / width).cast("bigint"), F.floor((F.col("limit") - 1) / width).cast("bigint")
    return pairs.select("*", F.explode(F.sequence(first, F.greatest(first, last))).alias("shard"))


def missing_mate_summary(reads: DataFrame, width: int, most_names: int = 101) -> DataFrame:
    """(ref_id, shard, n, names): of each shard how many reads lack their mate, and the first ``most_names`` of their names.

    Names are ranked by a window limit before they are gathered, so a shard's list is bounded.
    """
    one = reads.select("read_id", "read_name", "flags", "ref_id", "pos")
    lost = missing_mates(one.select("read_id", "read_name", "flags")).select("read_name")
    primary = one.where(align.has_flag(F.col("flags"), align.PAIRED) & align.is_primary(F.col("flags")))
    at = primary.join(lost, "read_name", "left_semi").groupBy("ref_id", F.floor(F.greatest(F.col("pos"), F.lit(0)) / width).cast("bigint").alias("shard"), "read_name").agg(F.count(F.lit(1)).alias("k"))
    counts = at.groupBy("ref_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("ref_id", "shard").orderBy("read_name"))
    names = at.withColumn("place", place).where(F.col("place") <= most_names).groupBy("ref_id", "shard").agg(F.array_sort(F.collect_list("read_name")).alias("names"))
    return counts.join(names, ["ref_id", "shard"])


def position_deltas(reads: DataFrame, width: int = 1 << 16, order: str = "read_id") -> DataFrame:
    """Adds delta: the distance to the position of the record before, within a block of ``width`` bases and in coordinate
    order; the first of a block has its position."""
    along = W.partitionBy("ref_id", F.floor(F.col("pos") / width)).orderBy("pos", order)
    return reads.withColumn("delta", F.col("pos") - F.coalesce(F.lag("pos").over(along), F.lit(0)))


def pair_counts(reads: DataFrame) -> DataFrame:
    """(same_ref, n): pairs whose mates lie on one reference and on two."""
    pairs = read_pairs(reads.select("read_id", "read_name", "flags", "ref_id"))
    return pairs.groupBy((F.col("ref_id_1") == F.col("ref_id_2")).alias("same_ref")).agg(F.count(F.lit(1)).alias("n"))


def distant_mates(reads: DataFrame, width: int, padding: int) -> DataFrame:
    """(read_id, ref_id, shard): reads that a padded shard of their mate's reference needs but doesn't hold.

    A row for each shard of ``width`` bases whose padded range holds the mate while the read lies on another
    reference or outside that range.  Secondary, supplementary and unmapped reads and reads without a mapped mate
    are left out.  The shards are computed from the mate's position, without a join.
    """
    keep = align.is_primary(F.col("flags")) & align.has_flag(F.col("flags"), align.PAIRED) & ~align.has_flag(F.col("flags"), align.UNMAPPED | align.MATE_UNMAPPED)
    mine = reads.where(keep & (F.col("ref_id") >= 0) & (F.col("mate_ref_id") >= 0) & (F.col("mate_pos") >= 0))
    first = F.greatest(F.floor((F.col("mate_pos") - padding) / width), F.lit(0)).cast("bigint")
    last = F.floor((F.col("mate_pos") + padding) / width).cast("bigint")
    each = mine.select("read_id", F.col("mate_ref_id").alias("shard_ref"), "ref_id", "pos", "mate_pos", F.explode(F.sequence(first, last)).alias("shard"))
    low, high = F.greatest(F.col("shard") * width - padding, F.lit(0)), (F.col("shard") + 1) * width + padding
    holds = (F.col("mate_pos") >= low) & (F.col("mate_pos") < high)
    apart = (F.col("ref_id") != F.col("shard_ref")) | (F.col("pos") < low) | (F.col("pos") >= high)
    return each.where(holds & apart).select("read_id", F.col("shard_ref").alias("ref_id"), "shard")
