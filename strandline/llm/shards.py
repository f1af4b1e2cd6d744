"""Cutting oversized shard-index entries into pieces under a byte limit.

The separators of ``splitting`` are here, from the coarsest: where the reference changes, where the position changes,
and between blocks of one position if the options split positions.  An entry is divided level by level and packed
greedily up to the limit; each piece's range overlaps its neighbours by the padding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.exprs import let
from strandline.llm.splitting import filled_cuts
from strandline.session import latest_rows

#: Separator levels, the coarsest first.
REFERENCE, POSITION, WITHIN = 1, 2, 3


def _ordered_blocks(blocks: Column) -> Column:
    """Blocks by number, each once; blocks without a number and null blocks are left out, null counts are 0."""
    kept = F.filter(blocks, lambda b: b["block_no"].isNotNull())
    clean = F.transform(kept, lambda b: b.withField("num_records", F.greatest(F.coalesce(b["num_records"], F.lit(0)), F.lit(0))))
    return let(F.array_sort(F.array_distinct(clean)), lambda o: F.filter(o, lambda b, i: (i == 0) | (b["block_no"] != F.get(o, i - 1)["block_no"])))


def _level(block: Column, before: Column, split_mapped: Column, split_unmapped: Column) -> Column:
    """The separator between two neighbouring blocks, null where no cut is allowed."""
    inside = F.when(block["start_ref"].eqNullSafe(F.lit(-1)), split_unmapped).otherwise(split_mapped)
    return (
        F.when(~block["start_ref"].eqNullSafe(before["end_ref"]), REFERENCE)
        .when(~block["start_pos"].eqNullSafe(before["end_pos"]), POSITION)
        .when(inside, WITHIN)
    )


def plan_cuts(index: DataFrame, options: DataFrame) -> DataFrame:
    """Adds to the latest row of each entry its ordered blocks, its options and the cuts (places of blocks, from 0).

    Only entries that are to be cut are returned: approx_file_bytes above a positive bytes_per_shard, at least one
    block, and no padding together with splitting of positions.  Entries without options, with a null size or a
    null or non-positive limit aren't.  Null padding is 0, null booleans are false; a null index_id is no entry.
    """
    rows = latest_rows(index.where(F.col("index_id").isNotNull()).select("index_id", "opts_id", "approx_file_bytes", "blocks", "indexed_at"), ["index_id"], "indexed_at")
    settings = options.where(F.col("opts_id").isNotNull()).groupBy("opts_id").agg(F.max(F.struct("padding", "split_unmapped_coords", "split_mapped_coords", "bytes_per_shard")).alias("o"))
    settings = settings.select(
        "opts_id",
        F.coalesce("o.padding", F.lit(0)).alias("padding"),
        F.coalesce("o.split_mapped_coords", F.lit(False)).alias("split_mapped"),
        F.coalesce("o.split_unmapped_coords", F.lit(False)).alias("split_unmapped"),
        F.col("o.bytes_per_shard").alias("bytes_per_shard"),
    ).where((F.col("bytes_per_shard") > 0) & ~((F.col("padding") != 0) & (F.col("split_mapped") | F.col("split_unmapped"))))
    due = rows.join(settings, "opts_id").where(F.col("approx_file_bytes") > F.col("bytes_per_shard"))
    planned = due.withColumn("plan", _plan(*[F.col(c) for c in ("blocks", "approx_file_bytes", "bytes_per_shard", "split_mapped", "split_unmapped")])).where(F.size("plan.blocks") > 0)
    return planned.withColumn("cuts", filled_cuts("plan.sizes", "plan.levels", "plan.cap"))


def _plan(blocks: Column, size: Column, limit: Column, split_mapped: Column, split_unmapped: Column) -> Column:
    """Struct (blocks, sizes, levels, cap) of an entry: its blocks, their records, what separates them, and the records of a
    piece that just keeps within the limit, in whole numbers."""

    def counted(b: Column) -> Column:
        return F.struct(b.alias("blocks"), F.transform(b, lambda x: x["num_records"].cast("bigint")).alias("sizes"))

    def capped(c: Column) -> Column:
        records = F.aggregate(c["sizes"], F.lit(0).cast("bigint"), lambda s, n: s + n)
        wide = [x.cast("decimal(19,0)") for x in (limit, records, size)]
        levels = F.transform(c["blocks"], lambda b, i: F.when(i > 0, _level(b, F.get(c["blocks"], i - 1), split_mapped, split_unmapped)))
        return F.struct(c["blocks"].alias("blocks"), c["sizes"].alias("sizes"), levels.alias("levels"), F.call_function("div", wide[0] * wide[1], wide[2]).cast("bigint").alias("cap"))

    return let(let(_ordered_blocks(blocks), counted), capped)


def first_blocks(index: DataFrame, options: DataFrame) -> DataFrame:
    """(index_id, block_no): the first block of each piece but the first."""
    return plan_cuts(index, options).select("index_id", F.explode(F.transform("cuts", lambda i: F.get("plan.blocks", i)["block_no"])).alias("block_no"))


def pieces(index: DataFrame, options: DataFrame) -> DataFrame:
    """Every piece of the entries that are cut, its range widened by the padding on both sides.

    Columns: index_id, piece_no (from 0), first_block, last_block, level (of the cut before it, null for the
    first), records, range_start_ref, range_start_pos, range_limit_ref, range_limit_pos.  Positions aren't widened
    below 0.  An entry without an allowed cut is one piece.  Each piece takes its own slice of blocks.
    """
    begins = F.concat(F.array(F.lit(0)), F.col("cuts"))
    rows = plan_cuts(index, options).select("index_id", "padding", "plan", F.concat(F.col("cuts"), F.array(F.size("plan.blocks"))).alias("ends"), F.posexplode(begins).alias("piece_no", "begin"))
    mine = rows.select("index_id", "piece_no", "padding", F.get("plan.levels", F.col("begin")).alias("level"), F.slice("plan.blocks", F.col("begin") + 1, F.get("ends", F.col("piece_no")) - F.col("begin")).alias("mine"))
    first, last = F.get("mine", F.lit(0)), F.element_at("mine", -1)
    return mine.select(
        "index_id",
        "piece_no",
        first["block_no"].alias("first_block"),
        last["block_no"].alias("last_block"),
        "level",
        F.aggregate("mine", F.lit(0).cast("bigint"), lambda s, b: s + b["num_records"]).alias("records"),
        first["start_ref"].alias("range_start_ref"),
        F.greatest(first["start_pos"] - F.col("padding"), F.lit(0)).alias("range_start_pos"),
        last["end_ref"].alias("range_limit_ref"),
        (last["end_pos"] + F.col("padding")).alias("range_limit_pos"),
    )
