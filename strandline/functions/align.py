"""Expressions over alignment records: flag bits, strands, CIGAR strings and coordinates.

All of them are built-in expressions; null arguments give null unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.exprs import let

# The bits of an alignment's flags.
PAIRED, PROPER_PAIR, UNMAPPED, MATE_UNMAPPED = 0x1, 0x2, 0x4, 0x8
REVERSE, MATE_REVERSE, READ1, READ2 = 0x10, 0x20, 0x40, 0x80
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800

FLAG_NAMES = {
    "paired": PAIRED,
    "proper_pair": PROPER_PAIR,
    "unmapped": UNMAPPED,
    "mate_is_unmapped": MATE_UNMAPPED,
    "is_reverse_strand": REVERSE,
    "mate_is_reverse_strand": MATE_REVERSE,
    "first_of_pair": READ1,
    "second_of_pair": READ2,
    "secondary_alignment": SECONDARY,
    "failed_quality_control": QC_FAIL,
    "duplicate": DUPLICATE,
    "supplementary": SUPPLEMENTARY,
}

STRAND_NONE, STRAND_FORWARD, STRAND_REVERSE = 0, 1, 2


def has_flag(flags: Column, bits: int) -> Column:
    """Whether any of the bits is set."""
    return flags.bitwiseAND(F.lit(bits)) != 0


def is_primary(flags: Column) -> Column:
    return ~has_flag(flags, SECONDARY | SUPPLEMENTARY)


def has_no_mapped_mate(flags: Column) -> Column:
    """Unpaired, or paired with an unmapped mate."""
    return ~has_flag(flags, PAIRED) | has_flag(flags, MATE_UNMAPPED)


def flag_helpers(flags: Column) -> dict[str, Column]:
    """The predicates on flags by name: the twelve bits, and primary, has_no_mapped_mate, linear mates."""
    return {**{name: has_flag(flags, bit) for name, bit in FLAG_NAMES.items()}, "primary": is_primary(flags), "has_no_mapped_mate": has_no_mapped_mate(flags), "mapped": ~has_flag(flags, UNMAPPED), "forward": ~has_flag(flags, REVERSE)}


# Tags: arrays of texts such as `NM:i:3`


def tag(tags: Column, name: str) -> Column:
    """The value of the first tag of a name, as text; null without one."""
    hit = F.get(F.filter(tags, lambda t: t.startswith(F.lit(f"{name}:"))), F.lit(0))
    return F.regexp_replace(hit, "^[^:]*:[^:]*:", "")


def int_tag(tags: Column, name: str) -> Column:
    """A tag's value as a number; a read without the tag, or whose value is none, is an error."""
    value = tag(tags, name).try_cast("bigint")
    return F.coalesce(value, F.raise_error(F.lit(f"a read without a number in tag {name}")).cast("bigint"))


def without_tags(tags: Column, names: Sequence[str]) -> Column:
    """The tags without those of the names, however often they occur."""
    return F.filter(tags, lambda t: ~F.split_part(t, F.lit(":"), F.lit(1)).isin(*names)) if names else tags


def is_linear_duplicate(tags: Column, name: str = "DT", value: str = "SQ") -> Column:
    """Whether the duplicate-type tag marks a copy made in sequencing; false without the tag."""
    return F.coalesce(tag(tags, name) == value, F.lit(False))


def chimeric(flags: Column, ref: Column, mate_ref: Column) -> Column:
    """Paired, both mates mapped, to different references."""
    return has_flag(flags, PAIRED) & ~has_flag(flags, UNMAPPED | MATE_UNMAPPED) & (ref != mate_ref)


def flag_strand(flags: Column) -> Column:
    """The strand of a fragment by the bits of one read: a mapped first read's own, the opposite of a second's.

    0 for unmapped reads and those that aren't exactly one of first and second.
    """
    one, two, back = has_flag(flags, READ1), has_flag(flags, READ2), has_flag(flags, REVERSE)
    return F.when(has_flag(flags, UNMAPPED) | (one == two), STRAND_NONE).when(one != back, STRAND_FORWARD).otherwise(STRAND_REVERSE)


def pair_strand(flags: Column, ref: Column, mate_ref: Column) -> Column:
    """The strand of a fragment whose mates lie on one reference and face each other; 0 for other pairs.

    A read whose mate is unmapped may instead say by equal strand bits which strand it is on.
    """
    one, two = has_flag(flags, READ1), has_flag(flags, READ2)
    back, mate_back = has_flag(flags, REVERSE), has_flag(flags, MATE_REVERSE)
    facing, alone = (back != mate_back) & (one != two), has_flag(flags, MATE_UNMAPPED) & (back == mate_back)
    return (
        F.when(ref != mate_ref, STRAND_NONE)
        .when(facing, F.when(one != back, STRAND_FORWARD).otherwise(STRAND_REVERSE))
        .when(alone, F.when(back, STRAND_REVERSE).otherwise(STRAND_FORWARD))
        .otherwise(STRAND_NONE)
    )


#: Operations that use up bases of the read, of the reference.
READ_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def cigar_ops(cigar: Column) -> Column:
    """The operations of a CIGAR string as an array of structs (length, op); `*` and null give an empty one."""
    texts = F.regexp_extract_all(F.coalesce(cigar, F.lit("*")), F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(texts, lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("length"), F.right(t, F.lit(1)).alias("op")))


def cigar_length(cigar: Column, ops: str) -> Column:
    """The total length of the operations named."""
    texts = F.regexp_extract_all(F.coalesce(cigar, F.lit("*")), F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(texts, F.lit(0), lambda s, t: s + t.cast("int"))


def reference_span(cigar: Column) -> Column:
    return cigar_length(cigar, REFERENCE_OPS)


def read_span(cigar: Column) -> Column:
    return cigar_length(cigar, READ_OPS)


def left_clip(cigar: Column) -> Column:
    """Clipped bases before the first other operation."""
    return cigar_length(F.regexp_extract(F.coalesce(cigar, F.lit("")), r"^((?:\d+[SH])*)", 1), "SH")


def right_clip(cigar: Column) -> Column:
    """Clipped bases after the last other operation."""
    return cigar_length(F.regexp_extract(F.coalesce(cigar, F.lit("")), r"((?:\d+[SH])*)$", 1), "SH")


def five_prime_clip(cigar: Column, flags: Column) -> Column:
    return F.when(has_flag(flags, REVERSE), right_clip(cigar)).otherwise(left_clip(cigar))


def alignment_end(pos: Column, cigar: Column) -> Column:
    """One past the last reference base."""
    return pos + reference_span(cigar)


def unclipped_start(pos: Column, cigar: Column) -> Column:
    return pos - left_clip(cigar)


def unclipped_end(pos: Column, cigar: Column) -> Column:
    """The last reference base if the clipped ones were aligned too."""
    return alignment_end(pos, cigar) + right_clip(cigar) - 1


def unclipped_five_prime(pos: Column, cigar: Column, flags: Column) -> Column:
    return F.when(has_flag(flags, REVERSE), unclipped_end(pos, cigar)).otherwise(unclipped_start(pos, cigar))


def aligned_blocks(pos: Column, cigar: Column) -> Column:
    """The M blocks of an alignment: structs (ref_start, read_start, length), positions from 0.

    I and S use up the read, D and N the reference, H neither.  Other operations make the result null.
    """
    start = F.struct(pos.cast("int").alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<ref_start:int,read_start:int,length:int>>").alias("blocks"))

    def step(s: Column, o: Column) -> Column:
        n, op = o["length"], o["op"]
        on_ref, on_read = F.when(op.isin("M", "D", "N"), n).otherwise(0), F.when(op.isin("M", "I", "S"), n).otherwise(0)
        block = F.array(F.struct(s["ref"].alias("ref_start"), s["read"].alias("read_start"), n.alias("length")))
        return F.struct((s["ref"] + on_ref).alias("ref"), (s["read"] + on_read).alias("read"), F.when(op == "M", F.concat(s["blocks"], block)).otherwise(s["blocks"]).alias("blocks"))

    blocks = let(cigar_ops(cigar), lambda ops: F.aggregate(ops, start, step, lambda s: s["blocks"]))
    return F.when(~F.coalesce(cigar, F.lit("")).rlike("[=XPB]"), blocks)


def read_offset(blocks: Column, at: Column) -> Column:
    """The read offset of the base aligned to reference position ``at``; null if none is."""
    hit = F.filter(blocks, lambda b: (b["ref_start"] <= at) & (at < b["ref_start"] + b["length"]))
    return let(hit, lambda h: F.get(h, F.lit(0))["read_start"] + at - F.get(h, F.lit(0))["ref_start"])


def base_at(seq: Column, qual: Column, pos: Column, cigar: Column, at: Column) -> Column:
    """Struct (inside, base, quality) of reference position ``at``: outside of the read inside is false, at a position that
    the read skips or lacks base and quality are null."""
    blocks = aligned_blocks(pos, cigar)
    inside = (at >= pos) & (at < alignment_end(pos, cigar))
    offset = read_offset(blocks, at)
    return F.struct(F.coalesce(inside, F.lit(False)).alias("inside"), F.when(inside & offset.isNotNull(), F.substring(seq, offset + 1, F.lit(1))).alias("base"), F.when(inside, F.get(qual, offset)).alias("quality"))


# Coordinates: (ref, pos, seq), with reference -1 after all others


def ref_order(ref: Column) -> Column:
    """A number by which references sort: -1, the unmapped one, is last."""
    return F.when(ref < 0, F.lit(2_147_483_647)).otherwise(ref).cast("int")


def coordinate(ref: Column, pos: Column, seq: Column | None = None) -> Column:
    """A struct that compares as coordinates do."""
    return F.struct(ref_order(ref).alias("ref"), pos.cast("int").alias("pos"), (F.lit(0) if seq is None else seq).cast("int").alias("seq"))


def record_position(ref: Column, pos: Column) -> Column:
    """The position of a record; unmapped ones stand at 0."""
    return F.when((ref < 0) & (pos < 0), 0).otherwise(pos)


def sort_key(ref: Column, pos: Column, flags: Column) -> Column:
    """One number for reference, position and strand; unmapped reads share a number above all others."""
    key = F.shiftleft(ref.cast("bigint"), 33).bitwiseOR(F.shiftleft(pos.cast("bigint"), 1)).bitwiseOR(F.when(has_flag(flags, REVERSE), 1).otherwise(0).cast("bigint"))
    return F.when(ref < 0, F.lit(0x7FFFFFFFFFFFFFFE)).otherwise(key)
