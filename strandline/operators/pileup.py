"""Base counts at reference positions (SNP pileup), with stitching of overlapping mates.

Alignments are cut to their M blocks by expressions, the blocks to the wanted intervals by a binned join, and only
the bases that are left are exploded and counted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import align, seq as seqs
from strandline.operators import intervals as iv


@dataclass(frozen=True)
class PileupOptions:
    """Which reads and bases count."""

    flag_exclude: int = 0xF00
    min_mapq: int = 60
    min_base_quality: int = 0
    clip: int = 0
    stitch: bool = False
    strands: bool = True
    only_strand: int = 0
    min_library_bag: int = 0
    min_bag_depth: int = 0
    library_bag_tag: str = "DL"
    bag_tag: str = "DS"
    max_read_length: int = 500
    max_read_span: int = 511

    def check(self) -> None:
        if self.clip < 0 or 2 * self.clip >= self.max_read_length or self.max_read_length > self.max_read_span:
            raise ValueError("clip must not be negative and less than half the read length, which must not exceed the span")


BASES = "ACGT"


def _kept(reads: DataFrame, options: PileupOptions) -> DataFrame:
    """The reads that count, with strand, blocks and end; one of a length or span above the limits is an error."""
    kept = reads.where(
        ~align.has_flag(F.col("flags"), options.flag_exclude)
        & ~align.has_flag(F.col("flags"), align.UNMAPPED)
        & (F.col("mapq") >= options.min_mapq)
        & F.col("ref").isNotNull()
        & (F.col("pos") >= 0)
        & ~F.col("cigar").isin("*", "")
        & (F.col("seq") != "*")
    )
    if options.min_library_bag:
        kept = kept.where(align.int_tag(F.col("tags"), options.library_bag_tag) >= options.min_library_bag)
    if options.min_bag_depth:
        kept = kept.where(align.int_tag(F.col("tags"), options.bag_tag) >= options.min_bag_depth)
    strand = align.pair_strand(F.col("flags"), F.col("ref_id"), F.col("mate_ref_id"))
    quals = seqs.clip_qualities(F.col("qual"), options.clip) if options.clip else F.col("qual")
    mate = [F.col("mate_pos")] if options.stitch else []
    rows = kept.select("read_id", "read_name", "ref", "pos", *mate, "flags", F.upper("seq").alias("seq"), quals.alias("qual"), strand.alias("strand"), align.aligned_blocks(F.col("pos"), F.col("cigar")).alias("blocks"), align.reference_span(F.col("cigar")).alias("span"))
    long, wide = F.length("seq") > options.max_read_length, F.col("span") > options.max_read_span
    limits = f" is longer than {options.max_read_length} bases or spans more than {options.max_read_span}"
    error = F.raise_error(F.concat(F.lit("read "), F.coalesce("read_name", F.lit("null")), F.lit(limits)))
    rows = rows.where(F.when(long | wide, error.cast("boolean")).otherwise(F.col("blocks").isNotNull()))
    if options.only_strand:
        return rows.where(F.col("strand") == options.only_strand)
    return rows.where(F.col("strand") != align.STRAND_NONE) if options.strands else rows


def mate_fragments(reads: DataFrame, max_span: int) -> DataFrame:
    """(read_id, fragment): reads of pairs whose mates overlap; a fragment is the id of the mate that begins first.

    ``reads`` has read_id, read_name, ref, pos, mate_pos, flags, span, strand.  Mates have one name and reference, each
    lies where the other says, the later one begins before the earlier one's end and within ``max_span`` of its start,
    and their strand is known.  Of further reads of a name at the same places the ones of least id are the mates.
    """
    low, high = F.least("pos", "mate_pos"), F.greatest("pos", "mate_pos")
    early = (F.col("pos") < F.col("mate_pos")) | ((F.col("pos") == F.col("mate_pos")) & align.has_flag(F.col("flags"), align.READ1))
    known = reads.where((F.col("strand") != align.STRAND_NONE) & (F.col("mate_pos") >= 0) & F.col("read_name").isNotNull())
    sides = known.groupBy("read_name", "ref", low.alias("low"), high.alias("high")).agg(
        F.min(F.when(early, F.struct("read_id", (F.col("pos") + F.col("span")).alias("limit")))).alias("a"), F.min(F.when(~early, F.col("read_id"))).alias("b")
    )
    met = sides.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("high") < F.col("a.limit")) & (F.col("high") - F.col("low") < max_span))
    return met.select(F.col("a.read_id").alias("fragment"), F.explode(F.array("a.read_id", "b")).alias("read_id"))


def _bases(rows: DataFrame, regions: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """A compact row for each base within the regions; sequences and qualities stay behind."""
    blocks = rows.select(*extra, "read_id", "read_name", "ref", "seq", "qual", "strand", F.inline("blocks")).withColumns({"start": F.col("ref_start"), "limit": F.col("ref_start") + F.col("length")})
    inside = iv.intersections(blocks, iv.union(regions))

    each = inside.select(*extra, "read_id", "read_name", "ref", "strand", "seq", "qual", "ref_start", "read_start", F.explode(F.sequence(F.col("shared_start").cast("bigint"), F.col("shared_limit").cast("bigint") - 1)).alias("pos"))
    offset = (F.col("read_start") + F.col("pos") - F.col("ref_start")).cast("int")
    base = F.substring(F.col("seq"), offset + 1, F.lit(1))
    # The projection stays in the generator's stage, so that rows are compact before anything copies them.
    return each.select(
        *extra,
        "read_id",
        "read_name",
        "ref",
        "strand",
        F.length("seq").alias("read_length"),
        "pos",
        F.when(base.isin(*BASES), base).when(F.length(base) == 1, "N").alias("base"),
        F.coalesce(F.get("qual", offset), F.lit(0)).alias("quality"),
        offset.alias("read_offset"),
    ).where(F.col("base").isNotNull())


def aligned_bases(reads: DataFrame, regions: DataFrame, options: PileupOptions) -> DataFrame:
    """A row for each aligned base within the regions: read_id, read_name, ref, pos, base, quality, strand, read_offset, read_length.

    ``reads`` has read_id, read_name, ref, ref_id, mate_ref_id, pos, mapq, cigar, flags, seq, qual (mate_pos to stitch,
    tags for bag filters).  Reads with an excluded flag, a lower mapq, no CIGAR or one with operations other than M, I,
    D, N, S, H, or no sequence are left out; so are bases whose strand is wanted and unknown.  A read of a length or span
    above the limits is an error.
    """
    return _bases(_kept(reads, options), regions)


def stitched_bases(reads: DataFrame, regions: DataFrame, options: PileupOptions) -> DataFrame:
    """(ref, pos, strand, base, quality): the bases of reads, those of overlapping mates at one position made one.

    Equal bases get the combined quality, unequal ones are N.  Mates meet once a read; only bases of reads with a mate
    are shuffled to meet each other.
    """
    kept = _kept(reads, options)
    mates = mate_fragments(kept, options.max_read_span)
    rows = kept.join(mates, "read_id", "left")
    bases = _bases(rows, regions, ("fragment",))
    columns = ["ref", "pos", "strand", "base", "quality"]
    alone = bases.where(F.col("fragment").isNull()).select(*columns)
    pairs = bases.where(F.col("fragment").isNotNull()).groupBy("fragment", "ref", "pos", "strand").agg(
        F.min("base").alias("x"), F.max("base").alias("y"), F.min("quality").alias("q"), F.max("quality").alias("r"), F.count(F.lit(1)).alias("n")
    )
    both, same = F.col("n") > 1, F.col("x") == F.col("y")
    base = F.when(~both | same, F.col("x")).otherwise("N")
    quality = F.when(both & same, seqs.combined_quality(F.col("q"), F.col("r"))).otherwise(F.col("q"))
    return alone.unionByName(pairs.select("ref", "pos", "strand", base.alias("base"), quality.alias("quality")))


def counts(bases: DataFrame, options: PileupOptions) -> DataFrame:
    """(ref, pos, depth, a_fwd, a_rev, ..., t_rev, n): depth counts every base, the others those of enough quality.

    Bases N count whatever their quality.
    """
    good = (F.col("quality") >= options.min_base_quality) | (F.col("base") == "N")

    def of(base: str, strand: int) -> Column:
        return F.count_if(good & (F.col("base") == base) & (F.col("strand") == strand))

    columns = [of(b, s).alias(f"{b.lower()}_{n}") for b in BASES for s, n in ((align.STRAND_FORWARD, "fwd"), (align.STRAND_REVERSE, "rev"))]
    return bases.groupBy("ref", "pos").agg(F.count(F.lit(1)).alias("depth"), *columns, F.count_if(F.col("base") == "N").alias("n"))


def pileup(reads: DataFrame, regions: DataFrame, options: PileupOptions | None = None, empty: bool = False) -> DataFrame:
    """The counts at every position of the regions that a read covers, or with ``empty`` at every position."""
    options = options or PileupOptions()
    options.check()
    found = counts((stitched_bases if options.stitch else aligned_bases)(reads, regions, options), options)
    if not empty:
        return found
    every = iv.positions(regions)
    numbers = [c for c in found.columns if c not in ("ref", "pos")]
    return every.join(found, ["ref", "pos"], "left").select("ref", "pos", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def alternatives(found: DataFrame, reference: DataFrame) -> DataFrame:
    """(ref, pos, ref_base, alt, n): a row for each base other than the reference's (ref, pos, base) that was seen."""
    wide = found.join(reference.select("ref", "pos", F.col("base").alias("ref_base")), ["ref", "pos"])
    each = F.array(*[F.struct(F.lit(b).alias("alt"), (F.col(f"{b.lower()}_fwd") + F.col(f"{b.lower()}_rev")).alias("n")) for b in BASES])
    return wide.select("ref", "pos", "ref_base", F.inline(each)).where((F.col("n") > 0) & (F.col("alt") != F.col("ref_base")))


# Outputs


def read_features(bases: DataFrame, options: PileupOptions) -> DataFrame:
    """(ref, pos, base, features): of each base seen, what each read says of it, in the order of read_id.

    A feature is a struct (read_id, from_start, from_end, read_length, quality, strand).  N and bases of a low quality
    have none.  Features of stitched mates aren't defined; asking for them is an error.  A position gathers the reads
    that cover it.
    """
    if options.stitch:
        raise ValueError("stitched bases have no features of single reads")
    good = bases.where((F.col("base") != "N") & (F.col("quality") >= options.min_base_quality))
    feature = F.struct("read_id", F.col("read_offset").alias("from_start"), (F.col("read_length") - 1 - F.col("read_offset")).alias("from_end"), "read_length", "quality", "strand")
    return good.groupBy("ref", "pos", "base").agg(F.array_sort(F.collect_list(feature)).alias("features"))


#: Columns that an output may have, and those that it has where nothing is said.
OUTPUT_COLUMNS = ("dpref", "dpalt", "enddists", "quals", "fraglens", "strands", "highq", "lowq")
DEFAULT_COLUMNS = ("dpref", "highq", "lowq")


def column_set(spec: str, default: tuple[str, ...] = DEFAULT_COLUMNS, known: tuple[str, ...] = OUTPUT_COLUMNS) -> tuple[str, ...]:
    """Columns by a list of names, or by changes `+a,-b` of the default; a mixture and unknown names are errors."""
    parts = [p for p in spec.split(",") if p]
    if not parts:
        return default
    signed = [p[0] in "+-" for p in parts]
    names = [p.lstrip("+-") for p in parts]
    if any(signed) != all(signed) or set(names) - set(known):
        raise ValueError(f"not a list of columns: {spec}")
    if not signed[0]:
        return tuple(k for k in known if k in names)
    chosen = set(default)
    for part, name in zip(parts, names, strict=True):
        (chosen.add if part[0] == "+" else chosen.discard)(name)
    return tuple(k for k in known if k in chosen)


_LISTS = {"enddists": (("5P_DISTS", "from_start"), ("3P_DISTS", "from_end")), "quals": (("QUALS", "quality"),), "fraglens": (("FRAGLENS", "read_length"),), "strands": (("STRANDS", "strand"),)}


def _listed(features: Column, name: str) -> Column:
    def shown(f: Column) -> Column:
        return F.when(f["strand"] == align.STRAND_FORWARD, "+").when(f["strand"] == align.STRAND_REVERSE, "-").otherwise(".") if name == "strand" else f[name].cast("string")

    return F.when(F.size(features) > 0, F.array_join(F.transform(features, shown), ",")).otherwise(".")


def _lines(rows: DataFrame, columns: tuple[str, ...], depth: str, tier: str, head: list[Column], features: DataFrame | None) -> DataFrame:
    lists = [c for c in columns if c in _LISTS]
    if lists:
        if features is None:
            raise ValueError("lists of single reads need features")
        rows = rows.join(features.select("ref", "pos", F.col("base").alias("__seen"), "features"), ["ref", "pos", "__seen"], "left")
    out = list(head)
    out += [F.col("depth").alias("DP")] if depth in columns else []
    for c in lists:
        out += [_listed(F.coalesce("features", F.array().cast("array<struct<read_id:bigint,from_start:int,from_end:int,read_length:int,quality:int,strand:int>>")), f).alias(n) for n, f in _LISTS[c]]
    out += [F.col("__n").alias(f"{tier}_depth_tier1")] if "highq" in columns else []
    out += [F.lit(0).cast("bigint").alias(f"{tier}_depth_tier2")] if "lowq" in columns else []
    return rows.select(*out)


def _total(base: str) -> Column:
    return F.col(f"{base.lower()}_fwd") + F.col(f"{base.lower()}_rev")


def reference_lines(found: DataFrame, reference: DataFrame, columns: tuple[str, ...] = DEFAULT_COLUMNS, features: DataFrame | None = None) -> DataFrame:
    """A row for each position of ``found``: #CHROM, POS (from 1), REF and the columns chosen, of the reference's base.

    ``reference`` has (ref, pos, base).  Where it is N, or nothing was seen, lists are a dot.
    """
    rows = found.join(reference.select("ref", "pos", F.upper("base").alias("__ref")), ["ref", "pos"])
    n = F.col("n")
    for b in BASES:
        n = F.when(F.col("__ref") == b, _total(b)).otherwise(n)
    rows = rows.withColumns({"__n": n, "__seen": F.col("__ref")})
    return _lines(rows, columns, "dpref", "ref", [F.col("ref").alias("#CHROM"), (F.col("pos") + 1).alias("POS"), F.col("__ref").alias("REF")], features)


def alternative_lines(found: DataFrame, reference: DataFrame, columns: tuple[str, ...] = DEFAULT_COLUMNS, features: DataFrame | None = None) -> DataFrame:
    """A row for each base other than the reference's that was seen: #CHROM, POS (from 1), REF, ALT and the columns chosen."""
    rows = found.join(reference.select("ref", "pos", F.upper("base").alias("__ref")), ["ref", "pos"])
    each = F.array(*[F.struct(F.lit(b).alias("__seen"), _total(b).alias("__n")) for b in BASES])
    seen = rows.select("ref", "pos", "depth", "__ref", F.inline(each)).where((F.col("__n") > 0) & (F.col("__seen") != F.col("__ref")))
    return _lines(seen, columns, "dpalt", "alt", [F.col("ref").alias("#CHROM"), (F.col("pos") + 1).alias("POS"), F.col("__ref").alias("REF"), F.col("__seen").alias("ALT")], features)


#: The columns of counts by base and strand.
STRAND_COLUMNS = {f"{b}{'+' if s == 'fwd' else '-'}": f"{b.lower()}_{s}" for b in BASES for s in ("fwd", "rev")}


def base_strand_lines(found: DataFrame, reference: DataFrame) -> DataFrame:
    """A row for each position: #CHROM, POS (from 1), REF and A+ A- C+ C- G+ G- T+ T-."""
    rows = found.join(reference.select("ref", "pos", F.upper("base").alias("__ref")), ["ref", "pos"])
    return rows.select(F.col("ref").alias("#CHROM"), (F.col("pos") + 1).alias("POS"), F.col("__ref").alias("REF"), *[F.col(c).alias(n) for n, c in STRAND_COLUMNS.items()])


def write_lines(lines: DataFrame, path: str) -> None:
    """A table of positions as tab-separated text with a header, sorted by place, a file a range."""
    # Another comment character keeps the header's # from being quoted.
    lines.orderBy("#CHROM", "POS").write.mode("overwrite").option("header", True).option("comment", "\x01").csv(path, sep="\t")


def read_base_strand(spark: SparkSession, path: str) -> DataFrame:
    """(ref, pos (from 0), ref_base, a_fwd, ..., t_rev) of tab-separated text of 11 columns; lines that begin with # are left out."""
    schema = "ref string, pos int, ref_base string, " + ", ".join(f"{c} bigint" for c in STRAND_COLUMNS.values())
    return spark.read.csv(path, sep="\t", comment="#", schema=schema).withColumn("pos", F.col("pos") - 1)


#: The columns of counts of one strand.
SINGLE_SCHEMA = "ref string, pos int, depth bigint, ref_base string, a bigint, c bigint, g bigint, t bigint, n bigint, ins bigint, del bigint"


def merged_strands(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """(ref, pos, ref_base, a_fwd, a_rev, ...) of two tables of SINGLE_SCHEMA, one a strand.

    Positions that only one side has, or whose reference bases differ, are an error.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("ref", "pos", F.col("ref_base").alias(f"__{s}"), *[F.col(b.lower()).alias(f"{b.lower()}_{s}") for b in BASES])

    both = side(forward, "fwd").join(side(reverse, "rev"), ["ref", "pos"], "full")
    agree = F.when(F.col("__fwd").eqNullSafe(F.col("__rev")) & F.col("__fwd").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("the strands differ at "), "ref", F.lit(":"), F.col("pos").cast("string"))).cast("boolean"))
    return both.where(agree).select("ref", "pos", F.col("__fwd").alias("ref_base"), *STRAND_COLUMNS.values())


def per_strand(reads: DataFrame, regions: DataFrame, options: PileupOptions | None = None) -> dict[str, DataFrame]:
    """The pileups of the fragments of either strand, ``fwd`` and ``rev``."""
    options = options or PileupOptions()
    sides = {"fwd": align.STRAND_FORWARD, "rev": align.STRAND_REVERSE}
    return {n: pileup(reads, regions, replace(options, only_strand=s)) for n, s in sides.items()}


def checked_references(header: DataFrame, sequences: DataFrame) -> DataFrame:
    """(ref_name, length, found) of a header's references (ref_name, length) against sequences (name, bases).

    A length that differs is an error; a missing sequence comes out with found false.
    """
    lengths = sequences.select(F.col("name").alias("ref_name"), F.length("bases").alias("__length"))
    both = header.join(lengths, "ref_name", "left")
    fits = F.when(F.col("__length").isNull() | (F.col("__length") == F.col("length")), F.col("__length").isNotNull())
    error = F.raise_error(F.concat(F.lit("lengths differ: "), "ref_name")).cast("boolean")
    return both.select("ref_name", "length", F.coalesce(fits, error).alias("found"))


def reference_bases(chunks: DataFrame, regions: DataFrame, chunk: int) -> DataFrame:
    """(ref, pos, base): the bases of chunks (name, chunk_no, bases) within the regions."""
    spans = chunks.select(F.col("name").alias("ref"), (F.col("chunk_no").cast("bigint") * chunk).alias("start"), (F.col("chunk_no").cast("bigint") * chunk + F.length("bases")).alias("limit"), "bases")
    inside = iv.intersections(spans, iv.union(regions))

    def at(pos: Column) -> Column:
        return F.struct(pos.alias("pos"), F.substring(F.col("bases"), (pos - F.col("start") + 1).cast("int"), F.lit(1)).alias("base"))

    return inside.select("ref", F.inline(F.transform(F.sequence(F.col("shared_start").cast("bigint"), F.col("shared_limit").cast("bigint") - 1), at)))
