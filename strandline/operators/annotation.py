"""Transcripts and genes from annotation records (closed ranges from 1: range_start, range_stop)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.operators.periods import merged_and_gaps

#: The kinds of genes whose transcripts count as coding.
CODING_TYPES = [
    "protein_coding",
    "nonsense_mediated_decay",
    "non_stop_decay",
    "IG_C_gene",
    "IG_D_gene",
    "IG_J_gene",
    "IG_LV_gene",
    "IG_V_gene",
    "TR_C_gene",
    "TR_D_gene",
    "TR_J_gene",
    "TR_V_gene",
    "polymorphic_pseudogene",
]


def valid_ranges(records: DataFrame) -> DataFrame:
    return records.where("range_start <= range_stop")


def transcripts(records: DataFrame, coding_only: bool = False) -> DataFrame:
    """(transcript_id, gene_id, chrom, strand, gene_type, n_exons, exon_bases): transcripts with the exons they have.

    Transcripts need a gene of the same id and chromosome; exons of unknown transcripts are left out (see
    ``orphans``).  Repeated records of one transcript give one row, the one of least record_id.
    """
    rows = valid_ranges(records)
    genes = rows.where(F.col("feature") == "gene").select("gene_id", "chrom").distinct()
    named = rows.where((F.col("feature") == "transcript") & F.col("transcript_id").isNotNull())
    if coding_only:
        named = named.where(F.col("gene_type").isin(CODING_TYPES))
    one = named.groupBy("transcript_id").agg(F.min_by(F.struct("gene_id", "chrom", "strand", "gene_type"), "record_id").alias("t")).select("transcript_id", "t.*")
    exons = rows.where(F.col("feature") == "exon").groupBy("transcript_id", "gene_id", "chrom").agg(F.count(F.lit(1)).alias("n_exons"), F.sum((F.col("range_stop") - F.col("range_start") + 1).cast("bigint")).alias("exon_bases"))
    return one.join(genes, ["gene_id", "chrom"], "left_semi").join(exons, ["transcript_id", "gene_id", "chrom"]).select("transcript_id", "gene_id", "chrom", "strand", "gene_type", "n_exons", "exon_bases")


def orphans(records: DataFrame) -> DataFrame:
    """(record_id, feature): transcripts without their gene and exons without their transcript."""
    genes = records.where(F.col("feature") == "gene").select("gene_id").distinct()
    named = records.where(F.col("feature") == "transcript").select("transcript_id").distinct()
    lost = records.where(F.col("feature") == "transcript").join(genes, "gene_id", "left_anti")
    stray = records.where(F.col("feature") == "exon").join(named, "transcript_id", "left_anti")
    return lost.select("record_id", "feature").unionByName(stray.select("record_id", "feature"))


def padded_exons(records: DataFrame, padding: int) -> DataFrame:
    """(transcript_id, chrom, kind, range_start, range_stop): the exons of a transcript widened by the padding and merged.

    Starts don't go below 1.  ``kind`` is merged; touching exons are one.
    """
    exons = valid_ranges(records).where(F.col("feature") == "exon")
    wide = exons.withColumns({"range_start": F.greatest(F.col("range_start") - padding, F.lit(1)), "range_stop": F.col("range_stop") + padding})
    return merged_and_gaps(wide, ["transcript_id", "chrom"], "range_start", "range_stop").where(F.col("kind") == "merged")


def gene_places(records: DataFrame) -> DataFrame:
    """(gene_id, chrom, place): genes numbered from 0 along each chromosome by start, ties by id.

    A gene's start is its least record's; the window runs over genes, of which a chromosome has few.
    """
    genes = valid_ranges(records).where((F.col("feature") == "gene") & F.col("gene_id").isNotNull()).groupBy("gene_id", "chrom").agg(F.min("range_start").alias("start"))
    return genes.select("gene_id", "chrom", (F.row_number().over(W.partitionBy("chrom").orderBy("start", "gene_id")) - 1).cast("int").alias("place"))


def genes_kept(
    genes: DataFrame, gene_id: str = "gene_id", name: str = "gene_name", chrom: str = "chrom", keep_mitochondrial: bool = False, keep_read_through: bool = False, keep_par_y: bool = False, keep_versioned: bool = False
) -> DataFrame:
    """Leaves out genes of chrM, with `_PAR_Y` in the id, with a dot in the name, and read-through genes (`A-B...`).

    A name with a hyphen isn't a read-through if it begins with HLA or MT or its second part is a number.  Null names,
    ids and chromosomes stay.
    """
    parts = F.split(F.col(name), "-", -1)
    through = (F.size(parts) > 1) & ~F.get(parts, F.lit(0)).isin("HLA", "MT") & ~F.get(parts, F.lit(1)).rlike("^[0-9]+$")
    dropped = [
        (keep_mitochondrial, F.col(chrom) == "chrM"),
        (keep_par_y, F.col(gene_id).contains("_PAR_Y")),
        (keep_versioned, F.col(name).contains(".")),
        (keep_read_through, F.col(name).isNotNull() & through),
    ]
    for kept, condition in dropped:
        if not kept:
            genes = genes.where(~F.coalesce(condition, F.lit(False)))
    return genes


def spliced(exons: DataFrame, reference: DataFrame, chunk: int, keys: Sequence[str] = ("transcript_id",)) -> DataFrame:
    """(keys, sequence): the exons' bases one after the other, reverse-complemented on the minus strand.

    ``reference`` has (chrom, chunk_no, bases) with chunks of ``chunk`` bases; an exon gathers the chunks it spans.
    """
    from strandline.functions import seq as seqs

    pieces = exons.select(*keys, "chrom", "strand", "range_start", "range_stop", F.explode(F.expr(f"sequence((range_start - 1) div {chunk}, (range_stop - 1) div {chunk})")).alias("chunk_no"))
    low = F.greatest(F.col("range_start") - 1 - F.col("chunk_no") * chunk, F.lit(0)).cast("int")
    high = F.least(F.col("range_stop") - F.col("chunk_no") * chunk, F.lit(chunk)).cast("int")
    cut = pieces.join(reference.withColumn("chunk_no", F.col("chunk_no").cast("bigint")), ["chrom", "chunk_no"]).withColumn("part", F.substring(F.col("bases"), low + 1, high - low))
    ordered = F.array_sort(F.collect_list(F.struct("range_start", "chunk_no", "part")))
    whole = cut.groupBy(*keys, "strand").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("sequence"))
    return whole.select(*keys, F.when(F.col("strand") == "-", seqs.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")).alias("sequence"))


# Layouts of a transcriptome: pieces of the reference in order, `|` between those that don't follow each other


def layout_of(separate_junctions: bool = False, whole_genes: bool = False, collapsed: bool = False) -> str:
    """The one layout that is asked for; more than one is an error."""
    asked = [n for n, on in (("junctions", separate_junctions), ("genes", whole_genes), ("collapsed", collapsed)) if on]
    if len(asked) > 1:
        raise ValueError(f"layouts exclude each other: {', '.join(asked)}")
    return asked[0] if asked else "exons"


_PIECE = "array<struct<start:int,stop:int>>"


def _touching(a: Column, b: Column) -> Column:
    """Whether closed ranges overlap or touch."""
    return F.when(a["start"] <= b["start"], b["start"] <= a["stop"] + 1).otherwise(a["start"] - 1 <= b["stop"])


def _last(pieces: Column) -> Column:
    return F.element_at(pieces, -1)


def _replaced(pieces: Column, last: Column) -> Column:
    return F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(last))


def merged_in_order(ranges: Column) -> Column:
    """Closed ranges in their order, each merged into the last one if it overlaps or touches that."""

    def step(done: Column, r: Column) -> Column:
        both = F.struct(F.least(_last(done)["start"], r["start"]).alias("start"), F.greatest(_last(done)["stop"], r["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & _touching(_last(done), r), _replaced(done, both)).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, F.array().cast(_PIECE), step)


def junctions(exons: Column, strand: Column, padding: int, kept: int) -> Column:
    """The windows around the ends of each exon: ``padding`` bases outside and ``kept`` inside.

    Exons come in the order of the transcript.  Where the first window of an exon meets the last one before it, only
    the far end of that one moves: the stop on the plus strand, the start on the minus strand.
    """

    def step(done: Column, e: Column) -> Column:
        begin = F.struct((e["start"] - padding).alias("start"), (e["start"] + kept).alias("stop"))
        end = F.struct((e["stop"] - kept).alias("start"), (e["stop"] + padding).alias("stop"))
        first, second = (F.when(strand == "-", x).otherwise(y) for x, y in ((end, begin), (begin, end)))
        last = _last(done)
        moved = F.when(strand == "-", F.struct(first["start"].alias("start"), last["stop"].alias("stop"))).otherwise(F.struct(last["start"].alias("start"), first["stop"].alias("stop")))
        joined = F.when((F.size(done) > 0) & _touching(last, first), _replaced(done, moved)).otherwise(F.concat(done, F.array(first)))
        return F.concat(joined, F.array(second))

    return F.aggregate(exons, F.array().cast(_PIECE), step)


def _ordered_exons() -> Column:
    """The exons of a group in the order of the transcript: falling on the minus strand."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("range_start").cast("int").alias("start"), F.col("range_stop").cast("int").alias("stop"))))
    return F.when(F.first("strand") == "-", F.reverse(listed)).otherwise(listed)


def transcript_pieces(records: DataFrame, padding: int = 0, separate_junctions: bool = False, kept: int = 0, coding_only: bool = False) -> DataFrame:
    """(transcript_id, gene_id, chrom, strand, exon_lengths, exons, junctions) of each transcript with exons.

    Without ``separate_junctions`` exons are widened by the padding (not below 0) and merged in order, and junctions is
    empty; with it exons stay as they are and junctions has the windows around their ends.  A transcript's exons, of
    which it has few, meet in one row.
    """
    rows = valid_ranges(records)
    named = rows.where((F.col("feature") == "transcript") & F.col("transcript_id").isNotNull())
    named = named.where(F.col("gene_type").isin(CODING_TYPES)) if coding_only else named
    one = named.groupBy("transcript_id").agg(F.min_by(F.struct("gene_id", "chrom", "strand"), "record_id").alias("t")).select("transcript_id", "t.*")
    exons = rows.where(F.col("feature") == "exon").select("transcript_id", "gene_id", "chrom", "range_start", "range_stop")
    gathered = exons.join(one, ["transcript_id", "gene_id", "chrom"]).groupBy("transcript_id", "gene_id", "chrom", "strand").agg(_ordered_exons().alias("listed"))
    lengths = F.transform("listed", lambda e: e["stop"] - e["start"] + 1)
    wide = F.transform("listed", lambda e: F.struct(F.greatest(e["start"] - padding, F.lit(0)).alias("start"), (e["stop"] + padding).alias("stop")))
    pieces = F.col("listed").cast(_PIECE) if separate_junctions else merged_in_order(wide)
    windows = junctions(F.col("listed"), F.col("strand"), padding, kept) if separate_junctions else F.array().cast(_PIECE)
    return gathered.select("transcript_id", "gene_id", "chrom", "strand", lengths.alias("exon_lengths"), pieces.alias("exons"), windows.alias("junctions"))


def collapsed_pieces(records: DataFrame, padding: int = 0, coding_only: bool = False) -> DataFrame:
    """(gene_id, chrom, strand, exons): the merged exons of all transcripts of each gene, falling on the minus strand."""
    each = transcript_pieces(records, padding, coding_only=coding_only).select("gene_id", "chrom", "strand", F.inline("exons"))
    merged = merged_and_gaps(each, ["gene_id", "chrom", "strand"], "start", "stop").where(F.col("kind") == "merged")
    listed = F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))))
    return merged.groupBy("gene_id", "chrom", "strand").agg(listed.alias("listed")).select("gene_id", "chrom", "strand", F.when(F.col("strand") == "-", F.reverse("listed")).otherwise(F.col("listed")).alias("exons"))


def gene_pieces(records: DataFrame, padding: int = 0, coding_only: bool = False) -> DataFrame:
    """(gene_id, chrom, strand, exons): each gene as one piece with the padding on both sides, not below 1."""
    genes = valid_ranges(records).where((F.col("feature") == "gene") & F.col("gene_id").isNotNull())
    genes = genes.where(F.col("gene_type").isin(CODING_TYPES)) if coding_only else genes
    one = genes.groupBy("gene_id", "chrom").agg(F.min_by(F.struct("range_start", "range_stop", "strand"), "record_id").alias("g"))
    piece = F.struct(F.greatest(F.col("g.range_start").cast("int") - padding, F.lit(1)).alias("start"), (F.col("g.range_stop").cast("int") + padding).alias("stop"))
    return one.select("gene_id", "chrom", F.col("g.strand").alias("strand"), F.array(piece).alias("exons"))


def transcript_headers(pieces: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds header: `>transcript|name|chrom:start-stop:place|lengths` by genes (gene_id, gene_name, start, stop, place)."""
    spot = F.format_string("%s:%d-%d:%d", "chrom", "start", "stop", "place")
    lengths = F.array_join(F.transform("exon_lengths", lambda n: n.cast("string")), ",")
    rows = pieces.join(genes.select("gene_id", "gene_name", "start", "stop", "place"), "gene_id")
    return rows.withColumn("header", F.concat_ws("|", F.concat(F.lit(">"), F.col("transcript_id")), "gene_name", spot, lengths)).select(*pieces.columns, "header")


def strict_reverse_complement(seq: Column) -> Column:
    """Of A, C, G, T and N in any case; any other letter is an error."""
    from strandline.functions import seq as seqs

    return F.when(seq.rlike("[^ACGTNacgtn]"), F.raise_error(F.concat(F.lit("not a base in "), seq)).cast("string")).otherwise(seqs.reverse_complement(seq))


def piece_sequences(pieces: DataFrame, key: str, reference: DataFrame, chunk: int) -> DataFrame:
    """(key, sequence): the exons' bases one after the other, each junction (or, without a column junctions, each exon
    after the first) behind a bar; pieces on the minus strand are reverse-complemented one by one.

    ``reference`` has (chrom, chunk_no, bases); a piece gathers the chunks that it spans.
    """
    tagged = [F.transform("exons", lambda e, i: F.struct(i.alias("i"), F.lit("" if "junctions" in pieces.columns else "|").alias("bar"), e["start"].alias("start"), e["stop"].alias("stop")))]
    if "junctions" in pieces.columns:
        tagged.append(F.transform("junctions", lambda e, i: F.struct((i + F.size("exons")).alias("i"), F.lit("|").alias("bar"), e["start"].alias("start"), e["stop"].alias("stop"))))
    each = pieces.select(key, "chrom", "strand", F.inline(F.concat(*tagged)))
    spans = each.withColumn("chunk_no", F.explode(F.expr(f"sequence(greatest(start - 1, 0) div {chunk}, (stop - 1) div {chunk})")))
    low = F.greatest(F.col("start") - 1 - F.col("chunk_no") * chunk, F.lit(0)).cast("int")
    high = F.least(F.col("stop") - F.col("chunk_no") * chunk, F.lit(chunk)).cast("int")
    cut = spans.join(reference.withColumn("chunk_no", F.col("chunk_no").cast("bigint")), ["chrom", "chunk_no"]).withColumn("part", F.substring(F.col("bases"), low + 1, high - low))
    whole = cut.groupBy(key, "strand", "i", "bar").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "part"))), lambda x: x["part"]), "").alias("piece"))
    turned = whole.withColumn("piece", F.when(F.col("strand") == "-", strict_reverse_complement(F.col("piece"))).otherwise(F.col("piece")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "bar", "piece"))), lambda x, n: F.concat(F.when(n > 0, x["bar"]).otherwise(""), x["piece"]))
    return turned.groupBy(key).agg(F.array_join(parts, "").alias("sequence"))
