"""Commands over the operators: python -m strandline.commands view|flagstat|convert|checksum|sort|gindex|pileup|fusion|transcriptome.

Alignment files are binary (.bam), text (.sam) or Parquet folders; what a path is follows from its name and from the
files beside it.  Results go to paths, written by all tasks; only reports of a few lines are printed.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import align
from strandline.functions import seq as seqs
from strandline.operators import alignments, annotation, fusion, fusion_calls, intervals, kmers, pileup
from strandline.plans import filterlang
from strandline.sources import binary, files

#: Reads and references of more than so many header lines aren't expected.
HEADER_LINES = 1 << 20


def header(spark: SparkSession, path: str) -> binary.Header:
    """The header of an alignment file; of a Parquet folder the references that its reads name, without text."""
    if path.endswith(".sam"):
        lines = spark.read.text(path).where(F.col("value").startswith("@")).limit(HEADER_LINES).collect()
        return binary.sam_header("".join(f"{r.value}\n" for r in lines))
    if binary.detect_format(path) == "bam":
        return binary.header_of(path)
    kept = Path(f"{path}/_header.sam")
    if kept.exists():
        return binary.sam_header(kept.read_text())
    rows = spark.read.parquet(path).where(F.col("ref_id") >= 0).groupBy("ref_id").agg(F.max("ref_name").alias("n"), F.max("pos").alias("p")).collect()
    return binary.Header("", [(r.n, r.p + 1) for r in sorted(rows, key=lambda r: r.ref_id)])


def load(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """Records with references by name and number."""
    if path.endswith(".sam"):
        names = header(spark, path).names
        listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")

        def number(c: str) -> Column:
            return (F.coalesce(F.array_position(listed, F.col(c)), F.lit(0)) - 1).cast("int")

        return files.read_sam(spark, path).withColumns({"ref_id": number("ref_name"), "mate_ref_id": number("mate_ref_name")})
    return binary.read_bam(spark, path, index) if binary.detect_format(path, index) == "bam" else spark.read.parquet(path)


def _identified(reads: DataFrame) -> DataFrame:
    """Operators order by read_id; records of files are told apart by what they say."""
    return reads if "read_id" in reads.columns else reads.withColumn("read_id", F.xxhash64("read_name", "flags", "ref_id", "pos", "cigar", "seq"))


def save(reads: DataFrame, path: str, head: binary.Header) -> None:
    """Sorted records as a file of the kind that the path names."""
    rows = alignments.coordinate_sorted(_identified(reads))
    if path.endswith(".sam"):
        text = rows.select(files.sam_line(F.col("template_length"), F.col("tags")).alias("value"))
        text.write.mode("overwrite").text(path)
        Path(f"{path}/_header.sam").write_text(head.text)
    elif path.endswith(".bam"):
        binary.write_bam(rows.drop("read_id"), path, head)
    else:
        files.write_reads(_identified(reads), path)
        Path(f"{path}/_header.sam").write_text(head.text)


def view(spark: SparkSession, args: argparse.Namespace) -> None:
    head = header(spark, args.path)
    if args.header or args.with_header:
        print(head.text, end="")
    if args.header:
        return
    rows = load(spark, args.path, args.index)
    if args.regions:
        rows = rows.where(filterlang.compile_regions(args.regions, head.names))
    if args.filter:
        rows = rows.where(filterlang.compile_filter(args.filter))
    lines = alignments.coordinate_sorted(_identified(rows)).select(files.sam_line(F.col("template_length"), F.col("tags")).alias("value"))
    if args.out:
        lines.write.mode("overwrite").text(args.out)
    else:
        for r in lines.toLocalIterator():
            print(r.value)


def flagstat(spark: SparkSession, args: argparse.Namespace) -> None:
    stats = alignments.flagstat(load(spark, args.path, args.index).select("flags", "ref_id", "mate_ref_id", "mapq"))
    for r in alignments.flagstat_text(stats).orderBy("line_no").collect():
        print(r.line)


def convert(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = load(spark, args.path, args.index)
    if args.drop_tags:
        rows = rows.withColumn("tags", align.without_tags(F.col("tags"), args.drop_tags.split(",")))
    save(rows, args.out, header(spark, args.path))


def checksum(spark: SparkSession, args: argparse.Namespace) -> None:
    fields = list(alignments.CHECKED) if args.all or not args.fields else [f"sum_{f}" for f in args.fields.split(",")]
    sums = alignments.checksum(load(spark, args.path, args.index), fields)
    print(alignments.checksum_json(sums))


def sort(spark: SparkSession, args: argparse.Namespace) -> None:
    heads = [header(spark, p) for p in args.paths]
    parts = [load(spark, p) for p in args.paths]
    save(parts[0] if len(parts) == 1 else alignments.merged_sorted([_identified(p) for p in parts]), args.out, binary.merged_header(heads))


def gindex(spark: SparkSession, args: argparse.Namespace) -> None:
    binary.write_gbai(binary.build_gbai(args.path, args.shard_size), args.out or f"{args.path}.gbai")


def run_pileup(spark: SparkSession, args: argparse.Namespace) -> None:
    if bool(args.bed) == bool(args.region):
        raise ValueError("either --bed or --region is needed")
    options = pileup.PileupOptions(args.flag_exclude, args.mapq, args.min_base_qual, args.clip, args.stitch, args.format == "basestrand", min_library_bag=2 if args.remove_sq else 0, min_bag_depth=args.min_bag_depth, max_read_length=args.max_read_len, max_read_span=args.max_read_span)
    options.check()
    columns = pileup.column_set(args.cols)
    head = header(spark, args.path)
    if args.bed:
        regions = files.read_bed(spark, args.bed, strict=True)
    else:
        name, start, limit = filterlang.parse_region(args.region)
        regions = spark.createDataFrame([(name, start, limit)], "ref string, start int, limit int")
        if limit > dict(head.references).get(name, limit):
            regions = spark.createDataFrame([(name, start, dict(head.references)[name])], "ref string, start int, limit int")
    sequences = files.read_fasta(spark, args.fasta, "clean")
    lengths = spark.createDataFrame(head.references, "ref_name string, length int")
    for r in pileup.checked_references(lengths, sequences).where(~F.col("found")).collect():
        print(f"no sequence for {r.ref_name}", file=sys.stderr)
    reads = _identified(load(spark, args.path, args.index)).withColumnRenamed("ref_name", "ref")
    reference = pileup.reference_bases(files.fasta_chunks(sequences, 10_000), regions, 10_000)
    whole = {"": (reads, options)} if not args.per_strand else {f".strand.{n}": (reads, pileup.replace(options, only_strand=s)) for n, s in (("fwd", align.STRAND_FORWARD), ("rev", align.STRAND_REVERSE))}
    for suffix, (rows, o) in whole.items():
        found = pileup.pileup(rows, regions, o, empty=True)
        if args.format == "basestrand":
            pileup.write_lines(pileup.base_strand_lines(found, reference), f"{args.out}{suffix}.basestrand.tsv")
            continue
        lists = set(columns) & {"enddists", "quals", "fraglens", "strands"}
        features = pileup.read_features(pileup.aligned_bases(rows, regions, o), o) if lists else None
        pileup.write_lines(pileup.reference_lines(found, reference, columns, features), f"{args.out}{suffix}.ref.tsv")
        pileup.write_lines(pileup.alternative_lines(found, reference, columns, features), f"{args.out}{suffix}.alt.tsv")


def fusion_candidates(spark: SparkSession, reads: DataFrame, sequences: DataFrame, pairs: DataFrame | None, options: fusion_calls.FusionOptions, most_genes_per_kmer: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, fragments, genes) of read pairs (read_no, name, r1, r2): screened, stitched, matched to the genes' k-mers, called.

    ``sequences`` are transcripts as from ``fusion_calls.transcriptome``.
    """
    screened = fusion.stitch(fusion.screen_low_complexity(reads, options.low_complexity), options.kmer, fraction=options.low_complexity)
    fragments = screened.select(F.col("read_no").alias("candidate"), F.col("name").alias("fragment_name"), seqs.umi_of_name(F.col("name")).alias("umi"), "r1", "r2")
    occurrences = kmers.exploded_kmers(sequences, "gene", "bases", options.kmer).select("gene", seqs.canonical(F.col("forward"), F.col("revcomp")).alias("kmer"))
    index = fusion.gene_index(occurrences, most_genes_per_kmer)
    sides = [kmers.exploded_kmers(fragments, "candidate", r, options.kmer).select(F.col("candidate").alias("fragment"), (F.col("pos").cast("bigint") + at).alias("pos"), seqs.canonical(F.col("forward"), F.col("revcomp")).alias("kmer")) for r, at in (("r1", 0), ("r2", fusion.R2_OFFSET))]
    hits = sides[0].unionAll(sides[1]).join(index, "kmer").select("fragment", "pos", F.explode("genes").alias("gene"))
    ranges = fusion.gene_ranges(hits, options.kmer)
    lengths = fragments.select(F.col("candidate").alias("fragment"), F.length("r1").alias("length1"), F.length("r2").alias("length2"))
    calls = fusion_calls.fusion_calls(fusion_calls.fragment_genes(ranges, options.most_genes).join(lengths, "fragment"), pairs, options)
    genes = sequences.groupBy("gene").agg(F.min_by(F.struct("chrom", "start", F.col("stop").alias("limit"), "place"), "transcript_id").alias("g")).select("gene", "g.*")
    return calls, fragments, genes


def run_fusion(spark: SparkSession, args: argparse.Namespace) -> None:
    options = fusion_calls.FusionOptions(kmer=args.k, least_span=args.min_span, most_homology=args.max_homology, low_complexity=args.low_complexity_fraction, distance=args.max_proximity_distance, places=args.max_proximity_genes, most_partners=args.max_gene_partners, least_support=args.min_read_support)
    if bool(args.pairs) == args.denovo:
        raise ValueError("either --pairs or --denovo is needed")
    pairs = files.read_gene_pairs(spark, args.pairs) if args.pairs else None
    sequences = fusion_calls.transcriptome(files.read_fasta(spark, args.transcriptome).withColumn("name", F.concat_ws(" ", "name", F.nullif("description", F.lit("")))), pairs)
    both = files.read_fastq_pairs(spark, args.r1, args.r2)
    reads = both.select("read_no", F.regexp_replace("id_1", "^@", "").alias("name"), F.upper("seq_1").alias("r1"), F.upper("seq_2").alias("r2"))
    reads = fusion.strip_umis(reads) if args.umi_in_read else reads
    calls, fragments, genes = fusion_candidates(spark, reads, sequences, pairs, options, args.max_genes_per_kmer)
    calls.write.mode("overwrite").parquet(f"{args.out}/all")
    kept = fusion_calls.filtered(spark.read.parquet(f"{args.out}/all"), fragments, genes, options, args.umi_in_read or args.umi_in_name)
    records = fusion_calls.call_records(kept, fragments, genes, pairs)
    records.orderBy("candidate").select(F.concat_ws("\n", "header", "sequence").alias("value")).write.mode("overwrite").text(f"{args.out}/fasta")
    fusion_calls.gene_numbers(genes).orderBy("gene_no").select("gene").write.mode("overwrite").text(f"{args.out}/genes")


def transcriptome(spark: SparkSession, args: argparse.Namespace) -> None:
    layout = annotation.layout_of(args.separate_junctions, args.whole_genes, args.collapsed)
    rows = files.read_gtf(spark, args.gtf)
    a = F.col("attributes")
    flat = rows.select("chrom", "feature", "range_start", "range_stop", "strand", a["gene_id"].alias("gene_id"), a["gene_name"].alias("gene_name"), a["gene_type"].alias("gene_type"), a["transcript_id"].alias("transcript_id")).withColumn("record_id", F.xxhash64("feature", "gene_id", "transcript_id", "range_start", "range_stop"))
    kept = annotation.genes_kept(flat, keep_mitochondrial=args.keep_mitochondrial, keep_read_through=args.keep_read_through, keep_par_y=args.keep_par_y, keep_versioned=args.keep_versioned)
    chunks = files.read_fasta_chunks(spark, args.fasta, 10_000).withColumnRenamed("name", "chrom")
    if layout in ("genes", "collapsed"):
        pieces = annotation.gene_pieces(kept, args.padding, args.coding_only) if layout == "genes" else annotation.collapsed_pieces(kept, args.padding, args.coding_only)
        texts = annotation.piece_sequences(pieces, "gene_id", chunks, 10_000)
        lines = texts.select(F.concat_ws("\n", F.concat(F.lit(">"), "gene_id", F.lit("|")), "sequence").alias("value"), F.col("gene_id").alias("key"))
    else:
        pieces = annotation.transcript_pieces(kept, args.padding, layout == "junctions", args.retained_bases, args.coding_only)
        genes = kept.where(F.col("feature") == "gene").groupBy("gene_id").agg(F.max("gene_name").alias("gene_name"), F.min("range_start").alias("start"), F.max("range_stop").alias("stop"))
        places = annotation.gene_places(kept).groupBy("gene_id").agg(F.min("place").alias("place"))
        headed = annotation.transcript_headers(pieces, genes.join(places, "gene_id"))
        texts = annotation.piece_sequences(pieces, "transcript_id", chunks, 10_000)
        lines = headed.select("transcript_id", "header").join(texts, "transcript_id").select(F.concat_ws("\n", "header", "sequence").alias("value"), F.col("transcript_id").alias("key"))
    lines.orderBy("key").select("value").write.mode("overwrite").text(args.out)


def regions_of(spark: SparkSession, path: str) -> DataFrame:
    """The union of a BED file."""
    return intervals.union(files.read_bed(spark, path))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run: object, *paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for path in paths:
            p.add_argument(path)
        return p

    p = command("view", view, "path")
    for flag in ("--header", "--with-header"):
        p.add_argument(flag, action="store_true")
    for flag in ("--regions", "--filter", "--index", "--out"):
        p.add_argument(flag)
    command("flagstat", flagstat, "path").add_argument("--index")
    p = command("convert", convert, "path", "out")
    p.add_argument("--index")
    p.add_argument("--drop-tags")
    p = command("checksum", checksum, "path")
    p.add_argument("--index")
    p.add_argument("--fields", help="of flags,mapq,mate,name,seq,qual,cigar")
    p.add_argument("--all", action="store_true")
    p = commands.add_parser("sort")
    p.set_defaults(run=sort)
    p.add_argument("out")
    p.add_argument("paths", nargs="+")
    p = command("gindex", gindex, "path")
    p.add_argument("--shard-size", type=int, default=65_536)
    p.add_argument("--out")
    p = command("pileup", run_pileup, "path", "fasta", "out")
    for flag in ("--bed", "--region", "--index"):
        p.add_argument(flag)
    p.add_argument("--cols", default="")
    p.add_argument("--format", choices=["tsv", "basestrand"], default="tsv")
    for flag, kind in (("--mapq", 60), ("--min-base-qual", 0), ("--clip", 0), ("--flag-exclude", 0xF00), ("--min-bag-depth", 0), ("--max-read-len", 500), ("--max-read-span", 511)):
        p.add_argument(flag, type=int, default=kind)
    for flag in ("--stitch", "--remove-sq", "--per-strand"):
        p.add_argument(flag, action="store_true")
    p = command("fusion", run_fusion, "r1", "r2", "transcriptome", "out")
    p.add_argument("--pairs")
    for flag in ("--denovo", "--umi-in-read", "--umi-in-name"):
        p.add_argument(flag, action="store_true")
    d = fusion_calls.FusionOptions()
    for flag, value in (("-k", d.kmer), ("--min-span", d.least_span), ("--max-homology", d.most_homology), ("--max-genes-per-kmer", 5), ("--max-proximity-distance", d.distance), ("--max-proximity-genes", d.places), ("--max-gene-partners", d.most_partners), ("--min-read-support", d.least_support)):
        p.add_argument(flag, type=int, default=value)
    p.add_argument("--low-complexity-fraction", type=float, default=d.low_complexity)
    p = command("transcriptome", transcriptome, "gtf", "fasta", "out")
    for flag in ("--separate-junctions", "--whole-genes", "--collapsed", "--coding-only", "--keep-mitochondrial", "--keep-read-through", "--keep-par-y", "--keep-versioned"):
        p.add_argument(flag, action="store_true")
    for flag in ("--padding", "--retained-bases"):
        p.add_argument(flag, type=int, default=0)
    return top


def main(words: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(words)
    if spark is None:
        from strandline.session import ship

        spark = SparkSession.builder.appName("strandline").getOrCreate()
        ship(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
