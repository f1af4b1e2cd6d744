"""Fusion building blocks, UMIs, annotation, file formats and streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandline.operators import annotation, fusion
from strandline.sources import files
from strandline.streaming import events


def test_umis_are_snapped(spark):
    def snap(known, umi):
        return tuple(fusion.snap_umis(spark.createDataFrame([(umi,)], "umi string"), "umi", known).first())[1:]

    short, long = ["AAA", "CCC", "GGG", "TTT"], ["AAAA", "CCCC", "GGGG", "TTTT"]
    assert snap(short, "AAA") == ("AAA", 0, False)
    assert snap(short, "TAA") == snap(short, "NAA") == ("AAA", 1, True)
    assert snap(long, "AACC") == ("AACC", -1, False)
    assert snap(long, "AANN") == ("AAAA", 2, True)
    assert snap(long, "ANNN") == ("AAAA", 3, True)
    assert snap(long, "NNNN") == ("NNNN", -1, False)
    assert snap(long, None) == (None, None, None)
    with pytest.raises(ValueError):
        fusion.snap_umis(spark.createDataFrame([("A",)], "umi string"), "umi", ["AX"])


@pytest.mark.parametrize(
    ("r1", "r2", "joined"),
    [
        ("AACCGGTTAC", "GGTTACGTGT", "AACCGGTTACGTGT"),
        ("AACCGGTTACGT", "CCGGTT", "AACCGGTT"),
        ("CCGGTT", "AACCGGTTACGT", "CCGGTTACGT"),
        ("CCGGTTACGT", "AACCGGTT", "CCGGTT"),
        ("AACCGGTTACGTACGTACGTA", "AACCGGTTACGTACGTACGTCGG", "AACCGGTTACGTACGTACGTCGG"),
        ("AACCGGTTAC", "AACCGGTTAC", "AACCGGTTAC"),
        ("AAAAAAAA", "CCCCCCCC", None),
        ("", "ACGT", None),
    ],
)
def test_reads_are_stitched(r1, r2, joined):
    assert fusion.stitch_pair(r1, r2, k=5) == joined


def test_gene_ranges_and_spans(spark):
    hits = spark.createDataFrame([("f", "g", p) for p in (0, 1, 2, 20, 25, 1_000_000_000)] + [("f", "h", 7)] * 2, "fragment string, gene string, pos bigint")
    ranges = fusion.gene_ranges(hits, 5)
    assert sorted(tuple(r) for r in ranges.collect()) == [("f", "g", 0, 7), ("f", "g", 20, 30), ("f", "g", 1_000_000_000, 1_000_000_005), ("f", "h", 7, 12)]
    assert [(r.gene, r.span, r.place) for r in fusion.top_genes(fusion.gene_spans(ranges), 1).collect()] == [("g", 22, 1)]


def test_gene_index_has_a_cap(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (None, "a"), (3, None)] + [(9, g) for g in "abcdef"], "kmer bigint, gene string")
    assert sorted((r.kmer, r.genes) for r in fusion.gene_index(rows).collect()) == [(1, ["a", "b"]), (2, ["a"])]


CANDIDATE = "candidate bigint, gene1 string, gene2 string, span1 int, span2 int, umi string, r1 string, r2 string"


def test_candidate_filters(spark):
    rows = [(1, "a", "b", 30, 30, None, "", ""), (2, "b", "a", 30, 30, None, "", ""), (3, "c", "d", 30, 30, "AC", "", ""), (4, "c", "d", 30, 30, "AC", "", ""), (5, "a", "b", 9, 30, None, "", "")]
    df = spark.createDataFrame(rows, CANDIDATE)
    wide = spark.createDataFrame([(i, "hub", f"x{i}", 30, 30, None, "", "") for i in range(6)] + [(9, "a", "b", 30, 30, None, "", "")], CANDIDATE)
    assert [r.candidate for r in fusion.without_promiscuous(wide).collect()] == [9]
    genes = spark.createDataFrame([("a", "1", 0, 10, 0), ("b", "1", 100, 110, 1), ("c", "1", 5000, 5010, 9), ("d", "2", 0, 9, 0)], "gene string, chrom string, start int, limit int, place int")
    assert sorted(r.candidate for r in fusion.without_neighbours(df, genes, 500, 0).collect()) == [3, 4]
    assert fusion.without_neighbours(df, genes, 0, 0).count() == 5


def test_umi_strip_and_screen(spark):
    df = spark.createDataFrame([("n x", "ACGTACGAAAT", "TTTTTTGCCCC"), ("m:ACG+TTT", "ACGTACGAAAT", "TTTTTTGCCCC"), ("s", "ACG", "TTTTTTGCCCC")], "name string, r1 string, r2 string")
    assert [tuple(r) for r in fusion.strip_umis(df).collect()] == [("n:ACGTAC+TTTTTT x", "AAAT", "CCCC"), ("m:ACG+TTT", "AAAT", "CCCC"), ("s", "N", "")]
    screened = spark.createDataFrame([("AAAAAAAAAA", "ACGTTGCAAC"), ("ACGTTGCAAC", "CCCCCCCCCC"), ("AAAA", "TTTT"), ("ACGTTGCAAC", "ACGTTGCATT")], "r1 string, r2 string")
    assert [tuple(r) for r in fusion.screen_low_complexity(screened).collect()] == [("GTTGCAACGT", ""), ("ACGTTGCAAC", ""), ("N", ""), ("ACGTTGCAAC", "AATGCAACGT")]


def test_spliced_transcripts(spark):
    bases = "ACGTACGTTTGGCCAA"
    chunks = files.fasta_chunks(spark.createDataFrame([("c", bases)], "name string, bases string"), 5)
    exons = spark.createDataFrame([("t", "c", "+", 2, 7), ("t", "c", "+", 11, 12), ("u", "c", "-", 4, 6)], "transcript_id string, chrom string, strand string, range_start int, range_stop int")
    got = {r.transcript_id: r.sequence for r in annotation.spliced(exons, chunks.withColumnRenamed("name", "chrom"), 5).collect()}
    assert got == {"t": bases[1:7] + bases[10:12], "u": "GTA"}
    assert files.fasta_range(chunks, "c", 3, 13, 5).first().bases == bases[3:13]


def test_fastq_is_read_in_ranges(spark, tmp_path):
    lines = [(f"@r{i}", "ACGT"[: i % 4 + 1], "+", "@I+#"[: i % 4 + 1]) for i in range(50)]
    text = "".join("\n".join(x) + "\n" for x in lines)
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    for name in ("a.fq", "b.fq.gz"):
        got = files.read_fastq(spark, str(tmp_path / name), split=64)
        assert sorted(tuple(r) for r in got.select("id", "seq", "unk", "qual").collect()) == sorted(lines)
    (tmp_path / "bad.fq").write_text("@a\nAC\n-\nII\n")
    with pytest.raises(files.FastqError):
        list(files.fastq_records(str(tmp_path / "bad.fq")))
    pairs = files.read_fastq_pairs(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz"))
    assert pairs.where(F.col("id_1") == F.col("id_2")).count() == 50
    numbered = files.with_record_number(files.read_fastq(spark, str(tmp_path / "a.fq"), split=64), stretch=100)
    assert [r.id for r in numbered.orderBy("read_no").collect()] == [x[0] for x in lines]
    assert [r.read_no for r in numbered.orderBy("offset").collect()] == list(range(50))
    with pytest.raises(Exception, match="unequal"):
        (tmp_path / "short.fq").write_text("@r0\nA\n+\n@\n")
        files.read_fastq_pairs(spark, str(tmp_path / "a.fq"), str(tmp_path / "short.fq")).collect()


def test_text_formats(spark, tmp_path):
    (tmp_path / "x.bed").write_text("chr1 5 9 name\n\nchr2\t1\t2\n")
    assert [tuple(r) for r in files.read_bed(spark, str(tmp_path / "x.bed")).collect()] == [("chr1", 5, 9), ("chr2", 1, 2)]
    (tmp_path / "x.fa").write_text(">a first one\nACGT\nAC\n>b\nGG\n")
    assert [tuple(r) for r in files.read_fasta(spark, str(tmp_path / "x.fa")).collect()] == [("a", "first one", "ACGTAC"), ("b", "", "GG")]
    (tmp_path / "y.fa").write_text(">s1 gene A->B\nAC>T\nGT\n>s2\n" + "ACGTA\n" * 40 + "AC\n>s3\n")
    whole = {"s1": ("gene A->B", "AC>TGT"), "s2": ("", "ACGTA" * 40 + "AC"), "s3": ("", "")}
    assert {r.name: (r.description, r.bases) for r in files.read_fasta(spark, str(tmp_path / "y.fa")).collect()} == whole
    for split in (7, 50, 1000):
        rows = files.read_fasta_source(spark, str(tmp_path / "y.fa"), 16, split).collect()
        assert {n: "".join(r.bases for r in sorted(rows, key=lambda r: r.chunk_no) if r.name == n) for n in whole} == {n: b for n, (_, b) in whole.items()}
        assert len(rows) == 1 + 13 + 1
    index = files.fasta_index(spark, str(tmp_path / "y.fa"))
    assert [tuple(r) for r in index.collect()] == [("s1", 6, 14, 4, 5), ("s2", 202, 26, 5, 6), ("s3", 0, 273, 0, 0)]
    files.write_fai(index, str(tmp_path / "fai"))
    fai = next((tmp_path / "fai").glob("part*"))
    fasta = files.FastaFile.open(str(tmp_path / "y.fa"), str(fai))
    assert fasta.names() == ["s1", "s2", "s3"] and fasta.get("s2", 3, 12) == whole["s2"][1][3:12] and fasta.get("s2", 0, 202) == whole["s2"][1]
    for bad in (("s2", 5, 5), ("s2", 0, 203), ("s2", -1, 4)):
        with pytest.raises(ValueError):
            fasta.get(*bad)
    with pytest.raises(KeyError):
        fasta.get("none", 0, 1)
    (tmp_path / "none.fa").write_text("")
    with pytest.raises(ValueError):
        files.fasta_index(spark, str(tmp_path / "none.fa"))
    assert [tuple(r) for r in files.read_bed(spark, str(tmp_path / "x.bed"), strict=True, invert=True).orderBy("ref", "start").collect()][0] == ("chr1", -1, 5)
    (tmp_path / "bad.bed").write_text("chr1\t9\t5\n")
    with pytest.raises(Exception, match="not an interval"):
        files.read_bed(spark, str(tmp_path / "bad.bed"), strict=True).collect()
    (tmp_path / "x.gtf").write_text('#c\nchr1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "G"; gene_name "N";\nchr1\ts\tCDS\t1\t9\t.\t+\t.\tgene_id "G";\n')
    row = files.read_gtf(spark, str(tmp_path / "x.gtf")).collect()
    assert len(row) == 1 and row[0].attributes == {"gene_id": "G", "gene_name": "N"}
    line = "read1\t99\tchr1\t123\t60\t4M\t=\t456\t0\tACGT\tABCD"
    (tmp_path / "x.sam").write_text("@HD\tx\n" + line + "\tRG:Z:N\n")
    sam = files.read_sam(spark, str(tmp_path / "x.sam"))
    assert sam.first().tags == ["RG:Z:N"] and sam.first().qual == [32, 33, 34, 35]
    assert sam.select(files.sam_line()).first()[0] == line
    (tmp_path / "p.tsv").write_text("Genes\tPapers\na/b\t1\nc\t2\n")
    assert [tuple(r) for r in files.read_gene_pairs(spark, str(tmp_path / "p.tsv")).collect()] == [("a", "b")]


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 6 % 24:02d}:{i % 6}0:00", i % 3, i % 7) for i in range(200)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "event_id int, ts string, user_id int, value int").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(path)
    batch = spark.read.parquet(path)
    for operator in (lambda e: events.tumbling_counts(e, "ts", "user_id", "value", lateness="30 days"), lambda e: events.sessions(e, "ts", "user_id", lateness="30 days")):
        stream = events.replay(spark, path, operator)
        assert stream.exceptAll(operator(batch)).isEmpty()
    once = events.replay(spark, path, lambda e: events.first_of_each(e, "ts", ["value"], "30 days"))
    assert once.count() == 7


def test_low_complexity_links_are_dropped(spark):
    r2 = fusion.R2_OFFSET
    rows = [
        (1, 0, 4, r2, r2 + 4, "ACGT", "ACGT"),
        (2, 0, 4, r2, r2 + 4, "AAAC", "ACGT"),
        (3, 0, 4, r2, r2 + 4, "ACGT", "GGGC"),
        (4, 2, r2 + 2, 0, 4, "ACGT", "ACGT"),
        (5, 2, r2 + 2, 0, 4, "ACAA", "CCGT"),
        (6, 1, 1, 0, 4, "ACGT", "ACGT"),
    ]
    df = spark.createDataFrame(rows, "candidate int, start1 bigint, limit1 bigint, start2 bigint, limit2 bigint, r1 string, r2 string")
    assert sorted(r.candidate for r in fusion.without_low_complexity(df).collect()) == [1, 4]
    got = spark.createDataFrame([("AAAC", "CGGT")], "r1 string, r2 string").select(*[fusion.covered(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")) for a, b in ((0, 3), (0, r2 + 1), (r2, r2 + 3))]).first()
    assert tuple(got) == ("AAA", "AAACC", "CGG")


def test_genes_are_left_out_by_name(spark):
    rows = [("g1", "A-B", "1"), ("g2", "A-B-C", "1"), ("g3", "HLA-A", "1"), ("g4", "MT-X", "1"), ("g5", "A-12", "1"), ("g6", "A.1", "1"), ("g7_PAR_Y", "P", "1"), ("g8", "Q_PAR_Y", "1"), ("g9", "M", "chrM"), ("g10", None, None)]
    df = spark.createDataFrame(rows, "gene_id string, gene_name string, chrom string")
    assert {r.gene_id for r in annotation.genes_kept(df).collect()} == {"g3", "g4", "g5", "g8", "g10"}
    assert annotation.genes_kept(df, keep_mitochondrial=True, keep_read_through=True, keep_par_y=True, keep_versioned=True).count() == 10
