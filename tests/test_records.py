"""Flags, CIGAR, coordinates, filters, pairs and pileup on small cases."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import align, seq
from strandline.operators import alignments, pileup
from strandline.plans import filterlang

READ = "read_id bigint, read_name string, ref_name string, ref string, ref_id int, pos int, mapq int, cigar string, flags int, mate_ref_name string, mate_ref_id int, mate_pos int, template_length int, seq string, qual array<int>"


def read(i, name, pos, cigar, flags, bases, quals, mapq=60, ref=0, mate=0, mate_pos=0):
    return (i, name, f"chr{ref + 1}", f"chr{ref + 1}", ref, pos, mapq, cigar, flags, f"chr{mate + 1}", mate, mate_pos, 20, bases, quals)


@pytest.fixture
def reads(spark):
    return lambda rows: spark.createDataFrame(rows, READ)


@pytest.mark.parametrize(
    ("text", "holds"),
    [
        ('ref_name == "chr1"', True),
        ("position == 122 && mate_position == 455", True),
        ("mapping_quality >= 60", True),
        ("mapping_quality > 60", False),
        ("sequence_length == 4", True),
        ('re(rec_name, "^rea.1$")', True),
        ('re(ref_name, "chr[23]")', False),
        ("paired && !unmapped", True),
        ("duplicate || second_of_pair", False),
        ("chimeric", True),
        ("(ref_id == 0x0) == (mate_ref_id == 1)", True),
        ('!(template_length < 0b101) && rec_name != "x"', True),
    ],
)
def test_filter_language(reads, text, holds):
    df = reads([read(1, "read1", 122, "4M", 65, "ACGT", [1] * 4, mate=1, mate_pos=455)])
    assert df.where(filterlang.compile_filter(text)).count() == int(holds)


@pytest.mark.parametrize("text", ["", "position", "1 == \"a\"", "paired < unmapped", "nothing", "re(rec_name, ref_name)", "(paired", "paired)", "paired &", "re(position, \"x\")", "! 1"])
def test_filter_errors(text):
    with pytest.raises(filterlang.FilterError):
        filterlang.compile_filter(text)


def test_regions():
    assert filterlang.parse_region("chr1:1-1000") == ("chr1", 0, 1000)
    assert filterlang.parse_region("chr1:1000") == ("chr1", 999, 1000)
    assert filterlang.parse_region("chr1") == ("chr1", 0, 2147483646)
    for bad in ("chr1:0-5", "chr1:9-5", "chr1:5-5", ":3"):
        with pytest.raises(filterlang.FilterError):
            filterlang.parse_region(bad)
    with pytest.raises(filterlang.FilterError):
        filterlang.compile_regions("chrQ:1-5", ["chr1"])


def test_cigar(spark):
    df = spark.createDataFrame([("3S2M1I2D4M2H", 100, 16), ("*", 5, 0), (None, 5, 0), ("5H", 7, 0)], "c string, p int, f int")
    c, p, f = F.col("c"), F.col("p"), F.col("f")
    rows = df.select(align.left_clip(c), align.right_clip(c), align.reference_span(c), align.read_span(c), align.unclipped_five_prime(p, c, f), align.aligned_blocks(p, c)).collect()
    assert tuple(rows[0])[:5] == (3, 2, 8, 10, 109)
    assert [tuple(b) for b in rows[0][5]] == [(100, 3, 2), (104, 6, 4)]
    assert tuple(rows[1])[:4] == (0, 0, 0, 0) and rows[1][5] == []
    assert tuple(rows[2])[:4] == (0, 0, 0, 0)
    offsets = df.limit(1).select(*[align.read_offset(align.aligned_blocks(p, c), F.lit(x)) for x in (100, 102, 104, 107, 108)]).first()
    assert tuple(offsets) == (3, None, 6, 9, None)


def test_kernels(spark):
    df = spark.createDataFrame([("acgtNxR",), ("",), ("AAAGTTCAGGT",), (None,)], "s string")
    s = F.col("s")
    rows = df.select(seq.clean(s), seq.reverse_complement(s), seq.unpack(seq.pack(s)), seq.is_low_complexity(s), seq.kmers(s, 5)).collect()
    assert tuple(rows[0])[:3] == ("ACGTNNN", "NNNACGT", "ACGTNNR")
    assert tuple(rows[1])[:4] == ("", "", "", True) and rows[1][4] == []
    assert [tuple(k) for k in rows[2][4]] == [(0, 11, 127), (1, 47, 31), (2, 189, 519), (3, 756, 897), (4, 978, 480), (5, 842, 376), (6, 299, 94)]
    assert rows[3][0] is None
    quality = spark.range(1).select(seq.combined_quality(F.lit(25), F.lit(37)), seq.combined_quality(F.lit(60), F.lit(60)), seq.hamming(F.lit("ACGT"), F.lit("AGGA")), seq.hamming(F.lit("A"), F.lit("AA"))).first()
    assert tuple(quality) == (62, 95, 2, None)


def base_counts(df):
    out = {}
    for r in df.collect():
        out |= {(r.pos, c): r[c] for c in df.columns[3:] if r[c]}
    return out


def regions(spark):
    return spark.createDataFrame([("chr1", 100000, 100005), ("chr1", 100006, 100007)], "ref string, start int, limit int")


def test_pileup_without_overlap(spark, reads):
    df = reads([read(1, "r", 100000, "2M", 1 | 2 | 32 | 64, "AC", [43, 43], mate_pos=100003), read(2, "r", 100003, "2M", 1 | 2 | 16 | 128, "GG", [43, 43], mate_pos=100000)])
    got = pileup.pileup(df, regions(spark), pileup.PileupOptions(min_base_quality=43, stitch=True))
    assert base_counts(got) == {(100000, "a_fwd"): 1, (100001, "c_fwd"): 1, (100003, "g_fwd"): 1, (100004, "g_fwd"): 1}
    every = pileup.pileup(df, regions(spark), pileup.PileupOptions(min_base_quality=43), empty=True)
    assert every.count() == 6 and base_counts(every) == base_counts(got)


def test_pileup_stitches_overlapping_mates(spark, reads):
    df = reads(
        [
            read(1, "r", 100000, "6M", 1 | 2 | 16 | 64, "ACNGGT", [37, 37, 2, 25, 37, 37], mate_pos=100002),
            read(2, "r", 100002, "6M", 1 | 2 | 32 | 128, "NGCTTA", [2, 25, 25, 37, 37, 37], mate_pos=100000),
        ]
    )
    got = base_counts(pileup.pileup(df, regions(spark), pileup.PileupOptions(min_base_quality=43, stitch=True)))
    assert {k: v for k, v in got.items() if k[1] != "n"} == {(100003, "g_rev"): 1}


def test_pileup_leaves_out(spark, reads):
    rows = [
        read(1, "a", 100000, "2M", 1 | 32 | 64, "AC", [43, 43], mapq=59),
        read(2, "b", 100000, "2M", 1 | 32 | 64 | 0x400, "AC", [43, 43]),
        read(3, "c", 100000, "*", 1 | 32 | 64, "AC", [43, 43]),
        read(4, "d", 100000, "2=", 1 | 32 | 64, "AC", [43, 43]),
        read(5, "e", 100000, "2M", 1 | 32 | 64, "AC", [43, 43], mate=1),
    ]
    assert pileup.pileup(reads(rows), regions(spark)).count() == 0
    with pytest.raises(ValueError):
        pileup.PileupOptions(clip=-1).check()


@pytest.mark.parametrize("bases,cigar", [(501, "501M"), (2, "1M510N1M")])
def test_pileup_of_too_long_reads_is_an_error(spark, reads, bases, cigar):
    df = reads([read(1, "far", 100000, cigar, 1 | 32 | 64, "A" * bases, [43] * bases)])
    with pytest.raises(Exception, match="read far is longer than 500 bases or spans more than 511"):
        pileup.pileup(df, regions(spark)).collect()


def test_pairs_and_order(reads):
    df = reads(
        [
            read(1, "p", 10, "5M", 1 | 64, "AAAAA", [1] * 5),
            read(2, "p", 20, "5M", 1 | 128 | 16, "AAAAA", [1] * 5),
            read(3, "p", 20, "5M", 1 | 128 | 256, "AAAAA", [1] * 5),
            read(4, "q", 10, "5M", 1 | 64, "AAAAA", [1] * 5),
            read(5, "u", -1, "*", 4, "A", [1], ref=-1),
            read(6, None, 10, "5M", 1 | 64, "AAAAA", [1] * 5),
        ]
    )
    assert [tuple(r) for r in alignments.bounded_pairs(df, 15).collect()] == [("p", 0, 10, 25, 1, 2)]
    assert alignments.bounded_pairs(df, 14).count() == 0
    assert [tuple(r) for r in alignments.missing_mates(df).collect()] == [("q", True)]
    assert [r.read_id for r in alignments.coordinate_sorted(df).collect()] == [1, 4, 6, 3, 2, 5]
    assert {r.read_id: r.seq_no for r in alignments.with_sequence_number(df).collect()} == {1: 0, 4: 1, 6: 2, 2: 0, 3: 1, 5: 0}
    stats = alignments.flagstat(df).first()
    assert (stats.total, stats.mapped, stats.secondary, stats.paired, stats.r1, stats.r2) == (6, 5, 1, 4, 3, 1)


def test_checksums_ignore_order(reads):
    rows = [read(i, f"r{i}", i * 7 % 50, "5M", 1, "ACGTA", [i] * 5) for i in range(30)]
    a, b = (alignments.checksum(reads(x).repartition(n)).first() for x, n in ((rows, 1), (rows[::-1], 3)))
    changed = alignments.checksum(reads([*rows[:-1], read(29, "r29", 29 * 7 % 50, "5M", 1, "ACGTC", [29] * 5)])).first()
    assert a == b and a.sum_seq != changed.sum_seq and a.sum_name == changed.sum_name


def test_empty_tables(reads, spark):
    none = reads([])
    assert alignments.flagstat(none).count() == alignments.checksum(none).count() == alignments.read_pairs(none).count() == 0
    assert pileup.pileup(none, regions(spark)).count() == 0


def test_tags_and_bases_at_positions(spark):
    df = spark.createDataFrame([(["DS:i:3", "RG:Z:a:b", "DT:Z:SQ"], "ACGTAC", [1, 2, 3, 4, 5, 6], 10, "2S2M1D2M")], "tags array<string>, seq string, qual array<int>, pos int, cigar string")
    t = F.col("tags")
    got = df.select(align.int_tag(t, "DS"), align.tag(t, "RG"), align.tag(t, "XX"), align.is_linear_duplicate(t), align.without_tags(t, ["DS", "DT"])).first()
    assert tuple(got) == (3, "a:b", None, True, ["RG:Z:a:b"])
    with pytest.raises(Exception, match="without a number"):
        df.select(align.int_tag(t, "RG")).collect()
    at = [tuple(r[0]) for r in [df.select(align.base_at(F.col("seq"), F.col("qual"), F.col("pos"), F.col("cigar"), F.lit(p))).first() for p in (9, 10, 11, 12, 13, 14, 15)]]
    assert at == [(False, None, None), (True, "G", 3), (True, "T", 4), (True, None, None), (True, "A", 5), (True, "C", 6), (False, None, None)]


def test_packed_parts_and_words(spark):
    row = spark.range(1).select(seq.unpack(F.lit("1248F"), start=1, limit=3), seq.count_bases(F.lit("CCGA"), "C", 1, 3), seq.two_bit_bytes(F.lit("ACGTT")), seq.fastq_body(F.lit("1032"), F.lit(3), "ACGT" * 4, "#5:I" * 4), seq.checked_umi(F.lit("ACN"))).first()
    assert tuple(row) == ("CG", 1, "E403", "ACG\n+\n#5:", "ACN")
    for bad, known in (("ACX", False), ("ACN", True)):
        with pytest.raises(Exception, match="not a UMI"):
            spark.range(1).select(seq.checked_umi(F.lit(bad), known)).collect()
    assert [r.word for r in seq.words_over(spark, 2, "AC").collect()] == ["AA", "AC", "CA", "CC"]


def test_regions_over_references(spark):
    from strandline.operators import intervals as iv
    from strandline.operators import sampling

    df = spark.createDataFrame([("a", 0, 10), ("b", 5, 9), ("c", 3, 8), ("x", 0, 9), ("c", 8, 8)], "ref string, start int, limit int")
    names = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "ref string, ref_id int")
    assert sorted(tuple(r) for r in iv.within(df, names, ("a", 4), ("c", 5)).collect()) == [("a", 4, 10), ("b", 5, 9), ("c", 3, 5)]
    with pytest.raises(ValueError):
        iv.within(df, names, ("c", 4), ("a", 5))
    left = iv.complement(df.where("ref = 'b'"), references=names.select("ref")).collect()
    assert sorted((r.ref, r.start) for r in left) == [("a", -1), ("b", -1), ("b", 9), ("c", -1), ("d", -1)]
    reads = spark.createDataFrame([(f"n{i // 2}",) for i in range(400)] + [(None,)], "id string")
    kept = sampling.by_rate(reads, 0.5).collect()
    assert len(kept) % 2 == 0 and 120 < len(kept) < 280 and sampling.by_rate(reads, 7).count() == 400
    assert sampling.to_count(reads, 1000).count() == 400 and 40 < sampling.to_count(reads, 100).count() < 170
    with pytest.raises(ValueError):
        sampling.by_rate(reads, -0.1)
