"""Calls of gene fusions: joint spans, choice, filters, names, outputs."""

import random

import pytest

from strandline.operators import fusion_calls as fc
from strandline.operators.fusion import R2_OFFSET

R2 = R2_OFFSET


def spans(*pairs):
    return [fc.Span(a, b) for a, b in pairs]


def gene(name, *pairs):
    ranges = spans(*pairs)
    return fc.Gene(name, sum(r.size for r in ranges if r.start < R2), sum(r.size for r in ranges if r.start >= R2), ranges)


def test_joint_span_across_reads():
    # The published case of two genes on both reads of a fragment.
    options = fc.FusionOptions(kmer=13, most_gap=6, most_homology=13, least_span=13)
    a, b = gene("Y", (0, 142), (R2 + 160, R2 + 202), (R2 + 203, R2 + 259)), gene("N", (R2 + 250, R2 + 284))
    found = fc.calls_of([a, b], 145, 145, options)
    assert found == [(a, b, fc.Joint(265, 240, 25, fc.Span(0, R2 + 259), fc.Span(R2 + 259, R2 + 284), True))]
    assert fc.calls_of([a, b], 145, 145, options, set()) == []
    assert len(fc.calls_of([a, b], 145, 145, options, {frozenset("YN")})) == 1


def covered(ranges, until, since=None):
    return sum(max(0, min(r.limit, until) - r.start) for r in ranges) if since is None else sum(max(0, r.limit - max(r.start, since)) for r in ranges)


def test_joint_span_is_the_best_junction():
    """Against every junction: a gene up to one of its ranges' ends, the other from a range's start or that end on."""
    rng = random.Random(3)
    options = fc.FusionOptions(most_gap=9, most_homology=10**9)

    def some():
        at, out = 0, []
        for _ in range(rng.randint(1, 4)):
            at += rng.randint(1, 12)
            out.append((at, at + rng.randint(3, 15)))
            at = out[-1][1]
        return spans(*out)

    for _ in range(3000):
        one, two = some(), some()
        best = max(sum(r.size for r in one), sum(r.size for r in two))
        for x, y in ((one, two), (two, one)):
            for a in x:
                for b in y:
                    if a.limit < b.start and b.start - a.limit + 1 <= 9:
                        best = max(best, covered(x, a.limit) + covered(y, 0, b.start))
                    elif a.start <= b.start <= a.limit <= b.limit:
                        best = max(best, covered(x, a.limit) + covered(y, 0, a.limit))
        found = fc.joint_span(one, two, options)
        # Only the first partner of each range is looked at, so a far junction may stay unseen, but none is made up.
        assert found.joint <= best and found.first + found.second == found.joint
        if found.second:
            x, y = (one, two) if found.straight else (two, one)
            assert covered(x, found.head.limit) >= found.first - 15 and found.head.start == x[0].start and found.tail.limit == y[-1].limit


def test_homologous_genes_make_no_call():
    one, two = spans((0, 50)), spans((30, 80))
    assert fc.joint_span(one, two, fc.FusionOptions(most_homology=15)) is None
    assert fc.joint_span(one, two, fc.FusionOptions(most_homology=21)).joint == 80


CALL = "candidate bigint, n int, gene1 string, gene2 string, span1 int, span2 int"


def ids(df):
    return sorted({r.candidate for r in df.collect()})


def test_support_counts_good_spans_and_keeps_the_others(spark):
    pairs, umis = "xxyyyyzz", ["AC", "AC", "AC", "GT", "AC", "TT", "CA", "CG"]
    second = [30, 30, 30, 28, 40, 9, 30, 10]
    calls = spark.createDataFrame([(i, 0, p, p, 35, s) for i, (p, s) in enumerate(zip(pairs, second, strict=True))], CALL)
    texts = spark.createDataFrame(list(enumerate(umis)), "candidate bigint, umi string")
    assert ids(fc.well_supported(calls, texts)) == [2, 3, 5]
    assert ids(fc.well_supported(calls)) == [0, 1, 2, 3, 4, 5]
    assert ids(fc.well_supported(calls.limit(0))) == []


def test_duplicates(spark):
    umis = ["ACGTAC", "ACGTTG", "TTTTAC", "TTTTNN", "NCGTAC", "ACGTAC", "ACGAAG"]
    calls = spark.createDataFrame([(i, 0, p, p, 30, 25) for i, p in enumerate("mmmmnnn")], CALL)
    texts = spark.createDataFrame([(i, u, "ACGT", None) for i, u in enumerate(umis)], "candidate bigint, umi string, r1 string, r2 string")
    # The last one is near the fifth only through the better known sixth.
    assert ids(fc.without_duplicates(calls, texts, umis=True)) == [0, 2, 4]
    whole = "ACGGTTCATG" * 4
    reads = [whole, "TT" + whole[2:], "TTT" + whole[3:], whole[:-1], "ACGTTTACGA", "CCGTTTACGA", whole]
    calls = spark.createDataFrame([(i, 0, p, p, 30, 25) for i, p in enumerate("mmmmmmn")], CALL)
    texts = spark.createDataFrame([(i, None, s, None) for i, s in enumerate(reads)], "candidate bigint, umi string, r1 string, r2 string")
    assert ids(fc.without_duplicates(calls, texts)) == [0, 2, 3, 4, 6]
    assert ids(fc.without_duplicates(calls.limit(0), texts)) == []


def test_names_need_listed_pairs(spark):
    calls = spark.createDataFrame([(1, 0, "b", "a", 30, 30), (2, 0, "c", "d", 30, 30)], CALL)
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "gene1 string, gene2 string")
    assert {r.candidate: r.name for r in fc.named(calls, pairs).collect()} == {1: "a/b", 2: "c/d"}
    assert {r.name for r in fc.named(calls).collect()} == {"a/b", "c/d"}
    with pytest.raises(Exception, match="not a listed pair"):
        fc.named(calls, pairs.limit(1)).collect()


def test_records_and_whole_pipeline(spark):
    r1, r2 = "ACGTTGCAACGGTCATTGCAACGTAGCTTGACCATGACTT", "CCATGACTTGACGTATGCCGATTACGGATCCAATGCTTGA"
    ranges = [(f, g, a, b) for f in (1, 2, 3) for g, a, b in (("x", 0, 40), ("y", R2, R2 + 40))] + [(4, "x", 0, 40)]
    df = spark.createDataFrame(ranges, "fragment bigint, gene string, start bigint, limit bigint")
    genes = fc.fragment_genes(df)
    fragments = genes.selectExpr("fragment", "40 as length1", "40 as length2", "genes")
    pairs = spark.createDataFrame([("y", "x")], "gene1 string, gene2 string")
    calls = fc.fusion_calls(fragments, pairs)
    assert ids(calls) == [1, 2, 3] and fc.fusion_calls(fragments).count() == 3
    assert fc.fusion_calls(fragments, pairs.limit(0)).count() == 0
    texts = spark.createDataFrame([(i, f"n{i}", u, r1, r2) for i, u in ((1, "AAAA"), (2, "CCCC"), (3, "AAAC"))], "candidate bigint, fragment_name string, umi string, r1 string, r2 string")
    places = spark.createDataFrame([("x", "chr1", 5, 90, 3), ("y", "chr2", 7, 80, 0)], "gene string, chrom string, start int, limit int, place int")
    kept = fc.filtered(calls, texts, places, fc.FusionOptions(), umis=True)
    assert ids(kept) == [1, 2]
    rows = {r.candidate: (r.header, r.sequence) for r in fc.call_records(kept, texts, places, pairs).collect()}
    assert rows[1] == (">n1|y/x|chr2:7-80:0/chr1:5-90:3|40/40|0:39/41:80", f"{r1}|{r2}")
    assert fc.truth_score(fc.named(kept), spark.createDataFrame([("x/y",), ("p/q",)], "name string")).first() == (1, 0, 1)


def test_transcript_names(spark):
    df = spark.createDataFrame([("E1.3|OR8|chr11:56-99:1051|960", "ACGT"), ("E2|X-1|c:1-2:0", "A")], "name string, bases string")
    assert [tuple(r)[:6] for r in fc.transcriptome(df).collect()] == [("E1.3", "OR8", "chr11", 56, 99, 1051), ("E2", "X-1", "c", 1, 2, 0)]
    pairs = spark.createDataFrame([("X-1", "Q")], "gene1 string, gene2 string")
    assert [r.gene for r in fc.transcriptome(df, pairs).collect()] == ["X-1"]
    with pytest.raises(Exception, match="not a transcript"):
        fc.transcriptome(df.selectExpr("'bad' as name", "bases")).collect()
    genes = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "gene string")
    assert sorted(map(tuple, fc.gene_numbers(genes).collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="outside"):
        fc.gene_numbers(genes, spark.createDataFrame([("a", 7)], "gene string, gene_no int")).collect()
