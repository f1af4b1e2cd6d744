"""Commands end to end on small files."""

import json
import random

import pytest

from strandline import commands
from strandline.sources import binary

TURN = str.maketrans("ACGT", "TGCA")
HEAD = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:60\n@SQ\tSN:chr2\tLN:40\n"
LINES = [
    "a\t99\tchr1\t3\t60\t4M\t=\t20\t21\tACGT\tIIII\tRG:Z:x\tNM:i:1",
    "a\t147\tchr1\t20\t60\t4M\t=\t3\t-21\tGGGG\tIIII",
    "b\t0\tchr2\t5\t10\t2M1D2M\t*\t0\t0\tTTTA\t*",
    "c\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII",
]


@pytest.fixture
def sam(tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(HEAD + "".join(f"{x}\n" for x in LINES))
    return str(path)


def test_records_keep_through_all_formats(spark, sam, tmp_path, capsys):
    bam, folder, back = str(tmp_path / "x.bam"), str(tmp_path / "x.pam"), str(tmp_path / "y.bam")
    for a, b in ((sam, bam), (bam, folder), (folder, back)):
        commands.main(["convert", a, b], spark)
    for path in (sam, bam, folder, back):
        commands.main(["view", path], spark)
        assert capsys.readouterr().out.splitlines() == LINES
    commands.main(["view", "--header", back], spark)
    assert capsys.readouterr().out == HEAD
    commands.main(["view", "--filter", "mapping_quality >= 60", "--regions", "chr1:10-40", bam], spark)
    assert capsys.readouterr().out.splitlines() == LINES[1:2]
    commands.main(["convert", "--drop-tags", "RG", bam, str(tmp_path / "z.bam")], spark)
    assert binary.read_bam(spark, str(tmp_path / "z.bam")).where("size(tags) > 0").first().tags == ["NM:i:1"]
    commands.main(["gindex", bam], spark)
    assert [e.ref_id for e in binary.read_gbai(f"{bam}.gbai")] == [0, 1, -1]
    commands.main(["flagstat", bam], spark)
    assert capsys.readouterr().out.startswith("4 + 0 in total")
    sums = []
    for path in (bam, folder):
        commands.main(["checksum", path], spark)
        sums.append(json.loads(capsys.readouterr().out))
    assert sums[0] == sums[1] and sums[0]["chr1"]["n_recs"] == 2 and "*" in sums[0]
    commands.main(["sort", str(tmp_path / "m.bam"), bam, back], spark)
    assert [r.read_name for r in binary.read_bam(spark, str(tmp_path / "m.bam")).collect()] == ["a", "a", "a", "a", "b", "b", "c", "c"]


def test_pileup(spark, sam, tmp_path):
    (tmp_path / "x.fa").write_text(">chr1\n" + "A" * 60 + "\n>chr2\n" + "T" * 40 + "\n")
    out = str(tmp_path / "p")
    commands.main(["pileup", sam, str(tmp_path / "x.fa"), out, "--region", "chr1:3-6", "--cols", "dpref,dpalt,enddists,strands,highq"], spark)

    def lines(name):
        return [x.read_text().splitlines() for x in sorted((tmp_path / name).glob("part*")) if x.read_text()][0]

    assert lines("p.ref.tsv") == ["#CHROM\tPOS\tREF\tDP\t5P_DISTS\t3P_DISTS\tSTRANDS\tref_depth_tier1", "chr1\t3\tA\t1\t0\t3\t+\t1", "chr1\t4\tA\t1\t.\t.\t.\t0", "chr1\t5\tA\t1\t.\t.\t.\t0", "chr1\t6\tA\t1\t.\t.\t.\t0"]
    assert lines("p.alt.tsv")[1:] == ["chr1\t4\tA\tC\t1\t1\t2\t+\t1", "chr1\t5\tA\tG\t1\t2\t1\t+\t1", "chr1\t6\tA\tT\t1\t3\t0\t+\t1"]
    commands.main(["pileup", sam, str(tmp_path / "x.fa"), out, "--region", "chr1:3-4", "--format", "basestrand"], spark)
    assert lines("p.basestrand.tsv")[1:] == ["chr1\t3\tA\t1\t0\t0\t0\t0\t0\t0\t0", "chr1\t4\tA\t0\t0\t1\t0\t0\t0\t0\t0"]
    with pytest.raises(ValueError):
        commands.main(["pileup", sam, str(tmp_path / "x.fa"), out], spark)
    with pytest.raises(ValueError):
        commands.main(["pileup", sam, str(tmp_path / "x.fa"), out, "--region", "chr1", "--cols", "+dpref,quals"], spark)


def test_transcriptome_and_fusion(spark, tmp_path):
    rng = random.Random(6)
    one, two = ("".join(rng.choice("ACGT") for _ in range(400)) for _ in range(2))
    (tmp_path / "g.fa").write_text(f">chr1\n{one}\n>chr2\n{two}\n")

    def line(chrom, feature, a, b, strand, more):
        return f'{chrom}\ts\t{feature}\t{a}\t{b}\t.\t{strand}\t.\t{more}\n'

    gtf = ""
    for chrom, strand, g in (("chr1", "+", "ONE"), ("chr2", "-", "TWO")):
        ids = f'gene_id "{g}"; gene_name "{g}"; gene_type "protein_coding";'
        gtf += line(chrom, "gene", 51, 350, strand, ids)
        gtf += line(chrom, "transcript", 51, 350, strand, f'{ids} transcript_id "T{g}";')
        for a, b in ((51, 150), (201, 350)):
            gtf += line(chrom, "exon", a, b, strand, f'{ids} transcript_id "T{g}";')
    (tmp_path / "a.gtf").write_text(gtf)
    out = tmp_path / "t"
    commands.main(["transcriptome", str(tmp_path / "a.gtf"), str(tmp_path / "g.fa"), str(out)], spark)
    lines = [x for p in sorted(out.glob("part*")) for x in p.read_text().splitlines()]
    first = one[50:150] + one[200:350]
    second = (two[50:150] + two[200:350])[::-1].translate(TURN)
    assert lines == [">TONE|ONE|chr1:51-350:0|100,150", first, ">TTWO|TWO|chr2:51-350:0|150,100", second]
    for flag, parts in (("--whole-genes", [one[50:350], two[50:350][::-1].translate(TURN)]), ("--collapsed", [one[50:150] + "|" + one[200:350], second[:150] + "|" + second[150:]])):
        commands.main(["transcriptome", flag, str(tmp_path / "a.gtf"), str(tmp_path / "g.fa"), str(out)], spark)
        assert [x for p in sorted(out.glob("part*")) for x in p.read_text().splitlines()][1::2] == parts
    with pytest.raises(ValueError):
        commands.main(["transcriptome", "--whole-genes", "--collapsed", str(tmp_path / "a.gtf"), str(tmp_path / "g.fa"), str(out)], spark)
    (tmp_path / "t.fa").write_text("\n".join(lines) + "\n")

    def record(i, seq, umi):
        return f"@f{i}:{umi}\n{seq}\n+\n{'I' * len(seq)}\n"

    fused = [first[40 + i : 140 + i] + second[20 : 120 + i] for i in range(3)]
    whole = first[:200]
    reads = [(f[:110], f[90:]) for f in fused] + [(whole[:110], whole[90:])]
    for k, name in ((0, "r1.fq"), (1, "r2.fq")):
        seqs = [r[0] if k == 0 else r[1][::-1].translate(TURN) for r in reads]
        (tmp_path / name).write_text("".join(record(i, s, u) for i, (s, u) in enumerate(zip(seqs, ("AAAAAA", "CCCCCC", "GGGGGG", "TTTTTT"), strict=True))))
    (tmp_path / "pairs.tsv").write_text("Genes\tSamples\nTWO/ONE\t5\n")
    commands.main(["fusion", str(tmp_path / "r1.fq"), str(tmp_path / "r2.fq"), str(tmp_path / "t.fa"), str(tmp_path / "f"), "--pairs", str(tmp_path / "pairs.tsv"), "--umi-in-name"], spark)
    found = [x for p in sorted((tmp_path / "f" / "fasta").glob("part*")) for x in p.read_text().splitlines()]
    assert len(found) == 6 and found[1::2] == fused
    assert found[0].startswith(">f0:AAAAAA|TWO/ONE|chr2:51-350:0/chr1:51-350:0|")
    genes = [x for p in sorted((tmp_path / "f" / "genes").glob("part*")) for x in p.read_text().splitlines()]
    assert genes == ["ONE", "TWO"]
