"""Binary alignment files, indexes and shard plans."""

import gzip
import random
import struct

import pytest

from strandline.operators import planning
from strandline.sources import binary, files

NAMES = [("chr1", 100_000), ("chr2", 50_000)]
HEADER = binary.Header("@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100000\n@SQ\tSN:chr2\tLN:50000\n", NAMES)


def rows(n=400):
    rng = random.Random(8)
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 60)))
        mapped = i < n - 5
        out.append(
            {
                "read_name": f"r{i}", "flags": 99 if mapped else 4, "ref_name": NAMES[i * 2 // n][0] if mapped else "*", "pos": i // 2 if mapped else -1, "mapq": i % 61,
                "cigar": f"{len(seq)}M" if mapped else "*", "mate_ref_name": "chr2" if mapped else "*", "mate_pos": 5 if mapped else -1, "template_length": i - 7,
                "seq": seq, "qual": [rng.randint(0, 60) for _ in seq] if i % 3 else [], "tags": ["NM:i:-3", "RG:Z:lane 1", "XA:A:c", "XB:B:s,1,-2", "XF:f:1.5", f"XI:i:{2**31 + i}"],
            }
        )
    return out


def expected(r):
    ids = {n: i for i, (n, _) in enumerate(NAMES)}
    return (r["read_name"], r["flags"], ids.get(r["ref_name"], -1), r["ref_name"], r["pos"], r["mapq"], r["cigar"], ids.get(r["mate_ref_name"], -1), r["mate_ref_name"], r["mate_pos"], r["template_length"], r["seq"], r["qual"], r["tags"])


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "x.bam")
    with open(path, "wb") as f:
        out = binary.BlockWriter(f)
        out.write(binary.header_bytes(HEADER))
        for i, r in enumerate(rows()):
            out.write(binary.encode_record(r, {"chr1": 0, "chr2": 1}))
            if i % 20 == 19:
                out.finish(last=False)
        out.finish()
    return path


def test_records_come_back(spark, bam):
    got = [tuple(r) for r in binary.read_bam(spark, bam).collect()]
    assert got == [expected(r) for r in rows()]
    assert binary.header_of(bam) == HEADER
    assert gzip.open(bam).read(4) == b"BAM\x01"
    assert [tuple(r) for r in binary.references(spark, bam).collect()] == [(0, "chr1", 100_000), (1, "chr2", 50_000)]


def test_index_cuts_the_scan(spark, bam):
    entries = binary.build_gbai(bam, 300)
    binary.write_gbai(entries, bam + ".gbai")
    assert binary.read_gbai(bam + ".gbai") == entries and len(entries) > 5
    df = binary.read_bam(spark, bam)
    assert df.rdd.getNumPartitions() == len(entries)
    assert [tuple(r) for r in df.collect()] == [expected(r) for r in rows()]
    places = [(e.ref_id, e.pos) for e in entries]
    assert places[0] == (0, 0) and (1, 100) in places and places[-1][0] == -1
    for ref, pos in ((0, 0), (0, 55), (1, 150), (1, 10**6), (-1, 0)):
        at = binary.offset_before(entries, ref, pos)
        assert at in {e.offset for e in entries} and binary.coordinate_at(bam, at) <= ((ref, pos) if ref >= 0 else (1 << 31, 0))
    assert binary.offset_before(entries, -1, 0) == entries[-1].offset
    bad = [entries[1], entries[0]]
    binary.write_gbai(bad, bam + ".bad")
    with pytest.raises(binary.FormatError):
        binary.read_gbai(bam + ".bad")


@pytest.mark.parametrize("single", [True, False])
def test_sink(spark, tmp_path, single):
    df = spark.createDataFrame([tuple(r.values()) for r in rows(50)], "read_name string, flags int, ref_name string, pos int, mapq int, cigar string, mate_ref_name string, mate_pos int, template_length int, seq string, qual array<int>, tags array<string>").coalesce(3)
    path = str(tmp_path / "out.bam")
    binary.write_bam(df, path, HEADER, single)
    import glob

    paths = [path] if single else sorted(glob.glob(path + "/*.bam"))
    got = [tuple(r) for p in paths for r in binary.read_bam(spark, p).collect()]
    assert got == [expected(r) for r in rows(50)]
    assert not glob.glob(path + ".parts/*")


def test_damaged_files(bam, tmp_path):
    data = open(bam, "rb").read()
    for name, bad in (("cut", data[:-40]), ("magic", b"x" + data[1:]), ("flip", data[:60] + bytes([data[60] ^ 255]) + data[61:])):
        path = tmp_path / name
        path.write_bytes(bad)
        with pytest.raises((binary.FormatError, Exception)):
            with open(path, "rb") as f:
                reader = binary.BlockReader(f)
                binary.read_header(reader)
                list(binary.raw_records(reader))
    with pytest.raises(binary.FormatError):
        binary.parse_header(binary.header_bytes(HEADER) + b"x")
    assert binary.parse_header(binary.header_bytes(HEADER)) == HEADER
    with pytest.raises(binary.FormatError):
        binary.merged_header([HEADER, binary.Header("", NAMES[:1])])
    assert binary.merged_header([HEADER, HEADER]) == HEADER


def bins(offsets):
    """A binned index as bytes, with a chunk and a window for each offset."""
    out = b"BAI\x01" + struct.pack("<i", len(offsets))
    for places in offsets:
        out += struct.pack("<i", 2) + struct.pack("<Ii", 4681, len(places)) + b"".join(struct.pack("<QQ", p, p + 1) for p in places)
        out += struct.pack("<Ii4Q", 37450, 2, 1, 2, 3, 4) + struct.pack("<i", len(places)) + b"".join(struct.pack("<Q", p) for p in places)
    return out + struct.pack("<Q", 7)


def test_shards_by_bins(tmp_path):
    (tmp_path / "x.bai").write_bytes(bins([[100 << 16, 0, 250 << 16, 900 << 16], [1000 << 16]]))
    index = binary.read_bai(str(tmp_path / "x.bai"))
    assert index.offsets() == [[100 << 16, 250 << 16, 900 << 16], [1000 << 16]] and index.unplaced == 7 and index.counts[0] == (1, 2, 3, 4)
    at = {100 << 16: (0, 10), 250 << 16: (0, 3000), 900 << 16: (0, 9000), 1000 << 16: (1, 4)}
    shards = planning.shards_of_bins(index, at.__getitem__, [10_000, 5_000], 100, 500, unmapped=True)
    # 650 bytes from 3000 to 9000 are divided into six; the last reference is too near in bytes for a bound of its own.
    assert [(s.start_ref, s.start) for s in shards] == [(0, 0), (0, 3000), (0, 4000), (0, 5000), (0, 6000), (0, 7000), (0, 8000), (0, 9000), (-1, 0)]
    assert (shards[-2].limit_ref, shards[-2].limit) == (1, 5000)
    with pytest.raises(ValueError):
        planning.shards_of_bins(binary.BinIndex([{}], [[]], [None], None), at.__getitem__, [5], 1, 1)


def test_shards_by_entries():
    entries = [binary.Entry(0, 7, 0, 10 << 16), binary.Entry(0, 40, 0, 20 << 16), binary.Entry(0, 90, 0, 60 << 16), binary.Entry(2, 5, 0, 80 << 16), binary.Entry(2, 8, 0, 200 << 16), binary.Entry(-1, -1, 0, 300 << 16)]
    shards = planning.shards_of_entries(entries, [100, 50, 30], 40, 50, padding=2)
    assert [(s.start_ref, s.start, s.limit_ref, s.limit) for s in shards] == [(0, 0, 0, 90), (0, 90, 2, 8), (2, 8, 2, 30)]
    assert shards[1].holds(2, 7) and not shards[1].holds(2, 8) and shards[1].holds(2, 9, padded=True) and shards[1].in_start_padding(0, 88)
    for bad in ([planning.Shard(0, 5, 0, 5)], [planning.Shard(0, 5, 0, 9), planning.Shard(0, 5, 0, 8)], [planning.Shard(0, 0, 0, 1, 0, -1)]):
        with pytest.raises(ValueError):
            planning.validated(bad)
    assert planning.strategy("bam") == "position" and planning.strategy("parquet") == "byte"
    with pytest.raises(ValueError):
        planning.strategy("parquet", padding=1, split_mapped=True)


def test_paths_of_ranges():
    universal = ((0, 0, 0), (-1, 2_147_483_647, 0))
    assert binary.range_path(*universal) == "0:0,-:-" and binary.coordinate_path(3, 9, 2) == "3:9:2"
    assert binary.parse_range_path("d/0:0,-:-.index") == (*universal, "index")
    assert binary.parse_range_path("d/1:2:3,4:5.seq") == ((1, 2, 3), (4, 5, 0), "seq") and binary.parse_range_path("x") is None
    paths = ["4:0,-:-.index", "0:0,2:0.index", "2:0,4:0.index", "0:0,2:0.seq"]
    assert binary.intersecting_files(paths, (1, 0, 0), (3, 0, 0)) == ["0:0,2:0.index", "2:0,4:0.index"]


def test_format_is_detected(bam, tmp_path):
    assert binary.detect_format("a.bam") == "bam" and binary.detect_format("a.pam/x") == "parquet" and binary.detect_format(str(tmp_path / "none")) == "bam"
    (tmp_path / "y").write_bytes(b"")
    (tmp_path / "y.gbai").write_bytes(b"")
    assert binary.detect_format(str(tmp_path / "y")) == "bam"
    assert binary.file_info(bam)["bytes"] > 1000


def test_adjacent_pairs(spark):
    schema = "read_id bigint, read_name string, flags int, pos int, mate_pos int"
    good = [(0, "a", 64, 1, 2), (1, "a", 128, 2, 1), (2, "b", 128, 5, 5), (3, "b", 64, 5, 5)]
    assert sorted(tuple(r) for r in planning.adjacent_pairs(spark.createDataFrame(good, schema), shard=2).collect()) == [("a", 0, 1, 0), ("b", 3, 2, 1)]
    for bad in (good[:3], [(0, "a", 64, 1, 2), (1, "a", 128, 2, 9)], [(0, "a", 64, 1, 2), (1, "a", 64, 2, 1)]):
        with pytest.raises(Exception, match="a|b"):
            planning.adjacent_pairs(spark.createDataFrame(bad, schema)).collect()


def test_read_shards_of_blocks(spark):
    blocks = [(i, 10, 0, i // 2, 0, 0, i // 2, 9) for i in range(8)]
    kind = "file_id bigint, index_id bigint, range_start_ref int, range_start_pos int, range_limit_ref int, range_limit_pos int, approx_file_bytes bigint, blocks array<struct<block_no:int,num_records:bigint,start_ref:int,start_pos:int,start_seq:int,end_ref:int,end_pos:int,end_seq:int>>"
    df = spark.createDataFrame([(1, 1, 0, 0, 0, 100, 1, blocks + blocks[:2]), (1, 2, 0, 100, -1, 2_147_483_647, 1, []), (2, 3, 0, 0, 1, 5, 1, None)], kind)
    plain = sorted((r.file_id, r.limit_pos) for r in planning.read_shards(df, 4).collect())
    assert plain[-1] == (2, 5) and (1, 100) in plain and (1, 2_147_483_647) in plain
    inner = [p for f, p in plain if f == 1 and p < 100]
    assert inner == sorted(set(inner)) and len(inner) == 2
    assert len([1 for r in planning.read_shards(df, 4, split_mapped=True).collect() if r.limit_pos < 100]) >= 2
