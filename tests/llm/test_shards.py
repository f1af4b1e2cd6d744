"""Oversized entries: against a plain loop over exact fractions."""

from fractions import Fraction

import pytest

from strandline.llm import shards

SF = "/root/testdata/sf0.01"
FIELDS = ["block_no", "num_records", "start_ref", "start_pos", "start_seq", "end_ref", "end_pos", "end_seq"]
INDEX = (
    "index_id bigint, file_id bigint, opts_id int, range_start_ref int, range_start_pos int, range_limit_ref int, range_limit_pos int, "
    "approx_file_bytes bigint, blocks array<struct<block_no int, num_records int, start_ref int, start_pos int, start_seq int, end_ref int, end_pos int, end_seq int>>, indexed_at timestamp"
)
OPTS = "opts_id int, strategy string, padding int, include_unmapped boolean, split_unmapped_coords boolean, split_mapped_coords boolean, bytes_per_shard bigint, num_shards int, min_bases_per_shard int"


def plain(index, options):
    """The rule as it reads."""
    settings = {o["opts_id"]: o for o in options}
    latest = {}
    for r in index:
        if r["index_id"] not in latest or r["indexed_at"] > latest[r["index_id"]]["indexed_at"]:
            latest[r["index_id"]] = r
    out = set()
    for r in latest.values():
        o = settings.get(r["opts_id"])
        if o is None or r["approx_file_bytes"] is None or not r["blocks"] or not o["bytes_per_shard"] or r["approx_file_bytes"] <= o["bytes_per_shard"]:
            continue
        mapped, unmapped, padding = o["split_mapped_coords"] or False, o["split_unmapped_coords"] or False, o["padding"] or 0
        if padding and (mapped or unmapped):
            continue
        blocks = list({b["block_no"]: b for b in sorted(r["blocks"], key=lambda b: b["block_no"])}.values())
        total = sum(b["num_records"] for b in blocks)

        def size(a, b):
            return Fraction(r["approx_file_bytes"] * sum(x["num_records"] for x in blocks[a:b]), total or 1)

        def allowed(i):
            b, before = blocks[i], blocks[i - 1]
            return (b["start_ref"], b["start_pos"]) != (before["end_ref"], before["end_pos"]) or (unmapped if b["start_ref"] == -1 else mapped)

        begin = 0
        while size(begin, len(blocks)) > o["bytes_per_shard"]:
            cuts = [i for i in range(begin + 1, len(blocks)) if allowed(i)]
            if not cuts:
                break
            within = [i for i in cuts if size(begin, i) <= o["bytes_per_shard"]]
            begin = within[-1] if within else cuts[0]
            out.add((r["index_id"], blocks[begin]["block_no"]))
    return out


def test_tables_match_the_plain_rule(spark):
    index, options = spark.read.parquet(f"{SF}/shard_index.parquet"), spark.read.parquet(f"{SF}/shard_opts.parquet")
    found = [tuple(r) for r in shards.first_blocks(index, options).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain([r.asDict(recursive=True) for r in index.collect()], [r.asDict() for r in options.collect()])


def block(no, n, at, end, ref=0):
    return (no, n, ref, at, 0, ref, end, 0)


def entry(i, size, blocks, opts=1, when="2024-01-01 00:00:00"):
    return (i, 1, opts, 0, 0, 0, 0, size, blocks, when)


@pytest.fixture
def make(spark):
    def of(rows, options):
        index = spark.createDataFrame(rows, INDEX.replace("indexed_at timestamp", "indexed_at string")).selectExpr("* except (indexed_at)", "cast(indexed_at as timestamp) indexed_at")
        return index, spark.createDataFrame(options, OPTS)

    return of


def opt(i=1, limit=10, padding=0, mapped=False, unmapped=False):
    return (i, "byte", padding, True, unmapped, mapped, limit, 1, 1)


def test_cases_and_no_cases(make):
    four = [block(0, 1, 0, 5), block(1, 1, 5, 5), block(2, 1, 6, 7), block(3, 1, 7, 9)]
    rows = [
        entry(1, 20, four),
        entry(2, 10, four),
        entry(3, None, four),
        entry(4, 20, []),
        entry(5, 20, None),
        entry(6, 20, four, opts=2),
        entry(7, 20, four, opts=3),
        entry(8, 20, four, opts=4),
        entry(9, 20, four, opts=None),
        entry(None, 20, four),
        entry(10, 20, list(reversed(four)) + four[:2], opts=5),
        entry(11, 20, [block(0, 0, 0, 0), block(1, 0, 5, 5)]),
        entry(1, 20, four),
    ]
    found = shards.first_blocks(*make(rows, [opt(), opt(2, None), opt(3, 0), opt(4, 10, 5, True), opt(5, 10, None, True, None)]))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (10, 2)]


def test_latest_row_holds_and_extra_columns_do_no_harm(make):
    four = [block(i, 1, 10 * i, 10 * i + 5) for i in range(4)]
    index, options = make([entry(1, 40, four), entry(1, 20, four, when="2024-01-02 00:00:00")], [opt()])
    index, options = index.selectExpr("*", "1 as plan", "'x' as padding"), options.selectExpr("*", "1 as cuts", "2 as index_id")
    assert [tuple(r) for r in shards.first_blocks(index, options).collect()] == [(1, 2)]


def test_pieces_cover_all_blocks_and_overlap_by_the_padding(make):
    four = [block(i, 1, 10 * i, 10 * i + 5) for i in range(4)]
    rows = shards.pieces(*make([entry(1, 40, four)], [opt(1, 20, 3)])).orderBy("piece_no").collect()
    assert [(r.first_block, r.last_block, r.records, r.range_start_pos, r.range_limit_pos, r.level) for r in rows] == [(0, 1, 2, 0, 18, None), (2, 3, 2, 17, 38, shards.POSITION)]


def test_empty_tables(make):
    assert shards.first_blocks(*make([], [])).count() == 0
    assert shards.pieces(*make([], [])).count() == 0


def test_texts_are_cut_at_the_coarsest_separators():
    from strandline.llm.splitting import pieces_of

    text = "Head one\n\nFirst sentence here. Second one.\nNext line of it\n\nTail word " + "x" * 30
    cut = [text[a:b] for a, b in pieces_of(text, 40)]
    assert "".join(cut) == text and max(map(len, cut)) <= 40
    assert cut[0] == "Head one\n\n" and cut[1] == "First sentence here. Second one.\n" and cut[2] == "Next line of it\n\n"
    assert pieces_of("abc", 10) == [(0, 3)] and pieces_of("x" * 25, 10) == [(0, 10), (10, 20), (20, 25)]


@pytest.mark.parametrize("overlap", [0, 7, 30])
def test_text_pieces(spark, overlap):
    import random

    from strandline.llm import splitting

    rng = random.Random(2)
    texts = [None, "", " ", "\n\n", "é" * 100] + ["".join(rng.choice(["word ", "A.\n", "b", "\n\n", "Long-er! ", "  "]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    df = spark.createDataFrame([(None if i % 9 == 4 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").selectExpr("*", "1 as piece_no", "'x' as piece")
    rows = splitting.text_pieces(df, 40, overlap).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        if i % 9 == 4:
            continue
        mine = sorted(by_text.get(i, []), key=lambda r: r.piece_no)
        if not t:
            assert not mine
            continue
        assert [r.piece_no for r in mine] == list(range(len(mine))) and mine[0].begin == 0
        assert all(r.piece == t[r.begin : r.begin + len(r.piece)] and 0 < len(r.piece) <= 40 for r in mine)
        ends = [r.begin + len(r.piece) for r in mine]
        assert ends[-1] == len(t) and all(a < b for a, b in zip(ends, ends[1:]))
        assert all(0 <= e - r.begin <= overlap for e, r in zip(ends, mine[1:]))
    with pytest.raises(ValueError):
        splitting.text_pieces(df, 10, 10)
