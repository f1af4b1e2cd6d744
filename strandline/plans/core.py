"""Registry of the core queries and their SQL.

Names begin with the inventory's id of the operator; pN_ are the record problems.  Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.functions import align
from strandline.functions import seq as seqs
from strandline.operators import alignments, annotation, badrows, diff, fusion, fusion_calls, kmers, periods, pileup, planning, sampling
from strandline.operators import intervals as iv
from strandline.plans import filterlang
from strandline.plans.adapters import GTF_SQL, READS_SQL, REFERENCE_LENGTH, REFERENCES, gtf, reads
from strandline.session import latest_rows, table
from strandline.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_READS = f"WITH reads AS ({READS_SQL}) "
_GTF = f"WITH gtf AS ({GTF_SQL}) "

# Flags and checksums

_PAIR = "(flags & 2304) = 0 AND (flags & 1) <> 0"
_FLAGSTAT_SQL = f"""
SELECT qc_fail, count(*) AS total, {", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in {
    "mapped": "(flags & 4) = 0", "duplicate": "(flags & 1024) <> 0", "secondary": "(flags & 256) <> 0",
    "supplementary": "(flags & 256) = 0 AND (flags & 2048) <> 0", "paired": _PAIR,
    "good_pair": f"{_PAIR} AND (flags & 2) <> 0 AND (flags & 4) = 0", "single": f"{_PAIR} AND (flags & 8) <> 0 AND (flags & 4) = 0",
    "pair_map": f"{_PAIR} AND (flags & 12) = 0", "diff_chr": f"{_PAIR} AND (flags & 12) = 0 AND ref_id <> mate_ref_id",
    "diff_high": f"{_PAIR} AND (flags & 12) = 0 AND ref_id <> mate_ref_id AND mapq >= 5",
    "r1": f"{_PAIR} AND (flags & 64) <> 0", "r2": f"{_PAIR} AND (flags & 128) <> 0"}.items())}
FROM (SELECT *, (flags & 512) <> 0 AS qc_fail FROM reads) GROUP BY qc_fail
"""


@query(_READS + _FLAGSTAT_SQL)
def agg1_flagstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.flagstat(reads(spark, sf_dir, ["read_id", "flags", "ref_id", "mate_ref_id", "mapq"]))


@query(f"SELECT qc_fail, {', '.join(f'CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}' for c in alignments.FLAGSTAT)} FROM (SELECT DISTINCT * FROM flagstat) GROUP BY qc_fail")
def agg3_merged_flagstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.merge_flagstat(table(spark, sf_dir, "flagstat").distinct())


def _flagstat_text_sql() -> str:
    lines = [("total", "in total (QC-passed reads + QC-failed reads)", None), ("secondary", "secondary", None), ("supplementary", "supplementary", None), ("duplicate", "duplicates", None), ("mapped", "mapped", "total"), ("paired", "paired in sequencing", None), ("r1", "read1", None), ("r2", "read2", None), ("good_pair", "properly paired", "paired"), ("pair_map", "with itself and mate mapped", None), ("single", "singletons", "paired"), ("diff_chr", "with mate mapped to a different chr", None), ("diff_high", "with mate mapped to a different chr (mapQ>=5)", None)]

    def number(c: str, q: str) -> str:
        return f"coalesce(sum({c}) FILTER (qc_fail = {q}), 0)"

    def share(c: str, whole: str) -> str:
        return "' (' || " + " || ':' || ".join(f"CASE WHEN {number(whole, q)} > 0 THEN printf('%.2f%%', 100.0 * {number(c, q)} / {number(whole, q)}) ELSE 'N/A' END" for q in ("false", "true")) + " || ')'"

    return " UNION ALL ".join(f"SELECT {i} AS line_no, {number(c, 'false')} || ' + ' || {number(c, 'true')} || ' {label}'{f' || {share(c, whole)}' if whole else ''} AS line FROM stats" for i, (c, label, whole) in enumerate(lines))


@query(_READS + f", stats AS ({_FLAGSTAT_SQL}) " + _flagstat_text_sql())
def snk19_flagstat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.flagstat_text(agg1_flagstat(spark, sf_dir))


def _hash_sum(value: str, name: str) -> str:
    number = f"CAST(('0x' || substr(md5(concat_ws('|', concat_ws(':', CAST(ref_id AS VARCHAR), CAST(pos AS VARCHAR)), coalesce({value}, ''))), 1, 15)) AS BIGINT)"
    return f"CAST(sum(CAST({number} AS HUGEINT)) % 18446744073709551616::HUGEINT AS VARCHAR) AS {name}"


_CHECKSUM_SQL = f"""
SELECT CASE WHEN ref_id < 0 THEN '*' ELSE ref_name END AS ref_name, count(*) AS n_recs, CAST(sum(greatest(pos, 0)) AS BIGINT) AS sum_pos,
  {_hash_sum('CAST(flags AS VARCHAR)', 'sum_flags')}, {_hash_sum('CAST(mapq AS VARCHAR)', 'sum_mapq')},
  {_hash_sum("concat_ws(':', CAST(mate_ref_id AS VARCHAR), CAST(mate_pos AS VARCHAR))", 'sum_mate')}, {_hash_sum('read_name', 'sum_name')},
  {_hash_sum('seq', 'sum_seq')}, {_hash_sum("array_to_string(qual, ',')", 'sum_qual')}, {_hash_sum('cigar', 'sum_cigar')}
FROM reads GROUP BY 1
"""


@query(_READS + _CHECKSUM_SQL)
def agg2_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.checksum(reads(spark, sf_dir))


# The filter language and views

FILTER = 'paired && !duplicate && !unmapped && (mapping_quality >= 30 || chimeric) && sequence_length > 50 && re(rec_name, "^MX00:[12]")'


@query(
    _READS
    + """SELECT read_id FROM reads WHERE (flags & 1) <> 0 AND (flags & 1024) = 0 AND (flags & 4) = 0
  AND (mapq >= 30 OR ((flags & 1) <> 0 AND (flags & 12) = 0 AND ref_id <> mate_ref_id))
  AND CASE WHEN seq = '*' THEN 0 ELSE length(seq) END > 50 AND regexp_matches(read_name, '^MX00:[12]')"""
)
def flt1_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["read_id", "read_name", "flags", "mapq", "ref_id", "mate_ref_id", "seq"]
    return reads(spark, sf_dir, columns).where(filterlang.compile_filter(FILTER)).select("read_id")


_FLAG_COLUMNS = ", ".join(f"(flags & {bit}) <> 0 AS {name}" for name, bit in align.FLAG_NAMES.items())


@query(_READS + f"SELECT {_FLAG_COLUMNS}, count(*) AS n FROM reads GROUP BY ALL")
def flt5_flag_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir, ["read_id", "flags"])
    return rows.groupBy(*[align.has_flag(F.col("flags"), bit).alias(name) for name, bit in align.FLAG_NAMES.items()]).agg(F.count(F.lit(1)).alias("n"))


@query(
    _READS
    + """SELECT read_id FROM reads WHERE (ref_id = 0 AND pos >= 0 AND pos < 50000000) OR (ref_id = 4 AND pos >= 1000000 AND pos < 90000000) OR ref_id = -1"""
)
def src24_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = filterlang.compile_regions("chr1:1-50000000,chr5:1000000-chr5:90000000,*:0-*:2147483647", REFERENCES)
    return reads(spark, sf_dir, ["read_id", "ref_id", "pos"]).where(condition).select("read_id")


@query(
    _READS
    + """SELECT read_id, concat_ws(chr(9), coalesce(read_name, '*'), flags, coalesce(ref_name, '*'), coalesce(pos, -1) + 1, mapq, coalesce(cigar, '*'),
  CASE WHEN mate_ref_name = ref_name AND ref_name <> '*' THEN '=' ELSE coalesce(mate_ref_name, '*') END, coalesce(mate_pos, -1) + 1, 0, coalesce(seq, '*'),
  CASE WHEN len(qual) > 0 THEN array_to_string(list_transform(qual, lambda q: chr(q + 33)), '') ELSE '*' END) AS line FROM reads WHERE mapq >= 40 AND (flags & 4) = 0"""
)
def snk1_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered records as sorted lines of SAM."""
    from strandline.sources.files import sam_line

    rows = alignments.coordinate_sorted(reads(spark, sf_dir).where(filterlang.compile_filter("mapping_quality >= 40 && !unmapped")))
    return rows.select("read_id", sam_line().alias("line"))


# Order, shards and pairs


@query(_READS + "SELECT read_id, CAST(row_number() OVER (PARTITION BY ref_id, CASE WHEN ref_id < 0 AND pos < 0 THEN 0 ELSE pos END ORDER BY read_id) - 1 AS INTEGER) AS seq_no FROM reads")
def win1_sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.with_sequence_number(reads(spark, sf_dir, ["read_id", "ref_id", "pos"])).select("read_id", "seq_no")


@query(_READS + "SELECT read_id, CASE WHEN ref_id < 0 THEN 9223372036854775806 ELSE CAST(ref_id AS BIGINT) * 8589934592 + CAST(pos AS BIGINT) * 2 + CASE WHEN (flags & 16) <> 0 THEN 1 ELSE 0 END END AS sort_key FROM reads")
def srt1_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments.coordinate_sorted(reads(spark, sf_dir, ["read_id", "ref_id", "pos", "flags"]))
    return rows.select("read_id", align.sort_key(F.col("ref_id"), F.col("pos"), F.col("flags")).alias("sort_key"))


WIDTH, PADDING = 1_000_000, 1_000


@query(
    f"""WITH cut AS (SELECT CAST(r AS INTEGER) AS ref_id, s AS start, least(s + {WIDTH}, {REFERENCE_LENGTH}) AS "limit" FROM range({len(REFERENCES)}) t(r), range(0, {REFERENCE_LENGTH}, {WIDTH}) u(s)),
every AS (SELECT ref_id, start, "limit", greatest(start - {PADDING}, 0) AS padded_start, least("limit" + {PADDING}, {REFERENCE_LENGTH}) AS padded_limit FROM cut UNION ALL SELECT -1, 0, 2147483647, 0, 2147483647)
SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN ref_id < 0 THEN 1000000 ELSE ref_id END, start) - 1 AS INTEGER) AS shard_no FROM every"""
)
def prt1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = spark.range(len(REFERENCES)).select(F.col("id").cast("int").alias("ref_id"), F.lit(REFERENCE_LENGTH).alias("length"))
    return alignments.position_shards(references, WIDTH, PADDING, unmapped=True)


@query(
    _READS
    + f""", counted AS (SELECT ref_id, CAST(floor(pos / {WIDTH}) AS BIGINT) AS shard, count(*) AS n_reads FROM reads WHERE ref_id >= 0 GROUP BY 1, 2)
SELECT *, CAST(coalesce(sum(n_reads) OVER (ORDER BY ref_id, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index FROM counted"""
)
def agg12_shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.shard_counts(reads(spark, sf_dir, ["read_id", "ref_id", "pos"]), WIDTH)


_SHARD_INDEX = """WITH RECURSIVE latest AS (SELECT * FROM shard_index WHERE index_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY indexed_at DESC) = 1),
each AS (SELECT file_id, index_id, CASE WHEN range_start_ref < 0 THEN 2147483647 ELSE range_start_ref END AS er, range_start_pos AS ep, range_limit_ref AS limit_ref, range_limit_pos AS limit_pos,
  unnest(CASE WHEN len(list_filter(coalesce(blocks, []), lambda x: x.block_no IS NOT NULL)) = 0 THEN [NULL] ELSE list_sort(list_distinct(list_filter(blocks, lambda x: x.block_no IS NOT NULL))) END) AS b FROM latest WHERE file_id IS NOT NULL)
"""


def _shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(table(spark, sf_dir, "shard_index"), ["index_id"], "indexed_at")


@query(
    _SHARD_INDEX
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY b.block_no) - 1 AS place, count(*) OVER (PARTITION BY index_id) AS n FROM each),
flat AS (SELECT file_id, CASE WHEN b IS NULL THEN NULL ELSE place END AS place, place = n - 1 AS last, b, limit_ref, limit_pos, row_number() OVER (PARTITION BY file_id ORDER BY er, ep, index_id, place) AS i, count(b) OVER (PARTITION BY file_id) AS blocks,
  coalesce(lag(b.end_ref) OVER (PARTITION BY index_id ORDER BY place) = b.start_ref AND lag(b.end_pos) OVER (PARTITION BY index_id ORDER BY place) = b.start_pos, false) AS inside FROM numbered),
walk AS (
  SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seen, CAST(0 AS BIGINT) AS made, false AS cut, false AS ended, CAST([0, 0, 0] AS INTEGER[]) AS cut_at, CAST([0, 0, 0] AS INTEGER[]) AS top FROM flat
  UNION ALL
  SELECT file_id, i, seen + CASE WHEN place IS NOT NULL AND NOT (due AND inside) THEN 1 ELSE 0 END, made + CAST(cut AS INTEGER) + CAST(ended AS INTEGER), cut, ended, here, CASE WHEN last THEN edge WHEN cut THEN here ELSE top END
  FROM (SELECT *, last AND edge <> CASE WHEN cut THEN here ELSE top END AS ended FROM (SELECT *, due AND NOT inside AND here <> top AS cut FROM (
    SELECT f.file_id, f.i, f.place, f.last, f.inside, w.seen, w.made, w.top, coalesce(f.place > 0 AND w.seen > (w.made + 1) * f.blocks // 8, false) AS due, [f.b.start_ref, f.b.start_pos, f.b.start_seq] AS here, [f.limit_ref, f.limit_pos, 0] AS edge
    FROM walk w JOIN flat f ON f.file_id = w.file_id AND f.i = w.i + 1))))
SELECT file_id, cut_at[1] AS limit_ref, cut_at[2] AS limit_pos, cut_at[3] AS limit_seq FROM walk WHERE cut UNION ALL SELECT file_id, top[1], top[2], top[3] FROM walk WHERE ended"""
)
def prt4_read_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where eight read shards of each file end; positions aren't split."""
    return planning.read_shards(_shard_index(spark, sf_dir), 8)


_ENTRIES = _SHARD_INDEX + """, entries AS (SELECT file_id, b.start_ref AS ref_id, b.start_pos AS pos, 65536 * row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN b.start_ref < 0 THEN 2147483647 ELSE b.start_ref END, b.start_pos, index_id, b.block_no) AS "offset" FROM each WHERE b IS NOT NULL)
"""


def _index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as entries of an index: the n-th of a file lies in its n-th stretch of 64 KiB."""
    blocks = F.array_distinct(F.filter("blocks", lambda b: b["block_no"].isNotNull()))
    rows = _shard_index(spark, sf_dir).where(F.col("file_id").isNotNull()).select("file_id", "index_id", F.explode(blocks).alias("b"))
    order = W.partitionBy("file_id").orderBy(align.ref_order(F.col("b.start_ref")), "b.start_pos", "index_id", "b.block_no")
    return rows.select("file_id", F.col("b.start_ref").alias("ref_id"), F.col("b.start_pos").alias("pos"), (F.row_number().over(order).cast("bigint") * 65_536).alias("offset"))


@query(
    _ENTRIES
    + f""", placed AS (SELECT *, CAST(ref_id AS BIGINT) * {REFERENCE_LENGTH} + pos AS lin FROM entries WHERE ref_id >= 0),
cuts AS (
  SELECT file_id, min("offset") AS "offset", min(lin // {REFERENCE_LENGTH} * {REFERENCE_LENGTH}) AS lin, true AS lead FROM placed GROUP BY file_id
  UNION ALL
  SELECT file_id, "offset", lin, false FROM (SELECT p.*, row_number() OVER (PARTITION BY p.file_id ORDER BY p."offset") AS k FROM cuts c JOIN placed p ON p.file_id = c.file_id AND p."offset" >= c."offset" + 5 * 65536 AND p.lin >= c.lin + 2000000) WHERE k = 1)
SELECT file_id, CAST(lin // {REFERENCE_LENGTH} AS INTEGER) AS start_ref, CAST(lin % {REFERENCE_LENGTH} AS INTEGER) AS start_pos FROM cuts"""
)
def prt3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where shards of five stretches and two million bases begin."""
    return planning.byte_shards(_index_entries(spark, sf_dir), [REFERENCE_LENGTH] * len(REFERENCES), 5, 2_000_000)


@query(
    _ENTRIES
    + """, firsts AS (SELECT file_id, ref_id, pos, min("offset") AS "offset" FROM entries GROUP BY ALL)
SELECT * FROM firsts WINDOW w AS (PARTITION BY file_id, ref_id ORDER BY "offset") QUALIFY lag("offset") OVER w IS NULL OR "offset" // 300000 <> (lag("offset") OVER w) // 300000"""
)
def win8_sparse_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.sparse_entries(_index_entries(spark, sf_dir), 300_000)


@query(
    _SHARD_INDEX.replace("WITH RECURSIVE", f"WITH reads AS ({READS_SQL}),")
    + """, entries AS (SELECT file_id, b.start_ref AS ref_id, b.start_pos AS at, max(index_id * 1000 + b.block_no) AS entry FROM each WHERE b IS NOT NULL AND b.start_ref >= 0 GROUP BY ALL)
SELECT read_id, entry FROM (SELECT * FROM reads WHERE ref_id >= 0) r ASOF LEFT JOIN entries e ON r.file_id = e.file_id AND r.ref_id = e.ref_id AND r.pos >= e.at"""
)
def join9_index_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor lookup: the block of each read's file that begins last at or before it."""
    left = reads(spark, sf_dir, ["read_id", "file_id", "ref_id", "pos"]).where(F.col("ref_id") >= 0)
    blocks = F.array_distinct(F.filter("blocks", lambda b: b["block_no"].isNotNull()))
    rows = _shard_index(spark, sf_dir).select("file_id", "index_id", F.explode(blocks).alias("b")).where(F.col("b.start_ref") >= 0)
    entries = rows.select("file_id", F.col("b.start_ref").alias("ref_id"), F.col("b.start_pos").alias("at"), (F.col("index_id") * 1000 + F.col("b.block_no")).alias("entry"))
    return iv.floor_lookup(left, entries, ["file_id", "ref_id"], "pos", "at", "entry").select("read_id", "entry")


@query(
    _READS
    + """SELECT CASE WHEN (CASE WHEN ref_id < 0 THEN 99 ELSE ref_id END) <> (CASE WHEN mate_ref_id < 0 THEN 99 ELSE mate_ref_id END) THEN (CASE WHEN ref_id < 0 THEN 99 ELSE ref_id END) < (CASE WHEN mate_ref_id < 0 THEN 99 ELSE mate_ref_id END)
  WHEN pos <> mate_pos THEN pos < mate_pos ELSE (flags & 64) <> 0 END AS left_most, count(*) AS n FROM reads GROUP BY 1"""
)
def join18_left_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir, ["read_id", "flags", "ref_id", "pos", "mate_ref_id", "mate_pos"])
    first = planning.left_most(F.col("ref_id"), F.col("pos"), F.col("flags"), F.col("mate_ref_id"), F.col("mate_pos"))
    return rows.groupBy(first.alias("left_most")).agg(F.count(F.lit(1)).alias("n"))


_MATES = (
    _READS
    + """, primary_reads AS (SELECT * FROM reads WHERE (flags & 1) <> 0 AND (flags & 2304) = 0 AND read_name IS NOT NULL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY read_id) AS k FROM primary_reads WHERE (flags & 64) <> 0 AND (flags & 128) = 0) WHERE k = 1),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY read_id) AS k FROM primary_reads WHERE (flags & 128) <> 0 AND (flags & 64) = 0) WHERE k = 1)
"""
)


@query(_MATES + "SELECT read_name, one.read_id AS read_id_1, two.read_id AS read_id_2 FROM one JOIN two USING (read_name)")
def join1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.read_pairs(reads(spark, sf_dir, ["read_id", "read_name", "flags"])).select("read_name", "read_id_1", "read_id_2")


@query(_MATES + "SELECT coalesce(one.read_name, two.read_name) AS read_name, one.read_name IS NOT NULL AS has_first FROM one FULL JOIN two ON one.read_name = two.read_name WHERE one.read_name IS NULL OR two.read_name IS NULL")
def join1_missing_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.missing_mates(reads(spark, sf_dir, ["read_id", "read_name", "flags"]))


_SPAN_SQL = "CAST(list_sum(list_transform(regexp_extract_all(coalesce({0}.cigar, '*'), '(\\d+)[MDN=X]', 1), lambda x: CAST(x AS INTEGER))) AS INTEGER)"


@query(
    _MATES
    + f""", near AS (SELECT read_name, one.ref_id, least(one.pos, two.pos) AS start,
  greatest(one.pos + coalesce({_SPAN_SQL.format('one')}, 0), two.pos + coalesce({_SPAN_SQL.format('two')}, 0)) AS "limit", one.read_id AS read_id_1, two.read_id AS read_id_2
  FROM one JOIN two USING (read_name) WHERE one.ref_id >= 0 AND one.ref_id = two.ref_id AND (one.flags & 4) = 0 AND (two.flags & 4) = 0)
SELECT * FROM near WHERE "limit" - start <= 1000"""
)
def join2_bounded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.bounded_pairs(reads(spark, sf_dir, ["read_id", "read_name", "flags", "ref_id", "pos", "cigar"]))


@query(
    _READS
    + f""", mine AS (SELECT read_id, mate_ref_id, ref_id, pos, mate_pos, unnest(range(greatest(CAST(floor((mate_pos - {PADDING}) / {WIDTH}) AS BIGINT), 0), CAST(floor((mate_pos + {PADDING}) / {WIDTH}) AS BIGINT) + 1)) AS shard
  FROM reads WHERE {_PAIR} AND (flags & 12) = 0 AND ref_id >= 0 AND mate_ref_id >= 0 AND mate_pos >= 0),
bounded AS (SELECT *, greatest(shard * {WIDTH} - {PADDING}, 0) AS low, (shard + 1) * {WIDTH} + {PADDING} AS high FROM mine)
SELECT read_id, mate_ref_id AS ref_id, shard FROM bounded WHERE mate_pos >= low AND mate_pos < high AND (ref_id <> mate_ref_id OR pos < low OR pos >= high)"""
)
def join3_distant_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.distant_mates(reads(spark, sf_dir, ["read_id", "flags", "ref_id", "pos", "mate_ref_id", "mate_pos"]), WIDTH, PADDING)


@query(
    _MATES
    + f""", near AS (SELECT read_name, least(one.pos, two.pos) AS start, greatest(one.pos + coalesce({_SPAN_SQL.format('one')}, 0), two.pos + coalesce({_SPAN_SQL.format('two')}, 0)) AS "limit"
  FROM one JOIN two USING (read_name) WHERE one.ref_id >= 0 AND one.ref_id = two.ref_id AND (one.flags & 4) = 0 AND (two.flags & 4) = 0)
SELECT read_name, unnest(range(start // 500, greatest(("limit" - 1) // 500, start // 500) + 1)) AS shard FROM near WHERE "limit" - start <= 1000"""
)
def join2_pairs_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded pairs once for each shard of 500 bases that they cross."""
    return alignments.pairs_by_shard(join2_bounded_pairs(spark, sf_dir), 500).select("read_name", "shard")


@query(
    _MATES
    + f""", lost AS (SELECT coalesce(one.read_name, two.read_name) AS read_name FROM one FULL JOIN two ON one.read_name = two.read_name WHERE one.read_name IS NULL OR two.read_name IS NULL),
at AS (SELECT DISTINCT ref_id, CAST(floor(greatest(pos, 0) / {WIDTH}) AS BIGINT) AS shard, read_name FROM primary_reads SEMI JOIN lost USING (read_name)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ref_id, shard ORDER BY read_name) AS k FROM at)
SELECT ref_id, shard, count(*) AS n, string_agg(read_name, ',' ORDER BY read_name) FILTER (k <= 101) AS names FROM ranked GROUP BY ref_id, shard""".replace("at AS (", "spots AS (").replace("FROM at)", "FROM spots)")
)
def agg16_missing_mate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignments.missing_mate_summary(reads(spark, sf_dir, ["read_id", "read_name", "flags", "ref_id", "pos"]), WIDTH)
    return found.select("ref_id", "shard", "n", F.array_join("names", ",").alias("names"))


@query(_READS + "SELECT read_id, pos - coalesce(lag(pos) OVER (PARTITION BY ref_id, pos // 65536 ORDER BY pos, read_id), 0) AS delta FROM reads WHERE ref_id >= 0")
def win7_position_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.position_deltas(reads(spark, sf_dir, ["read_id", "ref_id", "pos"]).where(F.col("ref_id") >= 0)).select("read_id", "delta")


@query(_MATES + "SELECT one.ref_id = two.ref_id AS same_ref, count(*) AS n FROM one JOIN two USING (read_name) GROUP BY 1")
def agg11_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.pair_counts(reads(spark, sf_dir, ["read_id", "read_name", "flags", "ref_id"]))


# Intervals

_EXONS = _GTF + """, exons AS (SELECT chrom AS ref, range_start - 1 AS start, range_stop AS "limit" FROM gtf WHERE feature = 'exon' AND range_start <= range_stop AND chrom IS NOT NULL),
marked AS (SELECT *, max("limit") OVER (PARTITION BY ref ORDER BY start, "limit" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY start, "limit" ROWS UNBOUNDED PRECEDING) AS run FROM marked),
merged AS (SELECT ref, CAST(min(start) AS BIGINT) AS start, CAST(max("limit") AS BIGINT) AS "limit" FROM numbered GROUP BY ref, run)
"""


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gtf(spark, sf_dir, ["record_id", "chrom", "feature", "range_start", "range_stop"])
    kept = rows.where((F.col("feature") == "exon") & (F.col("range_start") <= F.col("range_stop")) & F.col("chrom").isNotNull())
    return kept.select("record_id", F.col("chrom").alias("ref"), (F.col("range_start") - 1).alias("start"), F.col("range_stop").alias("limit"))


@query(_EXONS + 'SELECT ref, start, "limit" FROM merged')
def int1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union(_exons(spark, sf_dir))


@query(
    _EXONS
    + """, around AS (SELECT ref, "limit" AS start, coalesce(lead(start) OVER (PARTITION BY ref ORDER BY start), 2147483647) AS "limit" FROM merged UNION ALL SELECT ref, -1, min(start) FROM merged GROUP BY ref)
SELECT ref, CAST(start AS BIGINT) AS start, CAST("limit" AS BIGINT) AS "limit" FROM around WHERE start < "limit" """
)
def int2_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.complement(_exons(spark, sf_dir))


@query(
    _EXONS
    + """SELECT ref, greatest(start, CASE WHEN ref = 'chr3' THEN 10000000 ELSE 0 END) AS start, least("limit", CASE WHEN ref = 'chr6' THEN 60000000 ELSE 2147483647 END) AS "limit" FROM merged
WHERE ref IN ('chr3', 'chr4', 'chr5', 'chr6') AND NOT (ref = 'chr3' AND "limit" <= 10000000) AND NOT (ref = 'chr6' AND start >= 60000000)"""
)
def int8_within_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union's part of a region over four references."""
    names = spark.createDataFrame(list(enumerate(REFERENCES)), "ref_id int, ref string")
    return iv.within(_exons(spark, sf_dir), names, ("chr3", 10_000_000), ("chr6", 60_000_000))


@query(_EXONS + 'SELECT ref, 2 * count(*) AS n, min(start) AS "first", max("limit") AS "last" FROM merged GROUP BY ref')
def int9_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.endpoints(_exons(spark, sf_dir))


@query(_EXONS + 'SELECT ref, CAST(sum("limit" - start) AS BIGINT) AS bases FROM merged GROUP BY ref')
def agg13_covered_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.covered_bases(_exons(spark, sf_dir))


@query(_EXONS + """SELECT ref, greatest(start, 10000000) AS start, least("limit", 60000000) AS "limit" FROM merged WHERE ref = 'chr3' AND "limit" > 10000000 AND start < 60000000""")
def int8_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.subset(_exons(spark, sf_dir), "chr3", 10_000_000, 60_000_000)


@query(
    _GTF
    + """, e AS (SELECT record_id, chrom, range_start - 1 AS start, range_stop AS "limit" FROM gtf WHERE feature = 'exon' AND range_start <= range_stop),
g AS (SELECT record_id, chrom, range_start - 1 AS start, range_stop AS "limit" FROM gtf WHERE feature = 'gene' AND range_start <= range_stop)
SELECT e.record_id AS record_id, g.record_id AS r_record_id, greatest(e.start, g.start) AS shared_start, least(e."limit", g."limit") AS shared_limit
FROM e JOIN g ON e.chrom = g.chrom AND e.start < g."limit" AND g.start < e."limit" """
)
def int7_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gtf(spark, sf_dir, ["record_id", "chrom", "feature", "range_start", "range_stop"]).where("range_start <= range_stop")
    sides = [rows.where(F.col("feature") == f).select("record_id", F.col("chrom").alias("ref"), (F.col("range_start") - 1).alias("start"), F.col("range_stop").alias("limit")) for f in ("exon", "gene")]
    return iv.intersections(*sides).select("record_id", "r_record_id", "shared_start", "shared_limit")


_SPAN_ONE = _SPAN_SQL.replace("{0}.", "")


@query(
    _EXONS.replace("WITH gtf", f"WITH reads AS ({READS_SQL}), gtf")
    + f""", spans AS (SELECT read_id, ref_name AS ref, pos AS start, pos + coalesce({_SPAN_ONE}, 0) AS "limit" FROM reads WHERE ref_id >= 0 AND (flags & 4) = 0)
SELECT DISTINCT read_id FROM spans s JOIN merged m ON s.ref = m.ref AND s.start < m."limit" AND m.start < s."limit" WHERE s.start < s."limit" """
)
def join6_reads_on_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir, ["read_id", "ref_id", "ref_name", "flags", "pos", "cigar"]).where((F.col("ref_id") >= 0) & ~align.has_flag(F.col("flags"), align.UNMAPPED))
    spans = rows.select("read_id", F.col("ref_name").alias("ref"), F.col("pos").alias("start"), align.alignment_end(F.col("pos"), F.col("cigar")).alias("limit"))
    return iv.semi_overlap(spans, _exons(spark, sf_dir), "read_id").select("read_id")


@query(_EXONS.replace("WITH gtf", f"WITH reads AS ({READS_SQL}), gtf") + """SELECT read_id FROM reads r WHERE EXISTS (SELECT 1 FROM merged m WHERE m.ref = r.ref_name AND r.pos >= m.start AND r.pos < m."limit")""")
def join7_positions_in_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = reads(spark, sf_dir, ["read_id", "ref_name", "pos"]).select("read_id", F.col("ref_name").alias("ref"), "pos")
    return iv.containing(points, _exons(spark, sf_dir)).select("read_id")


@query(
    f"""WITH reads AS ({READS_SQL}), gtf AS ({GTF_SQL}), starts AS (SELECT chrom, range_start - 1 AS at, max(gene_id) AS gene_id FROM gtf WHERE feature = 'gene' AND range_start IS NOT NULL GROUP BY ALL)
SELECT read_id, gene_id FROM (SELECT * FROM reads WHERE ref_id >= 0) r ASOF LEFT JOIN starts s ON r.ref_name = s.chrom AND r.pos >= s.at"""
)
def join8_gene_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the gene that begins last at or before each read."""
    left = reads(spark, sf_dir, ["read_id", "ref_id", "ref_name", "pos"]).where(F.col("ref_id") >= 0).select("read_id", F.col("ref_name").alias("chrom"), "pos")
    genes = gtf(spark, sf_dir, ["record_id", "chrom", "feature", "range_start", "gene_id"]).where((F.col("feature") == "gene") & F.col("range_start").isNotNull())
    found = iv.floor_lookup(left, genes.select("chrom", (F.col("range_start") - 1).alias("at"), "gene_id"), ["chrom"], "pos", "at", "gene_id")
    return found.select("read_id", "gene_id")


# Sequences

_CLEAN = "regexp_replace(upper(seq), '[^ACGT]', 'N', 'g')"


@query(
    _READS
    + f"""SELECT read_id, {_CLEAN} AS clean, regexp_matches(seq, '[^ACGT]') AS other, reverse(translate({_CLEAN}, 'ACGT', 'TGCA')) AS revcomp,
  translate({_CLEAN}, 'ACGTN', '01234') AS codes FROM reads WHERE seq IS NOT NULL"""
)
def seq5_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    rows = reads(spark, sf_dir, ["read_id", "seq"]).where(s.isNotNull())
    return rows.select("read_id", seqs.clean(s).alias("clean"), seqs.has_other_than_acgt(s).alias("other"), seqs.reverse_complement(s).alias("revcomp"), seqs.base_codes(s).alias("codes"))


_KNOWN = "regexp_replace(upper(seq), '[^=ACMGRSVTWYHKDBN]', 'N', 'g')"


@query(
    _READS
    + f"""SELECT read_id, translate({_KNOWN}, '=ACMGRSVTWYHKDBN', '0123456789ABCDEF') AS packed, {_KNOWN} AS unpacked,
  reverse(translate(translate({_KNOWN}, '=ACMGRSVTWYHKDBN', '0123456789ABCDEF'), '0123456789ABCDEF', '084C2A6E195D3B7F')) AS turned FROM reads WHERE seq IS NOT NULL"""
)
def seq1_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = seqs.pack(F.col("seq"))
    return reads(spark, sf_dir, ["read_id", "seq"]).where(F.col("seq").isNotNull()).select("read_id", packed.alias("packed"), seqs.unpack(packed).alias("unpacked"), seqs.reverse_complement_packed(packed).alias("turned"))


_TWO_BIT = "translate(regexp_replace(upper(seq), '[^ACGT]', 'A', 'g'), 'ACGT', '0123')"


@query(
    _READS
    + f"""SELECT read_id, array_to_string(list_transform(regexp_extract_all({_TWO_BIT}, '[0-3]{{1,4}}'), lambda g: printf('%02X', CAST(list_sum(list_transform(range(length(g)), lambda i: CAST(g[i + 1] AS BIGINT) * CAST(power(4, i) AS BIGINT))) AS BIGINT))), '') AS two_bit,
  CAST(length(regexp_replace(substr(seq, 11, 20), '[^CG]', '', 'g')) AS INTEGER) AS cg FROM reads WHERE seq IS NOT NULL"""
)
def seq9_two_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bases a byte, and the C and G of bases 10 to 30."""
    rows = reads(spark, sf_dir, ["read_id", "seq"]).where(F.col("seq").isNotNull())
    return rows.select("read_id", seqs.two_bit_bytes(F.col("seq")).alias("two_bit"), seqs.count_bases(F.col("seq"), "CG", 10, 30).alias("cg"))


@query("WITH RECURSIVE w AS (SELECT '' AS word UNION ALL SELECT word || unnest(['A', 'C', 'G', 'T', 'N']) FROM w WHERE length(word) < 6) SELECT word FROM w WHERE length(word) = 6")
def seq23_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs.words_over(spark, 6)


def _count_sql(base: str) -> str:
    return f"length(regexp_replace(upper(seq), '[^{base}]', '', 'g'))"


@query(
    _READS
    + f"""SELECT ref_name, CAST(sum({_count_sql('A')}) AS BIGINT) AS a, CAST(sum({_count_sql('C')}) AS BIGINT) AS c, CAST(sum({_count_sql('G')}) AS BIGINT) AS g,
  CAST(sum({_count_sql('T')}) AS BIGINT) AS t, CAST(sum({_count_sql('CG')}) AS BIGINT) AS cg FROM reads WHERE seq IS NOT NULL GROUP BY ref_name"""
)
def agg14_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir, ["read_id", "ref_name", "seq"]).where(F.col("seq").isNotNull()).withColumn("s", F.upper("seq"))
    return rows.groupBy("ref_name").agg(*[F.sum(seqs.count_bases(F.col("s"), b).cast("bigint")).alias(b.lower()) for b in ("A", "C", "G", "T", "CG")])


@query(
    _READS
    + f""", counted AS (SELECT read_id, length(seq) AS n, list_sort([{_count_sql('A')}, {_count_sql('C')}, {_count_sql('G')}, {_count_sql('T')}, {_count_sql('^ACGT').replace('[^^', '[')}], 'DESC') AS most FROM reads WHERE seq IS NOT NULL)
SELECT read_id FROM counted WHERE n = 0 OR most[1] + most[2] > n * CAST(0.6 AS DOUBLE)"""
)
def seq17_low_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir, ["read_id", "seq"]).where(F.col("seq").isNotNull())
    return rows.where(seqs.is_low_complexity(F.col("seq"), 0.6)).select("read_id")


_K = 11


@query(
    _READS
    + f""", cut AS (SELECT substr(upper(seq), i, {_K}) AS w FROM (SELECT seq, unnest(range(1, length(seq) - {_K} + 2)) AS i FROM reads WHERE seq IS NOT NULL)),
coded AS (SELECT translate(w, 'ACGT', '0123') AS f, reverse(translate(w, 'ACGT', '3210')) AS r FROM cut WHERE regexp_full_match(w, '[ACGT]{{{_K}}}'))
SELECT least(CAST(list_sum(list_transform(range({_K}), lambda i: CAST(f[i + 1] AS BIGINT) * CAST(power(4, {_K} - 1 - i) AS BIGINT))) AS BIGINT),
  CAST(list_sum(list_transform(range({_K}), lambda i: CAST(r[i + 1] AS BIGINT) * CAST(power(4, {_K} - 1 - i) AS BIGINT))) AS BIGINT)) AS kmer, count(*) AS n FROM coded GROUP BY 1"""
)
def seq24_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of canonical k-mers of all reads."""
    each = kmers.exploded_kmers(reads(spark, sf_dir, ["read_id", "seq"]), "read_id", "seq", _K)
    return each.groupBy(seqs.canonical(F.col("forward"), F.col("revcomp")).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _READS
    + """SELECT ref_name, CASE substr(ref_name, 4) WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'M' THEN 25 ELSE CASE WHEN regexp_full_match(substr(ref_name, 4), '[1-9]|1[0-9]|2[0-2]') THEN CAST(substr(ref_name, 4) AS INTEGER) END END AS chrom_no, count(*) AS n
FROM reads GROUP BY 1, 2"""
)
def seq31_chrom_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir, ["read_id", "ref_name"])
    return rows.groupBy("ref_name", seqs.chrom_number(F.col("ref_name")).alias("chrom_no")).agg(F.count(F.lit(1)).alias("n"))


# Alignment records


def _clip_sql(pattern: str) -> str:
    return f"coalesce(CAST(list_sum(list_transform(regexp_extract_all(regexp_extract(coalesce(cigar, ''), '{pattern}', 1), '(\\d+)[SH]', 1), lambda x: CAST(x AS INTEGER))) AS INTEGER), 0)"


_LEFT, _RIGHT = _clip_sql("^((?:\\d+[SH])*)"), _clip_sql("((?:\\d+[SH])*)$")


@query(
    _READS
    + f""", clipped AS (SELECT read_id, flags, pos, {_LEFT} AS l, {_RIGHT} AS r, coalesce({_SPAN_ONE}, 0) AS span FROM reads WHERE ref_id >= 0)
SELECT read_id, l AS left_clip, r AS right_clip, pos - l AS unclipped_start, pos + span + r - 1 AS unclipped_end, CASE WHEN (flags & 16) <> 0 THEN pos + span + r - 1 ELSE pos - l END AS five_prime FROM clipped"""
)
def aln1_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, f = F.col("pos"), F.col("cigar"), F.col("flags")
    rows = reads(spark, sf_dir, ["read_id", "ref_id", "flags", "pos", "cigar"]).where(F.col("ref_id") >= 0)
    return rows.select(
        "read_id",
        align.left_clip(c).alias("left_clip"),
        align.right_clip(c).alias("right_clip"),
        align.unclipped_start(p, c).alias("unclipped_start"),
        align.unclipped_end(p, c).alias("unclipped_end"),
        align.unclipped_five_prime(p, c, f).alias("five_prime"),
    )


@query(
    _READS
    + """SELECT CASE (flags & 212) WHEN 64 THEN 1 WHEN 144 THEN 1 WHEN 128 THEN 2 WHEN 80 THEN 2 ELSE 0 END AS flag_strand,
  CASE WHEN ref_id <> mate_ref_id THEN 0 WHEN (flags & 240) IN (96, 144) THEN 1 WHEN (flags & 240) IN (80, 160) THEN 2
    WHEN (flags & 8) <> 0 AND (flags & 48) = 0 THEN 1 WHEN (flags & 8) <> 0 AND (flags & 48) = 48 THEN 2 ELSE 0 END AS pair_strand, count(*) AS n FROM reads GROUP BY 1, 2"""
)
def aln6_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir, ["read_id", "flags", "ref_id", "mate_ref_id"])
    return rows.groupBy(align.flag_strand(F.col("flags")).alias("flag_strand"), align.pair_strand(F.col("flags"), F.col("ref_id"), F.col("mate_ref_id")).alias("pair_strand")).agg(F.count(F.lit(1)).alias("n"))


# Pileup


def _pileup_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = reads(spark, sf_dir, ["read_id", "read_name", "ref_name", "ref_id", "mate_ref_id", "pos", "mate_pos", "mapq", "cigar", "flags", "seq", "qual"]).where(F.col("ref_id") >= 0)
    whole = spark.range(len(REFERENCES)).select(F.get(F.array(*[F.lit(r) for r in REFERENCES]), F.col("id").cast("int")).alias("ref"), F.lit(0).alias("start"), F.lit(REFERENCE_LENGTH).alias("limit"))
    return rows.withColumnRenamed("ref_name", "ref"), whole


_GOOD_READ = "(flags & 3840) = 0 AND (flags & 4) = 0 AND mapq >= 60 AND ref_name IS NOT NULL AND pos >= 0 AND ref_id >= 0 AND cigar NOT IN ('*', '') AND seq <> '*' AND NOT regexp_matches(cigar, '[=XPB]')"
_BASES_SQL = (
    _READS
    + f""", stranded AS (SELECT *, CASE WHEN ref_id <> mate_ref_id THEN 0 WHEN (flags & 240) IN (96, 144) THEN 1 WHEN (flags & 240) IN (80, 160) THEN 2
    WHEN (flags & 8) <> 0 AND (flags & 48) = 0 THEN 1 WHEN (flags & 8) <> 0 AND (flags & 48) = 48 THEN 2 ELSE 0 END AS strand FROM reads WHERE {_GOOD_READ}),
kept AS (SELECT *, regexp_extract_all(cigar, '([0-9]+)[MIDNSH]', 1) AS sizes, regexp_extract_all(cigar, '[0-9]+([MIDNSH])', 1) AS kinds FROM stranded WHERE strand <> 0),
ops AS (SELECT read_id, read_name, ref_name AS ref, pos AS begin, mate_pos, flags, strand, upper(seq) AS seq, qual, i, CAST(sizes[i] AS INTEGER) AS size, kinds[i] AS kind FROM kept, unnest(range(1, len(sizes) + 1)) t(i)),
laid AS (SELECT *, begin + coalesce(sum(CASE WHEN kind IN ('M', 'D', 'N') THEN size ELSE 0 END) OVER w, 0) AS ref_start, coalesce(sum(CASE WHEN kind IN ('M', 'I', 'S') THEN size ELSE 0 END) OVER w, 0) AS read_start FROM ops
  WINDOW w AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spread AS (SELECT read_id, read_name, ref, strand, begin, mate_pos, flags, ref_start + j AS pos, substr(seq, CAST(read_start + j + 1 AS BIGINT), 1) AS b, coalesce(qual[CAST(read_start + j + 1 AS BIGINT)], 0) AS quality FROM laid, unnest(range(size)) u(j) WHERE kind = 'M'),
bases AS (SELECT *, CASE WHEN b IN ('A', 'C', 'G', 'T') THEN b ELSE 'N' END AS base FROM spread WHERE length(b) = 1)
"""
)


def _counts_sql(source: str, least: int) -> str:
    each = ", ".join(f"count(*) FILTER (base = '{b}' AND strand = {s} AND quality >= {least}) AS {b.lower()}_{n}" for b in "ACGT" for s, n in ((1, "fwd"), (2, "rev")))
    return f"SELECT ref, CAST(pos AS BIGINT) AS pos, count(*) AS depth, {each}, count(*) FILTER (base = 'N') AS n FROM {source} GROUP BY ref, pos"


@query(_BASES_SQL + _counts_sql("bases", 20))
def pil6_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.pileup(*_pileup_input(spark, sf_dir), pileup.PileupOptions(min_base_quality=20))


_STITCHED_SQL = (
    _BASES_SQL
    + f""", ends AS (SELECT read_id, read_name, ref_name AS ref, pos, mate_pos, flags, pos + coalesce({_SPAN_ONE}, 0) AS "limit", pos < mate_pos OR (pos = mate_pos AND (flags & 64) <> 0) AS early FROM stranded WHERE strand <> 0 AND mate_pos >= 0 AND read_name IS NOT NULL),
sides AS (SELECT read_name, ref, least(pos, mate_pos) AS low, greatest(pos, mate_pos) AS high, min(read_id) FILTER (early) AS a, arg_min("limit", read_id) FILTER (early) AS a_limit, min(read_id) FILTER (NOT early) AS b FROM ends GROUP BY ALL),
mates AS (SELECT a AS fragment, unnest([a, b]) AS read_id FROM sides WHERE a IS NOT NULL AND b IS NOT NULL AND high < a_limit AND high - low < 511),
met AS (SELECT fragment, ref, pos, strand, min(base) AS x, max(base) AS y, min(quality) AS q, max(quality) AS r, count(*) AS n FROM bases JOIN mates USING (read_id) GROUP BY ALL),
weighed AS (SELECT *, pow(10.0::DOUBLE, -q / 10.0::DOUBLE) AS e, pow(10.0::DOUBLE, -r / 10.0::DOUBLE) AS f FROM met),
stitched AS (SELECT ref, pos, strand, base, quality FROM bases ANTI JOIN mates USING (read_id) UNION ALL
  SELECT ref, pos, strand, CASE WHEN n = 1 OR x = y THEN x ELSE 'N' END, CASE WHEN n > 1 AND x = y THEN least(CAST(round(-10.0 * log10((e * f) / ((1 - e) * (1 - f) + e * f))) AS INTEGER), 95) ELSE q END FROM weighed)
"""
)


@query(_STITCHED_SQL + _counts_sql("stitched", 43))
def pil7_stitched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.pileup(*_pileup_input(spark, sf_dir), pileup.PileupOptions(min_base_quality=43, stitch=True))


@query(_BASES_SQL + ", one AS (SELECT * FROM bases WHERE strand = 2) " + _counts_sql("one", 20))
def pil11_reverse_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pileup of the fragments of the reverse strand."""
    return pileup.per_strand(*_pileup_input(spark, sf_dir), pileup.PileupOptions(min_base_quality=20))["rev"]


@query(
    _BASES_SQL
    + """SELECT ref, CAST(pos AS BIGINT) AS pos, base, count(*) AS n, string_agg(CAST(read_offset AS VARCHAR), ',' ORDER BY read_id) AS from_start, string_agg(CAST(quality AS VARCHAR), ',' ORDER BY read_id) AS quality
FROM (SELECT b.*, b.at - 1 AS read_offset FROM (SELECT read_id, ref, ref_start + j AS pos, CASE WHEN substr(seq, CAST(read_start + j + 1 AS BIGINT), 1) IN ('A', 'C', 'G', 'T') THEN substr(seq, CAST(read_start + j + 1 AS BIGINT), 1) ELSE 'N' END AS base, CAST(read_start + j + 1 AS BIGINT) AS at, coalesce(qual[CAST(read_start + j + 1 AS BIGINT)], 0) AS quality
  FROM laid, unnest(range(size)) u(j) WHERE kind = 'M') b) WHERE base <> 'N' AND quality >= 20 GROUP BY ref, pos, base""".replace("b.at", "b.spot").replace("AS at,", "AS spot,")
)
def pil9_read_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each base seen, where in which reads it stands, and its qualities."""
    options = pileup.PileupOptions(min_base_quality=20)
    found = pileup.read_features(pileup.aligned_bases(*_pileup_input(spark, sf_dir), options), options)
    lists = [F.array_join(F.transform(f"features.{c}", lambda x: x.cast("string")), ",").alias(n) for c, n in (("from_start", "from_start"), ("quality", "quality"))]
    return found.select("ref", "pos", "base", F.size("features").cast("bigint").alias("n"), *lists)


def _first_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for the outputs: at every position the base that most reads show, ties to the smaller one."""
    found = pil6_base_counts(spark, sf_dir)
    counts = F.array(*[F.struct((F.col(f"{b.lower()}_fwd") + F.col(f"{b.lower()}_rev")).alias("n"), F.lit(-i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate("ACGT")])
    return found.select("ref", "pos", F.array_max(counts)["b"].alias("base"))


_PILED = _BASES_SQL + ", piled AS (" + _counts_sql("bases", 20) + """), most AS (SELECT *, a_fwd + a_rev AS a, c_fwd + c_rev AS c, g_fwd + g_rev AS g, t_fwd + t_rev AS t FROM piled),
refs AS (SELECT *, CASE WHEN a >= greatest(c, g, t) THEN 'A' WHEN c >= greatest(g, t) THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END AS r FROM most)
"""


@query(_PILED + """SELECT ref AS "#CHROM", pos + 1 AS "POS", r AS "REF", depth AS "DP", CASE r WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END AS ref_depth_tier1, CAST(0 AS BIGINT) AS ref_depth_tier2 FROM refs""")
def snk11_reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.reference_lines(pil6_base_counts(spark, sf_dir), _first_reads(spark, sf_dir))


@query(
    _PILED
    + """SELECT ref AS "#CHROM", pos + 1 AS "POS", r AS "REF", s AS "ALT", v AS alt_depth_tier1, CAST(0 AS BIGINT) AS alt_depth_tier2 FROM (SELECT *, unnest(['A', 'C', 'G', 'T']) AS s, unnest([a, c, g, t]) AS v FROM refs) WHERE v > 0 AND s <> r"""
)
def snk11_alternative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.alternative_lines(pil6_base_counts(spark, sf_dir), _first_reads(spark, sf_dir))


@query(_PILED + 'SELECT ref AS "#CHROM", pos + 1 AS "POS", r AS "REF", ' + ", ".join(f'{c} AS "{n}"' for n, c in pileup.STRAND_COLUMNS.items()) + " FROM refs")
def snk13_base_strand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.base_strand_lines(pil6_base_counts(spark, sf_dir), _first_reads(spark, sf_dir))


# Fusion building blocks over the k-mer table: a "gene" is the file that a k-mer was scanned from

_HITS = """WITH k AS (SELECT file_id, read_idx, pos, least(forward_kmer, revcomp_kmer) AS kmer FROM kmers WHERE forward_kmer <> -1 AND revcomp_kmer <> -1),
pairs AS (SELECT DISTINCT kmer, file_id % 100 AS gene FROM k WHERE file_id IS NOT NULL), small AS (SELECT kmer FROM pairs GROUP BY kmer HAVING count(*) <= 5)
"""


def _kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "kmers", ["file_id", "read_idx", "pos", "forward_kmer", "revcomp_kmer"])
    return rows.where((F.col("forward_kmer") != -1) & (F.col("revcomp_kmer") != -1)).select("file_id", "read_idx", F.col("pos").cast("bigint").alias("pos"), seqs.canonical(F.col("forward_kmer"), F.col("revcomp_kmer")).alias("kmer"))


def _gene_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.gene_index(_kmers(spark, sf_dir).select("kmer", (F.col("file_id") % 100).alias("gene")))


@query(_HITS + "SELECT kmer, list_sort(list(gene)) AS genes FROM pairs JOIN small USING (kmer) GROUP BY kmer")
def fus5_gene_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gene_index(spark, sf_dir)


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _kmers(spark, sf_dir).withColumn("fragment", F.concat_ws(":", "file_id", "read_idx")).join(_gene_index(spark, sf_dir), "kmer")
    return fusion.gene_ranges(hits.select("fragment", F.explode("genes").alias("gene"), "pos"), 23)


_RANGES = (
    _HITS
    + """, hits AS (SELECT DISTINCT concat_ws(':', file_id, read_idx) AS fragment, gene, CAST(pos AS BIGINT) AS pos FROM k JOIN small USING (kmer) JOIN pairs USING (kmer)),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER w + 23 THEN 0 ELSE 1 END AS fresh FROM hits WINDOW w AS (PARTITION BY fragment, gene ORDER BY pos)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY fragment, gene ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM marked),
ranges AS (SELECT fragment, gene, min(pos) AS start, max(pos) + 23 AS "limit" FROM numbered GROUP BY fragment, gene, run),
spans AS (SELECT fragment, gene, CAST(sum("limit" - start) AS BIGINT) AS span FROM ranges GROUP BY fragment, gene)
"""
)


@query(_RANGES + 'SELECT fragment, gene, start, "limit" FROM ranges')
def fus6_gene_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


@query(_RANGES + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fragment ORDER BY span DESC, gene) AS INTEGER) AS place FROM spans) WHERE place <= 5")
def fus7_top_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_genes(fusion.gene_spans(_ranges(spark, sf_dir)))


@query(_RANGES + "SELECT genes, count(*) AS fragments FROM (SELECT CAST(least(count(*), 4) AS INTEGER) AS genes FROM spans GROUP BY fragment) GROUP BY genes")
def agg10_gene_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.gene_count_histogram(fusion.gene_spans(_ranges(spark, sf_dir)))


@query(_RANGES + """SELECT fragment, gene, start, CAST(sum("limit" - start) OVER w AS BIGINT) AS up_to, CAST(sum("limit" - start) OVER v AS BIGINT) AS from_here FROM ranges
WINDOW w AS (PARTITION BY fragment, gene ORDER BY start ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY fragment, gene ORDER BY start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def win4_span_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion_calls.span_sums(_ranges(spark, sf_dir)).select("fragment", "gene", "start", "up_to", "from_here")


@query(
    _RANGES
    + """, g AS (SELECT fragment, gene, count(*) AS r, row_number() OVER (PARTITION BY fragment ORDER BY sum("limit" - start) DESC, gene) AS place FROM ranges GROUP BY fragment, gene),
f AS (SELECT fragment, count(*) AS n, sum(r) AS rr, count(*) FILTER (place <= 5) AS kn, sum(r) FILTER (place <= 5) AS kr FROM g GROUP BY fragment)
SELECT count(*) AS fragments, CAST(sum(n) AS BIGINT) AS raw_genes, CAST(sum(rr) AS BIGINT) AS raw_ranges, CAST(sum(kn) AS BIGINT) AS genes, CAST(sum(kr) AS BIGINT) AS ranges,
  count(*) FILTER (n = 1) AS fragments_1, count(*) FILTER (n = 2) AS fragments_2, count(*) FILTER (n = 3) AS fragments_3, count(*) FILTER (n >= 4) AS fragments_4 FROM f"""
)
def agg10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion_calls.fusion_stats(_ranges(spark, sf_dir))


# For calls, a locus of the annotation is the fragment and its transcripts, which share and swap exons, are the "genes"

_OPTIONS = fusion_calls.FusionOptions(kmer=23, most_gap=2_000, most_homology=400, least_span=10)
_CALLS = (
    _GTF
    + f""", e AS (SELECT concat_ws(':', gene_id, chrom) AS fragment, transcript_id AS gene, CAST(range_start - 1 AS BIGINT) AS a, CAST(range_stop AS BIGINT) AS b FROM gtf WHERE feature = 'exon' AND range_start <= range_stop AND transcript_id IS NOT NULL),
marked AS (SELECT *, max(b) OVER (PARTITION BY fragment, gene ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY fragment, gene ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM marked),
ranges AS (SELECT fragment, gene, min(a) AS start, max(b) AS "limit" FROM numbered GROUP BY fragment, gene, run),
lengths AS (SELECT fragment, max(span) * 6 // 5 AS length1, 0 AS length2 FROM (SELECT fragment, sum("limit" - start) AS span FROM ranges GROUP BY fragment, gene) GROUP BY fragment),
r AS (SELECT *, "limit" - start AS size, sum("limit" - start) OVER w AS mine, sum("limit" - start) OVER v AS rest, min(start) OVER p AS g_start, max("limit") OVER p AS g_limit FROM ranges
  WINDOW w AS (PARTITION BY fragment, gene ORDER BY start ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY fragment, gene ORDER BY start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), p AS (PARTITION BY fragment, gene)),
g0 AS (SELECT fragment, gene, coalesce(sum(size) FILTER (start < 1000000000), 0) AS span1, coalesce(sum(size) FILTER (start >= 1000000000), 0) AS span2, sum(size) AS span FROM r GROUP BY fragment, gene),
g1 AS (SELECT *, row_number() OVER (PARTITION BY fragment ORDER BY span DESC, gene) AS place FROM g0),
g2 AS (SELECT g1.*, length1, length2, length1 + length2 AS total, count(*) OVER (PARTITION BY fragment) AS n_genes FROM g1 JOIN lengths USING (fragment) WHERE place <= 5),
g AS (SELECT *, bool_or((n_genes > 1 AND span > total - 23) OR (span1 < greatest(23, length1 * 50 // 100) AND span2 < greatest(23, length2 * 50 // 100))) OVER (PARTITION BY fragment ORDER BY place) AS ended FROM g2),
gp AS (SELECT a.fragment, a.gene AS ga, b.gene AS gb, a.place AS pa, b.place AS pb, a.span AS sa, b.span AS sb, a.total * (CASE WHEN least(a.span, b.span) >= 30 THEN 80 ELSE 90 END) // 100 AS need
  FROM g a JOIN g b ON a.fragment = b.fragment AND a.place < b.place WHERE NOT a.ended AND a.span + b.span >= a.total * (CASE WHEN least(a.span, b.span) >= 30 THEN 80 ELSE 90 END) // 100),
xs AS (SELECT p.fragment, ga, gb, s.side, r.start, r."limit", r.size, r.mine, r.g_start, CASE WHEN s.side = 0 THEN gb ELSE ga END AS other FROM gp p, (VALUES (0), (1)) s(side), r WHERE r.fragment = p.fragment AND r.gene = CASE WHEN s.side = 0 THEN ga ELSE gb END),
met AS (SELECT x.*, y.start AS y_start, y."limit" AS y_limit, y.size AS y_size, y.rest AS y_rest, y.g_limit AS y_end FROM xs x JOIN r y ON y.fragment = x.fragment AND y.gene = x.other AND (y."limit" > x."limit" OR (x.side = 0 AND y."limit" = x."limit"))
  QUALIFY row_number() OVER (PARTITION BY x.fragment, ga, gb, x.side, x.start ORDER BY y.start) = 1),
kinds AS (SELECT *, CASE WHEN "limit" < y_start THEN 'gap' WHEN start > y_start THEN 'inside' ELSE 'over' END AS kind FROM met),
shared AS (SELECT *, coalesce(sum(CASE kind WHEN 'inside' THEN size WHEN 'over' THEN "limit" - y_start ELSE 0 END) OVER (PARTITION BY fragment, ga, gb ORDER BY "limit", side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  CASE kind WHEN 'inside' THEN size WHEN 'over' THEN "limit" - y_start ELSE 0 END AS own FROM kinds),
seen AS (SELECT *, CASE kind WHEN 'gap' THEN mine + y_rest WHEN 'over' THEN mine - size + y_limit - start + y_rest - y_size END AS joint, mine > y_rest OR (mine = y_rest AND side = 0) AS whole FROM shared WHERE before < {_OPTIONS.most_homology}),
fit AS (SELECT * FROM seen WHERE kind = 'over' OR (kind = 'gap' AND ((start < 1000000000 AND y_start >= 1000000000) OR y_start - "limit" + 1 <= {_OPTIONS.most_gap}))),
best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY fragment, ga, gb ORDER BY joint DESC, "limit", side) = 1),
homology AS (SELECT fragment, ga, gb, sum(own) AS own FROM seen GROUP BY ALL),
joined AS (SELECT p.*, b.joint AS bj, CASE WHEN kind = 'gap' OR whole THEN mine ELSE b.joint - y_rest END AS first_span, g_start, CASE WHEN kind = 'gap' OR whole THEN b."limit" ELSE y_start END AS until,
  CASE WHEN kind = 'over' AND whole THEN b."limit" ELSE y_start END AS since, y_end, side = 0 AS straight, coalesce(h.own, 0) AS own FROM gp p LEFT JOIN best b USING (fragment, ga, gb) LEFT JOIN homology h USING (fragment, ga, gb)),
scored AS (SELECT *, CASE WHEN sa > coalesce(bj, 0) THEN sa WHEN sb > coalesce(bj, 0) THEN sb WHEN own >= {_OPTIONS.most_homology} THEN NULL ELSE bj END AS joint, sa > coalesce(bj, 0) OR sb > coalesce(bj, 0) AS single FROM joined),
top AS (SELECT * FROM scored WHERE joint >= need QUALIFY joint = max(joint) OVER (PARTITION BY fragment)),
shapes AS (SELECT *, bool_or(single OR first_span = 0 OR joint = first_span OR joint - sa < {_OPTIONS.least_span}) OVER (PARTITION BY fragment) AS one_sided,
  [first_span, joint - first_span] || list_concat(least([g_start, until], [since, y_end]), greatest([g_start, until], [since, y_end])) AS shape FROM top),
calls AS (SELECT fragment AS candidate, CAST(row_number() OVER (PARTITION BY fragment ORDER BY pa, pb) - 1 AS INTEGER) AS n, ga AS gene1, gb AS gene2, CAST(first_span AS BIGINT) AS span1, CAST(joint - first_span AS BIGINT) AS span2, CAST(joint AS BIGINT) AS joint, straight,
  g_start AS start1, until AS limit1, since AS start2, y_end AS limit2 FROM shapes WHERE NOT one_sided QUALIFY min(shape) OVER (PARTITION BY fragment) = max(shape) OVER (PARTITION BY fragment))
"""
)


def _transcript_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gtf(spark, sf_dir, ["record_id", "chrom", "feature", "range_start", "range_stop", "gene_id", "transcript_id"])
    exons = rows.where((F.col("feature") == "exon") & F.col("transcript_id").isNotNull()).select(F.concat_ws(":", "gene_id", "chrom").alias("fragment"), F.col("transcript_id").alias("gene"), F.col("range_start").cast("bigint").alias("start"), F.col("range_stop").cast("bigint").alias("limit"))
    merged = periods.merged_and_gaps(exons, ["fragment", "gene"], "start", "limit").where(F.col("kind") == "merged")
    return merged.select("fragment", "gene", (F.col("start") - 1).alias("start"), "limit")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = _transcript_ranges(spark, sf_dir)
    spans = fusion.gene_spans(ranges).groupBy("fragment").agg(F.expr("max(span) * 6 div 5").alias("length1"), F.lit(0).alias("length2"))
    return fusion_calls.fusion_calls(fusion_calls.fragment_genes(ranges).join(spans, "fragment"), options=_OPTIONS)


@query(_CALLS + "SELECT * FROM calls")
def fus9_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all loci, any pair of transcripts: the longest joint spans."""
    return _calls(spark, sf_dir)


_FAMILIES = _CALLS + ", families AS (SELECT * REPLACE (right(gene1, 1) AS gene1, right(gene2, 1) AS gene2) FROM calls)"


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls with genes named by the last character only, so that candidates share pairs."""
    return _calls(spark, sf_dir).withColumns({c: F.right(c, F.lit(1)) for c in ("gene1", "gene2")})


@query(
    _FAMILIES
    + """, grouped AS (SELECT candidate, string_agg(least(gene1, gene2) || '/' || greatest(gene1, gene2), ',' ORDER BY n) AS grp, min(least(span1, span2)) AS short FROM families GROUP BY candidate),
enough AS (SELECT grp FROM grouped GROUP BY grp HAVING count(*) FILTER (short >= 100) >= 2)
SELECT candidate, n, least(gene1, gene2) || '/' || greatest(gene1, gene2) AS name FROM families SEMI JOIN (SELECT candidate FROM grouped SEMI JOIN enough USING (grp)) k USING (candidate)"""
)
def fus14_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of gene pairs that two candidates span well, with their names."""
    return fusion_calls.named(fusion_calls.well_supported(_families(spark, sf_dir), least_span=100)).select("candidate", "n", "name")


@query(
    _FAMILIES
    + """, partners AS (SELECT gene1 AS gene, gene2 AS other FROM families UNION SELECT gene2, gene1 FROM families), many AS (SELECT gene FROM partners GROUP BY gene HAVING count(*) > 5)
SELECT candidate, n, gene1, gene2 FROM families WHERE gene1 NOT IN (FROM many) AND gene2 NOT IN (FROM many)"""
)
def fus15_without_promiscuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.without_promiscuous(_families(spark, sf_dir), 5).select("candidate", "n", "gene1", "gene2")


@query(
    _FAMILIES
    + """, named AS (SELECT candidate, least(gene1, gene2) || '/' || greatest(gene1, gene2) AS name FROM families), support AS (SELECT name, count(DISTINCT candidate) AS s FROM named GROUP BY name),
foremost AS (SELECT candidate, name FROM (SELECT DISTINCT candidate, name, s FROM named JOIN support USING (name)) QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY s DESC, name) = 1),
called AS (SELECT name FROM foremost GROUP BY name HAVING count(*) >= 2), truth AS (SELECT DISTINCT a || '/' || b AS name FROM (SELECT right(transcript_id, 1) AS a, right(gene_id, 1) AS b FROM gtf WHERE transcript_id IS NOT NULL) WHERE a < b)
SELECT (SELECT count(*) FROM called SEMI JOIN truth USING (name)) AS true_positives, (SELECT count(*) FROM called ANTI JOIN truth USING (name)) AS false_positives, (SELECT count(*) FROM truth ANTI JOIN called USING (name)) AS false_negatives"""
)
def agg17_truth_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = gtf(spark, sf_dir, ["record_id", "gene_id", "transcript_id"]).where(F.col("transcript_id").isNotNull()).select(F.right("transcript_id", F.lit(1)).alias("a"), F.right("gene_id", F.lit(1)).alias("b")).where("a < b")
    return fusion_calls.truth_score(fusion_calls.named(_families(spark, sf_dir)), ends.select(F.concat_ws("/", "a", "b").alias("name")))


@query()
def fus13_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of candidates that aren't near an earlier one of their gene pairs, by the name's last eight characters as UMI."""
    calls = _families(spark, sf_dir)
    texts = calls.select("candidate").distinct().select("candidate", F.right(F.split_part("candidate", F.lit(":"), F.lit(1)), F.lit(8)).alias("umi"), F.lit("").alias("r1"), F.lit("").alias("r2"))
    return fusion_calls.without_duplicates(calls, texts, umis=True).select("candidate", "n", "gene1", "gene2")


# Annotation

_COLUMNS = ["record_id", "chrom", "feature", "range_start", "range_stop", "strand", "gene_id", "transcript_id", "gene_type"]


@query(
    _GTF
    + """, ok AS (SELECT * FROM gtf WHERE range_start <= range_stop), genes AS (SELECT DISTINCT gene_id, chrom FROM ok WHERE feature = 'gene'),
one AS (SELECT transcript_id, gene_id, chrom, strand, gene_type FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY record_id) AS k FROM ok WHERE feature = 'transcript' AND transcript_id IS NOT NULL) WHERE k = 1),
e AS (SELECT transcript_id, gene_id, chrom, count(*) AS n_exons, CAST(sum(range_stop - range_start + 1) AS BIGINT) AS exon_bases FROM ok WHERE feature = 'exon' GROUP BY ALL)
SELECT transcript_id, gene_id, chrom, strand, gene_type, n_exons, exon_bases FROM one SEMI JOIN genes USING (gene_id, chrom) JOIN e USING (transcript_id, gene_id, chrom)"""
)
def gtf1_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.transcripts(gtf(spark, sf_dir, _COLUMNS))


@query(
    _GTF
    + """SELECT record_id, feature FROM gtf g WHERE feature = 'transcript' AND NOT EXISTS (SELECT 1 FROM gtf x WHERE x.feature = 'gene' AND x.gene_id = g.gene_id)
UNION ALL SELECT record_id, feature FROM gtf g WHERE feature = 'exon' AND NOT EXISTS (SELECT 1 FROM gtf x WHERE x.feature = 'transcript' AND x.transcript_id = g.transcript_id)"""
)
def join12_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.orphans(gtf(spark, sf_dir, _COLUMNS))


@query(
    _GTF
    + """, wide AS (SELECT transcript_id, chrom, greatest(range_start - 250, 1) AS a, range_stop + 250 AS b FROM gtf WHERE feature = 'exon' AND range_start <= range_stop),
marked AS (SELECT *, max(b) OVER (PARTITION BY transcript_id, chrom ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id, chrom ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT transcript_id, chrom, min(a) AS range_start, max(b) AS range_stop FROM numbered GROUP BY transcript_id, chrom, run"""
)
def gtf2_padded_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.padded_exons(gtf(spark, sf_dir, _COLUMNS), 250).select("transcript_id", "chrom", "range_start", "range_stop")


@query(
    _GTF
    + """, genes AS (SELECT gene_id, chrom, min(range_start) AS start FROM gtf WHERE feature = 'gene' AND range_start <= range_stop AND gene_id IS NOT NULL GROUP BY ALL)
SELECT gene_id, chrom, CAST(row_number() OVER (PARTITION BY chrom ORDER BY start, gene_id) - 1 AS INTEGER) AS place FROM genes"""
)
def gtf4_gene_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.gene_places(gtf(spark, sf_dir, _COLUMNS))


_LISTED = "list(struct_pack(start := CAST(range_start AS INTEGER), stop := CAST(range_stop AS INTEGER)) ORDER BY range_start, range_stop)"
_TRANSCRIPTS = (
    _GTF
    + f""", ok AS (SELECT * FROM gtf WHERE range_start <= range_stop), one AS (SELECT transcript_id, gene_id, chrom, strand FROM ok WHERE feature = 'transcript' AND transcript_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY record_id) = 1),
listed AS (SELECT transcript_id, gene_id, chrom, one.strand, {_LISTED} AS l FROM (SELECT transcript_id, gene_id, chrom, range_start, range_stop FROM ok WHERE feature = 'exon') e JOIN one USING (transcript_id, gene_id, chrom) GROUP BY ALL),
ordered AS (SELECT * REPLACE (CASE WHEN strand = '-' THEN list_reverse(l) ELSE l END AS l) FROM listed)
"""
)


def _shown(pieces: str) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat_ws("-", p["start"].cast("string"), p["stop"].cast("string"))), ",")


def _shown_sql(pieces: str) -> str:
    return f"array_to_string(list_transform({pieces}, lambda p: concat_ws('-', p.start, p.stop)), ',')"


@query(
    _TRANSCRIPTS.replace("WITH gtf", "WITH RECURSIVE gtf", 1)
    + """, fold AS (SELECT transcript_id, strand, l, 0 AS i, CAST([] AS STRUCT(start INTEGER, stop INTEGER)[]) AS js FROM ordered
  UNION ALL
  SELECT transcript_id, strand, l, i + 1, list_append(CASE WHEN len(js) > 0 AND CASE WHEN js[-1].start <= one.start THEN one.start <= js[-1].stop + 1 ELSE js[-1].start - 1 <= one.stop END
      THEN list_append(js[:-2], CASE WHEN strand = '-' THEN struct_pack(start := one.start, stop := js[-1].stop) ELSE struct_pack(start := js[-1].start, stop := one.stop) END) ELSE list_append(js, one) END, two)
  FROM (SELECT *, CASE WHEN strand = '-' THEN z ELSE a END AS one, CASE WHEN strand = '-' THEN a ELSE z END AS two FROM (
    SELECT *, struct_pack(start := l[i + 1].start - 60, stop := l[i + 1].start + 10) AS a, struct_pack(start := l[i + 1].stop - 10, stop := l[i + 1].stop + 60) AS z FROM fold WHERE i < len(l))))
"""
    + f"SELECT transcript_id, {_shown_sql('js')} AS junctions FROM fold WHERE i = len(l)"
)
def gtf3_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transcript's windows of 60 bases outside and 10 inside of its exons' ends."""
    return annotation.transcript_pieces(gtf(spark, sf_dir, _COLUMNS), 60, separate_junctions=True, kept=10).select("transcript_id", _shown("junctions").alias("junctions"))


@query(
    _TRANSCRIPTS.replace("WITH gtf", "WITH RECURSIVE gtf", 1)
    + """, fold AS (SELECT transcript_id, l, 0 AS i, CAST([] AS STRUCT(start INTEGER, stop INTEGER)[]) AS js FROM ordered
  UNION ALL
  SELECT transcript_id, l, i + 1, CASE WHEN len(js) > 0 AND CASE WHEN js[-1].start <= e.start THEN e.start <= js[-1].stop + 1 ELSE js[-1].start - 1 <= e.stop END
      THEN list_append(js[:-2], struct_pack(start := least(js[-1].start, e.start), stop := greatest(js[-1].stop, e.stop))) ELSE list_append(js, e) END
  FROM (SELECT *, struct_pack(start := greatest(l[i + 1].start - 40, 0), stop := l[i + 1].stop + 40) AS e FROM fold WHERE i < len(l)))
"""
    + f"SELECT transcript_id, array_to_string(list_transform(l, lambda e: e.stop - e.start + 1), ',') AS exon_lengths, {_shown_sql('js')} AS exons FROM fold WHERE i = len(l)"
)
def gtf6_transcript_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transcript's exons with 40 bases of padding, merged in order, and their lengths without."""
    rows = annotation.transcript_pieces(gtf(spark, sf_dir, _COLUMNS), 40)
    return rows.select("transcript_id", F.array_join(F.transform("exon_lengths", lambda n: n.cast("string")), ",").alias("exon_lengths"), _shown("exons").alias("exons"))


@query(_GTF + f"SELECT gene_id, chrom, strand, concat_ws('-', greatest(range_start - 500, 1), range_stop + 500) AS piece FROM gtf WHERE feature = 'gene' AND gene_id IS NOT NULL AND range_start <= range_stop QUALIFY row_number() OVER (PARTITION BY gene_id, chrom ORDER BY record_id) = 1")
def gtf7_whole_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.gene_pieces(gtf(spark, sf_dir, _COLUMNS), 500).select("gene_id", "chrom", "strand", _shown("exons").alias("piece"))


@query(
    _TRANSCRIPTS
    + f""", each AS (SELECT gene_id, chrom, strand, unnest(l, recursive := true) FROM ordered),
marked AS (SELECT *, max(stop) OVER (PARTITION BY gene_id, chrom, strand ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM each),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id, chrom, strand ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM marked),
merged AS (SELECT gene_id, chrom, strand, min(start) AS start, max(stop) AS stop FROM numbered GROUP BY gene_id, chrom, strand, run),
whole AS (SELECT gene_id, chrom, strand, list(struct_pack(start, stop) ORDER BY start) AS l FROM merged GROUP BY ALL)
SELECT gene_id, chrom, strand, {_shown_sql("CASE WHEN strand = '-' THEN list_reverse(l) ELSE l END")} AS exons FROM whole"""
)
def gtf8_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged exons of all transcripts of each gene."""
    return annotation.collapsed_pieces(gtf(spark, sf_dir, _COLUMNS)).select("gene_id", "chrom", "strand", _shown("exons").alias("exons"))


# Raw reads: sampling and UMIs

_FIELD = '[^",]*|"(?:[^"]|"")*"'
_LINES = f"""WITH lines AS (SELECT raw_id, CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE coalesce(raw_line, '') END AS l FROM fastq_raw),
cut AS (SELECT raw_id, l, {", ".join(f"regexp_extract(l, '(?s)^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', {i}) AS f{i}" for i in range(1, 5))} FROM lines),
fields AS (SELECT raw_id, l, {", ".join(f"CASE WHEN left(f{i}, 1) = chr(34) THEN replace(substr(f{i}, 2, length(f{i}) - 2), repeat(chr(34), 2), chr(34)) ELSE f{i} END AS g{i}" for i in range(1, 5))} FROM cut),
judged AS (SELECT *, CASE WHEN NOT regexp_full_match(l, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') THEN 'quoting' WHEN l = '' OR NOT regexp_full_match(l, '(?s)(?:{_FIELD})(?:,(?:{_FIELD})){{3}}') THEN 'columns'
  WHEN left(g1, 1) <> '@' THEN 'id' WHEN left(g3, 1) <> '+' THEN 'unk' WHEN length(g2) <> length(g4) OR NOT regexp_full_match(g4, '[!-~]*') THEN 'qual' END AS reason FROM fields)
"""


def _parsed(spark: SparkSession, sf_dir: str, edits: bool = False) -> DataFrame:
    return badrows.parse_reads(table(spark, sf_dir, "fastq_raw", ["raw_id", "raw_line"]), edits=edits)


@query(_LINES + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where(F.col("reason").isNotNull()).select("raw_id", "reason")


@query(_LINES + "SELECT raw_id, g1 AS id, g2 AS seq, g3 AS unk, g4 AS qual FROM judged WHERE reason IS NULL")
def p6_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where(F.col("reason").isNull()).select("raw_id", "id", "seq", "unk", "qual")


@query()
def p6_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that fail, with the cheapest edits that would give them four fields."""
    return _parsed(spark, sf_dir, edits=True).where(F.col("reason").isNotNull()).select("raw_id", "reason", "edit_cost", "edits")


_P = badrows.programme(badrows.FIELDS)
_N = len(_P.begin)


@query(
    _LINES.replace("WITH lines", "WITH RECURSIVE lines", 1)
    + f""", failing AS (SELECT raw_id, reason, list_transform(regexp_extract_all(l, '"|,|[^",]+'), lambda t: CASE t WHEN chr(34) THEN 0 WHEN ',' THEN 1 ELSE 2 END) AS kinds FROM judged WHERE reason IS NOT NULL),
steps AS (SELECT {_P.step.ravel().tolist()} AS m),
walk AS (
  SELECT raw_id, reason, kinds, 0 AS i, {_P.begin.tolist()} AS v FROM failing
  UNION ALL
  SELECT raw_id, reason, kinds, i + 1, list_transform(range({_N}), lambda y: list_min(list_transform(range({_N}), lambda x: v[x + 1] + m[kinds[i + 1] * {_N * _N} + x * {_N} + y + 1]))) FROM walk, steps WHERE i < len(kinds)),
ended AS (SELECT * FROM walk WHERE i = len(kinds))
SELECT raw_id, reason, CAST(list_min(list_transform({_P.accepted(True)}, lambda x: v[x + 1])) AS INTEGER) AS quote_cost, CAST(list_min(list_transform({_P.accepted(False)}, lambda x: v[x + 1])) AS INTEGER) AS edit_cost FROM ended"""
)
def p6_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that fail, with the least edits for good quoting and for four fields."""
    return _parsed(spark, sf_dir).where(F.col("reason").isNotNull()).select("raw_id", "reason", "quote_cost", "edit_cost")


RATE, COUNT = 0.25, 1000
_NAME_NUMBER = "CAST(('0x' || substr(md5(g1), 1, 15)) AS BIGINT)"


@query(_LINES + f"SELECT raw_id FROM judged WHERE reason IS NULL AND {_NAME_NUMBER} < {int(RATE * sampling.SPACE)}")
def smp1_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the reads, chosen by a hash of the id, so that mates stay together on every run."""
    return sampling.by_rate(p6_reads(spark, sf_dir), RATE).select("raw_id")


@query(_LINES + f"SELECT raw_id FROM judged WHERE reason IS NULL AND {_NAME_NUMBER} < (SELECT least({COUNT} * {sampling.SPACE}::HUGEINT // count(*), {sampling.SPACE}) FROM judged WHERE reason IS NULL)")
def smp2_downsample_to_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a thousand reads."""
    return sampling.to_count(p6_reads(spark, sf_dir), COUNT).select("raw_id")


KNOWN_UMIS = ["ACGTAC", "CAGCGG", "GTTACA", "TTGGCC", "AAACCC", "CTCGCA"]
_BARCODE = "regexp_extract(g1, ':([ACGTN]{6})$', 1)"


@query(
    _LINES
    + f""", b AS (SELECT raw_id, {_BARCODE} AS umi FROM judged WHERE reason IS NULL AND {_BARCODE} <> ''), d AS (SELECT raw_id, umi, k, levenshtein(umi, k) AS e FROM b, unnest({KNOWN_UMIS}) AS t(k)),
m AS (SELECT raw_id, umi, min(e) AS least FROM d GROUP BY raw_id, umi), c AS (SELECT m.raw_id, m.umi, least, count(*) AS n, min(k) AS near FROM m JOIN d ON d.raw_id = m.raw_id AND d.e = least GROUP BY ALL)
SELECT raw_id, umi, CASE WHEN n = 1 THEN near ELSE umi END AS corrected, CAST(CASE WHEN n = 1 THEN least ELSE -1 END AS INTEGER) AS edits, n = 1 AND least > 0 AS changed FROM c"""
)
def seq21_snapped_umis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p6_reads(spark, sf_dir).select("raw_id", F.regexp_extract("id", ":([ACGTN]{6})$", 1).alias("umi")).where(F.col("umi") != "")
    return fusion.snap_umis(rows, "umi", KNOWN_UMIS)


# Two copies and periods

_CHECKSUM_FIELDS = ["n_recs", *diff.SUMS]
_BLANK = "'^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$'"
_P3 = f"""WITH b AS (SELECT file_id, regexp_replace(ref_name, {_BLANK}, '', 'g') AS ref_name, CAST(n_recs AS HUGEINT) AS n_recs, {", ".join(f"CAST(TRY_CAST(regexp_replace({c}, {_BLANK}, '', 'g') AS UBIGINT) AS HUGEINT) AS {c}" for c in diff.SUMS)}, computed_at FROM checksum_bam),
p AS (SELECT file_id, regexp_replace(ref_name, {_BLANK}, '', 'g') AS ref_name, CAST(n_recs AS HUGEINT) AS n_recs, {", ".join(f"CASE WHEN {c} < 0 THEN CAST({c} AS HUGEINT) + 18446744073709551616::HUGEINT ELSE CAST({c} AS HUGEINT) END AS {c}" for c in diff.SUMS)}, computed_at FROM checksum_pam),
bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, ref_name ORDER BY computed_at DESC) AS k FROM b) WHERE k = 1),
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, ref_name ORDER BY computed_at DESC) AS k FROM p) WHERE k = 1)
SELECT file_id, ref_name, 'missing_in_pam' AS field_name FROM bl WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.file_id IS NOT DISTINCT FROM bl.file_id AND pl.ref_name IS NOT DISTINCT FROM bl.ref_name)
UNION ALL SELECT file_id, ref_name, 'missing_in_bam' FROM pl WHERE NOT EXISTS (SELECT 1 FROM bl WHERE pl.file_id IS NOT DISTINCT FROM bl.file_id AND pl.ref_name IS NOT DISTINCT FROM bl.ref_name)
""" + "".join(f"UNION ALL SELECT bl.file_id, bl.ref_name, '{c}' FROM bl JOIN pl ON pl.file_id IS NOT DISTINCT FROM bl.file_id AND pl.ref_name IS NOT DISTINCT FROM bl.ref_name WHERE bl.{c} IS DISTINCT FROM pl.{c}\n" for c in _CHECKSUM_FIELDS)


@query(_P3)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.checksum_differences(table(spark, sf_dir, "checksum_bam"), table(spark, sf_dir, "checksum_pam")).select("file_id", "ref_name", "field_name")


_SAME_KEY = "pl.file_id IS NOT DISTINCT FROM bl.file_id AND pl.ref_name IS NOT DISTINCT FROM bl.ref_name"
_P3_VALUES = _P3[: _P3.index("SELECT file_id, ref_name, 'missing_in_pam'")] + f"""SELECT file_id, ref_name, 'missing_in_pam' AS field_name, CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value FROM bl WHERE NOT EXISTS (SELECT 1 FROM pl WHERE {_SAME_KEY})
UNION ALL SELECT file_id, ref_name, 'missing_in_bam', NULL, NULL FROM pl WHERE NOT EXISTS (SELECT 1 FROM bl WHERE {_SAME_KEY})
""" + "".join(f"UNION ALL SELECT bl.file_id, bl.ref_name, '{c}', CAST(bl.{c} AS VARCHAR), CAST(pl.{c} AS VARCHAR) FROM bl JOIN pl ON {_SAME_KEY} WHERE bl.{c} IS DISTINCT FROM pl.{c}\n" for c in _CHECKSUM_FIELDS)


@query(_P3_VALUES)
def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences with both values."""
    return diff.checksum_differences(table(spark, sf_dir, "checksum_bam"), table(spark, sf_dir, "checksum_pam"))


def _flag_rows(df: DataFrame) -> DataFrame:
    return df.select("file_id", "flags", F.when(F.col("mapq") < 30, 0).otherwise(1).alias("well"), F.floor(F.col("read_id") % 7).alias("lane"))


@query()
def p3_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two copies whose key, the file, repeats: reads by flags, quality and lane, one copy without duplicates' bits."""
    rows = reads(spark, sf_dir, ["read_id", "file_id", "flags", "mapq"])
    other = rows.withColumn("flags", F.when(F.col("read_id") % 97 == 0, F.col("flags").bitwiseXOR(F.lit(1024))).otherwise(F.col("flags"))).where(F.col("read_id") % 389 != 0)
    return diff.differences(_flag_rows(rows), _flag_rows(other), ["file_id"], ["flags", "well", "lane"])


@query(
    _GTF
    + """, e AS (SELECT gene_id, chrom, range_start AS a, range_stop AS b FROM gtf WHERE feature = 'exon' AND range_start <= range_stop),
marked AS (SELECT *, max(b) OVER (PARTITION BY gene_id, chrom ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id, chrom ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM marked),
m AS (SELECT gene_id, chrom, min(a) AS range_start, max(b) AS range_stop FROM numbered GROUP BY gene_id, chrom, run)
SELECT gene_id, chrom, 'merged' AS kind, range_start, range_stop FROM m
UNION ALL SELECT gene_id, chrom, 'gap', lo, hi FROM (SELECT gene_id, chrom, range_stop + 1 AS lo, lead(range_start) OVER (PARTITION BY gene_id, chrom ORDER BY range_start) - 1 AS hi FROM m) WHERE hi IS NOT NULL"""
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.exon_periods(table(spark, sf_dir, "gtf_records"))


# Streams


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def str1_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts; the same expression runs on a stream."""
    return streams.tumbling_counts(table(spark, sf_dir, "events", ["ts", "event_type", "value"]), "ts", "event_type", "value").select("event_type", "window_start", "n")


@query(
    """WITH marked AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM numbered GROUP BY user_id, run"""
)
def str5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events", ["ts", "user_id"]), "ts", "user_id")


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR""")
def str1_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts as a stream closes them: windows that end six hours or more before the latest event."""
    counted = streams.replay(spark, f"{sf_dir}/events.parquet", lambda e: streams.tumbling_counts(e, "ts", "event_type", "value", lateness="6 hours").select("event_type", "window_start", "n"))
    return counted


@query(
    """WITH marked AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM numbered GROUP BY user_id, run HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR"""
)
def str5_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a stream closes them: those that end six hours or more before the latest event."""
    return streams.replay(spark, f"{sf_dir}/events.parquet", lambda e: streams.sessions(e, "ts", "user_id", lateness="6 hours"))


@query("SELECT DISTINCT event_id FROM events")
def str6_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once each, by a stream that is replayed to its end and forgets an event after a week."""
    return streams.replay(spark, f"{sf_dir}/events.parquet", lambda e: streams.first_of_each(e, "ts", ["event_id"], "7 days")).select("event_id")
