"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import leakage, neardup, quality, shards, splitting, tokenizer, topk
from strandline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.first_blocks(table(spark, sf_dir, "shard_index"), table(spark, sf_dir, "shard_opts"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the oversized entries with its padded range."""
    return shards.pieces(table(spark, sf_dir, "shard_index"), table(spark, sf_dir, "shard_opts"))


def p1_text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in pieces of at most 2,000 characters that share up to 200, by the same hierarchy of separators."""
    return splitting.text_pieces(table(spark, sf_dir, "documents", ["doc_id", "text"]), 2_000, 200)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_reads(neardup.latest_reads(table(spark, sf_dir, "aligned_reads", ["read_id", "seq", "loaded_at"])))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per read: its class of equal sequences and its group of similar ones."""
    return neardup.read_groups(neardup.latest_reads(table(spark, sf_dir, "aligned_reads", ["read_id", "seq", "loaded_at"])))


#: A k-mer is frequent if it has at least one in so many of the counted rows.
P5_ONE_IN = 1000


def _counted_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kmers = table(spark, sf_dir, "kmers", ["forward_kmer", "revcomp_kmer"])
    return kmers.where((F.col("forward_kmer") != -1) & (F.col("revcomp_kmer") != -1)).select(F.least("forward_kmer", "revcomp_kmer").alias("kmer"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.heavy_hitters(_counted_kmers(spark, sf_dir), "kmer", P5_ONE_IN).select(F.col("value").alias("kmer"))


def p5_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent k-mers with their counts."""
    return topk.most_frequent(_counted_kmers(spark, sf_dir), "kmer", 100).select(F.col("value").alias("kmer"), "n")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id", "ids")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text again from its ids; null texts come back empty."""
    return tokenizer.decode(p7_ids(spark, sf_dir)).select("doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "eval_items", ["item_id", "text"]))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "common_words"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each document."""
    return quality.statistics(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "common_words"))


def p9_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics with the calibrated probability that a document is structural junk."""
    return quality.scored_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "common_words"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_text_pieces, p2_found, p2_groups, p5_found, p5_top100, p7_ids, p7_round_trip, p8_found, p9_found, p9_statistics, p9_scored)
}

_P1 = """
WITH RECURSIVE latest AS (SELECT * FROM shard_index WHERE index_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY indexed_at DESC) = 1),
due AS (
  SELECT index_id, CAST(approx_file_bytes AS HUGEINT) AS size, CAST(bytes_per_shard AS HUGEINT) AS cap, coalesce(padding, 0) AS padding, coalesce(split_mapped_coords, false) AS sm, coalesce(split_unmapped_coords, false) AS su, blocks
  FROM latest JOIN shard_opts USING (opts_id) WHERE bytes_per_shard > 0 AND approx_file_bytes > bytes_per_shard
    AND NOT (coalesce(padding, 0) <> 0 AND (coalesce(split_mapped_coords, false) OR coalesce(split_unmapped_coords, false)))),
flat AS (SELECT index_id, unnest(blocks, recursive := true) FROM due),
once AS (SELECT * FROM flat WHERE block_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index_id, block_no) = 1),
b AS (
  SELECT *, coalesce(num_records, 0) AS n, row_number() OVER w AS i, coalesce(sum(coalesce(num_records, 0)) OVER (PARTITION BY index_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    lag(end_ref) OVER w AS pr, lag(end_pos) OVER w AS pp FROM once WINDOW w AS (PARTITION BY index_id ORDER BY block_no)),
totals AS (SELECT index_id, CAST(sum(n) AS HUGEINT) AS total FROM b GROUP BY index_id),
allowed AS (
  SELECT b.*, CASE WHEN start_ref IS DISTINCT FROM pr THEN 1 WHEN start_pos IS DISTINCT FROM pp THEN 2 WHEN CASE WHEN start_ref = -1 THEN su ELSE sm END THEN 3 END AS level FROM b JOIN due USING (index_id) WHERE i > 1),
cuts AS (
  SELECT index_id, CAST(1 AS BIGINT) AS i, CAST(0 AS HUGEINT) AS done FROM b WHERE b.i = 1
  UNION ALL
  SELECT x.index_id, x.i, CAST(b.before AS HUGEINT) FROM (
    SELECT c.index_id, coalesce(max(a.i) FILTER ((a.before - c.done) * size <= cap * total), min(a.i)) AS i
    FROM cuts c JOIN due USING (index_id) JOIN totals USING (index_id) JOIN allowed a ON a.index_id = c.index_id AND a.i > c.i AND a.level IS NOT NULL
    WHERE (total - c.done) * size > cap * total GROUP BY c.index_id, c.i) x JOIN b ON b.index_id = x.index_id AND b.i = x.i)
"""
_P1_FOUND = _P1 + "SELECT index_id, block_no FROM cuts JOIN b USING (index_id, i) WHERE i > 1"
_P1_PIECES = _P1 + """, runs AS (SELECT index_id, i, coalesce(lead(i) OVER w, 1000000000) AS until, CAST(row_number() OVER w - 1 AS INTEGER) AS piece_no FROM cuts WINDOW w AS (PARTITION BY index_id ORDER BY i))
SELECT r.index_id, piece_no, min(b.block_no) AS first_block, max(b.block_no) AS last_block, min(a.level) FILTER (a.i = r.i) AS level, CAST(sum(b.n) AS BIGINT) AS records,
  arg_min(b.start_ref, b.i) AS range_start_ref, greatest(arg_min(b.start_pos, b.i) - min(padding), 0) AS range_start_pos, arg_max(b.end_ref, b.i) AS range_limit_ref, arg_max(b.end_pos, b.i) + min(padding) AS range_limit_pos
FROM runs r JOIN due USING (index_id) JOIN b ON b.index_id = r.index_id AND b.i >= r.i AND b.i < r.until LEFT JOIN allowed a ON a.index_id = b.index_id AND a.i = b.i GROUP BY r.index_id, piece_no
"""

_P2_SHINGLES = """
WITH latest AS (
  SELECT read_id, upper(seq) AS s FROM (SELECT read_id, seq, row_number() OVER (PARTITION BY read_id ORDER BY loaded_at DESC) AS k FROM aligned_reads)
  WHERE k = 1 AND seq IS NOT NULL AND seq <> '*'),
grams AS (
  SELECT DISTINCT read_id, g FROM (SELECT read_id, substr(s, i, 8) AS g FROM (SELECT read_id, s, unnest(range(1, length(s) - 6)) AS i FROM latest))
  WHERE regexp_full_match(g, '[ACGT]{8}')),
sizes AS (SELECT read_id, count(*) AS n FROM grams GROUP BY read_id),
turned AS (SELECT read_id, reverse(translate(g, 'ACGT', 'TGCA')) AS g FROM grams),
shared AS (
  SELECT a.read_id AS x, b.read_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.read_id < b.read_id GROUP BY a.read_id, b.read_id
  UNION ALL
  SELECT a.read_id AS x, b.read_id AS y, count(*) AS c FROM turned a JOIN grams b ON a.g = b.g AND a.read_id < b.read_id GROUP BY a.read_id, b.read_id)
SELECT DISTINCT x AS read_id_a, y AS read_id_b FROM shared JOIN sizes p ON p.read_id = x JOIN sizes q ON q.read_id = y
WHERE 10 * c >= 4 * (p.n + q.n - c)
"""

_P2_GROUPS = f"""
WITH RECURSIVE pairs AS ({_P2_SHINGLES}),
nodes AS (
  SELECT read_id, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS c
  FROM (SELECT read_id, upper(seq) AS s, row_number() OVER (PARTITION BY read_id ORDER BY loaded_at DESC) AS k FROM aligned_reads)
  WHERE k = 1 AND regexp_matches(s, '[ACGT]{{8}}')),
links AS (SELECT read_id_a AS x, read_id_b AS y FROM pairs UNION ALL SELECT read_id_b, read_id_a FROM pairs),
reach AS (SELECT read_id, read_id AS other FROM nodes UNION SELECT r.read_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT read_id, min(n.read_id) OVER (PARTITION BY c) AS class_id, group_id
FROM nodes n JOIN (SELECT read_id, min(other) AS group_id FROM reach GROUP BY read_id) g USING (read_id)
"""

_COUNTED = "SELECT least(forward_kmer, revcomp_kmer) AS kmer FROM kmers WHERE forward_kmer <> -1 AND revcomp_kmer <> -1"

_P8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT least(len(w), 13) AS n FROM e WHERE len(w) > 0),
eg AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM e WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (n, g)
"""

_STATS = r"""
WITH found AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM found),
common AS (SELECT list(DISTINCT word) AS c FROM common_words WHERE word IS NOT NULL),
counted AS (
  SELECT f.doc_id, CAST(len(w) AS INTEGER) AS n_words, length(array_to_string(w, '')) AS letters,
    (SELECT count(*) FROM (SELECT unnest(f.w) AS x) WHERE x IN (SELECT word FROM common_words)) AS common,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(13), '')) AS solid,
    length(regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g')) AS plain,
    len(l) AS lines, len(list_filter(l, lambda x: right(x, 1) IN ('.', '!', '?', ';', ':'))) AS ended
  FROM found f JOIN lines USING (doc_id)),
stats AS (
  SELECT doc_id, n_words,
    CASE WHEN n_words > 0 THEN CAST(letters AS DOUBLE) / n_words ELSE 0.0 END AS mean_word_length,
    CASE WHEN solid > 0 THEN CAST(solid - plain AS DOUBLE) / solid ELSE 0.0 END AS symbol_ratio,
    CASE WHEN lines > 0 THEN CAST(ended AS DOUBLE) / lines ELSE 0.0 END AS punctuated_share,
    CASE WHEN n_words > 0 THEN CAST(common AS DOUBLE) / n_words ELSE 0.0 END AS common_share,
    CASE WHEN n_words > 0 THEN
      CASE WHEN common * 100 < n_words * 15 THEN 1 ELSE 0 END + CASE WHEN (solid - plain) * 5 > solid THEN 1 ELSE 0 END
      + CASE WHEN letters < n_words * 3 OR letters > n_words * 11 THEN 1 ELSE 0 END + CASE WHEN ended * 4 < lines THEN 1 ELSE 0 END
    ELSE 0 END AS signs
  FROM counted)
"""

SQL: dict[str, str] = {
    "p1_found": _P1_FOUND,
    "p1_pieces": _P1_PIECES,
    "p2_found": _P2_SHINGLES,
    "p2_groups": _P2_GROUPS,
    "p5_found": f"WITH c AS ({_COUNTED}) SELECT kmer FROM c GROUP BY kmer HAVING count(*) * {P5_ONE_IN} >= (SELECT count(*) FROM c)",
    "p5_top100": f"SELECT kmer, count(*) AS n FROM ({_COUNTED}) GROUP BY kmer ORDER BY n DESC, kmer LIMIT 100",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": _P8,
    "p9_found": _STATS + "SELECT doc_id FROM stats WHERE n_words > 0 AND signs >= 2",
    "p9_statistics": _STATS + "SELECT doc_id, n_words, mean_word_length, symbol_ratio, punctuated_share, common_share, CAST(signs AS INTEGER) AS signs FROM stats",
}
