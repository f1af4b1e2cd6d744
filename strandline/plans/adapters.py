"""The library's data model over the given tables: reads, references, regions, genes and sequences.

``aligned_reads`` and ``gtf_records`` hold real records.  Reference numbers follow the order of the names in
REFERENCES, unmapped reads have number -1 and sort last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import align
from strandline.session import table

#: The references in their order; a fixed list.
REFERENCES = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY", "chrM"]
#: Bases of every reference in the planning queries.
REFERENCE_LENGTH = 250_000_000


def ref_number(name: Column) -> Column:
    """The number of a reference name, -1 for `*`, null and unknown names."""
    at = F.array_position(F.array(*[F.lit(r) for r in REFERENCES]), name) - 1
    return F.coalesce(at, F.lit(-1)).cast("int")


#: The same in SQL.
def ref_number_sql(column: str) -> str:
    names = ", ".join(f"'{r}'" for r in REFERENCES)
    return f"CAST(coalesce(list_position([{names}], {column}), 0) - 1 AS INTEGER)"


READS_SQL = f"""
SELECT read_id, file_id, shard_no, read_name, flags, ref_name, {ref_number_sql('ref_name')} AS ref_id, pos, mapq, cigar,
  mate_ref_name, {ref_number_sql('mate_ref_name')} AS mate_ref_id, mate_pos, seq, qual
FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY loaded_at DESC) AS row_no FROM aligned_reads) WHERE row_no = 1
"""

READ_COLUMNS = ["read_id", "file_id", "shard_no", "read_name", "flags", "ref_name", "pos", "mapq", "cigar", "mate_ref_name", "mate_pos", "seq", "qual"]


def reads(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The latest row of each read, with only the columns asked for; ref_id and mate_ref_id are derived."""
    from strandline.session import latest_rows

    want = columns or [*READ_COLUMNS, "ref_id", "mate_ref_id"]
    base = {c for c in want if c in READ_COLUMNS} | ({"ref_name"} if "ref_id" in want else set()) | ({"mate_ref_name"} if "mate_ref_id" in want else set())
    rows = latest_rows(table(spark, sf_dir, "aligned_reads", [c for c in READ_COLUMNS if c in base or c == "read_id"] + ["loaded_at"]), ["read_id"], "loaded_at")
    derived = {"ref_id": ref_number(F.col("ref_name")), "mate_ref_id": ref_number(F.col("mate_ref_name"))} if base else {}
    return rows.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in want])


GTF_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) AS row_no FROM gtf_records) WHERE row_no = 1"

GTF_COLUMNS = ["record_id", "chrom", "feature", "range_start", "range_stop", "strand", "gene_id", "transcript_id", "gene_type"]


def gtf(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The latest row of each annotation record."""
    from strandline.session import latest_rows

    want = columns or GTF_COLUMNS
    return latest_rows(table(spark, sf_dir, "gtf_records", [c for c in GTF_COLUMNS if c in want or c == "record_id"] + ["loaded_at"]), ["record_id"], "loaded_at").select(*want)


def mapped(df: DataFrame) -> DataFrame:
    return df.where((F.col("ref_id") >= 0) & ~align.has_flag(F.col("flags"), align.UNMAPPED))
