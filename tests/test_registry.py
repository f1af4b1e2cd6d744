"""The registry: names, and a few core queries against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from strandline.plans import core

SF = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(core.SQL) <= set(core.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p3_found", "p4_found", "p6_found"} <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ["agg1_flagstat", "agg2_checksum", "flt1_filter", "join3_distant_mates", "join8_gene_before", "int2_complement", "fus7_top_genes", "p3_found", "p4_found", "p6_reads", "seq21_snapped_umis"])
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    named = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {named} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
