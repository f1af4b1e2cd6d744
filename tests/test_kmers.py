"""Rolled k-mers against the expression and a plain loop."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.operators import kmers


@pytest.mark.parametrize("k", [1, 5, 31])
def test_rolled_kmers(spark, k):
    texts = ["AAAGTTCAGGT", "acgtNACGTAC", "", None, "AC", "ACGT" * 12, "é" + "ACGTA" * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").selectExpr("*", "1 as pos", "2 as forward")
    got = sorted(tuple(r) for r in kmers.exploded_kmers(df, "id", "s", k).where("id <> 6").collect())
    want = sorted((r[0], *r[1]) for r in df.where("id <> 6").select("id", F.explode(seq.kmers(F.col("s"), k))).collect())
    assert got == want


def test_no_rows_and_bad_k(spark):
    none = spark.createDataFrame([], "id int, s string")
    assert kmers.exploded_kmers(none, "id", "s", 5).count() == 0
    with pytest.raises(ValueError):
        kmers.exploded_kmers(none, "id", "s", 32)
