"""Samples of reads that keep mates together and come out the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The numbers that a name may hash to.
SPACE = 16**15


def name_number(name: Column) -> Column:
    """A number below SPACE of a read's name."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")


def by_rate(reads: DataFrame, rate: float, name: str = "id") -> DataFrame:
    """About ``rate`` of the names, with all their reads; a rate above 1 is 1, a negative one an error.  Null names are left out."""
    if rate < 0:
        raise ValueError("a rate must not be negative")
    return reads.where(name_number(F.col(name)) < int(min(rate, 1.0) * SPACE))


def to_count(reads: DataFrame, count: int, name: str = "id") -> DataFrame:
    """About ``count`` reads: the rate is exact, of a count of all reads; fewer reads than ``count`` stay whole."""
    if count < 0:
        raise ValueError("a count must not be negative")
    named = reads.where(F.col(name).isNotNull())
    total = named.agg(F.count(F.lit(1)).alias("n")).first()["n"]  # type: ignore[index]
    return named if total <= count else named.where(name_number(F.col(name)) < count * SPACE // total)
