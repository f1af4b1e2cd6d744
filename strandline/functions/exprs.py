"""Helpers for expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once and stood in the plan a single time, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
