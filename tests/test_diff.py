"""Differences of two copies: pairing, multiplicities, nulls, skew."""

import itertools
import random

import numpy as np
import pytest

from strandline.operators import diff

SCHEMA = "k string, a string, b string, c string"


def found(spark, left, right, **options):
    rows = diff.differences(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], ["a", "b", "c"], **options).collect()
    return sorted((str(r.k), r.kind, r.field_name or "", r.n) for r in rows)


def test_missing_differing_and_equal_rows(spark):
    left = [("1", "x", "y", "z"), ("2", "x", "y", None), ("3", "x", "y", "z"), (None, "n", None, None)]
    right = [("1", "x", "y", "z"), ("2", "x", "q", "z"), ("4", "x", "y", "z"), (None, "n", None, "w")]
    assert found(spark, left, right) == [("2", "differs", "b", 1), ("2", "differs", "c", 1), ("3", "missing_right", "", 1), ("4", "missing_left", "", 1), ("None", "differs", "c", 1)]


def test_identical_rows_cancel_by_multiplicity(spark):
    row = ("1", "x", "y", "z")
    assert found(spark, [row] * 5, [row] * 3) == [("1", "missing_right", "", 2)]
    assert found(spark, [row] * 2, [row] * 2) == []


def test_leftovers_pair_at_least_cost(spark):
    left = [("1", "p", "p", "p"), ("1", "q", "q", "q")]
    right = [("1", "q", "q", "w"), ("1", "p", "v", "p")]
    assert found(spark, left, right) == [("1", "differs", "b", 1), ("1", "differs", "c", 1)]


def test_large_groups_lose_no_row(spark):
    left = [("1", f"a{i}", f"b{i}", "x") for i in range(30)] + [("2", "s", "s", "s")]
    right = [("1", f"a{i}", f"b{i}", "y") for i in range(30)] + [("1", "new", "new", "new")]
    assert found(spark, left, right, most=4) == [("1", "differs", "c", 1)] * 30 + [("1", "missing_left", "", 1), ("2", "missing_right", "", 1)]


def test_large_keys_are_paired_at_least_cost(spark):
    rng = random.Random(3)
    draw = lambda n: [("1", *(rng.choice("pqrstu") for _ in range(3))) for _ in range(n)]
    left, right = draw(220), draw(200)
    dense = found(spark, left, right, most=1000)
    cost = lambda rows: sum(n for _, kind, _, n in rows if kind == "differs")
    gone = lambda rows: sum(n for _, kind, _, n in rows if kind == "missing_right") - sum(n for _, kind, _, n in rows if kind == "missing_left")
    flowing = found(spark, left, right, most=4)
    assert (cost(flowing), gone(flowing)) == (cost(dense), 20)
    assert not [x for x in flowing if x[1] == "missing_left"]


@pytest.mark.parametrize("seed", range(20))
def test_flows_are_optimal(seed):
    rng = np.random.default_rng(seed)
    x, y = (np.unique(rng.integers(-1, 4, (int(rng.integers(1, 40)), 4)), axis=0) for _ in range(2))
    nx, ny = (rng.integers(1, 4, len(t)) for t in (x, y))
    pairs = diff.assign_copies(x, nx, y, ny)
    one, two = (np.bincount([p[s] for p in pairs], [p[2] for p in pairs], len(t)) for s, t in ((0, x), (1, y)))
    assert (one <= nx).all() and (two <= ny).all() and sum(p[2] for p in pairs) == min(nx.sum(), ny.sum())
    a, b = np.repeat(x, nx, axis=0), np.repeat(y, ny, axis=0)
    if len(a) > len(b):
        a, b = b, a
    cost = (a[:, None] != b[None]).sum(axis=2).astype(float)
    assert sum(n * int((x[i] != y[j]).sum()) for i, j, n in pairs) == cost[range(len(a)), diff.assign(cost)].sum()


def test_clashing_names_and_empty_tables(spark):
    left = spark.createDataFrame([("1", "x", 1)], "k string, a string, net int").selectExpr("*", "0 as side", "'e' as row")
    right = spark.createDataFrame([("1", "z", 9)], "k string, a string, kind int")
    assert [(r.k, r.field_name, r.left_value, r.right_value) for r in diff.differences(left, right, ["k"], ["a"]).collect()] == [("1", "a", "x", "z")]
    assert found(spark, [], []) == []


@pytest.mark.parametrize("seed", range(20))
def test_assignment_is_optimal(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 5), rng.randint(5, 6)
    cost = np.array([[rng.randint(0, 7) for _ in range(m)] for _ in range(n)], dtype=float)
    to = diff.assign(cost)
    assert len(set(to)) == n
    assert cost[range(n), to].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_unsigned_numbers(spark):
    texts = [" 18446744073709551615", "0xffffffffffffffff ", "18446744073709551616", "0x", "", None, "12a", "0x10", " 7"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(diff.unsigned_text(diff.F.col("t"))).collect()
    assert [None if r[0] is None else int(r[0]) for r in rows] == [2**64 - 1, 2**64 - 1, None, None, None, None, None, 16, 7]
    assert int(spark.sql("select -1L as x").select(diff.unsigned_bits(diff.F.col("x"))).first()[0]) == 2**64 - 1
