"""Continuous periods and gaps against sets of units."""

import random

import pytest

from strandline.operators import intervals, periods


def plain(rows):
    units: dict = {}
    for key, a, b in rows:
        if a is not None and b is not None and a <= b:
            units.setdefault(key, set()).update(range(a, b + 1))
    out = set()
    for key, found in units.items():
        runs, last = [], None
        for x in sorted(found):
            if last is None or x > last + 1:
                runs.append([x, x])
            runs[-1][1] = last = x
        out |= {(key, "merged", *r) for r in runs} | {(key, "gap", p[1] + 1, q[0] - 1) for p, q in zip(runs, runs[1:], strict=False)}
    return out


@pytest.mark.parametrize("shard", [4, 7, 1 << 16])
def test_against_sets(spark, shard):
    rng = random.Random(shard)
    rows = [(rng.choice(["a", "b", None]), s := rng.randint(-60, 60), s + rng.choice([0, 1, 2, 9, 30, -1])) for _ in range(60)]
    rows += [("c", None, 3), ("c", 3, None), ("hot", 0, 0)] + [("hot", i, i) for i in range(0, 40, 2)] * 3
    df = spark.createDataFrame(rows, "k string, s int, e int").selectExpr("*", "1 as shard", "2 as a", "3 as runs")
    got = [tuple(r) for r in periods.merged_and_gaps(df, ["k"], "s", "e", shard=shard).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows)


def test_no_rows_and_types(spark):
    df = spark.createDataFrame([], "k string, s int, e int")
    out = periods.merged_and_gaps(df, ["k"], "s", "e")
    assert out.count() == 0 and dict(out.dtypes)["s"] == "int"


def regions(spark, rows):
    return spark.createDataFrame(rows, "ref string, start int, limit int")


def test_interval_algebra(spark):
    df = regions(spark, [("x", 5, 9), ("x", 9, 12), ("x", 20, 20), ("x", 30, 31), ("y", 0, 2), ("x", None, 4)])
    assert sorted(tuple(r) for r in intervals.union(df).collect()) == [("x", 5, 12), ("x", 30, 31), ("y", 0, 2)]
    assert sorted(tuple(r) for r in intervals.complement(df, 0, 40).collect()) == [("x", 0, 5), ("x", 12, 30), ("x", 31, 40), ("y", 2, 40)]
    assert sorted(tuple(r) for r in intervals.subset(df, "x", 8, 31).collect()) == [("x", 8, 12), ("x", 30, 31)]
    assert sorted(r.pos for r in intervals.positions(df).where("ref = 'x'").collect()) == [*range(5, 12), 30]


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(1)
    a = [("x" if rng.random() < 0.8 else "y", s := rng.randint(0, 300), s + rng.randint(0, 60)) for _ in range(40)]
    b = [("x" if rng.random() < 0.8 else "y", s := rng.randint(0, 300), s + rng.randint(0, 60)) for _ in range(40)]
    got = sorted((r.ref, r.start, r.limit, r.r_start, r.r_limit) for r in intervals.overlap_join(regions(spark, a), regions(spark, b), width=16).collect())
    assert got == sorted((p[0], *p[1:], *q[1:]) for p in a for q in b if p[0] == q[0] and p[1] < q[2] and q[1] < p[2] and p[1] < p[2] and q[1] < q[2])


def test_floor_lookup(spark):
    left = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", 9, "c"), ("z", 5, "d")], "k string, at int, name string")
    right = spark.createDataFrame([("k", 5, 50), ("k", 5, 51), ("k", 2, 20)], "k string, at int, v int")
    assert sorted((r.name, r.v) for r in intervals.floor_lookup(left, right, ["k"], "at", "at", "v").collect()) == [("a", None), ("b", 51), ("c", 51), ("d", None)]
