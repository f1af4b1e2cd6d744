"""Near-duplicate reads and frequent values against plain versions."""

import random
from collections import Counter

import pytest

from strandline.llm import neardup, topk

TURN = str.maketrans("ACGT", "TGCA")


def grams(s):
    return {s[i : i + 8] for i in range(len(s) - 7) if set(s[i : i + 8]) <= set("ACGT")}


def plain_pairs(rows, threshold=0.4):
    sets = {i: (grams(s.upper()), {g[::-1].translate(TURN) for g in grams(s.upper())}) for i, s in rows if i is not None and s and grams(s.upper())}
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and any(len(x & sets[b][0]) >= threshold * len(x | sets[b][0]) for x in sets[a])}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    bases = ["".join(rng.choice("ACGT") for _ in range(rng.choice([40, 76, 101]))) for _ in range(60)]
    out = list(bases)
    for b in bases[:40]:
        for _ in range(rng.randint(1, 3)):
            s = list(b)
            for _ in range(rng.randint(0, 4)):
                s[rng.randrange(len(s))] = rng.choice("ACGTN")
            s = "".join(s)
            s = s[rng.randint(0, 3) :]
            out.append(s[::-1].translate(TURN) if rng.random() < 0.5 else s.lower() if rng.random() < 0.3 else s)
    out += [bases[0]] * 30 + ["*", "", "ACGTACG", "N" * 50, None, "A" * 60, "A" * 61, "T" * 60]
    return list(enumerate(out)) + [(None, bases[1])]


def test_pairs_match_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, "read_id bigint, seq string").selectExpr("*", "1 as id", "2 as centre", "'x' as digest")
    found = [tuple(r) for r in neardup.similar_reads(df).collect()]
    assert len(found) == len(set(found))
    want = plain_pairs(rows)
    assert set(found) <= want
    assert len(want - set(found)) <= 0.005 * len(want)


def test_every_member_is_linked_to_its_buckets_centre(spark):
    import pyarrow as pa

    rng = random.Random(11)
    base = "".join(rng.choice("ACGT") for _ in range(100))
    texts = list({base[:i] + "".join(rng.choice("ACGT") for _ in range(3)) + base[i + 3 :] for i in (rng.randrange(97) for _ in range(3000))})
    classes = spark.createDataFrame(list(enumerate(texts)), "id bigint, seq string").repartition(48)
    linked = {}
    for r in neardup.star_edges(classes).collect():
        linked.setdefault(r.a, set()).add(r.b)
        linked.setdefault(r.b, set()).add(r.a)
    buckets = {}
    for row, key in zip(*(x.tolist() for x in neardup.band_keys(pa.array(texts)))):
        buckets.setdefault(key, set()).add(row)
    assert max(map(len, buckets.values())) > 1000
    assert [k for k, ids in buckets.items() if not any(ids - {c} <= linked.get(c, set()) for c in ids)] == []


def test_pairs_of_a_group_in_many_slices(spark):
    rng = random.Random(12)
    base = "".join(rng.choice("ACGT") for _ in range(100))
    texts = set()
    while len(texts) < 600:
        s = list(base)
        for _ in range(5):
            s[rng.randrange(100)] = rng.choice("ACGT")
        texts.add("".join(s))
    rows = list(enumerate(sorted(texts)))
    classes = spark.createDataFrame(rows, "id bigint, seq string").repartition(48)
    found = {(r.a, r.b) for r in neardup.class_pairs(classes).collect()}
    want = plain_pairs(rows)
    assert found <= want and len(want - found) <= 0.005 * len(want)


def test_groups(spark, rows):
    got = {r.read_id: r for r in neardup.read_groups(spark.createDataFrame(rows, "read_id bigint, seq string")).collect()}
    pairs = plain_pairs(rows)
    parent = {i: i for i in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert sum(got[i].group_id == root(i) for i in got) >= 0.99 * len(got)
    assert set(got) == {i for i, s in rows if i is not None and s and grams(s.upper())}


def test_unfinished_groups_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(20)], "a bigint, b bigint")
    assert {(r.id, r.group) for r in neardup.connected(path).collect()} >= {(i, 0) for i in range(1, 21)}
    with pytest.raises(RuntimeError):
        neardup.connected(path, rounds=1)


def test_no_reads(spark):
    none = spark.createDataFrame([], "read_id bigint, seq string")
    assert neardup.similar_reads(none).count() == 0 and neardup.read_groups(none).count() == 0


def test_signature_collisions_estimate_similarity():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    agree, exact = [], []
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(100))
        b = a[: rng.randint(50, 90)] + "".join(rng.choice("ACGT") for _ in range(40))
        table, _some = neardup.signatures(pa.array([a, b]))
        agree.append(float((table[0] == table[1]).mean()))
        x, y = ({min(g, g[::-1].translate(TURN)) for g in grams(s)} for s in (a, b))
        exact.append(len(x & y) / len(x | y))
    assert abs(np.mean(agree) - np.mean(exact)) < 0.04


@pytest.mark.parametrize("k", [1, 3, 50])
def test_most_frequent(spark, k, monkeypatch):
    rng = random.Random(k)
    values = [None] * 5 + [7] * 4000 + [rng.choice([-5, 0, 2**62, -(2**63), rng.randint(0, 300)]) for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(6).selectExpr("v", "v as value", "1 as n")
    count = Counter(v for v in values if v is not None)
    assert [tuple(r) for r in topk.most_frequent(df, "v", k).collect()] == sorted(count.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert {r.value: r.n for r in topk.heavy_hitters(df, "v", 100).collect()} == {v: n for v, n in count.items() if n * 100 >= sum(count.values())}


def test_frequent_of_nothing(spark):
    for rows in ([], [(None,)]):
        df = spark.createDataFrame(rows, "v bigint")
        assert topk.most_frequent(df, "v", 3).count() == 0 and topk.heavy_hitters(df, "v", 3).count() == 0
