"""Edit distance of words that read on into what follows."""

import random
from functools import cache

import pytest

from strandline.functions import seq


def by_the_rule(a, b, after_a, after_b):
    """The distance of the words, or that at the corner to which lost letters lead: while the last step there drops a letter of
    one word, the other word's loss is made up by the letter that follows it."""
    x, y = a + after_a, b + after_b

    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        return d(i - 1, j - 1) if x[i - 1] == y[j - 1] else 1 + min(d(i - 1, j - 1), d(i - 1, j), d(i, j - 1))

    i = j = len(a)
    while i and j and x[i - 1] != y[j - 1]:
        more_y, more_x = d(i - 1, j) < d(i, j) and j < len(y), d(i, j - 1) < d(i, j) and i < len(x)
        if not more_x and not more_y:
            break
        i, j = i + more_x, j + more_y
    return min(d(len(a), len(a)), d(i, j))


def test_distances():
    # Fixed value: the published case of a letter lost before the words end.
    assert seq.edit_distance_reading_on("ATCGGT", "ACGGTX", "XYZ", "") == 1
    rng = random.Random(17)

    def letters(n):
        return "".join(rng.choice("ACG") for _ in range(n))

    for _ in range(400):
        n = rng.randint(0, 9)
        a = letters(n)
        whole = list(a + letters(6))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(whole))
            whole[at : at + 1] = rng.choice([[], [rng.choice("ACG")], [whole[at], "T"]])
        b, after_b = "".join(whole[:n]), "".join(whole[n : n + rng.randint(0, 5)])
        if len(b) < n:
            continue
        after_a = letters(rng.randint(0, 5))
        assert seq.edit_distance_reading_on(a, b, after_a, after_b) == by_the_rule(a, b, after_a, after_b)


def test_lengths_must_agree_and_nulls_pass(spark):
    with pytest.raises(ValueError):
        seq.edit_distance_reading_on("A", "AC")
    df = spark.createDataFrame([("ACGGTX", "ATCGGT", "", "XYZ"), (None, "A", "", ""), ("ACGT", "AGGA", "", "")], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(seq.edit_distance_column(*[seq.F.col(x) for x in "abcd"])).collect()] == [1, None, 2]
