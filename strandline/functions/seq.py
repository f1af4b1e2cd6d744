"""Expressions over base sequences and qualities.

All of them are built-in expressions on strings of bases; packed forms are strings of hexadecimal digits, one digit
a base (1 A, 2 C, 4 G, 8 T, 15 any).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.exprs import let

#: The base of each 4-bit code.
NIBBLE_BASES = "=ACMGRSVTWYHKDBN"
_HEX = "0123456789ABCDEF"
#: The code of the complement of each 4-bit code (its bits in reverse).
_HEX_COMPLEMENT = "084C2A6E195D3B7F"


def clean(seq: Column) -> Column:
    """Capital A, C, G, T; everything else N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def clean_keep_case(seq: Column) -> Column:
    return F.regexp_replace(seq, "[^ACGTacgt]", "N")


def has_other_than_acgt(seq: Column) -> Column:
    return seq.rlike("[^ACGT]")


def has_other_than_acgtn(seq: Column) -> Column:
    return seq.rlike("[^ACGTN]")


def reverse_complement(seq: Column) -> Column:
    """Of letters of any case, in capitals; unknown letters become N."""
    return F.reverse(F.translate(clean(seq), "ACGT", "TGCA"))


def pack(seq: Column) -> Column:
    """One hexadecimal digit a base; letters that are no code become F."""
    known = F.regexp_replace(F.upper(seq), f"[^{NIBBLE_BASES}]", "N")
    return F.translate(known, NIBBLE_BASES, _HEX)


def _part(text: Column, start: int, limit: int | None) -> Column:
    """[start, limit) of a text; to its end without a limit."""
    if not start and limit is None:
        return text
    return F.substring(text, F.lit(start + 1), F.length(text) if limit is None else F.lit(max(limit - start, 0)))


def unpack(packed: Column, bases: str = NIBBLE_BASES, start: int = 0, limit: int | None = None) -> Column:
    """Bases of packed digits, or of [start, limit) of them, by any table of 16 letters."""
    return F.translate(F.upper(_part(packed, start, limit)), _HEX, bases)


def reverse_complement_packed(packed: Column) -> Column:
    return F.reverse(F.translate(F.upper(packed), _HEX, _HEX_COMPLEMENT))


def base_codes(seq: Column) -> Column:
    """0 to 3 for A, C, G, T of any case, 4 for other letters, as a string of digits."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGTN", "01234")


def reverse_complement_codes(codes: Column) -> Column:
    """0..3 become 3..0, in reverse."""
    return F.reverse(F.translate(codes, "0123", "3210"))


def count_bases(seq: Column, bases: str, start: int = 0, limit: int | None = None) -> Column:
    """How many letters of ``seq``, or of its part [start, limit), are among ``bases`` (letters, as they stand)."""
    return F.length(F.regexp_replace(_part(seq, start, limit), f"[^{bases}]", ""))


def two_bit_bytes(seq: Column) -> Column:
    """Four bases a byte, A 0, C 1, G 2, T 3 (others 0), the first in the lowest bits, as hexadecimal digits."""
    codes = F.translate(base_codes(seq), "4", "0")
    groups = F.regexp_extract_all(codes, F.lit("[0-3]{1,4}"), F.lit(0))

    def byte(g: Column) -> Column:
        digits = F.split(F.reverse(g), "", -1)
        return F.lpad(F.hex(F.aggregate(digits, F.lit(0).cast("bigint"), lambda v, d: v * 4 + d.cast("bigint"))), 2, "0")

    return F.array_join(F.transform(groups, byte), "")


def fastq_body(packed: Column, length: Column, bases: str, quals: str) -> Column:
    """`bases`, `+` and `qualities` on three lines, of a nibble a base that stands for both; the low nibble of a byte is first."""
    pairs = F.regexp_replace(F.upper(packed), "(.)(.)", "$2$1")
    digits = F.substring(pairs, F.lit(1), length)
    return F.concat_ws("\n", F.translate(digits, _HEX, bases), F.lit("+"), F.translate(digits, _HEX, quals))


def checked_umi(umi: Column, known: bool = False) -> Column:
    """The UMI; letters other than A, C, G, T (and N, if it isn't of a known list) are an error."""
    letters = "ACGT" if known else "ACGTN"
    return F.when(umi.rlike(f"[^{letters}]"), F.raise_error(F.concat(F.lit("not a UMI: "), umi)).cast("string")).otherwise(umi)


def words_over(spark: SparkSession, k: int, alphabet: str = "ACGTN") -> DataFrame:
    """(word): every word of k letters of the alphabet, in order."""
    n = len(alphabet)
    places = [F.substring(F.lit(alphabet), ((F.floor(F.col("id") / n ** (k - 1 - i)) % n) + 1).cast("int"), F.lit(1)) for i in range(k)]
    return spark.range(n**k).select(F.concat(*places).alias("word"))


def composition(seq: Column) -> Column:
    """Struct of the number of A, C, G, T of any case, and of all other letters (n)."""

    def of(upper: Column) -> Column:
        counts = [count_bases(upper, b) for b in "ACGT"]
        return F.struct(*[c.alias(b.lower()) for b, c in zip("ACGT", counts, strict=True)], (F.length(upper) - counts[0] - counts[1] - counts[2] - counts[3]).alias("n"))

    return let(F.upper(seq), of)


def is_low_complexity(seq: Column, fraction: float = 0.9) -> Column:
    """Whether the two most frequent of A, C, G, T and others make up more than ``fraction``; true for no bases."""

    def of(c: Column) -> Column:
        most = F.sort_array(F.array(*[c[b] for b in ("a", "c", "g", "t", "n")]), asc=False)
        return (F.get(most, F.lit(0)) + F.get(most, F.lit(1))) > F.length(seq) * F.lit(fraction)

    return F.when(F.length(seq) == 0, True).otherwise(let(composition(seq), of))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two strings of one length; null if the lengths differ."""
    unequal = F.zip_with(F.split(a, "", -1), F.split(b, "", -1), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(F.aggregate(unequal, F.lit(0), lambda s, x: s + x)))


#: The distance of fragments whose lengths differ.
FAR = 1_000_000


def fragment_hamming(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.coalesce(hamming(a1, b1) + hamming(a2, b2), F.lit(FAR))


def kmer_code(kmer: Column) -> Column:
    """2 bits a base, A 0 C 1 G 2 T 3, the first base highest, as a bigint; null with any other letter."""
    codes = F.split(base_codes(kmer), "", -1)
    value = F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, c: s * 4 + c.cast("bigint"))
    return F.when(kmer.rlike("^[ACGTacgt]{1,31}$"), value)


def kmers(seq: Column, k: int) -> Column:
    """Every k letters A, C, G, T in a row: structs (pos, forward, revcomp); places with other letters are left out."""
    starts = F.when(F.length(seq) >= k, F.sequence(F.lit(0), F.length(seq) - k)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        here = F.substring(seq, i + 1, F.lit(k))
        return F.struct(i.alias("pos"), kmer_code(here).alias("forward"), kmer_code(reverse_complement(here)).alias("revcomp"))

    return F.filter(F.transform(starts, at), lambda x: x["forward"].isNotNull() & F.substring(seq, x["pos"] + 1, F.lit(k)).rlike("^[ACGTacgt]+$"))


def canonical(forward: Column, revcomp: Column) -> Column:
    return F.least(forward, revcomp)


def umi_of_name(name: Column) -> Column:
    """The part after the last `:` before the first space if it is of A, C, G, T, N and `+`; else null."""
    last = F.element_at(F.split(F.element_at(F.split(name, " ", 2), 1), ":", -1), -1)
    return F.when(last.rlike("^[ACGTN+]+$"), last)


def add_umi(name: Column, umi1: Column, umi2: Column) -> Column:
    """`:umi1+umi2` before the first space of the name."""
    return F.regexp_replace(name, "^([^ ]*)", F.concat(F.lit("$1:"), umi1, F.lit("+"), umi2))


def chrom_number(name: Column) -> Column:
    """1 to 22, X 23, Y 24, M 25, after a prefix of three letters; null for anything else."""
    rest = F.substring(name, 4, 100)
    return F.when(rest == "X", 23).when(rest == "Y", 24).when(rest == "M", 25).when(rest.rlike("^([1-9]|1[0-9]|2[0-2])$"), rest.try_cast("int"))


def combined_quality(q1: Column, q2: Column, most: int = 95) -> Column:
    """The quality of two agreeing bases: the error e1 e2 / ((1 - e1)(1 - e2) + e1 e2), rounded, at most ``most``."""
    e1, e2 = F.pow(F.lit(10.0), -q1 / 10.0), F.pow(F.lit(10.0), -q2 / 10.0)
    both = e1 * e2
    return F.least(F.round(-10.0 * F.log10(both / ((1 - e1) * (1 - e2) + both))).cast("int"), F.lit(most))


def clip_qualities(qual: Column, n: int, value: int = 2) -> Column:
    """The first and last n qualities become ``value``; all of them if 2 n reaches the length."""
    return F.transform(qual, lambda q, i: F.when((i < n) | (i >= F.size(qual) - n), value).otherwise(q))


def trim(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def edit_distance_reading_on(a: str, b: str, after_a: str = "", after_b: str = "") -> int:
    """The edit distance of two words of one length, cut from longer sequences.

    A word that lost letters is filled up with those that follow it.  So while the last step to the corner drops a
    letter of one word, the other is read on by one of the letters that follow; the smaller of the distances at the
    first and the last corner counts.
    """
    if len(a) != len(b):
        raise ValueError("words of one length are needed")
    x, y = a + after_a, b + after_b
    row = list(range(len(y) + 1))
    table = [row]
    for i, p in enumerate(x, 1):
        last, row = row, [i]
        for j, q in enumerate(y, 1):
            row.append(last[j - 1] if p == q else 1 + min(last[j - 1], last[j], row[j - 1]))
        table.append(row)
    i = j = len(a)
    while i and j and x[i - 1] != y[j - 1]:
        here = table[i][j] - 1
        longer_y, longer_x = table[i - 1][j] == here and j < len(y), table[i][j - 1] == here and i < len(x)
        if not (longer_x or longer_y):
            break
        i, j = i + longer_x, j + longer_y
    return min(table[len(a)][len(b)], table[i][j])


def edit_distance_column(a: Column, b: Column, after_a: Column, after_b: Column) -> Column:
    """``edit_distance_reading_on`` of four columns; null if any is null.  Where nothing follows the words it is the built-in
    distance; only the other rows are worked on, in Arrow batches."""

    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series, after_a: pd.Series, after_b: pd.Series) -> pd.Series:
        rows = zip(a, b, after_a, after_b, strict=True)
        return pd.Series([None if None in r else edit_distance_reading_on(*r) for r in rows], dtype="Int32")

    alone = (after_a == "") & (after_b == "") & (F.length(a) == F.length(b))
    return F.when(alone, F.levenshtein(a, b)).otherwise(of(F.when(~alone, a), b, after_a, after_b))
