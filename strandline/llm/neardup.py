"""Near-duplicate sequences: one-permutation hashing, banded buckets, star-shaped candidate edges, exact checks.

Sequences that are equal (as they are or reverse-complemented) form a class and are worked on once.  A class's
strand-neutral substrings are hashed by one permutation into bins; the least value of each bin is kept, and empty
bins borrow from full ones (optimal densification).  Bands of a few bins name buckets; in a bucket every class is
linked to one centre only, so n members give n - 1 candidates.  Centres differ from band to band, and classes that
are similar to a common centre are candidates too.  Each candidate's similarity is then computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandline.llm.wordgrams import mix
from strandline.session import cut_lineage, latest_rows, shuffle_partitions

#: Letters of a substring; there are 4 ** GRAM of them.
GRAM = 8
#: Least similarity of a pair.
THRESHOLD = 0.4
#: Bins of the signature, bins of a band, number of bands.  Two classes of similarity s agree on a bin with
#: probability s; at 0.4 and 150 bands of 3 bins some 9.6 bands agree.
BINS, ROWS, BANDS = 64, 3, 150
#: Bits of each bin's value that a sketch keeps, and the bins that must agree before a candidate's sequences are fetched.
#: Classes of similarity 0.4 agree in 26 of 64 bins on average (deviation 4), unrelated ones in some 5.
SKETCH_BITS, LEAST_AGREEING = 6, 11
#: Sequences with fewer substrings than this share borrowed bins; their candidates aren't filtered.
LEAST_GRAMS = 64
#: Sequences whose bands are grouped before the shuffle; some 60 MB of arrays.
BATCH = 2048

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _letter in enumerate(b"ACGT"):
    _CODE[_letter] = _i


def gram_codes(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each substring of GRAM letters A, C, G, T: its row, its code, and the code of its reverse complement."""
    offsets = np.frombuffer(seqs.buffers()[1], dtype=np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
    data = np.frombuffer(seqs.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    m = len(data) - GRAM + 1
    if m <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    letters = _CODE[data]
    forward, backward, valid = np.zeros(m, dtype=np.int32), np.zeros(m, dtype=np.int32), np.ones(m, dtype=bool)
    for j in range(GRAM):
        part = letters[j : j + m]
        valid &= part < 4
        forward = forward * 4 + part
        backward |= (3 - (part & 3)).astype(np.int32) << (2 * j)
    row = np.repeat(np.arange(len(seqs)), np.diff(offsets))
    at = np.flatnonzero(valid & (row[:m] == row[GRAM - 1 :]))
    return row[at], forward[at].astype(np.int64), backward[at].astype(np.int64)


@cache
def _permutation() -> np.ndarray:
    """A fixed permutation of all codes."""
    return np.argsort(mix(np.arange(4**GRAM, dtype=np.uint64) + np.uint64(1))).astype(np.int64)


@cache
def _borrow() -> np.ndarray:
    """For each bin the bins that it tries in turn while it is empty: a random function of bin and attempt."""
    tries = np.arange(BINS * 4 * BINS, dtype=np.uint64).reshape(BINS, 4 * BINS)
    return (mix(tries + np.uint64(12345)) % np.uint64(BINS)).astype(np.int64)


@cache
def _bands() -> np.ndarray:
    """The bins of each band, every bin in about as many bands."""
    rng = np.random.Generator(np.random.PCG64(2024))
    out: list[np.ndarray] = []
    while len(out) < BANDS:
        order = rng.permutation(BINS)
        out += [np.sort(order[i : i + ROWS]) for i in range(0, BINS - ROWS + 1, ROWS)]
    return np.array(out[:BANDS])


def signatures(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation signatures (rows x BINS), and which rows have any substring at all."""
    row, forward, backward = gram_codes(seqs)
    value = _permutation()[np.minimum(forward, backward)]
    n = len(seqs)
    empty = 4**GRAM
    flat = np.full(n * BINS, empty, dtype=np.int64)
    np.minimum.at(flat, row * BINS + value % BINS, value // BINS)
    table = flat.reshape(n, BINS)
    full = table < empty
    some = full.any(axis=1)
    out, missing = table.copy(), ~full & some[:, None]
    r, b = np.nonzero(missing)
    attempt = 0
    while len(r):
        if attempt < _borrow().shape[1]:
            source = _borrow()[b, attempt]
        else:  # the same for all rows, so equal rows stay equal
            source = (b + attempt) % BINS
        hit = full[r, source]
        out[r[hit], b[hit]] = table[r[hit], source[hit]]
        r, b = r[~hit], b[~hit]
        attempt += 1
    return out, some


def band_keys(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket key of every band of every row that has a substring."""
    table, some = signatures(seqs)
    rows = np.flatnonzero(some)
    bits = int(np.ceil(np.log2(4**GRAM / BINS)))
    keys = np.zeros((len(rows), BANDS), dtype=np.int64)
    for j in range(ROWS):
        keys = (keys << bits) | table[rows][:, _bands()[:, j]]
    keys |= np.arange(BANDS, dtype=np.int64)[None, :] << (bits * ROWS)
    return np.repeat(rows, BANDS), keys.ravel()


_LINKS = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("others", T.ArrayType(T.LongType()))])


def _rank(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order of a bucket's members: its least is the centre."""
    return mix(key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(ids.view(np.uint64)))


def _bucket_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of each bucket: its key, one member, and the batch's other members of it (null if there are none).

    A bucket that holds a third of all rows thus sends one row a batch to the shuffle, and every member still comes
    with its bucket's key.
    """
    for part in parts:
        ids = part.column(0).to_numpy(zero_copy_only=False)
        row, key = band_keys(part.column(1).cast(pa.string()))
        member = ids[row]
        order = np.lexsort((_rank(key, member), key))
        key, member = key[order], member[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        ends = np.concatenate([[0], np.cumsum(~first)])[np.append(np.flatnonzero(first), len(key))]
        lone = np.append(np.diff(ends) == 0, False)
        others = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=lone), pa.array(member[~first]))
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(member[first]), others], names=["key", "id", "others"])


def _sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for begin in range(0, part.num_rows, BATCH):
            yield part.slice(begin, BATCH)


def star_edges(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: the candidates, each bucket's members linked to its centre.  ``classes`` has (id, seq)."""
    rows = classes.select("id", "seq").mapInArrow(lambda parts: _bucket_rows(_sliced(parts)), _LINKS)
    rows = rows.repartition(shuffle_partitions(classes.sparkSession, 4), "key")
    bucket = W.partitionBy("key").orderBy(F.xxhash64("key", "id"), "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    centred = rows.select("id", "others", F.first("id").over(bucket).alias("centre")).where((F.col("id") != F.col("centre")) | F.col("others").isNotNull())
    members = F.concat(F.array("id"), F.coalesce("others", F.array().cast("array<bigint>")))
    edges = centred.select(F.explode(members).alias("id"), "centre").where(F.col("id") != F.col("centre"))
    return edges.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _similar(threshold: float):
    """Exact similarity of the pairs (a, b, seq_a, seq_b): keeps those that reach the threshold."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            space = np.int64(4**GRAM)
            row_a, code_a, back_a = gram_codes(part.column(2).cast(pa.string()))
            row_b, code_b, _ = gram_codes(part.column(3).cast(pa.string()))
            n = part.num_rows
            set_b = np.unique(row_b * space + code_b)
            size_b = np.bincount(set_b // space, minlength=n)
            best = np.zeros(n)
            for codes in (code_a, back_a):
                set_a = np.unique(row_a * space + codes)
                size_a = np.bincount(set_a // space, minlength=n)
                shared = np.bincount(np.intersect1d(set_a, set_b, assume_unique=True) // space, minlength=n)
                union = size_a + size_b - shared
                best = np.maximum(best, np.where(union > 0, shared / np.maximum(union, 1), 0))
            keep = pa.array(np.flatnonzero(best >= threshold))
            yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(best[best >= threshold])], names=["a", "b", "similarity"])

    return batches


_SKETCH = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(f"s{i}", T.LongType()) for i in range(SKETCH_BITS)])


def _sketches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, s0.., one bit of every bin's value each); null for sequences with few substrings."""
    for part in _sliced(parts):
        seqs = part.column(1).cast(pa.string())
        table, _ = signatures(seqs)
        row, _, _ = gram_codes(seqs)
        few = pa.array(np.bincount(row, minlength=part.num_rows) < LEAST_GRAMS)
        spread = mix(table.astype(np.uint64))
        places = np.arange(BINS, dtype=np.uint64)
        words = [np.bitwise_or.reduce(((spread >> np.uint64(i)) & np.uint64(1)) << places, axis=1).view(np.int64) for i in range(SKETCH_BITS)]
        yield pa.RecordBatch.from_arrays([part.column(0), *[pc.if_else(few, pa.scalar(None, pa.int64()), pa.array(w)) for w in words]], names=[f.name for f in _SKETCH.fields])


def sketches(classes: DataFrame) -> DataFrame:
    """(id, s0..) of every class: some 60 bytes instead of a sequence."""
    return classes.select("id", "seq").mapInArrow(_sketches, _SKETCH)


def likely(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """The candidates (a, b) whose sketches agree in enough bins, or can't tell; only numbers are joined."""

    def side(x: str) -> DataFrame:
        return marks.select(F.col("id").alias(x), *[F.col(f"s{i}").alias(f"{x}{i}") for i in range(SKETCH_BITS)])

    both = edges.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    unequal = F.col("a0").bitwiseXOR(F.col("b0"))
    for i in range(1, SKETCH_BITS):
        unequal = unequal.bitwiseOR(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")))
    return both.where(F.coalesce(F.bit_count(unequal) <= BINS - LEAST_AGREEING, F.lit(True))).select("a", "b")


def verified(edges: DataFrame, classes: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidates that reach the threshold; sequences are fetched for likely ones only."""
    left = classes.select(F.col("id").alias("a"), F.col("seq").alias("seq_a"))
    right = classes.select(F.col("id").alias("b"), F.col("seq").alias("seq_b"))
    pairs = likely(edges, marks).join(left, "a").join(right, "b").select("a", "b", "seq_a", "seq_b")
    return pairs.mapInArrow(_similar(threshold), "a bigint, b bigint, similarity double")


def _reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def members_and_classes(reads: DataFrame, read_id: str = "read_id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(read_id, id) of each read that can be in a pair, and (id, seq) of each class of equal sequences.

    Sequences are upper-cased; one and its reverse complement are equal.  ``id`` is the least read of the class.
    Reads with a null id or sequence, `*`, or no substring of 8 letters A, C, G, T are left out.
    """
    upper = F.upper(F.col(f"`{seq}`"))
    kept = reads.select(F.col(f"`{read_id}`").alias("read_id"), upper.alias("seq")).where(F.col("read_id").isNotNull() & F.col("seq").rlike(f"[ACGT]{{{GRAM}}}"))
    canonical = kept.select("read_id", F.least("seq", _reverse_complement(F.col("seq"))).alias("seq"))
    keyed = cut_lineage(canonical.select("read_id", F.sha2("seq", 256).substr(1, 32).alias("digest"), "seq"))
    groups = keyed.groupBy("digest").agg(F.min("read_id").alias("id"), F.count(F.lit(1)).alias("n"))
    lone = groups.where(F.col("n") == 1).select("id")
    classes = keyed.join(groups.select(F.col("id").alias("read_id")), "read_id", "left_semi").select(F.col("read_id").alias("id"), "seq")
    many = groups.where(F.col("n") > 1).select("digest", "id")
    shared = keyed.select("digest", "read_id").join(many, "digest").select("read_id", "id")
    return lone.select(F.col("id").alias("read_id"), "id").unionAll(shared), classes


def star_pairs(classes: DataFrame, marks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): the classes that are similar to a centre of one of their buckets."""
    return cut_lineage(verified(star_edges(classes), classes, marks, threshold))


def class_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity), a < b: similar classes.  Star edges first, then pairs that share a similar centre.

    The second step is as large as the result that it looks for; groups need the first one only.
    """
    marks = cut_lineage(sketches(classes))
    first = star_pairs(classes, marks, threshold)
    ends = first.select(F.col("a").alias("centre"), F.col("b").alias("id")).unionAll(first.select(F.col("b").alias("centre"), F.col("a").alias("id")))
    other = ends.withColumnRenamed("id", "other")
    hops = ends.join(other, "centre").where(F.col("id") < F.col("other")).select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    rest = hops.join(first, ["a", "b"], "left_anti")
    return first.unionAll(verified(rest, classes, marks, threshold))


def similar_reads(reads: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(read_id_a, read_id_b), a < b: reads of similarity ``threshold`` or more, each pair once.

    ``reads`` has one row per read.  Copies of one sequence are pairs as well.
    """
    members, classes = members_and_classes(reads)
    members, classes = cut_lineage(members), cut_lineage(classes)
    pairs = class_pairs(classes, threshold)
    mine, yours = members.select(F.col("read_id").alias("x"), F.col("id").alias("a")), members.select(F.col("read_id").alias("y"), F.col("id").alias("b"))
    across = pairs.join(mine, "a").join(yours, "b").select("x", "y")
    within = mine.join(yours.withColumnRenamed("b", "a"), "a").where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionAll(within).select(F.least("x", "y").alias("read_id_a"), F.greatest("x", "y").alias("read_id_b"))


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, group): the least id that each id of the edges (a, b) is connected with.

    Alternates linking of larger neighbours and of all neighbours to the least one; every round is checkpointed.
    Groups that still change in the last round are an error.
    """
    now = cut_lineage(edges.select("a", "b").distinct())
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b"), F.col("m")).where(F.col("b") != F.col("m"))
        star = large.unionAll(least.where(F.col("a") != F.col("m")).select(F.col("a").alias("b"), "m")).distinct()
        small = star.groupBy("b").agg(F.min("m").alias("least"))
        again = star.join(small, "b").where(F.col("m") != F.col("least")).select(F.col("m").alias("b"), "least").unionAll(small.select("b", "least"))
        after = cut_lineage(again.select(F.col("least").alias("a"), "b").where(F.col("a") != F.col("b")).distinct())
        if after.count() == now.count() and after.exceptAll(now).isEmpty():
            break
        now = after
    else:
        raise RuntimeError(f"groups still changed after {rounds} rounds")
    return now.groupBy("b").agg(F.min("a").alias("group")).withColumnRenamed("b", "id")


def read_groups(reads: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(read_id, class_id, group_id): one row per read that can be in a pair.

    class_id is the least read with the same sequence, group_id the least read that similar pairs connect it with.
    Two classes that are similar to one centre are connected through it, so star edges are enough: at most one edge
    for each member of a bucket, whatever the size of a group.
    """
    members, classes = members_and_classes(reads)
    members, classes = cut_lineage(members), cut_lineage(classes)
    groups = connected(star_pairs(classes, cut_lineage(sketches(classes)), threshold))
    return members.join(groups, "id", "left").select("read_id", F.col("id").alias("class_id"), F.coalesce("group", "id").alias("group_id"))


def latest_reads(aligned_reads: DataFrame) -> DataFrame:
    """(read_id, seq) of the latest row of each read."""
    return latest_rows(aligned_reads.select("read_id", "seq", "loaded_at"), ["read_id"], "loaded_at").select("read_id", "seq")
