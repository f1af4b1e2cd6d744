"""Calls of gene fusions: the joint span of two genes on a fragment, the choice among pairs, filters and outputs.

A fragment's few longest genes meet in one row; which pairs are looked at, and which call wins, is decided per row in
Arrow batches, for fragments with two genes or more only.  Filters are joins and aggregations over calls.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandline.operators import fusion
from strandline.operators.fusion import R2_OFFSET
from strandline.session import shuffle_partitions


@dataclass(frozen=True)
class FusionOptions:
    """Fixed defaults: bases of a k-mer, of a gap, of homology and of a span; bounds of genes, partners and support."""

    kmer: int = 19
    most_gap: int = 9
    most_homology: int = 15
    least_span: int = 25
    low_complexity: float = 0.9
    most_genes: int = 5
    distance: int = 100_000
    places: int = 5
    most_partners: int = 5
    least_support: int = 2


#: Percent of a read that one gene must cover, and of a fragment that two must, or may if both are well seen.
READ_SHARE, WHOLE_SHARE, LOOSE_SHARE, WELL_SEEN = 50, 90, 80, 30


class Span(NamedTuple):
    """A stretch [start, limit) of a fragment; positions of the second read begin at R2_OFFSET."""

    start: int
    limit: int

    @property
    def size(self) -> int:
        return self.limit - self.start


class Gene(NamedTuple):
    """A gene's ranges on a fragment, in order, and the bases they cover of each read."""

    gene: object
    span1: int
    span2: int
    ranges: list[Span]

    @property
    def span(self) -> int:
        return self.span1 + self.span2


class Joint(NamedTuple):
    """Two genes' parts of a fragment: the one that comes first and the one that follows; ``straight`` if the first gene does."""

    joint: int
    first: int
    second: int
    head: Span
    tail: Span
    straight: bool


def _sums(ranges: Sequence[Span]) -> list[int]:
    """Bases before each range, and of all."""
    out = [0]
    for r in ranges:
        out.append(out[-1] + r.size)
    return out


def joint_span(one: Sequence[Span], two: Sequence[Span], options: FusionOptions) -> Joint | None:
    """The longest stretch that a part of one gene followed by a part of the other covers; None for homologous genes.

    Ranges meet in the order of their ends: each with the first of the other gene's that doesn't end before it.  The
    pair covers what its gene has up to the range, and what the other has from its partner on.  If a gene alone covers
    more than any pair, the second part is 0.
    """
    sides, sums = (one, two), (_sums(one), _sums(two))
    ends = [[r.limit for r in s] for s in sides]
    best: Joint | None = None
    shared = 0
    for _, side, i in sorted((r.limit, s, i) for s in (0, 1) for i, r in enumerate(sides[s])):
        if shared >= options.most_homology:
            break
        x, theirs = sides[side][i], sides[1 - side]
        # At equal ends the first gene's range counts as the one that ends before.
        j = (bisect_right if side else bisect_left)(ends[1 - side], x.limit)
        if j == len(theirs):
            break
        y = theirs[j]
        mine, rest = sums[side][i + 1], sums[1 - side][-1] - sums[1 - side][j]
        if x.limit < y.start:
            if not (x.start < R2_OFFSET <= y.start) and y.start - x.limit + 1 > options.most_gap:
                continue
            joint, first, until, since = mine + rest, mine, x.limit, y.start
        elif x.start > y.start:  # within the partner: no place for a junction
            shared += x.size
            continue
        else:
            shared += x.limit - y.start
            joint = mine - x.size + y.limit - x.start + rest - y.size
            whole = mine > rest or (mine == rest and side == 0)  # the longer part keeps what both cover
            first = mine if whole else joint - rest
            until = since = x.limit if whole else y.start
        if best is None or joint > best.joint:
            best = Joint(joint, first, joint - first, Span(sides[side][0].start, until), Span(since, theirs[-1].limit), side == 0)
    reached = best.joint if best else 0
    for s in (0, 1):
        if sums[s][-1] > reached:
            return Joint(sums[s][-1], sums[s][-1], 0, Span(sides[s][0].start, ends[s][-1]), Span(0, 0), True)
    return None if shared >= options.most_homology else best


def calls_of(genes: Sequence[Gene], length1: int, length2: int, options: FusionOptions, listed: set | None = None) -> list[tuple[Gene, Gene, Joint]]:
    """The calls of a fragment: the pairs whose joint span is the longest, if all of them have one structure.

    ``genes`` are ordered by falling span.  With ``listed`` (sets of two genes) a gene is paired with those that
    follow it up to the first with which it isn't listed.  There is no call if a longest pair is covered by one of its
    genes (the other adds fewer bases than the least span), or if longest pairs divide the fragment differently.
    """
    total = length1 + length2
    least = [max(options.kmer, n * READ_SHARE // 100) for n in (length1, length2)]
    found: list[tuple[Gene, Gene, Joint]] = []
    for i, a in enumerate(genes):
        alone = len(genes) > 1 and a.span > total - options.kmer
        if alone or (a.span1 < least[0] and a.span2 < least[1]):
            break
        for b in genes[i + 1 :]:
            share = LOOSE_SHARE if min(a.span, b.span) >= WELL_SEEN else WHOLE_SHARE
            need = total * share // 100
            if a.span + b.span < need or (listed is not None and frozenset((a.gene, b.gene)) not in listed):
                break
            j = joint_span(a.ranges, b.ranges, options)
            if j is not None and j.joint >= need:
                found.append((a, b, j))
    longest = [c for c in found if c[2].joint == max(f[2].joint for f in found)]
    one_sided = any(min(j.first, j.second) == 0 or j.joint - a.span < options.least_span for a, _, j in longest)
    shapes = {(j.first, j.second, *sorted((j.head, j.tail))) for _, _, j in longest}
    return [] if one_sided or len(shapes) > 1 else longest


def fragment_genes(ranges: DataFrame, most_genes: int = 5) -> DataFrame:
    """(fragment, genes): the ``most_genes`` genes of each fragment by falling span, ties by gene, with their ranges.

    ``ranges`` has (fragment, gene, start, limit).  A fragment has few ranges by nature (its bases bound them); the
    genes of one fragment are ranked by a window limit before they are gathered.
    """
    size = F.col("limit") - F.col("start")
    by_gene = ranges.groupBy("fragment", "gene").agg(
        F.sum(F.when(F.col("start") < R2_OFFSET, size).otherwise(0)).alias("span1"),
        F.sum(F.when(F.col("start") >= R2_OFFSET, size).otherwise(0)).alias("span2"),
        F.array_sort(F.collect_list(F.struct("start", "limit"))).alias("ranges"),
    )
    place = F.row_number().over(W.partitionBy("fragment").orderBy(F.desc(F.col("span1") + F.col("span2")), "gene"))
    top = by_gene.withColumn("place", place).where(F.col("place") <= most_genes)
    return top.groupBy("fragment").agg(F.array_sort(F.collect_list(F.struct("place", "gene", "span1", "span2", "ranges"))).alias("genes"))


def _call_schema(fragment: T.DataType, gene: T.DataType) -> T.StructType:
    numbers = [T.StructField(n, T.LongType()) for n in ("span1", "span2", "joint")] + [T.StructField("straight", T.BooleanType())]
    numbers += [T.StructField(n, T.LongType()) for n in ("start1", "limit1", "start2", "limit2")]
    return T.StructType([T.StructField("candidate", fragment), T.StructField("n", T.IntegerType()), T.StructField("gene1", gene), T.StructField("gene2", gene), *numbers])


def _called(options: FusionOptions, names: list[str], schema: pa.Schema):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            for r in part.to_pylist():
                genes = [Gene(g["gene"], g["span1"], g["span2"], [Span(x["start"], x["limit"]) for x in g["ranges"]]) for g in r["genes"]]
                listed = None if r["listed"] is None else {frozenset((p["a"], p["b"])) for p in r["listed"]}
                for n, (a, b, j) in enumerate(calls_of(genes, r["length1"], r["length2"], options, listed)):
                    rows.append((r["fragment"], n, a.gene, b.gene, j.first, j.second, j.joint, j.straight, *j.head, *j.tail))
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=schema)

    return batches


def fusion_calls(fragments: DataFrame, pairs: DataFrame | None = None, options: FusionOptions | None = None) -> DataFrame:
    """(candidate, n, gene1, gene2, span1, span2, joint, straight, start1, limit1, start2, limit2): the calls of fragments.

    ``fragments`` has (fragment, length1, length2, genes) as from ``fragment_genes``; ``pairs`` (gene1, gene2) limits
    the calls to listed pairs, in either order, by a join on the few pairs that each fragment has.  span1 and the
    first range belong to the part that comes first on the fragment, ``straight`` tells whether that is gene1's.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    options = options or FusionOptions()
    kind = fragments.schema["genes"].dataType.elementType["gene"].dataType  # type: ignore[attr-defined]
    schema = _call_schema(fragments.schema["fragment"].dataType, kind)
    several = fragments.where(F.size("genes") > 1).select("fragment", "length1", "length2", "genes")
    if pairs is None:
        rows = several.withColumn("listed", F.lit(None).cast(T.ArrayType(T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))))
    else:
        each = several.select("fragment", F.explode("genes.gene").alias("a"), F.col("genes.gene").alias("__all")).select("fragment", "a", F.explode("__all").alias("b")).where("a < b")
        known = pairs.select(F.least("gene1", "gene2").cast(kind).alias("a"), F.greatest("gene1", "gene2").cast(kind).alias("b")).distinct()
        met = each.join(known, ["a", "b"]).groupBy("fragment").agg(F.collect_set(F.struct("a", "b")).alias("listed"))
        rows = several.join(met, "fragment")
    return rows.mapInArrow(_called(options, schema.names, to_arrow_schema(schema)), schema)


# Filters: rows (candidate, n, gene1, gene2, span1, span2, ...); a candidate is gone when its last row is


def call_groups(calls: DataFrame) -> DataFrame:
    """(candidate, group, good_span): a candidate's gene pairs in the order of its calls, each pair without order."""
    pair = F.concat_ws("/", F.least("gene1", "gene2").cast("string"), F.greatest("gene1", "gene2").cast("string"))
    least = F.least("span1", "span2")
    rows = calls.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("n", pair.alias("pair")))).alias("pairs"), F.min(least).alias("least_span"))
    return rows.select("candidate", F.array_join("pairs.pair", ",").alias("group"), "least_span")


def _unknown(umi: str) -> int:
    return umi.count("N")


def _apart(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else max(len(a), len(b)) + 1_000_000


#: Unequal bases of two UMIs that count as one; share of unequal bases of two copies of a fragment.
UMI_NEAR, COPY_SHARE = 2, 0.05


def _first_copies(umis: bool):
    """Keeps of each group, whose rows arrive together and in order, the candidates that aren't near an earlier kept one."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: str | None = None
        kept: list = []
        for part in parts:
            keep = []
            for i, r in enumerate(part.to_pylist()):
                if r["group"] != group:
                    group, kept = r["group"], []
                if umis:
                    near = [k for k, known in enumerate(kept) if _apart(r["umi"], known) <= UMI_NEAR]
                    for k in near:  # the better known one stands for both from now on
                        kept[k] = min(kept[k], r["umi"], key=_unknown)
                    new = r["umi"]
                else:
                    most = max(1, int((len(r["r1"]) + len(r["r2"])) * COPY_SHARE))
                    near = [k for k, (a, b) in enumerate(kept) if _apart(r["r1"], a) + _apart(r["r2"], b) <= most]
                    new = (r["r1"], r["r2"])
                if not near:
                    kept.append(new)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64()))], names=["candidate"])

    return batches


def without_duplicates(calls: DataFrame, fragments: DataFrame, umis: bool = False) -> DataFrame:
    """Drops candidates that repeat an earlier one (by ``candidate``) of the same gene pairs.

    ``fragments`` has (candidate, umi, r1, r2), one row each.  With UMIs those that differ in at most two bases are one,
    else sequences of equal lengths that differ in at most 5 % of their bases, or one.  The rule depends on the order, so
    a group is read in order by one task, which holds only the representatives; null texts count as empty.
    """
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("umi", "r1", "r2")]
    rows = call_groups(calls).join(fragments.select("candidate", *texts), "candidate").select("candidate", "group", "umi", "r1", "r2")
    ordered = rows.repartition(shuffle_partitions(calls.sparkSession), "group").sortWithinPartitions("group", "candidate")
    first = ordered.mapInArrow(_first_copies(umis), T.StructType([T.StructField("candidate", calls.schema["candidate"].dataType)]))
    return calls.join(first, "candidate", "left_semi")


def well_supported(calls: DataFrame, fragments: DataFrame | None = None, least_span: int = 25, least_support: int = 2) -> DataFrame:
    """Candidates of gene pairs that ``least_support`` candidates span by ``least_span`` bases in every part.

    All candidates of such a group stay, also those with short spans.  With ``fragments`` (candidate, umi) one candidate
    of each UMI stays, the first.  Counts are aggregations; groups meet their candidates by a join.
    """
    rows = call_groups(calls)
    if fragments is not None:
        first = rows.join(fragments.select("candidate", "umi"), "candidate").groupBy("group", "umi").agg(F.min_by(F.struct("candidate", "least_span"), "candidate").alias("c"))
        rows = first.select("group", "c.candidate", "c.least_span")
    enough = rows.groupBy("group").agg(F.count_if(F.col("least_span") >= least_span).alias("support")).where(F.col("support") >= least_support)
    kept = rows.join(enough, "group", "left_semi").select("candidate")
    return calls.join(kept, "candidate", "left_semi")


def filtered(calls: DataFrame, fragments: DataFrame, genes: DataFrame, options: FusionOptions | None = None, umis: bool = False) -> DataFrame:
    """All filters in their order: low complexity, neighbours, duplicates, support, abundant partners.

    ``fragments`` has (candidate, umi, r1, r2), ``genes`` (gene, chrom, start, limit, place).
    """
    o = options or FusionOptions()
    names = calls.columns
    linked = fusion.without_low_complexity(calls.join(fragments.select("candidate", "r1", "r2"), "candidate"), o.low_complexity).select(*names)
    apart = fusion.without_neighbours(linked, genes, o.distance, o.places)
    single = without_duplicates(apart, fragments, umis)
    seen = well_supported(single, fragments if umis else None, o.least_span, o.least_support)
    return fusion.without_promiscuous(seen, o.most_partners)


# Names and outputs


def named(calls: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: both genes, in the order in which ``pairs`` (gene1, gene2) lists them, without pairs by name.

    A call whose genes are listed in neither order is an error.
    """
    if pairs is None:
        return calls.withColumn("name", F.concat_ws("/", F.least("gene1", "gene2").cast("string"), F.greatest("gene1", "gene2").cast("string")))
    listed = pairs.select("gene1", "gene2").distinct()
    turned = listed.select(F.col("gene1").alias("gene2"), F.col("gene2").alias("gene1"), F.lit(True).alias("__turned"))
    both = calls.join(listed.withColumn("__straight", F.lit(True)), ["gene1", "gene2"], "left").join(turned, ["gene1", "gene2"], "left")
    one, two = F.col("gene1").cast("string"), F.col("gene2").cast("string")
    name = F.when(F.col("__straight"), F.concat_ws("/", one, two)).when(F.col("__turned"), F.concat_ws("/", two, one))
    error = F.raise_error(F.concat(F.lit("not a listed pair: "), one, F.lit(", "), two))
    return both.withColumn("name", F.coalesce(name, error.cast("string"))).select(*calls.columns, "name")


def call_records(calls: DataFrame, fragments: DataFrame, genes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(candidate, header, sequence): every candidate as a record of FASTA.

    The header has the fragment's name, the gene pairs, their places on the reference, the spans of the first call and
    its closed ranges; positions in the second read are counted on behind the first and a bar.
    """
    rows = named(calls, pairs)
    first, second = F.split_part("name", F.lit("/"), F.lit(1)), F.split_part("name", F.lit("/"), F.lit(2))
    spot = F.format_string("%s:%d-%d:%d", "chrom", "start", "limit", "place")

    def places(i: int) -> DataFrame:
        return genes.select(F.col("gene").cast("string").alias(f"__g{i}"), spot.alias(f"__at{i}"))

    rows = rows.withColumns({"__g1": first, "__g2": second}).join(places(1), "__g1", "left").join(places(2), "__g2", "left")
    fields = ["n", "name", "__at1", "__at2", "span1", "span2", "start1", "limit1", "start2", "limit2"]
    whole = rows.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c")).join(fragments.select("candidate", "fragment_name", "r1", "r2"), "candidate")
    lead = F.get("c", F.lit(0))

    def shown(i: int) -> Column:
        def flat(at: Column) -> Column:
            return F.when(at >= R2_OFFSET, at - R2_OFFSET + F.length("r1") + 1).otherwise(at)

        return F.concat(flat(lead[f"start{i}"]).cast("string"), F.lit(":"), (flat(lead[f"limit{i}"]) - 1).cast("string"))

    spots = F.array_join(F.transform("c", lambda x: F.concat_ws("/", x["__at1"], x["__at2"])), ",")
    spans = F.concat_ws("/", lead["span1"].cast("string"), lead["span2"].cast("string"))
    header = F.concat_ws("|", F.concat(F.lit(">"), F.col("fragment_name")), F.array_join("c.name", ","), spots, spans, F.concat_ws("/", shown(1), shown(2)))
    return whole.select("candidate", header.alias("header"), F.when(F.col("r2") != "", F.concat_ws("|", "r1", "r2")).otherwise(F.col("r1")).alias("sequence"))


def span_sums(ranges: DataFrame) -> DataFrame:
    """Adds ``up_to`` and ``from_here``: the bases of a gene's ranges up to and from each, both included."""
    order = W.partitionBy("fragment", "gene").orderBy("start")
    size = F.col("limit") - F.col("start")
    return ranges.withColumns({"up_to": F.sum(size).over(order), "from_here": F.sum(size).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))})


def fusion_stats(ranges: DataFrame, most_genes: int = 5) -> DataFrame:
    """One row of counters: fragments with genes, genes and ranges before and after the cut to ``most_genes``, and how many
    fragments have 1, 2, 3 and 4 or more genes."""
    by_gene = ranges.groupBy("fragment", "gene").agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("limit") - F.col("start")).alias("span"))
    place = F.row_number().over(W.partitionBy("fragment").orderBy(F.desc("span"), "gene"))
    by_fragment = by_gene.withColumn("place", place).groupBy("fragment").agg(
        F.count(F.lit(1)).alias("genes"), F.sum("ranges").alias("ranges"), F.count_if(F.col("place") <= most_genes).alias("kept_genes"), F.sum(F.when(F.col("place") <= most_genes, F.col("ranges")).otherwise(0)).alias("kept_ranges")
    )
    totals = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in (("raw_genes", "genes"), ("raw_ranges", "ranges"), ("genes", "kept_genes"), ("ranges", "kept_ranges"))]
    bins = [F.count_if(F.col("genes") == i if i < 4 else F.col("genes") >= 4).alias(f"fragments_{i}") for i in (1, 2, 3, 4)]
    return by_fragment.agg(F.count(F.lit(1)).alias("fragments"), *totals, *bins)


def truth_score(calls: DataFrame, truth: DataFrame, least_support: int = 2) -> DataFrame:
    """(true_positives, false_positives, false_negatives) of calls (candidate, name) against the true names.

    A candidate with several names counts for the best supported one (ties to the smaller name); a name is called with
    ``least_support`` candidates.
    """
    support = calls.groupBy("name").agg(F.count_distinct("candidate").alias("s"))
    best = calls.join(support, "name").groupBy("candidate").agg(F.min_by("name", F.struct(-F.col("s"), F.col("name"))).alias("name"))
    called = best.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_support).select("name", F.lit(True).alias("called"))
    both = called.join(truth.select("name", F.lit(True).alias("true")).distinct(), "name", "full")
    hit, made, real = F.col("called") & F.col("true"), F.col("called").isNotNull(), F.col("true").isNotNull()
    return both.agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("true_positives"), F.count_if(made & ~real).alias("false_positives"), F.count_if(real & ~made).alias("false_negatives"))


# Names of transcripts


def transcript_key(name: Column) -> Column:
    """Struct (transcript_id, gene, chrom, start, stop, place) of a name `id|gene|chrom:start-stop:place...`; null if it is none."""
    pattern = r"^([^|]+)\|([^|]+)\|([^:|]+):(\d+)-(\d+):(\d+)"
    part = [F.regexp_extract(name, pattern, i) for i in range(1, 7)]
    found = F.struct(*[p.alias(n) for p, n in zip(part[:3], ("transcript_id", "gene", "chrom"), strict=True)], *[p.cast("int").alias(n) for p, n in zip(part[3:], ("start", "stop", "place"), strict=True)])
    return F.when(name.rlike(pattern), found)


def transcriptome(sequences: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(transcript_id, gene, chrom, start, stop, place, bases) of FASTA sequences (name, bases) with transcript names.

    With ``pairs`` only genes that a pair lists are kept.  A name of another form is an error.
    """
    key = F.coalesce(transcript_key(F.col("name")), F.raise_error(F.concat(F.lit("not a transcript's name: "), "name")).cast("struct<transcript_id:string,gene:string,chrom:string,start:int,stop:int,place:int>"))
    rows = sequences.select(key.alias("k"), "bases").select("k.*", "bases")
    if pairs is None:
        return rows
    named_genes = pairs.select(F.col("gene1").alias("gene")).unionAll(pairs.select(F.col("gene2").alias("gene"))).distinct()
    return rows.join(named_genes, "gene", "left_semi").select("transcript_id", "gene", "chrom", "start", "stop", "place", "bases")


def gene_numbers(genes: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(gene, gene_no): genes numbered from 1 by name; with ``fixed`` (gene, gene_no) by that list, and others are an error.

    The window runs over distinct genes, of which an annotation has some ten thousands.
    """
    each = genes.select("gene").where(F.col("gene").isNotNull()).distinct()
    if fixed is None:
        return each.withColumn("gene_no", F.row_number().over(W.orderBy("gene")))
    number = F.coalesce(F.col("gene_no"), F.raise_error(F.concat(F.lit("a gene outside of the list: "), F.col("gene").cast("string"))).cast("int"))
    return each.join(fixed.select("gene", F.col("gene_no").cast("int").alias("gene_no")), "gene", "left").select("gene", number.alias("gene_no"))
