"""Building blocks of gene-fusion detection: read screening, stitching, k-mer index, gene ranges, candidate filters, UMIs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.functions import seq as seqs
from strandline.functions.exprs import let

#: Positions in the second read begin here.
R2_OFFSET = 1_000_000_000
#: Bases of a UMI at the start of a read, and of the UMI with its spacer.
UMI_BASES, UMI_STRIPPED = 6, 7


def strip_umis(reads: DataFrame) -> DataFrame:
    """Rows (name, r1, r2): the UMIs at the reads' starts are cut off and appended to the name.

    Where a read is shorter than UMI and spacer, r1 becomes N and r2 empty; a name that has a UMI keeps it.
    """
    short = (F.length("r1") < UMI_STRIPPED) | (F.length("r2") < UMI_STRIPPED)
    name = F.when(short | seqs.umi_of_name(F.col("name")).isNotNull(), F.col("name")).otherwise(seqs.add_umi(F.col("name"), F.substring("r1", 1, UMI_BASES), F.substring("r2", 1, UMI_BASES)))
    cut = F.lit(UMI_STRIPPED + 1)
    return reads.withColumns(
        {
            "name": name,
            "r1": F.when(short, "N").otherwise(F.substring(F.col("r1"), cut, F.length("r1"))),
            "r2": F.when(short, "").otherwise(F.substring(F.col("r2"), cut, F.length("r2"))),
        }
    )


def screen_low_complexity(reads: DataFrame, fraction: float = 0.9) -> DataFrame:
    """r2 is turned to r1's strand; reads of low complexity are dropped: both, r1 (r2 takes its place), or r2."""
    low1, low2, turned = seqs.is_low_complexity(F.col("r1"), fraction), seqs.is_low_complexity(F.col("r2"), fraction), seqs.reverse_complement(F.col("r2"))
    return reads.withColumns(
        {
            "r1": F.when(low1 & low2, "N").when(low1, turned).otherwise(F.col("r1")),
            "r2": F.when(low1 | low2, "").otherwise(turned),
        }
    )


def _shared_start(r1: str, r2: str, k: int, most_unequal: float) -> tuple[int, int] | None:
    """Where r2 begins relative to r1, by the first k-mer of r1 whose last place in r2 makes a good overlap."""
    last = {r2[j : j + k]: j for j in range(len(r2) - k + 1) if set(r2[j : j + k]) <= set("ACGT")}
    for i in range(len(r1) - k + 1):
        j = last.get(r1[i : i + k])
        if j is None:
            continue
        shift = i - j
        begin, end = max(0, shift), min(len(r1), shift + len(r2))
        x, y = r1[begin:end], r2[begin - shift : end - shift]
        if sum(a != b for a, b in zip(x, y, strict=True)) <= most_unequal * (end - begin):
            return shift, end
    return None


def stitch_pair(r1: str | None, r2: str | None, k: int = 19, most_unequal: float = 0.1) -> str | None:
    """One sequence of two overlapping reads of one strand: from r1's start to r2's end; None if they don't overlap.

    Where the reads run past each other's ends, what lies outside of [start of r1, end of r2) is adapter and cut.
    """
    if not r1 or not r2:
        return None
    found = _shared_start(r1, r2, k, most_unequal)
    if found is None:
        return None
    shift, _ = found
    stop = shift + len(r2)
    if shift <= 0 and stop >= len(r1) and (shift < 0 or stop > len(r1)):
        return r2[-shift:]
    return r1[:stop] if stop <= len(r1) else r1 + r2[len(r1) - shift :]


def stitch(reads: DataFrame, k: int = 19, most_unequal: float = 0.1, fraction: float = 0.9) -> DataFrame:
    """Adds stitched: r1 becomes the stitched sequence and r2 empty; a stitched one of low complexity becomes N."""

    @F.pandas_udf("string")
    def joined(r1: pd.Series, r2: pd.Series) -> pd.Series:
        return pd.Series([stitch_pair(a, b, k, most_unequal) for a, b in zip(r1, r2, strict=True)], dtype=object)

    found = reads.withColumn("__joined", joined("r1", "r2"))
    whole = F.col("__joined").isNotNull()
    return found.withColumns(
        {
            "r1": F.when(whole & seqs.is_low_complexity(F.col("__joined"), fraction), "N").otherwise(F.coalesce("__joined", "r1")),
            "r2": F.when(whole, "").otherwise(F.col("r2")),
            "stitched": whole,
        }
    ).drop("__joined")


def gene_index(occurrences: DataFrame, most_genes: int = 5) -> DataFrame:
    """(kmer, genes): the sorted genes of each k-mer of (kmer, gene); k-mers of more than ``most_genes`` are left out.

    Genes are counted first, so a list is built only for k-mers within the bound.
    """
    pairs = occurrences.where(F.col("kmer").isNotNull() & F.col("gene").isNotNull()).select("kmer", "gene").distinct()
    small = pairs.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_genes).select("kmer")
    return pairs.join(small, "kmer", "left_semi").groupBy("kmer").agg(F.array_sort(F.collect_list("gene")).alias("genes"))


def fragment_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(fragment, pos, kmer) of rows (fragment, r1, r2): canonical k-mers; positions of r2 begin at R2_OFFSET."""

    def of(column: str, offset: int) -> Column:
        return F.transform(seqs.kmers(F.col(column), k), lambda x: F.struct((x["pos"].cast("bigint") + offset).alias("pos"), seqs.canonical(x["forward"], x["revcomp"]).alias("kmer")))

    return reads.select("fragment", F.inline(F.concat(of("r1", 0), of("r2", R2_OFFSET))))


def gene_ranges(hits: DataFrame, k: int) -> DataFrame:
    """(fragment, gene, start, limit) of hits (fragment, gene, pos): k-mers that overlap or touch are one range."""
    order = W.partitionBy("fragment", "gene").orderBy("pos")
    fresh = (F.coalesce(F.col("pos") > F.lag("pos").over(order) + k, F.lit(True))).cast("int")
    runs = hits.select("fragment", "gene", "pos").distinct().withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("fragment", "gene", "run").agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("limit")).drop("run")


def gene_spans(ranges: DataFrame) -> DataFrame:
    """(fragment, gene, span): bases of a fragment that a gene's ranges cover."""
    return ranges.groupBy("fragment", "gene").agg(F.sum(F.col("limit") - F.col("start")).alias("span"))


def top_genes(spans: DataFrame, k: int = 5) -> DataFrame:
    """Adds place (from 1) and keeps the k genes of the longest spans of each fragment, ties to the smaller gene."""
    order = W.partitionBy("fragment").orderBy(F.desc("span"), "gene")
    return spans.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def gene_count_histogram(spans: DataFrame, last: int = 4) -> DataFrame:
    """(genes, fragments): how many fragments meet how many genes; ``last`` stands for that many or more."""
    return spans.groupBy("fragment").agg(F.least(F.count(F.lit(1)), F.lit(last)).cast("int").alias("genes")).groupBy("genes").agg(F.count(F.lit(1)).alias("fragments"))


# Filters of candidates: rows (candidate, gene1, gene2, span1, span2, umi, r1, r2)


def covered(start: Column, limit: Column) -> Column:
    """The bases of r1 and r2 from start to limit, positions in r2 from R2_OFFSET."""
    in_r1, in_r2 = start < R2_OFFSET, limit >= R2_OFFSET
    first = F.substring(F.col("r1"), (start + 1).cast("int"), F.when(in_r2, F.length("r1")).otherwise(limit - start).cast("int"))
    begin = F.when(in_r1, 0).otherwise(start - R2_OFFSET)
    second = F.substring(F.col("r2"), (begin + 1).cast("int"), (limit - R2_OFFSET - begin).cast("int"))
    return F.concat(F.when(in_r1, first).otherwise(""), F.when(in_r2, second).otherwise(""))


def without_low_complexity(candidates: DataFrame, fraction: float = 0.9) -> DataFrame:
    """Drops pairs one of whose genes is linked by bases of low complexity; start1, limit1, start2, limit2 say where."""
    low = [seqs.is_low_complexity(covered(F.col(f"start{i}"), F.col(f"limit{i}")), fraction) for i in (1, 2)]
    return candidates.where(~(low[0] | low[1]))


def without_neighbours(candidates: DataFrame, genes: DataFrame, distance: int, places: int) -> DataFrame:
    """Drops pairs of genes (gene, chrom, start, limit, place) on one chromosome that lie within ``places`` ranks
    of each other or within ``distance`` bases (0 turns either off)."""

    def side(i: int) -> DataFrame:
        return genes.select(F.col("gene").alias(f"gene{i}"), *[F.col(c).alias(f"__{c}{i}") for c in ("chrom", "start", "limit", "place")])

    both = candidates.join(side(1), "gene1", "left").join(side(2), "gene2", "left")
    gap = F.greatest("__start1", "__start2") - F.least("__limit1", "__limit2")
    near = (F.col("__chrom1") == F.col("__chrom2")) & ((F.lit(places > 0) & (F.abs(F.col("__place1") - F.col("__place2")) <= places)) | (F.lit(distance > 0) & (gap <= distance)))
    return both.where(~F.coalesce(near, F.lit(False))).select(*candidates.columns)


def without_promiscuous(candidates: DataFrame, most_partners: int = 5) -> DataFrame:
    """Drops candidates one of whose genes has more than ``most_partners`` distinct partners."""
    both = candidates.select("gene1", "gene2").unionAll(candidates.select(F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2"))).distinct()
    many = both.groupBy("gene1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_partners).select(F.col("gene1").alias("gene"))
    return candidates.join(many.withColumnRenamed("gene", "gene1"), "gene1", "left_anti").join(many.withColumnRenamed("gene", "gene2"), "gene2", "left_anti").select(*candidates.columns)


# UMIs


def snap_umis(reads: DataFrame, column: str, known: Sequence[str], most_known: int = 4096) -> DataFrame:
    """Adds corrected, edits and changed: the known UMI nearest to each.

    A tie leaves the UMI as it is with -1 edits; a known UMI has 0 edits and isn't changed.  ``known`` is a bounded
    list of words of A, C, G, T of one length; other letters in it are an error.  Null UMIs stay null.
    """
    listed = sorted({k.upper() for k in known})
    if len(listed) > most_known or len({len(k) for k in listed}) > 1 or any(set(k) - set("ACGT") for k in listed) or not listed:
        raise ValueError("known UMIs must be 1 to 4096 words of A, C, G, T of one length")
    words = F.array(*[F.lit(k) for k in listed])
    here = F.col(f"`{column}`")

    def pick(costs: Column) -> Column:
        least = F.array_min(costs)
        one = F.size(F.filter(costs, lambda c: c == least)) == 1
        near = F.get(words, (F.array_position(costs, least) - 1).cast("int"))
        return F.struct(F.when(one, near).otherwise(here).alias("corrected"), F.when(one, least).otherwise(-1).alias("edits"), (one & (least > 0)).alias("changed"))

    found = let(F.transform(words, lambda w: F.levenshtein(here, w)), pick)
    return reads.withColumn("__umi", F.when(here.isNotNull(), found)).select("*", "__umi.*").drop("__umi")
