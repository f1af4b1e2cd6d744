"""Readers and writers of the field's text files: FASTQ, FASTA, FAI, BED, GTF, SAM, gene pairs.

Line formats are Spark text sources with expressions.  Records of FASTQ and FASTA span lines, so they are read by Python
data sources that cut plain files into byte ranges and find the first record of each.
"""

from __future__ import annotations

import glob
import gzip
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.sources.binary import file_info, open_binary

#: Bytes of a FASTQ partition.
SPLIT = 64 << 20


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class FastqError(ValueError):
    """A file isn't FASTQ."""


def _opened(path: str) -> IO[bytes]:
    raw = open_binary(path)
    return gzip.open(raw, "rb") if path.endswith(".gz") else raw  # type: ignore[return-value]


def _ranges(path: str, split: int) -> list[InputPartition]:
    """Byte ranges of the files of a pattern (or of one URI); packed files are one range each."""
    out: list[InputPartition] = []
    for name in [path] if "://" in path else sorted(glob.glob(path)):
        size = file_info(name)["bytes"]
        step = size + 1 if name.endswith(".gz") else split
        out += [_Range(name, b, b + step) for b in range(0, max(size, 1), step)]
    return out


def _record_start(lines: list[bytes]) -> int | None:
    """Which of a few lines begins a record: `@` with `+` two lines on, and no `+` two lines after the quality."""
    for i in range(len(lines) - 2):
        if lines[i][:1] == b"@" and lines[i + 2][:1] == b"+":
            return i
    return None


def fastq_records(path: str, begin: int = 0, end: int | None = None) -> Iterator[tuple[str, int, str, str, str, str]]:
    """The records whose first byte lies in [begin, end): file, offset (of the unpacked bytes), and the four lines.

    Raises FastqError where a record doesn't begin with `@`, has no `+` line, or is cut short.
    """
    with _opened(path) as f:
        at = begin
        if begin:
            f.seek(begin - 1)
            at = begin - 1 + len(f.readline())
            heads, starts, here = [], [], at
            for _ in range(8):
                line = f.readline()
                if not line:
                    break
                heads.append(line)
                starts.append(here)
                here += len(line)
            first = _record_start(heads)
            if first is None:
                return
            at = starts[first]
            f.seek(at)
        while end is None or at < end:
            lines = [f.readline() for _ in range(4)]
            if not lines[0]:
                return
            if not lines[3] and not (lines[2] and len(lines[1].rstrip()) == 0):
                raise FastqError(f"{path}: short record at {at}")
            if lines[0][:1] != b"@":
                raise FastqError(f"{path}: no @ at {at}")
            if lines[2][:1] != b"+":
                raise FastqError(f"{path}: no + in the record at {at}")
            yield (path, at, *[x.rstrip(b"\r\n").decode() for x in lines])
            at += sum(map(len, lines))


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path or glob): file, offset, id, seq, unk, qual.  Option split: bytes a task."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file string, offset bigint, id string, seq string, unk string, qual string"

    def reader(self, schema: object) -> DataSourceReader:
        return _FastqReader(self.options["path"], int(self.options.get("split", SPLIT)))


class _FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.path, self.split)

    def read(self, partition: _Range) -> Iterator[tuple]:
        packed = partition.path.endswith(".gz")
        yield from fastq_records(partition.path, partition.begin, None if packed else partition.end)


def read_fastq(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("split", split).load(path)


def with_record_number(records: DataFrame, name: str = "read_no", stretch: int = SPLIT) -> DataFrame:
    """Adds the number of each record, from 0, in the order of file and offset.

    Records are numbered within stretches of ``stretch`` bytes, and the records before each stretch are added: the only
    order over everything is that of the stretches.
    """
    part = F.floor(F.col("offset") / stretch).alias("__part")
    rows = records.withColumn("__part", part)
    counts = rows.groupBy("file", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("file", "__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "__part", before.alias("__before"))
    inner = F.row_number().over(W.partitionBy("file", "__part").orderBy("offset")) - 1
    return rows.withColumn("__inner", inner).join(F.broadcast(starts), ["file", "__part"]).withColumn(name, F.col("__before") + F.col("__inner")).drop("__part", "__before", "__inner")


def read_fastq_pairs(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    """(read_no, id_1, seq_1, ..., qual_2): the n-th records of two files side by side.

    An unequal number of records raises an error when the rows are read.
    """

    def numbered(path: str, i: int) -> DataFrame:
        return with_record_number(read_fastq(spark, path)).select("read_no", *[F.col(c).alias(f"{c}_{i}") for c in ("id", "seq", "unk", "qual")])

    both = numbered(path1, 1).join(numbered(path2, 2), "read_no", "full")
    lost = F.col("id_1").isNull() | F.col("id_2").isNull()
    return both.withColumn("id_1", F.when(lost, F.raise_error(F.lit("the files have unequal numbers of reads"))).otherwise(F.col("id_1")))


class FastaSource(DataSource):
    """spark.read.format("fasta").load(path or glob): a row a sequence, or with option chunk a row for each so many bases.

    offset is where the first base stands, line_bases and line_width are bases and bytes of the first line.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, name string, description string, offset bigint, line_bases int, line_width int, chunk_no int, bases string"

    def reader(self, schema: object) -> DataSourceReader:
        return _FastaReader(self.options["path"], int(self.options.get("split", SPLIT)), int(self.options.get("chunk", 0)))


class _FastaReader(DataSourceReader):
    def __init__(self, path: str, split: int, chunk: int):
        self.path, self.split, self.chunk = path, split, chunk

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.path, self.split)

    def read(self, partition: _Range) -> Iterator[tuple]:
        packed = partition.path.endswith(".gz")
        yield from fasta_records(partition.path, partition.begin, None if packed else partition.end, self.chunk)


def fasta_records(path: str, begin: int = 0, end: int | None = None, chunk: int = 0) -> Iterator[tuple]:
    """The sequences whose `>` lies in [begin, end), as rows of the source; only a `>` at a line's start begins one.

    With ``chunk`` at most so many bases and a line are held.  Bases before the first header are an error.
    """
    with _opened(path) as f:
        at = begin
        if begin:
            f.seek(begin - 1)
            at = begin - 1 + len(f.readline())
        head: tuple | None = None
        held, size, number = [], 0, 0

        def rows(last: bool) -> Iterator[tuple]:
            nonlocal held, size, number
            if head is None or not (last or (chunk and size >= chunk)):
                return
            text = b"".join(held)
            while chunk and len(text) >= chunk:
                yield (*head, number, text[:chunk].decode())
                text, number = text[chunk:], number + 1
            if last and (text or not number):
                yield (*head, number, text.decode())
                text = b""
            held, size = [text], len(text)

        while line := f.readline():
            body = line.rstrip()
            if line[:1] == b">":
                yield from rows(True)
                if end is not None and at >= end:
                    return
                name, _, description = body[1:].decode().partition(" ")
                head, held, size, number = (path, name, description.strip(), at + len(line), 0, 0), [], 0, 0
            elif head is not None:
                if not held:
                    head = (*head[:4], len(body), len(line))
                held.append(b"".join(body.split()))
                size += len(held[-1])
                yield from rows(False)
            elif begin == 0 and body:
                raise FastqError(f"{path}: bases before a header")
            at += len(line)
        yield from rows(True)


def read_fasta_source(spark: SparkSession, path: str, chunk: int = 0, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("chunk", chunk).option("split", split).load(path)


def read_fasta(spark: SparkSession, path: str, encoding: str = "raw") -> DataFrame:
    """(name, description, bases) of every sequence; a name ends at the first space; lines are joined.

    ``encoding``: ``raw`` as it stands, ``clean`` capital A, C, G, T and N, ``packed`` a hexadecimal digit a base.
    A sequence is one row; long ones should be read in chunks (see ``read_fasta_chunks``).
    """
    from strandline.functions import seq as seqs

    shapes = {"raw": F.col("bases"), "clean": seqs.clean(F.col("bases")), "packed": seqs.pack(F.col("bases"))}
    return read_fasta_source(spark, path).select("name", "description", shapes[encoding].alias("bases"))


def read_fasta_chunks(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    """(name, chunk_no, bases) of every sequence, cut while it is read."""
    return read_fasta_source(spark, path, chunk).where(F.col("bases") != "").select("name", "chunk_no", "bases")


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, offset, line_bases, line_width) of every sequence; a file without any is an error."""
    whole = read_fasta_source(spark, path, 1 << 20).groupBy("file", "name", "offset").agg(F.sum(F.length("bases")).cast("bigint").alias("length"), F.max("line_bases").alias("line_bases"), F.max("line_width").alias("line_width"))
    if whole.isEmpty():
        raise ValueError(f"{path}: no sequences")
    return whole.orderBy("file", "offset").select("name", "length", "offset", "line_bases", "line_width")


def write_fai(index: DataFrame, path: str) -> None:
    """An index as tab-separated text, one file in its order."""
    index.orderBy("offset").coalesce(1).write.mode("overwrite").csv(path, sep="\t")


class FastaFile:
    """Random access to a plain file through its index: ``get(name, start, limit)`` reads only the bytes it needs."""

    def __init__(self, path: str, index: dict[str, tuple[int, int, int, int]]):
        self.path, self.index = path, index

    @staticmethod
    def open(path: str, fai: str) -> FastaFile:
        with open_binary(fai) as f:
            rows = [line.split("\t") for line in f.read().decode().splitlines() if line]
        return FastaFile(path, {r[0]: (int(r[1]), int(r[2]), int(r[3]), int(r[4])) for r in rows})

    def names(self) -> list[str]:
        return list(self.index)

    def length(self, name: str) -> int:
        if name not in self.index:
            raise KeyError(f"no sequence {name}")
        return self.index[name][0]

    def get(self, name: str, start: int, limit: int) -> str:
        if not 0 <= start < limit <= self.length(name):
            raise ValueError(f"{name}: no range {start} to {limit}")
        _, offset, bases, width = self.index[name]
        begin, end = (offset + x // bases * width + x % bases for x in (start, limit - 1))
        with open_binary(self.path) as f:
            f.seek(begin)
            return b"".join(f.read(end + 1 - begin).split()).decode()


def fasta_chunks(sequences: DataFrame, chunk: int) -> DataFrame:
    """(name, chunk_no, bases): sequences in chunks of a fixed length, for range reads; a sequence is cut where it stands."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, bases in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for first in range(0, len(bases), chunk * 64):
                    cut = [bases[i : i + chunk] for i in range(first, min(first + chunk * 64, len(bases)), chunk)]
                    numbers = range(first // chunk, first // chunk + len(cut))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), pa.array(numbers, pa.int32()), pa.array(cut, pa.string())], names=["name", "chunk_no", "bases"])

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("chunk_no", T.IntegerType()), T.StructField("bases", T.StringType())])
    return sequences.where(F.length("bases") > 0).select("name", "bases").mapInArrow(batches, schema)


def fasta_range(chunks: DataFrame, name: str, start: int, limit: int, chunk: int) -> DataFrame:
    """(bases) of [start, limit) of a sequence: only the chunks it spans are read."""
    if limit <= start or start < 0:
        raise ValueError("a range must not be empty")
    wanted = chunks.where((F.col("name") == name) & F.col("chunk_no").between(start // chunk, (limit - 1) // chunk))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "bases"))), lambda x: x["bases"]), "")
    return wanted.agg(F.substring(joined, start % chunk + 1, limit - start).alias("bases"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """An index of FASTA: name, length, offset, line_bases, line_width."""
    return spark.read.csv(path, sep="\t", schema="name string, length bigint, offset bigint, line_bases int, line_width int")


def read_bed(spark: SparkSession, path: str, one_based: bool = False, strict: bool = False, invert: bool = False) -> DataFrame:
    """(ref, start, limit) of the first three fields, further ones, comments and blank lines ignored; packed files too.

    With ``strict`` a line without three fields, a negative start, an end before its start or at the last position
    is an error.  With ``invert`` what the intervals leave of the references that they name.
    """
    fields = F.split(F.trim("value"), r"[ \t]+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*($|#)")).select("value", F.get(fields, F.lit(0)).alias("ref"), F.get(fields, F.lit(1)).try_cast("int").alias("start"), F.get(fields, F.lit(2)).try_cast("int").alias("limit"))
    rows = rows.withColumn("start", F.col("start") - 1) if one_based else rows
    if strict:
        good = F.col("start").isNotNull() & F.col("limit").isNotNull() & (F.col("start") >= 0) & (F.col("limit") >= F.col("start")) & (F.col("limit") < 2_147_483_647)
        rows = rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not an interval: "), "value")).cast("boolean")))
    rows = rows.select("ref", "start", "limit")
    if invert:
        from strandline.operators.intervals import complement

        return complement(rows)
    return rows


def read_gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("gene", "transcript", "exon")) -> DataFrame:
    """Annotation records: chrom, feature, range_start, range_stop, strand and the attributes as a map."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, source string, feature string, range_start int, range_stop int, score string, strand string, frame string, attributes string")
    pairs = F.regexp_extract_all(F.col("attributes"), F.lit(r'(\w+) "([^"]*)"'), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(" "), F.lit(1)).alias("key"), F.regexp_extract(p, r'"([^"]*)"', 1).alias("value")))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    return rows.where(F.col("feature").isin(*features)).select("chrom", "feature", "range_start", "range_stop", "strand", last.alias("attributes"))


SAM_COLUMNS = ["read_name", "flags", "ref_name", "pos", "mapq", "cigar", "mate_ref_name", "mate_pos", "template_length", "seq", "qual"]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text: the eleven fields (positions from 0, qualities as numbers, `=` resolved) and the tags as texts.

    Numbers that can't be read are null.
    """
    raw = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t", -1)

    def at(i: int) -> Column:
        return F.get(f, F.lit(i))

    quals = F.when(at(10) == "*", F.array().cast("array<int>")).otherwise(F.transform(F.split(at(10), "", -1), lambda c: F.ascii(c) - 33))
    return raw.select(
        at(0).alias("read_name"),
        at(1).try_cast("int").alias("flags"),
        at(2).alias("ref_name"),
        (at(3).try_cast("int") - 1).alias("pos"),
        at(4).try_cast("int").alias("mapq"),
        at(5).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_ref_name"),
        (at(7).try_cast("int") - 1).alias("mate_pos"),
        at(8).try_cast("int").alias("template_length"),
        at(9).alias("seq"),
        quals.alias("qual"),
        F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))).alias("tags"),
    )


def sam_line(template: Column | None = None, tags: Column | None = None) -> Column:
    """A record as a line of SAM; ``template`` is its template length (0 without), ``tags`` an array of texts."""
    template = F.lit(0) if template is None else template
    quals = F.when(F.size("qual") > 0, F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")).otherwise("*")
    mate = F.when((F.col("mate_ref_name") == F.col("ref_name")) & (F.col("ref_name") != "*"), "=").otherwise(F.coalesce("mate_ref_name", F.lit("*")))
    fields = [
        F.coalesce("read_name", F.lit("*")),
        F.col("flags").cast("string"),
        F.coalesce("ref_name", F.lit("*")),
        (F.coalesce("pos", F.lit(-1)) + 1).cast("string"),
        F.col("mapq").cast("string"),
        F.coalesce("cigar", F.lit("*")),
        mate,
        (F.coalesce("mate_pos", F.lit(-1)) + 1).cast("string"),
        F.coalesce(template, F.lit(0)).cast("string"),
        F.coalesce("seq", F.lit("*")),
        F.coalesce(quals, F.lit("*")),
    ]
    return F.concat_ws("\t", *fields, *([] if tags is None else [tags]))


def template_length(pos: Column, limit: Column, flags: Column, mate_pos: Column, mate_limit: Column) -> Column:
    """The signed length of a pair on one reference: positive for the read that begins first, ties to the first of the pair."""
    from strandline.functions import align

    span = F.greatest(limit, mate_limit) - F.least(pos, mate_pos)
    leads = (pos < mate_pos) | ((pos == mate_pos) & align.has_flag(flags, align.READ1))
    return F.when(leads, span).otherwise(-span)


def fastq_text() -> Column:
    """A record (id, seq, unk, qual) as its four lines."""
    return F.concat_ws("\n", "id", "seq", "unk", "qual")


def write_fastq(reads: DataFrame, path: str) -> None:
    reads.select(fastq_text().alias("value")).write.mode("overwrite").text(path)


def write_sam(reads: DataFrame, path: str) -> None:
    """Sorted records as SAM text, a file a range."""
    from strandline.operators.alignments import coordinate_sorted

    coordinate_sorted(reads).select(sam_line().alias("value")).write.mode("overwrite").text(path)


def write_reads(reads: DataFrame, path: str) -> None:
    """Records as Parquet, range-partitioned and sorted by coordinate, so that region scans skip row groups."""
    from strandline.functions.align import ref_order

    ranged = reads.withColumn("__ref", ref_order(F.col("ref_id"))).repartitionByRange("__ref", "pos").sortWithinPartitions("__ref", "pos", "read_id").drop("__ref")
    ranged.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_gene_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(gene1, gene2) of a table with a header and a column Genes of `a/b`; other shapes of it are left out."""
    rows = spark.read.csv(path, sep="\t", header=True)
    parts = F.split("Genes", "/", -1)
    return rows.where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("gene1"), F.get(parts, F.lit(1)).alias("gene2"))
