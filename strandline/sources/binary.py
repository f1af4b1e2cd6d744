"""Binary alignment files: blocked gzip, headers, records, both kinds of index, a data source and a sink.

Files are opened by path, or by URI through Arrow's file systems, so that executors read shared storage.  A scan is cut
at the virtual offsets of an index (compressed offset << 16 | offset within the block): a task reads from one to the
next.  Without an index a file is one task.
"""

from __future__ import annotations

import gzip
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import IO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the formats: magic numbers, the empty last block, the letters of bases and CIGAR operations.
BAM_MAGIC, BAI_MAGIC = b"BAM\x01", b"BAI\x01"
GBAI_MAGIC = bytes.fromhex("47424149 01f1785c 7bcbc1ba 0823b119".replace(" ", ""))
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
NIBBLES, CIGAR_OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Bytes of a block before it is packed; 64 KiB less what packing may add.
BLOCK = 0xFF00
#: The bin of an index that holds counts instead of chunks.
META_BIN = 37450
#: Rows of an Arrow batch.
ROWS = 4096

SCHEMA = "read_name string, flags int, ref_id int, ref_name string, pos int, mapq int, cigar string, mate_ref_id int, mate_ref_name string, mate_pos int, template_length int, seq string, qual array<int>, tags array<string>"


class FormatError(ValueError):
    """A file isn't what it should be."""


def open_binary(path: str, mode: str = "rb") -> IO[bytes]:
    """A local file, or one of Arrow's file systems if the path is a URI."""
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name) if "r" in mode else where.open_output_stream(name)


def exists(path: str) -> bool:
    if "://" not in path:
        return os.path.exists(path)
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where.get_file_info(name).type != fs.FileType.NotFound


def detect_format(path: str, index: str | None = None) -> str:
    """``bam`` or ``parquet``: by the path's ending, else by the index files that lie beside it; unknown paths are bam."""
    if path.endswith(".bam"):
        return "bam"
    if ".pam" in path or path.rstrip("/").endswith(".parquet"):
        return "parquet"
    if any(exists(p) for p in ([index] if index else []) + [f"{path}.bai", f"{path}.gbai"]):
        return "bam"
    return "parquet" if exists(f"{path}/_SUCCESS") else "bam"


# Blocks


def pack_block(data: bytes, level: int = 6) -> bytes:
    """At most BLOCK bytes as one block."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class BlockWriter:
    """Writes bytes as blocks; ``tell`` is the virtual offset of the next byte."""

    def __init__(self, out: IO[bytes], level: int = 6):
        self.out, self.level, self.held, self.at = out, level, bytearray(), 0

    def tell(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, n: int) -> None:
        block = pack_block(bytes(self.held[:n]), self.level)
        self.out.write(block)
        self.at += len(block)
        del self.held[:n]

    def finish(self, last: bool = True) -> None:
        if self.held:
            self._flush(len(self.held))
        if last:
            self.out.write(LAST_BLOCK)
            self.at += len(LAST_BLOCK)


class BlockReader:
    """Reads the bytes of a file of blocks from a virtual offset on."""

    def __init__(self, source: IO[bytes], offset: int = 0):
        self.source = source
        self.seek(offset)

    def seek(self, offset: int) -> None:
        self.source.seek(offset >> 16)
        self.next_at, self.begin, self.block, self.at = offset >> 16, offset >> 16, b"", 0
        if offset & 0xFFFF:
            self._load()
            self.at = offset & 0xFFFF

    def _load(self) -> bool:
        self.begin, self.block, self.at = self.next_at, b"", 0
        head = self.source.read(18)
        if not head:
            return False
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise FormatError(f"no block at {self.begin}")
        extra = struct.unpack_from("<H", head, 10)[0]
        fields, size, spot = head[12:] + self.source.read(extra - 6), None, 0
        while spot + 4 <= extra:
            kind, n = fields[spot : spot + 2], struct.unpack_from("<H", fields, spot + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", fields, spot + 4)[0] + 1
            spot += 4 + n
        if size is None:
            raise FormatError(f"the block at {self.begin} doesn't tell its size")
        rest = self.source.read(size - 12 - extra)
        if len(rest) < size - 12 - extra:
            raise FormatError(f"the block at {self.begin} is cut short")
        self.block = zlib.decompress(rest[:-8], -15)
        if zlib.crc32(self.block) != struct.unpack_from("<I", rest, len(rest) - 8)[0]:
            raise FormatError(f"the block at {self.begin} is damaged")
        self.next_at = self.begin + size
        return True

    def tell(self) -> int:
        """The virtual offset of the next byte; at a block's end that of the next block."""
        return self.next_at << 16 if self.at == len(self.block) else self.begin << 16 | self.at

    def read(self, n: int) -> bytes:
        """n bytes, fewer at the end of the file."""
        parts = []
        while n:
            if self.at == len(self.block) and not self._load():
                break
            part = self.block[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


# Headers


@dataclass
class Header:
    """The text of a header, and the references in their order."""

    text: str = ""
    references: list[tuple[str, int]] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.references]


def read_header(reader: BlockReader) -> Header:
    if reader.read(4) != BAM_MAGIC:
        raise FormatError("not a binary alignment file")
    text = reader.read(*struct.unpack("<i", reader.read(4))).rstrip(b"\0").decode()
    references = []
    for _ in range(*struct.unpack("<i", reader.read(4))):
        name = reader.read(*struct.unpack("<i", reader.read(4)))[:-1].decode()
        references.append((name, *struct.unpack("<i", reader.read(4))))
    return Header(text, references)


def header_bytes(header: Header) -> bytes:
    text = header.text.encode()
    parts = [BAM_MAGIC, struct.pack("<i", len(text)), text, struct.pack("<i", len(header.references))]
    for name, length in header.references:
        parts += [struct.pack("<i", len(name) + 1), name.encode(), b"\0", struct.pack("<i", length)]
    return b"".join(parts)


def parse_header(data: bytes) -> Header:
    """A header that is all of ``data``; anything behind it is an error."""
    import io

    class Plain:
        def __init__(self, inner: IO[bytes]):
            self.read = inner.read

    inner = io.BytesIO(data)
    header = read_header(Plain(inner))  # type: ignore[arg-type]
    if inner.read(1):
        raise FormatError("bytes behind the header")
    return header


def header_of(path: str) -> Header:
    with open_binary(path) as f:
        return read_header(BlockReader(f))


def sam_header(text: str) -> Header:
    """The header of SAM text: references by its @SQ lines."""
    fields = [dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x) for line in text.splitlines() if line.startswith("@SQ")]
    return Header(text, [(f["SN"], int(f["LN"])) for f in fields])


def merged_header(headers: Sequence[Header]) -> Header:
    """One header for files that are merged; their references must be the same, in the same order."""
    if any(h.references != headers[0].references for h in headers):
        raise FormatError("the files' references differ")
    lines = dict.fromkeys(line for h in headers for line in h.text.splitlines())
    return Header("".join(f"{x}\n" for x in lines), headers[0].references)


def references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, ref_name, length) of a file's header."""
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(header_of(path).references)], "ref_id int, ref_name string, length int")


def file_info(path: str) -> dict[str, int]:
    """Size in bytes and time of change (seconds) of a file."""
    if "://" in path:
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        found = where.get_file_info(name)
        return {"bytes": found.size, "changed": found.mtime_ns // 10**9}
    stat = os.stat(path)
    return {"bytes": stat.st_size, "changed": int(stat.st_mtime)}


# Records

_FIXED = struct.Struct("<iiBBHHHiiii")
_TO_LETTERS = str.maketrans("0123456789abcdef", NIBBLES)
_TO_DIGITS = {**{ord(c): "0123456789abcdef"[i] for i, c in enumerate(NIBBLES)}, **{ord(c.lower()): "0123456789abcdef"[i] for i, c in enumerate(NIBBLES)}}
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _tags_of(data: bytes) -> list[str]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            out.append(f"{name}:{kind}:{data[at:end].decode()}")
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            code = f"<{n}{_NUMBERS[sub]}"
            out.append(f"{name}:B:{sub}," + ",".join(f"{x:g}" if sub == "f" else str(x) for x in struct.unpack_from(code, data, at + 5)))
            at += 5 + struct.calcsize(code)
        elif kind in _NUMBERS:
            code = f"<{_NUMBERS[kind]}"
            value = struct.unpack_from(code, data, at)[0]
            out.append(f"{name}:f:{value:g}" if kind == "f" else f"{name}:i:{value}")
            at += struct.calcsize(code)
        else:
            raise FormatError(f"a tag of unknown type {kind}")
    return out


def _tag_bytes(tag: str) -> bytes:
    name, kind, value = tag.split(":", 2)
    head = name.encode()
    if kind == "A":
        return head + b"A" + value.encode()
    if kind in "ZH":
        return head + kind.encode() + value.encode() + b"\0"
    if kind == "i":
        number = int(value)
        code = next(c for c in "cCsSiI" if -(1 << 31) <= number < 1 << 32 and _fits(number, _NUMBERS[c]))
        return head + code.encode() + struct.pack(f"<{_NUMBERS[code]}", number)
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "B":
        sub, *values = value.split(",")
        numbers = [float(v) if sub == "f" else int(v) for v in values]
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(numbers)}{_NUMBERS[sub]}", len(numbers), *numbers)
    raise FormatError(f"a tag of unknown type {kind}")


def _fits(number: int, code: str) -> bool:
    bits = struct.calcsize(code) * 8
    return 0 <= number < 1 << bits if code.isupper() else -(1 << bits - 1) <= number < 1 << bits - 1


def decode_record(data: bytes, names: Sequence[str]) -> tuple:
    """A record's bytes (without its size) as a row of SCHEMA; a reference outside of the header is an error."""
    ref, pos, name_size, mapq, _, ops, flags, bases, mate, mate_pos, template = _FIXED.unpack_from(data)
    if not (-1 <= ref < len(names) and -1 <= mate < len(names)):
        raise FormatError("a reference that the header hasn't")
    at = 32 + name_size
    name = data[32 : at - 1].decode()
    cigar = "".join(f"{x >> 4}{CIGAR_OPS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", data, at)) or "*"
    at += 4 * ops
    packed = (bases + 1) // 2
    seq = data[at : at + packed].hex().translate(_TO_LETTERS)[:bases] or "*"
    at += packed
    quals = data[at : at + bases]
    if len(quals) < bases:
        raise FormatError("a record is cut short")
    qual = [] if quals[:1] == b"\xff" else list(quals)
    tags = _tags_of(data[at + bases :])
    return (name, flags, ref, names[ref] if ref >= 0 else "*", pos, mapq, cigar, mate, names[mate] if mate >= 0 else "*", mate_pos, template, seq, qual, tags)


_OPERATION = re.compile(r"(\d+)([MIDNSHP=X])")


def _bin(start: int, limit: int) -> int:
    """The number of the smallest of the nested ranges (512 Mb down to 16 kb) that holds [start, limit)."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (limit - 1) >> shift:
            return first + (start >> shift)
    return 0


def encode_record(row: Row | dict, numbers: dict[str, int]) -> bytes:
    """A row as the bytes of a record, size first.  References are found by name; null fields take their empty values."""
    r = row if isinstance(row, dict) else row.asDict()
    name, cigar, seq = r.get("read_name") or "*", r.get("cigar") or "*", r.get("seq") or "*"
    ops = [(int(n), CIGAR_OPS.index(o)) for n, o in _OPERATION.findall(cigar)]
    letters = "" if seq == "*" else seq
    ref, mate = (numbers.get(r.get(c) or "*", -1) for c in ("ref_name", "mate_ref_name"))
    pos, mate_pos = (-1 if r.get(c) is None else r[c] for c in ("pos", "mate_pos"))
    span = sum(n for n, o in ops if CIGAR_OPS[o] in "MDN=X")
    digits = letters.translate(_TO_DIGITS)
    if re.search("[^0-9a-f]", digits):
        raise FormatError(f"{name}: letters that are no bases")
    quals = r.get("qual") or []
    if quals and len(quals) != len(letters):
        raise FormatError(f"{name}: unequal numbers of bases and qualities")
    place = _bin(max(pos, 0), max(pos, 0) + max(span, 1)) if pos >= 0 else 4680
    body = [
        _FIXED.pack(ref, pos, len(name) + 1, r.get("mapq") or 0, place, len(ops), r.get("flags") or 0, len(letters), mate, mate_pos, r.get("template_length") or 0),
        name.encode() + b"\0",
        struct.pack(f"<{len(ops)}I", *[n << 4 | o for n, o in ops]),
        bytes.fromhex(digits + "0" * (len(digits) % 2)),
        bytes(quals) if quals else b"\xff" * len(letters),
        *[_tag_bytes(t) for t in r.get("tags") or []],
    ]
    data = b"".join(body)
    return struct.pack("<i", len(data)) + data


def raw_records(reader: BlockReader, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, bytes) of the records that begin before the virtual offset ``end``."""
    while True:
        at = reader.tell()
        if end is not None and at >= end:
            return
        size = reader.read(4)
        if not size:
            return
        n = struct.unpack("<i", size)[0] if len(size) == 4 else -1
        data = reader.read(n) if n >= 32 else b""
        if len(data) != n:
            raise FormatError(f"a record is cut short at {at}")
        yield at, data


# Indexes


class Entry(NamedTuple):
    """Where the first record at a coordinate lies; reference -1 is unmapped and last."""

    ref_id: int
    pos: int
    seq: int
    offset: int


def _order(e: Entry) -> tuple[int, int, int]:
    return (e.ref_id if e.ref_id >= 0 else 1 << 31, e.pos, e.seq)


def build_gbai(path: str, interval: int = 65_536) -> list[Entry]:
    """Entries of a sorted file: the first record of each reference, then the first of a position once ``interval``
    compressed bytes have passed since the last entry."""
    out: list[Entry] = []
    last: tuple[int, int] | None = None
    with open_binary(path) as f:
        reader = BlockReader(f)
        read_header(reader)
        for at, data in raw_records(reader):
            here = struct.unpack_from("<ii", data)
            fresh = last is None or here[0] != last[0]
            if fresh or (here[1] != last[1] and (at >> 16) - (out[-1].offset >> 16) >= interval):
                out.append(Entry(*here, 0, at))
            last = here
    return out


def write_gbai(entries: Sequence[Entry], path: str) -> None:
    with open_binary(path, "wb") as f:
        f.write(gzip.compress(GBAI_MAGIC + b"".join(struct.pack("<iiIQ", *e) for e in entries)))


def read_gbai(path: str) -> list[Entry]:
    """Entries of an index; places and offsets that don't increase are an error."""
    with open_binary(path) as f:
        data = gzip.decompress(f.read())
    if data[:16] != GBAI_MAGIC or (len(data) - 16) % 20:
        raise FormatError(f"{path}: not an index")
    out = [Entry(*x) for x in struct.iter_unpack("<iiIQ", data[16:])]
    for a, b in zip(out, out[1:], strict=False):
        if _order(a) >= _order(b) or a.offset >= b.offset:
            raise FormatError(f"{path}: entries out of order")
    return out


def offset_before(entries: Sequence[Entry], ref_id: int, pos: int, seq: int = 0) -> int:
    """The offset of the last entry at or before a coordinate; of the first entry if there is none."""
    from bisect import bisect_right

    if not entries:
        raise ValueError("an index without entries")
    at = bisect_right(entries, _order(Entry(ref_id, pos, seq, 0)), key=_order)
    return entries[max(at - 1, 0)].offset


@dataclass
class BinIndex:
    """A binned index: by reference the chunks of each bin, the offsets of 16 kb windows, the counts; reads without a place."""

    chunks: list[dict[int, list[tuple[int, int]]]]
    windows: list[list[int]]
    counts: list[tuple[int, int, int, int] | None]
    unplaced: int | None

    def offsets(self) -> list[list[int]]:
        """By reference all places where reading may begin, in order, each once."""
        both = zip(self.chunks, self.windows, strict=True)
        return [sorted({b for c in bins.values() for b, _ in c if b} | {w for w in windows if w}) for bins, windows in both]


def read_bai(path: str) -> BinIndex:
    with open_binary(path) as f:
        data = f.read()
    if data[:4] != BAI_MAGIC:
        raise FormatError(f"{path}: not an index")
    at = 4

    def take(code: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(f"<{code}", data, at)
        at += struct.calcsize(f"<{code}")
        return out

    index = BinIndex([], [], [], None)
    for _ in range(take("i")[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        counts = None
        for _ in range(take("i")[0]):
            number, n = take("Ii")
            pairs = [take("QQ") for _ in range(n)]
            if number == META_BIN:
                counts = (*pairs[0], *pairs[1])
            else:
                bins[number] = pairs
        index.chunks.append(bins)
        index.counts.append(counts)
        index.windows.append(list(take(f"{take('i')[0]}Q")))
    if at + 8 <= len(data):
        index.unplaced = take("Q")[0]
    return index


def coordinate_at(path: str, offset: int) -> tuple[int, int]:
    """(ref_id, pos) of the record at a virtual offset; (0, 0) at the file's beginning, position 0 for unmapped reads."""
    if not offset:
        return 0, 0
    with open_binary(path) as f:
        for _, data in raw_records(BlockReader(f, offset)):
            ref, pos = struct.unpack_from("<ii", data)
            return ref, 0 if ref < 0 else pos
    raise FormatError(f"{path}: no record at {offset}")


# Scan


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class BamSource(DataSource):
    """spark.read.format("bam").load(path): rows of SCHEMA.  Option index: a .gbai file (else the path with .gbai, if it exists)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _BamReader(self.options["path"], self.options.get("index"))

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _BamWriter(self.options["path"], self.options.get("header", ""), self.options.get("single", "true").lower() == "true")


class _BamReader(DataSourceReader):
    def __init__(self, path: str, index: str | None):
        self.path, self.index = path, index

    def partitions(self) -> list[InputPartition]:
        index = self.index or (f"{self.path}.gbai" if exists(f"{self.path}.gbai") else None)
        if index is None:
            return [_Part(self.path, 0, None)]
        cuts = [e.offset for e in read_gbai(index)]
        return [_Part(self.path, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)] or [_Part(self.path, 0, None)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names = header_of(partition.path).names
        with open_binary(partition.path) as f:
            reader = BlockReader(f, partition.begin)
            if not partition.begin:
                read_header(reader)
            rows: list[tuple] = []
            for _, data in raw_records(reader, partition.end):
                rows.append(decode_record(data, names))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


_ARROW = pa.schema(
    [(n, pa.list_(pa.int32()) if n == "qual" else pa.list_(pa.string()) if n == "tags" else pa.string() if k == "string" else pa.int32()) for n, k in (x.split(" ", 1) for x in SCHEMA.split(", "))]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_bam(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """Records of a binary file, a task for each entry of its index."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam")
    return (reader.option("index", index) if index else reader).load(path)


# Sink


@dataclass
class _Written(WriterCommitMessage):
    part: int
    path: str


class _BamWriter(DataSourceArrowWriter):
    """Every task packs its rows into blocks of a file of its own; the commit sets header, parts and the last block."""

    def __init__(self, path: str, header: str, single: bool):
        self.path, self.header, self.single = path, header, single

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        assert context is not None
        header = sam_header(self.header)
        numbers = {n: i for i, n in enumerate(header.names)}
        folder = f"{self.path}.parts" if self.single else self.path
        if "://" not in folder:
            os.makedirs(folder, exist_ok=True)
        name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.bam"
        with open_binary(name, "wb") as f:
            out = BlockWriter(f)
            if not self.single:
                out.write(header_bytes(header))
            for part in iterator:
                for row in part.to_pylist():
                    out.write(encode_record(row, numbers))
            out.finish(last=not self.single)
        return _Written(context.partitionId(), name)

    def commit(self, messages: list) -> None:
        if not self.single:
            return
        with open_binary(self.path, "wb") as f:
            head = BlockWriter(f)
            head.write(header_bytes(sam_header(self.header)))
            head.finish(last=False)
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
                with open_binary(m.path) as part:
                    while piece := part.read(1 << 24):
                        f.write(piece)
            f.write(LAST_BLOCK)
        self._remove(messages)

    def abort(self, messages: list) -> None:
        self._remove(messages)

    def _remove(self, messages: list) -> None:
        for m in messages:
            if m is not None and "://" not in m.path and os.path.exists(m.path):
                os.remove(m.path)
        if self.single and os.path.isdir(f"{self.path}.parts") and not os.listdir(f"{self.path}.parts"):
            os.rmdir(f"{self.path}.parts")


def write_bam(reads: DataFrame, path: str, header: Header, single: bool = True) -> None:
    """Records in their order as a binary file, or (``single`` false) as a folder of such files, one a task.

    The parts are packed by all tasks; the commit of a single file copies them one after the other.
    """
    spark = reads.sparkSession
    spark.dataSource.register(BamSource)
    lines = [x for x in header.text.splitlines() if x and not x.startswith("@SQ")] + [f"@SQ\tSN:{n}\tLN:{x}" for n, x in header.references]
    text = "".join(f"{x}\n" for x in sorted(lines, key=lambda x: (not x.startswith("@HD"), not x.startswith("@SQ"))))
    reads.write.format("bam").option("header", text).option("single", str(single)).mode("append").save(path)


# Paths that name a range of coordinates

_INFINITE_REF, _INFINITE_POS = -1, 2_147_483_647


def coordinate_path(ref_id: int, pos: int, seq: int = 0) -> str:
    """`ref:pos` or `ref:pos:seq`, `-` for the last reference and position."""
    parts = ["-" if ref_id == _INFINITE_REF else str(ref_id), "-" if pos == _INFINITE_POS else str(pos)]
    return ":".join(parts + ([str(seq)] if seq else []))


def range_path(start: tuple[int, int, int], limit: tuple[int, int, int]) -> str:
    return f"{coordinate_path(*start)},{coordinate_path(*limit)}"


_RANGE_PATH = re.compile(r"(-|\d+):(-|\d+)(?::(\d+))?,(-|\d+):(-|\d+)(?::(\d+))?\.([A-Za-z0-9_]+)$")


def parse_range_path(path: str) -> tuple[tuple[int, int, int], tuple[int, int, int], str] | None:
    """(start, limit, field) of a path `start,limit.field`; None if it is none."""
    m = _RANGE_PATH.search(path)
    if m is None:
        return None
    numbers = [(_INFINITE_REF if r == "-" else int(r), _INFINITE_POS if p == "-" else int(p), int(s or 0)) for r, p, s in (m.groups()[:3], m.groups()[3:6])]
    return numbers[0], numbers[1], m[7]


def intersecting_files(paths: Sequence[str], start: tuple[int, int, int], limit: tuple[int, int, int], kind: str = "index") -> list[str]:
    """Of the paths of one field those whose range meets [start, limit), in the order of their ranges."""

    def key(c: tuple[int, int, int]) -> tuple[int, int, int]:
        return (c[0] if c[0] >= 0 else 1 << 31, c[1], c[2])

    found = [(parsed, p) for p in paths if (parsed := parse_range_path(p)) and parsed[2] == kind]
    return [p for (a, b, _), p in sorted(found, key=lambda x: key(x[0][0])) if key(a) < key(limit) and key(start) < key(b)]
