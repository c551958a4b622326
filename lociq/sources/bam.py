"""Binary alignments as a data source (S01): a partition for each stretch of the file that
holds what was asked for.

The index beside the file (path + '.bai') gives places where records begin. A whole read
is cut at these into partitions of about `partitionBytes` compressed bytes; a read of
regions takes the chunks of their bins and opens nothing else. Equalities on `rname` are
pushed down as whole contigs. Without an index a file is one partition. Rows are those
that `read_sam` gives for the same records.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from lociq.sources.blocks import Index, Reader, opened

SCHEMA = "sample string, qname string, flag int, rname string, pos bigint, mapq int, cigar string, seq string, qual string, tags map<string,string>"
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
PAIRS = [a + b for a in BASES for b in BASES]
#: Letters of numeric tag types and of their formats (fixed values of the format).
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
ON_REFERENCE = frozenset("MDN=X")
WHOLE = 1 << 29
ROWS = 4096


def header(reader: Reader) -> tuple[str, list[tuple[str, int]]]:
    """(header text, (name, length) of the contigs); the reader is left at the first record."""
    if reader.read(4) != b"BAM\1":
        raise ValueError("no binary alignments")
    text = reader.read(struct.unpack("<i", reader.read(4))[0]).decode().rstrip("\0")
    contigs = []
    for _ in range(struct.unpack("<i", reader.read(4))[0]):
        name = reader.read(struct.unpack("<i", reader.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", reader.read(4))[0]))
    return text, contigs


def number(x) -> str:
    return f"{x:g}" if isinstance(x, float) else str(x)


def tags_of(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(0, at)
            value, at = data[at:stop].decode(), stop + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[of]}", data, at + 5)
            value, at = ",".join([of, *map(number, values)]), at + 5 + struct.calcsize(f"<{n}{NUMBERS[of]}")
        else:
            value, at = number(struct.unpack_from(f"<{NUMBERS[kind]}", data, at)[0]), at + struct.calcsize(NUMBERS[kind])
        out.append((name, value))
    return out


def record(data: bytes, names: list[str]) -> tuple:
    """(row without sample, contig, start, end) of a record."""
    contig, pos, name_bytes, mapq, _, n_ops, flag, n_bases = struct.unpack_from("<iiBBHHHi", data)
    at = 32 + name_bytes
    name = data[32 : at - 1].decode()
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*"
    end = pos + sum(o >> 4 for o in ops if OPERATIONS[o & 15] in ON_REFERENCE)
    half = (n_bases + 1) // 2
    seq = "".join(map(PAIRS.__getitem__, data[at : at + half]))[:n_bases] or "*"
    at += half
    qual = data[at : at + n_bases]
    qual = "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    return (name, flag, names[contig] if contig >= 0 else "*", pos, mapq, cigar, seq, qual, tags_of(data[at + n_bases :])), contig, pos, max(end, pos + 1)


class Stretch(InputPartition):
    def __init__(self, begin: int, end: int | None, regions: list | None):
        self.begin, self.end, self.regions = begin, end, regions


def parsed(regions: str) -> list[tuple[str, int, int]]:
    """(contig, start, end) of 'chr1:1,000-2,000 chr2', 1-based and closed as written."""
    out = []
    for text in regions.split():
        m = re.fullmatch(r"(.+?)(?::([\d,]+)-([\d,]+))?", text)
        at = [int(x.replace(",", "")) if x else None for x in m.groups()[1:]]
        out.append((m[1], (at[0] or 1) - 1, at[1] or WHOLE))
    return out


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sample = options["path"], options.get("sample")
        self.index = options.get("index", f"{self.path}.bai")
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 1 << 25)))
        self.regions = parsed(options["regions"]) if options.get("regions") else None

    def pushFilters(self, filters) -> Iterator:
        """Contigs that a filter names are regions; the filter itself stays with Spark."""
        for f in filters:
            names = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("rname",) and self.regions is None and "*" not in names:
                self.regions = [(n, 0, WHOLE) for n in sorted({n for n in names if n is not None})]
            yield f

    def partitions(self) -> list[Stretch]:
        reader = Reader(self.path)
        _, contigs = header(reader)
        first = reader.at
        reader.close()
        try:
            with opened(self.index) as f:
                index = Index.unpacked(f.read())
        except FileNotFoundError:
            wanted = None if self.regions is None else self._numbered(contigs)
            return [Stretch(first, None, wanted)]
        if self.regions is None:
            cuts = [first]
            for at in index.starts():
                if (at >> 16) - (cuts[-1] >> 16) >= self.bytes:
                    cuts.append(at)
            return [Stretch(a, b, None) for a, b in zip(cuts, [*cuts[1:], None])]
        stretches: list[list] = []
        for contig, start, end in self._numbered(contigs):
            for begin, past in index.chunks(contig, start, end):
                stretches.append([begin, past])
        joined: list[list] = []
        for begin, past in sorted(stretches):  # regions that meet are read once
            if joined and begin <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], past)
            else:
                joined.append([begin, past])
        return [Stretch(a, b, self._numbered(contigs)) for a, b in joined] or [Stretch(0, 0, [])]

    def _numbered(self, contigs: list) -> list[tuple[int, int, int]]:
        place = {name: i for i, (name, _) in enumerate(contigs)}
        return [(place[c], s, e) for c, s, e in self.regions if c in place]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if part.end == 0:
            return
        first = Reader(self.path)
        names = [n for n, _ in header(first)[1]]
        first.close()
        reader, rows = Reader(self.path, part.begin, part.end), []
        while reader.more():
            row, contig, start, end = record(reader.read(struct.unpack("<i", reader.read(4))[0]), names)
            if part.regions is None or any(c == contig and start < e and s < end for c, s, e in part.regions):
                rows.append((self.sample, *row))
            if len(rows) >= ROWS:
                yield batch(rows)
                rows = []
        reader.close()
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    text, small, large = pa.string(), pa.int32(), pa.int64()
    kinds = (text, text, small, text, large, small, text, text, text, pa.map_(text, text))
    names = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, sample: str | None = None, regions: str | None = None, partition_bytes: int = 1 << 25) -> DataFrame:
    """Records of a file of binary alignments, of all or of those that overlap regions
    ('chr1:100-200 chr2'), in the columns of `read_sam`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    reader = spark.read.format("alignments").option("path", path).option("partitionBytes", str(partition_bytes))
    reader = reader.option("sample", sample) if sample is not None else reader
    return (reader.option("regions", regions) if regions else reader).load()


def read_bam_groups(spark: SparkSession, path: str) -> DataFrame:
    """Read groups of the header (S18), which alone is read."""
    reader = Reader(path)
    text, _ = header(reader)
    reader.close()
    rows = []
    for line in text.split("\n"):
        if line.startswith("@RG"):
            fields = dict(f.split(":", 1) for f in line.split("\t")[1:])
            rows.append((fields.get("ID", ""), fields.get("SM", "")))
    return spark.createDataFrame(rows, "group_id string, sample string")
