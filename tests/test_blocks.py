"""Block-compressed alignments and text, and byte ranges, against plain reading."""

import gzip
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from lociq.sources import bam, blocks, ranges, text_formats

CONTIGS = [("chr1", 3_000_000), ("chr2", 400_000), ("chr3", 1000)]


def sam_lines(rng, n):
    out = []
    for i in range(n):
        contig = rng.choice([0, 0, 0, 1])
        m, d = rng.randint(20, 400), rng.randint(1, 3000)
        cigar, bases = (f"{m}M{d}D{m}M5I3S", 2 * m + 8) if i % 3 else (f"{m}M", m)
        pos = rng.randrange(CONTIGS[contig][1] - 5000)
        seq, qual = ("".join(rng.choice("ACGTN") for _ in range(bases)), "".join(chr(33 + rng.randrange(40)) for _ in range(bases))) if i % 7 else ("*", "*")
        tags = [f"NM:i:{i - 5}", "RG:Z:g 1", "AS:f:1.5", "XB:B:s,1,-2,3", "XA:A:c"][: i % 6]
        out.append((contig, pos, [f"r{i}", str(rng.choice([0, 16, 256, 2064])), CONTIGS[contig][0], str(pos + 1), str(i % 61), cigar, "*", "0", "0", seq, qual, *tags]))
    out.sort(key=lambda x: x[:2])
    return [*out, (-1, -1, ["lost", "4", "*", "0", "0", "*", "*", "0", "0", "ACGTA", "IIIII"])]


def packed(contig, pos, f):
    """A record as its bytes, and its end."""
    ops = [(int(n), bam.OPERATIONS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", f[5])]
    end = max(pos + sum(n for n, o in ops if bam.OPERATIONS[o] in bam.ON_REFERENCE), pos + 1)
    seq = "" if f[9] == "*" else f[9]
    codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", contig, pos, len(f[0]) + 1, int(f[4]), blocks.bin_of(max(pos, 0), max(end, 1)), len(ops), int(f[1]), len(seq), -1, -1, 0)
    body += f[0].encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body += bytes(ord(c) - 33 for c in f[10]) if seq and f[10] != "*" else b"\xff" * len(seq)
    for tag in f[11:]:
        name, kind, value = tag.split(":", 2)
        if kind in "ZH":
            data = value.encode() + b"\0"
        elif kind == "A":
            data = value.encode()
        elif kind == "B":
            of, *values = value.split(",")
            data = of.encode() + struct.pack(f"<i{len(values)}{bam.NUMBERS[of]}", len(values), *map(int, values))
        else:
            data = struct.pack(f"<{kind}", float(value) if kind == "f" else int(value))
        body += name.encode() + kind.encode() + data
    return struct.pack("<i", len(body)) + body, end


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("alignments")
    rng = random.Random(1)
    lines = sam_lines(rng, 3000)
    head = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{m}\n" for n, m in CONTIGS) + "@RG\tID:g 1\tSM:one\n"
    (folder / "x.sam").write_text(head + "".join("\t".join(f) + "\n" for *_, f in lines))
    writer, index = blocks.Writer(), blocks.Index()
    writer.write(b"BAM\1" + struct.pack("<i", len(head)) + head.encode() + struct.pack("<i", len(CONTIGS)))
    for name, n in CONTIGS:
        writer.write(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n))
    writer.flush()
    for contig, pos, f in lines:
        data, end = packed(contig, pos, f)
        begin = writer.at
        writer.write(data)
        if contig >= 0:
            index.add(contig, pos, end, begin, writer.at)
    (folder / "x.bam").write_bytes(writer.close())
    (folder / "x.bam.bai").write_bytes(index.packed(len(CONTIGS)))
    (folder / "bare.bam").write_bytes((folder / "x.bam").read_bytes())
    return str(folder)


def rows_of(df):
    return sorted(tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in df.collect())


def test_blocks_are_gzip_and_offsets_hold():
    rng, writer, at = random.Random(2), blocks.Writer(), {}
    lines = [("x" * rng.randrange(3000) + str(i)).encode() + b"\n" for i in range(400)]
    for i, line in enumerate(lines):
        at[i] = writer.at
        writer.write(line)
    data = writer.close()
    assert gzip.decompress(data) == b"".join(lines)
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".gz") as f:
        f.write(data)
        f.flush()
        for i in (0, 7, 399, 200):
            assert blocks.Reader(f.name, at[i]).line() == lines[i]
        some = blocks.Reader(f.name, at[50], at[60])
        found = []
        while some.more():
            found.append(some.line())
        assert found == lines[50:60]


def test_bins_hold_what_overlaps():
    rng = random.Random(3)
    for _ in range(3000):
        a = sorted(rng.randrange(1 << rng.randint(1, 29)) for _ in range(2))
        b = sorted(rng.randrange(1 << rng.randint(1, 29)) for _ in range(2))
        if a[0] < max(b[1], b[0] + 1) and b[0] < max(a[1], a[0] + 1):
            assert blocks.bin_of(*a) in set(blocks.bins_over(*b))


def test_whole_bam_equals_sam(spark, files):
    wanted = rows_of(text_formats.read_sam(spark, f"{files}/x.sam", "s"))
    for size, parts in ((1 << 12, 20), (1 << 16, 10), (1 << 30, 1)):
        df = bam.read_bam(spark, f"{files}/x.bam", "s", partition_bytes=size)
        assert rows_of(df) == wanted and parts <= df.rdd.getNumPartitions() <= 2 * parts - 1
    assert rows_of(bam.read_bam(spark, f"{files}/bare.bam", "s")) == wanted
    assert [tuple(r) for r in bam.read_bam_groups(spark, f"{files}/x.bam").collect()] == [("g 1", "one")]


def test_regions_open_only_their_chunks(spark, files):
    from lociq.operators.signals import located

    whole = located(text_formats.read_sam(spark, f"{files}/x.sam")).select("qname", "rname", "ref_start", "ref_end").collect()
    for text in ("chr1:100,001-160,000", "chr2:1-5000 chr1:2000000-2000100", "chr2", "chr3", "none:5-6"):
        regions = bam.parsed(text)
        wanted = sorted(r.qname for r in whole if any(r.rname == c and r.ref_start < e and s < max(r.ref_end, r.ref_start + 1) for c, s, e in regions))
        assert sorted(r.qname for r in bam.read_bam(spark, f"{files}/x.bam", regions=text).collect()) == wanted
        assert sorted(r.qname for r in bam.read_bam(spark, f"{files}/bare.bam", regions=text).collect()) == wanted
    reader = bam.BamReader({"path": f"{files}/x.bam", "regions": "chr1:1,500,000-1,520,000"})
    size = len(open(f"{files}/x.bam", "rb").read())
    assert all(p.end for p in reader.partitions()) and sum((p.end >> 16) - (p.begin >> 16) for p in reader.partitions()) < 0.2 * size
    pushed = bam.BamReader({"path": f"{files}/x.bam"})
    list(pushed.pushFilters([bam.EqualTo(("rname",), "chr2")]))
    assert all((p.begin >> 16) > size // 2 for p in pushed.partitions())
    df = bam.read_bam(spark, f"{files}/x.bam").where("rname = 'chr2' AND mapq > 30")
    assert rows_of(df) == rows_of(text_formats.read_sam(spark, f"{files}/x.sam").where("rname = 'chr2' AND mapq > 30"))


def test_fasta_ranges_equal_whole_reading(spark, tmp_path):
    rng = random.Random(4)
    contigs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((1, 59, 60, 61, 5000))}
    path, fai, at = str(tmp_path / "x.fa"), [], 0
    with open(path, "w") as f:
        for name, seq in contigs.items():
            at += f.write(f">{name} some words\n")
            fai.append((name, len(seq), at, 60, 61))
            for i in range(0, len(seq), 60):
                at += f.write(seq[i : i + 60] + "\n")
    (tmp_path / "x.fa.fai").write_text("".join("\t".join(map(str, r)) + "\n" for r in fai))
    asked = []
    for _ in range(60):
        name = rng.choice(list(contigs))
        s = rng.randrange(len(contigs[name]) + 1)
        asked.append((len(asked), name, s, s + rng.choice([0, 1, 60, 61, 200, 9000])))
    regions = spark.createDataFrame([*asked, (99, "none", 0, 5)], "region_id bigint, chr string, start bigint, end bigint")
    index = text_formats.read_fai(spark, f"{path}.fai")
    got = {r.region_id: r.seq for r in ranges.fetch_fasta(regions, index, path).collect()}
    assert got == {i: contigs[c][s:e] for i, c, s, e in asked}
    whole = {r.region_id: r.seq for r in text_formats.fetch(regions, text_formats.read_fasta(spark, path, 100), 100).collect()}
    assert {i: s for i, s in got.items() if s} == {i: s for i, s in whole.items() if s}
    read = ranges.fasta_ranges(regions, index, path).agg(F.sum("length")).first()[0]
    assert read <= 1.02 * sum(map(len, got.values())) + 60


def test_offset_index(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    lines = ['{"id": %d, "text": "%s"}' % (i, "é" * (i % 50)) for i in range(500)]
    open(path, "w").write("\n".join(lines) + "\n")
    index = ranges.offset_index(spark, path, F.get_json_object("value", "$.id").cast("bigint"))
    wanted = index.where("key IN (0, 7, 499)")
    assert {r.key: r.text for r in ranges.read_ranges(wanted, ("key",)).collect()} == {i: lines[i] for i in (0, 7, 499)}


def test_indexed_text_gives_the_lines_of_a_region(spark, tmp_path):
    rng, path = random.Random(6), str(tmp_path / "out")
    rows = [(rng.choice("ab"), s := rng.randrange(2_000_000), s + rng.choice([0, 5, 300, 90_000]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "chr string, start bigint, end bigint, id bigint")
    ranges.write_indexed(df, path, F.concat_ws("\t", "chr", "start", "end", "id", F.expr("repeat('x', 60)")), parts=3)
    text = [line for k in range(3) for line in gzip.open(f"{path}/part-{k:05d}.gz", "rt").read().splitlines()]
    assert [tuple(x.split("\t")[:3]) for x in text] == [(c, str(s), str(e)) for c, s, e, _ in sorted(rows)]
    asked = [(0, "a", 500_000, 500_500), (1, "b", 0, 100), (2, "b", 1_999_000, 3_000_000), (3, "z", 0, 10**6)]
    regions = spark.createDataFrame(asked, "region_id bigint, chr string, start bigint, end bigint")
    found = ranges.read_indexed(spark, path, regions).collect()
    place = lambda x: (x.split("\t")[0], *map(int, x.split("\t")[1:4]))
    for i, c, s, e in asked:
        own = [place(r.line) for r in found if r.region_id == i]
        meets = lambda r: r[0] == c and r[1] < e and s < max(r[2], r[1] + 1)  # noqa: B023, E731
        assert sorted(filter(meets, own)) == sorted(filter(meets, rows)) and len(own) < 1200
