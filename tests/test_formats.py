import pytest
from pyspark.sql import functions as F

from lociq.sources import sinks, text_formats
from lociq.streaming import depth

FAI = "chr1\t1000\t6\t60\t61\nchr2\t800\t6\t60\t61\nchrX\t10\t6\t60\t61\n"


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def test_bed_and_contig_ids(spark, put):
    bed = text_formats.read_bed(spark, put("a.bed", "# c\ntrack x\nchr2\t5\t9\tn\t1\t+\n\nchr1\t7\t7\nchr9\t1\t2\n"), widen_empty=True)
    fai = text_formats.read_fai(spark, put("r.fai", FAI))
    assert [(r.line, r.chr, r.start, r.end, r.name) for r in bed.orderBy("line").collect()] == [(0, "chr2", 5, 9, "n"), (1, "chr1", 7, 8, None), (2, "chr9", 1, 2, None)]
    assert {(r.chr, r.chr_id) for r in text_formats.with_contig_ids(bed, fai).collect()} == {("chr1", 0), ("chr2", 1)}
    with pytest.raises(KeyError, match="chr9"):
        text_formats.with_contig_ids(bed, fai, pedantic=True)


def test_sam(spark, put):
    sam = put("a.sam", "@HD\tVN:1.6\n@RG\tID:g\tSM:me\nq\t16\tchr1\t11\t60\t5M\t*\t0\t0\tACGTA\tIIIII\tSA:Z:x,1\tNM:i:3\n")
    row = text_formats.read_sam(spark, sam, "me").first()
    assert (row.pos, row.mapq, row.cigar, row.tags) == (10, 60, "5M", {"SA": "x,1", "NM": "3"})
    assert text_formats.read_groups(spark, sam).first().sample == "me"


def test_vcf_there_and_back(spark, put, tmp_path):
    calls = spark.createDataFrame([(1, "chr1", 99, 150, "DEL", 51, "PASS", "ACG", "A", ["s:1.0"], True), (2, "chr1", 10, 10, "INS", 5, "LowQual", "A", "ACCCCC", ["s:2.0"], False)], "call_id bigint, chr string, start bigint, end bigint, svtype string, svlen bigint, filter string, ref string, alt string, consensus_ids array<string>, precise boolean")
    gts = spark.createDataFrame([(1, "a", "0/1", 30, 10, 5, 5, 0.99)], "call_id bigint, sample string, gt string, gq int, tc int, dr int, dv int, gp double")
    sinks.write_vcf(sinks.vcf_lines(calls, gts, ["a", "b"]), sinks.vcf_header(["a", "b"], [("chr1", 1000)]), str(tmp_path / "v"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*")))
    vcf = text_formats.read_vcf(spark, put("v.vcf", text)).collect()
    assert {(r.pos, r.sample, r.gt) for r in vcf} == {(100, "a", "0/1"), (100, "b", "0/0"), (11, "a", "0/0"), (11, "b", "0/0")}
    assert {r.info["END"] for r in vcf if r.pos == 100} == {"151"} and "PRECISE" in [r for r in vcf if r.pos == 100][0].info
    assert {r.pos for r in text_formats.read_vcf(spark, put("p.vcf", text), only_pass=True).collect()} == {100}


def test_fasta(spark, put):
    seq = "ACGT" * 60
    path = put("r.fa", f">chr1 text\n{seq[:100]}\n{seq[100:]}\n>chr2\nGG\n")
    chunks = text_formats.read_fasta(spark, path, chunk=64)
    regions = spark.createDataFrame([(1, "chr1", 60, 200), (2, "chr2", 0, 2), (3, "chr1", 0, 240)], "region_id bigint, chr string, start bigint, end bigint")
    got = {r.region_id: r.seq for r in text_formats.fetch(regions, chunks, chunk=64).collect()}
    assert got == {1: seq[60:200], 2: "GG", 3: seq}
    rows = spark.createDataFrame([("x", "A" * 170)], "name string, seq string")
    assert rows.select(sinks.fasta_record("name", "seq")).first()[0].split("\n") == [">x", "A" * 80, "A" * 80, "A" * 10]


def test_ped_and_ids(spark, put):
    assert text_formats.read_ped(spark, put("a.ped", "f c p m 1 2\n")).first().father == "p"
    with pytest.raises(Exception, match="six columns"):
        text_formats.read_ped(spark, put("b.ped", "f c p\n")).collect()
    rows = spark.createDataFrame([("s:12.3",), ("bad",)], "id string")
    assert [tuple(r) for r in rows.select(*text_formats.consensus_parts("id")).collect()] == [("s", 12, 3), (None, None, None)]
    assert tuple(spark.range(1).select(*text_formats.parse_region(F.lit("chr1:1,000-2,000"))).first()) == ("chr1", 1000, 2000)


def test_log_lines(spark, put):
    log = put("a.log", "x DROPPED crID=5 why\nTRANSFORMED crIDs={1, 2}\nother crID=9\n")
    assert [sorted(r.region_ids) for r in text_formats.log_lines(spark, log).collect()] == [[5], [1, 2]]


def test_breakend_forms(spark):
    rows = spark.createDataFrame([("A", "2", 9, a, b) for a in (False, True) for b in (True, False)], "r string, c string, p bigint, first boolean, fwd boolean")
    assert [r[0] for r in rows.select(sinks.breakend_alt("r", "c", "p", "first", "fwd")).collect()] == ["A[2:9[", "A]2:9]", "[2:9[A", "]2:9]A"]


def test_filters_keep_an_account(spark):
    kept, dropped = sinks.filtered(spark.range(5), F.when(F.col("id") < 4, F.col("id") > 1), "size", "too small")
    assert kept.count() == 2 and {(r.id, r.reason) for r in dropped.collect()} == {(0, "too small"), (1, "too small"), (4, "too small")}


def test_sorted_tables_and_tracks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", 5, 9, 1.5), (0, "a", 7, 8, float("nan"))], "chr_id bigint, chr string, start bigint, end bigint, v double")
    sinks.write_sorted(df, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    sinks.write_bedgraph(df, str(tmp_path / "g"), "v")
    assert [r.value for r in spark.read.text(str(tmp_path / "g")).collect()] == ["b\t5\t9\t1.5"]
    sinks.write_tile({"t": df}, str(tmp_path / "tile"), "me")
    assert spark.read.parquet(str(tmp_path / "tile/t")).first().sample == "me"


def test_streams_reach_the_batch_result(spark, tmp_path):
    rows = spark.createDataFrame([("c", 0, 1500), ("c", 900, 950), ("d", 5, 5)], "chr string, start bigint, end bigint")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = depth.depth_by_bin(stream).writeStream.format("memory").queryName("depths").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("depths").collect()} == {tuple(r) for r in depth.depth_by_bin(rows).collect()} == {("c", 0, 2), ("c", 1, 1), ("d", 0, 1)}


def test_entry_survives_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).parent.parent
    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[-1] == "False", said.stderr
