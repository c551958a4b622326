"""Genomic text formats as DataFrames.

Plain and gzipped files are read alike, by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociq.operators.intervals import range_join, running_sum
from lociq.operators.signals import SIGNAL

BED = "chr string, start bigint, end bigint, name string, score string, strand string"
FAI = "chr string, length bigint, offset bigint, line_bases bigint, line_width bigint"
PED = ("family", "individual", "father", "mother", "sex", "phenotype")


def line_numbers(lines: DataFrame, name: str = "line") -> DataFrame:
    """Numbers rows from 0 in file order without moving them: places within partitions,
    plus the counts of the partitions before."""
    placed = lines.withColumn("_id", F.monotonically_increasing_id())
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    marked = placed.withColumns({"_part": part, "_local": local})
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per input split
    before = F.coalesce(F.expr("sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    return marked.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_id", "_part", "_local", "_n", "_before")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of a reference index; chr_id is their order in the file."""
    return line_numbers(spark.read.csv(path, sep="\t", schema=FAI), "chr_id")


def read_bed(spark: SparkSession, path: str, widen_empty: bool = False) -> DataFrame:
    """BED lines without comments and blank lines, numbered in file order.
    widen_empty: intervals of no length get one base."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT (value LIKE '#%' OR value LIKE 'track%' OR value LIKE 'browser%')")
    f = F.split("value", "\t")
    bed = line_numbers(lines).select("line", f[0].alias("chr"), f[1].cast("bigint").alias("start"), f[2].cast("bigint").alias("end"), F.get(f, F.lit(3)).alias("name"), F.get(f, F.lit(4)).alias("score"), F.get(f, F.lit(5)).alias("strand"))
    return bed.withColumn("end", F.greatest("end", F.col("start") + 1)) if widen_empty else bed


def with_contig_ids(df: DataFrame, fai: DataFrame, pedantic: bool = False) -> DataFrame:
    """Adds chr_id; rows of unknown contigs go, or raise where pedantic."""
    if pedantic:
        unknown = [r.chr for r in df.select("chr").distinct().join(fai, "chr", "left_anti").limit(10).collect()]
        if unknown:
            raise KeyError(f"contigs not in the reference: {', '.join(map(str, unknown))}")
    return df.join(fai.select("chr", "chr_id"), "chr")


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    """Family lines; each must have six columns."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'").select(f.alias("f"))
    checked = lines.withColumn("f", F.when(F.size("f") == 6, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not six columns: "), F.array_join("f", " ")))))
    return checked.select(*(F.col("f")[i].alias(c) for i, c in enumerate(PED)))


def read_sam(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Alignment lines of SAM text; pos becomes 0-based."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where("value NOT LIKE '@%' AND value <> ''")
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.regexp_extract(t, "^..:.:(.*)$", 1))))
    return lines.select(
        F.lit(sample).alias("sample"), f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), (f[3].cast("bigint") - 1).alias("pos"),
        f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"), tags.alias("tags"),
    )


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Samples of the @RG header lines."""
    rows = spark.read.text(path).where("value LIKE '@RG%'")
    return rows.select(F.regexp_extract("value", r"\tID:([^\t]*)", 1).alias("group_id"), F.regexp_extract("value", r"\tSM:([^\t]*)", 1).alias("sample"))


def read_vcf(spark: SparkSession, path: str, only_pass: bool = False) -> DataFrame:
    """A row per variant and sample, with INFO and the FORMAT fields as maps (S13). The
    header line names the samples; it is one line, found without reading the rest."""
    lines = spark.read.text(path)
    head = lines.where("value LIKE '#CHROM%'").limit(1).collect()
    samples = head[0].value.split("\t")[9:] if head else []
    f = F.split("value", "\t")
    rows = lines.where("value NOT LIKE '#%' AND value <> ''").select(*(f[i].alias(c) for i, c in enumerate(("chr", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"))), F.slice(f, F.lit(10), F.lit(len(samples))).alias("calls") if samples else F.array().cast("array<string>").alias("calls"))
    if only_pass:
        rows = rows.where(F.col("filter") == "PASS")
    rows = line_numbers(rows, "variant_id").withColumns({"pos": F.col("pos").cast("bigint"), "info": F.expr("str_to_map(info, ';', '=')")})
    long = rows.select(*(c for c in rows.columns if c != "calls"), F.posexplode("calls").alias("_k", "_call"))
    fields = F.map_from_arrays(F.split("format", ":"), F.slice(F.split("_call", ":"), F.lit(1), F.size(F.split("format", ":"))))
    return long.withColumns({"sample": F.array(*map(F.lit, samples))[F.col("_k")] if samples else F.lit(None).cast("string"), "call": fields}).withColumn("gt", F.col("call")["GT"]).drop("_k", "_call")


def read_fasta(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """A reference as (chr, start, end, seq) chunks (S11). Lines are numbered where they
    stand, the headers above a line are counted, and the bases of a line go to the chunks
    that it touches: a contig is never one row, and a '>' inside a header is
    part of it."""
    lines = line_numbers(spark.read.text(path)).where("value <> ''")
    # How many headers stand above a line says which contig it is of; windows see a tile.
    marked = lines.select("line", "value", F.when(F.col("value").startswith(">"), 1).otherwise(0).cast("bigint").alias("is_head"), F.lit(0).alias("file"))
    counted = running_sum(marked, "file", "line", "is_head", "contig")
    heads = counted.where("is_head = 1").select("contig", F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("chr"))
    body = counted.where("is_head = 0 AND contig > 0").select("contig", F.col("line").alias("position"), F.regexp_replace("value", r"\s", "").alias("bases"))
    named = body.join(heads, "contig").select("chr", "position", "bases", F.length("bases").cast("bigint").alias("n"))
    placed = named.join(running_sum(named, "chr", "position", "n", "upto").select("chr", "position", "upto"), ["chr", "position"]).withColumn("at", F.col("upto") - F.col("n")).where("n > 0")
    dealt = placed.withColumn("k", F.explode(F.expr(f"sequence(at div {chunk}, (upto - 1) div {chunk})")))
    piece = F.expr(f"substring(bases, cast(greatest(k * {chunk} - at, 0) + 1 AS int), cast(least(upto, (k + 1) * {chunk}) - greatest(at, k * {chunk}) AS int))")
    pieces = dealt.select("chr", "k", F.greatest(F.col("at"), F.col("k") * chunk).alias("from"), piece.alias("piece"))
    whole = pieces.groupBy("chr", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from", "piece"))), lambda x: x["piece"]), "").alias("seq"))  # a chunk's lines
    return whole.select("chr", (F.col("k") * chunk).alias("start"), (F.col("k") * chunk + F.length("seq")).alias("end"), "seq")


def fetch(regions: DataFrame, chunks: DataFrame, chunk: int = 10_000) -> DataFrame:
    """region_id, seq: the bases of each region, joined from its chunks."""
    parts = chunks.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "seq")
    hits = range_join(regions.select("region_id", "chr", "start", "end"), parts, width=chunk)
    piece = F.expr("substring(seq, cast(greatest(start - r_start, 0) + 1 AS int), cast(least(`end`, r_end) - greatest(start, r_start) AS int))")
    return hits.select("region_id", "r_start", piece.alias("piece")).groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("r_start", "piece"))).alias("p")).select("region_id", F.expr("array_join(transform(p, x -> x.piece), '')").alias("seq"))


def parse_region(text) -> list:
    """chr, start, end columns of strings like chr1:1,000-2,000."""
    clean = F.regexp_replace(text, ",", "")
    part = lambda i: F.regexp_extract(clean, r"^([^:]+):(\d+)-(\d+)$", i)
    return [F.nullif(part(1), F.lit("")).alias("chr"), part(2).try_cast("bigint").alias("start"), part(3).try_cast("bigint").alias("end")]


def consensus_parts(column: str) -> list:
    """sample, region and assembly numbers of ids like sample:12.3; nulls where malformed."""
    part = lambda i: F.regexp_extract(column, r"^(.+):(\d+)\.(\d+)$", i)
    return [F.nullif(part(1), F.lit("")).alias("sample"), part(2).try_cast("bigint").alias("region_id"), part(3).try_cast("bigint").alias("assembly")]


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """DROPPED and TRANSFORMED lines with the region ids they name."""
    lines = spark.read.text(path).where(F.col("value").rlike("DROPPED|TRANSFORMED"))
    single = F.regexp_extract_all("value", F.lit(r"crID=(\d+)"), F.lit(1))
    several = F.split(F.regexp_extract("value", r"crIDs=\{?([0-9, ]*)\}?", 1), r",\s*")
    ids = F.array_distinct(F.filter(F.concat(single, several), lambda x: x != ""))
    return lines.select("value", F.transform(ids, lambda x: F.trim(x).cast("bigint")).alias("region_ids"))


EXPECTED = "chr string, start bigint, end bigint, svtype string, size bigint, genotype string"


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """Expected variants (S13), numbered in file order; a genotype other than HET or HOM
    raises."""
    rows = line_numbers(spark.read.csv(path, sep="\t", schema=EXPECTED, comment="#"), "expected_id")
    return rows.withColumn("genotype", F.when(F.col("genotype").isin("HET", "HOM"), F.col("genotype")).otherwise(F.raise_error(F.concat(F.lit("no genotype: "), F.coalesce("genotype", F.lit("null"))))))


def first_of_each(spark: SparkSession, folders: list[str]) -> dict[str, DataFrame]:
    """The tables of several stores by name, of the first folder that has one."""
    jvm, found = spark._jvm, {}
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        for status in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
            name = status.getPath().getName()
            if status.isDirectory() and not name.startswith(("_", ".")):
                found.setdefault(name, f"{folder.rstrip('/')}/{name}")
    return {name: spark.read.parquet(path) for name, path in sorted(found.items())}


#: Read fragments and candidate regions as JSON records.
FRAGMENT = f"sample string, read_name string, chr string, ref_start bigint, ref_end bigint, read_start bigint, read_end bigint, mapq int, forward boolean, supplementary boolean, sv_signals array<{SIGNAL}>, effective struct<chr:string,start:bigint,end:bigint>"
REGION = "region_id bigint, chr string, start bigint, end bigint, n_signals bigint, n_reads bigint"
CONTAINER = "container_id bigint, region_ids array<bigint>, consensuses array<struct<consensus_id:string,sequence:string,reads:array<string>>>, unused array<string>"


def read_json_tsv(spark: SparkSession, path: str, schema: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Records that stand as JSON in the last column of tab-separated lines (S06, X10),
    after as many columns as are named. A line that is no record raises."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where("trim(value) <> ''")
    record = F.from_json(F.element_at(f, -1), schema, {"mode": "FAILFAST"})
    return lines.select(*(f[i].alias(c) for i, c in enumerate(columns)), record.alias("_r")).select(*columns, "_r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str = CONTAINER) -> DataFrame:
    """One record a line, of a stated schema."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_stored(spark: SparkSession, path: str, wanted: DataFrame | None = None, on: tuple[str, ...] = (), chrs: list[str] | None = None) -> DataFrame:
    """A stored table, of the chromosomes given, which are folders of it and read alone
    (S07), and of the wanted keys (S09, S12), which reach the scan as a runtime filter."""
    df = spark.read.parquet(path)
    if chrs is not None:
        df = df.where(F.col("chr").isin(*chrs))
    return df if wanted is None else df.join(wanted.select(*on).distinct(), list(on), "left_semi")


def whole_reads(alignments: DataFrame, regions: DataFrame, width: int = 10_000) -> DataFrame:
    """(region_id, qname, seq, forward): the whole sequence of each read that lies over a
    region, once (S15). A hard-clipped alignment borrows the sequence of the read's
    alignment that has it all, turned to its own strand. alignments: (qname, flag, rname,
    ref_start, ref_end, cigar, seq); regions: (region_id, chr, r_start, r_end)."""
    complete = F.col("seq").isNotNull() & (F.col("seq") != "*") & ~F.col("cigar").contains("H")
    reverse = F.expr("(flag & 16) > 0")
    native = F.when(reverse, F.reverse(F.translate("seq", "ACGTacgt", "TGCAtgca"))).otherwise(F.col("seq"))
    whole = alignments.where(complete).groupBy("qname").agg(F.min_by(native, F.struct("flag", "ref_start")).alias("native"))
    rows = alignments.where("(flag & 256) = 0").select("qname", F.col("rname").alias("chr"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), (~reverse).alias("forward"), F.struct("flag", "ref_start").alias("first"))
    over = range_join(rows, regions, width=width).groupBy("region_id", "qname").agg(F.min_by("forward", "first").alias("forward"))
    out = over.join(whole, "qname")
    return out.select("region_id", "qname", F.when(F.col("forward"), F.col("native")).otherwise(F.reverse(F.translate("native", "ACGTacgt", "TGCAtgca"))).alias("seq"), "forward")
