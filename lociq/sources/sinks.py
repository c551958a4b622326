"""Writing results as Parquet in genome order and as genomic text (K01-K03, K05-K20, K22,
X13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYMBOLIC_FROM = 100_000


def write_sorted(df: DataFrame, path: str, parts: int | None = None, by: tuple[str, ...] = ("chr_id", "start")) -> None:
    """Parquet in genome order: ranges across files, sorted within, so that position
    filters skip row groups (K01)."""
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def write_tile(tables: dict[str, DataFrame], path: str, sample: str) -> None:
    """One sample's tables as a folder of Parquet tables partitioned by sample."""
    for name, df in tables.items():
        df.withColumn("sample", F.lit(sample)).write.mode("append").partitionBy("sample").parquet(f"{path}/{name}")


def bed_line(*columns: str) -> Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns))


def write_bed(df: DataFrame, path: str, *extra: str) -> None:
    df.sortWithinPartitions("chr", "start").select(bed_line("chr", "start", "end", *extra)).write.mode("overwrite").text(path)


def write_bedgraph(df: DataFrame, path: str, value: str) -> None:
    """Skips what is no number."""
    number = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf"))
    write_bed(df.where(number), path, value)


def fasta_record(name: str, seq: str, width: int = 80) -> Column:
    """A FASTA record with lines of a width."""
    at = F.sequence(F.lit(0), F.greatest(F.floor((F.length(seq) - 1) / width), F.lit(0)))
    lines = F.transform(at, lambda i: F.substring(F.col(seq), (i * width + 1).cast("int"), F.lit(width)))
    return F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.array_join(lines, "\n"))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(fasta_record(name, seq)).write.mode("overwrite").text(path)


def breakend_alt(ref: str, chr_: str, pos: str, mate_first: str, mate_forward: str) -> Column:
    """The four bracket forms of a breakend's ALT (X13). mate_first: the mate's piece
    comes before this base; mate_forward: it extends to the right of its position."""
    bracket = F.when(F.col(mate_forward), "[").otherwise("]")
    place = F.concat(bracket, F.col(chr_), F.lit(":"), F.col(pos).cast("string"), bracket)
    return F.when(F.col(mate_first), F.concat(place, F.col(ref))).otherwise(F.concat(F.col(ref), place))


def genotype_field() -> Column:
    """GT:GQ:TC:DR:DV:GP of a genotype row."""
    return F.concat_ws(":", "gt", F.col("gq").cast("string"), F.col("tc").cast("string"), F.col("dr").cast("string"), F.col("dv").cast("string"), F.format_number("gp", 4))


def vcf_lines(calls: DataFrame, genotypes: DataFrame, samples: list[str]) -> DataFrame:
    """(chr, pos, line) of VCF 4.2 (K10). calls: (call_id, chr, start, end, svtype, svlen,
    filter, ref, alt, consensus_ids, precise); genotypes: (call_id, sample, gt, gq, tc, dr,
    dv, gp). A sample without a genotype is 0/0 without reads."""
    by_sample = genotypes.groupBy("call_id").pivot("sample", samples).agg(F.first(genotype_field()))
    df = calls.join(by_sample, "call_id", "left")
    long = (F.length("ref") > SYMBOLIC_FROM) | (F.length("alt") > SYMBOLIC_FROM)
    ref = F.when(long, F.substring("ref", 1, 1)).otherwise(F.col("ref"))
    alt = F.when(long, F.concat(F.lit("<"), F.col("svtype"), F.lit(">"))).otherwise(F.col("alt"))
    info = F.concat(F.lit("SVTYPE="), "svtype", F.lit(";END="), (F.col("end") + 1).cast("string"), F.lit(";SVLEN="), F.col("svlen").cast("string"), F.lit(";CONSENSUSIDs="), F.array_join("consensus_ids", ","), F.when(F.col("precise"), ";PRECISE").otherwise(";IMPRECISE"))
    cells = [F.coalesce(F.col(f"`{s}`"), F.lit("0/0:60:0:0:0:1.0000")) for s in samples]
    line = F.concat_ws("\t", "chr", (F.col("start") + 1).cast("string"), F.concat_ws(".", "svtype", F.col("call_id").cast("string")), ref, alt, F.lit("60"), "filter", info, F.lit("GT:GQ:TC:DR:DV:GP"), *cells)
    return df.select("chr", (F.col("start") + 1).alias("pos"), line.alias("line"))


def vcf_header(samples: list[str], contigs: list[tuple[str, int]]) -> list[str]:
    info = (("SVTYPE", "1", "String", "Type of variant"), ("END", "1", "Integer", "End position"), ("SVLEN", "1", "Integer", "Length"), ("CONSENSUSIDs", ".", "String", "Supporting consensus sequences"), ("PRECISE", "0", "Flag", "Exact breakpoints"), ("IMPRECISE", "0", "Flag", "Breakpoints in a repeat"))
    form = (("GT", "1", "String", "Genotype"), ("GQ", "1", "Integer", "Quality"), ("TC", "1", "Integer", "Reads"), ("DR", "1", "Integer", "Reference reads"), ("DV", "1", "Integer", "Variant reads"), ("GP", "1", "Float", "Probability"))
    return [
        "##fileformat=VCFv4.2",
        *(f"##contig=<ID={c},length={n}>" for c, n in contigs),
        *(f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in info),
        *(f'##FORMAT=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in form),
        "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples)),
    ]


def write_vcf(lines: DataFrame, header: list[str], path: str) -> None:
    """Sorted part files of which the first begins with the header (K10): read as a folder
    or joined in name order they are one VCF, and no task writes more than its range."""
    head = lines.sparkSession.createDataFrame([(i, line) for i, line in enumerate(header)], "ord int, line string")
    head = head.select("ord", F.lit(None).cast(dict(lines.dtypes)["chr"]).alias("chr"), F.lit(None).cast("bigint").alias("pos"), "line")
    rows = head.unionByName(lines.select(F.lit(len(header)).alias("ord"), "chr", F.col("pos").cast("bigint").alias("pos"), "line"))
    order = ("ord", "chr", "pos")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def filtered(df: DataFrame, keep: Column, stage: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and those that go with the stage and the reason."""
    good = F.coalesce(keep, F.lit(False))
    return df.where(good), df.where(~good).withColumns({"stage": F.lit(stage), "reason": F.lit(reason)})


def write_table(df: DataFrame, path: str, by: str | None = "chr") -> None:
    """Coverage, copy numbers, containers, patterns and consensuses as Parquet (K02, K03,
    K05, K08, K22); a folder for each chromosome where a column is named, so that a reader
    of some takes those only. Row groups take the place of chunks of fixed size."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_tsv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Tab-separated lines with a header (K06); arrays are comma-joined."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    writer = df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_jsonl(df: DataFrame, path: str, everyone: DataFrame | None = None, on: str = "container_id", compression: str | None = None) -> None:
    """A record a line (K07, K19); with everyone, also for those that have none."""
    rows = df if everyone is None else everyone.select(on).join(df, on, "left")
    writer = rows.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.option("compression", compression) if compression else writer).json(path)


def json_tsv_line(df: DataFrame, *columns: str) -> DataFrame:
    """Lines with the named columns and the whole record as JSON in the last one (X10):
    what text_formats.read_json_tsv reads."""
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns), record).alias("value"))


def pattern_ids(patterns: DataFrame) -> DataFrame:
    """Adds pattern_key, number-type-consensus, the number counting a consensus's patterns
    of one type in order of place (K08)."""
    order = W.partitionBy("consensus_id", "svtype").orderBy("start", "pattern_id")
    return patterns.withColumn("pattern_key", F.concat_ws("-", (F.row_number().over(order) - 1).cast("string"), "svtype", F.col("consensus_id").cast("string")))


def region_bed(found: DataFrame) -> DataFrame:
    """Candidate regions as BED columns (K13): name is the id, score the reads."""
    return found.select("chr", "start", "end", F.col("region_id").alias("name"), F.least("n_reads", F.lit(1000)).alias("score"))


def pattern_bed(primitives: DataFrame) -> DataFrame:
    """A line per pattern from its first to its last place (K14); the outer interval is
    what INV-DEL and INV-DUP span too."""
    spans = primitives.groupBy("pattern_id", "svtype", "chr").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("support").alias("score"))
    return spans.select("chr", "start", F.greatest("end", F.col("start") + 1).alias("end"), F.concat_ws("-", "svtype", F.col("pattern_id").cast("string")).alias("name"), "score")


def primitive_vcf(primitives: DataFrame, samples: list[str]) -> DataFrame:
    """(chr, pos, line): primitives as flat lines with empty genotypes."""
    info = F.concat(F.lit("SVTYPE="), "svtype", F.lit(";END="), (F.col("end") + 1).cast("string"), F.lit(";SVLEN="), F.when(F.col("svtype") == "DEL", -F.col("size")).otherwise(F.col("size")).cast("string"), F.lit(";SUPPORT="), F.col("support").cast("string"))
    line = F.concat_ws("\t", F.col("chr").cast("string"), (F.col("start") + 1).cast("string"), F.concat_ws(".", "svtype", F.col("primitive_id").cast("string")), F.lit("N"), F.concat(F.lit("<"), "svtype", F.lit(">")), F.lit("."), F.lit("PASS"), info, F.lit("GT:GQ"), *(F.lit("./.:.") for _ in samples))
    return primitives.select("chr", (F.col("start") + 1).alias("pos"), line.alias("line"))


def write_sequences(sequences: DataFrame, wanted: DataFrame | None, path: str, shards: int | None = None, name: str = "consensus_id", seq: str = "sequence") -> None:
    """Sequences of the wanted ids as FASTA (K16, K22), in so many shards by their id."""
    rows = sequences if wanted is None else sequences.join(wanted.select(name).distinct(), name, "left_semi")
    rows = rows if shards is None else rows.repartition(shards, name)
    write_fasta(rows, path, name, seq)


def fastq_record(name: str, seq: str, qual: str) -> Column:
    return F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.coalesce(F.col(qual), F.expr(f"repeat('!', length({seq}))")))


def write_cut_reads(cut: DataFrame, path: str, fastq: bool = False, name: str = "qname", compression: str | None = None) -> None:
    """Reads cut to a region (alignments.cut with cut_seq) as FASTA or FASTQ."""
    rows = cut.select(fastq_record(name, "cut_seq", "cut_qual") if fastq else fasta_record(name, "cut_seq"))
    writer = rows.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def family_report(counts: DataFrame) -> DataFrame:
    """A row per type and size bin with the statuses beside each other and the share that
    is consistent among those that inform (K18); counts as genotypes.consistency gives."""
    states = ["consistent", "inconsistent", "non_informative", "uncertain"]
    wide = counts.groupBy("svtype", "size_bin").pivot("status", states).agg(F.sum("n")).na.fill(0)
    informs = F.col("consistent") + F.col("inconsistent")
    return wide.withColumn("percent", F.when(informs > 0, F.round(100.0 * F.col("consistent") / informs, 2)))


def latex_line(*columns: str) -> Column:
    """A row of a LaTeX table."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("--")), r"([%_&#])", r"\\$1")
    return F.concat(F.concat_ws(" & ", *map(cell, columns)), F.lit(r" \\"))


def annotated(lines: DataFrame, status: DataFrame) -> DataFrame:
    """VCF lines with each variant's family status in INFO as MNDL (K18). lines: (variant_id,
    line); status: (variant_id, status)."""
    df = lines.join(status.select("variant_id", "status"), "variant_id", "left")
    f = F.split("line", "\t")
    info = F.when(F.col("status").isNull(), f[7]).otherwise(F.concat(f[7], F.lit(";MNDL="), "status"))
    return df.withColumn("line", F.array_join(F.concat(F.slice(f, 1, 7), F.array(info), F.slice(f, F.lit(9), F.greatest(F.size(f) - 8, F.lit(0)))), "\t")).drop("status")
