"""Genotype likelihoods, calls and Mendelian consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expected alt fractions by copy number (fixed values), error 0.05 at the ends.
FRACTIONS = {1: (0.05, 0.95), 2: (0.05, 0.5, 0.95), 3: (0.05, 1 / 3, 2 / 3, 0.95), 4: (0.05, 0.25, 0.5, 0.75, 0.95)}
NO_READS_GQ = 60


def likelihoods(evidence: DataFrame, total: str = "n_total", alt: str = "n_alt", cn: str = "cn") -> DataFrame:
    """Adds gt_alt (alt alleles of the likeliest genotype), gp, gq, gt (G16). Binomial
    coefficients cancel between genotypes; powers are taken in logarithms."""
    n, k = F.col(total).cast("double"), F.col(alt).cast("double")
    by_cn = F.lit(None).cast("array<double>")
    for copies, fractions in FRACTIONS.items():
        by_cn = F.when(F.col(cn) == copies, F.array(*map(F.lit, fractions))).otherwise(by_cn)
    other = F.transform(F.sequence(F.lit(0), F.greatest(F.col(cn).cast("int"), F.lit(0))), lambda i: F.least(F.lit(0.95), F.greatest(F.lit(0.05), i / F.greatest(F.col(cn), F.lit(1)))))
    df = evidence.withColumn("_p", F.coalesce(by_cn, other))
    df = df.withColumn("_log", F.transform("_p", lambda p: k * F.log(p) + (n - k) * F.log(1 - p)))
    df = df.withColumn("_top", F.array_max("_log"))
    df = df.withColumn("_sum", F.aggregate("_log", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top"))))
    none, zero = F.col(total) == 0, F.col(cn) == 0
    gp = F.when(none | zero, 1.0).otherwise(1 / F.col("_sum"))
    best = F.when(none | zero, 0).otherwise(F.array_position("_log", F.col("_top")) - 1).cast("int")
    df = df.withColumns({"gt_alt": best, "gp": gp})
    df = df.withColumn("gq", F.when(F.col("gp") >= 1.0, NO_READS_GQ).otherwise(F.least(F.lit(NO_READS_GQ), F.floor(-10 * F.log10(1 - F.col("gp"))))).cast("int"))
    ref, alts = F.greatest(F.col(cn) - F.col("gt_alt"), F.lit(0)).cast("int"), F.col("gt_alt")
    few = F.concat(F.array_repeat(F.lit("0"), ref), F.array_repeat(F.lit("1"), alts))
    many = F.concat(F.array_repeat(F.lit("1"), alts), F.array_repeat(F.lit("0"), ref))
    gt = F.when(zero, F.lit("0")).when(none & (F.col(cn) > 0), F.array_join(F.array_repeat(F.lit("0"), F.col(cn).cast("int")), "/")).otherwise(F.array_join(F.when(F.col(cn) > 4, many).otherwise(few), "/"))
    return df.withColumn("gt", gt).drop("_p", "_log", "_top", "_sum")


def several_assemblies(patterns: DataFrame) -> DataFrame:
    """(sample, region_id) where one region gave two assemblies or more."""
    return patterns.groupBy("sample", "region_id").agg(F.count_distinct("assembly").alias("n")).where("n >= 2").select("sample", "region_id")


def corrected(genotypes: DataFrame, several: DataFrame) -> DataFrame:
    """1/1 becomes 0/1 with GQ at most 30 where a region gave several assemblies."""
    flagged = genotypes.join(several.withColumn("_several", F.lit(True)), ["sample", "region_id"], "left")
    fix = F.coalesce("_several", F.lit(False)) & (F.col("gt") == "1/1")
    return flagged.withColumns({"gt": F.when(fix, "0/1").otherwise(F.col("gt")), "gq": F.when(fix, F.least("gq", F.lit(30))).otherwise(F.col("gq"))}).drop("_several")


def alt_count(gt: Column | str) -> Column:
    """Alt alleles of a genotype string; a missing allele makes all reference."""
    gt = F.col(gt) if isinstance(gt, str) else gt
    return F.when(gt.contains("."), 0).otherwise(F.size(F.filter(F.split(gt, "/"), lambda a: a != "0")))


def copies(gt: Column | str) -> Column:
    gt = F.col(gt) if isinstance(gt, str) else gt
    return F.size(F.split(gt, "/"))


def inheritance(child: Column, father: Column, mother: Column, cn: Column) -> Column:
    """Status of a trio from alt counts and the child's copy number."""
    yes, no = F.lit("consistent"), F.lit("inconsistent")
    when = lambda good: F.when(good, yes).otherwise(no)
    return (
        F.when((child == 0) & (father == 0) & (mother == 0), "non_informative")
        .when(cn == 1, when((child == 0) | (mother > 0)))
        .when(cn == 2, when((child == 0) | ((child == 1) & (father + mother > 0)) | ((child == 2) & (father > 0) & (mother > 0))))
        .when(cn.isin(3, 4), when(father + mother >= child))
        .otherwise("uncertain")
    )


def trios(genotypes: DataFrame, pedigree: DataFrame) -> DataFrame:
    """One row per variant and trio (J26). genotypes: (variant_id, sample, gt, ...);
    pedigree: (individual, father, mother)."""
    side = lambda name: genotypes.select("variant_id", F.col("sample").alias(name), F.col("gt").alias(f"{name}_gt"))
    child = genotypes.join(pedigree.withColumnRenamed("individual", "sample"), "sample")
    both = child.join(side("father"), ["variant_id", "father"]).join(side("mother"), ["variant_id", "mother"])
    status = inheritance(alt_count("gt"), alt_count("father_gt"), alt_count("mother_gt"), copies("gt"))
    return both.withColumn("status", status)


def size_bin(size: Column) -> Column:
    return F.when(size < 100, "<100").when(size < 350, "100-350").when(size < 1000, "350-1000").when(size < 10_000, "1k-10k").otherwise(">10k")


def consistency(trio_rows: DataFrame) -> DataFrame:
    """Counts by type, size bin and status, with the totals over types, and the percentage
    among informative ones (A22)."""
    sets = [["svtype", "size_bin", "status"], ["svtype", "status"], ["size_bin", "status"], ["status"]]
    counts = trio_rows.groupingSets(sets, "svtype", "size_bin", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return counts.select(F.coalesce("svtype", F.lit("all")).alias("svtype"), F.coalesce("size_bin", F.lit("all")).alias("size_bin"), "status", "n")


def best_matches(expected: DataFrame, called: DataFrame, size_tolerance: float = 0.2, width: int = 1000) -> DataFrame:
    """Each expected variant's best call by type, size and genotype, MISSING if none.
    expected: (expected_id, chr, start, end, svtype, size, gt); called: (call_id, chr,
    r_start, r_end, c_type, c_size, c_gt)."""
    from lociq.operators.intervals import range_join

    like = F.abs(F.col("c_size") - F.col("size")) <= size_tolerance * F.col("size")
    score = F.when(F.col("svtype") == F.col("c_type"), 1).otherwise(0) + F.when(like, 1).otherwise(0) + F.when(F.col("gt") == F.col("c_gt"), 1).otherwise(0)
    hits = range_join(expected, called, width=width, points=True).withColumn("score", score).where("score > 0")
    best = hits.groupBy("expected_id").agg(F.min(F.struct(-F.col("score"), "call_id")).alias("b")).select("expected_id", F.col("b.call_id").alias("call_id"), (-F.col("b.col1")).alias("score"))
    out = expected.select("expected_id").join(best, "expected_id", "left")
    return out.withColumn("verdict", F.when(F.col("score").isNull(), "MISSING").when(F.col("score") == 3, "FULL").otherwise("PARTIAL")).withColumn("score", F.coalesce("score", F.lit(0)))
