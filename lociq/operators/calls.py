"""From patterns and composites to calls: regions, support, filters, breakend merging and
call assembly (P15, P17, F11, F13, F15-F17, F20, A17, A19, A21, A34, T06, T07, U02, J17, J18, J21,
J24, G04, G05, G13, G17, G20, W15)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociq.functions.dna import gc_fraction, kmer_similarity, sources
from lociq.operators.graph import components
from lociq.operators.intervals import range_join

#: Types that become calls; single breaks do not (fixed values).
CALLED = ("INS", "DEL", "INV", "INV-DEL", "INV-DUP")
MIN_ALT_READS = 3


def regions_of(primitives: DataFrame, tolerance: int) -> DataFrame:
    """Where each pattern lies: its primitives' places, padded but for deletions.
    primitives: (pattern_id, svtype, chr, start, end)."""
    pad = F.when(F.col("svtype") == "DEL", 0).otherwise(tolerance)
    return primitives.withColumns({"start": F.greatest(F.col("start") - pad, F.lit(0)), "end": F.col("end") + pad})


def log_id(svtype: str = "svtype", chr_: str = "chr", start: str = "start", end: str = "end", ids: str = "consensus_ids") -> Column:
    """A call's name in logs: type, place and its consensuses in order."""
    place = F.concat(F.col(chr_).cast("string"), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))
    return F.concat_ws("|", svtype, place, F.array_join(F.array_sort(F.col(ids).cast("array<string>")), ","))


def analysable(containers: DataFrame, copy_numbers: DataFrame, most: int = 4) -> DataFrame:
    """Containers of a copy number up to a limit (F11); (region_id, cn) as
    coverage.highest_copy_number gives it."""
    return containers.join(copy_numbers.where(F.col("cn") <= most), "region_id", "left_semi")


def usual_composition(variants: DataFrame, seq: str = "seq") -> DataFrame:
    """Insertions and deletions whose share of G and C is over 0.1 and at most 0.9; other
    types stay (F13)."""
    share = F.coalesce(gc_fraction(seq), F.lit(0.0))
    return variants.where(~F.col("svtype").isin("INS", "DEL") | ((share > 0.1) & (share <= 0.9)))


def supported(variants: DataFrame, least_size: int = 0) -> DataFrame:
    """Variants of a type that is called and of a least size."""
    return variants.where(F.col("svtype").isin(*CALLED) & (F.abs("size") >= least_size))


def consistent_input(variants: DataFrame, svtypes: tuple[str, ...], least_size: int, regions: DataFrame | None = None) -> DataFrame:
    """What a family test looks at (F17): passing calls of the types and the size, inside
    regions where given (J21)."""
    out = variants.where((F.col("filter") == "PASS") & F.col("svtype").isin(*svtypes) & (F.col("size") >= least_size))
    return out if regions is None else touching(out, regions)


def touching(variants: DataFrame, regions: DataFrame, width: int = 1000) -> DataFrame:
    """Variants that overlap a region: deletions with their whole length, other types with
    the base that they begin at (J21). regions: (chr, start, end)."""
    end = F.when(F.col("svtype") == "DEL", F.col("end")).otherwise(F.col("start") + 1)
    spans = regions.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hit = range_join(variants.select("variant_id", "chr", "start", end.alias("end")), spans, width=width)
    return variants.join(hit.select("variant_id"), "variant_id", "left_semi")


def of_regions(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted (sample, region_id) pairs."""
    return rows.join(wanted.select("sample", "region_id").distinct(), ["sample", "region_id"], "left_semi")


def sizes(members: DataFrame) -> DataFrame:
    """composite_id, size, population: the mean of the patterns' sizes by their support,
    rounded to even (A17), and the sizes of all their reads cut to integers, sorted (A19).
    members: (composite_id, size, support, distortions array<double>)."""
    mean = F.bround(F.sum(F.col("size") * F.col("support")) / F.sum("support")).cast("bigint")
    population = F.array_sort(F.flatten(F.collect_list(F.expr("transform(distortions, d -> cast(d AS bigint))"))))  # a composite's reads
    return members.groupBy("composite_id").agg(mean.alias("size"), population.alias("population"))


def supporting_reads(members: DataFrame, *by: str) -> DataFrame:
    """The distinct reads of each group (A21), sorted. members: (by, read_id)."""
    return members.groupBy(*by).agg(F.sort_array(F.collect_set("read_id")).alias("reads"))


def type_counts(variants: DataFrame, *by: str) -> DataFrame:
    return variants.groupBy(*by, "svtype").agg(F.count("*").alias("n"))  # A34


def representative(primitives: DataFrame, leftmost: bool = False) -> DataFrame:
    """composite_id, chr, start, end: the leftmost of a composite's places, or that of the
    largest support times size; the first place in a tie (T06, T07)."""
    place = F.struct("chr", "start", "end")
    best = F.min(F.struct(place.alias("p"))) if leftmost else F.min(F.struct((-F.col("support") * F.abs("size")).alias("w"), place.alias("p")))
    return primitives.groupBy("composite_id").agg(best.alias("b")).select("composite_id", "b.p.chr", "b.p.start", "b.p.end")


def read_sets(variants: DataFrame, alt: str = "alt_reads", covering: str = "covering_reads") -> DataFrame:
    """Adds n_alt, n_ref and n_total from the reads that show a variant and those over its
    place: reference reads are those that cover and do not show it (U02)."""
    return variants.withColumns({
        "n_alt": F.size(F.array_distinct(alt)),
        "n_ref": F.size(F.array_except(covering, alt)),
        "n_total": F.size(F.array_union(covering, alt)),
    })


def complexity_tolerance(variants: DataFrame, tracks: str = "tracks") -> DataFrame:
    """Adds size_tolerance: the mean complexity over a composite's tracks, each weighted by
    its length (G05): of the inserted sequence for insertions and inversions, of the
    reference for deletions; 1 for other types, 0 without any complexity."""
    total = F.expr(f"aggregate(transform({tracks}, t -> aggregate(t, 0D, (s, x) -> s + x)), 0D, (s, x) -> s + x)")
    length = F.expr(f"aggregate(transform({tracks}, t -> size(t)), 0, (s, x) -> s + x)")
    return _with_tolerance(variants, total, length)


def summed_tolerance(variants: DataFrame, total: str = "total", length: str = "length") -> DataFrame:
    """complexity_tolerance of composites whose tracks stand as their sums and lengths, added
    up, so that no task holds all tracks of a composite."""
    return _with_tolerance(variants, F.col(total), F.col(length))


def _with_tolerance(variants: DataFrame, total: Column, length: Column) -> DataFrame:
    mean = F.when(F.coalesce(total, F.lit(0.0)) == 0, 0.0).otherwise(total / length)
    return variants.withColumn("size_tolerance", F.when(F.col("svtype").isin("INS", "INV", "INV-DEL", "INV-DUP", "DEL"), mean).otherwise(1.0))


def _like_contexts(pairs: DataFrame, contexts: DataFrame, least: float) -> DataFrame:
    """Pairs whose sequence contexts share enough k-mers; none without a context."""
    counts = sources(contexts, "composite_id", "seq")
    both = pairs.join(contexts.select(F.col("composite_id").alias("a")).distinct(), "a", "left_semi").join(contexts.select(F.col("composite_id").alias("b")).distinct(), "b", "left_semi")
    return kmer_similarity(counts, both.select("a", "b"), "composite_id").where(F.col("similarity") >= least).select("a", "b")


def breakend_pairs(breakends: DataFrame, contexts: DataFrame, near: int = 150, least: float = 0.7, width: int = 1000) -> DataFrame:
    """(a, b) of single breakends that lie near each other in alike contexts.
    breakends: (composite_id, chr, start, end); contexts: (composite_id, seq)."""
    other = breakends.select("chr", F.col("start").alias("r_start"), F.greatest("end", F.col("start") + 1).alias("r_end"), F.col("composite_id").alias("b"))
    own = breakends.select(F.col("composite_id").alias("a"), "chr", "start", F.greatest("end", F.col("start") + 1).alias("end"))
    pairs = range_join(own, other, width=width, within=near, condition=F.col("a") < F.col("b")).select("a", "b").distinct()
    return _like_contexts(pairs, contexts, least)


def adjacency_pairs(ends: DataFrame, contexts: DataFrame | None = None, near: int = 150, least: float = 0.7, width: int = 1000) -> DataFrame:
    """(a, b) of adjacencies of as many breakends which, in genome order, lie near each
    other one by one (J18), in alike contexts where given. The first breakend of each finds
    the candidates; the others are compared in arrays. ends: (composite_id, chr, start,
    end), a row per breakend; an adjacency has a few."""
    low, high = F.least("start", "end"), F.greatest("start", "end")
    whole = ends.groupBy("composite_id").agg(F.array_sort(F.collect_list(F.struct("chr", F.col("start").alias("at"), low.alias("s"), high.alias("e")))).alias("ends"))
    first = whole.select("composite_id", "ends", F.size("ends").alias("k"), F.expr("ends[0].chr").alias("chr"), F.expr("ends[0].s").alias("start"), F.expr("ends[0].e + 1").alias("end"))
    other = first.select("chr", "k", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("composite_id").alias("b"), F.col("ends").alias("b_ends"))
    alike = F.expr(f"forall(zip_with(ends, b_ends, (x, y) -> x.chr = y.chr AND x.e + {near} >= y.s AND y.e + {near} >= x.s), z -> z)")
    pairs = range_join(first.withColumnRenamed("composite_id", "a"), other, width=width, within=near, also=("k",), condition=(F.col("a") < F.col("b")) & alike).select("a", "b")
    return pairs if contexts is None else _like_contexts(pairs, contexts, least)


def merged_adjacencies(ends: DataFrame, contexts: DataFrame | None = None, **limits) -> DataFrame:
    """composite_id, merged_id: adjacencies joined across chromosomes by components of
    their pairs (G04)."""
    merged = components(adjacency_pairs(ends, contexts, **limits)).withColumnRenamed("node", "composite_id")
    return ends.select("composite_id").distinct().join(merged, "composite_id", "left").select("composite_id", F.coalesce("component", "composite_id").alias("merged_id"))


def alignment_numbers(alignments: DataFrame, order=("read_start", "read_end")) -> DataFrame:
    """Adds alignment: a consensus's alignments numbered from 0 along it (W15). A consensus
    has a few alignments."""
    return alignments.withColumn("alignment", F.row_number().over(W.partitionBy("consensus_id").orderBy(*order)) - 1)


def assembled(composites: DataFrame, genotypes: DataFrame, places: DataFrame, min_alt_reads: int = MIN_ALT_READS) -> DataFrame:
    """Calls of composites (G17): place, length, filter and precision. A deletion ends its
    length past its start, an insertion a base past it. A call passes where one sample has
    enough reads of it, and is precise outside repeats. composites: (composite_id, svtype,
    size, consensus_ids, n_repeats); genotypes: (composite_id, sample, n_alt); places as
    representative gives them."""
    most = genotypes.groupBy("composite_id").agg(F.max("n_alt").alias("most_alt"))
    df = supported(composites).join(places, "composite_id").join(most, "composite_id", "left")
    length = F.abs("size")
    end = F.when(F.col("svtype") == "DEL", F.col("start") + length).when(F.col("svtype") == "INS", F.col("start") + 1).otherwise(F.col("end"))
    return df.select(
        "composite_id", "svtype", "chr", "start", end.alias("end"), length.alias("svlen"),
        F.when(F.coalesce("most_alt", F.lit(0)) >= min_alt_reads, "PASS").otherwise("LowQual").alias("filter"), (F.col("n_repeats") == 0).alias("precise"), "consensus_ids",
    )


def adjacency_calls(ends: DataFrame, genotypes: DataFrame, min_alt_reads: int = MIN_ALT_READS, symbolic_from: int = 100_000) -> DataFrame:
    """Two calls for each merged adjacency, that name each other as mates.

    The pattern of most support speaks for its composite, then the one of the lesser sample,
    consensus and id; patterns without exactly two ends never do, and a composite without
    any other has no call. Both calls pass where one sample has enough reads at either end;
    they are precise where no end of the composite lies in a repeat. ends: (composite_id,
    sample, consensus_id, pattern_id, support, ord, chr, at, sv_type 3 or 4, forward,
    inserted, n_repeats); genotypes: (composite_id, sample, n_alt), the larger of both ends."""
    facts = F.struct("ord", "chr", "at", "sv_type", "forward")
    # Two ends are the least and the greatest: no list of any pattern's ends is gathered.
    whole = ends.groupBy("composite_id", "sample", "consensus_id", "pattern_id").agg(F.max("support").alias("support"), F.max(F.coalesce("inserted", F.lit(""))).alias("inserted"), F.count("*").alias("n_ends"), F.min(facts).alias("first"), F.max(facts).alias("last"), F.sum("n_repeats").alias("n_repeats"))
    order = F.when(F.col("n_ends") == 2, F.struct(-F.col("support"), "sample", "consensus_id", "pattern_id"))
    speaker = F.min_by(F.struct("sample", "consensus_id", "pattern_id", "inserted", F.array("first", "last").alias("ends")), order)
    about = whole.groupBy("composite_id").agg(F.sum("n_repeats").alias("repeats"), F.array_sort(F.collect_set("consensus_id")).alias("consensus_ids"), speaker.alias("p"))
    spoken = about.where("composite_id IS NOT NULL AND p IS NOT NULL").select("composite_id", "repeats", "consensus_ids", "p.*")
    most = genotypes.groupBy("composite_id").agg(F.max("n_alt").alias("most_alt"))
    df = spoken.join(most, "composite_id", "left")
    name = F.concat_ws(".", F.col("sample").cast("string"), F.col("consensus_id").cast("string"), F.col("pattern_id").cast("string"))
    df = df.withColumns({"name": name, "n": F.length("inserted")}).withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
    df = df.withColumns({"e": F.expr("ends[_k]"), "mate": F.expr("ends[1 - _k]")})
    far = F.concat(F.col("mate.chr").cast("string"), F.lit(":"), (F.col("mate.at") + 1).cast("string"))
    contig = F.concat(F.lit("<ctg_"), "name", F.lit(">:"), F.when(F.col("e.sv_type") == 4, F.lit("1")).otherwise(F.col("n").cast("string")))
    symbolic = F.col("n") > symbolic_from
    place, base = F.when(symbolic, contig).otherwise(far), F.when(symbolic, F.lit("N")).otherwise(F.concat(F.lit("N"), F.col("inserted")))
    right, forward = F.col("e.sv_type") == 4, F.col("e.forward")
    bracket = F.when(right == forward, F.lit("[")).otherwise(F.lit("]"))  # which way the mate's piece runs
    there = F.concat(bracket, place, bracket)
    return df.select(
        "composite_id", F.concat_ws(".", "name", F.col("_k").cast("string")).alias("call_id"), F.concat_ws(".", "name", (1 - F.col("_k")).cast("string")).alias("mate_id"),
        F.col("e.chr").alias("chr"), F.col("e.at").alias("start"), (F.col("e.at") + 1).alias("end"), F.lit("BND").alias("svtype"), F.greatest("n", F.lit(1)).cast("bigint").alias("svlen"),
        F.when(right, F.concat(base, there)).otherwise(F.concat(there, base)).alias("alt"),
        F.when(F.coalesce("most_alt", F.lit(0)) >= min_alt_reads, "PASS").otherwise("LowQual").alias("filter"), (F.col("repeats") == 0).alias("precise"), "consensus_ids",
    )


def in_containers(reads: DataFrame, copy_numbers: DataFrame, most_copies: int = 4, assemble: Callable[[list[str]], str] | None = None) -> DataFrame:
    """The steps of one container for all (G13): containers of too many copies go, reads are
    clustered, and each cluster gives a consensus. reads: (container_id, read_id, inserted,
    deleted, seq); copy_numbers: (container_id, cn)."""
    from lociq.operators import clustering

    rows = reads.join(copy_numbers.where(F.col("cn") <= most_copies), "container_id")
    clusters = clustering.cluster_reads(rows.select("container_id", "read_id", "inserted", "deleted", "cn"))
    return clustering.consensus(rows.select("container_id", "read_id", "seq").join(clusters, ["container_id", "read_id"]), assemble)


def uniform_cover(lengths: DataFrame, depth: int = 30) -> DataFrame:
    """A stand-in coverage of one depth over every contig (G20): (chr, start, end, depth)."""
    return lengths.select("chr", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"), F.lit(depth).alias("depth"))


def log_hits(lines: DataFrame, region_ids: list[int], places: DataFrame | None = None) -> DataFrame:
    """Log lines that name one of the regions, or a place that overlaps one (J24). lines:
    (line, region_ids, chr, start, end); the question's ids are a parameter."""
    named = lines.where(F.arrays_overlap("region_ids", F.array(*map(F.lit, region_ids)).cast("array<bigint>"))).select("line")
    if places is not None:
        spans = places.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
        named = named.union(range_join(lines.where("chr IS NOT NULL").select("line", "chr", "start", "end"), spans).select("line"))
    return lines.join(named.distinct(), "line", "left_semi")
