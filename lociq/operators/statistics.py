"""Statistics of reads, regions and sequences, and the small joins around them
(A04, A06, A10-A12, A28, A29, A34, A37, W11, W16, J11, J23, J28, J30, F18, F19, F21, U03,
X06, T05)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lociq.operators.intervals import island_ids, range_join, sweep


def bin_size(reads: DataFrame, factor: int = 10) -> DataFrame:
    """Median read length times a factor, cut to an integer (A04). reads: (length)."""
    return reads.agg((F.expr("percentile(length, 0.5)") * factor).cast("bigint").alias("bin_size"))


def binned_max_depth(fragments: DataFrame, lengths: DataFrame, bin_size: int) -> DataFrame:
    """(chr, bin, depth): the deepest base of each bin of each contig (A06), 0 where nothing
    lies. Runs of equal depth stand for their bases. lengths: (chr, length)."""
    runs = sweep(fragments)
    last = F.floor((F.col("end") - 1) / bin_size)
    touched = runs.select("chr", "depth", F.explode(F.sequence(F.floor(F.col("start") / bin_size), last)).alias("bin"))
    deepest = touched.groupBy("chr", "bin").agg(F.max("depth").alias("depth"))
    bins = lengths.where("length > 0").select("chr", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / bin_size))).alias("bin"))
    return bins.join(deepest, ["chr", "bin"], "left").select("chr", "bin", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def median_indel_sizes(members: DataFrame) -> DataFrame:
    """region_id, median_size: the median size of a region's insertions and deletions, the
    middle pair's mean cut to an integer; 0 where there are none (A10)."""
    size = F.expr("cast(percentile(CASE WHEN sv_type <= 1 THEN abs(size) END, 0.5) AS bigint)")
    return members.groupBy("region_id").agg(F.coalesce(size, F.lit(0)).cast("bigint").alias("median_size"))


def median_of_means(members: DataFrame, group: str = "region_id", value: str = "coverage") -> DataFrame:
    """The median over groups of their mean."""
    return members.groupBy(group).agg(F.avg(value).alias("m")).agg(F.expr("percentile(m, 0.5)").alias("median_of_means"))


def summed_indels(members: DataFrame, keys=("region_id", "read_id")) -> DataFrame:
    """Inserted and deleted bases by read within regions."""
    of = lambda kind: F.sum(F.when(F.col("sv_type") == kind, F.col("size")).otherwise(0)).cast("bigint")
    return members.groupBy(*keys).agg(of(0).alias("inserted"), of(1).alias("deleted"))


def pair_lengths(alignments: DataFrame) -> DataFrame:
    """(a, b, aligned): the last alignment's length of each unordered pair of reads, both
    directions being one pair (A28). alignments: (query, target, ord, aligned)."""
    return alignments.groupBy(F.least("query", "target").alias("a"), F.greatest("query", "target").alias("b")).agg(F.max_by("aligned", "ord").alias("aligned"))


def density_track(signals: DataFrame, reach: int = 50, slope: float = 10.0, key: str = "group_id") -> DataFrame:
    """(key, position, density): a plateau over each signal with sigmoid flanks, summed by
    position (A29). Signals are as long as their group's reads, so positions are bounded by
    them. signals: (key, start, end, weight)."""
    at = F.explode(F.sequence(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach)).alias("position")
    df = signals.select(key, "start", "end", "weight", at)
    away = F.greatest(F.col("start") - F.col("position"), F.col("position") - F.col("end"), F.lit(0))
    return df.groupBy(key, "position").agg(F.sum(F.col("weight") * 2 / (1 + F.exp(away / F.lit(slope)))).alias("density"))


def heterogeneity(seqs: DataFrame, id_col: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Adds heterogeneity: over a sequence's letters, how much of an even share each has,
    summed; 0 for an empty one (A37)."""
    letters = "array_sort(array_distinct(split(s, '')))"
    share = "aggregate({l}, 0D, (t, c) -> t + least(1D, (length(s) - length(replace(s, c, ''))) / (length(s) / cast(size({l}) AS double))))"
    return seqs.withColumn("heterogeneity", F.expr(f"CASE WHEN length({seq}) = 0 THEN 0D ELSE {share.format(l=letters)} END".replace("(s,", f"({seq},").replace("(s)", f"({seq})")))


CODES = {c: i for i, pair in enumerate(("Aa", "Cc", "Gg", "Tt")) for c in pair}


def window_complexity(text: str, window: int, sizes) -> np.ndarray:
    """Over windows, the product of the shares of distinct k-mers. The k-mers of a size are
    renewed at every k-th base only, so a window may hold older ones; sequences shorter
    than the window have none."""
    letters = np.array([CODES.get(c, 4) for c in text], dtype=np.int64)
    n = len(letters)
    if n < window:
        return np.zeros(0)
    out = np.ones(n - window + 1)
    for k in sizes:
        words = np.zeros(n - k + 1, dtype=np.int64)
        for i in range(k):
            words = words * 8 + letters[i : n - k + 1 + i]
        held = window - k + 1
        j = np.arange(window, n)
        fresh = j[j % k == 0]
        queue = np.concatenate([words[:held], words[fresh - k + 1]])
        views = np.sort(np.lib.stride_tricks.sliding_window_view(queue, held), axis=1)
        distinct = 1 + (np.diff(views, axis=1) != 0).sum(axis=1)
        out *= distinct[np.concatenate([[0], np.cumsum(j % k == 0)])] / min(5**k, held)
    return out


#: Letters of a part that a task works on at once.
PART = 1 << 20


def text_parts(batches, column: str, most: int = PART):
    """Batches cut where their texts come to so many letters, one row at least, so that what
    is made of a part is bounded, however long the texts of a batch are."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(lengths):
            yield batch.slice(begin)


def complexity_track(seqs: DataFrame, window: int = 11, sizes=(2, 3, 4, 5), id_col: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Adds track (array of float): window_complexity of each sequence."""

    names = seqs.columns
    rows = seqs.withColumn("_text", F.coalesce(seq, F.lit("")))
    kinds = StructType([*seqs.schema.fields, StructField("track", ArrayType(DoubleType()))])

    def run(batches):
        for part in text_parts(batches, "_text"):
            tracks = [window_complexity(text, window, sizes) for text in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(tracks, pa.list_(pa.float64()))], [*names, "track"])

    return rows.mapInArrow(run, kinds)


def complexity(seq: str = "seq"):
    """Mean complexity of a sequence as a column (A37): windows of 15 bases, or of the
    largest odd number in a shorter one, and k-mers of all odd sizes from 3 up to 13 or the
    window's. 1 for fewer than three bases."""

    def one(text: str) -> float:
        if len(text) < 3:
            return 1.0
        window = min(len(text), 15) - (min(len(text), 15) % 2 == 0)
        return float(window_complexity(text, window, range(min(window, 13), 2, -2)).mean())

    @F.pandas_udf("double")
    def mean(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return mean(F.coalesce(seq, F.lit("")))


def annotated_signals(signals: DataFrame, repeats: DataFrame) -> DataFrame:
    """signals with gc_percent and complexity of their sequence, where they have one, and
    the least repeat that they touch, -1 without any (A37). A deletion touches with its
    whole length, other types with the base that they begin at. signals: (signal_id,
    sample, chr, start, end, sv_type, size, seq); repeats: (chr, start, end, repeat_id)."""
    from lociq.functions.dna import gc_fraction

    end = F.when(F.col("sv_type") == 1, F.greatest("end", F.col("start") + 1)).otherwise(F.col("start") + 1)
    spans = repeats.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "repeat_id")
    hit = range_join(signals.select("signal_id", "chr", "start", end.alias("end")), spans).groupBy("signal_id").agg(F.min("repeat_id").alias("repeat_id"))
    has = (F.col("sv_type") < 2) & F.col("seq").isNotNull()
    df = signals.join(hit, "signal_id", "left").withColumn("repeat_id", F.coalesce("repeat_id", F.lit(-1).cast("bigint")))
    gc = F.bround(100 * F.coalesce(gc_fraction("seq"), F.lit(0.0))).cast("int")
    return df.withColumns({"gc_percent": F.when(has, gc), "complexity": F.when(has, complexity())})


def sample_statistics(annotated: DataFrame) -> DataFrame:
    """By sample and type: signals, bases, those in repeats, mean composition and
    complexity (A37)."""
    return annotated.groupBy("sample", "sv_type").agg(
        F.count("*").alias("n"), F.sum("size").alias("bases"), F.count_if(F.col("repeat_id") >= 0).alias("in_repeats"), F.avg("gc_percent").alias("gc_percent"), F.avg("complexity").alias("complexity")
    )


def running_share(counts: DataFrame, label: str = "svtype", order: str = "size_bin", value: str = "n") -> DataFrame:
    """Adds share: the percentage of a label's total up to and with each row."""
    upto = W.partitionBy(label).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("share", 100.0 * F.sum(value).over(upto) / F.sum(value).over(W.partitionBy(label)))


def over_thin_places(candidates: DataFrame, spans: DataFrame, share: float = 0.15) -> DataFrame:
    """read_id of the candidates that lie over a place where candidates are thin, that is
    fewer than a share of the mean depth of spans, rounded up (J11). Both: (read_id, chr,
    start, end)."""
    mean = sweep(spans).groupBy("chr").agg((F.sum(F.col("depth") * (F.col("end") - F.col("start"))) / F.sum(F.col("end") - F.col("start"))).alias("mean"))
    thin = sweep(candidates).join(mean, "chr").where(F.col("depth") < F.ceil(F.col("mean") * share)).select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return range_join(candidates.select("read_id", "chr", "start", "end"), thin, width=500).select("read_id").distinct()


def others_of_consensus(regions: DataFrame, members: DataFrame) -> DataFrame:
    """region_id, consensus_id, others: the other regions of each consensus that a region
    went into; null where it went into none (J23). members: (consensus_id, region_id)."""
    whole = members.groupBy("consensus_id").agg(F.sort_array(F.collect_set("region_id")).alias("all"))
    df = regions.select("region_id").join(members.where("consensus_id IS NOT NULL"), "region_id", "left")
    # The lists come last, so that none is shuffled with a row; rows are few for what they
    # take, so their number of tasks stays. Both sides are dealt by the consensus.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(tasks, "consensus_id").join(whole.hint("merge"), "consensus_id", "left")
    return df.select("region_id", "consensus_id", F.array_remove("all", F.col("region_id")).alias("others"))


def neighbours(signals: DataFrame, radius: int = 500, width: int = 2000) -> DataFrame:
    """(signal_id, neighbour_id): signals of the same type that start within a radius, for
    deletions also those that end there (J28)."""
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= radius
    other = signals.select("chr", "sv_type", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("signal_id").alias("neighbour_id"))
    like = near("start", "r_start") | ((F.col("sv_type") == 1) & (near("end", "r_end") | near("end", "r_start")))
    pairs = range_join(signals.select("signal_id", "chr", "sv_type", "start", "end"), other, width=width, within=radius + 1, points=True, also=("sv_type",), condition=(F.col("signal_id") != F.col("neighbour_id")) & like)
    return pairs.select("signal_id", "neighbour_id")


def overlap_groups(alignments: DataFrame) -> DataFrame:
    """Adds group_start: alignments that overlap one another on the reference are one
    group, named by its chr and start (J30)."""
    return island_ids(alignments, touching=False).drop("island_end").withColumnRenamed("island_start", "group_start")


def larger_than(regions: DataFrame, size: int) -> DataFrame:
    """Regions of more than a size."""
    return regions.where(F.col("end") - F.col("start") > size)


def by_names(reads: DataFrame, names: DataFrame, keep: bool = True, column: str = "read_id") -> DataFrame:
    """Reads that are named, or those that are not."""
    return reads.join(names.select(column).distinct(), column, "left_semi" if keep else "left_anti")


def few_segments(signals: DataFrame, most: int = 4) -> DataFrame:
    """Signals of reads with at most so many breaks (F21): counted first, so that a read of
    very many is a number and no window."""
    many = signals.where("sv_type >= 3").groupBy("read_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return signals.join(many, "read_id", "left_anti")


def unconnected(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """Regions in no edge."""
    ends = edges.select(F.col("a").alias("region_id")).union(edges.select("b")).distinct()
    return regions.join(ends, "region_id", "left_anti")


def similar_windows(texts: DataFrame, start: str, end: str, most: int = 5, id_col: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(id, from, to): the stretches of a sequence whose windows differ from its window
    [start, end) in at most `most` places and lie clear of it (X06), overlapping ones
    joined. Mismatches of all windows are sums of differing letters, taken at once."""
    kind = dict(texts.dtypes)[id_col]

    def run(batches):
        for batch in text_parts(batches, "t"):
            rows = []
            for key, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "a", "b"))):
                a, b = sorted((max(0, min(a, len(text))), max(0, min(b, len(text)))))
                width = b - a
                if not width or len(text) < width:
                    continue
                letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                n = len(letters) - width + 1
                differ = np.zeros(n, dtype=np.int32)
                for k in range(width):
                    differ += letters[k : k + n] != letters[a + k]
                at = np.flatnonzero((differ <= max(1, most)) & (np.abs(np.arange(n) - a) >= width))
                if len(at):
                    first = np.concatenate([[True], np.diff(at) >= width])
                    last = np.concatenate([first[1:], [True]])
                    rows += [(key, int(s), int(e) + width) for s, e in zip(at[first], at[last])]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (batch.schema.field("k").type, pa.int64(), pa.int64()))], ["k", "from", "to"])

    df = texts.select(F.col(id_col).alias("k"), F.coalesce(seq, F.lit("")).alias("t"), F.expr(start).cast("bigint").alias("a"), F.expr(end).cast("bigint").alias("b"))
    return df.mapInArrow(run, f"k {kind}, from bigint, to bigint").withColumnRenamed("k", id_col)


def subsample(reads: DataFrame, attempt: int = 0, share: float = 0.5, column: str = "read_id") -> DataFrame:
    """The same share of reads for an attempt wherever it runs (T05): by a hash of the read
    and the attempt, so two attempts take different halves."""
    return reads.where(F.pmod(F.xxhash64(F.lit(42 + attempt), F.col(column)), F.lit(1_000_000)) < int(share * 1_000_000))


