"""Depth and copy number."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociq.operators import scans
from lociq.operators.graph import cut
from lociq.operators.intervals import TILE, along, island_ids, merge, overlap_sum, passed, range_join, row_numbers, sweep


def depths(signals: DataFrame, rafs: DataFrame) -> DataFrame:
    """signal_id, depth: fragments over each signal, empty signals being one base.
    signals: (signal_id, chr, start, end); rafs: (chr, start, end, ...)."""
    one = F.greatest("end", F.col("start") + 1)
    return overlap_sum(signals.select("signal_id", "chr", "start", one.alias("end")), rafs.select("chr", "start", one.alias("end")), "signal_id", "depth")


def at_points(points: DataFrame, rafs: DataFrame) -> DataFrame:
    """point_id, coverage: fragments that hold a point (J08). points: (point_id, chr, at)."""
    asked = points.select("point_id", "chr", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    return overlap_sum(asked, rafs.where(F.col("start") < F.col("end")), "point_id", "coverage")


def reads_over(regions: DataFrame, rafs: DataFrame, least: int = 2, width: int = 500) -> DataFrame:
    """region_id, reads: distinct reads over regions, widened to at least 2 * radius bases
    with the odd one to the right (J09)."""
    lack = F.greatest(F.lit(least) - (F.col("end") - F.col("start")), F.lit(0))
    wide = regions.select("region_id", "chr", (F.col("start") - F.floor(lack / 2)).alias("start"), (F.col("end") + F.ceil(lack / 2)).alias("end"))
    spans = rafs.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "read_id")
    return range_join(wide, spans, width=width).groupBy("region_id").agg(F.count_distinct("read_id").alias("reads"))


def elementary(rafs: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct reads over each elementary interval, covered ones only.

    Fragments are cut at the edges of tiles, and of each only what no earlier one of its
    read reaches counts for the depth. A running maximum within the read's tile tells that,
    so nothing is joined back, and a read is as many groups as it has tiles. The ends of all
    fragments part the result, the edges of tiles do not."""
    rows = rafs.select("chr", "read_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    first, last = F.floor(F.col("start") / tile), F.floor((F.greatest("end", F.col("start") + 1) - 1) / tile)
    known = F.col("start").isNotNull() & F.col("end").isNotNull()
    rows = rows.withColumns({"_first": F.coalesce(first, F.lit(0)), "_last": F.when(known, last).otherwise(F.coalesce(first, F.lit(0)))})
    rows = rows.withColumn("_tile", F.explode(F.sequence("_first", "_last")))
    begins, ends = F.col("_tile") == F.col("_first"), F.col("_tile") == F.col("_last")
    pieces = rows.select("chr", "read_id", "_tile", F.when(begins, F.col("start")).otherwise(F.col("_tile") * tile).alias("s"), F.when(ends, F.col("end")).otherwise((F.col("_tile") + 1) * tile).alias("e"), begins.alias("begins"), ends.alias("ends"))
    earlier = W.partitionBy("chr", "read_id", "_tile").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.greatest("s", F.max(F.when(F.col("s").isNotNull(), F.col("e"))).over(earlier)))  # where what is new begins
    new = F.coalesce(F.col("read_id").isNotNull() & F.col("s").isNotNull() & (F.col("e") > F.col("at")), F.lit(False))
    event = lambda when, at, change, edge: F.when(when, F.struct(F.col(at).alias("position"), change.alias("change"), edge.alias("edge")))
    whole = new & (F.col("at") == F.col("s"))
    events = F.array_compact(F.array(
        event(F.col("begins") | whole, "s", F.when(whole, 1).otherwise(0), F.col("begins")),
        event(F.col("ends") | new, "e", F.when(new, -1).otherwise(0), F.col("ends")),
        event(new & ~whole, "at", F.lit(1), F.lit(False)),
    ))
    steps = pieces.select("chr", F.inline(events)).where("chr IS NOT NULL AND position IS NOT NULL")
    steps = steps.groupBy("chr", "position").agg(F.sum("change").alias("change"), F.max("edge").alias("edge")).where("edge OR change <> 0").drop("edge")
    out = along(steps, ("chr",), ("change",)).where("next IS NOT NULL AND sum_change > 0")
    return out.select("chr", F.col("position").alias("start"), F.col("next").alias("end"), F.col("sum_change").cast("bigint").alias("coverage"))


def median_depth(covered: DataFrame, column: str = "coverage") -> DataFrame:
    """Unweighted median over elementary intervals, cut to an integer."""
    return covered.agg(F.expr(f"cast(percentile({column}, 0.5) AS bigint)").alias("median_coverage"))


def rebinned(covered: DataFrame, regions: DataFrame, bin_size: int, width: int = 2000) -> DataFrame:
    """Median coverage of the elementary intervals that touch each bin of each region, 0
    where none does (A05). regions: (region_id, chr, start, end)."""
    from lociq.operators.intervals import tiles

    bins = tiles(regions, bin_size).select("region_id", "chr", "start", "end")
    pieces = covered.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "coverage")
    medians = range_join(bins, pieces, width=width).groupBy("region_id", "chr", "start", "end").agg(F.expr("cast(percentile(coverage, 0.5) AS bigint)").alias("coverage"))
    return bins.join(medians, ["region_id", "chr", "start", "end"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))


def close_regions(regions: DataFrame, distance: int) -> DataFrame:
    """Regions nearer than a distance, merged."""
    return merge(regions, gap=distance)


def max_depth(df: DataFrame) -> DataFrame:
    """Deepest point of each key's intervals."""
    return sweep(df).groupBy("chr").agg(F.max("depth").alias("max_depth"))


#: Copy-number states, their expected depth in medians, and stay probability (fixed values).
EXPECTED, STAY, DISPERSION = (0.01, 0.6, 1.0, 1.6, 2.2), 0.90, 0.1


def log_emission(observed: np.ndarray, expected: float, dispersion: float = DISPERSION) -> np.ndarray:
    """Poisson(0.1) for an expected depth near none, else a negative binomial whose
    variance is e + dispersion * e^2."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    if expected <= 0.1:
        log = observed * math.log(0.1) - 0.1 - lgamma(observed + 1)
    else:
        variance = expected + dispersion * expected**2
        n, p = expected**2 / (variance - expected), expected / variance
        log = lgamma(observed + n) - lgamma(np.full(1, n))[0] - lgamma(observed + 1) + n * math.log(p) + observed * math.log(1 - p)
    return np.log(np.exp(log) + 1e-10)


def model(median: float) -> tuple[list[float], np.ndarray, np.ndarray]:
    """(expected depths, log moves, log beginnings) of the copy-number states."""
    states = len(EXPECTED)
    move = np.log(np.where(np.eye(states, dtype=bool), STAY, (1 - STAY) / (states - 1)) + 1e-10)
    return [EXPECTED[0], *(f * median for f in EXPECTED[1:])], move, np.full(states, np.log(1 / states + 1e-10))


def viterbi(observed: np.ndarray, median: float) -> np.ndarray:
    """Most likely copy-number states of one region's bins; the lowest in a tie."""
    means, move, begin = model(median)
    emit = scans.whole(np.stack([log_emission(observed, e) for e in means], axis=1))
    score, back = scans.forward(scans.whole(begin), emit, scans.whole(move), True)
    return scans.traced(back, int(score.argmax()), True)[1:]


def copy_numbers(bins: DataFrame, median: float, rows: int = scans.ROWS) -> DataFrame:
    """Runs of equal copy number (W13), decoded by tiles of a region's bins: max-plus
    matrices of the tiles, the scores that enter each, and the path backwards. Runs of the
    tiles are joined where they meet."""
    means, move, begin = model(median)
    kinds = dict(bins.dtypes)

    def emissions(pdf: pd.DataFrame) -> np.ndarray:
        observed = pdf["coverage"].to_numpy(dtype=float)
        return np.stack([log_emission(observed, e) for e in means], axis=1)

    def runs(pdf: pd.DataFrame, states: np.ndarray) -> pd.DataFrame:
        first = np.flatnonzero(np.append(True, states[1:] != states[:-1]))
        start, end, row = (pdf[c].to_numpy() for c in ("start", "end", "_row"))
        head = pdf[["region_id", "chr"]].iloc[first].reset_index(drop=True)
        return head.assign(start=np.minimum.reduceat(start, first), end=np.maximum.reduceat(end, first), cn=states[first], row=row[first], past=np.append(row[first[1:]], row[-1] + 1))

    tiled = scans.in_tiles(bins, ("region_id",), ("start", "end"), rows)
    found = scans.viterbi_states(tiled, ("region_id",), emissions, move, begin, f"region_id {kinds['region_id']}, chr {kinds['chr']}, start bigint, `end` bigint, cn bigint, row bigint, past bigint", runs)
    found = cut(found)  # read more than once
    joined = island_ids(found, ("region_id", "cn"), "row", "past")
    out = joined.groupBy("region_id", "cn", "island_start").agg(F.min("chr").alias("chr"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select("region_id", "chr", "start", "end", "cn")


def highest_copy_number(regions: DataFrame, track: DataFrame) -> DataFrame:
    """region_id, cn: highest copy number over a region; 2 where there is none or 0."""
    spans = track.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "cn")
    hit = range_join(regions.select("region_id", "chr", "start", "end"), spans, points=True).groupBy("region_id").agg(F.max("cn").alias("cn"))
    return regions.select("region_id").join(hit, "region_id", "left").select("region_id", F.coalesce(F.nullif("cn", F.lit(0)), F.lit(2)).alias("cn"))


def usual_copy_number(regions: DataFrame, track: DataFrame) -> DataFrame:
    """region_id, cn: the commonest copy number over a region, 2 by default; in a tie the
    one nearer to 2, then the lower (J20)."""
    spans = track.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "cn")
    counts = range_join(regions.select("region_id", "chr", "start", "end"), spans, points=True).groupBy("region_id", "cn").agg(F.count("*").alias("n"))
    best = counts.groupBy("region_id").agg(F.min(F.struct(-F.col("n"), F.abs(F.col("cn") - 2), "cn")).alias("b")).select("region_id", F.col("b.cn").alias("cn"))
    return regions.select("region_id").join(best, "region_id", "left").select("region_id", F.coalesce("cn", F.lit(2)).alias("cn"))


def running_depth(rafs: DataFrame) -> DataFrame:
    """Adds depth: intervals begun so far that still reach past this one's start, itself
    included, in genome order (W05). Ends count before starts at one place, so the depth is
    a row's number less the ends up to its start."""
    rows = row_numbers(rafs.select("chr", "start", "end", "read_id"), ("chr",), ("start", "end", "read_id"))
    done = passed(rafs, rafs.select("chr", F.col("start").alias("position")).distinct(), ("chr",))
    return rows.join(done.select("chr", F.col("position").alias("start"), "done"), ["chr", "start"]).select("chr", "start", "end", "read_id", (F.col("row") + 1 - F.col("done")).alias("depth"))
