"""Alignments to read fragments and their structural signals.

alignments: (sample, qname, flag, rname, pos, mapq, cigar); pos is 0-based here.
Signal types: 0 insertion, 1 deletion, 3 left break, 4 right break.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions.dna import cigar_blocks, once
from lociq.operators.intervals import overlap_sum, passed, row_numbers, with_neighbours

SIGNAL = "struct<ref_start:bigint,ref_end:bigint,read_start:bigint,read_end:bigint,size:bigint,sv_type:int>"


def located(alignments: DataFrame) -> DataFrame:
    """Start and end of each alignment on reference and read; reads in their own
    direction (P02)."""
    df = alignments.withColumn("blocks", once(cigar_blocks())).withColumn("forward", F.expr("(flag & 16) = 0"))
    df = df.withColumns({
        "read_length": F.expr("aggregate(blocks, 0L, (s, b) -> s + b.read_end - b.read_start)"),
        "ref_start": F.col("pos").cast("bigint"),
        "ref_end": F.expr("aggregate(blocks, cast(pos AS bigint), (s, b) -> greatest(s, b.ref_end))"),
        "head": F.expr("CASE WHEN element_at(blocks, 1).op IN ('S', 'H') THEN aggregate(blocks, named_struct('n', 0L, 'on', true), (s, b) -> named_struct('n', s.n + if(s.on AND b.op IN ('S', 'H'), b.len, 0L), 'on', s.on AND b.op IN ('S', 'H')), s -> s.n) ELSE 0L END"),
        "tail": F.expr("aggregate(reverse(blocks), named_struct('n', 0L, 'on', true), (s, b) -> named_struct('n', s.n + if(s.on AND b.op IN ('S', 'H'), b.len, 0L), 'on', s.on AND b.op IN ('S', 'H')), s -> s.n)"),
    })
    first, last = F.col("head"), F.col("read_length") - F.col("tail")
    return df.withColumns({
        "read_start": F.when(F.col("forward"), first).otherwise(F.col("read_length") - last),
        "read_end": F.when(F.col("forward"), last).otherwise(F.col("read_length") - first),
    })


def with_signals(df: DataFrame, min_signal: int = 6, min_break: int = 300) -> DataFrame:
    """Adds sv_signals, breaks first, then deletions, then insertions, then sorted by
    reference place (P03-P05)."""
    break_ = lambda at, read, size, kind: f"named_struct('ref_start', {at}, 'ref_end', {at}, 'read_start', {read}, 'read_end', {read}, 'size', {size}, 'sv_type', {kind})"
    left = break_("ref_start", "if(forward, read_start, read_end)", "head", 3)
    right = break_("ref_end", "if(forward, read_end, read_start)", "tail", 4)
    # A block's read places count from the alignment's end on a reverse read.
    inner = "named_struct('ref_start', b.ref_start, 'ref_end', b.ref_end, 'read_start', if(forward, b.read_start, read_length - b.read_end), 'read_end', if(forward, b.read_end, read_length - b.read_start), 'size', b.len, 'sv_type', {kind})"
    of = lambda op, kind: f"transform(filter(blocks, b -> b.op = '{op}' AND b.len >= {min_signal}), b -> {inner.format(kind=kind)})"
    breaks = f"array_compact(array(CASE WHEN head >= {min_break} THEN {left} END, CASE WHEN tail >= {min_break} THEN {right} END))"
    signals = F.expr(f"array_sort(concat({breaks}, {of('D', 1)}, {of('I', 0)}))")
    return df.withColumn("sv_signals", signals.cast(f"array<{SIGNAL}>"))


def admitted(df: DataFrame, min_mapq: int = 1, min_segment: int = 250, most_depth: int | None = 400, unseparated: DataFrame | None = None) -> DataFrame:
    """Alignments that count: mapped well and primary or supplementary, long enough, not
    of an unseparated read, and not past the admitted depth (F01, F02, W05). Alignments that are
    passed over still count for the depth of later ones, so the depth is a plain count."""
    df = df.where((F.col("mapq") >= min_mapq) & F.expr("(flag & 4) = 0 AND (flag & 256) = 0") & (F.col("ref_end") - F.col("ref_start") >= min_segment))
    if unseparated is not None:
        df = df.join(unseparated.select("qname"), "qname", "left_anti")
    if most_depth is None:
        return df
    # Depth at a start is starts so far less ends so far.
    rows = row_numbers(df, ("rname",), ("ref_start", "ref_end", "qname", "flag"), "_row")
    done = passed(df, df.select("rname", F.col("ref_start").alias("position")).distinct(), ("rname",), "ref_start", "ref_end")
    deep = rows.join(done.select("rname", F.col("position").alias("ref_start"), F.col("done").alias("_done")), ["rname", "ref_start"])
    return deep.where(F.col("_row") + 1 - F.col("_done") <= most_depth).select(*df.columns)


def fragments(alignments: DataFrame, **limits) -> DataFrame:
    """Alignments to read fragments with nested signals, in genome order within partitions."""
    rows = with_signals(admitted(located(alignments), **limits))
    out = rows.select("sample", F.col("qname").alias("read_name"), F.col("rname").alias("chr"), "ref_start", "ref_end", "read_start", "read_end", "mapq", "forward", F.expr("(flag & 2048) > 0").alias("supplementary"), "sv_signals")
    return out.withColumn("effective", F.struct(F.col("chr"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end")))


def in_order(rafs: DataFrame, path: str, by=("chr", "ref_start", "ref_end")) -> None:
    """Fragments written in genome order (T01): ranges across files, sorted within."""
    rafs.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def name_hash(column: str):
    """Unsigned 64-bit xxHash of a name with seed 0 (X09), which the built-in function's
    fixed seed does not give."""
    import xxhash

    @F.pandas_udf("decimal(20,0)")
    def digest(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else Decimal(xxhash.xxh64_intdigest(x)))

    return digest(column)


def covering(rafs: DataFrame) -> DataFrame:
    """(chr, start, end, read_hash) of fragments, for depth by reads."""
    return rafs.select("chr", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), name_hash("read_name").alias("read_hash"))


def exploded(rafs: DataFrame) -> DataFrame:
    """One row per signal."""
    kept = [c for c in rafs.columns if c not in ("sv_signals", "ref_start", "ref_end", "read_start", "read_end", "effective")]
    # A plain inline asks for arrays with elements first, which would work them out twice.
    return rafs.select(*kept, F.inline_outer("sv_signals")).where("sv_type IS NOT NULL")


def dense(rafs: DataFrame, radius: int = 500, least: int = 30) -> DataFrame:
    """Signals kept where signals of their type within radius, themselves included, sum to
    `least` bases (W02, F04). Sums of what starts by the far end less what ends before the
    near one, by bisection in each fragment."""

    @F.pandas_udf("array<boolean>")
    def enough(starts: pd.Series, ends: pd.Series, sizes: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for s, e, z, k in zip(starts, ends, sizes, kinds):
            keep = np.zeros(len(s), dtype=bool)
            for kind in np.unique(k):
                own = np.flatnonzero(k == kind)
                by_start, by_end = own[np.argsort(s[own], kind="stable")], own[np.argsort(e[own], kind="stable")]
                begun, ended = (np.concatenate([[0], np.cumsum(z[x])]) for x in (by_start, by_end))
                total = begun[np.searchsorted(s[by_start], e[own] + radius, "right")] - ended[np.searchsorted(e[by_end], s[own] - radius, "left")]
                keep[own] = total >= least
            out.append(keep)
        return pd.Series(out)

    field = lambda c: F.coalesce(F.transform("sv_signals", lambda x: x[c].cast("bigint")), F.array().cast("array<bigint>"))
    marked = rafs.withColumn("_keep", enough(*map(field, ("ref_start", "ref_end", "size", "sv_type"))))
    return marked.withColumn("sv_signals", F.expr("filter(sv_signals, (s, i) -> _keep[i])")).drop("_keep")


def density(signals: DataFrame, radius: int = 500, group: tuple[str, ...] = ("read_id",), key: str = "chr") -> DataFrame:
    """signal_id, density: the same over a flat signal table, by sums over overlaps."""
    keys = (key, *group, "sv_type")
    # Within a distance inclusive: half-open intervals a base wider.
    reach = signals.select("signal_id", *keys, (F.col("start") - radius - 1).alias("start"), (F.col("end") + radius + 1).alias("end"))
    return overlap_sum(reach, signals.select(*keys, "start", "end", "size"), "signal_id", "density", keys, F.col("size").cast("bigint"))


def indel_histogram(signals: DataFrame) -> DataFrame:
    """(sv_type, size, n) of insertions and deletions."""
    return signals.where(F.col("sv_type").isin(0, 1)).groupBy("sv_type", "size").agg(F.count("*").alias("n"))


def size_cutoffs(histogram: DataFrame, aligned_bases: DataFrame, per_megabase: float) -> DataFrame:
    """Per type the least size whose count per megabase is at most the limit, at least 6."""
    rate = F.col("n") / (F.col("bases") / 1e6)
    return histogram.crossJoin(F.broadcast(aligned_bases)).where(rate <= per_megabase).groupBy("sv_type").agg(F.greatest(F.min("size"), F.lit(6)).alias("cutoff"))


def by_size(signals: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Deletions at least their cutoff, insertions at least the lesser of both; breaks
    stay (F05). Types without a cutoff get 999999."""
    two = cutoffs.agg(*(F.coalesce(F.max(F.when(F.col("sv_type") == t, F.col("cutoff"))), F.lit(999999)).alias(n) for t, n in ((0, "min_ins"), (1, "min_del"))))
    keep = F.when(F.col("sv_type") == 1, F.col("size") >= F.col("min_del")).when(F.col("sv_type") == 0, F.col("size") >= F.least("min_ins", "min_del")).otherwise(True)
    return signals.crossJoin(F.broadcast(two)).where(keep).drop("min_ins", "min_del")


def quiet(rafs: DataFrame, half_window: int = 15, percentile: float = 0.9, factor: float = 8.0, least: int = 3, key: str = "chr", tie: str = "read_id") -> DataFrame:
    """Drops fragments with many more deletions than their neighbours (W01, F06): over the
    rows before and after in genome order, those that overlap."""
    value = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col(tie).alias("t"), F.col("n_del").alias("n"))
    df = with_neighbours(rafs, (key,), ("start", "end", tie), half_window, value, "near")
    others = f"array_sort(transform(filter(near, o -> o.s < end AND o.e > start AND NOT (o.s = start AND o.e = end AND o.t = {tie})), o -> cast(o.n AS double)))"
    df = df.withColumn("near", once(F.expr(others)))
    place = f"((size(near) - 1) * {percentile}D)"
    level = f"near[cast(floor({place}) AS int)] + (near[cast(ceil({place}) AS int)] - near[cast(floor({place}) AS int)]) * ({place} - floor({place}))"
    df = df.withColumn("level", once(F.expr(f"CASE WHEN size(near) >= {least} THEN {level} END")))
    return df.where(F.col("level").isNull() | (F.col("n_del") <= factor * F.col("level"))).drop("near", "level")


def unseparated(alignments: DataFrame, least_share: float = 0.3, least_length: int = 500, most_apart: int = 1000) -> DataFrame:
    """Reads with opposite-strand alignments over one place (J10). alignments: (read_id,
    chr, start, end, forward, ord)."""
    a = alignments
    b = a.select("read_id", "chr", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("forward").alias("f2"), F.col("ord").alias("o2"))
    shared = F.least("end", "e2") - F.greatest("start", "s2")
    shorter = F.least(F.col("end") - F.col("start"), F.col("e2") - F.col("s2"))
    hit = (F.col("ord") > F.col("o2")) & (F.col("ord") - F.col("o2") <= most_apart) & (F.col("forward") != F.col("f2")) & (shorter >= least_length) & (shared / shorter >= least_share)
    return a.join(b, ["read_id", "chr"]).where(hit).select("read_id", "chr", "start", "end", "s2", "e2")
