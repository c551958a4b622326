"""Interval algebra on (key, start, end) columns, half-open.

Range joins go through bins of two widths, so that intervals of any length meet in an
equi-join; merges and running sums work tile by tile and then across tiles, row numbers
range by range, so that one chromosome is not one task. What only asks for a sum over the
overlapping intervals (`overlap_sum`) forms no pairs at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociq.operators.graph import cut

#: Widths of the two bin levels differ by this factor; intervals of more bins than that
#: take part on the coarse level only.
RATIO = 512
TILE = 1 << 22


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))


def overlap_length(a_start, a_end, b_start, b_end) -> Column:
    """Shared bases; 0 where the intervals do not meet."""
    return F.greatest(F.least(F.col(a_end), F.col(b_end)) - F.greatest(F.col(a_start), F.col(b_start)), F.lit(0))


def signed_overlap(a_start, a_end, b_start, b_end) -> Column:
    """Signed overlap in which touching intervals count 1."""
    return F.least(F.col(a_end), F.col(b_end)) - F.greatest(F.col(a_start), F.col(b_start)) + 1


def slop(df: DataFrame, by: int, lengths: DataFrame | None = None, key: str = "chr") -> DataFrame:
    """Pad both ends, clipped to the contig (P09). lengths: (key, length)."""
    out = df.withColumns({"start": F.greatest(F.col("start") - by, F.lit(0)), "end": F.col("end") + by})
    if lengths is None:
        return out
    return out.join(lengths, key).withColumn("end", F.least("end", "length")).drop("length")


def _leveled(df: DataFrame, start: str, end: str, width: int, is_left: bool, long_: str) -> DataFrame:
    """df with a row per level and bin that it takes part in. Level 0 is short with short,
    level 1 long left with any right, level 2 short left with long right."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    bins = lambda size, level: F.transform(F.sequence(F.floor(F.col(start) / size), F.floor(last / size)), lambda b: F.struct(F.lit(level).alias("l"), b.alias("b")))
    df = df.withColumn(long_, (F.floor(last / width) - F.floor(F.col(start) / width)) >= RATIO)
    fine, coarse = bins(width, 0), lambda level: bins(width * RATIO, level)
    if is_left:
        parts = F.when(F.col(long_), coarse(1)).otherwise(F.concat(fine, coarse(2)))
    else:
        parts = F.when(F.col(long_), F.concat(coarse(1), coarse(2))).otherwise(F.concat(fine, coarse(1)))
    return df.withColumn("_lb", F.explode(parts)).withColumns({"_level": F.col("_lb.l"), "_bin": F.col("_lb.b")}).drop("_lb", long_)


def range_join(
    left: DataFrame, right: DataFrame, key: str = "chr", left_span=("start", "end"), right_span=("r_start", "r_end"),
    width: int = 1000, within: int = 0, points: bool = False, condition: Column | None = None, also: tuple[str, ...] = (),
) -> DataFrame:
    """Every pair of the same key whose intervals overlap, once.

    within: also pairs less than so far apart. points: empty intervals count as one base;
    otherwise one overlaps what lies on both its sides. also: further columns that both
    sides have and that must be equal; they are join keys, so they part the bins.
    Other column names must differ between the sides.

    Short intervals meet short ones in fine bins only; an interval of `RATIO` bins or more
    meets others in coarse bins. The three levels are disjoint and part of the join key,
    so a pair is formed in a bin only where both sides belong there.
    """
    (ls, le), (rs, re_) = left_span, right_span
    a = left.withColumns({"_as": F.col(ls) - within, "_ae": (F.greatest(F.col(le), F.col(ls) + 1) if points else F.col(le)) + within})
    b = right.withColumns({"_bs": F.col(rs), "_be": F.greatest(F.col(re_), F.col(rs) + 1) if points else F.col(re_)})
    a, b = _leveled(a, "_as", "_ae", width, True, "_along"), _leveled(b, "_bs", "_be", width, False, "_blong")
    size = F.when(F.col("_level") == 0, F.lit(width)).otherwise(F.lit(width * RATIO))
    owner = F.floor(F.greatest("_as", "_bs") / size) == F.col("_bin")  # of several common bins the first
    meet = (F.col("_as") < F.col("_be")) & (F.col("_bs") < F.col("_ae"))
    out = a.join(b, [key, *also, "_level", "_bin"]).where(meet & owner)
    if condition is not None:
        out = out.where(condition)
    return out.drop("_as", "_ae", "_bs", "_be", "_level", "_bin")


def island_ids(df: DataFrame, keys=("chr",), start="start", end="end", gap: int = 0, touching: bool = True, tile: int = TILE) -> DataFrame:
    """df with island_start and island_end: the merged interval that each row lies in.

    Rows join when the next start is at most `gap` past the reach so far; with
    touching=False bookended rows stay apart. Rows shrink to a row per start first, so a
    tile's window holds `tile` rows at most; what earlier tiles reach and how many islands
    they begin is a row a tile. A row with a null key or start lies nowhere and goes.
    """
    keys = list(keys)
    places = df.groupBy(*keys, F.col(start).alias("_at")).agg(F.max(end).alias("_to")).withColumn("_tile", F.floor(F.col("_at") / tile))
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    reached = places.groupBy(*keys, "_tile").agg(F.max("_to").alias("_most")).select(*keys, "_tile", F.max("_most").over(before).alias("_reach"))
    own = W.partitionBy(*keys, "_tile").orderBy("_at")
    reach = F.greatest(F.max("_to").over(own.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach")) + gap
    apart = (F.col("_at") > reach) if touching else (F.col("_at") >= reach)
    marked = places.join(reached, [*keys, "_tile"]).withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    begun = marked.groupBy(*keys, "_tile").agg(F.sum("_new").alias("_n")).select(*keys, "_tile", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = marked.join(begun, [*keys, "_tile"]).select(*keys, "_at", "_to", (F.col("_island") + F.col("_before")).alias("_island"))
    spans = placed.groupBy(*keys, "_island").agg(F.min("_at").alias("island_start"), F.max("_to").alias("island_end"))
    named = placed.join(spans, [*keys, "_island"]).select(*keys, F.col("_at").alias(start), "island_start", "island_end")
    return df.join(named, [*keys, start])


def merge(df: DataFrame, keys=("chr",), gap: int = 0, touching: bool = True, aggregates=()) -> DataFrame:
    """The merged intervals, with aggregates over their members."""
    out = island_ids(df, keys, gap=gap, touching=touching).groupBy(*keys, "island_start", "island_end").agg(F.count("*").alias("members"), *aggregates)
    return out.withColumnsRenamed({"island_start": "start", "island_end": "end"})


def along(steps: DataFrame, keys, changes: tuple[str, ...], tile: int = TILE) -> DataFrame:
    """steps (keys, position, changes), one row a position, with the running sum of each
    change (sum_<change>) and the next position. Windows hold a tile's positions, of which
    there are `tile` at most; what crosses tiles is one row a tile. Steps with a null key or
    position go."""
    keys = list(keys)
    tiled = steps.withColumn("_tile", F.floor(F.col("position") / tile))
    over = W.partitionBy(*keys).orderBy("_tile")
    totals = tiled.groupBy(*keys, "_tile").agg(F.min("position").alias("_first"), *(F.sum(c).alias(f"_t_{c}") for c in changes))
    before = [F.coalesce(F.sum(f"_t_{c}").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{c}") for c in changes]
    edges = totals.select(*keys, "_tile", F.lead("_first").over(over).alias("_after"), *before)
    own = W.partitionBy(*keys, "_tile").orderBy("position")
    df = tiled.withColumns({"next": F.lead("position").over(own), **{f"sum_{c}": F.sum(c).over(own.rowsBetween(W.unboundedPreceding, 0)) for c in changes}})
    df = df.join(edges, [*keys, "_tile"]).withColumns({"next": F.coalesce("next", "_after"), **{f"sum_{c}": F.col(f"sum_{c}") + F.col(f"_b_{c}") for c in changes}})
    return df.drop("_tile", "_after", *(f"_b_{c}" for c in changes))


def subtract(lengths: DataFrame, df: DataFrame, key: str = "chr") -> DataFrame:
    """What of each contig (key, length) no interval covers (J25): where the depth is 0."""
    event = lambda rows, at, change: rows.select(key, F.col(at).cast("bigint").alias("position"), F.lit(change).alias("change"))
    ends = lengths.withColumn("_zero", F.lit(0))
    inside = df.join(lengths.select(key, "length"), key)
    events = event(inside, "start", 1).unionByName(event(inside, "end", -1)).unionByName(event(ends, "_zero", 0)).unionByName(event(ends, "length", 0))
    swept = along(events.groupBy(key, "position").agg(F.sum("change").alias("change")), (key,), ("change",))
    gaps = swept.where("sum_change = 0 AND next IS NOT NULL").join(lengths.select(key, "length"), key).where(F.col("position") < F.col("length"))
    return gaps.select(key, F.col("position").alias("start"), F.least("next", "length").alias("end"))


def running_sum(df: DataFrame, key: str, position: str, value: str, name: str, tile: int = TILE) -> DataFrame:
    """df with the running sum of value along position; one row for each (key, position)."""
    out = along(df.select(key, F.col(position).alias("position"), F.col(value).alias("_v")), (key,), ("_v",), tile)
    return df.join(out.select(key, F.col("position").alias(position), F.col("sum__v").alias(name)), [key, position])


def sweep(df: DataFrame, key: str = "chr", start: str = "start", end: str = "end", cuts: DataFrame | None = None) -> DataFrame:
    """Depth over elementary intervals by +1/-1 events (W04): (key, start, end, depth).
    cuts: intervals whose ends part the result too, without counting for the depth."""
    event = lambda rows, at, change: rows.select(key, F.col(at).alias("position"), F.lit(change).alias("change"))
    events = event(df, start, 1).unionByName(event(df, end, -1))
    if cuts is not None:
        events = events.unionByName(event(cuts, start, 0)).unionByName(event(cuts, end, 0))
    out = along(events.groupBy(key, "position").agg(F.sum("change").alias("change")), (key,), ("change",))
    return out.where("next IS NOT NULL AND sum_change > 0").select(key, F.col("position").alias("start"), F.col("next").alias("end"), F.col("sum_change").cast("bigint").alias("depth"))


def passed(spans: DataFrame, points: DataFrame, keys, start: str = "start", end: str = "end", value: Column | None = None) -> DataFrame:
    """(keys, position, before, done): at each position of points (keys, position), the sum of value over the
    spans that start before it, and over those that end at or before it. A count by
    default. Spans and points shrink to their positions before anything is sorted."""
    keys, value = list(keys), F.lit(1).cast("bigint") if value is None else value
    none = F.lit(0).cast("bigint")
    rows = spans.select(*keys, F.col(start).alias("position"), value.alias("begun"), none.alias("ended"))
    rows = rows.unionByName(spans.select(*keys, F.col(end).alias("position"), none.alias("begun"), value.alias("ended")))
    rows = rows.unionByName(points.select(*keys, "position", none.alias("begun"), none.alias("ended")))
    out = along(rows.groupBy(*keys, "position").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended")), keys, ("begun", "ended"))
    return out.select(*keys, "position", (F.col("sum_begun") - F.col("begun")).alias("before"), F.col("sum_ended").alias("done"))


def overlap_sum(queries: DataFrame, spans: DataFrame, id_col: str, name: str, keys=("chr",), value: Column | None = None) -> DataFrame:
    """(id, name): the sum of value (a count by default) over the spans that overlap each
    query, 0 where none does. What starts before a query's end less what ends by its start
    is what overlaps it, so no pair is formed. Both have (keys, start, end); spans are not
    empty, or count on both sides of their place only where a query reaches over it."""
    keys = list(keys)
    ask = queries.select(id_col, *keys, F.explode(F.array(F.struct(F.col("end").alias("p"), F.lit(1).alias("sign")), F.struct(F.col("start").alias("p"), F.lit(-1).alias("sign")))).alias("_q"))
    ask = ask.select(id_col, *keys, F.col("_q.p").alias("position"), F.col("_q.sign").alias("sign"))
    known = passed(spans, ask.select(*keys, "position").distinct(), keys, value=value)
    return ask.join(known, [*keys, "position"]).groupBy(id_col).agg(F.sum(F.when(F.col("sign") == 1, F.col("before")).otherwise(-F.col("done"))).alias(name))


def row_numbers(df: DataFrame, keys, order, name: str = "row") -> DataFrame:
    """df with its rows' numbers from 0 within each key. Rows are dealt by ranges of (keys,
    order), so that a key is as many tasks as its size asks for; each range counts its own
    rows and adds those of the ranges before it. The ranges are written down first, since
    a lost executor must not redraw them."""
    keys, order = list(keys), list(order)
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))  # ranges, and keys' ends
    over = (W.partitionBy(*keys) if keys else W).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_offset"))
    own = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    return dealt.withColumn(name, own.cast("bigint") - 1).join(offsets, [*keys, "_part"]).withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset")


def with_neighbours(df: DataFrame, keys, order, half: int, value: Column, name: str, bucket: int = 1 << 14) -> DataFrame:
    """df with the values of up to `half` rows before and after each row, in order. Rows go
    by buckets of their numbers, with the edge rows of the buckets beside."""
    keys = list(keys)
    bucket = max(bucket, 2 * half)
    df = row_numbers(df.withColumn("_v", value), keys, order, "_row")
    place, at = F.floor(F.col("_row") / bucket), F.col("_row") % bucket
    near = F.array_compact(F.array(place, F.when(at < half, place - 1), F.when(at >= bucket - half, place + 1)))
    window = W.partitionBy(*keys, "_bucket").orderBy("_row").rowsBetween(-half, half)
    dealt = df.withColumn("_bucket", F.explode(near)).withColumn(name, F.collect_list("_v").over(window))
    return dealt.where(F.col("_bucket") == place).drop("_bucket", "_row", "_v")


def tiles(df: DataFrame, size: int) -> DataFrame:
    """Regions cut into tiles of a size, the last one shorter."""
    step = F.explode(F.sequence(F.col("start"), F.greatest(F.col("end") - 1, F.col("start")), F.lit(size).cast("bigint")))
    return df.where("start < end").withColumn("_s", step).withColumn("end", F.least(F.col("_s") + size, F.col("end"))).withColumn("start", F.col("_s")).drop("_s")


def lift(features: DataFrame, regions: DataFrame, width: int = 1000) -> DataFrame:
    """Features clipped to regions and moved to region coordinates.
    regions: (chr, r_start, r_end, region_id)."""
    hit = range_join(features, regions, width=width)
    return hit.select(
        "region_id",
        *(c for c in features.columns if c not in ("start", "end")),
        (F.greatest("start", "r_start") - F.col("r_start")).alias("start"),
        (F.least("end", "r_end") - F.col("r_start")).alias("end"),
    )
