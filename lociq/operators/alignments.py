"""Places between reads and the reference, cut alignments, read trimming and consensus
padding (X02, P18, A35, G09, G10, G14, F12, K17's rows).

Alignments carry `blocks` (functions.dna.cigar_blocks) with places in the alignment's own
direction; `forward` turns them into places on the read as it was sequenced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions.dna import once

MATCH = "('M', '=', 'X')"


def _clips(blocks: str) -> tuple[str, str, str]:
    """SQL for the clipped head, the place where the clipped tail begins, and the read's
    length."""
    length = f"element_at({blocks}, -1).read_end"
    head = f"if({blocks}[0].op IN ('S', 'H'), {blocks}[0].len, 0L)"
    tail = f"if(element_at({blocks}, -1).op IN ('S', 'H'), element_at({blocks}, -1).len, 0L)"
    return head, f"({length} - {tail})", length


def read_place(position: str, side: str = "nearest", blocks: str = "blocks", forward: str = "forward") -> Column:
    """Where a reference position lies on the read (X02). Before the alignment it is the
    first aligned base, from its end on the place past the last one. Inside a deletion the
    neighbouring aligned base on the side asked for ('left', 'right' as the read runs, or
    'nearest', the right one in a tie)."""
    head, tail, length = _clips(blocks)
    first, last = f"get(filter({blocks}, b -> b.op IN {MATCH}), 0).ref_start", f"try_element_at(filter({blocks}, b -> b.op IN {MATCH}), -1).ref_end"
    reach = "b.ref_start < {p} AND {p} <= b.ref_end" if side == "left" else "b.ref_start <= {p} AND {p} < b.ref_end"
    inside = f"get(filter({blocks}, b -> b.op IN {MATCH} AND {reach.format(p=position)}), 0)"
    before = f"try_element_at(filter({blocks}, b -> b.op IN {MATCH} AND b.ref_end <= {position}), -1)"
    after = f"get(filter({blocks}, b -> b.op IN {MATCH} AND b.ref_start >= {position}), 0)"
    if side == "nearest":
        gap = f"if({position} - {before}.ref_end < {after}.ref_start - {position}, {before}.read_end, {after}.read_start)"
    else:  # the read runs against the reference where it is reverse
        goes_on = f"{forward} = {'true' if side == 'right' else 'false'}"
        gap = f"if({goes_on}, {after}.read_start, {before}.read_end)"
    place = f"""CASE WHEN {position} < {first} THEN {head} WHEN {position} >= {last} THEN {tail}
        ELSE coalesce({inside}.read_start + {position} - {inside}.ref_start, {gap}, {before}.read_end, {after}.read_start) END"""
    return F.expr(f"if({forward}, {place}, {length} - ({place}))")


def reference_place(position: str, blocks: str = "blocks", forward: str = "forward") -> Column:
    """Where a place on the read lies on the reference (X02): in an insertion or a clip the
    end of the aligned base before it, or the start of the one after where none is before."""
    _, _, length = _clips(blocks)
    q = f"if({forward}, {position}, {length} - {position})"
    inside = f"get(filter({blocks}, b -> b.op IN {MATCH} AND b.read_start <= {q} AND {q} < b.read_end), 0)"
    before = f"try_element_at(filter({blocks}, b -> b.op IN {MATCH} AND b.read_end <= {q}), -1)"
    after = f"get(filter({blocks}, b -> b.op IN {MATCH} AND b.read_start >= {q}), 0)"
    return F.expr(f"coalesce({inside}.ref_start + {q} - {inside}.read_start, {before}.ref_end, {after}.ref_start)")


def cut(alignments: DataFrame, start: str = "r_start", end: str = "r_end", seq: str | None = None) -> DataFrame:
    """Alignments cut to a region: cut_pos, cut_cigar, and the piece of seq where given
    (P18). What is cut begins and ends with aligned bases; rows without any go."""
    part = f"""transform(filter(blocks, b -> b.op NOT IN ('S', 'H', 'P') AND
            if(b.ref_end > b.ref_start, b.ref_start < {end} AND {start} < b.ref_end, {start} < b.ref_start AND b.ref_start < {end})),
        b -> named_struct('op', b.op, 'from_ref', greatest(b.ref_start, {start}), 'to_ref', greatest(least(b.ref_end, {end}), b.ref_start),
            'from_read', if(b.op IN {MATCH}, b.read_start + greatest(b.ref_start, {start}) - b.ref_start, b.read_start),
            'to_read', if(b.op IN {MATCH}, b.read_end - b.ref_end + least(b.ref_end, {end}), b.read_end)))"""
    df = alignments.withColumn("_part", once(F.expr(part)))
    df = df.withColumn("_places", F.expr(f"transform(filter(transform(_part, (b, i) -> struct(b.op AS op, i AS i)), x -> x.op IN {MATCH}), x -> x.i)")).where(F.size("_places") > 0)
    df = df.withColumn("_part", F.expr("slice(_part, _places[0] + 1, element_at(_places, -1) - _places[0] + 1)"))
    cigar = "array_join(transform(_part, b -> concat(if(b.op = 'I', b.to_read - b.from_read, b.to_ref - b.from_ref), b.op)), '')"
    df = df.withColumns({"cut_pos": F.expr("_part[0].from_ref"), "cut_cigar": F.expr(cigar), "cut_from": F.expr("_part[0].from_read"), "cut_to": F.expr("element_at(_part, -1).to_read")})
    if seq is not None:
        df = df.withColumn("cut_seq", F.expr(f"substring({seq}, cast(cut_from AS int) + 1, cast(cut_to - cut_from AS int))"))
    return df.drop("_part", "_places")


def read_extents(alignments: DataFrame, keys=("container_id", "read_id")) -> DataFrame:
    """What of each read its alignments to a region cover (A35): the places on the read at
    the region's ends, first and last by (place, chr). alignments: (keys, chr, region_from,
    region_to, read_length), places on the read, in either order."""
    low, high = F.least("region_from", "region_to"), F.greatest("region_from", "region_to")
    return alignments.groupBy(*keys).agg(F.min(F.struct(low, "chr")).alias("low"), F.max(F.struct(high, "chr")).alias("high"), F.max("read_length").alias("read_length")).select(
        *keys, F.col("low.col1").alias("cut_start"), F.col("low.chr").alias("chr_start"), F.col("high.col1").alias("cut_end"), F.col("high.chr").alias("chr_end"), "read_length"
    )


def trimmed(reads: DataFrame, extents: DataFrame, keys=("container_id", "read_id")) -> DataFrame:
    """Reads cut to their extents (G09); those without any bases left go."""
    df = reads.join(extents, list(keys))
    return df.withColumn("cut_seq", F.expr("substring(seq, cast(cut_start AS int) + 1, cast(cut_end - cut_start AS int))")).where(F.length("cut_seq") > 0)


def padding(cuts: DataFrame, least: int = 0) -> DataFrame:
    """consensus_id, left_read, left_from, left_to, right_read, right_from, right_to, cap:
    the reads that reach furthest past a consensus on either side, and what of them lies
    there (G10). A side takes at most the larger of twice the consensus and `least` bases,
    those next to the consensus; the lesser read in a tie. cuts: (consensus_id, read_id,
    cut_start, cut_end, read_length, forward, consensus_length)."""
    f, s, e, n = F.col("forward"), F.col("cut_start"), F.col("cut_end"), F.col("read_length")
    df = cuts.withColumns({"before": F.when(f, s).otherwise(n - e), "past": F.when(f, n - e).otherwise(s)})
    best = lambda side: F.max(F.struct(F.col(side), (-F.col("read_id")).alias("r"), f.alias("f"), s.alias("s"), e.alias("e"), n.alias("n"))).alias(side)
    out = df.groupBy("consensus_id").agg(best("before"), best("past"), F.greatest(F.max("consensus_length") * 2, F.lit(least)).alias("cap"))
    p = lambda c: F.expr(c)
    return out.select(
        "consensus_id",
        (-F.col("before.r")).alias("left_read"),
        p("if(before.f, greatest(0, before.s - cap), before.e)").alias("left_from"),
        p("if(before.f, before.s, least(before.n, before.e + cap))").alias("left_to"),
        (-F.col("past.r")).alias("right_read"),
        p("if(past.f, past.e, greatest(0, past.s - cap))").alias("right_from"),
        p("if(past.f, least(past.n, past.e + cap), past.s)").alias("right_to"),
        "cap",
    )


def core_intervals(alignments: DataFrame) -> DataFrame:
    """The stretch of the reference that a consensus's core covers in each alignment
    (G14). alignments: (consensus_id, alignment, chr, blocks, forward, core_start,
    core_end), the core in places on the padded consensus."""
    a, b = reference_place("core_start"), reference_place("core_end")
    spans = alignments.select("consensus_id", "alignment", "chr", a.alias("a"), b.alias("b"))
    ends = once(F.struct(F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end")))
    return spans.select("consensus_id", "alignment", "chr", ends.alias("e")).where("e.start IS NOT NULL").select("consensus_id", "alignment", "chr", "e.start", "e.end")


def core_signals(signals: DataFrame, cores: DataFrame) -> DataFrame:
    """Signals that touch the core's stretch of their own alignment."""
    spans = cores.select("consensus_id", "alignment", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return signals.join(spans, ["consensus_id", "alignment"]).where((F.col("start") <= F.col("_e")) & (F.col("end") >= F.col("_s"))).drop("_s", "_e")


def in_region(signals: DataFrame, start: str, end: str) -> DataFrame:
    """Nested signals kept where they overlap the region's tile (F03): an empty one on the
    tile's border is in neither tile."""
    return signals.withColumn("sv_signals", F.expr(f"filter(sv_signals, s -> s.ref_start < {end} AND {start} < s.ref_end)"))
