"""Queries on places between reads and reference, statistics, and the way to calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.functions import dna, scores
from lociq.operators import alignments, calls, candidates, coverage, signals, statistics
from lociq.plans.catalog import CIGARS, query
from lociq.plans.views import rounded, view


def read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- places on reads ------------------------------------------------------------------

KEY = "aln_id, pos, a, b, c"
OPS = f"""x AS (SELECT DISTINCT * FROM ({CIGARS})),
    ops AS (SELECT *, 0 AS k, 'S' AS op, a AS len FROM x UNION ALL SELECT *, 1, 'M', b * 10 FROM x UNION ALL SELECT *, 2, 'D', CAST(c AS BIGINT) FROM x UNION ALL SELECT *, 3, 'M', b FROM x UNION ALL SELECT *, 4, 'I', a + 1 FROM x UNION ALL SELECT *, 5, 'M', 7 FROM x),
    run AS (SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len END) OVER w, 0) AS BIGINT) AS q, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D') THEN len END) OVER w, 0) AS BIGINT) AS r FROM ops WINDOW w AS (PARTITION BY {KEY} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    m AS (SELECT * FROM run WHERE op = 'M')"""
#: A place on the reference, one on the read, and a region, by the same arithmetic.
ASKED = "a % 2 = 0 AS forward, pos - 5 + (aln_id * 7 + b) % (b * 11 + c + 20) AS p, (aln_id * 3 + a) % (2 * a + b * 11 + 8) AS q0, pos + aln_id % (b * 10) AS s, pos + aln_id % (b * 10) + b + 2 * c AS e"
PLACED = f"""{OPS}, t AS (SELECT {KEY}, {ASKED}, 2 * a + b * 11 + 8 AS n FROM x),
    on_read AS (SELECT t.*, min(m.r) AS first, max(m.r + len) AS last, max(CASE WHEN m.r <= p AND p < m.r + len THEN m.q + p - m.r END) AS inside,
        arg_max(m.q + len, m.r) FILTER (WHERE m.r + len <= p) AS before, max(m.r + len) FILTER (WHERE m.r + len <= p) AS before_r, arg_min(m.q, m.r) FILTER (WHERE m.r >= p) AS after, min(m.r) FILTER (WHERE m.r >= p) AS after_r
        FROM t JOIN m USING ({KEY}) GROUP BY ALL),
    nearest AS (SELECT *, CASE WHEN p < first THEN a WHEN p >= last THEN n ELSE coalesce(inside, CASE WHEN p - before_r < after_r - p THEN before ELSE after END) END AS near,
        CASE WHEN p < first THEN a WHEN p >= last THEN n ELSE coalesce(inside, CASE WHEN forward THEN after ELSE before END) END AS right_side FROM on_read)"""


#: Where a place p of the read lies on the reference, over the aligned parts m.
ON_REFERENCE = "coalesce(max(CASE WHEN m.q <= {0} AND {0} < m.q + len THEN m.r + {0} - m.q END), max(m.r + len) FILTER (WHERE m.q + len <= {0}), min(m.r) FILTER (WHERE m.q >= {0}))"


def asked(spark, d):
    """Alignments, and the places asked for."""
    rows = read(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS aln_id", "l_partkey AS pos", "l_suppkey AS a", "CAST(l_quantity AS BIGINT) AS b", "CAST(l_linenumber AS BIGINT) AS c").distinct()
    return rows.selectExpr("*", *(f"{x.strip()}" for x in ASKED.split(", ")), "concat(a, 'S', b * 10, 'M', c, 'D', b, 'M', a + 1, 'I7M') AS cigar")


def aligned(spark, d):
    """The same with their CIGARs' blocks."""
    return asked(spark, d).withColumn("blocks", dna.once(dna.cigar_blocks()))


@query(f"WITH {PLACED} SELECT {KEY}, CASE WHEN forward THEN near ELSE n - near END AS nearest, CASE WHEN forward THEN right_side ELSE n - right_side END AS rightwards FROM nearest")
def read_places(spark, d):
    return aligned(spark, d).select(*KEY.split(", "), alignments.read_place("p").alias("nearest"), alignments.read_place("p", "right").alias("rightwards"))


@query(f"""WITH {OPS}, t AS (SELECT {KEY}, CASE WHEN a % 2 = 0 THEN q0 ELSE n - q0 END AS p FROM (SELECT {KEY}, {ASKED}, 2 * a + b * 11 + 8 AS n FROM x))
    SELECT {KEY}, {ON_REFERENCE.format('p')} AS place FROM t JOIN m USING ({KEY}) GROUP BY {KEY}""")
def reference_places(spark, d):
    return aligned(spark, d).select(*KEY.split(", "), alignments.reference_place("q0").alias("place"))


@query(f"""WITH {OPS}, t AS (SELECT {KEY}, {ASKED} FROM x),
    parts AS (SELECT {KEY}, k, op, greatest(r, s) AS from_r, CASE op WHEN 'I' THEN len ELSE least(r + len, e) - greatest(r, s) END AS n FROM run JOIN t USING ({KEY})
        WHERE op <> 'S' AND CASE op WHEN 'I' THEN s < r AND r < e ELSE r < e AND s < r + len END),
    ends AS (SELECT {KEY}, min(k) FILTER (WHERE op = 'M') AS k1, max(k) FILTER (WHERE op = 'M') AS k2 FROM parts GROUP BY {KEY})
    SELECT {KEY}, min(from_r) AS cut_pos, string_agg(CAST(n AS VARCHAR) || op, '' ORDER BY k) AS cut_cigar FROM parts JOIN ends USING ({KEY}) WHERE k BETWEEN k1 AND k2 GROUP BY {KEY}""")
def cut_cigars(spark, d):
    return alignments.cut(aligned(spark, d), "s", "e").select(*KEY.split(", "), "cut_pos", "cut_cigar")


@query(f"""WITH {OPS}, core AS (SELECT {KEY}, a + 3 AS u, a + b * 11 AS v, 2 * a + b * 11 + 8 AS n FROM x),
    t AS (SELECT {KEY}, CASE WHEN a % 2 = 0 THEN u ELSE n - u END AS p1, CASE WHEN a % 2 = 0 THEN v ELSE n - v END AS p2 FROM core),
    e AS (SELECT {KEY}, {ON_REFERENCE.format('p1')} AS u, {ON_REFERENCE.format('p2')} AS v FROM t JOIN m USING ({KEY}) GROUP BY {KEY})
    SELECT aln_id AS consensus_id, pos AS alignment, CAST(c AS BIGINT) AS chr, least(u, v) AS start, greatest(u, v) AS "end" FROM e""")
def core_intervals(spark, d):
    rows = aligned(spark, d).selectExpr("aln_id AS consensus_id", "pos AS alignment", "c AS chr", "blocks", "forward", "a + 3 AS core_start", "a + b * 11 AS core_end")
    return alignments.core_intervals(rows)


PARTS = "SELECT l_suppkey % 20 AS container_id, l_orderkey AS read_id, l_partkey % 5 AS chr, l_partkey % 700 AS u, l_partkey % 700 + (l_linenumber - 4) * 30 AS v, 900 + l_orderkey % 300 AS n FROM lineitem"


@query(f"""WITH t AS ({PARTS}), g AS (SELECT container_id, read_id, min({{'p': least(u, v), 'c': chr}}) AS lo, max({{'p': greatest(u, v), 'c': chr}}) AS hi, max(n) AS read_length FROM t GROUP BY ALL)
    SELECT container_id, read_id, lo.p AS cut_start, lo.c AS chr_start, hi.p AS cut_end, hi.c AS chr_end, read_length FROM g""")
def read_extents(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("lociq_lineitem")
    rows = spark.sql(PARTS.replace("FROM lineitem", "FROM lociq_lineitem")).withColumnsRenamed({"u": "region_from", "v": "region_to", "n": "read_length"})
    return alignments.read_extents(rows)


CUTS = "SELECT l_suppkey AS consensus_id, l_orderkey * 10 + l_linenumber AS read_id, min(l_partkey) % 300 AS s, min(l_partkey) % 300 + 50 AS e, min(l_partkey) % 300 + 50 + min(l_orderkey) % 400 AS n, min(l_partkey) % 3 > 0 AS f, max(l_partkey) % 90 AS k FROM {0} GROUP BY l_suppkey, l_orderkey * 10 + l_linenumber"


@query(f"""WITH t AS ({CUTS.format('lineitem')}), u AS (SELECT *, CASE WHEN f THEN s ELSE n - e END AS before, CASE WHEN f THEN n - e ELSE s END AS past, greatest(2 * max(k) OVER (PARTITION BY consensus_id), 40) AS cap FROM t),
    l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY consensus_id ORDER BY before DESC, read_id) = 1), r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY consensus_id ORDER BY past DESC, read_id) = 1)
    SELECT consensus_id, l.read_id AS left_read, CASE WHEN l.f THEN greatest(0, l.s - l.cap) ELSE l.e END AS left_from, CASE WHEN l.f THEN l.s ELSE least(l.n, l.e + l.cap) END AS left_to,
        r.read_id AS right_read, CASE WHEN r.f THEN r.e ELSE greatest(0, r.s - r.cap) END AS right_from, CASE WHEN r.f THEN least(r.n, r.e + r.cap) ELSE r.s END AS right_to, l.cap FROM l JOIN r USING (consensus_id)""")
def consensus_padding(spark, d):
    rows = spark.sql(CUTS.format("{t}"), t=read(spark, d, "lineitem")).withColumnsRenamed({"s": "cut_start", "e": "cut_end", "n": "read_length", "f": "forward", "k": "consensus_length"})
    return alignments.padding(rows, 40)


@query(f"""WITH {OPS}, t AS (SELECT *, a % 2 = 0 AS forward, 2 * a + b * 11 + 8 AS n FROM run),
    s AS (SELECT {KEY}, CASE op WHEN 'D' THEN 1 ELSE 0 END AS sv_type, r AS ref_start, r + CASE op WHEN 'D' THEN len ELSE 0 END AS ref_end, CASE WHEN forward THEN q ELSE n - q - CASE op WHEN 'I' THEN len ELSE 0 END END AS read_start, CASE WHEN forward THEN q + CASE op WHEN 'I' THEN len ELSE 0 END ELSE n - q END AS read_end, len AS size FROM t WHERE op IN ('D', 'I') AND len >= 3
        UNION ALL SELECT {KEY}, 3, pos, pos, CASE WHEN forward THEN a ELSE n - a END, CASE WHEN forward THEN a ELSE n - a END, a FROM t WHERE k = 0 AND a >= 5)
    SELECT {KEY}, CAST(sv_type AS INT) AS sv_type, ref_start, ref_end, read_start, read_end, size FROM s""")
def alignment_signals(spark, d):
    rows = asked(spark, d).drop("forward").withColumn("flag", F.expr("CASE WHEN a % 2 = 0 THEN 0 ELSE 16 END"))
    return signals.with_signals(signals.located(rows), 3, 5).select(*KEY.split(", "), F.inline_outer("sv_signals")).where("sv_type IS NOT NULL")


@query("""WITH good AS (SELECT chr, s, e, read_id, n_del FROM v_raf WHERE n_del >= 2 AND e - s >= 100 AND NOT forward),
    deep AS (SELECT a.chr, a.s, a.e, a.read_id, a.n_del, count(*) AS depth FROM good a JOIN good b ON a.chr = b.chr AND b.s <= a.s AND b.e > a.s WHERE b.s < a.s OR (b.e, b.read_id, b.n_del) <= (a.e, a.read_id, a.n_del) GROUP BY ALL)
    SELECT chr, s AS start, e AS "end", read_id, n_del FROM deep WHERE depth <= 8""")
def admitted_alignments(spark, d):
    rows = view(spark, d, "v_raf").selectExpr("chr AS rname", "start AS ref_start", "`end` AS ref_end", "read_id AS qname", "cast(n_del AS int) AS mapq", "CASE WHEN forward THEN 256 ELSE 16 END + n_del * 512 AS flag", "n_del")
    return signals.admitted(rows, min_mapq=2, min_segment=100, most_depth=8).select(F.col("rname").alias("chr"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), F.col("qname").alias("read_id"), "n_del")


# --- statistics -----------------------------------------------------------------------


@query("SELECT CAST(quantile_cont(e - s, 0.5) * 10 AS BIGINT) AS bin_size FROM v_raf")
def bin_size_median(spark, d):
    return statistics.bin_size(view(spark, d, "v_raf").select((F.col("end") - F.col("start")).alias("length")))


@query("""WITH steps AS (SELECT chr, p, sum(c) AS c FROM (SELECT chr, s AS p, 1 AS c FROM v_raf UNION ALL SELECT chr, e, -1 FROM v_raf) GROUP BY chr, p),
    deep AS (SELECT chr, p AS s, lead(p) OVER w AS e, sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS depth FROM steps WINDOW w AS (PARTITION BY chr ORDER BY p)),
    bins AS (SELECT chr, unnest(range(0, (max(e) + 99) // 100 + 1)) AS bin FROM v_raf GROUP BY chr),
    most AS (SELECT chr, bin, max(depth) AS depth FROM (SELECT chr, depth, unnest(range(s // 100, (e - 1) // 100 + 1)) AS bin FROM deep WHERE e IS NOT NULL AND depth > 0) GROUP BY ALL)
    SELECT chr, bin, CAST(coalesce(depth, 0) AS BIGINT) AS depth FROM bins LEFT JOIN most USING (chr, bin)""")
def binned_max_depth(spark, d):
    rows = view(spark, d, "v_raf")
    lengths = rows.groupBy("chr").agg(F.expr("(max(`end`) + 99) div 100 * 100 + 100").alias("length"))
    return statistics.binned_max_depth(rows, lengths, 100)


def members(spark, d):
    return view(spark, d, "v_signal").withColumn("region_id", F.expr("signal_id % 70"))


@query("SELECT signal_id % 70 AS region_id, CAST(floor(coalesce(quantile_cont(CASE WHEN sv_type <= 1 THEN size END, 0.5), 0)) AS BIGINT) AS median_size FROM v_signal GROUP BY 1")
def median_indel_sizes(spark, d):
    return statistics.median_indel_sizes(members(spark, d))


@query("WITH m AS (SELECT signal_id % 70 AS g, avg(size) AS m FROM v_signal GROUP BY 1) SELECT round(quantile_cont(m, 0.5), 6) AS median_of_means FROM m")
def median_of_region_means(spark, d):
    return rounded(statistics.median_of_means(members(spark, d), value="size"), "median_of_means")


@query("SELECT signal_id % 70 AS region_id, read_id, CAST(sum(CASE sv_type WHEN 0 THEN size ELSE 0 END) AS BIGINT) AS inserted, CAST(sum(CASE sv_type WHEN 1 THEN size ELSE 0 END) AS BIGINT) AS deleted FROM v_signal GROUP BY 1, 2")
def summed_indels(spark, d):
    return statistics.summed_indels(members(spark, d))


@query("SELECT least(l_suppkey, l_partkey % 50) AS a, greatest(l_suppkey, l_partkey % 50) AS b, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber + l_extendedprice / 1e9) AS aligned FROM lineitem GROUP BY 1, 2")
def pair_lengths(spark, d):
    rows = read(spark, d, "lineitem").selectExpr("l_suppkey AS query", "l_partkey % 50 AS target", "l_orderkey * 10 + l_linenumber + l_extendedprice / 1e9D AS ord", "l_extendedprice AS aligned")
    return statistics.pair_lengths(rows)


@query("""WITH g AS (SELECT signal_id % 70 AS group_id, s % 400 AS s, s % 400 + (e - s) AS e, CAST(size AS DOUBLE) AS w FROM v_signal), p AS (SELECT *, unnest(range(greatest(s - 50, 0), e + 51)) AS position FROM g)
    SELECT group_id, position, round(sum(w * 2 / (1 + exp(greatest(s - position, position - e, 0) / 10.0))), 4) AS density FROM p GROUP BY 1, 2""")
def density_tracks(spark, d):
    rows = members(spark, d).selectExpr("region_id AS group_id", "start % 400 AS start", "start % 400 + (`end` - start) AS `end`", "cast(size AS double) AS weight")
    return rounded(statistics.density_track(rows), "density", places=4)


@query("""WITH n AS (SELECT doc_id, length(seq) AS n, [length(seq) - length(replace(seq, x, '')) for x in ['A', 'C', 'G', 'T']] AS f FROM v_dna), k AS (SELECT *, len(list_filter(f, lambda x: x > 0)) AS m FROM n)
    SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE list_sum([least(1.0::DOUBLE, x / (n / CAST(m AS DOUBLE))) for x in f]) END, 6) AS heterogeneity FROM k""")
def sequence_heterogeneity(spark, d):
    return rounded(statistics.heterogeneity(view(spark, d, "v_dna")), "heterogeneity").select("doc_id", "heterogeneity")


@query()
def complexity_tracks(spark, d):
    """Means of the tracks; a test holds them against a plain sliding window."""
    out = statistics.complexity_track(view(spark, d, "v_dna"))
    return out.select("doc_id", F.size("track").alias("n"), F.round(F.expr("try_divide(aggregate(track, 0D, (s, x) -> s + x), size(track))"), 6).alias("mean"))


@query("""WITH n AS (SELECT svtype, size % 7 AS size_bin, count(*) AS n FROM v_genotype GROUP BY 1, 2)
    SELECT svtype, size_bin, n, round(100.0 * sum(n) OVER (PARTITION BY svtype ORDER BY size_bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY svtype), 6) AS share FROM n""")
def running_share(spark, d):
    counts = view(spark, d, "v_genotype").groupBy("svtype", F.expr("size % 7").alias("size_bin")).agg(F.count("*").alias("n"))
    return rounded(statistics.running_share(counts), "share")


SWEPT = """{1} AS (WITH steps AS (SELECT chr, p, sum(c) AS c FROM (SELECT chr, s AS p, 1 AS c FROM {0} UNION ALL SELECT chr, e, -1 FROM {0}) GROUP BY chr, p)
    SELECT * FROM (SELECT chr, p AS s, lead(p) OVER w AS e, sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS depth FROM steps WINDOW w AS (PARTITION BY chr ORDER BY p)) WHERE e IS NOT NULL AND depth > 0)"""


@query(f"""WITH few AS (SELECT * FROM v_raf WHERE n_del = 1), {SWEPT.format('v_raf', 'every')}, {SWEPT.format('few', 'own')},
    means AS (SELECT chr, sum(depth * (e - s)) / CAST(sum(e - s) AS DOUBLE) AS mean FROM every GROUP BY chr), thin AS (SELECT o.* FROM own o JOIN means USING (chr) WHERE depth < ceil(mean * 0.5))
    SELECT DISTINCT f.read_id FROM few f JOIN thin t ON f.chr = t.chr AND f.s < t.e AND t.s < f.e""")
def thin_place_reads(spark, d):
    rows = view(spark, d, "v_raf")
    return statistics.over_thin_places(rows.where("n_del = 1"), rows, 0.5)


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS region_id, l_orderkey % 400 AS consensus_id FROM lineitem)
    SELECT r.s_suppkey AS region_id, m.consensus_id, CASE WHEN m.consensus_id IS NOT NULL THEN coalesce((SELECT string_agg(CAST(o.region_id AS VARCHAR), ',' ORDER BY o.region_id) FROM m o WHERE o.consensus_id = m.consensus_id AND o.region_id <> m.region_id), '') END AS others
    FROM supplier r LEFT JOIN m ON m.region_id = r.s_suppkey""")
def regions_of_consensus(spark, d):
    parts = read(spark, d, "lineitem").selectExpr("l_suppkey AS region_id", "l_orderkey % 400 AS consensus_id").distinct()
    found = statistics.others_of_consensus(read(spark, d, "supplier").selectExpr("s_suppkey AS region_id"), parts)
    return found.select("region_id", "consensus_id", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query("""SELECT a.signal_id, b.signal_id AS neighbour_id FROM v_signal a JOIN v_signal b ON a.chr = b.chr AND a.sv_type = b.sv_type AND a.signal_id <> b.signal_id
    AND (abs(a.s - b.s) <= 200 OR (a.sv_type = 1 AND (abs(a.e - b.e) <= 200 OR abs(a.e - b.s) <= 200)))""")
def signal_neighbours(spark, d):
    return statistics.neighbours(view(spark, d, "v_signal"), 200)


@query("""WITH marked AS (SELECT *, CASE WHEN s >= max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM v_repeat),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked)
    SELECT repeat_id, chr, min(s) OVER (PARTITION BY chr, g) AS group_start FROM numbered""")
def overlap_groups(spark, d):
    return statistics.overlap_groups(view(spark, d, "v_repeat")).select("repeat_id", "chr", "group_start")


@query("SELECT region_id FROM v_region WHERE e - s > 600")
def large_regions(spark, d):
    return statistics.larger_than(view(spark, d, "v_region"), 600).select("region_id")


@query("SELECT signal_id FROM v_signal WHERE read_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def signals_by_names(spark, d):
    names = read(spark, d, "customer").where("c_nationkey < 12").selectExpr("c_custkey AS read_id")
    return statistics.by_names(view(spark, d, "v_signal"), names).select("signal_id")


@query("SELECT signal_id FROM v_signal WHERE read_id NOT IN (SELECT read_id FROM v_signal WHERE sv_type >= 3 GROUP BY read_id HAVING count(*) > 38)")
def few_segment_signals(spark, d):
    return statistics.few_segments(view(spark, d, "v_signal"), 38).select("signal_id")


@query("SELECT s_suppkey AS region_id FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0 UNION SELECT s_suppkey + 1 FROM supplier WHERE s_nationkey % 3 = 0)")
def unconnected_regions(spark, d):
    rows = read(spark, d, "supplier")
    edges = rows.where("s_nationkey % 3 = 0").selectExpr("s_suppkey AS a", "s_suppkey + 1 AS b")
    return statistics.unconnected(rows.selectExpr("s_suppkey AS region_id"), edges)


@query()
def similar_windows(spark, d):
    """Windows of twelve bases like the one at 20; a test holds them against plain loops."""
    return statistics.similar_windows(view(spark, d, "v_dna"), "20", "32", 4)


@query()
def read_halves(spark, d):
    """Half of the reads for the first attempt, by hashes; a test looks at its share."""
    return statistics.subsample(view(spark, d, "v_raf").select("read_id").distinct())


# --- calls ----------------------------------------------------------------------------

PRIMITIVES = "SELECT signal_id, signal_id % 900 AS composite_id, CASE sv_type WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' WHEN 3 THEN 'INV' ELSE 'BND' END AS svtype, chr, s, e, size, 1 + read_id % 9 AS support, read_id FROM v_signal"


def primitives(spark, d):
    svtype = F.expr("CASE sv_type WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' WHEN 3 THEN 'INV' ELSE 'BND' END")
    return view(spark, d, "v_signal").select("signal_id", F.expr("signal_id % 900").alias("composite_id"), svtype.alias("svtype"), "chr", "start", "end", "size", F.expr("1 + read_id % 9").alias("support"), "read_id")


@query(f"""WITH p AS ({PRIMITIVES}) SELECT signal_id AS pattern_id, svtype, chr, greatest(s - CASE svtype WHEN 'DEL' THEN 0 ELSE 150 END, 0) AS start, e + CASE svtype WHEN 'DEL' THEN 0 ELSE 150 END AS "end" FROM p""")
def pattern_regions(spark, d):
    return calls.regions_of(primitives(spark, d).withColumnRenamed("signal_id", "pattern_id"), 150).select("pattern_id", "svtype", "chr", "start", "end")


@query(f"WITH p AS ({PRIMITIVES}) SELECT signal_id, svtype || '|' || chr || ':' || s || '-' || e || '|' || least(CAST(read_id AS VARCHAR), CAST(signal_id AS VARCHAR)) || ',' || greatest(CAST(read_id AS VARCHAR), CAST(signal_id AS VARCHAR)) AS log_id FROM p")
def call_log_ids(spark, d):
    return primitives(spark, d).withColumn("consensus_ids", F.array("read_id", "signal_id")).select("signal_id", calls.log_id().alias("log_id"))


@query("""WITH track AS (SELECT p_partkey % 5 AS chr, p_partkey * 50 AS s, p_partkey * 50 + 100 AS e, p_size % 7 AS cn FROM part), h AS (SELECT g.region_id, max(cn) AS cn FROM v_region g LEFT JOIN track t ON g.chr = t.chr AND g.s < t.e AND t.s < g.e GROUP BY 1)
    SELECT region_id FROM h WHERE coalesce(nullif(cn, 0), 2) <= 4""")
def analysable_containers(spark, d):
    track = read(spark, d, "part").selectExpr("p_partkey % 5 AS chr", "p_partkey * 50 AS start", "p_partkey * 50 + 100 AS `end`", "cast(p_size % 7 AS bigint) AS cn")
    regions = view(spark, d, "v_region")
    return calls.analysable(regions, coverage.highest_copy_number(regions, track)).select("region_id")


@query("""WITH v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' ELSE 'INV' END AS svtype, seq FROM v_dna), g AS (SELECT *, CASE WHEN length(seq) > 0 THEN (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / CAST(length(seq) AS DOUBLE) ELSE 0 END AS gc FROM v)
    SELECT doc_id, svtype FROM g WHERE svtype = 'INV' OR (gc > 0.1 AND gc <= 0.9)""")
def usual_composition(spark, d):
    rows = view(spark, d, "v_dna").selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' ELSE 'INV' END AS svtype", "seq")
    return calls.usual_composition(rows).select("doc_id", "svtype")


@query(f"WITH p AS ({PRIMITIVES}) SELECT signal_id, svtype, size FROM p WHERE svtype IN ('INS', 'DEL', 'INV') AND size >= 30")
def supported_variants(spark, d):
    return calls.supported(primitives(spark, d), 30).select("signal_id", "svtype", "size")


VARIANTS = "SELECT variant_id, svtype, size, variant_id % 5 AS chr, variant_id * 30 % 90000 AS s, variant_id * 30 % 90000 + size AS e, CASE WHEN gt = './.' THEN 'LowQual' ELSE 'PASS' END AS filter FROM v_genotype WHERE sample = 'child'"


def variants(spark, d):
    return view(spark, d, "v_genotype").where("sample = 'child'").selectExpr("variant_id", "svtype", "size", "variant_id % 5 AS chr", "variant_id * 30 % 90000 AS start", "variant_id * 30 % 90000 + size AS `end`", "CASE WHEN gt = './.' THEN 'LowQual' ELSE 'PASS' END AS filter")


@query(f"""WITH v AS ({VARIANTS}) SELECT variant_id FROM v WHERE filter = 'PASS' AND svtype IN ('INS', 'DEL') AND size >= 50
    AND EXISTS (SELECT 1 FROM v_region r WHERE r.chr = v.chr AND v.s < r.e AND r.s < CASE svtype WHEN 'DEL' THEN v.e ELSE v.s + 1 END)""")
def family_test_input(spark, d):
    return calls.consistent_input(variants(spark, d), ("INS", "DEL"), 50, view(spark, d, "v_region")).select("variant_id")


@query(f"WITH v AS ({VARIANTS}) SELECT variant_id, svtype FROM v WHERE EXISTS (SELECT 1 FROM v_region r WHERE r.chr = v.chr AND v.s < r.e AND r.s < CASE svtype WHEN 'DEL' THEN v.e ELSE v.s + 1 END)")
def variants_in_regions(spark, d):
    return calls.touching(variants(spark, d), view(spark, d, "v_region")).select("variant_id", "svtype")


@query("SELECT variant_id, g.sample FROM v_genotype g WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = g.size % 50 AND g.sample = CASE n.n_regionkey % 2 WHEN 0 THEN 'child' ELSE 'father' END)")
def genotypes_of_regions(spark, d):
    wanted = read(spark, d, "nation").selectExpr("CASE n_regionkey % 2 WHEN 0 THEN 'child' ELSE 'father' END AS sample", "cast(n_nationkey AS bigint) AS region_id")
    return calls.of_regions(view(spark, d, "v_genotype").withColumn("region_id", F.expr("size % 50")), wanted).select("variant_id", "sample")


@query("""SELECT l_partkey AS composite_id, CAST(round_even(sum(l_quantity * l_linenumber) / sum(l_linenumber), 0) AS BIGINT) AS size, string_agg(CAST(CAST(trunc(l_extendedprice / 7) AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(trunc(l_extendedprice / 7) AS BIGINT)) AS population FROM lineitem GROUP BY 1""")
def composite_sizes(spark, d):
    rows = read(spark, d, "lineitem").selectExpr("l_partkey AS composite_id", "l_quantity AS size", "l_linenumber AS support", "array(l_extendedprice / 7) AS distortions")
    return calls.sizes(rows).select("composite_id", "size", F.array_join(F.col("population").cast("array<string>"), ",").alias("population"))


@query(f"WITH p AS ({PRIMITIVES}) SELECT composite_id, count(DISTINCT read_id) AS n_reads, min(read_id) AS first_read FROM p GROUP BY 1")
def composite_reads(spark, d):
    return calls.supporting_reads(primitives(spark, d), "composite_id").select("composite_id", F.size("reads").cast("bigint").alias("n_reads"), F.col("reads")[0].alias("first_read"))


@query(f"WITH p AS ({PRIMITIVES}) SELECT chr, svtype, count(*) AS n FROM p GROUP BY 1, 2")
def type_counts(spark, d):
    return calls.type_counts(primitives(spark, d), "chr")


BEST = f"p AS ({PRIMITIVES}), best AS (SELECT composite_id, chr, s, e FROM p QUALIFY row_number() OVER (PARTITION BY composite_id ORDER BY support * size DESC, chr, s, e) = 1)"


@query(f'WITH {BEST}, f AS (SELECT composite_id, chr, s FROM p QUALIFY row_number() OVER (PARTITION BY composite_id ORDER BY chr, s, e) = 1) SELECT composite_id, b.chr, b.s AS start, b.e AS "end", f.chr AS first_chr, f.s AS first_start FROM best b JOIN f USING (composite_id)')
def representative_regions(spark, d):
    rows = primitives(spark, d)
    first = calls.representative(rows, leftmost=True).select("composite_id", F.col("chr").alias("first_chr"), F.col("start").alias("first_start"))
    return calls.representative(rows).join(first, "composite_id")


@query("""WITH r AS (SELECT l_partkey AS variant_id, list_distinct(list(l_orderkey) FILTER (WHERE l_returnflag = 'R')) AS alt, list_distinct(list(l_orderkey)) AS cov FROM lineitem GROUP BY 1)
    SELECT variant_id, CAST(coalesce(len(alt), 0) AS BIGINT) AS n_alt, CAST(len(list_filter(cov, lambda x: NOT coalesce(list_contains(alt, x), false))) AS BIGINT) AS n_ref, CAST(len(cov) AS BIGINT) AS n_total FROM r""")
def read_set_counts(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("variant_id")).agg(F.collect_set(F.expr("CASE WHEN l_returnflag = 'R' THEN l_orderkey END")).alias("alt_reads"), F.collect_set("l_orderkey").alias("covering_reads"))
    return calls.read_sets(rows).select("variant_id", *(F.col(c).cast("bigint") for c in ("n_alt", "n_ref", "n_total")))


@query()
def size_tolerances(spark, d):
    """Composites of one track each; a test holds the weighted means against plain ones."""
    tracks = statistics.complexity_track(view(spark, d, "v_dna").select("doc_id", "seq")).select(F.expr("doc_id % 40").alias("composite_id"), F.expr("aggregate(track, 0D, (s, x) -> s + x)").alias("total"), F.size("track").alias("length"))
    sums = tracks.groupBy("composite_id").agg(F.sum("total").alias("total"), F.sum("length").alias("length"))
    typed = sums.withColumn("svtype", F.expr("CASE composite_id % 3 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' ELSE 'BND' END"))
    return rounded(calls.summed_tolerance(typed), "size_tolerance").select("composite_id", "svtype", "size_tolerance")


ENDS = "SELECT l_orderkey AS composite_id, l_linenumber % 3 AS chr, l_partkey * 40 AS s, l_partkey * 40 + l_suppkey % 7 AS e FROM {0} WHERE l_linenumber <= 2"


def breakends(spark, d):
    return spark.sql(ENDS.format("{t}"), t=read(spark, d, "lineitem")).withColumnsRenamed({"s": "start", "e": "end"})


@query(f"""WITH t AS ({ENDS.format('lineitem')}), w AS (SELECT composite_id, list({{'chr': chr, 's': s, 'e': e}} ORDER BY chr, s, e) AS l, count(*) AS k FROM t GROUP BY 1),
    f AS (SELECT *, l[1].chr AS chr, l[1].s AS s, l[1].e AS e FROM w)
    SELECT a.composite_id AS a, b.composite_id AS b FROM f a JOIN f b ON a.k = b.k AND a.chr = b.chr AND a.s <= b.e + 150 AND b.s <= a.e + 150 AND a.composite_id < b.composite_id
    WHERE len(list_filter(range(1, a.k + 1), lambda i: a.l[i].chr = b.l[i].chr AND a.l[i].e + 150 >= b.l[i].s AND b.l[i].e + 150 >= a.l[i].s)) = a.k""")
def near_adjacencies(spark, d):
    return calls.adjacency_pairs(breakends(spark, d))


@query()
def merged_adjacencies(spark, d):
    """Components of the pairs above; a test holds them against union-find."""
    return calls.merged_adjacencies(breakends(spark, d), near=10)


@query()
def breakend_pairs(spark, d):
    """Breakends near each other in alike contexts; a test holds them against plain loops."""
    ends = view(spark, d, "v_signal").where("sv_type >= 3").selectExpr("signal_id AS composite_id", "chr", "start", "`end`")
    # Contexts: the documents' bases, dealt out by number.
    contexts = view(spark, d, "v_dna").selectExpr("doc_id % 12 AS k", "left(seq, 60) AS seq").groupBy("k").agg(F.min("seq").alias("seq"))
    return calls.breakend_pairs(ends, ends.withColumn("k", F.expr("composite_id % 12")).join(F.broadcast(contexts), "k").select("composite_id", "seq"))


@query("SELECT user_id AS consensus_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 500, event_id) - 1 AS BIGINT) AS alignment FROM events")
def alignment_numbers(spark, d):
    rows = read(spark, d, "events").selectExpr("user_id AS consensus_id", "event_id", "event_id % 500 AS read_start", "event_id AS read_end")
    return calls.alignment_numbers(rows).select("consensus_id", "event_id", F.col("alignment").cast("bigint"))


@query(f"""WITH {BEST}, c AS (SELECT composite_id, CASE composite_id % 4 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' WHEN 2 THEN 'INV' ELSE 'BND' END AS svtype, CAST(sum(size) AS BIGINT) - 300 AS size, composite_id % 3 AS n_repeats FROM p GROUP BY 1),
    g AS (SELECT composite_id, max(n) AS n FROM (SELECT composite_id, read_id % 2 AS sample, count(DISTINCT read_id) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
    SELECT composite_id, svtype, b.chr, b.s AS start, CASE svtype WHEN 'DEL' THEN b.s + abs(size) WHEN 'INS' THEN b.s + 1 ELSE b.e END AS "end", abs(size) AS svlen, CASE WHEN g.n >= 6 THEN 'PASS' ELSE 'LowQual' END AS filter, n_repeats = 0 AS precise
    FROM c JOIN best b USING (composite_id) JOIN g USING (composite_id) WHERE svtype <> 'BND'""")
def assembled_calls(spark, d):
    rows = primitives(spark, d)
    composites = rows.groupBy("composite_id").agg((F.sum("size") - 300).alias("size"), F.array_sort(F.collect_set("read_id")).alias("consensus_ids")).selectExpr("*", "CASE composite_id % 4 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' WHEN 2 THEN 'INV' ELSE 'BND' END AS svtype", "composite_id % 3 AS n_repeats")
    genotypes = rows.groupBy("composite_id", F.expr("read_id % 2").alias("sample")).agg(F.count_distinct("read_id").alias("n_alt"))
    return calls.assembled(composites, genotypes, calls.representative(rows), 6).drop("consensus_ids")


@query()
def container_consensuses(spark, d):
    """The steps of a container on regions of bounded depth; a test looks at the members."""
    found = candidates.numbered(candidates.regions(view(spark, d, "v_signal"), pad=20)).select("region_id", F.col("chr"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    from lociq.operators.intervals import range_join

    inside = range_join(view(spark, d, "v_signal"), found, points=True).select(F.col("region_id").alias("container_id"), "read_id", "sv_type", "size")
    reads = statistics.summed_indels(inside, ("container_id", "read_id")).withColumn("seq", F.expr("repeat('ACGT', cast(1 + read_id % 5 AS int))"))
    copies = found.selectExpr("region_id AS container_id", "1 + region_id % 6 AS cn")
    return calls.in_containers(reads, copies).select("container_id", "cluster", F.length("sequence").alias("bases"), F.size("members").alias("n"))


@query("SELECT chr, 0 AS start, max(e) AS \"end\", 30 AS depth FROM v_repeat GROUP BY chr")
def uniform_cover(spark, d):
    return calls.uniform_cover(view(spark, d, "v_repeat").groupBy("chr").agg(F.max("end").alias("length")))


@query("""SELECT DISTINCT g.signal_id FROM v_signal g WHERE g.read_id IN (3, 5, 8) OR EXISTS (SELECT 1 FROM v_region r WHERE r.region_id % 4 = 0 AND r.chr = g.chr AND g.s < r.e AND r.s < g.e)""")
def log_hits(spark, d):
    lines = view(spark, d, "v_signal").select(F.col("signal_id").alias("line"), F.array("read_id").alias("region_ids"), "chr", "start", "end")
    return calls.log_hits(lines, [3, 5, 8], view(spark, d, "v_region").where("region_id % 4 = 0")).select(F.col("line").alias("signal_id"))


# --- seeds, depths and scores ---------------------------------------------------------


@query("""WITH m AS (SELECT *, CASE WHEN sv_type >= 3 THEN 300 WHEN sv_type = 1 THEN greatest(50, CAST(floor((e - s) * 0.1::DOUBLE) AS BIGINT)) ELSE 50 END AS margin FROM v_signal) SELECT signal_id, greatest(s - margin, 0) AS start, e + margin AS "end" FROM m""")
def seed_margins(spark, d):
    return candidates.seed_margins(view(spark, d, "v_signal")).select("signal_id", F.col("start").cast("bigint"), F.col("end").cast("bigint"))


@query(f"WITH {SWEPT.format('v_raf', 'every')} SELECT chr, CAST(max(depth) AS BIGINT) AS max_depth FROM every GROUP BY chr")
def max_depths(spark, d):
    return coverage.max_depth(view(spark, d, "v_raf"))


@query("""WITH marked AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 4000 THEN 1 ELSE 0 END AS fresh FROM v_region),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked) SELECT chr, min(s) AS start, max(e) AS "end", count(*) AS members FROM numbered GROUP BY chr, g""")
def close_regions(spark, d):
    return coverage.close_regions(view(spark, d, "v_region"), 4000)


SCORED = {
    "alike": ("CASE WHEN abs(x - y) > 0.10::DOUBLE * least(x, y) THEN 0.0 WHEN abs(x - y) < 0.01::DOUBLE * least(x, y) THEN 1.0 ELSE 0.01::DOUBLE * least(x, y) / (100 * abs(x - y)) END", lambda x, y: scores.size_similarity(x, y)),
    "near": ("30.0::DOUBLE / (x + 30)", lambda x, y: scores.distance_score(x)),
    "damped": ("1 - exp(-pow(x / 30.0::DOUBLE, 1.5))", lambda x, y: scores.size_damping(x)),
    "falling": ("exp(-x / 5000.0::DOUBLE)", lambda x, y: scores.exponential_weight(x)),
    "bell": ("exp(-x * x / (2 * 40.0::DOUBLE * 40))", lambda x, y: scores.gaussian_weight(x, 40.0)),
    "inverse": ("1 / pow(1 + x / 20.0::DOUBLE, 2)", lambda x, y: scores.inverse_power_weight(x, 20.0, 2.0)),
    "logistic": ("1 / (1 + exp((x - 50) / 8.0::DOUBLE))", lambda x, y: scores.logistic_weight(x, 50.0, 8.0)),
    "between": ("x + (y - x) * 0.25::DOUBLE", lambda x, y: scores.lerp(x, y, F.lit(0.25))),
}


@query("WITH t AS (SELECT signal_id, CAST(size AS DOUBLE) AS x, CAST(1 + signal_id % 90 AS DOUBLE) AS y FROM v_signal) SELECT signal_id, " + ", ".join(f"round({body}, 6) AS {name}" for name, (body, _) in SCORED.items()) + " FROM t")
def score_functions(spark, d):
    x, y = F.col("size").cast("double"), F.expr("cast(1 + signal_id % 90 AS double)")
    return view(spark, d, "v_signal").select("signal_id", *(F.round(f(x, y), 6).alias(name) for name, (_, f) in SCORED.items()))


# --- sequences of signals by sample ---------------------------------------------------

WORDED = "SELECT signal_id, signal_id % 3 AS sample, chr, s, e, sv_type, size, translate(md5(CAST(signal_id AS {text})), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM {rows}"


@query(f"""WITH t AS ({WORDED.format(text='VARCHAR', rows='v_signal')}), a AS (SELECT *, EXISTS (SELECT 1 FROM v_repeat r WHERE r.chr = t.chr AND t.s < r.e AND r.s < CASE WHEN sv_type = 1 THEN greatest(t.e, t.s + 1) ELSE t.s + 1 END) AS held,
        CASE WHEN sv_type < 2 THEN round_even(100.0 * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq), 0) END AS gc FROM t)
    SELECT CAST(sample AS INTEGER) AS sample, CAST(sv_type AS INTEGER) AS sv_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS bases, count(*) FILTER (WHERE held) AS in_repeats, round(coalesce(avg(gc), -1), 6) AS gc_percent FROM a GROUP BY ALL""")
def sample_signal_statistics(spark, d):
    rows = spark.sql(WORDED.format(text="STRING", rows="{t}"), t=view(spark, d, "v_signal").withColumnsRenamed({"start": "s", "end": "e"})).withColumnsRenamed({"s": "start", "e": "end"})
    out = statistics.sample_statistics(statistics.annotated_signals(rows, view(spark, d, "v_repeat")))
    return out.select(F.col("sample").cast("int"), F.col("sv_type").cast("int"), "n", "bases", "in_repeats", F.round(F.coalesce("gc_percent", F.lit(-1.0)), 6).alias("gc_percent"))
