"""Every query on the interval operators, with the SQL that states the same result.

Queries whose result depends on a sequential kernel (crowded windows, packing, Viterbi,
clustering) have no SQL; tests hold them against plain implementations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociq.functions import dna, scores
from lociq.operators import candidates, clustering, coverage, genotypes, graph, intervals, patterns, signals
from lociq.plans.views import rounded, sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(body: str | None = None):
    """Registers a function under its name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if body:
            ORACLES[f.__name__] = sql(body)
        return f

    return register


# --- joins of intervals -------------------------------------------------------------


@query("""SELECT g.signal_id, count(r.s) AS depth FROM v_signal g LEFT JOIN v_raf r
    ON g.chr = r.chr AND g.s < r.e AND r.s < greatest(g.e, g.s + 1) GROUP BY g.signal_id""")
def raf_interval_depth(spark, d):
    return coverage.depths(view(spark, d, "v_signal"), view(spark, d, "v_raf"))


@query("""SELECT g.signal_id, g.sv_type, coalesce(r.repeat_id, -1) AS repeat_id FROM v_signal g LEFT JOIN v_repeat r
    ON g.chr = r.chr AND g.s < r.e + 50 AND greatest(r.s - 50, 0) < greatest(g.e, g.s + 1)""")
def signal_repeat_left_join(spark, d):
    return candidates.with_repeats(view(spark, d, "v_signal"), view(spark, d, "v_repeat")).select("signal_id", "sv_type", "repeat_id")


RECIPROCAL = "g.chr = r.chr AND g.e > g.s AND least(g.e, r.e) - greatest(g.s, r.s) >= 0.5 * (g.e - g.s) AND least(g.e, r.e) - greatest(g.s, r.s) >= 0.5 * (r.e - r.s) AND g.s < r.e AND r.s < g.e"


@query(f"SELECT signal_id, chr, s AS start, size FROM v_signal g WHERE NOT EXISTS (SELECT 1 FROM v_repeat r WHERE {RECIPROCAL})")
def signal_repeat_anti_reciprocal(spark, d):
    return candidates.outside_runs(view(spark, d, "v_signal"), view(spark, d, "v_repeat")).select("signal_id", "chr", "start", "size")


@query("""SELECT signal_id, size FROM v_signal g WHERE g.e > g.s AND EXISTS (SELECT 1 FROM v_repeat r
    WHERE g.chr = r.chr AND g.s < r.e AND r.s < g.e AND least(g.e, r.e) - greatest(g.s, r.s) >= 0.5 * (g.e - g.s))""")
def signal_repeat_semi_frac(spark, d):
    return candidates.inside_runs(view(spark, d, "v_signal"), view(spark, d, "v_repeat")).select("signal_id", "size")


@query("""SELECT c.region_id AS core_id, count(DISTINCT r.repeat_id) AS n_repeats, string_agg(DISTINCT CAST(r.repeat_id AS VARCHAR), ',' ORDER BY CAST(r.repeat_id AS VARCHAR)) AS repeats
    FROM v_region c JOIN v_repeat r ON c.chr = r.chr AND c.s < r.e AND r.s < c.e GROUP BY c.region_id""")
def core_repeat_inner(spark, d):
    found = candidates.repeats_of(view(spark, d, "v_region").withColumnRenamed("region_id", "core_id"), view(spark, d, "v_repeat"))
    return found.select("core_id", F.size("repeat_ids").cast("bigint").alias("n_repeats"), F.array_join(F.sort_array(F.col("repeat_ids").cast("array<string>")), ",").alias("repeats"))


@query("SELECT g.signal_id AS point_id, count(r.s) AS coverage FROM v_signal g LEFT JOIN v_raf r ON g.chr = r.chr AND r.s <= g.s AND g.s < r.e WHERE g.sv_type = 0 GROUP BY 1")
def stab_coverage(spark, d):
    points = view(spark, d, "v_signal").where("sv_type = 0").select(F.col("signal_id").alias("point_id"), "chr", F.col("start").alias("at"))
    return coverage.at_points(points, view(spark, d, "v_raf"))


@query("SELECT g.region_id, count(DISTINCT r.read_id) AS reads FROM v_region g JOIN v_raf r ON g.chr = r.chr AND g.s < r.e AND r.s < g.e GROUP BY 1")
def region_distinct_reads(spark, d):
    return coverage.reads_over(view(spark, d, "v_region"), view(spark, d, "v_raf"))


@query("""SELECT c.region_id, r.repeat_id, greatest(c.s, r.s) - c.s AS start, least(c.e, r.e) - c.s AS "end"
    FROM v_region c JOIN v_repeat r ON c.chr = r.chr AND c.s < r.e AND r.s < c.e""")
def lift_to_regions(spark, d):
    regions = view(spark, d, "v_region").withColumnsRenamed({"start": "r_start", "end": "r_end"})
    return intervals.lift(view(spark, d, "v_repeat"), regions).select("region_id", "repeat_id", "start", "end")


@query("""SELECT read_id, chr, s AS start, e AS "end", s2, e2 FROM (
    SELECT a.read_id, a.chr, a.s, a.e, b.s AS s2, b.e AS e2 FROM v_raf a JOIN v_raf b ON a.read_id = b.read_id AND a.chr = b.chr
    WHERE a.n_del > b.n_del AND a.n_del - b.n_del <= 1000 AND a.forward <> b.forward AND least(a.e - a.s, b.e - b.s) >= 100
      AND (least(a.e, b.e) - greatest(a.s, b.s)) / CAST(least(a.e - a.s, b.e - b.s) AS DOUBLE) >= 0.3)""")
def opposite_strand_pairs(spark, d):
    return signals.unseparated(view(spark, d, "v_raf").withColumn("ord", F.col("n_del")), least_length=100)


EXPECTED = "SELECT s_suppkey AS expected_id, s_suppkey % 5 AS chr, s_suppkey * 900 AS s, s_suppkey * 900 + 400 AS e, CASE s_suppkey % 2 WHEN 0 THEN 'INS' ELSE 'DEL' END AS svtype, 20 + s_nationkey AS size, CASE s_suppkey % 3 WHEN 0 THEN 'HOM' ELSE 'HET' END AS gt FROM supplier"
CALLED = "SELECT signal_id AS call_id, chr, s, greatest(e, s + 1) AS e, CASE sv_type WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' ELSE 'BND' END AS c_type, size AS c_size, CASE signal_id % 3 WHEN 0 THEN 'HOM' ELSE 'HET' END AS c_gt FROM v_signal"
MATCHED = f"""WITH expected AS ({EXPECTED}), called AS ({CALLED}),
    hits AS (SELECT expected_id, call_id, (CASE WHEN svtype = c_type THEN 1 ELSE 0 END) + (CASE WHEN abs(c_size - size) <= 0.2 * size THEN 1 ELSE 0 END) + (CASE WHEN gt = c_gt THEN 1 ELSE 0 END) AS score
        FROM expected x JOIN called c ON x.chr = c.chr AND x.s < c.e AND c.s < x.e),
    best AS (SELECT * FROM hits WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY expected_id ORDER BY score DESC, call_id) = 1),
    matched AS (SELECT x.expected_id, b.call_id, coalesce(b.score, 0) AS score, CASE WHEN b.score IS NULL THEN 'MISSING' WHEN b.score = 3 THEN 'FULL' ELSE 'PARTIAL' END AS verdict FROM expected x LEFT JOIN best b USING (expected_id))"""


@query(MATCHED + " SELECT * FROM matched")
def best_match(spark, d):
    supplier = spark.read.parquet(f"{d}/supplier.parquet")
    expected = supplier.selectExpr("s_suppkey AS expected_id", "s_suppkey % 5 AS chr", "s_suppkey * 900 AS start", "s_suppkey * 900 + 400 AS `end`", "CASE s_suppkey % 2 WHEN 0 THEN 'INS' ELSE 'DEL' END AS svtype", "20 + s_nationkey AS size", "CASE s_suppkey % 3 WHEN 0 THEN 'HOM' ELSE 'HET' END AS gt")
    called = view(spark, d, "v_signal").selectExpr("signal_id AS call_id", "chr", "start AS r_start", "greatest(`end`, start + 1) AS r_end", "CASE sv_type WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' ELSE 'BND' END AS c_type", "size AS c_size", "CASE signal_id % 3 WHEN 0 THEN 'HOM' ELSE 'HET' END AS c_gt")
    return genotypes.best_matches(expected, called).select("expected_id", "call_id", "score", "verdict")


@query(MATCHED + " SELECT verdict, count(*) AS n, CAST(sum(score) AS BIGINT) AS total_score FROM matched GROUP BY verdict")
def accuracy_summary(spark, d):
    return best_match(spark, d).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("score").cast("bigint").alias("total_score"))


# --- merges, sweeps and windows ------------------------------------------------------

ISLANDS = """WITH padded AS (SELECT chr, greatest(s - {pad}, 0) AS s, greatest(e, s) + {pad} AS e, signal_id, read_id FROM v_signal),
    marked AS (SELECT *, CASE WHEN s {op} max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM padded),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    islands AS (SELECT chr, min(s) AS start, max(e) AS "end", count(*) AS n_signals, count(DISTINCT read_id) AS n_reads FROM numbered GROUP BY chr, island)"""


@query(ISLANDS.format(pad=50, op=">") + ' SELECT chr, start, "end", n_signals AS members FROM islands')
def merge_islands(spark, d):
    padded = view(spark, d, "v_signal").select("chr", F.greatest(F.col("start") - 50, F.lit(0)).alias("start"), (F.col("end") + 50).alias("end"))
    return intervals.merge(padded)


@query(ISLANDS.format(pad=5, op=">=") + ' SELECT chr, start, "end", n_signals AS members FROM islands')
def merge_islands_strict(spark, d):
    padded = view(spark, d, "v_signal").select("chr", F.greatest(F.col("start") - 5, F.lit(0)).alias("start"), (F.col("end") + 5).alias("end"))
    return intervals.merge(padded, touching=False)


@query("""WITH marked AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM v_repeat),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    merged AS (SELECT chr, min(s) AS s, max(e) AS e FROM numbered GROUP BY chr, island),
    ends AS (SELECT chr, s, e FROM merged UNION ALL SELECT chr, 0, 0 FROM v_repeat GROUP BY chr UNION ALL SELECT chr, max(e) + 1000, max(e) + 1000 FROM v_repeat GROUP BY chr),
    gaps AS (SELECT chr, e AS start, lead(s) OVER (PARTITION BY chr ORDER BY s, e) AS stop FROM ends)
    SELECT chr, start, stop AS "end" FROM gaps WHERE start < stop""")
def subtract_gaps(spark, d):
    repeats = view(spark, d, "v_repeat")
    return intervals.subtract(repeats.groupBy("chr").agg((F.max("end") + 1000).alias("length")), repeats)


@query("""WITH steps AS (SELECT chr, p, sum(c) AS c FROM (SELECT chr, s AS p, 1 AS c FROM v_raf UNION ALL SELECT chr, e, -1 FROM v_raf) GROUP BY chr, p),
    deep AS (SELECT chr, p AS start, lead(p) OVER w AS "end", CAST(sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM steps WINDOW w AS (PARTITION BY chr ORDER BY p))
    SELECT * FROM deep WHERE "end" IS NOT NULL AND depth > 0""")
def sweep_depth(spark, d):
    return intervals.sweep(view(spark, d, "v_raf"))


ELEMENTARY = """WITH cuts AS (SELECT chr, s AS p FROM v_raf UNION SELECT chr, e FROM v_raf),
    pieces AS (SELECT chr, p AS s, lead(p) OVER (PARTITION BY chr ORDER BY p) AS e FROM cuts),
    covered AS (SELECT p.chr, p.s, p.e, count(DISTINCT r.read_id) AS coverage FROM pieces p JOIN v_raf r ON p.chr = r.chr AND p.s < r.e AND r.s < p.e WHERE p.e IS NOT NULL GROUP BY ALL)"""


@query(ELEMENTARY + ' SELECT chr, s AS start, e AS "end", coverage FROM covered')
def elementary_coverage_distinct(spark, d):
    return coverage.elementary(view(spark, d, "v_raf"))


@query(ELEMENTARY + " SELECT CAST(floor(quantile_cont(coverage, 0.5)) AS BIGINT) AS median_coverage FROM covered")
def median_coverage(spark, d):
    return coverage.median_depth(coverage.elementary(view(spark, d, "v_raf")))


REBINNED = ELEMENTARY + """, bins AS (SELECT region_id, chr, s + 200 * k AS s, least(s + 200 * (k + 1), e) AS e FROM v_region, range(0, 10) AS t(k) WHERE s + 200 * k < e),
    binned AS (SELECT b.region_id, b.chr, b.s, b.e, coalesce(CAST(floor(quantile_cont(c.coverage, 0.5)) AS BIGINT), 0) AS coverage
        FROM bins b LEFT JOIN covered c ON b.chr = c.chr AND b.s < c.e AND c.s < b.e GROUP BY ALL)"""


@query(REBINNED.replace("GROUP BY ALL)", "GROUP BY b.region_id, b.chr, b.s, b.e)", 2).replace("pieces p JOIN v_raf r ON p.chr = r.chr AND p.s < r.e AND r.s < p.e WHERE p.e IS NOT NULL GROUP BY b.region_id, b.chr, b.s, b.e)", "pieces p JOIN v_raf r ON p.chr = r.chr AND p.s < r.e AND r.s < p.e WHERE p.e IS NOT NULL GROUP BY p.chr, p.s, p.e)") + ' SELECT region_id, chr, s AS start, e AS "end", coverage FROM binned')
def rebin_median(spark, d):
    return coverage.rebinned(coverage.elementary(view(spark, d, "v_raf")), view(spark, d, "v_region"), 200)


@query()
def copy_number_viterbi(spark, d):
    bins = graph.cut(coverage.rebinned(coverage.elementary(view(spark, d, "v_raf")), view(spark, d, "v_region"), 200))
    median = bins.agg(F.expr("coalesce(percentile(coverage, 0.5), 1.0)").alias("m")).first().m  # one number
    return coverage.copy_numbers(bins, max(float(int(median)), 1.0))


TRACK = "SELECT p_partkey % 5 AS chr, p_partkey * 50 AS s, p_partkey * 50 + 100 AS e, p_size % 5 AS cn FROM part"


@query(f"""WITH track AS ({TRACK}), votes AS (SELECT g.region_id, t.cn, count(*) AS n FROM v_region g JOIN track t ON g.chr = t.chr AND g.s < t.e AND t.s < g.e GROUP BY ALL),
    best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY n DESC, abs(cn - 2), cn) = 1)
    SELECT g.region_id, CAST(coalesce(b.cn, 2) AS BIGINT) AS usual, (SELECT CAST(coalesce(nullif(max(v.cn), 0), 2) AS BIGINT) FROM votes v WHERE v.region_id = g.region_id) AS highest
    FROM v_region g LEFT JOIN best b USING (region_id)""")
def cn_lookup_mode(spark, d):
    track = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey % 5 AS chr", "p_partkey * 50 AS start", "p_partkey * 50 + 100 AS `end`", "cast(p_size % 5 AS bigint) AS cn")
    regions = view(spark, d, "v_region")
    usual = coverage.usual_copy_number(regions, track).withColumnRenamed("cn", "usual")
    return usual.join(coverage.highest_copy_number(regions, track).withColumnRenamed("cn", "highest"), "region_id").select("region_id", F.col("usual").cast("bigint"), F.col("highest").cast("bigint"))


@query("SELECT sv_type, size, count(*) AS n FROM v_signal WHERE sv_type <= 1 GROUP BY ALL")
def indel_histogram(spark, d):
    return signals.indel_histogram(view(spark, d, "v_signal"))


@query("""WITH h AS (SELECT sv_type, size, count(*) AS n FROM v_signal WHERE sv_type <= 1 GROUP BY ALL), b AS (SELECT sum(e - s) AS bases FROM v_raf),
    c AS (SELECT sv_type, greatest(min(size), 6) AS cutoff FROM h, b WHERE n / (bases / 1e6) <= 5.0 GROUP BY sv_type),
    two AS (SELECT coalesce(max(cutoff) FILTER (WHERE sv_type = 0), 999999) AS min_ins, coalesce(max(cutoff) FILTER (WHERE sv_type = 1), 999999) AS min_del FROM c)
    SELECT signal_id, sv_type, size FROM v_signal, two WHERE CASE sv_type WHEN 1 THEN size >= min_del WHEN 0 THEN size >= least(min_ins, min_del) ELSE true END""")
def size_cutoff_filter(spark, d):
    rows = view(spark, d, "v_signal")
    bases = view(spark, d, "v_raf").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    return signals.by_size(rows, signals.size_cutoffs(signals.indel_histogram(rows), bases, 5.0)).select("signal_id", "sv_type", "size")


@query("""SELECT a.signal_id, CAST(sum(b.size) AS BIGINT) AS density FROM v_signal a JOIN v_signal b ON a.chr = b.chr AND a.read_id = b.read_id AND a.sv_type = b.sv_type
    AND b.s - a.e <= 500 AND a.s - b.e <= 500 GROUP BY 1 HAVING sum(b.size) >= 30""")
def density_window(spark, d):
    return signals.density(view(spark, d, "v_signal")).where("density >= 30")


NEAR = """WITH framed AS (SELECT *, list({'s': s, 'e': e, 't': read_id, 'n': n_del}) OVER (PARTITION BY chr ORDER BY s, e, read_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS near FROM v_raf),
    sorted AS (SELECT *, list_sort(list_transform(list_filter(near, lambda o: o.s < e AND o.e > s AND NOT (o.s = s AND o.e = e AND o.t = read_id)), lambda o: CAST(o.n AS DOUBLE))) AS v FROM framed),
    placed AS (SELECT *, (len(v) - 1) * 0.9::DOUBLE AS p FROM sorted),
    levels AS (SELECT *, CASE WHEN len(v) >= 3 THEN v[CAST(floor(p) AS INT) + 1] + (v[CAST(ceil(p) AS INT) + 1] - v[CAST(floor(p) AS INT) + 1]) * (p - floor(p)) END AS level FROM placed)"""


@query(NEAR + ' SELECT chr, s AS start, e AS "end", read_id, n_del FROM levels WHERE level IS NULL OR n_del <= 1.5 * level')
def neighbour_percentile_filter(spark, d):
    return signals.quiet(view(spark, d, "v_raf"), factor=1.5).select("chr", "start", "end", "read_id", "n_del")


@query("""SELECT a.chr, a.s AS start, a.e AS "end", a.read_id, count(*) AS depth FROM v_raf a JOIN v_raf b ON a.chr = b.chr AND b.s <= a.s AND b.e > a.s
    WHERE b.s < a.s OR (b.e, b.read_id) <= (a.e, a.read_id) GROUP BY ALL""")
def admission_depth(spark, d):
    return coverage.running_depth(view(spark, d, "v_raf"))


@query("SELECT chr, max(e) AS \"end\", min(s) AS start, count(*) AS n FROM v_repeat GROUP BY chr")
def extents_by_contig(spark, d):
    return view(spark, d, "v_repeat").groupBy("chr").agg(F.max("end").alias("end"), F.min("start").alias("start"), F.count("*").alias("n"))


@query("""SELECT region_id, chr, s + 150 * k AS start, least(s + 150 * (k + 1), e) AS "end" FROM v_region, range(0, 20) AS t(k) WHERE s + 150 * k < e""")
def region_tiles(spark, d):
    return intervals.tiles(view(spark, d, "v_region"), 150).select("region_id", "chr", "start", "end")


@query("""WITH lengths AS (SELECT chr, max(e) AS length FROM v_repeat GROUP BY chr) SELECT repeat_id, chr, greatest(s - 700, 0) AS start, least(e + 700, length) AS "end" FROM v_repeat JOIN lengths USING (chr)""")
def slop_clipped(spark, d):
    repeats = view(spark, d, "v_repeat")
    return intervals.slop(repeats, 700, repeats.groupBy("chr").agg(F.max("end").alias("length"))).select("repeat_id", "chr", "start", "end")


# --- strength and candidate regions --------------------------------------------------


def strength_input(spark, d):
    """Signals of even ids with the least repeat that each touches."""
    rows = view(spark, d, "v_signal")
    repeats = candidates.with_repeats(rows, view(spark, d, "v_repeat"))
    return repeats.groupBy("signal_id", "chr", "start", "end", "read_id", "sv_type", "size").agg(F.max("repeat_id").alias("repeat_id"))


@query("""WITH noted AS (SELECT g.signal_id, g.chr, g.s, g.e, g.read_id, g.sv_type, g.size, max(coalesce(r.repeat_id, -1)) AS rep FROM v_signal g LEFT JOIN v_repeat r
        ON g.chr = r.chr AND g.s < r.e + 50 AND greatest(r.s - 50, 0) < greatest(g.e, g.s + 1) GROUP BY ALL),
    pairs AS (SELECT a.signal_id, a.sv_type, a.size AS x, b.size AS y, a.rep >= 0 AND a.rep = b.rep AS shared, greatest(greatest(a.s, b.s) - CASE WHEN a.s <= b.s THEN a.e ELSE b.e END, 0) AS gap
        FROM noted a JOIN noted b ON a.chr = b.chr AND a.sv_type = b.sv_type AND a.read_id <> b.read_id AND b.s <= a.e + 11000 AND a.s <= b.e + 11000),
    near AS (SELECT *, CASE WHEN shared THEN floor(gap / 10) ELSE gap END AS d FROM pairs),
    alike AS (SELECT *, CASE WHEN sv_type >= 3 THEN 0.0 WHEN abs(x - y) > 0.10::DOUBLE * least(x, y) THEN 0.0 WHEN abs(x - y) < 0.01::DOUBLE * least(x, y) THEN 1.0 ELSE 0.01::DOUBLE * least(x, y) / (100 * abs(x - y)) END AS a FROM near WHERE d <= 1000),
    scored AS (SELECT signal_id, CASE WHEN sv_type >= 3 AND d > CASE WHEN shared THEN 500 ELSE 100 END THEN 0.0 WHEN d <= 0 THEN 1.0 ELSE greatest(30.0::DOUBLE / (d + 30), a) END AS v FROM alike)
    SELECT g.signal_id, round(coalesce(sum(v), 0.0), 6) AS strength FROM v_signal g LEFT JOIN scored USING (signal_id) GROUP BY 1""")
def band_join_strength(spark, d):
    return rounded(candidates.band_strength(strength_input(spark, d)), "strength")


@query()
def signal_strength(spark, d):
    return rounded(candidates.windowed_strength(strength_input(spark, d)), "strength")


@query("""WITH deep AS (SELECT g.signal_id, g.size, count(r.s) AS coverage FROM v_signal g LEFT JOIN v_raf r ON g.chr = r.chr AND g.s < r.e AND r.s < greatest(g.e, g.s + 1) GROUP BY ALL)
    SELECT signal_id, size / 10.0 AS strength, coverage FROM deep WHERE size / 10.0 > 1.0 AND CASE WHEN coverage > 0 THEN size / 10.0 / coverage ELSE 0.0 END > 0.06""")
def strength_filter(spark, d):
    rows = view(spark, d, "v_signal")
    deep = rows.join(coverage.depths(rows, view(spark, d, "v_raf")), "signal_id").withColumnRenamed("depth", "coverage")
    return candidates.strong(deep.withColumn("strength", F.col("size") / F.lit(10.0))).select("signal_id", "strength", "coverage")


@query(ISLANDS.format(pad=50, op=">") + """, kept AS (SELECT * FROM islands WHERE n_reads <= 6 * (SELECT quantile_cont(n_reads, 0.5) FROM islands)),
    wide AS (SELECT *, greatest(500 - ("end" - start), 0) AS lack FROM kept)
    SELECT row_number() OVER (ORDER BY chr, start) - 1 AS region_id, chr, greatest(start - CAST(floor(lack / 2) AS BIGINT), 0) AS start, "end" + lack - CAST(floor(lack / 2) AS BIGINT) AS "end", n_signals, n_reads FROM wide""")
def candidate_regions(spark, d):
    found = candidates.not_crowded(candidates.regions(view(spark, d, "v_signal")))
    out = candidates.at_least(candidates.numbered(found))
    return out.select(F.col("region_id").cast("bigint"), "chr", "start", "end", "n_signals", "n_reads")


@query(ISLANDS.format(pad=50, op=">") + ' SELECT chr, start, "end", n_reads FROM islands WHERE n_reads <= 1.5 * (SELECT quantile_cont(n_reads, 0.5) FROM islands)')
def cr_read_median_filter(spark, d):
    return candidates.not_crowded(candidates.regions(view(spark, d, "v_signal")), 1.5).select("chr", "start", "end", "n_reads")


@query(ISLANDS.format(pad=50, op=">") + ' SELECT chr, start, "end", "end" - start AS span FROM islands ORDER BY span DESC, chr, start LIMIT 20')
def top20_regions(spark, d):
    found = candidates.regions(view(spark, d, "v_signal")).withColumn("span", F.col("end") - F.col("start"))
    return found.orderBy(F.desc("span"), "chr", "start").limit(20).select("chr", "start", "end", "span")


@query(ISLANDS.format(pad=50, op=">") + """, d AS (SELECT list(n_reads ORDER BY n_reads) AS v, count(*) AS n FROM islands)
    SELECT k * 10 AS percent, v[CAST(round_even(k / 10.0 * (n - 1), 0) AS INT) + 1] AS n_reads FROM d, range(0, 11) AS t(k)""")
def nearest_rank_deciles(spark, d):
    """Nearest-rank deciles by row numbers, not by gathering the values."""
    found = candidates.regions(view(spark, d, "v_signal")).select("n_reads")
    counts = found.groupBy("n_reads").agg(F.count("*").alias("m"))  # as many rows as values differ
    below = F.sum("m").over(W.orderBy("n_reads").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.select("n_reads", (below - F.col("m")).alias("low"), below.alias("high"))
    ranks = found.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k")).select((F.col("k") * 10).cast("bigint").alias("percent"), F.expr("rint(k / 10D * (n - 1))").cast("bigint").alias("rank"))
    return ranks.join(F.broadcast(ranked), (F.col("low") <= F.col("rank")) & (F.col("rank") < F.col("high"))).select("percent", "n_reads")


MEMBERS = """WITH members AS (SELECT user_id AS read_id, event_id % 40 AS region_id FROM events WHERE event_type IN ('error', 'signup')),
    single AS (SELECT region_id, read_id FROM members GROUP BY ALL HAVING count(*) = 1),
    edges AS (SELECT x.region_id AS a, y.region_id AS b, count(*) AS n FROM single x JOIN single y ON x.read_id = y.read_id AND x.region_id < y.region_id GROUP BY ALL HAVING count(*) >= 3)"""


def break_members(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where("event_type IN ('error', 'signup')").selectExpr("user_id AS read_id", "event_id % 40 AS region_id")


@query(MEMBERS + " SELECT * FROM edges")
def cr_edges(spark, d):
    return candidates.region_edges(break_members(spark, d)).select("a", "b", "n")


LINKED = """edges AS (SELECT l_suppkey AS a, l_partkey % 97 + 100000 AS b FROM lineitem WHERE l_partkey % 11 = l_suppkey % 11 GROUP BY ALL),
    twoway AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(node, other) AS (SELECT a, a FROM twoway UNION SELECT r.node, b.b FROM reach r JOIN twoway b ON r.other = b.a)"""


@query(f"WITH RECURSIVE {LINKED} SELECT node, min(other) AS component FROM reach GROUP BY node")
def cr_components(spark, d):
    edges = spark.read.parquet(f"{d}/lineitem.parquet").where("l_partkey % 11 = l_suppkey % 11").selectExpr("l_suppkey AS a", "l_partkey % 97 + 100000 AS b")
    return graph.components(edges)


@query()
def cr_components_whole(spark, d):
    """All rows; the recursive SQL is too slow for them, so a test holds it against union-find."""
    edges = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey AS a", "l_partkey + 1000000000 AS b")
    return graph.components(edges)


PACKED = ISLANDS.format(pad=50, op=">").replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT *, row_number() OVER (ORDER BY chr, start) - 1 AS id FROM islands),
    near AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY start, "end", id) AS rn FROM c WHERE "end" - start <= 20000),
    walk(chr, rn, id, head, reach, held, batch) AS (SELECT chr, rn, id, start, "end", 1, CAST(0 AS BIGINT) FROM near WHERE rn = 1
        UNION ALL SELECT chr, rn, id, CASE WHEN fits THEN head ELSE start END, CASE WHEN fits THEN greatest(reach, "end") ELSE "end" END, CASE WHEN fits THEN held + 1 ELSE 1 END, CASE WHEN fits THEN batch ELSE batch + 1 END
        FROM (SELECT n.*, w.head, w.reach, w.held, w.batch, w.held < 20 AND greatest(w.reach, n."end") - w.head <= 20000 AS fits FROM walk w JOIN near n ON n.chr = w.chr AND n.rn = w.rn + 1)),
    packed AS (SELECT chr, batch, count(*) AS n, min(id) AS first FROM walk GROUP BY chr, batch UNION ALL SELECT chr, -1 - id, 1, id FROM c WHERE "end" - start > 20000)"""


@query(PACKED + " SELECT * FROM packed")
def pack_batches(spark, d):
    found = candidates.numbered(candidates.regions(view(spark, d, "v_signal"))).withColumnRenamed("region_id", "container_id")
    return candidates.batches(candidates.extents(found), most=20, span=20_000).select("chr", "batch", F.size("container_ids").cast("bigint").alias("n"), F.array_min("container_ids").alias("first"))


@query()
def folded_regions(spark, d):
    found = candidates.numbered(candidates.regions(view(spark, d, "v_signal"))).select("region_id", "chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    rows = intervals.range_join(view(spark, d, "v_signal"), found, points=True).select("region_id", "chr", "start", "end", "sv_type", "size", "read_id")
    return candidates.folded(rows).select("chr", "start", "end", F.size("region_ids").alias("n_regions"))


# --- genotypes and families ----------------------------------------------------------

LIKELY = """WITH f AS (SELECT *, CASE cn WHEN 1 THEN [0.05::DOUBLE, 0.95] WHEN 2 THEN [0.05::DOUBLE, 0.5, 0.95] WHEN 3 THEN [0.05::DOUBLE, 1.0/3, 2.0/3, 0.95] ELSE [0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95] END AS p FROM v_reads),
    g AS (SELECT *, list_transform(p, lambda x: n_alt * ln(x) + (n_total - n_alt) * ln(1 - x)) AS l FROM f),
    h AS (SELECT *, list_max(l) AS top, list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS total FROM g)"""


@query(LIKELY + """ SELECT locus, cn, CAST(list_position(l, top) - 1 AS INT) AS gt_alt, round(1 / total, 6) AS gp,
    repeat('0/', CAST(cn AS INT) - CAST(list_position(l, top) AS INT) + 1) || repeat('1/', CAST(list_position(l, top) AS INT) - 1) AS gt FROM h""")
def genotype_likelihood(spark, d):
    out = genotypes.likelihoods(view(spark, d, "v_reads"))
    return rounded(out, "gp").select("locus", "cn", "gt_alt", "gp", F.concat("gt", F.lit("/")).alias("gt"))


@query("""WITH several AS (SELECT sample, size % 50 AS region_id FROM v_genotype WHERE gt = '0/1' GROUP BY ALL HAVING count(DISTINCT variant_id % 7) >= 2)
    SELECT g.variant_id, g.sample, CASE WHEN s.sample IS NOT NULL AND gt = '1/1' THEN '0/1' ELSE gt END AS gt, CASE WHEN s.sample IS NOT NULL AND gt = '1/1' THEN least(60, 30) ELSE 60 END AS gq
    FROM v_genotype g LEFT JOIN several s ON g.sample = s.sample AND g.size % 50 = s.region_id""")
def multi_assembly_fix(spark, d):
    rows = view(spark, d, "v_genotype").withColumns({"region_id": F.expr("size % 50"), "gq": F.lit(60)})
    several = genotypes.several_assemblies(rows.where("gt = '0/1'").withColumn("assembly", F.expr("variant_id % 7")))
    return genotypes.corrected(rows, several).select("variant_id", "sample", "gt", "gq")


ALT = "CASE {0}.gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END"
STATUS = f"""WITH t AS (SELECT c.variant_id, c.svtype, c.size, {ALT.format('c')} AS k, {ALT.format('f')} AS f, {ALT.format('m')} AS m
        FROM v_genotype c JOIN v_genotype f ON f.variant_id = c.variant_id AND f.sample = 'father' JOIN v_genotype m ON m.variant_id = c.variant_id AND m.sample = 'mother' WHERE c.sample = 'child'),
    named AS (SELECT *, CASE WHEN k + f + m = 0 THEN 'non_informative' WHEN k = 0 OR (k = 1 AND f + m > 0) OR (k = 2 AND f > 0 AND m > 0) THEN 'consistent' ELSE 'inconsistent' END AS status,
        CASE WHEN size < 100 THEN '<100' WHEN size < 350 THEN '100-350' WHEN size < 1000 THEN '350-1000' WHEN size < 10000 THEN '1k-10k' ELSE '>10k' END AS size_bin FROM t)"""


def trio_rows(spark, d):
    pedigree = spark.createDataFrame([("child", "father", "mother")], "individual string, father string, mother string")
    return genotypes.trios(view(spark, d, "v_genotype"), pedigree).withColumn("size_bin", genotypes.size_bin(F.col("size")))


@query(STATUS + " SELECT variant_id, svtype, status FROM named")
def mendelian_status(spark, d):
    return trio_rows(spark, d).select("variant_id", "svtype", "status")


@query(STATUS + """ SELECT coalesce(svtype, 'all') AS svtype, coalesce(size_bin, 'all') AS size_bin, status, count(*) AS n FROM named
    GROUP BY GROUPING SETS ((svtype, size_bin, status), (svtype, status), (size_bin, status), (status))""")
def mendelian_grouping_sets(spark, d):
    return genotypes.consistency(trio_rows(spark, d))


STATES = ("consistent", "inconsistent", "non_informative", "uncertain")


@query(STATUS + " SELECT svtype, " + ", ".join(f"coalesce(CAST(sum(CASE WHEN status = '{s}' THEN 1 END) AS BIGINT), 0) AS {s}" for s in STATES) + " FROM named GROUP BY svtype")
def pivot_status(spark, d):
    return trio_rows(spark, d).groupBy("svtype").pivot("status", list(STATES)).agg(F.count(F.lit(1))).na.fill(0)


# --- sequences -----------------------------------------------------------------------

KMERS = """WITH words AS (SELECT doc_id, substr(seq, CAST(i AS INT), 9) AS w FROM v_dna, unnest(range(1, length(seq) - 7)) AS t(i) WHERE length(seq) >= 9),
    counts AS (SELECT doc_id, least(w, translate(w, 'ACGT', 'TGCA')) AS kmer, count(*) AS n FROM words GROUP BY ALL)"""


@query(KMERS + " SELECT kmer, CAST(sum(n) AS BIGINT) AS total, count(*) AS docs, max(n) AS most FROM counts GROUP BY kmer")
def kmer_counts(spark, d):
    counts = dna.kmer_counts(view(spark, d, "v_dna"), "doc_id", "seq")
    return counts.groupBy("kmer").agg(F.sum("n").alias("total"), F.count("*").alias("docs"), F.max("n").alias("most"))


@query(KMERS + """, totals AS (SELECT doc_id, sum(n) AS total, count(*) AS kinds FROM counts GROUP BY doc_id),
    pairs AS (SELECT doc_id AS a, doc_id + 1 AS b FROM v_dna WHERE doc_id + 1 IN (SELECT doc_id FROM v_dna)),
    shared AS (SELECT p.a, p.b, sum(least(x.n, y.n)) AS shared FROM pairs p JOIN counts x ON x.doc_id = p.a JOIN counts y ON y.doc_id = p.b AND y.kmer = x.kmer GROUP BY ALL)
    SELECT p.a, p.b, round(coalesce(coalesce(s.shared, 0) / CAST(CASE WHEN x.kinds <= y.kinds THEN x.total ELSE y.total END AS DOUBLE), 0), 6) AS similarity
    FROM pairs p LEFT JOIN shared s USING (a, b) LEFT JOIN totals x ON x.doc_id = p.a LEFT JOIN totals y ON y.doc_id = p.b""")
def kmer_similarity(spark, d):
    rows = view(spark, d, "v_dna")
    ids = rows.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    pairs = ids.join(rows.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    return rounded(dna.kmer_similarity(dna.sources(rows, "doc_id", "seq"), pairs, "doc_id"), "similarity")


@query("SELECT doc_id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc, CASE WHEN length(seq) > 0 THEN round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / CAST(length(seq) AS DOUBLE), 6) END AS gc FROM v_dna")
def reverse_complement(spark, d):
    return view(spark, d, "v_dna").select("doc_id", dna.reverse_complement("seq").alias("rc"), F.round(dna.gc_fraction("seq"), 6).alias("gc"))


@query("""WITH runs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Z]+') AS u, regexp_extract_all(coalesce(text, ''), '[a-z]+') AS l FROM documents)
    SELECT doc_id, CAST(len(u) AS BIGINT) AS cores, CAST(len(l) AS BIGINT) AS pads, CAST(coalesce(list_max(list_transform(u, lambda x: length(x))), 0) AS BIGINT) AS longest_core,
        CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS pad_bases FROM runs""")
def case_run_stats(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("seq"))
    upper, lower = dna.case_runs("seq")
    df = docs.select("doc_id", upper.alias("u"), lower.alias("l"))
    return df.select("doc_id", F.size("u").cast("bigint").alias("cores"), F.size("l").cast("bigint").alias("pads"), F.coalesce(F.array_max("u"), F.lit(0)).cast("bigint").alias("longest_core"), F.expr("aggregate(l, 0L, (s, x) -> s + x)").alias("pad_bases"))


@query("""WITH letters AS (SELECT doc_id, i, substr(seq, CAST(i AS INT), 1) AS c FROM v_dna, unnest(range(1, length(seq) + 1)) AS t(i)),
    grouped AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM letters)
    SELECT doc_id, c AS base, min(i) - 1 AS start, max(i) AS "end" FROM grouped GROUP BY doc_id, c, g HAVING count(*) >= 5""")
def mono_runs(spark, d):
    """Runs of one base (W18): each read in its own row, so no shuffle at all."""
    found = "regexp_extract_all(seq, '(A{5,}|C{5,}|G{5,}|T{5,})', 0)"
    rows = view(spark, d, "v_dna").withColumn("m", F.expr(found)).withColumn("g", F.expr("split(seq, '(A{5,}|C{5,}|G{5,}|T{5,})', -1)"))
    steps = "aggregate(zip_with(slice(g, 1, size(m)), m, (x, y) -> struct(length(x) AS x, length(y) AS y, left(y, 1) AS b)), named_struct('p', 0L, 'a', cast(array() AS array<struct<base: string, start: bigint, `end`: bigint>>)), (s, r) -> named_struct('p', s.p + r.x + r.y, 'a', concat(s.a, array(named_struct('base', r.b, 'start', s.p + r.x, 'end', s.p + r.x + r.y)))), s -> s.a)"
    return rows.select("doc_id", F.inline(F.expr(steps)))


CIGARS = "SELECT l_orderkey * 10 + l_linenumber AS aln_id, l_partkey AS pos, l_suppkey AS a, CAST(l_quantity AS BIGINT) AS b, l_linenumber AS c FROM lineitem"


@query(f"""WITH x AS (SELECT DISTINCT * FROM ({CIGARS})), ops AS (
        SELECT *, 0 AS k, 'S' AS op, a AS len FROM x UNION ALL SELECT *, 1, 'M', b * 10 FROM x UNION ALL SELECT *, 2, 'D', CAST(c AS BIGINT) FROM x UNION ALL SELECT *, 3, 'M', b FROM x UNION ALL SELECT *, 4, 'I', a + 1 FROM x UNION ALL SELECT *, 5, 'M', 7 FROM x),
    run AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len END) OVER w, 0) AS q, pos + coalesce(sum(CASE WHEN op IN ('M', 'D') THEN len END) OVER w, 0) AS r FROM ops WINDOW w AS (PARTITION BY aln_id, pos, a, b ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT aln_id, pos, op, CAST(len AS BIGINT) AS len, CAST(q AS BIGINT) AS read_start, CAST(r AS BIGINT) AS ref_start FROM run""")
def cigar_blocks(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber AS aln_id", "l_partkey AS pos", "l_suppkey AS a", "CAST(l_quantity AS BIGINT) AS b", "l_linenumber AS c").distinct()
    rows = rows.withColumn("cigar", F.expr("concat(a, 'S', b * 10, 'M', c, 'D', b, 'M', a + 1, 'I7M')"))
    return rows.select("aln_id", "pos", F.inline(dna.cigar_blocks())).select("aln_id", "pos", "op", "len", "read_start", "ref_start")


@query("""WITH found AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="/([^"]*)"', 1)) AS link FROM pages) SELECT page_id, link, count(*) AS n FROM found GROUP BY ALL""")
def log_region_extract(spark, d):
    found = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="/([^"]*)"'), F.lit(1))).alias("link"))
    return found.groupBy("page_id", "link").agg(F.count("*").alias("n"))


# --- statistics ----------------------------------------------------------------------


@query("""WITH g AS (SELECT chr, sv_type, count(*) AS n, avg(size) AS m, var_samp(size) AS v FROM v_signal GROUP BY ALL),
    p AS (SELECT a.chr AS a, b.chr AS b, a.sv_type, a.m - b.m AS gap, ((a.n - 1) * coalesce(a.v, 0) + (b.n - 1) * coalesce(b.v, 0)) / nullif(a.n + b.n - 2, 0) AS pooled FROM g a JOIN g b ON a.sv_type = b.sv_type AND a.chr < b.chr)
    SELECT a, b, sv_type, round(CASE WHEN coalesce(pooled, 0) = 0 AND gap = 0 THEN 0 ELSE gap / sqrt(pooled) END, 6) AS d FROM p""")
def cohens_d(spark, d):
    g = view(spark, d, "v_signal").groupBy("chr", "sv_type").agg(F.count("*").alias("n"), F.avg("size").alias("m"), F.var_samp("size").alias("v"))
    a, b = (g.select(F.col("chr").alias(s), "sv_type", *(F.col(c).alias(f"{s}{c}") for c in "nmv")) for s in "ab")
    c = F.col
    return a.join(b, "sv_type").where("a < b").select("a", "b", "sv_type", F.round(scores.cohens_d(c("an"), c("am"), c("av"), c("bn"), c("bm"), c("bv")), 6).alias("d"))


@query("""WITH v AS (SELECT label AS group_id, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
    n AS (SELECT *, lead(vec_id) OVER w AS o, lead(x) OVER w AS ox, lead(y) OVER w AS oy FROM v WINDOW w AS (PARTITION BY group_id ORDER BY vec_id)),
    d AS (SELECT group_id, vec_id AS a, o AS b, sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) AS distance FROM n WHERE o IS NOT NULL),
    s AS (SELECT group_id, quantile_cont(distance, 0.5) AS sigma FROM d WHERE distance > 0 GROUP BY 1)
    SELECT group_id, a, b, round(CASE WHEN distance = 0 THEN 1 ELSE exp(-distance * distance / (2 * sigma * sigma)) END, 6) AS similarity FROM d JOIN s USING (group_id)""")
def gaussian_similarity(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("group_id"), "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    w = W.partitionBy("group_id").orderBy("vec_id")
    pairs = v.select("group_id", F.col("vec_id").alias("a"), F.lead("vec_id").over(w).alias("b"), F.sqrt(F.pow(F.col("x") - F.lead("x").over(w), 2) + F.pow(F.col("y") - F.lead("y").over(w), 2)).alias("distance")).where("b IS NOT NULL")
    return rounded(patterns.gaussian_similarity(pairs), "similarity").select("group_id", "a", "b", "similarity")


@query("""WITH m AS (SELECT s_suppkey AS group_id, l_orderkey * 10 + l_linenumber AS read_id, min(l_extendedprice) AS length FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    f AS (SELECT *, CASE WHEN length / lag(length) OVER (PARTITION BY group_id ORDER BY length, read_id) > 1.2 THEN 1 ELSE 0 END AS fresh FROM m),
    c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY group_id ORDER BY length, read_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f)
    SELECT group_id, read_id, cluster, count(*) OVER (PARTITION BY group_id, cluster) < greatest(2, floor(sqrt(count(*) OVER (PARTITION BY group_id) / 2.0))) AS outlier FROM c""")
def length_gap_outliers(spark, d):
    lines, supplier = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    reads = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("group_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("read_id")).agg(F.min("l_extendedprice").alias("length"))
    return patterns.length_outliers(reads.withColumn("k", F.lit(2.0))).select("group_id", "read_id", "cluster", "outlier")


@query("""WITH m AS (SELECT o_custkey AS group_id, o_orderkey AS read_id, o_totalprice AS similarity, o_orderkey * 37 % 1001 AS aligned FROM orders),
    r AS (SELECT group_id, read_id, row_number() OVER (PARTITION BY group_id ORDER BY similarity DESC, read_id) + row_number() OVER (PARTITION BY group_id ORDER BY aligned DESC, read_id) AS rank FROM m)
    SELECT group_id, read_id, rank FROM r QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY rank, read_id) = 1""")
def medoid_rank(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS group_id", "o_orderkey AS read_id", "o_totalprice AS similarity", "o_orderkey * 37 % 1001 AS aligned")
    return patterns.medoids(rows).withColumn("rank", F.col("rank").cast("bigint"))


#: Breaks of which some stand at one place, on alignments that lie apart or over each other.
BREAKS = "SELECT user_id AS consensus_id, event_id AS ord, user_id % 3 + event_id % 7 // 6 AS chr, event_id * 13 % 2000 * (event_id % 3 // 2) AS ref, event_id * 7 % 500 AS read, event_type IN ('view', 'click', 'purchase') AS forward, event_id % 4 AS alignment, event_id * 13 % 2000 * (event_id % 3 // 2) - 200 * (event_id % 2) AS aln_start, event_id * 13 % 2000 * (event_id % 3 // 2) + 100 * (1 - event_id % 2) AS aln_end FROM events"


def breaks(spark, d):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("lociq_events")
    return spark.sql(BREAKS.replace("FROM events", "FROM lociq_events").replace("//", "DIV"))


@query(f"""WITH b AS ({BREAKS}), n AS (SELECT *, lead(ord) OVER w AS o2, lead(chr) OVER w AS chr2, lead(ref) OVER w AS ref2, lead(read) OVER w AS read2, lead(forward) OVER w AS f2, lead(alignment) OVER w AS al2, lead(aln_start) OVER w AS as2, lead(aln_end) OVER w AS ae2 FROM b WINDOW w AS (PARTITION BY consensus_id ORDER BY ord)),
    g AS (SELECT *, abs(read2 - read) AS gr, abs(ref2 - ref) AS gf, least(aln_end, ae2) - greatest(aln_start, as2) AS sh FROM n WHERE o2 IS NOT NULL AND alignment <> al2),
    t AS (SELECT consensus_id, ord, gr, gf, array_to_string(list_sort(list_filter([CASE WHEN gr <= 30 THEN 'READCLOSED' ELSE 'READGAP' END, CASE WHEN chr = chr2 AND gf <= 30 THEN 'REFCLOSED' END, CASE WHEN forward <> f2 THEN 'INVERSION' END,
        CASE WHEN chr <> chr2 OR gf > 500000 THEN 'TRANSLOCATION' END, CASE WHEN chr = chr2 AND sh >= 30 THEN 'OVERLAP' WHEN chr = chr2 AND sh <= 0 AND gf > 30 THEN 'REFGAP' END], lambda x: x IS NOT NULL)), ',') AS tags FROM g)
    SELECT consensus_id, ord, tags, CASE tags WHEN 'READGAP,REFCLOSED' THEN 'INS' WHEN 'READCLOSED,REFGAP' THEN 'DEL' ELSE 'ADJ' END AS pattern, CASE tags WHEN 'READGAP,REFCLOSED' THEN gr ELSE gf END AS size FROM t""")
def relation_tags(spark, d):
    return patterns.simple_patterns(patterns.relations(breaks(spark, d))).select("consensus_id", "ord", F.array_join("tags", ",").alias("tags"), "pattern", "size")


@query(f"""WITH b AS ({BREAKS}), f AS (SELECT *, CASE WHEN read - lag(read) OVER (PARTITION BY consensus_id ORDER BY ord) <= 30 THEN 0 ELSE 1 END AS fresh FROM b),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY consensus_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM f),
    k AS (SELECT *, row_number() OVER w AS k, lead(ord) OVER w AS mate FROM r WINDOW w AS (PARTITION BY consensus_id, run ORDER BY ord))
    SELECT consensus_id, ord AS first, mate AS second FROM k WHERE k % 2 = 1 AND mate IS NOT NULL""")
def adjacency_pairs(spark, d):
    return patterns.adjacencies(breaks(spark, d))


FOURS = "SELECT l_orderkey AS consensus_id, l_linenumber AS ord, min(l_suppkey) % 2 AS chr, min(l_partkey) AS ref, l_linenumber * 100 AS read, l_linenumber IN (1, 4) AS forward, l_linenumber AS alignment, min(l_partkey) AS aln_start, min(l_partkey) + 50 AS aln_end FROM {0} WHERE l_linenumber <= 4 GROUP BY l_orderkey, l_linenumber"


@query(f"""WITH b AS ({FOURS.format('lineitem')}), q AS (SELECT consensus_id, max(ref) FILTER (WHERE ord = 1) AS a, max(ref) FILTER (WHERE ord = 2) AS b, max(ref) FILTER (WHERE ord = 3) AS c, max(ref) FILTER (WHERE ord = 4) AS d FROM b GROUP BY 1 HAVING count(*) = 4)
    SELECT consensus_id, CASE WHEN abs(c - b) < abs(d - a) - 5 THEN 'INV-DEL' WHEN abs(c - b) > abs(d - a) + 5 THEN 'INV-DUP' ELSE 'INV' END AS pattern, CASE WHEN abs(c - b) < abs(d - a) - 5 THEN abs(d - a) ELSE abs(c - b) END AS size FROM q""")
def inversion_quads(spark, d):
    spark.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("lociq_lineitem")
    return patterns.quads(spark.sql(FOURS.format("lociq_lineitem")))


ALL_BREAKS = FOURS.replace(" WHERE l_linenumber <= 4", "")


@query(f"""WITH b AS ({ALL_BREAKS.format('lineitem')}), q AS (SELECT consensus_id, max(ref) FILTER (WHERE ord = 1) AS a, max(ref) FILTER (WHERE ord = 2) AS b, max(ref) FILTER (WHERE ord = 3) AS c, max(ref) FILTER (WHERE ord = 4) AS d FROM b GROUP BY 1 HAVING count(*) = 4 AND max(ord) = 4)
    SELECT consensus_id, CASE WHEN abs(c - b) < abs(d - a) - 5 THEN 'INV-DEL' WHEN abs(c - b) > abs(d - a) + 5 THEN 'INV-DUP' ELSE 'INV' END AS pattern, CASE WHEN abs(c - b) < abs(d - a) - 5 THEN abs(d - a) ELSE abs(c - b) END AS size FROM q""")
def inversion_quads_whole(spark, d):
    spark.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("lociq_lineitem")
    return patterns.quads(spark.sql(ALL_BREAKS.format("lociq_lineitem")))


@query("""WITH g AS (SELECT l_partkey AS composite_id, l_returnflag AS sample, l_suppkey AS consensus_id, CAST(abs(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT))) AS BIGINT) AS size, count(DISTINCT l_orderkey) AS support FROM lineitem GROUP BY 1, 2, 3)
    SELECT composite_id, sample, consensus_id, size, support FROM g QUALIFY row_number() OVER (PARTITION BY composite_id ORDER BY support DESC, sample, consensus_id) = 1""")
def best_group_size(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_partkey AS composite_id", "l_returnflag AS sample", "l_suppkey AS consensus_id", "CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT) AS signed_size", "array(l_orderkey) AS reads")
    return patterns.best_group(rows).withColumn("support", F.col("support").cast("bigint"))


@query("""SELECT l_partkey AS pattern_id, l_orderkey AS read_id, round(sum(l_quantity * exp(-l_extendedprice / 5000)) / sum(exp(-l_extendedprice / 5000)), 6) AS distortion FROM lineitem GROUP BY ALL""")
def read_distortions(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_partkey AS pattern_id", "l_orderkey AS read_id", "l_quantity AS size", "l_extendedprice AS distance")
    return rounded(patterns.distortions(rows), "distortion")


BINS = "CASE WHEN size < 20 THEN '<20' WHEN size < 50 THEN '20-50' WHEN size < 100 THEN '50-100' ELSE '>=100' END"


@query(f"""WITH b AS (SELECT sum(e - s) AS bases FROM v_raf) SELECT sv_type, {BINS} AS size_bin, count(*) AS n, round(count(*) / (max(bases) / 1e6), 6) AS per_megabase, round(quantile_cont(size, 0.95), 6) AS p95 FROM v_signal, b WHERE sv_type <= 1 GROUP BY 1, 2""")
def size_bin_rates(spark, d):
    bases = view(spark, d, "v_raf").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    rows = view(spark, d, "v_signal").where("sv_type <= 1").crossJoin(F.broadcast(bases)).withColumn("size_bin", F.expr(BINS))
    out = rows.groupBy("sv_type", "size_bin").agg(F.count("*").alias("n"), (F.count("*") / (F.max("bases") / 1e6)).alias("per_megabase"), F.expr("percentile(size, 0.95)").alias("p95"))
    return rounded(out, "per_megabase", "p95")


@query("""SELECT s.region_id AS primitive_id, count(DISTINCT r.read_id) AS n_reads FROM v_region s JOIN v_raf r ON s.chr = r.chr AND r.s <= s.s AND s.s <= r.e GROUP BY 1""")
def primitive_support(spark, d):
    primitives = view(spark, d, "v_region").select(F.col("region_id").alias("primitive_id"), F.col("chr").alias("consensus_id"), F.col("start").alias("at"))
    reads = view(spark, d, "v_raf").select(F.col("chr").alias("consensus_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "read_id")
    return patterns.supports(primitives, reads).select("primitive_id", F.size("reads").cast("bigint").alias("n_reads"))


COMPOSED = """edges AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p, l_suppkey % 5 AS r FROM lineitem),
    firsts AS (SELECT k, r, min(p) AS a FROM edges GROUP BY ALL), links AS (SELECT e.k, f.a, e.p AS b FROM edges e JOIN firsts f USING (k, r)),
    twoway AS (SELECT k, a, b FROM links UNION SELECT k, b, a FROM links),
    reach(k, node, other) AS (SELECT k, a, a FROM twoway UNION SELECT r.k, r.node, b.b FROM reach r JOIN twoway b ON r.k = b.k AND r.other = b.a),
    named AS (SELECT k, node, min(other) AS component FROM reach GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {COMPOSED}, pats AS (SELECT l_orderkey AS k, l_partkey AS p, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT)) AS BIGINT) AS z FROM lineitem GROUP BY ALL)
    SELECT n.k * 1000000 + component AS composite_id, CAST(sum(z) AS BIGINT) AS signed_size, count(*) AS n_patterns, CASE WHEN sum(z) >= 0 THEN 'INS' ELSE 'DEL' END AS svtype FROM named n JOIN pats p ON p.k = n.k AND p.p = n.node GROUP BY n.k, component""")
def horizontal_merge(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = lines.groupBy("l_orderkey", "l_partkey").agg(F.expr("CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT)) AS BIGINT)").alias("signed_size"), F.array_sort(F.collect_set(F.expr("l_suppkey % 5"))).alias("repeat_ids"))
    rows = rows.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("pattern_id"), F.lit("s").alias("sample"), F.col("l_orderkey").alias("consensus_id"), "signed_size", "repeat_ids")
    return patterns.horizontal(rows).select("composite_id", "signed_size", "n_patterns", "svtype")


def composites(spark, d):
    rows = view(spark, d, "v_signal").where("sv_type <= 3")
    return rows.select(F.col("signal_id").alias("composite_id"), "chr", "start", F.greatest("end", F.col("start") + 1).alias("end"), F.when(F.col("sv_type") == 0, "INS").when(F.col("sv_type") == 1, "DEL").otherwise("INV").alias("svtype"), "size", F.expr("concat('s', signal_id % 3)").alias("sample"), F.col("read_id").alias("consensus_id"), F.lit(3).alias("n"), F.col("size").cast("double").alias("mean"), F.lit(25.0).alias("variance"))


@query("""WITH c AS (SELECT signal_id AS id, chr, s, greatest(e, s + 1) AS e, sv_type, size, signal_id % 3 AS smp, read_id, CASE WHEN sv_type = 0 THEN greatest(150, size) ELSE 150 END AS reach FROM v_signal WHERE sv_type <= 3)
    SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM c a JOIN c b ON a.chr = b.chr AND a.sv_type = b.sv_type AND a.id <> b.id AND a.s - a.reach < b.e AND b.s < a.e + a.reach
    WHERE NOT (a.smp = b.smp AND a.read_id = b.read_id) AND abs(a.size - b.size) / 5.0 <= 2.0""")
def composite_pairs(spark, d):
    return patterns.merge_pairs(composites(spark, d))


@query()
def vertical_merge(spark, d):
    return patterns.vertical(composites(spark, d))


@query()
def read_clusters(spark, d):
    rows = view(spark, d, "v_signal").where("sv_type <= 1").groupBy(F.expr("chr * 1000000000 + start div 500").alias("container_id"), "read_id").agg(F.sum(F.when(F.col("sv_type") == 0, F.col("size")).otherwise(0)).alias("inserted"), F.sum(F.when(F.col("sv_type") == 1, F.col("size")).otherwise(0)).alias("deleted"))
    return clustering.cluster_reads(rows.withColumn("cn", F.lit(2)))


from lociq.plans import assembly, calling  # noqa: E402,F401  register their queries here


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
