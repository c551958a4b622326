"""Genotypes, families, copy number, regions, batches, clusters and patterns by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.operators import calls, candidates, clustering, coverage, genotypes, patterns


def by_hand(n, k, cn):
    fractions = genotypes.FRACTIONS.get(cn) or tuple(min(0.95, max(0.05, i / max(cn, 1))) for i in range(cn + 1))
    p = [math.comb(n, k) * f**k * (1 - f) ** (n - k) for f in fractions]
    best = p.index(max(p))
    return best, p[best] / sum(p)


def test_likelihoods(spark):
    cases = [(10, 5, 2), (10, 0, 2), (10, 10, 2), (7, 3, 3), (9, 2, 4), (5, 5, 1), (6, 3, 6), (40, 20, 2)]
    rows = genotypes.likelihoods(spark.createDataFrame([*cases, (0, 0, 2), (3, 1, 0)], "n_total bigint, n_alt bigint, cn bigint")).collect()
    for r in rows[: len(cases)]:
        best, gp = by_hand(r.n_total, r.n_alt, r.cn)
        assert r.gt_alt == best and r.gp == pytest.approx(gp)
        assert r.gq == (60 if r.gp >= 1 else min(60, math.floor(-10 * math.log10(1 - r.gp))))
    gt = {(r.n_total, r.n_alt, r.cn): r.gt for r in rows}
    assert gt[10, 5, 2] == "0/1" and gt[10, 10, 2] == "1/1" and gt[6, 3, 6] == "1/1/1/0/0/0" and gt[0, 0, 2] == "0/0" and gt[3, 1, 0] == "0"
    assert [r.gq for r in rows if r.n_total == 0] == [60]


@pytest.mark.parametrize("child,father,mother,status", [
    ("0/0", "0/0", "0/0", "non_informative"), ("0/1", "0/0", "0/0", "inconsistent"), ("0/1", "0/1", "./.", "consistent"), ("1/1", "0/1", "0/0", "inconsistent"),
    ("1/1", "0/1", "1/1", "consistent"), ("1", "0", "0/0", "non_informative"), ("1", "1", "0/0", "inconsistent"), ("1", "0", "0/1", "consistent"), ("0/1/1", "0/1", "0/1", "consistent"),
    ("0/1/1/1", "0/1", "0/1", "inconsistent"), ("0/0/0/0/1", "0/1", "0/1", "uncertain"), ("0/0", "1/1", "1/1", "consistent"),
])
def test_inheritance(spark, child, father, mother, status):
    rows = spark.createDataFrame([(1, "c", child), (1, "f", father), (1, "m", mother)], "variant_id bigint, sample string, gt string")
    family = spark.createDataFrame([("c", "f", "m")], "individual string, father string, mother string")
    got = genotypes.trios(rows, family).first().status
    if child == "1" and father == "0" and mother == "0/0":
        status = "inconsistent"  # the child alone carries it
    assert got == status


def test_viterbi_follows_depth():
    depth = np.array([30] * 10 + [60] * 10 + [0] * 10 + [30] * 10, dtype=float)
    path = coverage.viterbi(depth, 30.0)
    assert path[5] == 2 and path[15] == 4 and path[25] == 0 and path[35] == 2
    assert len(coverage.viterbi(np.array([7.0]), 30.0)) == 1


def test_copy_number_defaults(spark):
    regions = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 500, 600), (3, "c", 90, 110)], "region_id bigint, chr string, start bigint, end bigint")
    track = spark.createDataFrame([("c", 0, 100, 0), ("c", 100, 200, 3)], "chr string, start bigint, end bigint, cn bigint")
    assert {r.region_id: r.cn for r in coverage.highest_copy_number(regions, track).collect()} == {1: 2, 2: 2, 3: 3}
    assert {r.region_id: r.cn for r in coverage.usual_copy_number(regions, track).collect()} == {1: 0, 2: 2, 3: 3}


def batches_of(spark, rows, **limits):
    df = spark.createDataFrame([(i, s, e, [c]) for i, c, s, e in rows], "container_id bigint, start bigint, end bigint, chrs array<string>")
    out: dict = {}
    for r in candidates.batches(df, **limits).orderBy("chr", "batch").collect():
        out.setdefault(r.chr, []).append(list(r.container_ids))
    return out


def test_batches(spark):
    rows = [(1, "chr1", 100, 200), (2, "chr1", 300, 400), (3, "chr1", 500, 600), (4, "chr2", 100, 200)]
    assert batches_of(spark, rows, most=100, span=10_000) == {"chr1": [[1, 2, 3]], "chr2": [[4]]}
    five = [(i, "c", 100 * i, 100 * i + 50) for i in range(1, 6)]
    assert [len(b) for b in batches_of(spark, five, most=2)["c"]] == [2, 2, 1]
    wide = [(1, "c", 100, 200), (2, "c", 5000, 5100), (3, "c", 9000, 9100)]
    assert batches_of(spark, wide, span=5100)["c"] == [[1, 2], [3]]
    assert batches_of(spark, [(1, "c", 0, 99), (2, "c", 0, 10**9)])["c"] == [[2], [1]]


def plain_strength(rows):
    """All pairs, for windows that are not crowded."""
    out = {}
    for i, s, e, read, kind, size, rep in rows:
        total = 0.0
        for j, s2, e2, read2, kind2, size2, rep2 in rows:
            if read == read2 or kind != kind2:
                continue
            gap = max(0, max(s, s2) - (e if s <= s2 else e2))
            same = rep >= 0 and rep == rep2
            d = gap // 10 if same else gap
            if d > 1000 or kind >= 3 and d > (500 if same else 100):
                continue
            small, diff = min(size, size2), abs(size - size2)
            alike = 0.0 if kind >= 3 or diff > 0.1 * small else 1.0 if diff < 0.01 * small else 0.01 * small / (100 * diff)
            total += 1.0 if d <= 0 else max(30 / (d + 30), alike)
        out[i] = round(total, 6)
    return out


def test_strengths(spark):
    rng = np.random.RandomState(0)
    rows = []
    for i in range(80):
        s, kind = int(rng.randint(0, 60_000)), int(rng.choice([0, 1, 3, 4]))
        size = int(rng.randint(40, 60))
        rows.append((i, s, s + size * (kind == 1), int(rng.randint(0, 30)), kind, size, -1))
    df = spark.createDataFrame([(i, "c", s, e, r, k, z, p) for i, s, e, r, k, z, p in rows], "signal_id bigint, chr string, start bigint, end bigint, read_id bigint, sv_type int, size bigint, repeat_id bigint")
    wanted = plain_strength(rows)
    assert {r.signal_id: round(r.strength, 6) for r in candidates.band_strength(df).collect()} == wanted
    assert {r.signal_id: round(r.strength, 6) for r in candidates.windowed_strength(df).collect()} == wanted
    crowd = spark.createDataFrame([(i, "c", 1000 + i, 1000 + i, i, 0, 50, -1) for i in range(250)], df.schema)
    assert {r.strength for r in candidates.windowed_strength(crowd).collect()} == {10.0}


def test_similar_sizes_and_effect():
    rows = lambda *sizes: [(1, s, i) for i, s in enumerate(sizes)]
    assert candidates.similar_sizes(rows(200, 210, 205), rows(204, 206, 211))
    assert not candidates.similar_sizes(rows(200, 210, 205), rows(900, 905, 910))
    assert not candidates.similar_sizes(rows(20, 30), rows(25, 35))
    assert candidates.effect([5], [5]) == 0 and candidates.effect([5], [6]) == math.inf


def test_edges_need_single_breaks(spark):
    rows = [(1, r) for r in range(4)] + [(2, r) for r in range(4)] + [(3, 0), (3, 0), (3, 1)]
    df = spark.createDataFrame(rows, "region_id bigint, read_id bigint")
    assert [(r.a, r.b, r.n) for r in candidates.region_edges(df).collect()] == [(1, 2, 4)]
    found = spark.createDataFrame([(1,), (2,), (3,)], "region_id bigint")
    assert {r.region_id: r.container_id for r in candidates.containers(found, candidates.region_edges(df)).collect()} == {1: 1, 2: 1, 3: 3}


def test_inversion_kinds(spark):
    def four(i, refs):
        return [(i, k, "c", ref, 100 * k, k in (0, 3), k, ref, ref + 50) for k, ref in enumerate(refs)]

    rows = four(1, (100, 500, 120, 505)) + four(2, (100, 500, 300, 900)) + four(3, (100, 900, 50, 300)) + four(4, (1, 2, 3, 4))[:3]
    df = spark.createDataFrame(rows, "consensus_id bigint, ord bigint, chr string, ref bigint, read bigint, forward boolean, alignment bigint, aln_start bigint, aln_end bigint")
    got = {r.consensus_id: (r.pattern, r.size) for r in patterns.quads(df).collect()}
    assert got == {1: ("INV-DEL", 405), 2: ("INV-DEL", 800), 3: ("INV-DUP", 850)}


def test_support_is_closed_at_both_ends(spark):
    primitives = spark.createDataFrame([(1, "c", 100), (2, "c", 101)], "primitive_id bigint, consensus_id string, at bigint")
    reads = spark.createDataFrame([("c", 50, 100, "a"), ("c", 100, 150, "b"), ("c", 150, 90, "d")], "consensus_id string, r_start bigint, r_end bigint, read_id string")
    assert {r.primitive_id: r.reads for r in patterns.supports(primitives, reads).collect()} == {1: ["a", "b", "d"], 2: ["b", "d"]}


def test_vertical_merge_with_sequences(spark):
    rows = [(1, "c", 1000, 1001, "INS", 500, "s1", 1), (2, "c", 1010, 1011, "INS", 500, "s2", 2), (3, "c", 1020, 1021, "INS", 500, "s3", 3), (4, "d", 1000, 1001, "INS", 500, "s2", 4)]
    df = spark.createDataFrame(rows, "composite_id bigint, chr string, start bigint, end bigint, svtype string, size bigint, sample string, consensus_id bigint")
    df = df.withColumns({"n": F.lit(3), "mean": F.col("size").cast("double"), "variance": F.lit(4.0)})
    seqs = spark.createDataFrame([(1, "ATCGATCG" * 25), (2, "ATCGATCG" * 25), (3, "GCGCGCGC" * 25), (4, "ATCGATCG" * 25)], "composite_id bigint, seq string")
    assert {r.composite_id: r.merged_id for r in patterns.vertical(df, seqs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.composite_id: r.merged_id for r in patterns.vertical(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_read_clusters(spark):
    rows = [(1, i, 100.0 + i % 3, 0.0, 2) for i in range(6)] + [(1, 10 + i, 400.0 + i % 3, 0.0, 2) for i in range(6)] + [(2, i, 50.0, 5.0, 2) for i in range(4)]
    df = spark.createDataFrame(rows, "container_id bigint, read_id bigint, inserted double, deleted double, cn bigint")
    got = clustering.cluster_reads(df).toPandas()
    one = got[got.container_id == 1]
    assert one[one.read_id < 10].cluster.nunique() == 1 and one.cluster.nunique() == 2
    assert got[got.container_id == 2].cluster.nunique() == 1


def test_outliers_and_consensus(spark):
    similar = np.ones((6, 6))
    similar[5, :5] = similar[:5, 5] = 0
    assert clustering.poorly_connected(similar, 1).tolist() == [False] * 5 + [True]
    reads = spark.createDataFrame([(1, 0, i, "A" * n) for i, n in enumerate((5, 9, 7))], "container_id bigint, cluster bigint, read_id bigint, seq string")
    assert clustering.consensus(reads).first().sequence == "A" * 7
    assert clustering.consensus(reads, lambda s: max(s, key=len)).first().sequence == "A" * 9
    lengths = spark.createDataFrame([(1, i, n) for i, n in enumerate((1000, 1010, 1020, 1015, 1005, 5000))], "group_id bigint, read_id bigint, length bigint").withColumn("k", F.lit(1))
    assert [r.read_id for r in patterns.length_outliers(lengths).where("outlier").collect()] == [5]




def test_many_containers_are_clustered_as_one_by_one(spark):
    rng = np.random.RandomState(3)

    def alone(points, k):
        labels = clustering.by_indels(points, k)
        if labels is None:
            d2 = ((points[:, None] - points[None]) ** 2).sum(2)
            labels = clustering.spectral(np.exp(-d2 / (2 * (np.median(d2[d2 > 0]) if (d2 > 0).any() else 1.0))), min(k, len(points)))
        return labels.tolist()

    made = {c: (rng.randint(0, (60, 500)[c % 2], (1 + c % 7, 2)).astype(float), 1 + c % 4) for c in range(40)}
    rows = [(c, r, float(x), float(y), k) for c, (points, k) in made.items() for r, (x, y) in enumerate(points)]
    found = clustering.cluster_reads(spark.createDataFrame(rows, "container_id bigint, read_id bigint, inserted double, deleted double, cn bigint"))
    # Containers share Python batches; a call each was too slow.
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.toPandas().sort_values("read_id").groupby("container_id")["cluster"].agg(list).to_dict()
    assert got == {c: alone(*x) for c, x in made.items()}


def test_tolerances_gather_no_tracks(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["size_tolerances"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in plan._jdf.queryExecution().optimizedPlan().toString()
    rows = [(1, "INS", [[0.5, 0.25], [1.0]]), (2, "DEL", [[], [0.0]]), (3, "BND", [[0.5]]), (4, "INS", [[]])]
    table = spark.createDataFrame(rows, "composite_id bigint, svtype string, tracks array<array<double>>")
    sums = spark.createDataFrame([(i, t, float(sum(map(sum, x))), sum(map(len, x))) for i, t, x in rows], "composite_id bigint, svtype string, total double, length bigint")
    held = lambda df: {r.composite_id: r.size_tolerance for r in df.collect()}
    assert held(calls.summed_tolerance(sums)) == held(calls.complexity_tolerance(table)) == {1: 1.75 / 3, 2: 0.0, 3: 1.0, 4: 0.0}
