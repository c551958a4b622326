"""Extraction from alignments: an inverted read, clips, and the filters after it."""

import pytest
from pyspark.sql import functions as F

from lociq.operators import patterns, signals


@pytest.fixture(scope="module")
def inverted(spark):
    rows = [("s", "r", 0, "chr1", 0, 60, "2000M4000S"), ("s", "r", 16, "chr1", 2000, 60, "2000S2000M2000S"), ("s", "r", 2048, "chr1", 4000, 60, "4000S2000M")]
    return spark.createDataFrame(rows, "sample string, qname string, flag int, rname string, pos bigint, mapq int, cigar string")


def test_places_on_read_and_reference(inverted):
    got = {(r.ref_start, r.ref_end, r.read_start, r.read_end) for r in signals.located(inverted).collect()}
    assert got == {(0, 2000, 0, 2000), (2000, 4000, 2000, 4000), (4000, 6000, 4000, 6000)}


def test_breaks_of_an_inversion(inverted):
    rafs = signals.fragments(inverted, most_depth=None).orderBy("ref_start")
    got = [[(s.sv_type, s.ref_start, s.read_start, s.size) for s in r.sv_signals] for r in rafs.collect()]
    assert got[0] == [(4, 2000, 2000, 4000)]
    assert sorted(got[1]) == [(3, 2000, 4000, 2000), (4, 4000, 2000, 2000)]
    assert got[2] == [(3, 4000, 4000, 4000)]


def test_indels_and_small_clips(spark):
    rows = [("s", "a", 0, "c", 100, 60, "5S100M10D50M3D20I7M5H"), ("s", "b", 16, "c", 100, 60, "100M20I100M30D100M")]
    df = spark.createDataFrame(rows, "sample string, qname string, flag int, rname string, pos bigint, mapq int, cigar string")
    got = {r.read_name: [tuple(s) for s in r.sv_signals] for r in signals.fragments(df, min_segment=10, most_depth=None).collect()}
    assert got["a"] == [(200, 210, 105, 105, 10, 1), (263, 263, 155, 175, 20, 0)]
    assert got["b"] == [(200, 200, 200, 220, 20, 0), (300, 330, 100, 100, 30, 1)]


def test_admission_counts_passed_over_rows(spark):
    rows = [("s", f"q{i}", 0, "c", i, 60, "300M") for i in range(10)] + [("s", "late", 0, "c", 305, 60, "300M"), ("s", "low", 0, "c", 5, 0, "300M"), ("s", "second", 256, "c", 5, 60, "300M")]
    df = spark.createDataFrame(rows, "sample string, qname string, flag int, rname string, pos bigint, mapq int, cigar string")
    kept = {r.qname for r in signals.admitted(signals.located(df), most_depth=5).collect()}
    assert kept == {f"q{i}" for i in range(5)} | {"late"}


def test_density_keeps_company(spark):
    sig = lambda s, n, t=1: (s, s + n, 0, 0, n, t)
    rows = [("r", [sig(0, 10), sig(400, 10), sig(800, 10), sig(5000, 10), sig(9000, 40)])]
    df = spark.createDataFrame(rows, f"read_name string, sv_signals array<{signals.SIGNAL}>")
    got = [s.ref_start for s in signals.dense(df).first().sv_signals]
    assert got == [400, 9000]


def test_exploded_keeps_other_columns(inverted):
    flat = signals.exploded(signals.fragments(inverted, most_depth=None))
    assert {"read_name", "chr", "sv_type", "size"} <= set(flat.columns) and flat.count() == 4
    assert flat.where(F.col("sv_type") == 3).count() == 2


@pytest.mark.parametrize("name", ["alignment_signals", "core_intervals", "cut_cigars"])
def test_cigars_are_read_once(spark, name):
    """Filters on what a CIGAR gives must not carry its reading into themselves."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_neighbours_are_sorted_once_and_consensuses_share_batches(spark):
    import __spark_entry__

    plan = lambda name: __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("neighbour_percentile_filter").count("array_sort(") == 1
    assert "MapInPandas" in plan("horizontal_merge") and "FlatMapGroups" not in plan("horizontal_merge")


def test_words_of_a_sequence_are_cut_from_its_bytes(spark):
    from lociq.functions import dna

    rows = [(1, "ACGTACGTACGTé日ACGTTTGCAACC"), (2, None), (3, "ACGT"), (1, "ACGTACGTACGTTT"), (None, "AACCGGTTACGT")]
    counts = dna.kmer_counts(spark.createDataFrame(rows, "i bigint, s string"), "i", "s")
    wanted = {}
    for i, s in rows:
        for at in range(len(s or "") - 8):
            word = s[at : at + 9]
            key = i, min(word, word.translate(str.maketrans("ACGT", "TGCA")))
            wanted[key] = wanted.get(key, 0) + 1
    assert {(r.i, r.kmer): r.n for r in counts.collect()} == wanted
    assert "as binary" in counts._jdf.queryExecution().optimizedPlan().toString()


def test_composites_of_two_consensuses_stay_apart_under_one_number(spark, tmp_path):
    """A part of a million and more gives an order's pattern the number of the next order's."""
    import __spark_entry__

    lines = [(5, 1_000_003, 1, 7.0, "O"), (6, 3, 1, 4.0, "F"), (6, 9, 2, 1.0, "O"), (6, 4, 1, 2.0, "O")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = __spark_entry__.queries()["horizontal_merge"](spark, str(tmp_path))
    assert out.schema.simpleString() == "struct<composite_id:bigint,signed_size:bigint,n_patterns:bigint,svtype:string>"
    assert sorted(tuple(r) for r in out.collect()) == [(6_000_003, -2, 2, "DEL"), (6_000_003, 7, 1, "INS"), (6_000_009, 1, 1, "INS")]
    rows = [("p", "s", 1, None, [1]), ("q", "s", 1, 2.5, [1, 2]), ("p", "s", 2, None, None), ("r", "s", 2, -1.0, [])]
    found = patterns.horizontal(spark.createDataFrame(rows, "pattern_id string, sample string, consensus_id bigint, signed_size double, repeat_ids array<bigint>"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == [("p", 2.5, 2, "INS"), ("p", None, 1, "DEL"), ("r", -1.0, 1, "DEL")]


def test_shared_words_are_counted_without_a_row_a_word(spark):
    from lociq.functions import dna

    rows = [(1, "ACGTACGTACGGTTTGCAACC"), (1, "ACGTTTGCAACCA"), (2, "ACGTACGTACGGTTTGCAANN"), (3, "ACGT"), (4, "日日ACGTACGTACéé"), (5, None), (6, "acgtacgtacggtttgcaacc")]
    held = {}
    for i, s in rows:
        for at in range(len(s or "") - 8):
            word = s[at : at + 9]
            key = min(word, word.translate(str.maketrans("ACGTacgt", "TGCAtgca")))
            held.setdefault(i, {})[key] = held.setdefault(i, {}).get(key, 0) + 1
    asked = [(a, b) for a in range(1, 8) for b in range(1, 8) if a != b]
    wanted = {}
    for a, b in asked:
        x, y = held.get(a, {}), held.get(b, {})
        less = x if len(x) <= len(y) else y
        wanted[a, b] = sum(min(n, y.get(w, 0)) for w, n in x.items()) / sum(less.values()) if x and y else 0.0
    table = spark.createDataFrame(rows, "i bigint, s string")
    out = dna.kmer_similarity(dna.sources(table, "i", "s"), spark.createDataFrame(asked, "a bigint, b bigint"), "i")
    assert {(r.a, r.b): r.similarity for r in out.collect()} == wanted
    assert out.schema.simpleString() == "struct<a:bigint,b:bigint,similarity:double>"
    for df in (out, dna.kmer_counts(table, "i", "s")):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
