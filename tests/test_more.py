"""Operators without SQL against plain versions, and further sources and sinks."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from lociq.functions.dna import cigar_blocks
from lociq.operators import alignments, calls, intervals, signals, statistics
from lociq.sources import sinks, text_formats


def test_range_join_forms_few_rows_on_short_intervals(spark):
    """All intervals are short: what the join forms stays near what it gives."""
    rows = [(i, i % 3, i * 10, i * 10 + 5 + i % 40) for i in range(4000)]
    left = spark.createDataFrame(rows, "i bigint, chr bigint, start bigint, end bigint")
    right = left.select(F.col("i").alias("j"), "chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    formed = intervals._leveled(left, "start", "end", 500, True, "l").join(intervals._leveled(right, "r_start", "r_end", 500, False, "m"), ["chr", "_level", "_bin"]).count()
    assert formed <= 4000 * 40 and intervals.range_join(left, right, width=500).count() > 4000


def test_row_numbers_neighbours_and_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), s := rng.randint(0, 300), s + rng.randint(0, 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "i bigint, chr string, start bigint, end bigint")
    ordered = {c: sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[3], r[0])) for c in "ab"}
    found = {r.i: r.row for r in intervals.row_numbers(df, ("chr",), ("start", "end", "i")).collect()}
    assert found == {r[0]: k for c in "ab" for k, r in enumerate(ordered[c])}
    near = intervals.with_neighbours(df, ("chr",), ("start", "end", "i"), 3, F.col("i"), "near", bucket=8)
    assert {r.i: r.near for r in near.collect()} == {r[0]: [x[0] for x in ordered[c][max(0, k - 3) : k + 4]] for c in "ab" for k, r in enumerate(ordered[c])}
    spans = [(c, s, s + rng.randint(1, 60), rng.randint(1, 9)) for c in "abc" for s in rng.sample(range(300), 60)]
    sums = intervals.overlap_sum(df.where("start < end"), spark.createDataFrame(spans, "chr string, start bigint, end bigint, v bigint"), "i", "total", value=F.col("v"))
    assert {r.i: r.total for r in sums.collect()} == {i: sum(v for d, t, f, v in spans if d == c and s < f and t < e) for i, c, s, e in rows if s < e}


def test_windows_do_not_depend_on_tiles(spark):
    rows = [("c", p, p % 7) for p in random.Random(2).sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "chr string, position bigint, change bigint")
    wanted = {tuple(r) for r in intervals.along(df, ("chr",), ("change",)).collect()}
    for tile in (3, 50):
        assert {tuple(r) for r in intervals.along(df, ("chr",), ("change",), tile).collect()} == wanted


def test_dense_signals_equal_plain_pairs(spark):
    rng = random.Random(5)
    rafs = [(k, [(s := rng.randint(0, 3000), s + (z if t == 1 else 0), 0, 0, z, t) for _ in range(rng.randint(0, 25)) for z, t in [(rng.randint(1, 20), rng.choice((0, 1, 3)))]]) for k in range(30)]
    out = signals.dense(spark.createDataFrame(rafs, f"k bigint, sv_signals array<{signals.SIGNAL}>"), radius=200, least=30)
    plain = {k: [s for s in own if sum(t[4] for t in own if t[5] == s[5] and t[0] - s[1] <= 200 and s[0] - t[1] <= 200) >= 30] for k, own in rafs}
    assert {r.k: [tuple(s) for s in r.sv_signals] for r in out.collect()} == plain


def test_names_hash_with_seed_zero(spark):
    rows = spark.createDataFrame([("c", 1, 5, ""), ("c", 2, 6, None), ("c", 3, 7, "abc")], "chr string, ref_start bigint, ref_end bigint, read_name string")
    found = {r.start: r.read_hash for r in signals.covering(rows).collect()}
    assert {k: v if v is None else int(v) for k, v in found.items()} == {1: 0xEF46DB3751D8E999, 2: None, 3: 0x44BC2CF5AD770999}


def test_long_cigars_take_blocks_in_line(spark):
    ops = "".join(f"{1 + i % 9}{'MIMD'[i % 4]}" for i in range(20_000))
    out = spark.createDataFrame([(ops + "5S", 100)], "cigar string, pos bigint").select(cigar_blocks().alias("b")).first().b
    q, r = 0, 100
    for i, x in enumerate(out[:-1]):
        n, op = 1 + i % 9, "MIMD"[i % 4]
        assert (x.read_start, x.ref_start, x.op) == (q, r, op)
        q, r = q + n * (op != "D"), r + n * (op != "I")
    assert out[-1].op == "S" and out[-1].read_start == q and len(out) == 20_001


def test_places_inside_deletions_and_past_the_ends(spark):
    rows = spark.createDataFrame([(1, "2S10M5D10M3S", 100, True), (2, "2S10M5D10M3S", 100, False)], "i bigint, cigar string, pos bigint, forward boolean").withColumn("blocks", cigar_blocks())
    at = lambda p, side="nearest": {r.i: r.x for r in rows.select("i", alignments.read_place(str(p), side).alias("x")).collect()}
    assert at(50) == {1: 2, 2: 23} and at(104) == {1: 6, 2: 19} and at(500) == {1: 22, 2: 3}
    assert at(111)[1] == 12 and at(114)[1] == 12 and at(110, "left")[1] == 12 and at(112, "right")[2] == 13
    back = {r.i: r.x for r in rows.select("i", alignments.reference_place("6").alias("x")).collect()}
    assert back == {1: 104, 2: 122}


def test_reads_are_trimmed_and_cut(spark):
    reads = spark.createDataFrame([(1, 5, "ACGTACGTAC"), (1, 6, "ACGT")], "container_id bigint, read_id bigint, seq string")
    extents = spark.createDataFrame([(1, 5, 2, 6), (1, 6, 4, 4)], "container_id bigint, read_id bigint, cut_start bigint, cut_end bigint")
    assert [(r.read_id, r.cut_seq) for r in alignments.trimmed(reads, extents).collect()] == [(5, "GTAC")]
    rows = spark.createDataFrame([("2S4M2D4M", 10, "TTACGTGGCC")], "cigar string, pos bigint, seq string").withColumn("blocks", cigar_blocks())
    found = alignments.cut(rows.withColumns({"s": F.lit(12), "e": F.lit(18)}), "s", "e", "seq").first()
    assert (found.cut_pos, found.cut_cigar, found.cut_seq) == (12, "2M2D2M", "GTGG")
    tile = alignments.in_region(spark.createDataFrame([([(10, 10, 0, 0, 5, 0), (9, 11, 0, 0, 2, 1), (20, 25, 0, 0, 5, 1)],)], f"sv_signals array<{signals.SIGNAL}>"), "10", "20").first()
    assert [s.ref_start for s in tile.sv_signals] == [9]
    cores = spark.createDataFrame([(1, 0, 100, 200)], "consensus_id bigint, alignment bigint, start bigint, end bigint")
    inside = spark.createDataFrame([(1, 0, 90, 100), (1, 0, 201, 210), (1, 1, 150, 160)], "consensus_id bigint, alignment bigint, start bigint, end bigint")
    assert [r.start for r in alignments.core_signals(inside, cores).collect()] == [90]


def plain_track(text, w=11, sizes=(2, 3, 4, 5)):
    code = lambda c: {"A": 0, "C": 1, "G": 2, "T": 3}.get(c.upper(), 4)
    s = [code(c) for c in text]
    if len(s) < w:
        return []
    held = {k: [tuple(s[i : i + k]) for i in range(w - k + 1)] for k in sizes}
    share = lambda: math.prod(len(set(held[k])) / min(5**k, w - k + 1) for k in sizes)
    out = [share()]
    for j in range(w, len(s)):
        for k in sizes:
            if j % k == 0:
                held[k] = held[k][1:] + [tuple(s[j - k + 1 : j + 1])]
        out.append(share())
    return out


def test_complexity_and_tolerance(spark):
    rng = random.Random(4)
    texts = ["", "ACGT", "A" * 40, "ACGTN" * 9, "".join(rng.choice("ACGTn") for _ in range(200)), "acgtacgtacgt"]
    out = {r.doc_id: r.track for r in statistics.complexity_track(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, seq string")).collect()}
    for i, t in enumerate(texts):
        assert out[i] == pytest.approx(plain_track(t))
    rows = spark.createDataFrame([(1, "INS", [[0.5, 0.5], [1.0]]), (2, "DEL", [[0.0]]), (3, "BND", [[0.2]]), (4, "INV", [])], "composite_id bigint, svtype string, tracks array<array<double>>")
    assert {r.composite_id: round(r.size_tolerance, 6) for r in calls.complexity_tolerance(rows).collect()} == {1: round(2 / 3, 6), 2: 0.0, 3: 1.0, 4: 0.0}


def test_similar_windows_equal_plain_loops(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("AC") for _ in range(rng.randint(0, 90))) for _ in range(30)]
    wanted = []
    for i, t in enumerate(texts):
        a, b = min(5, len(t)), min(13, len(t))
        w, runs = b - a, []
        for s in range(len(t) - w + 1 if w else 0):
            if abs(s - a) >= w and sum(x != y for x, y in zip(t[s : s + w], t[a:b])) <= 2:
                if runs and s < runs[-1][1]:
                    runs[-1][1] = s + w
                else:
                    runs.append([s, s + w])
        wanted += [(i, s, e) for s, e in runs]
    out = statistics.similar_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, seq string"), "5", "13", 2)
    assert sorted(tuple(r) for r in out.collect()) == sorted(wanted)


def test_halves_are_halves_and_differ(spark):
    reads = spark.range(4000).withColumnRenamed("id", "read_id")
    a, b = ({r.read_id for r in statistics.subsample(reads, k).collect()} for k in (0, 1))
    assert abs(len(a) - 2000) < 150 and abs(len(a & b) - 1000) < 150 and a == {r.read_id for r in statistics.subsample(reads, 0).collect()}


def test_adjacencies_and_breakends_against_plain_pairs(spark):
    rng = random.Random(9)
    ends = [(i, rng.choice((1, 2)), p := rng.randint(0, 3000), p) for i in range(60) for _ in range(2)]
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(40)) if i % 3 else "ACGTTGCAACGGTCATTACGACGT") for i in range(60)]
    df, contexts = spark.createDataFrame(ends, "composite_id bigint, chr bigint, start bigint, end bigint"), spark.createDataFrame(seqs, "composite_id bigint, seq string")
    by = {i: sorted((c, s, e) for j, c, s, e in ends if j == i) for i in range(60)}
    near = {(a, b) for a in by for b in by if a < b and all(x[0] == y[0] and abs(x[1] - y[1]) <= 150 for x, y in zip(by[a], by[b]))}
    assert {tuple(r) for r in calls.adjacency_pairs(df).collect()} == near and near
    parent = {i: i for i in by}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in near:
        r, t = sorted((root(a), root(b)))
        parent[t] = r
    assert {r.composite_id: r.merged_id for r in calls.merged_adjacencies(df).collect()} == {i: root(i) for i in by}
    single = spark.createDataFrame([e for e in ends if e[0] % 2][::2], "composite_id bigint, chr bigint, start bigint, end bigint")
    rows = [tuple(r) for r in single.collect()]

    def kmers(s):
        out = {}
        for i in range(len(s) - 8):
            w = s[i : i + 9]
            w = min(w, w.translate(str.maketrans("ACGT", "TGCA")))
            out[w] = out.get(w, 0) + 1
        return out

    def alike(a, b):
        x, y = kmers(dict(seqs)[a]), kmers(dict(seqs)[b])
        return sum(min(n, y.get(k, 0)) for k, n in x.items()) / sum((x if len(x) <= len(y) else y).values()) >= 0.7

    wanted = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] - 400 < b[2] + 1 and b[2] < a[2] + 1 + 400 and alike(a[0], b[0])}
    assert {tuple(r) for r in calls.breakend_pairs(single, contexts, near=400).collect()} == wanted


def test_containers_give_their_reads(spark):
    rows = [(c, r, 10 * (r % 2) * 10, 0, "ACGT" * (1 + r % 2)) for c in (1, 2, 3) for r in range(8)]
    reads = spark.createDataFrame(rows, "container_id bigint, read_id bigint, inserted bigint, deleted bigint, seq string")
    copies = spark.createDataFrame([(1, 2), (2, 9), (3, 1)], "container_id bigint, cn bigint")
    out = calls.in_containers(reads, copies).collect()
    assert {r.container_id for r in out} == {1, 3} and sorted(x for r in out if r.container_id == 1 for x in r.members) == list(range(8))
    assert {tuple(sorted(r.members)) for r in out if r.container_id == 1} == {(0, 2, 4, 6), (1, 3, 5, 7)}


def test_fasta_in_chunks_and_json_records(spark, tmp_path):
    text = ">one a>b\nACGTAC\nGTA\n\n>two\nCC CC\n>none\n>three\nG\n"
    (tmp_path / "r.fa").write_text(text)
    with gzip.open(tmp_path / "z.fa.gz", "wt") as f:
        f.write(text)
    for name in ("r.fa", "z.fa.gz"):
        found = sorted(tuple(r) for r in text_formats.read_fasta(spark, str(tmp_path / name), chunk=4).collect())
        assert found == [("one", 0, 4, "ACGT"), ("one", 4, 8, "ACGT"), ("one", 8, 9, "A"), ("three", 0, 1, "G"), ("two", 0, 4, "CCCC")]
    rows = spark.createDataFrame([("s", "r1", "c", 1, 9, 0, 8, 60, True, False, [(2, 4, 1, 1, 2, 1)], ("c", 1, 9)), ("s", "r2", "c", 5, 7, 0, 2, 60, False, True, [], None)], text_formats.FRAGMENT)
    sinks.json_tsv_line(rows, "chr", "ref_start").write.option("compression", "gzip").text(str(tmp_path / "rafs"))
    back = text_formats.read_json_tsv(spark, str(tmp_path / "rafs"), text_formats.FRAGMENT)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    done = spark.createDataFrame([(1, [3], [("s:3.0", "ACGT", ["r1"])], [])], text_formats.CONTAINER)
    sinks.write_jsonl(done, str(tmp_path / "j"), spark.createDataFrame([(1,), (2,)], "container_id bigint"))
    assert {r.container_id: None if r.consensuses is None else len(r.consensuses) for r in text_formats.read_jsonl(spark, str(tmp_path / "j")).collect()} == {1: 1, 2: None}


def test_stored_tables_whole_reads_and_text_sinks(spark, tmp_path):
    cov = spark.createDataFrame([("a", 1, 2, 5), ("b", 1, 2, 6)], "chr string, start bigint, end bigint, coverage bigint")
    sinks.write_table(cov, str(tmp_path / "cov"))
    kept = text_formats.read_stored(spark, str(tmp_path / "cov"), chrs=["b"])
    assert [r.coverage for r in kept.collect()] == [6] and "PartitionFilters: [isnotnull(chr" in kept._jdf.queryExecution().toString()
    assert [r.chr for r in text_formats.read_stored(spark, str(tmp_path / "cov"), cov.where("coverage = 5"), ("start", "coverage")).collect()] == ["a"]
    alns = spark.createDataFrame([("r", 0, "c", 100, 200, "100M50S", "A" * 100 + "C" * 50), ("r", 2064, "c", 900, 950, "100H50M", "G" * 50), ("q", 16, "c", 150, 180, "30M", "T" * 30)], "qname string, flag int, rname string, ref_start bigint, ref_end bigint, cigar string, seq string")
    regions = spark.createDataFrame([(1, "c", 160, 170), (2, "c", 910, 920)], "region_id bigint, chr string, r_start bigint, r_end bigint")
    found = {(r.region_id, r.qname): (r.seq[:3], len(r.seq), r.forward) for r in text_formats.whole_reads(alns, regions).collect()}
    assert found == {(1, "r"): ("AAA", 150, True), (1, "q"): ("TTT", 30, False), (2, "r"): ("GGG", 150, False)}
    prims = spark.createDataFrame([(1, 7, "INV-DEL", "c", 10, 20, 10, 4, 5), (2, 7, "INV-DEL", "c", 40, 60, 20, 6, 5), (3, 8, "DEL", "c", 5, 9, 4, 2, 5)], "primitive_id bigint, pattern_id bigint, svtype string, chr string, start bigint, end bigint, size bigint, support bigint, consensus_id bigint")
    assert sorted(tuple(r) for r in sinks.pattern_bed(prims).collect()) == [("c", 5, 9, "DEL-8", 2), ("c", 10, 60, "INV-DEL-7", 6)]
    assert [r.line for r in sinks.primitive_vcf(prims.where("primitive_id = 3"), ["x"]).collect()] == ["c\t6\tDEL.3\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=10;SVLEN=-4;SUPPORT=2\tGT:GQ\t./.:."]
    assert {r.pattern_key for r in sinks.pattern_ids(prims).collect()} == {"0-INV-DEL-5", "1-INV-DEL-5", "0-DEL-5"}
    regions = spark.createDataFrame([(4, "c", 1, 9, 2000)], "region_id bigint, chr string, start bigint, end bigint, n_reads bigint")
    assert tuple(sinks.region_bed(regions).first()) == ("c", 1, 9, 4, 1000)
    counts = spark.createDataFrame([("INS", "all", "consistent", 3), ("INS", "all", "inconsistent", 1)], "svtype string, size_bin string, status string, n bigint")
    report = sinks.family_report(counts)
    assert report.first().percent == 75.0 and report.select(sinks.latex_line("svtype", "percent")).first()[0] == "INS & 75.0 \\\\"
    line = "c\t1\ti\tA\tT\t.\tPASS\tX=1\tGT\t0/1"
    marked = sinks.annotated(spark.createDataFrame([(1, line), (2, line)], "variant_id bigint, line string"), spark.createDataFrame([(1, "consistent")], "variant_id bigint, status string"))
    assert {r.variant_id: r.line for r in marked.collect()} == {1: line.replace("X=1", "X=1;MNDL=consistent"), 2: line}
    sinks.write_tsv(spark.createDataFrame([("c", [1, 2])], "chr string, ids array<bigint>"), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first().ids == "1,2"
    cut = spark.createDataFrame([("r", "ACG", None)], "qname string, cut_seq string, cut_qual string")
    sinks.write_cut_reads(cut, str(tmp_path / "fq"), fastq=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "fq")).collect()] == ["@r", "ACG", "+", "!!!"]
    sinks.write_sequences(spark.createDataFrame([("s:1.0", "ACGT"), ("s:2.0", "C")], "consensus_id string, sequence string"), spark.createDataFrame([("s:2.0",)], "consensus_id string"), str(tmp_path / "fa"), 2)
    assert [r.value for r in spark.read.text(str(tmp_path / "fa")).collect()] == [">s:2.0", "C"]


def test_expected_variants_and_first_stores(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("#chr\tstart\nc\t1\t5\tDEL\t4\tHET\nd\t2\t2\tINS\t9\tHOM\n")
    assert [tuple(r) for r in text_formats.read_expected(spark, str(tmp_path / "e.tsv")).orderBy("expected_id").select("chr", "size", "genotype", "expected_id").collect()] == [("c", 4, "HET", 0), ("d", 9, "HOM", 1)]
    for folder, name, value in (("a", "x", 1), ("b", "x", 2), ("b", "y", 3)):
        spark.createDataFrame([(value,)], "v bigint").write.parquet(str(tmp_path / folder / name))
    tables = text_formats.first_of_each(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert {k: v.first().v for k, v in tables.items()} == {"x": 1, "y": 3}


def test_lists_of_a_consensus_are_joined_last(spark):
    from lociq.operators import statistics

    regions = spark.range(9).selectExpr("id AS region_id")
    members = spark.createDataFrame([(c, r) for c in range(6) for r in range(8) if (r + c) % 3] + [(None, 7), (1, 1), (1, 100)], "consensus_id bigint, region_id bigint")
    out = statistics.others_of_consensus(regions, members)
    held = {c: {r for k, r in ((x.consensus_id, x.region_id) for x in members.collect()) if k == c} for c in range(6)}
    want = sorted((r, c, sorted(held[c] - {r})) for c, r in ((x.consensus_id, x.region_id) for x in members.collect()) if c is not None and r < 9)
    got = out.collect()
    assert sorted((x.region_id, x.consensus_id, x.others) for x in got if x.consensus_id is not None) == want
    assert [(x.region_id, x.others) for x in got if x.consensus_id is None] == [(8, None)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "consensus_id" in joins[0] and "region_id" in joins[1]  # nothing is shuffled by region with its list
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_are_worked_on_in_bounded_parts(spark):
    """Tracks are made of parts of a batch, whatever its rows hold; the rows stay as they are."""
    import pyarrow as pa

    texts = ["ACGT" * 5, None, "", "AC" * 30, "G" * 200, "ACGTT" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "seq"])
    parts = list(statistics.text_parts(iter([batch, batch]), "seq", most=64))
    assert [p.num_rows for p in parts] == [3, 1, 1, 1] * 2 and pa.Table.from_batches(parts).column("seq").to_pylist() == texts * 2
    df = spark.createDataFrame([(i, f"g{i}", t) for i, t in enumerate(texts)], "doc_id bigint, grp string, seq string")
    got = {r.doc_id: (r.grp, r.seq, r.track) for r in statistics.complexity_track(df).collect()}
    assert got == {i: (f"g{i}", t, statistics.window_complexity(t or "", 11, (2, 3, 4, 5)).tolist()) for i, t in enumerate(texts)}
