"""Votes, the way to calls, composite links and adjacency calls on planted cases."""

import random

import pytest
from pyspark.sql import functions as F

from lociq.operators import assembly, calls, intervals, patterns, signals
from lociq.sources import sinks
from tests.test_aligner import TURN, dna, noisy


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_votes_beat_every_member(spark):
    rng, truth, rows = random.Random(2), {}, []
    for cluster in range(2):
        truth[cluster] = dna(rng, 700)
        for read in range(9):
            seq = noisy(rng, truth[cluster], 0.06)
            rows.append((cluster, read, seq if read % 2 else seq[::-1].translate(TURN)))
    rows += [(5, 0, "ACGT" * 20), (5, 1, "ACGT" * 30), (6, 0, None), (6, 1, ""), (7, 0, "ac")]
    reads = spark.createDataFrame(rows, "cluster_id bigint, read_id bigint, seq string")
    got = {r.cluster_id: r for r in assembly.consensuses(reads).collect()}
    for cluster, seq in truth.items():
        own = min(edits(got[cluster].sequence, s) for s in (seq, seq[::-1].translate(TURN)))
        least = min(edits(s if r % 2 else s[::-1].translate(TURN), seq) for c, r, s in rows if c == cluster)
        assert own < 0.3 * least and got[cluster].members == 9
    assert set(got) == {0, 1, 5, 7} and got[5].sequence in ("ACGT" * 20, "ACGT" * 30) and got[7].sequence == "AC"


def test_election(spark):
    rows = [(1, 0, 0, "A", 2, False), (1, 0, 0, "C", 2, True), (1, 1, 0, "-", 3, False), (1, 1, 0, "G", 1, True), (1, 0, 1, "T", 3, False), (1, 2, 0, "G", 4, True), (1, 2, 1, "A", 2, False), (1, 3, 0, "T", 1, False), (1, 3, 0, "G", 1, False)]
    votes = spark.createDataFrame(rows, "cluster_id int, column int, rank int, base string, n int, own boolean")
    got = sorted((r.column, r.rank, r.base) for r in assembly.elected(votes).collect())
    assert got == [(0, 0, "C"), (0, 1, "T"), (2, 0, "G"), (3, 0, "G")]


def test_calls_and_audit(spark):
    rng = random.Random(4)
    contigs = [dna(rng, 2500) for _ in range(4)]
    haps = [contigs[0][:1000] + contigs[0][1090:], contigs[1][:1200] + dna(rng, 70) + contigs[1][1200:], contigs[2], contigs[3][:1000] + contigs[3][1000:1700][::-1].translate(TURN) + contigs[3][1700:]]
    reads = [(i, i, r, noisy(rng, h, 0.02)) for i, h in enumerate(haps) for r in range(7)] + [(9, 0, 0, "")]
    out, audit = assembly.called(spark.createDataFrame(reads, "cluster_id bigint, target bigint, read_id bigint, seq string"), spark.createDataFrame(list(enumerate(contigs)), "target bigint, seq string"))
    got = {r.chr: r for r in out.collect()}
    assert {c: r.svtype[:3] for c, r in got.items()} == {0: "DEL", 1: "INS", 3: "INV"}
    assert abs(got[0].start - 1000) < 8 and got[0].svlen in range(86, 95) and abs(got[1].start - 1200) < 8 and abs(got[3].start - 1000) < 20 and all(r.filter == "PASS" for r in got.values())
    assert {(r.stage, r.consensus_id, r.reason) for r in audit.collect()} == {("consensus", 9, "no read with bases"), ("signals", 2, "no signal in the core")}


COMPOSITE = "composite_id bigint, chr bigint, last_chr bigint, start bigint, end bigint, svtype string, size bigint, size_tolerance double, sample string, consensus_id bigint, n int, mean double, variance double"


def composite(i, start=1000, svtype="DEL", size=200, tolerance=1.0, chr_=1, last=None, variance=1.0, sample=None, consensus=None):
    return (i, chr_, chr_ if last is None else last, start, start + (size if svtype == "DEL" else 1), svtype, size, tolerance, sample or f"s{i}", consensus if consensus is not None else i, 3, float(size), variance)


@pytest.mark.parametrize("crowded", [1, 2, 1000])
def test_composite_links_by_each_arm(spark, monkeypatch, crowded):
    monkeypatch.setattr(patterns, "CROWDED_REPEAT", crowded)
    rng = random.Random(1)
    one, two = dna(rng, 300), dna(rng, 300)
    rows = [
        composite(1), composite(2, start=1250), composite(3, start=90_000), composite(4, start=50_000), composite(5, start=50_010, size=300),
        composite(10, svtype="INV"), composite(11, svtype="INV-DUP", start=1010), composite(12, svtype="INV", start=1020), composite(13, svtype="INV", start=1030, last=2),
        composite(20, start=700_000, tolerance=1.0, size=300), composite(21, start=700_010, size=400, tolerance=0.75), composite(22, start=700_020, size=400, tolerance=1.0),
        composite(30, start=5, svtype="INS", sample="x", consensus=7), composite(31, start=6, svtype="INS", sample="x", consensus=7),
    ]
    table = spark.createDataFrame(rows, COMPOSITE)
    reps = spark.createDataFrame([(1, 5), (3, 5), (3, 5), (5, 5), (30, 6), (31, 6), (10, 7), (12, 7), (4, 8)], "composite_id bigint, repeat_id bigint")
    got = {(r.a, r.b): (r.near, r.shared) for r in patterns.composite_links(table, reps).collect()}
    assert got == {
        (1, 2): (True, False), (1, 3): (False, True), (10, 11): (True, False), (10, 12): (True, True), (11, 12): (True, False),
        (20, 21): (True, False), (21, 22): (True, False),
    }
    flat = table.withColumn("size_tolerance", F.lit(1.0))
    assert (20, 21) not in {(r.a, r.b) for r in patterns.composite_links(flat, reps).collect()}  # complexity alone
    sequences = spark.createDataFrame([(10, one), (11, two), (12, one), *((i, one) for i in (1, 2, 3, 20, 21, 22))], "composite_id bigint, seq string")
    parted = {(r.a, r.b) for r in patterns.composite_links(table, reps, sequences).collect()}
    assert set(got) - parted == {(10, 11), (11, 12)}  # only the sequence parts them
    merged = {r.composite_id: r.merged_id for r in patterns.merged_composites(table, patterns.composite_links(table, reps)).collect()}
    assert merged == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 10: 10, 11: 10, 12: 10, 13: 13, 20: 20, 21: 20, 22: 20, 30: 30, 31: 31}


def test_adjacency_calls(spark):
    kinds = "composite_id bigint, sample string, consensus_id bigint, pattern_id bigint, support bigint, ord int, chr string, at bigint, sv_type int, forward boolean, inserted string, n_repeats int"
    pair = lambda c, sample, p, support, a, b, inserted="", repeats=0: [(c, sample, 1, p, support, 0, *a, inserted, repeats), (c, sample, 1, p, support, 1, *b, inserted, 0)]
    rows = pair(1, "b", 1, 5, ("x", 10, 4, True), ("y", 20, 3, True)) + pair(1, "a", 2, 5, ("x", 11, 4, False), ("y", 21, 3, False), "AC") + pair(2, "a", 3, 1, ("x", 10, 3, True), ("x", 99, 4, True), "G" * 50, 2)
    rows += [(3, "a", 1, 9, 7, 0, "x", 5, 4, True, None, 0)]
    genotypes = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "a", 2)], "composite_id bigint, sample string, n_alt bigint")
    got = {r.call_id: r for r in calls.adjacency_calls(spark.createDataFrame(rows, kinds), genotypes, symbolic_from=40).collect()}
    assert set(got) == {"a.1.2.0", "a.1.2.1", "a.1.3.0", "a.1.3.1"}
    assert all(got[r.mate_id].mate_id == r.call_id and r.end == r.start + 1 and r.svtype == "BND" for r in got.values())
    assert [got[f"a.1.2.{k}"].alt for k in (0, 1)] == ["NAC]y:22]", "[x:12[NAC"] and got["a.1.2.0"].filter == "PASS" and got["a.1.2.0"].svlen == 2 and got["a.1.2.0"].precise
    assert [got[f"a.1.3.{k}"].alt for k in (0, 1)] == ["]<ctg_a.1.3>:50]N", "N[<ctg_a.1.3>:1["] and got["a.1.3.1"].filter == "LowQual" and not got["a.1.3.1"].precise
    alone = spark.createDataFrame(pair(1, "b", 1, 5, ("x", 10, 4, True), ("y", 20, 3, True)), kinds)
    assert sorted(r.alt for r in calls.adjacency_calls(alone, genotypes).collect()) == ["N[y:21[", "]x:11]N"]


def test_small_helpers(spark, tmp_path):
    rows = spark.createDataFrame([("b", 5, 9), ("a", 7, 8), ("a", 1, 2), ("b", 1, 3)], "chr string, ref_start bigint, ref_end bigint")
    signals.in_order(rows, str(tmp_path / "o"))
    files = sorted((tmp_path / "o").glob("*.parquet"))
    assert [tuple(r) for f in files for r in spark.read.parquet(str(f)).collect()] == [("a", 1, 2), ("a", 7, 8), ("b", 1, 3), ("b", 5, 9)]
    spans = spark.createDataFrame([(0, 5, 5, 9), (0, 5, 3, 9), (0, 5, 9, 12)], "a int, b int, c int, d int")
    assert [r[0] for r in spans.select(intervals.signed_overlap("a", "b", "c", "d")).collect()] == [1, 3, -3]
    sinks.write_fasta(spark.createDataFrame([("n", "ACGT" * 30), ("e", "")], "name string, seq string").coalesce(1), str(tmp_path / "f"))
    text = "".join(p.read_text() for p in (tmp_path / "f").glob("*.txt"))
    assert text == f">n\n{('ACGT' * 20)}\n{('ACGT' * 10)}\n>e\n\n"


def plain_complexity(text):
    """Mean over windows of the product of the shares of distinct words, with queues."""
    n = len(text)
    if n < 3:
        return 1.0
    window = min(n, 15)
    window -= window % 2 == 0
    queues = {k: [text[i : i + k] for i in range(window - k + 1)] for k in range(min(window, 13), 2, -2)}
    out = []
    for j in range(window - 1, n):
        if j >= window:
            for k, held in queues.items():
                if j % k == 0:
                    held.append(text[j - k + 1 : j + 1])
                    del held[0]
        product = 1.0
        for k, held in queues.items():
            product *= len(set(held)) / min(5**k, len(held))
        out.append(product)
    return sum(out) / len(out)


def test_sequence_statistics(spark):
    from lociq.operators import statistics

    rng = random.Random(7)
    texts = ["", "A", "AC", "ACG", "ACGT", "ACGTA", "AAAAAAAA", "ACGT" * 10, dna(rng, 14), dna(rng, 15), dna(rng, 16), dna(rng, 200), "AC" * 60, None]
    rows = [(i, "s", 1, 100 * i, 100 * i + 50, i % 2, 9, t) for i, t in enumerate(texts)] + [(50, "s", 1, 5, 5, 3, 9, "ACGT")]
    signals_ = spark.createDataFrame(rows, "signal_id bigint, sample string, chr bigint, start bigint, end bigint, sv_type int, size bigint, seq string")
    repeats = spark.createDataFrame([(1, 40, 120, 8), (1, 130, 135, 7), (1, 250, 251, 9)], "chr bigint, start bigint, end bigint, repeat_id bigint")
    got = {r.signal_id: r for r in statistics.annotated_signals(signals_, repeats).collect()}
    for i, t in enumerate(texts):
        assert (got[i].complexity is None) == (t is None) and (t is None or abs(got[i].complexity - plain_complexity(t)) < 1e-9), t
    assert {i: r.repeat_id for i, r in got.items() if r.repeat_id >= 0} == {1: 7} and got[7].gc_percent == 50 and got[50].complexity is None
    total = {r.sv_type: r for r in statistics.sample_statistics(statistics.annotated_signals(signals_, repeats)).collect()}
    assert (total[1].n, total[1].in_repeats, total[1].bases) == (7, 1, 63) and total[3].complexity is None


def test_links_compare_texts_and_broadcast_no_composites(spark, monkeypatch):
    from lociq.functions import dna as functions

    rng = random.Random(5)
    texts = [dna(rng, 120), dna(rng, 120)]
    table = spark.createDataFrame([composite(i, start=1000 + i, sample=f"s{i}") for i in range(30)], COMPOSITE)
    sequences = spark.createDataFrame([(i, texts[i % 2]) for i in range(29)], "composite_id bigint, seq string")
    reps = spark.createDataFrame([(i, 1) for i in range(30)], "composite_id bigint, repeat_id bigint")
    asked, plain = [], functions.kmer_similarity
    monkeypatch.setattr(functions, "kmer_similarity", lambda counts, pairs, id_col: asked.append((counts.select(id_col).distinct().count(), pairs.count())) or plain(counts, pairs, id_col))
    out = patterns.composite_links(table, reps, sequences)
    assert asked == [(2, 4)]  # two texts, whatever the number of composites
    want = {(a, b): (True, True) for a in range(29) for b in range(a + 1, 29) if a % 2 == b % 2}
    assert {(r.a, r.b): (r.near, r.shared) for r in out.collect()} == want
    plan = patterns.composite_links(table, reps)._jdf.queryExecution().sparkPlan().toString()
    sides = [line for line in plan.splitlines() if "Join" in line]
    assert sum("BroadcastHashJoin" in line for line in sides) == 0


def test_votes_are_worked_out_once(spark):
    """The election reads its votes once: they come from alignments."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    kinds = "cluster_id int, column int, rank int, base string, n int, own boolean"
    rows = [(1, c, k, b, n, False) for c in range(20) for k, b, n in ((0, "A", 2), (0, "C", 1), (1, "T", 2), (2, "G", 1))]
    out = assembly.elected(spark.createDataFrame(rows, kinds).mapInPandas(counted, kinds)).collect()
    assert sorted((r.column, r.rank, r.base) for r in out) == sorted((c, k, b) for c in range(20) for k, b in ((0, "A"), (1, "T")))
    assert seen.value == len(rows)


def test_votes_equal_a_plain_count(spark, monkeypatch):
    """All CIGAR operations, several clusters, texts in parts; few rows leave a part."""
    import random
    import re
    from collections import Counter

    rng, rows = random.Random(3), []
    for i in range(300):
        ops = [(rng.randint(0, 12), rng.choice("MIDNSHP=X")) for _ in range(rng.randint(1, 8))]
        length = sum(n for n, o in ops if o in "MI=XSH")
        rows.append((i % 4, rng.randint(0, 9), "".join(f"{n}{o}" for n, o in ops), "".join(rng.choice("ACGTN") for _ in range(length)), rng.random() < 0.1))
    rows += [(9, 0, "*", "ACGT", False), (9, 0, "", "", False), (9, None, "4M", "ACGT", False), (9, 0, "2M", None, True)]
    n, own = Counter(), set()
    for cluster, pos, cigar, seq, mine in rows:
        if pos is None or seq is None:
            continue
        read, ref = 0, pos
        for size, op in re.findall("([0-9]+)([A-Z=])", cigar):
            for k in range(int(size)):
                at = (ref + k, 0, seq[read + k]) if op in "M=X" else (ref + k, 0, "-") if op == "D" else (ref - 1, k + 1, seq[read + k]) if op == "I" else None
                if at:
                    n[cluster, *at] += 1
                    if mine:
                        own.add((cluster, *at))
            read, ref = read + int(size) * (op in "MI=XSH"), ref + int(size) * (op in "MDN=X")
    table = spark.createDataFrame(rows, "cluster_id bigint, pos bigint, cigar string, seq string, own boolean")
    for letters in (1 << 20, 100):
        monkeypatch.setattr(assembly, "LETTERS", letters)
        got = {(r.cluster_id, r.column, r["rank"], r.base): (r.n, r.own) for r in assembly.votes(table).collect()}
        assert got == {k: (v, k in own) for k, v in n.items()}
    deep = table.where("cluster_id < 4").union(table.where("cluster_id < 4")).coalesce(1).sortWithinPartitions("cluster_id")
    monkeypatch.setattr(assembly, "LETTERS", 1 << 20)
    assert assembly.counted(deep).count() == len(n)


def test_adjacency_calls_gather_no_ends(spark):
    """A pattern of many ends costs its task two of them; it never speaks, nor does one end or no composite."""
    kinds = "composite_id bigint, sample string, consensus_id bigint, pattern_id bigint, support double, ord bigint, chr bigint, at bigint, sv_type int, forward boolean, inserted string, n_repeats bigint"
    row = lambda composite, pattern, support, ord_, at: (composite, "s", 1, pattern, support, ord_, 1, at, 4, True, None, 0)
    rows = [row(1, 10, 9.0, k, 100 + k) for k in range(500)] + [row(1, 11, 3.0, 2, 70), row(1, 11, 3.0, 1, 50), row(1, 12, 8.0, 1, 5), row(2, 13, 9.0, 1, 5)]
    rows += [row(3, 14, 1.0, 1, 20), row(3, 14, 1.0, 1, 20), row(None, 15, 1.0, 1, 30), row(None, 15, 1.0, 2, 40)]
    ends = spark.createDataFrame(rows, kinds)
    out = calls.adjacency_calls(ends, ends.groupBy("composite_id", "sample").agg(F.max("support").alias("n_alt")))
    assert sorted((r.composite_id, r.call_id, r.start) for r in out.collect()) == [(1, "s.1.11.0", 50), (1, "s.1.11.1", 70), (3, "s.1.14.0", 20), (3, "s.1.14.1", 20)]
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_cluster_is_voted_where_its_reads_lie(spark):
    """One task does what seeds and votes as rows do, with one shuffle of the reads."""
    rng, rows = random.Random(11), []
    for c in range(14):
        whole = dna(rng, rng.choice((12, 300, 900))) * rng.choice((1, 1, 2))
        for r in range(rng.choice((1, 2, 4, 7))):
            seq = "".join(x for b in whole for x in ([b] if rng.random() > 0.03 else rng.choice(([], ["A"], [b, "G"]))))
            if r == 3:
                seq = seq[: len(seq) // 2] + dna(rng, 60) + seq[len(seq) // 2 :]
            rows.append((c, r, seq[::-1].translate(TURN) if r % 2 else seq))
    rows += [(20, 1, ""), (20, 2, None), (21, 1, None), (21, 2, "acgt"), (22, 1, "ACGéT"), (22, 2, "ACG"), (23, 1, "N" * 60), (23, 2, dna(rng, 60)), (23, 3, "")]
    reads = spark.createDataFrame(rows, "cluster_id bigint, read_id bigint, seq string").repartition(3)
    held = lambda df: {r.cluster_id: (r.sequence, r.medoid, r.members) for r in df.collect()}
    how = {"size": 200, "k": 11, "w": 5}
    here = held(assembly.consensuses(reads, **how))
    assert here == held(assembly.consensuses(reads, deep=0, **how)) and {21, 22, 23} < here.keys() and 20 not in here
    plain = assembly.consensuses(reads.where("cluster_id < 20"))
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
