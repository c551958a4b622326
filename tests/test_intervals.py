import random

import pytest

from lociq.operators import coverage, intervals


def brute(a, b, within=0, points=False):
    out = []
    for i, c, s, e in a:
        e2 = max(e, s + 1) if points else e
        for j, d, t, f in b:
            f2 = max(f, t + 1) if points else f
            if c == d and s - within < f2 and t < e2 + within:
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("points,within", [(False, 0), (True, 0), (True, 25)])
def test_range_join_every_length(spark, points, within):
    rng = random.Random(points * 7 + within)
    spans = lambda n, k: [(i, rng.randint(0, 2), (s := rng.randint(0, 20_000)), s + rng.choice((0, 1, 5, 100, 3000, 60_000))) for i in range(k, k + n)]
    a, b = spans(120, 0) + [(900, 0, 100, 200), (901, 0, 200, 300)], spans(120, 0) + [(900, 0, 200, 250), (901, 0, 100, 200)]
    left = spark.createDataFrame(a, "i bigint, chr bigint, start bigint, end bigint")
    right = spark.createDataFrame(b, "j bigint, chr bigint, r_start bigint, r_end bigint")
    got = intervals.range_join(left, right, width=10, points=points, within=within)
    assert sorted((r.i, r.j) for r in got.collect()) == brute(a, b, within, points)


def merged(rows, gap, touching):
    out = []
    for s, e in sorted(rows):
        if out and (s <= out[-1][1] + gap if touching else s < out[-1][1] + gap):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("touching", [True, False])
@pytest.mark.parametrize("tile", [1 << 22, 64, 7])
def test_islands_do_not_depend_on_tiles(spark, monkeypatch, touching, tile):
    rng = random.Random(tile)
    rows = [(s := rng.randint(0, 900), s + rng.choice((1, 3, 10, 40))) for _ in range(150)]
    df = spark.createDataFrame([("c", s, e) for s, e in rows], "chr string, start bigint, end bigint")
    for gap in (0, 5):
        ids = intervals.island_ids(df, gap=gap, touching=touching, tile=tile).select("island_start", "island_end").distinct()
        assert sorted(tuple(r) for r in ids.collect()) == merged(rows, gap, touching)


def test_subtract_and_sweep(spark):
    df = spark.createDataFrame([("c", 10, 20), ("c", 15, 30), ("c", 30, 40), ("c", 15, 30)], "chr string, start bigint, end bigint")
    lengths = spark.createDataFrame([("c", 100), ("d", 5)], "chr string, length bigint")
    assert sorted(tuple(r) for r in intervals.subtract(lengths, df).collect()) == [("c", 0, 10), ("c", 40, 100), ("d", 0, 5)]
    assert sorted(tuple(r) for r in intervals.sweep(df).collect()) == [("c", 10, 15, 1), ("c", 15, 20, 3), ("c", 20, 30, 2), ("c", 30, 40, 1)]


def test_tiles_slop_and_lift(spark):
    regions = spark.createDataFrame([("c", 0, 25)], "chr string, start bigint, end bigint")
    assert sorted((r.start, r.end) for r in intervals.tiles(regions, 10).collect()) == [(0, 10), (10, 20), (20, 25)]
    lengths = spark.createDataFrame([("c", 28)], "chr string, length bigint")
    assert [(r.start, r.end) for r in intervals.slop(regions, 5, lengths).collect()] == [(0, 28)]
    features = spark.createDataFrame([("c", 5, 12, "f")], "chr string, start bigint, end bigint, name string")
    into = spark.createDataFrame([("c", 8, 20, 1)], "chr string, r_start bigint, r_end bigint, region_id bigint")
    assert [tuple(r) for r in intervals.lift(features, into).select("region_id", "name", "start", "end").collect()] == [(1, "f", 0, 4)]


@pytest.mark.parametrize("tile", [7, 64, 1 << 22])
def test_distinct_reads_by_tiles(spark, tile):
    rng = random.Random(tile)
    rows = [(rng.choice("ab"), s := rng.randint(-20, 150), s + rng.choice([1, 3, 10, 60]), rng.choice([1, 2, 3, 4, None])) for _ in range(150)]
    rows += [("a", 5, 5, 1), ("a", 40, 30, 2), ("a", None, 33, 1), ("a", 17, None, 1), (None, 1, 9, 1)]
    df = spark.createDataFrame(rows, "chr string, start bigint, end bigint, read_id bigint")
    wanted = set()
    for c in "ab":
        own = [r[1:] for r in rows if r[0] == c]
        cuts = sorted({x for s, e, _ in own for x in (s, e) if x is not None})
        for s, e in zip(cuts, cuts[1:]):
            if n := len({r for a, b, r in own if None not in (a, b, r) and a < e and s < b}):
                wanted.add((c, s, e, n))
    out = coverage.elementary(df, tile)
    assert {tuple(r) for r in out.collect()} == wanted
    # A read's fragments are shuffled once: nothing is joined back to them.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1
