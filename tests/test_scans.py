"""Scans by tiles against plain loops, for every tile size."""

import random

import numpy as np
import pandas as pd
import pytest

from lociq.operators import candidates, coverage, scans
from lociq.operators.graph import cut


def plain_path(observed, median):
    """Viterbi step by step, in whole numbers, with the state before each row kept."""
    means, move, begin = coverage.model(median)
    emit = scans.whole(np.stack([coverage.log_emission(np.array(observed, float), e) for e in means], axis=1)).tolist()
    move, score, before = scans.whole(move).tolist(), None, []
    for row in emit:
        if score is None:
            score, came = [b + e for b, e in zip(scans.whole(begin).tolist(), row)], [0] * 5
        else:
            came = [max(range(5), key=lambda i: (score[i] + move[i][j], -i)) for j in range(5)]  # noqa: B023
            score = [score[came[j]] + move[came[j]][j] + row[j] for j in range(5)]
        before.append(came)
    at = max(range(5), key=lambda i: (score[i], -i))
    path = [at]
    for came in before[:0:-1]:
        path.append(at := came[at])
    return path[::-1]


def track(rng, n):
    out, level = [], 30
    for _ in range(n):
        if rng.random() < 0.15:
            level = rng.choice([0, 15, 30, 45, 60])
        out.append(max(0, int(rng.gauss(level, 6))))
    return out


@pytest.mark.parametrize("rows", [1, 2, 7, 64, 4096])
def test_copy_numbers_equal_a_plain_path(spark, rows):
    rng = random.Random(rows)
    tracks = {r: track(rng, n) for r, n in enumerate((1, 2, 13, 14, 60))}
    tracks[9] = [30] * 20 + [15, 45] * 5  # ties
    bins = spark.createDataFrame([(r, r % 2, 100 * i, 100 * (i + 1), c) for r, t in tracks.items() for i, c in enumerate(t)], "region_id bigint, chr bigint, start bigint, end bigint, coverage bigint")
    wanted = set()
    for r, t in tracks.items():
        path, begin = plain_path(t, 30.0), 0
        assert coverage.viterbi(np.array(t, float), 30.0).tolist() == path
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[begin]:
                wanted.add((r, r % 2, 100 * begin, 100 * i, path[begin]))
                begin = i
    assert {tuple(x) for x in coverage.copy_numbers(bins, 30.0, rows).collect()} == wanted


def plain_batches(rows, most, span):
    out, first, last = [], None, None
    for start, end, i in sorted(rows):
        if first is not None and len(out[-1]) < most and max(last, end) - first <= span:
            out[-1].append(i)
            last = max(last, end)
        else:
            out.append([i])
            first, last = start, end
    return out


@pytest.mark.parametrize("rows", [1, 3, 16, 4096])
def test_batches_equal_a_plain_pass(spark, rows):
    rng = random.Random(rows)
    boxes = [(c, s := rng.randrange(3000), s + rng.randint(1, 150), i) for i, c in enumerate([0] * 90 + [1] * 5 + [2])]
    table = spark.createDataFrame([(i, s, e, [c]) for c, s, e, i in boxes] + [(900, 5, 2000, [0]), (901, 5, 9, [0, 1])], "container_id bigint, start bigint, end bigint, chrs array<bigint>")
    for most, span in ((4, 200), (7, 10_000), (100, 400), (1, 500)):
        got = {(r.chr, r.batch): r.container_ids for r in candidates.batches(table, most, span, rows).collect()}
        wanted = {(c, b): ids for c in range(3) for b, ids in enumerate(plain_batches([(s, e, i) for x, s, e, i in [*boxes, (0, 5, 2000, 900)] if x == c and e - s <= span], most, span))}
        assert {k: v for k, v in got.items() if k[1] >= 0} == wanted
        alone = {k: v for k, v in got.items() if k[1] < 0}
        assert alone == {(0, -902): [901], **({(0, -901): [900]} if 1995 > span else {})}


def test_no_task_holds_more_than_a_tile(spark, monkeypatch):
    seen = []
    plain = scans.followers
    monkeypatch.setattr(scans, "followers", lambda starts, *a: (seen.append(len(starts)), plain(starts, *a))[1])
    starts = np.arange(500)
    assert plain(starts, starts + 1, 4, 100).tolist() == (starts + 4).tolist()
    # Followers of a tile need the rows of a batch past it, whatever the key's size.
    rows = spark.range(5000).selectExpr("0L AS chr", "id AS start", "id + 1 AS `end`")
    tiled = scans.in_tiles(rows, ("chr",), ("start",), 256)
    assert tiled.groupBy("_tile").count().agg({"count": "max"}).first()[0] == 256
    assert scans.batch_starts(tiled, ("chr",), 10, 100, 256).where("_first").count() == 500


def test_empty_tables(spark):
    none = spark.createDataFrame([], "region_id bigint, chr bigint, start bigint, end bigint, coverage bigint")
    assert coverage.copy_numbers(none, 30.0).collect() == []
    assert candidates.batches(spark.createDataFrame([], "container_id bigint, start bigint, end bigint, chrs array<bigint>")).collect() == []


def test_gathered_sums_equal_rows():
    rng = random.Random(5)
    rows = lambda n: [(rng.choice([0, 1, 1, 3]), rng.choice([40, 120, 130, 135, 300]), rng.randrange(6)) for _ in range(n)]
    for _ in range(400):
        a, b, c = (rows(rng.randint(1, 9)) for _ in range(3))
        one, two, three = (candidates.Gathered(*map(list, zip(*x))) for x in (a, b, c))
        assert one.like(two) == candidates.similar_sizes(a, b)
        one.join(two)
        small = [s for t, s, _ in a + b if t <= 1]
        assert one.middle() == (float(np.median(small)) if small else 0.0) and one.like(three) == candidates.similar_sizes(a + b, c)


def test_many_tiles_share_a_python_batch(spark):
    tiled = spark.range(27_000).selectExpr("id div 9 AS k", "id % 9 AS _row", "id % 9 div 3 AS _tile", "id AS v")
    sums = scans.of_tiles(tiled, ("k",), lambda pdf: [int(pdf["v"].sum())], "array<bigint>")
    enters = scans.entering(sums, ("k",), lambda state, value: state + int(value[0]), 0, "bigint")
    out = scans.worked(tiled, enters, ("k",), lambda rows, state: rows[["k", "v"]].assign(before=state["state"] + rows["v"].cumsum()), "k bigint, v bigint, before bigint")
    for df in (sums, enters, out):  # a call for each tile was too slow
        assert "FlatMap" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.v, r.before) for r in out.collect()} == {(v, sum(range(v // 9 * 9, v + 1))) for v in range(27_000)}


def test_a_tile_stays_whole_where_its_join_turns_into_a_broadcast(spark):
    """A join planned by merging takes the rows' deal over; what it turns into does not deal."""
    tiled = cut(spark.range(0, 2000, 1, 8).selectExpr("id % 4 AS k", "id % 20 div 4 * 100 + id div 20 AS _row", "id % 20 div 4 AS _tile"))
    states = cut(tiled.groupBy("k", "_tile").agg({"*": "count"}).withColumnRenamed("count(1)", "state"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    for name, value in zip(names, ("-1", "10MB", "false")):
        spark.conf.set(name, value)
    try:
        out = scans.worked(tiled, states, ("k",), lambda rows, state: pd.DataFrame({"n": [len(rows)], "state": [state["state"]], "first": [rows["_row"].iloc[0] % 100]}), "n bigint, state bigint, first bigint")
        assert [tuple(r) for r in out.collect()] == [(100, 100, 0)] * 20
    finally:
        for name in names:
            spark.conf.unset(name)
