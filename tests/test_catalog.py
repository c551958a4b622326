"""Every query against its SQL at the smallest scale; kernels against plain versions."""

import math

import duckdb
import numpy as np
import pytest

from lociq.plans import catalog
from lociq.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, (bool, np.bool_, str)):
            return str(v)
        return repr(round(float(v), 5))

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, other, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), other.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def by_chromosome(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["start"], r["end"], r["signal_id"])):
        out.setdefault(r["chr"], []).append(r)
    return out.values()


def folded_gap(a, b):
    gap = max(0, b["start"] - a["end"])
    return gap // 10 if a["repeat_id"] >= 0 and a["repeat_id"] == b["repeat_id"] else gap


def test_signal_strength_equals_a_plain_scan(spark):
    """Each window looked up anew over the whole chromosome, pair by pair."""
    wanted = {}
    for rows in by_chromosome([r.asDict() for r in catalog.strength_input(spark, SF).collect()]):
        i = left = right = 0
        while i < len(rows):
            while left < i and folded_gap(rows[left], rows[i]) > 1000:
                left += 1
            right = max(right, i)
            while right + 1 < len(rows) and folded_gap(rows[i], rows[right + 1]) <= 1000:
                right += 1
            if right - left + 1 > 200:
                for r in rows[left : right + 1]:
                    wanted[r["signal_id"]] = 10.0
                i = right + 1
                continue
            own, total = rows[i], 0.0
            for k in range(left, right + 1):
                other = rows[k]
                d = folded_gap(*((other, own) if k < i else (own, other)))
                if other["read_id"] == own["read_id"] or other["sv_type"] != own["sv_type"] or d > 1000:
                    continue
                shared = own["repeat_id"] >= 0 and own["repeat_id"] == other["repeat_id"]
                small, diff = min(own["size"], other["size"]), abs(own["size"] - other["size"])
                alike = 0.0 if own["sv_type"] >= 3 or diff > 0.1 * small else 1.0 if diff < 0.01 * small else 0.01 * small / (100 * diff)
                if not (own["sv_type"] >= 3 and d > (500 if shared else 100)):
                    total += 1.0 if d <= 0 else max(30 / (d + 30), alike)
            wanted[own["signal_id"]] = total
            i += 1
    found = {r.signal_id: r.strength for r in catalog.QUERIES["signal_strength"](spark, SF).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-5 for k in found)


def test_folded_regions_equal_a_plain_fold(spark):
    """The fold over whole chromosomes, with sizes compared by the textbook formula."""
    from statistics import mean, median, variance

    from lociq.operators import candidates, intervals
    from lociq.plans.views import view

    found = candidates.numbered(candidates.regions(view(spark, SF, "v_signal"))).selectExpr("region_id", "chr", "start AS r_start", "`end` AS r_end")
    rows = [r.asDict() for r in intervals.range_join(view(spark, SF, "v_signal"), found, points=True).collect()]
    regions = {}
    for r in rows:
        regions.setdefault((r["chr"], r["region_id"]), []).append(r)

    def effect(x, y):
        n, m = len(x), len(y)
        v = ((n - 1) * (variance(x) if n > 1 else 0) + (m - 1) * (variance(y) if m > 1 else 0)) / (n + m - 2) if n + m > 2 else 0
        return (0.0 if mean(x) == mean(y) else math.inf) if v == 0 else abs(mean(x) - mean(y)) / math.sqrt(v)

    def alike(a, b):
        lacking, best = 0, math.inf
        for kind in (1, 0):
            x, y = ([r["size"] for r in side if r["sv_type"] == kind and r["size"] >= 100] for side in (a, b))
            lacking += any(len(z) < 0.2 * len({r["read_id"] for r in side}) for z, side in ((x, a), (y, b)))
            best = min(best, effect(x, y) if x and y else 0.5)
        return lacking < 2 and best < 0.5

    middle = lambda side: median([r["size"] for r in side if r["sv_type"] <= 1] or [0])
    wanted = []
    for chr_ in {c for c, _ in regions}:
        now = None
        own = {(min(r["start"] for r in v), max(r["end"] for r in v), k): v for (c, k), v in regions.items() if c == chr_}
        for _, side in sorted(own.items(), key=lambda x: x[0]):
            start, end = min(r["start"] for r in side), max(r["end"] for r in side)
            if now and start - 50 <= now[1] + 50 + min(2 * min(middle(now[2]), middle(side)), 300) and alike(now[2], side):
                now[1], now[2], now[3] = max(now[1], end), now[2] + side, now[3] + 1
            else:
                now = [start, end, side, 1]
                wanted.append((chr_, now))
    out = catalog.QUERIES["folded_regions"](spark, SF).collect()
    assert sorted(tuple(r) for r in out) == sorted((c, max(0, s - 50), e + 50, n) for c, (s, e, _, n) in wanted)


def test_vertical_merge_equals_union_find(spark, other):
    parent = {r.composite_id: r.composite_id for r in catalog.composites(spark, SF).collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in other.sql(catalog.ORACLES["composite_pairs"]).fetchall():
        r, t = sorted((root(a), root(b)))
        parent[t] = r
    assert {r.composite_id: r.merged_id for r in catalog.QUERIES["vertical_merge"](spark, SF).collect()} == {x: root(x) for x in parent}


def test_components_of_all_rows_equal_union_find(spark, other):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in other.sql("SELECT DISTINCT l_suppkey, l_partkey + 1000000000 FROM lineitem").fetchall():
        r, t = sorted((root(a), root(b)))
        parent[t] = r
    assert {r.node: r.component for r in catalog.QUERIES["cr_components_whole"](spark, SF).collect()} == {x: root(x) for x in parent}
