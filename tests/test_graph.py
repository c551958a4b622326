"""Connected components of edges that come twice, turned round, as loops and with nulls."""

from lociq.operators import graph


def test_components_keep_each_edge_once(spark, monkeypatch):
    seen, plain = [], graph.cut

    def watched(df):
        out = plain(df)
        if set(out.columns) == {"a", "b"}:
            seen.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", watched)
    edges = [(1, 2), (2, 1), (2, 3), (2, 3), (7, 7), (9, 8), (None, 5), (4, None)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8} and seen == [4]


def test_crowded_windows_and_parts_of_pairs(spark, monkeypatch):
    """Windows by a walk that looks at every pair; scores alike however many pairs go at a time."""
    import random

    from lociq.operators import candidates

    rng = random.Random(5)
    rows = sorted((at, at + rng.randint(0, 30)) for at in [rng.randrange(40_000) for _ in range(900)] + [rng.randrange(9000, 9900) for _ in range(350)])
    table = [(i, 1, s, e, rng.randrange(40), rng.choice([0, 1, 3]), rng.randint(30, 60), s // 4000 if s % 3 else -1) for i, (s, e) in enumerate(rows)]
    start, end, repeat = ([r[c] for r in table] for c in (2, 3, 7))

    def gap(a, b):
        g = max(0, start[b] - end[a])
        return g // 10 if repeat[a] >= 0 and repeat[a] == repeat[b] else g

    scored, crowded, i, left, right = [], [], 0, 0, 0
    while i < len(table):
        while left < i and gap(left, i) > 1000:
            left += 1
        right = max(right, i)
        while right + 1 < len(table) and gap(i, right + 1) <= 1000:
            right += 1
        if right - left >= 200:
            crowded.append((left, right))
            i = right
        else:
            scored.append((i, left, right))
        i += 1
    assert candidates.windows(start, end, repeat) == (scored, crowded) and scored and crowded
    frame = spark.createDataFrame(table, "signal_id bigint, chr int, start bigint, end bigint, read_id bigint, sv_type int, size bigint, repeat_id bigint")
    got = []
    for pairs in (1 << 20, 50):
        monkeypatch.setattr(candidates, "PAIRS", pairs)
        got.append({r.signal_id: round(r.strength, 9) for r in candidates.windowed_strength(frame).collect()})
    assert got[0] == got[1] and all(got[0][k] == 10.0 for a, b in crowded for k in range(a, b + 1))
