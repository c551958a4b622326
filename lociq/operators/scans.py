"""Scans along an order that go tile by tile.

A sequential kernel whose state is small is a map from the state that enters a tile to the
one that leaves it. Tiles give their maps in parallel; a fold over the maps, a row a tile,
says what enters each; then tiles are worked through again, in parallel, each from its own
state. So the largest task is a tile, or the maps of a key, never a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators.graph import cut
from lociq.operators.intervals import row_numbers

#: Rows of a tile.
ROWS = 1 << 12


def in_tiles(df: DataFrame, keys, order, rows: int = ROWS) -> DataFrame:
    """df with _row, its number within its key, and _tile."""
    return cut(row_numbers(df, keys, order, "_row").withColumn("_tile", F.floor(F.col("_row") / rows).cast("bigint")))


def each_tile(df: DataFrame, keys, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `work(rows in order)` gives for each tile. Rows come sorted, so many tiles share
    a Python batch, and only the tile that a batch ends in waits for the next one.

    Rows are dealt by a struct of the keys, which no join below is dealt by: a deal like a
    join's own is taken for done, and once the join turns into a broadcast while it runs,
    its rows stay where they were read, and a tile in several tasks."""
    by = [*keys, "_tile"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = []
        for batch in batches:
            if not len(batch):
                continue
            rows = pd.concat([*waiting, batch], ignore_index=True)
            edges = [0, *np.flatnonzero((rows[by] != rows[by].shift()).any(axis=1).to_numpy()[1:]) + 1]
            if len(edges) > 1:
                yield pd.concat([work(rows.iloc[i:j]) for i, j in zip(edges, edges[1:])], ignore_index=True)
            waiting = [rows.iloc[edges[-1] :]]
        if waiting:
            yield work(waiting[0])

    return df.repartition(F.struct(*by)).sortWithinPartitions(*by, "_row").mapInPandas(run, schema)


def of_tiles(tiled: DataFrame, keys, work: Callable[[pd.DataFrame], list], kind: str) -> DataFrame:
    """(keys, _tile, value): what `work` says of each tile's rows, in order."""
    kinds, keys = dict(tiled.dtypes), list(keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_tile": [pdf["_tile"].iloc[0]], "value": [work(pdf)]})

    return each_tile(tiled, keys, one, f"{''.join(f'{k} {kinds[k]}, ' for k in keys)}_tile bigint, value {kind}")


def entering(maps: DataFrame, keys, step: Callable, first, kind: str, backwards: bool = False) -> DataFrame:
    """(keys, _tile, state): the state that enters each tile, from the first tile on, or
    from the last one where backwards. step(state, value, first row's value or None) gives
    the state that the tile is left with; first gives the state before any. Rows come
    sorted by keys and tiles, and the state goes along with them."""
    kinds, keys = dict(maps.dtypes), list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            for key, value in zip(zip(*(batch[k] for k in keys)), batch["value"]):
                if key != last:
                    last, state = key, first(value) if callable(first) else first
                out.append(state)
                state = step(state, value)
            yield batch[[*keys, "_tile"]].assign(state=pd.Series(out, index=batch.index, dtype=object))

    tiles = F.col("_tile").desc() if backwards else F.col("_tile")
    return maps.repartition(F.struct(*keys)).sortWithinPartitions(*keys, tiles).mapInPandas(run, f"{''.join(f'{k} {kinds[k]}, ' for k in keys)}_tile bigint, state {kind}")


def worked(tiled: DataFrame, states: DataFrame, keys, work: Callable, schema: str) -> DataFrame:
    """What `work(rows in order, the tile's row of states)` gives for each tile; the columns
    of the states differ from those of the rows."""
    return each_tile(tiled.join(states, [*keys, "_tile"]), keys, lambda rows: work(rows, rows.iloc[0]), schema)


# --- Viterbi over max-plus matrices ---------------------------------------------------

#: Steps of a logarithm: whole numbers add up alike in any order.
FINE = 1 << 40


def whole(logs: np.ndarray) -> np.ndarray:
    return np.round(logs * FINE).astype(np.int64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices where adding is taking the larger and multiplying is adding."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The matrix of a run of rows: best score from each state before them to each state at
    their end. Halves are multiplied level by level, all pairs of a level at once."""
    steps = move[None] + emit[:, None, :]
    while len(steps) > 1:
        even = len(steps) // 2 * 2
        joined = (steps[0:even:2, :, :, None] + steps[1:even:2, None, :, :]).max(axis=2)
        steps = np.concatenate([joined, steps[even:]])
    return steps[0]


def forward(enter: np.ndarray, emit: np.ndarray, move: np.ndarray, start: bool) -> tuple[np.ndarray, np.ndarray]:
    """(scores at the last row, for each row and state the state before it), the lowest in
    a tie. start: nothing comes before, and enter is the score of each state to begin in."""
    back, score = np.zeros(emit.shape, dtype=np.int64), enter
    for t in range(len(emit)):
        if start and t == 0:
            score = enter + emit[0]
            continue
        step = score[:, None] + move
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + emit[t]
    return score, back


def traced(back: np.ndarray, last: int, start: bool) -> np.ndarray:
    """The states of the rows that lead to the last one's, and before them, where there is
    anything before, the state that the first row came from."""
    path = np.zeros(len(back) + 1, dtype=np.int64)
    path[-1] = last
    for t in range(len(back) - 1, -1, -1):
        path[t] = back[t, path[t + 1]] if not (start and t == 0) else path[t + 1]
    return path


def viterbi_states(tiled: DataFrame, keys, emissions: Callable[[pd.DataFrame], np.ndarray], moves: np.ndarray, begin: np.ndarray, schema: str, finish: Callable) -> DataFrame:
    """The most likely states of tiled rows. emissions gives log probabilities of a tile's
    rows by state; finish(rows, states) shapes a tile's result in the schema."""
    move, enter0 = whole(moves), whole(begin)
    states = len(enter0)
    emit = lambda pdf: whole(emissions(pdf))

    def matrix(pdf: pd.DataFrame) -> list:
        e = emit(pdf)
        if pdf["_row"].iloc[0] == 0:  # what the first row's states score, whatever enters
            m = np.broadcast_to(enter0 + e[0], (states, states))
            return (times(m, product(e[1:], move)) if len(e) > 1 else m).ravel().tolist()
        return product(e, move).ravel().tolist()

    def onward(state: list, value) -> list:
        return times(np.array([state]), np.array(value).reshape(states, states))[0].tolist()

    maps = cut(of_tiles(tiled, keys, matrix, "array<bigint>"))
    enters = cut(entering(maps, keys, onward, lambda _: [0] * states, "array<bigint>"))

    def run(pdf: pd.DataFrame, enter) -> tuple[np.ndarray, np.ndarray, bool]:
        start = pdf["_row"].iloc[0] == 0
        return *forward(enter0 if start else np.array(enter), emit(pdf), move, start), start

    kinds = dict(tiled.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in keys) + "_tile bigint, "

    def ways(pdf: pd.DataFrame, state) -> pd.DataFrame:
        score, back, start = run(pdf, state["state"])
        came = [int(traced(back, s, start)[0]) for s in range(states)]
        return pd.DataFrame({**{k: [state[k]] for k in keys}, "_tile": [state["_tile"]], "value": [[int(score.argmax()), *came]]})

    backs = cut(worked(tiled, enters, keys, ways, head + "value array<bigint>"))
    # The last tile ends in its best state, the others where the next one came from.
    lasts = entering(backs, keys, lambda state, value: int(value[1 + state]), lambda value: int(value[0]), "bigint", backwards=True)
    both = cut(enters.join(lasts.withColumnRenamed("state", "last"), [*keys, "_tile"]))

    def decode(pdf: pd.DataFrame, state) -> pd.DataFrame:
        _, back, start = run(pdf, state["state"])
        return finish(pdf, traced(back, int(state["last"]), start)[1:])

    return worked(tiled, both, keys, decode, schema)


# --- greedy packing -------------------------------------------------------------------


def followers(starts: np.ndarray, ends: np.ndarray, most: int, span: int) -> np.ndarray:
    """For each row the row at which the batch that it begins is full: `most` rows later,
    or the first whose end lies past the span, whichever comes first. Rows past the given
    ones are unknown: a row's answer needs the `most` rows after it."""
    n = len(starts)
    reach = np.lib.stride_tricks.sliding_window_view(np.concatenate([ends, np.full(most, np.iinfo(np.int64).min)]), most)[:n]  # of itself and what follows
    past = reach > (starts + span)[:, None]
    past[:, 0] = False
    return np.arange(n) + np.where(past.any(axis=1), past.argmax(axis=1), most)


def batch_starts(tiled: DataFrame, keys, most: int, span: int, rows: int = ROWS) -> DataFrame:
    """tiled (keys, start, end, ...) with _first: whether a row begins a batch. A row's
    follower is at most `most` rows on, so tiles see that many rows of those behind them,
    and a tile's map says for each row that a batch may begin it with, where the first batch
    of the next tile begins."""
    keys = list(keys)
    kinds = dict(tiled.dtypes)
    copies = F.explode(F.sequence(F.greatest(F.floor((F.col("_row") - most) / rows), F.lit(0)).cast("bigint"), F.col("_tile")))
    seen = cut(tiled.select(*keys, "_row", "start", "end", copies.alias("_tile")))
    head = "".join(f"{k} {kinds[k]}, " for k in keys)

    def jumps(pdf: pd.DataFrame) -> tuple[np.ndarray, int]:
        """Followers of the tile's own rows, counted from the tile's first row."""
        follow = followers(pdf["start"].to_numpy(np.int64), pdf["end"].to_numpy(np.int64), most, span)
        return follow, int((pdf["_row"] < (pdf["_tile"].iloc[0] + 1) * rows).sum())

    def exits(pdf: pd.DataFrame) -> list:
        follow, own = jumps(pdf)
        out = follow.copy()
        for i in range(own - 1, -1, -1):
            if follow[i] < own:
                out[i] = out[follow[i]]
        # By rows into the tile, up to where a batch from before can end.
        return [int(x) - rows for x in out[: min(own, most)]]

    maps = cut(of_tiles(seen, keys, exits, "array<bigint>"))

    def onward(state: int, value) -> int:
        return int(value[state]) if state < len(value) and state < rows else state - rows

    enters = entering(maps, keys, onward, 0, "bigint")

    def mark(pdf: pd.DataFrame, state) -> pd.DataFrame:
        follow, own = jumps(pdf)
        first, at = np.zeros(own, dtype=bool), int(state["state"])
        while at < own:
            first[at] = True
            at = int(follow[at])
        return pd.DataFrame({**{k: [state[k]] * own for k in keys}, "_row": pdf["_row"].to_numpy()[:own], "_first": first})

    marks = worked(seen, enters, keys, mark, f"{head}_row bigint, _first boolean")
    return tiled.join(marks, [*keys, "_row"])
