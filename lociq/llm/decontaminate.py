"""Benchmark decontamination: edit distance through random-walk embeddings.

A benchmark item of n words is leaked by a document that has a window of n words (or,
being shorter, is such a window itself) within `EDITS` of n edits of the item, words
being lower-cased runs of letters and digits. The random-walk (CGK) embedding writes a window
out as 2n symbols, stepping to the next word or staying by random bits that depend on the
step and the word: few edits become few differing places. Each of several walks is sampled
at a few places a table, all below 2n, where the walk still moves; windows that share a
table's samples with an item of the same length are compared with it by exact edit
distance. `WALKS` and `TABLES` are set so that at the largest distance still asked for
more than 0.95 of the leaks share a sample, which a test holds for each length of 8 to 60
words; nearer ones do so more surely, and exact copies always.

Before embedding, windows too poor in words of the benchmark are passed over: a window
within e edits shares n - e words with its item, and at least j of the item's e + j rarest
words, so none that qualifies is lost.

The benchmark is a stated query set: it is taken in blocks of at most `BLOCK_ITEMS` items
and `BLOCK_BYTES` characters, each carried to all documents; a larger benchmark makes
more passes, not larger tasks. Where there are several, a block's leaks are written and
its items let go before the next is read, so driver and tasks hold one block at a time.

Items of fewer than `WALK_WORDS` words allow one edit, or below five words none. They take
no walk: their key is all their words, or, once for each place, all but the word at that
place, so whatever lies within an edit shares a key and nothing is left to chance.

Null text is empty text. An item without words is found nowhere; one of a word or two is
found wherever its words stand, which is for the benchmark's owner to want. Repeated items
are found each, repeated documents are reported once for each row. Empty tables give no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import Scratch, keyed, text_or_empty

WORD = re.compile(r"[^\W_]+")
WALK_WORDS, EDITS = 8, 0.2
WALKS, TABLES, SAMPLES = 16, 16, 3
#: Windows whose walks are held at once.
STEP_WINDOWS = 1024
#: Of an item's rarest words beyond its allowed edits, those that a window must show.
RARE = 4
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16_000_000


class Vocabulary(dict):
    """Numbers the benchmark's words from 1; any other word is 0."""

    def __missing__(self, word: str) -> int:
        return 0


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def edits(item: np.ndarray, window: np.ndarray, most: int) -> int:
    """Exact Levenshtein distance over word numbers, bit-parallel; word 0 equals nothing."""
    n = len(item)
    at: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        at[w] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    for w in window.tolist():
        eq = at.get(w, 0) if w else 0
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(zero | plus)), plus & zero
        score += bool(up & top) - bool(down & top)
        up = ((up << 1) | 1) & full
        plus, minus = (down << 1) & full | (full & ~(zero | up)), up & zero
    return score


class Walks:
    """The walks and sampled places for windows of n words; the same in every task.

    A walk takes its n words in about 2n steps, and places are drawn below that. Factors
    have all 64 bits, so that the walk also leaves small numbers and the unknown word 0."""

    def __init__(self, n: int):
        rng = np.random.RandomState(n)
        self.n, self.steps = n, 2 * n
        draw = lambda *shape: rng.randint(0, 2**64, shape, dtype=np.uint64) | np.uint64(1)
        self.factors, self.mixers, self.salts = draw(self.steps, WALKS, 1), draw(SAMPLES), draw(WALKS, TABLES, 1)
        self.places = np.array([[rng.choice(self.steps, SAMPLES, replace=False) for _ in range(TABLES)] for _ in range(WALKS)])

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(WALKS * TABLES, windows) sample keys of an array of windows of word numbers; 0
        where a sample shows unknown words or the end only, which is a key of nothing."""
        m, n = windows.shape
        padded = np.concatenate([windows, np.zeros((m, 1), windows.dtype)], axis=1).astype(np.uint32).ravel()
        row = np.arange(m) * (n + 1)
        at, symbols = np.tile(row, (WALKS, 1)), np.empty((self.steps, WALKS, m), np.uint32)
        for step in range(self.steps):
            symbol = symbols[step] = padded[at]
            bit = ((symbol.astype(np.uint64) + np.uint64(1)) * self.factors[step]) >> np.uint64(63)
            at = np.minimum(at + bit.astype(np.int64), row + n)
        key, shows = np.tile(self.salts, (1, 1, m)), np.zeros((WALKS, TABLES, m), dtype=bool)
        for k in range(SAMPLES):
            symbol = symbols[self.places[:, :, k], np.arange(WALKS)[:, None]]
            shows |= symbol > 0
            key = (key ^ symbol) * self.mixers[k]
            key ^= key >> np.uint64(29)
        return np.where(shows, key, np.uint64(0)).reshape(WALKS * TABLES, m)


class Places:
    """Keys of short windows of n words: of all of them, or of all but one, for each place.
    A place's number is no part of its key, so a window that lacks a word has it as well."""

    def __init__(self, n: int):
        self.n, self.most = n, int(EDITS * n)
        self.factors = np.random.RandomState(n).randint(0, 2**64, 2, dtype=np.uint64) | np.uint64(1)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        rows = []
        for out in range(self.n) if self.most else (self.n,):
            key = np.full(len(windows), self.factors[0])
            for place in range(self.n):
                if place != out:
                    key = (key ^ windows[:, place].astype(np.uint64)) * self.factors[1]
                    key ^= key >> np.uint64(29)
            rows.append(np.maximum(key, np.uint64(1)))
        return np.stack(rows)


class Keys:
    """The sample keys of items of one length, sorted, with a bit map that passes over most
    keys of other windows."""

    def __init__(self, walks: Walks | Places, items: np.ndarray):
        parts = [walks.keys(items[at : at + STEP_WINDOWS]) for at in range(0, len(items), STEP_WINDOWS)]
        keys = np.concatenate(parts, axis=1)
        item = np.broadcast_to(np.arange(len(items), dtype=np.int32), keys.shape)[keys > 0]
        keys = keys[keys > 0]
        order = np.argsort(keys)
        self.keys, self.item = keys[order], item[order]
        self.mask = np.uint64((1 << max(16, (8 * len(keys)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, dtype=bool)
        self.bits[keys & self.mask] = True

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Distinct (window, item) that share a key, as two rows."""
        table, window = np.nonzero(self.bits[keys & self.mask])
        key = keys[table, window]
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        count = high - low
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.unique(np.stack([np.repeat(window, count), self.item[np.repeat(low, count) + offset]]), axis=1)


class Index:
    """A block of items, by length: their words, walks and sorted sample keys."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary, by_length = Vocabulary(), defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if words:
                for w in words:
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                by_length[len(words)].append((item_id, np.array([self.vocabulary[w] for w in words], dtype=np.int32)))
        items_with = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        for own in by_length.values():
            for _, words in own:
                items_with[np.unique(words)] += 1
        spelt = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        for word, i in self.vocabulary.items():
            spelt[i] = len(word)
        self.lengths, self.rare = {}, {}
        for n, own in sorted(by_length.items()):
            self.rare[n] = np.zeros(len(self.vocabulary) + 1, dtype=bool)
            for _, words in own:  # in few items first, then long before short
                rarest = words[np.lexsort((words, -spelt[words], items_with[words]))]
                self.rare[n][rarest[: int(EDITS * n) + min(RARE, n - int(EDITS * n))]] = True
            walks = Walks(n) if n >= WALK_WORDS else Places(n)
            self.lengths[n] = (own, walks, Keys(walks, np.stack([w for _, w in own])))

    def search(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document's place, item_id, first word, item's words, edits), the nearest window
        of each document and item."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        if not sizes.sum():
            return
        longest = max(self.lengths, default=0)
        flat = np.concatenate([*docs, np.zeros(longest, np.int32)])
        owner = np.repeat(np.arange(len(docs)), sizes)
        first = np.cumsum(sizes) - sizes
        last = first + sizes
        rare_at = np.flatnonzero(np.logical_or.reduce(list(self.rare.values()))[flat[: len(owner)]]) if self.rare else np.zeros(0, np.int64)
        known = np.concatenate([[0], np.cumsum(flat > 0, dtype=np.int64)])
        for n in self.lengths:
            most = int(EDITS * n)
            need = min(RARE, n - most)
            shown = rare_at[self.rare[n][flat[rare_at]]]
            if len(shown) < need:
                continue
            # Windows that hold `need` neighbouring rare words, as a union of ranges.
            low, high = shown[need - 1 :] - n + 1, shown[: len(shown) - need + 1]
            near = high >= low
            change = np.zeros(len(owner) + 2, dtype=np.int32)
            np.add.at(change, np.maximum(low[near], 0), 1)
            np.add.at(change, high[near] + 1, -1)
            # A window that would begin before its document is cut short to stand at its beginning.
            starts = np.flatnonzero(np.cumsum(change[: len(owner)]) > 0)
            starts = np.union1d(starts, first[owner[starts]][sizes[owner[starts]] < n])
            # Windows end with their document.
            ends = np.minimum(starts + n, last[owner[starts]])
            whole = (ends - starts == n) | ((starts == first[owner[starts]]) & (ends - starts >= n - most))
            starts, ends = starts[whole], ends[whole]
            enough = known[ends] - known[starts] >= n - most
            starts, ends = starts[enough], ends[enough]
            for at in range(0, len(starts), STEP_WINDOWS):
                yield from self._compare(flat, owner, first, starts[at : at + STEP_WINDOWS], ends[at : at + STEP_WINDOWS], n, most)

    def _compare(self, flat, owner, first, starts, ends, n, most):
        own, walks, keys = self.lengths[n]
        places = starts[:, None] + np.arange(n)
        windows = np.where(places < ends[:, None], flat[np.minimum(places, len(flat) - 1)], 0)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        found = keys.pairs(walks.keys(windows))
        for i in np.unique(found[1]).tolist():
            at = found[0][found[1] == i]
            # A window within the allowed edits shares so many words with the item at least.
            for w in at[np.isin(windows[at], own[i][1]).sum(axis=1) >= n - most].tolist():
                start = int(starts[w])
                distance = edits(own[i][1], flat[start : ends[w]], most)
                if distance <= most:
                    key = int(owner[start]), i
                    best[key] = min(best.get(key, (n + 1, 0)), (distance, start))
        for (doc, i), (distance, start) in best.items():
            yield doc, own[i][0], start - int(first[doc]), n, distance


_LAST: dict[str, Index] = {}


def index_of(name: str, items: list[tuple[int, str]]) -> Index:
    """The index of a block, made once in each Python worker; one block is kept."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Index(items)
    return _LAST[name]


def n_blocks(benchmark: DataFrame, text_col: str) -> int:
    """How many blocks of bounded number and size the items make; an item longer than a
    block's size is a block of its own."""
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length(text_or_empty(text_col))), F.lit(0))).first()
    return max(1, -(-n // BLOCK_ITEMS) * 2 if n > BLOCK_ITEMS else 1, -(-size // BLOCK_BYTES) * 2 if size > BLOCK_BYTES else 1)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, parts: int) -> Iterator[list[tuple[int, str]]]:
    """The items, block by block."""
    items = benchmark.select(F.col(item_col).alias("item"), text_or_empty(text_col).alias("text"))
    for part in range(parts):
        found = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else items
        yield [(r.item, r.text) for r in found.toLocalIterator()]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and leaked item: first_word, item_words, edits, similarity."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("t"))
    schema = f"{id_col} {kinds[0]}, {item_col} {kinds[1]}, first_word bigint, item_words bigint, edits bigint, similarity double"
    parts, scratch = n_blocks(benchmark, item_text_col), Scratch(docs.sparkSession)
    out = None
    for items in blocks(benchmark, item_col, item_text_col, parts):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame], shared=shared, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            index = index_of(name, shared.value)
            for batch in batches:
                ids = list(batch["k"])
                found = [np.array(list(map(index.vocabulary.__getitem__, words_of(t))), dtype=np.int32) for t in batch["t"]]
                best: dict[tuple, tuple] = {}
                for place, item, start, n, distance in index.search(found):
                    key = place, item
                    best[key] = min(best.get(key, (n + 1, 0, n)), (distance, start, n))
                rows = [(ids[place], item, start, n, distance, 1 - distance / n) for (place, item), (distance, start, n) in best.items()]
                yield pd.DataFrame(rows, columns=[id_col, item_col, "first_word", "item_words", "edits", "similarity"])

        part = texts.mapInPandas(run, schema)
        if parts > 1:
            part = scratch.cut(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that leak an item, whatever their ids."""
    rows = keyed(docs)
    found = leaks(rows, benchmark, "row_key", text_col).select("row_key").distinct()
    return rows.join(found, "row_key", "left_anti").select(*docs.columns)
