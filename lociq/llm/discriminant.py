"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each whole text gives a short vector of transformed statistics. Class means and
covariances come from sums over all labelled training rows, added up by Spark; every
covariance is shrunk towards the pooled one and that towards its diagonal. A score is
the logistic of the two classes' log-density difference, each density through the
Mahalanobis distance with an inverse Cholesky factor that is computed once.

Labels are learnt only where crc32(id as text) mod 4 is not 2. Language, source, id and
labels are never inputs of a score. Null text is empty text and is scored like any other.
Repeated rows are scored each; repeated labels count each. Null labels are not learnt
from. Without examples of both classes the score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import cut, text_or_empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Frequent words of the languages at hand (fixed values).
COMMON = frozenset(
    "the of and to in a is that for it was on as with be by at this are or from an "
    "der die das und zu den mit von für auf ist im dem nicht ein eine des sich auch "
    "de la le et les en un une du que est pour qui dans par au sur pas avec el y los se del las por con no su lo".split()
)
NAMES = ("words", "word_length", "symbols", "capitals", "digits", "stops", "common", "distinct", "same_lines", "repeats", "no_letter", "line_words", "beyond_ascii", "longest")
#: Weight of the pooled covariance in each class's, and of the diagonal in the pooled.
TO_POOLED, TO_DIAGONAL = 0.15, 0.1
THRESHOLD = 0.7

CAPITALS, DIGITS, STOPS, SYMBOLS = (re.compile(p) for p in ("[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+", r"[#*$%&|<>=_{}\[\]\\/@^~+]+"))


def count(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; shares go through a square root, counts
    and lengths through a logarithm."""
    words = WORD.findall(text)
    n, chars = len(words), max(1, sum(map(len, words)))
    lines = [s for s in text.split("\n") if not s.isspace() and s]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = sum(c for c in windows.values() if c > 1)
    share = lambda a, b: (a / b) ** 0.5 if b else 0.0
    lower = [w.lower() for w in words]
    return [
        np.log1p(n),
        np.log1p(chars / max(1, n)),
        share(count(SYMBOLS, text), chars),
        share(count(CAPITALS, text), chars),
        share(count(DIGITS, text), chars),
        share(count(STOPS, text), chars),
        share(sum(w.strip(".,;:!?") in COMMON for w in lower), n),
        share(len(set(lower)), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(repeated, max(1, n - 2)),
        share(sum(not any(map(str.isalpha, w)) for w in words), n),
        np.log1p(n / max(1, len(lines))),
        share(0 if text.isascii() else sum(c > "\x7f" for c in text), chars),
        np.log1p(max(map(len, words), default=0)),
    ]


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"k": batch["k"], "x": [statistics(t) for t in batch["t"]]})

    return docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("t")).mapInPandas(run, f"k {kind}, x array<double>")


def held_out(col: str):
    return F.crc32(F.col(col).cast("string")) % 4 == 2


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of squares by class y of the vectors x, summed in tasks and then
    by a small aggregation; what reaches the driver depends on the number of statistics."""
    d = len(NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for batch in batches:
            for y, part in batch.groupby("y"):
                x = np.stack(part["x"].to_numpy())
                total[int(y)] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        for y, v in total.items():
            if v[0]:
                yield pd.DataFrame({"y": y, "i": np.arange(len(v)), "v": v})

    sums = rows.select("y", "x").mapInPandas(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for y in {r.y for r in sums}:
        v = np.zeros(1 + d + d * d)
        for r in sums:
            if r.y == y:
                v[r.i] = r.v
        out[y] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


class Discriminant:
    """Two Gaussians, kept as mean, inverse Cholesky factor and log-normaliser."""

    def __init__(self, found: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        sizes = {y: n for y, (n, _, _) in found.items()}
        total = sum(sizes.values())
        self.share = (sizes.get(1, 0) + 1) / (total + 2)
        self.parts = {}
        if len(found) < 2:
            return
        means = {y: s / n for y, (n, s, _) in found.items()}
        scatter = {y: q - n * np.outer(means[y], means[y]) for y, (n, _, q) in found.items()}
        pooled = sum(scatter.values()) / total
        floor = np.diag(np.full(len(NAMES), 1e-4))
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + floor
        for y, n in sizes.items():
            own = n / (n + len(NAMES)) * (1 - TO_POOLED)  # few examples lean on the pooled
            factor = np.linalg.cholesky(own * scatter[y] / n + (1 - own) * pooled)
            self.parts[y] = (means[y], np.linalg.inv(factor), np.log(n / total) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        log = {y: c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for y, (m, f, c) in self.parts.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """A row per document: held_out, score, predicted."""
    seen = cut(features(docs, id_col, text_col))
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    model = Discriminant(moments(seen.join(known, "k")))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, len(NAMES)))
            yield pd.DataFrame({"k": batch["k"], "score": model.score(x)})

    scored = seen.mapInPandas(run, f"k {kind}, score double")
    return scored.select(F.col("k").alias(id_col), F.coalesce(held_out("k"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
