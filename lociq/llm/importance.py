"""Target-distribution importance resampling by an external sort-count.

A document's features are its runs of one to `RUNS` words; each falls on one of `BUCKETS`
buckets. One pass writes the buckets of all features, packed as unsigned 16-bit numbers,
with the documents' offsets, to the shared folder: rows of about `STREAM_FEATURES`
features, one row at least for a document that is longer. Counts come from these streams:
each row's buckets are sorted and run-length encoded, a task adds up its rows' runs, and a
groupBy merges the tasks. A bucket's gain is the logarithm of its share among the target's
features over its share among the corpus's. The streams are then read once more: gains
are gathered by bucket and summed by document with `np.add.reduceat`, so no text is cut
into words twice. Only counts by bucket, as many as buckets, pass the driver.

Weights get Gumbel noise from a digest of the id, and the highest scores are drawn, which
samples without replacement. Scores are whole numbers within the range of logarithms, some
100,000 values at most; ranks are those above a score, from a histogram, and the place
within it by id.

Null text has no words and no features: weight 0. Documents without an id have no score,
take no part in the draw and are not counted for its size. Rows that share an id are drawn
as rows of their own, in the order of their features and weights. An empty benchmark leaves
gains by the corpus's own counts; an empty corpus gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociq.llm.common import Scratch, text_or_empty

BUCKETS, RUNS, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
STREAM_FEATURES = 1 << 20
#: Remembered words of a Python worker.
CACHE_ENTRIES = 200_000
#: Copies of one ranked row that are written out together.
COPIES = 4096
#: Word bytes as they are, A-Z folded, all else a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Checksums(dict):
    """The checksum of a word and a blank after it, which its longer runs go on from."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = zlib.crc32(word + b" ")
        return value


def features(text: str, runs: int, buckets: int, begun: dict) -> tuple[int, np.ndarray]:
    """(words, buckets of all runs of words)."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    crc, found = zlib.crc32, list(map(zlib.crc32, words))
    before = list(map(begun.__getitem__, words))
    for k in range(1, min(runs, len(words))):
        found += map(crc, words[k:], before)
        before = [crc(b" ", crc(w, p)) for w, p in zip(words[k:], before)] if k + 1 < runs else before
    return len(words), (np.array(found, dtype=np.uint32) % np.uint32(buckets)).astype("<u2")


def streams(texts: DataFrame, kind: str, runs: int, buckets: int, size: int = STREAM_FEATURES) -> DataFrame:
    """(ids, words, offsets, packed): documents' buckets as packed streams. offsets has
    the places in the stream where documents begin, and its end."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be numbers of 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, ids, words, parts, held, of_ids = Checksums(), [], [], [], 0, None

        def row() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
            columns = [pa.array([ids], pa.list_(of_ids)), pa.array([words], pa.list_(pa.int64())), pa.array([offsets]), pa.array([np.concatenate(parts).tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "words", "offsets", "packed"])

        for batch in batches:
            of_ids = batch.column("k").type
            for key, text in zip(batch.column("k"), batch.column("t")):
                n, own = features(text.as_py(), runs, buckets, begun)
                if ids and held + len(own) > size:
                    yield row()
                    ids, words, parts, held = [], [], [], 0
                ids.append(key.as_py())
                words.append(n)
                parts.append(own)
                held += len(own)
        if ids:
            yield row()

    return texts.mapInArrow(run, f"ids array<{kind}>, words array<bigint>, offsets array<bigint>, packed binary")


def counted(streams: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: each stream is sorted and run-length encoded, tasks add up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for packed in batch["packed"]:
                ordered = np.sort(np.frombuffer(packed, dtype="<u2"), kind="stable")
                if len(ordered):
                    begins = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
                    total[ordered[begins]] += np.diff(begins, append=len(ordered))
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    out = np.zeros(buckets, dtype=np.int64)
    for r in streams.select("packed").mapInPandas(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain, from its counts and all counts, smoothed by one each."""
    n, all_s, all_t = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * all_s / ((float(corpus[b]) + 1) * all_t))) for b in range(n)], dtype=np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise in thousandths, from a digest of the id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(streams: DataFrame, gain: np.ndarray, kind: str, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), read off the streams."""
    shared = streams.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, words, offsets = (batch.column(c)[row].values for c in ("ids", "words", "offsets"))
                at = offsets.to_numpy()
                n = np.diff(at)
                own = gain[np.frombuffer(batch.column("packed")[row].as_buffer(), dtype="<u2")]
                weight, held = np.zeros(len(n), dtype=np.int64), n > 0
                if held.any():
                    weight[held] = np.add.reduceat(own, at[:-1][held]) // n[held]
                score = [None if i is None else int(w) + noise(i, seed) for i, w in zip(ids.to_pylist(), weight)]
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return streams.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """rows with the rank of those that are drawn."""
    shown = ["doc_id", "n_features", "weight", "score"]
    may = rows.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    scores = may.groupBy("score").agg(F.count("*").alias("n"))
    drawn = F.expr(f"cast({percent} * sum(n) OVER () AS bigint) div 100")
    # Scores are few (see above), so one window and a broadcast hold all that are drawn from.
    above = scores.select("score", (F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("above"), drawn.alias("drawn")).where("above < drawn")
    same = may.groupBy(*shown).agg(F.count("*").alias("copies")).join(F.broadcast(above), "score")
    within = W.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(W.unboundedPreceding, 0)
    placed = same.withColumn("first", F.col("above") + F.sum("copies").over(within) - F.col("copies"))
    # Rows alike in all that is shown stand as one so far; many copies are dealt out by parts.
    parts = placed.withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    parts = parts.repartition("score", "doc_id", "part")
    numbers = F.explode(F.expr(f"sequence(part * {COPIES} + 1, least(copies, (part + 1) * {COPIES}))"))
    chosen = parts.select(*shown, "first", "drawn", numbers.alias("number")).withColumn("rank", F.col("first") + F.col("number"))
    chosen = chosen.select(*shown, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))
    low = above.agg(F.min("score")).first()[0]
    none = (F.col("n_words") < least_words) | F.col("score").isNull()
    rest = rows if low is None else rows.where(none | (F.col("score") < low))
    return chosen.unionByName(rest.select(*shown, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """A row per document: n_features, weight, score, and rank where it is drawn."""
    scratch, kind = Scratch(docs.sparkSession), docs.schema[id_col].dataType.simpleString()
    packed = scratch.cut(streams(docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("t")), kind, runs, buckets))
    wanted = scratch.cut(streams(target.select(F.lit(0).cast("bigint").alias("k"), text_or_empty(target_col).alias("t")), "bigint", runs, buckets))
    gain = gains(counted(packed, buckets), counted(wanted, buckets))
    rows = scratch.cut(weighed(packed, gain, kind, seed))
    scratch.drop(rows)
    return ranked(rows, least_words, percent).withColumnRenamed("doc_id", id_col)
