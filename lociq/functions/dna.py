"""Column functions on sequences and CIGAR strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def reverse_complement(s: Column | str) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


TURNED = str.maketrans("ACGTacgt", "TGCAtgca")


def turned(seq: str) -> str:
    """reverse_complement of one sequence."""
    return seq.translate(TURNED)[::-1]


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def gc_fraction(s: Column | str) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, "[^GCgc]", "")) / F.length(s))


#: Words of a batch that a task gives out.
WORDS = 1 << 16


def sources(df: DataFrame, id_col: str, seq_col: str, k: int = 9) -> DataFrame:
    """(id, seqs): the bytes of each id's sequences that hold a word, a row an id. Words are
    counted where their sequences lie; what is shuffled is a byte a base, not a row a word."""
    return df.where(F.length(seq_col) >= k).groupBy(id_col).agg(F.collect_list(F.col(seq_col).cast("binary")).alias("seqs"))


COMPLEMENT = np.arange(0x110000, dtype=np.uint32)
for _a, _b in zip("ACGTacgt", "TGCAtgca"):
    COMPLEMENT[ord(_a)] = ord(_b)


def words_of(seqs: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, n, letters): the canonical k-mers of one id's sequences, as whole numbers whose
    digits are places among the letters (code points), and how often each comes. They go up as the words do."""
    points = [np.frombuffer(s, np.uint8) if s.isascii() else np.frombuffer(s.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for s in seqs]
    held = np.unique(np.concatenate([np.unique(p) for p in points]).astype(np.uint32))
    letters = np.unique(np.concatenate([held, COMPLEMENT[held]]))
    digits = np.zeros(int(letters[-1]) + 1, np.int64 if len(letters) ** k < 1 << 62 else object)
    digits[letters] = np.arange(len(letters))
    other = digits[COMPLEMENT[letters]]
    found = []
    for p in points:
        n = max(0, len(p) - k + 1)
        own = digits[p]
        ahead, turned = (np.zeros(n, digits.dtype) for _ in range(2))
        for j in range(k):
            piece = own[j : j + n]
            ahead, turned = ahead * len(letters) + piece, turned * len(letters) + other[piece.astype(np.int64)]
        found.append(np.minimum(ahead, turned))
    return *np.unique(np.concatenate(found), return_counts=True), letters


def spelt(words: np.ndarray, letters: np.ndarray, k: int) -> pa.Array:
    """The words as strings."""
    places, rest = np.zeros((len(words), k), np.int64), words
    for j in range(k - 1, -1, -1):
        places[:, j], rest = rest % len(letters), rest // len(letters)
    points = letters[places]
    if letters[-1] < 128:
        return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.arange(0, (len(words) + 1) * k, k, dtype=np.int32)), pa.py_buffer(points.astype(np.uint8).tobytes()))
    return pa.array([row.tobytes().decode("utf-32-le") for row in points.astype(np.uint32)], pa.string())


def kmer_counts(df: DataFrame, id_col: str, seq_col: str, k: int = 9) -> DataFrame:
    """(id, kmer, n): canonical k-mers, the lesser of a word and its complement."""
    rows = sources(df, id_col, seq_col, k)

    def run(batches):
        for batch in batches:
            ids, out, held = batch.column(id_col), [], 0
            for i in range(len(batch)):
                words, n, letters = words_of(batch.column("seqs")[i].as_py(), k)
                for at in range(0, len(words), WORDS):
                    some = words[at : at + WORDS]
                    out.append((np.full(len(some), i), spelt(some, letters, k), n[at : at + WORDS]))
                    held += len(some)
                if out and (held >= WORDS or i == len(batch) - 1):
                    of, kmers, n_ = zip(*out)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(of))), pa.concat_arrays(kmers), pa.array(np.concatenate(n_))], [id_col, "kmer", "n"])
                    out, held = [], 0

    return rows.mapInArrow(run, StructType([rows.schema[id_col], StructField("kmer", StringType()), StructField("n", LongType())]))


def shared_share(a: list, b: list, k: int) -> float:
    """Shared k-mers over the k-mers of the side with fewer distinct ones, the first in a tie."""
    (x, n, of_x), (y, m, of_y) = words_of(a, k), words_of(b, k)
    if not np.array_equal(of_x, of_y):  # letters differ: by their spelling
        x, y = (np.array(spelt(*side, k).to_pylist(), dtype=object) for side in ((x, of_x), (y, of_y)))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum()) / int(n.sum() if len(x) <= len(y) else m.sum())


def kmer_similarity(counts: DataFrame, pairs: DataFrame, id_col: str, k: int = 9) -> DataFrame:
    """(a, b, similarity): shared k-mers over the k-mers of the side with fewer distinct
    ones, the first in a tie (A14). Pairs with an empty side are 0. counts: the `sources` of
    the ids; a pair's two are counted where they meet."""
    side = lambda name: counts.select(F.col(id_col).alias(name), F.col("seqs").alias(f"seqs_{name}"))
    met = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "seqs_a", "seqs_b")
    kinds = pairs.select("a", "b").schema

    def run(batches):
        for batch in batches:
            a, b = batch.column("seqs_a"), batch.column("seqs_b")
            share = [shared_share(x.as_py(), y.as_py(), k) if x.is_valid and y.is_valid else 0.0 for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share, pa.float64())], ["a", "b", "similarity"])

    return met.mapInArrow(run, StructType([*kinds, StructField("similarity", DoubleType())]))


def once(column: Column) -> Column:
    """A column that is worked out once a row, as the only element of an exploded array:
    filters on what is made from it are not pushed past it, with its text put into them."""
    return F.explode(F.array(column))


#: CIGAR operations that use up bases of the read and of the reference (fixed values).
ON_READ, ON_REFERENCE, CLIPS = ("M", "I", "=", "X"), ("M", "D", "N", "=", "X"), ("S", "H")


def named(value: str, name: str, body: str) -> str:
    """SQL for body, in which name stands for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Elements up to which sums are folded in one go.
SHORT = 32


def running(values: str, element: str) -> str:
    """SQL for the sums before each element of a named array of bigint. Long ones in blocks
    of the square root of their length, so that no prefix is copied more often than that."""
    step = f"cast(sqrt(size({values})) AS int)"
    fold = "aggregate({0}, named_struct('p', {1}, 'a', cast(array() AS array<bigint>)), ({2}, v) -> named_struct('p', {2}.p + v, 'a', concat({2}.a, array({2}.p))), {2} -> {2}.a)"
    parts = f"transform(sequence(0, cast((size({values}) - 1) / {step} AS int)), j{element} -> slice({values}, j{element} * {step} + 1, {step}))"
    sums = f"transform(g{element}, c{element} -> aggregate(c{element}, 0L, (s, v) -> s + v))"
    blocks = named(parts, f"g{element}", f"flatten(zip_with(g{element}, {fold.format(sums, '0L', 't' + element)}, (c, o) -> {fold.format('c', 'o', 'u' + element)}))")
    return f"CASE WHEN size({values}) > {SHORT} THEN {blocks} ELSE {fold.format(values, '0L', 'w' + element)} END"


def cigar_blocks(cigar: str = "cigar", ref_start: str = "pos") -> Column:
    """The CIGAR as an array of (op, len, read_start, read_end, ref_start, ref_end), places
    counted from the alignment's first base, clips included on the read (P01). Places are
    sums of the lengths before, taken in blocks, so a long read's CIGAR is no square."""
    words = f"regexp_extract_all({cigar}, '[0-9]+[MIDNSHP=X]', 0)"
    blocks = f"transform({words}, x -> struct(right(x, 1) AS op, cast(left(x, length(x) - 1) AS bigint) AS len))"
    spent = lambda kinds, x: f"if({x}.op IN ({kinds}), {x}.len, 0L)"
    on_read, on_ref = "'M','I','=','X','S','H'", "'M','D','N','=','X'"
    q, r = (f"transform(bl, p -> {spent(k, 'p')})" for k in (on_read, on_ref))
    at = named(blocks, "bl", named(f"struct({q} AS q, {r} AS r)", "d", f"struct(bl, d, {running('d.q', 'q')} AS q, {running('d.r', 'r')} AS r)"))
    start = f"cast({ref_start} AS bigint)"
    one = f"struct(b.op AS op, b.len AS len, x.q[i] AS read_start, x.q[i] + x.d.q[i] AS read_end, {start} + x.r[i] AS ref_start, {start} + x.r[i] + x.d.r[i] AS ref_end)"
    return F.expr(named(at, "x", f"transform(x.bl, (b, i) -> {one})"))


def case_runs(seq: str) -> tuple[Column, Column]:
    """Lengths of the upper-case (core) and lower-case (padding) runs."""
    lengths = lambda p: F.transform(F.regexp_extract_all(F.col(seq), F.lit(p), F.lit(0)), F.length)
    return lengths("[A-Z]+"), lengths("[a-z]+")
