"""Quality rules by distribution: how far a document's letters and common words lie from
its language, with DataFrame functions only.

Each document gives two histograms, of character classes and of its language's common
words. The reference of a language is the sum of these histograms over all documents of
that language; the distance is Jensen-Shannon's, the square root of the divergence in
bits. Short documents have noisy histograms, so each rule has a least length, and
documents below it are not judged by that rule.

Languages are those of `COMMON_WORDS`; every other value, and null, falls under one
further reference, so the references are len(COMMON_WORDS) + 1 rows at most, whatever the
corpus: that bounds the only broadcast. Null text is empty text: no words, not kept.
Rows are independent and repeated rows count as often as they stand. Windows of three
words are compared through 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import WORD_BREAK, cut, text_or_empty

#: Frequent words by language (fixed values).
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on as with be by at this are or from an",
    "de": "der die das und in zu den mit von für auf ist im dem nicht ein eine des sich auch",
    "fr": "de la le et les des en un une du que est pour qui dans par au sur pas avec",
    "es": "de la que el en y a los se del las un por con no una para su al lo",
}
#: Classes in the order in which a text is stripped of them; the last is what remains.
CLASSES = (
    ("vowels", "[aeiou]+"),
    ("consonants", "[b-df-hj-np-tv-z]+"),
    ("capitals", "[A-Z]+"),
    ("digits", "[0-9]+"),
    ("stops", "[.,;:!?'\"()-]+"),
    ("marks", r"[!-/:-@\[-`{-~]+"),
    ("letters", r"\p{L}+"),
)
#: Base rules of the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Distances beyond which a document fails, and the least words for either to be judged.
MOST_CLASS_DISTANCE, CLASS_LEAST_WORDS = 0.30, 50
MOST_WORD_DISTANCE, WORD_LEAST_WORDS = 0.31, 100


def language(col: str = "lang") -> Column:
    return F.when(F.col(col).isin(*COMMON_WORDS), F.col(col)).otherwise(F.lit("other"))


def histograms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of each document: the contract's, then classes and common words."""
    df = docs.select(F.col(id_col).alias("doc_id"), language(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", WORD_BREAK), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("words").cast("bigint"))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^ \t\n\x0B\f\r]")))
    # Repeated windows: hashes in text order, sorted, and those that have an equal neighbour.
    df = df.withColumn("h", F.expr("CASE WHEN n_words >= 3 THEN transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE cast(array() AS array<bigint>) END"))
    df = df.withColumn("sorted", F.sort_array("h"))
    df = df.withColumn("twice", F.expr("array_distinct(filter(sorted, (x, i) -> i > 0 AND x = sorted[i - 1]))"))
    # A few repeats are looked up one by one; many are found by sorting hashes with places.
    few = "filter(sequence(0, size(h) - 1), i -> array_contains(twice, h[i]))"
    df = df.withColumn("pairs", F.expr("CASE WHEN size(twice) > 12 THEN array_sort(transform(h, (x, i) -> struct(x AS x, i AS i))) ELSE cast(array() AS array<struct<x: bigint, i: int>>) END"))
    many = "sort_array(transform(filter(pairs, (p, k) -> (k > 0 AND p.x = pairs[k - 1].x) OR (k < size(pairs) - 1 AND p.x = pairs[k + 1].x)), p -> p.i))"
    df = df.withColumn("places", F.expr(f"CASE WHEN size(twice) = 0 THEN cast(array() AS array<int>) WHEN size(twice) <= 12 THEN {few} ELSE {many} END"))
    df = df.withColumn("n_repeat_words", F.expr("CASE WHEN size(places) = 0 THEN 0L ELSE aggregate(zip_with(places, slice(places, 2, size(places)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x) END"))
    stripped, counts = F.regexp_replace("text", WORD_BREAK, ""), []
    df = df.withColumn("r0", stripped)
    for k, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"r{k + 1}", F.regexp_replace(f"r{k}", pattern, ""))
        counts.append(F.length(f"r{k}") - F.length(f"r{k + 1}"))
    counts.append(F.length(f"r{len(CLASSES)}"))
    common = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        common = F.when(F.col("lang") == lang, F.array(*map(F.lit, words.split()))).otherwise(common)
    df = df.withColumn("common", common)
    df = df.withColumn("hits", F.expr("filter(words, w -> array_contains(common, w))"))
    return df.select(
        "doc_id",
        "lang",
        "n_words",
        F.length("r0").cast("bigint").alias("word_chars"),
        F.expr("cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '')) AS bigint)").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*(c.cast("bigint") for c in counts)).alias("classes"),
        F.expr("coalesce(concat(transform(common, c -> cast(size(filter(hits, h -> h = c)) AS bigint)), array(n_words - size(hits))), array(n_words))").alias("wording"),
    )


def references(counted: DataFrame) -> DataFrame:
    """A row per language: both histograms summed over all its documents."""
    n_classes, n_wording = len(CLASSES) + 1, 1 + max(len(w.split()) for w in COMMON_WORDS.values())
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)]
    sums += [F.sum(F.get("wording", F.lit(i))).alias(f"w{i}") for i in range(n_wording)]
    totals = counted.groupBy("lang").agg(*sums)
    return totals.select(
        "lang",
        F.array(*(F.col(f"c{i}") for i in range(n_classes))).alias("class_reference"),
        F.array_compact(F.array(*(F.col(f"w{i}") for i in range(n_wording)))).alias("word_reference"),
    )


def js_distance(p: str, q: str) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of two count arrays; null
    where either is empty."""
    term = "CASE WHEN {0} > 0 THEN 0.5D * {0} * log2(2D * {0} / ({0} + {1})) ELSE 0D END"
    a, b = f"x / {p}_sum", f"y / {q}_sum"
    both = f"{term.format(f'({a})', f'({b})')} + {term.format(f'({b})', f'({a})')}"
    return F.expr(f"CASE WHEN {p}_sum > 0 AND {q}_sum > 0 THEN sqrt(greatest(0D, aggregate(zip_with({p}, {q}, (x, y) -> {both}), 0D, (s, x) -> s + x))) END")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: counts, distances, base_failed and kept."""
    counted = cut(histograms(docs, id_col, text_col, lang_col))
    df = counted.join(F.broadcast(references(counted)), "lang", "left")
    total = lambda c: F.expr(f"cast(aggregate({c}, 0L, (s, x) -> s + x) AS double)")
    for c in ("classes", "class_reference", "wording", "word_reference"):
        df = df.withColumn(f"{c}_sum", total(c))
    df = df.withColumn("class_distance", js_distance("classes", "class_reference"))
    df = df.withColumn("word_distance", js_distance("wording", "word_reference"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    far = ((F.col("n_words") >= CLASS_LEAST_WORDS) & (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE)) | (
        (F.col("n_words") >= WORD_LEAST_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    )
    return df.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "word_distance",
    )
