"""Secret scans by corpus-wide ownership, with DataFrame functions only.

Candidates come from fixed base patterns and from further patterns of known token forms.
Each candidate's value is hashed, and hashes are aggregated over the whole corpus by
distinct repositories and owners: a value that more than `MOST_OWNERS` owners hold, or
several owners in more than `MOST_REPOSITORIES` repositories, is a widely copied example;
any other looks live. What one owner alone holds is that owner's, in however many places.
Base spans always stay; the further ones stay where they look live and touch no base span.

Offsets are code points, ends are exclusive. Matches are found by splitting a text at a
pattern, so that their places are sums of lengths. Null text is empty text, without
candidates; a null owner or repository is a name like another. Repeated rows give the same
result each, and count once for an owner. What is joined is candidates, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import cut, text_or_empty

#: kind: pattern, group of the value, least characters of that group (fixed values).
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}+", 0, 32),
)
MORE = (
    ("vendor", r"(?:gh[opsu]_|glpat-|sk_live_|sk_test_|xox[abp]-|AIza)[A-Za-z0-9_-]{16,}+", 0, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30),
    ("bearer", r"(?:Bearer|Basic) ([A-Za-z0-9+/_.=-]{24,}+)", 1, 24),
)
#: A literal that a text with a match must hold, to pass over the others at once.
HINTS = {"assign": r"(?i)pass|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{32}", "vendor": "gh[opsu]_|glpat-|sk_live_|sk_test_|xox[abp]-|AIza", "jwt": "eyJ", "bearer": "Bearer |Basic "}
KINDS = tuple(k for k, *_ in (*BASE, *MORE))
MOST_OWNERS, MOST_REPOSITORIES = 2, 3
SPAN = "struct<start: bigint, kind_no: int, stop: bigint, hash: bigint>"


def quoted(pattern: str) -> Column:
    return F.lit(pattern)


def matches(df: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """df with a column of the kind's spans, sorted by place."""
    number, none = KINDS.index(kind), F.array().cast("array<string>")
    here = F.col("text").rlike(HINTS[kind])
    found = lambda g: F.when(here, F.regexp_extract_all("text", F.lit(pattern), F.lit(g))).otherwise(none)
    df = df.withColumn("whole", found(0)).withColumn("value", found(group) if group else F.col("whole"))
    # Lengths of what stands between matches and of the matches, in turn.
    gaps = F.when(F.size("whole") > 0, F.split("text", pattern, -1)).otherwise(none)
    df = df.withColumn("lengths", F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size("whole")), "whole", lambda g, m: F.array(F.length(g).cast("bigint"), F.length(m).cast("bigint")))))
    # Running sums in blocks of the square root of their number, so that no sum is copied often.
    df = df.withColumn("step", F.expr("greatest(32, cast(sqrt(size(lengths)) AS int))"))
    df = df.withColumn("parts", F.expr("CASE WHEN size(lengths) > 0 THEN transform(sequence(0, cast(ceil(size(lengths) / step) AS int) - 1), j -> slice(lengths, j * step + 1, step)) ELSE cast(array() AS array<array<bigint>>) END"))
    running = "aggregate({0}, named_struct('p', {1}, 'a', cast(array() AS array<bigint>)), (s, v) -> named_struct('p', s.p + v, 'a', concat(s.a, array(s.p))), s -> s.a)"
    df = df.withColumn("offsets", F.expr(running.format("transform(parts, c -> aggregate(c, 0L, (s, v) -> s + v))", "0L")))
    df = df.withColumn("at", F.expr(f"flatten(zip_with(parts, offsets, (c, o) -> {running.format('c', 'o')}))"))
    spans = f"transform(whole, (m, k) -> CASE WHEN length(value[k]) >= {least} THEN struct(at[2 * k + 1] AS start, {number} AS kind_no, at[2 * k + 1] + length(m) AS stop, xxhash64(value[k]) AS hash) END)"
    return df.withColumn(kind, F.expr(f"array_compact({spans})")).drop("whole", "value", "lengths", "step", "parts", "offsets", "at")


def written(spans: str) -> str:
    names = "element_at(array({}), s.kind_no + 1)".format(", ".join(f"'{k}'" for k in KINDS))
    return f"array_join(transform(array_sort({spans}), s -> concat_ws(':', {names}, s.start, s.stop)), ',')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """A row per document: base counts and digest, all spans, and how many candidates look
    live or are widely copied."""
    name = lambda *cols: F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), name(owner_col).alias("owner"), name(*repository_cols).alias("repository"))
    for kind in (*BASE, *MORE):
        df = matches(df, *kind)
    base, more = (F.flatten(F.array(*(F.col(k) for k, *_ in group))) for group in (BASE, MORE))
    df = df.select("id", "owner", "repository", base.alias("base"), more.alias("more"), *(F.size(k).cast("bigint").alias(f"n_{k}") for k, *_ in BASE))
    free = "filter(more, m -> NOT exists(base, b -> b.start < m.stop AND m.start < b.stop))"
    df = df.withColumn("more", F.expr(f"CASE WHEN size(more) > 0 THEN {free} ELSE more END")).withColumn("key", F.xxhash64("id", "base", "more", "owner", "repository"))
    seen = cut(df)

    held = seen.where("size(base) + size(more) > 0").select("key", "owner", "repository", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["hash"]))).alias("hash"))
    by_owner = held.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    copied = cut(owners.where((F.col("owners") > MOST_OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") > MOST_REPOSITORIES))).select("hash"))
    marked = cut(held.select("key", "hash").distinct().join(copied, "hash").groupBy("key").agg(F.collect_set("hash").alias("copied")))  # a document's own hashes

    out = seen.join(marked, "key", "left").withColumn("copied", F.coalesce("copied", F.array().cast("array<bigint>")))
    out = out.withColumn("live", F.expr("filter(more, m -> NOT array_contains(copied, m.hash))"))
    every = "concat(base, more)"
    return out.select(
        F.col("id").alias(id_col),
        *(f"n_{k}" for k, *_ in BASE),
        F.sha2(F.expr(written("base")), 256).alias("base_sha256"),
        F.expr(written("concat(base, live)")).alias("spans"),
        F.expr(f"cast(size(filter({every}, m -> NOT array_contains(copied, m.hash))) AS bigint)").alias("n_live"),
        F.expr(f"cast(size(filter({every}, m -> array_contains(copied, m.hash))) AS bigint)").alias("n_copied"),
    )
