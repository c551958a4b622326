"""Interval data out of general tables, by the same arithmetic in both SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_raf": """SELECT l_suppkey % 5 AS chr, l_partkey * 50 + l_linenumber * 7 AS s,
        l_partkey * 50 + l_linenumber * 7 + CAST(l_quantity AS BIGINT) * 10 AS e, l_orderkey AS read_id,
        l_linestatus AS sample, l_returnflag <> 'R' AS forward, CAST(l_linenumber AS BIGINT) AS n_del FROM {lineitem}""",
    "v_signal": """SELECT event_id AS signal_id, user_id % 5 AS chr, event_id * 10 AS s,
        event_id * 10 + CASE WHEN event_type IN ('click', 'purchase') THEN CAST(floor(value) AS BIGINT) + 1 ELSE 0 END AS e,
        CAST(floor(value) AS BIGINT) + 1 AS size,
        CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN 3 ELSE 4 END AS sv_type,
        user_id AS read_id FROM {events}""",
    "v_repeat": "SELECT p_partkey % 5 AS chr, p_partkey * 50 AS s, p_partkey * 50 + p_size AS e, p_partkey AS repeat_id FROM {part}",
    "v_region": "SELECT s_suppkey % 5 AS chr, s_suppkey * 900 AS s, s_suppkey * 900 + 400 + s_nationkey * 20 AS e, s_suppkey AS region_id FROM {supplier}",
    "v_reads": """SELECT l_partkey AS locus, count(*) AS n_total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_alt,
        1 + l_partkey % 4 AS cn FROM {lineitem} GROUP BY l_partkey""",
    "v_genotype": """SELECT l_orderkey AS variant_id, CASE l_linenumber WHEN 1 THEN 'child' WHEN 2 THEN 'father' ELSE 'mother' END AS sample,
        CASE min(l_partkey) % 4 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE './.' END AS gt,
        CASE l_orderkey % 3 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' ELSE 'INV' END AS svtype, l_orderkey * 7 % 12000 AS size
        FROM {lineitem} WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_linenumber""",
    "v_dna": """SELECT doc_id, source AS grp, translate({strip}, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM {documents}""",
}
#: Removing letters outside a-z is the one thing that the engines spell differently.
STRIP = {"spark": "regexp_replace(lower(coalesce(text, '')), '[^a-z]', '')", "duckdb": "regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g')"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder; interval ends are called start and end."""
    text = VIEWS[name].replace("{strip}", STRIP["spark"])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    out = spark.sql(text, **used)
    return out.withColumnsRenamed({"s": "start", "e": "end"}) if "s" in out.columns else out


def sql(body: str) -> str:
    """A statement for the other engine, with the views that it mentions put before it."""
    named = [n for n in VIEWS if n in body]
    texts = (VIEWS[n].replace("{strip}", STRIP["duckdb"]) for n in named)
    ctes = ", ".join(f"{n} AS ({t.format(**{x: x for x in TABLES})})" for n, t in zip(named, texts))
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("RECURSIVE ", "").strip()
    if body.startswith("WITH "):
        return f"WITH {recursive}{ctes}, {body[5:]}" if named else f"WITH {recursive}{body[5:]}"
    return f"WITH {recursive}{ctes} {body}" if named else body


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
