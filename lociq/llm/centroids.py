"""Centroid clustering: plain Lloyd rounds in whole numbers.

A vector's components become integers floor(scale * x). Every round carries the centroids
to the tasks, which assign their vectors by exact integer distances, one centroid after
another, the smaller number winning ties, and give the sums and counts of their part; a
groupBy merges these, and the driver sees only one row for each centroid and component.
So a round is one scan and a shuffle of a few rows a task, and neither a large cluster nor
a repeated vector is any task's burden.

Vectors of another width, or with a null, infinite or undefined component, are left out.
A row without an id is assigned like any other, but starts no centroid. Of vectors that
share an id the smaller components start first. With fewer vectors than centroids there
are as many centroids as vectors, and without any the result is empty. Integers of 64
bits are exact up to components of `NARROW`; a table that holds larger ones is worked
through in whole numbers of any size, where a distance that no long can hold is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import cut

CLUSTERS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
#: Twice this, squared and taken WIDTH times, is still below 2^63.
NARROW = 1 << 27


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(vec_id, v): the vectors of the given width with nothing but numbers, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Ids pass pandas as text, which keeps long ones whole beside nulls.
    return vectors.where(F.size(vector_col) == width).where(fine).select(F.col(id_col).cast("string").alias("vec_id"), v.alias("v"))


def whole(rows, scale: int, wide: bool) -> np.ndarray:
    """The integers of some vectors, a row each; of Python's whole numbers where wide."""
    x = np.stack(list(rows))
    if not wide:
        return np.floor(x * scale).astype(np.int64)
    exact = lambda a: math.floor(a * scale) if math.isfinite(a * scale) else int(a) * scale
    return np.array([[exact(a) for a in row] for row in x.tolist()], dtype=object)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, the smaller number at ties."""
    far = np.empty((len(x), len(centroids)), dtype=x.dtype)
    for k, centroid in enumerate(centroids):
        off = x - centroid
        far[:, k] = (off * off).sum(axis=1)
    own = far.argmin(axis=1).astype(np.int64)
    return own, far[np.arange(len(x)), own]


def starting(kept: DataFrame, clusters: int, seed: int, scale: int, wide: bool) -> np.ndarray:
    """The vectors whose ids have the smallest digests; as many rows as clusters at most."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), "vec_id"), 256)
    first = kept.where("vec_id IS NOT NULL").orderBy(digest, "v").limit(clusters).collect()
    return whole([r.v for r in first], scale, wide) if first else np.zeros((0, 0), np.int64)


def moved(kept: DataFrame, centroids: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """The centroids after one round."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    k, width = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, width), dtype=object if wide else np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if len(batch):
                x = whole(batch["v"], scale, wide)
                own, _ = nearest(x, shared.value)
                counts += np.bincount(own, minlength=k)
                np.add.at(sums, own, x)
        at, i = np.divmod(np.arange(k * width), width)
        total = list(map(str, sums.ravel())) if wide else sums.ravel()
        found = pd.DataFrame({"cluster": at, "component": i, "total": total, "members": counts[at]})
        yield found[found["members"] > 0]

    parts = kept.select("v").mapInPandas(run, f"cluster bigint, component bigint, total {'string' if wide else 'bigint'}, members bigint").groupBy("cluster", "component")
    if wide:  # sums that no column type holds, of a row a task

        def merged(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.head(1).assign(total=str(sum(map(int, rows["total"]))), members=rows["members"].sum())

        parts = parts.applyInPandas(merged, "cluster bigint, component bigint, total string, members bigint")
    else:
        parts = parts.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members"))
    out = centroids.copy()
    for r in parts.collect():  # a row for each centroid and component
        out[r.cluster, r.component] = int(r.total) // r.members
    shared.unpersist()
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 3) -> DataFrame:
    """A row per usable vector: cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    kept = usable(vectors, id_col, vector_col, width)
    largest = kept.select(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    wide = largest is not None and largest * scale >= NARROW - 1
    centroids = starting(kept, clusters, seed, scale, wide)
    schema = f"vec_id string, cluster int, distance {'string' if wide else 'bigint'}"
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(kept, centroids, scale, wide)
        shared = spark.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    own, far = nearest(whole(batch["v"], scale, wide), shared.value)
                    yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": own.astype(np.int32), "distance": list(map(str, far)) if wide else far})

        assigned = cut(kept.mapInPandas(run, schema))
    else:
        assigned = spark.createDataFrame([], schema)
    exact = "try_cast(distance AS decimal(38,0))"
    sums = assigned.groupBy("cluster").agg(F.expr(f"CASE WHEN count({exact}) = count(*) THEN try_sum({exact}) END").alias("total")).collect()  # a row a centroid
    known = all(r.total is not None for r in sums)
    fits = lambda n: int(n) if n is not None and n < 1 << 63 else None
    inertia = fits(sum(r.total for r in sums)) if known else None
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    facts = spark.createDataFrame([(r.cluster, fits(r.total), inertia, digest(r.cluster)) for r in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = assigned.join(F.broadcast(facts), "cluster")
    return out.select(F.col("vec_id").cast(kind).alias(id_col), "cluster", F.expr("try_cast(distance AS bigint)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same in SQL, a pair of steps a round."""
    fine = f"len(embedding) = {WIDTH} AND list_aggregate(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and')"
    steps = [
        f"raw AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE {fine})",
        f"x AS MATERIALIZED (SELECT rid, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS HUGEINT) AS x FROM raw, range(1, {WIDTH + 1}) AS t(i))",
        f"first AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS k FROM raw WHERE vec_id IS NOT NULL QUALIFY k < {CLUSTERS})",
        "c0 AS MATERIALIZED (SELECT k, i, x AS c FROM first JOIN x USING (rid))",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"d{n} AS (SELECT rid, k, sum((x - c) * (x - c)) AS d FROM x JOIN c{n} USING (i) GROUP BY rid, k)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT rid, arg_min(k, d * {CLUSTERS} + k) AS k, min(d) AS d FROM d{n} GROUP BY rid)")
        if n < ROUNDS:
            steps.append(f"m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN x USING (rid) GROUP BY k, i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{n} LEFT JOIN m{n} USING (k, i))")
    steps.append(f"h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)")
    out = f"""SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN raw USING (rid) JOIN h USING (k)"""
    return "WITH " + ",\n".join(steps) + "\n" + out
