"""Read clustering per container (G06-G08): grouped kernels over the reads of one container.
`consensus` is a seam for outside assemblers; assembly.consensuses votes (G11)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of a fit by k-means (fixed values).
ONE_CLUSTER, MORE_CLUSTERS, CENTRES_APART = 14.5, 29.0, 29.0


def k_means(points: np.ndarray, k: int, starts: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of the best of several seeded starts."""
    rng, best = np.random.RandomState(seed), None
    for _ in range(starts):
        centres = points[rng.choice(len(points), k, replace=False)]
        for _ in range(100):
            labels = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            moved = np.array([points[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = ((points - centres[labels]) ** 2).sum()
        if best is None or cost < best[0]:
            best = cost, labels, centres
    return best[1], best[2]


def by_indels(points: np.ndarray, copies: int) -> np.ndarray | None:
    """Clusters by summed inserted and deleted bases, where a number of them up to the
    copy number fits (G06); None where none does."""
    for k in range(1, min(copies, len(points)) + 1):
        labels, centres = k_means(points, k)
        mean = np.sqrt(((points - centres[labels]) ** 2).sum(1)).mean()
        apart = min((np.linalg.norm(a - b) for i, a in enumerate(centres) for b in centres[:i]), default=np.inf)
        if mean <= (ONE_CLUSTER if k == 1 else MORE_CLUSTERS) and apart >= CENTRES_APART:
            return labels
    return None


def spectral(similarity: np.ndarray, k: int) -> np.ndarray:
    """Clusters of a similarity matrix by its leading normalised eigenvectors."""
    degree = np.sqrt(np.maximum(similarity.sum(1), 1e-12))
    _, vectors = np.linalg.eigh(similarity / degree[:, None] / degree[None])
    rows = vectors[:, -k:]
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return k_means(rows, min(k, len(rows)))[0]


def poorly_connected(similarity: np.ndarray, k: int, least: float = 0.1) -> np.ndarray:
    """Reads with too few like reads."""
    links = (similarity > least).sum(1) - (np.diag(similarity) > least)
    need = max(1, min(max(1, int(0.5 * np.ceil(len(links) / k))), max(1, int(0.5 * np.median(links)))))
    return links < need


#: Seeded starts, and rounds of one at most.
STARTS, ROUNDS = 10, 100
#: Numbers that a step over many containers holds at once, about.
HELD = 1 << 21
#: A fit nearer than this to a limit is worked out container by container.
CLOSE_CALL = 1e-6


@functools.lru_cache(maxsize=4096)
def first_centres(n: int, k: int, starts: int = STARTS, seed: int = 42) -> np.ndarray:
    """The points that each start of `k_means` begins with: they hang on n and k alone."""
    rng = np.random.RandomState(seed)
    return np.array([rng.choice(n, k, replace=False) for _ in range(starts)])


def many_k_means(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """`k_means` of many containers of as many points each (containers, points, places):
    the same sums in the same order, so the same labels and centres."""
    n = points.shape[1]
    starts = first_centres(n, k)
    of = np.repeat(np.arange(len(points)), len(starts))
    centres = points[:, starts].reshape(len(of), k, -1)
    labels, going = np.zeros((len(of), n), dtype=np.int64), np.arange(len(of))
    for _ in range(ROUNDS):
        p, c = points[of[going]], centres[going]
        near = labels[going] = ((p[:, :, None] - c[:, None]) ** 2).sum(3).argmin(2)
        moved = c.copy()
        for j in range(k):
            own = near == j
            count = own.sum(1)
            total = np.where(own.T[:, :, None], p.transpose(1, 0, 2), 0.0).sum(0)  # point by point
            moved[:, j] = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c[:, j])
        far = ~(np.abs(moved - c) <= 1e-8 + 1e-5 * np.abs(c)).all((1, 2))
        going = going[far]
        centres[going] = moved[far]
        if not len(going):
            break
    cost = ((points[of] - np.take_along_axis(centres, labels[:, :, None], 1)) ** 2).reshape(len(of), -1).sum(1)
    best = cost.reshape(len(points), -1).argmin(1) + np.arange(len(points)) * len(starts)
    return labels[best], centres[best]


def many_by_indels(points: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, whether a number of clusters fits) of many containers, as `by_indels`."""
    labels, open_ = np.zeros(points.shape[:2], dtype=np.int64), np.arange(len(points))
    for k in range(1, min(copies, points.shape[1]) + 1):
        own, centres = many_k_means(points[open_], k)
        mean = np.sqrt(((points[open_] - np.take_along_axis(centres, own[:, :, None], 1)) ** 2).sum(2)).mean(1)
        apart = np.full(len(open_), np.inf)
        for i in range(k):
            for j in range(i):
                apart = np.minimum(apart, np.sqrt(((centres[:, i] - centres[:, j]) ** 2).sum(1)))
        most = ONE_CLUSTER if k == 1 else MORE_CLUSTERS
        fits = (mean <= most) & (apart >= CENTRES_APART)
        for at in np.flatnonzero((np.abs(mean - most) < CLOSE_CALL) | (np.abs(apart - CENTRES_APART) < CLOSE_CALL)):
            plain, gap = k_means(points[open_[at]], k), np.inf
            mean_ = np.sqrt(((points[open_[at]] - plain[1][plain[0]]) ** 2).sum(1)).mean()
            gap = min((np.linalg.norm(a - b) for i, a in enumerate(plain[1]) for b in plain[1][:i]), default=gap)
            own[at], fits[at] = plain[0], mean_ <= most and gap >= CENTRES_APART
        labels[open_[fits]] = own[fits]
        open_ = open_[~fits]
        if not len(open_):
            break
    done = np.ones(len(points), dtype=bool)
    done[open_] = False
    return labels, done


def many_spectral(points: np.ndarray, k: int) -> np.ndarray:
    """Labels of many containers by their reads' likeness, as `spectral` of each."""
    d2 = ((points[:, :, None] - points[:, None]) ** 2).sum(3)
    flat = np.sort(d2.reshape(len(d2), -1), axis=1)
    more, at = (flat > 0).sum(1), np.arange(len(flat))
    low, high = (flat[at, np.minimum(flat.shape[1] - more + x // 2, flat.shape[1] - 1)] for x in (np.maximum(more - 1, 0), more))
    sigma2 = np.where(more > 0, np.where(more % 2 == 1, high, (low + high) / 2), 1.0)
    similarity = np.exp(-d2 / (2 * sigma2)[:, None, None])
    degree = np.sqrt(np.maximum(similarity.sum(2), 1e-12))
    _, vectors = np.linalg.eigh(similarity / degree[:, :, None] / degree[:, None])
    rows = vectors[:, :, -k:]
    rows = rows / np.maximum(np.sqrt((rows * rows).sum(2, keepdims=True)), 1e-12)
    return many_k_means(rows, min(k, points.shape[1]))[0]


def labelled(points: np.ndarray, copies: int) -> np.ndarray:
    """Labels of many containers of as many reads and copies each: by their indels, and by
    likeness where no number of clusters fits."""
    n = points.shape[1]
    step = max(1, HELD // (n * max(n, STARTS * 2 * copies)))
    out = []
    for at in range(0, len(points), step):
        part = points[at : at + step]
        labels, done = many_by_indels(part, copies)
        if not done.all():
            labels[~done] = many_spectral(part[~done], min(copies, n))
        out.append(labels)
    return np.concatenate(out)


def cluster_reads(reads: DataFrame, copies: str = "cn") -> DataFrame:
    """container_id, read_id, cluster. reads: (container_id, read_id, inserted, deleted, cn).
    The reads of a container are bounded by the admitted depth, so a container is a row;
    many come in a Python batch, and those of as many reads and copies are one computation."""
    number = lambda c: F.transform("_r", lambda x: x[c].cast("double"))
    whole = reads.groupBy("container_id").agg(F.array_sort(F.collect_list(F.struct("read_id", "inserted", "deleted", F.col(copies).alias("copies")))).alias("_r"))
    rows = whole.select(F.col("container_id").cast("bigint"), F.transform("_r", lambda x: x["read_id"].cast("bigint")).alias("read_id"), number("inserted").alias("inserted"), number("deleted").alias("deleted"), F.col("_r")[0]["copies"].cast("bigint").alias("copies"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, k = batch["inserted"].map(len), batch["copies"].clip(lower=1).astype(int)
            batch = batch.assign(cluster=pd.Series([None] * len(batch), index=batch.index, dtype=object))
            for (_, most), group in batch.groupby([sizes, k]):
                points = np.stack([np.stack(group["inserted"].to_list()), np.stack(group["deleted"].to_list())], axis=2).astype(float)
                batch.loc[group.index, "cluster"] = pd.Series(list(labelled(points, most)), index=group.index)
            yield batch[["container_id", "read_id", "cluster"]]

    out = rows.mapInPandas(run, "container_id bigint, read_id array<bigint>, cluster array<bigint>")
    return out.select("container_id", F.inline(F.arrays_zip("read_id", "cluster")))


def consensus(reads: DataFrame, assemble: Callable[[list[str]], str] | None = None) -> DataFrame:
    """container_id, cluster, sequence, members (G11). assemble is the seam for an outside
    assembler; by default the read of median length stands for its cluster.
    reads: (container_id, cluster, read_id, seq)."""
    if assemble is None:
        held = F.array_sort(F.collect_list(F.struct(F.col("seq").isNull().alias("none"), F.length("seq").alias("n"), "read_id", "seq")))  # a cluster's reads
        rows = reads.groupBy("container_id", "cluster").agg(held.alias("_r"))
        middle = F.element_at("_r", F.expr("cast((size(_r) + 1) div 2 AS int)"))
        return rows.select("container_id", "cluster", middle["seq"].alias("sequence"), F.transform("_r", lambda x: x["read_id"]).alias("members"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=pdf["seq"].str.len()).sort_values(["n", "read_id"])
        return pd.DataFrame({"container_id": pdf["container_id"].iloc[:1], "cluster": pdf["cluster"].iloc[:1], "sequence": [assemble(list(pdf["seq"]))], "members": [list(pdf["read_id"])]})

    return reads.groupBy("container_id", "cluster").applyInPandas(kernel, "container_id bigint, cluster bigint, sequence string, members array<bigint>")
