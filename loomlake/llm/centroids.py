"""Plain Lloyd clustering of integer vectors: exact, so every run and every partitioning gives the same rows.

Vectors become integers once and are written; each round broadcasts the centroids, of which there are ``k``, and every partition sends back one
integer sum for each centroid and component. The driver sees ``k`` rows a round, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.scratch import Scratch

#: Integer components are held within this, so that a squared distance of up to 64 components fits into 64 bits.
LARGEST = 2**27 - 1
_TOP = Decimal(2**63 - 1)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): the vectors of ``width`` components, none null or not finite, each component x as floor(scale * x)."""
    vec = vectors[vector_col].cast("array<double>")
    whole = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.where((F.size(vec) == width) & whole)
    held = lambda x: F.greatest(F.lit(-LARGEST - 1.0), F.least(F.lit(float(LARGEST)), x * scale))
    return kept.select(vectors[id_col].cast("bigint").alias("vec_id"), F.transform(vec, lambda x: F.floor(held(x)).cast("bigint")).alias("v"))


def seeds(points: DataFrame, k: int, salt: str = "2") -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of ``salt:id``, in that order; of repeated ids the smaller vector is first."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = points.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centroid, the lowest on ties, and its squared distance."""
    apart = np.empty((len(centroids), len(v)), np.int64)
    for j, centroid in enumerate(centroids):
        gap = v - centroid
        apart[j] = np.einsum("ij,ij->i", gap, gap)
    best = apart.argmin(axis=0)
    return best, apart[best, np.arange(len(v))]


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; those without any stay."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = shared.value
        total, count = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for frame in frames:
            if len(frame):
                v = np.vstack(frame["v"].to_numpy())
                best, _ = nearest(v, now)
                count += np.bincount(best, minlength=len(now))
                for j in np.unique(best):
                    total[j] += v[best == j].sum(axis=0)
        used = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], "total": list(total[used])})

    parts = points.select("v").mapInPandas(sums, "cluster int, n bigint, total array<bigint>")
    by_place = parts.select("cluster", "n", F.posexplode("total").alias("place", "x"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    merged = by_place.groupBy("cluster", "place").agg(exact("n").alias("n"), exact("x").alias("x")).collect()
    shared.unpersist()
    out = centroids.copy()
    for r in merged:
        out[r["cluster"], r["place"]] = int(r["x"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256) -> DataFrame:
    """Each kept vector with its cluster after ``rounds`` rounds.

    Returns ``id_col``, cluster, distance (squared, of the integer vectors), cluster_inertia and inertia (distances summed over the cluster and over
    all vectors) and centroid_sha256 (of the centroid's components, comma-joined). Centroids start as ``seeds``.

    Vectors that are null, of another width, or with a null or non-finite component are left out. Components beyond 2**27 in integer form are
    held there, and sums beyond 2**63 - 1 too. Repeated ids are clustered row by row; a null id stays null, hashed as an empty one. Ties go to the lower
    centroid; with fewer than ``k`` vectors there are as many centroids. Extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "lloyd")
    points = scratch.write(integers(vectors, id_col, vector_col, width, scale), "integers")
    centroids = seeds(points, k)
    for _ in range(rounds if len(centroids) else 0):
        after = _moved(points, centroids)
        if np.array_equal(after, centroids):
            break
        centroids = after
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                best, apart = nearest(np.vstack(frame["v"].to_numpy()), shared.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": best.astype(np.int32), "distance": apart})

    found = scratch.write(points.mapInPandas(assigned, "vec_id bigint, cluster int, distance bigint"), "assigned")
    held = F.least(F.sum(F.col("distance").cast("decimal(20,0)")), F.lit(_TOP)).cast("bigint")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(held.alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    whole = min(sum(inertia.values()), 2**63 - 1)
    about = vectors.sparkSession.createDataFrame([(j, s, whole, digest[j]) for j, s in sorted(inertia.items())], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row a centroid
    out = found.join(F.broadcast(about), "cluster")
    return out.select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
