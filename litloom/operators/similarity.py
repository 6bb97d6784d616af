"""Cosine similarity of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """[M3] Cosine of two arrays; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def pair_moments(rows: DataFrame, vector: str) -> DataFrame:
    """[M3, A34] ``n_pairs, mean, deviation`` of the cosines of all pairs i < j (population deviation).

    No pair is formed: with unit vectors u the sum of all cosines is
    (|sum u|^2 - n) / 2 and the sum of their squares (||U'U||^2 - n) / 2, so one
    pass sums a vector and a square matrix of the vectors' length.  Zero and
    null vectors are left out; fewer than two vectors give null moments.
    """

    def partial(parts):
        total, gram, n = None, None, 0
        for pdf in parts:
            m = np.array([v for v in pdf["v"] if v is not None], float)
            if not len(m):
                continue
            length = np.linalg.norm(m, axis=1)
            u = m[length > 0] / length[length > 0, None]
            n += len(u)
            total = u.sum(0) if total is None else total + u.sum(0)
            gram = u.T @ u if gram is None else gram + u.T @ u
        if n:
            d = len(total)
            i, j = np.indices((d, d))
            yield pd.DataFrame({"i": np.r_[np.arange(d), i.ravel(), -1], "j": np.r_[np.full(d, -1), j.ravel(), -1], "s": np.r_[total, gram.ravel(), float(n)]})

    got = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    sq = F.col("s") * F.col("s")
    t = got.agg(
        F.coalesce(F.sum(F.when((F.col("i") < 0) & (F.col("j") < 0), F.col("s"))), F.lit(0.0)).alias("n"),
        F.coalesce(F.sum(F.when((F.col("i") >= 0) & (F.col("j") < 0), sq)), F.lit(0.0)).alias("a"),
        F.coalesce(F.sum(F.when((F.col("i") >= 0) & (F.col("j") >= 0), sq)), F.lit(0.0)).alias("g"),
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = (F.col("a") - F.col("n")) / 2 / F.nullif(pairs, F.lit(0.0))
    second = (F.col("g") - F.col("n")) / 2 / F.nullif(pairs, F.lit(0.0))
    return t.select(pairs.cast("long").alias("n_pairs"), mean.alias("mean"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("deviation"))


def nearest_centroid(rows: DataFrame, key: str, vector: str, centroids: DataFrame) -> DataFrame:
    """[M20] ``key, cluster, distance`` of the nearest centroid (cluster, center); centroids are few and collected."""
    cs = centroids.select("cluster", F.col("center").cast("array<double>")).collect()
    dist = lambda c: F.sqrt(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in c]), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    best = F.array_min(F.array(*[F.struct(dist(r["center"]).alias("distance"), F.lit(r["cluster"]).alias("cluster")) for r in cs]))
    return rows.select(key, best.alias("x")).select(key, "x.cluster", "x.distance")
