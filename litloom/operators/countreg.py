"""Negative binomial count regression, distributed: every step sums score and curvature over partitions.

NB2 with mean exp(x'b + offset) and variance mu + alpha mu^2; optionally with a
constant zero inflation.  The driver keeps vectors and matrices of the number
of coefficients only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digamma(x: np.ndarray) -> np.ndarray:
    x, r = np.array(x, float), 0.0
    for _ in range(8):  # recurrence up to where the series holds
        r = r - np.where(x < 8, 1 / x, 0.0)
        x = np.where(x < 8, x + 1, x)
    i = 1 / (x * x)
    return r + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def _lgamma(x: np.ndarray) -> np.ndarray:
    x, r = np.array(x, float), 0.0
    for _ in range(8):
        r = r - np.where(x < 8, np.log(x), 0.0)
        x = np.where(x < 8, x + 1, x)
    i = 1 / (x * x)
    return r + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / x


def loglik(theta: np.ndarray, x: np.ndarray, y: np.ndarray, off: np.ndarray, inflated: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods and score vectors per row; theta is b, log alpha (and the inflation's logit)."""
    p = x.shape[1]
    b, a = theta[:p], math.exp(min(max(theta[p], -20.0), 20.0))
    eta = np.clip(x @ b + off, -30, 30)
    mu, r = np.exp(eta), 1 / a
    am = 1 + a * mu
    ll = _lgamma(y + r) - _lgamma(np.full_like(y, r)) - _lgamma(y + 1) + y * np.log(a * mu / am) - r * np.log(am)
    d_eta = (y - mu) / am
    d_log_a = -r * (_digamma(y + r) - _digamma(np.full_like(y, r)) - np.log(am)) + (y - mu) / am
    if not inflated:
        return ll, np.column_stack([d_eta[:, None] * x, d_log_a])
    w = 1 / (1 + math.exp(-min(max(theta[p + 1], -30.0), 30.0)))
    zero = y == 0
    p0 = np.exp(-r * np.log(am))
    mix = w + (1 - w) * p0
    keep = np.where(zero, (1 - w) * p0 / mix, 1.0)  # how much of the row is the count part's
    full = np.where(zero, np.log(mix), math.log(1 - w) + ll)
    d_w = np.where(zero, (1 - p0) * w * (1 - w) / mix, -w)
    return full, np.column_stack([(d_eta * keep)[:, None] * x, d_log_a * keep, d_w])


def _sums(d: DataFrame, names: list[str], target: str, offset: str | None, theta: np.ndarray, inflated: bool, by: str | None = None):
    """Log-likelihood, score and curvature (central differences of the score) summed over all rows in one pass."""
    k = len(theta)
    t0 = [float(v) for v in theta]

    def run(parts):
        th = np.array(t0)
        ll, g, h = 0.0, np.zeros(k), np.zeros((k, k))
        for pdf in parts:
            x = np.column_stack([np.ones(len(pdf))] + [pdf[n].to_numpy(float) for n in names])
            y = pdf[target].to_numpy(float)
            off = pdf[offset].to_numpy(float) if offset else np.zeros(len(pdf))
            one, s = loglik(th, x, y, off, inflated)
            ll, g = ll + one.sum(), g + s.sum(0)
            for j in range(k):
                e = np.zeros(k)
                e[j] = 1e-5 * max(1.0, abs(th[j]))
                h[j] += (loglik(th + e, x, y, off, inflated)[1].sum(0) - loglik(th - e, x, y, off, inflated)[1].sum(0)) / (2 * e[j])
        yield pd.DataFrame({"i": np.r_[-1, np.arange(k), np.arange(k * k) + k], "v": np.r_[ll, g, h.ravel()]})

    got = {r["i"]: r["v"] for r in d.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    g = np.array([got.get(i, 0.0) for i in range(k)])
    h = np.array([got.get(k + i, 0.0) for i in range(k * k)]).reshape(k, k)
    return got.get(-1, 0.0), g, (h + h.T) / 2


def _cluster_sums(d: DataFrame, target: str, names: list[str], offset: str | None, t0: list[float], inflated: bool) -> tuple[DataFrame, int]:
    """Score vectors summed per cluster (``_cl``), first within each task: ``s0 .. s(k-1), _cl``."""
    k = len(t0)

    def scores(parts):
        th = np.array(t0)
        for pdf in parts:
            x = np.column_stack([np.ones(len(pdf))] + [pdf[c].to_numpy(float) for c in names])
            off = pdf[offset].to_numpy(float) if offset else np.zeros(len(pdf))
            s = loglik(th, x, pdf[target].to_numpy(float), off, inflated)[1]
            out = pd.DataFrame(s, columns=[f"s{i}" for i in range(k)])
            out["_cl"] = pdf["_cl"].to_numpy()
            yield out.groupby("_cl", as_index=False).sum()[[*[f"s{i}" for i in range(k)], "_cl"]]

    got = d.mapInPandas(scores, ", ".join(f"s{i} double" for i in range(k)) + ", _cl string")
    return got.groupBy("_cl").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]), k


class Fit:
    """Coefficients, covariance and criteria of a fitted model."""

    def __init__(self, names, theta, cov, llf, n, inflated, clusters=None):
        self.names, self.theta, self.cov, self.llf, self.n, self.inflated, self.clusters = names, theta, cov, llf, n, inflated, clusters

    @property
    def alpha(self) -> float:
        return math.exp(self.theta[len(self.names)])

    @property
    def aic(self) -> float:
        """[M18]"""
        return 2 * len(self.theta) - 2 * self.llf

    @property
    def bic(self) -> float:
        """[M18]"""
        return len(self.theta) * math.log(self.n) - 2 * self.llf

    def table(self, spark) -> DataFrame:
        """[M16] ``term, coef, std_err, z, p_value, ci_low, ci_high``; alpha by the delta method."""
        rows = []
        labels = [*self.names, "alpha"] + (["inflate_const"] if self.inflated else [])
        for i, name in enumerate(labels):
            v, s = float(self.theta[i]), math.sqrt(max(self.cov[i, i], 0.0))
            if name == "alpha":
                v, s = math.exp(v), math.exp(v) * s
            z = v / s if s else float("nan")
            rows.append((name, v, s, z, math.erfc(abs(z) / math.sqrt(2)) if s else float("nan"), v - 1.959963984540054 * s, v + 1.959963984540054 * s))
        return spark.createDataFrame(rows, "term string, coef double, std_err double, z double, p_value double, ci_low double, ci_high double")


def fit_nb(rows: DataFrame, target: str, features: list[str], offset: str | None = None, inflated: bool = False, cluster: str | None = None, steps: int = 60) -> Fit:
    """[M12, M14, M15] NB2, with a log-exposure offset, or zero-inflated; [M13] standard errors clustered by ``cluster``.

    Newton steps with halving; where the curvature is no maximum's, a ridge is
    added.  Rows with a null in a used column are left out; the features must
    not be collinear.
    """
    use = [target, *features, *([offset] if offset else [])]
    d = rows.select(*[F.col(c).cast("double").alias(c) for c in use], *([F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("_cl")] if cluster else [])).dropna(subset=use)
    start = d.agg(F.count("*").alias("n"), F.avg(target).alias("m"), F.var_pop(target).alias("v"), *([F.avg(F.exp(offset)).alias("e")] if offset else [])).first()
    n, m = start["n"], max(start["m"] or 0.0, 1e-3)
    base = math.log(m / (start["e"] if offset else 1.0))
    a0 = max((start["v"] - m) / m**2, 0.05) if start["v"] else 0.5
    theta = np.array([base, *[0.0] * len(features), math.log(a0), *([-2.0] if inflated else [])])
    ll, g, h = _sums(d, features, target, offset, theta, inflated)
    for _ in range(steps):
        ridge = 0.0
        while True:
            try:
                step = np.linalg.solve(-h + ridge * np.eye(len(theta)), g)
                if step @ g >= 0:
                    break
            except np.linalg.LinAlgError:
                pass
            ridge = max(ridge * 10, 1e-3)
        size = 1.0
        while size > 1e-4:
            new = theta + size * np.clip(step, -3, 3)
            ll2, g2, h2 = _sums(d, features, target, offset, new, inflated)
            if np.isfinite(ll2) and ll2 >= ll - 1e-9:
                break
            size /= 2
        gain = ll2 - ll
        if size > 1e-4:
            theta, ll, g, h = new, ll2, g2, h2
        if size <= 1e-4 or abs(gain) < 1e-8 * max(1.0, abs(ll)):
            break
    cov = np.linalg.pinv(-h)
    groups = None
    if cluster:
        per, k = _cluster_sums(d, target, features, offset, [float(v) for v in theta], inflated)
        outer = per.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        meat = np.array([[outer[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        groups = outer["g"]
        cov = cov @ meat @ cov * (groups / max(1, groups - 1))
    return Fit(["Intercept", *features], theta, cov, ll, n, inflated, groups)


def _given(rows: DataFrame, target: str, coef: dict[str, float], offset: str | None, cluster: str | None = None) -> tuple[list[str], DataFrame]:
    names = [c for c in coef if c != "Intercept"]
    use = [target, *names, *([offset] if offset else [])]
    return names, rows.select(*[F.col(c).cast("double").alias(c) for c in use], *([F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("_cl")] if cluster else [])).dropna(subset=use)


def at(rows: DataFrame, target: str, coef: dict[str, float], alpha: float, offset: str | None = None, inflation: float | None = None) -> Fit:
    """[M12, M14, M15, M18] The model at given coefficients: its likelihood and criteria over all rows; the covariance is not computed."""
    names, d = _given(rows, target, coef, offset)
    theta = np.array([coef.get("Intercept", 0.0), *[coef[c] for c in names], math.log(alpha), *([math.log(inflation / (1 - inflation))] if inflation is not None else [])])
    ll, _, _ = _sums(d, names, target, offset, theta, inflation is not None)
    return Fit(["Intercept", *names], theta, np.full((len(theta), len(theta)), np.nan), ll, d.count(), inflation is not None)


def cluster_scores(rows: DataFrame, target: str, coef: dict[str, float], alpha: float, offset: str | None, cluster: str) -> DataFrame:
    """[M13] ``term, clusters, score, meat``: the score at given coefficients, and the sum of its squares over clusters."""
    names, d = _given(rows, target, coef, offset, cluster)
    per, k = _cluster_sums(d, target, names, offset, [coef.get("Intercept", 0.0), *[coef[c] for c in names], math.log(alpha)], False)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"s{i}").alias("s")) for i, n in enumerate(["Intercept", *names])]))
    return per.select(each.alias("x")).groupBy("x.term").agg(F.count("*").alias("clusters"), F.sum("x.s").alias("score"), F.sum(F.col("x.s") * F.col("x.s")).alias("meat"))


def predicted_zeros(rows: DataFrame, coef: dict[str, float], alpha: float, offset: str | None = None) -> DataFrame:
    """[M17, M19] ``n, observed_zeros, predicted_zeros``: the sum of (1 / (1 + alpha mu))^(1 / alpha); ``coef`` maps columns to coefficients."""
    eta = F.lit(coef.get("Intercept", 0.0))
    for c, b in coef.items():
        if c != "Intercept":
            eta = eta + F.lit(float(b)) * F.col(c).cast("double")
    if offset:
        eta = eta + F.col(offset)
    p0 = F.pow(1.0 / (1.0 + F.lit(alpha) * F.exp(eta)), F.lit(1.0 / alpha))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("cites") == 0).alias("observed_zeros"), F.sum(p0).alias("predicted_zeros"))


def features(corpus: DataFrame, topics: DataFrame | None = None, key: str = "record_id") -> DataFrame:
    """[P29-P32, J1] The regression frame: cites, year, author_count, is_oa, is_article, keyword_count, venue, exposure_years, log_exposure, years_since, topic (-1 where none)."""
    from litloom.functions import text

    y = F.col("year")
    d = corpus.select(
        key, "cites", "year", "author_count", F.col("is_oa").cast("int").alias("is_oa"),
        F.coalesce(F.col("document_type") == "Article", F.lit(False)).cast("int").alias("is_article"), "keyword_count",
        F.trim(F.coalesce("source_title", F.lit("(unknown venue)"))).alias("venue"),
        text.exposure_years(y).alias("exposure_years"), F.log(text.exposure_years(y)).alias("log_exposure"), (F.lit(2026 + 153.0 / 365.0) - y - 0.5).alias("years_since"),
    )
    if topics is not None:
        d = d.join(topics.select(key, "topic"), key, "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))
    return d
