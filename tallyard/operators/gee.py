"""Generalised estimating equations: one logistic regressor, exchangeable clusters, robust errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "intercept double, slope double, rho double, se double, se_md double, clusters bigint"


def _cluster_cells(df: DataFrame, y: str, x: str, cluster: str, by: list[str]) -> DataFrame:
    """Counts of equal clusters: (n0, y0, n1, y1) of a cluster and how often it occurs.

    With a binary regressor a cluster is its four counts, so all iterations run over the
    distinct ones, however many clusters there are.
    """
    one, zero = F.col(x) == 1, F.col(x) == 0
    c = df.groupBy(*by, cluster).agg(*[F.sum(F.when(k, v).otherwise(0)).cast("int").alias(n) for n, k, v in (("n0", zero, F.lit(1)), ("y0", zero, F.col(y)), ("n1", one, F.lit(1)), ("y1", one, F.col(y)))])
    return c.groupBy(*by, "n0", "y0", "n1", "y1").agg(F.count(F.lit(1)).alias("times"))


def solve(n0, y0, n1, y1, times, rounds: int = 60) -> dict | None:
    """Fisher scoring over distinct clusters; None where a margin has no event or nothing but events."""
    n0, y0, n1, y1, w = (np.asarray(v, dtype="float64") for v in (n0, y0, n1, y1, times))
    s = [(w * v).sum() for v in (n0, y0, n1, y1)]
    if not (0 < s[1] < s[0] and 0 < s[3] < s[2]):
        return None
    odds = [np.log(e / (t - e)) for e, t in ((s[1], s[0]), (s[3], s[2]))]
    m, beta, rho = n0 + n1, np.array([odds[0], odds[1] - odds[0]]), 0.0
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.array([beta[0], beta[0] + beta[1]])))
        a = np.sqrt(mu * (1 - mu))
        r0, r1 = (y0 - n0 * mu[0]) / a[0], (y1 - n1 * mu[1]) / a[1]
        sq = y0 * ((1 - mu[0]) / a[0]) ** 2 + (n0 - y0) * (mu[0] / a[0]) ** 2 + y1 * ((1 - mu[1]) / a[1]) ** 2 + (n1 - y1) * (mu[1] / a[1]) ** 2
        pairs = (w * m * (m - 1)).sum()
        rho = float(np.clip((w * ((r0 + r1) ** 2 - sq)).sum() / pairs if pairs else 0.0, -0.2, 0.99))
        c = rho / (1 + (m - 1) * rho)
        # columns of D in standardised form: a for the intercept, a * x for the slope
        d0, d1 = n0 * a[0] + n1 * a[1], n1 * a[1]
        h = np.array([[n0 * a[0] ** 2 + n1 * a[1] ** 2 - c * d0 * d0, n1 * a[1] ** 2 - c * d0 * d1], [n1 * a[1] ** 2 - c * d0 * d1, n1 * a[1] ** 2 - c * d1 * d1]]) / (1 - rho)
        g = np.array([a[0] * r0 + a[1] * r1 - c * d0 * (r0 + r1), a[1] * r1 - c * d1 * (r0 + r1)]) / (1 - rho)
        total = (h * w).sum(axis=2)
        step = np.clip(np.linalg.solve(total, (g * w).sum(axis=1)), -1.0, 1.0)
        beta = np.clip(beta + step, -15.0, 15.0)
        if np.abs(step).max() < 1e-10:
            break
    bread = np.linalg.inv(total)
    meat = np.einsum("ik,jk,k->ij", g, g, w)
    lever = np.einsum("ijk,jl->ilk", h, bread)
    corrected = np.stack([np.linalg.solve(np.eye(2) - lever[:, :, k], g[:, k]) for k in range(len(w))], axis=1)
    meat_md = np.einsum("ik,jk,k->ij", corrected, corrected, w)
    return {"intercept": beta[0], "slope": beta[1], "rho": rho, "se": float(np.sqrt((bread @ meat @ bread)[1, 1])), "se_md": float(np.sqrt((bread @ meat_md @ bread)[1, 1])), "clusters": int(w.sum())}


def gee(df: DataFrame, y: str, x: str, cluster: str, by: list[str]) -> DataFrame:
    """Per ``by``: coefficients, working correlation, robust and bias-corrected errors of the slope; nulls where not estimable."""
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve(*(pdf[c] for c in ("n0", "y0", "n1", "y1", "times"))) or {"intercept": None, "slope": None, "rho": None, "se": None, "se_md": None, "clusters": int(pdf["times"].sum())}
        return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, **{k: v if v is None or k == "clusters" else round(float(v), 6) for k, v in out.items()}}])

    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    return _cluster_cells(df, y, x, cluster, by).groupBy(*by).applyInPandas(fit, f"{keys}, {_SCHEMA}")
