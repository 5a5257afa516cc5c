"""Convergence of posterior draws, and comparison of surfaces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rhat(draws: DataFrame) -> DataFrame:
    """(param, element, rhat) of draws (param, element, chain, draw, value)."""
    chains = draws.groupBy("param", "element", "chain").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    each = chains.groupBy("param", "element").agg(F.avg("n").alias("n"), F.var_samp("m").alias("b"), F.avg("v").alias("w"))
    return each.select("param", "element", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w")).alias("rhat"))


def trace(draws: DataFrame) -> DataFrame:
    """(param, chain, draw, value): mean over elements."""
    return draws.groupBy("param", "chain", "draw").agg(F.avg("value").alias("value"))


def width_correlation(a: DataFrame, b: DataFrame, keys: tuple = ("lon", "lat")) -> DataFrame:
    """Pearson correlation of the widths p95 - p05 and p75 - p25 of two surfaces joined on place, or on other keys where places repeat."""
    w = lambda d, k: d.select(*keys, (F.col("p95") - F.col("p05")).alias(f"w90_{k}"), (F.col("p75") - F.col("p25")).alias(f"w50_{k}"))
    both = w(a, "a").join(w(b, "b"), list(keys))
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("w90_a", "w90_b").alias("r90"), F.corr("w50_a", "w50_b").alias("r50"))


def rhat_by_index(draws: DataFrame, param: str) -> DataFrame:
    """(element, rhat) of one parameter, in order."""
    return rhat(draws.filter(F.col("param") == param)).select("element", "rhat").orderBy("element")


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of Pearson's r over n pairs: |t| with n - 2 degrees of freedom, by the continued fraction of the incomplete beta function."""
    if n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    if r == 0:
        return 1.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r  # of the beta law that 1 - r**2 follows
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + term * d)
                c = 1 + term / c
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def width_correlation_tests(a: DataFrame, b: DataFrame) -> list[dict]:
    """Correlation, number of places and p-value of each width: one row reaches the driver."""
    row = width_correlation(a, b).head()
    return [{"width": w, "r": row[c], "n": row["n"], "p_value": correlation_p_value(row[c], row["n"])} for w, c in (("p95-p05", "r90"), ("p75-p25", "r50")) if row[c] is not None]
