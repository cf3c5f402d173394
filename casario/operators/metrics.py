"""Measures of predictions: errors, calibration, coverage of intervals, paired tests."""

from __future__ import annotations

from math import erf, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import deciles, percentiles, ranges_of, written


def _row_of_percentiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row of exact percentiles (name: value and share) over all rows."""
    shares = {f"s{i}": s for i, s in enumerate(sorted({s for _, s in wanted.values()}))}
    of = {s: k for k, s in shares.items()}
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("_what"), v.cast("double").alias("_value")) for k, (v, _) in wanted.items()))).alias("x")).select("x.*")
    return percentiles(long, ["_what"], "_value", shares, few=True).agg(*(F.max(F.when(F.col("_what") == k, F.col(of[s]))).alias(k) for k, (_, s) in wanted.items()))


def regression_metrics(df: DataFrame, y: str = "y_log", p: str = "p_log", price: str = "price") -> DataFrame:
    """One row of twelve measures of predictions of log prices."""
    e, guess = F.col(p) - F.col(y), F.exp(F.col(p))
    rel, brl = F.abs(guess - F.col(price)) / F.col(price), guess - F.col(price)
    means = df.agg(
        F.avg(F.abs(e)).alias("mae_log"), F.sqrt(F.avg(e * e)).alias("rmse_log"),
        F.sqrt(F.avg(brl * brl)).alias("rmse_brl"), F.avg(F.abs(brl)).alias("mae_brl"),
        F.avg((rel <= 0.10).cast("double")).alias("within_10"), F.avg((rel <= 0.20).cast("double")).alias("within_20"),
        F.avg(e).alias("bias_log"), F.avg(brl).alias("bias_brl"),
    )
    ranks = _row_of_percentiles(df, {"mdape": (rel, 0.5), "p90_ape": (rel, 0.9), "bias_median_brl": (brl, 0.5), "bias_median_log": (e, 0.5)})
    return means.crossJoin(ranks).select("mae_log", "rmse_log", "mdape", "p90_ape", "rmse_brl", "mae_brl", "within_10", "within_20", "bias_log", "bias_brl", "bias_median_brl", "bias_median_log")


def decile_calibration(df: DataFrame, p: str, real: str, tie: str) -> DataFrame:
    """decil, n, median prediction and median value by decile of the prediction."""
    binned = deciles(df.select(F.col(p).alias("previsto"), F.col(real).alias("real"), F.col(tie).alias("_tie")), ["previsto", "_tie"])
    sizes = written(binned.groupBy("decil").agg(F.count("*").alias("n")), "sizes")  # ten rows, and the number of all
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("_what"), F.col(c).cast("double").alias("_value")) for c in ("previsto", "real"))))
    long = binned.select("decil", both.alias("x")).select("decil", "x.*")
    ranges = ranges_of(long, 2 * (sizes.agg(F.sum("n")).first()[0] or 0))
    medians = percentiles(long, ["decil", "_what"], "_value", {"_median": 0.5}, ranges, few=True)
    medians = medians.groupBy("decil").agg(*(F.max(F.when(F.col("_what") == k, F.col("_median"))).alias(k) for k in ("previsto", "real")))
    return sizes.join(medians, "decil", "left").select("decil", "n", "previsto", "real")


def interval(df: DataFrame, low: str, centre: str, high: str) -> DataFrame:
    """df with lo, hi (in order and holding the centre) and whether the quantiles crossed."""
    return df.withColumns({"lo": F.least(low, centre, high), "hi": F.greatest(low, centre, high), "cruzou": F.col(low) > F.col(high)})


def coverage(df: DataFrame, real: str) -> DataFrame:
    """Share inside, median width (absolute and relative) and crossings of interval()'s rows."""
    shares = df.agg(F.avg(F.col(real).between(F.col("lo"), F.col("hi")).cast("double")).alias("cobertura"), F.count_if("cruzou").alias("cruzamentos"))
    width = F.col("hi") - F.col("lo")
    ranks = _row_of_percentiles(df, {"largura_mediana": (width, 0.5), "largura_pct": (width / F.col(real), 0.5)})
    return shares.crossJoin(ranks).select("cobertura", "largura_mediana", "largura_pct", "cruzamentos")


def fold_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and standard error of each group's folds."""
    return df.groupBy(*by).agg(F.avg(value).alias("media"), F.stddev_samp(value).alias("dp"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("ep"), F.count(value).alias("n"))


def signed_rank(differences: list[float]) -> float:
    """Two-sided p of Wilcoxon's signed-rank test by the normal approximation, zeros split; for a few dozen paired folds."""
    order = sorted(range(len(differences)), key=lambda i: abs(differences[i]))
    rank, i = [0.0] * len(order), 0
    ties = 0.0
    while i < len(order):
        j = i
        while j < len(order) and abs(differences[order[j]]) == abs(differences[order[i]]):
            rank[order[j]] = 0.0
            j += 1
        for k in order[i:j]:
            rank[k] = (i + j + 1) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    n, zeros = len(order), sum(d == 0 for d in differences)
    zero_ranks = sum(r for r, d in zip(rank, differences, strict=True) if d == 0)
    w = sum(r for r, d in zip(rank, differences, strict=True) if d > 0) + zero_ranks / 2
    mean = n * (n + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - zeros * (zeros + 1) * (2 * zeros + 1)) / 24 - ties / 48 + (zeros**3 - zeros) / 48
    return 1.0 if var <= 0 else min(1.0, 2 * (1 - 0.5 * (1 + erf(abs(w - mean) / sqrt(var) / sqrt(2)))))


def benjamini_hochberg(p: list[float], alpha: float = 0.05) -> list[bool]:
    """Which hypotheses are rejected at a false discovery rate of alpha."""
    order = sorted(range(len(p)), key=p.__getitem__)
    last = max((k for k, i in enumerate(order, 1) if p[i] <= alpha * k / len(p)), default=0)
    return [i in set(order[:last]) for i in range(len(p))]
