"""Price models on log prices, intervals, imputation, spatial axes, dropout.

Two kinds of models: Spark ML's trees (``fit``), whose interval comes from residual quantiles on rows held out from the fit (split
conformal), by group where a group has enough of them; and boosted histograms (``fit_boosted``) with quantile models of their own,
native categories and the mean of several seeds, whose interval is the quantile models' (``quantile_interval``).
"""

from __future__ import annotations

from math import exp, fsum, lgamma, log, log1p, sqrt
from statistics import NormalDist

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import boosting

#: Estimators by name; users add their own with estimator().
ESTIMATORS: dict = {}


def estimator(name: str):
    """Registers a factory of an estimator (labelCol, seed, rounds, depth, bins); a name has one."""
    def keep(f):
        if name in ESTIMATORS:
            raise ValueError(f"{name} is taken")
        ESTIMATORS[name] = f
        return f

    return keep


@estimator("gbt")
def _gbt(label: str, seed: int, rounds: int, depth: int, bins: int):
    return GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, maxBins=bins, seed=seed, validationIndicatorCol="_early")


@estimator("forest")
def _forest(label: str, seed: int, rounds: int, depth: int, bins: int):
    return RandomForestRegressor(labelCol=label, numTrees=rounds, maxDepth=depth, maxBins=bins, seed=seed)


def price_model(numbers: list[str], categories: list[str], seed: int = 42, rounds: int = 20, depth: int = 5, bins: int = 64, kind: str = "gbt") -> Pipeline:
    """Numbers imputed by their medians with a flag each, categories with the levels seen at the fit (others are a level of their own)."""
    stages = [StringIndexer(inputCols=categories, outputCols=[f"{c}_ix" for c in categories], handleInvalid="keep")] if categories else []
    stages += [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}_im" for c in numbers])]
    stages += [VectorAssembler(inputCols=[f"{c}_im" for c in numbers] + [f"aus_{c}" for c in numbers] + [f"{c}_ix" for c in categories], outputCol="features")]
    return Pipeline(stages=[*stages, ESTIMATORS[kind]("log_price", seed, rounds, depth, bins)])


def with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with numbers as doubles, aus_<column> (1 where unknown) and n_campos_ausentes.

    A flag that is there stays: it tells what was unknown before an imputation.
    """
    flags = {f"aus_{c}": (F.col(f"aus_{c}") if f"aus_{c}" in df.columns else F.col(c).isNull()).cast("double") for c in columns}
    df = df.withColumns(flags).withColumns({c: F.col(c).cast("double") for c in columns})
    return df.withColumn("n_campos_ausentes", sum((F.col(f) for f in flags), F.lit(0.0)))


def erased(df: DataFrame, column: str, derived: list[str], where) -> DataFrame:
    """df with a field unknown in chosen rows, with what is derived from it, its flag and the count of flags."""
    out = {c: F.when(~where, F.col(c)) for c in (column, *derived) if c in df.columns}
    flags = [c for c in df.columns if c.startswith("aus_")]
    if f"aus_{column}" in flags:
        flag = F.col(f"aus_{column}")
        out[f"aus_{column}"] = F.when(where, F.lit(1).cast(df.schema[f"aus_{column}"].dataType)).otherwise(flag)
    df = df.withColumns(out)
    return df.withColumn("n_campos_ausentes", sum((F.col(f).cast("double") for f in flags), F.lit(0.0))) if flags else df


def hashed_share(share: float, seed: int, *columns: str):
    """True for about `share` of the rows, by hash: the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_000)) < int(share * 1_000_000)


def fit(df: DataFrame, id_col: str, numbers: list[str], categories: list[str], seed: int = 42, kind: str = "gbt") -> PipelineModel:
    """The model of df (with log_price and with_missing's columns); a hashed 15 % stops the boosting early."""
    return price_model(numbers, categories, seed, kind=kind).fit(df.withColumn("_early", hashed_share(0.15, seed, id_col)))


def fit_boosted(df: DataFrame, id_col: str, numbers: list[str], categories: list[str], n_seeds: int = 1, quantiles: tuple[float, ...] = (0.1, 0.9), settings: boosting.Settings | None = None) -> boosting.Model:
    """The central model of log_price (the mean of n_seeds fits) and one for each quantile, grown together over one binned table."""
    members = [*boosting.seeds("p_log", n_seeds), *(boosting.Member(f"q{round(q * 100)}_log", boosting.QUANTILE, q) for q in quantiles)]
    return boosting.fit(df, "log_price", [*numbers, *(f"aus_{c}" for c in numbers)], categories, members, [id_col], settings)


def predicted(model: PipelineModel | boosting.Model, df: DataFrame) -> DataFrame:
    """df with p_log, and with q<percent>_log for each quantile model."""
    if isinstance(model, boosting.Model):
        return boosting.predicted(model, df)
    return model.transform(df.withColumn("_early", F.lit(False))).drop("features", "_early").withColumnRenamed("prediction", "p_log")


def quantile_interval(df: DataFrame, low: str = "q10_log", high: str = "q90_log") -> DataFrame:
    """df with previsto, lo and hi in currency from the quantile models; crossed quantiles change places, the estimate lies within."""
    centre, a, b = F.exp("p_log"), F.exp(low), F.exp(high)
    return df.withColumns({"previsto": centre, "lo": F.least(a, b, centre), "hi": F.greatest(a, b, centre)})


def residual_quantiles(calibration: DataFrame, group: str, least: int = 50) -> DataFrame:
    """group, q10, q90 of residuals y_log - p_log by group; the row of a null group is for groups of fewer rows.

    Exact percentiles over ranges of the residuals, so that neither a large group nor the whole table meets in one task.
    """
    from .training import percentiles

    kind = calibration.schema[group].dataType
    rows = calibration.select(F.col(group).alias("_g"), (F.col("y_log") - F.col("p_log")).alias("_r")).where("_r IS NOT NULL")
    large = rows.where("_g IS NOT NULL").groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_g")
    shares = {"q10": 0.1, "q90": 0.9}
    own = percentiles(rows.join(large, "_g", "left_semi"), ["_g"], "_r", shares)
    whole = percentiles(rows.withColumn("_g", F.lit(0)), ["_g"], "_r", shares).withColumn("_g", F.lit(None).cast(kind))
    return own.unionByName(whole).withColumnRenamed("_g", group)


def with_interval(df: DataFrame, quantiles: DataFrame, group: str) -> DataFrame:
    """df with previsto, lo and hi in currency."""
    whole = quantiles.where(F.col(group).isNull()).select(F.col("q10").alias("_a"), F.col("q90").alias("_b"))
    out = df.join(quantiles.where(F.col(group).isNotNull()), group, "left").join(F.broadcast(whole), F.lit(True))  # one row
    centre = F.exp("p_log")
    lo, hi = F.exp(F.col("p_log") + F.coalesce("q10", "_a")), F.exp(F.col("p_log") + F.coalesce("q90", "_b"))
    return out.withColumns({"previsto": centre, "lo": F.least(lo, hi, centre), "hi": F.greatest(lo, hi, centre)}).drop("q10", "q90", "_a", "_b")


def rotated(train: DataFrame, df: DataFrame, x: str, y: str, least: int = 50) -> DataFrame:
    """df with eixo_1, eixo_2: x and y on the principal axes of train's points; unchanged where train has too few."""
    known = train.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n, mx, my = known.agg(F.count("*"), F.avg(x), F.avg(y)).first()
    if n <= least:
        return df.withColumns({"eixo_1": F.col(x), "eixo_2": F.col(y)})
    centred = lambda d: d.withColumns({"_x": F.col(x) - mx, "_y": F.col(y) - my})
    pca = Pipeline(stages=[VectorAssembler(inputCols=["_x", "_y"], outputCol="_v", handleInvalid="keep"), PCA(k=2, inputCol="_v", outputCol="_r")]).fit(centred(known))
    out = pca.transform(centred(df)).withColumn("_r", vector_to_array("_r"))
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    return out.withColumns({"eixo_1": F.when(ok, F.col("_r")[0]), "eixo_2": F.when(ok, F.col("_r")[1])}).drop("_x", "_y", "_v", "_r")


def imputed(train: DataFrame, df: DataFrame, field: str, by: list[str], least: int = 60) -> DataFrame:
    """df with unknown values of field from train's medians by ever fewer keys of `by`, the first of enough rows winning."""
    for n in range(len(by), -1, -1):
        keys = by[:n]
        known = train.where(F.col(field).isNotNull()).groupBy(*keys).agg(F.expm1(F.median(F.log1p(field))).alias("_v"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
        df = (df.join(known, keys, "left") if keys else df.join(F.broadcast(known), F.lit(True), "left")).withColumn(field, F.coalesce(F.col(field), F.col("_v"))).drop("_v")
    return df


def imputed_by_model(train: DataFrame, df: DataFrame, fields: list[str], numbers: list[str], categories: list[str], id_col: str, least: int = 60, settings: boosting.Settings | None = None) -> DataFrame:
    """df with unknown values of the fields from a model of each field's logarithm, fitted on train's rows that know it.

    numbers and categories must hold neither the fields nor what derives from them. A row whose value is unknown has no part in the
    fit, so estimates are out of sample in train too. A field known (and positive) in fewer than ``least`` rows stays as it is.
    """
    s = settings or boosting.Settings(rounds=25, rate=0.3, depth=4, least=30)
    for field in fields:
        known = train.where(F.col(field) > 0).withColumn("_log", F.ln(F.col(field)))
        if known.limit(least).count() < least:
            continue
        model = boosting.fit(known, "_log", numbers, categories, [boosting.Member("_estimate")], [id_col], s)
        df = boosting.predicted(model, df).withColumn(field, F.coalesce(F.col(field).cast("double"), F.exp("_estimate"))).drop("_estimate")
    return df


def _resampled_rank(n: int, q: float) -> int:
    """The least k for which the median of a resample of n values is at most the kth of them with a chance of q or more.

    A resample's (lower) median is at most the kth value when at least half of its n draws are, each with a chance of k / n: a
    binomial tail, summed for n up to 2,000 and taken as normal beyond.
    """
    half = (n + 1) // 2

    def chance(k: int) -> float:
        p = k / n
        if p <= 0 or p >= 1:
            return float(p >= 1)
        if n > 2_000:
            return 1 - NormalDist(n * p, sqrt(n * p * (1 - p))).cdf(half - 0.5)
        return fsum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(half, n + 1))

    lo, hi = 1, n
    while lo < hi:
        k = (lo + hi) // 2
        lo, hi = (lo, k) if chance(k) >= q else (k + 1, hi)
    return lo


def bootstrap_median(df: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """lo and hi: the interval of the median that resampling without end would give (one row; nulls without values).

    Where a resample's median falls depends on ranks alone, so the interval's ends are two order statistics: no row is copied
    or drawn, and the ranks are found by ranges.
    """
    from .training import percentiles

    rows = df.where(F.col(value).isNotNull()).select(F.lit(0).alias("_g"), F.col(value).cast("double").alias("_v"))
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([(None, None)], "lo double, hi double")
    at = {name: (_resampled_rank(n, q) - 1) / max(n - 1, 1) for name, q in (("lo", (1 - share) / 2), ("hi", (1 + share) / 2))}
    return percentiles(rows, ["_g"], "_v", at).select("lo", "hi")


def shuffled_rank(df: DataFrame, by: list[str], seed: int, *columns: str) -> DataFrame:
    """df with its place in a seeded order within each group."""
    return df.withColumn("posicao", F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *columns), *columns)))
