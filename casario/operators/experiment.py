"""Experiments and final training: folds by group, scenarios, paired arms, one model for each city and target, batch estimates.

The loops run over a handful of folds, arms or pairs; each step of them is a Spark job over its rows.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from math import isfinite

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting, features, metrics, modelling, training

#: What derives from the optional fees, the least rows that a served model is trained on.
DERIVED = {"condo_fee": ["condo_por_m2"], "iptu_tax": ["iptu_por_m2"]}
LEAST_ROWS = 100
WITHOUT_OPTIONALS = "sem_opcionais"


class NotTrainable(ValueError):
    """A pair has too few rows to train or none to measure on."""


@dataclass(frozen=True)
class Config:
    """One arm of an experiment. numbers and categories are the model's columns; the switches add steps before the fit.

    imputer: "medians" by group or "model" (boosted, from all columns but the optional fees). dropout: the share of training rows whose
    optional fees are masked at the fit, as users leave them out. kind: a Spark ML estimator's name, or "boosted" with the mean of
    ``seeds`` fits and quantile models.
    """

    name: str
    segment: str = "global"
    scenario: str = WITHOUT_OPTIONALS
    numbers: tuple[str, ...] = ("area_m2", "bedrooms", "condo_fee", "iptu_tax")
    categories: tuple[str, ...] = ()
    impute: bool = True
    imputer: str = "medians"
    dropout: float = 0.0
    kind: str = "gbt"
    seeds: int = 1
    encode: tuple[str, ...] = ()
    spatial: bool = False
    group: str = "grupo"
    twins: tuple[str, ...] = ("city", "neighborhood", "bedrooms", "area_m2")
    folds: int = 5
    seed: int = 20260829
    by: tuple[str, ...] = field(default=("city", "neighborhood"))


def in_scenario(df: DataFrame, scenario: str) -> DataFrame:
    """df as a user would ask: without the optional fees and what derives from them, or as it is."""
    if scenario == WITHOUT_OPTIONALS:
        for column, derived in DERIVED.items():
            if column in df.columns:
                df = modelling.erased(df, column, derived, F.lit(True))
    return df


def with_derived(df: DataFrame) -> DataFrame:
    """df with what derives from the fees made anew, as after an imputation."""
    return df.withColumns({d: F.try_divide(F.col(c), F.col("area_m2")) for c, ds in DERIVED.items() if c in df.columns for d in ds})


def one_of_twins(df: DataFrame, cfg: Config) -> DataFrame:
    """Copies of one property as one row: means of its numbers and price, first values of the rest."""
    means = [c for c in dict.fromkeys((*cfg.numbers, "price", *(d for ds in DERIVED.values() for d in ds))) if c in df.columns and c not in cfg.twins]
    firsts = [c for c in df.columns if c not in means and c not in cfg.twins]
    return training.fused(df, list(cfg.twins), [cfg.group, "property_id"], means, firsts).withColumn("log_price", F.ln("price"))


def prepared(train: DataFrame, test: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """train, and test with its twins fused and its scenario applied before anything is estimated; every step is fitted on train alone."""
    test = in_scenario(one_of_twins(test, cfg), cfg.scenario)
    if cfg.impute and cfg.imputer == "model":
        out = {*DERIVED, *(d for ds in DERIVED.values() for d in ds)}
        fields, numbers = [c for c in DERIVED if c in train.columns], [c for c in cfg.numbers if c not in out]
        places = [c for c in dict.fromkeys((*cfg.categories, *cfg.by)) if c in train.columns]
        both = modelling.imputed_by_model(train, train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True)), allowMissingColumns=True), fields, numbers, places, "property_id")
        both = training.written(both, "imputed")  # estimated once
        train, test = (with_derived(both.where(F.col("_test") == t).drop("_test")).select(d.columns) for t, d in ((False, train), (True, test)))
    elif cfg.impute:
        for column in DERIVED:
            if column in train.columns:
                test = modelling.imputed(train, test, column, list(cfg.by))
                train = modelling.imputed(train, train, column, list(cfg.by))
        train, test = with_derived(train), with_derived(test)
    if cfg.spatial:
        train, test = features.interactions(train), features.interactions(test)
    if cfg.encode:
        value = F.ln(F.col("price") / F.col("area_m2"))
        train, test = features.encoded(train, train, cfg.encode, value), features.encoded(train, test, cfg.encode, value)
    return train, test


def _columns(cfg: Config, df: DataFrame) -> list[str]:
    spatial = [c for c in ("geo_prod", "geo_soma", "geo_dif", "geo_raio") if cfg.spatial and c in df.columns]
    return [*cfg.numbers, *(f"te_{c}" for c in cfg.encode), *spatial]


def masked(train: DataFrame, share: float, seed: int) -> DataFrame:
    """train with the optional fees, what derives from them and their flags as unknown in a hashed share of the rows; one row loses all or none."""
    if share > 0:
        where = modelling.hashed_share(share, seed, "property_id")
        for column, derived in DERIVED.items():
            if column in train.columns:
                train = modelling.erased(train, column, derived, where)
    return train


def fitted(train: DataFrame, cfg: Config) -> PipelineModel | boosting.Model:
    numbers = _columns(cfg, train)
    rows = modelling.with_missing(masked(train, cfg.dropout, cfg.seed), numbers)
    if cfg.kind == "boosted":
        return modelling.fit_boosted(rows, "property_id", numbers, list(cfg.categories), cfg.seeds)
    return modelling.fit(rows, "property_id", numbers, list(cfg.categories), cfg.seed, cfg.kind)


def measured(model: PipelineModel | boosting.Model, test: DataFrame, cfg: Config) -> DataFrame:
    """One row of measures."""
    rows = modelling.predicted(model, modelling.with_missing(test, _columns(cfg, test)))
    return metrics.regression_metrics(rows.withColumn("y_log", F.ln("price")))


def with_folds(base: DataFrame, cfg: Config) -> DataFrame:
    """The rows of the segment outside the holdout, with base features and their fold; arms that are compared share these."""
    d = features.base_features(features.segment(base, cfg.segment).where(~F.col("_holdout"))).withColumn("log_price", F.ln("price"))
    return training.group_folds(d, cfg.group, "price", cfg.folds, cfg.seed)


def run(base: DataFrame, cfg: Config, dealt: DataFrame | None = None) -> DataFrame:
    """experimento, fold and the measures of each fold: fitted on the others' rows as they are, measured on its own with twins fused."""
    dealt = with_folds(base, cfg) if dealt is None else dealt
    out = None
    for k in range(cfg.folds):
        train, test = prepared(dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k), cfg)
        one = measured(fitted(train, cfg), test, cfg).select(F.lit(cfg.name).alias("experimento"), F.lit(k).alias("fold"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def holdout_measures(base: DataFrame, cfg: Config) -> DataFrame:
    """One row of measures on the holdout, for the arm that has been chosen: once."""
    d = features.base_features(features.segment(base, cfg.segment)).withColumn("log_price", F.ln("price"))
    train, test = prepared(d.where(~F.col("_holdout")), d.where("_holdout"), cfg)
    return measured(fitted(train, cfg), test, cfg)


def ablation(base: DataFrame, arms: list[Config], measure: str = "mae_log", alpha: float = 0.05) -> DataFrame:
    """experimento, media, diferenca to the first arm, p and promovido of arms on the same folds.

    An arm is promoted when it is better than the first one on average and its paired signed-rank test holds after
    correction for the number of arms.
    """
    dealt = with_folds(base, arms[0])
    spark = base.sparkSession
    found = {a.name: [r[measure] for r in run(base, a, dealt).orderBy("fold").collect()] for a in arms}  # arms x folds numbers
    first = found[arms[0].name]
    rest = {n: [x - y for x, y in zip(v, first, strict=True)] for n, v in found.items() if n != arms[0].name}
    p = {n: metrics.signed_rank(d) for n, d in rest.items()}
    held = dict(zip(p, metrics.benjamini_hochberg(list(p.values()), alpha), strict=True)) if p else {}
    mean = lambda v: sum(v) / len(v)
    rows = [(n, float(mean(v)), float(mean(rest[n])) if n in rest else 0.0, float(p.get(n, 1.0)), bool(held.get(n, False) and mean(rest[n]) < 0)) for n, v in found.items()]
    return spark.createDataFrame(rows, "experimento string, media double, diferenca double, p double, promovido boolean")


def logged(measures: DataFrame, cfg: Config, path: str) -> None:
    """Appends an experiment's mean measures and its settings to a log of JSON lines; no line is ever replaced."""
    names = [c for c in measures.columns if c not in ("experimento", "fold")]
    line = measures.agg(*(F.avg(c).alias(c) for c in names), F.count("*").alias("n_folds")).select(F.lit(cfg.name).alias("experimento"), F.lit(str(asdict(cfg))).alias("config"), F.current_timestamp().alias("quando"), "*")
    line.write.mode("append").json(path)


def leaderboard(log: DataFrame, measure: str = "mae_log") -> DataFrame:
    """The lines of the log, the best first."""
    return log.orderBy(F.asc_nulls_last(measure), "quando")


def train_pair(abt: DataFrame, holdout: DataFrame, city: str, target: str, cfg: Config) -> tuple[PipelineModel | boosting.Model, DataFrame, DataFrame]:
    """The model of one city and target, its measures on the holdout (one row), and its training rows; a pair that can't be served is refused."""
    own = lambda d, out: features.city_cut(d.where(F.col("transaction_type") == target), city).withColumns({"_holdout": F.lit(out), "log_price": F.ln("price")})
    train, test = own(abt, False), own(holdout, True)
    n = train.count()
    if n < LEAST_ROWS:
        raise NotTrainable(f"{city}/{target}: {n} rows to train on, {LEAST_ROWS} are the least that is served")
    if test.isEmpty():
        raise NotTrainable(f"{city}/{target}: nothing to measure on")
    a, b = prepared(features.base_features(train), features.base_features(test), cfg)
    model = fitted(a, cfg)
    return model, measured(model, b, cfg), train


def estimates(requests: DataFrame, model: PipelineModel | boosting.Model, cfg: Config, quantiles: DataFrame | None, group: str, limits: tuple[float, float] | None, index: DataFrame | None) -> DataFrame:
    """requests with previsto, lo, hi, rent by the city's yield (sales alone) and ressalvas.

    limits: prices between which the model was trained; quantiles: residual_quantiles of its calibration rows (a boosted model has its own); index: city
    and its yields (yield_mensal, yield_p10, yield_p90), a row a city.
    """
    from .serving import rent_anchor

    numbers = _columns(cfg, requests)
    out = modelling.predicted(model, modelling.with_missing(requests, numbers))
    out = modelling.quantile_interval(out) if isinstance(model, boosting.Model) else modelling.with_interval(out, quantiles, group)
    out = out.withColumns({c: F.round(c, 2) for c in ("previsto", "lo", "hi")})
    notes: list[Column] = []
    if limits:
        notes.append(F.when(~F.col("previsto").between(*limits), F.lit("fora_da_faixa_treinada")))
    if index is not None:
        out = rent_anchor(out.join(index, "city", "left"), "previsto", "lo", "hi")
        sale = F.col("transaction_type") == "venda"
        out = out.withColumns({c: F.when(sale, F.col(c)) for c in ("aluguel", "aluguel_lo", "aluguel_hi", "motivo")})
        notes.append(F.col("motivo"))
    return out.withColumn("ressalvas", F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>"))


def synthetic_case(spark, model: boosting.Model, cfg: Config) -> DataFrame:
    """One request in the middle of what a boosted model was fitted on: each number at its middle cut, each category at its first level."""
    middle = {c: v[len(v) // 2] if v else None for c, v in model.bins.numbers.items() if not c.startswith("aus_")}
    first = {c: v[0] if v else None for c, v in model.bins.categories.items()}
    row = spark.range(1).select(*(F.lit(v).cast("double").alias(c) for c, v in middle.items()), *(F.lit(v).cast("string").alias(c) for c, v in first.items()))
    return modelling.with_missing(row, [c for c in _columns(cfg, row) if c in row.columns])


def ready(spark, model: boosting.Model, cfg: Config) -> bool:
    """Whether a loaded model answers a synthetic request with a finite, positive estimate inside its interval: asked before it serves."""
    out = modelling.quantile_interval(modelling.predicted(model, synthetic_case(spark, model, cfg))).select("lo", "previsto", "hi").first()
    return all(v is not None and isfinite(v) and v > 0 for v in out) and out.lo <= out.previsto <= out.hi
