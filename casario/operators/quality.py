"""Operational reports: fill rates, counts by place and month, checks of the lake, places near others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F


def _filled(df: DataFrame, c: str):
    kind = df.schema[c].dataType
    ok = F.col(c).isNotNull()
    if isinstance(kind, T.StringType):
        ok = ok & (F.col(c) != "")
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        ok = ok & (F.size(c) > 0)
    return ok


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """campo, preenchido (share of rows with a value; empty text and lists have none) and n, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.avg(_filled(df, c).cast("double")).alias(c) for c in columns))
    return one.unpivot("_n", columns, "campo", "preenchido").select("campo", "preenchido", F.col("_n").alias("n"))


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """campo and n_nulos of each column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).unpivot([], columns, "campo", "n_nulos")


def counts_by_month(df: DataFrame, rows: str, months: list[str], month: str = "mes_referencia") -> DataFrame:
    """Rows of each key by month, one column a month, 0 where there are none."""
    return df.where(F.col(month).isin(months)).groupBy(rows).pivot(month, months).count().na.fill(0)


def counts_by_target(df: DataFrame, targets: DataFrame, keys: list[str], month: str = "mes_referencia") -> DataFrame:
    """Rows and last month of each target (a row of keys), 0 where nothing was collected."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(month).alias("ultimo_mes"))
    return targets.select(*keys).distinct().join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def layer_health(files: DataFrame, layer: str) -> DataFrame:
    """verificacao, ok, detalhe of a layer's files (linhas; -1: unreadable): some, all readable, none empty."""
    one = files.agg(F.count("*").alias("n"), F.count_if(F.col("linhas") < 0).alias("bad"), F.count_if(F.col("linhas") == 0).alias("empty"))
    check = lambda what, ok, n: F.struct(F.lit(f"{layer}_{what}").alias("verificacao"), ok.alias("ok"), n.cast("double").alias("detalhe"))
    return one.select(F.explode(F.array(check("arquivos", F.col("n") > 0, F.col("n")), check("ilegiveis", F.col("bad") == 0, F.col("bad")), check("vazios", F.col("empty") == 0, F.col("empty")))).alias("x")).select("x.*")


def thin_neighbourhoods(df: DataFrame, place: str = "neighborhood", least: int = 30) -> DataFrame:
    """place and n of the places with fewer than `least` rows, which a card names."""
    return df.where(F.col(place).isNotNull()).groupBy(place).agg(F.count("*").alias("n")).where(F.col("n") < least)


def health(df: DataFrame, month: str, critical: list[str], least: float = 0.9) -> DataFrame:
    """verificacao, ok, detalhe: rows present, the month present, critical columns filled."""
    one = df.agg(F.count("*").alias("n"), F.count_if(F.col("mes_referencia") == month).alias("m"), *(F.avg(_filled(df, c).cast("double")).alias(f"f_{c}") for c in critical))
    checks = [F.struct(F.lit("linhas").alias("verificacao"), (F.col("n") > 0).alias("ok"), F.col("n").cast("double").alias("detalhe")), F.struct(F.lit("mes_atual").alias("verificacao"), (F.col("m") > 0).alias("ok"), F.col("m").cast("double").alias("detalhe"))]
    checks += [F.struct(F.lit(f"preenchimento_{c}").alias("verificacao"), F.coalesce(F.col(f"f_{c}") >= least, F.lit(False)).alias("ok"), F.col(f"f_{c}").alias("detalhe")) for c in critical]
    return one.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def changed(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct values before and after, rows changed and new nulls of one column."""
    both = before.select(key, F.col(column).alias("_a")).join(after.select(key, F.col(column).alias("_b")), key)
    return both.agg(F.count_distinct("_a").alias("antes"), F.count_distinct("_b").alias("depois"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mudou"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("novos_nulos"))


def card_limits(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """campo, p01, p99, minimo, maximo of the columns with at least `least` known values."""
    from .training import percentiles

    aggs = [F.struct(F.lit(c).alias("campo"), F.min(F.col(c).cast("double")).alias("minimo"), F.max(F.col(c).cast("double")).alias("maximo"), F.count(c).alias("n")).alias(f"_{c}") for c in columns]
    ends = df.agg(*aggs).select(F.explode(F.array(*(f"_{c}" for c in columns))).alias("x")).select("x.*").where(F.col("n") >= least)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("campo"), F.col(c).cast("double").alias("_value")) for c in columns))).alias("x")).select("x.*")
    return ends.join(percentiles(long, ["campo"], "_value", {"p01": 0.01, "p99": 0.99}), "campo").select("campo", "p01", "p99", "minimo", "maximo", "n")
