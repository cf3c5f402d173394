"""Monthly history: one row per property and month from daily observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class EmptyResult(ValueError):
    """Zero rows where the pipeline must have some."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or EmptyResult when it has no rows; reads no more than one."""
    if df.isEmpty():
        raise EmptyResult(f"{what}: no rows")
    return df


def collapse_month(df: DataFrame, keys: list[str], date: str = "extraction_date", tie: str = "tie", price: str = "price") -> DataFrame:
    """The last whole row of each key by (date, tie), with first and last known price, days observed and whether the price changed.

    One aggregation without a window: the row, prices and days are partial aggregates. As a whole row is no fixed-width
    state, Spark aggregates sorted rows, within each task before the shuffle and after it. Days are a set, of a month's length
    at most: a distinct count would shuffle the whole rows once more.

    Date, tie and price are shuffled as one struct in the last row, the last and first known price and the order of the other
    columns: equal bytes side by side, which the shuffle's compression finds, where a row has no twin in its task. Rows of one
    date and tie go by price, null as the least.
    """
    point = F.struct(F.col(date).alias("date"), F.col(tie).alias("tie"), F.col(price).alias("price"))
    known = F.when(F.col(price).isNotNull(), point)
    held = {date: "_end.date", tie: "_end.tie", price: "_end.price"}
    rest = [c for c in df.columns if c not in keys and c not in held]
    out = df.groupBy(*keys).agg(
        *([F.max_by(F.struct(*rest), point).alias("_rest")] if rest else []),
        F.max(point).alias("_end"),
        F.max(known).alias("_last"),
        F.min(known).alias("_first"),
        F.size(F.collect_set(date)).cast("long").alias("n_dias_observado"),
        F.coalesce(F.min(price) != F.max(price), F.lit(False)).alias("preco_mudou_no_mes"),
    )
    row = [F.col(held.get(c, f"_rest.{c}")).alias(c) for c in df.columns if c not in keys]
    return out.select(*keys, *row, F.col("_first.price").alias("preco_primeiro"), F.col("_last.price").alias("preco_ultimo"), "n_dias_observado", "preco_mudou_no_mes")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by order (Spark prunes each task's groups to one row before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def build_month(df: DataFrame, month: str = "mes_referencia", source: str = "source_domain", tie: str = "tie") -> DataFrame:
    """Each source's month collapsed, then one source per property and month: the latest date, then the last source by name.

    Counts of days stay the winning source's. Two shuffles, as each begins with a partial step: dealing the observations by property
    and month alone would save the second, but bring all sources of a frequent property and month to one task.
    """
    own = collapse_month(df, [month, source, "property_id"], tie=tie)
    return last_per_key(own, [month, "property_id"], [F.desc("extraction_date"), F.desc(source)])


def only_cities(df: DataFrame, cities: DataFrame, key: str, keep_null: bool) -> DataFrame:
    """Rows whose key is in cities; rows of a null key stay only if keep_null (ingestion keeps them, history doesn't)."""
    inside = df.join(cities.select(key).distinct(), key, "left_semi")
    return inside.unionByName(df.where(F.col(key).isNull())) if keep_null else inside


def not_seen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been collected yet."""
    return df.join(seen.select(*keys), keys, "left_anti")


def first_new(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each group by order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= limit).drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new; columns by name, missing ones null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
