"""Orders, samples and listings that the read API and the reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import folds


def market_order(df: DataFrame, city: str = "cidade", place: str = "bairro", month: str = "mes_referencia") -> DataFrame:
    """By city, neighbourhood and month, unknown ones last."""
    return df.orderBy(*(F.asc_nulls_last(c) for c in (city, place, month)))


def by_city_and_size(df: DataFrame, city: str = "cidade", n: str = "n_anuncios") -> DataFrame:
    """By city, its places with the most listings first."""
    return df.orderBy(F.asc_nulls_last(city), F.desc_nulls_last(n))


def of_city(df: DataFrame, name: str | None, column: str = "cidade") -> DataFrame:
    """The rows of one city by its slug (all, without a name)."""
    if not name:
        return df
    cities = df.select(F.col(column).alias("_c")).distinct().where(folds.fold(F.col("_c"), "slug") == folds.slug(name))
    return df.join(cities, df[column] == cities["_c"], "left_semi")


def neighbourhood_view(market: DataFrame, city: str | None = None, with_point: bool = False) -> DataFrame:
    """The neighbourhoods that the map shows, those of the most listings first within a city."""
    found = of_city(market, city)
    columns = ("cidade", "uf", "bairro", "mes_referencia", "n_anuncios", "preco_mediano", "preco_p10", "preco_p90", "preco_m2_mediano", "lat", "lon", "cep_prefixo", "ipca_12m", "recorte_ipca")
    found = found.where("lat IS NOT NULL") if with_point else found
    return by_city_and_size(found.select(*(c for c in columns if c in found.columns)))


def neighbourhood_totals(market: DataFrame, city: str | None = None, with_point: bool = False) -> DataFrame:
    """One row: n shown, n_total and sem_coordenada."""
    n = F.count_if(F.col("lat").isNotNull()) if with_point else F.count("*")
    return of_city(market, city).agg(n.alias("n"), F.count("*").alias("n_total"), F.count_if(F.col("lat").isNull()).alias("sem_coordenada"))


def tail_per_group(df: DataFrame, by: list[str], order: str, k: int = 1) -> DataFrame:
    """The last k rows of each group by order, in that order."""
    w = W.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank").orderBy(*by, order)


def of_state(catalogue: DataFrame, state: str) -> DataFrame:
    """The target cities of one state of collection."""
    return catalogue.where(F.col("estado") == state)


def catalogue_summary(catalogue: DataFrame) -> DataFrame:
    """One row: total, cities by state of collection, and the sorted federal units."""
    return catalogue.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("estado") == s).alias(s) for s in ("coletando", "inventariando", "a_inventariar")), F.sort_array(F.collect_set("uf")).alias("ufs"))
