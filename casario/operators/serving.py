"""The tables that the read API serves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .history import last_per_key


def newest(market: DataFrame, keys: list[str], month: str = "mes_referencia") -> DataFrame:
    """The latest row of each place."""
    return last_per_key(market, keys, [F.desc(month)])


def one_month(market: DataFrame, month: str, column: str = "mes_referencia") -> DataFrame:
    """The rows of one month; none is an error."""
    found = market.where(F.col(column) == month)
    if found.isEmpty():
        raise LookupError(f"no market table for {month}")
    return found


def city_rollup(market: DataFrame) -> DataFrame:
    """Neighbourhoods, listings and medians of medians by city."""
    return market.groupBy("city").agg(F.count_distinct("neighborhood").alias("n_bairros"), F.sum("n_anuncios").alias("n_anuncios"), F.median("preco_mediano").alias("preco_mediano"), F.median("preco_m2_mediano").alias("preco_m2_mediano"))


def city_view(market: DataFrame, index_columns: list[str]) -> DataFrame:
    """city_rollup with the index columns of each city's latest row."""
    index = newest(market.select("city", "mes_referencia", *index_columns).distinct(), ["city"])
    return city_rollup(market).join(index, "city", "left")


def terciles(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with faixa: abaixo, media or acima within its group; null below three known values or where value is."""
    w = W.partitionBy(by)
    q = F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).over(w)
    label = F.when(F.col(value) <= F.col("_q")[0], "abaixo").when(F.col(value) >= F.col("_q")[1], "acima").otherwise("media")
    return df.withColumns({"_q": q, "_n": F.count(value).over(w)}).withColumn("faixa", F.when((F.col("_n") >= 3) & F.col(value).isNotNull(), label)).drop("_q", "_n")


def scaled_by_group(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """df with value scaled to 0..1 in its group; 0.5 in a constant group, null where unknown."""
    w = W.partitionBy(by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.when(F.col(value).isNull(), None).when(hi == lo, F.lit(0.5)).otherwise((F.col(value) - lo) / (hi - lo)))


def summary(df: DataFrame) -> DataFrame:
    """One row of counts over neighbourhood rows."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("faixa") == "acima").alias("acima"), F.count_if(F.col("faixa") == "abaixo").alias("abaixo"), F.count_distinct("city").alias("cidades"), F.sum("n_anuncios").alias("anuncios"))


def city_index(index: DataFrame, city: str, month: str) -> DataFrame:
    """One row a city from its latest index row: percentages, yearly yield, months and first month."""
    months = index.groupBy(city).agg(F.count_distinct(month).alias("n_meses"), F.min(month).alias("primeiro_mes"))
    last = newest(index, [city], month)
    return last.join(months, city).select(city, month, "n_meses", "primeiro_mes", "venda_m2", (F.col("yield_mensal") * 100).alias("yield_pct"), ((F.pow(1 + F.col("yield_mensal"), 12) - 1) * 100).alias("yield_anual_pct"))


def rent_anchor(df: DataFrame, price: str, low: str, high: str) -> DataFrame:
    """Rent by the city's yield with its envelope (missing p10, p90 fall back to the yield); reason where there is none."""
    lo, hi = F.col(low) * F.coalesce("yield_p10", "yield_mensal"), F.col(high) * F.coalesce("yield_p90", "yield_mensal")
    return df.withColumns({"aluguel": F.col(price) * F.col("yield_mensal"), "aluguel_lo": lo, "aluguel_hi": hi, "largura_do_envelope": hi - lo, "motivo": F.when(F.col("yield_mensal").isNull(), "sem_yield")})


def relative_to_inflation(value: str, inflation: str):
    """Growth in percent beyond inflation in percent."""
    return ((1 + F.col(value) / 100) / (1 + F.col(inflation) / 100) - 1) * 100


def top(df: DataFrame, order: str, k: int) -> DataFrame:
    """The k rows of greatest value."""
    return df.orderBy(F.desc_nulls_last(order), *[c for c in df.columns if c != order]).limit(k)


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """Position and rows of the k first of each group."""
    return df.withColumn("posicao", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("posicao") <= k)


def _binned(df: DataFrame, value: str, cuts) -> DataFrame:
    """df with faixa_cor: the place of the first cut that the value doesn't exceed (their number, if it exceeds all); null without a value.

    cuts makes them, in order, from the least and greatest known value.
    """
    made = cuts(F.col("_lo"), F.col("_hi"))
    above = F.lit(len(made))
    for i in reversed(range(len(made))):
        above = F.when(F.col(value) <= made[i], i).otherwise(above)
    edges = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))  # one row
    return df.join(F.broadcast(edges), F.lit(True)).withColumn("faixa_cor", F.when(F.col(value).isNotNull(), above.cast("int"))).drop("_lo", "_hi")


def width_bins(df: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """df with faixa_cor: bins of equal width between the least and the greatest value; a cut itself belongs to the lower one."""
    def cuts(lo, hi):
        step = F.when(hi > lo, (hi - lo) / bins).otherwise(1.0)
        return [lo + i * step for i in range(1, bins)]

    return _binned(df, value, cuts)


def diverging_bins(df: DataFrame, value: str, pivot: float = 0.0) -> DataFrame:
    """df with faixa_cor: five bins around a pivot, the middle one a tenth of either side wide; a cut itself belongs to the lower one.

    Fixed values: the cuts lie at 0.45 of the way from the least value to the pivot, 0.10 before and after the pivot, and 0.50 beyond it.
    """
    def cuts(lo, hi):
        below, beyond = F.greatest(F.lit(pivot) - lo, F.lit(1e-9)), F.greatest(hi - F.lit(pivot), F.lit(1e-9))
        return [lo + below * 0.45, F.lit(pivot) - below * 0.10, F.lit(pivot) + beyond * 0.10, F.lit(pivot) + beyond * 0.50]

    return _binned(df, value, cuts)
