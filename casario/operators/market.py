"""The market table: listings by city, neighbourhood and month, with points and published indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def price_per_area(price: str = "price", area: str = "area_m2"):
    """Price by area; an area of 0 gives infinity for a positive price (kept in medians), an unknown one null."""
    return F.when(F.col(area) == 0, F.when(F.col(price) > 0, F.lit(float("inf"))).when(F.col(price) < 0, F.lit(float("-inf")))).otherwise(F.col(price) / F.col(area))


def market_by(df: DataFrame, keys: list[str], cep: str = "cep", points: tuple[str, ...] = ()) -> DataFrame:
    """Count, exact price quantiles, median price by area and the most frequent CEP prefix (the least of equals) of each group, and the medians of its points' coordinates; null keys are groups.

    Exact quantiles hold a group's distinct values with their counts, so their memory is bounded by a group's distinct prices.
    """
    out = df.withColumn("_m2", price_per_area()).groupBy(*keys).agg(
        F.count("*").alias("n_anuncios"),
        F.percentile("price", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("_p"),
        F.median("_m2").alias("preco_m2_mediano"),
        F.mode(F.substring(cep, 1, 5), True).alias("cep_prefixo"),
        *(F.median(c).alias(c) for c in points),
    )
    quantiles = [F.col("_p")[i].alias(c) for i, c in enumerate(("preco_mediano", "preco_p10", "preco_p90"))]
    return out.select(*keys, "n_anuncios", *quantiles, "preco_m2_mediano", "cep_prefixo", *points)


def as_of(left: DataFrame, right: DataFrame, left_month: str, right_month: str, by: list[str], suffix: str) -> DataFrame:
    """left with the latest row of right whose month is not later, by key (or over all, without keys).

    right is a published index: few rows a key. Its rows are gathered per key, so left is neither sorted nor multiplied:
    each left row picks from an array. right's month comes back as <month>_<suffix>.
    """
    values = [c for c in right.columns if c not in by]
    series = right.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(right_month).alias("_m"), *[F.col(c) for c in values if c != right_month]))).alias("_series"))
    # Without keys there is one row: a broadcast of one array.
    joined = left.join(series, by, "left") if by else left.join(F.broadcast(series), F.lit(True), "left")
    upto = F.filter("_series", lambda x: x["_m"] <= F.col(left_month))
    joined = joined.withColumn("_last", F.try_element_at(upto, F.lit(-1)))
    return joined.select(*left.columns, *(F.col(f"_last.{c}").alias(c) for c in values if c != right_month), F.col("_last._m").alias(f"{right_month}_{suffix}"))


def forward_fill(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Columns with their last known value up to each row."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def only_in_index(index: DataFrame, market: DataFrame, key: str, month: str) -> DataFrame:
    """The latest row of each city of the index that has no listings."""
    return index.join(market.select(key).distinct(), key, "left_anti").withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(month)))).where("_rank = 1").drop("_rank")


def with_index_only(market: DataFrame, index: DataFrame, key: str = "cidade", month: str = "mes_referencia") -> DataFrame:
    """market and a row without neighbourhood and listings for each city that only the index knows, at its latest month."""
    rest = only_in_index(index, market, key, month).withColumn("n_anuncios", F.lit(0).cast("long"))
    return market.unionByName(rest, allowMissingColumns=True)


def wide(df: DataFrame, keys: list[str], field: str, value: str, fields: list[str], order: str) -> DataFrame:
    """Long series to one column a field: the last known value by order. The fields are given, so no job looks for them."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).pivot(field, fields).agg(F.max_by(value, order))


def geocoded(df: DataFrame, streets: DataFrame, points: DataFrame) -> DataFrame:
    """df with cep (its own where it has 8 digits, else its street's, else '') and the CEP's point.

    streets: city_key, street_key, cep; points: cep, lat, lon. Both are made unique first, the last (first) row by value winning.
    """
    street = streets.groupBy("city_key", "street_key").agg(F.max("cep").alias("_street_cep"))
    point = points.groupBy("cep").agg(F.min(F.struct("lat", "lon")).alias("_point"))
    own = F.when(F.col("cep").rlike("^[0-9]{8}$"), F.col("cep"))
    out = df.join(street, ["city_key", "street_key"], "left").withColumn("cep", F.coalesce(own, "_street_cep", F.lit("")))
    return out.join(point, "cep", "left").select(*df.columns, F.col("_point.lat").alias("lat"), F.col("_point.lon").alias("lon"))


def street_to_cep(df: DataFrame, city: str, street: str, cep: str) -> DataFrame:
    """The most frequent CEP of each street (the greatest of equals), its addresses and how many CEPs it has."""
    counts = df.groupBy(city, street, cep).agg(F.count("*").alias("_n"))
    return counts.groupBy(city, street).agg(F.max_by(cep, F.struct("_n", cep)).alias("cep"), F.sum("_n").alias("n_enderecos"), F.count("*").alias("n_ceps"))


def cep_to_point(df: DataFrame, cep: str, lat: str, lon: str) -> DataFrame:
    """Median point and number of addresses of each CEP; addresses without a numeric point are left out."""
    num = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    ok = df.select(F.col(cep).alias("cep"), num(lat).alias("_lat"), num(lon).alias("_lon")).where("_lat IS NOT NULL AND _lon IS NOT NULL")
    return ok.groupBy("cep").agg(F.median("_lat").alias("lat"), F.median("_lon").alias("lon"), F.count("*").alias("n_end"))


def canonical_spelling(df: DataFrame, key: str, form: str) -> DataFrame:
    """The spelling of each key with the most letters beyond ASCII, then the most frequent, then the greatest."""
    marks = F.char_length(F.regexp_replace(form, r"[\x00-\x7F]", ""))
    return df.groupBy(key, form).agg(F.count("*").alias("_n")).groupBy(key).agg(F.max_by(form, F.struct(marks.alias("m"), "_n", F.col(form).alias("f"))).alias("canonical"))
