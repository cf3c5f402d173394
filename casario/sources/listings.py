"""Listing observations derived from the driver's star schema, one per line item.

Facts join their dimensions on keys; the dimensions are small against the facts and Spark chooses the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where its files make fewer splits than there are; heavy work on texts is worth that shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df's narrow rows over all cores, two tasks each: a small file has few row groups, whatever its splits, and each is one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """property_id, source_domain, transaction_type, property_type, city, state, neighborhood, price, area_m2, bedrooms,
    condo_fee, cep, extraction_date, mes_referencia, tie."""
    supplier = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    supplier = supplier.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select(
        F.substring(F.sha1(F.concat(F.lit("part|"), F.col("l_partkey").cast("string"))), 1, 20).alias("property_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_domain"),
        F.when(F.col("l_returnflag") == "R", "locacao").otherwise("venda").alias("transaction_type"),
        F.col("p_type").alias("property_type"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.col("p_brand").alias("neighborhood"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("area_m2"),
        F.col("l_linenumber").alias("bedrooms"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("condo_fee"),
        F.lpad((F.col("l_partkey") * 37 % 1000).cast("string"), 8, "0").alias("cep"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("extraction_date"),
        F.date_format("l_shipdate", "yyyy-MM").alias("mes_referencia"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"),
    )


SQL = """
SELECT substr(sha1('part|' || l_partkey::VARCHAR), 1, 20) AS property_id, 's' || l_suppkey::VARCHAR AS source_domain,
  CASE WHEN l_returnflag = 'R' THEN 'locacao' ELSE 'venda' END AS transaction_type, p_type AS property_type, n_name AS city,
  r_name AS state, p_brand AS neighborhood, l_extendedprice AS price, l_quantity AS area_m2, l_linenumber AS bedrooms,
  l_extendedprice * l_discount AS condo_fee, lpad((l_partkey * 37 % 1000)::VARCHAR, 8, '0') AS cep,
  strftime(l_shipdate, '%Y-%m-%d') AS extraction_date, strftime(l_shipdate, '%Y-%m') AS mes_referencia,
  l_orderkey * 10 + l_linenumber AS tie
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
