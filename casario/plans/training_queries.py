"""Queries of the training table, metrics and reports on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import metrics, nearest, quality, training
from ..sources.listings import SQL as L
from ..sources.listings import listings, read

QUERIES: dict = {}
SQL: dict = {}
PRICES = {"venda": (20_000.0, 100_000_000.0), "locacao": (300.0, 60_000.0)}
AREAS = {"venda": (1_000.0, 60_000.0), "locacao": (5.0, 1_800.0)}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH L AS ({L})" + sql if "FROM L" in sql or "JOIN L" in sql else sql.lstrip(", ")
        return f

    return keep


_OK = "((transaction_type = 'venda' AND price BETWEEN 20000 AND 1e8) OR (transaction_type = 'locacao' AND price BETWEEN 300 AND 60000))"
_AREA = "((transaction_type = 'venda' AND price / area_m2 BETWEEN 1000 AND 60000) OR (transaction_type = 'locacao' AND price / area_m2 BETWEEN 5 AND 1800))"


@query("abt_filter", f" SELECT tie, transaction_type, price, area_m2 FROM L WHERE {_OK} AND {_AREA}")
def _(spark, sf_dir):
    return training.filtered(listings(spark, sf_dir), PRICES, AREAS).select("tie", "transaction_type", "price", "area_m2")


@query("abt_filter_log", f" SELECT count(*)::BIGINT AS n_in, 0::BIGINT AS no_price, (count(*) FILTER (NOT {_OK}))::BIGINT AS price_out, (count(*) FILTER ({_OK} AND NOT {_AREA}))::BIGINT AS area_out, (count(*) FILTER ({_OK} AND {_AREA}))::BIGINT AS n_out FROM L")
def _(spark, sf_dir):
    return training.filter_log(listings(spark, sf_dir), PRICES, AREAS)


@query("range_null", """ SELECT tie, CASE WHEN condo_fee BETWEEN 50 AND 20000 THEN condo_fee END AS condo_fee, CASE WHEN (transaction_type = 'venda' AND price < 50000) OR (transaction_type = 'locacao' AND price < 300) THEN NULL ELSE price END AS price,
  (CASE WHEN condo_fee BETWEEN 50 AND 20000 THEN '' ELSE 'condo_fee ' END || CASE WHEN transaction_type = 'venda' AND price < 50000 OR transaction_type = 'locacao' AND price < 300 THEN 'price' ELSE '' END) AS anulados FROM L""")
def _(spark, sf_dir):
    out = coerce.within_ranges(listings(spark, sf_dir))
    text = F.concat(F.when(F.array_contains("anulados", "condo_fee"), "condo_fee ").otherwise(""), F.when(F.array_contains("anulados", "price"), "price").otherwise(""))
    return out.select("tie", "condo_fee", "price", text.alias("anulados"))


@query("validate_reject", """ SELECT tie, CASE WHEN bedrooms = 3 THEN 'missing: neighborhood' WHEN bedrooms = 5 THEN 'transaction_type' END AS motivo FROM L""")
def _(spark, sf_dir):
    own = listings(spark, sf_dir).withColumns({"neighborhood": F.when(F.col("bedrooms") != 3, F.col("neighborhood")).otherwise(""), "transaction_type": F.when(F.col("bedrooms") == 5, "troca").otherwise(F.col("transaction_type"))})
    return own.select("tie", coerce.reject_reason(["property_id", "neighborhood", "source_domain"]).alias("motivo"))


@query("segment", """ SELECT CASE WHEN transaction_type = 'locacao' THEN 'locacao' WHEN price <= 50000 THEN 'venda_ate' ELSE 'venda_acima' END AS segmento, count(*)::BIGINT AS n, median(price) AS preco_mediano FROM L GROUP BY 1""")
def _(spark, sf_dir):
    name = F.when(F.col("transaction_type") == "locacao", "locacao").when(F.col("price") <= 50000, "venda_ate").otherwise("venda_acima")
    return listings(spark, sf_dir).groupBy(name.alias("segmento")).agg(F.count("*").alias("n"), F.median("price").alias("preco_mediano"))


_SIG = " , S AS (SELECT tie, concat_ws('|', transaction_type, city, neighborhood, bedrooms::VARCHAR) AS grupo, price FROM L)"


def _grouped(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("grupo", training.signature(["transaction_type", "city", "neighborhood", "bedrooms"]))


@query("holdout_split", _SIG + """ , G AS (SELECT grupo, row_number() OVER (ORDER BY sha1('42|' || grupo)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grupo FROM S))
  SELECT tie, grupo, r <= floor(0.1 * n + 0.5) AS is_holdout FROM S JOIN G USING (grupo)""")
def _(spark, sf_dir):
    return training.holdout(_grouped(spark, sf_dir), "grupo").select("tie", "grupo", "is_holdout")


@query("group_kfold", _SIG + """ , P AS (SELECT grupo, median(price) AS p FROM S GROUP BY grupo), R AS (SELECT grupo, row_number() OVER (ORDER BY p, grupo) AS r, count(*) OVER () AS n FROM P),
  D AS (SELECT grupo, greatest(0, ceil(round((r - 1) * 10 / (n - 1), 9)) - 1)::INT AS decil FROM R),
  F AS (SELECT grupo, ((row_number() OVER (PARTITION BY decil ORDER BY sha1('20260829|' || grupo)) - 1) % 5)::INT AS fold FROM D) SELECT tie, grupo, fold FROM S JOIN F USING (grupo)""")
def _(spark, sf_dir):
    return training.group_folds(_grouped(spark, sf_dir), "grupo", "price").select("tie", "grupo", "fold")


@query("target_encoding", """ , G AS (SELECT avg(ln(price / area_m2)) AS g FROM L) SELECT neighborhood, round((sum(ln(price / area_m2)) + 20 * any_value(g)) / (count(*) + 20), 9) AS encoded, count(*)::BIGINT AS n FROM L, G GROUP BY neighborhood""")
def _(spark, sf_dir):
    return training.target_encoding(listings(spark, sf_dir), "neighborhood", F.ln(F.col("price") / F.col("area_m2"))).withColumn("encoded", F.round("encoded", 9))


@query("twin_fusion", """ SELECT city, neighborhood, property_type, round(area_m2) AS area, bedrooms, round(avg(price), 6) AS price, round(avg(condo_fee), 6) AS condo_fee, arg_min(source_domain, tie) AS source_domain, count(*)::BIGINT AS n_gemeos
  FROM L WHERE bedrooms <> 7 GROUP BY 1, 2, 3, 4, 5 UNION ALL SELECT city, neighborhood, property_type, round(area_m2), NULL, round(price, 6), round(condo_fee, 6), source_domain, 1 FROM L WHERE bedrooms = 7""")
def _(spark, sf_dir):
    own = listings(spark, sf_dir).withColumns({"area": F.round("area_m2"), "bedrooms": F.nullif(F.col("bedrooms"), F.lit(7))})
    out = training.fused(own, ["city", "neighborhood", "property_type", "area", "bedrooms"], ["tie"], ["price", "condo_fee"], ["source_domain"])
    return out.withColumns({c: F.round(c, 6) for c in ("price", "condo_fee")})


@query("label_support", """ , X AS (SELECT unnest(list_distinct(string_split(property_type, ' '))) AS label FROM L) SELECT label, count(*)::BIGINT AS n FROM X GROUP BY label HAVING count(*) >= 30""")
def _(spark, sf_dir):
    return training.supported(listings(spark, sf_dir).withColumn("labels", F.split("property_type", " ")), "labels")


@query("having_enough", " SELECT city, transaction_type, count(*)::BIGINT AS n FROM L GROUP BY ALL HAVING count(*) >= 300")
def _(spark, sf_dir):
    return training.enough(listings(spark, sf_dir), ["city", "transaction_type"])


@query("ratios", """ SELECT tie, area_m2 / bedrooms AS area_por_quarto, condo_fee / area_m2 AS condo_m2, round(ln(area_m2), 9) AS log_area, round(ln(price), 9) AS log_price FROM L""")
def _(spark, sf_dir):
    return training.ratios(listings(spark, sf_dir)).select("tie", "area_por_quarto", "condo_m2", F.round("log_area", 9).alias("log_area"), F.round("log_price", 9).alias("log_price"))


_PRED = " , P AS (SELECT tie, city, price, ln(price) AS y_log, ln(price) + ((tie % 21) - 10) / 50.0 AS p_log FROM L)"


def _predicted(spark, sf_dir):
    return listings(spark, sf_dir).select("tie", "city", "price", F.ln("price").alias("y_log"), (F.ln("price") + (F.col("tie") % 21 - 10) / 50.0).alias("p_log"))


@query("metrics", _PRED + """ , E AS (SELECT p_log - y_log AS e, abs(exp(p_log) - price) / price AS r, exp(p_log) - price AS b FROM P)
  SELECT round(avg(abs(e)), 6) AS mae_log, round(sqrt(avg(e * e)), 6) AS rmse_log, round(median(r), 6) AS mdape, round(quantile_cont(r, 0.9), 6) AS p90_ape, round(sqrt(avg(b * b)), 4) AS rmse_brl, round(avg(abs(b)), 4) AS mae_brl,
  round(avg((r <= 0.10)::INT), 6) AS within_10, round(avg((r <= 0.20)::INT), 6) AS within_20, round(avg(e), 6) AS bias_log, round(avg(b), 4) AS bias_brl, round(median(b), 4) AS bias_median_brl, round(median(e), 6) AS bias_median_log FROM E""")
def _(spark, sf_dir):
    out = metrics.regression_metrics(_predicted(spark, sf_dir))
    return out.select(*(F.round(c, 4 if c.endswith("brl") else 6).alias(c) for c in out.columns))


@query("decile_calibration", _PRED + """ , R AS (SELECT *, row_number() OVER (ORDER BY p_log, tie) AS r, count(*) OVER () AS n FROM P), D AS (SELECT *, greatest(0, ceil(round((r - 1) * 10 / (n - 1), 9)) - 1)::INT AS decil FROM R)
  SELECT decil, count(*)::BIGINT AS n, round(median(p_log), 9) AS previsto, round(median(y_log), 9) AS "real" FROM D GROUP BY decil""")
def _(spark, sf_dir):
    return metrics.decile_calibration(_predicted(spark, sf_dir), "p_log", "y_log", "tie").withColumns({c: F.round(c, 9) for c in ("previsto", "real")})


@query("interval_coverage", """ , Q AS (SELECT price, price * (0.8 + (tie % 7) / 20.0) AS a, price * (1.3 - (tie % 11) / 20.0) AS b, price * 1.01 AS c FROM L), I AS (SELECT price, least(a, b, c) AS lo, greatest(a, b, c) AS hi, a > b AS x FROM Q)
  SELECT round(avg((price BETWEEN lo AND hi)::INT), 9) AS cobertura, round(median(hi - lo), 6) AS largura_mediana, round(median((hi - lo) / price), 9) AS largura_pct, (count(*) FILTER (x))::BIGINT AS cruzamentos FROM I""")
def _(spark, sf_dir):
    own = listings(spark, sf_dir).select("price", (F.col("price") * (0.8 + F.col("tie") % 7 / 20.0)).alias("a"), (F.col("price") * (1.3 - F.col("tie") % 11 / 20.0)).alias("b"), (F.col("price") * 1.01).alias("c"))
    out = metrics.coverage(metrics.interval(own, "a", "c", "b"), "price")
    return out.select(F.round("cobertura", 9).alias("cobertura"), F.round("largura_mediana", 6).alias("largura_mediana"), F.round("largura_pct", 9).alias("largura_pct"), "cruzamentos")


@query("fold_summary", """ , S AS (SELECT city, (tie % 5)::INT AS fold, median(price) AS m FROM L GROUP BY ALL) SELECT city, round(avg(m), 6) AS media, round(stddev_samp(m), 6) AS dp, round(stddev_samp(m) / sqrt(count(m)), 6) AS ep, count(m)::BIGINT AS n FROM S GROUP BY city""")
def _(spark, sf_dir):
    folds = listings(spark, sf_dir).groupBy("city", (F.col("tie") % 5).alias("fold")).agg(F.median("price").alias("m"))
    return metrics.fold_summary(folds, ["city"], "m").withColumns({c: F.round(c, 6) for c in ("media", "dp", "ep")})


@query("fill_rate", """WITH D AS (SELECT lang, CASE WHEN source = 'src1' THEN '' ELSE source END AS source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
  SELECT unnest(['lang', 'source', 'quality', 'toxic']) AS campo, round(unnest([avg((coalesce(lang, '') <> '')::INT), avg((coalesce(source, '') <> '')::INT), avg((quality IS NOT NULL)::INT), avg((toxic IS NOT NULL)::INT)]), 9) AS preenchido, count(*)::BIGINT AS n FROM D""")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("source", F.when(F.col("source") == "src1", "").otherwise(F.col("source")))
    return quality.fill_rates(d, ["lang", "source", "quality", "toxic"]).withColumn("preenchido", F.round("preenchido", 9))


@query("null_report", """WITH D AS (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT unnest(['quality', 'toxic']) AS campo, unnest([count(*) - count(quality), count(*) - count(toxic)])::BIGINT AS n_nulos FROM D""")
def _(spark, sf_dir):
    return quality.nulls(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left"), ["quality", "toxic"])


_MONTHS = ["1996-01", "1996-02", "1996-03"]


@query("ops_counts_pivot", " SELECT city, " + ", ".join(f"(count(*) FILTER (mes_referencia = '{m}'))::BIGINT AS \"{m}\"" for m in _MONTHS) + " FROM L WHERE mes_referencia IN ('1996-01', '1996-02', '1996-03') GROUP BY city")
def _(spark, sf_dir):
    return quality.counts_by_month(listings(spark, sf_dir), "city", _MONTHS)


@query("health_checks", """ , O AS (SELECT count(*) AS n, count(*) FILTER (mes_referencia = '1997-05') AS m, avg((city <> '')::INT) AS f FROM L)
  SELECT unnest(['linhas', 'mes_atual', 'preenchimento_city']) AS verificacao, unnest([n > 0, m > 0, f >= 0.9]) AS ok, unnest([n, m, f])::DOUBLE AS detalhe FROM O""")
def _(spark, sf_dir):
    return quality.health(listings(spark, sf_dir), "1997-05", ["city"])


@query("treatment_report", "SELECT count(DISTINCT p_type)::BIGINT AS antes, count(DISTINCT CASE WHEN p_size % 5 <> 0 THEN upper(p_type) END)::BIGINT AS depois, (count(*) FILTER (p_size % 5 = 0 OR upper(p_type) <> p_type))::BIGINT AS mudou, (count(*) FILTER (p_size % 5 = 0))::BIGINT AS novos_nulos FROM part")
def _(spark, sf_dir):
    own = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return quality.changed(own, own.withColumn("p_type", F.when(F.col("p_size") % 5 != 0, F.upper("p_type"))), "p_partkey", "p_type")


@query("card_limits", " , X AS (SELECT price, area_m2 FROM L) " + " UNION ALL ".join(f"SELECT '{c}' AS campo, quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.99) AS p99, min({c})::DOUBLE AS minimo, max({c})::DOUBLE AS maximo, count({c})::BIGINT AS n FROM X" for c in ("price", "area_m2")) + " -- FROM L")
def _(spark, sf_dir):
    return quality.card_limits(listings(spark, sf_dir), ["price", "area_m2"])


@query("knn_price", """WITH P AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::DOUBLE AS target FROM embeddings),
  N AS (SELECT a.vec_id, b.target, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.vec_id) AS r FROM P a JOIN P b ON a.vec_id <> b.vec_id)
  SELECT vec_id, avg(target) AS media, count(*)::BIGINT AS n FROM N WHERE r <= 15 GROUP BY vec_id""")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("double").alias("target"))
    return nearest.nearest_mean(p, p, 15, "vec_id")
