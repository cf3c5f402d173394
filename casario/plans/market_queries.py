"""Queries of history, market and serving operators on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, market, serving
from ..sources.listings import SQL as L
from ..sources.listings import listings, read

QUERIES: dict = {}
SQL: dict = {}
MARKET = ["city", "state", "neighborhood", "mes_referencia"]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH L AS ({L})" + sql if "FROM L" in sql or "JOIN L" in sql else sql.lstrip(", ")
        return f

    return keep


_MARKET_SQL = """ , M AS (SELECT city, state, neighborhood, mes_referencia, count(*)::BIGINT AS n_anuncios, median(price) AS preco_mediano,
  round(quantile_cont(price, 0.1), 6) AS preco_p10, round(quantile_cont(price, 0.9), 6) AS preco_p90, median(price / area_m2) AS preco_m2_mediano
  FROM L GROUP BY ALL),
 C AS (SELECT city, state, neighborhood, mes_referencia, substr(cep, 1, 5) AS p, count(*) AS n FROM L GROUP BY ALL),
 P AS (SELECT city, state, neighborhood, mes_referencia, arg_max(p, (n, -(p::INT))) AS cep_prefixo FROM C GROUP BY ALL)"""


@query("market_by_neighborhood_month", _MARKET_SQL + " SELECT * FROM M JOIN P USING (city, state, neighborhood, mes_referencia)")
def _(spark, sf_dir):
    return market.market_by(listings(spark, sf_dir), MARKET).withColumns({c: F.round(c, 6) for c in ("preco_p10", "preco_p90")})


_COLLAPSE = """ SELECT property_id, mes_referencia, arg_max(price, (extraction_date, tie)) AS price, arg_max(area_m2, (extraction_date, tie)) AS area_m2,
  arg_max(city, (extraction_date, tie)) AS city, arg_min(price, (extraction_date, tie)) AS preco_primeiro, arg_max(price, (extraction_date, tie)) AS preco_ultimo,
  count(DISTINCT extraction_date)::BIGINT AS n_dias_observado, min(price) <> max(price) AS preco_mudou_no_mes FROM L GROUP BY property_id, mes_referencia"""


@query("month_collapse", _COLLAPSE)
def _(spark, sf_dir):
    own = listings(spark, sf_dir).select("property_id", "mes_referencia", "price", "area_m2", "city", "extraction_date", "tie")  # whole rows are collapsed: only what is asked for
    out = history.collapse_month(own, ["mes_referencia", "property_id"])  # sorted before the shuffle: rows side by side share most of their dates
    return out.select("property_id", "mes_referencia", "price", "area_m2", "city", "preco_primeiro", "preco_ultimo", "n_dias_observado", "preco_mudou_no_mes")


@query("month_collapse_cross_source", """ , S AS (SELECT property_id, mes_referencia, source_domain, max(extraction_date) AS d, arg_max(price, (extraction_date, tie)) AS price,
  count(DISTINCT extraction_date)::BIGINT AS n_dias_observado FROM L GROUP BY ALL)
  SELECT property_id, mes_referencia, source_domain, price, n_dias_observado FROM S QUALIFY row_number() OVER (PARTITION BY property_id, mes_referencia ORDER BY d DESC, source_domain DESC) = 1""")
def _(spark, sf_dir):
    own = listings(spark, sf_dir).select("property_id", "mes_referencia", "source_domain", "price", "extraction_date", "tie")
    return history.build_month(own).select("property_id", "mes_referencia", "source_domain", "price", "n_dias_observado")


@query("history_only_cities", """ SELECT city, count(*)::BIGINT AS n FROM L WHERE city IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) GROUP BY city""")
def _(spark, sf_dir):
    cities = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("city"))
    return history.only_cities(listings(spark, sf_dir), cities, "city", False).groupBy("city").agg(F.count("*").alias("n"))


@query("incremental_antijoin", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf_dir):
    seen = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return history.not_seen(read(spark, sf_dir, "orders"), seen, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("new_rows_limit", """ SELECT city, transaction_type, tie, price FROM L QUALIFY row_number() OVER (PARTITION BY city, transaction_type ORDER BY extraction_date, tie) <= 5""")
def _(spark, sf_dir):
    return history.first_new(listings(spark, sf_dir), ["city", "transaction_type"], [F.col("extraction_date"), F.col("tie")], 5).select("city", "transaction_type", "tie", "price")


@query("upsert_new_wins", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(spark, sf_dir):
    old = read(spark, sf_dir, "orders")
    return history.upsert(old.select("o_orderkey", "o_totalprice"), old.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice")), ["o_orderkey"])


def _index(spark, sf_dir):
    """A monthly index by city, published for even months only: ragged against the listings."""
    by = listings(spark, sf_dir).where("cast(substring(mes_referencia, 6) AS int) % 2 = 0").groupBy("city", "mes_referencia")
    return by.agg(F.median("price").alias("venda_m2"), (F.median("price") / 1e7).alias("yield_mensal"))


_INDEX = " , I AS (SELECT city, mes_referencia, median(price) AS venda_m2, median(price) / 1e7 AS yield_mensal FROM L WHERE substr(mes_referencia, 6)::INT % 2 = 0 GROUP BY ALL)"


@query("asof_index", _INDEX + """ , K AS (SELECT city, mes_referencia, count(*)::BIGINT AS n FROM L GROUP BY ALL)
  SELECT K.city, K.mes_referencia, K.n, I.venda_m2, I.yield_mensal, I.mes_referencia AS mes_referencia_index FROM K ASOF LEFT JOIN I ON K.city = I.city AND K.mes_referencia >= I.mes_referencia""")
def _(spark, sf_dir):
    left = listings(spark, sf_dir).groupBy("city", "mes_referencia").agg(F.count("*").alias("n"))
    return market.as_of(left, _index(spark, sf_dir), "mes_referencia", "mes_referencia", ["city"], "index")


@query("asof_macro", """ , K AS (SELECT city, mes_referencia, count(*)::BIGINT AS n FROM L GROUP BY ALL),
  I AS (SELECT mes_referencia, median(price) AS ipca FROM L WHERE substr(mes_referencia, 6)::INT % 3 = 0 GROUP BY ALL)
  SELECT K.city, K.mes_referencia, K.n, I.ipca, I.mes_referencia AS mes_referencia_ipca FROM K ASOF LEFT JOIN I ON K.mes_referencia >= I.mes_referencia""")
def _(spark, sf_dir):
    own = listings(spark, sf_dir)
    left = own.groupBy("city", "mes_referencia").agg(F.count("*").alias("n"))
    index = own.where("cast(substring(mes_referencia, 6) AS int) % 3 = 0").groupBy("mes_referencia").agg(F.median("price").alias("ipca"))
    return market.as_of(left, index, "mes_referencia", "mes_referencia", [], "ipca")


@query("index_ffill", """ , M AS (SELECT city, mes_referencia, median(price) AS m FROM L GROUP BY ALL), K AS (SELECT city, mes_referencia, CASE WHEN substr(mes_referencia, 6)::INT % 2 = 0 THEN m END AS v FROM M)
  SELECT city, mes_referencia, last_value(v IGNORE NULLS) OVER (PARTITION BY city ORDER BY mes_referencia ROWS UNBOUNDED PRECEDING) AS v FROM K""")
def _(spark, sf_dir):
    k = listings(spark, sf_dir).groupBy("city", "mes_referencia").agg(F.median("price").alias("v"))
    k = k.withColumn("v", F.when(F.substring("mes_referencia", 6, 2).cast("int") % 2 == 0, F.col("v")))
    return market.forward_fill(k, ["city"], "mes_referencia", ["v"])


@query("index_only_cities", _INDEX + """ SELECT city, mes_referencia, venda_m2 FROM I WHERE city NOT IN (SELECT city FROM L WHERE neighborhood = 'Brand#11' AND bedrooms = 7 AND area_m2 > 45)
  QUALIFY row_number() OVER (PARTITION BY city ORDER BY mes_referencia DESC) = 1""")
def _(spark, sf_dir):
    few = listings(spark, sf_dir).where("neighborhood = 'Brand#11' AND bedrooms = 7 AND area_m2 > 45")
    return market.only_in_index(_index(spark, sf_dir), few, "city", "mes_referencia").select("city", "mes_referencia", "venda_m2")


_FIELDS = ["click", "error", "purchase", "signup", "view"]


@query("index_long_to_wide", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS dia, " + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{f}') AS \"{f}\"" for f in _FIELDS) + " FROM events WHERE value IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    days = read(spark, sf_dir, "events").withColumn("dia", F.date_format("ts", "yyyy-MM-dd"))
    return market.wide(days, ["user_id", "dia"], "event_type", "value", _FIELDS, "event_id")


@query("geocode_two_route", """ , D AS (SELECT tie, city AS city_key, neighborhood AS street_key, CASE WHEN bedrooms % 2 = 0 THEN cep END AS cep FROM L),
  S AS (SELECT city AS city_key, neighborhood AS street_key, max(cep) AS sc FROM L WHERE bedrooms = 1 GROUP BY ALL),
  P AS (SELECT cep, arg_min(struct_pack(lat := area_m2, lon := bedrooms), (area_m2, bedrooms)) AS p FROM L GROUP BY cep),
  G AS (SELECT tie, city_key, street_key, coalesce(cep, sc, '') AS cep FROM D LEFT JOIN S USING (city_key, street_key))
  SELECT tie, city_key, street_key, cep, p.lat AS lat, p.lon AS lon FROM G LEFT JOIN P USING (cep)""")
def _(spark, sf_dir):
    own = listings(spark, sf_dir)
    d = own.select("tie", F.col("city").alias("city_key"), F.col("neighborhood").alias("street_key"), F.when(F.col("bedrooms") % 2 == 0, F.col("cep")).alias("cep"))
    streets = own.where("bedrooms = 1").select(F.col("city").alias("city_key"), F.col("neighborhood").alias("street_key"), "cep")
    return market.geocoded(d, streets, own.select("cep", F.col("area_m2").alias("lat"), F.col("bedrooms").alias("lon")))


@query("street_to_cep", """ , N AS (SELECT city, neighborhood, cep, count(*) AS n FROM L GROUP BY ALL)
  SELECT city, neighborhood, arg_max(cep, (n, cep)) AS cep, sum(n)::BIGINT AS n_enderecos, count(*)::BIGINT AS n_ceps FROM N GROUP BY ALL""")
def _(spark, sf_dir):
    return market.street_to_cep(listings(spark, sf_dir), "city", "neighborhood", "cep")


@query("cep_to_point", """ , N AS (SELECT cep, try_cast(CASE WHEN bedrooms = 7 THEN 'x' ELSE price::VARCHAR END AS DOUBLE) AS a, area_m2 AS o FROM L)
  SELECT cep, median(a) AS lat, median(o) AS lon, count(*)::BIGINT AS n_end FROM N WHERE a IS NOT NULL GROUP BY cep""")
def _(spark, sf_dir):
    rows = listings(spark, sf_dir).select("cep", F.when(F.col("bedrooms") == 7, "x").otherwise(F.col("price").cast("string")).alias("a"), F.col("area_m2").cast("string").alias("o"))
    return market.cep_to_point(rows, "cep", "a", "o")


@query("city_rollup", _MARKET_SQL + """ SELECT city, count(DISTINCT neighborhood)::BIGINT AS n_bairros, sum(n_anuncios)::BIGINT AS n_anuncios, median(preco_mediano) AS preco_mediano,
  median(preco_m2_mediano) AS preco_m2_mediano FROM M GROUP BY city""")
def _(spark, sf_dir):
    return serving.city_rollup(market.market_by(listings(spark, sf_dir), MARKET))


@query("newest_market_row", _MARKET_SQL + """ SELECT city, neighborhood, mes_referencia, n_anuncios, preco_mediano FROM M QUALIFY row_number() OVER (PARTITION BY city, neighborhood ORDER BY mes_referencia DESC) = 1""")
def _(spark, sf_dir):
    return serving.newest(market.market_by(listings(spark, sf_dir), MARKET), ["city", "neighborhood"]).select("city", "neighborhood", "mes_referencia", "n_anuncios", "preco_mediano")


_HOODS = " , H AS (SELECT city, neighborhood, count(*)::BIGINT AS n_anuncios, median(price / area_m2) AS v FROM L GROUP BY ALL)"


def _hoods(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("city", "neighborhood").agg(F.count("*").alias("n_anuncios"), F.median(F.col("price") / F.col("area_m2")).alias("v"))


_TERCILE = _HOODS + """ , Q AS (SELECT *, quantile_cont(v, 1/3) OVER w AS a, quantile_cont(v, 2/3) OVER w AS b, count(v) OVER w AS n FROM H WINDOW w AS (PARTITION BY city)),
  T AS (SELECT city, neighborhood, n_anuncios, v, CASE WHEN n < 3 OR v IS NULL THEN NULL WHEN v <= a THEN 'abaixo' WHEN v >= b THEN 'acima' ELSE 'media' END AS faixa FROM Q)"""


@query("tercile_label", _TERCILE + " SELECT * FROM T")
def _(spark, sf_dir):
    return serving.terciles(_hoods(spark, sf_dir), "city", "v")


@query("serve_bairros_summary", _TERCILE + """ SELECT count(*)::BIGINT AS total, (count(*) FILTER (faixa = 'acima'))::BIGINT AS acima, (count(*) FILTER (faixa = 'abaixo'))::BIGINT AS abaixo,
  count(DISTINCT city)::BIGINT AS cidades, sum(n_anuncios)::BIGINT AS anuncios FROM T""")
def _(spark, sf_dir):
    return serving.summary(serving.terciles(_hoods(spark, sf_dir), "city", "v"))


@query("minmax_by_city", _HOODS + """ SELECT city, neighborhood, v, CASE WHEN max(v) OVER w = min(v) OVER w THEN 0.5 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS escala FROM H WINDOW w AS (PARTITION BY city)""")
def _(spark, sf_dir):
    return serving.scaled_by_group(_hoods(spark, sf_dir), "city", "v", "escala").drop("n_anuncios")


@query("serve_mercado", _INDEX + """ SELECT city, mes_referencia, n_meses, primeiro_mes, venda_m2, round(yield_mensal * 100, 9) AS yield_pct, round((pow(1 + yield_mensal, 12) - 1) * 100, 9) AS yield_anual_pct FROM
  (SELECT *, count(*) OVER (PARTITION BY city)::BIGINT AS n_meses, min(mes_referencia) OVER (PARTITION BY city) AS primeiro_mes, row_number() OVER (PARTITION BY city ORDER BY mes_referencia DESC) AS r FROM I) WHERE r = 1""")
def _(spark, sf_dir):
    out = serving.city_index(_index(spark, sf_dir), "city", "mes_referencia")
    return out.withColumns({c: F.round(c, 9) for c in ("yield_pct", "yield_anual_pct")})


@query("rent_anchor", _INDEX + """ , Y AS (SELECT city, arg_max(yield_mensal, mes_referencia) AS y FROM I WHERE city <> 'BRAZIL' GROUP BY city)
  SELECT tie, price * y AS aluguel, price * 0.9 * (y * 0.7) AS aluguel_lo, price * 1.1 * y AS aluguel_hi, price * 1.1 * y - price * 0.9 * (y * 0.7) AS largura_do_envelope, CASE WHEN y IS NULL THEN 'sem_yield' END AS motivo FROM L LEFT JOIN Y USING (city)""")
def _(spark, sf_dir):
    last = serving.newest(_index(spark, sf_dir), ["city"]).where("city <> 'BRAZIL'").select("city", "yield_mensal", (F.col("yield_mensal") * 0.7).alias("yield_p10"), F.lit(None).cast("double").alias("yield_p90"))
    own = listings(spark, sf_dir).withColumns({"lo": F.col("price") * 0.9, "hi": F.col("price") * 1.1}).join(last, "city", "left")
    return serving.rent_anchor(own, "price", "lo", "hi").select("tie", "aluguel", "aluguel_lo", "aluguel_hi", "largura_do_envelope", "motivo")


@query("city_rank", _HOODS + """ , R AS (SELECT city, median(v) AS v FROM H GROUP BY city) SELECT city, v, row_number() OVER (ORDER BY v DESC, city)::INT AS posicao FROM R""")
def _(spark, sf_dir):
    return serving.top_per_group(_hoods(spark, sf_dir).groupBy("city").agg(F.median("v").alias("v")), [], [F.desc("v"), F.col("city")], 2**31 - 1)


@query("topk_cities", " SELECT city, count(*)::BIGINT AS n FROM L GROUP BY city ORDER BY n DESC, city LIMIT 8")
def _(spark, sf_dir):
    return serving.top(listings(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n")), "n", 8)


@query("width_bins", _HOODS + """ , E AS (SELECT min(v) AS lo, max(v) AS hi FROM H) SELECT city, neighborhood, ((v > lo + 1 * ((hi - lo) / 5))::INT + (v > lo + 2 * ((hi - lo) / 5))::INT + (v > lo + 3 * ((hi - lo) / 5))::INT + (v > lo + 4 * ((hi - lo) / 5))::INT)::INT AS faixa_cor FROM H, E""")
def _(spark, sf_dir):
    return serving.width_bins(_hoods(spark, sf_dir), "v").select("city", "neighborhood", "faixa_cor")


_CHANGE = _HOODS + """ , M AS (SELECT city, median(v) AS m FROM H GROUP BY city), D AS (SELECT city, neighborhood, CASE WHEN n_anuncios > 1 THEN v / m - 1 END AS d FROM H JOIN M USING (city)),
 E AS (SELECT min(d) AS lo, greatest(0 - min(d), 1e-9) AS a, greatest(max(d) - 0, 1e-9) AS b FROM D)"""


@query("diverging_bins", _CHANGE + """ SELECT city, neighborhood, CASE WHEN d <= lo + a * 0.45 THEN 0 WHEN d <= 0 - a * 0.10 THEN 1 WHEN d <= 0 + b * 0.10 THEN 2 WHEN d <= 0 + b * 0.50 THEN 3 WHEN d IS NOT NULL THEN 4 END::INT AS faixa_cor FROM D, E""")
def _(spark, sf_dir):
    hoods = _hoods(spark, sf_dir)
    middle = hoods.groupBy("city").agg(F.median("v").alias("m"))
    d = hoods.join(middle, "city").withColumn("d", F.when(F.col("n_anuncios") > 1, F.col("v") / F.col("m") - 1))
    return serving.diverging_bins(d, "d").select("city", "neighborhood", "faixa_cor")


@query("last_turn_per_conversation", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1")
def _(spark, sf_dir):
    return history.last_per_key(read(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.desc("role"), F.desc("text")]).select("conv_id", "turn", "role", "text")
