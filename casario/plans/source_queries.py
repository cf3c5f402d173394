"""Queries of index, register and feature operators on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import folds
from ..operators import features, market, training, views
from ..sources import indices, register
from ..sources.listings import SQL as L
from ..sources.listings import listings, read

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH L AS ({L})" + sql if "FROM L" in sql or "JOIN L" in sql else sql.lstrip(", ")
        return f

    return keep


def _grid(spark, sf_dir):
    """A workbook: a sheet for each nation with its months, and one sheet of another layout."""
    months = listings(spark, sf_dir).groupBy("city", "mes_referencia").agg(F.max("price").alias("hi"), F.min("price").alias("lo"), F.count("*").alias("n"))
    number = lambda c: F.struct(F.lit("numero").alias("tipo"), c.cast("string").alias("texto"))
    empty = F.struct(F.lit("vazia").alias("tipo"), F.lit(None).cast("string").alias("texto"))
    text = lambda s: F.struct(F.lit("texto").alias("tipo"), F.lit(s).alias("texto"))
    odd = F.substring("mes_referencia", 6, 2).cast("int") % 2 == 1
    at = {
        indices.DATE: F.struct(F.lit("data").alias("tipo"), F.concat("mes_referencia", F.lit("-01")).alias("texto")), 17: number(F.col("hi")), 12: number(F.col("n")), 37: number(F.col("lo")),
        32: F.when(odd, number(F.col("lo"))).otherwise(text("-")), 42: number(F.col("n") / 10_000),
    }
    rows = months.select(F.col("city").alias("cidade"), F.lit(9).alias("linha"), F.array(*(at.get(i, empty) for i in range(43))).alias("celulas"))
    blocks, kinds = {2: "Venda", 20: "Locação", 40: "Rentabilidade"}, {12: "Var. em 12 meses", 17: "Preço médio", 32: "Var. em 12 meses", 37: "Preço médio", 42: "Aluguel mensalizada"}
    head = lambda of: F.array(*(text(of[i]) if i in of else empty for i in range(43)))
    lines = F.explode(F.array(F.struct(F.lit(2).alias("linha"), head(blocks).alias("celulas")), F.struct(F.lit(3).alias("linha"), head({}).alias("celulas")), F.struct(F.lit(4).alias("linha"), head(kinds).alias("celulas"))))
    heads = read(spark, sf_dir, "nation").select(F.col("n_name").alias("cidade"), lines.alias("x")).select("cidade", "x.*")
    other = rows.withColumn("cidade", F.lit("Metodologia")).limit(1)
    return rows.unionByName(heads).unionByName(other)


_LONG = """ , M AS (SELECT city AS cidade, mes_referencia, max(price) AS hi, min(price) AS lo, count(*)::BIGINT AS n FROM L GROUP BY ALL),
 S AS (SELECT cidade, mes_referencia, 'venda_m2' AS campo, hi AS valor FROM M UNION ALL SELECT cidade, mes_referencia, 'venda_var12', n::DOUBLE FROM M UNION ALL SELECT cidade, mes_referencia, 'locacao_m2', lo FROM M
  UNION ALL SELECT cidade, mes_referencia, 'locacao_var12', lo FROM M WHERE substr(mes_referencia, 6, 2)::INT % 2 = 1 UNION ALL SELECT cidade, mes_referencia, 'yield_mensal', n / 10000 FROM M)"""


@query("index_sheet_series", _LONG + " SELECT * FROM S")
def _(spark, sf_dir):
    return indices.sheet_series(_grid(spark, sf_dir))


@query("index_layout", """SELECT n_name AS cidade, true AS ok FROM nation UNION ALL SELECT 'Metodologia', false""")
def _(spark, sf_dir):
    return indices.layout(_grid(spark, sf_dir)).select("cidade", F.col("motivo").isNull().alias("ok"))


@query("index_monthly", _LONG + f""" SELECT cidade, mes_referencia, max(valor) FILTER (campo = 'venda_m2') AS venda_m2, max(valor) FILTER (campo = 'venda_var12') AS venda_var12, max(valor) FILTER (campo = 'locacao_m2') AS locacao_m2,
  max(valor) FILTER (campo = 'locacao_var12') AS locacao_var12, max(valor) FILTER (campo = 'yield_mensal') AS yield_mensal, round(max(valor) FILTER (campo = 'yield_mensal') * {indices.SPREAD["p10"]!r}, 9) AS yield_p10,
  round(max(valor) FILTER (campo = 'yield_mensal') * {indices.SPREAD["p90"]!r}, 9) AS yield_p90, 'Indice FipeZAP, serie historica' AS fonte FROM S GROUP BY ALL""")
def _(spark, sf_dir):
    return indices.monthly_index(indices.sheet_series(_grid(spark, sf_dir))).withColumns({c: F.round(c, 9) for c in ("yield_p10", "yield_p90")}).drop("dispersao")


@query("index_coverage", _LONG + " SELECT campo, count(*)::BIGINT AS meses, 1.0::DOUBLE AS preenchido, max(mes_referencia) AS ate FROM S GROUP BY campo")
def _(spark, sf_dir):
    return indices.coverage(indices.sheet_series(_grid(spark, sf_dir)))


def _api(spark, sf_dir):
    """API rows by month of orders: four variables, one of them absent in even months, and one that is unknown."""
    months = read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("D3C")).agg(F.count("*").alias("n"))
    codes = F.array(*(F.struct(F.lit(c).alias("D2C"), v.alias("V")) for c, v in {"63": F.col("n").cast("string"), "2265": F.when(F.substring("D3C", 5, 2).cast("int") % 2 == 1, F.concat(F.col("n").cast("string"), F.lit(".5"))).otherwise("..."), "69": F.lit("-"), "9": F.lit("1")}.items()))
    return months.select("D3C", F.explode(codes).alias("x")).select("x.*", "D3C")


_API = """WITH M AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1),
 S AS (SELECT 'Brasil' AS recorte, m AS mes_referencia, 'ipca_mensal' AS campo, n::DOUBLE AS valor FROM M UNION ALL SELECT 'Brasil', m, 'ipca_12m', CASE WHEN substr(m, 6, 2)::INT % 2 = 1 THEN n + 0.5 END FROM M UNION ALL SELECT 'Brasil', m, 'ipca_ano', NULL FROM M)"""


@query("inflation_series", _API + " SELECT * FROM S")
def _(spark, sf_dir):
    return indices.api_series(_api(spark, sf_dir))


@query("inflation_monthly", _API + """ SELECT recorte, mes_referencia, max(valor) FILTER (campo = 'ipca_mensal') AS ipca_mensal, max(valor) FILTER (campo = 'ipca_12m') AS ipca_12m, NULL::DOUBLE AS ipca_ano, NULL::DOUBLE AS ipca_indice,
  'IBGE/SIDRA tabela 1737 -- IPCA' AS fonte FROM S WHERE valor IS NOT NULL GROUP BY ALL""")
def _(spark, sf_dir):
    return indices.monthly_inflation(indices.api_series(_api(spark, sf_dir)))


def _addresses(spark, sf_dir):
    p = F.col("p_partkey")
    d = read(spark, sf_dir, "part").select(
        F.concat(F.substring(F.lpad((p * 37 % 900).cast("string"), 5, "0"), 1, 5), F.lit("-"), F.lpad((p % 7).cast("string"), 3, "0")).alias("CEP"),
        F.when(p % 3 == 0, "R.").when(p % 3 == 1, "AV").otherwise("Rua").alias("NOM_TIPO_SEGLOGR"), F.concat(F.lit("José "), F.col("p_brand")).alias("NOM_SEGLOGR"),
        F.when(p % 11 == 0, "sem").otherwise((-20 - p % 10 / 8).cast("string")).alias("Latitude"), (-46 - p % 4 / 4).cast("string").alias("LONGITUDE"))
    return register.projected(d).withColumn("municipio", F.lit("Santos"))


_STREETS = """WITH A AS (SELECT lpad((p_partkey * 37 % 900)::VARCHAR, 5, '0') || lpad((p_partkey % 7)::VARCHAR, 3, '0') AS cep,
  CASE WHEN p_partkey % 3 = 1 THEN 'avenida' ELSE 'rua' END || ' jose ' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS chave, CASE WHEN p_partkey % 11 <> 0 THEN -20 - p_partkey % 10 / 8 END AS lat, -46 - p_partkey % 4 / 4 AS lon FROM part)"""


@query("register_streets", _STREETS + """ , N AS (SELECT chave, cep, count(*) AS n FROM A GROUP BY ALL)
  SELECT 'Santos' AS municipio, chave, arg_max(cep, (n, cep)) AS cep, sum(n)::BIGINT AS n_enderecos, count(*)::BIGINT AS n_ceps FROM N GROUP BY chave""")
def _(spark, sf_dir):
    return register.street_lookup(_addresses(spark, sf_dir))


@query("register_points", _STREETS + " SELECT 'Santos' AS municipio, cep, median(lat) AS lat, median(lon) AS lon, count(*)::BIGINT AS n_enderecos FROM A WHERE lat IS NOT NULL GROUP BY cep")
def _(spark, sf_dir):
    return register.point_lookup(_addresses(spark, sf_dir))


def _base(spark, sf_dir):
    b = F.col("bedrooms")
    return listings(spark, sf_dir).withColumns({
        "bedrooms": F.when(b < 6, b - 1), "bathrooms": F.when(b % 2 == 0, b), "suites": b % 3, "parking_spots": F.when(b % 5 != 0, b % 4), "iptu_tax": F.when(b > 2, F.col("price") / 100),
        "floor_level": b * 2, "amen_piscina": b % 2 == 0, "amen_sauna": b % 3 == 0, "nega_garagem": b == 4})


_BASE = """ , B AS (SELECT tie, area_m2, condo_fee, price, bedrooms AS b, CASE WHEN bedrooms < 6 THEN bedrooms - 1 END AS bedrooms, CASE WHEN bedrooms % 2 = 0 THEN bedrooms END AS bathrooms, bedrooms % 3 AS suites,
  CASE WHEN bedrooms % 5 <> 0 THEN bedrooms % 4 END AS parking_spots, CASE WHEN bedrooms > 2 THEN price / 100 END AS iptu_tax, bedrooms * 2 AS floor_level FROM L)"""


@query("base_features", _BASE + """ SELECT tie, area_m2 / nullif(bedrooms, 0) AS area_por_quarto, bathrooms / nullif(bedrooms, 0) AS banhos_por_quarto, suites / nullif(bedrooms, 0) AS suites_por_quarto, parking_spots / nullif(bedrooms, 0) AS vagas_por_quarto,
  CASE WHEN bedrooms IS NULL AND bathrooms IS NULL THEN NULL ELSE coalesce(bedrooms, 0) + coalesce(bathrooms, 0) END::INT AS comodos, round(iptu_tax / nullif(area_m2, 0), 9) AS iptu_por_m2, round(ln(area_m2), 9) AS log_area,
  ((bedrooms IS NULL)::INT + (bathrooms IS NULL)::INT + (parking_spots IS NULL)::INT + (iptu_tax IS NULL)::INT)::INT AS n_campos_ausentes, ((b % 2 = 0)::INT + (b % 3 = 0)::INT)::INT AS n_amenidades, (b = 4)::INT AS n_negacoes FROM B""")
def _(spark, sf_dir):
    out = features.base_features(_base(spark, sf_dir))
    return out.select("tie", "area_por_quarto", "banhos_por_quarto", "suites_por_quarto", "vagas_por_quarto", "comodos", F.round("iptu_por_m2", 9).alias("iptu_por_m2"), F.round("log_area", 9).alias("log_area"), "n_campos_ausentes", "n_amenidades", "n_negacoes")


_POINTS = """ , P AS (SELECT lpad((p_partkey % 1000)::VARCHAR, 8, '0') AS k, min((-20 - p_partkey % 17 / 8, -46 - p_partkey % 5 / 4, p_partkey % 9)) AS p FROM part GROUP BY 1),
 J AS (SELECT tie, city, p[1] AS lat, p[2] AS lon, p[3]::BIGINT AS n_end FROM L LEFT JOIN P ON k = cep),
 X AS (SELECT tie, n_end, CASE WHEN lat IS NULL THEN NULL WHEN max(lat) OVER w = min(lat) OVER w THEN 0.5 ELSE (lat - min(lat) OVER w) / (max(lat) OVER w - min(lat) OVER w) END AS la,
  CASE WHEN lon IS NULL THEN NULL WHEN max(lon) OVER w = min(lon) OVER w THEN 0.5 ELSE (lon - min(lon) OVER w) / (max(lon) OVER w - min(lon) OVER w) END AS lo FROM J WINDOW w AS (PARTITION BY city))"""


@query("geo_features", _POINTS + """ SELECT tie, n_end AS cep_n_enderecos, round(la, 9) AS cep_lat_mm, round(lo, 9) AS cep_lon_mm, round(la * lo, 9) AS geo_prod, round(la + lo, 9) AS geo_soma, round(la - lo, 9) AS geo_dif,
  round(sqrt((la - 0.5) * (la - 0.5) + (lo - 0.5) * (lo - 0.5)), 9) AS geo_raio FROM X""")
def _(spark, sf_dir):
    p = F.col("p_partkey")
    points = read(spark, sf_dir, "part").select((p % 1000).cast("string").alias("cep"), (-20 - p % 17 / 8).alias("lat"), (-46 - p % 5 / 4).alias("lon"), (p % 9).alias("n_end"))
    out = features.interactions(features.located(listings(spark, sf_dir), points))
    return out.select("tie", "cep_n_enderecos", *(F.round(c, 9).alias(c) for c in ("cep_lat_mm", "cep_lon_mm", "geo_prod", "geo_soma", "geo_dif", "geo_raio")))


@query("encoded_rows", """ , T AS (SELECT * FROM L WHERE tie % 3 <> 0 AND city <> 'NATION_5'), G AS (SELECT avg(ln(price / area_m2)) AS g FROM T),
 E AS (SELECT city, sum(ln(price / area_m2)) AS s, count(*)::BIGINT AS n FROM T GROUP BY city)
 SELECT tie, round(coalesce((s + 20 * g) / (n + 20), g), 6) AS te_city, coalesce(n, 0)::BIGINT AS n_city FROM L CROSS JOIN G LEFT JOIN E USING (city)""")
def _(spark, sf_dir):
    rows = listings(spark, sf_dir)
    out = features.encoded(rows.where("tie % 3 <> 0 AND city <> 'NATION_5'"), rows, ["city"], F.ln(F.col("price") / F.col("area_m2")))
    return out.select("tie", F.round("te_city", 6).alias("te_city"), "n_city")


@query("fusion_report", """ , K AS (SELECT city, neighborhood, bedrooms, CASE WHEN bedrooms <> 3 THEN area_m2 END AS area_m2, condo_fee FROM L), C AS (SELECT * FROM K WHERE area_m2 IS NOT NULL),
 G AS (SELECT count(*) AS n FROM C GROUP BY city, neighborhood, bedrooms, area_m2)
 SELECT (SELECT count(*) FROM K)::BIGINT AS linhas_antes, (SELECT count(*) FROM G)::BIGINT + (SELECT count(*) FROM K WHERE area_m2 IS NULL)::BIGINT AS linhas_depois, (SELECT count(*) FROM K WHERE area_m2 IS NULL)::BIGINT AS inelegiveis,
  (SELECT coalesce(sum(n), 0) FROM G WHERE n > 1)::BIGINT AS em_grupo, (SELECT count(*) FROM G WHERE n > 1)::BIGINT AS grupos, (SELECT count(*) FROM C)::BIGINT - (SELECT count(*) FROM G)::BIGINT AS perdidas""")
def _(spark, sf_dir):
    d = listings(spark, sf_dir).withColumn("area_m2", F.when(F.col("bedrooms") != 3, F.col("area_m2")))
    keys = ["city", "neighborhood", "bedrooms", "area_m2"]
    return features.fusion_report(d, training.fused(d, keys, ["tie"], ["condo_fee"], ["property_id"]), keys, ["condo_fee"]).select("linhas_antes", "linhas_depois", "inelegiveis", "em_grupo", "grupos", "perdidas")


@query("level_lists", """ , X AS (SELECT DISTINCT 'city' AS campo, city AS nivel FROM L UNION SELECT DISTINCT 'transaction_type', transaction_type FROM L)
 SELECT campo, string_agg(nivel, '|' ORDER BY nivel) AS niveis FROM X GROUP BY campo""")
def _(spark, sf_dir):
    return features.levels(listings(spark, sf_dir), ["city", "transaction_type"]).select("campo", F.array_join("niveis", "|").alias("niveis"))


@query("neighbourhood_lists", " , X AS (SELECT DISTINCT city, neighborhood FROM L) SELECT city, string_agg(neighborhood, '|' ORDER BY neighborhood) AS bairros FROM X GROUP BY city")
def _(spark, sf_dir):
    return features.neighbourhoods(listings(spark, sf_dir)).select("city", F.array_join("bairros", "|").alias("bairros"))


@query("spelled_neighbourhoods", """, X AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'vila embaré' WHEN p_partkey % 3 = 1 THEN 'VILA EMBARE' ELSE 'ponta da praia' END AS b FROM part)
 SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'Ponta da Praia' ELSE 'Vila Embaré' END AS bairro FROM X""".replace(", X AS", "WITH X AS", 1))
def _(spark, sf_dir):
    m = F.col("p_partkey") % 3
    d = read(spark, sf_dir, "part").select("p_partkey", F.when(m == 0, "vila embaré").when(m == 1, "VILA EMBARE").otherwise("ponta da praia").alias("bairro"))
    titled = d.select(features.vocabulary.titled(F.col("bairro")).alias("form"))
    return features.spelled(d, "bairro", market.canonical_spelling(folds.folded(titled, "form", "ascii_key", "chave"), "chave", "form"))


@query("detail_over_search", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'd' || o_orderstatus ELSE o_orderstatus END AS estado, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS preco FROM orders""")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    search = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("estado"))
    detail = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("d"), "o_orderstatus")).alias("estado"), F.col("o_totalprice").alias("preco"))
    return features.merged(search, detail, "k")


@query("client_keys", "SELECT c_custkey, substr(sha256('sal' || c_name), 1, 16) AS chave FROM customer")
def _(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", features.client_key(F.col("c_name"), "sal").alias("chave"))


@query("neighbourhood_view", " SELECT city AS cidade, neighborhood AS bairro, count(*)::BIGINT AS n_anuncios, median(price) AS preco_mediano, CASE WHEN min(bedrooms) = 1 THEN min(area_m2) END AS lat FROM L WHERE city = 'NATION_1' GROUP BY ALL HAVING min(bedrooms) = 1")
def _(spark, sf_dir):
    d = listings(spark, sf_dir).groupBy(F.col("city").alias("cidade"), F.col("neighborhood").alias("bairro")).agg(F.count("*").alias("n_anuncios"), F.median("price").alias("preco_mediano"), F.when(F.min("bedrooms") == 1, F.min("area_m2")).alias("lat"))
    return views.neighbourhood_view(d, "Nation-1", True)


@query("neighbourhood_totals", " , N AS (SELECT city, neighborhood, min(bedrooms) = 2 AS sem FROM L GROUP BY ALL) SELECT (count(*) FILTER (NOT sem))::BIGINT AS n, count(*)::BIGINT AS n_total, (count(*) FILTER (sem))::BIGINT AS sem_coordenada FROM N")
def _(spark, sf_dir):
    d = listings(spark, sf_dir).groupBy(F.col("city").alias("cidade"), "neighborhood").agg(F.when(F.min("bedrooms") != 2, 1.0).alias("lat"))
    return views.neighbourhood_totals(d, with_point=True)


@query("tail_per_city", " SELECT city, mes_referencia, n FROM (SELECT city, mes_referencia, count(*)::BIGINT AS n FROM L GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY city ORDER BY mes_referencia DESC) <= 3")
def _(spark, sf_dir):
    return views.tail_per_group(listings(spark, sf_dir).groupBy("city", "mes_referencia").agg(F.count("*").alias("n")), ["city"], "mes_referencia", 3)


@query("segment_rows", " SELECT tie, price FROM L WHERE transaction_type = 'venda' AND price <= 50000")
def _(spark, sf_dir):
    return features.segment(listings(spark, sf_dir), "venda_ate800k", 50_000.0).select("tie", "price")


@query("city_cut", " SELECT tie FROM L WHERE city = 'NATION_3'")
def _(spark, sf_dir):
    return features.city_cut(listings(spark, sf_dir), "nation_3").select("tie")


@query("request_rows", """SELECT p_partkey, p_size::DOUBLE AS area_m2, CASE p_size % 3 WHEN 0 THEN 'mar_total' WHEN 1 THEN 'livre' ELSE 'nao_menciona' END AS rx_vista, p_size % 2 = 0 AS amen_piscina, p_size % 5 = 0 AS sem_elevador FROM part""")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("area"), F.when(F.col("p_size") % 3 == 0, "mar").when(F.col("p_size") % 3 == 1, "livre").alias("vista"), F.when(F.col("p_size") % 2 == 0, True).alias("piscina"), F.when(F.col("p_size") % 5 == 0, False).otherwise(F.when(F.col("p_size") % 5 == 1, True)).alias("elevador"))
    questions = [
        {"api": "area", "columns": ["area_m2"], "kind": "number"}, {"api": "vista", "columns": ["rx_vista"], "kind": "category", "map": {"mar": "mar_total", "livre": "livre"}, "default": "nao_menciona"},
        {"api": "piscina", "columns": ["amen_piscina"], "kind": "boolean"}, {"api": "elevador", "columns": ["sem_elevador"], "kind": "boolean", "inverted": ("sem_elevador",)}]
    return features.request_rows(p, questions)
