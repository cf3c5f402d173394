"""Queries of the capture readers, vocabularies, catalogue and lake writers on payloads that Spark makes from the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, folds, pii, vocabulary
from ..operators import boosting, catalogue, enrichment, features, ingestion, modelling, training, views
from ..sources import captures, html_platforms, indices, lake, models, pages
from ..sources.listings import SQL as L
from ..sources.listings import dealt, listings, read

QUERIES: dict = {}
SQL: dict = {}
assert html_platforms  # its readers register themselves


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH L AS ({L})" + sql if "FROM L" in sql or "JOIN L" in sql else sql.lstrip(", ")
        return f

    return keep


#: One home a part: k, thousands of its price, area, rooms, and so on.
_HOME = """WITH P AS (SELECT p_partkey AS k, (p_partkey * 137 % 900 + 100) AS mil, 30 + p_size AS area, (p_partkey % 5)::INT AS quartos, (p_partkey % 3 + 1)::INT AS banhos, (p_partkey % 3)::INT AS suites,
  (p_partkey % 4)::INT AS vagas, 200 + p_partkey % 50 * 10 AS condo, p_partkey % 7 * 100 AS iptu, (p_partkey % 20)::INT AS andar, replace(p_brand, '#', ' ') AS bairro, p_name AS nome FROM part)"""


def _homes(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return dealt(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_name"), "p_partkey").select(
        k.alias("k"), (k * 137 % 900 + 100).alias("mil"), (30 + F.col("p_size")).alias("area"), (k % 5).alias("quartos"), (k % 3 + 1).alias("banhos"), (k % 3).alias("suites"), (k % 4).alias("vagas"),
        (200 + k % 50 * 10).alias("condo"), (k % 7 * 100).alias("iptu"), (k % 20).alias("andar"), F.translate("p_brand", "#", " ").alias("bairro"), F.col("p_name").alias("nome"))


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _captured(homes: DataFrame, platform: str, url, body) -> DataFrame:
    rows = homes.select(F.lit(platform).alias("platform"), url.alias("url"), F.when(F.col("k") % 2 == 0, "venda").otherwise("locacao").alias("transaction"), body.alias("body"), F.lit("Santos").alias("hint_city"), F.lit("SP").alias("hint_state"))
    return captures.READERS[platform](rows)


@query("capture_flags", _HOME + """ SELECT k::VARCHAR || '-' || CASE WHEN k % 2 = 0 THEN 'venda' ELSE 'locacao' END AS listing_id, CASE WHEN k % 2 = 0 THEN 'venda' ELSE 'locacao' END AS transaction_type, mil * 1000::DOUBLE AS price, area::DOUBLE AS area_m2,
  quartos AS bedrooms, suites, vagas AS parking_spots, condo::DOUBLE AS condo_fee, nullif(iptu, 0)::DOUBLE AS iptu_tax, andar AS floor_level, bairro AS neighborhood,
  concat_ws('|', CASE WHEN k % 2 = 0 THEN 'Piscina' END, CASE WHEN k % 3 = 0 THEN 'Sauna' END) AS amenities FROM P""")
def _(spark, sf_dir):
    c = F.col
    body = F.to_json(F.struct(
        c("k").alias("codigo"), F.lit("Apartamento").alias("tipo"), c("bairro").alias("bairro"), F.lit("Santos").alias("cidade"), F.lit("SP").alias("estado"),
        F.when(c("k") % 3 == 0, F.lit("0")).otherwise((c("mil") * 1000).cast("string")).alias("valortratado"), _text("R$ ", c("mil"), ".000,00").alias("valor"),
        F.when(c("k") % 4 != 0, (c("area") * 100).cast("string")).alias("areaprincipaltratado"), _text(c("area"), ",00").alias("areainterna"), c("quartos").cast("string").alias("numeroquartos"),
        c("suites").cast("string").alias("numerosuites"), c("vagas").cast("string").alias("numerovagas"), _text(c("condo"), ",00").alias("valorcondominio"), c("iptu").cast("string").alias("valoriptu"),
        c("andar").cast("string").alias("numeroandar"), F.when(c("k") % 2 == 0, "1").otherwise("0").alias("piscina"), F.when(c("k") % 3 == 0, "1").alias("sauna"), F.lit("13 98888-7777").alias("telefone")))
    out = _captured(_homes(spark, sf_dir), "universal", _text("https://u.com/", c("k")), body)
    return out.select("listing_id", "transaction_type", "price", "area_m2", "bedrooms", "suites", "parking_spots", "condo_fee", "iptu_tax", "floor_level", "neighborhood", F.array_join("amenities", "|").alias("amenities"))


@query("capture_catalogue", _HOME + """, R AS (SELECT *, 'venda' AS t, mil * 1000::DOUBLE AS price FROM P WHERE k % 2 = 0 UNION ALL SELECT *, 'locacao', mil * 10::DOUBLE FROM P WHERE k % 3 = 0)
  SELECT 'c' || k::VARCHAR || '-' || t AS listing_id, t AS transaction_type, price, area::DOUBLE AS area_m2, CASE WHEN k % 4 <> 0 THEN (area + 5)::DOUBLE END AS area_total_m2, quartos AS bedrooms, banhos AS bathrooms,
  nullif(iptu, 0)::DOUBLE AS iptu_tax, 'https://b.com/' || k::VARCHAR AS link, CASE WHEN k % 5 = 0 THEN '' ELSE nome END AS amenities FROM R""")
def _(spark, sf_dir):
    c = F.col
    body = F.to_json(F.struct(
        _text("c", c("k")).alias("code"), _text("https://b.com/", c("k")).alias("details_url"), F.lit("Casa").alias("type_text"), F.lit("Santos").alias("city_name"), F.lit("SP").alias("uf"), c("bairro").alias("neighborhood_name"),
        _text(c("mil") * 1000, ".00").alias("sale_price"), _text(c("mil") * 10, ".00").alias("rent_price"), (c("k") % 2 == 0).alias("for_sale"), (c("k") % 3 == 0).alias("for_rent"), c("iptu").cast("string").alias("iptu_price"),
        c("area").cast("string").alias("area_useful"), F.when(c("k") % 4 != 0, (c("area") + 5).cast("string")).otherwise("0").alias("area_total"), c("quartos").cast("string").alias("dorms_count"), c("banhos").cast("string").alias("bathroom_count"),
        F.when(c("k") % 5 != 0, F.array(F.struct(c("nome").alias("name")), F.struct(F.lit("").alias("name")))).alias("features"), F.struct(F.lit("Ana").alias("nome")).alias("corretor")))
    out = _captured(_homes(spark, sf_dir), "microsistec_b", F.lit("https://b.com"), body)
    return out.select("listing_id", "transaction_type", "price", "area_m2", "area_total_m2", "bedrooms", "bathrooms", "iptu_tax", "link", F.array_join("amenities", "|").alias("amenities"))


@query("capture_product", _HOME + """, R AS (SELECT *, 'venda' AS t, mil * 1000::DOUBLE AS price FROM P UNION ALL SELECT *, 'locacao', mil * 10::DOUBLE FROM P WHERE k % 3 = 0)
  SELECT 's' || k::VARCHAR || '-' || t AS listing_id, t AS transaction_type, price, condo::DOUBLE AS condo_fee, area::DOUBLE AS area_m2, quartos AS bedrooms, CASE WHEN k % 2 = 0 THEN vagas END AS parking_spots, bairro AS neighborhood,
  'Academia|' || nome AS amenities FROM R""")
def _(spark, sf_dir):
    c = F.col
    attr = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    product = F.struct(
        _text("s", c("k")).alias("sku"), F.when(c("k") % 3 == 0, F.array(F.lit("sale"), F.lit("rent"))).otherwise(F.array(F.lit("sale"))).alias("dealTypes"), F.lit("Apartamento").alias("divisionType"),
        F.struct((c("mil") * 1000).cast("string").alias("sale"), (c("mil") * 10).cast("string").alias("rent"), c("condo").cast("string").alias("condominium"), F.lit("0").alias("property")).alias("prices"),
        F.struct(F.lit("Santos").alias("city"), F.lit("SP").alias("stateInitials"), c("bairro").alias("neighborhood")).alias("address"),
        F.array_compact(F.array(attr("bedroom_attr", F.lit("9 quartos")), attr("area_attr", _text(c("area"), "m²")), attr("bedroom_attr", _text(c("quartos"), " quartos")), F.when(c("k") % 2 == 0, attr("parking_lots_attr", c("vagas").cast("string"))))).alias("attributes"),
        F.struct(F.array(F.struct(F.lit("Academia").alias("name"))).alias("amenities")).alias("condominium"), F.array(F.struct(c("nome").alias("name"))).alias("features"))
    out = _captured(_homes(spark, sf_dir), "lopes", _text("https://l.com/", c("k")), F.to_json(F.struct(product.alias("product"))))
    return out.select("listing_id", "transaction_type", "price", "condo_fee", "area_m2", "bedrooms", "parking_spots", "neighborhood", F.array_join("amenities", "|").alias("amenities"))


@query("capture_property_page", _HOME + """ SELECT k::VARCHAR AS listing_id, CASE WHEN k % 3 = 0 THEN 'locacao' WHEN k % 2 = 0 THEN 'venda' ELSE 'locacao' END AS transaction_type, CASE WHEN k % 3 = 0 THEN 'apartamento padrão' END AS property_type, mil * 1000::DOUBLE AS price,
  bairro AS neighborhood, lpad(k::VARCHAR, 5, '0') || '300' AS cep, condo::DOUBLE AS condo_fee, nullif(iptu, 0)::DOUBLE AS iptu_tax, area::DOUBLE AS area_m2, quartos AS bedrooms, CASE WHEN k % 2 = 0 THEN vagas END AS parking_spots,
  'Academia|' || nome AS amenities, 'a descrição mais longa de ' || nome AS description_clean FROM P""")
def _(spark, sf_dir):
    c = F.col
    prop = lambda name, v: _text('{"name":"', F.lit(name), '","label":"x","value":', v, "}")
    quoted = lambda v: _text('"', v, '"')
    body = _text(
        '<script>{"listId":', c("k"), ',"price":"R$ ', c("mil"), '.000","zipcode":"', F.lpad(c("k").cast("string"), 5, "0"), '-300","neighbourhood":"', c("bairro"), '","municipality":"S\\u00e3o Vicente","properties":[',
        F.when(c("k") % 3 == 0, _text(prop("real_estate_type", F.lit('"Aluguel - apartamento padrão"')), ",")).otherwise(""), prop("condominio", _text('"R$ ', c("condo"), '"')), ",", prop("iptu", _text('"R$ ', c("iptu"), '"')), ",",
        prop("size", _text('"', c("area"), 'm²"')), ",", prop("rooms", _text('"', c("quartos"), ' ou mais"')), ",", prop("garage_spaces", F.when(c("k") % 2 == 0, quoted(c("vagas"))).otherwise("null")), ",", prop("re_features", _text('"Academia, ', c("nome"), '"')),
        ']}</script><script type="application/ld+json">{"description":"curta"}</script><script type="application/ld+json">{"Object":{"description":" a descrição mais longa de ', c("nome"), ' "}}</script><script type="application/ld+json">{bad</script>')
    out = _captured(_homes(spark, sf_dir), "olx", _text("https://o.com/", c("k")), body)
    return out.select("listing_id", "transaction_type", "property_type", "price", "neighborhood", "cep", "condo_fee", "iptu_tax", "area_m2", "bedrooms", "parking_spots", F.array_join("amenities", "|").alias("amenities"), "description_clean")


@query("capture_microdata_page", _HOME + """ SELECT 'v' || k::VARCHAR AS listing_id, CASE WHEN k % 5 <> 0 THEN 'apartamento' END AS property_type, mil * 1000::DOUBLE AS price, 'Santos' AS city, CASE WHEN k % 5 <> 0 THEN 'ponta da praia' END AS neighborhood, (1000 + condo)::DOUBLE AS condo_fee,
  nullif(iptu, 0)::DOUBLE AS iptu_tax, CASE WHEN k % 2 = 0 THEN quartos END AS bedrooms, vagas AS parking_spots, 'Aceita animais' AS amenities, nome AS description_clean FROM P WHERE k % 10 <> 3""")
def _(spark, sf_dir):
    c = F.col
    item = lambda name, v: _text('<li itemProp="', F.lit(name), '"><i></i><span class="amenities-item-text">', v, "</span></li>")
    page = _text(
        '<script type="application/ld+json">{"@type":"Product","sku":"v', c("k"), '","description":" ', c("nome"), ' ","offers":{"price":', c("mil") * 1000, '}}</script><span data-testid="condoFee" class="v">R$ 1.', c("condo"), '/mês</span><span data-testid="iptu">R$ ', c("iptu"), "</span>",
        item("numberOfRooms", F.when(c("k") % 2 == 0, _text(c("quartos"), " quartos")).otherwise("2 - 3 quartos")), item("numberOfParkingSpaces", _text(c("vagas"), " vagas")), item("PETS_ALLOWED", F.lit(" Aceita animais ")))
    url = F.when(c("k") % 5 != 0, _text("https://v.com/imovel/apartamento-2-quartos-ponta-da-praia-santos-com-garagem-id-", c("k"), "/")).otherwise(_text("https://v.com/imovel/imovel-comercial-id-", c("k"), "/"))
    out = _captured(_homes(spark, sf_dir), "vivareal", url, F.when(c("k") % 10 == 3, "<h1> Oops. </h1>").otherwise(page))
    return out.select("listing_id", "property_type", "price", "city", "neighborhood", "condo_fee", "iptu_tax", "bedrooms", "parking_spots", F.array_join("amenities", "|").alias("amenities"), "description_clean")


@query("capture_offers_page", _HOME + """, R AS (SELECT *, 'venda' AS t, mil * 1000::DOUBLE AS price FROM P UNION ALL SELECT *, 'locacao', 4000::DOUBLE + mil FROM P WHERE k % 3 = 0)
  SELECT 'AP' || (100 + k % 900)::VARCHAR || '-' || t AS listing_id, t AS transaction_type, price, 'Apartamento' AS property_type, 'São Vicente' AS city, 'SP' AS state, bairro AS neighborhood, area::DOUBLE AS area_m2, (area + 9)::DOUBLE AS area_total_m2, quartos AS bedrooms, suites,
  condo::DOUBLE AS condo_fee, 'Piscina|' || nome AS amenities, '2026-08-0' || (k % 9 + 1)::VARCHAR AS listing_first_seen FROM R""")
def _(spark, sf_dir):
    c = F.col
    offer = lambda kind, price: _text('{"@type":"Offer","businessFunction":"http://purl.org/goodrelations/v1#', F.lit(kind), '","price":"', price, '"}')
    body = _text(
        '<script type="application/ld+json">{"@graph":[{"@type":["RealEstateListing","Apartment"],"name":"Apartamento com quartos, ', c("area"), " m² - venda - ", c("bairro"), ' - São Vicente/SP","datePosted":"2026-08-0', c("k") % 9 + 1,
        'T10:00:00","agent":{"@type":"Person","telephone":"1"}},{"@type":"Apartment","numberOfBedrooms":', c("quartos"), ',"floorSize":{"@type":"QuantitativeValue","value":', c("area") + 9, '},"amenityFeature":[{"name":"Piscina"},{"name":""},{"name":"', c("nome"), '"}]},',
        offer("Sell", c("mil") * 1000), F.when(c("k") % 3 == 0, _text(",", offer("LeaseOut", _text("4.", c("mil"), ",00")))).otherwise(""), ',{"@type":"Offer","price":"1"}]}</script><strong>Condomínio</strong> R$ ', c("condo"), ',00<span class="uppercase">Suítes</span><span class="font-bold">', c("suites"), "</span>")
    out = _captured(_homes(spark, sf_dir), "veploy", _text("https://e.com/imovel/AP", 100 + c("k") % 900, "/apartamento"), body)
    return out.select("listing_id", "transaction_type", "price", "property_type", "city", "state", "neighborhood", "area_m2", "area_total_m2", "bedrooms", "suites", "condo_fee", F.array_join("amenities", "|").alias("amenities"), "listing_first_seen")


@query("capture_price_block_page", _HOME + """ SELECT k::VARCHAR AS listing_id, CASE WHEN k % 2 = 0 THEN 'locacao' ELSE 'venda' END AS transaction_type, mil * 1000::DOUBLE AS price, nullif(iptu, 0)::DOUBLE AS iptu_tax, quartos AS bedrooms, suites, area::DOUBLE AS area_m2, NULL::INT AS parking_spots,
  'Piscina|' || nome || '|Lavabo' AS amenities, 'Santos' AS city, 'Ponta Da Praia' AS neighborhood FROM P""")
def _(spark, sf_dir):
    c = F.col
    body = _text(
        '<div id="info-valores"><li><span>', F.when(c("k") % 2 == 0, "Locação").otherwise("Venda"), "</span><b>R$ ", c("mil"), ".000,00</b></li><li><span>IPTU</span><b>R$ ", c("iptu"), ",00</b></li></div><footer></footer><li><i></i><br><span>Dorm.</span><br><b>", c("quartos"),
        '</b></li><td><span><i class="fa"></i> sendo Suíte(s)</span></td><td class="r"><b>', c("suites"), "</b></td><span>Área (útil)</span><b>", c("area"), ' m2</b><section class="x tabs-caracteristicas"><li><i></i>Piscina</li><li>', F.regexp_replace("nome", " ", "  "),
        '</li></section><section class="tabs-rooms"><li>Piscina</li><li>Lavabo</li></section><div class="most-view"><span>Vagas</span><b>9</b></div>')
    out = _captured(_homes(spark, sf_dir), "microsistec_a", _text("https://m.com/", c("k"), "-apartamento-em-santos-bairro-ponta_da-praia.html"), body)
    return out.select("listing_id", "transaction_type", "price", "iptu_tax", "bedrooms", "suites", "area_m2", "parking_spots", F.array_join("amenities", "|").alias("amenities"), "city", "neighborhood")


def _ld_pages(spark, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "pages"), F.col("page_id")
    script = _text(
        '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"casa ', k, '","seller":{"@type":"Person","telephone":"1"},"offers":{"@type":"Offer","price":"', k * 10, '"}}', F.when(k % 2 == 0, ',{"@type":["Apartment","House"],"numberOfRooms":2}').otherwise(""),
        ',{"@type":"RealEstateAgent","name":"x"}]}</script><SCRIPT id="a" type="application/ld+json">', F.when(k % 3 == 0, "{bad").otherwise('[{"@type":"Place","name":["a","b"]}]'), "</SCRIPT>")
    return p.select("page_id", "url", F.concat("html", script).alias("html"))


@query("jsonld_blocks", """SELECT page_id, 2 + (page_id % 2 = 0)::INT + (page_id % 3 <> 0)::INT AS n_blocos, 'Product|Offer' || CASE WHEN page_id % 2 = 0 THEN '|Apartment+House' ELSE '' END || CASE WHEN page_id % 3 <> 0 THEN '|Place' ELSE '' END AS tipos FROM pages""")
def _(spark, sf_dir):
    d = _ld_pages(spark, sf_dir).select("page_id", pages.blocks(F.col("html")).alias("b"))
    return d.select("page_id", F.size("b").alias("n_blocos"), F.array_join(F.transform("b", lambda x: F.array_join(x["types"], "+")), "|").alias("tipos"))


@query("jsonld_values", """SELECT page_id, (page_id * 10)::VARCHAR AS preco, CASE WHEN page_id % 3 <> 0 THEN 'a' END AS lugar, CASE WHEN page_id % 2 = 0 THEN '2' END AS quartos, false AS contato FROM pages""")
def _(spark, sf_dir):
    d = _ld_pages(spark, sf_dir).select("page_id", pages.blocks(F.col("html")).alias("b"))
    at = lambda kinds, path: pages.first_of_type(F.col("b"), kinds, path)
    return d.select("page_id", at(("Product",), "offers.price").alias("preco"), at(("Place",), "name").alias("lugar"), at(("House",), "numberOfRooms").alias("quartos"), F.exists("b", lambda x: F.contains(x["json"], F.lit("telephone"))).alias("contato"))


_SITE = """WITH RECURSIVE S AS (SELECT page_id AS k FROM pages WHERE page_id > 0 AND page_id % 7 <> 0),
  R AS (SELECT k, 0 AS rodada FROM (VALUES (1), (2), (3)) t(k) UNION ALL SELECT R.k * 4 + d, rodada + 1 FROM R JOIN S USING (k), (VALUES (0), (1), (2), (3)) x(d))
  SELECT 'https://site.example/venda/' || regexp_replace(to_base(k, 4), '(.)', 'bairro\\1/', 'g') AS url, rodada, k IN (SELECT k FROM S) AS lida FROM R"""


@query("facet_harvest", _SITE)
def _(spark, sf_dir):
    p, k = read(spark, sf_dir, "pages").where("page_id > 0 AND page_id % 7 <> 0"), F.col("page_id")
    path = lambda n: F.concat(F.lit("/venda/"), F.regexp_replace(F.conv(n.cast("string"), 10, 4), "(.)", "bairro$1/"))
    links = _text(*(x for d in range(4) for x in ('<a href="', path(k * 4 + d), '">x</a>')), '<a href="', path(k), '">.</a><a href="', path(k), 'x?y=1/">.</a><a href="/outro/lugar/">.</a>')
    site = p.select(F.concat(F.lit("https://site.example"), path(k)).alias("url"), F.concat("html", links).alias("html"))
    seeds = spark.range(1, 4).select(F.concat(F.lit("https://site.example"), path(F.col("id"))).alias("url"))
    return pages.harvest(site, seeds)


_KINDS = ("Apartamento para alugar", "Casa em condomínio", "Kitnet 30 m2", "Sobrado", "Cobertura", "Galpão à venda", "Terreno", "Sala comercial", "Iate")
_TYPE = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(("'apartamento'", "'casa'", "'kitnet'", "'sobrado'", "'cobertura'", "'galpao'", "'terreno'", "'sala'", "NULL"))) + " END"


def _one_of(column, items):
    return F.element_at(F.array(*map(F.lit, items)), (column % len(items) + 1).cast("int"))


@query("property_types", f"""WITH X AS (SELECT p_partkey, {_TYPE} AS tipo FROM part) SELECT p_partkey, tipo, CASE WHEN tipo IN ('sala', 'galpao') THEN false WHEN tipo <> 'terreno' THEN true END AS residencial,
  CASE WHEN tipo IN ('apartamento', 'kitnet', 'cobertura') THEN 'residencial' WHEN tipo IN ('casa', 'sobrado') THEN 'casa' WHEN tipo IN ('sala', 'galpao') THEN 'comercial' WHEN tipo = 'terreno' THEN 'terreno' ELSE 'outro' END AS familia FROM X""")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", vocabulary.property_type(F.concat(F.col("p_name"), F.lit(" "), _one_of(F.col("p_partkey"), _KINDS))).alias("tipo"))
    return p.select("p_partkey", "tipo", vocabulary.residential(F.col("tipo")).alias("residencial"), vocabulary.family(F.col("tipo")).alias("familia"))


@query("municipalities", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'São Vicente' WHEN 1 THEN 'Embu das Artes' WHEN 2 THEN 'Vila Nova Do Sul' WHEN 3 THEN NULL END AS cidade,
  CASE c_custkey % 5 WHEN 0 THEN 'Sao Vicente' WHEN 1 THEN 'Embu das Artes' WHEN 2 THEN 'Vila Nova do Sul' WHEN 3 THEN 'Ribeiro dos Santos' END AS titulo FROM customer""")
def _(spark, sf_dir):
    names = F.element_at(F.array(F.lit("SAO  vicente"), F.lit("embu DAS artes"), F.lit(" vila  nova do sul"), F.lit("Ribeiro dos Santos"), F.lit("  ")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", vocabulary.municipality(names).alias("cidade"), vocabulary.titled(names).alias("titulo"))


@query("amenity_vocabulary", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'academia|piscina' WHEN 1 THEN 'armario na cozinha|vista eterna' ELSE '' END AS itens FROM supplier""")
def _(spark, sf_dir):
    lists = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("Piscina Adulto"), F.lit("Fitness"), F.lit("piscina"), F.lit("-"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("Vista Eterna"), F.lit("Cozinha Planejada"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(vocabulary.amenities(lists), "|").alias("itens"))


@query("label_columns", """SELECT p_partkey, p_partkey % 2 = 0 AS amen_piscina, p_partkey % 3 = 0 AS amen_sauna, p_partkey % 2 = 0 OR p_partkey % 3 = 0 AS agua, p_partkey % 5 = 0 AS carro FROM part""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    labels = F.array_compact(F.array(F.when(k % 2 == 0, "Piscina"), F.when(k % 3 == 0, "Sauna"), F.when(k % 5 == 0, "Garagem")))
    d = read(spark, sf_dir, "part").select("p_partkey", labels.alias("itens"))
    d = training.label_families(training.one_hot(d, "itens", {"Piscina": "amen_piscina", "Sauna": "amen_sauna"}), "itens", {"agua": ["Piscina", "Sauna"], "carro": ["Garagem"]})
    return d.drop("itens")


@query("coercion_texts", r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'locacao' WHEN 1 THEN 'venda' END AS transacao, 202600 + page_id % 12 + 1 AS mes, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'SP' END AS uf, (page_id % 5 + 1)::INT AS n_itens,
  CASE WHEN page_id % 10 = 0 THEN NULL ELSE (page_id % 10) * 1000.5::DOUBLE END AS valor_br, CASE WHEN page_id % 10 = 0 THEN NULL ELSE (page_id % 10) * 1000.5::DOUBLE END AS valor_us,
  substr(sha1(CASE WHEN page_id % 2 = 0 THEN 'd.com|' || page_id::VARCHAR ELSE 'url|d.com/' || page_id::VARCHAR END), 1, 20) AS property_id FROM pages""")
def _(spark, sf_dir):
    k = F.col("page_id")
    p = read(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, "casa-para-alugar").when(k % 3 == 1, "apartamento-a-venda").otherwise("outra-coisa").alias("slug"), F.concat(F.lit("2026-"), F.lpad((k % 12 + 1).cast("string"), 2, "0")).alias("mes"),
        F.when(k % 4 == 0, "São Paulo").otherwise(" sp ").alias("uf"), F.array_join(F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.concat(F.lit(" x"), i.cast("string"), F.lit(" , "))), ",").alias("lista"),
        F.concat(F.lit("R$ "), F.when(k % 10 == 0, "0").otherwise(F.concat((k % 10).cast("string"), F.lit("."), F.format_string("%03d", (k % 10 * 1000.5).cast("long") - k % 10 * 1000), F.when(k % 2 == 1, ",5").otherwise(",0")))).alias("br"), (k % 10 * 1000.5).cast("string").alias("us"))
    return p.select(
        "page_id", coerce.transaction(F.col("slug")).alias("transacao"), coerce.month_number(F.col("mes")).cast("long").alias("mes"), coerce.state(F.col("uf")).alias("uf"), F.size(coerce.split_list(F.col("lista"))).alias("n_itens"),
        coerce.brazilian_or_plain(F.col("br"), False).alias("valor_br"), coerce.brazilian_or_plain(F.col("us"), True).alias("valor_us"),
        coerce.property_id(F.lit("d.com"), F.when(k % 2 == 0, k.cast("string")), F.concat(F.lit("https://www.D.com/"), k.cast("string"), F.lit("/?a=1"))).alias("property_id"))


@query("joined_layers", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return catalogue.joined_layers([o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus")], "o_orderkey")


@query("request_errors", """WITH X AS (SELECT p_partkey, p_size * 60.0 AS area_m2, p_size % 15 AS bedrooms, p_partkey % 5 AS suites FROM part)
  SELECT p_partkey, CASE WHEN area_m2 NOT BETWEEN 15 AND 2000 THEN 'area_m2' WHEN bedrooms NOT BETWEEN 0 AND 12 THEN 'bedrooms' WHEN suites > bedrooms THEN 'suites' END AS erro,
  concat_ws('|', CASE WHEN p_partkey % 2 = 0 THEN 'condo_fee' END, CASE WHEN p_partkey % 3 = 0 THEN 'iptu_tax' END) AS ausentes FROM X""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    d = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 60.0).alias("area_m2"), (F.col("p_size") % 15).alias("bedrooms"), (k % 5).alias("suites"), F.when(k % 2 != 0, 1.0).alias("condo_fee"), F.when(k % 3 != 0, 1.0).alias("iptu_tax"))
    out = catalogue.missing_optionals(catalogue.requests_to_rows(d, {c: catalogue.PHYSICAL[c] for c in ("area_m2", "bedrooms")}), ["condo_fee", "iptu_tax"])
    return out.select("p_partkey", "erro", F.array_join("ausentes", "|").alias("ausentes"))


@query("level_options", """ , X AS (SELECT DISTINCT 'city' AS campo, city AS nivel FROM L UNION SELECT DISTINCT 'transaction_type', transaction_type FROM L)
 SELECT campo, nivel, CASE nivel WHEN 'venda' THEN 'Comprar' ELSE replace(nivel, '_', ' ') END AS rotulo FROM X WHERE nivel = 'venda' OR campo = 'city' AND nivel IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)""")
def _(spark, sf_dir):
    even = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.lit("city").alias("campo"), F.col("n_name").alias("nivel"))
    allowed = even.unionByName(even.limit(1).select(F.lit("transaction_type").alias("campo"), F.lit("venda").alias("nivel")))
    return features.options(features.levels(listings(spark, sf_dir), ["city", "transaction_type"]), allowed, {"venda": "Comprar"})


@query("ordered_columns", "SELECT p_partkey, p_size AS area, p_partkey % 2 = 0 AS amen_comum, 'amen_comum' AS com_apoio FROM part")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    d = read(spark, sf_dir, "part").select((k % 40 == 50).alias("amen_raro"), (k % 2 == 0).alias("amen_comum"), F.col("p_size").alias("area"), "p_partkey", k.alias("_interna"))
    apoio = features.supported_flags(d, 10)
    return features.form_matrix(features.ordered(features.matrix(d), ["p_partkey", "area", "nada"], apoio, ["area"]), ["p_partkey", "area", "amen_comum"]).withColumn("com_apoio", F.lit("|".join(apoio)))


@query("collection_plan", """WITH S AS (SELECT 'd' || s_suppkey::VARCHAR AS domain, 'p' || (s_suppkey % 3)::VARCHAR AS platform, s_suppkey % 5 <> 0 AS enabled, n_name AS own, s_suppkey % 4 = 0 AS every FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  T AS (SELECT n_name AS city, n_regionkey::VARCHAR AS state FROM nation WHERE n_nationkey % 2 = 0)
  SELECT domain, platform, city, state, t AS transaction FROM S JOIN T ON every OR own = city, (VALUES ('venda'), ('locacao')) x(t) WHERE enabled""")
def _(spark, sf_dir):
    k, nation = F.col("s_suppkey"), read(spark, sf_dir, "nation")
    s = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("d"), k.cast("string")).alias("domain"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("platform"), (k % 5 != 0).alias("enabled"), F.when(k % 4 != 0, F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("cities"), F.array(F.lit("venda"), F.lit("locacao")).alias("transactions"))
    targets = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("city"), F.col("n_regionkey").cast("string").alias("state"))
    return catalogue.checked_transactions(catalogue.collection_plan(s, targets).withColumnRenamed("transaction", "transaction_type")).withColumnRenamed("transaction_type", "transaction").select("domain", "platform", "city", "state", "transaction")


@query("serving_sources", "SELECT 'd' || s_suppkey::VARCHAR AS domain FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0 AND s_suppkey % 3 = 1 AND (s_suppkey % 4 = 0 OR n_name = 'NATION_3')")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("d"), k.cast("string")).alias("domain"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("platform"), (k % 5 != 0).alias("enabled"), F.when(k % 4 != 0, F.array("n_name")).alias("cities"))
    return catalogue.serving_sources(s, "p1", "NATION_3").select("domain")


@query("availability", """WITH M AS (SELECT 'NATION_' || (c_custkey % 25)::VARCHAR AS city, CASE WHEN c_custkey % 2 = 0 THEN 'venda' ELSE 'locacao' END AS target, max('2026-' || lpad((c_custkey % 90)::VARCHAR, 3, '0')) AS version FROM customer WHERE c_custkey % 7 = 0 GROUP BY ALL)
  SELECT n_name AS city, t AS target, version, n_nationkey % 6 <> 0 AND version IS NOT NULL AS served, CASE WHEN n_nationkey % 6 = 0 THEN CASE WHEN n_nationkey % 4 = 0 THEN 'unavailable' ELSE 'poucos' END WHEN version IS NULL THEN 'no model' END AS reason
  FROM nation CROSS JOIN (VALUES ('venda'), ('locacao')) x(t) LEFT JOIN M ON city = n_name AND target = t""")
def _(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    models = read(spark, sf_dir, "customer").select(F.concat(F.lit("NATION_"), (k % 25).cast("string")).alias("city"), F.when(k % 2 == 0, "venda").otherwise("locacao").alias("target"), F.concat(F.lit("2026-"), F.lpad((k % 90).cast("string"), 3, "0")).alias("version"), (k % 7 == 0).alias("complete"))
    pairs = read(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), F.explode(F.array(F.lit("venda"), F.lit("locacao"))).alias("target"), (n % 6 != 0).alias("available"), F.when(n % 4 != 0, "poucos").alias("why"))
    return catalogue.availability(pairs, models)


@query("availability_by_city", "SELECT n_name AS city, (CASE WHEN n_nationkey % 6 <> 0 THEN 2 ELSE 1 END)::BIGINT AS n_available, CASE WHEN n_nationkey % 6 = 0 THEN 'poucos' END AS motivo FROM nation")
def _(spark, sf_dir):
    n = F.col("n_nationkey")
    pairs = read(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), n, F.explode(F.array(F.lit("venda"), F.lit("locacao"))).alias("target")).withColumn("available", (F.col("target") == "venda") | (n % 6 != 0))
    out = catalogue.nested(pairs.withColumn("why", F.when(~F.col("available"), "poucos")))
    return out.select("city", "n_available", F.col("targets")["locacao"]["why"].alias("motivo"))


@query("city_yields", """WITH Y AS (SELECT n_name AS city, 0.001::DOUBLE * (n_nationkey % 5) AS p10, 0.004 AS median, 0.005 AS p90 FROM nation WHERE n_nationkey % 2 = 0)
  SELECT n_name AS city, CASE WHEN y.city IS NOT NULL THEN y.p10 ELSE 0.002 END::DOUBLE AS p10, CASE WHEN y.city IS NOT NULL THEN 0.004 ELSE 0.003 END::DOUBLE AS median, CASE WHEN y.city IS NOT NULL THEN 0.005 ELSE 0.006 END::DOUBLE AS p90, CASE WHEN y.city IS NOT NULL THEN 'published' ELSE 'manual' END AS origin
  FROM nation LEFT JOIN (SELECT * FROM Y WHERE p10 > 0) y ON city = n_name WHERE y.city IS NOT NULL OR n_nationkey % 3 = 0""")
def _(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    published = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("city"), (F.lit(0.001) * (F.col("n_nationkey") % 5)).alias("p10"), F.lit(0.004).alias("median"), F.lit(0.005).alias("p90"))
    manual = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("city"), F.lit(0.002).alias("p10"), F.lit(0.003).alias("median"), F.lit(0.006).alias("p90"))
    return catalogue.yields(published, manual)


@query("catalogue_summary", "SELECT count(*)::BIGINT AS total, count(*) FILTER (n_nationkey % 3 = 0)::BIGINT AS coletando, count(*) FILTER (n_nationkey % 3 = 1)::BIGINT AS inventariando, count(*) FILTER (n_nationkey % 3 = 2)::BIGINT AS a_inventariar, string_agg(DISTINCT n_regionkey::VARCHAR, '|' ORDER BY n_regionkey::VARCHAR) AS ufs FROM nation")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "nation").select(_one_of(F.col("n_nationkey"), ("coletando", "inventariando", "a_inventariar")).alias("estado"), F.col("n_regionkey").cast("string").alias("uf"))
    return views.catalogue_summary(d).withColumn("ufs", F.array_join("ufs", "|"))


def _place(spark, what: str) -> str:
    """A new folder beside the tables that operators write."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or 'file:/tmp/checkpoints').rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _records(spark, sf_dir, where: str, price) -> DataFrame:
    d = read(spark, sf_dir, "orders").where(where)
    const = {"source_domain": "a.com", "source_platform": "p", "transaction_type": "venda", "city": "Santos", "state": "SP", "extraction_date": "2026-08-01"}
    rows = d.select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("property_id"), price.alias("price"), (F.col("o_orderkey") % 3).cast("int").alias("bedrooms"), *(F.lit(v).alias(c) for c, v in const.items()))
    return lake.as_record(rows.withColumn("link", F.concat(F.lit("https://a.com/"), F.col("property_id"))))


@query("lake_upsert", """SELECT 'p' || o_orderkey::VARCHAR AS property_id, CASE WHEN o_orderkey % 5 IN (1, 2) THEN o_totalprice + 1 ELSE o_totalprice END AS price, (o_orderkey % 3)::INT AS bedrooms, 'sp' AS uf, 'santos' AS cidade, 'a.com' AS dominio FROM orders WHERE o_orderkey % 5 < 3""")
def _(spark, sf_dir):
    root = _place(spark, "lake")
    for where, add in (("o_orderkey % 5 < 2", 0.0), ("o_orderkey % 5 IN (1, 2)", 1.0)):  # the second run brings known and new rows
        lake.write_day(_records(spark, sf_dir, where, F.col("o_totalprice") + add), root, "SP", "Santos", "2026-08-01", "p", "a.com")
    return lake.read_month(spark, root, "2026-08").select("property_id", "price", "bedrooms", "uf", "cidade", "dominio")


@query("monthly_table", """SELECT substr(o_orderdate::VARCHAR, 6, 2) AS mes, CASE WHEN o_orderkey % 2 = 0 THEN 'santos' ELSE 'campinas' END AS cidade, count(*)::BIGINT AS n, sum(CASE WHEN o_orderkey % 2 = 0 AND month(o_orderdate) = 3 THEN 1 ELSE 0 END)::BIGINT AS trocadas
  FROM orders WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders) GROUP BY ALL""")
def _(spark, sf_dir):
    to, o = _place(spark, "months"), read(spark, sf_dir, "orders")
    year = o.agg(F.min(F.year("o_orderdate"))).first()[0]
    rows = o.where(F.year("o_orderdate") == year).select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("property_id"), F.lit(0).alias("troca"), F.lit("sp").alias("uf"), F.when(F.col("o_orderkey") % 2 == 0, "santos").otherwise("campinas").alias("cidade"), F.date_format("o_orderdate", "yyyy").alias("ano"), F.date_format("o_orderdate", "MM").alias("mes"))
    lake.write_months(rows, to)
    lake.write_months(rows.where("cidade = 'santos' AND mes = '03'").withColumn("troca", F.lit(1)), to)  # one partition is replaced
    return lake.read_months(spark, to).groupBy("mes", "cidade").agg(F.count("*").alias("n"), F.sum("troca").alias("trocadas"))


_SAID = ("Apartamento com piscina e elevador, vista livre e duas vagas de garagem.", "Casa sem piscina, mas com churrasqueira e quintal bem amplo para todos.", "Prédio não tem elevador. Possui academia e salão de festas para os moradores.", "Terreno plano de esquina, documentação em ordem, pronto para usar já.")


def _described(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return dealt(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("p"), k.cast("string")).alias("property_id"), k, _one_of(k, _SAID).alias("description_clean"), F.when(k % 3 == 0, F.array(F.lit("Piscina"))).alias("amenities"))


@query("amenity_extract", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Elevador|Garagem|Piscina|Vista Livre' WHEN 1 THEN 'Churrasqueira|Quintal' WHEN 2 THEN 'Academia|Salão de Festas' ELSE '' END AS pos, CASE p_partkey % 4 WHEN 1 THEN 'Piscina' WHEN 2 THEN 'Elevador' ELSE '' END AS neg FROM part""")
def _(spark, sf_dir):
    d = enrichment.with_amenities(_described(spark, sf_dir))
    return d.select("p_partkey", F.array_join(F.array_sort("amenities_texto"), "|").alias("pos"), F.array_join("amenities_negadas", "|").alias("neg"))


@query("extraction_report", """WITH N AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 3 = 0) AS f, count(*) FILTER (p_partkey % 4 < 3) AS t, count(*) FILTER (p_partkey % 4 = 0) AS quatro, count(*) FILTER (p_partkey % 4 IN (1, 2)) AS neg, count(*) FILTER (p_partkey % 4 < 3 AND p_partkey % 3 <> 0) AS v, count(*) FILTER (p_partkey % 4 < 3 OR p_partkey % 3 = 0) AS tem FROM part)
  SELECT n::BIGINT AS linhas, n::BIGINT AS com_descricao, f::BIGINT AS da_fonte, (2 * t + 2 * quatro)::BIGINT AS do_texto, neg::BIGINT AS negadas, t::BIGINT AS ganharam, v::BIGINT AS estavam_vazias, neg::BIGINT AS com_negacao, f / n AS cobertura_antes, tem / n AS cobertura_depois FROM N""")
def _(spark, sf_dir):
    return enrichment.report(enrichment.with_amenities(_described(spark, sf_dir)))


@query("enriched_table", """WITH X AS (SELECT p_partkey AS k, p_partkey % 4 AS t, p_partkey % 3 = 0 AS f, p_partkey % 4 IN (0, 1) AS agosto FROM part) SELECT 'p' || k::VARCHAR AS property_id, CASE WHEN agosto THEN '08' ELSE '09' END AS mes, t = 0 OR f AS amen_piscina, t = 0 AS amen_elevador, t = 1 AS nega_piscina, t = 2 AS nega_elevador,
  t = 2 AS amen_academia, false AS em_obra, CASE t WHEN 0 THEN 'privativa' ELSE 'nao_menciona' END AS rx_vaga_tipo, CASE t WHEN 0 THEN 'livre' ELSE 'nao_menciona' END AS rx_vista FROM X""")
def _(spark, sf_dir):
    to, d = _place(spark, "enriched"), _described(spark, sf_dir).withColumns({"uf": F.lit("sp"), "cidade": F.lit("santos"), "ano": F.lit("2026")})
    for month, where in (("08", "p_partkey % 4 IN (0, 1)"), ("09", "p_partkey % 4 IN (2, 3)")):  # months that name other labels
        enrichment.write_enriched(enrichment.expanded(enrichment.with_amenities(d.where(where).withColumn("mes", F.lit(month)))), to)
    return enrichment.read_enriched(spark, to).select("property_id", "mes", "amen_piscina", "amen_elevador", "nega_piscina", "nega_elevador", "amen_academia", "em_obra", "rx_vaga_tipo", "rx_vista")


@query("form_cut", "SELECT p_partkey, p_size AS area, p_brand AS bairro, p_retailprice AS price FROM part")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "part").select("*", F.col("p_size").alias("area"), F.col("p_brand").alias("bairro"), F.col("p_retailprice").alias("price"), F.lit(True).alias("amen_piscina"))
    return features.form_cut(d, ["p_partkey", "area", "bairro"], ["price", "p_partkey"])


@query("family_prevalence", "SELECT 'agua' AS familia, round(avg((p_partkey % 3 = 0)::INT) * 100, 2) AS prevalencia FROM part UNION ALL SELECT 'carro', round(avg((p_partkey % 5 = 0)::INT) * 100, 2) FROM part")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    return features.family_prevalence(read(spark, sf_dir, "part").select(F.when(k % 3 == 0, True).alias("agua"), (k % 5 == 0).alias("carro")), ["agua", "carro"])


@query("provenance", """SELECT 'p' || p_partkey::VARCHAR AS listing_id, CASE WHEN p_partkey % 2 = 0 THEN 'Página' WHEN p_partkey % 3 = 0 THEN 'Dica' ELSE 'Alvo' END AS city, CASE WHEN p_partkey % 3 = 0 THEN 'XX' ELSE 'SP' END AS state, 'venda' AS transaction_type,
  'https://a.com/' || p_partkey::VARCHAR AS link, 'a.com' AS source_domain, 'plat' AS source_platform, '2026-08-01' AS extraction_date, CASE WHEN p_partkey % 5 = 0 THEN '2020-01-01' ELSE '2026-08-01' END AS listing_first_seen FROM part""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    raw = read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("listing_id"), F.when(k % 2 == 0, "Página").alias("city"), F.when(k % 3 == 0, "Dica").alias("hint_city"), F.when(k % 3 == 0, "XX").alias("hint_state"), F.lit("locacao").alias("transaction_type"), F.lit("venda").alias("discovered_transaction_type"),
        F.concat(F.lit("https://a.com/"), k.cast("string")).alias("discovered_link"), F.lit("outro").alias("source_platform"), F.when(k % 5 == 0, "2020-01-01").alias("listing_first_seen"))
    out = ingestion.with_provenance(raw, "a.com", "2026-08-01", "Alvo", "SP", "plat")
    return out.select("listing_id", "city", "state", "transaction_type", "link", "source_domain", "source_platform", "extraction_date", "listing_first_seen")


@query("normalised_records", """WITH X AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m FROM orders)
  SELECT k, CASE m WHEN 1 THEN 'link' WHEN 2 THEN 'city' END AS motivo, CASE WHEN m NOT IN (1) THEN 'https://a.com/' || k::VARCHAR END AS link, CASE WHEN m = 4 THEN 'Ligue [CONTATO]' ELSE 'Casa ampla' END AS descricao, CASE WHEN m = 5 THEN NULL ELSE 450000 END::DOUBLE AS price FROM X WHERE m <> 3""")
def _(spark, sf_dir):
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 6
    raw = read(spark, sf_dir, "orders").where(m != 3).select(
        k.alias("k"), k.cast("string").alias("listing_id"), F.when(m == 1, F.lit("tel:139911")).otherwise(F.concat(F.lit("https://a.com/"), k.cast("string"))).alias("link"), F.when(m == 2, "Outra").otherwise("Santos").alias("city"), F.lit("SP").alias("state"), F.lit("venda").alias("transaction_type"), F.lit("p").alias("source_platform"),
        F.when(m == 5, "R$ 45,00").otherwise("R$ 450.000,00").alias("price"), F.lit("100").alias("area_m2"), F.when(m == 4, "Ligue (13) 99123-4567").otherwise("Casa ampla").alias("description_clean"))
    out = ingestion.normalised(ingestion.with_provenance(raw, "a.com", "2026-08-01"), ["Santos", "São Vicente"])
    ids = raw.select("k", coerce.property_id(F.lit("a.com"), F.col("listing_id"), F.col("link")).alias("property_id"))
    return ids.join(out, "property_id").select("k", "motivo", "link", F.col("description_clean").alias("descricao"), "price")


@query("run_report", """WITH X AS (SELECT 'p' || (s_suppkey % 3)::VARCHAR || ':d' || (s_suppkey % 7)::VARCHAR AS fonte, CASE WHEN s_suppkey % 5 = 0 THEN 'SKIP' WHEN s_suppkey % 4 = 0 THEN 'FAIL' ELSE 'OK' END AS situacao, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey END AS linhas FROM supplier)
  SELECT fonte, situacao, count(*)::BIGINT AS n, sum(linhas)::BIGINT AS linhas FROM X GROUP BY ALL UNION ALL SELECT 'TOTAL', NULL, count(*)::BIGINT, sum(linhas)::BIGINT FROM X""")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    return ingestion.run_report(read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("p"), (k % 3).cast("string")).alias("platform"), F.concat(F.lit("d"), (k % 7).cast("string")).alias("domain"), F.when(k % 5 == 0, "robots").alias("skipped"), F.when(k % 4 == 0, "timeout").alias("error"), k.alias("rows")))


@query("resolved_models", """WITH M AS (SELECT 'NATION_' || (c_custkey % 20)::VARCHAR AS city, 'venda' AS target, max('2026-' || lpad((c_custkey % 90)::VARCHAR, 3, '0')) AS version FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 20 <> 7 GROUP BY ALL),
  R AS (SELECT s_suppkey, 'NATION_' || (s_suppkey % 30)::VARCHAR AS city FROM supplier), Q AS (SELECT s_suppkey, R.city, n_nationkey, M.version AS v, CASE WHEN n_nationkey IS NULL THEN 'cidade ou transacao fora do escopo atendido' WHEN n_nationkey % 6 = 0 THEN CASE WHEN n_nationkey % 4 <> 0 THEN 'poucos' ELSE 'modelo estatistico ainda nao disponivel' END
  WHEN M.version IS NULL THEN 'modelo declarado disponivel mas ausente no disco -- a publicacao do modelo falhou' END AS motivo FROM R LEFT JOIN nation ON n_name = R.city LEFT JOIN M ON M.city = R.city) SELECT s_suppkey, city, motivo, CASE WHEN motivo IS NULL THEN v END AS version FROM Q""")
def _(spark, sf_dir):
    k, n, s = F.col("c_custkey"), F.col("n_nationkey"), F.col("s_suppkey")
    models = read(spark, sf_dir, "customer").select(F.concat(F.lit("NATION_"), (k % 20).cast("string")).alias("city"), F.lit("venda").alias("target"), F.concat(F.lit("2026-"), F.lpad((k % 90).cast("string"), 3, "0")).alias("version"), ((k % 3 == 0) & (k % 20 != 7)).alias("complete"))
    pairs = read(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), F.lit("venda").alias("target"), (n % 6 != 0).alias("available"), F.when(n % 4 != 0, "poucos").alias("why"))
    asked = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), (s % 30).cast("string")).alias("city"), F.lit("venda").alias("target"))
    return catalogue.resolved(asked, pairs, models).select("s_suppkey", "city", "motivo", "version")


@query("caveats", """SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'nao_menos_confiavel:' || concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'piscina' END, CASE WHEN p_partkey % 5 = 0 THEN 'elevador' END) END,
  CASE WHEN p_partkey % 5 = 0 THEN 'sem_elevador' END, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'vista_nao_informada' END) AS ressalvas FROM part""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    d = read(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("piscina"), F.when(k % 5 == 0, False).alias("elevador"), F.when(k % 4 == 1, "nao_sei").when(k % 4 > 1, "mar").alias("vista"))
    return catalogue.caveats(d, ["piscina", "elevador"]).select("p_partkey", F.array_join("ressalvas", "|").alias("ressalvas"))


@query("absent_yields", "SELECT n_name AS city, CASE WHEN n_nationkey % 3 = 0 THEN 'sem_rendimento' ELSE 'rendimento_invalido' END AS motivo FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 3 = 1 AND n_nationkey % 2 = 0")
def _(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    table = n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("city"), F.when((k % 3 == 1) & (k % 2 == 0), 0.006).otherwise(0.003).alias("p10"), F.lit(0.004).alias("median"), F.lit(0.005).alias("p90"))
    return catalogue.absent_yields(n.select(F.col("n_name").alias("city")), table)


@query("missing_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)")
def _(spark, sf_dir):
    return catalogue.missing_ids(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("card_summaries", """SELECT 'v' || s_suppkey::VARCHAR AS versao, CASE WHEN s_suppkey % 2 = 0 THEN 'b.parquet' ELSE '' END AS base, n_name || '/venda' AS segmento, s_suppkey * 10 AS n_treino, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE 0 END AS n_holdout, s_acctbal AS rmse_holdout,
  NULL::DOUBLE AS mae_holdout, n_name AS cidade, 'cidade' AS escopo_treino FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    card = F.to_json(F.struct(
        F.struct(F.col("n_name").alias("cidade"), F.lit("venda").alias("alvo"), F.concat(F.lit("v"), k.cast("string")).alias("versao")).alias("identificacao"), F.struct(F.lit("cidade").alias("escopo_treino"), (k * 10).alias("n_treino"), F.when(k % 3 == 0, k).alias("n_holdout")).alias("escopo"),
        F.struct(F.when(k % 2 == 0, "b.parquet").alias("abt")).alias("dados"), F.struct(F.col("s_acctbal").alias("rmse_brl")).alias("desempenho"), F.struct(F.lit(1).alias("x")).alias("limites")))
    texts = rows.select(card.alias("value"))
    texts = texts.unionByName(texts.limit(1).select(F.lit("{no card").alias("value")))
    return models.summaries(texts).select("versao", "base", "segmento", "n_treino", "n_holdout", "rmse_holdout", "mae_holdout", "cidade", "escopo_treino")


@query("card_metadata", """SELECT 'v' || s_suppkey::VARCHAR AS versao, n_name || '/venda' AS segmento, s_suppkey * 10 AS n_treino, '{"mae_log":0.5}' AS holdout, '{}' AS limites, '[]' AS calibracao_holdout FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    card = F.to_json(F.struct(F.struct(F.col("n_name").alias("cidade"), F.lit("venda").alias("alvo"), F.concat(F.lit("v"), k.cast("string")).alias("versao")).alias("identificacao"), F.struct((k * 10).alias("n_treino")).alias("escopo"), F.struct(F.lit(0.5).alias("mae_log")).alias("desempenho")))
    return models.metadata(rows.select(card.alias("value"))).select("versao", "segmento", "n_treino", "holdout", "limites", "calibracao_holdout")


@query("search_page_links", "SELECT page_id, page_id::VARCHAR || '|' || (page_id + 1)::VARCHAR AS ids, '/imovel/a-id-' || page_id::VARCHAR || '/' AS primeira FROM pages")
def _(spark, sf_dir):
    k = F.col("page_id")
    links = _text('<a href="/imovel/a-id-', k, '/">x</a><a href="/imovel/b-id-', k + 1, '/">x</a><a href="/imovel/outra-id-', k, '/?x=1">x</a><a href="/sobre/">x</a>')
    d = read(spark, sf_dir, "pages").select("page_id", pages.listing_links(F.concat("html", links)).alias("l"))
    return d.select("page_id", F.array_join(F.transform("l", lambda x: x["id"]), "|").alias("ids"), F.get("l", F.lit(0))["url"].alias("primeira"))


@query("block_types", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Apartment|Product' WHEN 1 THEN '' ELSE 'Offer' END AS tipos FROM pages")
def _(spark, sf_dir):
    kinds = F.element_at(F.array(F.array(F.lit("Apartment"), F.lit("Product"), F.lit("Thing")), F.array(F.lit("Product"), F.lit("Person"), F.lit("x")), F.array(F.lit("Offer"), F.lit("y"), F.lit("z"))), (F.col("page_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(pages.allowed_types(kinds), "|").alias("tipos"))


@query("months_of_text", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') END AS mes, CASE WHEN o_orderkey % 2 = 0 THEN 'casa' END AS tipo FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyyMM")).otherwise("13/2026").alias("t"), F.when(k % 2 == 0, "Casa").otherwise("um refúgio na praia").alias("k"))
    return o.select("o_orderkey", coerce.month_of(F.col("t")).alias("mes"), vocabulary.model_type(F.col("k")).alias("tipo"))


@query("file_counts", "SELECT CASE WHEN l_linenumber = 7 THEN -1 ELSE count(*) END::BIGINT AS linhas FROM lineitem GROUP BY l_linenumber")
def _(spark, sf_dir):
    to = _place(spark, "files")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("property_id"), "l_linenumber")
    for n in range(1, 8):  # a file each; the last has no ids
        one = lines.where(F.col("l_linenumber") == n).select("property_id").repartition(1)  # the file's task gets its own ids, not all lines
        (one if n < 7 else one.withColumnRenamed("property_id", "outro")).write.parquet(f"{to}/{n}")
    return lake.file_counts(spark, f"{to}/*/*.parquet").select("linhas")


@query("city_month_upsert", """WITH X AS (SELECT 'p' || (o_orderkey % 400)::VARCHAR AS property_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Santos' ELSE 'Campinas' END AS city, strftime(o_orderdate, '%Y-%m-%d') AS d, o_totalprice AS price, 's' || o_orderkey::VARCHAR AS s FROM orders),
  T AS (SELECT * FROM X WHERE substr(d, 6, 2) IN ('03', '04')) SELECT lower(city) AS cidade, substr(d, 6, 2) AS mes, property_id, d AS extraction_date, price FROM T QUALIFY row_number() OVER (PARTITION BY property_id, city, substr(d, 1, 7) ORDER BY d DESC, s DESC, price DESC) = 1""")
def _(spark, sf_dir):
    from ..streaming import incremental

    to, k = _place(spark, "upsert"), F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").where("month(o_orderdate) IN (3, 4)").select(
        F.concat(F.lit("p"), (k % 400).cast("string")).alias("property_id"), F.when(k % 2 == 0, "Santos").otherwise("Campinas").alias("city"), F.lit("SP").alias("state"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("extraction_date"), F.col("o_totalprice").alias("price"), F.concat(F.lit("s"), k.cast("string")).alias("source_domain"))
    put = incremental.upsert_batch(to)
    for n in range(3):  # batches as a stream hands them over, the second one twice
        put(o.where(F.crc32(F.col("source_domain").cast("binary")) % 3 == n), n)
    put(o.where(F.crc32(F.col("source_domain").cast("binary")) % 3 == 1), 1)
    return lake.read_months(spark, to).select("cidade", "mes", "property_id", "extraction_date", "price")


@query("validation_rows", f"""WITH X AS (SELECT p_partkey, {_TYPE} AS tipo, p_partkey % 4 = 0 AS fora FROM part) SELECT p_partkey, fora AS _holdout, CASE WHEN fora THEN 7 END::INT AS extra,
  CASE WHEN tipo IN ('apartamento', 'kitnet', 'cobertura') THEN 'residencial' WHEN tipo IN ('casa', 'sobrado') THEN 'casa' WHEN tipo IN ('sala', 'galpao') THEN 'comercial' WHEN tipo = 'terreno' THEN 'terreno' ELSE 'outro' END AS familia FROM X""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(k % 9 != 8, _one_of(k, _KINDS)).alias("property_type"))
    return features.with_validation(p.where(k % 4 != 0), p.where(k % 4 == 0).withColumn("extra", F.lit(7))).select("p_partkey", "_holdout", "extra", "familia")


@query("erased_fields", """WITH X AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS apaga, CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS condo_fee FROM part)
  SELECT k, CASE WHEN NOT apaga THEN condo_fee END AS condo_fee, CASE WHEN NOT apaga THEN condo_fee / 2 END AS condo_por_m2, CASE WHEN apaga OR condo_fee IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS aus_condo_fee, CASE WHEN apaga OR condo_fee IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS n_campos_ausentes FROM X""")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    d = read(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 5 != 0, F.col("p_size").cast("double")).alias("condo_fee")).withColumn("condo_por_m2", F.col("condo_fee") / 2)
    return modelling.erased(modelling.with_missing(d, ["condo_fee"]), "condo_fee", ["condo_por_m2"], F.col("k") % 3 == 0)


@query("listing_urls", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN 'casa-bairro-centro-' || page_id::VARCHAR END AS listing_id, CASE WHEN page_id % 3 = 0 THEN 'Casa' END AS property_type, CASE WHEN page_id % 3 = 0 THEN 'Praia Grande' END AS city,
  CASE WHEN page_id % 3 = 0 THEN 'Vila Nova' END AS neighborhood, page_id % 3 <> 2 AS anuncio FROM pages""")
def _(spark, sf_dir):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, _text("https://m.com/", k, "-casa-em-praia-grande-bairro-vila_nova.html")).when(k % 3 == 1, _text("https://m.com/casa-bairro-centro-", k, ".html")).otherwise(F.lit("https://m.com/sobre.html"))
    hints = html_platforms.url_hints(url)
    return read(spark, sf_dir, "pages").select("page_id", *(hints[c].alias(c) for c in ("listing_id", "property_type", "city", "neighborhood")), html_platforms.is_listing_url(url).alias("anuncio"))


@query("gate_of_clean_rows", "SELECT c_custkey, 'Casa de ' || c_custkey::VARCHAR || ' metros' AS texto FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Casa de "), k.cast("string"), F.lit(" metros, fone 13 99123-4567")).alias("texto"))
    try:
        pii.gate(rows, "contacts")
    except pii.PersonalData:  # what the gate is for: these rows never pass
        return pii.gate(rows.withColumn("texto", F.regexp_replace("texto", ", fone.*", "")), "clean")
    raise AssertionError("the gate let contacts pass")


@query("typed_columns", "SELECT c_custkey::VARCHAR AS id, round(c_acctbal)::INT AS saldo, NULL::DOUBLE AS falta FROM customer")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal").alias("saldo"), F.lit(1).alias("sobra"))
    return features.as_types(d, T.StructType([T.StructField("id", T.StringType()), T.StructField("saldo", T.IntegerType()), T.StructField("falta", T.DoubleType())]))


@query("training_tables", """WITH X AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS v, o_orderkey % 10 = 0 AS h FROM orders) SELECT k, CASE WHEN h THEN 'holdout' ELSE 'abt' END AS parte, '2026-09' AS mes FROM X WHERE v AND (h OR k % 3 = 0)""")
def _(spark, sf_dir):
    root, k = _place(spark, "training"), F.col("k")
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "venda").otherwise("locacao").alias("transaction_type"))
    abt, holdout = d.where(k % 10 != 0), d.where(k % 10 == 0)
    models.write_training(abt, holdout, root, "2026-08")
    models.write_training(abt, holdout, root, "2026-09")
    models.write_training(abt.where(k % 3 == 0), holdout, root, "2026-09")  # the month is replaced
    train, test, month = models.latest_training(spark, root, "venda")
    return train.select("k", F.lit("abt").alias("parte")).unionByName(test.select("k", F.lit("holdout").alias("parte"))).withColumn("mes", F.lit(month))


@query("market_months", " SELECT mes_referencia, city, count(*)::BIGINT AS n FROM L WHERE mes_referencia LIKE '%-0%' GROUP BY ALL")
def _(spark, sf_dir):
    root, rows = _place(spark, "market"), listings(spark, sf_dir)
    counts = rows.groupBy("mes_referencia", "city").agg(F.count("*").alias("n")).where("mes_referencia LIKE '%-0%'")
    models.write_market(counts.withColumn("n", F.lit(0).cast("long")), root)
    models.write_market(counts, root)  # its months take the place of the former ones
    return spark.read.schema("city string, n long, mes_referencia string").parquet(f"{root}/mercado").select("mes_referencia", "city", "n")


@query("captures_of_series", "SELECT n_name AS cidade, n_nationkey::DOUBLE AS valor FROM nation")
def _(spark, sf_dir):
    root = _place(spark, "series")
    d = read(spark, sf_dir, "nation").select(F.col("n_name").alias("cidade"), F.col("n_nationkey").cast("double").alias("valor"))
    indices.write_capture(d.withColumn("valor", F.lit(-1.0)), root, "2026-07-31")
    indices.write_capture(d, root, "2026-08-31")
    indices.write_derived(indices.latest_capture(spark, root, 2), f"{root}/derived")
    return spark.read.parquet(f"{root}/derived")


@query("sitemap_entries", "SELECT 'https://s.com/' || page_id::VARCHAR AS loc, '2026-08-0' || (page_id % 9 + 1)::VARCHAR AS lastmod FROM pages")
def _(spark, sf_dir):
    to, k = _place(spark, "sitemap"), F.col("page_id")
    entry = _text("<url><loc> https://s.com/", k, " </loc><lastmod>2026-08-0", k % 9 + 1, "</lastmod></url><url><loc>https://s.com/", k, "</loc><lastmod>2026-01-01</lastmod></url>")
    files = read(spark, sf_dir, "pages").groupBy((k / 100).cast("int").alias("b")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("value"))  # of a hundred pages each
    files.repartition("b").write.partitionBy("b").text(to)
    return pages.sitemap(spark, f"{to}/*/*.txt")


@query("stored_cards", "SELECT n_name AS cidade, 'venda' AS alvo, 'v1' AS versao, n_nationkey * 10 AS n_treino, n_regionkey / 10.0::DOUBLE AS mae_log FROM nation")
def _(spark, sf_dir):
    to, n = _place(spark, "cards"), F.col("n_nationkey")
    card = F.to_json(F.struct(F.struct(F.col("n_name").alias("cidade"), F.lit("venda").alias("alvo"), F.lit("v1").alias("versao")).alias("identificacao"), F.struct((n * 10).alias("n_treino")).alias("escopo"), F.struct((F.col("n_regionkey") / 10).alias("mae_log")).alias("desempenho")))
    d = read(spark, sf_dir, "nation").select(card.alias("value"), n.alias("n"))
    d.repartition(25, "n").write.partitionBy("n").text(to)
    d.limit(1).select(F.lit("{broken").alias("value")).write.text(f"{to}/n=x")
    return models.cards(spark, f"{to}/*/*.txt").select("cidade", "alvo", "versao", "n_treino", "mae_log")


@query("migrated_lake", "SELECT '2026-08-0' || (n_regionkey + 1)::VARCHAR AS dia, count(*)::BIGINT AS antes, count(*)::BIGINT AS depois, true AS mesmos FROM nation GROUP BY ALL")
def _(spark, sf_dir):
    old, new = _place(spark, "old"), _place(spark, "new")
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("property_id"), F.concat(F.lit("2026-08-0"), (F.col("n_regionkey") + 1).cast("string")).alias("dia"))
    for day in [r[0] for r in n.select("dia").distinct().collect()]:  # a folder for each of five regions
        n.where(F.col("dia") == day).select("property_id").write.parquet(f"{old}/sp/santos/{day}/p/a.com")
    out = lake.migrate(spark, old, new)
    return out.select(F.regexp_extract("origem", "/([0-9-]{10})/p/", 1).alias("dia"), "antes", "depois", "mesmos")


@query("street_keys", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'rua visconde rio branco' WHEN 1 THEN 'xy' ELSE '' END AS chave, s_suppkey % 3 = 0 AS usavel FROM supplier")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "supplier").select("s_suppkey", _one_of(F.col("s_suppkey"), ("R. Visc. do Rio Branco", "  Xy!", "de da")).alias("rua"))
    return folds.folded(d, "rua", "street_key", "chave").select("s_suppkey", "chave", F.coalesce(folds.usable(F.col("chave")), F.lit(False)).alias("usavel"))


@query("targets_of_a_state", "SELECT n_name AS cidade FROM nation WHERE n_nationkey % 3 = 1")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "nation").select(F.col("n_name").alias("cidade"), _one_of(F.col("n_nationkey"), ("coletando", "inventariando", "a_inventariar")).alias("estado"))
    return views.of_state(d, "inventariando").select("cidade")


@query("bootstrap_median", " SELECT bedrooms, true AS contem, true AS estreito FROM (SELECT DISTINCT bedrooms FROM L WHERE bedrooms <= 2)")
def _(spark, sf_dir):
    rows, out = listings(spark, sf_dir).where("bedrooms <= 2"), None
    for n in (1, 2):
        own = rows.where(F.col("bedrooms") == n)
        interval = modelling.bootstrap_median(own, "price")
        one = own.agg(F.median("price").alias("m"), F.max("price").alias("hi_all"), F.min("price").alias("lo_all"), F.first("bedrooms").alias("bedrooms")).join(F.broadcast(interval), F.lit(True))  # one row each
        one = one.select("bedrooms", F.col("m").between(F.col("lo"), F.col("hi")).alias("contem"), ((F.col("hi") - F.col("lo")) < 0.5 * (F.col("hi_all") - F.col("lo_all"))).alias("estreito"))
        out = one if out is None else out.unionByName(one)
    return out


@query("hashed_shares", " SELECT transaction_type, true AS perto, true AS igual FROM (SELECT DISTINCT transaction_type FROM L)")
def _(spark, sf_dir):
    share = lambda d: d.groupBy("transaction_type").agg(F.avg(modelling.hashed_share(0.15, 42, "tie").cast("double")).alias("s"))
    rows = listings(spark, sf_dir)
    again = share(rows.repartition(3, "price")).withColumnRenamed("s", "t")
    return share(rows).join(again, "transaction_type").select("transaction_type", (F.abs(F.col("s") - 0.15) < 0.02).alias("perto"), (F.abs(F.col("s") - F.col("t")) < 1e-12).alias("igual"))


@query("boosted_quantiles")
def _(spark, sf_dir):
    """Quantile and central models of the price, fitted on four fifths of the listings' groups and measured on the rest."""
    rows = listings(spark, sf_dir).withColumns({"log_price": F.ln("price"), "bedrooms": F.col("bedrooms").cast("double")}).withColumn("_out", modelling.hashed_share(0.2, 3, "property_id"))
    members = [boosting.Member("p_log"), boosting.Member("q10_log", boosting.QUANTILE, 0.1), boosting.Member("q90_log", boosting.QUANTILE, 0.9)]
    model = boosting.fit(rows.where("NOT _out"), "log_price", ["area_m2", "bedrooms"], ["city", "neighborhood"], members, ["tie"], boosting.Settings(rounds=12, rate=0.3, depth=3))
    out = modelling.quantile_interval(boosting.predicted(model, rows.where("_out")))
    return out.groupBy("transaction_type").agg(F.count("*").alias("n"), F.avg(F.col("price").between(F.col("lo"), F.col("hi")).cast("double")).alias("cobertura"), F.avg(F.abs(F.col("log_price") - F.col("p_log"))).alias("mae_log"))
