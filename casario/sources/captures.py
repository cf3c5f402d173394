"""Listing records from captured platform payloads: explicit JSON schemas project, so contacts never become columns.

captures: platform, url, transaction, body. Each reader maps one platform's names to the record's; readers are looked up
in a registry, to which users add their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import currency

READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
#: Flags of the flag platform and their labels.
FLAGS = {
    "piscina": "Piscina", "academia": "Academia", "churrasqueira": "Churrasqueira", "salaofestas": "Salão de Festas", "salaojogos": "Salão de Jogos",
    "sauna": "Sauna", "playground": "Playground", "quadraesportiva": "Quadra Esportiva", "quadratenis": "Quadra de Tênis", "beachtenis": "Beach Tennis",
    "espacogourmet": "Espaço Gourmet", "hidromassagem": "Hidromassagem", "homecinema": "Home Cinema", "salamassagem": "Sala de Massagem",
    "quadrasquash": "Quadra de Squash", "portaria24horas": "Portaria 24 horas", "seguranca24horas": "Segurança 24 horas", "interfone": "Interfone",
    "portaoeletronico": "Portão Eletrônico", "cercaeletrica": "Cerca Elétrica", "alarme": "Alarme", "circuitotv": "Circuito Interno de TV",
    "gascanalizado": "Gás Canalizado", "aguaindividual": "Água Individual", "wifi": "Wi-Fi", "tvacabo": "TV a Cabo", "mobiliado": "Mobiliado",
    "arcondicionado": "Ar-Condicionado", "armariocozinha": "Armários na Cozinha", "armarioquarto": "Armário no Quarto",
    "armariobanheiro": "Armário no Banheiro", "aquecedorgas": "Aquecedor a Gás", "aquecedorsolar": "Aquecedor Solar",
    "aquecedoreletrico": "Aquecedor Elétrico", "lareira": "Lareira", "permiteanimais": "Aceita Animais", "closet": "Closet", "lavabo": "Lavabo",
    "despensa": "Despensa", "escritorio": "Escritório", "areaservico": "Área de Serviço", "jardim": "Jardim", "quintal": "Quintal",
    "gramado": "Gramado", "vistamar": "Vista para o Mar", "vistamontanha": "Vista para a Montanha", "vistalago": "Vista para o Lago",
    "solmanha": "Sol da Manhã", "varandagourmet": "Varanda Gourmet", "box": "Box", "dce": "Dependência de Empregada", "rouparia": "Rouparia",
}


def reader(platform: str):
    """Registers a reader; a platform has one."""
    def keep(f):
        if platform in READERS:
            raise ValueError(f"{platform} already has a reader")
        READERS[platform] = f
        return f

    return keep


def read_captures(captures: DataFrame) -> tuple[DataFrame, list[str]]:
    """Raw records of all platforms with a reader, and the platforms without one."""
    found = [r[0] for r in captures.select("platform").distinct().collect()]  # one row a platform
    parts = [READERS[p](captures.where(F.col("platform") == p)) for p in sorted(found) if p in READERS]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out, sorted(p for p in found if p not in READERS)


def money(value: Column) -> Column:
    """A plain number; 0 is unknown."""
    return F.nullif(value.try_cast("double"), F.lit(0.0))


def brazilian_money(value: Column) -> Column:
    """A plain number or pt-BR money; 0 is unknown."""
    return F.coalesce(money(value), F.nullif(currency(value), F.lit(0.0)))


def count(value: Column) -> Column:
    """A whole number; 0 is an answer."""
    return F.trim(value).try_cast("int")


def number_in(value: Column) -> Column:
    """The first number in a text: '97m²' is 97."""
    return F.replace(F.nullif(F.regexp_extract(value, r"-?\d+(?:[.,]\d+)?", 0), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def _parsed(captures: DataFrame, schema: str) -> DataFrame:
    return captures.withColumn("r", F.from_json("body", schema))


@reader("universal")
def flag_platform(captures: DataFrame) -> DataFrame:
    """Records with pt-BR money, areas times 100, and amenities as flags of '1'."""
    texts = ("codigo", "tipo", "bairro", "cidade", "estado", "valor", "valortratado", "areainterna", "areaprincipaltratado", "numeroquartos", "numerobanhos", "numerosuites", "numerovagas", "descricao", "valorcondominio", "valoriptu", "numeroandar", "cep", *FLAGS)
    d = _parsed(captures, ", ".join(f"{c} string" for c in texts))
    r = lambda c: F.col(f"r.{c}")
    hundred = F.nullif((count(r("areaprincipaltratado")) / 100).cast("int"), F.lit(0))
    area = F.when(F.coalesce(count(r("areaprincipaltratado")), F.lit(0)) != 0, hundred).otherwise(F.nullif(currency(r("areainterna")).cast("int"), F.lit(0)))
    on = F.array_compact(F.array(*(F.when(r(c) == "1", label) for c, label in FLAGS.items())))
    return d.select(
        F.col("url").alias("link"), F.col("platform").alias("source_platform"), F.col("transaction").alias("transaction_type"), F.concat_ws("-", r("codigo"), "transaction").alias("listing_id"),
        r("tipo").alias("property_type"), r("cidade").alias("city"), r("estado").alias("state"), r("bairro").alias("neighborhood"), r("cep").alias("cep"),
        F.coalesce(brazilian_money(r("valortratado")), brazilian_money(r("valor"))).alias("price"), area.cast("double").alias("area_m2"),
        count(r("numeroquartos")).alias("bedrooms"), count(r("numerobanhos")).alias("bathrooms"), count(r("numerosuites")).alias("suites"), count(r("numerovagas")).alias("parking_spots"),
        brazilian_money(r("valorcondominio")).alias("condo_fee"), brazilian_money(r("valoriptu")).alias("iptu_tax"), count(r("numeroandar")).alias("floor_level"),
        F.nullif(F.trim(r("descricao")), F.lit("")).alias("description_clean"), on.alias("amenities"),
    )


@reader("microsistec_b")
def catalogue_platform(captures: DataFrame) -> DataFrame:
    """Records with en-US decimals that are for sale, for rent or both: one row for each."""
    texts = ("code", "details_url", "type_text", "city_name", "uf", "neighborhood_name", "sale_price", "rent_price", "condominium_price", "iptu_price", "area_useful", "area_total", "dorms_count", "bathroom_count", "suit_count", "parking_lot_count", "floor", "obs")
    d = _parsed(captures, ", ".join(f"{c} string" for c in texts) + ", for_sale boolean, for_rent boolean, features array<struct<name:string>>")
    r = lambda c: F.col(f"r.{c}")
    kinds = F.array_compact(F.array(F.when(r("for_sale"), F.struct(F.lit("venda").alias("kind"), r("sale_price").alias("price"))), F.when(r("for_rent"), F.struct(F.lit("locacao").alias("kind"), r("rent_price").alias("price")))))
    d = d.where(r("code").isNotNull() & r("details_url").isNotNull()).select("*", F.explode(kinds).alias("k"))
    return d.select(
        r("details_url").alias("link"), F.col("platform").alias("source_platform"), F.col("k.kind").alias("transaction_type"), F.concat_ws("-", r("code"), F.col("k.kind")).alias("listing_id"),
        r("type_text").alias("property_type"), r("city_name").alias("city"), r("uf").alias("state"), r("neighborhood_name").alias("neighborhood"),
        money(F.col("k.price")).alias("price"), money(r("condominium_price")).alias("condo_fee"), money(r("iptu_price")).alias("iptu_tax"),
        F.nullif(count(r("area_useful")), F.lit(0)).cast("double").alias("area_m2"), F.nullif(count(r("area_total")), F.lit(0)).cast("double").alias("area_total_m2"),
        count(r("dorms_count")).alias("bedrooms"), count(r("bathroom_count")).alias("bathrooms"), count(r("suit_count")).alias("suites"), count(r("parking_lot_count")).alias("parking_spots"), count(r("floor")).alias("floor_level"),
        F.filter(F.transform(F.coalesce(r("features"), F.array().cast("array<struct<name:string>>")), lambda f: f["name"]), lambda n: n.isNotNull() & (n != "")).alias("amenities"), r("obs").alias("description_clean"),
    )


@reader("lopes")
def product_platform(captures: DataFrame) -> DataFrame:
    """Records under product with prices by kind and attributes by type."""
    d = _parsed(captures, "product struct<sku:string,dealTypes:array<string>,divisionType:string,description:string,prices:struct<sale:string,rent:string,condominium:string,property:string>,address:struct<city:string,stateInitials:string,neighborhood:string,street:string>,attributes:array<struct<type:string,value:string>>,condominium:struct<amenities:array<struct<name:string>>>,features:array<struct<name:string>>>")
    p = lambda c: F.col(f"r.product.{c}")
    of = lambda kind: number_in(F.try_element_at(F.filter(p("attributes"), lambda a: a["type"] == kind), F.lit(-1))["value"])
    names = lambda c: F.transform(F.coalesce(p(c), F.array().cast("array<struct<name:string>>")), lambda x: x["name"])
    kinds = F.array_compact(F.array(F.when(F.array_contains(p("dealTypes"), "sale"), F.struct(F.lit("venda").alias("kind"), p("prices.sale").alias("price"))), F.when(F.array_contains(p("dealTypes"), "rent"), F.struct(F.lit("locacao").alias("kind"), p("prices.rent").alias("price")))))
    d = d.select("*", F.explode(kinds).alias("k"))
    attributes = {"bedrooms": "bedroom_attr", "bathrooms": "bathroom_attr", "suites": "suite_attr", "parking_spots": "parking_lots_attr", "floor_level": "floor_attr"}
    return d.select(
        F.col("url").alias("link"), F.col("platform").alias("source_platform"), F.col("k.kind").alias("transaction_type"), F.concat_ws("-", p("sku"), F.col("k.kind")).alias("listing_id"),
        p("divisionType").alias("property_type"), p("address.city").alias("city"), p("address.stateInitials").alias("state"), p("address.neighborhood").alias("neighborhood"), p("address.street").alias("address"),
        money(F.col("k.price")).alias("price"), money(p("prices.condominium")).alias("condo_fee"), money(p("prices.property")).alias("iptu_tax"),
        of("area_attr").alias("area_m2"), of("total_area_attr").alias("area_total_m2"), *(of(t).cast("int").alias(c) for c, t in attributes.items()),
        F.filter(F.concat(names("condominium.amenities"), names("features")), lambda n: n.isNotNull() & (n != "")).alias("amenities"), p("description").alias("description_clean"),
    )
