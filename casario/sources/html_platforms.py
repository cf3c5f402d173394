"""Listing records from captured HTML pages of four platforms: embedded JSON properties, JSON-LD, microdata, labelled spans.

Everything but the flattening of JSON-LD is native. Zero is unknown in money and areas and an answer in counts; a range is
unknown. Captures may have hint_city and hint_state, what the search knew of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pages
from .captures import reader

_STR = r'"((?:[^"\\]|\\.)*)"'
#: Patterns of the pages, names of fields in them, labels.
PROPERTY = r'\{"name":' + _STR + r',"label":' + _STR + r',"value":("(?:[^"\\]|\\.)*"|null)'
SCRIPTS = r"(?s)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
DEAD_PAGE = r"(?i)n[ãa]o conseguimos encontrar a p[áa]gina|>\s*Oops\.\s*<"
MICRODATA = r'(?s)itemProp="(\w+)"[^>]*>(?:(?!itemProp=).){0,600}?class="amenities-item-text"[^>]*>([^<]{1,60})<'
MICRO_NUMBERS = {"parking_spots": "numberOfParkingSpaces", "suites": "numberOfSuites", "bedrooms": "numberOfRooms", "bathrooms": "numberOfBathroomsTotal", "floor_level": "floorLevel"}
NO_TYPES = ("imovel", "imoveis", "venda", "aluguel")
OFFER_KINDS = {"sell": "venda", "leaseout": "locacao"}
HOME_TYPES = ("Apartment", "House", "Residence", "SingleFamilyResidence", "Accommodation", "RealEstateListing")
TITLE_TAIL = r"-\s*([^-]+?)\s*-\s*([^-/]+?)\s*/\s*([A-Z]{2})\s*$"
LABELLED_MONEY = r"(?iu)<strong>\s*(condom[íi]nio|iptu)\s*</strong>\s*(R\$\s?[\d.]+(?:,\d{2})?)"
STATISTIC = r'(?i)<span[^>]*uppercase[^>]*>\s*([^<]{3,20}?)\s*</span>\s*<span[^>]*font-bold[^>]*>\s*([^<]{1,20}?)\s*</span>'
PRICE_BLOCK = r'(?si)id="info-valores".*?(?=<footer|most-view|related|</aside>)'
VALUE_ROW = r"(?i)<span[^>]*>(?:\s*<i[^>]*>\s*</i>)?\s*([^<]{2,30}?)\s*</span>(?:\s|<br\s*/?>|</td>\s*<td[^>]*>)*<b[^>]*>\s*([^<]{1,30}?)\s*(?:<|$)"
RELATED = r"(?i)(?:most-view|related|Imóveis semelhantes|mais-vistos)"
FEATURES = r'(?is)<section[^>]*class="[^"]*tabs-caracteristicas[^"]*"[^>]*>(.*?)</section>'
ROOMS = r'(?is)<section[^>]*class="[^"]*tabs-rooms[^"]*"[^>]*>(.*?)</section>'
ITEM = r"(?i)<li[^>]*>(?:\s*<i[^>]*>\s*</i>)?\s*([^<]{2,50}?)\s*</li>"
LISTING_URL = r"(?i)/(\d+)-([a-z0-9-]+)-em-([a-z0-9-]+)-bairro-([a-z0-9_-]+)\.html$"
LISTING_URL_NO_ID = r"(?i)/([a-z0-9-]*-bairro[_-][a-z0-9_-]+-?)\.html$"
CODE_URL = r"(?i)/imovel/([A-Z]{2}\d{3,6})/([a-z0-9-]+)$"
DETAIL_LABELS = {
    "bedrooms": ("dorm", "dormitorio", "dormitorios", "quarto", "quartos"), "bathrooms": ("banheiro", "banheiros"), "suites": ("suite", "suites"),
    "parking_spots": ("vaga", "vagas"), "area_m2": ("area util", "area"), "area_total_m2": ("area total",), "floor_level": ("andar",),
}
TRANSACTION_LABELS = {"locacao": "locacao", "aluguel": "locacao", "venda": "venda"}


def part(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one or an empty one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def unescaped(raw: Column) -> Column:
    """The text of what stands between the quotes of a JSON string; itself where that is no JSON."""
    return F.coalesce(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>")[0], raw)


def positive(number: Column) -> Column:
    return F.when(number > 0, number)


def pt_money(text: Column) -> Column:
    """pt-BR money, the first number of a text: 'R$ 1.234,50' is 1234.5, 'R$ 0' unknown."""
    return positive(F.replace(F.replace(part(text, r"[\d\.,]+", 0), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))


def whole(text: Column) -> Column:
    """The first whole number: '5 ou mais' is 5, the floor of its bucket."""
    return part(F.replace(text, F.lit("."), F.lit("")), r"\d+", 0).try_cast("int")


def area(text: Column) -> Column:
    return positive(F.replace(part(F.replace(text, F.lit("."), F.lit("")), r"\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double"))


def no_range(text: Column) -> Column:
    """Null for a range like '96 - 351'; a leading minus is none."""
    return F.when(~F.contains(F.ltrim(F.trim(F.replace(text, F.lit("R$"), F.lit(""))), F.lit("-")), F.lit("-")), text)


def listed(text: Column) -> Column:
    """Items of a list parted by commas; empty for none."""
    return F.coalesce(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def ascii_label(text: Column) -> Column:
    """A label in lower case without accents, with single blanks."""
    plain = F.translate(F.lower(text), "áàâãäéèêëíìîïóòôõöúùûüç", "aaaaaeeeeiiiiooooouuuuc")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def pairs(text: Column, pattern: str) -> Column:
    """array(struct(k, v)) of a pattern's two groups."""
    return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2), lambda k, v: F.struct(k.alias("k"), v.alias("v")))


def first_of(array: Column) -> Column:
    """The first known item."""
    return F.try_element_at(F.array_compact(array), F.lit(1))


def _optional(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def _scripts(html: Column, node: str) -> Column:
    """Top-level objects of all JSON-LD scripts of a page; unreadable scripts are skipped."""
    return F.flatten(F.array_compact(F.transform(F.regexp_extract_all(html, F.lit(SCRIPTS), 1), lambda s: F.from_json(s, f"array<{node}>"))))


def longest(texts: Column) -> Column:
    """The longest text, trimmed; the first of equals."""
    sized = F.transform(texts, lambda t, i: F.struct(F.char_length(t).alias("n"), (-i).alias("i"), F.trim(t).alias("t")))
    return F.nullif(F.array_max(F.filter(sized, lambda x: x["n"].isNotNull()))["t"], F.lit(""))


@reader("olx")
def property_page(captures: DataFrame) -> DataFrame:
    """Pages with a properties array, which alone tells the fees, scalars of the embedded JSON, and the longest JSON-LD description."""
    html = F.col("body")
    d = captures.withColumn("_names", F.regexp_extract_all(html, F.lit(PROPERTY), 1)).withColumn("_values", F.regexp_extract_all(html, F.lit(PROPERTY), 3))

    def prop(name: str) -> Column:
        raw = F.try_element_at("_values", F.nullif(F.array_position("_names", name), F.lit(0)).cast("int"))
        return F.when(raw != "null", unescaped(F.btrim(raw, F.lit('"'))))

    def scalar(key: str) -> Column:
        raw = part(html, f'"{key}":({_STR}|null|\\d+)')
        return F.when(F.startswith(raw, F.lit('"')), unescaped(F.regexp_replace(raw, r'^"|"$', ""))).when(raw != "null", raw)

    said = F.split(prop("real_estate_type"), "-", 2)
    kind = F.lower(F.trim(said[0]))
    own = F.when(kind == "venda", "venda").when(kind == "aluguel", "locacao")
    nodes = _scripts(html, "struct<Object:struct<description:string>,description:string>")
    texts = F.transform(nodes, lambda n: F.coalesce(F.nullif(n["Object"]["description"], F.lit("")), n["description"]))
    cep = F.regexp_replace(scalar("zipcode"), r"\D", "")
    return d.select(
        F.col("url").alias("link"), F.col("platform").alias("source_platform"), F.coalesce(own, F.col("transaction")).alias("transaction_type"), scalar("listId").alias("listing_id"),
        F.nullif(F.trim(F.get(said, F.lit(1))), F.lit("")).alias("property_type"), pt_money(scalar("price")).alias("price"), F.coalesce(scalar("municipality"), _optional(d, "hint_city")).alias("city"),
        _optional(d, "hint_state").alias("state"), scalar("neighbourhood").alias("neighborhood"), F.when(F.char_length(cep) == 8, cep).alias("cep"), pt_money(prop("condominio")).alias("condo_fee"),
        pt_money(prop("iptu")).alias("iptu_tax"), area(prop("size")).alias("area_m2"), whole(prop("rooms")).alias("bedrooms"), whole(prop("bathrooms")).alias("bathrooms"),
        whole(prop("garage_spaces")).alias("parking_spots"), F.concat(listed(prop("re_features")), listed(prop("re_complex_features"))).alias("amenities"), longest(texts).alias("description_clean"),
    )


@reader("vivareal")
def microdata_page(captures: DataFrame) -> DataFrame:
    """Pages with a JSON-LD product, fees by test id and microdata items; an error page served as a page gives no record."""
    html = F.col("body")
    d = captures.where(~F.substring(html, 1, 250_000).rlike(DEAD_PAGE))
    d = d.withColumns({"_micro": pairs(html, MICRODATA), "_product": F.try_element_at(F.filter(_scripts(html, "struct<`@type`:string,sku:string,description:string,offers:struct<price:string>>"), lambda n: n["@type"] == "Product"), F.lit(1))})

    def number(key: str) -> Column:
        found = F.transform(F.filter("_micro", lambda m: m["k"] == key), lambda m: whole(no_range(m["v"])))
        return F.try_element_at(F.array_compact(found), F.lit(-1))

    labels = F.filter("_micro", lambda m: (m["k"] == F.upper(m["k"])) & m["k"].rlike("[A-Z]") & (F.trim(m["v"]) != ""))
    fee = lambda name: positive(F.replace(part(part(html, f'data-testid="{name}"[^>]*>([^<]{{1,40}})<'), r"[\d\.]+", 0), F.lit("."), F.lit("")).try_cast("double"))
    kind = part(F.col("url"), r"/imovel/([a-z]+)-")
    city = _optional(d, "hint_city")
    city_slug = F.regexp_replace(F.translate(F.lower(city), "áàâãéêíóôõúç", "aaaaeeiooouc"), "[^a-z0-9]+", "-")
    before = F.split_part(F.substring_index("url", "/imovel/", -1), F.concat(F.lit("-"), city_slug, F.lit("-")), F.lit(1))
    inside = F.contains(F.substring_index("url", "/imovel/", -1), F.concat(F.lit("-"), city_slug, F.lit("-")))
    place = F.when(inside, F.trim(F.replace(part(before, r"-quartos?-(.+)$"), F.lit("-"), F.lit(" "))))
    return d.select(
        F.col("url").alias("link"), F.col("platform").alias("source_platform"), F.col("transaction").alias("transaction_type"), F.coalesce("_product.sku", part(F.col("url"), r"-id-(\d+)")).alias("listing_id"),
        F.when(~kind.isin(*NO_TYPES), kind).alias("property_type"), city.alias("city"), _optional(d, "hint_state").alias("state"), F.nullif(place, F.lit("")).alias("neighborhood"),
        area(no_range(F.col("_product.offers.price"))).alias("price"), fee("condoFee").alias("condo_fee"), fee("iptu").alias("iptu_tax"), *(number(k).alias(c) for c, k in MICRO_NUMBERS.items()),
        F.transform(labels, lambda m: F.trim(m["v"])).alias("amenities"), F.nullif(F.trim("_product.description"), F.lit("")).alias("description_clean"),
    )


def _in_blocks(blocks: Column, path: str, types: tuple[str, ...]) -> Column:
    """The value at a path of the first block of one of the types that has it."""
    fitting = F.filter(blocks, lambda b: F.arrays_overlap(b["types"], F.array(*map(F.lit, types))))
    return first_of(F.transform(fitting, lambda b: pages.value_at(b["json"], path)))


@reader("veploy")
def offers_page(captures: DataFrame) -> DataFrame:
    """Pages with JSON-LD homes and an offer for each transaction, which gives a row each; a price without its transaction is no price."""
    d = captures.withColumn("_b", pages.blocks(F.col("body")))
    offers = F.filter("_b", lambda b: F.exists(b["types"], lambda t: F.lower(t) == "offer"))
    kinds = F.create_map(*[F.lit(x) for pair in OFFER_KINDS.items() for x in pair])
    plain = lambda v: F.coalesce(positive(v.try_cast("double")), pt_money(v))
    d = d.withColumn("_offers", F.transform(offers, lambda b: F.struct(pages.value_at(b["json"], "businessFunction").alias("kind"), pages.value_at(b["json"], "price").alias("price"))))
    d = d.withColumn("_offers", F.transform("_offers", lambda o: F.struct(kinds[F.lower(F.substring_index(o["kind"], "#", -1))].alias("kind"), plain(o["price"]).alias("price"))))
    each = F.filter("_offers", lambda o: o["kind"].isNotNull() & o["price"].isNotNull())
    one = F.array_compact(F.array(*(F.try_element_at(F.filter(each, _of_kind(kind)), F.lit(1)) for kind in OFFER_KINDS.values())))
    d = d.withColumn("_o", F.explode(one))
    # What several fields are taken from is a column of its own, so that no field searches the page again.
    of_types = lambda types: F.filter("_b", lambda b: F.arrays_overlap(b["types"], F.array(*map(F.lit, types))))
    d = d.withColumns({"_homes": of_types(HOME_TYPES), "_places": of_types(("PostalAddress",)), "_ads": of_types(("RealEstateListing",)), "_money": pairs(F.col("body"), LABELLED_MONEY), "_stats": pairs(F.col("body"), STATISTIC)})
    home = lambda path, of="_homes": first_of(F.transform(of, lambda b: pages.value_at(b["json"], path)))
    labelled = lambda pair: F.struct(ascii_label(pair["k"]).alias("k"), pair["v"].alias("v"))
    d = d.withColumns({"_title": F.coalesce(home("name"), F.lit("")), "_region": F.split(home("addressRegion", "_places"), "-"), "_money": F.transform("_money", labelled), "_stats": F.transform("_stats", labelled)})
    title, region = F.col("_title"), F.col("_region")
    two = F.size(region) == 2
    fee = lambda start: plain(first_of(F.transform(F.filter("_money", lambda m: F.startswith(m["k"], F.lit(start))), lambda m: m["v"])))
    stat = lambda names: first_of(F.transform(F.filter("_stats", lambda m: m["k"].isin(*names)), lambda m: whole(m["v"])))
    features = first_of(F.transform("_homes", lambda b: F.from_json(F.get_json_object(b["json"], "$.amenityFeature"), "array<struct<name:string>>")))
    return d.select(
        F.col("url").alias("link"), F.col("platform").alias("source_platform"), F.col("_o.kind").alias("transaction_type"), F.concat_ws("-", part(F.col("url"), CODE_URL), F.col("_o.kind")).alias("listing_id"),
        F.nullif(F.trim(F.split_part(F.split_part(F.split_part(title, F.lit(" com "), F.lit(1)), F.lit(" à "), F.lit(1)), F.lit(","), F.lit(1))), F.lit("")).alias("property_type"), F.col("_o.price").alias("price"),
        F.coalesce(part(title, TITLE_TAIL, 2), F.when(two, F.trim(region[0]))).alias("city"), F.coalesce(part(title, TITLE_TAIL, 3), F.when(two, F.trim(F.get(region, F.lit(1))))).alias("state"),
        F.coalesce(part(title, TITLE_TAIL, 1), home("addressLocality", "_places")).alias("neighborhood"), whole(part(title, r"(?i)(\d[\d.,]*)\s*m[²2]")).cast("double").alias("area_m2"),
        whole(home("floorSize.value")).cast("double").alias("area_total_m2"), F.coalesce(whole(home("numberOfBedrooms")), stat(("dormitorios", "dormitorio", "quartos"))).alias("bedrooms"),
        F.coalesce(whole(home("numberOfBathroomsTotal")), stat(("banheiros", "banheiro"))).alias("bathrooms"), stat(("suites", "suite")).alias("suites"), F.coalesce(whole(home("numberOfParkingSpaces")), stat(("vagas", "vaga"))).alias("parking_spots"),
        fee("condom").alias("condo_fee"), fee("iptu").alias("iptu_tax"), F.filter(F.transform(features, lambda f: f["name"]), lambda n: n.isNotNull() & (n != "")).alias("amenities"),
        F.nullif(F.trim(home("description", "_ads")), F.lit("")).alias("description_clean"), F.substring(home("datePosted", "_ads"), 1, 10).alias("listing_first_seen"),
    )


def _of_kind(kind: str):
    return lambda o: o["kind"] == kind


def label_key(text: Column) -> Column:
    """A label's key: 'Área (útil)' is 'area util', 'sendo Suíte(s)' is 'suite', 'Dorm.' is 'dorm'."""
    t = F.replace(F.regexp_replace(ascii_label(text), r"^sendo\s+", ""), F.lit("(s)"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[().:]", " "), r"\s+", " "))


def url_hints(url: Column) -> dict[str, Column]:
    """Type, city, neighbourhood and id that a listing's URL tells; null for other URLs."""
    words = lambda g: F.initcap(F.nullif(F.trim(F.regexp_replace(part(url, LISTING_URL, g), "[_-]", " ")), F.lit("")))
    return {"property_type": words(2), "city": words(3), "neighborhood": words(4), "listing_id": F.coalesce(part(url, LISTING_URL), F.substring(part(url, LISTING_URL_NO_ID), 1, 60))}


def is_listing_url(url: Column) -> Column:
    return url.rlike(LISTING_URL) | url.rlike(LISTING_URL_NO_ID) | url.rlike(CODE_URL)


@reader("microsistec_a")
def price_block_page(captures: DataFrame) -> DataFrame:
    """Pages with a price block, the only place that tells the transaction, and rows of details before the rail of other listings."""
    html = F.col("body")
    keyed = lambda text: F.transform(pairs(text, VALUE_ROW), lambda r: F.struct(label_key(r["k"]).alias("k"), r["v"].alias("v")))
    d = captures.withColumns({"_top": keyed(F.regexp_extract(html, PRICE_BLOCK, 0)), "_rows": keyed(F.get(F.split(html, RELATED, 2), F.lit(0))), "_b": pages.blocks(html)})
    head = F.try_element_at(F.filter("_top", lambda r: r["k"].isin(*TRANSACTION_LABELS)), F.lit(1))
    kinds = F.create_map(*[F.lit(x) for pair in TRANSACTION_LABELS.items() for x in pair])
    top = lambda names: F.try_element_at(F.filter("_top", lambda r: r["k"].isin(*names)), F.lit(1))["v"]
    detail = lambda names: F.coalesce(whole(top(names)), first_of(F.transform(F.filter("_rows", lambda r: r["k"].isin(*names)), lambda r: whole(r["v"]))))
    sold = first_of(F.transform("_b", lambda b: pages.value_at(b["json"], "offers.price")))
    items = lambda section: F.flatten(F.transform(F.regexp_extract_all(html, F.lit(section), 1), lambda s: F.regexp_extract_all(s, F.lit(ITEM), 1)))
    names = F.array_distinct(F.filter(F.transform(F.concat(items(FEATURES), items(ROOMS)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))
    text = F.trim(_in_blocks(F.col("_b"), "description", ("IndividualProduct", "Product")))
    hints = url_hints(F.col("url"))
    areas = ("area_m2", "area_total_m2")
    return d.select(
        F.col("url").alias("link"), F.col("platform").alias("source_platform"), F.coalesce(kinds[head["k"]], F.col("transaction")).alias("transaction_type"), *(c.alias(n) for n, c in hints.items()),
        F.coalesce(pt_money(head["v"]), positive(sold.try_cast("double")), pt_money(sold)).alias("price"), pt_money(top(("iptu",))).alias("iptu_tax"), pt_money(top(("condominio",))).alias("condo_fee"),
        *(detail(labels).cast("double" if c in areas else "int").alias(c) for c, labels in DETAIL_LABELS.items()), names.alias("amenities"),
        F.when(~F.lower(text).isin("", "false", "none"), text).alias("description_clean"),
    )
