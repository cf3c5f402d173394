"""Readers of captured HTML pages on synthetic pages."""

import json

import pytest

from casario.sources import captures, html_platforms

OLX = """<html><script>window.dataLayer=[{"iptu":null,"price":"R$ 0"}]</script>
<script>{"listId":1357924680,"price":"R$ 450.000","zipcode":"11055-300","neighbourhood":"Boqueir\\u00e3o","municipality":"Santos"
,"properties":[{"name":"real_estate_type","label":"Tipo","value":"Aluguel - apartamento padrão"},{"name":"condominio","label":"C","value":"R$ 1.250"},{"name":"iptu","label":"I","value":"R$ 0"},
{"name":"size","label":"A","value":"70m²"},{"name":"rooms","label":"Q","value":"5 ou mais"},{"name":"bathrooms","label":"B","value":"0"},{"name":"garage_spaces","label":"V","value":null},
{"name":"re_features","label":"F","value":"Academia, Ar condicionado"},{"name":"re_complex_features","label":"G","value":"Piscina"},{"name":"iptu","label":"I","value":"R$ 99"}]}</script>
<script type="application/ld+json">{"@type":"RentAction","Object":{"description":" uma descrição bem mais longa "},"description":"curta"}</script>
<script type="application/ld+json">[{"description":"média aqui"}]</script><script type="application/ld+json">{broken</script></html>"""

VIVA = """<html><script type="application/ld+json">{"@type":"Organization","name":"x"}</script>
<script type="application/ld+json">{"@type":"Product","sku":"77","description":"Apartamento claro ","offers":{"price":640000}}</script>
<span data-testid="condoFee" class="v">R$ 1.587/mês</span><span data-testid="iptu">R$ 0</span>
<li itemProp="numberOfParkingSpaces"><i></i><span class="amenities-item-text">2 vagas</span></li>
<li itemProp="numberOfSuites"><span class="amenities-item-text">0 suítes</span></li>
<li itemProp="numberOfRooms"><span class="amenities-item-text">2 - 3 quartos</span></li>
<li itemProp="floorLevel"><span class="amenities-item-text">22º andar</span></li>
<li itemProp="PETS_ALLOWED"><span class="amenities-item-text">Aceita animais</span></li></html>"""

VEPLOY = """<script type="application/ld+json">{"@graph":[{"@type":["RealEstateListing","Apartment"],"name":"Apartamento com 2 dormitórios, 51 m² - venda por R$ 430.000,00 - Centro - São Vicente/SP","description":" Bom ","datePosted":"2026-08-01T10:00:00"},
{"@type":"Apartment","numberOfBedrooms":2,"floorSize":{"@type":"QuantitativeValue","value":60},"amenityFeature":[{"name":"Piscina"},{"name":""},{"name":"Sauna"}]},
{"@type":"Offer","businessFunction":"http://purl.org/goodrelations/v1#Sell","price":"430000"},{"@type":"Offer","businessFunction":"http://purl.org/goodrelations/v1#LeaseOut","price":"4.112,00"},{"@type":"Offer","price":"1"}]}</script>
<span><strong>Condomínio</strong> R$ 450,00</span><span><strong>IPTU</strong> R$ 99,50</span>
<span class="a uppercase">Suítes</span><span class="font-bold">1</span><span class="uppercase">Vagas</span> <span class="font-bold">3</span>"""

PRICE_BLOCK = """<div id="info-valores"><li class="first-item"><span>Locação</span><b>R$ 4.500,00</b></li><li><span>IPTU</span><b>R$ 120,00</b></li></div>
<footer></footer><li><i></i><br><span>Dorm.</span><br><b>2</b></li><td><span><i class="fa"></i> sendo Suíte(s)</span></td><td class="r"><b>1</b></td><span>Área (útil)</span><b>78 m2</b>
<section class="x tabs-caracteristicas"><li><i></i>Piscina</li><li>Sala  ampla</li></section><section class="tabs-rooms"><li>Piscina</li><li>Lavabo</li></section>
<script type="application/ld+json">{"@type":"IndividualProduct","description":"False","offers":{"@type":"Offer","price":"1"}}</script>
<div class="most-view"><span>Vagas</span><b>9</b></div>"""


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("olx", "https://sp.olx.com.br/a-1357924680", "venda", OLX, "Santos", "SP"), ("olx", "https://sp.olx.com.br/b", "venda", "<html></html>", "Santos", "SP"),
        ("vivareal", "https://v.com/imovel/apartamento-2-quartos-ponta-da-praia-santos-com-garagem-68m2-venda-RS640000-id-77/", "venda", VIVA, "Santos", "SP"),
        ("vivareal", "https://v.com/imovel/imovel-comercial-id-78/", "venda", "<h1> Oops. </h1>", "Santos", "SP"), ("vivareal", "https://v.com/imovel/imovel-comercial-id-79/", "venda", None, None, None),
        ("veploy", "https://e.com/imovel/AP1234/apartamento", "venda", VEPLOY, None, None), ("veploy", "https://e.com/imovel/AP9/x", "venda", "", None, None),
        ("microsistec_a", "https://m.com/38-apartamento-em-santos-bairro-ponta_da-praia.html", "venda", PRICE_BLOCK, None, None),
    ]
    out, unknown = captures.read_captures(spark.createDataFrame(rows, "platform string, url string, transaction string, body string, hint_city string, hint_state string"))
    assert unknown == []
    return [r.asDict() for r in out.collect()]


def of(found, platform):
    return [r for r in found if r["source_platform"] == platform]


def subset(row, want):
    assert {k: row[k] for k in want} == want
    return True


def test_property_page(found):
    full, empty = sorted(of(found, "olx"), key=lambda r: r["price"] is None)
    assert subset(full, {
        "listing_id": "1357924680", "transaction_type": "locacao", "property_type": "apartamento padrão", "city": "Santos", "state": "SP", "neighborhood": "Boqueirão", "cep": "11055300", "condo_fee": 1250.0,
        "iptu_tax": None, "area_m2": 70.0, "bedrooms": 5, "bathrooms": 0, "parking_spots": None, "amenities": ["Academia", "Ar condicionado", "Piscina"], "description_clean": "uma descrição bem mais longa"})
    assert subset(empty, {"transaction_type": "venda", "city": "Santos", "price": None, "amenities": [], "description_clean": None})


def test_microdata_page(found):
    by = {r["listing_id"]: r for r in of(found, "vivareal")}
    assert "78" not in by
    assert subset(by["77"], {"price": 640000.0, "condo_fee": 1587.0, "iptu_tax": None, "parking_spots": 2, "suites": 0, "bedrooms": None, "floor_level": 22, "amenities": ["Aceita animais"], "neighborhood": "ponta da praia", "property_type": "apartamento", "description_clean": "Apartamento claro"})


def test_offers_page_gives_a_row_for_each_transaction(found):
    by = {r["transaction_type"]: r for r in of(found, "veploy")}
    assert set(by) == {"venda", "locacao"} and len(of(found, "veploy")) == 2
    assert (by["venda"]["price"], by["locacao"]["price"], by["venda"]["listing_id"]) == (430000.0, 4112.0, "AP1234-venda")
    assert subset(by["venda"], {"city": "São Vicente", "state": "SP", "neighborhood": "Centro", "property_type": "Apartamento", "area_m2": 51.0, "area_total_m2": 60.0, "bedrooms": 2, "suites": 1, "parking_spots": 3, "condo_fee": 450.0, "iptu_tax": 99.5, "amenities": ["Piscina", "Sauna"], "description_clean": "Bom", "listing_first_seen": "2026-08-01"})


def test_price_block_page(found):
    (r,) = of(found, "microsistec_a")
    assert subset(r, {"transaction_type": "locacao", "price": 4500.0, "iptu_tax": 120.0, "bedrooms": 2, "suites": 1, "area_m2": 78.0, "parking_spots": None, "amenities": ["Piscina", "Sala ampla", "Lavabo"], "description_clean": None, "listing_id": "38", "city": "Santos", "property_type": "Apartamento", "neighborhood": "Ponta Da Praia"})


def test_json_texts_are_unescaped(spark):
    from pyspark.sql import functions as F

    texts = ["Boqueir\\u00e3o", 'a \\"b\\"', "plain", "bad \\x"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html_platforms.unescaped(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in out} == {texts[0]: "Boqueirão", texts[1]: 'a "b"', texts[2]: "plain", texts[3]: "bad \\x"}
    assert json.loads('"' + texts[0] + '"') == "Boqueirão"
