import json

import pytest
from pyspark.sql import functions as F

from casario.functions import amenities, coerce, folds, pii, text_rules, vocabulary
from casario.operators import history, ingestion, market, metrics, modelling, quality, serving, training
from casario.sources import captures, lake, pages
from casario.streaming import incremental, limiter


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def observed(spark):
    return spark.createDataFrame([
        ("a", "s1", "2026-08-01", 500.0, 1), ("a", "s1", "2026-08-03", 490.0, 2), ("a", "s1", "2026-08-05", None, 3),
        ("a", "s1", "2026-09-01", 480.0, 4), ("b", "s1", "2026-08-02", 10.0, 5), ("b", "s2", "2026-08-02", 11.0, 6), ("c", "s1", "2026-08-01", None, 7),
    ], "property_id string, source_domain string, extraction_date string, price double, tie long").withColumn("mes_referencia", F.substring("extraction_date", 1, 7))


def test_month_keeps_the_last_row_and_known_prices(observed):
    out = {(r.property_id, r.mes_referencia): r for r in history.collapse_month(observed, ["property_id", "mes_referencia"]).collect()}
    a = out["a", "2026-08"]
    assert (a.price, a.preco_primeiro, a.preco_ultimo, a.n_dias_observado, a.preco_mudou_no_mes) == (None, 500.0, 490.0, 3, True)
    assert out["c", "2026-08"].preco_mudou_no_mes is False and out["c", "2026-08"].preco_ultimo is None
    assert len(out) == 4


def test_sources_of_one_day_go_by_name(observed):
    out = {(r.property_id, r.mes_referencia): r.source_domain for r in history.build_month(observed).collect()}
    assert out["b", "2026-08"] == "s2" and len(out) == 4


def test_no_rows_is_an_error(observed):
    with pytest.raises(history.EmptyResult):
        history.require_rows(observed.where("price > 1e9"), "test")


def test_closed_cities_and_null(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "city string")
    one = df.where("city = 'x'")
    assert sorted(rows(history.only_cities(df, one, "city", False))) == [("x",)]
    assert history.only_cities(df, one, "city", True).count() == 2


def test_price_by_area_keeps_infinity(spark):
    df = spark.createDataFrame([(100.0, 0.0), (100.0, None), (100.0, 50.0)], "price double, area_m2 double")
    assert rows(df.select(market.price_per_area())) == [(float("inf"),), (None,), (2.0,)]


def test_as_of_takes_the_last_published(spark):
    left = spark.createDataFrame([("a", "2026-01"), ("a", "2026-05"), ("b", "2026-05"), (None, "2026-05")], "city string, m string")
    right = spark.createDataFrame([("a", "2026-02", 1.0), ("a", "2026-04", None), ("a", "2026-06", 3.0)], "city string, pub string, v double")
    assert sorted(rows(market.as_of(left, right, "m", "pub", ["city"], "x")), key=str) == sorted([("a", "2026-01", None, None), ("a", "2026-05", None, "2026-04"), ("b", "2026-05", None, None), (None, "2026-05", None, None)], key=str)
    assert {r[3] for r in rows(market.as_of(left, right.drop("city"), "m", "pub", [], "x"))} == {None, "2026-04"}


def test_spelling_with_accents_wins(spark):
    df = spark.createDataFrame([("e", "Embare")] * 3 + [("e", "Embaré")], "k string, f string")
    assert rows(market.canonical_spelling(df, "k", "f")) == [("e", "Embaré")]


def test_filters_and_log(spark):
    df = spark.createDataFrame([("venda", 100000.0, 50.0), ("venda", 1000.0, 50.0), ("venda", None, 1.0), ("venda", 100000.0, None), ("venda", 100000.0, 0.0), ("troca", 1e6, 50.0)], "transaction_type string, price double, area_m2 double")
    assert training.filtered(df).count() == 2
    assert rows(training.filter_log(df)) == [(6, 1, 2, 1, 2)]


def test_holdout_keeps_groups_whole(spark):
    df = spark.range(1000).withColumn("g", F.concat(F.lit("g"), (F.col("id") % 100).cast("string")))
    out = training.holdout(df, "g")
    assert out.groupBy("g").agg(F.count_distinct("is_holdout").alias("n")).where("n > 1").count() == 0
    assert out.where("is_holdout").select("g").distinct().count() == 10


@pytest.mark.parametrize("n", [1, 10, 15, 23, 101])
def test_deciles_are_quantile_cuts(spark, n):
    pd = pytest.importorskip("pandas")
    got = [r.decil for r in training.deciles(spark.range(n), ["id"]).orderBy("id").collect()]
    assert got == ([0] if n == 1 else pd.qcut(range(n), 10, labels=False).tolist())


def test_twins_fuse_only_with_known_keys(spark):
    df = spark.createDataFrame([("x", 1, 10.0, None, 1), ("x", 1, 30.0, "s", 2), ("x", None, 5.0, "t", 3), ("x", None, 7.0, "u", 4)], "c string, b int, price double, s string, o long")
    assert sorted(rows(training.fused(df, ["c", "b"], ["o"], ["price"], ["s"])), key=str) == sorted([("x", 1, 20.0, "s", 2), ("x", None, 5.0, "t", 1), ("x", None, 7.0, "u", 1)], key=str)


def test_encoding_ignores_infinite_and_smooths(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", float("inf")), ("b", float("nan"))], "k string, v double")
    got = {r.k: r.encoded for r in training.target_encoding(df, "k", F.col("v")).collect()}
    assert got == {"a": (4 + 20 * 3.0) / 22, "nan": (5 + 60.0) / 21}


def test_terciles_need_three(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", None), ("b", 1.0), ("b", 2.0)], "c string, v double")
    assert {(r.c, r.v): r.faixa for r in serving.terciles(df, "c", "v").collect()} == {("a", 1.0): "abaixo", ("a", 2.0): "media", ("a", 3.0): "acima", ("a", None): None, ("b", 1.0): None, ("b", 2.0): None}


def test_fill_rates_count_empty_as_missing(spark):
    df = spark.createDataFrame([("x", ["a"]), ("", []), (None, None)], "t string, l array<string>")
    assert sorted(rows(quality.fill_rates(df, ["t", "l"]))) == [("l", 1 / 3, 3), ("t", 1 / 3, 3)]


def test_signed_rank_and_discovery_rate():
    assert metrics.signed_rank([1, 2, 3, 4, 5, 6, 7, 8]) < 0.02 < metrics.signed_rank([1, -2, 3, -4, 5, -6, 7, -8])
    assert metrics.signed_rank([0, 0]) == 1.0
    assert metrics.benjamini_hochberg([0.01, 0.04, 0.03, 0.9]) == [True, False, False, False]


def test_coercion(spark):
    df = spark.createDataFrame([("R$ 2.600,00", "50-140 m2", "11075-350"), ("grátis", "sem", "123"), (None, None, None), ("1.234", "1.200 m2", "11075350")], "a string, b string, c string")
    assert rows(df.select(coerce.currency(F.col("a")), coerce.integer(F.col("b")), coerce.cep(F.col("c")))) == [(2600.0, 50, "11075350"), (None, None, None), (None, None, None), (1234.0, 1200, "11075350")]
    urls = spark.createDataFrame([("https://www.Site.com/Imovel/1/?a=1#x",), ("site.com/b/",), (None,)], "u string")
    assert rows(urls.select(coerce.url(F.col("u")))) == [("site.com/imovel/1",), ("site.com/b",), (None,)]


def test_folds_and_vocabulary():
    assert folds.street_key("Av. Paulista") == folds.street_key("AVENIDA  PAULISTA") == "avenida paulista"
    assert folds.place("são  vicente d'oeste") == "Sao Vicente D'Oeste"
    assert folds.slug(" São Paulo/SP ") == "sao-paulo-sp"
    assert vocabulary.type_of("Apartamento Residencial para venda e locação") == "apartamento"
    assert vocabulary.type_of("Kitnet para alugar") == "kitnet" and vocabulary.type_of("O Espaço Ideal") is None
    assert vocabulary.municipality_of("guaruja") == "Guarujá" and vocabulary.municipality_of("Ribeiro dos Santos") is None
    assert vocabulary.amenity_of("Cozinha Planejada") == "armario na cozinha"


def test_titles_are_native(spark):
    df = spark.createDataFrame([("PONTA DA PRAIA",), ("  vila  dos REIS ",), ("",), (None,)], "x string")
    assert rows(df.select(vocabulary.titled(F.col("x")))) == [("Ponta da Praia",), ("Vila dos Reis",), (None,), (None,)]


FOUND = ["(13) 98195-9555", "+55 13 98195 9555", "13981959555", "tel: 13 3041-5555", "https://wa.me/5513981959555", "a.b@c.com.br", "123.456.789-01", "12.345.678/0001-90", "CRECI 12345-F", "Falar com Maria da Silva"]
OTHERS = ["CEP 11075-350", "R$ 790.000,00", "50 m2", "anuncio 2809851822", "Boqueirão, Santos", "falar com apartamento novo", "tel: 11075-350"]


def test_personal_data_is_found(spark):
    df = spark.createDataFrame([(f"antes {t} depois",) for t in FOUND], "t string").select(pii.scrub(F.col("t")).alias("s"))
    out = df.select("s.*", pii.scan(F.col("s.text")).alias("again")).collect()
    assert all(r.hits and pii.MARK in r.text and not r.again for r in out)
    assert [r.hits[0].kind for r in out] == ["phone", "phone", "phone_bare", "phone_param", "contact_url", "email", "cpf", "cnpj", "creci", "labelled_name"]


def test_other_numbers_stay(spark):
    df = spark.createDataFrame([(t,) for t in OTHERS], "t string").select("t", pii.scrub(F.col("t")).alias("s"))
    assert all((r.s.text, r.s.hits) == (r.t, []) for r in df.collect())


def test_scrub_by_example(spark):
    """Each detector sees what the ones before it leave; labels and postal codes stay; white space collapses."""
    M = pii.MARK
    cases = [
        (None, None, []), ("", "", []), ("  a   b ", "a b", []),
        ("corretora: Ana  Souza, CEP 11075-350", f"corretora: {M}, CEP 11075-350", [("labelled_name", "Ana  Souza")]),
        ("ana@b.com e mailto:ana@b.com", f"{M} e {M}", [("contact_url", "mailto:ana@b.com"), ("email", "ana@b.com")]),
        ("wa.me/x11075-350 fim", f"{M} fim", [("contact_url", "wa.me/x11075-350")]),
        ("CPF 123.456.789-01 fone=13 98195 9555", f"CPF {M} {M}", [("cpf", "123.456.789-01"), ("phone_param", "fone=13 98195 9555")]),
    ]
    out = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", pii.scrub(F.col("t")).alias("s")).orderBy("i").collect()
    assert [(r.s.text, [(h.kind, h.value) for h in r.s.hits]) for r in out] == [c[1:] for c in cases]


def test_gate(spark):
    ok = spark.createDataFrame([("x", ["Piscina"])], "city string, amenities array<string>")
    assert pii.gate(ok) is ok
    with pytest.raises(pii.PersonalData):
        pii.gate(spark.createDataFrame([("x", ["ligue 13981959555"])], "city string, amenities array<string>"))


def test_urls(spark):
    cases = {
        "https://wa.me/5513981959555": None, "https://a.com/x?telefone=13981959555": "https://a.com/x", "https://a.com/id-2809851822": "https://a.com/id-2809851822",
        None: None, " ": None, "HTTP://a.com/x?q=a@b.co#f": "http://a.com/x", "a.com/x?q=a@b.co": "a.com/x", "https://a.com/a@b.co": None, " https://a.com/x?p=1 ": "https://a.com/x?p=1",
    }
    out = spark.createDataFrame([(u,) for u in cases], "u string").select("u", pii.scrub_url(F.col("u")).alias("v")).collect()
    assert {r.u: r.v for r in out} == cases


def test_amenities_and_denials():
    yes, no = amenities.extract("Não possui garagem, portaria nem bicicletário. Porém tem piscina, sem elevador, com churrasqueira")
    assert set(yes) == {"Piscina", "Churrasqueira"} and set(no) == {"Garagem", "Portaria", "Bicicletário", "Elevador"}
    assert amenities.extract("sem necessidade de portaria") == (["Portaria"], [])
    assert amenities.extract(None) == ([], [])
    # a denial ends at five words, at a stop or at an affirming verb; "sem" at a comma or after forty characters
    assert amenities.extract("nao tem um dois tres quatro cinco piscina") == (["Piscina"], [])
    assert amenities.extract("nenhum elevador; piscina") == (["Piscina"], ["Elevador"])
    assert amenities.extract("nao tem sauna tem sauna") == (["Sauna"], ["Sauna"])
    assert amenities.extract("sem sauna, piscina") == (["Piscina"], ["Sauna"])
    assert amenities.extract("sem " + "x" * 39 + " sauna") == (["Sauna"], [])


def test_text_rules(spark):
    texts = ["apartamento reformado com 1 vaga demarcada e varanda gourmet, vista para o mar " * 2, "curto", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r.i: r for r in text_rules.with_rules(df, "t").collect()}
    assert (out[0].rx_vaga_tipo, out[0].rx_varanda_tipo, out[0].rx_vista, out[0].rx_estado_conservacao, out[0].rx_vaga_tipo_ord) == ("privativa_demarcada", "gourmet", "mar_total", "reformado", 6)
    assert out[1].rx_vista == "sem_descricao" and out[1].rx_vista_ord is None and out[1].rx_desc_chars is None


def test_captures_project_and_split(spark):
    body = [
        ("universal", "https://a.com/1", "venda", {"codigo": 7, "tipo": "Casa", "cidade": "Santos", "estado": "SP", "bairro": "Gonzaga", "valor": "R$ 790.000,00", "areaprincipaltratado": 7820, "numeroquartos": "3", "numerovagas": "0", "piscina": "1", "sauna": "0", "captadores": [{"nome": "X", "telefone": "13981959555"}], "valoriptu": "0"}),
        ("microsistec_b", "u", None, {"code": "c1", "details_url": "https://b.com/c1", "for_sale": True, "for_rent": True, "sale_price": 500000, "rent_price": "2500.00", "condominium_price": "130.00", "area_useful": 60, "features": [{"id": 1, "name": "Sauna"}], "receiver1": {"phones": ["1"]}}),
        ("lopes", "https://c.com/s1", None, {"product": {"sku": "s1", "dealTypes": ["sale"], "prices": {"sale": 5800000.0, "property": 0}, "address": {"city": "Santos", "stateInitials": "SP"}, "attributes": [{"type": "area_attr", "value": "97,5m²"}, {"type": "floor_attr", "value": "19º"}], "condominium": {"amenities": [{"name": "Piscina"}]}, "features": [{"name": "Lavabo"}], "agents": [{"name": "Y"}]}}),
        ("unknown", "u", None, {}),
    ]
    df = spark.createDataFrame([(p, u, t, json.dumps(b, ensure_ascii=False)) for p, u, t, b in body], "platform string, url string, transaction string, body string")
    out, missing = captures.read_captures(df)
    by = {r.listing_id: r for r in out.collect()}
    assert missing == ["unknown"] and set(by) == {"7-venda", "c1-venda", "c1-locacao", "s1-venda"}
    u = by["7-venda"]
    assert (u.price, u.area_m2, u.bedrooms, u.parking_spots, u.iptu_tax, u.amenities) == (790000.0, 78.0, 3, 0, None, ["Piscina"])
    assert (by["c1-venda"].price, by["c1-locacao"].price, by["c1-locacao"].condo_fee) == (500000.0, 2500.0, 130.0)
    assert (by["s1-venda"].area_m2, by["s1-venda"].floor_level, by["s1-venda"].iptu_tax, by["s1-venda"].amenities) == (97.5, 19, None, ["Piscina", "Lavabo"])
    with pytest.raises(ValueError):
        captures.reader("lopes")(lambda d: d)


def raw(spark):
    return spark.createDataFrame([
        ("1", "https://www.a.com/1/", "Venda", "R$ 500.000,00", "50-140 m2", "Santos", "11075-350", "Ligue (13) 98195-9555", ["Piscina"]),
        ("2", "https://wa.me/5513981959555", "Aluguel", "2.500", "60", "Santos", None, None, None),
        ("3", "https://www.a.com/3", "troca", "1", "60", None, None, None, None),
        ("4", "https://www.a.com/4", "Aluguel", "10", "60", "Manaus", None, None, None),
        ("5", "https://www.a.com/5", "Alugar", "2.500", "x", None, None, None, None),
    ], "listing_id string, link string, transaction_type string, price string, area_m2 string, city string, cep string, description_clean string, amenities array<string>").withColumns({"source_platform": F.lit("p"), "agent": F.lit("Nome")})


def test_ingestion(spark):
    found = ingestion.normalised(ingestion.with_provenance(raw(spark), "a.com", "2026-08-01", state="SP"), ["Santos"])
    out = {r.price if r.motivo is None else r.motivo: r for r in found.collect()}
    assert "agent" not in found.columns and {r.motivo for r in found.collect()} == {None, "link", "missing: transaction_type", "city"}
    one = out[500000.0]
    assert (one.area_m2, one.cep, one.cep_prefix, one.description_clean, one.transaction_type) == (50.0, "11075350", "11075", f"Ligue {pii.MARK}", "venda")
    assert out[2500.0].amenities == [] and out[2500.0].area_m2 is None
    assert out["city"].anulados == ["price"]
    assert {r.motivo: r.n for r in ingestion.report(found).collect()}[None] == 2


def test_lake(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    keep = lambda day, price, ids=("1", "5"): lake.as_record(ingestion.normalised(ingestion.with_provenance(raw(spark), "a.com", day, "Santos", "SP")).where(F.col("motivo").isNull())).where(F.col("price").isNotNull()).withColumn("price", F.col("price") + price)
    first = lake.write_day(keep("2026-08-01", 0.0), root, "SP", "São Paulo", "2026-08-01", "p", "a.com")
    assert first.endswith("raw/sp/sao-paulo/2026/08/01/p/a.com")
    lake.write_day(keep("2026-08-01", 1.0).limit(1), root, "SP", "São Paulo", "2026-08-01", "p", "a.com")
    lake.write_day(keep("2026-09-02", 2.0), root, "SP", "São Paulo", "2026-09-02", "p", "a.com")
    assert lake.months(spark, root) == ["2026-08", "2026-09"]
    month = lake.read_month(spark, root, "2026-08")
    assert month.count() == 2 and {(r.uf, r.cidade, r.dominio) for r in month.collect()} == {("sp", "sao-paulo", "a.com")}
    assert sum(r.price % 10 == 1 for r in month.collect()) == 1
    with pytest.raises(LookupError):
        lake.read_month(spark, root, "2025-01")
    with pytest.raises(history.EmptyResult):
        lake.write_day(keep("2026-08-01", 0.0).limit(0), root, "SP", "x", "2026-08-01", "p", "a.com")
    with pytest.raises(pii.PersonalData):
        lake.write_day(keep("2026-08-01", 0.0).withColumn("address", F.lit("13981959555")), root, "SP", "x", "2026-08-01", "p", "b.com")
    assert lake.months(spark, f"{root}/none") == []
    table = f"file://{tmp_path}/months"
    lake.write_months(month, table)
    lake.write_months(lake.read_month(spark, root, "2026-09"), table)
    assert lake.read_months(spark, table).count() == 4 and lake.read_months(spark, table, "2026-08").count() == 2
    assert lake.same_after_copy(month, lake.read_months(spark, table, "2026-08"))
    with pytest.raises(ValueError):
        lake.write_months(month.withColumn("uf", F.lit("")), table)


def test_mixed_number_types_merge(spark, tmp_path):
    for day, kind in (("01", "long"), ("02", "double")):
        spark.createDataFrame([(f"p{day}", 3)], "property_id string, bedrooms int").withColumn("price", F.lit(5).cast(kind)).write.parquet(f"file://{tmp_path}/sp/x/2026/08/{day}/p/d")
    assert sorted(r.price for r in lake.read_month(spark, f"file://{tmp_path}", "2026-08").collect()) == [5.0, 5.0]


def test_stream_upserts_months(spark, tmp_path):
    source, to = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    def put(day, price):
        lake.as_record(spark.createDataFrame([("a", day, price, "SP", "Santos", "s")], "property_id string, extraction_date string, price double, state string, city string, source_domain string")).write.mode("append").parquet(source)
        incremental.start(incremental.captures_stream(spark, source), to, f"file://{tmp_path}/check").awaitTermination()
    put("2026-08-01", 1.0)
    put("2026-08-03", 3.0)
    put("2026-08-02", 2.0)
    put("2026-09-01", 9.0)
    assert sorted((r.extraction_date, r.price) for r in lake.read_months(spark, to).collect()) == [("2026-08-03", 3.0), ("2026-09-01", 9.0)]


def test_limiter(spark):
    times = [0, 1, 2, 5, 9, 10, 11, 30]
    df = spark.createDataFrame([("k", t) for t in times] + [("other", 1)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    out = {r.s: r.admitido for r in limiter.admitted(df, "k", "ts", 2, 10.0).where("k = 'k'").collect()}
    assert out == {0: True, 1: True, 2: False, 5: False, 9: False, 10: True, 11: True, 30: True}


def test_jsonld():
    html = """<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Casa", "seller": {"@type": "Person", "telephone": "1"}, "offers": {"@type": "Offer", "price": "5"}}, {"@type": "RealEstateAgent", "name": "X"}]}</script>
    <script type="application/ld+json">{bad</script>"""
    found = pages.blocks_of(html)
    assert [b["types"] for b in found] == [["Product"], ["Offer"]] and "telephone" not in found[0]["json"]


def test_price_model_and_interval(spark):
    df = spark.range(1200).select("id", (F.col("id") % 97 + 20).cast("double").alias("area_m2"), F.when(F.col("id") % 5 > 0, (F.col("id") % 4).cast("int")).alias("bedrooms"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("city"))
    df = df.withColumn("log_price", F.ln("area_m2") + F.col("id") % 3 * 0.5 + (F.col("id") % 11 - 5) * 0.01)
    df = modelling.with_missing(df, ["area_m2", "bedrooms"]).withColumns({"y_log": F.col("log_price"), "price": F.exp("log_price")})
    fold = F.col("id") % 4
    model = modelling.fit(df.where(fold < 2), "id", ["area_m2", "bedrooms"], ["city"])
    cal = modelling.predicted(model, df.where(fold == 2))
    out = modelling.with_interval(modelling.predicted(model, df.where(fold == 3)), modelling.residual_quantiles(cal, "city"), "city")
    m = metrics.regression_metrics(out).first()
    assert m.mdape < 0.1
    assert 0.6 < metrics.coverage(out.withColumn("cruzou", F.lit(False)), "price").first().cobertura <= 1
    gone = modelling.erased(df, "bedrooms", [], F.col("id") % 2 == 0)
    assert gone.where("id % 2 = 0 AND (bedrooms IS NOT NULL OR aus_bedrooms <> 1)").count() == 0


def test_medians_impute_and_axes(spark):
    df = spark.range(400).select("id", F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("c"), F.when(F.col("id") % 3 > 0, F.col("id") % 2 * 100.0 + 50).alias("fee"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 * 2 + F.col("id") % 3).cast("double").alias("y"))
    out = modelling.imputed(df, df, "fee", ["c"])
    assert out.where("fee IS NULL").count() == 0 and {round(r.fee) for r in out.where("c = 'c1'").collect()} == {150}
    axes = modelling.rotated(df, df, "x", "y").agg(F.variance("eixo_1").alias("a"), F.variance("eixo_2").alias("b"), F.corr("eixo_1", "eixo_2").alias("r")).first()
    assert axes.a > 20 * axes.b and abs(axes.r) < 1e-6
    ci = modelling.bootstrap_median(df.limit(200), "x").first()
    assert 6 < ci.lo <= ci.hi < 14


def test_exact_percentiles_by_ranges(spark):
    df = spark.range(997).selectExpr("id % 3 AS g", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 2.5 ELSE sin(id) END AS v", "id")
    shares = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "top": 1.0}
    got = {r.g: r for r in training.percentiles(df, ["g"], "v", shares).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(*(F.percentile("v", s).alias(k) for k, s in shares.items())).collect()}
    assert got.keys() == want.keys() and all(got[g][k] == pytest.approx(want[g][k], abs=1e-12) for g in want for k in shares)
    assert training.percentiles(df.where("v > 9"), ["g"], "v", shares).count() == 0
    assert metrics.coverage(df.selectExpr("v AS lo", "v AS hi", "v AS y", "false AS cruzou").where("lo > 9"), "y").first().largura_mediana is None


def test_ranks_are_not_numbered_in_one_task(spark):
    df = spark.range(5000).selectExpr("pmod(id * 7919, 5000) AS v", "id AS tie", "cast(id AS string) AS g")
    for out in (training.deciles(df, ["v", "tie"]), training.group_folds(df, "g", "v"), metrics.decile_calibration(df, "v", "v", "tie")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" not in plan
        assert all("_range" in line or "_n#" in line or "_in#" in line for line in plan.splitlines() if "windowspecdefinition" in line)
    dealt = training.by_range(df, ["v", "tie"])
    assert dealt.select("_range").distinct().count() > 1
    assert [r.v for r in training.ranked(df, ["v", "tie"]).orderBy("_rank").collect()] == list(range(5000))


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """More rows make more ranges, values and bins stay the same: no task sorts or counts more than its share."""
    monkeypatch.setattr(training, "RANGE", 100)
    df = spark.range(0, 3000, 1, 3).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, -0.0).otherwise(F.col("id") * 7919 % 3000 / 10.0).alias("v"), F.col("id").alias("tie"))
    assert training.by_range(df, ["v", "tie"]).select("_range").distinct().count() >= 25
    assert [r.tie for r in training.ranked(df, ["v", "tie"]).orderBy("_rank").collect()] == [r.tie for r in df.orderBy("v", "tie").collect()]
    got = {r.g: (r.m, r.p) for r in training.percentiles(df, ["g"], "v", {"m": 0.5, "p": 0.9}).collect()}
    assert got == {r.g: (r.m, r.p) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.9).alias("p")).collect()}
