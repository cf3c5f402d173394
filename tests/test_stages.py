"""Command line stages, migration, sitemaps and the smaller catalogue and report operators."""

import pytest
from pyspark.sql import functions as F

from casario import cli
from casario.operators import catalogue, market, modelling, quality, serving
from casario.sources import lake, pages


@pytest.fixture(scope="module")
def captures(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    rows = [(f"id{i}", "a.com", "p", f"https://a.com/{i}", "venda", "apartamento", "Gonzaga" if i % 2 else "Gonzága", "Santos", "SP", 300_000.0 + 1000 * i, 60.0, 1 + i % 3, "2026-08-01", "11060001") for i in range(60)]
    names = "property_id string, source_domain string, source_platform string, link string, transaction_type string, property_type string, neighborhood string, city string, state string, price double, area_m2 double, bedrooms int, extraction_date string, cep string"
    lake.write_day(spark.createDataFrame(rows, names), root, "SP", "Santos", "2026-08-01", "p", "a.com")
    return root


def test_stages_from_captures_to_training_tables(spark, captures, tmp_path, capsys):
    history, to = str(tmp_path / "history"), str(tmp_path / "market")
    assert cli.main(["month", "--source", captures, "--to", history, "--month", "2026-08"], spark) == 0
    assert "nothing is written" in capsys.readouterr().out and not (tmp_path / "history").exists()
    assert cli.main(["month", "--source", captures, "--to", history, "--month", "2026-08", "--write"], spark) == 0
    assert cli.main(["market", "--source", history, "--to", to, "--write"], spark) == 0
    assert [(r.city, r.neighborhood, r.n_anuncios) for r in spark.read.parquet(f"{to}/mercado").collect()] == [("Santos", "Gonzaga", 60)]
    assert cli.main(["training", "--source", history, "--to", str(tmp_path / "abt"), "--month", "2026-08", "--write"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "abt/venda/abt")).count() + spark.read.parquet(str(tmp_path / "abt/venda/holdout")).count() == 60
    assert cli.main(["vocabulary", "--source", history, "--to", str(tmp_path / "v"), "--write"], spark) == 0
    assert {r.neighborhood for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"Gonzága"}
    assert cli.main(["month", "--source", captures, "--to", history, "--month", "2020-01"], spark) == 1
    assert cli.main(["index", "--source", str(tmp_path / "none"), "--to", to], spark) == 1


def test_counts_of_files_and_migration(spark, captures, tmp_path):
    old = tmp_path / "old" / "sp" / "santos" / "2026-08-02" / "p" / "a.com"
    spark.createDataFrame([("x",), ("y",)], "property_id string").coalesce(1).write.parquet(str(old))
    (r,) = lake.migrate(spark, str(tmp_path / "old"), str(tmp_path / "new")).collect()
    assert (r.antes, r.depois, r.mesmos) == (2, 2, True) and r.destino.endswith("sp/santos/2026/08/02/p/a.com")
    with pytest.raises(FileExistsError):
        lake.migrate(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    (old / "broken.parquet").write_text("no parquet")
    spark.createDataFrame([], "property_id string").coalesce(1).write.mode("append").parquet(str(old))
    files = lake.file_counts(spark, f"{old}/*.parquet")
    assert sorted(r.linhas for r in files.collect())[0] == -1 and sorted(r.linhas for r in files.collect())[-1] == 2
    health = {r.verificacao: r.ok for r in quality.layer_health(files, "cru").collect()}
    assert health["cru_arquivos"] and not health["cru_ilegiveis"]


def test_nested_sitemaps(spark, tmp_path):
    head = '<?xml version="1.0"?>'
    (tmp_path / "top.xml").write_text(head + "<sitemapindex><sitemap><loc> https://a.com/one.xml </loc></sitemap><sitemap><loc>https://a.com/bad.xml</loc></sitemap><sitemap><loc>https://a.com/top.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "one.xml").write_text(head + "<urlset><url><loc>https://a.com/1</loc><lastmod>2026-08-01</lastmod></url><url><loc>https://a.com/1</loc><lastmod>2026-08-02</lastmod></url><url><loc>https://a.com/2</loc></url></urlset>")
    (tmp_path / "bad.xml").write_text("not xml at all")
    out = pages.nested_sitemap(spark, str(tmp_path / "top.xml"), lambda loc: str(tmp_path / loc.rsplit("/", 1)[1]))
    assert sorted(map(tuple, out.collect()), key=str) == [("https://a.com/1", "2026-08-02"), ("https://a.com/2", None)]


def test_first_block_of_a_type(spark):
    html = '<script type="application/ld+json">[{"@type":"Place","name":"p"},{"@type":"Apartment"},{"@type":"Apartment","name":["a","b"]}]</script>'
    df = spark.createDataFrame([(html,), ("",)], "h string").select(pages.blocks(F.col("h")).alias("b"))
    out = df.select(pages.first_of_type(F.col("b"), ("Apartment",), "name").alias("n"), pages.first_of_type(F.col("b"), ("House",)).alias("h")).collect()
    assert [tuple(r) for r in out] == [("a", None), (None, None)]


def test_sources_and_transactions(spark):
    s = spark.createDataFrame([("a", "p", True, ["Santos"]), ("b", "q", True, []), ("c", "p", False, [])], "domain string, platform string, enabled boolean, cities array<string>")
    names = lambda d: sorted(r.domain for r in d.collect())
    assert names(catalogue.serving_sources(s)) == ["a", "b"] and names(catalogue.serving_sources(s, "p")) == ["a"] and names(catalogue.serving_sources(s, city="Campos")) == ["b"]
    ok = spark.createDataFrame([("venda",)], "transaction_type string")
    assert catalogue.checked_transactions(ok) is ok
    with pytest.raises(ValueError):
        catalogue.checked_transactions(spark.createDataFrame([("troca",), (None,)], "transaction_type string"))


def test_index_only_cities_and_city_view(spark):
    m = spark.createDataFrame([("Santos", "Gonzaga", 3, "2026-08")], "cidade string, bairro string, n_anuncios long, mes_referencia string")
    i = spark.createDataFrame([("Santos", "2026-08", 1.0), ("Campos", "2026-07", 2.0), ("Campos", "2026-08", 3.0)], "cidade string, mes_referencia string, venda_m2 double")
    out = {r.cidade: r for r in market.with_index_only(m, i).collect()}
    assert (out["Campos"].bairro, out["Campos"].n_anuncios, out["Campos"].mes_referencia) == (None, 0, "2026-08") and len(out) == 2
    rows = spark.createDataFrame([("Santos", "a", 2, 10.0, 1.0, "2026-07", 5.0), ("Santos", "b", 3, 30.0, 3.0, "2026-08", 6.0)], "city string, neighborhood string, n_anuncios long, preco_mediano double, preco_m2_mediano double, mes_referencia string, ipca_12m double")
    (r,) = serving.city_view(rows, ["ipca_12m"]).collect()
    assert (r.n_bairros, r.n_anuncios, r.preco_mediano, r.ipca_12m, r.mes_referencia) == (2, 5, 20.0, 6.0, "2026-08")


def test_targets_places_and_estimators(spark):
    d = spark.createDataFrame([("Santos", "venda", "2026-08", "g")] * 2 + [("Santos", "venda", "2026-09", "h")], "city string, alvo string, mes_referencia string, neighborhood string")
    t = spark.createDataFrame([("Santos", "venda"), ("Campos", "venda")], "city string, alvo string")
    assert sorted(map(tuple, quality.counts_by_target(d, t, ["city", "alvo"]).collect())) == [("Campos", "venda", 0, None), ("Santos", "venda", 3, "2026-09")]
    assert [tuple(r) for r in quality.thin_neighbourhoods(d, least=2).collect()] == [("h", 1)]
    with pytest.raises(ValueError):
        modelling.estimator("gbt")(None)
    assert modelling.price_model(["area_m2"], [], kind="forest").getStages()[-1].getNumTrees() == 20


def test_a_day_is_not_ranked_to_see_whether_it_has_rows(spark, tmp_path, monkeypatch):
    plans, real = [], lake.require_rows
    monkeypatch.setattr(lake, "require_rows", lambda d, what: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(d, what))
    lake.write_day(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "property_id string, price double"), f"file://{tmp_path}/lake", "SP", "Santos", "2026-08-01", "p", "a.com")
    assert len(plans) == 1 and "Window" not in plans[0]
    assert spark.read.parquet(f"file://{tmp_path}/lake/sp/santos/2026/08/01/p/a.com").count() == 1
