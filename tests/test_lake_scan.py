"""Footers, the ledgered upsert, the enriched table, facets and bins."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casario import cli
from casario.operators import enrichment, serving
from casario.sources import lake, pages
from casario.streaming import incremental


def test_footers_take_one_job(spark, tmp_path):
    for i in range(30):
        spark.createDataFrame([(f"p{i}", 3)] * (i + 1), "property_id string, bedrooms int").withColumn("price", F.lit(5).cast("long" if i % 2 else "double")).coalesce(1).write.parquet(f"{tmp_path}/sp/x/2026/08/{i + 1:02d}/p/d")
    (tmp_path / "sp/x/2026/08/01/p/d/odd.parquet").write_text("no parquet")
    spark.createDataFrame([(1,)], "other int").coalesce(1).write.parquet(f"{tmp_path}/sp/x/2026/08/31/p/d")
    glob = f"{tmp_path}/*/*/2026/08/*/*/*/*.parquet"
    files = lake.listed(spark, glob)
    counts = lake.file_counts(spark, glob)
    spark.sparkContext.setJobGroup("footers", "")
    got = {r.arquivo: r.linhas for r in counts.collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("footers")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 2 and len(got) == len(files) == 32
    assert sorted(got.values()) == [-1, -1, *range(1, 31)]
    with pytest.raises(OSError, match="odd.parquet"):
        lake.read_month(spark, f"{tmp_path}", "2026-08")
    (tmp_path / "sp/x/2026/08/01/p/d/odd.parquet").unlink()
    assert lake.read_month(spark, f"{tmp_path}", "2026-08").where("price = 5.0").count() == sum(range(1, 31))
    assert lake.file_counts(spark, f"{tmp_path}/none/*.parquet").count() == 0


def test_footers_of_other_stores_come_by_sparks_reader(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("a",), ("b",)], "property_id string").coalesce(1).write.parquet(f"{tmp_path}/t")
    (tmp_path / "t/bad.parquet").write_text("x")
    monkeypatch.setattr(lake, "OPENED", {})
    assert sorted(r.linhas for r in lake.file_counts(spark, f"{tmp_path}/t/*.parquet").collect()) == [-1, 2]


def _batch(spark, rows):
    return spark.createDataFrame(rows, "property_id string, extraction_date string, price double, state string, city string, source_domain string")


def test_upsert_leaves_other_partitions_and_a_batch_counts_once(spark, tmp_path):
    to = f"file://{tmp_path}/t"
    put = incremental.upsert_batch(to)
    put(_batch(spark, [(f"p{i}", "2026-08-01", 1.0, "SP", city, "s") for i in range(20) for city in ("Santos", "Campinas", "Guarujá")]), 0)
    put(_batch(spark, [("p1", "2026-07-01", 1.0, "SP", "Santos", "s")]), 1)
    stamps = lambda: {str(p): p.stat().st_mtime_ns for p in Path(tmp_path, "t").rglob("*.parquet")}
    before = stamps()
    put(_batch(spark, [("p1", "2026-08-02", 9.0, "SP", "Campinas", "s"), ("new", "2026-08-02", 7.0, "SP", "Campinas", "s"), ("p2", "2026-07-30", 0.5, "SP", "Campinas", "s")]), 2)
    after = stamps()
    assert all(after[p] == t for p, t in before.items() if "cidade=campinas" not in p) and not any(p in after for p in before if "cidade=campinas" in p)
    got = {(r.property_id, r.cidade, r.mes): r.price for r in lake.read_months(spark, to).collect()}
    assert got["p1", "campinas", "08"] == 9.0 and got["p1", "santos", "08"] == 1.0 and got["new", "campinas", "08"] == 7.0 and len(got) == 63
    put(_batch(spark, [("p1", "2026-08-03", 5.0, "SP", "Campinas", "s")]), 2)  # the same batch again: entered already
    assert lake.read_months(spark, to).where("price = 5.0").count() == 0
    entries = sorted((r.lote, r.linhas, sorted(r.particoes)) for r in incremental.ledger(spark, to).collect())
    assert entries[0][:2] == (0, 60) and entries[2] == (2, 3, ["sp/campinas/2026/07", "sp/campinas/2026/08"])
    assert not list(Path(tmp_path).glob("t.batch-*"))


def test_upsert_of_many_partitions_joins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_PARTITIONS", 1)
    to = f"file://{tmp_path}/t"
    put = incremental.upsert_batch(to)
    put(_batch(spark, [("a", "2026-08-01", 1.0, "SP", "Santos", "s"), ("a", "2026-08-01", 1.0, "SP", "Campinas", "s")]), 0)
    put(_batch(spark, [("a", "2026-08-02", 2.0, "SP", "Santos", "s"), ("b", "2026-08-02", 2.0, "SP", "Campinas", "s")]), 1)
    assert sorted((r.property_id, r.cidade, r.price) for r in lake.read_months(spark, to).collect()) == [("a", "campinas", 1.0), ("a", "santos", 2.0), ("b", "campinas", 2.0)]


def test_enriched_months_merge_their_columns(spark, tmp_path, capsys):
    text = {"08": ["Lindo apartamento com piscina e elevador, vista livre e duas vagas paralelas para o morador.", None, "Sem elevador, mas com churrasqueira e lazer completo para toda a sua grande família."], "09": ["Apartamento em obras, entrega prevista para o próximo ano, com academia e salão de festas."]}
    rows = [(f"p{m}{i}", t, ["Piscina"] if i == 0 else None, "sp", "santos", "2026", m) for m, ts in text.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "property_id string, description_clean string, amenities array<string>, uf string, cidade string, ano string, mes string")
    lake.write_months(df, str(tmp_path / "h"))
    for month in ("2026-08", "2026-09"):
        assert cli.main(["enriched", "--source", str(tmp_path / "h"), "--to", str(tmp_path / "e"), "--month", month, "--write"], spark) == 0
    assert "da_fonte 1" in capsys.readouterr().out
    both = enrichment.read_enriched(spark, str(tmp_path / "e"))
    got = {r.property_id: r for r in both.collect()}
    assert got["p080"].amen_piscina and got["p080"].amen_elevador and not got["p082"].amen_elevador and got["p082"].nega_elevador and not got["p090"].amen_elevador
    assert got["p090"].em_obra and not got["p080"].em_obra and not {"description_clean", "amenities", "amenities_fonte"} & set(both.columns)
    assert got["p081"].rx_vista == "sem_descricao"
    assert enrichment.read_enriched(spark, str(tmp_path / "e"), "2026-09").count() == 1
    report = enrichment.report(enrichment.with_amenities(df)).first()
    assert report.da_fonte == 2 and report.com_negacao == 1 and report.ganharam == 3


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(enrichment, "MOST_LABELS", 2)
    df = spark.createDataFrame([(1, ["a", "b", "c"], None)], "property_id int, amenities array<string>, description_clean string")
    with pytest.raises(ValueError):
        enrichment.expanded(enrichment.with_amenities(df))


def test_label_columns():
    assert [enrichment.label_column(x) for x in ("Varanda Gourmet", "Portão Eletrônico", "TV / Cabo (24h)")] == ["varanda_gourmet", "portao_eletronico", "tv_cabo_24h"]


def test_facets_and_harvest(spark):
    page = lambda path, *links: (f"https://a.com{path}", "".join(f'<a href="{x}">x</a>' for x in links))
    rows = [
        page("/venda/", "/venda/santos/", "/venda/santos/", "/venda/", "/venda/ab/", "/outra/abc/", "/venda/x?y=1/", "/venda/sem-barra", "/venda/campinas/"),
        page("/venda/santos/", "/venda/santos/gonzaga/", "/venda/", "/venda/campinas/"),
        page("/venda/santos/gonzaga/", "/venda/santos/gonzaga/"), page("/aluguel/", "/aluguel/santos/"), (None, "x"), ("https://a.com/nulo/", None),
    ]
    df = spark.createDataFrame([*rows, rows[0]], "url string, html string")
    got = sorted(tuple(r) for r in pages.harvest(df, df.where("url = 'https://a.com/venda/'").select("url")).collect())
    at = "https://a.com/venda/"
    assert got == [(at, 0, True), (f"{at}campinas/", 1, False), (f"{at}santos/", 1, True), (f"{at}santos/gonzaga/", 2, True)]
    with pytest.raises(RuntimeError):
        pages.harvest(df, df.where("url = 'https://a.com/venda/'").select("url"), rounds=1)


def test_bins(spark):
    rng = random.Random(3)
    values = [rng.uniform(-30, 80) for _ in range(50)] + [0.0, None, -30.0, 80.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    lo, hi = min(known), max(known)
    cuts = [lo - lo * 0.45, lo * 0.10, hi * 0.10, hi * 0.50]
    assert {r.v: r.faixa_cor for r in serving.diverging_bins(df, "v").collect()} == {v: None if v is None else sum(v > c for c in cuts) for v in values}
    step = (hi - lo) / 5
    assert {r.v: r.faixa_cor for r in serving.width_bins(df, "v").collect()} == {v: None if v is None else sum(v > lo + i * step for i in range(1, 5)) for v in values}
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert {r.faixa_cor for r in serving.width_bins(same, "v").collect()} == {0} and serving.diverging_bins(same, "v", 5.0).first().faixa_cor == 0
