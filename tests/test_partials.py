"""Configurations, checks and small operators beside their queries."""

import json
import re

import pandas as pd
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from casario.functions import amenities, coerce, folds, text_rules
from casario.operators import catalogue, features, history, ingestion, metrics, training
from casario.plans import reader_queries
from casario.sources import models, pages


def test_configuration_files(spark, tmp_path):
    good = {"version": models.CONFIG_VERSION, "sources": [{"domain": "a.com", "transactions": ["venda"]}], "targets": [{"city": "Santos"}], "compliance": {"robots": True}}
    (tmp_path / "c.json").write_text(json.dumps(good))
    sources, targets = models.config_tables(spark, models.read_config(spark, f"file://{tmp_path}/c.json"))
    assert [r.domain for r in sources.collect()] == ["a.com"] and targets.count() == 1
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list.json").write_text("[]")
    (tmp_path / "off.json").write_text(json.dumps(good | {"compliance": {"robots": False}}))
    for name in ("bad", "list", "off"):
        with pytest.raises(models.InvalidConfig):
            models.read_config(spark, f"file://{tmp_path}/{name}.json")
    (tmp_path / "c.yaml").write_text(f"version: {models.CONFIG_VERSION}\nsources:\n  - domain: a.com\n")
    try:
        import yaml  # noqa: F401
    except ModuleNotFoundError:
        with pytest.raises(models.InvalidConfig):
            models.read_config(spark, f"file://{tmp_path}/c.yaml")
    else:
        assert models.read_config(spark, f"file://{tmp_path}/c.yaml")["sources"][0]["domain"] == "a.com"


def test_sets_and_missing_columns(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert [r.k for r in catalogue.missing_ids(a, b, "k").collect()] == [1]
    with pytest.raises(ValueError, match="2"):
        catalogue.disjoint(a, b, "k")
    catalogue.disjoint(a, b.where("k = 3"), "k")
    with pytest.raises(features.MissingColumns):
        features.form_cut(a, ["k"], ["fold"])


def test_hints_stay_below_the_page(spark):
    d = spark.createDataFrame([("page", "hint", None), (None, "hint", "s")], "city string, hint_city string, hint_state string")
    out = ingestion.with_provenance(d, "a.com", "2026-08-01", "Alvo", "SP").orderBy(F.desc("city")).collect()
    assert [(r.city, r.state) for r in out] == [("page", "SP"), ("hint", "s")] and "hint_city" not in out[0].asDict()


def test_empty_reports(spark):
    runs = spark.createDataFrame([], "platform string, domain string, skipped string, error string, rows long")
    assert [tuple(r) for r in ingestion.run_report(runs).collect()] == [("TOTAL", None, 0, 0)]
    assert features.family_prevalence(spark.createDataFrame([], "a boolean"), ["a"]).first().prevalencia is None


def test_months_and_lists_of_text(spark):
    d = spark.createDataFrame([("2026-08",), ("2026-08-31x",), ("2026-13-01",), ("202612",), ("20261",), (None,)], "t string")
    assert [r[0] for r in d.select(coerce.month_of(F.col("t"))).collect()] == ["2026-08", "2026-08", None, "2026-12", None, None]
    assert spark.range(1).select(coerce.split_list(F.lit(" a 0, ,1 b ,"))).first()[0] == ["a 0", "1 b"]


def test_interval_of_the_median_is_what_resampling_gives(spark):
    import numpy as np

    from casario.operators import modelling

    rng = np.random.default_rng(2)
    values = np.sort(rng.exponential(3, 301))
    medians = np.sort(values[rng.integers(0, 301, (4000, 301))], axis=1)[:, 150]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
    got = modelling.bootstrap_median(df, "x").first()
    near = [abs(np.searchsorted(values, got[i]) - np.searchsorted(values, np.quantile(medians, q, method="inverted_cdf"))) for i, q in ((0, 0.025), (1, 0.975))]
    assert max(near) <= 2
    assert tuple(modelling.bootstrap_median(df.where("x < 0"), "x").first()) == (None, None)


def test_means_of_twins_in_any_order(spark):
    rows = [("x", 1, 0.1, "b"), ("x", 1, 0.2, "a"), ("x", 1, 0.3, "c"), ("y", 2, 1e300, "d"), ("y", 2, 1e300, "e")]
    found = {tuple(training.fused(spark.createDataFrame(r, "k string, o int, v double, s string").coalesce(1), ["k"], ["o"], ["v"], ["s"]).orderBy("k").collect()) for r in (rows, rows[::-1])}
    assert [[tuple(r) for r in f] for f in found] == [[("x", 0.2, "a", 3), ("y", 1e300, "d", 2)]]


def test_repeated_descriptions_are_looked_at_once(spark, sf_dir, monkeypatch):
    seen, plain = [], amenities.extract
    monkeypatch.setattr(amenities, "extract", lambda t: seen.append(t) or plain(t))
    out = amenities.extracted(pd.Series(["sem piscina", None, "com piscina", "sem piscina", ""]))
    assert list(zip(out.pos, out.neg)) == [([], ["Piscina"]), ([], []), (["Piscina"], []), ([], ["Piscina"]), ([], [])]
    assert sorted(t for t in seen if t) == ["com piscina", "sem piscina"]
    assert reader_queries._described(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_values_of_blocks_and_dealt_pages(spark, sf_dir):
    df = spark.createDataFrame([('{"a":{"b":"x, y"},"c":[{"d":1},{"d":2}],"e":"[1]","f":[7,8],"g":null}',)], "j string")
    got = df.select(*(pages.value_at(F.col("j"), p).alias(p.replace(".", "_")) for p in ("a.b", "c.d", "e", "f", "g", "h.i"))).first()
    assert tuple(got) == ("x, y", "1", "1", "7", None, None)
    plan = df.select(pages.value_at(F.col("j"), "a.b.c").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$[0]") + plan.count("$.") == 7  # two reads a key and one for the end: steps don't multiply
    assert reader_queries._homes(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_month_is_collapsed_in_one_shuffle(spark):
    df = spark.createDataFrame([("a", "2026-01-02", 1, 5.0), ("a", "2026-01-01", 2, 6.0), ("a", "2026-01-02", 3, None), ("b", None, 4, None)], "k string, extraction_date string, tie int, price double")
    out = history.collapse_month(df, ["k"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.k, r.tie, r.preco_primeiro, r.preco_ultimo, r.n_dias_observado, r.preco_mudou_no_mes) for r in out.orderBy("k").collect()] == [("a", 3, 6.0, 5.0, 2, True), ("b", 4, None, None, 0, False)]


def test_a_month_shuffles_one_row_and_its_points(spark):
    some = [("a", "2026-01-02", 1, 5.0, "x"), ("a", "2026-01-01", 9, 6.0, "y"), ("a", "2026-01-03", None, None, "z"), ("a", "2026-01-02", 1, 5.0, "x"), (None, None, None, 7.0, "u"), (None, None, 3, None, None), ("b", "2026-01-01", 2, None, "v"), ("c", "2026-01-01", 4, float("nan"), "w"), ("c", "2026-01-01", 5, float("nan"), None)]
    df = spark.createDataFrame(some * 2, "k string, extraction_date string, tie int, price double, s string").withColumn("m", F.create_map(F.lit("s"), F.col("s")))  # maps have no order
    out = history.collapse_month(df, ["k"])
    assert out.columns == ["k", "extraction_date", "tie", "price", "s", "m", "preco_primeiro", "preco_ultimo", "n_dias_observado", "preco_mudou_no_mes"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by(") == 1 and "partial_min_by(" not in plan
    got = {r.k: r for r in out.collect()}
    assert {k: str(tuple(r)[1:5] + tuple(r)[6:]) for k, r in got.items()} == {
        "a": "('2026-01-03', None, None, 'z', 6.0, 5.0, 3, True)", None: "(None, 3, None, None, 7.0, 7.0, 0, False)",
        "b": "('2026-01-01', 2, None, 'v', None, None, 1, False)", "c": "('2026-01-01', 5, nan, None, nan, nan, 1, False)"}
    assert all(r.m == {"s": r.s} for r in got.values())
    equal = spark.createDataFrame([("a", "2026-01-01", 1, p, f"s{p}") for p in (None, 2.0, 1.0)], "k string, extraction_date string, tie int, price double, s string")
    assert [(r.price, r.s, r.preco_ultimo, r.preco_primeiro) for n in (1, 3) for r in history.collapse_month(equal.repartition(n, "price"), ["k"]).collect()] == [(2.0, "s2.0", 2.0, 1.0)] * 2
    assert history.collapse_month(df.where("tie > 99"), ["k"]).count() == 0


def test_sources_shuffle_no_row_beside_its_order(spark):
    rows = [("p", "2026-01", "s1", 1.0, "2026-01-02", 1), ("p", "2026-01", "s1", 2.0, "2026-01-01", 2), ("p", "2026-01", "s2", 3.0, "2026-01-02", 1), (None, None, None, None, None, None), ("q", "2026-01", None, 4.0, None, None), ("q", "2026-01", "s0", None, None, 1)]
    out = history.build_month(spark.createDataFrame(rows * 2, "property_id string, mes_referencia string, source_domain string, price double, extraction_date string, tie int"))
    assert {(r.property_id, r.source_domain, r.price, r.n_dias_observado, r.preco_primeiro) for r in out.collect()} == {("p", "s2", 3.0, 1, 3.0), (None, None, None, 0, None), ("q", "s0", None, 0, None)}
    plan = out.select("property_id", "source_domain", "price", "n_dias_observado")._jdf.queryExecution().executedPlan().toString()
    assert "max_by(" not in plan and plan.count("partial_max(") == 1


def test_ranks_and_medians_read_each_table_once_a_step(spark, monkeypatch):
    plain, whole = training.written, []
    monkeypatch.setattr(training, "written", lambda df, what: (whole.append(what) if what not in ("starts", "sizes") else None, plain(df, what))[1])
    monkeypatch.setattr(training, "RANGE", 40)
    odd = [(None, 1.0, 1), (None, None, None), (float("nan"), 2.0, 2), (float("inf"), None, 3), (0.0, 3.0, 4), (-0.0, 3.0, 4), (-0.0, -0.0, 5)]
    some = odd + [(float(i % 50), float(i * 7919 % 300), i) for i in range(300)] * 2  # each row of these comes twice
    df = spark.createDataFrame(some, "p double, y double, tie int")
    got = {r.decil: r for r in metrics.decile_calibration(df, "p", "y", "tie").collect()}
    assert whole == ["rows", "ranges", "ranges"]  # no table of ranks, no copy of the values
    df.createOrReplaceTempView("some_predictions")
    want = spark.sql("""WITH r AS (SELECT *, row_number() OVER (ORDER BY p, tie) AS r, count(*) OVER () AS n FROM some_predictions)
        SELECT cast(greatest(0, ceil(round((r - 1) * 10 / (n - 1), 9)) - 1) AS int) AS decil, count(*) AS n, percentile(p, 0.5) AS previsto, percentile(y, 0.5) AS real FROM r GROUP BY 1""").collect()
    assert {k: str(tuple(r)) for k, r in got.items()} == {r.decil: str(tuple(r)) for r in want} and len(got) == 10
    plan = training.ranked(df, ["p", "tie"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    assert metrics.decile_calibration(df.where("tie > 1000"), "p", "y", "tie").count() == 0
    v = training.percentiles(spark.sql("SELECT * FROM VALUES (1, -0.0D), (1, NULL), (NULL, 5D), (2, NULL) t(g, v)"), ["g"], "v", {"m": 0.5}).collect()
    assert [(r.g, str(r.m)) for r in v] == [(1, "0.0")]


def test_words_of_text_rules_lose_no_match(spark):
    said = """sem garagem|vagas a parte|aquisicao de vaga|vaga para moto|garagem para motocicleta|por sorteio|rotativas|coletivos|coletica|manobrista|manbrista|valet|compartilhada|insuficiente|empilhadas|demarcada|escriturado|em escritura
garagens|varanda gourmet|terraco gourmet|sacada|varandao|vista parcial|lateral para o mar|vista mar|frente ao mar|vista livre|alto padrao|fino acabamento|porcelanato|sanca de gesso|iluminacao embutida|borda infinita|piso frio|acabamento em ceramica
carpete|moveis planejados|box de vidro|laminado|precisa de reforma|potencial de modernizacao|para reformar|novo em construcao|recem entregue|novissimo|na planta|em obras|entrega prevista|sera entregue|modernizada|renovado|eletrica nova|pintura recente
bem conservado|otimo estado|impecavel|super arrumado|muito bem cuidada|nada"""
    texts = said.replace("\n", "|").split("|")
    first = lambda t, f: next((n for n, p in text_rules.RULES[f] if re.search(p, t)), "nao_menciona")
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(text_rules.level(F.col("t"), f).alias(f) for f in text_rules.RULES)).collect()
    assert [(r.t, f, r[f]) for r in out for f in text_rules.RULES] == [(t, f, first(t, f)) for t in texts for f in text_rules.RULES]
    plan = spark.createDataFrame([("x",)], "t string").select(text_rules.level(F.col("t"), "rx_vista").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") >= len(text_rules.RULES["rx_vista"])  # patterns are not tried on every text
    assert folds.prose("São  ﬁm\n á\tÉ  x ") == " ".join(["sao", "fim", "a", "e", "x"]) + " "


def test_a_counted_file_reads_its_own_rows(spark, sf_dir, monkeypatch):
    tasks, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path: (tasks.append(w._df._jdf.queryExecution().optimizedPlan().toString()), plain(w, path))[1])
    assert reader_queries.QUERIES["file_counts"](spark, sf_dir).count() == 7
    assert len(tasks) == 7 and all("Repartition 1, true" in t for t in tasks)  # a shuffle: not one task for the whole table
