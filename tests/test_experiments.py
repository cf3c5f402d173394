"""Experiments, final training, estimates and the model store on a small synthetic market."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from casario.operators import boosting, experiment, features, modelling
from casario.sources import models

NUMBERS = ("area_m2", "bedrooms", "condo_fee", "iptu_tax")


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(5)
    rows = []
    for i in range(700):
        place, area, rooms = rng.randrange(4), rng.randrange(30, 200), rng.randrange(1, 5)
        price = area * (6000 + 1500 * place) * rng.uniform(0.9, 1.1)
        rows.append((f"p{i}", f"g{i // 2}", "São Paulo" if i % 7 else "Sao Paulo", f"bairro {place}", "venda", "portal" if i % 3 else None, "2026-08", float(price), float(area), rooms, 1, 0, 1, 2, float(area * 8) if i % 3 else None, float(price / 300) if i % 2 else None, i % 10 == 0))
    names = "property_id string, grupo string, city string, neighborhood string, transaction_type string, source_platform string, mes_referencia string, price double, area_m2 double, bedrooms int, bathrooms int, suites int, parking_spots int, floor_level int, condo_fee double, iptu_tax double, _holdout boolean"
    return spark.createDataFrame(rows, names).cache()


@pytest.fixture(scope="module")
def arm():
    return experiment.Config("base", numbers=NUMBERS, encode=("neighborhood",), folds=2)


def test_test_rows_are_fused_and_asked_as_users_ask(market, arm):
    d = features.base_features(market.withColumn("log_price", F.ln("price")))
    train, test = experiment.prepared(d.where("NOT _holdout"), d.where("_holdout"), experiment.Config("x", numbers=NUMBERS, impute=False))
    assert test.where("condo_fee IS NOT NULL OR condo_por_m2 IS NOT NULL OR NOT aus_condo_fee").count() == 0 and train.where("condo_fee IS NOT NULL").count() > 0
    _, known = experiment.prepared(d.where("NOT _holdout"), d.where("_holdout"), arm)
    assert known.where("condo_fee IS NULL OR iptu_tax IS NULL OR te_neighborhood IS NULL").count() == 0
    assert known.where("abs(condo_por_m2 - condo_fee / area_m2) > 1e-9").count() == 0
    twins = d.where("property_id = 'p0'").unionByName(d.where("property_id = 'p0'").withColumns({"price": F.col("price") * 3, "property_id": F.lit("q")}))
    one = experiment.one_of_twins(twins, arm).collect()
    assert len(one) == 1 and one[0].price == pytest.approx(2 * twins.agg(F.min("price")).first()[0]) and one[0].n_gemeos == 2


def test_experiment_log_and_ablation(spark, market, arm, tmp_path):
    own = experiment.run(market, arm)
    rows = own.collect()
    assert sorted(r.fold for r in rows) == [0, 1] and all(0 < r.mae_log < 0.5 for r in rows)
    for name in ("base", "again"):
        experiment.logged(spark.createDataFrame(rows, own.schema), experiment.Config(name), str(tmp_path / "log"))
    assert [r.experimento for r in experiment.leaderboard(spark.read.json(str(tmp_path / "log"))).collect()] == ["base", "again"]
    out = {r.experimento: r for r in experiment.ablation(market, [arm, experiment.Config("blind", numbers=("bedrooms",), folds=2)]).collect()}
    assert out["base"].diferenca == 0 and out["blind"].diferenca > 0 and not out["blind"].promovido


def test_pair_is_trained_stored_and_serves(spark, market, arm, tmp_path):
    base, out = market.where("NOT _holdout").drop("_holdout"), market.where("_holdout").drop("_holdout")
    with pytest.raises(experiment.NotTrainable):
        experiment.train_pair(base.limit(50), out, "Sao Paulo", "venda", arm)
    with pytest.raises(experiment.NotTrainable):
        experiment.train_pair(base, out.limit(0), "Sao Paulo", "venda", arm)
    model, measures, train = experiment.train_pair(base, out, "sao paulo", "venda", arm)
    assert train.count() == base.count()  # whatever the spelling of the city
    limits = {"uso_pretendido": "estimativa", "p01": 100_000.0, "p99": 2_000_000.0}
    own = models.card(train, out, measures, city="São Paulo", target="venda", version="2026-09-30-a", scope="cidade", limits=limits, environment={}, commit="HEAD")
    assert own["identificacao"]["commit"] is None and own["dados"]["plataformas"] == ["portal"] and own["escopo"]["periodo_dos_dados"] == ["2026-08"] and own["dados"]["cobertura_por_campo"]["condo_fee"] < 1
    root = f"file://{tmp_path}/models"
    columns = [*NUMBERS, "te_neighborhood"]
    for _ in range(2):  # a second training of a pair takes the first one's place
        to = models.save(model, spark, f"{root}/{models.next_version(spark, root, '2026-09-30')}", columns, own)
        models.save(model, spark, to, columns, own)
    assert to.endswith("2026-09-30-b")
    loaded, names, _ = models.load(spark, to, columns)
    assert names == columns
    with pytest.raises(features.MissingColumns):
        models.load(spark, to, columns[::-1])
    with pytest.raises(models.InvalidCard):
        models.save(model, spark, f"{root}/x", columns, own | {"escopo": {"escopo_treino": "?"}})
    (tmp_path / "models" / "bad").mkdir()
    (tmp_path / "models" / "bad" / "model_card.json").write_text("{no json")
    assert {(r.cidade, r.n_treino) for r in models.cards(spark, f"{root}/*/model_card.json").collect()} == {("São Paulo", base.count())}
    asked = features.base_features(out.withColumn("log_price", F.ln("price")))
    _, asked = experiment.prepared(features.base_features(train), asked, arm)
    q = modelling.residual_quantiles(modelling.predicted(loaded, modelling.with_missing(asked, columns)).withColumn("y_log", F.ln("price")), "neighborhood")
    index = spark.createDataFrame([("São Paulo", 0.005, 0.004, 0.006)], "city string, yield_mensal double, yield_p10 double, yield_p90 double")
    rows = experiment.estimates(asked, loaded, arm, q, "neighborhood", (300_000.0, 900_000.0), index).collect()
    assert all(r.lo <= r.previsto <= r.hi for r in rows)
    assert all(("fora_da_faixa_treinada" in r.ressalvas) == (not 300_000 <= r.previsto <= 900_000) for r in rows)
    assert all((r.aluguel is None) == (r.city != "São Paulo") == ("sem_yield" in r.ressalvas) for r in rows)


def test_training_tables_by_month(spark, market, tmp_path):
    root = str(tmp_path / "abt")
    for month in ("2026-08", "2026-09"):
        models.write_training(market.where("NOT _holdout"), market.where("_holdout"), root, month)
    abt, out, month = models.latest_training(spark, root, "venda")
    assert (month, abt.count(), out.count()) == ("2026-09", 630, 70)
    with pytest.raises(LookupError):
        models.latest_training(spark, root, "locacao")


def test_configuration_and_yields(spark, tmp_path):
    good = {"version": 2, "sources": [{"domain": "a.com", "platform": "p", "transactions": ["venda"]}, {"domain": "b.com", "enabled": False}], "targets": [{"city": "Santos", "state": "SP"}], "compliance": {"robots": True}}
    sources, targets = models.config_tables(spark, good)
    assert [tuple(r) for r in sources.orderBy("domain").collect()] == [("a.com", "p", True, [], ["venda"]), ("b.com", None, False, [], ["venda", "locacao"])] and targets.count() == 1
    for bad in ({"version": 1}, {"sources": [{"domain": "a.com"}] * 2}, {"sources": [{"domain": "a.com", "transactions": ["troca"]}]}, {"compliance": {"robots": False}}):
        with pytest.raises(models.InvalidConfig):
            models.checked_config(good | bad)
    (tmp_path / "now.json").write_text('{"Santos": {"p10": 0.004, "median": 0.005, "p90": 0.006}}')
    (tmp_path / "pointer").write_text("now.json\n")
    assert [tuple(r) for r in models.yield_tables(spark, str(tmp_path / "pointer")).collect()] == [("Santos", 0.004, 0.005, 0.006)]


def test_form_and_column_orders(spark):
    df = spark.createDataFrame([(1, 2, "x", True, False)], "b int, a int, property_id string, amen_x boolean, amen_y boolean")
    assert features.matrix(df.withColumn("_t", F.lit(1))).columns == ["b", "a", "amen_x", "amen_y"]
    assert features.form_matrix(df, ["a", "b"]).columns == ["a", "b"] and features.ordered(df, ["a", "z"], ["b", "a"]).columns == ["a", "b"]
    with pytest.raises(features.MissingColumns):
        features.form_matrix(df, ["a", "z"])
    assert features.supported_flags(df, 1) == ["amen_x"] and features.label_column("Varanda  Gourmet & Área") == "varanda_gourmet_area"
    labels = df.select(features.label_of(F.lit("sala_ampla"), {"loja": "Loja"}).alias("a"), features.label_of(F.lit("loja"), {"loja": "Loja"}).alias("b")).first()
    assert tuple(labels) == ("sala ampla", "Loja")
    levels = features.levels(spark.createDataFrame([("a", None), ("b", "x")], "u string, v string"), ["u", "v"])
    allowed = spark.createDataFrame([("u", "b"), ("v", "z")], "campo string, nivel string")
    assert [tuple(r) for r in features.options(levels, allowed, {}).collect()] == [("u", "b", "b")]


def test_vocabulary_treatment_and_reports(spark):
    rows = [("sp", "SANTOS", "EMBARE", "Apartamento 2 dorms", ["Piscina", "piscina"]), ("S1", "guaruja", "embaré", None, None), (None, None, None, "Loja", [])]
    out = features.treated(spark.createDataFrame(rows, "state string, city string, neighborhood string, property_type string, amenities array<string>"))
    by = {r.city_raw: r for r in out.collect()}
    assert (by["SANTOS"].state, by["SANTOS"].city, by["SANTOS"].neighborhood, by["SANTOS"].property_type, by["SANTOS"].is_residencial) == ("SP", "Santos", "Embaré", "apartamento", True)
    assert (by["guaruja"].state, by["guaruja"].city, by["guaruja"].neighborhood) == (None, "Guarujá", "Embaré") and by[None].amenities == []
    counts = {r.campo: r for r in features.treatment_counts(out, ["city", "neighborhood"]).collect()}
    assert (counts["neighborhood"].antes, counts["neighborhood"].depois, counts["neighborhood"].mudou, counts["neighborhood"].novos_nulos) == (2, 1, 2, 0)
    texts = spark.createDataFrame([("x", ["A"], ["B"], [], ["A", "B"]), (" ", [], ["B"], ["C"], ["B"]), (None, None, [], [], [])], "description_clean string, amenities_fonte array<string>, amenities_texto array<string>, amenities_negadas array<string>, amenities array<string>")
    r = features.extraction_report(texts).first()
    assert (r.linhas, r.com_descricao, r.da_fonte, r.do_texto, r.negadas, r.ganharam, r.estavam_vazias, r.com_negacao) == (3, 1, 1, 2, 1, 2, 1, 1)
    assert [tuple(x) for x in features.most_common(texts, "amenities", 1).collect()] == [("B", 2)]


@pytest.fixture(scope="module")
def optional(spark):
    """A market whose fees say much of the price, and depend on rooms and place; users leave them out."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        place, area, rooms, lift = rng.randrange(6), rng.randrange(30, 200), rng.randrange(1, 5), rng.randrange(2)
        fee = (200 + 90 * rooms + 250 * lift) * (1 + 0.2 * place) * rng.uniform(0.95, 1.05)
        price = area * (4000 + 900 * place) * (1 + fee / 4000) * rng.uniform(0.97, 1.03)
        rows.append((f"p{i}", f"g{i}", "Santos", f"bairro {place}", "venda", float(price), float(area), rooms, lift, 1, 1, 2, fee if i % 3 else None, price / 300, i % 10 == 0, fee))
    names = "property_id string, grupo string, city string, neighborhood string, transaction_type string, price double, area_m2 double, bedrooms int, bathrooms int, suites int, parking_spots int, floor_level int, condo_fee double, iptu_tax double, _holdout boolean, true_fee double"
    return spark.createDataFrame(rows, names).cache()


def test_model_imputer_beats_medians(optional):
    unknown = optional.where("condo_fee IS NULL")
    error = lambda d: d.agg(F.avg(F.abs(F.ln("condo_fee") - F.ln("true_fee")))).first()[0]
    medians = error(modelling.imputed(optional, unknown, "condo_fee", ["city", "neighborhood"]))
    own = modelling.imputed_by_model(optional, unknown, ["condo_fee"], ["bedrooms", "bathrooms"], ["neighborhood"], "property_id")
    assert own.where("condo_fee IS NULL").count() == 0 and error(own) < 0.5 * medians
    few = modelling.imputed_by_model(optional.limit(20), unknown, ["condo_fee"], ["bedrooms"], [], "property_id")
    assert few.where("condo_fee IS NOT NULL").count() == 0


def test_masked_rows_lose_the_fee_with_its_traces(optional):
    d = features.base_features(optional.withColumn("log_price", F.ln("price")))
    out = experiment.masked(d, 0.4, 3)
    lost = out.where("iptu_tax IS NULL")
    assert 0.3 < lost.count() / out.count() < 0.5 and lost.where("iptu_por_m2 IS NOT NULL OR condo_fee IS NOT NULL OR NOT aus_iptu_tax").count() == 0
    assert experiment.masked(d, 0, 3) is d


def test_arms_of_dropout_imputer_and_boosting(optional, monkeypatch):
    few = functools.partial(modelling.imputed_by_model, settings=boosting.Settings(rounds=8, rate=0.5, depth=3))
    monkeypatch.setattr(modelling, "imputed_by_model", few)
    common = dict(numbers=("area_m2", "bedrooms", "bathrooms", "condo_fee", "iptu_tax"), categories=("neighborhood",), folds=2)
    arms = [experiment.Config("plain", impute=False, **common), experiment.Config("dropout", impute=False, dropout=0.5, **common), experiment.Config("model", imputer="model", **common)]
    out = {r.experimento: r.media for r in experiment.ablation(optional, arms).collect()}
    assert out["dropout"] < out["plain"] and out["model"] < out["plain"]


def test_boosted_kind_serves_with_its_own_interval(spark, optional, tmp_path):
    cfg = experiment.Config("b", kind="boosted", seeds=2, numbers=("area_m2", "bedrooms", "bathrooms"), categories=("neighborhood",), impute=False)
    d = features.base_features(optional.withColumn("log_price", F.ln("price")))
    train, test = experiment.prepared(d.where("NOT _holdout"), d.where("_holdout"), cfg)
    model = experiment.fitted(train, cfg)
    assert experiment.measured(model, test, cfg).first().mae_log < 0.15
    limits = {"uso_pretendido": "estimativa"}
    own = models.card(optional.where("NOT _holdout"), optional.where("_holdout"), experiment.measured(model, test, cfg), city="Santos", target="venda", version="v", scope="cidade", limits=limits, environment={})
    to = models.save(model, spark, f"file://{tmp_path}/boosted", list(cfg.numbers), own)
    again, _, _ = models.load(spark, to)
    assert experiment.ready(spark, again, cfg) and experiment.synthetic_case(spark, again, cfg).first().neighborhood == "bairro 0"
    rows = lambda m: sorted((r.property_id, r.lo, r.previsto, r.hi) for r in experiment.estimates(test, m, cfg, None, "city", None, None).collect())
    got = rows(again)
    assert got == rows(model) and all(lo <= p <= hi for _, lo, p, hi in got) and sum(lo < hi for _, lo, _, hi in got) > 0.9 * len(got)
