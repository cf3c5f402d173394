import pytest

from casario.operators import catalogue


def test_plan_of_sources_and_targets(spark):
    sources = spark.createDataFrame([("a", "p", True, ["x"], ["venda", "locacao"]), ("b", "p", True, [], ["venda"]), ("c", "p", False, [], ["venda"])], "domain string, platform string, enabled boolean, cities array<string>, transactions array<string>")
    targets = spark.createDataFrame([("x",), ("y",)], "city string")
    out = sorted((r.domain, r.city, r.transaction) for r in catalogue.collection_plan(sources, targets).collect())
    assert out == [("a", "x", "locacao"), ("a", "x", "venda"), ("b", "x", "venda"), ("b", "y", "venda")]


def test_availability_and_nesting(spark):
    pairs = spark.createDataFrame([("s", "venda", True, None), ("s", "locacao", False, "few rows"), ("t", "venda", True, None)], "city string, target string, available boolean, why string")
    models = spark.createDataFrame([("s", "venda", "2026-01-01-a", True), ("s", "venda", "2026-01-02-a", False), ("s", "locacao", "2026-01-01-a", True)], "city string, target string, version string, complete boolean")
    out = {(r.city, r.target): (r.served, r.reason, r.version) for r in catalogue.availability(pairs, models).collect()}
    assert out == {("s", "venda"): (True, None, "2026-01-01-a"), ("s", "locacao"): (False, "few rows", "2026-01-01-a"), ("t", "venda"): (False, "no model", None)}
    one = {r.city: r for r in catalogue.nested(pairs).collect()}
    assert one["s"].n_available == 1 and set(one["s"].targets) == {"venda", "locacao"}


def test_published_yields_win(spark):
    schema = "city string, p10 double, median double, p90 double"
    out = {r.city: r.origin for r in catalogue.yields(spark.createDataFrame([("s", 0.003, 0.004, 0.005), ("t", 0.01, 0.004, 0.005)], schema), spark.createDataFrame([("s", 0.001, 0.002, 0.003), ("t", 0.001, 0.002, 0.003)], schema)).collect()}
    assert out == {"s": "published", "t": "manual"}


def test_layers_must_fit(spark):
    a, b = spark.range(3), spark.range(3).selectExpr("id", "id * 2 AS x")
    assert catalogue.joined_layers([a, b], "id").count() == 3
    with pytest.raises(ValueError):
        catalogue.joined_layers([a, b.where("id < 2")], "id")
    with pytest.raises(ValueError):
        catalogue.joined_layers([a, b.union(b)], "id")


def test_requests(spark):
    df = spark.createDataFrame([(50.0, 2, 1), (5.0, 2, 1), (50.0, 1, 2), (None, 2, None)], "area_m2 double, bedrooms int, suites int")
    out = catalogue.missing_optionals(catalogue.requests_to_rows(df, {k: v for k, v in catalogue.PHYSICAL.items() if k in df.columns}), ["area_m2", "suites"])
    assert [(r.erro, r.ausentes) for r in out.collect()] == [(None, []), ("area_m2", []), ("suites", []), (None, ["area_m2", "suites"])]
