import numpy as np
import pytest
from pyspark.sql import functions as F

from casario.operators import boosting as b

FAST = b.Settings(rounds=24, rate=0.25, depth=3, least=15, patience=8, refresh=9)


@pytest.fixture(scope="module")
def frame(spark):
    """y depends on a number, on whether it is known, and on a category whose levels' order says nothing; noise grows with x."""
    rng = np.random.default_rng(3)
    rows, effect = [], {f"b{i}": float(rng.normal()) for i in range(40)}
    for i in range(4000):
        x, level = float(rng.uniform(0, 10)), f"b{rng.integers(40)}"
        known = rng.random() > 0.2
        y = 0.3 * x + effect[level] + (0 if known else 1.0) + rng.normal() * (0.1 + 0.08 * x)
        rows.append((i, x if known else None, float(rng.normal()), level if i % 50 else None, y, 0.3 * x))
    return spark.createDataFrame(rows, "id long, x double, noise double, bairro string, y double, hint double").repartition(3).cache()


@pytest.fixture(scope="module")
def model(frame):
    members = [*b.seeds("central", 3), b.Member("q10", b.QUANTILE, 0.1), b.Member("q90", b.QUANTILE, 0.9)]
    return b.fit(frame.where("id % 4 <> 0"), "y", ["x", "noise"], ["bairro"], members, ["id"], FAST)


def test_quantiles_cover_and_widen(model, frame):
    rows = b.predicted(model, frame.where("id % 4 = 0 AND x IS NOT NULL"))
    share = rows.agg(F.avg((F.col("y") <= F.col("q10")).cast("double")).alias("lo"), F.avg((F.col("y") <= F.col("q90")).cast("double")).alias("hi")).first()
    assert 0.05 < share.lo < 0.17 and 0.83 < share.hi < 0.95
    width = {r.wide: r.w for r in rows.groupBy((F.col("x") > 5).alias("wide")).agg(F.avg(F.col("q90") - F.col("q10")).alias("w")).collect()}
    assert width[True] > 1.3 * width[False]


def test_split_conformal_is_not_narrower_where_noise_is_small(model, frame):
    """One residual quantile for all rows can't follow the noise; its interval is too wide where the noise is small."""
    rows = b.predicted(model, frame.where("id % 4 = 0 AND x IS NOT NULL"))
    r = F.col("y") - F.col("central")
    lo, hi = rows.agg(F.percentile(r, 0.1), F.percentile(r, 0.9)).first()
    small = rows.where("x < 3").agg(F.avg(F.col("q90") - F.col("q10"))).first()[0]
    assert small < hi - lo


def test_categories_are_split_without_order(model, frame):
    rmse = b.predicted(model, frame.where("id % 4 = 0")).agg(F.sqrt(F.avg((F.col("y") - F.col("central")) ** 2)).alias("e"), F.stddev("y").alias("s")).first()
    assert rmse.e < 0.65 * rmse.s


def test_mean_of_seeds_is_no_worse_than_one(model, frame):
    test = frame.where("id % 4 = 0").toPandas()
    raw = model.raw(model.bins.of([test["x"], test["noise"], test["bairro"]]))
    error = lambda p: float(np.sqrt(((test["y"].to_numpy() - p) ** 2).mean()))
    single = [error(raw[:, i]) for i in range(3)]
    assert error(raw[:, :3].mean(axis=1)) <= np.mean(single) and len({round(e, 9) for e in single}) == 3


def test_reload_gives_equal_codes_and_predictions(model, frame, spark, tmp_path):
    b.save(model, spark, f"{tmp_path}/m")
    again = b.load(spark, f"{tmp_path}/m")
    rows = frame.limit(200).unionByName(frame.limit(1).withColumn("bairro", F.lit("never seen")))
    values = lambda m: sorted(tuple(r) for r in b.predicted(m, rows).select("id", "central", "q10", "q90").collect())
    assert values(again) == values(model)
    assert again.bins.of([rows.toPandas()[c] for c in ("x", "noise", "bairro")]).tolist() == model.bins.of([rows.toPandas()[c] for c in ("x", "noise", "bairro")]).tolist()
    assert model.bins.of([rows.toPandas()[c] for c in ("x", "noise", "bairro")])[-1, 2] == 0


def test_equal_on_every_run_and_partitioning(frame):
    few = b.Settings(rounds=3, depth=2, refresh=2)
    fit = lambda d: b.fit(d, "y", ["x"], ["bairro"], [b.Member("p"), b.Member("m", b.QUANTILE, 0.5)], ["id"], few)
    one, two = fit(frame.limit(800).coalesce(1)), fit(frame.limit(800).repartition(5))
    assert [t.feature.tolist() for ts in one.trees for t in ts] == [t.feature.tolist() for ts in two.trees for t in ts]


def test_odd_tables(spark):
    rows = [(i, None if i % 2 else float("nan"), None, float(i % 3)) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, x double, c string, y double")
    few = b.Settings(rounds=2, depth=2)
    m = b.fit(d, "y", ["x"], ["c"], [b.Member("p")], ["id"], few)
    assert abs(b.predicted(m, d).first().p - 1.0) < 0.2
    m = b.fit(d, "y", [], [], [b.Member("p")], ["id"], few)
    assert b.predicted(m, d).first().p == pytest.approx(1.0)
    with pytest.raises(ValueError):
        b.fit(d.withColumn("y", F.lit(None).cast("double")), "y", ["x"], [], [b.Member("p")], ["id"], few)


def test_rows_of_equal_bins_are_one_run(frame, monkeypatch):
    """A fit reads its rows once, and its rounds read blocks in which trees are applied once to rows of equal bins."""
    tables, real = {}, b.written
    monkeypatch.setattr(b, "written", lambda d, what: tables.setdefault(what, []).append(real(d, what)) or tables[what][-1])
    rows = frame.select("id", "y", F.floor(F.col("x") / 2).alias("x"))
    whole, few = ([t.value.tolist() for ts in b.fit(rows, "y", ["x"], [], [b.Member("p"), b.Member("m", b.QUANTILE, 0.5)], ["id"], b.Settings(rounds=5, depth=2, refresh=r)).trees for t in ts] for r in (9, 2))
    assert [len(v) for v in tables.values()] == [2, 4]  # the second fit's predictions were written twice
    assert np.allclose(whole, few)
    for t in tables["boosting"]:
        blocks = t.collect()
        sizes = [np.frombuffer(r.n, np.int64) for r in blocks]
        assert sum(int(n.sum()) for n in sizes) == sum(len(r.y) // 8 for r in blocks) == rows.count()
        assert sum(map(len, sizes)) <= 6 + len(blocks)
