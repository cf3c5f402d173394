import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casario.operators import nearest


def plain(points, known, k):
    out = {}
    for i, x, y in points:
        near = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j, t) for j, a, b, t in known if j != i)[:k]
        if near:
            out[i] = (sum(n[2] for n in near) / len(near), len(near))
    return out


def clustered(rng, n):
    """Tight clusters of several widths, a spread, points on one line, and one place that many share."""
    out = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            x, y = rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)
        elif kind == 1:
            x, y = rng.gauss(3, 0.01), rng.gauss(-2, 0.01)
        elif kind == 2:
            x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        elif kind == 3:
            x, y = 7.0, rng.randrange(40) / 8
        else:
            x, y = 1.5, 1.5
        out.append((i, x, y, float(rng.randrange(100))))
    return out


@pytest.fixture(scope="module")
def rows():
    return clustered(random.Random(12), 1200)


def got(df):
    return {r.id: (r.media, r.n) for r in df.collect()}


@pytest.mark.parametrize(("k", "bound"), [(5, 16), (15, 128)])
def test_against_all_pairs_on_clusters(spark, rows, k, bound):
    df = spark.createDataFrame(rows, "id long, x double, y double, target double").repartition(3)
    want = plain([r[:3] for r in rows], rows, k)
    out = got(nearest.nearest_mean(df, df, k, "id", bound))
    assert out.keys() == want.keys()
    assert all(out[i][1] == n and out[i][0] == pytest.approx(m) for i, (m, n) in want.items())


def test_no_cell_is_above_its_bound(spark, rows):
    df = spark.createDataFrame([(x, y) for _, x, y, _ in rows], "x double, y double").distinct().repartition(4)
    tree = nearest.partition(df, 20)
    p = np.array(sorted({(x, y) for _, x, y, _ in rows}))
    cells = tree.of(p)
    assert np.bincount(cells).max() <= 20 and tree.count[0] == len(p)
    b = tree.box[cells]
    assert ((b[:, 0] <= p[:, 0]) & (p[:, 0] <= b[:, 1]) & (b[:, 2] <= p[:, 1]) & (p[:, 1] <= b[:, 3])).all()


def test_cuts_without_a_sample_hold_the_bound(spark, rows, monkeypatch):
    monkeypatch.setattr(nearest, "SAMPLE", 5)
    df = spark.createDataFrame([(x, y) for _, x, y, _ in rows], "x double, y double").distinct()
    assert nearest.partition(df, 60).count[1:].max() <= df.count()
    assert np.bincount(nearest.partition(df, 60).of(df.toPandas().to_numpy())).max() <= 60


def test_points_elsewhere_few_known_and_odd_rows(spark, rows):
    known = spark.createDataFrame([*rows[:7], (9001, None, 1.0, 5.0), (9002, float("nan"), 1.0, 5.0)], "id long, x double, y double, target double")
    points = spark.createDataFrame([(20000, 1e6, -1e6), (20001, 0.0, 0.0), (20002, None, 1.0), (0, *rows[0][1:3])], "id long, x double, y double")
    want = plain([(20000, 1e6, -1e6), (20001, 0.0, 0.0), rows[0][:3]], rows[:7], 10)
    out = got(nearest.nearest_mean(points, known, 10, "id", 2))
    assert out.keys() == want.keys() and all(out[i][1] == n and out[i][0] == pytest.approx(m) for i, (m, n) in want.items())
    assert got(nearest.nearest_mean(points, known.where("false"), 3, "id")) == {}
    assert got(nearest.nearest_mean(points.where(F.lit(False)), known, 3, "id")) == {}
