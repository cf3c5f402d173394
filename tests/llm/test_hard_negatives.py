import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casario.llm import hard_negatives as hn


def expected(rows, anchors, n_positives=5, k=10, low=30, high=90):
    """rows: (id, label, vector of ints)."""
    out = []
    for a, la, va in rows:
        if not anchors(a):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, lab, v in rows if i != a), key=lambda s: s[:2])
        for p, pid, _ in [s for s in scored if s[2] == la][:n_positives]:
            inside = [(-s, i) for s, i, lab in scored if lab != la and low * -p <= 100 * -s <= high * -p][:k]
            out += [(a, pid, r, i, -p, s) for r, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of(rng, n, dim=8, groups=6):
    centres = [[rng.gauss(0, 60) for _ in range(dim)] for _ in range(groups)]
    out = [(i, rng.randrange(4), [int(rng.gauss(x, 12)) for x in centres[rng.randrange(groups)]]) for i in range(n)]
    hot = out[0][2]
    out += [(n + i, rng.randrange(4), hot) for i in range(n // 2)]  # one vector that a third of the rows hold
    return [*out, (n * 2, 1, [0] * dim), (n * 2 + 1, 2, [-x for x in hot])]


@pytest.fixture(scope="module")
def rows():
    return rows_of(random.Random(4), 600)


def frame(spark, rows):
    rows = [*rows]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "id long, label int, vector array<long>").withColumns({"cluster": F.lit("x"), "rank": F.lit(1), "a.b": F.lit(2)}).repartition(3)


@pytest.mark.parametrize(("size", "most", "block"), [(40, 20_000, 8192), (8192, 20_000, 7), (40, 3, 64)])
def test_against_brute_force(spark, rows, monkeypatch, size, most, block):
    monkeypatch.setattr(hn, "LIST", size)
    monkeypatch.setattr(hn, "MOST_LISTS", most)
    monkeypatch.setattr(hn, "BLOCK", block)
    assert got(hn.mine(frame(spark, rows), F.col("id") % 20 == 0)) == expected(rows, lambda i: i % 20 == 0)


def test_other_numbers_and_window(spark, rows):
    df = hn.mine(frame(spark, rows), F.col("id") % 50 == 3, n_positives=2, k=3, low=-50, high=120)
    assert got(df) == expected(rows, lambda i: i % 50 == 3, 2, 3, -50, 120)


def test_rows_that_take_no_part(spark, rows):
    odd = [(None, 1, rows[0][2]), (5000, None, rows[0][2]), (5001, 1, None), (5002, 1, [1, None, 2, 3, 4, 5, 6, 7]), (5003, 1, [1, 2]), (5004, 1, []), (5005, 1, [2**40] * 8)]
    few = rows[:90]
    assert got(hn.mine(frame(spark, [*few, *odd]), F.lit(True))) == expected(few, lambda i: True)


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.randrange(-(2**28), 2**28) for _ in range(4)]) for i in range(80)]
    assert got(hn.mine(frame(spark, rows), F.lit(True))) == expected(rows, lambda i: True)


def test_repeated_rows_and_few_rows(spark):
    rows = [(100, 0, [3, 4]), (1, 0, [3, 4]), (1, 0, [3, 4]), (2, 1, [2, 2]), (2, 1, [2, 2]), (3, 1, [9, 9]), (4, 1, [0, 0])]
    assert got(hn.mine(frame(spark, rows), F.col("id") == 100)) == [(100, 1, r, 2, 25, 14) for r in (1, 1, 2, 2)]
    assert hn.mine(frame(spark, rows), F.col("id") == 77).count() == 0
    assert hn.mine(frame(spark, rows[:1]), F.col("id") == 100).count() == 0
    assert hn.mine(frame(spark, rows).where("false"), F.col("id") == 100).count() == 0


def test_bounds_hold_and_prune(rows, tmp_path, monkeypatch):
    """A search over tight lists doesn't open those whose bounds exclude them."""
    v = np.array([r[2] for r in rows])
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
    centres = hn.kmeans(v.astype(float), 12, np.random.default_rng(1))
    at = np.argmin(((v[:, None] - centres) ** 2).sum(axis=2), axis=1)
    for c in set(at.tolist()):
        hn.write_list(hn.list_path(tmp_path, c, 0), ids[at == c], labels[at == c], v[at == c])
    lists = hn.Lists(str(tmp_path), {c: 1 for c in set(at.tolist())})
    lower, upper = lists.bounds(v[:50])
    for j in range(len(lists.paths)):
        scores = lists.scores(j, v[:50], lists.rows(j)[3])
        assert (scores.max(axis=1) <= upper[:, j]).all() and (scores.min(axis=1) >= lower[:, j]).all()
    opened, real = [], lists.rows
    monkeypatch.setattr(lists, "rows", lambda j: (opened.append(j), real(j))[1])
    hn.positives(lists, ids[:1], labels[:1], v[:1], upper[:1], 5)
    assert 0 < len(opened) < len(lists.paths)


def test_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice([*range(10), None]), [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(700)]
    rows += [(700, 1, None), (800, 2, [float("nan")] * 6), (900, 3, [float("inf")] * 6), (1000, 3, [None] * 6), (1100, 3, [0.0] * 6)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(hn.SQL).fetchall()
    assert len(want) > 100 and got(hn.op12_hard_negatives(spark, str(tmp_path))) == sorted(want)
