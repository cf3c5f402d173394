import random
from fractions import Fraction

import numpy as np
import pytest

from casario.llm import components, jaccard_join
from casario.llm.jaccard_join import near_duplicates, shingle_sets


def brute(rows, t=Fraction(3, 4), k=5):
    sets = []
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and len(x & y) >= t * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_against_brute_force(docs, corpus):
    assert got(near_duplicates(docs)) == brute(corpus)


@pytest.mark.parametrize(("heavy", "block"), [(2, 5), (8, 2048), (64, 2048)])
def test_large_groups_of_near_copies(spark, monkeypatch, heavy, block):
    """Groups whose every shingle is heavy, links only through others, and a boilerplate in unrelated documents."""
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(5000)}"
    boiler, rows = [word() for _ in range(25)], []
    for g in range(3):
        base = [word() for _ in range(80)]
        for i in range(14):
            text = list(base)
            for _ in range(i % 4):
                text[rng.randrange(80)] = word()
            if i > 9:  # an edit that several share, and one of their own
                text[40:46] = [f"g{g}"] * 6
                text[i] = word()
            rows.append((len(rows), " ".join(text)))
    for _ in range(12):
        rows.append((len(rows), " ".join([word() for _ in range(40)] + boiler + [word() for _ in range(20)])))
    for _ in range(6):
        rows.append((len(rows), " ".join(boiler + [word() for _ in range(3)])))
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_threshold_is_exact(spark):
    """5 words shared of 7 and 6 of 8: 3 of 4 links, less doesn't."""
    a = [f"a{i}" for i in range(11)]  # 7 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1] + ["z"])), (3, " ".join(a[:-2] + ["y", "z"])), (4, " ".join(a[:10]))]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table(nothing):
    assert near_duplicates(nothing).count() == 0


def test_shingles():
    one, two, none = shingle_sets([b"A b c d e f", b"a B c", None])
    assert len(one) == 2 and len(two) == 1 and len(none) == 0
    assert np.array_equal(shingle_sets([b"a b c"])[0], two)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 5), (9, 9)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {out[i] for i in range(100, 141)} == {100} and {out[i] for i in (3, 5, 7)} == {3} and 9 not in out


def test_rows_of_one_id_and_null_ids(spark):
    """One row of each group stays: of repeated ids, of null ones, of equal rows; texts without words all stay."""
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a), (1, a), (2, a + " x"), (2, b), (None, b), (None, b), (None, "only here"), (3, ""), (3, ""), (None, None)]
    out = jaccard_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, a), (2, b), (None, "only here"), (3, ""), (3, ""), (None, None)], key=str)


def test_drop_keeps_one_of_each_group(docs, corpus):
    kept = {r.doc_id for r in jaccard_join.drop_near_duplicates(docs).collect()}
    assert kept == {i for i, _, c in brute(corpus) if i == c}
