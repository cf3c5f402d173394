import re

import pytest
from pyspark.sql import functions as F

from casario.llm.decontamination import hits, mark, remove_documents, remove_spans, windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (7, "Which of the three rivers named below carries the most water to the northern sea every year?"),
    (10, "Two short words"),
    (2, "Two SHORT words"),
    (3, "été"),
    (4, None),
    (5, "  ?!  "),
    (6, "rivers named below carries the most water to the northern sea"),
    (None, "nobody knows"),
]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, width=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), width)
        for at in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[at : at + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for at in range(len(w) - n + 1):
                if (g := tuple(w[at : at + n])) in grams:
                    hit |= set(range(at, at + n))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=lambda r: (r[0] is None, r))


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in df.collect()), key=lambda r: (r[0] is None, r))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def texts(corpus):
    item, out = ITEMS[0][1], [(i, t) for i, t, *_ in corpus]
    out += [(200, f"Before. {item.upper()} After,  it!"), (201, f"{item} {item}"), (202, item[:60]), (203, "x été, two\nshort words; two short"), (204, "ete nobody, knows"), (205, item.replace(" ", ", ")), (None, f"a {item}"), (206, "Été"), (200, "another text of one id")]
    return [*out, out[-9], out[-3]] + [(300 + k, f"{k} words here. " * 40 + f"\n{item}\n" + "more of them " * 9) for k in range(40)] + [(400, ("pad " * 5000 + item + " ") * 3)]


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").withColumns({"n_hit": F.lit("mine"), "hash": F.lit(1), "words": F.lit("w"), "at.b": F.lit(2)}).repartition(3)


@pytest.mark.parametrize("most", [500_000, 0])
def test_against_brute_force(table, texts, items, most):
    assert rows(mark(table, items, most=most)) == expected(texts, ITEMS)


def test_other_width_and_extra_columns(table, texts, items):
    got = mark(table, items, width=4)
    assert rows(got) == expected(texts, ITEMS, 4)
    assert {"hash", "words", "at.b"} <= set(got.columns) and got.columns.count("n_hit") == 1


def test_spans_go_and_the_rest_stays(spark, items):
    item = ITEMS[0][1]
    docs = spark.createDataFrame([(1, f"Before. {item} After, it!"), (2, "nothing here"), (3, None), (4, item), (5, f"{item} a été b {item} c"), (6, "(été)")], "doc_id long, text string")
    got = {r.doc_id: (r.text, [(s.at, s.end) for s in r.spans]) for r in remove_spans(mark(docs, items)).collect()}
    assert got[1] == ("Before.  After, it!".replace("  ", " ? ", 1), [(1, 18)])
    assert got[2] == ("nothing here", []) and got[3] == (None, [])
    assert got[4] == ("?", [(0, 17)]) and got[6] == ("()", [(0, 1)])
    assert got[5][0] == "? a  b ? c" and len(got[5][1]) == 3


def test_cleaned_texts_have_no_hits_left(table, items):
    again = mark(remove_spans(mark(table, items)).select("doc_id", "text"), items, width=10)
    assert again.where("n_hit > 0 AND doc_id >= 300").count() == 0


def test_documents_go(table, texts, items):
    marked = mark(table, items)
    clean = [r[0] for r in expected(texts, ITEMS) if not r[5]]
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in remove_documents(marked).collect()), key=key) == sorted(clean, key=key)
    half = [r[0] for r in expected(texts, ITEMS) if r[2] <= 0.5 * r[1]]
    assert sorted((r.doc_id for r in remove_documents(marked, 0.5).collect()), key=key) == sorted(half, key=key)


def test_empty_tables(table, items):
    assert mark(table.where("false"), items).count() == 0
    got = mark(table, items.where("false"))
    assert got.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0 and got.count() == table.count()


def test_plans_are_native_and_the_set_is_broadcast(table, items):
    grams = windows(items)
    plan = hits(table, grams)._jdf.queryExecution().executedPlan().toString() + mark(table, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "BroadcastHashJoin" in hits(table, grams)._jdf.queryExecution().executedPlan().toString()
