import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from casario.llm import conversation_repair as cr

GRAMMAR = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every sequence of edits with at most two inserts at a place, tried."""
    return tried(tuple(rows))


@functools.cache
def tried(rows):
    best = None
    marks = faults(rows)
    edits = [["D"] if m in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for m in marks]
    places = [[()] + [tuple(x) for k in (1, 2) for x in itertools.product(("Iu", "Ia"), repeat=k)]] * (len(rows) + 1)
    for chosen in itertools.product(*edits):
        for added in itertools.product(*places):
            steps = [*added[0]]
            for e, more in zip(chosen, added[1:], strict=True):
                steps += [e, *more]
            cost, audit, out, i = 0, "", [], 0
            for s in steps:
                audit += s[0]
                if s[0] == "I":
                    cost += 2
                    out.append(("user" if s[1] == "u" else "assistant", ""))
                    continue
                _, role, text = rows[i]
                cost += {"K": 0, "R": 2, "D": 3}[s[0]] + (s[0] != "D" and marks[i] == "truncated")
                if s[0] != "D":
                    out.append((role if s[0] == "K" else "user" if s[1] == "u" else "assistant", text))
                i += 1
            if (best is None or (cost, audit) < best[:2]) and GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = (cost, audit, out)
    return best


def expected(conv, rows, solve=cheapest):
    """rows: (turn, role, text) in any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    marks = faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, out = solve(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    body = "\n".join(f"{r}:{x}" for r, x in out)
    return (conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest()), out


def made(rng, n):
    return [(rng.choice([None, *range(6), -3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None]), rng.choice(["Yes.", "No!", "cut off", "", None, " \t", "ends? \n", "é…", "a. b"])) for _ in range(n)]


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    out = {i: made(rng, rng.choice([1, 2, 2, 3, 3])) for i in range(150)}
    out[None] = [(0, "assistant", "Hello."), (2, "user", "Hi.")]
    out[150] = [(i, r, x) for i, (r, x) in enumerate([("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello."), ("user", "Bye")])]
    return out


def table(spark, conversations):
    rows = [(c, t, r, x) for c, rows in conversations.items() for t, r, x in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"cost": F.lit("x"), "present": F.lit(1), "copy": F.lit(2), "a.b": F.lit(3)}).repartition(3)


def test_against_every_sequence_of_edits(spark, conversations):
    got = {r[0]: tuple(r) for r in cr.repair(table(spark, conversations)).collect()}
    assert got == {c: expected(c, rows)[0] for c, rows in conversations.items()}


def test_repaired_turns_have_the_digest(spark, conversations):
    df = table(spark, conversations)
    turns = {}
    for r in sorted(cr.repaired_turns(df).collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for c, rows in conversations.items():
        assert turns.get(c, []) == expected(c, rows)[1]


def in_order(rows):
    """Best paths row by row: no priority queue."""
    marks, paths = faults(rows), {0: (0, "", [])}
    after = lambda s: 3 if s == 2 else 2
    name = {2: "user", 3: "assistant"}

    def inserted(paths):
        for _ in range(2):
            for s, (cost, audit, out) in list(paths.items()):
                to = after(s)
                paths[to] = min(paths.get(to, (10**9, "", [])), (cost + 2, audit + "I", [*out, (name[to], "")]))
        return paths

    for (_, role, text), m in zip(rows, marks, strict=True):
        new = {}
        for s, (cost, audit, out) in inserted(paths).items():
            ways = [(s, (cost + 3, audit + "D", out))]
            if m not in ("blank", "duplicate"):
                more = m == "truncated"
                ways.append((after(s), (cost + 2 + more, audit + "R", [*out, (name[after(s)], text)])))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, role[:1]))
                if to:
                    ways.append((to, (cost + more, audit + "K", [*out, (role, text)])))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        paths = new
    return min(p for s, p in inserted(paths).items() if s in (0, 3))


@pytest.mark.parametrize("chunk", [1, 2, 7, 256])
def test_long_conversations_in_chunks(conversations, monkeypatch, chunk):
    monkeypatch.setattr(cr, "CHUNK", chunk)
    rng = random.Random(chunk)
    for c in range(12):
        rows = [(i, r, x if rng.random() < 0.3 or not x else f"{x[:-1]}{i}{x[-1]}") for i, (_, r, x) in enumerate((t, r or " ", x or " ") for t, r, x in made(rng, 300))]
        want, _ = expected(c, rows, in_order)
        it = cr.Conversation(c)
        for (t, r, x), m in zip(rows, faults(rows), strict=True):
            it.add(t, r.encode(), x.encode(), r[:1], ["", "blank", "duplicate", "truncated"].index(m))
        assert it.result() == want


def test_brute_force_agrees_with_rows_in_order(conversations):
    for rows in conversations.values():
        rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
        assert cheapest(rows) == in_order(rows)


def test_long_one_in_spark(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["user", "assistant"]), f"Turn {i % 900}" + rng.choice(".!x")) for i in range(3000)]
    (got,) = cr.repair(table(spark, {5: rows})).collect()
    assert tuple(got) == expected(5, rows, in_order)[0]


def damage(rows):
    out = {}
    for c, t, r, x in rows:
        got = out.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (t, "user" if d == 4 else r, "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x)
        got += [] if d == 0 else [row, row] if d == 3 else [row]
    return out


def test_query_with_damage(spark, tmp_path, conversations):
    rows = [(c, t, r, x) for c, rows in conversations.items() for t, r, x in rows]
    rows += [(c, t, ["user", "assistant"][t % 2], f"Turn {t} of {c}.") for c in range(1000, 1300) for t in range(3)]
    rows += [(2000 + c, None, "user", "Alone.") for c in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r) for r in cr.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: expected(c, rows, in_order)[0] for c, rows in damage(rows).items()}
    assert any(not r[7] for r in got.values())


def test_query_equals_its_sql_with_odd_rows(spark, tmp_path, conversations):
    import duckdb

    rows = [(c, t, r, x) for c, rows in conversations.items() for t, r, x in rows]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in cr.op13_conversation_repair(spark, str(tmp_path)).collect()), key=key) == sorted(con.sql(cr.SQL).fetchall(), key=key)


def test_empty_table_and_one_shuffle(spark, conversations):
    df = table(spark, conversations)
    assert cr.repair(df.where("false")).count() == 0 and cr.repaired_turns(df.where("false")).count() == 0
    plan = cr.repair(df.drop("a.b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Exchange hashpartitioning").__len__() == 2
