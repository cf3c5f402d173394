import hashlib
import re

from casario.llm.line_dedup import dedup_lines

BLANK = r"[\x20\x09-\x0D]"


def expected(rows, least=2, chars=10):
    key = lambda x: re.sub(f"^{BLANK}+|{BLANK}+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    found = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                found.setdefault(key(x), set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(found.get(key(x), ())) >= least and i > min(found[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect())


def test_against_brute_force(docs, corpus):
    assert got(dedup_lines(docs)) == expected(corpus)


def test_higher_threshold_and_short_keys(docs, corpus):
    assert got(dedup_lines(docs, min_chars=3, min_docs=3)) == expected(corpus, 3, 3)


def test_lines_with_blanks_case_and_order(spark):
    rows = [(2, "A  line of text \nkept\n\n  a  LINE of text"), (1, "\ta  line OF text\r"), (3, "ÁÉÍ line of accents"), (4, "áéí line of accents"), (5, "\n\n")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out) == expected(rows)
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in out.collect()}[2] == hashlib.sha256(b"kept\n").hexdigest()


def test_other_columns_pass_and_empty_table(docs, nothing):
    out = dedup_lines(docs)
    assert out.where("doc_id = 5").first().score == "x"
    assert dedup_lines(nothing).count() == 0


def test_plan_is_native(docs):
    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_text_is_split_once_not_for_each_run(spark):
    rows = [(1, "a line of the first\nanother line of it"), (2, "a line of the first\n\n\nown line\nAnother line of it\n\n"), (3, "another line of it\na line of the first")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out) == expected(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    starts = [m.end() for m in re.finditer(r"lambdafunction\(", plan)]
    assert starts
    for at in starts:
        end, depth = at, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        assert "split(" not in plan[at:end]
    assert "posexplode(split(" not in plan  # else what stands above it hashes the text for each of its lines
