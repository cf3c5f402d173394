import random

import pytest

#: Texts with the hard cases: null, empty, blanks, ties, repeats, one very long one.
WORDS = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge") for b in ("ra", "so", "ti", "lu", "né")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) with copies, near copies, shared lines and edge cases; doc 7 comes twice."""
    rng = random.Random(3)
    line = "This line is shared by many documents of the corpus."
    rows = [(0, None, "en", "a"), (1, "", None, "a"), (2, " \n\t ", "en", None), (3, "one two", "en", "a"), (4, "ONE two", "en", "a")]
    for i in range(5, 60):
        text = prose(rng, rng.randrange(30, 120))
        if i % 4 == 0:
            text = f"{text}\n{line}\n{prose(rng, 20)}"
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 2}"))
    rows.append(rows[7])
    base = rows[10][1]
    for i in range(60, 70):  # copies and near copies of one document
        words = base.split(" ")
        if i > 63:
            words[i % len(words)] = "changed"
        rows.append((i, " ".join(words), "en", "s0"))
    rows.append((70, "long " * 3000 + prose(rng, 4000), "en", "s1"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with a column whose name clashes with what operators add."""
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "cast(length(text) as long) AS n_chars", "'x' AS score", "'y' AS n_lines", "1 AS tokens").repartition(3, "doc_id")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < 0")
