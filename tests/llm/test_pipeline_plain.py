"""The stages one after another against plain versions of them, over a whole table."""

import math
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from test_line_dedup import expected as without_repeated_lines

from casario.llm import quality_classifier, quality_rules
from casario.llm.common import kept



def plain_score(text, vectors, net):
    """One text's score, token by token and unit by unit."""
    found = [int(h) for h in quality_classifier.tokens((text or "").encode())]
    distinct = np.array(sorted(set(found)), np.uint64)
    values, has = vectors.of(distinct)
    of = {int(h): (values[i].astype(float), bool(has[i])) for i, h in enumerate(distinct)}
    x = [0.0] * quality_classifier.INPUTS
    if n := len(found):
        for d in range(quality_classifier.DIM):
            column = [of[h][0][d] for h in found]
            mean = sum(column) / n
            x[d] = mean
            x[quality_classifier.DIM + d] = math.sqrt(max(sum(v * v for v in column) / n - mean * mean, 0))
        x[-2] = sum(of[h][1] for h in found) / n
    x[-1] = math.log1p(n) / 10
    if "share" in net:
        return net["share"]
    z = [(a - m) / s for a, m, s in zip(x, net["mean"], net["sd"], strict=True)]
    w, b, out, bias = net["p"]
    hidden = [math.tanh(sum(a * w[i, j] for i, a in enumerate(z)) + b[j]) for j in range(len(b))]
    return 1 / (1 + math.exp(-(sum(a * o for a, o in zip(hidden, out, strict=True)) + bias[0]) / net["t"]))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """Sets of positions of rows that are near duplicates of each other, by all pairs."""
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(top(i), []).append(i)
    return list(out.values())


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = kept(stage(spark, docs, sf_dir), "stage")
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_rules_by_sql(stages, sf_dir):
    _, before, after = stages[0]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert len(before) > len(after) > 0
    assert ids(after) == sorted(r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept").fetchall())


def test_classifier_score_by_score(stages, spark, sf_dir):
    _, before, after = stages[1]
    table, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    vectors, net = quality_classifier.train(table, quality_classifier.training_labels(labels))
    scores = {r.doc_id: plain_score(r.text, vectors, net) for r in before}
    assert ids(after) == sorted(i for i, s in scores.items() if s >= quality_classifier.CUT)
    got = {r.doc_id: r.score for r in quality_classifier.with_scores(table, (vectors, net)).collect()}
    assert all(got[i] == pytest.approx(s, abs=1e-4) for i, s in scores.items())


def test_lines_one_by_one(stages):
    _, before, after = stages[2]
    assert sorted((r.doc_id, r.text) for r in after) == [(i, text) for i, _, _, text in without_repeated_lines([(r.doc_id, r.text) for r in before])]


def test_one_of_each_group_stays(stages):
    _, before, after = stages[3]
    kept_ids = set(ids(after))
    assert len(kept_ids) == len(after) and {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    assert all(sum(before[i].doc_id in kept_ids for i in g) == 1 for g in groups(before))


def test_pieces_are_the_librarys_and_fit(stages):
    _, before, after = stages[4]
    coder, found = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in before:
        own = [*coder.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(own), 2048)):
            part = own[at : at + 2048]
            found.append((r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == sorted(found)
    filled = {}
    for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= math.ceil(sum(n for *_, n, _ in found) / 2048) * 1.25
