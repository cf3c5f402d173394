"""Null ids, repeated rows and columns whose names clash with what operators add: the same results as without them."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from casario.llm import additive_ann, byte_bpe, conversation_repair, decontamination, hard_negatives, license_scan, packing

CLASHES = ("ids", "decoded", "license", "matches", "coverage", "n_words", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "text_", "_text", "vector", "codes", "query_id", "rank", "score", "found", "spans", "items", "a.b", "cluster", "key")


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def odd(spark):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(1, "One text, two texts."), (1, "One text, two texts."), (None, f"{mit} and more"), (None, None), (2, ""), (3, f"Note. {mit}"), (4, " \n"), (2, "another text of one id"), (5, "x" * 700 + " é")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def test_byte_bpe(odd):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.encode(clashing(odd), path, public_tokenizers.PATTERN)
    assert rows(out) == rows(byte_bpe.encode(odd, path, public_tokenizers.PATTERN)) and out.columns == ["doc_id", "ids", "decoded"]
    assert sorted((r.doc_id is None, r.doc_id, bytes(r.decoded).decode()) for r in out.collect() if r.doc_id is not None) == sorted((False, r.doc_id, r.text or "") for r in odd.collect() if r.doc_id is not None)
    assert byte_bpe.encode(odd.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_license_scan(odd):
    out = license_scan.scan_licenses(clashing(odd))
    assert rows(out) == rows(license_scan.scan_licenses(odd)) and [r.license for r in out.where("doc_id IS NULL").orderBy(F.desc("n_words")).collect()] == ["MIT", None]


def test_packing(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.packed(clashing(odd), path)
    own = lambda d: sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert own(out) == own(packing.packed(odd, path)) and out.count() == odd.count()
    assert out.select("sequence_id", "offset").distinct().count() == out.count()


def test_vectors(spark):
    rows_ = [(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(200)] + [(None, [1.0, 2.0, 3.0], 1), (5, [5.0, 0.0, 1.0], 2)]
    d = spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int")
    asked = F.col("id") % 50 == 0
    assert rows(additive_ann.search(clashing(d), asked)) == rows(additive_ann.search(d, asked))
    ints = d.withColumn("v", hard_negatives.quantised(F.col("embedding")))
    mined = lambda x: rows(hard_negatives.mine(x, asked, "vec_id", "label", "v"))
    assert mined(clashing(ints)) == mined(ints) and mined(ints)


def test_decontamination_and_conversations(spark, odd):
    items = spark.createDataFrame([(1, "two texts"), (2, "of one id")], "item_id long, text string")
    keep = ["doc_id", "n_words", "n_hit", "n_items", "contaminated"]
    assert rows(decontamination.mark(clashing(odd), clashing(items)).select(keep)) == rows(decontamination.mark(odd, items).select(keep))
    talk = spark.createDataFrame([(None, 0, "user", "Hi."), (1, None, None, "x"), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    assert rows(conversation_repair.repair(clashing(talk))) == rows(conversation_repair.repair(talk))
