import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from casario.llm import queries
from casario.llm.common import kept

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages_keep_clean_documents_and_columns(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = kept(stage(spark, docs, big), "stage")
        assert docs.columns == COLUMNS, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[4] < sizes[3]
    left = docs.join(labels, "doc_id")
    assert left.where("quality = 0").count() == 0
    assert left.where("quality = 1").count() >= 0.9 * labels.where("quality = 1").count()
    assert docs.where("n_chars <> char_length(text)").count() == 0


def test_run_and_names(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


@pytest.fixture(scope="module")
def odd(docs):
    """The corpus with its nulls, empty and long texts, copies and repeated rows, null ids, and columns that clash with what operators add."""
    d = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    more = d.where("doc_id IN (12, 13)")
    none = d.where("doc_id = 14").withColumn("doc_id", F.lit(None).cast("long"))
    return d.unionByName(more).unionByName(none).withColumn("kept", F.lit("x")).withColumn("cls", F.lit(1)).withColumn("_text", F.lit("y"))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows_and_on_none(spark, sf_dir, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, sf_dir)
    empty = stage(spark, odd.limit(0), sf_dir)
    assert empty.count() == 0 and empty.columns == out.columns
    rows = out.collect()
    assert rows or k == 1  # nonsense words, which the classifier may reject one and all
    if k == 4:
        assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == sorted({r.doc_id for r in odd.select("doc_id").collect() if r.doc_id is not None})
        return
    assert out.columns == COLUMNS
    texts = {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    if name == "n-gram Jaccard join":
        assert len([r for r in rows if r.doc_id == 12]) == 1 and len([r for r in rows if not (r.text or "").split()]) == 3
    if name == "quality rules":
        assert all(r.text and len(r.text.split()) >= 50 for r in rows)
    if name == "line dedup":
        assert len(rows) == odd.count()
        assert all(r.n_chars == len(r.text) for r in rows)
    else:
        assert {(r.doc_id, r.text) for r in rows} <= texts
