"""The corpus pipeline: quality rules, quality classifier, line dedup, near-duplicate removal, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of documents. The classifier is
fitted on the labelled documents of the whole table, so that it knows rejected documents although the rules before it
have removed most of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casario.llm import jaccard_join, line_dedup, packing, quality_classifier, quality_rules
from casario.llm.common import kept, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules of its language and source reject; a null or blank text has no words and goes."""
    return quality_rules.filter_quality(docs).select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what scores below the cut. Labels without a document and documents without a label do no harm; empty texts get a score too."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), quality_classifier.training_labels(table(spark, sf_dir, "labels")))
    return quality_classifier.filter_quality(docs, model).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a smaller doc_id holds; a document that loses all of them stays with an empty text. n_chars is counted anew."""
    kind = docs.schema["n_chars"].dataType
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(kind)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates; texts without words belong to none and stay."""
    return jaccard_join.drop_near_duplicates(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences. Repeated rows are packed each; an empty table gives no rows."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", pack),
]

#: No SQL expresses the classifier, the links' components or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
