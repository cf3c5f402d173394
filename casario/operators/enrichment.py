"""The enriched table: the monthly history with what its descriptions say, as columns, after which the descriptions go.

Its boolean columns (amen_<label>, nega_<label>) are the labels that a month's rows name, so months differ in their columns; they are read
with one merged schema, in which a label that a month doesn't know is false.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amenities, folds, text_rules
from ..sources.lake import write_months

#: Labels that one table may have as columns, of each kind; more is an error, not a cut.
MOST_LABELS = 2_000
RULES = ("rx_vaga_tipo", "rx_vista")


def with_amenities(df: DataFrame, text: str = "description_clean", labels: str = "amenities") -> DataFrame:
    """df with amenities_fonte (its own labels), amenities_texto and amenities_negadas (what the text affirms and denies), and both in ``labels``.

    Repeats stay: that source and text agree is information.
    """
    own = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    df = df.withColumn("_m", amenities.mentioned(F.col(text)))
    df = df.withColumns({"amenities_fonte": own, "amenities_texto": F.col("_m.pos"), "amenities_negadas": F.col("_m.neg")}).drop("_m")
    return df.withColumn(labels, F.concat("amenities_fonte", "amenities_texto"))


def label_column(label: str) -> str:
    """'Varanda Gourmet' -> 'varanda_gourmet'."""
    return re.sub("[^a-z0-9]+", "_", folds.prose(label)).strip("_")


def _one_hot(df: DataFrame, labels: str, prefix: str) -> DataFrame:
    found = [r[0] for r in df.select(F.explode(labels).alias("label")).where("label IS NOT NULL").distinct().limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {labels}")
    columns: dict[str, list[str]] = {}
    for label in sorted(found):  # labels that are spelled alike share a column
        columns.setdefault(prefix + label_column(label), []).append(label)
    return df.withColumns({c: F.arrays_overlap(labels, F.array(*map(F.lit, same))) for c, same in columns.items()}) if columns else df


def expanded(df: DataFrame, text: str = "description_clean") -> DataFrame:
    """with_amenities' rows with a boolean column for each label affirmed and denied, em_obra and the text rules; lists and text go."""
    df = folds.folded(df, text, "prose", "_text")
    rules = text_rules.with_rules(df, "_text").withColumn("em_obra", text_rules.under_construction(F.col("_text")))
    out = _one_hot(_one_hot(rules.select(*(c for c in df.columns if c != "_text"), "em_obra", *RULES), "amenities", "amen_"), "amenities_negadas", "nega_")
    return out.drop("amenities", "amenities_fonte", "amenities_texto", "amenities_negadas", text)


def write_enriched(df: DataFrame, to: str) -> None:
    """Replaces the partitions that df has rows for, by the writer of the monthly history."""
    write_months(df, to)


def read_enriched(spark: SparkSession, root: str, month: str | None = None) -> DataFrame:
    """All months with one merged schema; a label's column that a month lacks is false there."""
    keys = {"uf", "cidade", "ano", "mes"}
    df = spark.read.option("basePath", root).option("mergeSchema", "true").parquet(root)
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in df.columns if c.startswith(("amen_", "nega_"))}
    texts = {c: F.lpad(F.col(c).cast("string"), 2, "0") if c == "mes" else F.col(c).cast("string") for c in df.columns if c in keys}
    df = df.withColumns(flags | texts)
    return df if month is None else df.where((F.col("ano") == month[:4]) & (F.col("mes") == month[5:]))


def report(df: DataFrame) -> DataFrame:
    """One row of what the extraction found, over with_amenities' rows."""
    from .features import extraction_report

    return extraction_report(df)
