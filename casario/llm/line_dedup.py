"""Line deduplication over the whole corpus with DataFrame functions only.

Lines are exploded with their position, normalised and hashed; documents are counted per hash; a line over the
threshold is dropped from every document but the smallest doc_id that holds it; what stays is put together by
position. Only hashes, ids and positions are shuffled for the count; the texts move once, to meet their mask.

Hot lines: the count is pre-aggregated in each map task, so a line that every document holds is one row per
task; the join back is a plain equi-join, which adaptive execution splits where a hash is skewed.

Edge cases: a null or empty text is one empty line. Keys under ``min_chars`` code points never count. Equal rows of
one doc_id count as one document and get the same mask; different texts of one doc_id are one document as well.
Rows of a null doc_id are never a copy's first and lose nothing. n_lines and n_dropped replace such columns of the input; all others
pass through untouched; names with the prefix ``_ld_`` are the operator's own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with text_col without its repeated lines, plus n_lines and n_dropped (long)."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    print_ = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # Row identity that does not depend on partitioning: the id and the text's hash.
    # Both are made before the lines are exploded, or each line would hash its whole text again.
    each = docs.select(F.col(id_col).alias("_ld_id"), print_.alias("_ld_print"), lines.alias("_ld_lines"))
    each = each.select("_ld_id", "_ld_print", F.posexplode("_ld_lines").alias("_ld_pos", "_ld_line"))
    each = each.withColumn("_ld_key", line_key(F.col("_ld_line"))).where(F.char_length("_ld_key") >= min_chars)
    # Two independent 64-bit hashes: equal for different lines with a chance of 2**-128 a pair.
    each = each.select("_ld_id", "_ld_print", "_ld_pos", F.xxhash64("_ld_key").alias("_ld_h"), F.xxhash64(F.lit(7), "_ld_key").alias("_ld_g"))
    if min_docs == 2:  # at least two documents: the least and the greatest doc_id differ
        found = each.groupBy("_ld_h", "_ld_g").agg(F.min("_ld_id").alias("_ld_first"), F.max("_ld_id").alias("_ld_last")).where("_ld_first < _ld_last")
    else:
        found = each.groupBy("_ld_h", "_ld_g", "_ld_id").agg(F.lit(1).alias("_ld_one")).groupBy("_ld_h", "_ld_g").agg(F.min("_ld_id").alias("_ld_first"), F.count("*").alias("_ld_n")).where(F.col("_ld_n") >= min_docs)
    drops = each.join(found.select("_ld_h", "_ld_g", "_ld_first"), ["_ld_h", "_ld_g"]).where("_ld_id > _ld_first")
    # One row per document that loses lines: its dropped positions, ascending.
    masks = drops.groupBy("_ld_id", "_ld_print").agg(F.sort_array(F.collect_set("_ld_pos")).alias("_ld_drop"))
    out = docs.withColumns({"_ld_id": F.col(id_col), "_ld_print": print_}).join(masks, ["_ld_id", "_ld_print"], "left")
    size = F.size(lines)
    # One flag a line, true in the runs between dropped positions: linear in lines, however many are dropped. Within a lambda
    # stands nothing of the row, as the optimiser would put the split there and run it for each element.
    cuts = F.concat(F.array(F.lit(-1)), F.col("_ld_drop"))
    ends = F.concat(F.col("_ld_drop"), F.array(size))
    stays = F.flatten(F.transform(F.arrays_zip(cuts.alias("a"), ends.alias("b")), lambda z: F.concat(F.array_repeat(F.lit(True), z["b"] - z["a"] - 1), F.array(F.lit(False)))))  # one more than lines
    text = F.array_join(F.zip_with(lines, stays, lambda line, stay: F.when(stay, line)), "\n")  # nulls are left out
    return out.withColumns({
        text_col: F.when(F.col("_ld_drop").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(text),
        "n_lines": size.cast("long"),
        "n_dropped": F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long"),
    }).drop("_ld_id", "_ld_print", "_ld_drop")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
found AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, coalesce(keyed.doc_id > found.first, false) AS gone FROM keyed LEFT JOIN found USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
