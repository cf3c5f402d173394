"""Quality rules whose cut-offs come from the corpus: quantile sketches per language and source.

Each document gets counts (words, code points, symbols, repeated lines and 3-word windows, capitals). The ratios of the
documents that pass the base rule are sketched per (language, source) as logarithmic buckets with counts, a
quantile sketch of relative error ACCURACY that merges by adding counts: map tasks pre-aggregate, and the merged sketches
of a language and of the corpus are sums of theirs. Fences from the sketches' quartiles replace fixed cut-offs; a group's fences
are blended with its language's, and these with the corpus's, by weight: a group of n documents has n parts of its own and WEIGHT parts
of the next wider sketch, so no number of documents makes a step. A join on language and source applies them.

The quartiles of a narrow group may lie so close that a fence would cut through ordinary texts: RATIOS sets the least spread of each ratio
(with SPREADS of 4, a text needs at least 0.32 of repeated lines above its group's third quartile to go). These five numbers are parameters.

Scale: only narrow feature rows leave the map tasks. A sketch has at most some 1,500 buckets a ratio whatever the
number of documents, so no group is unbounded and a hot source is as cheap as any other.

Edge cases: null or empty text has no words and fails the base rule. Null language or source is a group of its
own. Repeated rows count as often as they occur. Ratios of a text without words are 0. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hashes, kept, mixed, table, with_columns_of_text

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_TAILS = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))

#: Relative error of a sketched quantile.
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Documents whose weight the next wider sketch has in a group's fences.
WEIGHT = 100
#: ratio: (numerator, denominator, least spread, lower fence too). A fence is a quartile plus SPREADS times the
#: distance between the quartiles (or the least spread, if that is larger).
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars", 0.01, False),
    "upper_ratio": ("n_upper", "word_chars", 0.02, False),
    "repeat_ratio": ("n_repeat_words", "n_words", 0.05, False),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 0.08, False),
    "word_length": ("word_chars", "n_words", 0.6, True),
}
SPREADS = 4.0

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


def counts(text: bytes | None) -> tuple[int, ...]:
    """The counts of FEATURES for one UTF-8 text."""
    text = text or b""
    words = text.split()
    n = len(words)
    repeated = 0
    if n > 3:
        h = hashes(words)
        w = mixed(h[:-2] + mixed(h[1:-1] + mixed(h[2:])))
        _, back, times = np.unique(w, return_inverse=True, return_counts=True)
        if (twice := times[back] > 1).any():
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[k : n - 2 + k] |= twice
            repeated = int(hit.sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    inside = text.translate(None, _SPACES)
    return n, len(inside.translate(None, _TAILS)), len(inside) - len(inside.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(inside) - len(inside.translate(None, _UPPER)), len(lines)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with FEATURES of each row (columns of these names are replaced)."""
    def make(texts):
        found = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(FEATURES))
        return [pa.array(found[:, i]) for i in range(len(FEATURES))]

    return with_columns_of_text(docs.drop(*FEATURES), text_col, [T.StructField(c, T.LongType()) for c in FEATURES], make)


def with_ratios(f: DataFrame) -> DataFrame:
    f = f.withColumns({r: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0)) for r, (n, d, _, _) in RATIOS.items()})
    return f.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _bucket(x: Column) -> Column:
    """Bucket of a value of 0 or more; -100000 holds 0."""
    return F.when(x > 0, F.ceil(F.ln(x) / F.lit(math.log(GAMMA)))).otherwise(F.lit(-100000)).cast("int")


def sketches(f: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: the merged sketches of every group, language (source null, level 1) and the corpus (level 0)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), _bucket(F.col(r)).alias("bucket")) for r in RATIOS)))
    own = f.where(~F.col("base_failed")).select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.ratio", "p.bucket").agg(F.count("*").alias("n"))
    own = own.select("lang", "source", "ratio", "bucket", "n")
    by_lang = own.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return (own.withColumn("level", F.lit(2))
            .unionByName(by_lang.withColumns({"source": none, "level": F.lit(1)}))
            .unionByName(whole.withColumns({"lang": none, "source": none, "level": F.lit(0)})))


def quartiles(sk: DataFrame) -> DataFrame:
    """level, lang, source, ratio, total, q1, q3 of each sketch."""
    by = W.partitionBy("level", "lang", "source", "ratio")
    value = F.when(F.col("bucket") == -100000, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) * F.lit(2 / (GAMMA + 1)))
    run = sk.withColumns({"total": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy("bucket")), "value": value})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("value")))
    return run.groupBy("level", "lang", "source", "ratio").agg(F.max("total").alias("total"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def thresholds(f: DataFrame) -> DataFrame:
    """lang, source and the fences <ratio>_lo and <ratio>_hi of every group that has documents."""
    q = quartiles(sketches(f))
    least = F.coalesce(*(F.when(F.col("ratio") == r, F.lit(s)) for r, (_, _, s, _) in RATIOS.items()))
    two = F.col("ratio").isin(*(r for r, x in RATIOS.items() if x[3]))
    spread = F.greatest(F.col("q3") - F.col("q1"), least) * SPREADS
    q = q.withColumns({"hi": F.col("q3") + spread, "lo": F.when(two, F.col("q1") - spread).otherwise(F.lit(-1.0))})
    aggs = [F.max(F.when(F.col("ratio") == r, F.col(c))).alias(f"{r}_{c}") for r in RATIOS for c in ("lo", "hi")]
    wide = q.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *aggs)
    names = [f"{r}_{c}" for r in RATIOS for c in ("lo", "hi")]
    level = lambda n, p: wide.where(F.col("level") == n).select(
        *(F.col(c).alias(f"{p}_{c}") for c in (["lang", "source"] if n == 2 else ["lang"] if n == 1 else []) + ["total"] + names))
    groups = f.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    own, lang, whole = level(2, "o"), level(1, "l"), level(0, "w")
    out = groups.join(own, groups["lang"].eqNullSafe(own["o_lang"]) & groups["source"].eqNullSafe(own["o_source"]), "left")
    out = out.join(lang, out["lang"].eqNullSafe(lang["l_lang"]), "left").join(F.broadcast(whole), F.lit(True), "left")  # whole: one row
    blend = lambda p, c, wider: F.coalesce((F.col(f"{p}_total") * F.col(f"{p}_{c}") + WEIGHT * wider) / (F.col(f"{p}_total") + WEIGHT), wider)
    return out.select("lang", "source", *(blend("o", c, blend("l", c, F.col(f"w_{c}"))).alias(c) for c in names))


def judge(f: DataFrame, limits: DataFrame) -> DataFrame:
    """f (with ratios) with kept: base rule passed and every ratio within its group's fences."""
    t = limits.withColumnsRenamed({"lang": "_t_lang", "source": "_t_source"})
    ok = ~F.col("base_failed")
    for r in RATIOS:
        ok = ok & F.coalesce((F.col(r) <= F.col(f"{r}_hi")) & (F.col(r) >= F.col(f"{r}_lo")), F.lit(True))
    out = f.join(t, f["lang"].eqNullSafe(t["_t_lang"]) & f["source"].eqNullSafe(t["_t_source"]), "left")
    return out.withColumn("kept", ok).drop("_t_lang", "_t_source", *(f"{r}_{c}" for r in RATIOS for c in ("lo", "hi")))


def rules(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of docs (doc_id, lang, source, text) without their text, and the limits, both written."""
    f = kept(with_ratios(features(docs.select("doc_id", "lang", "source", "text")).drop("text")), "quality-features")
    return f, kept(thresholds(f), "quality-limits")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns.

    Rows are written once with their features; limits come from the narrow columns, and few rows of limits meet the
    written rows, so no text is counted twice or shuffled.
    """
    names = [f"_d{i}" for i in range(len(docs.columns))]  # docs may have columns with the names of features
    text = names[docs.columns.index("text")]
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), "lang", "source")
    f = kept(with_ratios(features(own, text)), "quality-rows")
    limits = kept(thresholds(f.drop(*names)), "quality-limits")
    return judge(f, limits).where("kept").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(*rules(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source", "n_upper", "n_lines")


def _sql() -> str:
    """The same in DuckDB, from the same parameters."""
    values = ", ".join(f"{n} / nullif({d}, 0)::DOUBLE AS {r}" for r, (n, d, _, _) in RATIOS.items())
    zero = ", ".join(f"coalesce({r}, 0.0) AS {r}" for r in RATIOS)
    each = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {r} AS x FROM good" for r in RATIOS)
    least = "CASE ratio " + " ".join(f"WHEN '{r}' THEN {s}" for r, (_, _, s, _) in RATIOS.items()) + " END"
    two = ", ".join(f"'{r}'" for r, x in RATIOS.items() if x[3])
    wide = ", ".join(f"max(CASE WHEN ratio = '{r}' THEN lo END) AS {r}_lo, max(CASE WHEN ratio = '{r}' THEN hi END) AS {r}_hi" for r in RATIOS)
    def blended(c: str) -> str:
        lang = f"coalesce((l.total * l.{c} + {WEIGHT} * w.{c}) / (l.total + {WEIGHT}), w.{c})"
        return f"coalesce((o.total * o.{c} + {WEIGHT} * {lang}) / (o.total + {WEIGHT}), {lang})"

    ok = " AND ".join(f"coalesce({r} BETWEEN {blended(f'{r}_lo')} AND {blended(f'{r}_hi')}, true)" for r in RATIOS)
    return rf"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS lines FROM lines GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, coalesce(dup.lines, 0)::BIGINT AS n_lines FROM texts JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id)),
r AS (SELECT * EXCLUDE ({", ".join(RATIOS)}), {zero} FROM (SELECT *, {values}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)),
good AS (SELECT * FROM r WHERE NOT base_failed),
b AS (SELECT lang, source, ratio, CASE WHEN x > 0 THEN ceil(ln(x) / {math.log(GAMMA)!r}) ELSE -100000 END::INT AS bucket, count(*) AS n FROM ({each}) GROUP BY ALL),
levels AS (SELECT 2 AS level, lang, source, ratio, bucket, n FROM b UNION ALL SELECT 1, lang, NULL, ratio, bucket, sum(n) FROM b GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, ratio, bucket, sum(n) FROM b GROUP BY ALL),
runs AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS upto,
  CASE WHEN bucket = -100000 THEN 0.0 ELSE pow({GAMMA!r}, bucket) * {2 / (GAMMA + 1)!r} END AS v FROM levels),
q AS (SELECT level, lang, source, ratio, max(total) AS total, min(CASE WHEN upto >= ceil(0.25 * total) THEN v END) AS q1, min(CASE WHEN upto >= ceil(0.75 * total) THEN v END) AS q3 FROM runs GROUP BY ALL),
fence AS (SELECT level, lang, source, ratio, total, q3 + greatest(q3 - q1, {least}) * {SPREADS} AS hi, CASE WHEN ratio IN ({two}) THEN q1 - greatest(q3 - q1, {least}) * {SPREADS} ELSE -1.0 END AS lo FROM q),
wide AS (SELECT level, lang, source, max(total) AS total, {wide} FROM fence GROUP BY level, lang, source)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {ok} AS kept, r.lang, r.source, n_upper, n_lines
FROM r LEFT JOIN wide o ON o.level = 2 AND o.lang IS NOT DISTINCT FROM r.lang AND o.source IS NOT DISTINCT FROM r.source
LEFT JOIN wide l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM r.lang LEFT JOIN wide w ON w.level = 0
"""


SQL = _sql()
