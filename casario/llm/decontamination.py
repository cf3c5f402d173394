"""Benchmark decontamination with DataFrame functions only: no Python, pandas or Arrow in any task.

The benchmark's items become a set of normalised n-grams of WIDTH words, broadcast by the hash of their words. Training
texts are scanned window by window: words are hashed once, a window's hash is made of its words' hashes, and every
window meets the broadcast set in the task that holds the text. A hit by hash is verified there and then by comparing the
words themselves. Verified hits are spans of words; what to do with them is the caller's choice: ``remove_spans`` takes
the words out of the texts, ``remove_documents`` takes the documents out.

Scale: the scan is one narrow stage; only hits are shuffled, by document. The set is broadcast while it has at most
``most`` windows, which are counted first; beyond that the windows' hashes are joined by shuffle (a hash that every
document holds is split by adaptive execution) and the found places are verified against the texts. A document's spans
are gathered in one row, as its text is. Hits are written to the shared folder once.

Words are runs of ASCII digits, ASCII letters (A-Z lower-cased) and all that is not ASCII. An item of fewer words than
the width, but not none, is one window of its length.

Edge cases: null and empty texts have no words and no hits; so has an item of null text. Equal rows of a document get the same
result each; different texts under one id are documents of their own, and a null id is an id. Windows of an item whose id is null
hit words, but no item is listed for them. Items of one id are one item. An empty benchmark hits nothing; an empty table gives
no rows. Added columns (n_words, n_hit, n_items, items, contaminated, spans) replace such columns of the input; all others
pass through, and names with the prefix ``_dc_`` are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, table
from .line_dedup import LOWER, UPPER

WIDTH = 10
#: Windows that are broadcast at most: some 150 bytes each.
MOST = 500_000
#: What stands between words, before and after lower-casing; words in texts as they are.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def window_hashes(of: Column, n: int) -> Column:
    """The hashes of all windows of n words, by position; too short texts have none."""
    hashed = F.transform(of, lambda w: F.xxhash64(w))
    # An array of one element binds the words' hashes to a name, so that they are made once a text.
    made = F.transform(F.array(hashed), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))
    return F.when(F.size(of) >= n, made[0])


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(_dc_n, _dc_hash, _dc_words, _dc_item): the items' windows, each of n words; a short item is one."""
    items = benchmark.select(F.col(id_col).cast("string").alias("_dc_item"), words(F.col(text_col)).alias("_dc_of")).withColumn("_dc_n", F.least(F.size("_dc_of"), F.lit(width))).where("_dc_n > 0")
    parts = F.transform(F.sequence(F.lit(1), F.size("_dc_of") - F.col("_dc_n") + 1), lambda i: F.slice(F.col("_dc_of"), i, F.col("_dc_n")))
    each = items.select("_dc_item", "_dc_n", F.explode(parts).alias("_dc_words")).distinct()
    whole = F.coalesce(*[F.when(F.col("_dc_n") == n, window_hashes(F.col("_dc_words"), n)[0]) for n in range(1, width + 1)])
    return each.select("_dc_n", whole.alias("_dc_hash"), "_dc_words", "_dc_item")


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_dc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_dc_print"), words(F.col(text_col)).alias("_dc_of"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}._dc_id").eqNullSafe(F.col(f"{b}._dc_id")) & (F.col(f"{a}._dc_print") == F.col(f"{b}._dc_print"))


def hits(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(_dc_id, _dc_print, _dc_at, _dc_n, _dc_words): every place (from 0) where a text has the words of a window; equal rows of a document give theirs each."""
    distinct = grams.select("_dc_n", "_dc_hash", "_dc_words").distinct()
    sizes = {r["_dc_n"]: r["k"] for r in distinct.groupBy("_dc_n").agg(F.count("*").alias("k")).collect()}  # a row for each length
    scan, small, out = _scan(docs, id_col, text_col), sum(sizes.values()) <= most, None
    for n in sorted(sizes):
        mine = distinct.where(F.col("_dc_n") == n).select("_dc_hash", "_dc_words")
        of = F.col("_dc_of")
        each = scan.select("_dc_id", "_dc_print", "_dc_of", F.posexplode(window_hashes(of, n)).alias("_dc_at", "_dc_hash"))
        found = F.slice(of, F.col("_dc_at") + 1, n)
        if small:
            part = each.join(F.broadcast(mine), "_dc_hash").where(found == F.col("_dc_words"))
        else:
            # Hashes alone are shuffled; the texts of what they find are read again and compared.
            guess = each.drop("_dc_of").join(mine.select("_dc_hash").distinct(), "_dc_hash", "left_semi")
            part = guess.alias("g").join(scan.alias("s"), _same("g", "s")).select("g._dc_id", "g._dc_print", "_dc_of", "_dc_at", "_dc_hash")
            part = part.join(mine, "_dc_hash").where(found == F.col("_dc_words"))
        part = part.select("_dc_id", "_dc_print", F.col("_dc_at").cast("int").alias("_dc_at"), F.lit(n).alias("_dc_n"), "_dc_words")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return scan.select("_dc_id", "_dc_print", F.lit(0).alias("_dc_at"), F.lit(0).alias("_dc_n"), "_dc_of").withColumnRenamed("_dc_of", "_dc_words").where(F.lit(False))
    return out


def merged(places: Column) -> Column:
    """Places (at, n) as an array of disjoint spans (at, end), in order; touching ones become one. Linear in the covered words."""
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p["at"], p["at"] + p["n"] - 1)))))

    def spans(c):
        starts = F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1) != x - 1))
        ends = F.filter(c, lambda x, i: (i == F.size(c) - 1) | (F.get(c, i + 1) != x + 1))
        return F.zip_with(starts, ends, lambda a, e: F.struct(a.alias("at"), (e + 1).alias("end")))

    return F.transform(F.array(covered), spans)[0]  # an array of one element binds the covered words to a name


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, most: int = MOST) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), items (sorted strings), contaminated and spans (array of at, end in words)."""
    grams = kept(windows(benchmark, item_col, item_text_col, width), "dc-windows")
    found = kept(hits(docs, grams, id_col, text_col, most), "dc-hits")
    spans = found.groupBy("_dc_id", "_dc_print").agg(F.collect_set(F.struct(F.col("_dc_at").alias("at"), F.col("_dc_n").alias("n"))).alias("_dc_places"))
    spans = spans.select("_dc_id", "_dc_print", merged(F.col("_dc_places")).alias("_dc_spans"))
    listed = found.select("_dc_id", "_dc_print", "_dc_n", "_dc_words").distinct().join(grams.select("_dc_n", "_dc_words", "_dc_item"), ["_dc_n", "_dc_words"])
    listed = listed.groupBy("_dc_id", "_dc_print").agg(F.sort_array(F.collect_set("_dc_item")).alias("_dc_items"))
    both = spans.alias("s").join(listed.alias("l"), _same("s", "l"), "left").select("s._dc_id", "s._dc_print", "_dc_spans", "_dc_items")
    mine = docs.withColumns({"_dc_id": F.col(id_col), "_dc_print": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), "_dc_count": F.size(words(F.col(text_col))).cast("long")})
    out = mine.alias("d").join(both.alias("b"), _same("d", "b"), "left")
    no_spans, no_items = F.array().cast("array<struct<at:int,end:int>>"), F.array().cast("array<string>")
    added = {
        "n_words": F.col("d._dc_count"),
        "n_hit": F.aggregate(F.coalesce("_dc_spans", no_spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["at"]),
        "n_items": F.size(F.coalesce("_dc_items", no_items)).cast("long"),
        "items": F.coalesce("_dc_items", no_items),
        "contaminated": F.col("_dc_spans").isNotNull(),
        "spans": F.coalesce("_dc_spans", no_spans),
    }
    others = [F.col(f"d.`{c}`") for c in docs.columns if c not in added]
    return out.select(*others, *(c.alias(n) for n, c in added.items()))


def cut(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what stands between them; what stands around a span stays."""
    raw = F.array_remove(F.split(text, RAW_BETWEEN), "")
    gaps = F.split(text, RAW_WORD, -1)
    # Pieces between spans: from a span's end to the next one's start, with the gap before each word; the last gap ends the text.
    from_ = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    to = F.concat(F.transform(spans, lambda s: s["at"]), F.array(F.size(raw)))
    runs = F.zip_with(from_, to, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # Bound once a text: the raw words and the gaps.
    bound = F.transform(F.array(F.struct(raw.alias("w"), gaps.alias("g"))), lambda x: F.array_join(F.transform(runs, lambda r: F.concat(
        # The words of a run, each with the gap before it. The gap before the first word of a run is the one after the span.
        F.array_join(F.zip_with(F.slice(x["g"], r["a"] + 1, r["b"] - r["a"]), F.slice(x["w"], r["a"] + 1, r["b"] - r["a"]), lambda g, w: F.concat(g, w)), ""),
        # The gap before the next span, or the end of the text.
        F.coalesce(F.get(x["g"], r["b"]), F.lit("")),
    )), ""))
    return bound[0]


def remove_spans(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """``mark``'s rows with the hit words taken out of the texts; clean texts stay as they are, null too."""
    return marked.withColumn(text_col, F.when(F.col("contaminated"), cut(F.col(text_col), F.col("spans"))).otherwise(F.col(text_col)))


def remove_documents(marked: DataFrame, least_share: float = 0.0) -> DataFrame:
    """``mark``'s rows without the contaminated documents whose hit words are more than least_share of all."""
    return marked.where(~F.col("contaminated") | (F.col("n_hit") <= F.col("n_words") * F.lit(least_share)))


def op11_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return mark(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
grams AS (SELECT DISTINCT item_id, l, unnest([array_to_string(ws[i:i + l - 1], ' ') for i in range(1, len(ws) - l + 2)]) AS w
          FROM (SELECT item_id, ws, least(len(ws), 10) AS l FROM items WHERE len(ws) > 0)),
places AS (SELECT doc_id, l, unnest(range(1, len(ws) - l + 2)) AS pos, unnest([array_to_string(ws[i:i + l - 1], ' ') for i in range(1, len(ws) - l + 2)]) AS w
           FROM docs, (SELECT DISTINCT l FROM grams) WHERE len(ws) >= l),
found AS (SELECT doc_id, l, pos, item_id FROM places JOIN grams USING (l, w)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + l)) AS p FROM (SELECT DISTINCT doc_id, pos, l FROM found)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
