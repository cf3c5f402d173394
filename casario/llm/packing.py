"""Best-fit packing of documents into sequences of a fixed number of tokens.

Pieces of equal length are interchangeable, so the packing is planned on the histogram of lengths, which has at most
``size`` entries however many documents there are; the driver sees nothing else. First comes a Martello-Toth reduction:
going down from the longest length, a small set that provably dominates every other set with that length is fixed (the
piece alone when nothing fits beside it; with its exact complement; with the longest that fits when no two others
fit together). What the reduction leaves is packed best-fit decreasing. The plan gives slots: runs of ranks within a
length, with first sequence and offset; each piece looks its slot up by its rank.

Ranks within a length are counted over (length, salt), so that a length that a third of all pieces share is spread; salts
grow with the pieces, RANKED to a salt at most on average.

Edge cases: a null or empty text is the end id alone. Equal rows are packed each. A text of more than ``size`` tokens
is cut into pieces of ``size``, the last may be shorter. A null doc_id is an id. An empty table packs to no rows. Columns other
than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, slices, table, trimmed
from .encoders import opened


#: Entries of a worker's memo; a pipeline's workers have had other work before.
MEMO = 350_000
#: Pieces of a salt.
RANKED = 100_000


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder = opened(vocabulary, False, memo=MEMO)
        for b in slices(batches, 1000):
            doc, cols = [], ([], [], [], [])
            for i, t in enumerate(b.column("text")):
                ids = coder.encode(t.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    doc.append(i)
                    for c, v in zip(cols, (k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(c, x) for c, x in zip(cols, types, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def reduce(counts: dict[int, int], size: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets fixed by dominance, as (lengths, how often), and the counts that remain."""
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], n: int) -> None:
        fixed.append((lengths, n))
        for x in lengths:
            left[x] -= n
            if not left[x]:
                del left[x]

    changed = True
    while changed:
        changed = False
        for a in sorted(left, reverse=True):
            while left.get(a):
                room = size - a
                # lengths that fit beside one piece of a; a itself only if there are two
                b = max((x for x in left if x <= room and (x != a or left[a] > 1)), default=None)
                if b is None:
                    take((a,), left[a])
                elif b == room:
                    take((a, b), left[a] // 2 if a == b else min(left[a], left[b]))
                else:
                    # the two shortest others: if they don't fit together, at most one fits beside a
                    least = min(left)
                    n = left[least] - (least == a)
                    two = [least] * min(2, n)
                    if len(two) < 2:
                        two += sorted(x for x in left if x != least and (x != a or left[a] > 1))[: 2 - len(two)]
                    if len(two) == 2 and sum(two) <= room:
                        break
                    take((a, b), left[a] // 2 if a == b else min(left[a], left[b]))
                changed = True
    return fixed, left


def best_fit(left: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of the counts, on groups of equal bins: (lengths, how often)."""
    groups: dict[int, list[list]] = defaultdict(list)  # room left: [lengths, bins]
    for a in sorted(left, reverse=True):
        n = left[a]
        while n:
            room = min((r for r, g in groups.items() if g and r >= a), default=None)
            if room is None:
                k = min(size // a, n)
                bins = n // k
                groups[size - k * a].append([(a,) * k, bins])
                n -= k * bins
                continue
            lengths, bins = groups[room].pop()
            k = min(room // a, n)  # a filled bin has the least room, so it goes on taking a
            use = min(bins, n // k)
            if bins > use:
                groups[room].append([lengths, bins - use])
            groups[room - k * a].append([lengths + (a,) * k, use])
            n -= k * use
    return [(tuple(x), n) for g in groups.values() for x, n in g if n]


def plan(counts: dict[int, int], size: int) -> dict[int, np.ndarray]:
    """length: rows (first rank, first sequence, offset), ascending by rank; each slot runs to the next one's first rank."""
    fixed, left = reduce(counts, size)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, n in [*fixed, *best_fit(left, size)]:
        at = 0
        for x in lengths:
            slots[x].append((used[x], sequence, at))
            used[x] += n
            at += x
        sequence += n
    assert dict(used) == {k: n for k, n in counts.items() if n}, "every piece has one place"
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def pack(found: DataFrame, size: int = 2048) -> DataFrame:
    """found (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = found.sparkSession
    salts = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // RANKED))
    found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    by_salt = kept(found.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `size` rows
    places = spark.sparkContext.broadcast(plan(counts, size))
    before = by_salt.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", *(c for c in ("ids_crc32",) if c in found.columns)))
    # At most size rows a salt: fewer than one in RANKED / size pieces.
    ranked = found.withColumn("_own", own).join(before, ["length", "_salt"]).withColumn("_rank", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_salt", "_before", "_own")
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(length) else []
            for a, z in zip(starts, [*starts[1:], len(length)], strict=True) if len(length) else []:
                at = order[a:z]
                slot = places.value[int(length[at[0]])]
                k = np.searchsorted(slot[:, 0], rank[at], side="right") - 1
                seq[at] = slot[k, 1] + rank[at] - slot[k, 0]
                off[at] = slot[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    return pack(kept(pieces(docs, vocabulary, size), "pieces"), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
