"""Near-duplicate documents by an exact Jaccard self-join of word shingles with adaptive multi-match prefixes.

A document is the set of its hashed 5-word shingles. Tokens have one global order, rarest first (by the level of their
count, then by hash). Two sets with similarity t or more share at least l tokens within their l-prefixes, which hold
all but ceil(t*n) - l of a set's n tokens. Steps:

1. Every document gives its class (hash of its set; exact copies are one class from here on) and its tokens go into
   a counting sketch: counts per hash bucket over all documents, pre-aggregated in each task, merged by bucket range.
   What comes of it is a map of levels, ceil(log2(count)) in four bits a cell, in a file that workers memory-map.
   Tokens of a count above HEAVY are heavy.
2. Each class takes the number m of matches that costs least: its m-prefix gives the estimated lengths of its lists
   (from the levels), of which at most one in m is a candidate. A longer prefix asks for correspondingly more shared tokens. Light lists
   hold at most HEAVY classes. Tokens that occur once have no partner and are not emitted.
3. Pairs with enough matches and fitting sizes are verified on their whole sets, which move once to their group.
4. Classes whose 1-prefix holds heavy tokens (groups of near copies beyond HEAVY) give all their light tokens too. A
   pair of them that shares L light ones has at most L and the lesser number of heavy ones in common: if that
   is enough, it is verified like the others. Pairs without a light token in common meet in the lists of the heavy tokens of their
   prefixes. A list is compared with its pivot, the class with the least share of light tokens, which links the most.
   Only classes of another component than the largest of the list are then compared with the others: in blocks, by
   codes, which say which of the pivot's heavy tokens a class has and how many others. No pair becomes a row but those that join two components, or that codes
   leave open, which are verified on their sets. Links within a component change nothing.
5. Components of all links give each document its component_id.

Nothing but paths is broadcast. A cell shared by several buckets takes the highest level: that costs time, never a link.
Shingles and classes are told apart by 64-bit hashes.

Edge cases: null or blank text has no shingles, links with nothing and is its own component. Fewer words than a
shingle: the whole sequence is the one shingle. Rows of equal doc_id are treated row by row; their component ids are by
doc_id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import os
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes, kept, local_path, mixed, shared_dir, slices, table, trim, trimmed, words
from .components import components

#: Light tokens occur in at most so many classes; a power of two.
HEAVY = 64
#: Most bits of a cell of the level map.
CELLS = 34
FLUSH = 2_000_000
#: Cost of verifying a candidate, in entries of lists.
VERIFY = 8
#: Pairs of a group that are compared with one pivot in one call, and classes of a block that are compared by codes.
GROUP, BLOCK = 256, 2048


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of each text's k-word shingles."""
    split = [words(t) for t in texts]
    sizes = [len(w) for w in split]
    h = hashes([w for s in split for w in s])
    at, out = 0, []
    fold = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        fold = mixed(fold * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j] + np.uint64(j + 1)) if len(fold) else fold
    for n in sizes:
        if n >= k:
            out.append(np.unique(fold[at : at + n - k + 1]))
        elif n:
            x = np.array([n], np.uint64)
            for j in range(at, at + n):
                x = mixed(x * np.uint64(3) + h[j : j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def class_of(tokens: np.ndarray) -> int:
    """Signed 64-bit identity of a set."""
    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >> 63 else h


def needed(n: int, t: Fraction) -> int:
    """Least number of tokens that a set of n shares with any set of similarity t or more."""
    return -(-n * t.numerator // t.denominator)


def _packed(values: np.ndarray) -> bytes:
    """Ascending values as first value and gaps of the least width."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    width = next(w for w in ("<u1", "<u2", "<u4", "<u8") if not len(gaps) or gaps[1:].max(initial=0) <= np.iinfo(w).max)
    return bytes([np.dtype(width).itemsize]) + (gaps[:1].tobytes() + gaps[1:].astype(width).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob, f"<u{blob[0]}", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(blob[1:9], "<u8"), gaps]), dtype=np.uint64)


class Join:
    """The steps on one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, threshold: float = 0.75, k: int = 5):
        self.spark, self.k, self.t = docs.sparkSession, k, Fraction(threshold).limit_denominator(1000)
        self.docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("print"))
        self.id_type = docs.schema["doc_id"].dataType.simpleString()
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tokens = max(1, size // 6)
        #: Bits of a bucket: some 16 buckets a token. Ranges: a few million tokens each.
        self.bits = min(48, max(22, math.ceil(math.log2(16 * tokens))))
        self.range_bits = min(self.bits, max(4, math.ceil(math.log2(max(1, tokens / 2_000_000)))))
        self.cells = max(self.range_bits + 1, min(CELLS, self.bits, math.ceil(math.log2(3 * tokens))))

    def scan(self) -> DataFrame:
        """Rows of documents (doc_id, print, cls, n) and of the sketch (range, buckets, counts other than one)."""
        bits, ranges, k = self.bits, self.range_bits, self.k
        schema = f"doc_id {self.id_type}, print long, cls long, n int, range int, buckets binary, counts binary"

        def run(batches):
            held, size, kind = [], 0, None

            def flush():
                v, n = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
                ends = np.searchsorted(v, np.arange(1 << ranges, dtype=np.uint64) << np.uint64(bits - ranges))
                rows = [(r, v[a:z], n[a:z]) for r, (a, z) in enumerate(zip(ends, [*ends[1:], len(v)], strict=True)) if z > a]
                # Counts other than one, as pairs of position and count.
                many = [np.flatnonzero(c > 1) for _, _, c in rows]
                counts = [np.concatenate([m, c[m]]).astype("<u4").tobytes() for m, (_, _, c) in zip(many, rows, strict=True)]
                none = [None] * len(rows)
                return pa.RecordBatch.from_arrays([pa.array(none, kind), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array([r for r, _, _ in rows], pa.int32()), pa.array([_packed(x) for _, x, _ in rows], pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "print", "cls", "n", "range", "buckets", "counts"])

            seen: set[int] = set()
            for b in slices(batches):
                kind = b.schema.field("doc_id").type
                sets = shingle_sets([t.as_py() for t in b.column("text")], k)
                ids = [class_of(s) for s in sets]
                none = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("print"), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.nulls(len(sets), pa.int32()), none, none], ["doc_id", "print", "cls", "n", "range", "buckets", "counts"])
                for c, s in zip(ids, sets, strict=True):
                    if c not in seen and len(s):
                        seen.add(c)
                        held.append(s)
                        size += len(s)
                        if size > FLUSH:
                            yield flush()
                            held, size = [], 0
            if held:
                yield flush()

        return self.docs.mapInArrow(trimmed(run), schema)

    def levels(self, scanned: DataFrame) -> str:
        """The file with the level of each cell: 0 for a count of one, k for counts above 2**(k-1) up to 2**k, 15 at most."""
        bits, ranges, fold = self.bits, self.range_bits, self.bits - self.cells
        width = 1 << (self.cells - ranges)
        path = local_path(shared_dir(self.spark, "levels"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.truncate((1 << self.cells) // 2)

        def merge(t: pa.Table) -> pa.Table:
            values, counts = [], []
            for blob, many in zip(t.column("buckets").to_pylist(), t.column("counts").to_pylist(), strict=True):
                v = _unpacked(blob)
                c, m = np.ones(len(v), np.int64), np.frombuffer(many, "<u4").reshape(2, -1)
                c[m[0]] = m[1]
                values.append(v)
                counts.append(c)
            v, c = np.concatenate(values), np.concatenate(counts)
            order = np.argsort(v, kind="stable")
            v, c = v[order], c[order]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            v, c = v[first] >> np.uint64(fold), np.add.reduceat(c, first)
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            level = np.zeros(width, np.uint8)
            level[(v[first] & np.uint64(width - 1)).astype(np.int64)] = np.minimum(np.ceil(np.log2(np.maximum.reduceat(c, first))), 15)
            r = t.column("range")[0].as_py()
            trim()
            fd = os.open(path, os.O_WRONLY)  # each range has bytes of its own, so a repeated task writes the same again
            os.pwrite(fd, (level[0::2] | level[1::2] << 4).tobytes(), r * width // 2)
            os.close(fd)
            return pa.table({"n": pa.array([len(v)], pa.int64())})

        scanned.where("range IS NOT NULL").select("range", "buckets", "counts").groupBy("range").applyInArrow(merge, "n long").agg(F.sum("n")).collect()
        return path

    def prefixes(self, levels: str) -> DataFrame:
        """Light shared prefix tokens (tok, cls, n, m, h) of classes, and the sets (cls, n, h, tokens, lead) of those with heavy ones in their 1-prefix.

        h: number of heavy tokens of such a class, else 0; they come first in tokens, by hash. lead: the heavy tokens of its 1-prefix.
        """
        cells, k, t, top = self.cells, self.k, self.t, HEAVY.bit_length() - 1

        def run(batches):
            level = np.memmap(levels, np.uint8, "r").view(np.ndarray)
            seen: set[int] = set()
            for b in slices(batches):
                toks, rows, whole = [], [], []
                for s in shingle_sets([x.as_py() for x in b.column("text")], k):
                    n = len(s)
                    if not n or (c := class_of(s)) in seen:
                        continue
                    seen.add(c)
                    cell = (s >> np.uint64(64 - cells)).astype(np.int64)
                    lv = level[cell >> 1] >> ((cell & 1) * 4).astype(np.uint8) & 15
                    order = np.argsort(lv, kind="stable")  # hashes ascend
                    lv, least = lv[order], needed(n, t)
                    light, more = int(np.searchsorted(lv, top, "right")), n - least
                    if light > more:
                        lists = np.cumsum((1 << lv[:light].astype(np.int64)) - 1)[more : more + least]
                        m = int(np.argmin(lists * (1 + VERIFY / np.arange(1, len(lists) + 1)))) + 1
                        heavy, end = 0, more + m
                    else:
                        m, heavy, end = 0, n - light, light
                        whole.append((c, n, heavy, s[np.concatenate([np.sort(order[light:]), order[:light]])].tobytes(), s[order[light : more + 1]].tobytes()))
                    found = s[order[:end][lv[:end] > 0]]
                    if len(found) >= max(m, 1):
                        toks.append(found.view(np.int64))
                        rows.append((c, n, m, heavy, len(found)))
                cls, n, m, h, times = np.array(rows, np.int64).reshape(-1, 5).T
                one = lambda x, w, kind: pa.array(np.concatenate([np.repeat(x, times), np.array(w, np.int64)]).astype(kind))
                tok = pa.array(np.concatenate([*toks, np.zeros(0, np.int64)]))
                none = pa.nulls(len(tok), pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([tok, pa.nulls(len(whole), pa.int64())]), one(cls, [w[0] for w in whole], np.int64), one(n, [w[1] for w in whole], np.int32),
                    one(m, [0] * len(whole), np.int32), one(h, [w[2] for w in whole], np.int32),
                    pa.concat_arrays([none, pa.array([w[3] for w in whole], pa.binary())]), pa.concat_arrays([none, pa.array([w[4] for w in whole], pa.binary())]),
                ], ["tok", "cls", "n", "m", "h", "tokens", "lead"])

        return self.docs.select("text").mapInArrow(trimmed(run), "tok long, cls long, n int, m int, h int, tokens binary, lead binary")

    def fits(self, a, b):
        """Sizes of two sets that allow the similarity."""
        return F.least(a, b) * self.t.denominator >= F.greatest(a, b) * self.t.numerator

    def enough(self, common, a, b):
        """Whether sets of these sizes are similar if so many tokens are common."""
        return common.cast("long") * (self.t.numerator + self.t.denominator) >= (a + b).cast("long") * self.t.numerator

    def candidates(self, tokens: DataFrame) -> DataFrame:
        """Pairs a < b of classes with enough common light prefix tokens."""
        lists = tokens.groupBy("tok").agg(F.sort_array(F.collect_set(F.struct("cls", "n", "m", "h"))).alias("x")).where(F.size("x") > 1)  # HEAVY at most
        pairs = lists.select(F.explode(F.flatten(F.transform(F.col("x"), lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
        pairs = pairs.where(self.fits(F.col("p.a.n"), F.col("p.b.n")))
        # m is 0 for classes with heavy prefixes: the other one's m counts; between two of them the heavy tokens do.
        m = F.when(F.col("p.a.m") == 0, F.col("p.b.m")).when(F.col("p.b.m") == 0, F.col("p.a.m")).otherwise(F.least("p.a.m", "p.b.m"))
        pairs = pairs.select(F.col("p.a.cls").alias("a"), F.col("p.b.cls").alias("b"), m.alias("m"), F.least("p.a.h", "p.b.h").alias("h"), F.col("p.a.n").alias("an"), F.col("p.b.n").alias("bn"))
        one = [F.first(c).alias(c) for c in ("m", "h", "an", "bn")]  # the same in all rows of a pair
        shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), *one)
        return shared.where(F.when(F.col("m") > 0, F.col("shared") >= F.col("m")).otherwise(self.enough(F.col("shared") + F.col("h"), F.col("an"), F.col("bn")))).select("a", "b")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """cls, tokens of the classes in wanted (cls): by a bitmap of bounded size in the tasks first, then by a join."""
        bits, k = 26, self.k
        slot = F.col("cls").bitwiseAND(F.lit((1 << bits) - 1))  # a class is a hash

        def mark(t: pa.Table) -> pa.Table:
            flags = np.zeros(1 << 15, bool)
            flags[t.column("slot").to_numpy() & 0x7FFF] = True
            return pa.table({"part": pa.array([t.column("slot")[0].as_py() >> 15], pa.int32()), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

        marks = wanted.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", 15).cast("int")).applyInArrow(mark, "part int, flags binary")
        flags = np.zeros((1 << bits) // 8, np.uint8)
        for r in marks.collect():  # 8 MB in all
            flags[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["flags"], np.uint8)
        shared = self.spark.sparkContext.broadcast(flags)

        def run(batches):
            flags, seen = shared.value, set()
            for b in slices(batches):
                out = []
                for s in shingle_sets([x.as_py() for x in b.column("text")], k):
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        at = c & ((1 << bits) - 1)
                        if flags[at >> 3] >> (7 - (at & 7)) & 1:
                            out.append((c, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["cls", "tokens"])

        found = self.docs.select("text").mapInArrow(trimmed(run), "cls long, tokens binary")
        return kept(found.join(wanted.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens")), "sets")

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Links u, v among the pairs that connect what the verified pairs of a group connect."""
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = both.groupBy("a").agg(F.min("b").alias("h")).select(F.col("a"), F.least("a", "h").alias("hub"))
        at = kept(pairs.join(hub, "a"), "pairs")  # each pair is checked where its first class's least partner is
        members = at.select(F.col("hub").alias("of"), F.col("a").alias("cls")).unionByName(at.select(F.col("hub").alias("of"), F.col("b").alias("cls"))).distinct()
        t = self.t

        def check(left: pa.Table, right: pa.Table) -> pa.Table:
            tokens = {c: np.frombuffer(x.as_py(), np.uint64) for c, x in zip(right.column("cls").to_pylist(), right.column("tokens"), strict=True)}
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            out = []
            for a, b in sorted(zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True)):
                x, y = find(a), find(b)
                if x != y and similar(tokens[a], tokens[b], t):  # links within a component change nothing
                    root[max(x, y)] = min(x, y)
                    out.append((a, b))
            return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

        return at.groupBy("hub").cogroup(members.join(sets, "cls").groupBy("of")).applyInArrow(check, "u long, v long")

    def _with_sets(self, pairs: DataFrame, sets: DataFrame, run, schema: str) -> DataFrame:
        """run(one set of u, rows of its partners with their sets) for distinct pairs (u, v).

        The partners of one u are dealt into groups of about GROUP; its set moves once to each.
        """
        pairs = kept(pairs, "compared")
        parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        dealt = kept(pairs.join(parts, "u").select("u", "v", F.pmod(F.xxhash64("v"), "parts").alias("part")), "dealt")
        left = dealt.select(F.col("u").alias("of"), F.col("part").alias("at")).distinct().join(sets.select(F.col("cls").alias("of"), F.col("h").alias("xh"), F.col("tokens").alias("x")), "of")
        right = dealt.join(sets.select(F.col("cls").alias("v"), "h", "tokens"), "v")
        return left.groupBy("of", "at").cogroup(right.groupBy("u", "part")).applyInArrow(run, schema)

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (u, v) that are links."""
        t = self.t

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            x = np.frombuffer(left.column("x")[0].as_py(), np.uint64)
            return right.select(["u", "v"]).filter(pa.array([similar(x, np.frombuffer(y.as_py(), np.uint64), t) for y in right.column("tokens")], pa.bool_()))

        return kept(self._with_sets(pairs, sets, run, "u long, v long"), "verified")

    def coded(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """u, v, whether they are linked, which of u's heavy tokens v has (bits), and how many heavy ones it has beside them."""
        t = self.t

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            x, xh = np.frombuffer(left.column("x")[0].as_py(), np.uint64), left.column("xh")[0].as_py()
            ok, bits, rest = [], [], []
            for y, h in zip(right.column("tokens"), right.column("h").to_pylist(), strict=True):
                y = np.frombuffer(y.as_py(), np.uint64)
                has = found_in(x[:xh], y[:h])
                ok.append(similar(x, y, t))
                bits.append(np.packbits(has).tobytes())
                rest.append(h - int(has.sum()))
            return pa.table({"u": right.column("u"), "v": right.column("v"), "ok": pa.array(ok, pa.bool_()), "bits": pa.array(bits, pa.binary()), "rest": pa.array(rest, pa.int32())})

        return kept(self._with_sets(pairs, sets, run, "u long, v long, ok boolean, bits binary, rest int"), "coded")

    def heavy_links(self, whole: DataFrame, links: DataFrame) -> DataFrame:
        """Edges with the components of links and of the links among classes (cls, n, h, tokens, lead) that share no light token."""
        def unfold(batches):
            for b in batches:
                found = [np.frombuffer(x.as_py(), np.int64) for x in b.column("lead")]
                take = pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), *(b.column(c).take(take) for c in ("cls", "n", "h"))], ["tok", "cls", "n", "h"])

        lists = kept(whole.select("cls", "n", "h", "lead").mapInArrow(unfold, "tok long, cls long, n int, h int"), "lists")
        pivots = lists.groupBy("tok").agg(F.max_by("cls", F.struct(F.col("h") / F.col("n"), "cls")).alias("u"))
        near = self.coded(lists.join(pivots, "tok").select("u", F.col("cls").alias("v")).distinct(), whole)
        known = components(links.unionByName(near.where("ok AND u <> v").select("u", "v")))
        of = near.join(known, near["v"] == known["node"], "left").select(F.col("u").alias("pivot"), F.col("v").alias("cls"), "bits", "rest", F.coalesce("root", "v").alias("root"))
        of = kept(of.join(whole.select("cls", "n", "h"), "cls"), "near")
        most = of.groupBy("pivot", "root").agg(F.count("*").alias("k")).groupBy("pivot").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.sum("k").alias("k"), F.count("*").alias("roots")).where("roots > 1")
        # A class whose heavy tokens don't make up a link with a set of the least size that it could link with is settled.
        able = self.enough(F.col("h"), F.col("n"), F.floor(F.col("n") * self.t.numerator / self.t.denominator))
        rows = of.where(able).join(most.select("pivot", "most", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "pivot")
        rows = kept(rows.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int")), "unsettled")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        minor = rows.where("root <> most").withColumn("other", every).select(F.col("pivot").alias("p"), F.col("block").alias("i"), F.col("other").alias("j"), "cls", "n", "h", "bits", "rest", "root")
        rows = rows.withColumn("own", every)
        up, low = self.t.numerator, self.t.numerator + self.t.denominator

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return by_codes(left, right, up, low)

        found = kept(minor.groupBy("p", "i", "j").cogroup(rows.groupBy("pivot", "own", "block")).applyInArrow(run, "u long, v long, sure boolean"), "by-codes")
        stars = known.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        sure, rest = found.where("sure").select("u", "v"), found.where("NOT sure").select("u", "v").distinct()
        return stars.unionByName(sure).unionByName(self.verified(rest, whole))

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id, cls, print (hash of the text) and root (class of the component) of every row."""
        scanned = kept(self.scan(), "shingles")
        classes = scanned.where("range IS NULL").select("doc_id", "print", "cls", F.col("n").cast("long").alias("n_shingles"))
        rows = kept(self.prefixes(self.levels(scanned)), "prefixes")
        pairs = kept(self.candidates(rows.where("tok IS NOT NULL").select("tok", "cls", "n", "m", "h")), "candidates")
        links = kept(self.linked(pairs, self.sets_of(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))))), "links")
        whole = kept(rows.where("tokens IS NOT NULL").groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "h", "tokens", "lead"))), "whole")
        if not whole.isEmpty():
            links = self.heavy_links(whole, links)
        roots = components(links)
        of = classes.join(roots, classes["cls"] == roots["node"], "left").withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "cls")))
        least = of.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
        return of.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "cls", "print", "root")


def found_in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b (ascending)."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


def by_codes(left: pa.Table, right: pa.Table, up: int, low: int) -> pa.Table:
    """Pairs of a row of left and one of right that join components, and pairs that the codes leave open (not sure).

    Codes over one pivot give the least number of common heavy tokens, and with the lesser rest the greatest: a pair is a link if
    common * low >= up * (sum of the sizes).
    """
    if not left.num_rows or not right.num_rows:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "sure": pa.array([], pa.bool_())})
    codes, sizes, rests, ids, roots = [], [], [], [], []
    for t in (left, right):
        raw = t.column("bits").to_pylist()
        width = -(-len(raw[0]) // 8) * 8
        codes.append(np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), "<u8").reshape(len(raw), -1))
        for to, c in ((sizes, "n"), (rests, "rest"), (ids, "cls"), (roots, "root")):
            to.append(t.column(c).to_numpy().astype(np.int64))
    names, label = np.unique(np.concatenate(roots), return_inverse=True)
    label = label.copy()
    split = len(ids[0])
    out, open_pairs = [], []
    for a in range(0, split, 256):
        common = np.zeros((len(codes[0][a : a + 256]), len(codes[1])), np.int32)
        for w in range(codes[0].shape[1]):
            common += np.bitwise_count(codes[0][a : a + 256, w, None] & codes[1][None, :, w])
        wanted = up * (sizes[0][a : a + 256, None] + sizes[1][None, :])
        linked = common * low >= wanted
        perhaps = ~linked & ((common + np.minimum(rests[0][a : a + 256, None], rests[1][None, :])) * low >= wanted)
        for i in range(len(linked)):
            at = np.flatnonzero(linked[i])
            for j in at[np.unique(label[split + at], return_index=True)[1]]:  # one of each component
                one, two = label[a + i], label[split + j]
                if one != two:
                    label[label == two] = one
                    out.append((ids[0][a + i], ids[1][j], True))
            open_pairs += [(a + i, j) for j in np.flatnonzero(perhaps[i] & (label[split:] != label[a + i]))]
    out += [(ids[0][i], ids[1][j], False) for i, j in open_pairs if label[i] != label[split + j]]
    return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64()), "sure": pa.array([x[2] for x in out], pa.bool_())})


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def similar(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    both, either = overlap(a, b)
    return both * t.denominator >= t.numerator * either


def near_duplicates(docs: DataFrame, threshold: float = 0.75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, cls, print, root of every row of docs (doc_id, text)."""
    return Join(docs, threshold, k).run()


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.75, k: int = 5) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (null ids last), then of the least hash of its text.

    Of equal rows one stays. Texts without words belong to no group and all stay.
    """
    found = kept(near_duplicates(docs, threshold, k).where("root IS NOT NULL").select("doc_id", "print", "root"), "groups")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first"))
    go = found.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("print") == F.col("first.print")))).select("doc_id", "print").distinct()
    again = found.groupBy("doc_id", "print").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "print")
    marks = kept(go.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True))), "duplicates").withColumnsRenamed({"doc_id": "_id", "print": "_own"})
    rows = docs.withColumn("_print", F.xxhash64("text"))
    same = lambda m: rows["doc_id"].eqNullSafe(m["_id"]) & (rows["_print"] == m["_own"])
    go, again = marks.where("NOT again"), marks.where("again")
    twice = again.join(go.select(F.col("_id").alias("_gi"), F.col("_own").alias("_go")), F.col("_id").eqNullSafe(F.col("_gi")) & (F.col("_own") == F.col("_go")), "left_anti")
    once = rows.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "_print"])
    return rows.join(marks, same(marks), "left_anti").unionByName(once).select(*docs.columns)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM texts),
classes AS MATERIALIZED (SELECT min(doc_id) AS cls, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS MATERIALIZED (SELECT cls, n, hash(t) AS t FROM (SELECT cls, n, unnest(s) AS t FROM classes)),
pairs AS (SELECT a.cls AS a, b.cls AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS shared FROM tokens a JOIN tokens b ON a.t = b.t AND a.cls < b.cls GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (an + bn - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT cls AS a, cls AS b FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
roots AS (SELECT a AS cls, min(b) AS root FROM reach GROUP BY a)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, sets.doc_id) AS component_id FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN roots USING (cls)
"""
