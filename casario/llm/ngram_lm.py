"""Interpolated modified Kneser-Ney model of a given order: counted in Spark, stored as sorted hash arrays, memory-mapped.

Training. Words are counted over all training texts (first shuffle, pre-aggregated in each task). n-grams of the full
order are counted per task and sent as compact sorted blobs to shards by the last word of their context; where that is
hot, by its last two words, and so on, and last by the predicted word too. Words above 1/HOT of all tokens
and contexts above 1/(2 HOT) are hot: fewer than 2 HOT of a length. A shard's task writes sorted arrays to the shared
folder: n-gram fingerprints with counts, contexts with their totals and how many words follow once, twice, more often.
Each distinct n-gram then counts once for its last n-1 words, which go as blobs to the shards of the next lower order,
down to bigrams. How many contexts precede a word goes, again as sorted blobs, to shards by word, where it meets the word
counts.

Scoring. A worker maps the shards it meets (file pages, not process memory), looks up a chunk of tokens in hash order and
sums log10 probabilities by text. Nothing of the model passes through the driver but the hot contexts and the
counts of counts.

P(w|tu) = max(c(tuw) - D(c(tuw)), 0)/c(tu) + g(tu) P(w|u), and so on with P(w|u) from k(uw), the number of words before uw,
in place of c, down to P1(w) = max(k(w) - d(k(w)), 0)/K + g1/(V+1), where k(w) counts the
words before w, K their sum, and V+1 leaves room for an unknown word. Discounts D1, D2, D3+ come from the counts
of counts at each level (Chen & Goodman, 1998). Before its first word a text has start marks, as many as a context has
words, after its last an end.

The query's order is ORDER. Words in n-grams and contexts are told apart by 40 bits of their hashes: those that share them are one word or
context here (2 of 3 million words; about 450,000 of 10^9 contexts). n-grams of a shard are found by 32 bits of their hash; those
of training that share these bits are kept by all 64, so that of what these bits tell apart no seen n-gram loses or lends a
count. An unseen n-gram or context is taken for a seen one about once in 10,000. Counts and sums have 64 bits where they need them.

Edge cases: a null or blank text is the end mark alone. Repeated rows count as often as they occur. Without training
texts the model is uniform. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hashes, kept, local_path, mixed, shared_dir, slices, table, words
from .hash_arrays import Files, joined, split, write

#: Hashes of marks that no word can equal, having white space.
START, END = hashes([b" ", b"\n"])
ORDER = 3
HOT = 2000
FLUSH = 2_000_000
CHUNK = 400_000
#: Tokens of a shard.
SHARD = 1_000_000
_LOW = np.uint64(24)


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text followed by END, and each text's number of tokens."""
    each = [words(t) for t in texts]
    sizes = np.array([len(s) + 1 for s in each], np.int64)
    out = np.full(sizes.sum(), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = hashes([w for s in each for w in s])
    return out, sizes


def before(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(sizes) - sizes] = START
    return out


def priors_of(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Each token's prior word, the one before that, and so on."""
    out = [before(tokens, sizes)]
    while len(out) < order - 1:
        out.append(before(out[-1], sizes))
    return out


def contexts_of(priors: list[np.ndarray]) -> list[np.ndarray]:
    """Contexts (40 bits) of the last word, the last two, and so on, of 40-bit priors."""
    out = [priors[0]]
    for p in priors[1:]:
        out.append(mixed(out[-1] * np.uint64(0x9E3779B97F4A7C15) + p) >> _LOW)
    return out


def keys_of(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of words behind contexts; the upper half is the fingerprint."""
    return mixed(u * np.uint64(0x9E3779B97F4A7C15) + w)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.uint32)


def found_in(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys among sorted_keys, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def among_hot(contexts: list[np.ndarray], hots: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of contexts, their positions among the hot ones and whether they are hot."""
    return [found_in(u, h) for u, h in zip(contexts, hots, strict=False)]


def shard_of(contexts: list[np.ndarray], w: np.ndarray, hot: list[tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """Shard of each n-gram: by its shortest context that isn't hot, or by the longest and the word."""
    out, busy = contexts[0] >> np.uint64(40 - bits), np.arange(len(w))
    for j, u in enumerate(contexts):
        busy = busy[hot[j][1][busy]]
        if not len(busy):
            break
        further = contexts[j + 1][busy] if j + 1 < len(contexts) else u[busy] * np.uint64(3) + w[busy]
        out[busy] = mixed(further) >> np.uint64(64 - bits)
    return out.astype(np.int64)


def by_context(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order in which equal contexts, and within them equal words, are together: one sort of 64-bit keys, and one of what clashes in them."""
    key = (u << _LOW) | (mixed(w) >> np.uint64(40))
    order = np.argsort(key)
    k, v = key[order], w[order]
    same = k[1:] == k[:-1]
    clash = np.flatnonzero(same & (v[1:] != v[:-1]))
    if len(clash):  # runs of one key that hold different words
        run = np.cumsum(np.r_[True, ~same])
        at = np.flatnonzero(np.isin(run, run[clash]))
        order[at] = order[at][np.lexsort((v[at], run[at]))]
    return order


def packed(priors: list[np.ndarray], w: np.ndarray, n: np.ndarray, hots: list[np.ndarray], bits: int) -> list[tuple[int, bytes]]:
    """shard and blob (last words of contexts, how often each follows, the further priors, words, counts) of summed n-grams."""
    u = contexts_of(priors)[-1]
    order = by_context(u, w)
    u, w, n = u[order], w[order], n[order]
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
    n, w, priors = np.add.reduceat(n, first), w[first], [p[order[first]] for p in priors]
    contexts = contexts_of(priors)
    shard = shard_of(contexts, w, among_hot(contexts, hots), bits)
    order = np.argsort((shard.astype(np.uint64) << np.uint64(40)) | priors[0])
    w, n, shard, priors = w[order], n[order], shard[order], [p[order] for p in priors]
    least = lambda x: x.astype("u1" if x.max() < 256 else "<u4")
    five = lambda x: np.frombuffer(_five(x), np.uint8)
    cuts, rows = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), []
    for a, z in zip(cuts, [*cuts[1:], len(w)], strict=True):
        v = priors[0][a:z]
        one = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        rows.append((int(shard[a]), joined(five(v[one]), np.diff(np.r_[one, z - a]).astype("<u4"), *(five(p[a:z]) for p in priors[1:]), five(w[a:z]), least(n[a:z]))))
    return rows


def unpacked(blobs: list[bytes], level: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    priors, ws, ns = [[] for _ in range(level - 1)], [], []
    for blob in blobs:
        v, k, *further, w, n = split(blob, "u1", "<u4", *["u1"] * level)
        w = _from_five(w)
        for to, p in zip(priors, [np.repeat(_from_five(v), k), *map(_from_five, further)], strict=True):
            to.append(p)
        ws.append(w)
        ns.append((n if len(n) == len(w) else n.view("<u4")).astype(np.int64))
    return [np.concatenate(p) for p in priors], np.concatenate(ws), np.concatenate(ns)


def _five(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = b.reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def discounts(n: list[int]) -> np.ndarray:
    """Discount of a count of 0, 1, 2 and 3 or more, from how many types have counts 1 to 4."""
    if min(n[:3]) <= 0:
        return np.array([0, 0.5, 0.75, 1.0])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


#: n-grams' fingerprints and counts below 255, those of larger counts; whole keys and counts of n-grams that share a fingerprint
#: (whose count is 0 in the former); contexts and their sums below 255, those of larger sums; contexts that occur once.
ARRAYS = ("<u4", "u1", "<u4", "<u8", "<u8", "<u8", "<u8", "u1", "<u8", "<u8", "<u4")


class Model:
    """hots and hot_sums hold the hot contexts of each length and their sums; discounts those of contexts of each length."""

    def __init__(self, path: str, bits: int, word_bits: int, hots: list[np.ndarray], hot_sums: list[np.ndarray], stats: dict):
        self.path, self.bits, self.word_bits, self.hots, self.hot_sums, self.files = path, bits, word_bits, hots, hot_sums, Files()
        self.__dict__ |= stats  # tokens, vocabulary, types (K), discounts, word_discount, word_rest

    def _by_shard(self, keys: np.ndarray, shards: np.ndarray, look, width: int) -> np.ndarray:
        """keys in ascending order of shards; look(shard, keys) gives rows of values."""
        out = np.zeros((len(keys), width))
        cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(keys) else []
        for a, z in zip(cuts, [*cuts[1:], len(keys)], strict=True) if len(keys) else []:
            look(int(shards[a]), keys[a:z], out[a:z])
        return out

    def word_values(self, w: np.ndarray) -> np.ndarray:
        """count and number of contexts of ascending distinct 64-bit words."""
        def look(s, keys, out):
            if (found := self.files.arrays(f"{self.path}/word-{s}", "<u8", "<u8", "<u8")) and len(found[0]):
                at = np.minimum(np.searchsorted(found[0], keys), len(found[0]) - 1)
                ok = found[0][at] == keys
                out[ok, 0], out[ok, 1] = found[1][at[ok]], found[2][at[ok]]
        return self._by_shard(w, w >> np.uint64(64 - self.word_bits), look, 2)

    def looked_up(self, contexts: list[np.ndarray], w: np.ndarray, hot: list[tuple[np.ndarray, np.ndarray]], d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the longest of contexts, its total and what d takes off the counts behind it, and how often w follows.

        A context that isn't hot lies in the shard of its n-grams, so one order serves both.
        """
        u, j = contexts[-1], len(contexts) - 1
        shard, keys = shard_of(contexts, w, hot, self.bits), keys_of(contexts[-1], w)
        order = np.argsort((shard.astype(np.uint64) << np.uint64(40)) | u)
        shard, us, keys = shard[order], u[order], keys[order]
        sums, counts = np.zeros((len(u), 4)), np.zeros(len(u))
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(u) else []
        for a, z in zip(cuts, [*cuts[1:], len(u)], strict=True) if len(u) else []:
            if found := self.files.arrays(f"{self.path}/pair-{j + 2}-{int(shard[a])}", *ARRAYS):
                self._in_shard(found, us[a:z], keys[a:z], sums[a:z], counts[a:z])
        at, ok = hot[j]
        busy = ok[order]
        sums[busy] = self.hot_sums[j][at[order[busy]]]
        total, off, count = np.empty(len(u)), np.empty(len(u)), np.empty(len(u))
        total[order], off[order], count[order] = sums[:, 0], sums[:, 1:] @ d[1:], counts
        return total, off, count

    @staticmethod
    def _in_shard(found: tuple[np.ndarray, ...], u: np.ndarray, keys: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Fills sums of ascending contexts and counts of n-grams' keys from a shard's arrays."""
        prints, small, large, large_counts, shared, shared_counts, ctx, ctx_sums, big, big_sums, single = found
        sums[found_in(u.astype("<u4"), single)[1]] = (1, 1, 0, 0)
        at, ok = found_in(u, ctx)
        sums[ok] = ctx_sums.reshape(-1, 4)[at[ok]]
        if len(big):
            at, ok = found_in(u, big)
            sums[ok] = big_sums.reshape(-1, 4)[at[ok]]
        f = fingerprint(keys)
        by = np.argsort(f)  # ascending keys are found several times as fast
        f = f[by]
        at, ok = found_in(f, prints)
        by, f, n = by[ok], f[ok], small[at[ok]]
        counts[by] = n
        if (many := np.flatnonzero(n == 255)).size:
            counts[by[many]] = large_counts[np.searchsorted(large, f[many])]
        if (none := by[n == 0]).size:  # n-grams of training share this fingerprint: they are told apart by whole keys
            at, ok = found_in(keys[none], shared)
            counts[none[ok]] = shared_counts[at[ok]]

    def score(self, tokens: np.ndarray, priors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 P of each token after its prior ones, log10 of the base, and whether training has the token."""
        w, of = np.unique(tokens, return_inverse=True)
        values = self.word_values(w)
        base = np.log10((values[:, 0] + 1) / (self.tokens + self.vocabulary + 1))
        k = values[:, 1]
        p = (self.word_rest / (self.vocabulary + 1) + np.maximum(k - self.word_discount[np.minimum(k, 3).astype(int)], 0) / max(self.types, 1))[of]
        contexts = contexts_of([x >> _LOW for x in priors])
        short = tokens >> _LOW
        hot = among_hot(contexts, self.hots)
        for j, d in enumerate(self.discounts):
            total, off, c = self.looked_up(contexts[: j + 1], short, hot, d)
            new = total == 0
            c[new], off[new], total[new] = 0, 1, 1  # an unknown context leaves all to the shorter one
            p = (np.maximum(c - d[np.minimum(c, 3).astype(np.int8)], 0) + off * p) / total
        return np.log10(p), base[of], (values[:, 0] > 0)[of]


def train(docs: DataFrame, order: int = 2) -> Model:
    """The model of docs (text) of an order of 2 or more, its arrays in the shared folder."""
    if order < 2:
        raise ValueError(f"an order of 2 or more, not {order}")
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("binary").alias("text"))

    def flushed(batches, make):
        """make(tokens, sizes) for every FLUSH tokens or so."""
        held, size = [], 0
        for b in slices(batches):
            t, s = token_hashes([x.as_py() for x in b.column("text")])
            held.append((t, s))
            size += len(t)
            if size > FLUSH:
                yield from make(np.concatenate([t for t, _ in held]), np.concatenate([s for _, s in held]))
                held, size = [], 0
        if size:
            yield from make(np.concatenate([t for t, _ in held]), np.concatenate([s for _, s in held]))

    def count_words(batches):
        def make(tokens, sizes):
            w, n = np.unique(tokens, return_counts=True)
            for a in range(0, len(w), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(w[a : a + 100_000]), np.int32)), pa.array(w[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], ["len", "w", "n"])
            # Contexts above 1/(2 HOT) of these tokens: what is above 1/HOT of all is above 1/(2 HOT) by these counts alone.
            for j, u in enumerate(contexts_of([p >> _LOW for p in priors_of(tokens, sizes, order)])[1:], 2):
                w, n = np.unique(u, return_counts=True)
                often = n > len(tokens) / (2 * HOT)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(often.sum(), j, np.int32)), pa.array(w[often].view(np.int64)), pa.array(n[often])], ["len", "w", "n"])
        yield from flushed(batches, make)

    counts = kept(texts.mapInArrow(count_words, "len int, w long, n long").groupBy("len", "w").agg(F.sum("n").alias("n")), "words")
    unigrams = counts.where("len = 0").drop("len")
    tokens, vocabulary = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = max(2, math.ceil(math.log2(max(1, tokens / SHARD))))
    word_bits = max(2, math.ceil(math.log2(max(1, vocabulary / SHARD * 4))))
    often = [r["w"] for r in unigrams.where(F.col("n") > tokens / HOT).select("w").collect()]  # fewer than HOT rows
    hots = [np.unique(np.append(np.array(often, np.int64).view(np.uint64), START) >> _LOW)]
    longer = counts.where((F.col("len") > 0) & (F.col("n") > tokens / (2 * HOT))).collect()  # fewer than 2 HOT rows of a length
    hots += [np.array(sorted(r["w"] for r in longer if r["len"] == j), np.uint64) for j in range(2, order)]
    uri = shared_dir(spark, "ngram-model")
    path = local_path(uri)

    def count_ngrams(batches):
        def make(tokens, sizes):
            rows = packed([p >> _LOW for p in priors_of(tokens, sizes, order)], tokens >> _LOW, np.ones(len(tokens), np.int64), hots, bits)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["key", "found"])
        yield from flushed(batches, make)

    def builder(level: int):
        def build(t: pa.Table) -> pa.Table:
            shard = t.column("key")[0].as_py()
            priors, w, n = unpacked(t.column("found").to_pylist(), level)
            u = contexts_of(priors)[-1]
            by = by_context(u, w)
            u, w, n = u[by], w[by], n[by]
            first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
            n = np.add.reduceat(n, first)
            u, w, priors = u[first], w[first], [p[by[first]] for p in priors]
            keys = keys_of(u, w)
            by = np.argsort(keys)
            keys, count = keys[by], n[by]
            f = fingerprint(keys)
            new = np.r_[True, f[1:] != f[:-1], True]
            alone, one = new[:-1] & new[1:], new[:-1]  # fingerprints of one n-gram, and the first of each
            big = alone & (count >= 255)
            small = np.where(alone, np.minimum(count, 255), 0)[one].astype("u1")
            at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            sums = np.stack([np.add.reduceat(x, at) for x in (n, n == 1, n == 2, n > 2)], axis=1).astype(np.int64)
            ctx = u[at]
            is_hot = np.isin(ctx, hots[level - 2])
            single = ~is_hot & (sums[:, 0] == 1)
            large = ~is_hot & (sums[:, 0] >= 255)
            held = ~is_hot & ~single & ~large
            write(f"{path}/pair-{level}-{shard}", f[one], small, f[big], count[big].astype("<u8"), keys[~alone], count[~alone].astype("<u8"), ctx[held], sums[held].astype("u1").reshape(-1),
                  ctx[large], sums[large].astype("<u8").reshape(-1), np.unique(ctx[single].astype("<u4")))
            rows = [("hot", int(x), None, v.tolist()) for x, v in zip(ctx[is_hot], sums[is_hot], strict=True)]
            rows.append(("stat", 0, None, [int((n == i).sum()) for i in (1, 2, 3, 4)]))
            if level > 2:
                rows += [("pair", s, blob, None) for s, blob in packed(priors[:-1], w, np.ones(len(w), np.int64), hots, bits)]
            else:
                w.sort()
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                k, w = np.diff(np.r_[first, len(w)]), w[first]
                ends = np.searchsorted(w, np.arange((1 << word_bits) + 1, dtype=np.uint64) << np.uint64(40 - word_bits))
                rows += [("word", s, joined(np.frombuffer(_five(w[a:z]), np.uint8), k[a:z].astype("<u4") if k[a:z].max() > 255 else k[a:z].astype("u1")), None) for s, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
            return pa.table({"kind": [r[0] for r in rows], "key": pa.array([r[1] for r in rows], pa.int64()), "found": pa.array([r[2] for r in rows], pa.binary()), "sums": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})
        return build

    total = lambda df, n: [df.agg(F.sum(F.col("sums")[i])).first()[0] or 0 for i in range(n)]
    blobs, pair_discounts, hot_sums = texts.mapInArrow(count_ngrams, "key long, found binary"), [], []
    for level in range(order, 1, -1):
        counted = kept(blobs.groupBy("key").applyInArrow(builder(level), "kind string, key long, found binary, sums array<long>"), f"pairs-{level}")
        pair_discounts.insert(0, discounts(total(counted.where("kind = 'stat'"), 4)))
        found = {r[0]: list(r)[1:] for r in counted.where("kind = 'hot'").groupBy("key").agg(*(F.sum(F.col("sums")[i]) for i in range(4))).collect()}  # 2 HOT rows at most
        hot_sums.insert(0, np.array([found.get(int(u), [0] * 4) for u in hots[level - 2]], np.float64).reshape(-1, 4))
        blobs = counted.where("kind = 'pair'").select("key", "found")

    def build_words(key, left: pa.Table, right: pa.Table) -> pa.Table:
        s = key[0].as_py()
        w = left.column("w").to_numpy().view(np.uint64)
        order = np.argsort(w)
        w, n = w[order], left.column("n").to_numpy()[order]
        ks, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for blob in right.column("found").to_pylist():
            x, k = split(blob, "u1", "u1")
            x = _from_five(x)
            ks.append(x)
            vs.append((k if len(k) == len(x) else k.view("<u4")).astype(np.int64))
        x, back = np.unique(np.concatenate(ks), return_inverse=True)
        k = np.bincount(back, np.concatenate(vs), len(x))
        at = np.minimum(np.searchsorted(x, w >> _LOW), max(len(x) - 1, 0))
        contexts = np.where(x[at] == w >> _LOW, k[at], 0).astype("<u8") if len(x) else np.zeros(len(w), "<u8")
        write(f"{path}/word-{s}", w, n.astype("<u8"), contexts)
        return pa.table({"sums": pa.array([[int(contexts.sum()), *(int((contexts == i).sum()) for i in (1, 2, 3, 4)), int((contexts > 2).sum())]], pa.list_(pa.int64()))})

    # The top bits of the word, as the arrays' shards.
    top = F.shiftrightunsigned("w", 64 - word_bits).cast("int")
    of_words = counted.where("kind = 'word'").select(F.col("key").cast("int").alias("at"), "found")
    word_stats = kept(unigrams.withColumn("shard", top).groupBy("shard").cogroup(of_words.groupBy("at")).applyInArrow(build_words, "sums array<long>"), "word-stats")
    types, *word_n, more = total(word_stats, 6)
    d = discounts(word_n)
    stats = {
        "tokens": tokens, "vocabulary": vocabulary, "types": types, "discounts": pair_discounts, "word_discount": d,
        "word_rest": (d[1] * word_n[0] + d[2] * word_n[1] + d[3] * more) / types if types else 1.0,
    }
    return Model(path, bits, word_bits, hots, hot_sums, stats)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # paths, discounts and hot contexts
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches):
        m = shared.value
        for b in slices(batches):
            tokens, sizes = token_hashes([x.as_py() for x in b.column("text")])
            priors, ends = priors_of(tokens, sizes, len(m.hots) + 1), np.cumsum(sizes)
            sums = np.zeros((3, len(tokens)))
            for a in range(0, len(tokens), CHUNK):
                sums[:, a : a + CHUNK] = m.score(tokens[a : a + CHUNK], [p[a : a + CHUNK] for p in priors])
            by_text = np.add.reduceat(sums, ends - sizes, axis=1) if len(sizes) else np.zeros((3, 0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(by_text[2].astype(np.int64)), pa.array(by_text[1]), pa.array(by_text[0])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 7) == 2, F.lit(False))


def op1_ngram_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))), ORDER)
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
