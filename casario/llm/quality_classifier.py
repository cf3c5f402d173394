"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Random indexing: every token has a fixed sparse ternary index vector (from its hash); a token's word vector is the sum
of the index vectors of its neighbours over the whole corpus. A task sums them for the distinct tokens of a window of
its texts and sends the sums as compact blobs to shards by the token's hash; sums over windows merge exactly and in any
order. A shard keeps one vector for each token seen MIN_COUNT times or more, of unit length, in a sorted array of the
shared folder, which workers memory-map: nothing of the vocabulary passes through the driver or is broadcast.

A document's input is the mean and the spread of its tokens' vectors, the share of tokens that have one and the
logarithm of its length. The network is fitted on the driver on at most SAMPLE labelled documents (those of smallest
hash), a documented bound; a temperature fitted on a fifth of them makes its outputs probabilities (1 below 50
documents). Labels, language, source and doc_id are never inputs.

Edge cases: a null or empty text is a zero vector of length 0 and gets a score. Labels other than 0 and 1, null ids,
ids with labels of both kinds and labels without a document are ignored. Repeated rows are scored each and count each in the corpus,
but once among the labelled ones. With fewer than two labelled documents or only one class the score is the share of label 1 (0.5 without
labels). Columns other than the named ones are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, hashes, kept, local_path, mixed, shared_dir, slices, table, trim, trimmed, with_columns_of_text
from .hash_arrays import Files, joined, split, write

DIM = 64
NONZERO = 2
NEAR = 2
#: Least count of a token that has a vector of its own; rarer ones have seen too few neighbours for one.
MIN_COUNT = 5
#: Tokens of a window, of a step within it, and of a shard.
WINDOW, STEP, SHARD = 1_000_000, 50_000, 2_000_000
HIDDEN = 32
#: Most labelled documents that the network is fitted on.
SAMPLE = 20_000
CUT = 0.3
INPUTS = 2 * DIM + 2
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+")


def index_vectors(h: np.ndarray) -> np.ndarray:
    """The index vectors of hashes: NONZERO entries of +1 or -1 in each row."""
    out, rows = np.zeros((len(h), DIM), np.int8), np.arange(len(h))
    for k in range(NONZERO):
        m = mixed(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        out[rows, (m % np.uint64(DIM)).astype(np.int64)] += np.where(m >> np.uint64(63), 1, -1).astype(np.int8)
    return out


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of a text's tokens."""
    return hashes(_TOKEN.findall(text)) if text else np.zeros(0, np.uint64)


def window_sums(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of texts, ascending, how often each occurs and the sums of its neighbours' index vectors."""
    distinct, of = np.unique(np.concatenate(texts), return_inverse=True)
    index = np.vstack([index_vectors(distinct), np.zeros((1, DIM), np.int8)])
    ends = np.cumsum([len(t) for t in texts])
    # NEAR places for "none" behind each text part it from the next.
    at = np.full(len(of) + NEAR * len(texts), -1, np.int32)
    at[np.arange(len(of)) + NEAR * np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))] = of
    sums = np.zeros((len(distinct), DIM), np.int32)
    for a in range(0, len(at), STEP):
        first, last = max(a - NEAR, 0), min(a + STEP + NEAR, len(at))
        near, wide = np.zeros((last - first, DIM), np.int8), index[at[first:last]]
        for k in range(1, NEAR + 1):
            near[k:] += wide[:-k]
            near[:-k] += wide[k:]
        own = at[a : a + STEP]
        order = np.argsort(own, kind="stable")
        order = order[np.searchsorted(own[order], 0) :]
        if len(order):
            starts = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
            sums[own[order][starts]] += np.add.reduceat(near[a - first :][order], starts, axis=0, dtype=np.int32)
    return distinct, np.bincount(of, minlength=len(distinct)), sums


def _blob(h: np.ndarray, n: np.ndarray, sums: np.ndarray) -> bytes:
    """Tokens, counts and sums, a byte an entry but for the rows that need more; compressed."""
    wide = np.flatnonzero((sums.max(axis=1) > 127) | (sums.min(axis=1) < -127))
    small = sums.astype(np.int8)
    small[wide] = 0
    raw = joined(h, n.astype("<u4"), small.reshape(-1), wide.astype("<u4"), sums[wide].astype("<i4").reshape(-1))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unblob(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    h, n, small, wide, sums = split(raw, "<u8", "<u4", "i1", "<u4", "<i4")
    return h, n, small.reshape(-1, DIM), wide, sums.reshape(-1, DIM)


class Vectors:
    """Word vectors in sorted arrays of the shared folder, by the top bits of the token's hash."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits, self.files = path, bits, Files()

    def of(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of ascending distinct tokens (zero without one), and whether each has one."""
        out, has = np.zeros((len(distinct), DIM), np.float32), np.zeros(len(distinct), bool)
        shards = (distinct >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(distinct) else []
        for a, z in zip(cuts, [*cuts[1:], len(distinct)], strict=True) if len(distinct) else []:
            found = self.files.arrays(f"{self.path}/vectors-{shards[a]}", "<u8", "<f2")
            if found is None or not len(found[0]):
                continue
            at = np.minimum(np.searchsorted(found[0], distinct[a:z]), len(found[0]) - 1)
            ok = found[0][at] == distinct[a:z]
            has[a:z] = ok
            out[a:z][ok] = found[1].reshape(-1, DIM)[at[ok]]
        return out, has


def word_vectors(docs: DataFrame, min_count: int = MIN_COUNT) -> Vectors:
    """The word vectors of all docs (text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, math.ceil(math.log2(max(1, size / 5 / SHARD))))
    path = local_path(shared_dir(spark, "word-vectors"))

    def run(batches):
        def out(held):
            h, n, sums = window_sums(held)
            ends = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            rows = [(s, _blob(h[a:z], n[a:z], sums[a:z])) for s, (a, z) in enumerate(zip([0, *ends], [*ends, len(h)], strict=True)) if z > a]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["shard", "sums"])

        held, size = [], 0
        for b in slices(batches):
            for t in b.column("text"):
                held.append(tokens(t.as_py()))
                size += len(held[-1])
                if size > WINDOW:
                    yield out(held)
                    held, size = [], 0
                    trim()
        if size:
            yield out(held)

    def build(t: pa.Table) -> pa.Table:
        found = [_unblob(x) for x in t.column("sums").to_pylist()]
        h, n = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        often = np.add.reduceat(n[order], first) >= min_count
        own = h[order][first][often]
        sums = np.zeros((len(own), DIM), np.int64)
        for f in found:
            at = np.minimum(np.searchsorted(own, f[0]), max(len(own) - 1, 0))
            ok = own[at] == f[0] if len(own) else np.zeros(len(f[0]), bool)
            sums[at[ok]] += f[2][ok]  # the tokens of a blob are distinct
            wide = ok[f[3]]
            sums[at[f[3][wide]]] += f[4][wide]
        norm = np.sqrt((sums.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        write(f"{path}/vectors-{t.column('shard')[0].as_py()}", own, (sums / np.where(norm > 0, norm, 1)).astype("<f2").reshape(-1))
        return pa.table({"n": pa.array([len(own)], pa.int64())})

    texts.mapInArrow(trimmed(run), "shard int, sums binary").groupBy("shard").applyInArrow(build, "n long").agg(F.sum("n")).collect()
    return Vectors(path, bits)


def pooled(texts: list[bytes | None], vectors: Vectors) -> np.ndarray:
    """Mean and spread of each text's word vectors, the share of tokens with a vector, and the logarithm of its length."""
    out = np.zeros((len(texts), INPUTS), np.float32)
    each = [tokens(t) for t in texts]
    distinct, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
    values, has = vectors.of(distinct)
    at = 0
    for i, t in enumerate(each):
        if n := len(t):
            u, k = np.unique(of[at : at + n], return_counts=True)
            at += n
            v, w = values[u], (k / n).astype(np.float32)
            mean = w @ v
            out[i, :DIM] = mean
            out[i, DIM : 2 * DIM] = np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
            out[i, -2] = w[has[u]].sum()
        out[i, -1] = np.log1p(n) / 10
    return out


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7) -> dict:
    """Two layers (tanh, logistic) by Adam; every fifth row is kept aside for the temperature."""
    if len(y) < 2 or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, y = (x - mean) / sd, y.astype(np.float64)
    aside = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    zt, yt = z[~aside], y[~aside]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(yt)), max(1, len(yt) // 128)):
            h = np.tanh(zt[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt[at]) / len(at)
            dh = np.outer(d, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((zt[at].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d, np.array([d.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    net = {"mean": mean, "sd": sd, "p": p, "t": 1.0}
    if aside.any():
        logit, ya = logits(net, x[aside]), y[aside]
        loss = lambda t: np.logaddexp(0, np.where(ya > 0, -logit, logit) / t).mean()
        net["t"] = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    p = net["p"]
    return (np.tanh(((x - net["mean"]) / net["sd"]) @ p[0] + p[1]) @ p[2] + p[3][0]) / net["t"]


def probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    if "share" in net:
        return np.full(len(x), net["share"])
    return 1 / (1 + np.exp(-np.clip(logits(net, x), -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Vectors, dict]:
    """Word vectors of all docs and the network fitted on labels (doc_id, quality)."""
    vectors = word_vectors(docs)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_max")).where("quality = _max").drop("_max")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("_print", F.xxhash64("text"))
    # Documents first, then the sample, so that labels without a document take no place in it.
    found = rows.select("doc_id", "_print").distinct().join(known, "doc_id")
    sample = kept(found.orderBy(F.xxhash64("doc_id"), "doc_id", "_print").limit(SAMPLE), "labelled")

    def run(batches):
        for b in slices(batches):
            x = pooled([t.as_py() for t in b.column("text")], vectors)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * INPUTS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_print"), b.column("quality"), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], ["doc_id", "_print", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.join(F.broadcast(sample), ["doc_id", "_print"]).dropDuplicates(["doc_id", "_print"])  # SAMPLE rows
    found = rows.select("doc_id", "_print", "quality", "text").mapInArrow(run, f"doc_id {kind}, _print long, quality int, x array<float>").toPandas()
    found["h"] = [xxhash.xxh3_64_intdigest(str(i)) for i in found["doc_id"]]
    found = found.sort_values(["h", "doc_id", "_print"])
    x = np.array(found["x"].tolist(), np.float32).reshape(len(found), INPUTS)
    return vectors, fit(x.astype(np.float64), found["quality"].to_numpy())


def with_scores(docs: DataFrame, model: tuple[Vectors, dict]) -> DataFrame:
    """docs with score (a column of that name is replaced)."""
    vectors, net = model  # paths and the network's weights

    def make(texts):
        return [pa.array(probabilities(net, pooled(texts, vectors).astype(np.float64)))]

    return with_columns_of_text(docs.drop("score"), "text", [T.StructField("score", T.DoubleType())], make)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod(F.col("doc_id"), 5) != 0)


def filter_quality(docs: DataFrame, model: tuple[Vectors, dict], cut: float = CUT) -> DataFrame:
    """The rows of docs with a score of cut or more, with docs' columns."""
    names = [f"_d{i}" for i in range(len(docs.columns))]  # docs may have a column score
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col("text"))
    return with_scores(own, model).where(F.col("score") >= cut).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_scores(docs, train(docs, training_labels(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
