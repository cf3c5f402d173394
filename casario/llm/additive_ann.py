"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of STAGES full-dimensional codewords, one of each residual codebook. The codebooks
are fitted on a bounded sample (SAMPLE rows of smallest id hash); every row is encoded by beam search and stored with
its codes, the squared norm of its approximation and its residual's length. A query scores codes by lookup tables
(inner products with all codewords, stored norms); rows whose estimate may be among the k nearest, by the spread of
the estimate, are then ranked by exact distance. No fixed number of candidates is set: a tight group of near-equal
vectors, which codes can't tell apart, becomes candidates as a whole.

Blocks: vectors stay in their partitions. Queries are written once to the shared folder as Arrow files, which the
workers memory-map; a task takes its rows in blocks of BLOCK and the queries in steps of QUERIES, and sends the k best
of a block for each query, which meet in a window per query. Codes need one byte a stage. All rows are scored for all
queries: the work grows with their product, the traffic with the queries times the blocks.

Edge cases: vectors that are null or zero, that hold null or non-finite components, or that have another length than
most of the sample take no part, as queries or candidates, nor do rows of a null id. Equal distances rank by the smaller id. Rows of one id
are candidates each, but never of a query of that id; its different vectors are queries of their own. Fewer rows than k: all of them. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, local_path, shared_dir, table

STAGES = 8
WORDS = 256
BEAM = 8
SAMPLE = 16_384
BLOCK = 8_192
QUERIES = 64
#: Half-width of an estimate, in standard deviations of its error.
Z = 2.5


def usable(v: Column) -> Column:
    """A vector without null or non-finite components, and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def codebooks(x: np.ndarray, stages: int = STAGES, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """stages x words x dimensions, each fitted to what the ones before leave."""
    rng, left, out = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(stages):
        c = kmeans(left, min(words, len(left)), rng).astype(np.float32)
        if len(c) < words:
            c = np.vstack([c, np.repeat(c[:1], words - len(c), axis=0)])
        out.append(c)
        left = left - c[np.argmin((c * c).sum(axis=1) - 2 * left @ c.T, axis=1)]
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x stages) and approximations, by beam search over the stages."""
    n, d = x.shape
    left, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
    for c in books:
        cost = (left * left).sum(axis=2)[:, :, None] + (c * c).sum(axis=1) - 2 * left @ c.T
        flat = cost.reshape(n, -1)
        b = min(beam, flat.shape[1])
        best = np.argpartition(flat, b - 1, axis=1)[:, :b]
        parent, word = best // len(c), best % len(c)
        rows = np.arange(n)[:, None]
        left = left[rows, parent] - c[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    one = np.argmin((left * left).sum(axis=2), axis=1)
    return codes[np.arange(n), one], x - left[np.arange(n), one]


def build(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.ndarray | None]:
    """The index (id, vector, codes, norm, err), written to the shared folder, and its codebooks."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(sample):
        return rows, None
    sizes, times = np.unique([len(v) for v in sample], return_counts=True)
    dim = int(sizes[times == times.max()].max())
    books = codebooks(np.array([v for v in sample if len(v) == dim]))
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            vec = b.column("vector")
            x = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            done = [encode(x[a : a + 512], shared.value) for a in range(0, len(x), 512)]
            codes, near = np.vstack([c for c, _ in done]), np.vstack([y for _, y in done]).astype(np.float64)
            err = np.sqrt(((x - near) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("id"), vec, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((near * near).sum(axis=1)), pa.array(err)], ["id", "vector", "codes", "norm", "err"])

    index = rows.where(F.size("vector") == dim).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>, codes binary, norm double, err double")
    return kept(index, "ann-index"), books


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, err: np.ndarray, books: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for each query: positions of the queries and of the rows, and distances."""
    tables = np.einsum("qd,mwd->mqw", q, books.astype(np.float64))
    dot = np.zeros((len(q), len(x)))
    for m in range(codes.shape[1]):
        dot += tables[m][:, codes[:, m]]
    guess = np.maximum(norm - 2 * dot + (q * q).sum(axis=1, keepdims=True), 0) + err * err
    spread = Z * 2 * np.sqrt(guess) * err / np.sqrt(x.shape[1])
    mine = ids[None, :] != q_ids[:, None]
    upper = np.where(mine, guess + spread, np.inf)
    limit = np.partition(upper, k - 1, axis=1)[:, k - 1 : k] if len(x) >= k else np.full((len(q), 1), np.inf)
    near = mine & (guess - spread <= limit)
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(near[i])
        d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
        top = np.lexsort((ids[at], d))[:k]
        out.append((np.full(len(top), i), at[top], d[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row that ``queries`` (a predicate on ``id``) selects."""
    spark = vectors.sparkSession
    index, books = build(vectors, id_col, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    if books is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    shared, dim = spark.sparkContext.broadcast(books), books.shape[2]
    path = local_path(shared_dir(spark, "ann-queries"))
    asked = kept(index.where(queries).select("id", "vector").dropDuplicates(["id", "vector"]), "ann-asked")

    def write(batches):
        os.makedirs(path, exist_ok=True)
        own = f"{path}/part-{TaskContext.get().partitionId()}"
        new, n = f"{own}.{os.getpid()}.{os.urandom(4).hex()}", 0
        with open(new, "wb") as f:
            writer = None
            for b in batches:
                writer = writer or pa.ipc.new_file(f, b.schema)
                for a in range(0, b.num_rows, QUERIES):
                    writer.write_batch(b.slice(a, QUERIES))
                n += b.num_rows
            if writer:
                writer.close()
        # Whole files only: a repeated task replaces its own.
        os.replace(new, f"{own}.arrow") if n else os.remove(new)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    asked.mapInArrow(write, "n long").agg(F.sum("n")).collect()

    def run(batches):
        held, n = [], 0

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            of = {c: t.column(c).combine_chunks() for c in ("id", "codes", "norm", "err", "vector")}
            ids, x = of["id"].to_numpy(zero_copy_only=False), _matrix(of["vector"], dim)
            codes = np.frombuffer(b"".join(of["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
            for file in sorted(Path(path).glob("*.arrow")):
                with pa.memory_map(str(file)) as f:
                    reader = pa.ipc.open_file(f)
                    for i in range(reader.num_record_batches):
                        b = reader.get_batch(i)
                        q = _matrix(b.column("vector"), dim)
                        at, row, d = best(b.column("id").to_numpy(zero_copy_only=False), q, ids, x, codes, of["norm"].to_numpy(), of["err"].to_numpy(), shared.value, k)
                        marks = pa.array([f"{file.stem}-{i}-{j}" for j in at], pa.string())
                        yield pa.RecordBatch.from_arrays([marks, b.column("id").take(pa.array(at)), of["id"].take(pa.array(row)), pa.array(d)], ["query", "query_id", "vec_id", "score"])

        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                held.append(b.slice(a, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield from block()
                    held, n = [], 0
        if n:
            yield from block()

    found = index.mapInArrow(run, f"query string, query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query", "query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_additive_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
