"""Hard negatives for contrastive training, mined from inverted lists with Cauchy-Schwarz bounds: exact.

An anchor's positives are the rows of its label with the largest inner products; the negatives of a positive are the best rows of
other labels whose score lies in a window that the positive's score sets. K-means centroids, fitted on a bounded sample (SAMPLE
rows of smallest id hash), deal every row to a list. A list stores its centroid and its radius, the largest distance of a row from
it, so that for an anchor a no score in the list is above <a, centroid> + |a| radius or below <a, centroid> - |a| radius. A search
visits lists by falling upper bound, skips those whose bounds lie outside the window, and stops when the bound falls strictly
below the kth score so far (equal bounds may hold a tie with a smaller id). Scores are integer inner products, computed exactly.

Scale: rows move once, to their lists, which are sorted by label and written to the shared folder; workers memory-map them. A list
has about LIST rows (or a MOST_LISTS-th of all): a larger cluster is dealt out by the hash of the id to several lists, each with a centroid and a radius of
its own, so one vector that a third of all rows hold makes many small tight lists. Anchors are dealt by cluster in ranges; a task
holds BATCH anchors, the lists' centroids and their scores for BLOCK rows, and its results need no shuffle. Where vectors form no clusters
no bound prunes and every list is visited: work grows with anchors times rows then, memory doesn't.

Edge cases: rows with a null id, label or vector, or a null component, take no part; nor do vectors of another length than the
most frequent one (of equally frequent ones the greatest) and those of a squared length from 2**62 on, whose scores a long can't hold.
Zero vectors take part. Equal scores rank by the smaller id. Repeated rows are rows each, but a row of the anchor's id is never its
positive or negative. Anchors without positives, and positives without rows in their window, give none. Fewer rows than asked: all.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hash_arrays
from .additive_ann import kmeans
from .common import local_path, shared_dir, table, trim

CLUSTERS, PER_CLUSTER = 256, 64
SAMPLE = 16_384
#: Rows of a list, more where there would be more than MOST_LISTS of them: a worker maps them all, a file each.
LIST, MOST_LISTS = 8_192, 20_000
#: Anchors and rows that are scored at once.
BATCH, BLOCK = 128, 8_192
#: Anchors of a task: their rows are small and their search is not, so their bytes say nothing of a task's size.
ANCHORS = 64
#: Scores below this are exact in double precision, whatever the order of the sum.
EXACT = 2.0**52


def quantised(v: Column, steps: int = 256) -> Column:
    """floor(steps * x) of each component; null for a vector that is null or holds null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(v.isNotNull() & fine, F.transform(v, lambda x: F.floor(x.cast("double") * steps)))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def write_list(path: str, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
    """A list's rows, sorted by label, with its centroid, its radius, the length of its longest row and where labels begin."""
    order = np.lexsort((ids, labels))
    ids, labels, x = ids[order], labels[order], x[order]
    wide = x.astype(np.float64)
    centre = wide.mean(axis=0)
    radius = np.sqrt(((wide - centre) ** 2).sum(axis=1).max())
    own, starts = np.unique(labels, return_index=True)
    stored = _narrow(x)
    head = np.array([radius, np.sqrt((wide * wide).sum(axis=1).max()), stored.itemsize], np.float64)
    hash_arrays.write(path, head, centre, own, np.append(starts, len(ids)).astype(np.int64), ids, stored)


class Lists:
    """The lists of an index, memory-mapped; bounds for anchors."""

    def __init__(self, folder: str, parts: dict[int, int]):
        self.files, self.paths = hash_arrays.Files(), []
        heads, centres = [], []
        for cluster, n in sorted(parts.items()):
            for part in range(n):
                if (a := self._arrays(path := list_path(folder, cluster, part))) is not None:
                    self.paths.append(path)
                    heads.append(a[0])
                    centres.append(a[1])
        self.heads, self.centres = np.array(heads).reshape(-1, 3), np.array(centres)

    def _arrays(self, path: str):
        return self.files.arrays(path, "f8", "f8", "i8", "i8", "i8", "u1")

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each anchor in each list, widened by what rounding may have lost."""
        wide = x.astype(np.float64)
        size = np.sqrt((wide * wide).sum(axis=1))[:, None]
        mid, reach = wide @ self.centres.T, size * self.heads[:, 0]
        slack = 1e-9 * size * (self.heads[:, 0] + np.sqrt((self.centres**2).sum(axis=1))) + 1e-6
        return mid - reach - slack, mid + reach + slack

    def rows(self, at: int):
        """Labels, where they begin, ids and vectors of a list."""
        _, _, labels, starts, ids, raw = self._arrays(self.paths[at])
        return labels, starts, ids, raw.view(f"i{int(self.heads[at, 2])}").reshape(len(ids), -1)

    def scores(self, at: int, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products: in double precision where that holds them, else in 64-bit integers."""
        longest = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        if longest * self.heads[at, 1] < EXACT:
            return x.astype(np.float64) @ rows.T.astype(np.float64)
        return x @ rows.T.astype(np.int64)


def list_path(folder: str, cluster: int, part: int) -> str:
    return f"{folder}/{cluster}-{part}"


class Best:
    """The k best (score, id) so far: larger scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.kth = k, [], [], None

    def reaches(self, bound: float) -> bool:
        """Whether a row of this score at most may still count."""
        return self.kth is None or bound >= self.kth

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.kth is not None:
            better = (scores > self.kth) | ((scores == self.kth) & (ids < self.ids[-1]))
            scores, ids = scores[better], ids[better]
        if not len(scores):
            return
        scores, ids = np.concatenate([np.array(self.scores, np.int64), scores.astype(np.int64)]), np.concatenate([np.array(self.ids, np.int64), ids])
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[top].tolist(), ids[top].tolist()
        self.kth = self.scores[-1] if len(top) == self.k else None


def positives(lists: Lists, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, upper: np.ndarray, k: int) -> list[Best]:
    """The k best other rows of each anchor's label."""
    best = [Best(k) for _ in ids]
    for at, most in _visits(upper):
        if not any(b.reaches(most) for b in best):
            break
        own, starts, row_ids, rows = lists.rows(at)
        for j, label in enumerate(own):
            a = [i for i in np.flatnonzero(labels == label) if best[i].reaches(upper[i, at])]
            for part in _blocks(starts[j], starts[j + 1]) if a else ():
                for i, s in zip(a, lists.scores(at, x[a], rows[part]), strict=True):
                    other = row_ids[part] != ids[i]
                    best[i].add(s[other], row_ids[part][other])
    return best


def negatives(lists: Lists, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, lower: np.ndarray, upper: np.ndarray, wanted: list[tuple[int, int, int]], k: int) -> list[Best]:
    """The k best rows of other labels for each wanted (anchor, least score, greatest score)."""
    best = [Best(k) for _ in wanted]
    for at, most in _visits(upper):
        if not any(b.reaches(most) and most >= lo for b, (_, lo, _) in zip(best, wanted, strict=True)):
            break
        open_ = [j for j, (i, lo, hi) in enumerate(wanted) if lo <= upper[i, at] and lower[i, at] <= hi and best[j].reaches(upper[i, at])]
        if not open_:
            continue
        of: dict[int, list[int]] = {}
        for j in open_:
            of.setdefault(wanted[j][0], []).append(j)
        own, starts, row_ids, rows = lists.rows(at)
        for part in _blocks(0, len(row_ids)):
            block = row_ids[part]
            for (i, those), s in zip(of.items(), lists.scores(at, x[list(of)], rows[part]), strict=True):
                other = block != ids[i]
                found = np.flatnonzero(own == labels[i])
                if len(found):
                    other[max(starts[found[0]] - part.start, 0) : max(starts[found[0] + 1] - part.start, 0)] = False
                s, near = s[other], block[other]
                for j in those:
                    least = wanted[j][1] if best[j].kth is None else max(wanted[j][1], best[j].kth)
                    inside = (s >= least) & (s <= wanted[j][2])
                    if inside.any():
                        best[j].add(s[inside], near[inside])
    return best


def _blocks(a: int, z: int) -> list[slice]:
    return [slice(k, min(k + BLOCK, z)) for k in range(int(a), int(z), BLOCK)]


def _visits(upper: np.ndarray):
    """Lists by the greatest upper bound of a batch of anchors, falling."""
    most = upper.max(axis=0)
    for at in np.argsort(-most, kind="stable"):
        yield int(at), float(most[at])


def mined(lists: Lists, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, n_positives: int, k: int, low: int, high: int):
    """Rows (anchor, positive, rank, negative, positive score, negative score) of a batch of anchors."""
    lower, upper = lists.bounds(x)
    best = positives(lists, ids, labels, x, upper, n_positives)
    wanted, whose = [], []
    for i, b in enumerate(best):
        for score, id_ in zip(b.scores, b.ids, strict=True):
            lo, hi = -(-low * score // 100), high * score // 100
            if lo <= hi:
                wanted.append((i, lo, hi))
                whose.append((int(ids[i]), id_, score))
    for (anchor, positive, score), b in zip(whose, negatives(lists, ids, labels, x, lower, upper, wanted, k), strict=True):
        for rank, (s, negative) in enumerate(zip(b.scores, b.ids, strict=True), 1):
            yield anchor, positive, rank, negative, score, s


def mine(rows: DataFrame, anchors: Column, id_col: str = "id", label_col: str = "label", vec_col: str = "vector", n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` (a predicate on ``id``) selects, whose score is low to high percent of the positive's.

    vec_col holds arrays of integers. Returns anchor_id, positive_id, rank, negative_id, positive_score and negative_score.
    """
    spark = rows.sparkSession
    kind, schema = rows.schema[id_col].dataType.simpleString(), "anchor_id {0}, positive_id {0}, rank int, negative_id {0}, positive_score long, negative_score long"
    v = F.col("vector")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<long>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("n")).head()
    if lengths is None or lengths["n"] == 0:
        return spark.createDataFrame([], schema.format(kind))
    dim = lengths["n"]
    squared = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.where((F.size("vector") == dim) & (squared < 2.0**62))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.transform("vector", lambda x: x.cast("double")).alias("vector")).toPandas()["vector"]
    if not len(sample):
        return spark.createDataFrame([], schema.format(kind))
    x = np.array(sample.tolist())
    centres = kmeans(x, max(1, min(CLUSTERS, len(x) // PER_CLUSTER)), np.random.default_rng(5))
    shared = spark.sparkContext.broadcast(centres)

    def dealt(batches):
        c = shared.value
        half = (c * c).sum(axis=1) / 2
        for b in batches:
            at = [np.argmax(_matrix(b.column("vector").slice(a, 4096), dim) @ c.T - half, axis=1) for a in range(0, b.num_rows, 4096)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.empty(0, np.int64), *at]).astype(np.int32))], ["id", "label", "vector", "cluster"])

    n_anchors = rows.where(anchors).count()
    rows = rows.mapInArrow(dealt, "id long, label long, vector array<long>, cluster int")
    sizes = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row for each centroid
    each = max(LIST, -(-sum(sizes.values()) // MOST_LISTS))
    parts = {c: -(-n // each) for c, n in sizes.items()}
    folder = local_path(shared_dir(spark, "negative-lists"))
    n = F.element_at(F.array(*[F.lit(parts.get(c, 1)) for c in range(len(centres))]), F.col("cluster") + 1)
    lists = rows.withColumn("part", F.pmod(F.xxhash64("id"), n).cast("int")).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "label", "id")

    def stored(batches):
        held, key, total = [], None, 0

        def put():
            ids, labels, vectors = (pa.chunked_array([h.column(c) for h in held]).combine_chunks() for c in ("id", "label", "vector"))
            write_list(list_path(folder, *key), ids.to_numpy(), labels.to_numpy(), _matrix(vectors, dim))
            held.clear()

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("cluster", "part")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, e in zip(cuts, cuts[1:], strict=False):
                if e == a:
                    continue
                if held and tuple(keys[a]) != key:
                    put()
                key = tuple(keys[a].tolist())
                held.append(b.slice(a, e - a))
                total += e - a
        if held:
            put()
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["n"])

    lists.mapInArrow(stored, "n long").agg(F.sum("n")).collect()

    def found(batches):
        index, rest = None, []
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

        def searched(held):
            ids, labels, vectors = (pa.chunked_array([h.column(c) for h in held]).combine_chunks() for c in ("id", "label", "vector"))
            out = list(mined(index, ids.to_numpy(), labels.to_numpy(), _matrix(vectors, dim), n_positives, k, low, high))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        for b in batches:
            index = index or Lists(folder, parts)
            for a in range(0, b.num_rows, BATCH):
                rest.append(b.slice(a, BATCH))
                if sum(r.num_rows for r in rest) >= BATCH:
                    yield searched(rest)
                    rest = []
        if rest:
            yield searched(rest)
        trim()

    asked = rows.where(anchors).repartitionByRange(max(1, -(-n_anchors // ANCHORS)), "cluster", "id").sortWithinPartitions("cluster", "id")
    out = asked.mapInArrow(found, schema.format("long"))
    return out.select(*(F.col(c).cast(kind) if c in ("anchor_id", "positive_id", "negative_id") else F.col(c) for c in out.columns))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("vector")), F.col("id") % 100 == 0, "vec_id")


SQL = """
WITH given AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM given a JOIN given b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""
