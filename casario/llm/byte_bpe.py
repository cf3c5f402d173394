"""Byte-level BPE as Spark folds over distinct words, and its decoding.

1. Each task finds the distinct matches ("words") of the splitting pattern in its texts; distinct() makes them global.
2. Higher-order functions fold ranked merges over a word's bytes: the state is an array of numbers, one for each piece,
   rank * CELL + place: the rank of the pair it begins and its place in the word. The least one is the leftmost pair of
   least rank; it is merged, two ranks are looked up anew. A last number stands for the word's end. Ranks come from
   one literal: a map of merged bytes to ranks, dealt into buckets by crc32 since Spark scans a map from its start.
3. Words and ids become sorted hash arrays in the shared folder. Workers map them, put each text's ids together from
   its words and decode the ids by joining the vocabulary's byte strings.

Words of more than LONG bytes (runs without a break) are merged in a worker with a heap, by the same ranks, as the fold
takes quadratic time; so is a word whose 64-bit hash another one shares. Nothing of the vocabulary of the corpus goes
through the driver. Bytes are held as ISO-8859-1 characters inside the fold.

Edge cases: a null or empty text has no ids. Repeated rows are encoded each; a null doc_id is an id. Other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashes, kept, local_path, shared_dir, slices, table
from .encoders import _begins, pieces_of
from .hash_arrays import Files, write

BUCKETS = 1 << 14
LONG = 256
#: A power of two beyond the place of any byte of a folded word, its end included.
CELL = 1 << 10
#: Stands for the rank of a pair that is no token; rank and place share an int.
NO_RANK = 2**31 // CELL - 1
#: Entries of a worker's set or memo; when full, it starts anew.
MEMO = 400_000
#: Words of a shard of the arrays.
SHARD = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: an array of BUCKETS maps (from_json of a constant is folded to a literal)."""
    if max(ranks.values()) >= NO_RANK:
        raise ValueError(f"ranks beyond {NO_RANK - 1} are not supported")
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _bound(state: Column, value: Column, body) -> Column:
    """body(state, value), with value found once and, other than by _let, neither copied nor its type asked for at each call."""
    return F.aggregate(F.array(value), state, body)


def fold(word: Column, ranks: Column) -> Column:
    """ids of one word of at most LONG bytes, given as bytes in ISO-8859-1 characters."""
    return _let(word, lambda x: _fold(x, ranks))


def _fold(word: Column, ranks: Column) -> Column:
    rank = lambda x: F.element_at(F.get(ranks, F.crc32(x.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1))), x)
    cut = lambda a, z: F.substring(word, a + 1, z - a)
    cell = lambda r, at: F.coalesce(r, F.lit(NO_RANK)) * CELL + at
    at = lambda x: x.bitwiseAND(F.lit(CELL - 1))
    start = F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: cell(F.when(i + 2 <= F.length(word), rank(cut(i, i + 2))), i))

    def merge(c: Column, m: Column, k: Column) -> Column:
        """c with its k-th cell m (from 1) and the next one as one, and the ranks of the two pairs that this makes."""
        prior, behind = F.get(c, k - 2), F.get(c, k + 2)
        whole = cell(F.when(behind.isNotNull(), rank(cut(at(m), at(behind)))), at(m))
        left = cell(rank(cut(at(prior), at(F.get(c, k + 1)))), at(prior))
        return F.transform(F.array_remove(c, F.get(c, k)), lambda x: F.when(x == m, whole).when(x == prior, left).otherwise(x))

    def step(c: Column, _: Column) -> Column:
        place = lambda c, m: F.array_position(c, m).cast("int")
        return _bound(c, F.array_min(c), lambda c, m: F.when(m >= NO_RANK * CELL, c).otherwise(_bound(c, place(c, m), lambda c, k: merge(c, m, k))))

    merged = F.aggregate(F.sequence(F.lit(2), F.length(word)), start, step)
    ids = _let(merged, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: rank(cut(at(x), at(F.get(c, i + 1))))))
    return F.when(rank(word).isNotNull(), F.array(rank(word))).otherwise(ids)


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one long word, by a heap over a linked list of pieces."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, prior, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, z = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != z:
            continue  # one of its pieces has been merged since
        alive[end[i]] = False
        end[i] = z
        if z < n:
            prior[z] = i
            if (r := ranks.get(word[i : end[z]])) is not None:
                heapq.heappush(heap, (r, i, end[z]))
        if (j := prior[i]) >= 0 and (r := ranks.get(word[j:z])) is not None:
            heapq.heappush(heap, (r, j, z))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def is_chunk(p: str) -> bool:
    """Whether what lies between two blanks, a line feed before it included, is a chunk."""
    return "!" < p < "\x7f" or _begins(p)


def cut(text: str | None, known) -> tuple[str, list[str], set[str]]:
    """pieces_of(text), and those pieces that known lacks; only these are looked at, as known holds nothing but such pieces."""
    if not text:
        return "", [], set()
    first, *rest = text.replace("\n", " \n").split(" ")
    new = {p for p in rest if p not in known}
    if not all(map(is_chunk, new)):
        first, rest = pieces_of(text)
        new = {p for p in rest if p not in known}
    return first, rest, new


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """word: the distinct matches of pattern in docs (text)."""

    def run(batches):
        split, seen, done = regex.compile(pattern), set(), set()

        def out():
            found = list(seen)
            for a in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[a : a + 50_000], pa.string())], ["word"])

        for b in slices(batches):
            for t in b.column("text"):
                first, _, new = cut(t.as_py(), done)
                seen.update(split.findall(first))
                for c in new:
                    seen.update(split.findall(c if c[0] == "\n" else " " + c))
                done.update(new)
            if len(seen) > MEMO:
                yield from out()
                seen.clear()
            if len(done) > MEMO:
                done.clear()
        yield from out()

    return docs.select("text").mapInArrow(run, "word string").distinct()


class Words:
    """Ids of words from the arrays of one dictionary, in a worker."""

    def __init__(self, path: str, bits: int, vocabulary: str, pattern: str):
        self.path, self.bits, self.ranks, self.split, self.files = path, bits, read_ranks(vocabulary), regex.compile(pattern), Files()
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token
        self.pieces = pa.array(pieces, pa.large_binary())
        self.memo: dict[str, bytes] = {}  # chunks behind a blank
        self.old: dict[str, bytes] = {}  # those of the memo before, which move back when they come again

    def look_up(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word."""
        keys = hashes([w.encode() for w in words])
        order = np.argsort(keys)
        shards, out = (keys >> np.uint64(64 - self.bits)).astype(np.int64)[order], {}
        cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(words) else []
        for a, z in zip(cuts, [*cuts[1:], len(words)], strict=True) if len(words) else []:
            known = self.files.arrays(f"{self.path}/words-{shards[a]}", "<u8", "<u4", "<u4")
            if known is None or not len(known[0]):
                continue
            own, ends, ids = known
            asked = order[a:z]
            at = np.minimum(np.searchsorted(own, keys[asked]), len(own) - 1)
            hit = own[at] == keys[asked]
            raw, at = memoryview(ids).cast("B"), at[hit]
            for k, i, j in zip(asked[hit].tolist(), ends[at].tolist(), ends[at + 1].tolist(), strict=True):
                out[words[k]] = bytes(raw[4 * i : 4 * j])
        for w in words:
            if w not in out:  # a long word
                out[w] = np.array(merge_heap(w.encode(), self.ranks), "<u4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a chunk of text that comes again is looked up once."""
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        each = [cut(t, memo) for t in texts]
        new = set().union(*[lacking for *_, lacking in each])
        memo.update((p, old[p]) for p in new if p in old)
        found = {p: self.split.findall(p if p[0] == "\n" else " " + p) for p in new if p not in old}
        lead = [self.split.findall(f) for f, *_ in each]
        ids = self.look_up(list({w for x in (*found.values(), *lead) for w in x}))
        memo.update((p, b"".join([ids[w] for w in x])) for p, x in found.items())
        return [b"".join([ids[w] for w in f]) + b"".join(map(memo.__getitem__, rest)) for f, (_, rest, _) in zip(lead, each, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The byte strings of ids, one after another: the values that Arrow takes from the vocabulary."""
        found = self.pieces.take(pa.array(np.frombuffer(ids, "<u4")))
        _, ends, raw = found.buffers()
        return raw.to_pybytes()[: np.frombuffer(ends, "<i8")[len(found)]] if raw and len(found) else b""


_OPEN: dict[str, Words] = {}


def dictionary(docs: DataFrame, vocabulary: str, pattern: str) -> tuple[str, int]:
    """Path and shard bits of the arrays of all distinct words' ids."""
    spark = docs.sparkSession
    words = kept(distinct_words(docs, pattern), "words")
    bits = max(1, math.ceil(math.log2(max(1, words.count() / SHARD))))
    path = local_path(shared_dir(spark, "bpe-words"))
    latin = F.decode(F.col("word").cast("binary"), "ISO-8859-1")
    folded = words.where(F.octet_length("word") <= LONG).select("word", fold(latin, literal(read_ranks(vocabulary))).alias("ids"))

    def keyed(batches):
        for b in batches:
            h = hashes([w.as_py().encode() for w in b.column("word")])
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - bits)).astype(np.int32)), pa.array(h.view(np.int64)), b.column("ids")], ["shard", "h", "ids"])

    def build(t: pa.Table) -> pa.Table:
        h, lists = t.column("h").to_numpy().view(np.uint64), t.column("ids").combine_chunks()
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
        order, h = order[~(same | np.r_[same[1:], False])], h[~(same | np.r_[same[1:], False])]  # words that share a hash
        lists = lists.take(pa.array(order))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype("<u4")
        write(f"{path}/words-{t.column('shard')[0].as_py()}", h, ends, lists.flatten().to_numpy().astype("<u4"))
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    folded.mapInArrow(keyed, "shard int, h long, ids array<int>").groupBy("shard").applyInArrow(build, "n long").agg(F.sum("n")).collect()
    return path, bits


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, binary) and decoded (binary) of each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    path, bits = dictionary(docs, vocabulary, pattern)

    def run(batches):
        if path not in _OPEN:
            _OPEN.clear()
            _OPEN[path] = Words(path, bits, vocabulary, pattern)
        words = _OPEN[path]
        for b in slices(batches, 100):  # the ids of so many texts stay in a core's cache
            ids = words.encode([t.as_py() for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(list(map(words.decode, ids)), pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = encode(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
