"""Token ids as Parquet files in ascending document order.

Texts are dealt by ranges of doc_id and sorted, each task encodes its range and Spark's committer publishes its file,
so a lost executor costs one task. Ids are a list<int> column, dictionary-encoded (two bytes an id or fewer); doc_id,
n_tokens, part, at (the file's ids before the document) and the metadata are columns of their own, so a reader of
metadata reads no tokens. Row groups and pages are small and the pages are indexed: a range of doc_id reads only the
pages that hold it. A position in the whole is a document's place in its file plus the sums of the files before.

Edge cases: a null or empty text is the end id alone. Rows of equal doc_id are written together in order of their text's
hash, and take their positions in that order. Null ids come first. Extra columns are dropped unless named in ``keep``;
those with one of the operator's own names (OWN) are dropped all the same. An empty table writes an empty file set, and
reads as no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, slices, table, trimmed
from .encoders import opened

#: Parquet writer: bytes of a row group and of a page, rows of a page, dictionary for the ids.
FILES = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "compression": "zstd",
}


OWN = ("doc_id", "n_tokens", "at", "tokens", "part")


def lists(parts: list[bytes]) -> pa.ListArray:
    """Ids of each document, given as little-endian 32-bit bytes, as an Arrow list array."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(docs: DataFrame, vocabulary: str, blanks: bool, end_id: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, n_tokens, at (ids of the partition's rows before) and tokens. docs: doc_id, text and those columns."""
    keep = tuple(c for c in keep if c not in OWN)
    docs = docs.select("doc_id", *keep, F.col("text").cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder, before = opened(vocabulary, blanks), 0
        for b in slices(batches, 1000):
            ids = [coder.encode(t.as_py()) + end for t in b.column("text")]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            at = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(b.column(c) for c in keep), pa.array(sizes), pa.array(at), lists(ids)],
                ["doc_id", *keep, "n_tokens", "at", "tokens"])

    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(trimmed(run, heap=False), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{extra}, n_tokens long, at long, tokens array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, blanks: bool = True, end_id: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Encodes docs (doc_id, text) and writes the files in ascending doc_id order to path: a file for each range of doc_id.

    The ranges are as many as spark.sql.shuffle.partitions, which grows with the data as for any other shuffle.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    encode(ranged, vocabulary, blanks, end_id, keep).withColumn("part", F.spark_partition_id()).write.options(**FILES).parquet(path)


def read_tokens(spark, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "tokens")) -> DataFrame:
    """The chosen columns of the files."""
    return spark.read.parquet(path).select(*columns)


def crc_of_ids(df: DataFrame) -> DataFrame:
    """df with its list column tokens replaced by ids_crc32."""
    others = [c for c in df.columns if c != "tokens"]

    def run(batches):
        for b in batches:
            t = b.column("tokens")
            ends, ids = t.offsets.to_numpy(), t.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(crc, pa.int64())], [*others, "ids_crc32"])

    return df.mapInArrow(run, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in others) + ", ids_crc32 long")


def with_starts(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """df (part, at, ...) with start: the ids of all documents before, in doc_id order. sizes: n_tokens, part of all rows.

    A file takes one row here, so the running sum over the files is over few rows.
    """
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("sum"))
    before = totals.select("part", (F.sum("sum").over(W.orderBy("part")) - F.col("sum")).alias("_before"))
    return df.join(before, "part").withColumn("start", F.col("_before") + F.col("at")).drop("_before", "at")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), to, public_tokenizers.path("byte_bpe_50k.json"), keep=("lang", "source"))
    read = crc_of_ids(read_tokens(spark, to, ("doc_id", "n_tokens", "part", "at", "tokens")))
    return with_starts(read, read_tokens(spark, to, ("n_tokens", "part"))).select("doc_id", "start", "n_tokens", "ids_crc32")
