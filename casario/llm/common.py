"""What the corpus operators share: tables, words, hashes and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space of the word rule: everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Where the setting is missing, only a session on one machine (master local) has a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:/tmp/checkpoints"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The path of a shared folder as the workers' file system mounts it.

    Memory-mapped arrays need a shared folder that executors mount (NFS, Lustre, a FUSE mount); other
    stores raise here rather than fail in the tasks.
    """
    scheme, sep, rest = uri.partition(":")
    if not sep or uri.startswith("/"):
        return uri
    if scheme != "file":
        raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {uri}")
    return "/" + rest.lstrip("/")


def kept(df: DataFrame, what: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    to = shared_dir(df.sparkSession, what)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def slices(batches, rows: int = 500):
    """Record batches of a few hundred texts: what a task unfolds at once stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def trim(heap: bool = True) -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and later stages need the room.

    Without heap only Arrow's: a worker that goes on with a large memo would fault its pages in again.
    """
    pa.default_memory_pool().release_unused()
    if not heap:
        return
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def trimmed(run, heap: bool = True):
    """run(batches) with trim() at its end."""
    def of(batches):
        try:
            yield from run(batches)
        finally:
            trim(heap)

    return of


def words(text: bytes | None) -> list[bytes]:
    """Words of lower-cased (A-Z only) UTF-8 text; bytes.split() splits at exactly the white space of SPACE."""
    return text.lower().split() if text else []


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    a = a ^ (a >> np.uint64(30))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    a = a ^ (a >> np.uint64(27))
    a = a * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def with_columns_of_text(df: DataFrame, text_col: str, added: list[T.StructField], make) -> DataFrame:
    """df with columns that make(texts as UTF-8 bytes) gives as arrays, all other columns unchanged.

    Only the texts go to the workers, once and a few hundred at a time, and only the new columns come back.
    """
    kind, names = T.StructType(added), [f.name for f in added]
    empty = pa.array([], to_arrow_type(kind))

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays(make(texts.slice(a, 500).to_pylist()), fields=list(empty.type)) for a in range(0, len(texts), 500)]
        trim()
        return pa.concat_arrays([empty, *parts])

    made = F.arrow_udf(run, kind).asNondeterministic()  # so that the optimiser never runs it twice
    return df.withColumn("_made", made(F.col(text_col).cast("binary"))).select(*(F.col(f"`{c}`") for c in df.columns), *(F.col("_made")[n].alias(n) for n in names))
