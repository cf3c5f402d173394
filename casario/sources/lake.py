"""The listing lake: day partitions of raw captures, monthly tables, and their writers.

Raw layout, not hive-style: {uf}/{cidade}/{yyyy}/{mm}/{dd}/{plataforma}/{dominio}/*.parquet. Keys come from the path, and the
month is chosen by a glob, which prunes directories before any file is opened.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folds import slug
from ..functions.pii import gate
from ..operators.history import last_per_key, require_rows, upsert

#: The record: every stage reads and writes exactly these columns and types.
RECORD = T.StructType([T.StructField(n, k) for n, k in (
    ("property_id", T.StringType()), ("source_domain", T.StringType()), ("source_platform", T.StringType()), ("link", T.StringType()),
    ("transaction_type", T.StringType()), ("property_type", T.StringType()), ("address", T.StringType()), ("neighborhood", T.StringType()),
    ("city", T.StringType()), ("state", T.StringType()), ("cep_prefix", T.StringType()), ("cep", T.StringType()), ("price", T.DoubleType()),
    ("condo_fee", T.DoubleType()), ("iptu_tax", T.DoubleType()), ("area_m2", T.DoubleType()), ("area_total_m2", T.DoubleType()),
    ("bedrooms", T.IntegerType()), ("bathrooms", T.IntegerType()), ("suites", T.IntegerType()), ("parking_spots", T.IntegerType()),
    ("floor_level", T.IntegerType()), ("description_clean", T.StringType()), ("amenities", T.ArrayType(T.StringType())),
    ("extraction_date", T.StringType()), ("listing_first_seen", T.StringType()), ("listing_last_seen", T.StringType()))])
REQUIRED = ["property_id", "source_domain", "source_platform", "link", "transaction_type", "extraction_date"]
KEYS = ("uf", "cidade", "ano", "mes", "dia", "plataforma", "dominio")
_PATH = "/([^/]+)/([^/]+)/([0-9]{4})/([0-9]{2})/([0-9]{2})/([^/]+)/([^/]+)/[^/]+$"


def as_record(df: DataFrame) -> DataFrame:
    """Exactly the record's columns: others dropped, missing ones null, each of its type."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields))


def dropped(df: DataFrame) -> list[str]:
    return sorted(set(df.columns) - set(RECORD.fieldNames()))


def with_keys(df: DataFrame) -> DataFrame:
    """df with the keys in its files' paths; files that don't fit the layout are left out."""
    df = df.withColumn("_file", F.col("_metadata.file_path"))
    return df.withColumns({k: F.regexp_extract("_file", _PATH, i + 1) for i, k in enumerate(KEYS)}).where("ano <> ''").drop("_file")


def read_month(spark: SparkSession, root: str, month: str) -> DataFrame:
    """All captures of one month (yyyy-MM) with their keys; none is an error.

    Foreign files of one column with whole and with decimal numbers don't merge in Spark: files are grouped by their
    footers' types, which one job reads, and each group is read and cast to the record.
    """
    year, number = month.split("-")
    files = listed(spark, f"{root}/*/*/{year}/{number}/*/*/*/*.parquet")
    groups: dict[str, list[str]] = {}
    for r in footers(spark, files).collect():  # a row for each file, whose names are here already
        if r["campos"] is None:
            raise OSError(f"{r['arquivo']} is no readable Parquet file")
        groups.setdefault("|".join(c for c in r["campos"] if c.split(":")[0] in RECORD.fieldNames()), []).append(r["arquivo"])
    out = None
    for same in groups.values():
        d = with_keys(spark.read.parquet(*same))
        d = d.select(*KEYS, *((F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise LookupError(f"no captures of {month} in {root}")
    return require_rows(out, f"captures of {month}")


def listed(spark: SparkSession, glob: str) -> list[str]:
    """The files of a glob, by directory listings alone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    return [str(f.getPath()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []]


#: Schemes whose files a task opens by itself and reads from their end; files of other stores come to the tasks whole, by Spark's reader.
OPENED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
#: Files whose footers one task reads.
PER_TASK = 64


def _footer(source) -> tuple[int | None, list[str] | None]:
    """Rows and fields (name:type) of an open Parquet file; None for what is none."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    try:
        f = pq.ParquetFile(source)
        return f.metadata.num_rows, sorted(f"{c.name}:{c.type}" for c in f.schema_arrow)
    except (pa.ArrowException, OSError):
        return None, None


def footers(spark: SparkSession, files: list[str]) -> DataFrame:
    """arquivo, linhas and campos (sorted name:type) from the files' footers, null for what is no Parquet: one job, one task for PER_TASK files."""
    import pyarrow as pa

    kind = "arquivo string, linhas long, campos array<string>"
    if not files:
        return spark.createDataFrame([], kind)
    scheme = files[0].partition(":")[0] if ":" in files[0] else "file"

    def batch(names, found):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.string()))], ["arquivo", "linhas", "campos"])

    def opened(batches):
        from pyarrow import fs

        def one(name: str):
            rest = name.partition(":")[2] if ":" in name else name
            if OPENED[scheme] == "file":
                return _footer("/" + rest.lstrip("/"))
            store, path = fs.FileSystem.from_uri(f"{OPENED[scheme]}:{rest}")
            with store.open_input_file(path) as f:
                return _footer(f)

        for b in batches:
            names = b.column(0).to_pylist()
            yield batch(names, [one(n) for n in names])

    def carried(batches):
        import io

        for b in batches:
            for i in range(b.num_rows):  # one file at a time: only its footer is looked at
                yield batch([b.column(0)[i].as_py()], [_footer(io.BytesIO(b.column(1)[i].as_buffer().to_pybytes()))])

    if scheme in OPENED:
        rows = spark.createDataFrame([(f,) for f in files], "arquivo string").repartition(-(-len(files) // PER_TASK))
        return rows.mapInArrow(opened, kind)
    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(carried, kind)


def months(spark: SparkSession, root: str) -> list[str]:
    """Months with captures, oldest first, from directory names alone."""
    return sorted({"-".join(f.split("/")[-6:-4]) for f in listed(spark, f"{root}/*/*/*/*/*/*/*/*.parquet")})


def path_token(text: str) -> str:
    """Lower-case, dots and underscores kept, anything else a dash."""
    return re.sub(r"[^a-z0-9._-]+", "-", text.strip().lower()).strip("-")


def swap(spark: SparkSession, fresh: str, target: str) -> None:
    """Puts a written folder in another's place by two renames; the old one is moved back if the second fails, and deleted last."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, to, old = (hadoop.Path(p) for p in (fresh, target, f"{target}.old-{uuid.uuid4().hex}"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(to.getParent())
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"{target} can't be moved aside; it stays as it was")
    if not fs.rename(new, to):
        if had and not fs.rename(old, to):
            raise OSError(f"{target} can't be replaced nor moved back; its rows are in {old}")
        raise OSError(f"{target} can't be replaced; it stays as it was")
    if had:
        fs.delete(old, True)


def write_day(new: DataFrame, root: str, state: str, city: str, day: str, platform: str, domain: str) -> str:
    """Upserts one source's day: the gate, then old rows without the new ids and the new rows, then a swap.

    Of several new rows of an id the last seen counts, then the greatest by its whole content. The new partition is
    written beside the old one and replaces it by renames, so that a failed run leaves the old one readable. No rows or
    an unreadable partition is an error.
    """
    spark = new.sparkSession
    content = F.sha2(F.to_json(F.struct(*RECORD.fieldNames())), 256)
    one = last_per_key(require_rows(as_record(new), "records"), ["property_id"], [F.desc_nulls_last("listing_last_seen"), content.desc()])
    one = gate(one, f"{platform}/{domain}")
    to = "/".join((root, slug(state), slug(city), *day.split("-"), path_token(platform), path_token(domain)))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(to)
    had = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    out = upsert(as_record(spark.read.parquet(to)), one, ["property_id"]) if had else one
    fresh = f"{to}.new-{uuid.uuid4().hex}"
    out.repartition("property_id").write.parquet(fresh)
    swap(spark, fresh, to)
    return to


def write_months(df: DataFrame, to: str, keys: tuple[str, ...] = ("uf", "cidade", "ano", "mes")) -> None:
    """Replaces the partitions that df has rows for, and no others; a null key is an error.

    Rows are dealt by partition and month with a few files each, so that a large city isn't one task.
    """
    missing = " OR ".join(f"{k} IS NULL OR {k} = ''" for k in keys)
    if not require_rows(df, "history").where(missing).isEmpty():
        raise ValueError("rows without a partition key")
    df.repartition(*keys, F.pmod(F.xxhash64("property_id"), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(to)


def read_months(spark: SparkSession, root: str, month: str | None = None) -> DataFrame:
    """The monthly table, its keys as text; one month is a partition filter."""
    keys = ("uf", "cidade", "ano", "mes")
    found = spark.read.option("basePath", root).parquet(root).schema
    texts = T.StructType([T.StructField(f.name, T.StringType()) if f.name in keys else f for f in found])
    df = spark.read.schema(texts).option("basePath", root).parquet(root)
    return df if month is None else df.where((F.col("ano") == month[:4]) & (F.col("mes") == month[5:]))


def file_counts(spark: SparkSession, glob: str) -> DataFrame:
    """arquivo and linhas of each file of a glob, from its footer; -1 for one that can't be read or has no ids, which is not the same as 0 rows."""
    known = F.exists("campos", lambda c: c.startswith("property_id:"))
    return footers(spark, listed(spark, glob)).select("arquivo", F.when(known, F.col("linhas")).otherwise(F.lit(-1)).cast("long").alias("linhas"))


def same_after_copy(before: DataFrame, after: DataFrame) -> bool:
    """Whether a migrated lake holds the same rows and ids."""
    sums = lambda d: d.agg(F.count("*"), F.count_distinct("property_id"), F.sum(F.xxhash64("property_id").cast("decimal(38,0)"))).first()
    return sums(before) == sums(after)


def migrate(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Copies partitions of the former layout ({uf}/{cidade}/yyyy-MM-dd/...) to {uf}/{cidade}/yyyy/MM/dd/..., and compares them.

    Files are copied byte by byte; antes, depois (rows) and mesmos (the same rows and ids) of each day are returned. A target that
    is there already is an error, so nothing is overwritten.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{old}/*/*/*-*-*/*/*")
    fs = path.getFileSystem(conf)
    moves = []
    for found in fs.globStatus(path) or []:
        source = str(found.getPath())
        uf, city, day, platform, domain = source.split("/")[-5:]
        if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", day):
            moves.append((source, "/".join((new, uf, city, *day.split("-"), platform, domain))))
    rows = []
    for source, target in moves:
        a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        if fs.exists(b):
            raise FileExistsError(target)
        fs.mkdirs(b.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, b.getFileSystem(conf), b, False, conf)
        before, after = spark.read.parquet(source), spark.read.parquet(target)
        rows.append((source, target, before.count(), after.count(), same_after_copy(before, after)))
    return spark.createDataFrame(rows, "origem string, destino string, antes long, depois long, mesmos boolean")
