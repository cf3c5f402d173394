"""Captures as a stream: each micro-batch is upserted into its month's table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import last_per_key
from ..sources.lake import RECORD, as_record, read_months, write_months


def captures_stream(spark: SparkSession, glob: str) -> DataFrame:
    """New capture files as they arrive."""
    return spark.readStream.schema(RECORD).parquet(glob)


#: Partitions that a batch may name in a filter of the table; a batch of more is matched by a join.
MOST_PARTITIONS = 2_000
KEYS = ("uf", "cidade", "ano", "mes")


def _ledger(spark: SparkSession, to: str, batch: int):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to}/_batches/{batch}.json")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def ledger(spark: SparkSession, to: str) -> DataFrame:
    """lote, linhas (rows of the batch after its own repeats), particoes and when, of each batch that the table holds."""
    return spark.read.schema("lote long, linhas long, particoes array<string>, quando string").json(f"{to}/_batches/*.json")


def upsert_batch(to: str, named: str | None = None):
    """A foreachBatch function: the batch's partitions (city and month) are read, merged (the latest row of a property wins) and replaced.

    Only partitions that the batch has rows for are read or written; the files of all others stay as they are. A batch is
    entered in the table's ledger after its rows; one that is there already, as after a failure, is left out. named sets
    ledgers of several streams apart.
    """
    order = [F.desc("extraction_date"), F.desc("source_domain"), F.desc("price")]

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        fs, entry = _ledger(spark, to, f"{named}-{number}" if named else number)
        if fs.exists(entry):
            return
        keyed = as_record(batch).withColumns({"ano": F.substring("extraction_date", 1, 4), "mes": F.substring("extraction_date", 6, 2), "uf": F.lower("state"), "cidade": F.lower("city")})
        keyed = last_per_key(keyed, ["property_id", *KEYS], order)
        aside = f"{to}.batch-{uuid.uuid4().hex}"  # read and replaced tables can't be one: the merged rows are written beside it first
        keyed.write.parquet(f"{aside}/new")
        keyed = spark.read.schema(keyed.schema).parquet(f"{aside}/new")
        touched = keyed.groupBy(*KEYS).agg(F.count("*").alias("n"))
        some = touched.limit(MOST_PARTITIONS + 1).collect()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        glob = fs.globStatus(path(f"{to}/uf=*"))
        if glob:
            old = read_months(spark, to)
            if len(some) <= MOST_PARTITIONS:  # a filter on partition columns: only their folders are listed and read
                parts = [F.struct(*(F.lit(r[k]) for k in KEYS)) for r in some]
                old = old.where(F.struct(*KEYS).isin(*parts) & F.col("ano").isin(*{r["ano"] for r in some}) & F.col("mes").isin(*{r["mes"] for r in some}) & F.col("uf").isin(*{r["uf"] for r in some}) & F.col("cidade").isin(*{r["cidade"] for r in some}))
            else:
                old = old.join(touched.select(*KEYS), list(KEYS), "left_semi")
            both = last_per_key(keyed.unionByName(old.select(*keyed.columns)), ["property_id", *KEYS], order)
            both.write.parquet(f"{aside}/merged")
            write_months(spark.read.schema(both.schema).parquet(f"{aside}/merged"), to)
        else:
            write_months(keyed, to)
        names = ["/".join(str(r[k]) for k in KEYS) for r in some] if len(some) <= MOST_PARTITIONS else None
        line = spark.range(1).select(F.lit(int(number)).alias("lote"), F.lit(sum(r["n"] for r in some) if names is not None else keyed.count()).alias("linhas"), F.lit(names).cast("array<string>").alias("particoes"), F.current_timestamp().cast("string").alias("quando"))
        out = fs.create(entry, False)
        try:
            out.write(bytearray(line.select(F.to_json(F.struct("*"))).first()[0].encode()))
        finally:
            out.close()
        fs.delete(path(aside), True)

    return run


def start(captures: DataFrame, to: str, checkpoint: str):
    """The running query; availableNow drains what is there and stops."""
    return captures.writeStream.foreachBatch(upsert_batch(to)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
