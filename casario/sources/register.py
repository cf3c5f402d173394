"""The national register of addresses: zipped CSV members, nine columns by name, and the tables derived from it."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds
from ..operators.history import require_rows
from ..operators.market import street_to_cep
from .indices import UnexpectedLayout

#: Municipalities by code, the columns that are kept, those that must be there.
MUNICIPALITIES = {"3548500": "Santos", "3550308": "Sao Paulo", "3551009": "Sao Vicente", "3518701": "Guaruja", "3541000": "Praia Grande", "3513504": "Cubatao", "3506359": "Bertioga"}
COLUMNS = ("cod_municipio", "cep", "dsc_localidade", "nom_tipo_seglogr", "nom_titulo_seglogr", "nom_seglogr", "latitude", "longitude", "nv_geo_coord")
NEEDED = ("cep", "nom_seglogr")
#: Least length of a street's key.
LEAST = 4


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """arquivo, celulas of every line of the first CSV member of each zip file (latin-1, parted by ;); the header names the columns.

    A zip can't be split: a file is a task, which streams its member in batches of lines. No CSV member is an error.
    """
    import csv

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    members = [m for m in z.namelist() if m.lower().endswith(".csv")]
                    if not members:
                        raise UnexpectedLayout(f"{name} holds no CSV")
                    with z.open(members[0]) as f:
                        lines = csv.reader(io.TextIOWrapper(f, "latin-1", newline=""), delimiter=";")
                        head = [h.strip().lower() for h in next(lines, [])]
                        missing = [c for c in NEEDED if c not in head]
                        if missing:
                            raise UnexpectedLayout(f"{name} lacks {missing}")
                        at = [head.index(c) if c in head else None for c in COLUMNS]
                        held: list[list] = []
                        for line in lines:
                            held.append([line[i] or None if i is not None and i < len(line) else None for i in at])
                            if len(held) == 10_000:
                                yield _batch(name, held)
                                held = []
                        if held:
                            yield _batch(name, held)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.repartition("path").mapInArrow(run, "arquivo string, " + ", ".join(f"{c} string" for c in COLUMNS))


def _batch(name: str, rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], ["arquivo", *COLUMNS])


def projected(df: DataFrame) -> DataFrame:
    """The nine columns of df, whatever the case of their names; missing ones null, but cep and nom_seglogr must be there. cep: digits only."""
    own = {c.lower(): c for c in df.columns}
    missing = [c for c in NEEDED if c not in own]
    if missing:
        raise UnexpectedLayout(f"columns {missing} are missing among {sorted(own)[:12]}")
    out = df.select(*((F.col(f"`{own[c]}`") if c in own else F.lit(None)).cast("string").alias(c) for c in COLUMNS))
    return out.withColumn("cep", F.regexp_replace("cep", r"\D", ""))


def write_register(df: DataFrame, root: str, year: str = "2022") -> None:
    """Addresses by municipality and census year: {cod}/{ano}/*.parquet; none is an error. Only the municipalities of df are replaced."""
    for code in [r[0] for r in require_rows(df, "register").select("cod_municipio").distinct().limit(10_000).collect()]:  # municipalities
        if not code:
            raise ValueError("addresses without a municipality")
        df.where(F.col("cod_municipio") == code).write.mode("overwrite").parquet(f"{root}/{code}/{year}")


def read_register(spark: SparkSession, root: str) -> DataFrame:
    """All municipalities and years, with municipio (its name, else its code) and ano_censo; the keys come from the folders."""
    d = spark.read.parquet(f"{root}/*/*/").withColumn("_f", F.col("_metadata.file_path"))
    code = F.regexp_extract("_f", r"/([^/]+)/([^/]+)/[^/]+$", 1)
    names = F.create_map(*[F.lit(x) for pair in MUNICIPALITIES.items() for x in pair])
    own = F.col("cod_municipio") if "cod_municipio" in d.columns else code
    return d.withColumns({"cod_municipio": own, "municipio": F.coalesce(names[code], code), "ano_censo": F.regexp_extract("_f", r"/([^/]+)/([^/]+)/[^/]+$", 2)}).drop("_f")


def street_lookup(addresses: DataFrame) -> DataFrame:
    """municipio, chave, cep (the most frequent, the greatest of equals), n_enderecos and n_ceps of each street.

    Only CEPs of eight digits and keys of LEAST characters or more count.
    """
    parts = F.concat_ws(" ", *(F.trim(F.coalesce(c, F.lit(""))) for c in ("nom_tipo_seglogr", "nom_titulo_seglogr", "nom_seglogr")))
    t = addresses.where(F.char_length("cep") == 8).select("municipio", F.trim(F.regexp_replace(parts, r"\s+", " ")).alias("_s"), "cep")
    counted = folds.folded(t, "_s", "street_key", "chave").where(F.char_length("chave") >= LEAST)
    return street_to_cep(counted, "municipio", "chave", "cep")


def point_lookup(addresses: DataFrame) -> DataFrame:
    """municipio, cep, median lat and lon, n_enderecos with a point of each CEP of eight digits.

    A CEP is a stretch of street, so a group of the exact median is small.
    """
    num = lambda c: F.col(c).try_cast("double")
    t = addresses.where(F.char_length("cep") == 8).select("municipio", "cep", num("latitude").alias("lat"), num("longitude").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    return t.groupBy("municipio", "cep").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count("*").alias("n_enderecos"))
