"""Published index and inflation series: workbook sheets and API rows to long rows, long rows to one row a month.

A series is long (place, month, field, value): fields end in different months, and a month has the rows it has. One
row a month keeps the ragged edge as nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import require_rows
from ..operators.market import wide

#: Column (from 0), block and label of each field, lines of the header (from 1), column of the date.
BLOCKS = {
    "venda_m2": (17, "Venda", "Preço médio"), "venda_var12": (12, "Venda", "Var. em 12 meses"), "locacao_m2": (37, "Locação", "Preço médio"),
    "locacao_var12": (32, "Locação", "Var. em 12 meses"), "yield_mensal": (42, "Rentabilidade", "mensalizada"),
}
HEADER, DATE = (2, 3, 4), 1
#: Codes of the inflation table's variables, what it covers, marks of absence are any text that is no number.
VARIABLES = {"63": "ipca_mensal", "2265": "ipca_12m", "69": "ipca_ano", "2266": "ipca_indice"}
COVERS = "Brasil"
#: Spread of yields between properties, relative to the median.
SPREAD = {"p10": 0.438 / 0.625, "p90": 0.882 / 0.625}
SPREAD_NOTE = "relativa, medida em Santos (n=151), aplicada ao centro do indice, que nao publica dispersao entre imoveis"


class UnexpectedLayout(ValueError):
    """A source does not look as it should; nothing is read from it."""


def filled_right(cells: Column) -> Column:
    """Texts of a row with each empty cell (null or '') taking the last one to its left; '' before the first."""
    step = lambda a, x: F.concat(a, F.array(F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")))))
    return F.aggregate(cells, F.array().cast("array<string>"), step)


def layout(grid: DataFrame, blocks: dict = BLOCKS, header: tuple[int, ...] = HEADER) -> DataFrame:
    """cidade and motivo of each sheet of grid (cidade, linha, celulas): null where the labels above each column are the expected ones."""
    rows = grid.where(F.col("linha").between(min(header), max(header))).select("cidade", "linha", filled_right(F.transform("celulas", lambda c: c["texto"])).alias("t"))
    heads = grid.select("cidade").distinct().join(rows.groupBy("cidade").agg(F.sort_array(F.collect_list(F.struct("linha", "t"))).alias("rows")), "cidade", "left")  # three rows a sheet
    reason = F.lit(None).cast("string")
    for name, (column, block, label) in reversed(list(blocks.items())):
        above = F.lower(F.array_join(F.transform("rows", _text_at(column)), " "))
        fits = F.contains(above, F.lit(block.lower())) & F.contains(above, F.lit(label.lower()))
        reason = F.when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit(f"{name}: "), F.coalesce(above, F.lit("")))).otherwise(reason)
    return heads.select("cidade", reason.alias("motivo"))


def _text_at(column: int):
    # A header that ends before the column goes on to the end of the sheet.
    return lambda r: F.coalesce(F.get(r["t"], F.lit(column)), F.try_element_at(r["t"], F.lit(-1)), F.lit(""))


def sheet_series(grid: DataFrame, blocks: dict = BLOCKS, header: tuple[int, ...] = HEADER, date: int = DATE) -> DataFrame:
    """cidade, mes_referencia, campo, valor of the sheets whose layout fits; rows without a date and cells without a number are left out.

    grid: cidade, linha (from 1), celulas (tipo: data, numero or texto; texto: yyyy-MM-dd for dates). When no sheet fits, it is an
    error; those that don't fit are in layout(). A workbook has a few dozen sheets of some hundred rows.
    """
    checked = layout(grid, blocks, header)
    good = checked.where("motivo IS NULL").select("cidade")
    if good.isEmpty():
        raise UnexpectedLayout(f"no sheet fits: {[r['motivo'] for r in checked.limit(5).collect()]}")
    at = lambda i: F.get("celulas", F.lit(i))
    rows = grid.join(good, "cidade", "left_semi").where((F.col("linha") > max(header)) & (at(date)["tipo"] == "data"))
    cells = F.array(*(F.struct(F.lit(k).alias("campo"), F.when(at(i)["tipo"] == "numero", at(i)["texto"].try_cast("double")).alias("valor")) for k, (i, _, _) in blocks.items()))
    return rows.select("cidade", F.substring(at(date)["texto"], 1, 7).alias("mes_referencia"), F.explode(cells).alias("c")).select("cidade", "mes_referencia", "c.*").where("valor IS NOT NULL")


def api_series(rows: DataFrame, variables: dict[str, str] = VARIABLES, covers: str = COVERS) -> DataFrame:
    """recorte, mes_referencia, campo, valor of API rows (D2C, D3C, V as texts; the descriptive first row is no data).

    Unknown variables and rows without a period are left out; a value that is no number is null, never 0. No rows at all is an error.
    """
    names = F.create_map(*[F.lit(x) for pair in variables.items() for x in pair])
    known = rows.where(F.col("D2C").isin(*variables) & (F.coalesce("D3C", F.lit("")) != ""))
    period = F.concat_ws("-", F.substring("D3C", 1, 4), F.substring("D3C", 5, 100))
    return require_rows(known.select(F.lit(covers).alias("recorte"), period.alias("mes_referencia"), names[F.col("D2C")].alias("campo"), F.col("V").try_cast("double").alias("valor")), "index rows")


def read_api(spark: SparkSession, path: str) -> DataFrame:
    """Rows of fetched API answers (JSON arrays), without the descriptive first row of each; an answer of fewer than two rows is an error."""
    texts = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<D2C:string,D3C:string,V:string>>").alias("rows"), F.col("_metadata.file_path").alias("f"))
    bad = texts.where(F.col("rows").isNull() | (F.size("rows") < 2)).select("f").limit(3).collect()
    if bad:
        raise UnexpectedLayout(f"no data in {[r[0] for r in bad]}")
    return texts.select(F.explode(F.slice("rows", 2, F.size("rows"))).alias("r")).select("r.*")


def latest_capture(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """The newest capture below root (the last path in order): each holds the whole series. depth: folders above serie.parquet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root}/{'*/' * depth}serie.parquet")
    found = sorted(str(f.getPath()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or [])
    if not found:
        raise LookupError(f"no capture in {root}")
    return spark.read.parquet(found[-1])


def write_capture(series: DataFrame, root: str, day: str) -> str:
    """Writes a capture (long rows) of one day (yyyy-MM-dd) below its year and month; none is an error. A series is some ten thousand rows."""
    to = f"{root}/{day[:4]}/{day[5:7]}/serie.parquet"
    require_rows(series, "series").coalesce(1).write.mode("overwrite").parquet(to)
    return to


def monthly_index(series: DataFrame, order: str | None = None) -> DataFrame:
    """One row a city and month with a column a field (null where absent), the yield's envelope and where it comes from.

    Of several values of a field and month the last by order counts (the greatest, without an order).
    """
    out = wide(series, ["cidade", "mes_referencia"], "campo", "valor", list(BLOCKS), order or "valor")
    envelope = {f"yield_{k}": F.col("yield_mensal") * F.lit(x) for k, x in SPREAD.items()}
    return require_rows(out.withColumns({**envelope, "dispersao": F.lit(SPREAD_NOTE), "fonte": F.lit("Indice FipeZAP, serie historica")}), "index")


def monthly_inflation(series: DataFrame, order: str | None = None) -> DataFrame:
    """One row a month and coverage with a column a variable; absent ones are null."""
    out = wide(series, ["recorte", "mes_referencia"], "campo", "valor", list(VARIABLES.values()), order or "valor")
    return require_rows(out.withColumn("fonte", F.lit("IBGE/SIDRA tabela 1737 -- IPCA")), "inflation")


def coverage(series: DataFrame) -> DataFrame:
    """campo, meses, preenchido (share with a value) and ate (last month with one) of a long series."""
    has = F.col("valor").isNotNull()
    return series.groupBy("campo").agg(F.count("*").alias("meses"), F.avg(has.cast("double")).alias("preenchido"), F.max(F.when(has, F.col("mes_referencia"))).alias("ate"))


def write_derived(df: DataFrame, to: str) -> None:
    """Replaces a derived table; no rows is an error."""
    require_rows(df, to).write.mode("overwrite").parquet(to)
