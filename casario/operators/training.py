"""The training table: filters, holdout by group, folds, target encoding, fusion of twins, support of labels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .market import price_per_area

#: Plausible prices by transaction, and prices by area.
PRICE_BANDS = {"venda": (50_000.0, 100_000_000.0), "locacao": (300.0, 200_000.0)}
AREA_BANDS = {"venda": (500.0, 60_000.0), "locacao": (5.0, 500.0)}
HOLDOUT, SUPPORT, SMOOTHING = 0.10, 30, 20.0
#: Rows of a range that one task sorts.
RANGE = 250_000


def in_band(value: Column, bands: dict[str, tuple[float, float]], kind: str = "transaction_type") -> Column:
    """Whether value lies in the band of its row's kind; a kind without a band never does."""
    ok = F.lit(False)
    for name, (lo, hi) in bands.items():
        ok = F.when(F.col(kind) == name, value.between(lo, hi)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def filtered(df: DataFrame, prices: dict = PRICE_BANDS, areas: dict = AREA_BANDS) -> DataFrame:
    """Rows with a price in band whose price by area is unknown or in band (an area of 0 is out)."""
    by_area = price_per_area()
    return df.where(F.col("price").isNotNull() & in_band(F.col("price"), prices) & (by_area.isNull() | in_band(by_area, areas)))


def filter_log(df: DataFrame, prices: dict = PRICE_BANDS, areas: dict = AREA_BANDS) -> DataFrame:
    """One row: rows in, dropped by each step in order, rows out."""
    by_area = price_per_area()
    known = F.col("price").isNotNull()
    priced = known & in_band(F.col("price"), prices)
    kept = priced & (by_area.isNull() | in_band(by_area, areas))
    return df.agg(F.count("*").alias("n_in"), F.count_if(~known).alias("no_price"), F.count_if(known & ~priced).alias("price_out"), F.count_if(priced & ~kept).alias("area_out"), F.count_if(kept).alias("n_out"))


def signature(columns: list[str]) -> Column:
    """Text key of a row's group: its values in order, null as empty."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def holdout(df: DataFrame, group: str, share: float = HOLDOUT, seed: int = 42) -> DataFrame:
    """df with is_holdout: a share of the groups, whole groups only, in the order of a seeded hash.

    Groups are ranked by the count of hashes in ranges before them, not by one sorted task: ranges of the hash's first
    three digits are counted, and only ranks within a range are windowed.
    """
    groups = df.select(group).distinct().withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}|"), F.col(group)))).withColumn("_r", F.substring("_h", 1, 3))
    ranges = groups.groupBy("_r").agg(F.count("*").alias("_n"))
    before = ranges.select("_r", (F.sum("_n").over(W.orderBy("_r")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))  # 4,096 rows at most
    ranked = groups.join(F.broadcast(before), "_r").withColumn("_rank", F.col("_before") + F.row_number().over(W.partitionBy("_r").orderBy("_h")))
    chosen = ranked.where(F.col("_rank") <= F.floor(F.lit(share) * F.col("_all") + 0.5)).select(F.col(group).alias("_chosen"))
    return df.join(chosen, F.col(group) == F.col("_chosen"), "left").withColumn("is_holdout", F.col("_chosen").isNotNull()).drop("_chosen")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table of the shared folder: cuts lineage and survives lost executors. Only one machine has a folder of its own."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    to = f"{(root or 'file:/tmp/checkpoints').rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def by_range(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """df with _range, in the order of its ranges of order, and _row, the place within its range (from 0), written: ranges are drawn from a sample, anew in each run.

    Without a number of ranges df is written before, as its rows say how many there are and the sample would run it once more.
    They are counted while they are written. Rows are sorted in the task that gets a range, so no second shuffle numbers them.
    """
    if ranges is None:
        seen = Observation()
        df = written(df.observe(seen, F.count("*").alias("n")), "rows")
        ranges = ranges_of(df, seen.get.get("n", 0))
    sorted_ = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the lower bits count a task's rows
    return written(sorted_.withColumns({"_range": F.spark_partition_id(), "_row": place}), "ranges")


def ranges_of(df: DataFrame, rows: int) -> int:
    """Ranges of about RANGE rows for df's rows, but no fewer than partitions of a shuffle."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE))


def ranked(df: DataFrame, order: list[str], name: str = "_rank") -> DataFrame:
    """df with its row number by order (from 1) and _all, the number of rows: rows of the ranges before and the place within the range."""
    dealt = by_range(df, order)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))  # a row for each range
    out = dealt.join(F.broadcast(written(before, "starts")), "_range")  # written, as each use of the ranks would count again
    return out.withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_range", "_row", "_before")


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], ranges: int | None = None, few: bool = False) -> DataFrame:
    """by and the exact percentiles (name: share) of each group's known values, as F.percentile gives them.

    Values are dealt by ranges, equal ones by a number of their own, so that no range grows with a frequent value; a value's rank in its
    group is the group's rows in the ranges before and its place in the range. With a number of ranges (of by_range) df is run twice.
    Only callers whose groups a constant bounds say that they are few: the places looked for are broadcast then.
    """
    values = df.where(F.col(value).isNotNull()).select(*by, value, F.monotonically_increasing_id().alias("_id"))
    dealt = by_range(values, [*by, value, "_id"], ranges)
    sums = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_in"), F.min("_row").alias("_start"))
    group = W.partitionBy(*by)
    before = sums.withColumns({"_before": F.sum("_in").over(group.orderBy("_range")) - F.col("_in"), "_all": F.sum("_in").over(group)})  # a row for each group and range
    position = {k: (F.col("_all") - 1) * F.lit(float(s)) for k, s in shares.items()}
    ends = {f"_{f.__name__}_{k}": f(p) for k, p in position.items() for f in (F.floor, F.ceil)}
    wanted = F.lit(False)
    for rank in ends.values():
        wanted = wanted | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in")))
    places = before.where(wanted)  # two for each group and share at most: grows with the groups, Spark chooses the join
    rows = dealt.join(F.broadcast(places) if few else places, [*by, "_range"])
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_row") - F.col("_start")).where(F.col("_rank").isin(*ends.values()))
    known = F.col(value).cast("double") + F.lit(0.0)  # -0.0 is 0.0, as for a group
    found = rows.groupBy(*by).agg(F.first("_all").alias("_all"), *(F.max(F.when(F.col("_rank") == rank, known)).alias(k) for k, rank in ends.items()))
    lo, hi = (lambda k: F.col(f"_floor_{k}")), (lambda k: F.col(f"_ceil_{k}"))
    return found.select(*by, *(F.when(lo(k) == hi(k), lo(k)).otherwise((F.ceil(p) - p) * lo(k) + (p - F.floor(p)) * hi(k)).alias(k) for k, p in position.items()))


def deciles(df: DataFrame, order: list[str], bins: int = 10, name: str = "decil") -> DataFrame:
    """df with its bin of equal size by order (ties by the further columns of order), as quantile cuts of the ranks."""
    n, r = F.col("_all"), F.col("_rank")
    return ranked(df, order).withColumn(name, F.when(n == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(F.round((r - 1) * bins / F.greatest(n - 1, F.lit(1)), 9)) - 1)).cast("int")).drop("_all", "_rank")


def group_folds(df: DataFrame, group: str, price: str, folds: int = 5, seed: int = 20260829) -> DataFrame:
    """df with fold: groups dealt in turn within deciles of their median price, in the order of a seeded hash."""
    of = deciles(df.groupBy(group).agg(F.median(price).alias("_p")), ["_p", group])
    turns = ranked(of.select(group, "decil", F.sha1(F.concat(F.lit(f"{seed}|"), F.col(group))).alias("_h")), ["decil", "_h"])
    starts = turns.groupBy("decil").agg(F.min("_rank").alias("_first"))
    return df.join(turns.join(F.broadcast(starts), "decil").select(group, ((F.col("_rank") - F.col("_first")) % folds).cast("int").alias("fold")), group)


def target_encoding(df: DataFrame, key: str, value: Column, smoothing: float = SMOOTHING) -> DataFrame:
    """key, encoded, n: each key's mean of the finite values, drawn to the mean over all; a null key is the key 'nan'."""
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("nan")).alias(key), value.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    sums = rows.groupBy(key).agg(F.sum("_v").alias("_s"), F.count("*").alias("n"))
    whole = sums.agg((F.sum("_s") / F.sum("n")).alias("_g"))
    return sums.join(F.broadcast(whole), F.lit(True)).select(key, ((F.col("_s") + smoothing * F.col("_g")) / (F.col("n") + smoothing)).alias("encoded"), "n")


def exact_mean(column: str) -> Column:
    """The mean of decimals, whose sum no order changes, to ten decimals; of doubles where one has more than eighteen digits before them."""
    exact = F.col(column).try_cast("decimal(28,10)")
    return F.when(F.count(exact) == F.count(column), F.avg(exact).cast("double")).otherwise(F.avg(column))


def fused(df: DataFrame, keys: list[str], order: list[str], means: list[str], firsts: list[str]) -> DataFrame:
    """Twins (equal keys, none null) as one row: means of the numbers, first known value of the rest, the least of those that order leaves equal; others as they are."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    one = df.where(complete).groupBy(*keys).agg(*(exact_mean(c).alias(c) for c in means), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, c))).alias(c) for c in firsts), F.count("*").alias("n_gemeos"))
    rest = df.where(~complete).select(*keys, *(F.col(c).cast("double").alias(c) for c in means), *firsts, F.lit(1).cast("long").alias("n_gemeos"))
    return one.unionByName(rest)


def supported(df: DataFrame, labels: str, least: int = SUPPORT) -> DataFrame:
    """label, n of the labels that at least `least` rows have."""
    return df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def one_hot(df: DataFrame, labels: str, names: dict[str, str]) -> DataFrame:
    """df with a boolean column for each label of names (label: column)."""
    return df.withColumns({column: F.coalesce(F.array_contains(labels, label), F.lit(False)) for label, column in names.items()})


def label_families(df: DataFrame, labels: str, families: dict[str, list[str]]) -> DataFrame:
    """df with a boolean column for each family: any of its labels."""
    return df.withColumns({name: F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, members))), F.lit(False)) for name, members in families.items()})


def enough(df: DataFrame, keys: list[str], least: int = 300) -> DataFrame:
    """Groups with at least `least` rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ratios(df: DataFrame) -> DataFrame:
    """df with the ratios and logarithms of the model: a denominator of 0 gives null."""
    over = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return df.withColumns({
        "area_por_quarto": over("area_m2", "bedrooms"),
        "condo_m2": over("condo_fee", "area_m2"),
        "log_area": F.when(F.col("area_m2") > 0, F.ln("area_m2")),
        "log_price": F.when(F.col("price") > 0, F.ln("price")),
    })
