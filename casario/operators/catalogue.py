"""Sources, targets, models and yields as small tables: what is collected, what can be served, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collection_plan(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Each enabled source with each target city that it serves (all, where it names none) and each of its transactions.

    Sources carry their cities, so this is an equi-join on the city and, for those without a list, one row a target.
    """
    on = sources.where("enabled")
    named = on.where(F.size("cities") > 0).select("domain", "platform", "transactions", F.explode("cities").alias("city")).join(targets, "city")
    every = on.where(F.coalesce(F.size("cities"), F.lit(0)) <= 0).select("domain", "platform", "transactions", F.lit(1).alias("_one"))
    rest = every.join(F.broadcast(targets.withColumn("_one", F.lit(1))), "_one").drop("_one")  # targets: the closed list of cities
    return named.unionByName(rest).withColumn("transaction", F.explode("transactions")).drop("transactions")


def serving_sources(sources: DataFrame, platform: str | None = None, city: str | None = None) -> DataFrame:
    """Enabled sources, of one platform and serving one city where these are given; a source without cities serves all."""
    ok = F.col("enabled")
    if platform:
        ok = ok & (F.col("platform") == platform)
    if city:
        ok = ok & ((F.coalesce(F.size("cities"), F.lit(0)) <= 0) | F.array_contains("cities", city))
    return sources.where(ok)


def checked_transactions(discovered: DataFrame, known: tuple[str, ...] = ("venda", "locacao")) -> DataFrame:
    """discovered, or ValueError when a row's transaction is none of the known ones."""
    odd = discovered.where(~F.coalesce(F.col("transaction_type").isin(*known), F.lit(False))).select("transaction_type").limit(3).collect()
    if odd:
        raise ValueError(f"unknown transactions: {[r[0] for r in odd]}")
    return discovered


def availability(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """city, target, version, served, reason: configuration before models, the newest complete model winning."""
    newest = models.where("complete").groupBy("city", "target").agg(F.max("version").alias("version"))
    out = pairs.join(newest, ["city", "target"], "left")
    reason = F.when(~F.col("available"), F.coalesce("why", F.lit("unavailable"))).when(F.col("version").isNull(), "no model")
    return out.select("city", "target", "version", reason.isNull().alias("served"), reason.alias("reason"))


def nested(pairs: DataFrame) -> DataFrame:
    """city, targets (map of target to its info) and how many are available."""
    info = F.struct("available", "why")
    return pairs.groupBy("city").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("target", info.alias("info"))))).alias("targets"), F.count_if("available").alias("n_available"))


def yields(published: DataFrame, manual: DataFrame) -> DataFrame:
    """city, p10, median, p90, origin: a published yield before a manual one; only 0 < p10 <= median <= p90 < 0.05 counts."""
    valid = lambda d: d.where("p10 > 0 AND p10 <= median AND median <= p90 AND p90 < 0.05")
    ranked = valid(published).withColumn("origin", F.lit("published")).unionByName(valid(manual).withColumn("origin", F.lit("manual")))
    best = ranked.groupBy("city").agg(F.max_by(F.struct("p10", "median", "p90", "origin"), F.struct(F.col("origin") == "published", "median")).alias("x"))
    return best.select("city", "x.*")


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """df, or ValueError when a key comes twice."""
    if not df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return df


def joined_layers(layers: list[DataFrame], key: str) -> DataFrame:
    """Layers joined one to one; a repeated or missing key is an error."""
    out = one_row_each(layers[0], key)
    for layer in layers[1:]:
        if not out.join(one_row_each(layer, key), key, "left_anti").isEmpty():
            raise ValueError(f"{key} missing in a layer")
        out = out.join(layer, key)
    return out


def requests_to_rows(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Estimate requests with erro: the first number out of its physical range, or more suites than bedrooms; null if fine."""
    error = F.lit(None).cast("string")
    if {"suites", "bedrooms"} <= set(df.columns):
        error = F.when(F.col("suites") > F.col("bedrooms"), "suites")
    for c, (lo, hi) in reversed(list(limits.items())):
        error = F.when(~F.col(c).between(lo, hi), c).otherwise(error)
    return df.withColumn("erro", error)


#: Physical ranges of a request.
PHYSICAL = {"area_m2": (15.0, 2_000.0), "bedrooms": (0.0, 12.0), "bathrooms": (0.0, 15.0), "suites": (0.0, 12.0), "parking_spots": (0.0, 12.0), "floor_level": (0.0, 60.0)}


def missing_optionals(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with ausentes: the names of unknown optional answers."""
    return df.withColumn("ausentes", F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns))))


def resolved(requests: DataFrame, pairs: DataFrame, models: DataFrame) -> DataFrame:
    """requests (city, target) with version, or motivo: the configuration (city, target, available, why) is asked before the models.

    Fixed values: the reasons' texts. A pair that is switched off is refused though a model of it may be there.
    """
    newest = models.where("complete").groupBy("city", "target").agg(F.max("version").alias("version"))
    known = pairs.select("city", "target", "available", "why", F.lit(True).alias("_known"))
    out = requests.join(known, ["city", "target"], "left").join(newest, ["city", "target"], "left")
    reason = F.when(F.col("_known").isNull(), "cidade ou transacao fora do escopo atendido").when(~F.col("available"), F.coalesce("why", F.lit("modelo estatistico ainda nao disponivel")))
    reason = reason.when(F.col("version").isNull(), "modelo declarado disponivel mas ausente no disco -- a publicacao do modelo falhou")
    return out.withColumn("motivo", reason).withColumn("version", F.when(reason.isNull(), F.col("version"))).drop("available", "why", "_known")


def caveats(df: DataFrame, booleans: list[str]) -> DataFrame:
    """df with ressalvas: what an estimate can't hold for the answers given.

    nao_menos_confiavel:<questions> for answers of no (texts that don't mention a thing and texts that deny it look alike),
    sem_elevador where that is the answer on lifts, vista_nao_informada without a view.
    """
    denied = F.array_compact(F.array(*(F.when(~F.col(c), F.lit(c)) for c in booleans)))
    notes = [F.when(F.size(denied) > 0, F.concat(F.lit("nao_menos_confiavel:"), F.array_join(denied, ",")))]
    if "elevador" in df.columns:
        notes.append(F.when(~F.col("elevador"), F.lit("sem_elevador")))
    if "vista" in df.columns:
        notes.append(F.when(F.coalesce(F.col("vista").isin("nenhuma", "nao_sei"), F.lit(True)), F.lit("vista_nao_informada")))
    return df.withColumn("ressalvas", F.array_compact(F.array(*notes)))


def missing_ids(df: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    """The keys of df that a layer lacks, each once."""
    return df.select(key).distinct().join(layer.select(key), key, "left_anti")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """ValueError when two sets share a key."""
    both = [r[0] for r in a.select(key).intersect(b.select(key)).limit(5).collect()]
    if both:
        raise ValueError(f"{key} in both sets: {both}")


def absent_yields(cities: DataFrame, yields_table: DataFrame, city: str = "city") -> DataFrame:
    """The cities without a usable yield and motivo: no row at all, or one whose numbers are out of order."""
    own = yields_table.select(F.col(city), F.lit(True).alias("_any"), (F.expr("p10 > 0 AND p10 <= median AND median <= p90 AND p90 < 0.05")).alias("_ok"))
    found = own.groupBy(city).agg(F.max("_any").alias("_any"), F.max(F.coalesce("_ok", F.lit(False))).alias("_ok"))
    out = cities.select(city).distinct().join(found, city, "left").where(~F.coalesce("_ok", F.lit(False)))
    return out.select(city, F.when(F.col("_any").isNull(), "sem_rendimento").otherwise("rendimento_invalido").alias("motivo"))
