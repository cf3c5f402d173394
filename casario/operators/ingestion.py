"""From raw records to records fit for the lake, in one chain of projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, folds, pii
from ..sources.lake import REQUIRED, as_record

TEXTS = ("description_clean", "address", "neighborhood", "city", "property_type")
NUMBERS = {"price": "money", "condo_fee": "money", "iptu_tax": "money", "area_m2": "int", "area_total_m2": "int", "bedrooms": "int", "bathrooms": "int", "suites": "int", "parking_spots": "int", "floor_level": "int"}


def with_hints(raw: DataFrame) -> DataFrame:
    """raw with what its address or search knew of a page (columns hint_<name>) where the page itself says nothing; the hints go."""
    hints = [c for c in raw.columns if c.startswith("hint_")]
    return raw.withColumns({c[5:]: F.coalesce(F.col(c[5:]), F.col(c)) if c[5:] in raw.columns else F.col(c) for c in hints}).drop(*hints)


def with_provenance(raw: DataFrame, domain: str, day: str, city: str | None = None, state: str | None = None, platform: str | None = None) -> DataFrame:
    """raw with its source and day: hints below the page, then the target's city and state for what both leave out.

    What the collector knows by itself lies above the page: domain, platform and day, and, where raw has columns discovered_link
    and discovered_transaction_type, the link and the transaction by which it came.
    """
    raw = with_hints(raw)
    above = {c[11:]: F.coalesce(F.col(c), F.col(c[11:])) if c[11:] in raw.columns else F.col(c) for c in ("discovered_link", "discovered_transaction_type") if c in raw.columns}
    raw = raw.withColumns(above).drop("discovered_link", "discovered_transaction_type")
    if platform:
        raw = raw.withColumn("source_platform", F.lit(platform))
    have = set(raw.columns)
    for c in ("listing_id", "link", "city", "state", "listing_first_seen"):
        if c not in have:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return raw.withColumns({
        "source_domain": F.lit(domain), "extraction_date": F.lit(day), "listing_last_seen": F.lit(day),
        "city": F.coalesce("city", F.lit(city).cast("string")), "state": F.coalesce("state", F.lit(state).cast("string")),
        "listing_first_seen": F.coalesce("listing_first_seen", F.lit(day)),
    })


def typed(df: DataFrame) -> DataFrame:
    """Text numbers parsed (numbers pass), amenities never null, transaction and postal code canonical."""
    out = {}
    for c, kind in NUMBERS.items():
        if c in df.columns and df.schema[c].dataType.simpleString() == "string":
            out[c] = coerce.currency(F.col(c)) if kind == "money" else coerce.integer(F.col(c))
    if "amenities" in df.columns:
        out["amenities"] = F.coalesce("amenities", F.array().cast("array<string>"))
    if "cep" in df.columns:
        prefix = F.col("cep_prefix") if "cep_prefix" in df.columns else F.lit(None).cast("string")
        out |= {"cep": coerce.cep(F.col("cep")), "cep_prefix": F.coalesce(prefix, F.when(coerce.cep(F.col("cep")).isNotNull(), coerce.cep_prefix(F.col("cep"))))}
    out["transaction_type"] = coerce.transaction(folds.fold(F.col("transaction_type"), "slug"))
    return df.withColumns(out)


def normalised(raw: DataFrame, cities: list[str] | None = None) -> DataFrame:
    """Records with motivo: null for a record to keep, else the first reason against it in the order of the stages.

    Contacts are scrubbed from texts and lists before anything is looked at; a link that is a contact rejects its record;
    values out of range become null (named in anulados); a city outside the closed list rejects, an unknown one doesn't.
    """
    listing_id = F.col("listing_id")
    df = raw.withColumn("_link", pii.scrub_url(F.col("link")))
    df = df.withColumn("property_id", coerce.property_id(F.col("source_domain"), listing_id, F.col("_link")))
    df = df.withColumn("link", F.col("_link"))
    df = as_record(typed(df))
    for c in TEXTS:
        df = df.withColumn(c, F.nullif(pii.scrub(F.col(c))["text"], F.lit("")))
    df = df.withColumn("amenities", F.filter(F.transform("amenities", lambda x: pii.scrub(x)["text"]), lambda x: x != ""))
    df = coerce.within_ranges(df)
    outside = F.lit(False)
    if cities is not None:
        known = F.array(*(F.lit(folds.city_key(c)) for c in cities))
        outside = F.col("city").isNotNull() & ~F.array_contains(known, folds.fold(F.col("city"), "city_key"))
    reason = F.when(F.col("link").isNull(), "link").otherwise(F.coalesce(coerce.reject_reason(REQUIRED), F.when(outside, "city")))
    return df.withColumn("motivo", reason)


def report(records: DataFrame) -> DataFrame:
    """n by motivo (null: kept) of normalised records."""
    return records.groupBy("motivo").agg(F.count("*").alias("n"))


def run_report(runs: DataFrame) -> DataFrame:
    """fonte (platform:domain), situacao (SKIP, FAIL, OK), n runs and linhas of source runs (platform, domain, skipped, error, rows), and their totals (fonte TOTAL, situacao null).

    A skipped run adds no rows; one that failed adds what it had.
    """
    status = F.when(F.col("skipped").isNotNull(), "SKIP").when(F.col("error").isNotNull(), "FAIL").otherwise("OK")
    each = runs.select(F.concat_ws(":", "platform", "domain").alias("fonte"), status.alias("situacao"), F.when(F.col("skipped").isNull(), F.coalesce("rows", F.lit(0))).otherwise(0).cast("long").alias("linhas"))
    own = each.groupBy("fonte", "situacao").agg(F.count("*").alias("n"), F.sum("linhas").alias("linhas"))
    return own.unionByName(own.agg(F.sum("n").alias("n"), F.sum("linhas").alias("linhas")).select(F.lit("TOTAL").alias("fonte"), F.lit(None).cast("string").alias("situacao"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("linhas", F.lit(0)).cast("long").alias("linhas")))
