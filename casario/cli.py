"""Stages from the command line: python -m casario.cli STAGE ... [--write]. Without --write a stage reports and writes nothing."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import folds
from .operators import enrichment, features, history, market, training
from .session import ship
from .sources import indices, lake, models, register


def _month(spark: SparkSession, args) -> DataFrame:
    """One month of captures to one row a property."""
    rows = lake.read_month(spark, args.source, args.month).withColumn("mes_referencia", F.lit(args.month)).withColumn("tie", F.sha1(F.to_json(F.struct("*"))))
    return history.build_month(rows)


def _market(spark: SparkSession, args) -> DataFrame:
    """The monthly history to the market by neighbourhood."""
    rows = lake.read_months(spark, args.source, args.month)
    rows = rows.withColumn("mes_referencia", F.concat_ws("-", "ano", "mes"))
    for c in ("city", "neighborhood"):
        rows = folds.folded(rows, c, "place", "_p").withColumn(c, F.nullif("_p", F.lit(""))).drop("_p")
    return market.market_by(rows, ["city", "state", "neighborhood", "mes_referencia"])


def _index(spark: SparkSession, args) -> DataFrame:
    return indices.monthly_index(indices.latest_capture(spark, args.source, 2))


def _inflation(spark: SparkSession, args) -> DataFrame:
    return indices.monthly_inflation(indices.latest_capture(spark, args.source, 3))


def _streets(spark: SparkSession, args) -> DataFrame:
    return register.street_lookup(register.read_register(spark, args.source))


def _points(spark: SparkSession, args) -> DataFrame:
    return register.point_lookup(register.read_register(spark, args.source))


def _vocabulary(spark: SparkSession, args) -> DataFrame:
    return features.treated(lake.read_months(spark, args.source, args.month))


def _enriched(spark: SparkSession, args) -> DataFrame:
    """The monthly history with its texts' amenities as columns; what the extraction found is printed."""
    rows = enrichment.with_amenities(lake.read_months(spark, args.source, args.month))
    print(", ".join(f"{k} {v}" for k, v in enrichment.report(rows).first().asDict().items()))
    return enrichment.expanded(rows)


def _training(spark: SparkSession, args) -> DataFrame:
    """The monthly history to training rows and holdout, whole groups of equal listings only."""
    rows = training.filtered(lake.read_months(spark, args.source, args.month))
    group = training.signature(["city", "neighborhood", "property_type", "bedrooms", "area_m2"])
    return training.holdout(rows.withColumn("grupo", group), "grupo")


def _write_training(df: DataFrame, to: str, month: str | None) -> None:
    out = df.withColumnRenamed("is_holdout", "_holdout")
    models.write_training(out.where("NOT _holdout").drop("_holdout"), out.where("_holdout").drop("_holdout"), to, month or "all")


def _write(df: DataFrame, to: str, _month: str | None) -> None:
    indices.write_derived(df, to)


STAGES = {
    "month": (_month, lambda df, to, _: lake.write_months(df, to)), "enriched": (_enriched, lambda df, to, _: enrichment.write_enriched(df, to)), "market": (_market, lambda df, to, _: models.write_market(df, to)), "training": (_training, _write_training),
    "index": (_index, _write), "inflation": (_inflation, _write), "streets": (_streets, _write), "points": (_points, _write), "vocabulary": (_vocabulary, _write),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 when the stage had rows (and, with --write, wrote them); 1 when it had none."""
    parser = argparse.ArgumentParser(prog="casario", description=__doc__)
    parser.add_argument("stage", choices=sorted(STAGES))
    parser.add_argument("--source", required=True, help="folder that the stage reads")
    parser.add_argument("--to", required=True, help="folder that it writes")
    parser.add_argument("--month", help="yyyy-MM, where a stage works on one month")
    parser.add_argument("--write", action="store_true")
    args = parser.parse_args(argv)
    spark = ship(spark or SparkSession.builder.appName(f"casario {args.stage}").getOrCreate())
    make, write = STAGES[args.stage]
    try:
        df = make(spark, args)
        n = df.count()
    except (LookupError, history.EmptyResult) as e:
        print(e, file=sys.stderr)
        return 1
    print(f"{args.stage}: {n} rows, {len(df.columns)} columns" + ("" if args.write else "; nothing is written without --write"))
    if n and args.write:
        write(df, args.to, args.month)
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
