"""Stored models, their cards, and the tables that a training run reads and writes."""

from __future__ import annotations

import json
import re
import string

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting
from ..operators.features import MissingColumns
from ..operators.history import require_rows
from .lake import swap

#: Blocks of a card, scopes of a training.
BLOCKS = ("identificacao", "escopo", "dados", "desempenho", "limites", "ambiente")
SCOPES = ("cidade", "agrupado")
#: The version of source configurations, transactions, flags of compliance that can't be switched off.
CONFIG_VERSION, TRANSACTIONS = 2, ("venda", "locacao")


class InvalidCard(ValueError):
    """A card that can't be trusted; nothing is written."""


class InvalidConfig(ValueError):
    """A source configuration that must not run."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def checked_card(card: dict) -> dict:
    """card, or InvalidCard: a missing block, an unknown scope, no rows or no intended use."""
    missing = [b for b in BLOCKS if b not in card]
    if missing:
        raise InvalidCard(f"blocks are missing: {missing}")
    if card["escopo"].get("escopo_treino") not in SCOPES:
        raise InvalidCard(f"unknown scope {card['escopo'].get('escopo_treino')!r}")
    if not card["escopo"].get("n_treino") or not card["limites"].get("uso_pretendido"):
        raise InvalidCard("a card needs n_treino and uso_pretendido")
    return card


def card(train: DataFrame, holdout: DataFrame, measures: DataFrame, *, city: str, target: str, version: str, scope: str, limits: dict, environment: dict, commit: str | None = None) -> dict:
    """The card of a trained pair: identity, scope, data (platforms, months, filled shares), measures, limits, environment."""
    if scope not in SCOPES:
        raise InvalidCard(f"unknown scope {scope!r}")
    known = [c for c in ("source_platform", "mes_referencia") if c in train.columns]
    sets = train.agg(F.count("*").alias("n"), *(F.sort_array(F.collect_set(c)).alias(c) for c in known)).first()  # platforms and months
    filled = train.agg(*(F.round(F.avg(F.col(c).isNotNull().cast("double")), 4).alias(c) for c in train.columns)).first().asDict()
    return {
        "identificacao": {"cidade": city, "alvo": target, "versao": version, "commit": commit if commit and re.fullmatch("[0-9a-f]{40}", commit) else None},
        "escopo": {"escopo_treino": scope, "n_treino": sets["n"], "n_holdout": holdout.count(), "periodo_dos_dados": sets["mes_referencia"] if "mes_referencia" in known else []},
        "dados": {"plataformas": sets["source_platform"] if "source_platform" in known else [], "cobertura_por_campo": {c: v for c, v in filled.items() if v is not None and v < 1}},
        "desempenho": measures.first().asDict(), "limites": limits, "ambiente": environment,
    }


def next_version(spark: SparkSession, folder: str, day: str) -> str:
    """day-a, day-b and so on: the first that folder does not hold."""
    for letter in string.ascii_lowercase:
        fs, p = _fs(spark, f"{folder}/{day}-{letter}")
        if not fs.exists(p):
            return f"{day}-{letter}"
    raise FileExistsError(f"26 versions of {day} in {folder}")


def save(model: PipelineModel | boosting.Model, spark: SparkSession, to: str, columns: list[str], card: dict) -> str:
    """Writes the model, the order of its columns and its checked card beside their place, then swaps them in."""
    checked_card(card)
    fresh = f"{to}.parcial"
    fs, p = _fs(spark, fresh)
    if fs.exists(p):
        raise FileExistsError(f"{fresh} is left of an earlier run")
    if isinstance(model, boosting.Model):  # with its level table: the same codes in every session
        _write_text(spark, f"{fresh}/modelo.json", model.to_json())
    else:
        model.write().save(f"{fresh}/modelo")
    _write_text(spark, f"{fresh}/colunas.json", json.dumps(columns, ensure_ascii=False))
    _write_text(spark, f"{fresh}/model_card.json", json.dumps(card, ensure_ascii=False))
    swap(spark, fresh, to)
    return to


def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[PipelineModel | boosting.Model, list[str], dict]:
    """The model, its columns and its card; columns, if given, must be the stored ones in their order."""
    own = json.loads(_read_text(spark, f"{path}/colunas.json"))
    if columns is not None and list(columns) != own:
        raise MissingColumns(f"the model of {path} has other columns: {own[:8]}")
    fs, p = _fs(spark, f"{path}/modelo.json")
    model = boosting.Model.from_json(_read_text(spark, f"{path}/modelo.json")) if fs.exists(p) else PipelineModel.load(f"{path}/modelo")
    return model, own, checked_card(json.loads(_read_text(spark, f"{path}/model_card.json")))


def cards(spark: SparkSession, glob: str) -> DataFrame:
    """arquivo, cidade, alvo, versao, n_treino, n_holdout, mae_log of the cards of a glob; files that are no JSON are left out."""
    text = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("arquivo"), "value")
    at = lambda path: F.get_json_object("value", f"$.{path}")
    return text.where(at("identificacao").isNotNull()).select(
        "arquivo", at("identificacao.cidade").alias("cidade"), at("identificacao.alvo").alias("alvo"), at("identificacao.versao").alias("versao"),
        at("escopo.n_treino").cast("long").alias("n_treino"), at("escopo.n_holdout").cast("long").alias("n_holdout"), at("desempenho.mae_log").cast("double").alias("mae_log"))


def write_training(abt: DataFrame, holdout: DataFrame, root: str, month: str) -> None:
    """Replaces the month's training and holdout rows of every transaction type: {alvo}/{abt|holdout}/mes_abt=yyyy-MM."""
    kinds = [r[0] for r in require_rows(abt, "training table").select("transaction_type").distinct().collect()]  # two kinds
    if None in kinds:
        raise ValueError("rows without a transaction type")
    for kind in kinds:
        for name, df in (("abt", abt), ("holdout", holdout)):
            df.where(F.col("transaction_type") == kind).write.mode("overwrite").parquet(f"{root}/{kind}/{name}/mes_abt={month}")


def latest_training(spark: SparkSession, root: str, target: str) -> tuple[DataFrame, DataFrame, str]:
    """The newest training rows of a target, their holdout and month; a missing holdout is an error."""
    fs, p = _fs(spark, f"{root}/{target}/abt/mes_abt=*")
    months = sorted(str(f.getPath()).rsplit("=", 1)[1] for f in fs.globStatus(p) or [])
    if not months:
        raise LookupError(f"no training table in {root}/{target}")
    other = f"{root}/{target}/holdout/mes_abt={months[-1]}"
    fs, p = _fs(spark, other)
    if not fs.exists(p):
        raise LookupError(f"a training table without its holdout: {other}")
    return spark.read.parquet(f"{root}/{target}/abt/mes_abt={months[-1]}"), spark.read.parquet(other), months[-1]


def write_market(market: DataFrame, root: str) -> None:
    """Replaces the months of the market table that it has rows for."""
    require_rows(market, "market").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mes_referencia").parquet(f"{root}/mercado")


def checked_config(config: dict) -> dict:
    """A source configuration of the known version: domains once each, known transactions, compliance never off."""
    if config.get("version") != CONFIG_VERSION:
        raise InvalidConfig(f"version {config.get('version')!r} is unknown")
    seen: set[str] = set()
    for source in config.get("sources", []):
        domain = source.get("domain")
        if not domain or domain in seen:
            raise InvalidConfig(f"domain {domain!r} is missing or comes twice")
        seen.add(domain)
        unknown = set(source.get("transactions", TRANSACTIONS)) - set(TRANSACTIONS)
        if unknown:
            raise InvalidConfig(f"{domain}: unknown transactions {sorted(unknown)}")
    if any(v is False for v in config.get("compliance", {}).values()):
        raise InvalidConfig("a rule of compliance can't be switched off")
    return config


def config_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """The sources (domain, platform, enabled, cities, transactions) and target cities of a checked configuration."""
    c = checked_config(config)
    sources = [(s["domain"], s.get("platform"), bool(s.get("enabled", True)), list(s.get("cities", [])), list(s.get("transactions", TRANSACTIONS))) for s in c.get("sources", [])]
    targets = [(t["city"], t.get("state")) for t in c.get("targets", [])]
    return spark.createDataFrame(sources, "domain string, platform string, enabled boolean, cities array<string>, transactions array<string>"), spark.createDataFrame(targets, "city string, state string")


def yield_tables(spark: SparkSession, pointer: str) -> DataFrame:
    """city, p10, median, p90 of the JSON file that a pointer file names (beside it, or by its whole path): an object of cities."""
    name = _read_text(spark, pointer).strip()
    path = name if ":" in name or name.startswith("/") else f"{pointer.rsplit('/', 1)[0]}/{name}"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.map_entries(F.from_json("value", "map<string,struct<p10:double,median:double,p90:double>>"))).alias("e"))
    return rows.select(F.col("e.key").alias("city"), "e.value.*")


_CARD = """identificacao struct<cidade:string,alvo:string,versao:string>, escopo struct<escopo_treino:string,n_treino:long,n_holdout:long>, dados struct<abt:string>, ambiente struct<gerado_em:string>,
 desempenho struct<rmse_brl:double,mae_brl:double,erro_mediano:double,dentro_20pct:double,cobertura_intervalo:double,vies_brl:double,vies_mediano:double>"""


def summaries(card_texts: DataFrame) -> DataFrame:
    """The block that goes with each estimate, from cards as JSON (value): names are changed, nothing is computed; text that is no card gives no row."""
    c = card_texts.select(F.from_json("value", _CARD).alias("c")).select("c.*").where("identificacao.cidade IS NOT NULL")
    return c.select(
        F.col("identificacao.versao").alias("versao"), F.coalesce("dados.abt", F.lit("")).alias("base"), F.concat_ws("/", "identificacao.cidade", "identificacao.alvo").alias("segmento"), F.col("escopo.n_treino").alias("n_treino"),
        F.coalesce("escopo.n_holdout", F.lit(0)).alias("n_holdout"), F.coalesce("ambiente.gerado_em", F.lit("")).alias("treinado_em"), *(F.col(f"desempenho.{a}").alias(b) for a, b in SUMMARY.items()),
        F.col("identificacao.cidade").alias("cidade"), F.col("identificacao.alvo").alias("alvo"), F.col("escopo.escopo_treino").alias("escopo_treino"))


#: Measures of a card and their names beside an estimate.
SUMMARY = {
    "rmse_brl": "rmse_holdout", "mae_brl": "mae_holdout", "erro_mediano": "erro_mediano_holdout", "dentro_20pct": "dentro_20pct_holdout", "cobertura_intervalo": "cobertura_intervalo",
    "vies_brl": "vies_brl_holdout", "vies_mediano": "vies_mediano_holdout",
}


def metadata(card_texts: DataFrame) -> DataFrame:
    """What the model screen shows of each card (value): version, segment, rows, when, the holdout's measures, limits and environment as JSON."""
    at = lambda path: F.get_json_object("value", f"$.{path}")
    return card_texts.where(at("identificacao.cidade").isNotNull()).select(
        at("identificacao.versao").alias("versao"), F.concat_ws("/", at("identificacao.cidade"), at("identificacao.alvo")).alias("segmento"), F.coalesce(at("dados.abt"), F.lit("")).alias("base"),
        at("escopo.n_treino").cast("long").alias("n_treino"), F.coalesce(at("escopo.n_holdout").cast("long"), F.lit(0)).alias("n_holdout"), F.coalesce(at("ambiente.gerado_em"), F.lit("")).alias("treinado_em"),
        F.lit("sem_opcionais").alias("cenario_de_decisao"), F.coalesce(at("desempenho"), F.lit("{}")).alias("holdout"), F.coalesce(at("calibracao_por_decil"), F.lit("[]")).alias("calibracao_holdout"),
        F.coalesce(at("limites"), F.lit("{}")).alias("limites"), F.coalesce(at("ambiente"), F.lit("{}")).alias("ambiente"))


def read_config(spark: SparkSession, path: str) -> dict:
    """A checked source configuration from a JSON file, or from a YAML file where a YAML reader is installed."""
    text = _read_text(spark, path)
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ModuleNotFoundError:
            raise InvalidConfig(f"{path}: no YAML reader is installed; give the configuration as JSON") from None
        found = yaml.safe_load(text)
    else:
        try:
            found = json.loads(text)
        except ValueError as e:
            raise InvalidConfig(f"{path}: {e}") from None
    if not isinstance(found, dict):
        raise InvalidConfig(f"{path} holds no configuration")
    return checked_config(found)
