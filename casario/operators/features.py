"""Columns of the model: segments, base features, locations, encodings, the matrices and their order, requests, reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..functions import folds, vocabulary
from .serving import scaled_by_group
from .training import SMOOTHING, target_encoding

#: What is no predictor, key fields whose absence is a signal, the limit between segments of sales.
NO_PREDICTORS = ("property_id", "link", "source_domain", "source_platform", "state", "extraction_date", "price", "log_price", "cep", "grupo", "familia_alvo", "_holdout")
KEY_FIELDS = ("area_m2", "bedrooms", "bathrooms", "parking_spots", "condo_fee", "iptu_tax", "floor_level", "suites")
SEGMENT_LIMIT = 800_000


class MissingColumns(ValueError):
    """A matrix lacks columns that its model was fitted on."""


def with_family(df: DataFrame, column: str = "property_type") -> DataFrame:
    """df with familia of its raw property types, folded once per distinct value."""
    kinds = df.select(F.col(column).alias("_t")).distinct().withColumn("familia", vocabulary.family(vocabulary.property_type(F.col("_t"))))
    return df.join(kinds, df[column].eqNullSafe(kinds["_t"]), "left").drop("_t")


def with_validation(base: DataFrame, validation: DataFrame, column: str = "property_type") -> DataFrame:
    """Both tables with _holdout (true for validation) and familia; columns by name, missing ones null."""
    both = base.withColumn("_holdout", F.lit(False)).unionByName(validation.withColumn("_holdout", F.lit(True)), allowMissingColumns=True)
    return with_family(both, column)


def segment(df: DataFrame, name: str, limit: float = SEGMENT_LIMIT) -> DataFrame:
    """The rows of a segment: venda or locacao first, _ate800k or _acima800k within it, a family at the end; 'global' is all."""
    ok = F.lit(True)
    for kind in ("venda", "locacao"):
        if name.startswith(kind):
            ok = ok & (F.col("transaction_type") == kind)
    if "_ate800k" in name:
        ok = ok & (F.col("price") <= limit)
    elif "_acima800k" in name:
        ok = ok & (F.col("price") > limit)
    for kind in ("residencial", "casa", "comercial"):
        if name.endswith(f"_{kind}"):
            ok = ok & (F.col("familia") == kind)
    return df.where(ok)


def city_cut(df: DataFrame, city: str, column: str = "city") -> DataFrame:
    """The rows of one city, whatever its spelling."""
    kinds = df.select(F.col(column).alias("_c")).distinct().where(folds.fold(F.col("_c"), "place") == folds.place(city))
    return df.join(kinds, df[column] == kinds["_c"], "left_semi")


def base_features(df: DataFrame) -> DataFrame:
    """df with ratios (a denominator of 0 or unknown gives null), flags of absence, and counts of amen_ and nega_ columns."""
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    rooms = F.coalesce("bedrooms", F.lit(0)) + F.coalesce("bathrooms", F.lit(0))
    df = df.withColumn("comodos", F.when(F.col("bedrooms").isNotNull() | F.col("bathrooms").isNotNull(), rooms))
    out = {
        "area_por_quarto": over("area_m2", "bedrooms"), "banhos_por_quarto": over("bathrooms", "bedrooms"), "suites_por_quarto": over("suites", "bedrooms"),
        "vagas_por_quarto": over("parking_spots", "bedrooms"), "area_por_comodo": over("area_m2", "comodos"), "log_area": F.when(F.col("area_m2") > 0, F.ln("area_m2")),
        "condo_por_m2": over("condo_fee", "area_m2"), "iptu_por_m2": over("iptu_tax", "area_m2"),
        **{f"aus_{c}": F.col(c).isNull() for c in KEY_FIELDS}, "n_campos_ausentes": sum((F.col(c).isNull().cast("int") for c in KEY_FIELDS), F.lit(0)),
    }
    for prefix, name in (("amen_", "n_amenidades"), ("nega_", "n_negacoes")):
        flags = [c for c in df.columns if c.startswith(prefix)]
        if flags:
            out[name] = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flags), F.lit(0))
    return df.withColumns(out)


def located(df: DataFrame, points: DataFrame, cep: str = "cep", city: str = "city") -> DataFrame:
    """df with cep_n_enderecos and cep_lat_mm, cep_lon_mm, scaled within its city (0.5 where all are equal). points: cep, lat, lon, n_end.

    CEPs meet as eight digits with leading zeros; of several points of a CEP the least counts.
    """
    eight = lambda c: F.lpad(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\D", ""), 8, "0")
    point = points.select(eight("cep").alias("_cep"), F.struct("lat", "lon", "n_end").alias("_p")).groupBy("_cep").agg(F.min("_p").alias("_p"))
    out = df.withColumn("_cep", eight(cep)).join(point, "_cep", "left").select(*df.columns, F.col("_p.lat").alias("_lat"), F.col("_p.lon").alias("_lon"), F.col("_p.n_end").alias("cep_n_enderecos"))
    return scaled_by_group(scaled_by_group(out, city, "_lat", "cep_lat_mm"), city, "_lon", "cep_lon_mm").drop("_lat", "_lon")


def interactions(df: DataFrame, lat: str = "cep_lat_mm", lon: str = "cep_lon_mm") -> DataFrame:
    """df with product, sum, difference and distance from the centre of its scaled coordinates; df itself without them."""
    if lat not in df.columns or lon not in df.columns:
        return df
    la, lo = F.col(lat), F.col(lon)
    return df.withColumns({"geo_prod": la * lo, "geo_soma": la + lo, "geo_dif": la - lo, "geo_raio": F.sqrt((la - 0.5) * (la - 0.5) + (lo - 0.5) * (lo - 0.5))})


def encoded(train: DataFrame, df: DataFrame, keys: Iterable[str], value: Column, smoothing: float = SMOOTHING) -> DataFrame:
    """df with te_<key> and n_<key> from train's rows: unseen keys take the mean over all and a count of 0. A null key is the key 'nan'."""
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    whole = train.agg(F.avg(F.when(good, value)).alias("_g"))  # one row
    df = df.join(F.broadcast(whole), F.lit(True), "left")
    for key in keys:
        table = target_encoding(train, key, value, smoothing).select(F.col(key).alias("_k"), F.col("encoded").alias(f"te_{key}"), F.col("n").alias(f"n_{key}"))
        df = df.join(table, F.coalesce(F.col(key).cast("string"), F.lit("nan")) == F.col("_k"), "left").drop("_k")
        df = df.withColumns({f"te_{key}": F.coalesce(f"te_{key}", "_g"), f"n_{key}": F.coalesce(f"n_{key}", F.lit(0))})
    return df.drop("_g")


def matrix(df: DataFrame) -> DataFrame:
    """df without what is no predictor."""
    return df.drop(*(c for c in df.columns if c in NO_PREDICTORS or c.startswith("_")))


def form_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing in the matrix: {missing}")
    return df.select(*columns)


def ordered(df: DataFrame, *groups: Iterable[str]) -> DataFrame:
    """The columns of the groups that df has, each once, in order of first mention."""
    return df.select(*dict.fromkeys(c for g in groups for c in g if c in df.columns))


def supported_flags(df: DataFrame, least: int, prefixes: tuple[str, ...] = ("amen_", "nega_")) -> list[str]:
    """Flag columns that are true in at least `least` rows, in one pass."""
    flags = [c for c in df.columns if c.startswith(prefixes)]
    counts = df.agg(*(F.count_if(F.col(c)).alias(c) for c in flags)).first() if flags else {}
    return [c for c in flags if counts[c] >= least]


def label_column(label: str) -> str:
    """A column's name for a label: 'Varanda Gourmet' is varanda_gourmet."""
    return folds.slug(label).replace("-", "_")


def spelled(df: DataFrame, column: str, spelling: DataFrame) -> DataFrame:
    """df with a place's name in title case, or as spelling (chave, canonical) writes it. Each distinct value is looked up once."""
    names = df.select(F.col(column).alias("_v")).distinct().withColumn("_t", vocabulary.titled(F.col("_v")))
    names = names.withColumn("_k", folds.fold(F.col("_t"), "ascii_key")).join(spelling.select(F.col("chave").alias("_k"), "canonical"), "_k", "left")
    names = names.select("_v", F.coalesce("canonical", "_t").alias("_new"))
    return df.join(names, df[column].eqNullSafe(names["_v"]), "left").withColumn(column, F.col("_new")).drop("_v", "_new")


def treated(df: DataFrame) -> DataFrame:
    """df with state, city, neighborhood, property_type and amenities in the vocabulary, is_residencial, and each raw value as <column>_raw."""
    from .market import canonical_spelling

    raw = df.withColumns({f"{c}_raw": F.col(c) for c in ("state", "city", "neighborhood", "property_type", "amenities")})
    unit = F.upper(F.trim("state"))
    raw = raw.withColumn("state", F.when(unit.rlike("^[A-Z]{2}$"), unit))
    places = raw.where(F.col("neighborhood").isNotNull()).select(vocabulary.titled(F.col("neighborhood")).alias("form")).where("form IS NOT NULL")
    spelling = canonical_spelling(folds.folded(places, "form", "ascii_key", "chave"), "chave", "form")
    out = spelled(raw, "neighborhood", spelling)
    kinds = out.select(F.col("property_type").alias("_t")).distinct().withColumn("_new", vocabulary.property_type(F.col("_t")))
    out = out.join(kinds, out["property_type"].eqNullSafe(kinds["_t"]), "left").withColumn("property_type", F.col("_new")).drop("_t", "_new")
    cities = out.select(F.col("city").alias("_c")).distinct().withColumn("_new", vocabulary.municipality(F.col("_c")))
    out = out.join(cities, out["city"].eqNullSafe(cities["_c"]), "left").withColumn("city", F.col("_new")).drop("_c", "_new")
    return out.withColumns({"is_residencial": vocabulary.residential(F.col("property_type")), "amenities": vocabulary.amenities(F.col("amenities"))})


def treatment_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """campo, distintos before and after, rows changed and new nulls of columns that have a <column>_raw, in one pass."""
    each = []
    for c in columns:
        a, b = F.col(f"{c}_raw"), F.col(c)
        each.append(F.struct(F.lit(c).alias("campo"), F.count_distinct(a).alias("antes"), F.count_distinct(b).alias("depois"), F.count_if(~F.coalesce(a, F.lit("")).eqNullSafe(F.coalesce(b, F.lit("")))).alias("mudou"), (F.count_if(b.isNull()) - F.count_if(a.isNull())).alias("novos_nulos")))
    return df.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def merged(search: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Search records with what their detail records know better: a known value of detail wins, a record without detail stays."""
    own, more = search.columns, [c for c in detail.columns if c != key]
    d = detail.select(key, *(F.col(c).alias(f"_d_{c}") for c in more))
    both = search.join(d, key, "left")
    kept = [F.coalesce(F.col(f"_d_{c}"), F.col(c)).alias(c) if c in more else F.col(c) for c in own]
    return both.select(*kept, *(F.col(f"_d_{c}").alias(c) for c in more if c not in own))


def fusion_report(df: DataFrame, fused: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: rows before and after fusing twins, rows that can't be fused (a null key), rows and number of groups of two or more, shares of nulls."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    groups = df.where(complete).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("em_grupo"), F.count("*").alias("grupos"))
    share = lambda d, when: d.agg(F.count("*").alias(f"linhas_{when}"), *(F.avg(F.col(c).isNull().cast("double")).alias(f"nulos_{when}_{c}") for c in fields))
    one = share(df, "antes").crossJoin(share(fused, "depois")).crossJoin(df.agg(F.count_if(~complete).alias("inelegiveis"))).crossJoin(groups)  # one row each
    return one.withColumn("perdidas", F.col("linhas_antes") - F.col("linhas_depois"))


def extraction_report(df: DataFrame) -> DataFrame:
    """One row of counts over amenities_fonte, amenities_texto, amenities_negadas, amenities and description_clean."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return df.agg(
        F.count("*").alias("linhas"), F.count_if(F.trim("description_clean") != "").alias("com_descricao"), F.sum(n("amenities_fonte")).alias("da_fonte"),
        F.sum(n("amenities_texto")).alias("do_texto"), F.sum(n("amenities_negadas")).alias("negadas"), F.count_if(n("amenities_texto") > 0).alias("ganharam"),
        F.count_if((n("amenities_texto") > 0) & (n("amenities_fonte") == 0)).alias("estavam_vazias"), F.count_if(n("amenities_negadas") > 0).alias("com_negacao"),
        F.avg((n("amenities_fonte") > 0).cast("double")).alias("cobertura_antes"), F.avg((n("amenities") > 0).cast("double")).alias("cobertura_depois"))


def most_common(df: DataFrame, labels: str, k: int = 15) -> DataFrame:
    """label and n of the k labels that occur most, equal counts by label."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


def levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """campo and its sorted distinct known values; a category has few."""
    each = F.array(*(F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("nivel")) for c in columns))
    pairs = df.select(F.explode(each).alias("x")).select("x.*").where("nivel IS NOT NULL").distinct()
    return pairs.groupBy("campo").agg(F.sort_array(F.collect_set("nivel")).alias("niveis"))


def neighbourhoods(df: DataFrame, city: str = "city", place: str = "neighborhood") -> DataFrame:
    """city and its sorted distinct neighbourhoods."""
    return df.where(F.col(place).isNotNull()).select(city, place).distinct().groupBy(city).agg(F.sort_array(F.collect_set(place)).alias("bairros"))


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """The text shown for a vocabulary value: its label, else the key with blanks for underscores."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else None
    plain = F.replace(key, F.lit("_"), F.lit(" "))
    return F.coalesce(known[key], plain) if known is not None else plain


def options(level_table: DataFrame, allowed: DataFrame, labels: dict[str, str]) -> DataFrame:
    """campo, nivel, rotulo of the model's levels that users may choose (allowed: campo, nivel)."""
    each = level_table.select("campo", F.explode("niveis").alias("nivel")).join(allowed, ["campo", "nivel"], "left_semi")
    return each.withColumn("rotulo", label_of(F.col("nivel"), labels))


def request_rows(df: DataFrame, questions: list[dict]) -> DataFrame:
    """Model rows from request rows. A question has api (its column in df), columns, kind (boolean, category or number), and may have
    map (answers to levels), default (of a level) and inverted (columns that only an explicit 'no' sets).

    Unanswered: false for booleans, null for the rest (or the default).
    """
    out: list[Column] = []
    for q in questions:
        v = F.col(q["api"]) if q["api"] in df.columns else F.lit(None)
        for c in q["columns"]:
            if q["kind"] == "boolean":
                yes = v.cast("boolean")
                out.append(F.coalesce(~yes if c in q.get("inverted", ()) else yes, F.lit(False)).alias(c))
            elif q["kind"] == "number":
                out.append(v.cast("double").alias(c))
            else:
                text = v.cast("string")
                if q.get("map"):
                    text = F.create_map(*[F.lit(x) for pair in q["map"].items() for x in pair])[text]
                out.append((F.coalesce(text, F.lit(q["default"])) if "default" in q else text).alias(c))
    return df.select(*[c for c in df.columns if c not in {q["api"] for q in questions}], *out)


def client_key(client: Column, salt: str) -> Column:
    """Sixteen hexadecimal digits that don't tell the client."""
    return F.substring(F.sha2(F.concat(F.lit(salt), client).cast("binary"), 256), 1, 16)


def digests(spark, glob: str) -> DataFrame:
    """arquivo and the sha256 of each file of a glob."""
    return spark.read.format("binaryFile").load(glob).select(F.col("path").alias("arquivo"), F.sha2("content", 256).alias("sha256"))


def as_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns of schema, each of its type; missing ones null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def form_cut(df: DataFrame, form: list[str], machinery: list[str]) -> DataFrame:
    """Only the form's columns and what folds and measures need; a missing one of either is an error."""
    return form_matrix(df, [*dict.fromkeys([*form, *machinery])])


def family_prevalence(df: DataFrame, families: list[str]) -> DataFrame:
    """familia and its share of rows in percent, of boolean family columns; unknown counts as no."""
    shares = df.agg(*(F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) * 100, 2).alias(c) for c in families))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(c).alias("familia"), F.col(c).alias("prevalencia")) for c in families))).alias("x")).select("x.*")
