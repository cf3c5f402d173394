"""Typed values from raw text, as native expressions. What can't be read is null, never 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plausible ranges; outside them a value is a source's placeholder.
RANGES = {"condo_fee": (50.0, 20_000.0), "iptu_tax": (10.0, 20_000.0)}
PRICE_RANGES = {"venda": (50_000.0, 100_000_000.0), "locacao": (300.0, 200_000.0)}
RENT_WORDS, SALE_WORDS = ("aluguel", "alugar", "locacao", "locar", "rent"), ("venda", "vender", "comprar", "sale")


def currency(text: Column) -> Column:
    """'R$ 2.600,00' as 2600.0: points group thousands, the comma is decimal."""
    return F.regexp_replace(F.replace(F.regexp_replace(text, r"[^0-9,.\-]", ""), F.lit("."), F.lit("")), ",", ".").try_cast("double")


def integer(text: Column) -> Column:
    """The first whole number, points removed: '50-140 m2' is 50."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit("."), F.lit("")), r"\d+", 0), F.lit("")).try_cast("int")


def is_range(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\d+\s*(?:-|a|até)\s*\d+"), F.lit(False))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def cep(text: Column) -> Column:
    """Exactly eight digits, else null."""
    return F.when(F.length(digits(text)) == 8, digits(text))


def cep_prefix(text: Column) -> Column:
    return F.when(F.length(digits(text)) >= 5, F.substring(digits(text), 1, 5))


def transaction(slug: Column) -> Column:
    """The transaction that a slug names, rent words first."""
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(slug, F.lit(w)) for w in words))
    return F.when(has(RENT_WORDS), "locacao").when(has(SALE_WORDS), "venda")


def url(text: Column) -> Column:
    """Host without www. and path without a closing slash, in lower case: what identifies a page."""
    host = F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(F.trim(text), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))), r"^www\.", "")
    path = F.regexp_extract(F.trim(text), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(text.isNotNull(), F.concat(host, F.regexp_replace(F.lower(path), r"/+$", "")))


def property_id(domain: Column, listing_id: Column, link: Column) -> Column:
    """The listing's identity: domain and listing id, or the page."""
    seed = F.when(F.coalesce(listing_id != "", F.lit(False)), F.concat(domain, F.lit("|"), listing_id)).when(F.coalesce(link != "", F.lit(False)), F.concat(F.lit("url|"), url(link)))
    return F.substring(F.sha1(seed), 1, 20)


def state(text: Column) -> Column:
    return F.when(F.upper(F.trim(text)).rlike("^[A-Z]{2}$"), F.upper(F.trim(text)))


def month_number(month: Column) -> Column:
    return F.replace(month, F.lit("-"), F.lit("")).cast("int")


def split_list(text: Column) -> Column:
    """Trimmed, non-empty items of a comma list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def brazilian_or_plain(text: Column, plain: bool) -> Column:
    """Money with en-US decimals where plain, else pt-BR; 0 is unknown."""
    value = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double") if plain else currency(text)
    return F.nullif(value, F.lit(0.0))


def within_ranges(df: DataFrame, ranges: dict = RANGES, prices: dict = PRICE_RANGES) -> DataFrame:
    """df with values outside their range nulled, and anulados: the names of those fields."""
    bad = {c: ~F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns}
    off = F.lit(False)
    for kind, (lo, hi) in prices.items():
        off = off | ((F.col("transaction_type") == kind) & ~F.col("price").between(lo, hi))
    bad["price"] = F.coalesce(off, F.lit(False))
    bad = {c: F.coalesce(b, F.lit(False)) for c, b in bad.items()}
    names = F.array_compact(F.array(*(F.when(b, F.lit(c)) for c, b in bad.items())))
    return df.withColumn("anulados", names).withColumns({c: F.when(~F.array_contains("anulados", c), F.col(c)) for c in bad})


def reject_reason(required: list[str], kinds: tuple[str, ...] = ("venda", "locacao")) -> Column:
    """Why a record can't be kept: missing fields first, then an unknown transaction; null if it can."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string") == "", F.lit(True)), F.lit(c)) for c in required)))
    kind = F.coalesce(F.col("transaction_type").isin(*kinds), F.lit(False))
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))).when(~kind, F.lit("transaction_type"))


def month_of(date: Column) -> Column:
    """yyyy-MM of a date or of text that begins with one; of yyyyMM too. Null for anything else."""
    text = date.cast("string")
    return F.when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])(-|$)"), F.substring(text, 1, 7)).when(text.rlike(r"^\d{4}(0[1-9]|1[0-2])$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2)))
