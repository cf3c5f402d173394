"""Canonical text keys. Spark has no Unicode normalisation, so these are Arrow-batched functions.

Low-cardinality columns should be folded once per distinct value: see folded().
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Abbreviations of street names, expanded in this order, and words left out of a street's key.
STREET_WORDS = {
    "av": "avenida", "r": "rua", "pc": "praca", "pca": "praca", "al": "alameda", "tv": "travessa", "rod": "rodovia", "estr": "estrada",
    "lgo": "largo", "vl": "vila", "jd": "jardim", "pq": "parque", "mal": "marechal", "pres": "presidente", "prof": "professor",
    "dr": "doutor", "sen": "senador", "dep": "deputado", "cel": "coronel", "com": "comendador", "sta": "santa", "sto": "santo",
    "s": "sao", "cap": "capitao", "eng": "engenheiro", "visc": "visconde", "bar": "barao",
}
STREET_STOP = {"de", "da", "do", "das", "dos", "e", "a", "o"}


_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


def _decomposed(m: re.Match) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", m[0]) if not unicodedata.combining(c))


def plain(text: str) -> str:
    """Compatibility-decomposed, without combining marks. ASCII is plain already, so only the rest is looked at."""
    return text if text.isascii() else _BEYOND_ASCII.sub(_decomposed, text)


def vocabulary_key(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", re.sub(r"[/-]", " ", plain(text).lower()))).strip()


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", plain(text).lower()).strip("-")


def street_key(text: str) -> str:
    kept = []
    for word in re.sub(r"[^a-z0-9\s]", " ", plain(text).lower()).split():
        full = STREET_WORDS.get(word, word)
        if full not in STREET_STOP:
            kept.append(full)
    return " ".join(kept)


def place(text: str) -> str:
    return re.sub(r"\s+", " ", plain(text)).strip().title()


def prose(text: str) -> str:
    """Lower-case, collapsed white space, not trimmed. Single blanks, most of a text's, need no replacement."""
    return re.sub(r"\s\s+|[^\S ]", " ", plain(text)).lower()


def ascii_key(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()).strip().lower()


def city_key(text: str) -> str:
    return plain(text).strip().lower().replace(" ", "-")


KINDS = {f.__name__: f for f in (vocabulary_key, slug, street_key, place, prose, ascii_key, city_key)}


def fold(column: Column, kind: str) -> Column:
    """A text key of each value; null is the empty text, as everywhere in the listings."""
    make = KINDS[kind]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: make(x) if x else "")

    return run(column)


def folded(df: DataFrame, column: str, kind: str, name: str) -> DataFrame:
    """df with the key of a column, computed once per distinct value and joined back (Spark broadcasts it where it is small)."""
    keys = df.select(F.col(column).alias("_value")).distinct().withColumn(name, fold(F.col("_value"), kind))
    return df.join(keys, df[column].eqNullSafe(keys["_value"]), "left").drop("_value")


def usable(key: Column) -> Column:
    """Whether a street key is specific enough to join on."""
    return F.char_length(key) >= 4
