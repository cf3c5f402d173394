"""Controlled vocabularies: municipalities, neighbourhoods, property types, amenity labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import vocabulary_key

#: Official spellings of municipalities by key (a key is the spelling folded), and a name that is none.
MUNICIPALITIES = (
    "Santos", "São Vicente", "Guarujá", "Praia Grande", "Cubatão", "Bertioga", "Mongaguá", "Itanhaém", "Peruíbe", "São Paulo",
    "São Sebastião", "Ilhabela", "Ubatuba", "Caraguatatuba", "Santo André", "São Bernardo do Campo", "Guarulhos", "Osasco", "Cotia",
    "Embu das Artes", "Mogi das Cruzes", "Santa Isabel", "Atibaia", "Jaguariúna", "Campinas", "Sorocaba", "Votorantim", "Salto", "Itu",
    "Boituva", "Ibiúna", "Igaratá", "Serra Negra", "Águas de Lindóia", "Cananéia", "Pardinho", "Curitiba", "Aracruz",
)
NOT_MUNICIPALITIES = {"ribeiro dos santos"}
LOWER_WORDS = {"de", "da", "do", "das", "dos", "e"}
#: What titles add to a type, and patterns of types on folded text, the first match winning.
NOISE = re.compile(r"\s*(para\s+(alugar|locacao|venda|venda\s+e\s+locacao)|a\s+venda|de\s+locacao|venda\s+e\s+locacao|\d+\s*m2?\b|proxim[oa]\s+d[ao].*|frente\s+mar)\s*", re.I)
TYPES = {
    "kitnet": r"\bkitnet|\bkitchenette|\bconjugado",
    "apartamento": r"\bapartamento|\bapto\b",
    "cobertura": r"\bcobertura",
    "flat": r"\bflat\b",
    "studio": r"\bstudio\b",
    "sobrado": r"\bsobrado",
    "casa": r"\bcasa\b|\bvillage\b|\bsobre\s?loja",
    "terreno": r"\bterreno|\blote\b|\barea\b",
    "chacara": r"\bchacara|\bsitio|\bfazenda|\brancho",
    "sala": r"\bsala\b|\bconjunto|\blaje\b|\bandar\s+corporativo|\bescritorio",
    "loja": r"\bloja|\bponto\s+comercial|\bsalao\b|\bcomercio\b",
    "galpao": r"\bgalpao|\barmazem|\bdeposito\b",
    "predio": r"\bpredio|\bedificio\b",
    "garagem": r"\bgaragem\b|\bbox\b|\bvaga\b",
}
RESIDENTIAL = ("apartamento", "kitnet", "cobertura", "flat", "studio", "sobrado", "casa", "chacara")
COMMERCIAL = ("sala", "loja", "galpao", "predio", "garagem")
#: Families of canonical types.
FAMILIES = {"residencial": ("apartamento", "kitnet", "cobertura", "flat", "studio", "loft"), "casa": ("casa", "sobrado", "chacara"), "comercial": COMMERCIAL, "terreno": ("terreno",)}
#: Labels that mean the same, by canonical label.
SYNONYMS = {
    "aceita animais": ("aceita pet", "aceita pets", "permite animais"),
    "dependencia de empregada": ("wc empregada", "wc de empregada", "dormitorio de empregada", "quarto de empregada", "dce"),
    "armario na cozinha": ("armarios na cozinha", "cozinha planejada"),
    "armario no quarto": ("armario embutido no quarto", "armarios no quarto"),
    "salao de festas": ("salao de festas gourmet",),
    "academia": ("sala de ginastica", "fitness"),
    "piscina": ("piscina adulto",),
    "quadra esportiva": ("quadra poliesportiva",),
    "varanda": ("varanda sacada", "sacada"),
    "portaria 24 horas": ("seguranca 24 horas",),
    "acessibilidade": ("acesso para deficientes",),
    "circuito interno de tv": ("cftv",),
    "gas canalizado": ("central de gas",),
}
_CANONICAL = {x: label for label, same in SYNONYMS.items() for x in same}
_OFFICIAL = {vocabulary_key(m): m for m in MUNICIPALITIES}
_PATTERNS = {k: re.compile(v) for k, v in TYPES.items()}


def municipality_of(text: str | None) -> str | None:
    key = vocabulary_key(text or "")
    if not key or key in NOT_MUNICIPALITIES:
        return None
    return _OFFICIAL.get(key) or re.sub(r"\s+", " ", text.strip()).title()


def titled_of(text: str | None) -> str | None:
    words = (text or "").split()
    return " ".join(w.lower() if i and w.lower() in LOWER_WORDS else w[:1].upper() + w[1:].lower() for i, w in enumerate(words)) or None


def type_of(text: str | None) -> str | None:
    key = vocabulary_key(NOISE.sub(" ", text or ""))
    return next((name for name, p in _PATTERNS.items() if p.search(key)), None)


def amenity_of(text: str | None) -> str | None:
    key = vocabulary_key(text or "")
    return _CANONICAL.get(key, key) if len(key) > 1 else None


def _mapped(column: Column, make) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: make(x if isinstance(x, str) else None))

    return run(column)


def municipality(column: Column) -> Column:
    return _mapped(column, municipality_of)


def titled(column: Column) -> Column:
    """Title case with small words in lower case, native: a place's spelling keeps its accents."""
    words = F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")
    case = lambda w, i: F.when((i > 0) & F.lower(w).isin(*sorted(LOWER_WORDS)), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return F.nullif(F.array_join(F.transform(words, case), " "), F.lit(""))


def property_type(column: Column) -> Column:
    return _mapped(column, type_of)


def residential(kind: Column) -> Column:
    """Whether a canonical type is residential; null where the type doesn't tell."""
    return F.when(kind.isin(*RESIDENTIAL), True).when(kind.isin(*COMMERCIAL), False)


def family(kind: Column) -> Column:
    out = F.lit("outro")
    for name, kinds in FAMILIES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def amenities(column: Column) -> Column:
    """Canonical labels of a list, distinct and sorted."""
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: sorted({a for x in xs if (a := amenity_of(x))}) if xs is not None else [])

    return run(column)


def model_type(column: Column) -> Column:
    """The canonical type as a category of the model: null for what is unknown, so that titles in the wrong field are no levels."""
    return F.nullif(property_type(column), F.lit(""))
