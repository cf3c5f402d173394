"""Ordinal attributes from descriptions, by ordered patterns on prose-folded text, as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (level, pattern) in order of precedence, and each field's scale.
RULES = {
    "rx_vaga_tipo": (
        ("sem_vaga", r"\bnao\s+(possui|possua|tem|tenha|ha|conta\s+com)\s+(vaga|garagem)|\bsem\s+(vaga|garagem)|\bvagas?\s+a\s+parte\b|\baquisicao\s+de\s+vaga|\bvaga\s+para\s+moto(s|cicleta)?\b(?!.*\bvaga\s+(de\s+)?(carro|auto))|\bgaragem\s+(exclusiva\s+)?para\s+motocicleta"),
        ("sorteio", r"\bsorteio\b"),
        ("rotativa", r"\brotativ[ao]s?"),
        ("coletiva", r"\bcoletiv[ao]s?|\bcoleti[ck]a|\bman[o]?brista|\bvalet\b|\bcompartilhad[ao]s?|\binsuficiente|\bempilhad[ao]s?"),
        ("privativa_demarcada", r"\b(demarcad[ao]s?|escriturad[ao]s?|em\s+escritura|consta\s+(da|na)\s+escritura)"),
        ("privativa", r"\bvagas?\b|\bgaragem\b|\bgaragens\b"),
    ),
    "rx_varanda_tipo": (
        ("gourmet", r"\b(varanda|terraco)\s+gourmet|varanda\s+com\s+churrasqueira"),
        ("sacada", r"\bsacada"),
        ("comum", r"\b(varanda|terraco|varandao)\b"),
    ),
    "rx_vista": (
        ("mar_parcial", r"\bvista\s+(lateral|parcial)|(lateral|parcial)\s+(para\s+o|do|pro)\s+mar"),
        ("mar_total", r"\bvista\s+(definitiva\s+|permanente\s+|total\s+|panoramica\s+)?(para\s+o|pro|do|ao)\s*mar|\bvista\s+mar\b|\bfrente\s+(para\s+o\s+|ao\s+)?mar\b"),
        ("livre", r"\bvista\s+(totalmente\s+)?livre|\bvista\s+panoramica"),
    ),
    "rx_padrao_acabamento": (
        ("alto", r"\b(alto\s+padrao|fino\s+acabamento|porcelanato|marmore|granito|sanca\s+de\s+gesso|gesso\s+rebaixado|iluminacao\s+(projetada|embutida)|acabamento(s)?\s+(de\s+)?(alta\s+qualidade|alto\s+padrao|modernos?|sofisticad)|piso\s+(de\s+)?(madeira|tabua|ipe)|closet|hidromassagem|borda\s+infinita)\b"),
        ("simples", r"\bpiso\s+frio\b|\b(piso|acabamento)\s+(em\s+)?ceramic[ao]\b|\bcarpete\b"),
        ("medio", r"\b(armarios?\s+planejad|moveis\s+planejad|cozinha\s+planejad|box\s+(de\s+)?(vidro|blindex)|laminad[ao])\b"),
    ),
    "rx_estado_conservacao": (
        ("precisa_reforma", r"\b(precisa\s+de\s+reforma|necessita\s+de\s+reforma|potencial\s+de\s+moderniz|para\s+reformar|reformar\s+e\s+personaliz)"),
        ("novo", r"\b(novo\s+em\s+construcao|apartamento\s+novo|imovel\s+novo|predio\s+novo|recem\s+entregue|entregue\s+e\s+pronto\s+para\s+morar|novissimo)\b"),
        ("em_obra", r"\bem\s+construcao\b|\bem\s+obras\b|\bna\s+planta\b|\blancamento\b|\bentrega\s+(prevista|em|para)\b|\bprevisao\s+de\s+entrega\b|\bsera\s+entregue\b|\bfase\s+final\s+de\s+construcao\b"),
        ("reformado", r"\breformad[ao]|\bmoderniz(ado|ada|acao)\b|\brenovad[ao]\b|\beletrica\s+(nova|totalmente\s+reformada)|\bpintura\s+recente\b"),
        ("bom", r"\b(bem\s+conservad[ao]|otimo\s+estado|excelente\s+estado|impecavel|super\s+arrumad[ao]|muito\s+bem\s+cuidad[ao])\b"),
    ),
}
#: A text without any of a level's words can't match its pattern: most texts are told by these alone, in RULES' order.
WORDS = {
    "rx_vaga_tipo": (("vaga", "garagem"), ("sorteio",), ("rotativ",), ("coleti", "brista", "valet", "compartilhad", "insuficiente", "empilhad"), ("demarcad", "escritura"), ("vaga", "garage")),
    "rx_varanda_tipo": (("varanda", "terraco"), ("sacada",), ("varanda", "terraco")),
    "rx_vista": (("lateral", "parcial"), ("vista", "frente"), ("vista",)),
    "rx_padrao_acabamento": (("padrao", "acabamento", "porcelanato", "marmore", "granito", "gesso", "iluminacao", "piso", "closet", "hidromassagem", "borda"), ("piso", "acabamento", "carpete"), ("planejad", "box", "laminad")),
    "rx_estado_conservacao": (("reforma", "moderniz"), ("novo", "entregue", "novissimo"), ("construcao", "obras", "planta", "lancamento", "entreg"), ("reformad", "moderniz", "renovad", "eletrica", "pintura"), ("conservad", "estado", "impecavel", "arrumad", "cuidad")),
}
SCALES = {
    "rx_vaga_tipo": ("sem_vaga", "nao_menciona", "rotativa", "sorteio", "coletiva", "privativa", "privativa_demarcada"),
    "rx_varanda_tipo": ("nenhuma", "nao_menciona", "sacada", "comum", "gourmet"),
    "rx_vista": ("interna", "nao_menciona", "livre", "mar_parcial", "mar_total"),
    "rx_padrao_acabamento": ("simples", "nao_menciona", "medio", "alto"),
    "rx_estado_conservacao": ("precisa_reforma", "original", "nao_menciona", "bom", "em_obra", "reformado", "novo"),
}
UNDER_CONSTRUCTION = r"\bem\s+construcao\b|\bem\s+obras\b|\bna\s+planta\b|\blancamento\b|\bentrega\s+(prevista|em|para)\b|\bprevisao\s+de\s+entrega\b|\bsera\s+entregue\b"
RICHNESS = (130, 293, 500, 1071)
ITEM = r"[•\-\*\n]|\b(possui|conta\s+com|dispoe|oferece)\b"
LEAST = 40


def level(text: Column, field: str) -> Column:
    """The first matching level of a field; patterns are tried on texts that hold one of the level's words."""
    out = F.lit("nao_menciona")
    for (name, pattern), words in reversed(list(zip(RULES[field], WORDS[field], strict=True))):
        held = reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
        out = F.when(held & text.rlike("(?U)" + pattern), name).otherwise(out)
    return out


def richness(text: Column) -> Column:
    """1 to 5 by length."""
    out = F.lit(5)
    for i, cut in reversed(list(enumerate(RICHNESS, 1))):
        out = F.when(F.char_length(text) < cut, i).otherwise(out)
    return out


def with_rules(df: DataFrame, text: str) -> DataFrame:
    """df with the fields of RULES and their ordinals, richness, items, characters and words of a folded text column.

    A text of fewer than LEAST characters is no description: its fields are sem_descricao, its numbers null.
    """
    t, has = F.col(text), F.char_length(text) >= LEAST
    df = df.withColumns({f: F.when(has, level(t, f)).otherwise("sem_descricao") for f in RULES})
    order = {f: F.nullif(F.array_position(F.array(*map(F.lit, SCALES[f])), F.col(f)), F.lit(0)) - 1 for f in RULES}
    df = df.withColumns({f"{f}_ord": o.cast("int") for f, o in order.items()})
    return df.withColumns({
        "rx_riqueza_anuncio": F.when(has, richness(t)), "rx_n_itens": F.when(has, F.regexp_count(t, F.lit(ITEM))),
        "rx_desc_chars": F.when(has, F.char_length(t)), "rx_n_palavras": F.when(has, F.regexp_count(t, F.lit(r"\s+")) + 1),
    })


def under_construction(text: Column) -> Column:
    return F.coalesce(text.rlike("(?U)" + UNDER_CONSTRUCTION), F.lit(False))
