"""Queries of text functions and sources on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amenities, coerce, folds, pii, text_rules, vocabulary
from ..operators import market
from ..sources import pages
from ..sources.listings import read, spread
from ..streaming import limiter

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("pii_scrub")
def _(spark, sf_dir):
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", pii.scrub(F.col("text")).alias("s"))
    found = F.array_join(F.transform("s.hits", lambda h: F.concat(h["kind"], F.lit("="), h["value"])), "|")
    return d.select("doc_id", F.sha2("s.text", 256).alias("texto_sha256"), found.alias("achados"), F.size("s.hits").alias("n_achados"))


@query("pii_scan_email", r"SELECT doc_id, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]{2,}'))::BIGINT AS n_email FROM documents WHERE regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.]{2,}')")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.explode(pii.scan(F.col("text"))).alias("h"))
    return d.where("h.kind = 'email'").groupBy("doc_id").agg(F.count("*").alias("n_email"))


@query("pii_gate_count")
def _(spark, sf_dir):
    return pii.scan_columns(read(spark, sf_dir, "documents").select("text", "lang")).groupBy("field", "kind").agg(F.count("*").alias("n"))


_TOLD = (
    "Vagas demarcadas e escrituradas, varanda gourmet, vista para o mar, porcelanato, apartamento novo.", "Vaga rotativa, sacada com vista livre, piso frio, precisa de reforma, mas bem localizado.",
    "Sem vaga de garagem; terraço amplo com vista lateral para o mar; box de vidro; reformado.", "Uma casa com quintal, perto de tudo, em rua tranquila e arborizada do bairro.", "curto demais",
)
_TOLD_FIELDS = {
    "rx_vaga_tipo": ("privativa_demarcada", "rotativa", "sem_vaga", "nao_menciona", "sem_descricao"), "rx_varanda_tipo": ("gourmet", "sacada", "comum", "nao_menciona", "sem_descricao"), "rx_vista": ("mar_total", "livre", "mar_parcial", "nao_menciona", "sem_descricao"),
    "rx_padrao_acabamento": ("alto", "simples", "medio", "nao_menciona", "sem_descricao"), "rx_estado_conservacao": ("novo", "precisa_reforma", "reformado", "nao_menciona", "sem_descricao"),
}
_TOLD_ORDER = {"rx_vaga_tipo": (6, 2, 0, 1), "rx_varanda_tipo": (4, 2, 3, 1), "rx_vista": (4, 2, 3, 1), "rx_padrao_acabamento": (3, 0, 2, 1), "rx_estado_conservacao": (6, 0, 5, 2)}


@query("text_rules", "WITH X AS (SELECT p_partkey, p_partkey % 5 AS m, (ARRAY[" + ", ".join(f"'{t}'" for t in _TOLD) + "])[p_partkey % 5 + 1] AS t FROM part) SELECT p_partkey, " + ", ".join(
    f"(ARRAY[{', '.join(repr(v) for v in vs)}])[m + 1] AS {f}, CASE m {' '.join(f'WHEN {i} THEN {o}' for i, o in enumerate(_TOLD_ORDER[f]))} END::INT AS {f}_ord" for f, vs in _TOLD_FIELDS.items())
    + ", CASE WHEN m < 4 THEN CASE WHEN length(t) < 130 THEN 1 ELSE 2 END END::INT AS rx_riqueza_anuncio, CASE WHEN m < 4 THEN 0 END::INT AS rx_n_itens, CASE WHEN m < 4 THEN length(t) END::INT AS rx_desc_chars, CASE WHEN m < 4 THEN len(string_split(t, ' ')) END::INT AS rx_n_palavras FROM X")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    told = F.element_at(F.array(*map(F.lit, _TOLD)), (k % 5 + 1).cast("int"))
    return text_rules.with_rules(folds.folded(read(spark, sf_dir, "part").select("p_partkey", told.alias("texto")), "texto", "prose", "t"), "t").drop("t", "texto")


@query("text_rules_documents")
def _(spark, sf_dir):
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", folds.fold(F.col("text"), "prose").alias("t"))
    return text_rules.with_rules(d, "t").drop("t")


_CONTACT = """WITH X AS (SELECT c_custkey, c_custkey % 6 AS m, '9' || lpad((c_custkey % 9000 + 1000)::VARCHAR, 4, '0') AS a, lpad((c_custkey * 7 % 10000)::VARCHAR, 4, '0') AS b FROM customer)"""


def _contacts(spark, sf_dir):
    k = F.col("c_custkey")
    a, b = F.concat(F.lit("9"), F.lpad((k % 9000 + 1000).cast("string"), 4, "0")), F.lpad((k * 7 % 10000).cast("string"), 4, "0")
    forms = [
        F.concat(F.lit("Ligue (13) "), a, F.lit("-"), b, F.lit("  agora, CEP 11055-300")), F.concat(F.lit("Escreva para joão."), k.cast("string"), F.lit("@Casa-nova.com.br hoje")), F.concat(F.lit("CPF 123.456.789-"), F.substring(b, 1, 2), F.lit(" do dono")),
        F.concat(F.lit("Falar com Maria da Silva, CRECI/SP "), b, F.lit("-F")), F.concat(F.lit(" https://wa.me/55139"), a, F.lit(" ou o site")), F.concat(F.lit("Casa de "), b, F.lit(" metros, sem contato"))]
    return read(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*forms), (k % 6 + 1).cast("int")).alias("texto"))


@query("pii_contacts", _CONTACT + """ SELECT c_custkey, CASE m WHEN 0 THEN 'Ligue [CONTATO] agora, CEP 11055-300' WHEN 1 THEN 'Escreva para [CONTATO] hoje' WHEN 2 THEN 'CPF [CONTATO] do dono' WHEN 3 THEN 'Falar com [CONTATO], CRECI/SP ' || b || '-F' WHEN 4 THEN '[CONTATO] ou o site' ELSE 'Casa de ' || b || ' metros, sem contato' END AS limpo,
  CASE m WHEN 0 THEN 'phone=(13) ' || a || '-' || b WHEN 1 THEN 'email=joão.' || c_custkey::VARCHAR || '@Casa-nova.com.br' WHEN 2 THEN 'cpf=123.456.789-' || substr(b, 1, 2) WHEN 3 THEN 'labelled_name=Maria da Silva' WHEN 4 THEN 'contact_url=https://wa.me/55139' || a ELSE '' END AS achados FROM X""")
def _(spark, sf_dir):
    d = _contacts(spark, sf_dir).select("c_custkey", pii.scrub(F.col("texto")).alias("s"))
    return d.select("c_custkey", F.col("s.text").alias("limpo"), F.array_join(F.transform("s.hits", lambda h: F.concat(h["kind"], F.lit("="), h["value"])), "|").alias("achados"))


@query("pii_columns", """WITH X AS (SELECT c_custkey % 6 AS m, c_custkey % 4 = 0 AS l FROM customer) SELECT 'texto' AS field, (ARRAY['phone', 'email', 'cpf', 'labelled_name', 'contact_url'])[m + 1] AS kind, count(*)::BIGINT AS n FROM X WHERE m < 5 GROUP BY ALL
  UNION ALL SELECT 'lista', 'email', count(*)::BIGINT FROM X WHERE l GROUP BY ALL""")
def _(spark, sf_dir):
    d = _contacts(spark, sf_dir).withColumn("lista", F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("um texto"), F.lit("a@b.com"))))
    return pii.scan_columns(d.select("texto", "lista")).groupBy("field", "kind").agg(F.count("*").alias("n"))


@query("scrubbed_links", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://a.com/' || page_id::VARCHAR || '?pagina=2' WHEN 1 THEN 'https://a.com/' || page_id::VARCHAR END AS link FROM pages""")
def _(spark, sf_dir):
    k = F.col("page_id").cast("string")
    forms = [F.concat(F.lit(" https://a.com/"), k, F.lit("?pagina=2 ")), F.concat(F.lit("HTTPS://a.com/"), k, F.lit("?tel=13988887777")), F.concat(F.lit("tel:139"), k), F.concat(F.lit("https://a.com/ana.lima@b.com/"), k)]
    return read(spark, sf_dir, "pages").select("page_id", pii.scrub_url(F.element_at(F.array(*forms), (F.col("page_id") % 4 + 1).cast("int"))).alias("link"))


@query("text_richness", "SELECT doc_id, CASE WHEN length(text) < 40 THEN NULL WHEN length(text) < 130 THEN 1 WHEN length(text) < 293 THEN 2 WHEN length(text) < 500 THEN 3 WHEN length(text) < 1071 THEN 4 ELSE 5 END::INT AS riqueza FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.char_length("text") >= 40, text_rules.richness(F.col("text"))).alias("riqueza"))


_URL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '/+$', '')"


@query("url_canonical", f"SELECT page_id, {_URL} AS pagina, substr(sha1('url|' || {_URL}), 1, 20) AS property_id FROM pages")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", coerce.url(F.col("url")).alias("pagina"), coerce.property_id(F.lit("d"), F.lit(None).cast("string"), F.col("url")).alias("property_id"))


@query("html_links", r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))::INT AS n_links FROM pages""")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.size(pages.links(F.col("html"))).alias("n_links"))


@query("fold_group", "SELECT lower(strip_accents(lang || ' ' || source)) AS chave, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat_ws(" ", "lang", "source").alias("x"))
    return folds.folded(d, "x", "vocabulary_key", "chave").groupBy("chave").agg(F.count("*").alias("n"))


@query("canonical_spelling", """WITH X AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) WHEN p_partkey % 3 = 1 THEN lower(p_brand) ELSE replace(p_brand, 'a', 'á') END AS form FROM part),
  N AS (SELECT lower(strip_accents(form)) AS k, form, count(*) AS n FROM X GROUP BY ALL)
  SELECT k AS chave, arg_max(form, (length(regexp_replace(form, '[\\x00-\\x7F]', '', 'g')), n, form)) AS canonical FROM N GROUP BY k""")
def _(spark, sf_dir):
    m = F.col("p_partkey") % 3
    x = read(spark, sf_dir, "part").select(F.when(m == 0, F.upper("p_brand")).when(m == 1, F.lower("p_brand")).otherwise(F.translate("p_brand", "a", "á")).alias("form"))
    return market.canonical_spelling(folds.folded(x, "form", "ascii_key", "chave"), "chave", "form").select("chave", "canonical")


@query("coercion", r"""WITH X AS (SELECT p_partkey, 'R$ ' || (p_partkey * 7)::VARCHAR || '.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || ',50' AS dinheiro, (p_size)::VARCHAR || '-' || (p_size + 9)::VARCHAR || ' m2' AS area, lpad(p_partkey::VARCHAR, 5, '0') || '-350' AS cep FROM part)
  SELECT p_partkey, replace(replace(regexp_replace(dinheiro, '[^0-9,.\-]', '', 'g'), '.', ''), ',', '.')::DOUBLE AS valor, regexp_extract(area, '\d+')::INT AS area, regexp_matches(area, '\d+\s*-\s*\d+') AS faixa, regexp_replace(cep, '\D', '', 'g') AS cep, substr(cep, 1, 5) AS cep_prefix FROM X""")
def _(spark, sf_dir):
    x = read(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("R$ "), (F.col("p_partkey") * 7).cast("string"), F.lit("."), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(",50")).alias("dinheiro"),
        F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 9).cast("string"), F.lit(" m2")).alias("area"), F.concat(F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("-350")).alias("cep"))
    return x.select("p_partkey", coerce.currency(F.col("dinheiro")).alias("valor"), coerce.integer(F.col("area")).alias("area"), coerce.is_range(F.col("area")).alias("faixa"), coerce.cep(F.col("cep")).alias("cep"), coerce.cep_prefix(F.col("cep")).alias("cep_prefix"))


@query("limiter", """WITH RECURSIVE E AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
  W AS (SELECT user_id, 0::BIGINT AS i, []::BIGINT[] AS held, 0::BIGINT AS ok FROM (SELECT DISTINCT user_id FROM E)
    UNION ALL SELECT user_id, i, CASE WHEN len(k) < 5 THEN list_append(k, t) ELSE k END, ok + CASE WHEN len(k) < 5 THEN 1 ELSE 0 END
    FROM (SELECT W.user_id, E.i, E.t, W.ok, list_filter(W.held, lambda x: x > E.t - 86400000000) AS k FROM W JOIN E ON E.user_id = W.user_id AND E.i = W.i + 1))
  SELECT user_id, max(ok)::BIGINT AS admitidos, (max(i) - max(ok))::BIGINT AS recusados FROM W GROUP BY user_id""")
def _(spark, sf_dir):
    return limiter.admitted(read(spark, sf_dir, "events"), "user_id", "ts", 5, 86_400.0).groupBy("user_id").agg(F.count_if("admitido").alias("admitidos"), F.count_if(~F.col("admitido")).alias("recusados"))
