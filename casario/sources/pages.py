"""Captured pages: links, JSON-LD blocks, sitemaps."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: JSON-LD types that may be kept, types that name people or agencies, and keys that hold contacts.
ALLOWED = {
    "Product", "IndividualProduct", "Offer", "AggregateOffer", "Apartment", "House", "SingleFamilyResidence", "Residence", "Accommodation", "Place",
    "PostalAddress", "GeoCoordinates", "RealEstateListing", "BuyAction", "RentAction", "BreadcrumbList", "ItemList",
}
FORBIDDEN = {"Person", "Organization", "RealEstateAgent", "LocalBusiness", "ContactPoint", "Corporation"}
CONTACT_KEYS = {
    "telephone", "email", "phone", "fax", "faxnumber", "contactpoint", "seller", "agent", "broker", "author", "creator", "publisher", "provider",
    "offeredby", "employee", "founder", "member", "owner", "landlord", "contact", "whatsapp", "mobile", "name_contact", "brand",
}
_SCRIPT = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)


def links(html: Column) -> Column:
    """Distinct link targets of a page, native."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1))


def _types(node: dict) -> set[str]:
    kind = node.get("@type", [])
    return set(kind) if isinstance(kind, list) else {kind}


def _nodes(value):
    """Every typed object of a JSON-LD value, outer before inner."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if "@type" in x:
                yield x
            stack += [v for v in reversed(list(x.values())) if isinstance(v, (dict, list))]
        elif isinstance(x, list):
            stack += reversed(x)


def _without_contacts(value):
    if isinstance(value, dict):
        return {k: _without_contacts(v) for k, v in value.items() if k.lower() not in CONTACT_KEYS}
    return [_without_contacts(v) for v in value] if isinstance(value, list) else value


def blocks_of(html: str | None) -> list[dict]:
    """types and JSON of the allowed JSON-LD objects of a page, without contacts; unreadable scripts are skipped."""
    found = []
    for script in _SCRIPT.findall(html or ""):
        try:
            data = json.loads(script.strip())
        except ValueError:
            continue
        for node in _nodes(data):
            kinds = _types(node)
            if kinds & ALLOWED and not kinds & FORBIDDEN:
                found.append({"types": sorted(kinds), "json": json.dumps(_without_contacts(node), ensure_ascii=False)})
    return found


def blocks(html: Column) -> Column:
    """array(struct(types, json)) of each page; nesting of any depth isn't expressible in JSON paths."""
    @F.pandas_udf("array<struct<types:array<string>,json:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(blocks_of)

    return run(html)


def value_at(block_json: Column, path: str) -> Column:
    """Text at a dotted path of a block; a list on the way gives its first element."""
    # Only what begins as a list is read as one (parsing plain text fails slowly), and each step's text is bound, not built again.
    first = lambda text, at: F.when(text.rlike(r"^\s*\["), F.get_json_object(text, f"$[0]{at}"))
    bound = lambda text, f: F.get(F.transform(F.array(text), f), F.lit(0))
    member = lambda key: lambda t: F.coalesce(first(t, f".{key}"), F.get_json_object(t, f"$.{key}"))
    out = block_json
    for key in path.split("."):
        out = bound(out, member(key))
    return bound(out, lambda t: F.coalesce(first(t, ""), t))


def first_of_type(blocks_column: Column, types: tuple[str, ...], path: str | None = None) -> Column:
    """The first block of one of the types (its JSON, or the value at a path that the first such block has); null without one."""
    fitting = F.filter(blocks_column, lambda b: F.arrays_overlap(b["types"], F.array(*map(F.lit, types))))
    values = F.transform(fitting, lambda b: value_at(b["json"], path) if path else b["json"])
    return F.try_element_at(F.array_compact(values), F.lit(1))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """loc and lastmod of a sitemap's entries, each loc once."""
    found = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return found.where("loc IS NOT NULL").groupBy(F.trim("loc").alias("loc")).agg(F.max("lastmod").alias("lastmod"))


def nested_sitemap(spark: SparkSession, path: str, located, depth: int = 3) -> DataFrame:
    """The entries of a sitemap and of the sitemaps that it names, `depth` levels down; each loc once. What is no XML has no entries.

    located(loc) gives the path of a fetched sitemap. An index names a few dozen files.
    """
    level, seen, out = [path], {path}, None
    for _ in range(depth):
        for p in level:
            own = sitemap(spark, p)
            out = own if out is None else out.unionByName(own)
        names = [r[0] for p in level for r in spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(p).where("loc IS NOT NULL").collect()]
        level = [q for q in dict.fromkeys(located(n.strip()) for n in names) if q not in seen]
        seen.update(level)
        if not level:
            break
    return out.groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def facets(url: Column, html: Column) -> Column:
    """Whole addresses of the facets that a page links: links below its own path, of 4 to 81 characters more, that end in a slash.

    They come from the page's own links, as each city has its own grammar of paths.
    """
    path = F.parse_url(url, F.lit("PATH"))
    host = F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("HOST")))
    found = F.regexp_extract_all(html, F.lit('href="([^"?#]+/)"'), F.lit(1))
    more = lambda link: F.char_length(link) - F.char_length(path)
    below = F.filter(found, lambda link: F.startswith(link, path) & (more(link) >= 4) & (more(link) <= 81))
    return F.coalesce(F.transform(F.array_distinct(below), lambda link: F.concat(host, link)), F.array().cast("array<string>"))


def harvest(pages: DataFrame, seeds: DataFrame, rounds: int = 30) -> DataFrame:
    """url, rodada and lida (whether the page is stored) of all that can be reached from the seeds by facets, each once.

    Breadth first: a round reads the facets of the stored pages of the last one and drops what any round has met. pages may
    hold an address several times; seeds is a table with url. Rounds are written, so that a lost executor repeats one at most.
    """
    from ..operators.training import written

    links = written(pages.where("url IS NOT NULL").select("url", facets(F.col("url"), F.col("html")).alias("facetas")).groupBy("url").agg(F.array_distinct(F.flatten(F.collect_set("facetas"))).alias("facetas")), "links")
    new = written(seeds.where("url IS NOT NULL").select("url").distinct().withColumn("rodada", F.lit(0)), "frontier")
    seen = new
    for n in range(1, rounds + 1):
        found = new.join(links, "url").select(F.explode("facetas").alias("url")).distinct()
        new = written(found.join(seen, "url", "left_anti").withColumn("rodada", F.lit(n)), "frontier")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    else:
        raise RuntimeError(f"facets go deeper than {rounds} rounds")
    return seen.join(links.select("url", F.lit(True).alias("lida")), "url", "left").withColumn("lida", F.coalesce("lida", F.lit(False)))


def listing_links(html: Column) -> Column:
    """array(struct(id, url)) of the listings that a search page links (addresses with -id-<number>), the first address of each id."""
    at = r'href="([^"]*-id-(\d+)[^"]*)"'
    urls, ids = (F.regexp_extract_all(html, F.lit(at), F.lit(g)) for g in (1, 2))
    firsts = F.filter(F.transform(ids, lambda x, i: F.when(F.array_position(ids, x) == i + 1, i)), lambda i: i.isNotNull())
    return F.transform(firsts, lambda i: F.struct(F.get(ids, i).alias("id"), F.get(urls, i).alias("url")))


def allowed_types(types: Column) -> Column:
    """The types of a block that may be kept; empty where one of them is forbidden."""
    of = lambda names: F.array(*map(F.lit, sorted(names)))
    return F.when(F.size(F.array_intersect(types, of(FORBIDDEN))) == 0, F.array_intersect(types, of(ALLOWED))).otherwise(F.array().cast("array<string>"))
