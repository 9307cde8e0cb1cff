"""Semi-structured documents: sitemaps, robots.txt, JSON-LD, storefront JSON."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money, urls

# The shape of a storefront's product JSON.
STOREFRONT = "struct<title:string,vendor:string,product_type:string,images:array<struct<src:string,position:int>>,options:array<struct<name:string,values:array<string>>>,variants:array<struct<price:string,compare_at_price:string,option1:string,available:boolean>>>"
PRODUCT_TYPES = ("Product", "ProductGroup")


def locations(xml: Column) -> Column:
    """Addresses of a sitemap, bare or in CDATA, ampersands decoded."""
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*(?:<!\[CDATA\[\s*)?([^<\s\]]+)"), 1)
    return F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def is_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


def sitemap_products(sitemaps: DataFrame, host: str = "host", url: str = "url", xml: str = "xml") -> DataFrame:
    """(host, location) of the product pages that stores' sitemaps list.

    A sitemap that is named after products is believed but for addresses that
    can't be a product's; in others an address has to look like one. Addresses
    on other hosts are left out, an index lists no pages, and each page is
    given once.
    """
    maps = sitemaps.filter(~is_index(F.col(xml))).select(F.col(host).alias("host"), urls.names_products(F.col(url)).alias("trusted"), F.explode(locations(F.col(xml))).alias("location"))
    path = urls.path(F.col("location"))
    kept = F.when(F.col("trusted"), ~urls.non_product_path(path)).otherwise(urls.product_path(path))
    own = maps.filter((urls.store_host(F.col("location")) == F.col("host")) & kept)
    return own.select("host", urls.without_fragment(F.col("location")).alias("location")).distinct()


def robots_rules(robots: DataFrame, host: str = "host", text: str = "robots_txt") -> DataFrame:
    """(host, kind, pattern, regex) rules of the `*` groups of each robots.txt.

    User-agent lines that follow one another, whatever lines of no group stand
    between, share the rules after them. A rule without a pattern says nothing,
    and neither does a text that is a web page. regex holds for the paths that
    the pattern covers: `*` is any run of characters, `$` at the end is the end,
    and all else stands for itself.
    """
    known = ["user-agent", "allow", "disallow", "crawl-delay"]
    lines = robots.filter(~F.col(text).rlike(r"^\s*<")).select(F.col(host), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("n", "raw"))
    tidy = lines.withColumn("raw", F.trim(F.substring_index("raw", "#", 1))).filter(F.col("raw").contains(":"))
    parts = tidy.select(host, "n", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("kind"), F.trim(F.regexp_replace("raw", "^[^:]*:", "")).alias("pattern"))
    by = W.partitionBy(host).orderBy("n")
    agents = parts.filter(F.col("kind").isin(known)).withColumn("is_agent", F.col("kind") == "user-agent")
    starts = F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(by), F.lit(False))
    grouped = agents.withColumn("group", F.sum(starts.cast("int")).over(by))
    star = grouped.filter(F.col("is_agent") & (F.col("pattern") == "*")).select(host, "group").distinct()
    rules = grouped.filter(~F.col("is_agent") & (F.col("pattern") != "")).join(star, [host, "group"], "left_semi")
    return rules.select(host, "kind", "pattern", pattern_regex(F.col("pattern")).alias("regex"))


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression anchored at the start."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    plain = F.regexp_replace(body, r"([.\[\]{}()+?^$|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(plain, F.lit("*"), F.lit(".*")), F.when(ends, "$").otherwise(""))


def allowed(paths: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """paths with `allowed`: the longest matching rule decides, allow on ties.
    An empty path is the root."""
    rules = rules.filter("kind <> 'crawl-delay'").select(F.col(host).alias("rule_host"), "kind", "pattern", "regex")
    asked = F.when(F.coalesce(F.col(path), F.lit("")) == "", "/").otherwise(F.col(path))
    hits = paths.join(rules, (F.col(host) == F.col("rule_host")) & F.call_function("rlike", asked, F.col("regex")), "left")
    longest = lambda kind: F.max(F.when(F.col("kind") == kind, F.length("pattern")))
    best = hits.groupBy(host, path).agg(longest("allow").alias("a"), longest("disallow").alias("d"))
    return best.select(host, path, (F.coalesce("a", F.lit(0)) >= F.coalesce("d", F.lit(0))).alias("allowed"))


def json_ld(html: Column) -> Column:
    """The bodies of a page's JSON-LD scripts."""
    return F.regexp_extract_all(html, F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), 1)


def product_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, name, brand, url, gtin, price, currency, in_list) of every
    product node in a page's JSON-LD, breadth first; bad JSON is skipped."""

    def walk(blocks: list) -> Iterator[tuple[dict, bool]]:
        queue = deque((b, False) for b in blocks)
        while queue:
            node, in_list = queue.popleft()
            if isinstance(node, list):
                queue += [(x, in_list) for x in node]
            elif isinstance(node, dict):
                kinds = node.get("@type")
                product = any(k in PRODUCT_TYPES for k in (kinds if isinstance(kinds, list) else [kinds]))
                if product:
                    yield node, in_list
                queue += [(v, in_list or k in ("itemListElement", "isRelatedTo", "isSimilarTo")) for k, v in node.items() if isinstance(v, (dict, list)) and not (product and k in ("hasVariant", "offers", "brand"))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, bodies in zip(batch["key"], batch["bodies"], strict=True):
                blocks = []
                for body in bodies if bodies is not None else ():
                    try:
                        blocks.append(json.loads(body))
                    except ValueError:
                        continue
                for pos, (node, in_list) in enumerate(walk(blocks)):
                    offers = node.get("offers") or {}
                    offers = offers[0] if isinstance(offers, list) and offers else offers
                    offers = offers if isinstance(offers, dict) else {}
                    brand = node.get("brand")
                    brand = brand.get("name") if isinstance(brand, dict) else brand
                    text = lambda v: None if v is None else str(v)
                    rows.append((page, pos, text(node.get("name")), text(brand), text(node.get("url")), text(node.get("gtin13") or node.get("gtin")), text(offers.get("price") or offers.get("lowPrice")), text(offers.get("priceCurrency")), in_list))
            yield pd.DataFrame(rows, columns=["key", "pos", "name", "brand", "url", "gtin", "price", "currency", "in_list"])

    source = pages.select(F.col(key).alias("key"), json_ld(F.col(html)).alias("bodies"))
    kind = source.schema["key"].dataType
    fields = [T.StructField("key", kind), T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("name", "brand", "url", "gtin", "price", "currency")), T.StructField("in_list", T.BooleanType())]
    return source.mapInPandas(read, T.StructType(fields)).withColumnRenamed("key", key)


GTIN_KEYS = ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "ean", "isbn")


def _texts(value) -> list[str]:
    """The texts of a value that may be one, a list, or an object with a name."""
    if isinstance(value, list):
        return [t for v in value for t in _texts(v)]
    if isinstance(value, dict):
        return _texts(value.get("name") or value.get("value"))
    return [] if value is None else [str(value).strip()]


def _listed(value) -> list[dict]:
    found = value if isinstance(value, list) else [value]
    return [v for v in found if isinstance(v, dict)]


def product_variants(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, group_name, brand, group_id, color, size, gtin, url, price,
    currency) of every variant of the product groups in a page's JSON-LD, in
    order; a product without variants is its own. Bad JSON is skipped."""
    names = ["key", "pos", "group_name", "brand", "group_id", "color", "size", "gtin", "url", "price", "currency"]

    def variants(block) -> Iterator[tuple]:
        queue = deque([block])
        while queue:
            node = queue.popleft()
            if isinstance(node, list):
                queue += node
            elif isinstance(node, dict):
                kinds = node.get("@type")
                kinds = kinds if isinstance(kinds, list) else [kinds]
                if not any(k in PRODUCT_TYPES for k in kinds):
                    queue += [v for v in node.values() if isinstance(v, (dict, list))]
                    continue
                for v in _listed(node.get("hasVariant")) or [node]:
                    offer = (_listed(v.get("offers")) or [{}])[0]
                    first = lambda *values: next((t for x in values for t in _texts(x) if t), None)
                    extra = {str(x.get("name", "")).lower(): x for x in _listed(v.get("additionalProperty"))}
                    code = first(*(x.get(k) for x in (v, offer, node) for k in GTIN_KEYS))
                    yield (first(node.get("name")), first(node.get("brand")), first(node.get("productGroupID")), first(v.get("color"), extra.get("color")), first(v.get("size"), extra.get("size")), code, first(v.get("url"), offer.get("url")), first(offer.get("price"), offer.get("lowPrice")), first(offer.get("priceCurrency")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, bodies in zip(batch["key"], batch["bodies"], strict=True):
                found = []
                for body in bodies if bodies is not None else ():
                    try:
                        found += variants(json.loads(body))
                    except ValueError:
                        continue
                rows += [(page, pos, *v) for pos, v in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    source = pages.select(F.col(key).alias("key"), json_ld(F.col(html)).alias("bodies"))
    fields = [T.StructField("key", source.schema["key"].dataType), T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names[2:])]
    return source.mapInPandas(read, T.StructType(fields)).withColumnRenamed("key", key)


def shown_variants(variants: DataFrame, pages: DataFrame, key: str, url: str) -> DataFrame:
    """One record per page: the variant whose address is the page's, else the
    first; the sizes, least and greatest price of its colour, and the addresses
    of other colours."""
    own = variants.join(pages.select(key, F.col(url).alias("page_url")), key).withColumn("shown", F.coalesce(urls.same_listing(F.col("url"), F.col("page_url")), F.lit(False)))
    lead = own.groupBy(key).agg(F.min_by(F.struct("group_name", "brand", "group_id", "color", "gtin"), F.struct((~F.col("shown")).alias("later"), "pos")).alias("lead"))
    joined = own.join(lead, key).withColumn("same", F.col("color").eqNullSafe(F.col("lead.color"))).withColumn("amount", money.parse_price(F.col("price")))
    listed = lambda keep, value: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(keep & F.col(value).isNotNull(), F.struct("pos", value)))), lambda x: x[value]))
    return joined.groupBy(key).agg(
        F.first("lead").alias("lead"), listed(F.col("same"), "size").alias("sizes"), F.min(F.when(F.col("same") & (F.col("amount") > 0), F.col("amount"))).alias("least_price"),
        F.max(F.when(F.col("same"), F.col("amount"))).alias("most_price"), listed(~F.col("same"), "url").alias("other_colours"),
    ).select(key, "lead.*", "sizes", "least_price", "most_price", "other_colours")


def breadcrumbs(html: Column) -> Column:
    """Names of a page's breadcrumb list, by position."""
    item = "struct<position:int,name:string,item:struct<name:string>>"
    lists = F.filter(F.transform(json_ld(html), lambda b: F.from_json(b, f"`@type` string, itemListElement array<{item}>")), lambda b: b["@type"] == "BreadcrumbList")
    items = F.array_sort(F.transform(F.try_element_at(lists, F.lit(1))["itemListElement"], lambda i: F.struct(i["position"].alias("p"), F.coalesce(i["name"], i["item"]["name"]).alias("n"))))
    return F.coalesce(F.filter(F.transform(items, lambda i: i["n"]), lambda n: n.isNotNull()), F.array().cast("array<string>"))


def storefront_product(body: Column) -> Column:
    """struct of a storefront's product JSON: images by place, least price,
    greatest former price above it, sizes, sold out or not."""
    p = F.from_json(body, STOREFRONT)
    prices = F.transform(p["variants"], lambda v: v["price"].cast("double"))
    former = F.array_max(F.transform(p["variants"], lambda v: v["compare_at_price"].cast("double")))
    return F.struct(
        p["title"].alias("name"),
        p["vendor"].alias("brand"),
        F.transform(F.array_sort(F.transform(p["images"], lambda i: F.struct(i["position"], i["src"]))), lambda i: i["src"]).alias("images"),
        F.array_min(prices).alias("price"),
        F.when(former > F.array_min(prices), former).alias("former_price"),
        F.array_distinct(F.transform(p["variants"], lambda v: v["option1"])).alias("sizes"),
        F.exists(p["variants"], lambda v: v["available"]).alias("available"),
    )


def shared_look(encoded: Column) -> Column:
    """array<struct> of an address-safe base64 JSON list: at most 12 pieces,
    ids up to 64 characters, images of web addresses only."""
    text = F.decode(F.unbase64(F.translate(encoded, "-_", "+/")), "UTF-8")
    pieces = F.from_json(text, "array<struct<id:string,name:string,image:string>>")
    return F.slice(F.filter(pieces, lambda p: (F.length(p["id"]) <= 64) & (p["image"].isNull() | p["image"].rlike("^https?://"))), 1, 12)
