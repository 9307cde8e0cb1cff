"""Queries over `pages`: identity, classification and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, text, urls
from ..sources import documents
from ..sources.tables import table
from .registry import Registry

R = Registry()

# SQL building blocks; each mirrors one function of the package.
HOST = r"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '\.$', '')"
PATH = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def sql(body: str, **more: str) -> str:
    """Fill in {host}, {path}, {query} of `url`, and lists of words."""
    parts = {"host": HOST.format(u="url"), "path": PATH.format(u="url"), "query": QUERY.format(u="url")} | more
    for name, value in parts.items():
        body = body.replace("{" + name + "}", value)
    return body


def sql_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


KEY = sql(
    r"""({host} || (case when tidy = '' then '/' else tidy end) || (case when asked = '' then '' else '?' || asked end))"""
)
KEYED = sql(
    r"""
with p as (
  select page_id, url,
    regexp_replace(regexp_replace(regexp_replace({path}, '/{2,}', '/', 'g'), '/+$', ''), '^/collections/[^/]+(/products/[^/]+)$', '\1', 'i') as tidy,
    array_to_string(list_transform(list_sort(list_transform(list_filter(string_split({query}, '&'),
      lambda x: x <> '' and split_part(x, '=', 1) <> '' and not regexp_matches(lower(split_part(x, '=', 1)), '^({tracking})$')),
      lambda x: {'k': split_part(x, '=', 1), 'v': regexp_replace(x, '^[^=]*=?', '')})), lambda s: s.k || '=' || s.v), '&') as asked
  from pages
), keyed as (select page_id, url, {host} as store_host, """,
    tracking=urls.TRACKING,
) + KEY + " as listing_key from p)"


@R.query(sql("select page_id, {host} as store_host from pages"))
def page_store_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.store_host(F.col("url")).alias("store_host"))


@R.query(KEYED + " select page_id, listing_key from keyed")
def page_listing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.listing_key(F.col("url")).alias("listing_key"))


@R.query(KEYED + " select store_host, count(*) as n_pages, count(distinct listing_key) as n_keys, arg_min(page_id, (length(listing_key), listing_key, page_id)) as keeper_page from keyed group by store_host")
def page_store_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each store, how many are different, and one to keep."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.store_host(F.col("url")).alias("store_host"), urls.listing_key(F.col("url")).alias("listing_key"))
    return p.groupBy("store_host").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.countDistinct("listing_key").alias("n_keys"),
        F.min_by("page_id", F.struct(F.length("listing_key"), "listing_key", "page_id")).alias("keeper_page"),
    )


@R.query(KEYED + ", r as (select *, row_number() over (partition by listing_key order by page_id) as n from keyed) select page_id, listing_key from r where n = 1")
def page_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each key: an order-keeping distinct."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.listing_key(F.col("url")).alias("listing_key"))
    return p.groupBy("listing_key").agg(F.min("page_id").alias("page_id")).select("page_id", "listing_key")


@R.query(KEYED + " select a.page_id as page_a, b.page_id as page_b from keyed a join keyed b on a.listing_key = b.listing_key and a.page_id < b.page_id")
def page_same_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of addresses of one page, found by their key."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.listing_key(F.col("url")).alias("listing_key"))
    a, b = p.withColumnRenamed("page_id", "page_a"), p.withColumnRenamed("page_id", "page_b")
    return a.join(b, "listing_key").filter("page_a < page_b").select("page_a", "page_b")


@R.query(
    sql(
        r"""
with s as (select page_id, list_filter(string_split(lower({path}), '/'), lambda x: x <> '') as s from pages)
select page_id, case when coalesce(regexp_matches(s[1], '^[a-z]{2}([-_][a-z]{2})?$'), false) and coalesce(regexp_matches(s[2], '^[a-z]{2}([-_][a-z]{2})?$'), false) then s[1] || '/' || s[2]
  when coalesce(regexp_matches(s[1], '^[a-z]{2}([-_][a-z]{2})?$'), false) then s[1] else '' end as locale from s
"""
    )
)
def page_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.locale_prefix(urls.path(F.col("url"))).alias("locale"))


CODE = r"(regexp_matches(regexp_replace({x}, '\.(html?|aspx|jsp|php)$', '', 'i'), '[0-9]{5,}') or regexp_matches(regexp_replace({x}, '\.(html?|aspx|jsp|php)$', '', 'i'), '(^|[^a-z0-9])[a-z]{1,3}[0-9]{4,}', 'i'))"
SLUG = r"""(length(regexp_replace({x}, '\.(html?|aspx|jsp|php)$', '', 'i')) >= 12 and len(list_filter(regexp_split_to_array(regexp_replace({x}, '\.(html?|aspx|jsp|php)$', '', 'i'), '[-_]'), lambda w: w <> '')) >= 3
  and len(list_filter(regexp_split_to_array(regexp_replace({x}, '\.(html?|aspx|jsp|php)$', '', 'i'), '[-_]'), lambda w: w <> '' and (w in {listing} or not regexp_matches(w, '^[a-z0-9]+$')))) = 0
  and len(list_filter(regexp_split_to_array(regexp_replace({x}, '\.(html?|aspx|jsp|php)$', '', 'i'), '[-_]'), lambda w: regexp_matches(w, '^[a-z]{3,}$'))) > 0)"""


def lists(body: str) -> str:
    names = {"strong": urls.STRONG_SEGMENTS, "weak": urls.WEAK_SEGMENTS, "refused": urls.NON_PRODUCT_SEGMENTS, "sections": urls.SHOP_SECTIONS, "parents": urls.SECTION_PARENTS, "listing": urls.LISTING_WORDS}
    for n, words in names.items():
        body = body.replace("{" + n + "}", sql_list(words))
    return body.replace("{list_file}", urls.LISTING_FILE).replace("{product_file}", urls.PRODUCT_FILE)


CLASSIFIED = lists(
    sql(r"with s as (select page_id, url, list_filter(string_split(lower(path_of), '/'), lambda x: x <> '') as s from ({source})), ")
    + r"""f as (
  select page_id, len(s) = 0 or len(list_filter(s, lambda x: x in {refused})) > 0 or coalesce(regexp_matches(s[-1], '{list_file}'), false) as refused,
    len(list_filter(s, lambda x: x in {strong} or starts_with(x, 'productpage'))) > 0 or coalesce(regexp_matches(s[-1], '-item-[0-9]{5,}(\.[a-z]+)?$'), false) or coalesce(regexp_matches(s[-1], '{product_file}'), false)
    or (len(list_filter(s, lambda x: """
    + CODE.replace("{x}", "x")
    + """)) > 0 and len(list_filter(s, lambda x: x in {weak})) > 0)
    or coalesce("""
    + CODE.replace("{x}", "s[-1]")
    + """, false)
    or (coalesce(s[-2] not in {parents}, true) and len(list_filter(s[1:-2], lambda x: x in {sections})) > 0 and coalesce("""
    + SLUG.replace("{x}", "s[-1]")
    + """, false)) as shaped
  from s
) select page_id, refused as non_product, (not refused) and shaped as product from f"""
)
#: Paths of several shapes made from the pages' own, so that all rules occur.
SHAPES = ["", "/products/x{id}", "/p/ab{id}", "/shop/long-named-piece{id}", "/collections/long-named-piece{id}", "/cart/x{id}", "/z/item-item-123{id}.html", "/shop/new-arrivals-{id}", "/a/search.php"]


def _shaped(pages: DataFrame) -> DataFrame:
    choice = F.col("page_id") % len(SHAPES)
    tail = F
    for k, shape in enumerate(SHAPES):
        tail = tail.when(choice == k, F.replace(F.lit(shape), F.lit("{id}"), F.col("page_id").cast("string")))
    return pages.select("page_id", "url", F.concat(urls.path(F.col("url")), tail.otherwise("")).alias("path_of"))


SHAPED_SQL = sql("select page_id, url, {path} || replace(case " + " ".join(f"when page_id % {len(SHAPES)} = {k} then '{s}'" for k, s in enumerate(SHAPES)) + " end, '{id}', page_id::varchar) as path_of from pages")


@R.query(CLASSIFIED.replace("{source}", SHAPED_SQL))
def page_product_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product and non-product paths, over pages' paths of all shapes."""
    p = _shaped(table(spark, sf_dir, "pages"))
    return p.select("page_id", urls.non_product_path(F.col("path_of")).alias("non_product"), urls.product_path(F.col("path_of")).alias("product"))


@R.query(
    r"""
with t as (select page_id, list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda h: {clean}) as h, {title} as title from pages)
select page_id, array_to_string(list_filter(h, lambda x: x <> '' and length(x) <= 200)[1:5], ' / ') as headings, title from t
""".replace("{clean}", "{C:h}").replace("{title}", "{C:regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)}")
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(text.headings(F.col("html")), " / ").alias("headings"), text.title(F.col("html")).alias("title"))


def _strip(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ([,.;:!?])', '\\1', 'g'))"


def _decode(x: str) -> str:
    for name, value in text.ENTITIES.items():
        x = f"replace({x}, '&{name};', '{value.replace(chr(39), chr(39) * 2)}')"
    return x


import re as _re  # noqa: E402

R.oracles["page_headings"] = _re.sub(r"\{C:(h|regexp_extract\(html, '[^']*', 1\))\}", lambda m: _decode(_strip(m[1])), R.oracles["page_headings"])


@R.query("select page_id, regexp_extract(html, '(?i)<html[^>]*\\slang=[\"'']([^\"'']+)', 1) as language from pages")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.language(F.col("html")).alias("language"))


@R.query(f"select page_id, length({_strip('html')}) as n_chars from pages")
def page_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.strip_tags(F.col("html"))).cast("long").alias("n_chars"))


@R.query(
    sql(
        r"""
with a as (select page_id, {host} as host, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref=["'']([^"''#]+)["'']', 1)) as href from pages)
select page_id, count(distinct href) as n_links, min(href) as first_link from a where starts_with(href, '/') group by page_id
"""
    )
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different links of each page into its own host."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode_outer(F.regexp_extract_all("html", F.lit("(?i)<a\\b[^>]*\\bhref=[\"']([^\"'#]+)[\"']"), 1)).alias("href"))
    return p.filter(F.col("href").startswith("/")).groupBy("page_id").agg(F.countDistinct("href").alias("n_links"), F.min("href").alias("first_link"))


@R.query(
    KEYED
    + sql(r""", w as (select page_id, trim(url) as raw, store_host as h, substr(listing_key, length(store_host) + 1) as rest, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) as scheme from keyed),
v as (select page_id, raw, h, scheme, split_part(rest, '?', 1) as p, regexp_extract(rest, '(\?.*)$', 1) as q from w),
e as (select page_id, unnest([raw, 'https://'||h||p||q, 'https://'||h||(case when p = '/' then p else p||'/' end)||q, 'https://www.'||h||p||q, 'https://www.'||h||(case when p = '/' then p else p||'/' end)||q,
  scheme||'://'||h||p||q, scheme||'://'||h||(case when p = '/' then p else p||'/' end)||q, scheme||'://www.'||h||p||q, scheme||'://www.'||h||(case when p = '/' then p else p||'/' end)||q]) as s from v)
select page_id, count(distinct s) as n, min(s) as first, max(s) as last from e group by page_id""")
)
def page_url_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", urls.url_spellings(F.col("url")).alias("s"))
    return p.select("page_id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("first"), F.array_max("s").alias("last"))


LABEL = r"case when len(l) < 2 then coalesce(l[1], '') when l[-2] in {registry} and len(l) >= 3 then l[-3] else l[-2] end".replace("{registry}", sql_list(urls.REGISTRY_LABELS))


@R.query(
    sql(
        r"with l as (select page_id, list_filter(string_split({host}, '.'), lambda x: x <> '') as l from pages), r as (select page_id, "
        + LABEL
        + " as r from l) select page_id, case when r = '' or r in "
        + sql_list(urls.TRACKER_HOSTS)
        + " then 'Store' else upper(r[1:1]) || r[2:] end as store_name, regexp_replace(r, '[^a-z0-9]', '', 'g') as shop_label from r"
    )
)
def page_store_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", urls.store_name(F.col("url")).alias("store_name"), urls.shop_label(urls.store_host(F.col("url"))).alias("shop_label"))


@R.query(sql("select page_id, regexp_replace(url, '#.*$', '') as url_bare, {host} || lower(regexp_replace({path}, '/+$', '')) as page_key, case when contains(lower(url), 'product') then 0 when regexp_matches(lower(url), 'blog|article|page|collection|marketing') then 2 else 1 end as rank from pages"))
def page_keys_and_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragment strip, lower-case page key and sitemap rank."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.without_fragment(u).alias("url_bare"), urls.page_key(u).alias("page_key"), urls.rank_child(u).alias("rank"))


@R.query(
    sql(
        r"""with s as (select page_id, list_filter(string_split(lower({path}), '/'), lambda x: x <> '') as s from pages)
select page_id, array_to_string(list_transform(s[greatest(len(s) - 1, 1):], lambda x: trim(regexp_replace(regexp_replace(x, '\.(html?|aspx|jsp|php)$', '', 'i'), '[-_+]+', ' ', 'g'))), ' · ') as label from s"""
    )
)
def page_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.label_from_path(F.col("url")).alias("label"))


#: What a shop's page carries besides its text: data in scripts, inline images, attributes that only style.
NOISE = "<script type=\"application/ld+json\">{\"@type\":\"Product\",\"sku\":\"S{id}\"}</script><script>var a = {id};</script><style>b{}</style><svg><path d=\"M{id}\"/></svg><!-- {id} --><img class=\"c{id}\" data-src=\"p{id}.jpg\" srcset=\"p{id}-2.jpg 2x\" src=\"data:image/gif;base64,R{id}\" aria-label='x {id}' data-track=\"t\">"
NOISY = "replace('" + NOISE.replace("'", "''") + "', '{id}', page_id::varchar) || html"
# Each cut is written out, as this dialect has neither back references nor looking ahead.
CUTS = [
    r"(?is)<script\b[^>]*type=[\"'']application/ld\+json[\"''][^>]*>.*?</script>",
    *(rf"(?is)<{t}\b[^>]*>.*?</{t}>" for t in ("script", "style", "noscript", "svg")),
    r"(?s)<!--.*?-->",
    r"(?i)(?:src|href)\s*=\s*(?:\"data:[^\"'']*\"|''data:[^\"'']*'')",
]
ATTRIBUTES = r"(?is)\s(?:class|style|srcset|sizes|data-track|aria-[\w-]+|id|role|tabindex)\s*=\s*(?:\".*?\"|''.*?'')"


def _condensed_sql() -> str:
    out = "h"
    for cut in CUTS:
        out = f"regexp_replace({out}, '{cut}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '{ATTRIBUTES}', '', 'g'), '\\s+', ' ', 'g'))"


@R.query(
    f"with p as (select page_id, html, {NOISY} as h from pages), c as (select page_id, html, '<!-- json-ld -->' || regexp_extract(h, '<script type=\"application/ld.json\">(.*?)</script>', 1) || chr(10) || '<!-- /json-ld -->' || chr(10) as head, {_condensed_sql()} as body from p) "
    + f"select page_id, md5(head || body[1:2000 - length(head)]) as condensed, length(head) + least(length(body), 2000 - length(head)) as n_condensed, regexp_matches(html, '{text.BOT_TITLE}') as bot_check from c"
)
def page_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut down for a model: their data first, then text without noise;
    and pages that only ask whether a visitor is human."""
    noise = F.replace(F.lit(NOISE), F.lit("{id}"), F.col("page_id").cast("string"))
    short = text.condensed(F.concat(noise, F.col("html")), 2000)
    rows = table(spark, sf_dir, "pages").select("page_id", short.alias("s"), text.bot_check(F.col("html")).alias("bot_check"))
    return rows.select("page_id", F.md5("s").alias("condensed"), F.length("s").cast("long").alias("n_condensed"), "bot_check")


COUNTRY = "case " + " ".join(f"when {{x}} = '{k}' then '{v}'" for k, v in money.COUNTRY_CURRENCY.items()) + " end"
LANGUAGE = "case " + " ".join(f"when {{x}} = '{k}' then '{v}'" for k, v in money.LANGUAGE_CURRENCY.items()) + " end"


@R.query(
    sql(
        "with l as (select page_id, split_part({host}, '.', -1) as tld, lower(case when page_id % 4 = 0 then 'uk-UA' when page_id % 4 = 1 then 'ja' when page_id % 4 = 2 then 'en' else 'pt_BR' end) as tag from pages), t as (select page_id, tld, string_split(replace(tag, '_', '-'), '-') as t from l) select page_id, coalesce("
        + COUNTRY.replace("{x}", "tld")
        + ", case when length(t[2]) = 2 and t[2] <> 'eu' then "
        + COUNTRY.replace("{x}", "t[2]")
        + " end, case when t[2] is null then "
        + LANGUAGE.replace("{x}", "t[1]")
        + " end) as currency from t"
    )
)
def page_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency that host and language tag suggest."""
    tag = F.when(F.col("page_id") % 4 == 0, "uk-UA").when(F.col("page_id") % 4 == 1, "ja").when(F.col("page_id") % 4 == 2, "en").otherwise("pt_BR")
    return table(spark, sf_dir, "pages").select("page_id", money.currency_from_locale(urls.store_host(F.col("url")), tag).alias("currency"))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\nDisallow: /fr/2\nCrawl-delay: 2\n"
# Lengths of the rules' patterns decide; the one with `$` ends the path.
ROBOTS_SQL = r"(greatest(case when starts_with({p}, '/en/1') then 5 else 0 end) >= greatest(case when starts_with({p}, '/en/') then 4 else 0 end, case when regexp_matches({p}, '^/.*\.html$') then 8 else 0 end, case when starts_with({p}, '/fr/2') then 5 else 0 end))"


def _robots(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    hosts = pages.select(urls.store_host(F.col("url")).alias("host")).distinct()
    return documents.robots_rules(hosts.withColumn("robots_txt", F.lit(ROBOTS))), pages.select(urls.store_host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")).distinct()


@R.query(sql("with p as (select distinct {host} as host, {path} as path from pages) select host, path, " + ROBOTS_SQL.replace("{p}", "path") + " as allowed from p"))
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path under its host's robots.txt: the longest rule decides."""
    rules, paths = _robots(spark, table(spark, sf_dir, "pages"))
    return documents.allowed(paths, rules)


# Hosts with names of even length write one file, others another.
HOST_RULES = {
    0: "User-agent: a\nSitemap: /s\nUser-agent: *\nNoindex: /\nDisallow: /en/ # all of it\nAllow: /en/*5$\n\nUser-agent: b\nDisallow: /",
    1: "User-agent: *\nDisallow: /*2\nAllow: /*/1\nCrawl-delay: 1\nDisallow:\n",
}
HOST_RULES_SQL = """case when length(host) % 2 = 0 then not starts_with(path, '/en/') or regexp_matches(path, '^/en/.*5$')
  else not regexp_matches(path, '^/.*2') or regexp_matches(path, '^/.*/1') end"""


@R.query(sql("with p as (select distinct {host} as host, case when {path} = '' then '/' else {path} end as path from pages) select host, path, " + HOST_RULES_SQL + " as allowed from p"))
def robots_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under a robots.txt of each host's own."""
    path = F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url")))
    paths = table(spark, sf_dir, "pages").select(urls.store_host(F.col("url")).alias("host"), path.alias("path")).distinct()
    robots = paths.select("host").distinct().withColumn("robots_txt", F.when(F.length("host") % 2 == 0, HOST_RULES[0]).otherwise(HOST_RULES[1]))
    return documents.allowed(paths, documents.robots_rules(robots))


SITEMAPPED = CLASSIFIED.replace("{source}", "select page_id, url, path_of from (" + SHAPED_SQL + ")")


@R.query(SITEMAPPED.replace(" select page_id, refused as non_product", sql(", c as (select page_id, refused, (not refused) and shaped as product from f), h as (select page_id, {host} as host, url from pages) select host, count(*) as n, min(c.page_id) as first_page from c join h using (page_id) where case when c.page_id % 2 = 0 then not refused else product end group by host --")))
def sitemap_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages out of two sitemaps of each store, one of them named after
    products."""
    p = _shaped(table(spark, sf_dir, "pages")).withColumn("host", urls.store_host(F.col("url")))
    # The page's number travels as a parameter, so that no two addresses are one.
    address = F.concat(F.lit("https://www."), F.col("host"), F.col("path_of"), F.lit("?n="), F.col("page_id").cast("string"))
    entry = F.concat(F.lit("<loc>"), F.replace(address, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    named = F.when(F.col("page_id") % 2 == 0, "product-sitemap.xml").otherwise("sitemap.xml")
    # A sitemap holds 50,000 addresses at most; larger stores have several.
    maps = p.groupBy("host", named.alias("named"), F.floor(F.col("page_id") / 50_000)).agg(F.concat_ws("", F.collect_list(entry)).alias("xml"))
    found = documents.sitemap_products(maps.select("host", F.concat(F.lit("https://"), "host", F.lit("/"), "named").alias("url"), "xml"))
    number = F.regexp_extract("location", r"\?n=([0-9]+)$", 1).cast("long")
    return found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("first_page"))


@R.query(
    KEYED
    + sql(""", c as (select *, {path} as path, row_number() over (partition by listing_key order by page_id) as n from keyed), k as (select * from c where n = 1 and """)
    + ROBOTS_SQL.replace("{p}", "path")
    + "), r as (select page_id, store_host, row_number() over (partition by store_host order by page_id) as place from k) select page_id, store_host, place from r where place <= 10"
)
def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten allowed pages of each store, each page once, in order."""
    pages = table(spark, sf_dir, "pages")
    rules, paths = _robots(spark, pages)
    allowed = documents.allowed(paths, rules).filter("allowed").select("host", "path")
    keyed = pages.select("page_id", urls.listing_key(F.col("url")).alias("k"), urls.store_host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    once = keyed.groupBy("k").agg(F.min_by(F.struct("page_id", "host", "path"), "page_id").alias("p")).select("p.*")
    place = F.row_number().over(W.partitionBy("host").orderBy("page_id"))
    ranked = once.join(allowed, ["host", "path"], "left_semi").withColumn("place", place).filter("place <= 10")
    return ranked.select("page_id", F.col("host").alias("store_host"), F.col("place").cast("long").alias("place"))


@R.query(
    sql(
        r"""with a as (select page_id, {host} as host, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref=["'']([^"''#]+)["'']', 1))) as href from pages),
d as (select distinct host, href from a), n as (select host, href, (row_number() over (partition by host order by href) - 1) // 20 as batch from d)
select host, batch, count(*) as n_links, min(href) as first_link from n group by host, batch"""
    )
)
def link_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each store in batches of twenty, as they'd go to a model."""
    p = table(spark, sf_dir, "pages").select(urls.store_host(F.col("url")).alias("host"), F.explode_outer(F.regexp_extract_all("html", F.lit("(?i)<a\\b[^>]*\\bhref=[\"']([^\"'#]+)[\"']"), 1)).alias("href"))
    n = F.row_number().over(W.partitionBy("host").orderBy("href"))
    numbered = p.filter("href is not null").distinct().withColumn("batch", F.floor((n - 1) / 20))
    return numbered.groupBy("host", "batch").agg(F.count(F.lit(1)).alias("n_links"), F.min("href").alias("first_link"))


@R.query(sql("with u as (select {host} as host, url from pages) select host, count(*) as n_locations, count(distinct url) as n_distinct, min(url) as first_location from u group by host"))
def sitemap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations read back from a sitemap of each store's pages."""
    p = table(spark, sf_dir, "pages").select(urls.store_host(F.col("url")).alias("host"), "page_id", F.concat(F.lit("<url><loc><![CDATA[ "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("]]></loc></url>")).alias("entry"))
    # A sitemap holds 50,000 addresses at most; larger stores have several.
    xml = p.groupBy("host", F.floor(F.col("page_id") / 50_000)).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "entry"))), lambda x: x["entry"]), "").alias("xml"))
    locs = xml.select("host", F.explode(documents.locations(F.col("xml"))).alias("url"))
    return locs.groupBy("host").agg(F.count(F.lit(1)).alias("n_locations"), F.countDistinct("url").alias("n_distinct"), F.min("url").alias("first_location"))


@R.query(
    sql(
        """with u as (select {host} as host, page_id, url, case when contains(lower(url), 'product') then 0 when regexp_matches(lower(url), 'blog|article|page|collection|marketing') then 2 else 1 end as rank from pages),
r as (select *, row_number() over (partition by host order by rank, page_id) as place from u where rank < 2) select host, page_id, rank, place from r where place <= 10"""
    )
)
def sitemap_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most promising children of each store's index."""
    p = table(spark, sf_dir, "pages").select(urls.store_host(F.col("url")).alias("host"), "page_id", urls.rank_child(F.col("url")).alias("rank")).filter("rank < 2")
    place = F.row_number().over(W.partitionBy("host").orderBy("rank", "page_id"))
    return p.withColumn("place", place.cast("long")).filter("place <= 10")


@R.query(
    sql(
        r"""with t as (select {host} as host, list_sort(list_distinct(list(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' – Shop | ' || {host}))) as titles from pages group by 1)
select host, len(titles) as n_titles, case when len(titles) >= 3 then ' – Shop | ' || host else '' end as suffix from t"""
    )
)
def store_title_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What at least three different titles of a store all end in, from its
    first separator on."""
    host = urls.store_host(F.col("url"))
    p = table(spark, sf_dir, "pages").select(host.alias("host"), F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" – Shop | "), host).alias("title"))
    # What all strings share at the end, the least and the greatest of the
    # reversed ones share at the front, so no store's titles are gathered.
    back = F.reverse("title")
    t = p.groupBy("host").agg(F.countDistinct("title").alias("n_titles"), F.array(F.reverse(F.min(back)), F.reverse(F.max(back))).alias("ends"))
    cut = text.title_suffix(text.longest_common_suffix(F.col("ends")))
    return t.select("host", "n_titles", F.when(F.col("n_titles") >= 3, cut).otherwise("").alias("suffix"))


@R.query(
    sql(
        """with p as (select page_id, {host} as host, page_id % 3 as n from pages)
select page_id, 0 as pos, 'piece ' || page_id as name, host as brand, null as url, '4006381333931' as gtin, (page_id % 90 + 10)::varchar as price, 'EUR' as currency, false as in_list from p
union all select page_id, k, 'other ' || k, null, 'https://' || host || '/' || k, null, (page_id + k)::varchar, null, true from p, range(1, 4) as r(k) where k <= n"""
    )
)
def page_product_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product nodes of JSON-LD put into the pages, walked breadth first: a
    piece and none to two others in a list."""
    n, host = F.col("page_id"), urls.store_host(F.col("url"))
    text = lambda c: c.cast("string")
    kind = lambda k: F.lit(k).alias("@type")
    piece = F.struct(
        kind("Product"), F.concat(F.lit("piece "), text(n)).alias("name"), F.struct(host.alias("name")).alias("brand"), F.lit("4006381333931").alias("gtin13"),
        F.struct(text(n % 90 + 10).alias("price"), F.lit("EUR").alias("priceCurrency")).alias("offers"),
    )
    one = lambda k: F.struct(F.struct(F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), F.concat(F.lit("other "), text(k)).alias("name"), F.concat(F.lit("https://"), host, F.lit("/"), text(k)).alias("url"), F.array(F.struct((n + k).alias("lowPrice"))).alias("offers")).alias("item"))
    listed = F.struct(kind("ItemList"), F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda k: k <= n % 3), one).alias("itemListElement"))
    graph = F.concat(F.lit('{"@graph":['), F.to_json(piece), F.lit(","), F.to_json(listed), F.lit("]}"))
    block = F.concat(F.lit('<script type="application/ld+json">'), graph, F.lit('</script><script type="application/ld+json">{bad</script>'))
    return documents.product_nodes(table(spark, sf_dir, "pages").select("page_id", F.concat("html", block).alias("html")), "page_id", "html")


@R.query(r"""with t as (select page_id, unnest(regexp_extract_all('<meta name="description" content="a &amp; b"><meta name="description" content="second">' || html, '(?is)<meta\s[^>]*>')) as t from pages),
k as (select page_id, lower(regexp_extract(t, '(?i)(?:property|name|itemprop)=["'']([^"'']+)', 1)) as k from t) select page_id, count(distinct k) as n_tags, 'a & b' as description from k where k <> '' group by page_id""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta tags of each page: how many, and the description."""
    m = table(spark, sf_dir, "pages").select("page_id", text.meta(F.concat(F.lit('<meta name="description" content="a &amp; b"><meta name="description" content="second">'), F.col("html"))).alias("m"))
    return m.select("page_id", F.size("m").cast("long").alias("n_tags"), F.col("m")["description"].alias("description"))
