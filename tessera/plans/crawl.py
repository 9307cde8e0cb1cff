"""Queries on links and crawl plans, over `pages` and anchors put into them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import crawl
from ..sources import documents
from ..sources.tables import shared_folder, table, written
from .pages import CLASSIFIED, HOST_RULES, HOST_RULES_SQL, KEYED, sql
from .registry import Registry

R = Registry()

#: Anchors of all kinds; {n} is the page's number, {h} its host, {s} its next one's.
HREFS = [
    "//{h}/products/coat-{n}?v=1", "../shop/wool-coat-no-{n}", "./p/ab{n}1234/", "?page={n}", "item/{n}12345/../987654", "HTTP://WWW.{h}:80/pd/x y/{n}", "https://other.example.net/products/{n}",
    "mailto:a@{h}", "/a/./b/../../dp/{n}", "../../../../item-item-{n}12345", "/cart/{n}99999", "/shop/пальто-{n}12345",
]
_ANCHORS = " || ".join(f"""'<a class="x" href="' || replace(replace('{h}', '{{n}}', page_id::varchar), '{{h}}', {{host}}) || '">x</a>'""" for h in HREFS)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = lambda h: F.concat(F.lit('<a class="x" href="'), F.replace(F.replace(F.lit(h), F.lit("{n}"), F.col("page_id").cast("string")), F.lit("{h}"), urls.store_host(F.col("url"))), F.lit('">x</a>'))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(*map(anchor, HREFS), "html").alias("html"))


# Links are made whole by their shape, then dots are removed by rewriting the
# path as often as any here needs, and characters are encoded one by one.
RESOLVED = (
    sql(
        r"""h as (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref=["'']([^"''#]+)["'']', 1)) as href, generate_subscripts(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref=["'']([^"''#]+)["'']', 1), 1) - 1 as place from linked),
w as (select *, regexp_extract(url, '^[a-z]+://[^/?#]*') as origin, case when {path} = '' then '/' else {path} end as base_path from h),
a as (select page_id, url, place, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '//') then regexp_extract(url, '^[a-z]+:') || href when starts_with(href, '/') then origin || href
  when starts_with(href, '?') then origin || base_path || href else origin || regexp_extract(base_path, '^(.*/)', 1) || href end as whole from w),
"""
    )
    + r"""p as (select page_id, url, place, regexp_replace(lower(regexp_extract(whole, '(?i)^https?://[^/?#]*')), ':80$', '') as start, regexp_extract(whole, '^[^:]*://[^/?#]*([^?#]*)', 1) as place_of, regexp_extract(whole, '(\?.*)$', 1) as asked from a where regexp_matches(whole, '(?i)^https?://')),
d as (select *, """
    + "regexp_replace(" * 5
    + r"regexp_replace(case when place_of = '' then '/' else place_of end, '/(\./)+', '/', 'g')"
    + r", '^(/\.\.)+(/|$)|/[^/]+/\.\.(/|$)', '/')" * 5
    + r""" as tidy from p),
links as (select page_id, url, place, start || array_to_string(list_transform(string_split(tidy, ''), lambda c: case when regexp_matches(c, '[^!-~]|["<>`{}]') then url_encode(c) else c end), '') || array_to_string(list_transform(string_split(asked, ''), lambda c: case when regexp_matches(c, '[^!-~]|["<>`{}]') then url_encode(c) else c end), '') as link from d)"""
)
LINKED = sql("linked as (select page_id, url, " + _ANCHORS + " || html as html from pages)")


@R.query(f"with {LINKED}, {RESOLVED} select page_id, place, link from links")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every anchor of a page leads: relative, rooted, without scheme,
    with dots, with characters to be encoded."""
    return crawl.page_links(_linked(spark, sf_dir), "page_id", "url", "html")


# The classifier's CTEs, over the different links by number.
_TESTED = CLASSIFIED.replace("{source}", sql("select page_id, link as url, {path} as path_of from numbered", path=sql("{path}").replace("(url,", "(link,")))
_TESTED = _TESTED.replace("with s as", "s as").replace(" select page_id, refused as non_product, (not refused) and shaped as product from f", "")
_OWN = sql("{host}") + " = " + sql("{host}").replace("(url,", "(link,")
PRODUCTS = f"""{LINKED}, {RESOLVED}, numbered as (select link, row_number() over (order by link) as page_id from (select distinct link from links)),
{_TESTED}, fine as (select link from numbered join f using (page_id) where (not refused) and shaped),
own as (select page_id, regexp_replace(link, '\\?.*$', '') as link, min(place) as place from links join fine using (link) where {_OWN} group by all)"""


@R.query(f"with {PRODUCTS} select page_id, link, min(place) as place from own group by page_id, link")
def page_product_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page to product pages of its own store, each once."""
    return crawl.product_links(_linked(spark, sf_dir), "page_id", "url", "html").select("page_id", "link", "place")


# Candidates of each store: its own pages in order of their number, those with an
# even one from a product sitemap, others as links.
PLANNED = (
    KEYED
    + sql(""", c as (select *, case when {path} = '' then '/' else {path} end || case when {query} = '' then '' else '?' || {query} end as path, case when page_id % 2 = 0 then 1 else 2 end as priority from keyed),
o as (select *, row_number() over (partition by store_host, listing_key order by priority, page_id) as n from c),
k as (select *, store_host as host from o where n = 1), fine as (select * from k where """)
    + HOST_RULES_SQL
    + "), r as (select *, row_number() over (partition by host order by priority, page_id) as place from fine)"
)
QUOTA = 7


@R.query(PLANNED + f" select page_id, host, 1 + (place - 1) // {QUOTA} as round, 1 + (place - 1) % {QUOTA} as rank from r where place <= 3 * {QUOTA}")
def crawl_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three plans one after the other: each leaves out what the ones before
    it planned, refused pages and other spellings."""
    pages = table(spark, sf_dir, "pages").withColumn("host", urls.store_host(F.col("url")))
    robots = pages.select("host").distinct().withColumn("robots_txt", F.when(F.length("host") % 2 == 0, HOST_RULES[0]).otherwise(HOST_RULES[1]))
    rules = documents.robots_rules(robots)
    candidates = pages.select("host", F.when(F.col("page_id") % 2 == 0, 1).otherwise(2).alias("priority"), F.col("page_id").alias("place"), "url")
    folder, known, rounds = f"{shared_folder(spark)}/crawl-memory-{uuid.uuid4().hex}", None, []
    for n in range(1, 4):
        plan = written(crawl.planned(candidates, rules, known, QUOTA).withColumn("round", F.lit(n).cast("long")), f"{folder}/plan-{n}")
        known = crawl.remembered(plan, f"{folder}/known")
        rounds.append(plan)
    plans = rounds[0].unionByName(rounds[1]).unionByName(rounds[2])
    first = pages.groupBy("host", urls.listing_key(F.col("url")).alias("page_key")).agg(F.min_by("page_id", F.struct(F.col("page_id") % 2, "page_id")).alias("page_id"))
    return plans.join(first, ["host", "page_key"]).select("page_id", "host", "round", F.col("rank").cast("long").alias("rank"))
