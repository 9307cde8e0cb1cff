"""What to fetch of a store next: links of pages, and plans that remember."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import documents

#: How a page names another one.
ANCHOR = r"(?i)<a\b[^>]*\bhref=[\"']([^\"'#]+)[\"']"
BASE = r"(?i)<base\b[^>]*\bhref=[\"']([^\"']+)[\"']"
#: Shares that a store's candidates are ranked in before they are ranked as a whole.
SHARES = 64


def page_links(pages: DataFrame, key: str, url: str, html: str, follow_base: bool = False) -> DataFrame:
    """(key, place, link): the addresses that a page's anchors lead to, in
    order; `follow_base` heeds the page's base element. Null html has none."""
    base = F.col(url)
    if follow_base:
        stated = F.regexp_extract(html, BASE, 1)
        base = F.when(stated != "", F.coalesce(urls.resolved(stated, base), base)).otherwise(base)
    anchors = pages.select(F.col(key).alias("key"), base.alias("base"), F.posexplode(F.regexp_extract_all(html, F.lit(ANCHOR), 1)).alias("place", "href"))
    # As an exploded array a link is worked out once: a filter on it would else be
    # pushed below, with the whole expression in it, wherever it is tested.
    found = anchors.select("key", "place", F.explode_outer(F.array(urls.resolved(F.col("href"), F.col("base")))).alias("link"))
    return found.filter("link is not null").withColumnRenamed("key", key)


def product_links(pages: DataFrame, key: str, url: str, html: str, nodes: DataFrame | None = None, follow_base: bool = False) -> DataFrame:
    """(key, place, link) of the product pages that a page links to, each once:
    those that its structured data names (`nodes`: key, place, url), whatever
    they look like, then anchors into its own store whose path is a product's,
    without query. Places count within each kind, structured data first."""
    source = pages.select(F.col(key).alias("key"), F.col(url).alias("page_url"), F.col(html).alias("html"))
    anchors = page_links(source, "key", "page_url", "html", follow_base).join(source.select("key", "page_url"), "key")
    own = anchors.filter(urls.same_store(F.col("link"), F.col("page_url")) & urls.product_path(urls.path(F.col("link"))))
    every = own.select("key", F.lit(1).alias("kind"), "place", F.regexp_replace("link", r"\?.*$", "").alias("link"))
    if nodes is not None:
        stated = nodes.filter(F.col("url").rlike("^https?://")).select(F.col(key).alias("key"), F.lit(0).alias("kind"), "place", urls.without_fragment(F.col("url")).alias("link"))
        every = every.unionByName(stated)
    first = every.groupBy("key", "link").agg(F.min(F.struct("kind", "place")).alias("first"))
    return first.select(F.col("key").alias(key), F.col("first.kind").alias("kind"), F.col("first.place").alias("place"), "link")


def ranked(rows: DataFrame, by: str, order: list[str], most: int, spread: str) -> DataFrame:
    """`rows` with `rank`, the first `most` of each `by` in `order` (which tells
    all rows apart). Each share of a group is ranked by itself first, so that no
    task sorts a large group whole: at most SHARES * most rows of it meet."""
    share = F.pmod(F.xxhash64(spread), F.lit(SHARES))
    few = rows.withColumn("share", share).withColumn("rank", F.row_number().over(W.partitionBy(by, "share").orderBy(*order))).filter(F.col("rank") <= most)
    whole = few.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return whole.filter(F.col("rank") <= most).drop("share")


def planned(candidates: DataFrame, rules: DataFrame, known: DataFrame | None = None, most: int = 2000) -> DataFrame:
    """(host, url, page_key, rank) of what to fetch next, at most `most`
    addresses of each store.

    candidates (host, priority, place, url): the lower priority comes first (a
    product page that was asked for, product sitemaps, links), then the lower
    place; host is the store that was asked for. An address of another store,
    one met before under another spelling, one in `known` (page_key, as planned
    before) and one that `rules` (from `documents.robots_rules`) refuse are left
    out. Known addresses are an anti join on a key that occurs once on either
    side, so it neither skews nor squares; its result is smaller than the
    candidates whatever the size of the memory.
    """
    own = candidates.filter(urls.store_host(F.col("url")) == F.col("host"))
    keyed = own.withColumn("page_key", urls.listing_key(F.col("url")))
    once = keyed.groupBy("host", "page_key").agg(F.min(F.struct("priority", "place", "url")).alias("first")).select("host", "page_key", "first.*")
    if known is not None:
        once = once.join(known.select("page_key").distinct(), "page_key", "left_anti")
    place = F.concat(urls.path(F.col("url")), F.when(urls.query(F.col("url")) != "", F.concat(F.lit("?"), urls.query(F.col("url")))).otherwise(""))
    asked = once.withColumn("asked", place)
    fine = documents.allowed(asked.select("host", F.col("asked").alias("path")).distinct(), rules).filter("allowed").select("host", F.col("path").alias("asked"))
    kept = asked.join(fine, ["host", "asked"], "left_semi")
    return ranked(kept, "host", ["priority", "place", "page_key"], most, "page_key").select("host", "url", "page_key", "rank")


def remembered(plan: DataFrame, folder: str) -> DataFrame:
    """Append a plan's addresses to the memory in `folder` and return the whole
    memory (page_key), for the next plan's `known`."""
    plan.select("page_key").write.mode("append").parquet(folder)
    return plan.sparkSession.read.parquet(folder)
