"""Photos of pages: which are a piece's own, and which all pages of a store show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import photos
from ..sources.tables import sent_if_small

#: A photo on this many pages of a store is the store's.
SHOP_PAGES = 5


def harvests(pages: DataFrame, key: str) -> DataFrame:
    """(key, photos): the gallery of each page (key, url, name, trusted,
    candidates): the trusted photos and what `photos.harvested` adds, the best
    copy of each, in order. Keys are unique.

    References become rows, so that each address is taken apart once, and come
    together again page by page.
    """
    none = F.array().cast("array<string>")
    own = pages.select(F.col(key).alias("key"), "url", photos.page_identity(F.col("url"), F.col("name")).alias("identity"), F.coalesce("trusted", none).alias("trusted"), F.coalesce("candidates", none).alias("candidates"))
    every = own.select("key", "url", F.size("trusted").alias("n"), F.posexplode(F.concat("trusted", "candidates")).alias("place", "src"))
    # Exploded as an array of one, an address is worked out once.
    whole = every.select("key", "n", "place", F.explode_outer(F.array(photos.upgraded(F.col("src"), F.col("url")))).alias("photo")).filter("photo is not null")
    shots = whole.select("key", "n", "place", photos.shot(F.col("photo")).alias("shot"))
    gathered = shots.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "n", "shot"))).alias("shots"))
    of = lambda keep: F.transform(F.filter("shots", keep), lambda s: s["shot"])
    parted = gathered.join(own.select("key", "identity"), "key").select("key", "identity", of(lambda s: s["place"] < s["n"]).alias("trusted"), of(lambda s: s["place"] >= s["n"]).alias("candidates"))
    found = parted.select("key", "trusted", photos.harvested(F.col("candidates"), F.col("trusted"), F.col("identity")).alias("more"))
    listed = found.select("key", photos.best_copies(F.concat("trusted", "more")).alias("photos"))
    return own.select("key").join(listed, "key", "left").select(F.col("key").alias(key), F.coalesce("photos", none).alias("photos"))


def without_shop_photos(shown: DataFrame, most_pages: int = SHOP_PAGES) -> DataFrame:
    """The rows of `shown` (page, store, photo, ...) whose photo is on fewer than
    `most_pages` pages of its store: a logo, a banner or a size chart is on all.

    Pages are counted in a first pass, by store and photo; only photos of stores
    come back to the rows, so the second pass joins a small table.
    """
    keyed = shown.withColumn("photo_key", photos.image_key(F.col("photo")))
    once = keyed.select("store", "photo_key", "page").distinct()
    shop = once.groupBy("store", "photo_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most_pages).select("store", "photo_key")
    return keyed.join(sent_if_small(shop), ["store", "photo_key"], "left_anti").drop("photo_key")
