"""Markup beyond plain tags: microdata, photos, titles, rules and styles."""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text, urls
from .binding import let

# Microdata fields and words of shops' titles.
FIELDS = ["name", "brand", "description", "image", "price", "priceCurrency", "sku", "gtin13", "color", "material"]
BOILERPLATE = r"(?i)^(?:buy(?:\s+online)?|shop(?:\s+online)?|online(?:\s+(?:store|shop))?|official(?:\s+(?:site|store))?|free\s+shipping|fast\s+delivery|sale|discounts?|price|best\s+price|new\s+arrivals?)$"
SEPARATORS = r"\s+[|—–·•]\s+|\s+-\s+"
GENERIC_LABELS = ["www", "shop", "store", "m", "en", "com", "net", "org", "co", "uk", "example"]


def microdata(html: Column) -> Column:
    """map of itemprop to its content attribute, else its element's text, for
    the fields that are there."""
    def one(field: str) -> Column:
        content = F.regexp_extract(html, f'(?is)<[a-z]+[^>]*itemprop="{field}"[^>]*content="([^"]*)"', 1)
        inner = text.strip_tags(F.regexp_extract(html, f'(?is)<([a-z0-9]+)[^>]*itemprop="{field}"[^>]*>(.*?)</\\1>', 2))
        return text.decode_entities(F.when(content != "", content).otherwise(inner))

    pairs = F.filter(F.array(*(F.struct(F.lit(f).alias("k"), one(f).alias("v")) for f in FIELDS)), lambda p: p["v"] != "")
    return F.map_from_entries(pairs)


def all_meta(html: Column, key: str) -> Column:
    """Every content of one meta key, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(f'(?is)<meta[^>]*(?:property|name)="{re.escape(key)}"[^>]*content="([^"]*)"'), 1), text.decode_entities)


def image_candidates(html: Column) -> Column:
    """Addresses of photos in image tags, preloads, backgrounds and srcsets,
    the first of each."""
    found = [
        F.regexp_extract_all(html, F.lit('(?is)<img[^>]*\\s(?:src|data-src|data-zoom)="([^"]+)"'), 1),
        F.regexp_extract_all(html, F.lit('(?is)<link[^>]*as="image"[^>]*href="([^"]+)"'), 1),
        F.regexp_extract_all(html, F.lit("(?is)background(?:-image)?:\\s*url\\(['\"]?([^'\")]+)"), 1),
        F.flatten(F.transform(F.regexp_extract_all(html, F.lit('(?is)srcset="([^"]+)"'), 1), srcset_urls)),
    ]
    return F.array_distinct(F.filter(F.concat(*found), lambda u: ~u.startswith("data:")))


def srcset_urls(value: Column) -> Column:
    """Addresses of a srcset: parted by a comma and space or after a size, so
    commas inside an address survive."""
    parts = F.split(F.trim(value), r"(?<=\s[0-9.]{1,9}[wx])\s*,\s*|,\s+")
    return F.filter(F.transform(parts, lambda p: F.substring_index(F.trim(p), " ", 1)), lambda u: u != "")


def store_names(html: Column, url: Column) -> Column:
    """What a page's shop may be called: its site name and its host's labels."""
    labels = F.filter(F.split(urls.store_host(url), r"\."), lambda x: ~x.isin(GENERIC_LABELS) & (F.length(x) >= 3))
    return F.array_distinct(F.transform(F.concat(all_meta(html, "og:site_name"), labels), lambda n: F.lower(F.trim(n))))


def tidy_title(title: Column, shops: Column) -> Column:
    """A title without segments at its ends that name the shop or sell."""
    def kept(segments: Column) -> Column:
        """Segments from the first that is neither, by dropping while they are."""
        noise = lambda s: s.rlike(BOILERPLATE) | F.array_contains(shops, F.lower(s))
        start = F.array().cast("array<string>")
        return F.aggregate(segments, start, lambda a, s: F.when((F.size(a) == 0) & noise(s), a).otherwise(F.array_append(a, s)))

    parts = F.filter(F.split(F.trim(F.coalesce(title, F.lit(""))), SEPARATORS), lambda s: F.trim(s) != "")
    inner = let(kept(parts), lambda p: F.reverse(kept(F.reverse(p))))
    return F.regexp_replace(F.array_join(inner, " - "), r"[\s|—–·•-]+$", "")


def _unescaped(value: pd.Series) -> pd.Series:
    return value.map(_html.unescape, na_action="ignore")


def decode_all_entities(value: Column) -> Column:
    """Entities of all kinds, numeric ones too."""
    return F.pandas_udf(_unescaped, T.StringType())(value)


def _searched(html: pd.Series, rule: pd.Series) -> pd.Series:
    def one(page: str, pattern: str) -> str | None:
        if page is None or not pattern:
            return None
        try:
            m = re.search(pattern, page, re.IGNORECASE)
        except re.error:
            return None
        return (m[1] if m.re.groups else m[0]) if m else None

    return pd.Series([one(h, r) for h, r in zip(html, rule, strict=True)])


def apply_rule(html: Column, rule: Column) -> Column:
    """What a site's own expression finds: its first group, or the whole; null
    if the expression is invalid or finds nothing."""
    return F.pandas_udf(_searched, T.StringType())(html, rule)


def repaired_retailers(retailers: Column, brand: Column) -> Column:
    """Retailers named like the brand, though not its own site, get the name
    that their address gives."""
    return F.transform(retailers, lambda r: F.when((F.lower(r["name"]) == F.lower(brand)) & ~urls.official_store(r["url"], brand), r.withField("name", urls.store_name(r["url"]))).otherwise(r))


def shuffled_order(key: Column, seed: int = 42) -> Column:
    """A fixed order that looks shuffled: sort by this, then by the key."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string")))


# Fixed value: where the generator of the fixed shuffle starts.
SHUFFLE_SEED = 0x4A3F2E1D


def shuffled(values: Column, seed: int = SHUFFLE_SEED) -> Column:
    """An array in a fixed shuffle: swaps from the last place down, each with a
    place drawn by a 32-bit xorshift generator, so that arrays of one length are
    always shuffled alike. The generator is folded over the places first, then
    the swaps over the array, whose work grows with the square of its length."""
    int32 = seed - (1 << 32) if seed >= 1 << 31 else seed
    step = lambda s, by: s.bitwiseXOR(F.shiftleft(s, by) if by > 0 else F.shiftright(s, -by))

    def draw(state: Column, i: Column) -> Column:
        def drawn(s: Column) -> Column:
            unsigned = s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
            other = F.shiftright(unsigned * (i + 1).cast("long"), 32).cast("int")
            return F.struct(s.alias("s"), F.array_append(state["swaps"], F.struct(i.alias("i"), other.alias("j"))).alias("swaps"))

        return let(step(step(step(state["s"], 13), -17), 5), drawn)

    places = F.when(F.size(values) > 1, F.sequence(F.size(values) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(int32).cast("int").alias("s"), F.array().cast("array<struct<i:int,j:int>>").alias("swaps"))
    swap = lambda a, d: F.transform(a, lambda x, k: F.when(k == d["i"], F.get(a, d["j"])).when(k == d["j"], F.get(a, d["i"])).otherwise(x))
    return F.aggregate(F.aggregate(places, start, draw)["swaps"], values, swap)
