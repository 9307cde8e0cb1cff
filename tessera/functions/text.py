"""Text of pages: tags, entities, headings, guards, names and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Named entities, size suffixes of names, bot-check titles.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "ndash": "–", "mdash": "—", "hellip": "…", "amp": "&"}
NAME_SIZE = r"(?i)\s+-\s+(?:one\s*size|one|os|xxs|xs|s|m|l|xl|xxl|2xl|3xl|4xl|[0-9]{1,3}(?:\.[0-9])?)$"
BOT_TITLE = "(?i)<title[^>]*>[^<]*(?:just a moment|attention required|access denied|are you a robot|verify you are human|captcha)"
SPEC_KEYS = {
    "material": "(?iu)^(?:material|materials|fabric|composition|made\\s*of|fabrication)(?![\\p{L}\\p{N}])",
    "colour": "(?iu)^(?:colou?r|colourway|colorway|farbe|couleur|colore|kolor|barva)(?![\\p{L}\\p{N}])",
    "brand": "(?iu)^(?:brand|designer|label|maker|manufacturer|marke|marque|marca)(?![\\p{L}\\p{N}])",
}


def decode_entities(html: Column) -> Column:
    """Named entities as characters; the ampersand comes last."""
    out = html
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return out


def strip_tags(html: Column) -> Column:
    """Tags become spaces, spaces collapse, none before punctuation."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n]+", " "), " ([,.;:!?])", "$1"))


# How many JSON-LD blocks go first and how long each may be, the
# attributes that only style or repeat, and what parts a title from the shop's name.
MOST_BLOCKS, MOST_BLOCK = 3, 4_000
LEAST_BUDGET = 1_000
NEEDLESS = r"class|style|srcset|sizes|data-(?!src(?!set)|original|image|zoom|large|hires|full)[\w-]+|aria-[\w-]+|id|role|tabindex"
SEPARATOR = r"\s+[|—–·•]\s+|\s+-\s+"
_JSON_LD = r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def without_code(html: Column) -> Column:
    """Without scripts, styles, inline images, comments, and attributes that
    only style or repeat; single spaces."""
    out = F.regexp_replace(html, _JSON_LD, " ")
    for tag in ("script", "style", "noscript", "svg"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)(?:src|href)\s*=\s*([\"'])data:[^\"']*\1", " ")
    out = F.regexp_replace(out, rf"(?is)\s(?:{NEEDLESS})\s*=\s*([\"']).*?\1", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def condensed(html: Column, most: int = 90_000) -> Column:
    """A page as a model would be shown it: the first JSON-LD blocks, then the
    text and the telling attributes, `most` characters in all."""
    blocks = F.slice(F.transform(F.regexp_extract_all(html, F.lit(_JSON_LD), 1), lambda b: F.substring(b, 1, MOST_BLOCK)), 1, MOST_BLOCKS)
    told = F.concat(F.lit("<!-- json-ld -->"), F.array_join(blocks, "\n"), F.lit("\n<!-- /json-ld -->\n"))

    def whole(head: Column) -> Column:
        return F.concat(head, F.substr(without_code(html), F.lit(1), F.greatest(F.lit(LEAST_BUDGET), most - F.length(head))))

    return let(F.when(F.size(blocks) > 0, told).otherwise(""), whole)


def title_suffix(common: Column) -> Column:
    """What of a shared ending belongs to the shop: from the first separator
    on; nothing where there is none, or nothing but separators."""
    cut = F.regexp_substr(common, F.lit(f"(?:{SEPARATOR})[\\s\\S]*$"))
    return F.when(F.length(F.regexp_replace(F.coalesce(cut, F.lit("")), r"[\s|—–·•-]", "")) > 0, cut).otherwise("")


def headings(html: Column) -> Column:
    """At most five texts of h1 elements, none empty or over 200 characters."""
    found = F.transform(F.regexp_extract_all(html, F.lit("(?is)<h1[^>]*>(.*?)</h1>"), 1), lambda h: decode_entities(strip_tags(h)))
    return F.slice(F.filter(found, lambda h: (h != "") & (F.length(h) <= 200)), 1, 5)


def title(html: Column) -> Column:
    return decode_entities(strip_tags(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def language(html: Column) -> Column:
    """html lang, else og:locale, else content-language; "" if none."""
    found = [
        F.regexp_extract(html, "(?i)<html[^>]*\\slang=[\"']([^\"']+)", 1),
        F.regexp_extract(html, "(?i)<meta[^>]*og:locale[^>]*content=[\"']([^\"']+)", 1),
        F.regexp_extract(html, "(?i)<meta[^>]*content-language[^>]*content=[\"']([^\"']+)", 1),
    ]
    return F.coalesce(*(F.when(x != "", x) for x in found), F.lit(""))


def meta(html: Column) -> Column:
    """map of property, name or itemprop to its first content."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<meta\\s[^>]*>"), 0)
    pairs = F.transform(tags, lambda t: F.struct(F.lower(F.regexp_extract(t, "(?i)(?:property|name|itemprop)=[\"']([^\"']+)", 1)).alias("k"), decode_entities(F.regexp_extract(t, "(?i)content=[\"']([^\"']*)", 1)).alias("v")))
    named = F.filter(pairs, lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(named, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(named, lambda p: p["k"] == k)[0]["v"]))


def bot_check(html: Column) -> Column:
    return F.coalesce(html.rlike(BOT_TITLE), F.lit(False))


def clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), NAME_SIZE, ""))


def base_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+-\s+[\w/]+$", ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z][a-z0-9-]{1,31}$")


def spec_value(specs: Column, kind: str) -> Column:
    """Value of the first array<struct<key, value>> row whose key means `kind`."""
    return F.try_element_at(F.filter(specs, lambda s: s["key"].rlike(SPEC_KEYS[kind])), F.lit(1))["value"]


def composition(text: Column) -> Column:
    """Percentages with fibres, in order, until they reach 100 or six parts."""
    atoms = F.regexp_extract_all(F.lower(text), F.lit("([0-9]{1,3}) ?% ?([a-z]+)"), 0)
    parts = F.filter(F.transform(atoms, lambda a: F.struct(F.regexp_extract(a, "^([0-9]+)", 1).cast("int").alias("n"), F.regexp_extract(a, "([a-z]+)$", 1).alias("fibre"))), lambda p: (p["n"] <= 100) & ~p["fibre"].isin("off", "discount", "sale", "de"))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<string>").alias("kept"))
    walked = F.aggregate(
        parts, start, lambda a, p: F.when((a["sum"] >= 100) | (F.size(a["kept"]) >= 6), a).otherwise(F.struct((a["sum"] + p["n"]).alias("sum"), F.array_append(a["kept"], F.concat(p["n"].cast("string"), F.lit("% "), p["fibre"])).alias("kept")))
    )
    return F.array_join(walked["kept"], ", ")


def longest_common_suffix(titles: Column) -> Column:
    """What all strings of an array end in, as characters from the right."""
    reversed_ = F.transform(titles, lambda t: F.reverse(t))
    first = reversed_[0]
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.length(first), F.lit(1))), lambda k: F.forall(reversed_, lambda t: F.substr(t, F.lit(1), k) == F.substr(first, F.lit(1), k)))
    return F.reverse(F.substr(first, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))))
