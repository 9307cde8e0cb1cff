"""Product codes and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a size label.
_LETTER = "(?:xx?xs|xs|s|m|l|xl|xxl|xxxl|[2-6]xl)"
_SYSTEM = "(?:eu|uk|us|fr|it|de|jp|cn|ru|ua|int)"
SIZE = "|".join(
    [
        f"{_LETTER}(?: ?[/–—-] ?{_LETTER})*",
        "[0-9]{1,2}(?:[.,]5)?",
        f"{_SYSTEM} ?[0-9]{{1,2}}(?:[.,]5)?",
        f"[0-9]{{1,2}}(?:[.,]5)? ?{_SYSTEM}",
        "[0-9]{2} ?[x×х/] ?[0-9]{2}",
        "w ?[0-9]{2} ?l ?[0-9]{2}",
        "one[ -]?size|onesize|os|free[ -]?size|taille unique|unica|единый размер|один размер|універсальний|безрозмірний",
    ]
)
GTIN_LENGTHS = [8, 12, 13, 14]


def gtin(raw: Column) -> Column:
    """The digits of a valid trade item number; "" if the check digit fails."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", "")
    body = F.split(F.reverse(F.substr(digits, F.lit(1), F.greatest(F.length(digits) - 1, F.lit(0)))), "")
    weighted = F.transform(F.filter(body, lambda d: d != ""), lambda d, i: d.cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    sound = F.length(digits).isin(GTIN_LENGTHS) & ~digits.rlike("^0+$") & ((10 - total % 10) % 10 == F.substring(digits, -1, 1).try_cast("int"))
    return F.when(sound, digits).otherwise("")


def gtin_key(raw: Column) -> Column:
    """Digits without leading zeros, if six or more are left."""
    key = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", ""), "^0+", "")
    return F.when(F.length(key) >= 6, key).otherwise("")


def gtin_spellings(raw: Column) -> Column:
    digits, key = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", ""), gtin_key(raw)
    padded = [F.when(F.length(key) <= n, F.lpad(key, n, "0")) for n in GTIN_LENGTHS]
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array_distinct(F.array(digits, key, *padded))))


def clean_code(raw: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?iu)^(?:ref\.?|sku|art\.?|артикул)\s*[:#]?\s*", ""), 1, most)


def code_key(raw: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def is_size(raw: Column) -> Column:
    value = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"\s+", " ")
    return (value != "") & (F.length(value) <= 20) & value.rlike(f"(?iu)^(?:{SIZE})$")


def pick_sizes(labels: Column, most: int = 40) -> Column:
    """The sizes among labels, first spelling of each, in order."""
    tidy = F.filter(F.transform(labels, lambda v: F.regexp_replace(F.trim(v), r"\s+", " ")), is_size)
    key = lambda v: F.regexp_replace(F.lower(v), r"[\s.,]", "")
    once = F.aggregate(tidy, F.array().cast("array<string>"), lambda seen, v: F.when(F.exists(seen, lambda s: key(s) == key(v)), seen).otherwise(F.array_append(seen, v)))
    return F.slice(once, 1, most)


def size_read_as_price(text: Column, sizes: Column) -> Column:
    """Whether a price text is one of the page's sizes followed by a dollar sign."""
    number = F.regexp_extract(F.trim(text), r"^([0-9]{1,3}(?:[.,]5)?)\s*\$$", 1)
    return (number != "") & F.exists(sizes, lambda s: F.trim(s) == number)
