"""Prices, currencies and offers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a currency for one US dollar.
USD_RATES = {
    "EUR": 0.85, "GBP": 0.74, "UAH": 41.0, "CZK": 21.0, "JPY": 157.0, "TRY": 45.0, "PLN": 3.6, "SEK": 9.5, "NOK": 10.2, "DKK": 6.4,
    "CHF": 0.8, "CAD": 1.37, "AUD": 1.5, "NZD": 1.65, "RUB": 80.0, "INR": 88.0, "CNY": 7.1, "KRW": 1380.0, "HKD": 7.8, "SGD": 1.28,
    "AED": 3.67, "BRL": 5.4, "MXN": 18.5, "ILS": 3.3, "RON": 4.3, "HUF": 335.0, "BGN": 1.66, "ZAR": 17.5, "THB": 32.0, "TWD": 30.0,
}
# Markers that name a currency, in order of precedence. They
# stand in families, each with a test that is true where one of it is in the
# text, so a family that isn't there costs one test and not one a marker.
DOLLARS = [
    (r"(?i)(?<![A-Za-z])US\s?\$", "USD"), (r"(?i)(?<![A-Za-z])CA?\s?\$", "CAD"), (r"(?i)(?<![A-Za-z])AU?\s?\$", "AUD"),
    (r"(?i)(?<![A-Za-z])NZ\s?\$", "NZD"), (r"(?i)(?<![A-Za-z])HK\s?\$", "HKD"), (r"(?i)(?<![A-Za-z])SG?\s?\$", "SGD"),
    (r"(?<![A-Za-z])R\s?\$", "BRL"),
]
DOLLAR = r"(?<![A-Za-z])(?:(?i:US|CA?|AU?|NZ|HK|SG?)|R)\s?\$"
SIGNS = [
    ("£", "GBP"), ("€", "EUR"), ("₴", "UAH"), ("₽", "RUB"), ("₺", "TRY"), ("₹", "INR"), ("₩", "KRW"), ("₪", "ILS"),
    (r"(?i)(CN|RM)\s?¥|元", "CNY"), ("¥", "JPY"), ("zł", "PLN"), ("Kč", "CZK"),
]
SIGN = "[£€₴₽₺₹₩₪¥元]|zł|Kč"
WORDS = [("(?iu)грн", "UAH"), ("(?iu)руб", "RUB"), ("(?iu)лв", "BGN")]
WORD = "(?iu)грн|руб|лв"
ISO_CODES = [
    "USD", "EUR", "GBP", "UAH", "RUB", "PLN", "CZK", "SEK", "NOK", "DKK", "CHF", "CAD", "AUD", "NZD", "JPY", "CNY", "TRY", "INR", "KRW",
    "HKD", "SGD", "AED", "BRL", "MXN", "ILS", "RON", "HUF", "BGN", "ZAR", "THB", "TWD",
]
COUNTRY_CURRENCY = {
    "ua": "UAH", "pl": "PLN", "cz": "CZK", "uk": "GBP", "gb": "GBP", "ru": "RUB", "tr": "TRY", "se": "SEK", "no": "NOK", "dk": "DKK",
    "ch": "CHF", "hu": "HUF", "ro": "RON", "il": "ILS", "jp": "JPY", "kr": "KRW", "cn": "CNY", "hk": "HKD", "tw": "TWD", "sg": "SGD",
    "th": "THB", "in": "INR", "ae": "AED", "za": "ZAR", "br": "BRL", "mx": "MXN", "ca": "CAD", "au": "AUD", "nz": "NZD", "us": "USD",
    "de": "EUR", "fr": "EUR", "it": "EUR", "es": "EUR", "nl": "EUR", "be": "EUR", "at": "EUR", "ie": "EUR", "pt": "EUR", "fi": "EUR",
    "gr": "EUR", "sk": "EUR", "si": "EUR", "ee": "EUR", "lv": "EUR", "lt": "EUR", "lu": "EUR", "mt": "EUR", "cy": "EUR", "hr": "EUR",
    "eu": "EUR",
}
LANGUAGE_CURRENCY = {
    "uk": "UAH", "pl": "PLN", "cs": "CZK", "hu": "HUF", "sv": "SEK", "da": "DKK", "nb": "NOK", "nn": "NOK", "no": "NOK", "ja": "JPY",
    "ko": "KRW", "he": "ILS", "tr": "TRY", "th": "THB",
}
# The shape of an amount with a marker beside it.
_GAP = "[    ]"
_AMOUNT = f"[0-9]{{1,3}}(?:(?:{_GAP}|[.,'’])[0-9]{{3}})+(?:[.,][0-9]{{1,2}})?|[0-9]+(?:[.,][0-9]{{1,2}})?"
_MARKER = rf"(?:(?<![A-Za-z])(?:US|CA|C|AU|A|NZ|HK|SG|S|R){_GAP}?)?\$|[€£₴₽¥₺₹₩₪]|zł|Kč|грн|руб|CHF|\b(?:USD|EUR|GBP|UAH|RUB|PLN|CZK|SEK|NOK|DKK|CAD|AUD|JPY|CNY|TRY)\b"
PRICE_IN_TEXT = f"(?i)(?:{_MARKER}){_GAP}*(?:{_AMOUNT})|(?<![0-9.,])(?:{_AMOUNT}){_GAP}*(?:{_MARKER})(?!{_GAP}*[0-9])"
MOST_PRICE = 500_000
PRICE_RATIO = 4


def lookup(table: dict[str, object], key: Column) -> Column:
    """A value of a fixed table; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def parse_price(text: Column) -> Column:
    """An amount from a written price; 0 if there is none or it is absurd.

    A comma after the last dot is a decimal comma; one to three digits, a dot
    and exactly three more are thousands.
    """
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9.,]+", "")
    without = lambda x, c: F.replace(x, F.lit(c), F.lit(""))
    # 1.234,99: to the second comma, without dots, the comma a dot
    european = F.replace(without(F.substring_index(kept, ",", 2), "."), F.lit(","), F.lit("."))
    # 1,234.99: to the second dot, without commas; 1.267 without its dot
    plain = F.when(kept.rlike(r"^[0-9]{1,3}\.[0-9]{3}$"), without(kept, ".")).otherwise(F.substring_index(without(kept, ","), ".", 2))
    number = F.when(kept.rlike(",[0-9]*$"), european).otherwise(plain)
    value = F.coalesce(number.try_cast("double"), F.lit(0.0))
    # both sides are always worked out, so Spark works the amount out once; an endless one makes NaN
    return F.nanvl(value * (value <= MOST_PRICE).cast("double"), F.lit(0.0))


def _first_of(raw: Column, markers: list[tuple[str, str]]) -> Column:
    """The currency of the first marker that is in the text; that of the last
    is taken as given."""
    out = F
    for pattern, code in markers[:-1]:
        out = out.when(raw.contains(pattern) if re.escape(pattern) == pattern else raw.rlike(pattern), code)
    return out.otherwise(markers[-1][1])


def currency_from_text(text: Column) -> Column:
    """The currency that a price text names; "" if none."""
    raw = F.coalesce(text, F.lit(""))
    beyond_ascii = F.octet_length(raw) > F.char_length(raw)
    upper = F.upper(raw)
    code = rf"\b({'|'.join(ISO_CODES)})\b"
    near = rf"(?:[0-9].{{0,7}}{code}|{code}.{{0,7}}[0-9])"
    # three capitals in front of the amount, else behind it
    beside = F.regexp_replace(F.regexp_extract(raw, r"^[A-Z]{3}\s*[0-9.,]|[0-9.,]\s*[A-Z]{3}$", 0), "[^A-Z]", "")
    return (
        F.when(raw.contains("$") & raw.rlike(DOLLAR), _first_of(raw, DOLLARS))
        .when(beyond_ascii & raw.rlike(SIGN), _first_of(raw, SIGNS))
        .when(raw.rlike("(?i)CHF"), "CHF")
        .when(beyond_ascii & raw.rlike(WORD), _first_of(raw, WORDS))
        .when(raw.contains("kr"), "SEK")
        .when(raw.contains("$"), "USD")
        .when(upper.rlike(r"\b[A-Z]{3}\b") & upper.rlike(near), F.regexp_extract(F.regexp_extract(upper, near, 0), code, 1))
        .otherwise(beside)
    )


def price_in_text(text: Column) -> Column:
    """The first amount with a marker beside it, as written; "" if none."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), PRICE_IN_TEXT, 0))


def currency_from_locale(host: Column, language: Column) -> Column:
    """The currency of the host's country, else of the language tag's region,
    else of a language with one currency; null if nothing tells."""
    tag = F.regexp_replace(F.lower(F.trim(F.coalesce(language, F.lit("")))), "_", "-")
    parts = F.split(tag, "-")
    region = F.try_element_at(parts, F.lit(2))
    by_region = F.when((F.length(region) == 2) & (region != "eu"), lookup(COUNTRY_CURRENCY, region))
    by_language = F.when(region.isNull(), lookup(LANGUAGE_CURRENCY, F.try_element_at(parts, F.lit(1))))
    return F.coalesce(lookup(COUNTRY_CURRENCY, F.substring_index(host, ".", -1)), by_region, by_language)


def cents(amount: Column) -> Column:
    """Rounded to hundredths, halves upwards."""
    return F.floor(amount * 100 + 0.5) / 100


def to_usd(amount: Column, currency: Column) -> Column:
    """The amount in dollars; null if the currency is unknown."""
    code = F.upper(F.trim(F.coalesce(currency, F.lit(""))))
    return F.when(code == "USD", cents(amount)).otherwise(cents(amount / lookup(USD_RATES, code)))


def unrounded_usd(amount: Column, currency: Column) -> Column:
    return F.when(currency == "USD", amount).otherwise(amount / lookup(USD_RATES, currency))


def cheapest_offer(offers: Column) -> Column:
    """The least offer of array<struct<price, currency>>, compared in dollars;
    the first of equal ones. Offers without a rate or a price never win."""
    rated = F.filter(
        F.transform(offers, lambda o, i: F.struct(unrounded_usd(o["price"], F.upper(F.trim(F.coalesce(o["currency"], F.lit("USD"))))).alias("usd"), i.alias("i"), o.alias("offer"))),
        lambda x: (x["offer"]["price"] > 0) & x["usd"].isNotNull(),
    )
    return F.array_min(F.transform(rated, lambda x: F.struct(x["usd"], x["i"], x["offer"])))["offer"]


def prices_agree(a: Column, b: Column) -> Column:
    """Either is unknown, or they are within a factor of four."""
    known = (a > 0) & (b > 0)
    return F.coalesce(~known | (F.greatest(a, b) / F.least(a, b) <= PRICE_RATIO), F.lit(True))
