"""Brand names: folding, agreement and what isn't a brand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Latin letters with marks and what they fold to.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőřśšťūůűźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorsstuuuzzz"
# Makers with several names, badges and words that aren't brands.
MAKERS = [
    ["nike", "jordan", "air jordan", "nike jordan"], ["fear of god", "essentials", "fear of god essentials"],
    ["saint laurent", "yves saint laurent", "ysl"], ["ralph lauren", "polo ralph lauren"], ["north face", "tnf"],
    ["a bathing ape", "bape"], ["comme des garcons", "cdg"], ["dr martens", "doc martens"],
]
NOT_A_BRAND = ["", "unknown", "brand", "other", "others", "none", "n/a", "na", "no brand", "nobrand", "generic", "unbranded", "default"]
BADGES = ["new", "new in", "new arrival", "new arrivals", "sale", "on sale", "sold out", "best seller", "limited edition", "online only", "exclusive", "coming soon", "pre order", "back in stock", "low stock", "last chance", "just in", "trending"]
SALES_WORDS = ["available", "unavailable", "discount", "discounts", "promotion", "promo", "offer", "offers", "coupon", "shipping", "delivery", "returns", "cart", "checkout", "clearance", "markdown", "bestseller", "preorder", "restocked", "sizes", "sizing"]


def fold(value: Column) -> Column:
    """Lower case, no marks or trademark signs, single spaces."""
    low = F.translate(F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), "[®™©℠]", " ")), _MARKED, _PLAIN)
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def brand_words(value: Column) -> Column:
    spelled = F.regexp_replace(F.regexp_replace(fold(value), "&", " and "), "['’`´]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, r"[\s,.\-‐–/#]+", " "), "^the ", ""))


def family(words: Column) -> Column:
    """The number of the family of names that brand words belong to, or null."""
    out = F
    for n, names in enumerate(MAKERS):
        hit = F.lit(False)
        for name in names:
            hit = hit | (words == name) | words.startswith(f"{name} ")
        out = out.when(hit, n)
    return out.otherwise(F.lit(None).cast("int"))


def maker(value: Column) -> Column:
    return let(brand_words(value), family)


def maker_names(value: Column) -> Column:
    """The brand, and all names of its family if it has one."""
    known = F.array(*(F.array(*map(F.lit, names)) for names in MAKERS))
    return F.concat(F.array(value), F.coalesce(F.try_element_at(known, maker(value) + 1), F.array().cast("array<string>")))


def fits(brand_a: Column, name_a: Column, brand_b: Column, name_b: Column) -> Column:
    """Whether one piece's brand holds for another: one maker; or, where only
    one has a brand, the other's name spells it."""
    facts = F.struct(real_brand(brand_a).alias("a"), real_brand(brand_b).alias("b"))

    def judged(f: Column) -> Column:
        a, b = f["a"] != "", f["b"] != ""
        return F.when(a & b, agree(f["a"], f["b"])).when(a, position_in(name_b, f["a"]) >= 0).when(b, position_in(name_a, f["b"]) >= 0).otherwise(False)

    return let(facts, judged)


def search_word(value: Column) -> Column:
    """The word to look a brand up by: its first of three letters or more."""
    words_ = F.filter(F.split(F.regexp_replace(fold(value), r"^the\s+", ""), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(F.filter(words_, lambda w: F.length(w) >= 3), F.lit(1)), F.try_element_at(words_, F.lit(1)), F.lit(""))


def maker_key(value: Column) -> Column:
    """A blocking key: the family, or the word to look the brand up by."""
    return F.coalesce(F.concat(F.lit("maker:"), maker(value).cast("string")), search_word(value))


def fronts(value: Column) -> Column:
    """The brand's words up to each of them: a brand with a line after its name
    agrees with each."""
    words_ = F.split(brand_words(value), " ")
    return F.transform(F.sequence(F.lit(1), F.size(words_)), lambda n: F.array_join(F.slice(words_, F.lit(1), n), " "))


def agree(a: Column, b: Column) -> Column:
    """One maker: equal words, with or without spaces, one family, or one
    brand the front of the other."""

    def compared(v: Column) -> Column:
        x, y = v["x"], v["y"]
        short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
        same = (x == y) | (F.replace(x, F.lit(" "), F.lit("")) == F.replace(y, F.lit(" "), F.lit(""))) | F.coalesce(family(x) == family(y), F.lit(False))
        return (x != "") & (y != "") & (same | ((F.length(short) >= 3) & F.startswith(long, F.concat(short, F.lit(" ")))))

    return let(F.struct(brand_words(a).alias("x"), brand_words(b).alias("y")), compared)


def is_sales_copy(value: Column) -> Column:

    def judged(text: Column) -> Column:
        words_ = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return (text != "") & (text.rlike("[%!?$€£¥₴₽]") | (F.size(words_) > 5) | (F.length(text) > 60) | F.array_join(words_, " ").isin(BADGES) | F.exists(words_, lambda w: w.isin(SALES_WORDS)))

    return let(fold(value), judged)


def is_not_a_brand(value: Column) -> Column:
    return fold(value).isin(NOT_A_BRAND) | is_sales_copy(value)


def real_brand(value: Column) -> Column:
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[®™©℠]", " "), r"\s+", " "))
    return F.when(is_not_a_brand(tidy), "").otherwise(tidy)


def position_in(text: Column, brand: Column) -> Column:
    """Where a brand stands in a folded text as words of its own, not as half
    of a hyphenated one; -1 if it doesn't."""

    def found(v: Column) -> Column:
        spelled = F.regexp_replace(F.regexp_replace(v["brand"], r"([.*+?^${}()|\[\]\\])", r"\\$1"), " ", r"\\s+")
        alone = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?<![\p{L}\p{N}][-‐–])"), spelled, F.lit(r"(?![\p{L}\p{N}])(?![-‐–][\p{L}\p{N}])"))
        there = (v["brand"] != "") & F.contains(v["text"], F.substring_index(v["brand"], " ", 1))
        return F.when(there, F.regexp_instr(v["text"], alone).cast("int") - 1).otherwise(-1)

    return let(F.struct(fold(text).alias("text"), fold(brand).alias("brand")), found)


def model_word(name: Column, brand: Column) -> Column:
    """The longest word of four letters or more that isn't the brand's, the
    first in the alphabet of equal ones: a blocking key."""
    own = F.filter(F.split(fold(name), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 4) & w.rlike(r"\p{L}") & ~F.array_contains(F.split(brand_words(brand), " "), w))
    best = F.array_min(F.transform(own, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.coalesce(best["w"], F.lit(""))
