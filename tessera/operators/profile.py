"""What a labelled catalogue says of new pieces: its habits by brand and store.

Tallies of values come from one pass with grouping sets, for each brand, each
store and the catalogue as a whole; a piece takes those of its brand, and falls
back to its store's, then to that of the store's parent domain, where the brand
has too few pieces. How often the words of pages agree with the labels is counted
for each style, and words speak only for styles where they mostly do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour, kinds, styles, urls
from ..functions.binding import let
from ..sources.tables import sent_if_small, shared_folder, written

# How much a habit takes to count.
BRAND_MIN_PIECES, STORE_STYLE_MIN, BRAND_STYLE_SHARE = 3, 5, 0.6
SIGNAL_MIN_PRECISION, SIGNAL_MIN_TAGS, CALIBRATION_MIN_PRODUCTS = 0.7, 5, 50
DARK_BRAND_SHARE, GENDER_SHARE, BRAND_GENDER_MIN, STORE_GENDER_MIN, MAX_STYLES = 0.2, 0.8, 3, 5, 3


def brand_key(brand: Column) -> Column:
    """A brand by its letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(brand, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def parent_domain(store: Column) -> Column:
    """The domain above a store's, "" where that is a registry's."""
    above = F.regexp_replace(store, r"^[^.]*\.", "")
    return F.when(above.contains("."), above).otherwise("")


def tallies(rows: DataFrame, values: str, by: list[str]) -> DataFrame:
    """(level, key, n, counts): for each column of `by` as a level, and for
    all rows as level "all", how many rows each key has and how many of them
    each value (of the array column `values`), in one pass. Empty keys have
    none. Values are few: counts are one map."""
    # Each row also counts once under no value, which gives n.
    marked = rows.select(*by, F.explode(F.array_append(F.array_distinct(values), F.lit(None).cast("string"))).alias("value"))
    sets = [[c, "value"] for c in by] + [["value"]]
    level = F.lit("all")
    for c in by:
        level = F.when(F.grouping(c) == 0, c).otherwise(level)
    key = F.coalesce(*(F.when(F.grouping(c) == 0, F.col(c)) for c in by), F.lit("*"))
    counted = marked.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by], F.col("value")).agg(level.alias("level"), key.alias("key"), F.count(F.lit(1)).alias("c"))
    told = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "c")))
    found = counted.filter("key <> ''").groupBy("level", "key").agg(F.max(F.when(F.col("value").isNull(), F.col("c"))).alias("n"), F.map_from_entries(F.sort_array(told)).alias("counts"))
    return found


@dataclass
class Profile:
    """styles, genders: tallies by level and key. agreement (style, tagged,
    right): how often a page's words gave a style and the editor, too. dark:
    the same for dark-toned pieces being filed dark, over all and within brands
    that use dark. styled: pieces with a style."""

    styles: DataFrame
    genders: DataFrame
    agreement: dict[str, tuple[int, int]]
    dark: tuple[int, int]
    dark_in_brands: tuple[int, int]
    styled: int


def built(labelled: DataFrame, dictionary: styles.Dictionary = styles.STYLE_TERMS) -> Profile:
    """The profile of labelled pieces (brand, name, description, url, styles,
    gender, colours, groups). Only sums for each style reach the driver.

    What is read off a piece, and the tallies, are written to the session's
    checkpoint folder: several passes need them, and reading is most of the work.
    """
    folder = f"{shared_folder(labelled.sparkSession)}/profile-{uuid.uuid4().hex}"
    read = labelled.select(
        brand_key(F.col("brand")).alias("brand"),
        urls.store_host(F.coalesce("url", F.lit(""))).alias("store"),
        kinds.normal_styles(F.coalesce("styles", F.array().cast("array<string>"))).alias("styles"),
        F.when(kinds.gender_from_page(F.col("name"), F.col("url"), F.lit(None).cast("string"), F.col("description")).isNull(), F.col("gender")).alias("gender"),
        styles.inferred_styles(F.concat_ws(" ", "name", "description"), len(kinds.STYLES), dictionary).alias("words"),
        colour.is_dark(F.coalesce("colours", F.array().cast("array<string>")), F.coalesce("groups", F.array().cast("array<string>"))).alias("dark"),
    )
    rows = written(read, f"{folder}/pieces")
    styled = rows.filter(F.size("styles") > 0)
    by_style = written(tallies(styled, "styles", ["brand", "store"]), f"{folder}/styles")
    by_gender = written(tallies(rows.filter("gender is not null").withColumn("gender", F.array("gender")), "gender", ["brand", "store"]), f"{folder}/genders")

    signals = styled.select("brand", "styles", F.explode(F.concat(F.transform("words", lambda s: F.concat(F.lit("words:"), s)), F.when(F.col("dark"), F.array(F.lit("dark"))).otherwise(F.array().cast("array<string>")))).alias("signal"))
    of = F.regexp_replace("signal", "^words:", "")
    counted = signals.groupBy("signal", F.when(F.col("signal") == "dark", F.col("brand")).alias("brand")).agg(F.count(F.lit(1)).alias("tagged"), F.count_if(F.array_contains("styles", of)).alias("right"))
    uses_dark = by_style.filter("level = 'brand'").filter(F.coalesce(F.try_element_at("counts", F.lit("dark")), F.lit(0)) >= DARK_BRAND_SHARE * F.col("n"))
    marked = counted.join(sent_if_small(uses_dark.select(F.col("key").alias("brand"), F.lit(True).alias("uses"))), "brand", "left")
    sums = marked.groupBy("signal").agg(F.sum("tagged").alias("tagged"), F.sum("right").alias("right"), F.sum(F.when(F.col("uses"), F.col("tagged"))).alias("t"), F.sum(F.when(F.col("uses"), F.col("right"))).alias("r")).collect()
    told = {r.signal: r for r in sums}
    dark = told.get("dark")
    return Profile(
        by_style,
        by_gender,
        {s.removeprefix("words:"): (r.tagged, r.right) for s, r in told.items() if s != "dark"},
        (dark.tagged, dark.right) if dark else (0, 0),
        (dark.t or 0, dark.r or 0) if dark else (0, 0),
        styled.count(),
    )


def _precise(signal: tuple[int, int]) -> float | None:
    """The share that was right, if it is trusted."""
    tagged, right = signal
    return right / tagged if tagged >= SIGNAL_MIN_TAGS and right >= SIGNAL_MIN_PRECISION * tagged else None


def _with_tallies(pieces: DataFrame, table: DataFrame) -> DataFrame:
    """`pieces` (brand_key, store) with the tallies of their brand, and of their
    store or else its parent domain, as structs by_brand and by_store."""
    of = lambda level, on, name: sent_if_small(table.filter(F.col("level") == level).select(F.col("key").alias(on), F.struct("n", "counts").alias(name)))
    joined = pieces.join(of("brand", "brand_key", "by_brand"), "brand_key", "left").join(of("store", "store", "by_own_store"), "store", "left")
    joined = joined.withColumn("parent", parent_domain(F.col("store"))).join(of("store", "parent", "by_parent"), "parent", "left")
    return joined.withColumn("by_store", F.coalesce("by_own_store", "by_parent")).drop("by_own_store", "by_parent", "parent")


def _offers(tally: Column, least: float, vocabulary: list[str], enough: Column) -> Column:
    """array<struct<value, share>> of values that hold at least `least`."""
    known = F.array(*map(F.lit, vocabulary))
    shares = F.transform(known, lambda s: F.struct(s.alias("value"), (F.coalesce(F.try_element_at(tally["counts"], s), F.lit(0)) / tally["n"]).alias("share")))
    return F.when(enough, F.filter(shares, lambda x: x["share"] >= least)).otherwise(F.array().cast("array<struct<value:string,share:double>>"))


def proposed_styles(pieces: DataFrame, profile: Profile, key: str) -> DataFrame:
    """(key, styles, confidences) of pieces (key, brand, url, words, colours,
    groups), where `words` are the styles that the page's words give: at most
    three styles, the surest, in the vocabulary's order."""
    keyed = pieces.select("*", brand_key(F.col("brand")).alias("brand_key"), urls.store_host(F.coalesce("url", F.lit(""))).alias("store"))
    told = _with_tallies(keyed, profile.styles)
    known = F.coalesce(F.col("by_brand")["n"] >= BRAND_MIN_PIECES, F.lit(False))
    habits = F.when(known, _offers(F.col("by_brand"), BRAND_STYLE_SHARE, kinds.STYLES, known)).otherwise(
        _offers(F.col("by_store"), BRAND_STYLE_SHARE, kinds.STYLES, F.coalesce(F.col("by_store")["n"] >= STORE_STYLE_MIN, F.lit(False)))
    )
    trusted = {s: _precise(profile.agreement.get(s, (0, 0))) if profile.styled >= CALIBRATION_MIN_PRODUCTS else 0.5 for s in kinds.STYLES}
    shares = F.create_map(*[F.lit(x) for s, p in trusted.items() if p is not None for x in (s, p)]) if any(trusted.values()) else F.create_map().cast("map<string,double>")
    said = F.filter(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda s: F.struct(s.alias("value"), F.try_element_at(shares, s).alias("share"))), lambda x: x["share"].isNotNull())
    everywhere, in_brands = _precise(profile.dark), _precise(profile.dark_in_brands)
    uses_dark = F.coalesce(F.try_element_at(F.col("by_brand")["counts"], F.lit("dark")) >= DARK_BRAND_SHARE * F.col("by_brand")["n"], F.lit(False))
    share = F.lit(everywhere) if everywhere is not None else F.when(uses_dark, F.lit(in_brands))
    toned = F.coalesce(colour.is_dark(F.col("colours"), F.col("groups")), F.lit(False)) & share.isNotNull()
    dark = F.when(toned, F.array(F.struct(F.lit("dark").alias("value"), share.cast("double").alias("share")))).otherwise(F.array().cast("array<struct<value:string,share:double>>"))

    def chosen(offers: Column) -> Column:
        best = F.transform(F.array(*map(F.lit, kinds.STYLES)), lambda s, n: F.struct((-F.array_max(F.transform(F.filter(offers, lambda o: o["value"] == s), lambda o: o["share"]))).alias("share"), n.alias("n"), s.alias("style")))
        surest = F.slice(F.array_sort(F.filter(best, lambda b: b["share"].isNotNull())), 1, MAX_STYLES)
        return F.array_sort(F.transform(surest, lambda b: F.struct(b["n"], b["style"], (-b["share"]).alias("share"))))

    found = told.select(key, let(F.concat(habits, said, dark), chosen).alias("c"))
    return found.select(key, F.transform("c", lambda b: b["style"]).alias("styles"), F.transform("c", lambda b: b["share"]).alias("confidences"))


def proposed_genders(pieces: DataFrame, profile: Profile, key: str) -> DataFrame:
    """(key, gender, source) of pieces (key, brand, url, setting) whose page is
    silent: the store's setting, else the brand's habit, else the store's."""
    keyed = pieces.select("*", brand_key(F.col("brand")).alias("brand_key"), urls.store_host(F.coalesce("url", F.lit(""))).alias("store"))
    told = _with_tallies(keyed, profile.genders)

    def habit(tally: Column, least: int) -> Column:
        offers = _offers(tally, GENDER_SHARE, ["women", "men", "unisex"], F.coalesce(tally["n"] >= least, F.lit(False)))
        return F.array_max(F.transform(offers, lambda o: F.struct(o["share"], o["value"])))["value"]

    brand, store = habit(F.col("by_brand"), BRAND_GENDER_MIN), habit(F.col("by_store"), STORE_GENDER_MIN)
    gender = F.coalesce("setting", brand, store)
    source = F.when(F.col("setting").isNotNull(), "store-setting").when(brand.isNotNull(), "brand").when(store.isNotNull(), "store")
    return told.select(key, gender.alias("gender"), source.alias("source"))
