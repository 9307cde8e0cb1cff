"""Which card of the catalogue a page of another store is a listing of."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import brand, colour, money, piece, urls
from ..functions.binding import let
from ..sources.tables import dealt_evenly, shared_folder, written

# How well colours fit, the best first.
RANK = {"same": 4, "near": 3, "partial": 2, "unknown": 1, "none": 1}
VERY_COLOUR = RANK["same"]


def _brands(a: Column, b: Column) -> list[Column]:
    return [brand.real_brand(a), brand.real_brand(b)]


def _words(name: Column, maker: Column, colours: Column) -> Column:
    """The words of a name but for garments, unless there are no others."""
    return let(piece.tokens(name, maker, colours), lambda w: F.array_distinct(F.when(F.size(piece.core(w)) > 0, piece.core(w)).otherwise(w)))


def _code_keys(codes: Column) -> Column:
    return F.transform(F.filter(codes, lambda c: (F.length(c) >= 5) & c.rlike(r"\p{L}") & c.rlike("[0-9]")), lambda c: F.concat(F.lit("code "), c))


def _at(addresses: Column) -> Column:
    return F.transform(F.filter(F.transform(addresses, urls.listing_key), lambda k: k != ""), lambda k: F.concat(F.lit("at "), k))


def _under(fronts: Column, words: Column) -> Column:
    return F.flatten(F.transform(fronts, lambda f: F.transform(words, lambda w: F.concat_ws(" ", F.lit("name"), f, w))))


def _page_keys(p: Column) -> Column:
    """What a page looks cards up by: its address, its article codes, and each
    word of its name under its maker, or under any maker if it names none."""

    def keyed(v: Column) -> Column:
        own = F.concat(brand.fronts(v["b"]), v["kin"], F.array(F.replace(brand.brand_words(v["b"]), F.lit(" "), F.lit("")), F.lit("~")))
        return F.concat(_at(F.array(p["url"])), _code_keys(p["all_codes"]), _under(F.when(v["b"] == "", F.array(F.lit("*"))).otherwise(own), v["w"]))

    return let(F.struct(brand.real_brand(p["brand"]).alias("b"), _kin(p["brand"]).alias("kin"), _words(p["name"], p["brand"], p["colours"]).alias("w")), keyed)


def _card_keys(c: Column) -> Column:
    """What a card is found by: its addresses, its codes, and the words of its
    name that can tell a model, those of four letters or with a digit. All
    words count if there are none, and for cards without a maker, whose name
    may hold the maker's."""

    def keyed(v: Column) -> Column:
        own = F.concat(brand.fronts(v["b"]), v["kin"], F.array(F.replace(brand.brand_words(v["b"]), F.lit(" "), F.lit("")), F.lit("*")))
        telling = F.filter(v["w"], lambda w: (F.length(w) >= 4) | w.rlike("[0-9]"))
        words = F.when((v["b"] == "") | (F.size(telling) == 0), v["w"]).otherwise(telling)
        return F.concat(_at(_addresses(c)), _code_keys(c["all_codes"]), _under(F.when(v["b"] == "", F.array(F.lit("~"))).otherwise(own), words))

    return let(F.struct(brand.real_brand(c["brand"]).alias("b"), _kin(c["brand"]).alias("kin"), _words(c["name"], c["brand"], c["colours"]).alias("w")), keyed)


def _kin(maker: Column) -> Column:
    return F.filter(F.array(brand.maker_key(maker)), lambda k: k.startswith("maker:"))


def _addresses(c: Column) -> Column:
    return F.array_compact(F.concat(F.array(c["url"]), F.transform(c["retailers"], lambda r: r["url"])))


def candidates(pages: DataFrame, cards: DataFrame, page: str, card: str) -> DataFrame:
    """Pairs (page, card, p, c) that can be one item. A pair that shares several
    keys comes once, at the least of them, so no second shuffle makes pairs
    distinct. A key that very many share is left to the join's own splitting."""
    none = F.array().cast("array<string>")
    given = lambda c: F.coalesce(F.col(c), none)
    facts = piece.facts(F.col("name"), F.col("brand"), given("colours")).alias("facts")
    ours = pages.select(
        F.col(page), F.struct(
            "url", "store", "brand", "name", given("colours").alias("colours"), "stated", "category", "price", "links_only",
            F.array_union(piece.article_codes(F.col("name")), F.transform(given("codes"), lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""))).alias("all_codes"),
            facts,
        ).alias("p"),
    )
    no_store = F.array().cast("array<struct<name:string,url:string>>")
    theirs = cards.select(
        F.col(card), F.struct(
            "pos", "url", F.coalesce("retailers", no_store).alias("retailers"), "brand", "name", given("colours").alias("colours"), "category", "price",
            piece.item_codes(F.col("name"), F.col("part_number")).alias("all_codes"), facts,
        ).alias("c"),
    )
    # Worked out once, read by both the keys and the pairs.
    folder = f"{shared_folder(pages.sparkSession)}/items-{uuid.uuid4().hex}"
    asked = written(ours.withColumn("page_keys", F.array_distinct(_page_keys(F.col("p")))), f"{folder}/pages").withColumn("k", F.explode("page_keys"))
    held = written(theirs.withColumn("card_keys", F.array_distinct(_card_keys(F.col("c")))), f"{folder}/cards").withColumn("k", F.explode("card_keys"))
    return asked.join(held, "k").filter(F.array_min(F.array_intersect("page_keys", "card_keys")) == F.col("k")).select(page, card, "p", "c")


def judged(pairs: DataFrame) -> DataFrame:
    """What speaks for and against each pair, one column each."""
    p, c = F.col("p"), F.col("c")
    host, store = urls.store_host(p["url"]), F.lower(F.trim(F.coalesce(p["store"], F.lit(""))))
    hosts = F.transform(_addresses(c), urls.store_host)
    named = F.exists(c["retailers"], lambda r: F.coalesce(F.lower(F.trim(r["name"])) == store, F.lit(False)))
    bare = lambda r: brand.real_brand(r["brand"]) == ""
    joined = lambda v: F.array_join(v, " / ")
    text_words = lambda v: F.array_distinct(F.filter(F.split(F.lower(F.array_join(v, " ")), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    told = pairs.select(
        "*",
        urls.same_listing(c["url"], p["url"]).alias("own_page"),
        F.exists(c["retailers"], lambda r: urls.same_listing(r["url"], p["url"])).alias("linked"),
        piece.variants_differ(p["name"], c["name"]).alias("other_variant"),
        brand.fits(c["brand"], c["name"], p["brand"], p["name"]).alias("fit"),
        (bare(p) != bare(c)).alias("one_bare"),
        F.when(store != "", named).otherwise(F.array_contains(hosts, host)).alias("own_store"),
        F.when(by_field(p), p["colours"]).otherwise(F.array(piece.variant_in(p["name"]))).alias("shades"),
    ).withColumn("by_code", F.col("fit") & piece.share_code(p["all_codes"], c["all_codes"]))
    makers = _brands(p["brand"], c["brand"])
    told = told.withColumn("sides", piece.in_company(p["name"], p["facts"], c["name"], c["facts"], makers, F.array_union(p["colours"], c["colours"])))
    x, y = F.col("sides")[0], F.col("sides")[1]
    named = F.size(F.array_union(p["facts"]["spellings"], c["facts"]["spellings"])) > 0
    same = named & piece.same_by_facts(x, y, p["category"], c["category"], ~F.col("fit"))
    told = told.withColumn("is_piece", (F.col("fit") | F.col("one_bare")) & (F.col("by_code") | same))
    near = money.prices_agree(F.coalesce(p["price"], F.lit(0.0)), F.coalesce(c["price"], F.lit(0.0)))
    told = told.withColumn("priced", F.col("is_piece") & (F.col("fit") | near | F.col("by_code") | (named & (x["bare"] == y["bare"]) & piece.is_model(x["bare"]))))
    related = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return told.select(
        "*",
        (F.col("priced") & ~F.col("other_variant")).alias("open"),
        (F.array_join(x["bare"], " ") == F.array_join(y["bare"], " ")).alias("same_name"),
        F.coalesce(F.try_element_at(related, colour.relation(joined(F.col("shades")), joined(c["colours"]))), F.lit(0)).alias("rank"),
        F.size(F.array_intersect(text_words(F.col("shades")), text_words(c["colours"]))).alias("shared"),
    )


def by_field(p: Column) -> Column:
    return F.coalesce(p["stated"], F.lit(True)) & (F.size(p["colours"]) > 0)


def stated(p: Column) -> Column:
    """Whether a page states a colour, in its field or as its name's variant."""
    return by_field(p) | (F.size(colour.colour_words(piece.variant_in(p["name"]))) > 0)


def same_items(pages: DataFrame, cards: DataFrame, page: str, card: str) -> DataFrame:
    """(page, card, how, stale): the card that each page is another store's
    listing of, or null, and how it was found or why not.

    pages: page, url, store, brand, name, colours (array), stated (false: the
    colours are read off a photo), category, price in dollars, codes (array),
    links_only. cards: card, pos (their order), url, retailers
    (array<struct<name, url>>), brand, name, colours, category, price,
    part_number. Any but the keys may be null; a page's key comes once.

    A card that holds this very page is its card, unless both names state
    variants that differ: such links are counted as stale. Else it is a piece
    of one maker by code or name, at any price; where one side names no maker,
    its name must be a model's own and the price near. Among those the name's
    variant decides, then the colour; a store's own card only in its very
    colour, as any other is its other listing.

    how: page, variant, model (the page states no colour), colour, link; or no
    address, no brand, no card, price, other variant, own store, other colour.

    One join on the keys that pages and cards share and one aggregation by page.
    """
    # Pairs are few bytes and much work each: judged in even shares.
    j = judged(dealt_evenly(candidates(pages, cards, page, card)))
    pos = F.struct(F.col("c.pos"), F.col(card))
    first = lambda keep: F.min(F.when(keep, pos))
    direct = F.col("own_page") | (F.col("linked") & ~F.col("other_variant"))
    named = F.col("open") & F.col("same_name")
    closest = F.struct(F.col("rank"), F.col("shared"), (~F.col("own_store")).alias("elsewhere"), (-F.col("c.pos")).alias("back"), F.col(card))
    fits = (F.col("rank") > 0) & (~F.col("own_store") | (F.col("rank") == VERY_COLOUR))
    found = j.groupBy(page).agg(
        first(direct).alias("direct"),
        F.count_if(F.col("linked") & F.col("other_variant") & ~F.col("own_page")).alias("stale"),
        F.count_if("is_piece").alias("pieces"), F.count_if("priced").alias("priced"), F.count_if("open").alias("open"), F.count_if(named).alias("named"),
        first(named).alias("namesake"), first(named & ~F.col("own_store")).alias("namesake_elsewhere"), first(F.col("open") & ~F.col("own_store")).alias("open_elsewhere"),
        F.max(F.when(named & fits, closest)).alias("best_namesake"), F.max(F.when(F.col("open") & fits, closest)).alias("best_open"),
    )
    own = pages.select(
        F.col(page), urls.store_host("url").alias("host"), brand.real_brand(F.col("brand")).alias("maker"), piece.variant_in(F.col("name")).alias("variant"),
        F.coalesce("links_only", F.lit(False)).alias("links_only"), stated(F.struct("name", "stated", F.coalesce("colours", F.array().cast("array<string>")).alias("colours"))).alias("told"),
    )
    r = own.join(found, page, "left")
    several = F.col("named") > 0
    elsewhere = F.when(several, F.col("namesake_elsewhere")).otherwise(F.col("open_elsewhere"))
    best = F.when(several, F.col("best_namesake")[card]).otherwise(F.col("best_open")[card])
    nothing = F.lit(None)
    answer = lambda found_, how: F.struct(found_.alias("card"), F.lit(how).alias("how"))
    key = F.col("direct")[card]
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    picked = (
        F.when(F.col("host") == "", answer(nothing, "no address"))
        .when(F.col("direct").isNotNull(), answer(key, "page"))
        .when(count("pieces") == 0, F.struct(nothing.alias("card"), F.when(F.col("maker") == "", "no brand").otherwise("no card").alias("how")))
        .when(count("priced") == 0, answer(nothing, "price"))
        .when(count("open") == 0, answer(nothing, "other variant"))
        .when((F.col("named") == 1) & (F.col("variant") != ""), answer(F.col("namesake")[card], "variant"))
        .when(~F.col("told") & elsewhere.isNotNull(), answer(elsewhere[card], "model"))
        .when(F.col("told") & best.isNotNull(), answer(best, "colour"))
        .when(F.col("told") & F.col("links_only") & (F.col("named") == 1) & F.col("namesake_elsewhere").isNotNull(), answer(F.col("namesake")[card], "link"))
        .when(elsewhere.isNull(), answer(nothing, "own store"))
        .otherwise(answer(nothing, "other colour"))
    )
    stale = F.when(F.col("direct").isNull() & (F.col("host") != ""), count("stale")).otherwise(0)
    return r.select(page, picked.alias("a"), stale.alias("stale")).select(page, F.col("a.card").alias(card), F.col("a.how").alias("how"), "stale")
