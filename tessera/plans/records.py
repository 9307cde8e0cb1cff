"""Queries over names, photos and records of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brand, codes, colour, money, photos, piece, text, urls
from ..operators import catalogue, records
from ..sources import documents
from ..sources.tables import dealt, table
from .registry import Registry

R = Registry()


def _case(key: str, values: list, kind: str = "string") -> Column:
    """One of the values, in turn."""
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_case(key: str, values: list) -> str:
    shown = lambda v: "null" if v is None else str(v).lower() if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"
    return f"case {key} % {len(values)} " + " ".join(f"when {k} then {shown(v)}" for k, v in enumerate(values)) + " end"


# One photo in several spellings, named after the part.
PHOTOS = [
    "https://www.cdn.shopify.com/s/files/1/{s}/products/{w}-{k}_grande.JPG?v={s}", "https://cdn.shopify.com/s/files/1/9/products/{w}-{k}.jpg", "https://x{s}.com/wp-content/uploads/{w}-{k}-300x400.png",
    "https://www.x{s}.com/i/{w}{k}@2x.jpg.webp", "https://x{s}.com/i/{w}-placeholder.png", "https://res.img.com/acc{s}/image/upload/w_{k},c_fill/v1/{w}/{k}.jpg", "https://x{s}.com/{w}/logo.svg",
]
KEYS = ["'shopify/products/' || w || '-' || k", "'shopify/products/' || w || '-' || k", "'x' || s || '.com/wp-content/uploads/' || w || '-' || k", "'x' || s || '.com/i/' || w || k || '@2x'", "'x' || s || '.com/i/' || w || '-placeholder'", "'res.img.com/acc' || s || '/' || w || '/' || k", "'x' || s || '.com/' || w || '/logo.svg'"]


@R.query(
    "with n as (select p_partkey, split_part(p_name, ' ', 2) as w, p_partkey as k, p_size as s from part) select p_partkey, case p_partkey % 7 " + " ".join(f"when {n} then {k}" for n, k in enumerate(KEYS)) + " end as image_key, p_partkey % 7 in (4) as placeholder from n"
)
def photo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What photo an address shows, and addresses that show none."""
    fill = lambda c, name, value: F.replace(c, F.lit("{" + name + "}"), value.cast("string"))
    u = fill(fill(fill(_case("p_partkey", PHOTOS), "s", F.col("p_size")), "w", F.split_part("p_name", F.lit(" "), F.lit(2))), "k", F.col("p_partkey"))
    rows = dealt(spark, sf_dir, "part").select("p_partkey", u.alias("u"))
    return rows.select("p_partkey", photos.image_key(F.col("u")).alias("image_key"), photos.is_placeholder(F.col("u")).alias("placeholder"))


UPLOADS = "'https://img.x.com/acct/image/upload/'"


@R.query(f"""select p_partkey, {UPLOADS} || case when p_size * 10 >= 200 then 'w_' || p_size * 10 || '/v1/' else 'w_200,q_80/' end || p_partkey || '.jpg,https://y.com/a' || p_size || '.jpg' as photos,
  'https://y.com/' || p_name || '.jpg?v=' || p_size as full_size, (p_size * 10)::double as rank, {UPLOADS} || case when p_size * 10 >= 200 then 'w_' || p_size * 10 else 'w_200,q_80' end || '/' || p_partkey || '.jpg' as filled from part""")
def photo_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several renditions of a photo the largest, in the order of first
    appearance; size parameters dropped; the size that an address asks for; a
    template filled in from its siblings."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    at = lambda steps, tail: F.concat(F.lit("https://img.x.com/acct/image/upload/"), steps, F.lit("/"), tail, F.lit(".jpg"))
    ten = at(F.concat(F.lit("w_"), (F.col("p_size") * 10).cast("string")), F.concat(F.lit("v1/"), key))
    other, blank = at(F.lit("w_200,q_80"), key), at(F.lit("__PARAMS__"), key)
    many = F.array(blank, ten, F.concat(F.lit("https://y.com/a"), size, F.lit("_small.jpg")), other, F.concat(F.lit("https://y.com/a"), size, F.lit(".jpg")), F.lit("https://z.com/b_{width}x.jpg"))
    sized = F.concat(F.lit("https://y.com/"), "p_name", F.lit("_200x.jpg?w=10&v="), size, F.lit("&H=3"))
    best = F.transform(photos.distinct_photos(many), lambda u: F.regexp_replace(u, "_small", ""))
    return dealt(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(best, ",").alias("photos"), photos.full_size(sized).alias("full_size"),
        photos.rendition_rank(ten).alias("rank"), photos.filled_template(blank, F.array(ten, other)).alias("filled"),
    )


@R.query("with n as (select p_partkey, lpad((p_partkey % 1000)::varchar, 3, '0') as a, lpad((p_size * 7 % 1000)::varchar, 3, '0') as b, p_size % 5 = 0 as other from part) select p_partkey, not other and (a[1] <> b[1])::int + (a[2] <> b[2])::int + (a[3] <> b[3])::int between 1 and 2 as frame from n")
def photo_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of one series, told by names that differ in one or two places."""
    a = F.concat(F.lit("lookbook_"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    b = F.concat(F.when(F.col("p_size") % 5 == 0, "longer_lookbook_").otherwise("lookbook_"), F.lpad((F.col("p_size") * 7 % 1000).cast("string"), 3, "0"))
    return dealt(spark, sf_dir, "part").select("p_partkey", photos.numbered_frame(a, b).alias("frame"))


NAMES = ["Nike Air Max 90 'Core Black' CW2288-111", "Air Max 90 - M", "Men's Detroit Jacket SS24", "Black Detroit Jacket 2024", "Samba OG", "550"]
TOKENS = ["air max 90", "air max 90", "detroit jacket ss24", "detroit jacket 2024", "samba og", "550"]


@R.query(f"select p_partkey, {_sql_case('p_partkey', TOKENS)} as tokens, {_sql_case('p_partkey', ['cw2288111', '', '', '', '', ''])} as codes, {_sql_case('p_partkey', ['Nike', 'Nike', '', '', 'adidas', ''])} as maker from part")
def piece_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a name leaves without brand, colour and codes; the codes; the
    maker of a model in it."""
    n = _case("p_partkey", NAMES)
    words = piece.tokens(n, F.lit("nike"), F.array(F.lit("Core Black")))
    return dealt(spark, sf_dir, "part").select("p_partkey", F.array_join(words, " ").alias("tokens"), F.array_join(piece.article_codes(n), " ").alias("codes"), F.coalesce(piece.brand_from_model(n), F.lit("")).alias("maker"))


PAIRS = [("Air Max 90", "Nike Air Max 90 Black"), ("Jordan 4 Retro", "Jordan 4 Retro Toro Bravo"), ("Detroit Jacket", "Detroit Jacket 2024"), ("Dunk Low DV0833-105", "Low Dunk dv0833 105"), ("Gazelle Indoor", "Gazelle Bold")]


@R.query(f"select p_partkey, {_sql_case('p_partkey', [True, False, False, True, False])} as same, {_sql_case('p_partkey', [True, True, True, True, True])} as family from part")
def same_piece_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two names are one piece, and one model line."""
    a, b, none = _case("p_partkey", [p[0] for p in PAIRS]), _case("p_partkey", [p[1] for p in PAIRS]), F.array().cast("array<string>")
    return dealt(spark, sf_dir, "part").select("p_partkey", piece.same_piece(F.lit("nike"), a, b, none, none).alias("same"), piece.same_family(F.lit("nike"), a, b).alias("family"))


@R.query("select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_type = b.p_type and a.p_partkey < b.p_partkey")
def same_code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part number under one maker: a join on the number's key, then the
    makers' agreement."""
    rows = dealt(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("mpn"))
    none = F.lit("")
    said = rows.select("p_brand", F.explode(F.array(codes.code_key(F.col("mpn")))).alias("k"), "mpn").distinct()
    a, b = (said.select("k", F.col("p_brand").alias(f"brand_{s}"), F.col("mpn").alias(f"mpn_{s}")) for s in "ab")
    # What brands and numbers say is told once of two spellings, not of two parts.
    alike = a.join(b, "k").filter(piece.same_codes(none, none, F.col("mpn_a"), F.col("mpn_b"), F.col("brand_a"), F.col("brand_b"))).drop("k")
    one, other = (rows.select(F.col("p_partkey").alias(s), F.col("p_brand").alias(f"brand_{s}"), F.col("mpn").alias(f"mpn_{s}")) for s in "ab")
    return alike.join(one, ["brand_a", "mpn_a"]).join(other, ["brand_b", "mpn_b"]).filter("a < b").select("a", "b")


KNOWN = ["Nikelane", "On", "Arket", "Studio Nord", "Ace"]
_KNOWN_SQL = "(['Nikelane', 'On', 'Arket', 'Studio Nord', 'Ace'])[1 + p_partkey % 5]"


@R.query(f"select p_partkey, {_KNOWN_SQL} as brand from part where p_size % 6 in (1, 5) or (p_size % 6 = 0 and length({_KNOWN_SQL}) > 3)")
def brands_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand that a name states first, as words of its own, not as half
    of a hyphenated one; a short brand counts only at the front, or behind whom the piece is for."""
    b, form = _case("p_partkey", KNOWN), F.col("p_size") % 6
    name = F.when(form == 0, F.concat_ws(" ", "p_name", F.upper(b))).when(form == 1, F.concat_ws(" ", F.lower(b), "p_name")).when(form == 2, F.concat(b, F.lit("-"), "p_name")).when(form == 3, F.concat(F.lit("x"), b, F.lit(" "), "p_name")).when(form == 5, F.concat_ws(" ", F.lit("Women's Kids"), b, "p_name")).otherwise(F.col("p_name"))
    names = dealt(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return records.brands_in_names(names, spark.createDataFrame([(k,) for k in KNOWN], "known string"), "p_partkey", "name", "known")


DECIDED = [("GOAT", "Nike Dunk", "goat.com"), ("Acme", "Acme Tee", "shop.com"), ("30% Off", "Samba OG", "shop.com"), ("shop", "Nike Dunk", "shop.com"), ("Unknown", "Tee", "x.com")]


@R.query(f"select p_partkey, {_sql_case('p_partkey', ['nike', 'Acme', 'adidas', 'nike', ''])} as brand, {_sql_case('p_partkey', ['name', 'page', 'model', 'name', 'page'])} as source from part")
def brand_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand by page, name, model or shop, and who said it."""
    said, name, host = (_case("p_partkey", [d[k] for d in DECIDED]) for k in range(3))
    in_name = F.when(name.startswith("Nike"), "nike")
    d = records.decided_brand(said, in_name, piece.brand_from_model(name), name, host)
    return dealt(spark, sf_dir, "part").select("p_partkey", d.alias("d")).select("p_partkey", "d.brand", "d.source")


CHOSEN = ["Navy", "Clay", None, "Black"]


@R.query(f"select p_partkey, {_sql_case('p_partkey', CHOSEN)} as colour from part")
def colour_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's colour among candidates of different origins."""
    one = lambda o, v: F.struct(F.lit(o).alias("origin"), v.alias("value"))
    first, second = _case("p_partkey", ["Sale", "XL", "Trucker Tee", "$20"]), _case("p_partkey", ["Navy", "Clay", "50%", "Black"])
    found = colour.choose(F.array(one("swatch", first), one("label", second)), F.lit("Trucker Tee"), F.lit("b"), codes.is_size, ["label"])
    return dealt(spark, sf_dir, "part").select("p_partkey", found.alias("colour"))


@R.query(f"select p_partkey, {_sql_case('p_partkey', ['Blue', 'Washed Black', 'Red', ''])} as colours, {_sql_case('p_partkey', ['', 'Washed Black', '', ''])} as from_name from part")
def colour_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour lists without labels that can't be colours."""
    name = _case("p_partkey", ["Tee", "Jeans - Washed Black", "Red Tee", "Tee - M"])
    labels = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("Blue"), F.lit("img_1.jpg"))).otherwise(F.array(F.lit("XL")))
    return dealt(spark, sf_dir, "part").select("p_partkey", F.array_join(colour.repaired(name, labels, codes.is_size), ",").alias("colours"), F.coalesce(colour.from_name(name, codes.is_size), F.lit("")).alias("from_name"))


@R.query("select page_id, 'Coat' as name, 'Acme' as brand, (page_id % 90 + 10)::double as price, 'EUR' as currency, floor((page_id % 90 + 10) / 0.85::double * 100 + 0.5) / 100 as price_usd, 'outerwear' as category, 'Blue' as color, '' as missing, true as ask_model from pages")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from pages: the richest product node with gaps filled from its
    namesakes, then meta tags, then headings; typed and checked."""
    p = table(spark, sf_dir, "pages")
    node = lambda body: F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"Coat"'), body, F.lit("}</script>"))
    html = F.concat(
        node(F.concat(F.lit(',"offers":{"price":"'), (F.col("page_id") % 90 + 10).cast("string"), F.lit('","priceCurrency":"EUR"}'))), node(F.lit(',"brand":"Acme"')),
        F.lit('<meta property="og:title" content="Meta title"><meta property="product:color" content="Blue">'), F.col("html"),
    )
    pages = p.select("page_id", "url", html.alias("html"))
    nodes = documents.product_nodes(pages, "page_id", "html").filter(~F.col("in_list"))
    own = records.richest(nodes, "page_id", ["name", "brand", "price", "currency", "gtin"])
    fields = ["name", "brand", "price", "currency", "gtin", "color"]
    none = F.lit(None).cast("string")
    m = text.meta(F.col("html"))
    by_node = F.struct(*(F.col(f).alias(f) for f in fields[:5]), none.alias("color"))
    by_meta = F.struct(m["og:title"].alias("name"), none.alias("brand"), none.alias("price"), none.alias("currency"), none.alias("gtin"), m["product:color"].alias("color"))
    by_heading = F.struct(text.headings(F.col("html"))[0].alias("name"), *(none.alias(f) for f in fields[1:]))
    raw = pages.join(own, "page_id", "left").select("page_id", "url", records.first_stated([by_node, by_meta, by_heading], fields).alias("raw"))
    r = raw.select("page_id", records.normalized(F.col("raw"), F.col("url")).alias("r"))
    return r.select("page_id", "r.name", "r.brand", "r.price", "r.currency", "r.price_usd", "r.category", "r.color", F.array_join("r.missing", ",").alias("missing"), records.needs_model(F.col("r"), F.lit(1)).alias("ask_model"))


@R.query("""with s as (select o_orderkey, o_custkey % 7 as fresh, o_custkey % 5 as a, 5 + o_orderkey % 3 as b, o_totalprice as price from orders)
select o_orderkey, case when fresh in (a, b) then 2 else 3 end as n, case when fresh = a then price else 1.0 end::double as first_price, case when fresh = a then 2.0 when fresh = b then price else 2.0 end::double as second_price from s""")
def retailer_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offer put in place of the same page's or store's, or added."""
    entry = lambda n, page, p: F.struct(F.concat(F.lit("https://s"), n.cast("string"), F.lit(page)).alias("url"), p.cast("double").alias("price"))
    held = F.array(entry(F.col("o_custkey") % 5, ".com/x", F.lit(1.0)), entry(5 + F.col("o_orderkey") % 3, ".com/y", F.lit(2.0)))
    fresh = entry(F.col("o_custkey") % 7, ".com/x/?utm_source=z", F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", records.with_retailer(held, fresh).alias("r"))
    return rows.select("o_orderkey", F.size("r").alias("n"), F.col("r")[0]["price"].alias("first_price"), F.col("r")[1]["price"].alias("second_price"))


@R.query(
    """with recursive o as (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by p_partkey) as n from part),
w as (select p_brand, n, p_partkey, p_size::bigint as s, 0 as piece from o where n = 1
  union all select o.p_brand, o.n, o.p_partkey, case when w.s > 0 and w.s + o.p_size > 100 then o.p_size else w.s + o.p_size end, w.piece + case when w.s > 0 and w.s + o.p_size > 100 then 1 else 0 end from w join o on o.p_brand = w.p_brand and o.n = w.n + 1)
select p_brand, p_partkey, piece from w"""
)
def budgeted_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows packed in order into pieces of at most a budget."""
    return records.packed(table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("p_size")), "p_brand", "p_partkey", "p_size", 100)


@R.query(
    """with c as (select a.p_partkey as incoming, b.p_partkey as card, (a.p_type = b.p_type) as fit, abs(a.p_retailprice - b.p_retailprice) as gap from part a join part b on a.p_brand = b.p_brand and a.p_name = b.p_name and a.p_partkey <> b.p_partkey),
r as (select *, row_number() over (partition by incoming order by fit desc, gap, card) as n from c) select incoming, card, fit from r where n = 1"""
)
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best card for each incoming piece: candidates by brand and name,
    ranked by fit, then price, then age."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_type", F.col("p_partkey").alias("card"), "p_retailprice")
    found = records.nearest_by(p, ["p_brand", "p_name", "p_type"], "p_retailprice", "card")
    wider = records.nearest_by(p, ["p_brand", "p_name"], "p_retailprice", "card")
    both = found.select("card", F.col("nearest").alias("same")).join(wider.select("card", F.col("nearest").alias("other")), "card")
    best = both.select(F.col("card").alias("incoming"), F.coalesce("same", "other").alias("card"), F.col("same").isNotNull().alias("fit"))
    return best.filter("card is not null")


@R.query("with g as (select p_brand, case p_partkey % 3 when 0 then 'women' when 1 then 'men' end as gender from part where p_size % 2 = 0), t as (select p_brand, gender, count(*) as c from g where gender is not null group by all), d as (select p_brand, sum(c)::bigint as n, arg_min(gender, (-c, gender)) as gender, max(c) as top from t group by p_brand) select p.p_brand, coalesce(case when d.top >= 0.6 * d.n and d.n >= 3 then d.gender end, 'unisex') as gender from (select distinct p_brand from part) p left join d using (p_brand)")
def gender_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gender that a brand's history proposes, where it is one-sided."""
    p = table(spark, sf_dir, "part")
    known = p.filter("p_size % 2 = 0").withColumn("gender", F.when(F.col("p_partkey") % 3 == 0, "women").when(F.col("p_partkey") % 3 == 1, "men")).filter("gender is not null")
    sure = catalogue.dominant(known, "p_brand", "gender", 0.6, 3)
    return p.select("p_brand").distinct().join(sure, "p_brand", "left").select("p_brand", F.coalesce("gender", F.lit("unisex")).alias("gender"))


@R.query("select c_custkey, case when c_custkey % 4 = 0 then 'https://shop.com/sale/' || c_nationkey else 'https://shop.com/' || lower(c_mktsegment) end as address, case when c_custkey % 4 = 0 then 'Sale' else c_mktsegment end as label from customer")
def category_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category links: the shop's own, without tracking, labelled."""
    link = lambda url, label: F.struct(url.alias("url"), label.alias("label"))
    segment = F.concat(F.when(F.col("c_custkey") % 4 == 0, "https://other.com/").otherwise("https://www.shop.com//"), F.lower("c_mktsegment"), F.lit("/?utm_source="), "c_name", F.lit("#top"))
    sale = F.concat(F.lit("http://shop.com/sale/"), F.col("c_nationkey").cast("string"))
    links = F.array(link(F.concat(F.lit("https://shop.com/cart/"), "c_name"), F.lit("Cart")), link(segment, F.col("c_mktsegment")), link(sale, F.lit("Sale")))
    own = F.filter(links, lambda x: urls.same_store(x["url"], F.lit("https://www.shop.com")) & ~urls.non_product_path(urls.path(x["url"])))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://"), urls.listing_key(own[0]["url"])).alias("address"), own[0]["label"].alias("label"))


@R.query("""with s as (select s_suppkey, case s_suppkey % 4 when 0 then 'GBP' when 1 then 'EUR' when 2 then 'USD' else '' end as currency, (s_suppkey % 9 + 1)::double as a, (s_nationkey + 3)::double as b from supplier)
select s_suppkey, currency, case when currency <> '' then least(a, b) end as least_price, case when currency <> '' then greatest(a, b) end as most_price from s""")
def storefront_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A storefront's JSON over what the page said: its price counts only
    where a currency is known."""
    key, amount = F.col("s_suppkey") % 4, (F.col("s_suppkey") % 9 + 1).cast("string")
    price = F.when(key == 1, F.concat(amount, F.lit(" €"))).when(key == 2, F.concat(F.lit("$"), amount)).otherwise(amount)
    said = F.struct(price.alias("price"), F.when(key == 0, "GBP").otherwise(" ").alias("currency"))
    offers = F.transform(F.array(F.concat(amount, F.lit(".00")), (F.col("s_nationkey") + 3).cast("string")), lambda p: p.cast("double"))
    currency = F.coalesce(records.stated(said["currency"]), money.currency_from_text(said["price"]))
    return table(spark, sf_dir, "supplier").select("s_suppkey", currency.alias("currency"), F.when(currency != "", F.array_min(offers)).alias("least_price"), F.when(currency != "", F.array_max(offers)).alias("most_price"))
