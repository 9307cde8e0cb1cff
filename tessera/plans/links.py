"""Queries over pieces that belong together, and over what pages state of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brand, colour, kinds, piece
from ..operators import catalogue, matching, records
from ..sources.tables import dealt, table
from .orders import RATE, _code, _sql_code
from .records import _case, _sql_case
from .registry import Registry

R = Registry()

SPELLED = "' ' || trim(regexp_replace(lower({x}), '[^a-z0-9]', ' ', 'g')) || ' '"


@R.query(
    "with p as (select p_partkey, p_brand, case when p_partkey % 3 = 0 then p_brand || ' ' || p_name else p_name end as own, case when p_partkey % 2 = 0 then p_brand when p_partkey % 7 = 0 then 'Unknown' end as said from part) "
    + "select p_partkey, case when p_partkey % 2 = 0 then true else contains(" + SPELLED.replace("{x}", "own") + ", " + SPELLED.replace("{x}", "p_brand") + ") end as fits from p"
)
def brand_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a brand holds for a listing that names it in full, or nowhere,
    or only in its name."""
    own = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.col("p_name"))
    said = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).when(F.col("p_partkey") % 7 == 0, "Unknown")
    return dealt(spark, sf_dir, "part").select("p_partkey", brand.fits(F.col("p_brand"), F.col("p_name"), said, own).alias("fits"))


ALIASES = [n for names in brand.MAKERS for n in names]
FAMILIES = ["|".join(names) for names in brand.MAKERS for _ in names]


@R.query(f"select p_partkey, case when p_size % 2 = 0 then {_sql_case('p_partkey', ALIASES)} || ' line|' || {_sql_case('p_partkey', FAMILIES)} else p_brand end as names from part")
def maker_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of a brand's maker; a brand outside the families is itself."""
    said = F.when(F.col("p_size") % 2 == 0, F.concat(_case("p_partkey", ALIASES), F.lit(" line"))).otherwise(F.col("p_brand"))
    return dealt(spark, sf_dir, "part").select("p_partkey", F.array_join(brand.maker_names(said), "|").alias("names"))


@R.query("with h as (select s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') as label from supplier) select 'www.' || label || '.com' as host, min_by(s_name, s_suppkey) as brand from h join supplier using (s_suppkey) group by label")
def own_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known brand whose own shop a host is."""
    s = table(spark, sf_dir, "supplier")
    label = F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "")
    hosts = s.select(F.concat(F.lit("www."), label, F.lit(".com")).alias("host")).union(s.select(F.concat(F.lit("shop"), F.col("s_suppkey").cast("string"), F.lit(".com"))))
    return records.own_shop_brands(hosts, s, "host", "s_name", "s_suppkey")


TOKENS = "list_filter(string_split({x}, ' '), lambda w: w not in ('red', 'blue', 'new'))"
LONGEST = "list_sort(list_transform(list_filter(string_split({x}, ' '), lambda w: length(w) >= 4), lambda w: {{'l': -length(w), 'w': w}}))[1].w"


@R.query(f"select p_partkey, 'brand' as word, coalesce({LONGEST.format(x='p_name')}, '') as model, array_to_string({TOKENS.format(x='p_name')} || [p_size::varchar], '%') as ordered from part")
def name_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a piece's cards are looked up by."""
    found = piece.lookups(F.col("p_brand"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))
    return dealt(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.word", "f.model", "f.ordered")


#: A number to every name, so that few parts share one.
NUMBER = "(p_size % 3 + 10)"


def _numbered() -> Column:
    return F.concat_ws(" ", "p_name", F.expr(NUMBER).cast("string"))


NAMED = f"with n as (select p_partkey, p_brand, p_size, p_name, {TOKENS.format(x='p_name')} as w from part), t as (select *, array_to_string(w, ' ') || ' ' || {NUMBER} as full_ from n)"


@R.query(NAMED + " select a.p_partkey as a, b.p_partkey as b, a.full_ = b.full_ and length(a.full_) >= 8 as same from t a join t b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey")
def same_model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two listings of a brand and size bear one model's name."""
    named = dealt(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", F.explode(F.array(piece.model_name(F.col("p_brand"), _numbered()))).alias("name"))
    p = named.select("p_brand", "p_size", "p_partkey", F.col("name.words").alias("words"), F.col("name.sound").alias("sound"))
    a, b = (p.select("p_brand", "p_size", F.col("p_partkey").alias(s), F.struct("words", "sound").alias(f"name_{s}")) for s in "ab")
    return a.join(b, ["p_brand", "p_size"]).filter("a < b").select("a", "b", piece.same_by_model(F.col("name_a"), F.col("name_b")).alias("same"))


@R.query(NAMED + " select p_partkey, min(p_partkey) over (partition by p_brand, full_) as component from t qualify count(*) over (partition by p_brand, full_) > 1")
def variant_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of one model as groups: by their names, and, where a name is too
    short to tell, by the page that a colour row leads to."""
    p = dealt(spark, sf_dir, "part")
    name = _numbered()
    pieces = p.select("p_partkey", "p_brand", name.alias("name"), F.array().cast("array<string>").alias("colours")).withColumn("brand", F.col("p_brand"))
    page = F.concat(F.lit("https://shop.com/products/"), F.col("p_partkey").cast("string"))
    # A page's colour row leads to the first page of the same name.
    first = pieces.groupBy("p_brand", piece.full_key(F.col("name"), F.col("p_brand")).alias("full")).agg(F.min("p_partkey").alias("first"))
    rows = pieces.withColumn("full", piece.full_key(F.col("name"), F.col("p_brand"))).join(first, ["p_brand", "full"]).filter("p_partkey <> first")
    links = rows.select("p_partkey", F.concat(F.lit("http://www.shop.com/products/"), F.col("first").cast("string"), F.lit("/?utm_source=x")).alias("url"))
    found = records.linked_variants(pieces.withColumn("url", page).drop("p_brand"), "p_partkey", links)
    return catalogue.linked_groups(found).select(F.col("node").alias("p_partkey"), "component")


COLOURS = ["Black", "Navy", "White", "Black"]


@R.query(NAMED + f", k as (select *, {_sql_case('p_partkey', COLOURS)} as c from t) select a.p_partkey as a, b.p_partkey as b from k a join k b on a.p_brand = b.p_brand and a.full_ = b.full_ and a.p_partkey < b.p_partkey where length(a.full_) >= 8 and a.c <> b.c")
def colour_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one piece in different colours."""
    p = dealt(spark, sf_dir, "part").withColumn("c", F.array(_case("p_partkey", COLOURS)))
    pieces = p.select("p_partkey", F.col("p_brand").alias("brand"), _numbered().alias("name"), F.col("c").alias("colours"))
    other = lambda x, y: piece.colour_sibling(x["brand"], x["name"], y["name"], x["colours"], y["colours"])
    return records.siblings_by_name(pieces, "p_partkey", other).filter("a < b")


USD = "floor(l_extendedprice / (" + RATE.replace("{c}", _sql_code("l_suppkey")) + ") * 100 + 0.5) / 100"


@R.query(f"""with l as (select l_orderkey, l_suppkey, {USD} as usd from lineitem), o as (select l_orderkey, min(l_suppkey) as own from l group by l_orderkey),
s as (select l_orderkey, own, min(usd) filter (where l_suppkey <> own and usd > 0) as least, max(usd) filter (where l_suppkey <> own) as most, count(*) filter (where l_suppkey <> own) as others from l join o using (l_orderkey) group by l_orderkey, own)
select l_orderkey, least(50.0, coalesce(least, 50.0))::double as least, greatest(60.0, coalesce(most, 60.0))::double as most, least(others + 1, {records.MOST_RETAILERS})::bigint as n_retailers from s""")
def kept_other_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card read again at one of its stores: the others stay, and the range of
    prices spans them all."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    entry = lambda page, price, code: F.struct(F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(page)).alias("url"), F.lit("").alias("name"), price.alias("price"), code.alias("currency"))
    line = F.struct("l_linenumber", "l_suppkey", entry(".com/x", F.col("l_extendedprice").cast("double"), _code("l_suppkey")).alias("e"))
    cards = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.min("l_suppkey").alias("l_suppkey"))
    ours = F.array(entry(".com/new", F.lit(50.0), F.lit("USD")))
    kept = records.with_other_stores(F.transform("lines", lambda x: x["e"]), ours, F.lit(50.0), F.lit(60.0))
    return cards.select("l_orderkey", kept.alias("k")).select("l_orderkey", "k.least", "k.most", F.size("k.retailers").cast("long").alias("n_retailers"))


@R.query("select p_brand, p_name, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_name) as place from part group by p_brand, p_name having count(*) > 1")
def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of duplicates, the largest first, then by name."""
    groups = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return catalogue.top_k(groups, "p_brand", [F.desc("n"), F.col("p_name")], 1 << 62)


@R.query(
    "select c_custkey, coalesce(case when c_custkey % 2 = 0 then c_mktsegment end, 'model ' || c_mktsegment) as name, coalesce(case when c_custkey % 3 <> 0 then c_name end, 'M ' || c_nationkey) as brand, "
    + "array_to_string(list_filter([case when c_custkey % 2 = 1 then 'name' end, case when c_custkey % 3 = 0 then 'brand' end, case when c_custkey % 5 = 1 then 'images' end], lambda x: x is not null), ',') as used, case c_custkey % 5 when 0 then 0 when 1 then 3 when 2 then 2 when 3 then 3 else 4 end as n_images from customer"
)
def model_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a record filled from a model's answer: what the page stated
    stays, and photos are added to a thin gallery only."""
    key = F.col("c_custkey")
    own = F.transform(F.slice(F.array(*map(F.lit, range(4))), F.lit(1), (key % 5).cast("int")), lambda n: F.concat(F.lit("a"), n.cast("string")))
    raw = F.struct(F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("name"), F.when(key % 3 != 0, F.col("c_name")).alias("brand"), own.alias("images"))
    said = F.struct(F.concat(F.lit("model "), "c_mktsegment").alias("name"), F.concat(F.lit("M "), F.col("c_nationkey").cast("string")).alias("brand"))
    filled = records.filled_by_model(raw, said, ["name", "brand"], F.array(F.lit("a0"), F.lit("b1"), F.lit("b2")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", filled.alias("f"))
    return rows.select("c_custkey", "f.name", "f.brand", F.array_join("f.used", ",").alias("used"), F.size("f.images").alias("n_images"))


SHADES = list(colour.STRONG)


@R.query(f"select p_partkey, case when p_size % 3 = 0 then {_sql_case('p_partkey', SHADES)} when p_size % 3 = 1 and split_part(p_name, ' ', 1) in ('red', 'blue') then p_name when p_size % 3 = 1 then 'noir' end as colour from part")
def markup_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour that a page's markup states, past values that are none."""
    said = F.concat(F.lit('<b data-color="#fff"></b><i data-product-colour-name="'), _case("p_partkey", SHADES), F.lit('">'))
    script = F.concat(F.lit('{"color": "theme", "color":"'), "p_name", F.lit('"} Colour: Noir<'))
    html = F.when(F.col("p_size") % 3 == 0, F.concat(script, said)).when(F.col("p_size") % 3 == 1, F.regexp_replace(script, "Noir", "noir")).otherwise("Color: as pictured")
    return dealt(spark, sf_dir, "part").select("p_partkey", colour.from_markup(html).alias("colour"))


@R.query(
    """with p as (select p_partkey, case when p_size % 4 = 0 then p_name || ' for men' else p_name end as n, case p_size % 4 when 1 then 'women' when 2 then 'man' else p_name end as a, case when p_size % 3 = 0 then 'Home > Men > Women' else 'Home' end as b, case when p_partkey % 2 = 0 then 'for women; he is a man' else 'cut for women' end as d, p_size from part)
select p_partkey, case when p_size % 4 = 0 then 'men' when p_size % 4 = 1 then 'women' when p_size % 4 = 2 then 'men' when contains(b, 'Men') then 'unisex' when not contains(d, 'man') or p_partkey % 2 = 1 then 'women' end as gender,
case when p_size % 4 = 0 then 'name' when p_size % 4 in (1, 2) or contains(b, 'Men') then 'address' when p_partkey % 2 = 1 then 'description' end as source from p"""
)
def page_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gender that a page states: name, address, breadcrumbs, description."""
    size = F.col("p_size") % 4
    name = F.when(size == 0, F.concat(F.col("p_name"), F.lit(" for men"))).otherwise(F.col("p_name"))
    place = F.when(size == 1, "women").when(size == 2, "man").otherwise(F.col("p_name"))
    crumbs = F.when(F.col("p_size") % 3 == 0, "Home > Men > Women").otherwise("Home")
    said = F.when(F.col("p_partkey") % 2 == 0, "for women; he is a man").otherwise("cut for women")
    found = kinds.gender_from_page(name, F.concat(F.lit("https://shop-men.com/"), place, F.lit("/x")), crumbs, said)
    return dealt(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.gender", "f.source")


@R.query(
    """with m as (select p_partkey as id, p_partkey // 4 as model, p_brand, p_size, p_retailprice as price, p_partkey % 3 as shop, case p_partkey % 4 when 0 then 'Black' when 1 then 'White' when 2 then 'Red' end as shade from part),
g as (select id, model, case when p_size % 5 <> 0 then p_brand end as maker, price * case when p_size % 7 = 0 then 10 else 1 end as price, p_size % 4 as shop, case p_size % 3 when 0 then 'Black' when 1 then 'Red' end as shade, p_size % 11 = 0 as moved from m),
j as (select g.id as page, m.id as card, maker is null as bare, maker is not null or greatest(g.price, m.price) <= 4 * least(g.price, m.price) as priced, m.shop = g.shop as own,
  g.shade is not null as told, case when m.shade is null then 1 when m.shade = g.shade then 4 else 0 end as fit from g join m on m.model = g.model and (maker is null or maker = m.p_brand)),
b as (select page, count(*) as n, count(*) filter (priced) as near, min(card) filter (priced and not own) as other, arg_max(card, (fit, not own, -card)) filter (priced and fit > 0 and (not own or fit = 4)) as best from j group by page)
select id as page, coalesce(case when moved then id when shade is null then other else best end, -1) as card,
  case when moved then 'page' when near = 0 then 'price' when shade is null and other is not null then 'model' when best is not null and shade is not null then 'colour' when other is null then 'own store' else 'other colour' end as how, 0 as stale from g left join b on page = id"""
)
def same_item_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card that a page of another store is a listing of, by address, maker,
    name, price and colour (-1: none), and why there is none."""
    p = dealt(spark, sf_dir, "part")
    spelled = F.translate(F.lpad(F.floor(F.col("p_partkey") / 4).cast("string"), 7, "0"), "0123456789", "abcdefghij")
    name = F.concat(F.lit("z"), spelled, F.lit(" y"), spelled, F.lit(" jacket"))
    shades = lambda c: F.when(c.isNotNull(), F.array(c))
    no_text, key = F.lit(None).cast("string"), F.col("p_partkey")
    card_url = F.concat(F.lit("https://s"), (key % 3).cast("string"), F.lit(".com/c"), key.cast("string"))
    page_url = F.concat(F.lit("https://www.s"), (F.col("p_size") % 4).cast("string"), F.lit(".com/p"), key.cast("string"))
    cards = p.select(
        key.alias("card"), key.alias("pos"), card_url.alias("url"), F.lit(None).cast("array<struct<name:string,url:string>>").alias("retailers"), F.col("p_brand").alias("brand"), name.alias("name"),
        shades(F.when(key % 4 == 0, "Black").when(key % 4 == 1, "White").when(key % 4 == 2, "Red")).alias("colours"), no_text.alias("category"), F.col("p_retailprice").alias("price"), no_text.alias("part_number"),
    )
    size = F.col("p_size")
    maker = F.when(size % 5 != 0, F.col("p_brand"))
    pages = p.select(
        key.alias("page"), F.when(size % 11 == 0, F.concat(card_url, F.lit("/?utm_source=x"))).otherwise(page_url).alias("url"), no_text.alias("store"), maker.alias("brand"),
        F.concat_ws(" ", F.when(size % 2 == 0, maker), name).alias("name"), shades(F.when(size % 3 == 0, "black").when(size % 3 == 1, "red")).alias("colours"), F.lit(True).alias("stated"),
        no_text.alias("category"), (F.col("p_retailprice") * F.when(size % 7 == 0, 10).otherwise(1)).alias("price"), F.lit(None).cast("array<string>").alias("codes"), F.lit(False).alias("links_only"),
    )
    return matching.same_items(pages, cards, "page", "card").withColumn("card", F.coalesce("card", F.lit(-1).cast("long")))
