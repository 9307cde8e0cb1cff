"""Scalar functions and operators on small literal rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import brand, codes, colour, garments, kinds, markup, money, photos, piece, styles, text, urls
from tessera.operators import catalogue, duplicates, gallery, matching, records, sinks
from tessera.sources import documents
from tessera.streaming import seen


def values(spark, inputs, made):
    """made(column) of each input, in order."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r.out for r in rows.select("k", made(F.col("v")).alias("out")).orderBy("k").collect()]


def test_listing_keys(spark):
    given = ["https://www.Shop.com//a//b/?utm_source=x&b=2&a=1#top", "http://shop.com/a/b?a=1&b=2", "https://s.com/collections/men/products/x/", "not an address", None, ""]
    assert values(spark, given, urls.listing_key) == ["shop.com/a/b?a=1&b=2", "shop.com/a/b?a=1&b=2", "s.com/products/x", "not an address", "", ""]


@pytest.mark.parametrize("path,want", [("/products/silk-shirt", True), ("/cart/12345678", False), ("/p/ab1234", True), ("/en/EG4958.html", True), ("/shop/nebula-jacket-aurelio", True), ("/shop/new-arrivals-here", False), ("/collections/nebula-jacket-aurelio", False), ("/items.aspx", False), ("/a/x-item-123456.aspx", True), ("/", False)])
def test_product_paths(spark, path, want):
    assert values(spark, [path], urls.product_path) == [want]


def test_stores(spark):
    given = ["https://www.timberland.co.uk/x", "https://farfetch.com", "https://awin1.com/x", "x"]
    assert values(spark, given, urls.store_name) == ["Timberland", "Farfetch", "Store", "Store"]
    assert values(spark, ["timberland.co.uk", "farfetch.com"], lambda h: urls.own_shop(h, F.lit("Timberland"))) == [True, False]
    assert values(spark, ["https://a.com/collections/x/products/y"], urls.product_json_url) == ["https://a.com/products/y.json"]


def test_prices(spark):
    given = ["$49.99", "49,99 €", "1.267", "1.234,99", "4 000 ₴", "", None, "900000", "12,345.50"]
    assert values(spark, given, money.parse_price) == [49.99, 49.99, 1267.0, 1234.99, 4000.0, 0.0, 0.0, 0.0, 12345.5]
    texts = ["US$ 5", "S$5", "C$ 5", "5 zł", "Price 4 000 UAH incl. VAT", "GBP89.00", "29.99 XYZ", "SALE", None]
    assert values(spark, texts, money.currency_from_text) == ["USD", "SGD", "CAD", "PLN", "UAH", "GBP", "XYZ", "", ""]
    assert values(spark, ["18\n$215", "18 $120", "4 000 ₴ now", "none"], money.price_in_text) == ["$215", "$120", "4 000 ₴", ""]


def test_markers_go_by_precedence(spark):
    want = {
        "C$ 5 or US$ 4": "USD", "R$ 5": "BRL", "r$ 5": "USD", "BASIC$ 5": "USD", "nz $5 €": "NZD", "5 Kč, 1 €": "EUR", "RM ¥5": "CNY", "¥5": "JPY", "5 元 zł": "CNY",
        "chf 5 руб": "CHF", "CHF 5 Kč": "CZK", "5 ЛВ kr": "BGN", "5 руб 3 грн": "UAH", "$4 kr": "SEK", "é $4": "USD", "Try it 5 usd": "TRY", "Try it": "", "XYZ 5 USD": "USD", "XYZ5": "XYZ", "5 VAT": "VAT",
    }
    assert dict(zip(want, values(spark, list(want), money.currency_from_text))) == want
    shown = {money.DOLLAR: "US$ ca$ AU$ NZ$ hk$ S$ R$", money.SIGN: "£ € ₴ ₽ ₺ ₹ ₩ ₪ 元 ¥ zł Kč", money.WORD: "грн РУБ лв"}
    for (gate, texts), family in zip(shown.items(), (money.DOLLARS, money.SIGNS, money.WORDS)):
        assert values(spark, texts.split(), lambda t, g=gate: t.rlike(g)) == [True] * len(family)
        assert values(spark, texts.split(), money.currency_from_text) == [c for _, c in family]
    odd = ["1.2.3", "1,2,3", "1.234.567,8,9", ".5", "5.", ",", ".", "1.2345", "9" * 400, "500000", "500000.01", "1,234.5.6"]
    assert values(spark, odd, money.parse_price) == [1.2, 1.2, 0.0, 0.5, 5.0, 0.0, 0.0, 1.2345, 0.0, 500000.0, 0.0, 1234.5]


def test_conversion_rounds_halves_up(spark):
    got = spark.range(1).select(money.to_usd(F.lit(4000.0), F.lit("uah")), money.to_usd(F.lit(1.005), F.lit("USD")), money.to_usd(F.lit(1.0), F.lit("XXX"))).first()
    assert tuple(got) == (97.56, 1.0, None)


def test_codes(spark):
    assert values(spark, ["4006381333931", "4006381333932", "00000000", "96385074", None], codes.gtin) == ["4006381333931", "", "", "96385074", ""]
    sizes = ["XS", "M/L", "40,5", "EU 38", "38 it", "32x34", "W32 L34", "One size", "100", "Add to bag", ""]
    assert values(spark, sizes, codes.is_size) == [True] * 8 + [False] * 3
    got = spark.range(1).select(codes.pick_sizes(F.array(*map(F.lit, [" M ", "m", "Sold out", "L"])))).first()[0]
    assert got == ["M", "L"]
    assert spark.range(1).select(codes.gtin_spellings(F.lit("0096385074"))).first()[0] == ["0096385074", "96385074", "000096385074", "0000096385074", "00000096385074"]
    assert values(spark, ["18 $", "$18"], lambda v: codes.size_read_as_price(v, F.array(F.lit("18")))) == [True, False]


def test_colours(spark):
    assert values(spark, ["Black/White", "Navy", "plain", None], colour.group_names) == [["Black", "White", "Multicolor"], ["Blue"], [], []]
    assert values(spark, ["stone", "black stone"], lambda v: colour.canonical(v, True)) == ["beige", "black"]
    assert values(spark, ["Core Black", "img_1.jpg", "XL", "38x40", "Red"], lambda v: colour.is_label(v, codes.is_size(v))) == [True, False, False, False, True]


def test_kinds(spark):
    given = ["Dress Shirt", "polo neck knit", "Polo", "bootcut jeans", "boot cut jeans", "denim jacket", "shoes", "thing"]
    assert values(spark, given, kinds.category) == ["shirts", "knitwear", "tops", "jeans", "jeans", "outerwear", "footwear", None]
    assert values(spark, ["for women and men", "Women's", "menswear", ""], kinds.read_gender)[0] == "unisex"


def test_brands(spark):
    assert values(spark, ["Levi's", "The North Face®", "Stüssy", "A & B"], brand.brand_words) == ["levis", "north face", "stussy", "a and b"]
    assert values(spark, ["Jordan", "Nike Lab", "Adidas", ""], lambda v: brand.agree(v, F.lit("nike"))) == [True, True, False, False]
    assert values(spark, ["30% off", "Sold Out", "unknown", "Acne Studios"], brand.real_brand) == ["", "", "", "Acne Studios"]


def test_texts(spark):
    page = '<html lang="uk-UA"><title>A &amp; B</title><meta property="og:title" content="T"><meta property="og:title" content="U"><h1> One </h1><h1></h1>'
    got = spark.createDataFrame([(page,)], "h string").select(text.language(F.col("h")).alias("l"), text.title(F.col("h")).alias("t"), text.headings(F.col("h")).alias("h1"), text.meta(F.col("h")).alias("m")).first()
    assert (got.l, got.t, got.h1, got.m["og:title"]) == ("uk-UA", "A & B", ["One"], "T")
    assert values(spark, ["Polo Shirt - Blue - M", "Tee - One Size"], text.clean_name) == ["Polo Shirt - Blue", "Tee"]
    assert values(spark, ["<title>Just a moment...</title>", "<title>Coat</title>"], text.bot_check) == [True, False]


def test_robots(spark):
    rules = documents.robots_rules(spark.createDataFrame([("h", "User-agent: a\nUser-agent: *\nDisallow: /x # c\nAllow: /x/y\nDisallow:\nUser-agent: b\nDisallow: /\n")], "host string, robots_txt string"))
    assert sorted((r.kind, r.pattern) for r in rules.collect()) == [("allow", "/x/y"), ("disallow", "/x")]
    paths = spark.createDataFrame([("h", "/x/y/z"), ("h", "/x/q"), ("h", "/"), ("other", "/x")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in documents.allowed(paths, rules).collect()} == {("h", "/x/y/z"): True, ("h", "/x/q"): False, ("h", "/"): True, ("other", "/x"): True}


def test_product_nodes(spark):
    page = '<script type="application/ld+json">[{"@type":"ItemList","itemListElement":[{"item":{"@type":["Product"],"name":"listed"}}]},{"@type":"Product","name":"own","brand":"B","offers":[{"price":5,"priceCurrency":"EUR"}]}]</script><script type="application/ld+json">{bad</script>'
    got = documents.product_nodes(spark.createDataFrame([(1, page), (2, "<p>"), (3, None)], "id long, html string"), "id", "html").collect()
    assert [(r.id, r.name, r.brand, r.price, r.in_list) for r in got] == [(1, "own", "B", "5", False), (1, "listed", None, None, True)]


def test_linked_groups(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(50, 40), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in catalogue.linked_groups(edges).collect()} == {k: 0 for k in range(13)} | {40: 40, 50: 40}


def test_columns_that_the_target_lacks_are_dropped(spark):
    kept, dropped = catalogue.writable(spark.createDataFrame([(1, 2)], "a int, b int"), ["a"])
    assert kept.columns == ["a"] and dropped == ["b"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:20:00")], "u int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = seen.fresh_stream(stream, ["u"], "ts", "10 minutes").writeStream.format("memory").queryName("fresh").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.u for r in spark.sql("select u from fresh").collect()) == [1, 2]
    run = seen.windowed_counts(stream, "ts", "1 minute", "10 minutes", ["u"]).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.u, r.n) for r in spark.sql("select u, n from counts").collect()) == [(1, 2), (2, 1)]


def test_photos(spark):
    given = ["https://cdn.shopify.com/s/files/1/2/products/a_300x300.jpg?v=1", "https://shop.com/cdn/shop/products/A.jpg", "https://x.com/wp-content/uploads/a-300x200.jpg"]
    assert values(spark, given, photos.image_key) == ["shopify/products/a", "shopify/products/a", "x.com/wp-content/uploads/a"]
    assert values(spark, ["https://x.com/w_400,h_500/dpr_2/a.jpg", "https://x.com/a.jpg", "https://x.com/{width}/a.jpg"], photos.rendition_rank) == [0, 0, -1]
    assert values(spark, ["lookbook_01", "dsc00012", "short"], lambda v: photos.numbered_frame(v, F.lit("lookbook_02"))) == [True, False, False]


@pytest.mark.parametrize("a,b,same", [("Air Max 90", "Nike Air Max 90", True), ("Jordan 4 Retro", "Jordan 4 Retro Toro Bravo", False), ("9060", "9060", True), ("Tee", "Tee", False), ("Dunk CW2288-111", "Low cw2288 111", True)])
def test_same_piece(spark, a, b, same):
    none = F.array().cast("array<string>")
    assert spark.range(1).select(piece.same_piece(F.lit("Nike"), F.lit(a), F.lit(b), none, none)).first()[0] is same


def test_garments(spark):
    given = ["Pullover Hoodie", "Polo Shirt", "Boots with Denim Bag", "Raw Denim", "x", None]
    found = values(spark, given, lambda v: garments.garment(v)["kind"])
    assert found == ["hoodie", "polo", "boots", "denim", None, None]


def test_records(spark):
    nodes = spark.createDataFrame([(1, 0, "Coat", None, "5"), (1, 1, "Coat", "Acme", None), (1, 2, "Other", "B", None), (2, 0, None, None, None)], "id long, pos int, name string, brand string, price string")
    rows = {r.id: (r.name, r.brand, r.price) for r in records.richest(nodes, "id", ["name", "brand", "price"]).collect()}
    assert rows == {1: ("Coat", "Acme", "5"), 2: (None, None, None)}
    packed = records.packed(spark.createDataFrame([("g", k, s) for k, s in enumerate([60, 50, 50, 500, 1])], "g string, k long, s long"), "g", "k", "s", 100)
    assert {r.k: r.piece for r in packed.collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows.write.parquet(path)
    new = sinks.upserted(spark.read.parquet(path), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k").withColumn("extra", F.lit(1))
    assert sinks.replaced(spark, path, new, ["k", "v"]) == ["extra"]
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.appended(spark, f"{tmp_path}/log", rows, F.lit("now"))
    sinks.appended(spark, f"{tmp_path}/log", rows, F.lit("now"))
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    assert catalogue.insert_if_absent(rows, spark.createDataFrame([(5, "A "), (6, "z"), (7, "z")], "k int, v string"), F.lower(F.trim("v"))).count() == 3


def test_markup(spark):
    assert values(spark, ["a.jpg 1x, b,c.jpg 2x", "a.jpg", ""], markup.srcset_urls) == [["a.jpg", "b,c.jpg"], ["a.jpg"], []]
    titles = ["Shop online | Coat - Red — Acme", "Sale Rail Tote | Acme", "Acme", "", None]
    assert values(spark, titles, lambda t: markup.tidy_title(t, F.array(F.lit("acme")))) == ["Coat - Red", "Sale Rail Tote", "", "", ""]
    said = ["Tennis preppy, tennis cargos", "", "ab", "Классическая юбка", "Lace necklace"]
    assert values(spark, said, styles.inferred_styles) == [["utilitarian", "preppy", "sporty"], [], [], ["classic"], []]
    assert values(spark, ["&#x27;&eacute;", None], markup.decode_all_entities) == ["'é", None]


def test_product_variants(spark):
    group = '{"@type":"ProductGroup","name":"Tee","brand":{"name":"B"},"productGroupID":"g","hasVariant":[{"color":"Red","size":"S","url":"https://x.com/a?v=1","offers":{"price":"10","priceCurrency":"EUR","gtin13":"1"}},{"color":"Red","size":"M","url":"https://x.com/a","offers":[{"price":"12,50"}]},{"color":"Blue","size":"M","url":"https://x.com/b","offers":{"price":9}}]}'
    crumbs = '{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"Tees"},{"position":1,"item":{"name":"Men"}}]}'
    page = "".join(f'<script type="application/ld+json">{b}</script>' for b in (group, "{bad", crumbs))
    pages = spark.createDataFrame([(1, "http://www.x.com/a/", page), (2, "https://x.com/z", "<p>")], "id long, url string, html string")
    rows = documents.product_variants(pages, "id", "html")
    assert [(r.color, r.size, r.price, r.gtin) for r in rows.orderBy("pos").collect()] == [("Red", "S", "10", "1"), ("Red", "M", "12,50", None), ("Blue", "M", "9", None)]
    r = documents.shown_variants(rows, pages, "id", "url").first()
    assert (r.group_name, r.brand, r.color, r.sizes, r.least_price, r.most_price, r.other_colours) == ("Tee", "B", "Red", ["S", "M"], 10.0, 12.5, ["https://x.com/b"])
    assert [x.b for x in pages.select("id", documents.breadcrumbs(F.col("html")).alias("b")).orderBy("id").collect()] == [["Men", "Tees"], []]


def test_gallery(spark):
    trusted = F.array(F.lit("https://x.com/i/lookbook_01.jpg"))
    found = [f"https://x.com/i/{n}.jpg" for n in ("lookbook_02", "red-wool-coat", "other", "placeholder")] + ["https://y.com/i/lookbook_03.jpg", "https://x.com/i/lookbook_01_300x300.jpg"]
    got = spark.range(1).select(photos.gallery(F.array(*map(F.lit, found)), trusted, F.lit("Red Wool Coat"))).first()[0]
    assert got == [f"https://x.com/i/{n}.jpg" for n in ("lookbook_01", "lookbook_02", "red-wool-coat")]


def test_robots_patterns_stand_for_themselves(spark):
    specials = ".^$+?()[]{}|\\"
    robots = "User-agent: x\nSitemap: s\nUser-agent: *\n" + "\n".join(f"Disallow: /a{c}b" for c in specials) + "\nDisallow: /*.php$\nDisallow: /p\nAllow: /p$\n"
    rules = documents.robots_rules(spark.createDataFrame([("h", robots), ("page", "<html>User-agent: *\nDisallow: /")], "host string, robots_txt string"))
    paths = [f"/a{c}b/x" for c in specials] + ["/axb", "/ab", "/x.php", "/x.php5", "/xphp", "/p", "/p/1", "", None]
    asked = spark.createDataFrame([("h", p) for p in paths] + [("page", "/a"), ("none", "/a")], "host string, path string")
    found = {(r.host, r.path): r.allowed for r in documents.allowed(asked, rules).collect()}
    assert not any(found["h", f"/a{c}b/x"] for c in specials)
    assert {p: found["h", p] for p in paths[len(specials):]} == {"/axb": True, "/ab": True, "/x.php": False, "/x.php5": True, "/xphp": True, "/p": True, "/p/1": False, "": True, None: True}
    assert found["page", "/a"] and found["none", "/a"]


def test_chains_of_photos(spark):
    at = "https://res.x.com/acc/image/upload/"
    ranks = {f"{at}w_400,h_600/dpr_2.0,f_auto/v12/a.jpg": 1200.0, f"{at}f_auto/a.jpg": float(2**53 - 1), f"{at}__P__/a.jpg": -1.0, "https://x.com/{size}/a.jpg": -1.0, "https://x.com/a.jpg": 0.0, f"{at}w_9": float(2**53 - 1)}
    assert values(spark, list(ranks), photos.rendition_rank) == list(ranks.values())
    siblings = F.array(F.lit(f"{at}w_200/v1/b.jpg"), F.lit(f"{at}w_900/c.jpg"), F.lit("https://res.x.com/other/image/upload/w_2000/d.jpg"))
    assert values(spark, [f"{at}%7Bp%7D/v2/a.jpg", "https://x.com/a.jpg"], lambda u: photos.filled_template(u, siblings)) == [f"{at}w_900/v2/a.jpg", None]
    assert values(spark, [f"{at}__P__/v2/a.jpg"], lambda u: photos.filled_template(u, F.array().cast("array<string>"))) == [f"{at}v2/a.jpg"]


def test_names_of_makers(spark):
    rows = spark.createDataFrame([("Nike", "Air Max 90", "Jordan", "x"), ("", "Stussy Basic Logo Hoodie", "Stussy", "Hoodie"), ("Acme", "Tee", "", "Other Tee"), ("", "a", "", "a"), ("Carhartt", "x", "Carhartt WIP", "y"), (None, "x", "Off", "y")], "a string, na string, b string, nb string")
    assert [r[0] for r in rows.select(brand.fits(F.col("a"), F.col("na"), F.col("b"), F.col("nb"))).collect()] == [True, True, False, False, True, False]
    assert values(spark, ["Air Jordan 1", "Acme", None], brand.maker_names) == [["Air Jordan 1", "nike", "jordan", "air jordan", "nike jordan"], ["Acme"], [None]]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from tessera.streaming import seen

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n int")
    at, folder = f"{tmp_path}/in.parquet", f"file://{tmp_path}/state"
    rows.write.parquet(at)
    first = {r.k: r.n for r in seen.counted_stream(spark, at, ["k"], folder).collect()}
    rows.limit(1).write.mode("append").parquet(at)
    assert first == {"a": 2, "b": 1}
    assert {r.k: r.n for r in seen.counted_stream(spark, at, ["k"], folder).collect()} == {"a": 3, "b": 1}


def test_pieces_by_category_spelling_and_strictness(spark):
    cases = [
        (["etnies"], "Emerson", "Etnies Shoes Emerson", "footwear", "footwear", [], False, True),
        (["etnies"], "Emerson", "Etnies Shoes Emerson", "footwear", "accessories", [], False, False),
        (["adidas"], "Classic", "Classic Shoes", "footwear", "footwear", [], False, False),
        (["Nike"], "Windrunner Hoodie", "Windrunner Skirt", "tops", "skirts", [], False, False),
        (["Carhartt WIP", "Carhartt"], "Carhartt WIP Detroit Jacket Black Rinsed", "Detroit Jacket", "outerwear", "outerwear", ["Black (rinsed)"], False, True),
        (["Nike", "Jordan"], "Nike Air Jordan 1 Retro High OG", "Jordan 1 Retro High OG", None, None, [], False, True),
        (["adidas"], "Samba OG Shoes", "adidas Samba OG 'Cloud White Core Black'", None, None, ["Cloud White / Core Black / Gum"], False, True),
        ([""], "Air Max 90", "Air Max 90", None, None, [], False, False),
        (["Nike"], "Air Max 90", "Air Max 90", None, None, [], True, True),
        (["Nike"], "Classic Logo Tee", "Classic Logo Tee", None, None, [], True, False),
        (["New Balance"], "9060", "New Balance 9060 U9060EEB NEW", None, None, [], False, True),
        (["New Balance"], "9060", "9060", None, None, [], True, False),
        (["Nike"], "2024", "2024", None, None, [], False, False),
        (["Nike"], None, None, None, None, [], False, False),
    ]
    rows = [(n, makers[0], makers[-1], *rest) for n, (makers, *rest) in enumerate(cases)]
    d = spark.createDataFrame(rows, "n int, maker string, other string, a string, b string, cat_a string, cat_b string, colours array<string>, strict boolean, want boolean")
    c, none = F.col, F.array().cast("array<string>")
    same = piece.same_piece([c("maker"), c("other")], c("a"), c("b"), c("colours"), none, c("cat_a"), c("cat_b"), c("strict"))
    assert [r.n for r in d.select("n", "want", same.alias("same")).collect() if r.same is not r.want] == []


def test_garments_by_head_and_script(spark):
    kinds_ = {
        "Reversible Bomber Nylon Jacket": "bomber", "Belt Scarf": "scarf", "Skater Jeans/Shorts with Belt Keychain": "shorts", "With Scarf": "scarf",
        "Куртка-бомбер": "bomber", "Платье-рубашка": "dress", "Паркет": None, "Парка зимняя": "parka", "Knit Dresses": "dress", "Brushes": None,
    }
    assert values(spark, list(kinds_), lambda v: garments.garment(v)["kind"]) == list(kinds_.values())
    many = tuple(garments.Garment(f"kind{n}", "tops", (), (f"~term{n}", f"стем{n} слов!")) for n in range(3000))
    found = values(spark, ["A Term2999 term7", "стем12а слов", "стем12а слово"], lambda v: F.to_json(garments.garment(v, many)))
    assert found == ['{"kind":"kind2999","category":"tops","generic":false,"strong":false}'.replace("2999", "7"), '{"kind":"kind12","category":"tops","generic":false,"strong":true}', None]


CARD = "card int, pos int, url string, retailers array<struct<name:string,url:string>>, brand string, name string, colours array<string>, category string, price double, part_number string"
PAGE = "page int, url string, store string, brand string, name string, colours array<string>, stated boolean, category string, price double, codes array<string>, links_only boolean"


def cards_of(spark, *rows):
    made = [(n, n, r.get("url", f"https://first.com/p/{n}"), r.get("retailers"), r.get("brand"), r["name"], r.get("colours"), r.get("category"), r.get("price"), r.get("mpn")) for n, r in enumerate(rows)]
    return spark.createDataFrame(made, CARD)


def pages_of(spark, *rows):
    made = [
        (n, r.get("url", f"https://second.com/q/{n}"), r.get("store"), r.get("brand"), r["name"], r.get("colours"), r.get("stated"), r.get("category"), r.get("price"), r.get("codes"), r.get("links_only"))
        for n, r in enumerate(rows)
    ]
    return spark.createDataFrame(made, PAGE)


def test_same_items(spark):
    cards = cards_of(
        spark,
        dict(brand="Nike", name="Nike Air Force 1 '07", colours=["White"], price=115.0),
        dict(brand="adidas", name="Samba OG Shoes", colours=["Cloud White / Core Black / Gum"]),
        dict(brand="New Balance", name="New Balance 9060", colours=["Grey"]),
        dict(brand="Jordan", name="Air Jordan 1 Retro High OG", colours=["Black/White"]),
        dict(brand=None, name="Bullet Hole Jeans", colours=["Blue"], category="jeans", price=500.0),
        dict(brand="Levi's", name="Levi's 501 Original Jeans", colours=["Blue"], category="jeans"),
        dict(brand="Acme", name="Yori Text Zip-up (Grey/Black)", retailers=[("Shop", "https://shop.com/a")]),
        dict(brand="Acme", name="Renamed", retailers=[("Shop", "https://shop.com/b")]),
        dict(brand="Zed", name="Nuvola Quartz Parka", colours=["Black"]),
        dict(brand="Zed", name="Nuvola Quartz Parka", colours=["Red"], retailers=[("Second", "https://second.com/x")]),
    )
    want = {
        0: (dict(brand="Nike", name="Кросівки чоловічі Nike Air Force 1 '07 CW2288-111", colours=["White"], price=110.0), 0, "colour"),
        1: (dict(brand="adidas", name="adidas Samba OG 'Cloud White Core Black'", colours=["White"]), 1, "colour"),
        2: (dict(brand="New Balance", name="New Balance 9060 U9060EEB NEW", colours=["Grey"]), 2, "colour"),
        3: (dict(brand="Nike", name="Nike Air Jordan 1 Retro High OG", colours=["White/Black"]), 3, "colour"),
        4: (dict(brand="Mowalola", name="Mowalola Bullet Hole Jeans", colours=["Blue"], category="jeans", price=520.0), 4, "colour"),
        5: (dict(brand="Mowalola", name="Mowalola Bullet Hole Jeans", colours=["Blue"], category="jeans", price=5200.0), None, "price"),
        6: (dict(brand="Levis", name="Levis 501 Original Jeans", colours=["Blue"], category="jeans"), 5, "colour"),
        7: (dict(brand="Acme", name="Yori Text Zip-up (Black/White)", url="https://shop.com/a?utm_source=x"), None, "other variant"),
        8: (dict(brand="Acme", name="Yori Text Zip-up (grey/black)"), 6, "variant"),
        9: (dict(brand="Other", name="Anything", url="https://www.shop.com/b/"), 7, "page"),
        10: (dict(brand="Zed", name="Nuvola Quartz Parka", colours=["Red"]), 9, "colour"),
        11: (dict(brand="Zed", name="Nuvola Quartz Parka", colours=["Green"]), None, "other colour"),
        12: (dict(brand="Zed", name="Nuvola Quartz Parka"), 8, "model"),
        13: (dict(brand="Zed", name="Nuvola Quartz Parka", colours=["Red"], stated=False, store="second"), 8, "model"),
        14: (dict(brand=None, name="Something Else"), None, "no brand"),
        15: (dict(brand="Zed", name="Something Else"), None, "no card"),
        16: (dict(brand="Zed", name="Nuvola Quartz Parka", url=None), None, "no address"),
        17: (dict(brand=None, name=None, url="https://second.com/q/17"), None, "no brand"),
    }
    found = {r.page: (r.card, r.how, r.stale) for r in matching.same_items(pages_of(spark, *(p for p, _, _ in want.values())), cards, "page", "card").collect()}
    assert found == {n: (card, how, int(n == 7)) for n, (_, card, how) in want.items()}
    assert matching.same_items(pages_of(spark, want[0][0]), cards.limit(0), "page", "card").first().how == "no card"


def test_a_link_takes_the_one_card_of_its_name(spark):
    cards = cards_of(spark, dict(brand="Zed", name="Nuvola Quartz Parka", colours=["Black"]))
    pages = pages_of(spark, *(dict(brand="Zed", name="Nuvola Quartz Parka", colours=["Red"], links_only=x) for x in (True, False)))
    assert {r.page: (r.card, r.how) for r in matching.same_items(pages, cards, "page", "card").collect()} == {0: (0, "link"), 1: (None, "other colour")}


def test_colours_by_tier_phrase_and_stem(spark):
    field = {
        "Black Linen": "black", "Navy Marl": "blue", "Stone": "beige", "Heather": "grey", "Rose Gold": "pink", "gold rose": "pink", "skyblue": "blue", "Тёмно-синий": "blue",
        "серьги": None, "Серая": "grey", "снежный": "white", "меланж": "grey", "Off-White / jet": "white", "Cloud White": "white", "xx": None, "олень": None,
    }
    assert values(spark, list(field), lambda v: colour.canonical(v, True)) == list(field.values())
    named = {"Stone Island Jacket": [], "Linen Shirt Sky Blue": ["blue"], "Navy, red and forest green": ["blue", "red", "green"], "Джинсовая куртка": []}
    assert values(spark, list(named), colour.colour_words) == list(named.values())
    assert values(spark, ["camo", "Black и Red", "stone"], lambda v: colour.group_names(v, True)) == [["Multicolor"], ["Black", "Red", "Multicolor"], ["Beige"]]
    assert values(spark, ["XL", "a_b", "b.jpg?x", "new"], lambda v: colour.why_not(v, codes.is_size(v))) == ['"XL" is a size', '"a_b" is a file name', '"b.jpg?x" is a file name', '"new" is not a colour name']


def test_makers_of_models(spark):
    named = {"Dunk Low 'Panda'": "Nike", "Sambas": None, "adidas Samba OG": "Adidas", "550 'White Green'": "New Balance", "Levi's 550": None, "Club C 85 Vintage": "Reebok"}
    assert values(spark, list(named), lambda v: piece.brand_from_model(v, F.array(F.lit("Adidas"), F.lit("x")))) == list(named.values())


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "SLOT", 7)
    rows = [(k, "hot" if k % 3 else f"b{k % 5}", k * k) for k in range(100)] + [(200, None, 0)]
    found = duplicates.block_pairs(spark.createDataFrame(rows, "id long, block string, v long"), "id", "block").collect()
    got = sorted((min(r.a_id, r.b_id), max(r.a_id, r.b_id)) for r in found)
    assert got == sorted((x, y) for x, b, _ in rows for y, d, _ in rows if x < y and b is not None and b == d)
    assert all(r.a_v == r.a_id**2 and r.b_v == r.b_id**2 for r in found)


def test_name_links_pick_each_other(spark):
    schema = "id long, brand string, name string, colours array<string>, price double, stores array<string>, store string"
    card = lambda k, name, colours, store, price=100.0, brand_="Etnies": (k, brand_, name, colours, price, [store], store)
    rows = [
        card(1, "Emerson Kingpin", ["Black / White"], "a.com"), card(2, "Emerson Kingpin", ["Black / Grey"], "a.com"), card(3, "Emerson Kingpin", ["Black"], "b.com"),
        card(4, "Marana Kingpin", ["Red"], "a.com"), card(5, "etnies Marana Kingpin Shoes", ["red"], "b.com"), card(6, "Marana Kingpin", ["Red"], "c.com", 500.0), card(7, "Marana Kingpin", ["Red"], "a.com"),
        card(8, "Jameson Kingpin", None, "a.com"), card(9, "Jameson Kingpin", ["Toro Bravo"], "b.com", None), card(10, "Jameson Kingpin Toro Bravo", ["Toro Bravo"], "c.com"), card(11, "Jameson Kingpin", ["Navy"], "d.com", 10.0, ""),
    ]
    found = duplicates.name_links(spark.createDataFrame(rows, schema)).collect()
    # 3 could be either of a.com's; 4 and 7 are two of one store, so 5 picks neither; 8 has no colour.
    assert sorted(map(tuple, found)) == [(8, 9), (8, 10), (9, 10)]


def test_families_are_chains(spark):
    rows = [(1, "g", "Acme", "Ritual Jacket", None), (2, "g", "Acme", "Ritual Woven Hoodie", None), (3, "g", "Acme", "Ritual Woven Dress", None), (4, "g", "Acme", "Cypher Jacket", None), (5, "h", "", "Ritual Jacket", None), (6, "h", "Acme", "Acme Ritual", None), (7, "h", None, "", None)]
    found = duplicates.model_families(spark.createDataFrame(rows, "id long, gid string, brand string, name string, category string"), "gid").collect()
    assert {r.id: r.family for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_gallery_harvest(spark):
    page = "https://www.shop.com/shopping/easy-tote-item-27412345.aspx"
    named = "Classic Easy Tote"
    cases = [
        # Named after the piece or its code; furniture of its own name stays.
        ([], ["https://cdn.x.com/a/my-easytote-logo.jpg", "/img/27412345_99_1000.jpg", "/img/other-bag.jpg", "/img/classic-tote-insert.jpg"], ["https://cdn.x.com/a/my-easytote-logo.jpg", "https://www.shop.com/img/27412345_99_1000.jpg"]),
        # Beside a trusted one: by front, by frame, on its host only.
        (["/i/all-birds_0010.jpg?width=30"], ["/i/all-birds_0017.jpg", "https://t.com/i/all-birds_0018.jpg", "/i/all-stars-banner.jpg", "/i/all-birds_0010.jpg"], ["https://www.shop.com/i/all-birds_0017.jpg"]),
        (["/i/sku1204551.jpg"], ["/i/sku1204552.jpg", "/i/sku9903341.jpg", "/i/IMG_4417.jpg"], ["https://www.shop.com/i/sku1204552.jpg"]),
        # Frames of a code: the code decides.
        (["/i/251149M237012_1.jpg"], ["/i/251149M237012_2.jpg", "/i/251149M237013_1.jpg", "/i/classic-easytote-2.jpg"], ["https://www.shop.com/i/251149M237012_2.jpg"]),
        (["/i/a.js", None], [None, "", "mailto:x"], []),
    ]
    rows = spark.createDataFrame([(k, page, named, t, c) for k, (t, c, _) in enumerate(cases)], "k int, url string, name string, trusted array<string>, candidates array<string>")
    found = {r.k: r.photos for r in gallery.harvests(rows, "k").collect()}
    first = {1: "all-birds_0010.jpg", 2: "sku1204551.jpg", 3: "251149M237012_1.jpg"}
    assert found == {k: [f"https://www.shop.com/i/{first[k]}" for _ in first if k in first][:1] + want for k, (_, _, want) in enumerate(cases)}
    assert values(spark, ["Black Leather Jacket", "Tree Runners", "Cruiser", "Jacket", None], photos.name_phrases) == [[], ["treerunner"], ["cruiser"], [], []]


def test_shop_photos(spark):
    shown = spark.createDataFrame([(p, "s.com", u) for p in range(6) for u in ("https://s.com/logo.png", f"https://s.com/p{p}.jpg")] + [(9, "t.com", "https://s.com/logo.png")], "page int, store string, photo string")
    left = {(r.page, r.photo[14:]) for r in gallery.without_shop_photos(shown).collect()}
    assert left == {(p, f"p{p}.jpg") for p in range(6)} | {(9, "logo.png")}


def test_fixed_shuffle(spark):
    def brute(a):
        s, a = 0x4A3F2E1D, list(a)
        for i in range(len(a) - 1, 0, -1):
            s = (s ^ (s << 13)) & 0xFFFFFFFF
            s = (s ^ ((s - (1 << 32) if s >> 31 else s) >> 17)) & 0xFFFFFFFF
            s = (s ^ (s << 5)) & 0xFFFFFFFF
            j = int(s / 0x100000000 * (i + 1))
            a[i], a[j] = a[j], a[i]
        return a

    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 3, 10, 57)] + [(None,)], "a array<int>").select("a", markup.shuffled(F.col("a")).alias("s")).collect()
    assert all(r.s == (None if r.a is None else brute(r.a)) for r in rows)


def test_brands_as_words_of_their_own(spark):
    cases = [("Pull-On Boot", "On", -1), ("On Cloud 5", "On", 0), ("Market", "Arket", -1), ("Кросівки Nike Air", "nike", 9), ("Levi's 501", "Levi's", 0), ("Acne  Studios Tee", "Acne Studios", 0), ("a+b", "A+B", 0), ("x", "", -1), (None, "x", -1)]
    rows = spark.createDataFrame([(t, b) for t, b, _ in cases], "t string, b string").select(brand.position_in(F.col("t"), F.col("b")).alias("p")).collect()
    assert [r.p for r in rows] == [p for *_, p in cases]
    names = spark.createDataFrame([(1, "Women's On Cloud 5"), (2, "Ash Grey Hoodie Nike"), (3, "Pull-On Boot")], "id int, name string")
    known = spark.createDataFrame([("On",), ("Nike",), ("Lee",)], "k string")
    assert {r.id: r.brand for r in records.brands_in_names(names, known, "id", "name", "k").collect()} == {1: "On", 2: "Nike"}
