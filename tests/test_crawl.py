"""Addresses of links, product links and crawl plans."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators import crawl
from tessera.sources import documents


def test_resolved(spark):
    base = "https://Shop.com/a/b/c.html?q=1#f"
    plain = ["x", "./x", "../x", "../../../x", "/x/../y/./z", "?p=2", "x/..", "a/../..", "//cdn.com/p", "http://e.com", "d/e?x=../y", ".", ".."]
    rows = spark.createDataFrame([(h, base) for h in plain], "h string, b string").select("h", urls.resolved(F.col("h"), F.col("b")).alias("r")).collect()
    for r in rows:
        want = urljoin(base, r.h).replace("Shop.com", "shop.com")
        # The library leaves a host without a path bare.
        assert r.r == (want + "/" if want == "http://e.com" else want), r.h
    odd = {"mailto:a@b": None, "javascript:x()": None, "": "https://shop.com/a/b/c.html?q=1", "#top": "https://shop.com/a/b/c.html?q=1", "HTTPS://E.com:443/Ü b": "https://e.com/%C3%9C%20b", " /t\nab ": "https://shop.com/tab", None: "https://shop.com/a/b/c.html?q=1"}
    rows = spark.createDataFrame([(h, base) for h in odd], "h string, b string").select("h", urls.resolved(F.col("h"), F.col("b")).alias("r")).collect()
    assert {r.h: r.r for r in rows} == odd
    assert spark.range(1).select(urls.resolved(F.lit("x"), F.lit("no address")).alias("r")).first().r is None


def test_product_links(spark):
    html = '<base href="/shop/"><a href="/products/a1">x</a><a href="products/b?c=1">y</a><A class=z href=\'//s.com/products/a1#x\'>z</a><a href="https://t.com/products/q">t</a>'
    pages = spark.createDataFrame([(1, "https://www.s.com/list", html), (2, "https://s.com/", None)], "page long, url string, html string")
    links = lambda **more: [(r.kind, r.link) for r in crawl.product_links(pages, "page", "url", "html", **more).orderBy("kind", "place").collect()]
    assert links() == [(1, "https://www.s.com/products/a1"), (1, "https://www.s.com/products/b")]
    assert links(follow_base=True)[1] == (1, "https://www.s.com/shop/products/b")
    nodes = spark.createDataFrame([(1, 0, "https://other.com/x#y"), (1, 1, "/relative"), (1, 2, "https://www.s.com/products/a1")], "page long, place int, url string")
    assert links(nodes=nodes) == [(0, "https://other.com/x"), (0, "https://www.s.com/products/a1"), (1, "https://www.s.com/products/b")]


def test_ranked_in_shares(spark, monkeypatch):
    monkeypatch.setattr(crawl, "SHARES", 5)
    rows = spark.range(500).select(F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("host"), ((F.col("id") * 37) % 501).alias("place"), "id")
    found = {(r.host, r.rank): r.place for r in crawl.ranked(rows, "host", ["place"], 20, "id").collect()}
    for host, own in (("small", range(0, 500, 10)), ("hot", [k for k in range(500) if k % 10])):
        assert [found[host, n] for n in range(1, 21)] == sorted((k * 37) % 501 for k in own)[:20]


def test_plans_remember(spark, tmp_path):
    rows = [("s.com", 1, k, f"https://s.com/products/p{k}") for k in range(5)] + [("s.com", 0, 0, "https://www.s.com/products/p3/?utm_source=x"), ("s.com", 1, 9, "https://t.com/products/z"), ("s.com", 2, 0, "https://s.com/cart/x"), ("s.com", 2, 1, "https://s.com/products/p9?no=1")]
    candidates = spark.createDataFrame(rows, "host string, priority int, place int, url string")
    rules = documents.robots_rules(spark.createDataFrame([("s.com", "User-agent: *\nDisallow: /cart\nDisallow: /*?no=")], "host string, robots_txt string"))
    first = crawl.planned(candidates, rules, most=2)
    assert [(r.rank, r.url) for r in first.orderBy("rank").collect()] == [(1, "https://www.s.com/products/p3/?utm_source=x"), (2, "https://s.com/products/p0")]
    known = crawl.remembered(first, f"file://{tmp_path}/memory")
    second = crawl.planned(candidates, rules, known)
    assert [r.url[-2:] for r in second.orderBy("rank").collect()] == ["p1", "p2", "p4"]
    assert crawl.planned(candidates, rules, crawl.remembered(second, f"file://{tmp_path}/memory")).count() == 0
