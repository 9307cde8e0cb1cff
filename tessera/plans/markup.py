"""Queries over markup put into the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kinds, markup, photos, styles, urls
from ..sources import documents
from ..sources.tables import dealt, table
from .garments import _quoted, spotted, term_rows
from .pages import ROBOTS_SQL, _robots, sql
from .registry import Registry

R = Registry()

MARKUP = '<div itemprop="name">Red <b>Coat</b> {n}</div><meta itemprop="price" content="{n}"><meta property="og:image" content="https://{h}/a{n}.jpg"><meta property="og:image" content="b.jpg"><img src="https://{h}/a{n}.jpg"><img data-src="c{n}.jpg"><div style="background-image: url(\'d.jpg\')"></div><img srcset="e,{n}.jpg 1x, f.jpg 2x">'


@R.query(sql("with p as (select page_id, {host} as h, page_id::varchar as n from pages) select page_id, 'Red Coat ' || n as name, n as price, 'https://' || h || '/a' || n || '.jpg,b.jpg' as metas, 'https://' || h || '/a' || n || '.jpg,c' || n || '.jpg,d.jpg,e,' || n || '.jpg,f.jpg' as images from p"))
def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microdata, repeated meta tags, and photos from all kinds of tags."""
    put = F.replace(F.replace(F.lit(MARKUP), F.lit("{n}"), F.col("page_id").cast("string")), F.lit("{h}"), urls.store_host(F.col("url")))
    h = F.concat(put, F.col("html"))
    m = markup.microdata(h)
    return table(spark, sf_dir, "pages").select("page_id", m["name"].alias("name"), m["price"].alias("price"), F.array_join(markup.all_meta(h, "og:image"), ",").alias("metas"), F.array_join(markup.image_candidates(h), ",").alias("images"))


@R.query(sql("select page_id, 'piece ' || page_id as title from pages"))
def page_tidy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without the shop's name and sales words at their ends."""
    shops = markup.store_names(F.lit('<meta property="og:site_name" content="My Shop">'), F.col("url"))
    title = F.concat(F.lit("Buy online | piece "), F.col("page_id").cast("string"), F.lit(" — My Shop | Free shipping"))
    return table(spark, sf_dir, "pages").select("page_id", markup.tidy_title(title, shops).alias("title"))


@R.query("select page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) as by_rule, null::varchar as by_bad_rule, 'é & ' || page_id as decoded from pages")
def page_site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's own expressions, a broken one ignored; numeric entities."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        markup.apply_rule(F.col("html"), F.lit('lang="([a-z]+)"')).alias("by_rule"),
        markup.apply_rule(F.col("html"), F.lit("([")).alias("by_bad_rule"),
        markup.decode_all_entities(F.concat(F.lit("&#233; &amp; "), F.col("page_id").cast("string"))).alias("decoded"),
    )


STYLED = [(n, t) for n, s in enumerate(kinds.STYLES) for t in styles.STYLE_TERMS[s]]
SAID = [t.replace("!", "") for _, t in STYLED]
_PICK = "(select [" + ", ".join(map(_quoted, SAID)) + f"])[1 + ({{n}}) % {len(SAID)}]"
_SAID_SQL = f"select p_partkey as id, split_part(p_name, ' ', 1) || ' ' || {_PICK.format(n='p_partkey * 5 + p_size')} || case when p_size % 2 = 0 then 's, ' else '-' end || {_PICK.format(n='p_partkey * 3')} || ' / ' || {_PICK.format(n='p_size')} as title from part"


@R.query(
    f"with {spotted(_SAID_SQL, term_rows(STYLED))}, first as (select id, rank, arg_min(array_to_string(w.w[i:e], ' '), i * 1000 + rank) as said from hits join w using (id) group by id, rank), "
    + "listed as (select id, list(rank order by rank) as ranks, max(said) filter (where rank = 1) as evidence from first group by id) "
    + "select p_partkey, coalesce(array_to_string(list_transform(ranks[1:3], lambda r: ([" + ", ".join(map(_quoted, kinds.STYLES)) + "])[r + 1]), ','), '') as styles, evidence from part left join listed on id = p_partkey"
)
def style_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles by their terms, three at most, with what first told one."""
    said = F.array(*map(F.lit, SAID))
    pick = lambda n: F.get(said, (F.expr(n) % len(SAID)).cast("int"))
    text = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "), pick("p_partkey * 5 + p_size"), F.when(F.col("p_size") % 2 == 0, "s, ").otherwise("-"), pick("p_partkey * 3"), F.lit(" / "), pick("p_size"))
    rows = dealt(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", F.array_join(styles.inferred_styles(F.col("text")), ",").alias("styles"), styles.style_evidence(F.col("text"))["streetwear"].alias("evidence"))


@R.query("select s_suppkey, case when s_suppkey % 3 = 0 then s_name when s_suppkey % 3 = 1 then 'Shop' || s_nationkey || 'x' else 'acme' || s_nationkey end as shown from supplier")
def retailer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retailers that were given the brand's name get their own, but for the
    brand's own site."""
    k, nation = F.col("s_suppkey") % 3, F.col("s_nationkey").cast("string")
    own = F.concat(F.lit("acme"), nation)
    url = F.concat(F.lit("https://www."), F.when(k == 2, own).otherwise(F.concat(F.lit("shop"), nation, F.lit("x"))), F.lit(".co.uk/p"))
    fixed = markup.repaired_retailers(F.array(F.struct(F.when(k == 0, F.col("s_name")).otherwise(own).alias("name"), url.alias("url"))), F.initcap(own))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fixed[0]["name"].alias("shown"))


@R.query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by md5('42:' || o_orderkey), o_orderkey) as place from orders")
def shuffled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in a fixed shuffle."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(markup.shuffled_order(F.col("o_orderkey")), "o_orderkey"))
    return o.withColumn("place", place.cast("long"))


@R.query(sql("with p as (select distinct {host} as host, {path} || case when {query} = '' then '' else '?' || {query} end as path from pages) select host, path, ").replace("{query}", "x") + ROBOTS_SQL.replace("{p}", "path") + " as allowed from p")
def robots_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with their parameters under robots.txt."""
    pages = table(spark, sf_dir, "pages")
    rules, _ = _robots(spark, pages)
    u = F.col("url")
    asked = F.concat(urls.path(u), F.when(urls.query(u) == "", "").otherwise(F.concat(F.lit("?"), urls.query(u))))
    return documents.allowed(pages.select(urls.store_host(u).alias("host"), asked.alias("path")).distinct(), rules)


SHADES = ["Red", "Blue", "Ecru"]
_SHADE = "(['Red', 'Blue', 'Ecru'])[1 + (page_id + {0}) % 3]"


@R.query(
    f"select page_id, 'Tee ' || page_id as group_name, case when page_id % 2 = 0 then {_SHADE.format(1)} else {_SHADE.format(0)} end as color, case when page_id % 2 = 0 then 'L' else 'S,M' end as sizes, "
    + "(case when page_id % 2 = 0 then 9 + page_id % 5 else 10 + page_id % 90 end)::double as least_price, case when page_id % 2 = 0 then 9 + page_id % 5 else 12.5 + page_id % 90 end::double as most_price, "
    + "case when page_id % 2 = 0 then 'https://x.com/a?v=' || page_id || ',https://x.com/b' else 'https://y.com/' || page_id end as other_colours, 'Men > Tees ' || page_id as trail from pages"
)
def page_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant groups put into the pages: the variant that is the page's own,
    else the first, with its colour's sizes and prices, the other colours'
    addresses, and the breadcrumbs."""
    n = F.col("page_id")
    shade = lambda k: F.get(F.array(*map(F.lit, SHADES)), ((n + k) % 3).cast("int"))
    text = lambda c: c.cast("string")
    variant = lambda colour, size, url, price: F.struct(colour.alias("color"), F.lit(size).alias("size"), url.alias("url"), F.struct(text(price).alias("price")).alias("offers"))
    other = F.when(n % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://y.com/"), text(n)))
    variants = [variant(shade(0), "S", F.concat(F.lit("https://x.com/a?v="), text(n)), n % 90 + 10), variant(shade(0), "M", F.lit("https://x.com/b"), F.concat(text(n % 90 + 12), F.lit(",50"))), variant(shade(1), "L", other, n % 5 + 9)]
    group = F.to_json(F.struct(F.lit("ProductGroup").alias("@type"), F.concat(F.lit("Tee "), text(n)).alias("name"), F.array(*variants).alias("hasVariant")))
    crumbs = F.concat(F.lit('{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"Tees '), text(n), F.lit('"},{"position":1,"item":{"name":"Men"}}]}'))
    script = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(script(group), script(crumbs), F.col("html")).alias("html"))
    shown = documents.shown_variants(documents.product_variants(pages, "page_id", "html"), pages, "page_id", "url")
    trail = pages.select("page_id", F.array_join(documents.breadcrumbs(F.col("html")), " > ").alias("trail"))
    return shown.join(trail, "page_id").select("page_id", "group_name", "color", F.array_join("sizes", ",").alias("sizes"), "least_price", "most_price", F.array_join("other_colours", ",").alias("other_colours"), "trail")


@R.query("select page_id, 'https://x.com/i/look-' || page_id || '-0001.jpg,https://x.com/i/look-' || page_id || '-0002.jpg,https://x.com/i/red-wool-coat.jpg' as gallery from pages")
def page_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of one piece among a page's addresses."""
    at = lambda n: F.concat(F.lit("https://x.com/i/look-"), F.col("page_id").cast("string"), F.lit(f"-{n}.jpg"))
    others = [F.lit(f"https://x.com/i/{n}.jpg") for n in ("red-wool-coat", "unrelated", "placeholder")] + [F.lit("https://y.com/i/red-wool-coat.jpg")]
    found = photos.gallery(F.array(at("0002"), *others), F.array(at("0001")), F.lit("Red Wool Coat"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, ",").alias("gallery"))


# The generator's state, an unsigned number here, and the list, one swap a round.
_XOR = "xor({s}, ({s} << 13) & 4294967295)", "xor({s}, floor((case when {s} >= 2147483648 then {s} - 4294967296 else {s} end) / 131072)::bigint & 4294967295)", "xor({s}, ({s} << 5) & 4294967295)"


def _next(state: str) -> list[str]:
    """CTE columns of one draw: three shifts, one after the other."""
    return [x.replace("{s}", s) for x, s in zip(_XOR, (state, "s1", "s2"), strict=True)]


@R.query(
    f"""with recursive lists as (select o_custkey, list(o_orderkey order by o_orderkey) as a from orders group by o_custkey),
r as (select o_custkey, a, len(a) - 1 as i, {markup.SHUFFLE_SEED}::bigint as s from lists
  union all select o_custkey, list_transform(a, lambda x, k: case when k = i + 1 then a[1 + (s3 * (i + 1)) // 4294967296] when k = 1 + (s3 * (i + 1)) // 4294967296 then a[i + 1] else x end), i - 1, s3
  from (select *, {_next("s")[2]} as s3 from (select *, {_next("s")[1]} as s2 from (select *, {_next("s")[0]} as s1 from r where i > 0))))
select o_custkey, array_to_string(a, ',') as shuffled from r where i <= 0"""
)
def shuffled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in the fixed shuffle of lists."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    return lists.select("o_custkey", F.array_join(markup.shuffled(F.col("a")).cast("array<string>"), ",").alias("shuffled"))
