"""Queries over orders, offers and money."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import catalogue
from ..sources.tables import table
from .registry import Registry

R = Registry()

CODES = ["USD", "EUR", "GBP", "UAH", "XXX"]
RATE = "case {c} when 'USD' then 1.0::double " + " ".join(f"when '{k}' then {v}::double" for k, v in money.USD_RATES.items()) + " end"


def _code(key: str):
    return F.element_at(F.array(*map(F.lit, CODES)), (F.col(key) % len(CODES) + 1).cast("int"))


def _sql_code(key: str) -> str:
    return "case " + key + f" % {len(CODES)} " + " ".join(f"when {k} then '{c}'" for k, c in enumerate(CODES)) + " end"


@R.query("select l_orderkey, string_agg(l_linenumber || ':' || p_name, ',' order by l_linenumber, l_partkey, p_name) as items, count(*) as n from lineitem join part on l_partkey = p_partkey group by l_orderkey")
def order_items_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items' products, in order; unknown products drop."""
    found = catalogue.ordered_hydrate(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), "l_orderkey", "l_linenumber", "l_partkey", "p_partkey", ["p_name"])
    listed = F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"].cast("string"), i["p_name"]))
    return found.select("l_orderkey", F.array_join(listed, ",").alias("items"), F.size("items").cast("long").alias("n"))


@R.query("select l_orderkey, l_linenumber, l_partkey, coalesce(case when l_linenumber % 3 = 0 then 'stored' end, p_name, '') as shown_name, p_partkey is not null as product_exists from lineitem left join (select * from part where p_partkey % 4 <> 0) on l_partkey = p_partkey")
def order_items_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item, the stored name before the product's, and whether there is one."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 3 == 0, "stored").otherwise("").alias("stored"))
    found = catalogue.enrich(items, table(spark, sf_dir, "part").filter("p_partkey % 4 <> 0"), "l_partkey", "p_partkey", "stored", "p_name")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "shown_name", "product_exists")


@R.query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem join part on l_partkey = p_partkey where p_type = 'PROMO')")
def orders_with_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").filter("p_type = 'PROMO'").select("p_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(wanted, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@R.query("with c as (select o_orderkey, o_totalprice, " + _sql_code("n_nationkey") + " as currency from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) select o_orderkey, currency, floor(o_totalprice / " + RATE.replace("{c}", "currency") + " * 100 + 0.5) / 100 as usd from c")
def fx_converted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals in dollars by the nation's currency; null if unknown."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", _code("n_nationkey").alias("currency"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("o_orderkey", "currency", money.to_usd(F.col("o_totalprice"), F.col("currency")).alias("usd"))


@R.query("with o as (select l_partkey, l_suppkey, min(l_extendedprice) as price, " + _sql_code("l_suppkey") + " as currency from lineitem group by l_partkey, l_suppkey), u as (select *, price / " + RATE.replace("{c}", "currency") + " as usd from o) select l_partkey, arg_min(l_suppkey, (usd, l_suppkey)) as l_suppkey, arg_min(price, (usd, l_suppkey)) as price, arg_min(currency, (usd, l_suppkey)) as currency from u where usd is not null group by l_partkey")
def cheapest_supplier_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least offer of each part, compared in dollars, in its own currency."""
    offers = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("price")).withColumn("currency", _code("l_suppkey"))
    usd = offers.withColumn("usd", money.unrounded_usd(F.col("price"), F.col("currency"))).filter("usd is not null")
    best = usd.groupBy("l_partkey").agg(F.min(F.struct("usd", "l_suppkey", "price", "currency")).alias("best"))
    return best.select("l_partkey", "best.l_suppkey", "best.price", "best.currency")


@R.query("with o as (select l_orderkey, list({'p': l_extendedprice, 'c': " + _sql_code("l_suppkey") + "} order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as o from lineitem group by l_orderkey), x as (select l_orderkey, unnest(o) as e, generate_subscripts(o, 1) as i from o), u as (select *, e.p / " + RATE.replace("{c}", "e.c") + " as usd from x) select l_orderkey, arg_min(e.p, (usd, i)) as price, arg_min(e.c, (usd, i)) as currency from u where usd is not null group by l_orderkey")
def cheapest_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least of each order's offers, as an array expression."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), _code("l_suppkey").alias("currency")).alias("o"))
    best = money.cheapest_offer(F.sort_array(F.collect_list("o")))
    return lines.groupBy("l_orderkey").agg(best.alias("best")).filter("best is not null").select("l_orderkey", "best.price", "best.currency")


#: How a number of cents is written, and what it means.
SHAPES = 5
WRITTEN = "case l_orderkey % 5 when 0 then '$' || c || '.' || r when 1 then c || ',' || r || ' €' when 2 then (c // 1000) || '.' || lpad((c % 1000)::varchar, 3, '0') || ',' || r || ' zł' when 3 then 'GBP' || (c // 1000) || ',' || lpad((c % 1000)::varchar, 3, '0') || '.' || r else c || ' 000 грн' end"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as shops write them."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("c")).distinct()  # noqa: E741
    l = l.withColumn("r", F.lpad((F.col("l_orderkey") % 90 + 10).cast("string"), 2, "0"))  # noqa: E741
    c, r, k = F.col("c").cast("string"), F.col("r"), F.col("l_orderkey") % SHAPES
    thousands, rest = F.floor(F.col("c") / 1000).cast("string"), F.lpad((F.col("c") % 1000).cast("string"), 3, "0")
    text = (
        F.when(k == 0, F.concat(F.lit("$"), c, F.lit("."), r))
        .when(k == 1, F.concat(c, F.lit(","), r, F.lit(" €")))
        .when(k == 2, F.concat(thousands, F.lit("."), rest, F.lit(","), r, F.lit(" zł")))
        .when(k == 3, F.concat(F.lit("GBP"), thousands, F.lit(","), rest, F.lit("."), r))
        .otherwise(F.concat(c, F.lit(" 000 грн")))
    )
    return l.select("l_orderkey", "l_linenumber", "c", "r", text.alias("text"))


PRICED = "with d as (select distinct l_orderkey, l_linenumber, floor(l_extendedprice)::bigint as c, lpad((l_orderkey % 90 + 10)::varchar, 2, '0') as r from lineitem), t as (select *, " + WRITTEN + " as text from d) "


@R.query(PRICED + "select l_orderkey, l_linenumber, text, case when v > 500000 then 0.0 else v end as price, case l_orderkey % 5 when 0 then 'USD' when 1 then 'EUR' when 2 then 'PLN' when 3 then 'GBP' else 'UAH' end as currency from (select *, case when l_orderkey % 5 = 4 then c * 1000.0 else c + r::int / 100.0 end::double as v from t)")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and currencies out of prices in five ways of writing."""
    t = F.col("text")
    return _written(spark, sf_dir).select("l_orderkey", "l_linenumber", "text", money.parse_price(t).alias("price"), money.currency_from_text(t).alias("currency"))


# A code that touches its amount isn't a word, so 'GBP12,345.67' isn't found.
# An amount is grouped in threes, so of "12345 000 грн" only the last group counts.
@R.query(PRICED + "select l_orderkey, l_linenumber, case when l_orderkey % 5 = 3 then '' when l_orderkey % 5 = 4 and c > 999 then '000 грн' else text end as found from t")
def price_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price inside a rendered text that starts with a size."""
    t = _written(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", money.price_in_text(F.concat(F.lit("Size 18\nNow "), F.col("text"), F.lit(" in stock"))).alias("found"))


@R.query("with o as (select l_partkey, count(distinct l_suppkey) as stores, min(l_extendedprice / " + RATE.replace("{c}", _sql_code("l_suppkey")) + ") as least_usd, max(l_extendedprice / " + RATE.replace("{c}", _sql_code("l_suppkey")) + ") as most_usd from lineitem group by l_partkey) select * from o")
def offer_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's range of prices over all stores, in dollars."""
    usd = money.unrounded_usd(F.col("l_extendedprice"), _code("l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("stores"), F.min(usd).alias("least_usd"), F.max(usd).alias("most_usd"))


@R.query("select row_number() over (order by pos) - 1 as pos, o_orderkey from (select unnest([5, 3, 99999999, 1]) as o_orderkey, generate_subscripts([5, 3, 99999999, 1], 1) as pos) semi join orders using (o_orderkey)")
def showcase_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured list of ids, in its order, without unknown ones."""
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, [5, 3, 99999999, 1]))).alias("place", "o_orderkey"))
    known = ids.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    listed = known.agg(F.sort_array(F.collect_list(F.struct("place", "o_orderkey"))).alias("l"))
    return listed.select(F.posexplode("l").alias("p", "x")).select(F.col("p").cast("long").alias("pos"), F.col("x.o_orderkey").cast("int").alias("o_orderkey"))


@R.query("(select o_orderkey, 0 as source from orders where o_orderkey in (7, 8)) union all (select o_orderkey, 1 from orders where o_orderkey not in (7, 8) order by o_orderkey limit 3)")
def top_up_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured orders, topped up to five with the first unused ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return catalogue.top_up(orders.filter("o_orderkey in (7, 8)"), orders, "o_orderkey", "o_orderkey", 5).select("o_orderkey", "source")


@R.query("select l_orderkey, string_agg(l_linenumber || ':' || case when l_partkey % 10 = 0 then l_partkey + 1 else l_partkey end, ',' order by l_linenumber, l_partkey, l_suppkey) as items from lineitem group by l_orderkey")
def repoint_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to merged parts moved to the part that was kept."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))
    moves = table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("gone"), (F.col("p_partkey") + 1).alias("kept"))
    found = catalogue.repointed(lines, "items", "l_partkey", moves, "gone", "kept")
    return found.select("l_orderkey", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"].cast("string"), i["l_partkey"].cast("string"))), ",").alias("items"))


@R.query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_suppkey = 3)")
def order_contains_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose nested array contains an entry with a given value."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey")).alias("offers"))
    return lines.filter(F.exists("offers", lambda o: o["l_suppkey"] == 3)).select(F.col("l_orderkey").alias("o_orderkey"))


@R.query("select o_orderkey, o_orderdate > timestamp '1998-06-01' - interval 7 day and o_orderdate <= timestamp '1998-06-01' as is_new from orders")
def order_is_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag that holds for seven days, against a pinned clock."""
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", ((day > F.lit("1998-05-25").cast("timestamp_ntz")) & (day <= now)).alias("is_new"))
