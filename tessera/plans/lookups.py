"""Scans, lookups, settings, trees and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, kinds
from ..operators import catalogue, sinks
from ..sources.tables import dealt, table
from .records import _case, _sql_case
from .registry import Registry

R = Registry()


@R.query("select o_orderkey, o_orderdate::date::varchar as day from orders")
def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a whole table, the newest rows first."""
    ordered = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return ordered.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@R.query("select p_partkey, p_name, (select string_agg(b.p_partkey::varchar, ',' order by b.p_partkey) from part b where b.p_brand = part.p_brand and b.p_name = part.p_name) as swatches from part where p_partkey = 5")
def product_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by key with its variants."""
    p = table(spark, sf_dir, "part")
    one = p.filter("p_partkey = 5").select("p_partkey", "p_name", "p_brand")
    wanted = one.select("p_brand", "p_name", F.col("p_partkey").alias("wanted"))
    others = p.join(wanted, ["p_brand", "p_name"]).groupBy("wanted").agg(F.sort_array(F.collect_list("p_partkey")).alias("s"))
    swatches = F.array_join(F.col("s").cast("array<string>"), ",").alias("swatches")
    return one.join(others, F.col("p_partkey") == F.col("wanted")).select("p_partkey", "p_name", swatches)


@R.query("select p_partkey, p_name from part where p_type = 'PROMO'")
def products_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_type") == "PROMO").select("p_partkey", "p_name")


@R.query("select event_id, case event_id % 3 when 2 then 0 else 1 + (event_id % 2) end::int as n_ids, case event_id % 3 when 0 then event_type when 1 then user_id::varchar end as first_id from events")
def settings_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ids in JSON settings; an older name of the key counts where
    the newer is absent, malformed text is empty."""
    listed = lambda c: F.to_json(F.when(F.col("event_id") % 2 == 0, F.array(c)).otherwise(F.array(c, F.lit("z"))))
    newer = F.concat(F.lit('{"extraStores":'), listed(F.col("event_type")), F.lit(',"stores":["x"]}'))
    older = F.concat(F.lit('{"stores":'), listed(F.col("user_id").cast("string")), F.lit("}"))
    body = F.when(F.col("event_id") % 3 == 0, newer).when(F.col("event_id") % 3 == 1, older).otherwise("{bad")
    s = F.from_json(body, "extraStores array<string>, stores array<string>")
    ids = F.coalesce(s["extraStores"], s["stores"], F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", F.size(ids).alias("n_ids"), F.try_element_at(ids, F.lit(1)).alias("first_id"))


@R.query("select p_brand, count(*) as n from part where p_name like 'red %' or p_name like 'blue %' group by p_brand")
def colour_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour names joined to a small dimension of groups."""
    groups = spark.createDataFrame([(k, n.capitalize()) for k, n in enumerate(colour.HEX)], "group_id int, name string")
    names = dealt(spark, sf_dir, "part").select("p_brand", F.explode(colour.group_names(F.col("p_name"))).alias("name"))
    return names.join(F.broadcast(groups), "name").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@R.query("select r_regionkey, string_agg(lower(n_name) || '=' || n_nationkey, ',' order by lower(n_name)) as logos from nation join region on n_regionkey = r_regionkey group by r_regionkey")
def name_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map from folded names to values, for each group."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    maps = n.groupBy("r_regionkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.lower("n_name"), F.col("n_nationkey").cast("string"))))).alias("m"))
    return maps.select("r_regionkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("logos"))


TREE = [("Tops", "Polo Shirts", "tops"), ("Tops", "T-Shirts", "tops"), ("Shoes", "Boots & Heels", "footwear"), ("Shoes", "Sneakers", "footwear"), ("Bags", "Bags", "bags"), ("Home", "Small Rings", "home"), ("Home", "Widgets", "home"), ("Home", "Hot Gears & Bolts", "home")]
TITLED = ["polo shirt", "heel", "t shirts", "two bags", "hat", "sneaker", "boots", "shirt polo"]
_TITLE_SQL = "lower(p_name || ' ' || (select [" + ", ".join(f"'{t}'" for t in TITLED) + f"])[1 + p_partkey % {len(TITLED)}] || ' ' || (select [" + ", ".join(f"'{t}'" for t in TITLED) + f"])[1 + p_size % {len(TITLED)}])"
# A word and its singular spellings.
_FORMS = "list_distinct(list_filter([{0}, case when {0} like '%ies' and length({0}) > 4 then {0}[:-4] || 'y' end, case when {0} like '%es' and length({0}) > 3 then {0}[:-3] end, case when {0} like '%s' and {0} not like '%ss' and length({0}) > 3 then {0}[:-2] end], lambda f: f is not null))"


@R.query(
    "with t(grp, label) as (values " + ", ".join(f"('{g}', '{n}')" for g, n, _ in TREE) + "), halves as (select grp, label, unnest(string_split(label, ' & ')) as half from t), "
    + f"l as (select *, list_transform(list_filter(regexp_split_to_array(lower(half), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: {_FORMS.format('x')}) as forms from halves), "
    + f"p as (select p_partkey, flatten(list_transform(regexp_split_to_array({_TITLE_SQL}, '[^a-z0-9]+'), lambda x: {_FORMS.format('x')})) as own from part), "
    + "hits as (select p_partkey, label, grp, len(forms) as n, length(half) as size from p join l on len(list_filter(forms, lambda f: not list_has_any(f, own))) = 0), "
    + "best as (select p_partkey, arg_max(label, (n, size, label)) as label, arg_max(grp, (n, size, label)) as grp from hits group by p_partkey) select part.p_partkey, label, grp from part left join best using (p_partkey)"
)
def subcategory_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a tree whose words, in any number, stand in a title; the
    one with most words; either half of an "A & B" label will do. Titles and
    labels meet on a word, not each with each."""
    forms = lambda words: F.flatten(F.transform(words, kinds.word_forms))
    labels = spark.createDataFrame(TREE, "grp string, label string, bucket string").withColumn("half", F.explode(F.split("label", " & ")))
    labels = labels.withColumn("words", F.filter(F.split(F.lower("half"), "[^a-z0-9]+"), lambda w: w != "")).withColumn("word", F.explode(F.array_distinct(forms(F.slice("words", 1, 1)))))
    pick = lambda n: F.get(F.array(*map(F.lit, TITLED)), (F.expr(n) % len(TITLED)).cast("int"))
    title = F.concat_ws(" ", "p_name", pick("p_partkey"), pick("p_size"))
    titles = dealt(spark, sf_dir, "part").select("p_partkey", F.split(F.lower(title), "[^a-z0-9]+").alias("own")).withColumn("own", F.array_distinct(forms(F.col("own"))))
    hits = titles.withColumn("word", F.explode("own")).join(F.broadcast(labels), "word")
    full = hits.filter(F.forall("words", lambda w: F.arrays_overlap(kinds.word_forms(w), F.col("own"))))
    best = full.groupBy("p_partkey").agg(F.max_by(F.struct("label", "grp"), F.struct(F.size("words"), F.length("half"), "label")).alias("b"))
    return titles.select("p_partkey").join(best, "p_partkey", "left").select("p_partkey", "b.label", "b.grp")


@R.query("with t as (select distinct p_type as grp, p_brand || '/' || p_size as bucket, p_name as label from part), n as (select bucket, grp, count(*) as n_labels, min(label) as least from t group by all) select bucket, grp, n_labels, case when n_labels = 1 then least end as single_label from n")
def tree_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree's buckets with their groups and labels; a bucket's only label
    stands for it."""
    t = table(spark, sf_dir, "part").select(F.col("p_type").alias("grp"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("bucket"), F.col("p_name").alias("label")).distinct()
    return t.groupBy("bucket", "grp").agg(F.count(F.lit(1)).alias("n_labels"), F.when(F.count(F.lit(1)) == 1, F.min("label")).alias("single_label"))


@R.query("select o_orderkey, case when o_orderkey = 3 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 10 <> 9 union all select -1, 'new'")
def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag set by key, rows deleted, a row added: the new version."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    flagged = sinks.updated(orders, F.col("o_orderkey") == 3, {"o_orderstatus": F.lit("X")})
    kept = sinks.deleted(flagged, F.col("o_orderkey") % 10 == 9)
    new = orders.limit(1).select(F.lit(-1).cast(orders.schema["o_orderkey"].dataType).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"))
    return sinks.upserted(kept, new, "o_orderkey")


@R.query("select c_custkey, case when c_custkey % 2 = 0 then c_name end as c_name, coalesce(nullif(case when c_custkey % 2 = 0 then c_name end, ''), case when o_custkey is not null then 'buyer' end) as title from customer left join (select distinct o_custkey from orders) on o_custkey = c_custkey")
def title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title from the card, else from a second source, else none."""
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("other", F.lit("buyer"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"))
    return c.join(buyers, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("c_name", "other").alias("title"))


@R.query("with g as (select p_brand, p_type, count(*) as n, max(case when p_partkey % 50 = 0 then 1 else 0 end) as has_lead from part group by all), w as (select *, row_number() over (partition by p_brand order by has_lead desc, n desc, p_type) as r from g) select p_brand, p_type as winner, n from w where r = 1")
def colour_group_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group that others join: the one with the lead, else the largest."""
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("p_partkey") % 50 == 0, 1).otherwise(0)).alias("has_lead"))
    best = catalogue.top_k(g, "p_brand", [F.desc("has_lead"), F.desc("n"), F.col("p_type")], 1)
    return best.select("p_brand", F.col("p_type").alias("winner"), "n")
