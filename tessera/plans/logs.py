"""Queries over `events`, `documents` and `labels`: logs and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources import documents
from ..sources.tables import table
from ..streaming import seen
from .registry import Registry

R = Registry()


@R.query("select event_id, (props::json ->> 'k')::int as k from events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings in JSON, read with a fixed schema; malformed ones are null."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@R.query("select event_type, count(*) as n, count(*) filter (where value > 50) as over, sum(value) as total from events group by event_type")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run by outcome."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("over"), F.sum("value").alias("total"))


@R.query("select distinct user_id, ts::date::varchar as day from events where event_type = 'purchase' and (user_id, ts::date) not in (select (user_id, ts::date) from events where event_type = 'error' and user_id is not null and ts is not null)")
def event_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't in the set of those seen, by two keys."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"))
    seen_ = e.filter("event_type = 'error'").select("user_id", "day").distinct()
    return e.filter("event_type = 'purchase'").select("user_id", "day").distinct().join(seen_, ["user_id", "day"], "left_anti")


@R.query("with g as (select user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events) select user_id, count(gap) as n, min(gap) as least_gap_us from g group by user_id")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least time between a user's consecutive events: an audit of pace."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("gap", gap).groupBy("user_id").agg(F.count("gap").alias("n"), F.min("gap").alias("least_gap_us"))


@R.query("select user_id, sum(value * case event_type when 'purchase' then 2.0 else 0.5 end) as spend from events group by user_id")
def event_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage times price, summed."""
    price = F.when(F.col("event_type") == "purchase", 2.0).otherwise(0.5)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.col("value") * price).alias("spend"))


@R.query("select min(event_id) as event_id, user_id, event_type from events group by user_id, event_type")
def event_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each kind that a seen-set lets through."""
    return seen.fresh(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), None, ["user_id", "event_type"], "event_id")


@R.query("select user_id, event_type, count(*) as n from events group by user_id, event_type")
def event_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, counted by key in a run that processes what
    there is and stops."""
    return seen.counted_stream(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"])


@R.query("select lang, count(*) as tagged, sum(quality)::bigint as good, sum(quality)::double / count(*) as precision_ from documents join labels using (doc_id) group by lang")
def label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a tag agrees with the labels."""
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("tagged"), F.sum("quality").cast("long").alias("good"), (F.sum("quality") / F.count(F.lit(1))).alias("precision_"))


@R.query("with b as (select source, lang, quality, toxic from documents join labels using (doc_id)), s as (select source, sum(quality)::double / count(*) as share from b group by source) select count(*) as tagged, sum(toxic)::bigint as right_, count(*) filter (where share >= 0.7) as tagged_in_good, coalesce(sum(toxic) filter (where share >= 0.7), 0)::bigint as right_in_good from b join s using (source)")
def two_pass_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement over all rows, and within sources that a first pass rates well."""
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    share = both.groupBy("source").agg((F.sum("quality") / F.count(F.lit(1))).alias("share"))
    joined, good = both.join(share, "source"), F.col("share") >= 0.7
    return joined.agg(F.count(F.lit(1)).alias("tagged"), F.sum("toxic").cast("long").alias("right_"), F.count_if(good).alias("tagged_in_good"), F.coalesce(F.sum(F.when(good, F.col("toxic"))), F.lit(0)).cast("long").alias("right_in_good"))


@R.query(
    "with n as (select doc_id, 1 + n_chars % 99 as p, lang, source from documents) select doc_id, case doc_id % 3 when 0 then p || '% wool, ' || (100 - p) || '% polyamide' when 1 then '100% cotton' else '' end as composition, "
    + "case doc_id % 3 when 0 then lang || ' mix' when 1 then coalesce(source, 'Cotton') end as material from n"
)
def document_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fibres with their percentages, and a value out of a list of specs."""
    k, p = F.col("doc_id") % 3, 1 + F.col("n_chars") % 99
    mixed = F.concat(F.lit("20% off! "), p.cast("string"), F.lit(" % Wool, "), (100 - p).cast("string"), F.lit("% polyamide and 5% elastane"))
    said = F.when(k == 0, mixed).when(k == 1, "100% cotton 30% linen").otherwise("none")
    value = F.when(k == 0, F.concat("lang", F.lit(" mix"))).otherwise(F.coalesce("source", F.lit("Cotton")))
    specs = F.array(F.struct(F.lit("Care").alias("key"), F.lit("cold").alias("value")), F.struct(F.when(k == 2, "Weight").otherwise("Fabric:").alias("key"), value.alias("value")))
    return table(spark, sf_dir, "documents").select("doc_id", text.composition(said).alias("composition"), text.spec_value(specs, "material").alias("material"))


@R.query("select doc_id, 'piece ' || source as clean, 'piece' as base, regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g') as slug, 'R&D <' || lang || '>' as decoded from documents")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without sizes and colours, slugs, and decoded entities."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.clean_name(F.concat(F.lit("piece "), F.col("source"), F.lit(" - XL"))).alias("clean"),
        text.base_name(F.concat(F.lit("piece - "), F.col("source"))).alias("base"),
        text.slug(F.concat_ws(" ", "source", "lang")).alias("slug"),
        text.decode_entities(F.concat(F.lit("R&amp;D &lt;"), F.col("lang"), F.lit("&gt;"))).alias("decoded"),
    )


@R.query("""with d as (select doc_id, lang, n_chars % 90 + 10 as a, n_chars % 70 + 20 as b, n_chars % 130 as f, n_chars % 3 as k from documents)
select doc_id, lang as name, least(a, b)::double as price, case when f > least(a, b) then f::double end as former_price, case when k = 0 then 'a.jpg,b.jpg' else 'b.jpg,a.jpg' end as images, case when k = 1 then 'S' else 'S,M' end as sizes, k = 2 as available from d""")
def storefront_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A storefront's product JSON as a record."""
    n = F.col("n_chars")
    written = lambda v: F.concat(F.lit('"'), v.cast("string"), F.lit('.00"'))
    image = lambda name, place: F.struct(F.lit(name).alias("src"), place.cast("int").alias("position"))
    body = F.concat(
        F.lit('{"title":"'), F.col("lang"), F.lit('","vendor":"v","images":'),
        F.to_json(F.array(image("b.jpg", F.when(n % 3 == 0, 2).otherwise(1)), image("a.jpg", F.when(n % 3 == 0, 1).otherwise(2)))),
        F.lit(',"variants":[{"price":'), written(n % 90 + 10), F.lit(',"compare_at_price":'), written(n % 130), F.lit(',"option1":"S","available":false},{"price":'),
        written(n % 70 + 20), F.lit(',"compare_at_price":null,"option1":"'), F.when(n % 3 == 1, "S").otherwise("M"), F.lit('","available":'), F.when(n % 3 == 2, "true").otherwise("false"), F.lit("}]}"),
    )
    p = table(spark, sf_dir, "documents").select("doc_id", documents.storefront_product(body).alias("p"))
    return p.select("doc_id", "p.name", "p.price", "p.former_price", F.array_join("p.images", ",").alias("images"), F.array_join("p.sizes", ",").alias("sizes"), "p.available")


@R.query("select doc_id, (case when doc_id % 3 = 0 then 1 else 2 end + case when n_chars % 2 = 0 then 1 else 0 end)::int as n_pieces, case when doc_id % 3 = 0 then coalesce(source, 'b') || '-2' else doc_id::varchar end as first_id from documents")
def shared_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks in an address: base64, JSON, and only valid pieces."""
    id_, image = F.col("doc_id").cast("string"), F.lit("https://x/a.jpg")
    part = lambda key, name, photo: F.struct(key.alias("id"), name.alias("name"), photo.alias("image"))
    pieces = F.array(
        part(id_, F.lit("a"), F.when(F.col("doc_id") % 3 == 0, "ftp://x").otherwise(image)),
        part(F.concat(F.coalesce("source", F.lit("b")), F.lit("-2")), F.coalesce("lang", F.lit("?")), image),
        part(F.lit("3"), F.lit("c"), F.when(F.col("n_chars") % 2 == 0, image).otherwise("ftp://y")),
        part(F.lit(None).cast("string"), F.lit("d"), image),
    )
    encoded = F.translate(F.base64(F.encode(F.to_json(pieces), "UTF-8")), "+/", "-_")
    p = table(spark, sf_dir, "documents").select("doc_id", documents.shared_look(encoded).alias("p"))
    return p.select("doc_id", F.size("p").alias("n_pieces"), F.col("p")[0]["id"].alias("first_id"))
