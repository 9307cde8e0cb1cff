"""Work dealt to all cores, whatever the files are like."""

from pyspark.sql import functions as F

from tessera.functions import colour, photos
from tessera.operators import catalogue, duplicates, records
from tessera.plans import gallery as gallery_plans
from tessera.plans import links, orders
from tessera.plans.colours import _labelled
from tessera.sources.tables import TASKS_PER_CORE

DATA = "/root/testdata/sf0.001"


def test_rows_of_one_row_group_are_dealt(spark):
    sizes = _labelled(spark, DATA).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert sizes.max() <= 2 * sizes.mean() + 1


def test_phrases_are_read_as_listed(spark):
    told = spark.range(1).select(colour.colour_words(F.lit("Dusty rose gold §5 black")).alias("c")).first()
    assert told.c == ["pink", "black"]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_are_taken_apart_once(spark):
    df = spark.range(1).select(photos.distinct_photos(F.array(F.col("id").cast("string"))).alias("p"))
    assert _plan(df).count("_grande") + _plan(df).count("grande|") <= 3


def test_colours_of_words(spark):
    words = ["offwhite", "black90", "ab", "чёрная", "jacket", "аллея", "rosegold2", "blackish", ""]
    told = spark.createDataFrame([(w,) for w in words], "w string").select("w", colour.names_colour(F.col("w")).alias("yes"), (F.size(colour.colour_words(F.col("w"))) > 0).alias("want")).collect()
    assert all(r.yes == r.want for r in told) and {r.w for r in told if r.yes} >= {"offwhite", "black90", "чёрная"}


def test_names_are_read_before_pairs(spark):
    above = _plan(links.same_model_names(spark, DATA)).split("Join ")[0]
    assert "regexp_replace" not in above


def _priced(spark):
    prices = [1.0, 1.0, 2.0, 3.0, 3.0, 3.0, 5.0, 8.0, 9.0, 50.0, 51.0, 400.0]
    return spark.createDataFrame([(g, g * 100 + n, p + 0.1 * (g * n % 3)) for g in range(12) for n, p in enumerate(prices[g % 4 :])], "g int, id int, price double")


def _paired(rows):
    a, b = (rows.select("g", F.col("id").alias(s), F.col("price").alias(f"price_{s}")) for s in "ab")
    return a.join(b, "g").filter("a <> b")


def _told(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_mutual_best_without_pairs(spark):
    rows = _priced(spark)
    pairs = _paired(rows).withColumn("score", F.least("price_a", "price_b") / F.greatest("price_a", "price_b")).filter("score >= 0.25")
    want, found = catalogue.mutual_best(pairs, "a", "b", "score"), catalogue.mutual_nearest(rows, ["g"], "price", "id", 4.0)
    assert _told(found, "a", "b") == _told(want, "a", "b") != set()
    assert "Join" not in _plan(found).split("\n")[-1] and "a <> b" not in _plan(found)


def test_nearest_without_pairs(spark):
    rows = _priced(spark)
    want = records.best_match(_paired(rows), "a", [F.abs(F.col("price_a") - F.col("price_b")), F.col("b")])
    assert _told(records.nearest_by(rows, ["g"], "price", "id").filter("nearest is not null"), "id", "nearest") == _told(want, "a", "b")


def test_copies_are_judged_as_classes(spark):
    names = ["Nike Air Max 90"] * 400 + ["Nike Air Max 90 Sneakers"] * 400 + ["Nike ab"] * 2
    pieces = spark.createDataFrame([(n, "g", "Nike", name, None) for n, name in enumerate(names)], "id int, gid string, brand string, name string, category string")
    found = {r.id: r.family for r in duplicates.model_families(pieces, "gid").collect()}
    assert {found[n] for n in range(800)} == {0} and (found[800], found[801]) == (800, 801)
    coloured = pieces.limit(2).withColumn("colours", F.array(F.lit("Black"))).withColumn("url", F.lit("https://x.com/a"))
    classes, members = records.classed(coloured, "id", ["brand", "name", "colours"])
    assert classes.count() == 1 and members.count() == 2


def test_page_numbers_name_no_photo(spark, tmp_path):
    spark.createDataFrame([(200009, "https://a.example.com/en/200009?x=1", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    shown = gallery_plans.page_harvest(spark, str(tmp_path)).first()
    assert "a-very-long-other-name" not in shown.photos and shown.n_photos == 2


def test_prices_are_read_by_compiled_code(spark):
    """HotSpot leaves methods above 8,000 bytes to its interpreter."""
    key = "spark.sql.adaptive.enabled"
    spark.conf.set(key, "false")
    try:
        plan = orders.price_parse(spark, DATA)._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        sizes = [code.apply(n)._3().maxMethodCodeSize() for n in range(code.size())]
    finally:
        spark.conf.unset(key)
    assert sizes and max(sizes) < 8000
