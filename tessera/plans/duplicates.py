"""Queries on cards of one piece and models of a group, over names from `part`.

Names are put together from lists by keys, so that the SQL can tell what names a
piece by the numbers that chose its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates
from ..sources.tables import dealt
from .garments import _quoted, _values
from .registry import Registry

R = Registry()

BRANDS = ["Arlo", "Bexley", "Corvane", "Dunmore", "Estrella"]
MODELS = ["Nuvolari", "Quartzite", "Halcyon", "Meridian", "Zephyrus", "Obelisks", "Wanderer"]
SECOND = ["Trek", "Nine", "Bay", "Rove"]
GARMENTS = ["Jacket", "Hoodie", "Dress"]
COLOURS = ["", "Black", "Core Black", "Navy", "Black / White"]
# How two colour labels relate; all others are different.
RELATED = _values([(0, 0, "none"), *((k, k, "same") for k in range(1, 5)), *((0, k, "unknown") for k in range(1, 5)), (1, 2, "near"), (1, 4, "partial"), (2, 4, "partial")])
CHOSEN = {
    "b": "p_partkey % 5", "m": "(p_partkey // 5 + p_size) % 7", "w": "(p_partkey // 35) % 4", "g": "p_size % 3",
    "c": "(p_partkey // 3 + p_size) % 5", "s": "(p_partkey // 7 + p_size * 3) % 6", "price": "p_retailprice * case when p_partkey % 11 = 0 then 6 else 1 end",
}
NUMBERED = "n as (select p_partkey as id, " + ", ".join(f"{v} as {k}" for k, v in CHOSEN.items()) + " from part)"


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = {k: F.expr(v.replace("//", "div")) for k, v in CHOSEN.items()}
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), F.col(k).cast("int"))
    p = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(c.alias(k) for k, c in numbers.items()))
    store = F.concat(F.lit("shop"), F.col("s").cast("string"), F.lit(".com"))
    return p.select(
        "id", of(BRANDS, "b").alias("brand"), F.concat_ws(" ", of(BRANDS, "b"), of(MODELS, "m"), of(SECOND, "w"), of(GARMENTS, "g")).alias("name"),
        F.filter(F.split(of(COLOURS, "c"), " / "), lambda c: c != "").alias("colours"), "price", F.array(store).alias("stores"), store.alias("store"),
        F.concat_ws("-", of(BRANDS, "b"), (F.col("id") % 3).cast("string")).alias("gid"), F.lit(None).cast("string").alias("category"),
    )


@R.query(
    f"""with {NUMBERED}, related(x, y, r) as {RELATED},
pairs as (select a.id as a, a.c = 0 as bare, b.id as b, b.s as store, coalesce(r, 'different') as r from n a join n b on a.b = b.b and a.m = b.m and a.w = b.w and a.s <> b.s and greatest(a.price, b.price) <= 4 * least(a.price, b.price)
  left join related on x = least(a.c, b.c) and y = greatest(a.c, b.c)),
slots as (select a, bare, store, count(*) as n, min(b) as any_b, list(b order by b) filter (where r = 'same') as e, list(b order by b) filter (where r = 'near') as ne, list(b order by b) filter (where r = 'partial') as pa, count(*) filter (where r in ('unknown', 'none')) as u from pairs group by all),
picks as (select distinct a, case when pick is not null then case when len(pick) = 1 then pick[1] end when n = 1 and (bare or u = 1) then any_b end as b from (select *, coalesce(e, ne, pa) as pick from slots))
select x.a, x.b from picks x join picks y on x.a = y.b and x.b = y.a where x.a < x.b"""
)
def name_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of one piece at two stores that pick each other, by the names of
    all cards under one maker and model word."""
    return duplicates.name_links(_cards(spark, sf_dir))


@R.query(
    f"""with recursive {NUMBERED}, g as (select *, b::varchar || '-' || (id % 3) as gid from n), nodes as (select gid, m, w, g, min(id) as least from g group by all),
links as (select x.gid, x.m, x.w, x.g, y.w as w2, y.g as g2 from nodes x join nodes y on x.gid = y.gid and x.m = y.m and (x.w = y.w or not (x.g > 0 and y.g > 0 and x.g <> y.g))),
reach as (select gid, m, w, g, least from nodes union select l.gid, l.m, l.w2, l.g2, r.least from reach r join links l on l.gid = r.gid and l.m = r.m and l.w = r.w and l.g = r.g)
select id, family from g join (select gid, m, w, g, min(least) as family from reach group by all) using (gid, m, w, g)"""
)
def group_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models within each group, as the least card of each."""
    return duplicates.model_families(_cards(spark, sf_dir), "gid").select("id", "family")
