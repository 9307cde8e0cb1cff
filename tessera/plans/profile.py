"""Queries on a catalogue's habits, over labels made from `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, kinds, styles
from ..operators import profile
from ..sources.tables import dealt
from .garments import _quoted, spotted, term_rows
from .markup import STYLED
from .registry import Registry

R = Registry()

# Labels: brands keep to two styles of their own, most of the time; a fifth of the
# parts have none; every seventh brand's parts have none at all. Names hold one
# term; every third store is a shop within another.
BRAND_NO = "cast(substring(p_brand, 7) as int)"
SAID = [t.replace("!", "") for _, t in STYLED]
DETAILS = {
    "one": f"({BRAND_NO} + case when p_partkey % 4 = 0 then p_size else 0 end) % 13",
    "other": f"({BRAND_NO} * 5 + p_size % 3) % 13",
    "term": f"(p_partkey * 3 + p_size) % {len(SAID)}",
    "labelled": f"p_partkey % 5 <> 0 and {BRAND_NO} % 7 <> 0",
    "shop": "p_size % 9",
    "gender": f"case when p_partkey % 6 = 0 then null when ({BRAND_NO} + p_size % 2) % 5 < 2 then 'women' when {BRAND_NO} % 3 = 0 then 'men' else 'unisex' end",
    "shade": "case p_partkey % 5 when 0 then 'Black' when 1 then 'charcoal' when 2 then 'White/Black' else p_name end",
}


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dealt(spark, sf_dir, "part")
    d = {k: F.expr(v) for k, v in DETAILS.items()}
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    shop = F.when(d["shop"] % 3 == 0, F.concat(F.lit("kids.shop"), (d["shop"] / 3).cast("int").cast("string"))).otherwise(F.concat(F.lit("shop"), (d["shop"] % 3).cast("string")))
    shade = d["shade"]
    return p.select(
        "p_partkey", F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", of(SAID, d["term"])).alias("name"), F.lit("").alias("description"), F.concat(F.lit("https://www."), shop, F.lit(".com/p")).alias("url"),
        F.when(d["labelled"], F.array(of(kinds.STYLES, d["one"]), of(kinds.STYLES, d["other"]), F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("styles"),
        d["gender"].alias("gender"), F.array(shade).alias("colours"), colour.group_names(shade).alias("groups"),
    )


_STYLES = "([" + ", ".join(map(_quoted, kinds.STYLES)) + "])"
_TERMS = "([" + ", ".join(map(_quoted, SAID)) + "])"
# Colours here are few, so that groups can be told by the words.
LABELLED = f"""named as (select *, {", ".join(f"{v} as {k}" for k, v in DETAILS.items() if k != "term")}, p_name || ' ' || {_TERMS}[1 + {DETAILS["term"]}] as name, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as brand from part),
labelled as (select *, case when shop % 3 = 0 then 'kids.shop' || (shop // 3) else 'shop' || (shop % 3) end || '.com' as store,
  case when labelled then list_distinct([{_STYLES}[1 + one], {_STYLES}[1 + other]]) else [] end as styles,
  case when regexp_matches(lower(shade), '\\bwhite\\b') then false else regexp_matches(lower(shade), '\\b(black|charcoal)\\b') end as dark from named)"""
TALLIED = """marked as (select level, key, unnest(vals || [null]) as v from {rows}), tallies as (select level, key, count(*) filter (where v is null) as n, v from marked group by level, key, v),
sizes as (select level, key, n from tallies where v is null), counts as (select level, key, v, c from (select level, key, v, count(*) as c from marked where v is not null group by all))"""
STYLE_ROWS = "(select 'brand' as level, brand as key, styles as vals from labelled where len(styles) > 0 union all select 'store', store, styles from labelled where len(styles) > 0 union all select 'all', '*', styles from labelled where len(styles) > 0)"


@R.query(f"with {LABELLED}, {TALLIED.format(rows=STYLE_ROWS)} select level, key, n, (select string_agg(v || '=' || c, ',' order by v) from counts where counts.level = sizes.level and counts.key = sizes.key) as counts from sizes")
def catalogue_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and styles of each brand, each store and all, in one pass."""
    rows = _labelled(spark, sf_dir).select(profile.brand_key(F.col("brand")).alias("brand"), F.regexp_extract("url", r"www\.([^/]*)", 1).alias("store"), kinds.normal_styles(F.col("styles")).alias("styles"))
    found = profile.tallies(rows.filter(F.size("styles") > 0), "styles", ["brand", "store"])
    return found.select("level", "key", "n", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


WORDS = f"""{spotted("select p_partkey as id, name as title from labelled", term_rows(STYLED))}, words as (select distinct id, {_STYLES}[1 + rank] as style from hits)"""
PROPOSED = f"""with {LABELLED}, {TALLIED.format(rows=STYLE_ROWS)}, {WORDS},
agreement as (select style, count(*) as tagged, count(*) filter (where list_contains(styles, style)) as ok from words join labelled on p_partkey = id where len(styles) > 0 group by style),
dark_brands as (select key from sizes left join counts using (level, key) where level = 'brand' and v = 'dark' and c >= 0.2 * n),
tones as (select count(*) as tagged, count(*) filter (where list_contains(styles, 'dark')) as ok, count(*) filter (where brand in (from dark_brands)) as b_tagged, count(*) filter (where brand in (from dark_brands) and list_contains(styles, 'dark')) as b_ok from labelled where len(styles) > 0 and dark),
placed as (select l.*, coalesce(bn.n, 0) >= 3 as known, case when sn.key is not null then store else regexp_replace(store, '^[^.]*\\.', '') end as store_key from labelled l left join sizes bn on bn.level = 'brand' and bn.key = l.brand left join sizes sn on sn.level = 'store' and sn.key = l.store),
offers as (
  select p_partkey, v as style, c / n as share from placed join sizes on level = 'brand' and key = brand join counts using (level, key) where known and c / n >= 0.6
  union all select p_partkey, v, c / n from placed join sizes on level = 'store' and key = store_key join counts using (level, key) where not known and n >= 5 and c / n >= 0.6
  union all select id, style, ok / tagged from words join agreement using (style) where tagged >= 5 and ok >= 0.7 * tagged
  union all select p_partkey, 'dark', case when tagged >= 5 and ok >= 0.7 * tagged then ok / tagged else b_ok / b_tagged end from placed, tones where dark and ((tagged >= 5 and ok >= 0.7 * tagged) or (b_tagged >= 5 and b_ok >= 0.7 * b_tagged and brand in (from dark_brands)))),
best as (select p_partkey, style, max(share) as share, list_position({_STYLES}, style) as place from offers group by all),
kept as (select *, row_number() over (partition by p_partkey order by share desc, place) as r from best)
select part.p_partkey, coalesce(string_agg(style, ',' order by place) filter (where r <= 3), '') as styles, coalesce(max(share), 0) as surest from part left join kept using (p_partkey) group by part.p_partkey"""


@R.query(PROPOSED)
def profile_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles that a catalogue's habits, a page's words and its tone propose."""
    rows = _labelled(spark, sf_dir)
    pieces = rows.withColumn("words", styles.inferred_styles(F.concat_ws(" ", "name", "description"), len(kinds.STYLES)))
    found = profile.proposed_styles(pieces, profile.built(rows), "p_partkey")
    return found.select("p_partkey", F.array_join("styles", ",").alias("styles"), F.coalesce(F.array_max("confidences"), F.lit(0.0)).alias("surest"))


GENDER_ROWS = "(select 'brand' as level, brand as key, [gender] as vals from labelled where gender is not null union all select 'store', store, [gender] from labelled where gender is not null)"


@R.query(
    f"with {LABELLED}, {TALLIED.format(rows=GENDER_ROWS)}, sure as (select level, key, arg_max(v, (c, v)) as gender from sizes join counts using (level, key) where c >= 0.8 * n and n >= case when level = 'brand' then 3 else 5 end group by level, key), "
    + "placed as (select l.*, case when exists (select 1 from sizes where level = 'store' and key = store) then store else regexp_replace(store, '^[^.]*\\.', '') end as store_key from labelled l) "
    + "select p_partkey, coalesce(case when p_size = 7 then 'men' end, b.gender, s.gender) as gender, case when p_size = 7 then 'store-setting' when b.gender is not null then 'brand' when s.gender is not null then 'store' end as source "
    + "from placed left join sure b on b.level = 'brand' and b.key = brand left join sure s on s.level = 'store' and s.key = store_key"
)
def profile_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genders of silent pages by setting, brand or store."""
    rows = _labelled(spark, sf_dir)
    pieces = rows.join(dealt(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") == 7, "men").alias("setting")), "p_partkey")
    return profile.proposed_genders(pieces, profile.built(rows), "p_partkey")
