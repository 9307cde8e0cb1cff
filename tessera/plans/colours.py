"""Queries on colours in labels, over labels made from `part`.

Labels join words of all tiers, phrases and declined words in turn. The SQL
replaces phrases one after the other and joins what is left with a table of
words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, colour
from ..sources.tables import dealt
from .garments import _quoted, _values
from .registry import Registry

R = Registry()

#: Spellings of phrases and declined words, and words that name no colour.
SAMPLES = [
    "rose gold", "off-white", "navyblue", "Sky Blue", "stone grey", "burnt sienna", "brick red", "тёмно-синий", "слоновая кость", "морской волны", "чёрная", "серые",
    "бельё", "алый", "аллея", "джинсовая", "меланж", "зелёное", "коричневый", "camo", "Island", "jacket", "501", "of", "blue2", "gunmetal", "dusty rose", "mint green",
]
WORDS = [w for tier in (colour.STRONG, colour.FIELD, colour.YARNS) for words in tier.values() for w in words] + SAMPLES
JOINED = [" ", "/", " and ", "-", ", ", " и "]
_WORDS_SQL = "[" + ", ".join(map(_quoted, WORDS)) + "]"
_JOINED_SQL = "[" + ", ".join(map(_quoted, JOINED)) + "]"
LABELS_SQL = f"select p_partkey as id, split_part(p_name, ' ', 1) || ' ' || (select {_WORDS_SQL})[1 + (p_partkey * 7 + p_size) % {len(WORDS)}] || (select {_JOINED_SQL})[1 + p_size % {len(JOINED)}] || (select {_WORDS_SQL})[1 + (p_partkey * 11 + length(p_type)) % {len(WORDS)}] as label from part"


def _label() -> Column:
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.expr(n) % len(values)).cast("int"))
    return F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "), pick(WORDS, "p_partkey * 7 + p_size"), pick(JOINED, "p_size"), pick(WORDS, "p_partkey * 11 + length(p_type)"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "part").select("p_partkey", _label().alias("label"))


TIERS_SQL = _values([(w, base, rank) for rank, tier in enumerate((colour.STRONG, colour.FIELD, colour.YARNS)) for base, words in tier.items() for w in words])


def _stems(column: str, what: int) -> str:
    shown = lambda base, rank: _quoted(base) if what == 0 else str(rank)
    return "case " + " ".join(f"when regexp_matches({column}, '^(?:{p})') then {shown(base, rank)}" for rank, stems in enumerate((colour.STEMS, colour.FIELD_STEMS, colour.YARN_STEMS)) for p, base in stems) + " end"


def read(labels: str) -> str:
    """CTEs from labels (id, label) to hits (id, place, base, rank)."""
    text = "lower(label)"
    for pattern, base in colour.PHRASES:
        text = f"regexp_replace({text}, '{pattern}', ' §{base} ', 'g')"
    return f"""labels as ({labels}), tiers(word, base, rank) as {TIERS_SQL},
pieces as (select id, unnest(p) as piece, generate_subscripts(p, 1) as place from (select id, regexp_extract_all({text}, '§?\\p{{L}}+') as p from labels)),
hits as (select * from (select id, place, case when starts_with(piece, '§') then piece[2:] else coalesce(tiers.base, {_stems('piece', 0)}) end as base,
  case when starts_with(piece, '§') then 0 else coalesce(tiers.rank, {_stems('piece', 1)}) end as rank from pieces left join tiers on tiers.word = piece where length(piece) >= 3) where base is not null)"""


NAMED = "select id, string_agg(base, ' ' order by place) filter (where rank = 0) as words, arg_max(base, (-rank, place)) as canonical from hits group by id"


def _map(pairs: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


TWICE = f"select 2 * id + last as id, case when last = 1 then string_split(label, ' ')[-1] else label end as label from ({LABELS_SQL}), (values (0), (1)) as twice(last)"


def _swatch(t: str) -> str:
    return f"coalesce({_map(colour.NAMED_HEX)}[trim(lower({t}.label))], {_map(colour.HEX)}[{t}.canonical], '{colour.UNKNOWN_HEX}')"



@R.query(
    f"with {read(TWICE)}, named as (select labels.id, label, words, canonical from labels left join ({NAMED}) using (id)) "
    + f"select a.id // 2 as p_partkey, coalesce(a.words, '') as colour_words, a.canonical, {_swatch('a')} as hex, {_swatch('b')} as last_hex from named a join named b on b.id = a.id + 1 where a.id % 2 = 0"
)
def part_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour words, the canonical colour and its swatch, and that of the
    label's last word."""
    label = F.col("label")
    return _labelled(spark, sf_dir).select(
        "p_partkey",
        F.array_join(colour.colour_words(label), " ").alias("colour_words"),
        colour.canonical(label, True).alias("canonical"),
        colour.to_hex(label).alias("hex"),
        colour.to_hex(F.substring_index("label", " ", -1)).alias("last_hex"),
    )


PARTED = f"select id * 100 + n as id, part as label from (select id, unnest(p) as part, generate_subscripts(p, 1) as n from (select id, regexp_split_to_array(label, '(?i)[/,&+·|]|\\band\\b|\\sи\\s') as p from ({LABELS_SQL})))"
GROUPED = f"""with {read(PARTED)}, named as (select id // 100 as id, id as part, arg_max(base, (-rank, place)) as base from hits where rank = 0 group by hits.id),
firsts as (select id, base, min(part) as part from named group by id, base),
groups as (select id, string_agg(upper(base[1:1]) || base[2:], ' ' order by part) || case when count(*) > 1 then ' Multicolor' else '' end as names from firsts group by id)"""


@R.query(GROUPED + " select p_partkey, coalesce(names, '') as colour_groups from part left join groups on id = p_partkey")
def part_colour_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter groups of a label: one for each part's colour."""
    return _labelled(spark, sf_dir).select("p_partkey", F.array_join(colour.group_names(F.col("label")), " ").alias("colour_groups"))


FIELD_GROUPED = GROUPED.replace("from hits where rank = 0", "from hits")


@R.query(
    FIELD_GROUPED
    + f", whole as ({LABELS_SQL}) select whole.id as p_partkey, coalesce(names, '') || case when regexp_matches(label, '{colour.SEVERAL}') and coalesce(names not like '% Multicolor', true) then case when names is null then 'Multicolor' else ' Multicolor' end else '' end as field_groups, "
    + """'"' || trim(label) || '" is not a colour name' as reason from whole left join groups on groups.id = whole.id"""
)
def part_field_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of a label in a colour field, where "camo" says several, and
    why it would be refused."""
    label = F.col("label")
    return _labelled(spark, sf_dir).select("p_partkey", F.array_join(colour.group_names(label, True), " ").alias("field_groups"), colour.why_not(label, codes.is_size(label)).alias("reason"))


@R.query(
    GROUPED
    + f", whole as ({LABELS_SQL}) select whole.id as p_partkey, (contains(names, 'Black') or regexp_matches(label, '{colour.DARK_WORDS}')) and not regexp_matches(names, 'White|Beige|Yellow|Pink|Orange') as dark from whole join groups on groups.id = whole.id"
)
def part_dark_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a label with a colour is dark."""
    # Exploded as an array of one, groups are worked out once, and behind the deal.
    grouped = _labelled(spark, sf_dir).select("p_partkey", "label", F.explode(F.array(colour.group_names(F.col("label")))).alias("groups"))
    return grouped.filter(F.size("groups") > 0).select("p_partkey", colour.is_dark(F.array("label"), F.col("groups")).alias("dark"))


# Two labels of each part: one as above, one of two words of its own, or none.
_TWO = f"select 2 * p_partkey as id, case when p_size % 11 = 0 then '' else label end as label from ({LABELS_SQL}) join part on p_partkey = id union all select 2 * p_partkey + 1, case when p_size % 7 = 0 then '' when p_size % 4 = 0 then upper(split_part(p_name, ' ', 1)) else (select {_WORDS_SQL})[1 + (p_partkey * 7 + p_size) % {len(WORDS)}] || '  ' || split_part(p_name, ' ', 1) end from part"


@R.query(
    f"with {read(_TWO)}, told as (select labels.id, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) as t, list_distinct(list(base) filter (where rank = 0 and base is not null)) as s, arg_max(base, (-rank, place)) as c from labels left join hits using (id) group by labels.id, label), "
    + "both_ as (select a.id // 2 as p_partkey, a.t as x, b.t as y, coalesce(a.s, []) as sx, coalesce(b.s, []) as sy, a.c as cx, b.c as cy from told a join told b on b.id = a.id + 1 where a.id % 2 = 0) "
    + "select p_partkey, case when x = '' and y = '' then 'none' when x = '' or y = '' then 'unknown' when x = y then 'same' when len(sx) > 0 and len(sy) > 0 then case when not (list_has_all(sx, sy) or list_has_all(sy, sx)) then 'different' when len(sx) = len(sy) then 'near' else 'partial' end when cx = cy then 'near' else 'different' end as relation from both_"
)
def colour_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two labels of a part relate."""
    pick = F.get(F.array(*map(F.lit, WORDS)), (F.expr("p_partkey * 7 + p_size") % len(WORDS)).cast("int"))
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    one = F.when(F.col("p_size") % 11 == 0, "").otherwise(_label())
    other = F.when(F.col("p_size") % 7 == 0, "").when(F.col("p_size") % 4 == 0, F.upper(word)).otherwise(F.concat(pick, F.lit("  "), word))
    return dealt(spark, sf_dir, "part").select("p_partkey", one.alias("a"), other.alias("b")).select("p_partkey", colour.relation(F.col("a"), F.col("b")).alias("relation"))
