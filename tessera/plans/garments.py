"""Queries on what garment a title names, over titles made from `part`.

The SQL finds terms by joining runs of words with a table of terms, which shares
nothing with the library's lookup but the dictionary.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import garments, kinds
from ..functions.garments import ATTACHED, GARMENTS, GENERIC
from ..sources.tables import dealt
from .registry import Registry

R = Registry()

TERMS = [(n, t) for n, g in enumerate(GARMENTS) for t in g.terms]
#: How titles spell the terms.
SPELLED = [re.sub("/.*/", "574", t).strip("~").replace("!", "") for _, t in TERMS]


def _quoted(value: object) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, (bool, int)) else "'" + str(value).replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + ")"


def _words(term: str) -> list[str]:
    """The words of a term, without the expression that may end it."""
    return re.sub(" /.*/", "", term).strip("~").replace("-", " ").split()


KINDS_SQL = _values([(n, g.kind, g.category, g.kind in GENERIC, "|".join(g.labels)) for n, g in enumerate(GARMENTS)])
def term_rows(listed: list[tuple[int, str]]) -> str:
    """A table of terms: (rank, term, n, strong, stem, shape, len)."""
    return _values(
        [
            (n, " ".join(_words(t)), len(_words(t)) + ("/" in t), not t.startswith("~"), bool(re.search("[а-яі]", t)), re.search("/(.*)/", t)[1] if "/" in t else None, len(re.sub("[~!/]", "", t)))
            for n, t in listed
        ]
    )


def spotted(titles: str, rows: str) -> str:
    """CTEs from titles (id, title) and a table of terms to hits (id, i, e, ...)
    and w (id, w), the words."""
    return f"""titles as ({titles}), t(rank, term, n, strong, stem, shape, len) as {rows},
w as (select id, list_filter(string_split(regexp_replace(replace(lower(coalesce(title, '')), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') as w from titles),
places as (select id, w, unnest(range(1, len(w) + 1)) as i from w),
hits as (select id, i, i + n - 1 as e, t.*, list_min(list_filter(range(1, len(w) + 1), lambda x: w[x] in ({", ".join(map(_quoted, ATTACHED))}))) as cut from places join t on case
  when shape is not null then array_to_string(w[i:i + n - 2], ' ') = term and regexp_full_match(coalesce(w[i + n - 1], ''), shape)
  when not stem then array_to_string(w[i:i + n - 1], ' ') = replace(term, '!', '') or (not contains(term, '!') and array_to_string(w[i:i + n - 1], ' ') in (term || 's', term || 'es'))
  else i + n - 1 <= len(w) and list_bool_and(list_transform(range(1, n + 1), lambda j: case when ends_with(string_split(term, ' ')[j], '!') then w[i + j - 1] || '!' = string_split(term, ' ')[j] else starts_with(w[i + j - 1], string_split(term, ' ')[j]) end)) end)"""


def matched(titles: str) -> str:
    """CTEs from titles (id, title) to named (id, kind, category, generic,
    labels, strong)."""
    return f"""{spotted(titles, term_rows(TERMS))}, k(rank, kind, category, generic, labels) as {KINDS_SQL},
pool as (select *, bool_or(stem) over (partition by id) as any_stem, bool_or(e < cut) over (partition by id) as any_front from (select *, bool_or(strong) over (partition by id) as any_strong from hits) where strong = any_strong),
heads as (select *, row_number() over (partition by id order by case when any_stem then (case when stem then i else 1000000 end) when any_front then (case when e < cut then -e else 1000000 end) else -e end, len desc, rank) as place from pool),
h as (select id, rank as head, strong from heads where place = 1),
named as (select id, k.kind, k.category, k.generic, k.labels, h.strong from h join k h_kind on h_kind.rank = h.head
  join k on k.rank = case when h_kind.generic then (select min(p.rank) from pool p join k o on o.rank = p.rank where p.id = h.id and o.category = h_kind.category) else h.head end)"""


def _term(number: str) -> str:
    return "(select [" + ", ".join(map(_quoted, SPELLED)) + f"])[1 + ({number}) % {len(SPELLED)}]"


ONE, OTHER = "p_partkey * 7 + p_size", "p_partkey * 3 + length(p_type)"
TITLES_SQL = f"select p_partkey as id, case p_size % 4 when 0 then p_name || ' ' || {_term(ONE)} when 1 then {_term(ONE)} || '-' || p_name when 2 then {_term(ONE)} || ' with ' || {_term(OTHER)} else {_term(OTHER)} || ' / ' || {_term(ONE)} || 's' end as title from part"


def _title() -> Column:
    spelled = F.array(*map(F.lit, SPELLED))
    pick = lambda number: F.get(spelled, (F.expr(number) % len(SPELLED)).cast("int"))
    one, other, form = pick(ONE), pick(OTHER), F.col("p_size") % 4
    two = F.when(form == 2, F.concat_ws(" with ", one, other)).otherwise(F.concat(F.concat_ws(" / ", other, one), F.lit("s")))
    return F.when(form == 0, F.concat_ws(" ", "p_name", one)).when(form == 1, F.concat_ws("-", one, "p_name")).otherwise(two)


@R.query(f"with {matched(TITLES_SQL)} select p_partkey, kind, case when strong then category end as category, coalesce(kind <> 'hoodie' and not generic, false) as conflict from part left join named on id = p_partkey")
def garment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head noun's garment, its category, and conflicts with a hoodie."""
    titled = dealt(spark, sf_dir, "part").select("p_partkey", _title().alias("title"))
    n = F.col("title")
    return titled.select("p_partkey", garments.garment(n)["kind"].alias("kind"), garments.garment_category(n).alias("category"), garments.garments_conflict(n, F.lit("Zip Hoodie")).alias("conflict"))


TREE = {"Hoodies": "tops", "t-shirts": "tops", "Skirts": "skirts", "BOOTS": "footwear", "Bags": "bags", "Tote Bags": "accessories", "Jackets": "outerwear", "Polo-Shirts": "tops", "Knitwear": "knitwear"}
TREE_SQL = _values(list(TREE.items()))
_KEY = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@R.query(
    f"with {matched(TITLES_SQL)}, tree(label, category) as {TREE_SQL}, wanted as (select id, category, unnest(string_split(labels, '|')) as label, generate_subscripts(string_split(labels, '|'), 1) as place from named), "
    + f"best as (select id, arg_min(tree.label, place) as label from wanted join tree on {_KEY.format('tree.label')} = {_KEY.format('wanted.label')} and tree.category = wanted.category group by id) select p_partkey, label from part left join best on id = p_partkey"
)
def garment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's label of a title's garment: the first of its kind's that the
    tree has, in any spelling, under the same category."""
    tree = F.create_map(*[F.lit(x) for pair in TREE.items() for x in pair])
    return dealt(spark, sf_dir, "part").select("p_partkey", garments.garment_label(_title(), tree).alias("label"))


# This dialect can't look ahead: what mustn't follow is taken out with its word first.
AHEAD = {
    r"\bpolo\b(?!\s*neck)": r"\bpolo\s*neck",
    "(?!\\s*-?cut)": r"\bboots?\s*-?cut|\bshoes?\s*(?:bag|box|tree|horn|care|lace|rack)",
    "(?!\\s*socks?)": r"\bcrew(?:neck)?\s*socks?",
    "(?!\\s*jacket)": r"\b(?:jeans?|denim)\s*jacket",
    "(?!y)": r"\bpants?y",
}


def _rule(pattern: str) -> str:
    text = "n"
    for shape, gone in AHEAD.items():
        if shape in pattern:
            text = f"regexp_replace({text}, '{gone}', ' ', 'g')"
    return f"regexp_matches({text}, '" + re.sub(r"\(\?!(?:[^()]|\([^()]*\))*\)", "", pattern) + "')"


RULES = "case " + " ".join(f"when {_rule(p)} then '{c}'" for p, c in kinds.CATEGORY_RULES + kinds.RUSSIAN_RULES) + " end"
#: Titles so that the rules have something to match.
RULED = [
    "ring", "dress shirt", "swim shorts", "denim jacket", "knit dress", "crew socks", "tote bag", "suit", "polo", "polo neck", "bootcut jeans", "boots", "shoe bag",
    "air max 90", "crewneck", "pants", "panty", "Кожаная куртка", "кроссовки", "худи", "платье", "rash guard", "tank top", "jeans jacket vest", "scarf",
]


TRAILS = ["Women > Shoes", "men/tops", "Unisex", "men/knit dress", "Women > Pullover Hoodies", "sale"]
_PICKED = "p_name || ' ' || (select [" + ", ".join(map(_quoted, RULED)) + f"])[1 + p_partkey % {len(RULED)}]"
_TRAIL = "(select [" + ", ".join(map(_quoted, TRAILS)) + f"])[1 + p_partkey % {len(TRAILS)}] || case when p_size % 2 = 0 then ' ' || p_name else '' end"


@R.query(
    f"with {matched(f'select 2 * p_partkey as id, {_PICKED} as title from part union all select 2 * p_partkey + 1, {_TRAIL} from part')}, "
    + f"ruled as (select titles.id, coalesce(case when strong then category end, {RULES}) as category, n from (select id, lower(title) as n from titles) titles left join named using (id)) "
    + "select p_partkey, a.category, coalesce(b.category, 'accessories') as trail_category, case when regexp_matches(b.n, '^(women|girls|ladies|femme|woman)') then 'women' when regexp_matches(b.n, '^(men|boys|homme|man\\b)') then 'men' when contains(b.n, 'unisex') then 'unisex' end as gender from part join ruled a on a.id = 2 * p_partkey join ruled b on b.id = 2 * p_partkey + 1"
)
def part_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of a title, by its head noun or else by rules, and category
    and gender of a shop's trail."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values)).cast("int"))
    trail = F.concat(pick(TRAILS), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(""))
    told = dealt(spark, sf_dir, "part").select("p_partkey", kinds.piece_category(F.concat_ws(" ", "p_name", pick(RULED))).alias("category"), kinds.retail_category(trail).alias("r"))
    return told.select("p_partkey", "category", F.col("r.category").alias("trail_category"), F.col("r.gender").alias("gender"))
