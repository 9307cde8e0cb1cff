"""Styles that a text speaks of: words for each, looked up by hash."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms
from .binding import let
from .kinds import STYLES

# Words of styles as `terms` has them, of our own choice; others can be passed.
STYLE_TERMS = {
    "minimal": ("minimal", "minimalist", "minimalism", "clean line", "understated", "минимализ", "лаконичн"),
    "streetwear": ("streetwear", "graphic tee", "skate", "hip hop", "стритвир", "уличн стил"),
    "classic": ("classic", "timeless", "tailored", "double breasted", "классическ", "двубортн"),
    "avant-garde": ("avant garde", "deconstructed", "asymmetric", "sculptural", "авангард", "асимметр"),
    "romantic": ("romantic", "floral", "ruffle", "puff sleeve", "романтич", "кружев"),
    "utilitarian": ("utility", "workwear", "cargo", "military", "multi pocket", "милитари", "карго"),
    "bohemian": ("bohemian", "boho", "crochet", "fringe", "paisley", "бохо", "бахром"),
    "preppy": ("preppy", "varsity", "argyle", "cable knit", "prep!", "преппи", "колледж"),
    "sporty": ("sporty", "athletic", "running", "tennis", "track suit", "спортивн", "бегов"),
    "dark": ("gothic", "grunge", "punk", "skull", "готик", "гранж"),
    "maximalist": ("maximalist", "sequin", "leopard", "all over print", "пайетк", "леопард"),
    "coastal": ("coastal", "nautical", "linen", "breton", "resort wear", "морск стил", "пляж"),
    "academic": ("academic", "tweed", "houndstooth", "corduroy", "elbow patch", "твид", "вельвет"),
}
Dictionary = dict[str, tuple[str, ...]]
#: Characters below which a text says nothing.
LEAST_TEXT = 3


@cache
def _index(listed: tuple[tuple[str, str], ...]) -> terms.Terms:
    return terms.Terms([t for _, t in listed])


def style_evidence(value: Column, dictionary: Dictionary = STYLE_TERMS) -> Column:
    """map of style to what first speaks of it in a text, in plain words; the
    vocabulary's order."""
    listed = tuple((s, t) for s, own in dictionary.items() for t in own)
    index, of_term = _index(listed), terms.constant([s for s, _ in listed])
    order = [s for s in STYLES if s in dictionary] + [s for s in dictionary if s not in STYLES]

    def read(words: Column) -> Column:
        def first(style: Column, hits: Column) -> Column:
            own = F.filter(hits, lambda h: F.get(of_term, h["term"]) == style)
            return F.array_min(F.transform(own, lambda h: F.struct(h["start"].alias("start"), h["term"].alias("term"), h["end"].alias("end"))))

        def told(hits: Column) -> Column:
            found = F.transform(terms.constant(order), lambda s: let(first(s, hits), lambda h: F.struct(s.alias("style"), F.array_join(F.slice(words, h["start"] + 1, h["end"] - h["start"]), " ").alias("said"))))
            return F.map_from_entries(F.filter(found, lambda x: x["said"].isNotNull()))

        return let(index.hits(words), told)

    return let(F.filter(F.split(terms.plain(value), " "), lambda w: w != ""), read)


def inferred_styles(value: Column, most: int = 3, dictionary: Dictionary = STYLE_TERMS) -> Column:
    """At most `most` styles with evidence, in the vocabulary's order; none for
    a text of under three characters."""
    short = F.length(F.trim(F.coalesce(value, F.lit("")))) < LEAST_TEXT
    return F.when(short, F.array().cast("array<string>")).otherwise(F.slice(F.map_keys(style_evidence(value, dictionary)), 1, most))
