"""Dictionaries looked up by hash, against a scan of all terms."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import garments, kinds, terms


def brute_hits(listed, text):
    """Every term at every place, by one expression each."""
    low = re.sub(r"[^\w]+|_", " ", text.lower().replace("ё", "е")).split()
    found = set()
    for n, term in enumerate(listed):
        marks = terms.parsed(term)
        for i in range(len(low) - len(marks) + 1):
            shape = {"*": r"\w*", "+": "(?:s|es)?"}
            each = [m[1:] if m.startswith("/") else re.escape(m.rstrip("*+")) + shape.get(m[-1], "") for m in marks]
            if all(re.fullmatch(e, w) for e, w in zip(each, low[i:])):
                found.add((n, i, i + len(marks)))
    return sorted(found)


def test_hits(spark):
    rng = random.Random(3)
    words = ["coat", "coats", "rain", "a", "as", "dress", "dresses", "куртк", "куртка", "парка", "парками", "t", "shirt", "574", "9060x", "ёлка"]
    listed = ["coat", "rain coat", "t-shirt", "dress!", "куртк", "куртк парк", "парка!", "a a", "shirt /[0-9]{3,4}[a-z]?/", "елк", "rain coat t shirt"]
    listed += [" ".join(rng.choices(["coat", "rain", "t", "shirt", "x"], k=rng.randint(1, 3))) for _ in range(40)]
    texts = ["", "!!", *(rng.choice([" ", "-", " / "]).join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(150))]
    split = F.filter(F.split(terms.plain(F.col("t")), " "), lambda w: w != "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", terms.Terms(listed).hits(split).alias("h")).collect()
    assert all(sorted(map(tuple, r.h)) == brute_hits(listed, r.t) for r in rows) and sum(len(r.h) for r in rows) > 200
    with pytest.raises(ValueError):
        terms.Terms(["/x+/"])


def test_all_kinds(spark):
    assert len(garments.GARMENTS) == 97 and len({g.kind for g in garments.GARMENTS}) == 97
    alone = [(t.strip("~").replace("!", "").replace("/[0-9]{3,4}[a-z0-9]*/", "990"), g.category) for g in garments.GARMENTS for t in g.terms]
    rows = spark.createDataFrame(alone, "t string, c string").select("t", "c", garments.garment(F.col("t"))["category"].alias("found")).collect()
    assert [r for r in rows if r.found != r.c] == []


def test_trails_ask_the_dictionary_first(spark):
    trails = ["men/knit dress", "Women > Pullover Hoodies", "Unisex", "girls / Air Max 90", None]
    rows = spark.createDataFrame([(t,) for t in trails], "t string").select(kinds.retail_category(F.col("t")).alias("r")).collect()
    assert [tuple(r.r) for r in rows] == [("dresses", "men"), ("tops", "women"), ("accessories", "unisex"), ("footwear", "women"), ("accessories", None)]


def test_dictionary_from_a_table(spark):
    table = spark.createDataFrame([(1, "hat", "accessories", ["Hats"], ["hat"]), (0, "cap", "accessories", ["Caps", "Hats"], ["cap", "шапк"]), (2, "none", "x", None, None)], "rank int, kind string, category string, labels array<string>, terms array<string>")
    mine = garments.read_dictionary(table)
    assert [g.kind for g in mine] == ["cap", "hat", "none"]
    tree = F.create_map(F.lit("hats"), F.lit("accessories"))
    row = spark.range(1).select(garments.garment(F.lit("Red Caps"), mine)["kind"].alias("k"), garments.garment_label(F.lit("Шапка"), tree, mine).alias("l")).first()
    assert tuple(row) == ("cap", "hats")


def test_cost_does_not_follow_the_dictionary(spark):
    names = spark.range(4000).select(F.concat_ws(" ", F.lit("washed"), F.concat(F.lit("word"), F.col("id") % 2500), F.lit("bomber jacket in blue")).alias("n")).cache()
    names.count()

    def seconds(size):
        dictionary = garments.GARMENTS + tuple(garments.Garment(f"k{n}", "tops", (), (f"word{n}", f"word{n} long coat")) for n in range(size))
        told = names.select(garments.garment(F.col("n"), dictionary)["kind"].alias("k"))
        told.count()
        began = time.time()
        told.write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(10)
    assert seconds(2500) < 4 * max(seconds(10), 0.2)
