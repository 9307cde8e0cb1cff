"""Benchmark decontamination: containment search with MinHash sketches.

An item's sketch is the set of the SKETCH smallest hashes of its shingles, a
uniform sample of them, so the share of a sketch that a document holds
estimates the share of the item that it contains, however long the document
is (comparing two whole sketches would estimate a resemblance that vanishes
inside long documents). Documents are partitioned by size, in classes that grow
fourfold, and the search is by class and shingle: a class is given the sketches
of those items only that are small enough to be contained in its documents.
Pairs that hold enough of a sketch are candidates, and each is verified by
exact containment of the shingle set.

Before a document's shingles become rows, those that are in no sketch are
dropped by a bitmap, a Bloom filter with one hash. Its size follows that of the
sketches up to MOST_BITS; beyond it more shingles pass, none is lost.

Arrays are unfolded with explode_outer: for a plain explode the optimizer adds
a filter that it pushes below the hashing, which would then run once for each
word. Everything is DataFrame expressions; shingles are 64-bit hashes of their
words, and no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import sent_if_small, settled
from .words import SHINGLE_WORDS, hashes, runs, words

SKETCH = 16
THRESHOLD_PERCENT = 80
#: Standard deviations of the sketch's hit count that the candidate threshold
#: allows for: at 5, less than one pair in a million at the threshold is lost.
DEVIATIONS = 5.0
#: Size classes of documents; the last is open.
CLASSES = 11
#: Bits of the bitmap: for each sketch value, and at most.
BITS_PER_VALUE = 16
MOST_BITS = 1 << 20


def item_shingles(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, width, size, shingles) of each item with a word.

    width is the number of words of its shingles: five, or all its words if it
    has fewer.
    """
    hashed = benchmark.select(F.col(item).alias("item"), hashes(words(F.lower(F.col(text).cast("string")))).alias("h"))
    hashed = hashed.filter((F.size("h") > 0) & F.col("item").isNotNull()).withColumn("width", F.least(F.size("h"), F.lit(SHINGLE_WORDS)))
    run = F.lit(None).cast("array<bigint>")
    for width in range(1, SHINGLE_WORDS + 1):
        run = F.when(F.col("width") == width, runs(F.col("h"), width)).otherwise(run)
    merged = hashed.select("item", "width", F.array_distinct(run).alias("shingles"))
    return merged.withColumn("size", F.size("shingles")).dropDuplicates(["item", "width", "shingles"])


def least_hits(size: Column) -> Column:
    """Sketch values that a document has to hold to become a candidate."""
    share = THRESHOLD_PERCENT / 100
    sampled = max(1, math.floor(SKETCH * share - DEVIATIONS * math.sqrt(SKETCH * share * (1 - share))))
    return F.when(size <= SKETCH, F.ceil(size * share)).otherwise(F.lit(sampled)).cast("long")


def _size_class(size: Column) -> Column:
    """The class of documents of `size` shingles."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1))) / 2), F.lit(CLASSES - 1)).cast("int")


def _shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc, class, shingles): each document's distinct shingles of the widths.

    Runs of different widths have different hashes, so one column holds all.
    """
    hashed = docs.select("doc", hashes(words(F.lower("text"))).alias("h"))
    every = F.array_distinct(F.concat(*(runs(F.col("h"), w) for w in widths)))
    return hashed.select("doc", _size_class(F.size("h")).alias("class"), every.alias("shingles"))


def _rows(sets: DataFrame) -> DataFrame:
    return sets.select("doc", "class", F.explode_outer("shingles").alias("shingle"))


def _bitmap(values: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test that holds for every shingle of values (shingle), about n of
    them, and for few others. The driver gets MOST_BITS bits at most."""
    bits = 1 << max(6, min(MOST_BITS.bit_length() - 1, (BITS_PER_VALUE * n).bit_length()))
    place = lambda s: F.shiftrightunsigned(s, 3).bitwiseAND(F.lit(bits - 1)).cast("int")
    one = F.lit(1).cast("long")
    at = F.shiftright(place(F.col("shingle")), 6)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = values.select(at.alias("at"), place(F.col("shingle")).alias("place")).groupBy("at").agg(F.bit_or(bit).alias("word"))
    held = {r["at"]: r["word"] for r in words.collect()}
    # One constant, which the optimizer folds to an array.
    listed = F.split(F.lit(",".join(str(held.get(k, 0)) for k in range(bits >> 6))), ",").cast("array<bigint>")

    def test(s: Column) -> Column:
        word = F.get(listed, F.shiftright(place(s), 6))
        return F.call_function("shiftrightunsigned", word, place(s).bitwiseAND(F.lit(63))).bitwiseAND(one) == one

    return test


def _contained(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, item, variant, size, n_shared) of documents (doc, text) and items."""
    held = items.groupBy("width").agg(F.sum("size").alias("rows"), F.sum(F.least("size", F.lit(SKETCH))).alias("sketch_rows")).collect()
    widths = sorted(r.width for r in held) or [SHINGLE_WORDS]
    rows, sketch_rows = sum(r.rows for r in held), sum(r.sketch_rows for r in held)

    # Hashes of shingles are hashed again, so that the least are a sample that
    # doesn't depend on how shingles were hashed.
    ordered = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(7)).alias("order"), s.alias("s"))))
    sketch = F.transform(F.slice(ordered, 1, SKETCH), lambda x: x["s"])
    least_class = _size_class(F.ceil(F.col("size") * THRESHOLD_PERCENT / 100))
    values = items.select("item", "variant", least_hits(F.col("size")).alias("least_hits"), least_class.alias("least"), F.explode_outer(sketch).alias("shingle"))
    sketches = values.withColumn("class", F.explode(F.sequence(F.col("least"), F.lit(CLASSES - 1)))).drop("least")
    wanted = _bitmap(values, sketch_rows)
    sets = _shingles(documents, widths)
    probes = _rows(sets.withColumn("shingles", F.filter("shingles", wanted)))
    probed = probes.join(sent_if_small(sketches, sketch_rows * CLASSES), ["class", "shingle"])
    hits = probed.select("doc", "item", "variant", "least_hits", "shingle").distinct()
    hits = hits.groupBy("doc", "item", "variant", "least_hits").agg(F.count(F.lit(1)).alias("hits"))
    candidates = settled(hits.filter(F.col("hits") >= F.col("least_hits")).select("doc", "item", "variant"), "candidates")
    suspects = documents.join(sent_if_small(candidates.select("doc").distinct(), candidates.count()), "doc", "left_semi")
    every = items.select("item", "variant", "size", F.explode_outer("shingles").alias("shingle"))
    shared = _rows(_shingles(suspects, widths)).join(sent_if_small(every, rows), "shingle").select("doc", "item", "variant", "size", "shingle").distinct()
    exact = shared.groupBy("doc", "item", "variant", "size").agg(F.count(F.lit(1)).alias("n_shared"))
    enough = exact.filter(100 * F.col("n_shared") >= THRESHOLD_PERCENT * F.col("size"))
    return enough.join(candidates, ["doc", "item", "variant"], "left_semi")


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return item_shingles(benchmark, item, text).withColumn("variant", F.xxhash64("width", "shingles"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_shared, n_item_shingles) of each document and benchmark
    item of which the document holds 80 per cent of the shingles or more.

    Texts are lower-cased and words taken whole; a shingle is five words, or,
    for an item of fewer words, all of them. Null and empty texts and items
    match nothing, and null keys are left out. Of rows that share a key, each
    is judged by its own text, and of several texts under one item id each is
    an item of its own; the best match counts. Other columns aren't read; an
    empty table on either side gives no rows. `key` and `item` have to differ.
    """
    if key == item:
        raise ValueError("key and item would be two columns of one name")
    known = F.col(key).isNotNull() & F.col(text).isNotNull()
    own = F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("text_id"))
    documents = docs.filter(known).select(own.alias("doc"), F.col(text).cast("string").alias("text"))
    found = _contained(documents, _items(benchmark, item, item_text))
    match = F.struct(F.col("n_shared") / F.col("size"), "n_shared", F.col("size").cast("long").alias("size"))
    best = found.groupBy(F.col("doc.key").alias("key"), "item").agg(F.max(match).alias("best"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), F.col("best.n_shared").alias("n_shared"), F.col("best.size").alias("n_item_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` whose text isn't contaminated, with all their columns.

    Each row is judged by its own text, whatever its key; null and empty texts
    stay, as do all rows if either table is empty. Repeated rows get the same
    verdict. Texts are told apart by two 64-bit hashes.
    """
    prints = lambda column: [F.xxhash64(column), F.xxhash64(column, F.lit(1))]
    texts = docs.select(F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    documents = texts.select(F.struct(*(p.alias(f"print{k}") for k, p in enumerate(prints(F.col("text"))))).alias("doc"), "text")
    leaked = settled(_contained(documents, _items(benchmark, item, item_text)).select("doc.*").distinct(), "leaked")
    leaked = sent_if_small(leaked, leaked.count())
    one, two = prints(docs[text].cast("string"))
    return docs.join(leaked, (one == leaked["print0"]) & (two == leaked["print1"]), "left_anti")
