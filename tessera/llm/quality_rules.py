"""Quality rules with adaptive thresholds.

Two fixed rules set the base: too few words, or too many words in repeated
passages. Beyond it a document is compared with its own kind: for each
language and source, mergeable quantile sketches (percentile_approx, combined
on the map side) of some ratios (letters and digits among the characters of
words, repeated lines, length of words) give the median and a quantile on
either side, and a document is dropped if a ratio lies many times their
distance outside. The text is read once; its measures are written to the shared
folder, and sketches and the joined filter read those. No Python runs on the
executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import settled
from .words import SPACES, hashes, runs, words

WINDOW = 8
# Fixed values of the base rules.
LEAST_WORDS = 20
REPEAT_PERCENT = 30

#: Ratio: the rank of its lower quantile (and, from above, of the upper one),
#: then (distances of that quantile from the median, least distance from it)
#: at which a document counts as an outlier, upwards and downwards. The
#: sketches decide but for groups without any spread.
RATIOS = {
    "plain_share": (0.25, None, (12.0, 0.02)),
    "dup_line_share": (0.25, (3.0, 0.0), None),
    "mean_word": (0.1, (5.0, 0.25), (5.0, 0.25)),
}
#: Ratios that are zero for most documents: their sketches take the others, so
#: that a document is compared with those that have any.
SPARSE = ("dup_line_share",)
#: Share of its language's spread that a group's is taken for at least, so that
#: a group of copies, which has none, doesn't drop all other documents.
LEAST_SPREAD = 0.5
#: Base-passing documents that a language and source need in a ratio's sketch
#: for thresholds of their own; with fewer, those of the language as a whole hold.
LEAST_GROUP = 50
#: Inverse of the sketches' rank error.
ACCURACY = 10_000


def _repeat_words(starts: Column) -> Column:
    """Words covered by windows at the ascending `starts`."""
    gaps = F.zip_with(F.slice(starts, 2, F.size(starts) - 1), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`keep` and the measures of each row; see `judge` for their meaning.

    n_marks are the characters in words that are neither letters nor numbers.
    A null text has none of anything; repeated rows and empty tables pass
    through; other columns aren't read.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    split = docs.select(*keep, t).select(*keep, "text", words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = split.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.array_join("words", ""), F.lit("[^\\p{L}\\p{N}]")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        hashes(F.col("words")).alias("hashes"),
    )
    windowed = counted.select(
        *keep,
        "n_words",
        "word_chars",
        "n_marks",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        runs(F.col("hashes"), WINDOW).alias("windows"),
    )
    # Only where a window repeats are windows sorted, with their places.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = windowed.withColumn("windows", placed)
    same = lambda w, k: F.col("windows")[w]["h"] == F.col("windows")[k]["h"]
    last = F.size("windows") - 1
    found = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(((k > 0) & same(F.greatest(k - 1, F.lit(0)), k)) | ((k < last) & same(F.least(k + 1, last), k)), F.col("windows")[k]["i"]))
    placed = ordered.withColumn("starts", F.when(F.col("windows").isNotNull(), F.array_sort(F.filter(found, lambda i: i.isNotNull())))).drop("windows")
    return placed.withColumn("n_repeat_words", F.coalesce(_repeat_words(F.col("starts")), F.lit(0)).cast("long")).drop("starts")


def _ratios(measured: DataFrame) -> DataFrame:
    chars, count, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    return measured.withColumns(
        {
            "plain_share": (F.col("word_chars") - F.col("n_marks")) / chars,
            "dup_line_share": F.col("n_dup_lines") / lines,
            "mean_word": F.col("word_chars") / count,
        }
    )


def quantiles(measured: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The quantiles of each group's ratios, by sketches, and how many documents
    each is taken of."""
    points = lambda low: F.array(F.lit(low), F.lit(0.5), F.lit(1 - low))
    taken = {r: F.when(F.col(r) > 0, F.col(r)) if r in SPARSE else F.col(r) for r in RATIOS}
    sketches = [F.percentile_approx(taken[r], points(low), F.lit(ACCURACY)).alias(r) for r, (low, _, _) in RATIOS.items()]
    return measured.groupBy(*by).agg(*(F.count(taken[r]).alias(f"n_{r}") for r in RATIOS), *sketches)


def thresholds(measured: DataFrame) -> DataFrame:
    """(of_lang, of_source, least_ratio, most_ratio ...): the accepted ratios of
    each language and source; null where a side has no bound."""
    own = quantiles(measured, ("lang", "source"))
    whole = quantiles(measured, ("lang",)).select(F.col("lang").alias("of"), *(F.col(r).alias(f"whole_{r}") for r in RATIOS))
    both = own.join(whole, F.col("lang").eqNullSafe(F.col("of")), "left")
    bounds: list[Column] = []
    for r, (_, *sides) in RATIOS.items():
        low, mid, high = (F.when(F.col(f"n_{r}") >= LEAST_GROUP, F.col(r)[k]).otherwise(F.col(f"whole_{r}")[k]) for k in range(3))
        whole_low, whole_mid, whole_high = (F.col(f"whole_{r}")[k] for k in range(3))
        spreads = (high - mid, LEAST_SPREAD * (whole_high - whole_mid)), (mid - low, LEAST_SPREAD * (whole_mid - whole_low))
        for name, sign, side, (spread, least) in zip(("most", "least"), (1, -1), sides, spreads, strict=True):
            bound = mid + sign * F.greatest(side[0] * F.greatest(spread, least), F.lit(side[1])) if side else F.lit(None).cast("double")
            bounds.append(bound.alias(f"{name}_{r}"))
    return both.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *bounds)


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", language: str = "lang", source: str = "source") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, base_failed, kept) of every row.

    word_chars are the code points in words, n_symbols the characters of
    #*$%&|<>, n_lines the lines with a word and n_dup_lines those equal to an
    earlier one, n_repeat_words the words in 8-word windows that occur twice
    or more in the text. base_failed: fewer than 20 words, or over 30 per cent
    of them in repeated windows. kept is false if base_failed, or if a ratio
    is an outlier of its language and source (null is a group like any other).

    Null and empty texts have no words and fail. Repeated rows and null keys
    are judged like others; other columns aren't read; an empty table gives no
    rows. Thresholds come from sketches of all base-passing rows; a language
    and source with fewer than LEAST_GROUP of them takes those of its language.
    """
    source_rows = docs.select(
        F.col(key).alias("key"), F.col(language).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    measured = settled(measures(source_rows, keep=("key", "lang", "source")).withColumn("base_failed", failed), "measures")
    rated = _ratios(measured)
    sound = rated.filter(~F.col("base_failed"))
    bounds = thresholds(sound)
    joined = rated.join(bounds, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    outlier = F.lit(False)
    for r in RATIOS:
        outlier = outlier | F.coalesce(F.col(r) > F.col(f"most_{r}"), F.lit(False)) | F.coalesce(F.col(r) < F.col(f"least_{r}"), F.lit(False))
    return joined.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~outlier).alias("kept")
    )
