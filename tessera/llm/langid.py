"""Language identification: multinomial naive Bayes on hashed n-grams.

Features are the character n-grams of orders 1 to 3 of the lower-cased text,
with everything but letters read as a space, hashed to a fixed number of
buckets. A batch of texts is a sparse matrix of bucket numbers; its product
with the matrix of log-probabilities is taken by gathering and summing rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import batch_of, mapped, text_slices

#: The answer for texts without a letter.
UNDETERMINED = "und"
ORDERS = 3
BUCKET_BITS = 16
#: Documents of each language that the model is fitted on, about and at most
#: (the sample is by a hash of the key, so its size varies by some per cent).
DOCS_PER_LANGUAGE = 4000
#: Added to each bucket's count.
SMOOTHING = 0.1
#: Tasks that count n-grams of the sample.
FIT_TASKS = 12


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams that start at each character, one array
    per order, with the start and end of each text in them.

    Texts are parted by spaces, so an n-gram may run past the end of its text
    but never into the next one.
    """
    pad = " " * ORDERS
    lowered = [t.lower() for t in texts]
    chars = np.frombuffer((pad.join(lowered) + pad).encode("utf-32-le"), np.uint32)
    chars = np.where(_letters()[chars], chars, np.uint32(32))
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    starts = np.cumsum(sizes + ORDERS) - sizes - ORDERS
    grams, state = [], np.zeros(len(chars), np.uint32)
    for order in range(ORDERS):
        ahead = chars[order:] if order else chars
        state = state[: len(ahead)] * np.uint32(0x9E3779B1) + ahead + np.uint32(order * 0x51ED27)
        mixed = (state ^ (state >> np.uint32(15))) * np.uint32(0x85EBCA77)
        grams.append(mixed >> np.uint32(32 - BUCKET_BITS))
    return grams, starts, starts + sizes


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; 0 where that is empty."""
    edges = np.column_stack([starts, ends]).ravel()
    out = np.add.reduceat(np.append(values, 0), edges)[::2]
    return np.where(ends > starts, out, 0)


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of the buckets, a row for each language."""

    languages: tuple[str, ...]
    log_probability: np.ndarray

    @staticmethod
    def of_counts(counts: dict[str, np.ndarray]) -> LanguageModel:
        languages = tuple(sorted(counts))
        rows = [np.log(counts[x] + SMOOTHING) - np.log(counts[x].sum() + SMOOTHING * len(counts[x])) for x in languages]
        return LanguageModel(languages, np.array(rows, np.float32).reshape(len(languages), 1 << BUCKET_BITS))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior probability.

        Languages are equally likely beforehand; of equal ones the first in
        alphabetical order is taken.
        """
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        grams, starts, ends = features(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for k, row in enumerate(self.log_probability):
            for g in grams:
                total[:, k] += _sums(row[g].astype(np.float64), starts, np.minimum(ends, len(g)))
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        some = [any(map(str.isalpha, t)) for t in texts]
        names = [self.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
        return names, np.where(some, score, 0.0).tolist()


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its key, as text,
    leaves 2 when divided by 4. A null key isn't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """A model of the non-null labels of `labelled`.

    Each language is represented by about `per_language` documents, chosen by
    a hash of the key and read whole; all, where it has fewer. Only the
    per-language row counts and one row of sums for each language and bucket
    reach the driver. Null texts teach nothing; without labels the model knows
    no language.
    """
    known = labelled.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    known = known.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes:
        return LanguageModel.of_counts({})
    parts = 1_000_000
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(parts, per_language * parts // n + 1)))])
    sample = known.filter(F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.lit(17)), F.lit(parts)) < share[F.col("label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                labels = batch.column("label").slice(start, len(texts)).to_pylist()
                grams, starts, ends = features(texts)
                for language in set(labels):
                    own = sums.setdefault(language, np.zeros(1 << BUCKET_BITS, np.int64))
                    inside = np.zeros(len(grams[0]) + 1, np.int8)
                    mine = np.fromiter((x == language for x in labels), bool, len(labels))
                    np.add.at(inside, starts[mine], 1)
                    np.add.at(inside, ends[mine], -1)
                    inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
                    for g in grams:
                        own += np.bincount(g[inside[: len(g)]], minlength=1 << BUCKET_BITS)
        for language, own in sums.items():
            at = np.flatnonzero(own)
            yield batch_of(_COUNTS, [language] * len(at), at.astype(np.int32), own[at])

    counted = mapped(sample.select("label", "text").repartition(FIT_TASKS), run, "label string, bucket int, n long")
    rows = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = {k: np.zeros(1 << BUCKET_BITS) for k in sizes}
    labels, buckets, ns = (rows.column(c).to_numpy() for c in ("label", "bucket", "n"))
    for k in counts:
        mine = labels == k
        counts[k][buckets[mine]] = ns[mine]
    return LanguageModel.of_counts(counts)


_COUNTS = pa.schema([("label", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, from its text alone.

    The whole text is read. A null or empty text or one without a letter is
    "und" with score 0, as is every text if the model knows no language. Null
    keys, repeated rows and empty tables pass through; other columns aren't
    read. The model (a row of fixed length per language) is broadcast.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field("key").type), ("lang_pred", pa.string()), ("score", pa.float64())])
            for start, texts in text_slices(batch, "text"):
                names, scores = shipped.value.predict(texts)
                yield batch_of(schema, batch.column("key").slice(start, len(texts)), names, scores)

    return mapped(source, run, f"key {kind.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def identified(docs: DataFrame, model: LanguageModel, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text has a language, known with at least
    `least_score`; all columns stay as they are.

    Rows with a null or empty text, or without a letter, go.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, text):
                names, scores = shipped.value.predict(texts)
                keep = [n != UNDETERMINED and s >= least_score for n, s in zip(names, scores, strict=True)]
                yield batch.slice(start, len(texts)).filter(pa.array(keep))

    return mapped(docs, run, docs.schema)
