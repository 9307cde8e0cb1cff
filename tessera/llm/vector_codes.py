"""Compression of vectors to codes of a few bytes (product quantisation).

Vectors of integers are cut into equal parts; each part position has a codebook,
fitted in rounds of assigning parts to nearest entries and replacing entries by
the means of their parts. The nearest entry is found in a vantage-point tree
over the entries of a position: each node has a vantage entry and parts the
others by their distance from it, and a subtree is left out when the triangle
inequality shows that it can hold nothing as near as what is known. All results
are exact: radii are rounded outwards, a subtree that could hold an equal
distance is still visited, and candidates are compared by integer squared
distances, ties going to the entry of lower index.

A round sends one row for each task, position, entry and component through a
shuffle; the driver holds only codebooks, whose size doesn't depend on the
number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import batch_of, mapped
from .tables import joined_to_groups, settled

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Components are floor(SCALE * x), and have to lie below LARGEST, so that squared
#: distances of vectors of up to 8,000 components fit 64 bits.
SCALE = 256
LARGEST = 1 << 24
#: By how much distances are rounded outwards: some rounding errors of a double.
WIDENED = 2.0**-50
#: Entries below which a node of the tree isn't split.
LEAF = 4
#: Vectors that are searched for at once.
VECTORS = 8192


@dataclass
class Node:
    """Part of a vantage-point tree: entries compared here (a vantage entry, or
    those of a leaf), and subtrees with the least and largest distance of their
    entries from the vantage entry, rounded down and up."""

    entries: list[int]
    children: list[tuple[Node, float, float]]


def grown(points: np.ndarray, members: list[int]) -> Node:
    """A tree over the rows `members` of integer `points`."""
    if len(members) <= LEAF:
        return Node(members, [])
    # The member farthest from the others' mean sees them at the most different distances.
    own = points[members]
    vantage = members[int(((own * len(own) - own.sum(0)).astype(float) ** 2).sum(1).argmax())]
    others = [m for m in members if m != vantage]
    squared = ((points[others] - points[vantage]) ** 2).sum(1)
    order = np.argsort(squared, kind="stable")
    half = len(order) // 2
    children = []
    for side in (order[:half], order[half:]):
        far = np.sqrt(squared[side].astype(float))
        low, high = far.min() * (1 - WIDENED), far.max() * (1 + WIDENED)
        children.append((grown(points, [others[i] for i in side.tolist()]), low, high))
    return Node([vantage], children)


class Search:
    """Nearest entries of one part position, for many parts at once."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = grown(entries, list(range(len(entries))))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each part."""
        self.parts = parts
        self.index = np.full(len(parts), len(self.entries), np.int64)
        self.squared = np.full(len(parts), np.iinfo(np.int64).max, np.int64)
        self._visit(self.root, np.arange(len(parts)))
        return self.index, self.squared

    def _visit(self, node: Node, at: np.ndarray) -> None:
        for e in node.entries:
            squared = ((self.parts[at] - self.entries[e]) ** 2).sum(1)
            better = (squared < self.squared[at]) | ((squared == self.squared[at]) & (e < self.index[at]))
            self.squared[at[better]], self.index[at[better]] = squared[better], e
        if not node.children:
            return
        # From here on `squared` belongs to the vantage entry.
        distance = np.sqrt(squared.astype(float))
        (near, near_low, near_high), (far, far_low, far_high) = node.children
        middle = (near_high + far_low) / 2
        inside = distance <= middle
        # Each part first visits the side that it lies on.
        self._visit(near, at[inside])
        self._visit(far, at[~inside])
        self._visit(far, at[inside][self._reaches(at[inside], distance[inside], far_low, far_high)])
        self._visit(near, at[~inside][self._reaches(at[~inside], distance[~inside], near_low, near_high)])

    def _reaches(self, at: np.ndarray, distance: np.ndarray, low: float, high: float) -> np.ndarray:
        """Whether entries between low and high from the vantage entry can be as
        near as the nearest known; distances are rounded in their favour."""
        least = np.maximum(low - distance * (1 + WIDENED), distance * (1 - WIDENED) - high)
        return least <= np.sqrt(self.squared[at].astype(float)) * (1 + WIDENED)


@dataclass
class Codebooks:
    """Entries by part position: integers[part, entry, component]."""

    entries: np.ndarray

    def searches(self) -> list[Search]:
        return [Search(book) for book in self.entries]

    def listed(self) -> list[int]:
        """All components by part, entry and position within the part."""
        return [int(x) for x in self.entries.ravel()]


def coded(vector: Column) -> Column:
    """The integer components of a vector; null where it is null or holds null
    or non-finite components."""
    numbers = vector.cast("array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(numbers, lambda x: F.floor(x * SCALE)))


def _sound(vectors: DataFrame, key: str, vector: str, parts: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, codes, carried0 ...) of the vectors that can be cut into parts."""
    carried = [F.col(c).alias(f"carried{k}") for k, c in enumerate(carry)]
    rows = vectors.select(F.col(key).alias("key"), coded(F.col(vector)).alias("codes"), *carried)
    return rows.filter(F.col("codes").isNotNull() & (F.size("codes") > 0) & (F.size("codes") % parts == 0))


def _seeds(kept: DataFrame, length: int, parts: int, entries: int) -> Codebooks:
    rows = kept.filter(F.col("key").isNotNull()).orderBy("key", "codes").limit(entries).select("codes").collect()
    if not rows:
        rows = kept.orderBy("codes").limit(entries).select("codes").collect()
    books = np.array([r.codes for r in rows], np.int64).reshape(len(rows), parts, length // parts)
    return Codebooks(np.ascontiguousarray(books.transpose(1, 0, 2)))


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) of a batch in blocks of up to VECTORS."""
    for lo in range(0, batch.num_rows, VECTORS):
        codes = batch.column("codes").slice(lo, VECTORS)
        block = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(codes), length)
        if len(block) and max(int(block.max()), -int(block.min())) >= LARGEST:
            raise ValueError(f"a component lies beyond {LARGEST // SCALE}, where squared distances don't fit 64 bits")
        yield lo, block


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])


def _updated(kept: DataFrame, books: Codebooks, length: int) -> Codebooks:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    parts, entries, width = books.entries.shape
    shipped = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches, totals, counts = shipped.value.searches(), np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, block in _blocks(batch, length):
                for part, search in enumerate(searches):
                    own = block[:, part * width : (part + 1) * width]
                    index, _ = search.nearest(own)
                    np.add.at(totals[part], index, own)
                    counts[part] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            spread = [np.repeat(a.astype(np.int32), width) for a in (part, entry)]
            position = np.tile(np.arange(width, dtype=np.int32), len(part))
            yield batch_of(_SUMS, *spread, position, totals[part, entry].ravel(), np.repeat(counts[part, entry], width))

    summed = mapped(kept.select("codes"), run, "part int, entry int, position int, total long, n long")
    rows = summed.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    part, entry, position, total, n = (rows.column(c).to_numpy() for c in ("part", "entry", "position", "total", "n"))
    fresh = books.entries.copy()
    fresh[part, entry, position] = total // n
    return Codebooks(fresh)


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the parts of the `entries` vectors of least key
    and are fitted to all vectors in `rounds` rounds. See `encode` for the
    vectors that count."""
    sound = _sound(vectors, key, vector, parts)
    first = sound.orderBy(F.col("key").asc_nulls_last(), "codes").select(F.size("codes").alias("n")).limit(1).collect()
    length = first[0].n if first else parts
    kept = sound.filter(F.size("codes") == length)
    books = _seeds(kept, length, parts, entries)
    if books.entries.shape[1]:
        for _ in range(rounds):
            books = _updated(kept, books, length)
    return books


def encode(vectors: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, code, error, carry ...): the index of the nearest entry for each
    part, two hexadecimal digits each, and the sum of the squared distances.

    Components become floor(256 * x). Vectors that are null, or hold null or
    non-finite components, are left out; so are empty ones and those whose
    length isn't that of the codebooks (in `fit`: of the least key's vector with
    a length that can be cut). A component beyond about a million is an error.
    Null keys are coded but start no codebook unless all are null; repeated
    rows are coded each; of vectors under one key the lesser comes first. With
    fewer vectors than entries codebooks are smaller; an empty table has none
    and gives no rows. Other columns aren't read; `key`, `carry`, code and
    error have to differ.
    """
    names = [key, "code", "error", *carry]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of one name among {names}")
    parts, entries, width = books.entries.shape
    if entries > 256:
        raise ValueError("two digits name 256 entries at most")
    length = parts * width
    kept = _sound(vectors, key, vector, parts, carry).filter(F.size("codes") == length if entries else F.lit(False))
    shipped = vectors.sparkSession.sparkContext.broadcast(books)
    others = ["key", *(f"carried{k}" for k in range(len(carry)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = shipped.value.searches()
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in others), ("code", pa.string()), ("error", pa.int64())])
            for lo, block in _blocks(batch, length):
                codes, errors = np.empty((len(block), parts), np.uint8), np.zeros(len(block), np.int64)
                for part, search in enumerate(searches):
                    index, squared = search.nearest(block[:, part * width : (part + 1) * width])
                    codes[:, part] = index
                    errors += squared
                yield batch_of(schema, *(batch.column(c).slice(lo, len(block)) for c in others), [bytes(c).hex() for c in codes], errors)

    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in others)
    found = mapped(kept.select("codes", *others), run, f"{kinds}, code string, error long")
    return found.select(F.col("key").alias(key), "code", "error", *(F.col(f"carried{k}").alias(c) for k, c in enumerate(carry)))


def with_group_error(encoded: DataFrame, group: str, name: str) -> DataFrame:
    """`encoded` with the sum of the errors over rows of equal `group` in
    `name`; nulls are a group. No group's rows meet in one task."""
    label = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null"))
    rows = settled(encoded.withColumn("group_key", label), "coded")
    sums = settled(rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("group_rows"), F.sum("error").alias(name)), "group-errors")
    return joined_to_groups(rows, sums, "group_key", "group_rows", spread="code").drop("group_key", "group_rows")
