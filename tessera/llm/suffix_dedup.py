"""Exact substring dedup with suffix arrays over content-chosen anchors.

A byte goes if a string of LENGTH bytes that covers it also starts in a
document with a smaller key. Sorting all suffixes of a corpus would move each
byte many times over, so only suffixes that can matter are sorted:

1. In each string of LENGTH bytes the GRAM-byte substring of least hash is its
   anchor. Equal strings have equal anchors at equal places. The strings of one
   anchor are consecutive; the bytes they span are the anchor's context.
2. Per slice of some MB of text, the hashes of the anchors' grams are dealt
   out by hash, and those that occur in a second slice or document come back
   as shared: one byte for each, in a file per slice in the shared folder.
3. The text is read again, and the contexts of shared anchors are dealt out by
   gram, equal ones of a slice once, with the least key that has them. There,
   for the different contexts of each gram, two suffix arrays are built by
   deep-shallow sorting: one of the suffixes that start at the anchors, one of
   the reversed prefixes that end there. A string that starts l bytes before
   its anchor occurs in two contexts exactly if these share l bytes to the
   left and LENGTH - l to the right, which the common prefix lengths tell.
   The least key of each string comes back as a mask of strings that occur in
   a smaller document.
4. The text is read a third time and cut.

A gram with very many contexts isn't gathered: its strings are dealt out one
by one, by a hash of the string itself, so that equal ones of a slice combine.
Grams and contexts are told apart by 64-bit hashes each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import mapped
from .near_dedup import by_group
from .shingles import _down, _up, mix
from .suffix_array import deep_shallow_order
from .tables import settled, shared_folder
from .token_files import _opened, put_in_place

LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1
#: Bytes of text handled together, and hashed at once.
SLICE_BYTES = 8 << 20
BLOCK_BYTES = 1 << 19
#: Occurrences from which a gram's strings are dealt out one by one.
HOT = 200_000
#: Bytes of text for each bucket of anchors, which is what a task holds, and the
#: least while there are cores without a bucket.
BUCKET_BYTES = 16 << 20
LEAST_BUCKET_BYTES = 1 << 20
MOST_TASKS = 20_000

_LEAST_PARTS = "spark.sql.files.minPartitionNum"
_PLACE = 24
_LOW = np.uint64((1 << _PLACE) - 1)
_NO_KEY = np.iinfo(np.int64).max


@dataclass
class Units:
    """Runs of strings that are dealt out together, with their contexts.

    start, strings: place in the slice's bytes of the first string, and how
    many there are. anchor: bytes before the anchor. key: what they're dealt
    out by; context: hash of all their bytes. doc: number in the slice.
    """

    start: np.ndarray
    strings: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    context: np.ndarray
    doc: np.ndarray

    def take(self, at: np.ndarray) -> Units:
        return Units(*(x[at] for x in (self.start, self.strings, self.anchor, self.key, self.context, self.doc)))

    @staticmethod
    def joined(parts: list[Units]) -> Units:
        names = ("start", "strings", "anchor", "key", "context", "doc")
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64)
        return Units(*(np.concatenate([np.empty(0, kind), *(getattr(p, x) for p in parts)]) for x, kind in zip(names, kinds, strict=True)))


class Slice:
    """Some documents, their bytes one after the other, and their units.

    A long document is cut into segments that overlap by LENGTH - 1 bytes, so
    that each of its strings lies in exactly one.
    """

    def __init__(self, keys: list[int | None], texts: list[bytes]):
        self.keys, self.texts = keys, texts
        self.docs = np.array([_NO_KEY if k is None else k for k in keys], np.int64)
        segments, at = [], 0
        pieces = []
        for doc, text in enumerate(texts):
            step = BLOCK_BYTES - LENGTH + 1
            for offset in range(0, max(1, len(text) - LENGTH + 1), step) if len(text) >= LENGTH else ():
                piece = text[offset : offset + BLOCK_BYTES]
                segments.append((doc, offset, at, len(piece)))
                pieces.append(piece)
                at += len(piece)
        self.segments = segments
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        seen = xxhash.xxh64(self.docs.tobytes())
        seen.update(np.fromiter(map(len, texts), np.int64, len(texts)).tobytes())
        for text in texts:
            seen.update(text)
        self.name = seen.intdigest() - (1 << 63)

    def units(self) -> Units:
        parts, held, size = [], [], 0
        for segment in self.segments:
            if held and size + segment[3] > BLOCK_BYTES:
                parts.append(self._block(held))
                held, size = [], 0
            held.append(segment)
            size += segment[3]
        if held:
            parts.append(self._block(held))
        return Units.joined(parts)

    def _block(self, segments: list[tuple[int, int, int, int]]) -> Units:
        base = segments[0][2]
        data = self.data[base : segments[-1][2] + segments[-1][3]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _up(len(data)))])
        n = len(data) - GRAM + 1
        gram = mix((sums[GRAM:] - sums[:n]) * _down(len(data))[:n])
        least = (gram & ~_LOW) | np.arange(n, dtype=np.uint64)
        width = 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        owner = (least & _LOW).astype(np.int64)
        # Strings that start in a segment and end in it.
        edge = np.zeros(len(owner) + 1, np.int32)
        first = np.array([s[2] - base for s in segments])
        length = np.array([s[3] for s in segments])
        edge[first] += 1
        np.add.at(edge, np.minimum(first + length - LENGTH + 1, len(owner)), -1)
        inside = np.cumsum(edge[:-1]) > 0
        new = inside.copy()
        new[1:] &= (owner[1:] != owner[:-1]) | ~inside[:-1]
        new[first[1:]] = inside[first[1:]]
        start = np.flatnonzero(new)
        places = np.flatnonzero(inside)
        strings = np.diff(np.append(np.searchsorted(places, start), len(places)))
        end = start + strings - 1 + LENGTH
        context = mix(((sums[end] - sums[start]) * _down(len(data))[start]) ^ mix(strings.astype(np.uint64)))
        segment = np.searchsorted(first, start, side="right") - 1
        doc = np.array([s[0] for s in segments])[segment]
        return Units(start + base, strings, owner[start] - start, gram[owner[start]], context, doc)

    def grams(self, units: Units, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, bucket, index): the distinct grams by bucket and value, and
        where each unit's gram is among them. A value is the gram's hash but
        for five bits: whether two documents have it, and the logarithm of the
        number of its units."""
        masked = units.key & ~np.uint64(31)
        order = np.lexsort((self.docs[units.doc], masked, _bucket(masked, buckets)))
        sorted_ = masked[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(order) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        docs = self.docs[units.doc][order]
        ends = np.append(starts[1:], len(order))
        many = docs[starts] != docs[ends - 1] if len(starts) else np.empty(0, bool)
        size = np.minimum(np.log2(np.maximum(ends - starts, 1)).astype(np.uint64), np.uint64(15))
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        values = sorted_[starts] | (size << np.uint64(1)) | many.astype(np.uint64)
        return values, _bucket(sorted_[starts], buckets), index

    def shared(self, flags: Answers, buckets: int) -> Units:
        """The units that may repeat, by the answers on their grams."""
        units = self.units()
        values, _, index = self.grams(units, buckets)
        return self.dealt(units, flags.read(self.name, "u1", len(values))[index])

    def dealt(self, units: Units, flags: np.ndarray) -> Units:
        """The units of shared grams; those of hot ones string by string."""
        hot = units.take(flags == 2)
        if not len(hot.start):
            return units.take(flags == 1)
        start = np.repeat(hot.start - np.cumsum(hot.strings) + hot.strings, hot.strings) + np.arange(hot.strings.sum())
        hashed = [np.empty(0, np.uint64)]
        for lo in range(0, len(start), 50_000):
            rows = self.data[start[lo : lo + 50_000, None] + np.arange(LENGTH)].astype(np.uint64) + np.uint64(1)
            hashed.append(mix((rows * _up(LENGTH)).sum(1, dtype=np.uint64)))
        key = np.concatenate(hashed)
        ones, zeros = np.ones(len(start), np.int64), np.zeros(len(start), np.int64)
        return Units.joined([units.take(flags == 1), Units(start, ones, zeros, key, key, np.repeat(hot.doc, hot.strings))])

    def distinct(self, units: Units, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, bucket, index): a unit of least document for each different
        (key, context), by bucket; and where each unit is among them."""
        order = np.lexsort((self.docs[units.doc], units.context, units.key, _bucket(units.key, buckets)))
        key, context = units.key[order], units.context[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])]) if len(order) else np.empty(0, bool)
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        first = order[new]
        return first, _bucket(units.key[first], buckets), index

    def cut(self, units: Units, masks: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        """(kept bytes, removed bytes, removed runs) of each document."""
        starts = np.zeros(len(self.data) + 1, bool)
        for j in range(WINDOW):
            some = (masks >> np.uint64(j)) & np.uint64(1) == 1
            starts[units.start[some] + j] = True
        counts = np.cumsum(starts[:-1], dtype=np.int32)
        covered = counts.copy()
        covered[LENGTH:] -= counts[:-LENGTH]
        covered = covered > 0
        own: dict[int, np.ndarray] = {}
        for doc, offset, at, length in self.segments:
            # Nothing runs over the end of a segment, as no string does.
            if doc not in own and length == len(self.texts[doc]):
                own[doc] = covered[at : at + length]
            else:
                whole = own.setdefault(doc, np.zeros(len(self.texts[doc]), bool))
                whole[offset : offset + length] |= covered[at : at + length]
        for doc, text in enumerate(self.texts):
            gone = own.get(doc)
            if gone is None or not gone.any():
                yield text, 0, 0
                continue
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            yield kept, len(text) - len(kept), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(32)).astype(np.int64) % buckets


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Slice]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            keys.append(key)
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= most:
                yield Slice(keys, texts)
                keys, texts, size = [], [], 0
    if keys:
        yield Slice(keys, texts)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """`rows`, the buckets of a task one after the other. Sorting spills, so a
    task holds one bucket at a time however many it is dealt."""
    parts = min(buckets, MOST_TASKS)
    return rows.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "slice")


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, rows) of an ascending bucket column."""
    if len(bucket):
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield int(bucket[lo]), slice(lo, hi)


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


class Answers:
    """A file per slice with what the buckets answered, in bucket order."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, answers: DataFrame) -> None:
        """answers: (slice, bucket, data)."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = _opened(folder)
            store.create_dir(root, recursive=True)
            written = 0
            for table in by_group(batches, "slice"):
                # Equal slices (repeated rows) get equal answers twice.
                once = dict(zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True))
                trial = f"{root}/.trial-{uuid.uuid4().hex}"
                with store.open_output_stream(trial) as out:
                    for bucket in sorted(once):
                        out.write(once[bucket])
                put_in_place(store, trial, f"{root}/{table.column('slice')[0].as_py()}")
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

        mapped(answers.repartition("slice").sortWithinPartitions("slice", "bucket"), run, "n long").agg(F.sum("n")).first()

    def read(self, name: int, dtype: str, expected: int) -> np.ndarray:
        if not expected:
            return np.empty(0, dtype)
        store, root = _opened(self.folder)
        with store.open_input_stream(f"{root}/{name}") as source:
            found = np.frombuffer(source.read(), dtype)
        if len(found) != expected:
            raise ValueError("the texts were dealt out otherwise than before; write them to a table first")
        return found


def _shared_grams(source: DataFrame, buckets: int, most: int, hot: int) -> DataFrame:
    """(slice, bucket, data): for each gram of the slice in the bucket, 0 if
    no other document has it, 1 if one may, 2 if it is hot."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, most):
            values, bucket, _ = part.grams(part.units(), buckets)
            yield _rows(["slice", "bucket", "data"], [pa.int64(), pa.int32(), pa.binary()], [(part.name, b, values[at].tobytes()) for b, at in _by_bucket(bucket)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "bucket"):
            blobs = [np.frombuffer(x, np.uint64) for x in table.column("data").to_pylist()]
            values = np.concatenate(blobs)
            order = np.argsort(values >> np.uint64(5), kind="stable")
            gram = values[order] >> np.uint64(5)
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            sizes = np.diff(np.append(starts, len(gram)))
            many = np.maximum.reduceat(values[order] & np.uint64(1), starts) > 0
            units = np.add.reduceat(np.int64(1) << ((values[order] >> np.uint64(1)) & np.uint64(15)).astype(np.int64), starts)
            flag = np.where((sizes > 1) | many, np.where(units > hot, 2, 1), 0).astype(np.uint8)
            flags = np.empty(len(values), np.uint8)
            flags[order] = np.repeat(flag, sizes)
            at = np.cumsum([0, *map(len, blobs)])
            bucket = table.column("bucket")[0].as_py()
            yield _rows(["slice", "bucket", "data"], [pa.int64(), pa.int32(), pa.binary()], [(s, bucket, flags[lo:hi].tobytes()) for s, lo, hi in zip(table.column("slice").to_pylist(), at[:-1], at[1:], strict=True)])

    schema = "slice long, bucket int, data binary"
    return mapped(_dealt(mapped(source, deal, schema), buckets), answer, schema)


def string_masks(key: np.ndarray, doc: np.ndarray, anchor: np.ndarray, strings: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each context the mask of its strings that occur in a context with
    the same key and a smaller document.

    key is ascending; contexts of one key differ. data[at:] are a context's
    strings + LENGTH - 1 bytes, `anchor` the place of its anchor in them.
    """
    n = len(key)
    masks = np.zeros(n, np.uint64)
    if not n:
        return masks
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
    size = strings + LENGTH - 1
    right_size = size - anchor
    spread = lambda first, step, sizes, width: np.where(np.arange(width) < sizes[:, None], data[np.clip(first[:, None] + step * np.arange(width), 0, len(data) - 1)], 0).astype(np.uint8)
    right = spread(at + anchor, 1, right_size, -(-LENGTH // 8) * 8)
    left = spread(at + anchor - 1, -1, anchor, -(-(WINDOW - 1) // 8) * 8)
    right_order, right_common = deep_shallow_order(group, right, right_size)
    left_order, left_common = deep_shallow_order(group, left, anchor)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(WINDOW):  # noqa: E741
        j = anchor - l
        some = np.flatnonzero((j >= 0) & (j < strings))
        if not len(some):
            continue
        right_class[right_order] = np.cumsum(right_common < LENGTH - l)
        left_class[left_order] = np.cumsum(left_common < l)
        code = right_class[some] * (n + 1) + left_class[some]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
        least = np.minimum.reduceat(doc[some][order], starts)
        smaller = np.empty(len(some), bool)
        smaller[order] = np.repeat(least, np.diff(np.append(starts, len(some)))) < doc[some][order]
        masks[some] |= smaller.astype(np.uint64) << j[some].astype(np.uint64)
    return masks


def _repeated_strings(source: DataFrame, flags: Answers, buckets: int, most: int) -> DataFrame:
    """(slice, bucket, data): the masks of the slice's distinct units."""

    names = ["slice", "bucket", "key", "context", "doc", "anchor", "strings", "bytes"]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, most):
            units = part.shared(flags, buckets)
            first, bucket, _ = part.distinct(units, buckets)
            u = units.take(first)
            docs = part.docs[u.doc]
            sizes = u.strings + LENGTH - 1
            rows = []
            for b, at in _by_bucket(bucket):
                ends = np.cumsum(sizes[at])
                place = np.arange(ends[-1]) + np.repeat(u.start[at] - ends + sizes[at], sizes[at])
                rows.append((part.name, b, u.key[at].tobytes(), u.context[at].tobytes(), docs[at].tobytes(), u.anchor[at].astype(np.uint8).tobytes(), u.strings[at].astype(np.uint8).tobytes(), part.data[place].tobytes()))
            yield _rows(names, kinds, rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "bucket"):
            whole = {x: np.frombuffer(b"".join(table.column(x).to_pylist()), k) for x, k in zip(names[2:], ("u8", "u8", "i8", "u1", "u1", "u1"), strict=True)}
            key, context, doc = whole["key"], whole["context"], whole["doc"]
            anchor, strings = whole["anchor"].astype(np.int64), whole["strings"].astype(np.int64)
            sizes = strings + LENGTH - 1
            at = np.cumsum(sizes) - sizes
            order = np.lexsort((doc, context, key))
            k, c = key[order], context[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            number = np.cumsum(new) - 1
            first = order[new]
            # Keys whose contexts' least documents aren't all the same.
            starts = np.flatnonzero(np.concatenate([[True], key[first][1:] != key[first][:-1]]))
            spans = np.diff(np.append(starts, len(first)))
            differ = np.repeat(np.minimum.reduceat(doc[first], starts) != np.maximum.reduceat(doc[first], starts), spans)
            masks = np.zeros(len(first), np.uint64)
            some = first[differ]
            masks[differ] = string_masks(key[some], doc[some], anchor[some], strings[some], whole["bytes"], at[some])
            every = (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1)
            out = np.empty(len(key), np.uint64)
            out[order] = np.where(doc[order] > doc[first][number], every[order], masks[number])
            counts = [len(x) // 8 for x in table.column("key").to_pylist()]
            cuts = np.cumsum([0, *counts])
            bucket = table.column("bucket")[0].as_py()
            yield _rows(["slice", "bucket", "data"], [pa.int64(), pa.int32(), pa.binary()], [(s, bucket, out[lo:hi].tobytes()) for s, lo, hi in zip(table.column("slice").to_pylist(), cuts[:-1], cuts[1:], strict=True)])

    dealt = mapped(source, deal, "slice long, bucket int, key binary, context binary, doc binary, anchor binary, strings binary, bytes binary")
    return mapped(_dealt(dealt, buckets), answer, "slice long, bucket int, data binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None, settle: bool = True, slice_bytes: int = SLICE_BYTES, hot: int = HOT) -> DataFrame:
    """(key, kept binary, n_bytes, n_removed, n_spans) of every row.

    Each byte covered by a string of 50 bytes that also starts in a row with a
    smaller key is removed, whatever else is removed; n_spans counts maximal
    removed runs. Texts are taken as UTF-8; null and texts under 50 bytes lose
    nothing. Repeats within a row, or among rows of one key, don't count. A
    null key is greater than all others. Other columns aren't read; an empty
    table gives no rows. Keys are integers.

    The texts are read three times and have to come in the same portions each
    time. Files do; anything else is first written to the shared folder
    (`settle`). `buckets` are the shares of the anchors that are sorted at
    once, by default one for each BUCKET_BYTES of text, or for each core; `slice_bytes` of text
    are handled together, and a gram of more than `hot` units is dealt out
    string by string.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    if settle:
        source = settled(source, "texts")
    if not buckets:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cores = spark.sparkContext.defaultParallelism
        buckets = max(1, -(-size // BUCKET_BYTES), min(cores, size // LEAST_BUCKET_BYTES))
    if spark.conf.get(_LEAST_PARTS, None) is None:
        # Else the portions of small files follow the number of cores, which
        # changes when executors come and go.
        spark.conf.set(_LEAST_PARTS, str(spark.sparkContext.defaultParallelism))
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    flags, masks = Answers(f"{folder}/grams"), Answers(f"{folder}/strings")
    flags.write(_shared_grams(source, buckets, slice_bytes, hot))
    masks.write(_repeated_strings(source, flags, buckets, slice_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "kept", "n_bytes", "n_removed", "n_spans"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for part in _slices(batches, slice_bytes):
            units = part.shared(flags, buckets)
            first, _, index = part.distinct(units, buckets)
            mask = masks.read(part.name, "u8", len(first))[index]
            # A document after the least of its slice has a whole context.
            later = part.docs[units.doc] > part.docs[units.doc[first]][index]
            mask = np.where(later, (np.uint64(1) << units.strings.astype(np.uint64)) - np.uint64(1), mask)
            rows: list[tuple] = []
            for k, t, (kept, removed, spans) in zip(part.keys, part.texts, part.cut(units, mask), strict=True):
                rows.append((k, kept, len(t), removed, spans))
                if len(rows) == 500:
                    yield _rows(names, kinds, rows)
                    rows = []
            yield _rows(names, kinds, rows)

    return mapped(source, cut, "key long, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("key", key)
