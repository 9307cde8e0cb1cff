"""Byte-level BPE encoding and decoding over a rank file.

A pre-token's bytes are the leaves of a segment tree. A leaf holds the rank of
the pair that starts at its byte (with the position in the low bits), an inner
node the least of its two children, so the root is the leftmost pair of least
rank. A merge follows the links between live neighbours, changes three leaves
and climbs to the root: logarithmic work.

Distinct short pre-tokens of a batch are merged side by side, one numpy row
per pre-token; long ones go through the same tree one at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import mapped, text_slices

#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 200_000
#: Bytes up to which pre-tokens are merged side by side.
SIDE_BY_SIDE = 64
#: Tree leaves worked on at once.
LEAVES = 1 << 18

_NONE = np.int64(1 << 62)
_BITS = 31


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and a rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class RankMerger:
    """Merges byte strings by pair rank, the leftmost least pair first."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the rank file has no token for bytes {missing[:5]}")
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << _BITS | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each non-empty piece."""
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = (whole,)
            elif len(piece) > SIDE_BY_SIDE:
                out[k] = self._one(piece)
            else:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for leaves, at in classes.items():
            step = LEAVES // leaves
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                for k, ids in zip(part, self._rows([pieces[k] for k in part], leaves), strict=True):
                    out[k] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (a, b) at `position`."""
        keys = a << _BITS | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at] << _BITS | position, _NONE)

    def _rows(self, pieces: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)[:, None]
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        position = np.arange(leaves)
        ids, live = self.byte_ids[raw], position < length
        after = np.where(position + 1 < length, position + 1, leaves)
        before = np.tile(position - 1, (n, 1))
        tree = np.full((n, 2 * leaves), _NONE)
        leaf = self._rank(ids[:, :-1], ids[:, 1:], position[:-1])
        tree[:, leaves:-1] = np.where(position[1:] < length, leaf, _NONE)
        width = leaves
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2

        def put(rows: np.ndarray, at: np.ndarray, value) -> None:
            node = at + leaves
            tree[rows, node] = value
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while rows.size:
            top = tree[rows, 1]
            left = top & ((1 << _BITS) - 1)
            gone = after[rows, left]
            right = after[rows, gone]
            ids[rows, left] = top >> _BITS
            live[rows, gone] = False
            after[rows, left] = right
            inside = right < leaves
            before[rows[inside], right[inside]] = left[inside]
            put(rows, gone, _NONE)
            pair = self._rank(ids[rows, left], ids[rows, np.minimum(right, leaves - 1)], left)
            put(rows, left, np.where(inside, pair, _NONE))
            prior = before[rows, left]
            some = prior >= 0
            r, p = rows[some], prior[some]
            put(r, p, self._rank(ids[r, p], ids[r, left[some]], p))
            rows = rows[tree[rows, 1] < _NONE]
        flat, ends = ids[live].tolist(), np.cumsum(live.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _one(self, piece: bytes) -> tuple[int, ...]:
        n, none, low = len(piece), int(_NONE), (1 << _BITS) - 1
        leaves = 1 << (n - 1).bit_length()
        ids, pairs = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), self.pairs
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        tree = [none] * (2 * leaves)

        def value(p: int, q: int) -> int:
            rank = pairs.get(ids[p] << _BITS | ids[q])
            return none if rank is None else rank << _BITS | p

        for p in range(n - 1):
            tree[leaves + p] = value(p, p + 1)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(p: int, v: int) -> None:
            node = leaves + p
            tree[node] = v
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                best = a if a < b else b
                if tree[node] == best:
                    break
                tree[node] = best
                node >>= 1

        while tree[1] < none:
            left = tree[1] & low
            ids[left] = tree[1] >> _BITS
            gone = after[left]
            right = after[gone]
            live[gone] = 0
            after[left] = right
            put(gone, none)
            if right < n:
                before[right] = left
                put(left, value(left, right))
            else:
                put(left, none)
            if before[left] >= 0:
                put(before[left], value(before[left], left))
        return tuple(i for i, x in zip(ids, live, strict=True) if x)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.forget()
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @cached_property
    def merger(self) -> RankMerger:
        """Made on first use: decoding needs none."""
        return RankMerger(self.ranks)

    def forget(self) -> None:
        """The ids of known pre-tokens stand in one array; a pre-token has the
        number of its start and size there."""
        self.known: dict[str, int] = {}
        self.first = self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def _learn(self, pieces: list[str]) -> None:
        merged = self.merger.merge([p.encode() for p in pieces])
        count = np.fromiter(map(len, merged), np.int64, len(merged))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.first = np.concatenate([self.first, np.cumsum(count) - count + len(self.ids)])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(merged), np.int32, int(count.sum()))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text end."""
        split = [self.split.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        self._learn(list({p for some in split for p in some if p not in known}))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        slots = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        sizes = self.count[slots]
        until = np.cumsum(sizes)
        ids = self.ids[np.arange(until[-1] if len(until) else 0) + np.repeat(self.first[slots] - until + sizes, sizes)]
        return ids, np.concatenate([[0], until])[np.cumsum(counts)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of the id lists that end at `ends` in `ids`."""
        sizes = self.sizes[ids]
        until = np.cumsum(sizes)
        flat = np.arange(until[-1] if len(until) else 0) + np.repeat(self.starts[ids] - until + sizes, sizes)
        data = self.bytes[flat].tobytes()
        cuts = np.concatenate([[0], until])[np.concatenate([[0], ends])].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(2)
def _codec(content: bytes, pattern: str) -> Codec:
    return Codec(parse_ranks(content), pattern)


def _shipped(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row; each match of `pattern` is merged alone.

    `decoded` names a further column, the bytes that the ids decode to, made
    in the same pass. A null or empty text gives an empty array (and no
    bytes). Strings of special tokens are ordinary text. Null keys, repeated
    rows and empty tables pass through; other columns aren't read. The rank
    file (one vocabulary) is read on the driver and sent to the workers.
    `decoded` can't be the name of another column of the result.
    """
    if decoded in (key, "ids", "key"):
        raise ValueError(f"{decoded} names another column")
    content = _shipped(docs, rank_file)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    fields = [T.StructField("key", source.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern)
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                ids, ends = codec.encode(texts)
                columns = [batch.column("key").slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))]
                if decoded:
                    columns.append(pa.array(codec.decode(ids, ends), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        # Workers outlive tasks; what they remember shouldn't.
        codec.forget()

    return mapped(source, run, T.StructType(fields)).withColumnRenamed("key", key)


def decode(encoded: DataFrame, rank_file: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """`encoded` with the array `ids` replaced by its bytes in `data`.

    A null or empty array gives empty bytes; ids outside the vocabulary are an
    error. All other columns are kept as they are; `data` can't be the name of
    one of them.
    """
    if data != ids and data in encoded.columns:
        raise ValueError(f"{data} names another column")
    content = _shipped(encoded, rank_file)
    rest = [f for f in encoded.schema.fields if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, "")
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                lists = part.column(at)
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                found = codec.decode(lists.flatten().to_numpy(zero_copy_only=False), ends)
                kept = [part.column(k) for k in range(part.num_columns) if k != at]
                names = [n for n in part.schema.names if n != ids]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], [*names, data])

    return mapped(encoded, run, T.StructType([*rest, T.StructField(data, T.BinaryType())]))
