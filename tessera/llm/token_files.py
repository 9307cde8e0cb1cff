"""Token-id files: independent zstandard frames with a trailing seek table.

A shard is one file:

    skippable frame   header: JSON with the format's version and the id type
    zstandard frame   ids of some whole documents, little-endian   (repeated)
    skippable frame   document index: keys and id counts, compressed
    skippable frame   seek table: compressed and plain size and checksum of
                      every frame of ids, then the count of frames, a flag
                      byte and the magic number of zstandard's seekable format

Each frame can be decompressed alone, and its checksum (the low 32 bits of the
xxhash64 of the plain bytes) is verified on reading. A reader fetches the end
of the file, then only the frames that hold the requested documents. Any
zstandard tool can decompress the whole file.

Shards hold ranges of ascending keys, so the ids of the corpus in key order
are the shards' ids one after the other.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import batch_of, mapped, text_slices
from .token_counts import needs_library

# Fixed values of the zstandard format and of its seekable extension.
SKIPPABLE_HEADER = 0x184D2A50
SKIPPABLE_INDEX = 0x184D2A51
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

#: Plain bytes after which a frame is closed.
FRAME_BYTES = 1 << 20
#: Bytes of text, and of 64 for each document, that a task encodes at most, and
#: at least while there are cores without a task; tasks at most.
TASK_BYTES = 64 << 20
LEAST_TASK_BYTES = 2 << 20
MOST_TASKS = 20_000
#: Plain bytes and documents after which a shard is closed.
SHARD_BYTES = 256 << 20
SHARD_DOCS = 1_000_000
#: Words whose ids a worker remembers.
REMEMBERED = 500_000


#: Letters of Latin scripts, where the standard `re` classes are those of the
#: tokenizer's pattern and all text is in composed form.
_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u02ff]")
# The split pattern of word-level BPE tokenizers, and its like
# for plain text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_WORDS = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+")
#: Words that the library gets in one text.
JOINED = 2000


class _Numbered(dict):
    """Words by number; a new word gets the next one, and is listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Ids of texts as the tokenizers library gives them.

    For tokenizers that lower-case, drop white space and merge each word
    alone, every distinct word goes through the library once. Texts with
    characters on which Unicode tables of different ages differ, and all texts
    of other tokenizers, go through it whole.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        added = spec.get("added_tokens") or []
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in before] == ["Split", "ByteLevel"]
            and before[0]["behavior"] == "Removed"
            and before[0]["invert"]
            and before[0]["pattern"] == {"Regex": WORD_PATTERN}
            and bool(spec["model"].get("end_of_word_suffix"))
            and not before[1]["use_regex"]
            and not before[1]["add_prefix_space"]
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
        )
        self.split = regex.compile(WORD_PATTERN)
        self.special = [x["content"] for x in added]
        self.wide = self.library.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.forget()
        self.last = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        if self.by_word:
            suffix = spec["model"]["end_of_word_suffix"]
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def forget(self) -> None:
        """The ids of remembered words stand in one array; a word has the
        number of its start and size there."""
        self.known = _Numbered()
        self.starts = self.sizes = np.empty(0, np.int32)
        self.ids = np.empty(0, np.int32)

    def _learn(self) -> None:
        """Ask the library for the ids of new words, many in one text; a
        word's last id is one that ends words."""
        words, self.known.new = self.known.new, []
        ids = [np.array(self._whole([" ".join(words[lo : lo + JOINED])])[0], np.int32) for lo in range(0, len(words), JOINED)]
        found = np.concatenate([np.empty(0, np.int32), *ids])
        ends = np.flatnonzero(self.last[found]) + 1
        if len(ends) != len(words):
            raise ValueError("the library has split the words otherwise")
        sizes = np.diff(ends, prepend=0)
        self.starts = np.concatenate([self.starts, (ends - sizes + len(self.ids)).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.ids = np.concatenate([self.ids, found])

    def _split(self, text: str) -> list[str] | None:
        """Words of a text; None if the library has to see it whole."""
        if any(x in text for x in self.special):
            return None
        if not _PLAIN.search(text):
            return _PLAIN_WORDS.findall(text.lower())
        if needs_library(text) or "Σ" in text or not unicodedata.is_normalized("NFC", text):
            return None
        return self.split.findall(text.lower())

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_word:
            return [np.array(x, np.int32) for x in self._whole(texts)]
        split = [self._split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        counts = np.fromiter((len(some or ()) for some in split), np.int64, len(split))
        slots = np.fromiter(map(self.known.__getitem__, chain.from_iterable(some or () for some in split)), np.int32, int(counts.sum()))
        self._learn()
        sizes = self.sizes[slots]
        until = np.cumsum(sizes, dtype=np.int32)
        flat = self.ids[np.arange(until[-1] if len(until) else 0, dtype=np.int32) + np.repeat(self.starts[slots] - until + sizes, sizes)]
        cuts = np.concatenate([[0], until])[np.cumsum(counts)]
        out = np.split(flat, cuts[:-1])
        odd = [k for k, some in enumerate(split) if some is None]
        for k, ids in zip(odd, self._whole([texts[k] for k in odd]), strict=True):
            out[k] = np.array(ids, np.int32)
        return out


@lru_cache(2)
def _encoder(content: str) -> WordEncoder:
    return WordEncoder(content)


def _skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


class ShardWriter:
    """Writes one shard; `close` returns (documents, ids)."""

    def __init__(self, out, dtype: str):
        self.out, self.dtype = out, np.dtype(dtype).newbyteorder("<")
        self.pending: list[np.ndarray] = []
        self.bytes, self.whole, self.frames = 0, 0, []
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        out.write(_skippable(SKIPPABLE_HEADER, json.dumps({"version": 1, "dtype": self.dtype.str}).encode()))

    def add(self, key: int | None, ids) -> None:
        array = np.asarray(ids, self.dtype)
        self.keys.append(key)
        self.counts.append(len(array))
        self.pending.append(array)
        self.bytes += array.nbytes
        self.whole += array.nbytes
        if self.bytes >= FRAME_BYTES:
            self._frame()

    def full(self, most_docs: int) -> bool:
        return self.whole >= SHARD_BYTES or len(self.keys) >= most_docs

    def _frame(self) -> None:
        plain = b"".join(a.tobytes() for a in self.pending)
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.pending, self.bytes = [], 0

    def close(self) -> tuple[int, int]:
        if self.pending:
            self._frame()
        known = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        index = struct.pack("<Q", len(self.keys)) + known.tobytes() + keys.tobytes() + np.array(self.counts, "<i8").tobytes()
        packed = self.pack.compress(index)
        self.out.write(_skippable(SKIPPABLE_INDEX, packed))
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(_skippable(SKIPPABLE_SEEK_TABLE, table))
        return len(self.keys), sum(self.counts)


class ShardReader:
    """Reads documents of one shard, decompressing only their frames."""

    def __init__(self, source):
        """source: a seekable binary file."""
        self.source = source
        source.seek(0)
        magic, n = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_HEADER:
            raise ValueError("not a token-id file")
        self.dtype = np.dtype(json.loads(source.read(n))["dtype"])
        first = 8 + n
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the file has no seek table; it may be cut short")
        source.seek(size - 9 - 12 * count)
        table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.checksums = table[:, 2]
        self.at = first + np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        source.seek(int(self.at[-1]))
        magic, n = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("the file has no document index")
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(source.read(n))
        (docs,) = struct.unpack_from("<Q", index)
        known = np.frombuffer(index, np.uint8, docs, 8)
        keys = np.frombuffer(index, "<i8", docs, 8 + docs)
        self.counts = np.frombuffer(index, "<i8", docs, 8 + 9 * docs)
        self.keys = [int(k) if x else None for k, x in zip(keys, known, strict=True)]
        self.starts = np.cumsum(self.counts) - self.counts

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        plain = self.unpack.decompress(self.source.read(int(self.at[k + 1] - self.at[k])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return plain

    def read(self, rows: list[int] | range) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the documents at `rows`, ascending; each frame is read once."""
        held, data = -1, b""
        width = self.dtype.itemsize
        for row in rows:
            lo, hi = int(self.starts[row]) * width, int(self.starts[row] + self.counts[row]) * width
            if lo == hi:
                yield row, np.empty(0, self.dtype)
                continue
            k = int(np.searchsorted(self.plain, lo, side="right")) - 1
            if k != held:
                held, data = k, self.frame(k)
            base = int(self.plain[k])
            yield row, np.frombuffer(data[lo - base : hi - base], self.dtype)

    def find(self, keys: set) -> Iterator[tuple[int, np.ndarray]]:
        """(key, ids) of the documents with the given keys."""
        for row, ids in self.read([r for r, k in enumerate(self.keys) if k in keys]):
            yield self.keys[row], ids


@dataclass(frozen=True)
class Shard:
    """A written file, with the number of ids before it."""

    path: str
    docs: int
    tokens: int
    start: int


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put_in_place(store: fs.FileSystem, trial: str, final: str) -> None:
    """Move a written file to its name, over that of an earlier attempt."""
    try:
        store.move(trial, final)
    except OSError:
        # Some file systems don't replace files.
        store.delete_file(final)
        store.move(trial, final)


def shares(size: int, most: int, least: int, cores: int) -> int:
    """How many tasks `size` bytes are dealt to: `most` bytes each, but as many
    as there are cores while each gets `least` bytes."""
    return max(1, min(MOST_TASKS, max(-(-size // most), min(cores, size // least))))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text", tasks: int | None = None, shard_docs: int = SHARD_DOCS) -> list[Shard]:
    """Encode all rows and write them to `folder` in ascending key order.

    Rows are dealt out by ranges of (key, hash of the text), so equal keys,
    however many, don't have to meet in one task; rows of one key are ordered
    by that hash and then by text, null keys come first, and a null text is
    empty. `end_id` is appended to each document. There are as many tasks as
    the size of the texts asks for, or the cores (`shares`), and a task closes its shard and begins
    another when that is large (SHARD_BYTES, `shard_docs`), so that no index grows without bound. A shard
    is written under a name of its own attempt and then moved, so a task that
    runs again or twice leaves whole files only. The driver gets one row per
    shard. An empty table gives no shard. `folder` must be shared by all executors (any file system
    that pyarrow knows); the ids are 16 bits wide if the vocabulary allows.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    if not tasks:
        size = source.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64)).first()[0] or 0
        tasks = shares(size, TASK_BYTES, LEAST_TASK_BYTES, spark.sparkContext.defaultParallelism)
    dealt = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks, "key", "tie").sortWithinPartitions("key", "tie", "text").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        number = TaskContext.get().partitionId()
        store, root = _opened(folder)
        piece, writer, out, trial = 0, None, None, ""

        def done() -> pa.RecordBatch:
            written, tokens = writer.close()
            out.close()
            name = f"shard-{number:06d}-{piece:06d}.ids.zst"
            put_in_place(store, trial, f"{root}/{name}")
            return batch_of(_MANIFEST, [number], [piece], [f"{folder}/{name}"], [written], [tokens])

        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                if writer is not None and writer.full(shard_docs):
                    yield done()
                    piece, writer = piece + 1, None
                if writer is None:
                    store.create_dir(root, recursive=True)
                    trial = f"{root}/.trial-{uuid.uuid4().hex}"
                    out = store.open_output_stream(trial)
                    writer = ShardWriter(out, "u4" if encoder.wide else "u2")
                keys = batch.column("key").slice(start, len(texts)).to_pylist()
                for k, ids in zip(keys, encoder.encode(texts), strict=True):
                    writer.add(k, ids if end_id is None else np.append(ids, end_id))
        if writer is not None:
            yield done()

    found = mapped(dealt, run, "number int, piece int, path string, docs long, tokens long").collect()
    out, start = [], 0
    for r in sorted(found, key=lambda r: (r.number, r.piece)):
        out.append(Shard(r.path, r.docs, r.tokens, start))
        start += r.tokens
    return out


_MANIFEST = pa.schema([("number", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_token_files(spark: SparkSession, shards: list[Shard], keys: set[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the documents in the files.

    `start` is the number of ids of all documents before; ids_crc32 is taken
    over the ids as little-endian 32-bit integers. `keys` limits the result to
    these documents, and then only their frames are decompressed; documents
    without a key are found by None. `with_ids` False leaves ids null. No shard
    gives no rows. A frame that doesn't match its checksum is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, at = _opened(path)
                with store.open_input_file(at) as source:
                    reader = ShardReader(source)
                    rows = range(len(reader.keys)) if keys is None else [r for r, k in enumerate(reader.keys) if k in keys]
                    held: list[tuple] = []
                    for row, ids in reader.read(rows):
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        held.append((reader.keys[row], before + int(reader.starts[row]), len(ids), crc, ids.astype(np.int32) if with_ids else None))
                        if len(held) == 2000:
                            yield batch_of(_READ, *map(list, zip(*held, strict=True)))
                            held = []
                    if held:
                        yield batch_of(_READ, *map(list, zip(*held, strict=True)))

    files = spark.createDataFrame([(s.path, s.start) for s in shards], "path string, start long")
    return mapped(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
