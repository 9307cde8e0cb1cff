"""Token counts by the whole-token shortcut.

Before any text is read, on the driver, every vocabulary string that a byte-level BPE file
spells as one pre-token is encoded alone; those that come back as exactly
themselves are proven whole tokens. In texts, a pre-token of that set counts
one at once, and only the distinct remaining pre-tokens are merged.

Texts with characters that Unicode tables of different ages class differently
are encoded whole by the library, as are all texts for tokenizers of another
kind (SentencePiece models, JSON files that aren't plain byte-level BPE).
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import batch_of, mapped, text_slices

# The split pattern of byte-level BPE tokenizers.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Counts of merged pre-tokens that a worker remembers.
REMEMBERED = 400_000

#: Characters whose class is the same in all Unicode versions in use.
_SETTLED = re.compile("[^\x00-\u0557\u2010-\u2027\u20ac]")


@lru_cache(1)
def unassigned_class() -> re.Pattern:
    """Characters that this Python's Unicode tables don't know."""
    spans, first = [], None
    for cp in range(sys.maxunicode + 2):
        unknown = cp <= sys.maxunicode and unicodedata.category(chr(cp)) == "Cn"
        if unknown and first is None:
            first = cp
        elif not unknown and first is not None:
            spans.append(f"\\U{first:08x}-\\U{cp - 1:08x}")
            first = None
    return re.compile(f"[{''.join(spans)}]")


def needs_library(text: str) -> bool:
    """Whether the text holds characters on which split tables may differ."""
    return bool(_SETTLED.search(text) and unassigned_class().search(text))


class WholeTokenCounter:
    """Counts tokens of texts as a tokenizers JSON file does."""

    def __init__(self, content: str, whole: frozenset[str] | None = None):
        """whole: the strings proven before, if any."""
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        added = [x["content"] for x in spec.get("added_tokens") or []]
        plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec.get("added_tokens") or [])
        before = spec.get("pre_tokenizer") or {}
        self.shortcut = (
            plain
            and spec["model"]["type"] == "BPE"
            and not spec.get("normalizer")
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
        )
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(BYTE_LEVEL_PATTERN)
        self.known: dict[str, int] = {}
        self.whole = (self._proven() if whole is None else whole) if self.shortcut else frozenset()

    def forget(self) -> None:
        self.known.clear()

    def _proven(self) -> frozenset[str]:
        strings = [self.library.decoder.decode([t]) for t in self.library.get_vocab(with_added_tokens=False)]
        single = [s for s in strings if s and "�" not in s and not needs_library(s) and self.split.findall(s) == [s]]
        return frozenset(s for s, n in zip(single, self._merged(single), strict=True) if n == 1)

    def _merged(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Token count of each text."""
        if not self.shortcut:
            return self._merged(texts)
        found, pieces, asked = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            if needs_library(text):
                asked.append(k)
                pieces.append(())
                continue
            parts = self.cut.split(text) if self.cut else [text]
            found[k] = len(parts) - 1
            pieces.append([p for part in parts for p in self.split.findall(part)] if len(parts) > 1 else self.split.findall(text))
        whole, known = self.whole, self.known
        if len(known) > REMEMBERED:
            known.clear()
        rest = [[p for p in some if p not in whole] for some in pieces]
        new = list({p for some in rest for p in some if p not in known})
        known.update(zip(new, self._merged(new), strict=True))
        for k, some in enumerate(rest):
            found[k] += len(pieces[k]) - len(some) + sum(map(known.__getitem__, some))
        for k, n in zip(asked, self._merged([texts[k] for k in asked]), strict=True):
            found[k] = n
        return found


class PieceCounter:
    """Counts tokens of texts as a SentencePiece model does."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)

    def forget(self) -> None:
        """Nothing is remembered."""

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]


@lru_cache(4)
def proven(content: bytes) -> frozenset[str]:
    """The whole tokens of a tokenizers JSON file."""
    return WholeTokenCounter(content.decode()).whole


@lru_cache(4)
def _counter(content: bytes, whole: frozenset[str] | None):
    return PieceCounter(content) if whole is None else WholeTokenCounter(content.decode(), whole)


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of `docs`.

    Counts leave out begin, end and other added tokens; strings of special
    tokens inside a text count as the library's default has them. A null or
    empty text has 0 bytes and 0 tokens. A null key stays null; repeated rows
    give repeated rows; other columns, whatever their names, aren't read. An
    empty table gives an empty result. `tokenizer`, a .json or .model file, is
    read on the driver, and its content and the proven strings are sent to the
    workers (their size is that of one vocabulary).
    """
    with open(tokenizer, "rb") as f:
        content = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast((content, proven(content) if tokenizer.endswith(".json") else None))
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shipped.value)
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field("key").type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            for start, texts in text_slices(batch, "text"):
                keys = batch.column("key").slice(start, len(texts))
                yield batch_of(schema, keys, [len(t.encode()) for t in texts], counter.counts(texts))
        # Workers outlive tasks; what they remember shouldn't.
        counter.forget()

    out = mapped(source, run, f"key {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
