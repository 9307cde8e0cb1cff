"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived
that every matching text satisfies. A batch of texts is indexed: for each
trigram that some query names, the ascending list of texts that hold it. The
queries' postings are intersected and united, and only the texts that remain
are searched with the expression itself. A rule whose expression has no
mandatory trigram is searched in all texts.

The index is over lower-cased ASCII, so it serves rules of either case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import mapped, text_slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` that `keeps` accepts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def expression(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base kinds in their listed order, then the added ones. A
# run of hex digits is taken whole, so its length can stand in the pattern.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# A private key goes on to its END line or, where that is missing before the next
# BEGIN, to the end of its base64 block; line breaks may be written as escapes.
_BREAK = r"(?:\s|\\[nrt])*+"
_PEM_HEADERS = rf"(?:{_BREAK}(?:Proc-Type|DEK-Info): [^\r\n\\]*)*+"
_PEM_LAST = rf"""{_BREAK}[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|(?=[ \t]*(?:[\r\n"']|\\[nr]|$)))"""
_PEM_BLOCK = rf"(?:{_PEM_HEADERS}(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_PEM_LAST})?)?"
ADDED_RULES = (
    Rule("pem", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{{0,40}}PRIVATE KEY-----|{_PEM_BLOCK})"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + ADDED_RULES

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]), False)

#: Strings that a part of an expression may stand for, at most, before it is
#: summed up by their trigrams.
SPELLINGS = 64

# A query is True (any text), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple


def _joined(kind: str, parts: list[Query]) -> Query:
    flat: set[Query] = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_strings(strings: set[str]) -> Query:
    """What holds in a text with one of the strings."""
    return _joined("or", [_joined("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else True


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-cased trigrams that every match satisfies.

    The syntax tree is walked from left to right. `ends` are the possible
    endings of what was read since the last part of unknown content; they grow
    by literals, small classes and alternatives, and when there are too many,
    their trigrams join the query and only their last two characters go on.
    """

    def walk(items) -> tuple[Query, set[str] | None]:
        """Query of a sequence, and its spellings if they're all known."""
        query, ends, exact = True, {""}, True
        for kind, arg in unrolled(items):
            part, spellings = one(kind, arg)
            query = _joined("and", [query, part])
            if spellings is None:
                query, ends, exact = _joined("and", [query, _of_strings(ends)]), {""}, False
                continue
            grown = {a + b for a, b in product(ends, spellings)}
            if len(grown) > SPELLINGS:
                query, exact = _joined("and", [query, _of_strings(ends)]), False
                grown = {a[-2:] + b for a, b in product(ends, spellings)}
                if len(grown) > SPELLINGS:
                    grown = set(spellings)
            ends = grown
        return (query, ends) if exact else (_joined("and", [query, _of_strings(ends)]), None)

    def unrolled(items) -> Iterator[tuple]:
        """What has to come at least once, spelled out, then the optional rest."""
        for kind, arg in items:
            if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0]:
                least, most, inner = arg
                for _ in range(min(least, 4)):
                    yield from inner
                if least > 4 or most > least:
                    yield kind, (0, most, inner)
            else:
                yield kind, arg

    def one(kind, arg) -> tuple[Query, set[str] | None]:
        if kind is op.LITERAL:
            return True, {chr(arg).lower()}
        if kind is op.IN:
            found: set[str] = set()
            for k, v in arg:
                if k is op.LITERAL:
                    found.add(chr(v).lower())
                elif k is op.RANGE and v[1] - v[0] < SPELLINGS:
                    found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    return True, None
            return True, found if len(found) <= 8 else None
        if kind is op.SUBPATTERN:
            return walk(arg[-1])
        if kind is op.BRANCH:
            sides = [walk(x) for x in arg[1]]
            if all(s is not None for _, s in sides) and len(both := set().union(*(s for _, s in sides))) <= SPELLINGS:
                return True, both
            return _joined("or", [_joined("and", [q, True if s is None else _of_strings(s)]) for q, s in sides]), None
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            _, most, inner = arg
            spellings = walk(inner)[1] if most == 1 else None
            return True, None if spellings is None else spellings | {""}
        if kind is op.AT:
            return True, {""}
        return True, None

    query, spellings = walk(parser.parse(pattern))
    return query if spellings is None else _joined("and", [query, _of_strings(spellings)])


def _trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*map(_trigrams, query[1])) if isinstance(query, tuple) else set()


def _codes(trigram: str) -> int | None:
    raw = trigram.encode()
    return int.from_bytes(raw, "big") if len(raw) == 3 else None


class TrigramIndex:
    """Postings of the wanted trigrams over a batch of texts."""

    def __init__(self, texts: list[str], wanted: np.ndarray):
        """wanted: a flag for each 24-bit trigram code."""
        # Bytes of 255 part the texts; UTF-8 has none, so no trigram spans two.
        parts = [t.encode().lower() for t in texts]
        data = np.frombuffer(b"\xff\xff".join(parts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 2)
        code = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
        at = np.flatnonzero(wanted[code])
        pairs = np.unique(code[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        keys, starts = np.unique(pairs >> 32, return_index=True)
        self.texts = len(texts)
        self.postings = dict(zip(keys.tolist(), np.split(pairs & 0xFFFFFFFF, starts[1:]), strict=False)) if len(keys) else {}

    def find(self, query: Query) -> np.ndarray:
        """Texts that satisfy the query, ascending."""
        if query is True:
            return np.arange(self.texts)
        if isinstance(query, str):
            code = _codes(query)
            return np.arange(self.texts) if code is None else self.postings.get(code, np.empty(0, np.int64))
        found = sorted((self.find(q) for q in query[1]), key=len)
        merge = np.intersect1d if query[0] == "and" else np.union1d
        out = found[0]
        for more in found[1:]:
            out = merge(out, more)
        return out


class Scanner:
    """Finds the spans of a set of rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.expressions = [r.expression() for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        codes = {_codes(t) for q in self.queries for t in _trigrams(q)} - {None}
        self.wanted[sorted(codes)] = True

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each text's spans, in that order."""
        index = TrigramIndex(texts, self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, expression, query) in enumerate(zip(self.rules, self.expressions, self.queries, strict=True)):
            for k in index.find(query).tolist():
                for m in expression.finditer(texts[k]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[k].append((m.start(), number, m.end()))
        for spans in found:
            spans.sort()
        return found


@lru_cache(2)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _mapped(df: DataFrame, text: str, rules: tuple[Rule, ...], made: Callable, field: T.StructField, drop: bool) -> DataFrame:
    schema = T.StructType([f for f in df.schema.fields if not (drop and f.name == field.name)] + [field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            keep = [k for k in range(batch.num_columns) if not (drop and k == at)]
            for start, texts in text_slices(batch, text):
                part = batch.slice(start, len(texts))
                made_column = made(scanner, part.column(at), texts)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), made_column], [*(part.schema.names[k] for k in keep), field.name])

    return mapped(df, run, schema)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, secrets array<struct<kind, start, end>>) of every row.

    A span covers the rule's whole match, in code points with the end
    excluded; matches of one kind are leftmost and don't overlap, those of
    different kinds may. Spans are ordered by start, then by the rules' order.
    A null or empty text has none; null keys, repeated rows and empty tables
    pass through; other columns aren't read.
    """
    kinds = [r.kind for r in rules]

    def made(scanner: Scanner, column: pa.Array, texts: list[str]) -> pa.Array:
        inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        rows = [[{"kind": kinds[n], "start": a, "end": b} for a, n, b in spans] for spans in scanner.scan(texts)]
        return pa.array(rows, inner)

    source = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias(text))
    return _mapped(source, text, rules, made, T.StructField("secrets", SPANS), False).select(key, "secrets")


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each maximal run of spans replaced by `mark`."""
    out, at, until = [], 0, 0
    for start, _, end in spans:
        if start >= until:
            out += [text[at:start], mark] if start > until or not out else []
            at = end
        until = max(until, end)
        at = until
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every found span of `text` replaced by `mark`.

    Overlapping and adjoining spans are replaced together. All other columns
    are kept as they are, as are null texts and texts without secrets.
    """

    def made(scanner: Scanner, column: pa.Array, texts: list[str]) -> pa.Array:
        found = scanner.scan(texts)
        values = [masked(t, spans, mark) if spans else t for t, spans in zip(texts, found, strict=True)]
        return pa.array([v if known else None for v, known in zip(values, column.is_valid().to_pylist(), strict=True)], pa.string())

    names = docs.columns
    kind = T.StructField(text, T.StringType())
    return _mapped(docs, text, rules, made, kind, True).select(*names)
