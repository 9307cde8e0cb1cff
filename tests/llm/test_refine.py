"""Exact dedup, vector codes and periodic runs against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, periodic_runs, tables, vector_codes

DATA = "/root/testdata/sf0.001"


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute_groups(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[normal(text)].append(key)
    return {t: (min((k for k in keys if k is not None), default=None), len(keys)) for t, keys in groups.items()}


LONG = "word " * 300_000
TEXTS = [
    (5, "a  b"), (3, "a\tb"), (3, "a\n\nb"), (None, "a b"), (9, "a b "), (1, None), (2, ""), (2, None), (7, " "), (8, LONG), (4, LONG.replace(" ", "\x0b")),
    (None, "only nulls"), (None, "only nulls"), (10, "x" * 64 + "y"), (11, "x" * 64 + "z"), (12, "a b"), (13, "a\x1cb"),
]


def test_exact_duplicates(spark):
    docs = spark.createDataFrame([(k, t, 0, "h") for k, t in TEXTS], "doc_id long, text string, n int, hash string")
    rows = exact_dedup.exact_duplicates(docs.repartition(3), digest="sha").collect()
    groups = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in brute_groups(TEXTS).items()}
    assert len(rows) == len(TEXTS) and {r.sha for r in rows} == set(groups)
    assert all((r.keep_id, r.group_size) == groups[r.sha] for r in rows)
    for sha, (least, _) in groups.items():
        assert [r.doc_id for r in rows if r.sha == sha and r.kept] == [least]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(docs, keep="doc_id")


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_exact_duplicates_with_hot_groups(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(tables, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(tables, "HOT_GROUPS", 3)
    rows = [(k, "same" if k % 3 == 0 else f"pair {k // 2}" if k % 5 else f"own {k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "id long, body string").repartition(5)
    found = exact_dedup.exact_duplicates(docs, key="id", text="body").collect()
    want = brute_groups(rows)
    text = dict(rows)
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in found) == [(k, *want[text[k]], k == want[text[k]][0]) for k, _ in rows]


def test_exact_duplicates_read_full_content_of_few(spark):
    docs = spark.createDataFrame([(k, f"{k} own text of row {k}") for k in range(50)] + [(100, "twice"), (101, "twice")], "doc_id long, text string")
    texts = docs.select(exact_dedup.normalised(F.col("text")).alias("text"))
    bitmap = exact_dedup._survivors(texts)
    assert bitmap.count() == 1
    outlined = texts.withColumns({"length": F.octet_length("text"), "prefix": F.xxhash64(F.substring("text", 1, exact_dedup.PREFIX))})
    assert {r.text for r in tables.tested(outlined, bitmap, ["length", "prefix"]).filter("passed").collect()} == {"twice"}


def brute_codes(vectors, parts=16, entries=64, rounds=2):
    """Plain integers, one comparison after the other."""
    kept = sorted((k, [int(np.floor(256.0 * x)) for x in v]) for k, v in vectors)
    cut = lambda v: [v[i * len(v) // parts : (i + 1) * len(v) // parts] for i in range(parts)]
    rows = [(k, cut(v)) for k, v in kept]
    books = [[c[p] for _, c in rows[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, c in rows:
                members[near(c[p], books[p])[1]].append(c[p])
            for e, own in members.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = {}
    for k, c in rows:
        nearest = [near(c[p], books[p]) for p in range(parts)]
        found.setdefault(k, []).append(("".join(f"{i:02x}" for _, i in nearest), sum(d for d, _ in nearest)))
    return {k: sorted(v) for k, v in found.items()}, [x for book in books for e in book for x in e]


def test_codes_of_embeddings(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    codes, listed = brute_codes([(r.vec_id, r.embedding) for r in vectors.collect()])
    books = vector_codes.fit(vectors.repartition(3))
    found = vector_codes.encode(vectors, books, carry=("label",)).collect()
    assert books.listed() == listed
    assert {r.vec_id: [(r.code, r.error)] for r in found} == codes


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(k, [((k * 7 + i * 13) % 11 - 5) / 64 for i in range(32)], k % 3 or None) for k in range(90)]
    odd = [(100, None, 1), (101, [None] * 32, 1), (102, [nan] + [0.0] * 31, 1), (103, [0.0] * 31 + [inf], 1), (104, [-inf] * 32, None), (105, [], 1), (106, [0.5] * 16, 1)]
    again = [sound[5], (None, [0.25] * 32, 2)]
    docs = spark.createDataFrame(sound + odd + again, "vec_id long, embedding array<double>, label int").withColumn("codes", F.lit("clash"))
    books = vector_codes.fit(docs)
    coded = vector_codes.encode(docs, books, carry=("label",))
    rows = vector_codes.with_group_error(coded, "label", "label_error").collect()
    codes, listed = brute_codes([(1000 if k is None else k, v) for k, v, _ in sound + again])
    assert books.listed() == listed
    found = defaultdict(list)
    for r in rows:
        found[1000 if r.vec_id is None else r.vec_id].append((r.code, r.error))
    assert found == codes
    sums = defaultdict(int)
    for r in rows:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in rows) and None in sums
    nothing = docs.limit(0)
    assert vector_codes.encode(nothing, vector_codes.fit(nothing)).count() == 0
    few = docs.filter("vec_id < 3")
    assert vector_codes.fit(few).entries.shape == (16, 3, 2) and {r.error for r in vector_codes.encode(few, vector_codes.fit(few)).collect()} == {0}
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.encode(spark.createDataFrame([(1, [1e6] * 32)], "vec_id long, embedding array<double>"), books).collect()


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_tree_search_is_exact(data):
    size = st.integers(-3, 3) if data.draw(st.booleans()) else st.integers(-(1 << 24) + 1, (1 << 24) - 1)
    width = data.draw(st.integers(1, 4))
    vector = st.lists(size, min_size=width, max_size=width)
    entries = np.array(data.draw(st.lists(vector, min_size=1, max_size=40)), np.int64)
    parts = np.array(data.draw(st.lists(vector, min_size=1, max_size=30)), np.int64)
    index, squared = vector_codes.Search(entries).nearest(parts)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert index.tolist() == every.argmin(1).tolist() and squared.tolist() == every.min(1).tolist()


def test_tree_search_leaves_subtrees_out():
    compared = []

    class Counted(vector_codes.Search):
        def _visit(self, node, at):
            compared.append(len(at) * len(node.entries))
            super()._visit(node, at)

    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-128, 128, (64, 4)), rng.integers(-128, 128, (500, 4))
    Counted(entries).nearest(parts)
    assert sum(compared) < 0.7 * 64 * 500


def brute_runs(words, least=24, periods=3):
    n, found = len(words), {}
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(least, periods * p):
                found.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=6), st.integers(1, 9)), max_size=4), max_size=5), st.integers(1, 24), st.integers(2, 4))
def test_runs(shapes, least, periods):
    documents = [[w for unit, times in shape for w in unit * times] for shape in shapes]
    assert periodic_runs.runs(documents, 3, least, periods) == [brute_runs(d, least, periods) for d in documents]


def test_runs_in_chunks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", 7)
    documents = [[0] * 40 + [1, 2] * 30 + list(range(3, 30)) * 4, [5] * 23, [5] * 24, []]
    assert periodic_runs.runs(documents, 30) == [brute_runs(d) for d in documents]


def brute_op13(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_op13_against_brute_force(spark, tmp_path):
    from tessera.llm.queries import QUERIES

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = [(10**6 + k, t) for k, t in enumerate([None, "", " \n", "a " * 23, "a " * 24, "a b c " * 9 + "x " + "b c " * 40] * 8)]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    docs.filter(F.length("text") < 6000).unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        assert tuple(r)[1:] == brute_op13(r.doc_id, texts[r.doc_id])


def test_runs_of_odd_rows(spark):
    long = "spam and eggs " * 120_000
    docs = spark.createDataFrame([(None, "a " * 30, 1), (1, None, 2), (1, None, 2), (2, long, 3)], "doc_id long, text string, runs int")
    rows = {(r.doc_id, r.n_words): r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in rows[None, 30].runs] == [(0, 30, 1)] and rows[None, 30].collapsed == "a"
    assert rows[1, 0].runs == [] and rows[1, 0].collapsed == ""
    assert [tuple(x) for x in rows[2, 360_000].runs] == [(0, 360_000, 3)] and rows[2, 360_000].collapsed == "spam and eggs"
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, least_periods=1)
