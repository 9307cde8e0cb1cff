"""Near-duplicates, repeated substrings and benchmark items by brute force."""

import random
import re

import numpy as np
import pytest

from tessera.llm import decontaminate, near_dedup, suffix_array, suffix_dedup, tables
from tessera.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def corpus():
    texts = [t for s in range(25) for t in family(s, 6, 80 + s, 4)] + family(99, 60, 150, 6)
    texts += [None, "", "  \t ", "one two", "ONE two", "one two three", texts[0].upper(), texts[0].replace(" ", "\n")]
    return [(k, t, "clash") for k, t in enumerate(texts)]


def brute_components(rows, percent=80):
    sets = {k: shingles(t) for k, t, *_ in rows}
    label = {k: k for k in sets}
    while True:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        if not changed:
            return {k: (len(sets[k]), label[k], label[k] == k) for k in sets}


def brute_rows(rows, percent=80):
    """(n, component, kept) of each row, whatever keys repeat or are null."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    out = []
    for (key, _), own, name in zip(rows, sets, label):
        keys = [k for (k, _), x in zip(rows, label) if x == name and k is not None]
        out.append((key, len(own), min(keys, default=None) if own else key))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"GROUP_SHINGLES": 300, "LEAF": 6, "LEVELS": 1}])
def test_near_duplicates_with_repeated_and_null_keys(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(25)]), t) for s in range(14) for t in family(s, 5, 60, 6)]
    a, b = family(50, 1, 60, 0)[0], family(51, 1, 60, 0)[0]
    rows += [(103, a), (105, a + " more"), (105, b), (107, b + " two more"), (105, b), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_rows(rows)
    stay = near_dedup.one_of_each(docs).collect()
    # One text of each component stays, that of its least key.
    left = [(r.doc_id, len(shingles(r.text))) for r in stay if shingles(r.text)]
    whole = {(c, k) for k, n, c in brute_rows(rows) if n}
    assert len(left) == len(brute_rows([(None, r.text) for r in stay if shingles(r.text)]))
    assert all(k is None or (k, k) in whole for k, _ in left)
    sets = [shingles(r.text) for r in stay if shingles(r.text)]
    assert not any(100 * len(x & y) >= 80 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    assert {105} <= {k for k, _ in left} and sum(t is None for _, t in ((r.doc_id, r.text) for r in stay)) == 1


@pytest.mark.parametrize("percent,limits", [(85, {}), (80, {}), (80, {"GROUP_DOCS": 10, "LEAF": 20, "LEVELS": 2})])
def test_near_duplicates(spark, monkeypatch, percent, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, percent=percent).collect()}
    assert found == brute_components(rows, percent)


def test_near_duplicates_of_odd_rows(spark):
    text = family(1, 1, 40, 0)[0]
    docs = spark.createDataFrame([(4, text), (4, text), (2, text), (None, text), (None, "lone text of no key at all"), (9, None)], "doc_id long, text string")
    rows = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(rows, key=str) == sorted([(4, 2, False), (4, 2, False), (2, 2, True), (None, 2, False), (None, None, True), (9, 9, True)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dedup.one_of_each(spark.createDataFrame([(4, text, 1), (4, text, 1), (2, text, 1), (2, text, 1), (9, None, 1)], "doc_id long, text string, kept int"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9] and kept.columns == ["doc_id", "text", "kept"]


def test_near_duplicates_in_a_hot_node(spark, monkeypatch):
    # Documents that agree on nearly every token, in a node of 65 blocks.
    monkeypatch.setattr(near_dedup, "LEAF", 2)
    monkeypatch.setattr(near_dedup, "LEVELS", 1)
    page = " ".join(f"w{k}" for k in range(1000))
    docs = spark.createDataFrame([(k, f"{page} own{k}") for k in range(130)], "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, percent=95).collect()
    assert len(found) == 130 and {r.component_id for r in found} == {0}


@pytest.mark.parametrize("leaf", [8, 30])
def test_pairs_in_crowded_nodes(spark, monkeypatch, leaf):
    # Pages of one template: in every node, linked with few of the others.
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "LEVELS", 1)
    rng = random.Random(8)
    page = [f"w{k}" for k in range(300)]
    rows = []
    for pair in range(60):
        own = [f"p{pair}.{k}" for k in range(60)]
        for _ in range(2):
            rows.append((len(rows), " ".join(page + own + [f"x{rng.randrange(10**9)}" for _ in range(4)])))
    rows += [(len(rows) + k, " ".join([*page, f"y{k}"])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, percent=85).collect()}
    assert found == brute_components(rows, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_below_crowded_nodes(percent):
    # Pairs at the threshold whose nodes are crowded at every level.
    pairs, rng = 20_000, np.random.default_rng(5)
    own = 100 - percent >> 1
    union = rng.integers(1 << 64, size=(pairs, 100), dtype=np.uint64)
    both = lambda cut: [np.ascontiguousarray(u) for u in np.delete(union, cut, 1)]
    n_tokens = near_dedup.branches(percent)
    a, b = (near_dedup.sketches(both(cut), n_tokens)[1] for cut in (np.s_[:own], np.s_[own : 100 - percent]))
    level = (a == b).reshape(pairs, near_dedup.trees(percent), near_dedup.LEVELS + 1, 2).any(3)
    together = level.all(2)
    assert abs(together.mean() - (1 - (1 - percent / 100) ** 2) ** (near_dedup.LEVELS + 1)) < 0.01
    assert together.any(1).all()


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (5, 5), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0


def test_deep_shallow_order():
    rng = random.Random(2)
    for _ in range(60):
        n, width, letters = rng.randint(1, 50), rng.choice([8, 40, 56]), rng.choice([2, 3, 256])
        base = [bytes(rng.randrange(letters) for _ in range(width)) for _ in range(3)]
        rows, lengths = np.zeros((n, width), np.uint8), np.array([rng.choice([width, rng.randint(0, width)]) for _ in range(n)])
        for i in range(n):
            own = bytearray(rng.choice(base))
            own[rng.randrange(width)] = rng.randrange(letters)
            rows[i, : lengths[i]] = list(own[: lengths[i]])
        group = np.sort(np.array([rng.randint(0, 3) for _ in range(n)]))
        order, common = suffix_array.deep_shallow_order(group, rows, lengths)
        keys = [(group[i], rows[i].tobytes(), lengths[i]) for i in order]
        assert keys == sorted(keys)
        for i in range(n):
            if i == 0 or keys[i][0] != keys[i - 1][0]:
                assert common[i] == -1
            else:
                differs = np.flatnonzero(rows[order[i]] != rows[order[i - 1]])
                assert common[i] == (differs[0] if len(differs) else width)


def brute_repeats(rows):
    big = 1 << 62
    first, out = {}, []
    rows = sorted(rows, key=lambda r: big if r[0] is None else r[0])
    for k, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - 49):
            first.setdefault(data[s : s + 50], big if k is None else k)
    for k, text in rows:
        data = (text or "").encode()
        cover = bytearray(len(data))
        for s in range(len(data) - 49):
            if first[data[s : s + 50]] < (big if k is None else k):
                cover[s : s + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(data, cover) if not c)
        spans = sum(1 for i in range(len(data)) if cover[i] and (not i or not cover[i - 1]))
        out.append((k, kept, len(data), sum(cover), spans))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [200_000, 0])
def test_repeats(spark, hot):
    rng = random.Random(3)
    passages = ["".join(rng.choice("ab é\x00") for _ in range(rng.choice([49, 50, 51, 120]))) for _ in range(6)]
    rows = []
    for k in range(80):
        parts = [rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(120))) for _ in range(5)]
        rows.append((k, "".join(parts)))
    rows += [(200, "x" * 400), (201, "x" * 300), (3, rows[3][1]), (None, rows[4][1]), (202, None), (203, ""), (204, rows[0][1][:60])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, kept int").repartition(3)
    found = suffix_dedup.remove_repeats(docs, slice_bytes=3000, hot=hot).collect()
    assert sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in found), key=str) == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_contamination(spark):
    rng = random.Random(4)
    words = lambda n: [f"q{rng.randrange(400)}" for _ in range(n)]
    items = [(k, " ".join(words(n))) for k, n in enumerate([3, 4, 5, 8, 20, 60, 150])] + [(50, None), (51, ""), (52, "Upper Case Item Of Six Words"), (53, " ".join(["same"] * 9))]
    docs = []
    for k in range(120):
        own = words(rng.randrange(0, 300))
        if k % 3 == 0:
            item = WORD.findall(items[rng.randrange(len(items))][1] or "")
            item = item[: len(item) - rng.randrange(0, 3)] if len(item) > 10 else item
            at = rng.randrange(len(own) + 1)
            own[at:at] = [w.upper() for w in item]
        docs.append((k, " ".join(own)))
    docs += [(7, docs[7][1]), (None, items[4][1]), (300, None), (301, "")]
    want = set()
    for k, text in docs:
        for i, item in items:
            size = len(WORD.findall((item or "").lower()))
            own = shingles(item, min(5, size)) if size else set()
            held = {s for s in shingles(text, len(next(iter(own))))} if own else set()
            if k is not None and own and 100 * len(own & held) >= 80 * len(own):
                want.add((k, i, len(own & held), len(own)))
    frame = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = decontaminate.contaminated(frame, bench).collect()
    assert len(want) > 20 and {tuple(r) for r in found} == want and len(found) == len(want)
    assert decontaminate.contaminated(frame.limit(0), bench).count() == decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    # Rows are judged by their texts, with a null key or one that others have.
    frame = frame.union(spark.createDataFrame([(0, "ok words here", 0), (None, items[5][1], 0), (1, items[5][1], 0)], frame.schema))
    docs += [(0, "ok words here"), (None, items[5][1]), (1, items[5][1])]
    leaked = {t for k, t in docs if t and any(k == w[0] for w in want) and t != "ok words here"} | {items[4][1], items[5][1]}
    stay = sorted((str(k), str(t)) for k, t in docs if t not in leaked)
    assert sorted((str(r.doc_id), str(r.text)) for r in decontaminate.clean(frame, bench).collect()) == stay and len(stay) < len(docs)
    with pytest.raises(ValueError):
        decontaminate.contaminated(frame, bench, key="item_id")


def test_a_small_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    items = [(k, " ".join(f"i{k}.{j}" for j in range(30))) for k in range(40)]
    docs = [(k, " ".join([f"own{k}.{j}" for j in range(50)] + ([items[k % 40][1]] if k % 2 else []))) for k in range(80)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k % 40) for k in range(80) if k % 2}


def test_repeats_in_long_texts(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    filler = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    at_edge = suffix_dedup.BLOCK_BYTES - 130
    rows = [(1, filler(100) + passage), (2, filler(at_edge) + passage + filler(700_000) + passage[:60]), (3, passage[200:])]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3).collect()
    assert sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in found), key=str) == brute_repeats(rows)


def test_large_groups_are_filtered_before_texts_move(spark, monkeypatch):
    rng = random.Random(4)
    page = [f"w{k}" for k in range(60)]
    texts = [" ".join([*page, f"x{k}"]) for k in range(6)] + [" ".join(f"o{k}.{j}" for j in range(rng.randint(3, 30))) for k in range(30)] + ["", None, "o0.0"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(0, texts[0], "clash"), (None, texts[1], "clash"), (7, None, "clash"), (7, texts[7], "clash"), (7, texts[7], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, passed string")
    told = lambda df: sorted(map(repr, df.collect()))
    kept, judged = told(near_dedup.one_of_each(docs)), told(near_dedup.near_duplicates(docs))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    assert told(near_dedup.near_duplicates(docs)) == judged and told(near_dedup.one_of_each(docs)) == kept
