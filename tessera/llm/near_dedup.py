"""MinHash near-duplicates by a chosen-path set similarity join.

1. Every text is read once and reduced to a sketch: the size and a 128-bit
   fingerprint of its shingle set, minwise tokens of 64 bits to branch on and
   COORDINATES of 16 bits to compare by. Equal sets form a class with a number
   of its own, whatever the keys of its rows; from here on a class is one
   document, so exact copies cost nothing.
2. Independent trees branch over the classes. A node holds the documents
   that share the minwise tokens chosen on the path to it; each level of each
   tree has two tokens of its own, used nowhere else, and a document goes to
   the children that its two tokens name. A pair of similarity s stays together
   down to the last level with probability (1 - (1 - s)**2)**(LEVELS + 1), and
   there are as many trees as it takes for a pair at the threshold to miss them
   all in fewer than one case in a million, even if all its nodes are crowded
   (six at 0.85, eight at 0.8). Nodes are only counted (by an aggregation that
   combines on the map side) until they hold at most LEAF documents.
3. The documents of a small node are compared exhaustively by their
   coordinates. What looks alike there is joined to candidate groups: a
   connected component of them all or, where that is too large for one task,
   the clusters of single nodes, cut into pairs of blocks where even these are.
4. Texts of grouped documents are read again, and links are confirmed on full
   shingle sets. Within a group, documents that are already connected aren't
   compared again, as that can't change a component.
5. Components of the confirmed links are found by star steps.

A node that is still crowded after LEVELS levels, or whose children would hold
as many pairs as it does, is compared as it is, whatever its size, in such a
way that a large group of near copies costs time in proportion to it:

a. It is cut into blocks of LEAF documents, and each block is compared and its
   links confirmed. Then the same is done to one document of each component
   that has come of it, for as long as that joins components.
b. The documents of one large component get blocks of their own. Every two
   blocks are compared but for those within one component, so no pair of a
   node is lost that could change a component. Only this work grows with the
   square of a node: of its documents that are linked with nothing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import mapped, text_slices
from .graph import components
from .shingles import mix, shingle_sets
from . import tables
from .tables import bitmap, sent_if_small, settled, tested

#: Similarity, in per cent, from which documents are linked.
LINK_PERCENT = 80
COORDINATES = 64
#: Standard deviations below the threshold's share of equal coordinates from
#: which a pair is a candidate.
DEVIATIONS = 5
#: Share of pairs at the threshold that may miss all trees.
MISSED = 1e-6
LEAF = 4000
LEVELS = 3
#: Documents and shingles that a group may have to be confirmed in one task.
GROUP_DOCS = 4000
GROUP_SHINGLES = 3_000_000

_FACTORS = (mix(np.arange(101, COORDINATES + 101, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def trees(percent: int) -> int:
    """Trees that keep all but MISSED of the pairs at the threshold together
    down to the last level."""
    s = percent / 100
    apart = 1 - (1 - (1 - s) ** 2) ** (LEVELS + 1)
    return max(1, math.ceil(math.log(MISSED) / math.log(apart))) if apart > 0 else 1


def branches(percent: int) -> int:
    """Minwise tokens of a sketch: two for each level of each tree."""
    return 2 * (LEVELS + 1) * trees(percent)


def alike(percent: int) -> int:
    """Equal coordinates that make a pair a candidate."""
    s = percent / 100
    return max(1, math.floor(COORDINATES * s - DEVIATIONS * math.sqrt(COORDINATES * s * (1 - s))))


def sketches(sets: list[np.ndarray], n_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (n, 2), branch tokens (n, n_tokens) and coordinates
    (n, COORDINATES) of shingle sets; zeros for empty sets."""
    n = len(sets)
    prints, tokens = np.zeros((n, 2), np.uint64), np.zeros((n, n_tokens), np.uint64)
    coordinates = np.zeros((n, COORDINATES), np.uint16)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    some = np.flatnonzero(sizes)
    if not len(some):
        return prints, tokens, coordinates
    flat = np.concatenate(sets)
    starts = (np.cumsum(sizes) - sizes)[some]
    prints[some, 0] = np.add.reduceat(flat, starts)
    prints[some, 1] = np.add.reduceat(mix(flat + np.uint64(0x165667B19E3779F9)), starts)
    seeds = mix(np.arange(1, n_tokens + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for k, seed in enumerate(seeds):
        hashed = (flat ^ (flat >> np.uint64(29))) * seed
        tokens[some, k] = np.minimum.reduceat(hashed ^ (hashed >> np.uint64(32)), starts)
    short = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    for k, factor in enumerate(_FACTORS):
        hashed = short * factor
        hashed ^= hashed >> np.uint32(16)
        hashed *= np.uint32(0x85EBCA77)
        coordinates[some, k] = (np.minimum.reduceat(hashed, starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return prints, tokens, coordinates


def sketched(docs: DataFrame, percent: int) -> DataFrame:
    """(key, text_id, n, print1, print2, tokens, coordinates) of docs (key,
    text_id, text)."""

    n_tokens = branches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                sets = shingle_sets(texts)
                prints, tokens, coordinates = sketches(sets, n_tokens)
                signed = prints.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * n_tokens, pa.int32()), pa.array(tokens.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, len(texts)) for c in ("key", "text_id")), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed[:, 0]), pa.array(signed[:, 1]), lists, pa.array([r.tobytes() for r in coordinates], pa.binary())],
                    ["key", "text_id", "n", "print1", "print2", "tokens", "coordinates"],
                )

    return mapped(docs, run, "key long, text_id long, n long, print1 long, print2 long, tokens array<long>, coordinates binary")


def by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The groups of batches whose rows are sorted by `column`, one by one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(lo, hi - lo)
            if held and lo == 0 and hi and held[0].column(column)[0].as_py() != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
            elif held and lo:
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def clusters(sizes: np.ndarray, percent: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[list[int]]:
    """Connected groups of two or more among len(sizes) items.

    `linked(p, rest)` flags the items of `rest` that p is linked with. Items
    that are connected already aren't compared with each other again; sizes
    too far apart for the similarity aren't compared at all.
    """
    rest, out = np.arange(len(sizes)), []
    while len(rest) > 1:
        group, at = [int(rest[0])], 0
        rest = rest[1:]
        while at < len(group) and len(rest):
            p = group[at]
            near = rest[(100 * sizes[rest] >= percent * sizes[p]) & (100 * sizes[p] >= percent * sizes[rest])]
            if len(near):
                new = near[linked(p, near)]
                if len(new):
                    group += new.tolist()
                    rest = np.setdiff1d(rest, new, assume_unique=True)
            at += 1
        if len(group) > 1:
            out.append(group)
    return out


def _alike(leaves: DataFrame, percent: int) -> DataFrame:
    """(node, root, doc) of the clusters in each node of leaves (node, doc, n,
    coordinates); the root, least of its cluster, is listed too."""

    least = alike(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, roots, docs = [], [], []
        for table in by_group(batches, "node"):
            ids = table.column("doc").to_numpy()
            rows = np.frombuffer(b"".join(table.column("coordinates").to_pylist()), np.uint16).reshape(-1, COORDINATES)
            node = table.column("node")[0].as_py()
            for group in clusters(table.column("n").to_numpy(), percent, lambda p, rest, rows=rows: (rows[rest] == rows[p]).sum(1) >= least):
                members = ids[group].tolist()
                nodes += [node] * len(members)
                roots += [min(members)] * len(members)
                docs += members
            if len(docs) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, roots, docs)], ["node", "root", "doc"])
                nodes, roots, docs = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, roots, docs)], ["node", "root", "doc"])

    return mapped(leaves.repartition("node").sortWithinPartitions("node", "doc"), run, "node long, root long, doc long")


def _children(node: Column, tree: Column, level: int) -> Column:
    """Keys of the children that a document goes to, by the two tokens of the
    tree's level."""
    first = 2 * ((LEVELS + 1) * tree + level)
    return F.array(*(F.xxhash64(node, c, F.col("tokens")[c]) for c in (first, first + 1)))


def _block(parts: Column, seed: int = 0) -> Column:
    """The block, of `parts`, that a document falls in."""
    return F.pmod(F.xxhash64("doc", F.lit(seed)), parts).cast("int")


def _pairs_of_blocks(size: Column, most: int, *group: Column) -> Column:
    """Keys of the pairs of blocks of `group` that a document takes part in:
    all of one block if the group has at most `most`, else half as many each."""
    parts = F.when(size <= most, 1).otherwise(F.ceil(2 * size / most)).cast("int")
    own = _block(parts)
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.xxhash64(*group, F.least(own, j), F.greatest(own, j)))


def _merged(crowded: DataFrame, sketch: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame]:
    """Links confirmed within blocks of crowded (node, doc) and of documents
    that stand for their components; and (node, doc, label) of all documents,
    the label naming the component so far."""
    links, todo, before = None, crowded, crowded.count()
    for round_ in itertools.count(1):
        sizes = todo.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
        parts = F.ceil(F.col("size") / LEAF)
        blocks = todo.join(sizes, "node").select(F.xxhash64("node", _block(parts, round_)).alias("node"), "doc")
        more = confirm(settled(_alike(blocks.join(sketch, "doc"), percent), "blocks"))
        links = settled(more if links is None else links.union(more), "merged")
        label = components(links).withColumnRenamed("node", "doc").withColumnRenamed("component", "label")
        labelled = settled(crowded.join(label, "doc", "left").select("node", "doc", F.coalesce("label", "doc").alias("label")), "labelled")
        todo = settled(labelled.groupBy("node", "label").agg(F.min("doc").alias("doc")).select("node", "doc"), "standing")
        now = todo.count()
        if 10 * now > 9 * before:
            return links, labelled
        before = now


def _grid(labelled: DataFrame) -> DataFrame:
    """(node, doc): a node for every two blocks of the nodes of labelled (node,
    doc, label), but for two blocks of one component."""
    counts = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
    # Small components of a node share blocks, under the label null.
    large = F.when(2 * F.col("c") >= LEAF, F.col("label"))
    owned = counts.select("node", "label", large.alias("owner"), "c")
    groups = settled(owned.groupBy("node", "owner").agg(F.ceil(F.sum("c") / LEAF).cast("int").alias("parts"), F.count(F.lit(1)).alias("labels")), "owners")
    mine = labelled.join(owned.select("node", "label", "owner"), ["node", "label"])
    other = groups.select("node", F.col("owner").alias("other"), F.col("parts").alias("other_parts"))
    same = F.col("owner").eqNullSafe(F.col("other"))
    # Blocks of one large component aren't compared with each other.
    pairs = groups.join(other, "node").filter(~(same & F.col("owner").isNotNull()) & ~(same & (F.col("labels") < 2)))
    at = mine.join(pairs, (mine["node"] == pairs["node"]) & mine["owner"].eqNullSafe(pairs["owner"]))
    own = F.xxhash64(pairs["owner"], _block(F.col("parts")))
    keys = F.transform(
        F.sequence(F.lit(0), F.col("other_parts") - 1),
        lambda j: F.xxhash64(mine["node"], F.least(own, F.xxhash64("other", j)), F.greatest(own, F.xxhash64("other", j))),
    )
    return at.select(F.explode(keys).alias("node"), "doc")


def _candidates(classes: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, root, doc): the clusters of all leaves of all trees; and the
    links that are confirmed already, if any.

    classes: (doc, n, tokens, coordinates).
    """
    roots = classes.select("doc", "tokens", F.explode(F.sequence(F.lit(0), F.lit(trees(percent) - 1))).alias("tree"))
    state = roots.select("doc", "tree", F.explode(_children(F.lit(-1).cast("long"), F.col("tree"), 0)).alias("node"))
    sketch = classes.select("doc", "n", "coordinates")
    found: list[DataFrame] = []
    left: list[DataFrame] = []
    for level in range(LEVELS + 1):
        state = settled(state, "nodes")
        counts = state.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = settled(state.join(counts, "node"), "sized")
        crowded = sized.filter(F.col("size") > LEAF)
        leaves = sized.filter(F.col("size") <= LEAF).select("node", "doc")
        found.append(settled(_alike(leaves.join(sketch, "doc"), percent), "alike"))
        if crowded.isEmpty():
            break
        if level == LEVELS:
            left.append(crowded.select("node", "doc"))
            break
        joined = crowded.join(classes.select("doc", "tokens"), "doc")
        child = F.explode(_children(F.col("node"), F.col("tree"), level + 1)).alias("child")
        grown = settled(joined.select("doc", "tree", "node", "size", child), "children")
        # Where branching saves no comparisons, the node is compared as it is.
        pairs = grown.groupBy("node", "size", "child").agg(F.count(F.lit(1)).alias("c"))
        pairs = pairs.groupBy("node", "size").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
        stuck = settled(pairs.filter(F.col("work") >= F.col("size") * F.col("size")).select("node"), "stuck")
        if not stuck.isEmpty():
            left.append(crowded.join(stuck, "node", "left_semi").select("node", "doc"))
        state = grown.join(stuck, "node", "left_anti").select("doc", "tree", F.col("child").alias("node"))
    links = None
    if left:
        links, labelled = _merged(settled(_all(left), "crowded"), sketch, confirm, percent)
        found.append(settled(_alike(_grid(labelled).join(sketch, "doc"), percent), "alike"))
    return _all(found), links


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _confirmed(texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links confirmed on full sets in texts (group, doc, text), as
    stars around the least document of each connected part of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "group"):
            # Rows may repeat; one of each is enough.
            ids, first = np.unique(table.column("doc").to_numpy(), return_index=True)
            sets = shingle_sets([t or "" for t in table.column("text").take(pa.array(first)).to_pylist()])
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            number = np.unique(np.concatenate(sets), return_inverse=True)[1]
            starts = np.cumsum(sizes) - sizes
            inside = np.zeros(int(number.max()) + 1 if len(number) else 0, bool)

            def linked(p: int, rest: np.ndarray, sizes=sizes, starts=starts, number=number, inside=inside) -> np.ndarray:
                own = number[starts[p] : starts[p] + sizes[p]]
                inside[own] = True
                ends = np.cumsum(sizes[rest])
                at = np.arange(ends[-1]) + np.repeat(starts[rest] - ends + sizes[rest], sizes[rest])
                both = np.add.reduceat(inside[number[at]].astype(np.int64), ends - sizes[rest])
                inside[own] = False
                return 100 * both >= percent * (sizes[rest] + sizes[p] - both)

            some = np.flatnonzero(sizes)
            a, b = [], []
            for group in clusters(sizes[some], percent, lambda p, rest, some=some, linked=linked: linked(int(some[p]), some[rest])):
                members = ids[some[group]]
                least = int(members.min())
                rest = members[members != least].tolist()
                a += [least] * len(rest)
                b += rest
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return mapped(texts.repartition("group").sortWithinPartitions("group", "doc"), run, "a long, b long")


def _links(found: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    """(a, b) links confirmed on full sets among found (node, root, doc), and
    whether they are the stars of whole components already.

    classes: (doc, n, key, text_id); rows: (key, text_id, text).
    """
    coarse = settled(components(found.select(F.col("root").alias("a"), F.col("doc").alias("b"))), "groups")
    named = coarse.withColumnRenamed("node", "doc")
    measured = [F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")]
    sizes = classes.select("doc", "n").join(named, "doc").groupBy("component").agg(*measured)
    fits = (F.col("docs") <= GROUP_DOCS) & (F.col("shingles") <= GROUP_SHINGLES)
    whole = named.join(sizes.filter(fits), "component", "left_semi").select(F.col("component").alias("group"), "doc")
    wide = named.join(sizes.filter(~fits), "component", "left_semi").select(F.col("doc").alias("root"))
    parted = found.join(wide, "root", "left_semi").distinct().join(classes.select("doc", "n"), "doc")
    # What is too large even so is confirmed by pairs of its blocks.
    weights = parted.groupBy("node", "root").agg(*measured)
    weight = F.greatest(F.col("docs") / GROUP_DOCS, F.col("shingles") / GROUP_SHINGLES)
    cells = _pairs_of_blocks(weight, 1, F.col("node"), F.col("root"))
    parted = settled(parted.join(weights, ["node", "root"]).select(F.explode(cells).alias("group"), "doc"), "parts")
    of_rows = classes.select("doc", F.col("key").alias("of_key"), F.col("text_id").alias("of_text"))
    groups = settled(whole.union(parted).join(of_rows, "doc"), "groups")
    same = F.col("key").eqNullSafe(F.col("of_key")) & (F.col("text_id") == F.col("of_text"))
    grouped = groups.count()
    if grouped > tables.BROADCAST_ROWS:
        # Texts are about to be shuffled: first leave out those of no group.
        marks = bitmap(groups.select(F.col("of_key").alias("key"), F.col("of_text").alias("text_id")), ["key", "text_id"])
        rows = tested(rows, marks, ["key", "text_id"]).filter("passed").drop("passed")
    texts = rows.join(sent_if_small(groups, grouped), same).select("group", "doc", "text")
    return settled(_confirmed(texts, percent), "links"), parted.isEmpty()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """(key, text_id, n_shingles, component_id, kept) of every row.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z
    lower-cased; a row's set is its distinct shingles of five words, or all
    its words where there are fewer. Rows whose sets have a similarity of
    `percent` (0.8 by default; over a half) or more are linked; component_id
    is the least key reachable, the row's own included. In each component the
    rows of least (key, text_id), nulls last, are kept.

    A null or empty text, or one without words, has an empty set, is linked
    with nothing and kept. A row with a null key takes part like any other, but
    names a component only where no row has a key: component_id is null there.
    Rows that share a key are judged by their own texts, told apart by text_id,
    the text's xxhash64; repeats of a row get the same verdict. Other columns
    aren't read; an empty table gives no rows. Keys are integers.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.xxhash64(F.col(text).cast("string")).alias("text_id"),
        F.col(text).cast("string").alias("text"),
    )
    sketch = settled(sketched(rows, percent), "sketches")
    same = ["print1", "print2", "n"]
    # Classes of equal sets, with the sketch of the least row.
    order = [F.col("key").isNull().alias("no_key"), "key", "text_id"]
    least = sketch.filter("n > 0").groupBy(*same).agg(F.min(F.struct(*order, "tokens", "coordinates")).alias("r"))
    numbered = least.select(F.monotonically_increasing_id().alias("doc"), *same, "r.*")
    classes = settled(numbered, "classes")

    def confirm(found: DataFrame) -> DataFrame:
        return _links(found, classes, rows, percent)[0]

    found, early = _candidates(classes, confirm, percent)
    links, stars = _links(found, classes, rows, percent)
    if early is not None or not stars:
        joined = components(links if early is None else links.union(early))
        links = joined.select(F.col("component").alias("a"), F.col("node").alias("b"))
    members = settled(links.select(F.col("b").alias("doc"), F.col("a").alias("component")).union(links.select("a", "a")).distinct(), "members")
    keeper = F.min(F.struct(*order)).alias("keeper")
    best = members.join(classes.select("doc", *order), "doc").groupBy("component").agg(keeper)
    own = F.struct(*order)
    judged = classes.join(members.join(best, "component"), "doc", "left").select(*same, F.coalesce("keeper", own).alias("keeper"))
    out = sketch.join(judged, same, "left")
    first = F.col("key").eqNullSafe(F.col("keeper.key")) & (F.col("text_id") == F.col("keeper.text_id"))
    return out.select(
        F.col("key").alias(key),
        "text_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("keeper.key")).alias("component_id"),
        ((F.col("n") == 0) | first).alias("kept"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """The rows of `docs` that near_duplicates keeps, with all their columns.

    Of rows that are kept and share both key and text, null or not, one stays.
    """
    judged = settled(near_duplicates(docs, key, text, percent).select(F.col(key).alias("its_key"), F.col("text_id").alias("its_text"), "kept"), "judged")

    own = [F.col(key).cast("long"), F.xxhash64(F.col(text).cast("string"))]

    def rows_of(some: DataFrame, how: str) -> DataFrame:
        n = some.count()

        def joined(rows: DataFrame) -> DataFrame:
            its = rows[key].cast("long").eqNullSafe(some["its_key"])
            return rows.join(sent_if_small(some, n), its & (F.xxhash64(rows[text].cast("string")) == some["its_text"]), how)

        if n <= tables.BROADCAST_ROWS:
            return joined(docs)
        # Only rows that may be among `some` are shuffled.
        marked = tested(docs.select(F.struct(*docs.columns).alias("row"), F.struct(*own).alias("own")), bitmap(some, [F.struct("its_key", "its_text")]), ["own"])
        may, not_ = (marked.filter(F.col("passed") == yes).select("row.*") for yes in (True, False))
        return joined(may).unionByName(not_) if how == "left_anti" else joined(may)

    pairs = judged.groupBy("its_key", "its_text", "kept").count()
    # Not kept, or more than once there.
    odd = settled(pairs.filter(~F.col("kept") | (F.col("count") > 1)), "odd")
    again = odd.filter("kept").select("its_key", "its_text")
    stay = rows_of(odd.select("its_key", "its_text"), "left_anti")
    return stay if again.isEmpty() else stay.union(rows_of(again, "left_semi").dropDuplicates([key, text]))
