"""N-gram Jaccard self-join of documents with signature trees, exact for every pair of different texts.

1. Each text becomes the set of its distinct word shingles (64-bit hashes). Texts with equal sets form a class, so that
   copies cost one row each and are never paired.
2. Prefix tokens deal the work: put in one order, sets of sizes n and m whose similarity is t or more share one of the
   first n - ceil(t n) + 1 tokens of either. Tokens that are frequent come last in that order, so the prefixes are rare.
   The frequent ones are found over all documents; a bounded number of them is sent to the tasks, and as any common
   order gives whole results, that bound bears on speed alone.
3. Classes that share a prefix token form a block. In it a signature tree holds in each node the OR of its members'
   token bitmaps and the range of their sizes; a traversal of two trees at once drops pairs of nodes whose largest
   possible overlap is too small. What is left links the classes to candidate groups (a spanning forest, not pairs).
   The classes of a token that has many are dealt to cells, by size and least hash; a tree over the cells' OR bitmaps and
   size ranges is traversed first, and only cells that may hold a link meet. Cells of equal members, as the tokens of
   one group of copies have them, are one.
4. Each candidate group is joined on its real sets by the same traversal with wider bitmaps, counting the tokens in
   common of the surviving pairs. Pairs that earlier links connect already need no count. Groups too large for a task
   are cut to blocks, by size and hash, and every pair of blocks with compatible sizes is a task of its own.
5. Connected components over the links (distributed star steps) give the component of each document.

Work that grows with the square of a group stays with groups of different texts that are all nearly similar, which no
exact join escapes; it is split over tasks and its output stays linear.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .common import Scratch, components, largest, lists, offsets, roots, slices, starts_of_runs, texts_of, whole_runs

U = np.uint64
#: Frequent shingles are counted in runs of this many shingles; one must occur so often in a run to be seen there.
COUNT_RUN, COUNT_LEAST = 1_000_000, 3
#: Frequent shingles sent to the tasks, at most (16 bytes each).
FREQUENT_MOST = 65_536
#: Bits of a bitmap: a power of two, a multiple of the set's size within these bounds.
BITS_LEAST, BITS_MOST = 64, 32_768
LEAF, FAN = 32, 8
#: Members of a cell of bitmaps; the classes of a token that has more make up several cells.
CELL = 512
#: Members of a block of real sets, and tokens in it.
BLOCK, BLOCK_TOKENS = 512, 200_000


# --- sets -----------------------------------------------------------------------------------------------------------


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    w = T.words(texts_of(batch.column("text")))
    return T.distinct(*T.shingles(T.hashes(w), w.bounds, size))


def _keys(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set, in two words."""

    def total(y: np.ndarray) -> np.ndarray:
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(y, dtype=np.uint64)))
        return c[bounds[1:]] - c[bounds[:-1]]

    n = np.diff(bounds).astype(np.uint64)
    return T.mix(total(T.mix(x ^ T.MUL_A)) + n), T.mix(total(T.mix(x + T.MUL_B)) + n * T.MUL_A)


def bits_for(n: np.ndarray, times: int) -> np.ndarray:
    """Width of the bitmap of a set of n tokens."""
    wide = np.exp2(np.ceil(np.log2(np.maximum(n, 1) * times))).astype(np.int64)
    return np.clip(wide, BITS_LEAST, BITS_MOST)


def bitmap(x: np.ndarray, bits: int) -> np.ndarray:
    """A token sets the bit at its hash modulo bits, so that the OR of a map's halves is the map of half the width."""
    out = np.zeros(bits, bool)
    out[(T.mix(x) % U(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) of fewer words that the same tokens give."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


# --- signature trees ------------------------------------------------------------------------------------------------


class Node:
    __slots__ = ("hi", "kids", "lo", "map", "rows", "spare")

    def __init__(self, rows, kids, lo, hi, spare, joined):
        self.rows, self.kids, self.lo, self.hi, self.spare, self.map = rows, kids, lo, hi, spare, joined


class Tree:
    """Sizes and bitmaps (of one width) of the members of a block, in a tree over their order by size."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, order: np.ndarray | None = None):
        self.sizes, self.maps = sizes, maps
        self.spare = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)  # tokens that share a bit with another
        order = np.lexsort((maps[:, 0], sizes)) if order is None else order
        self.root = rooted([self._node(order[i : i + LEAF], []) for i in range(0, len(order), LEAF)])

    def _node(self, rows: np.ndarray, kids: list) -> Node:
        return Node(rows, kids, int(self.sizes[rows].min()), int(self.sizes[rows].max()), int(self.spare[rows].max()), np.bitwise_or.reduce(self.maps[rows], 0))


def over(kids: list[Node]) -> Node:
    return Node(None, kids, min(k.lo for k in kids), max(k.hi for k in kids), max(k.spare for k in kids), np.bitwise_or.reduce([k.map for k in kids], 0))


def rooted(nodes: list[Node]) -> Node:
    """The root of a tree over nodes in the order that they come in."""
    while len(nodes) > 1:
        nodes = [over(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
    return nodes[0]


def possible(overlap, least_sizes, percent: int):
    """Whether 100 * overlap >= percent * (sizes - overlap) can hold."""
    return (100 + percent) * overlap >= percent * least_sizes


def meet(one: Node, two: Node, percent: int) -> Iterator[tuple[Node, Node]]:
    """Pairs of leaves below two nodes (each pair once if they are one) that their bitmaps and sizes let hold a link."""
    same = one is two
    stack = [(one, two)]
    while stack:
        x, y = stack.pop()
        if 100 * min(x.hi, y.hi) < percent * max(x.lo, y.lo):
            continue
        most = min(int(np.bitwise_count(x.map & y.map).sum()) + min(x.spare, y.spare), x.hi, y.hi)
        if not possible(most, x.lo + y.lo, percent):
            continue
        if x.kids and (not y.kids or x.hi - x.lo >= y.hi - y.lo or x is y):
            if same and x is y:
                stack += [(p, q) for i, p in enumerate(x.kids) for q in x.kids[i:]]
            else:
                stack += [(k, y) for k in x.kids]
        elif y.kids:
            stack += [(x, k) for k in y.kids]
        else:
            yield x, y


def traverse(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a and b (each pair once if the trees are one) that their bitmaps and sizes let link."""
    same = a is b
    for x, y in meet(a.root, b.root, percent):
        i, j = np.repeat(x.rows, len(y.rows)), np.tile(y.rows, len(x.rows))
        if x is y and same:
            i, j = i[i < j], j[i < j]
        keep = linkable(a.maps, a.sizes, b.maps, b.sizes, i, j, percent)
        if keep.any():
            yield i[keep], j[keep]


def linkable(maps_a, sizes_a, maps_b, sizes_b, i, j, percent: int) -> np.ndarray:
    """Of pairs of members: a token whose bit the other lacks isn't in the other."""
    p, q = maps_a[i], maps_b[j]
    common = p & q
    both = np.bitwise_count(common).sum(1).astype(np.int64)
    n, m = sizes_a[i], sizes_b[j]
    most = np.minimum(n - (np.bitwise_count(p).sum(1) - both), m - (np.bitwise_count(q).sum(1) - both))
    return possible(np.minimum(most, np.minimum(n, m)), n + m, percent)


# --- blocks of bitmaps ----------------------------------------------------------------------------------------------


def _forest(sizes: np.ndarray, maps: list[np.ndarray], side: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from rows to the first row of their group, over what the bitmaps let link in each block bounds[k]:bounds[k + 1].

    A block of two sides gives only the links that join groups across the sides: each side is a block of its own as well.
    """
    links: list[tuple[np.ndarray, np.ndarray]] = []
    width = np.array([len(m) for m in maps])
    small: list[tuple[int, int]] = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s <= LEAF:
            small.append((s, e))
            continue
        for w in np.unique(width[s:e]):  # a tree for each width; trees of different widths meet at the smaller one
            rows = s + np.flatnonzero(width[s:e] == w)
            links += _within(sizes, maps, rows, rows, int(w), percent)
            for v in np.unique(width[s:e]):
                if v > w:
                    links += _within(sizes, maps, rows, s + np.flatnonzero(width[s:e] == v), int(w), percent)
    if small:  # leaves: all of a batch at once
        i = np.concatenate([np.repeat(np.arange(a, b), np.arange(b - a - 1, -1, -1)) for a, b in small])
        reach = np.concatenate([np.arange(b - a - 1, -1, -1) for a, b in small])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
        w = np.minimum(width[i], width[j])
        for v in np.unique(w):
            at = np.flatnonzero(w == v)
            for part in np.array_split(at, max(1, len(at) * int(v) // 500_000)):
                p = np.concatenate([fold(maps[k][None], int(v)) for k in i[part]])
                q = np.concatenate([fold(maps[k][None], int(v)) for k in j[part]])
                index = np.arange(len(part))
                keep = linkable(p, sizes[i[part]], q, sizes[j[part]], index, index, percent)
                links.append((i[part][keep], j[part][keep]))
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])
    label = roots(len(sizes), i, j)
    same = side[i] == side[j]
    inner = roots(len(sizes), i[same], j[same])
    two = np.repeat([side[e - 1] == 1 for e in bounds[1:]], np.diff(bounds))
    row = np.flatnonzero((label != np.arange(len(sizes))) & (~two | (inner == np.arange(len(sizes)))))
    return row, label[row]


def _within(sizes, maps, rows, others, words, percent):
    a = Tree(sizes[rows], np.concatenate([fold(maps[k][None], words) for k in rows]))
    b = a if others is rows else Tree(sizes[others], np.concatenate([fold(maps[k][None], words) for k in others]))
    return [(rows[i], others[j]) for i, j in traverse(a, b, percent)]


# --- real sets ------------------------------------------------------------------------------------------------------


def _links(ids: np.ndarray, side: np.ndarray, x: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a forest) between the sets of one task: within side 0, or between sides 0 and 1 if both are there."""
    sizes = np.diff(bounds)
    bits = int(bits_for(np.array([sizes.max()]), 8)[0])
    maps = np.stack([bitmap(x[s:e], bits) for s, e in zip(bounds[:-1], bounds[1:], strict=True)])
    rows = [np.flatnonzero(side == k) for k in (0, 1)]
    a = Tree(sizes[rows[0]], maps[rows[0]])
    b = Tree(sizes[rows[1]], maps[rows[1]]) if len(rows[1]) else a
    other = rows[1] if len(rows[1]) else rows[0]
    group = np.arange(len(ids))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = k = group[group[k]]
        return k

    def join(one: Tree, two: Tree, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for i, j in traverse(one, two, percent):
            for p, q in zip(left[i].tolist(), right[j].tolist(), strict=True):
                rp, rq = root(p), root(q)
                if rp == rq:
                    continue
                y, z = x[bounds[p] : bounds[p + 1]], x[bounds[q] : bounds[q + 1]]
                if len(y) > len(z):
                    y, z = z, y
                at = np.searchsorted(z, y)
                common = int((z[np.minimum(at, len(z) - 1)] == y).sum())
                if 100 * common >= percent * (len(y) + len(z) - common):
                    group[rq] = rp
                    out.append((p, q))
        return out

    if b is not a:  # links inside the sides are other tasks' to tell; known here, they leave few to look for across
        join(a, a, rows[0], rows[0])
        join(b, b, rows[1], rows[1])
    pairs = np.array(join(a, b, rows[0], other), np.int64).reshape(-1, 2)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


# --- the operator ---------------------------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row of docs.

    Two documents link when their sets of distinct `size`-word shingles (words are parted by ASCII white space, A-Z in
    lower case) have a Jaccard similarity of percent / 100 or more; shorter texts have one shingle, the whole sequence.
    component_id is the smallest id reachable by links, class_id the smallest id with the very same set.

    Null, empty and blank texts: n_shingles 0, linked with nothing, component_id the own id. A null id: the row is
    returned, with null component_id, and links with nothing. Repeated rows: each is returned, in one component. Rows
    that repeat an id with another text each have the component of their own text; where such an id is the smallest of
    both texts' classes it is one vertex, with the links of both. Other columns are ignored, whatever their names. No rows: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    heavy, rank = _frequent(docs, size, scratch)
    sent = spark.sparkContext.broadcast((heavy, rank))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                x, bounds = _sets(part, size)
                n = np.diff(bounds)
                k1, k2 = _keys(x, bounds)
                tokens, cut = _prefixes(x, bounds, heavy, rank, percent)
                wide = bits_for(n, 1)
                maps = [bitmap(x[s:e], w).tobytes() for s, e, w in zip(bounds[:-1], bounds[1:], wide.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(_least(x, bounds).view(np.int64)), pa.array(maps, pa.binary()), lists(tokens.view(np.int64), cut, pa.int64())], ["doc_id", "n", "k1", "k2", "least", "map", "prefix"])

    made = scratch.write(docs.mapInArrow(sets, "doc_id long, n long, k1 long, k2 long, least long, map binary, prefix array<long>"), "sets")
    some = made.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.write(some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # a class is known by its smallest id from here on
    mine = some.join(classes, ["k1", "k2", "n"]).where("doc_id = rep").dropDuplicates(["rep", "k1", "k2"]).select("rep", "n", "least", "map", "prefix")
    mine = scratch.write(mine, "mine")
    dealt = mine.select(F.explode("prefix").alias("token"), "rep", "n", "least")
    many = scratch.write(dealt.groupBy("token").agg(F.count("*").alias("of")).where(F.col("of") > CELL), "many")
    blocks = dealt.join(many, "token", "left_anti").select("token", "rep").repartition(F.col("token")).sortWithinPartitions("token", "rep").mapInArrow(_blocks, "block long, members array<long>")
    blocks = blocks.groupBy("block").agg(F.first("members").alias("members"))
    rows = blocks.selectExpr("block", "0 AS side", "explode(members) AS rep").join(mine.select("rep", "n", "map"), "rep").select("block", "side", "rep", "n", "map")
    if not many.isEmpty():
        rows = rows.union(_cells(dealt.join(many, "token"), mine.select("rep", "n", "map"), percent, scratch))
    near = rows.repartition(F.col("block")).sortWithinPartitions("block", "side", "rep").mapInArrow(_near(percent), "a long, b long")
    near = scratch.write(near.distinct(), "near")
    scratch.drop("mine", "many", "cells", "celled", "members", "ors", "pairs")
    groups = scratch.write(components(near, scratch, "groups"), "groups")

    links = scratch.write(_exact(docs, groups.join(classes.selectExpr("rep AS node", "n", "k1", "k2"), "node"), size, percent, scratch), "links")
    labels = scratch.write(components(links, scratch, "labels"), "labels")
    found = classes.join(labels.selectExpr("node AS rep", "label"), "rep", "left").selectExpr("k1", "k2", "n", "rep", "coalesce(label, rep) AS label", "true AS known")
    out = made.select("doc_id", "n", "k1", "k2").join(found, ["k1", "k2", "n"], "left")
    blank = "n = 0 OR doc_id IS NULL"
    return out.selectExpr("doc_id", "n AS n_shingles", f"CASE WHEN {blank} THEN doc_id ELSE label END AS component_id", f"CASE WHEN {blank} THEN doc_id ELSE rep END AS class_id")


def _frequent(docs: DataFrame, size: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (sorted) and the rank of each, 1 or more: the logarithm of its count over all documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            y = np.concatenate(held)
            y.sort()
            at = starts_of_runs(y)
            n = np.diff(at)
            keep = n >= COUNT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(y[at[:-1]][keep].view(np.int64)), pa.array(n[keep], pa.int64())], ["token", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                x, _ = _sets(part, size)
                held.append(x)
                total += len(x)
                if total >= COUNT_RUN:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    counts = scratch.write(docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    top = largest(counts, "token", FREQUENT_MOST).toArrow()
    token = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], (1 + np.log2(top.column("n").to_numpy().astype(np.float64))).astype(np.int64)[order]


def _prefixes(x, bounds, heavy, rank, percent):
    """Prefix tokens of each set: rare before frequent, then by hash."""
    n = np.diff(bounds)
    length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
    order = np.arange(len(x))
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, x), len(heavy) - 1)
        r = np.where(heavy[at] == x, rank[at], 0)
        hit = np.unique(np.searchsorted(bounds, np.flatnonzero(r), side="right") - 1)
        for k in hit.tolist():  # others are in order already
            s, e = int(bounds[k]), int(bounds[k + 1])
            order[s:e] = s + np.argsort(r[s:e], kind="stable")
    cut = np.concatenate(([0], np.cumsum(length)))
    take = np.repeat(bounds[:-1] - cut[:-1], length) + np.arange(cut[-1])
    return x[order[take]], cut


def _least(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least hash of each set: near copies mostly have the same one."""
    out, some = np.zeros(len(bounds) - 1, np.uint64), np.diff(bounds) > 0
    if some.any():
        out[some] = np.minimum.reduceat(T.mix(x ^ T.MUL_C), bounds[:-1][some])
    return out


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token and class: the members of each token that has two or more, CELL at most.

    A block's id hashes its members: blocks of equal members become one.
    """
    for t in whole_runs(batches, "token"):
        token, rep = t.column("token").to_numpy(), t.column("rep").to_numpy()
        at = starts_of_runs(token)
        count = np.diff(at)
        pick = np.flatnonzero(count >= 2)
        if not len(pick):
            continue
        starts, sizes = at[pick], count[pick]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        members = rep[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(members.view(np.uint64) + T.MUL_A), dtype=np.uint64)))
        block = T.mix(c[bounds[1:]] - c[bounds[:-1]] + sizes.astype(np.uint64))
        keep = np.zeros(len(block), bool)
        keep[np.unique(block, return_index=True)[1]] = True  # of those within a batch, at once
        yield pa.RecordBatch.from_arrays([pa.array(block[keep].view(np.int64)), lists(members[np.repeat(keep, sizes)], np.concatenate(([0], np.cumsum(sizes[keep]))), pa.int64())], ["block", "members"])


def _cells(dealt: DataFrame, maps: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(block, side, rep, n, map) of the pairs of cells that may hold a link, from the classes of tokens that have many.

    dealt: (token, rep, n, least, of), maps: (rep, n, map). A token's classes are parted by a step of their size and ranges of their least hash,
    and cut there to cells of CELL; no step holds a token's classes in one task.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    parts = F.greatest(F.lit(1).cast("long"), F.expr(f"of div {8 * CELL}"))
    keyed = dealt.withColumn("step", step).withColumn("part", F.pmod("least", parts))
    place = F.row_number().over(Window.partitionBy("token", "step", "part").orderBy("least", "rep")) - 1
    keyed = keyed.withColumn("cell", F.xxhash64("token", "step", "part", F.floor(place / CELL))).select("token", "cell", "rep").distinct()
    celled = scratch.write(keyed, "celled")
    cells = celled.groupBy("token", "cell").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.count("*").alias("c"))
    cells = scratch.write(cells.select("token", "cell", F.xxhash64("x", "y", "c").alias("members")), "cells")
    # cells of equal members are one, and so are tokens of equal cells
    named = cells.groupBy("members").agg(F.min("cell").alias("cell"))
    held = scratch.write(celled.join(named, "cell").select("members", "rep").distinct().join(maps, "rep"), "members")
    ors = scratch.write(held.repartition(F.col("members")).sortWithinPartitions("members").mapInArrow(_joined, "members long, lo long, hi long, spare long, map binary"), "ors")
    cells = cells.select("token", "members").distinct()
    tokens = cells.groupBy("token").agg(F.bit_xor(F.xxhash64("members")).alias("x"), F.bit_xor(F.xxhash64("members", F.lit(1))).alias("y"), F.count("*").alias("c")).groupBy("x", "y", "c").agg(F.min("token").alias("token")).select("token")
    listed = cells.join(tokens, "token").join(ors, "members")
    pairs = scratch.write(listed.repartition(F.col("token")).sortWithinPartitions("token", "lo", "members").mapInArrow(_pairs(percent), "a long, b long").distinct(), "pairs")
    pairs = pairs.select("a", "b", F.xxhash64("a", "b").alias("block"))
    left = pairs.join(held, pairs["a"] == held["members"]).selectExpr("block", "0 AS side", "rep", "n", "map")
    right = pairs.where("a <> b").join(held, F.col("b") == held["members"]).selectExpr("block", "1 AS side", "rep", "n", "map")
    return left.union(right)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell the OR of its bitmaps, at the width of the narrowest, the sizes' range, and the most tokens that share a bit."""
    for t in whole_runs(batches, "members"):
        members, n = t.column("members").to_numpy(), t.column("n").to_numpy()
        maps = [np.frombuffer(m, np.uint64) for m in t.column("map").to_pylist()]
        at = starts_of_runs(members)
        out = []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            words = min(len(m) for m in maps[s:e])
            some = np.concatenate([fold(m[None], words) for m in maps[s:e]])
            spare = int((n[s:e] - np.bitwise_count(some).sum(1).astype(np.int64)).max())
            out.append((int(members[s]), int(n[s:e].min()), int(n[s:e].max()), spare, np.bitwise_or.reduce(some, 0).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], ["members", "lo", "hi", "spare", "map"])


def _pairs(percent: int):
    """From the cells of each token: a tree over them, and the pairs of cells that it lets hold a link, each with itself too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "token"):
            members, lo, hi, spare = (t.column(c).to_numpy() for c in ("members", "lo", "hi", "spare"))
            maps = [np.frombuffer(m, np.uint64) for m in t.column("map").to_pylist()]
            at = starts_of_runs(t.column("token").to_numpy())
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = min(len(m) for m in maps[s:e])
                nodes = []
                for k in range(s, e):  # a map that is folded has more tokens that share a bit: as many as bits went, at most
                    m = fold(maps[k][None], words)[0]
                    nodes.append(Node(np.array([k]), [], int(lo[k]), int(hi[k]), int(hi[k]) if len(maps[k]) > words else int(spare[k]), m))
                root = rooted(nodes)
                found = [(int(members[x.rows[0]]), int(members[y.rows[0]])) for x, y in meet(root, root, percent)]
                for k in range(0, len(found), 100_000):
                    a, b = np.array(found[k : k + 100_000], np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _near(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "block"):
            rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
            maps = [np.frombuffer(m, np.uint64) for m in t.column("map").to_pylist()]
            row, root = _forest(n, maps, t.column("side").to_numpy(), starts_of_runs(t.column("block").to_numpy()), percent)
            yield pa.RecordBatch.from_arrays([pa.array(rep[row]), pa.array(rep[root])], ["a", "b"])

    return run


def _exact(docs: DataFrame, near: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b), a spanning forest of each task's, between the classes (node, label, n, k1, k2) of candidate groups."""

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, bounds = _sets(part, size)
                k1, k2 = _keys(x, bounds)
                ok = pa.array((k1.view(np.int64) == part.column("k1").to_numpy()) & (k2.view(np.int64) == part.column("k2").to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("label"), part.column("n"), part.column("k1"), part.column("k2"), lists(x.view(np.int64), bounds, pa.int64())], ["node", "label", "n", "k1", "k2", "tokens"]).filter(ok)

    texts = docs.join(near.withColumnRenamed("node", "doc_id"), "doc_id").selectExpr("doc_id AS node", "label", "n", "k1", "k2", "text")
    held = scratch.write(texts.mapInArrow(again, "node long, label long, n long, k1 long, k2 long, tokens array<long>").dropDuplicates(["node", "k1", "k2"]).drop("k1", "k2"), "held")

    # blocks of a group: by size (a step of the logarithm to base 100 / percent), then by hash; small groups are one block
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    keyed = held.select("node", "label", "n", step.alias("step"))
    whole = keyed.groupBy("label").agg(F.count("*").alias("of"), F.sum("n").alias("sum"))
    large = whole.where(f"of > {2 * BLOCK} OR sum > {2 * BLOCK_TOKENS}").select("label", F.lit(True).alias("large"))
    parts = keyed.join(large, "label").groupBy("label", "step").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("parts"))
    parts = scratch.write(parts, "parts")
    lone = held.join(parts.select("label").distinct(), "label", "left_anti").selectExpr("label AS task0", "0 AS task1", "0 AS task2", "0 AS task3", "0 AS task4", "0 AS side", "node", "tokens")
    # each block meets itself, the later ones of its step, and those of the next step; rounding is met by one step more
    split = held.withColumn("step", step).join(parts, ["label", "step"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    after = parts.selectExpr("label", "step - 1 AS step", "parts AS next1")
    later = parts.selectExpr("label", "step - 2 AS step", "parts AS next2")
    before = parts.selectExpr("label", "step + 1 AS step", "parts AS last1")
    earlier = parts.selectExpr("label", "step + 2 AS step", "parts AS last2")
    for side in (after, later, before, earlier):
        split = split.join(side, ["label", "step"], "left")
    first = "transform(sequence(part, parts - 1), q -> struct(step AS s, part AS p, step AS t, q AS q, 0 AS side))"
    second = "transform(sequence(0, part), p -> struct(step AS s, p AS p, step AS t, part AS q, 1 AS side))"
    out = [f"{first}", f"filter({second}, c -> c.p < c.q)"]
    out += [f"transform(CASE WHEN next{k} > 0 THEN sequence(0, next{k} - 1) ELSE array() END, q -> struct(step AS s, part AS p, step + {k} AS t, q AS q, 0 AS side))" for k in (1, 2)]
    out += [f"transform(CASE WHEN last{k} > 0 THEN sequence(0, last{k} - 1) ELSE array() END, p -> struct(step - {k} AS s, p AS p, step AS t, part AS q, 1 AS side))" for k in (1, 2)]
    split = split.select("label", "node", "tokens", F.explode(F.expr(f"concat({', '.join(out)})")).alias("c")).selectExpr("label AS task0", "1 + c.s AS task1", "c.p AS task2", "1 + c.t AS task3", "c.q AS task4", "c.side AS side", "node", "tokens")
    tasks = lone.union(split).withColumn("task", F.xxhash64("task0", "task1", "task2", "task3", "task4"))

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "task"):
            t = t.combine_chunks()
            task, node, side = (t.column(c).to_numpy() for c in ("task", "node", "side"))
            column = t.column("tokens").chunk(0)
            bounds = offsets(column)
            x = column.values.to_numpy().view(np.uint64)
            at = starts_of_runs(task)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - s > 1 and (side[s:e] == 0).any():
                    p, q = _links(node[s:e], side[s:e], x[bounds[s] : bounds[e]], bounds[s : e + 1] - bounds[s], percent)
                    a.append(p)
                    b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return tasks.select("task", "side", "node", "tokens").repartition(F.col("task")).sortWithinPartitions("task", "side", "node").mapInArrow(link, "a long, b long").distinct()
