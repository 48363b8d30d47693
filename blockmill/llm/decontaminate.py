"""Benchmark decontamination by spaced seeds.

A mask names a few positions of a short stretch of words; a seed hashes the words at those positions, so that
substitutions at the others don't change it. The benchmark's seeds are joined with those of the documents; around each
hit the aligned words are compared, and a window of the item with enough equal words is a leak. The three masks find every
window of 13 words with 3 substitutions (tested over all patterns), which is all that 75 % allow. Where other windows or
shares allow patterns that the masks miss, a run of words that every pattern leaves whole is a further mask.

Words are runs of letters and digits (any non-ASCII character counts as a letter) with A-Z in lower case, so that marks
and case don't hide a passage.

Windows that the same items hold are one passage, whose id is a hash of those items' ids, and a document gives a row for
each passage that it shares, so that a passage that many items and many documents share does not give their product;
`passage_items` tells the items of those that several hold, and the two together all links. A window that several items
hold is met once, as that of the smallest id, and before all others: a document that holds it is not compared with the
windows that those items alone hold. Items that hold one window also make up a class, whose id is the smallest of theirs
(`item_classes`).

The benchmark's side of the join is held in the tasks in slices of a bounded number of words; a benchmark beyond the bound
is met slice after slice, each over all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import Scratch, components, roots, slices, texts_of

U = np.uint64
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7), (0, 1, 2, 4))
WINDOW, PERCENT = 13, 75
#: Items of fewer words hold no evidence and are not looked for; items below WINDOW are one window, and match whole.
LEAST_WORDS = 5
#: Words of the benchmark in one slice (about 80 bytes each with the three masks' seeds).
SLICE_WORDS = 1_000_000
FILTER_BITS = 22
#: Seed hits that are looked at together.
HITS = 2_000_000
SCHEMA = "doc_id long, class_id long, item_id long, doc_start int, item_start int, window int, matched int, n_items int, passage_id long"


@dataclass
class Index:
    items: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    masks: list[tuple[int, ...]]
    classes: np.ndarray  # of each item
    windows: np.ndarray  # of each item, the first of its windows in the two lists that follow
    own: np.ndarray  # 0 for a window that belongs to another item, 1 if no other item holds it, else 2
    held: np.ndarray  # how many items hold it
    passage: np.ndarray  # the number of its passage
    passages: np.ndarray  # the passages' ids
    members: np.ndarray  # sorted, of passages that several items hold: the passage's number times the items, plus the item
    seeds: list[np.ndarray]  # by mask, those that windows of several items need, then those that other windows need
    item: list[np.ndarray]
    at: list[np.ndarray]
    filter: np.ndarray


def seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed of the mask at each position that has room for it; the caller drops those that cross texts."""
    n = max(0, len(h) - mask[-1])
    x = np.zeros(n, np.uint64)
    for k in mask:
        x *= T.MUL_A
        x += h[k : n + k]
    x ^= x >> U(29)
    x *= T.MUL_B
    return x


def complete(masks: Iterable[tuple[int, ...]], window: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """The masks, and one more if some pattern of the substitutions that percent allows leaves no seed of theirs."""
    masks, bad = tuple(masks), window + (-percent * window // 100)
    places = [{s + o for o in m} for m in masks for s in range(window - m[-1])]

    def missed(left: list[set[int]], n: int) -> bool:  # can n substitutions meet each place?
        return not left or n > 0 and any(missed([p for p in left if x not in p], n - 1) for x in left[0])

    # bad substitutions cut the other words to bad + 1 runs at most; beyond 6 the patterns are too many to try
    return (*masks, tuple(range(max(1, -(-(window - bad) // (bad + 1)))))) if bad > 6 or missed(places, bad) else masks


def _codes(items: np.ndarray) -> np.ndarray:
    """Of ids; a passage's id is the exclusive or of its items' codes."""
    return T.mix(items.astype(np.int64).view(np.uint64) * T.MUL_A + T.MUL_C)


def build(items: list[int], texts: list[bytes], masks: Iterable[tuple[int, ...]] = MASKS, window: int = WINDOW, classes: list[int] | None = None) -> Index:
    """classes: of each item; by default the smallest id of the items that are linked by windows that several hold."""
    order = np.argsort(np.array(items, np.int64), kind="stable")
    items, texts = np.array(items, np.int64)[order], [texts[k] for k in order]
    w = T.words(texts, parts=T.MARKS)
    h, n = T.hashes(w), np.diff(w.bounds)
    short = sorted({int(k) for k in n if LEAST_WORDS <= k < window})
    x, first = T.shingles(h, w.bounds, window)
    owner = np.repeat(np.arange(len(items)), np.diff(first))
    one = np.unique(np.stack([x, owner.astype(np.uint64)], 1), axis=0)  # a row for each window and item that holds it
    kinds, begin, held = np.unique(one[:, 0], return_index=True, return_counts=True)
    of = one[:, 1].astype(np.int64)
    named = items[roots(len(items), of, np.repeat(of[begin], held))] if classes is None else np.array(classes, np.int64)[order]
    kind = np.searchsorted(kinds, x)
    # texts of one id are one item here
    new = np.ones(len(one), bool)
    new[1:] = (one[1:, 0] != one[:-1, 0]) | (items[of[1:]] != items[of[:-1]])
    passages, number = np.unique(np.bitwise_xor.reduceat(np.where(new, _codes(items)[of], U(0)), begin) if len(begin) else kinds, return_inverse=True)
    several = np.repeat(held > 1, held)
    members = np.unique(np.repeat(number, held)[several] * len(items) + of[several])
    own = np.where(of[begin][kind] == owner, np.where(held[kind] > 1, 2, 1), 0)
    out = Index(items, h, w.bounds, [*masks, *(tuple(range(k)) for k in short)], named, first, own, held[kind], number[kind], passages.view(np.int64), members, [], [], [], np.zeros(1 << FILTER_BITS, bool))
    doc = w.doc()
    for kind in (2, 1):
        owned = np.concatenate(([0], np.cumsum(own == kind)))
        for m, mask in enumerate(out.masks):
            x = seeds(h, mask)
            ok = doc[: len(x)] == doc[mask[-1] : mask[-1] + len(x)]
            size = n[doc[: len(x)]]
            ok &= size >= window if m < len(out.masks) - len(short) else size == len(mask)
            at = np.flatnonzero(ok)
            # seeds that no such window of the item covers are not needed
            place, wide = at - w.bounds[doc[at]], np.minimum(n[doc[at]], window)
            lo, hi = np.maximum(0, place + mask[-1] - wide + 1), np.minimum(place, n[doc[at]] - wide)
            at = at[owned[first[doc[at]] + hi + 1] > owned[first[doc[at]] + lo]]
            order = at[np.argsort(x[at], kind="stable")]
            out.seeds.append(x[order])
            out.item.append(doc[order].astype(np.int64))
            out.at.append((order - w.bounds[doc[order]]).astype(np.int64))
            out.filter[(x[at] >> U(64 - FILTER_BITS)).astype(np.int64)] = True
    return out


def _alignments(index: Index, w: T.Words, hits: list[tuple[np.ndarray, np.ndarray]], kind: int) -> Iterator[np.ndarray]:
    """(text, item, shift) of seed hits, some at a time; one may come several times."""
    for m, (mask, (x, at)) in enumerate(zip(index.masks, hits, strict=True)):
        k = m + (0 if kind == 2 else len(index.masks))
        if not len(index.seeds[k]):
            continue
        lo, hi = np.searchsorted(index.seeds[k], x), np.searchsorted(index.seeds[k], x, side="right")
        some, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        text = np.searchsorted(w.bounds, some, side="right") - 1
        inside = some + mask[-1] < w.bounds[text + 1]
        some, lo, hi, text = some[inside], lo[inside], hi[inside], text[inside]
        upto = np.cumsum(hi - lo)
        for begin in range(0, int(upto[-1]) if len(upto) else 0, HITS):
            e = np.arange(begin, min(begin + HITS, int(upto[-1])))
            hit = np.searchsorted(upto, e, side="right")
            e = hi[hit] - (upto[hit] - e)
            yield np.unique(np.stack([text[hit], index.item[k][e], some[hit] - index.at[k][e]], 1), axis=0)


def find(index: Index, texts: list[bytes], window: int = WINDOW, percent: int = PERCENT) -> dict[str, np.ndarray]:
    """Leaks: for each text and passage that it shares, the best window, but for items whose shared passages it has."""
    w = T.words(texts, parts=T.MARKS)
    h = T.hashes(w)
    hits = []
    for mask in index.masks:
        x = seeds(h, mask)
        at = np.flatnonzero(index.filter[(x >> U(64 - FILTER_BITS)).view(np.int64)])
        hits.append((x[at], at))
    names = ("text", "class", "item", "doc_start", "item_start", "window", "matched", "n_items", "passage")
    empty = {k: np.zeros(0, np.int64) for k in names}
    # windows of several items first; they link the text with all items that hold them
    shared = _best([empty, *(f for keys in _alignments(index, w, hits, 2) for f in _passing(index, w, h, keys, window, percent, 2))])
    return _best([shared, *(f for keys in _alignments(index, w, hits, 1) for f in _passing(index, w, h, keys[~_linked(index, shared, keys)], window, percent, 1))])


def _linked(index: Index, shared: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Whether the text of an alignment has a passage that the item holds with others."""
    lo, hi = np.searchsorted(shared["text"], keys[:, 0]), np.searchsorted(shared["text"], keys[:, 0], side="right")
    out, upto = np.zeros(len(keys), bool), np.cumsum(hi - lo)
    for begin in range(0, int(upto[-1]) if len(upto) else 0, HITS):
        e = np.arange(begin, min(begin + HITS, int(upto[-1])))
        key = np.searchsorted(upto, e, side="right")
        member = shared["passage"][hi[key] - (upto[key] - e)] * len(index.items) + keys[key, 1]
        at = np.minimum(np.searchsorted(index.members, member), len(index.members) - 1)
        out[key[index.members[at] == member]] = True
    return out


def _best(found: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Of each text and passage the window of most equal words; of those the first."""
    out = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    order = np.lexsort((out["doc_start"], out["item_start"], out["item"], -out["matched"], out["passage"], out["text"]))
    text, passage = out["text"][order], out["passage"][order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (passage[1:] != passage[:-1])
    return {k: v[order[new]] for k, v in out.items()}


def _passing(index: Index, w: T.Words, h: np.ndarray, keys: np.ndarray, window: int, percent: int, kind: int) -> Iterator[dict[str, np.ndarray]]:
    """The best windows of a kind that pass, of each text and passage, some alignments at a time."""
    for part in np.array_split(keys, max(1, len(keys) // 20_000)):
        found = _verify(index, w, h, part, window, percent, kind)
        if found is not None:
            yield _best([found])


def _verify(index: Index, w: T.Words, h: np.ndarray, keys: np.ndarray, window: int, percent: int, kind: int) -> dict[str, np.ndarray] | None:
    """The windows of a kind that pass in each alignment."""
    if not len(keys):
        return None
    text, item, shift = keys.T
    n = index.bounds[item + 1] - index.bounds[item]
    # the part of the item that lies in the text
    lo = np.maximum(0, w.bounds[text] - shift)
    hi = np.minimum(n, w.bounds[text + 1] - shift)
    size = np.minimum(n, window)
    ok = hi - lo >= size
    text, item, shift, lo, hi, size, n = (x[ok] for x in (text, item, shift, lo, hi, size, n))
    if not len(text):
        return None
    length = hi - lo
    cut = np.concatenate(([0], np.cumsum(length)))
    j = np.arange(cut[-1]) - np.repeat(cut[:-1], length) + np.repeat(lo, length)
    equal = h[np.repeat(shift, length) + j] == index.words[np.repeat(index.bounds[item], length) + j]
    total = np.concatenate(([0], np.cumsum(equal)))
    places = length - size + 1
    start = np.repeat(cut[:-1], places) + np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
    wide = np.repeat(size, places)
    matched = total[start + wide] - total[start]
    least = np.where(size < window, 100, percent)  # short items match whole
    at = np.repeat(index.windows[item], places) + j[start]
    pick = np.flatnonzero((100 * matched >= np.repeat(least, places) * wide) & (index.own[at] == kind))
    of = np.repeat(np.arange(len(text)), places)[pick]
    begin = j[start[pick]]
    return {"text": text[of], "class": index.classes[item[of]], "item": item[of], "doc_start": shift[of] + begin - w.bounds[text[of]], "item_start": begin, "window": size[of], "matched": matched[pick], "n_items": index.held[at[pick]], "passage": index.passage[at[pick]]}


def _dealt(bench: DataFrame) -> tuple[DataFrame, int]:
    """(text, item_id, slice) for each of the benchmark's different texts, known by its smallest id, and the number of slices."""
    texts = bench.groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = texts.selectExpr("sum(size(split(text, '[^0-9A-Za-z\\u0080-\\uffff]+'))) AS n").first()["n"] or 0
    parts = -(-total * 5 // (SLICE_WORDS * 4)) if total > SLICE_WORDS else 1
    return texts.withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")), parts


def _indexes(bench: DataFrame, masks, window: int, percent: int) -> Iterator[Index]:
    """One index for each slice of the benchmark's different texts."""
    masks = complete(masks, window, percent)
    texts, parts = _dealt(bench)
    if parts > 1:  # an item's class may lie in several slices
        texts = texts.join(item_classes(bench, window), "item_id")
    for k in range(parts):
        rows = (texts.where(F.col("slice") == k) if parts > 1 else texts).toPandas()
        yield build(rows["item_id"].tolist(), [x.encode() for x in rows["text"]], masks, window, rows["class_id"].tolist() if parts > 1 else None)


def _cleaned(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return bench.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")


def item_classes(bench: DataFrame, window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, class_id) for each item: the smallest id that is reached over items that hold one window.

    Items of fewer words are one window. Null ids and texts are passed over, and repeated rows told once; items without
    words are classes of their own. Other columns are ignored, whatever their names. No rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = T.words(texts_of(part.column("text")), parts=T.MARKS)
                x, first = T.shingles(T.hashes(w), w.bounds, window)
                of = np.repeat(np.arange(part.num_rows), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), part.column("item_id").take(pa.array(of))], ["passage", "item_id"])

    rows = _cleaned(bench, item_col, item_text_col)
    scratch = Scratch(rows.sparkSession, "classes")
    held = scratch.write(rows.mapInArrow(run, "passage long, item_id long").distinct(), "held")
    least = held.groupBy("passage").agg(F.min("item_id").alias("b"))
    links = scratch.write(held.join(least, "passage").where("item_id <> b").selectExpr("item_id AS a", "b").distinct(), "links")
    labels = components(links, scratch, "labels").selectExpr("node AS item_id", "label")
    return rows.select("item_id").distinct().join(labels, "item_id", "left").selectExpr("item_id", "coalesce(label, item_id) AS class_id")


def passage_items(bench: DataFrame, window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(passage_id, item_id) for each item of each passage that several items hold, copies included; others have one item.

    Passages are told within the slices that the benchmark is met in. Null ids and texts are passed over, and repeated rows
    told once. Other columns are ignored, whatever their names. No rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = T.words(texts_of(part.column("text")), parts=T.MARKS)
                x, first = T.shingles(T.hashes(w), w.bounds, window)
                some = part.select(["slice", "item_id"]).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(first))))
                codes = _codes(some.column("item_id").to_numpy()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), *some.columns, pa.array(codes)], ["seen", "slice", "first", "code"])

    rows = _cleaned(bench, item_col, item_text_col)
    scratch = Scratch(rows.sparkSession, "passages")
    texts = scratch.write(_dealt(rows)[0], "texts")
    held = scratch.write(texts.mapInArrow(run, "seen long, slice int, first long, code long").distinct(), "held")
    named = held.groupBy("slice", "seen").agg(F.bit_xor("code").alias("passage_id"))
    one = named.groupBy("slice", "passage_id").agg(F.min("seen").alias("seen"))
    copies = rows.join(texts.select("text", F.col("item_id").alias("first")), "text").select("first", "item_id").distinct()
    out = scratch.write(held.join(one, ["slice", "seen"]).select("passage_id", "first").distinct().join(copies, "first").select("passage_id", "item_id").distinct(), "members")
    return out.join(out.groupBy("passage_id").count().where("count > 1").select("passage_id"), "passage_id")


def find_leaks(docs: DataFrame, bench: DataFrame, window: int = WINDOW, percent: int = PERCENT, masks=MASKS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, item_id, doc_start, item_start, window, matched, n_items, passage_id) for each document and passage that it shares.

    A document shares a window of `window` words of an item if percent or more of them are equal, at aligned places, in the
    text. Items of fewer words must be there whole; items of fewer than 5 words are not looked for. Windows that the same
    items hold are one passage: the row tells the best of them, as a window of the smallest id that holds it (item_id), and
    how many texts hold it (n_items). `passage_items` names all items of a passage that several hold, each of them linked
    with the document; what such an item alone holds gives no further row. class_id is the item's class (`item_classes`).
    Null texts and blank ones leak nothing; null item ids and texts are passed over. Repeated documents give rows each;
    repeated items, and items of one text, are one. Other columns are ignored, whatever their names. Empty tables on either
    side give no rows. Passages lie within a slice of the benchmark, so that several slices may link a document with an
    item by a passage each.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    scratch = Scratch(spark, "leaks")
    for k, index in enumerate(_indexes(_cleaned(bench, item_col, item_text_col), masks, window, percent)):
        rows = docs.mapInArrow(_finder(spark.sparkContext.broadcast(index), window, percent), SCHEMA)
        if out is not None or k:
            rows = scratch.write(rows, f"slice-{k}")
        out = rows if out is None else out.unionByName(rows)
    return out


def _finder(sent, window: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                f = find(index, texts_of(part.column("text")), window, percent)
                ids = part.column("doc_id").take(pa.array(f["text"]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(f["class"]), pa.array(index.items[f["item"]]), *(pa.array(f[c], pa.int32()) for c in ("doc_start", "item_start", "window", "matched", "n_items")), pa.array(index.passages[f["passage"]])], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def drop_leaks(docs: DataFrame, bench: DataFrame, window: int = WINDOW, percent: int = PERCENT, masks=MASKS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that share a passage with the benchmark. Rows are filtered where they are read.

    Null and empty texts stay; repeated rows go or stay together; an empty benchmark drops nothing. Other columns pass
    through, whatever their names.
    """
    spark = docs.sparkSession
    for index in _indexes(_cleaned(bench, item_col, item_text_col), masks, window, percent):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    keep[find(sent.value, texts_of(part.column(text_col)), window, percent)["text"]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


__all__ = ["build", "complete", "drop_leaks", "find", "find_leaks", "item_classes", "passage_items", "seeds"]
