"""Scoring documents with a gated recurrent language model that is trained on the corpus.

1. Every word of every training document is counted (hashes and counts, aggregated by Spark).
2. Words of the largest counts, a bounded number, go to the tasks: the most frequent have an output of their own, the rest are
   in bands by count. All other words make up one more class, in which a word's probability is its count plus one over the
   class's; an unknown word is one word of that class. So the model gives probabilities to all texts, and they sum to one.
3. A hash of id and text deals the training documents: a bounded number begins the network in one task; all others are in
   rounds, and in each round in shards of about ROUND_TOKENS tokens. In a round every shard trains a copy of the last
   round's network, and the average of the copies, weighted by their tokens, is the next. How the table lies plays no part.
   Copies move as blocks of weights that are summed in a stream.
4. Documents are scored whole, the state carried from window to window. What depends on the counts of words that the tasks
   don't hold is joined by Spark, as one row for each such word of a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import Scratch, lists, slices, starts_of_runs, texts_of, whole_runs
from .gru import WINDOW, Network, Shape, Trainer, flat, pack, start, unflat

U = np.uint64
#: What ends every text, as a word's hash.
END = U(0x656E64)
#: Words whose counts the tasks hold, at most (16 bytes each), and bins by which their least count is found.
HELD_MOST, BINS = 262_144, 16
#: Training tokens that the network begins with, about, and steps on them at least (by further passes over them, few at most).
BEGIN_TOKENS, BEGIN_STEPS, PASSES_MOST = 1_000_000, 400, 8
#: Rounds, tokens of a shard in a round, about, and tasks that a round's shards are dealt to, at most.
ROUNDS, ROUND_TOKENS, TASKS_MOST = 3, 3_000_000, 8192
#: Tokens that are packed for scoring at once, and the streams that tokens are packed on in scoring and in training. A pack has
#: as many steps as its longest text has tokens, so that larger packs have fuller steps.
PACK, STREAMS, TRAIN_STREAMS = 3_000_000, 512, 256
RATE_BEGIN, RATE = 0.008, 0.004
#: Blocks that a copy's weights move in.
BLOCKS = 16
COUNT_RUN = 1_500_000
SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_held long, held_log double, model_log double, rare array<long>, times array<int>"


@dataclass
class Vocabulary:
    """Sorted hashes of the words that tasks hold, their counts, inputs and classes, and the size of each class by count."""

    words: np.ndarray
    counts: np.ndarray
    inputs: np.ndarray
    shape: Shape
    weights: np.ndarray
    tokens: int
    types: int

    @staticmethod
    def make(words: np.ndarray, counts: np.ndarray, tokens: int, types: int, shape: Shape) -> Vocabulary:
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -counts))] = np.arange(len(words))
        tail = rank >= shape.head
        top = int(np.log2(counts[tail].max())) if tail.any() else 0
        band = np.clip(top - np.log2(np.maximum(counts, 1)).astype(np.int64), 0, shape.bands - 2)
        inputs = np.where(tail, shape.head + band, rank).astype(np.int32)
        weights = np.ones(shape.bands)
        for k in range(shape.bands - 1):
            weights[k] = max(1, (counts[inputs == shape.head + k] + 1).sum())
        weights[-1] = (tokens - counts.sum()) + (types - len(words)) + 1
        return Vocabulary(words, counts, inputs, shape, weights, tokens, types)

    @property
    def rare(self) -> int:
        return self.shape.inputs - 1

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, classes, and counts (0 where tasks don't hold the word)."""
        if not len(self.words):
            ids, counts = np.full(len(h), self.rare, np.int32), np.zeros(len(h), np.int64)
        else:
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            held = self.words[at] == h
            ids, counts = np.where(held, self.inputs[at], np.int32(self.rare)), np.where(held, self.counts[at], 0)
        head = self.shape.head
        classes = np.where(ids < head, ids // self.shape.per_class, self.shape.classes + ids - head)
        return ids.astype(np.int32), classes.astype(np.int32), counts

    def input_counts(self) -> np.ndarray:
        out = np.bincount(self.inputs, self.counts, minlength=self.shape.inputs).astype(np.float64)
        out[self.rare] += self.tokens - self.counts.sum()
        return out

    @property
    def start_id(self) -> int:
        return int(self.look_up(np.array([END]))[0][0])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and the texts' bounds."""
    w = T.words(texts)
    return np.insert(T.hashes(w), w.bounds[1:], END), w.bounds + np.arange(len(w.bounds))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    total = 0

    def flush() -> pa.RecordBatch:
        x = np.concatenate(held)
        x.sort()
        at = starts_of_runs(x)
        return pa.RecordBatch.from_arrays([pa.array(x[at[:-1]].view(np.int64)), pa.array(np.diff(at), pa.int64())], ["word", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            held.append(tokens(texts_of(part.column("text")))[0])
            total += len(held[-1])
            if total >= COUNT_RUN:
                yield flush()
                held, total = [], 0
    if total:
        yield flush()


def _held(counts: DataFrame, tokens_: int, types: int, shape: Shape) -> Vocabulary:
    """The words of the largest counts, 2 or more, as many as tasks may hold."""
    by_bin = counts.where("n >= 2").groupBy(F.floor(F.log2("n") * BINS).cast("int").alias("bin")).count().orderBy(F.desc("bin")).collect()
    least, total = None, 0
    for r in by_bin:
        total += r["count"]
        if total > HELD_MOST:
            break
        least = r["bin"]
    if least is None:
        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    else:
        t = counts.where("n >= 2").where(F.floor(F.log2("n") * BINS).cast("int") >= least).toArrow()
        words, n = t.column("word").to_numpy().view(np.uint64), t.column("n").to_numpy()
    return Vocabulary.make(words, n, tokens_, types, shape)


def _classes(ids: np.ndarray, shape: Shape) -> np.ndarray:
    return np.where(ids < shape.head, ids // shape.per_class, shape.classes + ids - shape.head).astype(np.int32)


def _coded(docs: DataFrame, vocabulary: Vocabulary, shards: int, begin: float) -> DataFrame:
    """(round, shard, key, ids): each document's inputs, two bytes a token, and where it is learned from; round 0 begins."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = tokens(texts_of(part.column("text")))
                ids = sent.value.look_up(h)[0].astype("<i2")
                key = T.mix(part.column("key").to_numpy().view(np.uint64))
                first = (key >> U(40)).astype(np.float64) < begin * (1 << 24)
                key = T.mix(key + U(1))
                turn = np.where(first, 0, 1 + (key % U(ROUNDS)).astype(np.int64))
                shard = np.where(first, 0, (T.mix(key) % U(shards)).astype(np.int64))
                cuts = pa.py_buffer((2 * bounds).astype(np.int32))
                coded = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, cuts, pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), pa.array(shard, pa.int32()), pa.array(key.view(np.int64)), coded], ["round", "shard", "key", "ids"])

    keyed = docs.select(F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("key"), "text")
    return keyed.mapInArrow(code, "round int, shard int, key long, ids binary")


def _round(coded: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, tasks: int, begin: bool) -> np.ndarray:
    """The average of the shards' copies, each trained on the documents of its shard in the order of their keys."""
    spark, shape = coded.sparkSession, vocabulary.shape
    sent = spark.sparkContext.broadcast((weights, vocabulary.start_id))

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start_id = sent.value
        for t in whole_runs(batches, "shard"):
            shard = t.column("shard").to_numpy()
            at = starts_of_runs(shard)
            raw = t.column("ids").to_pylist()
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = np.frombuffer(b"".join(raw[s:e]), "<i2").astype(np.int32)
                packed = pack(np.cumsum([0, *(len(x) // 2 for x in raw[s:e])]), TRAIN_STREAMS)
                network = Network(shape, {k: v.copy() for k, v in unflat(shape, weights).items()})
                trainer = Trainer(network, RATE_BEGIN if begin else RATE)
                for _ in range(min(PASSES_MOST, -(-BEGIN_STEPS * WINDOW // len(packed.index))) if begin else 1):
                    trainer.train(packed, ids, _classes(ids, shape), start_id)
                parts = np.array_split(flat(network.p), BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([int(shard[s])] * BLOCKS, pa.int32()), pa.array([len(ids)] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "shard", "n", "weights"])

    def average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        n: dict[tuple[int, int], int] = {}
        for batch in batches:
            for *k, m, w in zip(batch.column("block").to_pylist(), batch.column("shard").to_pylist(), batch.column("n").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                k = tuple(k)
                x = np.frombuffer(w, np.float32).astype(np.float64) * m
                total[k] = total[k] + x if k in total else x
                n[k] = n.get(k, 0) + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in n], pa.int32()), pa.array([s for _, s in n], pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([(total[k] / n[k]).astype(np.float32).tobytes() for k in n], pa.binary())], ["block", "shard", "n", "weights"])

    schema = "block int, shard int, n long, weights binary"
    dealt = coded.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "key", "ids")
    copies = dealt.select("shard", "ids").mapInArrow(train, schema)
    # sums in two steps, in the order of the shards: those of up to 64 groups of copies, then those of the groups
    grouped = copies.repartition(F.col("block"), F.col("shard") % 64).sortWithinPartitions("block", "shard").withColumn("shard", F.col("shard") % 64)
    rows = grouped.mapInArrow(average, schema).repartition(F.col("block")).sortWithinPartitions("block", "shard").withColumn("shard", F.lit(0)).mapInArrow(average, schema).orderBy("block").collect()
    return np.concatenate([np.frombuffer(r["weights"], np.float32) for r in rows]) if rows else weights


def _trained(docs: DataFrame, vocabulary: Vocabulary, scratch: Scratch) -> dict[str, np.ndarray]:
    """The network after a begin and ROUNDS rounds over the training documents."""
    shape, weights = vocabulary.shape, flat(start(vocabulary.shape, vocabulary.input_counts()))
    begin = min(1.0, BEGIN_TOKENS / vocabulary.tokens)
    shards = max(1, -(-vocabulary.tokens // (ROUNDS * ROUND_TOKENS)))
    coded = scratch.write(_coded(docs, vocabulary, shards, begin), "coded", "round")
    for k in range(ROUNDS + 1 if begin < 1 else 1):
        weights = _round(coded.where(F.col("round") == k), vocabulary, weights, min(shards, TASKS_MOST) if k else 1, k == 0)
    scratch.drop("coded")
    return unflat(shape, weights)


def score_documents(docs: DataFrame, held_out: "F.Column | None" = None, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    held_out: a column of docs; rows for which it is true are scored but not learned from (by default those whose
    crc32(id as text) mod 7 is 2). Scores are base-10 logarithms of the probability of the whole text and its end; the base
    score is that of a unigram model with one added to each count, and one more word for the unknown.

    Scores depend on the rows alone, not on how they lie in partitions (but for rounding). Null, empty and blank texts are
    scored as an end alone. A null id hashes as an empty text. Repeated rows are scored, and learned from, each. Other columns are ignored, whatever their names. No rows give no rows; without training rows both
    scores take all words for unknown.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rule = F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2, F.lit(False)) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), rule.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    training = rows.where("NOT held_out")
    counts = scratch.write(training.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    vocabulary = _held(counts, sums["tokens"], sums["types"], shape)
    model = _trained(training, vocabulary, scratch) if sums["tokens"] else start(shape, vocabulary.input_counts())
    scored = scratch.write(rows.mapInArrow(_scorer(spark.sparkContext.broadcast((vocabulary, flat(model))), shape), SCORED), "scored")

    # the words that tasks don't hold: a row for each of a document
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = rare.join(counts, "word").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("times").alias("n_rare"))
    out = scored.drop("rare", "times").join(found, "uid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_held") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(int(sums["tokens"])).cast("long").alias("train_tokens"), (F.col("held_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(sums["tokens"] + sums["types"] + 1))).alias("base_score"), (F.col("model_log") + F.coalesce("rare_log", F.lit(0.0))).alias("score"))
    return out


def _scorer(sent, shape: Shape):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, weights = sent.value
        network = Network(shape, unflat(shape, weights))
        uid = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = tokens(texts_of(part.column("text")))
                held.append((part.column("doc_id"), part.column("held_out"), *_rare(h, bounds, vocabulary)))
                total += len(h)
                if total >= PACK:
                    yield _scored(held, vocabulary, network, uid)
                    uid += sum(len(x[0]) for x in held)
                    held, total = [], 0
        if held:
            yield _scored(held, vocabulary, network, uid)

    return run


def _rare(h: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> tuple:
    """Inputs, classes and counts of tokens, texts' bounds, and the distinct words of each text that tasks don't hold, with how often."""
    ids, classes, counts = vocabulary.look_up(h)
    at = np.flatnonzero(counts == 0)
    doc = np.searchsorted(bounds, at, side="right") - 1
    order = np.lexsort((h[at], doc))
    word, doc = h[at][order], doc[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(word)))
    cuts = np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=len(bounds) - 1))))
    return ids, classes, counts, bounds, word[first], times, cuts


def _scored(held: list[tuple], vocabulary: Vocabulary, network: Network, uid: int) -> pa.RecordBatch:
    ids, classes, counts = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))

    def joined(k: int) -> np.ndarray:
        out = [np.zeros(1, np.int64)]
        for x in held:
            out.append(x[k][1:] + out[-1][-1])
        return np.concatenate(out)

    bounds, cuts = joined(5), joined(8)
    log = network.score(pack(bounds, STREAMS), ids, classes, vocabulary.start_id) / np.log(10)
    band = np.maximum(ids - vocabulary.shape.head, 0)
    log -= np.where(ids >= vocabulary.shape.head, np.log10(vocabulary.weights)[band], 0)
    ones = np.log10(counts + 1.0)
    log += np.where((ids >= vocabulary.shape.head) & (counts > 0), ones, 0)
    each = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  (every text has a token, its end)
    n = len(bounds) - 1
    columns = [pa.array(np.arange(uid, uid + n)), pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), pa.array(np.diff(bounds)), pa.array(each((counts > 0).astype(np.int64))), pa.array(each(ones)), pa.array(each(log))]
    columns += [lists(np.concatenate([x[6] for x in held]).view(np.int64), cuts, pa.int64()), lists(np.concatenate([x[7] for x in held]), cuts, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORED.split(", ")])


__all__ = ["score_documents", "tokens"]
