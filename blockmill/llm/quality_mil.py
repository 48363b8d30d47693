"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages (stretches of words). Each passage is encoded from hashed counts of its words and their shapes;
gated attention weighs the passages, and the weighted representation is scored, so that the weights of the passages are
learned from labels of whole documents. Everything is numpy; scoring runs where the rows are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import id_hash, slices, texts_of

U = np.uint64
PASSAGE = 64
SHAPES, WORDS, RATES = 512, 256, 10
FEATURES = SHAPES + WORDS + RATES
HIDDEN, GATES = 32, 16
#: Labelled documents that the model is fitted on, at most, and passages of each, spread evenly over its whole text.
FIT_DOCS, FIT_PASSAGES = 4096, 24
#: Passes over them, and more where that gives fewer steps than LEAST_STEPS.
EPOCHS, LEAST_STEPS, BATCH, RATE = 12, 600, 64, 0.004
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.uint8)  # kinds of bytes: other ASCII marks have kinds of their own
_CLASS[[c for c in range(256) if 97 <= c <= 122]] = 1
_CLASS[[c for c in range(256) if 65 <= c <= 90]] = 2
_CLASS[[c for c in range(256) if 48 <= c <= 57]] = 3
_CLASS[128:] = 4
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 5 + _c % 27
_UPPER, _MARK = _CLASS == 2, _CLASS >= 5


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, one at least for each text, and the bounds of the texts' rows."""
    w = T.words(texts, lower=False)
    n = np.diff(w.bounds)
    passages = np.maximum(1, -(-n // PASSAGE))
    bounds = np.concatenate(([0], np.cumsum(passages)))
    doc = w.doc()
    place = np.arange(len(doc)) - w.bounds[doc]
    row = bounds[doc] + place // PASSAGE
    rows = int(bounds[-1])
    size = np.maximum(np.bincount(row, minlength=rows), 1).astype(np.float32)[:, None]

    h = T.hashes(w)
    length = w.end - w.start
    marks = np.concatenate(([0], np.cumsum(_MARK[w.buf], dtype=np.int32)))
    uppers = np.concatenate(([0], np.cumsum(_UPPER[w.buf], dtype=np.int32)))
    n_marks, n_upper = marks[w.end] - marks[w.start], uppers[w.end] - uppers[w.start]
    first, last = _CLASS[w.buf[w.start]].astype(np.uint64), _CLASS[w.buf[w.end - 1]].astype(np.uint64)
    shape = first + U(32) * last + U(1024) * np.minimum(n_marks, 3).astype(np.uint64) + U(4096) * np.minimum(n_upper, 3).astype(np.uint64)
    again = np.zeros(len(h), bool)  # the word before, or before that
    again[1:] |= (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    x = np.zeros((rows, FEATURES), np.float32)
    at = (T.mix(shape + U(7)) % U(SHAPES)).astype(np.int64)
    x[:, :SHAPES] = np.bincount(row * SHAPES + at, minlength=rows * SHAPES).reshape(rows, SHAPES)
    at = (h % U(WORDS)).astype(np.int64)
    x[:, SHAPES : SHAPES + WORDS] = np.bincount(row * WORDS + at, minlength=rows * WORDS).reshape(rows, WORDS)
    x[:, : SHAPES + WORDS] /= size
    np.sqrt(x, out=x)
    mean = lambda v: np.bincount(row, v, minlength=rows).astype(np.float32) / size[:, 0]
    rates = x[:, SHAPES + WORDS :]
    for k, v in enumerate((again, length / 8, n_marks / 4, n_marks == 0, n_upper / 4, n_upper == length, length == 1, length > 20, w.buf[np.maximum(w.start - 1, 0)] == 10)):
        rates[:, k] = mean(v)
    rates[:, RATES - 1] = np.log1p(np.bincount(row, minlength=rows)) / 4
    return x, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    p: dict[str, np.ndarray]

    @staticmethod
    def start(seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        sizes = {"e": (FEATURES, HIDDEN), "be": (HIDDEN,), "v": (HIDDEN, GATES), "g": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "c0": (1,)}
        return Model({k: (rng.standard_normal(s) * (0.15 if len(s) == 2 else 0.0 if k in ("be", "c0") else 0.1)).astype(np.float32) for k, s in sizes.items()})

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple:
        p, at = self.p, bounds[:-1]
        e = np.tanh(x @ p["e"] + p["be"])
        v, g = np.tanh(e @ p["v"]), _sigmoid(e @ p["g"])
        s = (v * g) @ p["a"]
        doc = np.repeat(np.arange(len(at)), np.diff(bounds))
        s = np.exp(s - np.maximum.reduceat(s, at)[doc])
        w = s / np.add.reduceat(s, at)[doc]
        z = np.add.reduceat(e * w[:, None], at)
        return _sigmoid(z @ p["c"] + p["c0"]), (e, v, g, w, z, doc)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, bounds = features(texts)
        return self.forward(x, bounds)[0].astype(np.float64) if len(texts) else np.zeros(0)

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (e, v, g, w, z, doc) = self.forward(x, bounds)
        d = ((score - y) / len(y)).astype(np.float32)
        dz = d[:, None] * p["c"]
        de = w[:, None] * dz[doc]
        dw = (e * dz[doc]).sum(1)
        ds = w * (dw - np.add.reduceat(w * dw, bounds[:-1])[doc])
        dv, dg = ds[:, None] * p["a"] * g * (1 - v * v), ds[:, None] * p["a"] * v * g * (1 - g)
        de += dv @ p["v"].T + dg @ p["g"].T
        de *= 1 - e * e
        out = {"c": z.T @ d, "c0": d.sum(keepdims=True), "a": (v * g).T @ ds, "v": e.T @ dv, "g": e.T @ dg, "e": x.T @ de, "be": de.sum(0)}
        return {k: g + np.float32(1e-5) * p[k] for k, g in out.items()}


def spread(n: int, most: int) -> list[int]:
    """Of n places all, or `most` of them at even distances from the first to the last."""
    return list(range(n)) if n <= most else [k * (n - 1) // max(1, most - 1) for k in range(most)]


def bags_of(texts: list[bytes], most: int = FIT_PASSAGES) -> list[np.ndarray]:
    """The passages that a model learns from, a bag for each text."""
    x, b = features(texts)
    return [x[s + np.array(spread(e - s, most))].astype(np.float16) for s, e in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Adam over bags. Without labels of either kind, every score is the share of label 1 (0.5 without any)."""
    model = Model.start()
    labels = labels.astype(np.float32)
    share = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    model.p["c0"][:] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        model.p["c"][:] = 0
        return model
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    batches = -(-len(bags) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            x = np.concatenate([bags[i] for i in pick]).astype(np.float32)
            g = model.gradients(x, np.cumsum([0, *(len(bags[i]) for i in pick)]), labels[pick])
            step += 1
            rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for name, d in g.items():
                m[name] += 0.1 * (d - m[name])
                v[name] += 0.01 * (d * d - v[name])
                model.p[name] -= (rate * m[name] / (np.sqrt(v[name]) + 1e-7)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_passages: int = FIT_PASSAGES) -> Model:
    """Fits a model to labelled documents whose crc32(id as text) mod 4 isn't 2, at most fit_docs of them.

    They are the first by a hash of the id, whatever their length; of a text of more passages, fit_passages that are spread
    evenly over all of it are learned from, so that the driver holds fit_docs * fit_passages passages of 1.6 KB at most. An id counts once:
    of rows that repeat it with other texts, the text of the least hash is learned from; repeated labels count once, and
    an id labelled both 0 and 1 is passed over. Null ids, labels and texts are passed over; empty texts are learned from.
    Other columns are ignored, whatever their names. Without labelled rows every score is 0.5.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(id_hash("doc_id") % 4 != 2)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    chosen = known.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bags = pa.array([zlib.compress(x.tobytes(), 1) for x in bags_of(texts_of(part.column("text")), fit_passages)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), part.column("h"), bags], ["id", "y", "h", "bag"])

    rows = texts.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("id"), "y", F.xxhash64("text").alias("h"), "text")
    bags = rows.mapInArrow(cut, "id long, y int, h long, bag binary").groupBy("id", "y").agg(F.min(F.struct("h", "bag")).alias("v"))
    got = bags.select("id", "y", "v.bag").toArrow().sort_by("id")  # fit_docs rows at most are sent
    return fit([np.frombuffer(zlib.decompress(x), np.float16).reshape(-1, FEATURES) for x in got.column("bag").to_pylist()], got.column("y").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts are bags of one empty passage. Null ids are not held out. Repeated rows are rows of their own; other
    columns are ignored, whatever their names, and none but the text is an input. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = sent.value.scores(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(id_hash(id_col) % 4 == 2, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns, without rows of a score below the threshold. Rows are filtered where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(sent.value.scores(texts_of(part.column(text_col))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
