import math
import os
import random
import re
import sys
import zlib
from collections import Counter
from math import log10

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from blockmill.llm import gru, lm_score, quality_mil  # noqa: E402

DATA = "/root/testdata/sf0.01"
SMALL = gru.Shape(hidden=5, classes=3, per_class=4, bands=2)


def small_network(seed=2):
    rng = np.random.default_rng(seed)
    return gru.Network(SMALL, {k: rng.standard_normal(s).astype(np.float32) * 0.5 for k, s in SMALL.sizes().items()})


def small_texts(rng, *lengths):
    bounds = np.cumsum([0, *lengths])
    ids = rng.integers(0, SMALL.inputs, bounds[-1]).astype(np.int32)
    classes = np.where(ids < SMALL.head, ids // SMALL.per_class, SMALL.classes + ids - SMALL.head).astype(np.int32)
    return bounds, ids, classes


# --- gated recurrent network ----------------------------------------------------------------------------------------


def test_packing_holds_each_token_once():
    bounds = np.cumsum([0, 3, 50, 1, 1, 7, 20])
    p = gru.pack(bounds, 3)
    assert sorted(p.index[p.index >= 0].tolist()) == list(range(bounds[-1]))
    assert (p.active == (p.index >= 0).sum(1)).all() and (np.diff(p.active) <= 0).all()
    assert sorted(p.index[p.fresh].tolist()) == bounds[:-1].tolist()


def test_state_runs_on_and_starts_anew():
    """Scores don't depend on windows, streams or neighbours: a text alone has the scores that it has among others."""
    rng = np.random.default_rng(0)
    bounds, ids, classes = small_texts(rng, 5, 100, 1, 40)
    net = small_network()
    many = net.score(gru.pack(bounds, 2), ids, classes, 1)
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        alone = net.score(gru.pack(np.array([0, e - s]), 1), ids[s:e], classes[s:e], 1)
        assert np.allclose(alone, many[s:e], atol=1e-5)
    # plain steps of the same network
    p = net.p
    h = np.zeros(SMALL.hidden)
    before = 1
    sig = lambda v: 1 / (1 + np.exp(-v))
    for t in range(bounds[1], bounds[2]):
        x, u, n = p["x"][before] + p["b"], h @ p["u"], SMALL.hidden
        r, z = sig(x[:n] + u[:n]), sig(x[n : 2 * n] + u[n : 2 * n])
        h = (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :]) + z * h
        c = h @ p["wc"] + p["bc"]
        want = c[classes[t]] - np.log(np.exp(c).sum())
        if ids[t] < SMALL.head:
            w = h @ p["ww"][classes[t]] + p["bw"][classes[t]]
            want += w[ids[t] % SMALL.per_class] - np.log(np.exp(w).sum())
        assert abs(want - many[t]) < 1e-4
        before = ids[t]


def test_probabilities_sum_to_one():
    net = small_network()
    total = 0.0
    for i in range(SMALL.inputs):
        ids = np.array([3, 7, i], np.int32)
        classes = np.where(ids < SMALL.head, ids // SMALL.per_class, SMALL.classes + ids - SMALL.head).astype(np.int32)
        total += np.exp(net.score(gru.pack(np.array([0, 3]), 1), ids, classes, 0)[2])
    assert abs(total - 1) < 1e-5


def test_states_are_those_of_plain_gates():
    """Window after window, with gates far beyond where exponentials of them would overflow."""
    net, rng = small_network(), np.random.default_rng(4)
    net.p["x"][3] = 500
    net.p["x"][4] = -500
    ids = rng.integers(0, SMALL.inputs, 90).astype(np.int32)
    p, n, h, want = {k: v.astype(float) for k, v in net.p.items()}, SMALL.hidden, np.zeros(SMALL.hidden), []
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -700, 700)))
    for k in range(len(ids)):
        x, hu = p["x"][ids[k - 1] if k else 1] + p["b"], h @ p["u"]
        r, z = sig(x[:n] + hu[:n]), sig(x[n : 2 * n] + hu[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * hu[2 * n :])
        h = z * h + (1 - z) * new
        want.append(h)
    for keep in (True, False):
        got = np.concatenate([h for _, h, _ in net.windows(gru.pack(np.array([0, len(ids)]), 1), ids, 1, keep)])
        np.testing.assert_allclose(got, want, atol=2e-5)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    bounds, ids, classes = small_texts(rng, 9, 4, 6)  # one window
    net = small_network()
    packed = gru.pack(bounds, 2)
    ((index, h, tape),) = list(net.windows(packed, ids, 1, True))
    g = net.gradients(index, h.copy(), tape, ids, classes)
    x = np.zeros_like(net.p["x"])
    x[g["words"]] = g["x"]
    g["x"] = x
    loss = lambda: -net.score(packed, ids, classes, 1).mean()
    for k, v in net.p.items():
        flat, d = v.reshape(-1), g[k].reshape(-1)
        for j in rng.choice(len(flat), min(12, len(flat)), replace=False):
            old, e = flat[j], np.float32(2e-2)
            flat[j] = old + e
            up = loss()
            flat[j] = old - e
            down = loss()
            flat[j] = old
            assert abs((up - down) / (2 * e) - d[j]) < 2e-3, (k, j)


def test_training_learns_a_pattern():
    ids = np.tile(np.array([0, 5, 9, 12], np.int32), 2000)
    classes = np.where(ids < SMALL.head, ids // SMALL.per_class, SMALL.classes + ids - SMALL.head).astype(np.int32)
    net = small_network()
    packed = gru.pack(np.arange(0, 8001, 80), 16)
    first = net.score(packed, ids, classes, 0).mean()
    trainer = gru.Trainer(net, 0.02)
    for _ in range(40):
        trainer.train(packed, ids, classes, 0)
    assert net.score(packed, ids, classes, 0).mean() > max(-0.3, first / 4)
    assert all(np.array_equal(v, net.p[k]) for k, v in gru.unflat(SMALL, gru.flat(net.p)).items())


# --- scores of documents --------------------------------------------------------------------------------------------


def _plain(docs, held):
    c = Counter()
    for i, t in docs:
        if not held(i):
            c.update([*brute.words(t), None])
    n, v = sum(c.values()), len(c)
    return n, {k: (len(w := [*brute.words(t), None]), sum(c[x] > 0 for x in w), sum(log10((c[x] + 1) / (n + v + 1)) for x in w)) for k, (_, t) in enumerate(docs)}


def test_scores_of_odd_texts(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "One oNe", "é\x0bß x\x1cy", "z" * 200_000, " ".join(rng.choice("abcdefg") + str(rng.randrange(2000)) for _ in range(30_000)), "one", "one"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(9, "one"), (None, "one two")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "held_out": F.lit("x"), "uid": F.lit(3)})
    rows = lm_score.score_documents(df).collect()
    n, plain = _plain(docs, held)
    key = lambda i, t: (i, t)
    want = sorted(((docs[k][0] is None, docs[k][0] or 0, held(docs[k][0]), a, b, round(c, 6)) for k, (a, b, c) in plain.items()))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows))
    assert got == want and key
    assert {r.train_tokens for r in rows} == {n}
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    same = [r.score for r in rows if r.doc_id in (3, 8)]
    assert max(same) - min(same) < 1e-5  # equal texts, but for rounding of 32-bit sums
    assert lm_score.score_documents(df.limit(0)).count() == 0
    alone = lm_score.score_documents(df.where("doc_id = 3"), held_out=F.lit(True)).first()
    assert (alone.train_tokens, alone.n_known, round(alone.base_score, 6)) == (0, 0, 0.0)


def test_held_out_texts_are_likelier_than_under_unigrams(spark):
    rows = lm_score.score_documents(spark.read.parquet(f"{DATA}/documents.parquet")).where("held_out").collect()
    assert sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)
    assert sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows)


def test_vocabulary_classes_sum_to_one():
    counts = np.array([50, 40, 30, 20, 10, 9, 8, 7, 6, 5, 4, 4, 3, 2, 2], np.int64)
    words = np.arange(100, 115).astype(np.uint64)
    v = lm_score.Vocabulary.make(words, counts, tokens=int(counts.sum()) + 6, types=len(counts) + 4, shape=SMALL)
    ids, classes, c = v.look_up(np.append(words, np.uint64(7)))
    assert ids[-1] == v.rare and c[-1] == 0 and sorted(ids[c > 6].tolist()) == list(range(8))
    for band in range(SMALL.bands - 1):
        assert sum((c + 1)[ids == SMALL.head + band]) == v.weights[band]
    assert v.weights[-1] == 6 + 4 + 1  # rare tokens and types, and the unknown


# --- quality --------------------------------------------------------------------------------------------------------


def test_attention_gradients():
    rng = np.random.default_rng(7)
    x = rng.random((9, quality_mil.FEATURES)).astype(np.float32)
    bounds, y = np.array([0, 1, 5, 9]), np.array([0, 1, 1], np.float32)
    model = quality_mil.Model.start()
    for v in model.p.values():
        v += rng.standard_normal(v.shape).astype(np.float32) * 0.2

    def loss():
        s = model.forward(x, bounds)[0]
        return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean() + 0.5e-5 * sum((v.astype(np.float64) ** 2).sum() for v in model.p.values()))

    g = model.gradients(x, bounds, y)
    for k, v in model.p.items():
        flat, d = v.reshape(-1), g[k].reshape(-1)
        for j in rng.choice(len(flat), min(10, len(flat)), replace=False):
            old, e = flat[j], np.float32(1e-2)
            flat[j] = old + e
            up = loss()
            flat[j] = old - e
            down = loss()
            flat[j] = old
            assert abs((up - down) / (2 * e) - d[j]) < 3e-3, (k, j)


def test_attention_weighs_the_telling_passage():
    plain = " ".join(f"word{k % 50}" for k in range(64))
    loud = " ".join(f"W{k % 50}!!" for k in range(64))
    rng = random.Random(2)
    texts, labels = [], []
    for _ in range(300):
        parts = [plain] * rng.randrange(1, 6)
        bad = rng.random() < 0.5
        if bad:
            parts[rng.randrange(len(parts))] = loud
        texts.append(" ".join(parts).encode())
        labels.append(0 if bad else 1)
    model = quality_mil.fit(quality_mil.bags_of(texts[:200]), np.array(labels[:200]))
    s = model.scores(texts[200:])
    assert ((s >= 0.5) == (np.array(labels[200:]) == 1)).mean() > 0.95
    x, bounds = quality_mil.features([" ".join([plain] * 4 + [loud]).encode()])
    weight = model.forward(x, bounds)[1][3]
    assert weight.argmax() == 4 or weight[4] > 0.2


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_mil.score(docs, quality_mil.train(docs, labels))
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert sum(right) > 0.95 * len(right)
    assert all(r.predicted for r in rows if r.quality == 1 and len(rows) and r.score >= 0.7)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_tables(spark):
    odd = [(0, None), (1, ""), (2, " \n"), (3, "x" * 100_000), (4, "a " * 100_000), (4, "a " * 100_000), (None, "plain words here")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"quality": F.lit(9), "y": F.lit(8), "score": F.lit(7), "held_out": F.lit(6)})
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    for known in (labels, labels.limit(0)):
        model = quality_mil.train(docs, known)
        rows = quality_mil.score(docs, model).collect()
        assert len(rows) == len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
        assert quality_mil.keep_good(docs, model).columns == docs.columns
    assert quality_mil.score(docs.limit(0), quality_mil.train(docs.limit(0), labels)).count() == 0


def _plain_score(model, x):
    """The forward pass of one bag in plain Python."""
    p = {k: v.tolist() for k, v in model.p.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    times = lambda row, m: [sum(a * r[k] for a, r in zip(row, m, strict=True)) for k in range(len(m[0]))]
    encoded = [[math.tanh(v + b) for v, b in zip(times(row, p["e"]), p["be"], strict=True)] for row in x]
    raw = [sum(math.tanh(v) * sig(g) * a for v, g, a in zip(times(e, p["v"]), times(e, p["g"]), p["a"], strict=True)) for e in encoded]
    weight = [math.exp(r) / sum(map(math.exp, raw)) for r in raw]
    z = [sum(w * e[k] for w, e in zip(weight, encoded, strict=True)) for k in range(len(encoded[0]))]
    return sig(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["c0"][0])


def _plain_features(text):
    """Rates of each passage of a text, in plain Python."""
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    rows = []
    for at in range(0, max(1, len(words)), 64):
        some = words[at : at + 64]
        n = max(1, len(some))
        marks = [sum(33 <= c < 127 and not chr(c).isalnum() for c in w) for _, w in some]
        upper = [sum(65 <= c <= 90 for c in w) for _, w in some]
        again = [any(j >= 0 and some[j][1] == w for j in (k - 1, k - 2)) for k, (_, w) in enumerate(some)]
        means = [again, [len(w) / 8 for _, w in some], [m / 4 for m in marks], [m == 0 for m in marks], [u / 4 for u in upper], [u == len(w) for u, (_, w) in zip(upper, some, strict=True)], [len(w) == 1 for _, w in some], [len(w) > 20 for _, w in some], [s == 0 or text[s - 1] == 10 for s, _ in some]]
        rows.append([sum(v) / n for v in means] + [math.log1p(len(some)) / 4])
    return rows


def test_scores_are_those_of_a_plain_forward_pass(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_mil.train(docs, labels)
    rows = docs.where("doc_id % 97 = 0").collect()
    got = {r.doc_id: r.score for r in quality_mil.score(docs.where("doc_id % 97 = 0"), model).collect()}
    assert len(rows) > 5
    for r in rows:
        x, _ = quality_mil.features([(r.text or "").encode()])
        assert np.allclose(x[:, -quality_mil.RATES :], _plain_features((r.text or "").encode()), atol=1e-5)
        assert abs(got[r.doc_id] - _plain_score(model, x.tolist())) < 1e-4


def test_long_and_repeated_rows_are_learned_from(spark):
    """A label that only texts beyond any former bound on length carry, and one id that is repeated many times."""
    plain, loud = " ".join(f"word{k % 50}" for k in range(64)), " ".join(f"W{k % 50}!!" for k in range(64))
    rows = [(k, " ".join([plain] * 60 + ([loud] * 60 if k % 2 else []))) for k in range(300)]
    rows += [(1000, loud)] * 500 + [(1000, loud + " other")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(300)] + [(1000, 0)] * 50 + [(7, 1)], "doc_id long, quality int")
    assert min(len(t) for _, t in rows[:300]) > 20_000
    model = quality_mil.train(docs, labels, fit_docs=200, fit_passages=8)
    scores = {r.doc_id: r.score for r in quality_mil.score(docs, model).collect()}
    assert sum((scores[k] >= 0.5) == (k % 2 == 0) for k in range(300)) > 290
    assert quality_mil.spread(10, 24) == list(range(10)) and quality_mil.spread(100, 4) == [0, 33, 66, 99] and quality_mil.spread(5, 1) == [0]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BEGIN_TOKENS", 40_000)
    monkeypatch.setattr(lm_score, "ROUND_TOKENS", 15_000)
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = [{r.doc_id: r.score for r in lm_score.score_documents(df.repartition(n)).collect()} for n in (2, 16)]
    assert scores[0].keys() == scores[1].keys()
    assert all(abs(scores[1][k] - v) < 1e-4 * abs(v) for k, v in scores[0].items())
