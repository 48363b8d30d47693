"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output, state carried along a text.

Words with an output of their own ("head" words) are in equal classes by frequency; other classes stand for bands of rarer
words, within which a word's probability doesn't depend on the state and is the caller's affair. The probability of a
word is that of its class, times that of the word within the class.

Texts are packed end to end into parallel streams; the state starts at zero with each text and runs on from window to
window, so that a text of any length is scored whole, with memory bounded by a window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

F32 = np.float32
WINDOW = 16


@dataclass(frozen=True)
class Shape:
    hidden: int = 32
    classes: int = 32
    per_class: int = 64
    bands: int = 10

    @property
    def head(self) -> int:
        return self.classes * self.per_class

    @property
    def inputs(self) -> int:
        return self.head + self.bands

    def sizes(self) -> dict[str, tuple[int, ...]]:
        h, c = self.hidden, self.classes + self.bands
        return {"x": (self.inputs, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "wc": (h, c), "bc": (c,), "ww": (self.classes, h, self.per_class), "bw": (self.classes, self.per_class)}


@cache
def _ones(n: int) -> np.ndarray:
    return np.ones(n, F32)


def softmax(x: np.ndarray, target: np.ndarray, gradient: float | None = None) -> np.ndarray:
    """Log-probability of each row's target; or, in place of the logits, the gradient of its negative, times a factor. Logits are held below 60."""
    np.minimum(x, F32(60), out=x)
    at = np.arange(0, x.size, x.shape[1])
    at += target
    if gradient is not None:
        np.exp(x, out=x)
        x *= (F32(gradient) / (x @ _ones(x.shape[1])))[:, None]
        x.reshape(-1)[at] -= F32(gradient)
        return x
    picked = x.reshape(-1).take(at)
    np.exp(x, out=x)
    return picked - np.log(x @ _ones(x.shape[1]))


def _with_ones(h: np.ndarray) -> np.ndarray:
    out = np.empty((len(h), h.shape[1] + 1), F32)
    out[:, :-1] = h
    out[:, -1] = 1
    return out


def start(shape: Shape, counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """counts: of the inputs, head words first, then bands. Output biases begin at the unigram distribution."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(F32) for k, s in shape.sizes().items()}
    p["b"][:] = 0
    p["b"][shape.hidden : 2 * shape.hidden] = 1  # keep the state at first
    head = counts[: shape.head].reshape(shape.classes, shape.per_class) + 0.5
    classes = np.concatenate((head.sum(1), counts[shape.head :] + 0.5))
    p["bc"][:] = np.log(classes / classes.sum())
    p["bw"][:] = np.log(head / head.sum(1, keepdims=True))
    for k in ("wc", "ww"):
        p[k] *= F32(0.3)
    return p


@dataclass
class Packed:
    """Streams of texts: token numbers by step and stream (streams by length, longest first), active streams by step."""

    index: np.ndarray
    fresh: np.ndarray
    active: np.ndarray


def pack(bounds: np.ndarray, streams: int) -> Packed:
    """Texts bounds[i]:bounds[i + 1] (none empty) on streams of about equal length."""
    n = np.diff(bounds)
    streams = max(1, min(streams, len(n)))
    heap = [(0, s) for s in range(streams)]
    of: list[list[int]] = [[] for _ in range(streams)]
    for i in np.argsort(-n, kind="stable").tolist():
        length, s = heapq.heappop(heap)
        of[s].append(i)
        heapq.heappush(heap, (length + int(n[i]), s))
    lengths = np.array([sum(int(n[i]) for i in x) for x in of])
    order = np.argsort(-lengths, kind="stable")
    index = np.full((int(lengths.max()), streams), -1, np.int32)
    fresh = np.zeros(index.shape, bool)
    for column, s in enumerate(order.tolist()):
        at = 0
        for i in of[s]:
            size = int(n[i])
            index[at : at + size, column] = np.arange(bounds[i], bounds[i + 1])
            fresh[at, column] = True
            at += size
    return Packed(index, fresh, (index >= 0).sum(1))


class Network:
    def __init__(self, shape: Shape, p: dict[str, np.ndarray]):
        self.shape, self.p = shape, p

    # --- forward ---

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the inputs, biases with them, and of the state, each by gate. Of the two sigmoids, (tanh(v / 2) + 1) / 2, they are halved."""
        p, n = self.p, self.shape.hidden
        x = np.empty((3, len(p["x"]), n), F32)
        for k in range(3):
            np.add(p["x"][:, k * n : (k + 1) * n], p["b"][k * n : (k + 1) * n], out=x[k])
        u = np.ascontiguousarray(p["u"].reshape(n, 3, n).transpose(1, 0, 2))
        x[:2] *= F32(0.5)
        u[:2] *= F32(0.5)
        return x, u

    def _heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes, and of the words in each class, with the biases as a last row, for states that end in a one."""
        p = self.p
        return np.concatenate((p["wc"], p["bc"][None])), np.concatenate((p["ww"], p["bw"][:, None]), 1)

    def _run(self, x: np.ndarray, u: np.ndarray, h: np.ndarray, before: np.ndarray, fresh: np.ndarray, active: list[int], keep: bool) -> tuple[np.ndarray, tuple | None]:
        """States of a window's tokens, step after step in one array; and, to keep, what backpropagation needs, lying likewise."""
        n, total = self.shape.hidden, sum(active)
        gates = x.take(before, 1)
        out = np.empty((total, n), F32)
        last, hn = (np.empty((total, n), F32), np.empty((total, n), F32)) if keep else (None, None)
        at = 0
        for t, a in enumerate(active):
            was, new = h[:a], fresh[t, :a]
            if keep:
                last[at : at + a] = was
                was = last[at : at + a]
            if new.any():
                was = was if keep else was.copy()
                was[new] = 0
            hu = np.matmul(was, u)
            g, c, candidate = gates[:2, at : at + a], gates[2, at : at + a], hu[2]
            g += hu[:2]
            np.tanh(g, out=g)
            g *= F32(0.5)
            g += F32(0.5)
            if keep:
                hn[at : at + a] = candidate
            candidate *= g[0]
            c += candidate
            np.tanh(c, out=c)
            h = np.subtract(was, c, out=out[at : at + a])
            h *= g[1]
            h += c
            at += a
        return out, (last, hn, gates) if keep else None

    def windows(self, packed: Packed, ids: np.ndarray, start_id: int, keep: bool) -> Iterator[tuple]:
        """Per window: token numbers, states (steps joined), and what backpropagation needs, of weights that may have moved since the last window."""
        h = np.zeros((packed.index.shape[1], self.shape.hidden), F32)
        x, u = self._gates()
        for t in range(0, len(packed.index), WINDOW):
            index, fresh, active = packed.index[t : t + WINDOW], packed.fresh[t : t + WINDOW], packed.active[t : t + WINDOW].tolist()
            joined = lambda x: np.concatenate([x[k, :a] for k, a in enumerate(active)])  # noqa: E731, B023
            tokens = joined(index)
            before = ids.take(np.maximum(tokens - 1, 0))
            before[joined(fresh)] = start_id
            if keep and t:
                x, u = self._gates()
            out, tape = self._run(x, u, h, before, fresh, active, keep)
            h = out[-active[-1] :]
            yield tokens, out, (before, fresh, active, tape)

    def score(self, packed: Packed, ids: np.ndarray, classes: np.ndarray, start_id: int) -> np.ndarray:
        """Natural log of the probability of each token's class and, for head words, of the word within it."""
        out = np.zeros(len(ids), np.float64)
        wc, ww = self._heads()
        for index, h, _ in self.windows(packed, ids, start_id, False):
            c = classes.take(index)
            h = _with_ones(h)
            log = softmax(h @ wc, c)
            order, cuts = self._by_class(c)
            y, word = h.take(order, 0), ids.take(index.take(order)) % self.shape.per_class
            inner = np.empty(len(order), F32)
            for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if e > s:
                    inner[s:e] = softmax(y[s:e] @ ww[k], word[s:e])
            log[order] += inner
            out[index] = log
        return out

    def _by_class(self, c: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The tokens of head words in order of their class, and where each class begins."""
        order = np.argsort(c.astype(np.int16), kind="stable")
        cuts = np.searchsorted(c.take(order), np.arange(self.shape.classes + 1)).tolist()
        return order[: cuts[-1]], cuts

    # --- training ---

    def gradients(self, index, h, tape, ids, classes) -> dict[str, np.ndarray]:
        """Of the loss by each parameter; of the inputs' weights only the rows of `words`, the words that the window has."""
        p, n = self.p, self.shape.hidden
        wc, ww = self._heads()
        c, scale = classes.take(index), 1 / len(index)
        y = _with_ones(h)
        d = softmax(y @ wc, c, scale)
        dwc = y.T @ d
        dh = d @ p["wc"].T
        order, cuts = self._by_class(c)
        y, word = y.take(order, 0), ids.take(index.take(order)) % self.shape.per_class
        dy, dww = np.empty((len(y), n), F32), np.zeros(ww.shape, F32)
        for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if e > s:
                d = softmax(y[s:e] @ ww[k], word[s:e], scale)
                np.matmul(y[s:e].T, d, out=dww[k])
                np.matmul(d, p["ww"][k].T, out=dy[s:e])
        dh[order] += dy
        g = {"wc": dwc[:n], "bc": dwc[n], "ww": np.ascontiguousarray(dww[:, :n]), "bw": dww[:, n].copy()}
        before, fresh, active, (last, hn, gates) = tape
        r, z, new = gates
        # by token, what the state's gradient is multiplied with at the three gates: all steps at once
        inner = 1 - new * new
        inner *= 1 - z
        by = np.empty(gates.shape, F32)
        np.multiply(inner, r, out=by[2])
        np.subtract(1, r, out=by[0])
        by[0] *= hn
        by[0] *= by[2]
        np.subtract(1, z, out=by[1])
        by[1] *= z
        by[1] *= last - new
        dx = np.empty(gates.shape, F32)
        ut = np.ascontiguousarray(p["u"].reshape(n, 3, n).transpose(1, 2, 0))
        carried, e = None, len(h)
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            s = e - a
            dnow = dh[s:e]
            if carried is not None:
                dnow[: len(carried)] += carried
            back = np.matmul(np.multiply(by[:, s:e], dnow, out=dx[:, s:e]), ut)
            carried = dnow * z[s:e]
            for k in range(3):
                carried += back[k]
            if fresh[t, :a].any():
                carried[fresh[t, :a]] = 0
            e = s
        g["u"] = np.matmul(last.T, dx).transpose(1, 0, 2).reshape(n, 3 * n)
        np.multiply(dh, inner, out=dx[2])
        dx = dx.transpose(1, 0, 2).reshape(len(h), 3 * n)
        g["b"] = _ones(len(h)) @ dx
        order = np.argsort(before.astype(np.int16), kind="stable")
        at = before.take(order)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        g["words"] = at.take(first)
        g["x"] = np.add.reduceat(dx.take(order, 0), first, axis=0)
        return g


class Trainer:
    """Adam over one process's texts. Of the inputs' weights only the rows of words that a window has are moved."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.steps = network, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in network.p.items()}

    def train(self, packed: Packed, ids: np.ndarray, classes: np.ndarray, start_id: int) -> None:
        p = self.network.p
        for index, h, tape in self.network.windows(packed, ids, start_id, True):
            g = self.network.gradients(index, h, tape, ids, classes)
            words = g.pop("words")
            norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
            self.steps += 1
            # one factor for the rate, the bias of both averages and the clipped length of the gradient
            scale = F32(min(1.0, 1 / max(norm, 1e-6)))
            rate = F32(self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps) * min(1.0, len(index) / 1024))
            for k, x in g.items():
                if scale < 1:
                    x *= scale
                m, v = (self.m[k], self.v[k]) if k != "x" else (self.m[k][words], self.v[k][words])
                # m is kept as 10 times and v as 100 times the average
                m *= F32(0.9)
                m += x
                v *= F32(0.99)
                x *= x
                v += x
                np.sqrt(v, out=x)
                x += F32(1e-5)
                np.divide(m, x, out=x)
                x *= rate
                if k == "x":
                    self.m[k][words], self.v[k][words] = m, v
                    p[k][words] -= x
                else:
                    p[k] -= x


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(shape: Shape, x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in sorted(shape.sizes().items()):
        size = int(np.prod(s))
        out[k], at = x[at : at + size].reshape(s).astype(F32), at + size
    return out
