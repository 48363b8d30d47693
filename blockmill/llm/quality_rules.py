"""Repetition coverage: how much of a text lies inside n-grams and lines that occur twice or more in it.

Word hashes are rolled up to n-gram hashes one length at a time (H_n[i] = H_{n-1}[i] * B + h[i + n - 1]) for all texts of
a batch at once. A window found twice marks all the words it covers, so that overlapping repeats count once; the measure
is the share of the words' characters that is marked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import slices, texts_of

U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share array<double>, reason string"


@dataclass(frozen=True)
class Limits:
    """Largest shares of the words' characters that may lie in repeats; texts above any of them go."""

    least_words: int = 50
    repeat_percent: int = 50
    lines: float = 0.30
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.40, 8: 0.35, 10: 0.30})


def repeated(x: np.ndarray) -> np.ndarray:
    """Of values: whether each occurs twice or more."""
    if len(x) < 2:
        return np.zeros(len(x), bool)
    y = np.sort(x)
    y = y[1:][y[1:] == y[:-1]]
    if not len(y):
        return np.zeros(len(x), bool)
    y = y[np.concatenate(([True], y[1:] != y[:-1]))]
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(values)))
    return c[bounds[1:]] - c[bounds[:-1]]


def measure(texts: list[bytes], lengths: Iterable[int]) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, and (length, chars) of covered."""
    w = T.words(texts, lower=False)
    h = T.hashes(w)
    doc = w.doc()
    lead = (w.buf & 0xC0) != 0x80  # first bytes of code points
    points = np.concatenate(([0], np.cumsum(lead)))
    chars = points[w.end] - points[w.start]
    out = {"n_words": np.diff(w.bounds), "word_chars": _sums(chars, w.bounds), "n_symbols": _sums(SYMBOLS[w.buf], w.text_start)}

    # lines: starts after each \n; a line's own words are those between its ends
    begin = np.flatnonzero(w.buf[: w.text_start[-1]] == 0x0A) + 1
    stop = np.append(begin[1:] - 1, w.text_start[-1] - 1)
    begin, stop = begin[: len(stop)], stop[: len(begin)]
    first, last = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    some = np.flatnonzero(last > first)
    of = np.searchsorted(w.text_start, begin[some], side="right") - 1
    raw, seen, dup = w.buf.tobytes(), set(), np.zeros(len(some), bool)
    here = -1
    for k, (d, s, e) in enumerate(zip(of.tolist(), begin[some].tolist(), stop[some].tolist(), strict=True)):
        if d != here:
            seen, here = set(), d
        line = raw[s:e]
        if line in seen:
            dup[k] = True
        seen.add(line)
    word_chars = np.concatenate(([0], np.cumsum(chars)))
    in_line = (word_chars[last] - word_chars[first])[some]
    out["n_dup_lines"] = np.bincount(of[dup], minlength=len(texts))
    out["line_chars"] = np.bincount(of[dup], in_line[dup], minlength=len(texts)).astype(np.int64)

    salt = T.mix(np.arange(1, len(texts) + 1, dtype=np.uint64))[doc]
    rolled, wanted = h.copy(), set(lengths) | {3}
    covered = {}
    for n in range(2, max(wanted) + 1):
        if len(h) < n:
            break
        rolled = rolled[: len(h) - n + 1] * T.MUL_A + h[n - 1 :]
        if n in wanted:
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            at = np.flatnonzero(inside)
            hit = at[repeated(T.mix(rolled[at]) ^ salt[at])]
            change = np.zeros(len(h) + 1, np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + n, -1)
            mark = np.cumsum(change[:-1]) > 0
            if n == 3:
                out["n_repeat_words"] = _sums(mark, w.bounds)
            covered[n] = _sums(np.where(mark, chars, 0), w.bounds)
    out.setdefault("n_repeat_words", np.zeros(len(texts), np.int64))
    out["covered"] = {n: covered.get(n, np.zeros(len(texts), np.int64)) for n in sorted(set(lengths))}
    return out


def repetition_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts, the base rule, and the verdict of the coverage limits.

    dup_ngram_share holds the share of each length of limits.ngrams, in ascending order of length; reason names the first
    limit that was passed (null for kept rows). Null, empty and blank texts have counts of 0, shares of 0, and fail the
    base rule for want of words. Null ids and repeated rows are kept as rows; columns other than the two are ignored,
    whatever their names. No rows give no rows. A text is measured whole, however long.
    """
    lengths = sorted(limits.ngrams)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(texts_of(part.column("text")), lengths)
                total = np.maximum(m["word_chars"], 1)
                failed = (m["n_words"] < limits.least_words) | (100 * m["n_repeat_words"] > limits.repeat_percent * m["n_words"])
                shares = np.stack([m["covered"][n] / total for n in lengths], 1) if lengths else np.zeros((len(total), 0))
                lines = m["line_chars"] / total
                reason = np.full(len(total), None, object)
                for k, n in reversed(list(enumerate(lengths))):
                    reason[shares[:, k] > limits.ngrams[n]] = f"{n}-grams"
                reason[lines > limits.lines] = "lines"
                reason[failed] = "base"
                kept = np.array([r is None for r in reason], bool)
                columns = [part.column("doc_id"), *(pa.array(m[c], pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(lines)]
                columns += [pa.array(list(shares), pa.list_(pa.float64())), pa.array(reason.tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
