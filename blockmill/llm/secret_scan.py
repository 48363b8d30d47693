"""Secrets in texts: strong patterns by themselves, weak parts only where complementary parts meet in one scope.

A credential is often stored in parts: an access identifier, a secret, an endpoint. Each part alone looks like ordinary
text, so weak candidates are proposed as intervals, and a sorted interval join within the text's scopes (stretches of
lines without a blank line between, and at most `reach` bytes apart) links them. A weak secret is reported only if an
identifier or an endpoint lies within reach in its scope, and likewise an identifier or endpoint only beside a secret.
A secret's credential lists every identifier and endpoint within reach, and names the nearest of each kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: Fixed patterns of the base kinds, over UTF-8 bytes (all their classes are ASCII).
BASE = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]{24,}"),
}
#: Weak parts of a credential, however long; each run of characters is read once.
IDENTIFIER = re.compile(rb"(?i:client|account|access|tenant|app|user)[_\x20-]?(?i:id|key|name)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{4,})")
ENDPOINT = re.compile(rb"(?<![a-z0-9+])[0-9+]*+([a-z][a-z0-9+]++://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]{4,}+)")
SECRET = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
HINT = re.compile(rb"(?i:id|key|name)[\"']?\x20*[:=]|://")
#: Kinds in the order that parts ties of start.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, credentials array<struct<scope:long,identifier:string,secret:string,endpoint:string,identifiers:array<string>,endpoints:array<string>>>"


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped and not tried again further on."""
    out = [(m.start(), m.end(), "assign") for m in BASE["assign"].finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), "access") for m in BASE["access"].finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in BASE["hex"].finditer(text)]


def entropy(x: bytes) -> float:
    return -sum((n := x.count(c)) / len(x) * log2(n / len(x)) for c in set(x)) if x else 0.0


def weak_parts(text: bytes) -> dict[str, list[tuple[int, int]]]:
    """Candidates by kind, in order of start. A weak secret mixes letters and digits and has 3.5 bits a byte or more."""
    if not HINT.search(text):
        return {}
    found = {"identifier": [m.span() for m in IDENTIFIER.finditer(text)], "endpoint": [m.span(1) for m in ENDPOINT.finditer(text)]}
    if not found["identifier"] and not found["endpoint"]:
        return {}
    starts = [s for s, _ in found["endpoint"]]
    inside = lambda x: (k := bisect_right(starts, x)) > 0 and x < found["endpoint"][k - 1][1]
    found["secret"] = [m.span() for m in SECRET.finditer(text) if re.search(rb"[0-9]", m[0]) and re.search(rb"[A-Za-z]", m[0]) and not inside(m.start()) and entropy(m[0]) >= 3.5]
    return found


def scopes(text: bytes) -> list[int]:
    """Starts of the stretches between blank lines."""
    return [0, *(m.end() for m in re.finditer(rb"\n[\x20\t\r]*\n", text))]


def link(text: bytes, strong: list[tuple[int, int, str]], reach: int) -> tuple[list[tuple[int, int, str]], list[tuple[int, dict]]]:
    """Weak spans that complementary parts support, and the credentials they make up: (scope, spans by kind)."""
    weak = weak_parts(text)
    if not weak:
        return [], []
    begin = scopes(text)
    scope = lambda x: bisect_left(begin, x[0] + 1)
    secrets = sorted({*weak["secret"], *((s, e) for s, e, _ in strong)})
    spans, found, known = set(), [], set(weak["secret"])
    near = {x: {} for x in secrets}
    for kind in ("identifier", "endpoint"):  # interval join: the parts of each kind, which don't overlap, within reach and scope
        parts = weak[kind]
        starts, ends = [s for s, _ in parts], [e for _, e in parts]
        for x in secrets:
            some = parts[bisect_left(ends, x[0] - reach) : bisect_right(starts, x[1] + reach)]
            near[x][kind] = [(gap, y) for y in some if (gap := max(y[0] - x[1], x[0] - y[1])) >= 0 and scope(x) == scope(y)]
    for x, others in near.items():
        if not any(others.values()):
            continue
        found.append((scope(x), {"secret": x, **{kind: min(some)[1] for kind, some in others.items() if some}, **{f"{kind}s": [y for _, y in some] for kind, some in others.items()}}))
        if x in known:
            spans.add((*x, "secret"))
        spans |= {(*y, kind) for kind, some in others.items() for _, y in some}
    return sorted(spans), found


def in_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte offsets as code points, in order of start, then kind."""
    at, last, points = {}, 0, 0
    for x in sorted({p for s, e, _ in spans for p in (s, e)}):
        points += len(text[last:x].decode())
        at[x], last = points, x
    return sorted(((at[s], at[e], k) for s, e, k in spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, reach: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: base counts, their digest, all spans (code points, end exclusive) and linked credentials.

    Null and empty texts have no spans. Null ids and repeated rows are kept as rows; other columns are ignored, whatever
    their names. No rows give no rows. Equal spans of several kinds are all reported; order is by start, then kind.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = {c.split()[0]: [] for c in SCHEMA.split(", ")[1:]}
                for text in texts_of(part.column("text")):
                    strong = base_spans(text)
                    more, found = link(text, strong, reach)
                    points = in_points(text, strong)
                    for kind in ("assign", "access", "hex"):
                        out[f"n_{kind}"].append(sum(k == kind for *_, k in strong))
                    out["base_sha256"].append(hashlib.sha256(joined(points).encode()).hexdigest())
                    out["spans"].append(joined(in_points(text, strong + more)) if more else joined(points))
                    out["n_linked"].append(len(found))
                    out["credentials"].append([{"scope": n, **{k: text[slice(*x[k])].decode() if k in x else None for k in ("identifier", "secret", "endpoint")}, **{k: [text[slice(*y)].decode() for y in x[k]] for k in ("identifiers", "endpoints")}} for n, x in found])
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.struct([("scope", pa.int64()), *((k, pa.string()) for k in ("identifier", "secret", "endpoint")), *((k, pa.list_(pa.string())) for k in ("identifiers", "endpoints"))]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
