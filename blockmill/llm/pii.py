"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Everything is DataFrame functions. A pattern's matches are marked in the text with a character that the text doesn't have,
the text is split there, and the pieces' running lengths give the matches' places; the pieces beside a match are its
context. Running sums are taken in chunks of about the square root of their number, so that no step copies all that came
before it. Patterns are written so that they take time in proportion to the text (possessive, or of bounded length, and
begun only where a run begins).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\x01"
MAIL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """quick: what any match holds. check: SQL over the match m. base: reported whatever its score. words: nearby words that raise the score. retry: the pattern is tried at every place, and on a failed check the match is tried without its last words."""

    name: str
    pattern: str
    quick: str
    check: str
    confirmed: float
    base: bool
    words: str
    retry: bool = False


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_PARTS = "forall(split(m, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 AND coalesce(try_cast(right(p, 3) AS INT), 0) <= 255)"
_IBAN = "regexp_replace(m, ' ', '')"
# mod 97 of the account's digits and letters (A is 10), its first four characters last
_MOD97 = f"aggregate(split(concat(substring({_IBAN}, 5, 40), substring({_IBAN}, 1, 4)), ''), 0, (r, c) -> CASE WHEN c = '' THEN r WHEN c BETWEEN '0' AND '9' THEN (r * 10 + ascii(c) - 48) % 97 ELSE (r * 100 + ascii(c) - 55) % 97 END) = 1"

#: In the order that parts ties of start.
KINDS = (
    Kind("email", rf"(?:(?<![{MAIL}])|\G)[{MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.9, True, "mail|contact|write|kontakt|courriel|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", _PARTS, 0.7, True, r"\bip\b|host|server|address|adresse|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", f"length({_DIGITS}) BETWEEN 14 AND 19 AND luhn_check({_DIGITS})", 0.8, True, "card|visa|master|credit|karte|carte|tarjeta|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", 0.7, True, "phone|call|mobile|whatsapp|telefon|anruf|appel|llam"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", f"length({_IBAN}) BETWEEN 15 AND 34 AND {_MOD97}", 0.8, False, "iban|bank|account|konto|compte|cuenta", True),
    # without a checksum: reported only beside words that say what it is
    Kind("national_phone", r"(?<![0-9+(.-])\(?0[0-9]{2,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9])", "0[0-9]{2}", "true", 0.3, False, "phone|call|mobile|whatsapp|telefon|anruf|appel|llam|tel"),
)
#: Words that speak against a span of digits.
AGAINST = "version|isbn|order no|invoice|serial"
LEAST, CONTEXT, RAISE, LOWER = 0.5, 40, 0.25, 0.3
SPAN = "struct<start:int,end:int,kind:string,rank:int,base:boolean,score:double>"


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body with the value, worked out once, by that name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(values: str, fold: str, start: int) -> str:
    """For an array of ints, one or more: what folding gives before each of them, and at last over all. fold: SQL over {0} and {1}."""
    begin = f"named_struct('at', {start}, 'out', cast(array() AS array<int>))"
    step = lambda x: f"named_struct('at', {fold.format('a.at', x)}, 'out', concat(a.out, array(a.at)))"
    wide = "CAST(ceil(sqrt(size(v))) AS INT)"
    chunks = f"transform(sequence(0, CAST((size(v) - 1) div {wide} AS INT)), k -> aggregate(slice(v, k * {wide} + 1, {wide}), {begin}, (a, x) -> {step('x')}))"
    tops = f"aggregate(chunk, {begin}, (a, y) -> {step('y.at')})"
    whole = f"concat(flatten(transform(chunk, (y, k) -> transform(y.out, x -> {fold.format('tops.out[k]', 'x')}))), array(tops.at))"
    return _let(values, "v", _let(chunks, "chunk", _let(tops, "tops", whole)))


def _span(rank: int, k: Kind, start: str, m: str, before: str, after: str) -> str:
    near = f"lower(concat({before}, ' ', {after}))"
    score = _let(near, "w", f"CAST({k.confirmed} + CASE WHEN w RLIKE {_q(k.words)} THEN {RAISE} ELSE 0.0 END - CASE WHEN w RLIKE {_q(AGAINST)} THEN {LOWER} ELSE 0.0 END AS DOUBLE)")
    return f"named_struct('start', {start}, 'end', {start} + length({m}), 'kind', '{k.name}', 'rank', {rank}, 'base', {str(k.base).lower()}, 'score', {score})"


def _beside(places: list[str]) -> tuple[str, str]:
    """The context before and after, from pieces at offsets of i, nearest first."""
    before = ", ".join(f"right(coalesce(get(p, i - {x}), ''), {CONTEXT})" for x in reversed(places))
    after = ", ".join(f"left(coalesce(get(p, i + {x}), ''), {CONTEXT})" for x in places)
    return f"right(concat({before}), {CONTEXT})", f"left(concat({after}), {CONTEXT})"


def _found(rank: int, k: Kind) -> str:
    """Array of spans of a kind in `_text`, in order of start."""
    none = f"cast(array() AS array<{SPAN}>)"
    odd = "sequence(1, size(p) - 2, 2)"
    if k.retry:  # copies of the matches, which may overlap, go before their places; of each the longest start that passes
        pieces = f"split(regexp_replace(_text, {_q(f'(?=({k.pattern}))')}, '{MARK}$1{MARK}'), '{MARK}')"
        starts = "transform(sequence(size(split(x, ' ')), 1, -1), n -> array_join(slice(split(x, ' '), 1, n), ' '))"
        best = _let("p[i]", "x", f"coalesce(get(filter({starts}, m -> {k.check}), 0), '')")
        before, _ = _beside(["1", "3", "5"])
        after = f"substring(concat(coalesce(get(p, i + 1), ''), left(coalesce(get(p, i + 3), ''), {CONTEXT + 50}), left(coalesce(get(p, i + 5), ''), {CONTEXT + 50})), length(m) + 1, {CONTEXT})"
        tried = f"filter(transform({odd}, i -> {_let(best, 'm', _span(rank, k, 'o[i]', 'm', before, after))}), s -> s.end > s.start)"
        # one that begins inside an earlier one is dropped; the pattern leaves room for 9 beginnings in a match
        spans = _let(tried, "f", "filter(f, (s, n) -> NOT exists(slice(f, greatest(n - 9, 0) + 1, least(n, 9)), e -> e.end > s.start))")
        size = "transform(p, (x, i) -> CASE WHEN i % 2 = 1 THEN 0 ELSE length(x) END)"
    else:
        pieces = f"split(regexp_replace(_text, {_q(k.pattern)}, '{MARK}$0{MARK}'), '{MARK}')"
        spans = f"transform(filter({odd}, i -> exists(array(p[i]), m -> {k.check})), i -> {_span(rank, k, 'o[i]', 'p[i]', *_beside(['1', '2', '3']))})"
        size = "transform(p, x -> length(x))"
    found = _let(pieces, "p", f"CASE WHEN size(p) < 3 THEN {none} ELSE {_let(_scan(size, '{0} + {1}', 0), 'o', spans)} END")
    found = found if k.base else f"filter({found}, s -> s.score >= {LEAST})"
    return f"CASE WHEN _text RLIKE {_q(k.quick)} THEN {found} ELSE {none} END"


_ORDER = "(x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start WHEN x.rank <> y.rank THEN x.rank - y.rank ELSE x.end - y.end END"
_NEVER = 2**31 - 1


def _merged(kinds: tuple[Kind, ...]) -> str:
    """All spans in order; those of other kinds that touch a base span are left out."""
    none = f"cast(array() AS array<{SPAN}>)"
    base = f"concat({', '.join([none, *(_found(r, k) for r, k in enumerate(kinds) if k.base)])})"
    more = f"concat({', '.join([none, *(_found(r, k) for r, k in enumerate(kinds) if not k.base)])})"
    last = _scan("transform(z, s -> CASE WHEN s.base THEN s.end ELSE 0 END)", "greatest({0}, {1})", 0)
    following = _scan(f"transform(reverse(z), s -> CASE WHEN s.base THEN s.start ELSE {_NEVER} END)", "least({0}, {1})", _NEVER)
    apart = _let(last, "g", _let(following, "h", "filter(z, (s, n) -> s.base OR (g[n] <= s.start AND h[size(z) - 1 - n] >= s.end))"))
    return _let(base, "b", _let(more, "e", f"CASE WHEN size(e) = 0 THEN array_sort(b, {_ORDER}) WHEN size(b) = 0 THEN array_sort(e, {_ORDER}) ELSE {_let(f'array_sort(concat(b, e), {_ORDER})', 'z', apart)} END"))


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with `pii` added: the spans (with their scores) by start, then kind, in code points, the end exclusive.

    Base kinds report every match that passes its check. Other kinds report what reaches the least score and touches no
    base span. Null and empty texts have no spans. Repeated rows are rows of their own; other columns pass through,
    whatever their names, but a column pii is replaced. A text is read whole, however long. No rows give no rows.
    """
    kept = [c for c in docs.columns if c != "pii"]
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), MARK, "\x02")
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept))).alias("row"), text.alias("_text"))
    return rows.withColumn("pii", F.expr(_merged(kinds))).select(*(F.col("row").getField(f"c{k}").alias(c) for k, c in enumerate(kept)), "pii")


def joined(base_only: bool) -> Column:
    spans = "filter(pii, s -> s.base)" if base_only else "pii"
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with each span replaced by its kind in brackets; overlapping spans give one replacement. Null stays null.

    The text is cut to pieces of 1,024 code points, so that what lies between two spans is found without reading it from
    its beginning.
    """
    text = f"`{text_col}`"
    gap = "CASE WHEN g.b <= g.a THEN '' WHEN shiftright(g.a, 10) = shiftright(g.b - 1, 10) THEN substring(c[shiftright(g.a, 10)], (g.a & 1023) + 1, g.b - g.a) ELSE concat(substring(c[shiftright(g.a, 10)], (g.a & 1023) + 1, 1024), array_join(slice(c, shiftright(g.a, 10) + 2, shiftright(g.b - 1, 10) - shiftright(g.a, 10) - 1), ''), left(c[shiftright(g.b - 1, 10)], ((g.b - 1) & 1023) + 1)) END"
    between = lambda a, b: _let(f"named_struct('a', {a}, 'b', {b})", "g", gap)
    done = f"concat(array_join(transform(s, (x, n) -> CASE WHEN x.start >= m[n] THEN concat({between('m[n]', 'x.start')}, '[', upper(x.kind), ']') ELSE '' END), ''), {between('m[size(s)]', f'length({text})')})"
    last = _scan("transform(s, x -> x.end)", "greatest({0}, {1})", 0)
    whole = _let("pii", "s", _let(last, "m", _let(f"regexp_extract_all({text}, '(?s).{{1,1024}}', 0)", "c", done)))
    return found.withColumn(text_col, F.expr(f"CASE WHEN size(pii) > 0 THEN {whole} ELSE {text} END"))


def redact_documents(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs, the same columns whatever their names, with personal data in the texts replaced."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    done = redact(find_pii(whole, kinds=kinds))
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts of the base kinds, base_sha256, spans, n_more, scores) per row of docs; scores are those of spans, in order.

    Null and empty texts have counts of 0. Null ids and repeated rows are rows of their own; other columns are ignored,
    whatever their names. No rows give no rows.
    """
    found = find_pii(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    counts = [F.expr(f"CAST(size(filter(pii, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    scores = F.expr("array_join(transform(pii, s -> format_number(s.score, 2)), ',')").alias("scores")
    return found.select("doc_id", *counts, F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"), F.expr("CAST(size(filter(pii, s -> NOT s.base)) AS BIGINT)").alias("n_more"), scores)
