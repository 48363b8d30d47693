"""Chat formatting: prompt, instruction and message layouts to canonical turns, and turns to one marked text.

The layout of a record is known by the fingerprint (SHA-256) of its nested field paths. Fingerprints select declarative
mappings, so that a layout is added as data. Paths that no mapping names (metadata) don't count.

The template is `### role: text</turn>` and a line end for each turn. Inside roles and texts a backslash becomes \\b,
`</turn>` becomes \\e, `### ` becomes \\h, and in roles a colon becomes \\c, so that no text can end a turn or open one, and
`read_turns` gives back exactly what was formatted. Everything is DataFrame functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, StructType

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: What other layouts call the three common roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout: either a list field with role and text fields, or fields that each are one turn. optional: paths that may be absent or null."""

    name: str
    list_field: str | None = None
    role: str | None = None
    text: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, fields joined by a blank line
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        if self.list_field:
            return [self.list_field, f"{self.list_field}[].{self.role}", f"{self.list_field}[].{self.text}", *self.optional]
        return [f for _, fields in self.turns for f in fields]

    def fingerprints(self) -> list[str]:
        """Of the layout with any of its optional paths."""
        sets = [[p for p in self.paths() if p not in self.optional]]
        for p in self.optional:
            sets += [[*s, p] for s in sets]
        return [hashlib.sha256("\n".join(sorted(s)).encode()).hexdigest() for s in sets]


MAPPINGS = (
    Mapping("messages", "messages", "role", "content", optional=("system",)),
    Mapping("conversations", "conversations", "from", "value", optional=("system",)),
    Mapping("dialog", "dialog", "speaker", "text"),
    Mapping("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping("prompt_completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("question_answer", turns=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))), optional=("system", "context")),
)
TURNS = "array<struct<role:string,text:string>>"
#: The JSON reader gives null for longer strings than this says; a string holds no more bytes anyway.
LONGEST = "map('maxStringLen', '2147483647')"


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(items) -> str:
    return f"array({', '.join(map(_q, items))})" if items else "cast(array() AS array<string>)"


def _role(x: str, roles: dict[str, str]) -> str:
    return f"coalesce(map({', '.join(f'{_q(a)}, {_q(b)}' for a, b in roles.items())})[{x}], {x})" if roles else x


def _name(*parts: str) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts)


class _Json:
    """How a payload that is JSON text is read: its fields, the items of its lists, and the sorted known paths it has."""

    def __init__(self, lists: list[str], known: list[str]):
        self.lists, self.known = lists, known

    def opened(self, records: DataFrame) -> DataFrame:
        item = "map<string,string>"
        out = records.withColumn("_m", F.expr(f"from_json(payload, '{item}', {LONGEST})"))
        for name in self.lists:
            out = out.withColumn(f"_{name}", F.expr(f"from_json(_m[{_q(name)}], 'array<{item}>', {LONGEST})"))
        return out

    def paths(self) -> str:
        # a path with a null value doesn't count
        some = "map_keys(map_filter({0}, (k, v) -> v IS NOT NULL))"
        had = [f"coalesce({some.format('_m')}, array())"]
        had += [f"transform(flatten(transform(coalesce(_{n}, array()), x -> coalesce({some.format('x')}, array()))), k -> concat({_q(n + '[].')}, k))" for n in self.lists]
        return f"array_sort(array_intersect(concat({', '.join(had)}), {_strings(self.known)}))"

    def field(self, name: str) -> str:
        return f"_m[{_q(name)}]"

    def items(self, name: str) -> str:
        return f"_{name}"

    def part(self, of: str, name: str) -> str:
        return f"x[{_q(name)}]"


class _Nested:
    """The same of a payload that is a struct, whose fields and lists of structs are read as they are."""

    def __init__(self, kind: StructType, known: list[str]):
        self.kinds, self.known = {f.name: f.dataType for f in kind.fields}, known
        self.inside = {n: {f.name: f.dataType for f in k.elementType.fields} for n, k in self.kinds.items() if isinstance(k, ArrayType) and isinstance(k.elementType, StructType)}

    def opened(self, records: DataFrame) -> DataFrame:
        return records

    def paths(self) -> str:
        here = []
        for path in self.known:
            of, _, name = path.partition("[].")
            if not name and of in self.kinds:
                here.append(f"CASE WHEN {_name('payload', of)} IS NOT NULL THEN {_q(path)} END")
            elif name in self.inside.get(of, {}):
                here.append(f"CASE WHEN exists({_name('payload', of)}, x -> {_name('x', name)} IS NOT NULL) THEN {_q(path)} END")
        return f"array_sort(filter(array({', '.join(here)}), p -> p IS NOT NULL))" if here else _strings([])

    def _text(self, x: str, kind) -> str:
        return f"CAST({x} AS STRING)" if isinstance(kind, AtomicType) else f"to_json({x})"

    def field(self, name: str) -> str:
        return self._text(_name("payload", name), self.kinds[name]) if name in self.kinds else "CAST(NULL AS STRING)"

    def items(self, name: str) -> str:
        return _name("payload", name) if name in self.inside else f"CAST(NULL AS {TURNS})"

    def part(self, of: str, name: str) -> str:
        return self._text(_name("x", name), self.inside[of][name]) if name in self.inside.get(of, {}) else "CAST(NULL AS STRING)"


def canonical_turns(records: DataFrame, payload_col: str = "payload", mappings: tuple[Mapping, ...] = MAPPINGS, roles: dict[str, str] = ROLES) -> DataFrame:
    """records with `fingerprint`, `layout` (a mapping's name, or null) and `turns` added.

    The payload is a JSON object as text, or a struct, whose texts may be of any length and hold any characters. The
    fingerprint is taken of each record, from those known paths under which it has a value. Records that are null, no
    object or of an unknown layout have no layout and an empty list of turns; null texts are empty; a turn of fields that all are absent is left out. Lists keep their order,
    and repeated turns stay. Roles by which other layouts call the common ones get the common name (`roles`; none: they stay). Repeated
    records are rows each; all columns of records pass through, whatever their names, but for fingerprint, layout and
    turns, which are replaced. No rows give no rows.
    """
    kept = [c for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    kind = records.select(F.col(f"`{payload_col}`")).schema[0].dataType
    payload = F.col(f"`{payload_col}`") if isinstance(kind, StructType) else F.col(f"`{payload_col}`").cast("string")
    records = records.select(F.struct(F.lit(1).alias("_1"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept))).alias("row"), payload.alias("payload"))
    known = sorted({p for m in mappings for p in m.paths()})
    read = _Nested(kind, known) if isinstance(kind, StructType) else _Json(sorted({m.list_field for m in mappings if m.list_field}), known)
    out = read.opened(records).withColumn("fingerprint", F.expr(f"sha2(array_join({read.paths()}, '\n'), 256)"))
    cases, layouts = [], []
    for m in mappings:
        when = f"fingerprint IN ({', '.join(map(_q, m.fingerprints()))})"
        layouts.append(f"WHEN {when} THEN {_q(m.name)}")
        if m.list_field:
            role = _role(f"coalesce({read.part(m.list_field, m.role)}, '')", roles)
            turns = f"transform({read.items(m.list_field)}, x -> named_struct('role', {role}, 'text', coalesce({read.part(m.list_field, m.text)}, '')))"
            if "system" in m.optional:
                turns = f"concat(CASE WHEN {read.field('system')} IS NOT NULL THEN array(named_struct('role', 'system', 'text', {read.field('system')})) ELSE cast(array() AS {TURNS}) END, {turns})"
        else:
            each = []
            for role, fields in m.turns:
                values = ", ".join(map(read.field, fields))
                each.append(f"named_struct('role', {_q(role)}, 'text', CASE WHEN coalesce({values}) IS NOT NULL THEN concat_ws('\n\n', {values}) END)")
            turns = f"filter(array({', '.join(each)}), t -> t.text IS NOT NULL)"
        cases.append(f"WHEN {when} THEN {turns}")
    out = out.withColumn("layout", F.expr(f"CASE {' '.join(layouts)} END")).withColumn("turns", F.expr(f"coalesce(cast(CASE {' '.join(cases)} END AS {TURNS}), cast(array() AS {TURNS}))"))
    return out.select(*(F.col("row").getField(f"c{k}").alias(c) for k, c in enumerate(kept)), "fingerprint", "layout", "turns")


def _escaped(x: str, role: bool = False) -> str:
    x = f"replace(replace(replace({x}, '\\\\', '\\\\b'), '</turn>', '\\\\e'), '### ', '\\\\h')"
    return f"replace({x}, ':', '\\\\c')" if role else x


def _plain(x: str, role: bool = False) -> str:
    x = f"replace({x}, '\\\\c', ':')" if role else x
    return f"replace(replace(replace({x}, '\\\\h', '### '), '\\\\e', '</turn>'), '\\\\b', '\\\\')"


def format_turns(turns: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Adds `formatted` and `loss_runs`: for each turn, how many code points to skip and then to train on.

    Columns of those two names are replaced; others pass through. Training is on turns of the role assistant.
    """
    role, text = _escaped("t.role", True), _escaped("t.text")
    piece = f"concat('{OPEN}', {role}, '{MIDDLE}', {text}, '</turn>\n')"
    skip = f"length(concat('{OPEN}', {role}, '{MIDDLE}'))"
    runs = f"transform(`{turns_col}`, t -> named_struct('skip', {skip}, 'take', CASE WHEN t.role = 'assistant' THEN length({text}) ELSE 0 END, 'after', {len(CLOSE)} + CASE WHEN t.role = 'assistant' THEN 0 ELSE length({text}) END))"
    return turns.withColumn("formatted", F.expr(f"array_join(transform(`{turns_col}`, t -> {piece}), '')")).withColumn("loss_runs", F.expr(runs))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Adds what `formatted` and `loss_runs` say: `read` (the turns) and `loss_text` (texts under the mask, unescaped).

    Columns of those two names are replaced; others pass through. An empty `formatted` is no turns.
    """
    pieces = "slice(_p, 1, size(_p) - 1)"
    at = f"locate('{MIDDLE}', p)"
    role = f"substring(p, {len(OPEN) + 1}, {at} - {len(OPEN) + 1})"
    text = f"substring(p, {at} + {len(MIDDLE)}, length(p))"
    read = f"transform({pieces}, p -> named_struct('role', {_plain(role, True)}, 'text', {_plain(text)}))"
    masked = "substring(p, r.skip + 1, r.take)"
    loss = f"array_join(zip_with({pieces}, loss_runs, (p, r) -> {_plain(masked)}), '')"
    # every piece is a turn: skip + take + after is its length with its end
    others = [F.col(f"`{c}`") for c in formatted.columns if c not in ("read", "loss_text")]
    split = formatted.select(F.struct(*others).alias("row"), F.split("formatted", "</turn>\n").alias("_p"), "loss_runs")
    return split.select("row.*", F.expr(read).alias("read"), F.expr(loss).alias("loss_text"))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, fingerprint, layout, turns, formatted, loss_runs) per conversation of rows by turn.

    Turns are in order of the turn's number, then role, then text; nulls come first and null roles and texts are empty.
    Repeated rows are turns of their own. Rows without an id make up one conversation. Other columns are ignored, whatever
    their names. No rows give no rows. A conversation becomes a record of messages with role and content, which goes
    through `canonical_turns` as any record does: its own fingerprint selects its layout, and without one of mappings it has
    no turns. Roles are those of the rows. A conversation is one row, and so holds 2 GB of text at most.
    """
    rows = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    records = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("r")).selectExpr("conv_id", "named_struct('messages', transform(r, x -> named_struct('role', x.role, 'content', x.text))) AS payload")
    return format_turns(canonical_turns(records, mappings=mappings, roles={}).drop("payload"))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), as read back from the formatted text.

    A row for each of `format_conversations`; a conversation without turns has counts of 0 and the digests of no text.
    """
    said = "array_join(transform(read, t -> concat(t.role, '\n', t.text, '\n')), '')"
    return read_turns(formatted).selectExpr("conv_id", "CAST(size(read) AS BIGINT) AS n_turns", f"sha2({said}, 256) AS turns_sha256", "CAST(length(loss_text) AS BIGINT) AS loss_chars", "sha2(loss_text, 256) AS loss_sha256", "CAST(length(formatted) AS BIGINT) AS formatted_chars")
