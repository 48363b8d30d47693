"""Type names of schemas, their Spark types, and widening."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Fixed names of the engine's types. BAG and ARRAY hold tuples, TUPLE and RECORD are structs.
PRIMITIVES: dict[str, T.DataType] = {
    "BYTE": T.ByteType(),
    "BOOLEAN": T.BooleanType(),
    "INT": T.IntegerType(),
    "LONG": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "ENUM": T.StringType(),
    "BYTES": T.BinaryType(),
    "MAP": T.MapType(T.StringType(), T.StringType()),
    "UNKNOWN": T.NullType(),
}
NAMES = {T.ByteType: "BYTE", T.BooleanType: "BOOLEAN", T.IntegerType: "INT", T.LongType: "LONG", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "STRING", T.BinaryType: "BYTES", T.MapType: "MAP", T.NullType: "UNKNOWN"}
RANK = {T.IntegerType: 0, T.LongType: 1, T.FloatType: 2, T.DoubleType: 3}


class SchemaError(ValueError):
    """A program that can't be compiled."""


def parse_schema(text: str) -> T.StructType:
    """`INT a, STRING b, BAG c[TUPLE t(INT x, STRING y)]` as a struct."""
    tokens = re.findall(r"[A-Za-z_]\w*|[\[\](),]", text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise SchemaError(f"not a schema: {text!r}")
    fields, rest = _fields(tokens)
    if rest:
        raise SchemaError(f"not a schema: {text!r}")
    return fields


def _fields(tokens: list[str]) -> tuple[T.StructType, list[str]]:
    out = T.StructType()
    while tokens and tokens[0] not in ")]":
        if len(tokens) < 2:
            raise SchemaError(f"a type and a name are needed at {' '.join(tokens)!r}")
        kind, name, tokens = tokens[0].upper(), tokens[1], tokens[2:]
        inner = None
        if tokens and tokens[0] in "[(":
            close = {"[": "]", "(": ")"}[tokens[0]]
            inner, tokens = _fields(tokens[1:])
            if not tokens or tokens[0] != close:
                raise SchemaError(f"{close} is missing after {name}")
            tokens = tokens[1:]
        out.add(name, _type(kind, inner))
        if tokens and tokens[0] == ",":
            tokens = tokens[1:]
        elif tokens and tokens[0] not in ")]":
            raise SchemaError(f"a comma is missing before {tokens[0]}")
    return out, tokens


def _type(kind: str, inner: T.StructType | None) -> T.DataType:
    if kind in ("BAG", "ARRAY"):
        if inner is None:
            raise SchemaError(f"{kind} needs the schema of its elements")
        only = inner.fields[0].dataType if len(inner) == 1 else inner
        return T.ArrayType(only if isinstance(only, T.StructType) else inner)
    if kind in ("TUPLE", "RECORD"):
        if inner is None:
            raise SchemaError(f"{kind} needs a schema")
        return inner
    if kind not in PRIMITIVES:
        raise SchemaError(f"unknown type {kind}")
    return PRIMITIVES[kind]


def type_of(name: str) -> T.DataType:
    return _type(name.upper(), None)


def show_type(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return "BAG"
    if isinstance(t, T.StructType):
        return "TUPLE"
    return NAMES.get(type(t), t.simpleString().upper())


def show_schema(schema: T.StructType) -> str:
    def one(name: str, t: T.DataType) -> str:
        if isinstance(t, T.ArrayType):
            element = t.elementType if isinstance(t.elementType, T.StructType) else T.StructType().add("value", t.elementType)
            return f"BAG {name}[TUPLE element({show_schema(element)})]"
        if isinstance(t, T.StructType):
            return f"TUPLE {name}({show_schema(t)})"
        return f"{show_type(t)} {name}"

    return ", ".join(one(f.name, f.dataType) for f in schema)


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds both, or None. INT < LONG < FLOAT < DOUBLE; equal types hold themselves."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if type(a) in RANK and type(b) in RANK:
        return a if RANK[type(a)] >= RANK[type(b)] else b
    return None


def is_whole(t: T.DataType) -> bool:
    return isinstance(t, (T.IntegerType, T.LongType))


def is_number(t: T.DataType) -> bool:
    return type(t) in RANK
