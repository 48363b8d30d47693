"""Scalar functions with the engine's own null and type rules, as typed columns.

They don't depend on the session's ANSI setting: whole numbers wrap around as 32- and 64-bit integers do, division by zero
raises for whole numbers and follows IEEE 754 for others, AND and OR take null for false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import SchemaError, is_number, is_whole, show_type, wider

INT, LONG, FLOAT, DOUBLE, STRING, BOOLEAN = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType(), T.BooleanType()


@dataclass(frozen=True)
class Typed:
    """A column with its type. value: the constant that it is, for lists and patterns."""

    column: Column
    type: T.DataType
    value: object = None


def constant(value: object) -> Typed:
    kind = BOOLEAN if isinstance(value, bool) else INT if isinstance(value, int) and -(2**31) <= value < 2**31 else LONG if isinstance(value, int) else DOUBLE if isinstance(value, float) else STRING
    return Typed(F.lit(value).cast(kind), kind, value)


def _both(name: str, a: Typed, b: Typed, whole: bool = False) -> tuple[Column, Column, T.DataType]:
    kind = wider(a.type, b.type)
    if kind is None or not (is_whole(kind) if whole else is_number(kind)):
        raise SchemaError(f"{name} of {show_type(a.type)} and {show_type(b.type)}")
    return a.column.cast(kind), b.column.cast(kind), kind


def wrap(x: Column, kind: T.DataType) -> Column:
    """A wide whole number as the integer that its low 32 or 64 bits are."""
    half, full, wide = (2**31, 2**32, "bigint") if kind == INT else (2**63, 2**64, "decimal(20,0)")
    number = lambda n: F.lit(str(n)).cast(wide)
    return (F.pmod(x + number(half), number(full)) - number(half)).cast(kind)


def _arithmetic(name: str, tried: Callable, plain: Callable) -> Callable:
    def build(a: Typed, b: Typed) -> Typed:
        x, y, kind = _both(name, a, b)
        if not is_whole(kind):
            return Typed(plain(x, y).cast(kind), kind)
        wide = "bigint" if kind == INT else "decimal(38,0)" if name != "TIMES" else "decimal(19,0)"
        slow = wrap(plain(x.cast(wide), y.cast(wide)), kind)
        return Typed(F.coalesce(tried(x, y), F.when(x.isNotNull() & y.isNotNull(), slow)), kind)

    return build


add = _arithmetic("ADD", F.try_add, lambda x, y: x + y)
minus = _arithmetic("MINUS", F.try_subtract, lambda x, y: x - y)
times = _arithmetic("TIMES", F.try_multiply, lambda x, y: x * y)


def divide(a: Typed, b: Typed) -> Typed:
    x, y, kind = _both("DIVIDE", a, b)
    if is_whole(kind):
        least = F.lit(str(-(2**31) if kind == INT else -(2**63))).cast(kind)
        safe = F.when((y == 0) | ((y == -1) & (x == least)), F.lit(1).cast(kind)).otherwise(y)
        zero = (x.isNotNull()) & (y == 0)
        # the quotient's operands are known to be safe before it is taken
        quotient = F.call_function("div", x, safe).cast(kind)
        return Typed(F.when(zero, F.raise_error(F.lit("division by zero")).cast(kind)).when((y == -1) & (x == least), least).otherwise(quotient), kind)
    x, y = x.cast("double"), y.cast("double")
    negative = ((x < 0) != (y.cast("string") == "-0.0"))
    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    out = F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))
    return Typed(out.cast(kind), kind)


def mod(a: Typed, b: Typed) -> Typed:
    x, y, kind = _both("MOD", a, b, whole=True)
    safe = F.when((y == 0) | (y == -1), F.lit(1).cast(kind)).otherwise(y)  # the remainder by -1 is 0, as by 1
    return Typed(F.when(x.isNotNull() & (y == 0), F.raise_error(F.lit("division by zero")).cast(kind)).otherwise((x % safe).cast(kind)), kind)


def _shift(name: str, function: str) -> Callable:
    def build(a: Typed, b: Typed) -> Typed:
        if not (is_whole(a.type) and is_whole(b.type)):
            raise SchemaError(f"{name} of {show_type(a.type)} and {show_type(b.type)}")
        return Typed(F.call_function(function, a.column, b.column.cast("int")), a.type)

    return build


def _compare(name: str, test: Callable[[Column, Column], Column]) -> Callable:
    def build(a: Typed, b: Typed) -> Typed:
        kind = wider(a.type, b.type)
        if kind is None:
            if name in ("EQ", "NE"):  # values of types that don't meet are never equal
                known = a.column.isNotNull() & b.column.isNotNull()
                return Typed(F.when(known, F.lit(name == "NE")), BOOLEAN)
            raise SchemaError(f"{name} of {show_type(a.type)} and {show_type(b.type)}")
        return Typed(test(a.column.cast(kind), b.column.cast(kind)), BOOLEAN)

    return build


def _true(a: Typed, name: str) -> Column:
    if not isinstance(a.type, (T.BooleanType, T.NullType)):
        raise SchemaError(f"{name} of {show_type(a.type)}")
    return F.coalesce(a.column.cast("boolean"), F.lit(False))


def and_(a: Typed, b: Typed) -> Typed:
    return Typed(_true(a, "AND") & _true(b, "AND"), BOOLEAN)


def or_(a: Typed, b: Typed) -> Typed:
    return Typed(_true(a, "OR") | _true(b, "OR"), BOOLEAN)


def not_(a: Typed) -> Typed:
    _true(a, "NOT")
    return Typed(~a.column.cast("boolean"), BOOLEAN)


def in_(a: Typed, *items: Typed) -> Typed:
    kinds = [wider(a.type, i.type) for i in items]
    tests = [(a.column.cast(k) == i.column.cast(k)) for k, i in zip(kinds, items, strict=True) if k is not None]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return Typed(out, BOOLEAN)


def is_distinct(a: Typed) -> Typed:
    """True for one row of each value: over all rows, not those of one task."""
    return Typed(F.row_number().over(Window.partitionBy(a.column).orderBy(a.column)) == 1, BOOLEAN)


def matches(a: Typed, pattern: Typed) -> Typed:
    if not isinstance(a.type, (T.StringType, T.NullType)):
        raise SchemaError(f"MATCHES of {show_type(a.type)}")
    return Typed(F.regexp(a.column.cast("string"), F.concat(F.lit(r"\A(?:"), pattern.column, F.lit(r")\z"))), BOOLEAN)


def concat(*items: Typed) -> Typed:
    if len(items) < 2:
        raise SchemaError("CONCAT needs two values or more")
    return Typed(F.concat_ws("", *(i.column.cast("string") for i in items)), STRING)


def cast_to(kind: T.DataType, strict: bool = True) -> Callable:
    """Numbers narrow as in two's complement (whole) or to the nearest end (others); bad texts raise, or give null if not strict."""

    def build(a: Typed) -> Typed:
        x = a.column
        if a.type == kind:
            return a
        if kind == STRING:
            return Typed(x.cast("string"), kind)
        if isinstance(a.type, T.BooleanType):
            return Typed(x.cast("int").cast(kind), kind)
        if isinstance(a.type, T.StringType):
            out = x.try_cast(kind)
            if strict:
                out = F.when(x.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit(f"not a {show_type(kind)}: "), x)).cast(kind)).otherwise(out)
            return Typed(out, kind)
        if not is_number(a.type) and not isinstance(a.type, (T.NullType, T.ByteType)):
            raise SchemaError(f"a cast of {show_type(a.type)} to {show_type(kind)}")
        if kind == INT and a.type == LONG:
            return Typed(wrap(F.pmod(x, F.lit(2**32).cast("bigint")), INT), kind)
        if is_whole(kind) and a.type in (FLOAT, DOUBLE):
            lo, hi = (-(2**31), 2**31 - 1) if kind == INT else (-(2**63), 2**63 - 1)
            d = x.cast("double")
            inner = F.when(F.isnan(d) | (d >= float(hi)) | (d <= float(lo)), F.lit(0.0)).otherwise(d)
            return Typed(F.when(F.isnan(d), F.lit(0).cast(kind)).when(d >= float(hi), F.lit(hi).cast(kind)).when(d <= float(lo), F.lit(lo).cast(kind)).otherwise(inner.cast(kind)), kind)
        return Typed(x.cast(kind), kind)

    return build


def nvl(a: Typed, b: Typed) -> Typed:
    """The second where the first is null or an empty text."""
    kind = wider(a.type, b.type)
    if kind is None:
        raise SchemaError(f"NVL of {show_type(a.type)} and {show_type(b.type)}")
    x, y = a.column.cast(kind), b.column.cast(kind)
    return Typed(F.when(x.isNull() | (x == "") if kind == STRING else x.isNull(), y).otherwise(x), kind)


def case(*items: Typed) -> Typed:
    """CASE(condition, value, condition, value, …): null if none holds."""
    if len(items) < 2 or len(items) % 2:
        raise SchemaError("CASE needs pairs of a condition and a value")
    kind = items[1].type
    for v in items[3::2]:
        new = wider(kind, v.type)
        if new is None:
            raise SchemaError(f"CASE of {show_type(kind)} and {show_type(v.type)}")
        kind = new
    out = None
    for c, v in zip(items[::2], items[1::2], strict=True):
        out = (F if out is None else out).when(_true(c, "CASE"), v.column.cast(kind))
    return Typed(out, kind)


def sizeof(a: Typed) -> Typed:
    if not isinstance(a.type, (T.ArrayType, T.MapType)):
        raise SchemaError(f"SIZEOF of {show_type(a.type)}")
    return Typed(F.when(a.column.isNotNull(), F.size(a.column).cast("long")), LONG)


def to_bytes(a: Typed) -> Typed:
    return Typed(F.to_json(F.struct(a.column.alias("value"))).cast("binary"), T.BinaryType())


def unique_id() -> Typed:
    return Typed(F.spark_partition_id().cast("long"), LONG)


def seq_no() -> Typed:
    """1, 2, … within each partition."""
    return Typed(F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.lit(1).cast("long"), LONG)


BUILTINS: dict[str, Callable[..., Typed]] = {
    "ADD": add,
    "MINUS": minus,
    "TIMES": times,
    "DIVIDE": divide,
    "MOD": mod,
    "LSHIFT": _shift("LSHIFT", "shiftleft"),
    "RSHIFT": _shift("RSHIFT", "shiftrightunsigned"),
    "EQ": _compare("EQ", lambda x, y: x == y),
    "NE": _compare("NE", lambda x, y: x != y),
    "LT": _compare("LT", lambda x, y: x < y),
    "LE": _compare("LE", lambda x, y: x <= y),
    "GT": _compare("GT", lambda x, y: x > y),
    "GE": _compare("GE", lambda x, y: x >= y),
    "AND": and_,
    "OR": or_,
    "NOT": not_,
    "IS_NULL": lambda a: Typed(a.column.isNull(), BOOLEAN),
    "IS_NOT_NULL": lambda a: Typed(a.column.isNotNull(), BOOLEAN),
    "IN": in_,
    "ISDISTINCT": is_distinct,
    "MATCHES": matches,
    "CONCAT": concat,
    "CASTTOINT": cast_to(INT),
    "CASTTOLONG": cast_to(LONG),
    "CASTTOFLOAT": cast_to(FLOAT),
    "CASTTODOUBLE": cast_to(DOUBLE),
    "CASTTOSTRING": cast_to(STRING),
    "NVL": nvl,
    "CASE": case,
    "SIZEOF": sizeof,
    "TOBYTEARRAY": to_bytes,
    "UNIQUEID": unique_id,
    "SEQNO": seq_no,
}
