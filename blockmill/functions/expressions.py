"""Expression trees to typed columns of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import SchemaError
from .builtin import BUILTINS, Typed
from .registry import Registry

KINDS = {"INT": T.IntegerType(), "LONG": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}


def compile_expression(tree, df: DataFrame, registry: Registry | None = None) -> Typed:
    """The tree's column over df, its types checked now rather than when it runs."""
    from ..plans.parser import Call, Const, Ref

    registry = registry or Registry()
    if isinstance(tree, Const):
        kind = KINDS[tree.kind]
        return Typed(F.lit(tree.value).cast(kind), kind, tree.value)
    if isinstance(tree, Ref):
        return _reference(tree, df.schema)
    assert isinstance(tree, Call)
    args = [compile_expression(a, df, registry) for a in tree.args]
    f = registry.find(tree.name)
    if f in BUILTINS.values():
        try:
            return f(*args)
        except TypeError as e:
            raise SchemaError(f"{tree.name} with {len(args)} values") from e
    made = f(*(a.column for a in args))
    if isinstance(made, Typed):
        return made
    if not isinstance(made, Column):
        raise SchemaError(f"{tree.name} gave no column")
    return Typed(made, df.select(made.alias("x")).schema["x"].dataType)


def _reference(ref, schema: T.StructType) -> Typed:
    first, *rest = ref.path
    if isinstance(first, int):
        if not 0 <= first < len(schema):
            raise SchemaError(f"no column ${first}")
        first = schema.fields[first].name
    if first not in schema.names:
        raise SchemaError(f"no column {first} among {', '.join(schema.names)}")
    column, kind = F.col(f"`{first}`"), schema[first].dataType
    for step in rest:
        if not isinstance(kind, T.StructType):
            raise SchemaError(f"{'.'.join(map(str, ref.path))}: {step} of what is no tuple")
        if isinstance(step, int):
            if not 0 <= step < len(kind):
                raise SchemaError(f"no field ${step}")
            step = kind.fields[step].name
        if step not in kind.names:
            raise SchemaError(f"no field {step} in {'.'.join(map(str, ref.path))}")
        column, kind = column.getField(step), kind[step].dataType
    if ref.key is not None:
        if not isinstance(kind, T.MapType):
            raise SchemaError(f"{'.'.join(map(str, ref.path))} is no map")
        column, kind = F.try_element_at(column, F.lit(ref.key)), kind.valueType
    return Typed(column, kind)


def expression(text: str, df: DataFrame, registry: Registry | None = None) -> Column:
    """The column that an expression's text stands for."""
    from ..plans.parser import parse_expression

    return compile_expression(parse_expression(text), df, registry).column


__all__ = ["compile_expression", "expression"]
