"""Functions, aggregates, cube aggregates and operators that users plug in by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import SchemaError
from .builtin import BUILTINS, Typed


class Registry:
    """What names stand for. A script's FUNCTION statements add aliases, with constructor arguments."""

    def __init__(self):
        self.functions: dict[str, Callable[..., Any]] = {}
        self.aggregates: dict[str, Callable[..., Column]] = {}
        self.operators: dict[str, Callable] = {}
        self.shuffles: dict[str, Callable] = {}
        self.storages: dict[str, Any] = {}

    def function(self, name: str, f: Callable[..., Any]) -> None:
        """f takes columns and gives a column: an expression, or a pandas_udf or udf."""
        self._new(self.functions, name, f)

    def aggregate(self, name: str, f: Callable[..., Column]) -> None:
        """f takes columns and gives an aggregate column: an expression or a grouped pandas_udf."""
        self._new(self.aggregates, name, f)

    def operator(self, name: str, f: Callable) -> None:
        """f takes DataFrames and a dict of parameters and gives a DataFrame."""
        self._new(self.operators, name, f)

    def shuffle(self, name: str, f: Callable) -> None:
        self._new(self.shuffles, name, f)

    @staticmethod
    def _new(table: dict, name: str, f: Callable) -> None:
        if name in table:
            raise SchemaError(f"{name} is declared already")
        table[name] = f

    def declare(self, alias: str, uri: str, args: list) -> None:
        """FUNCTION alias uri(args): uri is `module.name`, called with the arguments if there are any."""
        f = load(uri)
        if not (isinstance(f, type) and (hasattr(f, "end_measure") or hasattr(f, "take"))):  # cubes make their aggregates themselves
            f = f(*args) if args or isinstance(f, type) else f
        self._new(self.functions, alias, f)
        self.aggregates[alias] = f

    def find(self, name: str) -> Callable[..., Typed]:
        if name.upper() in BUILTINS and name not in self.functions:
            return BUILTINS[name.upper()]
        f = self.functions.get(name)
        if f is None:
            f = load(name) if "." in name else None
        if f is None:
            raise SchemaError(f"unknown function {name}")
        return f


def load(uri: str) -> Any:
    module, _, name = uri.rpartition(".")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise SchemaError(f"can't load {uri}: {e}") from e


def bag_of(column: Column) -> Column:
    """All values of a group as a bag, nulls included."""
    return F.collect_list(F.struct(column.alias("value")))


def presence_bitmap(column: Column, horizon: str) -> Column:
    """Bit d is set if a date (yyyyMMdd as a number, or yyyy-MM-dd) lies d days after the horizon, 0 to 31; nothing set is 0."""
    text = column.cast("string")
    day = F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    d = F.datediff(day, F.lit(horizon).cast("date"))
    return F.coalesce(F.bit_or(F.when(d.between(0, 31), F.call_function("shiftleft", F.lit(1), d))), F.lit(0))


#: Type of COUNT and its like.
LONG = T.LongType()
