"""An incremental view for distinct counts over the last days.

The view keeps, for each group and member, a bitmap of the days (from the horizon on, 31 at most) on which the member was
seen. A refresh reads only the days after the last one: stored bitmaps shift as the horizon moves forward, the new days'
bits are joined by OR, and members without a day left drop out.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import SchemaError

DAYS = 31


@dataclass(frozen=True)
class SummaryView:
    """table: (dims…, member, bitmap). horizon: the first day, refreshed: the last day in it."""

    dims: tuple[str, ...]
    member: str
    day: str
    horizon: date
    refreshed: date
    table: DataFrame

    @staticmethod
    def create(facts: DataFrame, dims: list[str], member: str, day: str, start: date, end: date) -> SummaryView:
        _check(start, end)
        return SummaryView(tuple(dims), member, day, start, end, _bits(facts, dims, member, day, start, start, end))

    def refresh(self, facts: DataFrame, start: date, end: date) -> SummaryView:
        """The view of start to end. Only facts after the last refresh are read."""
        _check(start, end)
        if start < self.horizon:
            raise SchemaError("days before the view's horizon aren't in it")
        if end < self.refreshed:
            raise SchemaError("the view can't end before its last refresh")
        shift = (start - self.horizon).days
        keys = [*self.dims, self.member]
        old = self.table.withColumn("bitmap", F.call_function("shiftrightunsigned", F.col("bitmap"), F.lit(min(shift, 31))) if shift < 32 else F.lit(0))
        first = max(start, date.fromordinal(self.refreshed.toordinal() + 1))
        new = _bits(facts, list(self.dims), self.member, self.day, start, first, end)
        both = old.unionByName(new).groupBy(*keys).agg(F.bit_or("bitmap").alias("bitmap")).where("bitmap <> 0")
        return SummaryView(self.dims, self.member, self.day, start, end, both)

    def counts(self, start: date | None = None, end: date | None = None, cube: bool = False, name: str = "members") -> DataFrame:
        """Distinct members of each group (or cell of the cube) over days of the view, all by default."""
        lo = ((start or self.horizon) - self.horizon).days
        hi = ((end or self.refreshed) - self.horizon).days
        if lo < 0 or hi < lo or (end or self.refreshed) > self.refreshed:
            raise SchemaError("the days asked for aren't all in the view")
        mask = ((1 << (hi - lo + 1)) - 1) << lo
        mask = mask - 2**32 if mask >= 2**31 else mask
        seen = self.table.where((F.col("bitmap").bitwiseAND(F.lit(mask).cast("int"))) != 0).where(F.col(self.member).isNotNull())
        grouped = seen.cube(*self.dims) if cube else seen.groupBy(*self.dims)
        return grouped.agg(F.countDistinct(self.member).alias(name))


def _check(start: date, end: date) -> None:
    if end < start or (end - start).days >= DAYS:
        raise SchemaError(f"a summary view holds 1 to {DAYS} days")


def _bits(facts: DataFrame, dims: list[str], member: str, day: str, horizon: date, start: date, end: date) -> DataFrame:
    days = facts.where(F.col(day).cast("date").between(F.lit(start), F.lit(end)))
    d = F.datediff(F.col(day).cast("date"), F.lit(horizon))
    return days.groupBy(*dims, member).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), d)).alias("bitmap"))
