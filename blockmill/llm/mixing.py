"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut to blocks of equal size. Weights are whole numbers w of a sum
W. Block i of a source is released at slot floor(i W / w) and due by slot ceil((i + 1) W / w); earliest deadline first among
the released fills every slot on time, so that after any number of slots each source is less than one block away from
its exact share. All releases and deadlines repeat after W slots (the weights freed of their common divisor), so only one
such period is scheduled (on the driver, W being bounded); where a block goes then follows from its number alone, and the
rest is DataFrame functions.
"""

from __future__ import annotations

import heapq
import json
from math import gcd, isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the operator's own making are whole parts of about this many, one at least.
PARTS = 1024
#: Slots of a period, at most: larger weights must be rounded by who gives them (the period is planned on the driver).
PERIOD_MOST = 1 << 20
#: More sources than this must be grouped first.
SOURCES_MOST = 20_000
#: Documents whose order and offsets are worked out in one group; a source has as many groups as it needs, by digits of a
#: hash, and their sums are added up in groups of 16^LEVEL.
GROUP, LEVEL = 5_000, 3


def own_weights(chars: dict[str, int]) -> dict[str, int]:
    """The square root of each source's characters, as whole parts of about PARTS, one at least."""
    roots = {s: isqrt(n) for s, n in chars.items()}
    return {s: max(1, PARTS * r // max(1, sum(roots.values()))) for s, r in roots.items()}


def schedule(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period, by earliest deadline among the released; ties go to the smaller name."""
    slots, names = sum(weights.values()), sorted(weights)
    out: dict[str, list[int]] = {s: [] for s in names}
    released: list[list[str]] = [[] for _ in range(slots)]
    released[0] = list(names)
    ready: list[tuple[int, str]] = []  # (deadline, source)
    for t in range(slots):
        for s in released[t]:
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * slots // weights[s]), s))
        _, s = heapq.heappop(ready)
        out[s].append(t)
        if len(out[s]) < weights[s]:  # the next block is released later than its predecessor's slot, or at once
            released[max(t + 1, len(out[s]) * slots // weights[s])].append(s)
    return out


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_chars: int = 100_000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(doc_id, source, n_chars, block, at, slot, on_target, and the columns to carry) for each row of docs; the mix is their order by slot, then at.

    weights: of each source, in whole numbers above 0; sources without one have weight 1, and without any weights a source's
    is the square root of its characters, as a whole part of about 1,024. at: where the document begins in its block; a
    document longer than a block takes the slot of the block that it begins in, and the blocks that it covers stay free of
    others. When a source has run out, the others go on in their own slots; on_target tells the slots before that. Weights
    that sum to more than PERIOD_MOST without their common divisor are refused, and so are more than SOURCES_MOST sources.

    Null sources are the source ''; null texts have no characters; null ids come first in a source's order, and repeated
    rows are rows of their own (their order among themselves is free). carry: columns of docs that the result keeps, such as
    the text; names that the result has already are not carried. Other columns are ignored, whatever their names. No rows
    give no rows.
    """
    spark = docs.sparkSession
    own = ["doc_id", "source", "n_chars", "block", "at", "slot", "on_target"]
    carry = [c for c in carry if c not in own]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # rows of one id, or without an id, are told apart by their texts
    mixed = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("\n"), F.md5(text)))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"), F.length(text).cast("long").alias("n_chars"), mixed.alias("mixed"), F.struct(F.lit(1).alias("_1"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry))).alias("carried"))
    totals = rows.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("docs")).limit(SOURCES_MOST + 1).collect()
    if len(totals) > SOURCES_MOST:
        raise ValueError(f"more than {SOURCES_MOST} sources: group them first")
    carried = [F.col("carried").getField(f"c{k}").alias(c) for k, c in enumerate(carry)]
    if not totals:
        return rows.select("doc_id", "source", "n_chars", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("slot"), F.lit(True).alias("on_target"), *carried)
    weight = own_weights({r.source: r.chars for r in totals}) if weights is None else {r.source: weights.get(r.source, 1) for r in totals}
    if min(weight.values()) < 1:
        raise ValueError("weights are whole numbers above 0")
    common = gcd(*weight.values())
    weight = {s: w // common for s, w in weight.items()}
    slots = sum(weight.values())
    if slots > PERIOD_MOST:
        raise ValueError(f"the weights sum to {slots} without their common divisor, more than {PERIOD_MOST}: give rounder ones")
    plan = schedule(weight)
    blocks = {r.source: -(-r.chars // block_chars) for r in totals}
    horizon = min(b // weight[s] * slots + plan[s][b % weight[s]] for s, b in blocks.items())

    digits = 0
    while max(r.docs for r in totals) > GROUP * 16**digits:
        digits += 1
    rows = rows.withColumn("part", F.substring("mixed", 1, digits))
    # prefix sums by levels of digits, so that no source, and no level's group, is large
    within = Window.partitionBy("source", "part").orderBy("mixed", "doc_id", "n_chars").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_chars").over(within), F.lit(0)))
    if digits:
        slim = docs.select(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"), F.substring(mixed, 1, digits).alias("part"), F.length(text).cast("long").alias("n"))
        rows = rows.join(_starts(slim.groupBy("source", "part").agg(F.sum("n").alias("n")), digits), ["source", "part"]).withColumn("before", F.col("before") + F.col("start"))
    listed = json.dumps([{"source": s, "weight": weight[s], "slots": plan[s]} for s in sorted(plan)]).replace("\\", "\\\\").replace("'", "\\'")
    # a slot for each of a period, at most PERIOD_MOST in all
    pattern = F.broadcast(spark.sql(f"SELECT inline(from_json('{listed}', 'array<struct<source:string,weight:bigint,slots:array<bigint>>>'))"))
    rows = rows.join(pattern, "source").withColumn("block", F.expr(f"before div {block_chars}")).withColumn("at", F.expr(f"before % {block_chars}"))
    rows = rows.withColumn("slot", F.expr(f"block div weight * {slots} + slots[CAST(block % weight AS INT)]"))
    return rows.select("doc_id", "source", "n_chars", "block", "at", "slot", (F.col("slot") < horizon).alias("on_target"), *carried)


def _starts(sums: DataFrame, digits: int) -> DataFrame:
    """(source, part, start): the sum of n in the source's parts before each, from (source, part, n)."""
    held = max(0, digits - LEVEL)
    over = F.substring("part", 1, held)
    upto = Window.partitionBy("source", over).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    here = sums.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    if not held:
        return here.select("source", "part", "start")
    above = _starts(sums.groupBy("source", over.alias("part")).agg(F.sum("n").alias("n")), held).select("source", F.col("part").alias("over"), F.col("start").alias("more"))
    return here.withColumn("over", over).join(above, ["source", "over"]).select("source", "part", (F.col("start") + F.col("more")).alias("start"))


def mix_oracle(block_chars: int) -> str:
    """DuckDB SQL for `mix(documents)` with weights of its own making."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || md5(coalesce(text, ''))) AS mixed FROM documents
), o AS (
  SELECT *, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY mixed, doc_id NULLS FIRST, n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d
), r AS (
  SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(floor(sqrt(CAST(sum(n_chars) AS DOUBLE))) AS BIGINT) AS root FROM d GROUP BY source
), u AS (
  SELECT source, chars, greatest(1, {PARTS} * root // greatest(1, CAST(sum(root) OVER () AS BIGINT))) AS weight FROM r
), g AS (
  SELECT max(k) AS common FROM range(1, {PARTS} + 2) t(k) WHERE (SELECT bool_and(weight % k = 0) FROM u)
), q AS (
  SELECT source, chars, weight // common AS weight, CAST(sum(weight // common) OVER () AS BIGINT) AS slots FROM u, g
), lists AS (
  SELECT list(source ORDER BY source) AS names, list(weight ORDER BY source) AS weights, any_value(slots) AS slots FROM q
), s AS (
  SELECT CAST(-1 AS BIGINT) AS t, 0 AS chosen, list_transform(weights, lambda x: CAST(0 AS BIGINT)) AS done FROM lists
  UNION ALL
  SELECT t, chosen, list_transform(done, lambda x, i: x + CASE WHEN i = chosen THEN 1 ELSE 0 END) FROM (
    SELECT s.t + 1 AS t, s.done, list_position(due, list_min(due)) AS chosen FROM (
      SELECT s.t, s.done, list_transform(s.done, lambda x, i: CASE WHEN x < weights[i] AND x * slots // weights[i] <= s.t + 1 THEN (x + 1) * slots // weights[i] + CASE WHEN (x + 1) * slots % weights[i] > 0 THEN 1 ELSE 0 END END) AS due
      FROM s, lists WHERE s.t + 1 < slots
    ) s
  )
), slot AS (
  SELECT names[chosen] AS source, t, row_number() OVER (PARTITION BY chosen ORDER BY t) - 1 AS i FROM s, lists WHERE t >= 0
), h AS (
  SELECT min((e.blocks // e.weight) * e.slots + slot.t) AS horizon
  FROM (SELECT *, (chars + {block_chars} - 1) // {block_chars} AS blocks FROM q) e JOIN slot ON slot.source = e.source AND slot.i = e.blocks % e.weight
)
SELECT doc_id, o.source, n_chars, before // {block_chars} AS block, before % {block_chars} AS at,
  (before // {block_chars} // weight) * slots + slot.t AS slot,
  (before // {block_chars} // weight) * slots + slot.t < horizon AS on_target
FROM o JOIN q ON q.source = o.source JOIN slot ON slot.source = o.source AND slot.i = (before // {block_chars}) % weight, h
"""
