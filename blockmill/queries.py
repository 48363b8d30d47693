"""Queries over the engine's operators, and DuckDB SQL that says what each should return."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expressions import expression
from .functions.registry import Registry
from .operators import blocks, cube, dictionary, joins, rows, window
from .operators.aggregates import Aggregate as A
from .operators.aggregates import group
from .plans.summary import SummaryView
from .sources.storage import storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return storage("PARQUET").read(spark, [f"{sf_dir}/{name}.parquet"], {})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def gen(df: DataFrame, *items: str) -> DataFrame:
    """`expression AS name` items, in the script language."""
    pairs = [i.rsplit(" AS ", 1) if " AS " in i else (i, i) for i in items]
    return rows.generate(df, *((n, expression(e, df)) for e, n in pairs))


def where(df: DataFrame, text: str) -> DataFrame:
    return rows.keep(df, expression(text, df))


CENTS = "CAST(round({0} * 100) AS BIGINT)"


def cents(df: DataFrame, column: str, name: str) -> DataFrame:
    """Whole cents, whose sums don't depend on the order of the rows."""
    return df.withColumn(name, F.round(F.col(column) * 100).cast("long"))


# --- generate and functions -----------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS added, l_orderkey * 2 - l_partkey AS less, l_orderkey // l_linenumber AS whole,
 l_extendedprice * (1 - l_discount) AS price, l_orderkey % 7 AS rest, l_extendedprice / l_quantity AS each FROM lineitem""")
def generate_arith(spark, d):
    return gen(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_orderkey + l_linenumber AS added", "l_orderkey * 2 - l_partkey AS less", "l_orderkey / l_linenumber AS whole", "l_extendedprice * (1 - l_discount) AS price", "MOD(l_orderkey, 7) AS rest", "l_extendedprice / l_quantity AS each")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' END AS size,
 CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS BIGINT) WHEN o_orderstatus = 'O' THEN o_custkey END AS mixed FROM orders""")
def generate_case(spark, d):
    return gen(table(spark, d, "orders"), "o_orderkey", "CASE(o_totalprice > 200000, 'large', o_totalprice > 100000, 'medium') AS size", "CASE(o_orderstatus == 'F', 1, o_orderstatus == 'O', o_custkey) AS mixed")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_mktsegment IS NULL THEN 'none' ELSE c_mktsegment END AS segment,
 concat(c_name, '-', c_custkey, CASE WHEN c_nationkey > 12 THEN CAST(c_nationkey AS VARCHAR) END) AS label FROM customer""")
def generate_nvl_concat(spark, d):
    df = gen(table(spark, d, "customer"), "c_custkey", "c_name", "c_nationkey", "CASE(c_mktsegment != 'BUILDING', c_mktsegment) AS seg")
    return gen(df, "c_custkey", "NVL(seg, 'none') AS segment", "CONCAT(c_name, '-', c_custkey, CASE(c_nationkey > 12, c_nationkey)) AS label")


@query("""SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS whole, CAST(trunc(c_acctbal) AS BIGINT) AS long, CAST(c_nationkey AS VARCHAR) AS text, CAST(c_nationkey AS DOUBLE) AS real,
 CAST(substr(c_name, 10) AS BIGINT) AS parsed, CASE WHEN c_nationkey > 10 THEN 1 ELSE 0 END AS flag FROM customer""")
def generate_casts(spark, d):
    df = table(spark, d, "customer").withColumn("tail", F.substring("c_name", 10, 20))
    return gen(df, "c_custkey", "CASTTOINT(c_acctbal) AS whole", "CASTTOLONG(c_acctbal) AS long", "CASTTOSTRING(c_nationkey) AS text", "CASTTODOUBLE(c_nationkey) AS real", "CASTTOLONG(tail) AS parsed", "CASTTOINT(c_nationkey > 10) AS flag")


@query("""SELECT l_orderkey, l_linenumber, l_orderkey << 3 AS up, CASE WHEN l_partkey % 2 = 0 THEN l_partkey >> 2 ELSE 4611686018427387904 - ((l_partkey + 3) // 4) END AS down FROM lineitem""")
def generate_bits(spark, d):
    df = gen(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "CASE(MOD(l_partkey, 2) == 0, l_partkey, MOD(l_partkey, 2) != 0, 0L - l_partkey) AS signed")
    return gen(df, "l_orderkey", "l_linenumber", "LSHIFT(l_orderkey, 3) AS up", "RSHIFT(signed, 2) AS down")


@query("""SELECT o_orderkey, CAST(((o_orderkey * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS wrapped FROM orders""")
def generate_wraparound(spark, d):
    df = gen(table(spark, d, "orders"), "o_orderkey", "CASTTOINT(o_orderkey) AS k")
    return gen(df, "o_orderkey", "k * 1000003 AS wrapped")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type AS kind, CAST(2 AS BIGINT) AS n FROM events""")
def map_projection(spark, d):
    df = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>")).withColumn("bag", F.array(F.struct("event_type"), F.struct("event_type")))
    return gen(df, "event_id", "m#'k' AS k", "$3 AS kind", "SIZEOF(bag) AS n")


@query("SELECT n_nationkey, n_name AS name, n_regionkey + 1 AS next FROM nation")
def nested_projection(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", F.struct("n_name", F.struct("n_regionkey").alias("region")).alias("n"))
    return gen(df, "n_nationkey", "n.n_name AS name", "n.region.n_regionkey + 1 AS next")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE coalesce(nullif(o_custkey % 3, 0) = 1, false) OR (NOT coalesce(o_orderstatus = 'F', false) AND o_totalprice > 150000)""")
def filter_bool3(spark, d):
    df = gen(table(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "CASE(MOD(o_custkey, 3) != 0, MOD(o_custkey, 3)) AS third")
    return gen(where(df, "third == 1 OR ((NOT o_orderstatus == 'F') AND o_totalprice > 150000)"), "o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, NOT coalesce(nullif(o_custkey % 3, 0) = 1, false) AND true AS unlike, coalesce(nullif(o_custkey % 3, 0) = 1, false) AND o_totalprice > 100000 AS both_hold, nullif(o_custkey % 3, 0) = 1 AS plain FROM orders""")
def generate_booleans(spark, d):
    df = gen(table(spark, d, "orders"), "o_orderkey", "o_totalprice", "CASE(MOD(o_custkey, 3) != 0, MOD(o_custkey, 3)) AS third")
    return gen(df, "o_orderkey", "NOT (third == 1 OR false) AND true AS unlike", "third == 1 AND o_totalprice > 100000 AS both_hold", "third == 1 AS plain")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 5 IN (1, 2)")
def filter_in(spark, d):
    return gen(where(table(spark, d, "orders"), "o_orderpriority IN ('1-URGENT', '2-HIGH') AND MOD(o_orderkey, 5) IN (1, 2)"), "o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '.*[aeiou].[0-9]*') AND p_type IS NOT NULL")
def filter_matches(spark, d):
    return gen(where(table(spark, d, "part"), "p_name MATCHES '.*[aeiou].[0-9]*' AND p_type IS NOT NULL"), "p_partkey", "p_name")


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def is_distinct(spark, d):
    df = table(spark, d, "orders")
    return group(rows.keep(gen(df, "ISDISTINCT(o_custkey) AS first"), F.col("first")), [], [A("COUNT", (), "n")])


# --- group ----------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_orderkey) AS BIGINT) AS keys, min(l_quantity) AS least, max(l_extendedprice) AS most, count(l_tax) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
 FROM lineitem WHERE l_quantity < 45 GROUP BY ALL""")
def group_sum_min_max_count(spark, d):
    df = cents(where(table(spark, d, "lineitem"), "l_quantity < 45"), "l_extendedprice", "c")
    return group(df, ["l_returnflag", "l_linestatus"], [A("SUM", ("l_orderkey",), "keys"), A("MIN", ("l_quantity",), "least"), A("MAX", ("l_extendedprice",), "most"), A("COUNT", ("l_tax",), "n"), A("SUM", ("c",), "cents")])


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS s, count(*) AS n, max(o_totalprice) AS m FROM orders")
def group_all(spark, d):
    return group(table(spark, d, "orders"), [], [A("SUM", ("o_custkey",), "s"), A("COUNT", (), "n"), A("MAX", ("o_totalprice",), "m")])


@query("SELECT * FROM (SELECT CAST(sum(o_custkey) AS BIGINT) AS s, count(*) AS n FROM orders WHERE o_orderkey < 0) WHERE n > 0")
def group_all_empty(spark, d):
    return group(where(table(spark, d, "orders"), "o_orderkey < 0"), [], [A("SUM", ("o_custkey",), "s"), A("COUNT", (), "n")])


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def group_count_distinct(spark, d):
    return group(table(spark, d, "orders"), ["o_orderpriority"], [A("COUNT_DISTINCT", ("o_custkey",), "customers")])


@query("SELECT l_orderkey, bit_or(l_linenumber) AS bits, bit_or(l_suppkey) AS long_bits FROM lineitem GROUP BY ALL")
def group_bitwise_or(spark, d):
    return group(table(spark, d, "lineitem"), ["l_orderkey"], [A("BITWISE_OR", ("l_linenumber",), "bits"), A("BITWISE_OR", ("l_suppkey",), "long_bits")])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def group_dedup(spark, d):
    return group(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders, count(*) AS n FROM orders GROUP BY ALL")
def group_bag(spark, d):
    df = group(table(spark, d, "orders"), ["o_custkey"], [A("BAG", ("o_orderkey",), "bag")])
    return df.select("o_custkey", F.array_join(F.transform(F.array_sort("bag"), lambda x: x["value"].cast("string")), ",").alias("orders"), F.size("bag").cast("long").alias("n"))


@query("SELECT k, CAST(sum(v) AS BIGINT) AS s, min(v) AS lo, max(v) AS hi, count(v) AS n FROM (SELECT nullif(o_custkey % 7, 0) AS k, nullif(o_orderkey % 5, 0) AS v FROM orders) GROUP BY k")
def group_nulls(spark, d):
    df = gen(table(spark, d, "orders"), "CASE(MOD(o_custkey, 7) != 0, MOD(o_custkey, 7)) AS k", "CASE(MOD(o_orderkey, 5) != 0, MOD(o_orderkey, 5)) AS v")
    return group(df, ["k"], [A("SUM", ("v",), "s"), A("MIN", ("v",), "lo"), A("MAX", ("v",), "hi"), A("COUNT", ("v",), "n")])


@query("""SELECT user_id, CAST(coalesce(bit_or(CASE WHEN d BETWEEN 0 AND 31 THEN CAST(1 AS BIGINT) << d END), 0) AS INTEGER) AS days
 FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events) GROUP BY ALL""")
def presence_bitmap(spark, d):
    df = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyyMMdd").cast("int"))
    return group(df, ["user_id"], [A("PRESENCE_BITMAP", ("day",), "days", args=("2024-01-01",))])


@query("SELECT l_returnflag, CAST(sum(CAST(round(l_quantity * l_quantity) AS BIGINT)) AS BIGINT) AS squares FROM lineitem GROUP BY ALL")
def group_user_aggregate(spark, d):
    return group(table(spark, d, "lineitem"), ["l_returnflag"], [A("USER", ("l_quantity",), "squares", user=lambda x: F.sum(F.round(x * x).cast("long")))])


# --- joins ----------------------------------------------------------------------------------------------------------


def _orders_customers(spark, d):
    """All orders and all customers, the latter by twice their number, so that either side has keys that the other lacks."""
    return gen(table(spark, d, "orders"), "o_orderkey", "o_custkey"), gen(table(spark, d, "customer"), "c_custkey * 2 AS c_custkey", "c_name")


_JOIN = """SELECT o.o_orderkey AS o___o_orderkey, o.o_custkey AS o___o_custkey, c.c_custkey AS c___c_custkey, c.c_name AS c___c_name
 FROM orders o {} JOIN (SELECT c_custkey * 2 AS c_custkey, c_name FROM customer) c ON o.o_custkey = c.c_custkey"""


def _join(name: str, f, kind: str, sql: str) -> None:
    def run(spark, d):
        o, c = _orders_customers(spark, d)
        return f(o, "o", ["o_custkey"], c, "c", ["c_custkey"], kind)

    run.__name__ = name
    query(_JOIN.format(sql))(run)


for _f, _n in ((joins.hash_join, "hash_join"), (joins.merge_join, "merge_join")):
    for _kind, _sql in (("", "INNER"), ("LEFT OUTER", "LEFT"), ("RIGHT OUTER", "RIGHT"), ("FULL OUTER", "FULL")):
        _join(f"{_n}_{_sql.lower()}", _f, _kind, _sql)


@query("SELECT a.n_name AS a___n_name, a.k AS a___k, b.k AS b___k, b.r_name AS b___r_name FROM (SELECT n_name, nullif(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT r_name, nullif(r_regionkey, 0) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys(spark, d):
    a = gen(table(spark, d, "nation"), "n_name", "CASE(n_regionkey != 0, n_regionkey) AS k")
    b = gen(table(spark, d, "region"), "CASE(r_regionkey != 0, r_regionkey) AS k", "r_name")
    return joins.merge_join(a, "a", ["k"], b, "b", ["k"])


@query("SELECT a.l_orderkey AS a___l_orderkey, a.l_linenumber AS a___l_linenumber, b.l_partkey AS b___l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_two_keys(spark, d):
    df = table(spark, d, "lineitem")
    out = joins.merge_join(df.select("l_orderkey", "l_linenumber"), "a", ["l_orderkey", "l_linenumber"], df.select("l_orderkey", "l_linenumber", "l_partkey"), "b", ["l_orderkey", "l_linenumber"])
    return out.select("a___l_orderkey", "a___l_linenumber", "b___l_partkey")


@query("SELECT o_custkey AS k, o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey * 2")
def reduce_join_inner(spark, d):
    c = gen(table(spark, d, "customer"), "c_custkey * 2 AS k", "c_name", "c_mktsegment")
    return joins.reduce_join(gen(table(spark, d, "orders"), "o_orderkey", "o_custkey AS k"), c, ["k"])


@query("SELECT o_custkey AS k, o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey * 2")
def reduce_join_left(spark, d):
    c = gen(table(spark, d, "customer"), "c_custkey * 2 AS k", "c_name")
    return joins.reduce_join(gen(table(spark, d, "orders"), "o_orderkey", "o_custkey AS k"), c, ["k"], "LEFT OUTER")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000)")
def purge(spark, d):
    return gen(rows.purge(table(spark, d, "nation"), "n_nationkey", gen(where(table(spark, d, "supplier"), "s_acctbal < 1000"), "s_nationkey")), "n_name", "n_regionkey")


# --- unions ---------------------------------------------------------------------------------------------------------


@query("SELECT s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer")
def combine_union(spark, d):
    return rows.combine([gen(table(spark, d, "supplier"), "s_name AS name", "s_nationkey AS nation"), gen(table(spark, d, "customer"), "c_name AS name", "c_nationkey AS nation")], ["nation", "name"])


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier")
def multimapper_widen(spark, d):
    return rows.union([gen(table(spark, d, "nation"), "n_nationkey AS k", "n_name AS name"), gen(table(spark, d, "supplier"), "s_name AS name", "s_suppkey AS k")])


@query("SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT n_nationkey, CAST(length(n_name) AS BIGINT) FROM nation WHERE n_nationkey > 20")
def gather_multipass(spark, d):
    n = table(spark, d, "nation")
    one = gen(group(n, ["n_regionkey"], [A("COUNT", (), "n")]), "n_regionkey AS k", "n")
    two = where(n, "n_nationkey > 20").select(F.col("n_nationkey").alias("k"), F.length("n_name").cast("long").alias("n"))
    return rows.gather([one, two])


# --- cubes ----------------------------------------------------------------------------------------------------------

_CUBED = "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS s, count(l_tax) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY "
_CUBE = [A("SUM", ("l_linenumber",), "s"), A("COUNT", ("l_tax",), "n"), A("MIN", ("l_quantity",), "lo"), A("MAX", ("l_quantity",), "hi")]
_DIMS = ["l_returnflag", "l_linestatus"]


@query(_CUBED + "CUBE (l_returnflag, l_linestatus)")
def cube_full(spark, d):
    return cube.cube(table(spark, d, "lineitem"), _DIMS, _CUBE)


@query(_CUBED + "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def cube_sets(spark, d):
    return cube.cube(table(spark, d, "lineitem"), _DIMS, _CUBE, [("l_returnflag", "l_linestatus"), ("l_returnflag",)])


@query(_CUBED + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def cube_combos(spark, d):
    return cube.cube(table(spark, d, "lineitem"), _DIMS, _CUBE, cube.combos(_DIMS, 1))


@query("SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority), ROLLUP (year(o_orderdate))")
def cube_rollups(spark, d):
    df = table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return cube.cube(df, ["o_orderstatus", "o_orderpriority", "y"], [A("COUNT", (), "n")], cube.rollups([("o_orderstatus", "o_orderpriority"), ("y",)]))


@query("SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_count_distinct(spark, d):
    return cube.cube(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [A("COUNT_DISTINCT", ("o_custkey",), "customers")], inner=["o_custkey"])


@query("""WITH i AS (SELECT o_orderstatus, o_orderpriority, o_custkey, grouping_id(o_orderstatus, o_orderpriority) AS g, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS m, count(*) AS c
 FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority, o_custkey), (o_orderstatus, o_custkey), (o_orderpriority, o_custkey), (o_custkey)))
 SELECT o_orderstatus, o_orderpriority, CAST(sum(m) AS BIGINT) AS sum_of_most, max(c) AS most_orders, count(*) AS customers FROM i GROUP BY o_orderstatus, o_orderpriority, g""")
def cube_dual_sum_max(spark, d):
    df = cents(table(spark, d, "orders"), "o_totalprice", "cents")
    return cube.cube(df, ["o_orderstatus", "o_orderpriority"], [A("[SUM,MAX]", ("cents",), "sum_of_most"), A("[MAX,COUNT]", ("o_orderkey",), "most_orders"), A("COUNT_DISTINCT", ("o_custkey",), "customers")], inner=["o_custkey"])


@query("SELECT l_returnflag, l_linestatus, median(l_quantity) AS med, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_median(spark, d):
    return cube.cube(table(spark, d, "lineitem"), _DIMS, [A("MEDIAN", ("l_quantity",), "med"), A("PERCENTILE", ("l_quantity",), "p90", args=(0.9,))])


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber * l_linenumber) AS BIGINT) AS squares FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_user_aggregate(spark, d):
    return cube.cube(table(spark, d, "lineitem"), _DIMS, [A("USER", ("l_linenumber",), "squares", user=lambda x: F.sum((x * x).cast("long")))])


class Spread:
    """The greatest value less the least, of a cell's values as they come."""

    output_type = "double"

    def buffer(self) -> list[float]:
        return []  # the least and the greatest, once there is a value

    def take(self, buffer: list[float], v: pd.Series) -> None:
        if v.notna().any():
            self.merge(buffer, [float(v.min()), float(v.max())])

    def merge(self, into: list[float], other: list[float]) -> None:
        if both := into + other:
            into[:] = [min(both), max(both)]

    def output(self, buffer: list[float]) -> float | None:
        return buffer[1] - buffer[0] if buffer else None


@query("SELECT l_returnflag, l_linestatus, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_pandas_aggregate(spark, d):
    return cube.cube(table(spark, d, "lineitem"), _DIMS, [A("USER", ("l_quantity",), "spread", user=Spread)])


# --- users' functions and operators ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice * 2 + 1 AS doubled, strlen(o_orderpriority) AS letters FROM orders")
def user_function(spark, d):
    r = Registry()
    r.function("twice", lambda x: x * 2)
    r.function("letters", F.pandas_udf(lambda s: s.str.len(), "bigint"))
    df = table(spark, d, "orders")
    return rows.generate(df, ("o_orderkey", F.col("o_orderkey")), ("doubled", expression("twice(o_totalprice) + 1", df, r)), ("letters", expression("letters(o_orderpriority)", df, r)))


# --- rank, top, rows ------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def rank_grouped(spark, d):
    return window.rank(table(spark, d, "orders"), "place", ["o_custkey"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey", "place")


@query("SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def rank_global(spark, d):
    return window.rank(table(spark, d, "orders"), "place", [], ["o_totalprice", "o_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def top1(spark, d):
    return window.top(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 3")
def topn(spark, d):
    return window.top(table(spark, d, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_name, CAST(c AS INTEGER) AS c FROM nation, range(3) t(c)")
def duplicate(spark, d):
    return gen(rows.duplicate(table(spark, d, "nation"), 3, "c"), "n_name", "c")


@query("SELECT l_orderkey AS orderkey, l_partkey AS part, l_quantity AS quantity FROM lineitem")
def flatten_bag(spark, d):
    bags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("items"))
    df = rows.flatten(bags, [("items", "BAG_TUPLE", [("part", T.LongType()), ("quantity", T.DoubleType())])])
    return gen(df, "l_orderkey AS orderkey", "part", "quantity")


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation, CAST(NULL AS VARCHAR) AS empty FROM customer")
def flatten_tuple(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.struct("c_name", "c_nationkey").alias("t"), F.array().cast("array<string>").alias("empty"))
    return rows.flatten(df, [("t", "TUPLE", [("name", T.StringType()), ("nation", T.IntegerType())]), ("empty", "BAG", [("empty", T.StringType())])])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, d):
    return rows.distinct(gen(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def sort_limit(spark, d):
    return rows.limit(rows.sort(gen(table(spark, d, "orders"), "o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], whole=True), 100)


@query("SELECT *, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 1000 AS part FROM documents")
def pivot_by_row(spark, d):
    return rows.pivot_by_row(table(spark, d, "documents"), 1000, ["n_chars", "doc_id"], "part")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def force_sorted_order(spark, d):
    return rows.force_sorted_order(rows.sort(gen(table(spark, d, "orders"), "o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]), ["o_totalprice", "o_orderkey"])


@query("SELECT o_custkey, min(o_orderkey) AS orderkey, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL")
def least_entry(spark, d):
    bags = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_totalprice", "o_orderkey")).alias("bag"))
    return gen(rows.least_entry(bags, "bag", 1, "e"), "o_custkey", "e.o_orderkey AS orderkey", "e.o_totalprice AS price")


@query("SELECT n_regionkey AS meta___id, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (SELECT n_regionkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) = count(s_suppkey))")
def collate_vectors(spark, d):
    return gen(rows.collate_vectors(table(spark, d, "nation"), table(spark, d, "supplier"), "n_regionkey", "n_nationkey", "s_nationkey"), "meta___id", "s_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS aside FROM lineitem")
def tee_split(spark, d):
    aside: list[DataFrame] = []
    df = gen(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")
    left = rows.tee(df, aside.append, None, expression("l_returnflag == 'R'", df), split=True)
    keep = lambda x, v: x.select("l_orderkey", "l_linenumber", F.lit(v).alias("aside"))
    return rows.gather([keep(left, False), keep(aside[0], True)])


# --- dictionaries ---------------------------------------------------------------------------------------------------

_WORDS = ["o_orderpriority", "o_orderstatus"]


@query("""SELECT 'o_orderpriority' AS colname, o_orderpriority AS colvalue, CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)
 UNION ALL SELECT 'o_orderstatus', o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderstatus) AS INTEGER) FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def dict_build(spark, d):
    return dictionary.build(table(spark, d, "orders"), _WORDS)


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderstatus) AS INTEGER) AS o_orderstatus FROM orders")
def dict_encode(spark, d):
    df = gen(table(spark, d, "orders"), "o_orderkey", *_WORDS)
    return dictionary.encode(df, _WORDS, dictionary.build(df, _WORDS))


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE '?' END AS o_orderstatus FROM orders")
def dict_decode(spark, d):
    df = gen(table(spark, d, "orders"), "o_orderkey", *_WORDS)
    words = dictionary.build(df, _WORDS)
    coded = dictionary.encode(df, _WORDS, words)
    return dictionary.decode(coded, _WORDS, words.where("colname = 'o_orderpriority' OR colvalue = 'F'"), "?")


@query("""WITH o AS (SELECT o_orderpriority AS v, min(o_orderkey) < 40 AS old FROM orders GROUP BY 1), n AS (SELECT count(*) AS n FROM o WHERE old)
 SELECT v AS colvalue, CAST(CASE WHEN old THEN row_number() OVER (PARTITION BY old ORDER BY v) ELSE n + row_number() OVER (PARTITION BY old ORDER BY v) END AS INTEGER) AS code FROM o, n""")
def dict_refresh(spark, d):
    df = table(spark, d, "orders")
    old = dictionary.build(where(df, "o_orderkey < 40"), ["o_orderpriority"])
    return gen(dictionary.refresh(df, ["o_orderpriority"], old), "colvalue", "code")


# --- blocks ---------------------------------------------------------------------------------------------------------

_ORDERS = "SELECT o_orderkey, o_custkey FROM orders"


def _blocks(spark, d, kind: str, n: int) -> DataFrame:
    """What blocks hold: all rows and keys, each key in one block, blocks of n or more (but the last of a bucket) that end with the key that fills them, in order."""
    df = blocks.blockgen(gen(table(spark, d, "orders"), "o_orderkey", "o_custkey"), kind, n, ["o_custkey"], ["o_custkey", "o_orderkey"])
    cost = {"ROW": F.count("*"), "SIZE": F.count("*") * 16, "PARTITION_KEY": F.lit(1)}[kind]
    keys = df.groupBy(blocks.BLOCK, "o_custkey").agg(F.count("*").alias("rows"), cost.alias("cost"))
    each = keys.groupBy(blocks.BLOCK).agg(F.sum("rows").alias("rows"), F.count("*").alias("keys"), F.sum("cost").alias("cost"), F.max_by("cost", "o_custkey").alias("last"), F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))
    by = Window.partitionBy(F.shiftright(blocks.BLOCK, 32)).orderBy(blocks.BLOCK)
    each = each.withColumns({"next": F.lead("lo").over(by), "less": F.col("cost") - F.col("last")})
    count = lambda c: F.count(F.when(F.expr(c), 1))
    return each.agg(F.sum("rows").alias("n"), F.sum("keys").alias("customers"), count(f"cost < {n} AND next IS NOT NULL").alias("too_small"), count(f"less >= {n}").alias("too_large"), count("next <= hi").alias("out_of_order"), (F.count("*") > 1).alias("several"))


_BLOCKS = "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(0 AS BIGINT) AS too_small, CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS out_of_order, true AS several FROM orders"


@query(_BLOCKS)
def blockgen_by_row(spark, d):
    return _blocks(spark, d, "ROW", 100)


@query(_BLOCKS)
def blockgen_by_key(spark, d):
    return _blocks(spark, d, "PARTITION_KEY", 20)


@query(_BLOCKS)
def blockgen_by_size(spark, d):
    return _blocks(spark, d, "SIZE", 4096)


@query("SELECT o_orderkey AS f___o_orderkey, c_custkey AS d___c_custkey, c_name AS d___c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def blockgen_by_index_join(spark, d):
    orders = gen(table(spark, d, "orders"), "o_orderkey", "o_custkey")
    n = blocks.buckets_for(orders)
    fact = blocks.blockgen(orders, "ROW", 100, ["o_custkey"], buckets=n)
    dim = blocks.blockgen_by_index(gen(table(spark, d, "customer"), "c_custkey", "c_name"), blocks.boundaries(fact, ["o_custkey"]), ["c_custkey"], buckets=n)
    return blocks.matched_join(fact, "f", ["o_custkey"], dim, "d", ["c_custkey"]).select("f___o_orderkey", "d___c_custkey", "d___c_name")


@query("SELECT * FROM (VALUES ('bucket', 0), ('key in two blocks', 0), ('key ranges overlap', 0), ('order', 0), ('block too small', 0)) t(\"check\", violations)")
def validate_blocks(spark, d):
    orders = gen(table(spark, d, "orders"), "o_orderkey", "o_custkey")
    n = blocks.buckets_for(orders)
    df = blocks.blockgen(orders, "ROW", 100, ["o_custkey"], ["o_custkey", "o_orderkey"], n)
    return blocks.validate(df, ["o_custkey"], ["o_custkey", "o_orderkey"], n, kind="ROW", n=100).select("check", F.col("violations").cast("int").alias("violations"))


# --- summary views --------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-30' GROUP BY ALL")
def summary_view_incremental(spark, d):
    facts = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    view = SummaryView.create(facts, ["event_type"], "user_id", "day", date(2024, 1, 1), date(2024, 1, 20))
    return view.refresh(facts, date(2024, 1, 4), date(2024, 1, 30)).counts(name="users")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY CUBE (event_type)")
def summary_view_days(spark, d):
    facts = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return SummaryView.create(facts, ["event_type"], "user_id", "day", date(2024, 1, 1), date(2024, 1, 30)).counts(date(2024, 1, 5), date(2024, 1, 11), cube=True, name="users")


# --- scripts --------------------------------------------------------------------------------------------------------


@query("""SELECT c_mktsegment AS segment, count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def script_program(spark, d):
    from .plans.compiler import Compiler
    from .plans.parser import parse

    text = f"""
        PROGRAM "orders by segment";
        JOB "join and count"
          REDUCERS 8;
          MAP {{
            o = LOAD "{d}/orders.parquet" USING PARQUET();
            f = FILTER o BY o_orderstatus != 'P';
            r = FROM f GENERATE o_custkey AS k, 1L AS one;
          }}
          MAP {{
            c = LOAD "{d}/customer.parquet" USING PARQUET();
            r = FROM c GENERATE c_custkey AS k, c_mktsegment AS segment;
          }}
          JOIN r ON k;
          REDUCE {{ g = GROUP r BY segment AGGREGATES SUM(one) AS orders, SUM(k) AS keys; }}
          STORE g INTO "unused" USING PARQUET();
        END"""
    program = parse(text)
    compiler = Compiler(spark)
    compiler.prepare(program)
    return compiler.compile_job(program.jobs[0]).df


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def script_cube(spark, d):
    from .plans.compiler import Compiler
    from .plans.parser import parse

    text = f"""
        JOB "cube"
          MAP {{ e = LOAD "{d}/events.parquet" USING PARQUET(); x = FROM e GENERATE event_type, user_id; }}
          CUBE x BY event_type, user_id AGGREGATES COUNT(event_type) AS n GROUPING COMBOS 1;
          STORE x INTO "unused" USING PARQUET();
        END"""
    return Compiler(spark).compile_job(parse(text).jobs[0]).df


from . import script_queries  # noqa: E402, F401  (adds its own)
