"""Queries that are scripts: run to their STORE below the shared folder, and read back."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.registry import Registry
from .operators.aggregates import Aggregate as A
from .operators.aggregates import group
from .operators.blocks import write_text
from .operators.cube import cube
from .plans import hooks
from .plans.compiler import Compiler, describe, run_script
from .plans.parser import parse
from .queries import query, table
from .scratch import Scratch
from .sources import paths
from .sources.storage import storage


def stored(spark: SparkSession, d: str, text: str, registry: Registry | None = None, at: str = "out", fmt: str = "PARQUET", params: dict[str, str] | None = None, prepare=None, **values: Any) -> DataFrame:
    """What the script stores at $OUT/at. $D is the tables' folder; prepare(root) runs first."""
    root = Scratch(spark, "script").root
    if prepare is not None:
        prepare(root)
    run_script(spark, text, {"D": d, "OUT": root, **values}, registry)
    return storage(fmt).read(spark, [f"{root}/{at}"], params or {})


# --- sources and sinks ----------------------------------------------------------------------------------------------

_COPY = """
    PROGRAM "copies"; SET overwrite true;
    JOB "back" MAP {{ t = LOAD "$OUT/copy" USING {0}({1}); s = FROM t GENERATE n_nationkey, n_name, n_regionkey; }} STORE s INTO "$OUT/out" USING PARQUET(); END
    JOB "out" MAP {{ n = LOAD "$D/nation.parquet" USING PARQUET(); s = FROM n GENERATE n_nationkey, n_name, n_regionkey; }} STORE s INTO "$OUT/copy" USING {0}({2}); END"""
_NATIONS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(_NATIONS)
def store_text(spark, d):
    return stored(spark, d, _COPY.format("TEXT", '"schema": "INT n_nationkey, STRING n_name, INT n_regionkey", "separator": "[|]"', '"separator": "|"'))


@query(_NATIONS)
def store_orc(spark, d):
    return stored(spark, d, _COPY.format("ORC", "", ""))


@query(_NATIONS)
def store_json(spark, d):
    return stored(spark, d, _COPY.format("JSON", '"schema": "INT n_nationkey, STRING n_name, INT n_regionkey"', ""))


@query("SELECT CAST(k AS BIGINT) AS id, k * 3 AS three FROM range(6) t(k)")
def load_virtual(spark, d):
    return stored(spark, d, """JOB "v" MAP { v = LOAD "none" USING VIRTUAL("mappers": "6"); o = FROM v GENERATE dummy AS id, dummy * 3 AS three; } STORE o INTO "$OUT/out" USING PARQUET(); END""")


def _versions(spark: SparkSession, d: str):
    def prepare(root: str) -> None:
        r = table(spark, d, "region").select("r_regionkey", "r_name")
        for k, name in enumerate(("v1", "v2", "w7")):
            r.withColumn("version", F.lit(k)).write.parquet(f"{root}/in/{name}/data")

    return prepare


@query("SELECT r_regionkey, r_name, 1 AS version FROM region")
def load_latest(spark, d):
    return stored(spark, d, """JOB "l" MAP { r = LOAD "$OUT/in/v#LATEST/data" USING PARQUET(); } STORE r INTO "$OUT/out" USING PARQUET(); END""", prepare=_versions(spark, d))


@query("SELECT r_regionkey, r_name, CAST(k AS INTEGER) AS version FROM region, range(2) t(k)")
def load_glob(spark, d):
    return stored(spark, d, """JOB "l" MAP { r = LOAD "$OUT/in/v*/data" USING PARQUET(); } STORE r INTO "$OUT/out" USING PARQUET(); END""", prepare=_versions(spark, d))


@query("SELECT r_name, k AS day FROM region, (SELECT unnest([2, 4]) AS k) UNION ALL SELECT r_name, 3 FROM region WHERE r_regionkey > 2")
def load_dated(spark, d):
    def prepare(root: str) -> None:
        r = table(spark, d, "region").select("r_regionkey", "r_name")
        for k in (1, 2, 4, 5):
            r.select("r_name", F.lit(k).alias("day")).write.parquet(f"{root}/in/daily/2024/01/0{k}")
        r.where("r_regionkey > 2").select("r_name", F.lit(3).alias("day")).write.parquet(f"{root}/in/hourly/2024/01/03/07")

    return stored(spark, d, """JOB "l" MAP { r = LOAD ("$OUT/in", 20240102, 20240104) USING PARQUET("useHourlyForMissingDaily": "true"); } STORE r INTO "$OUT/out" USING PARQUET(); END""", prepare=prepare)


@query("SELECT o_orderkey AS k, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey * 2")
def load_cached(spark, d):
    return stored(spark, d, """
        JOB "c" MAP { c = LOAD "$D/customer.parquet" USING PARQUET(); s = FROM c GENERATE c_custkey * 2 AS k, c_name; } STORE s INTO "$OUT/c" USING PARQUET(); END
        JOB "j" MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); c = LOAD-CACHED "$OUT/c" USING PARQUET(); j = HASH-JOIN LEFT OUTER o BY o_custkey, c BY k; s = FROM j GENERATE o___o_orderkey AS k, c___c_name AS name; }
        STORE s INTO "$OUT/out" USING PARQUET(); END""")


_STORE_BLOCKS = """
    JOB "fact" REDUCERS 5; MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); s = FROM o GENERATE o_orderkey, o_custkey; } BLOCKGEN s BY ROW 200 PARTITIONED ON o_custkey SORTED ON o_custkey, o_orderkey; STORE s INTO "$OUT/f" USING BLOCKS(); END"""


@query("SELECT o_orderkey, o_custkey FROM orders")
def store_blocks(spark, d):
    return stored(spark, d, _STORE_BLOCKS + """
    JOB "back" MAP { f = LOAD "$OUT/f" USING BLOCKS(); v = VALIDATE f BY ROW 200 PARTITIONED ON o_custkey SORTED ON o_custkey, o_orderkey; s = FROM v GENERATE o_orderkey, o_custkey; } STORE s INTO "$OUT/out" USING PARQUET(); END""")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey < 500")
def load_block_matching(spark, d):
    return stored(spark, d, _STORE_BLOCKS + """
    JOB "dim" MAP { c = LOAD "$D/customer.parquet" USING PARQUET(); s = FROM c GENERATE c_custkey, c_name; } BLOCKGEN s BY INDEX "$OUT/f" PARTITIONED ON c_custkey; STORE s INTO "$OUT/d" USING BLOCKS(); END
    JOB "join" MAP { f = LOAD "$OUT/f" USING BLOCKS(); s = FILTER f BY o_custkey < 500; d = LOAD BLOCK IN MEMORY FROM "$OUT/d" MATCHING s; j = JOIN s BY o_custkey, d BY c_custkey; g = FROM j GENERATE s___o_orderkey AS o_orderkey, d___c_name AS c_name; }
    STORE g INTO "$OUT/out" USING PARQUET(); END""")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def tee_in_script(spark, d):
    return stored(spark, d, """
        JOB "read" MAP { t = LOAD "$OUT/aside" USING TEXT("schema": "LONG o_orderkey, STRING o_orderstatus"); } STORE t INTO "$OUT/out" USING PARQUET(); END
        JOB "tee" MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); t = TEE o INTO "$OUT/aside" USING TEXT() GENERATE o_orderkey, o_orderstatus IF o_orderstatus == 'F'; c = GROUP t BY o_orderstatus AGGREGATES COUNT() AS n; }
        STORE c INTO "$OUT/counts" USING PARQUET(); END""")


@query("SELECT o_orderstatus, count(*) AS n, 'moved' AS place FROM orders GROUP BY ALL")
def completion_tasks(spark, d):
    df = stored(spark, d, """
        JOB "c" MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); c = GROUP o BY o_orderstatus AGGREGATES COUNT() AS n; } STORE c INTO "$OUT/first" USING PARQUET(); END
        onCompletion { MKDIR "$OUT/made"; MV "$OUT/first" "$OUT/made/moved"; RM "$OUT/none"; }""", at="made/moved")
    return df.withColumn("place", F.lit("moved"))


@query("SELECT 'counts' AS name, CAST(count(*) AS VARCHAR) AS value FROM region UNION ALL SELECT 'state', 'done'")
def metafile_hooks(spark, d):
    n = table(spark, d, "region").count()
    root = Scratch(spark, "hooks").root
    job = parse(f'JOB "r" MAP {{ r = LOAD "{d}/region.parquet" USING PARQUET(); }} STORE r INTO "{root}/new" USING PARQUET(); END').jobs[0]
    job.before = [f"METAFILE WRITE {root}/facts state begun counts {n}"]
    job.after = [f"METAFILE UPDATE {root}/facts state done", f"HDFS RENAME {root}/new {root}/old", f"HDFS DELETE {root}/old"]
    Compiler(spark).run_job(job)
    assert not paths.exists(spark, f"{root}/old") and not paths.exists(spark, f"{root}/new")
    facts = hooks.run(spark, [f"METAFILE READ {root}/facts"])[0]
    return spark.createDataFrame(sorted(facts.items()), "name string, value string")


@query("SELECT count(*) AS files, true AS told FROM range(4)")
def list_files(spark, d):
    root = Scratch(spark, "files").root
    for k in range(4):
        write_text(spark, f"{root}/{k}/part.txt", "x" * (k + 1))
    return paths.listing(spark, root).agg(F.count("*").alias("files"), (F.sum("length") == 10).alias("told"))


# --- shuffles -------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS k, CAST(sum(o_orderkey) AS BIGINT) AS s, count(*) AS n FROM orders GROUP BY ALL")
def shuffle_combiner(spark, d):
    return stored(spark, d, """
        JOB "c" REDUCERS 3; MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); g = FROM o GENERATE o_custkey AS k, o_orderkey AS s, 1L AS n; }
          SHUFFLE g PARTITIONED ON k SORTED ON k AGGREGATES SUM(s) AS s, SUM(n) AS n;
          REDUCE { a = NO_OP g ASSERT PARTITIONED ON k SORTED ON k; r = GROUP a BY k AGGREGATES SUM(s) AS s, SUM(n) AS n; } STORE r INTO "$OUT/out" USING PARQUET(); END""")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def shuffle_distinct(spark, d):
    return stored(spark, d, """
        JOB "d" MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); g = FROM o GENERATE o_orderstatus, o_orderpriority; } DISTINCT g; STORE g INTO "$OUT/out" USING PARQUET(); END""")


@query("SELECT 'o_orderpriority' AS colname, o_orderpriority AS colvalue, CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def shuffle_dictionary(spark, d):
    job = """JOB "{0}" MAP {{ o = LOAD "$D/orders.parquet" USING PARQUET(); }} DICTIONARY o ON o_orderpriority; STORE o INTO "$OUT/out" USING PARQUET("overwrite": "true"); END"""
    root = Scratch(spark, "script").root
    for name in ("made", "kept"):  # the second run keeps all codes
        run_script(spark, job.format(name), {"D": d, "OUT": root})
    return storage("PARQUET").read(spark, [f"{root}/out"], {})


@query("SELECT n_nationkey, n_regionkey FROM nation")
def shuffle_user(spark, d):
    r = Registry()
    r.shuffle("spread", lambda df, p: df.repartition(int(p["parts"]), "n_regionkey"))
    return stored(spark, d, """JOB "u" MAP { n = LOAD "$D/nation.parquet" USING PARQUET(); s = FROM n GENERATE n_nationkey, n_regionkey; } spread s { "parts": "3" }; STORE s INTO "$OUT/out" USING PARQUET(); END""", r)


# --- statements -----------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS k, 'even' AS kind FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey + 1000, 'all' FROM nation")
def multipass(spark, d):
    return stored(spark, d, """
        JOB "m" MAP { n = LOAD "$D/nation.parquet" USING PARQUET(); p = PIVOT IN MEMORY n;
          MULTIPASS { x = FILTER p BY n_regionkey == 0; y = FROM x GENERATE n_nationkey AS k, 'even' AS kind; } { z = FROM p GENERATE n_nationkey + 1000 AS k, 'all' AS kind; }
          g = GATHER y, z; } STORE g INTO "$OUT/out" USING PARQUET(); END""")


@query("""SELECT o_orderkey, CAST(list_position(['F', 'O', 'P'], o_orderstatus) AS INTEGER) AS code, o_orderstatus AS back FROM orders""")
def dictionary_inline(spark, d):
    return stored(spark, d, """
        CREATE DICTIONARY status COLUMN o_orderstatus VALUES 'F', 'O', 'P';
        JOB "d" MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); e = ENCODE o ON o_orderstatus USING status; s = FROM e GENERATE o_orderkey, o_orderstatus AS code, o_orderstatus; b = DECODE s ON o_orderstatus USING status; g = FROM b GENERATE o_orderkey, code, o_orderstatus AS back; }
        STORE g INTO "$OUT/out" USING PARQUET(); END""")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place, o_orderstatus FROM orders")
def rank_in_script(spark, d):
    return stored(spark, d, """JOB "r" MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); s = SORT o ON o_orderkey; r = RANK s AS place; g = FROM r GENERATE o_orderkey, place, o_orderstatus; } STORE g INTO "$OUT/out" USING PARQUET(); END""")


@query("""SELECT n_nationkey, hex(encode('{"value":"' || n_name || '"}')) AS bytes, true AS apart, true AS counted FROM nation""")
def unique_numbers(spark, d):
    """UNIQUEID tells tasks apart and SEQNO counts the rows of each, from 1 without gaps."""
    df = stored(spark, d, """JOB "u" MAP { n = LOAD "$D/nation.parquet" USING PARQUET(); g = FROM n GENERATE n_nationkey, TOBYTEARRAY(n_name) AS b, UNIQUEID() AS u, SEQNO() AS s; } STORE g INTO "$OUT/out" USING PARQUET(); END""")
    rows = df.groupBy("u").agg(F.count("*").alias("n"), F.countDistinct("s").alias("distinct"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    return df.join(rows, "u").select("n_nationkey", F.hex("b").alias("bytes"), (F.col("distinct") == F.col("n")).alias("apart"), ((F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("counted"))


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY ALL")
def create_array(spark, d):
    df = stored(spark, d, """JOB "a" MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); g = GROUP o BY o_custkey AGGREGATES CREATE_ARRAY(o_orderkey) AS orders; } STORE g INTO "$OUT/out" USING PARQUET(); END""")
    return df.select("o_custkey", F.array_join(F.sort_array("orders"), ",").alias("orders"))


@query("SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_extendedprice, 0.25) AS p25, count(*) AS n FROM lineitem GROUP BY ALL")
def group_percentiles(spark, d):
    return group(table(spark, d, "lineitem"), ["l_returnflag"], [A("MEDIAN", ("l_quantity",), "med"), A("PERCENTILE", ("l_extendedprice",), "p25", args=(0.25,)), A("COUNT", (), "n")])


@query("SELECT CAST((sum(o_orderkey * 1000003) % 4294967296 + 4294967296 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS s FROM orders")
def strict_sum(spark, d):
    wrapped = F.col("o_orderkey") * 1000003
    low = F.pmod(wrapped, F.lit(1 << 32))
    df = table(spark, d, "orders").select(F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int").alias("x"))
    return group(df, [], [A("SUM", ("x",), "s")], strict=True)


@query("SELECT o_orderkey, (o_custkey + 2) * 3 AS scaled FROM orders WHERE o_custkey < 300")
def register_function(spark, d):
    def prepare(root: str) -> None:
        write_text(spark, f"{root}/{module}.py", "class Scale:\n    def __init__(self, by, more):\n        self.by, self.more = by, more\n\n    def __call__(self, x):\n        return (x + self.more) * self.by\n")

    module = f"scales_{os.getpid()}_{id(spark) % 9973}"
    return stored(spark, d, f"""
        REGISTER "$OUT/{module}.py"; FUNCTION scale {module}.Scale(3, 2);
        JOB "s" MAP {{ o = LOAD "$D/orders.parquet" USING PARQUET(); f = FILTER o BY o_custkey < $limit; g = FROM f GENERATE o_orderkey, scale(o_custkey) AS scaled; }} STORE g INTO "$OUT/out" USING PARQUET(); END""", prepare=prepare, limit=300)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def settings_and_temp(spark, d):
    """SET reaches the job's session alone; $BLOCKMILL_TEMP holds what passes between jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = stored(spark, d, """
        PROGRAM "settings"; SET overwrite true;
        JOB "one" SET spark.sql.shuffle.partitions 3; MAP { o = LOAD "$D/orders.parquet" USING PARQUET(); g = FROM o GENERATE o_orderstatus; } STORE g INTO "$BLOCKMILL_TEMP/o" USING PARQUET(); END
        JOB "two" MAP { o = LOAD "$BLOCKMILL_TEMP/o" USING PARQUET(); g = GROUP o BY o_orderstatus AGGREGATES COUNT() AS n; } STORE g INTO "$OUT/out" USING PARQUET(); END""")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    return df


@query("SELECT 'first' AS job, 'LONG k, STRING name' AS stores UNION ALL SELECT 'second', 'STRING name, LONG n'")
def describe_script(spark, d):
    found = describe(spark, """
        JOB "first" MAP { c = LOAD "$D/customer.parquet" USING PARQUET(); t = TEE c INTO "$OUT/none" USING TEXT(); r = FROM t GENERATE c_custkey AS k, c_name AS name; } STORE r INTO "$OUT/a" USING PARQUET(); END
        JOB "second" MAP { c = LOAD "$D/customer.parquet" USING PARQUET(); g = FROM c GENERATE c_name AS name; } SHUFFLE g PARTITIONED ON name; REDUCE { s = GROUP g BY name AGGREGATES COUNT() AS n; } STORE s INTO "$OUT/b" USING PARQUET(); END""", {"D": d, "OUT": "/none"})
    return spark.createDataFrame(found, "job string, stores string")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20' GROUP BY ALL")
def summary_view_in_script(spark, d):
    def prepare(root: str) -> None:
        e = table(spark, d, "events").select("event_type", "user_id", F.date_format("ts", "yyyyMMdd").cast("int").alias("day")).where("day < 20240120")
        e.where("day < 20240110").write.parquet(f"{root}/early")
        e.write.parquet(f"{root}/all")

    view = """JOB "{0}" MAP {{ e = LOAD "$OUT/{0}" USING PARQUET(); g = GROUP e BY event_type AGGREGATES COUNT_DISTINCT(user_id) AS users, SUMMARY VIEW=v, SUMMARY PATH="$OUT/view", TIME_COLUMNS=[("$OUT/{0}", day, "yyyyMMdd")]; }} STORE g INTO "$OUT/{1}" USING PARQUET(); END"""
    root = Scratch(spark, "script").root
    prepare(root)
    for name, out in (("early", "first"), ("all", "out")):
        run_script(spark, view.format(name, out), {"OUT": root})
    return storage("PARQUET").read(spark, [f"{root}/out"], {})


# --- users' operators and cube aggregates ---------------------------------------------------------------------------


def both_parts(df: DataFrame, params: dict[str, str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in params["parts"].split(","):
                yield b.assign(part=part)

    return df.mapInPandas(run, "n_nationkey int, n_name string, part string")


@query("SELECT n_nationkey, n_name, k AS part FROM nation, (SELECT unnest(['a', 'b']) AS k) WHERE n_regionkey = 1")
def user_tuple_operator(spark, d):
    r = Registry()
    r.operator("both_parts", both_parts)
    return stored(spark, d, """
        JOB "u" MAP { n = LOAD "$D/nation.parquet" USING PARQUET(); f = FILTER n BY n_regionkey == 1; g = FROM f GENERATE n_nationkey, n_name; p = both_parts g { "parts": "a,b" }; } STORE p INTO "$OUT/out" USING PARQUET(); END""", r)


def fold_blocks(df: DataFrame, params: dict[str, str]) -> DataFrame:
    def fold(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_type": [b["event_type"].iloc[0]], "n": [len(b)], "most": [b["value"].max()]})

    return df.groupBy("event_type", "part").applyInPandas(fold, "event_type string, n long, most double")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(value) AS most FROM events GROUP BY ALL")
def user_block_operator(spark, d):
    """The operator's contract is a whole block at once: blocks here are small groups, folded again afterwards."""
    r = Registry()
    r.operator("fold_blocks", fold_blocks)
    return stored(spark, d, """
        JOB "u" MAP { e = LOAD "$D/events.parquet" USING PARQUET(); g = FROM e GENERATE event_type, value, MOD(user_id, 16) AS part; }
          SHUFFLE g PARTITIONED ON event_type, part;
          REDUCE { b = fold_blocks g { "none": "x" }; s = GROUP b BY event_type AGGREGATES SUM(n) AS n, MAX(most) AS most; } STORE s INTO "$OUT/out" USING PARQUET(); END""", r)


def stamped(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """Adds what the cached file says; each task opens its own copy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        with open(SparkFiles.get(params["file"])) as f:
            text = f.read()
        for b in batches:
            yield b.assign(stamp=text)

    return df.mapInPandas(run, "r_regionkey int, stamp string")


@query("SELECT r_regionkey, 'from a file' AS stamp FROM region")
def cached_files(spark, d):
    root, name = Scratch(spark, "files").root, f"stamp-{os.getpid()}.txt"
    write_text(spark, f"{root}/{name}", "from a file")
    one = lambda df, p: stamped(df, p)
    one.cached_files = [f"{root}/{name}"]
    r = Registry()
    r.operator("stamped", one)
    return stored(spark, d, f"""JOB "s" MAP {{ r = LOAD "$D/region.parquet" USING PARQUET(); g = FROM r GENERATE r_regionkey; s = stamped g {{ "file": "{name}" }}; }} STORE s INTO "$OUT/out" USING PARQUET(); END""", r)


class SquaresOfSums:
    """For each inner key the sum of its values; of a cell, the sum of these sums' squares, and how many there are."""

    output_type = "struct<squares:bigint,keys:bigint>"

    def setup(self, columns):
        self.value = None

    def buffer(self):
        return [0, 0, 0, False]  # squares, keys, the open key's sum, whether one is open

    def process(self, row):
        self.value = row[0] or 0

    def aggregate(self, buffer):
        buffer[2] += self.value
        buffer[3] = True

    def end_measure(self, buffer):
        if buffer[3]:
            buffer[0] += buffer[2] ** 2
            buffer[1] += 1
        buffer[2], buffer[3] = 0, False

    def merge(self, into, other):
        into[0] += other[0]
        into[1] += other[1]

    def output(self, buffer):
        return {"squares": buffer[0], "keys": buffer[1]}


_SQUARES = """WITH i AS (SELECT o_orderstatus, o_orderpriority, o_custkey, grouping_id(o_orderstatus, o_orderpriority) AS g, sum(o_shippriority + o_orderkey % 100) AS s FROM (SELECT *, 0 AS o_shippriority FROM orders)
 GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority, o_custkey), (o_orderstatus, o_custkey), (o_custkey)))
 SELECT o_orderstatus, o_orderpriority, CAST(sum(s * s) AS BIGINT) AS squares, count(*) AS keys FROM i GROUP BY o_orderstatus, o_orderpriority, g"""


@query(_SQUARES)
def cube_buffer_aggregate(spark, d):
    df = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey", F.expr("o_orderkey % 100").alias("x"))
    dims = ["o_orderstatus", "o_orderpriority"]
    out = cube(df, dims, [A("USER", ("x",), "v", user=SquaresOfSums)], [tuple(dims), ("o_orderstatus",), ()], inner=["o_custkey"])
    return out.select(*dims, "v.squares", "v.keys")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus)")
def cube_count_to_one(spark, d):
    return cube(table(spark, d, "orders"), ["o_orderstatus"], [A("[SUM,COUNT_TO_ONE]", ("o_orderkey",), "customers"), A("COUNT", (), "n")], inner=["o_custkey"])

