"""What compiling does and does not do, the order of jobs, settings, stores, plans of blocks, percentiles, buffers, pieces and hooks."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockmill import cli, scratch
from blockmill.operators import blocks, cube, pieces, rows
from blockmill.operators.aggregates import Aggregate as A
from blockmill.operators.aggregates import group
from blockmill.plans import hooks
from blockmill.plans.compiler import Compiler, _inputs, _outputs, describe, run_script
from blockmill.plans.jobs import feeds, levels
from blockmill.plans.parser import parse
from blockmill.queries import QUERIES, Spread
from blockmill.script_queries import SquaresOfSums
from blockmill.types import SchemaError


def test_describe_has_no_effects(spark, tmp_path):
    t = str(tmp_path)
    spark.createDataFrame([("a", 1, 20240101), ("b", 2, 20240102)], "kind string, member int, day int").write.parquet(f"{t}/in")
    text = f"""
    JOB "one" MAP {{ f = LOAD "{t}/in" USING PARQUET(); t = TEE f INTO "{t}/tee" USING TEXT(); s = SORT t ON kind, member; r = RANK s AS place; p = PIVOT IN MEMORY r; }}
      STORE p INTO "{t}/a" USING PARQUET(); END
    JOB "two" MAP {{ f = LOAD "{t}/in" USING PARQUET(); g = GROUP f BY kind AGGREGATES COUNT_DISTINCT(member) AS n, SUMMARY VIEW=v, SUMMARY PATH="{t}/view", TIME_COLUMNS=[("{t}", day, "yyyyMMdd")]; }} STORE g INTO "{t}/b" USING PARQUET(); END
    JOB "three" MAP {{ f = LOAD "{t}/in" USING PARQUET(); }} DICTIONARY f ON kind; STORE f INTO "{t}/c" USING PARQUET(); END"""
    assert describe(spark, text) == [("one", "STRING kind, INT member, INT day, LONG place"), ("two", "STRING kind, LONG n"), ("three", "STRING colname, STRING colvalue, INT code")]
    assert os.listdir(t) == ["in"]
    (tmp_path / "s.bm").write_text(text)
    assert cli.main(["compile", f"{t}/s.bm"]) == 0 and cli.main(["describe", f"{t}/s.bm"]) == 0
    assert sorted(os.listdir(t)) == ["in", "s.bm"]
    run_script(spark, text)
    assert {"tee", "view", "a", "b", "c"} <= set(os.listdir(t))
    assert describe(spark, text)[2][1] == "STRING colname, STRING colvalue, INT code" and not [n for n in os.listdir(t) if "refresh" in n]


def test_order_by_tees_views_and_patterns():
    job = lambda body, store: f'JOB "x" MAP {{ {body} }} STORE a INTO "{store}" USING PARQUET(); END'
    program = parse("\n".join([
        job('a = LOAD "/p/tee/part-1" USING TEXT("schema": "INT a");', "/o/1"),
        job('a = LOAD "/in" USING PARQUET(); t = TEE a INTO "/p/tee" USING TEXT();', "/o/2"),
        job('a = LOAD "/o/{2,7}" USING PARQUET();', "/o/3"),
        job('a = LOAD "/q/v#LATEST/data" USING PARQUET();', "/o/4"),
        job('a = LOAD "/in" USING PARQUET();', "/q/v9/data"),
        job('a = LOAD "/dates", "/x" USING PARQUET();', "/o/5"),
        job('a = LOAD "/in" USING PARQUET();', "/dates/daily/2024/01/01"),
    ]))
    jobs = {str(k): (_inputs(j), _outputs(j)) for k, j in enumerate(program.jobs)}
    order = levels(jobs)
    at = {n: k for k, level in enumerate(order) for n in level}
    assert at["1"] < at["0"] and at["1"] < at["2"] and at["4"] < at["3"] and at["6"] < at["5"]
    assert feeds("/a/b", "/a/b/c") and feeds("/a/b/c", "/a/b") and feeds("/a/b/", "/a/*") and not feeds("/a/b", "/a/bc") and not feeds("/a/x", "/a/{b,c}")


def test_settings_are_the_jobs_own(spark, tmp_path):
    t = str(tmp_path)
    spark.range(1000).write.parquet(f"{t}/in")
    seen = []

    def spy(df, params):
        session = df.sparkSession
        seen.append((session.conf.get("spark.sql.shuffle.partitions"), session._jsparkSession.sessionState().newHadoopConf().get("my.reader.option")))
        return df

    from blockmill.functions.registry import Registry

    r = Registry()
    r.operator("spy", spy)
    text = f"""PROGRAM "p"; SET my.reader.option "x1";
    JOB "j" SET spark.sql.shuffle.partitions 5; MAP {{ a = LOAD "{t}/in" USING PARQUET(); b = spy a {{ "k": "v" }}; }} STORE b INTO "{t}/out" USING PARQUET(); END"""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    run_script(spark, text, registry=r)
    assert seen == [("5", "x1")] and spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("my.reader.option", "none") == "none"
    with pytest.raises(SchemaError, match="SET spark.sql.warehouse.dir"):
        run_script(spark, text.replace("spark.sql.shuffle.partitions 5", 'spark.sql.warehouse.dir "/x"').replace("/out", "/out2"), registry=r)


def test_validation_runs_with_the_job(spark, tmp_path):
    t = str(tmp_path)
    df = spark.range(300).selectExpr("CAST(id % 30 AS INT) AS k", "id AS v")
    blocks.save(blocks.blockgen(df, "ROW", 50, ["k"], ["k"], 3).withColumn(blocks.BLOCK, F.col(blocks.BLOCK) + F.floor(F.col("v") / 30) % 2), f"{t}/bad", ["k"], ["k"], 3)
    text = f'JOB "v" MAP {{ f = LOAD "{t}/bad" USING BLOCKS(); v = VALIDATE f BY ROW 50 PARTITIONED ON k SORTED ON k; }} STORE v INTO "{t}/out" USING PARQUET(); END'
    assert describe(spark, text)
    with pytest.raises(SchemaError, match="key in two blocks"):
        run_script(spark, text)
    assert not os.path.exists(f"{t}/out")


def test_memory_is_let_go_and_scratch_tables_go(spark, tmp_path):
    t = str(tmp_path)
    spark.range(50).write.parquet(f"{t}/in")
    held = len(scratch._LIVE)
    run_script(spark, f'JOB "m" MAP {{ a = LOAD "{t}/in" USING PARQUET(); p = PIVOT IN MEMORY a; s = SORT p ON id; r = RANK s AS place; }} STORE r INTO "{t}/out" USING PARQUET(); END')
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0 and len(scratch._LIVE) == held
    assert sorted(r.place for r in spark.read.parquet(f"{t}/out").collect()) == list(range(1, 51))


def test_a_store_that_is_written_over_stays_whole(spark, tmp_path):
    t = f"{tmp_path}/b"
    make = lambda n: blocks.blockgen(spark.range(n).selectExpr("CAST(id % 10 AS INT) AS k", "id AS v"), "ROW", 20, ["k"], buckets=2)
    blocks.save(make(100), t, ["k"], buckets=2)
    with pytest.raises(SchemaError, match="holds blocks already"):
        blocks.save(make(10), t, ["k"], buckets=2)
    broken = make(100).withColumn("v", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        blocks.save(broken, t, ["k"], buckets=2, overwrite=True)
    assert blocks.load(spark, t).count() == 100
    blocks.save(make(60), t, ["k"], buckets=2, overwrite=True)
    assert blocks.load(spark, t).count() == 60 and blocks.index(spark, t).agg(F.sum("_rows")).first()[0] == 60
    assert len([n for n in os.listdir(t) if n.startswith("v-")]) == 1


def test_matched_joins_have_no_exchange_above_the_blocks(spark):
    a = spark.range(5000).selectExpr("IF(id % 50 = 0, NULL, id % 700) AS k", "id AS v")
    b = spark.range(900).selectExpr("IF(id > 890, NULL, id) AS k", "id * 2 AS w")
    left = blocks.blockgen(a, "ROW", 100, ["k"], buckets=6)
    right = blocks.blockgen_by_index(b, blocks.boundaries(left, ["k"]), ["k"], buckets=6)
    for kind, how in (("", "inner"), ("LEFT OUTER", "left"), ("FULL OUTER", "full")):
        out = blocks.matched_join(left, "a", ["k"], right, "b", ["k"], kind)
        want = a.select(*(F.col(c).alias(f"a___{c}") for c in a.columns)).join(b.select(*(F.col(c).alias(f"b___{c}") for c in b.columns)), F.expr("a___k <=> b___k"), how)
        assert out.count() == want.count() and out.exceptAll(want).isEmpty()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [struct" in plan
        sides = re.split(r"REPARTITION_BY_NUM", plan.split("SortMergeJoin [struct", 1)[1])
        assert "Exchange" not in sides[0].rsplit("Exchange", 1)[0] and "ENSURE_REQUIREMENTS" not in sides[0]


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_a_bucket_is_in_one_partition_however_ids_are_joined(spark, tmp_path, threshold):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.range(3000).selectExpr("IF(id % 50 = 0, NULL, id % 700) AS k", "id AS v")
        for n in (3, 8, 20):  # fewer than the partitions of a shuffle, as many, and more
            fact = blocks.blockgen(df, "ROW", 40, ["k"], ["k", "v"], n)
            for out in (fact, blocks.blockgen_by_index(df, blocks.boundaries(fact, ["k"]), ["k"], ["k", "v"], n)):
                at = out.withColumn("p", F.spark_partition_id()).groupBy(F.shiftright(blocks.BLOCK, 32).alias("b")).agg(F.countDistinct("p").alias("n")).agg(F.max("n"), F.count("*")).first()
                assert at[0] == 1 and at[1] == len({r.b for r in df.select(blocks.bucket_of(["k"], n).alias("b")).distinct().collect()})
        blocks.save(blocks.blockgen(df, "ROW", 40, ["k"], ["k", "v"], 3), f"{tmp_path}/f", ["k"], ["k", "v"], 3)
        files = blocks.load(spark, f"{tmp_path}/f").withColumn("f", F.input_file_name()).groupBy(blocks.BLOCK).agg(F.countDistinct("f").alias("n"))
        assert files.agg(F.max("n")).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_store_holds_whole_blocks_however_rows_lie(spark, tmp_path, monkeypatch):
    df = spark.range(3000).selectExpr("id % 700 AS k", "id AS v")
    frame = type(df)
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols, f=frame.repartition: f(self, max(11, n) if cols else n, *cols))
    made = blocks.blockgen(df, "ROW", 40, ["k"], ["k", "v"], 3)
    for name, rows_ in (("made", made), ("mixed", made.repartition(7))):
        blocks.save(rows_, f"{tmp_path}/{name}", ["k"], ["k", "v"], 3)
        stored = blocks.load(spark, f"{tmp_path}/{name}")
        files = stored.withColumn("f", F.input_file_name()).groupBy(blocks.BLOCK).agg(F.countDistinct("f").alias("n"))
        assert files.agg(F.max("n")).first()[0] == 1 and stored.count() == 3000
        assert all(r.violations == 0 for r in blocks.validate(stored, ["k"], ["k", "v"], 3, "ROW", 40).collect())


def test_blocks_end_where_they_are_full(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1, 2, 7, 40]) for _ in range(300)]
    df = spark.createDataFrame([(k, j) for k, n in enumerate(sizes) for j in range(n)], "k int, j int")
    for kind, n in (("ROW", 30), ("ROW", 1), ("PARTITION_KEY", 7), ("SIZE", 400)):
        out = blocks.blockgen(df, kind, n, ["k"], buckets=4)
        got = {r.k: r[blocks.BLOCK] for r in out.select("k", blocks.BLOCK).distinct().collect()}
        of = {r.k: r.b for r in df.select("k", blocks.bucket_of(["k"], 4).alias("b")).distinct().collect()}
        cost = {"ROW": lambda k: sizes[k], "PARTITION_KEY": lambda k: 1, "SIZE": lambda k: sizes[k] * 8}[kind]
        for bucket in range(4):
            number, full = 0, 0
            for k in sorted(k for k, b in of.items() if b == bucket):
                if full >= n:
                    number, full = number + 1, 0
                full += cost(k)
                assert got[k] == (bucket << 32) + number, (kind, k)


def test_exact_percentiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, rng.randrange(20), rng.random() * 100])) for _ in range(3000)]
    rows += [("none", 1, None), ("one", 2, 5.0)]
    df = spark.createDataFrame([(g, h, None if v is None else float(v)) for g, h, v in rows], "g string, h int, v double").repartition(5)
    asks = [A("MEDIAN", ("v",), "med"), A("PERCENTILE", ("v",), "p10", args=(0.1,)), A("PERCENTILE", ("v",), "top", args=(1.0,)), A("COUNT", ("v",), "n")]

    def want(some):
        v = sorted(x for x in some if x is not None)
        return [None if not v else float(np.quantile(v, p)) for p in (0.5, 0.1, 1.0)] + [len(v)]

    near = lambda x, y: all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(x, y, strict=True))
    got = {(r.g, r.h): r[2:] for r in group(df, ["g", "h"], asks).collect()}
    assert set(got) == {(g, h) for g, h, _ in rows}
    assert all(near(x, want(v for a, b, v in rows if (a, b) == k)) for k, x in got.items())
    (all_,) = group(df, [], asks).collect()
    assert near(all_, want(v for *_, v in rows)) and group(df.limit(0), [], asks).collect() == []
    cells = {(r.g, r.h, r.grouping_id): r[3:] for r in cube.cube(df, ["g", "h"], asks, nulls="keep", grouping=True).collect()}
    assert all(near(cells[g, h, 0], x) for (g, h), x in got.items()) and near(cells[None, None, 3], all_)
    for h in (1, 2):
        assert near(cells[None, h, 2], want(v for _, b, v in rows if b == h))
    assert cube.cube(df.where("g = 'one'"), ["h"], [A("MEDIAN", ("v",), "m")]).count() == 2
    for bad in (A("PERCENTILE", ("v",), "p", args=(1.5,)), A("MEDIAN", ("g",), "m")):
        with pytest.raises(SchemaError):
            group(df, ["h"], [bad])


def test_cube_buffers(spark):
    class Longest:
        """Without a merge: the longest run of rows of one inner key."""

        output_type = "long"

        def setup(self, columns):
            assert columns == ["v"]

        def buffer(self):
            return {"open": 0, "most": 0}

        def process(self, row):
            self.row = row

        def aggregate(self, buffer):
            buffer["open"] += self.row[0] is not None

        def end_measure(self, buffer):
            buffer["most"], buffer["open"] = max(buffer["most"], buffer["open"]), 0

        def output(self, buffer):
            return buffer["most"]

    rng = random.Random(9)
    rows = [(rng.choice("xy"), rng.choice("pq"), rng.randrange(30), rng.choice([None, rng.randrange(9)])) for _ in range(800)]
    df = spark.createDataFrame(rows, "a string, b string, k int, v int").repartition(6)
    out = cube.cube(df, ["a", "b"], [A("USER", ("v",), "q", user=SquaresOfSums), A("USER", ("v",), "longest", user=Longest), A("SUM", ("v",), "s")], inner=["k"])
    got = {(r.a, r.b): (r.q.squares, r.q["keys"], r.longest, r.s) for r in out.collect()}
    for a in ("x", "y", None):
        for b in ("p", "q", None):
            some = [r for r in rows if a in (None, r[0]) and b in (None, r[1])]
            sums, counts = {}, {}
            for _, _, k, v in some:
                sums[k] = sums.get(k, 0) + (v or 0)
                counts[k] = counts.get(k, 0) + (v is not None)
            assert got[a, b] == (sum(x * x for x in sums.values()), len(sums), max(counts.values()), sum(v or 0 for *_, v in some))
    with pytest.raises(SchemaError, match="aggregate of cubes"):
        group(df, ["a"], [A("USER", ("v",), "q", user=Longest)])


def test_cube_takes_cells_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CELLS", 7)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")

    class Count:
        """Values, and the rows of the largest piece that any task was given."""

        output_type = "struct<n:bigint,most:bigint>"

        def buffer(self):
            return [0, 0]

        def take(self, buffer, v, w):
            assert len(v) == len(w)
            buffer[:] = [buffer[0] + int(v.notna().sum()), max(buffer[1], len(v))]

        def merge(self, into, other):
            into[:] = [into[0] + other[0], max(into[1], other[1])]

        def output(self, buffer):
            return {"n": buffer[0], "most": buffer[1]}

    try:
        rng = random.Random(4)
        big = 1 << 60  # beyond what a double tells apart
        rows = [(rng.choice(["x", "y", None]), big + rng.randrange(9), rng.choice([True, False]), rng.choice([None, float(rng.randrange(9))]), k) for k in range(3000)] + [("z", big, True, None, 0)]
        df = spark.createDataFrame(rows, "a string, b long, c boolean, v double, w long").repartition(3)
        for sets in (None, [("a", "b"), ("c",)], [("b",), ()]):
            users = [A("USER", ("v",), "s", user=Spread), A("USER", ("v", "w"), "n", user=Count), A("COUNT", ("v",), "want"), A("MIN", ("v",), "lo"), A("MAX", ("v",), "hi")]
            out = cube.cube(df, ["a", "b", "c"], users, sets, nulls="keep", grouping=True).collect()
            assert all(r.n.n == r.want and r.n.most <= 50 and r.s == (None if r.want == 0 else r.hi - r.lo) for r in out)
            assert len({(r.grouping_id, r.a, r.b, r.c) for r in out}) == len(out) > 8
        assert cube.cube(df.where("w < 0"), ["a"], [A("USER", ("v",), "s", user=Spread)], nulls="keep").collect() == []
        assert cube.cube(df, [], [A("USER", ("v",), "s", user=Spread)]).collect()[0].s == 8
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    with pytest.raises(SchemaError, match="aggregate of cubes"):
        group(df, ["a"], [A("USER", ("v",), "s", user=Spread)])


def test_cube_pandas_aggregate_holds_no_cell(spark):
    plan = QUERIES["cube_pandas_aggregate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowAggregatePython" not in plan and "AggregateInPandas" not in plan


def test_hooks_and_metafiles(spark, tmp_path):
    t = str(tmp_path)
    assert hooks.read(spark, f"{t}/none") == {}
    hooks.run(spark, [f"METAFILE WRITE {t}/m a 1 b 'two words'", f"METAFILE UPDATE {t}/m a 3", f"HDFS RENAME {t}/m {t}/n"])
    assert hooks.run(spark, [f"METAFILE READ {t}/n"]) == [{"a": "3", "b": "two words"}]
    hooks.run(spark, [f"HDFS DELETE {t}/n"])
    assert not os.path.exists(f"{t}/n")
    for bad in ("", "METAFILE", "METAFILE WRITE x y", "HDFS COPY a b", "shell rm"):
        with pytest.raises(SchemaError):
            hooks.run(spark, [bad])


def test_temporary_folder_goes(spark, tmp_path):
    t = str(tmp_path)
    spark.range(9).write.parquet(f"{t}/in")
    run_script(spark, f'JOB "a" MAP {{ x = LOAD "{t}/in" USING PARQUET(); }} STORE x INTO "$BLOCKMILL_TEMP/x" USING PARQUET(); END JOB "b" MAP {{ x = LOAD "$BLOCKMILL_TEMP/x" USING PARQUET(); }} STORE x INTO "{t}/out" USING PARQUET(); END')
    assert spark.read.parquet(f"{t}/out").count() == 9
    root = scratch.shared_dir(spark).removeprefix("file:")
    assert not [n for n in os.listdir(root) if n.startswith("temp-")] and Compiler(spark).held == []


def test_sorted_order_is_forced(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, "c")], "k int, v string").coalesce(1)
    assert rows.force_sorted_order(rows.sort(df, ["k", "v"]), ["k", "v"]).count() == 3
    with pytest.raises(SchemaError, match="1 rows aren't in the order of k"):
        rows.force_sorted_order(df, ["k"])


def test_dimensions_have_four_types(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS d, 1.5D AS x, true AS b, 1 AS i, 2L AS l, 's' AS s")
    assert cube.cube(df, ["b", "i", "l", "s"], [A("COUNT", (), "n")]).count() == 16
    for bad in ("d", "x"):
        with pytest.raises(SchemaError, match="dimensions are"):
            cube.cube(df, [bad], [A("COUNT", (), "n")])
