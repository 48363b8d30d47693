import pytest
from pyspark.sql import functions as F

from blockmill import scratch
from blockmill.operators import rows


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", ["3", "24"])
@pytest.mark.parametrize(("name", "by"), [("documents", ["n_chars", "doc_id"]), ("lineitem", ["l_extendedprice", "l_orderkey", "l_linenumber"])])
def test_wide_rows_keep_all_numbers(spark, tmp_path, adaptive, parts, name, by):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
        rows.number(df, by, "place").write.parquet(str(tmp_path / "out"))
        rows.pivot_by_row(df, 1000, by, "part").write.parquet(str(tmp_path / "parts"))
        got, n = spark.read.parquet(str(tmp_path / "out")), df.count()
        assert got.columns == [*df.columns, "place"]
        assert got.agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place")).first()[:] == (n, n, 1, n)
        assert got.select(*df.columns).agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first() == df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        ends = got.withColumn("part", F.floor((F.col("place") - 1) / 1000)).groupBy("part").agg(F.min(F.struct(*by)).alias("lo"), F.max(F.struct(*by)).alias("hi")).orderBy("part").collect()
        assert all(a.hi < b.lo for a, b in zip(ends, ends[1:], strict=False))
        sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "parts")).groupBy("part").count().orderBy("part").collect()]
        assert sum(sizes) == n and set(sizes[:-1]) <= {1000}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_no_rows_and_ties(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert rows.number(empty, ["a"], "k").collect() == []
    tied = spark.createDataFrame([(None, "x")] * 5 + [(1, "y")] * 5, "a int, b string")
    got = sorted((r.k, r.b) for r in rows.number(tied, ["a"], "k").collect())
    assert [k for k, _ in got] == list(range(1, 11)) and [b for _, b in got] == ["x"] * 5 + ["y"] * 5


def test_scratch_is_released(spark):
    from blockmill.sources.paths import exists

    s = scratch.Scratch(spark, "t")
    assert s.write(spark.range(3), "a").count() == 3
    scratch.release()
    assert not exists(spark, s.root)
