"""Small inputs with known results, for each operator."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmill.functions.expressions import expression
from blockmill.operators import aggregates, blocks, cube, dictionary, joins, rows, window
from blockmill.operators.aggregates import Aggregate as A
from blockmill.types import SchemaError, parse_schema, show_schema, wider


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), parse_schema(schema))


def got(df):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return sorted([tuple(r) for r in df.collect()], key=key)


def same(df, *expected):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert got(df) == sorted(expected, key=key)


def ints(spark, *values):
    return frame(spark, "INT a", *((v,) for v in values))


N = None


@pytest.mark.parametrize("f", [joins.hash_join, joins.merge_join])
@pytest.mark.parametrize(
    ("kind", "expected"),
    [
        ("", [(2, 2), (2, 2), (100, 100), (100, 100)]),
        ("LEFT OUTER", [(0, N), (2, 2), (2, 2), (5, N), (10, N), (100, 100), (100, 100)]),
        ("RIGHT OUTER", [(N, 1), (2, 2), (2, 2), (N, 7), (N, 9), (100, 100), (100, 100)]),
        ("FULL OUTER", [(0, N), (N, 1), (2, 2), (2, 2), (5, N), (N, 7), (N, 9), (10, N), (100, 100), (100, 100)]),
    ],
)
def test_joins(spark, f, kind, expected):
    out = f(ints(spark, 0, 2, 2, 5, 10, 100), "l", ["a"], ints(spark, 1, 2, 7, 9, 100, 100), "r", ["a"], kind)
    assert out.columns == ["l___a", "r___a"]
    same(out, *expected)


@pytest.mark.parametrize("f", [joins.hash_join, joins.merge_join])
@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [((2, 2, 7, 9), (2, 7, 9), [(2, 2), (2, 2), (7, 7), (9, 9)]), ((2, 2, 5, 10), (1, 7, 9), []), ((0, 2, 2, 5, 10), (1, 2, 2, 7, 9), [(2, 2)] * 4), ((N, 1), (N, N, 1), [(N, N), (N, N), (1, 1)]), ((1, 2), (), [])],
)
def test_inner_joins(spark, f, left, right, expected):
    same(f(ints(spark, *left), "l", ["a"], ints(spark, *right), "r", ["a"]), *expected)


def test_full_outer_with_nothing(spark):
    same(joins.merge_join(ints(spark, 0, 2, 2), "l", ["a"], ints(spark), "r", ["a"], "FULL OUTER"), (0, N), (2, N), (2, N))


@pytest.mark.parametrize("f", [joins.hash_join, joins.merge_join])
def test_joins_on_two_keys(spark, f):
    left = frame(spark, "INT a, INT b", (0, 1), (2, 1), (2, 2), (5, 1), (10, 1), (100, 1))
    right = frame(spark, "INT c, INT a", (1, 1), (2, 0), (2, 1), (5, 1), (100, 2), (100, 3))
    same(f(left, "l", ["a", "b"], right, "r", ["c", "a"]), (2, 1, 2, 1), (5, 1, 5, 1))
    with pytest.raises(SchemaError):
        f(left, "l", ["a"], right, "r", ["a", "c"])


def test_fact_to_dimension(spark):
    fact = frame(spark, "INT k, INT f", (1000, 20), (1000, 21), (1001, 22))
    dim = frame(spark, "INT k, INT d", (1000, 100), (1002, 102))
    same(joins.reduce_join(fact, dim, ["k"]), (1000, 20, 100), (1000, 21, 100))
    same(joins.reduce_join(fact, dim, ["k"], "LEFT OUTER"), (1000, 20, 100), (1000, 21, 100), (1001, 22, N))
    same(joins.reduce_join(fact.limit(0), dim, ["k"]))
    twice = frame(spark, "INT k, INT d", (1000, 100), (1000, 101))
    with pytest.raises(Exception, match="more than one row for 1000"):
        joins.reduce_join(fact, twice, ["k"]).collect()
    assert joins.reduce_join(fact, twice, ["k"], unique=False).count() == 4
    with pytest.raises(SchemaError):
        joins.reduce_join(fact, frame(spark, "INT k, INT f"), ["k"])


def test_group(spark):
    df = frame(spark, "INT a, INT b, INT c", (0, 0, 100), (0, 0, 100), (2, 2, 100), (2, 5, 100), (5, 6, 100), (6, 6, 100))
    same(aggregates.group(df, ["a", "b"], [A("SUM", ("c",), "s")]), (0, 0, 200), (2, 2, 100), (2, 5, 100), (5, 6, 100), (6, 6, 100))
    same(aggregates.group(frame(spark, "INT a, INT b", (0, 0), (0, 1), (0, 1), (5, 6), (5, 6), (100, 10)), ["a", "b"]), (0, 0), (0, 1), (5, 6), (100, 10))


def test_group_with_nulls(spark):
    data = [(0, 0), (1, N), (2, 2), (2, 5), (2, N), (3, N), (3, N), (5, 6), (8, N), (8, 0), (10, 1), (18, 0), (18, N), (18, 0), (100, 10)]
    out = aggregates.group(frame(spark, "INT a, INT b", *data), ["a"], [A(k, ("b",), k) for k in ("SUM", "MIN", "MAX", "COUNT")])
    same(out, (0, 0, 0, 0, 1), (1, N, N, N, 0), (2, 7, 2, 5, 2), (3, N, N, N, 0), (5, 6, 6, 6, 1), (8, 0, 0, 0, 1), (10, 1, 1, 1, 1), (18, 0, 0, 0, 2), (100, 10, 10, 10, 1))


def test_group_all_of_nothing(spark):
    df = ints(spark)
    same(aggregates.group(df, [], [A("COUNT", (), "n"), A("SUM", ("a",), "s")]))
    same(aggregates.group(ints(spark, 1, N), [], [A("COUNT", (), "n"), A("COUNT", ("a",), "m")]), (2, 1))


def test_aggregators(spark):
    df = ints(spark, 100, 100, N, 101, 100, 0, 1, -1)
    same(aggregates.group(df, [], [A("MIN", ("a",), "x"), A("MAX", ("a",), "y"), A("BITWISE_OR", ("a",), "z"), A("COUNT_DISTINCT", ("a",), "d")]), (-1, 101, -1, 5))
    d = frame(spark, "DOUBLE a", *((x,) for x in (100.0, 100.1, N, -101.1, 1e-9)))
    same(aggregates.group(d, [], [A("MIN", ("a",), "x"), A("MAX", ("a",), "y")]), (-101.1, 100.1))
    bag = aggregates.group(ints(spark, 1, N, 1), [], [A("BAG", ("a",), "b")]).first().b
    assert sorted((x.value for x in bag), key=str) == [1, 1, None]
    wrapped = aggregates.group(ints(spark, 2**31 - 1, 1), [], [A("SUM", ("a",), "s")], strict=True)
    assert wrapped.schema["s"].dataType == T.IntegerType()
    same(wrapped, (-(2**31),))
    with pytest.raises(SchemaError):
        aggregates.group(frame(spark, "STRING a", ("x",)), [], [A("SUM", ("a",))])


def test_presence_bitmap(spark):
    df = frame(spark, "INT k, STRING d", (1, "2024-01-01"), (1, "2024-01-03"), (1, "20240201"), (1, "2024-02-02"), (2, "2023-12-31"), (2, N))
    same(aggregates.group(df, ["k"], [A("PRESENCE_BITMAP", ("d",), "m", args=("2024-01-01",))]), (1, 5 - 2**31), (2, 0))


def test_cube_of_one_and_three(spark):
    one = frame(spark, "INT n, INT d", (1, 10), (1, 20), (2, 30), (2, 40), (3, 50))
    same(cube.cube(one, ["d"], [A("SUM", ("n",), "s")]), (10, 1), (20, 1), (30, 2), (40, 2), (50, 3), (N, 9))
    three = frame(spark, "INT n, INT a, INT b, INT c", (1, 1, 1, 1), (1, 1, 1, 2), (2, 1, 2, 1), (3, 1, 2, 2), (2, 2, 2, 2))
    out = got(cube.cube(three, ["a", "b", "c"], [A("SUM", ("n",), "s")]))
    assert len(out) == 22
    for row in ((1, N, N, 7), (2, N, N, 2), (N, 1, N, 2), (N, 2, N, 7), (N, N, 1, 3), (N, N, 2, 6), (N, N, N, 9)):
        assert row in out
    same(cube.cube(three.drop("c"), ["a", "b"], [A("SUM", ("n",), "s")], [("a", "b"), ("a",), ("b", "a")]), (1, N, 7), (2, N, 2), (1, 1, 2), (1, 2, 5), (2, 2, 2))


def test_cube_counts_members(spark):
    df = frame(spark, "INT m, LONG a, INT b, LONG c", (1, 1, 1, 1), (1, 1, 2, 1), (2, 1, 2, 2), (3, 1, 1, 1), (4, 1, 1, 2), (5, 2, 2, 2))
    out = got(cube.cube(df, ["a", "b", "c"], [A("COUNT_DISTINCT", ("m",), "n")], inner=["m"]))
    assert (N, N, N, 5) in out and (1, N, N, 4) in out and (2, N, N, 1) in out
    same(cube.cube(df, ["a", "b"], [A("COUNT_DISTINCT", ("m",), "n"), A("[SUM,COUNT_TO_ONE]", ("m",), "o")], [("a",)], inner=["m"]), (1, N, 4, 4), (2, N, 1, 1))


def test_cube_nulls(spark):
    df = frame(spark, "INT n, INT d", (1, N), (2, 1))
    with pytest.raises(Exception, match="null in dimension d"):
        cube.cube(df, ["d"], [A("SUM", ("n",), "s")]).collect()
    same(cube.cube(df, ["d"], [A("SUM", ("n",), "s")], nulls="keep", grouping=True), (N, 0, 1), (1, 0, 2), (N, 1, 3))
    with pytest.raises(SchemaError):
        cube.cube(df, ["d"], [A("SUM", ("n",), "s")], [("x",)])
    with pytest.raises(SchemaError):
        cube.cube(df, ["d"], [A("[SUM,MAX]", ("n",), "s")])


def test_grouping_sets():
    assert cube.combos(["a", "b", "c"], 1) == [("a",), ("b",), ("c",), ()]
    assert cube.rollups([("a", "b"), ("c",)]) == [("a", "b", "c"), ("a", "b"), ("a", "c"), ("a",), ("c",), ()]


def test_combine_and_sort(spark):
    out = rows.combine([ints(spark, 3, 5, 10).coalesce(1), ints(spark, 2, 7, 9).coalesce(1)], ["a"])
    assert sorted(r.a for r in out.collect()) == [2, 3, 5, 7, 9, 10]
    df = frame(spark, "INT a, INT b, INT c", (0, 10, 0), (2, 5, 2), (2, 8, 5), (5, 9, 6), (10, 11, 1), (100, 6, 10))
    assert [tuple(r) for r in rows.sort(df, ["b", "c"], whole=True).collect()] == [(2, 5, 2), (100, 6, 10), (2, 8, 5), (5, 9, 6), (0, 10, 0), (10, 11, 1)]
    with pytest.raises(SchemaError):
        rows.union([df, df.drop("a")])


def test_flatten(spark):
    df = frame(spark, "INT id, BAG b[TUPLE t(STRING n, INT v)], BAG c[TUPLE t(INT x)]", (1, [("a", 1), ("b", 2)], [(7,), (8,)]), (2, N, []))
    out = rows.flatten(df, [("b", "BAG_TUPLE", [("n", T.StringType()), ("v", T.LongType())]), ("c", "BAG", [("x", T.IntegerType())])])
    assert out.columns == ["id", "n", "v", "x"]
    same(out, (1, "a", 1, 7), (1, "a", 1, 8), (1, "b", 2, 7), (1, "b", 2, 8), (2, N, N, N))


def test_rows(spark):
    df = ints(spark, 1, 2)
    same(rows.duplicate(df, 2, "k"), (1, 0), (1, 1), (2, 0), (2, 1))
    written = []
    left = rows.tee(ints(spark, 1, 2, N), written.append, [("b", F.col("a") + 1)], F.col("a") == 1, split=True)
    same(left, (2,), (N,))
    same(written[0], (2,))
    same(rows.purge(ints(spark, 1, 2, N), "a", ints(spark, 2, N)), (1,), (N,))
    same(rows.pivot_by_row(ints(spark, *range(7)), 3, ["a"], "g"), *((k, k // 3) for k in range(7)))
    bag = frame(spark, "INT id, BAG b[TUPLE t(INT x, INT y)]", (1, [(5, 2), (6, 1), (7, N)]), (2, []), (3, N))
    same(rows.least_entry(bag, "b", 1, "e").select("id", "e.x", "e.y"), (1, 6, 1), (2, N, N), (3, N, N))


def test_rank_and_top(spark):
    df = frame(spark, "INT g, INT v", (1, 3), (1, 1), (2, 5), (1, N))
    same(window.rank(df, "r", ["g"], ["v"]), (1, N, 1), (1, 1, 2), (1, 3, 3), (2, 5, 1))
    same(window.top(df, ["g"], ["v"], 2), (1, N), (1, 1), (2, 5))
    same(window.rank(ints(spark, 5, 3, 4), "r", [], ["a"]), (3, 1), (4, 2), (5, 3))


def test_dictionary(spark):
    d = frame(spark, "STRING colname, STRING colvalue, INT code", ("k", "a", 1), ("k", "b", 2))
    df = frame(spark, "STRING k, INT v", ("a", 10), ("a", 11), ("b", 10))
    coded = dictionary.encode(df, ["k"], d)
    same(coded, (1, 10), (1, 11), (2, 10))
    same(dictionary.decode(coded, ["k"], d), ("a", 10), ("a", 11), ("b", 10))
    odd = frame(spark, "STRING k", (N,), ("z",))
    same(dictionary.encode(odd, ["k"], d, nulls_as=-2, unknowns_as=-1), (-2,), (-1,))
    for bad in ("null in k", "lacks: z"):
        with pytest.raises(Exception, match=bad):
            dictionary.encode(odd.where("k IS NULL" if "null" in bad else "k IS NOT NULL"), ["k"], d).collect()
    same(dictionary.decode(frame(spark, "INT k", (N,), (9,)), ["k"], d, "?"), (N,), ("?",))
    same(dictionary.refresh(frame(spark, "STRING k", ("c",), ("a",), ("0",)), ["k"], d), ("k", "a", 1), ("k", "b", 2), ("k", "0", 3), ("k", "c", 4))


@pytest.mark.parametrize(("n", "sizes"), [(1, [2, 1]), (2, [2, 1]), (3, [3])])
def test_blocks_by_row(spark, n, sizes):
    df = frame(spark, "INT a, INT b", (3, 1), (3, 2), (10, 1))
    out = blocks.blockgen(df, "ROW", n, ["a"], buckets=1)
    assert [r["count"] for r in out.groupBy(blocks.BLOCK).count().orderBy(blocks.BLOCK).collect()] == sizes


def test_blocks_are_whole_and_valid(spark):
    df = spark.range(5000).selectExpr("CAST(id % 700 AS INT) AS k", "id AS v")
    out = blocks.blockgen(df, "ROW", 50, ["k"], ["k", "v"]).cache()
    assert out.count() == 5000
    assert all(r.violations == 0 for r in blocks.validate(out, ["k"], ["k", "v"], kind="ROW", n=50).collect())
    mixed = out.withColumn(blocks.BLOCK, F.when(F.col("v") == 7, F.lit(0)).otherwise(F.col(blocks.BLOCK)))
    assert any(r.violations for r in blocks.validate(mixed, ["k"], ["k", "v"]).collect())
    dim = blocks.blockgen_by_index(spark.range(700).selectExpr("CAST(id AS INT) AS k"), blocks.boundaries(out, ["k"]), ["k"])
    assert blocks.matched_join(out, "f", ["k"], dim, "d", ["k"]).count() == 5000


def test_block_store(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 100 AS k", "id AS v")
    out = blocks.blockgen(df, "PARTITION_KEY", 10, ["k"])
    with pytest.raises(SchemaError):
        blocks.save(df, f"{tmp_path}/no", ["k"])
    blocks.save(out, f"{tmp_path}/b", ["k"])
    assert blocks.meta(spark, f"{tmp_path}/b").partition_keys == ["k"]
    again = blocks.load(spark, f"{tmp_path}/b")
    assert again.count() == 1000
    one = again.first()[blocks.BLOCK]
    part = blocks.extract(spark, f"{tmp_path}/b", one)
    assert 0 < part.count() < 1000
    assert blocks.load_matching(spark, f"{tmp_path}/b", part).count() == part.count()


def test_bucketed_join_has_no_exchange(spark):
    for name in ("left_t", "right_t"):
        blocks.save_bucketed(spark.range(500).selectExpr("id AS k", f"id AS {name}_v"), name, ["k"], 4, overwrite=True)
    joined = spark.table("left_t").hint("merge").join(spark.table("right_t"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "Exchange")
    assert joined.count() == 500
    for name in ("left_t", "right_t"):
        spark.sql(f"DROP TABLE {name}")


def test_schemas():
    text = "INT a, STRING b, BAG c[TUPLE element(STRING n, FLOAT v)], MAP m, TUPLE t(INT x)"
    assert show_schema(parse_schema(text)) == text
    for bad in ("INT", "INT a STRING b", "WORD a", "BAG b", "INT a;"):
        with pytest.raises(SchemaError):
            parse_schema(bad)
    assert wider(T.IntegerType(), T.LongType()) == T.LongType()
    assert wider(T.LongType(), T.FloatType()) == T.FloatType()
    assert wider(T.IntegerType(), T.StringType()) is None


ONE = "INT i, LONG l, DOUBLE d, STRING s, BOOLEAN t, BOOLEAN n"


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("i + 1", 8), ("i + 2147483647", -2147483642), ("l * 4611686018427387904L", 3 * 2**62 - 2**64), ("l + 9223372036854775807L", 3 + 2**63 - 1 - 2**64),
        ("0 - i / 2", -3), ("i / 2", 3), ("(0 - i) / 2", -3), ("MOD(0 - i, 4)", -3), ("d / 0.0", float("inf")), ("(0.0 - d) / 0.0", float("-inf")), ("i / 2.0", 3.5),
        ("LSHIFT(i, 2)", 28), ("RSHIFT(0 - i, 28)", 15), ("NOT (n == t)", None), ("n AND t", False), ("n OR t", True), ("NOT (n OR false)", True), ("n IS NULL", True),
        ("i IN (1, 7)", True), ("n IN (true)", False), ("s MATCHES 'a.c'", True), ("s MATCHES 'a.'", False), ("CONCAT(s, i, n, d)", "abc72.5"), ("CASTTOINT('12')", 12), ("CASTTOINT(d)", 2), ("CASTTOINT(4294967297L)", 1),
        ("CASTTOINT(1.0e300)", 2**31 - 1), ("CASTTOINT(t)", 1), ("CASTTOSTRING(t)", "true"), ("NVL('', s)", "abc"), ("NVL(s, 'x')", "abc"), ("CASE(i > 9, 'a', i > 5, 'b')", "b"), ("CASE(i > 9, 1)", None),
        ("s == 1", False), ("s != 1", True), ("i == 7L", True), ("true OR false AND false", False), ("1 + 2 * 3", 7), ("i -1", 6), ("i == 7 IS NULL", False), ("$0 + $1", 10), ("1.5f * 2", 3.0),
    ],
)
def test_functions(spark, text, value):
    df = frame(spark, ONE, (7, 3, 2.5, "abc", True, N))
    assert df.select(expression(text, df).alias("x")).first().x == value


@pytest.mark.parametrize("text", ["i / 0", "MOD(i, 0)", "CASTTOINT('3.5')", "CASTTODOUBLE(s)"])
def test_functions_that_raise(spark, text):
    df = frame(spark, ONE, (7, 3, 2.5, "abc", True, N))
    with pytest.raises(Exception):
        df.select(expression(text, df).alias("x")).collect()


@pytest.mark.parametrize("text", ["i + s", "x + 1", "$9", "NOPE(i)", "i AND t", "CASE(t, 1, t, 'a')", "s.x", "s#'k'", "SIZEOF(i)", "i MATCHES 'a'", "99999999999"])
def test_functions_that_do_not_compile(spark, text):
    df = frame(spark, ONE, (7, 3, 2.5, "abc", True, N))
    with pytest.raises(SchemaError):
        expression(text, df)


def test_functions_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = frame(spark, ONE, (7, 3, 2.5, "abc", True, N))
        for text, value in (("i + 2147483647", -2147483642), ("i / 2", 3), ("d / 0.0", float("inf")), ("CASTTOINT(1.0e300)", 2**31 - 1)):
            assert df.select(expression(text, df).alias("x")).first().x == value
        with pytest.raises(Exception):
            df.select(expression("CASTTOINT('3.5')", df)).collect()
        with pytest.raises(Exception):
            df.select(expression("i / 0", df)).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
