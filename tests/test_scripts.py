"""Scripts: tokens, trees, precedence, jobs, and whole programs over files."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from blockmill import cli
from blockmill.functions.registry import Registry
from blockmill.operators import blocks
from blockmill.plans import parser
from blockmill.plans.compiler import Compiler, describe, run_script, substitute
from blockmill.plans.jobs import levels
from blockmill.plans.parser import Call, Const, Ref, ScriptError, parse, parse_expression
from blockmill.plans.summary import SummaryView
from blockmill.sources import paths
from blockmill.sources.storage import Storage, storage
from blockmill.streaming import views
from blockmill.types import SchemaError, parse_schema


def show(e) -> str:
    if isinstance(e, Const):
        return repr(e.value)
    if isinstance(e, Ref):
        return ".".join(map(str, e.path)) + (f"#{e.key}" if e.key else "")
    return f"{e.name}({', '.join(map(show, e.args))})"


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a OR b AND c", "AND(OR(a, b), c)"),
        ("a + b IN (1, 2)", "ADD(a, IN(b, 1, 2))"),
        ("a == b IS NULL", "IS_NULL(EQ(a, b))"),
        ("NOT a == b", "NOT(EQ(a, b))"),
        ("a -1", "MINUS(a, 1)"),
        ("a * -1", "TIMES(a, -1)"),
        ("1 + 2 * 3 - 4", "MINUS(ADD(1, TIMES(2, 3)), 4)"),
        ("m.x.y # 'k' MATCHES 'z'", "MATCHES(m.x.y#k, 'z')"),
        ("$0 + $1.a", "ADD(0, 1.a)"),
        ("a.b.F(x, 1L)", "a.b.F(x, 1)"),
        ("CASE(a > 1, 'x', true, \"y\")", "CASE(GT(a, 1), 'x', True, 'y')"),
        ("(a OR b) AND NOT c IS NOT NULL", "AND(OR(a, b), NOT(IS_NOT_NULL(c)))"),
    ],
)
def test_precedence(text, tree):
    assert show(parse_expression(text)) == tree


@pytest.mark.parametrize("text", ["a +", "(a", "a b", "IN (1)", "a IN 1", "'open", "a ? b", "3000000000"])
def test_bad_expressions(text):
    with pytest.raises(ScriptError):
        parse_expression(text)


COUNT = """
PROGRAM "counts"; SET overwrite true;
FUNCTION dbl %s.double_up();
CREATE DICTIONARY d COLUMN word VALUES 'a', 'b';
JOB "count words" REDUCERS 5;
  MAP { data = LOAD "$IN" USING TEXT("schema": "STRING word"); // one word a line
        with_count = FROM data GENERATE word, 1L AS count; }
  SHUFFLE with_count PARTITIONED ON word AGGREGATES SUM(count) AS count;
  REDUCE { counted = GROUP with_count BY word AGGREGATES SUM(count) AS count; }
  STORE counted INTO "$OUT/counts" USING TEXT();
END
JOB "read again"
  MAP { c = LOAD "$OUT/counts" USING TEXT("schema": "STRING word, LONG n");
        t = TOP 2 FROM c GROUP BY word ORDER BY n;
        f = FILTER t BY n > 1 AND word MATCHES '[a-z]+';
        g = FROM f GENERATE word, dbl(n) AS twice, n; }
  STORE g INTO "$OUT/twice" USING PARQUET();
END
onCompletion { MKDIR "$OUT/made"; RM "$OUT/none"; MV "$OUT/made" "$OUT/moved"; }
""" % __name__.split(".")[-1]


def double_up(x):
    return x * 2


def test_program_over_files(spark, tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(__file__.rsplit("/", 1)[0])
    (tmp_path / "words.txt").write_text("\n".join(["a", "b", "a", "c", "a", "b", "", "x1"]))
    values = {"IN": f"{tmp_path}/words.txt", "OUT": f"{tmp_path}/out"}
    p = parse(substitute(COUNT, values))
    assert [j.name for j in p.jobs] == ["count words", "read again"] and p.jobs[0].reducers == 5
    run_script(spark, COUNT, values, parallel=2)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/twice").collect())
    assert got == [("a", 6, 3), ("b", 4, 2)]
    assert (tmp_path / "out/moved").is_dir() and not (tmp_path / "out/made").exists()
    run_script(spark, COUNT, values)  # overwrite is set
    with pytest.raises(SchemaError, match="there already"):
        run_script(spark, COUNT.replace("SET overwrite true;", ""), values)
    assert describe(spark, COUNT, values)[1][1] == "STRING word, LONG twice, LONG n"


def test_statements(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k % 3}", [(k, "x"), (k + 1, "y")]) for k in range(9)], parse_schema("INT id, STRING name, BAG b[TUPLE t(INT v, STRING w)]")).write.parquet(f"{tmp_path}/in")
    text = f"""
    CREATE DICTIONARY names COLUMN name VALUES 'n0', 'n1', 'n2';
    JOB "all kinds"
      MAP {{
        a = LOAD "{tmp_path}/in" USING PARQUET();
        e = ENCODE a ON name USING names;
        d = DECODE e ON name USING names UNKNOWNS AS 'none';
        f = FLATTEN d BY b BAG_TUPLE AS (v:LONG, w:STRING);
        s = SORT f ON id, w;
        p = PIVOT IN MEMORY s ON id;
        MULTIPASS {{ x = FILTER p BY w == 'x'; y = FROM x GENERATE id, v; }} {{ z = FROM p GENERATE id, v; q = FILTER z BY v > 8; }};
        g = GATHER y, q;
        t = TEE WITH SPLIT g INTO "{tmp_path}/tee" USING TEXT() GENERATE id, v + 1 AS next IF id == 0;
        r = RANK t AS place GROUP BY id ORDER BY v;
        l = LIMIT r 100;
        u = DUPLICATE l 2 TIMES COUNTER AS c;
        o = DISTINCT u;
        k = NO_OP o;
      }}
      STORE k INTO "{tmp_path}/out" USING PARQUET();
    END""".replace("}};\n        g =", "}}\n        g =").replace("q = FILTER z BY v > 8; };", "q = FILTER z BY v > 8; }")
    run_script(spark, text)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    pairs = [(k, k) for k in range(1, 9)] + [(8, 9)]
    assert got == sorted((i, v, v - i + 1, c) for i, v in pairs for c in (0, 1))
    assert spark.read.text(f"{tmp_path}/tee").collect()[0].value == "0\t1"


def test_joins_and_cubes_in_scripts(spark, tmp_path):
    spark.createDataFrame([(k % 4, k) for k in range(12)], "k int, v int").write.parquet(f"{tmp_path}/f")
    spark.createDataFrame([(k, f"d{k}") for k in range(3)], "k int, name string").write.parquet(f"{tmp_path}/d")
    text = f"""
    JOB "joins" MAP {{ f = LOAD "{tmp_path}/f" USING PARQUET(); d = LOAD-CACHED "{tmp_path}/d" USING PARQUET();
        j = HASH-JOIN LEFT OUTER f BY k, d BY k; m = FROM j GENERATE f___k AS k, d___name AS name, f___v AS v; }}
      CUBE m BY k INNER v AGGREGATES COUNT_DISTINCT(v) AS n, [SUM, MAX](v) AS s GROUPING SETS (k);
      STORE m INTO "{tmp_path}/o" USING PARQUET(); END"""
    run_script(spark, text)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/o").collect()) == [(k, 3, 12 + 3 * k) for k in range(4)]
    bad = text.replace("BY k, d BY k", "BY k, d BY x")
    with pytest.raises(SchemaError, match="line 3: no column x"):
        run_script(spark, bad)


def test_blocks_in_scripts(spark, tmp_path):
    spark.range(400).selectExpr("CAST(id % 40 AS INT) AS k", "id AS v").write.parquet(f"{tmp_path}/f")
    spark.range(40).selectExpr("CAST(id AS INT) AS k", "id * 10 AS w").write.parquet(f"{tmp_path}/d")
    t = str(tmp_path)
    text = f"""
    JOB "fact" REDUCERS 3; MAP {{ f = LOAD "{t}/f" USING PARQUET(); }} BLOCKGEN f BY ROW 50 PARTITIONED ON k SORTED ON k, v; STORE f INTO "{t}/fb" USING BLOCKS(); END
    JOB "dim" MAP {{ d = LOAD "{t}/d" USING PARQUET(); }} BLOCKGEN d BY INDEX "{t}/fb" PARTITIONED ON k; STORE d INTO "{t}/db" USING BLOCKS(); END
    JOB "join" MAP {{ f = LOAD "{t}/fb" USING BLOCKS(); v = VALIDATE f BY ROW 50 PARTITIONED ON k SORTED ON k, v; d = LOAD BLOCK IN MEMORY FROM "{t}/db" MATCHING v; j = JOIN v BY k, d BY k; }}
      STORE j INTO "{t}/o" USING PARQUET(); END"""
    run_script(spark, text)
    out = spark.read.parquet(f"{t}/o")
    assert out.count() == 400 and out.where("v___k = d___k AND d___w = 10 * v___k").count() == 400
    with pytest.raises(SchemaError, match="passed BLOCKGEN"):
        run_script(spark, f'JOB "x" MAP {{ f = LOAD "{t}/f" USING PARQUET(); }} STORE f INTO "{t}/no" USING BLOCKS(); END')
    assert cli.main(["blocks", f"{t}/fb"]) == 0


def test_dictionary_jobs(spark, tmp_path):
    t = str(tmp_path)
    for name, words in (("one", "ba"), ("two", "acb")):
        spark.createDataFrame([(w,) for w in words], "w string").write.parquet(f"{t}/{name}")
    job = 'JOB "d" MAP {{ a = LOAD "{0}/{1}" USING PARQUET(); }} DICTIONARY a ON w; STORE a INTO "{0}/dict" USING PARQUET("overwrite": "true"); END'
    run_script(spark, job.format(t, "one"))
    run_script(spark, job.format(t, "two"))
    assert sorted((r.colvalue, r.code) for r in spark.read.parquet(f"{t}/dict").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert not [p for p in tmp_path.iterdir() if "refresh" in p.name]


def test_summary_view_in_scripts(spark, tmp_path):
    t = str(tmp_path)
    days = [("a", 1, 20240101), ("a", 2, 20240102), ("b", 1, 20240103), ("a", 1, 20240103)]
    text = 'JOB "v" MAP {{ f = LOAD "{0}/{1}" USING PARQUET(); g = GROUP f BY kind AGGREGATES COUNT_DISTINCT(member) AS n, SUMMARY VIEW=v, SUMMARY PATH="{0}/view", TIME_COLUMNS=[("{0}", day, "yyyyMMdd")]; }} STORE g INTO "{0}/{2}" USING PARQUET(); END'
    spark.createDataFrame(days, "kind string, member int, day int").write.parquet(f"{t}/f1")
    run_script(spark, text.format(t, "f1", "o1"))
    assert sorted(tuple(r) for r in spark.read.parquet(f"{t}/o1").collect()) == [("a", 2), ("b", 1)]
    spark.createDataFrame([*days, ("b", 7, 20240104)], "kind string, member int, day int").write.parquet(f"{t}/f2")
    run_script(spark, text.format(t, "f2", "o2"))
    assert sorted(tuple(r) for r in spark.read.parquet(f"{t}/o2").collect()) == [("a", 2), ("b", 2)]


def test_summary_view_slides(spark):
    facts = spark.sql("SELECT CAST(id % 3 AS INT) AS g, CAST(id % 17 AS INT) AS m, date_add(DATE'2024-01-01', CAST(id % 50 AS INT)) AS day FROM range(900)")
    view = SummaryView.create(facts, ["g"], "m", "day", date(2024, 1, 1), date(2024, 1, 10))
    for start, end in ((date(2024, 1, 4), date(2024, 1, 20)), (date(2024, 1, 13), date(2024, 2, 2)), (date(2024, 2, 5), date(2024, 2, 12))):
        view = view.refresh(facts, start, end)
        want = facts.where(F.col("day").between(F.lit(start), F.lit(end))).groupBy("g").agg(F.countDistinct("m").alias("members"))
        assert sorted(map(tuple, view.counts().collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(SchemaError):
        view.refresh(facts, date(2024, 1, 1), date(2024, 2, 13))
    with pytest.raises(SchemaError):
        SummaryView.create(facts, ["g"], "m", "day", date(2024, 1, 1), date(2024, 2, 1))


def test_views_follow_streams(spark, tmp_path):
    facts = spark.sql("SELECT CAST(id % 3 AS INT) AS g, CAST(id % 17 AS INT) AS m, CAST(date_add(DATE'2024-01-01', CAST(id % 20 AS INT)) AS DATE) AS day FROM range(300)")
    facts.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(facts.schema).parquet(f"{tmp_path}/in")
    views.follow(stream, ["g"], "m", "day", date(2024, 1, 1), f"{tmp_path}/view", f"{tmp_path}/check").awaitTermination(120)
    want = SummaryView.create(facts, ["g"], "m", "day", date(2024, 1, 1), date(2024, 1, 31)).table
    assert sorted(map(tuple, views.bitmaps(spark, f"{tmp_path}/view", ["g"], "m").collect())) == sorted(map(tuple, want.collect()))


def test_job_order():
    jobs = lambda **x: {n: (set(i.split()), set(o.split())) for n, (i, o) in x.items()}
    assert levels(jobs(a=("", "x"), b=("x", "y"), c=("y", ""))) == [["a"], ["b"], ["c"]]
    assert levels(jobs(a=("", "x"), b=("x", "y"), c=("x", "z"), d=("y z", "w"))) == [["a"], ["b", "c"], ["d"]]
    assert levels(jobs(a=("", "x"), b=("", "y"))) == [["a", "b"]]
    for bad in (jobs(a=("y", "x"), b=("x", "y")), jobs(s=("", "w"), a=("w y", "x"), b=("x", "y")), jobs(a=("x", "x")), jobs(a=("", "x"), b=("", "x"))):
        with pytest.raises(SchemaError):
            levels(bad)


def test_paths(spark, tmp_path):
    for name in ("v1/a", "v2/a", "v10/a", "daily/2024/01/01", "daily/2024/01/03", "hourly/2024/01/02/05", "hourly/2024/01/02/07"):
        (tmp_path / name).mkdir(parents=True)
    t = str(tmp_path)
    assert paths.resolve(spark, f"{t}/v#LATEST/a").endswith("/v2/a")
    short = lambda found: [p.removeprefix(t) for p in found]
    assert short(paths.dated(spark, t, 20240101, 20240103)) == ["/daily/2024/01/03", "/daily/2024/01/01"]
    assert short(paths.dated(spark, t, 20240102, 20240103, hourly_for_missing_daily=True)) == ["/daily/2024/01/03", "/hourly/2024/01/02/07", "/hourly/2024/01/02/05"]
    assert short(paths.dated(spark, t, 2024010205, 2024010206)) == ["/hourly/2024/01/02/05"]
    for args in ((20240102, 20240102), (20240103, 20240101), (20240101, 2024010205)):
        with pytest.raises(SchemaError):
            paths.dated(spark, t, *args)
    with pytest.raises(SchemaError):
        paths.dated(spark, t, 20240101, 20240103, error_on_missing=True)
    with pytest.raises(SchemaError):
        paths.resolve(spark, f"{t}/none#LATEST")


def test_formats(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1|a||x\n|b|2.5\n3\nbad|c|1|y|extra\n")
    df = storage("TEXT").read(spark, [f"{tmp_path}/t.txt"], {"schema": "INT a, STRING b, DOUBLE c, BOOLEAN d", "separator": "\\|"})
    assert [tuple(r) for r in df.collect()] == [(1, "a", None, None), (None, "b", 2.5, None), (3, None, None, None), (None, "c", 1.0, None)]
    storage("TEXT").write(df, f"{tmp_path}/out", {"separator": ","}, False)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == [",b,2.5,", ",c,1.0,", "1,a,,", "3,,,"]
    assert storage("VIRTUAL").read(spark, [], {"mappers": "3"}).rdd.getNumPartitions() == 3
    with pytest.raises(SchemaError):
        storage("TEXT").read(spark, ["x"], {})
    with pytest.raises(SchemaError):
        storage("NOPE")
    with pytest.raises(SchemaError, match="Avro"):
        storage("AVRO").read(spark, [f"{tmp_path}/t.txt"], {})
    own = Storage(lambda s, p, k: s.range(int(k["n"])).toDF("id"), lambda d, p, k, o: None)
    r = Registry()
    r.storages["mine"] = own
    r.operator("halve", lambda d, k: d.where(F.col("id") % 2 == 0))
    r.shuffle("spread", lambda d, k: d.repartition(int(k["n"])))
    job = parse('JOB "x" MAP { a = LOAD "p" USING mine("n": "10"); b = halve a {}; } spread b {"n": "4"}; STORE b INTO "o" USING mine(); END').jobs[0]
    out = Compiler(spark, r).compile_job(job).df
    assert out.count() == 5 and out.rdd.getNumPartitions() == 4


@pytest.mark.parametrize(
    "text",
    [
        "JOB", 'JOB "x" STORE a INTO "b" USING TEXT(); END', 'JOB "x" MAP { a = LOAD "p" USING TEXT(); } STORE a INTO "b" USING TEXT();',
        'JOB "x" MAP { a = LOAD "p" USING TEXT(); b = NOPE; } STORE a INTO "b" USING TEXT(); END', "SET a;", 'JOB "x" MAP { a = LOAD "p" USING TEXT(); MULTIPASS { b = NO_OP a; } } STORE a INTO "b" USING TEXT(); END',
    ],
)
def test_bad_programs(text):
    with pytest.raises(ScriptError):
        parse(text)


def test_values():
    assert substitute("$ab $a ${a} $0", {"a": 1, "ab": 2}) == "2 1 1 $0"
    with pytest.raises(ScriptError, match="no value for \\$b"):
        substitute("$b", {"a": 1})
    assert parser.tokenize("a /* x\n */ b // c\n d")[-1].line == 3


def test_command_line(tmp_path, capsys):
    f = tmp_path / "s.bm"
    f.write_text('JOB "x" MAP { a = LOAD "$p" USING TEXT("schema": "INT a"); } STORE a INTO "o" USING TEXT(); END')
    assert cli.main(["parse", str(f), "-D", "p=in"]) == 0
    assert '"paths": [\n' in capsys.readouterr().out
    (tmp_path / "v").write_text("param.p = in\n")
    args = type("A", (), {"files": [str(tmp_path / "v")], "define": ["p=out"]})
    assert cli.values(args) == {"p": "out"}
    assert Call("f", ()).args == ()
