"""Programs to DataFrames: every relation of a job is a lazy DataFrame, and a STORE is the action."""

from __future__ import annotations

import logging
import os
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import compile_expression
from ..functions.registry import Registry, load
from ..operators import aggregates as agg
from ..operators import blocks, cube, dictionary, joins, rows, window
from ..scratch import scope, shared_dir
from ..sources import paths
from ..sources.storage import storage
from ..types import SchemaError, show_schema, type_of
from . import hooks
from .jobs import levels
from .parser import Job, Op, Program, ScriptError, parse
from .summary import SummaryView

log = logging.getLogger(__name__)
#: Settings that are the engine's own; others are the session's while the job runs.
OWN_SETTINGS = ("overwrite",)
TEMP = "BLOCKMILL_TEMP"


@dataclass
class Relation:
    """Rows and how they lie: the keys that they are dealt by, sorted by and grouped by, and their blocks."""

    df: DataFrame
    partition: list[str] = field(default_factory=list)
    sort: list[str] = field(default_factory=list)
    pivot: list[str] = field(default_factory=list)
    blocks: dict[str, Any] | None = None

    def over(self, df: DataFrame, keep: bool = True) -> Relation:
        if not keep:
            return Relation(df)

        def there(keys: list[str]) -> list[str]:  # up to the first that is gone
            n = next((k for k, c in enumerate(keys) if c not in df.columns), len(keys))
            return keys[:n]

        return Relation(df, self.partition if there(self.partition) == self.partition else [], there(self.sort), there(self.pivot), self.blocks if blocks.BLOCK in df.columns else None)


def substitute(text: str, values: dict[str, Any]) -> str:
    """$names by their values, longest names first; an unknown $name of letters is an error."""
    names = sorted(values, key=len, reverse=True)
    if names:
        text = re.sub(r"\$\{?(" + "|".join(map(re.escape, names)) + r")\}?", lambda m: str(values[m[1]]), text)
    if left := re.search(r"\$\{?[A-Za-z_]\w*", text):
        raise ScriptError(f"no value for {left[0]}")
    return text


class Compiler:
    """dry: nothing is written, checked or held; relations have their schemas only."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None, strict: bool = False, dry: bool = False):
        self.spark, self.registry, self.strict, self.dry = spark, registry or Registry(), strict, dry
        self.dictionaries: dict[str, DataFrame] = {}
        self.passing: list[str] = []  # files between a job's steps
        self.actions: list[Callable[[], None]] = []  # what a job does besides its STORE: TEE, VALIDATE
        self.held: list[DataFrame] = []  # in memory until the job's end

    # --- programs ---

    def run(self, program: Program, parallel: int = 1, only: str | None = None) -> None:
        """Runs the jobs, each after those whose output it reads, then the tasks on completion."""
        self.prepare(program)
        jobs = {f"{k}: {j.name}": j for k, j in enumerate(program.jobs)}
        if only is not None:
            jobs = {n: j for n, j in jobs.items() if j.name == only or n.startswith(f"{only}:")}
            if not jobs:
                raise ScriptError(f"no job {only}")
        for level in levels({n: (_inputs(j), _outputs(j)) for n, j in jobs.items()}):
            if parallel > 1 and len(level) > 1:
                with ThreadPoolExecutor(parallel) as pool:
                    list(pool.map(lambda n: self.run_job(jobs[n], program.settings), level))
            else:
                for n in level:
                    self.run_job(jobs[n], program.settings)
        for task, where in program.completion:
            self.complete(task, where)

    def prepare(self, program: Program) -> None:
        for path in program.registers:
            if path.endswith((".py", ".zip", ".egg")):
                self.spark.sparkContext.addPyFile(path)
            else:
                log.warning("REGISTER %s: only Python files are loaded", path)
        for alias, uri, args in program.functions:
            self.registry.declare(alias, uri, args)
        for name, columns in program.dictionaries.items():
            self.dictionaries[name] = dictionary.inline(self.spark, columns)

    def complete(self, task: str, where: list[str]) -> None:
        """Failures of chores are logged only."""
        try:
            if task == "RM":
                for p in where:
                    paths.remove(self.spark, p)
            elif task == "MV":
                paths.move(self.spark, where[0], where[1])
            elif task == "MKDIR":
                for p in where:
                    paths.make(self.spark, p)
            elif task == "DUMP":
                self.spark.read.load(where[0]).show()
            else:
                load(task)(self.spark, *where)
        except Exception as e:
            log.warning("%s %s: %s", task, " ".join(where), e)

    def run_job(self, job: Job, settings: dict[str, Any] | None = None) -> None:
        """Runs a job in a session of its own, with the program's settings and then the job's."""
        settings = {**(settings or {}), **job.settings}
        one = Compiler(self.with_settings(settings), self.registry, self.strict)
        one.dictionaries = self.dictionaries
        with scope():
            try:
                hooks.run(one.spark, job.before)
                one.store(job, settings)
                hooks.run(one.spark, job.after)
            finally:
                for df in one.held:
                    df.unpersist()
                for path in one.passing:
                    paths.remove(one.spark, path)

    def with_settings(self, settings: dict[str, Any]) -> SparkSession:
        """The session with SET's keys, but for the engine's own: Spark's, and others, which readers and writers get as Hadoop's."""
        others = {k: v for k, v in settings.items() if k not in OWN_SETTINGS}
        if not others:
            return self.spark
        session = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        for k, v in others.items():
            try:
                session.conf.set(k, str(v).lower() if isinstance(v, bool) else str(v))
            except Exception as e:
                raise SchemaError(f"SET {k}: {str(e).splitlines()[0]}") from e
        return session

    def store(self, job: Job, settings: dict[str, Any]) -> None:
        relation = self.compile_job(job)
        s = job.store
        overwrite = str(s.params.get("overwrite", settings.get("overwrite", "false"))).lower() == "true"
        params = dict(s.params)
        if relation.blocks:
            params = {"partition_keys": ",".join(relation.blocks["keys"]), "sort_keys": ",".join(relation.blocks["order"]), "buckets": str(relation.blocks["buckets"]), "blockgen_id": relation.blocks["id"], **params}
        elif s.format.upper() == "BLOCKS":
            raise SchemaError(f"job {job.name}: only relations that passed BLOCKGEN can be stored as blocks")
        if not overwrite and paths.exists(self.spark, s.path):
            raise SchemaError(f"job {job.name}: {s.path} is there already; SET overwrite true")
        for act in self.actions:
            act()
        storage(s.format, self.registry.storages).write(relation.df, s.path, params, overwrite)

    # --- jobs ---

    def compile_job(self, job: Job) -> Relation:
        if job.reducers == 0 and (job.shuffle or job.reduce):
            raise SchemaError(f"job {job.name}: no reducers, but a shuffle")
        target = job.shuffle.inputs[0] if job.shuffle else job.store.relation
        ends: list[Relation] = []
        for source, ops in job.maps:
            env = {source.out: self.load(source)}
            self.statements(ops, env)
            if job.shuffle and job.shuffle.kind == "REDUCE_JOIN":
                name = target if target in env else (ops[-1].out if ops else source.out)
            else:
                name = target
            if name not in env:
                raise SchemaError(f"job {job.name}: a MAP lacks {name}")
            ends.append(env[name])
        if job.shuffle and job.shuffle.kind == "REDUCE_JOIN":
            if len(ends) != 2:
                raise SchemaError(f"job {job.name}: a JOIN shuffle needs two MAPs")
            out = self.reduce_join(job.shuffle, ends[0], ends[1])
        else:
            one = ends[0] if len(ends) == 1 else Relation(rows.union([e.df for e in ends]))
            out = self.shuffle(job.shuffle, one, job) if job.shuffle else one
        env = {target: out}
        self.statements(job.reduce, env)
        if job.store.relation not in env:
            raise SchemaError(f"job {job.name}: no relation {job.store.relation} to store")
        return env[job.store.relation]

    def load(self, source) -> Relation:
        found: list[str] = []
        for p in source.paths:
            if isinstance(p, tuple):
                flags = {k: str(source.params.get(k, "false")).lower() == "true" for k in ("errorOnMissing", "useHourlyForMissingDaily")}
                found += paths.dated(self.spark, *p, flags["errorOnMissing"], flags["useHourlyForMissingDaily"])
            else:
                found.append(paths.resolve(self.spark, p))
        params = {k: v for k, v in source.params.items() if k not in ("errorOnMissing", "useHourlyForMissingDaily")}
        df = storage(source.format, self.registry.storages).read(self.spark, found, params)
        if blocks.BLOCK in df.columns:
            m = blocks.meta(self.spark, found[0])
            return Relation(df, m.partition_keys, m.sort_keys, blocks={"keys": m.partition_keys, "order": m.sort_keys, "buckets": m.buckets, "id": m.blockgen_id, "path": found[0]})
        return Relation(df)

    # --- shuffles ---

    def reduce_join(self, op: Op, fact: Relation, dimension: Relation) -> Relation:
        df = joins.reduce_join(fact.df, dimension.df, op.args["keys"], op.args["kind"])
        return Relation(df, op.args.get("partition") or op.args["keys"], op.args["keys"])

    def shuffle(self, op: Op, r: Relation, job: Job) -> Relation:
        a, df = op.args, r.df
        if op.kind == "SHUFFLE":
            sort = a["sort"] or a["partition"]
            rows.need(df, [*a["partition"], *sort])
            if a["aggregates"]:  # a combiner: folds rows of equal keys, which the reducer folds again
                made = [self.aggregate(x) for x in a["aggregates"]]
                keys = [c for c in df.columns if c not in {x.output for x in made}]
                combined = agg.group(df, keys, made, self.strict)
                if [c for c in combined.columns if c not in df.columns] or set(df.columns) - set(combined.columns):
                    raise SchemaError("a combiner's columns must be those of its input")
                df = combined.select(*df.columns)
            dealt = df.repartition(job.reducers, *a["partition"]) if job.reducers else df.repartition(*a["partition"])
            return Relation(rows.sort(dealt, sort), a["partition"], sort, a["partition"])
        if op.kind == "DISTINCT":
            return Relation(rows.distinct(df), df.columns, df.columns)
        if op.kind == "BLOCKGEN":
            buckets = job.reducers or blocks.buckets_for(df)
            if a["by"] == "INDEX":
                index = paths.resolve(self.spark, a["value"])
                m = blocks.meta(self.spark, index)
                df = blocks.blockgen_by_index(df.distinct() if a["distinct"] else df, blocks.index(self.spark, index), a["partition"], a["sort"], m.buckets)
                buckets, ident = m.buckets, m.blockgen_id
            else:
                df, ident = blocks.blockgen(df, a["by"], a["value"] or 0, a["partition"], a["sort"], buckets, a["distinct"]), uuid.uuid4().hex
            order = a["sort"] or a["partition"]
            return Relation(df, a["partition"], order, blocks={"keys": a["partition"], "order": order, "buckets": buckets, "id": ident})
        if op.kind == "CUBE":
            return self.cube(op, r)
        if op.kind == "DICTIONARY":
            path = job.store.path
            if paths.exists(self.spark, path):  # codes that are there stay
                old = storage(job.store.format, self.registry.storages).read(self.spark, [path], dict(job.store.params))
                kept = dictionary.refresh(df, a["columns"], old.selectExpr("colname", "colvalue", "CAST(code AS INT) AS code"))
                if self.dry:
                    return Relation(kept)
                held = f"{path}.refresh-{uuid.uuid4().hex[:8]}"  # the old codes are read while they are written over
                kept.write.parquet(held)
                self.passing.append(held)
                return Relation(self.spark.read.parquet(held))
            return Relation(dictionary.build(df, a["columns"]))
        if op.kind == "USER_SHUFFLE":
            f = self.registry.shuffles.get(a["uri"]) or load(a["uri"])
            return Relation(f(df, a["params"]))
        raise ScriptError(f"line {op.line}: no shuffle {op.kind}")

    # --- statements ---

    def statements(self, ops: list[Op], env: dict[str, Relation]) -> None:
        for op in ops:
            try:
                if op.kind == "MULTIPASS":
                    ends: dict[str, Relation] = {}
                    for one in op.args["passes"]:
                        inner = dict(env)
                        self.statements(one, inner)
                        ends |= {o.out: inner[o.out] for o in one}
                    env |= ends
                    continue
                missing = [i for i in op.inputs if i not in env]
                if missing:
                    raise SchemaError(f"no relation {', '.join(missing)}")
                env[op.out] = self.operator(op, [env[i] for i in op.inputs])
            except SchemaError as e:
                raise type(e)(f"line {op.line}: {e}") if not str(e).startswith("line ") else e from e

    def aggregate(self, x: tuple[str, list[str], str | None]) -> agg.Aggregate:
        function, columns, name = x
        if function.startswith("["):
            return agg.Aggregate(function, tuple(columns), name)
        if function in self.registry.aggregates or "." in function:
            f = self.registry.aggregates.get(function) or load(function)
            return agg.Aggregate("USER", tuple(columns), name or f"{function.rpartition('.')[2]}___{'_'.join(columns)}", user=f)
        return agg.Aggregate(function.upper(), tuple(columns), name)

    def cube(self, op: Op, r: Relation) -> Relation:
        a = op.args
        sets = a["sets"] or (cube.combos(a["dims"], a["combos"]) if a["combos"] is not None else cube.rollups(a["rollups"]) if a["rollups"] else None)
        return Relation(cube.cube(r.df, a["dims"], [self.aggregate(x) for x in a["aggregates"]], sets, a["inner"]))

    def operator(self, op: Op, inputs: list[Relation]) -> Relation:
        a, r = op.args, inputs[0] if inputs else None
        df = r.df if r else None
        kind = op.kind
        if kind == "NO_OP":
            if "partition" in a and (r.partition != a["partition"] or r.sort[: len(a["sort"])] != a["sort"]):
                raise SchemaError(f"{op.inputs[0]} isn't partitioned on {', '.join(a['partition'])} and sorted on {', '.join(a['sort'])}")
            return r
        if kind == "GENERATE":
            made = [(n, compile_expression(e, df, self.registry).column) for n, e in a["columns"]]
            out = rows.generate(df, *made)
            renamed = {e.path[0]: n for n, e in a["columns"] if getattr(e, "path", None) and len(e.path) == 1 and e.key is None}
            follow = lambda keys: [renamed[k] for k in keys[: next((i for i, k in enumerate(keys) if k not in renamed), len(keys))]]
            whole = follow(r.partition)
            return Relation(out, whole if len(whole) == len(r.partition) else [], follow(r.sort), follow(r.pivot))
        if kind == "FILTER":
            return r.over(rows.keep(df, compile_expression(a["predicate"], df, self.registry).column))
        if kind == "LIMIT":
            return r.over(rows.limit(df, a["n"]))
        if kind == "DUPLICATE":
            return r.over(rows.duplicate(df, a["n"], a["counter"]))
        if kind == "FLATTEN":
            return r.over(rows.flatten(df, [(c, k, [(n, type_of(t)) for n, t in fields]) for c, k, fields in a["items"]]))
        if kind == "DISTINCT":
            return r.over(rows.distinct(df))
        if kind == "SORT":
            return Relation(rows.sort(df, a["sort"]), r.partition, a["sort"], r.pivot, r.blocks)
        if kind == "COMBINE":
            return Relation(rows.combine([i.df for i in inputs], a["sort"]), sort=a["sort"])
        if kind == "GATHER":
            return Relation(rows.gather([i.df for i in inputs]))
        if kind == "PIVOT":
            if "rows" in a:
                return Relation(rows.pivot_by_row(df, a["rows"], r.sort or df.columns))
            return Relation(self.hold(df) if a["memory"] else df, r.partition, r.sort, a.get("keys", r.pivot), r.blocks)
        if kind == "TEE":
            made = [(n, compile_expression(e, df, self.registry).column) for n, e in a["columns"]] if a["columns"] else None
            predicate = compile_expression(a["predicate"], df, self.registry).column if a["predicate"] is not None else None
            write = lambda d: self.actions.append(lambda: storage(a["format"], self.registry.storages).write(d, a["path"], a["params"], True))
            return r.over(rows.tee(df, write, made, predicate, a["split"]))
        if kind in ("ENCODE", "DECODE"):
            d = self.dictionaries[a["dictionary"]] if a.get("dictionary") in self.dictionaries else None
            if d is None:
                if "path" not in a:
                    raise SchemaError(f"no dictionary {a['dictionary']}")
                d = _dictionary(self.spark, paths.resolve(self.spark, a["path"]))
            if kind == "DECODE":
                return r.over(dictionary.decode(df, a["columns"], d, a.get("unknowns")))
            nulls = a.get("nulls")
            return r.over(dictionary.encode(df, a["columns"], d, int(nulls) if nulls is not None and str(nulls).lstrip("-").isdigit() else 0 if nulls is not None else None, a.get("unknowns")))
        if kind == "GROUP":
            if "summary" in a:
                return self.summary(op, r)
            return Relation(agg.group(df, a["by"], [self.aggregate(x) for x in a["aggregates"]], self.strict), [k for k in r.partition if k in a["by"]], a["by"])
        if kind == "CUBE":
            return self.cube(op, r)
        if kind in ("JOIN", "HASHJOIN"):
            left, right = inputs
            if kind == "JOIN" and left.blocks and right.blocks and left.blocks["id"] != right.blocks["id"]:
                raise SchemaError("the blocks of the two sides aren't of one layout")
            matched = kind == "JOIN" and left.blocks and right.blocks
            f = blocks.matched_join if matched else joins.merge_join if kind == "JOIN" else joins.hash_join
            out = f(left.df, op.inputs[0], a["left"], right.df, op.inputs[1], a["right"], a["kind"])
            name = lambda keys: [f"{op.inputs[0]}___{k}" for k in keys]
            return Relation(out, name(left.partition), name(left.sort))
        if kind == "LOAD_CACHED":
            # Spark sends it to every task where its size is below the threshold
            return Relation(storage(a["format"], self.registry.storages).read(self.spark, [paths.resolve(self.spark, a["path"])], a["params"]))
        if kind == "LOAD_BLOCK":
            if not r.blocks:
                raise SchemaError(f"{op.inputs[0]} has no blocks to match")
            path = paths.resolve(self.spark, a["path"])
            m = blocks.meta(self.spark, path)
            out = blocks.load_matching(self.spark, path, df)
            return Relation(self.hold(out) if a["memory"] else out, m.partition_keys, m.sort_keys, blocks={"keys": m.partition_keys, "order": m.sort_keys, "buckets": m.buckets, "id": m.blockgen_id})
        if kind == "VALIDATE":
            if blocks.BLOCK not in df.columns:
                raise SchemaError(f"{op.inputs[0]} has no blocks")
            buckets = r.blocks["buckets"] if r.blocks else 8
            found = blocks.validate(df, a["partition"], a["sort"], buckets, a["by"] if a["by"] in ("ROW", "PARTITION_KEY") else None, a["value"] if isinstance(a["value"], int) else 0).where("violations > 0")

            def check() -> None:
                if wrong := found.collect():
                    raise SchemaError("; ".join(f"{x.check}: {x.violations}" for x in wrong))

            self.actions.append(check)
            return r
        if kind == "TOP":
            return r.over(window.top(df, a["group"], a["order"], a["n"]))
        if kind == "RANK":
            return r.over(window.rank(df, a["name"], a["group"], a["order"] or r.sort))
        if kind == "USER":
            f = self.registry.operators.get(a["uri"]) or load(a["uri"])
            for path in getattr(f, "cached_files", ()):  # workers find them by SparkFiles
                self.spark.sparkContext.addFile(path)
            return Relation(f(*(i.df for i in inputs), a["params"]))
        raise ScriptError(f"no operator {kind}")

    def hold(self, df: DataFrame) -> DataFrame:
        if self.dry:
            return df
        self.held.append(df.cache())
        return self.held[-1]

    def summary(self, op: Op, r: Relation) -> Relation:
        """GROUP … AGGREGATES COUNT_DISTINCT(member) kept as a view below the summary path, refreshed by the days that are new."""
        a = op.args
        (function, columns, name), *more = a["aggregates"]
        if more or function.upper() != "COUNT_DISTINCT":
            raise SchemaError("a summary view keeps one COUNT_DISTINCT")
        day = a["summary"]["time"][0][1].rpartition(".")[2]
        df = r.df.withColumn("_day", F.coalesce(F.try_to_date(F.col(day).cast("string"), "yyyyMMdd"), F.try_to_date(F.substring(F.col(day).cast("string"), 1, 10), "yyyy-MM-dd")))
        if self.dry:
            return Relation(agg.group(df, a["by"], [self.aggregate(x) for x in a["aggregates"]]), sort=a["by"])
        span = df.agg(F.min("_day").alias("a"), F.max("_day").alias("b")).first()
        root = a["summary"]["path"]
        if span.a is None:
            return Relation(agg.group(df, a["by"], [self.aggregate(x) for x in a["aggregates"]]))
        facts = hooks.read(self.spark, f"{root}/_view.meta")
        if facts:
            old = SummaryView(tuple(a["by"]), columns[0], "_day", date.fromisoformat(facts["horizon"]), date.fromisoformat(facts["refreshed"]), self.spark.read.parquet(f"{root}/{facts['table']}"))
            view = old.refresh(df, max(span.a, old.horizon), max(span.b, old.refreshed))
        else:
            view = SummaryView.create(df, a["by"], columns[0], "_day", span.a, span.b)
        at = f"view-{datetime.now():%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"
        view.table.write.parquet(f"{root}/{at}")  # beside the old one, which it reads
        hooks.write(self.spark, f"{root}/_view.meta", {"horizon": view.horizon, "refreshed": view.refreshed, "table": at})
        stored = SummaryView(view.dims, view.member, view.day, view.horizon, view.refreshed, self.spark.read.parquet(f"{root}/{at}"))
        return Relation(stored.counts(name=name or f"COUNT_DISTINCT___{columns[0]}"), sort=a["by"])


def _dictionary(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path) if paths.is_parquet(spark, path) else storage("TEXT").read(spark, [path], {"schema": "STRING colname, STRING colvalue, INT code"})
    return df.selectExpr("colname", "colvalue", "CAST(code AS INT) AS code")


def _every(ops: list[Op]) -> list[Op]:
    return [x for o in ops for x in ([y for one in o.args["passes"] for y in _every(one)] if o.kind == "MULTIPASS" else [o])]


def _outputs(job: Job) -> set[str]:
    """What a job writes: its STORE, and what its TEEs and summary views keep."""
    ops = _every([o for _, one in job.maps for o in one] + job.reduce)
    tees = {o.args["path"] for o in ops if o.kind == "TEE"}
    return {job.store.path, *tees, *(o.args["summary"]["path"] for o in ops if o.kind == "GROUP" and "summary" in o.args)}


def _inputs(job: Job) -> set[str]:
    out = {p[0] if isinstance(p, tuple) else p for load_, _ in job.maps for p in load_.paths}
    ops = _every([o for _, one in job.maps for o in one] + job.reduce) + ([job.shuffle] if job.shuffle else [])
    for o in ops:
        if o.kind in ("LOAD_CACHED", "LOAD_BLOCK", "ENCODE", "DECODE") and "path" in o.args:
            out.add(o.args["path"])
        if o.kind == "BLOCKGEN" and isinstance(o.args["value"], str):
            out.add(o.args["value"])
    return out


def run_script(spark: SparkSession, text: str, values: dict[str, Any] | None = None, registry: Registry | None = None, parallel: int = 1, only: str | None = None) -> None:
    """Runs a script's text with $names by values, then by the environment. $BLOCKMILL_TEMP is a folder that goes at the end."""
    names = {m[1] for m in re.finditer(r"\$\{?([A-Za-z_]\w*)", text)}
    known = {**{k: v for k, v in os.environ.items() if k in names}, **(values or {})}
    temporary = f"{shared_dir(spark)}/temp-{uuid.uuid4().hex}" if TEMP in names and TEMP not in known else None
    if temporary:
        known[TEMP] = temporary
    try:
        Compiler(spark, registry).run(parse(substitute(text, known)), parallel, only)
    finally:
        if temporary:
            paths.remove(spark, temporary)


def describe(spark: SparkSession, text: str, values: dict[str, Any] | None = None, registry: Registry | None = None) -> list[tuple[str, str]]:
    """(job, schema of what it stores), without storing, holding or checking anything."""
    known = {TEMP: f"{shared_dir(spark)}/temp", **(values or {})}
    program = parse(substitute(text, known))
    c = Compiler(spark, registry, dry=True)
    c.prepare(program)
    with scope(dry=True):
        return [(j.name, show_schema(c.compile_job(j).df.schema)) for j in program.jobs]


def explain(spark: SparkSession, text: str, values: dict[str, Any] | None = None) -> list[tuple[str, list[str], list[str], str]]:
    """(job, what it reads, what it writes, its plan as Spark sees it before it runs); nothing is stored."""
    program = parse(substitute(text, {TEMP: f"{shared_dir(spark)}/temp", **(values or {})}))
    c = Compiler(spark, dry=True)
    c.prepare(program)
    with scope(dry=True):
        return [(j.name, sorted(_inputs(j)), sorted(_outputs(j)), c.compile_job(j).df._jdf.queryExecution().simpleString()) for j in program.jobs]
