"""Command line: runs scripts, and looks into block stores.

    python -m blockmill.cli run script.bm -D day=20240101 -f values.properties -x "job name" --parallel 5
    python -m blockmill.cli parse script.bm          (the tree)
    python -m blockmill.cli compile script.bm        (schemas of what jobs store; writes nothing)
    python -m blockmill.cli describe script.bm       (what jobs read and write, and their plans; writes nothing)
    python -m blockmill.cli blocks path [-d [-f TEXT]] [-e BLOCK] [-o OUT]
"""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import asdict

from .operators import blocks
from .plans.compiler import describe, explain, run_script, substitute
from .plans.parser import parse
from .session import session
from .sources.storage import storage


def values(args) -> dict[str, str]:
    out: dict[str, str] = {}
    for name in args.files or []:
        with open(name) as f:
            for line in f:
                if "=" in line and not line.lstrip().startswith("#"):
                    k, _, v = line.partition("=")
                    out[k.strip().removeprefix("param.")] = v.strip()
    for pair in args.define or []:
        k, _, v = pair.partition("=")
        out[k] = v
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="blockmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "parse", "compile", "describe"):
        s = sub.add_parser(name)
        s.add_argument("script")
        s.add_argument("-D", dest="define", action="append", help="name=value")
        s.add_argument("-f", dest="files", action="append", help="file of name=value lines")
        s.add_argument("-x", dest="only", help="run this job only")
        s.add_argument("--parallel", type=int, default=1, help="jobs at a time")
        s.add_argument("--debug", action="store_true", help="print what jobs read, write and plan before they run")
        s.add_argument("--perf", action="store_true", help="print the seconds taken")
    b = sub.add_parser("blocks")
    b.add_argument("path")
    b.add_argument("-d", dest="dump", action="store_true", help="print rows")
    b.add_argument("-f", dest="format", default="TEXT")
    b.add_argument("-e", dest="block", type=int, help="this block only")
    b.add_argument("-o", dest="out", help="write the rows there")
    args = p.parse_args(argv)
    if args.command == "blocks":
        spark = session()
        rows = blocks.extract(spark, args.path, args.block) if args.block is not None else blocks.load(spark, args.path)
        if args.out:
            storage(args.format).write(rows.drop(blocks.BLOCK), args.out, {}, False)
        elif args.dump:
            for r in rows.toLocalIterator():
                print("\t".join("" if v is None else str(v) for v in r))
        else:
            print(json.dumps(asdict(blocks.meta(spark, args.path)), indent=1))
            blocks.index(spark, args.path).orderBy(blocks.BLOCK).show(1000, False)
        return 0
    with open(args.script) as f:
        text = f.read()
    known = values(args)
    if args.command == "parse":
        program = parse(substitute(text, known) if known else text)
        print(json.dumps(asdict(program), indent=1, default=str))
        return 0
    spark = session()
    if args.command == "compile":
        for name, schema in describe(spark, text, known):
            print(f"{name}: {schema}")
        return 0
    if args.command == "describe" or args.debug:
        for name, reads, writes, plan in explain(spark, text, known):
            print(f"{name}\n  reads {', '.join(reads)}\n  writes {', '.join(writes)}\n{plan}")
    if args.command == "describe":
        return 0
    began = time.time()
    run_script(spark, text, known, parallel=args.parallel, only=args.only)
    if args.perf:
        print(f"{time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
