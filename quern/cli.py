"""Command line: run, prob, explain, watch and repl.  Exit codes: 0 done, 1 the program failed, 2 bad usage."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from . import diagnostics, prob
from .engine import Engine, Options
from .errors import QuernError
from .lang.ast import Modal
from .lang.parser import parse
from .sources.files import read_relation, write_relation


def _session() -> SparkSession:
    return SparkSession.builder.appName("quern").getOrCreate()


def _inputs(spark: SparkSession, given: list[str]) -> dict:
    out = {}
    for g in given:
        name, eq, path = g.partition("=")
        if not eq:
            raise QuernError(f"--input takes relation=path, not {g}")
        out[name] = read_relation(spark, path)
    return out


def _run(args, spark: SparkSession, out) -> None:
    text = Path(args.program).read_text()
    program = parse(text)
    inputs = _inputs(spark, args.input)
    options = Options(strict=args.strict, magic_sets=args.magic_sets)
    if any(isinstance(x, Modal) for r in program.rules for x in r.body) or any(isinstance(x, Modal) for c in program.constraints for x in c):
        from . import epistemic

        result = epistemic.run(spark, program, inputs, options=options)
    else:
        result = Engine(spark, options).run(program, inputs, modules=str(Path(args.program).parent))
    for i, (q, df) in enumerate(zip(program.queries, result.queries, strict=True)):
        if args.output:
            write_relation(df, f"{args.output}/query_{i}.{args.format}", "overwrite")
        else:
            print(f"?- {q}", file=out)
            rows = 0
            for row in df.toLocalIterator():
                rows += 1
                print("  " + ", ".join(f"{c} = {v}" for c, v in row.asDict().items()) if df.columns != ["u"] else "  true", file=out)
            print(f"rows: {rows}", file=out)


def _prob(args, spark: SparkSession, out) -> None:
    options = {k: v for k, v in (("samples", args.samples), ("seed", args.seed), ("confidence", args.confidence)) if v is not None}
    for a in prob.solve(spark, Path(args.program).read_text(), args.engine, **(options if args.engine == "mc" or options else {})):
        print(f"{a.atom}: {a.probability:.6f}" + (f" [{a.low:.6f}, {a.high:.6f}]" if isinstance(a, prob.Estimate) else ""), file=out)


def _explain(args, spark: SparkSession, out) -> None:
    compiled = Engine(spark, Options(magic_sets=args.magic_sets)).compile(Path(args.program).read_text(), _inputs(spark, args.input), str(Path(args.program).parent))
    print(compiled.explain(), file=out)


def _watch(args, spark: SparkSession, out) -> None:
    seen = None
    for _ in range(args.times) if args.times else iter(int, 1):
        now = Path(args.program).stat().st_mtime_ns
        if now != seen:
            seen = now
            try:
                _run(args, spark, out)
            except QuernError as e:
                print(f"error: {e}", file=out)
        time.sleep(args.every)


def _repl(args, spark: SparkSession, out) -> None:
    """Statements extend the program; a query is answered at once; :quit ends, :explain and :why ATOM tell more."""
    lines: list[str] = []
    for line in sys.stdin:
        line = line.strip()
        if line == ":quit":
            break
        try:
            if line == ":explain":
                print(Engine(spark).compile("\n".join(lines)).explain(), file=out)
            elif line.startswith(":why "):
                print(diagnostics.why("\n".join(lines), line[5:]), file=out)
            elif line.startswith("?-"):
                for row in Engine(spark).run("\n".join([*lines, line])).queries[-1].toLocalIterator():
                    print(tuple(row), file=out)
            elif line:
                parse(line)
                lines.append(line)
        except QuernError as e:
            print(f"error: {e}", file=out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, call in (("run", _run), ("explain", _explain), ("watch", _watch)):
        c = commands.add_parser(name)
        c.add_argument("program")
        c.add_argument("--input", action="append", default=[], metavar="RELATION=PATH")
        c.add_argument("--output")
        c.add_argument("--format", choices=["parquet", "csv", "json", "arrows"], default="csv")
        c.add_argument("--strict", action="store_true")
        c.add_argument("--magic-sets", choices=["on", "off", "auto"])
        c.add_argument("--every", type=float, default=1.0)
        c.add_argument("--times", type=int)
        c.set_defaults(call=call)
    c = commands.add_parser("prob")
    c.add_argument("program")
    c.add_argument("--engine", choices=["exact_ddnnf", "mc"])
    c.add_argument("--samples", type=int)
    c.add_argument("--seed", type=int)
    c.add_argument("--confidence", type=float)
    c.set_defaults(call=_prob)
    commands.add_parser("repl").set_defaults(call=_repl)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        args.call(args, spark or _session(), out or sys.stdout)
    except (QuernError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
