"""Programs over DataFrames: compile and run."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CompileError, ConstraintViolation, QuernError
from .functions.scalar import wrapping
from .functions.types import of_spark
from .lang.ast import Atom, Cmp, Modal, Program, Rule, literal_vars
from .lang.parser import parse
from .lang.passes import check_safety, constraint_name, desugar, expand_functions, link, magic, query_name
from .lang.stratify import Key, key, order, strata, uses
from .plans import fixpoint
from .plans.relation import Relation, arity, empty, given
from .plans.rules import compile_rule, makes_set
from .plans.schema import check_rules, infer
from .sources.facts import facts_frame


@dataclass(frozen=True)
class Options:
    strict: bool = False  # aggregates take u32 and u64 only
    max_rounds: int = fixpoint.MAX_ROUNDS
    magic_sets: str | None = None  # over the program's pragma: off, on, auto
    promote: bool = True  # cyclic bodies by candidates of the shortest list instead of one join after another
    masks: dict[str, bool] = field(default_factory=dict)  # learnable rules: on where true


#: A derived relation that is read more than once is written once its plan has more scans than this, so
#: that chains of rules can't grow plans without bound.
SCANS = 40


@dataclass
class Component:
    predicates: list[Key]
    recursive: bool
    rounds: int = 0


class Compiled:
    """A program after all passes, with the types of its predicates."""

    def __init__(self, program: Program, inputs: dict[str, DataFrame], options: Options = Options()):
        self.source, self.options = program, options
        p = expand_functions(program, int(program.pragmas.get("max_recursion_depth", 1000)))
        mode = options.magic_sets or p.pragmas.get("magic_sets", "off")
        self.magic_from = p
        if mode in ("on", "auto"):
            p = magic(p)
        self.program = p
        self.rules, self.query_vars = desugar(p)
        self.rules = [Rule(r.head, r.body) for r in self.rules if r.mask is None or options.masks.get(r.mask, False)]
        if any(isinstance(x, Modal) for r in self.rules for x in r.body):
            raise CompileError("the program has modal literals: run it with quern.epistemic")
        check_safety(self.rules)
        given_types = {(n, arity(df)): tuple(of_spark(t) for _, t in df.dtypes[: arity(df)]) for n, df in inputs.items()}
        self.types = infer(p, self.rules, given_types)
        check_rules(self.rules, self.types)
        self.order = order(self.rules)
        self.reads = Counter(d for r in self.rules for d, _ in uses(r))
        self.scans: dict[Key, int] = {}

    def strata(self) -> dict[Key, int]:
        return strata(Program(rules=self.rules))

    def explain(self) -> str:
        """The rewritten rules by stratum."""
        level, lines = self.strata(), []
        for part, recursive in self.order:
            lines.append(f"stratum {max(level[k] for k in part)}: {', '.join(f'{n}/{a}' for n, a in part)}{' (recursive)' if recursive else ''}")
            lines += [f"  {r}" for r in self.rules if key(r.head) in part]
        return "\n".join(lines)


class Result:
    """Relations of one run."""

    def __init__(self, compiled: Compiled, relations: dict[Key, Relation], components: list[Component]):
        self.compiled, self.relations, self.components = compiled, relations, components

    def relation(self, name: str, arity: int | None = None) -> DataFrame:
        """A predicate's rows, with its declared column names where it has them."""
        found = [k for k in self.relations if k[0] == name and (arity is None or k[1] == arity)]
        if len(found) != 1:
            raise QuernError(f"there {'is no' if not found else 'are several'} {name}")
        labels = next((d.columns for d in self.compiled.program.declarations.get(name, []) if len(d.types) == found[0][1]), ())
        df = self.relations[found[0]].df
        return df.toDF(*(n or f"c{i}" for i, n in enumerate(labels))) if labels and any(labels) else df

    @property
    def queries(self) -> list[DataFrame]:
        """The answers, one DataFrame for each query; columns are its variables (a query without: one row if true)."""
        out = []
        for i, vs in enumerate(self.compiled.query_vars):
            df = self.relations[query_name(i), len(vs)].df
            out.append(df.toDF(*vs) if vs else df)
        return out

    def holds(self, i: int = 0) -> bool:
        return not self.queries[i].isEmpty()


class Engine:
    """Runs programs on a Spark session."""

    def __init__(self, spark: SparkSession, options: Options = Options()):
        self.spark, self.options = spark, options

    def compile(self, program: str | Program, inputs: dict[str, DataFrame] | None = None, modules: dict[str, str] | str | None = None) -> Compiled:
        p = parse(program) if isinstance(program, str) else program
        if p.uses:
            p = link(p, loader(modules))
        return Compiled(p, inputs or {}, self.options)

    def base(self, compiled: Compiled, inputs: dict[str, DataFrame]) -> dict[Key, Relation]:
        """Facts and inputs of every predicate that has some."""
        out: dict[Key, Relation] = {}
        for k, t in compiled.types.items():
            parts = []
            if k[0] in inputs and arity(inputs[k[0]]) == k[1]:
                parts.append(given(inputs[k[0]], t).df)
            if k in compiled.program.facts:
                parts.append(facts_frame(self.spark, compiled.program.facts[k], t))
            if parts:
                bag = reduce(DataFrame.union, parts)
                out[k] = Relation(bag.distinct(), t, bag=bag)
        for n, df in inputs.items():
            if (n, arity(df)) not in compiled.types:
                out[n, arity(df)] = given(df)
        return out

    def run(self, program: str | Program | Compiled, inputs: dict[str, DataFrame] | None = None, modules: dict[str, str] | str | None = None, check: bool = True) -> Result:
        """Evaluate a program.  inputs: relation name -> DataFrame, read by position.

        Non-recursive predicates stay lazy DataFrames; recursive ones and, with check, constraints run here."""
        inputs = inputs or {}
        compiled = program if isinstance(program, Compiled) else self.compile(program, inputs, modules)
        with wrapping(self.spark):
            known = self.base(compiled, inputs)
            components = []
            for part, recursive in compiled.order:
                components.append(self.evaluate(compiled, part, recursive, known))
            if check:
                self.check(compiled, known)
        return Result(compiled, known, components)

    def lookup(self, compiled: Compiled, known: dict[Key, Relation]):
        def find(k: Key, _: int) -> Relation:
            if k not in known:
                known[k] = empty(self.spark, compiled.types.get(k, ("i64",) * k[1]))
            return known[k]

        return find

    def evaluate(self, compiled: Compiled, part: list[Key], recursive: bool, known: dict[Key, Relation], seeds: dict[Key, DataFrame] | None = None) -> Component:
        """Put the relations of one component into known."""
        find, types = self.lookup(compiled, known), compiled.types
        if recursive:
            base = {k: known[k] for k in part if k in known}
            done, rounds = fixpoint.solve(part, compiled.rules, self.spark, types, find, base, self.options.max_rounds, self.options.strict, seeds)
            known.update(done)
            return Component(part, True, rounds)
        k = part[0]
        scans = sum(compiled.scans.get(d, 1) for r in compiled.rules if key(r.head) == k for d, _ in uses(r))
        made = [compile_rule(r, self.spark, types, find, strict=self.options.strict, promote=self.options.promote) for r in compiled.rules if key(r.head) == k]
        parts = [known[k].df, *made] if k in known else made
        df = reduce(DataFrame.union, parts)
        own = [r for r in compiled.rules if key(r.head) == k]
        if len(parts) > 1 or not own or not makes_set(own[0], types, self.keyed(compiled, own[0], find)):
            df = df.distinct()
        if scans > SCANS and compiled.reads[k] > 1:
            df, scans = fixpoint.checkpoint(df), 1
        known[k], compiled.scans[k] = Relation(df, types[k]), scans
        return Component(part, False)

    def keyed(self, compiled: Compiled, rule: Rule, find):
        """Whether columns are a key, by counting; asked for inputs of rules that compare variables only, whose answers may be far larger than what they read."""
        theta = any(isinstance(x, Cmp) and len(set(literal_vars(x))) > 1 for x in rule.body) and sum(isinstance(x, Atom) for x in rule.body) > 1

        def ask(atom: Atom, columns: list[int]) -> bool:
            if not theta or key(atom) in compiled.scans:
                return False
            by = [f"c{i}" for i in columns]
            return find(key(atom), 0).df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty()

        return ask

    def check(self, compiled: Compiled, known: dict[Key, Relation]) -> None:
        for i, c in enumerate(compiled.program.constraints):
            if not known[constraint_name(i), 1].df.isEmpty():
                raise ConstraintViolation(constraint_name(i), ", ".join(map(str, c)))


def loader(modules: dict[str, str] | str | None):
    """Module programs by path: from a dictionary of texts, or from files below a folder."""
    def load(path: str) -> Program | None:
        if isinstance(modules, dict):
            return parse(modules[path]) if path in modules else None
        if modules is None:
            return None
        found = sorted(f for f in Path(modules, path).parent.glob(Path(path).name + ".*") if f.is_file())
        return parse(found[0].read_text()) if found else None

    return load


def query(spark: SparkSession, program: str, **inputs: DataFrame) -> DataFrame:
    """The answer of a program's last query over input DataFrames."""
    result = Engine(spark).run(program, inputs)
    if not result.queries:
        raise QuernError("the program has no query")
    return result.queries[-1]




__all__ = ["Compiled", "Engine", "Options", "Result", "loader", "query"]
