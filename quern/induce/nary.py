"""Induction of rules over relations of any arity.

Bodies are enumerated on the driver within stated bounds, each refusal is typed; coverage is counted by the engine."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement, product

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..errors import QuernError
from ..lang.ast import Atom, Program, Rule, Var


class InductionLimit(QuernError):
    """The search is larger than its bounds."""


@dataclass(frozen=True)
class Bounds:
    max_body_atoms: int = 2
    max_join_variables: int = 1
    max_patterns: int = 2000


@dataclass(frozen=True)
class Candidate:
    rule: str
    pos: int
    neg: int


def patterns(relations: dict[str, int], arity: int, bounds: Bounds) -> list[Rule]:
    """All safe bodies: head variables X0.. and up to max_join_variables others, up to renaming of the latter."""
    head = [Var(f"X{i}") for i in range(arity)]
    joins = [Var(f"Z{i}") for i in range(bounds.max_join_variables)]
    atoms = [Atom(n, args) for n in sorted(relations) for args in product(head + joins, repeat=relations[n])]
    out: dict[tuple, Rule] = {}
    for size in range(1, bounds.max_body_atoms + 1):
        for body in combinations_with_replacement(atoms, size):
            used = [a for x in body for a in x.args]
            if len(set(body)) < size or not set(head) <= set(used):
                continue
            order = list(dict.fromkeys(a for a in used if a in joins))
            if order != joins[: len(order)] or size > 1 and any(used.count(z) < 2 for z in order):
                continue
            out.setdefault(tuple(body), Rule(Atom("h", tuple(head)), body))
            if len(out) > bounds.max_patterns:
                raise InductionLimit(f"more than {bounds.max_patterns} patterns")
    return list(out.values())


def induce(spark: SparkSession, relations: dict[str, DataFrame], positives: DataFrame, negatives: DataFrame, bounds: Bounds = Bounds(), top: int = 10) -> list[Candidate]:
    """The best rules: more positives, fewer negatives, shorter, then by text; without positives none.

    All candidates' coverage is counted in one program run and one aggregation."""
    arity = len(positives.columns)
    rules = patterns({n: len(df.columns) for n, df in relations.items()}, arity, bounds)
    p = Program()
    xs = tuple(Var(f"X{i}") for i in range(arity))
    from ..lang.ast import Aggregate, Const

    counted = []
    for i, r in enumerate(rules):
        for kind in ("pos", "neg"):
            p.rules.append(Rule(Atom(f"hit_{kind}_{i}", xs), (Atom(f"__{kind}", xs), *r.body)))
            p.rules.append(Rule(Atom("n", (Const(i, "i64"), Const(kind, "symbol"), Aggregate("count", "X0"))), (Atom(f"hit_{kind}_{i}", xs),)))
        counted.append(r)
    inputs = dict(relations) | {"__pos": positives, "__neg": negatives}
    rows = Engine(spark).run(p, inputs).relation("n").collect()
    pos = {r[0]: r[2] for r in rows if r[1] == "pos"}
    neg = {r[0]: r[2] for r in rows if r[1] == "neg"}
    found = [(Candidate(str(r), pos[i], neg.get(i, 0)), len(r.body)) for i, r in enumerate(counted) if pos.get(i)]
    return [c for c, _ in sorted(found, key=lambda x: (-x[0].pos, x[0].neg, x[1], x[0].rule))[:top]]
