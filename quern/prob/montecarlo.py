"""Monte Carlo inference on Spark: many sampled worlds in one run.

Relations that depend on a choice get a world column, and rules join on it; so one program run evaluates
all worlds together, distributed by world.  A choice's draw in a world is a hash of world, choice and seed: a task that
runs again draws the same.  Evidence on a fact that is one outcome of one choice, and derived by
no rule, is clamped; other evidence rejects worlds.  Cycles through negation get the well-founded
meaning in each world."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import ProbabilityError, StratificationError
from ..functions.types import of_term, spark_type
from ..lang.ast import Atom, Not, Program, Rule, Var
from ..lang.parser import parse
from ..lang.passes import expand_functions
from ..lang.stratify import Key, key, uses
from ..sources.facts import value

SAMPLES, SEED, CONFIDENCE = 10_000, 0, 0.95
_WORLD = Var("World__")


@dataclass(frozen=True)
class Estimate:
    atom: str
    probability: float
    stderr: float
    low: float
    high: float
    samples: int


def wilson(k: int, n: int, confidence: float) -> tuple[float, float]:
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p, q = k / n, z * z / n
    middle, half = (p + q / 2) / (1 + q), z * math.sqrt(p * (1 - p) / n + q / (4 * n)) / (1 + q)
    return max(0.0, middle - half), min(1.0, middle + half)


def _uncertain(p: Program) -> set[Key]:
    out = {key(a) for c in p.choices for _, a in c}
    again = True
    while again:
        again = False
        for r in p.rules:
            if key(r.head) not in out and any(d in out for d, _ in uses(r)):
                out.add(key(r.head))
                again = True
    return out


def _clamped(p: Program, method: str | None) -> tuple[dict[int, int], list[tuple[Atom, bool]]]:
    """(outcome forced on choices, evidence that is left)."""
    if method == "rejection":
        return {}, list(p.evidence)
    heads, where = {key(r.head) for r in p.rules}, {}
    for i, c in enumerate(p.choices):
        for j, (_, a) in enumerate(c):
            where.setdefault(a, []).append((i, j))
    forced, left = {}, []
    for atom, truth in p.evidence:
        spots = where.get(atom, [])
        i, j = spots[0] if len(spots) == 1 else (-1, -1)
        simple = len(spots) == 1 and key(atom) not in heads and atom.args not in p.facts.get(key(atom), []) and (truth or len(p.choices[i]) == 1)
        if simple and i not in forced:
            if (p.choices[i][j][0] if truth else 1 - p.choices[i][j][0]) <= 0:
                raise ProbabilityError("the evidence is impossible")
            forced[i] = j if truth else len(p.choices[i])
        else:
            left.append((atom, truth))
    if left and method == "evidence_clamping":
        raise ProbabilityError(f"the evidence on {left[0][0]} can't be clamped")
    return forced, left


def _draws(spark: SparkSession, worlds: DataFrame, p: Program, forced: dict[int, int], seed: int, uncertain: set[Key]) -> dict[str, DataFrame]:
    """For each predicate of a choice: (world, arguments) of the outcomes drawn."""
    rows: dict[Key, list[tuple]] = {}
    kinds: dict[Key, list[str]] = {}
    for k in uncertain:
        ds = [d for d in p.declarations.get(k[0], []) if len(d.types) == k[1]]
        if ds:
            kinds[k] = list(ds[0].types)
    for i, c in enumerate(p.choices):
        low = 0.0
        for j, (w, a) in enumerate(c):
            span = (low, low + w) if i not in forced else (0.0, 1.0) if forced[i] == j else (2.0, 2.0)
            low += w
            k = key(a)
            types = kinds.setdefault(k, [of_term(t) for t in a.args])
            rows.setdefault(k, []).append((i, *span, *map(value, a.args, types)))
    for k in uncertain & p.facts.keys():
        types = kinds.setdefault(k, [of_term(t) for t in p.facts[k][0]])
        rows.setdefault(k, []).extend((-1, 0.0, 1.0, *map(value, r, types)) for r in p.facts[k])
    out = {}
    for k, given in rows.items():
        schema = ", ".join(["choice int, low double, high double", *(f"a{n} {spark_type(t)}" for n, t in enumerate(kinds[k]))])
        table = spark.createDataFrame(given, schema)
        # every world holds every choice: the product is what is sampled
        u = F.shiftrightunsigned(F.xxhash64("world", "choice", F.lit(seed)), 11) / float(1 << 53)
        drawn = worlds.crossJoin(table).where((u >= F.col("low")) & (u < F.col("high")))
        out[k[0]] = drawn.select("world", *(f"a{n}" for n in range(k[1])))
    return out


def monte_carlo(spark: SparkSession, program: str | Program, samples: int | None = None, seed: int | None = None, confidence: float | None = None, method: str | None = None) -> list[Estimate]:
    """Estimates of a program's probabilistic queries, given its evidence; options override pragmas."""
    p = expand_functions(parse(program) if isinstance(program, str) else program)
    samples = samples or int(p.pragmas.get("prob_samples", SAMPLES))
    seed = seed if seed is not None else int(p.pragmas.get("prob_seed", SEED))
    confidence = confidence or float(p.pragmas.get("prob_confidence", CONFIDENCE))
    for c in p.choices:
        if any(not 0 <= w <= 1 for w, _ in c) or sum(w for w, _ in c) > 1 + 1e-9:
            raise ProbabilityError("probabilities must lie in 0..1 and sum to 1 at most")
    uncertain = _uncertain(p)
    forced, evidence = _clamped(p, method or p.pragmas.get("prob_method"))
    worlds = spark.range(samples).select(F.col("id").alias("world"))

    def worldly(a: Atom) -> Atom:
        return Atom(a.name, (_WORLD, *a.args)) if key(a) in uncertain else a

    rules = []
    for r in p.rules:
        body = tuple(worldly(x) if isinstance(x, Atom) else Not(worldly(x.atom)) if isinstance(x, Not) else x for x in r.body)
        if key(r.head) in uncertain:
            if not any(isinstance(x, Atom) and key(x) in uncertain for x in r.body):
                body = (Atom("world__", (_WORLD,)), *body)
            body = tuple(sorted(body, key=lambda x: isinstance(x, Not)))  # the world is bound before negations
            rules.append(Rule(worldly(r.head), body))
        else:
            rules.append(Rule(r.head, body))
    for i, (a, _) in enumerate([*evidence, *((q, True) for q in p.prob_queries)]):
        body = (worldly(a),) if key(a) in uncertain else (Atom("world__", (_WORLD,)), a)
        rules.append(Rule(Atom(f"__ask_{i}", (_WORLD,)), body))
    q = p.copy()
    q.rules, q.choices, q.evidence, q.prob_queries, q.queries = rules, [], [], [], []
    q.facts = {k: v for k, v in p.facts.items() if k not in uncertain}
    q.declarations = {n: [type(d)(d.name, ("u64", *d.types), (None, *d.columns), d.private) if (n, len(d.types)) in uncertain else d for d in ds] for n, ds in p.declarations.items()}
    inputs = {"world__": worlds} | _draws(spark, worlds, p, forced, seed, uncertain)
    try:
        result = Engine(spark).run(q, inputs)
    except StratificationError:  # what is true in every world's well-founded model
        from ..epistemic import well_founded

        result = well_founded(Engine(spark), q, inputs, int(p.pragmas.get("prob_max_nonmonotone_iterations", 1024)))
    kept = worlds
    for i, (_, truth) in enumerate(evidence):
        kept = kept.join(result.relation(f"__ask_{i}").toDF("world"), "world", "left_semi" if truth else "left_anti")
    n = kept.count() if evidence else samples
    if not n:
        raise ProbabilityError("no sampled world meets the evidence")
    out = []
    for i, a in enumerate(p.prob_queries, len(evidence)):
        k = result.relation(f"__ask_{i}").toDF("world").join(kept, "world", "left_semi").count()
        x = k / n
        out.append(Estimate(str(a), x, math.sqrt(x * (1 - x) / n), *wilson(k, n, confidence), n))
    return out
