"""Modal programs: know and possible.

FAEEL (the default) asks for founded beliefs: a modal literal holds where its atom is derived, so it reads as an ordinary one, and
self-support derives nothing.  Cycles through negated modal literals get the well-founded meaning, by an alternating
fixpoint whose lower bound is the answer.  G91 also accepts circular support through ``possible``: from the upper bound, in which
every such literal holds, the program is evaluated against the frozen beliefs of the round before until they stay.
Modal constraints drop the world view, so all answers are empty; an ordinary constraint raises as ever."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine, Options, Result
from ..errors import RecursionLimit, StratificationError, UnsupportedEpistemicConstruct
from ..lang.ast import Atom, Modal, Not, Program, Rule, Var, literal_vars, term_vars
from ..lang.parser import parse
from ..lang.stratify import Key, components, dependencies, key, order
from ..plans.relation import checkpoint
from ..prob.diagram import Diagrams
from ..prob.evaluate import Evaluator, choice_facts, constant
from . import game

MAX_MODELS = 1024
_FROZEN = "__before_"
_MOVE, _SURE = "__game_move", "__game_sure"


def _ordinary(x):
    """A modal literal under founded beliefs."""
    return x if not isinstance(x, Modal) else Not(x.atom) if x.negated else x.atom


def _body(xs) -> tuple:
    """Literals under founded beliefs, negations last: a modal chain may stand before what binds its variables."""
    return tuple(sorted(map(_ordinary, xs), key=lambda x: isinstance(x, Not)))


def _split(p: Program) -> tuple[Program, list[tuple[Modal, ...]]]:
    """The program without its modal constraints, and these."""
    out, modal = p.copy(), []
    out.constraints = []
    for c in p.constraints:
        if not any(isinstance(x, Modal) for x in c):
            out.constraints.append(c)
            continue
        if not all(isinstance(x, Modal) for x in c):
            raise UnsupportedEpistemicConstruct(f"a constraint that mixes ordinary and modal literals: {', '.join(map(str, c))}")
        seen: list[str] = [v for x in c for v in dict.fromkeys(term_vars(x.atom))]
        if len(seen) != len(set(seen)):
            raise UnsupportedEpistemicConstruct(f"a constraint that shares a variable between modal literals: {', '.join(map(str, c))}")
        modal.append(c)
    return out, modal


def classify(p: Program) -> str:
    """non_recursive; case_a: recursion apart from modal literals; case_b: modal literals on recursive predicates; modal_cycle: a cycle through one."""
    deps = {k: [d for d, _ in v] for k, v in dependencies(p.rules).items()}
    part = {k: i for i, c in enumerate(components(deps)) for k in c}
    recursive = {k for c, again in order(p.rules, strict=False) if again for k in c}
    modal = [(key(r.head), key(x.atom)) for r in p.rules for x in r.body if isinstance(x, Modal)]
    if any(part.get(a) == part.get(b) and a in part and b in part for a, b in modal):
        return "modal_cycle"
    if not recursive:
        return "non_recursive"
    return "case_b" if any(b in recursive for _, b in modal) else "case_a"


def components_of(p: Program) -> list[set[Key]]:
    """Groups of predicates that share no rule: each can be answered on its own."""
    parent: dict[Key, Key] = {}

    def find(k: Key) -> Key:
        parent.setdefault(k, k)
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, ds in dependencies(p.rules).items():
        find(k)
        for d, _ in ds:
            parent[find(d)] = find(k)
    groups: dict[Key, set[Key]] = {}
    for k in list(parent):
        groups.setdefault(find(k), set()).add(k)
    return sorted(groups.values(), key=lambda g: min(g))


class EpistemicResult:
    """Answers of the accepted world view; ``accepted`` is false where a modal constraint dropped it."""

    def __init__(self, result: Result, accepted: bool):
        self.result, self.accepted = result, accepted

    @property
    def queries(self) -> list[DataFrame]:
        return [q if self.accepted else q.limit(0) for q in self.result.queries]

    def relation(self, name: str) -> DataFrame:
        return self.result.relation(name) if self.accepted else self.result.relation(name).limit(0)


def run(spark: SparkSession, program: str | Program, inputs: dict[str, DataFrame] | None = None, mode: str | None = None, options: Options = Options()) -> EpistemicResult:
    p = parse(program) if isinstance(program, str) else program
    mode = mode or p.pragmas.get("epistemic_mode", "faeel")
    limit = int(p.pragmas.get("max_recursion_depth", 1000))
    plain, modal = _split(p)
    recursive = [k for part, again in order(p.rules, strict=False) if again for k in part]
    if modal and recursive:
        raise UnsupportedEpistemicConstruct("recursion together with a modal constraint")
    for i, c in enumerate(modal):
        plain.rules.append(Rule(Atom(f"__modal_{i}", ()), tuple(_ordinary(x) for x in sorted(c, key=lambda x: x.negated))))
    engine = Engine(spark, options)
    result = _g91(engine, plain, inputs or {}, limit) if mode == "g91" else _founded(engine, plain, inputs or {}, limit)
    accepted = all(result.relation(f"__modal_{i}", 0).isEmpty() for i in range(len(modal)))
    return EpistemicResult(result, accepted)


def _reduced(p: Program) -> Program:
    out = p.copy()
    out.rules = [Rule(r.head, _body(r.body), r.mask) for r in p.rules]
    return out


def _founded(engine: Engine, p: Program, inputs: dict[str, DataFrame], limit: int) -> Result:
    q = _reduced(p)
    try:
        return engine.run(q, inputs)
    except StratificationError:
        return well_founded(engine, q, inputs, limit)


def well_founded(engine: Engine, p: Program, inputs: dict[str, DataFrame], limit: int = 1000) -> Result:
    """The lower bound of the alternating fixpoint: negated literals of cyclic predicates read frozen relations.

    A step settles one move of a game; programs that are games are solved by ``game`` in steps that double instead."""
    deps = dependencies(p.rules)
    cyclic: set[Key] = set()
    for part in components({k: [d for d, _ in v] for k, v in deps.items()}):
        inside = set(part)
        if any(d in inside and not mono for k in part for d, mono in deps[k]):
            cyclic |= inside
    if any(r.aggregates and key(r.head) in cyclic for r in p.rules):
        raise StratificationError("aggregation within a cycle")
    frozen = p.copy()
    frozen.rules = []
    moves = _game(p, cyclic, inputs)
    for r in p.rules:
        body = tuple(Not(Atom(_FROZEN + x.atom.name, x.atom.args)) if isinstance(x, Not) and key(x.atom) in cyclic and key(r.head) in cyclic else x for x in r.body)
        frozen.rules.append(Rule(r.head, body, r.mask))
    _declare(engine, p, frozen, inputs, cyclic)

    def step(before: dict[Key, DataFrame]) -> Result:
        return engine.run(frozen, inputs | {_FROZEN + n: df for (n, _), df in before.items()}, check=False)

    if moves:
        (k,) = cyclic
        given = engine.run(moves, inputs, check=False)
        sure = given.relation(_SURE, 1) if any(r.head.name == _SURE for r in moves.rules) or (_SURE, 1) in moves.facts else None
        return engine.run(frozen, inputs | {_FROZEN + k[0]: game.not_lost(given.relation(_MOVE, 2), sure)})
    # bounds are cut from their lineage, or plans would grow with every step
    inputs = {n: checkpoint(df) for n, df in inputs.items()}
    low: dict[Key, DataFrame] = {}
    for _ in range(limit):
        above = step(low)
        high = {k: checkpoint(above.relation(*k)) for k in cyclic}
        new = step(high)
        now = {k: checkpoint(new.relation(*k)) for k in cyclic}
        if low and all(_equal(now[k], low[k]) for k in cyclic):
            return engine.run(frozen, inputs | {_FROZEN + n: high[n, a] for n, a in cyclic})
        low = now
    raise RecursionLimit(f"the alternating fixpoint took more than {limit} rounds")


def _game(p: Program, cyclic: set[Key], inputs: dict[str, DataFrame]) -> Program | None:
    """The moves of a program whose cycles are those of a game, w(X) :- ..., not w(Y), with one predicate of one argument and at most one such literal in each rule."""
    if len(cyclic) != 1 or next(iter(cyclic))[1] != 1 or next(iter(cyclic))[0] in inputs:
        return None
    (k,) = cyclic
    out = p.copy()
    out.rules, out.queries, out.constraints = [], [], []
    deps = {h: {d for d, _ in v} for h, v in dependencies(p.rules).items()}
    above = {k}
    while more := {h for h, ds in deps.items() if h not in above and ds & above}:
        above |= more
    for r in p.rules:
        if key(r.head) not in above:
            out.rules.append(r)
        elif key(r.head) == k:
            against = [x for x in r.body if isinstance(x, Not) and key(x.atom) == k]
            rest = tuple(x for x in r.body if x not in against)
            if len(against) > 1 or any(isinstance(x, Atom) and key(x) in above or isinstance(x, Not) and key(x.atom) in above for x in rest):
                return None
            out.rules.append(Rule(Atom(_MOVE, (*r.head.args, *against[0].atom.args)) if against else Atom(_SURE, r.head.args), rest, r.mask))
    if k in out.facts:
        out.facts[_SURE, 1] = out.facts.pop(k)
    out.declarations = {n: ds for n, ds in p.declarations.items() if n != k[0]}
    return out


def _declare(engine: Engine, p: Program, frozen: Program, inputs: dict[str, DataFrame], keys: set[Key]) -> None:
    """Frozen relations have the types of those they copy, also before there is a copy."""
    lenient = p.copy()
    lenient.rules = [Rule(r.head, tuple(x for x in r.body if not isinstance(x, Not)), r.mask) for r in p.rules]
    lenient.queries, lenient.constraints = [], []
    types = engine.compile(lenient, inputs).types
    from ..lang.ast import Declaration

    for n, a in keys:
        t = types.get((n, a), ("i64",) * a)
        frozen.declarations.setdefault(_FROZEN + n, []).append(Declaration(_FROZEN + n, tuple(t), (None,) * a))


def _equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _g91(engine: Engine, p: Program, inputs: dict[str, DataFrame], limit: int) -> Result:
    deps = {k: [d for d, _ in v] for k, v in dependencies(p.rules).items()}
    part = {k: i for i, c in enumerate(components(deps)) for k in c}
    circular = lambda r, x: isinstance(x, Modal) and x.op == "possible" and not x.negated and part.get(key(r.head)) == part.get(key(x.atom)) is not None
    keys = {key(x.atom) for r in p.rules for x in r.body if circular(r, x)}
    if not keys:
        return _founded(engine, p, inputs, limit)
    whole = {k for k in deps for j in keys if part[k] == part[j]}
    for r in p.rules:
        if key(r.head) in whole and (r.aggregates or any(isinstance(x, Not) and key(x.atom) in whole for x in r.body)):
            raise UnsupportedEpistemicConstruct("negation or aggregation within a cycle of beliefs")
    upper, frozen = p.copy(), p.copy()
    upper.rules, frozen.rules = [], []
    for r in p.rules:
        rest = _body(x for x in r.body if not circular(r, x))
        bound = {v for x in rest for v in literal_vars(x)}
        if any(v not in bound for a in r.head.args for v in term_vars(a)):
            raise UnsupportedEpistemicConstruct(f"in {r}: a circular belief must not bind the head's variables alone")
        upper.rules.append(Rule(r.head, rest, r.mask))
        frozen.rules.append(Rule(r.head, _body(Atom(_FROZEN + x.atom.name, x.atom.args) if circular(r, x) else x for x in r.body), r.mask))
    # rules without a body are facts
    for r in [r for r in upper.rules if not r.body]:
        upper.rules.remove(r)
        upper.facts.setdefault(key(r.head), []).append(r.head.args)
    _declare(engine, upper, frozen, inputs, keys)
    before = engine.run(upper, inputs, check=False)
    state = {k: before.relation(*k) for k in keys}
    for _ in range(limit):
        result = engine.run(frozen, inputs | {_FROZEN + n: df for (n, _), df in state.items()}, check=False)
        now = {k: result.relation(*k) for k in keys}
        if all(_equal(now[k], state[k]) for k in keys):
            return engine.run(frozen, inputs | {_FROZEN + n: df for (n, _), df in state.items()})
        state = now
    raise RecursionLimit(f"the refinement took more than {limit} rounds")


def world_views(program: str | Program, max_models: int = MAX_MODELS) -> list[dict[str, bool]]:
    """Generate, propagate, test, on the driver: each assignment of the ground modal literals under which the program,
    evaluated with them fixed, makes exactly those true; modal constraints drop views.  For small ground programs."""
    p = parse(program) if isinstance(program, str) else program
    plain, modal = _split(p)
    atoms = list(dict.fromkeys(x.atom for r in p.rules for x in r.body if isinstance(x, Modal)))
    if any(isinstance(a, Var) for x in atoms for a in x.args):
        raise UnsupportedEpistemicConstruct("world views are enumerated for ground modal literals only")
    if 2 ** len(atoms) > max_models:
        raise UnsupportedEpistemicConstruct(f"{len(atoms)} modal literals give more than {max_models} candidates")
    out = []
    for truth in product((False, True), repeat=len(atoms)):
        guess = dict(zip(atoms, truth, strict=True))
        rules = [Rule(r.head, tuple(x for x in r.body if not isinstance(x, Modal))) for r in plain.rules if all(guess[x.atom] != x.negated for x in r.body if isinstance(x, Modal))]
        facts, _, _ = choice_facts(plain)
        for r in [r for r in rules if not r.body]:
            facts[key(r.head)][tuple(map(constant, r.head.args))] = 1
        known = Evaluator([r for r in rules if r.body], facts, Diagrams([])).run()
        has = lambda a: bool(known[key(a)].get(tuple(map(constant, a.args)), 0))
        if all(has(a) == t for a, t in guess.items()) and not any(all(_modal_holds(x, known) for x in c) for c in modal):
            out.append({str(a): t for a, t in guess.items()})
    return out


def _modal_holds(x: Modal, known) -> bool:
    from ..prob.exact import _matching

    return bool(_matching(x.atom, known[key(x.atom)])) != x.negated


__all__ = ["EpistemicResult", "classify", "components_of", "run", "well_founded", "world_views"]
