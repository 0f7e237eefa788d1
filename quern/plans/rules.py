"""One rule as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CompileError, TypeMismatch
from ..functions.scalar import compare, expr, term
from ..functions.types import INTEGERS, TERM, family, spark_type
from ..lang.ast import ANON, Aggregate, Atom, Cmp, Compound, Cons, Const, Is, ListTerm, Not, Rule, Univ, Var, literal_vars, term_vars
from ..lang.passes import BUILTINS
from ..lang.stratify import Key, key
from ..operators import candidates, multiway, relational
from .relation import UNIT, Relation, hashed, names, stored
from .schema import aggregate_type, check_aggregate

#: From so many rows of a relation on, a cyclic body's candidates are tested by a bitmap before they are shuffled.
MARKED_ROWS = 100_000
#: Rows that a join which does away with a variable may make for each that it reads.
FEW = 4
#: (predicate, position of the literal in the body) -> relation
Lookup = Callable[[Key, int], Relation]


def _is_builtin(x, types: dict[Key, tuple[str, ...]]) -> bool:
    return isinstance(x, Atom) and key(x) in BUILTINS and key(x) not in types


class Body:
    """Rows of variable bindings: columns v_X; a bag, as rows match."""

    def __init__(self, spark: SparkSession, types: dict[Key, tuple[str, ...]], lookup: Lookup):
        self.spark, self.types, self.lookup = spark, types, lookup
        self.df: DataFrame | None = None
        self.kinds: dict[str, str] = {}

    @property
    def rows(self) -> DataFrame:
        return relational.unit(self.spark) if self.df is None else self.df

    def env(self) -> dict[str, tuple[Column, str]]:
        return {v: (F.col(f"v_{v}"), t) for v, t in self.kinds.items()}

    def bound(self, names) -> bool:
        return all(n in self.kinds for n in names)

    def keep(self, test: Column) -> None:
        self.df = self.rows.where(test)

    def bind(self, t, value: Column, kind: str) -> None:
        """Match a term with a value: bind its variables, or filter where they are bound."""
        if isinstance(t, Var):
            if t.name == ANON:
                return
            if t.name in self.kinds:
                if family(self.kinds[t.name]) != family(kind):
                    raise TypeMismatch(f"{t.name} is {self.kinds[t.name]} and {kind}")
                self.keep(F.col(f"v_{t.name}") == value)
            else:
                self.df = self.rows.withColumn(f"v_{t.name}", value)
                self.kinds[t.name] = kind
        elif isinstance(t, Cons):
            self.df = self.rows.withColumn("__l", value).where(F.size("__l") > 0)
            self.bind(t.head, F.element_at("__l", 1), kind[5:-1])
            self.bind(t.tail, F.slice("__l", F.lit(2), F.greatest(F.lit(0), F.size("__l") - 1)), kind)
            self.df = self.df.drop("__l")
        elif isinstance(t, ListTerm) and term_vars(t):
            self.df = self.rows.withColumn("__l", value).where(F.size("__l") == len(t.items))
            for i, x in enumerate(t.items):
                self.bind(x, F.element_at("__l", i + 1), kind[5:-1])
            self.df = self.df.drop("__l")
        else:
            self.keep(value == term(t, self.env(), kind)[0])

    # ---- atoms
    def _select(self, atom: Atom, at: int) -> tuple[DataFrame, dict[str, str], list]:
        """The relation's matching rows as columns v_X, their types, and what is left to match afterwards."""
        rel = self.lookup(key(atom), at)
        df, cols, kinds, later = rel.df, {}, {}, []
        for i, (a, t) in enumerate(zip(atom.args, rel.types, strict=True)):
            c = F.col(f"c{i}")
            if isinstance(a, Var):
                if a.name == ANON:
                    continue
                if a.name in cols:
                    df = df.where(cols[a.name] == c)
                else:
                    cols[a.name], kinds[a.name] = c, t
            elif isinstance(a, (Cons, ListTerm, Compound)) and term_vars(a):
                cols[f"__t{at}_{i}"] = c
                later.append((a, f"v___t{at}_{i}", t))
            else:
                df = df.where(c == term(a, {}, t)[0])
        out = [c.alias(f"v_{v}") for v, c in cols.items()]
        return df.select(*out) if out else df.select(F.lit(1).alias(f"__r{at}")), kinds, later

    def join(self, atom: Atom, at: int) -> None:
        right, kinds, later = self._select(atom, at)
        for v, t in kinds.items():
            if v in self.kinds and family(self.kinds[v]) != family(t):
                raise TypeMismatch(f"{v} is {self.kinds[v]} and {t}")
        shared = [f"v_{v}" for v in kinds if v in self.kinds]
        if self.df is None:
            self.df = right
        else:
            self.df = relational.join(self.df, right, shared)
        if f"__r{at}" in self.df.columns and len(self.df.columns) > 1:
            self.df = self.df.drop(f"__r{at}")
        for v, t in kinds.items():
            self.kinds.setdefault(v, t)
        for t, column, kind in later:
            self.bind(t, F.col(column), kind)
            self.df = self.df.drop(column)

    # ---- cyclic bodies
    def edges(self, atom: Atom, at: int) -> tuple[DataFrame, dict[str, str]]:
        """A relation of two variables as a set of rows that is read several times."""
        right, kinds, _ = self._select(atom, at)
        for v, t in kinds.items():
            if v in self.kinds and family(self.kinds[v]) != family(t):
                raise TypeMismatch(f"{v} is {self.kinds[v]} and {t}")
        return right, kinds

    def close(self, var: str, atoms: list[tuple[int, Atom]]) -> None:
        """Bind a variable that several relations restrict: each row takes candidates from that which has fewest for it, and the
        others check them.  So no more candidates are made than the shortest list has, however long the hubs' are.  Where they may be many, a
        bitmap tests them before they are shuffled."""
        rows, sides = self.rows, []
        for n, (at, atom) in enumerate(atoms):
            right, kinds = self.edges(atom, at)
            known = next(f"v_{x}" for x in kinds if x != var)
            sides.append((right, known, self.lookup(key(atom), at).rows))
            self.kinds.setdefault(var, kinds[var])
            rows = rows.join(right.groupBy(known).agg(F.count(F.lit(1)).alias(f"__d{n}")), known)
        counts = [f"__d{n}" for n in range(len(sides))]
        least = F.least(*counts)
        chosen = F.coalesce(*(F.when(F.col(c) == least, n) for n, c in enumerate(counts)))
        rows = rows.withColumn("__side", chosen).drop(*counts)
        parts = []
        # relations that are alike but for their variables' names share a bitmap
        alike = [(key(atom), tuple(a if isinstance(a, Const) else a.name == var for a in atom.args)) for _, atom in atoms]
        marks: dict[int, candidates.Marks] = {}
        if max((size or 0 for _, _, size in sides)) >= MARKED_ROWS and all(size is not None and candidates.plain(right) for right, _, size in sides):
            rows = stored(rows)[0]
            made = {form: candidates.Marks(right.select(known, f"v_{var}"), size) for form, (right, known, size) in zip(alike, sides, strict=True)}
            marks = dict(enumerate(made[form] for form in alike))
        for n, (right, known, _) in enumerate(sides):
            part = rows.where(F.col("__side") == n).drop("__side")
            if marks:
                part = candidates.expand(part, right, known, f"v_{var}", [(end, marks[m]) for m, (_, end, _) in enumerate(sides) if m != n])
            else:
                part = part.join(right, known)
            for m, (other, end, size) in enumerate(sides):
                if m != n:
                    part = part.join(hashed(other, size), [end, f"v_{var}"], "left_semi")
            parts.append(part.select(*(f"v_{v}" for v in self.kinds)))
        self.df = reduce(DataFrame.union, parts)

    def square(self, halves: list[list[tuple[int, Atom]]]) -> None:
        """A cycle of four relations: the paths over two corners meet on both ends."""
        for n, half in enumerate(halves):
            body = self if not n else Body(self.spark, self.types, self.lookup)
            for at, atom in half:
                body.join(atom, at)
            if n:
                for v, t in body.kinds.items():
                    if v in self.kinds and family(self.kinds[v]) != family(t):
                        raise TypeMismatch(f"{v} is {self.kinds[v]} and {t}")
                self.df = relational.join(self.df, body.df, [f"v_{v}" for v in body.kinds if v in self.kinds])
                self.kinds |= {v: t for v, t in body.kinds.items() if v not in self.kinds}

    def negate(self, atom: Atom, at: int) -> None:
        right, kinds, later = self._select(atom, at)
        if later:
            raise CompileError(f"not {atom}: lists and terms with variables can't be negated")
        shared = [f"v_{v}" for v in kinds]
        self.df = relational.join(self.rows, right, shared, "left_anti")

    # ---- built-in literals
    def builtin(self, a: Atom, at: int) -> None:
        getattr(self, f"_{a.name}")(a, at)

    def _value(self, t, want: str | None = None) -> tuple[Column, str]:
        return term(t, self.env(), want)

    def _list(self, t) -> tuple[Column, str]:
        c, kind = self._value(t)
        if not kind.startswith("list<"):
            raise TypeMismatch(f"{t} is {kind}, no list")
        return c, kind

    def _is_list(self, a, at):
        if not self._value(a.args[0])[1].startswith("list<"):
            self.keep(F.lit(False))

    def _member(self, a, at):
        lst, kind = self._list(a.args[1])
        x = a.args[0]
        if isinstance(x, Var) and x.name not in self.kinds or term_vars(x) and not self.bound(term_vars(x)):
            self.df = self.rows.withColumn("__m", F.explode(lst))
            self.bind(x, F.col("__m"), kind[5:-1])
            self.df = self.df.drop("__m")
        else:
            self.df = self.rows.where(F.array_contains(lst, self._value(x, kind[5:-1])[0]))

    _memberchk = _member

    def _length(self, a, at):
        self.bind(a.args[1], F.size(self._list(a.args[0])[0]).cast("bigint"), "u32")

    def _nth(self, a, at):
        lst, kind = self._list(a.args[1])
        n = a.args[0]
        if isinstance(n, Var) and n.name not in self.kinds:
            before = self.rows
            self.df = before.select("*", F.posexplode(lst).alias("__p", "__x"))
            self.bind(n, F.col("__p").cast("bigint"), "u32")
        else:
            i = self._value(n)[0].cast("int")
            self.df = self.rows.withColumn("__i", i).where((F.col("__i") >= 0) & (F.col("__i") < F.size(lst))).withColumn("__x", F.get(lst, F.col("__i")))
        self.bind(a.args[2], F.col("__x"), kind[5:-1])
        self.df = self.df.drop("__p", "__x", "__i")

    def _append(self, a, at):
        x, y = self._list(a.args[0]), self._list(a.args[1])
        kind = y[1] if a.args[0] == ListTerm(()) else x[1]
        t = spark_type(kind)
        self.bind(a.args[2], F.concat(x[0].cast(t), y[0].cast(t)), kind)

    def _sort(self, a, at):
        lst, kind = self._list(a.args[0])
        self.bind(a.args[1], F.array_sort(F.array_distinct(lst)), kind)

    _list_to_set = _sort

    def _msort(self, a, at):
        lst, kind = self._list(a.args[0])
        self.bind(a.args[1], F.array_sort(lst), kind)

    def _ground(self, a, at):
        if not self.bound(term_vars(a.args[0])) or isinstance(a.args[0], Var) and a.args[0].name == ANON:
            self.keep(F.lit(False))

    def _var(self, a, at):
        if not (isinstance(a.args[0], Var) and a.args[0].name not in self.kinds):
            self.keep(F.lit(False))

    def _nonvar(self, a, at):
        if isinstance(a.args[0], Var) and a.args[0].name not in self.kinds:
            self.keep(F.lit(False))

    def _functor(self, a, at):
        c, kind = self._value(a.args[0])
        if kind != "term":
            raise TypeMismatch(f"{a.args[0]} is {kind}, no term")
        self.bind(a.args[1], c["functor"], "symbol")
        self.bind(a.args[2], F.size(c["args"]).cast("bigint"), "u32")

    def univ(self, x: Univ) -> None:
        if self.bound(term_vars(x.left)) and not (isinstance(x.left, Var) and x.left.name not in self.kinds):
            c, _ = self._value(x.left)
            self.bind(x.right, F.concat(F.array(c["functor"]), c["args"]), "list<symbol>")
        else:
            c, _ = self._list(x.right)
            made = F.struct(F.element_at(c, 1).cast("string").alias("functor"), F.slice(c, F.lit(2), F.size(c) - 1).cast("array<string>").alias("args"))
            self.bind(x.left, made.cast(TERM), "term")

    def _findall(self, a, at):
        template, goal, out = a.args
        if not isinstance(goal, Compound):
            raise CompileError(f"{a}: the goal must be an atom")
        inner = Body(self.spark, self.types, self.lookup)
        inner.join(Atom(goal.name, goal.args), at)
        value, kind = term(template, inner.env())
        shared = [v for v in inner.kinds if v in self.kinds]
        found = inner.rows.select(*(F.col(f"v_{v}") for v in shared), value.alias("__x"))
        listed = F.array_sort(F.collect_list("__x")).alias("__found")
        grouped = found.groupBy(*(f"v_{v}" for v in shared)).agg(listed) if shared else found.agg(listed)
        on = [f"v_{v}" for v in shared]
        self.df = self.rows.join(grouped, on, "left") if on else self.rows.crossJoin(grouped)
        self.bind(out, F.coalesce("__found", F.array().cast(f"array<{spark_type(kind)}>")), f"list<{kind}>")
        self.df = self.df.drop("__found")

    def _maplist(self, a, at):
        name, lists = a.args[0], a.args[1:]
        if not isinstance(name, Const) or not isinstance(lists[0], ListTerm):
            raise CompileError(f"{a}: maplist takes a predicate's name and a literal list")
        if len(lists) == 1:
            for x in lists[0].items:
                self.join(Atom(str(name.value), (x,)), at)
            return
        new = [Var(f"__map{at}_{i}") for i in range(len(lists[0].items))]
        for x, v in zip(lists[0].items, new, strict=True):
            self.join(Atom(str(name.value), (x, v)), at)
        kind = self.types[str(name.value), 2][1]
        made = F.array(*(F.col(f"v_{v.name}") for v in new)).cast(f"array<{spark_type(kind)}>")
        self.bind(lists[1], made, f"list<{kind}>")
        for v in new:
            del self.kinds[v.name]
            self.df = self.df.drop(f"v_{v.name}")


def _needs(x, body: Body, types) -> list[str] | None:
    """The variables that must be bound before x can run; None: x is an atom to join."""
    if isinstance(x, Cmp):
        return literal_vars(x)
    if isinstance(x, Is):
        return term_vars(x.value)
    if isinstance(x, Not):
        return term_vars(x.atom)
    if isinstance(x, Univ):
        return term_vars(x.left) if body.bound(term_vars(x.left)) else term_vars(x.right)
    if _is_builtin(x, types):
        ins = {"member": [1], "memberchk": [1], "nth": [1], "length": [0], "append": [0, 1], "sort": [0], "msort": [0], "list_to_set": [0], "functor": [0], "is_list": [0], "maplist": [1]}
        return [v for i in ins.get(x.name, []) for v in term_vars(x.args[i])]
    return None


def _edge(x) -> tuple[str, str] | None:
    """The two variables of an atom that has no others, no wildcard (which would multiply rows) and no inner terms."""
    if not isinstance(x, Atom) or not all(isinstance(a, (Var, Const)) for a in x.args):
        return None
    vs = [a.name for a in x.args if isinstance(a, Var)]
    return (vs[0], vs[1]) if len(vs) == 2 and vs[0] != vs[1] and ANON not in vs else None


def closing(atoms: list[tuple[int, Atom]], bound: set[str]) -> tuple[str, list[tuple[int, Atom]]] | None:
    """The unbound variable that most atoms tie to bound ones, if several do, and those atoms."""
    ties: dict[str, list[tuple[int, Atom]]] = {}
    for at, x in atoms:
        if e := _edge(x):
            for v, u in (e, e[::-1]):
                if v not in bound and u in bound:
                    ties.setdefault(v, []).append((at, x))
    best = max(ties.items(), key=lambda t: len(t[1]), default=None)
    return best if best and len(best[1]) > 1 else None


def four_cycle(atoms: list[tuple[int, Atom]]) -> list[list[tuple[int, Atom]]] | None:
    """Two paths of two atoms each that make a cycle over four variables, if the atoms are just that."""
    found = [(_edge(x), at, x) for at, x in atoms]
    if len(found) != 4 or any(e is None for e, _, _ in found):
        return None
    first, *rest = found
    if any(sum(v in e for e, _, _ in found) != 2 for e, _, _ in found for v in e) or len({v for e, _, _ in found for v in e}) != 4:
        return None
    beside = next((f for f in rest if first[0][1] in f[0]), None)
    others = [f for f in rest if f is not beside]
    return [[f[1:] for f in (first, beside)], [f[1:] for f in others]] if beside and set(others[0][0]) & set(others[1][0]) and set(first[0]) != set(beside[0]) else None


def _once(lookup: Lookup) -> Lookup:
    """Relations written when first asked for, and counted."""
    once: dict[Key, Relation] = {}

    def find(k: Key, at: int) -> Relation:
        if k not in once:
            rel = lookup(k, at)
            if rel.rows is None:
                df, n = stored(rel.df)
                rel = Relation(df, rel.types, n)
            once[k] = rel
        return once[k]

    return find


def compile_body(rule: Rule, spark: SparkSession, types: dict[Key, tuple[str, ...]], lookup: Lookup, first: int | None = None, promote: bool = False) -> Body:
    """Join the atoms so that each shares a variable with those before if one does (``first`` starts), and run
    every other literal as soon as its variables are bound; negations that share none come last.

    With promote, a variable that several atoms of two variables tie to bound ones (triangles, cliques, any cyclic body) is bound by
    all of them at once, and a cycle of four is joined as two paths.  Relations that this reads often are written before."""
    if promote and any(key(x) not in BUILTINS for x in rule.body if isinstance(x, Atom)):
        atoms = [(at, x) for at, x in enumerate(rule.body) if isinstance(x, Atom) and not _is_builtin(x, types)]
        cyclic = _cyclic([e for _, x in atoms if (e := _edge(x))])
        if cyclic:
            lookup = _once(lookup)
            rule, types, lookup = _bridged(rule, types, lookup, spark)
        promote = cyclic
    body = Body(spark, types, lookup)
    left = list(enumerate(rule.body))
    static = ("ground", "var", "nonvar")

    def ready() -> bool:
        for at, x in list(left):
            need = _needs(x, body, types)
            if need is None or not body.bound(need):
                continue
            if _is_builtin(x, types) and x.name in static and any(i < at for i, _ in left):
                continue  # these look at what stands before them
            if isinstance(x, Not) and not need and any(not isinstance(y, Not) for _, y in left):
                continue
            if _is_builtin(x, types) and x.name == "findall" and any(i < at for i, _ in left):
                continue
            left.remove((at, x))
            if isinstance(x, Cmp):
                body.keep(compare(x, body.env()))
            elif isinstance(x, Is):
                if x.var in body.kinds:
                    raise CompileError(f"in {rule}: the target {x.var} of is is already bound")
                value, kind = expr(x.value, body.env())
                body.bind(Var(x.var), value, kind)
            elif isinstance(x, Not):
                body.negate(x.atom, at)
            elif isinstance(x, Univ):
                body.univ(x)
            else:
                body.builtin(x, at)
            return True
        return False

    while left:
        if ready():
            continue
        atoms = [(at, x) for at, x in left if isinstance(x, Atom) and not _is_builtin(x, types)]
        if not atoms:
            raise CompileError(f"in {rule}: {left[0][1]} has unbound variables")
        if promote and (tied := closing(atoms, set(body.kinds))):
            for entry in tied[1]:
                left.remove(entry)
            body.close(*tied)
            continue
        if promote and not body.kinds and (halves := four_cycle(atoms)):
            left = [entry for entry in left if not any(entry is x or entry == x for half in halves for x in half)]
            body.square(halves)
            continue
        if first is not None and any(at == first for at, _ in atoms):
            at, x = next((at, x) for at, x in atoms if at == first)
        else:
            def score(entry):
                vs = set(term_vars(entry[1]))
                return (-(len(vs & body.kinds.keys()) > 0) if body.kinds else 0, -sum(isinstance(a, Const) for a in entry[1].args) if not body.kinds else 0, entry[0])

            at, x = min(atoms, key=score)
        left.remove((at, x))
        body.join(x, at)
    return body


def _bridged(rule: Rule, types: dict[Key, tuple[str, ...]], lookup: Lookup, spark: SparkSession) -> tuple[Rule, dict[Key, tuple[str, ...]], Lookup]:
    """The rule with pairs of atoms p(A, V), q(V, B) as one relation of (A, B), where nothing else reads V and their join makes few rows, as when V is a key.

    Heads that aggregate count the values of V and keep them."""
    if rule.aggregates:
        return rule, types, lookup
    made: dict[Key, Relation] = {}
    body, n = list(rule.body), 0

    def find(k: Key, at: int) -> Relation:
        return made[k] if k in made else lookup(k, at)

    while True:
        ties: dict[str, list[int]] = {}
        for i, x in enumerate(body):
            for v in set(literal_vars(x)) - {ANON}:
                ties.setdefault(v, []).append(i)
        heads = {v for a in rule.head.args for v in term_vars(a)}
        edges = {i: e for i, x in enumerate(body) if not _is_builtin(x, types) and (e := _edge(x))}
        for v, at in ties.items():
            if v in heads or len(at) != 2 or not all(i in edges for i in at) or set(edges[at[0]]) == set(edges[at[1]]):
                continue
            inner = Body(spark, types, find)
            (left, a), (right, b) = (inner.edges(body[i], 0) for i in at)
            sizes = [find(key(body[i]), 0).rows for i in at]
            if any(s is None for s in sizes) or sum(sizes) < MARKED_ROWS or family(a[v]) != family(b[v]):
                continue
            degree = [df.groupBy(f"v_{v}").agg(F.count(F.lit(1)).alias(f"__d{i}")) for i, df in enumerate((left, right))]
            if (degree[0].join(degree[1], f"v_{v}").agg(F.sum(F.col("__d0") * F.col("__d1")).alias("n")).first().n or 0) > FEW * sum(sizes):
                continue
            ends = [next(u for u in edges[i] if u != v) for i in at]
            df, rows = stored(left.join(right, f"v_{v}").select(*(F.col(f"v_{u}").alias(f"c{i}") for i, u in enumerate(ends))).distinct())
            name, kinds = f"__bridge{n}", tuple((a | b)[u] for u in ends)
            made[name, 2], types, n = Relation(df, kinds, rows), types | {(name, 2): kinds}, n + 1
            body[at[0]] = Atom(name, tuple(map(Var, ends)))
            del body[at[1]]
            break
        else:
            return Rule(rule.head, tuple(body), rule.mask), types, find


def _cycle_counts(rule: Rule, spark: SparkSession, types: dict[Key, tuple[str, ...]], lookup: Lookup) -> DataFrame | None:
    """head(W, count(_), ...) over a cycle of four integer relations through W, and at most a comparison of W's two neighbours."""
    keys = {a.name for a in rule.head.args if isinstance(a, Var)}
    atoms = [x for x in rule.body if isinstance(x, Atom) and not _is_builtin(x, types)]
    tests = [x for x in rule.body if isinstance(x, Cmp)]
    if len(keys) != 1 or len(atoms) != 4 or len(tests) > 1 or len(atoms) + len(tests) != len(rule.body) or not four_cycle(list(enumerate(atoms))):
        return None
    if not all(isinstance(a, Var) or isinstance(a, Aggregate) and a.op == "count" for a in rule.head.args):
        return None
    (w,) = keys
    near = [x for x in atoms if w in _edge(x)]
    ends = [next(v for v in _edge(x) if v != w) for x in near]
    op = None
    if tests:
        t = tests[0]
        if not isinstance(t.left, Var) or not isinstance(t.right, Var) or {t.left.name, t.right.name} != set(ends):
            return None
        op = t.op
        if t.left.name != ends[0]:
            near, ends = near[::-1], ends[::-1]
    far = [next(x for x in atoms if x not in near and e in _edge(x)) for e in ends]
    y = next(v for v in _edge(far[0]) if v != ends[0])
    body = Body(spark, types, lookup)
    got = [body.edges(x, 0) for x in (*near, *far)]
    counted = {a.var for a in rule.head.args if isinstance(a, Aggregate)}
    if len(near) != 2 or not counted <= {w, y, *ends} or any(t not in INTEGERS for _, kinds in got for t in kinds.values()):
        return None
    if len({kinds[e] for e in ends for _, kinds in got if e in kinds}) > 1:
        return None
    (a, _), (d, _), (b, _), (c, _) = got
    v = lambda df, *names: df.select(*(f"v_{n}" for n in names))
    return multiway.four_cycle_counts(v(a, w, ends[0]), v(b, ends[0], y), v(c, y, ends[1]), v(d, ends[1], w), op)


def _cyclic(edges: list[tuple[str, str]]) -> bool:
    """Whether edges between variables close a cycle of three or more."""
    parent: dict[str, str] = {}

    def root(v: str) -> str:
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    for a, b in {tuple(sorted(e)) for e in edges}:
        ra, rb = root(a), root(b)
        if ra == rb:
            return True
        parent[ra] = rb
    return False


def makes_set(rule: Rule, types: dict[Key, tuple[str, ...]], keyed: Callable[[Atom, list[int]], bool]) -> bool:
    """Whether a rule over sets makes no row twice: the head's variables settle all others of the body, directly or by keys.

    keyed tells whether an atom's relation has at most one row for each value of these columns."""
    if rule.aggregates or not all(isinstance(x, (Atom, Cmp, Not)) and not _is_builtin(x, types) for x in rule.body):
        return False
    atoms = [x for x in rule.body if isinstance(x, Atom)]
    if not all(isinstance(a, (Var, Const)) for x in (*atoms, rule.head) for a in x.args):
        return False
    cast_to = {a.name: t for a, t in zip(rule.head.args, types[key(rule.head)], strict=True) if isinstance(a, Var)}
    if any(cast_to.get(a.name, t) != t for x in atoms for a, t in zip(x.args, types[key(x)], strict=True) if isinstance(a, Var)):
        return False  # a cast may make values equal
    have = set(cast_to)
    known = lambda a: isinstance(a, Const) or a.name != ANON and a.name in have
    while left := [x for x in atoms if not all(map(known, x.args))]:
        settled = next((x for x in left if any(map(known, x.args)) and keyed(x, [i for i, a in enumerate(x.args) if known(a)])), None)
        if settled is None:
            return False
        have |= {a.name for a in settled.args if isinstance(a, Var) and a.name != ANON}
        atoms.remove(settled)
    return True


def head_columns(rule: Rule, body: Body, types: tuple[str, ...]) -> list[Column]:
    out = []
    for i, (a, t) in enumerate(zip(rule.head.args, types, strict=True)):
        c, kind = term(a, body.env(), t)
        if family(kind) != family(t) and not (kind.startswith("list<") and t.startswith("list<")):
            raise TypeMismatch(f"in {rule}: {a} is {kind}, not {t}")
        out.append(c.cast(spark_type(t)).alias(f"c{i}"))
    return out or [F.lit(1).alias(UNIT)]


def compile_rule(rule: Rule, spark: SparkSession, types: dict[Key, tuple[str, ...]], lookup: Lookup, first: int | None = None, strict: bool = False, promote: bool = False) -> DataFrame:
    """The head's rows; a bag, the caller makes it a set."""
    kinds = types[key(rule.head)]
    if promote and rule.aggregates:
        lookup = _once(lookup) if _cyclic([e for x in rule.body if isinstance(x, Atom) and not _is_builtin(x, types) and (e := _edge(x))]) else lookup
        if (counts := _cycle_counts(rule, spark, types, lookup)) is not None:
            return counts.select(*(F.col("n" if isinstance(a, Aggregate) else "w").cast(spark_type(t)).alias(f"c{i}") for i, (a, t) in enumerate(zip(rule.head.args, kinds, strict=True))))
    body = compile_body(rule, spark, types, lookup, first, promote)
    if not rule.aggregates:
        return body.rows.select(*head_columns(rule, body, kinds))
    keys = list(dict.fromkeys(a.name for a in rule.head.args if isinstance(a, Var)))
    wanted: dict[str, tuple[str, str]] = {}
    for a in rule.head.args:
        if isinstance(a, Aggregate):
            if a.var not in body.kinds:
                raise CompileError(f"in {rule}: {a.var} is not bound")
            check_aggregate(a.op, body.kinds[a.var], strict)
            wanted[f"a_{a.op}_{a.var}"] = (a.op, f"v_{a.var}")
    grouped = relational.group(body.rows, [f"v_{k}" for k in keys], wanted)
    out = []
    for i, (a, t) in enumerate(zip(rule.head.args, kinds, strict=True)):
        if isinstance(a, Aggregate):
            kind = aggregate_type(a.op, body.kinds[a.var])
            out.append(F.col(f"a_{a.op}_{a.var}").cast(spark_type(t if family(t) == family(kind) else kind)).alias(f"c{i}"))
        else:
            out.append(term(a, body.env(), t)[0].cast(spark_type(t)).alias(f"c{i}"))
    return grouped.select(*out)


__all__ = ["Body", "compile_body", "compile_rule", "makes_set", "names"]
