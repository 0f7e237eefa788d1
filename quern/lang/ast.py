"""Syntax tree of programs.  All nodes are immutable but Program."""

from __future__ import annotations

from dataclasses import dataclass, field


# ---- terms
@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Const:
    value: int | float | str | bool
    kind: str  # i64, f64, symbol, bool

    def __str__(self):
        return f'"{self.value}"' if self.kind == "symbol" else str(self.value)


@dataclass(frozen=True)
class ListTerm:
    items: tuple

    def __str__(self):
        return "[" + ", ".join(map(str, self.items)) + "]"


@dataclass(frozen=True)
class Cons:
    head: object
    tail: object

    def __str__(self):
        return f"[{self.head} | {self.tail}]"


@dataclass(frozen=True)
class Compound:
    name: str
    args: tuple

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Aggregate:
    op: str
    var: str

    def __str__(self):
        return f"{self.op}({self.var})"


ANON = "_"


# ---- expressions
@dataclass(frozen=True)
class Bin:
    op: str
    left: object
    right: object

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Cast:
    value: object
    to: str

    def __str__(self):
        return f"cast({self.value}, {self.to})"


@dataclass(frozen=True)
class If:
    test: Cmp
    yes: object
    no: object

    def __str__(self):
        return f"if {self.test} then {self.yes} else {self.no}"


# ---- literals
@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Not:
    atom: Atom

    def __str__(self):
        return f"not {self.atom}"


@dataclass(frozen=True)
class Cmp:
    op: str
    left: object
    right: object

    def __str__(self):
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Is:
    var: str
    value: object

    def __str__(self):
        return f"{self.var} is {self.value}"


@dataclass(frozen=True)
class Univ:
    left: object
    right: object

    def __str__(self):
        return f"{self.left} =.. {self.right}"


@dataclass(frozen=True)
class Modal:
    op: str  # know, possible
    atom: Atom
    negated: bool = False  # not know a

    def __str__(self):
        return f"{'not ' * self.negated}{self.op} {self.atom}"


# ---- statements
@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple
    mask: str | None = None  # of a learnable rule

    @property
    def aggregates(self) -> bool:
        return any(isinstance(a, Aggregate) for a in self.head.args)

    def __str__(self):
        return f"{self.head} :- {', '.join(map(str, self.body))}." if self.body else f"{self.head}."


@dataclass(frozen=True)
class Function:
    name: str
    params: tuple
    body: object  # an expression, or (result, literals)
    private: bool = False


@dataclass(frozen=True)
class Declaration:
    name: str
    types: tuple
    columns: tuple
    private: bool = False


@dataclass(frozen=True)
class Use:
    path: str
    names: tuple | None


@dataclass(frozen=True)
class Neural:
    network: str
    inputs: tuple
    output: str
    labels: tuple | None
    atom: Atom


@dataclass
class Program:
    declarations: dict[str, list[Declaration]] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)
    functions: dict[str, Function] = field(default_factory=dict)
    uses: list[Use] = field(default_factory=list)
    pragmas: dict[str, object] = field(default_factory=dict)
    facts: dict[tuple[str, int], list[tuple]] = field(default_factory=dict)  # (name, arity) -> tuples of constants
    rules: list[Rule] = field(default_factory=list)
    constraints: list[tuple] = field(default_factory=list)
    queries: list[Atom] = field(default_factory=list)
    choices: list[list[tuple[float, Atom]]] = field(default_factory=list)  # probabilistic facts and disjunctions
    evidence: list[tuple[Atom, bool]] = field(default_factory=list)
    prob_queries: list[Atom] = field(default_factory=list)
    neural: list[Neural] = field(default_factory=list)

    def copy(self) -> Program:
        return Program(
            {k: list(v) for k, v in self.declarations.items()}, dict(self.domains), dict(self.functions), list(self.uses), dict(self.pragmas),
            {k: list(v) for k, v in self.facts.items()}, list(self.rules), list(self.constraints), list(self.queries),
            [list(c) for c in self.choices], list(self.evidence), list(self.prob_queries), list(self.neural),
        )


def term_vars(t) -> list[str]:
    """Names of the variables of a term or expression, wildcards left out, in order."""
    if isinstance(t, Var):
        return [] if t.name == ANON else [t.name]
    if isinstance(t, Aggregate):
        return [t.var]
    if isinstance(t, (ListTerm,)):
        parts = t.items
    elif isinstance(t, Cons):
        parts = (t.head, t.tail)
    elif isinstance(t, (Compound, Call, Atom)):
        parts = t.args
    elif isinstance(t, (Bin, Cmp)):
        parts = (t.left, t.right)
    elif isinstance(t, Cast):
        parts = (t.value,)
    elif isinstance(t, If):
        parts = (t.test, t.yes, t.no)
    else:
        return []
    return [v for p in parts for v in term_vars(p)]


def literal_vars(x) -> list[str]:
    if isinstance(x, (Not, Modal)):
        return term_vars(x.atom)
    if isinstance(x, Is):
        return [x.var, *term_vars(x.value)]
    if isinstance(x, Univ):
        return term_vars(x.left) + term_vars(x.right)
    return term_vars(x)


def substitute(t, m: dict):
    """t with variables replaced by the terms of m."""
    if isinstance(t, Var):
        return m.get(t.name, t)
    if isinstance(t, Aggregate):
        return Aggregate(t.op, m[t.var].name if t.var in m and isinstance(m[t.var], Var) else t.var)
    s = lambda x: substitute(x, m)
    if isinstance(t, ListTerm):
        return ListTerm(tuple(map(s, t.items)))
    if isinstance(t, Cons):
        return Cons(s(t.head), s(t.tail))
    if isinstance(t, (Compound, Call, Atom)):
        return type(t)(t.name, tuple(map(s, t.args)))
    if isinstance(t, (Bin, Cmp)):
        return type(t)(t.op, s(t.left), s(t.right))
    if isinstance(t, Cast):
        return Cast(s(t.value), t.to)
    if isinstance(t, If):
        return If(s(t.test), s(t.yes), s(t.no))
    if isinstance(t, Not):
        return Not(s(t.atom))
    if isinstance(t, Modal):
        return Modal(t.op, s(t.atom), t.negated)
    if isinstance(t, Is):
        to = m.get(t.var)
        return Is(to.name if isinstance(to, Var) else t.var, s(t.value))
    if isinstance(t, Univ):
        return Univ(s(t.left), s(t.right))
    return t
