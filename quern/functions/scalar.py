"""Arithmetic and comparison with the language's semantics, as Spark columns.

Integers wrap; x / 0 is the type's greatest value and x % 0 is 0.  Floats follow IEEE 754, with NaN results of
division made positive quiet ones.  == and != follow IEEE, the ordered comparisons totalOrder
(-0.0 < 0.0, NaN above infinity)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import CompileError, TypeMismatch
from ..lang.ast import Bin, Call, Cast, Cmp, Compound, Const, If, ListTerm, Var
from .types import FLOATS, INTEGERS, LIMITS, TERM, family, resolve, spark_type


@contextmanager
def wrapping(spark: SparkSession):
    """Expressions analysed within wrap on overflow and cast without raising."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def wrapped(c: Column, t: str) -> Column:
    if t == "u32":
        return F.pmod(c, F.lit(2**32))
    return c.cast(spark_type(t)) if t in ("i32", "f32") else c


def cast(c: Column, source: str, to: str) -> Column:
    if source == "symbol" or to == "symbol":
        raise TypeMismatch(f"a {source} can't be cast to {to}")
    if to == "u32":
        return F.pmod(c.cast("bigint"), F.lit(2**32))
    return c.cast(spark_type(to))


def literal(c: Const, t: str | None = None) -> tuple[Column, str]:
    """A constant, as type t if it fits there."""
    kind = c.kind
    if t and t != kind:
        if kind == "i64" and t in INTEGERS + FLOATS or kind == "f64" and t in FLOATS:
            return F.lit(c.value).cast(spark_type(t)), t
        if kind == "symbol" and t == "bool" and c.value in ("true", "false"):
            return F.lit(c.value == "true"), "bool"
        if t in INTEGERS + FLOATS + ("symbol", "bool") or t.startswith("list<") or t == "term":
            raise TypeMismatch(f"{c} is no {t}")
        return F.lit(c.value).cast(t), t  # an input's own Spark type
    return F.lit(c.value).cast(spark_type(kind)), kind


def term(t, env: dict[str, tuple[Column, str]], want: str | None = None) -> tuple[Column, str]:
    """A term whose variables are bound."""
    if isinstance(t, Var):
        if t.name not in env:
            raise CompileError(f"{t.name} is not bound")
        return env[t.name]
    if isinstance(t, Const):
        return literal(t, want)
    if isinstance(t, ListTerm):
        inner = want[5:-1] if want and want.startswith("list<") else None
        parts = [term(x, env, inner) for x in t.items]
        kind = inner or (parts[0][1] if parts else "i64")
        if any(family(p) != family(kind) for _, p in parts):
            raise TypeMismatch(f"the items of {t} differ in type")
        return F.array(*(c for c, _ in parts)).cast(spark_type(f"list<{kind}>")), f"list<{kind}>"
    if isinstance(t, Compound):
        args = [term(a, env) for a in t.args]
        texts = F.array(*(c.cast("string") if k != "term" else F.to_json(c) for c, k in args)) if args else F.array().cast("array<string>")
        return F.struct(F.lit(t.name).alias("functor"), texts.alias("args")).cast(TERM), "term"
    raise CompileError(f"{t} can't be used here")


def _same(op: str, a: tuple[Column, str], b: tuple[Column, str]) -> str:
    if a[1] != b[1]:
        raise TypeMismatch(f"{a[1]} {op} {b[1]}: use cast()")
    return a[1]


def _operands(e, env) -> tuple[tuple[Column, str], tuple[Column, str]]:
    """Both sides; a constant takes the other side's type."""
    left, right = e.left, e.right
    if isinstance(left, Const) and not isinstance(right, Const):
        b = expr(right, env)
        return expr(left, env, b[1]), b
    a = expr(left, env)
    return a, expr(right, env, a[1]) if isinstance(right, Const) else expr(right, env)


def expr(e, env: dict[str, tuple[Column, str]], want: str | None = None) -> tuple[Column, str]:
    """(column, type) of an arithmetic expression."""
    if isinstance(e, Const):
        if want and e.kind == "f64" and want in INTEGERS:
            raise TypeMismatch(f"{want} and {e}: use cast()")
        return literal(e, want if want in INTEGERS + FLOATS and not (want in FLOATS and e.kind == "i64") else None) if want else literal(e)
    if isinstance(e, Var):
        return term(e, env)
    if isinstance(e, Cast):
        c, t = expr(e.value, env)
        return cast(c, t, resolve(e.to, {})), resolve(e.to, {})
    if isinstance(e, If):
        yes, no = expr(e.yes, env), expr(e.no, env)
        if isinstance(e.no, Const) and yes[1] != no[1]:
            no = expr(e.no, env, yes[1])
        if isinstance(e.yes, Const) and yes[1] != no[1]:
            yes = expr(e.yes, env, no[1])
        t = _same("else", yes, no)
        return F.when(compare(e.test, env), yes[0]).otherwise(no[0]), t
    if isinstance(e, Call):
        return _call(e, env)
    if not isinstance(e, Bin):
        raise CompileError(f"{e} is no expression")
    a, b = _operands(e, env)
    t = _same(e.op, a, b)
    (x, _), (y, _) = a, b
    if family(t) not in ("integer", "float"):
        raise TypeMismatch(f"{e.op} needs numbers, not {t}")
    if e.op in "+-*":
        return wrapped({"+": x + y, "-": x - y, "*": x * y}[e.op], t), t
    if t in INTEGERS:
        if e.op == "/":
            out = F.when(y == 0, F.lit(LIMITS[t])).otherwise(F.call_function("div", x.cast("bigint"), y.cast("bigint")))
        else:
            out = F.when(y == 0, F.lit(0)).otherwise(x % y)
        return out.cast(spark_type(t)), t
    if e.op == "%":
        raise TypeMismatch("% needs integers")
    negative = _negative(x) != _negative(y)
    zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    out = F.when(y == 0, zero).otherwise(x / y)
    return F.when(F.isnan(out), F.lit(float("nan"))).otherwise(out).cast(spark_type(t)), t


def _negative(c: Column) -> Column:
    """Sign bit of a float that is no NaN."""
    return (c < 0) | ((c == 0) & F.startswith(c.cast("string"), F.lit("-")))


def _call(e: Call, env) -> tuple[Column, str]:
    if e.name == "abs" and len(e.args) == 1:
        c, t = expr(e.args[0], env)
        return F.abs(c), t
    if e.name in ("min", "max") and len(e.args) == 2:
        a, b = _operands(Bin(e.name, *e.args), env)
        t = _same(e.name, a, b)
        x, y = a[0], b[0]
        if t in FLOATS:  # a NaN on either side gives the second
            nan = F.isnan(x) | F.isnan(y)
            return F.when(~nan & ((x < y) if e.name == "min" else (x > y)), x).otherwise(y), t
        return F.when((x < y) if e.name == "min" else (x > y), x).otherwise(y), t
    if e.name == "pow" and len(e.args) == 2:
        a, b = expr(e.args[0], env), expr(e.args[1], env)
        return F.pow(a[0].cast("double"), b[0].cast("double")), "f64"
    raise CompileError(f"there is no function {e.name}/{len(e.args)}")


def compare(e: Cmp, env) -> Column:
    """A comparison as a boolean column."""
    if isinstance(e.left, (ListTerm, Compound)) or isinstance(e.right, (ListTerm, Compound)):
        a = term(e.left, env)
        b = term(e.right, env, a[1])
    else:
        a, b = _operands(e, env)
    if family(a[1]) != family(b[1]) and not (isinstance(e.left, Const) or isinstance(e.right, Const)):
        raise TypeMismatch(f"{a[1]} {e.op} {b[1]}: both sides must have the same type")
    x, y, t = a[0], b[0], a[1]
    if {a[1], b[1]} & set(FLOATS):
        nan = F.isnan(x) | F.isnan(y)
        below = (x < y) | ((x == y) & ~nan & _negative(x) & ~_negative(y))
        above = (y < x) | ((x == y) & ~nan & _negative(y) & ~_negative(x))
        return {"==": (x == y) & ~nan, "!=": (x != y) | nan, "<": below, ">": above, "<=": ~above, ">=": ~below}[e.op]
    if e.op not in ("==", "!=") and family(t) not in ("integer", "float", "bool") and t in ("symbol", "term"):
        raise TypeMismatch(f"{t} has no order")
    return {"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e.op]
