"""Logical types and how Spark holds them.

Unsigned types are held in the next wider signed one; u64 is held as bigint, so values
from 2^63 on wrap.  A term is a struct of its functor and arguments."""

from __future__ import annotations

from ..errors import TypeMismatch
from ..lang.ast import Compound, Cons, Const, ListTerm

SPARK = {"u32": "bigint", "u64": "bigint", "i32": "int", "i64": "bigint", "f32": "float", "f64": "double", "bool": "boolean", "symbol": "string"}
INTEGERS = ("u32", "u64", "i32", "i64")
FLOATS = ("f32", "f64")
TERM = "struct<functor:string,args:array<string>>"
LIMITS = {"u32": 2**32 - 1, "u64": 2**63 - 1, "i32": 2**31 - 1, "i64": 2**63 - 1}


def resolve(t: str, domains: dict[str, str]) -> str:
    """A type without domain names."""
    seen = set()
    while t in domains:
        if t in seen:
            raise TypeMismatch(f"the domain {t} is defined by itself")
        seen.add(t)
        t = domains[t]
    if t.startswith("list<"):
        return f"list<{resolve(t[5:-1], domains)}>"
    if t in ("compound", "term"):
        return "term"
    if t == "predref":
        return "symbol"
    if t not in SPARK:
        raise TypeMismatch(f"unknown type {t}")
    return t


def spark_type(t: str) -> str:
    if t.startswith("list<"):
        return f"array<{spark_type(t[5:-1])}>"
    return TERM if t == "term" else SPARK.get(t, t)  # a Spark type of an input passes through


def of_spark(t: str) -> str:
    """The logical type of an input column; other Spark types pass through as they are."""
    if t.startswith("array<"):
        return f"list<{of_spark(t[6:-1])}>"
    if t == TERM:
        return "term"
    return {"bigint": "i64", "int": "i32", "smallint": "i32", "tinyint": "i32", "float": "f32", "double": "f64", "boolean": "bool", "string": "symbol"}.get(t, t)


def of_term(t) -> str | None:
    if isinstance(t, Const):
        return t.kind
    if isinstance(t, ListTerm):
        return f"list<{of_term(t.items[0]) or 'i64'}>" if t.items else "list<i64>"
    if isinstance(t, Compound):
        return "term"
    if isinstance(t, Cons) and of_term(t.head):
        return f"list<{of_term(t.head)}>"
    return None


def family(t: str) -> str:
    return "integer" if t in INTEGERS else "float" if t in FLOATS else t
