"""Inline facts as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import TypeMismatch
from ..functions.types import FLOATS, INTEGERS, LIMITS, spark_type
from ..lang.ast import Compound, Const, ListTerm
from ..plans.relation import names


def value(t, kind: str):
    """A ground term as a Python value of a type."""
    if isinstance(t, ListTerm):
        return [value(x, kind[5:-1]) for x in t.items]
    if isinstance(t, Compound):
        return (t.name, [str(a.value) if isinstance(a, Const) else str(a) for a in t.args])
    if kind in INTEGERS:
        if t.kind != "i64":
            raise TypeMismatch(f"{t} is no {kind}")
        if not (0 if kind[0] == "u" else -LIMITS[kind] - 1) <= t.value <= LIMITS[kind]:
            raise TypeMismatch(f"{t} doesn't fit into {kind}")
        return t.value
    if kind in FLOATS:
        if t.kind not in ("i64", "f64"):
            raise TypeMismatch(f"{t} is no {kind}")
        return float(t.value)
    if kind == "bool":
        if t.value not in ("true", "false", 0, 1):
            raise TypeMismatch(f"{t} is no bool")
        return t.value in ("true", 1)
    if kind == "symbol" and t.kind != "symbol":
        raise TypeMismatch(f"{t} is no symbol")
    return t.value


def facts_frame(spark: SparkSession, rows: list[tuple], types: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"{n} {spark_type(t)}" for n, t in zip(names(len(types)), types or ("i32",), strict=True))
    return spark.createDataFrame([tuple(map(value, r, types)) or (1,) for r in rows], schema)
