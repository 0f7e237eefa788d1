"""The relational operators that rules are made of.

Each is a thin, declarative step: Catalyst prunes, pushes down and picks join strategies.  Results are bags
where the operator says so and sets otherwise; output order is unspecified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a side may have to be broadcast on request.
BROADCAST_ROWS = 10_000


def unit(spark: SparkSession) -> DataFrame:
    """One row without content: the identity of joins."""
    return spark.range(1).select(F.lit(1).alias("u"))


def select(df: DataFrame, test: Column) -> DataFrame:
    return df.where(test)


def project(df: DataFrame, **columns: Column) -> DataFrame:
    """Reorder, drop and compute columns; a bag."""
    return df.select(*(c.alias(n) for n, c in columns.items()))


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Equi-join on columns of equal names: inner, left, left_semi or left_anti; without columns the cross product.

    strategy: None leaves the choice to Catalyst and AQE; "merge" and "shuffle_hash" ask for one; "broadcast" is followed only if
    right is counted to have at most BROADCAST_ROWS rows, and left to Catalyst beyond."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how}")
    if strategy == "broadcast":
        strategy = strategy if len(right.limit(BROADCAST_ROWS + 1).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS else None
    if strategy:
        right = right.hint(strategy)
    if on:
        return left.join(right, on, how)
    if how == "inner":
        return left.crossJoin(right)
    return left.join(right.limit(1).select(F.lit(1).alias("__there")), F.lit(True), how)


def chain(parts: list[DataFrame]) -> DataFrame:
    """A multiway natural join, each part joined on the columns it shares with those before."""
    return reduce(lambda a, b: join(a, b, [c for c in b.columns if c in a.columns]), parts)


def union(parts: list[DataFrame]) -> DataFrame:
    """Set union, n-ary."""
    return reduce(DataFrame.union, parts).distinct()


def distinct(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Set of rows; with keys one row, any, for each key."""
    return df.dropDuplicates(keys) if keys else df.distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that aren't in right."""
    return left.distinct().join(right, left.columns, "left_anti")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().join(right, left.columns, "left_semi")


def group(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Group by keys; aggregates: output -> (count, sum, min, max or logsumexp, column).

    Without aggregates the distinct keys.  Without keys one group, and none if there are no rows.  logsumexp is shifted by
    the group's maximum, which is aggregated first and joined, so both passes combine on the map side."""
    if not aggregates:
        return df.select(*keys).distinct()
    by = keys or ["__all"]
    rows = df if keys else df.withColumn("__all", F.lit(0))
    shifted = {n: c for n, (op, c) in aggregates.items() if op == "logsumexp"}
    if shifted:
        top = rows.groupBy(*by).agg(*(F.max(c).alias(f"__m_{n}") for n, c in shifted.items()))
        rows = rows.join(top, by)

    def one(n: str, op: str, c: str) -> Column:
        if op == "count":
            return F.count(F.lit(1)).alias(n)
        if op == "logsumexp":
            m = F.col(f"__m_{n}")
            shift = F.when(F.abs(m) == float("inf"), F.lit(0.0)).otherwise(m)
            return (F.max(shift) + F.log(F.sum(F.exp(F.col(c) - shift)))).alias(n)
        return {"sum": F.sum, "min": F.min, "max": F.max}[op](c).alias(n)

    return rows.groupBy(*by).agg(*(one(n, op, c) for n, (op, c) in aggregates.items())).select(*keys, *aggregates)


def masked_join(relations: list[DataFrame], mask: list[tuple[int, int, int]]) -> DataFrame:
    """Union over the mask's triples (i, j, k) of relations[i](x, y) joined with relations[j](y, z), labelled k: (k, x, z)."""
    parts = []
    for i, j, k in sorted(set(mask)):
        a, b = relations[i].toDF("x", "y"), relations[j].toDF("y", "z")
        parts.append(a.join(b, "y").select(F.lit(k).alias("k"), "x", "z"))
    if not parts:
        raise ValueError("the mask is empty")
    return union(parts)
