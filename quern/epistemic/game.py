"""Games: w(X) :- move(X, Y), not w(Y).  A position is won if some move leads to a lost one, and lost if all lead to won ones.

Positions with one move are worth what its target isn't.  Such chains are followed by doubling, so a chain of n takes log2(n) jobs, and taken
out; the others settle step by step, and become chains as moves to won positions are dropped.  What is left is open: it
is neither won nor lost in the well-founded model, which for such programs is the least three-valued one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.relation import checkpoint, counted, stored


def _followed(one: DataFrame, rows: int) -> DataFrame:
    """(x, t, turn) of positions with one move: t the first position after x with none or several, turn whether x is worth what t isn't.

    Positions that run into a circle keep a t in it."""
    before = rows + 1
    while rows and rows != before:
        before, seen = rows, Observation()
        via = one.select(F.col("x").alias("t"), F.col("t").alias("__t"), F.col("turn").alias("__turn"))
        step = one.join(via, "t", "left").select("x", F.coalesce("__t", "t").alias("t"), F.when(F.col("__t").isNotNull(), F.col("turn") != F.col("__turn")).otherwise(F.col("turn")).alias("turn"), F.col("__t").isNotNull().alias("__on"))
        one = checkpoint(step.observe(seen, F.count_if("__on").alias("n"))).drop("__on")
        rows = int(seen.get["n"])
    return one


def not_lost(moves: DataFrame, sure: DataFrame | None = None) -> DataFrame:
    """(x): positions that are won or open; those of sure are won anyhow."""
    moves = moves.toDF("x", "t").where("x is not null and t is not null").distinct()
    won = sure.toDF("x").distinct() if sure is not None else moves.select("x").limit(0)
    left, n = counted(moves.join(won, "x", "left_anti").withColumn("turn", F.lit(True)))
    ends = moves.select(F.col("t").alias("x")).distinct().join(moves.select("x"), "x", "left_anti").join(won, "x", "left_anti")
    known = stored(won.withColumn("won", F.lit(True)).union(ends.withColumn("won", F.lit(False))))[0]
    chains = []
    while n:
        one, n_one = counted(left.groupBy("x").agg(F.count(F.lit(1)).alias("__n"), F.first("t").alias("t"), F.first("turn").alias("turn")).where("__n = 1").drop("__n"))
        if n_one:
            chain = _followed(one, n_one)
            chains.append(chain)
            via = chain.select(F.col("x").alias("t"), F.col("t").alias("__t"), F.col("turn").alias("__turn"))
            left = left.join(chain.select("x"), "x", "left_anti").join(via, "t", "left")
            left = left.select("x", F.coalesce("__t", "t").alias("t"), F.when(F.col("__t").isNotNull(), F.col("turn") != F.col("__turn")).otherwise(F.col("turn")).alias("turn")).distinct()
        told = left.join(known.select(F.col("x").alias("t"), "won"), "t", "left").select("x", "t", "turn", (F.col("won") != F.col("turn")).alias("good"))
        told, before = counted(told)
        fresh, n_fresh = counted(told.groupBy("x").agg(F.bool_or(F.coalesce("good", F.lit(False))).alias("won"), F.bool_and(F.coalesce(~F.col("good"), F.lit(False))).alias("__lost")).where("won or __lost").select("x", "won"))
        left, n = counted(told.where("good is null").drop("good").join(fresh.select("x"), "x", "left_anti"))
        if n_fresh:
            known = stored(known.union(fresh))[0]
        if n == before and not n_one:
            break
    for chain in reversed(chains):
        ends = known.select(F.col("x").alias("t"), "won")
        known = stored(known.union(chain.join(ends, "t").select("x", (F.col("won") != F.col("turn")).alias("won"))))[0]
    return moves.select("x").union(won).distinct().join(known.where("not won").select("x"), "x", "left_anti")
