"""Exact rule induction: all two-atom rules over binary relations, ranked by coverage.

A candidate is a topology and two relations; its bindings (x, y) come from one join, and its coverage is how many of the positive and
negative examples are among them.  All candidates of one topology are counted in one pass: relations are stacked with
their index, joined, cut to the examples before anything is kept, and counted.

Ranking: more positives, fewer negatives, lower left index, lower right index; candidates without positives are
dropped, but ties are counted over all candidates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: topology -> (columns of the left relation, of the right one) among x, y, z
TOPOLOGIES = {
    "chain": (("x", "z"), ("z", "y")),  # h(x, y) :- left(x, z), right(z, y)
    "star": (("z", "x"), ("z", "y")),
    "fanout": (("x", "y"), ("x", "z")),
    "fanin": (("x", "y"), ("z", "y")),
}


def _stacked(relations: list[DataFrame], columns: tuple[str, str], label: str) -> DataFrame:
    parts = [r.toDF(*columns).distinct().withColumn(label, F.lit(i)) for i, r in enumerate(relations)]
    return reduce(DataFrame.union, parts)


def coverage(relations: list[DataFrame], positives: DataFrame, negatives: DataFrame, topologies: Iterable[str] = TOPOLOGIES) -> DataFrame:
    """(topology, left, right, pos, neg) of every candidate, uncovered ones included."""
    examples = positives.toDF("x", "y").distinct().withColumn("good", F.lit(1)).union(negatives.toDF("x", "y").distinct().withColumn("good", F.lit(0)))
    spark, n = positives.sparkSession, len(relations)
    parts = []
    for t in topologies:
        left, right = (_stacked(relations, c, side) for c, side in zip(TOPOLOGIES[t], ("left", "right"), strict=True))
        # examples first: what no example asks for is never built
        if t == "chain":
            rows = examples.join(left, "x").join(right, ["z", "y"])
        elif t == "star":
            rows = examples.join(left, "x").join(right, ["z", "y"])
        elif t == "fanout":
            rows = examples.join(left, ["x", "y"]).join(right.select("x", "right").distinct(), "x")
        else:
            rows = examples.join(left, ["x", "y"]).join(right.select("y", "right").distinct(), "y")
        hit = rows.select("x", "y", "good", "left", "right").distinct()
        counted = hit.groupBy("left", "right").agg(F.sum("good").alias("pos"), F.sum(1 - F.col("good")).alias("neg"))
        # the grid of candidates: the square of the number of relations, not of their rows
        grid = spark.range(n * n).select((F.col("id") / n).cast("int").alias("left"), (F.col("id") % n).cast("int").alias("right"))
        full = grid.join(counted, ["left", "right"], "left").select(F.lit(t).alias("topology"), "left", "right", F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"), F.coalesce("neg", F.lit(0)).cast("bigint").alias("neg"))
        parts.append(full)
    return reduce(DataFrame.union, parts)


def induce(relations: list[DataFrame], positives: DataFrame, negatives: DataFrame, top: int = 1, topologies: Iterable[str] = TOPOLOGIES) -> DataFrame:
    """(topology, rank, left, right, pos, neg, next_pos, next_neg, tied): the best candidates of each topology.

    next_* are those of the next candidate kept; tied is the number of candidates, of any coverage, with equal counts."""
    scored = coverage(relations, positives, negatives, topologies)
    tied = scored.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy("topology", "pos", "neg")))
    ranking = Window.partitionBy("topology").orderBy(F.desc("pos"), "neg", "left", "right")
    kept = tied.where("pos > 0").withColumn("rank", F.row_number().over(ranking))
    kept = kept.withColumn("next_pos", F.lead("pos").over(ranking)).withColumn("next_neg", F.lead("neg").over(ranking))
    return kept.where(F.col("rank") <= top).select("topology", "rank", "left", "right", "pos", "neg", "next_pos", "next_neg", "tied")
