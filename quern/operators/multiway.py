"""Cyclic joins: triangles, four-cycles, cliques.

On one undirected relation every edge is turned from its endpoint of lower degree to that of higher degree, so no
out-degree exceeds the square root of twice the number of edges: the wedges that are built stay few even where a
hub touches a third of all edges.  Rows equal those of the plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.relation import hashed, stored
from . import candidates


#: From so many rows on, pairs are tested by a bitmap before they are shuffled.
MARKED_ROWS = 100_000


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, each once, without loops."""
    a, b = edges.columns[:2]
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def oriented(edges: DataFrame) -> tuple[DataFrame, int]:
    """(s, t), and how many: each undirected edge from lower to higher (degree, id); written, as it is read for every vertex of a clique."""
    e, _ = stored(undirected(edges))
    degree = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    both = e.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return stored(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("t")))


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """All k-cliques of an undirected relation, k = 3 to 8, as sorted columns v0 < v1 < ...

    Grown one vertex at a time along the orientation, each new vertex checked against all earlier ones by semi-joins; of many edges, a
    bitmap tests new vertices before they are shuffled."""
    if not 3 <= k <= 8:
        raise ValueError("k is 3 to 8")
    o, n_edges = oriented(edges)
    part = o.select(F.col("s").alias("x0"), F.col("t").alias("x1"))
    marks = candidates.Marks(o, n_edges) if n_edges >= MARKED_ROWS and candidates.plain(o) else None
    for n in range(2, k):
        step = o.toDF(f"x{n - 1}", f"x{n}")
        part = candidates.expand(part, step, f"x{n - 1}", f"x{n}", [(f"x{i}", marks) for i in range(n - 1)]) if marks else part.join(step, f"x{n - 1}")
        for i in range(n - 1):
            part = part.join(hashed(o.toDF(f"x{i}", f"x{n}"), n_edges), [f"x{i}", f"x{n}"], "left_semi")
    ordered = F.array_sort(F.array(*(f"x{i}" for i in range(k))))
    return part.select(*(ordered[i].alias(f"v{i}") for i in range(k)))


def triangles(edges: DataFrame) -> DataFrame:
    return cliques(edges, 3)


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(v, n): triangles at each vertex, aggregated without keeping the triangles."""
    t = triangles(edges).select(F.explode(F.array("v0", "v1", "v2")).alias("v"))
    return t.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def four_cycles(r1: DataFrame, r2: DataFrame, r3: DataFrame, r4: DataFrame) -> DataFrame:
    """(w, x, y, z) of r1(w, x), r2(x, y), r3(y, z), r4(z, w); the paths of two meet on both ends."""
    left = r1.toDF("w", "x").distinct().join(r2.toDF("x", "y").distinct(), "x")
    right = r3.toDF("y", "z").distinct().join(r4.toDF("z", "w").distinct(), "z")
    return left.join(right, ["w", "y"]).select(*"wxyz")


def four_cycle_counts(r1: DataFrame, r2: DataFrame, r3: DataFrame, r4: DataFrame, op: str | None = None) -> DataFrame:
    """(w, n): how many four_cycles there are at each w, with op those of x op z, counted without making them: both paths go to w's task
    as packed lists.  Columns are integers; a second path that is the first one again isn't made."""
    a, b, c, d = (r.select(*(F.col(f"`{x}`").cast("bigint") for x in r.columns)).distinct() for r in (r1.toDF("w", "x"), r2.toDF("x", "y"), r3.toDF("y", "z").select("z", "y"), r4.toDF("z", "w").select("w", "z")))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan()
    again = plan(a).sameResult(plan(d)) and plan(b).sameResult(plan(c))
    return candidates.cycle_counts((a, b), None if again else (d, c), op)
