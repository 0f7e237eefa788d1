"""Rule learning by gradients: soft masks over candidate rules, trained on which examples each candidate covers.

Spark finds the hits, one row for each (example, candidate) that covers it; the masks, one number for each candidate, are trained
on the driver over the examples' distinct hit patterns, counted by Spark, so many examples with few patterns stay small.
An example's prediction is the noisy-or of its candidates' masks.  Learnt rules are those whose mask is at least one half; ``evaluate`` tests
them on examples held out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QuernError
from . import TOPOLOGIES, _stacked

MAX_PATTERNS = 200_000

Candidate = tuple[str, int, int]  # topology, left, right


@dataclass(frozen=True)
class Learnt:
    masks: dict[Candidate, float]
    loss: float

    @property
    def rules(self) -> list[Candidate]:
        return [c for c, m in sorted(self.masks.items(), key=lambda x: (-x[1], x[0])) if m >= 0.5]


def hits(relations: list[DataFrame], examples: DataFrame, topologies: Iterable[str] = TOPOLOGIES) -> DataFrame:
    """(x, y, good, topology, left, right) of every candidate that covers an example (x, y, good)."""
    e, parts = examples.toDF("x", "y", "good").distinct(), []
    for t in topologies:
        left, right = (_stacked(relations, c, side) for c, side in zip(TOPOLOGIES[t], ("left", "right"), strict=True))
        if t in ("chain", "star"):
            rows = e.join(left, "x").join(right, ["z", "y"])
        else:
            near = "x" if t == "fanout" else "y"
            rows = e.join(left, ["x", "y"]).join(right.select(near, "right").distinct(), near)
        parts.append(rows.select("x", "y", "good", F.lit(t).alias("topology"), "left", "right").distinct())
    return reduce(DataFrame.union, parts)


def _patterns(relations, examples, topologies) -> DataFrame:
    """(good, n, rules): how many examples have each set of covering candidates."""
    e = examples.toDF("x", "y", "good").distinct()
    per = hits(relations, examples, topologies).groupBy("x", "y", "good").agg(F.sort_array(F.collect_list(F.struct("topology", "left", "right"))).alias("rules"))
    return e.join(per, ["x", "y", "good"], "left").groupBy("good", "rules").agg(F.count(F.lit(1)).alias("n"))


def train(relations: list[DataFrame], examples: DataFrame, topologies: Iterable[str] = TOPOLOGIES, steps: int = 400, rate: float = 0.1, sparsity: float = 0.01, seed: int = 0) -> Learnt:
    """Masks that explain examples (x, y, good: 1 or 0), by Adam on the log loss and the masks' sum."""
    rows = _patterns(relations, examples, list(topologies)).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise QuernError(f"more than {MAX_PATTERNS} patterns of coverage")
    names = sorted({tuple(c) for r in rows for c in r.rules or ()})
    at = {c: i for i, c in enumerate(names)}
    h, y, n = np.zeros((len(rows), len(names))), np.zeros(len(rows)), np.zeros(len(rows))
    for i, r in enumerate(rows):
        y[i], n[i] = r.good, r.n
        h[i, [at[tuple(c)] for c in r.rules or ()]] = 1
    n /= n.sum() or 1
    w = np.random.default_rng(seed).normal(-0.5, 0.01, len(names))
    m1, m2, loss = np.zeros_like(w), np.zeros_like(w), 0.0
    for step in range(1, steps + 1):
        mask = 1 / (1 + np.exp(-w))
        none = np.exp(h @ np.log1p(-np.minimum(mask, 1 - 1e-9)))
        p = np.clip(1 - none, 1e-6, 1 - 1e-6)
        loss = float(-(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + sparsity * mask.sum())
        by_p = n * (p - y) / (p * (1 - p))
        by_mask = ((by_p * none)[:, None] * h / np.maximum(1 - mask, 1e-9)[None, :]).sum(axis=0) + sparsity
        g = by_mask * mask * (1 - mask)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Learnt({c: float(x) for c, x in zip(names, 1 / (1 + np.exp(-w)), strict=True)}, loss)


def evaluate(learnt: Learnt, relations: list[DataFrame], examples: DataFrame) -> dict[str, float]:
    """Precision, recall and accuracy of the learnt rules on examples (x, y, good), counted by Spark."""
    e, chosen = examples.toDF("x", "y", "good").distinct(), learnt.rules
    if chosen:
        on = reduce(lambda a, b: a | b, ((F.col("topology") == t) & (F.col("left") == i) & (F.col("right") == j) for t, i, j in chosen))
        found = hits(relations, examples, {t for t, _, _ in chosen}).where(on).select("x", "y").distinct().withColumn("said", F.lit(1))
        e = e.join(found, ["x", "y"], "left")
    else:
        e = e.withColumn("said", F.lit(0))
    said = F.coalesce("said", F.lit(0))
    r = e.agg(F.sum(said * F.col("good")).alias("tp"), F.sum(said).alias("pos"), F.sum("good").alias("good"), F.sum((said == F.col("good")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    return {"precision": (r.tp or 0) / max(1, r.pos or 0), "recall": (r.tp or 0) / max(1, r.good or 0), "accuracy": (r.right or 0) / max(1, r.n)}
