"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``statistics`` are Spark columns of a text: sizes, shares of capitals, symbols, digits and marks, repetition of
   words and lines.
2. Small regression trees are boosted on the logistic loss over at most ``MAX_TRAIN`` labelled rows (those of the
   least hash of their id); every path from a root to a node is a conjunctive rule.
3. A lasso logistic regression over the rules leaves few of them a weight.
4. ``compiled`` makes one Spark column expression of these, so that scoring stays in the JVM.

Only rows whose crc32(id as text) mod 5 isn't 0 train; of these every fifth by hash chooses the lasso
strength.  Ids, languages, sources and labels are no inputs of a score.

Defined results: null and empty texts have all statistics 0 and are scored as such; without
labels of both kinds the score is the share of label 1 (0.5 without labels); labels that are null or
whose document is absent teach nothing; repeated labels count again; repeated documents give repeated rows; a null
id is never held out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

MAX_TRAIN, HELD_OUT, KEEP = 20_000, 5, 0.3
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 40, 3, 0.3, 48, 10


def statistics(text: Column) -> dict[str, Column]:
    """name -> column of doubles; ``prepared`` gives what they read."""
    n = F.greatest(F.lit(1), F.length(text))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / n
    words, lines = F.col("_words"), F.col("_lines")
    n_words, n_lines = F.greatest(F.lit(1), F.size(words)), F.greatest(F.lit(1), F.size(lines))
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(text) / n_words,
        "upper": without(r"\p{Lu}+"),
        "symbols": without(r"[#$%&*|@^~=<>_{}\[\]\\+]+"),
        "marks": without(r"[!?]+"),
        "stops": without(r"[.,;:]+"),
        "digits": without(r"[0-9]+"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_length": F.length(text) / n_lines,
    }


def with_statistics(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The keep columns and every statistic, named s_*."""
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    empty = F.array().cast("array<string>")
    full = F.length("_text") > 0
    rows = rows.withColumns({"_words": F.when(full, F.split(F.trim("_text"), r"\s+")).otherwise(empty), "_lines": F.when(full, F.split("_text", "\n")).otherwise(empty)})
    names = [c for c in rows.columns if c not in ("_text", "_words", "_lines")]
    return rows.select(*names, *(c.cast("double").alias(f"s_{k}") for k, c in statistics(F.col("_text")).items()))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, limit, above): above: value > limit, else value <= limit."""

    conditions: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, limit, above in self.conditions:
            out &= (x[:, j] > limit) == above
        return out


@dataclass
class Ensemble:
    names: list[str]
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    held_out_loss: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))


def _grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> list[tuple[Rule, float]]:
    """The nodes of one tree below its root, as rules with their Newton steps; leaves first are those of greatest depth."""
    out: list[tuple[Rule, float]] = []

    def split(rows: np.ndarray, conditions: tuple, depth: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        if conditions:
            out.append((Rule(conditions), -g / (h + 1.0)))
        if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
            return
        best = (1e-6, None)
        for j, edges in enumerate(cuts):
            if not len(edges):
                continue
            at = np.searchsorted(edges, x[rows, j], side="left")  # bin i: <= edges[i]
            gs, hs, ns = (np.bincount(at, w, len(edges) + 1).cumsum()[:-1] for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
            gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), (j, float(edges[i])))
        if best[1] is None:
            return
        j, limit = best[1]
        above = x[rows, j] > limit
        split(rows[~above], (*conditions, (j, limit, False)), depth + 1)
        split(rows[above], (*conditions, (j, limit, True)), depth + 1)

    split(np.arange(len(x)), (), 0)
    return out


def _rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The rules of boosted trees, without repetition."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    z, found = np.full(len(x), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        nodes = _grow(x, cuts, p - y, p * (1 - p))
        if not nodes:
            break
        inner = {r.conditions[:-1] for r, _ in nodes}
        for rule, step in nodes:
            found.setdefault(frozenset(rule.conditions), rule)
            if rule.conditions not in inner:
                z += RATE * step * rule.holds(x)
    return list(found.values())


def _lasso(a: np.ndarray, y: np.ndarray, strength: float, start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Accelerated proximal gradient; the last weight is the intercept, without penalty."""
    n = len(a)
    lipschitz = 0.25 * np.linalg.eigvalsh(a.T @ a)[-1] / n + 1e-9
    w, v, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ v)))
        new = v - a.T @ (p - y) / n / lipschitz
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - strength / lipschitz)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def train(names: list[str], x: np.ndarray, y: np.ndarray) -> Ensemble:
    """An ensemble of rows x, whose order is random, and labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Ensemble(names, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    fold = np.arange(len(y)) % 5 == 0
    if y[~fold].min() == y[~fold].max():
        fold = np.zeros(len(y), bool)
    rules = _rules(x[~fold], y[~fold])
    a = np.column_stack([*(r.holds(x) for r in rules), np.ones(len(x))]).astype(np.float64)
    w, best = np.zeros(a.shape[1]), (np.inf, None)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    seen, on = a[~fold], fold if fold.any() else ~fold
    for strength in (1e-2, 3e-3, 1e-3, 3e-4):
        w = _lasso(seen, y[~fold], strength, w)
        p = np.clip(1 / (1 + np.exp(-(a[on] @ w))), 1e-9, 1 - 1e-9)
        loss = float(-(y[on] * np.log(p) + (1 - y[on]) * np.log(1 - p)).mean())
        if loss < best[0] - 1e-4:
            best = (loss, w.copy())
    w = best[1]
    return Ensemble(names, float(w[-1]), [(r, float(b)) for r, b in zip(rules, w[:-1], strict=True) if abs(b) > 1e-9], best[0])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Ensemble:
    """Learn from at most max_train labelled rows, whose ids aren't held out."""
    given = labels.select(F.col(key).cast("bigint").alias("_id"), F.col(label).cast("double").alias("_y")).where("_id is not null and _y is not null")
    order = F.xxhash64("_id")
    given = given.where(~held_out(F.col("_id")))
    n = given.count()
    if n > max_train:  # a hash limit first, so that no task sends many more rows than are needed
        given = given.where(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) <= 1.2 * max_train / n)
    chosen = given.orderBy(order, "_id", "_y").limit(max_train)
    # at most max_train rows of two numbers: broadcast
    joined = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")
    names = list(statistics(F.lit("")))
    rows = with_statistics(joined, "_t", [order.alias("_o"), F.col("_id"), F.col("_y")]).orderBy("_o", "_id", "_y", *(f"s_{k}" for k in names)).limit(2 * max_train).toPandas()
    return train(names, rows[[f"s_{k}" for k in names]].to_numpy(np.float64), (rows["_y"].to_numpy() > 0.5).astype(np.float64))


def compiled(model: Ensemble) -> Column:
    """The score as one expression over the s_* columns."""
    z = F.lit(model.intercept)
    for rule, w in model.rules:
        holds = None
        for j, limit, above in rule.conditions:
            c = F.col(f"s_{model.names[j]}")
            test = c > limit if above else c <= limit
            holds = test if holds is None else holds & test
        z = z + F.when(holds, w).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def scored(docs: DataFrame, model: Ensemble, keep: list[Column], text: str = "text") -> DataFrame:
    """The keep columns and score."""
    rows = with_statistics(docs, text, keep)
    return rows.select(*(c for c in rows.columns if not c.startswith("s_")), compiled(model).alias("score"))


def kept(docs: DataFrame, model: Ensemble, text: str = "text", least: float = KEEP) -> DataFrame:
    """docs without those that score below least."""
    row = F.struct(*map(quoted, docs.columns)).alias("_row")
    return scored(docs, model, [row], text).where(F.col("score") >= least).select("_row.*")
