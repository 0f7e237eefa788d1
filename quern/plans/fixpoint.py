"""Semi-naive evaluation of recursive components.

Each round evaluates, for every rule and every recursive literal of it, the variant that reads the last
round's new tuples there and everything known elsewhere; what is new is kept, until nothing is.  New tuples
are cut from their lineage by reliable checkpoints, so plans stay small and a lost executor costs
nothing; what is known is a union of blocks, merged as they grow.

Components along paths are walked in one job where edges form small connected parts (``paths``); the rest is for what follows of them.

The closure of one relation (p = e, p = p joined with e or with p) doubles instead: new tuples join all that is known, so a path of n
steps takes log2(n) rounds.  As a path is then derived once for each way to cut it, rounds whose
new tuples are more than ``DOUBLING_ROWS`` go on one step at a time, which is right from any round on.

What the rules read beside their own predicates is written once, unless it is a mere scan.  A round is one job for each predicate, which
also counts; those of one component run side by side.  Under AQE such a job becomes several; while all that it reads is known to be small
it is planned without; threads of one session take turns there."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RecursionLimit
from ..lang.ast import ANON, Atom, Rule, Var
from ..lang.passes import BUILTINS
from ..lang.stratify import Key, key, uses
from . import paths
from .relation import Relation, checkpoint, counted, empty, ensure_checkpoint_dir, estimated_bytes, written
from .rules import Lookup, compile_rule

MAX_ROUNDS, COMPACT, DOUBLING_ROWS, SMALL_ROWS, SMALL_BYTES = 1_000_000, 6, 20_000_000, 1_000_000, 1 << 27


def all_counted(dfs: dict[Key, DataFrame]) -> dict[Key, tuple[DataFrame, int]]:
    """Checkpoints and counts, the jobs side by side."""
    if len(dfs) < 2:
        return {k: counted(df) for k, df in dfs.items()}
    with ThreadPoolExecutor(min(8, len(dfs))) as pool:
        return dict(zip(dfs, pool.map(counted, dfs.values()), strict=True))


def closure_of(k: Key, rules: list[Rule]) -> int | None:
    """The position of p in the step of p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), e(Y, Z). (or e first), if that is all of p."""
    if k[1] != 2 or len(rules) != 2 or any(len(set(r.head.args)) != 2 or not all(isinstance(a, Var) for a in r.head.args) for r in rules):
        return None
    base, step = sorted(rules, key=lambda r: len(r.body))
    if len(base.body) != 1 or len(step.body) != 2 or not all(isinstance(x, Atom) and len(x.args) == 2 for x in (*base.body, *step.body)):
        return None
    e, (x, y) = base.body[0], step.body
    at = 0 if key(x) == k else 1
    joined = x.args[1] == y.args[0] and isinstance(x.args[1], Var) and x.args[1].name != ANON and (x.args[0], y.args[1]) == step.head.args and len({*step.head.args, x.args[1]}) == 3
    return at if joined and e.args == base.head.args and {key(x), key(y)} == {k, key(e)} and key(e) != k else None


def linear(k: Key, rules: list[Rule]) -> list[Rule]:
    """p(X, Z) :- p(X, Y), p(Y, Z). beside p(X, Y) :- e(X, Y). means the same with e for the second p."""
    if len(rules) != 2 or any(r.aggregates for r in rules):
        return rules
    base, step = sorted(rules, key=lambda r: len(r.body))
    if len(base.body) != 1 or len(step.body) != 2 or not all(isinstance(x, Atom) for x in (*base.body, *step.body)) or any(key(x) != k for x in step.body):
        return rules
    new = Rule(step.head, (step.body[0], Atom(base.body[0].name, step.body[1].args)), step.mask)
    return [base, new] if closure_of(k, [base, new]) is not None else rules


_PLANNING = RLock()


@contextmanager
def settings(spark: SparkSession, large: bool):
    """Plan a round over few rows as one job with few partitions; if it may be large, all is left to AQE.

    One thread at a time changes the session, and puts back what it found."""
    if large:
        yield
        return
    with _PLANNING:
        few = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))}
        before = {k: spark.conf.get(k) for k in few}
        try:
            for k, v in few.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)


class Blocks:
    """What is known of a predicate: disjoint checkpointed blocks, and how many rows they have.

    When there are more than COMPACT, the newest are merged, back to one that is much larger than they are
    together; so a row is written again a logarithmic number of times only."""

    def __init__(self, blocks: list[tuple[DataFrame, int]], types: tuple[str, ...], nothing: DataFrame):
        self.blocks, self.types, self.nothing = blocks, types, nothing

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.blocks)

    @property
    def relation(self) -> Relation:
        return Relation(reduce(DataFrame.union, (df for df, _ in self.blocks)) if self.blocks else self.nothing, self.types)

    def add(self, df: DataFrame, rows: int) -> None:
        self.blocks.append((df, rows))
        if len(self.blocks) > COMPACT:
            at = len(self.blocks) - 2
            while at and self.blocks[at - 1][1] <= 2 * sum(n for _, n in self.blocks[at:]):
                at -= 1
            parts = self.blocks[at:]
            # blocks that are partitioned alike are merged partition by partition, others by as many as the widest has
            widest = max(b.rdd.getNumPartitions() for b, _ in parts)
            united = reduce(DataFrame.union, (b for b, _ in parts))
            merged = checkpoint(united if united.rdd.getNumPartitions() <= widest else united.coalesce(widest))
            self.blocks = [*self.blocks[:at], (merged, sum(n for _, n in parts))]


def _squared(new: DataFrame, full: DataFrame) -> DataFrame:
    """Every path of a new and a known one; a shortest path of up to twice the steps has such a cut."""
    return new.toDF("c0", "via").join(full.toDF("via", "c1"), "via").select("c0", "c1")


def _new(made: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """The distinct tuples made that aren't known.

    Small rounds group both by all columns: blocks keep the hash partitioning of the round that made them, so what is known isn't shuffled again."""
    if not small:
        return made.join(known, made.columns, "left_anti")
    both = known.select("*", F.lit(False).alias("fresh")).union(made.select("*", F.lit(True).alias("fresh")))
    return both.groupBy(*made.columns).agg(F.bool_and("fresh").alias("fresh")).where("fresh").select(*made.columns)


def solve(
    part: list[Key], rules: list[Rule], spark: SparkSession, types: dict[Key, tuple[str, ...]], known: Lookup, base: dict[Key, Relation],
    limit: int = MAX_ROUNDS, strict: bool = False, seeds: dict[Key, DataFrame] | None = None,
) -> tuple[dict[Key, Relation], int]:
    """(relations of the predicates of one component, rounds).

    base holds their facts, or, with seeds (new tuples of a run before), all that is known already."""
    inside = set(part)
    outer, once = known, {}

    def known(k: Key, i: int) -> Relation:
        if k not in once:
            once[k] = written(outer(k, i))
        return once[k]

    own = {k: [r for r in rules if key(r.head) == k] for k in part}
    if len(part) == 1 and seeds is None and part[0] not in base:
        own = {k: linear(k, rs) for k, rs in own.items()}
    rules = [r for rs in own.values() for r in rs]
    walked: dict[Key, DataFrame] = {}
    walks = 0
    if seeds is None and limit >= MAX_ROUNDS and not any(k in base for k in part) and (found := paths.solve(part, rules, types, outer)):
        walked, left, walks = found
        if left is None:
            return {k: Relation(df, types[k]) for k, df in walked.items()}, walks
        once.update({k: written(r) for k, r in left.items()})

    def variant(rule: Rule, at: int | None, delta: dict[Key, Relation], full: dict[Key, Relation]) -> DataFrame:
        def lookup(k: Key, i: int) -> Relation:
            return delta[k] if i == at else full[k] if k in inside else known(k, i)

        return compile_rule(rule, spark, types, lookup, first=at, strict=strict)

    state = {k: base.get(k) or empty(spark, types[k]) for k in part}
    beside = [known(d, 0).df for d in {d for r in rules if key(r.head) in inside for d, _ in uses(r)} - inside if d not in BUILTINS]
    wide = sum(map(estimated_bytes, beside)) > SMALL_BYTES
    if seeds is None:
        start = [k for k in part if k in base or any(all(key(x) not in inside for x in r.body if isinstance(x, Atom)) for r in own[k])]
        with settings(spark, wide):
            done = all_counted({k: reduce(DataFrame.union, [state[k].df, *(variant(r, None, {}, state) for r in own[k])] if k in base else [variant(r, None, {}, state) for r in own[k]]).distinct() for k in start})
        first = {k: done[k][0] if k in done else state[k].df for k in part}
        counts = {k: done[k][1] if k in done else 0 for k in part}
        full = {k: Blocks([(first[k], counts[k])] if k in done else [], types[k], state[k].df) for k in part}
        delta = {k: Relation(first[k], types[k]) for k in part}
    else:
        delta = {k: Relation(seeds.get(k, empty(spark, types[k]).df), types[k]) for k in part}
        counts = {k: delta[k].df.count() for k in part}
        full = {k: Blocks([(state[k].df, state[k].df.count()), (delta[k].df, counts[k])], types[k], state[k].df) for k in part}
    rounds, doubled = 0, None
    if len(part) == 1 and seeds is None and part[0] not in base:
        doubled = closure_of(part[0], own[part[0]])
    live = {k for k in part if counts[k]}
    while live:
        rounds += 1
        if rounds > limit:
            raise RecursionLimit(f"{part[0][0]} took more than {limit} rounds")
        now = {k: full[k].relation for k in part}
        fresh: dict[Key, DataFrame] = {}
        if doubled is not None and counts[part[0]] > DOUBLING_ROWS:
            doubled = None
        small = not wide and sum(f.rows for f in full.values()) <= SMALL_ROWS
        with settings(spark, not small):
            for k in part:
                if doubled is not None:
                    made = [_squared(delta[k].df, now[k].df)]
                else:
                    made = [variant(r, at, delta, now) for r in own[k] for at, x in enumerate(r.body) if isinstance(x, Atom) and key(x) in live]
                if made:
                    new = reduce(DataFrame.union, made).distinct()
                    fresh[k] = _new(new, now[k].df, small) if full[k].blocks else new
            done = all_counted(fresh)
            fresh, counts = {k: df for k, (df, _) in done.items()}, {k: n for k, (_, n) in done.items()}
            delta = {k: Relation(fresh[k], types[k]) if k in fresh else empty(spark, types[k]) for k in part}
            live = {k for k in fresh if counts[k]}
            for k in live:
                full[k].add(fresh[k], counts[k])
    out = {k: full[k].relation for k in part}
    return {k: Relation(walked[k].union(r.df), r.types) if k in walked else r for k, r in out.items()}, walks + rounds


__all__ = ["MAX_ROUNDS", "checkpoint", "ensure_checkpoint_dir", "solve"]
