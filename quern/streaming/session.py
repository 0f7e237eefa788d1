"""Sessions: relations that are kept, changed by batches of deltas, and re-derived where they must be.

A batch deletes first, then inserts, with set semantics; what cancels out is no change.  After a change, components that
(directly or not) depend on changed relations are affected.  Where rows were only inserted and no negation,
aggregation or findall lies in a component's rules, it goes on from its known rows with the new ones as seeds;
all other affected components are computed anew from their inputs.  Retained relations are checkpointed."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Compiled, Engine, Result
from ..errors import QuernError
from ..functions.scalar import wrapping
from ..lang.ast import Atom, Not
from ..lang.stratify import Key, key, uses
from ..plans.fixpoint import checkpoint
from ..plans.relation import Relation, empty, given
from ..plans.rules import compile_rule


@dataclass
class DeltaStats:
    changed_relations: int = 0
    inserted: int = 0
    deleted: int = 0
    affected: int = 0
    recomputed: int = 0
    incremental: int = 0


@dataclass
class Delta:
    """Rows to delete and to insert."""

    insert: DataFrame | None = None
    delete: DataFrame | None = None

    def then(self, later: Delta) -> Delta:
        """Both in turn, as one."""
        def both(a, b):
            return b if a is None else a if b is None else a.union(b).distinct()

        kept = self.insert if self.insert is None or later.delete is None else self.insert.join(later.delete, self.insert.columns, "left_anti")
        return Delta(both(kept, later.insert), both(self.delete, later.delete))


@dataclass
class Temporal:
    """What is known of a relation's time: recorded, without meaning for evaluation."""

    column: str
    lineage: list[str] = field(default_factory=list)


class Session:
    """One program over relations that stay."""

    def __init__(self, engine: Engine, program: str | Compiled, inputs: dict[str, DataFrame] | None = None, modules=None):
        self.engine, self.program, self.modules = engine, program, modules
        self.stored: dict[str, DataFrame] = {}
        self.known: dict[Key, Relation] | None = None
        self.compiled: Compiled | None = program if isinstance(program, Compiled) else None
        self.callbacks: list[tuple[str | None, Callable[[str, DeltaStats], None]]] = []
        self.temporal: dict[str, Temporal] = {}
        self._pool = ThreadPoolExecutor(4)
        for n, df in (inputs or {}).items():
            self.put(n, df)

    # ---- the store
    def put(self, name: str, df: DataFrame) -> None:
        """Set a relation, whole."""
        self.stored[name] = checkpoint(df.distinct())
        self.known = None

    def export(self, name: str) -> DataFrame:
        if name in self.stored:
            return self.stored[name]
        if self.known is None:
            self.evaluate()
        found = [r for k, r in self.known.items() if k[0] == name]
        if len(found) != 1:
            raise QuernError(f"there is no one relation {name}")
        return found[0].df

    def remove(self, name: str) -> None:
        if self.stored.pop(name, None) is not None:
            self.known = None

    def clear(self) -> None:
        self.stored.clear()
        self.known = None

    def relations(self) -> list[str]:
        return sorted(self.stored)

    def mark_temporal(self, name: str, column: str, *lineage: str) -> None:
        self.temporal[name] = Temporal(column, list(lineage))

    # ---- evaluation
    def evaluate(self) -> Result:
        if self.known is None or self.compiled is None:
            self.compiled = self.program if isinstance(self.program, Compiled) else self.engine.compile(self.program, self.stored, self.modules)
            with wrapping(self.engine.spark):
                known = self.engine.base(self.compiled, self.stored)
                components = [self.engine.evaluate(self.compiled, part, again, known) for part, again in self.compiled.order]
                self.known = {k: Relation(checkpoint(r.df), r.types) for k, r in known.items()}
                self.engine.check(self.compiled, self.known)
            return Result(self.compiled, self.known, components)
        return Result(self.compiled, self.known, [])

    def evaluate_async(self) -> Future:
        return self._pool.submit(self.evaluate)

    def equivalent(self) -> bool:
        """Whether all derived relations equal those of a full computation."""
        now = self.known or {}
        full = self.engine.run(self.compiled or self.program, self.stored, check=False).relations
        for k, r in full.items():
            mine = now.get(k)
            if mine is None or not r.df.exceptAll(mine.df).isEmpty() or not mine.df.exceptAll(r.df).isEmpty():
                return False
        return True

    # ---- changes
    def insert(self, name: str, rows: DataFrame) -> DeltaStats:
        return self.apply({name: Delta(insert=rows)})

    def delete(self, name: str, rows: DataFrame) -> DeltaStats:
        return self.apply({name: Delta(delete=rows)})

    def on_change(self, callback: Callable[[str, DeltaStats], None], name: str | None = None) -> Callable[[], None]:
        """Call back after each commit that changes name (None: anything), in order of registration; returns what unregisters."""
        entry = (name, callback)
        self.callbacks.append(entry)
        return lambda: self.callbacks.remove(entry)

    def apply(self, batch: dict[str, Delta] | list[tuple[str, Delta]]) -> DeltaStats:
        """Apply a batch; deltas of one relation are merged first.  If it fails, the stored relations are as before
        and what was derived is dropped."""
        merged: dict[str, Delta] = {}
        for name, d in batch.items() if isinstance(batch, dict) else batch:
            merged[name] = merged[name].then(d) if name in merged else d
        if self.known is None and self.stored:
            self.evaluate()
        stats, before = DeltaStats(), dict(self.stored)
        added: dict[Key, DataFrame] = {}
        gone: set[Key] = set()
        try:
            for name, d in merged.items():
                self._change(name, d, stats, added, gone)
            if stats.changed_relations and self.known is not None:
                with wrapping(self.engine.spark):
                    self._derive(added, gone, stats)
        except Exception:
            self.stored, self.known = before, None
            raise
        if stats.changed_relations:
            changed = sorted({k[0] for k in added} | {k[0] for k in gone})
            for wanted, call in list(self.callbacks):
                for name in changed:
                    if wanted in (None, name):
                        call(name, stats)
        return stats

    def _change(self, name: str, d: Delta, stats: DeltaStats, added: dict[Key, DataFrame], gone: set[Key]) -> None:
        base = self.stored.get(name)
        if base is None:
            source = d.insert if d.insert is not None else d.delete
            base = source.limit(0)
        cols = base.columns
        shape = lambda df: df.select(*(F.col(f"`{c}`").cast(t).alias(n) for c, (n, t) in zip(df.columns, base.dtypes, strict=True))).distinct()
        insert = shape(d.insert) if d.insert is not None else base.limit(0)
        delete = shape(d.delete) if d.delete is not None else base.limit(0)
        out = checkpoint(base.join(delete, cols, "left_semi").join(insert, cols, "left_anti"))
        new = checkpoint(insert.join(base, cols, "left_anti"))
        n_out, n_new = out.count(), new.count()
        if not n_out and not n_new:
            return
        self.stored[name] = checkpoint(base.join(out, cols, "left_anti").union(new))
        stats.changed_relations, stats.deleted, stats.inserted = stats.changed_relations + 1, stats.deleted + n_out, stats.inserted + n_new
        k = (name, len(cols))
        if n_new:
            added[k] = new
        if n_out:
            gone.add(k)

    def _derive(self, added: dict[Key, DataFrame], gone: set[Key], stats: DeltaStats) -> None:
        c, known, engine = self.compiled, dict(self.known), self.engine
        base = engine.base(c, self.stored)
        inserted = {k: given(df, c.types.get(k)).df for k, df in added.items()}
        again: set[Key] = set(gone)  # changed in other ways than by more rows
        changed = set(inserted) | again
        derived = {k for part, _ in c.order for k in part}
        for k in changed - derived:
            known[k] = base[k] if k in base else empty(engine.spark, c.types.get(k, self.known[k].types if k in self.known else ()))
        for part, recursive in c.order:
            inside = set(part)
            rules = [r for r in c.rules if key(r.head) in inside]
            needs = {d: monotone for r in rules for d, monotone in uses(r)}
            touched = (set(needs) | inside) & changed
            if not touched:
                continue
            stats.affected += 1
            plain = all(isinstance(x, Atom) and x.name != "findall" or not isinstance(x, (Atom, Not)) for r in rules for x in r.body) and not any(r.aggregates for r in rules)
            if touched & again or not plain:
                stats.recomputed += 1
                for k in part:
                    known.pop(k, None)
                    if k in base:
                        known[k] = base[k]
                engine.evaluate(c, part, recursive, known)
                for k in part:
                    known[k] = Relation(checkpoint(known[k].df), known[k].types)
                again |= inside
            else:
                stats.incremental += 1
                seeds = self._seeds(part, rules, known, inserted)
                for k in part:
                    if k not in known:
                        known[k] = empty(engine.spark, c.types[k])
                if recursive and seeds:
                    old = {k: known[k] for k in part}
                    engine.evaluate(c, part, True, known, seeds)
                    for k in part:
                        known[k] = Relation(checkpoint(known[k].df), known[k].types)
                        inserted[k] = checkpoint(known[k].df.join(old[k].df, known[k].df.columns, "left_anti"))
                else:
                    for k, df in seeds.items():
                        known[k] = Relation(checkpoint(known[k].df.union(df)), known[k].types)
                        inserted[k] = df
            changed |= inside
        self.known = known
        engine.check(c, known)

    def _seeds(self, part: list[Key], rules: list, known: dict[Key, Relation], inserted: dict[Key, DataFrame]) -> dict[Key, DataFrame]:
        """New rows of a component's predicates that use at least one inserted row of another, or are inserted themselves."""
        c, out = self.compiled, {}
        for k in part:
            made = [inserted[k]] if k in inserted else []
            for r in rules:
                if key(r.head) != k:
                    continue
                for at, x in enumerate(r.body):
                    if isinstance(x, Atom) and key(x) in inserted and key(x) not in part:
                        find = self.engine.lookup(c, known)
                        look = lambda q, i, at=at, find=find: Relation(inserted[q], c.types[q]) if i == at else find(q, i)
                        made.append(compile_rule(r, self.engine.spark, c.types, look, first=at, strict=self.engine.options.strict))
            if made:
                df = reduce(DataFrame.union, made).distinct()
                if k in known:
                    df = df.join(known[k].df, df.columns, "left_anti")
                out[k] = checkpoint(df)
        return {k: df for k, df in out.items() if not df.isEmpty()}


def feed(session: Session, stream: DataFrame, name: str, operation: str | None = None):
    """A streaming query that applies each micro-batch of ``stream`` to a relation of the session.

    operation: a column that says "delete" for rows to delete; without it all rows are inserted.  The writer is
    returned, to be given a checkpoint location and started; as deltas are sets, a batch that comes again changes nothing."""
    def apply(batch: DataFrame, _: int) -> None:
        if operation is None:
            session.apply({name: Delta(insert=batch)})
            return
        gone = F.col(operation) == "delete"
        session.apply({name: Delta(insert=batch.where(~gone).drop(operation), delete=batch.where(gone).drop(operation))})

    return stream.writeStream.foreachBatch(apply)
