"""Recursion along paths, evaluated beside the edges.

A component is regular if its rules are p(X, Y) :- e(X, Y). and p(X, Z) :- q(X, Y), e(Y, Z). (or all of them with e first), with p and q of the
component and e from outside: its tuples are the ends of walks whose edges lead an automaton from state to state, one state a predicate.  Such a walk never leaves
its connected part of the graph, so the edges of each part go to one task, which walks from every node; no tuple that is made is shuffled or
compared with what other tasks know.  A round-wise evaluation shuffles all that is known in every round.

Connected parts: a task contracts the edges that reach it together; what these pieces share is contracted further, by random choice of a
neighbour while it is large (each round leaves a constant share of the nodes, expected), then in one task.  Parts of more than ``PART_EDGES`` edges aren't walked here:
their edges are handed back for evaluation in rounds, as all are if an end is null."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import INTEGERS, spark_type
from ..lang.ast import ANON, Atom, Rule, Var
from ..lang.passes import BUILTINS
from ..lang.stratify import Key, key
from .relation import Relation, counted, estimated_bytes, stored

#: Edges that are worth it, by Catalyst's estimate; edges of a part, contracted at once, and of what one task contracts; cells that a walk marks at once.
LEAST_BYTES, PART_EDGES, CHUNK_EDGES, TASK_EDGES, CELLS = 1 << 18, 4096, 1 << 19, 1 << 20, 1 << 21
#: Edges that a task walks at once, if parts end there; rows of an Arrow batch.
BLOCK_EDGES, ROWS = 1 << 15, 1 << 16
FEW_ROWS = 200_000


@dataclass(frozen=True)
class Automaton:
    edges: tuple[Key, ...]
    starts: tuple[tuple[int, int], ...]  # (edge, state)
    moves: tuple[tuple[int, int, int], ...]  # (state, edge, state)
    backward: bool  # e comes first: walks are made from their ends


def automaton(part: list[Key], rules: list[Rule], types: dict[Key, tuple[str, ...]]) -> Automaton | None:
    """Of a regular component whose nodes all have one type, with integers or symbols."""
    edges: list[Key] = []
    starts, moves, ways = [], [], set()

    def edge(k: Key) -> int:
        if k not in edges:
            edges.append(k)
        return edges.index(k)

    state = {k: i for i, k in enumerate(part)}
    for r in (r for r in rules if key(r.head) in state):
        if r.aggregates or not all(isinstance(x, Atom) and key(x) not in BUILTINS and len(x.args) == 2 for x in (r.head, *r.body)):
            return None
        if not all(isinstance(a, Var) and a.name != ANON for x in (r.head, *r.body) for a in x.args):
            return None
        if len(r.body) == 1 and key(r.body[0]) not in state and r.body[0].args == r.head.args and len(set(r.head.args)) == 2:
            starts.append((edge(key(r.body[0])), state[key(r.head)]))
            continue
        if len(r.body) != 2:
            return None
        pairs = [(x, y) for x, y in (r.body, r.body[::-1]) if x.args[1] == y.args[0] and (x.args[0], y.args[1]) == r.head.args and len({*x.args, *y.args}) == 3]
        if not pairs or (key(pairs[0][0]) in state) == (key(pairs[0][1]) in state):
            return None
        x, y = pairs[0]
        backward = key(y) in state
        ways.add(backward)
        moves.append((state[key(y if backward else x)], edge(key(x if backward else y)), state[key(r.head)]))
    kinds = {t for k in (*part, *edges) for t in types[k]}
    if len(ways) != 1 or len(part) > 100 or len(edges) > 100 or len(kinds) != 1 or not kinds <= {*INTEGERS, "symbol"}:
        return None
    return Automaton(tuple(edges), tuple(starts), tuple(moves), ways == {True})


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's connected part."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump


def coded(*columns: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """(values, codes of each column)."""
    both = pa.concat_arrays(columns).dictionary_encode(null_encoding="encode")
    codes = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return both.dictionary, np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def whole(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    """The columns of all batches."""
    return [pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)]


def few(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join with at most that many rows, which saves shuffling the other where they are few."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def contracted(limit: int | None):
    """Edges with the root of their part, as far as edges of one task, at most limit of them, tell."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = whole(held)
            values, (u, v) = coded(columns[0], columns[1])
            at = values.take(pa.array(roots(u, v, len(values))[u]))
            yield from pa.Table.from_arrays([*columns, at], names=[*held[0].schema.names, "root"]).to_batches(ROWS)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if limit is not None and rows >= limit:
                yield from chunk(held)
                held, rows = [], 0
        if rows:
            yield from chunk(held)

    return work


def parts(links: DataFrame, n: int, kind: str) -> tuple[DataFrame, int]:
    """((a, root): every node of the links (a, b) with one node of its connected part, rounds)."""
    labels: list[DataFrame] = []
    while n > TASK_EDGES:
        rank = lambda c, salt=len(labels): F.xxhash64(F.col(c), F.lit(salt))
        both = links.unionAll(links.select("b", "a"))
        best = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"), F.min(rank("b")).alias("rank"))
        label, _ = counted(best.select("a", F.when(F.col("rank") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("root")))
        labels.append(label)
        ends = links.join(label.toDF("a", "ra"), "a").select("b", "ra").join(label.toDF("b", "rb"), "b")
        links, n = counted(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    both = links.unionAll(links.select("b", "a")).repartition(1)  # so that a column names every node
    out, _ = counted(both.mapInArrow(contracted(None), f"a {kind}, b {kind}, root {kind}").select("a", "root").distinct())
    for label in reversed(labels):
        known = out.toDF("root", "last")
        out, _ = counted(label.join(known, "root", "left").select("a", F.coalesce("last", "root").alias("root")))
    return out, len(labels) + 1


def walks(starts: tuple, moves: tuple, states: int, cells: int):
    """(c0, c1, state): the ends of all walks over edges (c0, c1, edge, root), sorted by root, that lead to a state."""
    kinds = 1 + max(e for e, *_ in (*starts, *((e, p) for _, e, p in moves)))

    def reach(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        values, (u, v) = coded(columns[0], columns[1])
        label, n = np.asarray(columns[2]).astype(np.int64), len(values)
        _, (group,) = coded(columns[3])
        of = np.empty(n, np.int64)
        of[u] = of[v] = group
        order = np.argsort(of, kind="stable")  # nodes of a part side by side
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        u, v, of, value = place[u], place[v], of[order], values.take(pa.array(order))
        size = np.bincount(of)
        base = (np.cumsum(size) - size)[of]  # of a node: the first one of its part
        width = size[of]
        offset = np.concatenate([[0], np.cumsum(width)])  # a node's row of cells has one for each node of its part
        by = np.argsort(u * kinds + label, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(u * kinds + label, minlength=n * kinds))])
        to = v[by]
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(offset, offset[low] + cells // states, "right")) - 1)
            rows = int(offset[high] - offset[low])
            seen, owner = np.zeros(rows * states, bool), np.empty(rows * states, np.int32)

            def fresh(s: np.ndarray, y: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
                at = (offset[s] - offset[low] + y - base[s]) * states + state
                new = np.flatnonzero(~seen[at])
                at, turn = at[new], np.arange(len(new), dtype=np.int32)
                owner[at] = turn
                new = new[owner[at] == turn]
                seen[at] = True
                return s[new], y[new], state

            front = []
            for e, p in starts:
                mine = (u >= low) & (u < high) & (label == e)
                front.append(fresh(u[mine], v[mine], p))
            while front := [f for f in front if len(f[0])]:
                after = []
                for s, y, q in front:
                    for _, e, p in (m for m in moves if m[0] == q):
                        begin = first[y * kinds + e]
                        many = first[y * kinds + e + 1] - begin
                        ends, i = np.cumsum(many), 0
                        while i < len(y):  # a piece makes about as many rows as there are cells at most
                            done = int(ends[i - 1]) if i else 0
                            j = max(i + 1, int(np.searchsorted(ends, done + cells, "right")))
                            d = many[i:j]
                            at = np.arange(int(d.sum())) + np.repeat(begin[i:j] - (ends[i:j] - d - done), d)
                            after.append(fresh(np.repeat(s[i:j], d), to[at], p))
                            i = j
                front = after
            source = np.repeat(np.arange(low, high), width[low:high])
            for i in range(0, rows * states, ROWS * 4):
                found = np.flatnonzero(seen[i : i + ROWS * 4]) + i
                cell = found // states
                s = source[cell]
                y = base[s] + cell - (offset[s] - offset[low])
                if len(s):
                    yield pa.RecordBatch.from_arrays([value.take(pa.array(s)), value.take(pa.array(y)), pa.array((found % states).astype(np.int8))], names=["c0", "c1", "state"])
            low = high

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # edges of whole parts, and of one that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_EDGES and batch.column(3)[batch.num_rows - 1] != held[0].column(3)[0]:
                columns = whole(held)
                _, (group,) = coded(columns[3])
                cut = int(np.searchsorted(group, group[-1]))
                yield from reach([c.slice(0, cut) for c in columns])
                held = [pa.RecordBatch.from_arrays([c.slice(cut) for c in columns], names=batch.schema.names)]
        if held:
            yield from reach(whole(held))

    return work


def solve(part: list[Key], rules: list[Rule], types: dict[Key, tuple[str, ...]], known) -> tuple[dict[Key, DataFrame], dict[Key, Relation] | None, int] | None:
    """(tuples of each predicate, edges that are left to evaluate in rounds, rounds), or None where rounds do."""
    a = automaton(part, rules, types)
    if a is None or not a.starts:
        return None
    given = {k: known(k, 0) for k in a.edges}
    if sum(estimated_bytes(r.df) for r in given.values()) < LEAST_BYTES:
        return None
    spark, kind = given[a.edges[0]].df.sparkSession, spark_type(types[part[0]][0])
    turned = (lambda df, *more: df.select(F.col("c1").alias("c0"), F.col("c0").alias("c1"), *more)) if a.backward else (lambda df, *more: df.select("c0", "c1", *more))
    edges = reduce(DataFrame.unionAll, [turned(r.rows_of, F.lit(i).cast("tinyint").alias("edge")) for i, r in enumerate(given.values())])
    marked, n = stored(edges.mapInArrow(contracted(CHUNK_EDGES), f"c0 {kind}, c1 {kind}, edge tinyint, root {kind}"))

    def left(df: DataFrame) -> dict[Key, Relation]:
        return {k: Relation(turned(df.where(F.col("edge") == i)).distinct(), types[k]) for i, k in enumerate(a.edges)}

    if not marked.where("c0 IS NULL OR c1 IS NULL").isEmpty():
        return {}, left(marked), 0
    rounds = 1
    ends = marked.select(F.col("c0").alias("node"), "root").unionAll(marked.select("c1", "root"))
    shared, count = counted(ends.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("node", "least"))
    if count:
        links, count = counted(ends.join(few(shared, count), "node").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct())
        to, more = parts(links, count, kind)
        to = few(to.toDF("root", "part"), 2 * count)
        marked, rounds = marked.join(to, "root", "left").select("c0", "c1", "edge", F.coalesce("part", "root").alias("root")), rounds + more
    big, count = counted(marked.groupBy("root").count().where(F.col("count") > PART_EDGES).select("root"))
    big = few(big, count)
    mine = marked.join(big, "root", "left_anti").select("c0", "c1", "edge", "root") if count else marked
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = mine.repartition(tasks, "root").sortWithinPartitions("root").mapInArrow(walks(a.starts, a.moves, len(part), CELLS), f"c0 {kind}, c1 {kind}, state tinyint")
    made, _ = stored(made)
    out = {k: turned(made.where(F.col("state") == i)) for i, k in enumerate(part)}
    return out, left(marked.join(big, "root", "left_semi")) if count else None, rounds
