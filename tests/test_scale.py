"""Ways that are taken for large inputs only, on small ones: results equal those of the plain joins."""

import itertools
import random

import pytest

from quern import epistemic
from quern.engine import Engine, Options
from quern.errors import RecursionLimit
from quern.lang.parser import parse
from quern.operators import candidates, multiway
from quern.plans import fixpoint, paths, rules
from quern.queries import QUERIES
from quern.sources import files


@pytest.fixture
def large(monkeypatch):
    """Every relation counts as a large one, and a bitmap as a small one, so that it lets some wrong pairs through."""
    monkeypatch.setattr(rules, "MARKED_ROWS", 0)
    monkeypatch.setattr(multiway, "MARKED_ROWS", 0)
    monkeypatch.setattr(candidates, "LEAST", 10)
    monkeypatch.setattr(candidates, "STEP", 7)
    monkeypatch.setattr(candidates, "CHUNK", 3)


def test_cliques_by_marks_equal_enumeration(spark, large):
    rnd = random.Random(5)
    edges = {tuple(sorted(rnd.sample(range(14), 2))) for _ in range(55)}
    for name, to in (("long", int), ("string", lambda v: f"v{v:02}"), ("double", lambda v: float(v) / 4)):
        df = spark.createDataFrame([(to(a), to(b)) for a, b in edges] + [(to(3), to(3))], f"a {name}, b {name}")
        for k in (3, 4, 5) if name == "long" else (3, 4):
            want = {tuple(map(to, c)) for c in itertools.combinations(range(14), k) if all(p in edges for p in itertools.combinations(c, 2))}
            got = [tuple(r) for r in multiway.cliques(df, k).collect()]
            assert set(got) == want and len(got) == len(want) and want


def test_candidates_are_tested_before_the_shuffle(spark, large, monkeypatch):
    monkeypatch.setattr(candidates, "LEAST", 20)
    edges = spark.range(40).selectExpr("id", "explode(sequence(id + 1, id + 9)) as to").where("pmod(id * 7 + to * 3, 5) < 2")
    plain = edges.toDF("a", "b").join(edges.toDF("b", "c"), "b")
    marks = candidates.Marks(edges, edges.count())
    made = candidates.expand(edges.toDF("a", "b"), edges.toDF("b", "c"), "b", "c", [("a", marks)])
    true = plain.join(edges.toDF("a", "c"), ["a", "c"], "left_semi").select("a", "b", "c")
    rows = [tuple(r) for r in made.select("a", "b", "c").collect()]
    assert set(map(tuple, true.collect())) <= set(rows) and len(rows) <= true.count() + 2 < plain.count() / 2


def test_cyclic_rules_by_marks_equal_plain_joins(spark, large):
    rnd = random.Random(23)
    rels = {n: {(rnd.choice([0, rnd.randint(0, 9)]), rnd.choice([0, rnd.randint(0, 9)])) for _ in range(45)} for n in "pqrs"}
    inputs = {n: spark.createDataFrame(sorted(rows), "a long, b long") for n, rows in rels.items()}
    texts = [
        "t(X, Y, Z) :- p(X, Y), q(X, Z), r(Y, Z). ?- t(X, Y, Z).",
        "t(W, X, Y, Z) :- p(W, X), p(W, Y), p(W, Z), q(X, Y), q(X, Z), r(Y, Z). ?- t(W, X, Y, Z).",
        "t(X, count(Z), sum(Z), min(Y)) :- p(X, Y), p(X, Z), p(Y, Z). ?- t(X, N, S, M).",
        "t(X, Y) :- p(X, Y), q(Y, Z), r(X, Z). ?- t(X, Y).",
        "t(W, X, Y) :- p(W, X), q(W, Y), r(X, S), s(S, Y). ?- t(W, X, Y).",
        "t(W, count(Y)) :- p(W, X), p(Y, X), p(Y, Z), p(W, Z), X < Z. ?- t(W, N).",
        "t(W, count(Y)) :- p(W, X), q(X, Y), r(Y, Z), s(Z, W). ?- t(W, N).",
        *(f"t(W, count(X)) :- p(W, X), q(X, Y), r(Y, Z), s(Z, W), Z {op} X. ?- t(W, N)." for op in ("<", "<=", ">", ">=", "==", "!=")),
    ]
    for text in texts:
        got, want = ([tuple(r) for r in Engine(spark, Options(promote=on)).run(text, inputs).queries[0].collect()] for on in (True, False))
        assert sorted(got) == sorted(want) and len(got) == len(set(got)) and got, text


def test_four_cycle_counts_equal_the_cycles(spark, large):
    rnd = random.Random(2)
    r = [spark.createDataFrame([(rnd.randint(0, 6), rnd.choice([rnd.randint(0, 6), 2**40])) for _ in range(30)], "a long, b long") for _ in range(4)]
    r[3] = r[3].selectExpr("b", "a")
    want = dict(map(tuple, multiway.four_cycles(*r).groupBy("w").count().collect()))
    got = multiway.four_cycle_counts(*r)
    assert dict(map(tuple, got.collect())) == want and want and "BatchEvalPython" not in got._jdf.queryExecution().toString()


def test_answers_are_sets_without_shuffling_them(spark):
    """Where the head or keys settle all variables no distinct follows; where they don't one does."""
    keyed, twice = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 5)], "a long, n long"), spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6)], "a long, n long")
    text = "more(A, B) :- s(A, N), s(B, N), A < B. ?- more(A, B)."
    for df, want, aggregates in ((keyed, {(1, 2), (1, 4), (2, 4)}, 0), (twice, {(1, 2)}, 1)):
        df = df.distinct().checkpoint()
        out = Engine(spark).run(text, {"s": df}).queries[0]
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) == want and len(rows) == len(want)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.splitlines()[0].lstrip().startswith(("Project", "Join")) == (aggregates == 0)
    out = Engine(spark).run("pred t(i32). t(X) :- s(X, _), s(X, 5). ?- t(X).", {"s": twice}).queries[0].collect()
    assert sorted(map(tuple, out)) == [(1,), (2,)]


def test_arrow_files_by_uri(spark, tmp_path):
    """A URI names the same folder for executors that work elsewhere; drafts of tasks that failed aren't read; no rows keep their schema."""
    df = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    files.write_relation(df, f"file://{tmp_path}/a%20u.arrows")
    assert (tmp_path / "a u.arrows").is_dir() and sorted(map(tuple, files.read_relation(spark, f"file:{tmp_path}/a%20u.arrows").collect())) == [(1, 2), (3, 4)]
    (tmp_path / "a u.arrows" / "part-00009.attempt0").write_bytes(b"a broken draft")
    assert files.read_relation(spark, str(tmp_path / "a u.arrows")).count() == 2
    files.write_relation(df.limit(0), str(tmp_path / "none.arrows"))
    none = files.read_relation(spark, str(tmp_path / "none.arrows"))
    assert none.dtypes == df.dtypes and not none.collect()
    with pytest.raises(ValueError):
        files.write_relation(df, "hdfs://host/x.arrows")


def test_negative_zero_is_no_negative_balance(spark, tmp_path):
    rows = [(1, -0.0), (2, 0.0), (3, -0.01), (4, 500.0), (5, 500.01), (6, float("nan"))]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    out = QUERIES["float_total_order"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == [(1, "poor"), (2, "poor"), (3, "neg"), (4, "poor")]


def test_games_equal_the_alternating_fixpoint(spark, monkeypatch):
    rnd = random.Random(8)
    text = "w(X) :- m(X, Y), not know w(Y). w(X) :- s(X). l(X) :- m(_, X), not w(X). ?- w(X). ?- l(X)."
    for n, edges in ((8, 9), (12, 15), (30, 30), (16, 40)):
        m = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(edges)} | {(n + i, n + i + 1) for i in range(5)} | {(n + 5, 0)}
        inputs = {"m": spark.createDataFrame(sorted(m), "a long, b long"), "s": spark.createDataFrame([(n - 1,)], "a long")}
        got = [sorted(map(tuple, q.collect())) for q in epistemic.run(spark, text, inputs).queries]
        low: set = set()
        while True:  # the alternating fixpoint by hand
            high = {x for x, y in m if y not in low} | {n - 1}
            now = {x for x, y in m if y not in high} | {n - 1}
            if now == low:
                break
            low = now
        assert got[0] == sorted((x,) for x in low)


def test_long_games_end(spark):
    """A chain of 4,000 moves and a circle: the alternating fixpoint would take 2,000 steps."""
    moves = spark.range(4000).selectExpr("id as a", "id + 1 as b").unionAll(spark.createDataFrame([(9000, 9001), (9001, 9000), (9002, 9000)], "a long, b long"))
    won = epistemic.run(spark, "w(X) :- m(X, Y), not know w(Y). ?- w(X).", {"m": moves}).queries[0]
    assert sorted(r[0] for r in won.collect()) == list(range(1, 4000, 2))


def test_nonlinear_closure_runs_as_the_linear_one(spark):
    rnd = random.Random(4)
    text = "p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), p(Y, Z). ?- p(X, Y)."
    compiled = Engine(spark).compile(text, {"e": spark.createDataFrame([(1, 2)], "a long, b long")})
    own = [r for r in compiled.rules if r.head.name == "p"]
    assert fixpoint.closure_of(("p", 2), own) is None and fixpoint.closure_of(("p", 2), fixpoint.linear(("p", 2), own)) is not None
    edges = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(18)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    got = [tuple(r) for r in Engine(spark).run(text, {"e": spark.createDataFrame(sorted(edges), "a long, b long")}).queries[0].collect()]
    assert set(got) == want and len(got) == len(want)
    kept = Engine(spark).run(text + " p(90, 91). p(91, 92).", {"e": spark.createDataFrame([(1, 2)], "a long, b long")}).queries[0]
    assert {tuple(r) for r in kept.collect()} == {(1, 2), (90, 91), (91, 92), (90, 92)}


WALKS = [
    "p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), e(Y, Z). ?- p(X, Y).",
    "p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), p(Y, Z). ?- p(X, Y).",
    "p(X, Y) :- e(X, Y). p(X, Z) :- e(X, Y), p(Y, Z). ?- p(X, Y).",
    "odd(X, Y) :- e(X, Y). odd(X, Z) :- even(X, Y), e(Y, Z). even(X, Z) :- odd(X, Y), e(Y, Z). ?- even(X, Y).",
    "p(X, Y) :- f(X, Y). q(X, Z) :- e(Y, Z), p(X, Y). p(X, Z) :- q(X, Y), f(Y, Z). p(X, Z) :- p(X, Y), e(Y, Z). ?- q(X, Y).",
]


def pieces(rnd, n):
    """Chains, circles and denser parts, in no order."""
    out = set()
    for base in range(0, n * 10, 10):
        size = rnd.randint(2, 9)
        out |= {(base + i, base + i + 1) for i in range(size - 1)} if base % 30 else {(base + rnd.randrange(size), base + rnd.randrange(size)) for _ in range(2 * size)}
    out = list(out)
    rnd.shuffle(out)
    return out


def walked(text, rels):
    """The last query by hand: pairs of every predicate, a rule at a time, until nothing is new."""
    rules = [r for r in parse(text).rules]
    known = {n: set(rows) for n, rows in rels.items()}
    while True:
        before = sum(map(len, known.values()))
        for r in rules:
            x, *rest = sorted(r.body, key=lambda a: a.args[0] != r.head.args[0])
            made = known.get(x.name, set())
            for y in rest:
                made = {(a, d) for a, b in made for c, d in known.get(y.name, set()) if b == c}
            known.setdefault(r.head.name, set()).update(made)
        if sum(map(len, known.values())) == before:
            return known


@pytest.mark.parametrize(
    ("texts", "kind", "sizes"),
    [(WALKS[3:], "long", {"PART_EDGES": 7, "CELLS": 40, "BLOCK_EDGES": 5, "ROWS": 3}), (WALKS[1:3], "long", {"CHUNK_EDGES": 2, "TASK_EDGES": 3}), (WALKS[3:4], "string", {})],
)
def test_walks_equal_the_rules(spark, monkeypatch, texts, kind, sizes):
    """Parts of any size, cut among tasks, walked in blocks or left to rounds."""
    rnd, to = random.Random(31), int if kind == "long" else lambda v: f"n{v}"
    rels = {n: [(to(a), to(b)) for a, b in pieces(rnd, 12)] for n in "ef"}
    inputs = {n: spark.createDataFrame(rows, f"a {kind}, b {kind}").repartition(3) for n, rows in rels.items()}
    for name, n in ({"LEAST_BYTES": 0} | sizes).items():
        monkeypatch.setattr(paths, name, n)
    for text in texts:
        result = Engine(spark).run(text, inputs)
        want = walked(text, rels)
        for p in {r.head.name for r in parse(text).rules}:
            got = [tuple(r) for r in result.relation(p, 2).collect()]
            assert set(got) == want[p] and len(got) == len(want[p]) and got, (text, p)


def test_long_walks_take_few_rounds(spark, monkeypatch):
    """mutual_recursion_parity over chains of 300: one round a step before."""
    monkeypatch.setattr(paths, "LEAST_BYTES", 0)
    edges = spark.range(900).where("id % 300 != 299").selectExpr("id as a", "id + 1 as b")
    result = Engine(spark).run(WALKS[3], {"e": edges})
    got = result.queries[0]
    assert got.where("Y - X < 2 OR (Y - X) % 2 = 1").isEmpty() and got.distinct().count() == got.count() == 3 * sum(300 - d for d in range(2, 300, 2))
    assert max(c.rounds for c in result.components) <= 3


def test_walks_with_nulls_or_limits_go_by_rounds(spark, monkeypatch):
    """A null end starts or ends walks but joins nothing."""
    monkeypatch.setattr(paths, "LEAST_BYTES", 0)
    edges = spark.createDataFrame([(None, 1), (1, 2), (2, None), (None, None)], "a long, b long")
    got = {tuple(r) for r in Engine(spark).run(WALKS[0], {"e": edges}).queries[0].collect()}
    assert got == {(None, 1), (None, 2), (None, None), (1, 2), (1, None), (2, None)}
    with pytest.raises(RecursionLimit):
        Engine(spark, Options(max_rounds=2)).run(WALKS[3], {"e": spark.range(9).selectExpr("id as a", "id + 1 as b")})
