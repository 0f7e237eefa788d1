"""Sessions, sources, probabilistic and modal programs, induction, solver, tools."""

import io
import itertools
import json
import random

import pyarrow as pa
import pytest

from quern import diagnostics, epistemic, induce, prob
from quern.cli import main
from quern.engine import Engine
from quern.errors import ProbabilityError, UnsupportedEpistemicConstruct
from quern.induce import nary
from quern.operators import multiway, relational
from quern.sat import Solver
from quern.sources import files
from quern.streaming.session import Delta, Session, feed

GRAPH = """walk(From, To) :- edge(From, To). walk(From, End) :- walk(From, Mid), edge(Mid, End). spot(P) :- edge(P, _). spot(P) :- edge(_, P).
apart(P, Q) :- spot(P), spot(Q), not walk(P, Q). deg(P, count(Q)) :- walk(P, Q). ?- walk(1, To)."""


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "a long, b long")


def answers(s, i=0):
    return sorted(r[0] for r in s.evaluate().queries[i].collect())


def test_session_equals_recomputation(spark):
    s = Session(Engine(spark), GRAPH, {"edge": pairs(spark, (1, 2), (2, 3), (7, 8))})
    assert answers(s) == [2, 3]
    calls = []
    stop = s.on_change(lambda name, stats: calls.append((name, stats.inserted)), "edge")
    stats = s.insert("edge", pairs(spark, (3, 4)))
    assert stats.incremental >= 1 and stats.recomputed >= 1 and s.equivalent() and answers(s) == [2, 3, 4]
    stats = s.delete("edge", pairs(spark, (2, 3)))
    assert stats.affected == stats.recomputed and s.equivalent() and answers(s) == [2]
    assert calls == [("edge", 1), ("edge", 0)]
    stats = s.apply([("edge", Delta(insert=pairs(spark, (5, 5)))), ("edge", Delta(delete=pairs(spark, (5, 5))))])
    assert stats.changed_relations == 0 and len(calls) == 2
    stop()
    assert s.evaluate_async().result().queries[0].count() == 1
    s.remove("edge")
    assert s.relations() == []


def test_stream_feeds_a_session(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"a": 2, "b": 3}\n{"a": 1, "b": 2}\n')
    s = Session(Engine(spark), GRAPH, {"edge": pairs(spark, (9, 9))})
    stream = spark.readStream.schema("a long, b long").json(str(source))
    q = feed(s, stream, "edge").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert answers(s) == [2, 3]


def test_files(spark, tmp_path):
    df = pairs(spark, (1, 2), (3, 4))
    for end in ("parquet", "csv", "json", "arrows", "orc"):
        files.write_relation(df, str(tmp_path / f"x.{end}"))
        assert sorted(map(tuple, files.read_relation(spark, str(tmp_path / f"x.{end}")).collect())) == [(1, 2), (3, 4)]
    table = pa.table({"a": [5], "b": ["x"]})
    with pa.ipc.new_file(str(tmp_path / "y.arrow"), table.schema) as f:
        f.write_table(table)
    assert files.read_relation(spark, str(tmp_path / "y.arrow")).collect() == [(5, "x")]
    assert [len(c) for c in files.chunks(spark.range(25), 10)] == [10, 10, 5]


def test_triples(spark, tmp_path):
    def fnv(text):
        h = 14695981039346656037
        for x in text.encode():
            h = ((h ^ x) * 1099511628211) % 2**64
        return h - 2**64 if h >= 2**63 else h

    (tmp_path / "a.csv").write_text("subject,predicate,object,split\na,knows,b,train\nb,knows,é,\n")
    (tmp_path / "a.jsonl").write_text(json.dumps({"subject": "a", "predicate": "p", "object": "b"}) + "\n")
    (tmp_path / "a.nt").write_text('<http://x/s> <http://x/p> "o \\" x"@en .\n# note\n_:b <p> <o> .\n\n')
    got = {n: files.read_triples(spark, str(tmp_path / f"a.{n}")).collect() for n in ("csv", "jsonl", "nt")}
    assert [r["split"] for r in got["csv"]] == ["train", "unspecified"] and len(got["nt"]) == 2
    for rs in got.values():
        for r in rs:
            assert r.row_hash == fnv("|".join(r[:4]))
    assert files.histogram(files.read_triples(spark, str(tmp_path / "a.csv")), "split").count() == 2


def test_operators(spark):
    a, b = pairs(spark, (4, 5), *itertools.combinations(range(1, 5), 2)), pairs(spark, (1, 2), (9, 9))
    assert multiway.triangles(a).count() == 4 and multiway.cliques(a, 4).count() == 1
    assert dict(map(tuple, multiway.triangle_counts(a).collect())) == {1: 3, 2: 3, 3: 3, 4: 3}
    assert relational.intersect(a, b).count() == 1 and relational.difference(b, a).collect() == [(9, 9)]
    assert relational.union([a, a, b]).count() == 8
    assert relational.join(a, b.limit(0).toDF("x", "y"), [], "left_anti").count() == 7
    assert relational.group(a.limit(0), [], {"n": ("count", "a")}).collect() == []
    assert relational.join(a, b.toDF("a", "c"), ["a"], "left").where("c is null").count() == 4
    for strategy in ("merge", "shuffle_hash", "broadcast"):
        assert relational.join(a, b.toDF("a", "c"), ["a"], strategy=strategy).count() == 3
    with pytest.raises(ValueError):
        relational.join(a, b, ["a"], "full")


def test_random_cliques_equal_enumeration(spark):
    rnd = random.Random(3)
    edges = {tuple(sorted(rnd.sample(range(14), 2))) for _ in range(50)}
    df = pairs(spark, *edges, *((b, a) for a, b in list(edges)[:9]))
    for k in (3, 4, 5):
        want = {c for c in itertools.combinations(range(14), k) if all(p in edges for p in itertools.combinations(c, 2))}
        assert set(map(tuple, multiway.cliques(df, k).collect())) == want


WET = "wet() :- hose(). wet() :- rain(). 0.2::hose(). query(rain()). 0.7::rain(). query(hose()). evidence(wet(), true)."
AGG = "0.5::e(1, 2). 0.25::e(1, 3). d(X, count(Y)) :- e(X, Y). s(X, sum(Y)) :- e(X, Y). m(X, min(Y)) :- e(X, Y). x(X, max(Y)) :- e(X, Y). query(d(1, 2)). query(s(1, 5)). query(m(1, 2)). query(x(1, 3))."


def test_exact_inference():
    rain, hose = prob.exact(WET, gradients=True)
    assert abs(rain.probability - 0.7 / 0.76) < 1e-12 and abs(hose.probability - 0.2 / 0.76) < 1e-12
    h = 1e-6
    up = prob.exact(WET.replace("0.7::", f"{0.7 + h:.6f}::"))[0].probability
    assert abs((up - rain.probability) / h - rain.gradient["0.7::rain()"]) < 1e-4
    assert [a.probability for a in prob.exact(AGG)] == [0.125, 0.125, 0.5, 0.25]
    assert [a.probability for a in prob.exact("0.6::c(h); 0.4::c(t). query(c(h)). query(c(t)).")] == [0.6, 0.4]
    assert prob.exact("0.5::e(1,2). 0.5::e(2,3). r(X,Y) :- e(X,Y). r(X,Z) :- r(X,Y), e(Y,Z). query(r(1,3)).")[0].probability == 0.25
    assert prob.exact("dry() :- not wet(). 0.3::wet(). query(dry()).")[0].probability == 0.7
    for bad in ("0.6::a(); 0.6::b(). query(a()).", "query(odd()). evidence(odd(), false). 0.5::odd(). evidence(odd(), true)."):
        with pytest.raises(ProbabilityError):
            prob.exact(bad)
    with pytest.raises(ProbabilityError, match="Monte Carlo"):
        prob.exact(" ".join(f"0.5::e({i})." for i in range(17)) + " s(sum(X)) :- e(X). query(s(3)).")


def test_exact_inference_equals_enumeration():
    for seed in range(5):
        rnd = random.Random(seed)
        edges = [(rnd.randint(0, 4), rnd.randint(0, 4), rnd.choice([0.2, 0.5, 0.9])) for _ in range(8)]
        text = " ".join(f"{p}::e({a}, {b})." for a, b, p in edges) + " r(X, Y) :- e(X, Y). r(X, Z) :- r(X, Y), e(Y, Z). n(X) :- r(X, _), not r(X, X). query(r(0, 3)). query(n(0))."
        want = [0.0, 0.0]
        for world in itertools.product([0, 1], repeat=len(edges)):
            weight, has = 1.0, set()
            for (a, b, p), on in zip(edges, world, strict=True):
                weight *= p if on else 1 - p
                has |= {(a, b)} if on else set()
            reach = set(has)
            while new := {(a, d) for a, b in reach for c, d in has if b == c} - reach:
                reach |= new
            want[0] += weight * ((0, 3) in reach)
            want[1] += weight * (any(a == 0 for a, _ in reach) and (0, 0) not in reach)
        assert [round(a.probability, 9) for a in prob.exact(text)] == [round(w, 9) for w in want]


def test_monte_carlo(spark):
    for text in (WET, AGG):
        want = [a.probability for a in prob.exact(text)]
        got = prob.monte_carlo(spark, text, samples=3000, seed=1, confidence=0.9999)
        assert all(e.low <= w <= e.high for e, w in zip(got, want, strict=True))
        assert got == prob.monte_carlo(spark, text, samples=3000, seed=1, confidence=0.9999)
    clamped = prob.monte_carlo(spark, "0.1::a(). 0.5::b(). c() :- a(), b(). evidence(a(), true). query(c()).", samples=2000, confidence=0.9999)[0]
    assert clamped.samples == 2000 and clamped.low <= 0.5 <= clamped.high


def test_cycles_through_negation(spark):
    text = "0.5::open(). 0.25::shut(). go() :- not stay(), open(). stay() :- not go(), open(). stay() :- shut(). move(X) :- way(X, Y), not move(Y). way(1, 2). way(2, 3). query(stay()). query(go()). query(move(2)). query(move(1))."
    want = [0.25, 0.0, 1.0, 0.0]
    assert [a.probability for a in prob.exact(text)] == want
    got = prob.monte_carlo(spark, text, samples=1500, confidence=0.9999)
    assert all(e.low - 1e-9 <= w <= e.high + 1e-9 for e, w in zip(got, want, strict=True))


def modal(spark, text, **kw):
    return [sorted(map(tuple, q.collect())) for q in epistemic.run(spark, text, **kw).queries]


def test_modal_programs(spark):
    assert modal(spark, "f(1). u(1). a(X) :- know f(X). :- know u(X). ?- a(X).") == [[]]
    assert modal(spark, "f(1). pred u(i64). a(X) :- know f(X). :- know u(X). ?- a(X).") == [[(1,)]]
    loop = "pred belief(). ?- belief(). belief() :- possible belief()."
    assert modal(spark, loop) == [[]] and modal(spark, loop, mode="g91") == [[(1,)]]
    text = """spot(1). spot(2). spot(3). first(1, 2). walk(A, B) :- way(A, B). walk(A, C) :- way(B, C), walk(A, B).
    way(A, B) :- first(A, B). way(A, B) :- not know walk(A, B), spot(B), spot(A). ?- walk(A, B)."""
    assert modal(spark, text) == [[(1, 2)]]
    assert modal(spark, "p(1). q(X) :- know not possible p(X), r(X). r(1). r(2). ?- q(X).") == [[(2,)]]
    assert epistemic.world_views("p() :- possible p().") == [{"p()": False}, {"p()": True}]
    with pytest.raises(UnsupportedEpistemicConstruct):
        modal(spark, "p(1). q(1). :- p(X), know q(X). ?- p(X).")


def test_induction(spark):
    rels = [pairs(spark, (2, 3), (1, 2)), pairs(spark, (4, 6), (3, 5), (2, 4)), pairs(spark, (2, 5), (1, 4))]
    pos, neg = pairs(spark, (1, 4), (2, 5)), pairs(spark, (7, 8))
    best = {r.topology: r for r in induce.induce(rels, pos, neg).collect()}
    assert (best["chain"].left, best["chain"].right, best["chain"].pos, best["chain"].neg) == (0, 1, 2, 0)
    data = [set(map(tuple, r.collect())) for r in rels]
    holds = {
        "chain": lambda l, r, x, y: any((x, z) in l and (z, y) in r for z in range(9)),
        "star": lambda l, r, x, y: any((z, x) in l and (z, y) in r for z in range(9)),
        "fanout": lambda l, r, x, y: (x, y) in l and any((x, z) in r for z in range(9)),
        "fanin": lambda l, r, x, y: (x, y) in l and any((z, y) in r for z in range(9)),
    }
    for r in induce.coverage(rels, pos, neg).collect():
        assert r.pos == sum(holds[r.topology](data[r.left], data[r.right], *e) for e in [(1, 4), (2, 5)]) and r.neg == 0
    assert nary.induce(spark, {"b": rels[0], "c": rels[1]}, pos, neg, top=1)[0].rule == "h(X0, X1) :- b(X0, Z0), c(Z0, X1)."
    with pytest.raises(nary.InductionLimit):
        nary.patterns({"r": 3}, 2, nary.Bounds(3, 3, 50))


def test_solver_equals_enumeration():
    for seed in range(150):
        rnd = random.Random(seed)
        n = rnd.randint(2, 7)
        clauses = [tuple(rnd.choice([1, -1]) * v for v in rnd.sample(range(1, n + 1), min(n, rnd.randint(1, 3)))) for _ in range(rnd.randint(2, 26))]
        s = Solver()
        for c in clauses:
            s.add(*c)
        worlds = list(itertools.product([False, True], repeat=n))
        meets = lambda w, cs: all(any(w[abs(x) - 1] == (x > 0) for x in c) for c in cs)
        assert (s.solve().status == "sat") == any(meets(w, clauses) for w in worlds)
        s.assume(1)
        assert (s.solve().status == "sat") == any(meets(w, [*clauses, (1,)]) for w in worlds)
        s.retract()
        soft = [((rnd.choice([1, -1]) * v,), rnd.randint(1, 5)) for v in range(1, n + 1)]
        got = Solver(list(clauses)).maximise(soft)
        want = max((sum(w for c, w in soft if meets(x, [c])) for x in worlds if meets(x, clauses)), default=None)
        assert (None if got is None else got[0]) == want


def test_tools(spark, tmp_path, capsys):
    text = "step(1, 2). step(2, 3). walk(A, B) :- step(A, B). walk(A, C) :- walk(A, B), step(B, C).\n?- walk(1, To)."
    assert "given" in diagnostics.why(text, "walk(1, 3)") and "does not hold" in diagnostics.why(text, "walk(3, 1)")
    result, profile = diagnostics.profile(Engine(spark), text)
    assert profile.rows["walk/2"] == 3 and profile.rounds["walk/2"] >= 1
    cache = diagnostics.ParseCache()
    cache.parse(text)
    assert len(cache.parse(text + " step(3, 4).").rules) == 2 and cache.misses == 6
    f = tmp_path / "p.dl"
    f.write_text(text)
    out = io.StringIO()
    assert main(["run", str(f)], spark, out) == 0 and "rows: 2" in out.getvalue()
    assert main(["explain", str(f)], spark, out) == 0 and "recursive" in out.getvalue()
    (tmp_path / "q.dl").write_text(WET)
    assert main(["prob", str(tmp_path / "q.dl")], spark, out) == 0 and "0.921053" in out.getvalue()
    assert main(["run", str(tmp_path / "absent.dl")], spark, out) == 1 and main(["nonsense"], spark, out) == 2
    assert main(["run", str(f), "--output", str(tmp_path / "o"), "--format", "json"], spark, out) == 0
    assert spark.read.json(str(tmp_path / "o" / "query_0.json")).count() == 2


def test_neural_predicates(spark):
    import numpy as np

    from quern.prob import neural

    text = "query(added(1, 2, 2)). added(A, B, T) :- seen(A, V), seen(B, W), T is V + W. nn(digits, [Image], Digit, [0, 1, 2]) :: seen(Image, Digit)."
    make = lambda: lambda b: np.array([[0.2, 0.5, 0.3] if x == 1 else [0.1, 0.6, 0.3] for x in b.iloc[:, 0]])
    images = spark.createDataFrame([(1,), (2,)], "x long")
    got = neural.answer(spark, text, {"digits": make}, {"seen": images})
    assert abs(got[0].probability - (0.2 * 0.3 + 0.5 * 0.6 + 0.3 * 0.1)) < 1e-12
    p = neural.predictions(images, make, [0, 1, 2])
    assert p.count() == 6 and abs(neural.noisy_or(p.where("label > 0"), ["x"]).where("x = 1").first().probability - (1 - 0.5 * 0.7)) < 1e-9
    assert neural.embeddings(images, make).first().embedding == [0.2, 0.5, 0.3]


def test_doubling_closure_equals_single_steps(spark):
    rnd = random.Random(8)
    edges = {(rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(32)}
    reach = set(edges)
    while new := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= new
    for text in ("p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), e(Y, Z).", "p(X, Z) :- e(X, Y), p(Y, Z). p(X, Y) :- e(X, Y)."):
        got = Engine(spark).run(text + " ?- p(X, Y).", {"e": pairs(spark, *edges)}).queries[0].collect()
        assert set(map(tuple, got)) == reach and len(got) == len(reach)
    # facts of its own make it no closure
    got = Engine(spark).run("p(50, 0). p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), e(Y, Z). ?- p(50, Y).", {"e": pairs(spark, *edges)}).queries[0].collect()
    assert {r[0] for r in got} == {0} | {b for a, b in reach if a == 0}


def test_gradients_find_the_rule(spark):
    from quern.induce import differentiable

    rels = [pairs(spark, *((i, i + 100) for i in range(30))), pairs(spark, *((i + 100, i + 200) for i in range(30))), pairs(spark, *((i, i + 7) for i in range(30)))]
    rows = [(i, i + 200, 1) for i in range(30)] + [(i, i + 201, 0) for i in range(30)]
    seen, held = (spark.createDataFrame(rows[k::2], "x long, y long, good int") for k in (0, 1))
    learnt = differentiable.train(rels, seen)
    assert learnt.rules == [("chain", 0, 1)]
    assert set(differentiable.evaluate(learnt, rels, held).values()) == {1.0}
    assert differentiable.train(rels, seen.where("good = 0")).rules == []


def test_local_search_finds_models():
    from quern.sat import local_search

    for seed in range(30):
        rnd = random.Random(seed)
        hidden = [rnd.choice([1, -1]) * v for v in range(1, 13)]
        clauses = [tuple(x if rnd.random() < 0.6 else -x for x in rnd.sample(hidden, 3)) for _ in range(30)]
        clauses = [c if set(c) & set(hidden) else (*c[:2], -c[2]) for c in clauses]
        out = local_search(clauses)
        assert out.status == "sat" and all(any(out.model[abs(x)] == (x > 0) for x in c) for c in clauses)
    assert local_search([(1,), (-1,)]).status == "unknown"
