import random

import pytest
from naive import evaluate

from quern.engine import Engine, Options
from quern.errors import CompileError, ConstraintViolation, ModuleError, ParseError, RecursionLimit, StratificationError, TypeMismatch
from quern.lang.parser import parse


def rows(spark, text, i=-1, inputs=None, options=Options(), **kw):
    return sorted(tuple(r) for r in Engine(spark, options).run(text, inputs, **kw).queries[i].collect())


def truth(spark, text, **kw):
    return Engine(spark).run(text, **kw).holds()


CLOSURE = "walk(From, To) :- step(From, To). walk(From, End) :- walk(From, Mid), step(Mid, End)."


def test_closure(spark):
    assert rows(spark, f"step(30, 40). step(10, 20). step(20, 30). {CLOSURE} ?- walk(10, To).") == [(20,), (30,), (40,)]


def test_closure_of_a_cycle_ends(spark):
    assert len(rows(spark, f"step(30, 10). step(10, 20). step(20, 30). {CLOSURE} ?- walk(From, To).")) == 9


def test_nonlinear_and_mutual_recursion(spark):
    text = """s(1, 2). s(2, 3). s(3, 4). s(4, 5). far(From, To) :- s(From, To). far(From, End) :- far(From, Mid), far(Mid, End).
    odd(From, To) :- s(From, To). odd(From, End) :- even(From, Mid), s(Mid, End). even(From, End) :- odd(From, Mid), s(Mid, End). ?- far(1, To). ?- even(1, To)."""
    result = Engine(spark).run(text)
    assert sorted(r[0] for r in result.queries[0].collect()) == [2, 3, 4, 5]
    assert sorted(r[0] for r in result.queries[1].collect()) == [3, 5]


def test_magic_sets_answer_the_same(spark):
    text = f"step(8, 9). step(1, 2). step(7, 8). step(2, 3). walk(1, 1). {CLOSURE} ?- walk(1, To)."
    on = Options(magic_sets="on")
    assert rows(spark, text, options=on) == rows(spark, text) == [(1,), (2,), (3,)]
    assert "__magic_walk_bf" in Engine(spark, on).compile(text).explain()


def test_negation(spark):
    assert rows(spark, "spot(1). spot(2). spot(3). line(1, 2). tied(P) :- line(P, _). tied(P) :- line(_, P). free(P) :- spot(P), not tied(P). ?- free(P).") == [(3,)]
    assert rows(spark, "spot(1). spot(2). line(1, 1). out(P) :- spot(P), not line(P, P). ?- out(P).") == [(2,)]
    assert rows(spark, "spot(1). spot(2). line(1, 1). out(P) :- spot(P), not line(P, _). ?- out(P).") == [(2,)]


def test_boolean_gate(spark):
    assert rows(spark, "q(1). q(2). r(). p(X) :- q(X), not r(). ?- p(X).") == []
    assert rows(spark, "pred r(). q(1). q(2). p(X) :- q(X), not r(). ?- p(X).") == [(1,), (2,)]


def test_nullary_and_ground_queries(spark):
    assert truth(spark, "a(). b() :- a(). ?- b().")
    assert not truth(spark, "pred a(). b() :- a(). ?- b().")
    assert truth(spark, "e(1, 2). ?- e(1, 2).")
    assert not truth(spark, "e(1, 2). ?- e(2, 1).")


def test_constraints(spark):
    with pytest.raises(ConstraintViolation):
        Engine(spark).run(f"step(1, 2). step(2, 1). {CLOSURE} :- walk(P, P).")
    assert Engine(spark).run(f"step(1, 2). {CLOSURE} :- walk(P, P). ?- walk(From, To).").queries[0].count() == 1


def test_aggregates_count_matches_and_group(spark):
    assert rows(spark, "r(1,10). r(1,20). c(X, count(X)) :- r(X, _). ?- c(X, N).") == [(1, 2)]
    assert rows(spark, "pred w(u32, u32). t(sum(W)) :- w(_, W). ?- t(S).") == []
    assert rows(spark, "w(1,2). w(2,5). t(sum(W), min(W), max(W), count(W)) :- w(_, W). ?- t(A,B,C,D).") == [(7, 2, 5, 2)]


def test_aggregate_over_set_of_tuples(spark):
    text = "t(1,1,1,10). t(2,1,1,5). t(3,1,2,7). t(4,2,1,3). s(A,B,sum(V)) :- t(_,A,B,V). ?- s(A,B,V)."
    assert rows(spark, text) == [(1, 1, 15), (1, 2, 7), (2, 1, 3)]


def test_two_rules_of_one_aggregate_head_are_a_union(spark):
    assert rows(spark, "a(1). a(2). b(3). n(count(X)) :- a(X). n(count(X)) :- b(X). ?- n(N).") == [(1,), (2,)]


def test_logsumexp(spark):
    got = rows(spark, "pred o(u32, f64). o(1, 1.0). o(1, 2.0). o(1, 0.0). o(2, 0.0). l(K, logsumexp(V)) :- o(K, V). ?- l(K, V).")
    assert [(k, round(v, 4)) for k, v in got] == [(1, 2.4076), (2, 0.0)]


def test_arithmetic(spark):
    text = """pred in(i64). in(12). in(5). in(0). in(-7).
    m(I, A, C, S, D, Q, R, P) :- in(I), A is abs(I), C is min(max(I, 0), 10), S is 1 + 3 * C, D is A - C, Q is (3 + A) / 5, R is (3 + A) % 5, P is pow(cast(C, f64), 2).
    ?- m(I, A, C, S, D, Q, R, P)."""
    assert rows(spark, text) == [(-7, 7, 0, 1, 7, 2, 0, 0.0), (0, 0, 0, 1, 0, 0, 3, 0.0), (5, 5, 5, 16, 0, 1, 3, 25.0), (12, 12, 10, 31, 2, 3, 0, 100.0)]


def test_division_by_zero_and_wrapping(spark):
    assert rows(spark, "pred v(i64). v(5). p(Q, R) :- v(X), Q is X / 0, R is X % 0. ?- p(Q, R).") == [(2**63 - 1, 0)]
    assert rows(spark, "pred v(u32). v(5). p(Q, R) :- v(X), Q is X / 0, R is X % 0. ?- p(Q, R).") == [(2**32 - 1, 0)]
    assert rows(spark, "pred v(u32). v(3). p(D) :- v(X), D is X - 5. ?- p(D).") == [(2**32 - 2,)]
    assert rows(spark, "pred v(i64). v(9223372036854775807). p(D) :- v(X), D is X + 1. ?- p(D).") == [(-(2**63),)]
    assert rows(spark, "pred v(i64). v(-7). p(Q, R) :- v(X), Q is X / 2, R is X % 2. ?- p(Q, R).") == [(-3, -1)]


def test_float_semantics(spark):
    text = """pred raw(u32, f64, f64). raw(1, 1.0, 2.0). raw(2, 0.0, 0.0). raw(3, 5.0, 0.0).
    d(I, D) :- raw(I, A, B), D is A / B. same(I) :- d(I, D), D == D. big(I) :- d(I, D), D > 1000.0. ?- same(I). ?- big(I)."""
    result = Engine(spark).run(text)
    assert sorted(r[0] for r in result.queries[0].collect()) == [1, 3]
    assert sorted(r[0] for r in result.queries[1].collect()) == [2, 3]
    assert rows(spark, "pred z(u32, f64). z(1, -0.0). z(2, 0.0). neg(I) :- z(I, V), V < 0.0. ?- neg(I).") == [(1,)]


def test_functions_conditions_and_predicates(spark):
    text = "func sq(X) = X * X. func sign(X) = if X < 0 then 0 - 1 else if X == 0 then 0 else 1. func up(C) = P :- parent(C, P). v(-3). v(0). v(4). parent(-3, 10). out(X, S, G) :- v(X), S is sq(X), G is sign(X). gp(X, P) :- v(X), P is up(X). ?- out(X,S,G). ?- gp(X,P)."
    result = Engine(spark).run(text)
    assert sorted(map(tuple, result.queries[0].collect())) == [(-3, 9, -1), (0, 0, 0), (4, 16, 1)]
    assert list(map(tuple, result.queries[1].collect())) == [(-3, 10)]
    with pytest.raises(RecursionLimit):
        Engine(spark).compile("#pragma max_recursion_depth = 20\nfunc f(X) = f(X). v(1). p(Y) :- v(X), Y is f(X).")


def test_lists_and_terms(spark):
    text = """pred box(key: u32, what: list<u32>). box(2, [30]). box(1, [10, 20, 10]).
    m(K, V) :- box(K, W), member(V, W). n(K, N) :- box(K, W), length(W, N). s(K, V) :- box(K, W), nth(1, W, V). h(K, H, R) :- box(K, [H | R]).
    ?- m(K, V). ?- n(K, N). ?- s(K, V). ?- h(K, H, R)."""
    q = [sorted(map(tuple, d.collect())) for d in Engine(spark).run(text).queries]
    assert q[0] == [(1, 10), *([(1, 20)]), (2, 30)] and q[1] == [(1, 3), (2, 1)]
    assert q[2] == [(1, 20)] and q[3] == [(1, 10, [20, 10]), (2, 30, [])]
    assert rows(spark, "p(K, F, A) :- q(K), functor(spot(1, 2), F, A). q(1). ?- p(K, F, A).") == [(1, "spot", 2)]
    assert rows(spark, "pred t(x: term). t(spot(1, 2)). t(line(3)). f(F) :- t(T), functor(T, F, 2). ?- f(F).") == [("spot",)]
    assert rows(spark, "s(1, 2). s(1, 3). o(N) :- findall(V, s(1, V), W), length(W, N). ?- o(N).") == [(2,)]
    assert rows(spark, "z(N) :- findall(V, nothing(V), W), length(W, N). ?- z(N).") == [(0,)]
    assert rows(spark, "n(1, 10). n(2, 20). l(W) :- maplist(n, [1, 2], W). ?- l(W).") == [([10, 20],)]


def test_modules(spark):
    mods = {"graph": "private pred hidden(u32). hidden(7). step(2, 3). step(1, 2). walk(A, B) :- step(A, B). walk(A, C) :- step(A, B), walk(B, C). secret(X) :- hidden(X).", "a": "use b. x(1).", "b": "use a. y(1)."}
    assert rows(spark, "use graph. ?- walk(1, To).", modules=mods) == [(2,), (3,)]
    assert rows(spark, "use graph::{walk}. step(5, 6). ?- step(A, B).", modules=mods) == [(5, 6)]
    assert rows(spark, "use graph::{secret}. ?- secret(X).", modules=mods) == [(7,)]
    for bad in ("use graph::{hidden}.", "use nothing.", "use a.", "use graph::{absent}."):
        with pytest.raises(ModuleError):
            Engine(spark).compile(bad, modules=mods)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("self(V) :- base(V), not self(V). base(1).", StratificationError),
        ("n(count(X)) :- n(X). n(1).", StratificationError),
        ("p(X, Y) :- q(X). q(1).", CompileError),
        ("p(X) :- q(X), not r(Y), s(Y). q(1). r(1). s(1).", CompileError),
        ("p(X, Y) :- q(X, Y), Y is X + 1. q(1, 2).", CompileError),
        ("pred both(u32, f64). both(1, 1.0). total(T) :- both(A, B), T is A + B.", TypeMismatch),
        ("pred p(symbol). pred q(u32). p(a). r(X) :- p(X), q(X).", TypeMismatch),
        ("p(a). r(X) :- p(X), X < b.", TypeMismatch),
        ("p(a). r(sum(X)) :- p(X).", TypeMismatch),
        ("p(X) :- q(X)", ParseError),
        ("p(X).", ParseError),
    ],
)
def test_rejections(spark, text, error):
    with pytest.raises(error):
        Engine(spark).run(text)


def test_strict_aggregates(spark):
    text = "pred p(i64). p(1). r(sum(X)) :- p(X). ?- r(X)."
    assert rows(spark, text) == [(1,)]
    with pytest.raises(TypeMismatch):
        rows(spark, text, options=Options(strict=True))


def test_learnable_rules_follow_their_masks(spark):
    text = "q(1). r(2). learnable(a) :: p(X) :- q(X). learnable(b) :: p(X) :- r(X). ?- p(X)."
    assert rows(spark, text) == []
    assert rows(spark, text, options=Options(masks={"b": True})) == [(2,)]


def test_inputs_are_read_by_position(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "anything int, `odd name` string")
    assert rows(spark, "p(X, Y) :- t(X, Y). ?- p(X, Y).", inputs={"t": df}) == [(1, "a"), (2, "b")]


def test_parser_reports_places():
    with pytest.raises(ParseError) as e:
        parse("p(1).\nq(2) r(3).")
    assert (e.value.line, e.value.column) == (2, 6)


def test_random_programs_equal_a_naive_evaluator(spark):
    for seed in range(6):
        rnd = random.Random(seed)
        facts = {n: {(rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(8)} for n in ("e", "f")}
        xs = ["X", "Y", "Z"]
        rules = []
        for name in ("p", "q"):
            rules.append(((name, ("X", "Y")), [(rnd.choice(["e", "f"]), ("X", "Y"))], []))
            for _ in range(2):
                a, b = rnd.choice(["e", "f", "p", "q"]), rnd.choice(["e", "f", "p", "q"])
                rules.append(((name, ("X", "Z")), [(a, ("X", "Y")), (b, ("Y", "Z"))], []))
        rules.append((("r", ("X", "Y")), [("e", ("X", "Y"))], [("p", ("Y", "X"))]))
        rules.append((("r", ("X", "X")), [("f", ("X", rnd.choice(xs)))], [("q", ("X", "X"))]))
        want = evaluate(rules, facts, [{"p", "q"}, {"r"}])
        atom = lambda a: f"{a[0]}({', '.join(map(str, a[1]))})"
        text = " ".join(f"{n}({a}, {b})." for n, rs in facts.items() for a, b in rs)
        text += " ".join(f"{atom(h)} :- {', '.join([*map(atom, p), *('not ' + atom(x) for x in n)])}." for h, p, n in rules)
        result = Engine(spark).run(text + " ?- p(X, Y). ?- q(X, Y). ?- r(X, Y).")
        for name, q in zip("pqr", result.queries, strict=True):
            assert set(map(tuple, q.collect())) == want.get(name, set()), (seed, name)


def test_long_chains_of_rules_keep_small_plans(spark):
    text = "p0(1, 2). p0(2, 3). p0(3, 1). " + " ".join(f"p{i + 1}(A, C) :- p{i}(A, B), p{i}(B, C)." for i in range(14)) + " ?- p14(A, B)."
    assert len(rows(spark, text)) == 3


def test_cyclic_bodies_equal_plain_joins(spark):
    """Triangles, four-cycles, cliques and mixed bodies over skewed relations; with comparisons, aggregates and constants."""
    rnd = random.Random(17)
    rels = {n: {(rnd.choice([0, rnd.randint(0, 9)]), rnd.choice([0, rnd.randint(0, 9)])) for _ in range(45)} for n in "pqrs"}
    inputs = {n: spark.createDataFrame(sorted(rows), "a long, b long") for n, rows in rels.items()}
    texts = [
        "t(X, Y, Z) :- p(X, Y), q(X, Z), r(Y, Z). ?- t(X, Y, Z).",
        "t(X, Y, Z) :- p(X, Y), q(Z, X), r(Y, Z), X < Z, not s(X, Z). ?- t(X, Y, Z).",
        "t(W, X, Y, Z) :- p(W, X), q(X, Y), r(Y, Z), s(Z, W). ?- t(W, X, Y, Z).",
        "t(W, X, Y, Z) :- p(W, X), p(W, Y), p(W, Z), q(X, Y), q(X, Z), r(Y, Z). ?- t(W, X, Y, Z).",
        "t(X, count(Z), sum(Y)) :- p(X, Y), p(X, Z), p(Y, Z). ?- t(X, N, S).",
        "t(A, B, C, D, E) :- p(A, B), q(B, C), r(C, D), s(D, E), p(E, A). ?- t(A, B, C, D, E).",
        "t(X, Y) :- p(X, Y), q(Y, X), r(X, 0). ?- t(X, Y).",
        "t(X, Y, Z) :- p(X, Y), q(Y, Z), r(X, Z), s(Z, _). ?- t(X, Y, Z).",
    ]
    for text in texts:
        got, want = ([tuple(r) for r in Engine(spark, Options(promote=on)).run(text, inputs).queries[0].collect()] for on in (True, False))
        assert sorted(got) == sorted(want) and len(got) == len(set(got)), text
    x = {(a, b, c) for a, b in rels["p"] for a2, c in rels["q"] if a2 == a and (b, c) in rels["r"]}
    assert {tuple(r) for r in Engine(spark).run(texts[0], inputs).queries[0].collect()} == x and x
