"""Registered queries of single features over the driver's tables, each with its SQL."""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Options
from .errors import ConstraintViolation
from .operators import relational
from .queries import _FOLLOWS, follows, program, query, relation, table


def _folder(spark: SparkSession) -> str:
    """A new name below the shared folder."""
    from .plans.relation import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


# ---- operators and rules
query("operator_unit", lambda s, d: relational.join(relational.unit(s), table(s, d, "region").select("r_regionkey"), []).select("u", "r_regionkey"), "SELECT CAST(1 AS INT) AS u, r_regionkey FROM region")
query(
    "operator_nested_loop", lambda s, d: relational.select(relational.join(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), table(s, d, "nation").select("n_nationkey"), [], strategy="broadcast"), F.col("s_acctbal") < F.col("n_nationkey") * 100),
    "SELECT s_suppkey, s_acctbal, n_nationkey FROM supplier, nation WHERE s_acctbal < n_nationkey * 100",
)
query(
    "operator_chain_join", lambda s, d: relational.chain([table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c")), table(s, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n")), table(s, d, "nation").select(F.col("n_nationkey").alias("n"), "n_name")]).select("o_orderkey", "n_name"),
    "SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey",
)
query(
    "operator_project_filter", lambda s, d: relational.project(relational.select(table(s, d, "part"), F.col("p_size") > 40), key=F.col("p_partkey"), twice=F.col("p_size") * 2),
    "SELECT p_partkey AS key, CAST(p_size * 2 AS INT) AS twice FROM part WHERE p_size > 40",
)
query("operator_union", lambda s, d: relational.union([table(s, d, "customer").select(F.col("c_nationkey").alias("n")), table(s, d, "supplier").select("s_nationkey"), table(s, d, "nation").select("n_nationkey")]), "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
query(
    "operator_anti_merge", lambda s, d: relational.join(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "left_anti", "merge"),
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
query("operator_hash_join", lambda s, d: relational.join(table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n")), table(s, d, "nation").select(F.col("n_nationkey").alias("n"), "n_name"), ["n"], strategy="shuffle_hash"), "SELECT s_suppkey, s_nationkey AS n, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
query(
    "operator_group_aggregates", lambda s, d: relational.group(table(s, d, "events"), ["event_type"], {"n": ("count", "value"), "lo": ("min", "value"), "hi": ("max", "value")}),
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1",
)


def _violated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constraints that the tables violate."""
    out = []
    for k, text in enumerate(("known(C) :- customer(C, _, _). :- order(_, C, _), not known(C).", ':- order(_, _, "P").', "idle(C) :- customer(C, _, _). :- idle(C), order(_, C, _), customer(C, N, _), N > 24.")):
        try:
            Engine(spark).run(text, {n: relation(spark, sf_dir, n) for n in ("order", "customer")})
            out.append((k, False))
        except ConstraintViolation:
            out.append((k, True))
    return spark.createDataFrame(out, "k int, violated boolean")


query("constraint_violated", _violated, "SELECT * FROM (VALUES (0, EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))), (1, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P')), (2, EXISTS (SELECT 1 FROM customer WHERE c_nationkey > 24))) v(k, violated)")
program("rule_boolean_combination", 'low(P) :- part(P, _, S), S < 5. high(P) :- part(P, _, S), S > 45. either(P) :- low(P). either(P) :- high(P). neither(P) :- part(P, _, _), not low(P), not high(P). out(P, 1) :- either(P). out(P, 0) :- neither(P). ?- out(P, K).', "SELECT p_partkey AS p, CAST(CASE WHEN p_size < 5 OR p_size > 45 THEN 1 ELSE 0 END AS BIGINT) AS k FROM part", "p k", "part")
program("pragma_magic_sets", "#pragma magic_sets = on\nlater(From, To) :- follows(From, To). later(From, End) :- later(From, Mid), follows(Mid, End). ?- later(2, To).", f"WITH RECURSIVE f AS MATERIALIZED (SELECT a, b FROM {_FOLLOWS} WHERE b IS NOT NULL), r(b) AS (SELECT b FROM f WHERE a = 2 UNION SELECT f.b FROM r JOIN f ON f.a = r.b) SELECT b AS dst FROM r", "dst", more={"follows": follows})

# ---- lists and meta-predicates
_PARTS = "parts(K, L) :- region(K, _), findall(N, nation(N, _, K), L)."
program("lists_cons", f"{_PARTS} out(K, H, M) :- parts(K, [H | T]), length(T, M). ?- out(K, H, M).", "SELECT n_regionkey AS k, min(n_nationkey) AS h, CAST(count(*) - 1 AS BIGINT) AS m FROM nation GROUP BY 1", "k h m", "region", "nation")
program("lists_memberchk_is_list", f"{_PARTS} has(K, N) :- parts(K, L), is_list(L), nation(N, _, _), memberchk(N, L). ?- has(K, N).", "SELECT n_regionkey AS k, n_nationkey AS n FROM nation", "k n", "region", "nation")
program("lists_nth_enumerates", f"{_PARTS} at(K, I, N) :- parts(K, L), nth(I, L, N). ?- at(K, I, N).", "SELECT n_regionkey AS k, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS i, n_nationkey AS n FROM nation", "k i n", "region", "nation")
program("lists_msort_list_to_set", "out(K, A, B) :- region(K, _), append([3, 1, 3], [K, 1], L), msort(L, M), length(M, A), list_to_set(L, S), length(S, B). ?- out(K, A, B).", "SELECT r_regionkey AS k, CAST(5 AS BIGINT) AS a, CAST(CASE WHEN r_regionkey IN (1, 3) THEN 2 ELSE 3 END AS BIGINT) AS b FROM region", "k a b", "region")
program("meta_ground_var_nonvar", "out(K, 1) :- region(K, _), ground(K), nonvar(K). out(K, 2) :- var(X), region(K, _), nation(X, _, K). out(K, 3) :- region(K, _), var(K). ?- out(K, C).", "SELECT r_regionkey AS k, CAST(c AS BIGINT) AS c FROM region, (VALUES (1), (2)) v(c) WHERE c = 1 OR r_regionkey IN (SELECT n_regionkey FROM nation)", "k c", "region", "nation")


# ---- sources
def _round(end: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sources import files

        at = f"{_folder(spark)}.{end}"
        files.write_relation(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), at)
        kinds = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
        return files.read_relation(spark, at, None if end == "arrows" else kinds).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")

    return run


for _end in ("parquet", "csv", "jsonl", "orc", "arrows"):
    query(f"source_round_trip_{_end}", _round(_end), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")


def _triple_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("s"), F.replace("r_name", F.lit(" "), F.lit("_")).alias("o"))


def _triples(form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sources import files

        at, rows = f"{_folder(spark)}.{form}", _triple_rows(spark, sf_dir)
        if form == "nt":
            rows.select(F.concat(F.lit("<"), "s", F.lit("> <in> <"), "o", F.lit("> ."))).write.text(at)
        else:
            rows.select(F.col("s").alias("subject"), F.lit("in").alias("predicate"), F.col("o").alias("object")).write.json(at)
        return files.read_triples(spark, at).select("subject", "predicate", "object", "split")

    return run


for _form in ("nt", "jsonl"):
    query(f"source_triples_{_form}", _triples(_form), "SELECT replace(n_name, ' ', '_') AS subject, 'in' AS predicate, replace(r_name, ' ', '_') AS object, 'unspecified' AS split FROM nation JOIN region ON r_regionkey = n_regionkey")


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import files

    return files.histogram(_triple_rows(spark, sf_dir).select("s", F.col("o").alias("object")), "object")


query("source_triple_histogram", _histogram, "SELECT replace(r_name, ' ', '_') AS value, CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions through Arrow data that the driver holds, and back."""
    from .sources import files

    held = files.to_arrow(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return files.from_arrow(spark, held.to_batches()[0]).select("r_regionkey", "r_name")


query("source_record_batch", _batches, "SELECT r_regionkey, r_name FROM region")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the chunks in which all suppliers arrive."""
    from .sources import files

    sizes = [len(c) for c in files.chunks(table(spark, sf_dir, "supplier").select("s_suppkey"), 7)]
    return spark.createDataFrame(list(enumerate(sizes)), "k bigint, n bigint")


query("source_chunks", _chunks, "SELECT CAST(k AS BIGINT) AS k, CAST(least(7, n - k * 7) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM supplier), range(0, 1000000) r(k) WHERE k * 7 < n")
program("inline_facts", 'code("F", 1). code("O", 2). code("P", 3). coded(O, K) :- order(O, _, S), code(S, K). ?- coded(O, K).', "SELECT o_orderkey AS o, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS k FROM orders", "o k", "order")


# ---- sessions
def _session(spark: SparkSession, sf_dir: str, text: str, *names: str):
    from .streaming.session import Session

    s = Session(Engine(spark), text, {n: relation(spark, sf_dir, n) for n in names})
    s.evaluate()
    return s


def _coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a batch whose inserts and deletes cancel, and of one that doesn't."""
    from .streaming.session import Delta

    s = _session(spark, sf_dir, "many(S, count(O)) :- order(O, _, S). ?- many(S, N).", "order")
    new = spark.createDataFrame([(-1, -1, "F")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    none = s.apply([("order", Delta(insert=new)), ("order", Delta(delete=new))])
    some = s.apply([("order", Delta(insert=new))])
    return spark.createDataFrame([(0, none.changed_relations, none.inserted), (1, some.changed_relations, some.inserted)], "k int, changed bigint, inserted bigint")


query("session_coalesced_batches", _coalesced, "SELECT * FROM (VALUES (0, 0::BIGINT, 0::BIGINT), (1, 1::BIGINT, 1::BIGINT)) v(k, changed, inserted)")


def _session_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive relation after an insert, derived from the new rows only."""
    from .streaming.session import Session

    s = Session(Engine(spark), "later(A, B) :- next(A, B). later(A, C) :- later(A, B), next(B, C). ?- later(A, B).", {"next": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("a"), (F.col("n_regionkey") + 100).cast("bigint").alias("b"))})
    s.evaluate()
    s.insert("next", table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("bigint").alias("a"), (F.col("r_regionkey") + 200).cast("bigint").alias("b")))
    return s.evaluate().queries[0].toDF("a", "b")


query("session_insert_recursive", _session_insert, "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey + 100 AS BIGINT) AS b FROM nation UNION SELECT n_nationkey, n_regionkey + 200 FROM nation UNION SELECT r_regionkey + 100, r_regionkey + 200 FROM region")


def _session_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What callbacks saw of a delete and an insert, and the asynchronous answer after both."""
    s = _session(spark, sf_dir, "n(S, count(C)) :- customer(C, _, S). ?- n(S, N).", "customer")
    calls: list[tuple[str, int, int]] = []
    s.on_change(lambda name, stats: calls.append((name, stats.inserted, stats.deleted)), "customer")
    rows = relation(spark, sf_dir, "customer").where("c_nationkey = 3")
    s.delete("customer", rows)
    s.insert("customer", rows.where("c_mktsegment = 'BUILDING'"))
    total = sum(r[1] for r in s.evaluate_async().result().queries[0].collect())
    return spark.createDataFrame([(k, i, d, total) for k, (_, i, d) in enumerate(calls)], "k int, inserted bigint, deleted bigint, total bigint")


query("session_callbacks_async", _session_callbacks, "SELECT CAST(k AS INT) AS k, CAST(CASE k WHEN 0 THEN 0 ELSE b END AS BIGINT) AS inserted, CAST(CASE k WHEN 0 THEN a ELSE 0 END AS BIGINT) AS deleted, CAST(n - a + b AS BIGINT) AS total FROM (SELECT count(*) FILTER (WHERE c_nationkey = 3) AS a, count(*) FILTER (WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING') AS b, count(*) AS n FROM customer), (VALUES (0), (1)) v(k) WHERE k = 0 OR b > 0")


# ---- probabilities: a program for every region, with numbers from the tables
def _exact(name: str, text, columns: str, sql: str, more=lambda e, a: ()) -> None:
    """text(region, nations) is a program whose answers give rows (region, number of the answer, probability, ...)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .lang.parser import parse
        from .prob.exact import Exact

        nations: dict[int, list[int]] = {}
        for n, r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():
            nations.setdefault(r, []).append(n)
        rows = []
        for r, ns in sorted(nations.items()):
            e = Exact(parse(text(r, sorted(ns))))
            for k, q in enumerate(e.program.prob_queries):
                rows += [(r, k, round(a.probability, 6), *more(e, a)) for a in e.ask(q, gradients=True)]
        return spark.createDataFrame(rows, columns)

    query(name, run, sql)


_P = lambda n: f"{(n + 1) / 32:.5f}"
_ROWS = "region int, k int, probability double"
_N = "(SELECT n_regionkey AS region, (n_nationkey + 1) / 32.0::DOUBLE AS p, n_nationkey AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)"
_exact(
    "probability_annotated_disjunction", lambda r, ns: "; ".join(f"{1 / (len(ns) + 1):.12f}::seat({n})" for n in ns) + ". " + " ".join(f"query(seat({n}))." for n in ns), _ROWS,
    "SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS k, round(1.0::DOUBLE / (1 + count(*) OVER (PARTITION BY n_regionkey)), 6) AS probability FROM nation",
)
_exact(
    "probability_evidence", lambda r, ns: " ".join(f"{_P(n)}::on({n})." for n in ns) + " lit() :- on(N). evidence(lit(), true). " + " ".join(f"query(on({n}))." for n in ns), _ROWS,
    f"SELECT region, CAST(i - 1 AS INT) AS k, round(p / (1 - product(1 - p) OVER (PARTITION BY region)), 6) AS probability FROM {_N}",
)
_exact(
    "probability_log_evidence", lambda r, ns: " ".join(f"{_P(n)}::on({n})." for n in ns) + f" lit() :- on(N). evidence(lit(), true). query(on({ns[0]})).", f"{_ROWS}, log_evidence double",
    f"SELECT region, CAST(0 AS INT) AS k, round(min(p) / (1 - product(1 - p)), 6) AS probability, round(ln(1 - product(1 - p)), 6) AS log_evidence FROM {_N} GROUP BY 1", lambda e, a: (round(e.log_evidence, 6),),
)
_exact(
    "probability_gradients", lambda r, ns: " ".join(f"{_P(n)}::on({n})." for n in ns) + " lit() :- on(N). query(lit()).", f"{_ROWS}, slopes double",
    f"SELECT region, CAST(0 AS INT) AS k, round(1 - any_value(q), 6) AS probability, round(sum(q / (1 - p)), 6) AS slopes FROM (SELECT *, product(1 - p) OVER (PARTITION BY region) AS q FROM {_N}) GROUP BY 1", lambda e, a: (round(sum(a.gradient.values()), 6),),
)
_exact(
    "probability_negation", lambda r, ns: " ".join(f"{_P(n)}::on({n})." for n in ns) + " lit() :- on(N). dark() :- not lit(). query(dark()).", _ROWS,
    f"SELECT region, CAST(0 AS INT) AS k, round(product(1 - p), 6) AS probability FROM {_N} GROUP BY 1",
)
_exact(
    "probability_well_founded", lambda r, ns: f"{_P(ns[0])}::open(). {_P(ns[1])}::shut(). go() :- not stay(), open(). stay() :- not go(), open(). stay() :- shut(). query(stay()). query(go()).", _ROWS,
    f"SELECT region, CAST(k AS INT) AS k, round(CASE k WHEN 0 THEN p ELSE 0 END, 6) AS probability FROM {_N}, (VALUES (0), (1)) v(k) WHERE i = 2",
)
_exact(
    "probability_aggregates", lambda r, ns: f"{_P(ns[0])}::e(1, 2). {_P(ns[1])}::e(1, 3). d(X, count(Y)) :- e(X, Y). s(X, sum(Y)) :- e(X, Y). m(X, min(Y)) :- e(X, Y). x(X, max(Y)) :- e(X, Y). query(d(1, 2)). query(s(1, 5)). query(m(1, 2)). query(x(1, 3)). query(d(1, 0)).", _ROWS,
    f"SELECT a.region, CAST(k AS INT) AS k, round(CASE k WHEN 2 THEN a.p WHEN 3 THEN b.p WHEN 4 THEN 0 ELSE a.p * b.p END, 6) AS probability FROM {_N} a JOIN {_N} b ON b.region = a.region AND a.i = 1 AND b.i = 2, (VALUES (0), (1), (2), (3), (4)) v(k)",
)
_exact(
    "probability_recursive", lambda r, ns: " ".join(f"{_P(n)}::way({i}, {i + 1})." for i, n in enumerate(ns)) + f" far(X, Y) :- way(X, Y). far(X, Z) :- far(X, Y), way(Y, Z). query(far(0, {len(ns)})).", _ROWS,
    f"SELECT region, CAST(0 AS INT) AS k, round(product(p), 6) AS probability FROM {_N} GROUP BY 1",
)


def _sampled(name: str, text: str) -> None:
    """Whether the exact probabilities lie in the sampled intervals, and a second run gives the same."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from . import prob

        p = (table(spark, sf_dir, "region").count() + 1) / 32
        given = text.replace("{p}", f"{p:.5f}")
        want, one, two = prob.exact(given), *(prob.monte_carlo(spark, given, samples=2000, seed=5, confidence=0.99999) for _ in range(2))
        return spark.createDataFrame([(k, e.low - 1e-9 <= w.probability <= e.high + 1e-9, one == two) for k, (e, w) in enumerate(zip(one, want, strict=True))], "k int, inside boolean, repeatable boolean")

    query(name, run, f"SELECT CAST(k AS INT) AS k, true AS inside, true AS repeatable FROM range(0, {text.count('query(')}) r(k)")


_sampled("monte_carlo_rejection", "{p}::rain(). 0.3::hose(). wet() :- rain(). wet() :- hose(). evidence(wet(), true). query(rain()). query(hose()).")
_sampled("monte_carlo_clamping", "{p}::a(). 0.5::b(). c() :- a(), b(). evidence(a(), true). query(c()).")
_sampled("monte_carlo_negative_cycle", "{p}::open(). 0.25::shut(). go() :- not stay(), open(). stay() :- not go(), open(). stay() :- shut(). query(stay()). query(go()).")
_sampled("monte_carlo_recursive", "{p}::way(1, 2). 0.5::way(2, 3). 0.5::way(1, 3). far(X, Y) :- way(X, Y). far(X, Z) :- far(X, Y), way(Y, Z). query(far(1, 3)).")


def _neural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a nation has at least one supplier whose label isn't 0, by a network over keys."""
    from .prob import neural

    def make():
        import numpy as np

        return lambda b: np.stack([0.5 + (b["s_suppkey"].to_numpy() % 5) / 10, 0.5 - (b["s_suppkey"].to_numpy() % 5) / 10], axis=1)

    scored = neural.predictions(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), make, [0, 1])
    return neural.noisy_or(scored.where("label = 1"), ["s_nationkey"]).select("s_nationkey", F.round("probability", 6).alias("probability"))


query("neural_noisy_or", _neural, "SELECT s_nationkey, round(1 - product(1 - (0.5::DOUBLE - (s_suppkey % 5) / 10)), 6) AS probability FROM supplier GROUP BY 1")


# ---- modal programs
def _modal(name: str, text: str, columns: str, sql: str, *relations: str, mode: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from . import epistemic

        return epistemic.run(spark, text, {n: relation(spark, sf_dir, n) for n in relations}, mode=mode).queries[0].toDF(*columns.split())

    query(name, run, sql)


_LOOP = "seen(N) :- supplier(_, N). holds(N) :- seen(N). holds(N) :- possible holds(N), nation(N, _, _). ?- holds(N)."
_modal("modal_faeel_founded", _LOOP, "n", "SELECT DISTINCT s_nationkey AS n FROM supplier", "supplier", "nation")
_modal("modal_nested", 'rich(C) :- balance(C, B), B > 9000.0. poor(C) :- know not possible rich(C), customer(C, _, _). ?- poor(C).', "c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal <= 9000", "balance", "customer")
_modal("modal_constraint_accepted", 'big(C) :- balance(C, B), B > 9000.0. pred never(i64). :- know never(C). ok(C) :- know big(C), customer(C, _, _). ?- ok(C).', "c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000", "balance", "customer")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World views of a self-supporting belief for each region, and which readings hold it."""
    from . import epistemic

    rows = []
    for (r,) in table(spark, sf_dir, "region").select("r_regionkey").collect():
        text = f"pred p{r}(). p{r}() :- possible p{r}(). ?- p{r}()."
        held = [not epistemic.run(spark, text, mode=m).queries[0].isEmpty() for m in ("faeel", "g91")]
        rows.append((r, len(epistemic.world_views(f"p{r}() :- possible p{r}().")), *held))
    return spark.createDataFrame(rows, "r int, views int, faeel boolean, g91 boolean")


query("modal_world_views_g91", _views, "SELECT r_regionkey AS r, CAST(2 AS INT) AS views, false AS faeel, true AS g91 FROM region")


# ---- induction and solving
def _homes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(supplier, nation) and (nation, region)."""
    home = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("n"))
    return home, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), F.col("n_regionkey").cast("bigint").alias("r"))


def _topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of star, fanout and fanin over (supplier, nation) and (nation, region)."""
    from . import induce

    home, lies = _homes(spark, sf_dir)
    wrong = home.select("s_suppkey", (F.col("n") + 100).alias("n"))
    return induce.coverage([home, lies], home, wrong, ["fanout", "fanin", "star"]).select("topology", "left", "right", "pos", "neg")


query(
    "induction_topologies", _topologies,
    """WITH home AS (SELECT DISTINCT s_suppkey AS x, CAST(s_nationkey AS BIGINT) AS y FROM supplier), lies AS (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS x, CAST(n_regionkey AS BIGINT) AS y FROM nation),
    rel AS (SELECT 0 AS r, * FROM home UNION ALL SELECT 1, * FROM lies),
    ex AS (SELECT x, y, true AS good FROM home UNION ALL SELECT x, y + 100, false FROM home),
    hit AS (
      SELECT DISTINCT 'fanout' AS t, l.r AS l, r.r AS r, e.x, e.y, good FROM ex e JOIN rel l ON l.x = e.x AND l.y = e.y JOIN rel r ON r.x = e.x
      UNION SELECT DISTINCT 'fanin', l.r, r.r, e.x, e.y, good FROM ex e JOIN rel l ON l.x = e.x AND l.y = e.y JOIN rel r ON r.y = e.y
      UNION SELECT DISTINCT 'star', l.r, r.r, e.x, e.y, good FROM ex e JOIN rel l ON l.y = e.x JOIN rel r ON r.x = l.x AND r.y = e.y),
    grid AS (SELECT t, l, r FROM (VALUES ('fanout'), ('fanin'), ('star')) a(t), (VALUES (0), (1)) b(l), (VALUES (0), (1)) c(r))
    SELECT t AS topology, CAST(l AS INT) AS "left", CAST(r AS INT) AS "right", CAST(count(*) FILTER (WHERE good) AS BIGINT) AS pos, CAST(count(*) FILTER (WHERE NOT good) AS BIGINT) AS neg FROM grid LEFT JOIN hit USING (t, l, r) GROUP BY 1, 2, 3""",
)


def _nary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best body that explains (supplier, region)."""
    from .induce import nary

    home, lies = _homes(spark, sf_dir)
    good = home.join(lies, "n").select("s_suppkey", "r")
    best = nary.induce(spark, {"b": home, "c": lies}, good, good.select("s_suppkey", (F.col("r") + 100).alias("r")), top=1)[0]
    return spark.createDataFrame([(best.rule, best.pos, best.neg)], "rule string, pos bigint, neg bigint")


query("induction_nary", _nary, "SELECT 'h(X0, X1) :- b(X0, Z0), c(Z0, X1).' AS rule, CAST(count(*) AS BIGINT) AS pos, CAST(0 AS BIGINT) AS neg FROM supplier JOIN nation ON n_nationkey = s_nationkey")


def _colouring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the nations of a region coloured with k colours so that all differ?  By the solver and, where it can be, by local search."""
    from .sat import Solver, local_search

    rows = []
    for r, n in table(spark, sf_dir, "nation").groupBy("n_regionkey").count().collect():
        for k in (n - 1, n):
            v = lambda i, c: i * k + c + 1  # noqa: B023, E731
            clauses = [tuple(v(i, c) for c in range(k)) for i in range(n)] + [(-v(i, c), -v(j, c)) for c in range(k) for i in range(n) for j in range(i)]
            found = Solver(list(clauses)).solve().status
            tried = local_search(clauses).status if k == n else "unknown"
            best = Solver(list(clauses)).maximise([((v(0, c),), c + 1) for c in range(k)]) if k == n else None
            rows.append((r, k, found, tried, best[0] if best else None))
    return spark.createDataFrame(rows, "region int, k bigint, solver string, search string, best bigint")


query("solver_colouring", _colouring, "SELECT n_regionkey AS region, CAST(n - 1 + d AS BIGINT) AS k, CASE d WHEN 1 THEN 'sat' ELSE 'unsat' END AS solver, CASE d WHEN 1 THEN 'sat' ELSE 'unknown' END AS search, CAST(CASE d WHEN 1 THEN n END AS BIGINT) AS best FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1), (VALUES (0), (1)) v(d)")


# ---- tools
def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which regions a program proves to have a nation of the same number, and by how many lines."""
    from . import diagnostics

    facts = " ".join(f"at({n}, {r})." for n, r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect())
    rows = []
    for (r,) in table(spark, sf_dir, "region").select("r_regionkey").collect():
        proof = diagnostics.prove(f"{facts} same(R) :- at(R, R).", f"same({r})")
        rows.append((r, proof is not None, len(proof.lines()) if proof else 0))
    return spark.createDataFrame(rows, "r int, holds boolean, n int")


query("tool_proofs", _proofs, "SELECT r_regionkey AS r, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = r_regionkey AND n_regionkey = r_regionkey) AS holds, CAST(CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = r_regionkey AND n_regionkey = r_regionkey) THEN 2 ELSE 0 END AS INT) AS n FROM region")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import diagnostics

    _, profile = diagnostics.profile(Engine(spark), "at(N, R) :- nation(N, _, R). per(R, count(N)) :- at(N, R). ?- per(R, N).", {"nation": relation(spark, sf_dir, "nation")})
    return spark.createDataFrame([(k, n) for k, n in profile.rows.items() if k in ("at/2", "per/2")], "name string, n bigint")


query("tool_profile", _profile, "SELECT 'at/2' AS name, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'per/2', count(DISTINCT n_regionkey) FROM nation")


def _cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of the command line: run, explain, a missing file, an unknown command."""
    import tempfile
    from pathlib import Path

    from .cli import main

    rows = table(spark, sf_dir, "region").count()
    with tempfile.TemporaryDirectory() as d:  # read by the driver alone
        at = Path(d, "p.dl")
        at.write_text(" ".join(f"r({k})." for k in range(rows)) + " big(X) :- r(X), X > 2. ?- big(X).")
        out = io.StringIO()
        codes = [main(["run", str(at)], spark, out), main(["explain", str(at)], spark, out), main(["run", f"{at}.absent"], spark, io.StringIO()), main(["nonsense"], spark, io.StringIO())]
    return spark.createDataFrame([(k, c, f"rows: {rows - 3}" in out.getvalue()) for k, c in enumerate(codes)], "k int, code int, told boolean")


query("tool_command_line", _cli, "SELECT * FROM (VALUES (0, 0, true), (1, 0, true), (2, 1, true), (3, 2, true)) v(k, code, told)")

__all__: list[str] = []
