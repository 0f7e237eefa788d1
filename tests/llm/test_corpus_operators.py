"""Operators over many rows: chat trees, URL models, near duplicates, tiling; and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat, common, neardup, secrets, tiling, urls
from quern.llm.queries import ENGLISH_RANKS, PATTERN

SCHEMA = "doc_id bigint, text string, id string, component bigint, a bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


# ---- chat
def test_chat_round_trip(spark):
    texts = ["", "<|im_end|>", "<\\|x", "<<|im_start|>user\n", "a<", "<\\", "%0A", "long " * 20_000, None]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)] + [(2, 0, "sys\n%0A<|", "x"), (3, None, None, "y"), (3, 1, "assistant", "z"), (None, 0, "user", "n"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.render(chat.from_turns(turns.withColumn("leaf", F.lit(1))))
    got = {r.tree: r for r in out.select("tree", "n_turns", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(texts)]]
    assert got[1].loss == "".join(t or "" for t in texts[1::2]) and got[2].turns[0].role == "sys\n%0A<|"
    assert [(t.role, t.text) for t in got[3].turns] == [("assistant", "z"), ("", "y")] and got[4].n_turns == 2 and None in got
    assert chat.render(chat.from_turns(turns.limit(0))).count() == 0


def test_reply_trees_equal_enumeration(spark):
    rnd, rows = random.Random(7), []
    for tree in range(4):
        for n in range(12):
            rows.append((tree, n, rnd.randrange(n) if n else None, "user", f"t{n}", float(rnd.randint(0, 3))))
    rows += [(9, 0, 1, "user", "cycle", 1.0), (9, 1, 0, "user", "cycle", 1.0), (9, 2, 1, "user", "below", 1.0), (10, 0, 77, "user", "orphan", None)]
    nodes = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    want = {}
    for tree in {r[0] for r in rows} - {9}:
        up = {n: p for t, n, p, *_ in rows if t == tree}
        score = {n: s or 0.0 for t, n, _, _, _, s in rows if t == tree}
        paths = []
        for leaf in set(up) - set(up.values()):
            path, n = [], leaf
            while n in up:
                path.append(n)
                n = up[n]
            paths.append((-sum(score[x] for x in path), leaf, path[::-1]))
        want |= {(tree, rank): (leaf, [f"t{n}" if tree != 10 else "orphan" for n in path]) for rank, (_, leaf, path) in enumerate(sorted(paths)[:2], 1)}
    got = {(r.tree, r.rank): (r.leaf, [t.text for t in r.turns]) for r in chat.render(nodes, top=2).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert got == want


# ---- urls
def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme": ("", "", None), "http://A.Com": ("a.com", "", None), "http://a.com/": ("a.com", "/", "com/"),
        "x://EXAMPLE.com/en/1?q=/fr": ("example.com", "/en/1", "example.com/en/"), "h://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "h://notexample.com/en/": ("notexample.com", "/en/", "com/"), "h://a.net/es/1#x": ("a.net", "/es/1", "net/es/"), "h://a.net/ES/": ("a.net", "/ES/", None),
        "h://É.Com/x://y": ("É.com", "/x://y", "com/"), "h://a.com?x/": ("a.com", "", None), "://": ("", "", None),
    }
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(cases)] + [(None, "h://a.com/", "v"), (0, None, "v")], "page_id bigint, url string, verdict string")
    got = urls.judged(df).collect()
    assert len(got) == len(cases) + 2 and all(r.verdict in ("allow", "block") for r in got)
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert {u: (by[i].host, by[i].path, by[i].rule) for i, u in enumerate(cases)} == cases
    assert urls.judged(df.limit(0)).count() == 0


def test_url_models_tell_decided_kinds_apart(spark):
    rnd = random.Random(1)
    word = lambda s: "".join(rnd.choices(s, k=8))
    rows = [(f"h://{word('abcde')}.com/{word('abc')}",) for _ in range(200)] + [(f"h://{word('vwxyz')}.net/es/{word('xyz')}",) for _ in range(200)]
    asked = [(f"h://{word('abcde')}.org/{word('abc')}", "allow") for _ in range(40)] + [(f"h://{word('vwxyz')}.org/es/{word('xyz')}", "block") for _ in range(40)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([r[0] for r in rows] + [a for a, _ in asked])], "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judged(df).collect()}
    right = sum(got[400 + i].verdict == v for i, (_, v) in enumerate(asked))
    assert right >= 76


def test_grams_of_any_length(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choices("abé🦆\n", k=n)) for n in (1, 2, 4, 5, 251, 252, 253, 255, 256, 257, 260, 511, 512, 513, 2000)]
    got = urls._grams(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, s string")).groupBy("id", "gram").count().collect()
    want = Counter((i, ("\x02" * 4 + t)[k : k + 5]) for i, t in enumerate(texts) for k in range(len(t)))
    assert {(r.id, r.gram): r["count"] for r in got} == want


def test_a_very_long_url(spark):
    """A million characters: grams are what is written, not the url for each of them; its score is that of a brute-force count."""
    rnd = random.Random(3)
    rows = [(i, f"h://{''.join(rnd.choices('abcde', k=8))}.com/{i}") for i in range(30)] + [(40 + i, f"h://{''.join(rnd.choices('vwxyz', k=8))}.net/es/{i}") for i in range(30)]
    long = "h://a.org/" + "".join(rnd.choices("abcdefghij", k=1_000_000))
    df = spark.createDataFrame([*rows, (99, long), (100, "h://abcdeabc.org/")], "page_id bigint, url string")
    base = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    size = lambda: sum(f.stat().st_size for f in base.rglob("*") if f.is_file()) if base else 0
    before = size()
    got = {r.page_id: r for r in urls.judged(df).collect()}
    assert len(got) == 62 and got[100].verdict == "allow"
    assert not base or size() - before < 40_000_000
    train = Counter()
    for _, u in rows:
        s = u[4:]
        if int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 5:
            train.update((("\x02" * 4 + s)[k : k + 5], ".net" not in u) for k in range(len(s)))
    parts = [Counter() for _ in range(5)]
    contexts = [Counter() for _ in range(5)]
    for (g, good), n in train.items():
        for k in range(5):
            parts[k][g[4 - k :], good] += n
            contexts[k][g[4 - k : 4], good] += n

    def p(g, good):
        out = 1 / 256
        for k in range(5):
            out = (parts[k][g[4 - k :], good] + 2 * out) / (contexts[k][g[4 - k : 4], good] + 2)
        return out

    s = long[4:]
    grams = Counter(("\x02" * 4 + s)[k : k + 5] for k in range(len(s)))
    total = sum(n * round(math.log(p(g, True) / p(g, False)) * 1e6) for g, n in grams.items())
    assert abs(got[99].score - total / len(s) / 1e6) < 2e-6


# ---- near duplicates
def brute_groups(rows, n=4, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if w]
        sets.append((i, {tuple(ws[j : j + n]) for j in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(at)
    for at, (i, s) in enumerate(sets):
        for other, k in Counter(o for x in s for o in index[x] if o > at).items():
            j, t = sets[other]
            if None not in (i, j) and 100 * k >= percent * (len(s) + len(t) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def corpus(rnd, n=60):
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([1, 3, 4, 12, 60, 200]))]
        rows.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 5])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 6])):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(rnd.choice([" ", "\n\t"]).join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    # a chain of small steps, whose ends aren't alike, and a hot key
    ws = [f"w{i}" for i in range(120)]
    chain = [(5000 + k, " ".join(f"v{i}" if i < 4 * k else w for i, w in enumerate(ws))) for k in range(12)]
    hot = [(6000 + k, " ".join([*ws[:100], *(f"z{k}_{j}" for j in range(k % 40))])) for k in range(60)]
    rows = corpus(random.Random(5)) + chain + hot + [(7000, None), (7001, ""), (7002, " \t\n"), (None, "a b c d e"), (7003, "a b c d e"), (7004, "É é"), (7005, "é é"), (7006, "one"), (7007, "ONE"), (7007, "ONE")]
    got = neardup.groups(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_groups(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    five = neardup.groups(frame(spark, rows), shingle=5)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in five.collect()) == Counter(brute_groups(rows, 5))
    kept = neardup.deduplicated(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    want = {c for i, _, c in brute_groups(rows) if i is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert neardup.groups(frame(spark, []) if rows is None else frame(spark, rows).limit(0)).count() == 0


def test_one_text_of_a_repeated_id_links_it(spark):
    a, b = "a b c d e f g", "q r s t u v w"
    got = neardup.groups(frame(spark, [(3, a), (3, b), (2, a), (9, b)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(2, 2), (3, 2), (9, 2)}


def test_narrowing_loses_nothing(spark):
    wanted = spark.range(0, 40_000, 7)
    got = common.narrowed(spark.range(60_000).withColumn("_map", F.lit(1)), "id", wanted)
    ids = {r.id for r in got.collect()}
    assert got.columns == ["id", "_map"] and set(range(0, 40_000, 7)) <= ids and len(ids) < 6000
    assert common.narrowed(spark.range(10), "id", wanted.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    rnd = random.Random(9)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_minima_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        n, common = 2000, int(2000 * 2 * j / (1 + j))
        x = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        est = [(neardup.minima(np.roll(x, k)[:n]) == neardup.minima(np.roll(x, k)[n - common :])).mean() for k in range(0, 2000, 50)]
        assert abs(np.mean(est) - j) < 0.03


# ---- tiling
def brute_tiles(doc, item, least):
    """Longest unmarked common runs, by comparing every pair of places."""
    md, mi, total = set(), set(), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in md and j + k not in mi:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return total
        k, i, j = best
        md |= set(range(i, i + k))
        mi |= set(range(j, j + k))
        total += k


def test_tiles_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(150):
        doc, item = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        got = tiling.tile(doc, item, 3)
        assert sum(t[2] for t in got) == brute_tiles(doc, item, 3)
        assert len({d + k for d, _, n in got for k in range(n)}) == len({i + k for _, i, n in got for k in range(n)}) == sum(t[2] for t in got)


def test_decontamination(spark):
    ws = [f"word{i}" for i in range(40)]
    item, other = " ".join(ws), "The quick brown fox jumps over the lazy dog again and again"
    bench = spark.createDataFrame([(1, item, "x"), (2, other, "x"), (3, "two words", "x"), (4, None, "x"), (5, "", "x"), (1, item, "x")], "item_id bigint, text string, key string")
    swapped = " ".join(ws[20:] + ["between"] + ws[:20]).upper()
    rows = [(0, "start " + item + ". end"), (1, swapped), (2, " ".join(ws[:20])), (3, "The, quick; brown fox jumps OVER the lazy dog again"), (4, None), (5, ""), (6, "here are two words indeed"), (7, "clean " * 30_000), (8, " ".join(w for w in ws for _ in range(2)))]
    got = tiling.matches(frame(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {*((d, 1) for d in (0, 1)), (3, 2), (6, 3)}
    assert got.where("doc_id = 1").first().n_tiles == 2 and got.where("item_id = 1").count() == 4
    assert sorted(r.doc_id for r in tiling.clean(frame(spark, rows), bench).collect()) == [2, 4, 5, 7, 8]
    assert tiling.matches(frame(spark, rows), bench.limit(0)).count() == tiling.matches(frame(spark, rows).limit(0), bench).count() == 0


def test_decontamination_equals_brute_force(spark):
    """Whole documents tiled against every item, without seeds."""
    rnd = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rnd.choices(vocabulary, k=rnd.choice([2, 4, 5, 8, 20, 30]))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 15)))]
        for _ in range(rnd.randint(0, 2)):
            ws = rnd.choice(items).split()
            cut = rnd.randint(0, len(ws))
            parts += rnd.choice([[" ".join(ws)], [" ".join(ws[cut:]), "x", " ".join(ws[:cut])], [" ".join(ws[: cut + 3])]])
        rows.append((i, " ".join(parts)))
    rows += [(3, rows[5][1]), (None, items[5]), (None, "a clean text")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = Counter()
    for d, text in rows:
        for i, said in enumerate(items):
            ws = said.split()
            covered = brute_tiles(text.split(), ws, min(5, len(ws)))
            if covered >= 0.6 * len(ws):
                want[d, i, covered, len(ws)] += 1
    got = tiling.matches(frame(spark, rows), bench)
    assert Counter((r.doc_id, r.item_id, r.covered, r.n_words) for r in got.collect()) == want
    dirty = {(d, t) for d, t in rows if any(brute_tiles(t.split(), s.split(), min(5, len(s.split()))) >= 0.6 * len(s.split()) for s in items)}
    left = tiling.clean(frame(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter(r for r in rows if r not in dirty) and (None, "a clean text") in {(r.doc_id, r.text) for r in left}


def test_rows_that_share_an_id(spark):
    """Different texts of one id stay together; copies within it are one; the choice doesn't depend on partitions."""
    a, b, c = ("one two three four five six seven eight", "red green blue black white grey brown pink", "Red green  blue black white grey brown pink")
    rows = [(1, a), (1, b), (1, c), (1, a), (2, b), (3, "some other words that stand here alone now"), (None, a), (None, a), (4, ""), (4, None)]
    for parts in (1, 7):
        got = neardup.deduplicated(frame(spark, rows).repartition(parts), shingle=5).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (1, c), (3, rows[5][1]), (None, a), (None, a), (4, None)])


def test_columns_of_any_name(spark):
    """Dots, back-ticks and names that the operators use, in every stage of the pipeline but the last."""
    from quern.llm import quality

    df = spark.createDataFrame([(i, t, "x", 1.5, [1], "k") for i, t in enumerate(["word " * 30, "other words here " * 9, None, "token=abcdefgh12"])], "doc_id bigint, text string, `a.b` string, `c``d` double, _all array<int>, _k string")
    model = quality.Ensemble(list(quality.statistics(F.lit(""))))
    assert quality.kept(df, model).columns == df.columns == secrets.redacted(df, ENGLISH_RANKS, PATTERN).columns
    assert secrets.redacted(df, ENGLISH_RANKS, PATTERN).where("doc_id = 3").first()["text"] == "[ASSIGN]"
    assert quality.kept(df, model).count() == neardup.deduplicated(df).count() == 4
    bench = spark.createDataFrame([(1, "other words here other words here other words")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in tiling.clean(df, bench).collect()) == [0, 2, 3]
    assert common.without(df, common.quoted("doc_id"), df.select("doc_id").where("doc_id < 2")).columns == df.columns


# ---- pipeline
@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("tables")
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    rows = [(i, prose(rnd.randint(30, 80))) for i in range(120)] + [(200 + i, " ".join(word().upper() + "!!" for _ in range(40))) for i in range(60)]
    item = prose(30)
    rows += [(300, rows[3][1]), (301, rows[4][1] + " more"), (302, f"x {item} y"), (303, "token=abcdefgh12 " + prose(40)), (304, None), (305, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows[:180]], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), dict(rows)


def test_pipeline(spark, small):
    d, rows = small
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        seen.append({r.doc_id for r in out.collect()})
        if name != "encoding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = out
    quality_kept, unique, clean, redacted, encoded = seen
    assert {i for i in rows if 200 <= i < 260}.isdisjoint(quality_kept) and set(range(120)) <= quality_kept
    want = {c for _, _, c in brute_groups([(i, rows[i]) for i in sorted(quality_kept)], 5)}
    assert unique == want and 300 not in unique and 301 not in unique
    assert clean == unique - {302} and redacted == clean == encoded
    text = docs.where("doc_id = 303").first()
    assert text.text.startswith("[ASSIGN] ") and text.n_chars == len(text.text)
    tester = secrets.Tester(ENGLISH_RANKS, PATTERN)
    assert all(not r.text or not tester.spans(r.text)[0] for r in docs.collect())
    final = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in final} == encoded and all(r.round_trip and r.n_tokens == len(r.ids) for r in final)


def test_queries_of_the_contract(spark, small):
    from quern.llm.queries import QUERIES

    d, rows = small
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id bigint, turn bigint, role string, text string").write.mode("overwrite").parquet(f"{d}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op1_chat_formatting"](spark, d).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].n_turns) == (2, 2)
    for name in ("op2_secret_scan", "op4_byte_bpe", "op5_minhash_dedup", "op6_quality_rules", "op8_avi_media"):
        assert QUERIES[name](spark, d).count() == len(rows)
    assert {r.doc_id for r in QUERIES["op10_decontamination"](spark, d).collect()} == {302}
