"""MinHash near-duplicate groups.

Words are lower-cased (A-Z only) runs of characters other than space and U+0009..U+000D; a document's set is that of
its distinct runs of ``SHINGLE`` words (fewer words: the whole sequence as one).  Documents whose sets
have a Jaccard similarity of at least ``PERCENT`` / 100 are linked, and groups are the connected components.

1. One pass computes of every document the size of its set, a 128-bit digest of the set, ``BANDS`` x ``ROWS`` minima
   under universal hash functions (their low bytes are kept), and a key for each band.  Texts don't leave the scan.
2. Documents with equal sets are copies: they link to the smallest id of theirs, and only that one goes on.
3. Of each band key the smallest id (a partial aggregate) is the pivot; the key's other documents are compared with it
   alone, so that a hot key never makes all its pairs.  Pairs are tested by their minima, then on full sets, rebuilt
   from the whole texts of just those documents.
4. Links give components, by alternating large-star and small-star.  A key whose documents are still
   in several components takes further pivots, four times as many each round, against documents of other
   components only, until each key is of one component or all were pivots; so no link is lost that the bands can see.

At the similarity of exactly 0.8 the bands miss a pair with probability 3e-6, and the test of the
minima (``AGREE``) with 5e-6; above it both fall fast.

Defined results: documents without words (null, empty) are linked with nothing and have size 0; a document without
id is linked with nothing, its component is null and it is kept; rows that share an id are one document of
several texts, linked if any of them is; repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, narrowed, quoted, without

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Of the low bytes of HASHES minima, so many must agree before the full sets are compared.
AGREE = int(0.66 * HASHES)
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_POLY, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BAND = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hasher(dict):
    """word -> 64-bit hash; forgets all words when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hasher: Hasher, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of n words."""
    ws = text.encode().lower().split() if text else []  # of bytes, both know ASCII only
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hasher.__getitem__, ws), np.uint64, len(ws))
    size = min(n, len(ws))
    out = np.full(len(ws) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _POLY + h[i : len(ws) - size + 1 + i]
    return np.unique(_mix(out))


def minima(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a set that isn't empty: of a * x + b mod 2^32 over the high halves x, a odd."""
    best, x = np.full(HASHES, 0xFFFFFFFF, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        h = np.multiply(x[at : at + 512, None], _A[None, :])
        h += _B
        np.minimum(best, h.min(axis=0), out=best)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((rows * _BAND[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _POLY).view(np.int64)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    import xxhash

    arrow = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("minima", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def make():
        hasher = Hasher()

        def work(cols):
            out = [[] for _ in range(4)]
            for text in cols[1]:
                s = shingles(text, hasher, shingle)
                row = (0, None, None, None)
                if len(s):
                    m = minima(s)
                    row = (len(s), xxhash.xxh3_128_digest(s.tobytes()), m.astype(np.uint8).tobytes(), band_keys(m))
                for o, x in zip(out, row, strict=True):
                    o.append(x)
            return [cols[0], *out]

        return work

    return map_rows(docs, make, "id bigint, n bigint, digest binary, minima binary, keys array<bigint>", arrow)


def _agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of which enough minima agree."""
    sk = sketches.select("id", "minima")
    both = pairs.join(sk.toDF("a", "ma"), "a").join(sk.toDF("b", "mb"), "b")
    at = F.sequence(F.lit(1), F.lit(HASHES))
    agree = F.aggregate(at, F.lit(0), lambda n, i: n + F.when(F.substr("ma", i, F.lit(1)) == F.substr("mb", i, F.lit(1)), 1).otherwise(0))
    return both.where(agree >= AGREE).select("a", "b").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make():
        hasher, kept = Hasher(), {}

        def of(key, text):
            """The set of a text; pivots come again and again, so their sets are kept for a while."""
            if (got := kept.get(key)) is None or got[0] != text:
                if len(kept) > 500:
                    kept.clear()
                got = kept[key] = (text, shingles(text, hasher, shingle))
            return got[1]

        def work(cols):
            out = []
            for a, b, ta, tb in zip(*cols, strict=True):
                x, y = of(a, ta), shingles(tb, hasher, shingle)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b))
            return [list(c) for c in zip(*out, strict=True)] if out else [[], []]

        return work

    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    return map_rows(both, make, "a bigint, b bigint", arrow).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids of the edges (a, b): the least id each can reach.

    Alternating large-star and small-star; ends when a round leaves the edges as they were."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            sides = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
            out = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(e)
    while before[0]:
        e = checkpoint(star(star(e, True), False))
        now = state(e)
        if now == before:
            break
        before = now
    ids = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _open_keys(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, id, c) of the keys that hold documents of several components."""
    named = members.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    several = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return named.join(several, "key")


def groups(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id and kept of every document."""
    docs = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    sketches = checkpoint(_sketches(docs, shingle))
    full = sketches.where("digest is not null and id is not null")
    first = full.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = full.select("digest", "id").join(first.where("copies > 1"), "digest").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    copies = checkpoint(copies.distinct())
    reps = full.join(first.select(F.col("digest"), F.col("rep").alias("id")), ["digest", "id"], "left_semi").select("id", "minima", "keys").distinct()
    everyone = reps.select("id", F.explode("keys").alias("key"))
    pivots = checkpoint(everyone.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("most")).where("pivot < most").select("key", "pivot"))
    # keys of one document alone are gone from here on, and so are documents that have only such
    members = checkpoint(narrowed(everyone, "key", pivots).join(pivots, "key").select("key", "id", "pivot").distinct())
    ids = checkpoint(members.select("id").distinct())
    sk = checkpoint(narrowed(reps.select("id", "minima"), "id", ids).join(ids, "id", "left_semi"))
    texts = checkpoint(narrowed(docs, "id", ids).join(ids, "id", "left_semi"))

    def confirmed(pairs: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(links, all pairs compared so far); no pair is compared twice."""
        near = _agreeing(pairs, sk)
        near = checkpoint(near if before is None else near.join(before, ["a", "b"], "left_anti"))
        return checkpoint(_linked(near, texts, shingle, percent)), near if before is None else checkpoint(before.unionByName(near))

    edges, compared = confirmed(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), None)
    comp = checkpoint(components(edges.unionByName(copies)))
    n, tried = 2, checkpoint(members.select("key", F.col("pivot").alias("id")).distinct())
    while True:
        left = checkpoint(_open_keys(members.select("key", "id"), comp))
        if left.isEmpty():
            break
        # the next n documents of each open key, in order of id, that were no pivots of it
        fresh = left.join(tried, ["key", "id"], "left_anti")
        chosen = checkpoint(_next(fresh, n))
        if chosen.isEmpty():
            break
        pairs = chosen.select("key", F.col("id").alias("p"), F.col("c").alias("pc")).join(left, "key").where("pc <> c and p <> id")
        pairs = pairs.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
        new, compared = confirmed(pairs, compared)
        if not new.isEmpty():
            edges = checkpoint(edges.unionByName(new).distinct())
            comp = checkpoint(components(edges.unionByName(copies)))
        tried = checkpoint(tried.unionByName(chosen.select("key", "id")))
        n *= 4
    out = sketches.select("id", "n").join(comp, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _next(fresh: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    return fresh.withColumn("r", row).where(F.col("r") <= n).drop("r")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of every group, that of the smallest id.

    Rows that share an id and have the same words are copies, and one stays: the one of the least text, then of the least hash of
    all its columns.  Rows of other texts under one id are one document of several texts and stay together, or go together.
    Rows without an id stay.  No text is shuffled but those of rows that go, of rows that share an id, and of a few that a bitmap can't tell from them."""
    found = checkpoint(groups(docs, key, text, **how).select(F.col(key).alias("id"), "kept"))
    kept = without(docs, quoted(key).cast("bigint"), found.where("not kept and id is not null").select("id").distinct())
    twice = checkpoint(found.where("kept and id is not null").groupBy("id").count().where("count > 1").select("id"))
    if twice.isEmpty():
        return kept
    from pyspark.sql import Window

    names = [f"c{i}" for i in range(len(docs.columns))]
    k, t = (names[docs.columns.index(x)] for x in (key, text))
    rows = narrowed(docs.toDF(*names).withColumn("_id", F.col(k).cast("bigint")), "_id", twice).join(twice.toDF("_id"), "_id", "left_semi")
    words = F.regexp_replace(F.translate(F.coalesce(F.col(t), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")
    order = Window.partitionBy("_id", F.sha2(F.trim(words).cast("binary"), 256)).orderBy(t, F.xxhash64(*(c for c, (_, kind) in zip(names, docs.dtypes, strict=True) if "map<" not in kind)))
    one = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*names).toDF(*docs.columns)
    single = without(kept, quoted(key).cast("bigint"), twice)
    return single.union(one)
