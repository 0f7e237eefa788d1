"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased.  A document and a benchmark item that share a seed
(``seed`` = 5 words in a row) are compared: the longest unmarked common run of at least ``seed`` words is
marked as a tile in both, again and again, found by a running Karp-Rabin hash of falling length; tiles don't
overlap, and may come in any order, so reordered passages are caught.  An item of n words is
contaminated where the tiles cover at least ``coverage`` of it.  Items of fewer than ``seed`` words are
sought as one run.

1. The items' seeds are rows; a bitmap of their hashes, of fixed size (2 or 16 MB), goes to the executors.
2. One scan of the documents keeps of each the words near runs that the bitmap knows; nearly all have none.
3. These runs join the seeds (hash keys, salted for passages that many documents hold), which gives the pairs of document and item
   that share one; pairs whose number of shared seeds can't cover enough are left out.
4. Each pair is tiled.  Only the words near shared seeds are compared, which loses nothing: a tile consists of seeds.

The benchmark may be of any size; nothing of it is collected but the bitmap, and no document or pair is dropped.

Defined results: null or empty texts share nothing; an empty benchmark gives no rows; repeated items or
documents give repeated rows; ties between tiles go to the leftmost in the document, then in the item.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, quoted, without

SEED, COVERAGE = 5, 0.6
#: Marks of the bitmap that goes to the executors, the lesser while the seeds are few; keys over which one seed's rows are spread.
SMALL_BITS, BITS, SALTS = 1 << 24, 1 << 27, 8
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
Tile = tuple[int, int, int]


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Hasher(dict):
    """word -> 64-bit hash; forgets all words when it holds too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h

    def array(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2^64) of all runs of n words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _BASE + h[i : i + m]
    return out ^ (out >> np.uint64(29))


def tile(doc: list, item: list, least: int) -> list[Tile]:
    """Greedy tiles (at in doc, at in item, length) of two sequences of hashes, longest first."""
    unmarked_d, unmarked_i = [True] * len(doc), [True] * len(item)
    tiles: list[Tile] = []
    length = min(len(doc), len(item))
    base, mask = int(_BASE), (1 << 64) - 1

    def rolling(seq, free, n):
        """(start, hash) of every run of n unmarked words."""
        top = pow(base, n - 1, 1 << 64)
        h = have = 0
        for j, x in enumerate(seq):
            if not free[j]:
                h = have = 0
                continue
            if have == n:
                h = (h - seq[j - n] * top) & mask
                have -= 1
            h = (h * base + x) & mask
            have += 1
            if have == n:
                yield j - n + 1, h

    def longest(n):
        """Whether any unmarked run of n words is common, as hashes tell."""
        there = {h for _, h in rolling(item, unmarked_i, n)}
        return bool(there) and any(h in there for _, h in rolling(doc, unmarked_d, n))

    while length >= least:
        # the greatest common length, by bisection: a common run of n words holds one of n - 1
        low, high = least - 1, length
        while low < high:
            mid = (low + high + 1) // 2
            if longest(mid):
                low = mid
            else:
                high = mid - 1
        if low < least:
            break
        length = low
        at = defaultdict(list)
        for j, h in rolling(item, unmarked_i, length):
            at[h].append(j)
        for d, h in list(rolling(doc, unmarked_d, length)):
            for j in at.get(h, ()):
                if all(unmarked_d[d : d + length]) and all(unmarked_i[j : j + length]) and doc[d : d + length] == item[j : j + length]:
                    tiles.append((d, j, length))
                    unmarked_d[d : d + length] = [False] * length
                    unmarked_i[j : j + length] = [False] * length
                    break
        length -= 1
    return tiles


def seeds_of(h: np.ndarray, seed: int) -> np.ndarray:
    """The hashes of an item's runs of ``seed`` words; of all its words if it has fewer."""
    return runs(h, min(seed, len(h)))


_HITS = "key bigint, digest string, at array<int>, words array<bigint>, places array<int>, hashes array<bigint>, lengths array<int>"
_OUT = "key bigint, digest string, item_id bigint, covered bigint, n_words bigint, n_tiles bigint, longest bigint"
_SQL_TYPES = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "int": pa.int32()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _SQL_TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _items(benchmark: DataFrame, item: str, text: str, seed: int) -> DataFrame:
    """(n, item_id, words, seeds): every item with words, by a number of its own."""
    schema = "item_id bigint, words array<bigint>, seeds array<bigint>"

    def make():
        hasher = Hasher()

        def work(cols):
            rows = []
            for name, said in zip(*cols, strict=True):
                if ws := words(said):
                    h = hasher.array(ws)
                    rows.append((name, h.view(np.int64), np.unique(seeds_of(h, seed)).view(np.int64)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]

        return work

    rows = map_rows(benchmark.select(quoted(item).cast("bigint").alias("i"), quoted(text).alias("t")), make, schema, _arrow(schema))
    return checkpoint(rows).withColumn("n", F.monotonically_increasing_id())


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """bits marks, one for each low part of a seed's hash; they come to the driver in rows of 4 KB, at most bits / 8 bytes."""
    rows = seeds.select(F.pmod("seed", F.lit(bits)).alias("h")).select(F.expr("h div 32768").alias("row"), (F.col("h") % 32768).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.repartition("row").groupBy("row").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
        out[r.row * 4096 : (r.row + 1) * 4096] = np.frombuffer(r.map, np.uint8)
    return out


def _hits(docs: DataFrame, key: str, text: str, bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """The documents with runs that the bitmap knows: the words such runs cover (at, words), and the runs (places, hashes, lengths)."""
    mask = np.uint64(len(bitmap) * 8 - 1)

    def make():
        hasher = Hasher()

        def work(cols):
            rows = []
            for name, digest, said in zip(*cols, strict=True):
                if not said or not (ws := words(said)):
                    continue
                h, found, covered = hasher.array(ws), [], np.zeros(len(ws), bool)
                for n in lengths:
                    r = runs(h, n)
                    low = r & mask
                    at = np.flatnonzero(bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        found.append((at, r[at], np.full(len(at), n)))
                        for k in range(n):
                            covered[at + k] = True
                if found:
                    at = np.flatnonzero(covered)
                    places, hashes, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
                    rows.append((name, digest, at.astype(np.int32), h[at].view(np.int64), places.astype(np.int32), hashes.view(np.int64), sizes.astype(np.int32)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(7)]

        return work

    rows = docs.select(quoted(key).cast("bigint").alias("k"), _digest(key, text).alias("d"), quoted(text).alias("t"))
    return map_rows(rows, make, _HITS, _arrow(_HITS))


def _digest(key: str, text: str) -> Column:
    """A row's id and text in one; null where the text is, which no item matches."""
    return F.sha2(F.concat(F.coalesce(quoted(key).cast("bigint").cast("string"), F.lit("-")), F.lit(" "), quoted(text)).cast("binary"), 256)


def _tiled(pairs: DataFrame, seed: int, coverage: float) -> DataFrame:
    """The contaminated ones of pairs of a document's hits and an item."""
    def make():
        def work(cols):
            rows = []
            for key, digest, at, ws, places, hashes, sizes, item, its, its_seeds in zip(*cols, strict=True):
                size, wanted = len(its), set(its_seeds)
                n = min(seed, size)
                near = {p + k for p, x, m in zip(places, hashes, sizes, strict=True) if m == n and x in wanted for k in range(n)}
                if len(near) < coverage * size:
                    continue  # tiles lie within these positions
                doc, last = [], -2
                for p, h in zip(at, ws, strict=True):
                    if p in near:
                        if p != last + 1 and doc:
                            doc.append(None)  # no word: runs don't cross a gap
                        doc.append(h)
                        last = p
                tiles = tile(_numbered(doc, its), its, min(seed, size))
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * size:
                    rows.append((key, digest, item, covered, size, len(tiles), max(t[2] for t in tiles)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(7)]

        return work

    return map_rows(pairs.select("key", "digest", "at", "words", "places", "hashes", "lengths", "item_id", "its", "seeds"), make, _OUT, _arrow(_OUT))


def _numbered(doc: list[int | None], item: list[int]) -> list[int]:
    """doc with its gaps as a number that the item hasn't."""
    gap = max(item) + 1
    return [gap if x is None else x for x in doc]


def _found(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, seed: int, coverage: float) -> DataFrame:
    """One row of _OUT for each contaminated pair of rows."""
    items = _items(benchmark, item, item_text, seed)
    seeds = checkpoint(items.select("n", F.explode("seeds").alias("seed"), F.least(F.size("words"), F.lit(seed)).alias("length")))
    lengths = sorted(r[0] for r in seeds.select("length").distinct().collect())  # at most ``seed`` of them
    bits = SMALL_BITS if seeds.count() * 8 <= SMALL_BITS else BITS
    hits = checkpoint(_hits(docs, key, text, _bitmap(seeds, bits), lengths)).withColumn("doc", F.monotonically_increasing_id())
    runs_ = hits.select("doc", F.explode(F.array_distinct("hashes")).alias("seed"), F.pmod("doc", F.lit(SALTS)).alias("salt"))
    spread = seeds.select("n", "seed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    shared = runs_.join(spread, ["seed", "salt"]).groupBy("doc", "n").agg(F.count(F.lit(1)).alias("shared"))
    given = items.select("n", "item_id", F.col("words").alias("its"), "seeds")
    n = F.least(F.size("its"), F.lit(seed))
    # k different seeds, none of which the item repeats, cover at most k * seed of its words
    enough = (F.col("shared") * n >= coverage * F.size("its")) | (F.size("seeds") < F.size("its") - n + 1)
    pairs = shared.join(given, "n").where(enough).join(hits, "doc")
    return _tiled(pairs, seed, coverage)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """One row for each contaminated pair: key, item_id, covered, n_words, n_tiles, longest, coverage."""
    out = _found(docs, benchmark, key, text, item, item_text, seed, coverage).drop("digest")
    return out.withColumn("coverage", F.col("covered") / F.col("n_words")).withColumnRenamed("key", key)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """docs without the contaminated rows, whatever their ids: a row goes for its own text only, also where its id is null or not its alone."""
    hit = checkpoint(_found(docs, benchmark, key, text, item, item_text, seed, coverage).select("digest").distinct())
    return without(docs, _digest(key, text), hit)
