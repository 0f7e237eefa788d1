"""Byte-level BPE by DuckDB recursive queries, one small database in each Python worker.

Encoding: a text is split by the pattern, every piece separately.  A piece that is itself a
token is that token.  For the others, rows (word, position, token) start as single bytes and
join the merge table on neighbouring tokens; each step contracts the leftmost pair of minimum
rank of every word, until no pair is left.  Further pairs of that same rank are contracted in the same
step where this can't differ from one at a time: when no token of lower rank has the merged token
as its left or right part ("safe"), no new pair can come before them; overlapping ones
are taken alternately from the left.  So a very long word needs few steps.

Decoding: (text, position, token) rows join the vocabulary and are aggregated in order.

A word of more than ``LONG`` bytes is cut into windows of ``WINDOW`` bytes that overlap by ``OVERLAP``, which contract side by
side.  Where two neighbouring windows have a token in common (same start, same end), the tokens of the first up to it and
of the second from it on are joined.  That is exact: contraction is determined by ranks alone, so a sequence of tokens is a text's encoding if and only
if every two neighbours are the encoding of their own concatenation (up to the first contraction across a bound, the
tokens beside it contract as they would alone), and each two neighbours after joining stood together in an encoded window.
Windows without a common token become one, which contracts again.

Defined results: null or empty text has no tokens and decodes to no bytes; null ids
decode as empty; an id outside the vocabulary raises.  Repeated rows give repeated rows.
Memory: words are encoded ``CHUNK_BYTES`` at a time and ids decoded ``DECODE_TOKENS`` at a time, ``CACHE_WORDS`` encoded words are kept; DuckDB doesn't spill.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_rows

CHUNK_BYTES, CACHE_WORDS, DECODE_TOKENS, SLICE = 250_000, 200_000, 250_000, 600
#: Words of up to so many bytes are contracted one pair a step, which needs fewer operations a step.
SHORT = 48
LONG, WINDOW, OVERLAP = 2000, 320, 96
_SHIFT = 17  # bits of a token id within a pair

_ENCODE_SHORT = """
WITH RECURSIVE state(k, tok, fin) AS (
  SELECT k, tok, false FROM seed
  UNION ALL
  (WITH hit AS MATERIALIZED (
     SELECT p.k, p.nk, m.tok
     FROM (SELECT k, lead(k) OVER (ORDER BY k) AS nk, tok << 17 | lead(tok) OVER (ORDER BY k) AS pair FROM state WHERE NOT fin) p
     JOIN merges m ON m.pair = p.pair WHERE p.nk >> 32 = p.k >> 32),
   best AS (SELECT k >> 32 AS w, min(tok << 32 | (k & 4294967295)) AS b, arg_min(nk, tok << 32 | (k & 4294967295)) AS nk FROM hit GROUP BY 1)
   SELECT c.k, CASE WHEN (b.b & 4294967295) = (c.k & 4294967295) THEN b.b >> 32 ELSE c.tok END, b.w IS NULL
   FROM (SELECT k, tok FROM state WHERE NOT fin) c LEFT JOIN best b ON b.w = c.k >> 32
   WHERE b.w IS NULL OR b.nk <> c.k)
) SELECT k, tok FROM state WHERE fin ORDER BY k
"""
_ENCODE = """
WITH RECURSIVE state(k, tok, fin) AS (
  SELECT k, tok, false FROM seed
  UNION ALL
  (WITH cur AS (SELECT k, tok FROM state WHERE NOT fin),
   pairs AS (SELECT k, lead(k) OVER (ORDER BY k) AS nk, tok << 17 | lead(tok) OVER (ORDER BY k) AS pair FROM cur),
   hit AS (SELECT p.k, p.nk, m.tok, m.safe FROM pairs p JOIN merges m ON m.pair = p.pair WHERE p.nk >> 32 = p.k >> 32),
   best AS (SELECT k >> 32 AS w, min(tok << 32 | (k & 4294967295)) AS b FROM hit GROUP BY 1),
   todo AS (SELECT h.k, h.nk, h.tok FROM hit h JOIN best b ON b.w = h.k >> 32 AND h.tok = b.b >> 32
            WHERE h.safe OR (h.k & 4294967295) = (b.b & 4294967295)),
   runs AS (SELECT k, nk, tok, sum(start) OVER (ORDER BY k) AS run
            FROM (SELECT *, CASE WHEN lag(nk) OVER (ORDER BY k) = k THEN 0 ELSE 1 END AS start FROM todo)),
   picked AS (SELECT k, nk, tok FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) AS i FROM runs) WHERE i % 2 = 1)
   SELECT c.k, coalesce(p.tok, c.tok), b.w IS NULL
   FROM cur c LEFT JOIN best b ON b.w = c.k >> 32 LEFT JOIN picked p ON p.k = c.k
   WHERE NOT EXISTS (SELECT 1 FROM picked d WHERE d.nk = c.k))
) SELECT k, tok FROM state WHERE fin ORDER BY k
"""
_DECODE = """
SELECT i.doc, string_agg(v.piece, '' ORDER BY i.pos) AS piece
FROM ids i JOIN vocabulary v ON v.tok = i.tok GROUP BY i.doc
"""


def parsed(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "128MB", "temp_directory": ""})
        left, right, token, unsafe = [], [], [], set()
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), token.append(rank)
                    unsafe.update(x for x in (a, b) if x > rank)
        pair = np.array(left, np.int64) << _SHIFT | np.array(right, np.int64)
        self._table("merges", pair=pair, tok=np.array(token, np.int64), safe=np.array([t not in unsafe for t in token], bool))
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self._table("vocabulary", tok=np.array([r for _, r in tokens], np.int64), piece=[p.decode("latin-1") for p, _ in tokens])
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = [len(p) for p in self.ranks]
        self.byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the rank file lacks single bytes")
        self.known = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known[list(self.ranks.values())] = True
        #: Encoded words: those of late, and those of the generation before.
        self.cache: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _table(self, name: str, **columns) -> None:
        self.db.register("_given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _given")
        self.db.unregister("_given")

    def _query(self, sql: str, given: str, **columns) -> pa.Table:
        self.db.register(given, pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(given)

    def _contract(self, words: list[bytes], sql: str) -> list[list[int]]:
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        key = np.repeat(np.arange(len(words), dtype=np.int64) << 32, lengths) | (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths))
        out = self._query(sql, "seed", k=key, tok=self.byte[np.frombuffer(b"".join(words), np.uint8)])
        tokens = out["tok"].to_numpy().tolist()
        cuts = np.searchsorted(out["k"].to_numpy() >> 32, np.arange(len(words) + 1)).tolist()
        return [tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, words: set[str]) -> None:
        """Put the ids of words, joined by commas, into the cache."""
        for sql, fits in ((_ENCODE_SHORT, lambda n: n <= SHORT), (_ENCODE, lambda n: n > SHORT)):
            pending, size = [], 0
            for word in words:
                raw = word.encode()
                if not fits(len(raw)) or len(raw) > LONG:
                    continue
                if (whole := self.ranks.get(raw)) is not None:
                    self.cache[word] = str(whole)
                    continue
                pending.append((word, raw))
                size += len(raw)
                if size >= CHUNK_BYTES:
                    self._flush(pending, sql)
                    pending, size = [], 0
            if pending:
                self._flush(pending, sql)

    def _flush(self, pending: list[tuple[str, bytes]], sql: str) -> None:
        found = self._contract([raw for _, raw in pending], sql)
        self.cache.update((w, ",".join(map(str, x))) for (w, _), x in zip(pending, found, strict=True))

    def _windows(self, parts: list[bytes]) -> dict[bytes, list[int]]:
        """The encodings of different byte strings, in chunks of bounded size."""
        out: dict[bytes, list[int]] = {}
        for short in (True, False):
            chosen = [p for p in dict.fromkeys(parts) if (len(p) <= WINDOW) == short]
            at = 0
            while at < len(chosen):
                end, size = at, 0
                while end < len(chosen) and (end == at or size + len(chosen[end]) <= CHUNK_BYTES):
                    size += len(chosen[end])
                    end += 1
                out.update(zip(chosen[at:end], self._contract(chosen[at:end], _ENCODE_SHORT if short else _ENCODE), strict=True))
                at = end
        return out

    def encode_long(self, raw: bytes) -> np.ndarray:
        """The ids of a long word, from overlapping windows."""
        if (whole := self.ranks.get(raw)) is not None:
            return np.array([whole], np.int64)
        spans = [(a, min(len(raw), a + WINDOW)) for a in range(0, max(1, len(raw) - OVERLAP), WINDOW - OVERLAP)]
        known = self._windows([raw[a:b] for a, b in spans])
        while True:
            out: list[np.ndarray] = []
            merged: list[tuple[int, int]] = []
            begin = 0  # where the part of the window at hand that is still needed begins
            for n, (a, b) in enumerate(spans):
                ids = np.array(known[raw[a:b]], np.int64)
                starts = a + np.concatenate([[0], np.cumsum(self.sizes[ids])])
                keep = starts[:-1] >= begin
                common = None
                if n + 1 < len(spans):
                    na, nb = spans[n + 1]
                    other = na + np.concatenate([[0], np.cumsum(self.sizes[np.array(known[raw[na:nb]], np.int64)])])
                    _, i, j = np.intersect1d(starts[:-1], other[:-1], return_indices=True)
                    same = (starts[i + 1] == other[j + 1]) & (starts[i] >= begin)
                    common = int(starts[i[same][same.sum() // 2]]) if same.any() else None
                    if common is None:
                        merged.append((n, n + 1))
                    else:
                        keep &= starts[:-1] < common
                out.append(ids[keep])
                if common is not None:
                    begin = common
            if not merged:
                return np.concatenate(out)
            joined, skip = [], {j for _, j in merged}
            for n, (a, b) in enumerate(spans):
                if n in skip:
                    joined[-1] = (joined[-1][0], b)
                else:
                    joined.append((a, b))
            fresh = [raw[a:b] for a, b in joined if raw[a:b] not in known]
            known |= self._windows(fresh)
            spans = joined

    def encode_joined(self, texts: list[str | None]) -> list[str]:
        """The ids of every text, in decimal, joined by commas."""
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS // 2:
            self.old, self.cache = self.cache, {}
        new = set().union(*pieces)
        new.difference_update(self.cache)
        again = new & self.old.keys()
        self.cache.update((w, self.old[w]) for w in again)
        new -= again
        long = {w for w in new if len(w) > LONG // 4 and len(w.encode()) > LONG}
        self._learn(new - long)
        if not long:
            return [",".join(map(self.cache.__getitem__, words)) for words in pieces]
        found = {w: ",".join(map(str, self.encode_long(w.encode()).tolist())) for w in long}  # not kept
        return [",".join([found[w] if w in found else self.cache[w] for w in words]) for words in pieces]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [parsed(x) for x in self.encode_joined(texts)]

    def decode(self, ids: list[list[int] | None]) -> list[bytes]:
        if any(x is not None and len(x) > DECODE_TOKENS for x in ids):  # one text at a time, in parts
            return [b"".join(self._decode([x[a : a + DECODE_TOKENS] for a in range(0, len(x), DECODE_TOKENS)])) if x is not None else b"" for x in ids]
        return self._decode(ids)

    def _decode(self, ids: list[list[int] | None]) -> list[bytes]:
        out, at, count = [b""] * len(ids), 0, [0 if x is None else len(x) for x in ids]
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size + count[end] <= DECODE_TOKENS):
                size += count[end]
                end += 1
            arrays = [np.asarray(x if x is not None else [], np.int64) for x in ids[at:end]]
            if size:
                flat, lengths = np.concatenate(arrays), [len(a) for a in arrays]
                if not self._known(flat):
                    raise ValueError("an id is outside the vocabulary")
                table = self._query(_DECODE, "ids", doc=np.repeat(np.arange(at, end), lengths), pos=np.arange(size), tok=flat)
                for doc, piece in zip(table["doc"].to_pylist(), table["piece"].to_pylist(), strict=True):
                    out[doc] = piece.encode("latin-1")
            at = end
        return out

    def _known(self, ids: np.ndarray) -> bool:
        return bool(ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all())


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec: made once a process, for all tasks of this operator that run in it."""
    return held("bpe", (path, pattern), lambda: Codec(path, pattern))


def _mapped(df: DataFrame, key: str, value: str, path: str, pattern: str, work: Callable, out: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    def make():
        own = codec(path, pattern)
        return lambda cols: [cols[0], *work(own, cols[1])]

    arrow = pa.schema([("key", pa.int64()), *((n, t) for n, _, t in out)])
    schema = "key bigint, " + ", ".join(f"{n} {s}" for n, s, _ in out)
    return map_rows(df.select(F.col(key).cast("bigint").alias("key"), F.col(value).alias("value")), make, schema, arrow, slice_rows=SLICE, owner="bpe").withColumnRenamed("key", key)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and ids of every text."""

    def work(own, texts):
        ids = own.encode(texts)
        return [list(map(len, ids)), ids]

    return _mapped(df, key, text, path, pattern, work, [("n_tokens", "bigint", pa.int64()), ("ids", "array<int>", pa.list_(pa.int32()))])


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and bytes of every array of ids."""
    return _mapped(df, key, ids, path, pattern, lambda own, x: [own.decode(x)], [("bytes", "binary", pa.binary())])


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return digests of both."""

    def work(own, texts):
        joined = own.encode_joined(texts)
        ids = [parsed(x) for x in joined]
        back = own.decode(ids)
        return [list(map(len, ids)), [hashlib.sha256(x.encode()).hexdigest() for x in joined], [hashlib.sha256(b).hexdigest() for b in back]]

    return _mapped(df, key, text, path, pattern, work, [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())])


def encoded(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids, and whether the ids decode to the text's bytes, of every text."""

    def work(own, texts):
        ids = own.encode(texts)
        same = [b == (t or "").encode() for b, t in zip(own.decode(ids), texts, strict=True)]
        return [list(map(len, ids)), ids, same]

    return _mapped(df, key, text, path, pattern, work, [("n_tokens", "bigint", pa.int64()), ("ids", "array<int>", pa.list_(pa.int32())), ("round_trip", "boolean", pa.bool_())])
