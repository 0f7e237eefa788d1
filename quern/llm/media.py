"""Motion-JPEG in AVI: write, index, decode, and cut into shots.

A payload is stored as 16 x 12 grey frames, each a lossless JPEG (SOF3, predictor 1),
in a RIFF AVI file with an idx1 index.  A difference of 8-bit samples needs a category
of 0 to 8 and as many extra bits.  The Huffman table gives category s a code of 9 - s
bits, so every sample takes nine bits and a frame's scan is 216 whole bytes; whole files
can then be packed and unpacked as arrays.  The reader takes the tables and sizes from the file,
and falls back to bit-serial decoding where codes and extra bits don't add up to one width.

Shots end where the histogram of a frame differs from the one before by more than the
neighbourhood's mean plus ``k`` standard deviations (and at least ``floor``).

Defined results: a null text is an empty one; an empty payload is padded to one frame of spaces;
files that are no AVI, or have no index, raise ValueError in ``parse_avi`` and give no clips in
``clips``.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

WIDTH, HEIGHT, FPS = 16, 12, 25
FRAME = WIDTH * HEIGHT
CATEGORIES = 9
UNIT = 9  # bits a sample
Shot = tuple[int, int]
Code = tuple[int, int]


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical as in ITU-T T.81, annex C."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code += 1
            at += 1
        code <<= 1
    return out


#: One category for each code length 1..9: category 8 has one bit, category 0 nine.
_COUNTS, _SYMBOLS = [1] * 9 + [0] * 7, list(range(8, -1, -1))


def _difference_table() -> np.ndarray:
    """Nine bits for each difference of -255..255, at difference + 255."""
    codes, table = _codes(_COUNTS, _SYMBOLS), np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        table[d + 255] = codes[s][0] << s | extra
    return table


_TABLE = _difference_table()
_HEAD = (
    b"\xff\xd8"
    + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, HEIGHT, WIDTH, 1) + b"\x01\x11\x00"
    + b"\xff\xc4" + struct.pack(">HB", 19 + CATEGORIES, 0) + bytes(_COUNTS) + bytes(_SYMBOLS)
    + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x01\x00\x00"
)


def pad(data: bytes) -> bytes:
    """data and as many spaces as make a positive multiple of a frame."""
    return data + b" " * ((-len(data)) % FRAME if data else FRAME)


def _differences(frames: np.ndarray) -> np.ndarray:
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    return d


def _scans(payload: bytes) -> np.ndarray:
    """(frames, 216) bytes of entropy-coded samples, before stuffing."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH)
    words = _TABLE[_differences(frames).reshape(len(frames), FRAME) + 255].astype(np.uint32)
    # eight samples are nine bytes
    w = words.reshape(len(frames), FRAME // 8, 8)
    out = np.empty((len(frames), FRAME // 8, 9), np.uint8)
    for i in range(9):
        high, low = (w[:, :, i - 1] << (8 - i) if i else 0), (w[:, :, i] >> (i + 1) if i < 8 else 0)
        out[:, :, i] = (high | low) & 255
    return out.reshape(len(frames), -1)


def encode_avi(payload: bytes) -> bytes:
    """An AVI file that holds payload, a positive multiple of 192 bytes, without loss."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    chunks, index, at = [], [], 4
    for scan in _scans(payload):
        jpeg = _HEAD + scan.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        chunks.append(b"00dc" + struct.pack("<I", len(jpeg)) + jpeg + b"\x00" * (len(jpeg) & 1))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        at += len(chunks[-1])
    n, largest = len(chunks), max(map(len, chunks))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index)))


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, the JPEG frames in the order of the index)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("this is no AVI file")
    fps, movi, index, at = float(FPS), None, None, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / max(1, struct.unpack_from("<I", data, at + 20)[0])
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("the AVI file has no index")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            start = movi + offset + 8
            frames.append(data[start : start + size])
    return fps, frames


def _segments(jpeg: bytes) -> tuple[int, int, dict[int, Code], int, int]:
    """Height, width, codes, predictor and the scan's start."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("this is no JPEG frame")
    at, height, width, codes = 2, 0, 0, {}
    while True:
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if mark == 0xC3:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or n != 1:
                raise ValueError("only 8-bit grey frames are stored here")
        elif mark == 0xC4:
            codes = _codes(list(body[1:17]), list(body[17:]))
        elif mark == 0xDA:
            return height, width, codes, body[3], at + 2 + size
        elif 0xC0 <= mark <= 0xCF:
            raise ValueError("only lossless frames are stored here")
        at += 2 + size


def _value(s: int, extra: int) -> int:
    return extra if s and extra >> (s - 1) else extra - (1 << s) + 1 if s else 0


def _serial(scan: bytes, n: int, codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """Differences of one scan, read bit by bit: the way for any table."""
    back = {(length, code): s for s, (code, length) in codes.items()}
    bits, at, out = "".join(f"{b:08b}" for b in scan), 0, []
    while len(out) < n:
        code = length = 0
        while (length, code) not in back:
            code, length = code << 1 | (bits[at] == "1"), length + 1
            at += 1
        s = back[length, code]
        out.append(_value(s, int(bits[at : at + s] or "0", 2)))
        at += s
    return np.array(out, np.int32)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(frames, height, width) samples of the frames of one stream."""
    if not frames:
        return np.zeros((0, HEIGHT, WIDTH), np.uint8)
    height, width, codes, predictor, start = _segments(frames[0])
    if predictor != 1:
        raise ValueError("only predictor 1 is stored here")
    head, n = frames[0][:start], height * width
    scans = []
    for f in frames:
        if f[:start] != head:
            return np.concatenate([decode_frames([x]) for x in frames])
        scans.append(f[start:-2].replace(b"\xff\x00", b"\xff"))
    widths = {length + s for s, (_, length) in codes.items()}
    if widths == {UNIT} and n % 8 == 0 and all(len(s) == n * UNIT // 8 for s in scans):
        table = np.zeros(1 << UNIT, np.int32)
        for s, (code, _) in codes.items():
            for extra in range(1 << s):
                table[code << s | extra] = _value(s, extra)
        raw = np.frombuffer(b"".join(scans), np.uint8).reshape(len(scans), n // 8, 9).astype(np.uint16)
        words = np.empty((len(scans), n // 8, 8), np.uint16)
        for i in range(8):
            words[:, :, i] = (raw[:, :, i] << (i + 1) | raw[:, :, i + 1] >> (7 - i)) & 511
        d = table[words.reshape(len(scans), height, width)]
    else:
        d = np.stack([_serial(s, n, codes) for s in scans]).reshape(len(scans), height, width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFF).astype(np.uint8)


def differences(frames: np.ndarray, bins: int = 16) -> np.ndarray:
    """Histogram difference (0 to 1) of each frame to the one before; 0 for the first."""
    n = len(frames)
    if not n:
        return np.zeros(0)
    flat = frames.reshape(n, -1)
    at = (flat.astype(np.int64) * bins >> 8) + np.arange(n)[:, None] * bins
    h = np.bincount(at.ravel(), minlength=n * bins).reshape(n, bins)
    out = np.zeros(n)
    out[1:] = np.abs(h[1:] - h[:-1]).sum(axis=1) / (2.0 * flat.shape[1])
    return out


def shots(diff: np.ndarray, window: int = 12, k: float = 2.5, floor: float = 0.15) -> list[Shot]:
    """(first frame, end) of each shot; the threshold follows the differences around each frame."""
    n = len(diff)
    if not n:
        return []
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (diff, diff * diff))
    i = np.arange(n)
    lo, hi = np.maximum(1, i - window), np.minimum(n, i + window + 1)
    m = np.maximum(1, hi - lo - 1)  # the frame itself is left out
    mean = (sums[hi] - sums[np.minimum(lo, n)] - diff) / m
    dev = np.sqrt(np.maximum(0.0, (squares[hi] - squares[np.minimum(lo, n)] - diff * diff) / m - mean * mean))
    cut = np.flatnonzero((diff > np.maximum(floor, mean + k * dev)) & (i > 0))
    edges = [0, *cut.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``media`` (the AVI file) of every text."""
    types = dict(df.dtypes)
    arrow = pa.schema([pa.field(f"k{i}", pa.int64() if types[c] == "bigint" else pa.string()) for i, c in enumerate(keep)] + [pa.field("media", pa.binary())])
    cast = [F.col(c).cast("bigint" if types[c] == "bigint" else "string").alias(f"k{i}") for i, c in enumerate(keep)]

    def make():
        return lambda cols: [*cols[:-1], [encode_avi(pad((t or "").encode())) for t in cols[-1]]]

    schema = ", ".join(f"k{i} {'bigint' if types[c] == 'bigint' else 'string'}" for i, c in enumerate(keep)) + ", media binary"
    return map_rows(df.select(*cast, F.col(text).alias("t")), make, schema, arrow).toDF(*keep, "media")


def clips(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Timed clip rows: key, clip, first_frame, n_frames, start_s, end_s, mean_level.

    A null or broken file gives no row."""
    arrow = pa.schema([("key", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_level", pa.float64())])

    def make():
        def work(cols):
            rows = []
            for key, data in zip(*cols, strict=True):
                try:
                    fps, jpegs = parse_avi(data or b"")
                    frames = decode_frames(jpegs)
                except (ValueError, IndexError, struct.error):
                    continue
                for i, (a, b) in enumerate(shots(differences(frames))):
                    rows.append((key, i, a, b - a, a / fps, b / fps, float(frames[a:b].mean())))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in arrow]

        return work

    out = map_rows(df.select(F.col(key).cast("bigint").alias("key"), F.col(media).alias("m")), make, "key bigint, clip int, first_frame int, n_frames int, start_s double, end_s double, mean_level double", arrow)
    return out.withColumnRenamed("key", key)


def feature(frames: np.ndarray) -> str:
    """Frame count, mean level and clip bounds in frames, as one string."""
    spans = shots(differences(frames))
    return f"frames={len(frames)};level={int(frames.sum(dtype=np.int64)) // max(1, frames.size)};clips=" + ",".join(f"{a}-{b}" for a, b in spans)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest_row(text: str | None) -> tuple:
    raw = (text or "").encode()
    data = encode_avi(pad(raw))
    frames = decode_frames(parse_avi(data)[1])
    back = frames.tobytes()
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(frames)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, read it back, and return digests of both and the clips as a feature."""

    def make():
        return lambda cols: [cols[0], *map(list, zip(*map(_digest_row, cols[1]), strict=True))]

    return map_rows(df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("t")), make, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", _DIGEST)
