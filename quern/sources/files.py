"""Files in and out: Parquet, CSV, JSON lines, Arrow IPC, graph triples."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

UNSPECIFIED = "unspecified"
ARROW = (".arrow", ".arrows", ".ipc")


def read_relation(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A relation from a file or folder, by its ending: .parquet, .csv (with header), .json / .jsonl, .orc, .arrow / .arrows / .ipc."""
    end = Path(path.rstrip("/")).suffix.lower()
    if end in ARROW:
        return read_arrow(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    if end == ".csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if end in (".json", ".jsonl"):
        return reader.json(path)
    return reader.orc(path) if end == ".orc" else reader.parquet(path)


def local(path: str) -> str:
    """The path on this machine that a file: URI names, made absolute, as executors have working folders of their own."""
    scheme = urlsplit(path).scheme
    if scheme not in ("", "file"):
        raise ValueError(f"{path}: Arrow files are read and written in folders that all executors see as local ones, not at {scheme}:")
    return os.path.abspath(unquote(urlsplit(path).path) if scheme else path)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC, stream or file format.  The files are read on the executors, a batch at a time; the driver sees the schema only."""
    path = local(path)
    files = sorted(str(p) for p in Path(path).iterdir() if p.suffix in ARROW) if Path(path).is_dir() else [path]
    with _open_arrow(files[0]) as first:
        schema = first.schema

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name in part.column(0).to_pylist():
                with _open_arrow(name) as source:
                    batches = source if hasattr(source, "__iter__") else map(source.get_batch, range(source.num_record_batches))
                    yield from (pa.RecordBatch.from_arrays(b.columns, schema=b.schema) for b in batches)

    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files))
    return names.mapInArrow(read, from_arrow_schema(schema))


def _open_arrow(path: str):
    source = pa.memory_map(path)
    try:
        return pa.ipc.open_file(source)
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source)


def from_arrow(spark: SparkSession, table: pa.Table | pa.RecordBatch) -> DataFrame:
    """A relation from Arrow data that the driver holds."""
    return spark.createDataFrame(pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table)


def to_arrow(df: DataFrame) -> pa.Table:
    """A whole result as one Arrow table, for results known to fit on the driver."""
    return df.toArrow()


def write_arrow(df: DataFrame, folder: str) -> None:
    """One Arrow IPC stream file for each partition, written where the partition is; one file at least, which tells the schema."""
    folder = local(folder)
    Path(folder).mkdir(parents=True, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, out = 0, None
        at = Path(folder, f"part-{TaskContext.get().partitionId():05d}.arrows")
        draft = at.with_suffix(f".attempt{TaskContext.get().attemptNumber()}")
        for b in batches:
            out = out or pa.ipc.new_stream(str(draft), b.schema)
            out.write_batch(b)
            n += b.num_rows
        if out:
            out.close()
            draft.replace(at)  # a task that runs again writes the same file
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    if not any(p.suffix in ARROW for p in Path(folder).iterdir()):
        schema = df.limit(0).toArrow().schema
        pa.ipc.new_stream(str(Path(folder, "part-00000.arrows")), schema).close()


def write_relation(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write by ending: .csv, .json, .orc, .arrows or Parquet."""
    end = Path(path.rstrip("/")).suffix.lower()
    if end in ARROW:
        return write_arrow(df, path)
    writer = df.write.mode(mode)
    if end == ".csv":
        return writer.csv(path, header=True)
    if end in (".json", ".jsonl"):
        return writer.json(path)
    return writer.orc(path) if end == ".orc" else writer.parquet(path)


def read_triples(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """(subject, predicate, object, split, row_hash) of CSV with header, JSON lines or N-Triples.

    split is "unspecified" where it is missing; row_hash is the 64-bit FNV-1a hash of the four joined by bars."""
    form = form or {".csv": "csv", ".jsonl": "jsonl", ".json": "jsonl", ".nt": "nt"}.get(Path(path).suffix.lower())
    if form == "csv":
        df = spark.read.csv(path, header=True)
    elif form == "jsonl":
        df = spark.read.schema("subject string, predicate string, object string, split string").json(path)
    elif form == "nt":
        line = F.trim("value")
        pattern = r'^(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
        plain = lambda i: F.regexp_replace(F.regexp_extract(line, pattern, i), r"^<(.*)>$", "$1")
        rows = spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#")))
        df = rows.select(plain(1).alias("subject"), plain(2).alias("predicate"), plain(3).alias("object")).where("subject <> ''")
    else:
        raise ValueError(f"{path}: csv, jsonl or nt?")
    split = F.coalesce(F.nullif(F.trim("split"), F.lit("")), F.lit(UNSPECIFIED)) if "split" in df.columns else F.lit(UNSPECIFIED)
    return df.select("subject", "predicate", "object", split.alias("split")).withColumn("row_hash", fnv1a(F.concat_ws("|", "subject", "predicate", "object", "split")))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed bigint; integer arithmetic that wraps without raising."""
    codes = F.transform(F.sequence(F.lit(1), F.length(F.hex(text)), F.lit(2)), lambda i: F.conv(F.substr(F.hex(text), i, F.lit(2)), 16, 10).cast("bigint"))
    start = F.lit(-3750763034362895579)  # 14695981039346656037 mod 2^64
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        # x * 1099511628211 mod 2^64, where the prime is 2^40 + 435
        small = low(x) * 435
        high = (F.shiftrightunsigned(x, 32) * 435 + F.shiftrightunsigned(small, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        high = (high + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(high, 32).bitwiseOR(low(small))

    return F.when(F.length(text) > 0, F.aggregate(codes, start, step)).otherwise(start)


def histogram(triples: DataFrame, column: str) -> DataFrame:
    """(value, n) of predicate or split."""
    return triples.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def chunks(df: DataFrame, rows: int = 100_000) -> Iterator[list[Row]]:
    """A result in lists of at most so many rows; the driver holds one partition at a time."""
    out: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        out.append(row)
        if len(out) == rows:
            yield out
            out = []
    if out:
        yield out
