"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes that one Arrow batch may hold: a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Rows that are turned into Python objects at once.
SLICE_ROWS = 250


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; make one only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quoted(name: str) -> Column:
    """A column of any name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Of the bitmaps that are broadcast: 2 MB.
BITS = 1 << 24


def _marked(df: DataFrame, column: Column, wanted: DataFrame, how: str) -> DataFrame:
    """(_all, _h, _map): df's rows as structs, with the hash of a column and the part of the bitmap of wanted it falls into.

    What is broadcast is a bitmap of hashes: BITS bits in rows of 4 KB, however many rows wanted has."""
    h = F.pmod(F.xxhash64(F.col(wanted.columns[0])), F.lit(BITS))
    rows = wanted.select(h.alias("_h")).select(F.expr("_h div 32768").alias("_row"), (F.col("_h") % 32768).alias("_bit"))
    # numbers are shuffled, not a bitmap of every task
    marks = rows.repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    out = df.select(F.struct(*map(quoted, df.columns)).alias("_all"), column.alias("_k"))
    out = out.select("_all", "_k", F.pmod(F.xxhash64("_k"), F.lit(BITS)).alias("_h")).withColumn("_row", F.expr("_h div 32768"))
    bit = F.col("_h") % 32768
    byte = F.conv(F.hex(F.substr("_map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = out.join(F.broadcast(marks), "_row", how).withColumn("_byte", byte)
    return out.withColumn("_hit", F.coalesce(F.expr("shiftright(_byte, CAST(_h % 8 AS INT)) & 1") == 1, F.lit(False)))


def narrowed(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """df without most rows whose column isn't in the one of wanted, before anything is shuffled; it loses none that is."""
    return _marked(df, quoted(column), wanted, "inner").where("_hit").select("_all.*")


def without(df: DataFrame, column: Column, gone: DataFrame) -> DataFrame:
    """df without the rows whose column is in the one of gone; nulls stay.

    Rows that the bitmap of gone turns away, nearly all that stay, aren't shuffled; only the others are compared with gone itself."""
    marked = _marked(df, column, gone, "left")
    sure = marked.where(~F.col("_hit")).select("_all.*")
    maybe = marked.where("_hit").join(gone.toDF("_k"), "_k", "left_anti").select("_all.*")
    return sure.unionByName(maybe) if len(set(df.columns)) == len(df.columns) else sure.union(maybe)


#: What Python workers keep between tasks, by operator.
_HELD: dict[tuple, object] = {}


def held(owner: str, key: tuple, build: Callable[[], object]) -> object:
    """An object that a worker keeps between tasks of one operator, until another's run in it."""
    if (owner, key) not in _HELD:
        _HELD[owner, key] = build()
    return _HELD[owner, key]


def drop_others(owner: str) -> None:
    for k in [k for k in _HELD if k[0] != owner]:
        del _HELD[k]


def release() -> None:
    """Give memory that a task has freed back to the system, for whatever runs in the worker next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # a C library without it
            pass


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: str | StructType, arrow: pa.Schema, slice_rows: int = SLICE_ROWS, owner: str = "") -> DataFrame:
    """Apply a function of columns (lists, one slice of rows at a time) on the executors.

    Columns are passed by position, so their names may be any.  ``make`` is called once per task and returns the function, so that models and
    tables are loaded once.  The output streams: one slice is in Python at a time.  ``owner`` names whose held objects stay.
    """
    bounded_batches(df.sparkSession)
    # workers find this package where the driver did, unless it is installed there
    top = Path(__file__).resolve().parents[2]
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        drop_others(owner)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                if work is None:
                    work = make()
                part = batch.slice(at, slice_rows)
                columns = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        work = None
        release()

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


