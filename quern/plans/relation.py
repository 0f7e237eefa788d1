"""Relations: DataFrames of columns c0, c1, ... with logical types.

A relation without columns has one hidden column and a row where it is true."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import QuernError, TypeMismatch
from ..functions.types import of_spark, spark_type

UNIT = "u"
#: Of a hash table that a task builds, at most.
HASHED_BYTES = 32 << 20


def names(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)] or [UNIT]


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    types: tuple[str, ...]
    rows: int | None = None  # where it was counted
    bag: DataFrame | None = None  # the same rows in the order they are read, some perhaps repeated

    @property
    def rows_of(self) -> DataFrame:
        """The rows, some perhaps repeated, without the shuffle that makes them distinct."""
        return self.df if self.bag is None else self.bag

    def distinct(self) -> Relation:
        return Relation(self.df.distinct(), self.types)


def arity(df: DataFrame) -> int:
    """Columns of an input; one that has only the hidden column is a truth value."""
    return 0 if df.columns == [UNIT] else len(df.columns)


def given(df: DataFrame, types: tuple[str, ...] | None = None) -> Relation:
    """An input DataFrame as a relation; nulls have no meaning in programs, callers leave them out."""
    if not arity(df):
        return Relation(df.select(F.lit(1).alias(UNIT)), ())
    kinds = tuple(of_spark(t) for _, t in df.dtypes)
    if types is not None and len(types) != len(kinds):
        raise TypeMismatch(f"an input has {len(kinds)} columns, its declaration {len(types)}")
    to = types or kinds
    cols = [F.col(f"`{c}`").cast(spark_type(t)).alias(f"c{i}") for i, (c, t) in enumerate(zip(df.columns, to, strict=True))]
    return Relation(df.select(*cols) if cols else df.select(F.lit(1).alias(UNIT)), to)


def empty(spark: SparkSession, types: tuple[str, ...]) -> Relation:
    schema = ", ".join(f"{n} {spark_type(t)}" for n, t in zip(names(len(types)), types or ("i32",), strict=True))
    return Relation(spark.createDataFrame([], schema), types)


def unit(spark: SparkSession) -> DataFrame:
    """The one row that joins with everything."""
    return spark.range(1).select(F.lit(1).alias(UNIT))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names; make one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise QuernError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint and its number of rows, from one job."""
    seen = Observation()
    out = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, int(seen.get["n"])


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """As counted, in Parquet files in the checkpoint folder, a fifth of a checkpoint's bytes; how rows are partitioned is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    at = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), int(seen.get["n"])


def written(rel: Relation) -> Relation:
    """The relation, written once if reading it is more than a scan of files or of a checkpoint."""
    plan = rel.df._jdf.queryExecution().optimizedPlan().toString()
    if not any(x in plan for x in ("Join", "Aggregate", "Window", "Generate", "Sort", "Distinct")):
        return rel
    df, n = counted(rel.df)
    return Relation(df, rel.types, n)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, which errs upwards where joins are below."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hashed(df: DataFrame, rows: int | None) -> DataFrame:
    """The side of a join that is only looked up: as a hash table where a partition's share is known to fit, which saves sorting the other side."""
    fixed = all(t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") for _, t in df.dtypes)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if fixed and rows is not None and rows * 16 * (len(df.columns) + 2) <= parts * HASHED_BYTES else df
