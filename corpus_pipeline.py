"""From documents to token ids: quality, near duplicates, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and gets all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, neardup, quality, secrets, tiling
from quern.llm.common import ensure_checkpoint_dir, read_table
from quern.llm.queries import ENGLISH_RANKS, PATTERN, RANKS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below its limit go."""
    return quality.kept(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id.  Five words, 0.8."""
    return neardup.deduplicated(docs, shingle=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return tiling.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows."""
    done = secrets.redacted(docs, ENGLISH_RANKS, PATTERN)
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else done


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    return bpe.encoded(docs, RANKS, PATTERN)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("secrets", redact_secrets), ("encoding", encode_bpe)]

#: Trained models and BPE can't be expressed in SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what lies between them is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            at = f"{base}/{n}-{name}"
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
            if before:
                path = spark._jvm.org.apache.hadoop.fs.Path(before)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            before = at
    return docs
