"""Neural predicates: networks score rows on the executors, and their labels become annotated disjunctions.

A network is any function from a pandas DataFrame of inputs to one row of probabilities (one for each label), or of
numbers (an embedding), per input row; it runs in Arrow batches, loaded once a task by ``make``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CompileError
from ..lang.ast import Atom, Const, Program, Var
from ..lang.parser import parse
from .exact import Answer, exact

Network = Callable[[pd.DataFrame], np.ndarray]


def predictions(inputs: DataFrame, make: Callable[[], Network], labels: list) -> DataFrame:
    """The input columns, label and probability: one row for each input and label."""
    kind = "bigint" if all(isinstance(x, int) for x in labels) else "string"
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = make()
        for batch in batches:
            p = np.asarray(network(batch), float).reshape(len(batch), len(labels))
            out = batch.loc[batch.index.repeat(len(labels))].reset_index(drop=True)
            yield out.assign(label=np.tile(np.array(labels, object), len(batch)), probability=p.ravel())

    return inputs.mapInPandas(run, f"{given}, label {kind}, probability double")


def embeddings(inputs: DataFrame, make: Callable[[], Network]) -> DataFrame:
    """The input columns and their embedding."""
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = make()
        for batch in batches:
            yield batch.assign(embedding=list(np.asarray(network(batch), float).reshape(len(batch), -1)))

    return inputs.mapInPandas(run, f"{given}, embedding array<double>")


def noisy_or(rows: DataFrame, keys: list[str], probability: str = "probability") -> DataFrame:
    """keys and the probability that at least one of a group's independent rows holds."""
    surely = F.max(F.col(probability) >= 1.0)
    none = F.sum(F.log1p(-F.least(F.col(probability), F.lit(1.0 - 1e-15))))
    return rows.groupBy(*keys).agg(F.when(surely, 1.0).otherwise(1.0 - F.exp(none)).alias(probability))


def grounded(program: str | Program, networks: dict[str, Callable[[], Network]], inputs: dict[str, DataFrame]) -> Program:
    """The program with a disjunction for each input row of every neural predicate.

    inputs: predicate -> rows of its network's inputs, by position.  The disjunctions are the program's own choices, so they
    come to the driver, as exact inference needs them."""
    p = (parse(program) if isinstance(program, str) else program).copy()
    for n in p.neural:
        if n.labels is None:
            raise CompileError(f"{n.atom.name} has no labels: its network gives embeddings")
        if n.network not in networks or n.atom.name not in inputs:
            raise CompileError(f"{n.atom.name} needs the network {n.network} and input rows")
        labels = [int(x) if x.lstrip("-").isdigit() else x for x in n.labels]
        df = inputs[n.atom.name].toDF(*n.inputs)
        const = lambda v: Const(v, "symbol" if isinstance(v, str) else "f64" if isinstance(v, float) else "i64")
        choices: dict[tuple, list] = {}
        for row in predictions(df, networks[n.network], labels).toLocalIterator():
            env = dict(zip(n.inputs, row[: len(n.inputs)], strict=True)) | {n.output: row["label"]}
            atom = Atom(n.atom.name, tuple(const(env[a.name]) if isinstance(a, Var) else a for a in n.atom.args))
            choices.setdefault(tuple(row[: len(n.inputs)]), []).append((row["probability"], atom))
        p.choices += [choices[k] for k in sorted(choices, key=str)]
    p.neural = []
    return p


def answer(spark: SparkSession, program: str | Program, networks: dict[str, Callable[[], Network]], inputs: dict[str, DataFrame]) -> list[Answer]:
    """Exact answers of a program with neural predicates."""
    return exact(grounded(program, networks, inputs))
