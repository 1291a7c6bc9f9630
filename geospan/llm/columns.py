"""New columns beside a table's own ones, by position: whatever names the table has, none is mixed up, replaced or lost. Also small tables of the driver's own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel


def local(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table. From Arrow, since rows given as tuples are unpickled by executors, which start a second set of Python workers for it."""
    return spark.createDataFrame(pa.table(columns))


def numbered(df: DataFrame) -> DataFrame:
    """The same columns, called c0, c1, ..."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def appended(docs: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], kinds: Sequence[str], names: Sequence[str]) -> DataFrame:
    """docs with what f appends to its Arrow batches, of these types and under these names."""
    old = [x.dataType.simpleString() for x in docs.schema]
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate([*old, *kinds]))
    return numbered(docs).mapInArrow(kernel.mapped(f), schema).toDF(*docs.columns, *names)


def kept(docs: DataFrame, annotated: DataFrame, keep: Callable[[list[Column]], Column], change: Callable[[str, Column, list[Column]], Column] | None = None) -> DataFrame:
    """Rows of annotated, which is docs with columns appended, where keep(those) holds, cut to the columns of docs; change(name, column, those) may replace a column."""
    n = len(docs.columns)
    new = [F.col(f"c{i}") for i in range(n, len(annotated.columns))]
    rows = numbered(annotated).where(keep(new))
    return rows.select(*[(change(name, F.col(f"c{i}"), new) if change else F.col(f"c{i}")).alias(name) for i, name in enumerate(docs.columns)])
