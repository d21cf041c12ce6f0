"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from tallyspark.functions.shared import discard, new_folder, release, saved, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that an operator is about to add; names are compared without case."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in taken])


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold about `most` bytes; no row is left out. A
    single longer text makes a part of its own."""
    n, start, total = batch.num_rows, 0, 0
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i in range(n):
        size = sizes[i] or 0
        if i > start and (total + size > most or i - start >= 4096):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if n > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A null text counts as an empty one."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]
