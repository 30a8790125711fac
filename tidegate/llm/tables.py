"""Helpers shared by the operators: tables, safe column names, small-table collection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TEXT_BLANKS = " \t\n\x0b\f\r"   # the contract's white space: space and code points 9 to 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores put before it until no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def collected(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table that a documented bound keeps small; more rows than that are an error, never a cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows


def rows_of(batches: Iterator[pa.RecordBatch], max_rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``max_rows``, which bounds what one step holds."""
    for batch in batches:
        for start in range(0, batch.num_rows, max_rows):
            yield batch.slice(start, max_rows)


def as_strings(column: pa.Array) -> Iterator[str | None]:
    """The values one by one, so that a batch of long texts is never held twice."""
    for value in column:
        yield value.as_py()
