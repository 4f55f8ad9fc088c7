"""Counts of rows taken while they are written, so that none is read for its count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from adloom.operators.skew import few


def write_counted(
    rows: DataFrame,
    target: str,
    columns: Sequence[str] | None = None,
    overwrite: bool = False,
    **told: Column,
) -> dict:
    """Write the rows, or some columns of them, and return their number as ``rows``, and
    aggregates by name, which may read columns that are not written.

    They are taken by the tasks that write, after all shuffles. Of such a task one attempt
    counts, however often it or a stage before it is repeated.
    """
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in told.items()))
    if columns is not None:
        counted = counted.select(*columns)
    counted.write.mode("overwrite" if overwrite else "errorifexists").parquet(target)
    return seen.get


def total_bytes(column: str, where: Column | None = None) -> Column:
    """Aggregate: the bytes of a column's texts."""
    size = F.octet_length(column)
    return F.coalesce(F.sum(size if where is None else F.when(where, size)), F.lit(0))


def told_few(told: dict) -> bool:
    """Whether what was written is small enough to go to every executor."""
    return few(told["rows"], told["bytes"])
