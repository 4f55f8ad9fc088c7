"""Failure-isolated mapping: a row whose function raises does not fail the job."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

import adloom

#: Rows whose values are held as Python objects at a time.
ROWS = 200
# Executors get the functions themselves and need no copy of this package.
cloudpickle.register_pickle_by_value(adloom)


def isolated(function: Callable[[Any], Any], value_type: str) -> Callable[..., Column]:
    """An Arrow-batched column function giving ``struct<value, error>`` per row.

    ``error`` names what was raised and is null for a row that went well. Null
    input gives a null value without an error.
    """
    result = T.StructType(
        [
            T.StructField("value", T.DataType.fromDDL(value_type)),
            T.StructField("error", T.StringType()),
        ]
    )
    arrow_result = to_arrow_type(result)

    def attempt(item: Any) -> dict[str, Any]:
        if item is None:
            return {"value": None, "error": None}
        try:
            return {"value": function(item), "error": None}
        except Exception as raised:
            return {"value": None, "error": f"{type(raised).__name__}: {raised}"}

    @F.arrow_udf(result)
    def run(items: pa.Array) -> pa.Array:
        # A batch may have many rows; only some of them are Python objects at a time.
        parts = (items.slice(first, ROWS) for first in range(0, max(len(items), 1), ROWS))
        return pa.concat_arrays(
            [pa.array([attempt(item.as_py()) for item in part], type=arrow_result) for part in parts]
        )

    # Keeps the optimizer from evaluating it twice when a filter uses the result.
    return run.asNondeterministic()


def safe_map(
    df: DataFrame, source: str, function: Callable[[Any], Any], value_type: str
) -> DataFrame:
    """All rows with ``value`` and ``error`` columns added."""
    return df.withColumn("outcome", isolated(function, value_type)(F.col(source))).select(
        *df.columns, "outcome.value", "outcome.error"
    )


def survivors(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.col("error").isNull()).drop("error")


def failures(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.col("error").isNotNull()).drop("value")


def fold(mapped: DataFrame, *aggregates: Column) -> DataFrame:
    """Combine the survivors' values, and count the failures.

    Failed rows have a null value, which aggregates over ``value`` leave out, so one
    pass gives both.
    """
    return mapped.agg(*aggregates, F.count("error").alias("n_failed"))
