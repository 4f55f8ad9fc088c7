"""Near-duplicate removal by letters-only signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.functions import text as X
from adloom.operators.skew import broadcast_if


def with_signature(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("sig", X.signature(F.col(content)))


def recent_signatures(dupe: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest signatures, all without a limit; ties go to the smaller signature."""
    chosen = dupe.select("sig", "recent_url", "ts")
    return chosen if limit is None else chosen.orderBy(F.desc("ts"), "sig").limit(limit)


def admit(rows: DataFrame, snapshot: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose signature is not in the snapshot.

    The snapshot is what was known before the batch, so equal rows within one
    batch are all admitted. ``limit`` is the bound the snapshot was taken with.
    """
    known = broadcast_if(snapshot.select("sig"), limit)
    return rows.join(known, "sig", "left_anti")


def duplicates(rows: DataFrame, snapshot: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows dropped by :func:`admit`, with the url the signature was last seen at."""
    known = broadcast_if(snapshot.select("sig", "recent_url"), limit)
    return rows.join(known, "sig")


def first_per_signature(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Stricter than the default: one row per signature within the batch too."""
    return keep_one(rows, ["sig"], order, last=False)


def keep_one(rows: DataFrame, key: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """The first or last row per key by ``order``, combined per task before the shuffle."""
    pick = F.max_by if last else F.min_by
    others = [c for c in rows.columns if c not in key]
    kept = rows.groupBy(*key).agg(
        pick(F.struct(*others), F.struct(*order)).alias("_row")
    )
    return kept.select(*key, "_row.*").select(*rows.columns)


def admit_batches(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """What batch-by-batch admission keeps of a whole table, in one pass.

    A signature is admitted by the first batch that holds it and known to all
    later ones. Equal to admitting the batches in turn against all signatures so
    far. The rows of a signature spread over its batches.
    """
    first = rows.groupBy("sig").agg(F.min(batch).alias(batch))
    return rows.join(first, ["sig", batch], "left_semi")


def clusters(rows: DataFrame, key: str, row_id: str) -> DataFrame:
    """Keys held by several rows: count, and smallest and largest row id."""
    return (
        rows.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(row_id).alias("first_id"),
            F.max(row_id).alias("last_id"),
        )
        .filter(F.col("n") > 1)
    )
