"""Fetched pages: ``(url, html[, status[, status_message]])``, and listing seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions import urls as U

OK = 200


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of fetched pages."""
    return spark.read.parquet(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(url, content)``, to be classified without being stored."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("url"), F.col("value").alias("content"))


def _optional(pages: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in pages.columns else default


def rejection(pages: DataFrame) -> Column:
    """Why a page is not used, or null: bad URL first, then the status."""
    status = _optional(pages, "status", F.lit(OK))
    message = _optional(pages, "status_message", F.lit(""))
    return (
        F.when(
            ~F.coalesce(U.is_absolute_uri(F.col("url")), F.lit(False)),
            F.concat(F.lit("not an absolute URI: "), F.coalesce("url", F.lit(""))),
        )
        .when(
            status != OK,
            F.rtrim(F.concat(F.lit("HTTP status "), status.cast("string"), F.lit(" "), message)),
        )
        .when(F.col("html").isNull(), "no body")
    )


def route(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable pages, and ``(url, reason)`` of the others."""
    reason = rejection(pages)
    usable = pages.filter(reason.isNull())
    rejects = pages.select("url", reason.alias("reason")).filter(F.col("reason").isNotNull())
    return usable, rejects


def seed_listings(templates: DataFrame, template: str = "template", pages: int = 3) -> DataFrame:
    """Listing urls from templates with one ``%d`` for the page number, 1 upwards."""
    return templates.withColumn(
        "page_no", F.explode(F.sequence(F.lit(1), F.lit(pages)))
    ).withColumn(
        "url", F.replace(F.col(template), F.lit("%d"), F.col("page_no").cast("string"))
    )
