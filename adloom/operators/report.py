"""The digest of liked content, and its HTML page."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.text import clip
from adloom.operators.backlog import timestamp

# Report window and clip widths, and the markup of one line.
WINDOW_HOURS = 72
CONTENT_WIDTH = 79
NOTE_WIDTH = 29
LINE = "<p><a href='%s'>%s (%s)</a>"
HEADER = '<html><head><meta charset="utf-8"></head><body>'
FOOTER = "</body></html>"


def escape(text: Column) -> Column:
    """HTML-escape, ampersand first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def line(escaped: bool = False) -> Column:
    fields = (
        F.coalesce(F.col("url"), F.lit("")),
        clip(F.col("content"), CONTENT_WIDTH),
        clip(F.col("note"), NOTE_WIDTH),
    )
    return F.format_string(LINE, *(escape(f) if escaped else f for f in fields))


def digest(
    liked: DataFrame, as_of: datetime, hours: int = WINDOW_HOURS, escaped: bool = False
) -> DataFrame:
    """Distinct report lines of the window with their newest time, newest first."""
    return (
        liked.filter(F.col("ts") > timestamp(as_of - timedelta(hours=hours)))
        .groupBy(line(escaped).alias("line"))
        .agg(F.max("ts").alias("ts"))
        .orderBy(F.desc("ts"), "line")
    )


def html_lines(lines: DataFrame) -> DataFrame:
    """The page in order: header, report lines, footer."""
    spark = lines.sparkSession
    frame = spark.createDataFrame(
        [(0, HEADER), (2, FOOTER)], "section int, value string"
    ).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    body = lines.select(F.lit(1).alias("section"), F.col("line").alias("value"), "ts")
    return frame.unionByName(body).orderBy("section", F.desc("ts"), "value").select("value")


def write_html(lines: DataFrame, path: str) -> None:
    """Write the page as text parts that follow one another in name order.

    A small report is one part; a large one is range-partitioned by the sort, so
    no task holds all of it.
    """
    html_lines(lines).write.mode("overwrite").text(path)
