"""Page text: the text of chosen page parts, cleaned line by line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import html as H
from adloom.functions import text as X

# Fixed value: text nodes of up to this many characters are noise.
SHORT_NODE = 3


def subtree_text(nodes: Column) -> Column:
    """Text nodes long enough to matter, joined without a separator."""
    return F.array_join(F.filter(nodes, lambda node: F.length(node) > SHORT_NODE), "")


def block(matches: Column) -> Column:
    """Cleaned lines of all matches of one axis."""
    return X.terminate(
        F.flatten(F.transform(matches, lambda nodes: X.clean_lines(subtree_text(nodes))))
    )


def compose(axes: Column) -> Column:
    """One block per axis in axis order, each followed by a newline, empty or not."""
    return X.terminate(F.transform(axes, block))


def parse(
    pages: DataFrame, axes: Sequence[H.Selector] = H.AD_AXES, html: str = "html"
) -> DataFrame:
    """Pages with ``nodes`` (axis -> match -> text nodes) and ``error`` for ``html``."""
    rest = [c for c in pages.columns if c != html]
    return pages.withColumn("parsed", H.text_nodes(F.col(html), axes)).select(
        *rest, F.col("parsed.value").alias("nodes"), F.col("parsed.error").alias("error")
    )


def outcomes(
    pages: DataFrame, axes: Sequence[H.Selector] = H.AD_AXES, html: str = "html"
) -> DataFrame:
    """Pages with ``content`` and ``error`` instead of ``html``; one of the two is null."""
    ok = F.col("error").isNull() & F.col("nodes").isNotNull()
    return parse(pages, axes, html).select(
        *(c for c in pages.columns if c != html),
        F.when(ok, compose(F.col("nodes"))).alias("content"),
        F.when(~ok, F.coalesce("error", F.lit("no body"))).alias("error"),
    )


def page_text(
    pages: DataFrame, axes: Sequence[H.Selector] = H.AD_AXES, html: str = "html"
) -> DataFrame:
    """Pages with ``content`` instead of ``html``; :func:`outcomes` has those that failed."""
    return outcomes(pages, axes, html).filter(F.col("error").isNull()).drop("error")
