"""Links of listing pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import html as H
from adloom.functions import urls as U


def _conditions(selector: H.Selector) -> list[H.Selector]:
    upper = [selector.ancestor] if selector.ancestor else []
    return [s for s in (selector, *upper) if s.attr is not None]


def _always_plain(value: str) -> bool:
    return value.isascii() and value.replace("-", "").isalnum() and "fj" not in value


def _may_match(html: Column, selectors: Sequence[H.Selector]) -> Column:
    """False only for pages in which no selector can match.

    A page without the attribute value of any condition has no hit, unless the
    value is spelled with character references. Letters and digits have numeric ones
    only, but for the pair ``fj``.
    """
    gate = F.lit(False)
    for selector in selectors:
        values = [s.value for s in _conditions(selector)]
        if not values or not all(map(_always_plain, values)):
            return F.lit(True)
        needed = F.lit(True)
        for value in values:
            needed = needed & html.contains(value)
        gate = gate | needed
    return gate | html.contains("&#")


def all_hrefs(
    pages: DataFrame, selectors: Sequence[H.Selector] = H.LISTING_LINKS, html: str = "html"
) -> DataFrame:
    """One row per hit: page columns, ``selector_no``, ``pos`` and ``href``.

    Order is selector first, then document order; repeated hits stay. Pages that
    cannot match are not sent to Python.
    """
    rest = [c for c in pages.columns if c != html]
    gated = F.when(_may_match(F.col(html), selectors), F.col(html))
    found = pages.withColumn("found", H.links(gated, selectors)).select(
        *rest, F.posexplode("found.value").alias("selector_no", "hrefs")
    )
    return found.select(*rest, "selector_no", F.posexplode("hrefs").alias("pos", "href"))


def failures(
    pages: DataFrame, selectors: Sequence[H.Selector] = H.LISTING_LINKS, html: str = "html"
) -> DataFrame:
    """``url`` and ``error`` of the pages in which links could not be looked for."""
    gated = F.when(_may_match(F.col(html), selectors), F.col(html))
    found = pages.select("url", H.links(gated, selectors).alias("found"))
    return found.select("url", F.col("found.error").alias("error")).filter("error IS NOT NULL")


def hrefs(pages: DataFrame, selector: H.Selector, html: str = "html") -> DataFrame:
    """Hits of one selector: page columns, ``pos`` and ``href``."""
    return all_hrefs(pages, (selector,), html).drop("selector_no")


def valid_hrefs(found: DataFrame) -> DataFrame:
    """Hits whose href is a well-formed URI reference; others are dropped silently."""
    return found.filter(U.is_uri_reference(F.col("href")))


def absolute_links(
    pages: DataFrame,
    selectors: Sequence[H.Selector] = H.LISTING_LINKS,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Valid hits with ``link``, the href resolved against the page's own URL.

    The page URL is taken apart once per page, before the hits fan out.
    """
    kept = [c for c in pages.columns if c != html]
    based = U.with_parts(pages, url, "_base_")
    found = valid_hrefs(all_hrefs(based, selectors, html))
    resolved = U.with_resolved(found, "href", "_base_", "link")
    return resolved.select(*kept, "selector_no", "pos", "href", "link")
