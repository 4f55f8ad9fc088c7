"""The modes: each reads state and page tables and writes one run of state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import html as H
from adloom.operators import backlog as B
from adloom.operators import classify as C
from adloom.operators import dedup as D
from adloom.operators import extract, report, upsert
from adloom.operators.counted import told_few, total_bytes, write_counted
from adloom.operators.links import absolute_links
from adloom.operators.skew import broadcast_if, is_small, matching
from adloom.plans.state import Run, StateStore, newest
from adloom.session import shared_dir
from adloom.sources.pages import route
from adloom.sources.rules import RuleSet


@dataclass(frozen=True)
class Collected:
    """What a collect run did: stored content, and audits of the rest."""

    content: DataFrame
    #: Urls left out with their signature, and where it was seen last.
    duplicates: DataFrame
    #: Urls that gave no text, with the reason: refused pages, and pages not parsed.
    rejects: DataFrame
    #: Texts that were read, stored or not.
    read: DataFrame
    advice: DataFrame | None = None


@dataclass(frozen=True)
class Browsed:
    """What a browse run did: urls that are new, and counts."""

    new: DataFrame
    n_new: int
    n_distinct: int
    #: Links met, repeats included.
    n_input: int


def links(
    pages: DataFrame, selectors: Sequence[H.Selector] = H.LISTING_LINKS
) -> DataFrame:
    """Absolute links of listing pages in order; nothing is stored."""
    usable, _ = route(pages)
    return absolute_links(usable, selectors).select("url", "selector_no", "pos", "link")


def browse(
    store: StateStore,
    pages: DataFrame,
    run: Run,
    selectors: Sequence[H.Selector] = H.LISTING_LINKS,
) -> DataFrame:
    """Links of listing pages into the queue; returns the urls that are new."""
    return browse_counted(store, pages, run, selectors).new


def browse_counted(
    store: StateStore,
    pages: DataFrame,
    run: Run,
    selectors: Sequence[H.Selector] = H.LISTING_LINKS,
) -> Browsed:
    """As :func:`browse`; how many urls are new and were given is counted by its writes."""
    store.claim(run)
    hits = links(pages, selectors).groupBy(F.col("link").alias("url"))
    # Written before it is used, so that pages are parsed once. The number of times a url
    # was met goes through the shuffle with it and is summed up where it is written.
    found, told = store.write_told(
        "found",
        hits.agg(F.count(F.lit(1)).alias("given")),
        run.id,
        given=F.coalesce(F.sum("given"), F.lit(0)),
        bytes=total_bytes("url"),
    )
    known = store.log("url", before=run.id)
    new = upsert.store_urls(known, found, B.timestamp(run.as_of), told_few(told))
    new, added = store.write_told("url", new, run.id)
    return Browsed(new, added["rows"], told["rows"], told["given"])


def collect(
    store: StateStore,
    pages: DataFrame,
    run: Run,
    axes: Sequence[H.Selector] = H.AD_AXES,
    limit: int | None = None,
    snapshot: int | None = None,
    known: int | None = None,
    retry_failed: bool = False,
    within_batch: bool = False,
) -> Collected:
    """Text of queued pages into the content table, near-duplicates left out.

    All urls are taken from the queue and compared with all known signatures, unless
    ``limit`` takes up the oldest urls only and ``snapshot`` compares with the newest
    signatures only; ``known`` leaves out the urls fetched last. All urls taken are
    closed afterwards, found or not, unless ``retry_failed`` keeps those without a
    usable page open; then urls tried less often come first.
    """
    store.claim(run)
    content = store.log("content", before=run.id).drop("run")
    waiting = store.waiting(run.id)
    attempts = None
    if retry_failed and limit is not None:
        tried = store.log("backlog", before=run.id)
        attempts = tried.groupBy("url").agg(F.count(F.lit(1)).alias("attempts"))
    queue = store.write("backlog", B.oldest(waiting, limit, attempts), run.id)
    fetched_last = B.recently_fetched(content, known)
    wanted = queue if known is None else B.new_urls(queue, fetched_last, known)
    done = _store_pages(store, pages, run, axes, snapshot, within_batch, wanted, limit)
    closed = queue
    if retry_failed:
        closed = queue.join(done.read.select("url"), "url", "left_semi")
    closed = store.write("visited", closed.select("url"), run.id)
    left = queue.limit(0)
    if retry_failed or limit is not None:
        left = waiting.join(closed, "url", "left_anti")
    store.write("open", left, run.id)
    advice = B.advice(queue, fetched_last, known)
    return Collected(done.content, done.duplicates, done.rejects, done.read, advice)


def collect_pages(
    store: StateStore,
    pages: DataFrame,
    run: Run,
    axes: Sequence[H.Selector] = H.AD_AXES,
    snapshot: int | None = None,
    within_batch: bool = False,
) -> Collected:
    """As :func:`collect` for pages that arrive by themselves, without a queue."""
    store.claim(run)
    content = store.log("content", before=run.id)
    small = is_small(pages, "url")
    known = matching(content.select("url"), pages, "url", small).distinct()
    fresh = pages.join(F.broadcast(known) if small else known, "url", "left_anti")
    return _store_pages(store, fresh, run, axes, snapshot, within_batch)


def one_per_url(pages: DataFrame, urls: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    """The first page of every url, or of every given url, by ``page_id`` or else ``ts``.

    The choice is made on narrow rows; the html of other pages is not shuffled. Few
    given urls filter the pages before any shuffle.
    """
    order = next((c for c in ("page_id", "ts") if c in pages.columns), None)
    if order is None:
        raise ValueError("pages need page_id or ts, which tells the first page of a url")
    if urls is not None:
        pages = pages.join(broadcast_if(urls, bound), "url", "left_semi")
    # Pages that share url and order too are told apart by their html.
    pages = pages.withColumn("_html", F.xxhash64("html"))
    first = pages.groupBy("url").agg(F.min(F.struct(order, "_html")).alias("_first"))
    first = first.select("url", F.col("_first")[order].alias(order), F.col("_first._html").alias("_html"))
    keys = ["url", order, "_html"]
    chosen = pages.join(first, keys, "left_semi")
    # Rows that are equal in all of these stand for one fetch.
    others = [F.first(c).alias(c) for c in chosen.columns if c not in keys]
    return chosen.groupBy(*keys).agg(*others).drop("_html")


def _store_pages(
    store: StateStore,
    pages: DataFrame,
    run: Run,
    axes: Sequence[H.Selector],
    limit: int | None,
    within_batch: bool,
    urls: DataFrame | None = None,
    bound: int | None = None,
) -> Collected:
    usable, refused = route(pages)
    if urls is not None:
        refused = refused.join(broadcast_if(urls, bound), "url", "left_semi")
    chosen = one_per_url(usable, urls, bound)
    parsed = extract.outcomes(chosen.select("url", "html"), axes)
    # Written once: content, duplicates, and failures are all read from here.
    parsed = D.with_signature(parsed.withColumn("ts", B.timestamp(run.as_of)))
    whole = F.col("error").isNull()
    parsed, told = _kept_apart(store, parsed, "parsed", bytes=total_bytes("sig", whole))
    read = parsed.filter(whole).drop("error")
    # Probed by narrow rows, so that a signature that many texts share moves no text.
    signed = read.select("url", "sig", "ts")
    if limit is None:
        # Only signatures of this run are looked for; the others stay where they are.
        history = store.log("dupe", before=run.id)
        known = newest("dupe", matching(history, signed, "sig", told_few(told)))
    else:
        known = store.snapshot(run.id, limit)
    # The history is looked through once; what is stored and what is not follow from this.
    repeated = signed.drop("ts").join(known.select("sig", "recent_url"), "sig")
    repeated, _ = _kept_apart(store, repeated, "repeated")
    admitted = signed.join(repeated.select("url"), "url", "left_anti")
    if within_batch:
        admitted = D.first_per_signature(admitted, ["ts", "url"])
    content = store.write(
        "content", read.join(admitted.select("url"), "url", "left_semi"), run.id
    )
    named = admitted.select("sig", F.col("url").alias("recent_url"), "ts")
    store.write("dupe", D.keep_one(named, ["sig"], ["ts", "recent_url"], last=True), run.id)
    failed = parsed.select("url", F.concat(F.lit("not parsed: "), "error").alias("reason"))
    failed = failed.filter(F.col("reason").isNotNull())
    # A refused page counts only where its url has no usable one.
    refused = refused.join(parsed.select("url"), "url", "left_anti")
    return Collected(content, repeated, refused.unionByName(failed), read)


def _kept_apart(
    store: StateStore, rows: DataFrame, label: str, **told: Column
) -> tuple[DataFrame, dict]:
    """The rows, written to the shared folder and read back, and what was counted."""
    target = shared_dir(store.spark, label)
    told = write_counted(rows, target, **told)
    return store.spark.read.schema(rows.schema).parquet(target), told


def fetch(pages: DataFrame, axes: Sequence[H.Selector] = H.AD_AXES) -> DataFrame:
    """Cleaned text of pages; nothing is stored."""
    usable, _ = route(pages)
    return extract.page_text(usable.select("url", "html"), axes)


def search(
    store: StateStore,
    rule_sets: Sequence[RuleSet],
    run: Run,
    hours: int = B.HOURS,
) -> DataFrame:
    """Classify recent content and store what is liked; returns all verdicts."""
    store.claim(run)
    since = B.recency_cutoff(run.as_of, hours)
    content = store.log("content", upto=run.id, since=since).drop("run")
    recent = B.recent_content(content, run.as_of, hours)
    judged = C.classify(recent, *rule_sets)
    store.write("liked", last_liked(judged).withColumn("ts", B.timestamp(run.as_of)), run.id)
    return judged


def last_liked(judged: DataFrame) -> DataFrame:
    """Liked rows, one per rule set and text: the last by time and url."""
    return D.keep_one(
        C.liked_rows(judged), ["rule_set", "content_hash"], ["ts", "url"], last=True
    )


def match(texts: DataFrame, *rule_sets: RuleSet, text: str = "content") -> DataFrame:
    """Verdicts for given texts; nothing is stored."""
    return C.classify(texts, *rule_sets, text=text)


def list_recent(content: DataFrame, as_of: datetime, hours: int = B.HOURS) -> DataFrame:
    """Urls of recent content; the content itself is not read."""
    return B.recent_content(content, as_of, hours).select("url")


def run_cycle(
    store: StateStore,
    listings: DataFrame,
    pages: DataFrame,
    rule_sets: Sequence[RuleSet],
    run: Run,
    limit: int | None = None,
    hours: int = B.HOURS,
) -> DataFrame:
    """Browse, collect, search; returns the digest of liked content."""
    browse(store, listings, run)
    collect(store, pages, run, limit=limit)
    search(store, rule_sets, run, hours)
    since = run.as_of - timedelta(hours=report.WINDOW_HOURS)
    return report.digest(store.current("liked", upto=run.id, since=since), run.as_of)
