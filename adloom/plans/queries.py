"""Registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions import text as X
from adloom.functions import urls as U
from adloom.functions.patterns import fold
from adloom.operators import backlog as B
from adloom.operators import classify as C
from adloom.operators import dedup as D
from adloom.operators import extract, isolate, links, report, upsert
from adloom.plans import fixtures as T
from adloom.plans import modes
from adloom.plans.state import Run, StateStore
from adloom.session import shared_dir
from adloom.sources import pages as P
from adloom.sources.rules import load_rules
from adloom.streaming import stream as S

Query = Callable[[SparkSession, str], DataFrame]
# How many rows the top-k queries ask for.
NEWEST = 50
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _shown(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that no session time zone can matter."""
    return df.withColumn("ts", F.col("ts").cast("string"))


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("matches", F.array_join("matches", "|"))


# Sources and sinks


@query
def q_fetch_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return P.route(T.fetched(spark, sf))[1]


@query
def q_safe_map(spark: SparkSession, sf: str) -> DataFrame:
    mapped = isolate.safe_map(
        T.pages(spark, sf).select("url"),
        "url",
        lambda url: int(url.split("page=")[1].split("&")[0]),
        "bigint",
    )
    return isolate.fold(mapped, F.count("value").alias("n_ok"), F.sum("value").alias("total"))


@query
def q_store_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = T.pages(spark, sf)
    found = _links(pages)
    known = _links(pages.filter(F.col("url").startswith("http://"))).select("url")
    return _shown(upsert.store_urls(known, found, B.timestamp(T.AS_OF)))


@query
def q_store_urls_counts(spark: SparkSession, sf: str) -> DataFrame:
    pages = T.pages(spark, sf)
    known = _links(pages.filter(F.col("url").startswith("http://"))).distinct()
    return upsert.store_counts(known, _links(pages))


def _links(pages: DataFrame) -> DataFrame:
    return links.absolute_links(pages, (T.NAV_LINKS,)).select(F.col("link").alias("url"))


def _keyed_by_text(ads: DataFrame) -> DataFrame:
    """Ads at an address made from their letters, so that copies share a key."""
    return D.with_signature(ads).select(
        F.concat(F.lit(f"{T.ADS}t/"), "sig").alias("url"),
        X.content_hash(F.col("content")).alias("content"),
        "ts",
    )


@query
def q_store_content(spark: SparkSession, sf: str) -> DataFrame:
    ads = T.ad_texts(spark, sf)
    order = ["ts", "content"]
    current = D.keep_one(_keyed_by_text(T.even(ads)), ["url"], order, last=False)
    return _shown(upsert.insert_ignore(current, _keyed_by_text(T.odd(ads)), ["url"], order))


def _dupe_rows(ads: DataFrame) -> DataFrame:
    return ads.select("sig", F.col("url").alias("recent_url"), "ts")


@query
def q_upsert_signatures(spark: SparkSession, sf: str) -> DataFrame:
    ads = T.signed_ads(spark, sf)
    order = ["ts", "recent_url"]
    # The smallest time wins among current rows and the largest among incoming ones,
    # which tells replacing from mere sorting.
    current = D.keep_one(_dupe_rows(T.odd(ads)), ["sig"], order, last=False)
    return _shown(upsert.upsert_replace(current, _dupe_rows(T.even(ads)), ["sig"], order))


@query
def q_store_liked(spark: SparkSession, sf: str) -> DataFrame:
    judged = C.classify(T.ad_texts(spark, sf), T.TOPIC_A)
    return _shown(modes.last_liked(judged)).select("content_hash", "url", "note", "ts")


@query
def q_mark_visited(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(upsert.mark_visited(T.url_t(spark, sf), T.content_t(spark, sf)))


@query
def q_mark_visited_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Page urls as they are, and cut off where query or fragment starts."""
    pages = T.pages(spark, sf).select("url")
    cut = pages.select(F.regexp_replace("url", "[?#].*", "").alias("url"))
    return upsert.visited_counts(T.url_t(spark, sf), pages.unionByName(cut))


@query
def q_seed_listings(spark: SparkSession, sf: str) -> DataFrame:
    site = F.regexp_extract("url", "^https?://[^/]+/[a-z]+/", 0)
    templates = (
        T.pages(spark, sf).select(F.concat(site, F.lit("page-%d")).alias("template")).distinct()
    )
    return P.seed_listings(templates).select("page_no", "url")


# Links and urls


@query
def q_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    return links.hrefs(T.pages(spark, sf), T.ANY_LINK).select("page_id", "pos", "href")


@query
def q_links_class(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.regexp_replace("html", '<a href="/([a-m])', '<a class="row href-link" href="/$1')
    other = F.regexp_replace(marked, '<a href="/([n-z])', '<a class="href-links" href="/$1')
    pages = T.pages(spark, sf).withColumn("html", other)
    return links.all_hrefs(pages).select("page_id", "selector_no", "pos", "href")


@query
def q_links_descendant(spark: SparkSession, sf: str) -> DataFrame:
    return links.hrefs(T.pages(spark, sf), T.NAV_LINKS).select("page_id", "pos", "href")


@query
def q_all_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    found = links.all_hrefs(T.pages(spark, sf), (T.NAV_LINKS, T.ANY_LINK))
    return found.select("page_id", "selector_no", "pos", "href")


@query
def q_valid_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    found = links.hrefs(T.pages(spark, sf), T.ANY_LINK)
    return links.valid_hrefs(found).select("page_id", "pos", "href")


@query
def q_resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    found = links.absolute_links(T.pages(spark, sf), (T.ANY_LINK,))
    return found.select("page_id", "pos", "link")


@query
def q_resolve_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of reference against every page url."""
    page_id = F.col("page_id").cast("string")
    forms = F.array(
        *(
            F.concat(F.lit(head), page_id, F.lit(tail))
            for head, tail in (
                ("", ""),
                ("./", "/."),
                ("../", "?x=1"),
                ("../../../", ""),
                ("?p=", ""),
                ("#s", ""),
                ("//other.example.org/a/../", ""),
                ("/a/./b/../", "/.."),
                ("mailto:", "@example.org"),
            )
        )
    )
    refs = T.pages(spark, sf).select("page_id", "url", F.posexplode(forms).alias("form", "ref"))
    return U.resolve(refs, "ref", "url", "link").select("page_id", "form", "link")


@query
def q_reject_urls(spark: SparkSession, sf: str) -> DataFrame:
    return T.pages(spark, sf).select("url").filter(~U.is_absolute_uri(F.col("url")))


@query
def q_url_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Prefixes of page urls, as they are and with user info and port put in."""
    dressed = F.regexp_replace("url", "://([^/]+)", "://me:secret@$1:8080")
    return T.pages(spark, sf).select(
        "page_id", U.prefix(F.col("url")).alias("prefix"), U.prefix(dressed).alias("bare")
    )


# Content


@query
def q_page_title(spark: SparkSession, sf: str) -> DataFrame:
    return extract.page_text(T.pages(spark, sf), (T.TITLE,)).select("page_id", "content")


@query
def q_text_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = extract.parse(T.pages(spark, sf), (T.ARTICLE,)).select(
        "page_id", F.explode(F.col("nodes")[0]).alias("nodes")
    )
    return nodes.select(
        "page_id",
        F.size("nodes").cast("bigint").alias("n_nodes"),
        extract.subtree_text(F.col("nodes")).alias("text"),
    )


@query
def q_clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return T.documents(spark, sf).select(
        "doc_id", X.normalise_lines(F.col("text")).alias("lines")
    )


@query
def q_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract.page_text(T.pages(spark, sf), T.PAGE_AXES).select("page_id", "content")


@query
def q_ad_text(spark: SparkSession, sf: str) -> DataFrame:
    """All default axes, on documents put into ad markup."""
    return extract.page_text(T.ad_pages(T.ad_texts(spark, sf))).select("page_id", "content")


# Deduplication


@query
def q_purify(spark: SparkSession, sf: str) -> DataFrame:
    return T.documents(spark, sf).select("doc_id", X.purify(F.col("text")).alias("letters"))


@query
def q_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return T.signed_ads(spark, sf).select("doc_id", "sig")


@query
def q_exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    hashed = T.documents(spark, sf).select("doc_id", X.content_hash(F.col("text")).alias("hash"))
    return D.clusters(hashed, "hash", "doc_id")


@query
def q_dup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return D.clusters(T.signed_ads(spark, sf), "sig", "doc_id")


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """All signatures of the ads with an even id."""
    known = _dupe_rows(T.even(T.signed_ads(spark, sf)))
    return D.recent_signatures(D.keep_one(known, ["sig"], ["ts", "recent_url"], last=True))


@query
def q_recent_signatures(spark: SparkSession, sf: str) -> DataFrame:
    known = _dupe_rows(T.signed_ads(spark, sf))
    current = D.keep_one(known, ["sig"], ["ts", "recent_url"], last=True)
    return _shown(D.recent_signatures(current, NEWEST))


@query
def q_admit(spark: SparkSession, sf: str) -> DataFrame:
    admitted = D.admit(T.odd(T.signed_ads(spark, sf)), _snapshot(spark, sf))
    return admitted.select("doc_id", "sig")


@query
def q_dup_audit(spark: SparkSession, sf: str) -> DataFrame:
    dropped = D.duplicates(T.odd(T.signed_ads(spark, sf)), _snapshot(spark, sf))
    return dropped.select("doc_id", "url", "sig", "recent_url")


@query
def q_admit_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates within the batch removed as well."""
    admitted = D.admit(T.odd(T.signed_ads(spark, sf)), _snapshot(spark, sf))
    return D.first_per_signature(admitted, ["ts", "doc_id"]).select("doc_id", "sig")


@query
def q_admit_batches(spark: SparkSession, sf: str) -> DataFrame:
    batches = T.signed_ads(spark, sf).select(
        "doc_id", "sig", F.expr("doc_id div 250").alias("batch")
    )
    return D.admit_batches(batches).select("doc_id", "batch", "sig")


# Backlog


@query
def q_recently_fetched(spark: SparkSession, sf: str) -> DataFrame:
    return B.recently_fetched(T.titles_t(spark, sf), NEWEST)


@query
def q_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest of the queue."""
    return _shown(B.pending(T.url_t(spark, sf), T.content_t(spark, sf), NEWEST))


def _queue(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A backlog, and known urls that were fetched meanwhile by someone else."""
    backlog = B.pending(T.url_t(spark, sf), T.content_t(spark, sf))
    fetched = T.url_t(spark, sf).filter(F.col("url").contains("#"))
    return backlog, B.recently_fetched(fetched)


@query
def q_new_urls(spark: SparkSession, sf: str) -> DataFrame:
    return B.new_urls(*_queue(spark, sf)).select("url")


@query
def q_backlog_advice(spark: SparkSession, sf: str) -> DataFrame:
    return B.advice(*_queue(spark, sf))


@query
def q_recent_content(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(B.recent_content(T.titles_t(spark, sf), T.AS_OF))


@query
def q_mode_list(spark: SparkSession, sf: str) -> DataFrame:
    return modes.list_recent(T.ad_texts(spark, sf), T.AS_OF)


# Classification


@query
def q_rule_matches(spark: SparkSession, sf: str) -> DataFrame:
    ads = T.ad_texts(spark, sf).withColumn("folded", fold(F.col("content")))
    return ads.select(
        "doc_id",
        *(
            F.array_join(
                C.matches(F.col("content"), T.TOPIC_A.compiled(polarity), F.col("folded")), "|"
            ).alias(f"{polarity}s")
            for polarity in ("like", "dislike")
        ),
    )


@query
def q_classify(spark: SparkSession, sf: str) -> DataFrame:
    judged = C.classify(T.ad_texts(spark, sf), T.TOPIC_A)
    return _joined(judged).select("doc_id", "verdict", "matches")


@query
def q_classify_multi(spark: SparkSession, sf: str) -> DataFrame:
    judged = C.classify(T.ad_texts(spark, sf), T.TOPIC_A, T.TOPIC_B)
    return _joined(judged).select("doc_id", "rule_set", "verdict", "matches")


@query
def q_classify_many(spark: SparkSession, sf: str) -> DataFrame:
    """5,000 rules, of which each text meets few."""
    judged = C.classify_many(T.ad_texts(spark, sf), T.many_rules(), "doc_id")
    return _joined(judged).select("doc_id", "rule_set", "verdict", "matches")


@query
def q_rule_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Named classes next to accented letters and spaces that aren't ASCII, in patterns that
    either engine resolves."""
    spaced = F.replace("content", F.lit(" t"), F.lit("\u00a0t"))
    ads = T.ad_texts(spark, sf).withColumn("content", spaced)
    return _joined(C.classify(ads, T.TOPIC_D)).select("doc_id", "verdict", "matches")


@query
def q_verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.verdict_counts(C.classify(T.ad_texts(spark, sf), T.TOPIC_A, T.TOPIC_B))


@query
def q_liked_notes(spark: SparkSession, sf: str) -> DataFrame:
    liked = C.liked_rows(C.classify(T.ad_texts(spark, sf), T.TOPIC_A))
    return liked.select("doc_id", "content_hash", "note")


@query
def q_negative_audit(spark: SparkSession, sf: str) -> DataFrame:
    judged = C.classify(T.ad_texts(spark, sf), T.TOPIC_A)
    return _joined(C.negatives(judged)).select("url", "matches")


@query
def q_rule_longest(spark: SparkSession, sf: str) -> DataFrame:
    """Rules read from a file, in which the longest match decides what is reported."""
    path = shared_dir(spark, "rules")
    spark.range(1).select(F.lit(T.RULE_FILE)).coalesce(1).write.text(path)
    rules = load_rules(spark, path, "topic_c")
    return _joined(C.classify(T.ad_texts(spark, sf), rules)).select("doc_id", "verdict", "matches")


@query
def q_mode_match(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    return _joined(modes.match(turns, T.TOPIC_B, text="text")).select(
        "conv_id", "turn", "verdict", "matches"
    )


# Report


def _liked_t(spark: SparkSession, sf: str) -> DataFrame:
    return modes.last_liked(C.classify(T.ad_texts(spark, sf), T.TOPIC_A))


@query
def q_report(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(report.digest(_liked_t(spark, sf), T.AS_OF))


@query
def q_report_escaped(spark: SparkSession, sf: str) -> DataFrame:
    return report.digest(_liked_t(spark, sf), T.AS_OF, escaped=True).select("line")


@query
def q_report_clip(spark: SparkSession, sf: str) -> DataFrame:
    return T.ad_texts(spark, sf).select(
        "doc_id",
        X.clip(F.col("content"), report.CONTENT_WIDTH).alias("clip"),
        X.clip(F.col("url"), report.NOTE_WIDTH).alias("note_clip"),
    )


@query
def q_report_html(spark: SparkSession, sf: str) -> DataFrame:
    return report.html_lines(report.digest(_liked_t(spark, sf), T.AS_OF))


# Modes


def _store(spark: SparkSession, label: str) -> StateStore:
    return StateStore(spark, shared_dir(spark, label))


FIRST, SECOND = Run(1, T.EARLIER), Run(2, T.AS_OF)


@query
def q_mode_links(spark: SparkSession, sf: str) -> DataFrame:
    return modes.links(T.fetched(spark, sf), (T.NAV_LINKS,))


@query
def q_mode_browse(spark: SparkSession, sf: str) -> DataFrame:
    pages = T.fetched(spark, sf)
    store = _store(spark, "browse")
    modes.browse(store, pages.filter(F.col("url").startswith("http://")), FIRST, (T.NAV_LINKS,))
    return _shown(modes.browse(store, pages, SECOND, (T.NAV_LINKS,)))


@query
def q_browse_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of two browse runs as their writes tell them."""
    pages, store = T.fetched(spark, sf), _store(spark, "counts")
    half = pages.filter(F.col("url").startswith("http://"))
    rows = []
    for run, part in ((FIRST, half), (SECOND, pages)):
        done = modes.browse_counted(store, part, run, (T.NAV_LINKS,))
        rows.append((run.id, done.n_new, done.n_distinct, done.n_input))
    return spark.createDataFrame(rows, "run long, n_new long, n_distinct long, n_input long")


@query
def q_mode_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return modes.fetch(T.fetched(spark, sf), T.PAGE_AXES)


def _collected(spark: SparkSession, sf: str, label: str) -> tuple[StateStore, modes.Collected]:
    """Ads with an even id queued and collected, then all ads."""
    store = _store(spark, label)
    ads = T.ad_texts(spark, sf)
    done = None
    for run, part in ((FIRST, T.even(ads)), (SECOND, ads)):
        modes.browse(store, T.listing_pages(part), run)
        done = modes.collect(store, T.ad_pages(ads), run)
    return store, done


@query
def q_mode_collect(spark: SparkSession, sf: str) -> DataFrame:
    store, _ = _collected(spark, sf, "collect")
    return _shown(store.current("content"))


@query
def q_mode_collect_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Pages fetched twice, the first time in vain, and what became of every url.

    A url whose second fetch failed as well is rejected with the reason of either.
    """
    store = _store(spark, "fetches")
    ads = T.ad_texts(spark, sf)
    modes.browse(store, T.listing_pages(ads), FIRST)
    page = F.col("page_id")
    good = T.ad_pages(ads).withColumn("status", F.when(page % 5 == 0, 500).otherwise(200))
    first = good.withColumn("status", F.lit(500))
    # A page without a body can't be read.
    second = good.withColumn("html", F.when(page % 7 != 0, F.col("html")))
    fetched = first.unionByName(second.withColumn("page_id", page + (1 << 40)))
    done = modes.collect(store, fetched, FIRST)
    stored = done.content.select("url", F.lit("stored").alias("outcome"))
    rejected = done.rejects.select("url", F.col("reason").alias("outcome")).distinct()
    return stored.unionByName(rejected)


@query
def q_mode_collect_audit(spark: SparkSession, sf: str) -> DataFrame:
    _, done = _collected(spark, sf, "audit")
    return done.duplicates.select("url", "sig", "recent_url")


@query
def q_state_views(spark: SparkSession, sf: str) -> DataFrame:
    """A report of one's own in SQL over the state tables."""
    store, _ = _collected(spark, sf, "views")
    store.register_views("state_")
    return spark.sql(
        """
        SELECT u.visited, c.url IS NOT NULL AS collected, count(*) AS n,
               count(DISTINCT d.sig) AS n_signatures
        FROM state_url u
        LEFT JOIN state_content c ON c.url = u.url
        LEFT JOIN state_dupe d ON d.recent_url = u.url
        GROUP BY u.visited, c.url IS NOT NULL
        """
    )


@query
def q_mode_search(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "search")
    store.write("content", T.ad_texts(spark, sf), 1)
    modes.search(store, (T.TOPIC_A, T.TOPIC_B), SECOND)
    return _shown(store.current("liked"))


@query
def q_full_cycle(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "cycle")
    ads = T.ad_texts(spark, sf)
    digest = None
    for run, part in ((FIRST, T.even(ads)), (SECOND, ads)):
        digest = modes.run_cycle(
            store, T.listing_pages(part), T.ad_pages(ads), (T.TOPIC_A,), run
        )
    return _shown(digest)


# Streaming


@query
def q_stream_collect(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that arrive in a growing folder, collected batch by batch."""
    store = _store(spark, "stream")
    folder, checkpoint = shared_dir(spark, "arrivals"), shared_dir(spark, "offsets")
    ads = T.ad_texts(spark, sf)
    for part in (T.even(ads), T.odd(ads)):
        T.ad_pages(part).write.mode("append").parquet(folder)
        arrived = S.page_stream(spark, folder)
        S.collect_stream(arrived, store, checkpoint, clock=lambda _: T.AS_OF).awaitTermination()
    return _shown(store.current("content"))


@query
def q_stream_after_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch run, then a stream, then a stream with a new checkpoint, on one store."""
    store = _store(spark, "mixed")
    ads = T.ad_texts(spark, sf)
    modes.collect_pages(store, T.ad_pages(ads.filter(F.col("doc_id") % 3 == 0)), FIRST)
    for remainder in (1, 2):
        folder, checkpoint = shared_dir(spark, "arrivals"), shared_dir(spark, "offsets")
        T.ad_pages(ads.filter(F.col("doc_id") % 3 == remainder)).write.parquet(folder)
        arrived = S.page_stream(spark, folder)
        S.collect_stream(arrived, store, checkpoint, clock=lambda _: T.AS_OF).awaitTermination()
    return _shown(store.current("content"))


@query
def q_stream_after_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """A batch run, and a stream of two batches; the state is then compacted in place, the
    stream repeats its last batch, and a stream with a new checkpoint follows."""
    store = _store(spark, "compacted")
    ads = T.ad_texts(spark, sf)
    part = F.col("doc_id") % 4
    modes.collect_pages(store, T.ad_pages(ads.filter(part == 0)), FIRST)
    for group in ((1, 2), (3,)):
        folder, checkpoint = shared_dir(spark, "arrivals"), shared_dir(spark, "offsets")
        for remainder in group:
            T.ad_pages(ads.filter(part == remainder)).write.mode("append").parquet(folder)
            arrived = S.page_stream(spark, folder)
            S.collect_stream(arrived, store, checkpoint, clock=lambda _: T.AS_OF).awaitTermination()
        if len(group) > 1:
            # Neither the batch program nor the stream's first batch comes again.
            store.compact(gone=["batch"])
            S.repeat_last_batch(spark, checkpoint)
            arrived = S.page_stream(spark, folder)
            S.collect_stream(arrived, store, checkpoint, clock=lambda _: T.AS_OF).awaitTermination()
    return _shown(store.current("content"))


def _stream_texts(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id",
        F.concat(F.lit(f"{T.ADS}a/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content"),
        T.minutes_ago(F.col("doc_id") * 7).alias("ts"),
    )


@query
def q_stream_classify(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.documents(spark, sf).schema
    texts = _stream_texts(S.page_stream(spark, f"{sf}/document[s].parquet", schema))
    rows = _joined(S.classify_stream(texts, T.TOPIC_A)).select("doc_id", "verdict", "matches")
    folder = shared_dir(spark, "verdicts")
    sink = rows.writeStream.format("parquet").option("path", folder).outputMode("append")
    sink = sink.option("checkpointLocation", shared_dir(spark, "verdicts-offsets"))
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(folder)


@query
def q_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that arrive in four batches, each older than the one before."""
    store = _store(spark, "unique")
    folder, checkpoint = shared_dir(spark, "texts"), shared_dir(spark, "texts-offsets")
    texts = _stream_texts(T.documents(spark, sf))
    top = (texts.agg(F.max("doc_id")).first()[0] or 0) + 1
    for part in range(4):
        here = F.col("doc_id").between(top * part // 4, top * (part + 1) // 4 - 1)
        texts.filter(here).write.mode("append").parquet(folder)
        arrived = S.page_stream(spark, folder, texts.schema)
        S.dedup_stream(arrived, store, checkpoint, clock=lambda _: T.AS_OF).awaitTermination()
    return S.kept_rows(store).select("doc_id", "sig")
