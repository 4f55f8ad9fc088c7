import hashlib
import random
import sys
from datetime import datetime, timedelta

import pytest
from adloom.operators.backlog import timestamp
from adloom.plans import modes
from adloom.plans.state import Run, StateStore
from adloom.session import CHECKPOINT_DIR, shared_dir
from adloom.sources.rules import RuleSet
from adloom.streaming import stream as S
from pyspark import cloudpickle
from pyspark.sql import functions as F

START = datetime(2024, 1, 10, 6, 0, 0)


def run_at(number):
    return Run(number, START + timedelta(hours=number))


@pytest.fixture
def store(spark):
    return StateStore(spark, shared_dir(spark, "state"))


def listing(spark, urls, status=200):
    anchors = "".join(f'<a class="href-link" href="{u}">x</a>' for u in urls)
    return spark.createDataFrame(
        [("http://h/list", f"<html><body>{anchors}</body></html>", status)],
        "url string, html string, status int",
    )


def ads(spark, texts):
    """Pages from url -> text; a number stands for that status."""
    return spark.createDataFrame(
        [
            (n, u, f"<span class='pre'>{t}</span>", t if isinstance(t, int) else 200)
            for n, (u, t) in enumerate(texts.items())
        ],
        "page_id long, url string, html string, status int",
    )


def column(df, name="url"):
    return sorted(r[name] for r in df.collect())


def test_tables_come_into_being_with_their_first_run(spark, store):
    for table in ("url", "content", "dupe", "liked"):
        assert store.current(table).count() == 0
    modes.browse(store, listing(spark, ["/a", "/a", "/b c", "b#x"]), run_at(1))
    assert column(StateStore(spark, store.root).current("url")) == ["http://h/a", "http://h/b#x"]


def test_browse_adds_only_new_urls(spark, store):
    assert column(modes.browse(store, listing(spark, ["/a", "/b"]), run_at(1))) == ["http://h/a", "http://h/b"]
    again = modes.browse(store, listing(spark, ["/b", "/c"]), run_at(2))
    assert [(r.url, r.ts) for r in again.collect()] == [("http://h/c", run_at(2).as_of)]
    assert store.current("url").count() == 3
    assert modes.browse(store, listing(spark, ["/d"], 404), run_at(3)).count() == 0


def test_browse_rejects_listing_with_fragment(spark, store):
    pages = listing(spark, ["/a"]).withColumn("url", F.lit("http://h/list#top"))
    assert modes.browse(store, pages, run_at(1)).count() == 0
    assert modes.links(pages).count() == 0


def test_links_and_fetch_store_nothing(spark):
    found = modes.links(listing(spark, ["/b", "a", "/b"])).orderBy("selector_no", "pos")
    assert [r.link for r in found.collect()] == ["http://h/b", "http://h/a", "http://h/b"]
    assert modes.fetch(ads(spark, {"http://h/1": "some text"})).first().content == "\nsome text\n\n\n\n"


def test_collect_closes_the_whole_backlog(spark, store):
    modes.browse(store, listing(spark, ["/ok", "/gone", "/missing", "/x#f"]), run_at(1))
    pages = ads(spark, {"http://h/ok": "fine", "http://h/gone": 404, "http://h/x#f": "text", "http://h/other": "more"})
    done = modes.collect(store, pages, run_at(1))
    assert column(done.content) == ["http://h/ok"]
    assert column(done.rejects, "reason") == ["HTTP status 404", "not an absolute URI: http://h/x#f"]
    assert tuple(done.advice.first()) == (4, 4, "all new")
    assert {(r.url, r.visited) for r in store.current("url").collect()} == {
        (f"http://h/{u}", 1) for u in ("ok", "gone", "missing", "x#f")
    }
    later = modes.collect(store, pages, run_at(2))
    assert later.content.count() == 0 and later.advice.first().advice == "none"


def test_retry_failed_keeps_failures_open(spark, store):
    modes.browse(store, listing(spark, ["/ok", "/gone"]), run_at(1))
    modes.collect(store, ads(spark, {"http://h/ok": "fine", "http://h/gone": 500}), run_at(1), retry_failed=True)
    done = modes.collect(store, ads(spark, {"http://h/gone": "back again"}), run_at(2), retry_failed=True)
    assert column(done.content) == ["http://h/gone"]


@pytest.mark.parametrize("limit", [2, None])
def test_oldest_urls_come_first(spark, store, limit):
    modes.browse(store, listing(spark, ["/z"]), run_at(1))
    modes.browse(store, listing(spark, ["/b", "/a"]), run_at(2))
    pages = ads(spark, {f"http://h/{u}": f"text of {u}" for u in "abz"})
    done = modes.collect(store, pages, run_at(2), limit=limit)
    assert column(done.content) == [f"http://h/{u}" for u in ("az" if limit else "abz")]


def test_equal_pages_within_a_batch_are_all_stored_unless_strict(spark):
    pages = ads(spark, {"http://h/1": "same text 1", "http://h/2": "same text 2"})
    for strict, expected in ((False, 2), (True, 1)):
        store = StateStore(spark, shared_dir(spark, "batch"))
        assert modes.collect_pages(store, pages, run_at(1), within_batch=strict).content.count() == expected
        assert store.current("dupe").count() == 1
        later = modes.collect_pages(store, ads(spark, {"http://h/3": "same text 3"}), run_at(2))
        assert later.content.count() == 0
        assert later.duplicates.first().recent_url == ("http://h/1" if strict else "http://h/2")


def test_first_page_of_a_url_counts(spark, store):
    twice = ads(spark, {"http://h/1": "older text"}).withColumn("page_id", F.lit(1)).unionByName(
        ads(spark, {"http://h/1": "newer text"}).withColumn("page_id", F.lit(2))
    )
    assert modes.collect_pages(store, twice, run_at(1)).content.first().content == "\nolder text\n\n\n\n"
    assert modes.collect_pages(store, twice, run_at(2)).content.count() == 0
    with pytest.raises(ValueError):
        modes.collect_pages(store, twice.drop("page_id"), run_at(3))


def test_first_usable_page_of_a_url_counts(spark, store):
    pages = spark.createDataFrame(
        [
            (1, "http://h/1", None, 500),
            (2, "http://h/1", "<span class='pre'>good text</span>", 200),
            (2, "http://h/1", "<span class='pre'>good text</span>", 200),
            (3, "http://h/1", "<span class='pre'>later text</span>", 200),
            (1, "http://h/2", None, 404),
        ],
        "page_id long, url string, html string, status int",
    )
    done = modes.collect_pages(store, pages, run_at(1))
    assert [r.content.strip() for r in done.content.collect()] == ["good text"]
    assert [tuple(r) for r in done.rejects.collect()] == [("http://h/2", "HTTP status 404")]


def test_pages_that_fail_in_extraction_are_rejects(spark, store, monkeypatch):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    monkeypatch.setattr("adloom.functions.html.select_text", failing)
    modes.browse(store, listing(spark, ["/ok", "/bad"]), run_at(1))
    pages = ads(spark, {"http://h/ok": "fine", "http://h/bad": "boom"})
    done = modes.collect(store, pages, run_at(1), retry_failed=True)
    assert column(done.content) == ["http://h/ok"]
    assert [tuple(r) for r in done.rejects.collect()] == [("http://h/bad", "not parsed: ValueError: boom")]
    assert column(store.log("visited")) == ["http://h/ok"]


def failing(page, axes):
    if "boom" in page:
        raise ValueError("boom")
    return [[["some text"]] for _ in axes]


def test_failures_do_not_starve_the_queue(spark, store):
    modes.browse(store, listing(spark, ["/a"]), run_at(1))
    modes.browse(store, listing(spark, ["/b"]), run_at(2))
    pages = ads(spark, {"http://h/b": "fetched text"})
    for number in (2, 3):
        modes.collect(store, pages, run_at(number), limit=1, retry_failed=True)
    assert column(store.current("content")) == ["http://h/b"]


def test_runs_of_others_are_not_overwritten(spark, store):
    modes.collect_pages(store, ads(spark, {"http://h/1": "some text"}), run_at(1))
    with pytest.raises(ValueError):
        store.claim(Run(1, run_at(1).as_of, "other"))
    with pytest.raises(ValueError):
        store.claim(Run(2, START))
    assert store.run_of("other", START).id == 2 and store.run_of("other", START).id == 2
    assert store.run_of("other", START).as_of == run_at(1).as_of
    assert store.run_of("third", run_at(5).as_of).id == 3


def letters(number):
    return "word" + "".join("abcdefghij"[int(d)] for d in str(number))


def batches(seed, runs=5, size=12, kinds=12):
    rng = random.Random(seed)
    return [
        {f"http://h/{n}-{i}": f"{letters(rng.randrange(kinds))} {rng.randrange(99)}" for i in range(size)}
        for n in range(1, runs + 1)
    ]


def model(pages_per_run, limit):
    """The collect loop, one batch after the other, on plain dictionaries."""
    content, dupe = {}, {}
    for number, pages in enumerate(pages_per_run, 1):
        ranked = sorted(dupe, key=lambda s: (-dupe[s][1], s))
        known = set(ranked[:limit])
        for url in sorted(pages):
            word = pages[url].split()[0]
            sig = hashlib.md5(word.encode()).hexdigest()
            if sig not in known:
                content[url] = pages[url]
                dupe[sig] = (url, number)
    return content, dupe


@pytest.mark.parametrize("limit", [3, 1000])
def test_collect_equals_the_sequential_model(spark, store, limit):
    runs = batches(1)
    for number, pages in enumerate(runs, 1):
        modes.collect_pages(store, ads(spark, pages), run_at(number), snapshot=limit)
    content, dupe = model(runs, limit)
    got = {r.url: r.content.strip() for r in store.current("content").collect()}
    assert got == content
    stored = {r.sig: (r.recent_url, r.ts) for r in store.current("dupe").collect()}
    assert stored == {s: (u, run_at(n).as_of) for s, (u, n) in dupe.items()}
    newest = {r.sig for r in store.snapshot(len(runs) + 1, 5).collect()}
    assert newest == set(sorted(dupe, key=lambda s: (-dupe[s][1], s))[:5])
    beyond = store.snapshot(len(runs) + 1, 5000)
    assert column(beyond, "sig") == sorted(dupe)


def test_repeating_a_run_changes_nothing(spark, store):
    runs = batches(2, runs=3)
    for number, pages in enumerate(runs, 1):
        for _ in range(2):
            modes.collect_pages(store, ads(spark, pages), run_at(number), snapshot=3)
    assert {r.url: r.content.strip() for r in store.current("content").collect()} == model(runs, 3)[0]


RULES = (RuleSet("r", ("red", "blue"), ("damp",)),)


def test_cycle_search_report(spark, store):
    texts = {"http://h/1": "Red house", "http://h/2": "blue, damp", "http://h/3": "green", "http://h/4": "RED house!"}
    page = listing(spark, [u.removeprefix("http://h") for u in texts])
    digest = modes.run_cycle(store, page, ads(spark, texts), RULES, run_at(1))
    assert column(digest, "line") == [
        "<p><a href='http://h/1'>\nRed house\n\n\n\n (Red)</a>",
        "<p><a href='http://h/4'>\nRED house!\n\n\n\n (RED)</a>",
    ]
    assert column(modes.list_recent(store.current("content"), run_at(1).as_of)) == sorted(texts)
    store.register_views("t_")
    assert spark.sql("SELECT count(*) FROM t_liked JOIN t_url USING (url) WHERE visited = 1").first()[0] == 2


def test_same_content_at_two_urls_leaves_the_last(spark, store):
    rows = [("http://h/1", "red", START), ("http://h/2", "red", START)]
    store.write("content", spark.createDataFrame(rows, "url string, content string, ts timestamp_ntz"), 1)
    modes.search(store, RULES, run_at(1))
    assert column(store.current("liked")) == ["http://h/2"]
    modes.search(store, RULES, run_at(2))
    assert [(r.url, r.ts) for r in store.current("liked").collect()] == [("http://h/2", run_at(2).as_of)]
    assert modes.search(store, RULES, Run(3, START + timedelta(days=5))).count() == 0


def test_compacted_copy_goes_on_like_the_original(spark, store):
    runs = batches(3, runs=3)
    for number, pages in enumerate(runs[:2], 1):
        modes.collect_pages(store, ads(spark, pages), run_at(number), snapshot=3)
    modes.browse(store, listing(spark, ["/q"]), run_at(2))
    copy = store.copy_to(shared_dir(spark, "copy"), 2)
    for one in (store, copy):
        modes.collect_pages(one, ads(spark, runs[2]), run_at(3), snapshot=3)
    for table in ("url", "content", "dupe"):
        assert sorted(store.current(table).collect()) == sorted(copy.current(table).collect())


def test_match_given_text(spark):
    df = spark.createDataFrame([("a red door",)], "body string")
    assert tuple(modes.match(df, *RULES, text="body").first()) == ("a red door", "r", "liked", ["red"])


def test_run_ids_start_at_one():
    with pytest.raises(ValueError):
        Run(0, START)


def test_shared_folder_is_the_one_the_cluster_names(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get(CHECKPOINT_DIR) + "/x-")


def test_stream_equals_batch_loop(spark, store):
    runs = batches(4, runs=3)
    folder, offsets = shared_dir(spark, "in"), shared_dir(spark, "offsets")
    schema = "page_id bigint, url string, html string"
    for pages in runs:
        ads(spark, pages).selectExpr("1L page_id", "url", "html").coalesce(1).write.mode("append").parquet(folder)
        S.collect_stream(
            S.page_stream(spark, folder, spark.createDataFrame([], schema).schema, 1),
            store,
            offsets,
            clock=lambda number: run_at(number + 1).as_of,
            snapshot=3,
        ).awaitTermination()
    content, dupe = model(runs, 3)
    assert {r.url: r.content.strip() for r in store.current("content").collect()} == content
    assert column(store.current("dupe"), "sig") == sorted(dupe)


def test_streams_after_a_batch_run_keep_its_rows(spark, store):
    modes.collect_pages(store, ads(spark, {"http://h/1": "one text"}), run_at(1))
    for number in (2, 3):
        folder, offsets = shared_dir(spark, "in"), shared_dir(spark, "offsets")
        page = ads(spark, {f"http://h/{number}": f"{letters(number)} text"})
        page.select("page_id", "url", "html").write.parquet(folder)
        stream = S.page_stream(spark, folder)
        S.collect_stream(stream, store, offsets, clock=lambda _: run_at(9).as_of).awaitTermination()
    assert column(store.current("content")) == ["http://h/1", "http://h/2", "http://h/3"]
    assert sorted(r.run for r in store.log("claims").collect()) == [1, 2, 3]


def stream_of(spark, rows, schema):
    folder = shared_dir(spark, "texts")
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def collected(spark, stream):
    folder = shared_dir(spark, "out")
    stream.writeStream.format("parquet").option("path", folder).option(
        "checkpointLocation", shared_dir(spark, "chk")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder)


def test_stream_dedup_keeps_one_of_each_however_late(spark, store):
    folder, offsets = shared_dir(spark, "texts"), shared_dir(spark, "offsets")
    schema = "url string, content string, ts timestamp_ntz"
    for part in range(3):
        rows = [
            (f"u{part}-{n}", f"{letters(n % (3 + part) if n % 3 else 0)} {n}", START - timedelta(days=9 * part))
            for n in range(100)
        ]
        df = spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        S.dedup_stream(stream, store, offsets).awaitTermination()
    kept = S.kept_rows(store)
    assert kept.count() == 5 and set(kept.columns) == {"url", "content", "ts", "sig", "run"}
    assert {r.url[:2] for r in kept.collect()} == {"u0", "u1", "u2"}


def test_stream_classification(spark):
    stream = stream_of(spark, [("1", "red"), ("2", "red damp")], "url string, content string")
    judged = collected(spark, S.classify_stream(stream, *RULES))
    assert {(r.url, r.verdict) for r in judged.collect()} == {("1", "liked"), ("2", "disliked")}


def test_literal_timestamp(spark):
    assert spark.range(1).select(timestamp(START).alias("t")).first().t == START


def texts_folder(spark):
    folder = shared_dir(spark, "texts")

    def add(rows):
        df = spark.createDataFrame(rows, "url string, content string, ts timestamp_ntz")
        df.coalesce(2).write.mode("append").parquet(folder)
        return spark.readStream.schema(df.schema).parquet(folder)

    return add


def test_stream_dedup_state_survives_restarts_and_repeated_batches(spark, store, monkeypatch):
    add, offsets, read = texts_folder(spark), shared_dir(spark, "offsets"), []
    log = StateStore.log
    monkeypatch.setattr(StateStore, "log", lambda s, table, **k: read.append(table) or log(s, table, **k))
    others = StateStore.of_others
    monkeypatch.setattr(StateStore, "of_others", lambda *a: read.append(others(*a)))
    clock = lambda number: run_at(number + 1).as_of
    stream = add([("a", "one 1", START), ("b", "one 2", None), ("c", None, START), ("d", "two", START), ("n", None, START), ("m", None, START)])
    S.dedup_stream(stream, store, offsets, clock=clock).awaitTermination()
    assert column(S.kept_rows(store)) == ["b", "c", "d"]  # no time comes first
    # The first batch again: it does not meet its own signatures.
    S.repeat_last_batch(spark, offsets)
    S.dedup_stream(stream, store, offsets, clock=clock).awaitTermination()
    assert column(S.kept_rows(store)) == ["b", "c", "d"]
    for part in range(2):
        add([(f"e{part}", "two", START), (f"f{part}", "three", START - timedelta(days=9))])
        read.clear()
        S.dedup_stream(stream, store, offsets, clock=clock).awaitTermination()
        assert "seen" not in read and None in read  # no batch reads what came before
    S.repeat_last_batch(spark, offsets)
    S.dedup_stream(stream, store, offsets, clock=clock).awaitTermination()
    assert column(S.kept_rows(store)) == ["b", "c", "d", "f0"]


@pytest.mark.parametrize("folded", [False, True])
def test_a_stream_knows_what_others_have_seen(spark, store, folded):
    def go_on(add, offsets, rows):
        S.dedup_stream(add(rows), store, offsets, clock=lambda _: START).awaitTermination()

    one, two = ((texts_folder(spark), shared_dir(spark, "offsets")) for _ in range(2))
    go_on(*one, [("a", "one", START)])
    go_on(*two, [("b", "one", START), ("c", "two", START)])
    go_on(*one, [("d", "two", START), ("e", "three", START), ("f", "one", START)])
    if folded:
        assert store.compact() == 1 and store.manifest().segments[0].folders["seen"][1] == 1
    go_on(*two, [("g", "three", START), ("h", "four", START), ("i", "one", START)])
    go_on(*one, [("j", "four", START), ("k", "five", START)])
    assert column(S.kept_rows(store)) == ["a", "c", "e", "h", "k"]


def test_browse_counts_come_with_its_writes(spark, store):
    first = modes.browse_counted(store, listing(spark, ["/a", "/a", "/b"]), run_at(1))
    assert (first.n_new, first.n_distinct, first.n_input) == (2, 2, 3)
    again = modes.browse_counted(store, listing(spark, ["/b", "/c", "/c"]), run_at(2))
    assert (again.n_new, again.n_distinct, again.n_input) == (1, 2, 3)
    repeated = modes.browse_counted(store, listing(spark, ["/b", "/c", "/c"]), run_at(2))
    assert (repeated.n_new, repeated.n_distinct, repeated.n_input) == (1, 2, 3)
    none = modes.browse_counted(store, listing(spark, ["/d"], 404), run_at(3))
    assert (none.n_new, none.n_distinct, none.n_input) == (0, 0, 0)
