"""State over many runs: compaction, repeated runs, claims, queues and what is read."""

import random
import threading
from datetime import datetime, timedelta

import pytest
from adloom.operators import skew
from adloom.plans import modes, state
from adloom.plans.state import Bounds, Run, StateStore
from adloom.session import shared_dir
from adloom.streaming import stream as S
from pyspark.sql import functions as F

START = datetime(2024, 1, 10, 6)


def run_at(number, owner="batch"):
    return Run(number, START + timedelta(hours=number), owner)


@pytest.fixture
def store(spark):
    return StateStore(spark, shared_dir(spark, "state"))


def ads(spark, texts):
    rows = [(n, u if "/" in u else f"http://h/{u}", f"<span class=\'pre\'>{t}</span>") for n, (u, t) in enumerate(texts.items())]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def listing(spark, urls):
    anchors = "".join(f'<a class="href-link" href="{u}">x</a>' for u in urls)
    return spark.createDataFrame([("http://h/list", f"<body>{anchors}</body>")], "url string, html string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def dupes(spark, rows):
    return spark.createDataFrame(rows, "sig string, recent_url string, ts timestamp_ntz").coalesce(1)


def files_read(df):
    return {path.split("/")[-2] for path in df.inputFiles()}


def folders(store):
    return {t: store.files.names(store.path(t)) for t in (*state.TABLES, "bounds/dupe", "manifest")}


def test_many_runs_are_folded_in_levels(spark, store, monkeypatch):
    monkeypatch.setattr(state, "FAN", 3)
    rng = random.Random(1)
    model, most = {}, 0
    for number in range(1, 25):
        run = run_at(number)
        store.claim(run)
        new = [(f"s{rng.randrange(12)}", f"u{number}-{i}", run.as_of) for i in range(3)]
        new = list({row[0]: row for row in new}.values())
        store.write("dupe", dupes(spark, new), number)
        store.write("visited", dupes(spark, new).select(F.col("recent_url").alias("url")), number)
        model |= {row[0]: row for row in new}
        if number % 3 == 0:
            before = rows_of(store.current("dupe"))
            assert store.compact() == number - 1  # the last run may be repeated
            assert rows_of(store.current("dupe")) == before == rows_of(dupes(spark, list(model.values())))
        most = max(most, len(store.files.names(store.path("dupe"))))
    told = store.manifest()
    assert [s.first for s in told.segments] == [1, *(s.last + 1 for s in told.segments[:-1])]
    assert len(told.segments) <= 6 and told.upto == 23
    assert len({s.level for s in told.segments}) > 1
    # Neither folders nor names pile up.
    assert most < 20 and all(len(names) < 20 for names in folders(store).values())
    assert store.log("visited").count() == len({r.url for r in store.log("visited").collect()}) > 50
    assert sorted(r.run for r in store.log("claims").collect()) == list(range(1, 25))
    assert sorted(r.run for r in store.log("visited", after=10, before=13).select("run").distinct().collect()) == [11, 12]


def test_compaction_that_fails_half_way_is_not_seen(spark, store, monkeypatch):
    for number in (1, 2, 3):
        store.claim(run_at(number))
        store.write("dupe", dupes(spark, [(f"s{number}", "u", START)]), number)
    before = rows_of(store.current("dupe"))
    put = store.files.put
    monkeypatch.setattr(store.files, "put", lambda path, *rest, **how: "manifest" not in path and put(path, *rest, **how))
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.undo()
    assert rows_of(store.current("dupe")) == before and store.manifest().upto == 0
    assert store.compact() == 2 and store.compact() == 2
    assert rows_of(store.current("dupe")) == before


def test_folded_runs_are_not_repeated_and_the_last_one_is(spark, store):
    for number in (1, 2, 3):
        store.claim(run_at(number))
        store.write("dupe", dupes(spark, [("s", f"u{number}", START)]), number)
    store.compact()
    with pytest.raises(ValueError, match="folded"):
        StateStore(spark, store.root).claim(run_at(2))
    with pytest.raises(ValueError, match="folded"):
        store.copy_to(shared_dir(spark, "copy"), 1)
    again = StateStore(spark, store.root)
    again.claim(run_at(3))
    # What run 2 had stored is known to the repeated run.
    assert [r.recent_url for r in again.snapshot(3).collect()] == ["u2"]
    again.write("dupe", dupes(spark, []), 3)
    assert [r.recent_url for r in again.current("dupe").collect()] == ["u2"]


@pytest.mark.parametrize("how", ["in place", "copy"])
def test_retry_after_compaction_loses_nothing(spark, store, how):
    folder, offsets = shared_dir(spark, "in"), shared_dir(spark, "offsets")
    schema = "page_id bigint, url string, html string"
    empty = spark.createDataFrame([], schema).schema

    def started(where):
        clock = lambda number: START + timedelta(hours=number)
        S.collect_stream(S.page_stream(spark, folder, empty), where, offsets, clock=clock).awaitTermination()

    for number, texts in enumerate(({"a": "one", "b": "two", "c": "three"}, {"d": "four", "e": "one"})):
        ads(spark, texts).coalesce(1).write.mode("append").parquet(folder)
        started(store)
    before = {t: rows_of(store.current(t)) for t in ("content", "dupe")}
    assert [row[0][-1] for row in before["content"]] == ["a", "b", "c", "d"]
    S.repeat_last_batch(spark, offsets)
    if how == "copy":
        store = store.copy_to(shared_dir(spark, "copy"), 2)
    else:
        assert store.compact() == 1
    started(store)
    assert {t: rows_of(store.current(t)) for t in before} == before
    assert sorted(r.run for r in store.log("claims").collect()) == [1, 2]


def test_copy_keeps_everything(spark, store):
    texts = spark.createDataFrame([("u1", "some words", START)], "url string, content string, ts timestamp_ntz")
    folder = shared_dir(spark, "texts")
    texts.write.parquet(folder)
    S.dedup_stream(spark.readStream.schema(texts.schema).parquet(folder), store, shared_dir(spark, "o"),
                   clock=lambda _: START).awaitTermination()
    for number in (2, 3, 4):
        modes.browse(store, listing(spark, [f"/{number}", "/gone"]), run_at(number))
        pages = ads(spark, {f"http://h/{number}": f"text {chr(96 + number)}"})
        modes.collect(store, pages, run_at(number), limit=9, retry_failed=True)
    copy = store.copy_to(shared_dir(spark, "copy"), 4, gone=[w for w in writers(store) if w != "batch"])
    assert copy.manifest().upto == 3
    for table in ("content", "dupe", "url", "liked"):
        assert rows_of(copy.current(table)) == rows_of(store.current(table))
    for table in ("backlog", "claims", "seen", "kept", "found"):
        assert rows_of(copy.log(table)) == rows_of(store.log(table))
    assert rows_of(S.kept_rows(copy)) == rows_of(S.kept_rows(store))
    for one in (store, copy):
        assert [r.url for r in one.waiting(5).collect()] == ["http://h/gone"]


def writers(store):
    return {state.writer_of(r.owner) for r in store.log("claims").collect()}


def test_of_two_writers_one_gets_the_run(spark, store):
    for attempt in range(1, 6):
        results, start = {}, threading.Barrier(2)

        def claim(name):
            mine = StateStore(spark, store.root)
            mine.log = lambda *a, log=mine.log, **k: (log(*a, **k), start.wait(60))[0]
            try:
                results[name] = mine.claim(Run(attempt, START, name))
            except ValueError as error:
                results[name] = error

        both = [threading.Thread(target=claim, args=(n,)) for n in ("one", "two")]
        [t.start() for t in both]
        [t.join() for t in both]
        won = [n for n, r in results.items() if isinstance(r, Run)]
        assert len(won) == 1
        owner = store.log("claims").filter(F.col("run") == attempt).first().owner
        assert owner == won[0] and "belongs to" in str(results[{"one": "two", "two": "one"}[owner]])


def test_recent_rows_are_looked_for_in_recent_runs(spark, store):
    for number in range(1, 31):
        run = run_at(24 * number)
        rows = [(f"u{number}", "text", run.as_of)] if number % 7 else []
        table = spark.createDataFrame(rows, "url string, content string, ts timestamp_ntz").coalesce(1)
        store.claim(run)
        store.write("content", table, run.id)
        if number == 20:
            store.compact()
    since = run_at(24 * 29).as_of - timedelta(minutes=1)
    recent = store.log("content", since=since)
    assert files_read(recent) == {f"run={24 * 29}", f"run={24 * 30}"}
    assert sorted(r.url for r in recent.collect()) == ["u29", "u30"]
    assert not store.log("content", upto=24 * 30, since=START + timedelta(days=99)).inputFiles()
    # Folded runs are read where they may matter.
    old = store.current("content", since=run_at(24 * 18).as_of)
    assert {r.url for r in old.collect()} == {f"u{n}" for n in range(19, 31) if n % 7}
    assert Bounds.of(Bounds(3, None, 5).name(7)) == (7, Bounds(3, None, 5))


def test_a_run_reads_the_last_queue_and_what_came_since(spark, store):
    rng = random.Random(3)
    waiting = {}
    for number in range(1, 9):
        run = run_at(number)
        urls = [f"/{rng.randrange(60)}" for _ in range(9)]
        new = modes.browse(store, listing(spark, urls), run).collect()
        waiting |= {r.url: (r.ts, r.url) for r in new}
        if number == 5:  # comes by another way, and needs no collecting
            other = min(waiting)
            modes.collect_pages(store, ads(spark, {other: "other text", "http://h/new": "more"}), run)
            waiting.pop(other)
            continue
        taken = sorted(waiting, key=waiting.get)[:4]
        assert [r.url for r in store.waiting(number).orderBy("ts", "url").limit(4).collect()] == taken
        modes.collect(store, ads(spark, {u: f"text of {chr(97 + number)}" for u in taken}), run, limit=4)
        for url in taken:
            waiting.pop(url)
    assert rows_of(store.waiting(9)) == sorted((u, ts) for u, (ts, _) in waiting.items())
    store.compact()
    assert len([r for r in store.files.names(store.path("open"))]) > 5
    assert rows_of(store.waiting(9)) == sorted((u, ts) for u, (ts, _) in waiting.items())
    # Of the urls and the queues only the last run's are read, of those closed none.
    read = {path.split(store.root)[-1].strip("/").rsplit("/", 1)[0] for path in store.waiting(9).inputFiles()}
    assert {folder for folder in read if not folder.startswith("content")} == {"open/run=8"}


def test_keys_are_looked_for_without_moving_the_history(spark, monkeypatch):
    history = spark.range(0, 5000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    incoming = spark.range(4990, 5010).select(F.concat(F.lit("k"), "id").alias("key"))
    for bits in (27, 15, 3):  # with few bits most keys share their hash with another
        monkeypatch.setattr(skew, "MAP_BITS", bits)
        hits = {r.id for r in skew.matching(history, incoming, "key").collect()}
        assert hits >= set(range(4990, 5000)) and (bits < 27 or len(hits) == 10)
        new = skew.without_known(incoming, history, "key")
        assert sorted(r.key for r in new.collect()) == [f"k{n}" for n in range(5000, 5010)]
    small = skew.matching(history, incoming, "key", small=True)
    assert {r.id for r in small.collect()} == set(range(4990, 5000))
    for found in (small, skew.matching(history, incoming, "key")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]
        assert "Exchange" not in moved and "BroadcastHashJoin" in plan
