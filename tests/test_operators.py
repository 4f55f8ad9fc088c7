import re
from collections import defaultdict
from datetime import datetime, timedelta
from itertools import groupby

import pytest
from adloom.functions import text as X
from adloom.operators import backlog as B
from adloom.operators import dedup as D
from adloom.operators import report, skew, upsert
from adloom.sources import pages as P
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 31, 12, 34, 56)


def at(minutes):
    return T0 - timedelta(minutes=minutes)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_letters_only_signature(spark):
    df = spark.createDataFrame(
        [("Cena 100 zł",), ("Cena: 250 zł!",), ("cena zł",), ("123",), ("",), ("ǅ ʰ ª 漢",)], "t string"
    )
    letters = [r[0] for r in df.select(X.purify(F.col("t"))).collect()]
    assert letters == ["Cenazł", "Cenazł", "cenazł", "", "", "ǅʰª漢"]
    sigs = [r[0] for r in df.select(X.signature(F.col("t"))).collect()]
    assert sigs[0] == sigs[1] != sigs[2] and sigs[3] == sigs[4]
    exact = [r[0] for r in df.select(X.content_hash(F.col("t"))).collect()]
    assert len(set(exact)) == 6


def test_clip_counts_characters(spark):
    df = spark.createDataFrame([("ąęł" * 40,), (None,)], "t string")
    assert [r[0] for r in df.select(X.clip(F.col("t"), 79)).collect()] == [("ąęł" * 40)[:79], ""]


def test_recent_signatures_break_ties(spark):
    dupe = spark.createDataFrame(
        [("c", "u1", at(0)), ("b", "u2", at(0)), ("a", "u3", at(5))],
        "sig string, recent_url string, ts timestamp_ntz",
    )
    assert rows(D.recent_signatures(dupe, 2), "sig") == [("b",), ("c",)]
    assert rows(D.recent_signatures(dupe, None), "sig") == [("a",), ("b",), ("c",)]


@pytest.mark.parametrize("limit", [1000, None])
def test_admission_against_snapshot(spark, limit):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "id int, sig string")
    known = spark.createDataFrame([("c", "old")], "sig string, recent_url string")
    admitted = D.admit(batch, known, limit)
    assert rows(admitted, "id") == [(1,), (2,), (3,)]
    assert rows(D.duplicates(batch, known, limit), "id", "recent_url") == [(4, "old")]
    assert rows(D.first_per_signature(admitted, ["id"]), "id") == [(1,), (2,)]


def test_bounded_snapshot_is_broadcast_and_batch_not_shuffled(spark):
    batch = spark.range(100).select(F.col("id").cast("string").alias("sig"))
    plan = D.admit(batch, batch.limit(5), 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def batches(spark):
    """Every third row has one signature."""
    return spark.range(3000).select(
        "id",
        (F.col("id") / 100).cast("int").alias("batch"),
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("s"), (F.col("id") * 7919 % 700).cast("string")))
        .alias("sig"),
    )


def test_closed_form_equals_batch_loop(spark):
    df = batches(spark)
    known, expected = set(), []
    ordered = sorted(df.collect(), key=lambda r: r.id)
    for _, batch in groupby(ordered, key=lambda r: r.batch):
        admitted = [r for r in batch if r.sig not in known]
        known |= {r.sig for r in admitted}
        expected += [(r.id,) for r in admitted]
    assert rows(D.admit_batches(df), "id") == sorted(expected)


def test_rows_of_a_hot_signature_meet_by_batch(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.admit_batches(batches(spark))._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(sig#\d+, batch#\d+", plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clusters(spark):
    found = D.clusters(batches(spark), "sig", "id")
    hot = found.filter("sig = 'hot'").first()
    assert (hot.n, hot.first_id, hot.last_id) == (1000, 0, 2997)


@pytest.fixture
def contents(spark):
    current = spark.createDataFrame(
        [("a", "old", at(9))], "url string, content string, ts timestamp_ntz"
    )
    incoming = spark.createDataFrame(
        [("a", "new", at(1)), ("b", "second", at(2)), ("b", "first", at(3))],
        "url string, content string, ts timestamp_ntz",
    )
    return current, incoming


def test_insert_ignore_keeps_first(contents):
    merged = upsert.insert_ignore(*contents, ["url"], ["ts"])
    assert rows(merged, "url", "content") == [("a", "old"), ("b", "first")]


def test_upsert_replace_keeps_last(contents):
    merged = upsert.upsert_replace(*contents, ["url"], ["ts"])
    assert rows(merged, "url", "content", "ts") == [("a", "new", at(1)), ("b", "second", at(2))]


def test_keep_one_combines_before_the_shuffle(contents):
    plan = D.keep_one(contents[1], ["url"], ["ts"], last=True)._jdf.queryExecution()
    assert "partial_max_by" in plan.executedPlan().toString()


@pytest.mark.parametrize("small", [True, False])
def test_store_urls_and_counts(spark, small):
    current = spark.createDataFrame([("a", at(9), 1)], "url string, ts timestamp_ntz, visited int")
    given = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "url string")
    new = upsert.store_urls(current, given, B.timestamp(T0), small)
    assert rows(new, "url", "ts", "visited") == [("b", T0, 0), ("c", T0, 0)]
    assert tuple(upsert.store_counts(current, given).first()) == (2, 4)
    assert tuple(upsert.store_counts(current, given.filter("false")).first()) == (0, 0)


def test_few_long_urls_are_not_small(spark):
    given = spark.createDataFrame([("u" * 3_000_000,), ("v" * 3_000_000,)], "url string")
    assert not skew.is_small(given, "url") and skew.is_small(given.limit(1), "url")
    assert skew.is_small(given.limit(0), "url") and not skew.is_small(spark.range(10_001), "id")


def test_few_new_urls_do_not_shuffle_the_table(spark):
    spark.range(100_000).selectExpr("cast(id as string) url").createOrReplaceTempView("many_urls")
    given = spark.createDataFrame([("7",), ("x",)], "url string")
    new = skew.without_known(given, spark.table("many_urls"), "url", True)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and rows(new, "url") == [("x",)]


def test_mark_visited(spark):
    url = spark.createDataFrame(
        [("a", at(1), 0), ("b", at(2), 1), ("c", at(3), None)],
        "url string, ts timestamp_ntz, visited int",
    )
    keys = spark.createDataFrame([("a",), ("b",), ("x",), ("a",)], "url string")
    marked = {r.url: r.visited for r in upsert.mark_visited(url, keys).collect()}
    assert marked == {"a": 1, "b": 1, "c": None}
    assert rows(upsert.visited_counts(url, keys), "url", "changed") == [
        ("a", 1), ("a", 1), ("b", 1), ("x", 0),
    ]


def test_backlog(spark):
    url = spark.createDataFrame(
        [("a", at(1), 0), ("b", at(5), 0), ("c", at(9), 1), ("d", at(7), 0), ("e", at(8), None), ("f", at(5), 0)],
        "url string, ts timestamp_ntz, visited int",
    )
    content = spark.createDataFrame([("d", "x", at(0))], "url string, content string, ts timestamp_ntz")
    queue = B.pending(url, content)
    assert rows(queue, "url") == [("a",), ("b",), ("f",)]
    assert [r.url for r in B.pending(url, content, 2).collect()] == ["b", "f"]
    known = B.recently_fetched(content)
    assert tuple(B.advice(queue, known).first()) == (3, 3, "all new")
    fetched = spark.createDataFrame([("b",)], "url string")
    assert rows(B.new_urls(queue, fetched), "url") == [("a",), ("f",)]
    assert tuple(B.advice(queue, fetched).first()) == (3, 2, "some known")
    assert tuple(B.advice(queue.limit(0), fetched).first()) == (0, 0, "none")


def test_recency_starts_at_midnight(spark):
    content = spark.createDataFrame(
        [("a", datetime(2024, 1, 30)), ("b", datetime(2024, 1, 29, 23, 59, 59)), ("c", T0)],
        "url string, ts timestamp_ntz",
    )
    assert rows(B.recent_content(content, T0), "url") == [("a",), ("c",)]
    assert rows(B.recent_content(content, T0, 13), "url") == [("a",), ("c",)]
    assert rows(B.recent_content(content, T0, 12), "url") == [("c",)]


def test_recency_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "content")
    spark.createDataFrame([("a", "x", T0)], "url string, content string, ts timestamp_ntz").write.parquet(path)
    listed = B.recent_content(spark.read.parquet(path), T0).select("url")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-30T00:00)" in plan
    assert "ReadSchema: struct<url:string,ts:timestamp_ntz>" in plan


def test_digest(spark):
    liked = spark.createDataFrame(
        [
            ("u'1", "<b>&", "note", at(10)),
            ("u'1", "<b>&", "note", at(5)),
            ("u2", "y" * 100, "n" * 40, at(1)),
            ("u3", "late", None, T0 - timedelta(hours=72)),
            ("u4", None, None, T0 - timedelta(hours=71)),
        ],
        "url string, content string, note string, ts timestamp_ntz",
    )
    lines = report.digest(liked, T0)
    assert [(r.line, r.ts) for r in lines.collect()] == [
        (f"<p><a href='u2'>{'y' * 79} ({'n' * 29})</a>", at(1)),
        ("<p><a href='u'1'><b>& (note)</a>", at(5)),
        ("<p><a href='u4'> ()</a>", T0 - timedelta(hours=71)),
    ]
    escaped = [r.line for r in report.digest(liked, T0, escaped=True).collect()]
    assert escaped[1] == "<p><a href='u&#39;1'>&lt;b&gt;&amp; (note)</a>"


def test_html_page_keeps_order(spark, tmp_path):
    lines = spark.range(500).select(
        F.format_string("line %03d", "id").alias("line"),
        (F.lit(T0).cast("timestamp_ntz") - F.expr("INTERVAL '1' MINUTE") * F.col("id")).alias("ts"),
    )
    path = tmp_path / "report"
    report.write_html(lines, str(path))
    text = "".join(p.read_text("utf8") for p in sorted(path.glob("part-*")))
    assert text.split("\n") == [
        report.HEADER, *(f"line {n:03d}" for n in range(500)), report.FOOTER, "",
    ]


def test_routing(spark):
    pages = spark.createDataFrame(
        [
            ("http://a/1", "x", 200, "OK"),
            ("http://a/2", "x", 404, "Not Found"),
            ("http://a/3#f", "x", 500, None),
            ("/4", "x", 200, "OK"),
            ("http://a/5", None, 200, "OK"),
            ("http://a/6", "x", 503, None),
        ],
        "url string, html string, status int, status_message string",
    )
    usable, rejects = P.route(pages)
    assert rows(usable, "url") == [("http://a/1",)]
    assert dict(rows(rejects, "url", "reason")) == {
        "http://a/2": "HTTP status 404 Not Found",
        "http://a/3#f": "not an absolute URI: http://a/3#f",
        "/4": "not an absolute URI: /4",
        "http://a/5": "no body",
        "http://a/6": "HTTP status 503",
    }
    plain = pages.select("url", "html").filter("url = 'http://a/2'")
    assert rows(P.route(plain)[0], "url") == [("http://a/2",)]


def test_seed_listings(spark):
    templates = spark.createDataFrame([("http://a/p%d?x=1",), ("http://b/1",)], "template string")
    by_page = defaultdict(list)
    for r in P.seed_listings(templates).collect():
        by_page[r.page_no].append(r.url)
    assert {k: sorted(v) for k, v in by_page.items()} == {
        n: [f"http://a/p{n}?x=1", "http://b/1"] for n in (1, 2, 3)
    }


def test_texts_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two\n", "utf8")
    row = P.read_texts(spark, str(tmp_path)).first()
    assert row.content == "line one\nline two\n" and row.url.endswith("a.txt")
