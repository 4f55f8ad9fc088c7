import time

import pyarrow as pa
import pytest
from adloom.functions.html import (
    AD_AXES,
    LISTING_LINKS,
    Selector,
    select_links,
    select_text,
    text_nodes,
)
from adloom.functions.html import links as html_links
from adloom.operators import extract, isolate, links
from pyspark.sql import functions as F

SPAN = (Selector("span", "class", "pre"),)


def span_nodes(html):
    return select_text(html, SPAN)[0]


def hrefs(html):
    return select_links(html, LISTING_LINKS)


def test_whole_attribute_must_equal():
    assert span_nodes("<p><span class='pre x'>no</span><span class=pre>yes</span></p>") == [["yes"]]


def test_class_token_among_several():
    assert hrefs('<a class="x href-link y" href="/1"><a class="href-links" href="/2">') == [[], ["/1"]]


def test_anchor_without_href_is_dropped():
    assert hrefs('<a class="href-link">x</a><a class="href-link" href="">y</a>') == [[], [""]]


def test_ancestor_at_any_depth():
    html = (
        '<a href="/0">0</a><div class="asset-list"><ul><li><div><a href="/1">1</a></div>'
        '<a href="/2">2</a></ul></div><a href="/3">3</a>'
    )
    assert hrefs(html) == [["/1", "/2"], []]


def test_anchor_hit_by_both_selectors_comes_twice():
    html = '<div class="asset-list"><a class="href-link" href="/1">1</a></div>'
    assert hrefs(html) == [["/1"], ["/1"]]


def test_nested_ancestors_give_an_anchor_once():
    html = '<div class="asset-list"><div class="asset-list"><a href="/1"></a></div></div>'
    assert hrefs(html)[0] == ["/1"]


def test_unclosed_ancestor_contains_nothing():
    assert hrefs('<div class="asset-list"><a href="/1">') == [[], []]


def test_anchors_in_comments_do_not_count():
    assert hrefs('<!-- <a class="href-link" href="/1"> --><A CLASS="href-link" HREF=/2>') == [[], ["/2"]]


def test_href_is_decoded_only_for_closed_references():
    html = '<a class="href-link" href="/?a=1&amp;b=2&copy=3&#x41;&nosuch;">'
    assert hrefs(html)[1] == ["/?a=1&b=2&copy=3A&nosuch;"]


def test_markup_inside_quotes_is_not_markup():
    html = """<img alt="<a class='href-link' href='/no'>"><a title='>' class="href-link" href="/yes">"""
    assert hrefs(html)[1] == ["/yes"]


def test_nested_matches_are_both_emitted():
    html = "<span class=pre>outer <span class=pre>inner</span> tail</span>"
    assert span_nodes(html) == [["outer ", "inner", " tail"], ["inner"]]


def test_unclosed_inner_elements_end_with_the_match():
    html = "<div><span class=pre><p>one<p>two<b>three</span>after</div>"
    assert span_nodes(html) == [["one", "two", "three"]]


def test_outer_end_tag_closes_the_match():
    assert span_nodes("<p><span class=pre>in</p>out") == [["in"]]


def test_stray_end_tag_does_not_split_text():
    assert span_nodes("<span class=pre>ab</i>cd</span>") == [["abcd"]]


def test_comment_and_void_element_split_text():
    assert span_nodes("<span class=pre>ab<!-- x -->cd<br>ef</span>") == [["ab", "cd", "ef"]]


def test_references_are_part_of_their_text_node():
    assert span_nodes("<span class=pre>a&amp;b &lt;i&gt; &#211; &middot;</span>") == [["a&b <i> Ó ·"]]


def test_script_text_inside_a_match_is_raw():
    html = "<span class=pre>x<script>if (a<b) '</span>' &amp;</script>y</span>z"
    assert span_nodes(html) == [["x", "if (a<b) '</span>' &amp;", "y"]]


def test_title_counts_only_directly_below_head():
    html = "<html><head><title>One</title></head><body><svg><title>Two</title></svg></body></html>"
    assert select_text(html, AD_AXES)[0] == [["One"]]


def test_match_open_at_the_end_of_the_page():
    assert span_nodes("<span class=pre>text <b>bold") == [["text ", "bold"]]


def test_broken_markup_takes_linear_time():
    started = time.time()
    for html in ("<a " * 200_000, "<p>" * 200_000, "</p>" * 200_000, "<!--" * 200_000,
                 "<a b='" * 200_000, "<script>" * 100_000, "<div class='asset-list'>" * 50_000,
                 "<span class=pre>" * 300 + "x" * 1000, '="' * 300_000 + "<a =" * 100_000):
        select_text(html, AD_AXES)
        select_links(html, LISTING_LINKS)
    assert time.time() - started < 30


def page_text(spark, html):
    return extract.page_text(spark.createDataFrame([("u", html)], "url string, html string")).first()


def test_page_without_a_match_is_four_newlines(spark):
    assert page_text(spark, "<p>nothing here</p>").content == "\n" * 4
    assert page_text(spark, "").content == "\n" * 4


def test_blocks_in_axis_order(spark):
    html = (
        "<html><head><title>The title</title></head><body><div class='col-md-8'>Second site</div>"
        "<table id='attributeTable'><tr><td>Rooms</td><td>two</td><td>four</td></tr></table>"
        "<span class='pre'>First\n  \nSecond</span><span class='pre'>Third</span></body></html>"
    )
    assert page_text(spark, html).content == (
        "The title\n\nFirst\nSecond\nThird\n\nRoomsfour\n\nSecond site\n\n"
    )


def test_lines_are_trimmed_of_unicode_blanks(spark):
    html = "<span class=pre>\u00a0one \r\n\u2003two\u3000\n \r\n\u2028three\u200b</span>"
    assert page_text(spark, html).content == "\none\ntwo\n\u2028three\u200b\n\n\n\n"


def test_short_nodes_vanish_before_trimming(spark):
    html = "<span class=pre>abc<b>abcd</b>  x\n<i>a\nąb</i></span>"
    assert page_text(spark, html).content == "\nabcd  x\na\nąb\n\n\n\n"


def test_failing_rows_are_isolated(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("3",)], "s string")
    mapped = isolate.safe_map(df, "s", int, "bigint")
    assert {r.value for r in isolate.survivors(mapped).collect()} == {1, 3, None}
    failed = isolate.failures(mapped).collect()
    assert [r.s for r in failed] == ["x"] and failed[0].error.startswith("ValueError")
    assert isolate.fold(mapped, F.sum("value").alias("n")).first().n == 4


def test_gate_sends_only_candidates_but_loses_none(spark):
    pages = spark.createDataFrame(
        [
            ("1", '<a class="href-link" href="/1">'),
            ("2", '<a class="href&#45;link" href="/2">'),
            ("3", '<a href="/3">'),
            ("4", None),
        ],
        "url string, html string",
    )
    found = links.all_hrefs(pages).collect()
    assert {(r.url, r.href) for r in found} == {("1", "/1"), ("2", "/2")}


def test_unsupported_selectors_are_refused(spark):
    with pytest.raises(ValueError):
        text_nodes(F.col("html"), (Selector("b", ancestor=Selector("div")),))
    with pytest.raises(ValueError):
        html_links(F.col("html"), (Selector("a", parent="div"),))


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([("u", "<p>")], "url string, html string")
    for df in (extract.page_text(pages), links.absolute_links(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_few_rows_of_a_batch_are_python_objects_at_a_time(spark):
    alive, most = 0, 0

    class Text(str):
        def __init__(self, _):
            nonlocal alive, most
            alive += 1
            most = max(most, alive)

        def __del__(self):
            nonlocal alive
            alive -= 1

    run = isolate.isolated(lambda page: Text(f"{page}!"), "string").func
    found = run(pa.array([f"p{i}" for i in range(5000)]))
    assert found.to_pylist() == [{"value": f"p{i}!", "error": None} for i in range(5000)]
    assert most < 500
    assert run(pa.array([], pa.string())).to_pylist() == []
