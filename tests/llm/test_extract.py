"""Blocks of broken markup, exact decoding, and main text of held-out layouts."""

import itertools
import random
import time

import pytest

from adloom.llm import extract as X


@pytest.fixture(scope="module")
def model():
    return X.fit(X.labelled_pages())


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<p>b<div>c</p>d</div>e", ["a", "b", "c", "d", "e"]),
        ("<p><b>x<br>y<p>z", ["x y", "z"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<p>&lt;b&gt; &amp;amp; &#233;&nbsp;&copy</p>", ["<b> &amp; é ©"]),
        ("<script>var a='<p>x</p>';</script><style>p{}</style>t<!-- <p>c</p> -->u", ["tu"]),
        ("<head><title>no</title></head><body>yes", ["yes"]),
        ("<head><title>no</title><body><p>yes", ["yes"]),
        ("<form>f<textarea>no</textarea><select><option>no</select></form>", ["f"]),
        ("<p>a</i></p></div>b<", ["a", "b<"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ],
)
def test_blocks(html, want):
    assert [b.text for b in X.blocks(html)] == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<![foo[x]>b<p>c", ["ab", "c"]),
        ("<p>a<![foo[ x > b ]]><p>c", ["a b ]]>", "c"]),
        ("<p>a<![ b><p>c", ["a", "c"]),
        ("<p>a<![[y]]><p>c", ["a", "c"]),
        ("<p>a<![iffy]><![if-x]><![]><![&]>b", ["ab"]),
        ("<p>a<![ b", ["a<![ b"]),
        ("<p>a<![[y", ["a<![[y"]),
        ("<p>a<![foo[ b", ["a<![foo[ b"]),
        ("<p>a<![CDATA[ x ]]><![if !IE]>b<![endif]>c", ["abc"]),
    ],
)
def test_marked_sections(html, want):
    assert [b.text for b in X.blocks(html)] == want


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article><p>a<svg class="i"/> b<p>c</article>d', ["a b", "c", "d"]),
        ("<p>a<svg><title/><style/><path d=x/>no</svg>b", ["ab"]),
        ("<div/>a</div><p>b<i/>c", ["a", "bc"]),
    ],
)
def test_self_closed_elements(html, want):
    assert [b.text for b in X.blocks(html)] == want


def test_no_marked_section_raises():
    rng = random.Random(5)
    pieces = ["<![", "[", "]", ">", "]]>", "if", "CDATA", "foo", " ", "<p>", "-", "é", "İ", "ſ", "<", "!", "&#1;", "-->"]
    for _ in range(3000):
        X.blocks("<p>a<![" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))))


def test_viterbi_finds_the_best_labels():
    rng = random.Random(1)
    for _ in range(30):
        page = X.blocks("".join(f"<p>{'w ' * rng.randint(1, 9)}</p>" for _ in range(rng.randint(1, 7))))
        names = {n for block in X.features(page) for n in block}
        weight = {n: rng.gauss(0, 1) for n in names}
        pair = ((rng.gauss(0, 1), rng.gauss(0, 1)), (rng.gauss(0, 1), rng.gauss(0, 1)))
        own = [sum(weight[n] for n in block) for block in X.features(page)]

        def score(labels, own=own, pair=pair):
            steps = sum(pair[a][b] for a, b in zip(labels, labels[1:]))
            return steps + sum(s for s, label in zip(own, labels) if label)

        best = max(itertools.product((0, 1), repeat=len(page)), key=score)
        assert score(X.Model(weight, pair).decode(page)) == pytest.approx(score(best))


def test_held_out_layouts(model):
    right = total = 0
    for html in X.labelled_pages(150, seed=77):
        page = X.blocks(html)
        right += sum(b.label == label for b, label in zip(page, model.decode(page)))
        total += len(page)
    assert right / total > 0.98


def test_a_page_with_everything_around_it(model):
    html = """<html><head><title>T</title></head><body><header class="site-header"><h2>Daily</h2></header>
    <nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
    <div class="cookie-notice">We use cookies. <button>OK</button></div>
    <main><article><h1>Rain &amp; wind</h1><p>It rained   all day,
    said the office.<p>More rain is due. <a href="/c">Maps</a> show where.</article></main>
    <aside class="related"><h3>More</h3><ul><li><a href="/d">Snow last year</a></ul></aside>
    <section id="comments"><h3>2 comments</h3><p>I got wet.</p></section>
    <div class="ad">Buy boots now.</div><form><p>Search the site</p></form>
    <footer>&copy; Daily. All rights reserved.</footer></body></html>"""
    assert model.text(html) == (
        "Rain & wind\nIt rained all day, said the office.\nMore rain is due. Maps show where."
    )


def test_query_takes_awkward_rows(spark, model):
    long = "<article>" + "<p>Some words of prose, and more of them.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (None, None, ""), (2, "v", "<nav><a>x</a></nav>"), (2, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = X.main_texts(pages, model).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.n_chars for r in got)[:2] == [0, 0]
    assert max(r.text.count("\n") for r in got) == 19_999
    assert X.main_texts(pages.filter("false"), model).count() == 0


@pytest.mark.parametrize("markup", [
    "<div>a" * 100_000, "<b>a</i>" * 100_000, "<i><div>" + "<b></i>x" * 100_000, "<p><span>x" * 50_000,
    "<ul><li>x" * 50_000, "".join(f"<div id=n{'ab'[i % 2]}{chr(97 + i % 26) * (i % 40)}>a" for i in range(50_000)),
], ids=["div", "inline", "closed by none", "p", "li", "names"])
def test_deep_nesting_takes_time_in_proportion(markup):
    begun = time.process_time()
    assert X.blocks(markup)
    assert time.process_time() - begun < 15


@pytest.mark.parametrize("tag", ["noscript", "object"])
def test_text_of_replaced_elements_is_kept(model, tag):
    body = "<p>{0} first words of the article, which go on for a while.</p>"
    page = f"<article><h1>A title</h1>{body}<{tag}><p>{{1}} words in place of something else, that go on.</p></{tag}>{body}</article>"
    assert "{1} words in place" in model.text(page)
