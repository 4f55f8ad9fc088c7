import random
import re
from urllib.parse import urljoin, urlsplit

import pytest
from adloom.functions import urls as U
from pyspark.sql import functions as F

BASE = "http://a/b/c/d;p?q"
# RFC 3986 sections 5.4.1 and 5.4.2.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/",
    "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s",
    "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
    "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g",
    "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g",
    "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def resolved(spark, pairs):
    df = spark.createDataFrame([(i, r, b) for i, (r, b) in enumerate(pairs)], "i int, ref string, base string")
    rows = U.resolve(df, "ref", "base", "link").orderBy("i").collect()
    return [r.link for r in rows]


def test_rfc_examples(spark):
    refs = list(EXAMPLES)
    got = resolved(spark, [(r, BASE) for r in refs])
    assert dict(zip(refs, got)) == EXAMPLES


def test_base_without_path_and_without_authority(spark):
    got = resolved(
        spark,
        [("g", "http://a"), ("g", "http://a?q"), ("?x", "http://a"), ("n", "mailto:m"), ("../n", "x:a/b/c"), ("", "http://a/b#f")],
    )
    assert got == ["http://a/g", "http://a/g", "http://a?x", "mailto:n", "x:a/n", "http://a/b"]


def test_random_references_against_urljoin(spark):
    rng = random.Random(7)
    segments = ["a", "b.c", "..", ".", "x-1", "%41", "d;e"]
    pairs = []
    for _ in range(400):
        path = "/".join(rng.choice(segments) for _ in range(rng.randint(1, 5)))
        ref = rng.choice(["", "/", "./", "../"]) + path
        ref += rng.choice(["", "?k=v", "#f", "?k#f"])
        base = "https://h.example" + rng.choice(["/", "/p/q", "/p/q/", "/p/q/r.html"]) + rng.choice(["", "?z"])
        pairs.append((ref, base))
    got = resolved(spark, pairs)
    assert got == [urljoin(base, ref) for ref, base in pairs]


def flags(spark, values, test):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r.ok for r in df.select("i", test(F.col("u")).alias("ok")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "test, good, bad",
    [
        (
            U.is_uri_reference,
            ["", "a", "/a/b?c#d", "//h:80/x", "?q", "#f", "a/b:c", "http://[::1]/", "http://[1:2:3:4:5:6:7:8]",
             "http://[::ffff:1.2.3.4]:8/", "mailto:a@b", "%C4%85", "//", "x:", "http://u:p@h/"],
            ["a b", "ą", "%", "%4", "%4g", "a:b:c d", "1:b", ":a", "a^b", "http://h:8x/", "a#b#c", "http://[:1]/",
             "/a\n", "http://[::1::2]/", "<"],
        ),
        (
            U.is_absolute_uri,
            ["http://a/b?c", "x:", "file:///a", "urn:a:b", "HTTP://A"],
            ["http://a/b#c", "/a", "a", "", "//a/b", "1x:a", "http://a/ b"],
        ),
        (U.is_uri, ["http://a/b#c", "x:#"], ["/a", "a#b#c:"]),
    ],
)
def test_grammar(spark, test, good, bad):
    assert flags(spark, good, test) == [True] * len(good)
    assert flags(spark, bad, test) == [False] * len(bad)


def test_very_long_urls(spark):
    long = "http://h/" + "%D0%B0" * 50_000 + "/x" * 50_000 + "?" + "y" * 100_000 + "#" + "z/" * 50_000
    assert flags(spark, [long, "data:" + "A" * 300_000, long + "%"], U.is_uri_reference) == [True, True, False]
    assert resolved(spark, [(long, "http://b/")]) == [long]


def prefixes(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r.p for r in df.select("i", U.prefix(F.col("u")).alias("p")).orderBy("i").collect()]


def test_prefix_examples(spark):
    assert prefixes(spark, ["https://foo.com/bar#baz", "./bar", "http://u:p@h:80/x", "mailto:a@b", "http://[::1]:8/", "x y"]) == [
        "https://foo.com", None, "http://h", None, "http://[::1]", None,
    ]


def test_prefix_starts_with_the_protocol(spark):
    rng = random.Random(3)
    alphabet = "abcXYZ019" * 10 + "/" * 10 + "." * 5 + "#" * 2
    urls = [
        f"{rng.choice(['http', 'https'])}://" + "".join(rng.choices(alphabet, k=rng.randint(1, 150)))
        for _ in range(500)
    ]
    for url, prefix in zip(urls, prefixes(spark, urls)):
        if len(re.findall("#", url)) > 1:
            assert prefix is None
        else:
            parts = urlsplit(url)
            assert prefix == f"{parts.scheme}://{parts.netloc}"
