"""Inputs of the registered queries, all derived row by row from the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.html import Selector
from adloom.functions.text import signature
from adloom.operators.backlog import timestamp
from adloom.session import spread
from adloom.sources.rules import RuleSet

AS_OF = datetime(2024, 1, 31, 12, 34, 56)
EARLIER = AS_OF - timedelta(hours=30)

# Page parts and links of the test pages.
TITLE = Selector("title", parent="head")
ARTICLE = Selector("article")
NAV_LINKS = Selector("a", ancestor=Selector("nav"))
ANY_LINK = Selector("a")
PAGE_AXES = (TITLE, ARTICLE)

TOPIC_A = RuleSet(
    "topic_a",
    ("queaux", "th(ing|er)ly", "[e|é]chan", "ciónes", "gelich"),
    ("casino", "@mail[0-9]?", "[0-9]{16}"),
)
# Rules in which the longest match is not that of the first alternative.
TOPIC_C = RuleSet("topic_c", ("(th|the|there)(a|at|ation)?", "(q|qu|que)*aux"), ("(a|an|and)+t",))
# Rules with named classes, the last of each list with more than one way to match.
TOPIC_D = RuleSet(
    "topic_d",
    (
        "[[:alpha:]]{9,12}[[:punct:]]",
        "[[:space:]](a|an|and)+t",
        "[[:word:]]+[[:space:]]th?[[:lower:]]+ly",
    ),
    ("[[:space:]]q[[:alnum:]]{3}[^[:alnum:]]", "[[:blank:]]+[[:upper:]]+[[:digit:]]+"),
)
# The rules of topic C as a file.
RULE_FILE = '(["(th|the|there)(a|at|ation)?", "(q|qu|que)*aux"], ["(a|an|and)+t"])'
TOPIC_B = RuleSet("topic_b", ("licen[s|c]e", "queaux"), ("@mail[0-9]?",))

_SYLLABLES = [c + v for c in "bcdfghklmnprstvz" for v in "aeiou"]


def many_rules() -> tuple[RuleSet, RuleSet]:
    """5,000 rules in two sets, made of syllables."""
    n = len(_SYLLABLES)
    made = [
        f"{a}{b}({_SYLLABLES[(i + j) % n]}|{_SYLLABLES[(i + 3 * j + 7) % n]})"
        for j, b in enumerate(_SYLLABLES)
        for i, a in enumerate(_SYLLABLES)
    ]
    first, second = tuple(made[:2500]), tuple(made[2500:5000])
    return RuleSet("many_a", first[:2000], first[2000:]), RuleSet("many_b", second[:2000], second[2000:])


ADS = "https://ads.example.org/"


def minutes_ago(minutes: Column) -> Column:
    return timestamp(AS_OF) - F.expr("INTERVAL '1' MINUTE") * minutes


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a status that depends on their host."""
    url = F.col("url")
    return pages(spark, sf_dir).withColumn(
        "status",
        F.when(url.contains("spam-farm"), 404).when(url.contains("cheap-pills"), 500).otherwise(200),
    )


def url_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue of all page urls; some count as visited."""
    return pages(spark, sf_dir).select(
        "url",
        minutes_ago(F.col("page_id") * 17).alias("ts"),
        F.when(F.col("url").endswith(".html"), 1).otherwise(0).alias("visited"),
    )


def content_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected content: the raw title of every page without transport security."""
    return (
        pages(spark, sf_dir)
        .filter(F.col("url").startswith("http://"))
        .select(
            "url",
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("content"),
            minutes_ago(F.col("page_id") * 17).alias("ts"),
        )
    )


def titles_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of all pages, one row a page: its raw title."""
    return pages(spark, sf_dir).select(
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("content"),
        minutes_ago(F.col("page_id") * 17).alias("ts"),
    )


def ad_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as collected ads: id, url, content, time."""
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit(f"{ADS}a/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content"),
        minutes_ago(F.col("doc_id") * 7).alias("ts"),
    )


def signed_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_texts(spark, sf_dir).select(
        "doc_id", "url", "ts", signature(F.col("content")).alias("sig")
    )


def even(ads: DataFrame) -> DataFrame:
    return ads.filter(F.col("doc_id") % 2 == 0)


def odd(ads: DataFrame) -> DataFrame:
    return ads.filter(F.col("doc_id") % 2 != 0)


def ad_pages(ads: DataFrame) -> DataFrame:
    """Ads as pages in the markup that the default axes select from.

    Every axis finds something in some ads: an attribute table in those with an even id,
    and the text of the second site in every third. Neither has letters, so that copies
    keep equal signatures.
    """
    doc_id = F.col("doc_id").cast("string")
    table = F.concat(
        F.lit("<table id='attributeTable'><tr><td>2024</td><td> "),
        doc_id,
        F.lit(" (+) </td></tr></table>"),
    )
    second = F.concat(F.lit("<div class='col-md-8'>+48 <i>"), doc_id, F.lit(" 000</i></div>"))
    escaped = F.replace(
        F.replace("content", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")
    )
    return ads.select(
        F.col("doc_id").alias("page_id"),
        "url",
        F.concat(
            F.lit("<html><head><title>Listing</title></head><body><span class='pre'>"),
            escaped,
            F.lit("</span>"),
            F.when(F.col("doc_id") % 2 == 0, table).otherwise(""),
            F.when(F.col("doc_id") % 3 == 0, second).otherwise(""),
            F.lit("</body></html>"),
        ).alias("html"),
    )


def listing_pages(ads: DataFrame) -> DataFrame:
    """A listing page for every ad, in the markup of the default link selectors."""
    doc_id = F.col("doc_id").cast("string")
    return ads.select(
        F.concat(F.lit(f"{ADS}list/"), doc_id).alias("url"),
        F.concat(
            F.lit('<div class="wide asset-list"><p><a href="../a/'), doc_id, F.lit('">ad</a></div>')
        ).alias("html"),
    )
