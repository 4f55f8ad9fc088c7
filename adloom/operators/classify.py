"""Verdicts of like and dislike rules over texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import patterns as P
from adloom.functions.text import content_hash
from adloom.sources.rules import RuleSet

LIKED, DISLIKED, UNMATCHED = "liked", "disliked", "unmatched"


def matches(text: Column, patterns: Sequence[P.Pattern], folded: Column | None = None) -> Column:
    """First match of every pattern that has one, in pattern order."""
    found = F.array(*(p.found(text, folded) for p in patterns))
    return F.array_compact(found.cast("array<string>"))


def classify(df: DataFrame, *rule_sets: RuleSet, text: str = "content") -> DataFrame:
    """Rows with ``rule_set``, ``verdict`` and ``matches``, one row per rule set.

    Without a like the text is unmatched; with likes only it is liked and
    ``matches`` are the likes; with both it is disliked and ``matches`` are the
    dislikes. Dislikes are looked up only in texts with a like.
    """
    content, folded = F.col(text), F.col("_folded")
    # Steps stay apart so that each is computed once and then referred to.
    liked = df.withColumn("_folded", P.fold(content)).withColumns(
        {
            f"_likes{n}": matches(content, rules.compiled("like"), folded)
            for n, rules in enumerate(rule_sets)
        }
    )
    judged = liked.withColumns(
        {
            f"_dislikes{n}": F.when(
                F.size(f"_likes{n}") > 0, matches(content, rules.compiled("dislike"), folded)
            ).otherwise(F.array().cast("array<string>"))
            for n, rules in enumerate(rule_sets)
        }
    )
    verdicts = [
        _verdict(rules.name, F.col(f"_likes{n}"), F.col(f"_dislikes{n}"))
        for n, rules in enumerate(rule_sets)
    ]
    # A generator even for one rule set: filters on the verdict stay above it, where
    # they would otherwise be pushed below and match the patterns once more.
    result = judged.withColumn("_verdict", F.explode(F.array(*verdicts)))
    return result.select(*df.columns, "_verdict.*")


def _verdict(name: str, likes: Column, dislikes: Column) -> Column:
    return F.struct(
        F.lit(name).alias("rule_set"),
        F.when(F.size(likes) == 0, UNMATCHED)
        .when(F.size(dislikes) == 0, LIKED)
        .otherwise(DISLIKED)
        .alias("verdict"),
        F.when(F.size(likes) == 0, likes)
        .when(F.size(dislikes) == 0, likes)
        .otherwise(dislikes)
        .alias("matches"),
    )


def indexed_matches(
    df: DataFrame, rule_sets: Sequence[RuleSet], key: str, text: str = "content"
) -> DataFrame:
    """Matches of any number of rules: ``key``, ``set_no``, ``polarity``, ``pos``, ``match``.

    Every match of a rule contains one of its factors. An inverted index from the first
    letters of factors to rules is joined with the letter sequences of each text, so that a
    text is only compared with rules of which it has a sequence, and then only where it has
    the whole factor. Rules without such a factor are tried on every text.
    """
    spark = df.sparkSession
    listed = [
        (n, polarity, pos, pattern)
        for n, rules in enumerate(rule_sets)
        for polarity in ("like", "dislike")
        for pos, pattern in enumerate(rules.compiled(polarity))
    ]
    told = [(len(p.needles) > 0 and min(map(len, p.needles)) >= P.GRAM, *rule, p) for *rule, p in listed]
    rows = [
        (gram, n, polarity, pos, p.java, [f for f in p.needles if f[: P.GRAM] == gram], p.open_ended)
        for indexed, n, polarity, pos, p in told
        if indexed
        for gram in sorted({f[: P.GRAM] for f in p.needles})
    ]
    narrow = df.select(key, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    folded = narrow.withColumn("_folded", P.fold(F.col("_text")))
    found = []
    if rows:
        # As long as the rules, which the driver holds.
        index = F.broadcast(spark.createDataFrame(rows, INDEX))
        # Most sequences of no rule go before the text is repeated for each of the others.
        wanted = sorted({row[0] for row in rows})
        grams = folded.withColumn("_gram", F.explode(P.grams(F.col("_folded"), wanted)))
        # The substring test comes first, since patterns are costly to compile for each row.
        whole = F.exists("_factors", lambda factor: F.col("_folded").contains(factor))
        hit = F.when(whole, F.rlike("_text", F.col("_java"))).otherwise(False)
        hits = grams.join(index, "_gram").filter(hit)
        simple = F.expr("regexp_extract(_text, _java, 0)")
        rule = ("set_no", "polarity", "pos")
        plain = hits.filter("_open IS NULL").select(key, *rule, simple.alias("match"))
        found.append(plain)
        if any(p.open_ended is not None for *_, p in told):
            resolved = P.longest_of("_text", "_open").alias("match")
            found.append(hits.filter("_open IS NOT NULL").select(key, *rule, resolved))
    rest = [told_rule for told_rule in told if not told_rule[0]]
    if rest:
        text_column, folded_column = F.col("_text"), F.col("_folded")
        each = F.array(
            *(
                F.struct(
                    F.lit(n).alias("set_no"),
                    F.lit(polarity).alias("polarity"),
                    F.lit(pos).alias("pos"),
                    p.found(text_column, folded_column).alias("match"),
                )
                for _, n, polarity, pos, p in rest
            )
        )
        tried = folded.select(key, F.explode(each).alias("_one")).select(key, "_one.*")
        found.append(tried.filter("match IS NOT NULL"))
    if not found:
        return narrow.limit(0).select(key, F.lit(0).alias("set_no"), F.lit("").alias("polarity"),
                                      F.lit(0).alias("pos"), F.lit("").alias("match"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.distinct()


#: Index rows: letters, the rule, its pattern, and its factors that begin with the letters.
INDEX = (
    "_gram string, set_no int, polarity string, pos int, _java string, _factors array<string>, _open string"
)


def classify_many(
    df: DataFrame, rule_sets: Sequence[RuleSet], key: str, text: str = "content"
) -> DataFrame:
    """As :func:`classify`, for thousands of rules; ``key``, never null, tells rows apart."""
    found = indexed_matches(df, rule_sets, key, text)
    one = F.struct("set_no", "polarity", "pos", "match")
    # A text has as many matches as there are rules at most.
    found = found.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_found"))
    joined = df.join(found, key, "left")

    def of(n: int, polarity: str) -> Column:
        mine = F.filter("_found", lambda m: (m.set_no == n) & (m.polarity == polarity))
        matched = F.transform(mine, lambda m: m.match)
        return F.coalesce(matched, F.array().cast("array<string>"))

    verdicts = [
        _verdict(rules.name, of(n, "like"), of(n, "dislike")) for n, rules in enumerate(rule_sets)
    ]
    result = joined.withColumn("_verdict", F.explode(F.array(*verdicts)))
    return result.select(*df.columns, "_verdict.*")


def liked_rows(judged: DataFrame, text: str = "content") -> DataFrame:
    """Liked texts with their hash and ``note``, the matches joined by a space."""
    return judged.filter(F.col("verdict") == LIKED).select(
        *(c for c in judged.columns if c not in ("verdict", "matches")),
        content_hash(F.col(text)).alias("content_hash"),
        F.array_join("matches", " ").alias("note"),
    )


def negatives(judged: DataFrame) -> DataFrame:
    """Rejected texts: ``url`` and what rejected them, nothing if unmatched."""
    return judged.filter(F.col("verdict") != LIKED).select("rule_set", "url", "matches")


def verdict_counts(judged: DataFrame) -> DataFrame:
    """Texts scanned per rule set and verdict."""
    return judged.groupBy("rule_set", "verdict").agg(F.count(F.lit(1)).alias("n"))
