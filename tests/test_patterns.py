import itertools
import random
import re

import pytest
from adloom.functions import patterns as P
from adloom.functions.patterns import Pattern, fold
from adloom.operators.classify import classify, classify_many, liked_rows, matches, negatives, verdict_counts
from adloom.sources.rules import RuleSet, load_rules, rules_table
from pyspark.sql import functions as F


def first_matches(spark, pattern, texts, gated=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    folded = fold(F.col("t")) if gated else None
    found = Pattern.compile(pattern).found(F.col("t"), folded)
    return [r.m for r in df.select("i", found.alias("m")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "pattern, text, expected",
    [
        ("(ab|abcd)", "xabcd", "abcd"),
        ("a?(ab)?", "ab", "ab"),
        ("(a|ab)(c|bcd)", "abcd", "abcd"),
        ("x|xy|xyz", "xyz", "xyz"),
        ("Lip(ki|kach|ek)", "w LIPKACH", "LIPKACH"),
        ("świerkła", "ul. ŚWIERKŁA 3", "ŚWIERKŁA"),
        ("[n|ń]", "|", "|"),
        ("[^dz]? umowy", "bez umowy", " umowy"),
        ("[^dz]? umowy", "na\n umowy", " umowy"),
        ("a.c", "a\nc", None),
        ("a[^x]c", "a\nc", None),
        ("a[^X]c", "axc", None),
        ("^b$", "a\nb\nc", "b"),
        ("^$", "a\n", ""),
        ("z*", "abc", ""),
        ("a{2,3}", "aaaa", "aaa"),
        ("a{2}b", "aab", "aab"),
        (r"\.", "a.b", "."),
        (r"\d", "5d", "d"),
        ("[[:alpha:]]+", "12ąb3", "ąb"),
        ("[]a]+", "x]a]", "]a]"),
        ("[a-c-]+", "x-b-d", "-b-"),
        (r"[\w]", "a\\", "\\"),
        ("[a&&b]", "&", "&"),
        ("a(b|)c", "ac", "ac"),
        (r"\<cat", "a cat", "cat"),
        ("casino", "CAſINO", "CAſINO"),
        ("kilo", "\u212aILO", "\u212aILO"),
        ("hit", "h\u0131t", "h\u0131t"),
        ("hit", "H\u0130T", "H\u0130T"),
    ],
)
def test_dialect(spark, pattern, text, expected):
    assert first_matches(spark, pattern, [text]) == [expected]


@pytest.mark.parametrize("pattern", ["(a", "a)", "[a", "*a", "a{3,1}", "a\\", "[[:nope:]]"])
def test_malformed_patterns(pattern):
    with pytest.raises(ValueError):
        Pattern.compile(pattern)


def test_open_ended_patterns_match_longest(spark):
    texts = ["".join(t) for n in range(6) for t in itertools.product("abc", repeat=n)]
    for pattern in ["(a|ab)*c*", "(a|ab){0,9}", "(b|bc)+", "(a|ab)(c|bcd)*", "(c|a*)(b|bc)*"]:
        expected = [leftmost_longest(pattern, t) for t in texts]
        assert first_matches(spark, pattern, texts) == expected, pattern


def test_more_shapes_than_are_written_out(spark):
    pattern = "(" + "|".join("x" + "y" * n for n in range(300)) + ")(z|zz)?"
    assert first_matches(spark, pattern, ["aXyyyzz", "x", "q"]) == ["Xyyyzz", "x", None]


def leftmost_longest(pattern, text):
    exact = re.compile(pattern)
    for start in range(len(text) + 1):
        for end in range(len(text), start - 1, -1):
            if exact.fullmatch(text, start, end):
                return text[start:end]
    return None


def test_random_finite_patterns_match_longest(spark):
    rng = random.Random(11)

    def piece(depth):
        kind = rng.random()
        if kind < 0.55 or depth == 0:
            atom = rng.choice(["a", "b", "c", "[ab]"])
        else:
            atom = "(" + "|".join(branch(depth - 1) for _ in range(rng.randint(1, 3))) + ")"
        return atom + rng.choice(["", "", "", "?", "{1,2}", "*", "+"])

    def branch(depth):
        return "".join(piece(depth) for _ in range(rng.randint(1, 3)))

    texts = ["".join(t) for n in range(5) for t in itertools.product("abc", repeat=n)]
    for _ in range(15):
        pattern = branch(2)
        expected = [leftmost_longest(pattern, t) for t in texts]
        assert first_matches(spark, pattern, texts) == expected, pattern


def test_gate_loses_no_match(spark):
    rng = random.Random(5)
    odd = {"i": "iI\u0130\u0131", "s": "sS\u017f", "k": "kK\u212a", "å": "åÅ\u212b"}
    words = ["kiosk", "basik ś", "łąkowa", "å sik", "mississippi"]
    for word in words:
        texts = [
            "\ufb01ß" + "".join(rng.choice(odd.get(c, c + c.upper())) for c in word) + "σς"
            for _ in range(60)
        ]
        plain = first_matches(spark, word, texts, gated=False)
        assert first_matches(spark, word, texts) == plain
        assert all(m is not None for m in plain)


def texts(spark, *rows):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "url string, content string")


def judge(spark, rules, *rows):
    judged = classify(texts(spark, *rows), rules).orderBy("url").collect()
    return [(r.verdict, r.matches) for r in judged]


def test_verdicts(spark):
    rules = RuleSet("r", ("alpha", "beta"), ("gamma", "delta"))
    assert judge(
        spark, rules, "Beta and ALPHA", "gamma only", "alpha gamma DELTA", "", None, "delta, beta, delta"
    ) == [
        ("liked", ["ALPHA", "Beta"]),
        ("unmatched", []),
        ("disliked", ["gamma", "DELTA"]),
        ("unmatched", []),
        ("unmatched", []),
        ("disliked", ["delta"]),
    ]


def test_pattern_on_both_lists_rejects(spark):
    assert judge(spark, RuleSet("r", ("x",), ("x",)), "x") == [("disliked", ["x"])]


def test_empty_match_is_a_match(spark):
    assert judge(spark, RuleSet("r", ("q*",), ()), "abc") == [("liked", [""])]
    assert judge(spark, RuleSet("r", (), ("x",)), "x") == [("unmatched", [])]


def test_several_rule_sets_and_summaries(spark):
    first, second = RuleSet("one", ("a",), ("b",)), RuleSet("two", ("b",))
    judged = classify(texts(spark, "a", "ab", "c"), first, second)
    got = {(r.url, r.rule_set): r.verdict for r in judged.collect()}
    assert got == {
        ("0", "one"): "liked", ("0", "two"): "unmatched", ("1", "one"): "disliked",
        ("1", "two"): "liked", ("2", "one"): "unmatched", ("2", "two"): "unmatched",
    }
    counts = {(r.rule_set, r.verdict): r.n for r in verdict_counts(judged).collect()}
    assert counts["two", "unmatched"] == 2 and sum(counts.values()) == 6
    assert {(r.url, r.note) for r in liked_rows(judged).collect()} == {("0", "a"), ("1", "b")}
    assert {(r.url, r.rule_set, tuple(r.matches)) for r in negatives(judged).collect()} == {
        ("0", "two", ()), ("1", "one", ("b",)), ("2", "one", ()), ("2", "two", ()),
    }


def test_plan_reads_dislikes_only_after_a_like(spark):
    judged = classify(texts(spark, "a"), RuleSet("r", ("like",), ("dislike",)))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan


def test_matches_without_gate(spark):
    found = matches(F.col("content"), RuleSet("r", ("a", "b", "c")).compiled("like"))
    assert texts(spark, "cab").select(found.alias("m")).first().m == ["a", "b", "c"]


def test_rule_files(spark, tmp_path):
    path = tmp_path / "x.rules"
    path.write_text('(["W\\322ocha", "a\\"b", "x\\&y", "tab\\t", "\\x105"],\n ["z[b|c]\\\\."])\n', "utf8")
    rules = load_rules(spark, str(path), "x")
    assert rules.likes == ("Włocha", 'a"b', "xy", "tab\t", "ą")
    assert rules.dislikes == ("z[b|c]\\.",)
    rows = rules_table(spark, rules).orderBy("polarity", "pos").collect()
    assert [(r.polarity, r.pos) for r in rows] == [("dislike", 0)] + [("like", n) for n in range(5)]


@pytest.mark.parametrize(
    "text", ["", "[]", '(["a"])', '(["a"] ["b"])', '(["a",],[])', '(["a"],["b"]) x', '(["\\q"],[])', "(['a'],[])"]
)
def test_malformed_rule_files(text):
    with pytest.raises(ValueError):
        RuleSet.parse("r", text)


def test_empty_lists_parse():
    assert RuleSet.parse("r", "([],[])") == RuleSet("r", (), ())


SIGNS = "aZéÉßñ0٣_ \t\n\x0b\f\r\x1c\x85\xa0\u2003\u3000-.!~|`^\x00\x7f\x80µŁłΩω漢"


@pytest.mark.parametrize("name", ["alnum", "alpha", "blank", "cntrl", "digit", "graph", "lower", "print",
                                  "punct", "space", "upper", "word", "xdigit"])
def test_both_engines_take_classes_for_the_same_characters(spark, name):
    texts = [f"{sign}x" for sign in SIGNS]
    for plain in (f"[[:{name}:]]x", f"[^[:{name}:]]x"):
        # The same with a choice that can't be written out.
        assert first_matches(spark, plain, texts) == first_matches(spark, f"{plain}(x|xy)*", texts)


@pytest.mark.parametrize("anchored", [r"\<x", r"x\>", r"\bx", r"x\b", r"\Bx", r"x\B", r"\`x", r"x\'"])
def test_both_engines_put_anchors_at_the_same_places(spark, anchored):
    texts = [t for sign in SIGNS for t in (f"{sign}x", f"x{sign}", f"{sign}x{sign}")] + ["x"]
    either = first_matches(spark, f"{anchored}(q|qz)*", texts)
    assert first_matches(spark, anchored, texts) == either
    assert either[-1] == "x" or "B" in anchored


def test_space_that_is_not_ascii(spark):
    texts = ["\xa0ab xx ab", "\xa0a\tab"]
    assert first_matches(spark, "[[:space:]](a|ab)+", texts) == [" ab", "\tab"]
    assert first_matches(spark, r"\<wiat", ["świat wiat"]) == ["wiat"]


def test_many_rules_equal_one_by_one(spark):
    rng = random.Random(4)
    syllables = [c + v for c in "bdkt" for v in "aeo"]
    texts = [" ".join("".join(rng.choices(syllables, k=4)) for _ in range(40)) for _ in range(60)]
    texts += ["", None, "BADE kilo", "a\u212aILO x"]
    made = ["".join(rng.choices(syllables, k=2)) + f"({a}|{b}d?)" for a in syllables for b in syllables]
    odd = ("kilo", "(ba|bad)+e", "x", "d?", "[bk]ade|tobeka", "(tobe|tobeka)+t?")
    sets = (RuleSet("one", tuple(made[:60]) + odd, tuple(made[60:75])), RuleSet("two", tuple(made[75:])), RuleSet("none", ()))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    want = classify(df, *sets, text="t").collect()
    got = classify_many(df, sets, "i", "t").collect()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({r.verdict for r in got}) == 3
    assert classify_many(df.limit(0), sets, "i", "t").count() == 0
    plan = classify_many(df, sets, "i", "t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_text_is_repeated_only_for_the_letters_of_rules(spark):
    """Sequences with letters that no rule has at their places are left out at once."""
    wanted = ["bade", "ba]-", "^\\ &", "é\nab"]
    texts = ["xbadebade" + "lorem ipsum " * 50, "ba]-^\\ &é\nab\U0001f600bade", "bad e", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(P.grams(F.col("t"), wanted)).collect()
    assert [sorted(r[0]) if r[0] is not None else None for r in rows] == [
        ["bade"], sorted(wanted), [], [], None
    ]


def test_rules_are_looked_up_by_all_that_their_matches_must_hold():
    rule = Pattern.compile("bade(ka|tu)")
    assert rule.factors == ("bade",) and rule.needles == ("badeka", "badetu")
    assert Pattern.compile("bade(ka|tu)*").needles == ("bade",)
    assert Pattern.compile("b(a|e)").needles == Pattern.compile("b(a|e)").factors == ("ba", "be")
