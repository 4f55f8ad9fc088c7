"""Rule files: a pair of string lists, ``(["like", ...], ["dislike", ...])``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from adloom.functions.patterns import Pattern
from adloom.schemas import RULES

_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.DOTALL)
_SHAPE = re.compile(r"\s*\(\s*(\[[\s#,]*\])\s*,\s*(\[[\s#,]*\])\s*\)\s*\Z")
_LIST = re.compile(r"\[\s*(?:#\s*(?:,\s*#\s*)*)?\]\Z")
_ESCAPE = re.compile(r"\\(?:(\d+)|x([0-9A-Fa-f]+)|o([0-7]+)|(&)|(\s+)\\|([abfnrtv\"\\']))", re.DOTALL)

# One-letter escapes of the literal syntax.
_SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _unescape(body: str) -> str:
    def one(match: re.Match) -> str:
        decimal, hexa, octal, nothing, gap, letter = match.groups()
        if decimal or hexa or octal:
            return chr(int(decimal) if decimal else int(hexa, 16) if hexa else int(octal, 8))
        return "" if nothing or gap else _SIMPLE.get(letter, letter)

    if "\\" in _ESCAPE.sub("", body):
        raise ValueError(f"unknown escape in rule string {body!r}")
    return _ESCAPE.sub(one, body)


@dataclass(frozen=True)
class RuleSet:
    """Named like and dislike patterns, in file order."""

    name: str
    likes: tuple[str, ...]
    dislikes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self.compiled("like"), self.compiled("dislike")

    def compiled(self, polarity: str) -> list[Pattern]:
        sources = self.likes if polarity == "like" else self.dislikes
        return [Pattern.compile(source) for source in sources]

    @staticmethod
    def parse(name: str, text: str) -> RuleSet:
        """Read the file format; anything else is a ValueError."""
        strings = [_unescape(m[1]) for m in _STRING.finditer(text)]
        shape = _SHAPE.match(_STRING.sub("#", text))
        if not shape or not all(_LIST.match(part) for part in shape.groups()):
            raise ValueError(f"rule set {name!r} is not a pair of string lists")
        n_likes = shape[1].count("#")
        return RuleSet(name, tuple(strings[:n_likes]), tuple(strings[n_likes:]))


def load_rules(spark: SparkSession, path: str, name: str) -> RuleSet:
    """Read one rule file from any file system Spark reaches."""
    found = spark.read.text(path, wholetext=True).take(2)
    if len(found) != 1:
        raise ValueError(f"{path} must hold exactly one rule file")
    return RuleSet.parse(name, found[0].value)


def rules_table(spark: SparkSession, *rule_sets: RuleSet) -> DataFrame:
    """Rule sets as rows, for storage and for reporting."""
    rows = [
        (rules.name, polarity, pos, pattern)
        for rules in rule_sets
        for polarity, patterns in (("like", rules.likes), ("dislike", rules.dislikes))
        for pos, pattern in enumerate(patterns)
    ]
    return spark.createDataFrame(rows, RULES)
