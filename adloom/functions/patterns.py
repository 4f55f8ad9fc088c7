"""Rule patterns: POSIX extended syntax expressed for Spark's regex functions.

Rules are matched case-insensitively, ``.`` and negated brackets stop at newlines,
and of all matches at the leftmost place the longest counts. Spark's engine takes
the first alternative instead, so patterns with a small set of shapes are written out
as alternatives in order of falling length. For other patterns with a choice the engine
only tells which texts match, and an engine with the longest-match rule reads those.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode case folding, line mode, and newline as the only line end.
FLAGS = "(?iumd)"
# Shapes that are written out; more of them are resolved on matched texts instead.
MAX_SHAPES = 256
# One common literal of this length is selective enough; otherwise the texts that a
# match can be made of are told apart, up to a number of them.
GOOD_FACTOR, MIN_FACTOR = 4, 2
MAX_TEXTS = 8
#: Letters of a factor by which rules are looked up.
GRAM = 4
GAP = "\0"

_BOUND = re.compile(r"\{(\d+)(,(\d*))?\}")
_BRACKET = re.compile(r"\[(\^?)(\]?(?:\[:[a-z]+:\]|\[=.=\]|\[\..\.\]|[^\]])*)\]", re.DOTALL)
_BRACKET_ITEM = re.compile(r"\[:([a-z]+):\]|\[([.=])(.)\2\]|(.)-(?=.)(.)|(.)", re.DOTALL)

# Named bracket classes, and escapes that are not plain characters.
# Written out, so that every engine takes them for the same characters.
CLASSES = {
    "alnum": r"\p{L}\p{N}",
    "alpha": r"\p{L}",
    "blank": r" \t",
    "cntrl": r"\x00-\x1f\x7f",
    "digit": "0-9",
    "graph": r"\x21-\x7e",
    "lower": r"\p{Ll}\p{Lu}",
    "print": r"\x20-\x7e",
    "punct": r"\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e",
    "space": r" \t\n\x0b\f\r",
    "upper": r"\p{Ll}\p{Lu}",
    "word": r"\p{L}\p{N}_",
    "xdigit": "0-9A-Fa-f",
}
_WORD = rf"[{CLASSES['word']}]"
ANCHORS = {
    "`": r"(?<![\s\S])",
    "'": r"(?![\s\S])",
    "b": rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    "B": rf"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
    "<": rf"(?<!{_WORD})(?={_WORD})",
    ">": rf"(?<={_WORD})(?!{_WORD})",
}
LINE_START, LINE_END = r"(?<![^\n])", r"(?![^\n])"


def quote(char: str) -> str:
    if char.isascii() and not char.isalnum() and char not in " \n\t_":
        return "\\" + char
    return char


@dataclass
class Shape:
    """A translated part: its regex, its fixed-width forms if there are few, and the
    texts it matches, where ``GAP`` stands for anything. ``texts`` tells choices
    apart, ``plain`` is one text with gaps for them."""

    java: str
    forms: list[tuple[int, str]] | None
    texts: tuple[str, ...] = (GAP,)
    plain: str = GAP


def _product(left: list | None, right: list | None) -> list | None:
    if left is None or right is None or len(left) * len(right) > MAX_SHAPES:
        return None
    return [(a + b, x + y) for (a, x), (b, y) in itertools.product(left, right)]


class _Reader:
    """One left-to-right pass over a pattern."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at = pattern, 0
        self.alternatives, self.variable = False, 0

    def alternation(self) -> Shape:
        branches = [self.branch()]
        while self.pattern.startswith("|", self.at):
            self.at += 1
            self.alternatives = True
            branches.append(self.branch())
        if len(branches) == 1:
            return branches[0]
        forms = None
        if all(b.forms is not None for b in branches):
            forms = [form for b in branches for form in b.forms]
        texts = tuple(text for b in branches for text in b.texts)
        return Shape("(?:" + "|".join(b.java for b in branches) + ")", forms, texts)

    def branch(self) -> Shape:
        java, forms, texts, plain = "", [(0, "")], ("",), ""
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            piece = self.piece()
            java += piece.java
            plain += piece.plain
            forms = _product(forms, piece.forms)
            added = piece.texts if len(texts) * len(piece.texts) <= MAX_TEXTS else (GAP,)
            texts = tuple(dict.fromkeys(left + right for left in texts for right in added))
        return Shape(java, forms, texts, plain)

    def piece(self) -> Shape:
        shape = self.atom()
        while self.at < len(self.pattern):
            bound = _BOUND.match(self.pattern, self.at)
            sign = self.pattern[self.at]
            if bound:
                low = int(bound[1])
                high = low if bound[2] is None else int(bound[3]) if bound[3] else None
                self.at = bound.end()
            elif sign in "*+?":
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
                self.at += 1
            else:
                break
            if high is not None and high < low:
                raise ValueError(f"bad repetition in pattern {self.pattern!r}")
            shape = self.repeat(shape, low, high)
        return shape

    def repeat(self, shape: Shape, low: int, high: int | None) -> Shape:
        self.variable += low != high
        forms = None
        if high is not None and high <= MAX_SHAPES:
            forms, power = [], [(0, "")]
            for count in range(high + 1):
                if count >= low and power is not None and forms is not None:
                    forms = forms + power
                power = _product(power, shape.forms)
                if power is None and count < high:
                    forms = None
                    break
            if forms is not None and len(forms) > MAX_SHAPES:
                forms = None
        upper = "" if high is None else high
        texts = ("", *shape.texts) if (low, high) == (0, 1) else (GAP,)
        return Shape(f"(?:{shape.java}){{{low},{upper}}}", forms, texts)

    def atom(self) -> Shape:
        char = self.pattern[self.at]
        self.at += 1
        if char == "(":
            inner = self.alternation()
            if not self.pattern.startswith(")", self.at):
                raise ValueError(f"unclosed group in pattern {self.pattern!r}")
            self.at += 1
            return Shape(f"(?:{inner.java})", inner.forms, inner.texts, inner.plain)
        if char == "[":
            return self.bracket()
        if char == ".":
            return Shape(r"[^\n]", [(1, r"[^\n]")])
        if char in "^$":
            anchor = LINE_START if char == "^" else LINE_END
            return Shape(anchor, [(0, anchor)], ("",), "")
        if char in "*+?":
            raise ValueError(f"nothing to repeat in pattern {self.pattern!r}")
        if char == "\\":
            if self.at == len(self.pattern):
                raise ValueError(f"pattern {self.pattern!r} ends in a backslash")
            char = self.pattern[self.at]
            self.at += 1
            if char in ANCHORS:
                return Shape(ANCHORS[char], [(0, ANCHORS[char])], ("",), "")
        return Shape(quote(char), [(1, quote(char))], (char,), char)

    def bracket(self) -> Shape:
        found = _BRACKET.match(self.pattern, self.at - 1)
        if not found or not found[2]:
            raise ValueError(f"unclosed bracket in pattern {self.pattern!r}")
        self.at = found.end()
        items, chars = [], []
        for item in _BRACKET_ITEM.finditer(found[2]):
            named, _, single, first, last, plain = item.groups()
            if named:
                if named not in CLASSES:
                    raise ValueError(f"unknown class {named!r} in pattern {self.pattern!r}")
                items.append(CLASSES[named])
            elif first:
                items.append(f"{quote(first)}-{quote(last)}")
            else:
                items.append(quote(single or plain))
                chars.append(single or plain)
        body = "[" + ("^\\n" if found[1] else "") + "".join(items) + "]"
        listed = not found[1] and len(chars) == len(items)
        return Shape(body, [(1, body)], tuple(chars) if listed else (GAP,))


@dataclass(frozen=True)
class Pattern:
    """A rule pattern ready for Spark; every match contains one of ``factors``."""

    source: str
    java: str
    factors: tuple[str, ...]
    #: Where the longest match can't be written out: the pattern that resolves it.
    open_ended: str | None = None
    #: The same as ``factors``, but the longest ones, however many they are.
    needles: tuple[str, ...] = ()

    @staticmethod
    def compile(source: str) -> Pattern:
        reader = _Reader(source)
        shape = reader.alternation()
        if reader.at != len(source):
            raise ValueError(f"unbalanced group in pattern {source!r}")
        java, exact = shape.java, True
        if reader.alternatives or reader.variable > 1:
            exact = shape.forms is not None
            if exact:
                widest = sorted(dict.fromkeys(shape.forms), key=lambda form: -form[0])
                java = "|".join(form for _, form in widest)
        open_ended = None if exact else shape.java
        return Pattern(source, FLAGS + java, _factors(shape, GOOD_FACTOR), open_ended, _factors(shape))

    def found(self, text: Column, folded: Column | None = None) -> Column:
        """The first match in its original case, or null.

        ``folded`` is :func:`fold` of the text: a substring test on it spares
        most texts the regex.
        """
        hit = text.rlike(self.java)
        if folded is not None and self.factors:
            gate = functools.reduce(operator.or_, (folded.contains(f) for f in self.factors))
            hit = gate & hit
        if self.open_ended is not None:
            # Only texts with a match leave the JVM.
            return _longest(self.open_ended)(F.when(hit, text))
        return F.when(hit, F.regexp_extract(text, self.java, 0))


def _longest(java: str) -> Callable[[Column], Column]:
    """The leftmost-longest match of texts that are known to have one."""

    @F.arrow_udf("string")
    def resolve(texts: pa.Array) -> pa.Array:
        return pa.array((_first_longest(java, text.as_py()) for text in texts), pa.string())

    return resolve


def longest_of(text: str, java: str) -> Column:
    """The same with the pattern in a column."""

    @F.arrow_udf("string")
    def resolve(texts: pa.Array, patterns: pa.Array) -> pa.Array:
        both = zip(patterns.to_pylist(), texts.to_pylist())
        return pa.array((_first_longest(p, t) for p, t in both), pa.string())

    return resolve(text, java)


def _first_longest(java: str, text: str | None) -> str | None:
    found = _exact(java).search(text) if text is not None else None
    return found[0] if found else None


@functools.lru_cache(maxsize=10_000)
def _exact(java: str):
    import regex

    return regex.compile(java, regex.POSIX | regex.IGNORECASE | regex.MULTILINE)


def grams(folded: Column, wanted: Sequence[str]) -> Column:
    """The distinct runs of ``GRAM`` characters of a text, overlapping ones included, that
    have at each place a character that some wanted run has there."""
    runs = "".join("[" + "".join(map(quote, sorted(set(chars)))) + "]" for chars in zip(*wanted))
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?=({runs}))"), F.lit(1)))


def _factors(shape: Shape, enough: int | None = None) -> tuple[str, ...]:
    """Texts one of which is in every match; nothing if there are none of use. One text of
    the length that is enough is taken alone."""
    common = max(_foldable(shape.plain), key=len, default="")
    if enough is None or len(common) < enough:
        longest = [max(_foldable(text), key=len, default="") for text in shape.texts]
        if len(longest) <= MAX_TEXTS and min(map(len, longest)) > max(len(common), 1):
            return tuple(
                f for f in dict.fromkeys(longest) if not any(g in f for g in longest if g != f)
            )
    return (common,) if len(common) >= MIN_FACTOR else ()


def _foldable(text: str) -> list[str]:
    """Lower-case stretches of a literal whose letters have one simple case pair."""

    def simple(char: str) -> bool:
        lower = char.lower()
        return (
            char != GAP
            and ord(char) < 0x250
            and len(lower) == len(char.upper()) == 1
            and lower.upper().lower() == lower == char.upper().lower()
            and char != "\u00b5"
        )

    stretches = itertools.groupby(text, simple)
    return ["".join(chars).lower() for good, chars in stretches if good]


# Characters that match a plain letter without it being their lower case.
_ODD_CASES = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"))


def fold(text: Column) -> Column:
    """Case-folded text that contains the factor of any pattern matching the text."""
    for odd, plain in _ODD_CASES:
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)
