"""Text expressions: line clean-up, letters-only form and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tab to carriage return, and the Unicode space separators.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)


def clean_lines(text: Column) -> Column:
    """Trimmed non-blank lines of a text, as an array."""
    trimmed = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.filter(trimmed, lambda line: line != "")


def terminate(lines: Column) -> Column:
    """Lines as one text in which every line ends with a newline."""
    return F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")


def normalise_lines(text: Column) -> Column:
    return terminate(clean_lines(text))


def purify(text: Column) -> Column:
    """Letters only, case kept."""
    return F.regexp_replace(text, r"[^\p{L}]+", "")


def _present(text: Column) -> Column:
    """Null as empty text. A key that cannot be null is computed once: joins would
    otherwise compute it in a null filter first."""
    return F.coalesce(text, F.lit(""))


def signature(text: Column) -> Column:
    """Near-duplicate key: equal for texts with equal letters."""
    return F.md5(purify(_present(text)))


def content_hash(text: Column) -> Column:
    """Exact-duplicate key over the raw text."""
    return F.md5(_present(text))


def clip(text: Column, width: int) -> Column:
    """The first characters of a text, empty for null."""
    return F.coalesce(F.substring(text, 1, width), F.lit(""))
