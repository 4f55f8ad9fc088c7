"""URL expressions after RFC 3986: validity, resolution and authority prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# RFC 3986 appendix A, composed from its named rules. Percent escapes are checked
# apart by BROKEN_ESCAPE, so each rule is a flat character class: repeated groups
# would recurse once per character in the regex engine and fail on long URLs.
BROKEN_ESCAPE = "%(?![0-9A-Fa-f]{2})"
_PLAIN = r"A-Za-z0-9\-._~!$&'()*+,;=%"
_PCHAR = f"[{_PLAIN}:@]"
_PATH_CHARS = f"[{_PLAIN}:@/]*"
_SCHEME = r"[A-Za-z][A-Za-z0-9+\-.]*"
_H16 = "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_LS32 = f"(?:{_H16}:{_H16}|{_IPV4})"
_IPV6 = "|".join(
    [f"(?:{_H16}:){{6}}{_LS32}", f"::(?:{_H16}:){{5}}{_LS32}", f"(?:{_H16})?::(?:{_H16}:){{4}}{_LS32}"]
    + [
        f"(?:(?:{_H16}:){{0,{before}}}{_H16})?::(?:{_H16}:){{{3 - before + 1}}}{_LS32}"
        for before in (1, 2, 3, 4)
    ]
    + [
        f"(?:(?:{_H16}:){{0,5}}{_H16})?::{_H16}",
        f"(?:(?:{_H16}:){{0,6}}{_H16})?::",
    ]
)
_IP_LITERAL = rf"\[(?:{_IPV6}|[vV][0-9A-Fa-f]+\.[A-Za-z0-9\-._~!$&'()*+,;=:]+)\]"
_AUTHORITY = f"(?:[{_PLAIN}:]*@)?(?:{_IP_LITERAL}|[{_PLAIN}]*)(?::[0-9]*)?"
_AFTER_AUTHORITY = f"(?:/{_PATH_CHARS})?"
_ROOTED = f"/(?:{_PCHAR}{_PATH_CHARS})?"
_ROOTLESS = f"{_PCHAR}{_PATH_CHARS}"
_NO_SCHEME = f"[{_PLAIN}@]+(?:/{_PATH_CHARS})?"
_QUERY = rf"(?:\?[{_PLAIN}:@/?]*)?"
_FRAGMENT = f"(?:#[{_PLAIN}:@/?]*)?"
_HIER = f"(?://{_AUTHORITY}{_AFTER_AUTHORITY}|{_ROOTED}|{_ROOTLESS}|)"
_RELATIVE = f"(?://{_AUTHORITY}{_AFTER_AUTHORITY}|{_ROOTED}|{_NO_SCHEME}|)"

ABSOLUTE_URI = rf"\A{_SCHEME}:{_HIER}{_QUERY}\z"
URI = rf"\A{_SCHEME}:{_HIER}{_QUERY}{_FRAGMENT}\z"
URI_REFERENCE = rf"\A(?:{_SCHEME}:{_HIER}|{_RELATIVE}){_QUERY}{_FRAGMENT}\z"

# RFC 3986 appendix B. A part that is absent gives the empty string; a part that
# is present keeps its delimiter, so presence and emptiness stay apart.
_PARTS = r"\A([^:/?#]+:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?\z"
PART_NAMES = ("scheme", "authority", "path", "query", "fragment")


def _matches(url: Column, grammar: str) -> Column:
    return url.rlike(grammar) & ~url.rlike(BROKEN_ESCAPE)


def is_uri_reference(url: Column) -> Column:
    return _matches(url, URI_REFERENCE)


def is_uri(url: Column) -> Column:
    return _matches(url, URI)


def is_absolute_uri(url: Column) -> Column:
    """True for an absolute URI; one with a fragment does not count."""
    return _matches(url, ABSOLUTE_URI)


def with_parts(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """Add the five components of a URL column, each with its delimiter."""
    return df.withColumns(
        {
            prefix + name: F.regexp_extract(url, _PARTS, number)
            for number, name in enumerate(PART_NAMES, 1)
        }
    )


def _drop_last(stack: Column) -> Column:
    return F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 section 5.2.4 for a path that starts with a slash."""
    closed = F.regexp_replace(path, r"/(\.{1,2})\z", "/$1/")
    segments = F.split(F.substr(closed, F.lit(2)), "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda stack, segment: F.when(segment == ".", stack)
        .when(segment == "..", _drop_last(stack))
        .otherwise(F.concat(stack, F.array(segment))),
    )
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"))
    # Most paths have no dot segment and skip the walk.
    return F.when(path.contains("/."), resolved).otherwise(path)


def with_resolved(df: DataFrame, reference: str, base: str, name: str) -> DataFrame:
    """Add ``name``, the reference made absolute (RFC 3986 section 5.2).

    ``base`` is the prefix of base URL components from :func:`with_parts`, so that
    a page URL is taken apart once for all its links. Steps are separate columns
    because each is referred to several times by the next.
    """
    ref = {part: F.col(f"_ref_{part}") for part in PART_NAMES}
    own = {part: F.col(base + part) for part in PART_NAMES}
    has_scheme = ref["scheme"] != ""
    has_authority = has_scheme | (ref["authority"] != "")
    has_path = has_authority | (ref["path"] != "")
    has_query = has_path | (ref["query"] != "")
    merged = F.when(
        (own["authority"] != "") & (own["path"] == ""), F.concat(F.lit("/"), ref["path"])
    ).otherwise(F.concat(F.regexp_extract(own["path"], r"\A(?:[\s\S]*/)?", 0), ref["path"]))
    path = (
        F.when(has_authority | ref["path"].startswith("/"), ref["path"])
        .when(has_path, merged)
        .otherwise(own["path"])
    )
    stepped = with_parts(df, reference, "_ref_").withColumn("_path", path)
    rootless = F.when(
        F.col("_path").rlike(r"(?:\A|/)\.{1,2}(?:/|\z)"),
        F.substr(remove_dot_segments(F.concat(F.lit("/"), F.col("_path"))), F.lit(2)),
    ).otherwise(F.col("_path"))
    link = F.concat(
        F.when(has_scheme, ref["scheme"]).otherwise(own["scheme"]),
        F.when(has_authority, ref["authority"]).otherwise(own["authority"]),
        F.when(F.col("_path").startswith("/"), remove_dot_segments(F.col("_path"))).otherwise(
            rootless
        ),
        F.when(has_query, ref["query"]).otherwise(own["query"]),
        ref["fragment"],
    )
    return stepped.select(*df.columns, link.alias(name))


def resolve(df: DataFrame, reference: str, base: str, name: str) -> DataFrame:
    """Add ``name``: the reference column resolved against the base URL column."""
    based = with_parts(df, base, "_base_")
    return with_resolved(based, reference, "_base_", name).select(*df.columns, name)


def prefix(url: Column) -> Column:
    """``scheme://host`` without user info and port, or null."""
    found = F.regexp_replace(
        F.regexp_extract(url, rf"\A{_SCHEME}://[^/?#]*", 0),
        r"//(?:[^@/?#]*@)?(\[[^\]]*\]|[^:@/?#]*)(?::[0-9]*)?\z",
        "//$1",
    )
    return F.when(is_uri(url) & (found != ""), found)
