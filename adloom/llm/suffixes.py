"""Suffix-array deduplication by longest-previous-factor arrays over bytes.

The longest previous factor of a position is the longest string that starts there and
also starts at an earlier position. It is the larger of two common prefixes: with the
previous and with the next suffix, in suffix order, that starts at a smaller position.
Where it reaches the window, the string is a later copy; the mirrored array, which looks
for larger positions, tells the first copy of each.

One suffix array over all text can't be spread over machines, so windows that may be equal
are brought together first: super-k-mers of bytes with the same minimiser form a group,
and a task builds one suffix array over the distinct strings of many groups, with a
different mark after each string. Two windows of different groups are never equal, so
nothing is lost.

Defined results: null, empty and short texts have no windows and lose nothing. Rows that
repeat count as further places and all lose their windows; rows without an id are kept
apart by their text. Bytes are cut where the windows end, also within a character. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from adloom.llm import superkmers as S
from adloom.llm.substrings import joined_runs
from adloom.llm.superkmers import Units

WINDOW, MMER = 400, 32
#: Bytes of the strings that one suffix array holds, unless one group has more.
ARRAY_BYTES = 1 << 19
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def units(texts: pa.Array) -> Units:
    array = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = array.buffers()
    begin = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[begin[0] : begin[-1]]
    hashes = raw.astype(np.uint64) + np.uint64(1)
    # By its own name: tasks get this function by value, and would get all of ``S`` with it.
    return Units(hashes, begin - begin[0], raw.tobytes(), np.arange(len(raw) + 1), 0)


SCHEME = S.Scheme(units, WINDOW, MMER)


def substring_ranks(code: np.ndarray, bits: int, least: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of the substrings that start at each place, by growing lengths.

    Codes have so many bits, and there are fewer than 2**21. As many codes as fit are
    packed and ranked at once; each further round ranks strings of three times the length
    by three ranks. The last length is a third of ``least`` or more. Where a string reaches
    over the end, it is shorter and comes first.
    """
    n, per = len(code), 63 // bits
    key = np.zeros(n, np.uint64)
    for step in range(per):
        key <<= np.uint64(bits)
        key[: max(n - step, 0)] |= code[step:].astype(np.uint64)
    levels, size = [(per, ranked(key)[1])], per
    while 3 * size < least:
        levels.append((3 * size, ranked(triples(levels[-1], np.arange(n)))[1]))
        size *= 3
    return levels


def triples(level: tuple[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Keys that order the suffixes at the given places by three times the length."""
    size, rank = level
    longer = np.concatenate((rank.astype(np.uint64) + np.uint64(1), np.zeros(2 * size, np.uint64)))
    return (longer[at] << np.uint64(42)) | (longer[at + size] << np.uint64(21)) | longer[at + 2 * size]


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    new = np.ones(len(key), np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank


def common_prefixes(
    left: np.ndarray, right: np.ndarray, levels: list[tuple[int, np.ndarray]], n: int
) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, by falling lengths."""
    found = np.zeros(len(left), np.int64)
    for size, rank in reversed(levels):
        for _ in range(7 if size == 1 else 3):
            a, b = left + found, right + found
            ok = np.maximum(a, b) + size <= n
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            found += size * ok
            if not ok.any():
                break
    return found


def nearest_smaller(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each suffix, its common prefix with the nearest suffix before it, in suffix
    order, that starts at a smaller position; below ``least`` the search ends at 0.

    ``lcp[i]`` belongs to suffixes ``i - 1`` and ``i``. All suffixes walk at once, each
    along the pointers of those it has passed.
    """
    to = np.arange(len(position)) - 1
    best = lcp.copy()
    best[:1] = 0
    best[best < least] = 0
    active = np.flatnonzero(best > 0)
    active = active[position[to[active]] > position[active]]
    while len(active):
        via = to[active]
        best[active] = np.minimum(best[active], best[via])
        to[active] = to[via]
        active = active[best[active] > 0]
        active = active[position[to[active]] > position[active]]
    return best


def longest_previous(code: np.ndarray, least: int = 1, mirrored: bool = False) -> np.ndarray:
    """Longest previous factor of each position where it reaches ``least``, else 0.

    ``mirrored`` gives the longest factor that also starts at a later position.
    """
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    levels = substring_ranks(code.astype(np.int64) + 1, 9, n)
    order = np.argsort(triples(levels[-1], np.arange(n)))
    levels.insert(0, (1, code))
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_prefixes(order[:-1], order[1:], levels, n)
    result = np.empty(n, np.int64)
    result[order] = factors(order, lcp, least, mirrored)
    return result


def factors(order: np.ndarray, lcp: np.ndarray, least: int, mirrored: bool) -> np.ndarray:
    position = -order if mirrored else order
    before = nearest_smaller(position, lcp, least)
    behind = np.zeros_like(lcp)
    behind[1:] = lcp[:0:-1]
    after = nearest_smaller(position[::-1], behind, least)[::-1]
    return np.maximum(before, after)


def later_and_first(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows start, over all strings one after the other, that also start earlier
    and that also start later, and where each string begins.

    These are the places whose longest previous (or next) factor reaches the window. The
    suffixes of shorter rests are not needed and left out of the order.
    """
    begin = np.cumsum([0, *(len(s) + 1 for s in strings)])
    # A mark after each string; no window holds it, so none reaches into the next string.
    code = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    code[begin[1:] - 1] = 0
    levels = substring_ranks(code, 9, window)
    starts = np.ones(len(code) + 1, bool)
    for row, end in enumerate(begin[1:]):
        starts[max(end - window, begin[row]) : end] = False
    starts = np.flatnonzero(starts[:-1])
    order = starts[np.argsort(triples(levels[-1], starts))]
    # Neighbours share a window if the pieces that cover it have equal ranks.
    size, rank = next(level for level in reversed(levels) if level[0] <= window)
    lcp = np.full(len(order), window)
    lcp[:1] = 0
    for at in (*range(0, window - size, size), window - size):
        lcp[1:][rank[order[1:] + at] != rank[order[:-1] + at]] = 0
    copies = []
    for mirrored in (False, True):
        found = np.zeros(len(code), bool)
        found[order[factors(order, lcp, window, mirrored) >= window]] = True
        copies.append(found)
    return copies[0], copies[1], begin


def factor_groups(groups: list[S.Group]) -> Iterator[tuple[bytes, int, int]]:
    """Runs of repeated windows of each string, by suffix arrays over many groups."""
    batch: list[S.Group] = []
    size = 0
    for group in groups:
        if len(group.sid) == 1:
            # Equal strings were merged before: their copies are all there is.
            if group.n[0] > 1:
                yield group.sid[0], 0, len(group.body[0]) - WINDOW + 1
            continue
        added = sum(map(len, group.body)) + len(group.body)
        if batch and size + added > ARRAY_BYTES:
            yield from solved(batch)
            batch, size = [], 0
        batch.append(group)
        size += added
    if batch:
        yield from solved(batch)


def solved(groups: list[S.Group]) -> Iterator[tuple[bytes, int, int]]:
    strings = [body for group in groups for body in group.body]
    ids = [sid for group in groups for sid in group.sid]
    n = [k for group in groups for k in group.n]
    later, first, begin = later_and_first(strings, WINDOW)
    repeated = later | first
    for row in np.flatnonzero(np.array(n) > 1):
        repeated[begin[row] : begin[row + 1] - WINDOW] = True
    place = np.flatnonzero(repeated)
    row = np.searchsorted(begin, place, "right") - 1
    for r, at, size in joined_runs(list(zip(row.tolist(), (place - begin[row]).tolist()))):
        yield ids[r], at, size


METHOD = S.Method(factor_groups, lambda bodies: pa.array(bodies, pa.large_binary()))


def spans(docs: DataFrame) -> DataFrame:
    return S.spans(docs, SCHEME, METHOD)


def digests(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes and runs, and a digest of what is kept, for every document."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").cast(pa.binary()).to_pylist()
        rows = []
        for raw, runs in zip(texts, part.column("_runs").to_pylist()):
            gone = S.covered(runs, len(raw), WINDOW) if runs else np.zeros(0, bool)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if runs else raw
            starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((len(raw), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]),
             pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    keyed = S.keyed(docs)
    return S.apply_spans(keyed, spans(keyed), work, DIGESTS)
