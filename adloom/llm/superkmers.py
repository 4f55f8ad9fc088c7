"""Super-k-mers: windows of units (words or bytes) that share a minimiser travel together.

A window's minimiser is the m-mer in it with the smallest hash, the leftmost on ties.
Consecutive windows with the minimiser at the same place are packed into one string, the
super-k-mer. Equal windows have equal minimisers at equal distances, so they meet where
super-k-mers are grouped by minimiser, and one super-k-mer never holds the same window
twice. What happens inside such a group is up to the caller.

Three passes over the texts keep the shuffle small: the first counts super-k-mers by
minimiser, the second sends the packed strings of minimisers met more than once, each
distinct string of a slice once with its number of copies, and the third sends places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm import common as C

#: Windows that are looked at together; a place in them must fit into ``_PLACE`` bits.
#: What lies at the border of two blocks is joined, so no string depends on it.
BLOCK = 1 << 20
_PLACE = 22
#: Bits of the map of minimisers met more than once. Its size is fixed: when it fills up
#: with far more text, more strings are sent, and nothing is lost.
MAP_BITS = 27
#: Strings of one minimiser that a task holds; beyond, they are cut up and dealt out anew.
GROUP_BYTES = 1_500_000
#: Into how many runs of windows such a string is cut at a time, about.
FAN = 8
CONTENTS = "minimiser long, sid binary, body binary, n long"
FOUND = "sid binary, at int, size int, digest binary, minimiser long, body binary, n long"
#: A document, also when ids repeat or are missing.
KEYS = ("_k1", "_k2")


@dataclass(frozen=True)
class Units:
    """Texts of a slice as units: a hash for each unit, and the bytes it stands for."""

    hashes: np.ndarray
    #: Number of each text's first unit, and of the end.
    first: np.ndarray
    data: bytes
    #: Place of every unit in ``data``, the end, and bytes between units.
    start: np.ndarray
    gap: int


@dataclass(frozen=True)
class Scheme:
    """What is cut: units of a slice, window and m-mer in units."""

    units: Callable[[pa.Array], Units]
    window: int
    mmer: int


@dataclass(frozen=True)
class SuperKmers:
    minimiser: np.ndarray
    #: First window and number of windows of each, the text they belong to, and the place
    #: of the minimiser.
    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray
    at: np.ndarray


def key_columns() -> tuple[Column, Column]:
    return (
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias(KEYS[0]),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias(KEYS[1]),
    )


def keyed(docs: DataFrame) -> DataFrame:
    """Id, text (null as empty) and two columns that tell documents apart."""
    return docs.select("doc_id", C.text_or_empty(), *key_columns())


def mixed(value: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def mmers(hashes: np.ndarray, m: int) -> np.ndarray:
    """The hash of every run of ``m`` units, by joining runs of doubled lengths."""
    base, result, done, piece, size = 0x100000001B3, None, 0, hashes, 1
    rest = m
    while rest:
        if rest & 1:
            if result is None:
                result, done = piece, size
            else:
                n = len(hashes) - done - size + 1
                factor = np.uint64(pow(base, size, 1 << 64))
                result = result[:n] * factor + piece[done : done + n]
                done += size
        rest >>= 1
        if rest:
            n = len(hashes) - 2 * size + 1
            factor = np.uint64(pow(base, size, 1 << 64))
            piece = piece[:n] * factor + piece[size : size + n]
            size *= 2
    return mixed(result)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def super_kmers(units: Units, scheme: Scheme) -> SuperKmers:
    """All super-k-mers of a slice, in order.

    Each depends on its own text alone, not on the texts that share the slice.
    """
    window, m, total = scheme.window, scheme.mmer, len(units.hashes)
    parts = []
    for low in range(0, max(total - window + 1, 0), BLOCK):
        hashes = units.hashes[low : low + BLOCK + window - 1]
        mm = mmers(hashes, m)
        owner = np.searchsorted(units.first, np.arange(low, low + len(hashes)), "right") - 1
        high = mm >> np.uint64(_PLACE)
        packed = (high << np.uint64(_PLACE)) | np.arange(len(mm), dtype=np.uint64)
        place = (sliding_min(packed, window - m + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        inside = owner[: len(place)] == owner[window - 1 :]
        cut = np.ones(len(place) + 1, bool)
        cut[1:-1] = (place[1:] != place[:-1]) | (owner[1 : len(place)] != owner[: len(place) - 1])
        edges = np.flatnonzero(cut)
        begin, size = edges[:-1], np.diff(edges)
        # Windows that reach into the next text come last in their run.
        size = np.add.reduceat(inside.astype(np.int64), begin)
        keep = size > 0
        begin, size = begin[keep], size[keep]
        parts.append((mm[place[begin]], begin + low, size, owner[begin], place[begin] + low))
    if not parts:
        none = np.zeros(0, np.int64)
        return SuperKmers(none.astype(np.uint64), none, none, none, none)
    minimiser, begin, size, text, at = (np.concatenate(column) for column in zip(*parts))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    if len(first) < len(at):
        size = np.add.reduceat(size, first)
    return SuperKmers(minimiser[first], begin[first], size, text[first], at[first])


def bodies(units: Units, found: SuperKmers, window: int) -> list[bytes]:
    """The packed string of each super-k-mer."""
    data = units.data
    low = units.start[found.begin].tolist()
    high = (units.start[found.begin + found.size + window - 1] - units.gap).tolist()
    return [data[a:b] for a, b in zip(low, high)]


def digest(body: bytes) -> bytes:
    return xxhash.xxh3_128_digest(body)


def number(body: bytes) -> int:
    """A signed number of 64 bits for a string."""
    return int.from_bytes(xxhash.xxh3_64_digest(body), "big", signed=True)


def repeated_map(docs: DataFrame, scheme: Scheme) -> bytes:
    """A bitmap with a bit set for every minimiser that more than one super-k-mer has."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        found = super_kmers(scheme.units(part.column("text")), scheme)
        value, often = np.unique(found.minimiser, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), pa.array(often)], names=["minimiser", "n"]
        )

    slot = F.pmod("minimiser", F.lit(1 << MAP_BITS))
    rows = (
        C.map_slices(docs.select("text"), count, "minimiser long, n long")
        .groupBy("minimiser")
        .agg(F.sum("n").alias("n"))
        .filter("n > 1")
        .groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    )
    return joined_map((row.bucket, row.bits) for row in rows.toLocalIterator())


def joined_map(buckets: Iterable[tuple[int, bytes]]) -> bytes:
    """The bitmap of numbered buckets, in whatever order they come."""
    result = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    # 4 KB for each of at most 2 ** (MAP_BITS - 15) buckets, numbered from 1; slot 0 alone
    # has bucket 0 and shares the first bit of bucket 1.
    for bucket, bits in buckets:
        at = max(bucket - 1, 0) * 4096
        result[at : at + 4096] |= np.frombuffer(bits, np.uint8)
    return result.tobytes()


def chosen(found: SuperKmers, bitmap: bytes) -> SuperKmers:
    bits = np.frombuffer(bitmap, np.uint8)
    # A slot's bit position counts from 1 within its bucket, slot 0 apart.
    slot = (found.minimiser.view(np.int64) % (1 << MAP_BITS)).astype(np.int64)
    at = np.maximum(slot - 1, 0)
    keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return SuperKmers(*(column[keep] for column in
                        (found.minimiser, found.begin, found.size, found.text, found.at)))


def contents(docs: DataFrame, scheme: Scheme, bitmap: Broadcast) -> DataFrame:
    """Distinct packed strings of every slice, with their copies."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        units = scheme.units(part.column("text"))
        found = chosen(super_kmers(units, scheme), bitmap.value)
        rows: dict[bytes, list] = {}
        for minimiser, body in zip(
            found.minimiser.view(np.int64).tolist(), bodies(units, found, scheme.window)
        ):
            row = rows.setdefault(body, [minimiser, 0])
            row[1] += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([m for m, _ in rows.values()], pa.int64()),
             pa.array(map(digest, rows), pa.binary()), pa.array(list(rows), pa.binary()),
             pa.array([n for _, n in rows.values()], pa.int64())],
            names=["minimiser", "sid", "body", "n"],
        )

    return C.map_slices(docs.select("text"), work, CONTENTS)


def places(docs: DataFrame, scheme: Scheme, bitmap: Broadcast) -> DataFrame:
    """Document and first window of every super-k-mer that was sent."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        units = scheme.units(part.column("text"))
        found = chosen(super_kmers(units, scheme), bitmap.value)
        text = pa.array(found.text)
        begin = found.begin - units.first[found.text]
        ids = [digest(body) for body in bodies(units, found, scheme.window)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.binary()), *(part.column(k).take(text) for k in KEYS),
             pa.array(begin)],
            names=["sid", *KEYS, "begin"],
        )

    rows = docs.select("text", *KEYS)
    return C.map_slices(rows, work, "sid binary, _k1 long, _k2 long, begin long")


@dataclass
class Group:
    """Distinct strings of one minimiser with their copies."""

    sid: list[bytes]
    body: list[bytes]
    n: list[int]


#: Solves groups: for each, which windows repeat, as (string number, first window, windows).
Solver = Callable[[list[Group]], Iterable[tuple[bytes, int, int]]]
#: Makes an array of texts from packed strings.
Texts = Callable[[list[bytes]], pa.Array]


@dataclass(frozen=True)
class Method:
    """How groups are solved, and how their strings are cut up again."""

    solve: Solver
    texts: Texts


@dataclass(frozen=True)
class Slices:
    """Cuts the strings of a hot minimiser into runs of at most ``step`` windows.

    A window is told by how far before the minimiser it begins; equal windows begin equally
    far before it. The runs end at multiples of ``step`` of that distance, and a run's key
    is a digest of what all windows of a full run share. So equal windows meet again, and
    strings that differ there part. With a step of 1 a key stands for one window.
    """

    scheme: Scheme
    method: Method
    step: int

    def rows(self, loose: list[tuple[int, bytes, bytes, int]]) -> list[tuple]:
        if not loose:
            return []
        units = self.scheme.units(self.method.texts([body for _, _, body, _ in loose]))
        found = super_kmers(units, self.scheme)
        data, start, gap = units.data, units.start.tolist(), units.gap
        window, step = self.scheme.window, self.step
        result = []
        for text, begin, size, at in zip(*(c.tolist() for c in (found.text, found.begin, found.size, found.at))):
            key, sid, _, n = loose[text]
            first = int(units.first[text])
            # Windows begin from ``near`` to ``far`` units before the minimiser.
            near, far = at - (begin + size - 1), at - begin
            for low in range(near - near % step, far + 1, step):
                a = at - min(low + step - 1, far)
                b = at - max(low, near) + window
                shared = data[start[at - low] : start[at - low - step + 1 + window] - gap]
                body = data[start[a] : start[b] - gap]
                result.append((sid, a - first, None, digest(body), number(shared), body, n))
        return result


def grouped(rows: DataFrame, solve: Solver, cut: Slices, label: str) -> DataFrame:
    """Windows that start in two places or more, as runs of windows of each string.

    Groups arrive sorted and are merged as a stream. A minimiser whose strings outgrow
    ``GROUP_BYTES`` is not held: its strings leave cut up, with ``digest`` set.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Group | None = None
        last, held_bytes, flooded = None, 0, False
        for batch in batches:
            ready: list[Group] = []
            loose: list[tuple[int, bytes, bytes, int]] = []
            keys = batch.column("minimiser").to_numpy(False)
            alone = np.ones(len(keys), bool)
            alone[1:] &= keys[1:] != keys[:-1]
            alone[:-1] &= keys[1:] != keys[:-1]
            alone &= batch.column("n").to_numpy(False) == 1
            if len(keys):
                # The neighbours of the first and last row may be in other batches.
                alone[0] = alone[-1] = False
                alone[keys == last] = False
            part = batch.filter(pa.array(~alone))
            columns = (part.column(c).to_pylist() for c in ("minimiser", "sid", "body", "n"))
            for key, sid, body, n in zip(*columns):
                if key != last or held is None:
                    if held is not None and not flooded:
                        ready.append(held)
                    held, last, held_bytes, flooded = Group([], [], []), key, 0, False
                if flooded:
                    if loose and loose[-1][:2] == (key, sid):
                        n += loose.pop()[3]
                    loose.append((key, sid, body, n))
                elif held.sid and held.sid[-1] == sid:
                    held.n[-1] += n
                else:
                    held.sid.append(sid)
                    held.body.append(body)
                    held.n.append(n)
                    held_bytes += len(body)
                    # Equal strings only add to a number, however many there are.
                    if held_bytes > GROUP_BYTES and len(held.sid) > 1:
                        loose += zip([key] * len(held.sid), held.sid, held.body, held.n)
                        flooded, held = True, Group([], [], [])
            yield from found_rows(solve(ready), cut.rows(loose))
        if held is not None and not flooded:
            yield from found_rows(solve([held]), [])

    ordered = rows.repartition("minimiser").sortWithinPartitions("minimiser", "sid")
    return C.staged(ordered.mapInArrow(run, FOUND), label)


def found_rows(solved: Iterable[tuple[bytes, int, int]], cut: list) -> Iterator[pa.RecordBatch]:
    rows = [(sid, at, size, None, None, None, None) for sid, at, size in solved] + cut
    if rows:
        schema = pa.schema([("sid", pa.binary()), ("at", pa.int32()), ("size", pa.int32()),
                            ("digest", pa.binary()), ("minimiser", pa.int64()),
                            ("body", pa.binary()), ("n", pa.int64())])
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def steps(scheme: Scheme) -> list[int]:
    """Lengths of the runs that hot strings are cut into, one after the other, down to 1."""
    result = [scheme.window - scheme.mmer + 1]
    while result[-1] > 1:
        result.append(-(-result[-1] // FAN))
    return result[1:]


def repeated_windows(rows: DataFrame, scheme: Scheme, method: Method) -> DataFrame:
    """Runs of repeated windows (``sid``, ``at``, ``size``) of all packed strings.

    The strings of a hot minimiser are cut into a few runs of windows, which are grouped by
    what their windows share and solved in the same way; of these the runs of groups that
    are still hot are cut further. Only the run in which a string leaves what it has in
    common with others is cut at each step, so that rows grow with the logarithm of the
    windows. Runs of one window are equal strings, and copies of those are only counted. A
    run is given once, however many slices sent its string.
    """
    resolved = ["sid", "at", "size"]
    levels = []
    for step in steps(scheme):
        found = grouped(rows, method.solve, Slices(scheme, method, step), "windows")
        levels.append(found)
        parts = found.filter(F.col("digest").isNotNull())
        rows = parts.select("minimiser", F.col("digest").alias("sid"), "body", "n")
        if parts.isEmpty():
            break
    else:
        last = grouped(rows, method.solve, Slices(scheme, method, 1), "windows")
        levels.append(last)
    result = levels.pop().filter(F.col("digest").isNull()).select(*resolved)
    for found in reversed(levels):
        parts = found.filter(F.col("digest").isNotNull()).select("digest", "sid", "at").distinct()
        inner = result.distinct().withColumnsRenamed({"sid": "digest", "at": "_at", "size": "_size"})
        outer = parts.join(inner, "digest").select(
            "sid", (F.col("at") + F.col("_at")).alias("at"), F.col("_size").alias("size")
        )
        result = found.filter(F.col("digest").isNull()).select(*resolved).unionByName(outer)
    return result


def spans(docs: DataFrame, scheme: Scheme, method: Method) -> DataFrame:
    """For each document with repeated windows, their runs: first window and number."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(repeated_map(docs, scheme))
    repeated = repeated_windows(contents(docs, scheme, bitmap), scheme, method)
    # A string with many places meets one row or a few here; such keys can be split.
    hits = places(docs, scheme, bitmap).join(repeated, "sid")
    return hits.groupBy(*KEYS).agg(
        F.collect_list(F.struct((F.col("begin") + F.col("at")).alias("begin"), "size")).alias("_runs")
    )


def covered(runs: list[dict] | None, n_units: int, window: int) -> np.ndarray:
    """Which units of a document lie in a repeated window."""
    edge = np.zeros(n_units + 1, np.int64)
    for run in runs or ():
        edge[run["begin"]] += 1
        edge[run["begin"] + run["size"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def apply_spans(
    docs: DataFrame,
    found: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """Hand every document (columns of ``docs`` and ``_runs``) to ``work``."""
    return C.map_slices(docs.join(found, list(KEYS), "left"), work, schema)
