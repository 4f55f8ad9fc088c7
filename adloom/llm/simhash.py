"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage points.

A fingerprint has a bit set if over half of a text's shingle hashes have it. Two
fingerprints link at ``RADIUS`` or fewer differing bits. Equal fingerprints are merged
first. The distinct ones are split by vantage-point trees: a node keeps fingerprints
within a distance of its point on one side and the others on the other side. By the
triangle inequality a link crosses a side only if the distance to the point is within
``RADIUS`` of the bound, so a fingerprint is also sent, as a query, to every shard whose
bounds it overlaps. The upper tree is fitted on a bounded sample and decides shards; each
shard builds its own tree, with a ring for every range of distances, and finds its links
exactly. Only links that join something are emitted, never all pairs of a group. Groups
are the connected components of all links.

Defined results: null, empty and wordless texts have fingerprint zero, linked like any
other. Rows that repeat an id stand in one group if their texts do; rows without an id
belong to the group of their text, and a group without any id has no component id. The
filter keeps one row of every group, also of repeated rows and of rows without an id. An
empty table gives no rows. Other columns are not read by the query, and are handed on by
the filter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm import common as C

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Distinct fingerprints that the upper tree is fitted on at least, and that a shard should
#: hold. The sample has some for each shard, so that shards don't grow with the table: one
#: fingerprint of 8 bytes in about 80.
SAMPLE, SHARD = 65_536, 20_000
#: Fingerprints of a sample that a node needs, those drawn for each shard, and fingerprints
#: of a ring that are compared directly.
LEAST_SAMPLE, SHARD_SAMPLE, LEAF = 64, 256, 1024
#: Comparisons that are held at once.
PAIRS = 1 << 20
PRINTS = "doc_id long, fp long"


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of every text."""
    words = C.words(texts)
    raw = words.data
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8).tobytes()
    size = words.counts
    n = np.where(size >= SHINGLE, size - SHINGLE + 1, (size > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(words.first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    last = np.minimum(at + SHINGLE, np.repeat(words.first[1:], n))
    low, high = words.start[at].tolist(), (words.start[last] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(low, high)), np.uint64, len(low)
    )
    return majority(hashes, begin)


def majority(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Bits set in over half of the hashes between consecutive places."""
    result = np.zeros(len(begin) - 1, np.uint64)
    full = np.flatnonzero(np.diff(begin) > 0)
    first = 0
    while first < len(full):
        # A bounded number of hashes is unpacked at once.
        last = int(np.searchsorted(begin[full + 1], begin[full[first]] + (1 << 18), "right"))
        rows = full[first : max(last, first + 1)]
        low, high = begin[rows[0]], begin[rows[-1] + 1]
        counts = np.zeros((len(rows), 64), np.int64)
        for a in range(low, high, 1 << 20):  # one very long text is taken in parts
            b = min(high, a + (1 << 20))
            bits = np.unpackbits(
                hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
            )
            if len(rows) == 1:
                counts[0] += bits.sum(axis=0, dtype=np.int64)
            else:
                counts += np.add.reduceat(bits, begin[rows] - low, axis=0, dtype=np.int64)
        bits = (2 * counts > (begin[rows + 1] - begin[rows])[:, None]).astype(np.uint8)
        result[rows] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
        first += len(rows)
    return result


def with_fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """Id and fingerprint of every row, and more columns of longs that are handed on."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        made = fingerprints(part.column("text")).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(made), *(part.column(name) for name in also)],
            names=["doc_id", "fp", *also],
        )

    schema = ", ".join([PRINTS, *(f"{name} long" for name in also)])
    return C.map_slices(docs.select("doc_id", C.text_or_empty(), *also), work, schema)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


@dataclass
class Node:
    """An upper node: its vantage point, bound and sides; a leaf has a shard number."""

    point: np.uint64 = np.uint64(0)
    bound: int = 0
    near: Node | None = None
    far: Node | None = None
    shard: int = -1


def vantage_point(points: np.ndarray) -> np.uint64:
    """Of a few spread points, the one whose distances to the others vary most."""
    candidates = points[:: max(1, len(points) // 8)][:8]
    some = points[:: max(1, len(points) // 1024)]
    return max(candidates, key=lambda p: float(distance(some, p).var()))


def upper_tree(sample: np.ndarray, depth: int) -> tuple[Node, int]:
    """A tree of the given depth at most, and the number of its shards."""
    made = 0

    def grow(points: np.ndarray, depth: int) -> Node:
        nonlocal made
        if depth > 0 and len(points) >= LEAST_SAMPLE:
            point = vantage_point(points)
            far = distance(points, point)
            bound = int(np.median(far))
            inside = far <= bound
            if inside.any() and not inside.all():
                return Node(point, bound, grow(points[inside], depth - 1),
                            grow(points[~inside], depth - 1))
        made += 1
        return Node(shard=made - 1)

    return grow(sample, depth), made


def routes(tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the point, shard, and whether it lives there, for every shard it may link to.

    A pair of points in two shards is looked for in the later one only.
    """
    home = np.zeros(len(points), np.int64)
    found: list[tuple[np.ndarray, int]] = []

    def visit(node: Node, rows: np.ndarray, owns: np.ndarray) -> None:
        if not len(rows):
            return
        if node.shard >= 0:
            found.append((rows, node.shard))
            home[rows[owns]] = node.shard
            return
        far = distance(points[rows], node.point)
        inside = far <= node.bound
        a, b = far - RADIUS <= node.bound, far + RADIUS > node.bound
        visit(node.near, rows[a], (owns & inside)[a])
        visit(node.far, rows[b], (owns & ~inside)[b])

    visit(tree, np.arange(len(points)), np.ones(len(points), bool))
    row = np.concatenate([rows for rows, _ in found]) if found else np.zeros(0, np.int64)
    shard = np.concatenate([np.full(len(r), s) for r, s in found]) if found else row
    keep = shard >= home[row]
    row, shard = row[keep], shard[keep]
    return row, shard, shard == home[row]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with the least node of its component, itself left out."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def shard_links(members: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among members and from queries to members, reduced to what joins them."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def reduce() -> None:
        nonlocal waiting
        if found:
            found[:] = [spanning(*(np.concatenate(side) for side in zip(*found)))]
            waiting = len(found[0][0])

    def compare(points: np.ndarray, asked: np.ndarray) -> None:
        nonlocal waiting
        step = max(1, PAIRS // max(len(points), 1))
        for low in range(0, len(asked), step):
            some = asked[low : low + step]
            row, col = np.nonzero(np.bitwise_count(some[:, None] ^ points) <= RADIUS)
            row, col = some[row], points[col]
            other = row != col
            if other.any():
                found.append((row[other], col[other]))
                waiting += len(found[-1][0])
                if waiting > 4 * PAIRS:
                    reduce()

    def search(points: np.ndarray, asked: np.ndarray) -> None:
        if not len(points) or not len(asked):
            return
        if len(points) <= LEAF or len(asked) * len(points) <= PAIRS:
            compare(points, asked)
            return
        point = vantage_point(points)
        far, near = distance(points, point), distance(asked, point)
        if far.min() == far.max():
            compare(points, asked)
            return
        for ring in np.unique(far):
            search(points[far == ring], asked[np.abs(near - ring) <= RADIUS])

    search(members, np.concatenate([members, queries]))
    reduce()
    return found[0] if found else (members[:0], members[:0])


def links(distinct: DataFrame, count: int) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose components are those of all links."""
    depth = max(0, int(np.ceil(np.log2(max(count, 1) / SHARD))))
    sample = np.zeros(0, np.uint64)
    if depth:
        share = min(1.0, max(SAMPLE, SHARD_SAMPLE << depth) / count)
        # Drawn by a hash, so that it is the same each time and needs no sort.
        drawn = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))
        found = distinct.filter(drawn).select("fp").toArrow().column("fp").to_numpy()
        sample = np.sort(found).view(np.uint64)
    tree, shards = upper_tree(sample, depth)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy(False).view(np.uint64)
            row, shard, lives = routes(tree, points)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(points[row].view(np.int64)), pa.array(lives)],
                names=["shard", "fp", "lives"],
            )

    def solve(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        lives = table.column("lives").to_numpy()
        a, b = shard_links(np.sort(points[lives]), np.sort(points[~lives]))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = distinct.select("fp").mapInArrow(route, "shard long, fp long, lives boolean")
    # A shard holds about SHARD members and the queries that overlap its bounds.
    dealt = routed.repartition(shards, "shard")
    return dealt.groupBy("shard").applyInArrow(solve, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """The least node of each node's component (``node``, ``root``), by alternating stars.

    Every round joins each node's larger neighbours to its least neighbour, and then its
    smaller ones. Rounds are written to the shared folder.
    """
    edges = C.staged(edges.filter("a != b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        edges = C.staged(small_star(large_star(edges)), "stars")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).filter("a != b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def groups(docs: DataFrame, *also: str) -> DataFrame:
    """Fingerprint (``fp``) and component of every document, and more columns handed on.

    ``root`` tells components apart, also those without a ``component_id``.
    """
    prints = C.staged(with_fingerprints(docs, *also), "fingerprints")
    distinct = C.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    joined = components(links(distinct, distinct.count()))
    rooted = distinct.join(joined, distinct.fp == joined.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = rooted.join(lowest, "root").select("fp", "root", "component_id")
    # Many documents may share a fingerprint; the other side has it once.
    return prints.join(by_print, "fp")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of every group, that with the smallest id, with all its columns.

    A row without an id stays only where no row of its group has one. Of rows that share
    the id, that with the least hash of its text stays, and of those that share the text as
    well the least by all columns.
    """
    key = {
        "_none": F.col("doc_id").isNull(),
        "_id": F.coalesce("doc_id", F.lit(0)),
        "_text": F.xxhash64(F.coalesce("text", F.lit(""))),
    }
    found = groups(docs.select("doc_id", "text", key["_text"].alias("_text")), "_text")
    first = F.min(F.struct(key["_none"].alias("_none"), key["_id"].alias("_id"), "_text"))
    kept = found.groupBy("root").agg(first.alias("_first")).select("_first.*")
    # Equal rows are combined before they are dealt out.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *(c.alias(k) for k, c in key.items()))
    rows = rows.groupBy(*key).agg(F.min("_row").alias("_row"))
    return rows.join(kept, list(key), "left_semi").select("_row.*")
