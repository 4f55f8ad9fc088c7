"""Fingerprints, links and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from adloom.llm import simhash as B

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    points = sorted(root)
    for i, p in enumerate(points):
        for q in points[i + 1 :]:
            if (p ^ q).bit_count() <= 4:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in points}


def texts(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["Ab", "cé", "d", "É", "f#"]) + str(rng.randint(0, 9))
                               for _ in range(n))
    base = prose(400).split()
    result = [None, "", " \n", "one", "one two three", "ONE two three", prose(30)]
    for _ in range(30):
        near = list(base)
        near[rng.randrange(len(near))] = "x"
        result.append(" ".join(near))
    return result + [prose(rng.randint(1, 60)) for _ in range(40)]


def test_fingerprints_and_groups(as_docs):
    given = texts(1)
    got = {r.doc_id: r for r in B.report(as_docs(given)).collect()}
    want = [fingerprint(t) for t in given]
    assert [got[i].fingerprint for i in range(len(given))] == [f"{p:016x}" for p in want]
    root = brute_components(want)
    lowest = {}
    for i, p in enumerate(want):
        lowest.setdefault(root[p], i)
    assert [got[i].component_id for i in range(len(given))] == [lowest[root[p]] for p in want]
    kept = {r.doc_id for r in B.one_of_each_group(as_docs(given)).collect()}
    assert kept == set(lowest.values())


@pytest.mark.parametrize("depth", [0, 3])
def test_shards_lose_no_link(monkeypatch, depth):
    monkeypatch.setattr(B, "LEAF", 8)
    monkeypatch.setattr(B, "PAIRS", 256)
    rng = random.Random(depth)
    points = {rng.getrandbits(64) for _ in range(300)}
    for p in sorted(points)[:150]:
        for _ in range(3):
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    points = np.array(sorted(points), np.uint64)
    tree, shards = B.upper_tree(points, depth)
    assert shards > depth
    row, shard, lives = B.routes(tree, points)
    a, b = [], []
    for s in range(shards):
        here = shard == s
        x, y = B.shard_links(points[row[here & lives]], points[row[here & ~lives]])
        a.append(x)
        b.append(y)
    node, root = B.spanning(np.concatenate(a), np.concatenate(b))
    got = {int(p): int(p) for p in points} | dict(zip(node.tolist(), root.tolist()))
    assert got == brute_components([int(p) for p in points])


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(-5, -6), (7, 7)]
    found = B.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in found} == {(i, 0) for i in range(1, 201)} | {(-5, -6)}


def test_missing_ids_and_empty_table(as_docs):
    rows = B.report(as_docs(["same words here now"] * 3, ids=[None, 4, 4])).collect()
    assert {r.component_id for r in rows} == {4} and len(rows) == 3
    assert B.report(as_docs(["a"], ids=[None])).first().component_id is None
    assert B.one_of_each_group(as_docs(["a b"] * 2, ids=[None, 1])).count() == 1
    empty = as_docs(["a"]).filter("doc_id < 0")
    assert B.report(empty).count() == 0


def test_one_row_of_each_group_with_repeated_rows_and_missing_ids(as_docs):
    a, b, c, d = ("one two three four five", "other words stand in here", "nothing of it again now",
                  "a fourth text without any id")
    rows = [(5, a), (5, a), (7, a), (None, a), (None, b), (None, b), (None, c), (3, c), (3, c), (None, d),
            (9, None), (9, ""), (3, "same id but far from the other text")]
    docs = as_docs([t for _, t in rows], ids=[i for i, _ in rows]).repartition(3)
    kept = B.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text or "", r.n_chars or 0) for r in kept.collect())
    want = [(5, a), (None, b), (3, c), (None, d), (9, ""), (3, rows[-1][1])]
    assert got == Counter((i, t, len(t)) for i, t in want)
