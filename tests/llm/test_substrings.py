"""Windows of words against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark import cloudpickle

from adloom.llm import substrings as B
from adloom.llm import superkmers as S


@pytest.fixture(autouse=True)
def changed_values_reach_the_workers():
    cloudpickle.register_pickle_by_value(S)
    yield
    cloudpickle.unregister_pickle_by_value(S)

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts):
    docs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(d[i : i + 35]) for d in docs for i in range(len(d) - 34))
    rows = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - 34):
            if seen[tuple(d[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(w for w, g in zip(d, gone) if not g)
        rows.append((len(d), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(60), prose(12)
    result = [None, "", "  \t\n", "one", prose(34), prose(35), "a " * 300, "x y " * 90, prose(3000)]
    result += [f"{prose(rng.randint(0, 50))}  {shared}\n{prose(rng.randint(0, 50))}" for _ in range(6)]
    result += [f"{prose(40)} {line} {prose(40)}" for _ in range(20)]
    copy = prose(120)
    result += [copy] * 5 + [copy.replace(" ", "\x0b", 7)]
    words = copy.split()
    for _ in range(8):
        near = list(words)
        for _ in range(2):
            near[rng.randrange(len(near))] = word()
        result.append(" ".join(near))
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_digests_equal_brute_force(as_docs, seed):
    given = texts(seed)
    got = {r.doc_id: tuple(r)[1:] for r in B.digests(as_docs(given)).collect()}
    assert [got[i] for i in range(len(given))] == brute(given)


@pytest.mark.parametrize("held", [600, 10])
def test_hot_minimisers_are_cut(as_docs, monkeypatch, held):
    monkeypatch.setattr(S, "GROUP_BYTES", held)
    given = texts(3)
    got = {r.doc_id: tuple(r)[1:] for r in B.digests(as_docs(given)).collect()}
    assert [got[i] for i in range(len(given))] == brute(given)


def test_blocks_meet(as_docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 100)
    given = texts(4)
    rows = brute(given)
    batch = as_docs(given).toArrow().combine_chunks()
    found = S.super_kmers(B.units(batch.column("text").combine_chunks()), B.SCHEME)
    assert found.size.sum() == sum(max(n - 34, 0) for n, _, _ in rows)


def test_repeated_ids_and_missing_ids(as_docs):
    given = texts(5)[10:30]
    got = B.digests(as_docs(given, ids=[None, 7] * 10)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(brute(given))


def test_empty_table_and_other_columns(as_docs, spark):
    docs = as_docs(["a"]).filter("doc_id < 0")
    assert B.digests(docs).count() == 0
    wide = as_docs(["w " * 80, "solo\n text"]).selectExpr("*", "1 AS begin", "2 AS sid", "3 AS n")
    kept = {r.doc_id: r for r in B.without_repeats(wide).collect()}
    assert kept[0].text == "" and kept[0].n_chars == 0
    assert kept[1].text == "solo\n text" and kept[1].sid == 2
