"""Longest previous factors and repeated byte strings against brute force."""

import collections
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

import adloom
from adloom.llm import substrings as W
from adloom.llm import suffixes as B
from adloom.llm import superkmers as S


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factor(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab" if seed % 2 else b"abcd") for _ in range(rng.randint(1, 150)))
    code = np.frombuffer(text, np.uint8)
    for mirrored in (False, True):
        got = B.longest_previous(code, mirrored=mirrored).tolist()
        others = lambda i: range(i + 1, len(text)) if mirrored else range(i)
        want = [max((common(text[i:], text[j:]) for j in others(i)), default=0)
                for i in range(len(text))]
        assert got == want


def brute(texts):
    docs = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 400] for d in docs for i in range(len(d) - 399))
    rows = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rows.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def brute_words(texts):
    docs = [t.split() for t in texts]
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


@pytest.fixture(autouse=True)
def changed_values_reach_the_workers():
    cloudpickle.register_pickle_by_value(S)
    yield
    cloudpickle.unregister_pickle_by_value(S)


def texts(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared, line, copy = prose(450), prose(60), prose(900)
    result = [None, "", "x", prose(399), prose(5000), "ab" * 600, "é" * 300]
    result += [prose(rng.randint(0, 300)) + shared + prose(rng.randint(0, 300)) for _ in range(6)]
    result += [prose(500) + line + prose(500) for _ in range(12)]
    result += [copy] * 4
    for _ in range(6):
        cut = rng.randrange(len(copy))
        result.append(copy[:cut] + "#" + copy[cut + 1 :])
    return result


@pytest.mark.parametrize("seed, held", [(1, None), (2, None), (3, 1500), (4, 10)])
def test_digests_equal_brute_force(as_docs, monkeypatch, seed, held):
    if held:
        monkeypatch.setattr(S, "GROUP_BYTES", held)
    given = texts(seed)
    got = {r.doc_id: tuple(r)[1:] for r in B.digests(as_docs(given)).collect()}
    assert [got[i] for i in range(len(given))] == brute(given)


def test_repeated_and_missing_ids_and_empty_table(as_docs):
    given = texts(4)[7:]
    got = B.digests(as_docs(given, ids=[None, 3, 3, 3] * (len(given) // 4) + [3] * (len(given) % 4)))
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(brute(given))
    assert B.digests(as_docs(["a"]).filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("scheme", [B.SCHEME, W.SCHEME])
@pytest.mark.parametrize("block", [1, 97, 1000])
def test_super_kmers_do_not_depend_on_the_slice(monkeypatch, scheme, block):
    """A text has the same packed strings alone and behind others, whatever the blocks are."""
    rng = random.Random(block)
    prose = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    given = [prose(n) for n in (1200, 0, 37, 3000, 401, 2500)] + ["ab " * 500]

    def strings(texts):
        units = scheme.units(pa.array(texts, pa.string()))
        found = S.super_kmers(units, scheme)
        return found.text.tolist(), S.bodies(units, found, scheme.window)

    alone = [strings([t])[1] for t in given]
    monkeypatch.setattr(S, "BLOCK", block)
    for order in (range(len(given)), range(len(given) - 1, -1, -1)):
        owner, found = strings([given[i] for i in order])
        got = [[b for t, b in zip(owner, found) if t == row] for row in range(len(given))]
        assert got == [alone[i] for i in order]


@pytest.mark.parametrize("method, brute_force", [(B, brute), (W, brute_words)])
def test_rows_dealt_out_anew_for_every_pass(as_docs, monkeypatch, method, brute_force):
    monkeypatch.setattr(S, "BLOCK", 701)
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("abcde") * rng.randint(1, 4) for _ in range(n))
    shared = [prose(400) for _ in range(4)]
    given = [prose(rng.randint(0, 200)) + " " + rng.choice(shared) + " " + prose(rng.randint(0, 200))
             for _ in range(60)]
    docs = as_docs(given).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in method.digests(docs).collect()}
    assert [got[i] for i in range(len(given))] == brute_force(given)


@pytest.mark.parametrize("held", [1500, 10])
def test_flooded_strings_of_many_slices_give_their_runs_once(spark, monkeypatch, held):
    monkeypatch.setattr(S, "GROUP_BYTES", held)
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcde \n") for _ in range(n))
    line = prose(60)
    given = [prose(500) + line + prose(500) for _ in range(8)] + ["ab" * 500]
    found = S.super_kmers(B.units(pa.array(given)), B.SCHEME)
    strings = S.bodies(B.units(pa.array(given)), found, B.WINDOW)
    rows = [(m, S.digest(b), b, 1) for m, b in zip(found.minimiser.view(np.int64).tolist(), strings)]
    sent = spark.createDataFrame(rows * 5, S.CONTENTS)
    got = S.repeated_windows(sent, B.SCHEME, B.METHOD).collect()
    windows = {(bytes(r.sid), r.at + i) for r in got for i in range(r["size"])}
    assert windows == {(S.digest(b), i) for b in strings for i in range(len(b) - 399)}
    assert len(windows) == sum(r["size"] for r in got)


def test_rows_of_a_hot_minimiser_grow_with_the_logarithm_of_its_windows(spark, monkeypatch):
    """Strings that share a passage and differ around it: each leaves it in one run a step."""
    monkeypatch.setattr(S, "GROUP_BYTES", 20_000)
    made = []
    monkeypatch.setattr(S.C, "staged", lambda rows, label: made.append(kept(rows)) or made[-1])

    def kept(rows):
        return spark.createDataFrame(rows.collect(), rows.schema)

    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    shared = prose(600)
    given = [prose(380) + shared + prose(380) for _ in range(150)]
    found = S.super_kmers(B.units(pa.array(given)), B.SCHEME)
    strings = S.bodies(B.units(pa.array(given)), found, B.WINDOW)
    rows = [(m, S.digest(b), b, 1) for m, b in zip(found.minimiser.view(np.int64).tolist(), strings)]
    got = S.repeated_windows(spark.createDataFrame(rows, S.CONTENTS), B.SCHEME, B.METHOD).collect()
    whole = {}
    for b in strings:
        for i in range(len(b) - 399):
            whole.setdefault(b[i : i + 400], set()).add((S.digest(b), i))
    often = collections.Counter(t[i : i + 400] for t in map(str.encode, given) for i in range(len(t) - 399))
    want = {place for window, places in whole.items() if often[window] > 1 for place in places}
    assert {(bytes(r.sid), r.at + i) for r in got for i in range(r["size"])} == want
    assert len(made) == 4 and S.steps(B.SCHEME) == [47, 6, 1]
    hot = {bytes(r.sid) for r in made[0].filter("digest IS NOT NULL").collect()}
    cut = sum(level.filter("digest IS NOT NULL").count() for level in made)
    assert len(hot) > 250 and cut < 32 * len(hot)


def test_map_of_slots_keeps_slot_0_in_any_order():
    slots = [0, 2, 32768, 32769, (1 << S.MAP_BITS) - 1]
    rows = []
    for slot in slots:
        bits = bytearray(4096)
        bits[(slot - 1) % 32768 // 8 if slot else 0] |= 1 << ((slot - 1) % 8 if slot else 0)
        rows.append(((slot - 1) // 32768 + 1 if slot else 0, bytes(bits)))
    minimiser = np.array([*slots, 3, 32767, 32770], np.uint64)
    none = np.zeros(len(minimiser), np.int64)
    for order in (rows, rows[::-1]):
        kept = S.chosen(S.SuperKmers(minimiser, none, none, none, none), S.joined_map(order))
        assert kept.minimiser.tolist() == slots


def test_what_tasks_get_does_not_hold_the_modules(spark, monkeypatch):
    """Functions go to the executors by value where the package is registered so."""
    monkeypatch.setattr(S.C, "staged", lambda rows, label: spark.createDataFrame(rows.collect()))
    known = [m for m in (adloom, S) if m.__name__ not in cloudpickle.list_registry_pickle_by_value()]
    for module in known:
        cloudpickle.register_pickle_by_value(module)
    try:
        cloudpickle.dumps((S.Slices(B.SCHEME, B.METHOD, 1), B.METHOD.solve))
    finally:
        for module in known:
            cloudpickle.unregister_pickle_by_value(module)
