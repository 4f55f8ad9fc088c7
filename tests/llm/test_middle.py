"""Fill-in-middle against cuts counted unit by unit, and the round trip."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from adloom.llm import middle
from pyspark.sql import functions as F

UNITS = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts(seed, n=120):
    rng = random.Random(seed)
    made = ["".join(rng.choice("ab é漢😀 \n\t\x1c") for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [None, "", " ", "\n\n", "a", "<P>", "a<", "x <M", "a <S> b", "w " * 30_000, " " * 50_000, *made]


def test_units_and_ranks():
    given = [t or "" for t in texts(1)]
    widths, first = middle.unit_widths(pa.array(given))
    lanes = middle.promoted(60_000)
    for row, text in enumerate(given):
        units = UNITS.findall(text)
        mine = widths[first[row] : first[row + 1]]
        assert mine.tolist() == list(map(len, units)), text
        ranks = middle.SkipList(mine, lanes)
        for rank in {0, len(units) // 3, len(units) // 2, max(len(units) - 1, 0), len(units)}:
            assert ranks.seek(rank) == sum(map(len, units[:rank]))


def test_lanes_of_any_height():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 50, 700):
        chars = rng.integers(1, 9, n)
        for heights in (np.zeros(n, np.int64), rng.integers(0, 6, n), np.full(n, 3)):
            ranks = middle.SkipList(chars, heights)
            assert [ranks.seek(r) for r in range(n + 1)] == [0, *np.cumsum(chars).tolist()]
    with pytest.raises(IndexError):
        ranks.seek(n + 1)


def test_a_search_takes_few_links():
    ranks = middle.SkipList(np.ones(100_000, np.int64))
    assert len(ranks.lanes) > 5 and len(ranks.lanes[-1].units) < 40
    assert all(lane.units.sum() == lane.chars.sum() == 100_000 for lane in ranks.lanes)


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, share, order = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or share % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if order % 100 < 80:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def test_forms_outputs_and_round_trip(spark, as_docs):
    given = texts(3)
    ids = [None, None, *range(2, len(given) - 1), 2]  # missing and repeated ids
    docs = as_docs(given, ids).withColumn("form", F.lit("clash")).repartition(3)
    rows = middle.fill_in_middle(docs).withColumn("back", middle.restored()).collect()
    got = sorted((tuple(r) for r in rows), key=repr)
    want = sorted(((i, *plain(i, t), t or "") for i, t in zip(ids, given)), key=repr)
    assert got == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    digests = sorted((tuple(r) for r in middle.digests(docs).collect()), key=repr)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert digests == sorted(((*row[:5], sha(row[5]), sha(row[6])) for row in want), key=repr)


def test_no_documents(as_docs):
    assert middle.digests(as_docs([])).count() == 0
