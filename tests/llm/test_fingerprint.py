"""Edited texts by brute force, and estimates against true similarity."""

import hashlib
import re

import pytest

from adloom.llm import fingerprint as M

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    base = " ".join(f"w{i * 7919 % 1009}" for i in range(700))
    return [None, "", " \t", "é", "one two", "one two", base, base, base[:2000], base[1000:],
            base.replace("w1", "v1"), "a b c d e", "\x0bx  y\nz w v u t ", "漢字 " * 40]


def test_edits_estimates_and_equal_texts(as_docs):
    given = texts()
    rows = {r.doc_id: r for r in M.fingerprints(as_docs(given)).collect()}
    for i, text in enumerate(given):
        text, follower = text or "", given[i - 1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        row = rows[i]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(jaccard(shingles(text), shingles(edited)), abs=0.15)
        assert row.near_next == pytest.approx(jaccard(shingles(text), shingles(follower)), abs=0.15)
    assert rows[4].fingerprint == rows[5].fingerprint and rows[6].fingerprint == rows[7].fingerprint
    assert rows[0].fingerprint == rows[2].fingerprint == "0" * (M.BINS * M.BITS // 4)
    assert len({r.fingerprint for r in rows.values()}) == 10


def test_few_shingles_fill_all_bins(as_docs):
    docs = as_docs([" ".join(f"{c}{i}" for i in range(5 + k)) for k, c in enumerate("abcdefgh")] * 2)
    rows = M.with_fingerprint(docs, "text", "fp").collect()
    assert len({r.fp for r in rows}) == 8
    assert all("0" * 12 not in r.fp for r in rows)


def test_order_with_repeated_and_missing_ids(as_docs):
    rows = M.fingerprints(as_docs(["abc", "abc", "defdef", None], ids=[5, 5, None, 7])).collect()
    edited = sorted((str(r.doc_id), r.edited_sha256) for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert edited == sorted([("5", sha("abd")), ("5", sha("abd")), ("None", sha("defd")), ("7", sha(""))])
    alone = M.fingerprints(as_docs(["abcdef"])).collect()
    assert alone[0].edited_sha256 == sha("abcdab") and alone[0].near_next == 1.0
    assert M.fingerprints(as_docs(["a"]).filter("false")).count() == 0
