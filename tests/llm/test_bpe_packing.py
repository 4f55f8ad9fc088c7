"""Byte-level BPE against tiktoken, edits against encoding anew, and packing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from adloom.llm import bpe, packing
from adloom.llm.queries import load_tokenizer

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=encoder.rank, special_tokens={})


def texts(seed, n=150):
    rng = random.Random(seed)
    signs = "abcdeinorstTH  é\n\t#1!' 　\x1c漢😀"
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [None, "", " ", "\n\n", "it's  so", "<|endoftext|>", "ab" * 4000, " " * 700, *made]


def test_ids_and_digests(as_docs, reference):
    given = texts(1)
    rows = {r.doc_id: r for r in bpe.encode(as_docs(given), RANKS, P.PATTERN).collect()}
    for i, text in enumerate(given):
        ids = np.array(reference.encode_ordinary(text or ""), "<u4").tobytes()
        assert rows[i].n_tokens == len(ids) // 4, text
        assert rows[i].ids_sha256 == hashlib.sha256(ids).hexdigest(), text
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_appends_and_edits(encoder):
    rng = random.Random(2)
    for _ in range(300):
        raw = bytes(rng.choice(b"thein agor") for _ in range(rng.randint(1, 60)))
        text = bpe.Text(encoder, raw[:20])
        text.append(raw[20:])
        assert text.ids == encoder.encode_piece(raw)
        a = rng.randint(0, len(raw))
        b = rng.randint(a, len(raw))
        text.replace(a, b, bytes(rng.choice(b"the ") for _ in range(rng.randint(0, 5))))
        assert text.ids == encoder.encode_piece(text.raw)
    long = bpe.Text(encoder, b"thequickbrown" * 3000)
    assert long.replace(20_000, 20_003, b"xyz") < 600
    assert long.ids == encoder.encode_piece(long.raw)


def test_small_caches_change_nothing(encoder, monkeypatch):
    split = regex.compile(P.PATTERN).findall
    given = [t for t in texts(3) if t]
    want = [encoder.encode_pieces(split(t)) for t in given]
    monkeypatch.setattr(bpe, "CACHE", 3)
    small = bpe.Encoder(encoder.tokens)
    assert [small.encode_pieces(split(t)) for t in given] == want


def test_packing_is_whole(as_docs):
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    given = [*texts(4, 60), "word " * 2500, "a b" * 1023, "x"]
    rows = packing.pack_documents(as_docs(given), load_tokenizer).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(given):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 1024 for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024
    assert len(filled) <= -(-sum(r.length for r in rows) // 1024) + 2


@pytest.mark.parametrize("sign", [" ", "\n", "x", "\u3000", " a", "1"])
def test_very_long_runs(sign):
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = load_tokenizer()
    for text in (sign * 1_000_000, f"a {sign * 20_000}b", sign * 9_999):
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_blank_text_does_not_fail_the_table(as_docs):
    rows = packing.pack_documents(as_docs([" " * 1_000_000, "\n" * 2_000_000, "x"]), load_tokenizer).collect()
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for row, text in enumerate((" " * 1_000_000, "\n" * 2_000_000)):
        n = len(plain.encode(text, add_special_tokens=False).ids) + 1
        assert sum(r.length for r in rows if r.doc_id == row) == n


def test_best_fit_and_bounded_space():
    packer = packing.Packer(10, most_open=2)
    assert packer.place(6) == (0, 0) and packer.place(5) == (1, 0)
    assert packer.place(4) == (0, 6)  # the fullest that has room
    assert packer.place(5) == (1, 5)
    assert [packer.place(n) for n in (7, 8)] == [(2, 0), (3, 0)]
    assert packer.place(9) == (4, 0)  # the fullest, with two left, is closed
    assert packer.n_open == 2 and packer.place(3) == (2, 7)
    rng = random.Random(5)
    sizes = [rng.randint(1, 1024) for _ in range(20_000)]
    packer = packing.Packer()
    for size in sizes:
        packer.place(size)
    assert packer.n_made < 1.02 * sum(sizes) / 1024


def test_repeated_and_missing_ids_and_empty_table(as_docs):
    rows = packing.pack_documents(as_docs(["a"] * 3, ids=[None, 1, 1]), load_tokenizer).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
    empty = as_docs(["a"]).filter("doc_id < 0")
    assert packing.pack_documents(empty, load_tokenizer).count() == 0
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0
