"""Byte-level BPE by prefix dynamic programming, and exact decoding.

For every prefix of a piece of text there is exactly one token that ends its encoding.
It is the token that matches the prefix's end and may follow the last token of what
comes before; whether two tokens may stand side by side is read off the merges. Storing
that last token for each prefix gives the encoding by walking back from the end, lets
text be appended without encoding the old part again, and after an edit needs new
entries only from the edit on, until they agree with the old ones again.

Defined results: a null or empty text has no tokens. Every byte is a token, so that all
texts can be encoded, very long pieces in time proportional to their length. Repeated
rows are encoded each for itself. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from adloom.llm import common as C

#: Pieces whose ids a task remembers, twice over, and the longest of them.
CACHE = 250_000
CACHED_CHARS = 64
_NO_LIMIT = 1 << 60
_SHORT = (2, 1)
#: White space outside ASCII, and controls that some engines count as such.
_OTHER_SPACE = regex.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Token strings by id from a rank file; ids run from 0 without gaps."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for encoded, rank in pairs:
        tokens[int(rank)] = base64.b64decode(encoded)
    return tokens


@dataclass
class Encoder:
    """Tables of one vocabulary, whose tokens are ordered by merge rank."""

    tokens: list[bytes]
    rank: dict[bytes, int] = field(init=False)
    #: The merge that makes each token, and the token that each merge makes.
    parts: list[tuple[int, int]] = field(init=False)
    merge: dict[tuple[int, int], int] = field(init=False)
    #: Lengths of the tokens that end with the given three bytes, longest first, followed
    #: by the lengths of shorter tokens.
    lengths: dict[bytes, tuple[int, ...]] = field(init=False)
    #: Bytes of the longest token.
    reach: int = field(init=False)
    fits: dict[tuple[int, int], bool] = field(init=False)
    ids_of: dict[str, bytes] = field(init=False)
    older_ids: dict[str, bytes] = field(init=False)

    def __post_init__(self) -> None:
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.parts, self.merge, self.fits = [], {}, {}
        self.ids_of, self.older_ids = {}, {}
        for number, token in enumerate(self.tokens):
            self.parts.append((number, number))
            for cut in range(len(token) - 1, 0, -1):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is None or right is None or max(left, right) >= number:
                    continue
                if self.may_follow(left, right):
                    self.parts[number] = left, right
                    self.merge[left, right] = number
                    break
        self.fits = {}
        self.reach = max(map(len, self.tokens), default=0)
        by_end: dict[bytes, set[int]] = {}
        for token in self.tokens:
            if len(token) > 2:
                by_end.setdefault(token[-3:], {1, 2}).add(len(token))
        self.lengths = {end: tuple(sorted(sizes, reverse=True)) for end, sizes in by_end.items()}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"fits": {}, "ids_of": {}, "older_ids": {}}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of both strings together is just these two tokens.

        The two tokens are taken apart again, the later merge first. If on the way the
        neighbours at the seam form a token that would have been merged earlier, the seam
        would not have survived. This is the published test of neighbouring tokens for
        linear-time byte-pair encoding, step by step.
        """
        limit = _NO_LIMIT
        merge, parts = self.merge, self.parts
        while True:
            made = merge.get((left, right))
            if made is not None and made < limit:
                return False
            if left > right:
                limit, inner = left, parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, parts[left][1]
                if inner == left:
                    return True
                left = inner

    def extend(self, text: bytes, last: list[int], until: int | None = None) -> list[int]:
        """Add the last tokens of the prefixes of ``text`` that ``last`` does not hold yet."""
        find, fits, lengths = self.rank.get, self.fits, self.lengths.get
        for end in range(len(last), (len(text) if until is None else until) + 1):
            for size in lengths(text[end - 3 : end], _SHORT) if end > 2 else _SHORT:
                if size > end:
                    continue
                token = find(text[end - size : end])
                if token is None:
                    continue
                if size == end:
                    break
                before = last[end - size]
                good = fits.get((before, token))
                if good is None:
                    if len(fits) > 4 * CACHE:
                        fits.clear()
                    good = fits[before, token] = self.may_follow(before, token)
                if good:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        """The ids of the whole text behind the entries."""
        ids, end, tokens = [], len(last) - 1, self.tokens
        while end:
            token = last[end]
            ids.append(token)
            end -= len(tokens[token])
        ids.reverse()
        return ids

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, without splitting it further."""
        whole = self.rank.get(piece)  # a token is its own encoding
        return self.walk_back(self.extend(piece, [0])) if whole is None else [whole]

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """Ids of all pieces one after the other, as little-endian 32-bit numbers."""
        known = self.ids_of
        result = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = self.older_ids.get(piece)
                if ids is None:
                    numbers = self.encode_piece(piece.encode())
                    ids = struct.pack(f"<{len(numbers)}I", *numbers)
                if len(piece) <= CACHED_CHARS:
                    if len(known) >= CACHE:
                        # What was not used since the last time is forgotten.
                        self.older_ids, self.ids_of = known, {}
                        known = self.ids_of
                    known[piece] = ids
            result.append(ids)
        return b"".join(result)

    def encode_texts(self, texts: pa.Array, split: Callable[[str], list[str]]) -> list[bytes]:
        """Ids of every text. Each distinct chunk of a slice is split and encoded once.

        A chunk is a run of other bytes with the ASCII space before it; the pattern never
        joins what lies on both sides of its end. Texts with other white space, whose
        runs could reach over that end, are split as a whole.
        """
        raw, begin = C.padded(texts)
        space = C.is_space(raw)
        opens = np.zeros(len(raw), bool)
        opens[1:] = space[1:] & ~space[:-1]
        opens[begin[1:] - 1] = False  # the added space
        opens[begin[:-1][np.diff(begin) > 0]] = True
        keep = np.ones(len(raw), bool)
        keep[begin[1:] - 1] = False
        data = raw[keep]
        place = np.flatnonzero(opens)
        owner = np.searchsorted(begin, place, "right") - 1
        start = np.append(place - owner, len(data))
        first = np.searchsorted(owner, np.arange(len(begin)))
        chunks = C.Words(data, start, first).encode_raw()
        coded = [self.encode_pieces(split(chunk.decode())) for chunk in chunks[1]]
        number = chunks[0].tolist()
        result = []
        for row, text in enumerate(texts.to_pylist()):
            if text is not None and _OTHER_SPACE.search(text):
                result.append(self.encode_pieces(split(text)))
            else:
                mine = number[first[row] : first[row + 1]]
                result.append(b"".join(map(coded.__getitem__, mine)))
        return result

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@dataclass
class Text:
    """One piece under edit: its bytes and the last token of each of its prefixes."""

    encoder: Encoder
    raw: bytes = b""
    last: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        self.encoder.extend(self.raw, self.last)

    @property
    def ids(self) -> list[int]:
        return self.encoder.walk_back(self.last)

    def append(self, more: bytes) -> None:
        self.raw += more
        self.encoder.extend(self.raw, self.last)

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of ``raw[begin:end]``; returns how many entries were made.

        An entry depends on the bytes and entries of the longest token's reach before it.
        Once that many entries in a row equal the old ones, all later ones do.
        """
        old, shift = self.last, len(new) - (end - begin)
        self.raw = self.raw[:begin] + new + self.raw[end:]
        self.last = old[: begin + 1]
        equal = 0
        while len(self.last) <= len(self.raw):
            at = len(self.last)
            self.encoder.extend(self.raw, self.last, at)
            after_edit = at > begin + len(new)
            equal = equal + 1 if after_edit and self.last[at] == old[at - shift] else 0
            if equal >= self.encoder.reach:
                self.last.extend(old[at - shift + 1 :])
                return at - begin
        return len(self.raw) - begin


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    spark = docs.sparkSession
    # The vocabulary has a fixed size, a few megabytes with its merges.
    shared = spark.sparkContext.broadcast(Encoder(read_ranks(ranks_path)))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder = shared.value
        split = regex.compile(pattern).findall
        rows = []
        for ids in encoder.encode_texts(part.column("text"), split):
            decoded = encoder.decode(np.frombuffer(ids, "<u4"))
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                         hashlib.sha256(decoded).hexdigest()))
        n, coded, plain = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()),
             pa.array(plain, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return C.map_slices(docs.select("doc_id", C.text_or_empty()), work, ENCODED)
