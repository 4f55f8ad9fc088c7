"""Substring deduplication by super-k-mer partitioning over words.

A window is ``WINDOW`` consecutive words of one document. Every word that lies in a window
whose words also start anywhere else, in the same document included, is removed; windows
are judged on the input. Windows travel as super-k-mers to the bucket of their minimiser,
where sorting brings equal windows together and counts them exactly.

Defined results: null, empty and short texts have no windows and lose nothing. Rows that
repeat count as further places, so that both lose their windows; rows without an id are
kept apart by their text. Words are kept as they are. Other columns are not read by the
digest query, and are handed on by the filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from adloom.llm import common as C
from adloom.llm import superkmers as S

WINDOW, MMER = 35, 8
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def units(texts: pa.Array) -> S.Units:
    words = C.words(texts)
    number, names = words.encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    hashes = known[number] if len(names) else np.zeros(0, np.uint64)
    return S.Units(hashes, words.first, words.data.tobytes(), words.start, 1)


SCHEME = S.Scheme(units, WINDOW, MMER)


def windows(body: bytes) -> list[bytes]:
    """The windows of a packed string."""
    space = [-1, *(i for i, b in enumerate(body) if b == 32), len(body)]
    return [body[a + 1 : b] for a, b in zip(space, space[WINDOW:])]


def sort_and_count(groups: list[S.Group]) -> Iterator[tuple[bytes, int, int]]:
    """Runs of repeated windows of each string, by sorting the windows of a group."""
    for group in groups:
        if len(group.sid) == 1:
            if group.n[0] > 1:
                yield group.sid[0], 0, len(windows(group.body[0]))
            continue
        entries = sorted(
            (window, row, at)
            for row, body in enumerate(group.body)
            for at, window in enumerate(windows(body))
        )
        hits: list[tuple[int, int]] = []
        low = 0
        for high in range(1, len(entries) + 1):
            if high < len(entries) and entries[high][0] == entries[low][0]:
                continue
            if high - low > 1 or group.n[entries[low][1]] > 1:
                hits += [(row, at) for _, row, at in entries[low:high]]
            low = high
        for row, at, size in joined_runs(sorted(hits)):
            yield group.sid[row], at, size


def joined_runs(hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Sorted (row, place) pairs as (row, first place, places)."""
    first = 0
    for i in range(1, len(hits) + 1):
        if i == len(hits) or hits[i] != (hits[i - 1][0], hits[i - 1][1] + 1):
            yield *hits[first], i - first
            first = i


METHOD = S.Method(
    sort_and_count, lambda bodies: pa.array(bodies, pa.binary()).cast(pa.string())
)


def spans(docs: DataFrame) -> DataFrame:
    return S.spans(docs, SCHEME, METHOD)


def kept_texts(part: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """For each document its words, how many are removed, and the rest joined by spaces."""
    words = C.words(part.column("text"))
    data = words.data.tobytes()
    for row, runs in enumerate(part.column("_runs").to_pylist()):
        a, b = words.first[row], words.first[row + 1]
        whole = data[words.start[a] : max(words.start[b] - 1, words.start[a])]
        if not runs:
            yield int(b - a), 0, whole
            continue
        gone = S.covered(runs, b - a, WINDOW)
        kept = [w for w, lost in zip(whole.split(b" "), gone.tolist()) if not lost]
        yield int(b - a), int(gone.sum()), b" ".join(kept)


def digests(docs: DataFrame) -> DataFrame:
    """Words, removed words, and a digest of what is kept, for every document."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(n, lost, hashlib.sha256(kept).hexdigest()) for n, lost, kept in kept_texts(part)]
        n, lost, kept = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()),
             pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    keyed = S.keyed(docs)
    return S.apply_spans(keyed, spans(keyed), work, DIGESTS)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated windows taken out of their text, all columns kept.

    A text that loses nothing is unchanged; of the others the kept words are joined by
    single spaces. A column ``n_chars`` follows the text.
    """
    keys = S.keyed(docs)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch):
                old = part.column("text").to_pylist()
                new = [text if not lost else kept.decode()
                       for text, (_, lost, kept) in zip(old, kept_texts(part))]
                made = {"text": pa.array(new, pa.string())}
                if "n_chars" in names:
                    sizes = [len(t) if t is not None else None for t in new]
                    made["n_chars"] = pa.array(sizes, part.schema.field("n_chars").type)
                columns = [made.get(name, part.column(name)) for name in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = spans(keys)
    tagged = docs.select(*names, *S.key_columns()).join(found, list(S.KEYS), "left")
    return tagged.mapInArrow(run, schema)
