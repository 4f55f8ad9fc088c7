"""Best-fit packing of tokenised documents into sequences of a fixed length.

Packing is online and bounded: a task keeps at most ``OPEN`` sequences open, and a bitset
holds the amounts of free space that any of them has. A piece goes to the fullest
sequence that it fits into, which is the lowest set bit at or above its length. When all
places are taken, the fullest sequence is closed to make room. Pieces arrive in batches of
bounded size, each in order of falling length.

Documents are cut only if they are longer than a sequence; the rest of the division comes
first, so that every later piece fills a sequence by itself.

Defined results: a null or empty text is one piece that holds the separator alone. Rows
with the same or no id are packed each for itself, and their pieces are numbered each from
0. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm import common as C

LENGTH = 1024
SEPARATOR = 2
#: Sequences that one task keeps open, and pieces that one task packs.
OPEN = 8192
#: White space in a row that tiktoken's pattern engine is trusted with.
SPACE_RUN = 10_000
PIECES_PER_TASK = 400_000
#: Bits of a sequence number below the number of its task.
TASK_SHIFT = 36
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def tokenizer(ranks_path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the vocabulary's ranks; special strings are ordinary text.

    The engine behind tiktoken gives up on white space of about a million characters in a
    row; texts with long runs are encoded by :mod:`adloom.llm.bpe`, which gives the same.
    """
    import tiktoken

    from adloom.llm.bpe import Encoder, read_ranks

    tokens = read_ranks(ranks_path)
    ranks = {token: number for number, token in enumerate(tokens)}
    coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(rf"\s{{{SPACE_RUN}}}")
    own = cache(lambda: Encoder(tokens))
    split = regex.compile(pattern).findall

    def encode(text: str) -> np.ndarray:
        if len(text) >= SPACE_RUN and long_run.search(text):
            return np.frombuffer(own().encode_pieces(split(text)), "<u4")
        return coder.encode_to_numpy(text, disallowed_special=())

    return encode


def pieces(docs: DataFrame, load: Callable[[], Callable[[str], np.ndarray]]) -> DataFrame:
    """Every document's pieces: place in the document, length and checksum of the ids.

    ``load`` makes the tokenizer, once for each Python worker.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for batch in batches:
            for part in C.slices(batch):
                owners, rows = [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(encode(text), SEPARATOR).astype("<u4")
                    for number, (start, size) in enumerate(cut(len(ids))):
                        owners.append(row)
                        crc = zlib.crc32(ids[start : start + size].tobytes())
                        rows.append((number, start, size, crc))
                number, start, size, crc = np.array(rows, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays(
                    [pc.take(part.column("doc_id"), pa.array(owners, pa.int32())),
                     pa.array(number.astype(np.int32)), pa.array(start), pa.array(size),
                     pa.array(crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", C.text_or_empty()).mapInArrow(run, PIECES)


def cut(total: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Starts and sizes of the pieces of a document."""
    head = total % length
    starts = [0] if head else []
    starts += range(head, total, length)
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


class Packer:
    """Open sequences by free space; ``place`` returns a sequence and an offset."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN) -> None:
        self.length, self.most_open = length, most_open
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.free_bits = 0
        self.n_open = 0
        self.n_made = 0

    def place(self, size: int) -> tuple[int, int]:
        above = self.free_bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.n_open >= self.most_open:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, sequence = self.length, self.n_made
            self.n_made += 1
        if free > size:
            self.by_free[free - size].append(sequence)
            self.free_bits |= 1 << (free - size)
            self.n_open += 1
        return sequence, self.length - free

    def _take(self, free: int) -> int:
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return sequence


def pack(rows: DataFrame, n_rows: int) -> DataFrame:
    """Sequence and offset of every piece. The rows must come from a written table.

    Rows are dealt out evenly whatever their ids, so that no id or source can make one
    task long; each task packs its own rows, and sequence numbers carry the task's number.
    """
    from pyspark import TaskContext

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << TASK_SHIFT
        packer = Packer()
        for batch in batches:
            size = batch.column("length").to_numpy(False)
            placed = np.zeros((len(size), 2), np.int64)
            # Of the pieces at hand the longest come first and the short ones fill up.
            order = np.argsort(-size, kind="stable")
            placed[order] = np.array([packer.place(n) for n in size[order].tolist()]).reshape(-1, 2)
            sequence, offset = placed.T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence + base), pa.array(offset)],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    dealt = rows.repartition(max(1, -(-n_rows // PIECES_PER_TASK)))
    return dealt.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, load: Callable[[], Callable[[str], np.ndarray]]) -> DataFrame:
    """Tokenise and pack; the pieces are written first, so that no text is read twice."""
    cut_up = C.staged(pieces(docs, load), "pieces")
    return pack(cut_up, cut_up.count())


def bounds(packed: DataFrame) -> DataFrame:
    """Filled length of every sequence, for a look at how full they are."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("filled"), F.count(F.lit(1)).alias("n_pieces")
    )
