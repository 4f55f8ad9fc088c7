"""What the operators share: whole texts as arrays of words, and staged tables.

Text arrives in Arrow batches. A batch is handled in slices of about a megabyte, so
that memory depends on the longest text and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.session import shared_dir, spread

SLICE_BYTES = 1 << 20
SLICE_ROWS = 2000
#: Bytes between words: space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The table of documents, restricted to the columns that are needed."""
    return spread(table(spark, sf_dir, "documents", *columns))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def staged(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written below the folder all executors share and read back.

    This cuts the lineage: what follows never repeats the work if an executor is lost.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def remainder(column: str, modulus: int) -> Column:
    """The crc32 of a number written as text, modulo ``modulus``; null counts as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def map_slices(
    rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply ``work`` to slices of the rows; the frame needs a column named ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield work(part)

    return rows.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``SLICE_BYTES`` of text, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
        last = min(max(last, first + 1), first + SLICE_ROWS)
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Words of consecutive texts, each followed by one space, in one byte array."""

    data: np.ndarray
    #: Place of every word in ``data``, and the end of ``data``.
    start: np.ndarray
    #: Number of every text's first word, and of the end.
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def encode(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for every word, and the distinct words by number."""
        number, names = self.encode_raw()
        return number, [name[:-1] for name in names]

    def encode_raw(self) -> tuple[np.ndarray, list[bytes]]:
        """The same with what follows each word."""
        if len(self.start) == 1:
            return np.zeros(0, np.int64), []
        offsets = pa.py_buffer(self.start.astype(np.int32))
        array = pa.Array.from_buffers(
            pa.binary(), len(self.start) - 1, [None, offsets, pa.py_buffer(self.data)]
        ).dictionary_encode()
        return array.indices.to_numpy(False).astype(np.int64), array.dictionary.to_pylist()


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with a space after it, and where each begins."""
    whole = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " ").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    begin = np.frombuffer(offsets, np.int64, len(whole) + 1, whole.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[begin[0] : begin[-1]], begin - begin[0]


def is_space(raw: np.ndarray) -> np.ndarray:
    return _SPACE[raw]


def words(texts: pa.Array) -> Words:
    """Words of each text: runs of anything but space and tab to carriage return."""
    raw, begin = padded(texts)
    space = is_space(raw)
    previous = np.empty_like(space)
    previous[:1] = True
    previous[1:] = space[:-1]
    starts = np.flatnonzero(~space & previous)
    closing = space & ~previous
    lengths = np.flatnonzero(closing) - starts
    start = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=start[1:])
    data = raw[~space | closing]
    data[start[1:] - 1] = 32
    return Words(data, start, np.searchsorted(starts, begin))


def per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between the given places."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]
