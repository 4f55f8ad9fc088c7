"""Fill-in-middle: texts cut into prefix, middle and suffix, and put into another order.

A text is a row of units, each a word with the white space before it, or white space at
the end. Where it is cut is decided by ranks of units; what is cut are code points. Both
are brought together by an indexable skip list over the units: the links of every lane
carry how many units and how many code points they jump over, and an express lane's link
the sums of the links below it. From the top lane down, a search takes every link that does
not pass the rank, and the widths on its way add up to the exact place of the cut.

Which texts are rearranged, how, and where they are cut comes from a hash of a seed and
the id alone, so that a repeated run or a lost task gives the same rows.

Defined results: a null or empty text, and one that holds a sentinel, stays as it is
(``plain``, without cuts). A null id is hashed as no digits. Equal ids are cut by the same
numbers, each in its own text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm import common as C

# The sentinels, and the share of texts in 100 that are rearranged, and of
# these that have the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
REARRANGED, SUFFIX_FIRST = 50, 80
SEED = 42
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: One unit in so many of a lane is also in the next lane above, on average.
STRIDE = 4
ARRANGED = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
)


def promoted(n: int) -> np.ndarray:
    """How many express lanes each of the first ``n`` units is in, by a hash of its number."""
    value = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    lanes = np.zeros(n, np.int64)
    left = np.arange(n)
    while len(left):
        left = left[value[left] % np.uint64(STRIDE) == 0]
        value[left] //= np.uint64(STRIDE)
        # A hash of zero would go on for ever; no list is as high as this.
        left = left[lanes[left] < 24]
        lanes[left] += 1
    return lanes


@dataclass(frozen=True)
class Lane:
    """Links of one lane: the units and code points each jumps over, and the link in the
    lane below that starts at the same place."""

    units: np.ndarray
    chars: np.ndarray
    below: np.ndarray


class SkipList:
    """An indexable skip list over the units of a text, the lowest lane first."""

    def __init__(self, chars: np.ndarray, lanes: np.ndarray | None = None) -> None:
        n = len(chars)
        self.size = n
        height = (promoted(n) if lanes is None else lanes[:n]).copy()
        height[:1] = n  # every lane starts at the head
        self.lanes = [Lane(np.ones(n, np.int64), chars.astype(np.int64), np.zeros(n, np.int64))]
        while len(height) > STRIDE:
            up = np.flatnonzero(height > len(self.lanes) - 1)
            if len(up) == len(height):
                break
            lower = self.lanes[-1]
            self.lanes.append(
                Lane(np.add.reduceat(lower.units, up), np.add.reduceat(lower.chars, up), up)
            )
            height = height[up]

    def seek(self, rank: int) -> int:
        """The code points before the unit of a rank, from 0 to the number of units."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        units = chars = link = 0
        for lane in reversed(self.lanes):
            last = len(lane.units)
            while link < last and units + lane.units[link] <= rank:
                units += int(lane.units[link])
                chars += int(lane.chars[link])
                link += 1
            if units == rank:
                break
            link = int(lane.below[link])
        return chars


def unit_widths(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all units of all texts, and the number of each text's first unit."""
    raw, begin = C.padded(texts)
    space = C.is_space(raw)
    # A unit ends with a word, and with a text that ends in white space.
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:-1] = space[1:] & ~space[:-1]
    close = begin[1:] - 1  # the space that was added
    ends[close[close > begin[:-1]]] = True
    end = np.flatnonzero(ends)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    owner = np.searchsorted(begin, end, "right") - 1
    first = np.searchsorted(owner, np.arange(len(begin)))
    width = np.diff(chars[end], prepend=0)
    opens = np.zeros(len(end), bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    width[opens] = (chars[end] - chars[begin[owner]])[opens]
    return width, first


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that decide about one document."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def arranged(
    text: str, widths: np.ndarray, numbers: tuple[int, int, int, int], lanes: np.ndarray
) -> tuple[str, int | None, int | None, str]:
    """Form, code points of prefix and middle, and the rearranged text."""
    one, two, share, order = numbers
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or share % 100 >= REARRANGED:
        return PLAIN, None, None, text
    units = SkipList(widths, lanes)
    cuts = sorted((one % (units.size + 1), two % (units.size + 1)))
    a, b = map(units.seek, cuts)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < SUFFIX_FIRST:
        return SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Every document with its units, form, cuts and rearranged text (``output``)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, ids = part.column("text"), part.column("doc_id")
        widths, first = unit_widths(texts)
        lanes = promoted(int(np.diff(first).max(initial=0)))
        rows = list(_rows(texts.to_pylist(), ids.to_pylist(), widths, first, seed, lanes))
        form, prefix, middle, output = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(first)), pa.array(form, pa.string()),
             pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
             pa.array(output, pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return C.map_slices(docs.select("doc_id", C.text_or_empty()), work, ARRANGED)


def _rows(
    texts: list[str], ids: list[int | None], widths: np.ndarray, first: np.ndarray, seed: int,
    lanes: np.ndarray,
) -> Iterator[tuple[str, int | None, int | None, str]]:
    for row, (text, doc_id) in enumerate(zip(texts, ids)):
        yield arranged(text, widths[first[row] : first[row + 1]], draws(seed, doc_id), lanes)


def restored(form: str = "form", output: str = "output") -> Column:
    """The original text, from form and rearranged text alone."""
    parts = F.split(output, "<[PSM]>", -1)
    # What stands before the first sentinel is empty.
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == PSM, psm).when(F.col(form) == SPM, spm).otherwise(F.col(output))


def digests(docs: DataFrame) -> DataFrame:
    """The same with digests in place of the texts, also of the text rebuilt."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )
