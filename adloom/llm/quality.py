"""Quality rules: hashed n-gram likelihood ratio of trusted and raw text, and base rules.

Every document is cut into overlapping byte 4-grams of its words joined by single
spaces, and each 4-gram is hashed into a fixed number of buckets. Two multinomials over
the buckets are counted: one over trusted documents (all that are labelled good), one over
all documents. A document's score is the mean over its 4-grams of log(trusted / raw); it is
kept if the score reaches a threshold, fitted on all labelled documents, and no base rule
fails.

Defined results: a null or empty text has no words, score 0 and fails the base rules. A
null id is never a labelled one. Repeated rows are judged each for itself. With no
labels of a kind, the threshold is ``-inf`` and only the base rules decide. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm import common as C
from adloom.operators.skew import matching

BITS = 16
#: Pseudo-count that every bucket starts with.
SMOOTH = 0.5
#: Base rules: fewest words, and largest percentage of words in repeated 3-word windows.
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"  # noqa: E501


@dataclass(frozen=True)
class Model:
    """Log ratio by bucket, and the least score that is kept."""

    ratio: np.ndarray
    threshold: float


def buckets(words: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every 4-gram that lies within one text, and each text's first one."""
    raw = words.data.astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(0, np.int64), np.zeros(len(words.first), np.int64)
    gram = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    hashed = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    begin = words.start[words.first]
    inside = np.ones(len(raw), bool)
    for back in (1, 2, 3):
        at = begin[1:] - back
        inside[at[at >= 0]] = False
    inside = inside[: len(hashed)]
    before = np.concatenate(([0], np.cumsum(inside)))
    return hashed[inside].astype(np.int64), before[np.minimum(begin, len(hashed))]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Id and text of all labelled documents, with ``good`` 1 or 0, once for each label.

    Texts without a label are told by a bitmap of the ids' hashes and not shuffled.
    """
    kind = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    kind = kind.select("doc_id", F.col("quality").cast("int").alias("good")).distinct()
    rows = matching(docs.select("doc_id", C.text_or_empty()), kind, "doc_id")
    # Merged at any size, so that the labels need not fit into an executor.
    return C.staged(rows.join(kind.hint("merge"), "doc_id"), "labelled")


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket is met in all documents.

    Each task adds up its own documents and sends one row per bucket it has met.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in C.slices(batch):
                found, _ = buckets(C.words(part.column("text")))
                total += np.bincount(found, minlength=1 << BITS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    counted = (
        docs.select(C.text_or_empty())
        .mapInArrow(count, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
    )
    result = np.zeros(1 << BITS)
    for row in counted.collect():  # one row per bucket at most
        result[row.bucket] = row.n
    return result


def ratios(docs: DataFrame, trusted: DataFrame | None) -> np.ndarray:
    """log(trusted / raw) by bucket; raw counts cover all documents."""
    both = np.full((2, 1 << BITS), SMOOTH)
    both[0] += gram_counts(docs)
    if trusted:
        both[1] += gram_counts(trusted)
    raw, good = np.log(both / both.sum(axis=1, keepdims=True))
    return (good - raw).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the ratio, and the threshold that best tells the labelled documents apart."""
    known = labelled(docs, labels)
    ratio = ratios(docs, known.filter("good = 1"))
    judged = with_statistics(known, ratio, "good int")
    scored = judged.filter(~base_failed()).groupBy("doc_id", "good").agg(F.min("score").alias("score"))
    return Model(ratio, best_threshold(scored))


def best_threshold(scored: DataFrame) -> float:
    """The cut of ``score`` with the best balanced accuracy for ``good``; the middle of the
    gap, the lowest on ties.

    Scores are sorted by ranges. What lies before a range is added up on the driver, which
    gets one row for each, and within a range by a window.
    """
    counts = scored.groupBy("score").agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")
    )
    ranges = counts.repartitionByRange("score").withColumn("part", F.spark_partition_id())
    ranges = C.staged(ranges, "scores")
    summed = ranges.groupBy("part").agg(
        F.min("score").alias("first"), F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )
    parts = sorted(summed.collect(), key=lambda row: row.first)
    n_good, n_bad = sum(row.good for row in parts), sum(row.bad for row in parts)
    if not n_good or not n_bad:
        return -np.inf
    before, lost_good, lost_bad = [], 0, 0
    for row, after in zip(parts, [*parts[1:], None]):
        before.append((row.part, lost_good, lost_bad, after.first if after else None))
        lost_good, lost_bad = lost_good + row.good, lost_bad + row.bad
    names = "part int, good_before long, bad_before long, first_after double"
    known = F.broadcast(scored.sparkSession.createDataFrame(before, names))
    order = Window.partitionBy("part").orderBy("score")
    gain = (F.sum("bad").over(order) + F.col("bad_before")) / F.lit(n_bad) - (
        F.sum("good").over(order) + F.col("good_before")
    ) / F.lit(n_good)
    cuts = ranges.join(known, "part").select(
        "score", gain.alias("gain"), F.coalesce(F.lead("score").over(order), "first_after").alias("next")
    )
    best = cuts.filter("next IS NOT NULL AND gain > 0").agg(
        F.min_by(F.struct("score", "next"), F.struct(-F.col("gain"), "score")).alias("cut")
    )
    cut = best.first().cut
    return (cut.score + cut.next) / 2 if cut else -np.inf


def statistics(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Base counts and the score of every document."""
    return with_statistics(docs.select("doc_id", C.text_or_empty()), ratio)


def with_statistics(docs: DataFrame, ratio: np.ndarray, *more: str) -> DataFrame:
    """The same behind further columns of ``docs``, given with their types."""
    fields = [*more, *STATS.split(", ")]
    names = [field.split()[0] for field in fields]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text")
        words = C.words(texts)
        found, begin = buckets(words)
        sums = C.per_text(ratio[found].astype(np.float64), begin)
        raw, places = C.padded(texts)
        visible = ~C.is_space(raw) & ((raw & 0xC0) != 0x80)
        columns = [
            *(part.column(name) for name in names[: len(more)]),
            part.column("doc_id"),
            pa.array(words.counts),
            pa.array(C.per_text(visible, places)),
            pa.array(C.per_text(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)), places)),
            pa.array([duplicate_lines(t) for t in texts.to_pylist()], pa.int64()),
            pa.array(repeated_words(words)),
            pa.array(sums / np.maximum(np.diff(begin), 1)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return C.map_slices(docs, work, ", ".join(fields))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(words: C.Words) -> np.ndarray:
    """Per text, the words inside 3-word windows that occur twice or more in it."""
    number, _ = words.encode()
    total = len(number)
    marked = np.zeros(total + 2, np.int64)
    if total >= 3:
        text = words.text_of_word()
        inside = text[:-2] == text[2:]
        if number.max() < 1 << 21:  # three of them fit into one key
            key = number[:-2] << 42 | number[1:-1] << 21 | number[2:]
        else:  # one very long text; there are fewer pairs than 2**31
            pair = np.unique(number[:-2] << 32 | number[1:-1], return_inverse=True)[1]
            key = pair << 32 | number[2:]
        key, place = key[inside], np.flatnonzero(inside)
        owner = text[place]
        order = np.lexsort((key, owner))
        same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hits = place[order[again]]
        np.add.at(marked, hits, 1)
        covered = marked[:total].copy()
        covered[1:] += marked[: total - 1]
        covered[2:] += marked[: total - 2]
        return C.per_text(covered > 0, words.first)
    return np.zeros(len(words.first) - 1, np.int64)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Counts, score and verdict of every document."""
    return (
        statistics(docs, model.ratio)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    model = fit(docs, labels)
    return kept_rows(docs, model)


def kept_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that pass, filtered in one pass; columns keep their names and types."""
    ratio, threshold = model.ratio, model.threshold

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch):
                words = C.words(part.column("text"))
                found, begin = buckets(words)
                n = words.counts
                score = C.per_text(ratio[found].astype(np.float64), begin)
                score = score / np.maximum(np.diff(begin), 1)
                failed = (n < MIN_WORDS) | (100 * repeated_words(words) > REPEAT_PERCENT * n)
                yield part.filter(pa.array(~failed & (score >= threshold)))

    return docs.mapInArrow(run, docs.schema)
