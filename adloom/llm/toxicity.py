"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5 characters, with marks at both ends)
and of itself, each hashed to a row of one embedding table. A text is the average over
the bags of all its words, and a softmax over two classes reads it. Frequent subwords
count less in the average, by ``RARE / (RARE + frequency)`` as in smooth inverse
frequency, so that a few telling words are heard among hundreds of common ones. Table and
softmax are trained together in numpy, so that a misspelling never seen shares most of
its vectors with the word it hides.

Defined results: null and empty texts, and texts without words, get the score of the bias
alone. Without labelled rows of both kinds every score is one half and ``predicted`` 1.
Rows without an id are held out or not as an id of no characters; null labels are not
learned from. Repeated rows are scored each for itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm import common as C

#: Labelled documents of each class that are learned from, and the longest in characters.
SAMPLE = 2000
SAMPLE_CHARS = 20_000
#: Held-out documents: remainder of the id's checksum.
MODULUS, HELD_OUT = 5, 0
BITS, DIM, SIZES = 17, 8, (3, 4, 5)
STEPS, BATCH, RATE, DECAY = 900, 64, 0.02, 1e-4
#: Sampled texts that must hold a bucket for it to be trained; the others stay zero.
LEAST_TEXTS = 4
#: Words in the pieces of clean texts that are learned from as well.
PIECE_WORDS = 32
#: Frequency at which a subword counts half.
RARE = 1e-4
#: Factor on the averaged vector, since one word among hundreds must be able to decide.
GAIN = 10.0
SCORED = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Model:
    """What scoring needs: each bucket's vector times the softmax weights, how much it
    counts in an average, and the bias."""

    weight: np.ndarray
    share: np.ndarray
    bias: float


@dataclass(frozen=True)
class Bags:
    """Hashed subwords of words, one after the other, and where each word's begin."""

    bucket: np.ndarray
    begin: np.ndarray


def subwords(words: Sequence[bytes]) -> Bags:
    """The bag of each word, in lower case; the word itself is part of it."""
    texts = [f"<{w.decode('utf-8', 'replace').lower()}>" for w in words]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = code.astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)
    left = ends[owner] - np.arange(len(code)) if len(texts) else np.zeros(0, np.int64)
    found, owners = [], []
    rolling = np.zeros(len(code), np.uint64)
    for n in range(1, max(SIZES) + 1):
        # The hash of the n characters from each place on.
        rolling = rolling[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in SIZES:
            inside = left[: len(rolling)] >= n
            found.append(mixed(rolling[inside], n))
            owners.append(owner[: len(rolling)][inside])
    whole = np.fromiter((hash_word(t) for t in texts), np.uint64, len(texts))
    found.append(mixed(whole, 0))
    owners.append(np.arange(len(texts)))
    bucket, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return Bags(bucket[order], begin)


def hash_word(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def mixed(value: np.ndarray, salt: int) -> np.ndarray:
    value = (value + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (value >> np.uint64(64 - BITS)).astype(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts, at most ``SAMPLE`` of each class."""
    usable = labels.filter(
        F.col("toxic").isin(0, 1)
        & F.col("doc_id").isNotNull()
        & (C.remainder("doc_id", MODULUS) != HELD_OUT)
    ).select("doc_id", "toxic")
    short = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    chosen = None
    for kind in (0, 1):
        one = usable.filter(F.col("toxic") == kind).distinct()
        one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = one if chosen is None else chosen.unionByName(one)
    # At most 2 * SAMPLE ids.
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic")
    # Of the texts of a repeated id one is learned from, the same each time.
    rows = rows.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.orderBy("doc_id", "toxic")
    return [(row.text, row.toxic) for row in rows.collect()]


@dataclass(frozen=True)
class Corpus:
    """Sampled texts as averages: rows of the table and what each adds, text by text."""

    row: np.ndarray
    part: np.ndarray
    begin: np.ndarray
    #: Trained buckets, which the rows number, and how much every bucket counts.
    buckets: np.ndarray
    share: np.ndarray

    def batch(self, texts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows and parts of some texts, and where those of each begin."""
        at, run = spread(self.begin[texts], self.begin[texts + 1] - self.begin[texts])
        return self.row[at], self.part[at], run


def corpus(texts: Sequence[str]) -> Corpus:
    words = C.words(pa.array(texts, pa.string()))
    number, names = words.encode()
    parts = [subwords(names[i : i + 20_000]) for i in range(0, len(names), 20_000)]
    bucket = np.concatenate([p.bucket.astype(np.int32) for p in parts] or [np.zeros(0, np.int32)])
    size = np.concatenate([np.diff(p.begin) for p in parts] or [np.zeros(0, np.int64)])
    first = np.concatenate(([0], np.cumsum(size)))
    held, times = [], []
    for a, b in zip(words.first[:-1], words.first[1:]):
        own, count = np.unique(number[a:b], return_counts=True)
        at, _ = spread(first[own], size[own])
        total = np.bincount(bucket[at], np.repeat(count, size[own]), 1 << BITS)
        held.append(np.flatnonzero(total).astype(np.int32))
        times.append(total[held[-1]].astype(np.float32))
    begin = np.concatenate(([0], np.cumsum([len(h) for h in held])))
    row = np.concatenate(held or [np.zeros(0, np.int32)])
    part = np.concatenate(times or [np.zeros(0, np.float32)])
    known = np.bincount(row, minlength=1 << BITS) >= LEAST_TEXTS
    seen = np.bincount(row, part, 1 << BITS) * known
    share = RARE / (RARE + seen / max(seen.sum(), 1.0))
    part *= share[row]
    part /= np.repeat(np.maximum(sums(part, begin), 1e-30), np.diff(begin))
    keep = known[row]
    rank = np.cumsum(known) - 1
    kept = np.concatenate(([0], np.cumsum(keep)))
    return Corpus(rank[row[keep]], part[keep].astype(np.float32), kept[begin], np.flatnonzero(known), share)


def fit(rows: Sequence[tuple[str, int]]) -> Model:
    """Train table and softmax together by Adam on small batches; the seed is fixed.

    A few words of each clean text are learned from as a clean text too, so that short
    texts without telling words are not in doubt.
    """
    label = np.array([toxic for _, toxic in rows], np.int64)
    if not label.any() or label.all():
        return Model(np.zeros(1 << BITS), np.ones(1 << BITS), 0.0)
    rng = np.random.default_rng(7)
    rows = [*rows, *((piece(text, rng), 0) for text, toxic in rows if not toxic)]
    label = np.array([toxic for _, toxic in rows], np.int64)
    known = corpus([text for text, _ in rows])
    n_rows = len(known.buckets)
    table = rng.normal(0, 0.02, (n_rows, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = (table, out, bias)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    kind_weight = 0.5 * len(label) / np.bincount(label, minlength=2)
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if not len(order):
            order = rng.permutation(len(rows))
        chosen, order = order[:BATCH], order[BATCH:]
        row, part, runs = known.batch(chosen)
        hidden = GAIN * sums(table[row] * part[:, None], runs)
        logits = hidden @ out + bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(len(chosen)), label[chosen]] -= 1.0
        error = prob * kind_weight[label[chosen], None] / len(chosen)
        back = np.repeat(GAIN * error @ out.T, np.diff(runs), axis=0) * part[:, None]
        table_grad = np.stack([np.bincount(row, back[:, k], n_rows) for k in range(DIM)], axis=1)
        grads = (table_grad + DECAY * table, hidden.T @ error, error.sum(axis=0))
        rate = RATE * (1 - (step - 1) / STEPS)
        for param, grad, (mean, square) in zip(params, grads, state):
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            fair = mean / (1 - 0.9**step), square / (1 - 0.99**step)
            param -= (rate * fair[0] / (np.sqrt(fair[1]) + 1e-6)).astype(np.float32)
    weight = np.zeros(1 << BITS)
    weight[known.buckets] = GAIN * table @ (out[:, 1] - out[:, 0])
    return Model(weight, known.share, float(bias[1] - bias[0]))


def piece(text: str, rng: np.random.Generator) -> str:
    """Up to ``PIECE_WORDS`` consecutive words of a text, now and then none."""
    words = text.split()
    size = int(rng.integers(0, PIECE_WORDS + 1))
    at = int(rng.integers(0, max(len(words) - size, 0) + 1))
    return " ".join(words[at : at + size])


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive numbers from each ``first`` on, and where each run begins."""
    begin = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(first - begin[:-1], size) + np.arange(begin[-1]), begin


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; zero for none."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of the toxic class for every text."""
    words = C.words(texts)
    number, names = words.encode()
    bags = subwords(names)
    by_word = sums((model.weight * model.share)[bags.bucket], bags.begin)
    counted = sums(model.share[bags.bucket], bags.begin)
    total = sums(counted[number], words.first)
    logit = sums(by_word[number], words.first) / np.where(total > 0, total, 1.0) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score of every document, from its text alone."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        value = scores(model, part.column("text"))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held_out"), pa.array(value),
             pa.array((value >= 0.5).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    rows = docs.select(
        "doc_id",
        (C.remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"),
        C.text_or_empty(),
    )
    return C.map_slices(rows, work, SCORED)
