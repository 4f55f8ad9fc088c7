"""Language by segmentation-marginalised unigrams.

The pieces are those of a public vocabulary (only its strings are used). For every
language, piece probabilities are learned by expectation maximisation over all
segmentations of the words of a labelled sample. A word's probability is the sum over
all its segmentations, computed by the forward algorithm; a text's is the product over
its words. Words are runs of letters in lower case, with the mark that the vocabulary
puts before a word. The score is the posterior of the best language under equal priors.

Defined results: null, empty and letterless texts are ``und`` with score 0. A text whose
languages tie goes to the first language by name. Rows without an id count as an id of no
characters. Without any labelled text every text is ``und``. Repeated rows are predicted
each for itself. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm import common as C

UNKNOWN = "und"
#: Labelled documents that are read for each language, and distinct words kept of them.
SAMPLE_DOCS = 1500
SAMPLE_WORDS = 20_000
SALTS = 64
#: Letters of the longest word that is learned from.
SAMPLE_LETTERS = 40
ROUNDS = 4
#: Held-out documents: remainder of the id's checksum.
MODULUS, HELD_OUT = 4, 2
#: Mark before a word, and the longest piece that is used.
MARK = "▁"
LONGEST = 12
#: Words in one forward pass, and letters beyond which a word has a pass of its own, with
#: scaled sums.
BLOCK = 20_000
LONG_WORD = 40
#: Base of the rolling hash that finds pieces, and bits of a bitmap over it.
_BASE, _BITMAP = np.uint64(0x100000001B3), 19
_LETTERS = re.compile(r"[^\W\d_]+")
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def vocabulary(path: str) -> list[str]:
    """Pieces of letters, with or without the mark, of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    usable = {
        p.lower()
        for p in pieces
        if len(p) <= LONGEST and p != MARK and _LETTERS.fullmatch(p.removeprefix(MARK))
    }
    return sorted(usable)


@dataclass
class Pieces:
    """The vocabulary as sorted hashes, with a bitmap that most other strings fail."""

    hashes: np.ndarray
    number: np.ndarray
    bitmap: np.ndarray
    by_text: dict[str, int]

    @classmethod
    def of(cls, pieces: Sequence[str]) -> Pieces:
        hashes = np.zeros(len(pieces), np.uint64)
        for i, piece in enumerate(pieces):
            value = 0
            for char in piece:
                value = (value * int(_BASE) + ord(char)) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = value
        number = np.argsort(hashes)
        bitmap = np.zeros(1 << _BITMAP, bool)
        bitmap[slot(hashes)] = True
        return cls(hashes[number], number, bitmap, {p: i for i, p in enumerate(pieces)})


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITMAP)


@dataclass(frozen=True)
class Lattice:
    """Every place of every piece in many words at once, in order of where pieces end.

    Words are sorted by falling length, so that the words that reach a place are the
    first ones. A cell is a place in a word; the cells of one place lie side by side.
    """

    word: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    #: First edge that ends at each place; first cell of each place.
    edge_of: np.ndarray
    cell_of: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, length: np.ndarray, pieces: Pieces) -> Lattice:
        """``code`` holds the characters of words of falling length."""
        first = np.cumsum(length) - length
        word_of = np.repeat(np.arange(len(length)), length)
        offset = np.arange(len(code)) - first[word_of]
        left = length[word_of] - offset
        covered = np.zeros(len(code), bool)
        found = []
        rolling = np.zeros(len(code), np.uint64)
        for n in range(1, min(LONGEST, int(length.max(initial=0))) + 1):
            rolling = rolling[: len(code) - n + 1] * _BASE + code[n - 1 :]
            at = np.flatnonzero((left[: len(rolling)] >= n) & pieces.bitmap[slot(rolling)])
            near = np.minimum(np.searchsorted(pieces.hashes, rolling[at]), len(pieces.hashes) - 1)
            same = pieces.hashes[near] == rolling[at]
            at, piece = at[same], pieces.number[near[same]]
            if n == 1:
                covered[at] = True
                bare = np.flatnonzero(~covered)
                at = np.concatenate([at, bare])
                piece = np.concatenate([piece, np.full(len(bare), len(pieces.number))])
            found.append((word_of[at], offset[at], offset[at] + n, piece))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, int)] * 4
        order = np.argsort(columns[2].astype(np.int16), kind="stable")
        word, begin, end, piece = (c[order] for c in columns)
        longest = int(length.max(initial=0))
        reaching = np.searchsorted(-length, -np.arange(longest + 1), "right")
        cell_of = np.concatenate(([0], np.cumsum(reaching)))
        return cls(word, begin, end, piece, np.searchsorted(end, np.arange(longest + 2)),
                   cell_of, length)

    def cells(self, place: np.ndarray | int, word: np.ndarray) -> np.ndarray:
        return self.cell_of[place] + word

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Sum over all segmentations of what lies before each cell, by language."""
        alpha = np.ones((self.cell_of[-1], prob.shape[1]))
        for place in range(1, len(self.cell_of) - 1):
            low, high = self.edge_of[place], self.edge_of[place + 1]
            word = self.word[low:high]
            terms = alpha[self.cells(self.begin[low:high], word)] * prob[self.piece[low:high]]
            a, b = self.cell_of[place], self.cell_of[place + 1]
            for lang in range(prob.shape[1]):
                alpha[a:b, lang] = np.bincount(word, terms[:, lang], b - a)
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        """Each word's probability by language."""
        return alpha[self.cells(self.length, np.arange(len(self.length)))]

    def expected_counts(self, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each piece is used over all segmentations, for one language."""
        alpha = self.forward(p[:, None])
        total = self.totals(alpha)[:, 0]
        beta = np.zeros(self.cell_of[-1])
        beta[self.cells(self.length, np.arange(len(self.length)))] = 1.0
        counts = np.zeros(len(p))
        order = np.argsort(self.begin, kind="stable")
        bounds = np.searchsorted(self.begin[order], np.arange(len(self.cell_of)))
        for place in range(len(self.cell_of) - 3, -1, -1):
            at = order[bounds[place] : bounds[place + 1]]
            word = self.word[at]
            ahead = p[self.piece[at]] * beta[self.cells(self.end[at], word)]
            used = alpha[self.cells(place, word), 0] * ahead * (weight / total)[word]
            counts += np.bincount(self.piece[at], used, len(p))
            a, b = self.cell_of[place], self.cell_of[place + 1]
            beta[a:b] += np.bincount(word, ahead, b - a)
        return counts


@dataclass
class Model:
    """Piece probabilities: one row per piece, one column per language.

    The last row is the probability of a character that no piece covers.
    """

    languages: list[str]
    pieces: Pieces
    prob: np.ndarray

    def score_words(self, words: Sequence[bytes]) -> np.ndarray:
        """Log probability by language, and number of letters, of each given word."""
        runs = letter_runs(words)
        order = np.argsort(-runs.length, kind="stable")
        scores = np.zeros((len(order), len(self.languages) + 1))
        scores[:, -1] = runs.length
        n_long = int(np.count_nonzero(runs.length > LONG_WORD))
        for at in order[:n_long]:
            text = runs.code[runs.first[at] : runs.first[at] + runs.length[at]]
            scores[at, :-1] = self.forward_long(MARK + text.astype("<u4").tobytes().decode("utf-32-le"))
        for low in range(n_long, len(order), BLOCK):
            block = order[low : low + BLOCK]
            code, length = runs.marked(block)
            lattice = Lattice.of(code, length, self.pieces)
            scores[block, :-1] = np.log(lattice.totals(lattice.forward(self.prob)))
        total = np.zeros((len(order) + 1, scores.shape[1]))
        np.cumsum(scores, axis=0, out=total[1:])
        bounds = np.searchsorted(runs.word, np.arange(len(words) + 1))
        return total[bounds[1:]] - total[bounds[:-1]]

    def forward_long(self, text: str) -> np.ndarray:
        """The same sum for one long word; it keeps as many sums as a piece has characters."""
        recent = [np.ones(self.prob.shape[1])]
        scale = 0.0
        for end in range(1, len(text) + 1):
            sums, hit = np.zeros(self.prob.shape[1]), False
            for back in range(1, min(LONGEST, end) + 1):
                piece = self.pieces.by_text.get(text[end - back : end])
                if piece is not None:
                    sums += recent[-back] * self.prob[piece]
                    hit |= back == 1
            if not hit:
                sums += recent[-1] * self.prob[-1]
            recent = [*recent[1 - LONGEST :], sums]
            peak = sums.max()
            if peak < 1e-100:
                recent = [np.maximum(old / peak, 1e-290) for old in recent]
                scale += np.log(peak)
        return np.log(recent[-1]) + scale


@dataclass(frozen=True)
class Runs:
    """Runs of letters in lower case: their characters, places, and word numbers."""

    code: np.ndarray
    first: np.ndarray
    length: np.ndarray
    word: np.ndarray

    def marked(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters of the chosen runs, each with the mark before it."""
        length = self.length[chosen] + 1
        begin = np.cumsum(length) - length
        at = np.repeat(self.first[chosen] - 1 - begin, length) + np.arange(length.sum())
        code = self.code[at]
        code[begin] = ord(MARK)
        return code.astype(np.uint64), length


def letter_runs(words: Sequence[bytes]) -> Runs:
    text = "\n" + b"\n".join(words).decode("utf-8", "replace").lower() + "\n"
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = letters()[code]
    change = np.diff(letter.astype(np.int8))
    first = np.flatnonzero(change == 1) + 1
    last = np.flatnonzero(change == -1) + 1
    breaks = np.cumsum(code == 10)
    return Runs(code, first, last - first, breaks[first] - 1)


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    every = (chr(i).isalpha() for i in range(0x110000))
    return np.fromiter(every, bool, 0x110000)


def training_words(docs: DataFrame) -> list[tuple[str, bytes, int]]:
    """The most frequent words of a sample of each language: language, word, count."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    # First within salted groups, since one language may hold most rows.
    salted = Window.partitionBy("lang", F.pmod(F.hash("doc_id"), F.lit(SALTS))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    usable = (
        docs.select("doc_id", "lang", "text")
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .filter(C.remainder("doc_id", MODULUS) != HELD_OUT)
    )
    chosen = (
        usable.select("doc_id", "lang")
        .withColumn("_place", F.row_number().over(salted))
        .filter(F.col("_place") <= SAMPLE_DOCS)
        .withColumn("_place", F.row_number().over(whole))
        .filter(F.col("_place") <= SAMPLE_DOCS)
        .drop("_place")
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch):
                total: Counter = Counter()
                words = C.words(part.column("text"))
                number, names = words.encode()
                langs = part.column("lang").to_pylist()
                for text, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                    found, often = np.unique(number[a:b], return_counts=True)
                    for n, k in zip(found.tolist(), often.tolist()):
                        for run in _LETTERS.findall(names[n].decode("utf-8", "replace").lower()):
                            if len(run) <= SAMPLE_LETTERS:
                                total[langs[text], run] += k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang for lang, _ in total], pa.string()),
                        pa.array([word for _, word in total], pa.string()),
                        pa.array(list(total.values()), pa.int64()),
                    ],
                    names=["lang", "word", "n"],
                )

    # The sample's ids are bounded by the number of languages.
    counted = (
        usable.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi")
        .select("lang", "text")
        .mapInArrow(count, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = counted.withColumn("_place", F.row_number().over(best)).filter(
        F.col("_place") <= SAMPLE_WORDS
    )
    return [(row.lang, row.word, row.n) for row in kept.collect()]


def fit(docs: DataFrame, vocabulary_path: str) -> Model:
    """Piece probabilities of every language in the labelled documents."""
    by_lang: dict[str, dict[str, int]] = {}
    for lang, word, n in training_words(docs):
        by_lang.setdefault(lang, {})[word] = n
    return learn(by_lang, vocabulary(vocabulary_path))


def learn(by_lang: dict[str, dict[str, int]], vocabulary: Sequence[str]) -> Model:
    """Expectation maximisation from equal probabilities, smoothed by half a count."""
    languages, pieces = sorted(by_lang), Pieces.of(vocabulary)
    prob = np.full((len(vocabulary) + 1, max(len(languages), 1)), 1.0 / (len(vocabulary) + 1))
    for column, lang in enumerate(languages):
        words = sorted(by_lang[lang], key=lambda w: (-len(w), w))
        weight = np.array([by_lang[lang][w] for w in words], float)
        code = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32)
        length = np.array([len(w) + 1 for w in words], np.int64)
        lattice = Lattice.of(code.astype(np.uint64), length, pieces)
        for _ in range(ROUNDS):
            counts = lattice.expected_counts(weight, prob[:, column]) + 0.5
            prob[:, column] = counts / counts.sum()
    return Model(languages, pieces, prob)


def posterior(model: Model, texts: pa.Array) -> np.ndarray:
    """Posterior by text and language; a row of zeros where there are no letters."""
    words = C.words(texts)
    number, names = words.encode()
    scores = model.score_words(names)[number]
    total = np.zeros((len(number) + 1, scores.shape[1]))
    np.cumsum(scores, axis=0, out=total[1:])
    sums = total[words.first[1:]] - total[words.first[:-1]]
    logs, letters = sums[:, :-1], sums[:, -1]
    if not model.languages:
        return np.zeros((len(texts), 0))
    weight = np.exp(logs - logs.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    return np.where(letters[:, None] > 0.5, weight, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language and score of every document, from its text alone."""
    names = np.array([*model.languages, UNKNOWN], object)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        weight = posterior(model, part.column("text"))
        score = weight.max(axis=1, initial=0.0)
        best = weight.argmax(axis=1) if weight.shape[1] else np.zeros(len(weight), int)
        pred = names[np.where(score > 0, best, len(names) - 1)]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()),
             pa.array(np.minimum(score, 1.0))],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    rows = docs.select(
        "doc_id",
        (C.remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"),
        C.text_or_empty(),
    )
    return C.map_slices(rows, work, PREDICTED)


def kept_documents(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Documents in a known language with at least this score, with all their columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch):
                score = posterior(model, part.column("text")).max(axis=1, initial=0.0)
                yield part.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
