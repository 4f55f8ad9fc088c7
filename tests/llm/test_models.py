"""Language, toxicity and quality: exact parts by brute force, models on held-out rows."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from adloom.llm import language as L
from adloom.llm import quality as Q
from adloom.llm import toxicity as T

WORD = re.compile("[^\x20\x09-\x0d]+")
PIECES = P.path("piece_bpe_32k.model")


def segmentations(text, pieces, prob, unknown):
    if not text:
        return 1.0
    total = 0.0
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            total += prob[pieces.index(text[:n])] * segmentations(text[n:], pieces, prob, unknown)
        elif n == 1:
            total += unknown * segmentations(text[1:], pieces, prob, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "ba", "bab", "▁ba"]
    rng = random.Random(1)
    prob = np.array([[rng.random() * 0.1 for _ in range(2)] for _ in range(len(pieces) + 1)])
    model = L.Model(["x", "y"], L.Pieces.of(pieces), prob)
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)]
    got = model.score_words([w.encode() for w in words])
    for word, row in zip(words, got):
        want = [math.log(segmentations("▁" + word, pieces, prob[:, k], prob[-1, k])) for k in (0, 1)]
        assert np.allclose(row, [*want, len(word)])
        assert np.allclose(model.forward_long("▁" + word), want)
    long = "abcab" * 60
    cut = model.score_words([b"x1a-b", long.encode()])
    assert np.allclose(cut[0], model.score_words([b"x", b"a", b"b"]).sum(axis=0))
    assert cut[1, 2] == 300 and np.isfinite(cut[1]).all()


def test_training_raises_the_likelihood():
    pieces = ["▁", "t", "h", "e", "th", "he", "the", "▁the", "▁th"]
    words = {"the": 50, "he": 10, "then": 3}
    logs = []
    for rounds in (0, 1, 3):
        L_rounds, L.ROUNDS = L.ROUNDS, rounds
        try:
            model = L.learn({"en": words}, pieces)
        finally:
            L.ROUNDS = L_rounds
        scores = model.score_words([w.encode() for w in words])[:, 0]
        logs.append(float(scores @ np.array(list(words.values()))))
    assert logs[0] < logs[1] < logs[2]


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


SOUNDS = {"en": ["the", "ing", "er", "wh"], "fr": ["eau", "oi", "que", "é"], "de": ["sch", "ung", "ä"]}


def test_language_of_held_out_rows(as_docs):
    rng = random.Random(2)
    rows = [(g, prose(rng, SOUNDS[g], 30)) for _ in range(60) for g in SOUNDS]
    extra = [None, "", "12 !!", "THEING wher ING", "eau oi " + "q" * 5000]
    docs = as_docs([t for _, t in rows] + extra, langs=[g for g, _ in rows] + [None] * 5)
    model = L.fit(docs, PIECES)
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    held = [i for i in range(len(rows)) if got[i].held_out]
    assert held and all(got[i].lang_pred == rows[i][0] for i in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[len(rows) + k].lang_pred for k in range(4)] == ["und", "und", "und", "en"]
    kept = {r.doc_id for r in L.kept_documents(docs, model).collect()}
    assert kept >= set(range(len(rows))) and not kept & {len(rows), len(rows) + 1, len(rows) + 2}


def test_language_without_labels_or_rows(as_docs):
    docs = as_docs(["some text", None], ids=[None, 1], langs=[None, None])
    model = L.fit(docs, PIECES)
    assert [r.lang_pred for r in L.predict(docs, model).collect()] == ["und", "und"]
    assert L.predict(docs.filter("doc_id < 0"), model).count() == 0


def toxic_rows(seed, n=400):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for _ in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 200))]
        toxic = int(rng.random() < 0.4)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["qvuzkrak", "wyxbumf"]))
        rows.append((" ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows_and_misspellings():
    model = T.fit(toxic_rows(1))
    rest = toxic_rows(2, 100)
    score = T.scores(model, pa.array([t for t, _ in rest]))
    assert np.mean((score >= 0.5) == [y for _, y in rest]) > 0.95
    odd = T.scores(model, pa.array(["aeon qvuzkrack train", "aeon train stone", "", None]))
    assert odd[0] > 0.5 > odd[1] and odd[2] == odd[3]


def plain_score(model, text):
    """The score of one text, word by word."""

    def bucket(value, salt):
        return ((value + salt) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - T.BITS)

    def bag_of(word):
        marked, found = f"<{word.lower()}>", []
        for n in (3, 4, 5):
            for i in range(len(marked) - n + 1):
                value = 0
                for sign in marked[i : i + n]:
                    value = (value * 0x100000001B3 + ord(sign)) % 2**64
                found.append(bucket(value, n))
        found.append(bucket(xxhash.xxh3_64_intdigest(marked.encode()), 0))
        return found

    found = [b for w in WORD.findall(text or "") for b in bag_of(w)]
    counted = sum(model.share[b] for b in found)
    logit = sum(model.share[b] * model.weight[b] for b in found) / (counted or 1.0) + model.bias
    return 1 / (1 + math.exp(-logit))


def test_toxicity_scores_equal_a_plain_version():
    model = T.fit(toxic_rows(4, 150))
    given = [t for t, _ in toxic_rows(5, 60)] + [None, "", "x", " \n", "É qvuz", "İx", "one two three four five"]
    got = T.scores(model, pa.array(given))
    assert np.allclose(got, [plain_score(model, t) for t in given], atol=1e-9)


def test_a_repeated_id_is_learned_from_by_the_same_text(as_docs, spark):
    docs = as_docs(["b text", "a text", "b text", "c text"], ids=[1, 1, 1, 2])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    found = {tuple(T.training_rows(d, labels)) for d in (docs, docs.repartition(3), docs.orderBy("text"))}
    assert len(found) == 1


def test_shares_and_averages_of_the_sample():
    texts = [t for t, _ in toxic_rows(6, 30)]
    found = T.corpus(texts)
    bags = []
    for text in texts:
        names = [w.encode() for w in WORD.findall(text)]
        bags.append(Counter(T.subwords(names).bucket.tolist()))
    met = Counter(b for bag in bags for b in bag)
    known = sorted(b for b in met if met[b] >= T.LEAST_TEXTS)
    assert found.buckets.tolist() == known
    seen = {b: sum(bag[b] for bag in bags) for b in known}
    share = {b: T.RARE / (T.RARE + seen[b] / sum(seen.values())) for b in known}
    for i, bag in enumerate(bags):
        row, part, _ = found.batch(np.array([i]))
        total = sum(n * share.get(b, 1.0) for b, n in bag.items())
        want = {known.index(b): n * share[b] / total for b, n in bag.items() if b in share}
        assert dict(zip(row.tolist(), part.tolist())) == pytest.approx(want, rel=1e-4)


def test_toxicity_query_shape(as_docs, spark):
    docs = as_docs([t for t, _ in toxic_rows(3, 60)])
    labels = spark.createDataFrame(
        [(i, y) for i, (_, y) in enumerate(toxic_rows(3, 60))] + [(None, 1), (3, None)],
        "doc_id long, toxic int",
    )
    rows = T.training_rows(docs, labels)
    got = T.score(docs, T.fit(rows)).collect()
    assert len(got) == 60 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len(rows) == sum(not r.held_out for r in got)
    none = T.fit(T.training_rows(docs, labels.filter("false")))
    assert {r.score for r in T.score(docs, none).collect()} == {0.5}


def brute_counts(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, gram in enumerate(zip(words, words[1:], words[2:])):
        if grams[gram] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit))


def test_base_counts_equal_brute_force(as_docs):
    rng = random.Random(4)
    given = [None, "", "\n \n", "é 漢 a", "a a a a", "x y z x y z", "l\nl\n l\nl\n\n\n"]
    given += ["".join(rng.choice("ab é#|\n\t") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    rows = Q.statistics(as_docs(given), np.zeros(1 << Q.BITS, np.float32)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert [got[i] for i in range(len(given))] == [brute_counts(t) for t in given]


def test_ratio_and_verdicts(as_docs, spark):
    rng = random.Random(5)
    good = [prose(rng, SOUNDS["en"], 80) for _ in range(60)]
    junk = [" ".join(f"{w}%%%" for w in prose(rng, SOUNDS["en"], 80).split()) for _ in range(60)]
    given = [*good, *junk, None, "short text"]
    docs = as_docs(given)
    labels = spark.createDataFrame(
        [(i, int(i < 60)) for i in range(0, 120, 2)] + [(None, 1), (5, None)], "doc_id long, quality int"
    )
    model = Q.fit(docs, labels)
    grams = lambda t: [t[i : i + 4] for i in range(len(t) - 3)]
    counts = [Counter(), Counter()]
    for i, t in enumerate(given):
        for g in grams(" ".join(WORD.findall(t or "")) + " "):
            counts[0][g] += 1
            counts[1][g] += i < 60 and i % 2 == 0
    n = len(Q.ratios(docs, []))
    sizes = [sum(c.values()) + Q.SMOOTH * n for c in counts]
    some = [math.log((counts[1][g] + Q.SMOOTH) / sizes[1]) - math.log((counts[0][g] + Q.SMOOTH) / sizes[0])
            for g in grams(good[1] + " ")]
    rows = {r.doc_id: r for r in Q.judge(docs, model).collect()}
    assert rows[1].score == pytest.approx(np.mean(some), abs=0.05)
    kept = [i for i in range(len(given)) if rows[i].kept]
    assert kept == list(range(60))
    assert {r.doc_id for r in Q.kept_documents(docs, labels).collect()} == set(kept)
    assert rows[121].base_failed and not rows[121].kept
    free = Q.fit(docs, labels.filter("quality = 1"))
    assert free.threshold == -math.inf
    assert Q.judge(docs.filter("doc_id < 0"), model).count() == 0


def test_repeated_words_of_a_text_with_very_many_distinct_words():
    last = 1 << 21
    text = " ".join(map(str, range(last + 1)))
    # By numbers of 21 bits, the windows (5, 1, 2**21) and (5, 1, 0) would be one.
    text += f" 5 1 {last} 9 5 1 0"
    found = Q.C.words(pa.array([text, "a b c a b c", text + " 7 8 9 5"]))
    assert Q.repeated_words(found).tolist() == [0, 6, 6]


def test_every_labelled_document_counts(as_docs, spark):
    """More labelled documents of a kind than any fixed number that a sample would have."""
    n = 10_400
    prose = lambda word, i: " ".join(f"{word}{i * 60 + j:x}" for j in range(60))
    given = [prose("good", i) for i in range(n)] + [prose("junk", i) for i in range(60)]
    docs = as_docs(given).repartition(8)
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(len(given))], "doc_id long, quality int")
    counts = [np.bincount(Q.buckets(Q.C.words(pa.array(some)))[0], minlength=1 << Q.BITS) + Q.SMOOTH
              for some in (given, given[:n])]
    raw, good = (np.log(c / c.sum()) for c in counts)
    model = Q.fit(docs, labels)
    assert np.allclose(model.ratio, good - raw, atol=1e-5)
    scores = {r.doc_id: r.score for r in Q.statistics(docs, model.ratio).collect()}
    between = max(scores[i] for i in range(n, n + 60)), min(scores[i] for i in range(n))
    assert model.threshold == sum(between) / 2


@pytest.mark.parametrize("seed", range(4))
def test_threshold_equals_that_of_all_sorted_scores(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.gauss(kind, 1), 1 if seed else 6), kind) for kind in (0, 1) for _ in range(150)]
    best = 0.0, -math.inf
    values = sorted({score for score, _ in rows})
    for low, high in zip(values, values[1:]):
        gain = sum(s <= low and not k for s, k in rows) / 150 - sum(s <= low and k for s, k in rows) / 150
        best = max(best, (gain, (low + high) / 2), key=lambda x: x[0])
    frame = spark.createDataFrame(rows, "score double, good int").repartition(3)
    assert Q.best_threshold(frame) == best[1]
    assert Q.best_threshold(frame.filter("good = 1")) == -math.inf
    assert Q.best_threshold(frame.withColumn("score", F.lit(1.0))) == -math.inf
