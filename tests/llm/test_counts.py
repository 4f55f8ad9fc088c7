"""Token counts against the library that the vocabulary belongs to."""

import random

import pyarrow as pa
import pytest
from adloom.llm import counts
from adloom.llm.queries import WORDS
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    with open(WORDS, encoding="utf-8") as file:
        return counts.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORDS)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def texts(seed, n=1500):
    rng = random.Random(seed)
    signs = "abcdeinorstTHlvm  é\n\t#1!\'\'\'\'\xa0\u3000\x1c漢😀ΣİÅ\u0308²Ⅷ½<|>’٣"
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    special = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|endoftext|>\u0308a", "<|endoftext"]
    endings = ["it\'s", "\'re\'rex\'\'s", "don\'tt \'re \'v \'r", "\'", "\'l", "x\'ve", "\'VE", "a\'\'ll"]
    long = ["a1" * 3000, "\'" * 9000, "漢" * 6000, "x" * 10_000, " " * 100_000, "\n" * 50_000, "ab " * 20_000]
    return ["", " ", *special, *endings, *long, *made]


@pytest.mark.parametrize("chunk", [1, 7, counts.CHUNK])
def test_counts_equal_the_library(vocabulary, library, chunk):
    given = texts(chunk)
    counter = counts.Counter(vocabulary, chunk)
    assert counter.counts(pa.array(given)).tolist() == library(given)
    assert [counter.count(t) for t in given[:400]] == library(given[:400])


def test_every_token_is_its_own_encoding(vocabulary, library):
    rng = random.Random(4)
    names = rng.sample([t for t in range(512, len(vocabulary.parts))], 3000)
    machine = counts.Machine(vocabulary)

    def symbols(token):
        left, right = vocabulary.parts[token]
        return [token] if left == token else symbols(left) + symbols(right)

    for token in names:
        places = counts.NOTHING
        total = 0
        for symbol in symbols(token):
            places, settled = machine.feed(places, symbol if symbol > 511 else base(vocabulary, symbol))
            total += settled
        assert total + places[-1][2] == 1


def base(vocabulary, token):
    """The symbol of a token of one byte."""
    return next(s for s in range(512) if vocabulary.token[vocabulary.child[s]] == token)


def test_forgetting_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(counts, "CACHE", 3)
    given = texts(5, 300)
    counter = counts.Counter(vocabulary)
    counter.machine.most_states = 10
    assert counter.counts(pa.array(given)).tolist() == library(given)
    assert len(counter.known) <= 3


def test_running_counts_compose(vocabulary, library):
    text = "some words, 3 numbers and it\'s over " * 40
    counter = counts.Counter(vocabulary, 11)
    running = counter.running(text)
    assert running == sorted(running) and running[-1] == library([text])[0]
    scan = counts.prefix_scan(list("abcdefg"), lambda a, b: a + b)
    assert scan == ["a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg"]


def test_table(spark, as_docs, library):
    given = [None, *texts(6, 200), "word " * 2048, "word " * 2049]
    ids = [None, None, *range(len(given) - 3), 5]
    docs = as_docs(given, ids).withColumn("n_tokens", F.lit("clash")).repartition(3)
    whole = [t or "" for t in given]
    got = sorted(map(tuple, counts.token_counts(docs, WORDS).collect()), key=repr)
    want = [(i, len(t.encode()), n, n > 2048) for i, t, n in zip(ids, whole, library(whole))]
    assert got == sorted(want, key=repr)
    assert counts.token_counts(as_docs([]), WORDS).count() == 0
