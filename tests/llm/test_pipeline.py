"""The pipeline on a small table, stage by stage and against plain versions."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from adloom.llm import common as C
from adloom.llm.queries import REGISTRY

SOUNDS = {"en": ["the", "ing", "er", "wh", "st"], "fr": ["eau", "oi", "que", "é", "le"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(as_docs, table_of, spark):
    rng = random.Random(3)
    shared = prose(rng, "en", 60)
    texts, langs = [], []
    for i in range(40):
        lang = "en" if i % 2 else "fr"
        text = prose(rng, lang, 150)
        texts.append(f"{text} {shared} {prose(rng, lang, 20)}" if i < 4 else text)
        langs.append(lang)
    texts += [texts[30], texts[31], None, "", "too short", "again and " * 60]
    texts += [" ".join(f"{w}###" for w in prose(rng, "en", 100).split()) for _ in range(20)]
    langs += ["en"] * 26
    labels = [(i, int(i < 40)) for i in range(0, 66, 3)]
    return table_of(documents=as_docs(texts, langs=langs),
                    labels=spark.createDataFrame(labels, "doc_id long, quality int"))


def test_stages(spark, folder):
    docs = C.documents(spark, folder)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = C.staged(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.schema == C.documents(spark, folder).schema
    ids = {name: sorted(r.doc_id for r in seen[name].select("doc_id").distinct().collect()) for name in seen}
    assert ids["quality_rules"] == list(range(42)) == ids["language_id"]
    assert ids["simhash_near_dedup"] == list(range(40)) == ids["substring_dedup"]
    words = [(r.text or "").split() for r in seen["substring_dedup"].collect()]
    left = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    assert max(left.values()) == 1
    sizes = {r.doc_id: len(r.text.split()) for r in seen["substring_dedup"].collect()}
    assert all(sizes[i] == (170 if i < 4 else 150) for i in range(40))
    pieces = seen["best_fit_packing"].collect()
    assert {r.doc_id for r in pieces} == set(range(40))
    assert {(r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()} == {
        (r.doc_id, r.ids_crc32) for r in pieces
    }


def test_empty_table(spark, folder, table_of):
    docs = C.documents(spark, folder).filter("doc_id < 0")
    empty = table_of(documents=docs, labels=C.table(spark, folder, "labels").filter("false"))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(name.split("_")[0][2:]) for name in REGISTRY) == list(range(1, 14))
