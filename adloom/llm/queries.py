"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adloom.llm import common as C
from adloom.llm import (
    bpe,
    counts,
    extract,
    fingerprint,
    language,
    middle,
    packing,
    quality,
    repair,
    simhash,
    substrings,
    suffixes,
    toxicity,
)
from adloom.session import spread

#: Vocabularies of public tokenizers; every operator takes such a path as a parameter.
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir, "doc_id", "text")
    model = quality.fit(docs, C.table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.judge(docs, model)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(C.documents(spark, sf_dir, "doc_id", "text"), load_tokenizer)


def load_tokenizer() -> Callable:
    return packing.tokenizer(BPE_RANKS, public_tokenizers.PATTERN)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir, "doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs, PIECES))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(C.table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return extract.main_texts(pages, extract.fit(extract.labelled_pages()))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(C.documents(spark, sf_dir, "doc_id", "text"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir, "doc_id", "text")
    labels = C.table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.score(docs, toxicity.fit(toxicity.training_rows(docs, labels)))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(C.documents(spark, sf_dir, "doc_id", "text"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(C.documents(spark, sf_dir, "doc_id", "text"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(C.table(spark, sf_dir, "documents", "doc_id", "text"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir, "doc_id", "text")
    return bpe.encode(docs, BPE_RANKS, public_tokenizers.PATTERN)


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.digests(spread(rows))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(C.documents(spark, sf_dir, "doc_id", "text"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(C.documents(spark, sf_dir, "doc_id", "text"), WORDS)


REGISTRY: dict[str, Query] = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_language_id": language_id,
    "op3_html_extraction": html_extraction,
    "op4_substring_dedup": substring_dedup,
    "op5_toxicity": toxicity_scores,
    "op6_suffix_array_dedup": suffix_array_dedup,
    "op7_simhash_near_dedup": simhash_near_dedup,
    "op8_byte_bpe": bpe_round_trip,
    "op9_document_fingerprints": document_fingerprints,
    "op10_quality_rules": quality_rules,
    "op11_conversation_repair": conversation_repair,
    "op12_fill_in_middle": fill_in_middle,
    "op13_token_counts": token_counts,
}
# The other operators use models, tokenizers or hashes that SQL lacks, or compare so many
# byte strings that SQL is too slow; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        windows AS (
            SELECT doc_id, pos, array_to_string(words[pos : pos + 34], ' ') AS content
            FROM texts, unnest(generate_series(1, len(words) - 34)) AS t(pos)),
        repeated AS (SELECT content FROM windows GROUP BY content HAVING count(*) > 1),
        removed AS (
            SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 34)) AS pos
            FROM windows SEMI JOIN repeated USING (content)),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS content, count(*) AS n
            FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts)
            ANTI JOIN removed USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
               CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(content, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list(entry ORDER BY i) AS entries
            FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
                      CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
                  FROM range(256) AS t(i))),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(
                       string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
                                    || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                       lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
            FROM conversations),
        hit AS (
            SELECT keyed.*, xor(list_reduce([4294967295] || bytes, lambda c, b:
                       xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
            FROM keyed, crc_table),
        damaged AS (
            SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                              ELSE text END AS text,
                   unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM hit WHERE fault <> 0),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(length(role) || ':' || role || text), copy) AS p,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM damaged),
        judged AS (
            SELECT *, CASE WHEN bare = '' THEN 'blank'
                           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1
                               THEN 'duplicate'
                           WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
                   lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY p) || role[1:1] AS pair
            FROM numbered),
        moves(was, symbol, becomes) AS (
            VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        inserts(was, n, becomes) AS (
            VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (0, 2, 3), (1, 1, 2),
                   (1, 2, 3), (2, 1, 3), (2, 2, 2), (3, 1, 2), (3, 2, 3)),
        edits AS (
            SELECT i.was, symbol, 0 AS paid, i.n, 'K' AS edit, m.becomes
            FROM inserts AS i JOIN moves AS m ON i.becomes = m.was
            UNION ALL
            SELECT i.was, NULL, 1, i.n, 'R', m.becomes
            FROM inserts AS i JOIN moves AS m ON i.becomes = m.was AND m.symbol <> 's'
            UNION ALL SELECT was, NULL, 2, n, 'D', becomes FROM inserts),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        front AS (
            SELECT conv_id, 0 AS p, 0 AS state, {'cost': 0, 'audit': ''} AS best FROM ids
            UNION ALL
            SELECT f.conv_id, f.p + 1, e.becomes, min({
                'cost': f.best.cost + 5 * e.n + e.paid
                        + CASE WHEN j.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END,
                'audit': f.best.audit || repeat('I', e.n) || e.edit})
            FROM front AS f
            JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM f.conv_id AND j.p = f.p + 1
            JOIN edits AS e ON e.was = f.state AND (e.symbol IS NULL OR e.symbol = j.role[1:1])
                 AND (e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
            GROUP BY f.conv_id, f.p, e.becomes),
        ends AS (
            SELECT f.conv_id, min({'cost': f.best.cost + 5 * i.n, 'audit': f.best.audit || repeat('I', i.n)}) AS best
            FROM front AS f JOIN inserts AS i ON i.was = f.state AND i.becomes IN (0, 3)
            WHERE f.p = (SELECT count(*) FROM judged AS j WHERE j.conv_id IS NOT DISTINCT FROM f.conv_id)
            GROUP BY f.conv_id),
        signs AS (
            SELECT conv_id, best.audit AS audit, unnest(generate_series(1, length(best.audit))) AS k FROM ends),
        placed AS (
            SELECT conv_id, k, audit[k : k] AS edit,
                   length(replace(audit[1 : k], 'I', '')) AS p,
                   length(replace(audit[1 : k], 'D', '')) - length(replace(audit, 'D', '')) % 2 AS place
            FROM signs),
        repaired AS (
            SELECT s.conv_id, string_agg(
                CASE s.edit WHEN 'K' THEN j.role ELSE CASE place % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
                || ':' || CASE s.edit WHEN 'I' THEN '' ELSE j.text END, chr(10) ORDER BY k) AS content
            FROM placed AS s
            LEFT JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.p = s.p AND s.edit <> 'I'
            WHERE s.edit <> 'D' GROUP BY s.conv_id),
        counted AS (
            SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id)
        SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(e.best.cost AS BIGINT) AS cost,
               e.best.audit AS audit, sha256(coalesce(content, '')) AS repaired_sha256
        FROM ends AS e
        LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
        LEFT JOIN repaired AS r ON r.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op12_fill_in_middle": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(
                       coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                   sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
            FROM documents),
        drawn AS (
            SELECT *, len(units) AS n, CAST('0x' || hash[1:8] AS BIGINT) AS h1,
                   CAST('0x' || hash[9:16] AS BIGINT) AS h2, CAST('0x' || hash[17:24] AS BIGINT) AS h3,
                   CAST('0x' || hash[25:32] AS BIGINT) AS h4
            FROM texts),
        cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                             OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn),
        parts AS (
            SELECT *, array_to_string(units[1 : a], '') AS prefix,
                   array_to_string(units[a + 1 : b], '') AS middle,
                   array_to_string(units[b + 1 :], '') AS suffix
            FROM cut)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
               CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
}
