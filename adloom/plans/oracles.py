"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from types import SimpleNamespace

from adloom.functions.text import BLANKS
from adloom.plans import fixtures as T

AS_OF = f"TIMESTAMP '{T.AS_OF}'"
EARLIER = f"TIMESTAMP '{T.EARLIER}'"
CUTOFF = "TIMESTAMP '2024-01-30 00:00:00'"
WINDOW = "TIMESTAMP '2024-01-28 12:34:56'"
BLANK_SQL = " || ".join(f"chr({ord(c)})" for c in BLANKS)
SHOWN = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
NL = "chr(10)"


def _ago(minutes: str) -> str:
    return f"{AS_OF} - to_minutes({minutes})"


# The rules of topic D with the classes written out.
CLASSES_D = SimpleNamespace(
    name="topic_d",
    likes=(
        r"\p{L}{9,12}[!-/:-@\[-`{-~]",
        r"[ \t\n\x0b\f\r](?:and|an|a)+t",
        r"[\p{L}\p{N}_]+[ \t\n\x0b\f\r]th?\p{L}+ly",
    ),
    dislikes=(
        r"[ \t\n\x0b\f\r]q[\p{L}\p{N}]{3}[^\n\p{L}\p{N}]",
        r"[ \t]+\p{L}+[0-9]+",
    ),
)
# The rules of topic C, with the alternatives written out by falling length.
LONGEST_C = T.RuleSet(
    "topic_c",
    (
        "thereation|theation|thation|thereat|therea|there|theat|that|thea|the|tha|th",
        "(que|qu|q)*aux",
    ),
    ("(and|an|a)+t",),
)


def _letters(text: str) -> str:
    return f"regexp_replace({text}, '[^\\p{{L}}]+', '', 'g')"


def _sig(text: str) -> str:
    return f"md5({_letters(text)})"


def _lines(text: str) -> str:
    """Clean lines, each with a newline."""
    trimmed = f"list_transform(string_split({text}, {NL}), lambda x: trim(x, {BLANK_SQL}))"
    kept = f"list_filter({trimmed}, lambda x: x <> '')"
    return f"coalesce(array_to_string(list_transform({kept}, lambda x: x || {NL}), ''), '')"


def _decode(text: str) -> str:
    for entity, char in (
        ("&quot;", '"'),
        ("&copy;", "©"),
        ("&middot;", "·"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&#39;", "''"),
        ("&amp;", "&"),
    ):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def _nodes(part: str) -> str:
    found = f"regexp_extract_all({part}, '>([^<]+)', 1)"
    return f"list_transform({found}, lambda x: {_decode('x')})"


TITLE_TEXT = _decode("regexp_extract(html, '<title>([^<]*)</title>', 1)")
TITLE_BLOCK = _lines(f"CASE WHEN length({TITLE_TEXT}) > 3 THEN {TITLE_TEXT} ELSE '' END")
ARTICLE = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"
ARTICLE_NODES = _nodes(ARTICLE)
ARTICLE_TEXT = (
    f"coalesce(array_to_string(list_filter({ARTICLE_NODES}, lambda x: length(x) > 3), ''), '')"
)
PAGE_TEXT = f"{TITLE_BLOCK} || {NL} || {_lines(ARTICLE_TEXT)} || {NL}"

# A valid absolute URL of the test pages has no fragment.
ABSOLUTE = "regexp_matches(url, '^https?://[!$&-;=?-Z_a-z~]+$')"
VALID_HREF = "regexp_full_match(href, '/[!$&-;=?-Z_a-z~]*')"
PREFIX = "regexp_extract(url, '^https?://[^/]+', 0)"
STATUS = (
    "CASE WHEN contains(url, 'spam-farm') THEN 404"
    " WHEN contains(url, 'cheap-pills') THEN 500 ELSE 200 END"
)

HREFS = """hrefs AS (
    SELECT page_id, url, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS pos,
           unnest(found) AS href
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages)
)"""
LINKS = f"""{HREFS}, links AS (
    SELECT page_id, url AS page_url, pos, href, {PREFIX} || href AS link
    FROM hrefs WHERE {VALID_HREF}
)"""
URL_T = f"""url_t AS (
    SELECT url, {_ago("page_id * 17")} AS ts,
           CASE WHEN suffix(url, '.html') THEN 1 ELSE 0 END AS visited FROM pages
)"""
CONTENT_T = f"""content_t AS (
    SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS content,
           {_ago("page_id * 17")} AS ts
    FROM pages WHERE starts_with(url, 'http://')
)"""
ADS = f"""ads AS (
    SELECT doc_id, '{T.ADS}a/' || doc_id AS url, text AS content,
           {_ago("doc_id * 7")} AS ts, {_sig("text")} AS sig FROM documents
)"""
SNAPSHOT = f"""{ADS}, known AS (
    SELECT sig, url AS recent_url, ts FROM ads WHERE doc_id % 2 = 0
    QUALIFY row_number() OVER (PARTITION BY sig ORDER BY ts DESC, url DESC) = 1
)"""
TITLES_T = f"""titles_t AS (
    SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS content,
           {_ago("page_id * 17")} AS ts
    FROM pages
)"""
# Text of an ad page under the default axes: title, body, attribute table, second site.
AD_TEXT = (
    f"'Listing' || {NL} || {NL} || "
    + _lines("CASE WHEN length(content) > 3 THEN content ELSE '' END")
    + f" || {NL} || CASE WHEN doc_id % 2 = 0 THEN '2024 ' || doc_id || ' (+)' || {NL} ELSE '' END"
    + f" || {NL} || CASE WHEN doc_id % 3 = 0 THEN '+48 ' || doc_id || ' 000' || {NL} ELSE '' END || {NL}"
)


def _matches(patterns: tuple[str, ...], text: str = "content") -> str:
    found = ", ".join(
        f"CASE WHEN regexp_matches({text}, '{p}', 'i') THEN regexp_extract({text}, '{p}', 0, 'i') END"
        for p in patterns
    )
    return f"list_filter([{found}], lambda x: x IS NOT NULL)"


def _judged(source: str, topic: T.RuleSet, text: str = "content") -> str:
    """Subquery adding rule_set, verdict and the list ``matches``."""
    return f"""(
        SELECT * EXCLUDE (likes, dislikes), '{topic.name}' AS rule_set,
               CASE WHEN len(likes) = 0 THEN 'unmatched' WHEN len(dislikes) = 0 THEN 'liked'
                    ELSE 'disliked' END AS verdict,
               CASE WHEN len(likes) = 0 OR len(dislikes) = 0 THEN likes ELSE dislikes END AS matches
        FROM (SELECT *, {_matches(topic.likes, text)} AS likes,
                     {_matches(topic.dislikes, text)} AS dislikes FROM {source})
    )"""


MATCHES = "coalesce(array_to_string(matches, '|'), '') AS matches"
NOTE = "coalesce(array_to_string(matches, ' '), '')"


def _last_liked(judged: str) -> str:
    return f"""(
        SELECT rule_set, md5(content) AS content_hash, url, content, {NOTE} AS note, ts
        FROM {judged} WHERE verdict = 'liked'
        QUALIFY row_number() OVER (PARTITION BY rule_set, content_hash ORDER BY ts DESC, url DESC) = 1
    )"""


LIKED_T = _last_liked(_judged("ads", T.TOPIC_A))
LINE = (
    "printf('<p><a href=''%s''>%s (%s)</a>', url, substr(content, 0, 80), substr(note, 0, 30))"
)


def _escape(text: str) -> str:
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ("''", "&#39;"),
        ('"', "&quot;"),
    ):
        text = f"replace({text}, '{char}', '{entity}')"
    return text


ESCAPED_LINE = (
    f"'<p><a href=''' || {_escape('url')} || '''>' || {_escape('substr(content, 0, 80)')}"
    f" || ' (' || {_escape('substr(note, 0, 30)')} || ')</a>'"
)


def _digest(liked: str) -> str:
    return (
        f"SELECT {LINE} AS line, max(ts) AS ts FROM {liked} WHERE ts > {WINDOW} GROUP BY 1"
    )


# Both collect runs over ads: contents c1 and c2, queue b1 and b2, signatures d1 and d2.
COLLECTED = f"""{ADS}, texts AS (SELECT url, doc_id, {AD_TEXT} AS content FROM ads),
    signed AS (SELECT url, content, doc_id, {_sig("content")} AS sig FROM texts),
    c1 AS (SELECT url, content, sig, {EARLIER} AS ts FROM signed WHERE doc_id % 2 = 0),
    d1 AS (SELECT sig, max(url) AS recent_url FROM c1 GROUP BY sig),
    f2 AS (SELECT * FROM signed WHERE doc_id % 2 <> 0),
    c2 AS (SELECT url, content, sig, {AS_OF} AS ts FROM f2 ANTI JOIN d1 USING (sig)),
    d2 AS (SELECT sig, max(url) AS recent_url FROM c2 GROUP BY sig),
    collected AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
    dupes AS (SELECT * FROM d2 UNION ALL SELECT * FROM d1)"""

_PATH = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"
_DIR = f"regexp_replace({_PATH}, '[^/]*$', '')"
_PARENT = f"regexp_replace({_DIR}, '[^/]+/$', '')"
_FORMS = [
    f"{PREFIX} || {_DIR} || page_id",
    f"{PREFIX} || {_DIR} || page_id || '/'",
    f"{PREFIX} || {_PARENT} || page_id || '?x=1'",
    f"{PREFIX} || '/' || page_id",
    f"{PREFIX} || {_PATH} || '?p=' || page_id",
    "regexp_replace(url, '#.*$', '') || '#s' || page_id",
    f"regexp_extract(url, '^https?:', 0) || '//other.example.org/' || page_id",
    f"{PREFIX} || '/a/'",
    "'mailto:' || page_id || '@example.org'",
]

ORACLES: dict[str, str] = {
    "q_fetch_rejects": f"""
        SELECT url, CASE WHEN NOT {ABSOLUTE} THEN 'not an absolute URI: ' || url
                         ELSE 'HTTP status ' || {STATUS} END AS reason
        FROM pages WHERE NOT {ABSOLUTE} OR {STATUS} <> 200""",
    "q_safe_map": """
        SELECT count(n) AS n_ok, CAST(sum(n) AS BIGINT) AS total,
               count(*) - count(n) AS n_failed
        FROM (SELECT CAST(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS BIGINT) AS n
              FROM pages)""",
    "q_store_urls": f"""
        WITH {LINKS}
        SELECT DISTINCT link AS url, '{T.AS_OF}' AS ts, 0 AS visited FROM links
        WHERE link NOT IN (SELECT link FROM links WHERE starts_with(page_url, 'http://'))""",
    "q_store_urls_counts": f"""
        WITH {LINKS}
        SELECT count(DISTINCT link) FILTER (link NOT IN
                   (SELECT link FROM links WHERE starts_with(page_url, 'http://'))) AS n_new,
               count(*) AS n_input FROM links""",
    "q_store_content": f"""
        WITH {ADS}, keyed AS (
            SELECT '{T.ADS}t/' || sig AS url, md5(content) AS content, ts, doc_id % 2 <> 0 AS late
            FROM ads)
        SELECT url, content, {SHOWN} FROM keyed
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY late, keyed.ts, content) = 1""",
    "q_upsert_signatures": f"""
        WITH {ADS}, kept AS (
            SELECT sig, url AS recent_url, ts, 0 AS step FROM ads WHERE doc_id % 2 <> 0
            QUALIFY row_number() OVER (PARTITION BY sig ORDER BY ts, url) = 1
            UNION ALL SELECT sig, url, ts, 1 FROM ads WHERE doc_id % 2 = 0)
        SELECT sig, recent_url, {SHOWN} FROM kept QUALIFY row_number() OVER
            (PARTITION BY sig ORDER BY step DESC, kept.ts DESC, recent_url DESC) = 1""",
    "q_store_liked": f"""
        WITH {ADS} SELECT content_hash, url, note, {SHOWN} FROM {LIKED_T}""",
    "q_mark_visited": f"""
        WITH {URL_T}, {CONTENT_T}
        SELECT url, {SHOWN}, CASE WHEN url IN (SELECT url FROM content_t) THEN 1
                                  ELSE visited END AS visited FROM url_t""",
    "q_mark_visited_counts": """
        WITH given AS (
            SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '[?#].*', '') FROM pages)
        SELECT url, CASE WHEN url IN (SELECT url FROM pages) THEN 1 ELSE 0 END AS changed
        FROM given""",
    "q_seed_listings": """
        WITH templates AS (
            SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/[a-z]+/', 0) || 'page-' AS stem
            FROM pages)
        SELECT CAST(n AS INTEGER) AS page_no, stem || n AS url
        FROM templates, generate_series(1, 3) AS s(n)""",
    "q_hrefs": f"WITH {HREFS} SELECT page_id, pos, href FROM hrefs",
    "q_links_class": f"""
        WITH {HREFS}
        SELECT page_id, 1 AS selector_no,
               CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos,
               href
        FROM hrefs WHERE regexp_matches(href, '^/[a-m]')""",
    "q_links_descendant": f"WITH {HREFS} SELECT page_id, pos, href FROM hrefs",
    "q_all_hrefs": f"""
        WITH {HREFS}
        SELECT page_id, CAST(n AS INTEGER) AS selector_no, pos, href
        FROM hrefs, generate_series(0, 1) AS s(n)""",
    "q_valid_hrefs": f"WITH {LINKS} SELECT page_id, pos, href FROM links",
    "q_resolve_links": f"WITH {LINKS} SELECT page_id, pos, link FROM links",
    "q_resolve_forms": "\nUNION ALL\n".join(
        f"SELECT page_id, {n} AS form, {link} AS link FROM pages" for n, link in enumerate(_FORMS)
    ),
    "q_reject_urls": f"SELECT url FROM pages WHERE NOT {ABSOLUTE}",
    "q_url_prefix": f"SELECT page_id, {PREFIX} AS prefix, {PREFIX} AS bare FROM pages",
    "q_page_title": f"SELECT page_id, {TITLE_BLOCK} || {NL} AS content FROM pages",
    "q_text_nodes": f"""
        SELECT page_id, CAST(len({ARTICLE_NODES}) AS BIGINT) AS n_nodes, {ARTICLE_TEXT} AS text
        FROM pages""",
    "q_clean_lines": f"SELECT doc_id, {_lines('text')} AS lines FROM documents",
    "q_page_text": f"SELECT page_id, {PAGE_TEXT} AS content FROM pages",
    "q_ad_text": f"WITH {ADS} SELECT doc_id AS page_id, {AD_TEXT} AS content FROM ads",
    "q_purify": f"SELECT doc_id, {_letters('text')} AS letters FROM documents",
    "q_signatures": f"SELECT doc_id, {_sig('text')} AS sig FROM documents",
    "q_exact_dups": """
        SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id
        FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "q_dup_clusters": f"""
        SELECT {_sig("text")} AS sig, count(*) AS n, min(doc_id) AS first_id,
               max(doc_id) AS last_id
        FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "q_recent_signatures": f"""
        WITH {ADS}, current AS (
            SELECT sig, url AS recent_url, ts FROM ads
            QUALIFY row_number() OVER (PARTITION BY sig ORDER BY ts DESC, url DESC) = 1)
        SELECT sig, recent_url, {SHOWN} FROM
            (SELECT * FROM current ORDER BY ts DESC, sig LIMIT 50)""",
    "q_admit": f"""
        WITH {SNAPSHOT}
        SELECT doc_id, sig FROM ads WHERE doc_id % 2 <> 0 AND sig NOT IN (SELECT sig FROM known)""",
    "q_dup_audit": f"""
        WITH {SNAPSHOT}
        SELECT a.doc_id, a.url, a.sig, s.recent_url FROM ads a JOIN known s USING (sig)
        WHERE a.doc_id % 2 <> 0""",
    "q_admit_strict": f"""
        WITH {SNAPSHOT}
        SELECT doc_id, sig FROM ads WHERE doc_id % 2 <> 0 AND sig NOT IN (SELECT sig FROM known)
        QUALIFY row_number() OVER (PARTITION BY sig ORDER BY ts, doc_id) = 1""",
    "q_admit_batches": f"""
        WITH batches AS (SELECT doc_id, doc_id // 250 AS batch, {_sig("text")} AS sig FROM documents)
        SELECT doc_id, batch, sig FROM batches
        QUALIFY batch = min(batch) OVER (PARTITION BY sig)""",
    "q_recently_fetched": f"""
        WITH {TITLES_T} SELECT url FROM titles_t ORDER BY ts DESC, url LIMIT 50""",
    "q_backlog": f"""
        WITH {URL_T}, {CONTENT_T}
        SELECT url, {SHOWN} FROM (
            SELECT url, ts FROM url_t WHERE visited <> 1 AND url NOT IN (SELECT url FROM content_t)
            ORDER BY ts, url LIMIT 50)""",
    "q_new_urls": f"""
        WITH {URL_T}, {CONTENT_T},
        known AS (SELECT url FROM url_t WHERE contains(url, '#')),
        queue AS (
            SELECT url FROM url_t WHERE visited <> 1 AND url NOT IN (SELECT url FROM content_t))
        SELECT url FROM queue WHERE url NOT IN (SELECT url FROM known)""",
    "q_backlog_advice": f"""
        WITH {URL_T}, {CONTENT_T},
        known AS (SELECT url FROM url_t WHERE contains(url, '#')),
        queue AS (
            SELECT url FROM url_t WHERE visited <> 1 AND url NOT IN (SELECT url FROM content_t)),
        counts AS (
            SELECT count(*) AS n_backlog,
                   count(*) FILTER (url NOT IN (SELECT url FROM known)) AS n_new FROM queue)
        SELECT n_backlog, n_new, CASE WHEN n_new = 0 THEN 'none' WHEN n_new = n_backlog
               THEN 'all new' ELSE 'some known' END AS advice FROM counts""",
    "q_recent_content": f"""
        WITH {TITLES_T} SELECT url, content, {SHOWN} FROM titles_t
        WHERE titles_t.ts >= {CUTOFF}""",
    "q_mode_list": f"WITH {ADS} SELECT url FROM ads WHERE ts >= {CUTOFF}",
    "q_rule_matches": f"""
        WITH {ADS}
        SELECT doc_id, coalesce(array_to_string({_matches(T.TOPIC_A.likes)}, '|'), '') AS likes,
               coalesce(array_to_string({_matches(T.TOPIC_A.dislikes)}, '|'), '') AS dislikes
        FROM ads""",
    "q_classify": f"""
        WITH {ADS} SELECT doc_id, verdict, {MATCHES} FROM {_judged("ads", T.TOPIC_A)}""",
    "q_classify_multi": f"""
        WITH {ADS}
        SELECT doc_id, rule_set, verdict, {MATCHES} FROM {_judged("ads", T.TOPIC_A)}
        UNION ALL
        SELECT doc_id, rule_set, verdict, {MATCHES} FROM {_judged("ads", T.TOPIC_B)}""",
    "q_verdict_counts": f"""
        WITH {ADS}
        SELECT rule_set, verdict, count(*) AS n FROM (
            SELECT rule_set, verdict FROM {_judged("ads", T.TOPIC_A)}
            UNION ALL SELECT rule_set, verdict FROM {_judged("ads", T.TOPIC_B)})
        GROUP BY 1, 2""",
    "q_liked_notes": f"""
        WITH {ADS}
        SELECT doc_id, md5(content) AS content_hash, {NOTE} AS note
        FROM {_judged("ads", T.TOPIC_A)} WHERE verdict = 'liked'""",
    "q_negative_audit": f"""
        WITH {ADS}
        SELECT url, {MATCHES} FROM {_judged("ads", T.TOPIC_A)} WHERE verdict <> 'liked'""",
    "q_rule_longest": f"""
        WITH {ADS}
        SELECT doc_id, verdict, {MATCHES} FROM {_judged("ads", LONGEST_C)}""",
    "q_rule_classes": f"""
        WITH {ADS}, spaced AS (SELECT * REPLACE (replace(content, ' t', chr(160) || 't') AS content) FROM ads)
        SELECT doc_id, verdict, {MATCHES} FROM {_judged("spaced", CLASSES_D)}""",
    "q_classify_many": f"""
        WITH {ADS}, numbered AS (
            SELECT (instr('bcdfghklmnprstvz', c) - 1) * 5 + instr('aeiou', v) - 1 AS i, c || v AS s
            FROM (SELECT unnest(string_split('bcdfghklmnprstvz', '')) AS c),
                 (SELECT unnest(string_split('aeiou', '')) AS v)),
        rules AS (
            SELECT b.i * 80 + a.i AS n, a.s || b.s AS head, x.s AS one, y.s AS two
            FROM numbered AS a, numbered AS b
            JOIN numbered AS x ON x.i = (a.i + b.i) % 80
            JOIN numbered AS y ON y.i = (a.i + 3 * b.i + 7) % 80
            WHERE b.i * 80 + a.i < 5000),
        folded AS (SELECT doc_id, content, lower(content) AS low FROM ads),
        hits AS (
            SELECT doc_id, n // 2500 AS part, n % 2500 < 2000 AS likes, n,
                   regexp_extract(content, head || '(' || one || '|' || two || ')', 0, 'i') AS found
            FROM folded JOIN rules ON contains(low, head) AND (contains(low, head || one) OR contains(low, head || two))),
        listed AS (
            SELECT doc_id, part, coalesce(list(found ORDER BY n) FILTER (likes), []) AS likes,
                   coalesce(list(found ORDER BY n) FILTER (NOT likes), []) AS dislikes
            FROM hits GROUP BY doc_id, part),
        judged AS (
            SELECT a.doc_id, CASE p.part WHEN 0 THEN 'many_a' ELSE 'many_b' END AS rule_set,
                   coalesce(likes, []) AS likes, coalesce(dislikes, []) AS dislikes
            FROM ads AS a, (SELECT unnest([0, 1]) AS part) AS p
            LEFT JOIN listed AS l ON l.doc_id = a.doc_id AND l.part = p.part)
        SELECT doc_id, rule_set,
               CASE WHEN len(likes) = 0 THEN 'unmatched' WHEN len(dislikes) = 0 THEN 'liked' ELSE 'disliked' END AS verdict,
               coalesce(array_to_string(
                   CASE WHEN len(likes) = 0 OR len(dislikes) = 0 THEN likes ELSE dislikes END, '|'), '') AS matches
        FROM judged""",
    "q_mode_match": f"""
        SELECT conv_id, turn, verdict, {MATCHES}
        FROM {_judged("conversations", T.TOPIC_B, "text")}""",
    "q_report": f"""
        WITH {ADS} SELECT line, {SHOWN} FROM ({_digest(LIKED_T)})""",
    "q_report_escaped": f"""
        WITH {ADS} SELECT DISTINCT {ESCAPED_LINE} AS line FROM {LIKED_T} WHERE ts > {WINDOW}""",
    "q_report_clip": f"""
        WITH {ADS}
        SELECT doc_id, substr(content, 0, 80) AS clip, substr(url, 0, 30) AS note_clip FROM ads""",
    "q_report_html": f"""
        WITH {ADS} SELECT line AS value FROM ({_digest(LIKED_T)})
        UNION ALL SELECT '<html><head><meta charset="utf-8"></head><body>'
        UNION ALL SELECT '</body></html>'""",
    "q_mode_links": f"""
        WITH {LINKS}
        SELECT url, 0 AS selector_no, pos, link FROM (SELECT *, page_url AS url FROM links)
        WHERE {ABSOLUTE} AND {STATUS} = 200""",
    "q_mode_browse": f"""
        WITH {LINKS}, usable AS (
            SELECT link, url FROM (SELECT *, page_url AS url FROM links)
            WHERE {ABSOLUTE} AND {STATUS} = 200)
        SELECT DISTINCT link AS url, '{T.AS_OF}' AS ts FROM usable
        WHERE link NOT IN (SELECT link FROM usable WHERE starts_with(url, 'http://'))""",
    "q_browse_counts": f"""
        WITH {LINKS}, usable AS (
            SELECT link, starts_with(url, 'http://') AS early
            FROM (SELECT *, page_url AS url FROM links) WHERE {ABSOLUTE} AND {STATUS} = 200),
        urls AS (SELECT link, bool_or(early) AS early FROM usable GROUP BY 1)
        SELECT 1 AS run, (SELECT count(*) FROM urls WHERE early) AS n_new,
               (SELECT count(*) FROM urls WHERE early) AS n_distinct,
               (SELECT count(*) FROM usable WHERE early) AS n_input
        UNION ALL
        SELECT 2, (SELECT count(*) FROM urls WHERE NOT early), (SELECT count(*) FROM urls),
               (SELECT count(*) FROM usable)""",
    "q_mode_fetch": f"""
        SELECT url, {PAGE_TEXT} AS content FROM pages WHERE {ABSOLUTE} AND {STATUS} = 200""",
    "q_mode_collect": f"WITH {COLLECTED} SELECT url, content, {SHOWN} FROM collected",
    "q_mode_collect_fetches": f"""
        WITH {ADS}
        SELECT url, 'stored' AS outcome FROM ads WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0
        UNION ALL
        SELECT url, 'HTTP status 500' FROM ads WHERE doc_id % 5 = 0 OR doc_id % 7 = 0
        UNION ALL SELECT url, 'no body' FROM ads WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0""",
    "q_mode_collect_audit": f"""
        WITH {COLLECTED} SELECT f.url, f.sig, d.recent_url FROM f2 f JOIN d1 d USING (sig)""",
    "q_state_views": f"""
        WITH {COLLECTED}
        SELECT 1 AS visited, c.url IS NOT NULL AS collected, count(*) AS n,
               count(DISTINCT d.sig) AS n_signatures
        FROM texts t LEFT JOIN collected c USING (url) LEFT JOIN dupes d ON d.recent_url = t.url
        GROUP BY ALL""",
    "q_mode_search": f"""
        WITH {ADS}, recent AS (SELECT * FROM ads WHERE ts >= {CUTOFF})
        SELECT rule_set, content_hash, url, content, note, '{T.AS_OF}' AS ts
        FROM {_last_liked(_judged("recent", T.TOPIC_A))}
        UNION ALL
        SELECT rule_set, content_hash, url, content, note, '{T.AS_OF}' AS ts
        FROM {_last_liked(_judged("recent", T.TOPIC_B))}""",
    "q_full_cycle": f"""
        WITH {COLLECTED},
        liked AS (SELECT * REPLACE ({AS_OF} AS ts)
                  FROM {_last_liked(_judged("collected", T.TOPIC_A))})
        SELECT line, {SHOWN} FROM ({_digest("liked")})""",
    "q_stream_collect": f"""
        WITH {COLLECTED}
        SELECT url, content, '{T.AS_OF}' AS ts FROM collected""",
    "q_stream_after_batch": f"""
        WITH {ADS}, texts AS (
            SELECT url, content AS raw, doc_id % 3 AS step, {AD_TEXT} AS content FROM ads),
        signed AS (SELECT url, step, content, {_sig("content")} AS sig FROM texts)
        SELECT url, content,
               CASE step WHEN 0 THEN '{T.EARLIER}' ELSE '{T.AS_OF}' END AS ts
        FROM signed QUALIFY step = min(step) OVER (PARTITION BY sig)""",
    "q_stream_after_compaction": f"""
        WITH {ADS}, texts AS (
            SELECT url, content AS raw, doc_id % 4 AS step, {AD_TEXT} AS content FROM ads),
        signed AS (SELECT url, step, content, {_sig("content")} AS sig FROM texts)
        SELECT url, content,
               CASE step WHEN 0 THEN '{T.EARLIER}' ELSE '{T.AS_OF}' END AS ts
        FROM signed QUALIFY step = min(step) OVER (PARTITION BY sig)""",
    "q_stream_classify": f"""
        WITH {ADS} SELECT doc_id, verdict, {MATCHES} FROM {_judged("ads", T.TOPIC_A)}""",
    "q_stream_dedup": f"""
        WITH {ADS}, parts AS (
            SELECT *, doc_id >= top // 4 AS p1, doc_id >= top * 2 // 4 AS p2,
                   doc_id >= top * 3 // 4 AS p3
            FROM ads, (SELECT max(doc_id) + 1 AS top FROM documents))
        SELECT doc_id, sig FROM parts QUALIFY row_number() OVER
            (PARTITION BY sig ORDER BY p1, p2, p3, parts.ts, url) = 1""",
}
