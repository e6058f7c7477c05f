"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from barloom.llm.chat_format import LOSS_ROLE, TURN_END, TURN_START
from barloom.llm.queries import CRAFTED_ID, CRAFTED_TEXT, URL_RULES
from barloom.llm.secrets import BASE_KINDS, EXAMPLE_OWNERS, KINDS

_RULES = ", ".join(f"('{r.pattern}', '{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)

_URL_FILTER = rf"""
WITH rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
rest AS (
    SELECT row_number() OVER () AS n, page_id,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
),
parsed AS (
    SELECT n, page_id,
           translate(regexp_extract(rest, '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
),
best AS (
    SELECT n, max({{'l': length(rule), 'rule': rule, 'verdict': rule_verdict}}) AS top
    FROM parsed JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY n
),
tokens AS (
    SELECT n, unnest(list_distinct(list_concat(
               list_transform(string_split(host, '.'), lambda x: 'h:' || x),
               list_transform(string_split(path, '/'), lambda x: 'p:' || x)))) AS token
    FROM parsed
),
literals AS (
    SELECT rule, unnest(list_concat(
               list_transform(string_split(rule_host, '.'), lambda x: 'h:' || x),
               list_transform(list_filter(string_split(rule_path, '/'), lambda x: x <> ''),
                              lambda x: 'p:' || x))) AS token
    FROM rules
),
counted AS (
    SELECT rule, token, count(n) AS urls FROM literals LEFT JOIN tokens USING (token) GROUP BY ALL
),
filed AS (
    SELECT rule, arg_min(token, {{'urls': urls, 'token': token}}) AS token FROM counted GROUP BY rule
),
tried AS (SELECT n, count(*) AS n_candidates FROM tokens JOIN filed USING (token) GROUP BY n)
SELECT page_id, host, path, top.rule AS rule, coalesce(top.verdict, 'allow') AS verdict,
       coalesce(n_candidates, 0) AS n_candidates
FROM parsed LEFT JOIN best USING (n) LEFT JOIN tried USING (n)
"""

_CONTENT_SORT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""



def _kind_spans(number: int) -> str:
    """Matches and the text between them alternate: their lengths add up to the places."""
    kind = KINDS[number]
    pattern = kind.pattern.replace("'", "''")
    return f"""
    SELECT n, {number} AS kind_no, '{kind.name}' AS kind, unnest(list_transform(
        range(1, len(hits) + 1), lambda i: {{
            'start': list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                     + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0),
            'size': length(hits[i]), 'value': secret[i]}})) AS s
    FROM (SELECT n, string_split_regex(text, '{pattern}') AS gaps,
                 regexp_extract_all(text, '{pattern}', 0) AS hits,
                 regexp_extract_all(text, '{pattern}', 1) AS secret FROM docs)"""


_SECRETS = f"""
WITH docs AS (
    SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text,
           coalesce(source, '') || '/' || coalesce(lang, '') AS repo, coalesce(source, '') AS owner
    FROM documents
),
matches AS ({" UNION ALL ".join(map(_kind_spans, range(len(KINDS))))}),
spans AS (
    SELECT n, kind_no, kind, s.value AS value, s.start AS start,
           kind || ':' || s.start::BIGINT || ':' || (s.start + s.size)::BIGINT AS written
    FROM matches
    WHERE length(s.value) >= CASE kind {" ".join(f"WHEN '{k.name}' THEN {k.least}" for k in KINDS)} END
),
owned AS (
    SELECT value, count(DISTINCT owner) AS owners FROM spans JOIN docs USING (n) GROUP BY value
),
told AS (
    SELECT n,
           {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in BASE_KINDS)},
           string_agg(written, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(BASE_KINDS)}) AS base,
           string_agg(written, ',' ORDER BY start, kind_no) AS spans,
           count(*) FILTER (owners < {EXAMPLE_OWNERS}) AS n_live,
           count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_example
    FROM spans JOIN owned USING (value) GROUP BY n
)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN told USING (n)
"""

_CHAT_FORMAT = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES ({CRAFTED_ID}, 0, 'user', '{CRAFTED_TEXT}'),
                     ({CRAFTED_ID}, 1, '{LOSS_ROLE}', '{CRAFTED_TEXT}')
),
sized AS (
    SELECT *, {len(TURN_START) + 1 + len(TURN_END)}
              + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))
              + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'),
                                      '<(\\*)\|', '<\1\\|', 'g')) AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text)
                       FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _phrases(size: int) -> str:
    """Counts of the phrases of one size; those that cross a piece are not formed."""
    words = ", ".join(f"lead(word, {i}) OVER piece AS w{i}" for i in range(1, size))
    text = " || ' ' || ".join(["word", *[f"w{i}" for i in range(1, size)]])
    return f"""
    SELECT lang, {text} AS phrase, count(*) AS f
    FROM (SELECT lang, word{", " + words if words else ""} FROM words
          WINDOW piece AS (PARTITION BY d, p ORDER BY i)) GROUP BY ALL"""


_COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT d, lang, unnest(parts) AS piece, unnest(range(len(parts))) AS p
    FROM (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                 string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS parts FROM documents)
),
words AS (
    SELECT d, lang, p, unnest(found) AS word, unnest(range(len(found))) AS i
    FROM (SELECT *, regexp_extract_all(piece, '[^\x20\x09]+') AS found FROM pieces)
),
f1 AS ({_phrases(1)}), f2 AS ({_phrases(2)}), f3 AS ({_phrases(3)}),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
two AS (
    SELECT x.lang, x.phrase, x.f AS a, p.f AS l, s.f AS r
    FROM f2 x JOIN f1 p ON p.lang = x.lang AND p.phrase = split_part(x.phrase, ' ', 1)
              JOIN f1 s ON s.lang = x.lang AND s.phrase = split_part(x.phrase, ' ', 2)
    WHERE x.f >= 10
),
three AS (
    SELECT x.lang, x.phrase, x.f AS a,
           split_part(x.phrase, ' ', 1) || ' ' || split_part(x.phrase, ' ', 2) AS head,
           split_part(x.phrase, ' ', 2) || ' ' || split_part(x.phrase, ' ', 3) AS tail
    FROM f3 x WHERE x.f >= 10
),
around AS (
    SELECT lang, part, max(a) AS a
    FROM (SELECT lang, head AS part, a FROM three UNION ALL SELECT lang, tail, a FROM three) GROUP BY ALL
),
cuts AS (
    SELECT lang, phrase, a, 1 AS k, l, r FROM two
    WHERE NOT EXISTS (SELECT 1 FROM around g
                      WHERE g.lang = two.lang AND g.part = two.phrase AND 100 * g.a >= 50 * two.a)
    UNION ALL
    SELECT t.lang, t.phrase, t.a, 1, p.f, s.f
    FROM three t JOIN f1 p ON p.lang = t.lang AND p.phrase = split_part(t.phrase, ' ', 1)
                 JOIN f2 s ON s.lang = t.lang AND s.phrase = t.tail
    UNION ALL
    SELECT t.lang, t.phrase, t.a, 2, p.f, s.f
    FROM three t JOIN f2 p ON p.lang = t.lang AND p.phrase = t.head
                 JOIN f1 s ON s.lang = t.lang AND s.phrase = split_part(t.phrase, ' ', 3)
),
scored AS (
    SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
),
weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

_LEXICAL = f"""
WITH told AS (
    SELECT d, doc_id, unnest(found) AS term, len(found) AS n
    FROM (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS found FROM documents)
),
size AS (SELECT count(DISTINCT d) AS docs, count(*) AS terms FROM told),
postings AS (SELECT d, any_value(doc_id) AS doc_id, term, any_value(n) AS n, count(*) AS tf FROM told GROUP BY d, term),
weighed AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM postings, size GROUP BY term
),
asked AS (
    SELECT q, item_id, unnest(list_distinct(found)) AS term
    FROM (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER}, {_TERM}) AS found FROM benchmark)
),
scored AS (
    SELECT q, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weighed USING (term), size GROUP BY q, d
)
SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY q ORDER BY score DESC, doc_id)
QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_url_filter": _URL_FILTER,
    "op2_secret_scan": _SECRETS,
    "op7_content_sort": _CONTENT_SORT,
    "op11_chat_format": _CHAT_FORMAT,
    "op12_phrase_trie": _COLLOCATIONS,
    "op13_term_pipeline": _LEXICAL,
}
