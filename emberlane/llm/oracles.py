"""DuckDB SQL for the operators that SQL expresses over whole tables."""

from __future__ import annotations

from math import ceil

from .licenses import license_words, step_of
from .queries import LICENSE_PHRASES, LICENSE_TEMPLATES, LISTED_HOSTS, URL_RULES

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOW.format("coalesce(text, '')")

OP1 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS l FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) > 1 THEN list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) ELSE l END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.d),
 m AS (SELECT d, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM m LEFT JOIN n ON doc_id = d WHERE doc_id IS NOT NULL
UNION ALL SELECT d, 0, c, d = c FROM m WHERE d NOT IN (SELECT doc_id FROM n)"""

OP4 = """WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn - 1 AS turn, turn AS ra, text AS content FROM conversations WHERE role = 'assistant'),
 g AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS g FROM c),
 v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, g ORDER BY turn) - 1 AS level FROM g),
 l AS (SELECT v.conv_id, v.turn, v.conv_id || ':' || v.turn AS call_id, 'reply' AS name, level::INT AS level, ra, text, content, CASE WHEN length(text) < 20 THEN '$.prompt: too short' END AS problem FROM v LEFT JOIN r USING (conv_id, turn))
SELECT conv_id, turn, call_id, name, level, CASE WHEN ra IS NULL THEN 'unanswered' WHEN problem IS NOT NULL THEN 'invalid' ELSE 'linked' END AS status, problem,
 '{"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"call_id":"' || call_id || '","level":' || level || ',"name":"reply"' || CASE WHEN ra IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END || '}' AS line FROM l
UNION ALL
SELECT conv_id, ra, conv_id || ':' || turn, NULL, NULL, 'orphan', NULL, '{"call_id":"' || conv_id || ':' || turn || '","result":' || to_json(content)::VARCHAR || '}' FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.turn = r.turn)
UNION ALL
SELECT conv_id, turn, NULL, role, NULL, 'message', NULL, '{' || coalesce('"name":' || to_json(role)::VARCHAR || CASE WHEN text IS NULL THEN '' ELSE ',' END, '') || coalesce('"result":' || to_json(text)::VARCHAR, '') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""


def _rule(what: int) -> str:
    cases = "".join(
        f" WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN '{(host + path, verdict)[what]}'"
        for verdict, host, path in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE{cases} END"


OP6 = rf"""WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
 h AS (SELECT page_id, coalesce({_LOW.format("regexp_extract(r, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path,
   list_sort(list_filter(string_split(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM p),
 k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS key FROM h),
 j AS (SELECT *, coalesce(key IN (SELECT key FROM k WHERE key IS NOT NULL AND regexp_matches(host, '{LISTED_HOSTS}')), false) AS in_list FROM k)
SELECT page_id, host, path, {_rule(0)} AS rule, coalesce({_rule(1)}, CASE WHEN in_list THEN 'block' ELSE 'allow' END) AS verdict, in_list FROM j"""


def _op9() -> str:
    """Blocks of two steps begin at every step; the last begins before the last step."""
    sets = [sorted({w.decode() for w in license_words(text)}) for _, text in LICENSE_TEMPLATES]
    words = ", ".join(f"({k}, '{LICENSE_TEMPLATES[k][0]}', '{w}', {len(s)}, {ceil(0.9 * len(s) - 1e-9)}, {step_of(LICENSE_TEMPLATES[k][1])})" for k, s in enumerate(sets) for w in s)
    phrases = ", ".join(f"({k}, '{label}', {phrase.split()!r}, {len(phrase.split())})" for k, (phrase, label) in enumerate(LICENSE_PHRASES.items()))
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
 t(t, label, word, n, least, step) AS (VALUES {words}), f(f, label, ws, k) AS (VALUES {phrases}),
 p AS (SELECT doc_id, l, len(l) AS n, generate_subscripts(l, 1) AS i, unnest(l) AS word FROM w),
 b AS (SELECT doc_id, i - 1 AS pos, f.label FROM p JOIN f ON word = ws[1] AND l[i:i + k - 1] = ws),
 bb AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS base FROM b GROUP BY 1),
 k AS (SELECT doc_id, p.n, t, label, word, t.n AS tn, least, step, unnest([(i - 1) // step, (i - 1) // step - 1]) AS block FROM p JOIN t USING (word)),
 v AS (SELECT doc_id, block, step, t, label, tn, count(DISTINCT word) AS c FROM k WHERE block = 0 OR block > 0 AND block * step < n - step GROUP BY 1, 2, 3, 4, 5, 6, least HAVING count(DISTINCT word) >= least),
 vv AS (SELECT doc_id, list(DISTINCT label) AS met, max(c / tn) AS best, count(DISTINCT (block, step)) AS n_blocks FROM v GROUP BY 1)
SELECT w.doc_id, len(l) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM w LEFT JOIN bb ON bb.doc_id = w.doc_id LEFT JOIN vv ON vv.doc_id = w.doc_id"""


#: Targets rise with a common level until they meet their cap: the capped sources
#: are those of the least cap for their weight, as many as the level asks for.
OP11 = r"""WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
 w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM w),
 p AS (SELECT k, source_size, weight, coalesce(sum(source_size) OVER b, 0)::BIGINT AS capped, sum(weight) OVER r AS rest, sum(source_size) OVER ()::BIGINT AS total
   FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 l AS (SELECT (1.5::DOUBLE * total - 2.0::DOUBLE * capped) / rest AS level FROM p WHERE weight * ((1.5::DOUBLE * total - 2.0::DOUBLE * capped) / rest) <= 2.0::DOUBLE * source_size ORDER BY k LIMIT 1),
 t AS (SELECT source, source_size, CASE WHEN weight * level > 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE weight * level END AS target FROM w CROSS JOIN l),
 u AS (SELECT doc_id, size, source_size, target, least(2.0::DOUBLE, coalesce(target / nullif(source_size, 0), 0.0::DOUBLE)) AS rate,
   ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, ':' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u"""


def _terms(text: str) -> str:
    return rf"regexp_extract_all({_LOW.format(text)}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


OP13 = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_terms("coalesce(text, '')")} AS l FROM documents),
 g AS (SELECT count(*) AS nn, sum(len(l))::BIGINT AS ll FROM d WHERE len(l) > 0),
 i AS (SELECT item, item_id, unnest(l) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_terms("coalesce(text, '')")} AS l FROM benchmark)),
 q AS (SELECT item, item_id, term, count(*) AS times FROM i GROUP BY 1, 2, 3),
 f AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(l) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
 w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f CROSS JOIN g GROUP BY term, nn),
 m AS (SELECT doc_id, k, 25 + (75 * len(l) * nn) // ll AS m FROM d CROSS JOIN g WHERE len(l) > 0),
 s AS (SELECT item, item_id, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
   FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY 1, 2, 3, 4)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, k))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""


ORACLES = {"op1_minhash_dedup": OP1, "op4_chat_format": OP4, "op6_url_filter": OP6, "op9_license_scan": _op9(), "op11_source_mix": OP11, "op13_lexical_search": OP13}
