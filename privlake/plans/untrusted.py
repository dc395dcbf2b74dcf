"""Queries over reports that pages send: conversation turns as messages of JSON, some of them with faults."""

from __future__ import annotations

from privlake.operators import untrusted as u
from privlake.plans.registry import query
from privlake.sources.tables import derived

_ROW = """concat('{"url": "https://h', CAST(conv_id AS STRING), '.example.org/', repeat('p', length(text) % 700), '", "method": "', CASE WHEN turn % 2 = 0 THEN 'GET' ELSE 'A-METHOD-OF-MANY-SIGNS' END, '", "bytes": ', CAST(length(text) * (CASE WHEN conv_id % 3 = 0 THEN -1 ELSE 1 END) AS STRING), CASE WHEN conv_id % 5 = 0 THEN '.5e300' ELSE '' END, ', "matches": [', repeat('{"category": "email"}, ', length(text) % 40), '"last", 1, null]}')"""
#: A turn's message: good rows, between which stand rows with faults, in messages of which some are refused whole.
MESSAGES = f"""SELECT conv_id * 1000 + turn AS message_id, CASE (conv_id + turn * 3) % 11
 WHEN 0 THEN concat('{{"source": "tripwire-report", "observations": [', a, ', ', substr(a, 1, 40))
 WHEN 1 THEN concat('{{"source": "another", "observations": [', a, ']}}')
 WHEN 2 THEN '{{"source": "tripwire-report", "observations": []}}'
 WHEN 3 THEN concat('{{"source": "tripwire-report", "observations": ', a, '}}')
 WHEN 4 THEN concat('{{"source": "tripwire-report", "observations": [', repeat(concat(a, ', '), 49 + CAST(turn AS INT)), a, ']}}')
 WHEN 5 THEN concat('{{"source": "tripwire-report", "observations": [', a, ', null, 7, "text", [1], ', replace(a, '"method": "', '"method": 5, "was": "'), ', ', replace(a, '"bytes": ', '"bytes": "12", "were": '), ']}}')
 WHEN 6 THEN concat('{{"source": "tripwire-report", "observations": [', replace(a, '"url"', '"link"'), ', ', replace(a, '"matches": [', '"matches": {{"a": 1}}, "had": ['), ', ', a, ']}}')
 WHEN 7 THEN concat('{{"source": 5, "observations": [', a, ']}}')
 WHEN 8 THEN concat('["tripwire-report", ', a, ']')
 ELSE concat('{{"source": "tripwire-report", "more": true, "observations": [', a, ', ', a, ']}}') END AS body
FROM (SELECT conv_id, turn, text, {_ROW} AS a FROM conversations) x"""
_NUMBER = "json_type(o, '$.bytes') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
_CHECKED = f"""WITH m AS ({MESSAGES}), v AS (SELECT message_id, body, coalesce(json_valid(body), false) AS ok FROM m),
w AS (SELECT *, CASE WHEN NOT ok THEN 'not_json' WHEN coalesce(json_type(CASE WHEN ok THEN body END, '$.source') <> 'VARCHAR' OR json_extract_string(CASE WHEN ok THEN body END, '$.source') <> 'tripwire-report', true) THEN 'wrong_source'
 WHEN coalesce(json_type(CASE WHEN ok THEN body END, '$.observations') <> 'ARRAY', true) OR json_array_length(CASE WHEN ok THEN body END, '$.observations') = 0 THEN 'no_rows' END AS whole FROM v),
o AS (SELECT message_id, i, CAST(json_extract(body, '$.observations[' || i || ']') AS JSON) AS o FROM (SELECT message_id, body, unnest(range(CAST(json_array_length(body, '$.observations') AS BIGINT))) AS i FROM w WHERE whole IS NULL)),
r AS (SELECT *, CASE WHEN i >= 50 THEN 'beyond_limit' WHEN coalesce(json_type(o, '$.url') <> 'VARCHAR', true) THEN 'no_url' WHEN coalesce(json_type(o, '$.method') <> 'VARCHAR', true) THEN 'no_method' WHEN coalesce(NOT {_NUMBER}, true) THEN 'no_bytes' WHEN coalesce(json_type(o, '$.matches') <> 'ARRAY', true) THEN 'no_matches' END AS reason FROM o),
g AS (SELECT message_id, i, json_extract_string(o, '$.url') AS url, json_extract_string(o, '$.method') AS method, CAST(json_extract(o, '$.bytes') AS DOUBLE) AS bytes, CAST(json_array_length(o, '$.matches') AS INT) AS matches FROM r WHERE reason IS NULL)"""


def _checked(spark, sf_dir):
    return u.checked_rows(derived(spark, sf_dir, MESSAGES, "conversations"), "message_id", "body")


@query(f"{_CHECKED} SELECT message_id, CAST(i AS INT) AS ordinal, left(url, 512) AS url, left(method, 16) AS method, greatest(0.0, least(bytes, 9007199254740991.0)) AS bytes, least(matches, 32) AS matches, concat_ws(',', CASE WHEN length(url) > 512 THEN 'url' END, CASE WHEN length(method) > 16 THEN 'method' END, CASE WHEN bytes < 0 OR bytes > 9007199254740991 THEN 'bytes' END, CASE WHEN matches > 32 THEN 'matches' END) AS cut FROM g")
def reported_requests(spark, sf_dir):
    return u.good_rows(_checked(spark, sf_dir)).selectExpr("message_id", "ordinal", "url", "method", "bytes", "size(matches) AS matches", "array_join(cut, ',') AS cut")


@query(f"{_CHECKED} SELECT message_id, CAST(NULL AS INT) AS ordinal, whole AS reason, body IS NULL AS empty FROM w WHERE whole IS NOT NULL UNION ALL SELECT message_id, CAST(i AS INT), reason, false FROM r WHERE reason IS NOT NULL")
def refused_reports(spark, sf_dir):
    return u.quarantined(_checked(spark, sf_dir)).selectExpr("message_id", "ordinal", "reason", "raw IS NULL AS empty")


@query(f"""{_CHECKED}, t AS (SELECT 'good' AS what FROM g UNION ALL SELECT 'refused: ' || whole FROM w WHERE whole IS NOT NULL UNION ALL SELECT 'refused: ' || reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT 'cut: url' FROM g WHERE length(url) > 512 UNION ALL SELECT 'cut: method' FROM g WHERE length(method) > 16
 UNION ALL SELECT 'cut: bytes' FROM g WHERE bytes < 0 OR bytes > 9007199254740991 UNION ALL SELECT 'cut: matches' FROM g WHERE matches > 32),
n AS (SELECT what, count(*) AS n FROM t GROUP BY what) SELECT what, coalesce(n, 0) AS n FROM (VALUES ('good'), ('refused: not_json'), ('refused: wrong_source'), ('refused: no_rows'), ('refused: beyond_limit'), ('refused: no_url'), ('refused: no_method'), ('refused: no_bytes'), ('refused: no_matches'), ('cut: url'), ('cut: method'), ('cut: bytes'), ('cut: matches')) AS k(what) LEFT JOIN n USING (what)""")
def report_counts(spark, sf_dir):
    return u.tally(_checked(spark, sf_dir))
