"""Queries over texts: scan, mask, validators, URLs, intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlake.functions import text as t
from privlake.functions import urls
from privlake.functions import validators as v
from privlake.operators import intents, scan
from privlake.plans.registry import query
from privlake.sources import forms_html, pages
from privlake.sources.tables import derived, table

_VERHOEFF = f"list_reduce(range(0, 12), lambda c, i: CAST(substr('{v.VERHOEFF_PRODUCT}', CAST(c * 10 + CAST(substr('{v.VERHOEFF_PLACES}', CAST((i % 8) * 10 + CAST(substr(d, CAST(12 - i AS BIGINT), 1) AS BIGINT) + 1 AS BIGINT), 1) AS BIGINT) + 1 AS BIGINT), 1) AS BIGINT), CAST(0 AS BIGINT)) = 0"
_TWICE = "2 * CAST(substr(d, k, 1) AS INT)"
_LUHN_D = f"list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN (length(d) - k) % 2 = 0 THEN CAST(substr(d, k, 1) AS INT) WHEN {_TWICE} > 9 THEN {_TWICE} - 9 ELSE {_TWICE} END)) % 10 = 0"
_UPI = ", ".join(f"'{p}'" for p in v.UPI_PROVIDERS)


def _kept(source: str, unvalidated: bool) -> str:
    """CTEs that end in `kept`: the scan's matches. Level by level, since matches of one rule never overlap."""
    rules = [
        ("financial", r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b", 0.99, _LUHN_D),
        ("aadhaar", r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b", 0.98, _VERHOEFF),
        ("pan", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.97, "regexp_full_match(v, '[A-Z]{3}[PCHFATBLJGKE][A-Z][0-9]{4}[A-Z]')"),
        ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.95, "true"),
        ("upi", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9]+\b", 0.92, f"lower(split_part(v, '@', 2)) IN ({_UPI})"),
        ("phone", r"\b(?:\+?91[\s-]?)?[6-9][0-9]{9}\b", 0.9, "true"),
    ] + ([("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.85, "true")] if unvalidated else [])
    parts = [f"src AS ({source})"]
    for k, (category, pattern, confidence, check) in enumerate(rules):
        parts.append(f"m{k} AS (SELECT id, regexp_extract_all(body, '{pattern}') AS m, string_split_regex(body, '{pattern}') AS g FROM src WHERE body IS NOT NULL)")
        parts.append(f"x{k} AS (SELECT id, i, m[i] AS v, regexp_replace(m[i], '[\\s-]', '', 'g') AS d, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{k} WHERE len(m) > 0))")
        own = f"SELECT id, CAST(s AS INT) AS s, CAST(s + length(v) AS INT) AS e, '{category}' AS category, v AS matched_text, {category != 'email'} AS validated, CAST({confidence} AS DOUBLE) AS confidence FROM x{k} x WHERE {check}"
        parts.append(f"k{k} AS ({own})" if not k else f"k{k} AS (SELECT * FROM k{k - 1} UNION ALL SELECT n.* FROM ({own}) n WHERE NOT EXISTS (SELECT 1 FROM k{k - 1} o WHERE o.id = n.id AND n.s < o.e AND o.s < n.e))")
    return "WITH " + ",\n".join([*parts, f"kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS INT) AS ordinal FROM k{len(rules) - 1})"])


_DOCS = "SELECT doc_id AS id, text AS body FROM documents"
_BODIES = "SELECT request_id AS id, body FROM ({})"


@query(_kept(_DOCS, True) + " SELECT category, count(*) AS n_matches, count(DISTINCT id) AS n_docs FROM kept GROUP BY category")
def pii_by_category(spark, sf_dir):
    found = scan.scan_pii(table(spark, sf_dir, "documents"), "doc_id", "text", unvalidated=True)
    return found.groupBy("category").agg(F.count("*").alias("n_matches"), F.count_distinct("doc_id").alias("n_docs"))


@query(_kept(_DOCS, True) + " SELECT id AS doc_id, ordinal, category, matched_text, s AS start, validated, confidence FROM kept")
def scan_text(spark, sf_dir):
    return scan.scan_pii(table(spark, sf_dir, "documents"), "doc_id", "text", unvalidated=True)


_MASKED = """, cuts AS (SELECT id, s, e, category, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS p FROM kept),
built AS (SELECT c.id, string_agg(substr(body, c.p + 1, c.s - c.p) || '[REDACTED:' || category || ']', '' ORDER BY c.s) AS head, max(e) AS last FROM cuts c JOIN src USING (id) GROUP BY c.id)
SELECT src.id AS doc_id, CASE WHEN built.id IS NULL THEN body ELSE head || substr(body, last + 1) END AS masked FROM src LEFT JOIN built ON src.id = built.id"""


@query(_kept(_DOCS, True) + _MASKED)
def mask_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scan.masked(F.col("text"), True).alias("masked"))


_CASE = "CASE category WHEN " + " WHEN ".join(f"'{k}' THEN '{x}'" for k, x in scan.SEVERITY.items()) + " END"


@query(_kept(_DOCS, True) + f" SELECT lang, count(*) AS total, count_if(lv = 'critical') AS critical_count, count_if(lv = 'high') AS high_count, count_if(lv = 'medium') AS medium_count, count_if(lv = 'low') AS low_count, count(DISTINCT category) AS categories, round(avg(confidence), 6) AS mean_confidence FROM (SELECT *, {_CASE} AS lv FROM kept JOIN documents ON id = doc_id) GROUP BY lang")
def pii_summary_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("lang", F.explode(scan.scan_spans(F.col("text"), True)).alias("m")).select("lang", "m.category", "m.confidence")
    return scan.summarise(found, "lang")


@query("SELECT count(*) AS docs, CAST(0 AS BIGINT) AS residual FROM documents")
def residual_after_mask(spark, sf_dir):
    masked = table(spark, sf_dir, "documents").select(scan.masked(F.col("text")).alias("t"))
    return masked.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size(scan.scan_spans(F.col("t")))), F.lit(0)).cast("long").alias("residual"))


@query(rf"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{{16}}\b')) AS d FROM documents) SELECT doc_id, d AS card, {_LUHN_D} AS valid FROM c")
def card_luhn_hits(spark, sf_dir):
    cards = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(t.B + "[0-9]{16}" + t.B), F.lit(0))).alias("card"))
    return cards.select("doc_id", "card", v.luhn_valid(F.col("card")).alias("valid"))


_ID = "lpad(CAST({} * 7919 % 1000003 AS STRING), 6, '0')"


@query(f"WITH c AS (SELECT c_custkey, concat({_ID.format('c_custkey')}, {_ID.format('(c_custkey + 17)')}) AS d FROM customer) SELECT c_custkey, d AS number, {_VERHOEFF} AS valid FROM c")
def verhoeff_numbers(spark, sf_dir):
    rows = derived(spark, sf_dir, f"SELECT c_custkey, concat({_ID.format('c_custkey')}, {_ID.format('(c_custkey + 17)')}) AS number FROM customer", "customer")
    return rows.withColumn("valid", F.coalesce(v.verhoeff_valid(F.col("number")), F.lit(False)))


_IDS = """SELECT s_suppkey, concat('ABC', substr('PDCXHQ', CAST(s_suppkey % 6 + 1 AS INT), 1), 'E', lpad(CAST(s_suppkey AS STRING), 4, '0'), 'F') AS pan,
 concat('SBIN', CAST(s_suppkey % 2 AS STRING), lpad(CAST(s_suppkey AS STRING), 6, '0')) AS ifsc,
 concat('user', CAST(s_suppkey AS STRING), '@', CASE WHEN s_suppkey % 3 = 0 THEN 'PayTM' WHEN s_suppkey % 3 = 1 THEN 'mail5' ELSE 'okbank' END) AS upi,
 concat(CASE WHEN s_suppkey % 3 = 0 THEN '+91 ' ELSE '' END, CAST(5 + s_suppkey % 5 AS STRING), lpad(CAST(s_suppkey AS STRING), 9, '0')) AS phone FROM supplier"""


@query(f"WITH c AS ({_IDS}) SELECT s_suppkey, regexp_full_match(pan, '[A-Z]{{3}}[PCHFATBLJGKE][A-Z][0-9]{{4}}[A-Z]') AS pan_ok, regexp_full_match(ifsc, '[A-Z]{{4}}0[A-Z0-9]{{6}}') AS ifsc_ok, lower(split_part(upi, '@', 2)) IN ({_UPI}) AS upi_ok, regexp_full_match(regexp_replace(phone, '[^0-9]', '', 'g'), '(91)?[6-9][0-9]{{9}}') AS phone_ok FROM c")
def identifier_formats(spark, sf_dir):
    rows = derived(spark, sf_dir, _IDS, "supplier")
    return rows.select("s_suppkey", v.pan_valid(F.col("pan")).alias("pan_ok"), v.ifsc_valid(F.col("ifsc")).alias("ifsc_ok"), v.upi_valid(F.col("upi")).alias("upi_ok"), v.phone_valid(F.col("phone")).alias("phone_ok"))


@query("""WITH c AS (SELECT c_custkey, c_name AS n FROM customer UNION ALL SELECT -c_custkey, left(c_name, 3) FROM customer)
SELECT c_custkey, CASE WHEN length(n) <= 4 THEN repeat('*', length(n)) ELSE left(n, 2) || repeat('*', least(length(n) - 4, 12)) || right(n, 2) END AS masked,
 CASE WHEN length(n) <= 4 THEN repeat('*', length(n)) ELSE left(n, 2) || repeat('*', length(n) - 4) || right(n, 2) END AS sample FROM c""")
def mask_values(spark, sf_dir):
    rows = derived(spark, sf_dir, "SELECT c_custkey, c_name AS n FROM customer UNION ALL SELECT -c_custkey, left(c_name, 3) FROM customer", "customer")
    return rows.select("c_custkey", t.mask_value(F.col("n")).alias("masked"), t.mask_sample(F.col("n")).alias("sample"))


@query("SELECT doc_id, replace(replace(text, 'the', '***'), 'der', '***') AS scrubbed FROM documents")
def known_value_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.scrub_known(F.col("text"), F.array(F.lit("the"), F.lit(""), F.lit("der"))).alias("scrubbed"))


_URL = r"regexp_extract(url, '^([a-zA-Z]+)://([^/:?#]+)(:[0-9]+)?([^?#]*)', ['p', 'h', 'o', 'q'])"


@query(f"SELECT page_id, lower(u.p) || '://' || lower(u.h) || CASE WHEN u.o = '' OR (lower(u.p) = 'http' AND u.o = ':80') OR (lower(u.p) = 'https' AND u.o = ':443') THEN '' ELSE u.o END || CASE WHEN u.q = '' THEN '/' ELSE u.q END AS clean, lower(u.h) AS host FROM (SELECT page_id, {_URL} AS u FROM pages)")
def sanitized_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.sanitize_url(F.col("url")).alias("clean"), urls.hostname(F.col("url")).alias("host"))


_SIZES = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN n_chars ELSE n_chars * n_chars END AS n FROM documents"


@query(f"WITH c AS ({_SIZES}), p AS (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS k FROM c), q AS (SELECT *, floor(n / pow(1024.0, k) * 10 + 0.5) / 10 AS s FROM p) SELECT doc_id, CASE WHEN n = 0 THEN '0 B' ELSE regexp_replace(format('{{:.1f}}', s), '\\.0$', '') || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] END AS shown FROM q")
def shown_sizes(spark, sf_dir):
    return derived(spark, sf_dir, _SIZES, "documents").select("doc_id", t.format_bytes(F.col("n")).alias("shown"))


_TASKS = """SELECT conv_id * 1000 + turn AS task_id, concat(CASE conv_id % 12 WHEN 0 THEN 'Extract the data and fill the form with ' WHEN 1 THEN 'What do I have to fill here? ' WHEN 2 THEN 'check where is the submit button ' WHEN 3 THEN 'scrape everything then submit; list all '
 WHEN 4 THEN 'fill the name and address fields ' WHEN 5 THEN 'Do I have a photo ' WHEN 6 THEN 'do this now ' WHEN 7 THEN 'read the page and then click submit and type ' WHEN 8 THEN '  ' WHEN 9 THEN 'summarize this page ' WHEN 10 THEN 'tell me if it is open ' ELSE '' END, coalesce(text, ''), CASE WHEN turn % 5 = 0 THEN ' ?' ELSE '' END) AS task FROM conversations"""
_Q = " OR ".join(f"contains(t, '{p}')" for p in intents.QUESTION_PHRASES)
_E = " OR ".join("contains(t, '" + p.replace("'", "''") + "')" for p in intents.EXTRACTION_PHRASES)


@query(rf"WITH c AS ({_TASKS}), d AS (SELECT task_id, lower(trim(task)) AS t FROM c) SELECT task_id, t <> '' AND (ends_with(t, '?') OR regexp_matches(t, '^(what|which|where|when|why|who|whom|whose|how)\b') OR regexp_matches(t, '^(is|are|do|does|did|has|have|was|were|can|could|will|would|should|am)\s+(i|you|we|they|he|she|there|my|any)\b') OR regexp_matches(t, '^(check|tell me|find out|see|show me|know|look up|identify|locate)\s+(where|what|which|who|whom|whose|when|why|how|whether|if)\b') OR {_Q}) AS is_question, t <> '' AND NOT regexp_matches(t, '\b(fill|submit|click|type into|complete the form)\b') AND ({_E}) AS is_extraction FROM d")
def task_intents(spark, sf_dir):
    tasks = derived(spark, sf_dir, _TASKS, "conversations")
    return tasks.select("task_id", intents.is_question(F.col("task")).alias("is_question"), intents.is_extraction(F.col("task")).alias("is_extraction"))


_PARTS = "[t]"
for _sep in intents.SEPARATORS:
    _PARTS = f"list_filter(flatten(list_transform({_PARTS}, lambda p: string_split_regex(p, '(?i){_sep}'))), lambda p: trim(p) <> '')"
_ACTS, _READS, _VETO = (f"regexp_matches(lower({{0}}), '{p.replace(intents.B, chr(92) + 'b')}')" for p in (intents.ACTION_VERBS, intents.READ_VERBS, intents.EXTRACTION_VETO))
_VERB = f"({_ACTS} OR {_READS})"


@query(f"""WITH RECURSIVE tk AS ({_TASKS}), w AS (SELECT task_id, trim(coalesce(task, '')) AS t FROM tk), q AS (SELECT task_id, t, {_PARTS} AS parts FROM w WHERE t <> ''),
g AS (SELECT task_id, k, string_split_regex(parts[k], '(?i) and ') AS pieces FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM q)),
f AS (SELECT task_id, k, pieces, 1 AS i, CAST([] AS VARCHAR[]) AS done, pieces[1] AS now_ FROM g
 UNION ALL SELECT task_id, k, pieces, i + 1, CASE WHEN cut THEN list_append(done, now_) ELSE done END, CASE WHEN cut THEN pieces[i + 1] ELSE concat(now_, ' and ', pieces[i + 1]) END
 FROM (SELECT *, {_VERB.format('now_')} AND {_VERB.format("array_to_string(pieces[i + 1:], ' and ')")} AS cut FROM f WHERE i < len(pieces)) x),
c AS (SELECT task_id, k, unnest(list_append(done, now_)) AS d, unnest(range(1, len(done) + 2)) AS n FROM f WHERE i = len(pieces)),
d AS (SELECT task_id, k, n, trim(d) AS d FROM c WHERE trim(d) <> '' UNION ALL SELECT task_id, 0, 0, t FROM q WHERE task_id NOT IN (SELECT task_id FROM c WHERE trim(d) <> '')),
e AS (SELECT *, CASE WHEN (NOT {_VETO.format('d')} AND ({_E.replace('contains(t,', 'contains(lower(d),')})) OR ({_READS.format('d')} AND NOT {_ACTS.format('d')}) THEN 'extract' ELSE 'action' END AS kind FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id, kind ORDER BY k, n) AS of_kind FROM e)
SELECT task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY k, n) - 1 AS INT) AS ordinal, kind, d AS description FROM r WHERE kind <> 'extract' OR of_kind = 1""")
def decompose_tasks(spark, sf_dir):
    tasks = derived(spark, sf_dir, _TASKS, "conversations")
    return tasks.select("task_id", F.posexplode(intents.decompose(F.col("task"))).alias("ordinal", "c")).select("task_id", "ordinal", "c.kind", "c.description")


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<title\b[^>]*>.*?</title>', '', 'g'), '(?i)</?(p|div|h[1-6]|li|ul|ol|br|tr|td|article|nav|footer|section|table)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(12) || chr(11))), lambda x: length(x) > 2 AND length(x) < 80)[1:30], '|') AS headings FROM pages")
def page_headings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(t.headings(pages.plain(F.col("html"))), "|").alias("headings"))


@query("WITH t AS (SELECT lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)(?:[^>]*)>', 1))) AS tag FROM pages) SELECT tag, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY tag")
def element_counts(spark, sf_dir):
    return pages.elements_by_tag(table(spark, sf_dir, "pages"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\b[^>]*>[^<]*</a>')[1:100] AS l FROM pages), b AS (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM a)
SELECT page_id, CAST(i - 1 AS INT) AS ordinal, regexp_extract(l[i], 'href="([^"]*)"', 1) AS href, left(trim(regexp_replace(l[i], '<[^>]*>', '', 'g')), 120) AS label FROM b""")
def page_links(spark, sf_dir):
    return pages.links(table(spark, sf_dir, "pages"))


@query("SELECT p_partkey, levenshtein(p_name, 'goldenrod lace') AS distance, levenshtein(p_name, 'goldenrod lace') <= greatest(2, CAST(floor(length('goldenrod lace') * 3 / 10) AS BIGINT)) AS near FROM part")
def fuzzy_labels(spark, sf_dir):
    d = F.levenshtein("p_name", F.lit("goldenrod lace"))
    return table(spark, sf_dir, "part").select("p_partkey", d.cast("long").alias("distance"), (d <= F.greatest(F.lit(2), F.floor(F.lit(14 * 3 / 10)))).alias("near"))


@query("SELECT c_custkey, c_name AS plain FROM customer")
def aes_roundtrip(spark, sf_dir):
    key = F.lit("0123456789abcdef0123456789abcdef")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.base64(F.aes_encrypt("c_name", key, F.lit("GCM"))).alias("sealed"))
    return rows.select("c_custkey", F.try_aes_decrypt(F.unbase64("sealed"), key, F.lit("GCM")).cast("string").alias("plain"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g'), '<a\s[^>]*href="[^>]*>[^<]*')) AS a FROM pages)
SELECT page_id, count(*) AS links, count_if(trim(regexp_replace(a, '^<[^>]*>', '')) <> '') AS labelled FROM a GROUP BY page_id""")
def page_elements(spark, sf_dir):
    found = forms_html.page_elements(table(spark, sf_dir, "pages")).where("role = 'link'")
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.trim("text") != "").alias("labelled"))


@query()
def page_fields(spark, sf_dir):
    return forms_html.page_fields(table(spark, sf_dir, "pages"))
