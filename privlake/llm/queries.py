"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import HEADER, audio_columns
from .decontaminate import decontaminate
from .html_text import extract_text
from .langid import held_out, train_language_model
from .line_templates import drop_recurring_lines
from .merkle import folded, merkle_manifest, proof_text, row_digest
from .mixing import mix_sources
from .ngram_join import ngram_components
from .packing import pack
from .suffix_dedup import drop_repeated_bytes
from .token_align import align_tokens
from .toxicity import train_toxicity_model
from .unit_dedup import drop_repeated_units


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file: in `folder`, or else where the installed package has it."""
    import public_tokenizers

    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words of benchmark items in documents; contaminated from a twentieth of the words on."""
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs in ten documents or more."""
    out = drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.9 or more over sets of 3 words."""
    return ngram_components(_table(spark, sf_dir, "documents"), n=3, num=90)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids of the lower-casing word tokenizer."""
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as 8-bit audio; digests of the stored file, of the samples read back from it, and of its features."""
    out = audio_columns(_table(spark, sf_dir, "documents")).withColumn("payload", F.expr(f"substring(media, {HEADER + 1})"))
    spans = F.array_join(F.transform("segments", lambda x: F.concat_ws("-", F.format_number(x["start"], 2), F.format_number(x["end"], 2))), " ")
    feature = F.concat_ws("|", "frames", F.array_join(F.transform("mean_log_mel", lambda x: F.format_number(x, 2)), " "), F.size("segments"), F.crc32(F.encode(spans, "UTF-8")), "mel_crc32")
    return out.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from labels of those whose crc32 of the id does not leave 2 when divided by 4."""
    docs, out = _table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = train_toxicity_model(docs, _table(spark, sf_dir, "labels").where(~out))
    return model.predict(docs.select("doc_id", out.alias("held_out"), "text")).drop("text")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines and sentences that stand earlier in any document."""
    out = drop_repeated_units(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return out.select("doc_id", "n_units", "n_removed", "removed_chars", spans.alias("removed_spans"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 of the id leaves 1 to 4 when divided by 5."""
    docs = _table(spark, sf_dir, "documents")
    out = held_out("doc_id")
    model = train_language_model(docs.where(~out))
    return model.predict(docs.select("doc_id", out.alias("held_out"), "text")).drop("text")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without bytes of strings of 200 bytes that also start elsewhere."""
    out = drop_repeated_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, subroot, root and proof, and whether a leaf that was tampered with still leads to the root."""
    docs, fields = _table(spark, sf_dir, "documents"), ("doc_id", "source", "lang")
    more = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 7 == 0).cast("int"), F.lit(0))
    tampered = row_digest(*fields, F.col("n_chars").cast("decimal(20,0)") + more, "text")
    out = merkle_manifest(docs.withColumn("_tampered", tampered), row_digest(*fields, "n_chars", "text"), columns=["_tampered"])
    out = out.withColumn("folded_root", folded(F.col("_tampered"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.encode(proof_text(F.col("proof")), "UTF-8"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two public tokenizers make of every document."""
    out, _ = align_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), with_groups=False)
    return out


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix to target weights takes of every document."""
    out = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_packing": op4_packing,
    "op5_media_columns": op5_media_columns,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_source_mixing": op13_source_mixing,
}

ORACLES = {
    "op1_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bn)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n AS n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, text, i - 1 AS i, list_transform(list_filter(string_split_regex(lines[i], '[ \t\r\f\x0B]+'), lambda x: x <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS toks
      FROM (SELECT doc_id, text, lines, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE text IS NOT NULL)),
k AS (SELECT *, array_to_string(toks, ' ') AS g, concat(len(toks), ' ', array_to_string(toks[1:3], ' ')) AS leaf FROM l WHERE len(toks) > 0),
once AS (SELECT DISTINCT leaf, g, toks, text FROM k),
full_leaf AS (SELECT leaf FROM once GROUP BY leaf HAVING count(*) >= 10),
named AS (SELECT leaf, g, toks, count(*) AS docs FROM once WHERE leaf IN (SELECT leaf FROM full_leaf) GROUP BY ALL),
places AS (SELECT leaf, g, docs, unnest(range(4, len(toks) + 1)) AS pos, toks FROM named),
kept AS (SELECT leaf, pos, tok FROM (SELECT leaf, pos, docs, toks[pos] AS tok FROM places) WHERE tok <> '<*>' GROUP BY ALL HAVING sum(docs) >= 10),
flags AS (SELECT p.leaf, p.g, list(p.pos) AS held FROM places p JOIN kept c ON p.leaf = c.leaf AND p.pos = c.pos AND p.toks[p.pos] = c.tok GROUP BY ALL),
gen AS (SELECT n.leaf, n.g, list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN i <= 3 OR toks[i] = '<*>' OR list_contains(coalesce(held, []), i) THEN toks[i] ELSE '<?>' END) AS tpl FROM named n LEFT JOIN flags f ON n.leaf = f.leaf AND n.g = f.g),
shaped AS (SELECT leaf, g, array_to_string(list_transform(tpl, lambda t: CASE WHEN t = '<?>' THEN '<*>' ELSE t END), ' ') AS tpl FROM gen WHERE len(list_filter(tpl, lambda t: t <> '<?>')) >= len(tpl) * 0.8 AND 2 * len(list_filter(tpl, lambda t: t NOT IN ('<?>', '<*>'))) >= len(tpl)),
rec AS (SELECT tpl FROM (SELECT DISTINCT s.tpl, o.text FROM once o JOIN shaped s ON o.leaf = s.leaf AND o.g = s.g) GROUP BY tpl HAVING count(*) >= 10),
gone AS (SELECT k.doc_id, list(k.i) AS dropped FROM k JOIN shaped s ON k.leaf = s.leaf AND k.g = s.g JOIN rec USING (tpl) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN dropped IS NULL THEN coalesce(text, '') ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(dropped, i - 1)), lambda i: lines[i]), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE
c AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM documents),
d AS (SELECT doc_id, lang, sha256(concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(CAST(source AS VARCHAR)), ':', source) END, CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(CAST(lang AS VARCHAR)), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(CAST(text AS VARCHAR)), ':', text) END)) AS leaf,
      sha256(concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(CAST(source AS VARCHAR)), ':', source) END, CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(CAST(lang AS VARCHAR)), ':', lang) END, CASE WHEN (CAST(n_chars AS HUGEINT) + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END) IS NULL THEN '-' ELSE concat(strlen(CAST((CAST(n_chars AS HUGEINT) + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END) AS VARCHAR)), ':', (CAST(n_chars AS HUGEINT) + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)) END, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(CAST(text AS VARCHAR)), ':', text) END)) AS tampered FROM c),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (SELECT 0 AS l, lang, p, n, leaf AS h FROM leaves
          UNION ALL SELECT l + 1, lang, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY l, lang, p // 2, n),
subs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS l, p, n, h FROM subs
         UNION ALL SELECT l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM tops WHERE n > 1 GROUP BY l, p // 2, n),
paths AS (SELECT lang, p AS home, 0 AS l, p, n, tampered AS h, '' AS proof FROM leaves
          UNION ALL SELECT s.lang, s.home, s.l + 1, s.p // 2, (s.n + 1) // 2, sha256(CASE WHEN s.p % 2 = 0 THEN concat(s.h, o.h) ELSE concat(o.h, s.h) END), concat(s.proof, o.h)
          FROM paths s LEFT JOIN nodes o ON o.l = s.l AND o.lang IS NOT DISTINCT FROM s.lang AND o.p = xor(s.p, 1) WHERE s.n > 1),
ends AS (SELECT paths.lang, home, 0 AS l, subs.p, subs.n, paths.h, proof FROM paths JOIN subs ON paths.lang IS NOT DISTINCT FROM subs.lang WHERE paths.n = 1
         UNION ALL SELECT s.lang, s.home, s.l + 1, s.p // 2, (s.n + 1) // 2, sha256(CASE WHEN s.p % 2 = 0 THEN concat(s.h, o.h) ELSE concat(o.h, s.h) END), concat(s.proof, o.h)
         FROM ends s LEFT JOIN tops o ON o.l = s.l AND o.p = xor(s.p, 1) WHERE s.n > 1)
SELECT doc_id, leaf, subs.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaves JOIN ends e ON e.n = 1 AND e.home = leaves.p AND e.lang IS NOT DISTINCT FROM leaves.lang JOIN subs ON subs.lang IS NOT DISTINCT FROM leaves.lang, (SELECT h FROM tops WHERE n = 1) r""",
    "op13_source_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(CAST(doc_id AS VARCHAR), text, '') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 10 * 3 * source_size // w, source NULLS LAST) AS k FROM s),
f AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM o),
c AS (SELECT k, num, den FROM f WHERE w * num <= 3 * source_size * den ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f.k < c.k THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * c.num AS DOUBLE) / CAST(c.den AS DOUBLE) END AS target FROM f, c),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, CAST(concat('0x', substr(sha256(concat('0|', key)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
}
