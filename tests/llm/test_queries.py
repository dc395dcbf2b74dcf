"""The registered queries at the smallest scale, against SQL or brute force, and the pipeline stage by stage."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from privlake.llm import queries as q
from privlake.llm.common import durable

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    run = con.execute(q.ORACLES[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in run.fetchall()), key=str)


def test_language_id_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = q.op9_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = q.op6_toxicity(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, marked[r.doc_id]) for r in rows if r.held_out and r.doc_id in marked]
    right = sum(p == t == 1 for p, t in held)
    assert right >= 0.9 * sum(t for _, t in held) and right >= 0.9 * sum(p for p, _ in held)


def test_near_duplicates_tells_texts_under_one_id_apart(spark):
    import corpus_pipeline

    a, b, c = ("".join(f"{x}{k} " for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (7, c), (-3, b + "end"), (10, a), (10, None), (9, c + "end"), (None, a), (None, a)]
    for kind in ("long", "string"):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        got = corpus_pipeline.near_duplicates(spark, docs, SF)
        assert got.columns == docs.columns
        kept = sorted((str(r.doc_id), r.text or "") for r in got.collect())
        # by text, "10" comes before "5"
        assert kept == sorted([("10" if kind == "string" else "5", a), ("10", ""), ("-3", b + "end"), ("7", c), ("None", a), ("None", a)])


def test_pipeline(spark):
    if not os.path.exists(os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")):
        pytest.skip("the pipeline is not here")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = durable(stage(spark, docs, SF))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            ids = now
    assert now == ids


def test_repeated_bytes_by_brute_force(spark):
    size, seen, want = 200, {}, {}
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for b in docs.values():
        for p in range(len(b) - size + 1):
            seen[b[p : p + size]] = seen.get(b[p : p + size], 0) + 1
    for i, b in docs.items():
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = q.op10_suffix_array_dedup(spark, SF).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def cut_up(text):
    """Lines, each a list of (start, end, words): its sentences, of which short ones belong to the next long one. Written apart from the library."""
    lines, at = [], 0
    for line in re.findall(r"[^\n]*\n+|[^\n]+$", text):
        found, begin, held = [], at, []
        for part in re.findall(r".*?[.!?]+[ \t]+|.+?$", line.rstrip("\n")):
            at += len(part)
            held += part.lower().split()
            if len(part.split()) >= 5:
                found.append((begin, at, held))
                begin, held = at, []
        at += len(line) - len(line.rstrip("\n"))
        if held:
            found.append((begin, at, held))
        elif found and found[-1][1] == begin and not line.rstrip("\n").endswith((" ", "\t")):
            found[-1] = (found[-1][0], at, found[-1][2])
        lines.append(found)
    return lines


def test_repeated_units_by_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert len({i for i, _ in docs}) == len(docs)
    seen, want, lost = set(), {}, 0
    for i, text in docs:
        rows, gone, run = cut_up(text or ""), set(), []
        again = []
        for line in rows:
            again.append([" ".join(u[2]) in seen or seen.add(" ".join(u[2])) or False for u in line])
            if all(again[-1]) and sum(len(u[2]) for u in line) >= 5:
                gone.update(u[:2] for u in line)
        flat = [(u, x) for line, flags in zip(rows, again, strict=True) for u, x in zip(line, flags, strict=True)]
        for u, x in [*flat, (None, False)]:
            if x:
                run.append(u)
                continue
            if sum(len(y[2]) for y in run) >= 16:
                gone.update(y[:2] for y in run)
            run = []
        kept, at = "", 0
        for start, end in sorted(gone):
            kept, at = kept + text[at:start], end
        kept += (text or "")[at:]
        lost += bool(gone)
        want[i] = (len(flat), len(gone), sum(e - s for s, e in gone), ",".join(f"{s}-{e}" for s, e in sorted(gone)), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_units, r.n_removed, r.removed_chars, r.removed_spans, r.kept_sha256) for r in q.op8_substring_dedup(spark, SF).collect()}
    assert got == want and lost


def _stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


CLASHING = ("_name", "_all", "_row", "_key", "_id", "n_lines", "n_dropped", "score", "lang_pred", "component_id", "contaminated", "_text", "a.b", "start", "length")


@pytest.mark.parametrize("stage", ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"])
def test_stages_carry_columns_and_take_odd_rows(spark, stage):
    words = "the river runs past old mills and carries leaves of many trees to the sea each year".split()
    rows = [(i, " ".join(words[i % 5 :] + [w + "abcdefghij"[i] for w in words]), "en" if i % 2 else "de") for i in range(10)]
    rows += [(20, None, "en"), (21, "", "de"), (22, " \n ", None), (23, "long " * 50_000, "en"), (24, rows[3][1], "en"), (24, rows[3][1], "en"), (None, "no id " + rows[1][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text"))
    for c in CLASHING:
        docs = docs.select("*", F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c))
    got = _stages()[stage](spark, docs, SF)
    assert _stages()[stage](spark, docs.limit(0), SF).count() == 0
    if stage == "packing":
        pieces = Counter()
        for r in got.collect():
            pieces[r.doc_id] += r.length
        ends = Counter(r[0] for r in rows)  # an end id each; texts without words have nothing else
        assert set(pieces) == set(ends) and (pieces[20], pieces[21], pieces[22]) == (1, 1, 1) and pieces[24] == 2 * pieces[3]
        return
    assert got.dtypes == docs.dtypes
    out = got.collect()
    assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in out for c in CLASHING)
    ids = [r.doc_id for r in out]
    assert set(ids) - {20, 21, 22, 23} == {*range(10), None} | (set() if stage == "ngram_jaccard_join" else {24})
    if stage != "language_id":
        assert {20, 21, 22, 23} <= set(ids) and ids.count(24) == (0 if stage == "ngram_jaccard_join" else 2)


def test_near_duplicate_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", "".join(c.lower() if c.isascii() else c for c in t)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least, ids = {i: i for i in sets}, sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    assert {r.doc_id for r in _stages()["ngram_jaccard_join"](spark, docs, SF).collect()} == set(least.values())


def test_decontamination_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    words = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] if w for k in range(max(1, len(w) - 12))}
    stay = set()
    for r in docs.collect():
        w, hit = words(r.text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            stay.add(r.doc_id)
    assert stay != {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in _stages()["benchmark_decontamination"](spark, docs, SF).collect()} == stay
