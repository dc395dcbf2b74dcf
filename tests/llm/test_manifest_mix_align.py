"""Merkle manifest, mixing and token alignment: against brute force, and on odd rows."""

import hashlib
import json
import os
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from privlake.llm import mixing, token_align
from privlake.llm import queries as q
from privlake.llm.merkle import folded, merkle_manifest, proof_text, row_digest
from privlake.llm.mixing import emit, mix_sources
from privlake.llm.queries import tokenizer_path
from privlake.llm.ranks import ranked
from privlake.llm.token_align import align_tokens

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level, fanout):
    """All levels of a tree, from the leaves up."""
    levels = [level]
    while len(level) > 1:
        level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        levels.append(level)
    return levels


def siblings(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at // fanout * fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


ROWS = [(i * 7 % 23, ["en", "de", None, "fr", "", "é"][i % 6 if i % 5 else 0], f"t{i}") for i in range(60)]
ROWS += [(None, "en", "no id"), (None, None, None), (5, "en", "t"), (5, "en", "t"), (5, "en", None), (1, "one", ""), (2, "xx", "w " * 300_000)]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 12), (2, 1), (2, 2), (3, 1)])
def test_manifest_by_brute_force(spark, fanout, levels):
    docs = spark.createDataFrame(ROWS, "doc_id long, lang string, text string").withColumn("root", F.lit(1)).withColumn("_pos", F.lit("p")).withColumn("a.b", F.lit(2))
    got = merkle_manifest(docs, row_digest("doc_id", "lang", "text"), columns=["_pos", "root", "a.b"], fanout=fanout, levels=levels)
    assert got.columns == ["doc_id", "lang", "_pos", "a.b", "leaf", "subroot", "root", "proof"]
    got = got.withColumn("folded", folded(F.col("leaf"), F.col("proof"))).withColumn("all", proof_text(F.col("proof"))).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r)))))
    trees = {g: tree([x[2] for x in sorted(v)], fanout) for g, v in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order], fanout)
    want = Counter()
    for g, v in groups.items():
        for at, (has, i, leaf) in enumerate(sorted(v)):
            proof = siblings(trees[g], at, fanout) + siblings(top, order.index(g), fanout)
            want[i if has else None, g, leaf, trees[g][-1][0], top[-1][0], "".join(a + b for a, b in proof)] += 1
    assert Counter((r.doc_id, r.lang, r.leaf, r.subroot, r.root, r.all) for r in got) == want
    assert all(r.folded == r.root for r in got)


def test_manifest_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, lang string, text string")
    assert merkle_manifest(docs.limit(0), row_digest("doc_id")).count() == 0
    (one,) = merkle_manifest(docs.limit(1), row_digest("doc_id")).collect()
    assert one.leaf == one.subroot == one.root and one.proof == []
    digests = docs.select(row_digest("doc_id", "text").alias("d"), row_digest(F.col("doc_id") + 1, "text").alias("e"), "doc_id").collect()
    assert all((r.d == r.e) == (r.doc_id is None) for r in digests)


def test_manifest_query_finds_what_was_tampered_with(spark):
    got = q.op11_merkle_manifest(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in got) and len({r.verified for r in got}) == 2


def test_ranked_spreads_a_group_over_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 7919 % 977).alias("v"))
    got = ranked(rows, "g", ["v"])
    by = defaultdict(list)
    for r in got.collect():
        by[r.g].append((r._pos, r.v, r._n))
    for g, n in (("a", 4500), ("b", 500)):
        assert [x[0] for x in sorted(by[g])] == list(range(n)) and {x[2] for x in by[g]} == {n}
        assert [x[1] for x in sorted(by[g])] == sorted(x[1] for x in by[g])


def plan_of(sizes, weights, most):
    """Targets by the rule as it is told: share, stop what is above, share the rest again."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        rest, open_ = total - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / open_ for s in names}
        above = {s for s in names if target[s] > most * sizes[s]} - full
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("few", [20_000, 0])
def test_mix_by_brute_force(spark, few):
    rows = [(i, f"s{i % 9}" if i % 3 else "hot", "w\x0b" * (i % 40) + "end" * (i % 2)) for i in range(900)]
    rows += [(None, None, "null source and id"), (7000, "empty", ""), (7001, "void", None), (7002, "big", "x " * 200_000), (7003, "big", " \n"), (7002, "big", "x " * 200_000)]
    rows += [(8000 + k, f"\U0001f600{k}" if k % 2 else f"￮{k}", "a b c") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("t")).withColumn("_size", F.lit(3)).withColumn("a.b", F.lit(1))
    got = mix_sources(docs, few=few)
    assert [c for c in got.columns if c not in ("size", "source_size", "target", "rate", "copies")] == ["doc_id", "source", "text", "_size", "a.b"]
    out = got.collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    target = plan_of(sizes, (5, 2, 1), 3)
    assert Counter((r.doc_id, r.source, r.text, r.size, r.source_size) for r in out) == Counter((i, s, t, len((t or "").split()), sizes[s]) for i, s, t in rows)
    assert all(abs(r.target - target[r.source]) <= 1e-9 * (1 + target[r.source]) for r in out)
    for r in out:
        drawn = int(sha(f"0|{r.doc_id if r.doc_id is not None else r.text}")[:13], 16) / (1 << 52)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies == int(rate) + (drawn < rate - int(rate)) and r.copies <= 3
    again = mix_sources(docs.repartition(7), few=few)
    assert Counter((r.doc_id, r.copies) for r in again.collect()) == Counter((r.doc_id, r.copies) for r in out)
    assert emit(again).count() == sum(r.copies for r in out)
    assert mix_sources(docs.limit(0), few=few).count() == 0
    assert {(r.target, r.copies) for r in mix_sources(docs.where("doc_id in (7000, 7001)"), few=few).collect()} == {(0.0, 0)}


def test_mix_comes_near_its_targets(spark):
    taken, target = Counter(), {}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    for r in mix_sources(docs).select("source", "size", "target", "copies").collect():
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.15 * target[s] for s in target)
    assert mixing.HEAVY > 0


def brute_alignment(texts):
    """Whole texts by both tokenizers, and every pair of tokens looked at by its end."""
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a_path, b_path = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    shown = [n for n in range(256) if 33 <= n <= 126 or 161 <= n <= 172 or n >= 174]
    table = {chr(n): n for n in shown}
    for n in range(256):
        if n not in shown:
            table[chr(256 + len(table) - len(shown))] = n
    with open(a_path, encoding="utf-8") as f:
        entries = {i: bytes(table[c] for c in x) for x, i in json.load(f)["model"]["vocab"].items() if i != 50256}

    def piece(i):
        x = b.id_to_piece(i)
        return bytes.fromhex(x[3:5]) if b.is_byte(i) else x.replace("▁", " ").encode()

    docs = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(entries[i] for i in ids_a) != raw or b"".join(map(piece, ids_b)) != raw:
            ids_a, ids_b = [], []
        end_a, end_b = (list(accumulate(map(len, x))) for x in ([entries[i] for i in ids_a], [piece(i) for i in ids_b]))
        shared = sorted(set(end_a) & set(end_b))
        links = [(ids_a[bisect_left(end_a, e)], ids_b[bisect_left(end_b, e)]) for e in shared]
        groups = [[[], []] for _ in shared]
        for side, (ids, ends) in enumerate(((ids_a, end_a), (ids_b, end_b))):
            for i, e in zip(ids, ends, strict=True):
                groups[bisect_left(shared, e)][side].append(str(i))
        docs.append((len(ids_a), len(ids_b), len(shared), links, ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)))
    counts = Counter(x for d in docs for x in d[3])
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = [(d[0], d[1], d[2], len(d[3]), sum(counts[x] == most[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), sha(d[4]) if d[4] else "", d[4]) for d in docs]
    return rows, {(x, y, n, n == most[y]) for (x, y), n in counts.items()}


ODD = ["", " ", "  two  spaces ", "tab\tand\nlines \n\n x", "a▁b", "café été naïve × ÷ x", "  nbsp  x   y", "日本語 文字", "\U0001f600 \U0001f468‍\U0001f469 x", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll I'M", "x" * 20_000, "1234567 12 ", "\x00 nul \x1f us \x85 nel", "é combining", "!!! ??? ... --", " 's 'll ' s", "▁", "﻿bom", "tail space ", "Ǆ ɸ Ͱ x"]


def test_alignment_of_odd_texts_by_brute_force(spark, monkeypatch):
    texts = [*ODD, None, " ".join(f"w{i % 997}" for i in range(30_000)), ODD[5], ODD[5], " ".join(o for o in ODD if "▁" not in o)]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").withColumn("_doc", F.lit(0)).withColumn("a.b", F.lit(0))
    want, pairs = brute_alignment(texts)
    args = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    got, linked = align_tokens(docs, *args)
    assert {(r.a, r.b, r.links, r.best) for r in linked.collect()} == pairs
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, w in enumerate(want):
        r = rows[i if i != 3 else None]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) == w, texts[i]
    assert align_tokens(docs.limit(0), *args)[0].count() == 0


def test_alignment_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute_alignment([r.text for r in docs])
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in q.op12_token_alignment(spark, SF).collect()}
    assert got == {r.doc_id: w[:7] for r, w in zip(docs, want, strict=True)}
    assert token_align.CHUNK > 0
