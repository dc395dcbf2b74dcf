"""Every operator on nulls, empty and very long texts, repeated rows, an empty table, and columns with clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from privlake.llm import audio, common, packing, toxicity
from privlake.llm.common import components, durable, release, scratch
from privlake.llm.decontaminate import decontaminate
from privlake.llm.html_text import extract_text, html_text
from privlake.llm.langid import Settings, held_out, train_language_model
from privlake.llm.line_templates import drop_recurring_lines
from privlake.llm.ngram_join import ngram_components
from privlake.llm.queries import tokenizer_path
from privlake.llm.suffix_dedup import drop_repeated_bytes
from privlake.llm.toxicity import _sample, train_toxicity_model
from privlake.llm.unit_dedup import drop_repeated_units

LONG = " ".join(f"w{i % 997}" for i in range(40_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (3, None),
    (4, ""),
    (5, " \n\t \n"),
    (6, LONG),
    (7, LONG + " tail"),
    (8, "é" * 500),
    (None, "text without an id that is its own document here"),
    (9, "same row twice in the table"),
    (9, "same row twice in the table"),
]


def frame(spark, rows=ROWS):
    """Documents with columns whose names operators could use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", "x", 0.5, [1]) for i, t in rows], "doc_id long, text string, lang string, source string, _text string, score double, removed array<int>")
    return df.withColumn("_key", F.lit(1)).withColumn("n_words", F.lit("n")).withColumn("component_id", F.lit(0)).withColumn("token", F.lit(0)).withColumn("_doc", F.lit(0))


def items(spark, rows=((1, "beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (None, "same row"))):
    return spark.createDataFrame(list(rows), "item_id long, text string").withColumn("_window", F.lit(1))


def rows_of(df):
    return {(r.doc_id, i): r for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))}


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_decontaminate(spark):
    got = by_id(decontaminate(frame(spark), items(spark)))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [(r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got[1] + got[2]] == [(10, 9, ["1"], True)] * 2
    assert [(r.n_words, r.n_hit, r.contaminated) for k in (3, 4, 5) for r in got[k]] == [(0, 0, False)] * 3
    assert [(r.n_hit, list(r["items"])) for r in got[9]] == [(2, [""])] * 2
    assert got[6][0].n_words == 40_000
    assert decontaminate(frame(spark).limit(0), items(spark)).count() == 0
    assert by_id(decontaminate(frame(spark), items(spark).limit(0)))[1][0].n_hit == 0


def test_line_dedup(spark):
    rows = [(i, f"User {i} logged in from host {i * 7}\n{chr(97 + i)}{chr(98 + i)} own line number words here\n\n") for i in range(12)] + [(20, None), (21, ""), (None, "User 99 logged in from host 4"), (22, LONG)]
    got = by_id(drop_recurring_lines(frame(spark, rows), columns=["lang", "score"]))
    assert got[3][0].text == "de own line number words here\n\n" and got[3][0].n_dropped == 1 and got[3][0].lang == "en"
    assert got[20][0].text is None and got[20][0].n_lines == 0 and got[21][0].text == "" and got[21][0].n_lines == 1
    assert got[None][0].text == "" and got[22][0].text == LONG
    first = by_id(drop_recurring_lines(frame(spark, rows), keep_first=True))
    assert sum(r.n_dropped for v in first.values() for r in v) == 12 and first[None][0].n_dropped == 0  # the null id ranks first
    copies = [(i, "one line that many copies share\nand a second") for i in range(30)]
    assert all(r.n_dropped == 0 for r in drop_recurring_lines(frame(spark, copies)).collect())
    assert drop_recurring_lines(frame(spark).limit(0)).count() == 0


def test_line_dedup_variables_without_digits(spark):
    rows = [(i, f"Posted by user {n} in general today ok fine") for i, n in enumerate("ann bob cid dan eve fay gus hal ida jon".split())]
    got = drop_recurring_lines(frame(spark, rows), min_docs=10).collect()
    assert all(r.n_dropped == 1 for r in got)


def test_line_dedup_of_verbatim_lines(spark):
    passage = " ".join(f"{chr(97 + k % 26) * 5}{chr(97 + k // 26)}" for k in range(55))
    rows = [(i, f"{chr(97 + i) * 9} own\n{passage} \nshort line") for i in range(3)] + [(3, "aaaaaaaaa own\n" + rest) for rest in (passage, passage + "\nx")]
    rows.append((0, rows[0][1]))
    pair = "two texts only " + passage
    rows += [(8, pair + "\na"), (9, pair + "\nb")]
    got = by_id(drop_recurring_lines(frame(spark, rows), keep_first=True, min_texts=3))
    assert [r.text for r in got[0]] == [rows[0][1]] * 2  # the first, and its copy
    assert got[1][0].text == "bbbbbbbbb own\nshort line" and got[2][0].text == "ccccccccc own\nshort line"
    assert sorted(r.text for r in got[3]) == ["aaaaaaaaa own", "aaaaaaaaa own\nx"]
    assert got[8][0].n_dropped == got[9][0].n_dropped == 0
    assert by_id(drop_recurring_lines(frame(spark, rows), keep_first=True, min_texts=2))[9][0].text == "b"
    assert sum(r.n_dropped for r in drop_recurring_lines(frame(spark, rows), keep_first=True).collect()) == 0


def brute_components(rows, n, num):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_ngram_join(spark):
    got = by_id(ngram_components(frame(spark), n=3, num=90))
    assert sum(map(len, got.values())) == len(ROWS)
    assert {k: got[k][0].component_id for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, None)} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, None: None}
    assert (got[3][0].n_shingles, got[8][0].n_shingles) == (0, 1)
    assert ngram_components(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("n,num,filter_rows", [(3, 90, 1 << 25), (5, 80, 1 << 25), (5, 80, 0)])
def test_ngram_join_of_a_large_group(spark, n, num, filter_rows):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            words[at] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(frame(spark, rows), n=n, num=num, filter_rows=filter_rows).collect()}
    assert got == brute_components(rows, n, num)


def test_components_in_rounds_equal_one_task(spark):
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2))], "a long, b long")
    assert sorted(components(edges).collect()) == sorted(components(edges, local_edges=0).collect())


def test_packing(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [*ROWS, (10, "ends in <|endoftext|> or <|ENDOFTEXT|>"), (11, "It's d'été… …, A1b2")]
    got = packing.pack(frame(spark, rows), path, windows=3).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    expected = {}
    for i, text in rows:
        expected.setdefault(i, []).append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, whole in expected.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, whole))
        for r in pieces[i]:
            own = whole[0][r.start : r.start + r.length]
            assert (r.ids_crc32, bytes(r["ids"]), r.doc_tokens) == (zlib.crc32(own.tobytes()), own.tobytes(), len(whole[0]))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0
    assert packing.pack(frame(spark).limit(0), path).count() == 0


def test_audio(spark):
    got = by_id(audio.audio_columns(frame(spark)))
    assert sum(map(len, got.values())) == len(ROWS)
    for i, text in ROWS:
        raw = (text or "").encode()
        samples, rate = audio.read_wav(bytes(got[i][0].media))
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert samples.tobytes() == padded and rate == 16000
        chunks = audio.read_tensors(bytes(got[i][0].tensors))
        assert chunks["log_mel"].type.shape == [16, 40] and len(chunks) == -(-got[i][0].frames // 16)
    assert got[1][0].tensors == got[2][0].tensors
    assert audio.audio_columns(frame(spark).limit(0)).count() == 0


def test_audio_segments_have_hysteresis():
    s = audio.Settings()
    energy = np.array([0, 0, 0, 0, 1, 3, 1, 0, 1, 0, 0, 0, 0, 0, 0], float)
    assert audio.segments(energy, s) == [(4, 7)]


def test_tone_lights_its_own_mel_band():
    s = audio.Settings()
    t = np.arange(16000) / 16000
    low, high = (audio.log_mel(audio.resample(np.sin(2 * np.pi * f * t), 1, 2), s)[0].mean(axis=0).argmax() for f in (300, 2500))
    assert low < high


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><th rowspan=2>Name<th>Jan<tr><td>31</table>", "Name  Jan\n      31"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>z<td>y</table>", "a  b\n   c\nz  y"),
        ("<table><tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d<td>e<tr><td>1<td>2<td>3<td>4</table>", "ab     c\n       d  e\n1   2  3  4"),
        ("<details>body<summary>S</summary>x</details><details open><summary>T</summary>y</details>", "S\nT\ny"),
        ("<dialog>d</dialog><dialog open>e</dialog><ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "e\nab"),
        ("<svg>no<g>no</g><text>yes <tspan>t</tspan></text><title>n</title><defs><text>d</text></defs><path/></svg>after", "yes t after"),
        ("<plaintext>a<b></plaintext>c", "a<b></plaintext>c"),
        ("<p>Name: <input value=Bob><input type=hidden value=x><input type=password value=p><input placeholder=ph>", "Name: Bob ph"),
        ("<ol reversed><li>a<li>b</ol>", "  2. a\n  1. b"),
        ("<ol start=3><li>a<li value=7>b<li value=x>c</ol>", "  3. a\n  7. b\n  8. c"),
    ],
)
def test_html_spans_numbers_and_closed_parts(html, text):
    assert html_text(html) == text


@pytest.mark.parametrize("page", ["<p>x" + "</b>" * 500_000, "<p><table><tr><td>" + "<i>" * 300_000 + "</p>" * 300_000, "<table>" + "<form>" * 150_000 + "<td>x", "<svg>" + "<g>" * 200_000 + "<path/>" * 100_000])
def test_html_takes_time_in_proportion(page):
    import time

    def seconds(part):
        now = time.process_time()
        html_text(part)
        return time.process_time() - now

    small, whole = seconds(page[: len(page) // 8]), seconds(page)
    assert whole < 8 * 4 * small + 1


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a<p>b"), (3, "<p>a<p>b"), (4, "<div " * 3000), (5, "<b>" * 5000 + "x")], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r.page_id, r.text) for r in extract_text(pages).collect()), key=lambda r: r[0])
    assert got[:4] == [(1, None), (2, ""), (3, "a\n\nb"), (3, "a\n\nb")] and got[5][1] == "x"
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html,text",
    [
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "  - a\n  - b\n    - c"),
        ("<ol start=3><li>a<li>b</ol>", "  3. a\n  4. b"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("a<span style='display:none'>no</span><span hidden>no</span><span style='opacity:0.5'>yes</span>", "ayes"),
        ("<h1>T</h1>x<br>y<script>no</script><!-- no -->", "T\n\nx\ny"),
        ("<pre>a  b\n c</pre>", "a  b\n c"),
        ("<p>one <b>two</b>\n three &amp; <i>four", "one two three & four"),
        ("</div></p>x</b>", "x"),
    ],
)
def test_html_layout(html, text):
    assert html_text(html) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<head><title>T</title><p>Hello <b>you</b><div>there</div>", "Hello you\n\nthere"),
        ("<html><head><meta charset=utf-8><style>p{}</style>\n<h1>A</h1>b", "A\n\nb"),
        ("<head><title>T</title> plain text <i>first</i>", "plain text first"),
        ("<head><title>T</title><script>no</script><noscript><p>no</noscript></head><body>yes", "yes"),
        ("<div>a<svg/>b</div>c", "ab\nc"),
        ("<p>a<math />b<p>c", "ab\n\nc"),
        ("<p>a<math><mi/>x<mo/>y</math>b", "axyb"),
        ("a<svg><g/><title>no</title><path/></svg>b", "ab"),
        ("<div/>a", "a"),
    ],
)
def test_html_implied_body_and_foreign_elements(html, text):
    assert html_text(html) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<table><tr><form><td>a</td><td>b</td></form></tr><tr><td>cc<td>d</table>", "a   b\ncc  d"),
        ("<table><form><tr><td>a<td>b</tr></form></table>", "a  b"),
        ("<table><tbody><form><input><td>a<td>b<tr><td>c</form></table>", "a  b\nc"),
        ("<table><tr>big <b>loose</b> text<td>a</tr></table>", "big loose text  a"),
        ("<table>first<tr><td>a</tr>mid<tbody>in<tr><td>b</tr></tbody>last</table>", "first\na\nmid\nin\nb\nlast"),
        ("<table><tr><td>a</td><div hidden><td>no</td></div><!-- no --> <script>no</script></tr></table>", "a"),
        ("<table><tr><div>x<table><tr><td>in</table></div><td>a</tr></table>", "x in  a"),
        ("<b aria-hidden=true>yes</b>", "yes"),
        ("<textarea>\na <b>c</b> &amp;\n  d</textarea>e", "a <b>c</b> &\n  de"),
        ("<p>x <textarea>left open &lt;", "x left open <"),
        ("<select><option>a<option selected>b<option>c</select>", "b"),
        ("<select><option disabled>a<optgroup disabled label=g><option>b</optgroup><option label=' L '>c</select>", "L"),
        ("<select><option hidden selected>Choose<option>b</select>", "Choose"),
        ("x<select multiple><option>a<optgroup label=g><option hidden>no<option>b</select>y", "x\na\ng\nb\ny"),
        ("<select size=2><option>a<option>b</select>", "a\nb"),
        ("<select hidden><option>a</select><textarea style='display:none'>b</textarea>", ""),
    ],
)
def test_html_keeps_loose_table_text_and_form_text(html, text):
    assert html_text(html) == text


def test_units(spark):
    rows = [*ROWS, (20, "First line stays here.\nA sentence of several words stands here. Another sentence of many words too."), (21, "Lead in words. a  Sentence of several WORDS stands here. Then something that is new.")]
    got = by_id(drop_repeated_units(frame(spark, rows), min_words=3))
    assert sum(map(len, got.values())) == len(rows)
    assert got[1][0].n_removed == 0 and got[2][0].text == "" and got[3][0].text is None and got[5][0].n_units == 0
    assert got[20][0].n_removed == 0
    assert [(s.start, s.end) for s in got[7][0].removed] == [] and got[6][0].text == LONG
    assert drop_repeated_units(frame(spark).limit(0)).count() == 0


def test_units_resume_after_a_different_start(spark):
    passage = "this long sentence has seven words altogether. and here is the second long one."
    got = by_id(drop_repeated_units(frame(spark, [(1, "Some own start of words. " + passage), (2, "Other. Different beginning with more words. " + passage)]), min_words=3))
    assert got[2][0].text == "Other. Different beginning with more words. " and got[1][0].n_removed == 0


def test_short_lines_stay_once(spark):
    line = "a line of nine words that many documents share"
    rows = [(i, f"{line}\n{'own ' * i}text {i}. {line}\n") for i in range(200)] + [(None, f"x\n{line}. Two more short words. And other ones here.\n{line}"), (300, f"{line}. And other ones here. Two more short words.\n")]
    got = by_id(drop_repeated_units(frame(spark, rows)))
    assert got[None][0].n_removed == 0  # ranks first
    assert all(got[i][0].text.startswith("own" if i else "text") and got[i][0].n_removed == 1 for i in range(200))
    assert sum(r.text.count(line + "\n") for v in got.values() for r in v) == 200 and got[300][0].n_removed == 0
    assert all(r.n_removed == 0 for v in by_id(drop_repeated_units(frame(spark, rows[:200]), min_line_words=10)).values() for r in v)


def test_short_units_go_only_in_runs(spark):
    short, run = "line of four words", "one short line here\nand the next short line\nthen a third one of them\nand one more at last"
    rows = [(1, short + "\nown text one\n" + run), (2, "own text two\n" + short), (3, run + "\nown text three"), (3, run + "\nown text three"), (None, "nothing of all that")]
    got = by_id(drop_repeated_units(frame(spark, rows)))
    assert got[2][0].n_removed == 0 and got[1][0].n_removed == 0 and got[None][0].n_removed == 0
    assert [r.text for r in got[3]] == ["own text three"] * 2 and got[3][0].n_removed == 4


def brute_bytes(rows, size):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            seen[b[p : p + size]] = seen.get(b[p : p + size], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                mask[p : p + size] = b"\1" * size
        out.append((i is None, i or 0, len(b), sum(mask), bytes(x for x, m in zip(b, mask, strict=True) if not m)))
    return sorted(out)


@pytest.mark.parametrize(("hot", "filters"), [(20_000, 1 << 25), (1, 1 << 25), (20_000, 0), (1, 0)])
def test_repeated_bytes(spark, hot, filters):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared, other = word(260), word(230)
    rows = [(1, word(100) + shared + word(90)), (2, shared[:230] + word(50) + other), (3, other + shared[40:]), (4, "ab" * 300), (5, word(199)), (6, None), (7, ""), (8, "é" * 150), (9, shared), (9, shared), (None, word(10) + other[15:225]), (10, word(3000))]
    got = drop_repeated_bytes(frame(spark, rows), hot_contexts=hot, filter_rows=filters).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == brute_bytes(rows, 200)
    assert all(r.n_removed == sum(s.end - s.start for s in r.removed) for r in got)


def test_repeated_bytes_of_an_empty_table(spark):
    assert drop_repeated_bytes(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize(
    "html,text",
    [
        ("a<![foo[bar]]>b", "ab"),
        ("a<!-- no end <b>x</b>", "a"),
        ("<table><tr><td colspan=" + "9" * 5000 + ">a<td>b</table>", "a" + " " * 2000 + "b"),
        ('<p style="-webkit-backface-visibility:hidden">seen</p>', "seen"),
        ('<div style="visibility: hidden">no<b style="visibility:visible">yes</b>no</div>', "yes"),
        ('<div style="display:none">no<b style="display:inline">no</b></div>x', "x"),
        ('<p style="opacity:0.0">no</p><p style="opacity:0.5">half</p><p style="opacity:0%">no</p>', "half"),
        ("<div>" * 2000 + "<script>var x=1;</script><span hidden>secret</span>ok", "ok"),
        ("<table><tr><td>" * 50 + "a<td>b", "a b"),
        ("<table>" + "<form>" * 3000 + "<tr><td>a<td>b", "a  b"),
        ("<select>" + "<option>a<select>" * 999, "a" * 999),
        ("<input type=submit value=Send> <input value=typed>", "Send typed"),
    ],
)
def test_html_odd_pages(html, text):
    assert html_text(html) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<![ <!-- --> <! ]]> <![CDATA[ <? > <table> <tr> <td colspan=3> </table> <select> <option> <ul> <li> <p> </p> <b> </b> <svg/> <math> <textarea> </textarea> <script> </script> <pre> & &#0; &amp <head> </head> <body> word \0 \r\n é <div style='visibility:hidden'> <a href=' = ' < / 9".split(" ")), max_size=40))
def test_html_never_fails(parts):
    assert isinstance(html_text(" ".join(parts)), str) and isinstance(html_text("".join(parts)), str)


def test_language_model(spark):
    words = {"en": "the and of with this that from have", "fr": "le la de et que pour avec dans", "de": "der die und von mit für auch nicht"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i, lang in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    learned = train_language_model(docs.where(~held_out("doc_id")))
    got = learned.predict(docs.where(held_out("doc_id"))).collect()
    assert got and np.mean([r.lang == r.lang_pred for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)
    clash = frame(spark).withColumnRenamed("score", "SCORE").withColumn("_p", F.lit(7)).withColumn("_row", F.lit(8))
    odd = by_id(learned.predict(clash))
    assert set(odd[1][0].asDict()) == {*clash.columns, "lang_pred", "score"} - {"SCORE"} and (odd[1][0]._p, odd[1][0]._row) == (7, 8)
    assert [odd[k][0].lang_pred for k in (3, 4, 5)] == ["und"] * 3 and odd[3][0].score == 0.0
    none = train_language_model(docs.limit(0))
    assert {r.lang_pred for r in none.predict(docs).collect()} == {"und"}


def test_language_model_knows_rare_languages(spark):
    words = {"en": "the and of with this that from have", "fr": "le la de et que pour avec dans", "xx": "zyq wqx qqz", "yy": "kkj jjk"}
    rows = [(i, words["en" if i % 2 else "fr"], "en" if i % 2 else "fr") for i in range(3000)] + [(3000 + i, words["xx"], "xx") for i in range(40)] + [(4000, words["yy"], "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = train_language_model(docs, settings=Settings(max_rows=60))
    assert learned.classes == ("en", "fr", "xx", "yy")
    assert learned.predict(docs.where("lang = 'xx'")).where("lang_pred = 'xx'").count() == 40


def test_toxicity_model(spark):
    rng = np.random.default_rng(4)
    plain, bad = "the river runs by a green hill and sun".split(), ["vilefool", "rotscum", "m0ron"]
    rows = []
    for i in range(400):
        words, toxic = list(rng.choice(plain, 20)), int(i % 4 == 0)
        if toxic:
            words[int(rng.integers(0, 20))] = bad[i % 3]
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = held_out("doc_id", 4, 2)
    model = train_toxicity_model(docs, docs.where(~out))
    got = model.predict(docs.where(out)).collect()
    assert np.mean([r.toxic == r.predicted for r in got]) > 0.95
    clash = frame(spark).withColumnRenamed("score", "Score").withColumn("_raw", F.lit(7)).withColumn("_margin", F.lit(8)).withColumn("_features", F.lit("f"))
    odd = model.predict(clash)
    assert odd.columns == [c for c in clash.columns if c != "Score"] + ["score", "predicted"]
    assert all(0 <= r.score <= 1 and (r._raw, r._margin, r._features) == (7, 8, "f") for r in odd.collect())
    flat = train_toxicity_model(docs, docs.where("toxic = 0"))
    assert {r.score for r in flat.predict(docs).collect()} == {0.0}
    assert train_toxicity_model(docs.limit(0), docs.limit(0)).predict(docs.limit(0)).count() == 0


def test_toxicity_sample_is_bounded_when_one_id_has_many_rows(spark):
    rows = [(1, f"text {i} vilefool") for i in range(300)] + [(1, "same")] * 50 + [(2, "clean"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    many = _sample(docs, labels, "text", "toxic", "doc_id", toxicity.Settings(max_rows=50)).count()
    assert 20 <= many <= 100
    assert _sample(docs, labels, "text", "toxic", "doc_id", toxicity.Settings()).count() == 303


def test_toxicity_measures_each_text_by_itself():
    lexicon, s = {"vilefool": 2.0, "scum~": 1.0}, toxicity.Settings()
    texts = ["You are a V1LEFOOL!!", "vilefool", "", "you", "a b c d e f g scummy you", " \u00b4you SCUM\u00b4mers ", "x " * 50 + "vilefool"]
    together = toxicity._feature_lists(texts, toxicity._Measures(lexicon, s))
    alone = [toxicity._feature_lists([t], toxicity._Measures(lexicon, s))[0] for t in texts]
    assert np.allclose(together, alone)
    named = [dict(zip(toxicity.FEATURES, map(float, r), strict=True)) for r in together]
    assert named[0]["near_second_person"] == 0.25 and named[0]["obfuscated_hits"] == 1 and named[1]["near_second_person"] == 0
    assert named[2] == dict.fromkeys(toxicity.FEATURES, 0.0) and named[3]["any_word"] == 0
    assert named[4]["stem_count"] == 1 and named[4]["near_second_person"] == 1 / 9 and named[6]["word_count"] == 1


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out("doc_id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_kept_bytes_digest(spark):
    got = drop_repeated_bytes(frame(spark, [(1, "abc")])).select(F.sha2("kept", 256)).first()[0]
    assert got == hashlib.sha256(b"abc").hexdigest()


@pytest.mark.parametrize("kind", ["decimal(20,0)", "smallint", "date"])
def test_ids_of_other_kinds(spark, kind):
    rows = [(k, " ".join(f"word{i}" for i in range(60))) for k in (1, 2)] + [(3, "other text")]
    number = F.col("doc_id")
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), number) if kind == "date" else number.cast(kind))
    assert [r.n_removed > 0 for r in drop_repeated_bytes(docs).orderBy("doc_id").collect()] == [True, True, False]
    for out in (ngram_components(docs), packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False), audio.audio_columns(docs)):
        assert dict(out.dtypes)["doc_id"] == kind and out.select("doc_id").distinct().count() == 3


def test_written_tables_go(spark, tmp_path, monkeypatch):
    import threading

    there = lambda: sum(1 for x in tmp_path.iterdir() if x.name.startswith("privlake-"))
    release(spark)
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    with scratch(spark):
        found = drop_repeated_units(frame(spark))
        assert there() and found.count() == len(ROWS)
        kept = durable(frame(spark), outlive=True)
        other = threading.Thread(target=lambda: durable(spark.range(3)))
        other.start()
        other.join()
        with scratch(spark):
            durable(spark.range(1))
            before = there()
        assert there() == before - 1
    assert there() == 2 and kept.count() == len(ROWS)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        durable(spark.range(1)).count() / 0
    assert there() == 2
    release(spark)
    assert there() == 0


def test_audio_features_by_brute_force():
    s, r = audio.Settings(), np.random.default_rng(7)
    divisor = int(np.gcd(s.rate, s.stored_rate))
    for n in (1, 64, 1000, 4999):
        x = r.uniform(-1, 1, n)
        for up, down in ((s.rate // divisor, s.stored_rate // divisor), (3, 2), (2, 5), (1, 1)):
            h, stuffed = audio._filter(up, down), np.zeros(n * up)
            stuffed[::up] = x
            whole = np.convolve(stuffed, h)
            want = [whole[len(h) // 2 + m * down] for m in range(-(-n * up // down))]
            assert np.allclose(audio.resample(x, up, down), want, atol=1e-9)
        mel, energy = audio.log_mel(x, s)
        padded = np.concatenate([x, np.zeros(max(0, s.frame - n))])
        assert len(mel) == max(1, 1 + (n - s.frame) // s.hop)
        for k in (0, len(mel) // 2, len(mel) - 1):
            frame = padded[k * s.hop : k * s.hop + s.frame] * np.hanning(s.frame)
            bins, power = np.arange(s.fft // 2 + 1), []
            for b in bins:
                angle = -2 * np.pi * b * np.arange(s.frame) / s.fft
                power.append(np.sum(frame * np.cos(angle)) ** 2 + np.sum(frame * np.sin(angle)) ** 2)
            assert np.allclose(mel[k], np.log(np.array(power) @ audio._mel(s) + 1e-6), atol=2e-3)
            assert abs(energy[k] - 10 * np.log10(np.mean(frame**2) + 1e-9)) < 1e-6
    for _ in range(50):
        energy = np.cumsum(r.normal(0, 4, 80))
        found, run, middle = [], [], np.median(energy)
        for k, e in enumerate([*energy, -np.inf]):
            if e > middle + s.low_db:
                run.append((k, e))
            else:
                if any(e > middle + s.high_db for _, e in run):
                    found.append((run[0][0], k))
                run = []
        assert audio.segments(energy, s) == found
