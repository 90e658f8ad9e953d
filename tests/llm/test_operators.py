"""Each operator against a brute-force version and on awkward rows."""

import base64
import hashlib
import re
import zlib

import duckdb
import pytest

from tracefold.llm import chat, gif, html, langid, lines, mixing, setjoin, tokens, warc, winnow
from tracefold.llm.queries import ORACLES, QUERIES
from tracefold.llm.store import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string"
LONG = " ".join(f"w{i % 977}" for i in range(300_000))
AWKWARD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1, "x"),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1, "x"),
    (2, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "b", 0, None),
    (5, "short text", "de", None, 3, None),
    (6, LONG, "en", "a", 9, None),
    (7, "ÄÖ ü \t\r\n x\x00y", "de", "c", 9, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def _components(rows):
    sets = {}
    for i, t in rows:
        w = _words(t)
        sets.setdefault(i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                comp[q] = p
    return sorted((i, len(sets[i]), find(i)) for i, _ in rows)


def test_jaccard_components(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert sorted(map(tuple, QUERIES["op6_jaccard_join"](spark, SF).collect())) == _components(rows)


def test_jaccard_chain_and_large_group(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 30 + i % 30] + [f"u{i}"])) for i in range(70)]
    got = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == _components(rows)


def test_jaccard_awkward(docs, empty):
    got = sorted(map(tuple, setjoin.jaccard_components(docs).collect()))
    assert got == _components([(r[0], r[1]) for r in AWKWARD])
    assert setjoin.jaccard_components(empty).count() == 0


def test_pipeline_stages_equal_brute_force(spark):
    """Every stage on what the one before it kept; the language classifier, which has no other form, by its own predictions."""
    import corpus_pipeline as cp
    from tracefold.llm.store import materialize, table

    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    docs = table(spark, SF, "documents")
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        before, after = docs.toPandas(), out.toPandas()
        con.register("documents", before)
        kept, texts = sorted(after["doc_id"]), dict(zip(before["doc_id"], before["text"], strict=True))
        if name == "language_id":
            scored = langid.predict(docs, langid.fit(docs)).collect()
            assert kept == sorted(r["doc_id"] for r in scored if r["lang_pred"] != langid.UNDETERMINED and r["score"] >= cp.MIN_SCORE)
        elif name == "line_dedup":
            want = sorted(con.execute(f"SELECT doc_id, text_md5 FROM ({ORACLES['op5_line_templates']})").fetchall())
            got = sorted((i, hashlib.md5(t.encode()).hexdigest()) for i, t in zip(after["doc_id"], after["text"], strict=True))
            assert got == want
        elif name == "ngram_jaccard_join":
            assert kept == sorted(i for i, _, c in _components(list(texts.items())) if i == c)
        elif name == "benchmark_decontamination":
            assert kept == sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op10_decontaminate']}) WHERE NOT contaminated").fetchall())
        else:
            cols = "doc_id, source, size, source_size, target, taken, position"
            want = con.execute(f"SELECT {cols} FROM ({ORACLES['op2_mixing']})").fetchall()
            assert sorted(map(repr, map(tuple, out.select(*cols.split(", ")).collect()))) == sorted(map(repr, want))
        con.unregister("documents")
        docs = out
    assert sorted(map(repr, cp.run(spark, SF).collect())) == sorted(map(repr, docs.collect()))


def test_mixing_reaches_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", next(a[1] for a in AWKWARD if a[0] == r["doc_id"]) or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
    by = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert mixing.mix(empty).count() == 0


def test_winnowing_awkward(spark, docs, empty):
    items = spark.createDataFrame([(1, "Five six, seven! eight nine ten eleven twelve"), (2, None), (3, "short"), (3, "short"), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in winnow.contamination(docs, items).collect()}
    assert (1, 12, 8, ("1",)) in got and (5, 2, 1, ("3",)) in got and (3, 0, 0, ()) in got and (4, 0, 0, ()) in got
    assert winnow.contamination(empty, items).count() == 0
    assert winnow.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert {r[0] for r in winnow.decontaminate(docs, items).select("doc_id").collect()} == {3, 4, 6, 7}


def test_language_awkward(spark, docs, empty):
    text = {"aa": "the cat and the dog sat there", "bb": "der hund und die katze sind da"}
    train = spark.createDataFrame([(i, f"{t} {i % 7}", x, "s", 1, None) for i in range(40) for x, t in text.items()], DOCS)
    model = langid.fit(train)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert got[3] == got[4] == ("und", 0.0) and got[1][0] in text
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    again = langid.predict(train, model)
    assert again.filter("lang = lang_pred").count() == 80


def test_gif_round_trip():
    for raw in (b"", b"a" * 64, b"ab" * 150_000, bytes(range(256)) * 300, LONG.encode()[:200_000]):
        p = gif.payload_of(raw)
        assert b"".join(f.pixels.tobytes() for f in gif.decode(gif.encode(p))) == p


def test_gif_transparency_disposal_interlace():
    def frame(x, y, w, h, px, gce=b"", interlace=0):
        return gce + b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, interlace << 6]) + b"\x08" + gif._blocks(gif.lzw_encode(bytes(px)))

    head = b"GIF89a" + bytes([2, 0, 2, 0, 0xF7, 0, 0]) + gif.GREYS
    control = lambda disposal, t=None: b"\x21\xf9\x04" + bytes([disposal << 2 | (t is not None), 5, 0, t or 0]) + b"\0"
    data = head + frame(0, 0, 2, 2, [10, 20, 30, 40], control(1)) + frame(0, 0, 1, 1, [99], control(3)) + frame(0, 0, 2, 1, [7, 200], control(2, 7)) + frame(1, 1, 1, 1, [5]) + b"\x3b"
    seen = [(f.delay_cs, f.canvas[:, :, 0].ravel().tolist()) for f in map(lambda f: gif.Frame(f.index, f.delay_cs, f.disposal, f.pixels, f.canvas.copy()), gif.decode(data))]
    assert seen == [(5, [10, 20, 30, 40]), (5, [99, 20, 30, 40]), (5, [10, 200, 30, 40]), (0, [0, 0, 30, 5])]
    rows = head[:6] + bytes([1, 0, 8, 0]) + head[10:] + frame(0, 0, 1, 8, [0, 4, 2, 6, 1, 3, 5, 7], interlace=1) + b"\x3b"
    assert next(gif.decode(rows)).pixels.ravel().tolist() == list(range(8))
    with pytest.raises(ValueError):
        list(gif.decode(b"no gif at all"))


def test_gif_awkward(docs, empty):
    for r in gif.features(gif.store(docs)).collect():
        p = gif.payload_of(next(a[1] for a in AWKWARD if a[0] == r["doc_id"]).encode() if r["doc_id"] != 3 else b"")
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert gif.features(gif.store(empty)).count() == 0


def test_warc_awkward(spark):
    rows = [(1, "u", "a\r\n\r\nWARC/1.1\r\nx"), (2, "u", "b\r\n"), (2, "u", "b\r\n"), (3, "u", "c\r\n\r\n"), (4, None, None), (5, "u\n", ""), (None, "u", "b\r\n"), (7, "u", "\r\n\r\n\r\n")]
    path = new_path(spark, "w")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = list((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolved_records(spark, path).collect())
    d = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    kinds = {(1,): "response", (3,): "response", (4,): "response", (7,): "response"}
    want = [(str(p), len((h or "").encode()), d(h), "response" if (p,) in kinds else "revisit", None if (p,) in kinds else (4 if p == 5 else 2)) for p, _, h in rows]
    first = want.index(("2", 3, d("b\r\n"), "revisit", 2))
    want[first] = ("2", 3, d("b\r\n"), "response", None)
    assert sorted(map(str, got)) == sorted(map(str, want))


PAGE = """<html><body><nav><a href=x>menu</a></nav><div class="ad-1">buy</div><article><header><h1>T &amp; t</h1></header><p>One<br>two  <b>three</b>
<p>Four &lt;five&gt;<div class="comments"><p>rubbish</p></div><form>f</form></article><aside>side</aside><footer>&copy;</footer></body></html>"""


def test_html_awkward(spark):
    rows = [(1, "http://h.example/1", PAGE), (2, "http://h.example/2", None), (3, None, "plain   text"), (4, "bad url", "<p>a<script>var x='</p>'</script>b")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "T & t\n\nOne two three\n\nFour <five>"
    assert got[2] == ("", 0) and got[3] == ("plain text", 10) and got[4][0] == "ab"


def _page(body):
    return f"<html><body><nav><a href=x>menu</a></nav>{body}</body></html>"


def test_html_keeps_main_text_outside_one_container(spark):
    """A lead in the shared div and the body in another, sibling sections, an article beside more text."""
    lead, rest = "lead " * 30, "body " * 90
    rows = [(i, "http://h.example/a", _page(f'<div class="lead"><p>{lead}</p></div>')) for i in range(5)]
    rows += [
        (10, "http://h.example/b", _page(f'<div class="lead"><p>{lead}</p></div><div class="text"><p>{rest}</p></div>')),
        (11, "http://i.example/c", _page(f"<div><p>{rest}</p></div><div><p>{lead}</p></div>")),
        (12, "http://j.example/d", _page(f"<article><p>{rest}</p></article><section><p>{lead}</p></section>")),
    ]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    lead, rest = lead.strip(), rest.strip()
    assert got == {**{i: lead for i in range(5)}, 10: f"{lead}\n\n{rest}", 11: f"{rest}\n\n{lead}", 12: f"{rest}\n\n{lead}"}


def test_html_takes_back_marks_of_wrappers(spark):
    """Layout classes, a page-wide form and an unclosed nav hold the article; true boilerplate stays out."""
    text, other = "body " * 40, "other " * 10
    skip = "<div>Skip</div>"
    pages = {
        1: f'{skip}<div class="has-sidebar"><article><p>{text}</p></article><div class="sidebar">{other}</div></div>',
        2: f'<div class="page-header-fixed"><div class="top"><p>{text}</p></div><footer>{other}</footer></div>',
        3: f'<div id="nav-open"><main><p>{text}</p></main></div>',
        4: f"<form action=x><div><p>{text}</p></div><nav>{other}</nav></form>",
        5: f"<nav><a href=x>menu</a><article><p>{text}</p></article>",
        6: f'<article><p>{other}</p></article><div class="comments"><article>{text}</article></div>',
        7: f'<div class="post"><p>{text}</p></div><div class="related"><article>{other}</article><article>{other}</article></div>',
        8: f"<div><p>{other}</p></div><select><option>{text}</option></select>",
        9: f"<div hidden><p>{text}</p></div>",
        10: f'<form role="main"><p>{text}</p></form>{skip * 60}',
    }
    rows = [(i, f"http://h{i}.example/", f"<html><body>{p}</body></html>") for i, p in pages.items()]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text, other = text.strip(), other.strip()
    assert got[1] == f"Skip\n\n{text}" and got[10] == "\n\n".join([text, *["Skip"] * 60])
    assert [got[i] for i in range(2, 10)] == [text, text, text, text, other, text, other, text]


def test_chat_awkward(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, None, None), (None, 0, "user", "<|im_end|>")]
    got = {(r["conv_id"], r["n_turns"], r["n_copies"]) for r in chat.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(2, 2, 2), (4, 1, 1), (None, 1, 1)}


def test_lines_awkward(spark, docs, empty):
    assert lines.drop_templates(docs).count() == len(AWKWARD) and lines.drop_templates(empty).count() == 0
    own = lambda i, n: " ".join(chr(97 + i) * k for k in range(n, n + 8))
    rows = [(i, f"{own(i, 2)}\nVisit our page 12{i} times today\n{own(i, 20)}") for i in range(6)] + [(9, own(9, 2)), (10, own(9, 2))]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {**{i: (f"{own(i, 2)}\n{own(i, 20)}", 3, 1) for i in range(6)}, 9: (own(9, 2), 1, 0), 10: (own(9, 2), 1, 0)}


def test_lines_variable_field(spark):
    """One word that changes makes a field; a whole text that is copied is left alone."""
    own = lambda i, n: " ".join(chr(97 + i) * k for k in range(n, n + 9))
    copy = "\n".join(own(20, n) for n in (2, 20, 40))
    rows = [(i, f"{own(i, 2)}\nthis page was last seen by {chr(97 + i)} on monday morning\n{own(i, 20)}") for i in range(6)] + [(30 + i, f"{copy}\n{own(10 + i, 2)[:3]}") for i in range(6)]
    out = {r["doc_id"]: r["n_dropped"] for r in lines.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {**{i: 1 for i in range(6)}, **{30 + i: 0 for i in range(6)}}


def test_token_lengths(spark, docs, empty):
    enc = tokens.encoding(tokens.VOCABULARY)
    ls = [len(enc.encode_ordinary(r[1] or "")) for r in AWKWARD]
    h = tokens.length_histogram(tokens.encoded_lengths(docs))
    for r in h.collect():
        assert r["truncated_tokens"] == sum(min(x, r["length"]) for x in ls) and r["docs_at_least"] == sum(x >= r["length"] for x in ls)
    assert {r["limit"]: r["truncated_tokens"] for r in tokens.truncated_totals(h, [2, 8]).collect()} == {n: sum(min(x, n) for x in ls) for n in (2, 8)}
    assert tokens.length_histogram(tokens.encoded_lengths(empty)).count() == 0
