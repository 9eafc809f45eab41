from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import ODD, SMALL, words
from pyspark.sql import functions as F

from sparkgraph.llm import html_extract
from sparkgraph.llm.chat import format_chats, parse
from sparkgraph.llm.decontaminate import build, decontaminate, scan
from sparkgraph.llm.dom import read
from sparkgraph.llm.queries import HOSTILE, op7_html_extract, op8_chat_format
from sparkgraph.llm.textvec import ALNUM, SPACED, Words, hash_words, prefix_hash, rows_by_bytes, run_hash, shingles

LOWER = {c: c + 32 for c in range(65, 91)}


# Words and hashes


def test_words_are_those_of_the_patterns():
    import pyarrow as pa

    texts = [t for _, t in ODD]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for kind, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        for limit in (1, 100, 1 << 20):
            got = []
            for rows, data, offsets in rows_by_bytes(batch, "text", limit):
                w = Words(data, offsets, kind)
                raw = data.tobytes()
                got += [[raw[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
            assert got == [re.findall(pattern, t or "") for t in texts]


def test_hashes_depend_on_the_word_only(monkeypatch):
    data = np.frombuffer("ab é Ab ab\0 ab".encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]))
    h = w.hashes()
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    assert w.hashes(lower=True)[0] == w.hashes(lower=True)[2] == hash_words(["ab"])[0]
    monkeypatch.setattr("sparkgraph.llm.textvec.CHUNK", 3)
    assert (w.hashes() == h).all()


def test_run_hashes():
    values = np.tile(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64), 2)
    prefix = prefix_hash(values, np.uint64(12345678901))
    a = np.arange(40)
    assert (run_hash(prefix, a, a + 7) == run_hash(prefix, a + 50, a + 57)).all()
    assert (run_hash(prefix, a, a + 7) != run_hash(prefix, a, a + 8)).all()


def test_shingles():
    data = np.frombuffer(b"a b cx yd e f g", np.uint8)
    rows = np.array([0, 6, 6, 9, 15])  # "a b cx", "", " yd", " e f g"
    w = Words(data, rows)
    _, row = shingles(w, w.hashes(), 2)
    assert row.tolist() == [0, 0, 2, 3, 3]


# Chat


TURNS = [
    (1, 0, "system", "be <good> & kind"), (1, 1, "user", "hi"), (1, 2, "user", "</turn>\n<next>&lt;"), (1, 3, "assistant", "<assistant>\nno"),
    (1, 4, "assistant", ""), (2, 5, "assistant", None), (2, None, "user", "first"), (3, 1, None, "role"), (None, 1, "user", "x" * 50000),
    (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "assistant", "tie"), (5, 1, "a>\nb", "odd role"), (6, 1, "assistant", "日本 🙂"),
]


def turns_frame(spark, rows=TURNS):
    return spark.createDataFrame([(*r, "k", 3) for r in rows], "conv_id long, turn int, role string, text string, turns string, formatted int")


def test_chats_come_back(spark):
    got = {r.conv_id: r for r in parse(format_chats(turns_frame(spark))).collect()}
    want: dict = {}
    for c, n, role, text in sorted(TURNS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    assert {c: r.loss_texts for c, r in got.items()} == {c: [t for role, t in v if role == "assistant"] for c, v in want.items()}
    assert got[1].formatted.count("<user>\n") == 1  # adjacent turns of a role share a block


def test_no_chats(spark):
    assert parse(format_chats(turns_frame(spark, []))).collect() == []


def test_chat_query(spark):
    rows = {r.conv_id: r for r in op8_chat_format(spark, SMALL).collect()}
    hostile = rows[-7]
    assert hostile.n_turns == 2 and hostile.loss_chars == len(HOSTILE)
    assert hostile.loss_sha256 == hashlib.sha256(HOSTILE.encode()).hexdigest()
    plan = op8_chat_format(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Decontamination


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items, window=13):
    w = norm(text)
    hit, found = set(), set()
    for ident, item in items:
        v = norm(item)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            run = v[i : i + window]
            for j in range(len(w) - len(run) + 1):
                if w[j : j + len(run)] == run:
                    hit |= set(range(j, j + len(run)))
                    found.add("" if ident is None else str(ident))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, words(1, 30)), (2, "Hello, WORLD!"), (3, ""), (None, "日本語 🙂"), (4, None), (10, words(2, 14)), (10, words(2, 14)), (11, "a b a b a"), (12, "...")]


def test_scan_finds_overlaps_and_borders():
    automaton = build([(str(i), t or "") for i, t in ITEMS])
    for text in ("hello world", "xhello world", "hello worldx", "a b a b a b a", "HELLO--world hello\nworld", "", "a  b\ta,b.a"):
        n, hit, ids = scan(text, automaton)
        assert (n, int(hit.sum()), sorted(ids)) == brute(text, [(str(i), t) for i, t in ITEMS])
    assert scan("hello", build([]))[0] == 1


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_decontaminate_against_brute_force(spark, odd, none, limit):
    r = random.Random(4)
    docs = [(100 + k, " ".join(r.choice([words(1, 30), words(2, 14), words(k, 9), "hello world", "é É"]).split()[r.randrange(3) :])) for k in range(25)]
    frame = odd.select("doc_id", "text", "bench").unionByName(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, bench int"))
    items = spark.createDataFrame([(i, t, "extra") for i, t in ITEMS], "item_id long, text string, bench string")
    got = sorted((str(r.doc_id), r.bench.n_words, r.bench.n_hit, r.bench["items"], r.bench.contaminated) for r in decontaminate(frame, items, shard_bytes=limit).collect())
    want = []
    for i, t in [*ODD, *docs]:
        n, hit, found = brute(t, ITEMS)
        want.append((str(i), n, hit, found, hit > 0 and 20 * hit >= n))
    assert got == sorted(want)
    assert decontaminate(none, items).collect() == []
    assert not any(r.bench.contaminated for r in decontaminate(odd, items.limit(0)).collect())


def test_spans_point_into_the_original(spark):
    text = "Ünd -- Hello,\tWORLD! 日本語 hello world."
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(2, "hello world")], "item_id long, text string")
    (row,) = decontaminate(frame, items).collect()
    assert [text[s.start : s.end] for s in row.bench.spans] == ["Hello,\tWORLD", "hello world"]


# HTML


def blocks(page):
    return [b.text for b in read(page)[1]]


def test_reading_html():
    assert blocks("a<p>b &amp; c&lt;d<br>e<p> f  \n g</div>h") == ["a", "b & c<d e", "f g", "h"]
    assert blocks("<script>if (a<b) '</p>'</script><style>p{}</style><title>t</title>x<!-- <p>y</p> -->z") == ["xz"]
    assert blocks("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == ["a", "b", "c", "d", "e"]
    assert blocks("<p>one <b>two</b><i>three</i> <a href='x>y'>four</a></p>five") == ["one twothree four", "five"]
    assert blocks("<div>a<!-- open comment <p>b") == ["a"] and blocks("a <p cla") == ["a"] and blocks("") == []
    assert blocks("<p>1 < 2 and &nbsp; &unknown; &#x41;&#66;") == ["1 < 2 and &unknown; AB"]
    assert blocks("<noscript>no</noscript><p>yes<template>t</template>") == ["yes"]
    assert blocks("<div" + " x" * 10000 + ">deep" + "<div>" * 3000 + "end") == ["deep", "end"]


def test_written_layouts():
    trees, writer, right = html_extract.fitted(), html_extract._Writer(1234), 0
    for _ in range(200):
        page = writer.page()
        nodes, found = read(page)
        wanted = {id(n) for n, y in zip(nodes, html_extract.labels(nodes), strict=True) if y}
        want = "\n".join(b.text for b in found if id(b.node) in wanted)
        right += html_extract.main_texts([page], trees)[0] == want
    assert right >= 185


def test_kept_trees_are_those_of_the_generator():
    """The stored file is what its generator gives."""
    kept, again = html_extract.kept_trees(), html_extract.fit_trees(html_extract.PAGES, html_extract.SEED)
    assert (kept.feature == again.feature).all() and np.allclose(kept.cut, again.cut) and np.allclose(kept.value, again.value, atol=1e-8)
    assert html_extract.fitted() is html_extract.fitted()


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<ul><li><a href=/a>One resource</a></li><li><a href=/b>Two resource</a></li></ul>", "One resource\nTwo resource"),
        ("<ul><li><a href=/a>Only resource</a></li></ul>", "Only resource"),
        ("<ol><li><a href=/a>First</a> and more words here</li><li>Second</li></ol>", "First and more words here\nSecond"),
        ("<h2>Sources</h2><ul><li><a href=/a>A paper</a></li><li><a href=/b>A book</a></li></ul>", "Sources\nA paper\nA book"),
        ("<p><a href=/a>All of this is one link</a></p>", "All of this is one link"),
        ("<blockquote><p>Said so.</p></blockquote>", "Said so."),
        ("<table><tr><td>a</td><td>1</td></tr></table>", "a\n1"),
        ("<figure><img src=x><figcaption>A picture.</figcaption></figure>", "A picture."),
    ],
)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<main><article>{}</article></main>"])
def test_lists_of_links_and_others_inside_an_article_stay(inner, text, wrap):
    first = "The quick brown fox jumps over the lazy dog, and then it rests. It did so for a while."
    body = wrap.format(f"<h1>Title here</h1><p>{first}</p>{inner}<p>{first}</p>")
    links = "".join(f"<li><a href=/{i}>{w}</a></li>" for i, w in enumerate(("Home", "News", "About", "Contact")))
    page = f"<html><body><nav><ul>{links}</ul></nav>{body}<aside><h3>Related</h3><ul>{links}</ul></aside><footer><p>&copy; 2024 Someone</p></footer></body></html>"
    want = f"Title here\n{first}\n{text}\n{first}"
    assert html_extract.main_texts([page], html_extract.fitted()) == [want]


def test_long_conversations(spark):
    """Work on a conversation of 50,000 turns grows far below the square of its turns."""
    n = 50_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <"), F.col("id").cast("string")).alias("text"))
    (row,) = parse(format_chats(turns)).collect()
    assert [(t.role, t.text) for t in row.turns] == [("user" if i % 3 == 0 else "assistant", f"text <{i}") for i in range(n)]
    assert row.loss_texts == [f"text <{i}" for i in range(n) if i % 3]
    assert [row.formatted[s.start : s.end] for s in row.loss_spans] == [f"text &lt;{i}" for i in range(n) if i % 3]


def test_benchmark_of_5_megabytes(spark, monkeypatch):
    """One scan, with nothing of the benchmark sent to the driver; the hits are those of a dictionary of all runs."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    r = random.Random(8)
    known = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    items = [(k, " ".join(r.choice(known) for _ in range(r.choice([5, 40, 400])))) for k in range(6500)]
    assert sum(len(t) for _, t in items) > 5_000_000
    docs = []
    for k in range(60):
        parts = [" ".join(r.choice(known) for _ in range(r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            w = r.choice(items)[1].split()
            a = r.randrange(len(w))
            parts += [" ".join(w[a : a + r.randint(3, 40)]), " ".join(r.choice(known) for _ in range(r.randint(0, 20)))]
        docs.append((k, " ".join(parts).upper()))
    runs: dict = {}
    for ident, text in items:
        w = text.split()
        for i in range(max(1, len(w) - 12)):
            runs.setdefault(tuple(w[i : i + 13]), set()).add(str(ident))
    want = {}
    for k, text in docs:
        w, hit, found = norm(text), set(), set()
        for i in range(len(w)):
            for size in (5, 13):
                if (ids := runs.get(tuple(w[i : i + size]))) and len(w[i : i + size]) == size:
                    hit |= set(range(i, i + size))
                    found |= ids
        want[k] = (len(w), len(hit), sorted(found))
    monkeypatch.setattr(Frame, "toLocalIterator", None)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    for size in (1 << 20, 128 << 20):
        out = decontaminate(frame, table, shard_bytes=size)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert {r.doc_id: (r.bench.n_words, r.bench.n_hit, r.bench["items"]) for r in out.collect()} == want


def test_decoding_is_consistent():
    nodes, _ = read("<div><p>a</p><p>b</p></div><nav><p>c</p></nav>")
    margin = np.array([0, 2, -1, 3, -6, 5.0])[: len(nodes)]
    kept = dict(zip((n.tag + str(i) for i, n in enumerate(nodes)), html_extract.decode(nodes, margin), strict=True))
    assert kept == {"body0": True, "div1": True, "p2": False, "p3": True, "nav4": False, "p5": False}


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>T</title><meta charset=x><article><p>One<p>Two</article>", ["One", "Two"]),
        ("<head><link rel=x><script>s</script>Bare text<p>One", ["Bare text", "One"]),
        ("<head><title>T</title><style>s</style></head><body><p>One</body>", ["One"]),
        ("<head><svg><path d=x></svg><p>One", ["One"]),
        ("<p>One<svg><path d=x><p>Two<svg><p>Three", ["One", "Two", "Three"]),
        ("<p>One<noscript><p>Two", ["One", "Two"]),
    ],
)
def test_heads_and_raw_elements_left_open(page, texts):
    assert blocks(page) == texts


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "<html>"), (5, "plain text only"), (6, "<article><p>x</article>" * 50), (6, "<p>" * 3000), (None, "<article><h1>T</h1><p>" + "w " * 40000)]
    frame = spark.createDataFrame([(i, t, "u", "old") for i, t in rows], "page_id long, html string, url string, text string")
    got = {(r.page_id, r.html): r.text for r in html_extract.extract(frame).collect()}
    assert got[1, None] == got[2, ""] == got[3, "  "] == got[4, "<html>"] == ""
    assert got[rows[7]].startswith("T\nw w") and len(got[rows[7]]) == 1 + 1 + 79999
    assert html_extract.extract(frame.limit(0)).collect() == []


def test_page_query(spark):
    """The layout of the test pages: an article between a menu, an advert and a footer."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = op7_html_extract(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
