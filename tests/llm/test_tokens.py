from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD
from tokenizers import Tokenizer

from sparkgraph.llm.queries import bpe_digest
from sparkgraph.llm.segment_bpe import Codec, SegmentTrees, decode, encode
from sparkgraph.llm.token_count import Counter, count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
MORE = [
    "don't I'LL 12345 ٣٤٥  \n\n x  y ", "ΣΑΣ ΟΔΟΣ İstanbul ǅ ŉ ß ﬁ", "é É ­ ‍   \u0085", "a" * 3000, "\U0001f468‍\U0001f469‍\U0001f467 𝔘𝔫𝔦",
    "<|endoftext|>", "<|ENDOFTEXT|><|endoftext|> x", "x<|startoftext|>", "½²ªº µ", "“quoted” – dash… €5", "àb́c",
]


def texts():
    return [t or "" for _, t in ODD] + MORE


def test_codec_is_the_library():
    library, own = Tokenizer.from_file(BYTES), Codec(BYTES)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts()]
    assert own.encode_all(texts()) == want
    assert own.encode_all(texts()) == want  # now remembered
    assert [own.decode(ids) for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_decoding_of_broken_bytes():
    library, own = Tokenizer.from_file(BYTES), Codec(BYTES)
    for ids in ([222], [220, 222, 10], [50256, 200, 201], [], [187, 187, 65]):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forgetting_does_no_harm(monkeypatch):
    monkeypatch.setattr("sparkgraph.llm.segment_bpe.REMEMBERED", 3)
    library, own = Tokenizer.from_file(BYTES), Codec(BYTES)
    for t in texts()[3:8]:
        assert own.encode_all([t]) == [library.encode(t, add_special_tokens=False).ids]


def test_segment_trees():
    r = np.random.default_rng(0)
    keys = r.integers(0, 100, (5, 8))
    trees = SegmentTrees(keys.copy())
    for _ in range(50):
        rows = np.flatnonzero(r.random(5) < 0.6)
        if len(rows):
            leaf, new = r.integers(0, 8, len(rows)), r.integers(0, 100, len(rows))
            keys[rows, leaf] = new
            trees.set(rows, leaf, new)
        assert (trees.root(np.arange(5)) == keys.min(1)).all()


def test_encode_and_decode_frames(odd, none, spark):
    library = Tokenizer.from_file(BYTES)
    coded = encode(odd, BYTES)
    assert set(coded.columns) == set(odd.columns)
    back = decode(coded, BYTES, out_col="text").select("doc_id", "ids", "text").collect()
    want = sorted((library.encode(t or "", add_special_tokens=False).ids, t or "") for _, t in ODD)
    assert sorted((r.ids, r.text) for r in back) == want
    assert encode(none, BYTES).collect() == [] and decode(encode(none, BYTES), BYTES).collect() == []
    both = encode(odd, BYTES, decoded_col="kept").select("ids", "kept").collect()
    assert sorted((r.ids, r.kept) for r in both) == want
    rows = spark.createDataFrame([(1, [64, None, 65]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in decode(rows, BYTES).collect()} == {1: "ab", 2: "", 3: ""}
    with pytest.raises(FileNotFoundError):
        encode(odd, "/nowhere")


def test_bpe_query(spark, small):
    library = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in bpe_digest(docs).collect()} == want


def test_counts_are_the_library():
    library, own = Tokenizer.from_file(WORDS), Counter(WORDS)
    for t in texts():
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t[:40]


def test_every_plain_character():
    library, own = Tokenizer.from_file(WORDS), Counter(WORDS)
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2060), 0x20AC]):
        for t in (c, f"a{c}b", f"1{c}{c}2", f"A{c}"):
            assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), hex(ord(c))


def test_whole_tokens_are_single():
    library, own = Tokenizer.from_file(WORDS), Counter(WORDS)
    assert len(own.whole) > 30_000
    for t in own.whole[::500]:
        assert len(library.encode(t, add_special_tokens=False).ids) == 1


def test_count_frames(odd, none, spark, small):
    library = Tokenizer.from_file(WORDS)
    got = sorted(r.n_tokens for r in count_tokens(odd, WORDS).collect())
    assert got == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ODD)
    assert count_tokens(none, WORDS).collect() == []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for r in count_tokens(docs, WORDS, out_col="n").collect():
        assert r.n == len(library.encode(r.text, add_special_tokens=False).ids)


def test_counts_stretch_by_stretch_are_the_librarys():
    """Random mixes of plain words, other scripts, marks, odd spaces and special strings; only what is not plain goes to the library."""
    import random

    r = random.Random(6)
    library, own = Tokenizer.from_file(WORDS), Counter(WORDS)
    parts = ["hello", "World's", "naïve", "x\u0301", "\u0301x", "Σίσυφος", "ΟΔΟΣ", "ΟΔΟΣ.", "привет", "🙂", "👨\u200d👩", "日本語", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b",
             "\u3000", "\u0085", "\xa0", "İ", "ß", "ǅ", "don't", "...", "¿qué?", "12", "٣", "ﬁ", "\u1100\u1161", "e\u0301\u0323", "<|", "|>"]
    for _ in range(1500):
        text = "".join(r.choice(parts) + r.choice(["", " ", "  ", "\n", "\t", " \r\n"]) for _ in range(r.randint(1, 12)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    sent = []
    own.library = type("Spy", (), {"encode": lambda self, t, **k: sent.append(t) or library.encode(t, **k)})()
    text = "plain words " * 500 + "🙂 " + "more plain words " * 500 + "привет"
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert sent == ["🙂 привет"]
