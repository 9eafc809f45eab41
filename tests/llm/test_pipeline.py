from __future__ import annotations

import duckdb
import public_tokenizers
import pytest
from conftest import COLUMNS, SMALL
from test_dedup import LOWER, classes
from test_text import brute
from tokenizers import Tokenizer

import corpus_pipeline
from sparkgraph.llm import quality
from sparkgraph.llm.queries import ORACLES, QUERIES


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    scorer = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = [(r.doc_id, r.text) for r in quality.score(docs, scorer, out_col="q").collect() if r.q.kept]
    last = {}
    for i, t in kept:
        last[t.translate(LOWER)] = max(i, last.get(t.translate(LOWER), -1))
    kept = [(i, t) for i, t in kept if last[t.translate(LOWER)] == i]
    firsts = {c for _, c, _ in classes(kept)}
    kept = [(i, t) for i, t in kept if i in firsts]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = {i: brute(t, items) for i, t in kept}
    kept = [(i, t) for i, t in kept if not (found[i][1] > 0 and 20 * found[i][1] >= found[i][0])]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in kept}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)
    assert 0 < len(rows) < docs.count() and columns


def test_stages_keep_columns_and_take_odd_rows(spark, odd, none):
    for docs in (odd, none):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == names
                docs = out
        assert out.columns[:2] == ["doc_id", "n_tokens"]
        assert out.count() == docs.count()
    assert COLUMNS


def test_exact_stage_keeps_one_row(spark):
    docs = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (2, "A", 1), (None, "b", 2), (None, "b", 2)], "doc_id long, text string, x int")
    out = corpus_pipeline.drop_exact_copies(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or -1, r.text) for r in out) == [(-1, "b"), (2, "A")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())
