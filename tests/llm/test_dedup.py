from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import ODD, SMALL, words

from sparkgraph.llm.components import components
from sparkgraph.llm.exact_dedup import DigestIndex, exact_dedup
from sparkgraph.llm.near_dedup import _pairs, near_dedup, signatures
from sparkgraph.llm.queries import op1_near_dedup
from sparkgraph.llm.substring_dedup import Bitmap, repeated_spans, substring_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Exact


def test_exact_odd_texts(odd, none):
    got = exact_dedup(odd).collect()
    texts = [(i, (t or "").translate(LOWER)) for i, t in ODD]
    sizes = Counter(t for _, t in texts)
    best = {t: max((i for i, u in texts if u == t and i is not None), default=None) for t in sizes}
    want = Counter((i, best[t], sizes[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(sizes)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(none).collect() == []


def test_exact_index_over_batches(spark):
    index = DigestIndex(spark, "digests_test", n_buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    again = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.dedup(first, "one").collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    want = {(9, 2, False), (8, 8, True), (7, 8, False)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.dedup(again, "two").collect()} == want
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.dedup(again, "two").collect()} == want  # run again after a failure
    index.compact()
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.dedup(again, "three").collect()} == {(9, 2, False), (8, 8, False), (7, 8, False)}
    assert index.read().count() == 3
    index.drop()


def test_exact_plan_does_not_shuffle_the_index(spark):
    index = DigestIndex(spark, "digests_plan", n_buckets=4)
    index.dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "one").collect()
    fresh = spark.createDataFrame([(b"x",)], "digest binary").join(index.read().select("digest").hint("merge"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    index.drop()


def test_exact_in_parts(spark):
    """Any number of parts gives what one gives; the index is gone afterwards."""
    r = random.Random(4)
    docs = [(r.choice([None, *range(60)]), r.choice(["a", "A", "b", "B c", "", None, f"t{r.randrange(40)}"])) for _ in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    one, *more = ([tuple(x) for x in exact_dedup(frame, parts=n).drop("key").collect()] for n in (1, 2, 5))
    assert all(Counter(x) == Counter(one) for x in more)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]
    named = frame.select(F.col("doc_id").cast("string"), "text")
    assert exact_dedup(named).count() == len(docs)
    with pytest.raises(ValueError, match="numeric"):
        DigestIndex(spark, "digests_named").dedup(named, parts=2)


def test_exact_parts_meet_in_the_index(spark):
    """The second part finds texts that the first has stored, and appends the others."""
    index = DigestIndex(spark, "digests_parts", n_buckets=2)
    index.dedup(spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(20)], "doc_id long, text string"), "one", parts=4)
    rows = index.read().collect()
    assert len(rows) == 11 and {r.keep_id for r in rows} == {19, *range(0, 20, 2)}
    files = index.read().select(F.input_file_name().alias("f"), "keep_id").distinct().collect()
    assert len({r.f for r in files}) > 2  # appended to more than once
    index.drop()


@pytest.mark.parametrize("lost_after", [0, 1, 2, 3])
def test_exact_compaction_that_lost_its_driver(spark, monkeypatch, lost_after):
    name = f"digests_lost{lost_after}"
    index = DigestIndex(spark, name, n_buckets=2)
    index.dedup(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), "one")
    left = [lost_after]

    class Session:
        catalog, read, table, conf, sparkContext = spark.catalog, spark.read, spark.table, spark.conf, spark.sparkContext

        def sql(self, text):
            if not left[0]:
                raise RuntimeError("lost")
            left[0] -= 1
            return spark.sql(text)

    index.spark = Session()
    if lost_after < 3:
        with pytest.raises(RuntimeError):
            index.compact()
    else:
        index.compact()
    again = DigestIndex(spark, name, n_buckets=2)
    got = again.dedup(spark.createDataFrame([(7, "a"), (8, "c")], "doc_id long, text string"), "two").collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(7, 1, False), (8, 8, True)}
    assert not any(spark.catalog.tableExists(f"{name}{end}") for end in ("_old", "_compact"))
    again.drop()


# Near


def shingle_set(text, size=5):
    w = split((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else None


def classes(docs, threshold=0.8):
    """The least id of each document's class, by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y):
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        members[root(k)].append(i)
    return Counter((i, min(m, key=lambda v: (v is not None, v)), len(m)) for m in members.values() for i in m)


def test_near_odd_texts(odd, none):
    got = near_dedup(odd).collect()
    want = classes(ODD)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    groups = Counter((r.class_id, r.class_size) for r in got if r.kept)
    assert sum(r.kept for r in got) == sum(1 / size for (_, _, size), n in want.items() for _ in range(n)) and groups
    assert near_dedup(none).collect() == []


def near_copies(seed, n):
    r = random.Random(seed)
    docs, k = [], 0
    for base in range(n):
        text = words(seed * 1000 + base, r.choice([6, 30, 120, 400])).split()
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            copy = list(text)
            for _ in range(r.choice([0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
            docs.append((k, " ".join(copy)))
            k += 1
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_against_all_pairs(spark, seed):
    docs = near_copies(seed, 40)
    got = near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == classes(docs)


def test_near_hot_group(spark):
    """One large group of near copies, many of which are not linked to each other."""
    r = random.Random(5)
    base = words(77, 150).split()
    docs = []
    for k in range(250):
        copy = list(base)
        for _ in range(r.randrange(0, 9)):
            copy[r.randrange(len(copy))] = f"u{r.randrange(10**6)}"
        docs.append((k, " ".join(copy)))
    got = near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == classes(docs)


def test_near_group_of_2000(spark):
    """A bucket of more than one block: the classes are those of all pairs."""
    r = np.random.default_rng(6)
    base = r.integers(0, 5000, 80)
    texts = []
    for _ in range(2000):
        copy = base.copy()
        at = r.integers(0, 80, r.integers(0, 7))
        copy[at] = r.integers(10**6, 10**7, len(at))
        texts.append(" ".join(map(str, copy)))
    ids = {}
    sets = [[ids.setdefault(s, len(ids)) for s in shingle_set(t)] for t in texts]
    has = np.zeros((len(texts), len(ids)), np.float32)
    for i, s in enumerate(sets):
        has[i, s] = 1
    common, size = has @ has.T, has.sum(1)
    linked = common >= 0.8 * (size[:, None] + size - common) - 1e-3
    label = np.arange(len(texts))
    while True:
        low = np.where(linked, label, len(texts)).min(1)
        if (low == label).all():
            break
        label = low
    assert 1 < len(np.unique(label)) < 1500
    got = near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: x.class_id for x in got} == dict(enumerate(label.tolist()))


@pytest.mark.parametrize("n", [40, 700])
def test_near_rounds_meet_all_pairs(spark, n):
    """Members with equal sketches: each pair of different classes comes from one of the rounds, once."""
    r = random.Random(n)
    rows = [(1, k, r.randrange(5), [7] * 32, n, 1, [k, 9]) for k in range(n)]
    frame = spark.createDataFrame(rows, "bucket long, key long, label long, sketch array<long>, size long, band int, bands array<int>").repartition(3)
    found = [tuple(sorted(p)) for begin, end in ((0.0, 4), (4, 32), (32, math.inf)) for p in _pairs(frame, begin, end, 0.8).collect()]
    label = {k: c for _, k, c, *_ in rows}
    assert Counter(found) == Counter((a, b) for b in range(n) for a in range(b) if label[a] != label[b])
    elsewhere = frame.withColumn("bands", F.expr("array(3, 9)"))  # met in an earlier band
    assert _pairs(elsewhere, 0.0, math.inf, 0.8).count() == 0


def test_near_counts_as_weights(spark):
    docs = [(1, "a b c d e " * 10), (2, "a b c d e " * 4), (3, "a b c d e " * 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.class_id for r in near_dedup(frame).collect()} == {1}
    assert {r.doc_id: r.class_id for r in near_dedup(frame, weighting="count").collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_near_whole_table_against_all_pairs(spark, weighting):
    """The documents of the smallest scale; the query goes by counts."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    bags = []
    for _, text in docs:
        w = split((text or "").translate(LOWER))
        bag = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        bags.append(bag if weighting == "count" else Counter(dict.fromkeys(bag, 1)))
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    least = {c: min(i for (i, _), x in zip(docs, label, strict=True) if x == c) for c in set(label)}
    want = {i: least[c] for (i, _), c in zip(docs, label, strict=True)}
    if weighting == "count":
        got = op1_near_dedup(spark, SMALL)
    else:
        got = near_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_near_repeated_shingles_weigh(spark):
    """Random bags with repeated shingles: classes by weighted similarity, not by that of sets."""
    r = random.Random(12)
    docs = []
    for k in range(60):
        line = " ".join(f"l{k // 6}x{i}" for i in range(12))
        docs.append((k, " ".join([line] * r.randint(1, 12))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bags = []
    for _, text in docs:
        w = text.split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    label = list(range(60))
    for a in range(60):
        for b in range(a):
            if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert {x.doc_id: x.class_id for x in near_dedup(frame, weighting="count").collect()} == dict(enumerate(label))
    assert len(set(label)) > len({x.class_id for x in near_dedup(frame).collect()})


def test_signatures_agree_like_weighted_jaccard():
    r = np.random.default_rng(3)
    k = 4000
    element = r.integers(0, 2**63, 60).astype(np.uint64)
    wa, wb = r.integers(1, 12, 60).astype(float), r.integers(1, 12, 60).astype(float)
    wb[:15] = wa[:15]
    signed = signatures(np.concatenate((element, element)), np.concatenate((wa, wb)), np.repeat([0, 1], 60), 2, k)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((signed[0] == signed[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)
    once = signatures(element, np.ones(60), np.zeros(60, int), 1, 64)
    assert (once == signatures(np.tile(element, 3), np.ones(180), np.zeros(180, int), 1, 64)).all()


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# Substrings


def repeats(docs, length):
    """(id, words, removed, what is left) of each document, by a table of all windows."""
    lists = [split(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
    out = []
    for (ident, _), w in zip(docs, lists, strict=True):
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((ident, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


def cut(frame, **options):
    return Counter((r.doc_id, r.repeats.n_words, r.repeats.n_removed, r.repeats.kept) for r in substring_dedup(frame, **options).collect())


def test_substring_odd_texts(odd, none):
    assert cut(odd) == repeats(ODD, 35)
    assert substring_dedup(none).collect() == []


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 35, 8), (2, 6, 3), (3, 5, 5), (4, 4, 1)])
def test_substring_against_all_windows(spark, seed, length, gram):
    r = random.Random(seed)
    passages = [words(seed * 50 + i, r.randint(2, 3 * length), 60).split() for i in range(12)]
    docs = []
    for k in range(60):
        text = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            text += p[a : a + r.randint(1, 3 * length)] + words(seed + k + len(text), r.randint(0, length), 60).split()
        docs.append((k, " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert cut(frame, length=length, seed=gram) == repeats(docs, length)


def test_substring_spans(spark):
    shared = [f"s{i}" for i in range(10)]
    docs = [(1, " ".join(["a", *shared, "b"])), (2, " ".join(["c", "d", *shared]))]
    rows = {r.doc_id: r.repeats for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), length=4, seed=2).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(1, 10)] and rows[1].kept == "a b" and [tuple(s) for s in rows[2].spans] == [(2, 11)]


def test_substring_repeated_rows(spark):
    """Rows of one id and text have their places and spans gathered once, not once for each row."""
    text, other = words(8, 400), words(9, 30) + " " + " ".join(words(8, 400).split()[50:120]) + " " + words(10, 30)
    docs = [(None, text)] * 300 + [(1, other)] * 3 + [(2, other + " x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert cut(frame) == repeats(docs, 35)
    keyed = frame.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    sizes = [len(r.spans) for r in repeated_spans(keyed).collect()]
    assert len(sizes) == 3 and max(sizes) < 800


def test_bitmap(spark):
    keys = [0, 1, -1, 5, 2**25 - 1, 2**25, -(2**63), 2**63 - 1, 32768, 32769]
    mine = spark.createDataFrame([(k,) for k in keys], "key long")
    every = spark.createDataFrame([(k,) for k in [*keys, 7, 1000, 32770]], "key long")
    bitmap = Bitmap(mine, "key")
    assert {r.key for r in bitmap.filter(every, "key").collect()} == set(keys)
    assert {r.key for r in bitmap.filter(every, "key", inside=False).collect()} == {7, 1000, 32770}
