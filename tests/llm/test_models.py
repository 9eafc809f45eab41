from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD, SMALL, words
from pyspark.sql import functions as F

from sparkgraph.llm import boosting, kneser_ney, quality
from sparkgraph.llm.queries import op4_quality, op6_lm_score

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "</s>"]


class Reference:
    """The bigram model written out with dictionaries."""

    def __init__(self, texts):
        self.count, self.pairs = Counter(), Counter()
        for t in texts:
            self.count.update(tokens(t))
            self.pairs.update(zip(["<s>", *tokens(t)], tokens(t), strict=False))
        self.context = defaultdict(lambda: [0, 0, 0, 0])
        self.before = Counter()
        for (u, w), n in self.pairs.items():
            self.context[u][0] += n
            self.context[u][min(n, 3)] += 1
            self.before[w] += 1
        self.top, _ = self.discounts(self.pairs.values())
        self.low, n = self.discounts(self.before.values())
        v = len(self.count)
        self.rest = (self.low[1] * n[0] + self.low[2] * n[1] + self.low[3] * (v - n[0] - n[1])) / len(self.pairs)

    @staticmethod
    def discounts(counts):
        n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        return [0.0, *kneser_ney.discounts(n)], n

    def p(self, u, w):
        lower = max(self.before[w] - self.low[min(self.before[w], 3)], 0) / len(self.pairs) + self.rest / (len(self.count) + 1)
        if u not in self.context:
            return lower
        c, n = self.context[u], self.pairs[u, w]
        return max(n - self.top[min(n, 3)], 0) / c[0] + sum(d * k for d, k in zip(self.top[1:], c[1:], strict=True)) / c[0] * lower

    def score(self, text):
        return sum(math.log10(self.p(u, w)) for u, w in zip(["<s>", *tokens(text)], tokens(text), strict=False))


def check_scores(rows, learned, texts):
    ref = Reference(learned)
    total, vocabulary = sum(ref.count.values()), len(ref.count)
    for key, lm in rows:
        t = tokens(texts[key])
        assert (lm.n_tokens, lm.n_known) == (len(t), sum(w in ref.count for w in t))
        assert lm.base_score == pytest.approx(sum(math.log10((ref.count[w] + 1) / (total + vocabulary + 1)) for w in t))
        assert lm.score == pytest.approx(ref.score(texts[key]))
    return ref


def test_discounts():
    assert kneser_ney.discounts([0, 1, 2, 3]) == (0.5, 1.0, 1.5)
    y = 10 / 18
    assert kneser_ney.discounts([10, 4, 2, 1]) == pytest.approx((1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5))


def test_probabilities_sum_to_one():
    ref = Reference([words(3, 300, 30), words(4, 300, 30)])
    for u in ("<s>", "never", next(iter(ref.count))):
        assert sum(ref.p(u, w) for w in [*ref.count, "unseen"]) == pytest.approx(1)


def test_scores_of_odd_texts(spark, odd, none):
    texts = dict(enumerate(t for _, t in ODD))
    model = kneser_ney.train(odd)
    rows = [(r.row, r.lm) for r in kneser_ney.score(odd, model).collect()]
    check_scores(rows, texts.values(), texts)
    empty = kneser_ney.train(none)
    assert empty.n_tokens == 0 and kneser_ney.score(none, model).collect() == []
    assert all(r.lm.n_known == 0 and r.lm.base_score == 0 for r in kneser_ney.score(odd, empty).collect())


def test_large_counts_and_many_shards(spark):
    texts = {i: t for i, t in enumerate(["the cat " * 400, *[words(i, 200, 50) for i in range(30)]])}
    frame = spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(4)
    model = kneser_ney.train(frame, shard_bytes=64)
    assert model.bits >= 5
    ref = check_scores([(r.doc_id, r.lm) for r in kneser_ney.score(frame, model).collect()], texts.values(), texts)
    assert max(ref.pairs.values()) > 255


def test_counts_beyond_32_bits():
    """Packed and stored counts keep their value; so do sums of them."""
    r = np.random.default_rng(2)
    hashes = r.integers(0, 2**63, 50).astype(np.uint64)
    for top in (3, 300, 70_000, 2**32 + 7, 2**40):
        counts = np.full(50, top)
        counts[::7] = 1
        h, n = kneser_ney._unpack(kneser_ney._pack(hashes, counts), "hn")
        assert (h == hashes).all() and (n == counts).all()
        both = kneser_ney._unpack(kneser_ney._pack(hashes, hashes[::-1].copy(), counts, counts * 2), "hhnn")
        assert (both[1] == hashes[::-1]).all() and (both[2] == counts).all() and (both[3] == 2 * counts).all()


def test_stored_counts_beyond_32_bits(tmp_path):
    table = kneser_ney._add_pairs(f"file://{tmp_path}", 0, 2)
    u, w = np.array([5, 5, 9], np.uint64), np.array([1, 2, 1], np.uint64)
    blobs = [kneser_ney._pack(u, w, np.array([2**32 + 7, 1, 2])), kneser_ney._pack(u[:1], w[:1], np.array([2**33]))]
    out = table(pa.table({"shard": pa.array([0, 0], pa.int32()), "kind": pa.array([0, 0], pa.int32()), "blob": pa.array(blobs, pa.binary())}))
    kneser_ney._add_words(f"file://{tmp_path}", 2)(out)
    model = kneser_ney.Model(f"file://{tmp_path}", 0, 1, 2, 3, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0.1)
    tables = kneser_ney.Tables(model)
    (counts,) = tables.find("pair", kneser_ney.pair_keys(u, w, 0), ["count"])
    assert counts.tolist() == [2**33 + 2**32 + 7, 1, 2]
    assert tables.find("word", np.array([1, 2], np.uint64), ["0"])[0].tolist() == [2**33 + 2**32 + 9, 1]
    assert tables.find("context", np.array([5], np.uint64), ["0"])[0].tolist() == [2**33 + 2**32 + 8]


def test_lm_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    rows = op6_lm_score(spark, SMALL).collect()
    assert {r.doc_id for r in rows if r.held_out} == held and len(rows) == len(docs)
    check_scores([(r.doc_id, r) for r in rows], [t for i, t in docs.items() if i not in held], docs)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


class TrigramReference(Reference):
    """The trigram model written out with dictionaries; pairs that begin a text keep their counts."""

    def __init__(self, texts):
        super().__init__(texts)
        self.triples = Counter()
        for t in texts:
            w = ["<s>", *tokens(t)]
            self.triples.update(zip(w, w[1:], w[2:], strict=False))
        self.adjusted = Counter({(u, w): n for (u, w), n in self.pairs.items() if u == "<s>"})
        self.adjusted.update((v, w) for _, v, w in self.triples)
        self.after = {2: defaultdict(lambda: [0, 0, 0, 0]), 3: defaultdict(lambda: [0, 0, 0, 0])}
        for order, grams in ((2, self.adjusted), (3, self.triples)):
            for (*context, _), n in grams.items():
                self.after[order][*context][0] += n
                self.after[order][*context][min(n, 3)] += 1
        self.discount = {2: self.discounts(self.adjusted.values())[0], 3: self.discounts(self.triples.values())[0]}

    def p3(self, w, *context):
        order = len(context) + 1
        if order == 1:
            return max(self.before[w] - self.low[min(self.before[w], 3)], 0) / len(self.pairs) + self.rest / (len(self.count) + 1)
        lower = self.p3(w, *context[1:])
        if context not in self.after[order]:
            return lower
        c, d, n = self.after[order][context], self.discount[order], (self.adjusted if order == 2 else self.triples)[*context, w]
        return max(n - d[min(n, 3)], 0) / c[0] + sum(a * b for a, b in zip(d[1:], c[1:], strict=True)) / c[0] * lower

    def score3(self, text):
        w = ["<s>", *tokens(text)]
        return sum(math.log10(self.p3(w[i], *w[max(i - 2, 0) : i])) for i in range(1, len(w)))


def test_trigram_probabilities_sum_to_one():
    ref = TrigramReference([words(3, 300, 12), words(4, 300, 12)])
    for context in [("<s>",), ("never",), ("never", "<s>"), *[g[:2] for g in list(ref.triples)[:40:8]]]:
        assert sum(ref.p3(w, *context) for w in [*ref.count, "unseen"]) == pytest.approx(1)


def test_trigram_scores(spark, odd):
    texts = {i: t for i, t in enumerate(["the cat " * 400, "", None, *["of the " + words(i, 200, 20) for i in range(40)], *[t for _, t in ODD]])}
    frame = spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(4)
    for learned, bytes_ in ((frame, 1 << 11), (frame.where("doc_id % 3 > 0"), 1 << 20), (odd, 1 << 20)):
        ref = TrigramReference([r.text for r in learned.select("text").collect()])
        rows = kneser_ney.score(frame, kneser_ney.train(learned, shard_bytes=bytes_)).collect()
        for r in rows:
            assert r.lm.trigram_score == pytest.approx(ref.score3(texts[r.doc_id]))
            assert r.lm.perplexity == pytest.approx(10 ** (-r.lm.trigram_score / r.lm.n_tokens))
    two = kneser_ney.score(frame, kneser_ney.train(frame, order=2)).collect()
    check_scores([(r.doc_id, r.lm) for r in two], texts.values(), texts)
    assert "trigram_score" not in two[0].lm
    with pytest.raises(ValueError, match="order"):
        kneser_ney.train(frame, order=4)


def test_lm_query_uses_three_words(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ref = TrigramReference([t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    rows = op6_lm_score(spark, SMALL).collect()
    assert all(r.trigram_score == pytest.approx(ref.score3(docs[r.doc_id])) for r in rows)
    assert sum(r.trigram_score for r in rows if r.held_out) > sum(r.score for r in rows if r.held_out)


def test_boosting_learns():
    r = np.random.default_rng(1)
    x = r.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000], n_trees=40, depth=3)
    assert ((trees.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    flat = boosting.fit(np.zeros((10, 2)), np.ones(10), n_trees=2)
    assert (flat.margin(np.zeros((3, 2))) > 0).all()


def test_statistics():
    texts = ["a a a b", "", "HELLO!! you, trash.", "x | y\nx | y"]
    data = "".join(texts).encode()
    rows = np.cumsum([0, *(len(t.encode()) for t in texts)])
    stats, n = quality.statistics(np.frombuffer(data, np.uint8), rows)
    at = {name: i for i, name in enumerate(quality.STATISTICS)}
    assert n.tolist() == [4, 0, 3, 6]
    assert stats[0, at["repeated"]] == 0.5 and stats[0, at["distinct"]] == 0.5
    assert stats[2, at["en dehumanising"]] == 1 and stats[2, at["addressed"]] == 1 and stats[2, at["marks"]] == pytest.approx(1 / 3)
    assert stats[2, at["shouted"]] == pytest.approx(1 / 3) and stats[2, at["en"]] == 0
    assert stats[3, at["lines"]] == 0.5 and stats[3, at["letterless"]] == pytest.approx(1 / 3)


def test_languages_and_lists():
    texts = {
        "en": "it is the case that you are a stupid person and one of the losers in this town",
        "es": "no es para una persona como la que se sienta en el parque, eres un idiota y un cobarde",
        "fr": "il ne faut pas croire que ce sont des gens qui sont dans une ville, tu es un abruti",
        "de": "das ist nicht ein Haus von der Stadt, und du bist der Trottel mit dem Hund",
    }
    data = "".join(texts.values()).encode()
    rows = np.cumsum([0, *(len(t.encode()) for t in texts.values())])
    stats, n = quality.statistics(np.frombuffer(data, np.uint8), rows)
    at = {name: i for i, name in enumerate(quality.STATISTICS)}
    for i, language in enumerate(texts):
        assert [c for c in texts if stats[i, at[c]]] == [language]
        assert stats[i, at["addressed"]] >= 1
    assert stats[0, at["en scorn"]] == stats[0, at["en insult"]] == 1 and stats[3, at["de any"]] == 1
    said = quality.votes(stats, n, quality.TOXICITY)
    names = [t[0] for t in quality.TOXICITY]
    # A list votes on its own language only.
    assert said[1, names.index("es any")] == 1 and said[1, names.index("en insult")] == 2 and said[0, names.index("en profanity")] == 0


class PlainEM:
    """Expectation-maximisation over single documents, written out with loops."""

    def __init__(self, votes, human, rounds=100):
        good_bad = lambda v: [(i, x) for i, x in enumerate(v) if x < 2]
        self.post = [0.95 if 1 in v else 0.05 for v in votes]
        anchor = {d: (0.99 if v[human] == 1 else 0.01) for d, v in enumerate(votes) if v[human] < 2}
        for d, p in anchor.items():
            self.post[d] = p
        for _ in range(rounds):
            last = list(self.post)
            self.rates = []
            for c in (0, 1):
                row = []
                for i in range(len(votes[0])):
                    weight = [p if c else 1 - p for p in self.post]
                    said = sum(w for w, v in zip(weight, votes, strict=True) if v[i] == 1) + 10 * (0.9 if c else 0.1)
                    rest = sum(w for w, v in zip(weight, votes, strict=True) if v[i] == 0) + 10 * (0.1 if c else 0.9)
                    row.append(min(max(said / (said + rest), 1e-3), 1 - 1e-3))
                self.rates.append(row)
            prior = min(max(sum(self.post) / len(votes), 1e-4), 1 - 1e-4)
            for d, v in enumerate(votes):
                if d in anchor:
                    continue
                odds = math.log(prior) - math.log(1 - prior)
                for i, x in good_bad(v):
                    a, b = self.rates[1][i], self.rates[0][i]
                    odds += math.log(a / b) if x else math.log((1 - a) / (1 - b))
                self.post[d] = 1 / (1 + math.exp(-odds))
            if max(abs(a - b) for a, b in zip(self.post, last, strict=True)) < 1e-6:
                break


def plain_fit(rows, p, weight, size):
    """FTRL-proximal, a feature at a time in dictionaries."""
    z, n = defaultdict(float), defaultdict(float)
    value = lambda f: 0.0 if abs(z[f]) <= 1 else (math.copysign(1, z[f]) - z[f]) / ((1 + math.sqrt(n[f])) / 0.3 + 0.5)
    share = sum(w for w, q in zip(weight, p, strict=True) if q > 0.5) / sum(weight)
    gain = [min(10, max(1, share / max(1 - share, 1e-3))), min(10, max(1, (1 - share) / max(share, 1e-3)))]
    for _ in range(6):
        for i in np.random.default_rng(7).permutation(len(rows)).tolist():
            w = {f: value(f) for f in rows[i]}
            guess = 1 / (1 + math.exp(-sum(w[f] * x for f, x in rows[i].items())))
            for f, x in rows[i].items():
                g = (guess - p[i]) * weight[i] * gain[p[i] > 0.5] * x
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / 0.3 * w[f]
                n[f] += g * g
    out = np.zeros(size)
    for f in list(z):
        out[f] = value(f)
    return out


def test_training_against_brute_force(spark):
    """The whole of ``train`` on a small table: EM over single documents, class weights, screen and FTRL in plain Python."""
    r = random.Random(3)
    common = "the of and to in a is that for it with was on as are this by at from".split()
    harsh = "idiot moron stupid pathetic trash scum".split()
    docs, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        text = [r.choice(common) if r.random() < 0.5 else f"w{r.randrange(90)}" for _ in range(r.randint(20, 120))]
        if bad:
            for _ in range(len(text) // 12 + 1):
                text[r.randrange(len(text))] = r.choice(harsh) if i % 8 else "zorgish"
        if i % 5 == 2:
            text = [f"{w}$$$" for w in text]
        docs.append((i, " ".join(text) + "."))
        if i % 3 == 0:
            labels.append((i, int(i % 5 != 2), int(bad)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    scorer = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    raw = [np.frombuffer(t.encode(), np.uint8) for _, t in docs]
    ends = [np.array([0, len(x)]) for x in raw]
    stats = [quality.statistics(x, e) for x, e in zip(raw, ends, strict=True)]
    said = {i: (1 - q, t) for i, q, t in labels}
    keys = {row.doc_id: row.key for row in frame.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).collect()}
    order = sorted(range(len(docs)), key=lambda i: keys[i])
    posts = []
    for k, (labellers, rates) in enumerate(((quality.QUALITY, scorer.quality_rates), (quality.TOXICITY, scorer.toxicity_rates))):
        votes = [[*quality.votes(s, n, labellers)[0].tolist(), said[i][k] if i in said else 2] for i, (s, n) in enumerate(stats)]
        em = PlainEM(votes, len(votes[0]) - 1)
        assert np.allclose(rates, em.rates, atol=1e-4)
        posts.append([float(x) for x in em.post])
    for post, fitted, features, screen in ((posts[0], scorer.quality, quality.form_features, False), (posts[1], scorer.toxicity, quality.word_features, True)):
        odds = [min(max(p, 1 - p), 0.99) / (1 - min(max(p, 1 - p), 0.99)) for p in post]
        mean = [float(np.mean([o for o, p in zip(odds, post, strict=True) if (p > 0.5) == c])) for c in (False, True)]
        weight = [o / mean[int(p > 0.5)] for o, p in zip(odds, post, strict=True)]
        rows = []
        for x, e in zip(raw, ends, strict=True):
            ids, values, _ = features(x, e)
            rows.append(dict(zip(ids.tolist(), values.astype(float).tolist(), strict=True)))
        if screen:
            sums, whole = defaultdict(lambda: [0.0, 0.0]), [0.0, 0.0]
            for row, p, w in zip(rows, post, weight, strict=True):
                whole[p > 0.5] += w
                for f, v in row.items():
                    sums[f][p > 0.5] += w * v
            good = {f for f, (a, b) in sums.items() if b >= 2 and (b + 0.05) / whole[1] > 4 * (a + 0.05) / whole[0]}
            rows = [{f: v for f, v in row.items() if f in good} for row in rows]
        rows = [{**row, 1 << quality.BITS: 1.0} for row in rows]
        want = plain_fit([rows[i] for i in order], [post[i] for i in order], [weight[i] for i in order], len(fitted))
        assert np.allclose(fitted, want, atol=2e-3) and (want != 0).sum() > 3


def test_words_that_no_list_has_are_learned(spark):
    """Half the labels teach the words of other languages: at least 0.9 of held-out toxic documents are found, in each language."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scorer = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score(docs, scorer).withColumnRenamed("quality", "q").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert np.mean([r.q.p_toxic >= 0.5 for r in toxic]) >= 0.9
    for language in ("en", "fr", "de", "es"):
        assert np.mean([not r.q.kept for r in toxic if r.lang == language]) >= 0.85
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean([r.q.kept for r in clean]) >= 0.99 and len(clean) > 1000


@pytest.mark.parametrize("n_human", [0, 1, 98, 99, 100, 101, 3000])
def test_weights_have_no_switch(n_human):
    """More labels shift weight step by step; each class weighs one in the mean."""
    p = np.array([0.01] * n_human + [0.05] * 900 + [0.99] * 40 + [0.9] * 7)
    weight = quality.class_weights(p)
    for c in (p > 0.5, p <= 0.5):
        assert weight[c].mean() == pytest.approx(1)
    weak = weight[n_human]
    assert weak == pytest.approx((n_human + 900) * 19 / (n_human * 99 + 900 * 19))


def test_em_recovers_accuracies():
    r = np.random.default_rng(5)
    truth = r.random(20000) < 0.2
    right = [0.95, 0.85, 0.75, 0.7]
    votes = np.stack([np.where(r.random(20000) < 0.3, 2, np.where(r.random(20000) < a, truth, ~truth)) for a in right], axis=1)
    kinds, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, prior = quality.estimate(["".join(map(str, k)) for k in kinds], counts.astype(float))
    assert abs(prior - 0.2) < 0.05
    assert np.abs(rates[1] - right).max() < 0.06 and np.abs(1 - rates[0] - right).max() < 0.06
    assert ((post[inverse.ravel()] > 0.5) == truth).mean() > 0.9


def test_quality_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 1), (5, 0, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    scorer = quality.train(odd, labels)
    rows = quality.score(odd, scorer).collect()
    assert len(rows) == len(ODD) and all(0 <= r.quality.p_bad <= 1 and 0 <= r.quality.p_toxic <= 1 for r in rows)
    assert quality.score(none, scorer).collect() == []
    assert quality.score(odd, quality.train(none)).count() == len(ODD)
    assert quality.score(odd, quality.train(odd)).count() == len(ODD)


def test_quality_held_out(spark):
    """Fitted without the labels of every third labelled document, right on nearly all of these."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scorer = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.score(docs, scorer).withColumnRenamed("quality", "q").join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = np.mean([(r.q.p_bad > 0.5) == (r.quality == 0) for r in rows])
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert right > 0.95 and np.mean([r.q.kept for r in clean]) > 0.97


def test_quality_query(spark):
    rows = op4_quality(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert 0.5 < np.mean([r.kept for r in rows]) < 1


