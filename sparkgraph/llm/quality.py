"""A quality and toxicity filter learned from weak labels.

Heuristic labellers vote good, bad or not at all on each document; human
labels, where a table has them, are one labeller more. Expectation-maximisation
over the counts of vote patterns estimates how each labeller votes on good and
on bad documents, and so a posterior label for each pattern. Posterior labels
are the targets of a logistic scorer over hashed features (binned statistics and
marks for quality; words and their beginnings, by their share of the text, for
toxicity), fitted by FTRL-proximal steps, whose L1 term leaves most weights zero.
A document's weight is the odds of its posterior label, relative to the mean of
its class, so that what people labelled counts more than what labellers could not
see, in the same way with many labels, few or none. All documents are scored.

Labellers of toxicity are word lists that overlap in the texts they find: in
English one of insults, one of scorn, one of dehumanising words and one of
profanity, one for each other language, one of insults near an address, and one
of shouting. A list votes only on texts of its language, told by function words.

One model is for quality and one for toxicity; a document is kept if neither
finds it bad.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgraph.llm.shared import flat_schema, materialise, small_batches
from sparkgraph.llm.textvec import ALNUM, SPACED, Words, hash_words, mix, rows_by_bytes

#: Weights of a scorer: 2**BITS hashed features; this bounds what is broadcast.
BITS = 20

#: Documents that the scorers are fitted on, at most; votes and posteriors cover all.
MAX_TRAIN = 12_000

#: Bytes of text whose features are made at once.
SLICE = 1 << 19

#: How often a human label is taken to be right.
HUMAN_ACCURACY = 0.99

# Frequent function words of four languages, and words that are used to insult, by language and kind.
STOP = {
    "en": "the of and to in a is that for it with was on as are be this by at from or an not have".split(),
    "es": "de la que el en los del las un por con una su para es al lo como y no se".split(),
    "fr": "de la le les des et est du une dans qui pour au sur avec ne pas ce que en un".split(),
    "de": "der die und das den von zu mit sich auf für ist im dem nicht ein eine als in es".split(),
}
FUNCTION_WORDS = tuple(dict.fromkeys(w for words in STOP.values() for w in words))
LISTS = {
    ("en", "insult"): "idiot idiots moron morons loser losers clown clowns fool fools imbecile imbeciles jerk jerks dumbass creep creeps coward cowards freak freaks".split(),
    ("en", "scorn"): "stupid pathetic worthless disgusting dumb ugly useless brainless ridiculous revolting repulsive despicable contemptible hideous".split(),
    ("en", "dehumanising"): "trash scum vermin filth garbage parasite parasites subhuman cockroach cockroaches swine maggot maggots savages".split(),
    ("en", "profanity"): "shit bullshit fuck fucking fucker bitch bastard bastards asshole assholes dick cunt whore slut damn crap".split(),
    ("es", "any"): "idiota idiotas imbécil imbéciles estúpido estúpida tonto tonta basura escoria payaso perdedor perdedora inútil asqueroso asquerosa patético patética mierda cabrón puta puto gilipollas cobarde maldito".split(),
    ("fr", "any"): "idiot idiote imbécile stupide crétin crétine ordure ordures raclure clown minable inutile dégoûtant dégoûtante pathétique merde connard connasse salaud salope pute lâche débile abruti".split(),
    ("de", "any"): "idiot idioten dumm dummkopf trottel abschaum müll clown verlierer versager wertlos widerlich erbärmlich ekelhaft scheiße arschloch hurensohn schlampe feigling missgeburt blöd ungeziefer".split(),
}
ADDRESS = "you your youre ur eres tú usted tu vous toi es du bist ihr dich".split()

_LANGUAGES = tuple(STOP)
_KINDS = tuple(LISTS)


def _table(words: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all listed words, and for each a bit for every list that has it."""
    bits: dict[str, int] = {}
    for i, listed in enumerate(words.values()):
        for w in listed:
            bits[w] = bits.get(w, 0) | 1 << i
    hashes = hash_words(list(bits))
    order = np.argsort(hashes)
    return hashes[order], np.array(list(bits.values()), np.int64)[order]


_STOP, _HARSH, _ADDRESS = _table(STOP), _table(LISTS), _table({"address": ADDRESS})


def _bits(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The lists that each word is in."""
    keys, bits = table
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, bits[at], 0)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

#: Statistics of a text for quality.
FORM = ("symbols", "upper", "function", "repeated", "distinct", "ends", "letterless", "lines", "length", "marks")
#: Statistics for toxicity: words of each list, listed words near an address, and words in capitals; then whether the text is in each language.
HARSH = tuple(f"{language} {kind}" for language, kind in _KINDS)
STATISTICS = (*FORM, *HARSH, "addressed", "shouted", *_LANGUAGES)

#: Words on either side of a listed one where an address counts.
NEAR = 4


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _marked(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The last byte of each word, and whether the word ends in two symbols or more."""
    if not len(words):
        return np.empty(0, np.uint8), np.empty(0, bool)
    last = words.data[words.end - 1]
    return last, (words.end - words.start > 1) & _SYMBOL[last] & _SYMBOL[words.data[words.end - 2]]


def statistics(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of each row (see STATISTICS) and its number of words."""
    words = Words(data, rows)
    n, row = words.count, words.row()
    some = np.maximum(n, 1)
    hashes = words.hashes(lower=True)
    plain = Words(data, rows, ALNUM)
    plain_hashes = plain.hashes(lower=True)
    stop, harsh = _bits(plain_hashes, _STOP), _bits(plain_hashes, _HARSH)
    function = _sums(stop > 0, plain.first)
    each = np.stack([_sums(stop >> i & 1, plain.first) for i in range(len(_LANGUAGES))])
    # A text is in the language that most of its function words are of, if it has enough.
    most = each.max(0)
    spoken = (each == most) & (most >= 3) & (most >= 0.02 * plain.count)
    address = np.concatenate(([0], np.cumsum(_bits(plain_hashes, _ADDRESS))))
    at, of = np.arange(len(plain)), plain.row()
    near = address[np.minimum(at + NEAR + 1, plain.first[1:][of])] - address[np.maximum(at - NEAR, plain.first[:-1][of])]
    capitals = np.concatenate(([0], np.cumsum(_UPPER[data])))
    shouted = (plain.end - plain.start > 3) & (capitals[plain.end] - capitals[plain.start] == plain.end - plain.start)
    letters, size = _sums(_LETTER[data], rows), _sums(SPACED[data], rows)
    upper = _sums(_UPPER[data], rows)
    symbols = _sums(_SYMBOL[data], rows)
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    # Distinct words by one sort of row and hash; rows of a slice are few, so 40 bits of hash remain.
    wide = np.uint64(max(1, int(len(n)).bit_length()))
    keyed = np.sort((row.astype(np.uint64) << (np.uint64(64) - wide)) | (hashes >> wide))
    new = np.concatenate(([True], keyed[1:] != keyed[:-1])) if len(keyed) else np.empty(0, bool)
    distinct = _sums(new, words.first)
    ends = np.isin(data[words.end - 1], np.frombuffer(b".?!", np.uint8)) if len(words) else np.empty(0, bool)
    letter_sum = np.concatenate(([0], np.cumsum(_LETTER[data])))
    letterless = letter_sum[words.end] == letter_sum[words.start]
    lines = Words(data, rows, np.arange(256) != 10)
    line_row = lines.row()
    line_keys = np.sort((line_row.astype(np.uint64) << (np.uint64(64) - wide)) | (lines.hashes() >> wide))
    new_line = np.concatenate(([True], line_keys[1:] != line_keys[:-1])) if len(line_keys) else np.empty(0, bool)
    out = np.stack(
        [
            symbols / np.maximum(size, 1),
            upper / np.maximum(letters, 1),
            function / np.maximum(plain.count, 1),
            _sums(same, words.first) / some,
            distinct / some,
            _sums(ends, words.first) / some,
            _sums(letterless, words.first) / some,
            1 - _sums(new_line, lines.first) / np.maximum(lines.count, 1),
            size / some,
            _sums(_marked(words)[1], words.first) / some,
            *(_sums(harsh >> i & 1, plain.first) for i in range(len(_KINDS))),
            _sums((harsh > 0) & (near > 0), plain.first),
            _sums(shouted, plain.first) / np.maximum(plain.count, 1),
            *spoken,
        ],
        axis=1,
    )
    return out, n


#: Quality labellers: statistic, fewest words to vote, good up to, bad from (bad below good: reversed).
QUALITY = (
    ("symbols", 10, 0.05, 0.12),
    ("marks", 10, 0.02, 0.20),
    ("upper", 5, 0.10, 0.50),
    ("function", 20, 0.10, 0.03),
    ("repeated", 10, 0.05, 0.30),
    ("distinct", 50, 0.35, 0.20),
    ("ends", 30, 0.03, 0.003),
    ("letterless", 20, 0.05, 0.25),
    ("lines", 20, 0.20, 0.50),
    ("length", 10, 7.0, 12.0),
)
#: Toxicity labellers: the same, and the language that a text must be in (or "").
TOXICITY = (
    *((name, 5, 0.0, 1.0, name.split()[0]) for name in HARSH),
    ("addressed", 5, 0.0, 1.0, ""),
    ("shouted", 10, 0.05, 0.30, ""),
)


def votes(stats: np.ndarray, n_words: np.ndarray, labellers: tuple) -> np.ndarray:
    """1 for bad, 0 for good, 2 for none; one column a labeller."""
    out = np.full((len(stats), len(labellers)), 2, np.uint8)
    for i, (name, least, good, bad, *language) in enumerate(labellers):
        value = stats[:, STATISTICS.index(name)]
        enough = n_words >= least
        if any(language):
            enough = enough & (stats[:, STATISTICS.index(language[0])] > 0)
        out[enough & ((value <= good) if good < bad else (value >= good)), i] = 0
        out[enough & ((value >= bad) if good < bad else (value <= bad)), i] = 1
    return out


def _listed(parts: list[tuple[np.ndarray, np.ndarray]], n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of (hashes, rows) by row, how often each occurs in its row, and where each row's begin (n_rows + 1)."""
    ids = np.concatenate([h for h, _ in parts]) >> np.uint64(64 - BITS)
    of = np.concatenate([r for _, r in parts]).astype(np.uint64)
    keyed = np.sort((of << np.uint64(BITS)) | ids)
    new = np.flatnonzero(np.concatenate(([True], keyed[1:] != keyed[:-1]))) if len(keyed) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate((new, [len(keyed)])))
    keyed = keyed[new]
    first = np.searchsorted(keyed >> np.uint64(BITS), np.arange(n_rows + 1).astype(np.uint64))
    return (keyed & np.uint64((1 << BITS) - 1)).astype(np.int32), counts, first


def form_features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features for quality, each of value 1: statistics in bins, coarse and fine, and the symbols that words are or end in."""
    stats, n_words = statistics(data, rows)
    n_rows = len(rows) - 1
    parts = []
    values = np.concatenate((np.minimum(stats[:, : len(FORM)], 20), np.log2(n_words + 1)[:, None]), axis=1)
    for i, step in enumerate((8, 25, 80)):
        scale = np.array([step] * 8 + [step / 8, step, 1])
        bins = np.floor(values * scale).astype(np.uint64)
        hashes = mix(bins * np.uint64(1009) + np.arange(bins.shape[1], dtype=np.uint64) + np.uint64((i + 1) << 40))
        parts.append((hashes.ravel(), np.repeat(np.arange(n_rows), bins.shape[1])))
    words = Words(data, rows)
    last, marked = _marked(words)
    lone, tail = np.flatnonzero((words.end - words.start == 1) & _SYMBOL[last]), np.flatnonzero(marked)
    marks = np.concatenate((last[lone].astype(np.uint64), data[words.end[tail] - 2].astype(np.uint64) * 256 + last[tail]))
    parts.append((mix(marks + np.uint64(1 << 44)), words.row()[np.concatenate((lone, tail))]))
    ids, _, first = _listed(parts, n_rows)
    return ids, np.ones(len(ids), np.float32), first


#: The share of a text's words at which a word's feature has its full value.
FULL = 0.02


def word_features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features for toxicity: the words and their first 4, 5 and 6 bytes, with values that grow with their share of the text up to 1."""
    words = Words(data, rows, ALNUM)
    row, n_rows = words.row(), len(rows) - 1
    parts = [(words.hashes(lower=True), row)]
    parts += [(mix(words.hashes(lower=True, head=h) + np.uint64(h)), row) for h in (4, 5, 6)]
    ids, counts, first = _listed(parts, n_rows)
    values = np.minimum(counts / np.repeat(FULL * np.maximum(words.count, 1), np.diff(first)), 1)
    return ids, values.astype(np.float32), first


def estimate(patterns: list[str], counts: np.ndarray, human: int | None = None, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: (posterior of bad by pattern, P(vote bad | good or bad) by labeller, P(bad)).

    A labeller that does not vote says nothing. Where the labeller at ``human``
    votes, its vote is the posterior, up to HUMAN_ACCURACY; elsewhere the
    estimated accuracies of the others make it. A document starts as bad if any labeller finds it so, or as the
    human has it.
    """
    v = np.array([[int(c) for c in p] for p in patterns])
    bad, good = (v == 1).astype(float), (v == 0).astype(float)
    post = np.where(bad.any(1), 0.95, 0.05)
    anchored = v[:, human] < 2 if human is not None else np.zeros(len(v), bool)
    anchor = np.where(bad[:, human if human is not None else 0] == 1, HUMAN_ACCURACY, 1 - HUMAN_ACCURACY)
    post = np.where(anchored, anchor, post)
    rates = np.empty((2, v.shape[1]))
    prior = 0.5
    for _ in range(rounds):
        last = post
        for c, weight in enumerate((counts * (1 - post), counts * post)):
            # A vote counts ten times over for what its name says, before any is seen.
            said = weight @ bad + 10 * (0.9 if c else 0.1)
            rates[c] = said / (said + weight @ good + 10 * (0.1 if c else 0.9))
        rates = rates.clip(1e-3, 1 - 1e-3)
        prior = min(max(float(counts @ post) / max(counts.sum(), 1), 1e-4), 1 - 1e-4)
        log = bad @ np.log(rates).T + good @ np.log(1 - rates).T
        post = np.where(anchored, anchor, 1 / (1 + np.exp(np.clip(log[:, 0] + np.log(1 - prior) - log[:, 1] - np.log(prior), -500, 500))))
        if np.abs(post - last).max() < 1e-6:
            break
    return post, rates, prior


def class_weights(p: np.ndarray) -> np.ndarray:
    """The weight of each row: the odds of its posterior label, up to those of a human one, relative to the mean of its class."""
    sure = np.clip(np.maximum(p, 1 - p), 0.5, HUMAN_ACCURACY)
    odds = sure / (1 - sure)
    for c in (p > 0.5, p <= 0.5):
        if c.any():
            odds[c] /= odds[c].mean()
    return odds


def screened(seen: np.ndarray, n: np.ndarray, least: float = 2.0, ratio: float = 4.0) -> np.ndarray:
    """Of features with the sums ``seen`` of values in good and in bad rows (2 columns) those that tell bad ones.

    Their sum is ``least`` in bad rows, and their mean ``ratio`` times that in good
    ones; the whole weights of both are ``n``. A text has hundreds of words of its
    own; without a screen a scorer learns these by heart.
    """
    n = np.maximum(n, 1)
    return (seen[:, 1] >= least) & ((seen[:, 1] + 0.05) / n[1] > ratio * (seen[:, 0] + 0.05) / n[0])


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray, weight: np.ndarray, epochs: int = 6, alpha: float = 0.3, l1: float = 1.0, l2: float = 0.5
) -> np.ndarray:
    """Weights of a logistic scorer (the last is the intercept) by FTRL-proximal.

    A row is (feature ids, their values); ``p`` its probability to be bad and
    ``weight`` its weight. Both classes weigh the same, up to tenfold.
    """
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7).permutation(len(rows))
    share = float(np.average(p > 0.5, weights=weight)) if len(rows) else 0.5
    gain = (min(10.0, max(1.0, share / max(1 - share, 1e-3))), min(10.0, max(1.0, (1 - share) / max(share, 1e-3))))
    for _ in range(epochs):
        for i in order:
            x, value = rows[i]
            zi, root = z[x], np.sqrt(n[x])
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((1.0 + root) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ value, -35, 35))) - p[i]) * weight[i] * gain[int(p[i] > 0.5)] * value
            after = np.sqrt(root**2 + g * g)
            z[x] = zi + g - (after - root) / alpha * wi
            n[x] += g * g
    live = np.abs(z) > l1
    w[live] = (np.sign(z[live]) * l1 - z[live]) / ((1.0 + np.sqrt(n[live])) / alpha + l2)
    return w


@dataclass(frozen=True)
class Scorer:
    """Weights for quality and toxicity, and what EM found of the labellers: P(vote bad | good) and P(vote bad | bad)."""

    quality: np.ndarray
    toxicity: np.ndarray
    quality_rates: np.ndarray
    toxicity_rates: np.ndarray


_VOTES = flat_schema("key long, quality string, toxicity string")


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in rows_by_bytes(batch, "text", SLICE):
            stats, n = statistics(data, offsets)
            said = [
                ["".join(map(str, v)) for v in votes(stats, n, labellers).tolist()] for labellers in (QUALITY, TOXICITY)
            ]
            yield pa.RecordBatch.from_arrays([rows.column("key"), *map(pa.array, said)], names=_VOTES.names)


_SEEN = flat_schema("feature int, good double, bad double")


def _see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word feature's values in good and in bad rows by their weights, added up in the task."""
    seen = np.zeros(((1 << BITS), 2))
    for batch in batches:
        for rows, data, offsets in rows_by_bytes(batch, "text", SLICE):
            ids, values, first = word_features(data, offsets)
            p, weight = (rows.column(c).to_numpy() for c in ("toxic", "w_toxic"))
            for c in (0, 1):
                mine = np.where((p > 0.5) == c, weight, 0.0)
                seen[:, c] += np.bincount(ids, values * np.repeat(mine, np.diff(first)), 1 << BITS)
    some = np.flatnonzero(seen.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some, 0]), pa.array(seen[some, 1])], names=_SEEN.names)


_GIVEN = ("bad", "toxic", "w_bad", "w_toxic")


def _extract(kept):
    """Features of the rows to fit on; of words only those that are kept (packed bits), so that a row is small however long its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.unpackbits(kept.value, count=1 << BITS).astype(bool)
        for batch in batches:
            for rows, data, offsets in rows_by_bytes(batch, "text", SLICE):
                lists = []
                for (ids, values, first), only in ((form_features(data, offsets), None), (word_features(data, offsets), use)):
                    if only is not None:
                        good = only[ids]
                        first = np.concatenate(([0], np.cumsum(good)))[first]
                        ids, values = ids[good], values[good]
                    lists += [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x)) for x in (ids, values)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in _GIVEN), *lists], names=[*_GIVEN, "form", "form_x", "words", "words_x"])

    return run


def train(docs: DataFrame, labels: DataFrame | None = None, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Estimate the labellers on all of ``docs`` and fit the scorers on at most ``max_train`` of them.

    ``labels`` (doc_id, quality 0/1, toxic 0/1) may cover any of them; a null
    or other value is no vote, and of several labels of a document the worst
    counts. The documents to fit on are drawn by hash, a third of them each from
    those that look bad, toxic and clean, as far as there are so many, with
    human labels first. Posteriors are their targets and, as odds, their weights
    (:func:`class_weights`); the rule is the same for any number of labels.
    Without labels only what the labellers' words tell can be learned. What
    reaches the driver of a document are its features for quality and those
    words that pass a screen, not its text.
    """
    small_batches(docs.sparkSession)
    ident, text = F.col(id_col), F.col(text_col)
    keyed = docs.select(F.xxhash64(ident, text).alias("key"), ident.alias("doc_id"), text.alias("text"))
    voted = materialise(
        keyed.select("key", "text").mapInArrow(_vote, _VOTES), "votes"
    )
    human = F.lit("2")
    if labels is not None:
        ids = keyed.select("key", "doc_id").distinct()
        vote = lambda c, bad: F.when(F.col(c) == bad, 1).when(F.col(c) == 1 - bad, 0)
        said = labels.select(F.col("doc_id"), vote("quality", 0).alias("q"), vote("toxic", 1).alias("t")).groupBy("doc_id").agg(F.max("q").alias("q"), F.max("t").alias("t"))
        given = ids.join(said, "doc_id").groupBy("key").agg(F.max("q").alias("q"), F.max("t").alias("t"))
        voted = voted.join(given, "key", "left")
        human = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("2"))
        voted = voted.select("key", F.concat("quality", human("q")).alias("quality"), F.concat("toxicity", human("t")).alias("toxicity"))
    else:
        voted = voted.select("key", F.concat("quality", human).alias("quality"), F.concat("toxicity", human).alias("toxicity"))
    voted = materialise(voted, "all-votes")
    spark, found = docs.sparkSession, []
    for kind in ("quality", "toxicity"):
        rows = voted.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(kind).collect()  # at most 3 to the number of labellers
        if not rows:
            empty = np.zeros((1 << BITS) + 1)
            return Scorer(empty, empty, np.empty((2, 0)), np.empty((2, 0)))
        post, rates, _ = estimate([r[0] for r in rows], np.array([r.n for r in rows], float), None if labels is None else len(rows[0][0]) - 1)
        found.append((spark.createDataFrame([(r[0], float(p)) for r, p in zip(rows, post, strict=True)], f"{kind} string, p_{kind} double"), rates))
    (quality, quality_rates), (toxicity, toxicity_rates) = found
    judged = voted.join(F.broadcast(quality), "quality").join(F.broadcast(toxicity), "toxicity")
    groups = (F.col("p_toxicity") > 0.5, (F.col("p_quality") > 0.5) & (F.col("p_toxicity") <= 0.5), (F.col("p_quality") <= 0.5) & (F.col("p_toxicity") <= 0.5))
    chosen = None
    for group in groups:
        part = judged.where(group).dropDuplicates(["key"]).orderBy(F.col("quality").endswith("2") & F.col("toxicity").endswith("2"), F.xxhash64("key")).limit(max_train // 3)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = chosen.select("key", F.col("p_quality").alias("bad"), F.col("p_toxicity").alias("toxic")).orderBy("key").toPandas()  # at most max_train short rows
    for kind in ("bad", "toxic"):
        sample[f"w_{kind}"] = class_weights(sample[kind].to_numpy())
    given = materialise(spark.createDataFrame(sample, "key long, bad double, toxic double, w_bad double, w_toxic double"), "sample")
    texts = materialise(keyed.select("key", "text").join(F.broadcast(given), "key").dropDuplicates(["key"]), "sample-texts")
    seen = texts.select("toxic", "w_toxic", "text").mapInArrow(_see, _SEEN).groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    seen = seen.where("bad > 0").toPandas()  # at most 2**BITS rows
    toxic = sample["toxic"].to_numpy() > 0.5
    n = np.array([sample["w_toxic"].to_numpy()[toxic == c].sum() for c in (False, True)])
    kept = np.zeros(1 << BITS, bool)
    kept[seen["feature"].to_numpy()[screened(seen[["good", "bad"]].to_numpy(), n)]] = True
    run = _extract(spark.sparkContext.broadcast(np.packbits(kept)))
    made = texts.orderBy("key").select(*_GIVEN, "text").mapInArrow(run, "bad double, toxic double, w_bad double, w_toxic double, form array<int>, form_x array<float>, words array<int>, words_x array<float>")
    rows = made.toArrow()
    last, fitted = np.array([1 << BITS]), []
    for name, target in (("form", "bad"), ("words", "toxic")):
        lists = [
            (np.concatenate((ids.values.to_numpy(), last)), np.concatenate((values.values.to_numpy(), [1.0])))
            for ids, values in zip(rows.column(name), rows.column(f"{name}_x"), strict=True)
        ]
        fitted.append(fit(lists, rows.column(target).to_numpy(), rows.column(f"w_{target}").to_numpy()))
    return Scorer(*fitted, quality_rates, toxicity_rates)


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """Every row and column of ``docs`` with a struct of ``p_bad``, ``p_toxic`` and ``kept`` in ``out_col``.

    A column of the name ``out_col`` is replaced.
    ``kept`` says that both are below ``threshold``. Null and empty texts have
    the features of no words and are judged by them.
    """
    small_batches(docs.sparkSession)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*names)
    schema = T.StructType([*given.schema.fields, *flat_schema("p_bad double, p_toxic double").fields])
    text, arrow = names[docs.columns.index(text_col)], to_arrow_schema(schema)
    weights = docs.sparkSession.sparkContext.broadcast(np.stack((scorer.quality, scorer.toxicity)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for rows, data, offsets in rows_by_bytes(batch, text, SLICE):
                out = []
                for each, (ids, values, first) in zip(w, (form_features(data, offsets), word_features(data, offsets)), strict=True):
                    sums = np.concatenate(([0.0], np.cumsum(each[ids] * values, dtype=float)))
                    out.append(pa.array(1 / (1 + np.exp(-np.clip(sums[first[1:]] - sums[first[:-1]] + each[-1], -35, 35)))))
                yield pa.RecordBatch.from_arrays([*rows.columns, *out], schema=arrow)

    kept = (F.col("p_bad") < threshold) & (F.col("p_toxic") < threshold)
    judged = given.mapInArrow(run, schema)
    return judged.select(
        *[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != out_col],
        F.struct("p_bad", "p_toxic", kept.alias("kept")).alias(out_col),
    )
