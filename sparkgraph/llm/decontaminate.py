"""Benchmark decontamination with an Aho-Corasick automaton over words.

Every run of ``window`` consecutive normalised words of a benchmark item is a
pattern (an item with fewer words, but some, is one pattern). One automaton
over all patterns scans each document once; matches are mapped back to words
and to character offsets of the original text.

States are beginnings of patterns, named by the 64-bit hash of their words, so
that the automaton is a sorted array of hashes with a byte for each: the length
of the state that it falls back to (its longest proper end that is a state), and
whether it is a whole pattern. The child of a state is the state of one word
more, whose hash is had from prefix sums of the text. That takes nine bytes a
state. The arrays are made by Spark from the benchmark table, lie in the shared
folder in parts, and are memory-mapped by workers; nothing of the benchmark goes
through the driver.

Texts are scanned side by side: a slice's words are cut in equal stretches that
each start ``window`` words early, since a state never holds more than that.

Normalised: A-Z lower-cased, words are runs of ASCII letters and digits and
of all characters beyond ASCII.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgraph.llm.kneser_ney import load, save
from sparkgraph.llm.shared import materialise, new_path, small_batches
from sparkgraph.llm.textvec import ALNUM, RUN, Words, prefix_hash, rows_by_bytes, run_hash

#: Bytes of one part of the automaton's arrays, about; a task sorts and holds so much when the automaton is made.
SHARD_BYTES = 128 << 20

#: Words that are scanned in a row; as many stretches as a slice has go side by side.
STRETCH = 128

#: Bit of a state's byte that marks a whole pattern; the others are the length of the state to fall back to.
WHOLE = 128

#: ``spans`` are [start, end) in code points of the original text, merged where they touch or overlap in words.
HITS = "n_words long, n_hit long, items array<string>, word_spans array<struct<first:long,last:long>>, spans array<struct<start:long,end:long>>"

_STATES = "key long, length int, back int, whole boolean, item string, ends array<long>"


def _states(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """All states of the items in a slice, repeats too: item row, hash, length, length known to fall back to, whether whole, and ends.

    The end without the first word is a state where the next place starts a
    pattern of the item too. In an item's last pattern that is open; there
    ``ends`` lists the hashes of all proper ends, longest first.
    """
    prefix = prefix_hash(words.hashes(lower=True), RUN)
    size = np.minimum(words.count, window)
    patterns = np.where(words.count > 0, words.count - size + 1, 0)
    row = np.repeat(np.arange(len(size)), patterns)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(patterns) - patterns, patterns)
    start, final = words.first[row] + nth, nth == patterns[row] - 1
    which = np.repeat(np.arange(len(row)), size[row])
    length = np.arange(len(which)) - np.repeat(np.cumsum(size[row]) - size[row], size[row]) + 1
    row, start, final = row[which], start[which], final[which]
    key = run_hash(prefix, start, start + length)
    back = np.where(final, 0, length - 1)
    n_ends = np.where(final, length - 1, 0)
    of = np.repeat(np.arange(len(length)), n_ends)
    skip = np.arange(len(of)) - np.repeat(np.cumsum(n_ends) - n_ends, n_ends) + 1
    ends = run_hash(prefix, start[of] + skip, start[of] + length[of])
    return row, key.view(np.int64), length, back, length == size[row], n_ends, ends.view(np.int64)


def _listed_states(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in rows_by_bytes(batch, "text"):
                row, key, length, back, whole, n_ends, ends = _states(Words(data, offsets, ALNUM), window)
                items = rows.column("item").take(pa.array(row)).to_pandas().where(whole, None)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_ends))), pa.int32()), pa.array(ends))
                columns = [pa.array(key), pa.array(length, pa.int32()), pa.array(back, pa.int32()), pa.array(whole), pa.array(items, pa.string()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "length", "back", "whole", "item", "ends"])

    return run


class Automaton:
    """Sorted hashes of states with their bytes, and of whole patterns with the ids of their items (as JSON), in parts by hash."""

    def __init__(self, window: int, shortest: int, states: list[tuple[np.ndarray, np.ndarray]], patterns: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.window, self.shortest = window, shortest
        self.states = sorted((s for s in states if len(s[0])), key=lambda s: s[0][0])
        self.patterns = sorted((p for p in patterns if len(p[0])), key=lambda p: p[0][0])
        size = sum(len(keys) for keys, _ in self.states)
        # Most words lead nowhere: a table by some bits of the hash tells that of most at once.
        self._bits = np.int64((1 << min(24, max(8, (16 * size).bit_length()))) - 1)
        self._may = np.zeros(int(self._bits) + 1, bool)
        for keys, _ in self.states:
            for i in range(0, len(keys), 1 << 20):
                self._may[keys[i : i + (1 << 20)] & self._bits] = True
        self._firsts = np.array([keys[0] for keys, _ in self.states], np.int64)
        self._named = np.array([keys[0] for keys, *_ in self.patterns], np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The byte of each state, -1 where there is none."""
        keys = hashes.view(np.int64)
        out = np.full(len(keys), -1, np.int16)
        maybe = np.flatnonzero(self._may[keys & self._bits])
        if not len(maybe):
            return out
        asked = keys[maybe]
        part = np.searchsorted(self._firsts, asked, "right") - 1 if len(self.states) > 1 else np.zeros(len(asked), np.int64)
        for p in np.unique(part[part >= 0]).tolist():
            have, marks = self.states[p]
            mine = np.flatnonzero(part == p) if len(self.states) > 1 else np.arange(len(asked))
            at = np.minimum(np.searchsorted(have, asked[mine]), len(have) - 1)
            good = have[at] == asked[mine]
            out[maybe[mine[good]]] = marks[at[good]]
        return out

    def items(self, key: int) -> list[str]:
        """The ids of the items that have a pattern."""
        names, offsets, blob = self.patterns[int(np.searchsorted(self._named, key, "right")) - 1]
        i = int(np.searchsorted(names, key))
        return json.loads(bytes(blob[offsets[i] : offsets[i + 1]]))

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of a pattern in a slice: word after its last one, number of words, hash."""
        n = len(words)
        none = np.empty(0, np.int64)
        if not n or not self.states:
            return none, none, none
        prefix = prefix_hash(words.hashes(lower=True), RUN)
        every = np.arange(n)
        alone = self.find(run_hash(prefix, every, every + 1))  # states of one word
        new_row = np.zeros(n, bool)
        new_row[words.first[:-1][words.count > 0]] = True
        # After each word: the length of the state, and its byte.
        lengths, marks = np.zeros(n, np.int16), np.zeros(n, np.int16)
        begin = np.arange(0, n, STRETCH)
        length, mark = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int16)
        for step in range(-self.window, STRETCH):
            at = begin + step
            lane = np.flatnonzero((at >= 0) & (at < n))
            at = at[lane]
            now, byte = length[lane], mark[lane]
            now[new_row[at]] = 0
            todo = np.flatnonzero((now > 0) | (alone[at] >= 0))
            idle = np.ones(len(lane), bool)
            idle[todo] = False
            now[idle] = 0
            while len(todo):
                root = now[todo] == 0
                first = todo[root]
                now[first], byte[first] = (alone[at[first]] >= 0).astype(np.int64), alone[at[first]]
                todo = todo[~root]
                if not len(todo):
                    break
                found = self.find(run_hash(prefix, at[todo] - now[todo], at[todo] + 1))
                good = found >= 0
                now[todo[good]] += 1
                byte[todo[good]] = found[good]
                todo = todo[~good]
                # Fall back, and try the same word again.
                now[todo] = byte[todo] & (WHOLE - 1)
                held = todo[now[todo] > 0]
                byte[held] = self.find(run_hash(prefix, at[held] - now[held], at[held]))
            length[lane], mark[lane] = now, byte
            if step >= 0:
                lengths[at], marks[at] = now, byte
        ends, sizes = [], []
        at = np.flatnonzero(lengths >= self.shortest)
        size, byte = lengths[at].astype(np.int64), marks[at]
        while len(at):  # the state, and all that it falls back to
            whole = (byte & WHOLE) > 0
            ends.append(at[whole] + 1)
            sizes.append(size[whole])
            size = (byte & (WHOLE - 1)).astype(np.int64)
            more = size >= self.shortest
            at, size = at[more], size[more]
            byte = self.find(run_hash(prefix, at + 1 - size, at + 1))
        if not ends:
            return none, none, none
        end, size = np.concatenate(ends), np.concatenate(sizes)
        return end, size, run_hash(prefix, end - size, end).view(np.int64)


def build(items: list[tuple[str, str]], window: int = 13) -> Automaton:
    """The automaton of a few (item id, text), in memory."""
    data = [(text or "").encode() for _, text in items]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    row, key, length, back, whole, n_ends, ends = _states(Words(np.frombuffer(b"".join(data), np.uint8), offsets, ALNUM), window)
    keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    byte = np.zeros(len(keys), np.int64)
    np.maximum.at(byte, inverse, back)
    of = np.repeat(np.arange(len(key)), n_ends)
    skip = np.arange(len(of)) - np.repeat(np.cumsum(n_ends) - n_ends, n_ends) + 1
    good = np.isin(ends, keys)
    np.maximum.at(byte, inverse[of[good]], (length[of] - skip)[good])
    named: dict[int, set[str]] = {}
    for r, k in zip(row[whole].tolist(), key[whole].tolist(), strict=True):
        named.setdefault(k, set()).add(items[r][0])
    byte[np.isin(keys, list(named))] |= WHOLE
    blobs = [json.dumps(sorted(named[k])).encode() for k in sorted(named)]
    patterns = np.array(sorted(named), np.int64), np.concatenate(([0], np.cumsum([len(b) for b in blobs]))).astype(np.int64), np.frombuffer(b"".join(blobs), np.uint8)
    return Automaton(window, int(length[whole].min()) if whole.any() else window, [(keys, byte.astype(np.uint8))], [patterns])


@dataclass(frozen=True)
class Stored:
    """Where an automaton's arrays lie."""

    folder: str
    window: int
    shortest: int
    states: tuple[int, ...]
    patterns: tuple[int, ...]


@functools.lru_cache(maxsize=1)
def _mapped(stored: Stored) -> Automaton:
    part = lambda kind, i, names: tuple(load(stored.folder, f"{kind}-{i}.{n}.npy") for n in names)
    states = [part("state", i, ("key", "byte")) for i in stored.states]
    return Automaton(stored.window, stored.shortest, states, [part("pattern", i, ("key", "offset", "blob")) for i in stored.patterns])


def _store_states(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("key").to_numpy(), b.column("byte").to_numpy().astype(np.uint8)) for b in batches if b.num_rows]
        part = TaskContext.get().partitionId()
        if held:
            for name, arrays in zip(("key", "byte"), zip(*held, strict=True), strict=True):
                save(folder, f"state-{part}.{name}.npy", np.concatenate(arrays))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    return run


def _store_patterns(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, blobs = [], [], []
        for b in batches:
            texts = [t.encode() for t in b.column("items").to_pylist()]
            keys.append(b.column("key").to_numpy())
            sizes += map(len, texts)
            blobs.append(np.frombuffer(b"".join(texts), np.uint8))
        part = TaskContext.get().partitionId()
        if sizes:
            save(folder, f"pattern-{part}.key.npy", np.concatenate(keys))
            save(folder, f"pattern-{part}.offset.npy", np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
            save(folder, f"pattern-{part}.blob.npy", np.concatenate(blobs))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    return run


def store(benchmark: DataFrame, window: int, item_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> Stored:
    """Make the automaton of a benchmark table of any size, in the shared folder."""
    if not 0 < window < WHOLE:
        raise ValueError(f"window must be from 1 to {WHOLE - 1}")
    spark = benchmark.sparkSession
    folder = new_path(spark, "automaton")
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    listed = materialise(rows.mapInArrow(_listed_states(window), _STATES), "states")
    states = listed.groupBy("key").agg(F.max("back").alias("back"), F.max("whole").alias("whole"))
    ends = listed.where(F.size("ends") > 0).select(F.col("key").alias("of"), "length", F.posexplode("ends").alias("skip", "key"))
    open_ = ends.join(states.select("key"), "key").groupBy("of").agg(F.max(F.col("length") - 1 - F.col("skip")).alias("open"))
    byte = F.greatest("back", F.coalesce("open", F.lit(0))) + F.when(F.col("whole"), WHOLE).otherwise(0)
    made = materialise(states.join(open_, F.col("key") == F.col("of"), "left").select("key", byte.alias("byte")), "automaton-states")
    patterns = listed.where("whole").groupBy("key").agg(F.to_json(F.sort_array(F.collect_set("item"))).alias("items"))
    n_states, n_bytes = made.count(), listed.where("whole").agg(F.coalesce(F.sum(F.octet_length("item") + 12), F.lit(0)), F.min("length")).first()
    parts = []
    for frame, size, run in ((made, 9 * n_states, _store_states(folder)), (patterns, n_bytes[0], _store_patterns(folder))):
        n = -(-size // shard_bytes)
        dealt = frame.repartitionByRange(n, "key") if n > 1 else frame.coalesce(1)
        parts.append(tuple(sorted(r.part for r in dealt.sortWithinPartitions("key").mapInArrow(run, "part int").collect())))  # a number a part
    return Stored(folder, window, n_bytes[1] or window, *parts)


def _merged(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1


def _covered(words: Words, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Flag of each word of a slice whether an occurrence covers it."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, end - size, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def scan(text: str, automaton: Automaton) -> tuple[int, np.ndarray, set[str]]:
    """(number of words, flag of each word whether it is hit, items found) of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]), ALNUM)
    end, size, key = automaton.scan(words)
    return len(words), _covered(words, end, size), {i for k in np.unique(key).tolist() for i in automaton.items(k)}


def _scanner(stored: Stored, text: str, schema: pa.Schema):
    """Arrow batches of the kept columns to kept columns and hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _mapped(stored)
        for batch in batches:
            for rows, data, offsets in rows_by_bytes(batch, text):
                words = Words(data, offsets, ALNUM)
                end, size, key = automaton.scan(words)
                hit = _covered(words, end, size)
                total = np.concatenate(([0], np.cumsum(hit)))
                # Runs of hit words; one never reaches into the next text.
                inner = words.first[1:-1]
                edge = np.zeros(len(words) + 1, bool)
                edge[inner] = True
                first = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | edge[1:-1]))) if len(words) else np.empty(0, np.int64)
                last = np.flatnonzero(hit & np.concatenate((~hit[1:] | edge[1:-1], [True]))) if len(words) else np.empty(0, np.int64)
                of = np.searchsorted(words.first, first, "right") - 1
                ends = pa.array(np.searchsorted(of, np.arange(len(rows) + 1)), pa.int32())
                base = words.first[of]
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if len(first) else np.zeros(1, np.int64)
                from_ = chars[words.start[first]] - chars[offsets[of]] if len(first) else first
                to = chars[words.end[last]] - chars[offsets[of]] if len(first) else first
                found: list[list[str]] = [[] for _ in range(len(rows))]
                if len(end):
                    row = np.searchsorted(words.first, end - 1, "right") - 1
                    pairs = np.unique(np.stack((row, key)), axis=1)
                    known = {k: automaton.items(k) for k in np.unique(pairs[1]).tolist()}
                    for r, k in pairs.T.tolist():
                        found[r] += known[k]
                lists = [
                    pa.array([sorted(set(x)) for x in found], pa.list_(pa.string())),
                    pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], names=["first", "last"])),
                    pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(from_), pa.array(to)], names=["start", "end"])),
                ]
                counts = pa.array(words.count, pa.int64()), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64())
                columns = [c.cast(schema.field(i + rows.num_columns).type) for i, c in enumerate((*counts, *lists))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], schema=schema)

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    min_share: float = 0.05,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    out_col: str = "bench",
) -> DataFrame:
    """Every row of ``docs`` with all its columns and a struct in ``out_col``, which replaces a column of that name.

    The struct has ``n_words``, ``n_hit`` (words inside an occurrence of a
    pattern), ``items`` (ids of the items found, sorted as strings),
    ``word_spans`` (first and last hit word of each run), ``spans`` (the same
    in code points of the original text) and ``contaminated``: some word is
    hit, and at least ``min_share`` of the words.

    Null and empty texts have no words and are clean. Items without words have
    no pattern; a null item id counts as ''. Repeated items count once, and
    repeated rows of ``docs`` each keep their row. The automaton is made here,
    by jobs over ``benchmark``, in parts of some ``shard_bytes``; ``docs`` are
    scanned once, whatever the size of the benchmark. Words are compared by
    64-bit hashes.
    """
    small_batches(docs.sparkSession)
    keep = [f"__c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*keep)
    schema = T.StructType([*given.schema.fields, *docs.sparkSession.createDataFrame([], HITS).schema.fields])
    stored = store(benchmark, window, item_col, item_text_col, shard_bytes)
    hits = given.mapInArrow(_scanner(stored, keep[docs.columns.index(text_col)], to_arrow_schema(schema)), schema)
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(min_share) * F.col("n_words"))
    if min_share > 0 and abs(1 / min_share - round(1 / min_share)) < 1e-9:  # whole numbers, free of rounding
        contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / min_share) >= F.col("n_words"))
    bench = F.struct("n_words", "n_hit", "items", "word_spans", "spans", contaminated.alias("contaminated"))
    return hits.select(*[F.col(k).alias(c) for k, c in zip(keep, docs.columns, strict=True) if c != out_col], bench.alias(out_col))
