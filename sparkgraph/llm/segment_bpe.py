"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The symbols of a piece are the leaves' neighbours: leaf i holds the key
``rank * width + i`` of the pair that begins at symbol i. The root, the least
key, is the leftmost pair of the lowest rank. A merge rewrites three leaves and
their paths to the root, until the root holds no pair. Many pieces of about
the same length are merged side by side, one tree a row, in NumPy; the piece's
merges are in the same order as one at a time.

The vocabulary file is that of the ``tokenizers`` library (byte-level BPE);
its path is a parameter.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgraph.llm.shared import small_batches
from sparkgraph.llm.textvec import rows_by_bytes, trim

#: Fixed by the file format: how byte-level BPE splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose ids a worker remembers; beyond, it forgets all but the first half, among which the frequent ones are.
REMEMBERED = 200_000

_NONE = np.int64(1) << np.int64(62)


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class SegmentTrees:
    """One segment tree of ``width`` leaves (a power of two) for each row."""

    def __init__(self, keys: np.ndarray):
        self.n, self.width = keys.shape
        self.nodes = np.empty((self.n, 2 * self.width), np.int64)
        self.nodes[:, self.width :] = keys
        size = self.width
        while size > 1:
            half = size // 2
            level = self.nodes[:, size : 2 * size]
            self.nodes[:, half:size] = np.minimum(level[:, ::2], level[:, 1::2])
            size = half

    def root(self, rows: np.ndarray) -> np.ndarray:
        return self.nodes[rows, 1]

    def set(self, rows: np.ndarray, leaf: np.ndarray, keys: np.ndarray) -> None:
        """Point updates, one in each row of ``rows``."""
        at = leaf + self.width
        self.nodes[rows, at] = keys
        while self.width > 1 and at[0] > 1:  # all leaves are equally deep
            at = at >> 1
            self.nodes[rows, at] = np.minimum(self.nodes[rows, 2 * at], self.nodes[rows, 2 * at + 1])


class Vocabulary:
    """Ids, pairs and ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if {k: pre.get(k) for k in plain} != plain or spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        ids: dict[str, int] = model["vocab"]
        self.byte_id = np.array([ids[c] for c in chars], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.size = max(self.bytes) + 1
        pairs, merged = [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append(ids[a] * self.size + ids[b])
            merged.append(ids[a + b])
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pairs, self.rank = np.array(pairs, np.int64)[order], order.astype(np.int64)
        self.merged = np.array(merged, np.int64)  # by rank
        # An open-addressed table from pair to rank: one or two probes instead of a binary search.
        self._bits = int(4 * len(pairs)).bit_length()
        self._slots = np.full(1 << self._bits, -1, np.int64)
        todo = np.arange(len(self.pairs))
        at = self._slot(self.pairs)
        while len(todo):
            free = self._slots[at] < 0
            self._slots[at[free]] = todo[free]
            lost = self._slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (len(self._slots) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, -1 where it has none or an id is below 0."""
        pairs = left * self.size + right
        out = np.full(pairs.shape, -1, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at, wanted = self._slot(pairs[todo]), pairs[todo]
        while len(todo):
            slot = self._slots[at]
            same = (slot >= 0) & (self.pairs[np.maximum(slot, 0)] == wanted)
            out[todo[same]] = self.rank[slot[same]]
            on = (slot >= 0) & ~same
            todo, at, wanted = todo[on], (at[on] + 1) & (len(self._slots) - 1), wanted[on]
        return out

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merge the ids in each row (-1 pads at the end) until no pair has a rank; -1 marks gone symbols."""
        n, width = symbols.shape
        sym = symbols.copy()
        place = np.arange(width)
        keys = np.full((n, width), _NONE)
        if width > 1:
            ranks = self.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
            keys[:, :-1] = np.where(ranks >= 0, ranks * width + place[:-1], _NONE)
        trees = SegmentTrees(keys)
        after = np.tile(place + 1, (n, 1))  # width: none
        before = np.tile(place - 1, (n, 1))  # -1: none
        rows = np.arange(n)
        while True:
            top = trees.root(rows)
            rows, top = rows[top < _NONE], top[top < _NONE]
            if not len(rows):
                return sym
            i, rank = top % width, top // width
            j = after[rows, i]
            k = after[rows, j]
            h = before[rows, i]
            new = self.merged[rank]
            sym[rows, i], sym[rows, j] = new, -1
            after[rows, i] = k
            inner = k < width
            before[rows[inner], k[inner]] = i[inner]
            right = np.where(inner, sym[rows, np.minimum(k, width - 1)], -1)
            ahead = self.ranks(new, right)
            trees.set(rows, i, np.where(ahead >= 0, ahead * width + i, _NONE))
            trees.set(rows, j, np.full(len(rows), _NONE))
            led = h >= 0
            if led.any():
                back = self.ranks(sym[rows[led], h[led]], new[led])
                trees.set(rows[led], h[led], np.where(back >= 0, back * width + h[led], _NONE))

    def encode_pieces(self, pieces: list[str], cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and the number of each."""
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        begin = np.cumsum(sizes) - sizes
        kept = np.zeros(len(data), bool)  # a merged symbol stands where its first byte stood
        order = np.argsort(sizes, kind="stable")
        by_size = sizes[order]
        i = int(np.searchsorted(by_size, 1))
        while i < len(order):
            width = 1 << max(0, int(by_size[i] - 1).bit_length())
            j = min(int(np.searchsorted(by_size, width, "right")), i + max(1, cells // width))
            group = order[i:j]
            mask = np.arange(width) < sizes[group][:, None]
            place = (begin[group][:, None] + np.arange(width))[mask]
            symbols = np.full((len(group), width), -1, np.int64)
            symbols[mask] = data[place]
            done = self.merge(symbols)[mask]
            data[place], kept[place] = done, done >= 0
            i = j
        ends = np.concatenate(([0], np.cumsum(kept)))
        return data[kept].astype(np.int32), ends[begin + sizes] - ends[begin]


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of the runs [start, start + size), one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Codec:
    """Encodes and decodes whole texts; remembers the ids of pieces it has met, up to a bound."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary = Vocabulary(path)
        self._piece = regex.compile(PIECES)
        self._marks = sorted(vocabulary.special, key=len, reverse=True)
        self._special = regex.compile("(" + "|".join(map(regex.escape, self._marks)) + ")") if self._marks else None
        sizes = np.zeros(vocabulary.size, np.int64)
        for i, token in vocabulary.bytes.items():
            sizes[i] = len(token)
        self._token_size, self._token_start = sizes, np.cumsum(sizes) - sizes
        self._token_bytes = np.frombuffer(b"".join(vocabulary.bytes[i] for i in sorted(vocabulary.bytes)), np.uint8)
        # Places of known pieces, and the ids of all of them one after another. Special strings are known first;
        # no other piece has their form.
        self._known = {mark: i for i, mark in enumerate(self._marks)}
        self._ids = np.array([vocabulary.special[m] for m in self._marks], np.int32)
        self._size = np.ones(len(self._marks), np.int64)

    def forget(self, keep: int = 0) -> None:
        """Keep the ``keep`` pieces that were met first; their places stay."""
        n = len(self._marks) + keep
        self._known = dict(itertools.islice(self._known.items(), n))
        self._ids = self._ids[: int(self._size[:n].sum())].copy()
        self._size = self._size[:n].copy()

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in order; special strings are pieces."""
        if not any(mark in text for mark in self._marks):
            return self._piece.findall(text)
        out: list[str] = []
        for part in self._special.split(text):
            out += [part] if part in self.vocabulary.special else self._piece.findall(part)
        return out

    def encode_flat(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of each."""
        split = [self.pieces(text) for text in texts]
        every = list(itertools.chain.from_iterable(split))
        if len(self._known) > REMEMBERED:
            self.forget(REMEMBERED // 2)
        known = self._known
        places = list(map(known.get, every))
        if None in places:
            fresh = list({p for p, i in zip(every, places, strict=True) if i is None})
            ids, sizes = self.vocabulary.encode_pieces(fresh)
            known.update(zip(fresh, range(len(self._size), len(self._size) + len(fresh)), strict=True))
            self._ids, self._size = np.concatenate((self._ids, ids)), np.concatenate((self._size, sizes))
            places = list(map(known.__getitem__, every))
        at = np.array(places, np.int64)
        size = self._size[at]
        start = (np.cumsum(self._size) - self._size)[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        pieces = np.concatenate(([0], np.cumsum([len(x) for x in split]))).astype(np.int64)
        return self._ids[_gather(start, size)], np.diff(ends[pieces])

    def encode_all(self, texts: Iterable[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, counts = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids that stand one after another, ``counts`` of them in each text."""
        size = self._token_size[ids]
        data = self._token_bytes[_gather(self._token_start[ids], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
        texts = pa.LargeStringArray.from_buffers(len(counts), buffers[1], buffers[2])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # some bytes are not UTF-8
            raw = data.tobytes()
            texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.large_string())
        return texts.cast(pa.string())

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        ids = np.fromiter(ids, np.int64)
        return self.decode_flat(ids, np.array([len(ids)]))[0].as_py()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns renamed apart, so that none clashes with a result."""
    small_batches(df.sparkSession)
    names = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def _checked(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each text in ``out_col`` (array<int>).

    As the library gives them without begin, end or other added tokens;
    special strings inside a text become their ids. Null and empty texts have
    no ids. With ``decoded_col`` the ids are also decoded again, as
    :func:`decode` does it, in the same pass over the data. Columns of these
    names are replaced.
    """
    given, names = _columns(docs)
    new = [T.StructField("__ids", T.ArrayType(T.IntegerType(), False))]
    if decoded_col is not None:
        new.append(T.StructField("__decoded", T.StringType()))
    schema = T.StructType([*given.schema.fields, *new])
    at, arrow = docs.columns.index(text_col), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for rows, _, _ in rows_by_bytes(batch, names[at], 1 << 20):
                ids, counts = own.encode_flat(t or "" for t in rows.column(at).to_pylist())
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                made = [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())).cast(arrow.field("__ids").type)]
                if decoded_col is not None:
                    made.append(own.decode_flat(ids, counts))
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], schema=arrow)
        own.forget()  # the worker lives on
        trim()

    _checked(path)
    coded = given.mapInArrow(run, schema)
    out = [out_col] if decoded_col is None else [out_col, decoded_col]
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in out]
    return coded.select(*kept, *[F.col(f.name).alias(c) for f, c in zip(new, out, strict=True)])


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in ``ids_col``; null ids and null elements give no characters."""
    given, names = _columns(docs)
    schema = T.StructType([*given.schema.fields, T.StructField("__text", T.StringType())])
    at, arrow = docs.columns.index(ids_col), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                lists = rows.column(at)
                counts = lists.value_lengths().fill_null(0).to_numpy()
                ids = lists.flatten()
                if ids.null_count:
                    row = np.repeat(np.arange(len(counts)), counts)[ids.is_valid().to_numpy(zero_copy_only=False)]
                    ids, counts = ids.drop_null(), np.bincount(row, minlength=len(counts))
                yield pa.RecordBatch.from_arrays([*rows.columns, own.decode_flat(ids.to_numpy(), counts)], schema=arrow)

    _checked(path)
    out = given.mapInArrow(run, schema)
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != out_col]
    return out.select(*kept, F.col("__text").alias(out_col))
