"""Perplexity by interpolated modified Kneser-Ney models of two and of three words.

Counting: each task reduces its texts to distinct triples (the two words
before, word) with counts and sends them, packed by shard, to the task that adds
up that shard. Shards are chosen by the previous word's hash and a few bits of
the word's, so that no frequent word gathers its successors in one place, and a
pair's count and its distinct predecessors are added up with its triples. A
second exchange adds up, for each word, its pairs as a context and its distinct
predecessors, and, for each pair, its successors met twice or more; those met
once are what is left of the pair's count. Triples go in passes over the texts,
each for some of the shards, and the files of a pass's shuffle are removed
before the next, so that not all triples lie on disk twice.

Storage: a shard is a sorted array of 64-bit hashes with parallel arrays of
counts, in the shared folder. Scoring workers memory-map them, so only the
pages they touch are read, and share them on a machine.

With ``order`` 2 only pairs are counted. With 3 the same tables hold both
models: the pairs' own counts for the one, their predecessors for the other.
Pairs that begin a text have no predecessors and keep their counts.
"""

from __future__ import annotations

import functools
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgraph.llm.shared import delete, flat_schema, local_path, new_path, small_batches, text_bytes
from sparkgraph.llm.textvec import Words, mix, rows_by_bytes

#: Hashes that stand for the place before the first word, and for the end.
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)

#: Pairs a task gathers before it sends them on.
HELD = 1 << 21

#: Input bytes for each shard, and parts into which a previous word's successors are dealt.
SHARD_BYTES, SALT = 16 << 20, 8

#: Bits of a shard's number that tables of words have less. Every shard of pairs sends to every shard of words, so these are few.
FEWER = 3

#: Passes over the texts that count triples.
PASSES = 4

#: Spark's setting to remove the files of a query's shuffles when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_PACKED = flat_schema("shard int, kind int, blob binary")
_STATS = flat_schema("kind int, a long, b long, c long, n1 long, n2 long, n3 long, n4 long")


def _deal(previous: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    return mix(previous ^ ((word % np.uint64(SALT)) * _C2)) >> np.uint64(64 - bits)


def _dealt(key: np.ndarray, previous: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return key
    return _deal(previous, word, bits) << np.uint64(64 - bits) | (key >> np.uint64(bits))


def pair_keys(previous: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """The hash of each pair; its top ``bits`` are the shard."""
    return _dealt(mix(mix(previous + _C1) ^ word), previous, word, bits)


def triple_keys(earlier: np.ndarray, previous: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """The hash of each triple; its shard is that of its last two words."""
    return _dealt(mix(pair_keys(previous, word, 0) ^ mix(earlier + _C2)), previous, word, bits)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def word_bits(bits: int) -> int:
    """Bits of the shards of words, contexts and successors, which are smaller than the shards of pairs would be."""
    return max(min(bits, 5), bits - FEWER)


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous word, word and first token of each row (with the total at the end); each row ends in END."""
    n_rows, hashes = len(words.count), words.hashes(lower=True)
    first = words.first + np.arange(n_rows + 1)
    word = np.empty(len(words) + n_rows, np.uint64)
    previous = np.empty_like(word)
    at = np.arange(len(words)) + words.row()
    word[at], previous[at + 1] = hashes, hashes
    word[first[1:] - 1], previous[first[:-1]] = END, BEGIN
    return previous, word, first


def before(previous: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before the previous one; BEGIN for the first two tokens of a row."""
    earlier = np.empty_like(previous)
    earlier[1:] = previous[:-1]
    earlier[first[:-1]] = BEGIN
    return earlier


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one compressed blob.

    64-bit arrays of hashes go as one dictionary and indexes, without these where
    there is one that counts up; counts in the narrowest type that holds them.
    """
    n = len(arrays[0])
    hashes = [a for a in arrays if a.dtype == np.uint64]
    plain = len(hashes) == 1 and bool((hashes[0][1:] > hashes[0][:-1]).all())
    values, index = (hashes[0], None) if plain else np.unique(np.concatenate(hashes), return_inverse=True)
    counts = [_small(a) for a in arrays if a.dtype != np.uint64]
    out = [np.array((n, len(values), plain, *(c.dtype.itemsize for c in counts)), np.int64).tobytes(), values.tobytes()]
    if not plain:
        out.append(index.astype(_width(len(values))).tobytes())
    out += [c.tobytes() for c in counts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _width(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of a blob; ``kinds`` has h for hashes, which come first, and n for counts."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, size, plain, *widths = np.frombuffer(data, np.int64, 3 + kinds.count("n")).tolist()
    at = 8 * (3 + len(widths))
    values, out = np.frombuffer(data, np.uint64, size, at), []
    at += 8 * size
    for kind in kinds:
        if kind == "h" and plain:
            out.append(values)
        elif kind == "h":
            out.append(values[np.frombuffer(data, _width(size), n, at)])
            at += n * np.dtype(_width(size)).itemsize
        else:
            width = widths.pop(0)
            out.append(np.frombuffer(data, f"<u{width}", n, at).astype(np.int64))
            at += width * n
    return out


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, the place of one row of each, and the sums of ``values``."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.empty(0, np.int64)
    return ranked[new], order[new], [np.add.reduceat(v[order], new) if len(new) else v for v in values]


@functools.cache
def _arrow(names: tuple[str, ...]) -> pa.Schema:
    return to_arrow_schema(_PACKED if names == tuple(_PACKED.names) else _STATS)


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    arrow = _arrow(tuple(schema.names))
    columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


#: Bytes of blobs that go in one batch.
BATCH_BYTES = 4 << 20


def _by_shard(kind: int, keys: np.ndarray, bits: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Arrays packed by the shards of their keys, some shards to a batch; what is in order by key stays so."""
    shard = shard_of(keys, bits)
    order = None if (shard[1:] >= shard[:-1]).all() else np.argsort(shard, kind="stable")
    rows, size = [], 0
    for s, begin, end in _runs(shard if order is None else shard[order]):
        part = slice(begin, end) if order is None else order[begin:end]
        rows.append((s, kind, _pack(*(a[part] for a in arrays))))
        size += len(rows[-1][2])
        if size >= BATCH_BYTES:
            yield _batch(_PACKED, rows)
            rows, size = [], 0
    if rows:
        yield _batch(_PACKED, rows)


def _runs(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each shard in a sorted list, and where its entries begin and end."""
    cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))).tolist() if len(shards) else []
    return zip(shards[cuts].tolist() if cuts else [], cuts, [*cuts[1:], len(shards)], strict=False)


def _keys(grams: list[np.ndarray], bits: int) -> np.ndarray:
    return (pair_keys if len(grams) == 2 else triple_keys)(*grams, bits)


def _count(bits: int, order: int, passes: int, at: int):
    """Texts to packed pairs or triples by shard, of every shard whose number leaves ``at`` when divided by ``passes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            grams = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            keys, one, (counts,) = _summed(_keys(grams, bits), np.ones(len(grams[0]), np.int64))
            # Pairs side by side pack better; their shard stays in front.
            near = (grams[-2][one] >> np.uint64(36) << np.uint64(28) | grams[-1][one] >> np.uint64(36)) >> np.uint64(bits)
            near = np.argsort(shard_of(keys, bits).astype(np.uint64) << np.uint64(64 - bits) | near if bits else near)
            one = one[near]
            yield from _by_shard(0, keys[near], bits, *(x[one] for x in grams), counts[near])

        for batch in batches:
            for _, data, offsets in rows_by_bytes(batch, "text"):
                previous, word, first = tokens(Words(data, offsets))
                grams = (before(previous, first), previous, word)[-order:]
                if passes > 1:
                    mine = _deal(previous, word, bits) % np.uint64(passes) == at
                    grams = tuple(x[mine] for x in grams)
                held.append(grams)
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from flush()
        if any(len(x[0]) for x in held):
            yield from flush()

    return run


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Put an array in the shared folder under its final name at once, so that a repeated task does no harm."""
    path = local_path(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as file:
            np.save(file, array)
        os.replace(part, f"{path}/{name}")
        return
    store, base = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        np.save(out, array)
    store.move(part, f"{base}/{name}")


def _mapped(path: str) -> np.ndarray:
    """An array that is mapped into memory without holding its file open, or read if it is small: a worker has thousands of them."""
    with open(path, "rb") as file:
        if os.path.getsize(path) < 1 << 16:
            return np.load(file)
        np.lib.format.read_magic(file)
        shape, _, dtype = np.lib.format.read_array_header_1_0(file)
        data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        return np.frombuffer(data, dtype, offset=file.tell()).reshape(shape)


def load(folder: str, name: str) -> np.ndarray | None:
    """Map an array into memory; None if the shard has none. From a remote store it is fetched first, into an unlinked file."""
    path = local_path(folder)
    if path is not None:
        full = f"{path}/{name}"
        return _mapped(full) if os.path.exists(full) else None
    store, base = pa.fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{base}/{name}").type == pa.fs.FileType.NotFound:
        return None
    with tempfile.NamedTemporaryFile(suffix=".npy") as own:
        with store.open_input_stream(f"{base}/{name}") as source:
            while piece := source.read(1 << 20):
                own.write(piece)
        own.flush()
        return _mapped(own.name)


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8)


def _tally(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == i).sum()) for i in range(1, 5)]


def _save_counts(folder: str, table: str, column: str, counts: np.ndarray) -> None:
    """Large counts are few; the others take a byte each."""
    large = np.flatnonzero(counts > 255)
    save(folder, f"{table}.{column}.npy", np.minimum(counts, 255).astype(np.uint8))
    save(folder, f"{table}.{column}-large.npy", np.stack((large, counts[large])))


def _by_size(counts: np.ndarray) -> list[np.ndarray]:
    return [counts, *((counts == i).astype(np.int64) for i in (1, 2)), (counts > 2).astype(np.int64)]


def _add_pairs(folder: str, bits: int, order: int):
    """Add up one shard of pairs or triples, store it, and send on what its words and pairs need."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b, "h" * order + "n") for b in table.column("blob").to_pylist()]
        *grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        shard = table.column("shard")[0].as_py()
        out: list[pa.RecordBatch] = []
        tallies: list[list[int]] = []
        predecessors = np.ones(len(counts), np.int64)
        if order == 3:
            keys, one, (counts,) = _summed(triple_keys(*grams, bits), counts)
            grams = [x[one] for x in grams]
            inside = np.flatnonzero(grams[1] != BEGIN)
            save(folder, f"triple-{shard}.key.npy", keys[inside])
            _save_counts(folder, f"triple-{shard}", "count", counts[inside])
            tallies = [[5, *_tally(counts[inside]), len(inside)]]
            more = inside[counts[inside] > 1]
            twice = counts[more] == 2
            held = [twice.astype(np.int64), (~twice).astype(np.int64), np.where(twice, 0, counts[more])]
            contexts, _, held = _summed(pair_keys(grams[0][more], grams[1][more], bits), *held)
            out += _by_shard(4, contexts, word_bits(bits), contexts, *held)
            del keys, inside, more
            predecessors = np.ones(len(counts), np.int64)
        previous, word = grams[-2:]
        del grams
        keys, one, (counts, predecessors) = _summed(pair_keys(previous, word, bits), counts, predecessors)
        previous, word = previous[one], word[one]
        save(folder, f"pair-{shard}.key.npy", keys)
        _save_counts(folder, f"pair-{shard}", "count", counts)
        sizes = _by_size(counts)
        tallies.append([3, *_tally(counts), len(counts)])
        if order == 3:
            adjusted = np.where(previous == BEGIN, counts, predecessors)
            _save_counts(folder, f"pair-{shard}", "adjusted", adjusted)
            sizes += _by_size(adjusted)
            tallies.append([6, *_tally(adjusted), len(adjusted)])
        contexts, _, sizes = _summed(previous, *sizes)
        words, _, (seen, different) = _summed(word, counts, np.ones(len(word), np.int64))
        out += [
            *_by_shard(1, contexts, word_bits(bits), contexts, *sizes),
            *_by_shard(2, words, word_bits(bits), words, seen, different),
            _batch(_PACKED, [(-1, 3, np.array(tallies, np.int64).tobytes())]),
        ]
        return pa.Table.from_batches(out)

    return run


def _add_words(folder: str, order: int):
    """Add up one shard of contexts and words and store it; the tallies of the whole model come out."""
    forms = {1: ("context", "h" + "nnnn" * (order - 1)), 2: ("word", "hnn"), 4: ("successor", "hnnn")}

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        rows: list[tuple] = []
        for kind, (name, form) in forms.items():
            parts = [_unpack(b, form) for k, b in zip(kinds, blobs, strict=True) if k == kind]
            if not parts:
                continue
            keys, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            keys, _, values = _summed(keys, *values)
            save(folder, f"{name}-{shard}.key.npy", keys)
            for i, v in enumerate(values):
                save(folder, f"{name}-{shard}.{i}.npy", _small(v))
            if kind == 2:
                rows.append((2, len(keys), int(values[0].sum()), int(values[1].sum()), *_tally(values[1])))
        for kind, blob in zip(kinds, blobs, strict=True):
            if kind == 3:
                rows += [(of, size, 0, 0, *n) for of, *n, size in np.frombuffer(blob, np.int64).reshape(-1, 6).tolist()]
        return pa.Table.from_batches([_batch(_STATS, rows)])

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and 3 or more, from how many counts are 1 to 4; usual values where some are none."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
    return tuple(min(max(d, 0.0), i + 1.0) for i, d in enumerate(raw))  # type: ignore[return-value]


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the numbers that hold for all of them."""

    folder: str
    bits: int
    n_tokens: int
    n_words: int
    n_pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    rest: float  # of the word distribution, for unseen words
    order: int = 2
    adjusted_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)  # of pairs below triples
    triple_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)


def _summed_stats(stats: DataFrame) -> dict[int, Row]:
    sums = stats.groupBy("kind").agg(*[F.sum(c).alias(c) for c in _STATS.names[1:]])
    return {row.kind: row for row in sums.collect()}  # four rows at most


def train(docs: DataFrame, text_col: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES, order: int = 3, passes: int | None = None) -> Model:
    """Count all of ``docs`` and store the model in ``folder`` (a new one in the shared folder by default).

    ``order`` is the longest run of words that is counted, 2 or 3. ``docs`` is
    read ``passes`` times (``PASSES`` for order 3, once for 2) and must have the
    same rows each time.

    Words are runs of bytes other than space and 0x09-0x0D with A-Z
    lower-cased; each text, null and empty too, ends in one end token. Without
    rows the model knows no word.
    """
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    folder = folder or new_path(spark, "kneser-ney")
    # Triples take about twice the memory of pairs when a shard is added up.
    bits = max(3, (text_bytes(docs, text_col) // shard_bytes).bit_length()) + (order == 3)
    passes = passes or (PASSES if order == 3 else 1)
    texts, parts = docs.select(F.col(text_col).alias("text")), new_path(spark, "kneser-ney-parts")
    kept = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        for at in range(passes):
            packed = texts.mapInArrow(_count(bits, order, passes, at), _PACKED)
            # A task has the shards of a few numbers, however many partitions the session has.
            packed = packed.repartition(-(-(1 << bits) // passes), "shard")
            packed.groupBy("shard").applyInArrow(_add_pairs(folder, bits, order), _PACKED).write.parquet(f"{parts}/{at}")
        pairs = spark.read.schema(_PACKED).parquet(*[f"{parts}/{at}" for at in range(passes)])
        stats = pairs.repartition(1 << word_bits(bits), "shard").groupBy("shard").applyInArrow(_add_words(folder, order), _STATS)
        by_kind = _summed_stats(stats)
    finally:
        spark.conf.set(_CLEANUP, kept)
        delete(spark, parts)
    if not by_kind:
        return Model(folder, bits, 0, 0, 0, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 1.0, order)
    words, every = by_kind[2], by_kind[3]
    lower, upper, *more = (discounts([r.n1, r.n2, r.n3, r.n4]) for r in [words, every, *(by_kind[k] for k in (6, 5) if order == 3)])
    rest = (lower[0] * words.n1 + lower[1] * words.n2 + lower[2] * (words.a - words.n1 - words.n2)) / words.c
    return Model(folder, bits, words.b, words.a, every.a, upper, lower, rest, order, *more)


class Tables:
    """A model's arrays, mapped into memory shard by shard as they are asked for."""

    def __init__(self, model: Model):
        self.model = model
        self._maps: dict[str, np.ndarray | None] = {}

    def _array(self, name: str) -> np.ndarray | None:
        if name not in self._maps:
            self._maps[name] = load(self.model.folder, f"{name}.npy")
        return self._maps[name]

    def find(self, table: str, keys: np.ndarray, columns: list[str]) -> list[np.ndarray]:
        """The columns' counts for each key, 0 where the table lacks it."""
        asked, back = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(asked), np.int64) for _ in columns]
        bits = self.model.bits if table in ("pair", "triple") else word_bits(self.model.bits)
        for s, begin, end in _runs(shard_of(asked, bits)):
            part = asked[begin:end]
            have = self._array(f"{table}-{s}.key")
            if have is None or not len(have):
                continue
            at = np.searchsorted(have, part)
            at[at == len(have)] = 0
            found = np.flatnonzero(have[at] == part)
            for values, column in zip(out, columns, strict=True):
                values[begin + found] = self._array(f"{table}-{s}.{column}")[at[found]]
                if table in ("pair", "triple"):
                    large, counts = self._array(f"{table}-{s}.{column}-large")
                    if len(large):
                        i = np.minimum(np.searchsorted(large, at[found]), len(large) - 1)
                        hit = large[i] == at[found]
                        values[begin + found[hit]] = counts[i[hit]]
        return [v[back] for v in out]

    def log10(self, earlier: np.ndarray, previous: np.ndarray, word: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Each model's log10 probability of each word after those before it, and the word's count in training."""
        m = self.model
        seen, different = self.find("word", word, ["0", "1"])
        low = np.array((0.0, *m.word_discounts))
        p = m.rest / (m.n_words + 1)
        if m.n_pairs:
            p = p + np.maximum(different - low[np.minimum(different, 3)], 0) / m.n_pairs
        p = np.broadcast_to(p, len(word)).astype(float)
        sizes = self.find("context", previous, [str(i) for i in range(4 * (m.order - 1))])
        keys = pair_keys(previous, word, m.bits)
        pairs, *adjusted = self.find("pair", keys, ["count", "adjusted"][: m.order - 1])
        out = [np.log10(_interpolated(pairs, m.pair_discounts, *sizes[:4], p))]
        if m.order == 3:
            p = _interpolated(adjusted[0], m.adjusted_discounts, *sizes[4:], p)
            # A token's context is the pair that ends before it. The first token of a text has none.
            inside = np.flatnonzero(previous != BEGIN)
            total = pairs[inside - 1]
            triples, n2, n3, in_n3 = (np.zeros(len(inside), np.int64) for _ in range(4))
            # Only where both pairs are known can the triple be, and only a pair met twice has a successor met twice.
            i = np.flatnonzero((total > 0) & (pairs[inside] > 0))
            at = inside[i]
            (triples[i],) = self.find("triple", triple_keys(earlier[at], previous[at], word[at], m.bits), ["count"])
            i = np.flatnonzero(total > 1)
            n2[i], n3[i], in_n3[i] = self.find("successor", keys[inside[i] - 1], ["0", "1", "2"])
            p[inside] = _interpolated(triples, m.triple_discounts, total, total - 2 * n2 - in_n3, n2, n3, p[inside])
            out.append(np.log10(p))
        return out, seen


def _interpolated(counts: np.ndarray, of: tuple, total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted shares of the contexts' totals, what is spared going by ``lower``, which stands alone after unknown contexts."""
    p, known, top = lower.copy(), total > 0, np.array((0.0, *of))
    spare = top[1] * n1 + top[2] * n2 + top[3] * n3
    t = total[known]
    p[known] = np.maximum(counts - top[np.minimum(counts, 3)], 0)[known] / t + spare[known] / t * p[known]
    return p


@functools.lru_cache(maxsize=1)
def _tables(model: Model) -> Tables:
    return Tables(model)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "lm") -> DataFrame:
    """Every row and column of ``docs`` with a struct in ``out_col``, which replaces a column of that name.

    It has ``n_tokens`` (words and the end), ``n_known`` (tokens met in
    training), ``base_score`` (log10 probability by add-one word frequencies),
    ``score`` (by the model of two words), with a model of order 3
    ``trigram_score`` (by that of three) and ``perplexity`` (10 to the power of
    minus the last score a token). Null and empty texts are one end token.
    """
    small_batches(docs.sparkSession)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*names)
    scores = ["score", "trigram_score"][: model.order - 1]
    fields = flat_schema("n_tokens long, n_known long, base_score double, " + ", ".join(f"{s} double" for s in scores)).fields
    schema = T.StructType([*given.schema.fields, *fields])
    text, arrow = names[docs.columns.index(text_col)], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(model)
        for batch in batches:
            for rows, data, offsets in rows_by_bytes(batch, text):
                previous, word, first = tokens(Words(data, offsets))
                logs, seen = tables.log10(before(previous, first), previous, word)
                base = np.log10((seen + 1) / (model.n_tokens + 1 * (model.n_words + 1)))
                at = first[:-1]
                values = np.diff(first), np.add.reduceat((seen > 0).astype(np.int64), at), *(np.add.reduceat(x, at) for x in (base, *logs))
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, values)], schema=arrow)

    perplexity = F.pow(F.lit(10.0), -F.col(scores[-1]) / F.col("n_tokens")).alias("perplexity")
    lm = F.struct("n_tokens", "n_known", "base_score", *scores, perplexity).alias(out_col)
    return given.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != out_col], lm)
