"""Removal of repeated passages by seeding and extending.

A passage of ``length`` words that stands in two places holds, in both, the
same winnowed anchor: the least hash among the word ``seed``-grams of a window
is chosen from the window's words alone. So every window belongs to one
anchor, and documents need only be joined on anchors.

1. Seed: each document gives its anchors; an anchor carries a hash of its
   context, which is all windows that chose it. Anchors found once are done.
2. Extend, whole: places that agree in anchor and context repeat each other
   in all their windows, to both ends of the context.
3. Extend, word by word: where one anchor has several contexts, the windows
   of each different context are compared by hash. A context that many places
   share is compared once, for all of them.
4. Overlapping repeats are merged to maximal spans and cut out.

All groups are counted before or at the shuffle; no pairs of places are made.
Rows of one id and text share a key; what is gathered for a key are sets, so that
a document that is repeated a thousand times has its places and spans once.
Texts move only for documents that need step 3 or 4, found by a bitmap of
fixed size (which may let others pass, never hold one back).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgraph.llm.shared import flat_schema, materialise, small_batches
from sparkgraph.llm.textvec import RUN, Words, prefix_hash, rows_by_bytes, run_hash

#: Bits of the bitmap of documents; its 4 MiB bound what is collected and broadcast.
BITS = 1 << 25


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the first position of the least of values[i : i + width]."""
    at, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        first, second = at[:-step], at[step:]
        at = np.where(values[second] < values[first], second, first)
        done += step
    return at


class Anchors:
    """The anchors of a slice: ``lo`` first window (word index), ``n`` windows, ``anchor`` and ``context`` hashes, ``row``."""

    def __init__(self, words: Words, length: int, seed: int):
        n = len(words)
        empty = np.empty(0, np.int64)
        self.lo = self.n = self.row = empty
        self.anchor = self.context = np.empty(0, np.uint64)
        if n < length:
            return
        prefix = prefix_hash(words.hashes(), RUN)
        place = np.arange(n - seed + 1)
        grams = run_hash(prefix, place, place + seed)
        chosen = _sliding_argmin(grams, length - seed + 1)
        row = words.row()
        start = np.arange(len(chosen))
        start = start[words.first[1:][row[start]] - start >= length]
        if not len(start):
            return
        at = chosen[start]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[start[1:]] != row[start[:-1]]))))
        last = np.concatenate((new[1:], [len(start)])) - 1
        self.lo, self.row = start[new], row[start[new]]
        self.n = start[last] - self.lo + 1
        self.anchor = grams[at[new]]
        self.context = run_hash(prefix, self.lo, start[last] + length) + (at[new] - self.lo).astype(np.uint64)


_ANCHORS = flat_schema("key long, lo int, n int, anchor long, context long")
_WINDOWS = flat_schema("key long, anchor long, window long, first int, asks boolean, weight int")


def _seeds(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_ANCHORS)
        for batch in batches:
            for rows, data, offsets in rows_by_bytes(batch, "text"):
                words = Words(data, offsets)
                a = Anchors(words, length, seed)
                if len(a.lo):
                    key = rows.column("key").to_numpy()[a.row]
                    lo = (a.lo - words.first[a.row]).astype(np.int32)
                    values = key, lo, a.n.astype(np.int32), a.anchor.view(np.int64), a.context.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], schema=schema)

    return run


def _windows(length: int):
    """Hashes of all windows of the contexts listed in ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_WINDOWS)
        for batch in batches:
            for rows, data, offsets in rows_by_bytes(batch, "text"):
                words = Words(data, offsets)
                prefix = prefix_hash(words.hashes(), RUN)
                places = rows.column("places")
                each = places.flatten()
                row = np.repeat(np.arange(len(rows)), places.value_lengths().to_numpy())
                lo, n, anchor, weight = (each.field(f).to_numpy().astype(np.int64) for f in ("lo", "n", "anchor", "weight"))
                which = np.repeat(np.arange(len(lo)), n)
                first = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = first + words.first[row[which]]
                found = run_hash(prefix, start, start + length)
                key = rows.column("key").to_numpy()[row[which]]
                asks = (weight == 1)[which]
                values = key, anchor[which], found.view(np.int64), first.astype(np.int32), asks, weight[which].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], schema=schema)

    return run


class Bitmap:
    """A bitmap over hashed keys with a fixed number of bits, for a cheap first test of membership.

    It is a table of at most BITS / 32768 + 1 rows of 4 KiB, which bounds what is
    broadcast. Building and testing are DataFrame expressions. Beyond some 10^8
    keys nearly all bits are set, and the join behind it does all the work.
    """

    def __init__(self, keys: DataFrame, column: str):
        place = F.expr(f"`{column}` & {BITS - 1}L")
        parts = keys.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__bit"))
        self.parts = materialise(parts.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits")), "bitmap")

    def filter(self, df: DataFrame, column: str, inside: bool = True) -> DataFrame:
        """The rows whose key may be among the keys, or those whose key is not."""
        place = f"`{column}` & {BITS - 1}L"
        bit = f"bitmap_bit_position({place})"
        byte = f"CAST(conv(hex(substring(__bits, CAST({bit} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
        found = F.expr(f"coalesce(shiftright({byte}, CAST({bit} % 8 AS INT)) & 1, 0) = 1")
        tested = df.join(F.broadcast(self.parts), F.expr(f"bitmap_bucket_number({place}) = __bucket"), "left")
        return tested.where(found if inside else ~found).select(*df.columns)


def repeated_spans(docs: DataFrame, length: int = 35, seed: int = 8) -> DataFrame:
    """The repeats in ``docs`` (columns ``key``, a long made from id and text, and ``text``; a key may be repeated).

    Returns ``key`` and ``spans``, structs of the first and last word of spans
    that windows of ``length`` words found elsewhere cover; they may overlap,
    and documents without any have no row.
    """
    if not 0 < seed <= length:
        raise ValueError("seed must be from 1 to length")
    seeds = materialise(docs.mapInArrow(_seeds(length, seed), _ANCHORS), "seeds")
    again = materialise(
        seeds.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("places"), F.min("context").alias("least"), F.max("context").alias("most"))
        .where("places > 1")
        .select("anchor", (F.col("least") != F.col("most")).alias("mixed")),
        "repeated-seeds",
    )
    found = materialise(seeds.join(again, "anchor").withColumn("place", F.xxhash64("key", "lo")), "places")
    mixed = found.where("mixed")
    contexts = materialise(
        mixed.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("places"), F.min("place").alias("chosen")), "contexts"
    )
    extended = materialise(mixed.join(contexts, ["anchor", "context"]), "extended")
    # Of places that share a context one speaks for all, with the weight of two.
    speaks = extended.where("places = 1 OR place = chosen").select(
        "key", F.struct("lo", "n", "anchor", F.when(F.col("places") > 1, 2).otherwise(1).alias("weight")).alias("place")
    )
    speaks = materialise(speaks.groupBy("key").agg(F.collect_set("place").alias("places")), "speaking")
    texts = Bitmap(speaks, "key").filter(docs.select("key", "text"), "key").join(speaks, "key")
    windows = materialise(texts.mapInArrow(_windows(length), _WINDOWS), "windows")
    twice = windows.groupBy("anchor", "window").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor", "window")
    partly = windows.where("asks").join(twice, ["anchor", "window"], "left_semi").select("key", F.struct("first", (F.col("first") + length - 1).alias("last")).alias("span"))
    whole = F.struct(F.col("lo").alias("first"), (F.col("lo") + F.col("n") + length - 2).alias("last")).alias("span")
    spans = (
        found.where("NOT mixed").select("key", whole)
        .unionByName(extended.where("places > 1").select("key", whole))
        .unionByName(partly)
    )
    return spans.groupBy("key").agg(F.collect_set("span").alias("spans"))


def _cut(text_at: int, spans_at: int, n_keep: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in rows_by_bytes(batch, batch.schema.names[text_at]):
                counts, gone, spans, kept = [], [], [], []
                for text, cuts in zip(rows.column(text_at).to_pylist(), rows.column(spans_at).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    merged: list[list[int]] = []
                    for first, last in sorted((c["first"], c["last"]) for c in cuts or ()):
                        if merged and first <= merged[-1][1] + 1:
                            merged[-1][1] = max(last, merged[-1][1])
                        else:
                            merged.append([first, last])
                    counts.append(len(words))
                    gone.append(sum(b - a + 1 for a, b in merged))
                    spans.append([{"first": a, "last": b} for a, b in merged])
                    for a, b in reversed(merged):
                        del words[a : b + 1]
                    kept.append(b" ".join(words).decode())
                new = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, schema.field(n_keep + 2).type), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:n_keep], *new], schema=schema)

    return run


def substring_dedup(docs: DataFrame, length: int = 35, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", out_col: str = "repeats") -> DataFrame:
    """Cut every passage of at least ``length`` words that stands elsewhere too, in the same document or another.

    Words are runs of bytes other than space and 0x09-0x0D, compared
    unchanged. Returns every row and column of ``docs`` and, in ``out_col``
    (which replaces a column of that name), a struct of ``n_words``, ``n_removed``, ``spans`` (first and last word of
    each maximal repeat, merged) and ``kept`` (the words left, joined by one
    space). All copies of a passage go. Windows are judged on the input, not on
    what is left. Null and empty texts have no words; texts of fewer words than
    ``length`` lose none; rows of the same id and text are two documents; a
    null id is an id like others.
    """
    small_batches(docs.sparkSession)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*names)
    text, ident = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    given = given.withColumn("key", F.xxhash64(F.col(ident), F.col(text)))
    spans = materialise(repeated_spans(given.select("key", F.col(text).alias("text")), length, seed), "spans")
    bitmap = Bitmap(spans, "key")
    hit = bitmap.filter(given, "key").join(spans, "key", "left").select(*names, "spans")
    clean = bitmap.filter(given, "key", inside=False).select(*names, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    schema = T.StructType(
        [*given.select(*names).schema.fields, *T.StructType.fromDDL("n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept string").fields]
    )
    run = _cut(names.index(text), len(names), len(names), to_arrow_schema(schema))
    out = hit.mapInArrow(run, schema).unionByName(clean.mapInArrow(run, schema))
    repeats = F.struct("n_words", "n_removed", "spans", "kept").alias(out_col)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != out_col], repeats)
