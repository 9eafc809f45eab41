"""Near-duplicate classes from weighted DartMinHash signatures.

Darts are thrown, by hashing, at the plane of weight and rank that belongs to
each element. The plane is cut in regions that double in weight and in rank,
and each region in cells of area one that hold a Poisson number of darts. A
dart counts if it lies below the element's weight; of the counting darts of a
coordinate the one of least rank is kept. Two sets agree in a coordinate with
the probability of their weighted Jaccard similarity, and only about
k ln k + 2k darts of low rank are looked at for k coordinates.

Signatures are cut into bands; documents that share a band meet in a bucket.
Candidate pairs are checked exactly on their shingles, and documents linked by
pairs at or above the threshold form a class (connected components).

No bucket is expanded into all its pairs. First the least member of a bucket is
compared with the others. Then some members, chosen by hash, and last all are
compared with the members that are not yet of their class and whose sketch (a
longer signature, two bits a coordinate, made only for buckets that hold several
classes) is not too far. So each pair in a bucket is compared, already linked, or
far apart. A pair that shares several buckets is compared in the first of them.

Between rounds a document is one row that lists its buckets, so that labels and
sketches are joined once to each document, and buckets of one class are struck
from the lists by a bitmap, without a shuffle by bucket. In the last round a
member of a bucket goes to ``MAX_BLOCKS`` tasks at most, however large the bucket
is; what grows with the square of a bucket is only the comparison of sketches in
memory, at some 50 ns a pair of members of different classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgraph.llm.components import components
from sparkgraph.llm.shared import materialise, small_batches
from sparkgraph.llm.substring_dedup import Bitmap
from sparkgraph.llm.textvec import RUN, Words, mix, prefix_hash, rows_by_bytes, run_hash, shingles

#: P(more than i darts) for a Poisson number with mean one.
_MORE = [1 - sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(16)]
#: Members of a bucket that have been compared with all others after each round; the last round is for all.
ROUNDS = (4, 32, math.inf)

#: Members of a large bucket that are compared with as many others in one task, and the parts that it has at most.
BLOCK, MAX_BLOCKS = 512, 64

#: Coordinates of a sketch, and those that are compared before the others.
SKETCH, GLANCE = 1024, 256

#: Cells that are looked at side by side.
CELLS = 1 << 19

_C1, _C2, _C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_UNIT = 2.0**-53


def _times(c: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(c) * n % 2**64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * _UNIT


def _throw(elements: np.ndarray, weights: np.ndarray, row: np.ndarray, limit: np.ndarray):
    """The counting darts with rank under ``limit`` of their row: (row, dart hash, rank), region by region."""
    nu = 0
    while len(elements) and (np.uint64(1) << np.uint64(nu)) - np.uint64(1) < weights.max():
        low_w = (1 << nu) - 1
        here = weights > low_w
        rho = 0
        while True:
            low_r = (1 << rho) - 1
            pick = np.flatnonzero(here & (limit[row] > low_r))
            if not len(pick):
                break
            region = mix(elements[pick] + _times(_C1, 1 + nu * 64 + rho))
            # Cells: 2**rho slices of the weights by 2**nu of the ranks, all of area one.
            step = max(1, CELLS // len(pick))
            for begin in range(0, 1 << (rho + nu), step):
                piece = np.arange(begin, min(begin + step, 1 << (rho + nu)))
                w0 = low_w + (1 << nu) * (piece & ((1 << rho) - 1)) / (1 << rho)
                r0 = low_r + (1 << rho) * (piece >> rho) / (1 << nu)
                near = (weights[pick][:, None] > w0) & (limit[row[pick]][:, None] > r0)
                i, c = np.nonzero(near)
                cell = mix(region[i] + _C2 * (piece[c] + 1).astype(np.uint64))
                which, w0, r0, number = pick[i], w0[c], r0[c], _unit(cell)
                for dart in range(len(_MORE)):
                    # `number` says how many darts the cell has: more than `dart` if it is below that probability.
                    on = np.flatnonzero(number < _MORE[dart])
                    if not len(on):
                        break
                    cell, which, number, w0, r0 = cell[on], which[on], number[on], w0[on], r0[on]
                    name = mix(cell + _times(_C3, dart + 1))
                    rank = r0 + (1 << rho) / (1 << nu) * _unit(mix(name + _C2))
                    low = np.flatnonzero(rank < limit[row[which]])
                    place = mix(name[low] + _C1) & np.uint64(0xFFFFFFFF)
                    weight = w0[low] + (1 << nu) / (1 << rho) * (place.astype(np.float64) * 2.0**-32)
                    good = low[weight < weights[which[low]]]
                    if len(good):
                        yield row[which[good]], name[good], rank[good]
            rho += 1
        nu += 1


def signatures(elements: np.ndarray, weights: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """DartMinHash of each row's weighted elements: n_rows by k dart names (0 where a row has no elements).

    An element that is listed twice in a row counts once, with its larger weight.
    """
    out = np.zeros((n_rows, k), np.uint64)
    total = np.bincount(row, weights, minlength=n_rows)
    darts = k * math.log(k) + 2 * k
    with np.errstate(divide="ignore"):
        limit = np.where(total > 0, darts / total, 0)
    todo = total > 0
    while todo.any():
        best = np.full(n_rows * k, np.inf)
        name = np.zeros(n_rows * k, np.uint64)
        use = todo[row]
        for r, dart, rank in _throw(elements[use], weights[use], row[use], limit):
            at = r * k + (mix(dart + _C3) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, at, rank)
            least = rank == best[at]
            name[at[least]] = dart[least]
        full = todo & np.isfinite(best.reshape(n_rows, k)).all(1)
        out[full] = name.reshape(n_rows, k)[full]
        todo &= ~full
        limit = limit * 2  # some coordinate is empty: look at ranks twice as high
    return out



def _weighed(words: Words, size: int, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, weights (1, or the number of times in the row) and rows."""
    element, row = shingles(words, words.hashes(lower=True), size)
    if not counted or not len(element):
        return element, np.ones(len(element)), row
    order = np.lexsort((element, row))
    element, row = element[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (element[1:] != element[:-1]) | (row[1:] != row[:-1]))))
    return element[new], np.diff(np.concatenate((new, [len(element)]))).astype(float), row[new]


def _sign(size: int, n_bands: int, band: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in rows_by_bytes(batch, "text"):
                words = Words(data, offsets)
                element, weight, row = _weighed(words, size, counted)
                signed = signatures(element, weight, row, len(rows), n_bands * band)
                bands = np.zeros((len(rows), n_bands), np.uint64)
                for i in range(band):
                    bands = mix(bands + _C1 + signed[:, i::band][:, :n_bands])
                bands = mix(bands + np.arange(n_bands, dtype=np.uint64) * _C2)
                hashes = words.hashes(lower=True)
                start, end = words.first[:-1], words.first[1:]
                copy = [run_hash(prefix_hash(h, RUN), start, end).view(np.int64) for h in (hashes, mix(hashes + _C3))]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("key"),
                        pa.array(copy[0]),
                        pa.array(copy[1]),
                        pa.array(words.count, pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(rows) + 1) * n_bands, pa.int32()), pa.array(bands.ravel().view(np.int64))
                        ),
                    ],
                    names=["key", "copy1", "copy2", "n_words", "bands"],
                )

    return run


def _sets(size: int, counted: bool):
    """Each text's distinct elements; one of weight n is n different ones, so that the sets' Jaccard similarity is the weighted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in rows_by_bytes(batch, "text"):
                element, weight, row = _weighed(Words(data, offsets), size, counted)
                if counted:
                    n = weight.astype(np.int64)
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    element, row = mix(np.repeat(element, n) + _C2 * nth.astype(np.uint64)), np.repeat(row, n)
                order = np.lexsort((element, row))
                element, row = element[order], row[order]
                if len(element):
                    new = np.concatenate(([True], (element[1:] != element[:-1]) | (row[1:] != row[:-1])))
                    element, row = element[new], row[new]
                ends = pa.array(np.searchsorted(row, np.arange(len(rows) + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(element.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column("key"), lists], names=["key", "elements"])

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A signature of SKETCH coordinates of each set, two bits each, 32 to a long."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            rows = batch.slice(i, 64)
            lists = rows.column("elements")
            element = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
            signed = signatures(element, np.ones(len(element)), row, len(rows), SKETCH)
            bits = (mix(signed + _C2) & np.uint64(3)).reshape(len(rows), -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
            packed = np.bitwise_or.reduce(bits, axis=2).view(np.int64)
            ends = pa.array(np.arange(len(rows) + 1) * packed.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.ListArray.from_arrays(ends, pa.array(packed.ravel()))], names=["key", "sketch"])


def _least_agreement(threshold: float, n: int, sigmas: float) -> int:
    """Of ``n`` coordinates, how many must agree; a pair at the threshold lies below with the chance of so many standard deviations."""
    expected = threshold + (1 - threshold) / 4
    return math.ceil(n * expected - sigmas * math.sqrt(n * expected * (1 - expected)))


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many coordinates each pair of sketches agrees."""
    d = x ^ y
    apart = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)
    return 32 * x.shape[1] - apart


def _near(threshold: float):
    """Pairs of a pack of whole buckets, or of two blocks of a large one: of different classes, met here first, with sketches alike.

    A member that asks is compared with those that do not, and with the asking ones of greater key.
    """
    words = GLANCE // 32
    glance, least = _least_agreement(threshold, GLANCE, 5), _least_agreement(threshold, SKETCH, 4)

    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        bucket, key, label, asks, side = (column[c].to_numpy(zero_copy_only=False) for c in ("bucket", "key", "label", "asks", "side"))
        band = column["band"].to_numpy()
        bands = column["bands"].flatten().to_numpy().reshape(len(key), -1)
        sketch = column["sketch"].flatten().to_numpy().view(np.uint64).reshape(len(key), -1)
        head = np.ascontiguousarray(sketch[:, :words])
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        out = []
        for rows in np.split(order, cuts):
            left, right = rows[asks[rows] & (side[rows] != 1)], rows[side[rows] != 0]
            for i in range(0, len(left), 64):
                x = left[i : i + 64]
                a, b = np.nonzero((~asks[right] | (key[right] > key[x][:, None])) & (label[right] != label[x][:, None]))
                a, b = x[a], right[b]
                for j in range(0, len(a), 1 << 15):
                    p, q = a[j : j + (1 << 15)], b[j : j + (1 << 15)]
                    like = _agree(head[p], head[q]) >= glance
                    p, q = p[like], q[like]
                    like = _agree(sketch[p], sketch[q]) >= least
                    p, q = p[like], q[like]
                    met = (bands[p] == bands[q]).argmax(1) == band[p]
                    out.append((key[p[met]], key[q[met]]))
        x, y = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return run


def _pairs(rows: DataFrame, begin: float, end: float, threshold: float) -> DataFrame:
    """Pairs to verify among the members of each bucket in ``rows``: of those placed in [begin, end) by hash and all placed there or later."""
    place, last = F.pmod(F.xxhash64("key", "bucket"), F.lit(1 << 30)) / float(1 << 30) * F.col("size"), end == math.inf
    rows = rows.where(place >= begin).withColumn("asks", F.lit(True) if last else place < end)
    packs = max(1, rows.count() // 2048)
    large = F.col("size") > BLOCK
    few = rows.where(~large).select(
        F.lit(False).alias("large"), F.pmod(F.xxhash64("bucket"), F.lit(packs)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), *rows.columns
    )
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    blocks = F.least(blocks, F.lit(MAX_BLOCKS)) if last else blocks
    own = F.pmod(F.xxhash64("key"), blocks.cast("long")).cast("int")
    many = rows.where(large).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)) if last else F.lit(0))
    one, given = (F.lit(True).alias("large"), F.col("bucket").alias("g")), [c for c in rows.columns if c != "asks"]
    if last:  # block i meets block j in the cell (i, j) with i up to j, where those of i ask
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        cells = many.select(*one, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), *given, (F.col("own") <= F.col("other")).alias("asks"))
    else:  # the asking ones go to all blocks
        every = rows.where(large & F.col("asks")).select(*one, F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(0).alias("side"), *given, "asks")
        cells = many.select(*one, F.lit(0).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *given, "asks").unionByName(every)
    return few.unionByName(cells).groupBy("large", "g", "i", "j").applyInArrow(_near(threshold), "x long, y long")


def near_dedup(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    n_bands: int = 25,
    band: int = 5,
    weighting: str = "set",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The near-duplicate class of each row of ``docs``: ``doc_id``, ``class_id``, ``class_size``, ``n_links``, ``kept`` and ``key``.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z
    lower-cased; a text's elements are its runs of ``shingle`` words, or the
    whole of a shorter text. ``weighting`` is "set" (each element weighs 1) or
    "count" (as often as it occurs). A class holds the documents linked,
    directly or through others, by a weighted Jaccard similarity of
    ``threshold`` or more; ``class_id`` is its least id and that row is kept.
    ``n_links`` counts the links that were found to other different texts;
    texts that are the same words are one and need no link. ``key`` is
    ``xxhash64`` of id and text, to find the row again.

    At the threshold itself, 25 bands of 5 miss a pair with a chance of 5e-5,
    and the sketches that are compared before the shingles with one of 4e-5
    (that it is taken to share an earlier band, by 32 bits: 6e-9).
    Documents without words (null or empty too) are each their own class. Of
    rows with the same id and text one is kept; a null id counts as smallest.
    An empty table gives an empty result.
    """
    if weighting not in ("set", "count"):
        raise ValueError("weighting must be set or count")
    small_batches(docs.sparkSession)
    counted = weighting == "count"
    source = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed_schema = "key long, doc_id {}, row long, copy1 long, copy2 long, n_words long, bands array<long>".format(docs.schema[id_col].dataType.simpleString())
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    signed = materialise(numbered.mapInArrow(_with_columns(_sign(shingle, n_bands, band, counted), ["doc_id", "row"]), signed_schema), "signed")

    # Texts of the same words are one node, named by the key of its least row.
    worded = signed.where("n_words > 0")
    first = F.min(F.struct("doc_id", "row", "key", "bands")).alias("first")
    nodes = materialise(worded.groupBy("copy1", "copy2").agg(first).select("copy1", "copy2", "first.key", "first.bands"), "nodes")
    bands = nodes.select("key", F.posexplode("bands").alias("band", "bucket"))
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("leader")).where("size > 1")
    # One row a document, with its buckets (n_bands at most); those that are its own alone are left out.
    bucket = F.struct("band", "bucket", "size", "leader")
    members = materialise(bands.join(buckets, "bucket").groupBy("key").agg(F.collect_list(bucket).alias("buckets")), "members")
    asked = members.select("key")
    sets = Bitmap(asked, "key").filter(source.select("key", "text"), "key").join(asked, "key", "left_semi")
    sets = sets.mapInArrow(_sets(shingle, counted), "key long, elements array<long>")
    sets = materialise(sets.dropDuplicates(["key"]), "shingle-sets")

    labels = asked.select("key", F.col("key").alias("label"))
    checked = links = sketches = None
    for begin, end in zip((None, 0.0, *ROUNDS), (None, *ROUNDS), strict=False):
        if begin is None:
            pairs = members.select(F.col("key").alias("y"), F.explode("buckets.leader").alias("x")).where("x <> y")
        else:
            in_bucket = members.join(labels, "key").select("key", "label", F.inline("buckets"))
            # A bucket goes on while it has two classes; the bitmap may let others pass, which then give no pairs.
            split = in_bucket.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
            mixed = Bitmap(split, "bucket").filter(in_bucket.where((F.col("key") != F.col("leader")) & (F.col("size") > begin)), "bucket")
            mixed = materialise(mixed.groupBy("key", "label").agg(F.collect_list(bucket).alias("buckets")), "mixed")
            members = mixed.select("key", "buckets")
            if not members.limit(1).count():
                break
            if sketches is None:
                short = nodes.select("key", F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("bands"))
                sketches = sets.join(members.select("key"), "key").mapInArrow(_sketch, "key long, sketch array<long>")
                sketches = materialise(sketches.join(short, "key"), "sketches")
            rows = mixed.join(sketches, "key").select("key", "label", "sketch", "bands", F.inline("buckets")).drop("leader")
            pairs = _pairs(rows, begin, end, threshold)
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        found = materialise(_verified(pairs, sets, threshold), "compared")
        checked = found.select("a", "b") if checked is None else checked.unionByName(found.select("a", "b"))
        new = found.where("linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        if new.limit(1).count():
            moved = components(
                new.join(labels.select(F.col("key").alias("a"), F.col("label").alias("la")), "a")
                .join(labels.select(F.col("key").alias("b"), F.col("label").alias("lb")), "b")
                .select(F.col("la").alias("a"), F.col("lb").alias("b"))
            ).withColumnRenamed("label", "to")
            labels = materialise(
                labels.join(moved, labels["label"] == moved["node"], "left").select("key", F.coalesce("to", "label").alias("label")), "labels"
            )
    n_links = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    named = materialise(
        nodes.select("copy1", "copy2", "key").join(labels, "key", "left").join(n_links, "key", "left")
        .select("copy1", "copy2", F.coalesce("label", "key").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes"
    )
    rows = materialise(worded.select("doc_id", "row", "key", "copy1", "copy2").join(named, ["copy1", "copy2"]).select("doc_id", "row", "key", "label", "n_links"), "class-rows")
    least = materialise(rows.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size")), "class-firsts")
    classed = rows.join(least, "label").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_links", (F.col("row") == F.col("first.row")).alias("kept"), "key"
    )
    alone = signed.where("n_words = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "key"
    )
    return classed.unionByName(alone)


def _with_columns(run, names: list[str]):
    """Put passed-through columns after the key; ``run`` yields slices in the order of the input."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for made in run(iter([batch])):
                own = batch.slice(at, made.num_rows)
                at += made.num_rows
                columns = [made.column(0), *(own.column(n) for n in names), *made.columns[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=[made.schema.names[0], *names, *made.schema.names[1:]])

    return out


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Each pair with its exact similarity and whether that links it."""
    side = lambda s: sets.select(F.col("key").alias(s), F.col("elements").alias(f"elements_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("elements_a", "elements_b"))
    similarity = common / (F.size("elements_a") + F.size("elements_b") - common)
    return both.select("a", "b", similarity.alias("similarity")).withColumn("linked", F.col("similarity") >= threshold)
