"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest in the session's
catalogue. A batch of documents is reduced to its distinct digests, an
anti-join against the index (sort-merge: the index side is neither shuffled
nor, in one-file buckets, sorted) leaves the digests that are new, and these
are appended. A large table may be brought to the index in parts, those of the
largest ids first, so that what one append sorts is bounded and what an earlier
part has stored is met by the anti-join of the later ones. Only DataFrame
functions are used.

Texts are equal when identical after A-Z are lower-cased; null is the empty
text.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgraph.llm.shared import delete, materialise, new_path


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


class DigestIndex:
    """A persistent set of text digests.

    ``table`` has one row for each digest ever kept: ``digest`` (SHA-256),
    ``keep_id`` (the document that stays) and ``batch`` (the batch that
    brought it). ``n_buckets`` is fixed when the table is made; it defaults
    to the session's number of shuffle partitions. The table lies in ``path``,
    or in the session's warehouse where that is not given.

    A batch may be run again under its own name after a failure: digests that
    it has appended already count as its own, so the outcome is the same.
    """

    def __init__(self, spark: SparkSession, table: str, n_buckets: int | None = None, path: str | None = None):
        self.spark, self.table, self.path = spark, table, path
        self.n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._recover()

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def _recover(self) -> None:
        """Finish or undo a compaction that lost its driver: at any moment one of its tables is whole."""
        has = {name: self.spark.catalog.tableExists(name) for name in (self.table, f"{self.table}_compact", f"{self.table}_old")}
        if not has[self.table]:  # the old table moves away only when the compact one is whole
            whole = next((name for name in (f"{self.table}_compact", f"{self.table}_old") if has[name]), None)
            if whole is None:
                return
            self.spark.sql(f"ALTER TABLE {whole} RENAME TO {self.table}")
            has[whole] = False
        for name in (f"{self.table}_compact", f"{self.table}_old"):
            if has[name]:
                self.spark.sql(f"DROP TABLE {name}")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _append(self, rows: DataFrame) -> None:
        writer = (
            rows.repartition(self.n_buckets, "digest")
            .sortWithinPartitions("digest")
            .write.format("parquet")
            .bucketBy(self.n_buckets, "digest")
            .sortBy("digest")
            .mode("append")
        )
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.path:
            delete(self.spark, self.path)

    def dedup(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int = 1) -> DataFrame:
        """Add the new texts of ``docs`` to the index and say of every row whether it stays.

        Returns one row for each row of ``docs``, dropped ones too: ``doc_id``,
        ``keep_id``, ``group_size`` (rows of this batch with the text),
        ``kept``, ``text_sha256`` and ``key`` (``xxhash64`` of id and text, to find
        the row again). Of equal texts in a batch the row with
        the largest id stays, unless an earlier batch has the text: then none
        does and ``keep_id`` names the earlier document. Of rows with the same
        id and text one stays; a null id counts as smallest. An empty table
        gives an empty result. ``parts`` beyond 1 (for numeric ids) brings
        ``docs`` to the index in so many parts; the result is the same.
        """
        if parts > 1 and not isinstance(docs.schema[id_col].dataType, T.NumericType):
            raise ValueError("parts go by numeric ids")
        batch = batch or uuid.uuid4().hex
        digests = materialise(
            docs.select(
                F.col(id_col).alias("doc_id"),
                F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
                F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        # Copies are counted before the shuffle, so a hot text sends one row a task.
        part = _part(digests, parts).alias("part")
        last = F.max(F.struct("doc_id", "row")).alias("last")
        by_part = materialise(digests.groupBy("digest", part).agg(last, F.count(F.lit(1)).alias("group_size")), "digest-groups")
        for i in range(parts):
            fresh = by_part.where(F.col("part") == i)
            if self.exists():
                fresh = fresh.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
            self._append(fresh.select("digest", F.col("last.doc_id").alias("keep_id"), F.lit(batch).alias("batch")))
        # The part that has the largest id of a text comes first, so the index names that row.
        groups = by_part if parts == 1 else by_part.groupBy("digest").agg(F.max("last").alias("last"), F.sum("group_size").alias("group_size"))
        stays = groups.join(self.read().hint("merge"), "digest").select(
            "digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("last.row")).alias("keep_row")
        )
        # As a table, `stays` has no partitioning of its own: both sides of the join are
        # shuffled, and adaptive execution may split a hot digest's rows.
        return digests.join(materialise(stays, "kept-digests"), "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "key",
        )

    def compact(self) -> None:
        """Rewrite the table with one sorted file a bucket, after many appends; swaps it in by renaming.

        A driver that is lost meanwhile leaves one whole table, which the next :class:`DigestIndex` of the name finds.
        """
        self._recover()
        spare, old = f"{self.table}_compact", f"{self.table}_old"
        path, self.path = self.path, f"{self.path}-{uuid.uuid4().hex}" if self.path else None
        DigestIndex(self.spark, spare, self.n_buckets, self.path)._append(self.read())
        self.spark.sql(f"ALTER TABLE {self.table} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {spare} RENAME TO {self.table}")
        self.spark.sql(f"DROP TABLE {old}")
        if path:
            delete(self.spark, path)


def _part(digests: DataFrame, parts: int) -> Column:
    """The part of each row: 0 for the largest ids, the last one for the smallest and null."""
    out = F.lit(parts - 1)
    if parts > 1:
        shares = [1 - i / parts for i in range(1, parts)]
        bounds = digests.agg(F.percentile_approx("doc_id", shares)).first()[0] or []
        for i, bound in reversed(list(enumerate(bounds))):
            out = F.when(F.col("doc_id") > bound, F.lit(i)).otherwise(out)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 2) -> DataFrame:
    """:meth:`DigestIndex.dedup` against a new index in the shared folder, which is dropped when all is decided.

    ``docs`` comes in ``parts`` (one where ids are not numbers).
    """
    spark, numeric = docs.sparkSession, isinstance(docs.schema[id_col].dataType, T.NumericType)
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", path=new_path(spark, "digest-index"))
    try:
        return index.dedup(docs, id_col=id_col, text_col=text_col, parts=parts if numeric else 1)
    finally:
        index.drop()
