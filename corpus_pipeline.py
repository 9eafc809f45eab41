"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), where ``docs`` has the columns of
``documents``, and returns a frame that is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgraph.llm import quality
from sparkgraph.llm.decontaminate import decontaminate
from sparkgraph.llm.exact_dedup import exact_dedup
from sparkgraph.llm.near_dedup import near_dedup
from sparkgraph.llm.queries import bpe_digest
from sparkgraph.llm.shared import materialise
from sparkgraph.llm.substring_dedup import Bitmap


def _only(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (key, kept) keeps; of rows of the same id and text it keeps one or all.

    Texts of rows whose key was never dropped are not moved: a bitmap lets them
    pass, and only the others are joined.
    """
    judged = materialise(judged.select("key", "kept"), "judged")
    kept, dropped = judged.where("kept").select("key").distinct(), judged.where("NOT kept").select("key").distinct()
    key = _free(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    bitmap = Bitmap(dropped, "key")
    near = bitmap.filter(keyed, key)
    gone = dropped.join(kept, "key", "left_anti").withColumnRenamed("key", "gone_key")
    near = near.join(gone, near[key] == gone["gone_key"], "left_anti")
    twice = dropped.join(kept, "key", "left_semi").withColumnRenamed("key", "twice_key")
    if twice.limit(1).count():  # the same id and text in several rows, of which one stays
        same = near[key] == twice["twice_key"]
        near = near.join(twice, same, "left_anti").unionByName(near.join(twice, same, "left_semi").dropDuplicates([key]))
    return bitmap.filter(keyed, key, inside=False).unionByName(near).drop(key)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` has not."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality or the toxicity scorer rejects."""
    scorer = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = _free(docs, "verdict")
    return quality.score(docs, scorer, out_col=verdict).where(f"{verdict}.kept").drop(verdict)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text, A-Z and a-z taken as equal."""
    return _only(docs, exact_dedup(docs.select("doc_id", "text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return _only(docs, near_dedup(docs.select("doc_id", "text")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold too much of a benchmark item."""
    verdict = _free(docs, "verdict")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col=verdict)
    return found.where(f"NOT {verdict}.contaminated").drop(verdict)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digest(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: The classifier's fitted weights and the tokenizer's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
