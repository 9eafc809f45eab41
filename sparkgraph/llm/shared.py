"""Places that the driver and all executors see.

Intermediate tables go under the folder that the session names in
``spark.checkpoint.dir``; only where that is unset (tests, local runs) a
temporary folder is taken instead.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}
_paths: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path that Spark accepts."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sparkgraph-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends, or by :func:`release`."""
    path = f"{shared_dir(spark)}/sparkgraph/{label}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; this cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this session; frames that read them are void afterwards."""
    for entry in [e for e in _paths if e[0] is spark]:
        delete(spark, entry[1])
        _paths.remove(entry)


@atexit.register
def _clean() -> None:
    for spark, path in _paths:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def local_path(uri: str) -> str | None:
    """The plain path of a ``file:`` URI or bare path, else None."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of 1,000 rows, where the session has the default of 10,000.

    A batch is held on both sides at once; whole texts are thousands of bytes each.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def text_bytes(df: DataFrame, column: str) -> int:
    """About how many bytes a column of texts has: by the optimiser's file sizes, or counted where it knows none."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


_KINDS = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def flat_schema(text: str) -> T.StructType:
    """A schema of simple columns from "name kind, ..."; unlike DDL it needs no session, so workers can import it."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(","))])
