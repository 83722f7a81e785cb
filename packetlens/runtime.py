"""Materialised intermediates on storage that every executor shares.

Iterative operators cut their lineage by writing a table into the folder named by
``spark.checkpoint.dir``; the files survive the loss of any executor.  Only where that
setting is absent and the master is one machine (tests) a temporary folder is made; on a
cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediates: ``spark.checkpoint.dir`` if set, else one of our own."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master or ""):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="packetlens-")
    return _local_dir


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through the Hadoop file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/packetlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._packetlens_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` once nothing reads it any more."""
    path = getattr(df, "_packetlens_path", None)
    if path:
        delete_path(df.sparkSession, path)
        _written[:] = [(s, p) for s, p in _written if p != path]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session may already be gone
            pass


def micros(df: DataFrame, name: str):
    """Microseconds since 1970 of a timestamp column, with or without zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(f"`{name}`"))
