"""Delimited tables with a fixed header, and where they are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class HeaderError(ValueError):
    """The header of a table is not the one its contract names."""


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    row = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').csv(path).limit(1).first()
    if row is None:
        raise HeaderError(f"{path} is empty")
    return [(v or "").removeprefix("﻿") for v in row]


def read_table(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ",",
    exact: Sequence[str] | None = None,
    required: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """An all-string table whose empty fields are '' (never NULL), compressed or not.

    ``exact`` asks for this very header, ``required`` for a part of it; a leading ``?`` of a
    column name is dropped.  Doubled quotes and line breaks inside fields are read, a byte
    order mark is not part of the header, rows of another width raise when they are read.
    Compressed files cannot be split; ``partitions`` spreads their rows right after reading.
    """
    header = [h.removeprefix("?") for h in _header(spark, path, sep)]
    if len(set(header)) != len(header):
        raise HeaderError(f"{path}: repeated column")
    if exact is not None and list(exact) != header:
        raise HeaderError(f"{path}: expected {list(exact)}, found {header}")
    if missing := [r for r in required if r not in header]:
        raise HeaderError(f"{path}: missing {missing}")
    schema = StructType([StructField(h, StringType()) for h in header])
    reader = spark.read.schema(schema).option("header", "true").option("sep", sep).option("multiLine", "true")
    df = reader.option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", "true").csv(path)
    df = df.na.fill("")
    return df.repartition(partitions) if partitions else df


def write_table(df: DataFrame, path: str, *, fields: Sequence[str], order: Sequence[str] = (), overwrite: bool = False, one_file: bool = False) -> None:
    """Fixed columns, missing values as '', rows in ``order``; without ``overwrite`` an existing
    table or an unexpected column raises.  One file per task, in order of their names; a single
    file, which one task has to write, must be asked for."""
    if not overwrite and (extra := set(df.columns) - set(fields)):
        raise ValueError(f"unexpected columns {sorted(extra)}")
    cols = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    out = (df.orderBy(*order) if order else df).select(*cols)
    out = out.coalesce(1) if one_file else out
    writer = out.write.mode("overwrite" if overwrite else "errorifexists").option("header", "true").option("escape", '"')
    writer.option("emptyValue", "").option("lineSep", "\n").csv(path)


def row_count(spark: SparkSession, path: str) -> int | None:
    """Rows without the header, or None for anything but a CSV file."""
    if not path.endswith((".csv", ".csv.gz")):
        return None
    return read_table(spark, path).count()


def token_hits(spark: SparkSession, folder: str, tokens: Sequence[str]) -> DataFrame:
    """Files of a text tree that contain a token in any letter case: ``path, token``."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.lower("value").alias("t"))
    wanted = F.array(*[F.lit(t.lower()) for t in tokens])
    files = files.where(~F.col("path").rlike(r"\.(gz|pyc)$"))
    return files.select("path", F.explode(F.filter(wanted, lambda x: F.contains(F.col("t"), x))).alias("token"))
