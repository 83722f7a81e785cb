"""Set, key and ordering operators of the audit and of collection manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.runtime import materialize


def numbered(df: DataFrame, *, order: Sequence[str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive numbers from 1 along a total order, of the whole table or (``by``) of every
    key, without sorting a table or a key in one task: rows go to ranges of the order, are
    numbered inside, and the sizes of the ranges are summed."""
    laid = materialize(df.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = laid.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__p").alias("__q"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*order))
    same = [F.col("__p") == F.col("__q"), *[F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]]
    rows = laid.withColumn("__i", inside).join(sizes, reduce(lambda x, y: x & y, same))
    return rows.withColumn(out, (F.col("__before") + F.col("__i")).cast("long")).select(*df.columns, out)


def first_wins(df: DataFrame, *, key: Column, order: Sequence[str], number: str | None = None, prefix: str = "P") -> DataFrame:
    """The first row of every key in ``order`` (which must be total); with ``number`` also an
    id in order of first appearance.  The first row is found by a partially aggregated
    minimum."""
    rows = df.withColumn("__key", key)
    cols = [c for c in df.columns if c not in order]
    best = rows.groupBy("__key").agg(F.min(F.struct(*order, *cols)).alias("r")).select("__key", "r.*")
    if number:
        best = numbered(best, order=order, out=number).withColumn(number, F.format_string(f"{prefix}%05d", number))
    return best.withColumnRenamed("__key", "dedup_key")


def member_flags(df: DataFrame, *, key: str, routes: Mapping[str, DataFrame]) -> DataFrame:
    """One boolean column per route: whether the key is a member."""
    out = df
    for name, ids in routes.items():
        member = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
        out = out.join(member, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def membership_label(flags: Sequence[str]) -> Column:
    """``G | R | P`` style list of the routes that hold."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(f), f) for f in flags])), " | ")


def venn_cells(df: DataFrame, *, flags: Sequence[str]) -> DataFrame:
    """Rows in every exact combination of flags, and their union, in one pass."""
    label = membership_label(flags)
    cells = df.where(reduce(lambda a, b: a | b, [F.col(f) for f in flags]))
    cells = cells.groupBy(label.alias("cell")).agg(F.count(F.lit(1)).alias("records"))
    return cells.unionByName(cells.agg(F.lit("union").alias("cell"), F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("records")))


def two_sided_difference(left: DataFrame, right: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, with the side that lacks them."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    missing = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("unexpected")))


def duplicates(df: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def attempt_lineage(df: DataFrame, *, visit: str, order: Sequence[str], attempt: str, status: str) -> DataFrame:
    """Attempts of each visit with the previous one, and whether the terminal one is accepted."""
    w = Window.partitionBy(visit).orderBy(*order)
    last = F.row_number().over(Window.partitionBy(visit).orderBy(*[F.desc(c) for c in order])) == 1
    return df.select(
        visit, attempt, F.row_number().over(w).alias("attempt_index"), F.lag(attempt).over(w).alias("previous_attempt"),
        last.alias("is_terminal"), (last & (F.col(status) == "accepted")).alias("selected"),
    )


def dense_ids(df: DataFrame, *, value: str, out: str) -> DataFrame:
    """Distinct values with their alphabetical index from 0, numbered by ranges of the values,
    so it does not matter how many of them begin alike."""
    d = df.select(value).where(F.col(value).isNotNull()).distinct()
    return numbered(d, order=[value], out=out).withColumn(out, F.col(out) - 1)
