"""Distances between the value distributions of two groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.operators.weights import ESTIMATORS, by_estimator

MASSES = tuple(ESTIMATORS.values())


def magnitude_bucket(value: Column) -> Column:
    """A monotone coarse bucket of a number (eighth octaves), for two-level running sums."""
    size = F.floor(F.log2(F.abs(value.cast("double")) + 1) * 8).cast("int")
    return F.when(value < 0, -size).otherwise(size)


def running_sums(df: DataFrame, *, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Running sums ``<value>_cum`` along ``order`` (unique within ``keys``) in two levels: inside
    coarse buckets, and over the buckets' sums, so a long group is spread over many tasks."""
    b = df.withColumn("__b", magnitude_bucket(F.col(order)))
    sums = b.groupBy(*keys, "__b").agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__b", *[F.coalesce(F.sum(f"__s_{v}").over(w), F.lit(0.0)).alias(f"__p_{v}") for v in values])
    inner = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(sums, [*keys, "__b"]).select("*", *[(F.col(f"__p_{v}") + F.sum(v).over(inner)).alias(f"{v}_cum") for v in values])
    return out.drop("__b", *[f"__p_{v}" for v in values])


def signed_masses(
    shares: DataFrame,
    pairs: DataFrame,
    *,
    side: str,
    keys: Sequence[str],
    value: str = "value",
    masses: Sequence[str] = MASSES,
    totals: Sequence[str] = (),
) -> DataFrame:
    """Left minus right mass of every value of each pair of groups, by estimator.

    ``pairs`` has ``pair_id, left_side, right_side`` and is as small as the number of
    configurations squared; ``side`` is the column of ``shares`` they name; ``keys`` are the
    columns both sides must agree in.  Pairs join value histograms, never observations.
    ``lo`` and ``hi`` tell which sides hold the value; ``totals`` of both sides go along as
    ``left_<total>`` and ``right_<total>``.
    """
    ends = pairs.select(
        "pair_id",
        F.inline(
            F.array(
                F.struct(F.col("left_side").alias(side), F.lit(1).alias("sign")),
                F.struct(F.col("right_side").alias(side), F.lit(-1).alias("sign")),
            )
        ),
    )
    both = [F.max(F.when(F.col("sign") == n, F.col(t))).alias(f"{end}_{t}") for t in totals for end, n in (("left", 1), ("right", -1))]
    return shares.join(ends, side).groupBy("pair_id", *keys, F.col(value).alias("value")).agg(
        *[F.sum(F.col(m) * F.col("sign")).alias(m) for m in masses], F.min("sign").alias("lo"), F.max("sign").alias("hi"), *both
    )


def _clamped(df: DataFrame, keys: Sequence[str], masses: Sequence[str]) -> DataFrame:
    """Distances by estimator, within 0..1, of pairs that have both sides."""
    rows = df.where("lo = -1 and hi = 1").select(
        *keys, *[F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(m))).alias(m) for m in masses]
    )
    return by_estimator(rows, keep=keys, out="distance", masses=masses)


def weighted_ks(diff: DataFrame, *, keys: Sequence[str], masses: Sequence[str] = MASSES, carry: Sequence[str] = ()) -> DataFrame:
    """Largest gap between the two distribution functions (right-continuous).

    Running sums go bucket by bucket of the value; each bucket keeps its total and the extremes
    of its inner running sum, and the second level runs over those few rows only.  ``carry``
    are columns to keep, alike in all rows of a key or NULL."""
    k = ["pair_id", *keys]
    b = diff.withColumn("__b", magnitude_bucket(F.col("value")))
    w = Window.partitionBy(*k, "__b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inner = b.select(*k, "__b", "lo", "hi", *carry, *masses, *[F.sum(m).over(w).alias(f"{m}_c") for m in masses])
    ends = [f(c).alias(n) for m in masses for f, c, n in ((F.sum, m, f"{m}_s"), (F.min, f"{m}_c", f"{m}_n"), (F.max, f"{m}_c", f"{m}_x"))]
    held = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max(c).alias(c) for c in carry]]
    buckets = inner.groupBy(*k, "__b").agg(*ends, *held)
    over = Window.partitionBy(*k).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.select("*", *[F.coalesce(F.sum(f"{m}_s").over(over), F.lit(0.0)).alias(f"{m}_b") for m in masses])
    top = before.groupBy(*k).agg(
        *[F.max(F.greatest(F.abs(F.col(f"{m}_b") + F.col(f"{m}_n")), F.abs(F.col(f"{m}_b") + F.col(f"{m}_x")))).alias(m) for m in masses],
        *held,
    )
    return _clamped(top, [*k, *carry], masses)


def total_variation(diff: DataFrame, *, keys: Sequence[str], masses: Sequence[str] = MASSES, carry: Sequence[str] = ()) -> DataFrame:
    """Half the sum of absolute mass differences; ``carry`` as in :func:`weighted_ks`."""
    k = ["pair_id", *keys]
    half = diff.groupBy(*k).agg(
        *[(F.sum(F.abs(m)) * 0.5).alias(m) for m in masses], F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max(c).alias(c) for c in carry]
    )
    return _clamped(half, [*k, *carry], masses)
