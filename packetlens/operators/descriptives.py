"""Weighted descriptives, plain summaries, ranks and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.operators.distances import running_sums
from packetlens.operators.weights import ESTIMATORS

#: Cumulative shares this close below a rank count as having reached it (floating-point ties).
TIE = 1e-12


def weighted_quantiles(shares: DataFrame, *, keys: Sequence[str], ranks: Sequence[float], mass: str = "mass") -> DataFrame:
    """Lower inverse distribution function: the first value whose cumulative share reaches a
    rank, without interpolation.  ``shares`` has ``value`` and ``mass`` summing to 1 by key."""
    cum = running_sums(shares, keys=keys, order="value", values=[mass])
    return cum.groupBy(*keys).agg(
        *[F.min(F.when(F.col(f"{mass}_cum") >= r - TIE, F.col("value"))).alias(f"q{round(r * 100):02d}") for r in ranks]
    )


def numeric_descriptives(shares: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Weighted mean, five quantiles, interquartile range, minimum and maximum by key and
    estimator; ``shares`` has ``value`` and a column of shares per estimator, which one pass
    takes side by side."""
    ranks = {r: f"q{round(r * 100):02d}" for r in (0.1, 0.25, 0.5, 0.75, 0.9)}
    cum = running_sums(shares, keys=keys, order="value", values=list(ESTIMATORS.values()))
    found = cum.groupBy(*keys).agg(
        *[F.sum(F.col("value") * F.col(m)).alias(f"{m}_mean") for m in ESTIMATORS.values()],
        *[
            F.min(F.when(F.col(f"{m}_cum") >= r - TIE, F.col("value"))).alias(f"{m}_{n}")
            for m in ESTIMATORS.values() for r, n in ranks.items()
        ],
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )
    both = [
        F.struct(
            F.lit(e).alias("estimator"), F.col(f"{m}_mean").alias("mean"), *[F.col(f"{m}_{n}").alias(n) for n in ranks.values()],
            (F.col(f"{m}_q75") - F.col(f"{m}_q25")).alias("iqr"),
        )
        for e, m in ESTIMATORS.items()
    ]
    return found.select(*keys, "minimum", "maximum", F.inline(F.array(*both)))


def plain_summary(df: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, linear quartiles, interquartile range and maximum of finite values."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), q.alias("__q"), F.max(v).alias("maximum")
    )
    return out.select(
        *keys,
        "count",
        "mean",
        F.col("__q")[1].alias("median"),
        F.col("__q")[0].alias("q25"),
        F.col("__q")[2].alias("q75"),
        (F.col("__q")[2] - F.col("__q")[0]).alias("iqr"),
        "maximum",
    )


def average_ranks(df: DataFrame, *, keys: Sequence[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Ranks from 1, ties sharing the mean of their places."""
    order = F.desc(value) if descending else F.asc(value)
    tied = Window.partitionBy(*keys, value)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, rank + (F.count(F.lit(1)).over(tied) - 1) / 2.0)


def correlation(left: str, right: str) -> Column:
    """Pearson's correlation within -1..1, NULL where a side is constant."""
    r = F.try_divide(F.covar_pop(left, right), F.stddev_pop(left) * F.stddev_pop(right))
    return F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def spearman(df: DataFrame, *, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Rank correlation per key, within -1..1; constant input gives NULL."""
    ranked = average_ranks(average_ranks(df, keys=keys, value=left, out="__x"), keys=keys, value=right, out="__y")
    return ranked.groupBy(*keys).agg(correlation("__x", "__y").alias("rho"))


def longest_runs(df: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """Longest stretch of consecutive integers among each key's distinct values."""
    seen = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    runs = seen.withColumn("__i", island).groupBy(*keys, "__i").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest_run"))


def pivot_measures(df: DataFrame, *, keys: Sequence[str], pivot: str, values: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One column ``<value>_<measure>`` per pivot value, in a fixed order (no extra pass)."""
    cells = [
        F.max(F.when(F.col(pivot) == v, F.col(m))).alias(f"{v}_{m}") for v in values for m in measures
    ]
    return df.groupBy(*keys).agg(*cells)
