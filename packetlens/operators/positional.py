"""Shifts by packet position: contributors, distances, summaries and persistence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.operators.descriptives import plain_summary
from packetlens.operators.rollups import stable_round

SUPPORTED, LOW = 10, 2


def contributors(df: DataFrame, *, group: Sequence[str], session: str, position: str, k: int) -> DataFrame:
    """Sessions present at each position 1..k of each group, zero where none is."""
    whole = df.groupBy(*group).agg(F.countDistinct(session).alias("sessions_in_group"))
    at = df.where(F.col(position).between(1, k)).groupBy(*group, position).agg(F.countDistinct(session).alias("n"))
    grid = whole.withColumn(position, F.explode(F.sequence(F.lit(1), F.lit(k))))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return grid.join(at, [*group, position], "left").select(
        *group, position, "sessions_in_group", n.alias("contributing_sessions"),
        (n / F.col("sessions_in_group")).alias("contributor_fraction"),
    )


def unit_distances(
    df: DataFrame,
    pairs: DataFrame,
    *,
    group: Sequence[str],
    side: str,
    session: str,
    position: str,
    k: int,
    numeric: Mapping[str, Column],
    categorical: Mapping[str, Column],
) -> DataFrame:
    """Distance of every pair, class, position 1..k and feature, every session weighing the
    same at a position.  Fewer than two sessions on a side give no distance.

    Value counts by group and position are made once; pairs join those counts.
    """
    other = [g for g in group if g != side]
    features = [*numeric, *categorical]
    base = df.where(F.col(position).between(1, k))
    named = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                (c.cast("long") if n in numeric else F.lit(None).cast("long")).alias("num"),
                (F.lit(None).cast("string") if n in numeric else c.cast("string")).alias("cat"),
            )
            for n, c in {**numeric, **categorical}.items()
        ]
    )
    long = base.select(*group, position, F.col(session).alias("session"), F.inline(named)).where("num is not null or cat is not null")
    key = [*group, position, "feature"]
    counts = long.groupBy(*key, "num", "cat").agg(F.count(F.lit(1)).alias("n"))
    # Sessions first, which lie together already, then their number: no row is expanded.
    total = long.groupBy(*key, "session").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("total")
    )
    mass = counts.join(total.drop("sessions"), key).withColumn("mass", F.col("n") / F.col("total"))
    ends = pairs.select(
        "pair_id",
        F.inline(
            F.array(
                F.struct(F.col("left_side").alias(side), F.lit(1.0).alias("sign")),
                F.struct(F.col("right_side").alias(side), F.lit(-1.0).alias("sign")),
            )
        ),
    )
    unit = ["pair_id", *other, position, "feature"]
    diff = mass.join(ends, side).groupBy(*unit, "num", "cat").agg(F.sum(F.col("mass") * F.col("sign")).alias("dm"))
    w = Window.partitionBy(*unit).orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    gaps = diff.withColumn("gap", F.sum("dm").over(w))
    is_num = F.col("feature").isin(*numeric) if numeric else F.lit(False)
    dist = gaps.groupBy(*unit).agg(
        F.when(is_num, F.max(F.abs("gap"))).otherwise(F.sum(F.abs("dm")) * 0.5).alias("distance")
    ).withColumn("distance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("distance"))))

    present = df.select(*group).distinct()
    left = pairs.join(present, pairs["left_side"] == present[side]).drop(side)
    right = present.select(F.col(side).alias("right_side"), *other)
    grid = left.join(right, ["right_side", *other], "left_semi")
    grid = grid.withColumn(position, F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn(
        "feature", F.explode(F.array(*[F.lit(f) for f in features]))
    )

    def support(which):
        return total.select(F.col(side).alias(f"{which}_side"), *other, position, "feature", F.col("sessions").alias(which))

    on = [*other, position, "feature"]
    full = grid.join(support("left"), ["left_side", *on], "left").join(support("right"), ["right_side", *on], "left")
    full = full.join(dist, unit, "left")
    zero = F.lit(0).cast("long")
    lo, hi = F.coalesce("left", zero), F.coalesce("right", zero)
    least = F.least(lo, hi)
    status = F.when(least < LOW, "insufficient").when(least >= SUPPORTED, "primary_supported").otherwise("low_support")
    return full.select(
        "pair_id", "contrast", *other, position, "feature",
        F.when(is_num, "ks").otherwise("total_variation").alias("distance_statistic"),
        F.when(least >= LOW, F.col("distance")).alias("distance"),
        lo.alias("left_contributing_sessions"), hi.alias("right_contributing_sessions"),
        least.alias("minimum_contributing_sessions"), status.alias("support_status"),
        (status == "primary_supported").alias("included_in_primary_summary"),
    )


def position_summary(units: DataFrame, *, digits: int) -> DataFrame:
    """Summary of the supported distances at each feature, contrast and position."""
    keys = ["feature", "contrast", "position"]
    ok = units.where("support_status = 'primary_supported'")
    s = plain_summary(ok, keys=keys, value="distance")
    arms = ok.groupBy(*keys).agg(
        F.min("minimum_contributing_sessions").alias("minimum_sessions_per_arm"),
        F.percentile("minimum_contributing_sessions", F.lit(0.5)).alias("median_minimum_sessions_per_arm"),
    )
    measures = ("mean", "median", "q25", "q75", "iqr", "maximum")
    return s.select(*keys, "count", *[stable_round(m, digits).alias(m) for m in measures]).join(arms, keys)


def persistence(summary: DataFrame, *, thresholds: Sequence[float]) -> DataFrame:
    """Per feature, contrast and threshold: how many supported positions reach it, the longest
    consecutive run of them, and their list."""
    keys = ["feature", "contrast", "threshold"]
    rows = summary.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    rows = rows.withColumn("hit", F.col("median") >= F.col("threshold"))
    w = Window.partitionBy(*keys, "hit").orderBy("position")
    rows = rows.withColumn("island", F.when(F.col("hit"), F.col("position") - F.row_number().over(w)))
    runs = rows.where("hit").groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("run"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("supported_positions"),
        F.sum(F.col("hit").cast("long")).alias("positions_at_or_above_threshold"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("position")))).cast("array<string>"), ";").alias("qualifying_positions"),
    )
    return out.join(runs, keys, "left").select(
        *keys, "supported_positions", "positions_at_or_above_threshold",
        F.round(F.col("positions_at_or_above_threshold") / F.col("supported_positions"), 9).alias("fraction_at_or_above_threshold"),
        F.coalesce("run", F.lit(0).cast("long")).alias("longest_consecutive_run"), "qualifying_positions",
    )
