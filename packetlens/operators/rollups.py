"""Roll-ups of distances and of three-valued outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTSIDE = "redundant_reported_only"


def stable_round(column, digits: int) -> Column:
    """Round after a nudge far below the last digit, so that exact ties go one way whatever
    the order of summation was."""
    return F.round((F.col(column) if isinstance(column, str) else column) + 3e-11, digits)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, everything else as it is."""
    return df.select(*[stable_round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def family_of(feature: Column, families: Mapping[str, str]) -> Column:
    """Family of a feature; a feature outside every family is only reported."""
    table = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    return F.coalesce(F.try_element_at(table, feature), F.lit(OUTSIDE))


def class_rollup(df: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """Number of classes, mean, median and maximum of their distances."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("classes"), F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("maximum"),
    )


def family_rollup(pair_features: DataFrame, families: Mapping[str, str]) -> DataFrame:
    """Equal-weight mean over the features of each family, with their sorted list."""
    f = pair_features.withColumn("family", family_of(F.col("feature"), families)).where(F.col("family") != OUTSIDE)
    return f.groupBy("pair_id", "contrast", "family").agg(
        *[F.avg(m).alias(m) for m in ("mean", "median", "maximum")],
        F.array_join(F.array_sort(F.collect_set("feature")), ";").alias("features"),
    )


def composite(families: DataFrame, *, parts: int) -> DataFrame:
    """Equal-weight mean over exactly ``parts`` families; incomplete pairs are left out."""
    c = families.groupBy("pair_id", "contrast").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in ("mean", "median", "maximum")]
    )
    return c.where(F.col("n") == parts).drop("n")


def sequential_rollup(units: DataFrame) -> DataFrame:
    """Mean over classes at each supported position, then mean, median and maximum."""
    at = units.where("support_status = 'primary_supported'").groupBy("pair_id", "contrast", "feature", "position").agg(
        F.avg("distance").alias("m")
    )
    return at.groupBy("pair_id", "contrast", "feature").agg(
        F.count(F.lit(1)).alias("positions"), F.avg("m").alias("mean"),
        F.percentile("m", F.lit(0.5)).alias("median"), F.max("m").alias("maximum"),
    )


def sequential_composite(features: DataFrame, *, parts: int) -> DataFrame:
    """Equal-weight mean over exactly ``parts`` features."""
    c = features.groupBy("pair_id", "contrast").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean"), F.avg("median").alias("median")
    )
    return c.where(F.col("n") == parts).drop("n")


def directional_mapping(pairs: DataFrame) -> DataFrame:
    """Directed evaluations of unordered pairs: the first id runs left to right, the second
    right to left; a third raises."""
    ids = F.split("directed_evaluation_ids", ";")
    ok = F.when(F.size(ids) <= 2, ids).otherwise(F.raise_error(F.lit("more than two directed evaluations")))
    rows = pairs.select("pair_id", "contrast", "left_side", "right_side", F.posexplode(ok).alias("n", "evaluation_id"))
    first = F.col("n") == 0
    return rows.select(
        "pair_id", "contrast", "evaluation_id",
        F.when(first, "left_to_right").otherwise("right_to_left").alias("direction"),
        F.when(first, F.col("left_side")).otherwise(F.col("right_side")).alias("source_configuration_id"),
        F.when(first, F.col("right_side")).otherwise(F.col("left_side")).alias("target_configuration_id"),
    )


def scope_sensitivity(wide: DataFrame, *, ranked: Sequence[str]) -> DataFrame:
    """Compare two scopes' summaries per contrast: ``wide`` has ``heldout_`` and ``all_`` means
    and medians per contrast and feature; ties in the top three go by feature name."""
    from packetlens.operators.descriptives import average_ranks, correlation

    inside = wide.where(F.col("feature").isin(*ranked))
    r = average_ranks(inside, keys=["contrast"], value="heldout_median", out="heldout_rank", descending=True)
    r = average_ranks(r, keys=["contrast"], value="all_median", out="all_rank", descending=True)

    def top(c):
        return F.row_number().over(Window.partitionBy("contrast").orderBy(F.desc(c), "feature")) <= 3

    r = r.withColumn("heldout_top3", top("heldout_median")).withColumn("all_top3", top("all_median"))
    rho = r.groupBy("contrast").agg(
        correlation("heldout_rank", "all_rank").alias("rho"),
        F.sum((F.col("heldout_top3") & F.col("all_top3")).cast("long")).alias("top3_overlap"),
    )
    r = r.select("contrast", "feature", "heldout_rank", "all_rank", "heldout_top3", "all_top3")
    out = wide.join(r, ["contrast", "feature"], "left").join(rho, "contrast")
    ratio = F.when(F.col("heldout_median") != 0, F.round(F.col("all_median") / F.col("heldout_median"), 6))
    return out.select(
        "contrast", "feature", "heldout_mean", "all_mean",
        (F.round(F.col("all_mean") - F.col("heldout_mean"), 8) + 0.0).alias("mean_difference"),
        "heldout_median", "all_median",
        (F.round(F.col("all_median") - F.col("heldout_median"), 8) + 0.0).alias("median_difference"),
        ratio.alias("median_ratio"),
        F.when(F.col("heldout_rank").isNull(), "not_ranked").otherwise("ranked").alias("rank_scope"),
        "heldout_rank", "all_rank", F.round("rho", 9).alias("rho"),
        F.coalesce("heldout_top3", F.lit(False)).alias("heldout_top3"),
        F.coalesce("all_top3", F.lit(False)).alias("all_top3"), "top3_overlap",
    )


def outcome_summary(df: DataFrame, *, dimensions: Sequence[str], outcome: str, positive: str, negative: str) -> DataFrame:
    """Total, positive, negative and undocumented rows per dimension, zero where none; the
    total counts every outcome, also unknown ones."""
    counted = df.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum((F.col(outcome) == o).cast("long")).alias(n) for n, o in
          (("positive", positive), ("negative", negative), ("not_documented", "not_documented"))],
    )
    fixed = df.sparkSession.createDataFrame([(d,) for d in dimensions], "dimension string")
    cols = ("total", "positive", "negative", "not_documented")
    return fixed.join(F.broadcast(counted.where(F.col("dimension").isin(*dimensions))), "dimension", "left").select(
        "dimension", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in cols]
    )


def precedence_rollup(df: DataFrame, *, keys: Sequence[str], outcome: str, order: Sequence[str]) -> DataFrame:
    """The first of ``order`` that any member has; members count; NULL outcomes (no member)
    count as the last but one rule says: undocumented, with no member."""
    best = F.lit(order[-1])
    for o in reversed(order[:-1]):
        best = F.when(F.max((F.col(outcome) == o).cast("int")) == 1, o).otherwise(best)
    return df.groupBy(*keys).agg(best.alias("outcome"), F.count(outcome).alias("members"))
