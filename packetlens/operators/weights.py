"""Observation weights and value masses of groups, for both estimators in one pass.

``packet_pooled`` gives every observation the same weight; ``session_balanced`` gives every
session the same weight, divided evenly among its observations.  Weights are taken after the
stratum, the feature and missing values have been settled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: estimator -> its column of masses
ESTIMATORS = {"session_balanced": "balanced", "packet_pooled": "pooled"}


def value_masses(
    df: DataFrame,
    *,
    group: Sequence[str],
    session: str,
    features: Mapping[str, Column],
    direction: str | None = None,
    whole: bool = True,
    labels: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Mass of every value of a group, feature and stratum: ``balanced`` (sums to the number of
    sessions) and ``pooled`` (sums to the number of observations).

    Strata are ``all`` (with ``whole``) and, with ``direction``, each direction of its own; NULL
    values take no part.  ``labels`` are features of text, for stratum ``all`` only; with them
    there is a column ``label`` beside ``value``.  In-session counts of all features are
    windows over rows that lie by session; only then are features laid out in rows, which the
    next aggregation takes in before its exchange.  ``features`` must be of one type.
    """
    labels = labels or {}
    f = [f"__f{i}" for i in range(len(features))]
    t = [f"__t{i}" for i in range(len(labels))]
    cols = [*group, F.col(session).alias("__session"), *[c.alias(n) for n, c in zip([*f, *t], [*features.values(), *labels.values()])]]
    base = df.select(*cols, *([F.col(direction).alias("__dir")] if direction else []))
    per = [*group, "__session"]
    strata = [(F.lit("all"), "__a", Window.partitionBy(*per))] if whole else []
    if direction:
        strata.append((F.col("__dir"), "__d", Window.partitionBy(*per, "__dir")))
    for _, tail, w in reversed(strata):
        names = f + t if tail == "__a" else f
        base = base.select("*", *[F.count(n).over(w).alias(n + tail) for n in names])
    kind = dict(base.dtypes)[f[0]] if f else "long"
    none = F.lit(None)

    def struct(name, stratum, value, label, n):
        parts = [F.lit(name).alias("feature"), stratum.alias("stratum"), value.alias("value"), F.try_divide(F.lit(1.0), F.col(n)).alias("r")]
        return F.struct(*parts, *([label.alias("label")] if labels else []))

    laid = [
        struct(name, stratum, F.col(n), none.cast("string"), n + tail) for n, name in zip(f, features) for stratum, tail, _ in strata
    ] + [struct(name, F.lit("all"), none.cast(kind), F.col(n), n + "__a") for n, name in zip(t, labels)]
    given = "value is not null or label is not null" if labels else "value is not null"
    rows = base.select(*group, F.inline(F.array(*laid))).where(f"({given}) and stratum is not null")
    return rows.groupBy(*group, "feature", "stratum", "value", *(["label"] if labels else [])).agg(
        F.sum("r").alias("balanced"), F.count(F.lit(1)).alias("pooled")
    )


def group_totals(masses: DataFrame, *, group: Sequence[str]) -> DataFrame:
    """``sessions`` and ``observations`` of every group, feature and stratum."""
    return masses.groupBy(*group, "feature", "stratum").agg(
        F.round(F.sum("balanced")).cast("long").alias("sessions"), F.sum("pooled").alias("observations")
    )


def normalized(masses: DataFrame, *, group: Sequence[str]) -> DataFrame:
    """Masses of both estimators as shares of their group (columns ``balanced``, ``pooled``),
    beside the group's ``sessions`` and ``observations``."""
    key = [*group, "feature", "stratum"]
    shares = masses.join(group_totals(masses, group=group), key)
    return shares.withColumn("balanced", F.col("balanced") / F.col("sessions")).withColumn(
        "pooled", F.col("pooled") / F.col("observations")
    )


def by_estimator(df: DataFrame, *, keep: Sequence[str], out: str, masses: Sequence[str] = tuple(ESTIMATORS.values())) -> DataFrame:
    """One row per estimator instead of one column each."""
    both = F.array(*[F.struct(F.lit(e).alias("estimator"), F.col(c).alias(out)) for e, c in ESTIMATORS.items() if c in masses])
    return df.select(*keep, F.inline(both))
