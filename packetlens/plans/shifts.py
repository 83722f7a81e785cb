"""Distribution-shift queries over ``packet_observations`` and their oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.operators import bootstrap, descriptives, distances, positional, rollups, weights
from packetlens.operators.rollups import stable_round
from packetlens.runtime import materialize
from packetlens.plans.observations import (
    CATEGORICAL, CONTRASTS, FAMILIES, GROUP, NUMERIC, OBS_SQL, configuration_pairs, distance_sql, long_sql, mass_sql,
    observations, scoped,
)

KEYS = ["cohort_scope", "class_name", "feature", "stratum", "estimator"]
UNIT = KEYS[:-1]
RANKS = (0.1, 0.25, 0.5, 0.75, 0.9)


def _shares(
    obs: DataFrame, numeric=NUMERIC, categorical=CATEGORICAL, strata: tuple[str, ...] = ("all", "c2s", "s2c")
) -> DataFrame:
    """Value histograms of every group as shares, numbers in ``value`` and texts in ``label``.
    They are written once, being far smaller than the observations, and read by all that
    follows."""
    masses = weights.value_masses(
        obs, group=GROUP, session="session_view_index", features={n: F.col(n).cast("long") for n in numeric},
        direction="direction" if numeric and set(strata) != {"all"} else None, whole="all" in strata,
        labels={n: F.col(n) for n in categorical},
    )
    if not categorical:
        masses = masses.withColumn("label", F.lit(None).cast("string"))
    return weights.normalized(materialize(masses, "masses"), group=GROUP)


_SIDES = [f"{end}_{t}" for t in ("sessions", "observations") for end in ("left", "right")]


def _distances(
    obs: DataFrame, pairs: DataFrame, numeric=NUMERIC, categorical=CATEGORICAL, *, strata=("all", "c2s", "s2c"), estimators=tuple(weights.ESTIMATORS)
) -> DataFrame:
    """Distances of all pairs with the support of both sides."""
    masses = [weights.ESTIMATORS[e] for e in estimators]
    shares = _shares(obs, numeric, categorical, strata)
    parts = []
    for names, column, measure, label in (
        (numeric, "value", distances.weighted_ks, "ks"), (categorical, "label", distances.total_variation, "total_variation"),
    ):
        if names:
            rows = distances.signed_masses(
                shares.where(f"{column} is not null"), pairs, side="configuration_id", keys=UNIT, value=column, masses=masses,
                totals=("sessions", "observations"),
            )
            parts.append(measure(rows, keys=UNIT, masses=masses, carry=_SIDES).withColumn("distance_statistic", F.lit(label)))
    return reduce(DataFrame.unionByName, parts)


def _one_feature(estimator: str, numeric, categorical, strata: tuple[str, ...]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        obs = observations(spark, sf_dir).withColumn("cohort_scope", F.lit("all"))
        pairs = configuration_pairs(observations(spark, sf_dir, once=False))
        d = _distances(obs, pairs, numeric, categorical, strata=strata, estimators=(estimator,))
        return d.where(F.col("stratum").isin(*strata)).select(
            "pair_id", "class_name", "feature", "stratum", F.round("distance", 9).alias("distance")
        )

    return query


def _one_feature_sql(estimator: str, numeric, categorical, strata) -> str:
    src = "(SELECT * FROM sc WHERE cohort_scope='all')"
    kind, rows = ("ks", "nlong") if numeric else ("tv", "clong")
    key = "cohort_scope, configuration_id, class_name"
    listed = ", ".join(f"'{s}'" for s in strata)
    return (
        f"WITH {OBS_SQL},\n{long_sql(numeric or ('iat_us',), categorical or ('direction',), src)},{mass_sql(rows, 'sh', key)},"
        f"{distance_sql('sh', 'd', ', '.join(KEYS), kind)}\n"
        f"SELECT pair_id, class_name, feature, stratum, ROUND(distance,9) AS distance FROM d WHERE estimator='{estimator}' AND stratum IN ({listed})"
    )


def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-balanced quantiles of every group and numeric feature (all directions)."""
    obs = observations(spark, sf_dir).withColumn("cohort_scope", F.lit("all"))
    sh = _shares(obs, categorical=(), strata=("all",))
    return descriptives.weighted_quantiles(sh, keys=[*GROUP, "feature"], ranks=RANKS, mass="balanced").drop("cohort_scope")


def numeric_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    sh = _shares(scoped(observations(spark, sf_dir)), categorical=())
    d = descriptives.numeric_descriptives(sh, keys=[*GROUP, "feature", "stratum"])
    unit = F.when(F.col("feature") == "iat_us", 1000.0).otherwise(1.0)
    label = F.when(F.col("feature") == "iat_us", "ms").when(F.col("feature") == "ipv4_ttl", "hops").when(
        F.col("feature") == "tcp_window_raw", "raw"
    ).otherwise("bytes")
    return d.select(
        *GROUP, "feature", "stratum", "estimator", label.alias("unit"),
        *[F.round(F.col(c) / unit + 1e-9, 6).alias(c) for c in ("mean", "q10", "q25", "q50", "q75", "q90", "iqr", "minimum", "maximum")],
    )


def categorical_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sh = _shares(scoped(observations(spark, sf_dir)), numeric=(), strata=("all",))
    sh = weights.by_estimator(sh, keep=[*GROUP, "feature", "label"], out="mass")
    fin = F.col("label").contains("FIN") | F.col("label").contains("RST")
    return sh.select(
        *GROUP, "feature", "estimator", F.col("label").alias("category"), F.round("mass", 9).alias("prevalence"),
        ((F.col("feature") == "tcp_flag_pattern") & fin).alias("termination_sensitive"),
    )


def _long(spark: SparkSession, sf_dir: str, *, scopes=("all", "heldout"), strata=("all", "c2s", "s2c"), estimators=tuple(weights.ESTIMATORS)) -> DataFrame:
    """Distances of the scopes, strata and estimators asked for; nothing else is computed."""
    obs = observations(spark, sf_dir)
    obs = scoped(obs) if "heldout" in scopes else obs.withColumn("cohort_scope", F.lit("all"))
    pairs = configuration_pairs(observations(spark, sf_dir, once=False))
    d = _distances(obs, pairs, strata=strata, estimators=estimators)
    # a handful of rows: configurations squared
    out = d.join(F.broadcast(pairs.select("pair_id", "contrast")), "pair_id")
    return out.select(*KEYS, "pair_id", "contrast", "distance_statistic", F.round("distance", 9).alias("distance"), *_SIDES)


def marginal_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distance: scope x estimator x stratum x pair x class x feature, with support."""
    return _long(spark, sf_dir)


def _main(spark: SparkSession, sf_dir: str, scopes=("all",)) -> DataFrame:
    """The distances that roll-ups report: session-balanced, both directions together."""
    return _long(spark, sf_dir, scopes=scopes, strata=("all",), estimators=("session_balanced",))


_KEYS_SQL = ", ".join(KEYS)
_GROUP_SQL = ", ".join(GROUP)
BASE_SQL = (
    f"{OBS_SQL},\n{long_sql()},{mass_sql('nlong', 'ns', _GROUP_SQL)},{mass_sql('clong', 'cs', _GROUP_SQL)},"
    f"{distance_sql('ns', 'kd', _KEYS_SQL, 'ks')},{distance_sql('cs', 'td', _KEYS_SQL, 'tv')}"
)
LONG_SQL = f"""WITH {BASE_SQL},
tot AS (SELECT {_GROUP_SQL}, feature, stratum, COUNT(DISTINCT session) AS sessions, COUNT(*) AS observations FROM nlong GROUP BY ALL
  UNION ALL SELECT {_GROUP_SQL}, feature, stratum, COUNT(DISTINCT session), COUNT(*) FROM clong GROUP BY ALL),
ml AS (SELECT {', '.join('d.' + k for k in KEYS)}, d.pair_id, p.contrast, distance_statistic, ROUND(distance,9) AS distance,
  l.sessions AS left_sessions, r.sessions AS right_sessions, l.observations AS left_observations, r.observations AS right_observations
  FROM (SELECT *, 'ks' AS distance_statistic FROM kd UNION ALL SELECT *, 'total_variation' FROM td) d JOIN pairs p USING (pair_id)
  JOIN tot l ON l.cohort_scope=d.cohort_scope AND l.class_name=d.class_name AND l.feature=d.feature AND l.stratum=d.stratum AND l.configuration_id=p.left_side
  JOIN tot r ON r.cohort_scope=d.cohort_scope AND r.class_name=d.class_name AND r.feature=d.feature AND r.stratum=d.stratum AND r.configuration_id=p.right_side)"""

_SUM_KEYS = ["cohort_scope", "estimator", "stratum", "feature", "contrast"]
SUMMARY_SQL = f"""{LONG_SQL},
su AS (SELECT {', '.join(_SUM_KEYS)}, COUNT(*) AS "count", AVG(distance) AS mean, quantile_cont(distance,0.5) AS median,
  quantile_cont(distance,0.25) AS q25, quantile_cont(distance,0.75) AS q75,
  quantile_cont(distance,0.75)-quantile_cont(distance,0.25) AS iqr, MAX(distance) AS maximum FROM ml GROUP BY ALL)"""


def _summary(distances_: DataFrame) -> DataFrame:
    return descriptives.plain_summary(distances_, keys=_SUM_KEYS, value="distance")


def summary_linear_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(marginal_long(spark, sf_dir))
    return s.select(*_SUM_KEYS, "count", *[stable_round(c, 8).alias(c) for c in ("mean", "median", "q25", "q75", "iqr", "maximum")])


def marginal_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(_main(spark, sf_dir))
    s = s.withColumn("mean", stable_round("mean", 8)).withColumn("median", stable_round("median", 8)).withColumnRenamed("count", "units")
    return descriptives.pivot_measures(
        s, keys=["feature"], pivot="contrast", values=CONTRASTS, measures=("mean", "median", "units")
    )


_WIDE_SQL = f"""{SUMMARY_SQL} SELECT feature, {', '.join(
    f"MAX(CASE WHEN contrast='{c}' THEN {e} END) AS {c}_{n}" for c in CONTRASTS
    for e, n in (("ROUND(mean+3E-11,8)", "mean"), ("ROUND(median+3E-11,8)", "median"), ('"count"', "units")))}
FROM su WHERE cohort_scope='all' AND estimator='session_balanced' AND stratum='all' GROUP BY feature"""


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded 95 % intervals of mean and median, values ordered by pair and class."""
    m = marginal_long(spark, sf_dir)
    return bootstrap.bootstrap_intervals(m, keys=_SUM_KEYS, value="distance", order=["pair_id", "class_name"])


def _ranked_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(_main(spark, sf_dir, ("all", "heldout")))
    s = s.select("cohort_scope", "contrast", "feature", stable_round("mean", 8).alias("mean"), stable_round("median", 8).alias("median"))
    return descriptives.pivot_measures(
        s, keys=["contrast", "feature"], pivot="cohort_scope", values=("heldout", "all"), measures=("mean", "median")
    )


def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(_main(spark, sf_dir)).where(F.col("feature").isin(*FAMILIES))
    s = s.withColumn("median", stable_round("median", 8))
    return descriptives.average_ranks(s, keys=["contrast"], value="median", out="median_rank", descending=True).select(
        "contrast", "feature", "median_rank"
    )


def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _ranked_scopes(spark, sf_dir).where(F.col("feature").isin(*FAMILIES))
    return descriptives.spearman(s, keys=["contrast"], left="heldout_median", right="all_median").select(
        "contrast", F.round("rho", 9).alias("rho")
    )


def scope_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out against all sessions: differences, ratio, ranks, correlation and top three."""
    return rollups.scope_sensitivity(_ranked_scopes(spark, sf_dir), ranked=list(FAMILIES))


_FAM = ", ".join(f"'{f}'" for f in FAMILIES)
SCOPES_SQL = f"""{SUMMARY_SQL},
rs AS (SELECT contrast, feature, MAX(CASE WHEN cohort_scope='heldout' THEN ROUND(mean+3E-11,8) END) AS hm, MAX(CASE WHEN cohort_scope='heldout' THEN ROUND(median+3E-11,8) END) AS hd,
  MAX(CASE WHEN cohort_scope='all' THEN ROUND(mean+3E-11,8) END) AS am, MAX(CASE WHEN cohort_scope='all' THEN ROUND(median+3E-11,8) END) AS ad
  FROM su WHERE estimator='session_balanced' AND stratum='all' GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY contrast ORDER BY hd DESC)+(COUNT(*) OVER (PARTITION BY contrast,hd)-1)/2.0E0 AS hr,
  rank() OVER (PARTITION BY contrast ORDER BY ad DESC)+(COUNT(*) OVER (PARTITION BY contrast,ad)-1)/2.0E0 AS ar,
  row_number() OVER (PARTITION BY contrast ORDER BY hd DESC, feature)<=3 AS ht, row_number() OVER (PARTITION BY contrast ORDER BY ad DESC, feature)<=3 AS a3
  FROM rs WHERE feature IN ({_FAM})),
rh AS (SELECT contrast, nullif(corr(hr,ar),'nan'::DOUBLE) AS rho, CAST(SUM(CASE WHEN ht AND a3 THEN 1 ELSE 0 END) AS BIGINT) AS overlap FROM rk GROUP BY contrast)"""
_SENS_SQL = f"""{SCOPES_SQL}
SELECT rs.contrast, rs.feature, rs.hm AS heldout_mean, rs.am AS all_mean, ROUND(rs.am-rs.hm,8)+0.0 AS mean_difference, hd_ AS heldout_median, ad_ AS all_median,
  ROUND(ad_-hd_,8)+0.0 AS median_difference, CASE WHEN hd_<>0 THEN ROUND(ad_/hd_,6) END AS median_ratio,
  CASE WHEN rk.feature IS NULL THEN 'not_ranked' ELSE 'ranked' END AS rank_scope, hr AS heldout_rank, ar AS all_rank, ROUND(rho,9) AS rho,
  COALESCE(ht,FALSE) AS heldout_top3, COALESCE(a3,FALSE) AS all_top3, overlap AS top3_overlap
FROM (SELECT contrast, feature, hm, am, hd AS hd_, ad AS ad_ FROM rs) rs LEFT JOIN rk USING (contrast, feature) JOIN rh USING (contrast)"""


def _pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.class_rollup(_main(spark, sf_dir), keys=["pair_id", "contrast", "feature"], value="distance")


def pair_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _pair_features(spark, sf_dir)
    return f.select(
        "pair_id", "contrast", "feature", "classes", *[stable_round(c, 8).alias(c) for c in ("mean", "median", "maximum")],
        rollups.family_of(F.col("feature"), FAMILIES).alias("family"),
    )


def pair_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rounded(rollups.family_rollup(_pair_features(spark, sf_dir), FAMILIES), 8)


def pair_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rounded(
        rollups.composite(rollups.family_rollup(_pair_features(spark, sf_dir), FAMILIES), parts=len(set(FAMILIES.values()))), 8
    )


_CASE_FAM = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{v}'" for f, v in FAMILIES.items()) + " ELSE 'redundant_reported_only' END"
PAIR_SQL = f"""{LONG_SQL},
pf AS (SELECT pair_id, contrast, feature, COUNT(*) AS classes, AVG(distance) AS mean, quantile_cont(distance,0.5) AS median, MAX(distance) AS maximum
  FROM ml WHERE cohort_scope='all' AND estimator='session_balanced' AND stratum='all' GROUP BY ALL),
fa AS (SELECT pair_id, contrast, family, AVG(mean) AS mean, AVG(median) AS median, AVG(maximum) AS maximum, string_agg(feature, ';' ORDER BY feature) AS features
  FROM (SELECT *, {_CASE_FAM} AS family FROM pf) WHERE family<>'redundant_reported_only' GROUP BY ALL)"""


def _first_k(spark: SparkSession, sf_dir: str):
    obs = observations(spark, sf_dir).withColumn("cohort_scope", F.lit("all"))
    return obs, configuration_pairs(observations(spark, sf_dir, once=False))


SEQUENTIAL = ("signed_ip_total_length_bytes", "direction", "iat_us", "ipv4_ttl", "tcp_window_raw", "tcp_payload_length_bytes")
K = 40
PGROUP = ["configuration_id", "class_name"]


def first_k_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, _ = _first_k(spark, sf_dir)
    return positional.contributors(obs, group=PGROUP, session="session_view_index", position="position", k=K).withColumn(
        "contributor_fraction", F.round("contributor_fraction", 9)
    )


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, pairs = _first_k(spark, sf_dir)
    signed = F.when(F.col("direction") == "c2s", F.col("ip_total_length_bytes")).otherwise(-F.col("ip_total_length_bytes"))
    numeric = {"signed_ip_total_length_bytes": signed.cast("long")}
    numeric |= {n: F.col(n).cast("long") for n in SEQUENTIAL if n in NUMERIC}
    return positional.unit_distances(
        obs, pairs, group=PGROUP, side="configuration_id", session="session_view_index", position="position", k=K,
        numeric=numeric, categorical={"direction": F.col("direction")},
    )


def first_k_unit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).withColumn("distance", F.round("distance", 9))


def first_k_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.position_summary(_units(spark, sf_dir).withColumn("distance", F.round("distance", 9)), digits=8)


def first_k_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.persistence(first_k_summary(spark, sf_dir), thresholds=(0.1, 0.2))


def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest stretch of consecutive positions seen in each session view."""
    return descriptives.longest_runs(
        observations(spark, sf_dir), keys=["configuration_id", "class_name", "session_view_index"], value="position"
    )


def sequential_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rounded(rollups.sequential_rollup(first_k_unit_distance(spark, sf_dir)), 8)


def sequential_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rounded(rollups.sequential_composite(sequential_feature(spark, sf_dir), parts=len(SEQUENTIAL)), 8)


UNIT_SQL = f"""WITH {OBS_SQL},
base AS (SELECT *, CASE WHEN direction='c2s' THEN ip_total_length_bytes ELSE -ip_total_length_bytes END AS signed_ip_total_length_bytes FROM obs WHERE position BETWEEN 1 AND {K}),
nl AS ({' UNION ALL '.join(f"SELECT configuration_id, class_name, position, session_view_index AS s, '{f}' AS feature, CAST({f} AS VARCHAR) AS value, CAST({f} AS BIGINT) AS num FROM base WHERE {f} IS NOT NULL" for f in SEQUENTIAL if f != 'direction')}
 UNION ALL SELECT configuration_id, class_name, position, session_view_index, 'direction', direction, NULL FROM base WHERE direction IS NOT NULL),
tot AS (SELECT configuration_id, class_name, position, feature, COUNT(*) AS n, COUNT(DISTINCT s) AS ses FROM nl GROUP BY ALL),
ma AS (SELECT configuration_id, class_name, position, feature, value, num, COUNT(*)*1.0E0/ANY_VALUE(n) AS mass FROM nl JOIN tot USING (configuration_id, class_name, position, feature) GROUP BY ALL),
grid AS (SELECT pair_id, contrast, left_side, right_side, class_name, position, feature FROM (
  SELECT p.*, c.class_name FROM pairs p JOIN (SELECT DISTINCT configuration_id, class_name FROM obs) c ON c.configuration_id=p.left_side
  SEMI JOIN (SELECT DISTINCT configuration_id, class_name FROM obs) e ON e.configuration_id=p.right_side AND e.class_name=c.class_name)
  CROSS JOIN (SELECT UNNEST(range(1,{K}+1)) AS position) CROSS JOIN (SELECT UNNEST({list(SEQUENTIAL)}) AS feature)),
sg AS (SELECT p.pair_id, m.class_name, m.position, m.feature, value, num, mass AS sm, 1 AS side FROM pairs p JOIN ma m ON m.configuration_id=p.left_side
  UNION ALL SELECT p.pair_id, m.class_name, m.position, m.feature, value, num, -mass, 2 FROM pairs p JOIN ma m ON m.configuration_id=p.right_side),
su_ AS (SELECT pair_id, class_name, position, feature, value, num, SUM(sm) AS dm FROM sg GROUP BY ALL),
di AS (SELECT pair_id, class_name, position, feature, MAX(ABS(g)) AS d FROM (SELECT *, SUM(dm) OVER (PARTITION BY pair_id, class_name, position, feature ORDER BY num ROWS UNBOUNDED PRECEDING) AS g FROM su_ WHERE feature<>'direction') GROUP BY ALL
  UNION ALL SELECT pair_id, class_name, position, feature, 0.5E0*SUM(ABS(dm)) FROM su_ WHERE feature='direction' GROUP BY ALL),
un AS (SELECT g.pair_id, g.contrast, g.class_name, g.position, g.feature, CASE WHEN g.feature='direction' THEN 'total_variation' ELSE 'ks' END AS distance_statistic,
  COALESCE(l.ses,0) AS left_contributing_sessions, COALESCE(r.ses,0) AS right_contributing_sessions,
  LEAST(COALESCE(l.ses,0),COALESCE(r.ses,0)) AS minimum_contributing_sessions,
  CASE WHEN LEAST(COALESCE(l.ses,0),COALESCE(r.ses,0))<2 THEN 'insufficient' WHEN LEAST(l.ses,r.ses)>=10 THEN 'primary_supported' ELSE 'low_support' END AS support_status,
  CASE WHEN LEAST(COALESCE(l.ses,0),COALESCE(r.ses,0))>=2 THEN ROUND(LEAST(1.0E0,GREATEST(0.0E0,d)),9) END AS distance
  FROM grid g LEFT JOIN tot l ON l.configuration_id=g.left_side AND l.class_name=g.class_name AND l.position=g.position AND l.feature=g.feature
  LEFT JOIN tot r ON r.configuration_id=g.right_side AND r.class_name=g.class_name AND r.position=g.position AND r.feature=g.feature
  LEFT JOIN di ON di.pair_id=g.pair_id AND di.class_name=g.class_name AND di.position=g.position AND di.feature=g.feature),
fs AS (SELECT feature, contrast, position, COUNT(*) AS "count", ROUND(AVG(distance)+3E-11,8) AS mean, ROUND(quantile_cont(distance,0.5)+3E-11,8) AS median, ROUND(quantile_cont(distance,0.25)+3E-11,8) AS q25,
  ROUND(quantile_cont(distance,0.75)+3E-11,8) AS q75, ROUND(quantile_cont(distance,0.75)-quantile_cont(distance,0.25)+3E-11,8) AS iqr, ROUND(MAX(distance)+3E-11,8) AS maximum,
  MIN(minimum_contributing_sessions) AS minimum_sessions_per_arm, quantile_cont(CAST(minimum_contributing_sessions AS DOUBLE),0.5) AS median_minimum_sessions_per_arm
  FROM un WHERE support_status='primary_supported' GROUP BY ALL),
sq AS (SELECT pair_id, contrast, feature, COUNT(*) AS positions, ROUND(AVG(m)+3E-11,8) AS mean, ROUND(quantile_cont(m,0.5)+3E-11,8) AS median, ROUND(MAX(m)+3E-11,8) AS maximum FROM
  (SELECT pair_id, contrast, feature, position, AVG(distance) AS m FROM un WHERE support_status='primary_supported' GROUP BY ALL) GROUP BY ALL)"""

_PERSIST_SQL = UNIT_SQL + """
, q AS (SELECT feature, contrast, t AS threshold, position, median>=t AS hit FROM fs CROSS JOIN (VALUES (0.1E0),(0.2E0)) v(t)),
isl AS (SELECT feature, contrast, threshold, MAX(n) AS longest FROM (SELECT feature, contrast, threshold, position-rn AS i, COUNT(*) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY feature, contrast, threshold ORDER BY position) AS rn FROM q WHERE hit) GROUP BY ALL) GROUP BY ALL)
SELECT feature, contrast, threshold, COUNT(*) AS supported_positions, CAST(SUM(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS positions_at_or_above_threshold,
 ROUND(SUM(CASE WHEN hit THEN 1 ELSE 0 END)*1.0E0/COUNT(*),9) AS fraction_at_or_above_threshold, CAST(COALESCE(ANY_VALUE(longest),0) AS BIGINT) AS longest_consecutive_run,
 COALESCE(string_agg(CASE WHEN hit THEN CAST(position AS VARCHAR) END, ';' ORDER BY position),'') AS qualifying_positions
FROM q LEFT JOIN isl USING (feature, contrast, threshold) GROUP BY ALL"""


def directional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed evaluations of each unordered pair: the first left to right, the second back."""
    p = configuration_pairs(observations(spark, sf_dir, once=False))
    n = F.when(F.col("contrast") == "temporal", 1).otherwise(2)
    one, two = F.concat(F.col("pair_id"), F.lit(":1")), F.concat(F.col("pair_id"), F.lit(":2"))
    listed = F.when(n == 1, one).otherwise(F.concat_ws(";", one, two))
    return rollups.directional_mapping(p.withColumn("directed_evaluation_ids", listed))


_NK, _CK = _GROUP_SQL, _GROUP_SQL
_DESC_KEYS = f"{_GROUP_SQL}, feature, stratum, estimator"
_DESC_SQL = f"""WITH {OBS_SQL},
{long_sql()},{mass_sql('nlong', 'ns', _GROUP_SQL)},
cu AS (SELECT *, SUM(mass) OVER (PARTITION BY {_DESC_KEYS} ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum FROM ns),
ag AS (SELECT {_DESC_KEYS}, SUM(value*mass) AS mean, {', '.join(f"MIN(CASE WHEN cum>={r}-1E-12 THEN value END) AS q{round(r * 100):02d}" for r in RANKS)}, MIN(value) AS minimum, MAX(value) AS maximum FROM cu GROUP BY ALL)
SELECT {_DESC_KEYS}, CASE feature WHEN 'iat_us' THEN 'ms' WHEN 'ipv4_ttl' THEN 'hops' WHEN 'tcp_window_raw' THEN 'raw' ELSE 'bytes' END AS unit,
{', '.join(f"ROUND({e}/(CASE WHEN feature='iat_us' THEN 1000.0E0 ELSE 1.0E0 END)+1E-9,6) AS {c}" for c, e in [('mean', 'mean'), *[(f'q{round(r * 100):02d}', f'q{round(r * 100):02d}') for r in RANKS], ('iqr', '(q75-q25)'), ('minimum', 'minimum'), ('maximum', 'maximum')])} FROM ag"""
_PREV_SQL = f"""WITH {OBS_SQL},
{long_sql()},{mass_sql('clong', 'cs', _GROUP_SQL)}
SELECT {_GROUP_SQL}, feature, estimator, value AS category, ROUND(mass,9) AS prevalence,
feature='tcp_flag_pattern' AND (value LIKE '%FIN%' OR value LIKE '%RST%') AS termination_sensitive FROM cs"""
_WQ_SQL = f"""WITH {OBS_SQL},
{long_sql(source="(SELECT * FROM sc WHERE cohort_scope='all')")},{mass_sql('nlong', 'ns', _GROUP_SQL)},
cu AS (SELECT *, SUM(mass) OVER (PARTITION BY {_DESC_KEYS} ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum FROM ns WHERE stratum='all' AND estimator='session_balanced')
SELECT configuration_id, class_name, feature, {', '.join(f"MIN(CASE WHEN cum>={r}-1E-12 THEN value END) AS q{round(r * 100):02d}" for r in RANKS)} FROM cu GROUP BY ALL"""

_SPEC = {
    "ks_session_balanced": ("session_balanced", NUMERIC, (), ("all",)),
    "ks_packet_pooled": ("packet_pooled", NUMERIC, (), ("all",)),
    "ks_by_direction_stratum": ("session_balanced", NUMERIC, (), ("c2s", "s2c")),
    "tv_flags": ("session_balanced", (), ("tcp_flag_pattern",), ("all",)),
    "tv_direction": ("session_balanced", (), ("direction",), ("all",)),
}

QUERIES = {name: _one_feature(*spec) for name, spec in _SPEC.items()} | {
    f.__name__: f
    for f in (
        weighted_quantiles, numeric_descriptives, categorical_prevalence, marginal_long, summary_linear_quantiles, marginal_wide,
        bootstrap_ci, average_rank, spearman_rank, scope_sensitivity, pair_feature, pair_family, pair_composite,
        first_k_contributors, first_k_unit_distance, first_k_summary, first_k_persistence, longest_run, sequential_feature,
        sequential_composite, directional_pairs,
    )
}

ORACLE = {name: _one_feature_sql(*spec) for name, spec in _SPEC.items()} | {
    "weighted_quantiles": _WQ_SQL,
    "numeric_descriptives": _DESC_SQL,
    "categorical_prevalence": _PREV_SQL,
    "marginal_long": f"{LONG_SQL} SELECT * FROM ml",
    "summary_linear_quantiles": f"""{SUMMARY_SQL} SELECT {', '.join(_SUM_KEYS)}, "count", ROUND(mean+3E-11,8) AS mean, ROUND(median+3E-11,8) AS median,
 ROUND(q25+3E-11,8) AS q25, ROUND(q75+3E-11,8) AS q75, ROUND(iqr+3E-11,8) AS iqr, ROUND(maximum+3E-11,8) AS maximum FROM su""",
    "marginal_wide": _WIDE_SQL,
    "average_rank": f"{SCOPES_SQL} SELECT contrast, feature, ar AS median_rank FROM rk",
    "spearman_rank": f"{SCOPES_SQL} SELECT contrast, ROUND(rho,9) AS rho FROM rh",
    "scope_sensitivity": _SENS_SQL,
    "pair_feature": f"{PAIR_SQL} SELECT pair_id, contrast, feature, classes, ROUND(mean+3E-11,8) AS mean, ROUND(median+3E-11,8) AS median, ROUND(maximum+3E-11,8) AS maximum, {_CASE_FAM} AS family FROM pf",
    "pair_family": f"{PAIR_SQL} SELECT pair_id, contrast, family, ROUND(mean+3E-11,8) AS mean, ROUND(median+3E-11,8) AS median, ROUND(maximum+3E-11,8) AS maximum, features FROM fa",
    "pair_composite": f"""{PAIR_SQL} SELECT pair_id, contrast, ROUND(AVG(mean)+3E-11,8) AS mean, ROUND(AVG(median)+3E-11,8) AS median, ROUND(AVG(maximum)+3E-11,8) AS maximum
 FROM fa GROUP BY pair_id, contrast HAVING COUNT(*)=4""",
    "first_k_contributors": f"""WITH {OBS_SQL}, g AS (SELECT configuration_id, class_name, COUNT(DISTINCT session_view_index) AS sessions_in_group FROM obs GROUP BY ALL),
c AS (SELECT configuration_id, class_name, position, COUNT(DISTINCT session_view_index) AS n FROM obs GROUP BY ALL)
SELECT configuration_id, class_name, CAST(p.position AS INTEGER) AS position, sessions_in_group, COALESCE(n,0) AS contributing_sessions, ROUND(COALESCE(n,0)*1.0E0/sessions_in_group,9) AS contributor_fraction
FROM g CROSS JOIN (SELECT UNNEST(range(1,{K}+1)) AS position) p LEFT JOIN c USING (configuration_id, class_name, position)""",
    "first_k_unit_distance": f"""{UNIT_SQL} SELECT pair_id, contrast, class_name, CAST(position AS INTEGER) AS position, feature, distance_statistic, distance, left_contributing_sessions,
 right_contributing_sessions, minimum_contributing_sessions, support_status, support_status='primary_supported' AS included_in_primary_summary FROM un""",
    "first_k_summary": f"{UNIT_SQL} SELECT feature, contrast, CAST(position AS INTEGER) AS position, * EXCLUDE (feature, contrast, position) FROM fs",
    "first_k_persistence": _PERSIST_SQL,
    "longest_run": f"""WITH {OBS_SQL}, d AS (SELECT DISTINCT configuration_id, class_name, session_view_index, position FROM obs),
i AS (SELECT *, position - row_number() OVER (PARTITION BY configuration_id, class_name, session_view_index ORDER BY position) AS i FROM d)
SELECT configuration_id, class_name, session_view_index, MAX(n) AS longest_run FROM (SELECT configuration_id, class_name, session_view_index, i, COUNT(*) AS n FROM i GROUP BY ALL) GROUP BY ALL""",
    "sequential_feature": f"{UNIT_SQL} SELECT * FROM sq",
    "sequential_composite": f"""{UNIT_SQL} SELECT pair_id, contrast, ROUND(AVG(mean)+3E-11,8) AS mean, ROUND(AVG(median)+3E-11,8) AS median FROM sq GROUP BY pair_id, contrast HAVING COUNT(*)={len(SEQUENTIAL)}""",
    "directional_pairs": f"""WITH {OBS_SQL}, e AS (SELECT *, UNNEST(range(1, CASE WHEN contrast='temporal' THEN 2 ELSE 3 END)) AS n FROM pairs)
SELECT pair_id, contrast, pair_id||':'||n AS evaluation_id, CASE n WHEN 1 THEN 'left_to_right' ELSE 'right_to_left' END AS direction,
CASE n WHEN 1 THEN left_side ELSE right_side END AS source_configuration_id, CASE n WHEN 1 THEN right_side ELSE left_side END AS target_configuration_id FROM e""",
}
