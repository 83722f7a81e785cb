"""The observation table as the distribution queries read it, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: stands for a missing class
MISSING = "(missing)"
#: fixed values: numeric and categorical features, and contrasts in report order
NUMERIC = (
    "frame_length_bytes", "ip_total_length_bytes", "tcp_payload_length_bytes", "ipv4_ttl", "tcp_window_raw", "iat_us",
)
CATEGORICAL = ("direction", "tcp_flag_pattern")
#: fixed values: feature families of the composite, in report order
FAMILIES = {
    "ip_total_length_bytes": "size_packetization",
    "ipv4_ttl": "host_path",
    "tcp_window_raw": "host_path",
    "direction": "direction_flags",
    "tcp_flag_pattern": "direction_flags",
    "iat_us": "timing",
}
CONTRASTS = ("client_browser", "client_os", "client_browser_and_os", "network", "temporal")
GROUP = ["cohort_scope", "configuration_id", "class_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """One row per observed packet, under one spelling of its group; a missing class is the class
    ``(missing)``.  With ``once`` false also rows delivered twice, where only distinct keys are
    read from it.  Rows are exchanged once, by session: repeats, and every window over a
    session later, are found where they lie."""
    o = table(spark, sf_dir, "packet_observations")
    rows = o.select(
        "protocol_id",
        F.upper(F.replace(F.trim("configuration_id"), F.lit("_"), F.lit("-"))).alias("configuration_id"),
        F.coalesce(F.rtrim(F.lower(F.trim("class_name")), F.lit(".")), F.lit(MISSING)).alias("class_name"),
        "session_view_index",
        "position",
        "direction",
        *NUMERIC[:-1],
        F.when(F.col("iat_us") >= 0, F.col("iat_us")).alias("iat_us"),
        "tcp_flag_pattern",
    )
    return rows.repartition("configuration_id", "class_name", "session_view_index").distinct() if once else rows


def scoped(obs: DataFrame) -> DataFrame:
    """Every observation under scope ``all``; those of every fourth session also under
    ``heldout``, which stands for a held-out split that the table does not have.  Only queries
    that compare two scopes read it."""
    scopes = F.when(F.col("session_view_index") % 4 == 0, F.array(F.lit("all"), F.lit("heldout"))).otherwise(
        F.array(F.lit("all"))
    )
    return obs.withColumn("cohort_scope", F.explode(scopes))


def configurations(obs: DataFrame) -> DataFrame:
    """Distinct configurations with the parts of their id."""
    c = obs.select("protocol_id", "configuration_id").distinct()
    part = F.split("configuration_id", "-")
    return c.select(
        "protocol_id", "configuration_id", *[part[i].alias(n) for i, n in enumerate(("campaign", "os", "browser", "network"))]
    )


def configuration_pairs(obs: DataFrame) -> DataFrame:
    """Unordered pairs of one protocol's configurations that differ by one contrast."""
    c = configurations(obs)
    a = c.select(*[F.col(x).alias(f"l_{x}") for x in c.columns])
    b = c.select(*[F.col(x).alias(f"r_{x}") for x in c.columns])

    def differs(x):
        return F.col(f"l_{x}") != F.col(f"r_{x}")

    os, browser, net, camp = (differs(x) for x in ("os", "browser", "network", "campaign"))
    contrast = (
        F.when(camp & ~os & ~browser & ~net, "temporal")
        .when(~camp & ~os & browser & ~net, "client_browser")
        .when(~camp & os & ~browser & ~net, "client_os")
        .when(~camp & os & browser & ~net, "client_browser_and_os")
        .when(~camp & ~os & ~browser & net, "network")
    )
    on = (F.col("l_protocol_id") == F.col("r_protocol_id")) & (F.col("l_configuration_id") < F.col("r_configuration_id"))
    return a.join(b, on).select(
        F.concat_ws("~", "l_configuration_id", "r_configuration_id").alias("pair_id"),
        contrast.alias("contrast"),
        F.col("l_protocol_id").alias("protocol_id"),
        F.col("l_configuration_id").alias("left_side"),
        F.col("r_configuration_id").alias("right_side"),
    ).where("contrast is not null")


OBS_SQL = """
obs AS (SELECT DISTINCT protocol_id, upper(replace(trim(configuration_id),'_','-')) AS configuration_id,
  coalesce(rtrim(lower(trim(class_name)),'.'),'(missing)') AS class_name, session_view_index, position, direction,
  frame_length_bytes, ip_total_length_bytes, tcp_payload_length_bytes, ipv4_ttl, tcp_window_raw,
  CASE WHEN iat_us>=0 THEN iat_us END AS iat_us, tcp_flag_pattern
  FROM packet_observations),
sc AS (SELECT 'all' AS cohort_scope, * FROM obs UNION ALL SELECT 'heldout', * FROM obs WHERE session_view_index % 4 = 0),
cf AS (SELECT DISTINCT protocol_id, configuration_id, split_part(configuration_id,'-',1) camp, split_part(configuration_id,'-',2) os,
  split_part(configuration_id,'-',3) br, split_part(configuration_id,'-',4) net FROM obs),
pairs AS (SELECT * FROM (SELECT a.configuration_id||'~'||b.configuration_id AS pair_id,
  CASE WHEN a.camp<>b.camp AND a.os=b.os AND a.br=b.br AND a.net=b.net THEN 'temporal'
       WHEN a.camp=b.camp AND a.os=b.os AND a.br<>b.br AND a.net=b.net THEN 'client_browser'
       WHEN a.camp=b.camp AND a.os<>b.os AND a.br=b.br AND a.net=b.net THEN 'client_os'
       WHEN a.camp=b.camp AND a.os<>b.os AND a.br<>b.br AND a.net=b.net THEN 'client_browser_and_os'
       WHEN a.camp=b.camp AND a.os=b.os AND a.br=b.br AND a.net<>b.net THEN 'network' END AS contrast,
  a.protocol_id, a.configuration_id AS left_side, b.configuration_id AS right_side
  FROM cf a JOIN cf b ON a.protocol_id=b.protocol_id AND a.configuration_id<b.configuration_id) WHERE contrast IS NOT NULL)"""


def long_sql(numeric: tuple[str, ...] = NUMERIC, categorical: tuple[str, ...] = CATEGORICAL, source: str = "sc", extra: str = "") -> str:
    """CTEs ``nlong`` and ``clong``: long numeric and categorical rows by stratum."""
    n = " UNION ALL ".join(f"SELECT *, '{f}' AS feature, CAST({f} AS BIGINT) AS value FROM st WHERE {f} IS NOT NULL" for f in numeric)
    c = " UNION ALL ".join(
        f"SELECT *, '{f}' AS feature, {f} AS value FROM st WHERE stratum='all' AND {f} IS NOT NULL" for f in categorical
    )
    return (
        f"st AS (SELECT cohort_scope, configuration_id, class_name, session_view_index AS session{extra}, s.stratum, direction, tcp_flag_pattern, "
        f"{', '.join(NUMERIC)} FROM {source} CROSS JOIN (VALUES ('all'),('c2s'),('s2c')) s(stratum) WHERE s.stratum='all' OR s.stratum=direction),\n"
        f"nlong AS ({n}),\nclong AS ({c})"
    )


def mass_sql(long: str, out: str, key: str) -> str:
    """CTEs turning long rows into shares ``out(key, feature, stratum, estimator, value, mass)``."""
    return f"""
{out}_w AS (SELECT {key}, feature, stratum, value, 1.0E0/COUNT(*) OVER (PARTITION BY {key}, feature, stratum, session) AS r FROM {long}),
{out}_m AS (SELECT {key}, feature, stratum, value, SUM(r) AS bal, CAST(COUNT(*) AS DOUBLE) AS pool FROM {out}_w GROUP BY ALL),
{out}_n AS (SELECT {key}, feature, stratum, value, bal/SUM(bal) OVER (PARTITION BY {key}, feature, stratum) AS bal,
  pool/SUM(pool) OVER (PARTITION BY {key}, feature, stratum) AS pool FROM {out}_m),
{out} AS (SELECT {key}, feature, stratum, 'session_balanced' AS estimator, value, bal AS mass FROM {out}_n
  UNION ALL SELECT {key}, feature, stratum, 'packet_pooled', value, pool FROM {out}_n)"""


def distance_sql(shares: str, out: str, key: str, kind: str) -> str:
    """CTEs for KS or total-variation distances of every pair: ``out(pair_id, key..., distance)``."""
    k = f"pair_id, {key}"
    gap = (
        f"SELECT {k}, MAX(ABS(g)) AS d FROM (SELECT {k}, SUM(dm) OVER (PARTITION BY {k} ORDER BY value ROWS UNBOUNDED PRECEDING) AS g FROM {out}_u) GROUP BY ALL"
        if kind == "ks"
        else f"SELECT {k}, 0.5E0*SUM(ABS(dm)) AS d FROM {out}_u GROUP BY ALL"
    )
    return f"""
{out}_s AS (SELECT p.pair_id, {key}, value, 1 AS side, mass AS sg FROM pairs p JOIN {shares} m ON m.configuration_id=p.left_side
  UNION ALL SELECT p.pair_id, {key}, value, 2, -mass FROM pairs p JOIN {shares} m ON m.configuration_id=p.right_side),
{out}_b AS (SELECT {k} FROM {out}_s GROUP BY ALL HAVING COUNT(DISTINCT side)=2),
{out}_u AS (SELECT {k}, value, SUM(sg) AS dm FROM {out}_s SEMI JOIN {out}_b USING ({k}) GROUP BY ALL),
{out} AS (SELECT {k}, LEAST(1.0E0,GREATEST(0.0E0,d)) AS distance FROM ({gap}))"""
