"""Packet, split and planner queries with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlens.functions import text as T
from packetlens.functions.addresses import canonical_ip
from packetlens.operators import checks, flows, matrix, selection
from packetlens.operators.components import token_components
from packetlens.plans.observations import OBS_SQL, configuration_pairs, observations, table
from packetlens.runtime import micros


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("psyn"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def sessionize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = flows.flow_sessions(_events(spark, sf_dir), flow=["user_id"], order=["ts", "event_id"], opening=F.col("psyn"), token=F.col("k"))
    return s.groupBy("user_id", "session_ordinal").agg(F.count(F.lit(1)).alias("packets"), F.min("event_id").alias("first_id"))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessionize_events(spark, sf_dir)
    return s.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("packets").alias("packets"), F.min("packets").alias("fewest"), F.max("packets").alias("most")
    ).withColumn("status", F.when(F.col("sessions") > 0, "accepted").otherwise("rejected_no_tcp_sessions"))


def _tcp(spark, sf_dir):
    """Packets once each, with a source, addresses in one spelling, time in microseconds."""
    t = table(spark, sf_dir, "tcp_packets")
    return t.withColumn("us", micros(t, "captured_at")).drop("arrived_at", "captured_at").distinct().where(
        "source_ip is not null and source_port is not null"
    ).withColumn("source_ip", canonical_ip(F.col("source_ip")))


_TCP_SQL = r"""tp AS (SELECT DISTINCT packet_id, capture_id, regexp_replace(regexp_replace(lower(trim(source_ip)),'^::ffff:',''),'(^|\.)0+([0-9])','\1\2','g') AS source_ip,
 source_port, destination_ip, destination_port, sequence, flags, payload_length, epoch_us(captured_at) AS us FROM tcp_packets WHERE source_ip IS NOT NULL AND source_port IS NOT NULL)"""


def flow_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bidirectional flows cut at fresh connection openings only."""
    t = _tcp(spark, sf_dir)
    key = flows.endpoint_key("source_ip", "source_port", "destination_ip", "destination_port")
    syn = (F.col("flags").bitwiseAND(2) != 0) & (F.col("flags").bitwiseAND(16) == 0)
    s = flows.flow_sessions(t.withColumn("flow", key), flow=["flow"], order=["us", "packet_id"], opening=syn, token=F.col("sequence"))
    return s.groupBy("flow", "session_ordinal").agg(F.count(F.lit(1)).alias("packets"), F.min("packet_id").alias("first_id"), F.sum("payload_length").alias("payload"))


def time_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.time_inversions(_tcp(spark, sf_dir), keys=["capture_id"], order=["packet_id"], ts="us")


def rebase_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = flows.rebase_times(_tcp(spark, sf_dir), keys=["source_ip", "source_port"], us="us", anchor_us=1_000_000)
    return r.select("packet_id", "rebased_us")


def first_k_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = flows.first_k(_tcp(spark, sf_dir), keys=["source_ip", "source_port"], order=["us", "packet_id"], k=50)
    return t.select("packet_id", "place")


def first_payload_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = flows.trim_to_first(_tcp(spark, sf_dir), keys=["source_ip", "source_port"], order="packet_id", condition=F.col("payload_length") > 0)
    return t.groupBy("source_ip", "source_port").agg(F.count(F.lit(1)).alias("kept"), F.min("packet_id").alias("first_id"))


def flag_mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tcp(spark, sf_dir).groupBy("flags").agg(F.count(F.lit(1)).alias("packets"))
    return t.select("flags", "packets", T.flag_pattern(F.col("flags")).alias("pattern"), T.flag_mask(T.flag_pattern(F.col("flags"))).alias("back"))


def unordered_pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = configuration_pairs(observations(spark, sf_dir, once=False))
    return p.select("pair_id", T.unordered_key(F.col("right_side"), F.col("left_side")).alias("unordered_configuration_key"))


def position_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session views whose soundly measured positions (payload fits the IP length) do not run
    from 1 without gap."""
    g = ["protocol_id", "configuration_id", "class_name", "session_view_index"]
    o = observations(spark, sf_dir).where("frame_length_bytes >= ip_total_length_bytes").select(*g, "position").distinct()
    return o.groupBy(*g).agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> 1 or hi <> n")


def observation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.rule_counts(table(spark, sf_dir, "packet_observations"), checks.observation_rules())


def iat_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "packet_observations")
    broken = F.when(F.col("iat_us") < 0, "negative").when((F.col("position") == 1) & F.col("iat_us").isNotNull(), "first_has_value").when(
        (F.col("position") > 1) & F.col("iat_us").isNull(), "missing"
    ).otherwise("ok")
    return o.groupBy(broken.alias("state")).agg(F.count(F.lit(1)).alias("rows"))


def first_five_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, TTL and inter-arrival time of each session view's first five payload packets."""
    g = ["protocol_id", "configuration_id", "class_name", "session_view_index"]
    o = observations(spark, sf_dir).where("tcp_payload_length_bytes > 0")
    o = o.groupBy(*g, "position").agg(F.max(F.struct("ip_total_length_bytes", "ipv4_ttl", F.col("iat_us").alias("iat"))).alias("x"))
    top = flows.first_k(o, keys=g, order=["position"], k=5)
    cells = [
        F.max(F.when(F.col("place") == i, F.col(f"x.{c}"))).alias(f"{n}_{i}")
        for i in range(1, 6) for c, n in (("ip_total_length_bytes", "length"), ("ipv4_ttl", "ttl"), ("iat", "iat"))
    ]
    return top.groupBy(*g).agg(*cells)


_P5 = ["protocol_id", "configuration_id", "class_name", "session_view_index"]
_FIVE_SQL = f"""WITH {OBS_SQL}, o AS (SELECT {', '.join(_P5)}, position, arg_max(ROW(ip_total_length_bytes, ipv4_ttl, iat_us), (ip_total_length_bytes, ipv4_ttl, coalesce(iat_us,-1))) AS x FROM obs WHERE tcp_payload_length_bytes>0 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_P5)} ORDER BY position) AS place FROM o)
SELECT {', '.join(_P5)}, {', '.join(f"MAX(CASE WHEN place={i} THEN x[{j}] END) AS {n}_{i}" for i in range(1, 6) for j, n in ((1, 'length'), (2, 'ttl'), (3, 'iat')))} FROM t WHERE place<=5 GROUP BY ALL"""


def _components(spark, sf_dir):
    m = table(spark, sf_dir, "session_manifest").where("status = 'accepted'")
    rel = [T.relation_key(F.col(c)) for c in ("parent_group_id", "pcap_sha256")]
    comp = token_components(m, node="session_id", tokens=rel)
    first = m.groupBy("session_id").agg(F.min(F.struct("record_no", "configuration_id", "class_name")).alias("r"))
    j = comp.join(first, comp["node"] == first["session_id"])
    return j.groupBy("component").agg(
        F.min(F.struct("r.configuration_id", "r.class_name")).alias("cell"), F.count(F.lit(1)).alias("n")
    ).select("cell.configuration_id", "cell.class_name", "component", "n")


def exact_group_selection(spark: SparkSession, sf_dir: str, per_cell_limit: int = 40) -> DataFrame:
    """At most ``per_cell_limit`` sessions of every cell, in whole leakage groups, by subset sums in digest order."""
    return selection.cell_splits(
        _components(spark, sf_dir), cell=["configuration_id", "class_name"], group="component", size="n", target=per_cell_limit, namespace="selection-v1", share=0.0
    ).drop("split")


def group_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 70/15/15 roles of all sessions of every cell, in whole leakage groups."""
    return selection.cell_splits(
        _components(spark, sf_dir), cell=["configuration_id", "class_name"], group="component", size="n", target=None, namespace="split-v1"
    )


MODELS = ("forest", "boosted_trees", "svm", "mlp", "cnn", "transformer", "graph")
SEEDS = (11, 23, 47)
ROUTES = {m: ({"temporal": f"{m}_temporal", "all": f"{m}_base"} if m in ("cnn", "transformer") else {"all": f"{m}_base"}) for m in MODELS}


def _cells(spark, sf_dir):
    """Directed evaluations: every configuration on itself, and both ways over every pair."""
    obs = observations(spark, sf_dir, once=False)
    same = obs.select("configuration_id").distinct().select(
        F.lit("matched").alias("evaluation_kind"), F.col("configuration_id").alias("source_configuration_id"), F.col("configuration_id").alias("target_configuration_id")
    )
    p = configuration_pairs(obs)
    kind = F.when(F.col("contrast") == "temporal", "temporal").otherwise("shifted")
    there = p.select(kind.alias("evaluation_kind"), F.col("left_side").alias("source_configuration_id"), F.col("right_side").alias("target_configuration_id"))
    back = p.where("contrast <> 'temporal'").select(kind.alias("evaluation_kind"), F.col("right_side").alias("source_configuration_id"), F.col("left_side").alias("target_configuration_id"))
    c = same.unionByName(there).unionByName(back)
    n = F.row_number().over(Window.orderBy("evaluation_kind", "source_configuration_id", "target_configuration_id"))
    return c.withColumn("cell_ordinal", n).withColumn("evaluation_id", F.format_string("E%03d", "cell_ordinal"))


def matrix_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = matrix.ordered_table(spark, MODELS, "model", "model_ordinal")
    seeds = matrix.ordered_table(spark, SEEDS, "seed", "seed_ordinal")
    return matrix.evaluation_jobs(_cells(spark, sf_dir), models, seeds, ROUTES)


def preprocess_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.source_jobs(_cells(spark, sf_dir), matrix.ordered_table(spark, MODELS, "model", "model_ordinal"))


def training_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = matrix.source_jobs(_cells(spark, sf_dir), matrix.ordered_table(spark, MODELS, "model", "model_ordinal"), SEEDS)
    return jobs.withColumn("seeds", F.array_join(F.col("seeds").cast("array<string>"), ","))


def routing_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_jobs(spark, sf_dir).groupBy("model", "evaluation_kind", "recipe").agg(F.count(F.lit(1)).alias("jobs"))


def group_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.grouped_commands(
        matrix_jobs(spark, sf_dir), keys=["model", "source_configuration_id"], order=["cell_ordinal", "seed_ordinal"], item="job_id"
    )


def cross_product_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of direction, flag pattern and TTL that no packet has."""
    obs = table(spark, sf_dir, "packet_observations")
    rows = obs.select("direction", "tcp_flag_pattern", "ipv4_ttl").distinct()
    dims = {c: obs.select(c).distinct().where(f"{c} is not null") for c in ("direction", "tcp_flag_pattern", "ipv4_ttl")}
    return matrix.product_coverage(rows, dims)


def cohort_day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each protocol's configurations x classes x days without observation, with more
    than one, or (part of the key is missing) outside the product."""
    key = {
        "configuration_id": F.upper(F.replace(F.trim("configuration_id"), F.lit("_"), F.lit("-"))),
        "class_name": F.rtrim(F.lower(F.trim("class_name")), F.lit(".")),
        "capture_day": F.col("capture_day"),
    }
    rows = table(spark, sf_dir, "packet_observations").select("protocol_id", *[c.alias(n) for n, c in key.items()])
    dims = {c: rows.select("protocol_id", c).distinct().where(f"{c} is not null") for c in key}
    return matrix.product_coverage(rows, dims, within="protocol_id")


def triple_optional_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple patterns with optional parts, sampled values and a distinct concatenation."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    subject = F.concat(F.lit("n"), F.col("n_nationkey"))
    triples = (
        n.select(subject.alias("s"), F.lit("name").alias("p"), F.col("n_name").alias("o"))
        .unionByName(n.join(r, n["n_regionkey"] == r["r_regionkey"]).where("r_name <> 'ASIA'").select(subject.alias("s"), F.lit("stream").alias("p"), F.col("r_name").alias("o")))
        .unionByName(s.where("s_acctbal > 0").select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("s"), F.lit("author").alias("p"), F.col("s_name").alias("o")))
    )

    def pattern(p):
        return triples.where(F.col("p") == p).select("s", F.col("o").alias(p))

    j = pattern("name").join(pattern("stream"), "s", "left").join(pattern("author"), "s", "left")
    return j.groupBy("s", "name").agg(
        F.min("stream").alias("stream"), F.array_join(F.array_sort(F.collect_set("author")), " ").alias("authors")
    )


def cohort_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, packets, fewest and most packets of a session per configuration and class."""
    g = ["protocol_id", "configuration_id", "class_name"]
    per = observations(spark, sf_dir).groupBy(*g, "session_view_index").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*g).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("packets"), F.min("n").alias("min_packets"), F.max("n").alias("max_packets")
    )


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell: sessions, distinct parents, and sessions by split."""
    m = table(spark, sf_dir, "session_manifest").withColumn("split", F.lower(F.trim("split")))
    return m.groupBy("configuration_id", "class_name").agg(
        F.countDistinct("session_id").alias("sessions"), F.countDistinct("parent_group_id").alias("parents"),
        *[F.countDistinct(F.when(F.col("split") == s, F.col("session_id"))).alias(s) for s in selection.ROLES],
    )


QUERIES = {
    f.__name__: f
    for f in (
        sessionize_events, session_summary, flow_sessions, time_inversions, rebase_time, first_k_packets, first_payload_trim,
        flag_mask_roundtrip, unordered_pair_key, position_contiguity, observation_rules, iat_rules, first_five_features,
        exact_group_selection, group_splits, matrix_jobs, preprocess_jobs, training_jobs, routing_default, group_commands,
        cross_product_coverage, cohort_day_coverage, triple_optional_group_concat, cohort_reconciliation, selection_summary,
    )
}

_EV_SQL = """WITH e AS (SELECT user_id, event_id, ts, event_type='signup' AS psyn, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events),
a AS (SELECT *, row_number() OVER w AS rn, last_value(CASE WHEN psyn THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, SUM(CASE WHEN rn=1 OR (psyn AND (prev IS NULL OR prev<>k)) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS session_ordinal FROM a),
s AS (SELECT user_id, CAST(session_ordinal AS BIGINT) AS session_ordinal, COUNT(*) AS packets, MIN(event_id) AS first_id FROM f GROUP BY 1,2)"""
_FLOW_SQL = f"""WITH {_TCP_SQL}, x AS (SELECT *, source_ip||':'||source_port AS a, destination_ip||':'||destination_port AS b, (flags&2)<>0 AND (flags&16)=0 AS syn FROM tp),
y AS (SELECT *, least(a,b)||'-'||greatest(a,b) AS flow FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY us, packet_id) AS rn, last_value(CASE WHEN syn THEN sequence END IGNORE NULLS) OVER (PARTITION BY flow ORDER BY us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM y),
f AS (SELECT *, SUM(CASE WHEN rn=1 OR (syn AND (prev IS NULL OR prev<>sequence)) THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY rn ROWS UNBOUNDED PRECEDING) AS o FROM z)
SELECT flow, CAST(o AS BIGINT) AS session_ordinal, COUNT(*) AS packets, MIN(packet_id) AS first_id, CAST(SUM(payload_length) AS BIGINT) AS payload FROM f GROUP BY 1,2"""
_CELLS_SQL = f"""WITH {OBS_SQL}, ce AS (SELECT 'matched' AS evaluation_kind, configuration_id AS source_configuration_id, configuration_id AS target_configuration_id FROM (SELECT DISTINCT configuration_id FROM obs)
 UNION ALL SELECT CASE WHEN contrast='temporal' THEN 'temporal' ELSE 'shifted' END, left_side, right_side FROM pairs UNION ALL SELECT 'shifted', right_side, left_side FROM pairs WHERE contrast<>'temporal'),
cells AS (SELECT *, CAST(row_number() OVER (ORDER BY evaluation_kind, source_configuration_id, target_configuration_id) AS INT) AS cell_ordinal FROM ce),
mo AS (SELECT * FROM (VALUES {','.join(f"({i},'{m}')" for i, m in enumerate(MODELS, 1))}) v(model_ordinal, model)), se AS (SELECT * FROM (VALUES {','.join(f'({i},{s})' for i, s in enumerate(SEEDS, 1))}) v(seed_ordinal, seed)),
jobs AS (SELECT model||'_E'||lpad(CAST(cell_ordinal AS VARCHAR),3,'0')||'_s'||seed AS job_id, model_ordinal, model, cell_ordinal, 'E'||lpad(CAST(cell_ordinal AS VARCHAR),3,'0') AS evaluation_id, evaluation_kind,
 seed_ordinal, seed, source_configuration_id, target_configuration_id, CASE WHEN model IN ('cnn','transformer') AND evaluation_kind='temporal' THEN model||'_temporal' ELSE model||'_base' END AS recipe FROM mo CROSS JOIN cells CROSS JOIN se)"""
_FLAGS_SQL = "CASE WHEN flags=0 THEN 'NONE' ELSE concat_ws('|', " + ", ".join(f"CASE WHEN (flags&{1 << i})<>0 THEN '{n}' END" for i, n in enumerate(T.FLAG_NAMES)) + ") END"
_OBS_RULES_SQL = {
    "position_range": "position NOT BETWEEN 1 AND 50",
    "payload_is_ip_less_40": "tcp_payload_length_bytes<>ip_total_length_bytes-40",
    "frame_is_ip_plus_14": "coalesce(frame_length_bytes<>greatest(60,ip_total_length_bytes+14),TRUE)",
    "direction_domain": "coalesce(direction,'') NOT IN ('c2s','s2c')",
    "iat_null_iff_first": "(iat_us IS NULL)<>(position=1)",
    "iat_not_negative": "coalesce(iat_us<0,FALSE)",
    "ttl_range": "ipv4_ttl NOT BETWEEN 1 AND 255",
    "window_range": "tcp_window_raw NOT BETWEEN 0 AND 65535",
    "flag_pattern_canonical": "NOT regexp_matches(tcp_flag_pattern,'^(NONE|(FIN)?((^|\\|)SYN)?((^|\\|)RST)?((^|\\|)PSH)?((^|\\|)ACK)?((^|\\|)URG)?((^|\\|)ECE)?((^|\\|)CWR)?)$')",
}

ORACLE = {
    "sessionize_events": f"{_EV_SQL} SELECT * FROM s",
    "session_summary": f"{_EV_SQL} SELECT user_id, COUNT(*) AS sessions, CAST(SUM(packets) AS BIGINT) AS packets, MIN(packets) AS fewest, MAX(packets) AS most, 'accepted' AS status FROM s GROUP BY 1",
    "flow_sessions": _FLOW_SQL,
    "time_inversions": f"WITH {_TCP_SQL}, i AS (SELECT capture_id, us < lag(us) OVER (PARTITION BY capture_id ORDER BY packet_id) AS e FROM tp) SELECT capture_id, CAST(SUM(CASE WHEN e THEN 1 ELSE 0 END) AS BIGINT) AS inversions FROM i GROUP BY 1",
    "rebase_time": f"WITH {_TCP_SQL} SELECT packet_id, us - MIN(us) OVER (PARTITION BY source_ip, source_port) + 1000000 AS rebased_us FROM tp",
    "first_k_packets": f"WITH {_TCP_SQL} SELECT * FROM (SELECT packet_id, row_number() OVER (PARTITION BY source_ip, source_port ORDER BY us, packet_id) AS place FROM tp) WHERE place<=50",
    "first_payload_trim": f"""WITH {_TCP_SQL}, f AS (SELECT source_ip, source_port, MIN(packet_id) AS f FROM tp WHERE payload_length>0 GROUP BY 1,2)
 SELECT source_ip, source_port, COUNT(*) AS kept, MIN(packet_id) AS first_id FROM tp JOIN f USING (source_ip, source_port) WHERE packet_id>=f GROUP BY 1,2""",
    "flag_mask_roundtrip": f"WITH {_TCP_SQL} SELECT flags, COUNT(*) AS packets, {_FLAGS_SQL} AS pattern, flags AS back FROM tp GROUP BY flags",
    "unordered_pair_key": f"WITH {OBS_SQL} SELECT pair_id, left_side||'|'||right_side AS unordered_configuration_key FROM pairs",
    "position_contiguity": f"""WITH {OBS_SQL} SELECT protocol_id, configuration_id, class_name, session_view_index, MIN(position) AS lo, MAX(position) AS hi, COUNT(DISTINCT position) AS n FROM obs WHERE frame_length_bytes>=ip_total_length_bytes GROUP BY ALL
 HAVING MIN(position)<>1 OR MAX(position)<>COUNT(DISTINCT position)""",
    "observation_rules": " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", COUNT(*)=0 AS passed, COUNT(*) AS observed, CAST(0 AS BIGINT) AS expected FROM packet_observations WHERE {c}" for n, c in _OBS_RULES_SQL.items()
    ),
    "iat_rules": """SELECT CASE WHEN iat_us<0 THEN 'negative' WHEN position=1 AND iat_us IS NOT NULL THEN 'first_has_value' WHEN position>1 AND iat_us IS NULL THEN 'missing' ELSE 'ok' END AS state, COUNT(*) AS rows
 FROM packet_observations GROUP BY 1""",
    "first_five_features": _FIVE_SQL,
    "matrix_jobs": f"{_CELLS_SQL} SELECT * FROM jobs",
    "preprocess_jobs": f"{_CELLS_SQL} SELECT 'prep_'||model||'_'||source_configuration_id AS job_id, model, source_configuration_id FROM mo CROSS JOIN (SELECT DISTINCT source_configuration_id FROM cells)",
    "training_jobs": f"{_CELLS_SQL} SELECT 'train_'||model||'_'||source_configuration_id AS job_id, model, source_configuration_id, '{','.join(map(str, SEEDS))}' AS seeds FROM mo CROSS JOIN (SELECT DISTINCT source_configuration_id FROM cells)",
    "routing_default": f"{_CELLS_SQL} SELECT model, evaluation_kind, recipe, COUNT(*) AS jobs FROM jobs GROUP BY ALL",
    "group_commands": f"{_CELLS_SQL} SELECT model, source_configuration_id, COUNT(*) AS jobs, string_agg(job_id, ' ' ORDER BY cell_ordinal, seed_ordinal) AS job_list FROM jobs GROUP BY ALL",
    "cross_product_coverage": """WITH d AS (SELECT DISTINCT direction FROM packet_observations WHERE direction IS NOT NULL), f AS (SELECT DISTINCT tcp_flag_pattern FROM packet_observations WHERE tcp_flag_pattern IS NOT NULL),
 t AS (SELECT DISTINCT ipv4_ttl FROM packet_observations WHERE ipv4_ttl IS NOT NULL), h AS (SELECT DISTINCT direction, tcp_flag_pattern, ipv4_ttl FROM packet_observations)
 SELECT direction, tcp_flag_pattern, ipv4_ttl, 'missing' AS state FROM d CROSS JOIN f CROSS JOIN t ANTI JOIN h USING (direction, tcp_flag_pattern, ipv4_ttl)""",
    "cohort_day_coverage": """WITH o AS (SELECT protocol_id, upper(replace(trim(configuration_id),'_','-')) AS configuration_id, rtrim(lower(trim(class_name)),'.') AS class_name, capture_day FROM packet_observations),
 k AS (SELECT protocol_id, configuration_id, class_name, capture_day, COUNT(*) AS n FROM o GROUP BY ALL),
 c AS (SELECT DISTINCT protocol_id, configuration_id FROM o WHERE configuration_id IS NOT NULL), l AS (SELECT DISTINCT protocol_id, class_name FROM o WHERE class_name IS NOT NULL), d AS (SELECT DISTINCT protocol_id, capture_day FROM o WHERE capture_day IS NOT NULL),
 p AS (SELECT protocol_id, configuration_id, class_name, capture_day FROM c JOIN l USING (protocol_id) JOIN d USING (protocol_id))
 SELECT *, 'missing' AS state FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.protocol_id=p.protocol_id AND k.configuration_id=p.configuration_id AND k.class_name=p.class_name AND k.capture_day=p.capture_day)
 UNION ALL SELECT protocol_id, configuration_id, class_name, capture_day, CASE WHEN protocol_id IS NULL OR configuration_id IS NULL OR class_name IS NULL OR capture_day IS NULL THEN 'unexpected' ELSE 'repeated' END FROM k
 WHERE n>1 OR protocol_id IS NULL OR configuration_id IS NULL OR class_name IS NULL OR capture_day IS NULL""",
    "triple_optional_group_concat": """SELECT 'n'||n_nationkey AS s, n_name AS name, MIN(CASE WHEN r_name<>'ASIA' THEN r_name END) AS stream, coalesce(string_agg(DISTINCT s_name, ' ' ORDER BY s_name),'') AS authors
 FROM nation LEFT JOIN region ON n_regionkey=r_regionkey LEFT JOIN supplier ON s_nationkey=n_nationkey AND s_acctbal>0 GROUP BY ALL""",
    "cohort_reconciliation": f"""WITH {OBS_SQL} SELECT protocol_id, configuration_id, class_name, COUNT(*) AS sessions, CAST(SUM(n) AS BIGINT) AS packets, MIN(n) AS min_packets, MAX(n) AS max_packets
 FROM (SELECT protocol_id, configuration_id, class_name, session_view_index, COUNT(*) AS n FROM obs GROUP BY ALL) GROUP BY ALL""",
    "selection_summary": """SELECT configuration_id, class_name, COUNT(DISTINCT session_id) AS sessions, COUNT(DISTINCT parent_group_id) AS parents, COUNT(DISTINCT CASE WHEN lower(trim(split))='train' THEN session_id END) AS train,
 COUNT(DISTINCT CASE WHEN lower(trim(split))='validation' THEN session_id END) AS validation, COUNT(DISTINCT CASE WHEN lower(trim(split))='test' THEN session_id END) AS test FROM session_manifest GROUP BY ALL""",
}
