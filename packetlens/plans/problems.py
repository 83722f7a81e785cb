"""The queries of the general problems (2, 4, 5) over the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.operators.packed import unpack_values
from packetlens.operators.references import canonical_id, list_references, orphan_references, orphan_report
from packetlens.operators.sessions import packet_sessions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with first and last packet, start, end, duration and packet count."""
    s = packet_sessions(table(spark, sf_dir, "tcp_packets"))
    return s.select(
        "source_ip",
        "source_port",
        F.col("first_event").alias("first_packet_id"),
        F.col("last_event").alias("last_packet_id"),
        "session_start_us",
        "session_end_us",
        "duration_us",
        F.col("event_count").alias("packet_count"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_sessions(spark, sf_dir).select("first_packet_id", "last_packet_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id held in the three list fields, with its place."""
    rq2 = unpack_values(
        table(spark, sf_dir, "rq2_paper_summary"),
        fields=["holdout_design_ids", "not_documented_design_ids"],
        row_key="rq2_paper_summary_id",
        source_table="rq2_paper_summary",
    )
    fixes = unpack_values(
        table(spark, sf_dir, "structural_corrections"),
        fields=["public_entity_ids"],
        row_key="normalization_id",
        source_table="structural_corrections",
    )
    return rq2.unionByName(fixes)


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that a reference can name, with the time it exists."""
    kinds = {
        "publication": ("publications", "record_id"),
        "design": ("evaluation_designs", "design_id"),
        "scheme": ("class_schemes", "scheme_id"),
        "dataset": ("canonical_datasets", "dataset_id"),
        "evidence": ("evidence", "evidence_id"),
    }
    parts = [
        table(spark, sf_dir, t).select(
            F.lit(kind).alias("kind"), canonical_id(F.col(key)).alias("id"), "recorded_at", "withdrawn_at"
        )
        for kind, (t, key) in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rq2 = table(spark, sf_dir, "rq2_paper_summary")
    fixes = table(spark, sf_dir, "structural_corrections")
    refs = list_references(
        rq2.withColumn("paper_id", canonical_id(F.col("paper_id"))),
        source_table="rq2_paper_summary",
        row_key="rq2_paper_summary_id",
        fields={"paper_id": F.lit("publication"), "holdout_design_ids": F.lit("design")},
        at="recorded_at",
    ).unionByName(
        list_references(
            fixes,
            source_table="structural_corrections",
            row_key="normalization_id",
            fields={"public_entity_ids": F.lower(F.trim("entity_type")), "evidence_ids": F.lit("evidence")},
            at="recorded_at",
        )
    )
    return orphan_references(
        refs,
        _existing(spark, sf_dir),
        ref_keys=["target", "ref_id"],
        target_keys=["kind", "id"],
        match="partial",
        at="at",
        valid_from="recorded_at",
        valid_to="withdrawn_at",
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that named no record existing when their row was recorded."""
    return _orphans(spark, sf_dir).select("source_table", "row_key", "field_name", "ref_id").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field and month of ``recorded_at``."""
    return orphan_report(
        _orphans(spark, sf_dir).dropDuplicates(["source_table", "row_key", "field_name", "ref_id"]),
        by=["source_table", "field_name"],
        period="at",
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_sessions": p2_sessions,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_report": p5_report,
}


# Oracle SQL.  Quoted values are matched whole, unquoted ones up to the next separator.
_TOKEN = r"""'"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^''"\s|;,/&+·•；，、｜／()\[\]{}<>（）［］【】]+'"""
_VALUE = """trim(CASE WHEN x LIKE '"%' THEN replace(substr(x,2,length(x)-2),'""','"') WHEN x LIKE '''%' THEN replace(substr(x,2,length(x)-2),'''''','''') ELSE x END)"""


def _values_sql(fields: list[tuple[str, str, str]], extra: str = "") -> str:
    """CTE ``val``: every value of (table, key, field) with its place."""
    more = f", {extra}" if extra else ""
    src = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS source_table, {k} AS row_key, '{f}' AS field_name, {f} AS t{more} FROM {t}" for t, k, f in fields
    )
    return (
        f"src AS ({src}), tok AS (SELECT * EXCLUDE (l, t), UNNEST(l) AS x, generate_subscripts(l,1) AS n FROM (SELECT *, regexp_extract_all(t,{_TOKEN}) AS l FROM src)),\n"
        f"val AS (SELECT * EXCLUDE (x), {_VALUE} AS item FROM tok)"
    )


_RQ2, _FIX = ("rq2_paper_summary", "rq2_paper_summary_id"), ("structural_corrections", "normalization_id")
_P4_SQL = f"""WITH {_values_sql([(*_RQ2, "holdout_design_ids"), (*_RQ2, "not_documented_design_ids"), (*_FIX, "public_entity_ids")])}
SELECT source_table, row_key, field_name, CAST(row_number() OVER (PARTITION BY source_table, row_key, field_name ORDER BY n) AS INTEGER) AS item_no, item FROM val WHERE item<>''"""
_TARGETS_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, upper(trim({key})) AS id, recorded_at AS a, withdrawn_at AS z FROM {t}"
    for kind, t, key in (
        ("publication", "publications", "record_id"), ("design", "evaluation_designs", "design_id"), ("scheme", "class_schemes", "scheme_id"),
        ("dataset", "canonical_datasets", "dataset_id"), ("evidence", "evidence", "evidence_id"),
    )
)
_P5_SQL = f"""WITH {_values_sql([(*_RQ2, "holdout_design_ids")], "recorded_at, 'design' AS kind")},
src2 AS (SELECT DISTINCT 'structural_corrections' AS source_table, normalization_id AS row_key, f AS field_name, t, recorded_at, kind FROM
 (SELECT *, 'public_entity_ids' AS f, public_entity_ids AS t, lower(trim(entity_type)) AS kind FROM structural_corrections UNION ALL SELECT *, 'evidence_ids', evidence_ids, 'evidence' FROM structural_corrections)),
val2 AS (SELECT source_table, row_key, field_name, recorded_at, kind, {_VALUE} AS item FROM (SELECT *, UNNEST(regexp_extract_all(t,{_TOKEN})) AS x FROM src2)),
ref AS (SELECT source_table, row_key, field_name, recorded_at, kind, upper(item) AS ref_id FROM val WHERE item<>'' UNION SELECT source_table, row_key, field_name, recorded_at, kind, upper(item) FROM val2 WHERE item<>''
 UNION SELECT 'rq2_paper_summary', rq2_paper_summary_id, 'paper_id', recorded_at, 'publication', upper(trim(paper_id)) FROM rq2_paper_summary WHERE trim(paper_id)<>''),
tgt AS ({_TARGETS_SQL}),
orphan AS (SELECT * FROM ref WHERE NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.kind=ref.kind AND tgt.id=ref.ref_id AND tgt.a<=ref.recorded_at AND (tgt.z IS NULL OR tgt.z>ref.recorded_at)))"""
_P2_SQL = r"""WITH p AS (SELECT DISTINCT packet_id, regexp_replace(regexp_replace(lower(trim(source_ip)),'^::ffff:',''),'(^|\.)0+([0-9])','\1\2','g') AS source_ip, source_port,
 epoch_us(captured_at) AS us, (flags&2)<>0 AND (flags&16)=0 AS syn, sequence FROM tcp_packets WHERE source_ip IS NOT NULL AND source_port IS NOT NULL),
g AS (SELECT *, coalesce(us-lag(us) OVER w>60000000,TRUE) AS gap FROM p WINDOW w AS (PARTITION BY source_ip, source_port ORDER BY us, packet_id)),
b AS (SELECT *, SUM(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip, source_port ORDER BY us, packet_id ROWS UNBOUNDED PRECEDING) AS block FROM g),
s AS (SELECT *, last_value(CASE WHEN syn THEN sequence END IGNORE NULLS) OVER (PARTITION BY source_ip, source_port, block ORDER BY us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b),
n AS (SELECT *, SUM(CASE WHEN gap OR (syn AND (prev IS NULL OR prev<>sequence)) THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip, source_port ORDER BY us, packet_id ROWS UNBOUNDED PRECEDING) AS ses FROM s),
r AS (SELECT source_ip, source_port, arg_min(packet_id, (us, packet_id)) AS first_packet_id, arg_max(packet_id, (us, packet_id)) AS last_packet_id, MIN(us) AS session_start_us, MAX(us) AS session_end_us,
 MAX(us)-MIN(us) AS duration_us, COUNT(*) AS packet_count FROM n GROUP BY source_ip, source_port, ses)"""

ORACLE = {
    "p2_found": f"{_P2_SQL} SELECT first_packet_id, last_packet_id FROM r",
    "p2_sessions": f"{_P2_SQL} SELECT * FROM r",
    "p4_found": _P4_SQL,
    "p5_found": f"{_P5_SQL} SELECT DISTINCT source_table, row_key, field_name, ref_id FROM orphan",
    "p5_report": f"""{_P5_SQL} SELECT source_table, field_name, CAST(date_trunc('month', recorded_at) AS DATE) AS period, COUNT(*) AS orphans FROM
 (SELECT DISTINCT source_table, row_key, field_name, ref_id, recorded_at FROM orphan) GROUP BY ALL""",
}
