"""Queries over captures: packets of the tables are written as captures and read back, cut into
sessions, named, sanitised and trimmed; oracle SQL reads the same from the tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from packetlens.functions import text as T
from packetlens.operators import captures as C
from packetlens.operators import flows
from packetlens.plans.observations import table
from packetlens.plans.packets import _TCP_SQL, _tcp

KEY, LABEL, PLACES = b"masking key", "host.example", 50


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tcp(spark, sf_dir).where("capture_id is not null and destination_ip is not null and destination_port is not null")


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.captures_from_packets(_packets(spark, sf_dir), path="capture_id", order=["us", "packet_id"])


def capture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet as read back from its capture."""
    p = C.capture_packets(_captures(spark, sf_dir))
    return p.where("error is null").select(
        F.col("path").alias("capture_id"), "record_index", "timestamp_us", "source_ip", "source_port", "destination_ip", "destination_port",
        "sequence", "flags", "payload_length",
    )


def capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each capture by flow and fresh openings, each a capture of its own."""
    s = C.session_captures(_captures(spark, sf_dir), version="v1")
    return s.select(
        F.col("path").alias("capture_id"), "session_id", "ordinal", "first_record", "packets", F.length("content").cast("long").alias("bytes")
    )


def capture_session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, packets and skipped records per capture, with its status."""
    s = C.session_report(C.session_captures(_captures(spark, sf_dir), version="v1"))
    return s.select(F.col("path").alias("capture_id"), "sessions", "tcp_packets", "skipped", "status")


@F.pandas_udf(ArrayType(BinaryType()))
def _hello_parts(hosts: pd.Series) -> pd.Series:
    """A ClientHello that offers the host, cut into two segments."""

    def build(host: str) -> list[bytes]:
        name = host.encode()
        entry = struct.pack("!HBH", len(name) + 3, 0, len(name)) + name
        extensions = struct.pack("!HH", 0, len(entry)) + entry
        body = b"\x03\x03" + bytes(32) + b"\0" + b"\0\2\x13\x01" + b"\1\0" + struct.pack("!H", len(extensions)) + extensions
        hello = b"\1" + len(body).to_bytes(3, "big") + body
        record = b"\x16\x03\x01" + struct.pack("!H", len(hello)) + hello
        return [record[:20], record[20:]]

    return hosts.map(build)


def capture_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server names in the captures of manifest records, whose hello comes in two segments in
    the wrong order, one of them twice."""
    host = T.normalize_host(F.try_parse_url(F.col("url"), F.lit("HOST")))
    m = table(spark, sf_dir, "session_manifest").select(F.col("record_no").cast("string").alias("path"), host.alias("host"))
    m = m.where("host is not null and path is not null").distinct()
    parts = m.select("path", "host", F.posexplode(F.transform(F.array(F.lit(1), F.lit(0), F.lit(1)), lambda i: i)).alias("at", "part"))
    parts = parts.withColumn("body", F.element_at(_hello_parts("host"), F.col("part") + 1)).select(
        "path", F.col("at").cast("long").alias("us"), F.lit("10.0.0.1").alias("source_ip"), F.lit(50_000).alias("source_port"),
        F.lit("10.0.0.2").alias("destination_ip"), F.lit(443).alias("destination_port"),
        F.when(F.col("part") == 0, 1000).otherwise(1020).cast("long").alias("sequence"), F.lit(24).alias("flags"), "body",
    )
    named = C.capture_names(C.captures_from_packets(parts, path="path", order=["us"], payload="body"))
    return named.select(F.col("path").cast("long").alias("record_no"), F.array_join("server_names", ";").alias("server_names"))


def _flow_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per capture and flow, under a campaign's folder."""
    p = _packets(spark, sf_dir)
    key = flows.endpoint_key("source_ip", "source_port", "destination_ip", "destination_port")
    p = p.withColumn("path", F.concat_ws("/", F.lit("2024"), "capture_id", key))
    c = C.captures_from_packets(p, path="path", order=["us", "packet_id"])
    return c.withColumn("relative", F.col("path")).withColumn("label", F.lit(LABEL))


def _sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sanitize_captures(_flow_captures(spark, sf_dir), key=KEY, relative="relative", label="label", max_packets=PLACES)


def sanitized_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets kept and dropped of every flow's capture; flows without payload fail."""
    return _sanitized(spark, sf_dir).select(
        "path", "input_packets", "output_packets", "dropped_tcp_handshake", "dropped_tls_handshake", "timestamp_inversions",
        "retained_indices", F.col("error").isNotNull().alias("failed"),
    )


def _trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _sanitized(spark, sf_dir).where("error is null").withColumn("relative", F.col("path"))
    return C.trim_captures(clean, relative="relative", indices="retained_indices")


def trimmed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures from their first payload on; those with anything but acknowledgements before it fail."""
    return _trimmed(spark, sf_dir).select(
        "path", "input_packets", "output_packets", "leading_ack_removed", "removed_indices", F.col("error").isNotNull().alias("failed")
    )


def sanitize_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sanitize_report(_sanitized(spark, sf_dir)).select(
        "captures", "errors", "input_packets", "output_packets", "dropped_tcp_handshake", "min_output_packets", "max_output_packets"
    )


def payload_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.payload_positions(_trimmed(spark, sf_dir))


def sanitized_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sanitised capture tells of its packets: times from the anchor, sequence numbers and
    ports as differences inside the flow, checksums valid by construction of the reader."""
    clean = _sanitized(spark, sf_dir).where("error is null").select("path", "content")
    p = C.capture_packets(clean).where("error is null")
    w = Window.partitionBy("path", "source_ip")  # at most PLACES packets
    step = F.pmod(F.col("sequence") - F.min(F.struct("record_index", "sequence")).over(w)["sequence"], F.lit(1 << 32))
    return p.select(
        "path", "record_index", (F.col("timestamp_us") - 1_705_276_800_000_000).alias("since_first_us"), step.alias("sequence_step"),
        F.size(F.collect_set("source_port").over(w)).cast("long").alias("ports"), "flags", "payload_length",
    )


def capture_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures against a manifest with planted faults, told by the length of the packet count:
    a wrong digest, a missing file, an unlisted one, no digest, an unsafe path."""
    files = _captures(spark, sf_dir)
    counts = _packets(spark, sf_dir).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
    fault = F.col("n") % 7
    listed = files.join(counts, files["path"] == counts["capture_id"]).where(fault != 0).select(
        F.when(fault == 1, F.concat(F.lit("gone/"), "path")).when(fault == 2, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("pcap_path"),
        F.when(fault == 3, F.lit("0" * 64)).when(fault == 4, F.lit(None)).otherwise(F.sha2("content", 256)).alias("pcap_sha256"),
    )
    b = C.bound_to_manifest(files, listed, path="pcap_path", digest="pcap_sha256")
    return b.select(F.col("pcap_path").alias("path"), "binding")


QUERIES = {
    f.__name__: f
    for f in (
        capture_packets, capture_sessions, capture_session_report, capture_hosts, sanitized_flows, sanitized_packets, trimmed_flows,
        sanitize_totals, payload_positions, capture_binding,
    )
}

_CAP = f"""WITH {_TCP_SQL}, pk AS (SELECT * FROM tp WHERE capture_id IS NOT NULL AND destination_ip IS NOT NULL AND destination_port IS NOT NULL),
ix AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY us, packet_id)-1 AS i, least(source_ip||':'||source_port,destination_ip||':'||destination_port)||'-'||greatest(source_ip||':'||source_port,destination_ip||':'||destination_port) AS fl,
 (flags&2)<>0 AND (flags&16)=0 AS syn FROM pk)"""
_SES = f"""{_CAP}, pv AS (SELECT *, row_number() OVER w AS n, last_value(CASE WHEN syn THEN sequence END IGNORE NULLS) OVER (PARTITION BY capture_id, fl ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tok FROM ix WINDOW w AS (PARTITION BY capture_id, fl ORDER BY i)),
st AS (SELECT *, SUM(CASE WHEN n=1 OR (syn AND tok IS DISTINCT FROM sequence) THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, fl ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM pv),
ss AS (SELECT capture_id, MIN(i) AS first_record, COUNT(*) AS packets, 24+SUM(16+greatest(60,54+payload_length)) AS bytes FROM st GROUP BY capture_id, fl, k),
so AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY first_record) AS ordinal FROM ss)"""
_ENDS = "source_ip, source_port, destination_ip, destination_port"
_SAN = f"""WITH {_TCP_SQL}, pk AS (SELECT *, '2024/'||capture_id||'/'||least(source_ip||':'||source_port,destination_ip||':'||destination_port)||'-'||greatest(source_ip||':'||source_port,destination_ip||':'||destination_port) AS path FROM tp WHERE capture_id IS NOT NULL AND destination_ip IS NOT NULL AND destination_port IS NOT NULL),
ix AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY us, packet_id)-1 AS i, (flags&2)<>0 AS drp FROM pk),
kp AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY us, i)-1 AS j FROM ix WHERE NOT drp QUALIFY j<{PLACES}),
ok AS (SELECT path, COUNT(*) AS output_packets, string_agg(i, ',' ORDER BY j) AS retained_indices, MIN(CASE WHEN payload_length>0 THEN j END) AS fp, MIN(us) AS t0 FROM kp GROUP BY path HAVING MAX(payload_length)>0),
al AS (SELECT path, COUNT(*) AS input_packets, SUM(CASE WHEN drp THEN 1 ELSE 0 END) AS drops FROM ix GROUP BY path),
sn AS (SELECT path, CASE WHEN ok.path IS NOT NULL THEN input_packets END AS input_packets, output_packets, CASE WHEN ok.path IS NOT NULL THEN drops END AS dropped_tcp_handshake, ok.path IS NULL AS failed, retained_indices FROM al LEFT JOIN ok USING (path)),
tr AS (SELECT ok.path, output_packets AS n, fp, COUNT(*) FILTER (WHERE j<fp AND flags<>16) AS bad, string_agg(CASE WHEN j<fp THEN i END, ',' ORDER BY j) AS rem FROM ok JOIN kp USING (path) GROUP BY ALL),
tm AS (SELECT path, CASE WHEN bad=0 THEN n END AS input_packets, CASE WHEN bad=0 THEN n-fp END AS output_packets, CASE WHEN bad=0 THEN fp END AS leading_ack_removed, CASE WHEN bad=0 THEN coalesce(rem,'') END AS removed_indices, bad>0 AS failed FROM tr)"""


def _host_sql() -> str:
    from packetlens.plans.audit import _HOST_SQL

    return rf"nullif(regexp_replace(lower({_HOST_SQL}),'\.+$',''),'')"


ORACLE = {
    "capture_packets": f"{_CAP} SELECT capture_id, CAST(i AS INTEGER) AS record_index, us AS timestamp_us, {_ENDS}, sequence, flags, payload_length FROM ix",
    "capture_sessions": f"""{_SES} SELECT capture_id, 'session_'||substr(sha256('v1'||chr(0)||capture_id||chr(0)||ordinal),1,24) AS session_id, CAST(ordinal AS INTEGER) AS ordinal,
 CAST(first_record AS INTEGER) AS first_record, CAST(packets AS INTEGER) AS packets, CAST(bytes AS BIGINT) AS bytes FROM so""",
    "capture_session_report": f"{_SES} SELECT capture_id, COUNT(*) AS sessions, CAST(SUM(packets) AS BIGINT) AS tcp_packets, 0 AS skipped, 'accepted' AS status FROM so GROUP BY 1",
    "capture_hosts": f"SELECT DISTINCT record_no, {_host_sql()} AS server_names FROM session_manifest WHERE record_no IS NOT NULL AND {_host_sql()} IS NOT NULL",
    "sanitized_flows": f"""{_SAN} SELECT path, CAST(input_packets AS INTEGER) AS input_packets, CAST(output_packets AS INTEGER) AS output_packets, CAST(dropped_tcp_handshake AS INTEGER) AS dropped_tcp_handshake,
 CASE WHEN NOT failed THEN 0 END AS dropped_tls_handshake, CASE WHEN NOT failed THEN 0 END AS timestamp_inversions, retained_indices, failed FROM sn""",
    "sanitized_packets": f"""{_SAN}, f AS (SELECT path, source_ip, arg_min(sequence, j) AS s0 FROM kp SEMI JOIN ok USING (path) GROUP BY ALL)
 SELECT path, CAST(j AS INTEGER) AS record_index, us-t0 AS since_first_us, (sequence-s0+4294967296)%4294967296 AS sequence_step, CAST(1 AS BIGINT) AS ports, flags, payload_length FROM kp JOIN ok USING (path) JOIN f USING (path, source_ip)""",
    "trimmed_flows": f"""{_SAN} SELECT path, CAST(input_packets AS INTEGER) AS input_packets, CAST(output_packets AS INTEGER) AS output_packets, CAST(leading_ack_removed AS INTEGER) AS leading_ack_removed, removed_indices, failed FROM tm""",
    "sanitize_totals": f"""{_SAN} SELECT COUNT(*) AS captures, SUM(CASE WHEN failed THEN 1 ELSE 0 END)::BIGINT AS errors, SUM(input_packets)::BIGINT AS input_packets, SUM(output_packets)::BIGINT AS output_packets,
 SUM(dropped_tcp_handshake)::BIGINT AS dropped_tcp_handshake, MIN(output_packets)::INTEGER AS min_output_packets, MAX(output_packets)::INTEGER AS max_output_packets FROM sn""",
    "payload_positions": f"{_SAN} SELECT CAST(leading_ack_removed AS INTEGER) AS leading_ack_removed, COUNT(*) AS captures FROM tm WHERE NOT failed GROUP BY 1",
    "capture_binding": f"""{_CAP}, n AS (SELECT capture_id, COUNT(*)%7 AS f FROM pk GROUP BY 1)
 SELECT CASE f WHEN 1 THEN 'gone/'||capture_id WHEN 2 THEN '../'||capture_id ELSE capture_id END AS path, ['unlisted','missing','unsafe_path','hash_mismatch','partial','ok','ok'][f+1] AS binding FROM n
 UNION ALL SELECT capture_id, 'unlisted' FROM n WHERE f IN (1,2)""",
}
