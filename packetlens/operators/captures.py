"""Capture files as DataFrames: one row per file in, packets, sessions or reports out.

A capture is one value of a ``binaryFile`` row.  Arrow batches are kept small so that a task
holds few captures at once; bytes are shuffled nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.functions import frames, sanitize

PACKET_SCHEMA = (
    "path string, record_index int, timestamp_us long, source_ip string, source_port int, destination_ip string, "
    "destination_port int, sequence long, flags int, payload_length int, ip_family int, error string"
)
SESSION_SCHEMA = "path string, session_id string, ordinal int, first_record int, packets int, skipped int, content binary, error string"
NAME_SCHEMA = "path string, server_names array<string>, error string"
SANITIZED_SCHEMA = (
    "path string, sanitized_path string, content binary, source_sha256 string, sanitized_sha256 string, input_packets int, "
    "output_packets int, family string, repaired_lengths int, timestamp_inversions int, timestamp_shift_us long, "
    "dropped_tcp_handshake int, dropped_tls_handshake int, dropped_union int, plaintext_bytes_removed int, "
    "masked_retained_bytes int, handshake_not_observed boolean, retained_indices string, dropped_indices string, error string"
)
TRIMMED_SCHEMA = (
    "path string, content binary, output_sha256 string, input_packets int, output_packets int, leading_ack_removed int, "
    "timestamp_shift_us long, retained_indices string, removed_indices string, error string"
)


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of all ``*.pcap`` files below a folder, resource forks left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pcap").load(folder)
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("._")).select("path", "content")


def _each(captures: DataFrame, schema: str, rows_of: Callable[[tuple], Iterable[dict]], columns: list[str]) -> DataFrame:
    """Rows of every capture; one that cannot be read gives a row with its ``error``."""
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[list] = []
            for row in pdf.itertuples(index=False):
                try:
                    found = list(rows_of(row))
                except (frames.CaptureError, ValueError, IndexError) as problem:
                    found = [{"error": str(problem)}]
                out += [[row[0] if n == "path" else r.get(n) for n in names] for r in found]
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)

    return captures.select(*columns).mapInPandas(run, schema)


def _address(raw: bytes) -> str:
    import ipaddress

    return str(ipaddress.ip_address(raw))


def capture_packets(captures: DataFrame) -> DataFrame:
    """TCP headers of every record, payload bytes left behind; records that are not TCP give a
    row with the reason in ``error``."""

    def rows(row):
        for r in frames.read_records(bytes(row[1])):
            try:
                p = frames.decode_tcp(r.frame)
            except (frames.CaptureError, IndexError) as problem:
                yield {"record_index": r.index, "timestamp_us": r.timestamp_us, "error": str(problem)}
                continue
            yield {
                "record_index": r.index, "timestamp_us": r.timestamp_us, "source_ip": _address(p.source), "source_port": p.source_port,
                "destination_ip": _address(p.target), "destination_port": p.target_port, "sequence": p.sequence,
                "flags": p.flags, "payload_length": len(p.payload), "ip_family": p.family,
            }

    return _each(captures, PACKET_SCHEMA, rows, ["path", "content"])


def session_captures(captures: DataFrame, *, version: str, parent: str = "path") -> DataFrame:
    """One capture per session with its token; see :func:`frames.capture_sessions`."""
    import hashlib

    def rows(row):
        found, skipped = frames.capture_sessions(bytes(row[1]))
        for s in found:
            token = hashlib.sha256(f"{version}\0{row[2]}\0{s['ordinal']}".encode()).hexdigest()[:24]
            yield {**s, "session_id": f"session_{token}", "skipped": skipped}

    named = captures.select("path", "content", F.col(parent).alias("__parent"))
    return _each(named, SESSION_SCHEMA, rows, ["path", "content", "__parent"])


def session_report(sessions: DataFrame) -> DataFrame:
    """Per parent capture: sessions, packets, skipped records and status."""
    ok = F.col("session_id").isNotNull()
    return sessions.groupBy("path").agg(
        F.sum(ok.cast("long")).alias("sessions"), F.coalesce(F.sum("packets"), F.lit(0)).cast("long").alias("tcp_packets"),
        F.max("skipped").alias("skipped"), F.max("error").alias("error"),
    ).withColumn(
        "status", F.when(F.col("error").isNotNull(), "skipped_rejected_capture").when(F.col("sessions") > 0, "accepted").otherwise("rejected_no_tcp_sessions")
    )


def capture_names(captures: DataFrame) -> DataFrame:
    """Server names offered in every capture, sorted and distinct."""
    return _each(captures, NAME_SCHEMA, lambda row: [{"server_names": frames.server_names(bytes(row[1]))}], ["path", "content"])


def annotate(named: DataFrame, allowed: DataFrame, *, size: str, minimum: int, scheduled: str | None = None) -> DataFrame:
    """Class by full server name, or the first reason against it: size, no name, several names,
    name not allowed, another class than scheduled.  ``allowed`` has ``host, class_name``."""
    one = F.when(F.size("server_names") == 1, F.col("server_names")[0])
    found = named.withColumn("host", one).join(allowed.select("host", F.col("class_name").alias("annotated_class")), "host", "left")
    reason = F.when(F.col(size) < minimum, "below_minimum_session_bytes").when(F.size("server_names") == 0, "no_sni").when(
        F.size("server_names") > 1, "ambiguous_sni"
    ).when(F.col("annotated_class").isNull(), "sni_not_allowlisted")
    if scheduled:
        reason = reason.when(F.col("annotated_class") != F.col(scheduled), "scheduled_class_mismatch")
    reason = reason.otherwise("")
    return found.withColumn("rejection_reason", reason).withColumn("status", F.when(reason == "", "accepted").otherwise("rejected"))


def sanitize_captures(captures: DataFrame, *, key: bytes, relative: str, label: str, max_packets: int = 50) -> DataFrame:
    """Sanitised capture and report per row; ``relative`` and ``label`` are columns with the
    path within the campaign tree and the name to mask."""
    import hashlib

    def rows(row):
        path = row[2]
        folder, _, _ = path.rpartition("/")
        neutral = f"sample_{hashlib.sha256(path.encode()).hexdigest()[:24]}.pcap"
        out = sanitize.sanitize(bytes(row[1]), key=key, label=row[3], anchor_us=sanitize.campaign_anchor(path), max_packets=max_packets)
        yield {**out, "sanitized_path": f"{folder}/{neutral}" if folder else neutral}

    return _each(captures, SANITIZED_SCHEMA, rows, ["path", "content", relative, label])


def trim_captures(captures: DataFrame, *, relative: str, indices: str) -> DataFrame:
    """Payload-start form of sanitised captures; see :func:`sanitize.trim_to_payload`."""

    def rows(row):
        yield sanitize.trim_to_payload(bytes(row[1]), indices=row[3] or "", anchor_us=sanitize.campaign_anchor(row[2]))

    return _each(captures, TRIMMED_SCHEMA, rows, ["path", "content", relative, indices])


def sanitize_report(rows: DataFrame) -> DataFrame:
    """Totals of sanitised captures, and failures by reason in ``errors``."""
    sums = [c for c in ("input_packets", "output_packets", "dropped_tcp_handshake", "dropped_tls_handshake", "dropped_union",
                        "plaintext_bytes_removed", "masked_retained_bytes", "repaired_lengths", "timestamp_inversions") if c in rows.columns]
    return rows.agg(
        F.count(F.lit(1)).alias("captures"), F.count("error").alias("errors"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        F.min("output_packets").alias("min_output_packets"), F.max("output_packets").alias("max_output_packets"),
    )


def payload_positions(trimmed: DataFrame) -> DataFrame:
    """Histogram of how many leading acknowledgements were removed, in numeric order."""
    return trimmed.where("error is null").groupBy("leading_ack_removed").agg(F.count(F.lit(1)).alias("captures")).orderBy("leading_ack_removed")


def bound_to_manifest(captures: DataFrame, manifest: DataFrame, *, path: str, digest: str) -> DataFrame:
    """Files and manifest rows side by side, ``binding`` saying how they agree: ``ok``,
    ``missing`` (no such file), ``hash_mismatch``, ``partial`` (path or digest not given),
    ``unsafe_path`` (absolute, or with ``..``) or ``unlisted`` (a file that no row names; its
    path stands in ``path``, all other columns are NULL)."""
    have = captures.select(F.col("path").alias("__file"), F.sha2("content", 256).alias("__d"))
    j = manifest.join(have, manifest[path] == F.col("__file"), "full")
    p, d = F.col(path), F.col(digest)
    state = (
        F.when(p.isNull() & d.isNull() & F.col("__file").isNotNull(), "unlisted").when(p.isNull() | d.isNull(), "partial")
        .when(p.startswith("/") | F.array_contains(F.split(p, "/"), ".."), "unsafe_path")
        .when(F.col("__file").isNull(), "missing").when(F.col("__d") != d, "hash_mismatch").otherwise("ok")
    )
    return j.withColumn("binding", state).withColumn(path, F.coalesce(path, "__file")).drop("__d", "__file")


def captures_from_packets(packets: DataFrame, *, path: str, order: list[str], payload: str | None = None) -> DataFrame:
    """``path, content``: one capture per ``path`` of packets ``us, source_ip, source_port,
    destination_ip, destination_port, sequence, flags`` and ``payload_length`` (zeros) or the
    bytes in ``payload``.  Addresses are IPv4.  A capture is one value, so the packets of a path
    meet in one task."""
    body = F.col(payload) if payload else F.lit(None).cast("binary")
    rows = packets.select(
        F.col(path).alias("path"), "us", "source_ip", "source_port", "destination_ip", "destination_port", "sequence", "flags",
        "payload_length" if "payload_length" in packets.columns else F.lit(0).alias("payload_length"), body.alias("body"),
        F.struct(*order).alias("at"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ipaddress

        known: dict[str, bytes] = {}

        def packed(text: str) -> bytes:
            if text not in known:
                known[text] = ipaddress.IPv4Address(text).packed
            return known[text]

        now, records, done = None, [], []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.path != now:
                    if records:
                        done.append((now, sanitize.write_capture(records)))
                    now, records = r.path, []
                data = bytes(r.payload_length) if r.body is None else bytes(r.body)
                frame = frames.tcp_frame(
                    packed(r.source_ip), packed(r.destination_ip), int(r.source_port), int(r.destination_port),
                    sequence=int(r.sequence), flags=int(r.flags), payload=data,
                )
                records.append((int(r.us), len(frame), frame))
            if done:
                yield pd.DataFrame(done, columns=["path", "content"])
                done = []
        if records:
            yield pd.DataFrame([(now, sanitize.write_capture(records))], columns=["path", "content"])

    laid = rows.repartition("path").sortWithinPartitions("path", "at").drop("at")
    return laid.mapInPandas(run, "path string, content binary")
