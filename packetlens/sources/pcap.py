"""Python data source ``capture``: ``spark.read.format("capture").load(folder)`` gives packets."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "path string, record_index int, timestamp_us long, captured_length int, source_ip string, source_port int, "
    "destination_ip string, destination_port int, sequence long, acknowledged long, flags int, window int, ttl int, payload_length int"
)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        found = [self.folder] if os.path.isfile(self.folder) else glob.glob(f"{self.folder}/**/*.pcap", recursive=True)
        return [_File(p) for p in sorted(found) if not os.path.basename(p).startswith("._")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import ipaddress

        from packetlens.functions.frames import CaptureError, decode_tcp, read_records

        with open(partition.path, "rb") as handle:
            raw = handle.read()
        for r in read_records(raw):
            try:
                p = decode_tcp(r.frame)
            except (CaptureError, IndexError):
                continue
            yield (
                partition.path, r.index, r.timestamp_us, r.captured_length, str(ipaddress.ip_address(p.source)), p.source_port,
                str(ipaddress.ip_address(p.target)), p.target_port, p.sequence, p.acknowledged, p.flags, p.window, p.ttl, len(p.payload),
            )


class CaptureSource(DataSource):
    """TCP packets of classic captures on storage that every executor mounts, one task a file."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)
