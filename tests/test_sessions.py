import random

import brute
import pytest
from pyspark.sql import functions as F

from packetlens.functions.addresses import canonical_ip
from packetlens.operators.sessions import merge_intervals, packet_sessions

SCHEMA = "key string, us long, id long, opens boolean, token long, session_start_us string"


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    return df.withColumn("ts", F.timestamp_micros("us"))


def run(df, gap, ranges):
    out = merge_intervals(
        df, keys=["key"], ts="ts", event_id="id", gap_us=gap, opening=F.col("opens"), token=F.col("token"), ranges=ranges
    )
    return sorted((r.first_event, r.last_event, r.event_count) for r in out.collect())


@pytest.mark.parametrize("seed", range(6))
def test_like_the_state_machine(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        key = rnd.choice(["hot"] * 5 + ["a", "b", None])
        us = rnd.randrange(0, 400_000 if seed % 2 else 3_000)
        rows.append((key, us, rnd.randrange(500), rnd.random() < 0.25 or None, rnd.choice([1, 2, None])))
    # an id delivered twice is the same row again
    seen = {}
    rows = [seen.setdefault(r[2], r) for r in rows]
    expected = brute.sessions([dict(key=k, us=u, id=i, opens=o, token=t) for k, u, i, o, t in rows], 900)
    for ranges in (1, 3, 25):
        assert run(frame(spark, rows), 900, ranges) == sorted(expected)


def test_gap_is_exclusive_and_cut_by_new_openings(spark):
    rows = [("k", 0, 1, True, 5), ("k", 100, 2, True, 5), ("k", 200, 3, False, 9), ("k", 300, 4, True, 6), ("k", 401, 5, False, 6)]
    assert run(frame(spark, rows), 100, 4) == [(1, 3, 3), (4, 4, 1), (5, 5, 1)]


def test_empty(spark):
    assert run(frame(spark, []), 100, 3) == []


def test_addresses(spark):
    texts = [" 10.0.0.1", "::ffff:10.0.0.1", "::FFFF:010.000.000.001", "0:0:0:0:0:ffff:10.0.0.1", "::ffff:0a00:0001", "[::1]", "2001:DB8::00a1", "2001:db8:0:0:0:0:0:a1", "no address", "  ", None]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select(canonical_ip(F.col("a")).alias("a"))
    assert [r.a for r in df.collect()] == ["10.0.0.1"] * 5 + [
        "0:0:0:0:0:0:0:1", "2001:db8:0:0:0:0:0:a1", "2001:db8:0:0:0:0:0:a1", "no address", None, None
    ]


def test_packets_without_source_belong_to_no_session(spark):
    df = spark.createDataFrame(
        [("1.1.1.1", 5, 0, 1, 2, 7), (None, 5, 1, 2, 2, 7), ("1.1.1.1", None, 2, 3, 2, 7), ("01.1.1.1", 5, 3, 4, 18, 7)],
        "source_ip string, source_port int, us long, packet_id long, flags int, sequence long",
    ).withColumn("captured_at", F.timestamp_micros("us"))
    out = packet_sessions(df).collect()
    assert [(r.first_event, r.last_event, r.event_count) for r in out] == [(1, 4, 2)]
