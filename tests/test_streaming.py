import random

import brute
import pyarrow as pa
from pyspark.sql import functions as F

from packetlens.operators.sessions import as_fragments
from packetlens.streaming.sessions import advance, inactivity_sessions, interval_sessions


def _stream(spark, folder, batches, schema):
    """A stream whose micro-batches are the given lists of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/f{i:03d}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    )


SCHEMA = "key string, us long, id long, opens boolean, token long"
FLUSH = [("flush", 10**9, 10**6, False, None)]


def _sessions(spark, tmp_path, batches, name, watermark):
    stream = _stream(spark, str(tmp_path / "in"), batches, SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    out = interval_sessions(
        stream, key="key", ts="ts", event_id="id", gap_us=900_000, opening=F.col("opens"), token=F.col("token"), watermark=watermark
    )
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table(name).where("key <> 'flush'").collect()
    return sorted((r.first_event, r.last_event, r.event_count) for r in rows)


def test_late_events_take_their_place(spark, tmp_path):
    rnd = random.Random(5)
    rows = [
        (rnd.choice(["a", "a", "b"]), i * 70_000 + rnd.randrange(60_000), i, rnd.random() < 0.2, rnd.choice([1, 2, None])) for i in range(160)
    ]
    # every event comes up to two seconds late, and some come twice
    arriving = sorted(rows + rows[::9], key=lambda r: r[1] + rnd.randrange(2_000_000))
    batches = [arriving[i : i + 45] for i in range(0, len(arriving), 45)] + [FLUSH]
    got = _sessions(spark, tmp_path, batches, "late", "2 seconds")
    wanted = brute.sessions([dict(key=k, us=u, id=i, opens=o, token=t) for k, u, i, o, t in rows], 900_000)
    assert got == sorted(wanted)


def test_events_later_than_the_watermark_are_left_out(spark, tmp_path):
    first = [("a", 1_000_000, 1, False, None), ("a", 1_500_000, 2, False, None), ("b", 60_000_000, 3, False, None)]
    assert _sessions(spark, tmp_path, [first, [("b", 60_100_000, 4, False, None)], [("a", 1_200_000, 5, False, None)], FLUSH], "gone", "1 second") == [
        (1, 2, 2), (3, 4, 2),
    ]


def test_state_is_bounded_by_the_watermark():
    events = pa.table(
        {"us": pa.array(range(0, 5000, 10)), "id": pa.array(range(500)), "opens": pa.array([False] * 500), "token": pa.array([None] * 500, pa.int64())}
    )
    done, left = advance(as_fragments(events, []), 4_900, 50)
    assert done.num_rows == 0 and left.num_rows == 1 + 10 and left["n"].to_pylist()[0] == 490
    done, left = advance(left, 10_000, 50)
    assert done["n"].to_pylist() == [500] and left.num_rows == 0


def test_inactivity_sessions_in_batch(spark):
    df = spark.createDataFrame([("k", 0), ("k", 59), ("k", 130), ("j", 5)], "key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.key, r.event_count, r.duration_us) for r in inactivity_sessions(df, keys=["key"], ts="ts").collect()}
    assert got == {("k", 2, 59_000_000), ("k", 1, 0), ("j", 1, 0)}
