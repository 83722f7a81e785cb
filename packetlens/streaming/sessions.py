"""Sessions over streams.

``inactivity_sessions`` is Spark's own merging session window.  ``interval_sessions`` adds cuts
at opening events; its state is the fragment list of :mod:`packetlens.operators.sessions`, merged
by the same step as in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetlens.operators.sessions import FRAGMENT, as_fragments, merge_fragments, without_repeats
from packetlens.runtime import micros


def inactivity_sessions(
    stream: DataFrame, *, keys: Sequence[str], ts: str, gap: str = "60 seconds", watermark: str = "10 minutes"
) -> DataFrame:
    """Start, end, duration and event count per key and session; a session is final once the
    watermark has passed its end.  Works on batch frames alike."""
    aware = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    groups = aware.groupBy(*keys, F.session_window(ts, gap))
    out = groups.agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("event_count"))
    us = F.unix_micros("session_end") - F.unix_micros("session_start")
    return out.drop("session_window").withColumn("duration_us", us)


_STATE = pa.schema(
    [
        ("start_us", pa.int64()), ("first_event", pa.int64()), ("end_us", pa.int64()), ("last_event", pa.int64()),
        ("n", pa.int64()), ("opens", pa.bool_()), ("token", pa.int64()), ("sure", pa.bool_()),
    ]
)


def advance(state: pa.Table, watermark_us: int, gap_us: int) -> tuple[pa.Table, pa.Table]:
    """Finished sessions and what stays in state once the watermark stands at a time.

    Events behind the watermark can no longer be preceded by others: they merge in order.
    Events before it stay as they came, so a late one still finds its place between them.
    The last merged fragment runs on until the watermark is further than the gap behind it.
    """
    state = without_repeats(state.sort_by([("start_us", "ascending"), ("first_event", "ascending")]), [])
    settled = sum(x < watermark_us for x in state["start_us"].to_pylist())
    merged, waiting = merge_fragments(state.slice(0, settled), [], gap_us), state.slice(settled)
    keep = 0
    if merged.num_rows and merged["end_us"][-1].as_py() + gap_us >= watermark_us:
        keep = 1
    done = merged.slice(0, merged.num_rows - keep)
    return done, pa.concat_tables([merged.slice(merged.num_rows - keep), waiting])


def interval_sessions(
    stream: DataFrame,
    *,
    key: str,
    ts: str,
    event_id: str,
    gap_us: int,
    opening: Column | None = None,
    token: Column | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Sessions as :func:`packetlens.operators.sessions.merge_intervals` gives them, from events
    in any order that are at most ``watermark`` late; later ones are left out.

    State per key is the running fragment and the events before the watermark, so it is
    bounded by the events of one watermark delay; a silent key leaves the state.  A session is
    emitted once, when the watermark has passed its end by more than the gap or has passed the
    opening that cuts it.  ``event_id`` and ``token`` are whole numbers; events without key,
    time or id belong to no session; an event delivered twice is one event.
    Returns ``key, session_start_us, session_end_us, duration_us, first_event, last_event,
    event_count``.
    """
    rows = stream.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{ts}`").cast("timestamp").alias("ts"),
        micros(stream, ts).alias("us"),
        F.col(f"`{event_id}`").cast("long").alias("id"),
        (F.lit(False) if opening is None else F.coalesce(opening, F.lit(False))).alias("opens"),
        (F.lit(None).cast("long") if token is None else token.cast("long")).alias("token"),
    ).where("key is not null and us is not null and id is not null").withWatermark("ts", watermark)
    kind = dict(rows.dtypes)["key"]
    schema = (
        f"key {kind}, session_start_us long, session_end_us long, duration_us long, first_event long, last_event long, event_count long"
    )
    sql = {pa.int64(): "long", pa.bool_(): "boolean"}
    state_schema = ", ".join(f"{f.name} array<{sql[f.type]}>" for f in _STATE)

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = max(0, state.getCurrentWatermarkMs()) * 1000
        held = [_STATE.empty_table()]
        if state.exists:
            held.append(pa.table([pa.array(list(v), f.type) for v, f in zip(state.get, _STATE)], schema=_STATE))
        if not state.hasTimedOut:
            for pdf in batches:
                pdf = pdf[pdf["us"] >= now]
                tokens = [None if pd.isna(t) else int(t) for t in pdf["token"]]
                events = pa.table(
                    {
                        "us": pa.array(pdf["us"], pa.int64()), "id": pa.array(pdf["id"], pa.int64()),
                        "opens": pa.array(pdf["opens"], pa.bool_()), "token": pa.array(tokens, pa.int64()),
                    }
                )
                held.append(as_fragments(events, []).cast(_STATE))
        done, left = advance(pa.concat_tables(held), now, gap_us)
        if left.num_rows:
            state.update(tuple(left[c].to_pylist() for c in FRAGMENT))
            last = left["end_us"][0].as_py() if left.num_rows == 1 else left["end_us"][1].as_py()
            state.setTimeoutTimestamp(max((last + gap_us) // 1000 + 1, now // 1000 + 1))
        elif state.exists:
            state.remove()
        if done.num_rows:
            start, end = (done[c].to_numpy() for c in ("start_us", "end_us"))
            yield pd.DataFrame(
                {
                    "key": [k[0]] * done.num_rows, "session_start_us": start, "session_end_us": end, "duration_us": end - start,
                    "first_event": done["first_event"].to_numpy(), "last_event": done["last_event"].to_numpy(),
                    "event_count": done["n"].to_numpy(),
                }
            )

    return rows.groupBy("key").applyInPandasWithState(
        run, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )
