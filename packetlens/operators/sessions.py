"""Sessions by inactivity as merging interval state.

Every event opens an interval as long as the gap.  Overlapping intervals of a key merge; an
*opening* event cuts the merged interval.  The state of a key is a list of *fragments*: start
and end with their events, the number of events, the opening a fragment began with, and
whether its beginning is certain.  :func:`merge_fragments` merges any sorted list of them, so
the same step serves events, the fragments of neighbouring partitions and the state of a
stream (:mod:`packetlens.streaming.sessions`).

A batch is laid out by ranges of (key, time), so a key with a third of all events is spread
over as many tasks as its size needs, whatever its rate.  Inside a task only the running
fragment is kept.  Only fragments at a range's edge, at most three a range, meet again by key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions.addresses import canonical_ip
from packetlens.runtime import micros

SYN, ACK = 2, 16
#: the columns of a fragment behind its keys
FRAGMENT = ("start_us", "first_event", "end_us", "last_event", "n", "opens", "token", "sure")


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where a value differs from the one before it, NULLs being equal; the first does."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        one_null = pc.xor(pc.is_null(a), pc.is_null(b))
        out[1:] = pc.or_(differs, one_null).to_numpy(zero_copy_only=False)
    return out


def merge_fragments(state: pa.Table, keys: Sequence[str], gap_us: int) -> pa.Table:
    """Merge fragments, sorted by ``keys``, ``start_us`` and ``first_event``, to longer ones.

    A fragment begins a session if its key is new, if it lies more than ``gap_us`` behind the
    one before, if its beginning is certain already, or if it opens and the running session
    did not begin with an opening of the same token.  The running session's token is that of
    the last opening since the last silence, as any other opening would have cut.

    The first fragment keeps its ``sure``; what follows is sure unless it hangs on a session
    whose beginning is not known.
    """
    size = state.num_rows
    if size == 0:
        return state
    at = np.arange(size)
    start, end = state["start_us"].to_numpy(), state["end_us"].to_numpy()
    fresh = at == 0
    for k in keys:
        fresh |= _changes(state[k])
    silent = fresh.copy()
    silent[1:] |= start[1:] - end[:-1] > gap_us
    opens, sure = (state[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("opens", "sure"))
    block = np.maximum.accumulate(np.where(silent, at, 0))
    before = np.r_[-1, np.maximum.accumulate(np.where(opens, at, -1))[:-1]]
    known = before >= block
    token = state["token"].combine_chunks()
    earlier = token.take(pa.array(np.maximum(before, 0)))
    equal = pc.or_(
        pc.fill_null(pc.equal(token, earlier), False), pc.and_(pc.is_null(token), pc.is_null(earlier))
    ).to_numpy(zero_copy_only=False)
    cut = silent | sure | (opens & ~(known & equal))
    certain = sure | (opens & known & ~equal)
    certain[1:] |= silent[1:]
    certain |= opens & ~known & certain[block]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], size] - 1
    begin, finish = state.take(pa.array(first)), state.take(pa.array(last))
    columns = {
        **{k: begin[k] for k in keys},
        "start_us": begin["start_us"],
        "first_event": begin["first_event"],
        "end_us": finish["end_us"],
        "last_event": finish["last_event"],
        "n": pa.array(np.add.reduceat(state["n"].to_numpy(), first)),
        "opens": begin["opens"],
        "token": begin["token"],
        "sure": pa.array(certain[first]),
    }
    return pa.table(columns)


def as_fragments(events: pa.Table, keys: Sequence[str]) -> pa.Table:
    """Events (``keys, us, id, opens, token``) as fragments of one event each."""
    size = events.num_rows
    return pa.table(
        {
            **{k: events[k] for k in keys},
            "start_us": events["us"],
            "first_event": events["id"],
            "end_us": events["us"],
            "last_event": events["id"],
            "n": pa.array(np.ones(size, np.int64)),
            "opens": events["opens"],
            "token": events["token"],
            "sure": pa.array(np.zeros(size, bool)),
        }
    )


def without_repeats(state: pa.Table, keys: Sequence[str]) -> pa.Table:
    """Sorted fragments without events that the fragment before ends with already."""
    fresh = np.arange(state.num_rows) == 0
    for k in keys:
        fresh |= _changes(state[k])
    for a, b in (("start_us", "end_us"), ("first_event", "last_event")):
        now, before = state[a].slice(1), state[b].slice(0, max(0, state.num_rows - 1))
        fresh[1:] |= pc.not_equal(now, before).to_numpy(zero_copy_only=False)
    return state if fresh.all() else state.filter(pa.array(fresh))


def _range_sessions(keys: Sequence[str], gap_us: int, schema: pa.Schema):
    """One range: batches in order merge into the running fragment, all others go out.
    Fragments that another range may still change are marked as ``edge``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: pa.Table | None = None

        def out(table: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from table.append_column("edge", pa.array(edge)).select(schema.names).cast(schema).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            state = as_fragments(pa.Table.from_batches([batch]), keys)
            if running is not None:
                state = pa.concat_tables([running, state])
            state = merge_fragments(without_repeats(state, keys), keys, gap_us)
            done, running = state.slice(0, state.num_rows - 1), state.slice(state.num_rows - 1)
            if done.num_rows:
                yield from out(done, ~done["sure"].to_numpy(zero_copy_only=False).astype(bool))
        if running is not None:
            yield from out(running, np.ones(1, bool))

    return run


def _edge_sessions(keys: Sequence[str], gap_us: int, schema: pa.Schema):
    """Finished sessions pass; the edge fragments of a key merge once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from table.filter(pc.invert(table["edge"])).select(schema.names).to_batches()
            edges.append(table.filter(table["edge"]))
        if edges:
            state = pa.concat_tables(edges)
            order = [(c, "ascending") for c in (*keys, "start_us", "first_event")]
            state = merge_fragments(state.sort_by(order), keys, gap_us)
            yield from state.select(schema.names).cast(schema).to_batches()

    return run


def merge_intervals(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    event_id: str,
    gap_us: int,
    opening: Column | None = None,
    token: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Split each key's events into sessions.

    In order of (``ts``, ``event_id``) a session begins at a key's first event, at an event
    more than ``gap_us`` after the previous one, and at an ``opening`` event unless the
    running session began with an opening event of the same ``token``.

    Defined cases: an event without key, time or id belongs to no session; events with equal
    time and id are one event; a NULL ``opening`` is false; NULL tokens equal each other;
    late events take their place in time (a stream takes them until its watermark has
    passed); an empty input gives no sessions.  ``ranges`` is the number of ranges, by
    default the session's shuffle partitions, which adaptive execution joins where small.

    Returns ``keys``, ``session_start_us``, ``session_end_us``, ``duration_us``,
    ``first_event``, ``last_event``, ``event_count``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    k = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(f"`{c}`").alias(n) for n, c in zip(k, keys)],
        micros(df, ts).alias("us"),
        F.col(f"`{event_id}`").alias("id"),
        (F.lit(False) if opening is None else F.coalesce(opening, F.lit(False))).alias("opens"),
        (F.lit(None).cast("long") if token is None else token).alias("token"),
    ).where(" and ".join(f"{c} is not null" for c in [*k, "us", "id"]))
    order = [F.xxhash64(*k), *k, "us", "id"]
    laid = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    kinds = dict(rows.dtypes)
    columns = {
        **{n: kinds[n] for n in k},
        "start_us": "long", "first_event": kinds["id"], "end_us": "long", "last_event": kinds["id"], "n": "long",
        "opens": "boolean", "token": kinds["token"], "sure": "boolean", "edge": "boolean",
    }
    ddl = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    fragments = laid.mapInArrow(_range_sessions(k, gap_us, arrow), ddl)
    meeting = F.when(F.col("edge"), F.xxhash64(*k)).otherwise(F.xxhash64("first_event"))
    final = [*k, "start_us", "first_event", "end_us", "last_event", "n"]
    out = pa.schema([arrow.field(c) for c in final])
    sessions = fragments.repartition(meeting).mapInArrow(
        _edge_sessions(k, gap_us, out), ", ".join(f"`{c}` {columns[c]}" for c in final)
    )
    return sessions.select(
        *[F.col(n).alias(c) for n, c in zip(k, keys)],
        F.col("start_us").alias("session_start_us"),
        F.col("end_us").alias("session_end_us"),
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        "first_event",
        "last_event",
        F.col("n").alias("event_count"),
    )


def packet_events(packets: DataFrame, *, ip: str, port: str, ts: str, packet_id: str, flags: str, sequence: str) -> DataFrame:
    """Packets as events of their source: ``source_ip`` in one spelling, ``opens`` for SYN
    without ACK, ``sequence`` as token."""
    bits = F.col(f"`{flags}`")
    return packets.select(
        canonical_ip(F.col(f"`{ip}`")).alias("source_ip"),
        F.col(f"`{port}`").alias("source_port"),
        F.col(f"`{ts}`").alias("captured_at"),
        F.col(f"`{packet_id}`").alias("packet_id"),
        ((bits.bitwiseAND(SYN) != 0) & (bits.bitwiseAND(ACK) == 0)).alias("opens"),
        F.col(f"`{sequence}`").cast("long").alias("sequence"),
    )


def packet_sessions(
    packets: DataFrame,
    *,
    ip: str = "source_ip",
    port: str = "source_port",
    ts: str = "captured_at",
    packet_id: str = "packet_id",
    flags: str = "flags",
    sequence: str = "sequence",
    gap_seconds: int = 60,
    ranges: int | None = None,
) -> DataFrame:
    """Sessions of each (address, port), cut by silence and by fresh connection openings
    (SYN set, ACK not set).  Addresses are compared in one spelling; see :func:`canonical_ip`."""
    events = packet_events(packets, ip=ip, port=port, ts=ts, packet_id=packet_id, flags=flags, sequence=sequence)
    return merge_intervals(
        events,
        keys=["source_ip", "source_port"],
        ts="captured_at",
        event_id="packet_id",
        gap_us=gap_seconds * 1_000_000,
        opening=F.col("opens"),
        token=F.col("sequence"),
        ranges=ranges,
    )
