"""Duplicates hidden by formatting: canonical keys, Bloom filters of repeated keys, exact groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.llm import bloom
from packetlens.runtime import materialize

#: So many hashes (32 MB) are sent to every executor; more meet their rows in a shuffle join.
BROADCAST_HASHES = 1 << 22


def canonical_value(column: Column) -> Column:
    """Only Unicode letters and digits, letter case removed; NULL and blank give ''."""
    # Upper case first, so that characters that become two (such as ß) meet their other case;
    # the capital sharp s has no upper case of its own.
    upper = F.replace(F.upper(F.coalesce(column.cast("string"), F.lit(""))), F.lit("ẞ"), F.lit("SS"))
    folded = F.lower(upper)
    return F.regexp_replace(folded, r"[^\p{L}\p{Nd}]+", "")


def canonical_key(fields: Sequence[str]) -> Column:
    """128-bit digest of the canonical values, whichever field each of them stands in."""
    values = F.array_sort(F.array(*[canonical_value(F.col(f"`{f}`")) for f in fields]))
    return F.unhex(F.md5(F.array_join(values, "\x1f")))


def formatted_copies(
    df: DataFrame,
    *,
    record_id: str,
    fields: Sequence[str],
    segment_keys: int = bloom.SEGMENT_KEYS,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """Every record with the smallest record id of its set of copies and the set's size.

    Returns ``record_id, first_record_id, copies``.  Ids and 128-bit keys are written once.
    The 64-bit hashes of the keys go to the Bloom filters of their segment, which name the
    possibly repeated ones.  Up to ``broadcast_hashes`` of those (counted) are sent to the
    rows, so that only possible repeats are shuffled; beyond, ids and keys meet them in a
    shuffle join, which adaptive execution splits at hot keys.  All other records are
    singletons already.  Possible repeats are grouped exactly: the smallest id and the number
    are partially aggregated and joined back, so no group is gathered in one task.

    Rows wholly blank in ``fields`` are copies of each other; a record id delivered twice
    counts once per row; a NULL id is left out; an empty table gives no rows.  Writes its
    intermediate tables when it is called.
    """
    keyed = df.select(F.col(f"`{record_id}`").alias("record_id"), canonical_key(fields).alias("key")).where(
        "record_id is not null"
    )
    keyed = materialize(keyed, "keys").withColumn("h", F.xxhash64("key"))
    maybe = bloom.repeated_hashes(keyed, "h", rows=keyed.count(), segment_keys=segment_keys)
    maybe = materialize(maybe, "repeats")
    if maybe.count() <= broadcast_hashes:
        maybe = F.broadcast(maybe)
    else:
        maybe = maybe.hint("merge")
    rows = keyed.join(maybe, "h", "left_semi").select("record_id", "key")
    heads = rows.groupBy("key").agg(F.min("record_id").alias("first_record_id"), F.count(F.lit(1)).alias("copies"))
    again = rows.join(heads, "key").select("record_id", "first_record_id", "copies")
    alone = keyed.join(maybe, "h", "left_anti").select(
        "record_id", F.col("record_id").alias("first_record_id"), F.lit(1).cast("long").alias("copies")
    )
    return again.unionByName(alone)
