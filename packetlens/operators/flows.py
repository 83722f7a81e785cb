"""Window operators over ordered packets: flows, sessions, prefixes, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def endpoint_key(a_ip: str, a_port: str, b_ip: str, b_port: str) -> Column:
    """One key for both directions of a connection."""
    a = F.concat_ws(":", F.col(a_ip), F.col(a_port).cast("string"))
    b = F.concat_ws(":", F.col(b_ip), F.col(b_port).cast("string"))
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def direction_key(a_ip: str, a_port: str, b_ip: str, b_port: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in (a_ip, a_port, b_ip, b_port)])


def flow_sessions(df: DataFrame, *, flow: Sequence[str], order: Sequence[str], opening: Column, token: Column) -> DataFrame:
    """``session_ordinal`` of each packet within its flow: a session begins with the flow's first
    packet and with every opening whose token differs from that of the last opening.  Nothing
    else ends a session."""
    w = Window.partitionBy(*flow).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__open", F.when(F.coalesce(opening, F.lit(False)), F.struct(token.alias("t"))))
    rows = rows.withColumn("__prev", F.last("__open", ignorenulls=True).over(before))
    first = F.row_number().over(w) == 1
    anew = F.col("__open").isNotNull() & (F.col("__prev").isNull() | ~F.col("__open.t").eqNullSafe(F.col("__prev.t")))
    rows = rows.withColumn("__start", (first | anew).cast("long"))
    ordinal = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("session_ordinal", ordinal).drop("__open", "__prev", "__start")


def first_k(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], k: int, out: str = "place") -> DataFrame:
    """The first ``k`` rows of every key (window group limit prunes before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def trim_to_first(df: DataFrame, *, keys: Sequence[str], order: str, condition: Column) -> DataFrame:
    """Rows from each key's first row that meets ``condition`` on; keys without one vanish.
    The first place is a partially aggregated minimum, not a window over the key."""
    first = df.where(condition).groupBy(*keys).agg(F.min(order).alias("__first"))
    return df.join(first, list(keys)).where(F.col(order) >= F.col("__first")).drop("__first")


def time_inversions(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], ts: str) -> DataFrame:
    """Number of rows earlier than the row before them in delivery order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    earlier = (F.col(ts) < F.lag(ts).over(w)).cast("long")
    return df.select(*keys, F.coalesce(earlier, F.lit(0).cast("long")).alias("i")).groupBy(*keys).agg(F.sum("i").alias("inversions"))


def rebase_times(df: DataFrame, *, keys: Sequence[str], us: str, anchor_us: int = 0, out: str = "rebased_us") -> DataFrame:
    """Times of each key moved so that its first one falls on the anchor."""
    first = df.groupBy(*keys).agg(F.min(us).alias("__first"))
    return df.join(first, list(keys)).withColumn(out, F.col(us) - F.col("__first") + F.lit(anchor_us)).drop("__first")
