"""References to records that do not exist, found by anti-joins per null mask."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.operators.packed import split_packed
from packetlens.runtime import materialize

MATCH = ("simple", "partial", "full")


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    *,
    ref_keys: Sequence[str],
    target_keys: Sequence[str],
    match: str = "simple",
    at: str | None = None,
    valid_from: str | None = None,
    valid_to: str | None = None,
) -> DataFrame:
    """Rows of ``refs`` whose composite key names no row of ``targets``.

    References are grouped by which of their key columns are NULL, and each group is
    anti-joined on the columns that are not.  ``match`` is the rule for partly NULL keys:
    ``simple`` - any NULL makes the reference pass; ``partial`` - the rest must be found;
    ``full`` - a key must be wholly NULL (passes) or wholly given, a mixed one is an orphan.

    With ``at``, ``valid_from`` and ``valid_to`` a target counts only if it exists at the
    reference's time: ``valid_from <= at`` and (``valid_to`` NULL or ``> at``); a reference
    without time then finds nothing, a target without ``valid_from`` is never there.
    References are written once, as every mask reads them (and writes happen when this is
    called); masks that no row has cost no join.  Repeated references stay repeated; an empty target table makes every checked reference
    an orphan.  The joins are shuffle joins that adaptive execution splits at hot keys, or
    broadcast joins where the optimiser has measured the target side as small.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    names = [f"__t{i}" for i in range(len(target_keys))]
    timed = at is not None
    target = targets.select(
        *[F.col(f"`{c}`").alias(n) for n, c in zip(names, target_keys)],
        *([F.col(f"`{valid_from}`").alias("__from"), F.col(f"`{valid_to}`").alias("__to")] if timed else []),
    ).distinct()

    def condition(used: Sequence[int]) -> Column:
        terms = [F.col(f"`{ref_keys[i]}`") == F.col(names[i]) for i in used]
        if timed:
            terms += [
                F.col("__from") <= F.col(f"`{at}`"),
                F.col("__to").isNull() | (F.col("__to") > F.col(f"`{at}`")),
            ]
        return reduce(lambda a, b: a & b, terms)

    def masked(mask: Sequence[bool]) -> DataFrame:
        tests = [F.col(f"`{c}`").isNull() if m else F.col(f"`{c}`").isNotNull() for c, m in zip(ref_keys, mask)]
        return refs.where(reduce(lambda a, b: a & b, tests))

    refs = materialize(refs, "references")
    present = refs.select(*[F.col(f"`{c}`").isNull().alias(f"m{i}") for i, c in enumerate(ref_keys)]).distinct().collect()
    parts = [refs.where(F.lit(False))]
    for mask in sorted(tuple(r) for r in present):  # at most two to the number of key columns
        used = [i for i, null in enumerate(mask) if not null]
        if not used:
            continue  # a wholly NULL key passes under every rule
        if len(used) == len(ref_keys) or match == "partial":
            parts.append(masked(mask).join(target, condition(used), "left_anti"))
        elif match == "full":
            parts.append(masked(mask))
    return reduce(DataFrame.unionByName, parts)


def orphan_report(orphans: DataFrame, *, by: Sequence[str], period: str, unit: str = "month") -> DataFrame:
    """Number of orphan references per ``by`` columns and calendar period of ``period``."""
    when = F.date_trunc(unit, F.col(f"`{period}`").cast("timestamp")).cast("date").alias("period")
    return orphans.groupBy(*by, when).agg(F.count(F.lit(1)).alias("orphans"))


def canonical_id(column: Column) -> Column:
    """An id without outer blanks, in upper case; blank gives NULL."""
    text = F.upper(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(text != "", text)


def list_references(df: DataFrame, *, source_table: str, row_key: str, fields: dict[str, Column], at: str) -> DataFrame:
    """References held in scalar or packed fields: ``source_table, row_key, field_name,
    target, ref_id, at``; ``fields`` maps each field to the kind of record it names."""
    named = F.array(
        *[
            F.struct(F.lit(f).alias("field_name"), t.alias("target"), F.col(f"`{f}`").alias("text"))
            for f, t in fields.items()
        ]
    )
    rows = df.select(
        F.lit(source_table).alias("source_table"),
        F.col(f"`{row_key}`").alias("row_key"),
        F.col(f"`{at}`").alias("at"),
        F.inline(named),
    ).where(F.length(F.trim("text")) > 0)
    ids = F.explode(F.array_distinct(F.transform(split_packed(F.col("text")), canonical_id)))
    return rows.select("source_table", "row_key", "field_name", "target", ids.alias("ref_id"), "at").distinct()
