"""Declarative checks: a name and the rows that break it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.functions.text import flag_mask, flag_pattern, split_ids


@dataclass(frozen=True)
class Check:
    """``violations`` are the rows that break the rule; ``expected`` of them are allowed."""

    name: str
    violations: DataFrame
    expected: int = 0


def report(spark: SparkSession, checks: Sequence[Check]) -> DataFrame:
    """``check, passed, observed, expected``: one lazily counted row per check."""
    rows = [
        c.violations.agg(
            F.lit(c.name).alias("check"), (F.count(F.lit(1)) == c.expected).alias("passed"),
            F.count(F.lit(1)).alias("observed"), F.lit(c.expected).cast("long").alias("expected"),
        )
        for c in checks
    ]
    return reduce(DataFrame.unionByName, rows)


def observation_rules(max_position: int = 50) -> Mapping[str, Column]:
    """Row rules of packet observations; each is true where the row breaks it."""
    c = F.col
    return {
        "position_range": ~c("position").between(1, max_position),
        "payload_is_ip_less_40": c("tcp_payload_length_bytes") != c("ip_total_length_bytes") - 40,
        "frame_is_ip_plus_14": F.coalesce(c("frame_length_bytes") != F.greatest(F.lit(60), c("ip_total_length_bytes") + 14), F.lit(True)),
        "direction_domain": ~F.coalesce(c("direction").isin("c2s", "s2c"), F.lit(False)),
        "iat_null_iff_first": c("iat_us").isNull() != (c("position") == 1),
        "iat_not_negative": F.coalesce(c("iat_us") < 0, F.lit(False)),
        "ttl_range": ~c("ipv4_ttl").between(1, 255),
        "window_range": ~c("tcp_window_raw").between(0, 65535),
        "flag_pattern_canonical": F.coalesce(flag_pattern(flag_mask(c("tcp_flag_pattern"))) != c("tcp_flag_pattern"), F.lit(True)),
    }


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations of every row rule in one scan: ``check, passed, observed, expected``."""
    sums = df.agg(*[F.coalesce(F.sum(r.cast("long")), F.lit(0).cast("long")).alias(n) for n, r in rules.items()])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("passed"), F.col(n).alias("observed"), F.lit(0).cast("long").alias("expected"))
        for n in rules
    ])))


def same_rows(name: str, left: DataFrame, right: DataFrame) -> Check:
    """Two tables hold the same rows, repeated ones included."""
    return Check(name, left.exceptAll(right).unionByName(right.exceptAll(left)))


def contract_checks(tables: Mapping[str, DataFrame], contract: Mapping) -> list[Check]:
    """Checks from a JSON contract: per table ``primary_key``, ``rows``, ``enums`` and
    ``foreign_keys`` (``column, table, key``, optionally ``list`` and ``optional``)."""
    out = []
    for name, spec in contract["tables"].items():
        df = tables[name]
        if "primary_key" in spec:
            key = spec["primary_key"]
            key = [key] if isinstance(key, str) else key
            out.append(Check(f"{name}.primary_key", df.groupBy(*key).count().where("count > 1")))
        for column, allowed in spec.get("enums", {}).items():
            out.append(Check(f"{name}.{column}.enum", df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))))
        if "rows" in spec:
            out.append(Check(f"{name}.rows", df, expected=spec["rows"]))
        for fk in spec.get("foreign_keys", ()):
            value = F.explode(split_ids(F.col(fk["column"]))) if fk.get("list") else F.col(fk["column"])
            refs = df.select(value.alias("k"))
            if fk.get("optional") or fk.get("list"):
                refs = refs.where("k is not null and k <> ''")
            target = tables[fk["table"]].select(F.col(fk["key"]).alias("k"))
            out.append(Check(f"{name}.{fk['column']}.foreign_key", refs.join(target, "k", "left_anti")))
    return out
