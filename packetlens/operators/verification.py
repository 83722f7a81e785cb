"""Violations of release rules, as rows: which rule, whom it hits, what was found."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def _rows(df: DataFrame, rule: str, subject, observed) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), observed.cast("string").alias("observed"))


def _several(df: DataFrame, rule: str, key: str, over: Sequence[str]) -> DataFrame:
    """Keys that stand with more than one combination of ``over``.  Combinations are made
    distinct before they are counted, so a key with a third of all rows is a few rows."""
    found = df.where(F.col(key).isNotNull()).select(key, *over).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _rows(found.where("n > 1"), rule, F.col(key), F.col("n"))


def split_violations(
    df: DataFrame,
    *,
    parent: str,
    digest: str,
    cell: Sequence[str],
    split: str,
    leakage: str | None = None,
    shares: Mapping[str, int] = {"validation": 15, "test": 15},
) -> DataFrame:
    """``rule, subject, observed`` of a split manifest, one row per member:

    ``invalid_split``; ``parent_crosses``, ``content_crosses`` and ``leakage_crosses`` (a parent,
    digest or leakage group in several cells or splits); ``leakage_missing``; ``leakage_torn``
    (a parent or digest with several leakage groups); ``quota`` (a cell whose splits are not
    ``floor(share %)`` of its rows, the rest being train).  NULL parents and digests bind
    nothing; an empty manifest breaks no rule.
    """
    where = [*cell, split]
    parts = [
        _rows(df.where(~F.coalesce(F.col(split).isin(*SPLITS), F.lit(False))), "invalid_split", F.coalesce(F.col(split), F.lit("")), F.lit(1)).distinct(),
        _several(df, "parent_crosses", parent, where),
        _several(df, "content_crosses", digest, where),
    ]
    if leakage:
        empty = df.where(F.coalesce(F.col(leakage), F.lit("")) == "").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        parts += [
            _several(df, "leakage_crosses", leakage, where), _rows(empty, "leakage_missing", F.lit(""), F.col("n")),
            _several(df, "leakage_torn", parent, [leakage]), _several(df, "leakage_torn", digest, [leakage]),
        ]
    counts = df.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(F.col(split) == s, F.lit(False))).alias(s) for s in SPLITS]
    )
    due = {s: F.floor(F.col("n") * share / 100) for s, share in shares.items()}
    due["train"] = F.col("n") - reduce(lambda a, b: a + b, due.values())
    off = reduce(lambda a, b: a | b, [F.col(s) != d for s, d in due.items()])
    name = F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("")) for c in cell])
    parts.append(_rows(counts.where(off), "quota", name, F.concat_ws(" ", *SPLITS)))
    return reduce(DataFrame.unionByName, parts)


def manifest_violations(df: DataFrame, *, path: str, digest: str, session: str) -> DataFrame:
    """``rule, subject, observed``: ``partial_binding`` (path or digest alone),
    ``duplicate_path`` and ``duplicate_session`` among bound rows; rows without both are not
    bound and break no rule."""
    p, d = F.col(path), F.col(digest)
    bound = df.where(p.isNotNull() & d.isNotNull())
    twice = [
        _rows(bound.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rule, F.col(c), F.col("n"))
        for c, rule in ((path, "duplicate_path"), (session, "duplicate_session"))
    ]
    partial = _rows(df.where(p.isNull() != d.isNull()), "partial_binding", F.coalesce(p, d), F.lit(1)).groupBy("rule", "subject").agg(
        F.count(F.lit(1)).cast("string").alias("observed")
    )
    return reduce(DataFrame.unionByName, [partial, *twice])


def attribute_conflicts(rows: DataFrame, dimension: DataFrame, *, key: str, attributes: Sequence[str]) -> DataFrame:
    """``key, attribute, stated, declared, rows``: rows whose attributes are not those that the
    dimension declares for their key (NULL ``declared`` where it has no such key)."""
    have = dimension.select(key, *[F.col(a).alias(f"__{a}") for a in attributes])
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("stated"), F.col(f"__{a}").alias("declared")) for a in attributes])
    counts = rows.groupBy(key, *attributes).agg(F.count(F.lit(1)).alias("rows"))  # before the join, so a hot key is one row
    laid = counts.join(have, key, "left").select(key, "rows", F.inline(pairs)).where("not (stated <=> declared)")
    return laid.groupBy(key, "attribute", "stated", "declared").agg(F.sum("rows").alias("rows"))


def declared_against_observed(declared: DataFrame, observed: DataFrame, *, keys: Sequence[str], count: str) -> DataFrame:
    """``keys, declared, observed, state``: numbers of both sides, keys of one side only included."""
    a = declared.select(*keys, F.col(count).alias("declared"))
    b = observed.select(*keys, F.col(count).alias("observed"))
    state = F.when(F.col("declared").isNull(), "undeclared").when(F.col("observed").isNull(), "unobserved")
    return a.join(b, list(keys), "full").withColumn(
        "state", state.when(F.col("declared") == F.col("observed"), "equal").otherwise("different")
    )
