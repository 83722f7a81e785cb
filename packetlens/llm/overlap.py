"""Same or almost same records across splits: exact keys, and a prefix-filter join on rare
character shingles for texts within a small edit distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.runtime import materialize

#: Long enough that a shingle of a URL spans two words, which makes it rare.
SHINGLE = 10
MAX_EDITS = 2
#: So many counted shingles (64 MB) are sent to every executor; more meet their texts in a shuffle join.
BROADCAST_SHINGLES = 1 << 22


def compact_key(column: Column) -> Column:
    """A key without letter case, blanks and separators; nothing left gives NULL."""
    text = F.regexp_replace(F.lower(column), r"[^\p{L}\p{Nd}]+", "")
    return F.when(text != "", text)


def url_key(column: Column) -> Column:
    """Host and path of a URL.  Scheme, letter case, a leading "www.", user, port, query,
    fragment, percent escapes, final slashes and a final "index.html" do not count.
    A malformed escape is kept as written; nothing left gives NULL."""
    text = F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    text = F.regexp_replace(text, r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//", "")
    text = F.regexp_replace(text, r"(?s)[?#].*$", "")
    text = F.transform(F.array(text), lambda u: F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u))[0]
    text = F.lower(text)
    text = F.regexp_replace(text, r"^[^/@]*@", "")
    text = F.regexp_replace(text, r"^www\.", "")
    text = F.regexp_replace(text, r"^([^/:]*):\d*(?=/|$)", "$1")
    text = F.regexp_replace(text, r"(?:/+(?:index\.html)?)+$", "")
    return F.when(text != "", text)


def _disjoint(places: list[int], q: int) -> int:
    """Number of edits needed to change every shingle at some sorted places: how many of them,
    taken greedily from the left, do not overlap."""
    found, free = 0, 0
    for p in places:
        if p >= free:
            found, free = found + 1, p + q
    return found


def rare_prefix(size: int, shared: list[tuple[int, int, int]], q: int, edits: int) -> list[tuple[int, int]]:
    """The shingles (hash, place) by which a text of a size is looked up.

    ``shared`` are (count, hash, place) of its shingles that both sides have.  All others come
    first in the order, as they find nothing; then the shared ones, rarest first, until more
    than ``edits`` edits were needed to change the whole prefix.  None are returned if the
    others need that many already: such a text has no partner.
    """
    common = {p for *_, p in shared}
    chosen = [p for p in range(size - q + 1) if p not in common]
    if _disjoint(chosen, q) > edits:
        return []
    out, at, step = [], 0, 1
    order = sorted(shared)
    while at < len(order):
        end = min(len(order), at + step)
        while end < len(order) and order[end][1] == order[end - 1][1]:
            end += 1  # a shingle that stands at several places goes in whole
        out += [(h, p) for _, h, p in order[at:end]]
        at, step = end, max(1, end // 4)
        if _disjoint(sorted(chosen + [p for _, p in out]), q) > edits:
            break
    return out


def _prefixes(q: int, edits: int):
    """Prefixes of texts whose shingles come in rows one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, size, held = None, 0, []
        out: list[tuple[int, int, int, int]] = []
        for pdf in batches:
            for i, n, p, h, c in zip(*(pdf[x].tolist() for x in ("id", "size", "place", "gram", "n"))):
                if i != now:
                    out += [(now, h_, p_, size) for h_, p_ in rare_prefix(size, held, q, edits)] if held else []
                    now, size, held = i, n, []
                held.append((c, h, p))
            if out:
                yield pd.DataFrame(out, columns=["id", "gram", "place", "size"])
                out = []
        if held:
            out = [(now, h_, p_, size) for h_, p_ in rare_prefix(size, held, q, edits)]
            if out:
                yield pd.DataFrame(out, columns=["id", "gram", "place", "size"])

    return run


def _short_variants(text: Column, edits: int) -> Column:
    """A short text with up to ``edits`` characters left out."""
    found = F.array(text)
    for _ in range(edits):
        found = F.array_distinct(
            F.concat(
                found,
                F.flatten(
                    F.transform(
                        found,
                        lambda t: F.transform(
                            F.filter(F.sequence(F.lit(0), F.length(t)), lambda p: p > 0),
                            lambda p: F.concat(F.substring(t, F.lit(1), p - 1), F.substring(t, p + 1, F.length(t))),
                        ),
                    )
                ),
            )
        )
    return found


def near_texts(
    left: DataFrame,
    right: DataFrame,
    *,
    edits: int = MAX_EDITS,
    q: int = SHINGLE,
    broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """All pairs of distinct texts (one-column tables) at most ``edits`` insertions, deletions
    or replacements apart, as ``text_a`` (of ``left``) and ``text_b`` (of ``right``).

    Exact.  Every shingle is counted, whatever its number, and the counts come back to the
    texts as a table.  The evaluation side's rarest shingles are the index, the training
    side's probe it (see :func:`rare_prefix`); a hit must lie at nearly the same place
    (position filter) in a text of nearly the same length (length filter); hits are verified.
    Texts too short for the prefix bound meet through their deletion variants.  NULLs equal
    nothing.  Writes its intermediate tables when it is called.
    """

    def distinct(df):
        return df.select(F.col(df.columns[0]).alias("text")).where("text is not null").distinct()

    both = distinct(left).withColumn("in_eval", F.lit(True)).unionByName(distinct(right).withColumn("in_eval", F.lit(False)))
    both = materialize(both.withColumn("id", F.xxhash64("text", "in_eval")), "texts")
    size = F.length("text")
    places = F.filter(F.sequence(F.lit(0), F.greatest(size - q, F.lit(0))), lambda i: i <= size - q)
    grams = both.select(
        "id", "in_eval", size.alias("size"),
        F.explode(F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.substring(F.col("text"), i + 1, F.lit(q))).alias("gram")))).alias("s"),
    ).select("id", "in_eval", "size", "s.place", "s.gram")
    counts = grams.groupBy("gram").agg(
        F.count_if("in_eval").alias("l"), F.count_if(~F.col("in_eval")).alias("r")
    ).where("l > 0 and r > 0")
    counts = materialize(counts.select("gram", (F.col("l") * F.col("r")).alias("n")), "shingles")
    if counts.count() <= broadcast_shingles:
        known = grams.join(F.broadcast(counts), "gram")  # a text's rows stay together
    else:
        known = grams.join(counts.hint("merge"), "gram").repartition("id").sortWithinPartitions("id")
    known = known.select("id", "size", "place", "gram", "n")

    def side(in_eval: str, names: list[str]) -> DataFrame:
        return prefixes.join(both.where(in_eval).select("id"), "id", "left_semi").select("id", "gram", "place", "size").toDF(*names)

    prefixes = materialize(known.mapInPandas(_prefixes(q, edits), "id long, gram long, place int, size int"), "prefixes")
    a, b = side("in_eval", ["ia", "gram", "pa", "sa"]), side("not in_eval", ["ib", "gram", "pb", "sb"])
    hits = a.join(b, "gram").where(
        (F.abs(F.col("pa") - F.col("pb")) <= edits) & (F.abs(F.col("sa") - F.col("sb")) <= edits)
    ).select("ia", "ib")
    short = both.where(F.length("text") < q * (edits + 1)).select(
        "id", "in_eval", F.explode(_short_variants(F.col("text"), edits)).alias("v")
    )
    short_hits = short.where("in_eval").select("v", F.col("id").alias("ia")).join(
        short.where("not in_eval").select("v", F.col("id").alias("ib")), "v"
    ).select("ia", "ib")
    hits = hits.unionByName(short_hits).distinct()
    ta = both.where("in_eval").select(F.col("id").alias("ia"), F.col("text").alias("text_a"))
    tb = both.where("not in_eval").select(F.col("id").alias("ib"), F.col("text").alias("text_b"))
    pairs = hits.join(ta, "ia").join(tb, "ib")
    return pairs.where(F.levenshtein("text_a", "text_b", edits).between(0, edits)).select("text_a", "text_b")


def _sides(records, record_id, split, keys: dict[str, Column], train, evaluation) -> tuple[DataFrame, DataFrame]:
    side = split_name(F.col(f"`{split}`"))
    keyed = records.select(
        F.col(f"`{record_id}`").alias("record"),
        F.when(side.isin(*evaluation), True).when(side.isin(*train), False).alias("in_eval"),
        *[c.alias(f"k_{n}") for n, c in keys.items()],
    ).where("record is not null and in_eval is not null")
    keyed = materialize(keyed.distinct(), "records")
    return keyed.where("in_eval"), keyed.where("not in_eval")


def split_name(column: Column) -> Column:
    """A split's name without outer blanks and letter case."""
    return F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def cross_split_overlaps(
    records: DataFrame,
    *,
    record_id: str,
    split: str,
    exact: dict[str, Column],
    near: dict[str, Column],
    train: Sequence[str] = ("train",),
    evaluation: Sequence[str] = ("validation", "test"),
    edits: int = MAX_EDITS,
) -> DataFrame:
    """``eval_id, train_id, by`` for records of the evaluation splits that are also in train.

    ``exact`` and ``near`` map the name of a rule to its key; NULL keys equal nothing, NULL
    and other splits are in no split, a record delivered twice counts once, a split value is
    read without outer blanks and letter case.  ``near`` pairs are found between distinct
    texts and expanded to records last.
    """
    evals, trains = _sides(records, record_id, split, {**exact, **near}, train, evaluation)
    parts = []
    for name in exact:
        k = f"k_{name}"
        e = evals.select(F.col("record").alias("eval_id"), k).where(f"{k} is not null").distinct()
        t = trains.select(F.col("record").alias("train_id"), k).where(f"{k} is not null").distinct()
        parts.append(e.join(t, k).select("eval_id", "train_id", F.lit(name).alias("by")))
    for name in near:
        k = f"k_{name}"
        texts = near_texts(evals.select(k), trains.select(k), edits=edits)
        e = evals.select(F.col("record").alias("eval_id"), F.col(k).alias("text_a")).where("text_a is not null").distinct()
        t = trains.select(F.col("record").alias("train_id"), F.col(k).alias("text_b")).where("text_b is not null").distinct()
        parts.append(
            texts.join(e, "text_a").join(t, "text_b").select("eval_id", "train_id", F.lit(name).alias("by"))
        )
    return reduce(DataFrame.unionByName, parts)


def overlapping_records(
    records: DataFrame,
    *,
    record_id: str,
    split: str,
    exact: dict[str, Column],
    near: dict[str, Column],
    train: Sequence[str] = ("train",),
    evaluation: Sequence[str] = ("validation", "test"),
    edits: int = MAX_EDITS,
) -> DataFrame:
    """``record`` of every evaluation record that is also in train, once each, by the rules of
    :func:`cross_split_overlaps` but through semi-joins: no pair of records is made, so a key
    that n and m records carry costs n + m rows."""
    evals, trains = _sides(records, record_id, split, {**exact, **near}, train, evaluation)
    parts = []
    for name in exact:
        k = f"k_{name}"
        parts.append(evals.join(trains.select(k).where(f"{k} is not null").distinct(), k, "left_semi").select("record"))
    for name in near:
        k = f"k_{name}"
        texts = near_texts(evals.select(k), trains.select(k), edits=edits).select(F.col("text_a").alias(k)).distinct()
        parts.append(evals.join(texts, k, "left_semi").select("record"))
    return reduce(DataFrame.unionByName, parts).distinct()
