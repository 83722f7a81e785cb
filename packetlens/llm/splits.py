"""Splits that keep related records together: distributed union-find, then greedy assignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from packetlens.functions.text import UNKNOWN_WORDS, relation_key  # noqa: F401
from packetlens.operators.components import star_forest
from packetlens.runtime import materialize

#: Nodes of one forest in a Python worker; a fuller one is handed on and the next begun.
FOREST_NODES = 500_000
#: Forests that merge into one, level by level.
FAN_IN = 16
#: Links that one task of a merge takes, about.
LINKS_PER_TASK = 1_000_000


class Forest:
    """Union-find over hashable nodes; the smallest node of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a < b:
            self.up[b] = a
        elif b < a:
            self.up[a] = b


def _local_forests(nodes: int):
    """Forests of one input partition: each session and token with its local root.

    Sessions sort before tokens, so a root is always the tree's smallest session."""

    def out(forest: Forest):
        items = list(forest.up)
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pd.DataFrame(
                {"kind": [k for k, _ in part], "name": [n for _, n in part], "root": [forest.find(x)[1] for x in part]}
            )

    def run(batches):
        forest = Forest()
        for pdf in batches:
            for node, tokens in zip(pdf["node"], pdf["tokens"]):
                me = (0, node)
                forest.find(me)
                for token in tokens:
                    forest.union(me, (1, token))
            if len(forest.up) > nodes:
                yield from out(forest)
                forest = Forest()
        yield from out(forest)

    return run


def _merge_forests(nodes: int):
    """Forests over links between the roots of smaller ones."""

    def out(forest: Forest):
        items = [x for x in list(forest.up) if forest.find(x) != x]
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pd.DataFrame({"a": part, "b": [forest.find(x) for x in part]})

    def run(batches):
        forest = Forest()
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"]):
                forest.union(a, b)
            if len(forest.up) > nodes:
                yield from out(forest)
                forest = Forest()
        yield from out(forest)

    return run


def _renamed(rows: DataFrame, column: str, forest: DataFrame) -> DataFrame:
    """``rows`` with the roots in ``column`` replaced by the roots that took them in."""
    f = forest.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    joined = rows.join(f, rows[column] == F.col("__a"), "left")
    return joined.withColumn(column, F.coalesce("__b", column)).drop("__a", "__b")


def related_groups(
    df: DataFrame,
    *,
    node: str,
    relations: Sequence[Column],
    fan_in: int = FAN_IN,
    forest_nodes: int = FOREST_NODES,
    links_per_task: int = LINKS_PER_TASK,
) -> DataFrame:
    """``node, group_node``: the smallest node of those related directly or through others.

    Level 0: every input partition builds its own forests, of ``forest_nodes`` nodes at most.
    A value (or node) that only one of them holds is done.  The others link roots: at level
    k the forests of ``fan_in`` ** k neighbouring partitions merge into one, until one is left.  Links
    of a level go to as many tasks as ``links_per_task`` asks for, each of which merges its
    own; what still points at several roots is settled by star contraction (no round, where
    one task held all links of its forests).  The same steps run at every size.  A value
    shared by a third of all rows costs one link per forest.

    NULL relations relate nothing; rows without ``node`` are left out; repeated rows do not
    matter; an empty table gives no rows.  Writes its intermediate tables when it is called.
    """
    tokens = F.array_compact(
        F.array(*[F.when(r.isNotNull(), F.concat(F.lit(f"{i}:"), r)) for i, r in enumerate(relations)])
    )
    rows = df.select(F.col(f"`{node}`").cast("string").alias("node"), tokens.alias("tokens")).where("node is not null")
    local = rows.mapInPandas(_local_forests(forest_nodes), "kind int, name string, root string")
    local = materialize(local.withColumn("part", F.spark_partition_id()), "forests")
    several = local.groupBy("kind", "name").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    spots = materialize(local.join(several.select("kind", "name"), ["kind", "name"], "left_semi"), "spots")
    parts = (local.agg(F.max("part")).first()[0] or 0) + 1
    roots = None
    while True:
        parts = -(-parts // fan_in)
        spots = spots.withColumn("part", F.expr(f"part div {fan_in}"))
        head = spots.groupBy("kind", "name", "part").agg(F.min("root").alias("b"), F.max("root").alias("z")).where("b < z")
        links = spots.join(head.drop("z"), ["kind", "name", "part"]).where("root <> b")
        links = materialize(links.select("part", F.col("root").alias("a"), "b").distinct(), "links")
        tasks = -(-links.count() // links_per_task)
        if tasks:
            chunk = F.pmod(F.xxhash64("b"), F.lit(tasks))
            merged = links.repartition(parts * tasks, "part", chunk).mapInPandas(_merge_forests(forest_nodes), "a string, b string")
            forest = star_forest(merged)
            spots = _renamed(spots, "root", forest)
            roots = forest if roots is None else _renamed(roots, "b", forest).unionByName(forest)
            roots = materialize(roots, "roots")
        if parts == 1:
            break
        spots = materialize(spots.distinct(), "spots")
    members = local.where("kind = 0").select(F.col("name").alias("node"), F.col("root").alias("group_node"))
    if roots is not None:
        members = _renamed(members, "group_node", roots)
    return members.groupBy("node").agg(F.min("group_node").alias("group_node"))


def water_fill(deficit: np.ndarray, size: int, n: int) -> np.ndarray:
    """How many of ``n`` items of one size each split takes if every item goes to the split
    furthest below its target.  All but the last few are counted, not walked through."""
    out = np.zeros(len(deficit), np.int64)
    room = deficit / size
    if n > 64:
        order = np.sort(room)[::-1]
        level = max((order[:k].sum() - (n - 16)) / k for k in range(1, len(order) + 1))
        out = np.maximum(0, np.floor(room - level)).astype(np.int64)
    left = room - out
    for _ in range(n - int(out.sum())):
        k = int(np.argmax(left))
        out[k] += 1
        left[k] -= 1
    return out


def allocate(hist: pd.DataFrame, shares: Sequence[float], levels: Sequence[str]) -> pd.DataFrame:
    """Greedy assignment over a histogram (``levels``, ``size``, ``n``): how many groups of
    each cell and size every split takes, largest first.

    A group goes to the split furthest below target in its own cell; where that is a near
    tie (less than one group), the shortfall of the cell's single levels and of the whole
    decides.
    """
    shares = np.asarray(shares, float)
    hist = hist.sort_values(["size", *levels], ascending=[False] + [True] * len(levels), na_position="first")
    mass = hist["size"] * hist["n"]

    def targets(keys):
        return {k: v * shares for k, v in mass.groupby(keys, dropna=False).sum().items()}

    keys = [tuple("" if pd.isna(v) else v for v in row) for row in hist[list(levels)].itertuples(index=False)]
    cell = targets(pd.Series(keys, index=hist.index))
    single = [targets(pd.Series([k[i] for k in keys], index=hist.index)) for i in range(len(levels))]
    whole = shares * mass.sum()
    taken = []
    for key, size, n in zip(keys, hist["size"], hist["n"]):
        size, n = int(size), int(n)
        out = np.zeros(len(shares), np.int64)
        bulk = max(0, n - 4)
        if bulk:
            out = water_fill(cell[key], size, bulk)
        need = cell[key] - out * size
        others = sum((s[k] for s, k in zip(single, key)), whole) - out * size * (len(levels) + 1)
        for _ in range(n - bulk):
            near = need >= need.max() - size
            k = int(np.argmax(np.where(near, others, -np.inf)))
            out[k] += 1
            need[k] -= size
            others[k] -= size * (len(levels) + 1)
        cell[key] = cell[key] - out * size
        for s, k in zip(single, key):
            s[k] = s[k] - out * size
        whole = whole - out * size
        taken.append(out)
    grid = np.array(taken).reshape(len(hist), len(shares))
    return hist.assign(**{f"upto_{i}": grid[:, : i + 1].sum(axis=1) for i in range(len(shares))})


def grouped_splits(
    members: DataFrame,
    *,
    node: str,
    group: str,
    levels: Sequence[str],
    splits: Sequence[tuple[str, float]] = (("train", 0.70), ("validation", 0.15), ("test", 0.15)),
    rank_buckets: int = 64,
) -> DataFrame:
    """Every node with its group's split; ``members`` has one row per node.

    Groups count to the cell (combination of ``levels``) that holds most of their nodes.
    Groups of one cell and size are alike, so the greedy walk runs over their histogram,
    whose rows are bounded by cells times distinct sizes; which groups take which split is
    settled by their rank in a hash order, counted in ``rank_buckets`` buckets so that a
    size shared by a third of all groups is never sorted in one task.
    """
    spark = members.sparkSession
    lv = [f"l{i}" for i in range(len(levels))]
    m = members.select(
        F.col(f"`{node}`").alias("node"),
        F.col(f"`{group}`").alias("grp"),
        *[F.col(f"`{c}`").cast("string").alias(n) for n, c in zip(lv, levels)],
    )
    per_cell = m.groupBy("grp", *lv).agg(F.count(F.lit(1)).alias("c"))
    groups = per_cell.groupBy("grp").agg(
        F.sum("c").alias("size"), F.max(F.struct("c", *lv)).alias("home")
    ).select("grp", "size", *[F.col(f"home.{n}").alias(n) for n in lv])
    groups = groups.withColumn("h", F.xxhash64("grp")).withColumn("bucket", F.pmod("h", F.lit(rank_buckets)).cast("int"))
    groups = materialize(groups, "groups")
    counts = groups.groupBy(*lv, "size", "bucket").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if counts.empty:
        return m.select(F.col("node").alias(node), F.col("grp").alias(group), F.lit(None).cast("string").alias("split"))
    hist = counts.groupby([*lv, "size"], dropna=False, as_index=False)["n"].sum()
    plan = allocate(hist, [s for _, s in splits], lv)
    counts = counts.sort_values([*lv, "size", "bucket"])
    counts["before"] = counts.groupby([*lv, "size"], dropna=False)["n"].cumsum() - counts["n"]
    upto = [f"upto_{i}" for i in range(len(splits))]
    table = counts.drop(columns="n").merge(plan[[*lv, "size", *upto]], on=[*lv, "size"])
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in lv]
        + [T.StructField("size", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("before", T.LongType())]
        + [T.StructField(u, T.LongType()) for u in upto]
    )
    records = table[[*lv, "size", "bucket", "before", *upto]].astype(object)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in records.itertuples(index=False)]
    quota = spark.createDataFrame(rows, schema)
    w = Window.partitionBy(*lv, "size", "bucket").orderBy("h", "grp")
    ranked = groups.withColumn("rank", F.row_number().over(w)).alias("g")
    q = quota.alias("q")
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"q.{c}")) for c in [*lv, "size", "bucket"]]
    place = F.col("q.before") + F.col("g.rank")
    pick = F.lit(splits[-1][0])
    for i in range(len(splits) - 2, -1, -1):
        pick = F.when(place <= F.col(f"q.upto_{i}"), F.lit(splits[i][0])).otherwise(pick)
    chosen = ranked.join(q, on).select(F.col("g.grp").alias("grp"), pick.alias("split"))
    return m.select("node", "grp").join(chosen, "grp").select(
        F.col("node").alias(node), F.col("grp").alias(group), "split"
    )
