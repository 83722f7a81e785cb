"""Exact selections and splits of indivisible groups, one small dynamic program per cell."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlens.runtime import materialize

ROLES = ("train", "validation", "test")
#: States of one table of quotas (bits): quotas up to 1,447 are searched completely.
TABLE_STATES = 1 << 21
#: So much of a quota is left to the table at first; the rest is shared out in proportion.
FIRST_ROOM = 64


def name_digest(*parts: object) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


def exact_subset(sizes: dict[str, int], target: int, *context: object) -> set[str]:
    """Groups whose sizes add up to ``target``.  Groups come in digest order and every reachable
    total keeps the first way it was reached; an unreachable target raises."""
    order = sorted(sizes, key=lambda g: (name_digest(*context, g), g))
    came: dict[int, tuple[int, str] | None] = {0: None}
    for g in order:
        fresh = {t + sizes[g]: (t, g) for t in came if t + sizes[g] <= target and t + sizes[g] not in came}
        came.update(fresh)
        if target in came:
            break
    if target not in came:
        raise ValueError(f"no set of groups adds up to {target}")
    chosen, at = set(), target
    while came[at] is not None:
        at, g = came[at]
        chosen.add(g)
    return chosen


def exact_roles(sizes: dict[str, int], validation: int, test: int, *context: object) -> dict[str, str]:
    """A role for every group so that validation and test hold exactly their quotas.

    Groups come in digest order; at each state the roles are tried in an order given by the
    digest of group and role; the first way to a state is kept."""
    order = sorted(sizes, key=lambda g: (name_digest(*context, g), g))
    layers: list[dict[tuple[int, int], tuple[tuple[int, int], str] | None]] = [{(0, 0): None}]
    for g in order:
        tried = sorted(ROLES, key=lambda r: name_digest(*context, g, r))
        layer: dict = {}
        for v, t in sorted(layers[-1]):
            for role in tried:
                to = (v + sizes[g] * (role == "validation"), t + sizes[g] * (role == "test"))
                if to[0] <= validation and to[1] <= test:
                    layer.setdefault(to, ((v, t), role))
        layers.append(layer)
    if (validation, test) not in layers[-1]:
        raise ValueError(f"quotas {validation} and {test} cannot be met by whole groups")
    roles, at = {}, (validation, test)
    for g, layer in zip(reversed(order), reversed(layers[1:])):
        at, roles[g] = layer[at]
    return roles


def pieces(n: int) -> list[int]:
    """Numbers that add up to ``n`` and that give any three numbers adding up to ``n``: none is
    larger than a third (rounded up) of what is left, so it always fits into the largest."""
    out = []
    while n:
        out.append(-(-n // 3))
        n -= out[-1]
    return out


def _filled(counts: dict[int, int], v: int, t: int) -> tuple[dict[int, tuple[int, int]], int]:
    """How many groups of every size go to validation and test, at the highest reachable of the
    quotas (v, t), (v - 1, t), ... (the larger is lowered), and by how much they were lowered.
    ``v * (t + 1) + t`` numbers a state's bit, equal sizes go in ``pieces``."""
    if not counts:
        return {}, v + t
    width = t + 1
    rows = ((1 << (width * (v + 1))) - 1) // ((1 << width) - 1)
    inside = (1 << (width * (v + 1))) - 1
    state, steps = 1, []
    for s in sorted(counts, reverse=True):
        for k in pieces(counts[s]):
            w = s * k
            steps.append((s, k, state))
            more = (state << (w * width)) & inside if w <= v else 0
            if w <= t:
                more |= (state & (rows * ((1 << (width - w)) - 1))) << w
            state |= more
    a, b, lowered = v, t, 0
    while not state >> (a * width + b) & 1:
        if not a or not b:
            a, b, lowered = 0, 0, v + t
        elif a >= b:
            a, lowered = a - 1, lowered + 1
        else:
            b, lowered = b - 1, lowered + 1
    out = {s: (0, 0) for s in counts}
    for s, k, before in reversed(steps):
        w = s * k
        if before >> (a * width + b) & 1:
            continue
        if a >= w and before >> ((a - w) * width + b) & 1:
            a, out[s] = a - w, (out[s][0] + k, out[s][1])
        else:
            b, out[s] = b - w, (out[s][0], out[s][1] + k)
    return out, lowered


def role_counts(counts: dict[int, int], quota: int, states: int = TABLE_STATES) -> tuple[dict[int, tuple[int, int]], bool]:
    """How many of ``counts[size]`` groups of every size go to validation and test so that both
    hold ``quota`` members, and whether they do.  The rest is left to train.

    Where whole groups cannot meet them, the quotas are lowered by single steps, validation
    first.  Most groups are shared out in proportion; what remains of the quotas is met by a
    table over few states.  Where it cannot be, more is left to the table, in the end (while
    a table has at most ``states``) everything.  Quotas beyond that may be lowered although a
    way exists; no group is ever left out."""
    both = 2 * quota
    while True:  # groups beyond the quota can only go to train
        usable = {s: n for s, n in counts.items() if 0 < s <= both - both // 2}
        total = sum(s * n for s, n in usable.items())
        if total >= both:
            break
        both = total
    v, t = both // 2, both - both // 2
    best, least, room = {s: (0, 0) for s in usable}, both + 1 if both else 0, FIRST_ROOM
    while least:
        share, want, bulk = max(0, v - room) / total, 0.0, {}
        got = 0
        for s in sorted(usable, reverse=True):
            want += share * s * usable[s]
            bulk[s] = [max(0, min(int((want - got) / s), usable[s] // 2))] * 2
            got += s * bulk[s][0]
        left = [v - got, t - got]
        for s in sorted(usable, reverse=True):  # only where the table is still too large
            while (left[0] + 1) * (left[1] + 1) > states and sum(bulk[s]) < usable[s] and s <= max(left):
                k = int(left[1] >= left[0])
                bulk[s] = [bulk[s][0] + (k == 0), bulk[s][1] + (k == 1)]
                left[k] -= s
        rest = {s: n - sum(bulk[s]) for s, n in usable.items() if n > sum(bulk[s]) and s <= max(left)}
        found, lowered = _filled(rest, *left)
        if lowered < least:
            best, least = {s: tuple(x + y for x, y in zip(bulk[s], found.get(s, (0, 0)))) for s in usable}, lowered
        if not any(map(sum, bulk.values())) or (room + 1) ** 2 > states:
            break
        room = min(room * 4, v) if (v + 1) * (t + 1) <= states else room * 4
    return {s: best.get(s, (0, 0)) for s in counts}, not least and both == 2 * quota


def _whole_cells(groups: DataFrame, cell: Sequence[str], group: str, size: str, namespace: str, share: float) -> DataFrame:
    """Roles of all groups of every cell.  The program sees a cell's histogram of group sizes;
    which groups of one size take which role goes by their rank in digest order, counted in
    256 buckets, so no task holds or sorts all groups of a cell."""
    kinds = dict(groups.dtypes)
    digest = F.sha2(F.concat_ws("\0", F.lit(namespace), F.lit("split"), *[F.col(c).cast("string") for c in (*cell, group)]), 256)
    rows = groups.select(*cell, group, F.col(size).cast("long").alias(size), digest.alias("digest"))
    rows = materialize(rows.withColumn("bucket", F.substring("digest", 1, 2)), "groups")
    alike = [*cell, size]
    counts = rows.groupBy(*alike, "bucket").agg(F.count(F.lit(1)).alias("_many"))
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in cell], f"{size} long", "validation long", "test long", "exact boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = {int(s): int(n) for s, n in zip(pdf[size], pdf["_many"])}
        roles, exact = role_counts(sizes, int(sum(s * n for s, n in sizes.items()) * share + 1e-9))
        out = pdf[alike].copy()
        out["validation"], out["test"] = ([roles[int(s)][i] for s in pdf[size]] for i in (0, 1))
        out["exact"] = exact
        return out

    def same(a: str, b: str, names: Sequence[str]) -> list:
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]

    plan = counts.groupBy(*alike).agg(F.sum("_many").alias("_many")).groupBy(*cell).applyInPandas(run, schema)
    before = F.coalesce(F.sum("_many").over(Window.partitionBy(*alike).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = counts.withColumn("before", before).alias("c").join(plan.alias("p"), same("c", "p", alike)).select(
        *[f"c.{c}" for c in (*alike, "bucket", "before")], "p.validation", "p.test", "p.exact"
    )
    rank = F.row_number().over(Window.partitionBy(*alike, "bucket").orderBy("digest", group))
    j = rows.withColumn("rank", rank).alias("g").join(place.alias("q"), same("g", "q", [*alike, "bucket"]))
    at = F.col("q.before") + F.col("g.rank")
    role = F.when(at <= F.col("q.validation"), "validation").when(at <= F.col("q.validation") + F.col("q.test"), "test").otherwise("train")
    return j.select(*[f"g.{c}" for c in (*cell, group, size)], role.alias("split"), "q.exact")


def cell_splits(
    groups: DataFrame, *, cell: Sequence[str], group: str, size: str, target: int | None, namespace: str, share: float = 0.15
) -> DataFrame:
    """Per cell: an exact selection of ``target`` members (all, where None or more than there
    are) and roles with floor(share) quotas for validation and test.

    A cell is one configuration and class.  With a target the program runs over the sizes of
    the cell's groups in one task per cell; without one it runs over the histogram of sizes,
    and every group gets a role.  Where groups cannot meet a quota it is lowered until they can; the column
    ``exact`` says whether that happened.
    Returns ``cell, group, size, split, exact``.
    """
    if target is None:
        return _whole_cells(groups, cell, group, size, namespace, share)
    kinds = dict(groups.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in cell], f"{group} {kinds[group]}", f"{size} long", "split string", "exact boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in cell]
        sizes = {g: int(n) for g, n in zip(pdf[group], pdf[size])}
        want = min(target, sum(sizes.values()))
        exact, chosen = True, None
        while chosen is None:
            try:
                chosen = exact_subset(sizes, want, namespace, "select", *key)
            except ValueError:
                want, exact = want - 1, False
        kept = {g: sizes[g] for g in chosen}
        quota, roles = int(sum(kept.values()) * share), None
        v = t = quota
        while roles is None:
            try:
                roles = exact_roles(kept, v, t, namespace, "split", *key)
            except ValueError:
                exact = False
                v, t = (v - 1, t) if v >= t else (v, t - 1)
        names = sorted(roles)
        out = pd.DataFrame({group: names, size: [kept[n] for n in names], "split": [roles[n] for n in names]})
        for c, value in zip(cell, key):
            out[c] = value
        out["exact"] = exact
        return out[[*cell, group, size, "split", "exact"]]

    rows = groups.select(*cell, group, F.col(size).cast("long").alias(size))
    return rows.groupBy(*cell).applyInPandas(run, schema)
