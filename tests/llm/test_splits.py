import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetlens.llm import splits

SCHEMA = "session_id string, parent string, digest string, tokens string, cfg string, cls string"


def rows_of(seed=2, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        parent = rnd.choice([f"P{rnd.randrange(120)}", " p7 ", None, "unknown", "N/A", ""])
        rows.append((f"s{i:04d}", parent, rnd.choice([None, "pending", "0" * 64, f"h{rnd.randrange(900)}"]), "x", f"c{i % 2}", f"k{i % 3}"))
    rows += [("s0001", "P3", None, "x", "c0", "k0"), (None, "P3", None, "x", "c0", "k0")]
    hub = [(f"t{i:04d}", "HUB", None, "x", "c0", "k0") for i in range(200)]  # a third of all rows
    return rows + hub


def brute(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, p, h, *_ in rows:
        if s is None:
            continue
        find(s)
        for k, v in (("~p", p), ("~h", h)):
            v = (v or "").strip().lower()
            if v and v not in splits.UNKNOWN_WORDS and set(v) != {"0"}:
                a, b = find(s), find(k + v)
                up[max(a, b)] = min(a, b)
    return {s: find(s) for s, *_ in rows if s is not None}


@pytest.mark.parametrize("sizes", [{}, {"fan_in": 2}, {"fan_in": 3, "forest_nodes": 40, "links_per_task": 7}])
def test_groups(spark, sizes):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    rel = [splits.relation_key(F.col("parent")), splits.relation_key(F.col("digest"))]
    got = {r.node: r.group_node for r in splits.related_groups(df, node="session_id", relations=rel, **sizes).collect()}
    assert got == brute(rows)
    if not sizes:
        assert splits.related_groups(df.limit(0), node="session_id", relations=rel).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(4)
    members, n = [], 0
    for g in range(900):
        cell = (f"c{rnd.randrange(2)}", rnd.choice(["k0", "k1", None]))
        for _ in range(1 if g % 3 else rnd.randrange(1, 15)):
            members.append((f"s{n}", f"g{g}", *cell))
            n += 1
    df = spark.createDataFrame(members, "s string, g string, cfg string, cls string")
    out = splits.grouped_splits(df, node="s", group="g", levels=["cfg", "cls"], rank_buckets=5).toPandas()
    assert len(out) == n and out["split"].notna().all() and out.groupby("g")["split"].nunique().max() == 1
    share = out["split"].value_counts() / n
    assert abs(share["train"] - 0.7) < 0.01 and abs(share["test"] - 0.15) < 0.01
    cells = {m[0]: (m[2], m[3]) for m in members}
    by = Counter((cells[s], k) for s, k in zip(out["s"], out["split"]))
    for cell in set(cells.values()):
        total = sum(by[cell, k] for k in ("train", "validation", "test"))
        assert abs(by[cell, "test"] - 0.15 * total) <= 4
    again = splits.grouped_splits(df.repartition(3), node="s", group="g", levels=["cfg", "cls"], rank_buckets=5).toPandas()
    assert dict(zip(again["s"], again["split"])) == dict(zip(out["s"], out["split"]))
    assert splits.grouped_splits(df.limit(0), node="s", group="g", levels=["cfg", "cls"]).count() == 0


def test_counted_fill_is_the_greedy_walk():
    for size, n in ((1, 1000), (3, 77), (5, 64), (2, 333)):
        target = np.array([0.7, 0.15, 0.15]) * size * n
        left, walked = target / size, np.zeros(3, int)
        for _ in range(n):
            k = int(np.argmax(left))
            walked[k] += 1
            left[k] -= 1
        assert (splits.water_fill(target, size, n) == walked).all()


def test_one_big_group_first():
    hist = pd.DataFrame({"l0": ["a", "a"], "size": [1, 70], "n": [30, 1]})
    plan = splits.allocate(hist, (0.7, 0.15, 0.15), ["l0"])
    big = plan[plan["size"] == 70].iloc[0]
    assert (big.upto_0, big.upto_1, big.upto_2) == (1, 1, 1)
    small = plan[plan["size"] == 1].iloc[0]
    assert (small.upto_0, small.upto_1, small.upto_2) == (0, 15, 30)
