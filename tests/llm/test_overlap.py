import random

import pytest
from pyspark.sql import functions as F

from packetlens.llm import overlap


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def mutate(rnd, t, n):
    for _ in range(n):
        p = rnd.randrange(len(t) + 1)
        kind = rnd.randrange(3)
        t = t[:p] + rnd.choice("abz/é") + t[p:] if kind == 0 else t[: max(0, p - 1)] + t[p:] if kind == 1 else t[: max(0, p - 1)] + rnd.choice("abz") + t[p:]
    return t


@pytest.mark.parametrize("seed, q, few", [(1, 12, 1 << 22), (2, 5, 1 << 22), (3, 7, 0)])  # the last by the shuffle join
def test_near_texts_against_all_pairs(spark, seed, q, few):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé/") for _ in range(rnd.choice([0, 1, 3, 5, 9, 13, 15, 16, 17, 25, 60]))) for _ in range(60)]
    left = [*base, "aaaaaaaaaaaaaaaaaaaaaaaa", None, None]
    right = [mutate(rnd, rnd.choice(base), rnd.randrange(5)) for _ in range(150)] + ["aaaaaaaaaaaaaaaaaaaaaaaaaa", None, base[0]]
    a, b = (spark.createDataFrame([(t,) for t in x], "t string") for x in (left, right))
    got = {(r.text_a, r.text_b) for r in overlap.near_texts(a, b, q=q, broadcast_shingles=few).collect()}
    want = {(x, y) for x in set(left) for y in set(right) if x is not None and y is not None and abs(len(x) - len(y)) <= 2 and lev(x, y) <= 2}
    assert got == want
    assert overlap.near_texts(a.limit(0), b).count() == 0


def test_prefix_needs_more_edits_than_allowed():
    # of 31 shingles of ten, those at 5..25 are shared: the others alone need two edits
    shared = [(1 + p % 3, p, p) for p in range(5, 26)]
    prefix = overlap.rare_prefix(40, shared, 10, 2)
    assert prefix and {p % 3 for _, p in prefix} == {0}
    assert overlap.rare_prefix(40, shared[:3], 10, 2) == []
    assert len(overlap.rare_prefix(12, [(1, 7, p) for p in range(3)], 10, 2)) == 3


def test_url_key(spark):
    same = [
        "https://www.Host.example/a/b/index.html?x=1#y", "http://host.example:8080/a/b/", "HOST.EXAMPLE/a/b", "//host.example/%61/b", " https://u@host.example/a/b ",
    ]
    odd = ["https://host.example/100%", "https://host.example/a+b", "", None, "https:///", "http://host.example/"]
    df = spark.createDataFrame([(t,) for t in same + odd], "u string").select(overlap.url_key(F.col("u")).alias("k"))
    got = [r.k for r in df.collect()]
    assert got[: len(same)] == ["host.example/a/b"] * len(same)
    assert got[len(same) :] == ["host.example/100%", "host.example/a+b", None, None, None, "host.example"]


def test_records(spark):
    rows = [
        (1, " TRAIN ", "s1", "page-1", "https://h.example/aaaaaaaaaaaaaaaaaaaa"), (2, "test", "s1", None, None), (3, "validation", None, "PAGE_1", None),
        (4, "Test", None, None, "http://h.example/aaaaaaaaaaaaaaaaaabb"), (5, None, "s1", "page-1", None), (6, "holdout", "s1", None, None),
        (7, "test", None, " - ", None), (1, " TRAIN ", "s1", "page-1", "https://h.example/aaaaaaaaaaaaaaaaaaaa"), (None, "test", "s1", None, None),
    ]
    df = spark.createDataFrame([(*r, True) for r in rows], "n long, split string, s string, p string, u string, in_eval boolean")
    out = overlap.cross_split_overlaps(
        df, record_id="n", split="split", exact={"s": F.col("s"), "p": overlap.compact_key(F.col("p"))}, near={"u": overlap.url_key(F.col("u"))}
    )
    assert {(r.eval_id, r.train_id, r.by) for r in out.collect()} == {(2, 1, "s"), (3, 1, "p"), (4, 1, "u")}
    rules = {"exact": {"s": F.col("s"), "p": overlap.compact_key(F.col("p"))}, "near": {"u": overlap.url_key(F.col("u"))}}
    assert sorted(r.record for r in overlap.overlapping_records(df, record_id="n", split="split", **rules).collect()) == [2, 3, 4]
