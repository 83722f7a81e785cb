import random
from collections import defaultdict

import numpy as np

from packetlens.llm import bloom, dedup


def canon(values):
    return tuple(sorted("".join(c for c in (v or "").upper().lower() if c.isalpha() or c.isdecimal()) for v in values))


def test_copies(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(500):
        n = int(rnd.paretovariate(0.8)) % 60
        t, d, v, y = f"Títle of ¼ Straße {n}", f"10.1/{n}", "Venue & Co", str(2000 + n % 5)
        vals = [rnd.choice([t, t.upper(), f" {t}. ", t.replace(" ", " ")]), rnd.choice([d, d.replace(".", "-")]), v, rnd.choice([y, f"({y})"])]
        if rnd.random() < 0.3:
            rnd.shuffle(vals)
        rows.append((f"r{i:03d}", *vals, "clash"))
    rows += [("z1", None, "", " ", "…", "c"), ("z2", None, None, None, None, "c"), (None, "a", "b", "c", "d", "c"), ("z3", "lone", None, None, None, "c")]
    df = spark.createDataFrame(rows, "id string, title string, doi string, venue string, year string, key string")
    groups = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            groups[canon(r[1:5])].append(r[0])
    want = {(i, min(g), len(g)) for g in groups.values() for i in g}
    fields = ["title", "doi", "venue", "year"]
    for few in ({}, {"segment_keys": 20, "broadcast_hashes": 10}):  # also in many segments, and by the shuffle join
        out = dedup.formatted_copies(df, record_id="id", fields=fields, **few)
        assert {(r.record_id, r.first_record_id, r.copies) for r in out.collect()} == want
    assert dedup.formatted_copies(df.limit(0), record_id="id", fields=fields).count() == 0


def test_filters_name_all_repeats_whatever_the_partitions(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 3000)
    repeated = {int(k) for k in keys[:200]}
    df = spark.createDataFrame([(int(k),) for k in [*keys, *keys[:200]]] + [(None,)], "h long")
    for parts, segment in ((1, 1 << 20), (13, 1 << 20), (5, 100)):
        found = [r.h for r in bloom.repeated_hashes(df.repartition(parts), "h", rows=3201, segment_keys=segment).collect()]
        assert len(found) == len(set(found)) and repeated <= set(found) and len(found) < 400
    assert bloom.repeated_hashes(df.limit(0), "h", rows=0).count() == 0


def test_repeats_across_parts_of_one_segment():
    a, b = np.arange(1, 1000, dtype=np.int64) * 0x1234567890AB, np.arange(500, 1500, dtype=np.int64) * 0x1234567890AB
    found = set(bloom.merge_parts([(a, a[:1]), (b, b[:0])]))
    assert set(a[499:]) | {a[0]} <= found and len(found) < 600
