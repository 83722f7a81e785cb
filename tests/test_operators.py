import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.functions import text as T
from packetlens.operators import bootstrap, checks, components, descriptives, distances, matrix, relational, rollups, selection, weights
from packetlens.plans import packets
from packetlens.sources import contracts, tables


def numpy_ks(lv, lw, rv, rw):
    grid = np.union1d(lv, rv)
    f = lambda v, w: np.array([w[v <= g].sum() / w.sum() for g in grid])
    return np.abs(f(lv, lw) - f(rv, rw)).max()


@pytest.fixture(scope="module")
def obs(spark):
    rnd = random.Random(3)
    rows = []
    for cfg in ("a", "b"):
        for s in range(12):
            for p in range(rnd.randrange(1, 9)):
                v = None if rnd.random() < 0.1 else rnd.randrange(-3, 40) if cfg == "a" else rnd.randrange(0, 25)
                rows.append((cfg, "k", s, p, v, rnd.choice(["c2s", "s2c"])))
    return rows, spark.createDataFrame(rows, "cfg string, cls string, s int, p int, v long, d string")


def test_ks_and_tv_against_numpy(spark, obs):
    rows, df = obs
    m = weights.value_masses(df, group=["cfg", "cls"], session="s", features={"v": F.col("v")}, direction="d")
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, left_side string, right_side string")
    keys = ["cls", "feature", "stratum"]
    diff = distances.signed_masses(weights.normalized(m, group=["cfg", "cls"]), pairs, side="cfg", keys=keys)
    got = {(r.stratum, r.estimator): r.distance for r in distances.weighted_ks(diff, keys=keys).collect()}
    tv = {(r.stratum, r.estimator): r.distance for r in distances.total_variation(diff, keys=keys).collect()}
    for stratum in ("all", "c2s", "s2c"):
        for estimator in weights.ESTIMATORS:
            sides = []
            for cfg in ("a", "b"):
                kept = [(s, v) for c, _, s, _, v, d in rows if c == cfg and v is not None and stratum in ("all", d)]
                n = {s: sum(x == s for x, _ in kept) for s, _ in kept}
                w = np.array([1 / n[s] if estimator == "session_balanced" else 1.0 for s, _ in kept])
                sides += [np.array([v for _, v in kept]), w / w.sum()]
            assert got[stratum, estimator] == pytest.approx(numpy_ks(*sides), abs=1e-12)
            values = np.union1d(sides[0], sides[2])
            half = 0.5 * sum(abs(sides[1][sides[0] == v].sum() - sides[3][sides[2] == v].sum()) for v in values)
            assert tv[stratum, estimator] == pytest.approx(half, abs=1e-12)
    same = spark.createDataFrame([("q", "a", "a"), ("r", "a", "none")], "pair_id string, left_side string, right_side string")
    diff = distances.signed_masses(weights.normalized(m, group=["cfg", "cls"]), same, side="cfg", keys=keys)
    assert {(r.pair_id, r.distance) for r in distances.weighted_ks(diff, keys=keys).collect()} == {("q", 0.0)}


def test_quantiles_and_summary(spark):
    df = spark.createDataFrame([("g", v, m) for v, m in ((1, 0.25), (2, 0.25), (10, 0.5))], "g string, value long, mass double")
    q = descriptives.weighted_quantiles(df, keys=["g"], ranks=(0.1, 0.25, 0.5, 0.75)).first()
    assert (q.q10, q.q25, q.q50, q.q75) == (1, 1, 2, 10)
    vals = [3.0, 1.0, 4.0, 1.0, 5.0]
    s = descriptives.plain_summary(spark.createDataFrame([("g", v) for v in [*vals, None]], "g string, v double"), keys=["g"], value="v").first()
    assert s["count"] == 5 and s.q25 == np.quantile(vals, 0.25) and s.maximum == 5.0
    d = spark.createDataFrame([("g", 1.0, 5.0), ("g", 1.0, 6.0), ("g", 2.0, 7.0)], "g string, x double, y double")
    assert [r.r for r in descriptives.average_ranks(d, keys=["g"], value="x", out="r").orderBy("y").collect()] == [1.5, 1.5, 3.0]
    assert descriptives.spearman(d, keys=["g"], left="x", right="y").first().rho == pytest.approx(np.sqrt(3) / 2)
    runs = spark.createDataFrame([("g", v) for v in (1, 3, 4, 5, 5, 9, None)], "g string, v int")
    assert descriptives.longest_runs(runs, keys=["g"], value="v").first().longest_run == 3


def test_bootstrap(spark):
    values = np.array([0.1, 0.4, 0.2, 0.9])
    a = bootstrap.interval(values, "x|y", replicates=2000)
    assert a == bootstrap.interval(values, "x|y", replicates=2000) != bootstrap.interval(values, "x|z", replicates=2000)
    assert a[0] < values.mean() < a[1]
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    row = bootstrap.bootstrap_intervals(df, keys=["k"], value="v", order=["i"]).first()
    assert row.mean_ci_low < row.mean_ci_high
    one, two = (np.random.Generator(np.random.PCG64(1)) for _ in range(2))
    whole = one.integers(0, 7, size=(10, 7))
    assert (whole == np.vstack([two.integers(0, 7, size=(4, 7)), two.integers(0, 7, size=(6, 7))])).all()


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)]
    edges += [(200, x) for x in range(201, 400)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (1, None), (5, 5)], "a long, b long")
    got = {r.a: r.b for r in components.star_forest(df).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components.star_forest(df.limit(0)).count() == 0


def test_tokens_of_different_columns_do_not_match(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "x"), (3, "x", None), (4, None, None)], "n int, a string, b string")
    got = {r.node: r.component for r in components.token_components(df, node="n", tokens=[F.col("a"), F.col("b")]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_selection():
    sizes = {f"g{i}": 1 + i % 3 for i in range(20)}
    chosen = selection.exact_subset(sizes, 17, "ns", "cell")
    assert sum(sizes[g] for g in chosen) == 17
    with pytest.raises(ValueError):
        selection.exact_subset({"a": 2, "b": 2}, 3, "ns")
    roles = selection.exact_roles(dict.fromkeys([f"s{i}" for i in range(20)], 1), 3, 3, "ns")
    assert sorted(roles.values()).count("train") == 14 and list(roles.values()).count("test") == 3
    with pytest.raises(ValueError):
        selection.exact_roles({"a": 2, "b": 2}, 1, 0, "ns")
    assert roles == selection.exact_roles(dict.fromkeys([f"s{i}" for i in range(20)], 1), 3, 3, "ns")


def reachable_quotas(counts, quota):
    """The quotas that group by group trial of all roles ends at."""
    states = {(0, 0)}
    for s, n in counts.items():
        for _ in range(n):
            states |= {(v + s, t) for v, t in states if v + s <= quota} | {(v, t + s) for v, t in states if t + s <= quota}
    v = t = quota
    while (v, t) not in states:
        v, t = (v - 1, t) if v >= t else (v, t - 1)
    return v, t


def test_role_counts():
    rnd = random.Random(5)
    for _ in range(300):
        counts = {rnd.randrange(1, rnd.choice([4, 12, 40])): rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 5))}
        quota = sum(s * n for s, n in counts.items()) * 15 // 100
        roles, exact = selection.role_counts(counts, quota)
        v, t = (sum(s * roles[s][i] for s in counts) for i in (0, 1))
        assert all(sum(roles[s]) <= n for s, n in counts.items())
        assert (v, t) == reachable_quotas(counts, quota) and exact == (v == t == quota)
    roles, exact = selection.role_counts({1: 2_000_000, 2: 300_000, 300: 4}, 390_180)
    assert exact and all(sum(s * r[i] for s, r in roles.items()) == 390_180 for i in (0, 1))


def test_whole_cells_keep_every_group(spark):
    rnd = random.Random(7)
    rows = [(c, "k", f"{c}{i}", 1 + rnd.randrange(3) * (i % 2)) for c in ("a", "b", None) for i in range(120)] + [("d", "k", "d0", 4)]
    df = spark.createDataFrame(rows, "cfg string, cls string, grp string, n int")
    out = selection.cell_splits(df, cell=["cfg", "cls"], group="grp", size="n", target=None, namespace="ns").collect()
    assert sorted((r.grp, r.n) for r in out) == sorted((g, n) for _, _, g, n in rows)
    for c in ("a", "b", None, "d"):
        own = [r for r in out if r.cfg == c]
        quota = sum(r.n for r in own) * 15 // 100
        assert [sum(r.n for r in own if r.split == s) for s in ("validation", "test")] == [quota, quota] and all(r.exact for r in own)


def test_group_splits_keep_cells_of_any_size(spark, tmp_path):
    rows = [(i, f"s{i:04d}", "accepted", "Q1-A-B-C", "k", f"parent-group-{i:04d}", None) for i in range(100)]
    names = "record_no int, session_id string, status string, configuration_id string, class_name string, parent_group_id string, pcap_sha256 string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/session_manifest.parquet")
    out = packets.group_splits(spark, str(tmp_path)).groupBy("split").agg(F.sum("n").alias("n")).collect()
    assert {r.split: r.n for r in out} == {"train": 70, "validation": 15, "test": 15}


def test_leakage_groups_of_the_manifest(spark, tmp_path):
    zero, names = "0" * 64, "record_no int, session_id string, status string, configuration_id string, class_name string, parent_group_id string, pcap_sha256 string"
    rows = [("s0", "P1", zero), ("s1", " p1 ", "pending"), ("s2", "UNKNOWN", zero), ("s3", "unknown", "ab12"), ("s4", "-", "AB12"), ("s5", None, "n/a")]
    df = spark.createDataFrame([(i, s, "accepted", "Q1-A-B-C", "k", p, h) for i, (s, p, h) in enumerate(rows)], names)
    df.write.parquet(f"{tmp_path}/session_manifest.parquet")
    got = {(r.component, r.n) for r in packets.group_splits(spark, str(tmp_path)).collect()}
    assert got == {("s0", 2), ("s2", 1), ("s3", 2), ("s5", 1)}


def test_text(spark):
    df = spark.createDataFrame([("Réseau https://x.y/z?q=1 Traffic+Flow!", "<HTTPS://doi.org/10.1/AB?>", " b | a||a ", '"2020"^^x')], "a string, d string, l string, y string")
    r = df.select(
        T.normalize_text(F.col("a")).alias("a"), T.clean_doi(F.col("d")).alias("d"), T.join_ids(T.split_ids(F.col("l"))).alias("l"),
        T.literal_year(F.col("y")).alias("y"), T.unordered_key(F.lit("b"), F.lit("a")).alias("k"), T.normalize_host(F.lit("MÜnchen.Example.")).alias("h"),
        T.https_url(F.lit("https://u@h/x")).alias("u"), T.https_url(F.lit("https://h/x")).alias("v"), T.twelve_digits(F.lit(0.5)).alias("t"),
        T.safe_component(F.lit("../x")).alias("s"), T.is_sha256(F.lit("0" * 64)).alias("i"),
    ).first()
    assert tuple(r) == ("re seau traffic+flow", "10.1/ab", "a | b", 2020, "a|b", "xn--mnchen-3ya.example", False, True, "0.5", False, True)
    flags = spark.range(256).select(F.col("id").cast("int").alias("m"))
    assert flags.where(T.flag_mask(T.flag_pattern(F.col("m"))) != F.col("m")).count() == 0


def test_relational(spark):
    df = spark.createDataFrame([(3, "k", "z"), (1, "k", "y"), (2, "j", None)], "o int, key string, v string")
    out = relational.first_wins(df, key=F.col("key"), order=["o"], number="id").orderBy("o").collect()
    assert [(r.id, r.o, r.v) for r in out] == [("P00001", 1, "y"), ("P00002", 2, None)]
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in relational.two_sided_difference(a, b, keys=["x"]).collect()) == [(1, "missing"), (3, "unexpected")]
    roll = spark.createDataFrame([("p", "no"), ("p", "yes"), ("q", "no"), ("r", None)], "k string, o string")
    got = {(r.k, r.outcome, r.members) for r in rollups.precedence_rollup(roll, keys=["k"], outcome="o", order=["yes", "unknown", "no"]).collect()}
    assert got == {("p", "yes", 2), ("q", "no", 1), ("r", "no", 0)}


def test_matrix(spark):
    assert matrix.select_known([1, 2, 3], [3, 1], "n") == [1, 3]
    with pytest.raises(ValueError):
        matrix.select_known([1], [2], "n")
    assert matrix.fill_template("run {a}", {"a": 1}) == "run 1"
    with pytest.raises(ValueError):
        matrix.fill_template("{b}", {})
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "z")], "a int, b string")
    dims = {"a": spark.createDataFrame([(1,), (2,)], "a int"), "b": spark.createDataFrame([("x",)], "b string")}
    assert sorted((r.a, r.b, r.state) for r in matrix.product_coverage(rows, dims).collect()) == [(1, "x", "repeated"), (2, "x", "missing"), (2, "z", "unexpected")]


def test_cohort_day_coverage(spark, tmp_path):
    rows = [("t", " a_1", "k.", 1), ("t", "A-1", "K", 1), ("t", "a-1", "m", 2), ("t", "b-1", "k", 2), ("t", "b-1", None, 2), ("u", "c-1", "k", 3)]
    df = spark.createDataFrame(rows, "protocol_id string, configuration_id string, class_name string, d int")
    df.select("*", F.date_add(F.lit("2026-01-01").cast("date"), F.col("d")).alias("capture_day")).write.parquet(f"{tmp_path}/packet_observations.parquet")
    got = {(r.protocol_id, r.configuration_id, r.class_name, r.capture_day.day - 1, r.state) for r in packets.cohort_day_coverage(spark, str(tmp_path)).collect()}
    missing = {("A-1", "k", 2), ("A-1", "m", 1), ("B-1", "k", 1), ("B-1", "m", 1), ("B-1", "m", 2)}
    assert got == {("t", *m, "missing") for m in missing} | {("t", "A-1", "k", 1, "repeated"), ("t", "B-1", None, 2, "unexpected")}


def test_contract_checks(spark):
    t = {"a": spark.createDataFrame([("1", "x", "b1 | b9"), ("1", "y", "")], "id string, e string, bs string"), "b": spark.createDataFrame([("b1",)], "id string")}
    contract = {"tables": {"a": {"primary_key": "id", "rows": 2, "enums": {"e": ["x"]}, "foreign_keys": [{"column": "bs", "table": "b", "key": "id", "list": True}]}}}
    got = {r["check"]: (r.passed, r.observed) for r in checks.report(spark, checks.contract_checks(t, contract)).collect()}
    assert got == {"a.primary_key": (False, 1), "a.e.enum": (False, 1), "a.rows": (True, 2), "a.bs.foreign_key": (False, 1)}
    assert checks.report(spark, [checks.same_rows("s", t["b"], t["b"])]).first().passed


def test_tables(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('﻿id,?note\n1,"a ""q"",\nb"\n2,\n', encoding="utf-8")
    df = tables.read_table(spark, str(p), exact=["id", "note"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'a "q",\nb'), ("2", "")]
    with pytest.raises(tables.HeaderError):
        tables.read_table(spark, str(p), required=["gone"])
    out = str(tmp_path / "out")
    tables.write_table(df, out, fields=["id", "note"], order=["id"])
    assert tables.read_table(spark, out).count() == 2 and tables.row_count(spark, str(p)) == 2 and tables.row_count(spark, "x.txt") is None
    with pytest.raises(Exception):
        tables.write_table(df, out, fields=["id", "note"])
    with pytest.raises(ValueError):
        tables.write_table(df, out + "2", fields=["id"])
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "f.txt").write_text("Secret here")
    assert [r.token for r in tables.token_hits(spark, str(tmp_path / "tree"), ["SECRET", "no"]).collect()] == ["secret"]


def test_contracts(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"a": 1, "a": 2}')
    with pytest.raises(contracts.ContractError):
        contracts.load_strict(p)
    contracts.write_report(p, {"b": 1, "a": [2]})
    assert list(json.loads(p.read_text())) == ["a", "b"] and contracts.load_strict(p, keys=["a", "b"])[0]["b"] == 1
    with pytest.raises(contracts.ContractError):
        contracts.load_strict(p, keys=["a"])
    assert contracts.allow_list({"H.Example.": "c"}) == {"h.example": "c"}
    for bad in ({}, {"-": "c"}, [{"host": "a.b", "class_name": "c"}, {"host": "A.b", "class_name": "c"}]):
        with pytest.raises(contracts.ContractError):
            contracts.allow_list(bad)
    target = tmp_path / "done"
    with contracts.staged_folder(target) as folder:
        contracts.copy_into(folder, {"x/y.bin": b"1"})
        assert not target.exists()
    assert (target / "x/y.bin").read_bytes() == b"1"
    with pytest.raises(FileExistsError):
        with contracts.staged_folder(target):
            pass
    with pytest.raises(contracts.ContractError):
        contracts.copy_into(target, {"../z": b""})
    with pytest.raises(contracts.ContractError):
        contracts.pages([{"page_id": "1", "url": "http://x"}], fields=["page_id", "url"])
    with pytest.raises(contracts.ContractError):
        contracts.configurations([{"configuration_id": "1", "a": "x", "b": ""}], fields=["configuration_id", "a", "b"], together=["a", "b"])
