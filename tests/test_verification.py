import pytest

from packetlens.operators import verification as V
from packetlens.operators.checks import Check, report

SCHEMA = "parent string, digest string, cfg string, cls string, split string, leak string, rule string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def found(df):
    return sorted((r.rule, r.subject, r.observed) for r in df.collect())


def check(df):
    return V.split_violations(df, parent="parent", digest="digest", cell=["cfg", "cls"], split="split", leakage="leak")


def test_sound_split_breaks_no_rule(spark):
    rows = [(f"p{i}", f"d{i}", "c", "k", "validation" if i < 3 else "test" if i < 6 else "train", f"g{i}") for i in range(20)]
    assert found(check(frame(spark, rows))) == []
    assert found(check(frame(spark, []))) == []


def test_each_rule(spark):
    rows = [("p1", "d1", "c", "k", "train", "g1"), ("p1", "d2", "c", "k", "test", "g2"), ("p3", "d2", "c", None, None, ""), (None, None, "c", "k", "dev", None)]
    assert found(check(frame(spark, rows))) == [
        ("content_crosses", "d2", "2"), ("invalid_split", "", "1"), ("invalid_split", "dev", "1"), ("leakage_missing", "", "2"),
        ("leakage_torn", "d2", "2"), ("leakage_torn", "p1", "2"), ("parent_crosses", "p1", "2"), ("quota", "c/", "0 0 0"), ("quota", "c/k", "1 0 1"),
    ]


def test_manifest(spark):
    rows = [("a", "x", "s1"), ("a", "y", "s2"), ("b", None, "s3"), (None, "z", None), (None, None, "s1"), ("c", "w", "s1")]
    df = spark.createDataFrame(rows, "path string, sha string, session string")
    assert found(V.manifest_violations(df, path="path", digest="sha", session="session")) == [
        ("duplicate_path", "a", "2"), ("duplicate_session", "s1", "2"), ("partial_binding", "b", "1"), ("partial_binding", "z", "1"),
    ]
    assert found(V.manifest_violations(df.limit(0), path="path", digest="sha", session="session")) == []


def test_attributes_and_numbers(spark):
    rows = spark.createDataFrame([("k", "a", "x"), ("k", "b", "x"), ("k", None, "x"), ("u", "a", None)], "key string, os string, net string")
    declared = spark.createDataFrame([("k", "a", "x")], "key string, os string, net string")
    got = {(r.key, r.attribute, r.stated, r.declared, r.rows) for r in V.attribute_conflicts(rows, declared, key="key", attributes=["os", "net"]).collect()}
    assert got == {("k", "os", "b", "a", 1), ("k", "os", None, "a", 1), ("u", "os", "a", None, 1)}
    a, b = (spark.createDataFrame(r, "key string, n int") for r in ([("k", 1), ("l", 2), ("m", 3)], [("k", 1), ("l", 5), ("o", 1)]))
    states = {r.key: r.state for r in V.declared_against_observed(a, b, keys=["key"], count="n").collect()}
    assert states == {"k": "equal", "l": "different", "m": "unobserved", "o": "undeclared"}


@pytest.mark.parametrize("n", [0, 2])
def test_report(spark, n):
    df = spark.range(n)
    assert [(r.passed, r.observed) for r in report(spark, [Check("c", df)]).collect()] == [(n == 0, n)]
