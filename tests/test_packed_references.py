import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetlens.operators.packed import split_packed, unpack_values
from packetlens.operators.references import list_references, orphan_references, orphan_report

CASES = [
    None, "", "  ", "[]", "A1", '"A 1"', "A|B", " [A ; B,,C] ", "'it''s' | \"x\"\"y\"", '"a|b"|\'c "d" e\'', "A\tB\r\nC", "A；B · C",
    '"unclosed | a', "a'b'c", "''", '""', '"a" "a"', "{A / B}", "( X & Y )", '" A "', "'\"'", "x" * 9000 + "|" + ",".join("abc" * 3),
]


def test_split_cases(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "t string")
    got = [r.v for r in df.select(split_packed(F.col("t")).alias("v")).collect()]
    assert got == [brute.packed(c) for c in CASES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \"'|;,[]\n", max_size=25), min_size=20, max_size=60))
def test_split_random(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", split_packed(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [brute.packed(t) for t in texts]


def test_long_list_stays_linear(spark):
    text = " | ".join(f'"id {i}"' for i in range(4000))
    df = spark.createDataFrame([(text,)], "t string").select(F.size(split_packed(F.col("t"))).alias("n"))
    assert df.first().n == 4000


def test_unpack_counts_a_row_delivered_twice_once(spark):
    df = spark.createDataFrame([("r1", "A|A", 1), ("r1", "A|A", 2), ("r2", None, 1), (None, "B", 1)], "k string, f string, item int")
    out = unpack_values(df, fields=["f"], row_key="k", source_table="t")
    assert sorted((r.row_key or "", r.item_no, r.item) for r in out.collect()) == [("", 1, "B"), ("r1", 1, "A"), ("r1", 2, "A")]


@pytest.mark.parametrize("match, expected", [("simple", {3}), ("partial", {3, 5}), ("full", {3, 4, 5})])
def test_null_masks(spark, match, expected):
    refs = spark.createDataFrame([(1, "a", "x"), (2, None, None), (3, "a", "z"), (4, "a", None), (5, None, "q")], "n int, p string, q string")
    targets = spark.createDataFrame([("a", "x"), ("b", "y")], "p string, q string")
    out = orphan_references(refs, targets, ref_keys=["p", "q"], target_keys=["p", "q"], match=match)
    assert {r.n for r in out.collect()} == expected
    empty = orphan_references(refs, targets.limit(0), ref_keys=["p", "q"], target_keys=["p", "q"])
    assert {r.n for r in empty.collect()} == {1, 3}


def test_existence_in_time(spark):
    refs = spark.createDataFrame([("r1", "a, b|'A'", 10), ("r2", "a", 30), ("r3", "a", None)], "k string, f string, at int")
    listed = list_references(refs, source_table="t", row_key="k", fields={"f": F.lit("x")}, at="at")
    targets = spark.createDataFrame([("x", "A", 5, 20), ("x", "A", 40, None), ("x", "B", 11, None)], "kind string, id string, a int, z int")
    out = orphan_references(
        listed, targets, ref_keys=["target", "ref_id"], target_keys=["kind", "id"], at="at", valid_from="a", valid_to="z"
    )
    assert {(r.row_key, r.ref_id) for r in out.collect()} == {("r1", "B"), ("r2", "A"), ("r3", "A")}


def test_report_by_month(spark):
    df = spark.sql("select 't' t, timestamp'2024-02-03 04:05:06' at union all select 't', null")
    assert sorted((str(r.period), r.orphans) for r in orphan_report(df, by=["t"], period="at").collect()) == [("2024-02-01", 1), ("None", 1)]
