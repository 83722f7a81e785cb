"""Queries of the problems against their oracle SQL."""

import compare
import pytest

from packetlens.llm import queries as Q

QUERIES, ORACLE = Q.queries(), Q.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - {"p6_report", "p7_copies", "p9_fill"}))
def test_oracle(spark, sf_dir, con, name):
    assert compare.compare(spark, con, sf_dir, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", ["p1_percentiles", "p3_balance", "p9_containers"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
