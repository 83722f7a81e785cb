"""Every query of the core against its oracle SQL, and row counts of those without one."""

import compare
import pytest

from packetlens.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
#: share the plan of a query that is compared below; compared at sf0.01 by the driver
SAME_PLAN = {
    "ks_packet_pooled", "ks_by_direction_stratum", "tv_direction", "summary_linear_quantiles", "marginal_wide", "average_rank",
    "spearman_rank", "pair_feature", "pair_family", "first_k_summary", "sequential_feature", "preprocess_jobs", "routing_default",
    "weighted_quantiles", "venn_cells", "reject_histogram",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SAME_PLAN))
def test_oracle(spark, sf_dir, con, name):
    assert compare.compare(spark, con, sf_dir, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"bootstrap_ci"}))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
