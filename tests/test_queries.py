"""Named queries against their SQL on the smallest tables; ASSAYER_ALL=1 runs every one."""
import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF = os.environ.get("ASSAYER_SF", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()
CHOSEN = [n for n in ORACLE if os.environ.get("ASSAYER_ALL")] or [n for n in (
    "roles_orders", "roles_dirty_orders", "profile_columns_labels", "profile_table_with_gaps", "sample_values_orders", "clean_orders",
    "numeric_summary_events", "corr_matrix_lineitem", "relationships_orders", "spearman_with_gaps", "iqr_outliers_events",
    "v_rank_by_group", "v_cumsum", "v_diff_by_group", "v_quantile_by_group", "v_describe", "v_qcut", "v_arithmetic",
    "segment_lift_orders", "quality_overall", "drift_compare", "histogram_events", "findings_shape", "payload_markdown", "payload_wrapped",
    "history_prior_run", "limit_audit_events") if n in ORACLE]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    assert differences(con, ORACLE[name], entry.queries()[name](spark, SF)) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 11
