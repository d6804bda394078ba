"""Plans that must keep their shape at scale."""
import pytest

import __spark_entry__ as entry
from assayer.operators import associations, drivers, profile, stats, verbs
from assayer.sources.tables import read_parquet

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_read_only_needed_columns(spark):
    df = read_parquet(spark, f"{SF}/lineitem.parquet")
    text = plan(verbs.aggregate(df, ["l_returnflag"], {"n": ("l_tax", "mean")}))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in text
    text = plan(verbs.where(df.select("l_orderkey", "l_tax"), df["l_tax"] > 0.07))
    assert "PushedFilters: [IsNotNull(l_tax), GreaterThan(l_tax,0.07)]" in text


def test_limits_per_group_are_applied_before_the_exchange(spark):
    events = read_parquet(spark, f"{SF}/events.parquet")
    for df in (drivers.top_values(events, ["event_type", "props"]), verbs.drop_duplicates(events, ["user_id"], ["event_id"]),
               profile.sample_values(read_parquet(spark, f"{SF}/events.parquet", row_id=True))):
        assert "WindowGroupLimit" in plan(df) and "Partial" in plan(df)


@pytest.mark.parametrize("name", ["roles_lineitem", "corr_pairs_lineitem", "relationships_orders", "history_prior_run", "history_page",
                                  "segment_lift_orders", "v_rank_by_group", "payload_wrapped", "findings_headline", "drift_compare"])
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_small_ladders_move_no_rows(spark):
    df = read_parquet(spark, f"{SF}/lineitem.parquet", row_id=True)
    text = plan(associations.spearman_pairs(df, ["l_quantity", "l_tax", "l_discount"]))
    physical = text[text.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") <= 3 and physical.count("BroadcastHashJoin") == 3


def test_correlation_is_one_pass_without_shuffle_of_rows(spark):
    df = read_parquet(spark, f"{SF}/lineitem.parquet")
    physical = plan(stats.correlation_pairs(df, ["l_quantity", "l_tax", "l_discount"]))
    assert "Exchange hashpartitioning" not in physical and physical.count("Exchange SinglePartition") == 1
