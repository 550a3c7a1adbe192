"""Plan shapes that the scale design relies on."""

from conftest import SF_SMALL
from faultline.plans import registry as R


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics_prune_and_partially_aggregate(spark):
    p = _plan(R.SPARK["issue_metrics"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(week" in p
    assert "partial_count" in p
    assert "PushedFilters" in p


def test_saved_searches_meet_events_on_tokens(spark):
    """Events are joined on (pid, token), in the weeks of the searches; nothing is broadcast by a hint."""
    df = R.SPARK["saved_search_matches"](spark, SF_SMALL)
    p = _plan(df)
    assert "NestedLoop" not in p and "CartesianProduct" not in p
    scans = [line for line in p.splitlines() if "FileScan" in line and "tags#" in line]
    assert scans and all("week" in line[line.index("PartitionFilters"):] for line in scans)
    logical = df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in logical and "strategy=broadcast" not in logical
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    over_events = [line for line in optimized.splitlines() if "Join Inner" in line and "token" in line]
    assert over_events and all("pid" in line for line in over_events)


def test_alert_rules_join_on_keys_and_prune_weeks(spark):
    p = _plan(R.SPARK["alert_evaluate"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "NestedLoop" not in p
    assert "PartitionFilters: [isnotnull(week" in p


def test_retention_reads_no_expired_week(spark):
    p = _plan(R.SPARK["retention_sweep"](spark, SF_SMALL))
    assert "date_add(week" in p[p.index("PartitionFilters"):]


def test_alert_page_is_a_group_limit(spark):
    assert "WindowGroupLimit" in _plan(R.SPARK["alert_list"](spark, SF_SMALL))


def test_no_window_over_a_whole_group(spark):
    """Windows over events, comments and rules are partitioned by the piece as well as by the group."""
    for name, group in (("event_neighbors", "gid"), ("issue_discussion", "issue_id"), ("alerts_by_project", "project_id")):
        df = R.SPARK[name](spark, SF_SMALL)
        p = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in p.splitlines() if "Window [" in line]
        assert windows
        for line in windows:
            assert "piece" in line and group in line
        assert "Checkpoint" not in p and "LogicalRDD" not in p


def test_pages_read_events_a_few_times(spark):
    """issue_detail: metrics and tag counts are written by one event pass each, the plan has one for the newest events and
    one for issues older than they should be; the tables that the product keeps are not rebuilt from events."""
    for name, most in (("issue_detail", 2), ("issue_list", 3), ("issue_list_search", 3)):
        p = _plan(R.SPARK[name](spark, SF_SMALL))
        scans = [line for line in p.splitlines() if "FileScan" in line and "event-table" in line]
        assert 0 < len(scans) <= most, (name, len(scans))
        assert all("week" in line[line.index("PartitionFilters"):] for line in scans)
        assert "SortAggregate" not in p and "NestedLoop" not in p and "CartesianProduct" not in p


def test_reports_have_no_cross_join(spark):
    assert "NestedLoop" not in _plan(R.SPARK["query_log_report"](spark, SF_SMALL))
