"""Every registered query against its SQL, and the shape of the plans."""

import json
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

from eventflow.operators import state
from eventflow.plans import all_queries, states

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], ORACLES.get(name)) is None


def test_every_query_has_sql():
    assert set(all_queries.ORACLES) == set(all_queries.QUERIES)
    assert set(all_queries.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["customer_id", "open_tasks", "urgent_tasks", "first_due_us"]
    assert df.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_answers(spark):
    folder = "/root/testdata/sf0.01"
    counts = {r.outcome: r["count"] for r in state.outcomes(states.log(spark, folder)).groupBy("outcome").count().collect()}
    assert counts == {"applied": 6737, "rejected_exists": 1573, "created_by_update": 1256, "noop_delete": 434}
    assert all_queries.QUERIES["state_fold"](spark, folder).count() == 120
    live = all_queries.QUERIES["fleet_apply_events"](spark, folder).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in live} == {"node": 18, "process": 26}


NO_LOOP = [n for n in all_queries.QUERIES if not n.startswith("stream_") and n != "state_fold_stream"]


@pytest.mark.parametrize("name", NO_LOOP)
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["route_fanout", "queue_group_assign", "route_many"])
def test_few_matches_do_not_shuffle_events(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "event_id" not in "".join(re.findall(r"Exchange hashpartitioning.*", text))


def test_history_limits_before_the_shuffle(spark):
    text = plan(state.history(states.log(spark, SF).withColumnRenamed("slot", "revision")))
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Partial")


def test_fold_aggregates_before_the_shuffle(spark):
    """Updates and deletes by entity after a partial aggregate, creates by (entity, segment), and
    the compacted rows by entity."""
    text = plan(state.fold(states.log(spark, SF)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3
    assert "partial_max_by" in text and "props" not in text


def test_scan_pushes_filters(spark):
    text = plan(state.state_at(states.log(spark, SF), 100))
    assert re.search(r"PushedFilters: \[[^\]]*event_id", text)
