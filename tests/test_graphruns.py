"""Routes and parallel steps of small graphs worked out by hand; whole tables are compared with SQL in test_queries."""

import pytest

from spanforge.operators import graphruns as x

NODE = "graph_id long, node_id string, node_type string, title string, status string, superstep long, inputs string, outputs string"
EDGE = "graph_id long, source string, target string, edge_type string, condition string"


def node(i, step, status="succeeded", reads="{}", writes="{}", kind="llm", title=""):
    return (1, i, kind, title, status, step, reads, writes)


def sync(spark, *nodes, states=()):
    n = spark.createDataFrame(list(nodes), NODE)
    s = spark.createDataFrame([(1, *x) for x in states], "graph_id long, superstep long, state string")
    return sorted((r.superstep, r.kind) for r in x.sync_issues(n, s).collect())


def test_parallel_steps(spark):
    a, b = node("a", 1, writes='{"k":1}'), node("b", 1, writes='{"k":2}')
    join = node("j", 2)
    assert sync(spark, a, b, join) == []
    assert sync(spark, a, b, node("j", 2, "running")) == [(1, "write_conflict")]
    assert sync(spark, a, b) == [(1, "missing_join"), (1, "write_conflict")]
    assert sync(spark, a, node("b", 1, reads='{"k":0}'), join) == [(1, "race_condition")]
    assert sync(spark, node("a", 1, reads='{"k":0}', writes='{"k":1}'), node("b", 1), join) == []
    assert sync(spark, a, node("b", 1, "failed"), node("j", 2, "skipped")) == [(1, "downstream_failure"), (1, "failed_parallel")]
    assert sync(spark, node("a", 1), node("b", 1), join, states=[(1, '{"e":"error"}'), (2, '{"e":"Timeout"}'), (3, "{}")]) == [(2, "state_error_after_parallel")]
    assert sync(spark, node("a", 1, writes="no json"), node("b", None), node("c", None, reads=None)) == [(-1, "missing_join")]


def routes(spark, nodes, edges, states=(), status="running"):
    n, e = spark.createDataFrame(list(nodes), NODE), spark.createDataFrame([(1, *x) for x in edges], EDGE)
    s = spark.createDataFrame([(1, *x) for x in states], "graph_id long, superstep long, state string")
    return sorted((r.kind, r.source, r.target) for r in x.route_issues(n, e, s, spark.createDataFrame([(1, status)], "graph_id long, status string")).collect())


END = node("end", 9, kind="end")


def test_missing_dead_and_unreachable(spark):
    a, b = node("a", 1), node("b", 2)
    assert routes(spark, [a, b], [("a", "b", "direct", None)]) == [("dead_end", "b", None)]
    assert routes(spark, [a, b], [("a", "b", "direct", None)], status="completed") == []
    assert routes(spark, [a, b, END], [("a", "b", "direct", ""), ("b", "ghost", "direct", "")]) == [("missing_target", "b", "ghost"), ("unreachable", "end", None)]
    assert routes(spark, [a, node("b", 2, "failed"), END], [("a", "b", "direct", ""), ("b", "ghost", "direct", ""), ("b", "end", "direct", "")]) == []
    assert routes(spark, [a, b, END], [("a", "b", "conditional", ""), ("a", "ghost", "conditional", ""), ("b", "end", "direct", "")]) == []


@pytest.mark.parametrize(
    ("target", "condition", "want"),
    [
        (dict(kind="llm"), "finish", ["condition_mismatch"]), (dict(kind="router"), "finish", []), (dict(kind="router", title="stop here"), "continue", ["condition_mismatch"]), (dict(kind="llm"), "route_to_tool", ["condition_title_mismatch"]),
        (dict(kind="tool"), "route_to_tool", []), (dict(kind="router", title="NewsService"), "r == 'weather_service'", ["condition_value_target_mismatch"]), (dict(kind="router", title="WeatherTools"), "r == 'weather_service'", []),
        (dict(kind="router", title="NewsService"), "r == 'high'", []), (dict(kind="router", title="NewsService"), "r == 'tool_path'", []),
    ],
)
def test_conditions(spark, target, condition, want):
    found = routes(spark, [node("a", 1), node("b", 2, **target), END], [("a", "b", "conditional", condition), ("b", "end", "direct", "")])
    assert [k for k, _, _ in found] == want


def test_contradictions_and_skipped_ways(spark):
    edges = [("a", "b", "conditional", "r == 'yes'"), ("a", "c", "conditional", "r == 'no'"), ("b", "end", "direct", ""), ("c", "end", "direct", "")]
    made = lambda out, c="skipped": [node("a", 1, writes=out, kind="router"), node("b", 2, kind="router"), node("c", 2, c, kind="router"), END]
    assert routes(spark, made('{"r":"yes"}'), edges) == []
    assert routes(spark, made('{"r":"no"}'), edges) == [("output_condition_contradiction", "a", "b"), ("skipped_conditional", "a", "c")]
    assert routes(spark, made('{"r":"no"}', "succeeded"), edges) == [("output_condition_contradiction", "a", "b")][:0]
    assert routes(spark, made("{}"), edges) == [("skipped_conditional", "a", "c")]
    assert routes(spark, made("{}"), edges, [(1, '{"r":"yes"}')]) == []
    assert routes(spark, made("{}"), edges, [(2, '{"r":"no"}')]) == [("skipped_conditional", "a", "c"), ("state_condition_contradiction", "a", "b")]
    assert routes(spark, [node("z", 0, writes='{"r":"yes"}'), *made("{}")], [("z", "a", "direct", ""), *edges]) == []


def test_routes_are_read_from_few_passes(spark):
    """Nodes, edges, tests and states are written once; the issues read them without the windows of the adapter."""
    from spanforge.plans.catalog import QUERIES

    plan = QUERIES["m9_route_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and plan.count("Window [") <= 1 and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 3


def test_edges_without_source_and_states_without_members(spark):
    edges = [(None, "b", "conditional", "r == 'yes'"), ("a", "b", "conditional", "r == 'yes'"), ("a", "end", "direct", ""), ("b", "end", "direct", "")]
    nodes = [node("a", 1, kind="router"), node("b", 2, kind="router"), END]
    assert routes(spark, nodes, edges, [(2, '{"r":"no"}')]) == [("state_condition_contradiction", "a", "b")]
    assert routes(spark, nodes, edges, [(1, "[1]"), (2, '{"r":"no"}')]) == []
    assert routes(spark, nodes, edges, [(0, '{"r":"no"}'), (1, "{}")]) == [("state_condition_contradiction", None, "b")]


def test_findings(spark):
    n = spark.createDataFrame([node("a", 1), node("b", 1, "failed")], NODE)
    assert [tuple(r) for r in x.sync_findings(x.sync_issues(n), n).collect()] == [(1, 2, "failed_parallel,missing_join", "severe", 0.8)]
    e = spark.createDataFrame([], EDGE)
    empty = x.route_issues(n.limit(0), e, spark.createDataFrame([], "graph_id long, superstep long, state string"), spark.createDataFrame([], "graph_id long, status string"))
    assert empty.count() == 0
