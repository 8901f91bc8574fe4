"""Faults of states on small cases worked out by hand; whole tables are compared with SQL in test_queries."""

import json

import pytest

from spanforge.operators import states as x


def frame(spark, *states, trace=1, gap=60.0):
    rows = [(trace, i, i * gap, s if s is None or isinstance(s, str) else json.dumps(s)) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "trace_id long, step long, ts double, state string")


GRAPH = [
    ({"a": 1, "b": 2}, {"a": 1}, {("b", "field_deletion")}),
    ({"a": "x"}, {"a": None}, {("a", "null_injection")}),
    ({"a": 5}, {"a": 5.5}, {("a", "type_change")}),
    ({"a": [1]}, {"a": list(range(11))}, {("a", "value_explosion")}),
    ({"a": [1]}, {"a": list(range(10))}, set()),
    ({"a": [1, 2]}, {"a": [1]}, {("a", "list_shrinkage")}),
    ({"my_user_id": "u"}, {"my_user_id": "v"}, {("my_user_id", "identity_mutation")}),
    ({"step_count": 5}, {"step_count": 4}, {("step_count", "counter_decrease")}),
    ({"a": 2}, {"a": -201}, {("a", "value_jump")}),
    ({"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 1, "y": 1, "x": 1, "_z": 1}, {("x,y", "field_injection")}),
    ({"a": 1, "b": 1}, {"a": 1, "b": 1, "y": 1, "x": 1}, set()),
    ({"a": None}, {"a": 1}, set()),
    (None, {"a": 1}, set()),
    ({"a": 1}, "no json", {("a", "field_deletion")}),
    ({"a": 1}, [1, 2], {("a", "field_deletion")}),
]


@pytest.fixture(scope="module")
def graph_found(spark):
    df = None
    for i, (a, b, _) in enumerate(GRAPH):
        f = frame(spark, a, b, trace=i)
        df = f if df is None else df.union(f)
    return {(r.trace_id, r.key, r.kind) for r in x.graph_signals(df).collect()}


@pytest.mark.parametrize("i", range(len(GRAPH)))
def test_graph_faults(graph_found, i):
    assert {(k, kind) for t, k, kind in graph_found if t == i} == GRAPH[i][2]


def test_failed_nodes_and_findings(spark):
    s = frame(spark, {"a": 1}, {"a": 1})
    n = spark.createDataFrame([(1, 7, "failed", 3, "Checkpoint lost", None), (1, 8, "failed", 4, "timeout", "{}"), (1, 9, "succeeded", 5, "corrupt", None)], "trace_id long, node_id long, status string, superstep long, error string, outputs string")
    signals = x.graph_signals(s, n)
    assert [(r.step, r.key, r.kind) for r in signals.collect()] == [(3, "7", "node_error")]
    assert [tuple(r) for r in x.graph_corruption(signals, s.union(frame(spark, {}, trace=2))).orderBy("trace_id").collect()] == [(1, 1, "node_error", "severe", 0.7), (2, 0, "", "none", 0.85)]
    assert x.graph_signals(s.limit(0)).count() == 0


ISSUES = [
    ({"x": 5}, {"x": -5}, {("sign_flip", "x")}),
    ({"x": 1}, {"x": 6}, {("extreme_magnitude_change", "x")}),
    ({"x": 1}, {"x": 5}, set()),
    ({"revision": 3}, {"revision": 2}, {("monotonic_regression", "revision")}),
    ({"is_admin": True}, {"is_admin": False}, {("security_boolean_flip", "is_admin")}),
    ({"t": "abcdefg"}, {"t": ""}, {("string_cleared", "t")}),
    ({"t": "a" * 30}, {"t": "a" * 5}, {("string_truncated", "t")}),
    ({"t": "one two three four"}, {"t": "five six seven eight"}, {("content_replacement", "t")}),
    ({"order_status": "shipped", "n": 1}, {"order_status": "pending", "n": None}, {("status_regression", "order_status"), ("data_loss", "n"), ("regression_nullification", "n")}),
    ({"l": [1, 2]}, {"l": []}, {("data_loss", "l")}),
    ({"l": [{"id": 1}]}, {"l": [{"id": 1}, {"id": 1}]}, {("duplicate_items", "l")}),
    ({"d": {"a": 1, "b": 2, "c": 3}}, {"d": {"a": 1}}, {("data_loss", "d")}),
    ({"a": 1, "b": 2, "c": 3, "d": 4}, {"d": 4}, {("field_disappeared", "a,b,c")}),
    ({"s": 1}, {"score": 50, "grade": "a"}, {("cross_field_inconsistency", "score,grade")}),
    ({"name": "a", "username": "b", "email": "a@b.org"}, {"name": "c", "username": "d", "email": "a@b.org"}, {("identity_mutation", "name,username")}),
    ({"z": 1}, {"start_date": "2024-02", "end_date": "2024-01", "min_value": 2, "max_value": 1}, {("cross_field_inconsistency", "start_date,end_date"), ("cross_field_inconsistency", "min_value,max_value")}),
    ({"z": 1}, {"age": 151, "url": "ftp://x", "phone": "123", "uuid": "x", "percentage": 100}, {("domain_violation", k) for k in ("age", "url", "phone", "uuid")}),
    ({"z": 1}, {"order_id": "o-1"}, {("hallucinated_reference", "order_id")}),
    ({"z": 1}, {"p": "twelve letters", "q": "twelve letters"}, {("suspicious_value_copy", "p,q")}),
    ({"j": {"pay": {"sum": 10}}}, {"j": {"pay": {"sum": -10}}}, {("sign_flip", "j.pay.sum")}),
    ({"counter": 10, "x": 1}, {"counter": 100, "x": 1}, set()),
    ({"x": 1}, {"x": "1"}, {("type_drift", "x")}),
]


@pytest.fixture(scope="module")
def issues_found(spark):
    df = None
    for i, (a, b, _) in enumerate(ISSUES):
        f = frame(spark, a, b, trace=i)
        df = f if df is None else df.union(f)
    return {(r.trace_id, r.issue, r.field) for r in x.issues(df).collect()}


@pytest.mark.parametrize("i", range(len(ISSUES)))
def test_issues(issues_found, i):
    assert {(k, f) for t, k, f in issues_found if t == i} == ISSUES[i][2]


def test_fast_fields_fall_silent(spark):
    """Eleven judgements of a field within five seconds: the eleventh and later ones are left out."""
    df = frame(spark, *[{"x": 1 if i % 2 else 100} for i in range(16)], gap=0.25)
    assert sorted(r.step for r in x.issues(df).filter("issue = 'extreme_magnitude_change'").collect()) == list(range(1, 11))


def test_findings(spark):
    found = x.corruption(x.issues(frame(spark, {"x": 5}, {"x": -5})))
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1, 0, 0, 1, 70, round(0.8 * 0.4 + 0.4 * 0.3 + 0.25 * 0.15 + 0.05, 4))]


def test_closed_objects_have_one_level(spark):
    rows = x.fields(frame(spark, {"a": {"b": 1}, "c": 1}, {"a": {"b": 2}}), 0).select("path", "lvl", "kind").collect()
    assert sorted(tuple(r) for r in rows) == [("a", 0, "dict"), ("a", 0, "dict"), ("c", 0, "int")]


def test_a_leaf_stands_for_both_levels_in_one_row(spark):
    rows = x.fields(frame(spark, {"a": {"b": {"c": 1}}, "d": 1, "e.f": 2})).select("path", "lvl", "leaf").collect()
    assert sorted(tuple(r) for r in rows) == [("a", 0, False), ("a.b.c", 1, True), ("d", 0, True), ("e.f", 0, True), ("e.f", 1, True)]


def test_issues_of_both_levels_come_twice(spark):
    """A leaf beside an opened object has its issue on both levels, also where its name holds a dot; one that was an object before has not."""
    a, b = {"x": 5, "e.f": 5, "o": {"y": 5}, "z": {"q": 1}}, {"x": -5, "e.f": -5, "o": {"y": -5}, "z": -1}
    found = sorted((r.issue, r.field) for r in x.issues(frame(spark, a, b)).collect())
    assert found == sorted([("sign_flip", "x")] * 2 + [("sign_flip", "e.f")] * 2 + [("sign_flip", "o.y"), ("type_drift", "z"), ("type_drift", "z")])


def test_paths_meet_within_a_row(spark, monkeypatch):
    """No window or aggregate sorts or gathers paths, and a task has a bounded number of states."""
    s = frame(spark, *[{"x": i, "o": {"y": -i}} for i in range(9)])
    plan = x.issues(s)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and "RangeFrame" not in plan
    assert not any("path" in line for line in plan.splitlines() if "Window [" in line)
    monkeypatch.setattr(x, "ROWS", 1)
    assert x.compared(s).rdd.getNumPartitions() == 9


def test_names_with_dots_are_told_from_members(spark):
    """A name with a dot and a member of the same path are two paths, each held against its own."""
    a, b = {"a.b": 1, "a": {"b": 5, "c": {"d": 1}}, "a\u0000b": 2}, {"a.b": 1, "a": {"b": -5, "c": {"d": 1}}, "a\u0000b": 2}
    assert [(r.issue, r.field) for r in x.issues(frame(spark, a, b)).collect()] == [("sign_flip", "a.b")]


def test_judgements_without_a_time_are_at_one_time(spark):
    df = frame(spark, *[{"x": 1 if i % 2 else 100} for i in range(16)]).selectExpr("trace_id", "step", "cast(null as double) as ts", "state")
    assert sorted(r.step for r in x.issues(df).filter("issue = 'extreme_magnitude_change'").collect()) == list(range(1, 11))
