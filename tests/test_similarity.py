"""Clusters against plain versions; whole tables are compared with SQL in test_queries."""

import math
import random

import numpy as np
import pytest

from spanforge.operators import similarity as x


def cosine(a, b):
    n = math.sqrt(sum(v * v for v in a)) * math.sqrt(sum(v * v for v in b))
    return sum(p * q for p, q in zip(a, b, strict=True)) / n if n else 0.0


def leaders(vectors, alike):
    found, of = [], []
    for i, v in enumerate(vectors):
        hit = next((j for j in found if cosine(vectors[j], v) >= alike), None)
        if hit is None:
            found.append(i)
        of.append(i if hit is None else hit)
    return of


@pytest.mark.parametrize("block", [512, 7, 1])
def test_leaders_in_order(spark, block):
    rng = random.Random(block)
    rows = []
    for q, n in (("a", 60), ("b", 1), ("c", 25), ("d", 200)):
        rows += [(q, i, [rng.choice((0.0, 1.0, 2.0)) for _ in range(3)]) for i in range(n)]
    df = spark.createDataFrame([*rows, ("e", 1, None)], "question string, pos long, vector array<double>")
    got = {(r.question, r.pos): r.leader for r in x.answer_clusters(df, 0.9, block).collect()}
    for q in "abcd":
        vectors = [v for k, _, v in rows if k == q]
        assert [got[q, i] for i in range(len(vectors))] == leaders(vectors, 0.9)
    assert ("e", 1) not in got
    assert x.answer_clusters(df.limit(0)).count() == 0


def test_leaders_past_several_tasks(spark):
    rng = random.Random(5)
    rows = [(1, i, [rng.choice((0.0, 1.0, 2.0)) for _ in range(4)]) for i in range(150)] + [(1, 150, [1.0, 2.0]), (1, 151, [1.0, 2.0]), (2, 0, [0.0] * 4)]
    df = spark.createDataFrame(rows, "question long, pos long, vector array<double>")
    got = {(r.question, r.pos): r.leader for r in x.answer_clusters(df, 0.97, block=16, stream=9).collect()}
    assert [got[1, i] for i in range(150)] == leaders([v for q, _, v in rows if q == 1 and len(v) == 4], 0.97)
    assert (got[1, 150], got[1, 151], got[2, 0]) == (150, 150, 0) and len(got) == len(rows)


def test_entropy(spark):
    rows = [("q", 0, [1.0, 0.0]), ("q", 1, [1.0, 0.01]), ("q", 2, [0.0, 1.0]), ("q", 3, [0.01, 1.0]), ("one", 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "question string, pos long, vector array<double>")
    got = {r.question: r for r in x.semantic_entropy(df).collect()}
    assert (got["q"].clusters, got["q"].entropy, got["q"].consistency, got["q"].reliable, got["q"].risk) == (2, 1.0, 0.5, False, 0.5)
    assert (got["one"].entropy, got["one"].consistency, got["one"].reliable) == (0.0, 1.0, True)
    far = spark.createDataFrame([("q", [-1.0, -1.0]), ("one", [1.0, 1.0])], "question string, vector array<double>")
    assert {r.question: r.risk for r in x.semantic_entropy(df, far).collect()} == {"q": 0.75, "one": 0.0}


def kmeans(q, rounds):
    n = len(q)
    k = min(max(2, n // 4), 5)
    centres = [q[i * n // k] for i in range(k)]
    near = lambda v: min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))[1]
    for _ in range(rounds):
        labels = [near(v) for v in q]
        for j in range(k):
            held = [v for v, label in zip(q, labels, strict=True) if label == j]
            if held:
                centres[j] = [sum(int(v[i]) for v in held) // len(held) for i in range(len(q[0]))]
    return [near(v) for v in q]


def test_clusters_equal_plain_kmeans(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for t, n in enumerate((5, 6, 9, 30, 64)):
        vectors = (rng.normal(size=(n, 6)) + 4 * rng.integers(0, 3, (n, 1))).tolist()
        rows += [(t, i, "a", "{}", "", v) for i, v in enumerate(vectors)]
        if n >= 6:
            want[t] = kmeans([[int(np.floor(c * x.UNIT + 0.5)) if c >= 0 else -int(np.floor(-c * x.UNIT + 0.5)) for c in v] for v in vectors], x.ROUNDS)
    df = spark.createDataFrame([*rows, (9, 1, "a", "{}", "", None)], "trace_id long, step long, agent string, state string, content string, vector array<double>")
    got = {}
    for r in x.clustered(df).orderBy("trace_id", "pos").collect():
        got.setdefault(r.trace_id, []).append(r.label)
    assert got == want


@pytest.mark.parametrize("longest", [x.LONGEST, 100, 0])
def test_clusters_of_long_and_short_traces(spark, longest):
    """Traces are clustered in tasks without a join, or by rounds, with the same labels, over batches that cut traces."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for t, n in enumerate((6, 7, 3, 40, 8, 21)):
        vectors = np.where(rng.random((n, 4)) < 0.5, rng.integers(-2, 3, (n, 4)) * 0.5, 4e4 * (t == 3 and longest == x.LONGEST)).tolist()  # in tasks, sums beyond a long are exact too
        rows += [(f"t{t}", i, v) for i, v in enumerate(vectors)]
        if n >= 6:
            want[f"t{t}"] = kmeans([[int(c * x.UNIT) for c in v] for v in vectors], x.ROUNDS)
    df = spark.createDataFrame([*rows, (None, 1, [0.0] * 4)], "trace_id string, step long, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        c = x.clustered(df, keep=2, longest=longest)
        assert longest < x.LONGEST or "Join" not in c._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in c.orderBy("trace_id", "pos").collect():
            got.setdefault(r.trace_id, []).append(r)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {t: [r.label for r in rs] for t, rs in got.items()} == want
    for t, rs in got.items():
        assert [r.late for r in rs] == [[b.label for b in rs[i:]].count(r.label) for i, r in enumerate(rs)]
        assert [r.q for r in rs] == [[int(c * x.UNIT) for c in v] if r.late <= 2 else None for r, v in zip(rs, [v for k, _, v in rows if k == t], strict=True)]


def steps(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "trace_id long, step long, agent string, state string, content string, vector array<double>")


def test_loop_methods(spark):
    one = lambda *rows, **k: [(r.method, r.loop_start, r.loop_length) for r in x.loops(steps(spark, *rows), **k).collect()]
    a, b = [1.0, 0.0], [0.0, 1.0]
    assert one(("p", '{"a":1}', "", a), ("q", '{"b":1}', "", b), ("p", '{"a":2}', "", b)) == [("structural", 0, 2)]
    assert one(("p", '{"a":1,"b":1}', "", a), ("q", '{"b":1}', "", b), ("p", '{"a":2,"b":2}', "", b)) == []
    assert one(("p", '{"a":1}', "", a), ("q", '{"b":1}', "", b), ("r", '{"a":1}', "", b)) == [("hash", 0, 2)]
    like = [("p", '{"a":1}', "x", a), ("q", '{"a":2}', "y", a), ("r", '{"a":3}', "z", a)]
    assert one(*like, ("s", '{"a":4}', "more", a)) == [("semantic", 0, 3)]
    assert one(*like, ("s", '{"a":4}', "To summarize: more", a)) == []
    assert one(("p", "{}", "", a), ("p", "{}", "", a)) == []


def test_cluster_patterns(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    found = x.cluster_loops(steps(spark, *[("p", "{}", "", v) for v in (b, a, b, a, a, a, a, a)])).collect()
    assert [(r.kind, r.held, r.similarity) for r in found] == [("cluster_dominance_cycle", 6, 1.0)]
    found = x.cluster_loops(steps(spark, *[("p", "{}", "", v) for v in (a, b) * 4])).collect()
    assert [(r.kind, r.cycle) for r in found] == [("cluster_cycle", 2)]
