"""Contradictions of parallel branches, against pairs made by hand."""

import random

from spanforge.operators import parallel as x


def spans(spark, rows):
    return spark.createDataFrame(rows, "trace_id long, span_id long, parent_id long, name string, start_time long, end_time long, output string")


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, rng.choice((None, 1, 2, 3)), "s", a := rng.randrange(60), rng.choice((None, a, a + rng.randrange(8))), "") for i in range(150)]
    want = set()
    for r in rows:
        for q in rows:
            if r[2] is not None and r[0] == q[0] and r[2] == q[2] and (r[4], r[1]) < (q[4], q[1]) and q[4] < (r[4] if r[5] is None else r[5]):
                want |= {r[1], q[1]}
    assert {r.span_id for r in x.overlapping(spans(spark, rows)).collect()} == want and want


def test_counts_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(1, 7, i // 3, rng.choice(("number", "truth")), rng.choice("ab"), rng.choice("xyz")) for i in range(90)]
    df = spark.createDataFrame(rows, "trace_id long, parent_id long, span_id long, kind string, entity string, fact string")
    want = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[2] != b[2] and a[3:5] == b[3:5] and a[5] != b[5]:
                want[a[3:5]] = want.get(a[3:5], 0) + 1
    assert {(r.kind, r.entity): r.n for r in x.contradictions(df).collect()} == want


def finding(spark, *rows):
    return [tuple(r) for r in x.parallel_consistency(spans(spark, [(1, *r) for r in rows])).collect()]


def test_severities(spark):
    a, b = (1, 0, "s", 0, 10, "The total is 10"), (2, 0, "s", 5, 15, "the total was 12")
    end = (3, None, "merge", 20, 21, "all done")
    assert finding(spark, a, b, end) == [(1, 1, 1, 30)]
    assert finding(spark, a, (2, 0, "s", 10, 15, "the total was 12"), end) == []
    assert finding(spark, a, b, (3, None, "merge", 20, 21, "However, they differ")) == []
    assert finding(spark, a, b, (3, None, "reconcile", 15, 21, None)) == []
    assert finding(spark, a, b, *[(3 + i, None, "m", 20 + i, None, "fine") for i in range(10)], (20, None, "m", 40, 41, "however")) == [(1, 1, 1, 30)]
    assert finding(spark, a, b) == []
    c, d = (1, 0, "s", 0, 10, "the order was approved"), (2, 0, "s", 5, 15, "the order was not approved")
    assert finding(spark, c, d, (4, 0, "s", 6, 9, "the order was rejected"), end) == [(1, 1, 3, 75)]
