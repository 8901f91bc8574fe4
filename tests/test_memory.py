"""The memory store against plain versions; recall and contrast over whole tables are compared with SQL in test_queries."""

import json
import math
import random

import pytest

from spanforge.operators import memory as x
from spanforge.operators.graph import cut

SCHEMA = "tenant long, memory_id long, domain string, memory_type string, framework string, content string, facts string, vector array<double>, importance double, access_count long, created_at double, is_active boolean, supersedes long, superseded_by long, last_accessed double"
D = "/root/testdata/sf0.01"


def memory(i, vector, facts=None, domain="loop", content=None, importance=0.5, access=0, created=0.0, active=True, tenant=1, kind="p", framework=None):
    return (tenant, i, domain, kind, framework, f"m{i}" if content is None else content, None if facts is None else json.dumps(facts), vector, importance, access, created, active, None, None, None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def cos(a, b):
    n = math.sqrt(sum(v * v for v in a)) * math.sqrt(sum(v * v for v in b))
    return round(sum(p * q for p, q in zip(a, b, strict=True)) / (n or 1.0), 12)


@pytest.mark.parametrize(("top", "over", "block", "stream"), [(None, 0.5, 2048, 200_000), (3, -2.0, 3, 7), (None, 0.2, 1, 4)])
def test_neighbours_equal_brute_force(spark, top, over, block, stream):
    rng = random.Random(block)
    vector = lambda: [float(rng.randrange(-3, 4)) for _ in range(3)]
    store = [memory(i, vector() if i % 9 else None, tenant=i % 2, domain=rng.choice("ab"), kind=rng.choice("pq")) for i in range(80)] + [memory(99, [1.0], tenant=0)]
    asks = [(i % 2, i, rng.choice((None, "a", "b")), rng.choice((None, "p")), None, vector()) for i in range(12)] + [(7, 50, None, None, None, [1.0, 2.0, 3.0])]
    want = set()
    for t, i, domain, kind, _, v in asks:
        hits = [(-cos(v, m[7]), m[1]) for m in store if m[0] == t and m[7] is not None and len(m[7]) == len(v) and cos(v, m[7]) > over and domain in (None, m[2]) and kind in (None, m[3])]
        want |= {(str(t), i, m, -s) for s, m in sorted(hits)[:top]}
    asked = spark.createDataFrame(asks, "tenant long, ask_id long, domain string, memory_type string, framework string, vector array<double>")
    got = {(r.tenant, r.ask_id, r.memory_id, r.similarity) for r in x.neighbours(asked, frame(spark, *store), top, over, block, stream).collect()}
    assert got == want and want


@pytest.mark.parametrize("top", [3, None])
def test_neighbours_stream_in_batches(spark, top):
    import numpy as np

    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=(300, 5)), np.repeat(rng.normal(size=(3, 5)), 60, axis=0)]).round(2)
    after = [None if i % 3 else i for i in range(len(v))]
    store = spark.createDataFrame([(1, i, "ab"[i % 2], "p", None, a, x_) for i, (a, x_) in enumerate(zip(after, v.tolist(), strict=True))], "tenant long, memory_id long, domain string, memory_type string, framework string, after long, vector array<double>")
    asks = [(1, i, None if i % 4 else "a", None, None, v[i].tolist()) for i in range(0, len(v), 5)]
    want = set()
    for _, i, domain, _, _, y in asks:
        hits = sorted((-c, j) for j in range(len(v)) if (after[j] is None or i > j) and domain in (None, "ab"[j % 2]) and (c := cos(y, v[j].tolist())) > 0.3)
        want |= {(i, j) for _, j in hits[:top]}
    asked_ = spark.createDataFrame(asks, "tenant long, ask_id long, domain string, memory_type string, framework string, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.ask_id, r.memory_id) for r in x.neighbours(asked_, store, top, 0.3, block=50, stream=150).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def asked(spark, vector, tenant=1):
    return spark.createDataFrame([(tenant, 1, None, None, None, vector)], "tenant long, ask_id long, domain string, memory_type string, framework string, vector array<double>")


def test_recall_widens_and_writes_back(spark):
    a = [1.0, 0.0]
    store = frame(spark, *[memory(i, [1.0, 0.001 * i], importance=0.0) for i in range(60)], memory(70, [1.0, 1.0], importance=1.0), memory(71, a, importance=1.0, active=False))
    day = 86400.0
    found = x.recall(asked(spark, a), store, now=900 * day, k=2).collect()
    # The fifty most alike score some 0.4, so that the next ones are looked at.
    assert [r.memory_id for r in found] == [70, 0] and found[0].level == "medium"
    assert found[1].score == pytest.approx(0.4 + math.exp(-10) * 0.2, abs=1e-6)
    used = x.accessed(store, x.recall(asked(spark, a), store, now=900 * day, k=2), 5.0)
    assert {r.memory_id: (r.access_count, r.last_accessed) for r in used.filter("access_count > 0").collect()} == {70: (1, 5.0), 0: (1, 5.0)}
    # While they are new, the fifty most alike score over one half, and no more are looked at.
    assert [r.memory_id for r in x.recall(asked(spark, a), store, now=0.0, k=1).collect()] == [0]
    assert x.recall(asked(spark, a), store.limit(0), now=0.0).count() == 0


def state(df):
    return {r.memory_id: (r.is_active, r.supersedes, r.superseded_by) for r in df.collect()}


def test_remember(spark):
    store = frame(spark, memory(1, [1.0, 0.0], {"t": 1, "details": "x"}), memory(2, [0.0, 1.0], {"t": 1}, domain="cost"), memory(3, [-1.0, 0.0], active=False, content="old"))
    batch = frame(
        spark, memory(10, [0.0, 0.0, 1.0], content="m1"), memory(11, [1.0, 0.1]), memory(12, [1.0, 0.5], {"t": 2}), memory(13, [1.0, 0.5], {"t": 9}), memory(14, [0.5, 1.0], {"t": 5}),
        memory(15, [1.0, 0.55], {"t": 1, "details": "y"}, content="m12"), memory(16, [-1.0, 0.0], content="old"), memory(17, None, content="only text"), memory(18, [1.0, 0.0], tenant=2), memory(19, None, content="only text"),
    )
    got = cut(x.remember(store, batch))
    # 10 and 19 repeat contents, 11 is near 1, 13 near 12; 12 contradicts 1; 14 is of another domain than 2; 15 repeats a content of the batch.
    assert state(got) == {1: (False, None, 12), 2: (True, None, None), 3: (False, None, None), 12: (True, 1, None), 14: (True, None, None), 16: (True, None, None), 17: (True, None, None), 18: (True, None, None)}
    again = cut(x.remember(got, batch))
    # Those that had only the superseded memory against them come in now.
    assert set(state(again)) - set(state(got)) == {10, 11}
    assert state(x.remember(again, batch)) == state(again)


def test_new_memories_contradict_earlier_ones(spark):
    got = x.remember(frame(spark, memory(0, [0.0, 0.0, 1.0])), frame(spark, memory(1, [1.0, 0.0, 0.0], {"t": 1}), memory(2, [1.0, 0.5, 0.0], {"t": 2}), memory(3, [1.0, 0.55, 0.6], {"t": None})))
    assert state(got) == {0: (True, None, None), 1: (False, None, 2), 2: (True, 1, None), 3: (True, None, None)}


def plain(store, batch):
    """The same insertion one after another, with the store as it stood before."""
    active = [m for m in store if m.is_active]
    kept, hashes = [], {(m.tenant, m.content) for m in active}
    for m in batch:
        if (m.tenant, m.content) in hashes:
            continue
        hashes.add((m.tenant, m.content))
        if any(m.tenant == o.tenant and cos(m.vector, o.vector) > 0.95 for o in active):
            continue
        kept.append(m)
    fresh = []
    for m in kept:
        if not any(m.tenant == o.tenant and cos(m.vector, o.vector) > 0.95 for o in fresh):
            fresh.append(m)
    over, by = {}, {}
    for k, m in enumerate(fresh):
        near = sorted((-cos(m.vector, o.vector), o.memory_id, o) for o in active + fresh[:k] if m.facts and o.tenant == m.tenant and o.domain == m.domain and cos(m.vector, o.vector) > 0.8)[:5]
        for _, i, o in near:
            a, b = json.loads(o.facts or "{}"), json.loads(m.facts)
            if any(key != "details" and a[key] != b[key] for key in set(a) & set(b)):
                over[m.memory_id] = i
                by.setdefault(i, m.memory_id)
                break
    return {m.memory_id: (m.is_active and m.memory_id not in by, over.get(m.memory_id), by.get(m.memory_id)) for m in store} | {m.memory_id: (m.memory_id not in by, over.get(m.memory_id), by.get(m.memory_id)) for m in fresh}


def test_whole_table_equals_one_after_another(spark):
    store, batch = x.split(x.memories(spark, D))
    want = plain(store.orderBy("memory_id").collect(), batch.orderBy("memory_id").collect())
    got = x.q14(spark, D)
    assert {r.memory_id: (r.is_active, r.supersedes, r.superseded_by) for r in got.collect()} == want


def test_contrast(spark):
    rows = [(1, 1, True, [1.0, 0.0]), (1, 2, False, [0.8, 0.6]), (1, 3, False, [0.0, 1.0]), (2, 4, True, [1.0, 0.0]), (1, 5, True, [0.5, 0.5])]
    e = spark.createDataFrame(rows, "mode long, example_id long, is_failure boolean, vector array<double>")
    q = spark.createDataFrame([(1, 9, [1.0, 0.0])], "mode long, ask_id long, vector array<double>")
    got = sorted((r.role, r.rank, r.example_id) for r in x.contrastive(q, e).collect())
    assert got == [("hard_negative", 1, 2), ("negative", 1, 2), ("negative", 2, 3), ("positive", 1, 1), ("positive", 2, 5)]


def test_more_hard_examples_than_negatives(spark):
    e = spark.createDataFrame([(1, i, False, [1.0, 0.1 * i]) for i in range(6)], "mode long, example_id long, is_failure boolean, vector array<double>")
    q = spark.createDataFrame([(1, 9, [1.0, 0.0])], "mode long, ask_id long, vector array<double>")
    got = sorted((r.role, r.rank, r.example_id) for r in x.contrastive(q, e, negatives=1, hard=3).collect())
    assert got == [("hard_negative", 1, 0), ("hard_negative", 2, 1), ("hard_negative", 3, 2), ("negative", 1, 0)]
