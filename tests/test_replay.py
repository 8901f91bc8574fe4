"""Matching blocks against the plain definition, diffs against rebuilt texts, and whole tables against a plain version."""

import difflib
import json
import random
import tracemalloc

import pytest

from spanforge.functions import sequences as q
from spanforge.operators import replay as x

D = "/root/testdata/sf0.01"


def brute(a, b):
    """Blocks by trying all pairs of places, without frequent elements."""

    def longest(a0, a1, b0, b1):
        best = (0, 0, 0)
        for i in range(a0, a1):
            for j in range(b0, b1):
                n = 0
                while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        return best

    def all_(a0, a1, b0, b1):
        i, j, n = longest(a0, a1, b0, b1)
        return [] if n == 0 else all_(a0, i, b0, j) + [(i, j, n)] + all_(i + n, a1, j + n, b1)

    return all_(0, len(a), 0, len(b))


def test_blocks_equal_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 25))) for _ in range(2))
        assert sum(n for _, _, n in q.blocks(a, b)) == sum(n for _, _, n in brute(a, b))
        if a != b:
            assert q.likeness(a, b) == 2.0 * sum(n for _, _, n in brute(a, b)) / (len(a) + len(b))


def test_ratio_of_long_texts_equals_the_usual_measure():
    rng = random.Random(8)
    for n in (150, 199, 200, 201, 900, 3000):
        words = [f"w{rng.randrange(300)}" for _ in range(n // 4)]
        other = [w if rng.random() < 0.8 else f"v{rng.randrange(9)}" for w in words]
        a, b = " ".join(words)[:n], " ".join(other)[: n + 7]
        assert q.likeness(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_memory_grows_with_the_lengths():
    rng = random.Random(9)
    a = "".join(chr(200 + rng.randrange(5000)) for _ in range(60_000))
    b = a[:30_000] + "!" + a[30_001:]
    tracemalloc.start()
    found = q.blocks(a, b)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found == [(0, 0, 30_000), (30_001, 30_001, 29_999)] and peak < 60_000 * 400


def test_segments_rebuild_the_replay():
    rng = random.Random(10)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30))) for _ in range(2))
        out, at = "", 0
        for _, original, replay, position, length in q.segments(a, b, q.blocks(a, b)):
            assert a[position : position + len(original)] == original and length == max(len(original), len(replay))
            out, at = out + a[at:position] + replay, position + len(original)
        assert out + a[at:] == b


def test_compare_texts(spark):
    rows = [(1, "same", "same"), (2, None, None), (3, "abc", None), (4, "a\nb\nc", "a\nx"), (5, "hello world", "hello brave world"), (6, "é" * 50, "é" * 49 + "e")]
    got = {r.k: r for r in x.compare_texts(spark.createDataFrame(rows, "k int, original string, replay string")).collect()}
    assert [(got[k].similarity, got[k].difference) for k in (1, 2, 3)] == [(1.0, "identical"), (1.0, "identical"), (0.0, "completely_different")]
    assert (got[4].changed_lines, got[5].inserted, got[5].deleted, got[5].changed_lines) == (2, 6, 0, 1)
    assert [(s.kind, s.original, s.replay, s.position) for s in got[5].segments] == [("insert", "", "brave ", 6)]
    assert got[6].similarity == pytest.approx(0.98) and got[6].difference == "minor"


def test_compare_objects(spark):
    a, b = {"t": "abc", "o": {"p": "x", "q": {"r": 1}}, "gone": "g", "n": 5}, {"t": "abc", "o": {"p": "y", "q": {"r": 1}}, "n": [5], "new": {"z": 1}}
    df = spark.createDataFrame([(1, json.dumps(a), json.dumps(b)), (2, "no json", None)], "k int, original string, replay string")
    got = {r.path: r.difference for r in x.compare_objects(df, "k").collect()}
    assert got == {"t": "identical", "o.p": "completely_different", "o.q.r": "identical", "gone": "completely_different", "n": "major", "new": "completely_different"}


def test_whole_tables_equal_a_plain_version(spark):
    by, last = {}, {}
    for r in spark.read.parquet(f"{D}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault((r.conv_id, r.role), []).append(r)
        last[r.conv_id, r.turn] = r.text
    want = {}
    for (conv, _), rs in by.items():
        for p, r in zip(rs, rs[1:], strict=False):
            if p.text is not None:
                want[conv, r.turn] = round(difflib.SequenceMatcher(None, p.text, r.text or "").ratio(), 6)
    got = {(r.conv_id, r.turn): r for r in x.r5(spark, D).collect()}
    assert {k: r.similarity for k, r in got.items()} == want
    assert {(r.conv_id, r.turn) for r in x.h25(spark, D).collect()} == {k for k, s in want.items() if s > 0.9 and last[k] is not None}


def test_pairs_that_need_no_blocks_stay_out_of_python():
    """Equal texts, and a text against none, are answered before: only the third pair reaches Python, and parts of a batch keep its order."""
    import pyarrow as pa

    a, b = [None, None, "abcd"] * 300, [None, None, "abxd"] * 300
    parts = [r for part in q._compared(iter([(pa.array(a), pa.array(b))])) for r in part.to_pylist()]
    assert len(parts) == 900 and parts[0]["likeness"] is None and parts[899]["likeness"] == 0.75
    assert [(s["kind"], s["position"]) for s in parts[899]["segments"]] == [("replace", 2)]


def test_segments_of_easy_pairs(spark):
    rows = spark.createDataFrame([("", "xy"), ("xy", ""), ("xy", "xy"), (None, None), (None, "z")], "original string, replay string")
    got = [(r.similarity, r.difference, [tuple(s) for s in r.segments], r.inserted, r.deleted) for r in x.compare_texts(rows).collect()]
    assert got == [
        (0.0, "completely_different", [("insert", "", "xy", 0, 2)], 2, 0), (0.0, "completely_different", [("delete", "xy", "", 0, 2)], 0, 2), (1.0, "identical", [], 0, 0), (1.0, "identical", [], 0, 0),
        (0.0, "completely_different", [("insert", "", "z", 0, 1)], 1, 0),
    ]


def test_objects_become_rows_once(spark):
    """Eight levels are opened within a row: members are exploded once, not at each level; deeper objects are compared whole."""
    deep = lambda v, n: {"k": deep(v, n - 1)} if n else v
    df = spark.createDataFrame([(1, json.dumps(deep(1, 7) | {"e": {}}), json.dumps(deep(2, 7) | {"e": {}})), (2, json.dumps(deep(1, 10)), json.dumps(deep(2, 10))), (3, "{}", "no json"), (4, "[1]", '{"a":1}')], "k int, original string, replay string")
    c = x.compare_objects(df, "k")
    assert c._jdf.queryExecution().executedPlan().toString().count("Generate explode") == 1
    got = sorted((r.k, r.path, r.original, r.replay) for r in c.collect())
    assert got == [(1, ".".join("k" * 7), "1", "2"), (2, ".".join("k" * 8), '{"k":{"k":1}}', '{"k":{"k":2}}'), (4, "a", "", "1")]


def test_counted_segments_equal_segments(spark):
    rng = random.Random(11)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60))), "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))) for _ in range(200)]
    df = spark.createDataFrame([*pairs, *pairs, (None, "a"), ("a", None), (None, None)], "original string, replay string")
    whole, counts = x.compare_texts(df).collect(), x.compare_texts(df, counts=True).collect()
    assert [(r.similarity, r.difference, len(r.segments)) for r in whole] == [(r.similarity, r.difference, r.n_segments) for r in counts]
