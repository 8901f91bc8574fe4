import re

from spanforge.llm import mixing as x

from .fixtures import empty, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if share[s] > 2.0 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def check(docs, rows, slack):
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    goal, taken = brute_targets(sizes), {}
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in docs)
    by_size = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by_size.setdefault((r.source_size, round(r.target, 6)), 0)
        by_size[r.source_size, round(r.target, 6)] += r.taken
    for s, n in sizes.items():
        assert (n, round(goal[s], 6)) in by_size, (s, n, goal[s])
        taken[s] = by_size[n, round(goal[s], 6)]
        assert abs(taken[s] - goal[s]) <= slack(s), (s, taken[s], goal[s])


def test_awkward_rows(spark):
    df = frame(spark)
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    largest = {s: max(len(WORD.findall(t or "")) for _, t, q in docs if q == s) for s in {d[2] for d in docs}}
    check(docs, x.mix_sizes(df).collect(), lambda s: largest[s])
    assert x.mix_sizes(empty(spark)).count() == 0
    assert x.mix(empty(spark)).count() == 0
    assert x.mix(df).columns == df.columns


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.size, r.target, r.taken) for r in x.mix_sizes(df).collect()) == [(0, 0.0, 0), (0, 0.0, 0)]


def test_whole_table_and_reruns(spark):
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/documents.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    rows = x.op9_mixing(spark, d).collect()
    largest = {s: max(len(WORD.findall(t or "")) for _, t, q in docs if q == s) for s in {d[2] for d in docs}}
    check(docs, rows, lambda s: largest[s])
    assert sorted(rows) == sorted(x.op9_mixing(spark, d).collect())
    times = {}
    for r in x.mix(df).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times.get(r.doc_id, 0) * r.size == r.taken for r in rows)
