import numpy as np

from spanforge.llm import ann, embdedup
from spanforge.llm.hnsw import Graph

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, fp string, shard int, list int, VEC_ID long, Embedding string, LABEL string, c0 int"


def brute_components(rows, least=0.93):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    by = {}
    for i, (_, v, label) in enumerate(rows):
        if ok(v) and label is not None:
            by.setdefault((label, len(v)), []).append(i)
    for ids in by.values():
        x = np.array([rows[i][1] for i in ids], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= least):
            if a != b:
                links[ids[a]] += 1
                root[find(ids[a])] = find(ids[b])
    name = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            name[find(i)] = min(r[0], name.get(find(i), r[0]))
    return sorted((str(r[0]), links[i], str(name.get(find(i))), r[0] is not None and r[0] == name.get(find(i))) for i, r in enumerate(rows))


def awkward():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * 0.15).astype("float32").tolist(), i % 2) for i in range(80)]
    rows += [(200 + i, rows[3][1], 1) for i in range(30)] + [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [1.0] + [float("nan")] * 7, 1), (304, [None] + [1.0] * 7, 0), (305, rows[3][1], None), (None, rows[3][1], 1), (200, rows[3][1], 1), (306, [1.0, 2.0], 1), (307, [1.0, 2.125], 1), (308, [float("inf")] * 8, 0), (309, [-0.0] * 8, 0)]
    return rows + [(310, [2.0, 1.0], 0), (315, [1.0, 1.0], 0)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, -1, "y", "z", 3) for r in rows], SCHEMA)


def components(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def test_near_dedup_awkward_rows(spark):
    rows = awkward()
    df = frame(spark, rows)
    assert components(embdedup.embedding_components(df)) == brute_components(rows)
    assert components(embdedup.embedding_components(df, shard=16)) == brute_components(rows)
    assert embdedup.embedding_components(frame(spark, [])).count() == 0


def test_near_dedup_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert components(embdedup.op3_embedding_dedup(spark, SMALL)) == brute_components(rows)
    searched = spark.sparkContext.accumulator(0)
    embeddings = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert components(embdedup.embedding_components(embeddings, searched=searched)) == brute_components(rows)
    classes = embeddings.filter("label is not null").select("label", "embedding").distinct().count()
    print("queries that beams answered", searched.value, "of", classes)
    assert searched.value >= 0.9 * classes


def test_beams_widen_until_the_audit_passes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[:300] = x[0] + rng.normal(size=(300, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, _ = embdedup.linked(Graph(x), x, x[:400], 0.93, beam=8)
    truth = [np.flatnonzero(s >= 0.93) for s in x[:400] @ x.T]
    assert sum(len(np.intersect1d(a, b)) for a, b in zip(found, truth, strict=True)) >= 0.99 * sum(map(len, truth))


def pairs_among(n, dim, pairs, seed):
    """Unit vectors of which the last ``pairs`` are near copies of the first."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n - pairs :] = x[:pairs] + rng.normal(size=(pairs, dim)) * 0.05
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def without_copies(x, first):
    """A graph in which no beam reaches the nodes from ``first`` on."""
    g = Graph(x)
    for level in g.levels:
        level[level >= first] = -1
    return g


def test_an_audit_without_links_is_no_proof():
    x = pairs_among(3000, 16, 5, 8)
    own = np.concatenate([[5], np.arange(5), np.arange(6, 1000)])
    found, _ = embdedup.linked(without_copies(x, 2995), x, x[own], 0.93, own=own)
    assert all((2995 + i) in found[1 + i] for i in range(5))


def test_queries_own_nodes_hide_no_lost_link():
    x = pairs_among(3000, 16, 64, 9)
    found, _ = embdedup.linked(without_copies(x, 2999), x, x[:64], 0.93, own=np.arange(64))
    assert all((2936 + i) in found[i] for i in range(64))


def test_near_dedup_of_thousands_in_a_label(spark):
    x = pairs_among(5000, 16, 60, 10).astype("float32")
    rows = [(i, v.tolist(), i // 4500) for i, v in enumerate(x)]
    assert components(embdedup.embedding_components(frame(spark, rows), shard=2500)) == brute_components(rows)


def test_graph_recall():
    x = np.random.default_rng(6).normal(size=(2000, 16)).astype("float32")
    g = Graph(x, 0.5 * (x**2).sum(1))
    ids, _ = g.search(x[:200], 64)
    true = np.argsort((x**2).sum(1)[None] - 2 * x[:200] @ x.T, axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) > 0.95
    assert Graph(x[:0]).search(x[:2], 4)[0].tolist() == [[-1] * 4] * 2
    assert Graph(x[:1]).search(x[:1], 4)[0].tolist() == [[0, -1, -1, -1]]


def brute_nearest(rows, is_query, top=20):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, float))
    out = {}
    for i, vs in ok.items():
        if is_query(i):
            near = sorted({(-round(float(ann.dots(vs[0][None], w[None])[0]), 12), j) for j, ws in ok.items() for w in ws if j != i and len(w) == len(vs[0])})
            out[i] = near[:top]
    return out


def test_nearest_awkward_rows(spark):
    from pyspark.sql import functions as F

    rows = awkward()
    got = {}
    for r in ann.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 5 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, -round(r.score, 12), r.vec_id))
    want = brute_nearest(rows, lambda i: i % 5 == 0)
    assert got.keys() == want.keys()
    for i, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, len(near) + 1))
        assert [n[1:] for n in near] == want[i]
    assert ann.nearest_neighbours(frame(spark, []), F.lit(True)).count() == 0


def test_nearest_few_rows_give_all(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i + 1), 1.0], 0) for i in range(4)]
    assert ann.nearest_neighbours(frame(spark, rows), F.lit(True)).count() == 12


def test_nearest_recall_on_the_whole_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in e], float), np.array([r.vec_id for r in e])
    got = {}
    for r in ann.op8_nearest(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hit.append(len(set(ids[np.argsort(-s)[:20]].tolist()) & got[ids[q]]) / 20)
    print("recall", np.mean(hit))
    assert np.mean(hit) >= 0.95


def test_nearest_recall_with_hundreds_of_lists(spark):
    """Far more lists than a query reads at first."""
    import pandas as pd
    from pyspark.sql import functions as F

    base = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], float)
    rng = np.random.default_rng(12)
    x = np.repeat(base, 25, 0)
    x = (x + rng.normal(size=x.shape) * 0.5 * x.std()).astype("float32")
    assert len(x) >= 50_000 and len(x) // ann.LIST > 10 * ann.PROBES
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.astype(float).tolist()}), "vec_id long, embedding array<double>")
    got = {}
    rows = ann.nearest_neighbours(df, F.col("vec_id") % 200 == 0).collect()
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x, hit = x.astype(float), []
    for q in range(0, len(x), 200):
        s = x @ x[q]
        s[q] = -np.inf
        hit.append(len(set(np.argsort(-s)[:20].tolist()) & got[q]) / 20)
    print("recall", np.mean(hit), "least", min(hit), "audited", rows[0].audit_recall)
    assert np.mean(hit) >= 0.9 and rows[0].audit_recall >= 0.93


def test_probes_widen_until_the_audit_passes(spark):
    from pyspark.sql import functions as F

    x = np.random.default_rng(13).normal(size=(3000, 16))  # no clusters: few lists hold few of the neighbours
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0, probes=1).collect()
    assert rows[0].audit_recall >= 0.93


def test_queries_of_a_bin_come_to_several_tasks(spark, monkeypatch):
    want = sorted(map(tuple, ann.op8_nearest(spark, SMALL).collect()))
    monkeypatch.setattr(ann, "ASKS", 3)
    assert sorted(map(tuple, ann.op8_nearest(spark, SMALL).collect())) == want
