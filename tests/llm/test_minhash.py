import numpy as np

from spanforge.llm import minhash as m

from .fixtures import empty, frame

SMALL = "/root/testdata/sf0.01"


def brute(docs):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = {(a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in seen:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(least.get(root(i)) if s else d), d is not None and d == (least.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def result(df):
    return sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_awkward_rows(spark):
    df = frame(spark)
    assert result(m.minhash_components(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert m.minhash_components(empty(spark)).count() == 0


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert result(m.op1_minhash(spark, SMALL)) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_pairs_apart_from_the_first_of_their_bucket_are_found(spark, monkeypatch):
    """With one band of one row nearly every pair meets in a bucket led by a third text."""
    monkeypatch.setattr(m, "signatures", lambda sets, bands=1, rows=1: np.ones((len(sets), 1), np.uint64))
    texts = [(i, " ".join(f"t{i // 2}x{j}" for j in range(40)) + " tail" * (i % 2)) for i in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert result(m.minhash_components(df)) == brute(texts)


def test_signature_agreement_estimates_similarity():
    a = m.shingle_set(" ".join(f"a{i}" for i in range(1000)))
    b = m.shingle_set(" ".join(f"a{i}" for i in range(250, 1000)))
    got = (m.signatures([a], 400, 1) == m.signatures([b], 400, 1)).mean()
    assert abs(got - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.08


def test_one_of_each_group_stays(spark):
    df = frame(spark)
    out = m.keep_one(df)
    assert out.columns == df.columns
    kept = sorted((str(r.doc_id), r.kept) for r in m.minhash_components(df).filter("kept or doc_id is null and n_shingles = 0").collect())
    assert sorted(str(r.doc_id) for r in out.collect()) == [d for d, _ in kept]
