import hashlib
from collections import Counter

import numpy as np

from spanforge.llm import linededup as d

from .fixtures import empty, frame, rows

SMALL = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs, least=10):
    keyed = [[(lower(x.strip(WHITE)), x) for x in (t or "").split("\n")] for _, t in docs]
    n = Counter(k for doc in keyed for k in {k for k, _ in doc if k})
    out = []
    for (i, _), doc in zip(docs, keyed, strict=True):
        keep = [x for k, x in doc if n[k] < least]
        out.append((str(i), len(doc), len(doc) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.line_dedup_lines, r.line_dedup_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect())


def test_awkward_rows(spark):
    df = frame(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    out = d.dedup_lines(df)
    assert result(out) == brute(docs)
    assert out.columns[: len(df.columns)] == df.columns
    assert d.dedup_lines(empty(spark)).count() == 0


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in d.op2_line_dedup(spark, SMALL).collect())
    assert got == brute(docs)


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    df = frame(spark)
    expected = result(d.dedup_lines(df))
    monkeypatch.setattr(d, "BROADCAST_BYTES", -1)
    assert result(d.dedup_lines(df)) == expected


def test_insert_and_delete_reverse_each_other(spark):
    df = frame(spark)
    some, rest = frame(spark, [r for r in rows() if (r[0] or 107) < 107]), frame(spark, [r for r in rows() if (r[0] or 0) >= 107])
    part = d.LineDedup.build(some)
    whole = part.insert(rest)
    assert result(whole.clean(df)) == result(d.dedup_lines(df))
    back = whole.delete(rest)
    assert result(back.clean(some)) == result(part.clean(some)) == brute([(r.doc_id, r.text) for r in some.collect()])
    assert sorted(back.counts.collect()) == sorted(part.counts.collect())


def test_false_hits_are_excepted():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 100))
    filters = {0: d.build_filter(a, b).table.tobytes()}
    assert d.Probe(filters, 1).hits(a, b).all()
    wrong = frozenset([(int(a[3]), int(b[3]))])
    assert np.flatnonzero(~d.Probe(filters, 1, wrong).hits(a, b)).tolist() == [3]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 4000))
    f = d.build_filter(a, b)
    assert f.contains(a, b).all()
    x, y = rng.integers(-(2**63), 2**63 - 1, (2, 20000))
    assert f.contains(x, y).mean() < 0.001
    f.delete(a[:2000], b[:2000])
    assert f.contains(a[2000:], b[2000:]).all() and not f.contains(a[:2000], b[:2000]).any()
