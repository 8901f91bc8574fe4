import hashlib
import math
from fractions import Fraction

import numpy as np

from spanforge.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, form string, ints int, VEC_ID long, Embedding string, codes int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, -1, "y", 2) for r in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, codebooks_sha256) in plain Python integers."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        some = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
        ends = codes.bounds(dim, parts)
        cut = lambda v: [v[a:b] for a, b in zip(ends, ends[1:], strict=False)]  # noqa: E731, B023
        books = [[list(cut(v)[p]) for _, v, _ in some[:entries]] for p in range(parts)]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            for p in range(parts):
                held = {}
                for _, v, _ in some:
                    held.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
                for k, xs in held.items():
                    books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for i, v, label in some:
            found = [near(x, books[p]) for p, x in enumerate(cut(v))]
            out.append((i, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), codes.LONGEST), label, sha))
    sums = {}
    for _, _, e, label, _ in out:
        sums[label] = sums.get(label, 0) + e
    return sorted(map(str, ((i, c, e, min(sums[label], codes.LONGEST), sha) for i, c, e, label, sha in out)))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def awkward(dim=16):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=dim) * (1 if i % 3 else 9)).tolist(), i % 2) for i in range(60)]
    rows += [(3, rows[3][1], 1), (90, rows[3][1], None), (91, None, 1), (92, [None] + [1.0] * (dim - 1), 1), (93, [math.nan] * dim, 0), (94, [math.inf] * dim, None)]
    rows += [(95, [0.0] * dim, None), (96, [-0.0] * dim, 0), (97, [], 2), (None, [0.5] * dim, 3), (98, [1.0, -2.5, 3.0], 1), (99, [1.5, 2.0, -7.0], 1)]
    return rows


def test_awkward_rows_equal_plain_integers(spark):
    rows = awkward()
    assert got(codes.compress(frame(spark, rows))) == brute(rows)
    assert codes.compress(frame(spark, [])).count() == 0
    few = [(5, [1.0] * 8, 1), (6, [2.0] * 8, None)]
    assert got(codes.compress(frame(spark, few))) == brute(few)


def test_components_of_any_size_are_exact(spark):
    rows = [(i, [(-1.0) ** i * 1e30 / (i + 1), 1e300, 1e-300, float(i)] + [float(i % 3)] * 4, 1) for i in range(24)]
    assert got(codes.compress(frame(spark, rows))) == brute(rows)


def test_ties_and_unused_entries(spark):
    rows = [(i, [float(i % 2)] * 8, i % 3) for i in range(40)] + [(100, [0.5] * 8, 1)]
    assert got(codes.compress(frame(spark, rows))) == brute(rows)


def test_search_equals_a_full_scan():
    rng = np.random.default_rng(5)
    for scale in (3, 50, 5000):
        entries = rng.integers(-scale, scale, (16, 4))
        x = rng.integers(-scale, scale, (500, 4))
        d = ((x[:, None] - entries[None]) ** 2).sum(-1)
        at, best = codes.Codebook(entries).nearest(x, rng.integers(0, 16, 500))
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
