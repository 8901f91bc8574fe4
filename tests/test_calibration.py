"""The band of resamples against a plain version; the whole table is compared with SQL in test_queries."""

import hashlib

import pytest

from spanforge.operators import calibration as x


def band(rows):
    n, found = len(rows), []
    for b in range(x.RESAMPLES):
        drawn = [rows[int(hashlib.md5(f"{x.SEED}_{b}_{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)]
        both, of = sum(bool(d and t) for d, t in drawn), sum(bool(d) for d, _ in drawn) + sum(bool(t) for _, t in drawn)
        found.append(round(2 * both / of, 6) if of else 0.0)
    found.sort()
    return found[int(0.025 * x.RESAMPLES)], found[int(0.975 * x.RESAMPLES) - 1]


@pytest.mark.parametrize("held", [x.HELD, 7])
def test_bands_equal_plain_resamples(spark, held):
    modes = {"a": [(i % 3 == 0, i % 2 == 0) for i in range(40)], "b": [(True, None), (None, True), (True, True), (False, True)], "c": [(True, True)] * 3}
    rows = [(m, i, d, t) for m, of in modes.items() for i, (d, t) in enumerate(of)]
    p = spark.createDataFrame(rows, "mode string, record_id long, detected boolean, truth boolean")
    got = {r["mode"]: (r.lower, r.upper) for r in x.bootstrap(p, held).collect()}
    assert got == {m: pytest.approx(band(modes[m])) for m in "ab"}
