import hashlib
import math
import re
import zlib

from spanforge.llm import resample as x

from .fixtures import empty, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    s, t = [0] * 10000, [0] * 10000
    for held, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in features(text):
                held[b] += 1
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(sum(s) + 10000) / (float(s[b] + 1) * float(sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    some = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(some[: 5 * len(some) // 100]):
        r[4] = k + 1
    return rows


def test_ring_equals_joined_words():
    for text in (None, "", "a", "A b\tC", "Été 12 x-y_z " * 9, "ß" * 5 + "\x7f" + "q"):
        for n in (1, 2, 3, 5):
            w = words(text)
            want = sorted(zlib.crc32(" ".join(w[i : i + k]).encode()) % 777 for k in range(1, n + 1) for i in range(len(w) - k + 1))
            assert sorted(b for found, _ in x.runs(text, n, 777) for b in found.tolist()) == want


def test_a_long_text_comes_in_pieces():
    text = "word other third " * 100_000
    pieces = list(x.runs(text))
    assert len(pieces) > 10 and max(len(p) for p, _ in pieces) < x.PIECE + x.RUN
    assert sum(n for _, n in pieces) == 300_000 and sum(len(p) for p, _ in pieces) == 3 * 300_000 - 3


def test_awkward_rows(spark):
    df = frame(spark)
    target = spark.createDataFrame([("Common line here, w1 w2 w3",), (None,), ("",)], "text string")
    docs = [(r[0], r[1]) for r in df.collect()]
    docs += [(1000 + i, f"w{i} w1 w2 " * (7 + i)) for i in range(60)]
    more = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, ["Common line here, w1 w2 w3", None, ""])
    got = x.draw(more, target).collect()
    assert sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score) for r in got))) == sorted(map(str, (tuple(r[:4]) for r in want)))
    drawn = sorted((r.rank, r.score) for r in got if r.rank is not None)
    assert drawn == sorted((r[4], r[3]) for r in want if r[4] is not None) and len(drawn) >= 3
    assert len(x.draw(df, target).collect()) == df.count()
    assert x.draw(empty(spark), target).count() == 0
    assert x.draw(more, target.limit(0)).count() == len(docs)


def test_ranks_by_range_equal_a_sort(spark, monkeypatch):
    monkeypatch.setattr(x, "RANKED", 7)
    docs = [(i // 2 if i % 5 else None, "same words again and " * 6) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = x.draw(df, spark.createDataFrame([("same words",)], "text string"), percent=40).collect()
    drawn = sorted((r.rank, -r.score) for r in got if r.rank is not None)
    assert [k for k, _ in drawn] == list(range(1, 161)) and [s for _, s in drawn] == sorted(s for _, s in drawn)


def test_whole_table_equals_plain_version(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = sorted(str(tuple(r)) for r in x.op13_resample(spark, d).collect())
    assert got == sorted(str(tuple(r[:5])) for r in brute(docs, target))
