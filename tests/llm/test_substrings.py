import random
import re

import pytest

from spanforge.llm import substrings as x

from .fixtures import empty, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    """(words, removed, kept text) for each text."""
    cut = [WORD.findall(t or "") for t in texts]
    counts = {}
    for w in cut:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            counts[key] = counts.get(key, 0) + 1
    out = []
    for w in cut:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(v for j, v in enumerate(w) if j not in gone)))
    return out


def got(df):
    return sorted((r.substring_words, r.substring_removed, r.text) for r in df.collect())


def planted(seed=3, n=120):
    """Texts of few different words with passages that stand in several of them, whole, cut and spoiled in a word."""
    rng = random.Random(seed)
    draw = lambda k, m=400: [f"v{rng.randrange(m)}" for _ in range(k)]
    passages = [draw(rng.randrange(30, 120)) for _ in range(12)]
    texts = []
    for i in range(n):
        words = draw(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            a = rng.randrange(0, 20)
            p = p[a : a + rng.randrange(20, 120)]
            if p and rng.random() < 0.4:
                p[rng.randrange(len(p))] = "spoiled"
            words += p + draw(rng.randrange(0, 15))
        texts.append((" " if i % 2 else "\n").join(words))
    return texts + texts[:10] + ["again " * 300, "a b c " * 90, "again " * 34, None, "", " \t", "x" * 100_000]


@pytest.mark.parametrize(("window", "together", "passages", "streamed"), [(35, 2048, 20_000, 200_000), (35, 1, 3, 5), (12, 4, 2, 7)])
def test_equal_to_brute_force(spark, monkeypatch, window, together, passages, streamed):
    for name, value in (("TOGETHER", together), ("PASSAGES", passages), ("CROWD", passages), ("STREAMED", streamed), ("CHUNK", 64)):
        monkeypatch.setattr(x, name, value)
    texts = planted()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got(x.drop_repeats(df, window)) == sorted(brute(texts, window))


def test_joins_of_frequent_keys_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(x, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(x, "HOT", 50)
    texts = planted(5, 40) + [f"own{i} " + " ".join(f"w{k}" for k in range(50)) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got(x.drop_repeats(df)) == sorted(brute(texts, 35))


def test_awkward_rows(spark):
    df = frame(spark)
    out = x.drop_repeats(df)
    assert out.columns == [*df.columns, "substring_words", "substring_removed", "substring_spans"]
    at, n = df.columns.index("text"), len(df.columns)
    rows = [tuple(r) for r in out.collect()]
    assert sorted((r[n], r[n + 1], r[at]) for r in rows) == sorted(brute([tuple(r)[at] for r in df.collect()], 35))
    assert all(r[n + 1] == sum(s.e - s.s for s in r[n + 2] or ()) for r in rows)
    assert x.drop_repeats(empty(spark)).count() == 0


def test_a_text_of_a_megabyte(spark):
    long = " ".join(f"n{i}" for i in range(150_000))
    texts = [long, "own " + " ".join(f"n{i}" for i in range(100_000, 100_060))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r[:2] for r in got(x.drop_repeats(df))] == [(61, 60), (150_000, 60)]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    words = [f"v{rng.randrange(6)}".encode() for _ in range(500)]
    first, last, anchor = x.anchored(words, 12)
    of = {}
    for a, b, h in zip(first, last, anchor, strict=True):
        for i in range(a, b + 1):
            assert of.setdefault(tuple(words[i : i + 12]), (h, )) == (h,)
    assert first[0] == 0 and last[-1] == 488 and (first[1:] == last[:-1] + 1).all()
