import math
import re
import zlib
from collections import Counter

import numpy as np

from spanforge.llm import langid, toxicity

from .fixtures import empty, frame

SMALL, TINY = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


def test_block_max_equals_a_full_scan():
    rng = np.random.default_rng(7)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w**2).sum())))
    index = toxicity.BlockMax(vectors, 60)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for but in (None, np.arange(100)):
        for i, ((t, w), (got, near)) in enumerate(zip(vectors[:100], index.nearest(vectors[:100], 25, but), strict=True)):
            s = dense[:, t] @ w
            if but is not None:
                s[i] = 0
            order = np.lexsort((np.arange(500), -s))
            want = [j for j in order[:25] if s[j] > 0]
            assert np.allclose(near, s[want])
            assert np.allclose(s[got], s[want])
    assert index.reads[2] < index.reads[1]  # some blocks are passed over


def test_toxicity_equals_a_plain_search(spark):
    """Weights, cosines and votes worked out anew from all texts and labels, without an index; blocks read are reported."""
    docs, labels = spark.read.parquet(f"{TINY}/documents.parquet"), spark.read.parquet(f"{TINY}/labels.parquet")
    scorer = toxicity.train(docs, labels, examples=10**6)
    got = {r.doc_id: r for r in toxicity.score(docs, scorer).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    bags = {d: Counter(toxicity.terms_of(t)) for d, t in texts.items()}
    first = {}
    for d in sorted(toxic):
        if d in texts and zlib.crc32(str(d).encode()) % 5:
            first.setdefault(texts[d], [d, 0])[1] |= toxic[d]
    train = dict(first.values())
    df = Counter(w for b in bags.values() for w in b)
    n = [Counter(w for d, y in train.items() if y == label for w in bags[d]) for label in (0, 1)]
    per = Counter(train.values())

    def scale(w):
        odds = [math.log((n[y][w] + 0.5) / (per[y] - n[y][w] + 0.5)) for y in (0, 1)]
        sure = max(0, abs(odds[1] - odds[0]) - 3 * math.sqrt(1 / (n[1][w] + 0.5) + 1 / (n[0][w] + 0.5)))
        return (math.log((1 + len(texts)) / (1 + df[w])) + 1) * (0.03 + 0.97 * (1 - math.exp(-sure)))

    vocabulary = {w for d in train for w in bags[d]}
    scales = {w: scale(w) for w in vocabulary}

    def vector(d):
        v = {w: (1 + math.log(k)) * scales[w] for w, k in bags[d].items() if w in scales}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    examples = {d: vector(d) for d in train}
    for d in texts:
        v = vector(d)
        near = sorted((-sum(x * e.get(w, 0) for w, x in v.items()), i) for i, e in examples.items())[:15]
        near = [(-c, i) for c, i in near if c < 0]
        if not v:
            assert got[d].evidence == [] and abs(got[d].score - (per[1] + 0.5) / (len(train) + 1)) < 1e-12
            continue
        assert got[d].evidence and np.allclose(got[d].evidence_cosine, [c for c, _ in near[:3]], atol=2e-6)
        yes, all_ = sum(c for c, i in near if train[i]), sum(c for c, _ in near)
        vote = math.log((yes + 0.02 * all_ + 1e-9) / (all_ - yes + 0.02 * all_ + 1e-9))
        a, b = scorer.fit
        if abs(near[-1][0] - (near[-2][0] if len(near) > 1 else 0)) > 1e-9:
            assert abs(got[d].score - 1 / (1 + math.exp(-max(-30, min(30, a * vote + b))))) < 1e-6
    own = toxicity.train(docs, labels)
    own.score(list(texts.values()))
    print("blocks read of all", own.index.reads[2] / (own.index.reads[0] * own.index.blocks))


def test_toxicity_awkward_rows(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0), (4, 7), (100, 0), (101, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(df, labels).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.toxicity(df, labels.limit(0)).count() == df.count()
    assert toxicity.keep_clean(df, labels).columns == df.columns


def test_toxicity_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in toxicity.op4_toxicity(spark, SMALL).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [(rows[i].predicted, t) for i, t in labels.items() if i in rows and rows[i].held_out]
    right = np.mean([p == t for p, t in held])
    caught = np.mean([p for p, t in held if t == 1])
    false = np.mean([p for p, t in held if t == 0])
    print("accuracy", right, "caught", caught, "false", false)
    assert right > 0.98 and caught > 0.88 and false < 0.005


def test_language_awkward_rows(spark):
    df = frame(spark)
    rows = langid.identify(df, langid.train(df)).collect()
    assert len(rows) == df.count()
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (6, 7, 8):
            assert r.lang_pred == "und" and r.score == 0
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert texts
    assert langid.identify(empty(spark), langid.train(empty(spark))).count() == 0


def test_language_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in langid.op5_langid(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()
    held = [rows[r.doc_id].lang_pred == r.lang for r in docs if rows[r.doc_id].held_out]
    print("accuracy", np.mean(held))
    assert np.mean(held) > 0.98


def test_rare_languages_keep_their_texts(spark):
    rows = [(i, f"common word number{i % 7}", "aa") for i in range(4000)] + [(5000 + i, f"selten wort{'abcdefgh'[i]}", "bb") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(docs, labelled=40)
    learned = {f"wort{'abcdefgh'[i]}".encode() for i in range(8) if zlib.crc32(str(5000 + i).encode()) % 4 != 2}
    assert m.langs == ["aa", "bb"] and learned and learned <= m.base.keys()
    assert m.predict("selten")[0] == "bb" and m.predict("common")[0] == "aa"


def test_unseen_words_back_off(spark):
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("strand strong " * 5, "a"), ("olivier olive " * 5, "b")] * 3)]
    m = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert m.predict("stran")[0] == "a" and m.predict("oliv")[0] == "b"
    assert m.predict("12 ...") == ("und", 0.0)
    assert m.predict("漢")[0] in ("a", "b")


def test_languages_equal_a_plain_version(spark):
    """Every prediction of a table worked out anew with plain counts, words before n-grams."""
    rows = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in langid.op5_langid(spark, TINY).collect()}
    words, grams = {}, {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            words.setdefault(r.lang, Counter()).update(re.findall(r"[^\x00-@\[-`{-\x7f]+", r.text.lower()))
    langs = sorted(words)
    for lang in langs:
        grams[lang] = Counter()
        for w, n in words[lang].items():
            for k in range(1, 5):
                for i in range(len(w) + 3 - k):
                    grams[lang][f" {w} "[i : i + k]] += n
    known, pieces = {w for c in words.values() for w in c}, {g for c in grams.values() for g in c}
    size = {lang: sum(words[lang].values()) for lang in langs}
    kinds = Counter(map(len, pieces))
    total = {lang: {k: sum(n for g, n in grams[lang].items() if len(g) == k) for k in kinds} for lang in langs}

    def score(w, lang):
        if w in known:
            return math.log((words[lang][w] + 0.5) / (size[lang] + 0.5 * len(known) + 1))
        for k in (4, 3, 2, 1):
            found = [g for i in range(len(w) + 3 - k) if (g := f" {w} "[i : i + k]).strip() and g in pieces]
            if found:
                return sum(math.log((grams[lang][g] + 0.5) / (total[lang][k] + 0.5 * kinds[k] + 1)) for g in found) / len(found)
        return 0.0

    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        seen = Counter(re.findall(r"[^\x00-@\[-`{-\x7f]+", r.text.lower()))
        s = [sum(n * score(w, lang) for w, n in seen.items()) for lang in langs]
        p = np.exp(np.array(s) - max(s))
        assert got[r.doc_id].lang_pred == langs[int(np.argmax(s))]
        assert abs(got[r.doc_id].score - p.max() / p.sum()) < 1e-6
