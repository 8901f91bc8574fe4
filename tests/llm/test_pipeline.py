import corpus_pipeline as cp
from spanforge.llm import linededup, minhash, mixing, packing, toxicity

from .fixtures import empty, frame
from .test_linededup import brute as brute_lines
from .test_minhash import brute as brute_groups
from .test_packing import check as check_packing

SMALL = "/root/testdata/sf0.01"


def test_stages_each_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out, columns = [docs], list(docs.columns)
    for name, stage in cp.STAGES:
        stage(spark, out[-1], SMALL).write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    assert [s for s, _ in cp.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    assert all(sorted(o.columns) == sorted(columns) for o in out[:-1])
    rows = [[(r.doc_id, r.text) for r in o.select("doc_id", "text").collect()] for o in out[:-1]]

    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert sorted(d for d, _ in rows[1]) == sorted(d for d, p in scores.items() if not p)
    clean = {d for d, _ in rows[1]}
    told = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(t == 0 and d not in clean for d, t in told.items()) <= 0.01 * len(told)

    import hashlib

    want = brute_lines(rows[1])
    assert sorted((str(d), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows[2]) == sorted((d, h) for d, _, _, h in want)

    groups = brute_groups(rows[2])
    assert sorted(str(d) for d, _ in rows[3]) == sorted(d for d, _, _, kept in groups if kept)

    takes = {r.doc_id: r for r in mixing.mix_sizes(out[3]).collect()}
    times = {}
    for d, _ in rows[4]:
        times[d] = times.get(d, 0) + 1
    assert all(times.get(d, 0) * r["size"] == r.taken for d, r in takes.items())

    check_packing(rows[4], [r for r in out[5].collect()])
    assert linededup and minhash and packing


def test_run_gives_the_last_stage(spark):
    out = cp.run(spark, SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    """Null, empty, long and repeated texts, null ids and clashing columns go through every stage; so does a table without rows."""
    spark.createDataFrame([(1, 0, 0), (101, 1, 1), (102, 0, 1), (None, 1, 1), (103, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (frame(spark), empty(spark)):
        docs = rows
        for name, stage in cp.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == list(cp.COLUMNS)
            path = str(tmp_path / f"{name}-{rows is docs}-{docs.count()}")
            out.write.mode("overwrite").parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        assert (docs.count() > 0) == (rows.count() > 0)


def test_a_megabyte_of_text(spark, tmp_path):
    """A very long text is scored, stripped of lines, compared, mixed and packed with all its words."""
    import random

    draw = random.Random(3)
    words = [f"w{draw.randrange(50000)}" for _ in range(180_000)]
    long = " ".join(words)
    rows = [(1, long, "en", "a", len(long)), (2, long + " end", "en", "a", len(long) + 4), (3, "short text of six plain words", "en", "b", 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(long) > 1_000_000
    kept = {r.doc_id for r in minhash.keep_one(docs).collect()}
    assert kept == {1, 3}
    sizes = {r.doc_id: r["size"] for r in mixing.mix_sizes(docs).collect()}
    assert sizes == {1: 180_000, 2: 180_001, 3: 6}
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces if p.doc_id == 1) == next(p.doc_tokens for p in pieces if p.doc_id == 1) > 180_000
