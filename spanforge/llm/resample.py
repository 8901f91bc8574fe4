"""Target-distribution importance resampling (13): hashed n-gram buckets by a streaming CRC ring, Gumbel top-k.

One scan of a document keeps the running zlib states of its last n starts. A word extends each of them by a
space and itself, and begins a state of its own; every state is then the CRC of one run of words that ends here,
and its remainder is the run's bucket. Nothing is joined into strings, and a text of any length needs the memory
of one piece. Bucket counts of the documents and of the target give each bucket a gain; a second scan adds the
gains up. Drawing without replacement in proportion to the weights is taking the highest of weight plus Gumbel
noise; a histogram of bounded size says which rows can be among them, and only those are sorted, by range over
many tasks.
"""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import Scratch, columns_once, table

#: ASCII letters and digits and all other code points; in UTF-8 every byte of the latter is 128 or more.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, "42"
#: Buckets that a scan hands over at a time.
PIECE = 1 << 16
#: Cells of the histogram of scores for each doubling of a score.
CELLS = 1024
#: Rows that one task ranks.
RANKED = 1_000_000


def runs(text: str | None, run: int = RUN, buckets: int = BUCKETS):
    """Arrays of buckets of all runs of 1 to ``run`` words, with the number of words that each array saw begin."""
    crc, ring, found, words = zlib.crc32, [], [], 0
    for m in WORD.finditer((text or "").encode().lower()):
        word = m.group()
        spaced = b" " + word
        if len(ring) == run:
            del ring[0]
        ring = [crc(spaced, state) for state in ring]
        ring.append(crc(word))
        found += ring
        words += 1
        if len(found) >= PIECE:
            yield np.array(found, np.int64) % buckets, words
            found, words = [], 0
    if found:
        yield np.array(found, np.int64) % buckets, words


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all runs of the column ``text``; a task adds its own up before the shuffle."""

    def count(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found, _ in runs(text.as_py(), run, buckets):
                    held += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, smoothed by one in every bucket; ``buckets`` bounds what reaches the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for held, frame in ((s, docs), (t, target)):
        for r in bucket_counts(frame, run, buckets).collect():
            held[r.bucket] = r.n
    all_s, all_t = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row for each row of (doc_id, text)."""

    def weigh(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = features = weight = 0
                for found, begun in runs(text.as_py(), run, len(gain)):
                    words, features, weight = words + begun, features + len(found), weight + int(gain[found].sum())
                rows.append((words, features, weight))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, scratch: Scratch, n: int) -> DataFrame:
    """``rows`` with their rank in ``order``: dealt by range over many tasks, each task's places shifted by those before it."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // RANKED + 1)
    dealt = scratch.keep(rows.repartitionByRange(tasks, *order).withColumn("task", F.spark_partition_id()), "ranges")
    before = 0
    shift = []
    for r in sorted(dealt.groupBy("task").count().collect()):
        shift.append((r.task, before))
        before += r["count"]
    shifts = rows.sparkSession.createDataFrame(shift, "task int, before long")
    place = F.row_number().over(W.partitionBy("task").orderBy(*order)).cast("long")
    return dealt.join(F.broadcast(shifts), "task").withColumn("rank", place + F.col("before")).drop("task", "before")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of ``docs``; rank is null where it isn't drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn, rounded down. A null, empty or wordless
    text has no features and weighs nothing; its score is its noise alone. The noise follows the id, so that rows
    which repeat an id share it; a null id takes that of an empty one and comes after the others in ties, and rows
    equal in score and id take neighbouring ranks. Only doc_id and text of ``docs`` and text of ``target`` are read;
    without target texts all gains follow the documents alone, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    slim = columns_once(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    gain = gains(slim, columns_once(target, "text"), run, buckets)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = weighed(slim, gain, run).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    # A cell is never above that of a higher score, and there are some 130,000 of them whatever the scores.
    cell = (F.signum(F.col("score").cast("double")) * F.floor(F.log2(F.abs("score") + 1.0) * CELLS)).cast("int")
    scored = scratch.keep(scored.withColumn("cell", F.when(F.col("n_words") >= least_words, cell)), "scored")
    cells = scored.filter("cell is not null").groupBy("cell").count().collect()
    wanted = percent * sum(r["count"] for r in cells) // 100
    least, held = None, 0
    for r in sorted(cells, reverse=True):
        if held >= wanted:
            break
        least, held = r.cell, held + r["count"]
    out = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select(*out, unranked)
    may = F.coalesce(F.col("cell") >= least, F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    first = ranked(scored.filter(may), order, scratch, held).select(*out, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return first.unionByName(scored.filter(~may).select(*out, unranked))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
