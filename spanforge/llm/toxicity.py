"""Toxicity (4): nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled examples is indexed with all their words. A word's weight in a text is its
TF-IDF, stretched by how surely the word tells the labels apart: a word that does not keeps ``FLOOR`` of its
weight, so every word counts and every text with a word of the examples is searched. Document frequencies
and label counts of these words are counted over all documents. For each word and block of examples the
index knows the largest weight, so that blocks whose bound stays below the k-th neighbour are passed over
without changing the result; many texts are searched at once. Neighbours vote with their cosines; the vote
is calibrated on the examples themselves, each left out of its own neighbours.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, Scratch, columns_once, numbered, pieces, position, table

#: Labelled examples of each label that are indexed, on average, where there are as many.
EXAMPLES = 1500
NEIGHBOURS = 15
BLOCK = 32
#: Blocks that are read first, by falling bound, before the k-th neighbour rules others out.
FIRST_BLOCKS = 6
#: Share of its TF-IDF that a word without a bearing on the labels keeps, and the standard errors that a bearing must exceed.
FLOOR, ERRORS = 0.03, 3.0
#: Cells of the index that a batch of searches spreads out at a time.
CELLS = 1 << 17
#: The held-out fold: crc32(doc_id as text) mod FOLDS is 0.
FOLDS = 5

_SPACE = bytes(b if (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPACE).split()


def known_terms(at: dict, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, rising, and occurrences of a text's words that are in the vocabulary ``at``."""
    ids = [i for i in map(at.get, terms_of(text)) if i is not None]
    return np.unique(np.array(ids, np.int32), return_counts=True)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for ``size`` places each, end to end."""
    return np.repeat((start - np.cumsum(size) + size).astype(np.int32), size) + np.arange(int(size.sum()), dtype=np.int32)


class BlockMax:
    """Examples' unit vectors as postings in order of word and block; a cell is a word's postings in a block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        n = len(vectors)
        self.n, self.blocks = n, -(-n // BLOCK)
        terms = np.concatenate([t for t, _ in vectors]).astype(np.int64) if n else np.zeros(0, np.int64)
        weights = np.concatenate([w for _, w in vectors]) if n else np.zeros(0)
        examples = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        order = np.lexsort((examples, terms))
        terms, self.weights, self.examples = terms[order], weights[order], examples[order].astype(np.int32)
        key = terms * max(1, self.blocks) + self.examples // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.start, self.size = first, np.diff(first, append=len(key))
        self.block = (self.examples[first] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(terms[first], np.arange(n_terms + 1))  # a word's cells are cells[t] to cells[t + 1]
        self.reads = np.zeros(3, np.int64)  # texts searched, blocks with a bound, blocks read

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of each vector's k largest positive cosines, ties to the earlier example; ``but`` are examples to leave out."""
        out, at = [], 0
        room = [int((self.cells[t + 1] - self.cells[t]).sum()) for t, _ in vectors]
        while at < len(vectors):
            end, cells = at, 0
            while end < len(vectors) and end - at < 256 and (end == at or cells + room[end] <= CELLS):
                cells += room[end]
                end += 1
            out += self._some(vectors[at:end], k, None if but is None else but[at:end])
            at = end
        return out

    def _some(self, vectors, k, but):
        m = len(vectors)
        terms = np.concatenate([t for t, _ in vectors])
        weights, row = np.concatenate([w for _, w in vectors]), np.repeat(np.arange(m), [len(t) for t, _ in vectors])
        size = self.cells[terms + 1] - self.cells[terms]
        cell, row, weights = spread(self.cells[terms], size), np.repeat(row, size), np.repeat(weights, size)
        place = row * self.blocks + self.block[cell]
        bounds = np.bincount(place, weights * self.most[cell], m * self.blocks).reshape(m, self.blocks) * (1 + 1e-9)
        first = np.zeros((m, self.blocks), bool)
        lead = np.argpartition(-bounds, min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS]
        np.put_along_axis(first, lead, True, 1)
        first &= bounds > 0
        total = np.zeros(m * self.n)
        self._read(total, first, cell, row, weights, place)
        near = total.reshape(m, self.n)
        if but is not None:
            near[np.arange(m), but] = 0.0
        kth = np.partition(near, self.n - k, axis=1)[:, self.n - k] if self.n > k else np.zeros(m)
        rest = (bounds > 0) & (bounds >= kth[:, None]) & ~first
        self._read(total, rest, cell, row, weights, place)
        if but is not None:
            near[np.arange(m), but] = 0.0
        self.reads += (m, int((bounds > 0).sum()), int(first.sum() + rest.sum()))
        found = []
        for s in near:
            at = np.flatnonzero(s >= np.partition(s, self.n - k)[self.n - k]) if self.n > k else np.arange(self.n)
            at = at[s[at] > 0]
            at = at[np.lexsort((at, -s[at]))[:k]]
            found.append((at, s[at]))
        return found

    def _read(self, total, chosen, cell, row, weights, place) -> None:
        """Add the postings of the chosen blocks. A pair of text and example adds up in order of the words, whatever else is read."""
        some = np.flatnonzero(chosen.ravel()[place])
        size = self.size[cell[some]]
        at = spread(self.start[cell[some]], size)
        key = np.repeat(row[some] * self.n, size) + self.examples[at]
        total += np.bincount(key, np.repeat(weights[some], size) * self.weights[at], len(total))


def bearing(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> np.ndarray:
    """How surely a word tells the labels apart, 0 to 1: its log odds beyond ``ERRORS`` standard errors, from texts of either label that hold it."""
    odds = lambda n, m: np.log((n + 0.5) / (m - n + 0.5))
    apart = np.abs(odds(n1, all1) - odds(n0, all0)) - ERRORS * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    return 1 - np.exp(-np.maximum(0, apart))


class Scorer:
    """Vocabulary, weights, index and calibration; bounded by the examples, so that every task can hold it."""

    def __init__(self, rows: list[tuple], counts: np.ndarray, n_docs: int, per: dict, k: int = NEIGHBOURS):
        """rows: (doc_id, toxic, numbers, occurrences) of the examples; counts: for each word the documents, and the toxic and
        other training texts, that hold it; per: training texts by label."""
        self.at: dict = {}
        self.k, self.per = k, {label: per.get(label, 0) for label in (0, 1)}
        self.idf = np.log((1 + n_docs) / (1 + counts[:, 0])) + 1
        self.scale = self.idf * (FLOOR + (1 - FLOOR) * bearing(counts[:, 1], counts[:, 2], self.per[1], self.per[0]))
        self.blank = (self.per[1] + 0.5) / (sum(self.per.values()) + 1)
        vectors = [self.weigh(t, n) for _, _, t, n in rows]
        order = self._alike(vectors)
        self.labels, self.ids = np.array([rows[i][1] for i in order], int), [rows[i][0] for i in order]
        vectors = [vectors[i] for i in order]
        self.index = BlockMax(vectors, len(self.idf))
        self.fit = (0.0, float(np.log(self.blank / (1 - self.blank))))
        if rows:
            self._calibrate(vectors)
        self.index.reads[:] = 0

    @staticmethod
    def _alike(vectors) -> list[int]:
        """An order that puts like examples into one block, for tight bounds: by the heaviest word, then by length."""
        heavy = [(int(t[np.argmax(w)]) if len(t) and w.max() > 0.5 else -1) for t, w in vectors]
        common: dict = {}
        for t, _ in vectors:
            for x in t.tolist():
                common[x] = common.get(x, 0) + 1
        # Texts of one language share their commonest words: the commonest word of at most a third of the examples parts them.
        limit = max(1, len(vectors) // 3)
        lead = [max(((common[x], -x) for x in t.tolist() if common[x] <= limit), default=(0, 0)) for t, _ in vectors]
        return sorted(range(len(vectors)), key=lambda i: (heavy[i], lead[i], len(vectors[i][0]), i))

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.scale[terms]
        return terms, w / np.sqrt((w**2).sum()) if len(w) else w

    def _votes(self, found) -> np.ndarray:
        yes = np.array([near[self.labels[ids] == 1].sum() for ids, near in found])
        both = np.array([near.sum() for _, near in found])
        return np.log((yes + 0.02 * both + 1e-9) / (both - yes + 0.02 * both + 1e-9))

    def _calibrate(self, vectors) -> None:
        """A logistic curve over the vote, examples weighing as many training texts as they stand for."""
        some = [i for i, (t, _) in enumerate(vectors) if len(t)]
        if not some:
            return
        x = self._votes(self.index.nearest([vectors[i] for i in some], self.k, np.array(some)))
        y = self.labels[some].astype(float)
        n = np.bincount(self.labels[some], minlength=2)
        w = np.array([max(self.per[label], n[label]) / max(1, n[label]) for label in (0, 1)])[self.labels[some]]
        a, b, ridge = 1.0, 0.0, np.diag([1e-2, 1e-2])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            v = w * p * (1 - p)
            grad = np.array([(w * (y - p) * x).sum(), (w * (y - p)).sum()]) - ridge @ np.array([a - 1, b])
            step = np.linalg.solve(np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + ridge, grad)
            a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
        self.fit = (max(0.0, a), b)

    def score(self, texts: list) -> tuple[np.ndarray, list, list]:
        """Scores, evidence's doc_ids and their cosines. Texts without a word of the examples get the rate of toxic training texts."""
        vectors = [known_terms(self.at, x) for x in texts]
        scores, ids, cosines = np.full(len(texts), self.blank), [[]] * len(texts), [[]] * len(texts)
        some = [i for i, (t, _) in enumerate(vectors) if len(t)]
        if some:
            found = self.index.nearest([self.weigh(*vectors[i]) for i in some], self.k)
            scores[some] = 1 / (1 + np.exp(-np.clip(self.fit[0] * self._votes(found) + self.fit[1], -30, 30)))
            for i, (at, near) in zip(some, found, strict=True):
                ids[i], cosines[i] = [self.ids[j] for j in at[:3]], near[:3].round(6).tolist()
        return scores, ids, cosines


def held_out_fold(doc_id, folds: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(1)).cast("int")


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Scorer:
    """Fit on labelled rows outside the held-out fold; equal texts count once, and so do repeated ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    slim = columns_once(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = columns_once(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("told_id"), F.col("toxic").cast("int").alias("toxic")).filter("told_id is not null and toxic in (0, 1)")
    told = told.filter(held_out_fold(F.col("told_id"), FOLDS) != 0).groupBy("told_id").agg(F.max("toxic").alias("toxic"))
    small = told.count() <= BROADCAST_ROWS
    known = slim.join(F.broadcast(told) if small else told, F.col("doc_id") == F.col("told_id")).select("doc_id", "text", "toxic")
    firsts = known.groupBy(F.xxhash64("text").alias("h1"), F.crc32("text").alias("h2")).agg(F.min("doc_id").alias("first_id"), F.max("toxic").alias("toxic"))
    firsts = scratch.keep(firsts.groupBy("first_id").agg(F.max("toxic").alias("toxic")), "firsts")
    per = {r["toxic"]: r["count"] for r in firsts.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("example"), "first_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {label: min(1.0, examples / max(1, per.get(label, 0))) for label in (0, 1)}
    picked = firsts.filter(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # The examples' own texts are the one bounded sample that reaches the driver; a repeated id gives its smallest text.
    texts = slim.join(F.broadcast(picked), F.col("doc_id") == F.col("first_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow()
    rows = sorted(zip(*[texts.column(c).to_pylist() for c in ("doc_id", "toxic", "text")], strict=True), key=lambda r: r[:2])
    words = sorted({w for _, _, text in rows for w in terms_of(text)})
    at = {w: i for i, w in enumerate(words)}
    shared = spark.sparkContext.broadcast(at)
    counted = slim.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, F.col("doc_id") == F.col("first_id"), "left").select("text", "toxic")

    def count(batches):
        number, seen, n = shared.value, np.zeros((len(shared.value), 3), np.int64), 0
        for batch in pieces(batches):
            n += batch.num_rows
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = known_terms(number, text.as_py())[0]
                seen[ids, 0] += 1
                if toxic is not None:
                    seen[ids, 2 - toxic] += 1
        some = np.flatnonzero(seen[:, 0])
        cols = [np.append(some, -1), *[np.append(seen[some, k], n if k == 0 else 0) for k in range(3)]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype("int64")) for c in cols], ["i", "n", "n1", "n0"])

    sums = counted.mapInArrow(count, "i long, n long, n1 long, n0 long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "n0")]).toArrow()
    scratch.drop(firsts)
    shared.unpersist()
    i, *n = [sums.column(c).to_numpy() for c in ("i", "n", "n1", "n0")]
    counts = np.zeros((len(words), 3))
    for k in range(3):
        counts[i[i >= 0], k] = n[k][i >= 0]
    scorer = Scorer([(d, toxic, *known_terms(at, text)) for d, toxic, text in rows], counts, int(n[0][i < 0].sum()), per)
    scorer.at = at
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, evidence_cosine): see ``toxicity``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        s = shared.value
        for batch in pieces(batches):
            scores, ids, cosines = s.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "evidence_cosine"])

    slim = columns_once(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = slim.mapInArrow(run, "doc_id long, score double, evidence array<long>, evidence_cosine array<double>")
    return out.select("doc_id", (held_out_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "evidence_cosine")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, evidence_cosine), a row for each row of ``docs``.

    Null and empty texts, and texts without a word of the examples, get the rate of toxic training texts,
    and no evidence. A null id isn't held out. Without any labelled row the score is one half. Evidence
    holds the three nearest examples' doc_ids and cosines; equal cosines go by the index's order. Only doc_id
    and text are read of ``docs``, doc_id and toxic of ``labels``; labels other than 0 and 1 are not used.
    Repeated rows give repeated results; texts of any length are searched with all their words.
    """
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below one half, with all their columns, whatever their names.

    Null and empty texts have the rate of toxic training texts for a score. Repeated rows stay or go alike;
    no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = position(docs, "text")

    def clean(batches):
        s = shared.value
        for batch in pieces(batches):
            yield batch.filter(pa.array(s.score(batch.column(at).to_pylist())[0] < 0.5))

    plain = numbered(docs)
    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
