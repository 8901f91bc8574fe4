"""Language ID (5): word-first backoff.

A known word scores its log frequency in each language. An unseen word is scored by its longest character
n-grams that are known, from four down to one. The model comes from a bounded sample of each language's
labelled texts and is small enough for every task; every text is predicted from all its words.
"""

import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, columns_once, pieces, table

#: Labelled texts of a language that the model is fitted on at most, on average; all their words are learned.
LABELLED = 20_000
ORDERS = (4, 3, 2, 1)
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Word scores that a task remembers.
REMEMBER = 300_000

_LETTER = re.compile(r"[^\W\d_]")
_SPACE = bytes(b if (65 <= b < 91 or 97 <= b < 123 or b >= 128) else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs without ASCII digits, punctuation and white space."""
    return text.lower().encode("utf-8", "replace").translate(_SPACE).split()


def grams_of(word: str) -> list[str]:
    """The n-grams of a word between two spaces, longest first."""
    s = f" {word} "
    return [s[i : i + order] for order in ORDERS for i in range(len(s) - order + 1)]


class Model(dict):
    """Maps a word to its row of ``table``; unseen words get a row by backoff when first asked for."""

    def __init__(self, langs: list[str], words: list[bytes], rows: np.ndarray, grams: list[str], gram_rows: np.ndarray):
        """rows and gram_rows: how often each word and each n-gram occurs in each language."""
        super().__init__()
        self.langs = langs
        self.base = {w: i for i, w in enumerate(words)}
        self.words = np.log((rows + 0.5) / (rows.sum(0) + 0.5 * len(words) + 1))
        order = np.array([len(g) for g in grams], int)
        logs = np.zeros_like(gram_rows)
        for o in ORDERS:
            own = gram_rows[order == o]
            logs[order == o] = np.log((own + 0.5) / (own.sum(0) + 0.5 * len(own) + 1))
        self.grams = dict(zip(grams, logs, strict=True))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(self.base)
        self.table = np.zeros((len(self.base) + 65536, len(self.langs)))
        self.table[: len(self.base)] = self.words

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.back_off(word.decode("utf-8", "replace"))
        self[word] = at
        return at

    def back_off(self, word: str) -> np.ndarray:
        for _, some in groupby(grams_of(word), key=len):
            found = [self.grams[g] for g in some if g.strip() and g in self.grams]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        if len(self) > len(self.base) + REMEMBER:
            self.reset()
        at = [self[w] for w in words_of(text)]
        total = self.table[at].sum(axis=0) if at else np.zeros(len(self.langs))
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())

    def __reduce__(self):
        return _restore, (self.langs, self.base, self.words, self.grams)


def _restore(langs, base, words, grams) -> Model:
    m = Model.__new__(Model)
    dict.__init__(m)
    m.langs, m.base, m.words, m.grams = langs, base, words, grams
    m.reset()
    return m


def fold(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)), F.lit(0))


def table_of(counts: DataFrame, key: str, langs: list[str]) -> tuple[list, np.ndarray]:
    """The distinct keys in order, and their counts by language, from rows (lang, key, n)."""
    found = counts.toArrow()
    coded = found.column(key).combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    place = {lang: k for k, lang in enumerate(langs)}
    out = np.zeros((len(names), len(langs)))
    np.add.at(out, (coded.indices.to_numpy(), [place[x] for x in found.column("lang").to_pylist()]), found.column("n").to_numpy())
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], out[order]


def train(docs: DataFrame, labelled: int = LABELLED) -> Model:
    """Fit on the texts with a language outside the held-out fold; of a language with more than ``labelled``, on a sample by hash."""
    spark = docs.sparkSession
    slim = columns_once(docs, "doc_id", "text", "lang").filter((fold(F.col("doc_id")) != HELD) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    per = {r["lang"]: r["count"] for r in slim.groupBy("lang").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Only languages above the bound have a share; all texts of the others are taken.
    often = {lang: labelled / n for lang, n in per.items() if n > labelled}
    share = F.coalesce(F.create_map(*[F.lit(x) for pair in often.items() for x in pair])[F.col("lang")], F.lit(1.0)) if often else F.lit(1.0)
    sample = slim.filter(place < share).select("lang", "text")

    def count(batches):
        seen: dict = defaultdict(Counter)
        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[lang].update(words_of(text.as_py()))
        rows = [(lang, w, k) for lang, c in seen.items() for w, k in c.items()]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    def split(batches):
        seen: Counter = Counter()

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for g in grams_of(word.decode()):
                    seen[lang, g] += n
            if len(seen) > 500_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    scratch = Scratch(spark, "langid")
    counts = scratch.keep(sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    words = table_of(counts, "word", langs)
    grams = table_of(counts.mapInArrow(split, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram", langs)
    scratch.drop(counts)
    return Model(langs, *words, *grams)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if no language was
    learned. The score is the predicted language's share of the likelihood; ties go to the first by name.
    Only doc_id and text are read; an empty table gives an empty result. A null id isn't held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in pieces(batches):
            found = [m.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    slim = columns_once(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = slim.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD).alias("held_out"), "lang_pred", "score")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
