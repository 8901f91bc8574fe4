"""Vector code compression (11): product quantisation in exact integers, with an exponion search.

Components become integers, vectors are cut into consecutive parts, and every part position has a codebook of
its own. A part's search starts at the entry it had in the round before. An entry can only be as near as that
one if it lies within twice the part's distance of it, by the triangle inequality; so the other entries, sorted
by their distance from the start, are tried up to that radius only. All distances are squared integers, so
that ties are true ties and go to the lower index.

A round is one pass: each task finds its parts' entries and adds up the parts of each entry; both are written
together, and the sums, a row for each task and entry, are read back by themselves. Codebooks are the one thing
that reaches the driver: 16 vectors for each vector length that the table holds.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, Scratch, columns_once, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LONGEST = (1 << 63) - 1
STATE = "vec_id long, label string, dim int, form string, ints binary, codes binary, part int, entry int, n long, sums array<string>"


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: 64-bit integers where no distance can overflow them, else Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if y.size == 0 or np.abs(y).max() < exact_below(x.shape[-1]):
        return y.astype(np.int64)
    ratios = [v.as_integer_ratio() for v in x.ravel().tolist()]
    return np.array([p * SCALE // q for p, q in ratios], object).reshape(x.shape)


def exact_below(dim: int) -> int:
    """Components below this keep four times a squared distance of ``dim`` of them within 64 bits."""
    return math.isqrt((1 << 62) // (16 * max(dim, 1)))


def bounds(dim: int, parts: int) -> list[int]:
    """Ends of consecutive parts; where ``parts`` doesn't divide ``dim``, the first parts have one component more."""
    size, more = divmod(dim, parts)
    return [0, *np.cumsum([size + (k < more) for k in range(parts)]).tolist()]


class Codebook:
    """The entries of one part position, and for each entry all of them by distance from it."""

    def __init__(self, entries: np.ndarray):
        small = entries.size == 0 or max(abs(int(v)) for v in entries.ravel()) < exact_below(entries.shape[1])
        self.entries = entries.astype(np.int64 if small else object)
        gaps = ((self.entries[:, None] - self.entries[None]) ** 2).sum(-1)
        k = len(entries)
        self.order = np.array([sorted(range(k), key=lambda j: (gaps[a, j], j)) for a in range(k)])
        self.gaps = np.take_along_axis(gaps, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``; ties go to the lower entry."""
        own = ((x - self.entries[start]) ** 2).sum(1)
        at, best, rows = start.copy(), own.copy(), np.arange(len(x))
        for step in range(len(self.entries)):
            rows = rows[self.gaps[start[rows], step] <= 4 * own[rows]]
            if not len(rows):
                break
            j = self.order[start[rows], step]
            d = ((x[rows] - self.entries[j]) ** 2).sum(1)
            better = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
            at[rows[better]], best[rows[better]] = j[better], d[better]
        return at, best


def packed(x: np.ndarray) -> tuple[str, list[bytes]]:
    """Integer rows as bytes of the least width that holds them all; beyond 64 bits as decimal text."""
    if x.dtype == object:
        return "text", [",".join(map(str, r)).encode() for r in x.tolist()]
    most = int(np.abs(x).max()) if x.size else 0
    form = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return form, [r.tobytes() for r in x.astype(form)]


def unpacked(form: str, raws: list[bytes], dim: int) -> np.ndarray:
    if form == "text":
        return np.array([list(map(int, r.split(b","))) for r in raws], object).reshape(len(raws), dim)
    return np.frombuffer(b"".join(raws), form).reshape(len(raws), dim).astype(np.int64)


def integers(vectors: DataFrame, label: str) -> DataFrame:
    """Rows of STATE without codes; vectors that are null or hold null or non-finite components are left out."""
    df = columns_once(vectors, "vec_id", label, "embedding")
    df = df.select(F.col("vec_id").cast("long"), F.col(label).cast("string"), F.col("embedding").cast("array<double>"))

    def convert(batches):
        for batch in batches:
            kept: dict[int, list] = {}
            for i, x in enumerate(batch.column(2)):
                if x.is_valid and not x.values.null_count:
                    v = x.values.to_numpy()
                    if np.isfinite(v).all():
                        kept.setdefault(len(v), []).append((i, v))
            for dim, rows in kept.items():
                form, raws = packed(whole(np.array([v for _, v in rows], float).reshape(len(rows), dim)))
                yield state(batch.take(pa.array([i for i, _ in rows])), dim, form, raws, None)

    return df.mapInArrow(convert, STATE)


def state(ids, dim, form, raws, codes) -> pa.RecordBatch:
    n = len(raws)
    none = [None] * n
    cols = [ids.column(0), ids.column(1), pa.array([dim] * n, pa.int32()), pa.array([form] * n), pa.array(raws, pa.binary()), pa.array(none if codes is None else codes, pa.binary())]
    cols += [pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in STATE.split(", ")])


def groups(batch: pa.RecordBatch, parts: int):
    """(rows, dim, form, raws, matrix, codes of the round before) by vector length and form."""
    dims, forms = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    by: dict = {}
    for i, key in enumerate(zip(dims, forms, strict=True)):
        by.setdefault(key, []).append(i)
    for (dim, form), rows in by.items():
        some = batch.take(pa.array(rows))
        raws, had = some.column(4).to_pylist(), some.column(5).to_pylist()
        codes = np.zeros((len(rows), parts), np.int64) if had[0] is None else np.frombuffer(b"".join(had), np.uint8).reshape(-1, parts).astype(np.int64)
        yield some, dim, form, raws, unpacked(form, raws, dim), codes


def searched(x: np.ndarray, codes: np.ndarray, books: list[Codebook], ends: list[int]):
    """Codes and errors of whole vectors, each part starting at its entry of the round before."""
    found = [book.nearest(x[:, a:b], codes[:, p]) for p, (book, a, b) in enumerate(zip(books, ends, ends[1:], strict=False))]
    return np.stack([f[0] for f in found], 1), sum(f[1].astype(object) for f in found)


def one_round(rows: DataFrame, books: dict[int, list[np.ndarray]], parts: int) -> DataFrame:
    """``rows`` with their new codes, and behind each task's rows the sums of the parts of each entry."""

    def assign(batches):
        ready = {dim: [Codebook(b) for b in each] for dim, each in books.items()}
        counts: dict[tuple[int, int, int], int] = {}
        totals: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            for some, dim, form, raws, x, codes in groups(batch, parts):
                ends = bounds(dim, parts)
                at, _ = searched(x, codes, ready[dim], ends)
                for p, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    for e in np.unique(at[:, p]).tolist():
                        held = x[at[:, p] == e, a:b]
                        key = (dim, p, e)
                        counts[key] = counts.get(key, 0) + len(held)
                        totals[key] = [s + int(t) for s, t in zip(totals.get(key, [0] * (b - a)), held.sum(0), strict=True)]
                yield state(some, dim, form, raws, [bytes(r) for r in at.astype(np.uint8)])
        keys = sorted(counts)
        cols = [pa.array([None] * len(keys), t) for t in (pa.int64(), pa.string())] + [pa.array([k[0] for k in keys], pa.int32())]
        cols += [pa.array([None] * len(keys), t) for t in (pa.string(), pa.binary(), pa.binary())] + [pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)]
        cols += [pa.array([counts[k] for k in keys], pa.int64()), pa.array([list(map(str, totals[k])) for k in keys], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in STATE.split(", ")])

    return rows.mapInArrow(assign, STATE)


def added_up(rows: DataFrame) -> list:
    """(dim, part, entry, n, sums as text): the tasks' sums, added in Python integers of any size."""

    def add(key, pdf):
        import pandas as pd

        sums = [0] * len(pdf["sums"].iloc[0])
        for row in pdf["sums"]:
            sums = [a + int(b) for a, b in zip(sums, row, strict=True)]
        return pd.DataFrame([(*key, int(pdf["n"].sum()), list(map(str, sums)))], columns=["dim", "part", "entry", "n", "sums"])

    tasks = rows.filter("part is not null").select("dim", "part", "entry", "n", "sums")
    return tasks.groupBy("dim", "part", "entry").applyInPandas(add, "dim int, part int, entry int, n long, sums array<string>").collect()


def fitted(rows: DataFrame, scratch: Scratch, parts: int, entries: int, rounds: int) -> tuple[dict[int, list[np.ndarray]], DataFrame]:
    """Codebooks [entry, position] by vector length and part, and the table of ``rows`` with the codes and sums of the last round."""
    first = W.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "form", "ints")
    start = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= entries).select("dim", "k", "form", "ints")
    chosen: dict[int, list] = {}
    for r in sorted(start.collect(), key=lambda r: (r.dim, r.k)):
        chosen.setdefault(r.dim, []).append(unpacked(r.form, [bytes(r.ints)], r.dim)[0])
    books = {}
    for dim, held in chosen.items():
        x, ends = np.array([list(map(int, v)) for v in held], object).reshape(len(held), dim), bounds(dim, parts)
        books[dim] = [x[:, a:b] for a, b in zip(ends, ends[1:], strict=False)]
    for _ in range(rounds):
        after = scratch.keep(one_round(rows.filter("part is null"), books, parts), "round")
        for r in added_up(after):
            book = books[r.dim][r.part].copy()
            book[r.entry] = [int(s) // r.n for s in r.sums]
            books[r.dim][r.part] = book
        scratch.drop(rows)
        rows = after
    return books, rows


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each row of ``vectors`` whose vector is whole.

    Null vectors and those with null or non-finite components are left out; zero and empty ones are coded like
    others. Rows that repeat an id are coded each; a null id is the last to start a codebook, and rows of one id
    start it in order of their integers. Fewer rows than ``entries`` make as many entries. Vectors of
    another length are a table of their own, with their own codebooks; a length that ``parts`` doesn't divide
    has longer parts first. Null labels are one label. Components of any finite size are exact; an error beyond
    a long is the greatest long. Only vec_id, embedding and the label are read; an empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    books, rows = fitted(scratch.keep(integers(vectors, label), "integers"), scratch, parts, entries, rounds)
    digests = {dim: digest(each) for dim, each in books.items()}

    def code(batches):
        ready = {dim: [Codebook(b) for b in each] for dim, each in books.items()}
        for batch in batches:
            for some, dim, _, raws, x, codes in groups(batch, parts):
                at, error = searched(x, codes, ready[dim], bounds(dim, parts))
                cols = [some.column(0), some.column(1), pa.array([bytes(r).hex() for r in at.astype(np.uint8)]), pa.array([min(int(e), LONGEST) for e in error], pa.int64()), pa.array([digests[dim]] * len(raws))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    coded = scratch.keep(rows.filter("part is null").mapInArrow(code, "vec_id long, label string, code string, error long, codebooks_sha256 string"), "coded")
    scratch.drop(rows)
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = scratch.keep(sums.select(F.col("label").alias("of"), "label_error"), "sums")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
