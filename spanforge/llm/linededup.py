"""Line dedup (2): sharded cuckoo filters backed by exact reference-count tables.

The reference counts say, for each line key, how many documents hold it. Keys that reach the limit sit
in the cuckoo filter of their shard; a filter takes deletions, so documents can leave again and a key
that falls below the limit stops being dropped. The scan that rewrites texts probes the filters. Since
every key is in the exact table, the few keys that a filter reports wrongly are found beforehand by
probing it with the whole table, and the scan excepts them: its result is exact. Filters of a bounded size
go to every task; beyond it, lines go to the filter of their shard. Insertions and deletions add short
tables of changes to the counts, and read only the keys that change.
"""

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, Scratch, columns_once, numbered, pieces, position, table

MIN_CHARS = 1
MIN_DOCS = 10
#: Keys of a shard's filter on average, and bytes of filters and exceptions up to which tasks get them whole.
SHARD_KEYS = 50_000
BROADCAST_BYTES = 64 << 20
#: Lines of a shard that go to one task on average, where lines go to filters, and tables of changes that are summed up into one.
SHARD_LINES, CHANGES = 4_000_000, 8

SLOTS = 4
KICKS = 500
_ODD = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    """The white space of `[\\x20\\x09-\\x0D]` off both ends, A-Z in lower case; other letters stay as they are."""
    return line.strip().lower()


def key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


class CuckooFilter:
    """Fingerprints of 32 bits, four to a bucket; a key's second bucket follows from its first and its fingerprint."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> "CuckooFilter":
        return cls(np.zeros((1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85))))), SLOTS), np.uint32))

    def _places(self, k1: np.ndarray, k2: np.ndarray):
        prints = (k2.view(np.uint64) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        first = (k1.view(np.uint64) & self.mask).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, place, prints):
        with np.errstate(over="ignore"):
            return (place.astype(np.uint64) ^ ((prints.astype(np.uint64) * _ODD) >> np.uint64(20)) & self.mask).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(k1, k2)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if a key found no room; the caller then builds a larger filter."""
        for p, a, b in zip(*self._places(k1, k2), strict=True):
            for place in (a, b):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = p
                    break
            else:
                place = b
                for kick in range(KICKS):
                    slot = (int(p) + kick) % SLOTS
                    p, self.table[place, slot] = self.table[place, slot], p
                    place = int(self._other(np.array([place]), np.array([p], np.uint32))[0])
                    free = np.flatnonzero(self.table[place] == 0)
                    if len(free):
                        self.table[place, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for p, a, b in zip(*self._places(k1, k2), strict=True):
            for place in (a, b):
                hit = np.flatnonzero(self.table[place] == p)
                if len(hit):
                    self.table[place, hit[0]] = 0
                    break


def build_filter(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    room = len(k1)
    while True:
        f = CuckooFilter.sized(room)
        if f.insert(k1, k2):
            return f
        room *= 2


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def reference_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, n_docs): the rows of ``docs`` that hold each line key at least once."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            k1, k2 = _halves(list(seen))
            return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(list(seen.values()), pa.int64())], ["k1", "k2", "n"])

        for batch in pieces(batches):
            for text in batch.column(0):
                keys = {k for k in map(line_key, (text.as_py() or "").encode().split(b"\n")) if long_enough(k, min_chars)}
                seen.update(map(key_hash, keys))
            if len(seen) > 200_000:  # what a task holds is bounded; the sum over tasks is Spark's
                yield out()
                seen.clear()
        if seen:
            yield out()

    partial = columns_once(docs, "text").mapInArrow(count, "k1 long, k2 long, n long")
    return partial.groupBy("k1", "k2").agg(F.sum("n").alias("n_docs"))


def summed(tables: list[DataFrame], keep: bool = False) -> DataFrame:
    """(k1, k2, n_docs) summed over ``tables``; keys that no document holds any more are left out unless ``keep``."""
    both = reduce(DataFrame.unionByName, tables).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"))
    return both if keep else both.filter("n_docs > 0")


def build_filters(dropped: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) over the keys (k1, k2) of ``dropped``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = build_filter(pdf["k1"].to_numpy("int64"), pdf["k2"].to_numpy("int64"))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [f.table.tobytes()]})

    return dropped.withColumn("shard", shard_of(shards)).groupBy("shard").applyInPandas(build, "shard long, filter binary")


def shard_of(shards: int):
    return F.pmod(F.shiftrightunsigned("k1", 40), F.lit(shards)).cast("long")


class Probe:
    """Every shard's filter, for keys of any shard."""

    def __init__(self, filters: dict[int, bytes], shards: int, wrong: frozenset = frozenset()):
        self.filters = {s: CuckooFilter(np.frombuffer(b, np.uint32).reshape(-1, SLOTS)) for s, b in filters.items()}
        self.shards, self.wrong = shards, wrong

    def hits(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        shard = (k1.view(np.uint64) >> np.uint64(40)).astype(np.int64) % self.shards
        out = np.zeros(len(k1), bool)
        for s in np.unique(shard):
            if int(s) in self.filters:
                at = np.flatnonzero(shard == s)
                out[at] = self.filters[int(s)].contains(k1[at], k2[at])
        for i in np.flatnonzero(out) if self.wrong else ():
            out[i] = (int(k1[i]), int(k2[i])) not in self.wrong
        return out


class LineDedup:
    """The state of line dedup: exact counts and the filters of the keys at or over ``min_docs``.

    ``insert`` and ``delete`` take documents in and out; ``clean`` rewrites texts by the present state.
    """

    def __init__(self, tables: list[DataFrame], filters: DataFrame, shards: int, scratch: Scratch, min_docs: int, min_chars: int):
        """The counts are the sum of ``tables``: the first holds whole counts, the others changes."""
        self.tables, self.filters, self.shards, self.scratch, self.min_docs, self.min_chars = tables, filters, shards, scratch, min_docs, min_chars

    @property
    def counts(self) -> DataFrame:
        return self.tables[0] if len(self.tables) == 1 else summed(self.tables)

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> "LineDedup":
        scratch = Scratch(docs.sparkSession, "linededup")
        counts = scratch.keep(reference_counts(docs, min_chars), "counts")
        dropped = counts.filter(F.col("n_docs") >= min_docs)
        shards = max(1, -(-dropped.count() // SHARD_KEYS))
        return cls([counts], scratch.keep(build_filters(dropped, shards), "filters"), shards, scratch, min_docs, min_chars)

    def _change(self, docs: DataFrame, sign: int) -> "LineDedup":
        delta = self.scratch.keep(reference_counts(docs, self.min_chars).select("k1", "k2", (F.col("n_docs") * sign).alias("n_docs")), "change")
        keys = delta.select("k1", "k2")
        small = keys.count() <= BROADCAST_ROWS
        # Of the counts only the changed keys are summed; with few of them no table is shuffled whole.
        was = summed([t.join(F.broadcast(keys) if small else keys, ["k1", "k2"], "left_semi") for t in self.tables], keep=True).withColumnRenamed("n_docs", "was")
        both = delta.withColumnRenamed("n_docs", "change").join(was, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.col("change")).alias("n_docs"))
        crossing = both.filter((F.col("was") >= self.min_docs) != (F.col("n_docs") >= self.min_docs)).withColumn("shard", shard_of(self.shards))
        least = self.min_docs

        def update(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            shard = (old if len(old) else keys)["shard"].iloc[0]
            f = CuckooFilter(np.frombuffer(old["filter"].iloc[0], np.uint32).reshape(-1, SLOTS).copy()) if len(old) else CuckooFilter.sized(len(keys))
            arrays = lambda rows: (rows["k1"].to_numpy("int64"), rows["k2"].to_numpy("int64"))
            f.delete(*arrays(keys[keys["n_docs"] < least]))
            full = not f.insert(*arrays(keys[keys["n_docs"] >= least]))
            return pd.DataFrame({"shard": [shard], "filter": [None if full else f.table.tobytes()]})

        updated = self.scratch.keep(self.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInPandas(update, "shard long, filter binary"), "filters")
        tables = [*self.tables, delta]
        if len(tables) > CHANGES:
            tables = [self.scratch.keep(summed(tables), "counts")]
        new = LineDedup(tables, updated, self.shards, self.scratch, least, self.min_chars)
        if not updated.filter("filter is null").isEmpty():  # a filter is full: all are built anew from the exact counts
            dropped = new.counts.filter(F.col("n_docs") >= least)
            new.shards = max(1, -(-dropped.count() // SHARD_KEYS))
            new.filters = self.scratch.keep(build_filters(dropped, new.shards), "filters")
        return new

    def insert(self, docs: DataFrame) -> "LineDedup":
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> "LineDedup":
        """``docs`` must be in the state."""
        return self._change(docs, -1)

    def _probe(self):
        """A broadcast of the filters and their false hits, or None if they are over the size limit."""
        spark = self.counts.sparkSession
        held = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if held > BROADCAST_BYTES:
            return None
        shared, shards = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}), self.shards

        def wrongly(batches):
            probe = Probe(shared.value, shards)
            for batch in batches:
                hit = probe.hits(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield batch.filter(pa.array(hit))

        rare = self.counts.filter(F.col("n_docs") < self.min_docs).select("k1", "k2")
        wrong = rare.mapInArrow(wrongly, "k1 long, k2 long").take(BROADCAST_BYTES // 256 + 1)
        if len(wrong) > BROADCAST_BYTES // 256:
            return None
        return spark.sparkContext.broadcast((shared.value, frozenset((r["k1"], r["k2"]) for r in wrong)))

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with text rewritten and, after its columns, line_dedup_lines and line_dedup_dropped.

        Lines whose key is held by ``min_docs`` rows or more go; the others are joined by \\n. A null text
        counts as one empty line and becomes an empty text. Keys shorter than ``min_chars`` stay. All other
        columns stay as they are, whatever their names; no rows give no rows.
        """
        probe, shards, min_chars = self._probe(), self.shards, self.min_chars
        names, at = docs.columns, position(docs, "text")
        out = numbered(docs)
        out = out.withColumn("c_text", F.coalesce(F.col(f"c{at}"), F.lit("")))
        schema = ", ".join(f"c{i} {docs.schema[i].dataType.simpleString()}" for i in range(len(names))) + ", n_lines long, n_dropped long"
        out = out.drop(f"c{at}").withColumnRenamed("c_text", f"c{at}").select(*[f"c{i}" for i in range(len(names))])
        if probe is None:
            out = self._clean_by_shard(out, f"c{at}")
        else:

            def rewrite(batches):
                filters, wrong = probe.value
                known = Probe(filters, shards, wrong)
                for batch in pieces(batches):
                    lines = [t.as_py().encode().split(b"\n") for t in batch.column(at)]
                    keys = [line_key(x) for doc in lines for x in doc]
                    hashes = [key_hash(k) for k in keys]
                    drop = known.hits(*_halves(hashes)) if hashes else np.zeros(0, bool)
                    drop &= np.array([long_enough(k, min_chars) for k in keys], bool)
                    texts, n_lines, n_dropped, i = [], [], [], 0
                    for doc in lines:
                        gone = drop[i : i + len(doc)]
                        i += len(doc)
                        n_lines.append(len(doc))
                        n_dropped.append(int(gone.sum()))
                        texts.append((b"\n".join(x for x, g in zip(doc, gone, strict=True) if not g) if n_dropped[-1] else b"\n".join(doc)).decode())
                    cols = batch.columns
                    cols[at] = pa.array(texts, pa.string())
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*[f"c{i}" for i in range(len(cols))], "n_lines", "n_dropped"])

            out = out.mapInArrow(rewrite, schema)
        return out.toDF(*names, "line_dedup_lines", "line_dedup_dropped")

    def _clean_by_shard(self, docs: DataFrame, text: str) -> DataFrame:
        """Beyond the broadcast limit: lines go to the filter of their shard; dropped places meet texts by their hash.

        A task reads a shard's filter, then the rare keys of the shard, which show what the filter reports
        wrongly, then lines. A shard with many lines is dealt to several tasks, whatever its lines are.
        """
        min_chars, shards = self.min_chars, self.shards
        task = "shard long, salt int, kind int, filter binary, t1 long, t2 long, i long, k1 long, k2 long"

        def lines(batches):
            for batch in pieces(batches):
                rows = [(t1, t2, i, *np.frombuffer(key_hash(k), "<i8").tolist()) for t, t1, t2 in zip(*[c.to_pylist() for c in batch.columns], strict=True) for i, k in enumerate(map(line_key, t.encode().split(b"\n"))) if long_enough(k, min_chars)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["t1", "t2", "i", "k1", "k2"])

        def probe(batches):
            key, known, wrong = None, None, set()
            for batch in batches:
                table = pa.Table.from_batches([batch])
                shard, salt, kind = (batch.column(c).to_numpy() for c in ("shard", "salt", "kind"))
                ends = np.flatnonzero(np.diff(shard, append=-1) | np.diff(salt, append=-1) | np.diff(kind, append=-1)) + 1
                for first, last in zip([0, *ends[:-1]], ends, strict=True):
                    rows = table.slice(first, last - first)
                    if (shard[first], salt[first]) != key:
                        key, known, wrong = (shard[first], salt[first]), None, set()
                    if kind[first] == 0:
                        known = Probe({int(shard[first]): rows.column("filter")[0].as_py()}, shards)
                        continue
                    if known is None:  # no key of the shard is dropped
                        continue
                    k1, k2 = (rows.column(c).to_numpy() for c in ("k1", "k2"))
                    hit = rows.filter(pa.array(known.hits(k1, k2)))
                    if kind[first] == 1:
                        wrong |= set(zip(hit.column("k1").to_pylist(), hit.column("k2").to_pylist(), strict=True))
                    else:
                        right = [k not in wrong for k in zip(hit.column("k1").to_pylist(), hit.column("k2").to_pylist(), strict=True)]
                        yield from hit.filter(pa.array(right, pa.bool_())).select(["t1", "t2", "i"]).to_batches()

        named = docs.withColumns({"t1": F.xxhash64(F.col(text)), "t2": F.xxhash64(F.lit("two"), F.col(text))})
        distinct = named.groupBy("t1", "t2").agg(F.first(text).alias(text)).select(text, "t1", "t2")
        found = self.scratch.keep(distinct.mapInArrow(lines, "t1 long, t2 long, i long, k1 long, k2 long").withColumn("shard", shard_of(shards)), "lines")
        salts = found.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(SHARD_LINES)).cast("int").alias("salts"))
        each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        blank = lambda *names: [F.lit(None).cast("binary" if c == "filter" else "long").alias(c) for c in names]
        rare = self.counts.filter(F.col("n_docs") < self.min_docs).select("k1", "k2").withColumn("shard", shard_of(shards))
        parts = [
            self.filters.join(F.broadcast(salts), "shard").select("shard", each, F.lit(0).alias("kind"), "filter", *blank("t1", "t2", "i", "k1", "k2")),
            rare.join(F.broadcast(salts), "shard").select("shard", each, F.lit(1).alias("kind"), *blank("filter", "t1", "t2", "i"), "k1", "k2"),
            found.join(F.broadcast(salts), "shard").select("shard", F.pmod(F.xxhash64("t1", "t2", "i"), F.col("salts")).cast("int").alias("salt"), F.lit(2).alias("kind"), *blank("filter"), "t1", "t2", "i", "k1", "k2"),
        ]
        dealt = reduce(DataFrame.unionByName, parts).select(*[c.split()[0] for c in task.split(", ")])
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hits = dealt.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(probe, "t1 long, t2 long, i long")
        places = hits.groupBy("t1", "t2").agg(F.collect_set("i").alias("places"))
        joined = named.join(places, ["t1", "t2"], "left")
        parts = F.split(F.col(text), "\n", -1)
        none = F.array().cast("array<bigint>")
        gone = F.coalesce("places", none)
        kept = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))), lambda x: ~F.array_contains(gone, x["i"]))
        out = joined.withColumn("n_lines", F.size(parts).cast("long")).withColumn("n_dropped", F.size(gone).cast("long"))
        return out.withColumn(text, F.array_join(F.transform(kept, lambda x: x["x"]), "\n")).select(*docs.columns, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` of its rows or more share; see ``LineDedup.clean``.

    A row is a document: rows that repeat an id or a whole text count each. An empty table gives an empty one.
    """
    return LineDedup.build(docs, min_docs, min_chars).clean(docs)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_once(table(spark, sf_dir, "documents"), "doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("line_dedup_lines").alias("n_lines"), F.col("line_dedup_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))
