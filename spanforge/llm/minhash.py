"""MinHash near-dedup (1): circulant MinHash, banding, exact Jaccard verification, components.

Two permutations of the 64-bit shingle space are drawn. The first scatters the shingles; the second is
shifted circularly, a step further for each coordinate of the signature, so that the two make all
coordinates. Bands of coordinates put documents into buckets. Documents with equal shingle sets are one
node; in each bucket every node is held against the bucket's lead, the node that shares most buckets with
others, which joins groups of copies with a linear number of pairs. That comparison also leaves a sketch of
the shingles in which the node differs from the lead. Nodes that share a bucket and are still apart are
paired with each other unless their sketches prove that the two sets differ in too many shingles; the
proof is exact, so that no link is lost. Every link rests on the full sets.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, Scratch, columns_once, numbered, pieces, position, table
from .components import components

WORDS = 5
#: Linked from this many hundredths of the union on.
PERCENT = 75
BANDS, ROWS = 24, 3
#: Pairs of one leading node that go to one group.
GROUP_PAIRS = 256
#: Members of a bucket that are held against each other in one task.
BUCKET = 2048
#: 64-bit words of a sketch of differences.
SKETCH = 16

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_STEP = 0x9E3779B97F4A7C15
_CHUNK = 1 << 15


def permute(x: np.ndarray) -> np.ndarray:
    """The first permutation: a bijection of the unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text; one for fewer words than a shingle has, none without words."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(w) - words + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(words):
            total = (total + w[k : k + n]) * np.uint64(_STEP + 2 * k)
    return np.unique(permute(total))


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys [document, band] of non-empty sets."""
    out = np.empty((len(sets), bands), np.uint64)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (n == 0 or n + len(sets[last]) <= _CHUNK):
            n += len(sets[last])
            last += 1
        x = permute(np.concatenate(sets[first:last]) ^ _M3)
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        y, z = np.empty_like(x), np.empty_like(x)
        for b in range(bands):
            key = np.full(last - first, b + 1, np.uint64)
            for r in range(rows):
                with np.errstate(over="ignore"):
                    np.add(x, np.uint64(((b * rows + r) * _STEP) % (1 << 64)), out=y)  # the circular shift
                    np.right_shift(y, np.uint64(31), out=z)
                    np.bitwise_xor(y, z, out=y)
                    np.multiply(y, _M3, out=y)
                    key = permute(key * _M1 + np.minimum.reduceat(y, starts))
            out[first:last, b] = key
        first = last
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


SIGNED = "doc_id long, text_hash long, n_shingles long, fp binary, bands array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fp, bands): fp is equal for equal shingle sets, null for empty ones."""

    def sign(batches):
        for batch in pieces(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = iter(signatures([sets[i] for i in some]).view(np.int64).tolist())
            bands = [next(keys) if len(s) else None for s in sets]
            cols = [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "fp", "bands"])

    slim = columns_once(docs, "doc_id", "text")
    return slim.select(slim.doc_id.cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, SIGNED)


def sketch(differing: np.ndarray) -> list[int]:
    """A bit for each differing shingle, so that the union of two sketches has no more bits than the union of the two differences has shingles."""
    bits = np.zeros(SKETCH * 64, bool)
    bits[(differing % np.uint64(SKETCH * 64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, linked, differ, words): whether the full sets of each of ``pairs`` reach the similarity, in how many shingles they differ, and a sketch of those.

    The sets of the nodes in question are computed once more from their texts and sent to groups of
    pairs that share ``a``; a group's task reads a's set first and then one set at a time.
    """
    spark = docs.sparkSession
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(GROUP_PAIRS)).cast("int").alias("salts"))
    # Only leads of more than one group need a number of salts; the pairs of a frequent lead are not gathered for it.
    heavy = scratch.keep(per.filter("salts > 1"), "heavy")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy
    salted = pairs.join(heavy, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int"))
    firsts = per.select(F.col("a").alias("fp"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("later"))
    sends = scratch.keep(salted.select(F.col("b").alias("fp"), "a", "salt", F.lit(1).alias("later")).union(firsts), "sends")
    few = sends.count() <= BROADCAST_ROWS
    asked = sends.select("fp").distinct().join(nodes.select("fp", F.col("pick.doc_id").alias("pick_id"), F.col("pick.text_hash").alias("pick_hash")), "fp")
    asked = scratch.keep(asked.select("pick_id", "pick_hash"), "asked")
    slim = columns_once(docs, "doc_id", "text")
    slim = slim.select(slim.doc_id.cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    chosen = slim.join(F.broadcast(asked) if few else asked, slim.doc_id.eqNullSafe(asked.pick_id) & (slim.text_hash == asked.pick_hash), "left_semi")

    def sets(batches):
        for batch in pieces(batches):
            found = [shingle_set(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["fp", "shingles"])

    held = chosen.select("text").mapInArrow(sets, "fp binary, shingles binary")
    sent = held.join(F.broadcast(sends) if few else sends, "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.select("a", "salt", "later", "fp", "shingles").repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "later", "fp")

    def compare(batches):
        lead, at = None, None
        for batch in batches:
            out = []
            for a, salt, later, fp, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s = np.frombuffer(raw, np.uint64)
                if not later:
                    lead, at = s, (a, salt)
                    continue
                assert at == (a, salt), "a group of pairs has lost its first set"
                differing = np.setxor1d(s, lead, assume_unique=True)
                both = len(s) + len(lead)  # less the difference it is twice the intersection, plus it twice the union
                out.append((a, fp, 100 * (both - len(differing)) >= PERCENT * (both + len(differing)), len(differing), sketch(differing)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["a", "b", "linked", "differ", "words"])

    links = scratch.keep(dealt.mapInArrow(compare, "a binary, b binary, linked boolean, differ long, words array<long>").dropDuplicates(["a", "b"]), "links")
    scratch.drop(sends, asked)
    return links


def near(a: str, b: str):
    """Sizes that let two sets reach the similarity."""
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def minhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Rows with equal shingle sets, repeated rows among them, are linked. Null, empty and blank texts have
    no shingles and no links: their component is their own id. A row with a null id takes its group's
    smallest id and isn't kept; a group with no id at all has a null component. Only doc_id and text are
    read; an empty table gives an empty result.
    """
    return grouped(docs).drop("text_hash")


def grouped(docs: DataFrame) -> DataFrame:
    """The same with text_hash, which with doc_id tells rows apart."""
    scratch = Scratch(docs.sparkSession, "minhash")
    slim = scratch.keep(signed(docs), "signed")
    nodes = slim.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.max(F.struct("doc_id", "text_hash")).alias("pick"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = scratch.keep(nodes, "nodes")
    buckets = nodes.select("fp", "n", F.posexplode("bands").alias("band", "key")).select("fp", "n", F.xxhash64("band", "key").alias("bucket"))
    shared = scratch.keep(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "bucket"), "shared")
    met = shared.groupBy("fp").agg(F.sum("m").alias("met"))
    leads = shared.join(met, "fp").groupBy("bucket").agg(F.max(F.struct("met", "fp", "n")).alias("lead"))
    members = scratch.keep(shared.drop("m").join(leads, "bucket"), "members")
    # Nodes whose size alone rules a link out are compared as well: without a sketch nothing would part them from their bucket.
    stars = members.filter(F.col("fp") != F.col("lead.fp")).select(F.col("lead.fp").alias("a"), F.col("fp").alias("b")).distinct()
    stars = scratch.keep(stars, "stars")
    compared = verified(stars, nodes, docs, scratch)
    links = compared.filter("linked").select("a", "b")
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)

    placed = members.select("bucket", "fp", "n", F.col("lead.fp").alias("a")).join(roots, F.col("fp") == F.col("node"), "left").select("bucket", "fp", "n", "a", F.coalesce("root", "fp").alias("root"))
    # Members are counted by root first, so that a bucket's own row is made from few.
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    split = sizes.groupBy("bucket").agg(F.count("*").alias("roots"), F.max(F.struct("m", "root")).alias("most"), F.ceil(F.sum("m") / F.lit(BUCKET)).cast("int").alias("salts"))
    split = split.filter("roots > 1").select("bucket", F.col("most.root").alias("main"), "salts")
    words = [F.coalesce(F.col("words")[k], F.when(F.col("fp") == F.col("a"), F.lit(0))).alias(f"w{k}") for k in range(SKETCH)]
    differ = F.coalesce("differ", F.when(F.col("fp") == F.col("a"), F.lit(0))).alias("differ")
    sketched = compared.select("a", F.col("b").alias("fp"), "differ", "words")
    apart = scratch.keep(placed.join(split, "bucket").join(sketched, ["a", "fp"], "left").select("bucket", "fp", "n", "root", "main", "salts", differ, *words), "apart")
    # A large bucket's members are dealt to several tasks, each of which holds the members outside the main root against its share.
    x = apart.filter("root <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("x")
    y = apart.withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")).alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.fp") < F.col("y.fp"))
    union = sum((F.bit_count(F.col(f"x.w{k}").bitwiseOR(F.col(f"y.w{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("x.w0").bitwiseOR(F.col("y.w0"))))
    # Two sets differ in no fewer shingles than that; sets of a and b shingles are linked if (a + b) (100 - PERCENT) >= difference (100 + PERCENT).
    least = 2 * union - F.col("x.differ") - F.col("y.differ")
    may = F.coalesce((100 + PERCENT) * least <= (100 - PERCENT) * (F.col("x.n") + F.col("y.n")), F.lit(True))
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.root") != F.col("y.root")) & once & near("x.n", "y.n") & may)
    rest = rest.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.keep(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = verified(rest, nodes, docs, scratch).filter("linked").select("a", "b")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    scratch.drop(shared, members, apart)
    named = nodes.select("fp", "least_id").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = scratch.keep(named.join(ids, "root").select("fp", "component_id"), "of")
    out = slim.select("doc_id", "text_hash", "n_shingles", "fp").join(of, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document, that of the smallest doc_id, of each group; rows without words all stay. Columns as in ``docs``.

    Rows that repeat that document's id and text stay with it. A group with no id at all stays whole.
    """
    found = grouped(docs)
    gone = found.filter(~F.col("kept") & F.col("component_id").isNotNull()).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    gone = Scratch(docs.sparkSession, "keep-one").keep(gone, "gone")
    few = gone.count() <= BROADCAST_ROWS
    plain = numbered(docs)
    doc_id, text = (F.col(f"c{position(docs, n)}") for n in ("doc_id", "text"))
    same = doc_id.cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(text) == F.col("gone_hash"))
    return plain.join(F.broadcast(gone) if few else gone, same, "left_anti").toDF(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))
