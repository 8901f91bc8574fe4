"""Approximate nearest neighbours (8): balanced posting lists with replicated boundary vectors.

The largest inner product is turned into the nearest point by one more coordinate that gives all vectors
the same length. Centroids are fitted on a bounded sample with a penalty on large clusters; every vector
is indexed. A vector near the border between clusters goes to several lists. Queries find lists through
a small-world graph over the centroids, held in memory, and keep those whose distance is within a ratio of
the nearest. Some queries are first held against all vectors; the numbers of lists and the ratio are widened
until the lists hold enough of their true neighbours. Lists that grow large are cut into parts, which are
scanned separately; parts are dealt to tasks that each answer a query once.
"""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import Scratch, columns_once, table
from .hnsw import Graph
from .vectors import dots, matrix, valid_vectors

TOP = 20
#: Vectors that centroids are fitted on at most, vectors a list aims at, and lists at most.
SAMPLE, LIST, LISTS = 32768, 128, 4096
#: Lists that a vector may lie in, and how much farther than the nearest centroid theirs may be (squared distances).
REPLICAS, REPLICA_RATIO = 4, 1.2
#: Lists that a query reads at most, and how much farther than the nearest theirs may be (squared distances).
PROBES, PROBE_RATIO = 32, 3.0
#: Vectors and queries of a part of a list on average.
PART = 4096
#: Members of lists that lie together in one task on average; a task answers a query once for all its lists.
BIN = 16384
#: Queries that a task answers at a time.
ASKED = 256
#: Queries that come to a bin in one task; a bin's members go to as many tasks as its queries need.
ASKS = 16_384
ROUNDS = 10
#: Queries that the audit holds against all vectors, and the share of their true neighbours that the lists must give.
AUDIT, RECALL = 64, 0.93


def balanced_centroids(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """k-means whose distances grow with the size a cluster had in the round before."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    penalty = np.zeros(len(c))
    for _ in range(rounds):
        own = np.empty(len(x), np.int64)
        near = np.empty(len(x))
        for a in range(0, len(x), 4096):
            d = (c**2).sum(1) - 2 * x[a : a + 4096] @ c.T + penalty
            own[a : a + 4096] = d.argmin(1)
            near[a : a + 4096] = d.min(1)
        size = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        filled = size > 0
        c[filled] = total[filled] / size[filled, None]
        if (~filled).any():
            c[~filled] = x[np.argsort(-near)[: (~filled).sum()]]
        spread = max(1e-12, float(np.mean((x - c[own]) ** 2) * x.shape[1]))
        penalty = spread * 0.5 * np.log(np.maximum(size, 1) / (len(x) / len(c)))
    return c


class Lists:
    """Centroids and the graph over them."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.graph = Graph(centroids, 0.5 * (centroids**2).sum(1))

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(list, squared distance) of the ``k`` nearest centroids found, nearest first; -1 where fewer."""
        k = min(k, len(self.c))
        ids = self.graph.search(x, max(2 * k, 32))[0][:, :k]
        d = ((self.c[ids] - x[:, None, :]) ** 2).sum(2)
        d[ids < 0] = np.inf
        return ids, d

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists for each vector: the nearest, and others within the ratio unless a chosen centroid is nearer to theirs than the vector is."""
        ids, d = self.nearest(x, REPLICAS * 2)
        out = []
        for row, dist in zip(ids, d, strict=True):
            chosen = [row[0]]
            for i, far in zip(row[1:], dist[1:], strict=True):
                if len(chosen) == REPLICAS or far > dist[0] * REPLICA_RATIO:
                    break
                if all(((self.c[i] - self.c[j]) ** 2).sum() > far for j in chosen):
                    chosen.append(i)
            out.append(np.array(chosen))
        return out


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x**2).sum(1)))[:, None]], 1)


def slack(score: np.ndarray) -> np.ndarray:
    """A little under a score, so that rounding loses no equal."""
    return score - 1e-9 * np.where(np.isfinite(score), np.abs(score), 0) - 1e-12


def exact_top(asking: list, top: int):
    """For mapInArrow over (fp, vec): each batch's best ``top`` classes for each of ``asking``, (fp, vec) pairs."""

    def run(batches):
        q, own = matrix(v for _, v in asking), [f for f, _ in asking]
        for b in batches:
            x, fps = matrix(b.column(1).to_pylist()), b.column(0)
            s = q @ x.T
            take = min(len(x), top)
            at = np.argpartition(-s, take - 1, axis=1)[:, :take]
            r = np.repeat(np.arange(len(q)), take)
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in r], pa.binary()), fps.take(pa.array(at.ravel())), pa.array(dots(q[r], x[at.ravel()]))], ["q", "fp", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, is_query, top: int = TOP, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score, audit_recall): for each row that meets ``is_query`` the rows of largest inner product, itself excepted.

    Vectors are compared with those of their length. Null, empty, zero and non-finite vectors and null ids
    take no part. Equal vectors are searched once and the smaller ids come first. A query for which the
    lists give too few is searched in all of them. Repeated rows of an id are one. audit_recall is the share
    of the audited queries' true neighbours that the lists gave. Other columns are not read; no queries or no
    vectors give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    slim = columns_once(vectors, "vec_id", "embedding")
    rows = scratch.keep(valid_vectors(slim).filter("vec_id is not null").dropDuplicates(["vec_id", "fp"]), "rows")
    dims = [r["dim"] for r in rows.filter(is_query).select("dim").distinct().orderBy("dim").collect()]
    found = [_of_one_length(rows.filter(F.col("dim") == d), is_query, top, probes, scratch) for d in dims]
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, audit_recall double")
    return reduce(DataFrame.unionByName, found) if found else none


def _of_one_length(rows: DataFrame, is_query, top: int, probes: int, scratch: Scratch) -> DataFrame:
    spark = rows.sparkSession
    # The first ids of a class are all that any query can want of it, and one more for its own.
    ids = rows.select("fp", "vec_id").withColumn("nth", F.row_number().over(W.partitionBy("fp").orderBy("vec_id"))).filter(F.col("nth") <= top + 1).select("fp", "vec_id")
    ids = scratch.keep(ids, "ids")
    classes = scratch.keep(rows.groupBy("fp").agg(F.first("vec").alias("vec")).withColumn("h", F.xxhash64("fp")), "classes")
    n = classes.count()
    # A bounded sample by hash: its share is such that the bound is met on average.
    share = min(1.0, SAMPLE / n)
    sample = classes.filter(F.col("h") <= F.lit(int(share * 2.0**64 - 2.0**63) if share < 1 else (1 << 63) - 1)).select("fp", "vec").limit(2 * SAMPLE).collect()
    sample.sort(key=lambda r: bytes(r["fp"]))

    def longest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float((matrix(b.column(0).to_pylist()) ** 2).sum(1).max(initial=0))])], ["most"])

    most = classes.select("vec").mapInArrow(longest, "most double").agg(F.max("most")).first()[0]
    k = int(max(1, min(LISTS, n // LIST, len(sample) // 8)))
    # The graph over the centroids is built once; tasks get it whole.
    shared = spark.sparkContext.broadcast(Lists(balanced_centroids(lifted(matrix(bytes(r["vec"]) for r in sample), most), k)))

    def post(batches):
        index = shared.value
        for b in batches:
            raws = b.column(1).to_pylist()
            homes = index.homes(lifted(matrix(raws), most))
            at = np.repeat(np.arange(len(raws)), [len(x) for x in homes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(homes).astype("int32") if homes else [], pa.int32()), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["list", "fp", "vec"])

    posts = scratch.keep(classes.select("fp", "vec").mapInArrow(post, "list int, fp binary, vec binary"), "posts")
    # A row for each list, of which there are a bounded number.
    sizes = {r["list"]: r["n"] for r in posts.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = np.array([-(-sizes.get(i, 0) // PART) for i in range(k)])
    bins = max(1, -(-sum(sizes.values()) // BIN))
    many = F.element_at(F.array(*[F.lit(int(max(1, x))) for x in parts]), F.col("list") + 1)
    slot = F.col("list") + F.pmod(F.xxhash64("fp"), many).cast("int") * k  # the list and the part of it
    posted = posts.withColumn("slot", slot).withColumn("bin", F.col("slot") % bins)
    queries = scratch.keep(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "fp"), "queries")
    asking = queries.select("fp").distinct().join(classes, "fp").select("fp", "vec")

    def probe(limit: int, ratio: float | None):
        """A row for each query and bin, with the slots to read there."""

        def run(batches):
            index = shared.value
            for b in batches:
                x = matrix(b.column(1).to_pylist())
                if ratio is None and limit >= k:  # every list, whether the graph leads to it or not
                    ids, d = np.tile(np.arange(k), (len(x), 1)), np.zeros((len(x), k))
                else:
                    ids, d = index.nearest(np.concatenate([x, np.zeros((len(x), 1))], 1), limit)
                at, col = np.nonzero((ids >= 0) & (ratio is None or d <= d[:, :1] * ratio))
                lists = ids[at, col]
                at, lists = np.repeat(at, parts[lists]), np.repeat(lists, parts[lists])
                # The parts of a list follow one another; a part's number is its place among them.
                new = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(lists, prepend=-1))
                part = np.arange(len(at)) - np.repeat(new, np.diff(new, append=len(at)))
                slots = lists + part * k
                order = np.lexsort((slots, slots % bins, at))
                at, slots = at[order], slots[order]
                first = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(slots % bins, prepend=-1))
                some = pa.array(at[first])
                read = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype("int32")), pa.array(slots.astype("int32")))
                yield pa.RecordBatch.from_arrays([pa.array((slots[first] % bins).astype("int32")), read, b.column(0).take(some), b.column(1).take(some)], ["bin", "slots", "fp", "vec"])

        return run

    def scan(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The best of a bin for each query: candidates of every slot, then the first of them over all slots."""
        none = pd.DataFrame({"q": [], "fp": [], "score": []})
        if not len(members) or not len(asked):
            return none
        x, q = matrix(members["vec"]), matrix(asked["vec"])
        fps, own = members["fp"].to_numpy(), asked["fp"].to_numpy()
        same = np.unique(fps, return_inverse=True)[1]  # a replica is the same vector
        here = {s: np.asarray(i) for s, i in members.groupby("slot").indices.items()}
        slots = [np.asarray(s) for s in asked["slots"]]
        out = []
        for a in range(0, len(q), ASKED):
            some = slots[a : a + ASKED]
            row, slot = np.repeat(np.arange(a, a + len(some)), [len(s) for s in some]), np.concatenate(some)
            order = np.argsort(slot, kind="stable")
            cuts = np.flatnonzero(np.diff(slot[order], prepend=-1))
            ask, found, near = [], [], []
            for rows in np.split(order, cuts[1:]):
                one = here.get(int(slot[rows[0]]))
                if one is None:
                    continue
                s = q[row[rows]] @ x[one].T
                take = min(len(one), top + 1)
                kth = -np.partition(-s, take - 1, axis=1)[:, take - 1]
                r, c = np.nonzero(s >= slack(kth)[:, None])
                ask.append(row[rows[r]])
                found.append(one[c])
                near.append(s[r, c])
            if not ask:
                continue
            ask, found, near = np.concatenate(ask), np.concatenate(found), np.concatenate(near)
            first = np.unique(ask * np.int64(len(fps)) + same[found], return_index=True)[1]
            ask, found = best(ask[first], found[first], near[first])
            exact = dots(q[ask], x[found])
            out.append(pd.DataFrame({"q": own[ask], "fp": fps[found], "score": exact}))
        return pd.concat(out) if out else none

    def best(ask: np.ndarray, found: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of each query that may be among its first; near equals of the last stay, for exact scores and ids to decide."""
        order = np.lexsort((-near, ask))
        ask, found, near = ask[order], found[order], near[order]
        first = np.flatnonzero(np.diff(ask, prepend=-1))
        group = np.repeat(np.arange(len(first)), np.diff(first, append=len(ask)))
        last = np.full(len(first), -np.inf)
        at = np.arange(len(ask)) - first[group] == top
        last[group[at]] = near[at]
        keep = near >= slack(last)[group]
        return ask[keep], found[keep]

    def search(asking: DataFrame, limit: int, ratio: float | None) -> DataFrame:
        salts = max(1, -(-asking.count() // ASKS))
        asked = asking.mapInArrow(probe(limit, ratio), "bin int, slots array<int>, fp binary, vec binary").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int"))
        held = posted.select("bin", "slot", "fp", "vec", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        hits = held.groupBy("bin", "salt").cogroup(asked.groupBy("bin", "salt")).applyInPandas(scan, "q binary, fp binary, score double")
        best = hits.dropDuplicates(["q", "fp"]).join(ids, "fp")
        return best.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top + 1).select("q", "vec_id", "score")

    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    audited = [(bytes(r["fp"]), bytes(r["vec"])) for r in asking.orderBy(F.xxhash64(F.lit("audit"), "fp")).limit(AUDIT).collect()]
    truth = classes.select("fp", "vec").mapInArrow(exact_top(audited, top + 1), "q binary, fp binary, score double")
    # A query's own vector is no neighbour of it.
    truth = truth.filter("q <> fp").withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "fp"))).filter(F.col("nth") <= top).select("q", "fp")
    # The lists of the audited queries' true neighbours tell the recall of any number of lists and any ratio.
    where = posts.join(F.broadcast(truth), "fp").groupBy("q", "fp").agg(F.collect_set("list").alias("lists")).collect()
    near, d = shared.value.nearest(np.concatenate([matrix(v for _, v in audited), np.zeros((len(audited), 1))], 1), k) if audited else (np.zeros((0, 1)), np.zeros((0, 1)))
    at = {f: i for i, (f, _) in enumerate(audited)}
    ratio: float | None = PROBE_RATIO
    while True:
        read = [set(n[:probes][(m[:probes] <= m[0] * ratio) if ratio is not None else slice(None)].tolist()) for n, m in zip(near, d, strict=True)]
        recall = float(np.mean([not read[at[bytes(r["q"])]].isdisjoint(r["lists"]) for r in where])) if where else 1.0
        if recall >= RECALL or (probes >= k and ratio is None):
            break
        # Half as many lists again and twice the ratio, up to every list.
        probes, ratio = min(k, probes + probes // 2 + 1), None if probes + probes // 2 + 1 >= k else 2 * ratio
    found = scratch.keep(search(asking, probes, ratio), "found")
    enough = min(top + 1, ids.limit(top + 1).count())
    full = found.groupBy("q").count().filter(F.col("count") >= enough).select(F.col("q").alias("fp"))
    short = scratch.keep(asking.join(full, "fp", "left_anti"), "short")
    if not short.isEmpty():
        again = scratch.keep(search(short, k, None), "again")
        found = found.join(short.select(F.col("fp").alias("q")), "q", "left_anti").unionByName(again)
    scratch.drop(posts)
    pairs = queries.join(found, F.col("fp") == F.col("q")).filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return pairs.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score", F.lit(recall).alias("audit_recall")).filter(F.col("rank") <= top)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
