"""Embedding near-dedup (3): a small-world graph per shard, every shard queried, cosine verified, components united.

Equal vectors of a label are one class. A label's classes are dealt to shards of bounded size; each shard's
graph is a table of nodes. One task reads a shard's graph and then every class of the label, block by block,
so that queries travel and graphs do not. A query whose beam is full of links is searched again with a wider
one; one with more links than the widest beam holds is held against the whole shard. For each block an audit
scans the shard with some of the queries, and with probes made near to nodes of the shard, and all beams are
widened until none of their links is missed. Nodes that no walk through the graph reaches are held against
every query.
"""

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, table
from .components import components
from .hnsw import Graph
from .vectors import matrix, valid_vectors

COSINE = 0.93
#: Classes of a shard and of a block of queries on average.
SHARD, BLOCK = 8192, 2048
BEAM, WIDEST = 64, 1024
#: Queries, and probes made from nodes, that an audit of a block takes.
AUDIT = 64

NODE = "label string, dim int, shard int, pos int, fp binary, vec binary, members long, height int, links binary"
FOUND = "u binary, v binary, n long"
KEYS = ["label", "dim", "shard"]


def unit(raws) -> np.ndarray:
    x = matrix(raws)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("fp").reset_index(drop=True)
    g = Graph(unit(pdf["vec"]))
    links = [b"".join(level[i].astype("<i4").tobytes() for level in g.levels[: g.height[i] + 1]) for i in range(len(pdf))]
    return pdf.assign(pos=np.arange(len(pdf), dtype="int32"), height=g.height.astype("int32"), links=links)[["label", "dim", "shard", "pos", "fp", "vec", "members", "height", "links"]]


def load_shard(pdf: pd.DataFrame) -> tuple[Graph, np.ndarray]:
    x, height = unit(pdf["vec"]), pdf["height"].to_numpy()
    levels = []
    m = 16
    for k in range(int(height.max()) + 1):
        width = 2 * m if k == 0 else m
        links = np.full((len(pdf), width), -1, np.int32)
        start = 0 if k == 0 else 4 * (2 * m + (k - 1) * m)
        for i in np.flatnonzero(height >= k):
            links[i] = np.frombuffer(pdf["links"].iat[i], "<i4", width, start)
        levels.append(links)
    return Graph.load(x, np.zeros(len(x), np.float32), height, levels), x


def unreached(g: Graph) -> np.ndarray:
    """Nodes that no walk on the ground level reaches from the entry."""
    seen, edge = np.zeros(len(g.x) + 1, bool), g.order[:1]
    while len(edge):
        seen[edge] = True
        edge = np.unique(g.levels[0][edge])
        edge = edge[(edge >= 0) & ~seen[edge]]
    return np.flatnonzero(~seen[:-1])


def probes(x: np.ndarray, cosine: float, count: int = AUDIT) -> np.ndarray:
    """Queries of which each lies between ``cosine`` and 1 from a node of the shard."""
    rng = np.random.default_rng(1)
    some = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    aside = rng.normal(size=some.shape)
    aside -= (aside * some).sum(1, keepdims=True) * some
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    c = np.linspace(min(1.0, cosine + 1e-6), 1, len(some))[:, None]
    return c * some + np.sqrt(np.maximum(0, 1 - c**2)) * aside


def linked(g: Graph, x: np.ndarray, q: np.ndarray, cosine: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[list[np.ndarray], int]:
    """For each query the shard's nodes at or above ``cosine``, and the queries that beams answered.

    ``own`` holds the queries' own nodes, -1 where they have none here; no audit counts them.
    """
    own = np.full(len(q), -1) if own is None else own
    lost, answered = unreached(g), 0

    def scan(rows: np.ndarray) -> list[np.ndarray]:
        return [np.flatnonzero(s >= cosine) for k in range(0, len(rows), 512) for s in rows[k : k + 512] @ x.T]

    def beams(qs: np.ndarray, ef: int) -> list[np.ndarray]:
        nonlocal answered
        out, rows = [np.zeros(0, np.int64)] * len(qs), np.arange(len(qs))
        while len(rows) and ef <= WIDEST:
            ids, near = g.search(qs[rows], ef)
            full = (near[:, -1] >= cosine - 1e-4) & (len(x) > ef)
            for i, found, close in zip(rows[~full], ids[~full], near[~full], strict=True):
                some = np.union1d(found[close >= cosine - 1e-4], lost)
                out[i] = some[x[some] @ qs[i] >= cosine]
            answered += int((~full).sum())
            rows, ef = rows[full], ef * 4
        for i, hit in zip(rows, scan(qs[rows]), strict=True):
            out[i] = hit
        return out

    taken = np.random.default_rng(0).permutation(len(q))[:AUDIT]
    audit = np.concatenate([q[taken], probes(x, cosine)])
    selves = np.concatenate([own[taken], np.full(len(audit) - len(taken), -1)])
    truth = scan(audit)
    known = sum(int((t != o).sum()) for t, o in zip(truth, selves, strict=True))
    while beam <= WIDEST:
        if sum(int((np.intersect1d(t, f) != o).sum()) for t, f, o in zip(truth, beams(audit, beam), selves, strict=True)) >= known:
            answered = 0
            return beams(q, beam), answered
        beam *= 2
    return scan(q), 0


class Shard:
    """One shard's graph, queried block by block; links are told once a tree holds their ends."""

    def __init__(self, nodes: pd.DataFrame, cosine: float):
        nodes = nodes.sort_values("pos").reset_index(drop=True)
        self.g, self.x = load_shard(nodes)
        self.fps, self.members, self.cosine = nodes["fp"].to_numpy(), nodes["members"].to_numpy("int64"), cosine
        self.at, self.tree = {f: i for i, f in enumerate(self.fps)}, np.arange(len(nodes))

    def search(self, own: list[bytes], vecs: list[bytes]) -> tuple[list, list, list, int]:
        """Rows (u, null, n) for each query with the vectors that it is linked to here, rows (u, v) that span its links, and the queries that beams answered."""
        tree, fps, members, at = self.tree, self.fps, self.members, self.at
        found, answered = linked(self.g, self.x, unit(vecs), self.cosine, own=np.array([at.get(f, -1) for f in own]))
        u, v, n = [], [], []
        for f, hits in zip(own, found, strict=True):
            here = at.get(f)
            others = hits[hits != here] if here is not None else hits
            if not len(others):
                continue
            u.append(f)
            v.append(None)
            n.append(int(members[others].sum()))
            group = np.append(others, here) if here is not None else others
            roots = np.unique(tree[group])
            if len(roots) > 1:
                tree[np.isin(tree, roots)] = roots[0]
            if len(roots) > 1 or here is None:
                for r in roots:
                    u.append(f)
                    v.append(fps[r])
                    n.append(0)
        return u, v, n, answered


def stream(cosine: float, searched=None):
    """For mapInArrow over rows in order of KEYS and kind: a shard's nodes (kind 0), then its queries (kind 1)."""

    def run(batches):
        key, nodes, shard, own, vecs = None, [], None, [], []

        def answer(most: int = 0):
            nonlocal shard, own, vecs
            if shard is None and nodes:
                shard = Shard(pd.concat(nodes), cosine)
                nodes.clear()
            if shard is None:  # a shard that no class was dealt to
                own, vecs = [], []
            while len(own) > most:
                u, v, n, answered = shard.search(own[:BLOCK], vecs[:BLOCK])
                own, vecs = own[BLOCK:], vecs[BLOCK:]
                if searched is not None:
                    searched.add(answered)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], ["u", "v", "n"])

        for batch in batches:
            names, at = list(zip(*[batch.column(c).to_pylist() for c in (*KEYS, "kind")], strict=True)), 0
            for (*k, kind), part in groupby(names):
                rows = batch.slice(at, len(list(part)))
                at += rows.num_rows
                if k != key:
                    yield from answer()
                    key, shard = k, None
                    nodes.clear()
                if kind == 0:
                    nodes.append(rows.to_pandas())
                else:
                    own += rows.column("fp").to_pylist()
                    vecs += rows.column("vec").to_pylist()
                    yield from answer(BLOCK - 1)
        yield from answer()

    return run


def embedding_components(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD, searched=None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors`` (vec_id, embedding, label).

    Only vectors of one label and length are compared. A row whose label is null, or whose vector is null,
    empty, zero or holds null or non-finite components, has no links and is its own component. Repeated rows
    are linked to each other. A row with a null id has its group's smallest id and isn't kept. Other columns
    are not read; an empty table gives an empty result. An accumulator ``searched`` counts the queries of
    shards that beams answered; all others were held against their whole shard.
    """
    scratch = Scratch(vectors.sparkSession, "embdedup")
    rows = scratch.keep(valid_vectors(vectors, keep_invalid=True, label="label"), "rows")
    some = rows.filter("fp is not null and label is not null")
    classes = some.groupBy("label", "dim", "fp").agg(F.first("vec").alias("vec"), F.count("*").alias("members"), F.min("vec_id").alias("least_id"))
    # one fingerprint for a vector and its label
    classes = scratch.keep(classes.withColumn("fp", F.unhex(F.md5(F.concat(F.col("fp"), F.col("label").cast("binary"))))), "classes")
    per = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards"))
    sized = classes.join(per, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    graph = scratch.keep(sized.groupBy(*KEYS).applyInPandas(build_shard, NODE), "graph")
    blank = lambda name, kind: F.lit(None).cast(kind).alias(name)
    asking = sized.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asking = asking.select(*KEYS, blank("pos", "int"), "fp", "vec", blank("members", "long"), blank("height", "int"), blank("links", "binary"), F.lit(1).alias("kind"))
    both = graph.withColumn("kind", F.lit(0)).unionByName(asking)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "kind", "pos", "fp")
    found = scratch.keep(dealt.mapInArrow(stream(cosine, searched), FOUND), "found")
    scratch.drop(graph)
    counts = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(found.filter("v is not null").select("u", "v"), scratch)
    named = classes.select("label", "fp", "members", "least_id").join(roots, F.col("fp") == F.col("node"), "left").join(counts, F.col("fp") == F.col("u"), "left")
    named = named.select("fp", "least_id", F.coalesce("root", "fp").alias("root"), (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = scratch.keep(named.join(ids, "root").select(F.col("fp").alias("of"), "n_links", "component_id"), "of")
    own = F.when(F.col("label").isNotNull(), F.unhex(F.md5(F.concat(F.col("fp"), F.col("label").cast("binary")))))
    out = rows.select("vec_id", own.alias("own")).join(of, F.col("own") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))
