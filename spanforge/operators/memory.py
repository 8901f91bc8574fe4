"""A store of memories: recall in two phases with use written back, insertion without duplicates and against contradictions, and contrastive examples.

memories (tenant, memory_id, domain, memory_type, framework, content, facts, vector, importance, access_count, created_at,
is_active, supersedes, superseded_by, last_accessed); facts are a JSON object, times are seconds. Vectors asked for are
dealt in blocks, and a tenant's memories stream past them in several tasks, so that no task holds a store and no pair
is kept but those found.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import MEMORIES, memories
from .graph import cut
from .similarity import answer_clusters

#: Weights of likeness, recency and importance; days that recency fades in; bonus of a use and at most; candidates of the two phases.
WEIGHTS, FADES, BONUS, MOST_BONUS, FIRST, SECOND = (0.4, 0.2, 0.4), 90, 0.02, 0.05, 50, 100
#: Likeness over which a memory is a duplicate, and may contradict; those looked at; names of facts that don't.
DUPLICATE, RELATED, LOOKED_AT, FREE_TEXT = 0.95, 0.8, 5, ("details", "content", "method")
#: Vectors asked for in a block, memories of a tenant that stream past it in one task, likenesses worked out at once.
BLOCK, STREAM, AT_ONCE = 16_384, 200_000, 1 << 24
FILTERS = ("domain", "memory_type", "framework")
_DEALT = ("tenant", "dim", "block", "salt", "kind", "id", *FILTERS, "after", "vector")


def neighbours(asked: DataFrame, store: DataFrame, top: int | None = None, over: float = -2.0, block: int = BLOCK, stream: int = STREAM) -> DataFrame:
    """(tenant, ask_id, memory_id, similarity): memories of the same tenant by cosine over ``over``, the ``top`` nearest of each ask or all.

    Domain, memory_type and framework of an ask that are not null must be those of the memory; a memory with an ``after`` (the store may
    lack the column) is for asks with a greater id only. Equal likeness goes to the lesser id; vectors of another length
    are no neighbours, nor is a memory without one; a zero vector has likeness 0. Single-precision products pass over what lies
    surely below an ask's last place; the rest is worked out in double precision.
    """
    nth = F.row_number().over(W.partitionBy("tenant", F.size("vector")).orderBy("ask_id")) - 1
    tenant = F.col("tenant").cast("string")
    single = all(df.schema["vector"].dataType.simpleString() == "array<float>" for df in (asked, store))
    vector = F.col("vector").cast("array<float>" if single else "array<double>").alias("vector")
    some = lambda i, after: [tenant.alias("tenant"), F.size("vector").alias("dim"), F.col(i).cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in FILTERS], after.cast("long").alias("after"), vector]
    a = asked.filter("vector is not null").withColumn("block", F.floor(nth / block)).select("block", *some("ask_id", F.lit(None)))
    s = store.filter("vector is not null").select(*some("memory_id", F.col("after") if "after" in store.columns else F.lit(None)))
    salts = s.groupBy("tenant", "dim").agg(F.ceil(F.count("*") / F.lit(stream)).alias("salts"))
    blocks = a.groupBy("tenant", "dim").agg((F.max("block") + 1).alias("blocks"))
    asks = a.join(salts, ["tenant", "dim"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("kind", F.lit(0))
    held = s.join(salts, ["tenant", "dim"]).join(blocks, ["tenant", "dim"]).withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("kind", F.lit(1))
    tasks = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asks.select(*_DEALT).unionByName(held.select(*_DEALT)).repartition(tasks, "tenant", "dim", "block", "salt").sortWithinPartitions("tenant", "dim", "block", "salt", "kind")

    def search(batches):
        import numpy as np
        import pyarrow as pa

        codes: dict[str, int] = {}
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def numbers(column):
            return np.array([-1 if v is None else codes.setdefault(v, len(codes)) for v in column.to_pylist()], np.int64)

        def part(run):
            """Ids, filters, afters and vectors of rows of one kind, with lengths that are not 0."""
            dim = run.column(1)[0].as_py()
            x = run.column(10).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(run.num_rows, dim)
            norm = np.linalg.norm(x, axis=1)
            norm = np.where(norm > 0, norm, 1.0)
            after = run.column(9).fill_null(np.iinfo(np.int64).min).to_numpy()
            return run.column(5).to_numpy(), [numbers(run.column(6 + k)) for k in range(3)], after, x, norm, (x / norm[:, None]).astype(np.float32)

        def joined(parts):
            ids, filters, after, *more = zip(*parts, strict=True)
            cat = np.concatenate
            return cat(ids), [cat(f) for f in zip(*filters, strict=True)], cat(after), *map(cat, more)

        def placed(found, n):
            """The ``top`` best of each ask, and what their last one has."""
            at, mid, sim = found
            order = np.lexsort((mid, -sim, at))
            at, mid, sim = at[order], mid[order], sim[order]
            first = np.searchsorted(at, np.arange(n))
            keep = np.arange(len(at)) - first[at] < top
            at, mid, sim = at[keep], mid[keep], sim[keep]
            last = np.full(n, over)
            count = np.bincount(at, minlength=n)
            full = count == top
            last[full] = sim[(np.cumsum(count) - 1)[full]]
            return (at, mid, sim), last

        def rows(key, ids, found):
            at, mid, sim = found
            for i in range(0, len(at), 100_000):
                n = len(at[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array(ids[at[i : i + n]], pa.int64()), pa.array(mid[i : i + n], pa.int64()), pa.array(sim[i : i + n], pa.float64())], ["tenant", "ask_id", "memory_id", "similarity"])

        key, wanted, asks_, kept, pending, last = None, [], None, none, [], None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True))
            bounds = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if lo == hi:
                    continue
                *at_, kind = keys[lo]
                if key != at_:
                    if pending:
                        kept, _ = placed([np.concatenate(c) for c in zip(kept, *pending, strict=True)], len(last))
                    if asks_:
                        yield from rows(key, asks_[0], kept)
                    key, wanted, asks_, kept, pending, last = at_, [], None, none, [], None
                run = part(batch.slice(lo, hi - lo))
                if kind == 0:
                    wanted.append(run)
                    continue
                if not wanted:
                    continue
                if asks_ is None:
                    asks_ = joined(wanted)
                    last = np.full(len(asks_[0]), float(over))
                ids, filters, _, x, norm, unit = asks_
                margin = np.float32((x.shape[1] + 4) * 2.0**-23)
                wide = max(1, AT_ONCE // len(ids))
                for c in range(0, hi - lo, wide):
                    mids, m_filters, after, m_x, m_norm, m_unit = [f[c : c + wide] if not isinstance(f, list) else [g[c : c + wide] for g in f] for f in run]
                    sims = unit @ m_unit.T
                    for f, g in zip(filters, m_filters, strict=True):
                        some_ = np.flatnonzero(f >= 0)
                        if len(some_):
                            sims[some_] = np.where(f[some_, None] == g, sims[some_], np.float32(-9))
                    if (late := np.flatnonzero(after > np.iinfo(np.int64).min)).size:
                        sims[:, late] = np.where(ids[:, None] > after[late], sims[:, late], np.float32(-9))
                    least = np.where(last > -2, last - margin, -2).astype(np.float32)
                    if top is not None and len(mids) > top and not (last > over).any():
                        least = np.maximum(least, np.partition(sims, len(mids) - top, axis=1)[:, len(mids) - top] - 2 * margin)
                    i, j = np.nonzero(sims >= least[:, None])
                    del sims
                    for b in range(0, len(i), 100_000):
                        p, q = i[b : b + 100_000], j[b : b + 100_000]
                        sim = np.round(np.einsum("ij,ij->i", x[p], m_x[q]) / (norm[p] * m_norm[q]), 12)
                        hit = (sim > over) & (sim >= last[p])
                        found = p[hit], mids[q[hit]], sim[hit]
                        if top is None:
                            yield from rows(key, ids, found)
                        else:
                            pending.append(found)
                    if pending and sum(len(f[0]) for f in pending) >= max(len(kept[0]), len(ids)):
                        kept, last = placed([np.concatenate(f) for f in zip(kept, *pending, strict=True)], len(ids))
                        pending = []
        if pending:
            kept, _ = placed([np.concatenate(c) for c in zip(kept, *pending, strict=True)], len(last))
        if asks_:
            yield from rows(key, asks_[0], kept)

    found = dealt.mapInArrow(search, "tenant string, ask_id long, memory_id long, similarity double")
    if top is None:
        return found
    return found.withColumn("r_", F.row_number().over(W.partitionBy("tenant", "ask_id").orderBy(F.col("similarity").desc(), "memory_id"))).filter(F.col("r_") <= top).drop("r_")


def composite(similarity: Column, days: Column, importance: Column, access_count: Column, weights=WEIGHTS) -> Column:
    a, b, c = weights
    return similarity * a + F.exp(-F.greatest(F.lit(0.0), days) / FADES) * b + importance * c + F.least(F.lit(MOST_BONUS), F.log1p(F.coalesce(access_count, F.lit(0)).cast("double")) * BONUS)


def recall(asked: DataFrame, store: DataFrame, now: float, k: int = 5, least: float = 0.3, weights=WEIGHTS) -> DataFrame:
    """(tenant, ask_id, rank, memory_id, similarity, score, level): the ``k`` active memories of the best composite score for each ask.

    The 50 most alike are scored; where none reaches ``least``, or the most alike of those that do scores under 0.5, the next 50 are too.
    Equal scores keep the order of likeness.
    """
    active = store.filter("is_active")
    n = neighbours(asked, active, top=SECOND).withColumn("near", F.row_number().over(W.partitionBy("tenant", "ask_id").orderBy(F.col("similarity").desc(), "memory_id")))
    more = active.select(F.col("tenant").cast("string").alias("tenant"), "memory_id", "importance", "access_count", "created_at")
    score = composite(F.col("similarity"), (F.lit(float(now)) - F.col("created_at")) / 86400, F.col("importance"), F.col("access_count"), weights)
    s = n.join(more, ["tenant", "memory_id"]).withColumn("score", F.round(score, 9)).filter(F.col("score") >= least)
    per = W.partitionBy("tenant", "ask_id")
    lead = F.first("score").over(per.orderBy(F.col("near") > FIRST, "near"))
    first = F.min("near").over(per)
    s = s.withColumn("wide", (first > FIRST) | (lead < 0.5)).filter(F.col("wide") | (F.col("near") <= FIRST))
    s = s.withColumn("rank", F.row_number().over(per.orderBy(F.col("score").desc(), "near"))).filter(F.col("rank") <= k)
    return s.select("tenant", "ask_id", "rank", "memory_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.5, "medium").otherwise("low").alias("level"))


def accessed(store: DataFrame, recalled: DataFrame, now: float) -> DataFrame:
    """``store`` with the uses of ``recalled`` written back: one for each ask that recalled a memory."""
    uses = recalled.groupBy("tenant", "memory_id").agg(F.count("*").alias("uses_"))
    s = store.withColumn("tenant_", F.col("tenant").cast("string")).join(uses.withColumnRenamed("tenant", "tenant_"), ["tenant_", "memory_id"], "left")
    return s.withColumns({"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("uses_", F.lit(0)), "last_accessed": F.when(F.col("uses_") > 0, F.lit(float(now))).otherwise(F.col("last_accessed"))}).select(*store.columns)


def opposing(old: str, new: str) -> Column:
    """Whether two columns of JSON objects have a name in common, FREE_TEXT apart, whose values differ and are not null."""
    free = ", ".join(f"'{x}'" for x in FREE_TEXT)
    facts = lambda c: f"coalesce(map_entries(try_variant_get(try_parse_json({c}), '$', 'map<string,variant>')), array())"
    return F.expr(f"exists({facts(old)}, a -> a.key not in ({free}) and to_json(a.value) <> 'null' and exists({facts(new)}, b -> b.key = a.key and to_json(b.value) <> 'null' and to_json(b.value) <> to_json(a.value)))")


def remember(store: DataFrame, batch: DataFrame) -> DataFrame:
    """``store`` with ``batch`` inserted (same columns; memory_id gives the order), and superseded memories inactive.

    A memory is left out if an active one of its tenant has the same content, or a likeness over 0.95; both also against
    earlier ones of the batch. The new ones supersede the first contradiction among the five most alike, over 0.8, of the active memories of their
    domain and the earlier new ones; one that several contradict names the first. So a batch repeated has no
    effect. Contents are compared by hash; null contents are equal, and memories without a vector are compared by content only.
    What is found is written before it is used again; to insert one batch after another, write the store in between.
    """
    active = store.filter("is_active")
    hashed = F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash_")
    known = active.select(F.col("tenant").alias("t_"), hashed).distinct()
    fresh = batch.withColumn("hash_", hashed).withColumn("n_", F.row_number().over(W.partitionBy("tenant", "hash_").orderBy("memory_id"))).filter("n_ = 1")
    fresh = fresh.join(known, fresh["tenant"].eqNullSafe(known["t_"]) & (fresh["hash_"] == known["hash_"]), "left_anti").drop("n_", "hash_")
    any_ = F.lit(None).cast("string")
    ask = lambda df, domain: df.select("tenant", F.col("memory_id").alias("ask_id"), domain.alias("domain"), any_.alias("memory_type"), any_.alias("framework"), "vector")
    near = neighbours(ask(fresh, any_), active, top=1, over=DUPLICATE).select(F.col("tenant").alias("t_"), "ask_id")
    fresh = fresh.join(near, (fresh["tenant"].cast("string") == near["t_"]) & (fresh["memory_id"] == near["ask_id"]), "left_anti")
    fresh = cut(fresh)
    led = answer_clusters(fresh.select(F.col("tenant").alias("question"), F.col("memory_id").alias("pos"), "vector"), DUPLICATE + 1e-12).filter("pos <> leader").select(F.col("question").alias("t_"), F.col("pos").alias("p_"))
    fresh = cut(fresh.join(led, (fresh["tenant"] == led["t_"]) & (fresh["memory_id"] == led["p_"]), "left_anti"))
    # Earlier new memories are candidates like stored ones.
    pool = active.select("tenant", "memory_id", *FILTERS, "facts", "vector", F.lit(None).cast("long").alias("after")).unionByName(fresh.select("tenant", "memory_id", *FILTERS, "facts", "vector", F.col("memory_id").cast("long").alias("after")))
    alike = neighbours(ask(fresh.filter("facts is not null"), F.col("domain")), pool, top=LOOKED_AT, over=RELATED)
    text = lambda c: F.col(c).cast("string").alias(c)
    alike = alike.withColumn("r_", F.row_number().over(W.partitionBy("tenant", "ask_id").orderBy(F.col("similarity").desc(), "memory_id")))
    alike = alike.join(pool.select(text("tenant"), "memory_id", F.col("facts").alias("old_facts")), ["tenant", "memory_id"])
    alike = alike.join(fresh.select(text("tenant"), F.col("memory_id").alias("ask_id"), F.col("facts").alias("new_facts")), ["tenant", "ask_id"])
    hit = cut(alike.filter(opposing("old_facts", "new_facts")).groupBy("tenant", "ask_id").agg(F.min_by("memory_id", "r_").alias("old_id")))
    by = hit.groupBy(F.col("tenant").alias("t_"), F.col("old_id").alias("o_")).agg(F.min("ask_id").alias("by_"))
    over = hit.select(F.col("tenant").alias("u_"), F.col("ask_id").alias("a_"), F.col("old_id").alias("over_"))
    every = store.unionByName(fresh.withColumns({"access_count": F.lit(0).cast("long"), "is_active": F.lit(True)}).select(*store.columns))
    every = every.join(by, (F.col("tenant").cast("string") == F.col("t_")) & (F.col("memory_id") == F.col("o_")), "left").join(over, (F.col("tenant").cast("string") == F.col("u_")) & (F.col("memory_id") == F.col("a_")), "left")
    every = every.withColumns({"is_active": F.col("is_active") & F.col("by_").isNull(), "superseded_by": F.coalesce("superseded_by", "by_"), "supersedes": F.coalesce("supersedes", "over_")})
    return every.select(*store.columns)


def contrastive(asked: DataFrame, examples: DataFrame, positives: int = 3, negatives: int = 2, hard: int = 1, over: float = 0.7) -> DataFrame:
    """(mode, ask_id, role, rank, example_id, similarity) of examples (mode, example_id, is_failure, vector): the nearest failures, the nearest others, and of the others the nearest with a likeness of 0.7 or more."""
    role = lambda c: F.concat(F.col("mode").cast("string"), F.lit("/"), c.cast("string"))
    blank = [F.lit(None).cast("string").alias(c) for c in FILTERS]
    store = examples.select(role(F.col("is_failure").cast("int")).alias("tenant"), F.col("example_id").alias("memory_id"), *blank, "vector")
    ask = lambda flag: asked.select(role(F.lit(flag)).alias("tenant"), "ask_id", *blank, "vector")
    # One search gives all roles: the hard ones are those of the others that are alike enough.
    found = neighbours(ask(1).unionByName(ask(0)), store, top=max(positives, negatives, hard))
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("tenant", "ask_id").orderBy(F.col("similarity").desc(), "memory_id")))
    failed, rank = F.col("tenant").endswith("/1"), F.col("rank")
    named = lambda name, cond: F.when(cond, F.lit(name))
    roles = F.array_compact(F.array(named("positive", failed & (rank <= positives)), named("negative", ~failed & (rank <= negatives)), named("hard_negative", ~failed & (rank <= hard) & (F.col("similarity") > over - 1e-9))))
    r = found.withColumn("role", F.explode(roles))
    return r.select(F.split_part("tenant", F.lit("/"), F.lit(1)).alias("mode"), "ask_id", "role", "rank", F.col("memory_id").alias("example_id"), F.round("similarity", 6).alias("similarity"))


NOW = 1_706_745_600.0
_COS = "round(list_cosine_similarity(CAST({0}.vector AS DOUBLE[]), CAST({1}.vector AS DOUBLE[])), 12)"


def split(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All memories in two parts, by their hash: those that are stored, and those that come."""
    comes = F.pmod(F.hash("memory_id"), F.lit(4)) == 0
    return m.filter(~comes), m.filter(comes)


_ASKS = "SELECT tenant, memory_id AS ask_id, CASE WHEN memory_id % 3 = 0 THEN domain END AS domain, CASE WHEN memory_id % 3 = 1 THEN memory_type END AS memory_type, CASE WHEN memory_id % 7 = 0 THEN framework END AS framework, vector FROM memories"


def asks(m: DataFrame) -> DataFrame:
    when = lambda c, n, r: F.when(F.col("memory_id") % n == r, F.col(c)).alias(c)
    return m.select("tenant", F.col("memory_id").alias("ask_id"), when("domain", 3, 0), when("memory_type", 3, 1), when("framework", 7, 0), "vector")


_RECALL = f"""WITH {MEMORIES}, asks AS ({_ASKS}), n AS (SELECT a.tenant, a.ask_id, m.memory_id, {_COS.format("a", "m")} AS similarity, m.importance, m.access_count, m.created_at FROM asks a JOIN memories m ON a.tenant = m.tenant AND m.is_active AND (a.domain IS NULL OR a.domain = m.domain) AND (a.memory_type IS NULL OR a.memory_type = m.memory_type) AND (a.framework IS NULL OR a.framework = m.framework)),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant, ask_id ORDER BY similarity DESC, memory_id) AS near FROM n QUALIFY near <= {SECOND}), s AS (SELECT *, round(similarity * 0.4e0 + exp(-greatest(0e0, ({NOW} - created_at) / 86400e0) / {FADES}) * 0.2e0 + importance * 0.4e0 + least(0.05e0, ln(1 + access_count) * 0.02e0), 9) AS score FROM r),
f AS (SELECT * FROM s WHERE score >= 0.3), w AS (SELECT *, min(near) OVER (PARTITION BY tenant, ask_id) > {FIRST} OR first_value(score) OVER (PARTITION BY tenant, ask_id ORDER BY near) < 0.5 AS wide FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY tenant, ask_id ORDER BY score DESC, near) AS rank FROM w WHERE wide OR near <= {FIRST} QUALIFY rank <= 5)"""


@query("q13_memory_recall", f"{_RECALL} SELECT CAST(tenant AS VARCHAR) AS tenant, ask_id, rank, memory_id, round(similarity, 6) AS similarity, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM k")
def q13(spark, d) -> DataFrame:
    m = memories(spark, d)
    return recall(asks(m), m, NOW)


@query("q13_access_written_back", f"{_RECALL}, u AS (SELECT tenant, memory_id, count(*) AS uses FROM k GROUP BY 1, 2) SELECT m.tenant, m.memory_id, m.access_count + coalesce(uses, 0) AS access_count, CASE WHEN uses > 0 THEN {NOW}::DOUBLE END AS last_accessed FROM memories m LEFT JOIN u ON u.tenant = m.tenant AND u.memory_id = m.memory_id")
def q13_written_back(spark, d) -> DataFrame:
    m = memories(spark, d)
    return accessed(m, recall(asks(m), m, NOW), NOW).select("tenant", "memory_id", "access_count", "last_accessed")


@query("q14_remembered")
def q14(spark, d) -> DataFrame:
    """A quarter of the memories, by their hash, come to a store of the others."""
    store, batch = split(memories(spark, d))
    return remember(store, batch).select("tenant", "memory_id", "is_active", "supersedes", "superseded_by")


_MODES = "modes AS (SELECT vec_id AS example_id, label % 3 AS mode, vec_id % 2 = 0 AS is_failure, embedding AS vector FROM embeddings)"
_NEAR = f"SELECT a.mode, a.example_id AS ask_id, '{{role}}' AS role, b.example_id, {_COS.format('a', 'b')} AS similarity, row_number() OVER (PARTITION BY a.example_id ORDER BY {_COS.format('a', 'b')} DESC, b.example_id) AS rank FROM modes a JOIN modes b ON a.mode = b.mode AND {{is_}} b.is_failure WHERE {_COS.format('a', 'b')} >= {{least}} QUALIFY rank <= {{top}}"


@query("q17_contrastive", f"WITH {_MODES}, r AS ({_NEAR.format(role='positive', is_='', least=-2, top=3)} UNION ALL {_NEAR.format(role='negative', is_='NOT', least=-2, top=2)} UNION ALL {_NEAR.format(role='hard_negative', is_='NOT', least=0.7, top=1)}) SELECT CAST(mode AS VARCHAR) AS mode, ask_id, role, rank, example_id, round(similarity, 6) AS similarity FROM r")
def q17(spark, d) -> DataFrame:
    """For each vector of a mode, examples of the mode; even ids are failures."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("label") % 3).alias("mode"), F.col("vec_id").alias("example_id"), (F.col("vec_id") % 2 == 0).alias("is_failure"), F.col("embedding").alias("vector"))
    return contrastive(e.select("mode", F.col("example_id").alias("ask_id"), "vector"), e)
