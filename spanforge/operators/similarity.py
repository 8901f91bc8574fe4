"""Likeness of steps by vectors: loops on three levels, loops by clusters, and entropy over clusters of answers.

Steps are (trace_id, step, agent, state, content, vector), answers (question, pos, vector). Clusters of a trace come from
k-means over all traces at once: components are whole numbers, so that sums are exact and rows may be added
up in any order. Traces are dealt to tasks once, which cluster many traces together; for a trace too long for a task, a round
is a join with at most five centres and a sum by cluster.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..plans.registry import query
from ..sources.adapters import STEPS, read, steps
from .graph import cut

#: Structural threshold, semantic threshold and window by framework; matches that make a semantic loop.
THRESHOLDS = {
    "default": (0.95, 0.85, 7), "langgraph": (0.92, 0.88, 5), "autogen": (0.90, 0.80, 10), "crewai": (0.88, 0.82, 8), "n8n": (0.98, 0.90, 5), "dify": (0.95, 0.85, 6), "openclaw": (0.90, 0.82, 8),
}
MATCHES = 2
#: Phrases of a summary and of progress.
REVIEWS = (
    r"\b(?:to summarize|in summary|summarizing|to recap|recapping)\b", r"\b(?:so far|thus far|up to this point|at this point)\b", r"\b(?:what we've done|what i've done|what has been done)\b",
    r"\b(?:reviewing|let me review|to review)\b", r"\b(?:accomplishments|completed so far|progress report)\b", r"\b(?:status update|current status|where we are)\b",
    r"\b(?:here's what|here is what)\s+(?:we've|i've|has been)\b", r"\b(?:quick recap|brief summary|overview of)\b", r"\b(?:wrapping up|to wrap up|in conclusion)\b", r"\b(?:let me go over|going over what)\b",
    r"\b(?:step \d+ of \d+|task \d+ of \d+)\b", r"\b(?:phase \d+|iteration \d+|round \d+)\b", r"\b(?:checkpoint|milestone|progress)\b", r"\b(?:moving on to|proceeding to|next up)\b", r"\b(?:completed step \d+|finished step \d+)\b",
)
#: Parts of a unit that components are rounded to; rounds of k-means; members of a cluster that are compared.
UNIT, ROUNDS, COMPARED = 65536, 5, 5
#: Components of a trace that one task clusters by itself.
LONGEST = 1 << 21
#: Cosine from which an answer joins a cluster, entropy below which answers are reliable.
ALIKE, RELIABLE = 0.85, 0.5
#: Answers of a question that are clustered in one group at a time, and those that are held against its leaders in one task.
BLOCK, STREAM = 4096, 20_000


def _confidence(base: float, raw: Column, strength: Column, length: Column) -> Column:
    return F.round(F.least(F.lit(0.99), F.lit(base * 0.5) + raw * 0.25 + F.least(F.lit(1.0), length / 5.0) * 0.15 + strength * 0.1), 4)


def last_steps(s: DataFrame, window: int) -> DataFrame:
    """The last ``window`` steps of each trace, with ``back``: 1 for the last."""
    w = W.partitionBy("trace_id").orderBy(F.col("step").desc())
    return s.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= window)


def loops(s: DataFrame, framework: str = "default") -> DataFrame:
    """(trace_id, method, loop_start, loop_length, raw_score, confidence) of traces of three steps or more whose last step repeats one of the window before it.

    The first method that finds a match counts: structural (same agent, same names in the state, fewer than two values
    changed), hash (equal states), semantic (vectors alike in two steps or more without progress, unless the last content sums
    up). A state that is no JSON object has no names; rows without a vector are never alike.
    """
    _, alike, window = THRESHOLDS[framework]
    members = F.expr("try_variant_get(try_parse_json(state), '$', 'map<string,variant>')")
    n = s.groupBy("trace_id").agg(F.count("*").alias("n")).filter("n >= 3")
    r = last_steps(s, window).join(n, "trace_id").withColumn("members", members)
    r = r.withColumn("entries", F.expr("coalesce(array_sort(transform(map_keys(members), k -> struct(k as k, to_json(members[k]) as v))), array())")).drop("members", "state")
    r = r.withColumn("names", F.expr("transform(entries, e -> e.k)"))
    now = r.filter("back = 1").select("trace_id", F.col("agent").alias("c_agent"), F.col("content").alias("c_content"), F.col("vector").alias("c_vector"), F.col("entries").alias("c_entries"), F.col("names").alias("c_names"))
    p = r.filter("back > 1").join(now, "trace_id")
    width = F.least(F.col("n") - 1, F.lit(window - 1))
    new = F.size(F.array_except("c_names", "names")) > 0
    changes = F.expr("size(filter(c_entries, e -> array_contains(names, e.k) and not array_contains(entries, e)))") >= 2
    same = F.expr("array_sort(names) = array_sort(c_names)") & (F.col("agent") == F.col("c_agent"))
    review = reduce(Column.__or__, [F.lower("c_content").rlike(x) for x in REVIEWS])
    sim = F.coalesce(cosine(F.col("vector"), F.col("c_vector")), F.lit(0.0))
    p = p.withColumns({"width": width, "at": F.col("n") - F.col("back"), "progress": new | changes, "review": F.coalesce(review, F.lit(False)), "sim": sim})
    p = p.withColumns({"structural": same & ~F.col("progress"), "hash": F.col("entries") == F.col("c_entries"), "semantic": (F.col("width") >= 3) & (F.col("sim") > alike) & ~F.col("progress")})
    of = lambda m: [F.count_if(m).alias(f"{m}_n"), F.min(F.when(F.col(m), F.col("at"))).alias(f"{m}_at")]
    g = p.groupBy("trace_id", "n", "width").agg(*[c for m in ("structural", "hash", "semantic") for c in of(m)], F.avg(F.when(F.col("semantic"), F.round("sim", 9))).alias("avg_sim"), F.bool_or("review").alias("review"))
    method = F.when(F.col("structural_n") > 0, "structural").when(F.col("hash_n") > 0, "hash").when((F.col("semantic_n") >= MATCHES) & ~F.col("review"), "semantic")
    g = g.withColumn("method", method).filter("method is not null")
    pick = lambda c: F.when(F.col("method") == "structural", F.col(f"structural_{c}")).when(F.col("method") == "hash", F.col(f"hash_{c}")).otherwise(F.col(f"semantic_{c}"))
    g = g.withColumns({"found": pick("n"), "at": pick("at")}).withColumn("loop_length", F.col("n") - 1 - F.col("at"))
    # In traces longer than the window, places of the first and third method count from the step before it.
    g = g.withColumn("loop_start", F.col("at") - ((F.col("n") > window) & (F.col("method") != "hash")).cast("int"))
    raw = F.when(F.col("method") == "semantic", F.col("avg_sim")).otherwise(F.col("found") / F.col("width"))
    g = g.withColumn("raw", raw)
    half, quarter = (F.least(F.lit(1.0), F.col("found") / d) for d in (2.0, 4.0))
    confidence = F.when(F.col("method") == "structural", _confidence(0.96, F.col("raw"), half, F.col("loop_length"))).when(F.col("method") == "hash", _confidence(0.80, F.col("raw"), half, F.col("loop_length"))).otherwise(_confidence(0.70, F.col("raw"), quarter, F.col("loop_length")))
    return g.select("trace_id", "method", "loop_start", "loop_length", F.round("raw", 4).alias("raw_score"), confidence.alias("confidence"))


def clustered(s: DataFrame, rounds: int = ROUNDS, keep: int | None = None, longest: int = LONGEST) -> DataFrame:
    """(trace_id, step, pos, n, k, label, late, q) of traces of six steps or more: k-means of each trace, min(max(2, n / 4), 5) clusters, seeds evenly spaced.

    Vectors are rounded to whole numbers of 1 / UNIT and centres down to whole numbers; ties go to the lower cluster, and
    a cluster without members keeps its centre. Steps without a vector are left out; all vectors have one length. ``late`` is
    1 for the last step of its cluster; with ``keep``, q is null where late is greater. Traces are dealt to tasks once, and a task holds those of
    a batch; a trace of over ``longest`` components goes by rounds over all tasks.
    """
    s = s.filter("vector is not null and trace_id is not null").select("trace_id", "step", "vector")
    width = s.agg(F.max(F.size("vector"))).first()[0] or 0
    # Vectors that hold null or NaN, for which this is not false, are left to the rounds too.
    odd = ~F.coalesce(~F.array_contains("vector", F.lit(float("nan")).cast(s.schema["vector"].dataType.elementType)), F.lit(False)) | (F.size("vector") != width)
    apart = cut(s.groupBy("trace_id").agg(F.count("*").alias("n"), F.bool_or(odd).alias("odd")).filter((F.col("n") >= 6) & (F.col("odd") | (F.col("n") * width > longest))).select("trace_id"))
    if apart.isEmpty():
        return _in_tasks(s, width, rounds, keep)
    rest = _by_rounds(s.join(apart, "trace_id", "left_semi"), width, rounds)
    if keep is not None:
        rest = rest.withColumn("q", F.when(F.col("late") <= keep, F.col("q")))
    return _in_tasks(s.join(apart, "trace_id", "left_anti"), width, rounds, keep).unionByName(rest)


def _in_tasks(s: DataFrame, width: int, rounds: int, keep: int | None) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = {c: s.schema[c].dataType.simpleString() for c in ("trace_id", "step")}
    names = ["trace_id", "step", "pos", "n", "k", "label", "late", "q"]

    def whole(v) -> np.ndarray:
        y = v.astype(float) * UNIT
        t = np.trunc(y)
        y = t + np.where(np.abs(y - t) >= 0.5, np.sign(y), 0.0)
        if not (np.abs(y) < 2.0**63).all():
            raise OverflowError("a component is too large")
        return y.astype(np.int64)

    def label(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """Rows of whole traces, which begin at ``starts``."""
        size = np.diff([*starts, table.num_rows])
        many = np.repeat(size >= 6, size)
        table, size = table.filter(pa.array(many)), size[size >= 6]
        rows, traces = table.num_rows, len(size)
        starts, g, k = np.cumsum(size) - size, np.repeat(np.arange(traces), size), np.clip(size // 4, 2, 5)
        v = table.column("vector").combine_chunks()
        exact = q = whole(v.flatten().to_numpy(zero_copy_only=False)).reshape(rows, width)
        if rows and width and 4 * width * int(np.abs(q).max()) ** 2 >= 2**63:
            exact = q.astype(object)
        dot = (lambda a, b: (a * b).sum(axis=1)) if exact.dtype == object else (lambda a, b: np.einsum("ij,ij->i", a, b))
        most = int(k.max()) if traces else 0
        centres = [exact[starts + np.minimum(j * size // k, size - 1)] for j in range(most)]

        def near() -> np.ndarray:
            best, of = None, np.zeros(rows, np.int64)
            for j, c in enumerate(centres):
                d = dot(c, c)[g] - 2 * dot(exact, c[g])
                if best is None:
                    best = d
                else:
                    closer = (d < best) & (j < k)[g]
                    best, of = np.where(closer, d, best), np.where(closer, j, of)
            return of

        def by_cluster(of):
            key = g * 8 + of
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            return order, first, key[order][first], np.diff([*first, rows])

        for _ in range(rounds if rows else 0):
            order, first, key, held = by_cluster(near())
            means = np.add.reduceat(exact[order], first, axis=0) // held[:, None] if width else exact[order][first]
            for j, c in enumerate(centres):
                c[key[key % 8 == j] // 8] = means[key % 8 == j]
        of, late = near(), np.zeros(rows, np.int64)
        order, first, _, held = by_cluster(of)
        late[order] = np.repeat(first + held, held) - np.arange(rows)
        kept = np.ones(rows, bool) if keep is None else late <= keep
        # A list whose offset is null is null.
        ends = np.concatenate([[0], np.cumsum(kept * width)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~kept, False)), pa.array(q[kept].reshape(-1)))
        ints = lambda x, t: pa.array(x.astype(t))
        columns = [table.column("trace_id").combine_chunks(), table.column("step").combine_chunks(), ints(np.arange(rows) - starts[g], np.int32), ints(size[g], np.int64), ints(k[g], np.int64), ints(of, np.int32), ints(late, np.int32), lists]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        """Rows come by trace and step; the last trace of a batch waits for the next."""
        waiting: list = []
        for batch in batches:
            ids = batch.column("trace_id")
            new = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1
            if waiting and batch.num_rows and waiting[-1].column("trace_id")[-1] != ids[0]:
                new = np.append(0, new)
            if not len(new):
                waiting += [batch] if batch.num_rows else []
                continue
            waiting.append(batch.slice(0, new[-1]))
            before = sum(b.num_rows for b in waiting[:-1])
            yield label(pa.Table.from_batches(waiting), np.append(0, new[:-1] + before) if before + new[0] else np.array([0]))
            waiting = [batch.slice(new[-1])]
        if waiting:
            yield label(pa.Table.from_batches(waiting), np.array([0]))

    dealt = s.repartition("trace_id").sortWithinPartitions("trace_id", "step")
    return dealt.mapInArrow(run, f"trace_id {kind['trace_id']}, step {kind['step']}, pos int, n long, k long, label int, late int, q array<long>")


def _by_rounds(s: DataFrame, width: int, rounds: int) -> DataFrame:
    """The same for any length of a trace: a round is a join with at most five centres a trace and a sum by trace and cluster."""
    w = W.partitionBy("trace_id").orderBy("step")
    q = s.select("trace_id", "step", F.transform("vector", lambda x: F.round(x.cast("double") * UNIT).cast("long")).alias("q"))
    q = q.withColumns({"pos": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy("trace_id"))}).filter("n >= 6")
    q = cut(q.withColumn("k", F.expr("least(greatest(2, n div 4), 5)")))
    seed = F.expr("array_position(transform(sequence(0, k - 1), i -> i * n div k), pos) - 1")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda t, x: t + x)
    packed = lambda c: c.withColumn("norm", dot(F.col("q"), F.col("q"))).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("label", "norm", "q"))).alias("centres"))
    centres = q.withColumn("label", seed).filter("label >= 0").select("trace_id", F.col("label").cast("int").alias("label"), "q")
    for _ in range(rounds):
        near = nearest(q, packed(centres), dot)
        sums = near.groupBy("trace_id", "label").agg(F.count("*").alias("held"), *[F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(width)])
        means = sums.select("trace_id", "label", F.array(*[F.expr(f"cast((s{i} - pmod(s{i}, held)) / held as bigint)") for i in range(width)]).alias("mean"))
        centres = cut(centres.join(means, ["trace_id", "label"], "left").select("trace_id", "label", F.coalesce("mean", "q").alias("q")))
    late = F.row_number().over(W.partitionBy("trace_id", "label").orderBy(F.col("pos").desc()))
    return nearest(q, packed(centres), dot).withColumn("late", late)


def nearest(q: DataFrame, centres: DataFrame, dot) -> DataFrame:
    best = F.array_min(F.transform("centres", lambda c: F.struct((c["norm"] - 2 * dot(F.col("q"), c["q"])).alias("d"), c["label"].alias("label"))))
    return q.join(centres, "trace_id").withColumn("label", best["label"]).drop("centres")


def cluster_loops(s: DataFrame, framework: str = "default", rounds: int = ROUNDS, longest: int = LONGEST) -> DataFrame:
    """(trace_id, clusters, kind, dominant, held, cycle, similarity, loop_start, confidence) of traces whose last steps stay in one cluster (six in ten or more) or go round in clusters."""
    window = THRESHOLDS[framework][2]
    c = clustered(s, rounds, COMPARED, longest).filter((F.col("late") <= COMPARED) | (F.col("pos") >= F.col("n") - window))
    # A trace's last steps, and the last of each cluster: some forty rows at most.
    last = c.groupBy("trace_id", "n", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "late", "q"))).alias("x"))
    last = last.withColumn("l", F.expr(f"transform(filter(x, y -> y.pos >= n - {window}), y -> y.label)")).withColumn("m", F.size("l"))
    last = last.withColumn("most", F.expr("array_max(transform(l, a -> size(filter(l, b -> b = a))))"))
    cycles = [F.when((F.col("m") >= 2 * p) & F.expr(f"slice(l, -{p}, {p}) = slice(l, greatest(m - {2 * p} + 1, 1), {p})"), p) for p in range(2, window // 2 + 1)]
    last = last.withColumns({"dominant": F.expr("filter(l, a -> size(filter(l, b -> b = a)) = most)[0]"), "rules": (F.col("most") * 10 >= F.col("m") * 6) & (F.col("most") >= MATCHES), "cycle": F.coalesce(*cycles, F.lit(0))})
    last = last.filter("rules or cycle >= 2").withColumns({"dominant": F.expr("if(rules, dominant, 0)"), "held": F.expr("if(rules, most, 0)")})
    last = last.withColumn("v", F.expr(f"transform(filter(x, y -> y.label = dominant and y.late <= {COMPARED}), y -> struct(y.pos as pos, y.q as q))")).drop("x")
    both = F.flatten(F.transform("v", lambda a, i: F.transform(F.expr("slice(v, 1, size(v))"), lambda b, j: F.when(j > i, F.round(cosine(a["q"], b["q"]), 9)))))
    r = last.withColumn("sims", F.array_compact(both)).drop("v")
    average = F.when(F.size("sims") > 0, F.aggregate("sims", F.lit(0.0), lambda t, x: t + x) / F.size("sims")).otherwise(0.0)
    r = r.withColumn("similarity", F.coalesce(average, F.lit(0.0)))
    raw = F.when(F.col("rules"), F.col("held") / F.col("m")).otherwise(0.0) * 0.5 + F.col("similarity") * 0.5
    start = F.expr("n - m + array_position(l, dominant) - 1")
    kind = F.when(F.col("rules") & (F.col("cycle") >= 2), "cluster_dominance_cycle").when(F.col("rules"), "cluster_dominance").otherwise("cluster_cycle")
    strength = F.least(F.lit(1.0), F.col("held") / 5.0)
    return r.select("trace_id", F.col("k").cast("int").alias("clusters"), kind.alias("kind"), "dominant", "held", "cycle", F.round("similarity", 4).alias("similarity"), F.when(F.expr("array_contains(l, dominant)"), start).cast("long").alias("loop_start"), _confidence(0.75, raw, strength, F.col("held")).alias("confidence"))


def answer_clusters(a: DataFrame, alike: float = ALIKE, block: int = BLOCK, stream: int = STREAM) -> DataFrame:
    """(question, pos, leader): in order of ``pos``, an answer joins the first leader whose vector is alike, or leads.

    A question's answers are clustered at most ``block`` at a time: the first unassigned ones find their leaders in one group,
    all others then stream past those leaders in tasks of some ``stream``. A round needs the leaders of ``block`` answers, never all answers of
    a question, and the last answers are assigned as if all had come one after another. Vectors of another length are never alike; null ones join nothing and lead nothing.
    """
    import numpy as np
    import pyarrow as pa

    def unit(vectors):
        """By length, the places of vectors and the vectors with length one."""
        size = np.array([len(v) for v in vectors], int)
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            x = np.array([vectors[i] for i in at], float).reshape(len(at), dim)
            norm = np.linalg.norm(x, axis=1)
            yield int(dim), at, x / np.where(norm > 0, norm, 1.0)[:, None]

    def first_hit(hits):
        return np.where(hits.any(axis=1), hits.argmax(axis=1), -1)

    def lead(key, pdf):
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        of = np.arange(len(pdf))
        for _, at, x in unit(pdf["vector"].tolist()):
            led: list[int] = []
            for lo in range(0, len(at), 256):
                y = x[lo : lo + 256]
                before = first_hit(y @ x[led].T >= alike) if led else np.full(len(y), -1)
                near = y @ y.T >= alike
                new: list[int] = []
                for i in range(len(y)):
                    if before[i] >= 0:
                        of[at[lo + i]] = at[led[before[i]]]
                    elif len(hit := np.flatnonzero(near[i, new])):
                        of[at[lo + i]] = at[lo + new[hit[0]]]
                    else:
                        new.append(i)
                led += [lo + i for i in new]
        pos = pdf["pos"].to_numpy()
        return pdf.assign(leader=pos[of])[["question", "pos", "leader", "vector"]]

    def hold(batches):
        """Leaders of a question and salt come before its answers."""
        key, leaders, ready = None, [], None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("question", "salt", "kind")], strict=True))
            bounds = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if lo == hi:
                    continue
                *at, kind = keys[lo]
                if key != at:
                    key, leaders, ready = at, [], None
                run = batch.slice(lo, hi - lo)
                if kind == 0:
                    leaders += zip(run.column("pos").to_pylist(), run.column("vector").to_pylist(), strict=True)
                    continue
                if ready is None:
                    leaders.sort(key=lambda r: r[0])
                    ready = {dim: (np.array([leaders[i][0] for i in places]), x) for dim, places, x in unit([v for _, v in leaders])}
                of = np.full(hi - lo, None, object)
                for dim, places, x in unit(run.column("vector").to_pylist()):
                    if dim in ready:
                        pos, y = ready[dim]
                        for c in range(0, len(places), 1024):
                            hit = first_hit(x[c : c + 1024] @ y.T >= alike)
                            of[places[c : c + 1024][hit >= 0]] = pos[hit[hit >= 0]]
                names = ["question", "pos", "vector", "bucket"]
                yield pa.RecordBatch.from_arrays([*[run.column(c) for c in names], pa.array(of.tolist(), run.column("pos").type)], [*names, "leader"])

    kinds = [a.schema[c].dataType.simpleString() for c in ("question", "pos", "vector")]
    spark = a.sparkSession
    nth = F.row_number().over(W.partitionBy("question").orderBy("pos")) - 1
    small = max(1, block // 8)
    left = cut(a.filter("vector is not null").select("question", "pos", "vector").withColumn("bucket", F.floor(nth / small)))
    done = None
    while not left.isEmpty():
        # The next buckets whose unassigned answers fit a group; a bucket alone always does.
        upto = F.sum("count").over(W.partitionBy("question").orderBy("bucket"))
        sizes = left.groupBy("question", "bucket").count().withColumn("upto", upto)
        chosen = cut(sizes.filter(F.col("upto") <= block).groupBy("question").agg(F.max("bucket").alias("last")).unionByName(sizes.groupBy("question").agg(F.min("bucket").alias("last"))).groupBy("question").agg(F.max("last").alias("last")))
        first = left.join(chosen, left["question"].eqNullSafe(chosen["question"]) & (left["bucket"] <= chosen["last"]), "left_semi")
        found = cut(first.select("question", "pos", "vector").groupBy("question").applyInPandas(lead, "question {}, pos {}, leader {}, vector {}".format(kinds[0], kinds[1], kinds[1], kinds[2])))
        part = found.select("question", "pos", "leader")
        done = part if done is None else done.unionByName(part)
        rest = left.join(chosen, left["question"].eqNullSafe(chosen["question"]) & (left["bucket"] <= chosen["last"]), "left_anti")
        salts = rest.groupBy(F.col("question").alias("q_")).agg(F.ceil(F.count("*") / F.lit(stream)).alias("salts"))
        heads = found.filter("pos = leader").join(salts, F.col("question").eqNullSafe(F.col("q_"))).select("question", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "pos", "vector", F.lit(0).cast("long").alias("bucket"))
        others = rest.join(salts, F.col("question").eqNullSafe(F.col("q_"))).select("question", F.pmod(F.xxhash64("pos"), "salts").alias("salt"), F.lit(1).alias("kind"), "pos", "vector", "bucket")
        dealt = heads.unionByName(others).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "question", "salt").sortWithinPartitions("question", "salt", "kind")
        held = cut(dealt.mapInArrow(hold, "question {}, pos {}, vector {}, bucket long, leader {}".format(*kinds, kinds[1])))
        done = done.unionByName(held.filter("leader is not null").select("question", "pos", "leader"))
        left = held.filter("leader is null").drop("leader")
    return a.select("question", "pos", F.lit(None).cast(a.schema["pos"].dataType).alias("leader")).limit(0) if done is None else done


def semantic_entropy(a: DataFrame, sources: DataFrame | None = None, alike: float = ALIKE) -> DataFrame:
    """(question, answers, clusters, entropy, consistency, reliable, risk): entropy over the clusters of a question's answers.

    ``sources`` (question, vector) raises the risk by half where none of the first five answers is near it (below 0.5), and halves it where one is (over 0.8).
    """
    c = answer_clusters(a, alike)
    sizes = c.groupBy("question", "leader").agg(F.count("*").alias("m"))
    total = sizes.groupBy("question").agg(F.sum("m").alias("answers"), F.count("*").alias("clusters"))
    part = F.col("m") / F.col("answers")
    e = sizes.join(total, "question").groupBy("question", "answers", "clusters").agg((-F.sum(part * F.log2(part))).alias("entropy"))
    e = e.withColumn("entropy", F.when(F.col("clusters") == 1, 0.0).otherwise(F.col("entropy")))
    share = F.when(F.col("answers") > 1, F.col("entropy") / F.log2(F.greatest(F.col("answers"), F.lit(2)).cast("double"))).otherwise(0.0)
    e = e.withColumns({"share": share})
    risk = 1 - F.round(1 - F.col("share"), 4)
    if sources is not None:
        first = a.filter("vector is not null").withColumn("nth", F.row_number().over(W.partitionBy("question").orderBy("pos"))).filter("nth <= 5")
        near = first.join(sources.select("question", F.col("vector").alias("source")), "question").groupBy("question").agg(F.greatest(F.max(cosine(F.col("vector"), F.col("source"))), F.lit(0.0)).alias("near"))
        e = e.join(near, "question", "left")
        risk = F.when(F.col("near") < 0.5, F.least(F.lit(1.0), risk * 1.5)).when(F.col("near") > 0.8, risk * 0.5).otherwise(risk)
    return e.select("question", "answers", "clusters", F.round("entropy", 4).alias("entropy"), F.round(1 - F.col("share"), 4).alias("consistency"), (F.col("entropy") < RELIABLE).alias("reliable"), F.round(risk, 4).alias("risk"))


_REVIEW = " OR ".join(f"regexp_matches(lower(c.content), '{x}')".replace("'ve", "''ve").replace("here's", "here''s") for x in REVIEWS)
_CONF = "round(least(0.99e0, {base} * 0.5e0 + {raw} * 0.25e0 + least(1e0, {length} / 5e0) * 0.15e0 + {strength} * 0.1e0), 4)"


@query("l1_loops", f"""WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY step DESC) AS back, count(*) OVER (PARTITION BY trace_id) AS n FROM steps), w AS (SELECT *, json_keys(state) AS names FROM r WHERE back <= 7 AND n >= 3),
p AS (SELECT a.trace_id, a.n, least(a.n - 1, 6) AS width, a.n - a.back AS spot, a.agent = c.agent AND list_sort(a.names) = list_sort(c.names) AS same, len(list_filter(c.names, lambda k: NOT list_contains(a.names, k))) > 0
 OR len(list_filter(c.names, lambda k: list_contains(a.names, k) AND json_extract(a.state, '$.' || k) <> json_extract(c.state, '$.' || k))) >= 2 AS progress, a.state = c.state AS hash, list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS sim, {_REVIEW} AS review FROM w a JOIN w c ON a.trace_id = c.trace_id AND a.back > 1 AND c.back = 1),
g AS (SELECT trace_id, n, width, count(*) FILTER (WHERE same AND NOT progress) AS s_n, min(spot) FILTER (WHERE same AND NOT progress) AS s_at, count(*) FILTER (WHERE hash) AS h_n, min(spot) FILTER (WHERE hash) AS h_at,
 count(*) FILTER (WHERE width >= 3 AND sim > 0.85 AND NOT progress) AS m_n, min(spot) FILTER (WHERE width >= 3 AND sim > 0.85 AND NOT progress) AS m_at, avg(round(sim, 9)) FILTER (WHERE width >= 3 AND sim > 0.85 AND NOT progress) AS avg_sim, bool_or(review) AS review FROM p GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN s_n > 0 THEN 'structural' WHEN h_n > 0 THEN 'hash' WHEN m_n >= 2 AND NOT review THEN 'semantic' END AS method FROM g),
h AS (SELECT *, CASE method WHEN 'structural' THEN s_n WHEN 'hash' THEN h_n ELSE m_n END AS found, CASE method WHEN 'structural' THEN s_at WHEN 'hash' THEN h_at ELSE m_at END AS spot FROM f WHERE method IS NOT NULL),
i AS (SELECT *, n - 1 - spot AS loop_length, spot - CAST(n > 7 AND method <> 'hash' AS INTEGER) AS loop_start, CASE method WHEN 'semantic' THEN avg_sim ELSE CAST(found AS DOUBLE) / width END AS raw FROM h)
SELECT trace_id, method, loop_start, loop_length, round(raw, 4) AS raw_score, CASE method WHEN 'structural' THEN {_CONF.format(base="0.96e0", raw="raw", length="loop_length", strength="least(1e0, found / 2e0)")} WHEN 'hash' THEN {_CONF.format(base="0.8e0", raw="raw", length="loop_length", strength="least(1e0, found / 2e0)")} ELSE {_CONF.format(base="0.7e0", raw="raw", length="loop_length", strength="least(1e0, found / 4e0)")} END AS confidence FROM i""")
def l1(spark, d) -> DataFrame:
    return loops(steps(spark, d))


def _kmeans_sql(rounds: int) -> str:
    near = "SELECT q.trace_id, q.pos, min(list_sum([(q.q[i] - b.q[i]) * (q.q[i] - b.q[i]) for i in generate_series(1, len(q.q))]) * 8 + b.label) % 8 AS label FROM q JOIN b{r} b ON q.trace_id = b.trace_id GROUP BY 1, 2"
    ctes = f"""{STEPS}, q0 AS (SELECT trace_id, step, [CAST(round(CAST(x AS DOUBLE) * {UNIT}) AS BIGINT) for x in vector] AS q, row_number() OVER (PARTITION BY trace_id ORDER BY step) - 1 AS pos, count(*) OVER (PARTITION BY trace_id) AS n FROM steps),
q AS MATERIALIZED (SELECT *, least(greatest(2, n // 4), 5) AS k FROM q0 WHERE n >= 6), b0 AS MATERIALIZED (SELECT trace_id, i AS label, q FROM q, range(5) r(i) WHERE i < k AND pos = i * n // k)"""
    for r in range(rounds):
        ctes += f""", a{r} AS MATERIALIZED ({near.format(r=r)}), u{r} AS (SELECT a.trace_id, label, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r} a JOIN q ON a.trace_id = q.trace_id AND a.pos = q.pos), m{r} AS (SELECT trace_id, label, i, sum(x) AS s, count(*) AS c FROM u{r} GROUP BY 1, 2, 3),
v{r} AS (SELECT trace_id, label, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS q FROM m{r} GROUP BY 1, 2), b{r + 1} AS MATERIALIZED (SELECT b.trace_id, b.label, coalesce(v.q, b.q) AS q FROM b{r} b LEFT JOIN v{r} v ON b.trace_id = v.trace_id AND b.label = v.label)"""
    return f"{ctes}, c AS MATERIALIZED (SELECT q.*, CAST(label AS INTEGER) AS label FROM ({near.format(r=rounds)}) a JOIN q ON a.trace_id = q.trace_id AND a.pos = q.pos)"


@query("l2_cluster_loops", f"""WITH {_kmeans_sql(ROUNDS)}, l0 AS (SELECT trace_id, n, k, list(label ORDER BY pos) AS l FROM c WHERE pos >= n - 7 GROUP BY 1, 2, 3), l1 AS (SELECT *, len(l) AS m, list_max([len([b for b in l if b = a]) for a in l]) AS most FROM l0),
l2 AS (SELECT *, [a for a in l if len([b for b in l if b = a]) = most][1] AS dominant0, most * 10 >= m * 6 AND most >= 2 AS rules, CASE WHEN m >= 4 AND l[m - 1:m] = l[m - 3:m - 2] THEN 2 WHEN m >= 6 AND l[m - 2:m] = l[m - 5:m - 3] THEN 3 ELSE 0 END AS cycle FROM l1),
l3 AS (SELECT *, CASE WHEN rules THEN dominant0 ELSE 0 END AS dominant, CASE WHEN rules THEN most ELSE 0 END AS held FROM l2 WHERE rules OR cycle >= 2), t AS (SELECT c.trace_id, c.pos, c.q FROM c JOIN l3 ON c.trace_id = l3.trace_id AND c.label = l3.dominant QUALIFY row_number() OVER (PARTITION BY c.trace_id ORDER BY pos DESC) <= 5),
s AS (SELECT a.trace_id, avg(round(list_cosine_similarity(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])), 9)) AS sim FROM t a JOIN t b ON a.trace_id = b.trace_id AND a.pos < b.pos GROUP BY 1)
SELECT l3.trace_id, CAST(k AS INTEGER) AS clusters, CASE WHEN rules AND cycle >= 2 THEN 'cluster_dominance_cycle' WHEN rules THEN 'cluster_dominance' ELSE 'cluster_cycle' END AS kind, dominant, CAST(held AS INTEGER) AS held, cycle, round(coalesce(sim, 0), 4) AS similarity, CASE WHEN list_contains(l, dominant) THEN n - m + list_position(l, dominant) - 1 END AS loop_start,
{_CONF.format(base="0.75e0", raw="(CASE WHEN rules THEN CAST(held AS DOUBLE) / m ELSE 0e0 END * 0.5e0 + coalesce(sim, 0e0) * 0.5e0)", length="held", strength="least(1e0, held / 5e0)")} AS confidence FROM l3 LEFT JOIN s ON l3.trace_id = s.trace_id""")
def l2(spark, d) -> DataFrame:
    return cluster_loops(steps(spark, d))


def answers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Vectors as answers to the question that their label names; a question's source is the vector of the same place among all."""
    e = read(spark, d, "embeddings").select(F.col("label").alias("question"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return e, e.filter("question = pos").select("question", "vector")


@query("l30_semantic_entropy", f"""WITH RECURSIVE e AS (SELECT label AS question, vec_id AS pos, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings), g AS (SELECT question, list(v ORDER BY nth) AS vs FROM e GROUP BY 1),
r AS (SELECT question, 0::BIGINT AS nth, []::BIGINT[] AS leaders, 0::BIGINT AS leader FROM g UNION ALL SELECT r.question, e.nth, CASE WHEN hit IS NULL THEN list_append(r.leaders, e.nth) ELSE r.leaders END, coalesce(hit, e.nth) FROM r JOIN e ON r.question = e.question AND e.nth = r.nth + 1 JOIN g ON g.question = r.question, LATERAL (SELECT [l for l in r.leaders if list_cosine_similarity(g.vs[l], e.v) >= {ALIKE}][1] AS hit) h),
z AS (SELECT question, leader, count(*) AS m FROM r WHERE nth > 0 GROUP BY 1, 2), t AS (SELECT question, sum(m) AS n, count(*) AS clusters FROM z GROUP BY 1), p AS (SELECT z.question, CAST(n AS BIGINT) AS answers, clusters, CASE WHEN clusters = 1 THEN 0 ELSE -sum(m / n * log2(m / n)) END AS entropy FROM z JOIN t ON z.question = t.question GROUP BY 1, 2, 3),
s AS (SELECT a.question, greatest(max(list_cosine_similarity(a.v, b.v)), 0) AS near FROM e a JOIN e b ON a.question = b.question AND b.pos = b.question WHERE a.nth <= 5 GROUP BY 1), h AS (SELECT *, CASE WHEN answers > 1 THEN entropy / log2(answers) ELSE 0 END AS share FROM p)
SELECT h.question, answers, clusters, round(entropy, 4) AS entropy, round(1 - share, 4) AS consistency, entropy < {RELIABLE} AS reliable, round(CASE WHEN near < 0.5 THEN least(1, (1 - round(1 - share, 4)) * 1.5) WHEN near > 0.8 THEN (1 - round(1 - share, 4)) * 0.5 ELSE 1 - round(1 - share, 4) END, 4) AS risk FROM h LEFT JOIN s ON h.question = s.question""")
def l30(spark, d) -> DataFrame:
    a, sources = answers(spark, d)
    return semantic_entropy(a, sources)
