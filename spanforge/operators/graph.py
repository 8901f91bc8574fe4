"""Agent graphs: edges are steps from one span name to the next, or nations that trade through orders."""

import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import PARENTS, SPANS, order, parents, read, spans


def handoffs(s: DataFrame) -> DataFrame:
    """(trace_id, turn, source, target): steps to another name."""
    step = s.withColumn("source", F.lag("name").over(order())).withColumn("turn", (F.row_number().over(order()) - 1).cast("long"))
    return step.filter("source is not null and source <> name").select("trace_id", "turn", "source", F.col("name").alias("target"))


HANDOFFS = f"{SPANS}, h AS (SELECT trace_id, turn, source, name AS target FROM (SELECT *, lag(name) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS source, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) - 1 AS turn FROM spans) WHERE source <> name)"


@query("o2_unanswered_handoffs", f"WITH {HANDOFFS} SELECT trace_id, source, target FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.trace_id = a.trace_id AND b.source = a.target AND b.target = a.source AND b.turn > a.turn)")
def o2(spark, d) -> DataFrame:
    h = handoffs(spans(spark, d))
    back = h.groupBy("trace_id", F.col("source").alias("target"), F.col("target").alias("source")).agg(F.max("turn").alias("last"))
    return h.join(back, ["trace_id", "source", "target"], "left").filter(F.col("last").isNull() | (F.col("last") <= F.col("turn"))).select("trace_id", "source", "target")


@query("o3_coordination_overhead", f"WITH {HANDOFFS}, p AS (SELECT *, lag(source) OVER (PARTITION BY trace_id ORDER BY turn) AS ps, lag(target) OVER (PARTITION BY trace_id ORDER BY turn) AS pt FROM h) SELECT trace_id, round(avg(CASE WHEN ps = target AND pt = source THEN 1.0 ELSE 0.0 END), 6) AS overhead FROM p GROUP BY 1")
def o3(spark, d) -> DataFrame:
    w = W.partitionBy("trace_id").orderBy("turn")
    back = F.coalesce((F.lag("source").over(w) == F.col("target")) & (F.lag("target").over(w) == F.col("source")), F.lit(False))
    return handoffs(spans(spark, d)).withColumn("back", back).groupBy("trace_id").agg(F.round(F.avg(F.when(F.col("back"), 1.0).otherwise(0.0)), 6).alias("overhead"))


@query("o4_degrees", f"WITH {HANDOFFS}, o AS (SELECT trace_id, source AS agent, count(*) AS n FROM h GROUP BY 1, 2), i AS (SELECT trace_id, target AS agent, count(*) AS n FROM h GROUP BY 1, 2) SELECT coalesce(o.trace_id, i.trace_id) AS trace_id, coalesce(o.agent, i.agent) AS agent, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) = 0 AND coalesce(i.n, 0) > 0 AS orphan FROM o FULL JOIN i ON o.trace_id = i.trace_id AND o.agent = i.agent")
def o4(spark, d) -> DataFrame:
    ends = handoffs(spans(spark, d)).select("trace_id", F.explode(F.array(F.struct(F.col("source").alias("agent"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("agent"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    g = ends.groupBy("trace_id", "x.agent").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return g.withColumn("orphan", (F.col("out_degree") == 0) & (F.col("in_degree") > 0))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read again, so that no step repeats those before it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanforge-"))  # a local session, as in tests
    return df.checkpoint()


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth) by breadth-first steps until nothing is new; a step joins only the nodes found last."""
    edges = cut(edges.select("source", "target").distinct())
    seen = last = cut(start.select("node", F.lit(0).alias("depth")))
    depth = 0
    while not last.isEmpty():
        depth += 1
        step = last.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        last = cut(step.withColumn("depth", F.lit(depth)))
        seen = seen.union(last)
    return seen


TREE = "edges AS (SELECT DISTINCT CASE WHEN p_size % 2 = 1 THEN p_brand ELSE p_type END AS source, CASE WHEN p_size % 2 = 1 THEN p_type || ' ' || p_name ELSE p_brand END AS target FROM part)"


@query("o7_reachable", f"WITH RECURSIVE {TREE}, r(node) AS (SELECT 'Brand#1' UNION SELECT target FROM r JOIN edges ON node = source) SELECT node FROM r")
def o7(spark, d) -> DataFrame:
    """What a brand reaches through all parts: odd sizes lead from brand to type and name, even ones from type to brand."""
    odd = F.col("p_size") % 2 == 1
    p = read(spark, d, "part").select(F.when(odd, F.col("p_brand")).otherwise(F.col("p_type")).alias("source"), F.when(odd, F.concat_ws(" ", "p_type", "p_name")).otherwise(F.col("p_brand")).alias("target"))
    return reachable(p, spark.range(1).select(F.lit("Brand#1").alias("node"))).select("node")


def cycles(edges: DataFrame, most: int = 10) -> DataFrame:
    """(trace_id, start, members, length): simple cycles of 2 to ``most`` agents from each agent, one for each set of members.

    A path is known by its start, its end and the agents on it, in order of name: paths that differ only
    in the order between are one, so that a step has at most a row for each set and end.
    """
    e = cut(edges.select("trace_id", "source", "target").distinct())
    paths = e.filter("source <> target").select("trace_id", F.col("source").alias("start"), F.col("target").alias("at"), F.array_sort(F.array("source", "target")).alias("members"))
    found = []
    for length in range(2, most + 1):
        paths = cut(paths)
        if paths.isEmpty():
            break
        step = paths.join(e.select("trace_id", F.col("source").alias("at"), "target"), ["trace_id", "at"])
        found.append(step.filter("target = start").select("trace_id", "start", F.array_join("members", ">").alias("members"), F.lit(length).alias("length")).distinct())
        paths = step.filter(~F.array_contains("members", F.col("target"))).select("trace_id", "start", F.col("target").alias("at"), F.array_sort(F.array_append("members", F.col("target"))).alias("members")).distinct()
    none = e.select("trace_id", F.col("source").alias("start"), F.lit("").alias("members"), F.lit(0).alias("length")).limit(0)
    return reduce(DataFrame.unionByName, found, none)


_CYCLES = f"WITH RECURSIVE {HANDOFFS}, e AS (SELECT DISTINCT trace_id, source, target FROM h), p(trace_id, start, cur, members) AS (SELECT trace_id, source, target, list_sort([source, target]) FROM e UNION SELECT p.trace_id, p.start, e.target, list_sort(list_append(p.members, e.target)) FROM p JOIN e ON e.trace_id = p.trace_id AND e.source = p.cur WHERE NOT list_contains(p.members, e.target) AND len(p.members) < 10), c AS (SELECT DISTINCT p.trace_id, start, array_to_string(members, '>') AS members, CAST(len(members) AS INTEGER) AS length FROM p JOIN e ON e.trace_id = p.trace_id AND e.source = p.cur AND e.target = p.start)"


@query("o1_cycles", f"{_CYCLES} SELECT * FROM c")
def o1(spark, d) -> DataFrame:
    return cycles(handoffs(spans(spark, d)))


@query("o9_cyclic_traces", f"{_CYCLES} SELECT t.trace_id, coalesce(n, 0) AS cycles, n IS NOT NULL AS cyclic FROM (SELECT DISTINCT trace_id FROM e) t LEFT JOIN (SELECT trace_id, count(*) AS n FROM c GROUP BY 1) x ON x.trace_id = t.trace_id")
def o9(spark, d) -> DataFrame:
    h = handoffs(spans(spark, d))
    n = cycles(h).groupBy("trace_id").agg(F.count("*").alias("cycles"))
    return h.select("trace_id").distinct().join(n, "trace_id", "left").select("trace_id", F.coalesce("cycles", F.lit(0)).alias("cycles"), F.col("cycles").isNotNull().alias("cyclic"))


@query("o5_handoff_protocol", f"WITH {HANDOFFS}, r AS (SELECT a.trace_id, a.turn, min(b.turn) - a.turn AS wait FROM h a LEFT JOIN h b ON b.trace_id = a.trace_id AND b.source = a.target AND b.target = a.source AND b.turn > a.turn GROUP BY 1, 2) SELECT trace_id, count(*) FILTER (WHERE wait > 10) AS slow, count(*) FILTER (WHERE wait IS NULL) AS unanswered FROM r GROUP BY 1")
def o5(spark, d, turns: int = 10) -> DataFrame:
    """Handoffs answered after more than ten turns, or never. Both directions of a pair of agents lie in one window."""
    h = handoffs(spans(spark, d))
    up = F.col("source") < F.col("target")
    w = W.partitionBy("trace_id", F.least("source", "target"), F.greatest("source", "target")).orderBy("turn").rowsBetween(1, W.unboundedFollowing)
    first = F.when(up, F.min(F.when(~up, F.col("turn"))).over(w)).otherwise(F.min(F.when(up, F.col("turn"))).over(w))
    return h.withColumn("wait", first - F.col("turn")).groupBy("trace_id").agg(F.count_if(F.col("wait") > turns).alias("slow"), F.count_if(F.col("wait").isNull()).alias("unanswered"))


def to_root(p: DataFrame) -> DataFrame:
    """(trace_id, span_id, root, depth, minutes) for spans with parents: how many spans are above, and the time of the chain down to the span.

    Each round doubles the part of a chain that a row covers, so that a chain of n spans takes log n joins.
    """
    minutes = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 60e6
    own = p.select("trace_id", F.col("span_id").alias("root"), minutes.alias("own"))
    # A row covers the spans from its own up to, but without, the one it points to; a root points to itself and covers none.
    under = F.col("parent_id").isNotNull()
    up = cut(p.select("trace_id", "span_id", F.coalesce("parent_id", "span_id").alias("root"), under.cast("long").alias("depth"), F.when(under, minutes).otherwise(0.0).alias("minutes")))
    while True:
        above = up.select("trace_id", F.col("span_id").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"), F.col("minutes").alias("longer"))
        joined = up.join(above, ["trace_id", "root"]).select("trace_id", "span_id", F.col("further").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("minutes") + F.col("longer")).alias("minutes"), (F.col("further") != F.col("root")).alias("moved"))
        joined = cut(joined)
        up = joined.drop("moved")
        if joined.filter("moved").isEmpty():
            return up.join(own, ["trace_id", "root"]).withColumn("minutes", F.col("minutes") + F.col("own")).drop("own")


_CHAIN = f"WITH RECURSIVE {PARENTS}, c(trace_id, span_id, cur, depth, minutes) AS (SELECT trace_id, span_id, span_id, 0, CAST(0 AS DOUBLE) FROM parents UNION ALL SELECT c.trace_id, c.span_id, p.parent_id, depth + 1, minutes + epoch_us(p.end_time - p.start_time) / 60e6 FROM c JOIN parents p ON p.trace_id = c.trace_id AND p.span_id = c.cur WHERE c.cur IS NOT NULL), g AS (SELECT trace_id, span_id, max(depth) - 1 AS depth, max(minutes) AS minutes FROM c GROUP BY 1, 2)"


@query("o8_chain_depth", f"{_CHAIN} SELECT trace_id, CAST(max(depth) AS BIGINT) AS depth, max(depth) > 5 AS too_deep FROM g GROUP BY 1")
def o8(spark, d, most: int = 5) -> DataFrame:
    depth = F.max("depth")
    return to_root(parents(spark, d)).groupBy("trace_id").agg(depth.alias("depth"), (depth > most).alias("too_deep"))


@query("o11_critical_path", f"{_CHAIN}, t AS (SELECT trace_id, sum(epoch_us(end_time - start_time) / 60e6) AS total FROM parents GROUP BY 1) SELECT g.trace_id, round(max(minutes), 4) AS longest, round(max(minutes) / greatest(max(total), 1e-9), 6) AS share FROM g JOIN t ON g.trace_id = t.trace_id GROUP BY 1")
def o11(spark, d) -> DataFrame:
    """The longest chain of dependent spans, and its share of all work."""
    p = parents(spark, d)
    total = p.groupBy("trace_id").agg(F.sum((F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 60e6).alias("total"))
    longest = to_root(p).groupBy("trace_id").agg(F.max("minutes").alias("longest")).join(total, "trace_id")
    return longest.select("trace_id", F.round("longest", 4).alias("longest"), F.round(F.col("longest") / F.greatest("total", F.lit(1e-9)), 6).alias("share"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) is connected with. Roots of neighbours are taken, then roots of roots, until none changes."""
    e = cut(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    roots = cut(e.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = e.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("least"))
        lower = roots.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("least", "root")).alias("via"))
        far = roots.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = cut(lower.join(far, "via").select("node", F.col("far").alias("root"), (F.col("far") != F.col("was")).alias("changed")))
        roots = new.select("node", "root")
        if new.filter("changed").isEmpty():
            return roots


@query("o12_cyclomatic", f"WITH RECURSIVE {HANDOFFS}, e AS (SELECT DISTINCT trace_id, source, target FROM h), b AS (SELECT trace_id, source AS u, target AS v FROM e UNION SELECT trace_id, target, source FROM e), r(trace_id, node, cur) AS (SELECT DISTINCT trace_id, u, u FROM b UNION SELECT r.trace_id, r.node, b.v FROM r JOIN b ON b.trace_id = r.trace_id AND b.u = r.cur), m AS (SELECT trace_id, node, min(cur) AS root FROM r GROUP BY 1, 2), n AS (SELECT trace_id, count(*) AS nodes, count(DISTINCT root) AS parts FROM m GROUP BY 1) SELECT n.trace_id, nodes, parts, (SELECT count(*) FROM e WHERE e.trace_id = n.trace_id) - nodes + 2 * parts AS complexity FROM n")
def o12(spark, d) -> DataFrame:
    """Edges less nodes plus twice the connected parts of each trace's graph of agents."""
    e = handoffs(spans(spark, d)).select("trace_id", "source", "target").distinct()
    name = lambda c: F.concat_ws("/", "trace_id", c)
    c = connected(e.select(name("source").alias("u"), name("target").alias("v")))
    parts = c.withColumn("trace_id", F.split_part("node", F.lit("/"), F.lit(1)).cast("long")).groupBy("trace_id").agg(F.count("*").alias("nodes"), F.countDistinct("root").alias("parts"))
    n = e.groupBy("trace_id").agg(F.count("*").alias("edges"))
    return parts.join(n, "trace_id").select("trace_id", "nodes", "parts", (F.col("edges") - F.col("nodes") + 2 * F.col("parts")).alias("complexity"))


@query("o13_handoff_summary", f"WITH {HANDOFFS} SELECT source, target, count(*) AS n, count(DISTINCT trace_id) AS traces FROM h GROUP BY 1, 2")
def o13(spark, d) -> DataFrame:
    return handoffs(spans(spark, d)).groupBy("source", "target").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("traces"))
