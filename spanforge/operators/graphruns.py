"""Executions of agent graphs: routes that go wrong and parallel steps that are not joined, for all graphs at once.

nodes (graph_id, node_id, node_type, title, status, superstep, inputs, outputs), inputs and outputs as JSON objects;
edges (graph_id, source, target, edge_type, condition); states (graph_id, superstep, state), JSON; runs (graph_id, status).
A node id stands once in a graph. Where order matters, nodes come by superstep, then id. Members of JSON are exploded
once and compared by key, so that no pair of nodes is made.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import GRAPHS, graph_runs
from .graph import cut

#: Statuses of success; names of ends; words of conditions that end or go on; types that process; words of node types.
DONE, ENDS, PROCESSING = ("succeeded", "completed"), ("human", "end", "__end__"), ("llm", "tool", "subgraph", "map_reduce")
ENDING, GOING_ON = ("end", "finish", "stop", "terminate", "complete", "done"), ("process", "continue", "next", "run", "execute", "start")
TYPE_WORDS = {
    "tool": ("tool", "execute", "action", "function", "invoke"), "llm": ("llm", "model", "generate", "respond", "chat", "answer"), "human": ("human", "user", "manual", "approve", "review"),
    "router": ("router", "route", "switch", "branch", "decide"),
}
#: Words that say little about a node, values that need not resemble one, words left out, words of failed states.
GENERIC = ("tool", "service", "handler", "agent", "processor", "node", "queue", "manager", "worker", "module", "search", "path", "process", "step")
ANY_VALUE = (
    "true", "false", "yes", "no", "default", "none", "high", "low", "medium", "valid", "invalid", "premium", "standard", "basic", "normal", "available", "unavailable", "found", "not_found",
    "success", "error", "failed", "pending", "positive", "negative", "neutral", "user_found",
)
SMALL_WORDS, STATE_ERRORS = ("", "to", "the", "a", "is", "and", "or"), ("error", "fail", "timeout", "partial_failure", "sync_failed")
_TEST = r"^(\w+)\s*==\s*['\"]([^'\"]+)['\"]"


def _or(conditions) -> Column:
    return reduce(Column.__or__, conditions)


def _those(kinds: dict[str, Column]) -> Column:
    """The kinds whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))


def ok(status: Column) -> Column:
    return F.coalesce(status.isin(*DONE), F.lit(False))


def members(df: DataFrame, column: str, *keys: str, all_rows: bool = False) -> DataFrame:
    """(keys, key, value) of a column's JSON objects: strings as they are, True and False, other values as JSON; null values are left out.

    With ``all_rows``, a row without members stays, with a null key."""
    spark = df.sparkSession
    explode = spark.tvf.variant_explode_outer if all_rows else spark.tvf.variant_explode
    e = df.select(*keys, F.try_parse_json(column).alias("v")).lateralJoin(explode(F.col("v").outer()))
    e = e if all_rows else e.filter("key is not null")
    kind = F.schema_of_variant("value")
    text = F.when(kind == "VOID", None).when(kind == "STRING", F.expr("try_variant_get(value, '$', 'string')")).when(kind == "BOOLEAN", F.initcap(F.to_json("value"))).otherwise(F.to_json("value"))
    return e.select(*keys, "key", text.alias("text"))


def sync_issues(nodes: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(graph_id, superstep, kind) of supersteps that run several nodes: write_conflict, race_condition, missing_join, failed_parallel, downstream_failure; and states after them that speak of errors."""
    n = nodes.withColumn("superstep", F.coalesce("superstep", F.lit(-1)))
    step = n.groupBy("graph_id", "superstep").agg(F.count("*").alias("n"), F.count_if(ok(F.col("status"))).alias("good"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("failed", "skipped")).alias("bad"))
    after = step.select("graph_id", (F.col("superstep") - 1).alias("superstep"), *[F.col(c).alias(f"next_{c}") for c in ("n", "good", "bad")])
    uses = members(n, "inputs", "graph_id", "superstep", "node_id").withColumn("w", F.lit(0)).unionByName(members(n, "outputs", "graph_id", "superstep", "node_id").withColumn("w", F.lit(1)))
    # A key is in conflict if two nodes write it, in a race if one reads what another writes.
    key = uses.groupBy("graph_id", "superstep", "key").agg(F.count_if(F.col("w") == 1).alias("writers"), F.count_if(F.col("w") == 0).alias("readers"), F.count_distinct("node_id").alias("users"))
    key = key.groupBy("graph_id", "superstep").agg(F.bool_or(F.col("writers") > 1).alias("conflict"), F.bool_or((F.col("writers") > 0) & (F.col("readers") > 0) & (F.col("users") > 1)).alias("race"))
    s = step.filter("n > 1").join(after, ["graph_id", "superstep"], "left").join(key, ["graph_id", "superstep"], "left")
    joined = (F.col("next_n") == 1) & (F.col("next_good") == 1)
    rules = {
        "write_conflict": F.col("conflict") & ~F.coalesce(joined, F.lit(False)), "race_condition": F.col("race"), "missing_join": F.col("next_n").isNull() | ((F.col("next_n") > 1) & (F.col("next_n") >= F.col("n"))),
        "failed_parallel": (F.col("failed") > 0) & (F.col("good") > 0), "downstream_failure": F.col("next_bad") > 0,
    }
    out = s.select("graph_id", "superstep", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("kind"))
    if states is None:
        return out
    first = step.filter("n > 1").groupBy("graph_id").agg(F.min("superstep").alias("first"))
    late = states.join(first, "graph_id").filter((F.col("first") < F.col("superstep")) & _or(F.lower("state").contains(w) for w in STATE_ERRORS))
    return out.unionByName(late.select("graph_id", "superstep", F.lit("state_error_after_parallel").alias("kind")))


def sync_findings(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, issues, kinds, severity, confidence) of every graph with nodes."""
    g = issues.groupBy("graph_id").agg(F.count("*").alias("issues"), F.array_sort(F.collect_set("kind")).alias("k"))
    g = nodes.select("graph_id").distinct().join(g, "graph_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    has = lambda *kinds: F.arrays_overlap("k", F.array(*[F.lit(x) for x in kinds]))
    confidence = F.when(F.col("issues") == 0, 0.85).when(has("failed_parallel", "downstream_failure"), F.least(F.lit(0.9), 0.7 + F.col("issues") * 0.05)).when(has("write_conflict", "race_condition"), 0.7).when(has("state_error_after_parallel"), 0.65).otherwise(0.6)
    severity = F.when(F.col("issues") == 0, "none").when(has("write_conflict", "failed_parallel"), "severe").when(has("race_condition", "downstream_failure", "state_error_after_parallel"), "moderate").otherwise("minor")
    return g.select("graph_id", "issues", F.coalesce(F.array_join("k", ","), F.lit("")).alias("kinds"), severity.alias("severity"), F.round(confidence, 4).alias("confidence"))


def route_issues(nodes: DataFrame, edges: DataFrame, states: DataFrame, runs: DataFrame) -> DataFrame:
    """(graph_id, kind, source, target): missing targets, dead ends, unreachable nodes, and conditions that names, types, states or outputs contradict.

    Issues of an edge carry its ends, those of a node its id as source. A condition is tested if it reads: key == 'value'.
    The state of a router is that of its superstep, else of the next. A value that the router itself does not put
    out is that of the first node, at its superstep or before, that does.
    """
    n = nodes.withColumns({"superstep": F.coalesce("superstep", F.lit(-1)), "title": F.coalesce("title", F.lit("")), "node_type": F.coalesce("node_type", F.lit(""))})
    # Nodes, states, edges that may have an issue and tests with what they are held against are written once, and read by all checks.
    n = cut(n.select("graph_id", "node_id", "node_type", "title", "status", "superstep", "outputs"))
    src = n.select("graph_id", F.col("node_id").alias("source"), F.col("superstep").alias("step"), ok(F.col("status")).alias("source_ok"))
    dst = n.select("graph_id", F.col("node_id").alias("target"), "node_type", "title", F.col("status").alias("target_status"), F.lit(True).alias("known"))
    e = edges.join(dst, ["graph_id", "target"], "left")
    e = e.withColumns({"known": F.coalesce("known", F.lit(False)), "target_ok": ok(F.col("target_status")), "conditional": F.coalesce(F.col("edge_type") == "conditional", F.lit(False)), "condition": F.coalesce("condition", F.lit(""))})
    # An edge without a condition can only miss its target.
    missing = (F.col("target") != "") & ~F.col("known") & ~F.col("target").isin(*ENDS)
    e = e.filter(F.col("conditional") | missing).join(src, ["graph_id", "source"], "left").withColumn("step", F.coalesce("step", F.lit(-1)))
    e = e.withColumns({"test_key": F.nullif(F.regexp_extract("condition", _TEST, 1), F.lit("")), "test_value": F.nullif(F.regexp_extract("condition", _TEST, 2), F.lit(""))})
    # What a router's conditional edges have in common; an edge without a source is alone.
    router = W.partitionBy("graph_id", "source")
    named, ok_way = F.col("graph_id").isNotNull() & F.col("source").isNotNull(), F.when(F.col("conditional") & F.col("target_ok"), F.col("target"))
    common = {
        "ways": F.count_if(F.col("conditional")), "all_ok": F.bool_and(F.when(F.col("conditional"), F.col("target_ok"))), "ok_target": F.min(ok_way), "ok_last": F.max(ok_way),
        "tests": F.collect_set(F.when(F.col("conditional") & F.col("test_key").isNotNull(), F.struct("test_key", "test_value"))),
    }
    e = e.withColumns({k: F.when(named, c.over(router)) for k, c in common.items()}).withColumn("ways", F.coalesce("ways", F.lit(0)))

    other_ok = F.col("conditional") & ((F.col("ok_target") != F.col("target")) | (F.col("ok_last") != F.col("target")))
    cond = F.translate(F.lower("condition"), "_", " ")
    name = F.lower(F.when(F.col("title") == "", F.col("target")).otherwise(F.col("title")))
    says = lambda words, c: _or(c.contains(w) for w in words)
    mismatch = (says(ENDING, cond) & F.col("node_type").isin(*PROCESSING)) | (says(GOING_ON, cond) & (F.col("node_type").isin(*ENDS) | says(ENDING, name)))
    sent = F.replace(cond, F.lit("=="), F.lit(" "))
    typed = _or(sent.rlike(rf"(?:route.to|go.to|send.to|path.to)\s*(?:{'|'.join(w)})") & (F.col("node_type") != t) for t, w in TYPE_WORDS.items()) & (F.col("node_type") != "")
    value = F.regexp_extract("condition", r"['\"]([^'\"]+)['\"]", 1)
    flat = lambda c: F.regexp_replace(F.lower(c), "[_-]", "")
    left_out = F.array(*[F.lit(x) for x in (*GENERIC, *SMALL_WORDS)])
    value_words = F.array_except(F.split(F.lower(value), r"[\s_-]"), left_out)
    title_words = F.array_except(F.transform(F.split("title", r"(?<=[a-z])(?=[A-Z])|[\s_-]"), F.lower), left_out)
    stems = lambda ws: F.transform(ws, lambda w: F.regexp_replace(w, "s+$", ""))
    unlike = ~flat(F.col("title")).contains(flat(value)) & ~flat(value).contains(flat(F.col("title"))) & (F.size(value_words) > 0) & ~F.arrays_overlap(stems(value_words), stems(title_words))
    strange = F.col("target_ok") & (F.col("title") != "") & (F.length(value) >= 3) & ~F.lower(value).isin(*ANY_VALUE) & unlike
    is_known = F.col("conditional") & F.col("known") & (F.col("condition") != "")
    kinds = {
        "missing_target": missing & F.coalesce("source_ok", F.lit(False)) & ~F.coalesce(other_ok, F.lit(False)),
        "condition_mismatch": is_known & mismatch, "condition_title_mismatch": is_known & typed, "condition_value_target_mismatch": F.col("conditional") & strange,
    }
    e = e.withColumn("kinds", _those(kinds)).withColumn("left_out", F.expr("coalesce(conditional and ways >= 2 and target_status = 'skipped' and ok_target is not null, false)")).filter("size(kinds) > 0 or left_out or conditional and test_key is not null")
    e = cut(e.select("graph_id", "source", "target", "kinds", "left_out", "conditional", "step", "test_key", "test_value", "target_ok", "ways", "all_ok", "ok_target", "tests"))
    of_edges = e.select("graph_id", F.explode("kinds").alias("kind"), "source", "target")

    # Tests and what nodes put out meet by key, so that neither is joined with the other three times.
    put = members(n, "outputs", "graph_id", "node_id", "superstep").filter("text is not null and graph_id is not null")
    put = put.select("graph_id", F.col("node_id").alias("source"), F.col("superstep").alias("step"), F.col("key").alias("test_key"), F.col("text").alias("test_value"), F.lit(True).alias("put"))
    t = e.filter("conditional and test_key is not null").drop("kinds", "left_out", "conditional").withColumn("put", F.lit(False)).unionByName(put, allowMissingColumns=True)
    t = t.withColumn("first", F.min(F.when(F.col("put"), F.struct("step", "source", "test_value"))).over(W.partitionBy("graph_id", "test_key")))
    t = t.withColumn("own", F.max(F.when(F.col("put") & F.col("source").isNotNull(), F.col("test_value"))).over(W.partitionBy("graph_id", "test_key", "source")))
    t = t.withColumn("met", F.min(F.when(F.col("put"), F.col("step"))).over(W.partitionBy("graph_id", "test_key", "test_value"))).filter("not put")
    t = t.withColumn("put_value", F.coalesce("own", F.when(F.col("first.step") <= F.col("step"), F.col("first.test_value")))).drop("first", "put")
    s = cut(members(states.withColumn("full", F.expr("coalesce(state, '{}') <> '{}'")), "state", "graph_id", "superstep", "full", all_rows=True))
    at = lambda shift, name: s.filter("key is not null").select("graph_id", (F.col("superstep") - shift).alias("step"), F.col("key").alias("test_key"), F.col("text").alias(name))
    here = s.filter("full").select("graph_id", F.col("superstep").alias("step"), F.lit(True).alias("has_state")).distinct()
    by = ["graph_id", "step", "test_key"]
    tested = t.join(here, ["graph_id", "step"], "left").join(at(0, "now"), by, "left").join(at(1, "then"), by, "left").withColumn("state_value", F.when(F.col("has_state"), F.col("now")).otherwise(F.col("then")))

    def contradicts(value: str) -> Column:
        sibling = (F.col("ways") > 1) & F.col("all_ok") & F.array_contains("tests", F.struct("test_key", F.col(value).alias("test_value")))
        return F.col("target_ok") & F.col(value).isNotNull() & (F.col(value) != F.col("test_value")) & ~sibling

    # The way that was taken (of several, that of the least target) is confirmed by the router's state, its own output, or that of a node before it.
    confirmed = F.col("target_ok") & (F.col("target") == F.col("ok_target")) & ((F.col("state_value") == F.col("test_value")) | (F.col("own") == F.col("test_value")) | (F.col("met") <= F.col("step")))
    against = _those({"state_condition_contradiction": contradicts("state_value"), "output_condition_contradiction": contradicts("put_value")})
    tested = tested.withColumns({"kinds": against, "sure": F.coalesce(confirmed, F.lit(False))}).filter("size(kinds) > 0 or sure")
    tested = cut(tested.select("graph_id", "source", "target", "kinds", "sure"))
    of_tests = tested.select("graph_id", F.explode("kinds").alias("kind"), "source", "target")
    skipped = e.filter("left_out").join(tested.filter("sure").select("graph_id", "source").distinct(), ["graph_id", "source"], "left_anti").select("graph_id", F.lit("skipped_conditional").alias("kind"), "source", "target")

    ways = edges.select("graph_id", F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit(True).alias("leads")), F.struct(F.col("target").alias("node_id"), F.lit(False).alias("leads")))).alias("x")).select("graph_id", "x.*")
    ways = ways.groupBy("graph_id", "node_id").agg(F.bool_or("leads").alias("leads"), F.bool_or(~F.col("leads")).alias("led"))
    graph = W.partitionBy("graph_id")
    m = n.filter("graph_id is not null").select("graph_id", "node_id", "node_type", "title", "superstep").withColumns({"last": F.max("superstep").over(graph), "entry": F.min(F.struct("superstep", "node_id")).over(graph)})
    m = m.join(runs, "graph_id", "left").join(ways, ["graph_id", "node_id"], "left")
    over = F.coalesce((F.col("status") == "completed") & (F.col("superstep") >= F.col("last")), F.lit(False))
    ends = F.col("node_type").isin(*ENDS) | F.lower("title").isin(*ENDS) | F.col("node_id").isin(*ENDS)
    of_nodes = _those({"dead_end": ~over & ~ends & ~F.coalesce("leads", F.lit(False)), "unreachable": (F.col("node_id") != F.col("entry.node_id")) & ~F.coalesce("led", F.lit(False))})
    of_nodes = m.select("graph_id", F.explode(of_nodes).alias("kind"), F.col("node_id").alias("source"), F.lit(None).cast("string").alias("target"))
    return reduce(DataFrame.unionByName, [of_nodes, of_tests, skipped], of_edges)


def route_findings(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, issues, kinds, severity, confidence) of every graph with nodes."""
    g = issues.groupBy("graph_id").agg(F.count("*").alias("issues"), F.array_sort(F.collect_set("kind")).alias("k"))
    g = nodes.select("graph_id").distinct().join(g, "graph_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    has = lambda *kinds: F.arrays_overlap("k", F.array(*[F.lit(x) for x in kinds]))
    worst = has("missing_target", "state_condition_contradiction", "output_condition_contradiction")
    upto = lambda most, base, each: F.least(F.lit(most), base + F.col("issues") * each)
    confidence = F.when(F.col("issues") == 0, 0.85).when(worst, upto(0.95, 0.8, 0.05)).when(has("condition_value_target_mismatch"), upto(0.92, 0.7, 0.08)).when(has("condition_title_mismatch", "skipped_conditional"), upto(0.9, 0.65, 0.08)).otherwise(upto(0.9, 0.6, 0.1))
    severity = F.when(F.col("issues") == 0, "none").when(worst, "severe").when(has("dead_end", "condition_title_mismatch", "condition_value_target_mismatch"), "moderate").otherwise("minor")
    return g.select("graph_id", "issues", F.coalesce(F.array_join("k", ","), F.lit("")).alias("kinds"), severity.alias("severity"), F.round(confidence, 4).alias("confidence"))


_OK = "('succeeded', 'completed')"
_TEXT = "CASE json_type({0}, '$.' || k) WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN upper(({0}->>('$.' || k))[1]) || ({0}->>('$.' || k))[2:] ELSE {0}->>('$.' || k) END"
_SYNC = f"""WITH {GRAPHS}, u AS (SELECT graph_id, superstep, node_id, unnest(json_keys(inputs)) AS key, 0 AS w FROM graph_nodes UNION ALL SELECT graph_id, superstep, node_id, unnest(json_keys(outputs)), 1 FROM graph_nodes),
s AS (SELECT graph_id, superstep, count(*) AS n, count(*) FILTER (WHERE status IN {_OK}) AS good, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('failed', 'skipped')) AS bad FROM graph_nodes GROUP BY 1, 2),
p AS (SELECT s.*, t.n AS next_n, t.good AS next_good, t.bad AS next_bad FROM s LEFT JOIN s t ON s.graph_id = t.graph_id AND t.superstep = s.superstep + 1 WHERE s.n > 1),
c AS (SELECT DISTINCT a.graph_id, a.superstep FROM u a JOIN u b ON a.graph_id = b.graph_id AND a.superstep = b.superstep AND a.key = b.key AND a.node_id <> b.node_id AND a.w = 1 AND b.w = 1),
r AS (SELECT DISTINCT a.graph_id, a.superstep FROM u a JOIN u b ON a.graph_id = b.graph_id AND a.superstep = b.superstep AND a.key = b.key AND a.node_id <> b.node_id AND a.w = 1 AND b.w = 0),
i AS (SELECT p.graph_id, p.superstep, 'write_conflict' AS kind FROM p SEMI JOIN c USING (graph_id, superstep) WHERE NOT coalesce(next_n = 1 AND next_good = 1, FALSE) UNION ALL SELECT p.graph_id, p.superstep, 'race_condition' FROM p SEMI JOIN r USING (graph_id, superstep)
 UNION ALL SELECT graph_id, superstep, 'missing_join' FROM p WHERE next_n IS NULL OR (next_n > 1 AND next_n >= n) UNION ALL SELECT graph_id, superstep, 'failed_parallel' FROM p WHERE failed > 0 AND good > 0 UNION ALL SELECT graph_id, superstep, 'downstream_failure' FROM p WHERE next_bad > 0
 UNION ALL SELECT t.graph_id, t.superstep, 'state_error_after_parallel' FROM graph_states t WHERE EXISTS (SELECT 1 FROM p WHERE p.graph_id = t.graph_id AND p.superstep < t.superstep) AND ({" OR ".join(f"contains(lower(state), '{w}')" for w in STATE_ERRORS)}))"""


def _finding_sql(issues: str, confidence: str, severity: str) -> str:
    return f"""{issues}, g AS (SELECT graph_id, count(*) AS issues, list_sort(list(DISTINCT kind)) AS k FROM i GROUP BY 1) SELECT n.graph_id, coalesce(issues, 0) AS issues, coalesce(array_to_string(k, ','), '') AS kinds,
CASE WHEN k IS NULL THEN 'none' {severity} END AS severity, round(CASE WHEN k IS NULL THEN 0.85e0 {confidence} END, 4) AS confidence FROM (SELECT DISTINCT graph_id FROM graph_nodes) n LEFT JOIN g ON n.graph_id = g.graph_id"""


def _has(*kinds: str) -> str:
    return f"len(list_intersect(k, {list(kinds)!r})) > 0"


@query("m11_sync_issues", f"{_SYNC} SELECT * FROM i")
def m11_issues(spark, d) -> DataFrame:
    g = graph_runs(spark, d)
    return sync_issues(g["nodes"], g["states"])


@query("m11_parallel_sync", _finding_sql(_SYNC, f"WHEN {_has('failed_parallel', 'downstream_failure')} THEN least(0.9e0, 0.7e0 + issues * 0.05e0) WHEN {_has('write_conflict', 'race_condition')} THEN 0.7e0 WHEN {_has('state_error_after_parallel')} THEN 0.65e0 ELSE 0.6e0", f"WHEN {_has('write_conflict', 'failed_parallel')} THEN 'severe' WHEN {_has('race_condition', 'downstream_failure', 'state_error_after_parallel')} THEN 'moderate' ELSE 'minor'"))
def m11(spark, d) -> DataFrame:
    g = graph_runs(spark, d)
    return sync_findings(sync_issues(g["nodes"], g["states"]), g["nodes"])


def _says(words, column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_GEN = [*GENERIC, *SMALL_WORDS]
_TYPED = " OR ".join(f"(regexp_matches(replace(cond, '==', ' '), '(?:route.to|go.to|send.to|path.to)\\s*(?:{'|'.join(w)})') AND node_type <> '{t}')" for t, w in TYPE_WORDS.items())
_PATTERN = _TEST.replace("'", "''").replace('\\"', '"')
_ROUTE = f"""WITH {GRAPHS}, o AS (SELECT graph_id, node_id, superstep, k AS key, {_TEXT.format("outputs")} AS text FROM (SELECT *, unnest(json_keys(outputs)) AS k FROM graph_nodes)), t AS (SELECT graph_id, superstep, k AS key, {_TEXT.format("state")} AS text FROM (SELECT *, unnest(json_keys(state)) AS k FROM graph_states)),
e AS (SELECT e.*, a.superstep AS step, a.status AS source_status, b.node_type, b.title, b.status AS target_status, b.node_id IS NOT NULL AS known, coalesce(b.status IN {_OK}, FALSE) AS target_ok, edge_type = 'conditional' AS conditional, replace(lower(condition), '_', ' ') AS cond,
 nullif(regexp_extract(condition, '{_PATTERN}', 1), '') AS test_key, nullif(regexp_extract(condition, '{_PATTERN}', 2), '') AS test_value, regexp_extract(condition, '[''"]([^''"]+)[''"]', 1) AS val FROM graph_edges e LEFT JOIN graph_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.source LEFT JOIN graph_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.target),
x AS (SELECT e.*, (SELECT count(*) FROM e f WHERE f.graph_id = e.graph_id AND f.source = e.source AND f.conditional) AS ways, (SELECT bool_and(target_ok) FROM e f WHERE f.graph_id = e.graph_id AND f.source = e.source AND f.conditional) AS all_ok, (SELECT min(target) FROM e f WHERE f.graph_id = e.graph_id AND f.source = e.source AND f.conditional AND f.target_ok) AS ok_target FROM e),
y AS (SELECT x.*, p.text AS own, coalesce(p.text, q.text) AS put_value, CASE WHEN z.graph_id IS NOT NULL THEN h.text ELSE l.text END AS state_value FROM x LEFT JOIN o p ON p.graph_id = x.graph_id AND p.node_id = x.source AND p.key = x.test_key
 LEFT JOIN (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY graph_id, key ORDER BY superstep, node_id) = 1) q ON q.graph_id = x.graph_id AND q.key = x.test_key AND q.superstep <= x.step LEFT JOIN graph_states z ON z.graph_id = x.graph_id AND z.superstep = x.step
 LEFT JOIN t h ON h.graph_id = x.graph_id AND h.superstep = x.step AND h.key = x.test_key LEFT JOIN t l ON l.graph_id = x.graph_id AND l.superstep = x.step + 1 AND l.key = x.test_key WHERE conditional AND test_key IS NOT NULL),
v AS (SELECT DISTINCT graph_id, source FROM y WHERE target_ok AND target = ok_target AND (coalesce(state_value = test_value, FALSE) OR coalesce(own = test_value, FALSE) OR EXISTS (SELECT 1 FROM o WHERE o.graph_id = y.graph_id AND o.superstep <= y.step AND o.key = y.test_key AND o.text = y.test_value))),
c AS (SELECT *, [w for w in regexp_split_to_array(lower(val), '[\\s_-]') if NOT list_contains({_GEN!r}, w)] AS vw, [w for w in [lower(u) for u in regexp_split_to_array(regexp_replace(title, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[\\s_-]')] if NOT list_contains({_GEN!r}, w)] AS tw, regexp_replace(lower(val), '[_-]', '', 'g') AS fv, regexp_replace(lower(title), '[_-]', '', 'g') AS ft FROM x),
i AS (SELECT graph_id, 'missing_target' AS kind, source, target FROM x WHERE target <> '' AND NOT known AND NOT {ENDS!r}.list_contains(target) AND source_status IN {_OK} AND NOT (conditional AND EXISTS (SELECT 1 FROM e f WHERE f.graph_id = x.graph_id AND f.source = x.source AND f.conditional AND f.target <> x.target AND f.target_ok))
 UNION ALL SELECT graph_id, 'condition_mismatch', source, target FROM x WHERE conditional AND known AND condition <> '' AND (({_says(ENDING, "cond")} AND node_type IN {PROCESSING!r}) OR ({_says(GOING_ON, "cond")} AND (node_type IN {ENDS!r} OR {_says(ENDING, "lower(title)")})))
 UNION ALL SELECT graph_id, 'condition_title_mismatch', source, target FROM x WHERE conditional AND known AND condition <> '' AND ({_TYPED})
 UNION ALL SELECT graph_id, 'condition_value_target_mismatch', source, target FROM c WHERE conditional AND target_ok AND title <> '' AND length(val) >= 3 AND NOT lower(val) IN {ANY_VALUE!r} AND NOT contains(ft, fv) AND NOT contains(fv, ft) AND len(vw) > 0 AND len(list_intersect([rtrim(w, 's') for w in vw], [rtrim(w, 's') for w in tw])) = 0
 UNION ALL SELECT n.graph_id, 'dead_end', node_id, NULL FROM graph_nodes n JOIN graph_runs r ON r.graph_id = n.graph_id WHERE NOT EXISTS (SELECT 1 FROM graph_edges e WHERE e.graph_id = n.graph_id AND e.source = n.node_id) AND NOT (node_type IN {ENDS!r} OR lower(title) IN {ENDS!r} OR node_id IN {ENDS!r}) AND NOT (r.status = 'completed' AND superstep >= (SELECT max(superstep) FROM graph_nodes m WHERE m.graph_id = n.graph_id))
 UNION ALL SELECT graph_id, 'unreachable', node_id, NULL FROM graph_nodes n WHERE NOT EXISTS (SELECT 1 FROM graph_edges e WHERE e.graph_id = n.graph_id AND e.target = n.node_id) AND node_id <> (SELECT node_id FROM graph_nodes m WHERE m.graph_id = n.graph_id ORDER BY superstep, node_id LIMIT 1)
 UNION ALL SELECT graph_id, 'state_condition_contradiction', source, target FROM y WHERE target_ok AND state_value <> test_value AND NOT (ways > 1 AND all_ok AND EXISTS (SELECT 1 FROM y f WHERE f.graph_id = y.graph_id AND f.source = y.source AND f.test_key = y.test_key AND f.test_value = y.state_value))
 UNION ALL SELECT graph_id, 'output_condition_contradiction', source, target FROM y WHERE target_ok AND put_value <> test_value AND NOT (ways > 1 AND all_ok AND EXISTS (SELECT 1 FROM y f WHERE f.graph_id = y.graph_id AND f.source = y.source AND f.test_key = y.test_key AND f.test_value = y.put_value))
 UNION ALL SELECT graph_id, 'skipped_conditional', source, target FROM x ANTI JOIN v USING (graph_id, source) WHERE conditional AND ways >= 2 AND target_status = 'skipped' AND ok_target IS NOT NULL)"""
_ROUTE = _ROUTE.replace(f"NOT {ENDS!r}.list_contains(target)", f"target NOT IN {ENDS!r}")


@query("m9_route_issues", f"{_ROUTE} SELECT * FROM i")
def m9_issues(spark, d) -> DataFrame:
    g = graph_runs(spark, d, cut)
    return route_issues(g["nodes"], g["edges"], g["states"], g["runs"])


@query("m9_edge_misroute", _finding_sql(_ROUTE, f"WHEN {_has('missing_target', 'state_condition_contradiction', 'output_condition_contradiction')} THEN least(0.95e0, 0.8e0 + issues * 0.05e0) WHEN {_has('condition_value_target_mismatch')} THEN least(0.92e0, 0.7e0 + issues * 0.08e0) WHEN {_has('condition_title_mismatch', 'skipped_conditional')} THEN least(0.9e0, 0.65e0 + issues * 0.08e0) ELSE least(0.9e0, 0.6e0 + issues * 0.1e0)", f"WHEN {_has('missing_target', 'state_condition_contradiction', 'output_condition_contradiction')} THEN 'severe' WHEN {_has('dead_end', 'condition_title_mismatch', 'condition_value_target_mismatch')} THEN 'moderate' ELSE 'minor'"))
def m9(spark, d) -> DataFrame:
    g = graph_runs(spark, d, cut)
    return route_findings(route_issues(g["nodes"], g["edges"], g["states"], g["runs"]), g["nodes"])
