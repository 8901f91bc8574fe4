"""Trace detectors: a finding (trace_id, detector, detected, severity) of each detector for every trace, all from one pass.

Spans are dealt by trace once. Windows mark what a span's neighbours tell, one aggregate by kind, name and
route adds the marks up, short windows over its rows pair routes with their reverse, and one aggregate a trace
gives the features that all severities are read from.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import jaccard, words
from ..plans.registry import query
from ..sources.adapters import AGENT_SPANS, agent_spans

#: How often a name in a row warns and alarms; lengths and repeats of a cycle; share of distinct names.
WARN, ALARM, CYCLES, REPEATS, DIVERSITY = 3, 5, (2, 3, 4, 5), 3, 0.2
#: Spans before a risky action that may approve it, microseconds of a batch, last values of a metric, its least gain, its tolerance and its reversals.
LOOKBACK, BATCH_US, LAST, GAIN, TOLERANCE, REVERSALS = 5, 30_000_000, 10, 0.02, 0.02, 3
#: Route changes and round trips allowed, handlers from which asking around is shopping, alike outputs.
BOUNCES, ROUND_TRIPS, HANDLERS, STALE = 2, 2, 3, 0.7
#: Weights of failure categories; input tokens of small calls and of complex tasks, and tools of these.
WEIGHTS = {"discovery": 20, "schema": 30, "auth": 40, "connection": 25}
SMALL_CALL, COMPLEX_TOKENS, COMPLEX_TOOLS, COMPLEX_TURNS = 200, 5000, 5, 3
#: Spans that a task sorts at a time.
ROWS = 100_000

_ORDER = ("us", "span_id")


def dealt(a: DataFrame) -> DataFrame:
    """Spans dealt by trace to as many tasks as their number asks for, with what the windows need of names, errors and texts in their place."""
    parts = max(a.sparkSession.sparkContext.defaultParallelism, -(-a.count() // ROWS))
    a = a.repartition(parts, "trace_id")
    bad, tool, llm, tier = F.col("status") == "error", F.col("kind") == "tool", F.col("kind") == "llm", R.model_tier(F.col("model"))
    weight = reduce(Column.__add__, [F.when(F.col("error").rlike(R.FAILURES[c]), w).otherwise(0) for c, w in WEIGHTS.items()])
    yes = lambda c: F.coalesce(c, F.lit(False))
    return a.select(
        "trace_id", "span_id", "us", "name", "kind", "value", "tokens", "source", "target", F.when(F.col("kind") == "handoff", F.col("content")).alias("content"), yes(bad).alias("is_bad"), yes(bad & F.col("name").isin("Read", "Glob", "Grep") & F.lower("error").rlike("not found|no such file")).alias("is_file"),
        F.when(tool & bad, weight).otherwise(0).alias("weight"), F.when(llm, R.context_window(F.coalesce("model", F.lit("")))).alias("window"), yes(llm & (tier == "expensive")).alias("is_dear"), yes(llm & (tier == "cheap")).alias("is_cheap"),
        yes((F.col("kind") == "user_input") | F.lower("name").rlike("approval|confirm|authorize|consent")).alias("approves"), yes(tool & R.risk(F.concat_ws(" ", "name", "content")).isNotNull()).alias("is_risk"),
    )


def marked(a: DataFrame) -> DataFrame:
    """Spans with what their neighbours tell. Windows in one order follow each other, so that a task sorts its spans three times."""
    whole, t, tk = W.partitionBy("trace_id"), W.partitionBy("trace_id").orderBy(*_ORDER), W.partitionBy("trace_id", "kind").orderBy(*_ORDER)
    so_far = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    tool = F.col("kind") == "tool"
    approved = F.coalesce(F.max(F.col("approves").cast("int")).over(t.rowsBetween(-LOOKBACK, -1)), F.lit(0)) == 1
    a = dealt(a).withColumns({"seq": F.row_number().over(t), "before": F.lag("value").over(t), "before2": F.lag("value", 2).over(t), "risky": (F.col("is_risk") & ~approved).cast("int")}).drop("approves", "is_risk")
    a = a.withColumns({"rk": F.sum("risky").over(so_far(t)), "apart": F.coalesce(F.col("us") - F.last(F.when(F.col("risky") == 1, F.col("us")), ignorenulls=True).over(t.rowsBetween(W.unboundedPreceding, -1)) > BATCH_US, F.lit(True))})
    a = a.withColumn("batch", F.when(F.col("risky") == 1, F.col("rk") - F.max(F.when((F.col("risky") == 1) & F.col("apart"), F.col("rk"))).over(so_far(t)) + 1)).drop("rk", "apart")
    a = a.withColumns({"n_all": F.count("*").over(whole), "best_seq": F.when(F.col("value") == F.min("value").over(whole), F.col("seq"))})
    late = F.col("seq") > F.col("n_all") - LAST
    a = a.withColumn("late", late).withColumn("scale", F.max(F.when(late, F.abs("value"))).over(whole))
    a = a.withColumns({"tseq": F.row_number().over(tk), "pname": F.lag("name").over(tk)})
    a = a.withColumns({f"c{p}": (tool & (F.col("tseq") > p) & (F.col("tseq") <= p * REPEATS) & (F.lag("name", p).over(tk) == F.col("name"))).cast("int") for p in CYCLES})
    # A run, and a stretch of changes, is as long as the way back to where it began.
    a = a.withColumn("run", F.col("tseq") - F.max(F.when(F.coalesce(F.col("pname") != F.col("name"), F.lit(True)), F.col("tseq"))).over(so_far(tk)) + 1)
    a = a.withColumn("route", F.when(F.col("kind") == "handoff", F.col("target")).when(F.col("kind") == "agent", F.col("name")))
    a = a.withColumn("proute", F.lag("route").over(tk))
    a = a.withColumn("streak", F.when(F.col("route").isNotNull(), F.col("tseq") - F.max(F.when(F.coalesce(F.col("proute") == F.col("route"), F.lit(True)), F.col("tseq"))).over(so_far(tk))))
    pair = W.partitionBy("trace_id", "kind", F.least("source", "target"), F.greatest("source", "target")).orderBy(*_ORDER)
    return a.withColumn("pcontent", F.when(F.col("kind") == "handoff", F.lag("content").over(pair)))


def features(a: DataFrame) -> DataFrame:
    """One row a trace."""
    m = marked(a)
    tool, llm = F.col("kind") == "tool", F.col("kind") == "llm"
    gain = (F.col("before") - F.col("value")) / F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    step = F.col("late") & (F.col("seq") > F.col("n_all") - LAST + 1) & F.col("before").isNotNull()
    turn = (F.col("value") - F.col("before")) * (F.col("before") - F.col("before2")) < 0
    late_turn = F.col("late") & (F.col("seq") > F.col("n_all") - LAST + 2) & turn
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    at = lambda seq: F.max(F.when(F.col("seq") == seq, F.col("value")))
    # No structs or texts among the values, so that they are added up in a hash table without a sort.
    g = m.groupBy("trace_id", "kind", "name", "source", "target", "proute", "route").agg(
        F.count("*").alias("n"), n(F.col("is_bad")).alias("bad"), n(F.col("is_file")).alias("files"), F.max("run").alias("run"), *[F.sum(f"c{p}").alias(f"c{p}") for p in CYCLES],
        F.sum("tokens").alias("tokens"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("risky").alias("risky"), F.max("batch").alias("batch"), F.sum("weight").alias("mcp"),
        n(F.col("is_dear")).alias("dear"), n(F.col("is_dear") & (F.col("tokens") > 0) & (F.col("tokens") < SMALL_CALL)).alias("dear_small"), n(F.col("is_cheap")).alias("cheap"),
        F.max("streak").alias("streak"), n(jaccard(words(F.col("content")), words(F.col("pcontent"))) >= STALE).alias("stale"), F.min("value").alias("best"), F.min("best_seq").alias("best_seq"), at(F.lit(1)).alias("first_value"), at(F.col("n_all")).alias("last_value"),
        at(F.greatest(F.col("n_all") - LAST + 1, F.lit(1))).alias("late_value"), n(turn).alias("turns"), n(late_turn).alias("late_turns"), n(step & (F.col("value") > F.col("before"))).alias("worse"), F.sum(F.when(step, gain)).alias("gain"), n(step & (gain < GAIN)).alias("stalled"), F.max("scale").alias("scale"),
        F.max(F.when(llm & (F.col("tseq") == 1), F.col("window"))).alias("window"),
    )
    ways = lambda a, b: W.partitionBy("trace_id", "kind", F.least(a, b), F.greatest(a, b))
    both = lambda a, b: F.least(F.sum(F.when(F.col(a) < F.col(b), F.col("n")).otherwise(0)).over(ways(a, b)), F.sum(F.when(F.col(a) > F.col(b), F.col("n")).otherwise(0)).over(ways(a, b)))
    handoff = F.col("kind") == "handoff"
    g = g.withColumns({
        "name_n": F.sum("n").over(W.partitionBy("trace_id", "kind", "name")), "calls": F.sum(F.when(tool, F.col("n")).otherwise(0)).over(W.partitionBy("trace_id")),
        "bounced": both("proute", "route"), "trips": F.when(handoff, both("source", "target")),
        "pair_n": F.sum("n").over(ways("source", "target")), "pair_stale": F.sum("stale").over(ways("source", "target")), "handlers": F.when(handoff, F.size(F.collect_set("target").over(W.partitionBy("trace_id", "kind", "source")))),
    })
    kind = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    stuck = (F.col("trips") > ROUND_TRIPS) & (F.col("pair_stale") >= F.floor(F.col("pair_n") / 2))
    routes = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    share = F.col("n") / F.col("calls")
    return g.groupBy("trace_id").agg(
        F.sum("n").alias("n"), *[kind(k).alias(k) for k in ("tool", "llm", "agent", "message", "handoff", "user_input")], F.count_if(tool).alias("tool_names"), F.max(F.when(tool, F.col("run"))).alias("run"), *[F.sum(f"c{p}").alias(f"c{p}") for p in CYCLES],
        F.sum(F.when(tool & (F.col("n") >= 5), F.when(share > 0.5, 25).when(share > 0.3, 15).otherwise(0)).otherwise(0)).alias("repeats"), ((F.max("last_us") - F.min("first_us")) / 60e6).alias("minutes"),
        F.max(F.when(F.col("kind") == "agent", F.col("name_n"))).alias("most_turns"), F.min(F.when(F.col("kind") == "agent", F.col("name_n"))).alias("least_turns"), F.sum("files").alias("files"), F.sum(F.when(tool, F.col("bad")).otherwise(0)).alias("failed"),
        F.sum("risky").alias("risky"), F.max("batch").alias("batch"), F.sum("tokens").alias("tokens"), F.max("window").alias("window"), F.sum("mcp").alias("mcp"), F.sum("dear").alias("dear"), F.sum("dear_small").alias("dear_small"), F.sum("cheap").alias("cheap"),
        F.sum(F.when(llm, F.col("tokens")).otherwise(0)).alias("llm_tokens"), *[f.alias(f"{k}_{c}") for k in ("handoff", "agent") for c, f in (("streak", routes(k, "streak")), ("bounced", routes(k, "bounced")))], F.max(F.when(stuck, F.col("trips"))).alias("stuck"), F.max("handlers").alias("handlers"),
        F.min("best").alias("best"), F.min("best_seq").alias("best_seq"), *[F.max(c).alias(c) for c in ("first_value", "last_value", "late_value")], *[F.sum(c).alias(c) for c in ("turns", "late_turns", "worse", "gain", "stalled")], F.max("scale").alias("scale"),
    )


def c(name: str) -> Column:
    return F.col(name)


def when0(condition: Column, value) -> Column:
    return F.when(condition, value).otherwise(0)


def loop() -> Column:
    """A tool called again and again, a repeated opening pattern, or few distinct tools."""
    cycle = reduce(Column.__or__, [c(f"c{p}") == p * (REPEATS - 1) for p in CYCLES])
    return when0(c("tool") >= WARN, F.when(c("run") >= ALARM, 50).when(c("run") >= WARN, 25).otherwise(0) + when0(cycle, 30) + when0((c("tool") >= 5) & (c("tool_names") / c("tool") < DIVERSITY), 20))


def cost() -> Column:
    return when0(c("llm") > 50, 30) + when0(c("tool") > 100, 25) + when0(c("minutes") > 30, 30)


def coordination() -> Column:
    """Many messages, an agent that dominates, many handoffs; platforms' own rules are not among them."""
    s = when0((c("message") > 20) & (c("message") / c("n") > 0.5), 30) + when0(c("most_turns") > c("least_turns") * 3, 25) + when0(c("handoff") > 10, 30)
    return when0(c("agent") >= 2, s)


def hallucination() -> Column:
    """Files that are not there, and many failed tools."""
    return when0(c("files") >= 3, 40) + when0((c("failed") > 5) & (c("failed") / F.greatest("tool", F.lit(1)) > 0.3), 30)


def approval_bypass() -> Column:
    return 20 * c("risky") + when0(c("batch") >= 2, 15 + (c("batch") - 2) * 5)


def overflow() -> Column:
    """Tokens against the context window of the trace's first model. Shares of the system and of tools, and growth, are not judged."""
    use = c("tokens") / F.coalesce("window", F.lit(R.WINDOWS["default"]))
    return F.when(use >= 0.95, 80).when(use >= 0.85, 60).when(use >= 0.5, 30).otherwise(0)


def convergence() -> Column:
    """A metric to be made small: divergence before thrashing before plateau before regression; a trace that improves on the whole is spared."""
    n, steps = c("n"), F.greatest(F.least(c("n"), F.lit(LAST)) - 1, F.lit(1))
    best, last, first, scale = c("best"), c("last_value"), c("first_value"), F.when(c("scale") == 0, 1.0).otherwise(c("scale"))
    improved = (first - last) / F.greatest(F.abs(first), F.abs(last), F.lit(1e-10))
    smooth = c("turns") / F.greatest(n - 2, F.lit(1)) < 0.6
    fell = F.abs(last - best) / F.when(best == 0, 1.0).otherwise(F.abs(best))
    regression = F.when((n - c("best_seq") > 0) & (last > best * (1 + TOLERANCE)), F.when(fell > 0.1, 85).when(fell > 0.05, 65).when(fell > TOLERANCE, 45).otherwise(25))
    stall = c("stalled") / steps
    plateau = F.when(c("gain") / steps < GAIN, F.when(stall >= 0.9, 65).when(stall >= 0.7, 45).otherwise(25))
    turned = c("late_turns") / F.greatest(steps - 1, F.lit(1))
    thrashing = F.when((n >= 3) & (c("late_turns") >= REVERSALS), F.when(turned >= 0.8, 65).when(turned >= 0.6, 45).otherwise(25))
    wrong, change = c("worse") / steps, last - c("late_value")
    divergence = F.when((n >= 3) & (wrong >= 0.7) & (change > 0), F.when((wrong >= 0.9) & (change / scale > 0.1), 85).when(wrong >= 0.8, 65).otherwise(45))
    spared = (improved > 0.3) & smooth
    plateau = F.when(~((improved > 0.5) & (plateau < 65)), plateau)
    return when0(n >= 3, F.coalesce(divergence, F.when(~spared, thrashing), plateau, F.when(~spared, regression), F.lit(0)))


def routing() -> Column:
    """Stretches of more than two route changes, and routes taken twice there and back. Whether a handler fits its input is not judged."""
    of = lambda name: F.when(c("handoff") > 0, c(f"handoff_{name}")).otherwise(c(f"agent_{name}"))
    long_enough = F.when(c("handoff") > 0, c("handoff")).otherwise(c("agent")) >= 3
    most = F.greatest(when0(of("streak") > BOUNCES, of("streak")), when0(of("bounced") >= 2, of("bounced")))
    return when0(long_enough & (most > 0), 25 + F.least(most * 10, F.lit(40)))


def escalation_loop() -> Column:
    """Round trips of two agents without progress, and one that asks many handlers."""
    s = when0(c("stuck").isNotNull(), F.least(30 + (c("stuck") - ROUND_TRIPS) * 10, F.lit(55))) + when0(c("handlers") >= HANDLERS, F.least(25 + c("handlers") * 8, F.lit(50)))
    return when0(c("handoff") >= 3, s)


def model_selection() -> Column:
    """Dear models for simple tasks or small calls, and cheap ones for complex tasks."""
    simple = (c("llm_tokens") <= SMALL_CALL) & (c("tool") == 0) & (c("user_input") <= 1)
    complex_ = (c("llm_tokens") >= COMPLEX_TOKENS) | (c("tool_names") >= COMPLEX_TOOLS) | (c("user_input") >= COMPLEX_TURNS)
    return F.when(simple, 20 * c("dear")).otherwise(when0(c("llm") > 1, 15 * c("dear_small"))) + when0(complex_, 25 * c("cheap"))


#: Detectors in order: severity from a trace's features, and the range that it is held to.
DETECTORS = {
    "loop": (loop, 0, 100), "repetition": (lambda: c("repeats"), 0, 50), "cost": (cost, 0, 70), "coordination": (coordination, 0, 80), "hallucination": (hallucination, 0, 90), "convergence": (convergence, 10, 90), "overflow": (overflow, 0, 100),
    "routing": (routing, 20, 75), "escalation_loop": (escalation_loop, 30, 75), "approval_bypass": (approval_bypass, 40, 90), "model_selection": (model_selection, 15, 50), "mcp_protocol": (lambda: c("mcp"), 25, 70),
}


def detect_all(a: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(trace_id, detector, detected, severity): a row for each trace and registered detector, or those named. A severity above 0 is held to its detector's range."""

    def one(name: str) -> Column:
        fn, least, most = DETECTORS[name]
        s = F.coalesce(fn(), F.lit(0))
        held = F.when(s > 0, F.greatest(F.lit(least), F.least(F.lit(most), s))).otherwise(0).cast("int")
        return F.struct(F.lit(name).alias("detector"), (held > 0).alias("detected"), held.alias("severity"))

    names = [name for name in DETECTORS if only is None or name in only]
    return features(a).select("trace_id", F.explode(F.array(*[one(name) for name in names])).alias("x")).select("trace_id", "x.*")


def score(findings: DataFrame) -> DataFrame:
    """A trace's severity: the worst finding and five for each further one, fifteen at most; with a level and its three worst findings."""
    worst_first = F.array_sort(F.collect_list(F.when(F.col("detected"), F.struct((-F.col("severity")).alias("s"), "detector"))))
    per = findings.groupBy("trace_id").agg(F.max("severity").alias("worst"), F.count_if("detected").alias("n"), worst_first.alias("found"))
    total = F.when(F.col("n") == 0, 0).otherwise(F.least(F.lit(100), F.col("worst") + F.least(F.lit(15), 5 * (F.col("n") - 1)))).cast("int")
    level = F.when(total >= 80, "severe").when(total >= 60, "critical").when(total >= 40, "problematic").when(total >= 20, "warning").otherwise("healthy")
    top = F.array_join(F.transform(F.slice("found", 1, 3), lambda x: x["detector"]), ",")
    return per.select("trace_id", F.col("n").alias("findings"), total.alias("severity"), level.alias("level"), top.alias("top"))


# The SQL that each detector's rows are held against, written apart from the pass above.

_T = "(PARTITION BY trace_id ORDER BY us, span_id)"
_TRACES = "traces AS (SELECT trace_id, count(*) AS n FROM spans GROUP BY 1)"
_K = lambda kind: f"count(*) FILTER (WHERE kind = '{kind}')"
_TOOLS = f"t AS (SELECT *, row_number() OVER {_T} - 1 AS seq FROM spans WHERE kind = 'tool')"
_RISK = "regexp_matches(name || ' ' || content, '(?i)" + "|".join(R.RISKS) + "')"
_WS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
_WINDOW = "CASE " + " ".join([f"WHEN model = '{k}' THEN {v}" for k, v in R.WINDOWS.items()] + [f"WHEN contains(model, '{k}') THEN {v}" for k, v in R.WINDOWS.items()]) + " ELSE 128000 END"

#: For each detector common tables, the last of which, v, has (trace_id, v): the severity before it is held to its range.
BODIES = {
    "loop": f"""{_TOOLS}, m AS (SELECT *, CASE WHEN lag(name) OVER {_T} = name THEN 0 ELSE 1 END AS ch FROM t), r AS (SELECT *, sum(ch) OVER {_T} AS run FROM m), l AS (SELECT trace_id, max(c) AS run FROM (SELECT trace_id, run, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT trace_id, list(name ORDER BY us, span_id) AS ns, count(*) AS n, count(DISTINCT name) AS names FROM t GROUP BY 1), k AS (SELECT *, {' OR '.join(f'(n >= {3 * p} AND ns[1:{p}] = ns[{p + 1}:{2 * p}] AND ns[1:{p}] = ns[{2 * p + 1}:{3 * p}])' for p in CYCLES)} AS cyc FROM a),
v AS (SELECT k.trace_id, CASE WHEN n < 3 THEN 0 ELSE CASE WHEN run >= 5 THEN 50 WHEN run >= 3 THEN 25 ELSE 0 END + CASE WHEN cyc THEN 30 ELSE 0 END + CASE WHEN n >= 5 AND CAST(names AS DOUBLE) / n < 0.2 THEN 20 ELSE 0 END END AS v FROM k JOIN l ON k.trace_id = l.trace_id)""",
    "repetition": "e AS (SELECT trace_id, name, count(*) AS c FROM spans WHERE kind = 'tool' GROUP BY 1, 2), s AS (SELECT *, c / sum(c) OVER (PARTITION BY trace_id) AS p FROM e), v AS (SELECT trace_id, sum(CASE WHEN c >= 5 AND p > 0.5 THEN 25 WHEN c >= 5 AND p > 0.3 THEN 15 ELSE 0 END) AS v FROM s GROUP BY 1)",
    "cost": f"v AS (SELECT trace_id, CASE WHEN {_K('llm')} > 50 THEN 30 ELSE 0 END + CASE WHEN {_K('tool')} > 100 THEN 25 ELSE 0 END + CASE WHEN max(us) - min(us) > 1800000000 THEN 30 ELSE 0 END AS v FROM spans GROUP BY 1)",
    "coordination": f"g AS (SELECT trace_id, max(n) AS most, min(n) AS fewest, sum(n) AS n FROM (SELECT trace_id, name, count(*) AS n FROM spans WHERE kind = 'agent' GROUP BY 1, 2) GROUP BY 1), o AS (SELECT trace_id, {_K('message')} AS m, {_K('handoff')} AS h, count(*) AS n FROM spans GROUP BY 1), v AS (SELECT g.trace_id, CASE WHEN g.n < 2 THEN 0 ELSE CASE WHEN m > 20 AND m / o.n > 0.5 THEN 30 ELSE 0 END + CASE WHEN most > fewest * 3 THEN 25 ELSE 0 END + CASE WHEN h > 10 THEN 30 ELSE 0 END END AS v FROM g JOIN o ON o.trace_id = g.trace_id)",
    "hallucination": "q AS (SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS bad, count(*) FILTER (WHERE status = 'error' AND name IN ('Read', 'Glob', 'Grep') AND regexp_matches(lower(error), 'not found|no such file')) AS files FROM spans WHERE kind = 'tool' GROUP BY 1), v AS (SELECT trace_id, CASE WHEN files >= 3 THEN 40 ELSE 0 END + CASE WHEN bad > 5 AND bad / n > 0.3 THEN 30 ELSE 0 END AS v FROM q)",
    "convergence": f"""q AS (SELECT *, row_number() OVER {_T} - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS n, lag(value) OVER {_T} AS p, lag(value, 2) OVER {_T} AS pp FROM spans), r AS (SELECT *, i >= n - 10 AS late, i > n - 10 AND p IS NOT NULL AS step, i > n - 9 AND (value - p) * (p - pp) < 0 AS late_turn, max(abs(value)) FILTER (WHERE i >= n - 10) OVER (PARTITION BY trace_id) AS sc FROM q),
f AS (SELECT trace_id, max(n) AS n, min(value) AS best, arg_min(i, (value, i)) AS best_i, arg_min(value, i) AS first, arg_max(value, i) AS last, arg_min(value, i) FILTER (WHERE late) AS late_first, count(*) FILTER (WHERE (value - p) * (p - pp) < 0) AS turns, count(*) FILTER (WHERE late_turn) AS lt, count(*) FILTER (WHERE step) AS steps, count(*) FILTER (WHERE step AND value > p) AS worse, avg((p - value) / CASE WHEN sc = 0 THEN 1 ELSE sc END) FILTER (WHERE step) AS gain, count(*) FILTER (WHERE step AND (p - value) / CASE WHEN sc = 0 THEN 1 ELSE sc END < 0.02) AS stalled, max(CASE WHEN sc = 0 THEN 1 ELSE sc END) AS sc FROM r GROUP BY 1),
h AS (SELECT *, (first - last) / greatest(abs(first), abs(last), 1e-10) AS improved, turns / greatest(n - 2, 1) < 0.6 AS smooth, abs(last - best) / CASE WHEN best = 0 THEN 1 ELSE abs(best) END AS fell FROM f),
d AS (SELECT *, CASE WHEN n - 1 - best_i > 0 AND last > best * 1.02 THEN CASE WHEN fell > 0.1 THEN 85 WHEN fell > 0.05 THEN 65 WHEN fell > 0.02 THEN 45 ELSE 25 END END AS regression, CASE WHEN gain < 0.02 THEN CASE WHEN stalled / steps >= 0.9 THEN 65 WHEN stalled / steps >= 0.7 THEN 45 ELSE 25 END END AS plateau, CASE WHEN lt >= 3 THEN CASE WHEN lt / greatest(steps - 1, 1) >= 0.8 THEN 65 WHEN lt / greatest(steps - 1, 1) >= 0.6 THEN 45 ELSE 25 END END AS thrashing,
 CASE WHEN worse / steps >= 0.7 AND last > late_first THEN CASE WHEN worse / steps >= 0.9 AND (last - late_first) / sc > 0.1 THEN 85 WHEN worse / steps >= 0.8 THEN 65 ELSE 45 END END AS divergence, improved > 0.3 AND smooth AS spared FROM h WHERE n >= 3),
v AS (SELECT trace_id, coalesce(divergence, CASE WHEN NOT spared THEN thrashing END, CASE WHEN NOT (improved > 0.5 AND plateau < 65) THEN plateau END, CASE WHEN NOT spared THEN regression END, 0) AS v FROM d)""",
    "overflow": f"w AS (SELECT trace_id, coalesce(arg_min(model, (us, span_id)) FILTER (WHERE kind = 'llm'), '') AS model, sum(tokens) AS t FROM spans GROUP BY 1), u AS (SELECT trace_id, t / ({_WINDOW}) AS u FROM w), v AS (SELECT trace_id, CASE WHEN u >= 0.95 THEN 80 WHEN u >= 0.85 THEN 60 WHEN u >= 0.5 THEN 30 ELSE 0 END AS v FROM u)",
    "routing": f"""h AS (SELECT trace_id, us, span_id, CASE kind WHEN 'handoff' THEN target ELSE name END AS route FROM spans s WHERE kind = 'handoff' OR (kind = 'agent' AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.trace_id = s.trace_id AND x.kind = 'handoff'))), q AS (SELECT *, lag(route) OVER {_T} AS p, count(*) OVER (PARTITION BY trace_id) AS n FROM h), s AS (SELECT *, sum(CASE WHEN p <> route THEN 0 ELSE 1 END) OVER {_T} AS grp FROM q WHERE n >= 3),
r AS (SELECT trace_id, max(n) AS changes FROM (SELECT trace_id, grp, count(*) FILTER (WHERE p <> route) AS n FROM s GROUP BY 1, 2) GROUP BY 1), c AS (SELECT trace_id, p, route, count(*) AS n FROM s WHERE p <> route GROUP BY 1, 2, 3), b AS (SELECT c.trace_id, max(least(c.n, d.n)) AS trips FROM c JOIN c d ON d.trace_id = c.trace_id AND d.p = c.route AND d.route = c.p GROUP BY 1), w AS (SELECT r.trace_id, greatest(CASE WHEN changes > 2 THEN changes ELSE 0 END, CASE WHEN trips >= 2 THEN trips ELSE 0 END) AS most FROM r LEFT JOIN b ON b.trace_id = r.trace_id), v AS (SELECT trace_id, CASE WHEN most > 0 THEN 25 + least(most * 10, 40) ELSE 0 END AS v FROM w)""",
    "escalation_loop": f"""h AS (SELECT *, {_WS.format(c='content')} AS ws FROM spans WHERE kind = 'handoff'), p AS (SELECT *, lag(ws) OVER (PARTITION BY trace_id, least(source, target), greatest(source, target) ORDER BY us, span_id) AS pw FROM h), g AS (SELECT trace_id, least(source, target) AS a, greatest(source, target) AS b, count(*) AS n, least(count(*) FILTER (WHERE source < target), count(*) FILTER (WHERE source > target)) AS trips, count(*) FILTER (WHERE pw IS NOT NULL AND len(list_intersect(ws, pw)) / len(list_distinct(list_concat(ws, pw))) >= 0.7) AS stale FROM p GROUP BY 1, 2, 3),
r AS (SELECT trace_id, max(trips) FILTER (WHERE trips > 2 AND stale >= n // 2) AS stuck, sum(n) AS n FROM g GROUP BY 1), s AS (SELECT trace_id, max(c) AS handlers FROM (SELECT trace_id, source, count(DISTINCT target) AS c FROM h GROUP BY 1, 2) GROUP BY 1), v AS (SELECT r.trace_id, CASE WHEN n < 3 THEN 0 ELSE CASE WHEN stuck IS NULL THEN 0 ELSE least(30 + (stuck - 2) * 10, 55) END + CASE WHEN handlers >= 3 THEN least(25 + handlers * 8, 50) ELSE 0 END END AS v FROM r JOIN s ON s.trace_id = r.trace_id)""",
    "approval_bypass": f"""q AS (SELECT *, coalesce(max(CASE WHEN kind = 'user_input' OR regexp_matches(lower(name), 'approval|confirm|authorize|consent') THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY us, span_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS ok FROM spans), u AS (SELECT * FROM q WHERE kind = 'tool' AND ok = 0 AND {_RISK}), p AS (SELECT *, CASE WHEN us - lag(us) OVER {_T} <= 30000000 THEN 0 ELSE 1 END AS gap FROM u), b AS (SELECT *, sum(gap) OVER {_T} AS grp FROM p), m AS (SELECT trace_id, sum(n) AS n, max(n) AS batch FROM (SELECT trace_id, grp, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1), v AS (SELECT trace_id, 20 * n + CASE WHEN batch >= 2 THEN 15 + (batch - 2) * 5 ELSE 0 END AS v FROM m)""",
    "model_selection": f"""l AS (SELECT *, CASE WHEN regexp_matches(model, 'opus|o1|o3') OR regexp_matches(model, 'gpt-4(-turbo)?(-[0-9]+)?$') THEN 'expensive' WHEN contains(model, 'sonnet') OR (contains(model, 'gpt-4o') AND NOT contains(model, 'gpt-4o-mini')) OR regexp_matches(model, 'gemini[- ]([0-9]+\\.?[0-9]*[- ])?pro') THEN 'mid' WHEN regexp_matches(model, 'haiku|gpt-4o-mini|gemini[- ]([0-9]+\\.?[0-9]*[- ])?flash|gpt-3\\.5') THEN 'cheap' END AS tier FROM spans),
t AS (SELECT trace_id, {_K('llm')} AS llm, {_K('tool')} AS tools, count(DISTINCT name) FILTER (WHERE kind = 'tool') AS names, {_K('user_input')} AS turns, coalesce(sum(tokens) FILTER (WHERE kind = 'llm'), 0) AS tokens, count(*) FILTER (WHERE tier = 'expensive') AS dear, count(*) FILTER (WHERE tier = 'expensive' AND tokens > 0 AND tokens < 200) AS small, count(*) FILTER (WHERE tier = 'cheap') AS cheap FROM l GROUP BY 1), v AS (SELECT trace_id, CASE WHEN tokens <= 200 AND tools = 0 AND turns <= 1 THEN 20 * dear WHEN llm > 1 THEN 15 * small ELSE 0 END + CASE WHEN tokens >= 5000 OR names >= 5 OR turns >= 3 THEN 25 * cheap ELSE 0 END AS v FROM t)""",
    "mcp_protocol": "v AS (SELECT trace_id, sum(" + " + ".join("CASE WHEN regexp_matches(error, '" + R.FAILURES[k].replace("'", "''") + f"') THEN {w} ELSE 0 END" for k, w in WEIGHTS.items()) + ") AS v FROM spans WHERE kind = 'tool' AND status = 'error' GROUP BY 1)",
}


def sql_of(name: str) -> str:
    _, least, most = DETECTORS[name]
    s = f"CAST(CASE WHEN coalesce(v, 0) > 0 THEN greatest({least}, least({most}, v)) ELSE 0 END AS INTEGER)"
    return f"WITH {AGENT_SPANS}, {_TRACES}, {BODIES[name]} SELECT traces.trace_id, '{name}' AS detector, {s} > 0 AS detected, {s} AS severity FROM traces LEFT JOIN v ON v.trace_id = traces.trace_id"


ALL_SQL = " UNION ALL ".join(f"SELECT * FROM ({sql_of(name)})" for name in DETECTORS)

NUMBERS = {"loop": "k1", "repetition": "k2", "cost": "k3", "coordination": "k4", "hallucination": "k5", "convergence": "k17", "overflow": "k18", "routing": "k19", "escalation_loop": "k22", "approval_bypass": "k26", "model_selection": "k27", "mcp_protocol": "k28"}

for _name, _number in NUMBERS.items():

    def _one(spark, d, name=_name) -> DataFrame:
        return detect_all(agent_spans(spark, d), [name])

    query(f"{_number}_{_name}", sql_of(_name))(_one)


@query("k33_orchestrate", ALL_SQL)
def k33(spark, d) -> DataFrame:
    return detect_all(agent_spans(spark, d))


@query("k34_score", f"""WITH f AS ({ALL_SQL}), p AS (SELECT trace_id, max(severity) AS worst, count(*) FILTER (WHERE detected) AS n, coalesce(array_to_string(list(detector ORDER BY severity DESC, detector) FILTER (WHERE detected)[1:3], ','), '') AS top FROM f GROUP BY 1),
t AS (SELECT trace_id, n AS findings, CAST(CASE WHEN n = 0 THEN 0 ELSE least(100, worst + least(15, 5 * (n - 1))) END AS INTEGER) AS severity, top FROM p) SELECT trace_id, findings, severity, CASE WHEN severity >= 80 THEN 'severe' WHEN severity >= 60 THEN 'critical' WHEN severity >= 40 THEN 'problematic' WHEN severity >= 20 THEN 'warning' ELSE 'healthy' END AS level, top FROM t""")
def k34(spark, d) -> DataFrame:
    """Every trace's score over all detectors."""
    return score(detect_all(agent_spans(spark, d)))


@query("p19_smoke_aggregate", f"WITH f AS ({ALL_SQL}) SELECT detector, count(*) FILTER (WHERE detected) AS n, round(coalesce(avg(severity) FILTER (WHERE detected), 0), 4) AS mean, max(severity) AS worst, count(*) FILTER (WHERE severity >= 60) AS critical FROM f GROUP BY 1")
def p19(spark, d) -> DataFrame:
    f = detect_all(agent_spans(spark, d))
    return f.groupBy("detector").agg(F.count_if("detected").alias("n"), F.round(F.coalesce(F.avg(F.when(F.col("detected"), F.col("severity"))), F.lit(0.0)), 4).alias("mean"), F.max("severity").alias("worst"), F.count_if(F.col("severity") >= 60).alias("critical"))
