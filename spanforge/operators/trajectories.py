"""Trajectories against a reference, required against seen, entangled and subsumed findings, facts passed on, fixes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import ratio
from ..plans.registry import query
from ..sources.adapters import AGENT_SPANS, MODELS, PARENTS, SPANS, agent_spans, order, parents, read, spans
from .detectors import ALL_SQL, detect_all
from .graph import HANDOFFS, connected, cut, handoffs

#: Weights of a trajectory's five scores.
PARTS = {"tool_selection": 0.25, "path_efficiency": 0.20, "completeness": 0.25, "step_ordering": 0.15, "recovery": 0.15}
#: The tools that a task should use, in order.
REFERENCE = ("click", "view", "purchase", "signup")


def trajectory(s: DataFrame, reference: tuple[str, ...] = REFERENCE) -> DataFrame:
    """(trace_id, overall, and the five scores) of each trace's steps against the reference's.

    Tools by F1 of the two sets, length, share of the reference's steps that occur, longest common
    subsequence, and errors that one of the next two steps makes good.
    """
    want = F.array(*[F.lit(x) for x in reference])
    good = lambda i: F.coalesce(F.lead("status", i).over(order()) == "ok", F.lit(False))
    s = s.withColumns({"bad": F.col("status") == "error", "mended": good(1) | good(2), "seq": F.row_number().over(order())})
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"])
    g = s.groupBy("trace_id").agg(in_order.alias("steps"), F.count_if("bad").alias("bad"), F.count_if(F.col("bad") & F.col("mended")).alias("mended"))
    have, n = F.array_distinct("steps"), float(len(reference))
    both = F.size(F.array_intersect(have, want))
    p, r = both / F.size(have), both / float(len(set(reference)))
    covered = F.size(F.filter(want, lambda x: F.array_contains(F.col("steps"), x))) / n
    parts = {
        "tool_selection": ratio(2 * p * r, p + r), "path_efficiency": F.least(F.lit(1.0), n / F.size("steps")), "completeness": covered,
        "step_ordering": R.common_subsequence(want, F.col("steps")) / n, "recovery": F.when(F.col("bad") == 0, 1.0).otherwise(F.col("mended") / F.greatest("bad", F.lit(1))),
    }
    overall = sum((parts[k] * w for k, w in PARTS.items()), F.lit(0.0))
    return g.select("trace_id", F.round(overall, 4).alias("overall"), *[F.round(v, 4).alias(k) for k, v in parts.items()])


@query("l43_trajectory")
def l43(spark, d) -> DataFrame:
    """Its parts but the order of steps are held against SQL by l43_trajectory_parts."""
    return trajectory(spans(spark, d))


_REF = f"{list(REFERENCE)!r}"


@query("l43_trajectory_parts", f"""WITH {SPANS}, q AS (SELECT *, coalesce(lead(status) OVER w = 'ok', FALSE) OR coalesce(lead(status, 2) OVER w = 'ok', FALSE) AS mended FROM spans WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, span_id)), g AS (SELECT trace_id, list_distinct(list(name)) AS have, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS bad, count(*) FILTER (WHERE status = 'error' AND mended) AS mend FROM q GROUP BY 1), f AS (SELECT *, len(list_intersect(have, {_REF})) AS b FROM g)
SELECT trace_id, round(CASE WHEN b = 0 THEN 0 ELSE 2.0 * (b / len(have)) * (b / 4.0) / (b / len(have) + b / 4.0) END, 4) AS tool_selection, round(CAST(least(1.0, 4.0 / n) AS DOUBLE), 4) AS path_efficiency, round(b / 4, 4) AS completeness, round(CASE WHEN bad = 0 THEN 1 ELSE mend / bad END, 4) AS recovery FROM f""")
def l43_parts(spark, d) -> DataFrame:
    return trajectory(spans(spark, d)).select("trace_id", "tool_selection", "path_efficiency", "completeness", "recovery")


#: Share of a co-occurrence that is added, confidence from which a finding triggers, and the most that is added.
BOOST, TRIGGER, MOST = 0.3, 0.6, 0.25


def entangled(findings: DataFrame) -> DataFrame:
    """(trace_id, detector, confidence, adjusted): each detector's confidence (severity in hundredths), raised by what usually comes with it.

    How often one detector is found with another is counted over all traces; a trace's few findings are
    paired in its own row, and the short table of pairs is looked up.
    """
    f = cut(findings.withColumn("confidence", F.col("severity") / 100.0))  # read three times
    per = f.groupBy("trace_id").agg(F.collect_list(F.struct("detector", "detected", "confidence")).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["detector"] != a["detector"]), lambda b: F.struct(a["detector"].alias("i"), b["detector"].alias("j"), a["detected"].alias("a"), b["detected"].alias("b"), a["confidence"].alias("trigger")))))
    each = per.select("trace_id", F.explode(pairs).alias("p")).select("trace_id", "p.*")
    share = each.groupBy("i", "j").agg(ratio(F.count_if(F.col("a") & F.col("b")), F.count_if("a")).alias("share"))
    boost = each.filter(F.col("trigger") >= TRIGGER).join(F.broadcast(share), ["i", "j"]).groupBy("trace_id", F.col("j").alias("detector")).agg(F.least(F.lit(MOST), F.sum(F.col("share") * BOOST * F.col("trigger"))).alias("boost"))
    return f.join(boost, ["trace_id", "detector"], "left").select("trace_id", "detector", "confidence", F.round(F.least(F.lit(1.0), F.col("confidence") + F.coalesce("boost", F.lit(0.0))), 4).alias("adjusted"))


@query("l45_entangled", f"""WITH f AS (SELECT *, severity / 100 AS confidence FROM ({ALL_SQL})), s AS (SELECT a.detector AS i, b.detector AS j, CASE WHEN count(*) FILTER (WHERE a.detected) = 0 THEN 0 ELSE count(*) FILTER (WHERE a.detected AND b.detected) / count(*) FILTER (WHERE a.detected) END AS share FROM f a JOIN f b ON a.trace_id = b.trace_id AND a.detector <> b.detector GROUP BY 1, 2),
b AS (SELECT f.trace_id, j AS detector, least({MOST}, sum(share * {BOOST} * confidence)) AS boost FROM f JOIN s ON s.i = f.detector WHERE confidence >= {TRIGGER} GROUP BY 1, 2) SELECT f.trace_id, f.detector, confidence, round(CAST(least(1.0, confidence + coalesce(boost, 0)) AS DOUBLE), 4) AS adjusted FROM f LEFT JOIN b ON b.trace_id = f.trace_id AND b.detector = f.detector""")
def l45(spark, d) -> DataFrame:
    return entangled(detect_all(agent_spans(spark, d)))


#: Findings that are a symptom where their root is found.
SUBSUMED = (("grounding", "hallucination"), ("loop", "overflow"), ("derailment", "completion"), ("communication", "coordination"), ("context_pressure", "completion"))


def subsumed(findings: DataFrame) -> DataFrame:
    """Findings without the symptoms of roots found in the same trace. A trace's roots are seen in one window, so that nothing is joined."""
    found = F.collect_set(F.when(F.col("detected"), F.col("detector"))).over(W.partitionBy("trace_id"))
    f = findings.withColumn("found", found).filter("detected")
    gone = F.lit(False)
    for root, symptom in SUBSUMED:
        gone = gone | ((F.col("detector") == symptom) & F.array_contains("found", root))
    return f.filter(~gone).drop("found")


@query("l48_subsumed", f"WITH f AS ({ALL_SQL}) SELECT * FROM f WHERE detected AND NOT ({' OR '.join(f'(detector = {b!r} AND EXISTS (SELECT 1 FROM f x WHERE x.trace_id = f.trace_id AND x.detected AND x.detector = {a!r}))' for a, b in SUBSUMED)})")
def l48(spark, d) -> DataFrame:
    return subsumed(detect_all(agent_spans(spark, d)))


@query("l23_tool_provision", f"WITH {SPANS}, r(tool) AS (VALUES ('click'), ('view'), ('search')), t AS (SELECT trace_id, list(DISTINCT name) AS have, list(DISTINCT name) FILTER (WHERE status = 'error') AS failed FROM spans GROUP BY 1) SELECT trace_id, tool AS missing FROM t, r WHERE NOT list_contains(have, tool)")
def l23(spark, d, required: tuple[str, ...] = ("click", "view", "search")) -> DataFrame:
    """Required tools that a trace never used."""
    have = spans(spark, d).groupBy("trace_id").agg(F.collect_set("name").alias("have"))
    return have.select("trace_id", F.explode(F.array_except(F.array(*[F.lit(x) for x in required]), F.col("have"))).alias("missing"))


#: What each role may do.
ROLES = {"tool": ("click", "view"), "llm": ("purchase",), "agent": ("signup", "view")}


@query("l24_role_usurpation", f"WITH {PARENTS}, o AS (SELECT p.trace_id, p.span_id, q.kind AS role, p.name FROM parents p JOIN parents q ON q.trace_id = p.trace_id AND q.span_id = p.parent_id) SELECT trace_id, role, count(*) AS actions, count(*) FILTER (WHERE NOT list_contains(CASE role WHEN 'tool' THEN ['click', 'view'] WHEN 'llm' THEN ['purchase'] ELSE ['signup', 'view'] END, name)) AS outside FROM o GROUP BY 1, 2")
def l24(spark, d) -> DataFrame:
    """Actions outside what the role that opened their task may do."""
    p = parents(spark, d)
    roles = p.select("trace_id", F.col("span_id").alias("parent_id"), F.col("kind").alias("role"))
    allowed = F.create_map(*[x for role, names in ROLES.items() for x in (F.lit(role), F.array(*[F.lit(n) for n in names]))])
    o = p.filter("parent_id is not null").select("trace_id", "parent_id", "name").join(roles, ["trace_id", "parent_id"])
    return o.groupBy("trace_id", "role").agg(F.count("*").alias("actions"), F.count_if(~F.array_contains(allowed[F.col("role")], F.col("name"))).alias("outside"))


@query("l26_quality_gates", f"WITH {SPANS}, g AS (SELECT trace_id, list(DISTINCT 'gate' || (k % 4)) FILTER (WHERE status = 'ok' AND k IS NOT NULL AND value > 90) AS seen FROM spans GROUP BY 1) SELECT trace_id, len(list_filter(['gate0', 'gate1', 'gate2', 'gate3'], lambda x: NOT list_contains(coalesce(seen, []), x))) AS absent FROM g")
def l26(spark, d) -> DataFrame:
    """Required gates that a trace did not pass."""
    seen = F.collect_set(F.when((F.col("status") == "ok") & (F.col("value") > 90) & F.col("k").isNotNull(), F.concat(F.lit("gate"), (F.col("k") % 4).cast("string"))))
    return spans(spark, d).groupBy("trace_id").agg(seen.alias("seen")).select("trace_id", F.size(F.array_except(F.array(*[F.lit(f"gate{i}") for i in range(4)]), F.col("seen"))).cast("long").alias("absent"))


_WS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r\\f]+'), lambda x: length(x) > 4))"


@query("l21_compaction", f"WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS whole, arg_max(text, turn) AS last FROM conversations GROUP BY 1), w AS (SELECT conv_id, {_WS.format(c='whole')} AS a, {_WS.format(c='last')} AS b FROM t) SELECT conv_id, len(a) AS terms, len(a) - len(list_intersect(a, b)) AS lost, round(CASE WHEN len(a) = 0 THEN 0 ELSE (len(a) - len(list_intersect(a, b))) / len(a) END, 6) AS loss FROM w")
def l21(spark, d) -> DataFrame:
    """Words of over four letters that a conversation's last turn, as its summary, has lost."""
    t = read(spark, d, "conversations")
    terms = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[ \t\n\r\f]+"), lambda x: F.length(x) > 4))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    w = t.groupBy("conv_id").agg(whole.alias("whole"), F.max_by("text", "turn").alias("last")).select("conv_id", terms(F.col("whole")).alias("a"), terms(F.col("last")).alias("b"))
    lost = F.size(F.array_except("a", "b")).cast("long")
    return w.select("conv_id", F.size("a").cast("long").alias("terms"), lost.alias("lost"), F.round(ratio(lost, F.size("a")), 6).alias("loss"))


_K20 = f"""WITH {SPANS}, f AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) - 1 AS step, 'owner' || (k % 3) AS entity, CAST(floor(value) AS INTEGER) AS fact, name = 'signup' AS updates FROM spans WHERE k IS NOT NULL)"""


@query("k20_propagation", f"{_K20}, p AS (SELECT a.trace_id, a.entity, a.fact, b.fact AS later FROM f a JOIN f b ON b.trace_id = a.trace_id AND b.entity = a.entity AND b.step >= a.step + 2 AND b.fact <> a.fact AND NOT b.updates AND a.fact <> 0 AND b.fact <> 0 AND greatest(a.fact, b.fact) / least(a.fact, b.fact) < 10) SELECT trace_id, entity, count(*) AS contradictions, count(DISTINCT fact) AS facts FROM p GROUP BY 1, 2")
def k20(spark, d) -> DataFrame:
    """Numbers (of an owner) that a step at least two later gives otherwise, in the same order of magnitude and without a word of an update.

    A trace's equal facts are counted once by step before they are paired, and only within an owner.
    """
    f = spans(spark, d).filter("k is not null").withColumn("step", F.row_number().over(order()) - 1)
    f = f.select("trace_id", "step", F.concat(F.lit("owner"), (F.col("k") % 3).cast("string")).alias("entity"), F.floor("value").cast("int").alias("fact"), (F.col("name") == "signup").alias("updates")).filter("fact <> 0")
    a, b = f.alias("a"), f.filter("not updates").alias("b")
    on = F.expr("a.trace_id = b.trace_id and a.entity = b.entity and b.step >= a.step + 2 and b.fact <> a.fact") & R.same_magnitude(F.col("a.fact"), F.col("b.fact"))
    return a.join(b, on).groupBy("a.trace_id", "a.entity").agg(F.count("*").alias("contradictions"), F.countDistinct("a.fact").alias("facts"))


@query("m3_complexity", f"WITH RECURSIVE {HANDOFFS}, e AS (SELECT DISTINCT trace_id, source, target FROM h), b AS (SELECT trace_id, source AS u, target AS v FROM e UNION SELECT trace_id, target, source FROM e), r(trace_id, node, cur) AS (SELECT DISTINCT trace_id, u, u FROM b UNION SELECT r.trace_id, r.node, b.v FROM r JOIN b ON b.trace_id = r.trace_id AND b.u = r.cur), m AS (SELECT trace_id, node, min(cur) AS root FROM r GROUP BY 1, 2), n AS (SELECT trace_id, count(*) AS nodes, count(DISTINCT root) AS parts FROM m GROUP BY 1), x AS (SELECT n.*, (SELECT count(*) FROM e WHERE e.trace_id = n.trace_id) - nodes + 2 * parts AS cyclomatic FROM n) SELECT trace_id, nodes > 25 AS large, cyclomatic > 10 AS tangled, cyclomatic FROM x")
def m3(spark, d, nodes: int = 25, tangles: int = 10) -> DataFrame:
    """Workflows with too many nodes or independent paths."""
    e = handoffs(spans(spark, d)).select("trace_id", "source", "target").distinct()
    name = lambda c: F.concat_ws("/", "trace_id", c)
    c = connected(e.select(name("source").alias("u"), name("target").alias("v"))).withColumn("trace_id", F.split_part("node", F.lit("/"), F.lit(1)).cast("long"))
    n = c.groupBy("trace_id").agg(F.count("*").alias("nodes"), F.countDistinct("root").alias("parts")).join(e.groupBy("trace_id").agg(F.count("*").alias("edges")), "trace_id")
    paths = F.col("edges") - F.col("nodes") + 2 * F.col("parts")
    return n.select("trace_id", (F.col("nodes") > nodes).alias("large"), (paths > tangles).alias("tangled"), paths.alias("cyclomatic"))


@query("m16_variable_leaks", "SELECT doc_id, list_sort(list_filter([" + ", ".join("CASE WHEN regexp_matches(text, '" + p.replace("'", "''") + f"') THEN '{k}' END" for k, p in R.SECRETS.items() if k != "aws_secret") + "], lambda x: x IS NOT NULL))[1] AS first_kind FROM documents WHERE text IS NOT NULL AND (" + " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for k, p in R.SECRETS.items() if k != "aws_secret") + ")")
def m16(spark, d) -> DataFrame:
    """Outputs that hold a secret, with the first kind by name; the secret itself is not shown."""
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), k) for k, p in R.SECRETS.items() if k != "aws_secret"]))
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.array_sort(kinds).alias("kinds")).filter(F.size("kinds") > 0).select("doc_id", F.col("kinds")[0].alias("first_kind"))


@query("m24_sandbox_escape", f"WITH {AGENT_SPANS} SELECT trace_id, count(*) FILTER (WHERE kind = 'tool' AND name IN ('Write', 'deploy')) AS restricted, count(*) FILTER (WHERE kind = 'tool' AND name IN ('Write', 'deploy') AND status = 'ok') AS escaped FROM spans GROUP BY 1")
def m24(spark, d, restricted: tuple[str, ...] = ("Write", "deploy")) -> DataFrame:
    """Restricted tools called in a sandbox, and calls of them that went through."""
    r = (F.col("kind") == "tool") & F.col("name").isin(*restricted)
    return agent_spans(spark, d).groupBy("trace_id").agg(F.count_if(r).alias("restricted"), F.count_if(r & (F.col("status") == "ok")).alias("escaped"))


@query("p15_execution_quality", f"WITH {SPANS}, n AS (SELECT trace_id, name, count(*) AS runs, count(DISTINCT k % 3) AS shapes, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) AS bad FROM spans GROUP BY 1, 2) SELECT trace_id, round(1 - sum(bad * runs) / sum(runs), 4) AS success, round(coalesce(avg(1.0 / greatest(shapes, 1)) FILTER (WHERE runs >= 2), 1), 4) AS consistency, round(1 - avg(bad), 4) AS reliability FROM n GROUP BY 1")
def p15(spark, d) -> DataFrame:
    """Share of successful runs, how alike a node's outputs (k modulo 3) are over its runs, and one less the mean failure rate of nodes."""
    bad = F.when(F.col("status") == "error", 1.0).otherwise(0.0)
    n = spans(spark, d).groupBy("trace_id", "name").agg(F.count("*").alias("runs"), F.countDistinct(F.col("k") % 3).alias("shapes"), F.avg(bad).alias("bad"))
    alike = F.avg(F.when(F.col("runs") >= 2, 1.0 / F.greatest("shapes", F.lit(1))))
    return n.groupBy("trace_id").agg(F.round(1 - F.sum(F.col("bad") * F.col("runs")) / F.sum("runs"), 4).alias("success"), F.round(F.coalesce(alike, F.lit(1.0)), 4).alias("consistency"), F.round(1 - F.avg("bad"), 4).alias("reliability"))


@query("r8_handoff_assertions", f"WITH {HANDOFFS}, q AS (SELECT *, lead(turn) OVER w - turn AS wait, lead(source) OVER w AS nx FROM h WINDOW w AS (PARTITION BY trace_id ORDER BY turn)) SELECT trace_id, bool_and(coalesce(wait <= 5, TRUE)) AS in_time, bool_and(coalesce(nx = target, TRUE)) AS continuous, count(*) FILTER (WHERE source > target) = 0 AS one_way FROM q GROUP BY 1")
def r8(spark, d, most: int = 5) -> DataFrame:
    """Whether every handoff is followed in time, by the agent handed to, and none goes back."""
    w = W.partitionBy("trace_id").orderBy("turn")
    q = handoffs(spans(spark, d)).withColumns({"wait": F.lead("turn").over(w) - F.col("turn"), "nx": F.lead("source").over(w)})
    return q.groupBy("trace_id").agg(F.bool_and(F.coalesce(F.col("wait") <= most, F.lit(True))).alias("in_time"), F.bool_and(F.coalesce(F.col("nx") == F.col("target"), F.lit(True))).alias("continuous"), (F.count_if(F.col("source") > F.col("target")) == 0).alias("one_way"))


#: The fix that each detector asks for.
FIXES = {
    "loop": "break_loop", "repetition": "switch_strategy", "cost": "escalate", "coordination": "escalate", "hallucination": "escalate", "convergence": "switch_strategy", "overflow": "escalate", "routing": "switch_strategy",
    "escalation_loop": "escalate", "approval_bypass": "escalate", "model_selection": "switch_strategy", "mcp_protocol": "switch_strategy",
}


def fix_of(detector: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FIXES.items() for x in pair])[detector]


@query("s9_healing_plan", f"WITH f AS ({ALL_SQL}), x(detector, fix) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in FIXES.items())}) SELECT trace_id, fix, count(*) AS findings, max(severity) AS worst FROM f JOIN x ON x.detector = f.detector WHERE detected GROUP BY 1, 2")
def s9(spark, d) -> DataFrame:
    """The fixes that a trace's findings ask for, with how many ask and the worst."""
    f = detect_all(agent_spans(spark, d)).filter("detected").withColumn("fix", fix_of(F.col("detector")))
    return f.groupBy("trace_id", "fix").agg(F.count("*").alias("findings"), F.max("severity").alias("worst"))


@query("v10_chain_analysis", f"WITH {PARENTS}, e AS (SELECT c.trace_id, c.name AS cn, p.name AS pn, c.status AS cs, p.status AS ps, c.k AS ck, p.k AS pk FROM parents c JOIN parents p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id) SELECT trace_id, count(*) AS links, count(*) FILTER (WHERE cs = 'error' AND ps = 'error') AS cascades, count(*) FILTER (WHERE cn = pn AND ck = pk) AS repeated FROM e GROUP BY 1")
def v10(spark, d) -> DataFrame:
    """Links of a trace's tasks, failures under failures, and work repeated under itself."""
    p = parents(spark, d)
    up = p.select("trace_id", F.col("span_id").alias("parent_id"), F.col("name").alias("pn"), F.col("status").alias("ps"), F.col("k").alias("pk"))
    e = p.filter("parent_id is not null").join(up, ["trace_id", "parent_id"])
    return e.groupBy("trace_id").agg(F.count("*").alias("links"), F.count_if((F.col("status") == "error") & (F.col("ps") == "error")).alias("cascades"), F.count_if((F.col("name") == F.col("pn")) & (F.col("k") == F.col("pk"))).alias("repeated"))


@query("v14_benchmark_statistics", "SELECT coalesce(source, 'unknown') AS framework, lang AS mode, count(*) AS records, count(*) FILTER (WHERE toxic = 1) AS failures FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2")
def v14(spark, d) -> DataFrame:
    j = read(spark, d, "documents").select("doc_id", "source", "lang").join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return j.groupBy(F.coalesce("source", F.lit("unknown")).alias("framework"), F.col("lang").alias("mode")).agg(F.count("*").alias("records"), F.count_if(F.col("toxic") == 1).alias("failures"))


@query("r3_weekly_report", f"WITH {SPANS} SELECT CAST(date_trunc('week', start_time) AS DATE) AS week, name, count(*) AS alerts FROM spans WHERE status = 'error' AND NOT (k % 10 = 3) OR (k IS NULL AND status = 'error') GROUP BY 1, 2")
def r3(spark, d) -> DataFrame:
    """Alerts of each week by name, without those that a pattern (k ends in 3) suppresses."""
    s = spans(spark, d).filter((F.col("status") == "error") & F.coalesce(F.col("k") % 10 != 3, F.lit(True)))
    return s.groupBy(F.to_date(F.date_trunc("week", "start_time")).alias("week"), "name").agg(F.count("*").alias("alerts"))


@query("k27_models_by_tier", f"WITH {AGENT_SPANS} SELECT model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM spans WHERE kind = 'llm' GROUP BY 1")
def k27_models(spark, d) -> DataFrame:
    """Calls and tokens of each model, which the selection check judges."""
    return agent_spans(spark, d).filter("kind = 'llm'").groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).filter(F.col("model").isin(*MODELS))
