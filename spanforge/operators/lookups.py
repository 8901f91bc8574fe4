"""Filters, projections and joins of spans, messages, findings and review items."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import ALIASES, PRICES, resolved_model
from ..functions.text import overlap, words
from ..plans.registry import query
from ..sources.adapters import MESSAGES, NOW, PARENTS, PREDICTIONS, SPANS, messages, order, parents, predictions, read, spans


@query("b1_spans_by_kind", f"WITH {SPANS} SELECT trace_id, span_id, name FROM spans WHERE kind = 'tool'")
def b1(spark, d, kind: str = "tool") -> DataFrame:
    return spans(spark, d).filter(F.col("kind") == kind).select("trace_id", "span_id", "name")


@query("b2_roots_and_children", f"WITH {PARENTS} SELECT p.trace_id, p.span_id, count(c.span_id) AS children FROM parents p LEFT JOIN parents c ON c.trace_id = p.trace_id AND c.parent_id = p.span_id WHERE p.parent_id IS NULL GROUP BY 1, 2")
def b2(spark, d) -> DataFrame:
    """Root spans with the number of their children, roots without any included."""
    p = parents(spark, d)
    under = p.filter("parent_id is not null").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count("*").alias("children"))
    return p.filter("parent_id is null").select("trace_id", "span_id").join(under, ["trace_id", "span_id"], "left").fillna(0, ["children"])


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to each given value; a column whose value is None is not asked for."""
    for column, value in wanted.items():
        df = df if value is None else df.filter(F.col(column) == value)
    return df


@query("b5_optional_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def b5(spark, d) -> DataFrame:
    return optional(read(spark, d, "orders"), o_orderstatus="P", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_totalprice")


@query("b6_rows_of_a_page", f"WITH {SPANS}, page AS (SELECT trace_id FROM (SELECT DISTINCT trace_id FROM spans) ORDER BY 1 LIMIT 20) SELECT trace_id, span_id FROM spans WHERE trace_id IN (SELECT trace_id FROM page)")
def b6(spark, d) -> DataFrame:
    """Spans of the traces on the first page, by a semi-join with the page."""
    s = spans(spark, d)
    return s.join(F.broadcast(s.select("trace_id").distinct().orderBy("trace_id").limit(20)), "trace_id", "left_semi").select("trace_id", "span_id")


@query("b9_tagged", "SELECT doc_id FROM documents WHERE list_contains(string_split(source || ',' || lang, ','), 'en')")
def b9(spark, d, tag: str = "en") -> DataFrame:
    tags = F.split(F.concat_ws(",", "source", "lang"), ",")
    return read(spark, d, "documents").filter(F.col("source").isNotNull() & F.col("lang").isNotNull() & F.array_contains(tags, tag)).select("doc_id")


@query("b10_flagged", "SELECT l.doc_id FROM labels l WHERE toxic = 1")
def b10(spark, d) -> DataFrame:
    """Rows whose JSON object of failure flags has the flag set; flags are null where unknown."""
    flags = read(spark, d, "labels").select("doc_id", F.to_json(F.struct((F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 1).alias("quality"))).alias("flags"))
    return flags.filter(F.expr("try_variant_get(try_parse_json(flags), '$.toxic', 'boolean')")).select("doc_id")


@query("b11_default_method", "SELECT coalesce(lang, 'unknown') AS method, count(*) AS n FROM documents GROUP BY 1")
def b11(spark, d) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("method")).agg(F.count("*").alias("n"))


#: Least score of each health tier.
GRADES = ((0.9, "Healthy"), (0.8, "Good"), (0.7, "Needs Attention"), (0.5, "At Risk"))


def grade(score):
    """The first tier whose least score is reached; Critical below all."""
    g = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        g = g.when(score >= least, name)
    return g.otherwise("Critical")


@query("b13_grades", f"SELECT event_id, CASE {' '.join(f'WHEN value / 100 >= {a} THEN {b!r}' for a, b in GRADES)} ELSE 'Critical' END AS grade FROM events")
def b13(spark, d) -> DataFrame:
    return read(spark, d, "events").select("event_id", grade(F.col("value") / 100).alias("grade"))


@query("b15_by_failure_modes", "SELECT l.doc_id, toxic = 1 OR quality = 0 AS any_mode, toxic = 1 AND quality = 0 AS all_modes FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE lang = 'en' AND toxic IS NOT NULL AND quality IS NOT NULL AND (toxic = 1 OR quality = 0)")
def b15(spark, d) -> DataFrame:
    """Records of a framework with any of the failure modes, and whether they have all."""
    modes = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "quality")))
    r = read(spark, d, "labels").filter("toxic is not null and quality is not null").withColumn("modes", modes).join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    wanted = F.array(F.lit("toxic"), F.lit("quality"))
    return r.filter((F.col("lang") == "en") & F.arrays_overlap("modes", wanted)).select("doc_id", F.lit(True).alias("any_mode"), (F.size(F.array_except(wanted, F.col("modes"))) == 0).alias("all_modes"))


@query("c2_feedback_lookup", "SELECT lang, count(*) FILTER (WHERE toxic = 1) AS confirmed, count(*) FILTER (WHERE toxic = 0) AS rejected FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1")
def c2(spark, d) -> DataFrame:
    """Feedback by the type of its detection; feedback on a detection that is gone is skipped."""
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("confirmed"), F.count_if(F.col("toxic") == 0).alias("rejected"))


@query("c3_items_with_state", "SELECT d.doc_id, quality, quality IS NOT NULL AS reviewed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def c3(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("reviewed", F.col("quality").isNotNull())


@query("c5_findings_of_framework", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW' AND l_returnflag = 'R'")
def c5(spark, d) -> DataFrame:
    traces = read(spark, d, "orders").filter("o_orderpriority = '5-LOW'").select("o_orderkey")
    return read(spark, d, "lineitem").filter("l_returnflag = 'R'").join(traces, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber")


@query("c6_truth_with_predictions", f"WITH {PREDICTIONS} SELECT p.mode, count(*) AS n, count(*) FILTER (WHERE p.detected = (l.toxic = 1)) AS hits FROM labels l JOIN predictions p ON l.doc_id = p.record_id WHERE l.toxic IS NOT NULL GROUP BY 1")
def c6(spark, d) -> DataFrame:
    """Ground truth with the prediction of the same record; records without one are skipped."""
    truth = read(spark, d, "labels").filter("toxic is not null").select(F.col("doc_id").alias("record_id"), (F.col("toxic") == 1).alias("toxic"))
    return truth.join(predictions(spark, d), "record_id").groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("detected") == F.col("toxic")).alias("hits"))


@query("c8_prompts_with_baseline", """WITH p AS (SELECT conv_id, turn, sha256(text) AS h FROM conversations WHERE role = 'user'), b AS (SELECT h, min(conv_id) AS base FROM p GROUP BY 1)
SELECT p.conv_id, p.turn, CASE WHEN base < p.conv_id THEN base END AS baseline FROM p LEFT JOIN b ON p.h = b.h""")
def c8(spark, d) -> DataFrame:
    """Prompts with the earliest conversation that holds the same prompt, if it is another."""
    p = read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    base = p.groupBy("h").agg(F.min("conv_id").alias("base"))
    return p.join(base, "h", "left").select("conv_id", "turn", F.when(F.col("base") < F.col("conv_id"), F.col("base")).alias("baseline"))


@query("c13_overlapping_siblings", f"WITH {PARENTS} SELECT a.trace_id, a.span_id AS first_span, b.span_id AS second_span FROM parents a JOIN parents b ON a.trace_id = b.trace_id AND a.parent_id = b.parent_id AND (a.start_time, a.span_id) < (b.start_time, b.span_id) AND b.start_time < a.end_time")
def c13(spark, d) -> DataFrame:
    """Pairs of siblings of which the later starts before the earlier ends."""
    p = parents(spark, d).filter("parent_id is not null").select("trace_id", "parent_id", "span_id", "start_time", "end_time")
    a, b = p.alias("a"), p.alias("b")
    same = (F.col("a.trace_id") == F.col("b.trace_id")) & (F.col("a.parent_id") == F.col("b.parent_id"))
    later = F.struct("a.start_time", "a.span_id") < F.struct("b.start_time", "b.span_id")
    return a.join(b, same & later & (F.col("b.start_time") < F.col("a.end_time"))).select("a.trace_id", F.col("a.span_id").alias("first_span"), F.col("b.span_id").alias("second_span"))


@query("c18_edges_with_both_ends", f"WITH {PARENTS} SELECT e.trace_id, e.parent_id, e.span_id AS child_id, p.status AS parent_status, e.status AS child_status FROM parents e JOIN parents p ON e.trace_id = p.trace_id AND e.parent_id = p.span_id")
def c18(spark, d) -> DataFrame:
    nodes = parents(spark, d).select("trace_id", "span_id", "parent_id", "status")
    up = nodes.select("trace_id", F.col("span_id").alias("parent_id"), F.col("status").alias("parent_status"))
    return nodes.filter("parent_id is not null").join(up, ["trace_id", "parent_id"]).select("trace_id", "parent_id", F.col("span_id").alias("child_id"), "parent_status", F.col("status").alias("child_status"))


@query("c19_redundant_siblings", f"WITH {PARENTS} SELECT a.trace_id, a.span_id AS first_span, b.span_id AS second_span FROM parents a JOIN parents b ON a.trace_id = b.trace_id AND a.parent_id = b.parent_id AND a.span_id < b.span_id AND a.name = b.name AND a.k = b.k")
def c19(spark, d) -> DataFrame:
    """Pairs of siblings with the same work: equal name and input."""
    p = parents(spark, d).filter("parent_id is not null").select("trace_id", "parent_id", "name", "k", "span_id")
    pairs = p.withColumnRenamed("span_id", "first_span").join(p.withColumnRenamed("span_id", "second_span"), ["trace_id", "parent_id", "name", "k"])
    return pairs.filter("first_span < second_span").select("trace_id", "first_span", "second_span")


#: How heavily a parent's failure weighs on its children.
CASCADE = {"click": 0.3, "view": 0.3, "purchase": 0.9, "signup": 0.7, "error": 0.8}


@query("c20_cascading_failures", f"WITH {PARENTS}, w(name, weight) AS (VALUES {', '.join(f'({k!r}, CAST({v} AS DOUBLE))' for k, v in CASCADE.items())}) SELECT c.trace_id, c.span_id, weight FROM parents c JOIN parents p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id JOIN w ON w.name = p.name WHERE p.status = 'error' AND c.status = 'error' AND (p.end_time IS NULL OR c.start_time IS NULL OR p.end_time <= c.start_time)")
def c20(spark, d) -> DataFrame:
    """Failed spans whose failed parent ended before they began; unknown times pass."""
    p = parents(spark, d).filter("status = 'error'")
    weight = p.sparkSession.createDataFrame(list(CASCADE.items()), "name string, weight double")
    up = p.select("trace_id", F.col("span_id").alias("parent_id"), "name", F.col("end_time").alias("ended")).join(F.broadcast(weight), "name")
    passes = F.col("ended").isNull() | F.col("start_time").isNull() | (F.col("ended") <= F.col("start_time"))
    return p.filter("parent_id is not null").select("trace_id", "parent_id", "span_id", "start_time").join(up, ["trace_id", "parent_id"]).filter(passes).select("trace_id", "span_id", "weight")


_MODEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'claude-3-opus-latest' WHEN '2-HIGH' THEN 'GPT-4o-2024-08-06' WHEN '3-MEDIUM' THEN 'gpt-4o-mini-x' WHEN '4-NOT SPECIFIED' THEN 'gemini-pro' ELSE 'other' END"
_SQL_MODEL = "CASE " + " ".join([f"WHEN m = {k!r} THEN {v!r}" for k, v in ALIASES.items()] + [f"WHEN m = {k!r} THEN m" for k in PRICES] + [f"WHEN contains(m, {k!r}) OR contains({k!r}, m) THEN {k!r}" for k in PRICES]) + " ELSE m END"


@query("c21_model_prices", f"""WITH o AS (SELECT o_orderkey, lower({_MODEL}) AS m FROM orders), r AS (SELECT o_orderkey, {_SQL_MODEL} AS model FROM o), p(model, price_in, price_out) AS (VALUES {', '.join(f'({k!r}, CAST({v[0]} AS DOUBLE), CAST({v[1]} AS DOUBLE))' for k, v in PRICES.items())})
SELECT o_orderkey, r.model, price_in, price_out FROM r LEFT JOIN p ON r.model = p.model""")
def c21(spark, d) -> DataFrame:
    """Calls with the price row of their model; the price table is short and fixed."""
    prices = spark.createDataFrame([(k, v[0], v[1]) for k, v in PRICES.items()], "model string, price_in double, price_out double")
    calls = read(spark, d, "orders").select("o_orderkey", resolved_model(F.expr(_MODEL)).alias("model"))
    return calls.join(F.broadcast(prices), "model", "left").select("o_orderkey", "model", "price_in", "price_out")


@query("c23_agent_pairs", f"WITH {SPANS}, a AS (SELECT DISTINCT trace_id, name FROM spans) SELECT x.trace_id, x.name AS first_agent, y.name AS second_agent FROM a x JOIN a y ON x.trace_id = y.trace_id AND x.name < y.name")
def c23(spark, d) -> DataFrame:
    """Every pair of a trace's agents. A trace has few distinct agents, so pairs stay few however many its spans."""
    a = spans(spark, d).select("trace_id", "name").distinct()
    return a.withColumnRenamed("name", "first_agent").join(a.withColumnRenamed("name", "second_agent"), "trace_id").filter("first_agent < second_agent")


_WS = "list_distinct(list_filter(regexp_split_to_array(lower(content), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
_OVER = "CASE WHEN least(len({a}), len({b})) = 0 THEN 0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / least(len({a}), len({b})) END"


@query("c11_duplicate_dispatch", f"""WITH {MESSAGES}, w AS (SELECT *, {_WS} AS ws FROM messages) SELECT a.trace_id, a.msg_id AS first_msg, b.msg_id AS second_msg FROM w a JOIN w b ON a.trace_id = b.trace_id AND a.sender = b.sender AND a.recipient <> b.recipient AND a.msg_id < b.msg_id AND b.ts - a.ts <= 2 AND {_OVER.format(a='a.ws', b='b.ws')} >= 0.7""")
def c11(spark, d, seconds: float = 2, least: float = 0.7) -> DataFrame:
    """Like messages of one sender to different recipients within two seconds."""
    m = messages(spark, d).withColumn("ws", words(F.col("content")))
    a, b = m.alias("a"), m.alias("b")
    on = (F.col("a.trace_id") == F.col("b.trace_id")) & (F.col("a.sender") == F.col("b.sender")) & (F.col("a.recipient") != F.col("b.recipient")) & (F.col("a.msg_id") < F.col("b.msg_id"))
    near = (F.col("b.ts") - F.col("a.ts") <= seconds) & (overlap(F.col("a.ws"), F.col("b.ws")) >= least)
    return a.join(b, on & near).select("a.trace_id", F.col("a.msg_id").alias("first_msg"), F.col("b.msg_id").alias("second_msg"))


@query("c12_relays", f"""WITH {MESSAGES}, w AS (SELECT *, {_WS} AS ws FROM messages) SELECT a.trace_id, a.msg_id AS first_msg, b.msg_id AS relayed FROM w a JOIN w b ON a.trace_id = b.trace_id AND a.recipient = b.sender AND b.ts > a.ts AND b.recipient <> a.sender AND {_OVER.format(a='a.ws', b='b.ws')} >= 0.2""")
def c12(spark, d, least: float = 0.2) -> DataFrame:
    """Messages passed on to a third agent later, with a part of their words."""
    m = messages(spark, d).withColumn("ws", words(F.col("content")))
    a, b = m.alias("a"), m.alias("b")
    on = (F.col("a.trace_id") == F.col("b.trace_id")) & (F.col("a.recipient") == F.col("b.sender")) & (F.col("b.ts") > F.col("a.ts")) & (F.col("b.recipient") != F.col("a.sender"))
    return a.join(b, on & (overlap(F.col("a.ws"), F.col("b.ws")) >= least)).select("a.trace_id", F.col("a.msg_id").alias("first_msg"), F.col("b.msg_id").alias("relayed"))


@query("c15_starved_tasks", f"""WITH p AS (SELECT conv_id, turn, {_WS.replace('content', 'text')} AS ws FROM conversations WHERE role = 'user'), e AS (SELECT conv_id, turn, {_WS.replace('content', 'text')} AS ws FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = p.conv_id AND {_OVER.format(a='p.ws', b='e.ws')} >= 0.5)""")
def c15(spark, d, least: float = 0.5) -> DataFrame:
    """Planned tasks (what the user asks) that nothing carried out shares half its words with."""
    t = read(spark, d, "conversations").select("conv_id", "turn", "role", words(F.col("text")).alias("ws"))
    p, e = t.filter("role = 'user'").alias("p"), t.filter("role = 'assistant'").alias("e")
    return p.join(e, (F.col("p.conv_id") == F.col("e.conv_id")) & (overlap(F.col("p.ws"), F.col("e.ws")) >= least), "left_anti").select("conv_id", "turn")


@query("c17_dropped_facts", """WITH f AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS fact FROM conversations), l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT DISTINCT f.conv_id, fact FROM f JOIN l ON f.conv_id = l.conv_id WHERE f.turn < 2 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.conv_id = f.conv_id AND g.turn = l.last AND g.fact = f.fact)""")
def c17(spark, d) -> DataFrame:
    """Numbers of the first two turns that the last turn no longer has."""
    t = read(spark, d, "conversations")
    facts = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    early = F.flatten(F.collect_list(F.when(F.col("turn") < 2, facts(F.col("text")))))
    per = t.groupBy("conv_id").agg(early.alias("early"), facts(F.max_by("text", "turn")).alias("last"))
    return per.select("conv_id", F.explode(F.array_except("early", "last")).alias("fact"))


@query("b14_active_in_week", f"WITH {SPANS} SELECT name, count(*) AS n FROM spans WHERE start_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND (list_contains(CAST([] AS VARCHAR[]), kind) OR len(CAST([] AS VARCHAR[])) = 0) GROUP BY 1")
def b14(spark, d, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Spans of the platforms that a rule applies to; none named means all."""
    s = spans(spark, d).filter(F.col("start_time") >= F.lit(NOW).cast("timestamp") - F.expr("interval 7 days"))
    return (s.filter(F.col("kind").isin(*kinds)) if kinds else s).groupBy("name").agg(F.count("*").alias("n"))


#: Rules and the kinds of span they apply to; none named means all.
APPLIES = {"loop": (), "cost": ("llm", "agent"), "mcp_protocol": ("tool",), "model_selection": ("llm",), "routing": ("agent", "tool")}


def applicable(s: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """(rule, spans, traces): the spans of ``s`` that each rule applies to, in one pass; a rule without kinds applies to all."""
    names = F.array_compact(F.array(*[F.when(F.col("kind").isin(*kinds), F.lit(r)) if kinds else F.lit(r) for r, kinds in rules.items()]))
    per = s.groupBy("trace_id", "kind").agg(F.count("*").alias("n")).select("trace_id", "n", F.explode(names).alias("rule"))
    return per.groupBy("rule").agg(F.sum("n").alias("spans"), F.count_distinct("trace_id").alias("traces"))


@query("b14_platform_rules", f"WITH {SPANS} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS spans, count(DISTINCT trace_id) AS traces FROM spans" + (f" WHERE kind IN ({', '.join(repr(k) for k in kinds)}) HAVING count(*) > 0" if kinds else " HAVING count(*) > 0") for r, kinds in APPLIES.items()))
def b14_rules(spark, d) -> DataFrame:
    return applicable(spans(spark, d), APPLIES)


@query("e17_next_step", f"WITH {SPANS}, q AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) - 1 AS step FROM spans) SELECT a.trace_id, a.span_id, b.span_id IS NOT NULL AS retried, coalesce(b.status = 'ok', FALSE) AS recovered FROM q a LEFT JOIN q b ON a.trace_id = b.trace_id AND a.name = b.name AND b.step = a.step + 1 WHERE a.status = 'error'")
def e17(spark, d) -> DataFrame:
    """Failed steps, whether the next step runs the same node again, and whether that went well."""
    s = spans(spark, d)
    again = F.coalesce(F.lead("name").over(order()) == F.col("name"), F.lit(False))
    s = s.withColumns({"retried": again, "recovered": F.coalesce(again & (F.lead("status").over(order()) == "ok"), F.lit(False))})
    return s.filter("status = 'error'").select("trace_id", "span_id", "retried", "recovered")


@query("e19_change_runs", f"""WITH {SPANS}, c AS (SELECT *, row_number() OVER w AS i, CASE WHEN lag(name) OVER w <> name THEN 1 ELSE 0 END AS ch FROM spans WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, span_id)),
g AS (SELECT trace_id, i - row_number() OVER (PARTITION BY trace_id ORDER BY i) AS island FROM c WHERE ch = 1) SELECT trace_id, max(n) AS longest FROM (SELECT trace_id, island, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1 HAVING max(n) > 2""")
def e19(spark, d, most: int = 2) -> DataFrame:
    """The longest stretch of steps that each change the route, where it is over two."""
    s = spans(spark, d).withColumn("i", F.row_number().over(order())).withColumn("changed", F.lag("name").over(order()) != F.col("name")).filter("changed")
    island = F.col("i") - F.row_number().over(W.partitionBy("trace_id").orderBy("i"))
    runs = s.withColumn("island", island).groupBy("trace_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("trace_id").agg(F.max("n").alias("longest")).filter(F.col("longest") > most)


@query("e9_recent_gain", f"""WITH {SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time DESC, span_id DESC) AS back FROM spans), g AS (SELECT trace_id, (lag(value) OVER (PARTITION BY trace_id ORDER BY back DESC) - value) / greatest(abs(lag(value) OVER (PARTITION BY trace_id ORDER BY back DESC)), 1e-10) AS gain FROM r WHERE back <= 10)
SELECT trace_id, round(avg(gain), 6) AS gain FROM g GROUP BY 1 HAVING count(gain) > 0""")
def e9(spark, d, last: int = 10) -> DataFrame:
    """Mean relative improvement (fall) of the metric from step to step in the last ten."""
    s = spans(spark, d).withColumn("back", F.row_number().over(W.partitionBy("trace_id").orderBy(F.desc("start_time"), F.desc("span_id")))).filter(F.col("back") <= last)
    before = F.lag("value").over(W.partitionBy("trace_id").orderBy(F.desc("back")))
    return s.withColumn("gain", (before - F.col("value")) / F.greatest(F.abs(before), F.lit(1e-10))).groupBy("trace_id").agg(F.round(F.avg("gain"), 6).alias("gain")).filter("gain is not null")
