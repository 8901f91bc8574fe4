"""Coordination of agents through messages (trace_id, msg_id, sender, recipient, content, ts): one check a function, and all of them together."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import overlap, words
from ..plans.registry import query
from ..sources.adapters import DISPATCHES, dispatches

#: Seconds of a conflict, a duplicate, a rapid change and a slow reply; messages of a pair; shares of words.
CONFLICT_S, DUPLICATE_S, RAPID_S, SLOW_S, PAIR_MESSAGES, DUPLICATE, RELAY, LOST = 5.0, 2.0, 3.0, 10.0, 8, 0.7, 0.2, 0.2
#: Opposing verbs, words that call an instruction back, verbs that claim a resource, phrases that ask again.
OPPOSED = (
    (("update", "set", "change", "enable", "activate", "start", "add"), ("delete", "remove", "disable", "deactivate", "stop", "drop")),
    (("create", "insert", "save", "write", "open"), ("delete", "remove", "destroy", "close", "drop")),
    (("lock",), ("unlock",)),
    (("approve", "accept"), ("reject", "deny", "decline")),
)
CALLED_BACK = ("cancel", "instead", "disregard", "ignore", "scratch", "stop", "abort", "nevermind", "never mind", "actually")
CLAIMS = ("acquire", "allocate", "claim", "lock", "reserve", "write")
ASKED_AGAIN = "please provide|requesting|still waiting|no .* received|where is|send me|need the|waiting for"


def long_words(text: Column, least: int) -> Column:
    return F.filter(words(text), lambda w: F.length(w) > least)


def two(m: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    keep = ["trace_id", "msg_id", "sender", "recipient", "ts", *columns]
    return m.select(*keep).alias("a"), m.select(*keep).alias("b")


def pair(df: DataFrame) -> DataFrame:
    return df.select(F.col("a.trace_id"), F.col("a.msg_id").alias("first_msg"), F.col("b.msg_id").alias("second_msg"))


SAME_TRACE = "a.trace_id = b.trace_id"
_WS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r\\f]+'), lambda x: len(x) > {n}))"
_OVER = "CASE WHEN least(len({a}), len({b})) = 0 THEN 0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / least(len({a}), len({b})) END"
_M = f"WITH {DISPATCHES}"
_PAIR = "SELECT a.trace_id, a.msg_id AS first_msg, b.msg_id AS second_msg"


def ignored(m: DataFrame) -> DataFrame:
    """Messages after which the recipient wrote nothing."""
    last = m.groupBy("trace_id", F.col("sender").alias("recipient")).agg(F.max("ts").alias("last"))
    return m.join(last, ["trace_id", "recipient"], "left").filter(F.coalesce(F.col("last") <= F.col("ts"), F.lit(True))).select("trace_id", "msg_id")


@query("w_ignored_messages", f"{_M} SELECT trace_id, msg_id FROM messages a WHERE NOT EXISTS (SELECT 1 FROM messages b WHERE {SAME_TRACE} AND b.sender = a.recipient AND b.ts > a.ts)")
def w_ignored(spark, d) -> DataFrame:
    return ignored(dispatches(spark, d))


def lost(m: DataFrame) -> DataFrame:
    """Messages whose recipient later asks for what they said."""
    m = m.withColumn("ws", long_words(F.col("content"), 4))
    a, _ = two(m, "ws")
    _, b = two(m.filter(F.lower("content").rlike(ASKED_AGAIN)), "ws")
    on = F.expr(f"{SAME_TRACE} and b.sender = a.recipient and b.ts > a.ts") & (overlap(F.col("a.ws"), F.col("b.ws")) > LOST)
    return a.join(b, on, "left_semi").select("trace_id", "msg_id")


@query("w_lost_messages", f"{_M}, w AS (SELECT *, {_WS.format(c='content', n=4)} AS ws FROM messages) SELECT trace_id, msg_id FROM w a WHERE EXISTS (SELECT 1 FROM w b WHERE {SAME_TRACE} AND b.sender = a.recipient AND b.ts > a.ts AND regexp_matches(lower(b.content), '{ASKED_AGAIN}') AND {_OVER.format(a='a.ws', b='b.ws')} > {LOST})")
def w_lost(spark, d) -> DataFrame:
    return lost(dispatches(spark, d))


def partners(m: DataFrame) -> DataFrame:
    """(trace_id, agent, reached, addressed_by, partners, agents) for every agent of a trace."""
    ends = m.select("trace_id", F.explode(F.array(F.struct(F.col("sender").alias("agent"), F.col("recipient").alias("to"), F.lit(None).cast("string").alias("by")), F.struct(F.col("recipient").alias("agent"), F.lit(None).cast("string").alias("to"), F.col("sender").alias("by")))).alias("x")).select("trace_id", "x.*")
    each = ends.distinct().groupBy("trace_id", "agent").agg(F.countDistinct("to").alias("reached"), F.countDistinct("by").alias("addressed_by"), F.countDistinct(F.coalesce("to", "by")).alias("partners"))
    return each.withColumn("agents", F.count("*").over(W.partitionBy("trace_id")))


_P = "e AS (SELECT DISTINCT trace_id, sender, recipient FROM messages), p AS (SELECT trace_id, agent, count(DISTINCT t) AS reached, count(DISTINCT f) AS addressed_by, count(DISTINCT coalesce(t, f)) AS partners FROM (SELECT trace_id, sender AS agent, recipient AS t, NULL AS f FROM e UNION ALL SELECT trace_id, recipient, NULL, sender FROM e) GROUP BY 1, 2), q AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS agents FROM p)"


def limited(m: DataFrame) -> DataFrame:
    """Agents that write to under half of the others; those that one other addresses at most are links of a chain."""
    p = partners(m)
    return p.filter((F.col("reached") > 0) & (F.col("addressed_by") > 1) & (F.col("agents") > 2) & (F.col("reached") < (F.col("agents") - 1) * 0.5)).select("trace_id", "agent")


@query("w_limited_communication", f"{_M}, {_P} SELECT trace_id, agent FROM q WHERE reached > 0 AND addressed_by > 1 AND agents > 2 AND reached < (agents - 1) * 0.5")
def w_limited(spark, d) -> DataFrame:
    return limited(dispatches(spark, d))


@query("l4_pipeline_topology", f"{_M}, {_P} SELECT trace_id, count(*) >= 3 AND count(*) FILTER (WHERE partners <= 2) >= count(*) * 0.6 AS pipeline FROM q GROUP BY 1")
def l4(spark, d) -> DataFrame:
    """Whether most agents of a trace have two partners at most."""
    n = F.count("*")
    return partners(dispatches(spark, d)).groupBy("trace_id").agg(((n >= 3) & (F.count_if(F.col("partners") <= 2) >= n * 0.6)).alias("pipeline"))


def back_and_forth(m: DataFrame) -> DataFrame:
    ends = m.groupBy("trace_id", F.least("sender", "recipient").alias("first_agent"), F.greatest("sender", "recipient").alias("second_agent"))
    return ends.agg(F.count("*").alias("n")).filter(F.col("n") > PAIR_MESSAGES)


@query("w_back_and_forth", f"{_M} SELECT trace_id, least(sender, recipient) AS first_agent, greatest(sender, recipient) AS second_agent, count(*) AS n FROM messages GROUP BY 1, 2, 3 HAVING count(*) > {PAIR_MESSAGES}")
def w_back_and_forth(spark, d) -> DataFrame:
    return back_and_forth(dispatches(spark, d))


def conflicting(m: DataFrame) -> DataFrame:
    """Opposed instructions of two senders to one recipient within five seconds."""
    has = lambda some: F.arrays_overlap(words(F.col("content")), F.array(*[F.lit(w) for w in some]))
    m = m.withColumns({f"{side}{i}": has(some) for i, pair_ in enumerate(OPPOSED) for side, some in zip("pn", pair_, strict=True)})
    flags = [f"{side}{i}" for i in range(len(OPPOSED)) for side in "pn"]
    a, b = two(m.filter(reduce(Column.__or__, [F.col(f) for f in flags])), *flags)
    opposed = " or ".join(f"(a.p{i} and b.n{i}) or (a.n{i} and b.p{i})" for i in range(len(OPPOSED)))
    return pair(a.join(b, F.expr(f"{SAME_TRACE} and a.recipient = b.recipient and a.sender <> b.sender and a.msg_id < b.msg_id and abs(b.ts - a.ts) <= {CONFLICT_S} and ({opposed})")))


def _flags() -> str:
    return ", ".join(f"len(list_intersect(ws, {list(some)!r})) > 0 AS {side}{i}" for i, pair_ in enumerate(OPPOSED) for side, some in zip("pn", pair_, strict=True))


_OPPOSED = " OR ".join(f"(a.p{i} AND b.n{i}) OR (a.n{i} AND b.p{i})" for i in range(len(OPPOSED)))


@query("w_conflicting_instructions", f"{_M}, w AS (SELECT *, {_WS.format(c='content', n=0)} AS ws FROM messages), f AS (SELECT *, {_flags()} FROM w) {_PAIR} FROM f a JOIN f b ON {SAME_TRACE} AND a.recipient = b.recipient AND a.sender <> b.sender AND a.msg_id < b.msg_id AND abs(b.ts - a.ts) <= {CONFLICT_S} AND ({_OPPOSED})")
def w_conflicting(spark, d) -> DataFrame:
    return conflicting(dispatches(spark, d))


def duplicates(m: DataFrame) -> DataFrame:
    """Like messages of one sender to two recipients within two seconds."""
    a, b = two(m.withColumn("ws", words(F.col("content"))), "ws")
    on = F.expr(f"{SAME_TRACE} and a.sender = b.sender and a.recipient <> b.recipient and a.msg_id < b.msg_id and abs(b.ts - a.ts) <= {DUPLICATE_S}")
    return pair(a.join(b, on & (overlap(F.col("a.ws"), F.col("b.ws")) >= DUPLICATE)))


@query("w_duplicate_dispatch", f"{_M}, w AS (SELECT *, {_WS.format(c='content', n=0)} AS ws FROM messages) {_PAIR} FROM w a JOIN w b ON {SAME_TRACE} AND a.sender = b.sender AND a.recipient <> b.recipient AND a.msg_id < b.msg_id AND abs(b.ts - a.ts) <= {DUPLICATE_S} AND {_OVER.format(a='a.ws', b='b.ws')} >= {DUPLICATE}")
def w_duplicates(spark, d) -> DataFrame:
    return duplicates(dispatches(spark, d))


def relay_changes(m: DataFrame) -> DataFrame:
    """(trace_id, first_msg, second_msg): values given as key: value that change on the way to a third agent; of a trace the first."""
    keys, values = (F.regexp_extract_all("content", F.lit(r"(\w+):\s*(\w+)"), F.lit(g)) for g in (1, 2))
    m = m.withColumn("ws", long_words(F.col("content"), 3)).withColumn("kv", F.arrays_zip(keys.alias("key"), values.alias("value")))
    a, b = two(m.filter(F.size("kv") > 0), "ws", "kv")
    changed = F.exists("a.kv", lambda x: F.exists("b.kv", lambda y: (x["key"] == y["key"]) & (x["value"] != y["value"])))
    hits = a.join(b, F.expr(f"{SAME_TRACE} and b.sender = a.recipient and b.recipient <> a.sender and b.ts > a.ts") & (overlap(F.col("a.ws"), F.col("b.ws")) >= RELAY) & changed)
    first = hits.groupBy("a.trace_id").agg(F.min(F.struct("a.ts", "b.ts", "a.msg_id", F.col("b.msg_id").alias("other"))).alias("x"))
    return first.select("trace_id", F.col("x.msg_id").alias("first_msg"), F.col("x.other").alias("second_msg"))


@query("w_relay_changes", f"""{_M}, w AS (SELECT *, {_WS.format(c='content', n=3)} AS ws, regexp_extract_all(content, '(\\w+):\\s*(\\w+)', 1) AS ks, regexp_extract_all(content, '(\\w+):\\s*(\\w+)', 2) AS vs FROM messages),
h AS ({_PAIR}, row_number() OVER (PARTITION BY a.trace_id ORDER BY a.ts, b.ts) AS nth FROM w a JOIN w b ON {SAME_TRACE} AND b.sender = a.recipient AND b.recipient <> a.sender AND b.ts > a.ts AND {_OVER.format(a='a.ws', b='b.ws')} >= {RELAY} WHERE len(list_filter(list_zip(a.ks, a.vs), lambda x: len(list_filter(list_zip(b.ks, b.vs), lambda y: x[1] = y[1] AND x[2] <> y[2])) > 0)) > 0)
SELECT trace_id, first_msg, second_msg FROM h WHERE nth = 1""")
def w_relay(spark, d) -> DataFrame:
    return relay_changes(dispatches(spark, d))


def out_of_order(m: DataFrame) -> DataFrame:
    """(trace_id, first_msg, second_msg): steps of one sender, next to each other by number, of which the later is answered first."""
    step = F.regexp_extract(F.lower("content"), r"\b(?:step|phase|task)\s*(\d+)", 1).try_cast("int")
    s = m.withColumn("step", step).filter("step is not null").select("trace_id", "msg_id", "sender", "recipient", "ts", "step")
    # The first message that the recipient sends later answers the step.
    answers = m.select(F.col("trace_id").alias("t"), F.col("sender").alias("by"), F.col("ts").alias("at"))
    s = s.join(answers, (F.col("trace_id") == F.col("t")) & (F.col("recipient") == F.col("by")) & (F.col("at") > F.col("ts")), "left").groupBy("trace_id", "msg_id", "sender", "ts", "step").agg(F.min("at").alias("answer"))
    w = W.partitionBy("trace_id", "sender").orderBy("step", "ts")
    s = s.withColumns({"second_msg": F.lead("msg_id").over(w), "later": F.lead("answer").over(w)})
    return s.filter(F.col("later").isNotNull() & (F.col("answer").isNull() | (F.col("later") < F.col("answer")))).select("trace_id", F.col("msg_id").alias("first_msg"), "second_msg")


@query("w_ordering_violations", f"""{_M}, s AS (SELECT *, TRY_CAST(regexp_extract(lower(content), '\\b(?:step|phase|task)\\s*(\\d+)', 1) AS INTEGER) AS step FROM messages), r AS (SELECT s.*, (SELECT min(b.ts) FROM messages b WHERE b.trace_id = s.trace_id AND b.sender = s.recipient AND b.ts > s.ts) AS answer FROM s WHERE step IS NOT NULL),
n AS (SELECT trace_id, msg_id AS first_msg, answer, lead(msg_id) OVER w AS second_msg, lead(answer) OVER w AS later FROM r WINDOW w AS (PARTITION BY trace_id, sender ORDER BY step, ts)) SELECT trace_id, first_msg, second_msg FROM n WHERE later IS NOT NULL AND (answer IS NULL OR later < answer)""")
def w_order(spark, d) -> DataFrame:
    return out_of_order(dispatches(spark, d))


def resource(content: Column) -> Column:
    """What the first claiming verb, by name, asks for."""
    lower = F.lower(content)
    found = [F.nullif(F.regexp_extract(lower, verb + r"\s+(?:to\s+)?(?:resource\s+)?(\w+)", 1), F.lit("")) for verb in CLAIMS]
    return F.coalesce(*found)


def contention(m: DataFrame) -> DataFrame:
    """Two agents that ask for one resource within five seconds."""
    a, b = two(m.withColumn("resource", resource(F.col("content"))).filter("resource is not null"), "resource")
    return pair(a.join(b, F.expr(f"{SAME_TRACE} and a.resource = b.resource and a.sender <> b.sender and a.msg_id < b.msg_id and abs(b.ts - a.ts) < {CONFLICT_S}")))


_RES = "coalesce(" + ", ".join(f"nullif(regexp_extract(lower(content), '{v}\\s+(?:to\\s+)?(?:resource\\s+)?(\\w+)', 1), '')" for v in CLAIMS) + ")"


@query("w_resource_contention", f"{_M}, r AS (SELECT *, {_RES} AS resource FROM messages) {_PAIR} FROM r a JOIN r b ON {SAME_TRACE} AND a.resource = b.resource AND a.sender <> b.sender AND a.msg_id < b.msg_id AND abs(b.ts - a.ts) < {CONFLICT_S}")
def w_contention(spark, d) -> DataFrame:
    return contention(dispatches(spark, d))


def rapid_changes(m: DataFrame) -> DataFrame:
    """Instructions called back by the next one of the same pair within three seconds."""
    w = W.partitionBy("trace_id", "sender", "recipient").orderBy("ts")
    lower = F.lower("content")
    n = m.withColumns({"before": F.lag("msg_id").over(w), "gap": F.col("ts") - F.lag("ts").over(w)})
    return n.filter((F.col("gap") <= RAPID_S) & reduce(Column.__or__, [lower.contains(x) for x in CALLED_BACK])).select("trace_id", F.col("before").alias("first_msg"), F.col("msg_id").alias("second_msg"))


@query("w_rapid_changes", f"{_M}, n AS (SELECT *, lag(msg_id) OVER w AS before, ts - lag(ts) OVER w AS gap FROM messages WINDOW w AS (PARTITION BY trace_id, sender, recipient ORDER BY ts)) SELECT trace_id, before AS first_msg, msg_id AS second_msg FROM n WHERE gap <= {RAPID_S} AND ({' OR '.join(f'contains(lower(content), {x!r})' for x in CALLED_BACK)})")
def w_rapid(spark, d) -> DataFrame:
    return rapid_changes(dispatches(spark, d))


def slow_replies(m: DataFrame) -> DataFrame:
    """Messages whose first reply came after more than ten seconds. Both directions of a pair lie in one window, so that no pair is joined."""
    ends = (F.least("sender", "recipient"), F.greatest("sender", "recipient"))
    w = W.partitionBy("trace_id", *ends).orderBy("ts").rowsBetween(1, W.unboundedFollowing)
    up = F.col("sender") < F.col("recipient")
    first = F.when(up, F.min(F.when(~up, F.col("ts"))).over(w)).otherwise(F.min(F.when(up, F.col("ts"))).over(w))
    return m.withColumn("delay", first - F.col("ts")).filter(F.col("delay") > SLOW_S).select("trace_id", "msg_id", "delay")


@query("w_slow_replies", f"{_M} SELECT a.trace_id, a.msg_id, min(b.ts) - a.ts AS delay FROM messages a JOIN messages b ON {SAME_TRACE} AND b.sender = a.recipient AND b.recipient = a.sender AND b.ts > a.ts GROUP BY a.trace_id, a.msg_id, a.ts HAVING min(b.ts) - a.ts > {SLOW_S}")
def w_slow(spark, d) -> DataFrame:
    return slow_replies(dispatches(spark, d))


def bypassed(m: DataFrame) -> DataFrame:
    """Traces in which A asks B, B passes on to C and C answers A, with a word in common by its first five letters."""
    stems = F.array_distinct(F.transform(long_words(F.col("content"), 3), lambda x: F.substring(x, 1, 5)))
    a, c = two(m.withColumn("stems", stems), "stems")
    via = m.select(F.col("trace_id").alias("t"), F.col("sender").alias("middle"), F.col("recipient").alias("last"), F.col("ts").alias("at"))
    ends = a.join(c, F.expr(f"{SAME_TRACE} and b.recipient = a.sender and b.sender <> a.recipient and b.ts > a.ts") & F.arrays_overlap("a.stems", "b.stems"))
    ends = ends.select("a.trace_id", F.col("a.recipient").alias("mid"), F.col("b.sender").alias("end"), F.col("a.ts").alias("since"), F.col("b.ts").alias("until"))
    on = (F.col("trace_id") == F.col("t")) & (F.col("mid") == F.col("middle")) & (F.col("end") == F.col("last")) & (F.col("at") > F.col("since")) & (F.col("at") < F.col("until"))
    return ends.join(via, on, "left_semi").select("trace_id").distinct()


@query("w_indirect_delegation", f"{_M}, w AS (SELECT *, list_distinct(list_transform({_WS.format(c='content', n=3)}, lambda x: x[1:5])) AS st FROM messages) SELECT DISTINCT a.trace_id FROM w a JOIN w b ON {SAME_TRACE} AND b.sender = a.recipient AND b.recipient <> a.sender AND b.ts > a.ts JOIN w c ON c.trace_id = a.trace_id AND c.ts > b.ts AND c.sender = b.recipient AND c.recipient = a.sender WHERE len(list_intersect(a.st, c.st)) > 0")
def w_bypassed(spark, d) -> DataFrame:
    return bypassed(dispatches(spark, d))


#: Checks in order, with the severity of their findings.
CHECKS = {
    "ignored_message": (ignored, "medium"), "message_lost": (lost, "high"), "limited_communication": (limited, "low"), "excessive_back_forth": (back_and_forth, "medium"),
    "conflicting_instructions": (conflicting, "high"), "duplicate_dispatch": (duplicates, "medium"), "data_corruption_relay": (relay_changes, "high"), "ordering_violation": (out_of_order, "medium"),
    "resource_contention": (contention, "high"), "rapid_instruction_change": (rapid_changes, "low"), "slow_response": (slow_replies, "low"), "indirect_delegation": (bypassed, "low"),
}


def coordination(m: DataFrame) -> DataFrame:
    """(trace_id, issues, severe, checks, healthy): findings of all checks, a row for every trace with a message.

    Healthy traces have no severe finding. Circular and excessive delegation are not among the checks.
    """
    each = [fn(m).groupBy("trace_id").agg(F.count("*").alias("n")).select("trace_id", F.lit(name).alias("check"), "n", F.lit(severity == "high").alias("severe")) for name, (fn, severity) in CHECKS.items()]
    per = reduce(DataFrame.unionByName, each).groupBy("trace_id").agg(F.sum("n").alias("issues"), F.sum(F.when(F.col("severe"), F.col("n")).otherwise(0)).alias("severe"), F.count("*").alias("checks"))
    return m.select("trace_id").distinct().join(per, "trace_id", "left").fillna(0).withColumn("healthy", F.col("severe") == 0)


@query("l3_coordination")
def l3(spark, d) -> DataFrame:
    return coordination(dispatches(spark, d))


@query("l3_coordination_metrics", f"{_M}, n AS (SELECT trace_id, count(*) AS messages, count(DISTINCT least(sender, recipient) || greatest(sender, recipient)) AS pairs FROM messages GROUP BY 1), g AS (SELECT trace_id, count(DISTINCT a) AS agents FROM (SELECT trace_id, sender AS a FROM messages UNION ALL SELECT trace_id, recipient FROM messages) GROUP BY 1) SELECT n.trace_id, round(pairs / (agents * (agents - 1) / 2), 6) AS density, round(messages / agents, 6) AS per_agent FROM n JOIN g ON n.trace_id = g.trace_id")
def l3_metrics(spark, d) -> DataFrame:
    m = dispatches(spark, d)
    n = m.groupBy("trace_id").agg(F.count("*").alias("messages"), F.countDistinct(F.least("sender", "recipient"), F.greatest("sender", "recipient")).alias("pairs"))
    g = m.select("trace_id", F.explode(F.array("sender", "recipient")).alias("agent")).groupBy("trace_id").agg(F.countDistinct("agent").alias("agents"))
    most = F.col("agents") * (F.col("agents") - 1) / 2
    return n.join(g, "trace_id").select("trace_id", F.round(F.col("pairs") / most, 6).alias("density"), F.round(F.col("messages") / F.col("agents"), 6).alias("per_agent"))
