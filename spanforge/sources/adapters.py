"""The generic tables as trace frames, in Spark and as the SQL that the checks use.

spans: an event is a span of its user's trace; turns: a conversation's rows; predictions: a rule's verdict
on a labelled document; edges: customers and suppliers that an order links.
"""

from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The day that stands for "now".
NOW = "2024-02-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "llm").when(F.col("event_type") == "signup", "agent").otherwise("tool")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).try_cast("int")
    return e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("name"), kind.alias("kind"), status.alias("status"), F.col("ts").alias("start_time"), "value", k.alias("k"))


IN_ORDER = ("start_time", "span_id")


def order(*more: str) -> W:
    return W.partitionBy("trace_id", *more).orderBy(*IN_ORDER)


SPANS = """spans AS (SELECT user_id AS trace_id, event_id AS span_id, event_type AS name,
  CASE event_type WHEN 'purchase' THEN 'llm' WHEN 'signup' THEN 'agent' ELSE 'tool' END AS kind,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, ts AS start_time, value,
  TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, mode, detected, confidence, truth): a length rule against the quality label."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(labels, "doc_id").select(F.col("doc_id").alias("record_id"), F.col("source").alias("mode"), (F.col("n") > 1000).alias("detected"), F.least(F.lit(1.0), F.col("n") / 4000.0).alias("confidence"), (F.col("quality") == 1).alias("truth"))


PREDICTIONS = """predictions AS (SELECT d.doc_id AS record_id, source AS mode, length(text) > 1000 AS detected,
  least(1.0, CAST(length(text) AS DOUBLE) / 4000.0) AS confidence, quality = 1 AS truth
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with an end and a parent: one whose k is under 20 opens a task that the spans after it belong to; a span lasts its value in minutes."""
    s = spans(spark, sf_dir)
    opens = F.coalesce(F.col("k") < 20, F.lit(False))
    opened = F.last(F.when(opens, F.col("span_id")), ignorenulls=True).over(order().rowsBetween(W.unboundedPreceding, -1))
    return s.withColumn("parent_id", opened).withColumn("end_time", F.timestamp_micros(F.unix_micros(F.col("start_time").cast("timestamp")) + F.floor(F.col("value")) * 60_000_000).cast(s.schema["start_time"].dataType))


PARENTS = SPANS + """, parents AS (SELECT *, last_value(CASE WHEN k < 20 THEN span_id END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY start_time, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id,
  start_time + to_minutes(CAST(floor(value) AS BIGINT)) AS end_time FROM spans)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, msg_id, sender, recipient, content, ts): a turn is a message to the role of the next turn, the last to that before; a turn takes a second."""
    w = W.partitionBy("conv_id").orderBy("turn")
    to = F.coalesce(F.lead("role").over(w), F.lag("role").over(w))
    return turns(spark, sf_dir).select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("msg_id"), F.col("role").alias("sender"), to.alias("recipient"), F.col("text").alias("content"), F.col("turn").cast("double").alias("ts"))


MESSAGES = """messages AS (SELECT conv_id AS trace_id, turn AS msg_id, role AS sender, coalesce(lead(role) OVER w, lag(role) OVER w) AS recipient, text AS content, CAST(turn AS DOUBLE) AS ts
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


#: What an agent writes to another, by the last digit of k.
PHRASES = (
    "update the customer record for the ledger now", "delete the customer record for the ledger now", "please provide the customer record for the ledger", "lock resource ledger for writing",
    "step 1 collect the totals of all regions", "step 2 report the totals of all regions", "cancel that and use the older totals instead", "owner: alice total: 10 for the customer record",
    "owner: bob total: 12 for the customer record", "forward the report of all regions to the reviewers",
)


def dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, msg_id, sender, recipient, content, ts): an event as an instruction between two of four agents; a trace's messages come a second apart."""
    s = spans(spark, sf_dir).filter("k is not null")
    a, b = F.col("k") % 4, F.floor(F.col("k") / 4) % 4
    name = lambda c: F.concat(F.lit("agent"), c.cast("int").cast("string"))
    content = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("k") % 10 + 1).cast("int"))
    return s.select("trace_id", F.col("span_id").alias("msg_id"), name(a).alias("sender"), name(F.when(a == b, (b + 1) % 4).otherwise(b)).alias("recipient"), content.alias("content"), F.row_number().over(order()).cast("double").alias("ts"))


DISPATCHES = SPANS + f""", messages AS (SELECT trace_id, span_id AS msg_id, 'agent' || (k % 4) AS sender, 'agent' || (CASE WHEN k % 4 = k // 4 % 4 THEN (k // 4 % 4 + 1) % 4 ELSE k // 4 % 4 END) AS recipient,
  ({list(PHRASES)!r})[CAST(k % 10 + 1 AS INTEGER)] AS content, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS DOUBLE) AS ts FROM spans WHERE k IS NOT NULL)"""


#: Names that spans of agents carry, by their value.
TOOLS = ("Read", "Grep", "Write", "deploy")
MODELS = ("claude-3-opus", "claude-3.5-sonnet", "claude-3.5-haiku", "gpt-4", "gpt-4-turbo", "gpt-4o", "gpt-4o-mini", "gemini-1.5-pro", "gemini-flash", "o1-preview", "llama-3", "gpt-3.5-turbo-0125")
ERRORS = ("Tool not found: search", "schema validation: missing required field", "401 Unauthorized: expired token", "connection refused after timeout", "ok", "Invalid arguments and permission denied", "file not found", "Unexpected property x")


def agent_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of agents (trace_id, span_id, us, name, kind, status, value, tokens, source, target, content, error, model).

    The last digit of k is the kind, the value the rest; a month's time is pressed into three quarters of
    an hour, in microseconds since its start.
    """
    e = read(spark, sf_dir, "events")
    k, v = F.coalesce(F.regexp_extract("props", '"k": ([0-9]+)', 1).try_cast("int"), F.lit(0)), F.floor("value").cast("int")
    e = e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), "event_type", "value", k.alias("k"), v.alias("v"), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000).alias("us"))
    d = F.col("k") % 10
    kind = F.when(d <= 3, "tool").when(d <= 5, "llm").when(d == 6, "agent").when(d == 7, "message").when(d == 8, "handoff").otherwise("user_input")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    e = e.withColumn("kind", kind)
    a, b = F.col("v") % 4, F.floor(F.col("v") / 4).cast("int") % 4
    to = F.when(a == b, (b + 1) % 4).otherwise(b)
    is_ = lambda x: F.col("kind") == x
    name = F.when(is_("tool"), pick(TOOLS, F.col("v"))).when(is_("agent"), F.concat(F.lit("agent"), (F.col("v") % 3).cast("string"))).otherwise(F.col("kind"))
    bad = F.col("event_type") == "error"
    return e.select(
        "trace_id", "span_id", "us", name.alias("name"), "kind", F.when(bad, "error").otherwise("ok").alias("status"), "value", (F.col("k") * 40).alias("tokens"),
        F.when(is_("handoff"), F.concat(F.lit("a"), a.cast("string"))).alias("source"), F.when(is_("handoff"), F.concat(F.lit("a"), to.cast("string"))).alias("target"),
        pick(PHRASES, F.col("v")).alias("content"), F.when(bad, pick(ERRORS, F.col("v"))).alias("error"), F.when(is_("llm"), pick(MODELS, F.col("v"))).alias("model"),
    )


AGENT_SPANS = f"""e0 AS (SELECT user_id AS trace_id, event_id AS span_id, event_type, value, coalesce(TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER), 0) AS k, CAST(floor(value) AS INTEGER) AS v, CAST(floor((epoch_us(ts) - 1704067200000000) / 1000) AS BIGINT) AS us FROM events),
e1 AS (SELECT *, CASE WHEN k % 10 <= 3 THEN 'tool' WHEN k % 10 <= 5 THEN 'llm' WHEN k % 10 = 6 THEN 'agent' WHEN k % 10 = 7 THEN 'message' WHEN k % 10 = 8 THEN 'handoff' ELSE 'user_input' END AS kind FROM e0),
spans AS (SELECT trace_id, span_id, us, CASE kind WHEN 'tool' THEN ({list(TOOLS)!r})[v % 4 + 1] WHEN 'agent' THEN 'agent' || (v % 3) ELSE kind END AS name, kind, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, value, k * 40 AS tokens,
 CASE WHEN kind = 'handoff' THEN 'a' || (v % 4) END AS source, CASE WHEN kind = 'handoff' THEN 'a' || (CASE WHEN v % 4 = v // 4 % 4 THEN (v // 4 % 4 + 1) % 4 ELSE v // 4 % 4 END) END AS target, ({list(PHRASES)!r})[v % 10 + 1] AS content,
 CASE WHEN event_type = 'error' THEN ({list(ERRORS)!r})[v % 8 + 1] END AS error, CASE WHEN kind = 'llm' THEN ({list(MODELS)!r})[v % 12 + 1] END AS model FROM e1)"""


#: What the turns of a dialogue say, by the value of an event.
SAYINGS = (
    "What is the total for the north region? Please tell me.", "The total for the north region is 10, taken from the ledger of the first quarter, after all of the corrections that were booked in March.", "I don't have that.", "Task complete, everything is finished.",
    "But wait, there is one more thing to look at.", "Next step: I will collect the totals.", "Could you be more specific? I need more details.", "Please send me the report of last week.", "ok", "Working on it, moving on to the other region.", "That is confidential and restricted.",
    "How do we proceed with the south region?", "The south region comes after the north region, as the plan of the first quarter says, and the report of last week is attached to it.", "All done, nothing more.", "I am confused about the south region.", "fine",
)


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, turn, participant, text): an event as a turn of its user's dialogue with three agents."""
    s = spans(spark, sf_dir)
    k, v = F.coalesce("k", F.lit(0)), F.floor("value").cast("int")
    who = F.when(k % 4 == 0, "user").otherwise(F.concat(F.lit("agent"), (k % 3).cast("string")))
    return s.select("trace_id", (F.row_number().over(order()) - 1).alias("turn"), who.alias("participant"), F.element_at(F.array(*[F.lit(x) for x in SAYINGS]), v % len(SAYINGS) + 1).alias("text"))


DIALOGUES = SPANS + f""", turns AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) - 1 AS turn, CASE WHEN coalesce(k, 0) % 4 = 0 THEN 'user' ELSE 'agent' || (coalesce(k, 0) % 3) END AS participant,
  ([{", ".join("'" + x.replace("'", "''") + "'" for x in SAYINGS)}])[CAST(floor(value) AS INTEGER) % {len(SAYINGS)} + 1] AS text FROM spans)"""


#: What states of agents hold, by digits of an event.
NOTES = ("null", '""', '"ok then"', '"the whole ledger of the first quarter was booked"', '"a completely different sentence about other matters"', "7")
ITEMS = ("[]", '[{"id":1}]', '[{"id":1},{"id":2},{"id":3}]', '[{"id":1},{"id":1}]', "[1,2,3,4,5,6,7,8,9,10,11,12]")
PROFILES = (
    "{}", '{"name":"Ann","first_name":"A","verified":true,"address":{"city":"Rome","zip":100}}', '{"name":"Bob","first_name":"B","verified":false,"address":{"city":"Oslo","zip":900}}', "null",
)
#: A member of a state, as text, from k and v; the same expressions in both engines.
_MEMBERS = (
    "'{\"user_id\":\"u', CASE WHEN v % 9 = 0 THEN '1' ELSE '0' END, '\",\"version\":', CAST(v % 97 AS STRING)", "CASE WHEN k % 11 = 0 THEN '' ELSE concat(',\"status\":\"', $status, '\"') END",
    "',\"score\":', CAST(v % 100 - 5 AS STRING), ',\"grade\":\"', $grade, '\",\"ratio\":', CAST(v % 7 AS STRING), CASE WHEN k % 2 = 0 THEN '.5' ELSE '' END", "',\"note\":', $note, ',\"items\":', $item",
    "CASE WHEN k % 10 = 9 THEN '' ELSE concat(',\"profile\":', $profile) END", "',\"step_count\":', CAST(v % 40 AS STRING), ',\"age\":', CAST(v * 3 - 20 AS STRING), ',\"email\":\"a', CASE WHEN v % 4 = 0 THEN ' ' ELSE '' END, '@b.org\",\"min_value\":', CAST(v % 10 AS STRING), ',\"max_value\":', CAST(k % 10 AS STRING)",
    "CASE WHEN k % 13 = 0 THEN concat(',\"extra\":1,\"label\":\"reference-', CAST(v AS STRING), '\",\"order_id\":\"reference-', CAST(v AS STRING), '\"') ELSE '' END", "CASE WHEN k % 6 = 1 THEN ',\"name\":\"N\",\"username\":\"n\"' WHEN k % 6 = 2 THEN ',\"name\":\"M\",\"username\":\"m\"' ELSE '' END", "'}'",
)


def _state(pick) -> str:
    names = dict(status=pick(("pending", "processing", "shipped", "delivered", "completed"), "v"), grade=pick(("A", "B", "C", "D", "F"), "k"), note=pick(NOTES, "k"), item=pick(ITEMS, "v"), profile=pick(PROFILES, "k"))
    return Template("concat(" + ", ".join(_MEMBERS) + ")").substitute(names)


def _case(values, of: str) -> str:
    return f"CASE {of} % {len(values)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values)) + " END"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, step, ts, state): an event as the JSON state of its user's agent; a month's time is pressed into three quarters of an hour, in seconds."""
    e = read(spark, sf_dir, "events")
    k = F.coalesce(F.regexp_extract("props", '"k": ([0-9]+)', 1).try_cast("int"), F.lit(0))
    e = e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("step"), k.alias("k"), F.floor("value").cast("int").alias("v"), (F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000) / 1e6).alias("ts"))
    return e.select("trace_id", "step", "ts", F.expr(_state(_case)).alias("state"))


STATES = f"""states AS (SELECT trace_id, step, ts, {_state(_case)} AS state FROM (SELECT user_id AS trace_id, event_id AS step, coalesce(TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER), 0) AS k, CAST(floor(value) AS INTEGER) AS v, floor((epoch_us(ts) - 1704067200000000) / 1000) / 1e6 AS ts FROM events))"""


#: What failed nodes of a graph say, by the value of an event.
FAULTS = ("connection refused", "State mismatch after resume", "KeyError: missing key total", "checkpoint could not be read", "division by zero", "malformed JSON")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, node_id, status, superstep, error, outputs): an event as a run of a node."""
    s = spans(spark, sf_dir)
    bad = F.col("status") == "error"
    fault = F.element_at(F.array(*[F.lit(x) for x in FAULTS]), (F.floor("value").cast("int") % len(FAULTS)) + 1)
    return s.select("trace_id", F.col("span_id").alias("node_id"), F.when(bad, "failed").otherwise("succeeded").alias("status"), F.col("span_id").alias("superstep"), F.when(bad, fault).alias("error"), F.lit("{}").alias("outputs"))


NODES = f"""nodes AS (SELECT user_id AS trace_id, event_id AS node_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, event_id AS superstep, CASE WHEN event_type = 'error' THEN ({list(FAULTS)!r})[CAST(floor(value) AS INTEGER) % {len(FAULTS)} + 1] END AS error, '{{}}' AS outputs FROM events)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, step, agent, state, content, vector): an event as a step of one of three agents, with a small state and the vector whose id its value names."""
    s = spans(spark, sf_dir)
    v = F.floor("value").cast("int")
    state = F.concat(F.lit('{"tool":"'), "name", F.lit('","n":'), (v % 3).cast("string"), F.when(v % 5 == 0, F.lit(',"last":true')).otherwise(""), F.lit("}"))
    s = s.select("trace_id", F.col("span_id").alias("step"), F.concat(F.lit("agent"), (F.coalesce("k", F.lit(0)) % 3).cast("string")).alias("agent"), state.alias("state"), F.element_at(F.array(*[F.lit(x) for x in SAYINGS]), v % len(SAYINGS) + 1).alias("content"), v.alias("vec_id"))
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("vec_id"), F.col("embedding").alias("vector"))
    return s.join(e, "vec_id").drop("vec_id")


STEPS = f"""steps AS (SELECT user_id AS trace_id, event_id AS step, 'agent' || (coalesce(TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER), 0) % 3) AS agent,
  concat('{{"tool":"', event_type, '","n":', CAST(CAST(floor(value) AS INTEGER) % 3 AS VARCHAR), CASE WHEN CAST(floor(value) AS INTEGER) % 5 = 0 THEN ',"last":true' ELSE '' END, '}}') AS state,
  ([{", ".join("'" + x.replace("'", "''") + "'" for x in SAYINGS)}])[CAST(floor(value) AS INTEGER) % {len(SAYINGS)} + 1] AS content, embedding AS vector FROM events JOIN embeddings ON vec_id = CAST(floor(value) AS INTEGER))"""


#: What parallel branches report, by the value of an event.
REPORTS = (
    "the north total is 10", "the north total is 12", "the south account was approved", "the south account was rejected", "access is not valid", "access is valid and the count: 7", "nothing to report here",
    "however the branches disagree", "rate = 5% and the rate = 6%", "",
)


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, span_id, parent_id, name, start_time, end_time, output): spans with a parent and what they report, rarely a word of reconciliation."""
    v = F.floor("value").cast("int")
    pick = F.element_at(F.array(*[F.lit(x) for x in REPORTS]), F.when((v % 10 == 7) & (v % 4 != 0), 6).otherwise(v % 10).cast("int") + 1)
    return parents(spark, sf_dir).select("trace_id", "span_id", "parent_id", "name", "start_time", "end_time", pick.alias("output"))


BRANCHES = PARENTS + f""", branches AS (SELECT trace_id, span_id, parent_id, name, start_time, end_time, ({list(REPORTS)!r})[CASE WHEN CAST(floor(value) AS INTEGER) % 10 = 7 AND CAST(floor(value) AS INTEGER) % 4 <> 0 THEN 6 ELSE CAST(floor(value) AS INTEGER) % 10 END + 1] AS output FROM parents)"""


#: Titles, types and routes of graph nodes, and conditions of their edges, by digits of an event.
TITLES = ("WeatherService", "News agent", "FinalStep", "weather_tool", "DatabaseQuery", "end", "Reviewers")
NODE_TYPES = ("llm", "tool", "human", "router", "subgraph")
ROUTES = ("weather_service", "news", "review", "fast")
CONDITIONS = ("route == \\'weather_service\\'", "route == \\'news\\'", "route_to_tool", "finish", "continue", "mode == \\'fast\\'", "route == \\'review\\'", "go to human")
_GRAPH_ROWS = f"""SELECT user_id AS graph_id, event_type, ts, CAST(floor(value) AS INT) AS v, coalesce(TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT), 0) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events"""


def _graph_sql(quote) -> dict[str, str]:
    """The same statements in both engines, but for how a quote in a text is written."""
    case = lambda values, of: f"CASE {of} % {len(values)} " + " ".join(f"WHEN {i} THEN '{quote(x)}'" for i, x in enumerate(values)) + " END"
    return {
        "graph_nodes": f"""SELECT graph_id, concat('n', CAST(seq AS STRING)) AS node_id, {case(NODE_TYPES, "k")} AS node_type, {case(TITLES, "v")} AS title, CASE WHEN event_type = 'error' THEN 'failed' WHEN v % 5 = 0 THEN 'skipped' ELSE 'succeeded' END AS status,
          CAST(sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id ORDER BY seq) AS BIGINT) AS superstep, concat('{{"key', CAST(v % 5 AS STRING), '":1}}') AS inputs,
          concat('{{"key', CAST(k % 4 AS STRING), '":', CAST(v % 3 AS STRING), CASE WHEN k % 3 = 1 THEN concat(',"route":"', {case(ROUTES, "v")}, '"') ELSE '' END, '}}') AS outputs FROM graph_rows""",
        "graph_edges": f"""SELECT graph_id, concat('n', CAST(seq AS STRING)) AS source, CASE WHEN v % 23 = 0 THEN 'ghost' ELSE concat('n', CAST(seq + 1 AS STRING)) END AS target, CASE WHEN k % 4 = 0 THEN 'conditional' ELSE 'direct' END AS edge_type, CASE WHEN k % 4 = 0 THEN {case(CONDITIONS, "v")} ELSE '' END AS condition FROM graph_rows WHERE k % 7 <> 0
          UNION ALL SELECT graph_id, concat('n', CAST(seq AS STRING)), concat('n', CAST(seq + 2 AS STRING)), 'conditional', {case(CONDITIONS[::-1], "v")} FROM graph_rows WHERE k % 4 = 0 AND k % 7 <> 0""",
        "graph_states": f"""SELECT graph_id, superstep, max(state) AS state FROM (SELECT graph_id, CAST(sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id ORDER BY seq) AS BIGINT) AS superstep, concat('{{"route":"', {case(ROUTES, "v")}, '","note":"', CASE WHEN v % 19 = 0 THEN 'sync_failed' ELSE 'fine' END, '"}}') AS state FROM graph_rows) x WHERE superstep % 3 <> 1 GROUP BY graph_id, superstep""",
        "graph_runs": "SELECT graph_id, CASE WHEN graph_id % 2 = 0 THEN 'completed' ELSE 'running' END AS status FROM graph_rows GROUP BY graph_id",
    }


def graph_runs(spark: SparkSession, sf_dir: str, written=lambda df: df) -> dict[str, DataFrame]:
    """Graph executions, one a user: nodes, edges, states and runs, each as a frame; an event is a node that leads to the next ones.

    ``written`` may store the rows in order that all of them are made from.
    """
    rows = spark.sql(_GRAPH_ROWS.replace("TRY_CAST", "try_cast").replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events"))
    rows = written(rows)
    return {name.removeprefix("graph_"): spark.sql(q.replace("{", "{{").replace("}", "}}").replace("graph_rows", "{rows}"), rows=rows) for name, q in _graph_sql(lambda x: x).items()}


GRAPHS = f"graph_rows AS ({_GRAPH_ROWS}), " + ", ".join(f"{name} AS ({q})" for name, q in _graph_sql(lambda x: x.replace("\\'", "''")).items())


_MEMORY = """SELECT label % 2 AS tenant, vec_id AS memory_id, CASE label % 3 WHEN 0 THEN 'loop' WHEN 1 THEN 'corruption' ELSE 'cost' END AS domain, CASE WHEN vec_id % 2 = 0 THEN 'detection_pattern' ELSE 'fix_outcome' END AS memory_type, CASE WHEN vec_id % 5 < 3 THEN 'langgraph' ELSE 'crewai' END AS framework,
  concat('memory ', CAST(CASE WHEN vec_id % 9 = 0 THEN 0 ELSE vec_id END AS STRING)) AS content, CASE WHEN vec_id % 6 = 0 THEN NULL ELSE concat('{"threshold":', CAST(vec_id % 4 AS STRING), ',"details":"d', CAST(vec_id AS STRING), '"}') END AS facts, embedding AS vector, CAST(vec_id % 10 AS DOUBLE) / 10 AS importance, CAST(vec_id % 4 AS BIGINT) AS access_count,
  CAST(1706745600 - (vec_id % 400) * 86400 AS DOUBLE) AS created_at, vec_id % 11 <> 0 AS is_active, CAST(NULL AS BIGINT) AS supersedes, CAST(NULL AS BIGINT) AS superseded_by, CAST(NULL AS DOUBLE) AS last_accessed FROM embeddings"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of embeddings as a memory of one of two tenants; see ``operators.memory`` for the columns."""
    return spark.sql(_MEMORY.replace("{", "{{").replace("}", "}}").replace("FROM embeddings", "FROM {embeddings}"), embeddings=read(spark, sf_dir, "embeddings"))


MEMORIES = f"memories AS ({_MEMORY})"


#: What retrievals and users say of dates, by the value of an event.
DATED = (
    "sales as of March 5, 2019 and updated 2021-06-30", "published 12/01/2023 for the north", "prices since 2020 and from 1980", "the plan of January 2022", "nothing of note", "two years ago it was prior to 2015",
    "retrieved on 2023-11-11, effective May 1 2018", "recorded 13/40/2020", "in 2023 the rate rose",
)


def retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, span_id, kind, start_time, text): events as retrievals, inputs of users and others."""
    s = spans(spark, sf_dir)
    kind = F.when(F.col("k") % 4 < 2, "retrieval").when(F.col("k") % 20 == 19, "user_input").otherwise("tool")
    return s.select("trace_id", "span_id", F.coalesce(kind, F.lit("tool")).alias("kind"), "start_time", F.element_at(F.array(*[F.lit(x) for x in DATED]), F.floor("value").cast("int") % len(DATED) + 1).alias("text"))


RETRIEVALS = SPANS + f""", retrievals AS (SELECT trace_id, span_id, CASE WHEN k % 4 < 2 THEN 'retrieval' WHEN k % 20 = 19 THEN 'user_input' ELSE 'tool' END AS kind, start_time, ({list(DATED)!r})[CAST(floor(value) AS INTEGER) % {len(DATED)} + 1] AS text FROM spans)"""
