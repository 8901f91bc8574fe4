"""Ingestion as queries: events written as telemetry or records, and read back as spans and states."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources import otlp, records
from ..sources.adapters import MODELS, read, spans

_E = "e AS (SELECT *, coalesce(TRY_CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER), 0) AS k FROM events)"


def batches(spark, d) -> DataFrame:
    """Events as OTLP documents, one for a user and day: written as JSON and parsed again."""
    e = read(spark, d, "events").withColumn("k", F.coalesce(F.regexp_extract("props", '"k": ([0-9]+)', 1).try_cast("int"), F.lit(0)))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    nanos = lambda c: F.concat(c.cast("string"), F.lit("000"))
    text = lambda key, value: F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue"), F.lit(None).cast("string").alias("intValue")).alias("value"))
    number = lambda key, value: F.struct(F.lit(key).alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), value.cast("string").alias("intValue")).alias("value"))
    u = F.col("user_id") % 4
    system = F.when(u == 0, "openai").when(u == 1, "AWS_Bedrock")
    attrs = F.array_compact(F.array(
        F.when(system.isNotNull(), text("gen_ai.system", system)), F.when(F.col("event_type") != "view", text("gen_ai.agent.name", F.col("event_type"))), F.when(u == 2, text("langgraph.graph", F.lit("g"))), text("gen_ai.state", F.col("props")),
        F.when(F.col("k") % 5 == 0, number("gen_ai.usage.total_tokens", F.col("k") + 1000)), number("gen_ai.usage.input_tokens", F.col("k")), number("gen_ai.usage.output_tokens", F.floor("value")), F.when(F.col("event_type") == "purchase", text("gen_ai.request.model", F.element_at(F.array(*[F.lit(m) for m in MODELS]), F.col("k") % len(MODELS) + 1))),
    ))
    name = F.when(F.col("k") % 2 == 0, "view node").otherwise(F.col("event_type"))
    span = F.struct(F.when(F.col("k") % 10 != 9, F.col("user_id").cast("string")).alias("traceId"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("spanId"), name.alias("name"), nanos(us).alias("startTimeUnixNano"), nanos(us + F.floor("value") * 1000).alias("endTimeUnixNano"), attrs.alias("attributes"), F.struct(F.when(F.col("event_type") == "error", 2).otherwise(1).alias("code")).alias("status"))
    per = e.groupBy("user_id", F.to_date("ts")).agg(F.collect_list(span).alias("spans"))
    doc = F.to_json(F.struct(F.array(F.struct(F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans")))
    empty = e.limit(1).select(F.lit('{"resourceSpans": []}').alias("doc"))
    return per.select(doc.alias("doc")).union(empty).select(F.from_json("doc", otlp.SCHEMA).alias("x")).select("x.*")


_SPAN = f"WITH {_E}, s AS (SELECT CASE WHEN k % 10 <> 9 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS trace_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS span_id, CASE WHEN k % 2 = 0 THEN 'view node' ELSE event_type END AS name, event_type, user_id, ts, value, k, props FROM e)"


@query("a1_otlp_spans", f"{_SPAN} SELECT trace_id, span_id, name, CASE WHEN event_type = 'purchase' THEN 'llm' WHEN event_type <> 'view' THEN 'agent' ELSE 'task' END AS kind, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CAST(floor(value) AS DOUBLE) AS duration_ms FROM s")
def a1(spark, d) -> DataFrame:
    return otlp.flatten(batches(spark, d)).select("trace_id", "span_id", "name", "kind", "status", "duration_ms")


@query("a2_agent_states", f"""{_SPAN}, f AS (SELECT *, first_value(CASE user_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'bedrock' WHEN 2 THEN 'langgraph' END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY ts, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS framework FROM s)
SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY ts, span_id) - 1 AS sequence_num, CASE WHEN event_type <> 'view' THEN event_type ELSE name END AS agent_id, CASE WHEN k % 5 = 0 THEN k + 1000 ELSE k + CAST(floor(value) AS BIGINT) END AS tokens, framework, CASE WHEN event_type = 'purchase' THEN ({list(MODELS)!r})[k % {len(MODELS)} + 1] END AS model, substr(sha256(props), 1, 16) AS state_hash FROM f WHERE event_type <> 'view' OR k % 2 = 0""")
def a2(spark, d) -> DataFrame:
    return otlp.states(otlp.flatten(batches(spark, d))).select("trace_id", "span_id", F.col("sequence_num").cast("long").alias("sequence_num"), "agent_id", "tokens", "framework", "model", "state_hash")


@query("a27_without_content", f"{_SPAN} SELECT span_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS models FROM s")
def a27(spark, d) -> DataFrame:
    s = otlp.flatten(batches(spark, d)).withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("gen_ai.prompt"), F.lit("secret text"), F.lit("llm.output"), F.lit("more"))))
    kept = otlp.without_content(s)
    hidden = F.exists(F.map_keys("attributes"), lambda k: k.rlike("prompt$|output$"))
    return kept.filter(~hidden).select("span_id", F.map_contains_key("attributes", F.lit("gen_ai.request.model")).cast("int").alias("models"))


_TEXTS = {
    0: '{"run_type": "llm", "id": 1}', 1: '[{"observations": []}]', 2: '{"traceId": "t"}\n{"other": 1}', 3: '{"span_kind": "LLM", "attributes": {"openinference.span": 1}}', 4: '{"span_kind": "LLM", "attributes": {"x": 1}}', 5: '{"executionId": 7}', 6: "no json", 7: "[]", 8: '{"broken": ', 9: '  {"name": "plain"}',
}
_FORMATS = ("langsmith", "langfuse", "otel", "phoenix", "generic", "n8n", "generic", "generic", "generic", "generic")


@query("a13_formats", f"WITH {_E} SELECT event_id, ({list(_FORMATS)!r})[k % 10 + 1] AS format FROM e")
def a13(spark, d) -> DataFrame:
    """The format of a text, here one of ten by the last digit of k."""
    s = spans(spark, d).select(F.col("span_id").alias("event_id"), F.coalesce("k", F.lit(0)).alias("k"))
    text = F.element_at(F.array(*[F.lit(t) for t in _TEXTS.values()]), (F.col("k") % 10 + 1).cast("int"))
    return s.select("event_id", records.trace_format(text).alias("format"))


def lines(spark, d) -> DataFrame:
    """(job, line_no, line): events as JSON records in three makers' manners, one line in thirteen broken."""
    e = read(spark, d, "events").withColumn("k", F.coalesce(F.regexp_extract("props", '"k": ([0-9]+)', 1).try_cast("int"), F.lit(0)))
    smith = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("name"), F.upper("event_type").alias("run_type"), F.when(F.col("event_type") == "error", "boom").alias("error"), F.struct((F.col("k") + 5).alias("total_tokens")).alias("usage")))
    fuse = F.to_json(F.struct(F.col("event_id").alias("spanId"), F.col("user_id").alias("traceId"), F.col("event_type").alias("operation"), F.when(F.col("event_type") == "error", "FAILED").otherwise("ok").alias("status"), (F.col("k") + 5).alias("totalTokens")))
    plain = F.to_json(F.struct(F.col("event_type").alias("agent"), (F.col("k") + 5).alias("tokens"), F.when(F.col("event_type") == "error", "error").alias("level")))
    text = F.when(F.col("k") % 13 == 0, '{"broken": ').when(F.col("k") % 3 == 0, smith).when(F.col("k") % 3 == 1, fuse).otherwise(plain)
    return e.select((F.col("user_id") % 10).alias("job"), F.col("event_id").alias("line_no"), text.alias("line"))


@query("a22_records", f"WITH {_E} SELECT event_id AS line_no, k % 13 <> 0 AS parsed, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 3 = 2 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS trace_id, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 3 = 2 THEN 'line-' || event_id ELSE CAST(event_id AS VARCHAR) END AS span_id, CASE WHEN k % 13 <> 0 THEN event_type END AS name, CASE WHEN k % 13 <> 0 THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END END AS status, CASE WHEN k % 13 <> 0 THEN CAST(k + 5 AS BIGINT) END AS tokens FROM e")
def a22(spark, d) -> DataFrame:
    return records.records(lines(spark, d)).select("line_no", "parsed", "trace_id", "span_id", "name", "status", "tokens")


@query("a28_import_jobs", f"WITH {_E}, j AS (SELECT user_id % 10 AS job, count(*) AS total, count(*) FILTER (WHERE k % 13 <> 0) AS imported, count(*) FILTER (WHERE k % 13 = 0) AS failed FROM e GROUP BY 1) SELECT *, CASE WHEN imported = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS state FROM j")
def a28(spark, d) -> DataFrame:
    found = lines(spark, d).select("job", F.struct("line_no", "line").alias("x")).select("job", "x.*")
    parsed = found.withColumn("parsed", F.json_object_keys("line").isNotNull())
    return records.bookkeeping(parsed, "job")
