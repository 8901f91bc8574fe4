"""Trace files of other makers: the format of a text, and its records as spans, with the lines that fail kept apart."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats in order of the check, each with the fields that tell it.
MARKS = {"langsmith": ("run_type", "session_id"), "langfuse": ("traces", "observations"), "otel": ("resourceSpans", "traceId"), "phoenix": ("span_kind", "context"), "n8n": ("executionId", "workflowId")}
PHOENIX = "openinference.|phoenix."
#: Names that records give to a field of a span, in order.
FIELDS = {
    "trace_id": ("trace_id", "traceId", "session_id", "sessionId", "execution_id", "executionId", "workflowId"), "span_id": ("span_id", "spanId", "id", "run_id", "uuid"), "parent_id": ("parent_id", "parentSpanId", "parent_run_id", "parentObservationId"),
    "name": ("name", "run_name", "agent", "node", "operation"), "kind": ("kind", "run_type", "type", "span_kind"), "status": ("status", "level", "state"), "start_time": ("start_time", "startTime", "timestamp", "startedAt"), "end_time": ("end_time", "endTime", "completedAt"),
    "input": ("input", "inputs", "prompt", "query"), "output": ("output", "outputs", "response", "completion", "result"), "error": ("error", "error_message", "statusMessage", "exception"), "tokens": ("total_tokens", "totalTokens", "tokens", "usage"),
}


def first_item(text: Column) -> Column:
    """A list's first item, or the first line of a text that opens with a brace, as JSON; null for anything else, or what does not parse."""
    t = F.trim(text)
    item = F.when(t.startswith("["), F.get_json_object(t, "$[0]")).when(t.startswith("{"), F.split_part(t, F.lit("\n"), F.lit(1)))
    return F.when(F.try_parse_json(item).isNotNull(), item)


def trace_format(text: Column) -> Column:
    """The first format of which the item has a field; Phoenix also asks for an attribute of its own; else generic."""
    keys = F.coalesce(F.json_object_keys(first_item(text)), F.array().cast("array<string>"))
    has = lambda names: F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))
    own = F.exists(F.coalesce(F.json_object_keys(F.get_json_object(first_item(text), "$.attributes")), F.array().cast("array<string>")), lambda k: k.rlike("^(?:openinference|phoenix)\\."))
    found = F.coalesce(*[F.when(has(names) & own if name == "phoenix" else has(names), name) for name, names in MARKS.items()])
    return F.coalesce(found, F.lit("generic"))


def records(lines: DataFrame, text: str = "line") -> DataFrame:
    """(line_no, parsed, and the fields of a span as text) for rows (line_no, line): a field is the first of its names that the record has.

    A line that is no JSON object has parsed false and no fields. A record without a trace belongs to
    "unknown", one without an id gets its line's number, one with an error, or a status that says so, is
    an error.
    """
    item = F.when(F.json_object_keys(F.col(text)).isNotNull(), F.col(text))
    rows = lines.withColumn("item", item)
    value = lambda names: F.coalesce(*[F.nullif(F.get_json_object("item", f"$.{n}"), F.lit("")) for n in names])
    got = rows.select("line_no", F.col("item").isNotNull().alias("parsed"), *[value(names).alias(f) for f, names in FIELDS.items()])
    failed = F.lower("status").isin("error", "failed", "failure") | F.col("error").isNotNull()
    return got.withColumns({
        "trace_id": F.when(F.col("parsed"), F.coalesce("trace_id", F.lit("unknown"))), "span_id": F.when(F.col("parsed"), F.coalesce("span_id", F.concat(F.lit("line-"), F.col("line_no").cast("string")))),
        "status": F.when(F.col("parsed"), F.when(F.coalesce(failed, F.lit(False)), "error").otherwise("ok")), "kind": F.lower("kind"), "tokens": F.coalesce(F.col("tokens").try_cast("long"), F.get_json_object("tokens", "$.total_tokens").try_cast("long")),
    })


def bookkeeping(found: DataFrame, *by: str) -> DataFrame:
    """How many lines of each job were read, became spans, and failed, and its state."""
    n = found.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("parsed").alias("imported"), F.count_if(~F.col("parsed")).alias("failed"))
    return n.withColumn("state", F.when(F.col("imported") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("completed"))
