"""OpenTelemetry JSON into spans and agent states: nested batches are flattened and typed attribute values unwrapped."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>"
_KV = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},status:struct<code:int,message:string>>"
SCHEMA = f"resourceSpans array<struct<resource:struct<attributes:{_KV}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>>"

#: What providers call themselves, and the beginnings of frameworks' own attributes, in order.
PROVIDERS = {"aws.bedrock": "bedrock", "aws_bedrock": "bedrock", "bedrock": "bedrock", "vertex_ai": "vertex_ai", "google_vertex_ai": "vertex_ai", "gcp_vertex_ai": "vertex_ai", "openai": "openai", "anthropic": "anthropic", "azure.openai": "azure_openai", "dify": "dify"}
PREFIXES = {
    "aws.bedrock.": "bedrock", "google.gen_ai.": "vertex_ai", "gcp.": "vertex_ai", "crewai.": "crewai", "langgraph.": "langgraph", "autogen.": "autogen", "openclaw.": "openclaw", "microsoft.": "microsoft_agent_framework", "agent_framework.": "microsoft_agent_framework",
    "claude.computer_use.": "computer_use", "claude.dispatch.": "dispatch", "claude.agent_teams.": "agent_teams", "claude.cowork.": "cowork", "claude.scheduled_task.": "scheduled_task",
}
#: Attributes that name an agent, its state, its model, its prompt, its answer, and its tokens, in order.
AGENT = ("gen_ai.agent.name", "gen_ai.agent.id", "langgraph.node.name", "crewai.agent.role", "autogen.agent.name", "openclaw.agent.name", "aws.bedrock.agent.id", "aws.bedrock.agent.alias")
STATE = ("gen_ai.state", "gen_ai.system", "langgraph.state", "crewai.state", "openclaw.session.state")
MODEL = ("gen_ai.request.model", "gen_ai.response.model", "aws.bedrock.model_id")
PROVIDER = ("gen_ai.system", "gen_ai.provider.name")
PROMPT = ("gen_ai.prompt", "gen_ai.content.prompt", "llm.prompt", "input")
ANSWER = ("gen_ai.completion", "gen_ai.content.completion", "llm.completion", "output")
TOKENS = ("gen_ai.usage.total_tokens", "llm.token_count")


def attributes(pairs: Column) -> Column:
    """A map of key to text; of repeated keys the last stays."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))
    known = F.filter(F.coalesce(pairs, F.array().cast(_KV)), lambda x: x["key"].isNotNull())
    last = F.filter(known, lambda x, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], text(x["value"]))))


def kind_of(name: Column, attrs: Column) -> Column:
    """A span's kind by its attributes, else by words of its name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    has = lambda k: F.coalesce(F.map_contains_key(attrs, F.lit(k)), F.lit(False))
    return F.when(has("gen_ai.tool.name") | n.contains("tool"), "tool").when(has("gen_ai.request.model") | n.rlike("llm|chat|completion"), "llm").when(has("gen_ai.agent.name") | n.contains("agent"), "agent").when(n.rlike("retriev|search"), "retrieval").otherwise("task")


def flatten(batches: DataFrame) -> DataFrame:
    """Spans of parsed batches. Empty and null batches have none. A span without a trace id belongs to the trace "unknown"; microseconds are kept of times."""
    each = batches.select(F.explode_outer("resourceSpans").alias("r")).select(F.explode_outer("r.scopeSpans").alias("s")).select(F.explode_outer("s.spans").alias("x")).filter("x is not null")
    micros = lambda c: F.timestamp_micros(F.expr(f"try_cast({c} as bigint) div 1000"))
    flat = each.select(F.coalesce("x.traceId", F.lit("unknown")).alias("trace_id"), F.col("x.spanId").alias("span_id"), F.col("x.parentSpanId").alias("parent_id"), F.col("x.name").alias("name"), micros("x.startTimeUnixNano").alias("start_time"), micros("x.endTimeUnixNano").alias("end_time"), F.when(F.col("x.status.code") == 2, "error").otherwise("ok").alias("status"), F.col("x.status.message").alias("error_message"), attributes(F.col("x.attributes")).alias("attributes"))
    return flat.withColumn("kind", kind_of(F.col("name"), F.col("attributes"))).withColumn("duration_ms", (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000)


def read_lines(spark: SparkSession, path: str, schema: str = SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON files, a document a line: errors keeps the text of each line that does not parse."""
    parsed = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    bad = F.col("x._bad").isNotNull()
    return parsed.filter(~bad).select("x.*").drop("_bad"), parsed.filter(bad).select(F.col("value").alias("line"))


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Spans of JSON files, one batch a line; see ``read_lines`` for the lines that do not parse."""
    return flatten(read_lines(spark, path)[0])


def first_attribute(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col("attributes")[k] for k in names])


def framework(attrs: Column) -> Column:
    """Of one span: what its provider is known as, else what its first attribute with a framework's prefix belongs to."""
    named = [F.when(F.lower(attrs[p]) == k, v) for p in PROVIDER for k, v in PROVIDERS.items()]
    by_prefix = F.filter(F.transform(F.map_keys(attrs), lambda k: reduce(lambda w, x: w.when(k.startswith(x[0]), x[1]), list(PREFIXES.items())[1:], F.when(k.startswith(next(iter(PREFIXES))), next(iter(PREFIXES.values()))))), lambda x: x.isNotNull())
    return F.coalesce(*named, F.get(by_prefix, F.lit(0)))


def with_tokens(spans: DataFrame) -> DataFrame:
    """tokens: the total if given, else input plus output where there is either, else 0."""
    n = lambda k: F.col("attributes")[k].try_cast("long")
    both = F.coalesce(n("gen_ai.usage.input_tokens"), F.lit(0)) + F.coalesce(n("gen_ai.usage.output_tokens"), F.lit(0))
    return spans.withColumn("tokens", F.coalesce(*[n(k) for k in TOKENS], both))


def state_hash(state: Column) -> Column:
    """The first half of the SHA-256 of a state's JSON with its keys in order; of a text that is no JSON, of that text as the value of "raw"; of no state, of an empty object."""
    text = F.coalesce(F.to_json(F.try_parse_json(state)), F.to_json(F.struct(state.alias("raw"))))
    spaced = F.regexp_replace(F.regexp_replace(text, '":', '": '), ',"', ', "')
    return F.substring(F.sha2(F.when(state.isNull(), "{}").otherwise(spaced), 256), 1, 16)


def states(spans: DataFrame) -> DataFrame:
    """Agent states: spans that name an agent, by an attribute or by their own name, numbered in their trace by start."""
    w = W.partitionBy("trace_id").orderBy("start_time", "span_id")
    s = with_tokens(spans).withColumn("framework", F.first(framework(F.col("attributes")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    agent, name = first_attribute(AGENT), F.lower(F.coalesce("name", F.lit("")))
    s = s.withColumn("agent_id", F.coalesce(agent, "name")).filter(agent.isNotNull() | name.startswith("openclaw.") | name.contains("agent") | name.contains("node"))
    return s.select(
        "trace_id", "span_id", (F.row_number().over(w) - 1).alias("sequence_num"), "agent_id", "tokens", "framework", first_attribute(MODEL).alias("model"), first_attribute(PROMPT).alias("prompt"), first_attribute(ANSWER).alias("response"),
        state_hash(first_attribute(STATE)).alias("state_hash"), F.floor("duration_ms").alias("latency_ms"), "start_time",
    )


def without_content(spans: DataFrame, keys: tuple[str, ...] = ("prompt", "completion", "input", "output", "content", "message")) -> DataFrame:
    """Attributes whose last part names content are dropped; structure stays."""
    last = lambda k: F.element_at(F.split(k, r"\."), -1)
    return spans.withColumn("attributes", F.map_filter("attributes", lambda k, _: ~last(k).isin(*keys)))
