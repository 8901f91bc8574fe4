"""Real-time rows: sliding rates, sessions and loop checks on streams of spans."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..plans.registry import query
from ..sources.adapters import AGENT_SPANS, SPANS, agent_spans

LATE = "10 minutes"
#: Calls of a tool in a row that warn and alarm; uses among the recent ones; calls of tools and models in a session; severity that blocks.
WARN, ALARM, USES, TOOLS, MODELS, BLOCK = 3, 5, 5, 100, 50, 60
#: Tool calls that a session remembers, and blocks from which enforcement goes a level up.
RECENT, VIOLATIONS = 20, 3
LEVELS = ("suggest", "direct", "block", "terminate")


def rates(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """(start, event_type, n) for every sliding window; on a stream late events are dropped after the watermark."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    return e.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, start, end, n): stretches of a user's events without a longer gap."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen")).select("user_id", F.col("w.start").alias("start"), "last_seen", "n")


def severity_of(run: int, uses: int, tools: int, models: int, is_tool: bool) -> int:
    """The worst of what a span sets off: its tool in a row, among the recent calls, and the session's calls."""
    loop = 60 + (run - ALARM) * 5 if run >= ALARM else 30 if run >= WARN else 0
    return max(loop if is_tool else 0, 30 if is_tool and uses >= USES else 0, 40 if tools > TOOLS or models > MODELS else 0)


def level_of(severity: int, violations: int) -> str:
    base = 2 if severity >= 80 else 1 if severity >= 60 else 0
    return LEVELS[min(base + 1, 3)] if severity >= 40 and violations >= VIOLATIONS else LEVELS[base]


LIVE = "trace_id long, span_id long, severity long, blocked boolean, level string"


def live_checks(spans: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """(trace_id, span_id, severity, blocked, level) of each span as it comes: what its session's recent tool calls, counters and blocks say.

    A stream with columns trace_id, span_id, us, kind, name. The state of a session is its recent tool names
    and four counters, and goes when the session is quiet for ``timeout_ms``. Spans of a batch are taken in order
    of time; one that comes after a later one of another batch is judged as it comes.
    """

    def step(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        recent, tools, models, violations = state.get if state.exists else ("", 0, 0, 0)
        names = recent.split("\n") if recent else []
        for frame in frames:  # Spark hands over a session's rows in pieces of bounded size
            out = []
            for span_id, kind, name in frame.sort_values(["us", "span_id"])[["span_id", "kind", "name"]].itertuples(index=False):
                is_tool = kind == "tool"
                tools, models = tools + is_tool, models + (kind == "llm")
                run = 1
                while is_tool and run <= len(names) and names[-run] == name:
                    run += 1
                severity = severity_of(run, names.count(name), tools, models, is_tool)
                out.append((key[0], span_id, severity, severity >= BLOCK, level_of(severity, violations)))
                violations += severity >= BLOCK
                names = [*names, name][-RECENT:] if is_tool else names
            yield pd.DataFrame(out, columns=["trace_id", "span_id", "severity", "blocked", "level"])
        state.update(("\n".join(names), tools, models, violations))
        state.setTimeoutDuration(timeout_ms)

    return spans.groupBy("trace_id").applyInPandasWithState(step, LIVE, "recent string, tools long, models long, violations long", "append", "ProcessingTimeTimeout")


_T = "(PARTITION BY trace_id ORDER BY us, span_id)"
_TK = "(PARTITION BY trace_id, kind ORDER BY us, span_id)"
_LIVE = f"""WITH {AGENT_SPANS}, q AS (SELECT *, row_number() OVER {_TK} AS tseq, CASE WHEN lag(name) OVER {_TK} = name THEN 0 ELSE 1 END AS ch, count(*) FILTER (WHERE kind = 'tool') OVER {_T} AS tools, count(*) FILTER (WHERE kind = 'llm') OVER {_T} AS models, len(list_filter(list(name) OVER (PARTITION BY trace_id, kind ORDER BY us, span_id ROWS BETWEEN {RECENT} PRECEDING AND 1 PRECEDING), lambda x: x = name)) AS uses FROM spans),
r AS (SELECT *, least(tseq - max(CASE WHEN ch = 1 THEN tseq END) OVER {_TK} + 1, {RECENT + 1}) AS run FROM q), s AS (SELECT *, greatest(CASE WHEN kind <> 'tool' THEN 0 WHEN run >= {ALARM} THEN 60 + (run - {ALARM}) * 5 WHEN run >= {WARN} THEN 30 ELSE 0 END, CASE WHEN kind = 'tool' AND uses >= {USES} THEN 30 ELSE 0 END, CASE WHEN tools > {TOOLS} OR models > {MODELS} THEN 40 ELSE 0 END) AS severity FROM r),
v AS (SELECT *, coalesce(sum(CASE WHEN severity >= {BLOCK} THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY us, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS violations FROM s)"""


def checked(a: DataFrame) -> DataFrame:
    """What ``live_checks`` says, for all spans of a table at once."""
    t, tk = W.partitionBy("trace_id").orderBy("us", "span_id"), W.partitionBy("trace_id", "kind").orderBy("us", "span_id")
    tool = F.col("kind") == "tool"
    a = a.repartition("trace_id").withColumns({"tseq": F.row_number().over(tk), "new": F.coalesce(F.lag("name").over(tk) != F.col("name"), F.lit(True)), "tools": F.count_if(tool).over(t), "models": F.count_if(F.col("kind") == "llm").over(t), "names": F.collect_list("name").over(tk.rowsBetween(-RECENT, -1))})
    run = F.least(F.col("tseq") - F.max(F.when(F.col("new"), F.col("tseq"))).over(tk) + 1, F.lit(RECENT + 1))
    a = a.withColumn("run", run).withColumn("uses", F.size(F.filter("names", lambda x: x == F.col("name"))))
    loop = F.when(~tool, 0).when(F.col("run") >= ALARM, 60 + (F.col("run") - ALARM) * 5).when(F.col("run") >= WARN, 30).otherwise(0)
    a = a.withColumn("severity", F.greatest(loop, F.when(tool & (F.col("uses") >= USES), 30).otherwise(0), F.when((F.col("tools") > TOOLS) | (F.col("models") > MODELS), 40).otherwise(0)).cast("long"))
    s = F.col("severity")
    before = F.coalesce(F.sum((s >= BLOCK).cast("int")).over(t.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = F.when(s >= 80, 2).when(s >= 60, 1).otherwise(0)
    at = F.when((s >= 40) & (before >= VIOLATIONS), F.least(base + 1, F.lit(3))).otherwise(base)
    return a.select("trace_id", "span_id", "severity", (s >= BLOCK).alias("blocked"), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), at + 1).alias("level"))


@query("i1_live_checks", f"{_LIVE} SELECT trace_id, span_id, CAST(severity AS BIGINT) AS severity, severity >= {BLOCK} AS blocked, ({list(LEVELS)!r})[CASE WHEN severity >= 40 AND violations >= {VIOLATIONS} THEN least(CASE WHEN severity >= 80 THEN 2 WHEN severity >= 60 THEN 1 ELSE 0 END + 1, 3) ELSE CASE WHEN severity >= 80 THEN 2 WHEN severity >= 60 THEN 1 ELSE 0 END END + 1] AS level FROM v")
def i1(spark, d) -> DataFrame:
    return checked(agent_spans(spark, d))


@query("i17_enforcement", f"{_LIVE} SELECT trace_id, count(*) FILTER (WHERE severity >= {BLOCK}) AS violations, count(*) FILTER (WHERE severity >= 40 AND violations >= {VIOLATIONS}) AS escalated FROM v GROUP BY 1")
def i17(spark, d) -> DataFrame:
    """Blocks of each session, and the findings judged a level higher because of earlier ones."""
    done = F.sum(F.col("blocked").cast("int")).over(W.partitionBy("trace_id").orderBy("us", "span_id").rowsBetween(W.unboundedPreceding, -1))
    a = agent_spans(spark, d)
    c = checked(a).join(a.select("trace_id", "span_id", "us"), ["trace_id", "span_id"]).withColumn("before", F.coalesce(done, F.lit(0)))
    return c.groupBy("trace_id").agg(F.count_if("blocked").alias("violations"), F.count_if((F.col("severity") >= 40) & (F.col("before") >= VIOLATIONS)).alias("escalated"))


def stream(spark: SparkSession, path: str, pattern: str = "*.parquet", files: int = 4) -> DataFrame:
    """Events of a folder's Parquet files as they come, at most ``files`` in a batch."""
    schema = spark.read.parquet(os.path.join(path, pattern)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)


def upsert(target: str, key: str):
    """A foreachBatch sink that writes each batch once, by its number, so that a repeated batch replaces itself; ``latest`` reads the target."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """Of an upsert's target the newest row of each key."""
    rows = spark.read.option("basePath", target).parquet(target)
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("x")).select("x.*")


@query("i13_chunks", "WITH n AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), c AS (SELECT conv_id, unnest(generate_series(0, greatest(last - 4, 0), 3)) AS first FROM n) SELECT c.conv_id, CAST(first // 3 AS BIGINT) AS chunk, count(*) AS turns FROM c JOIN conversations t ON t.conv_id = c.conv_id AND (t.turn = 0 OR t.turn BETWEEN first AND first + 4) GROUP BY 1, 2")
def i13(spark, d, size: int = 5, step: int = 3) -> DataFrame:
    """Overlapping chunks of a conversation, each with its first turn again. A turn finds its own chunks, so that none is joined."""
    t = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn")
    t = t.withColumn("last", F.max("turn").over(W.partitionBy("conv_id")))
    most = F.floor(F.greatest(F.col("last") - (size - 1), F.lit(0)) / step)
    low = F.when(F.col("turn") == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((F.col("turn") - size + 1) / step)))
    high = F.when(F.col("turn") == 0, most).otherwise(F.least(most, F.floor(F.col("turn") / step)))
    chunks = t.withColumn("chunk", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>"))))
    return chunks.groupBy("conv_id", "chunk").agg(F.count("*").alias("turns"))


@query("i14_focus_window", "SELECT c.conv_id, c.turn, count(*) AS turns, CAST(sum(length(o.text)) AS BIGINT) AS chars FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id AND (o.turn = 0 OR abs(o.turn - c.turn) <= 2) GROUP BY 1, 2")
def i14(spark, d, around: int = 2) -> DataFrame:
    """The turns around each turn, and the conversation's first, in one window."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    whole, near = W.partitionBy("conv_id"), W.partitionBy("conv_id").orderBy("turn").rangeBetween(-around, around)
    first = F.max(F.when(F.col("turn") == 0, F.length("text"))).over(whole)
    far = F.col("turn") > around
    return t.select("conv_id", "turn", (F.count("*").over(near) + F.when(far & first.isNotNull(), 1).otherwise(0)).alias("turns"), (F.sum(F.length("text")).over(near) + F.when(far, F.coalesce(first, F.lit(0))).otherwise(0)).alias("chars"))


@query("i15_drift_window", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, first_value(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS ref FROM embeddings WHERE label IS NOT NULL), s AS (SELECT vec_id, label, list_cosine_similarity(e, ref) AS s FROM e) SELECT vec_id, round(avg(s) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS similarity FROM s")
def i15(spark, d, last: int = 5) -> DataFrame:
    """Mean similarity of the last five vectors of a label to its first."""
    w = W.partitionBy("label").orderBy("vec_id")
    e = spark.read.parquet(f"{d}/embeddings.parquet").filter("label is not null").withColumn("s", cosine(F.col("embedding"), F.first("embedding").over(w)))
    return e.select("vec_id", F.round(F.avg("s").over(w.rowsBetween(1 - last, 0)), 6).alias("similarity"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("i9_sliding_rates", "SELECT CAST(w AS TIMESTAMP) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2")
def i9(spark, d) -> DataFrame:
    out = rates(_events(spark, d))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("i10_daily_usage", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 5 AS over_limit FROM events GROUP BY 1, 2")
def i10(spark, d) -> DataFrame:
    return _events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("over_limit", F.col("n") > 5)


@query("i18_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, sid""")
def i18(spark, d) -> DataFrame:
    out = sessions(_events(spark, d))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("i16_velocity", f"WITH {SPANS} SELECT span_id, count(*) OVER (PARTITION BY trace_id ORDER BY start_time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM spans")
def i16(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    e = _events(spark, d).withColumn("at", F.unix_micros("ts"))
    return e.select(F.col("event_id").alias("span_id"), F.count("*").over(W.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0)).alias("n"))
