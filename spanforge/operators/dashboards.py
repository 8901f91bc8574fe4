"""Panels of a dashboard: grouped figures, ranked lists, set comparisons, and the queries that are made of them."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..plans.registry import query
from ..sources.adapters import NOW, PARENTS, PREDICTIONS, SPANS, parents, predictions, read, spans
from .lookups import optional

_NOW = f"TIMESTAMP '{NOW}'"


@query("d2_json_average", f"WITH {SPANS} SELECT name, round(coalesce(avg(k), 0), 6) AS mean_k FROM spans GROUP BY 1")
def d2(spark, d) -> DataFrame:
    """Mean of a JSON field; nulls do not count, and no value at all gives 0."""
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'double')")
    return read(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.coalesce(F.avg(k), F.lit(0.0)), 6).alias("mean_k"))


_CATEGORY = "CASE WHEN event_type IN ('click', 'view') THEN 'navigation' WHEN event_type = 'error' THEN 'reliability' ELSE 'conversion' END"


@query("d7_category_average", f"SELECT {_CATEGORY} AS category, round(avg(value) / 100, 6) AS score, count(*) AS n FROM events GROUP BY 1")
def d7(spark, d) -> DataFrame:
    return read(spark, d, "events").groupBy(F.expr(_CATEGORY).alias("category")).agg(F.round(F.avg("value") / 100, 6).alias("score"), F.count("*").alias("n"))


@query("d9_filtered_counts", f"WITH {SPANS} SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE kind = 'llm' AND value > 50) AS costly FROM spans GROUP BY 1")
def d9(spark, d) -> DataFrame:
    return spans(spark, d).groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if((F.col("kind") == "llm") & (F.col("value") > 50)).alias("costly"))


@query("d11_next_version", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def d11(spark, d) -> DataFrame:
    """One after the largest version of each workflow; 1 for one without any."""
    last = read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    return read(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (F.coalesce("last", F.lit(0)) + 1).alias("next_version"))


@query("d12_mean_difference", "SELECT l_returnflag, round(avg(l_extendedprice * (1 - l_discount) - l_extendedprice), 4) AS gain FROM lineitem GROUP BY 1")
def d12(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_extendedprice")), 4).alias("gain"))


@query("d16_nested_groups", "SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY 1, 2")
def d16(spark, d) -> DataFrame:
    return read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("importance"))


def trace_summary(p: DataFrame) -> DataFrame:
    """(trace_id, started, ended, tokens, errors, spans) in one aggregate."""
    return p.groupBy("trace_id").agg(F.min("start_time").alias("started"), F.max("end_time").alias("ended"), F.sum("k").alias("tokens"), F.count_if(F.col("status") == "error").alias("errors"), F.count("*").alias("spans"))


@query("d18_trace_summary", f"WITH {PARENTS} SELECT trace_id, min(start_time) AS started, max(end_time) AS ended, CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (WHERE status = 'error') AS errors, count(*) AS spans FROM parents GROUP BY 1")
def d18(spark, d) -> DataFrame:
    return trace_summary(parents(spark, d))


@query("d20_latency", f"WITH {SPANS} SELECT name, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, max(value) AS slowest FROM spans GROUP BY 1")
def d20(spark, d) -> DataFrame:
    """Latency by detector. Exact percentiles over counts of distinct latencies, which are first summed in every task."""
    counts = spans(spark, d).groupBy("name", "value").agg(F.count("*").alias("n"))
    at = lambda q, name: F.round(F.percentile("value", F.lit(q), F.col("n")), 4).alias(name)
    return counts.groupBy("name").agg(F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 4).alias("mean"), at(0.5, "p50"), at(0.95, "p95"), at(0.99, "p99"), F.max("value").alias("slowest"))


@query("e21_priority_order", f"WITH {SPANS} SELECT span_id, row_number() OVER (PARTITION BY trace_id ORDER BY k DESC NULLS LAST, value DESC, span_id) AS priority FROM spans WHERE status = 'error'")
def e21(spark, d) -> DataFrame:
    """Findings of a trace by severity, then confidence."""
    w = W.partitionBy("trace_id").orderBy(F.desc_nulls_last("k"), F.desc("value"), "span_id")
    return spans(spark, d).filter("status = 'error'").select("span_id", F.row_number().over(w).cast("long").alias("priority"))


@query("f2_costliest_traces", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def f2(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


#: Orders of the review queue.
SORTS = {"newest": ("o_orderdate", False), "oldest": ("o_orderdate", True), "confidence_low": ("o_totalprice", True), "confidence_high": ("o_totalprice", False)}


def sorted_page(df: DataFrame, sort: str, key: str, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the rows in one of the named orders, ties by key; an unknown name sorts by the newest."""
    column, up = SORTS.get(sort, SORTS["newest"])
    return df.orderBy(F.asc(column) if up else F.desc(column), key).offset((page - 1) * size).limit(size)


@query("f4_review_order", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 20")
def f4(spark, d) -> DataFrame:
    return sorted_page(read(spark, d, "orders").filter("o_orderstatus = 'P'"), "confidence_low", "o_orderkey", page=2).select("o_orderkey")


_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"


@query("f5_stable_order", f"SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK}, o_totalprice DESC, o_orderkey) AS place FROM orders")
def f5(spark, d) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.expr(_RANK), F.desc("o_totalprice"), "o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("f6_top_issues", f"WITH {SPANS} SELECT name, count(*) AS n, arg_min(k, (start_time, span_id)) AS first_severity FROM spans WHERE k IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
def f6(spark, d) -> DataFrame:
    """The commonest issues, with the severity that was seen first."""
    s = spans(spark, d).filter("k is not null").groupBy("name").agg(F.count("*").alias("n"), F.min_by("k", F.struct("start_time", "span_id")).alias("first_severity"))
    return s.orderBy(F.desc("n"), "name").limit(5)


@query("f8_primary_issue", f"WITH {SPANS} SELECT trace_id, arg_max(name, (CASE name WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END, value, span_id)) AS primary_issue FROM spans GROUP BY 1")
def f8(spark, d) -> DataFrame:
    """A trace's issue of the highest priority, the largest of equals."""
    rank = F.when(F.col("name") == "error", 4).when(F.col("name") == "purchase", 3).when(F.col("name") == "signup", 2).otherwise(1)
    return spans(spark, d).groupBy("trace_id").agg(F.max_by("name", F.struct(rank, "value", "span_id")).alias("primary_issue"))


_HALVES = f"WITH {SPANS}, a AS (SELECT DISTINCT trace_id, name FROM spans WHERE start_time < TIMESTAMP '2024-01-16'), b AS (SELECT DISTINCT trace_id, name FROM spans WHERE start_time >= TIMESTAMP '2024-01-16')"


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    """The two halves of the month as two runs."""
    s, middle = spans(spark, d), F.lit("2024-01-16").cast("timestamp")
    return s.filter(F.col("start_time") < middle).select("trace_id", "name").distinct(), s.filter(F.col("start_time") >= middle).select("trace_id", "name").distinct()


@query("g1_union_of_names", f"{_HALVES} SELECT trace_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1")
def g1(spark, d) -> DataFrame:
    a, b = halves(spark, d)
    return a.union(b).groupBy("trace_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("g2_set_measures", f"{_HALVES}, s AS (SELECT coalesce(x.trace_id, y.trace_id) AS trace_id, coalesce(x.l, []) AS l, coalesce(y.l, []) AS r FROM (SELECT trace_id, list(name) AS l FROM a GROUP BY 1) x FULL JOIN (SELECT trace_id, list(name) AS l FROM b GROUP BY 1) y ON x.trace_id = y.trace_id) SELECT trace_id, len(list_intersect(l, r)) AS shared, len(l) - len(list_intersect(l, r)) AS dropped, len(r) - len(list_intersect(l, r)) AS added, round(CASE WHEN len(l) = 0 THEN 0 ELSE CAST(len(list_intersect(l, r)) AS DOUBLE) / len(l) END, 6) AS contained FROM s")
def g2(spark, d) -> DataFrame:
    a, b = (x.groupBy("trace_id").agg(F.collect_set("name").alias(n)) for x, n in zip(halves(spark, d), "lr", strict=True))
    none = F.array().cast("array<string>")
    s = a.join(b, "trace_id", "full").select("trace_id", F.coalesce("l", none).alias("l"), F.coalesce("r", none).alias("r"))
    shared = F.size(F.array_intersect("l", "r")).cast("long")
    return s.select("trace_id", shared.alias("shared"), F.size(F.array_except("l", "r")).cast("long").alias("dropped"), F.size(F.array_except("r", "l")).cast("long").alias("added"), F.round(ratio(shared, F.size("l")), 6).alias("contained"))


@query("g3_failures_and_healthy", """WITH s AS (SELECT d.doc_id, length(text) AS n, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL), f AS (SELECT doc_id, n, 'failure' AS side FROM s WHERE toxic = 1 ORDER BY abs(n - 1000), doc_id LIMIT 5), h AS (SELECT doc_id, n, 'healthy' AS side FROM s WHERE toxic = 0 ORDER BY abs(n - 1000), doc_id LIMIT 5) SELECT * FROM f UNION ALL SELECT * FROM h""")
def g3(spark, d, k: int = 5, size: int = 1000) -> DataFrame:
    """The nearest failures and the nearest healthy records of a text length, together."""
    s = read(spark, d, "documents").filter("text is not null").select("doc_id", F.length("text").cast("long").alias("n")).join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    near = lambda label, side: s.filter(F.col("toxic") == label).orderBy(F.abs(F.col("n") - size), "doc_id").limit(k).select("doc_id", "n", F.lit(side).alias("side"))
    return near(1, "failure").unionByName(near(0, "healthy"))


_SETS = f"WITH {PREDICTIONS}, t AS (SELECT DISTINCT mode, record_id FROM predictions WHERE truth), p AS (SELECT DISTINCT mode, record_id FROM predictions WHERE detected)"


@query("g5_set_confusion", f"{_SETS} SELECT coalesce(t.mode, p.mode) AS mode, count(*) FILTER (WHERE t.record_id IS NOT NULL AND p.record_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.record_id IS NULL) AS fp, count(*) FILTER (WHERE p.record_id IS NULL) AS fn FROM t FULL JOIN p ON t.mode = p.mode AND t.record_id = p.record_id GROUP BY 1")
def g5(spark, d) -> DataFrame:
    """True and false positives and misses as set algebra of true and predicted places."""
    p = predictions(spark, d)
    true, found = (p.filter(c).select("mode", "record_id").distinct().withColumn(c, F.lit(True)) for c in ("truth", "detected"))
    both = true.join(found, ["mode", "record_id"], "full")
    return both.groupBy("mode").agg(F.count_if(F.col("truth") & F.col("detected")).alias("tp"), F.count_if(F.col("truth").isNull()).alias("fp"), F.count_if(F.col("detected").isNull()).alias("fn"))


# The panels below answer in long form: (panel, key, value), so that one result holds all of them.


def panel(df: DataFrame, name: str, key, value) -> DataFrame:
    return df.select(F.lit(name).alias("panel"), key.cast("string").alias("key"), F.round(value.cast("double"), 4).alias("value"))


def _panel(name: str, key: str, value: str, rest: str) -> str:
    return f"SELECT '{name}' AS panel, CAST({key} AS VARCHAR) AS key, round(CAST({value} AS DOUBLE), 4) AS value FROM {rest}"


_LOOPS = f"WITH {SPANS}, r AS (SELECT * FROM spans WHERE start_time >= {_NOW} - INTERVAL 30 DAY AND start_time < {_NOW} AND status = 'error'), days AS (SELECT CAST(unnest(generate_series({_NOW} - INTERVAL 30 DAY, {_NOW} - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day), a AS (SELECT name, count(*) AS n FROM (SELECT s.name FROM r JOIN spans s ON s.span_id = r.span_id + 1) GROUP BY 1 ORDER BY n DESC, name LIMIT 10)"


@query("v1_loop_analytics", " UNION ALL ".join([
    f"{_LOOPS} SELECT * FROM ({_panel('by_method', 'coalesce(name, chr(117))', 'count(*)', 'r GROUP BY name')}",
    _panel("mean_length", "'all'", "coalesce(avg(k), 0)", "r"), _panel("top_agents", "name", "n", "a"),
    _panel("daily", "day", "count(span_id)", "days LEFT JOIN r ON CAST(start_time AS DATE) = day GROUP BY day") + ")",
]))
def v1(spark, d) -> DataFrame:
    """Findings of the last thirty days by method, their mean length, the agents most concerned, and a day's number, days without any included."""
    s, now = spans(spark, d), F.lit(NOW).cast("timestamp")
    r = s.filter((F.col("start_time") >= now - F.expr("interval 30 days")) & (F.col("start_time") < now) & (F.col("status") == "error"))
    agents = r.select((F.col("span_id") + 1).alias("span_id")).join(s.select("span_id", "name"), "span_id").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{NOW}' - interval 30 days, date'{NOW}' - interval 1 day)")).alias("day")).select(F.col("day").cast("date").alias("day"))
    daily = days.join(r.groupBy(F.to_date("start_time").alias("day")).agg(F.count("*").alias("n")), "day", "left")
    return (
        panel(r.groupBy(F.coalesce("name", F.lit("u")).alias("name")).agg(F.count("*").alias("n")), "by_method", F.col("name"), F.col("n"))
        .unionByName(panel(r.agg(F.coalesce(F.avg("k"), F.lit(0)).alias("n")), "mean_length", F.lit("all"), F.col("n")))
        .unionByName(panel(agents, "top_agents", F.col("name"), F.col("n")))
        .unionByName(panel(daily, "daily", F.col("day"), F.coalesce("n", F.lit(0))))
    )


@query("v3_quality_analytics", " UNION ALL ".join([
    f"WITH {SPANS} SELECT * FROM ({_panel('distribution', 'least(floor(value / 10) * 10, 90)::BIGINT', 'count(*)', 'spans GROUP BY least(floor(value / 10) * 10, 90)')}",
    _panel("category", "c", "avg(value) / 100", f"(SELECT {_CATEGORY} AS c, value FROM events) GROUP BY c"),
    _panel("trend", "CAST(start_time AS DATE)", "avg(value)", "spans GROUP BY CAST(start_time AS DATE)"),
    "SELECT * FROM (" + _panel("issues", "name", "count(*)", "spans WHERE k > 50 GROUP BY name ORDER BY count(*) DESC, name LIMIT 5") + "))",
]))
def v3(spark, d) -> DataFrame:
    """Score histogram, mean by category, daily trend and the commonest issues."""
    s = spans(spark, d)
    bucket = F.least(F.floor(F.col("value") / 10) * 10, F.lit(90)).alias("b")
    issues = s.filter("k > 50").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(5)
    return (
        panel(s.groupBy(bucket).agg(F.count("*").alias("n")), "distribution", F.col("b"), F.col("n"))
        .unionByName(panel(d7(spark, d), "category", F.col("category"), F.col("score")))
        .unionByName(panel(s.groupBy(F.to_date("start_time").alias("day")).agg(F.avg("value").alias("v")), "trend", F.col("day"), F.col("v")))
        .unionByName(panel(issues, "issues", F.col("name"), F.col("n")))
    )


@query("v6_trace_page", f"WITH {SPANS}, t AS (SELECT trace_id, min(start_time) AS started FROM spans GROUP BY 1 ORDER BY started DESC, trace_id LIMIT 20 OFFSET 20) SELECT t.trace_id, started, coalesce(s.n, 0) AS states, coalesce(e.n, 0) AS detections FROM t LEFT JOIN (SELECT trace_id, count(*) AS n FROM spans GROUP BY 1) s ON s.trace_id = t.trace_id LEFT JOIN (SELECT trace_id, count(*) AS n FROM spans WHERE status = 'error' GROUP BY 1) e ON e.trace_id = t.trace_id")
def v6(spark, d, page: int = 2, size: int = 20) -> DataFrame:
    """A page of the newest traces with the numbers of their states and detections, all from one aggregate."""
    per = spans(spark, d).groupBy("trace_id").agg(F.min("start_time").alias("started"), F.count("*").alias("states"), F.count_if(F.col("status") == "error").alias("detections"))
    return per.orderBy(F.desc("started"), "trace_id").offset((page - 1) * size).limit(size)


@query("v7_detection_page", f"WITH {SPANS} SELECT span_id, name, value FROM spans WHERE status = 'error' AND value / 100 >= 0.6 ORDER BY start_time DESC, span_id LIMIT 50")
def v7(spark, d, least: float | None = 0.6, kind: str | None = None, size: int = 50) -> DataFrame:
    """Detections that meet the filters given, the newest first."""
    s = optional(spans(spark, d), status="error", kind=kind)
    s = s if least is None else s.filter(F.col("value") / 100 >= least)
    return s.orderBy(F.desc("start_time"), "span_id").limit(size).select("span_id", "name", "value")


@query("v8_agent_quality", f"WITH {SPANS}, a AS (SELECT name AS agent, round(avg(value), 1) AS mean, min(value) AS lowest, max(value) AS highest, count(DISTINCT trace_id) AS runs, count(*) FILTER (WHERE status = 'error') AS issues FROM spans GROUP BY 1) SELECT *, CASE WHEN mean >= 90 THEN 'healthy' WHEN mean >= 70 THEN 'degraded' WHEN mean >= 50 THEN 'poor' ELSE 'critical' END AS band FROM a")
def v8(spark, d) -> DataFrame:
    a = spans(spark, d).groupBy(F.col("name").alias("agent")).agg(F.round(F.avg("value"), 1).alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.countDistinct("trace_id").alias("runs"), F.count_if(F.col("status") == "error").alias("issues"))
    m = F.col("mean")
    return a.withColumn("band", F.when(m >= 90, "healthy").when(m >= 70, "degraded").when(m >= 50, "poor").otherwise("critical"))


@query("v9_review_queue", "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'en' AND toxic IS NOT NULL ORDER BY n_chars DESC, d.doc_id LIMIT 20")
def v9(spark, d, size: int = 20) -> DataFrame:
    docs = optional(read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), lang="en", source=None)
    labels = read(spark, d, "labels").filter("toxic is not null").select("doc_id", "quality")
    return docs.join(labels, "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(size).select("doc_id", "lang", "quality")


@query("v13_healing_stats", "SELECT o_orderstatus AS status, count(*) AS n, round(avg(l_extendedprice * l_discount), 4) AS gain FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def v13(spark, d) -> DataFrame:
    """Healings by status with the mean gain of their steps; steps are summed by healing before the join."""
    steps = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("gain"))
    j = read(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(steps, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_orderstatus").alias("status")).agg(F.sum("n").alias("n"), F.round(F.sum("gain") / F.sum("n"), 4).alias("gain"))


@query("s8_fix_effectiveness", "SELECT l_shipmode_type AS detection, fix, count(*) AS n, round(avg(ok), 6) AS success_rate FROM (SELECT l_returnflag AS l_shipmode_type, l_linestatus AS fix, CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS ok FROM lineitem) GROUP BY 1, 2")
def s8(spark, d) -> DataFrame:
    """Success rate of each fix for each type of detection."""
    ok = F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("detection"), F.col("l_linestatus").alias("fix")).agg(F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("success_rate"))


@query("s10_audit_log", "SELECT event_id, ts FROM events WHERE user_id = 8 AND event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 100")
def s10(spark, d, session: int | None = 8, kind: str | None = "error", since: str | None = "2024-01-10", size: int = 100) -> DataFrame:
    """The latest events of the log that meet the filters given."""
    e = optional(read(spark, d, "events"), user_id=session, event_type=kind)
    e = e if since is None else e.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    return e.orderBy(F.desc("ts"), "event_id").limit(size).select("event_id", "ts")


#: States a day that a plan allows; a deployment sets its own.
PLANS = {"free": 5, "pro": 50}


@query("s11_billing_usage", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used, count(*) > 5 AS over_free, count(*) > 50 AS over_pro FROM events GROUP BY 1, 2")
def s11(spark, d) -> DataFrame:
    per = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    return per.withColumns({f"over_{plan}": F.col("used") > most for plan, most in PLANS.items()})
