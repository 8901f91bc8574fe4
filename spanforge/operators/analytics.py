"""Dashboards: grouped aggregates, time series, top lists, pages and set comparisons."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import NOW, SPANS, order, read, spans


@query("b3_tool_sequence", f"WITH {SPANS} SELECT trace_id, string_agg(name, '>' ORDER BY start_time, span_id) AS tools FROM spans WHERE kind = 'tool' GROUP BY 1")
def tool_sequence(spark, d) -> DataFrame:
    s = spans(spark, d).filter("kind = 'tool'")
    in_order = F.array_sort(F.collect_list(F.struct("start_time", "span_id", "name")))
    return s.groupBy("trace_id").agg(F.array_join(F.transform(in_order, lambda x: x["name"]), ">").alias("tools"))


@query("b4_recent_spans", f"WITH {SPANS} SELECT trace_id, count(*) AS n FROM spans WHERE start_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND start_time < TIMESTAMP '{NOW}' GROUP BY 1")
def recent_spans(spark, d) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return spans(spark, d).filter((F.col("start_time") >= now - F.expr("interval 7 days")) & (F.col("start_time") < now)).groupBy("trace_id").agg(F.count("*").alias("n"))


@query("b7_keyword_search", "SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%password%' OR text ILIKE '%token%'")
def keyword_search(spark, d) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").filter(t.ilike("%license%") | t.ilike("%password%") | t.ilike("%token%")).select("doc_id")


@query("b8_json_field_average", "SELECT event_type, round(avg(CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS DOUBLE)), 6) AS mean_k FROM events GROUP BY 1")
def json_field_average(spark, d) -> DataFrame:
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'double')")
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(k), 6).alias("mean_k"))


@query("b12_confidence_tiers", "SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'high' WHEN value / 100 >= 0.6 THEN 'likely' WHEN value / 100 >= 0.4 THEN 'possible' ELSE 'low' END AS tier FROM events")
def confidence_tiers(spark, d) -> DataFrame:
    c = F.col("value") / 100
    return read(spark, d, "events").select("event_id", F.when(c >= 0.8, "high").when(c >= 0.6, "likely").when(c >= 0.4, "possible").otherwise("low").alias("tier"))


@query("c1_items_per_customer", "SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def items_per_customer(spark, d) -> DataFrame:
    # Lines are counted per order first, so that one short row an order is shuffled for the join.
    per_order = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    return read(spark, d, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("lines").alias("n"))


@query("c4_counts_attached", "SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(u, 0) AS urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def counts_attached(spark, d) -> DataFrame:
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return read(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("u", F.lit(0)).alias("urgent"))


@query("c7_compare_two_runs", f"""WITH {SPANS}, a AS (SELECT trace_id, max(value) AS v FROM spans WHERE start_time < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT trace_id, max(value) AS v FROM spans WHERE start_time >= TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT coalesce(a.trace_id, b.trace_id) AS trace_id, coalesce(a.v, 0) AS before, coalesce(b.v, 0) AS after, CASE WHEN a.v IS NULL THEN 'new' WHEN b.v IS NULL THEN 'resolved' WHEN b.v > a.v THEN 'worse' WHEN b.v < a.v THEN 'better' ELSE 'same' END AS change FROM a FULL JOIN b ON a.trace_id = b.trace_id""")
def compare_two_runs(spark, d) -> DataFrame:
    """The two halves of the month as two runs."""
    s, middle = spans(spark, d), F.lit("2024-01-16").cast("timestamp")
    a, b = s.filter(F.col("start_time") < middle).groupBy("trace_id").agg(F.max("value").alias("a")), s.filter(F.col("start_time") >= middle).groupBy("trace_id").agg(F.max("value").alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved").when(F.col("b") > F.col("a"), "worse").when(F.col("b") < F.col("a"), "better").otherwise("same")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return a.join(b, "trace_id", "full").select("trace_id", zero("a").alias("before"), zero("b").alias("after"), change.alias("change"))


@query("c9_next_span_pairs", f"WITH {SPANS} SELECT name, next_name, count(*) AS n FROM (SELECT name, lead(name) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS next_name FROM spans) WHERE next_name IS NOT NULL GROUP BY 1, 2")
def next_span_pairs(spark, d) -> DataFrame:
    return spans(spark, d).withColumn("next_name", F.lead("name").over(order())).filter("next_name is not null").groupBy("name", "next_name").agg(F.count("*").alias("n"))


@query("c10_opposing_within_band", f"""WITH {SPANS} SELECT a.span_id AS first_id, b.span_id AS second_id FROM spans a JOIN spans b ON a.trace_id = b.trace_id AND a.name = 'purchase' AND b.name = 'error'
AND b.start_time > a.start_time AND b.start_time <= a.start_time + INTERVAL 30 MINUTE""")
def opposing_within_band(spark, d, seconds: int = 1800) -> DataFrame:
    """A range join as an equal join on time bins: the second span's bin is the first's or the next one."""
    s = spans(spark, d).withColumn("at", F.unix_micros(F.col("start_time").cast("timestamp")))
    width = seconds * 1_000_000
    a = s.filter("name = 'purchase'").select("trace_id", F.col("span_id").alias("first_id"), F.col("at").alias("t1"), F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) + 1)).alias("bin"))
    b = s.filter("name = 'error'").select("trace_id", F.col("span_id").alias("second_id"), F.col("at").alias("t2"), F.floor(F.col("at") / width).alias("bin"))
    return a.join(b, ["trace_id", "bin"]).filter((F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t1") + width)).select("first_id", "second_id")


@query("c14_never_answered", f"WITH {SPANS} SELECT a.span_id FROM spans a WHERE a.name = 'view' AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.trace_id = a.trace_id AND b.name = 'purchase' AND b.start_time > a.start_time)")
def never_answered(spark, d) -> DataFrame:
    """The latest answer decides: one row a trace instead of an inequality join."""
    s = spans(spark, d)
    last = s.filter("name = 'purchase'").groupBy("trace_id").agg(F.max("start_time").alias("last"))
    return s.filter("name = 'view'").join(last, "trace_id", "left").filter(F.col("last").isNull() | (F.col("last") <= F.col("start_time"))).select("span_id")


@query("c16_approved_before", f"WITH {SPANS} SELECT span_id, coalesce(max(CASE WHEN name = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY start_time, span_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) = 1 AS approved FROM spans")
def approved_before(spark, d) -> DataFrame:
    flag = F.max(F.when(F.col("name") == "signup", 1).otherwise(0)).over(order().rowsBetween(-5, -1))
    return spans(spark, d).select("span_id", (F.coalesce(flag, F.lit(0)) == 1).alias("approved"))


@query("d1_count_by_key", "SELECT coalesce(o_orderpriority, 'unknown') AS method, count(*) AS n FROM orders GROUP BY 1")
def count_by_key(spark, d) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.coalesce("o_orderpriority", F.lit("unknown")).alias("method")).agg(F.count("*").alias("n"))


@query("d3_cost_by_segment", "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS cost, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def cost_by_segment(spark, d) -> DataFrame:
    return read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("cost"), F.count("*").alias("n"))


@query("d4_daily_series", f"""WITH {SPANS}, days AS (SELECT CAST(x AS DATE) AS day FROM generate_series(TIMESTAMP '{NOW}' - INTERVAL 30 DAY, TIMESTAMP '{NOW}' - INTERVAL 1 DAY, INTERVAL 1 DAY) t(x))
SELECT day, count(span_id) AS n FROM days LEFT JOIN (SELECT * FROM spans WHERE status = 'error') s ON CAST(s.start_time AS DATE) = day GROUP BY 1""")
def daily_series(spark, d) -> DataFrame:
    now = F.lit(NOW).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(now, 30), F.date_sub(now, 1))).alias("day"))
    n = spans(spark, d).filter("status = 'error'").groupBy(F.to_date("start_time").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("d5_agent_rollup", f"WITH {SPANS} SELECT trace_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS tokens, round(avg(value), 6) AS mean_value, max(start_time) AS last_seen FROM spans GROUP BY 1")
def agent_rollup(spark, d) -> DataFrame:
    return spans(spark, d).groupBy("trace_id").agg(F.count("*").alias("n"), F.sum("k").alias("tokens"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("start_time").alias("last_seen"))


@query("d6_score_histogram", "SELECT CAST(least(floor(least(value, 100) / 10) * 10, 90) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
def score_histogram(spark, d) -> DataFrame:
    score = F.least("value", F.lit(100.0))
    return read(spark, d, "events").groupBy(F.least(F.floor(score / 10) * 10, F.lit(90)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("d8_status_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_pivot(spark, d) -> DataFrame:
    wide = read(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@query("d13_distinct_counts", f"WITH {SPANS} SELECT trace_id, count(DISTINCT name) AS names, count(DISTINCT k) AS keys FROM spans GROUP BY 1")
def distinct_counts(spark, d) -> DataFrame:
    return spans(spark, d).groupBy("trace_id").agg(F.countDistinct("name").alias("names"), F.countDistinct("k").alias("keys"))


@query("d14_most_common", f"WITH {SPANS}, c AS (SELECT trace_id, name, count(*) AS n FROM spans GROUP BY 1, 2) SELECT trace_id, name, n FROM c QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, name) = 1")
def most_common(spark, d) -> DataFrame:
    c = spans(spark, d).groupBy("trace_id", "name").agg(F.count("*").alias("n"))
    best = c.groupBy("trace_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "name", "n")).alias("x"))
    return best.select("trace_id", "x.name", "x.n")


@query("d15_first_and_last", f"WITH {SPANS}, s AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) - 1 AS seq FROM spans) SELECT trace_id, name, min(seq) AS first_seq, max(seq) AS last_seq FROM s GROUP BY 1, 2")
def first_and_last(spark, d) -> DataFrame:
    s = spans(spark, d).withColumn("seq", (F.row_number().over(order()) - 1).cast("long"))
    return s.groupBy("trace_id", "name").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("d17_weighted_mean", f"WITH {SPANS} SELECT trace_id, round(CASE WHEN sum(k) = 0 THEN 0 ELSE sum(value * k) / sum(k) END, 6) AS weighted FROM spans GROUP BY 1")
def weighted_mean(spark, d) -> DataFrame:
    return spans(spark, d).groupBy("trace_id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("k")), F.sum("k")), F.lit(0.0)), 6).alias("weighted"))


@query("d19_baselines", f"WITH {SPANS} SELECT name, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM spans GROUP BY 1")
def baselines(spark, d) -> DataFrame:
    return spans(spark, d).groupBy("name").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.percentile("value", 0.75), 6).alias("p75"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("d21_gini", f"""WITH {SPANS}, w AS (SELECT trace_id, name, count(*) AS w FROM spans GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY w, name) AS i, count(*) OVER (PARTITION BY trace_id) AS n FROM w)
SELECT trace_id, round(CAST(sum((2 * i - n - 1) * w) AS DOUBLE) / (any_value(n) * CAST(sum(w) AS DOUBLE)), 6) AS gini FROM r GROUP BY 1""")
def gini(spark, d) -> DataFrame:
    w = spans(spark, d).groupBy("trace_id", "name").agg(F.count("*").alias("w"))
    r = w.withColumn("i", F.row_number().over(W.partitionBy("trace_id").orderBy("w", "name"))).withColumn("n", F.count("*").over(W.partitionBy("trace_id")))
    return r.groupBy("trace_id").agg(F.round(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("w")) / (F.first("n") * F.sum("w")), 6).alias("gini"))


@query("f1_top_agents", f"WITH {SPANS} SELECT trace_id, count(*) AS n FROM spans WHERE status = 'error' GROUP BY 1 ORDER BY n DESC, trace_id LIMIT 10")
def top_agents(spark, d) -> DataFrame:
    return spans(spark, d).filter("status = 'error'").groupBy("trace_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trace_id").limit(10)


@query("f3_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page(spark, d, number: int = 2, size: int = 20) -> DataFrame:
    return read(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(number * size).limit(size).select("o_orderkey", "o_totalprice")


@query("f7_nearest_vectors", """WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS similarity FROM embeddings, q WHERE vec_id <> 0 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) DESC, vec_id LIMIT 10""")
def nearest_vectors(spark, d, query_id: int = 0, k: int = 10) -> DataFrame:
    from ..functions.text import cosine

    e = read(spark, d, "embeddings")
    q = e.filter(F.col("vec_id") == query_id).limit(1).select(F.col("embedding").alias("q"))
    near = e.filter(F.col("vec_id") != query_id).join(F.broadcast(q)).withColumn("s", cosine(F.col("embedding"), F.col("q")))
    return near.orderBy(F.desc("s"), "vec_id").limit(k).select("vec_id", F.round("s", 6).alias("similarity"))


@query("f9_cap_per_group", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def cap_per_group(spark, d, most: int = 5) -> DataFrame:
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return read(spark, d, "documents").select("doc_id", "source", n.alias("n")).filter(F.col("n") <= most).select("doc_id", "source")


@query("g4_duplicates_across_splits", "SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def duplicates_across_splits(spark, d) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("m")).filter("m > 1").select("hash", "n")


@query("v2_cost_panel", "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS framework, round(sum(o_totalprice), 2) AS cost, count(*) AS n, round(avg(o_totalprice), 4) AS mean_cost FROM orders GROUP BY 1, 2")
def cost_panel(spark, d) -> DataFrame:
    p = F.col("o_totalprice")
    return read(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("framework")).agg(F.round(F.sum(p), 2).alias("cost"), F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean_cost"))


@query("v5_agent_list", f"WITH {SPANS} SELECT trace_id, count(*) AS n, CASE WHEN max(start_time) >= (SELECT max(start_time) FROM spans) - INTERVAL 1 DAY THEN 'active' ELSE 'idle' END AS state FROM spans GROUP BY 1")
def agent_list(spark, d) -> DataFrame:
    s = spans(spark, d)
    last = s.agg(F.max("start_time").alias("end"))
    each = s.groupBy("trace_id").agg(F.count("*").alias("n"), F.max("start_time").alias("seen"))
    state = F.when(F.col("seen") >= F.col("end") - F.expr("interval 1 day"), "active").otherwise("idle")
    return each.join(F.broadcast(last)).select("trace_id", "n", state.alias("state"))
