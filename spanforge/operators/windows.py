"""Sequence logic of a trace as window functions."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard, ratio, words
from ..plans.registry import query
from ..sources.adapters import SPANS, order, spans, turns

SEQ = f"WITH {SPANS}, s AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) - 1 AS seq, count(*) OVER (PARTITION BY trace_id) AS n FROM spans)"


def numbered(s: DataFrame) -> DataFrame:
    return s.withColumn("seq", (F.row_number().over(order()) - 1).cast("long")).withColumn("n", F.count("*").over(W.partitionBy("trace_id")))


def runs(s: DataFrame) -> DataFrame:
    """(trace_id, name, run, length, first_seq): stretches of equal names."""
    changed = F.coalesce((F.lag("name").over(order()) != F.col("name")).cast("int"), F.lit(1))
    marked = numbered(s).withColumn("changed", changed).withColumn("run", F.sum("changed").over(order()))
    return marked.groupBy("trace_id", "run", "name").agg(F.count("*").alias("length"), F.min("seq").alias("first_seq"))


@query("e1_previous_row", f"{SEQ} SELECT span_id, round(value - lag(value) OVER (PARTITION BY trace_id ORDER BY start_time, span_id), 6) AS change FROM s")
def previous_row(spark, d) -> DataFrame:
    return spans(spark, d).select("span_id", F.round(F.col("value") - F.lag("value").over(order()), 6).alias("change"))


@query("e2_longest_run", f"""{SEQ}, m AS (SELECT *, CASE WHEN lag(name) OVER w = name THEN 0 ELSE 1 END AS changed FROM s WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, span_id)), r AS (SELECT *, sum(changed) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS run FROM m),
l AS (SELECT trace_id, run, name, count(*) AS length FROM r GROUP BY 1, 2, 3) SELECT trace_id, name, length FROM l QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY length DESC, run) = 1""")
def longest_run(spark, d) -> DataFrame:
    best = runs(spans(spark, d)).groupBy("trace_id").agg(F.min(F.struct((-F.col("length")).alias("m"), "run", "name", "length")).alias("x"))
    return best.select("trace_id", "x.name", "x.length")


@query("e4_trailing_window", f"{SEQ} SELECT trace_id, name, count(*) AS n FROM s WHERE seq >= n - 7 GROUP BY 1, 2")
def trailing_window(spark, d, last: int = 7) -> DataFrame:
    return numbered(spans(spark, d)).filter(F.col("seq") >= F.col("n") - last).groupBy("trace_id", "name").agg(F.count("*").alias("n"))


@query("e5_running_total", f"{SEQ} SELECT span_id, CAST(sum(k) OVER (PARTITION BY trace_id ORDER BY start_time, span_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM s")
def running_total(spark, d) -> DataFrame:
    return spans(spark, d).select("span_id", F.sum("k").over(order().rowsBetween(W.unboundedPreceding, 0)).alias("total"))


@query("e6_context_so_far", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars, string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS roles FROM conversations")
def context_so_far(spark, d) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return turns(spark, d).select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("chars"), F.array_join(F.collect_list("role").over(w), ",").alias("roles"))


@query("e7_sign_changes", f"""{SEQ}, a AS (SELECT *, value - lag(value) OVER w AS d1 FROM s WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, span_id)), b AS (SELECT *, lag(d1) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS d0 FROM a)
SELECT trace_id, count(*) FILTER (WHERE d0 * d1 < 0) AS reversals FROM b GROUP BY 1""")
def sign_changes(spark, d) -> DataFrame:
    s = spans(spark, d).withColumn("d1", F.col("value") - F.lag("value").over(order()))
    return s.withColumn("d0", F.lag("d1").over(order())).groupBy("trace_id").agg(F.count_if(F.col("d0") * F.col("d1") < 0).alias("reversals"))


@query("e8_best_so_far", f"{SEQ} SELECT trace_id, seq AS best_seq, value AS best, n - 1 - seq AS since FROM s QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY value, seq) = 1")
def best_so_far(spark, d) -> DataFrame:
    best = numbered(spans(spark, d)).groupBy("trace_id").agg(F.min(F.struct("value", "seq", "n")).alias("x"))
    return best.select("trace_id", F.col("x.seq").alias("best_seq"), F.col("x.value").alias("best"), (F.col("x.n") - 1 - F.col("x.seq")).alias("since"))


@query("e10_growth_rate", f"{SEQ}, g AS (SELECT trace_id, n, (value - lag(value) OVER w) / lag(value) OVER w AS rate FROM s WHERE value > 0 WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, span_id)) SELECT trace_id, round(avg(rate), 4) AS mean_rate, bool_or(rate < -0.1) AS falls FROM g WHERE n >= 5 GROUP BY 1")
def growth_rate(spark, d) -> DataFrame:
    s = numbered(spans(spark, d)).filter("value > 0 and n >= 5")
    before = F.lag("value").over(order())
    return s.withColumn("rate", (F.col("value") - before) / before).groupBy("trace_id").agg(F.round(F.avg("rate"), 4).alias("mean_rate"), F.bool_or(F.col("rate") < -0.1).alias("falls"))


@query("e11_thirds", f"{SEQ} SELECT trace_id, round(avg(value) FILTER (WHERE seq < greatest(n // 3, 1)), 6) AS first_third, round(avg(value) FILTER (WHERE seq >= n - greatest(n // 3, 1)), 6) AS last_third FROM s GROUP BY 1")
def thirds(spark, d) -> DataFrame:
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    return numbered(spans(spark, d)).groupBy("trace_id").agg(F.round(F.avg(F.when(F.col("seq") < third, F.col("value"))), 6).alias("first_third"), F.round(F.avg(F.when(F.col("seq") >= F.col("n") - third, F.col("value"))), 6).alias("last_third"))


@query("e12_tail_rate", f"{SEQ} SELECT trace_id, round(avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END), 6) AS overall, round(avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) FILTER (WHERE seq >= greatest(1, CAST(floor(n * 7 / 10) AS BIGINT))), 6) AS tail FROM s GROUP BY 1")
def tail_rate(spark, d) -> DataFrame:
    bad = F.when(F.col("status") == "error", 1.0).otherwise(0.0)
    tail = F.col("seq") >= F.greatest(F.lit(1), F.floor(F.col("n") * 7 / 10))
    return numbered(spans(spark, d)).groupBy("trace_id").agg(F.round(F.avg(bad), 6).alias("overall"), F.round(F.avg(F.when(tail, bad)), 6).alias("tail"))


@query("e13_slope", f"{SEQ} SELECT trace_id, round(regr_slope(CAST(k AS DOUBLE), CAST(seq AS DOUBLE)), 6) AS slope FROM s GROUP BY 1")
def slope(spark, d) -> DataFrame:
    return numbered(spans(spark, d)).groupBy("trace_id").agg(F.round(F.regr_slope(F.col("k").cast("double"), F.col("seq").cast("double")), 6).alias("slope"))


@query("e14_rapid_batches", f"""WITH {SPANS}, p AS (SELECT *, CASE WHEN start_time - lag(start_time) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS gap FROM spans WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, span_id)), g AS (SELECT *, sum(gap) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS batch FROM p)
SELECT trace_id, min(span_id) AS first_span, count(*) AS n FROM g GROUP BY trace_id, batch HAVING count(*) >= 2""")
def rapid_batches(spark, d, seconds: int = 600) -> DataFrame:
    at = F.unix_micros(F.col("start_time").cast("timestamp"))
    s = spans(spark, d).withColumn("gap", F.when(at - F.lag(at).over(order()) <= seconds * 1_000_000, 0).otherwise(1)).withColumn("batch", F.sum("gap").over(order()))
    return s.groupBy("trace_id", "batch").agg(F.min("span_id").alias("first_span"), F.count("*").alias("n")).filter("n >= 2").drop("batch")


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"


@query("e15_near_duplicate_turns", f"""WITH w AS (SELECT conv_id, turn, {WORDS} AS ws FROM conversations), p AS (SELECT *, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS ps FROM w)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(ws, ps))) = 0 THEN 0 ELSE CAST(len(list_intersect(ws, ps)) AS DOUBLE) / len(list_distinct(list_concat(ws, ps))) END, 6) AS similarity FROM p WHERE ps IS NOT NULL""")
def near_duplicate_turns(spark, d) -> DataFrame:
    t = turns(spark, d).withColumn("ws", words(F.col("text")))
    t = t.withColumn("ps", F.lag("ws").over(W.partitionBy("conv_id").orderBy("turn"))).filter("ps is not null")
    return t.select("conv_id", "turn", F.round(jaccard(F.col("ws"), F.col("ps")), 6).alias("similarity"))


@query("e16_last_producer", f"{SEQ} SELECT span_id, last_value(CASE WHEN kind = 'llm' THEN span_id END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY start_time, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS producer FROM s")
def last_producer(spark, d) -> DataFrame:
    before = order().rowsBetween(W.unboundedPreceding, -1)
    return spans(spark, d).select("span_id", F.last(F.when(F.col("kind") == "llm", F.col("span_id")), ignorenulls=True).over(before).alias("producer"))


@query("e18_alternations", f"{SEQ}, a AS (SELECT *, coalesce(lag(name, 2) OVER w = name AND lag(name) OVER w <> name, FALSE) AS alternates FROM s WINDOW w AS (PARTITION BY trace_id ORDER BY start_time, span_id)) SELECT trace_id, count(*) FILTER (WHERE alternates) AS n FROM a GROUP BY 1")
def alternations(spark, d) -> DataFrame:
    two = (F.lag("name", 2).over(order()) == F.col("name")) & (F.lag("name").over(order()) != F.col("name"))
    return spans(spark, d).withColumn("two", F.coalesce(two, F.lit(False))).groupBy("trace_id").agg(F.count_if("two").alias("n"))


@query("e20_sigma_cliff", f"{SEQ}, m AS (SELECT trace_id, avg(value) AS mu, stddev_samp(value) AS sd FROM s GROUP BY 1) SELECT s.trace_id, count(*) AS n FROM s JOIN m ON s.trace_id = m.trace_id WHERE seq >= n - 10 AND value > mu + 2 * sd GROUP BY 1")
def sigma_cliff(spark, d) -> DataFrame:
    whole = W.partitionBy("trace_id")
    s = numbered(spans(spark, d)).withColumns({"mu": F.avg("value").over(whole), "sd": F.stddev_samp("value").over(whole)})
    return s.filter((F.col("seq") >= F.col("n") - 10) & (F.col("value") > F.col("mu") + 2 * F.col("sd"))).groupBy("trace_id").agg(F.count("*").alias("n"))


@query("e22_recent_against_baseline", f"{SEQ} SELECT span_id, round(avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY trace_id ORDER BY start_time, span_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS recent, round(avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY trace_id ORDER BY start_time, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING), 6) AS base FROM s")
def recent_against_baseline(spark, d) -> DataFrame:
    bad = F.when(F.col("status") == "error", 1.0).otherwise(0.0)
    return spans(spark, d).select("span_id", F.round(F.avg(bad).over(order().rowsBetween(-5, -1)), 6).alias("recent"), F.round(F.avg(bad).over(order().rowsBetween(W.unboundedPreceding, -6)), 6).alias("base"))


@query("h8_token_estimate", "SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM conversations")
def token_estimates(spark, d) -> DataFrame:
    from ..functions.text import token_estimate

    return turns(spark, d).select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"))


@query("h31_entropy", f"WITH {SPANS}, c AS (SELECT trace_id, name, count(*) AS n FROM spans GROUP BY 1, 2), p AS (SELECT trace_id, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY trace_id) AS p FROM c) SELECT trace_id, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY 1")
def entropy(spark, d) -> DataFrame:
    c = spans(spark, d).groupBy("trace_id", "name").agg(F.count("*").alias("n"))
    p = c.withColumn("p", ratio(F.col("n"), F.sum("n").over(W.partitionBy("trace_id"))))
    return p.groupBy("trace_id").agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("entropy"))
