"""Checks of agent sessions: spending, teams, screens, files, hand-offs, schedules, subagents, pressure and warnings.

Each check gives (trace_id, detected, score): the largest of its signs' scores, and whether there is any.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..plans.registry import query
from ..sources.adapters import PARENTS, SPANS, order, parents, spans
from .windows import numbered


def verdict(df: DataFrame, *signs: tuple[Column, Column], key: str = "trace_id") -> DataFrame:
    """Signs are (condition, score); scores are cut at 1 and rounded to four places."""
    found = F.greatest(F.lit(None).cast("double"), *[F.when(c, F.least(F.lit(1.0), s.cast("double"))) for c, s in signs]) if len(signs) > 1 else F.when(signs[0][0], F.least(F.lit(1.0), signs[0][1].cast("double")))
    return df.select(key, F.coalesce(found.isNotNull(), F.lit(False)).alias("detected"), F.round(F.coalesce(found, F.lit(0.0)), 4).alias("score"))


def _verdict(source: str, *signs: tuple[str, str], key: str = "trace_id") -> str:
    parts = ", ".join(f"CASE WHEN {c} THEN least(1.0, CAST({s} AS DOUBLE)) END" for c, s in signs)
    return f"SELECT {key}, greatest({parts}, NULL) IS NOT NULL AS detected, round(coalesce(greatest({parts}, NULL), 0), 4) AS score FROM {source}"


_W = "(PARTITION BY trace_id ORDER BY start_time, span_id)"


def index_percentile(values: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """(key, at, n): the value at place floor(q n) of each key's values in order, from counts of distinct values."""
    counts = values.groupBy(key, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(key).orderBy(value)
    c = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(W.partitionBy(key))})
    return c.filter(F.col("upto") > F.floor(F.col("n") * q)).groupBy(key).agg(F.min(value).alias("at"), F.first("n").alias("n"))


_L34 = f"WITH {SPANS}, b AS (SELECT trace_id, avg(value) AS mu, stddev_samp(value) AS sd, count(*) AS n, list(value ORDER BY value)[CAST(floor(count(*) * 0.95) AS INTEGER) + 1] AS p95 FROM spans GROUP BY 1), j AS (SELECT span_id, value, k, mu, sd, p95, n FROM spans JOIN b ON spans.trace_id = b.trace_id)"


@query("l34_spending", f"{_L34} {_verdict('j', ('n >= 10 AND sd > 0 AND (value - mu) / sd > 2.5', '(value - mu) / sd / 5.0'), ('n >= 10 AND value > p95 * 1.5', 'value / (p95 * 3)'), ('value > 0 AND k / value > 20', '(k / value - 20) / 30'), key='span_id')}")
def l34(spark, d) -> DataFrame:
    """Calls that cost far more than their agent's others (by deviation, and by the 95th value), or think (k) over twenty times what they say (value)."""
    s = spans(spark, d)
    stats = s.groupBy("trace_id").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    b = stats.join(index_percentile(s, "trace_id", "value", 0.95).withColumnRenamed("at", "p95"), "trace_id")
    v, z = F.col("value"), (F.col("value") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))
    thought = F.col("k") / F.nullif(v, F.lit(0.0))
    return verdict(s.join(b, "trace_id"), ((F.col("n") >= 10) & (z > 2.5), z / 5), ((F.col("n") >= 10) & (v > F.col("p95") * 1.5), v / F.nullif(F.col("p95") * 3, F.lit(0.0))), (thought > 20, (thought - 20) / 30), key="span_id")


@query("d19_index_baselines", f"WITH {SPANS} SELECT name, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, list(value ORDER BY value)[CAST(floor(count(*) * 0.75) AS INTEGER) + 1] AS p75, list(value ORDER BY value)[CAST(floor(count(*) * 0.95) AS INTEGER) + 1] AS p95 FROM spans GROUP BY 1")
def d19(spark, d) -> DataFrame:
    """Mean, deviation and the values at the places of the 75th and 95th percent."""
    s = spans(spark, d)
    stats = s.groupBy("name").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"))
    at = lambda q, n: index_percentile(s, "name", "value", q).select("name", F.col("at").alias(n))
    return stats.join(at(0.75, "p75"), "name").join(at(0.95, "p95"), "name")


_L35 = f"""WITH {SPANS}, m AS (SELECT trace_id, least(name, nx) AS a, greatest(name, nx) AS b, count(*) AS n FROM (SELECT trace_id, name, lead(name) OVER {_W} AS nx FROM spans) WHERE nx IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT trace_id, count(*) FILTER (WHERE n > 5) AS chatty FROM m GROUP BY 1),
t AS (SELECT trace_id, k, count(DISTINCT name) AS who FROM spans WHERE k IS NOT NULL GROUP BY 1, 2), u AS (SELECT trace_id, count(*) FILTER (WHERE who > 1) AS doubled FROM t GROUP BY 1), c AS (SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE status = 'ok' AND value > 50) AS done FROM spans GROUP BY 1), g AS (SELECT trace_id, max(n) AS most, sum(n) AS total FROM (SELECT trace_id, name, count(*) AS n FROM spans GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT c.trace_id, coalesce(chatty, 0) AS chatty, coalesce(doubled, 0) AS doubled, n, done, most, total FROM c LEFT JOIN p ON p.trace_id = c.trace_id LEFT JOIN u ON u.trace_id = c.trace_id JOIN g ON g.trace_id = c.trace_id)"""


@query("l35_agent_teams", f"{_L35} {_verdict('j', ('doubled > 0', 'doubled * 0.3'), ('chatty > 0 AND done < n * 0.5', 'chatty * 0.3'), ('total > 5 AND most / total > 0.6', '(most / total - 0.5) * 2'))}")
def l35(spark, d) -> DataFrame:
    """Tasks (k) that several members took, pairs that talk much while little is done, and one member who does most."""
    s = spans(spark, d)
    nx = F.lead("name").over(order())
    pairs = s.withColumn("nx", nx).filter("nx is not null").groupBy("trace_id", F.least("name", "nx").alias("a"), F.greatest("name", "nx").alias("b")).agg(F.count("*").alias("m")).groupBy("trace_id").agg(F.count_if(F.col("m") > 5).alias("chatty"))
    tasks = s.filter("k is not null").groupBy("trace_id", "k").agg(F.countDistinct("name").alias("who")).groupBy("trace_id").agg(F.count_if(F.col("who") > 1).alias("doubled"))
    work = s.groupBy("trace_id", "name").agg(F.count("*").alias("m"), F.count_if((F.col("status") == "ok") & (F.col("value") > 50)).alias("good")).groupBy("trace_id").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.sum("good").alias("done"))
    j = work.join(pairs, "trace_id", "left").join(tasks, "trace_id", "left").fillna(0, ["chatty", "doubled"])
    share = F.col("most") / F.col("n")
    return verdict(j, (F.col("doubled") > 0, F.col("doubled") * 0.3), ((F.col("chatty") > 0) & (F.col("done") < F.col("n") * 0.5), F.col("chatty") * 0.3), ((F.col("n") > 5) & (share > 0.6), (share - 0.5) * 2))


def longest(s: DataFrame, flag: Column, name: str) -> DataFrame:
    """(trace_id, name): the longest stretch of steps that all meet ``flag``; 0 if none does."""
    f = s.withColumn("f", F.coalesce(flag, F.lit(False))).withColumn("before", F.sum((~F.col("f")).cast("int")).over(order()))
    return f.groupBy("trace_id", "before").agg(F.count_if("f").alias("c")).groupBy("trace_id").agg(F.max("c").alias(name))


def _longest(flag: str, name: str) -> str:
    return f"(SELECT trace_id, max(c) AS {name} FROM (SELECT trace_id, b, count(*) FILTER (WHERE f) AS c FROM (SELECT trace_id, f, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS b FROM (SELECT *, coalesce({flag}, FALSE) AS f FROM q)) GROUP BY 1, 2) GROUP BY 1)"


_L36 = f"WITH {SPANS}, q AS (SELECT *, lag(name) OVER {_W} = name AS again FROM spans), e AS (SELECT trace_id, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) AS rate, count(*) FILTER (WHERE name NOT IN ('click', 'type', 'screenshot', 'scroll', 'key', 'drag', 'wait', 'move')) AS unknown FROM q GROUP BY 1), j AS (SELECT e.*, r.repeats, x.fails FROM e JOIN {_longest('again', 'repeats')} r ON r.trace_id = e.trace_id JOIN {_longest(chr(115) + 'tatus = ' + chr(39) + 'error' + chr(39), 'fails')} x ON x.trace_id = e.trace_id)"


@query("l36_computer_use", f"{_L36} {_verdict('j', ('rate > 0.4', '(rate - 0.4) * 3'), ('repeats >= 3', 'repeats * 0.25'), ('fails >= 5', '(fails - 4) * 0.2'), ('unknown > 0', 'unknown * 0.3'))}")
def l36(spark, d) -> DataFrame:
    """Screen actions that fail often, repeat, fail in a row, or are of no known kind."""
    s = spans(spark, d)
    known = ("click", "type", "screenshot", "scroll", "key", "drag", "wait", "move")
    again = s.withColumn("again", F.lag("name").over(order()) == F.col("name"))
    e = s.groupBy("trace_id").agg(F.avg(F.when(F.col("status") == "error", 1.0).otherwise(0.0)).alias("rate"), F.count_if(~F.col("name").isin(*known)).alias("unknown"))
    j = e.join(longest(again, F.col("again"), "repeats"), "trace_id").join(longest(s, F.col("status") == "error", "fails"), "trace_id")
    return verdict(j, (F.col("rate") > 0.4, (F.col("rate") - 0.4) * 3), (F.col("repeats") >= 3, F.col("repeats") * 0.25), (F.col("fails") >= 5, (F.col("fails") - 4) * 0.2), (F.col("unknown") > 0, F.col("unknown") * 0.3))


_DESTROYS = "name = 'purchase' OR name = 'error'"


@query("l37_cowork_safety", f"WITH {SPANS}, j AS (SELECT trace_id, count(*) FILTER (WHERE ({_DESTROYS}) AND k >= 95) AS synced, count(*) FILTER (WHERE ({_DESTROYS}) AND value >= 50) AS unconfirmed, count(*) FILTER (WHERE k < 5) AS irreversible FROM spans GROUP BY 1) {_verdict('j', ('synced > 0', '0.95'), ('unconfirmed > 2', 'unconfirmed * 0.2'), ('irreversible > 3', 'irreversible * 0.15'))}")
def l37(spark, d) -> DataFrame:
    """Destructive actions on synchronised places, several of them unconfirmed, and several that cannot be undone."""
    destroys = F.col("name").isin("purchase", "error")
    j = spans(spark, d).groupBy("trace_id").agg(F.count_if(destroys & (F.col("k") >= 95)).alias("synced"), F.count_if(destroys & (F.col("value") >= 50)).alias("unconfirmed"), F.count_if(F.col("k") < 5).alias("irreversible"))
    return verdict(j, (F.col("synced") > 0, F.lit(0.95)), (F.col("unconfirmed") > 2, F.col("unconfirmed") * 0.2), (F.col("irreversible") > 3, F.col("irreversible") * 0.15))


_L38 = f"WITH {SPANS}, q AS (SELECT *, lead(name) OVER {_W} AS nx FROM spans), j AS (SELECT trace_id, CAST(sum(floor(value)) * 1000 AS DOUBLE) AS ms, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'error' AND nx = name) AS retries, epoch_us(max(start_time) - min(start_time)) / 1e6 AS gap FROM q GROUP BY 1)"


@query("l38_async_dispatch", f"{_L38} {_verdict('j', ('ms > 300000', 'ms / 600000'), ('errors > 0 AND retries = 0', '0.7'), ('gap > 600', 'gap / 1200'))}")
def l38(spark, d) -> DataFrame:
    """Work that takes over five minutes, errors that nothing retries, and results ten minutes after the instruction."""
    q = spans(spark, d).withColumn("nx", F.lead("name").over(order()))
    bad, at = F.col("status") == "error", F.unix_micros(F.col("start_time").cast("timestamp"))
    j = q.groupBy("trace_id").agg((F.sum(F.floor("value")) * 1000).cast("double").alias("ms"), F.count_if(bad).alias("errors"), F.count_if(bad & (F.col("nx") == F.col("name"))).alias("retries"), ((F.max(at) - F.min(at)) / 1e6).alias("gap"))
    return verdict(j, (F.col("ms") > 300000, F.col("ms") / 600000), ((F.col("errors") > 0) & (F.col("retries") == 0), F.lit(0.7)), (F.col("gap") > 600, F.col("gap") / 1200))


_L39 = f"""WITH {SPANS}, q AS (SELECT *, row_number() OVER {_W} - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS n, lag(k) OVER {_W} = k AS same, epoch_us(start_time - lag(start_time) OVER {_W}) / 1000 AS gap, status = 'error' AS bad FROM spans),
h AS (SELECT trace_id, max(n) AS n, avg(value) FILTER (WHERE i < n // 2) AS first, avg(value) FILTER (WHERE i >= n // 2) AS second, count(*) FILTER (WHERE gap > 3 * 28800000) AS skips, count(*) FILTER (WHERE bad AND i < n // 2) AS e1, count(*) FILTER (WHERE bad AND i >= n // 2) AS e2, bool_and(bad) AS all_bad FROM q GROUP BY 1), j AS (SELECT h.*, streak FROM h JOIN {_longest('same', 'streak')} x ON x.trace_id = h.trace_id WHERE n >= 3)"""


@query("l39_scheduled_task", f"{_L39} {_verdict('j', ('n >= 4 AND first > 0 AND second > first * 1.5', '(second / first - 1.5) * 2'), ('streak >= 3', 'streak * 0.25'), ('skips > 0', 'skips * 0.35'), ('n >= 4 AND e2 > e1 + 1 AND e2 >= 2', 'e2 * 0.25'), ('all_bad', '0.9'))}")
def l39(spark, d, interval_ms: int = 28_800_000) -> DataFrame:
    """Runs that slow down, say the same (k) again and again, are left out, fail more in the second half, or all fail."""
    at = F.unix_micros(F.col("start_time").cast("timestamp"))
    q = numbered(spans(spark, d)).withColumns({"same": F.lag("k").over(order()) == F.col("k"), "gap": (at - F.lag(at).over(order())) / 1000, "late": F.col("seq") >= F.floor(F.col("n") / 2)})
    bad = F.col("status") == "error"
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    h = q.groupBy("trace_id").agg(F.max("n").alias("n"), mean(~F.col("late")).alias("first"), mean(F.col("late")).alias("second"), F.count_if(F.col("gap") > 3 * interval_ms).alias("skips"), F.count_if(bad & ~F.col("late")).alias("e1"), F.count_if(bad & F.col("late")).alias("e2"), F.bool_and(bad).alias("all_bad"))
    j = h.join(longest(q, F.col("same"), "streak"), "trace_id").filter("n >= 3")
    many = F.col("n") >= 4
    return verdict(
        j, (many & (F.col("first") > 0) & (F.col("second") > F.col("first") * 1.5), (F.col("second") / F.nullif(F.col("first"), F.lit(0.0)) - 1.5) * 2), (F.col("streak") >= 3, F.col("streak") * 0.25),
        (F.col("skips") > 0, F.col("skips") * 0.35), (many & (F.col("e2") > F.col("e1") + 1) & (F.col("e2") >= 2), F.col("e2") * 0.25), (F.col("all_bad"), F.lit(0.9)),
    )


_L40 = f"WITH {PARENTS}, j AS (SELECT trace_id, parent_id, count(*) AS n, count(*) FILTER (WHERE name NOT IN ('click', 'view', 'signup')) AS outside, count(DISTINCT k) AS tools, count(*) FILTER (WHERE name = 'signup') AS spawns FROM parents WHERE parent_id IS NOT NULL GROUP BY 1, 2)"


@query("l40_subagent_boundary", f"{_L40} {_verdict('j', ('outside > 0', 'outside / n + 0.3'), ('spawns > 0', '0.5 + spawns * 0.2'), ('tools > 8', '(tools - 8) * 0.2'), ('(tools - 3.3) / 1.5 > 3', '(tools - 3.3) / 1.5 / 5'), key='parent_id')}")
def l40(spark, d, allowed: tuple[str, ...] = ("click", "view", "signup"), mean: float = 3.3, sd: float = 1.5, p95: int = 6) -> DataFrame:
    """Subagents (the spans under one parent) that use tools they may not, spawn others, or use unusually many tools (distinct k)."""
    j = parents(spark, d).filter("parent_id is not null").groupBy("trace_id", "parent_id").agg(F.count("*").alias("n"), F.count_if(~F.col("name").isin(*allowed)).alias("outside"), F.countDistinct("k").alias("tools"), F.count_if(F.col("name") == "signup").alias("spawns"))
    z = (F.col("tools") - mean) / sd
    return verdict(j, (F.col("outside") > 0, F.col("outside") / F.col("n") + 0.3), (F.col("spawns") > 0, 0.5 + F.col("spawns") * 0.2), (F.col("tools") > p95 + 2, (F.col("tools") - (p95 + 2)) * 0.2), (z > 3, z / 5), key="parent_id")


_L20 = f"""WITH {SPANS}, q AS (SELECT *, row_number() OVER {_W} - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS n, avg(value) OVER (PARTITION BY trace_id) AS mu, stddev_samp(value) OVER (PARTITION BY trace_id) AS sd FROM spans),
j AS (SELECT trace_id, sum(k) / 4000.0 AS used, avg(value) FILTER (WHERE i >= n - greatest(n // 3, 1)) / nullif(avg(value) FILTER (WHERE i < greatest(n // 3, 1)), 0) AS kept, count(*) FILTER (WHERE i >= n * 0.6 AND name = 'signup') AS wraps, count(*) FILTER (WHERE i >= n - 3 AND value < mu - 2 * sd) AS cliffs FROM q GROUP BY 1), s AS (SELECT trace_id, CAST(coalesce(used > 0.85, FALSE) AS INTEGER) + CAST(coalesce(kept < 0.5, FALSE) AS INTEGER) + CAST(wraps > 0 AS INTEGER) + CAST(cliffs > 0 AS INTEGER) AS signals,
 0.3 * CAST(coalesce(used > 0.85, FALSE) AS INTEGER) + 0.3 * CAST(coalesce(kept < 0.5, FALSE) AS INTEGER) + 0.2 * CAST(wraps > 0 AS INTEGER) + 0.2 * CAST(cliffs > 0 AS INTEGER) AS score FROM j)"""


@query("l20_context_pressure", f"{_L20} SELECT trace_id, signals >= 2 AND score >= 0.3 AS detected, round(CAST(score AS DOUBLE), 4) AS score FROM s")
def l20(spark, d, window: int = 4000) -> DataFrame:
    """A full context (tokens are k), outputs that halve, talk of wrapping up (a signup) in the last two fifths, and a cliff at the end: two signs make a finding."""
    whole = W.partitionBy("trace_id")
    q = numbered(spans(spark, d)).withColumns({"mu": F.avg("value").over(whole), "sd": F.stddev_samp("value").over(whole), "third": F.greatest(F.floor(F.col("n") / 3), F.lit(1))})
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    kept = mean(F.col("seq") >= F.col("n") - F.col("third")) / F.nullif(mean(F.col("seq") < F.col("third")), F.lit(0.0))
    j = q.groupBy("trace_id").agg((F.sum("k") / float(window) > 0.85).alias("full"), (kept < 0.5).alias("halved"), (F.count_if((F.col("seq") >= F.col("n") * 0.6) & (F.col("name") == "signup")) > 0).alias("wraps"), (F.count_if((F.col("seq") >= F.col("n") - 3) & (F.col("value") < F.col("mu") - 2 * F.col("sd"))) > 0).alias("cliff"))
    one = {c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("full", "halved", "wraps", "cliff")}
    score = 0.3 * one["full"] + 0.3 * one["halved"] + 0.2 * one["wraps"] + 0.2 * one["cliff"]
    return j.select("trace_id", ((sum(one.values(), F.lit(0)) >= 2) & (score >= 0.3)).alias("detected"), F.round(score, 4).alias("score"))


_L41 = f"""WITH {SPANS}, q AS (SELECT *, row_number() OVER {_W} - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS n, lag(name) OVER {_W} = name AS again FROM spans), m AS (SELECT trace_id, max(n) AS n, regr_slope(CAST(k AS DOUBLE), CAST(i AS DOUBLE)) AS slope, max(k) AS top, avg(value) FILTER (WHERE i < greatest(n // 3, 1)) AS first, avg(value) FILTER (WHERE i >= n - greatest(n // 3, 1)) AS last,
 avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) AS overall, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) FILTER (WHERE i >= greatest(1, CAST(floor(n * 7 / 10) AS BIGINT))) AS tail FROM q GROUP BY 1), j AS (SELECT m.*, x.streak FROM m JOIN {_longest('again', 'streak')} x ON x.trace_id = m.trace_id)"""


@query("l41_warnings", f"{_L41} SELECT trace_id, coalesce(slope > 0.1, FALSE) AS tokens_rise, coalesce(last < first * 0.7, FALSE) AS quality_falls, coalesce(tail > 0.3 AND tail > overall * 1.5, FALSE) AS errors_spiral, streak >= 3 AS repeats FROM j")
def l41(spark, d) -> DataFrame:
    """What a trace's course foretells: tokens that rise, quality that falls from its first to its last third, errors that gather in the last three tenths, repetition."""
    again = F.lag("name").over(order()) == F.col("name")
    q = numbered(spans(spark, d)).withColumns({"again": again, "third": F.greatest(F.floor(F.col("n") / 3), F.lit(1))})
    bad, mean = F.when(F.col("status") == "error", 1.0).otherwise(0.0), (lambda c, v: F.avg(F.when(c, v)))
    late = F.col("seq") >= F.greatest(F.lit(1), F.floor(F.col("n") * 7 / 10))
    m = q.groupBy("trace_id").agg(F.regr_slope(F.col("k").cast("double"), F.col("seq").cast("double")).alias("slope"), mean(F.col("seq") < F.col("third"), F.col("value")).alias("first"), mean(F.col("seq") >= F.col("n") - F.col("third"), F.col("value")).alias("last"), F.avg(bad).alias("overall"), mean(late, bad).alias("tail"))
    j = m.join(longest(q, F.col("again"), "streak"), "trace_id")
    yes = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    return j.select("trace_id", yes(F.col("slope") > 0.1, "tokens_rise"), yes(F.col("last") < F.col("first") * 0.7, "quality_falls"), yes((F.col("tail") > 0.3) & (F.col("tail") > F.col("overall") * 1.5), "errors_spiral"), (F.col("streak") >= 3).alias("repeats"))


@query("l49_error_patterns", f"WITH {SPANS} SELECT trace_id, count(*) FILTER (WHERE status = 'error') AS errors, round(avg(CASE WHEN kind = 'tool' AND status = 'error' THEN 1.0 WHEN kind = 'tool' THEN 0.0 END), 6) AS tool_failures, round(avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM spans GROUP BY 1")
def l49(spark, d) -> DataFrame:
    bad = F.col("status") == "error"
    return spans(spark, d).groupBy("trace_id").agg(F.count_if(bad).alias("errors"), F.round(F.avg(F.when(F.col("kind") == "tool", F.when(bad, 1.0).otherwise(0.0))), 6).alias("tool_failures"), F.round(F.avg(F.when(bad, 1.0).otherwise(0.0)), 6).alias("rate"))


@query("m20_tool_abuse", f"WITH {SPANS}, t AS (SELECT trace_id, name, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS bad FROM spans WHERE kind = 'tool' GROUP BY 1, 2), j AS (SELECT trace_id, sum(n) AS calls, max(n) AS most, sum(bad) AS failed FROM t GROUP BY 1), i AS (SELECT trace_id, CAST(calls > 4 AS INTEGER) + CAST(most >= 3 AS INTEGER) + CAST(calls >= 3 AND failed / calls > 0.5 AS INTEGER) AS issues FROM j) SELECT trace_id, issues > 0 AS detected, CAST(CASE WHEN issues > 0 THEN least(1.0, round(0.4 + 0.25 * issues, 4)) ELSE 0 END AS DOUBLE) AS confidence FROM i")
def m20(spark, d) -> DataFrame:
    """Many calls, the same tool again and again, and calls that mostly fail: each an issue."""
    t = spans(spark, d).filter("kind = 'tool'").groupBy("trace_id", "name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("bad"))
    j = t.groupBy("trace_id").agg(F.sum("n").alias("calls"), F.max("n").alias("most"), F.sum("bad").alias("failed"))
    issues = (F.col("calls") > 4).cast("int") + (F.col("most") >= 3).cast("int") + ((F.col("calls") >= 3) & (ratio(F.col("failed"), F.col("calls")) > 0.5)).cast("int")
    return j.select("trace_id", (issues > 0).alias("detected"), F.when(issues > 0, F.least(F.lit(1.0), F.round(0.4 + 0.25 * issues, 4))).otherwise(0.0).alias("confidence"))


@query("m6_timeouts", f"WITH {PARENTS}, q AS (SELECT *, epoch_us(start_time - lag(end_time) OVER {_W}) / 1e6 AS stall FROM parents), j AS (SELECT trace_id, epoch_us(max(end_time) - min(start_time)) / 1e6 AS total, count(*) FILTER (WHERE epoch_us(end_time - start_time) / 1e6 > 60 * 60) AS slow, count(*) FILTER (WHERE stall > 60) AS stalls FROM q GROUP BY 1) SELECT trace_id, total > 300 AS over_limit, slow AS slow_nodes, stalls FROM j")
def m6(spark, d, limit_s: int = 300, node_s: int = 3600, stall_s: int = 60) -> DataFrame:
    """A run over its limit, nodes over theirs, and gaps between one node's end and the next one's start."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    q = parents(spark, d).withColumns({"b": us("start_time") / 1e6, "e": us("end_time") / 1e6})
    q = q.withColumn("stall", F.col("b") - F.lag("e").over(order()))
    return q.groupBy("trace_id").agg((F.max("e") - F.min("b") > limit_s).alias("over_limit"), F.count_if(F.col("e") - F.col("b") > node_s).alias("slow_nodes"), F.count_if(F.col("stall") > stall_s).alias("stalls"))


@query("m7_recursion", f"WITH {SPANS}, q AS (SELECT *, row_number() OVER {_W} - 1 AS step FROM spans), c AS (SELECT trace_id, name, count(DISTINCT step) AS n FROM q GROUP BY 1, 2), j AS (SELECT trace_id, max(n) AS most, sum(n) AS steps FROM c GROUP BY 1) SELECT trace_id, CAST(CASE WHEN steps >= 50 THEN 0.95 WHEN steps / 50.0 > 0.9 THEN 0.7 WHEN most >= 3 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence FROM j")
def m7(spark, d, limit: int = 50) -> DataFrame:
    """A recursion limit reached, nearly reached, or a node that runs in three supersteps or more."""
    c = numbered(spans(spark, d)).groupBy("trace_id", "name").agg(F.countDistinct("seq").alias("m")).groupBy("trace_id").agg(F.max("m").alias("most"), F.sum("m").alias("steps"))
    return c.select("trace_id", F.when(F.col("steps") >= limit, 0.95).when(F.col("steps") / limit > 0.9, 0.7).when(F.col("most") >= 3, 0.5).otherwise(0.0).alias("confidence"))


@query("m10_tool_failures", f"WITH {SPANS}, q AS (SELECT *, lead(name) OVER {_W} = name AS again, lead(status) OVER {_W} AS then_status, row_number() OVER (PARTITION BY trace_id ORDER BY start_time DESC, span_id DESC) = 1 AS last FROM spans) SELECT span_id, CAST(CASE WHEN last THEN 0.95 WHEN again AND then_status = 'error' THEN 0.8 ELSE 0.6 END AS DOUBLE) AS confidence FROM q WHERE status = 'error'")
def m10(spark, d) -> DataFrame:
    """Failed steps: that end the run, whose retry fails too, and the others."""
    nx = F.lead("name").over(order())
    q = spans(spark, d).withColumns({"nx": nx, "then": F.lead("status").over(order())}).filter("status = 'error'")
    return q.select("span_id", F.when(F.col("nx").isNull(), 0.95).when((F.col("nx") == F.col("name")) & (F.col("then") == "error"), 0.8).otherwise(0.6).alias("confidence"))


@query("m12_checkpoints", f"WITH {SPANS}, q AS (SELECT *, k - lag(k) OVER {_W} AS d FROM spans WHERE k IS NOT NULL) SELECT trace_id, count(*) FILTER (WHERE d < 0) AS backward, count(*) FILTER (WHERE d > 1) AS gaps, CAST(CASE WHEN count(*) FILTER (WHERE d < 0) > 0 THEN 0.85 WHEN count(*) FILTER (WHERE d > 1) > 0 THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence FROM q GROUP BY 1")
def m12(spark, d) -> DataFrame:
    """Checkpoint numbers (k) that go back, or leave some out."""
    q = spans(spark, d).filter("k is not null").withColumn("d", F.col("k") - F.lag("k").over(order()))
    back, gaps = F.count_if(F.col("d") < 0), F.count_if(F.col("d") > 1)
    return q.groupBy("trace_id").agg(back.alias("backward"), gaps.alias("gaps"), F.when(back > 0, 0.85).when(gaps > 0, 0.8).otherwise(0.0).alias("confidence"))


@query("m15_model_fallback", f"WITH {SPANS}, q AS (SELECT *, k % 3 AS model, lag(k % 3) OVER {_W} AS pm, lag(status) OVER {_W} AS ps FROM spans WHERE k IS NOT NULL) SELECT span_id, CASE WHEN ps = 'error' THEN 'after_failure' ELSE 'changed' END AS reason FROM q WHERE pm <> model")
def m15(spark, d) -> DataFrame:
    """Calls whose model (k modulo 3) is another than before, told apart by a failure before them."""
    s = spans(spark, d).filter("k is not null").withColumn("model", F.col("k") % 3)
    s = s.withColumns({"pm": F.lag("model").over(order()), "ps": F.lag("status").over(order())})
    return s.filter("pm <> model").select("span_id", F.when(F.col("ps") == "error", "after_failure").otherwise("changed").alias("reason"))


@query("m17_classifier_drift", f"WITH {SPANS}, c AS (SELECT k AS input, count(DISTINCT name) AS labels, count(*) FILTER (WHERE value < 50) AS unsure, count(*) AS n FROM spans WHERE k IS NOT NULL GROUP BY 1), i AS (SELECT *, CAST(labels > 1 AS INTEGER) + CAST(unsure > 0 AS INTEGER) AS issues FROM c) SELECT input, labels > 1 AS disagrees, unsure, round(CAST(CASE WHEN issues = 0 THEN 0 ELSE least(0.95, 0.5 + 0.15 * issues) END AS DOUBLE), 4) AS confidence FROM i")
def m17(spark, d) -> DataFrame:
    """Inputs that the classifier labels in several ways, or with a confidence under one half."""
    c = spans(spark, d).filter("k is not null").groupBy(F.col("k").alias("input")).agg(F.countDistinct("name").alias("labels"), F.count_if(F.col("value") < 50).alias("unsure"))
    issues = (F.col("labels") > 1).cast("int") + (F.col("unsure") > 0).cast("int")
    return c.select("input", (F.col("labels") > 1).alias("disagrees"), "unsure", F.round(F.when(issues == 0, 0.0).otherwise(F.least(F.lit(0.95), 0.5 + 0.15 * issues)), 4).alias("confidence"))


@query("m19_session_loop", f"WITH {SPANS}, h AS (SELECT trace_id, name, k, count(*) AS n FROM spans GROUP BY 1, 2, 3), s AS (SELECT trace_id, name, count(*) AS n FROM spans GROUP BY 1, 2), q AS (SELECT *, coalesce(lag(name, 2) OVER {_W} = name AND lag(name) OVER {_W} <> name, FALSE) AS two FROM spans), a AS {_longest('two', 'abab')} SELECT a.trace_id, (SELECT count(*) FROM h WHERE h.trace_id = a.trace_id AND n >= 3) AS same_input, (SELECT count(*) FROM s WHERE s.trace_id = a.trace_id AND n >= 5) AS same_shape, abab + 2 >= 4 AS alternates FROM a")
def m19(spark, d) -> DataFrame:
    """Calls with the same tool and input three times, of the same tool five times, and A B A B stretches of four."""
    s = spans(spark, d)
    two = (F.lag("name", 2).over(order()) == F.col("name")) & (F.lag("name").over(order()) != F.col("name"))
    per = s.groupBy("trace_id", "name", "k").agg(F.count("*").alias("m")).groupBy("trace_id", "name").agg(F.count_if(F.col("m") >= 3).alias("inputs"), F.sum("m").alias("m"))
    per = per.groupBy("trace_id").agg(F.sum("inputs").alias("same_input"), F.count_if(F.col("m") >= 5).alias("same_shape"))
    return per.join(longest(s.withColumn("two", two), F.col("two"), "abab"), "trace_id").select("trace_id", "same_input", "same_shape", (F.col("abab") + 2 >= 4).alias("alternates"))


@query("m22_spawn_chain", f"WITH {PARENTS}, c AS (SELECT trace_id, parent_id, count(*) AS n FROM parents WHERE parent_id IS NOT NULL AND k < 20 GROUP BY 1, 2), w AS (SELECT trace_id, parent_id, count(*) AS n FROM parents WHERE parent_id IS NOT NULL GROUP BY 1, 2) SELECT w.trace_id, w.parent_id, w.n AS children, w.n > 3 AS too_many FROM w")
def m22(spark, d, most: int = 3) -> DataFrame:
    """Sessions that spawn more than three others."""
    n = parents(spark, d).filter("parent_id is not null").groupBy("trace_id", "parent_id").agg(F.count("*").alias("children"))
    return n.withColumn("too_many", F.col("children") > most)
