"""Parallel branches (trace_id, span_id, parent_id, name, start_time, end_time, output): overlapping siblings by a sweep, and facts on which they contradict each other.

Siblings are swept once in order of their start: one overlaps another if the next starts before its end, or a former
ends after its start. Contradictions are counted from the numbers of equal facts, so that no pair of spans or facts
is made however many a parent has.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import BRANCHES, branches

#: What states a number and what states a truth of something.
NUMBERS = r"(?i)([\w\s]{2,30})\s*(?:is|was|are|were|=|:)\s*(\$?[\d,]+\.?\d*%?)"
TRUTHS = (
    r"(?i)([\w\s]{2,30})\s*(?:is|was|are|were)\s+((?:not\s+)?(?:true|false|yes|no|correct|incorrect|valid|invalid|available|unavailable|enabled|disabled|active|inactive|approved|rejected|confirmed|denied"
    r"|successful|failed|compliant|non-compliant))"
)
#: Words of a reconciliation, spans after the group that may hold one, points of a contradiction, least and most points.
RECONCILED = (
    "however", "conflicting", "on the other hand", "contradiction", "disagree", "inconsistent", "reconcil", "mismatch", "discrepan", "differ", "conflict", "whereas", "but the other", "in contrast",
)
AFTER, NUMBER_POINTS, TRUTH_POINTS, LEAST, MOST = 10, 25, 30, 30, 75


def overlapping(s: DataFrame) -> DataFrame:
    """Spans that overlap a sibling in time; a span without an end ends as it starts. Spans without a parent have no siblings."""
    end = F.coalesce("end_time", "start_time")
    w = W.partitionBy("trace_id", "parent_id").orderBy("start_time", "span_id")
    s = s.filter("parent_id is not null").withColumn("until", end)
    before = F.max("until").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumns({"first": F.coalesce(F.lead("start_time").over(w) < F.col("until"), F.lit(False)), "later": F.coalesce(before > F.col("start_time"), F.lit(False))})
    return s.filter("first or later").drop("first", "later")


def facts(s: DataFrame) -> DataFrame:
    """(trace_id, parent_id, span_id, kind, entity, fact) of each statement in the output of a span."""
    def found(kind: str, pattern: str):
        names, said = (F.regexp_extract_all("output", F.lit(pattern), F.lit(g)) for g in (1, 2))
        return F.transform(F.arrays_zip(names.alias("a"), said.alias("b")), lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(F.regexp_replace(x["a"], r"^\s+|\s+$", "")).alias("entity"), (F.trim(x["b"]) if kind == "number" else F.lower(F.trim(x["b"]))).alias("fact")))

    both = F.concat(found("number", NUMBERS), found("truth", TRUTHS))
    return s.filter("output is not null").select("trace_id", "parent_id", "span_id", F.explode(both).alias("x")).select("trace_id", "parent_id", "span_id", "x.*")


def contradictions(f: DataFrame) -> DataFrame:
    """(trace_id, parent_id, kind, entity, n): pairs of facts of two spans about one thing that differ, counted.

    Of m facts with m_s in span s, m(m-1)/2 less the sum of m_s(m_s-1)/2 pairs are of two spans; those that agree are counted alike by fact.
    """
    by = ["trace_id", "parent_id", "kind", "entity"]
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    held = f.groupBy(*by, "fact", "span_id").agg(F.count("*").alias("m"))
    alike = held.groupBy(*by, "fact").agg(F.sum("m").alias("m"), pairs("m").alias("inside")).groupBy(*by).agg((pairs("m") - F.sum("inside")).alias("agree"))
    spans_ = held.groupBy(*by, "span_id").agg(F.sum("m").alias("m"))
    all_ = spans_.groupBy(*by).agg(F.sum("m").alias("all"), pairs("m").alias("inside"))
    n = F.col("all") * (F.col("all") - 1) / 2 - F.col("inside") - F.col("agree")
    return all_.join(alike, by).select(*by, F.round(n).cast("long").alias("n")).filter("n > 0")


def reconciled(s: DataFrame, groups: DataFrame) -> DataFrame:
    """(trace_id, parent_id) of ``groups`` (trace_id, parent_id, until): one of the ten spans of the trace that start first at the group's end or later speaks of a reconciliation; without output its name does."""
    said = F.lower(F.when(F.coalesce("output", F.lit("")) == "", F.col("name")).otherwise(F.col("output")))
    mark = reduce(lambda a, b: a | b, [said.contains(w) for w in RECONCILED])
    w = W.partitionBy("trace_id").orderBy("start_time", "span_id")
    ahead = s.withColumn("near", F.max(F.coalesce(mark, F.lit(False)).cast("int")).over(w.rowsBetween(0, AFTER - 1)))
    rows = ahead.select("trace_id", F.col("start_time").alias("at"), F.lit(1).alias("is_span"), "span_id", "near", F.lit(None).cast(s.schema["parent_id"].dataType).alias("parent_id"))
    ends = groups.select("trace_id", F.col("until").alias("at"), F.lit(0).alias("is_span"), F.lit(None).cast(s.schema["span_id"].dataType).alias("span_id"), F.lit(None).cast("int").alias("near"), "parent_id")
    order = W.partitionBy("trace_id").orderBy("at", "is_span", "span_id").rowsBetween(0, W.unboundedFollowing)
    return rows.unionByName(ends).withColumn("near", F.first("near", ignorenulls=True).over(order)).filter("is_span = 0 and near = 1").select("trace_id", "parent_id")


def parallel_consistency(s: DataFrame) -> DataFrame:
    """(trace_id, groups, contradictions, severity) of traces of three spans or more with contradictory branches that nothing reconciles."""
    n = s.groupBy("trace_id").agg(F.count("*").alias("n")).filter("n >= 3").select("trace_id")
    o = overlapping(s)
    groups = o.groupBy("trace_id", "parent_id").agg(F.max("until").alias("until"))
    c = contradictions(facts(o)).groupBy("trace_id", "parent_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.when(F.col("kind") == "number", NUMBER_POINTS).otherwise(TRUTH_POINTS)).alias("points"))
    open_ = c.join(reconciled(s, groups), ["trace_id", "parent_id"], "left_anti").join(n, "trace_id", "left_semi")
    g = open_.groupBy("trace_id").agg(F.count("*").alias("groups"), F.sum("n").alias("contradictions"), F.sum("points").alias("points"))
    return g.select("trace_id", "groups", "contradictions", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), "points")).cast("int").alias("severity"))


_MARKED = "(" + " OR ".join(f"contains(said, '{w}')" for w in RECONCILED) + ")"
_FOUND = "SELECT trace_id, parent_id, span_id, '{0}' AS kind, lower(trim(unnest(regexp_extract_all(output, '{1}', 1)), ' \t\n')) AS entity, {2}(trim(unnest(regexp_extract_all(output, '{1}', 2)))) AS fact FROM o"


@query("k24_parallel_consistency", f"""WITH {BRANCHES}, b AS (SELECT *, coalesce(end_time, start_time) AS until, lower(CASE WHEN coalesce(output, '') = '' THEN name ELSE output END) AS said FROM branches),
o AS (SELECT * FROM b x WHERE EXISTS (SELECT 1 FROM b y WHERE x.trace_id = y.trace_id AND x.parent_id = y.parent_id AND x.span_id <> y.span_id AND ((x.start_time, x.span_id) < (y.start_time, y.span_id) AND y.start_time < x.until OR (y.start_time, y.span_id) < (x.start_time, x.span_id) AND x.start_time < y.until))),
f AS ({_FOUND.format("number", NUMBERS, "")} UNION ALL {_FOUND.format("truth", TRUTHS, "lower")}),
c AS (SELECT a.trace_id, a.parent_id, count(*) AS n, sum(CASE a.kind WHEN 'number' THEN {NUMBER_POINTS} ELSE {TRUTH_POINTS} END) AS points FROM f a JOIN f b ON a.trace_id = b.trace_id AND a.parent_id = b.parent_id AND a.span_id < b.span_id AND a.kind = b.kind AND a.entity = b.entity AND a.fact <> b.fact GROUP BY 1, 2),
g AS (SELECT trace_id, parent_id, max(until) AS until FROM o GROUP BY 1, 2), d AS (SELECT g.trace_id, g.parent_id, {_MARKED} AS marked FROM g JOIN b ON b.trace_id = g.trace_id AND b.start_time >= g.until QUALIFY row_number() OVER (PARTITION BY g.trace_id, g.parent_id ORDER BY b.start_time, b.span_id) <= {AFTER}),
e AS (SELECT trace_id, parent_id FROM d GROUP BY 1, 2 HAVING bool_or(marked)), n AS (SELECT trace_id FROM b GROUP BY 1 HAVING count(*) >= 3)
SELECT c.trace_id, count(*) AS groups, CAST(sum(n) AS BIGINT) AS contradictions, CAST(greatest({LEAST}, least({MOST}, sum(points))) AS INTEGER) AS severity FROM c ANTI JOIN e ON c.trace_id = e.trace_id AND c.parent_id = e.parent_id SEMI JOIN n ON c.trace_id = n.trace_id GROUP BY 1""")
def k24(spark, d) -> DataFrame:
    return parallel_consistency(branches(spark, d))
