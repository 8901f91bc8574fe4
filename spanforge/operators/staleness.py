"""Old dates in what agents retrieve (trace_id, span_id, kind, start_time, text), against the time that the task speaks of."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import RETRIEVALS, retrievals

#: What gives a date, a month, a year and a time long past; formats of dates; days that are old; least and most points.
DATE = r"(?i)(?:as of|data from|updated|last updated|current as of|dated|retrieved on|published|recorded|effective)\s+(\w+\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})"
MONTH = r"(?i)((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})"
YEAR = r"(?i)(?:in|since|from|during|circa|year)\s+(\d{4})\b"
LONG_PAST = r"(?i)(last year|two years ago|three years ago|several years ago|years ago|a few years back|back in \d{4}|prior to \d{4})"
FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMMM d yyyy")
OLD, YEARS, LEAST, MOST = 365, (1990, 2100), 20, 60
#: Points of a reference by its kind: at least, for each year, at most.
POINTS = {"date": (10, 3, 20), "month": (8, 2, 15), "year": (5, 2, 12), "past": (10, 0, 10)}


def dates(text: Column) -> Column:
    """(kind, day) of each reference to a date; months count from their first day, years from July, and a time long past has no day."""
    tidy = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    between = lambda c: F.when(F.year(c).between(*YEARS), c)
    parse = {
        "date": (DATE, lambda c: F.coalesce(*[F.to_date(F.try_to_timestamp(tidy(c), F.lit(f))) for f in FORMATS])), "month": (MONTH, lambda c: between(F.to_date(F.try_to_timestamp(F.concat(F.lit("1 "), tidy(c)), F.lit("d MMMM yyyy"))))),
        "year": (YEAR, lambda c: between(F.to_date(F.concat(c, F.lit("-07-01"))))), "past": (LONG_PAST, lambda c: F.lit(None).cast("date")),
    }

    def found(kind: str, pattern: str, day) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda c: F.struct(F.lit(kind).alias("kind"), day(c).alias("day")))

    return F.filter(F.concat(*[found(k, p, day) for k, (p, day) in parse.items()]), lambda x: x["day"].isNotNull() | (x["kind"] == "past"))


def memory_staleness(s: DataFrame, old: int = OLD) -> DataFrame:
    """(trace_id, references, severity) of traces whose retrievals refer to days more than ``old`` before the task's time, or to a time long past.

    The task's time is the newest day of the first input of a user that names one, else the day of the trace's first span. Days that don't
    exist are no dates; a null text refers to nothing.
    """
    s = s.filter("text is not null").withColumn("dates", dates(F.col("text")))
    newest = F.array_max(F.transform("dates", lambda x: x["day"]))
    per = W.partitionBy("trace_id")
    named = F.when((F.col("kind") == "user_input") & newest.isNotNull(), F.struct("start_time", "span_id", newest.alias("day")))
    task = F.coalesce(F.min(named).over(per)["day"], F.to_date(F.min("start_time").over(per)))
    r = s.withColumn("task", task).filter("kind = 'retrieval'").select("trace_id", "task", F.explode("dates").alias("x"))
    r = r.withColumn("age", F.datediff("task", "x.day")).filter(F.col("age").isNull() | (F.col("age") > old))
    years = F.floor(F.coalesce("age", F.lit(0)) / 365.25)
    points = F.coalesce(*[F.when(F.col("x.kind") == k, F.least(F.lit(most), least + years * each)) for k, (least, each, most) in POINTS.items()])
    g = r.groupBy("trace_id").agg(F.count("*").alias("references"), F.sum(points).alias("points"))
    return g.select("trace_id", "references", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), "points")).cast("int").alias("severity"))


_PARSE = {"date": "CAST(try_strptime(x, ['%Y-%m-%d', '%m/%d/%Y', '%B %d, %Y', '%B %d %Y']) AS DATE)", "month": "CAST(try_strptime('1 ' || x, '%d %B %Y') AS DATE)", "year": "TRY_CAST(x || '-07-01' AS DATE)", "past": "NULL::DATE"}
_FOUND = " UNION ALL ".join(f"SELECT trace_id, span_id, kind AS span, start_time, '{k}' AS kind, {_PARSE[k]} AS day FROM (SELECT *, unnest(regexp_extract_all(text, '{p}', 1)) AS x FROM retrievals)" for k, p in (("date", DATE), ("month", MONTH), ("year", YEAR), ("past", LONG_PAST)))
_POINTS = "CASE kind " + " ".join(f"WHEN '{k}' THEN least({most}, {least} + CAST(floor(coalesce(age, 0) / 365.25) AS INTEGER) * {each})" for k, (least, each, most) in POINTS.items()) + " END"


@query("k25_memory_staleness", f"""WITH {RETRIEVALS}, f AS (SELECT * FROM ({_FOUND}) WHERE kind = 'past' OR (day IS NOT NULL AND (kind = 'date' OR year(day) BETWEEN {YEARS[0]} AND {YEARS[1]}))),
u AS (SELECT trace_id, day FROM (SELECT trace_id, start_time, span_id, max(day) AS day FROM f WHERE span = 'user_input' AND day IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) = 1),
t AS (SELECT trace_id, CAST(min(start_time) AS DATE) AS first FROM retrievals GROUP BY 1), a AS (SELECT f.trace_id, f.kind, date_diff('day', f.day, coalesce(u.day, t.first)) AS age FROM f JOIN t ON f.trace_id = t.trace_id LEFT JOIN u ON f.trace_id = u.trace_id WHERE span = 'retrieval')
SELECT trace_id, count(*) AS "references", CAST(greatest({LEAST}, least({MOST}, sum({_POINTS}))) AS INTEGER) AS severity FROM a WHERE age IS NULL OR age > {OLD} GROUP BY 1""")
def k25(spark, d) -> DataFrame:
    return memory_staleness(retrievals(spark, d))


@query("h16_dates", f"""WITH {RETRIEVALS}, f AS (SELECT * FROM ({_FOUND}) WHERE kind = 'past' OR (day IS NOT NULL AND (kind = 'date' OR year(day) BETWEEN {YEARS[0]} AND {YEARS[1]}))) SELECT trace_id, span_id, kind, day FROM f""")
def h16(spark, d) -> DataFrame:
    return retrievals(spark, d).select("trace_id", "span_id", F.explode(dates(F.col("text"))).alias("x")).select("trace_id", "span_id", "x.kind", "x.day")
