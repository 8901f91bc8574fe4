"""Dates and their age on cases worked out by hand."""

import datetime

from spanforge.operators import staleness as x


def frame(spark, *rows):
    data = [(1, i, k, datetime.datetime(2024, 1, 1, 12, 0, i), t) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(data, "trace_id long, span_id long, kind string, start_time timestamp, text string")


def severity(spark, *rows):
    return [tuple(r)[1:] for r in x.memory_staleness(frame(spark, *rows)).collect()]


def test_dates(spark):
    got = [(r.x.kind, str(r.x.day)) for r in frame(spark, ("tool", "As of march 5, 2019; updated 6/7/2021, dated 2020-02-30; may 2017, since 2016, in 1980, last year")).selectExpr("text").select(x.F.explode(x.dates(x.F.col("text"))).alias("x")).collect()]
    assert got == [("date", "2019-03-05"), ("date", "2021-06-07"), ("month", "2017-05-01"), ("year", "2016-07-01"), ("past", "None")]


def test_age_is_held_against_the_task(spark):
    assert severity(spark, ("retrieval", "updated 2022-12-31")) == [(1, 20)]
    assert severity(spark, ("retrieval", "updated 2023-01-01")) == []
    assert severity(spark, ("retrieval", "updated 2019-01-01"), ("retrieval", "January 2010, since 2012, years ago")) == [(4, 57)]
    assert severity(spark, ("user_input", "as of 2020-01-01"), ("user_input", "as of 2030-01-01"), ("retrieval", "updated 2019-06-01")) == []
    assert severity(spark, ("tool", "since 2001"), ("retrieval", None), ("retrieval", "")) == []
