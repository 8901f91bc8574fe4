"""Files with awkward lines, and streams held against the same checks over whole tables."""

import hashlib
import json

from pyspark.sql import functions as F

from spanforge.functions import rules
from spanforge.operators import calibration, coordination
from spanforge.sources import otlp, records
from spanforge.sources.adapters import agent_spans
from spanforge.streaming import realtime

D = "/root/testdata/sf0.001"


def test_telemetry_files(spark, tmp_path):
    attrs = [{"key": "gen_ai.agent.name", "value": {"stringValue": "A"}}, {"key": "n", "value": {"intValue": "7"}}, {"key": "n", "value": {"doubleValue": 1.5}}, {"key": "gen_ai.state", "value": {"stringValue": json.dumps({"b": 1, "a": "x"})}}]
    span = {"traceId": "t", "spanId": "s1", "name": "step", "startTimeUnixNano": "2000000", "endTimeUnixNano": "5000000", "attributes": attrs, "status": {"code": 2}}
    other = {"spanId": "s2", "name": "my node", "startTimeUnixNano": "1000000"}
    lines = [json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, other]}, {"spans": []}, {}]}]}), '{"resourceSpans": []}', "{}", "", "{broken", "[1"]
    (tmp_path / "x.json").write_text("\n".join(lines))
    rows, errors = otlp.read_lines(spark, str(tmp_path))
    assert sorted(r.line for r in errors.collect()) == ["[1", "{broken"]
    spans = {r.span_id: r for r in otlp.flatten(rows).collect()}
    assert spans["s1"].attributes["n"] == "1.5" and spans["s1"].status == "error" and spans["s1"].duration_ms == 3
    assert spans["s2"].trace_id == "unknown" and spans["s2"].attributes == {}
    states = {r.span_id: r for r in otlp.states(otlp.read_otlp(spark, str(tmp_path))).collect()}
    assert states["s1"].agent_id == "A" and states["s2"].agent_id == "my node"
    assert states["s1"].state_hash == hashlib.sha256(json.dumps({"b": 1, "a": "x"}, sort_keys=True).encode()).hexdigest()[:16]
    assert states["s2"].state_hash == hashlib.sha256(b"{}").hexdigest()[:16]


def test_records_of_any_maker(spark):
    lines = ['{"runId": 1, "id": "r", "session_id": "s", "inputs": {"q": 1}, "error": "x"}', '{"name": "n", "status": "FAILED"}', "not json", "[]", "", None]
    got = records.records(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")).orderBy("line_no").collect()
    assert [r.parsed for r in got] == [True, True, False, False, False, False]
    assert (got[0].trace_id, got[0].span_id, got[0].status, got[0].input) == ("s", "r", "error", '{"q":1}')
    assert (got[1].trace_id, got[1].span_id, got[1].status) == ("unknown", "line-1", "error")
    assert got[2].trace_id is None and got[2].status is None


def test_longest_common_subsequence(spark):
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    pairs = [(list("abcbdab"), list("bdcaba")), ([], ["a"]), (["a"], []), (list("aaaa"), list("aa")), (list("abc"), list("xyz"))]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", rules.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == plain(r.a, r.b) for r in rows)


def test_isotonic_fit_never_falls(spark):
    p = spark.createDataFrame([("m", (i * 37 % 50) / 50, i % 3 == 0, i * 37 % 50 > 20) for i in range(200)] + [("few", 0.5, True, True)], "mode string, confidence double, detected boolean, truth boolean")
    rows = calibration.isotonic(p).collect()
    assert {r["mode"] for r in rows} == {"m"}
    fit = [r.probability for r in sorted(rows, key=lambda r: r.confidence)]
    assert len(fit) > 1 and fit == sorted(fit) and 0 <= fit[0] and fit[-1] <= 1


def test_coordination_without_messages(spark):
    none = spark.createDataFrame([], "trace_id long, msg_id long, sender string, recipient string, content string, ts double")
    assert coordination.coordination(none).count() == 0
    two = spark.createDataFrame([(1, 1, "a", "b", "deploy the service now please", 0.0), (1, 2, "a", "c", "deploy the service now please", 1.0), (1, 3, "b", "a", None, 30.0)], none.schema)
    row = coordination.coordination(two).first()
    assert row.issues > 0 and row.healthy


def files(spark, tmp_path, df, n):
    for k in range(n):
        df.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(frame, tmp_path, sink):
    # With a time-out Spark would go on making batches without data.
    frame.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    running = frame.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    done = running.awaitTermination(120)
    running.stop()
    assert done


def test_live_checks_equal_the_whole_table(spark, tmp_path):
    a = agent_spans(spark, D).select("trace_id", "span_id", "us", "kind", "name")
    cut = a.approxQuantile("us", [0.5], 0.0)[0]
    s = files(spark, tmp_path, a.withColumn("part", (F.col("us") > cut).cast("int")), 2)
    got = []
    drain(realtime.live_checks(s), tmp_path, lambda b, _: got.extend(tuple(r) for r in b.collect()))
    want = [tuple(r) for r in realtime.checked(a).collect()]
    assert sorted(got) == sorted(want)


def test_an_upsert_keeps_the_newest_row(spark, tmp_path):
    target = str(tmp_path / "out")
    write = realtime.upsert(target, "id")
    write(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), 0)
    write(spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, v string"), 1)
    write(spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, v string"), 1)  # a repeated batch
    assert sorted(tuple(r) for r in realtime.latest(spark, target, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_sessions_and_rates_on_a_stream(spark, tmp_path):
    e = spark.read.parquet(f"{D}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = e.approxQuantile("event_id", [0.5], 0.0)[0]
    s = files(spark, tmp_path, e.withColumn("part", (F.col("event_id") > cut).cast("int")), 2)
    got = []
    drain(realtime.rates(s), tmp_path, lambda b, _: got.extend(tuple(r) for r in b.collect()))
    want = {tuple(r) for r in realtime.rates(e).collect()}
    # Windows that the watermark of the batch before has not passed are still open.
    assert set(got) <= want and len(got) == len(set(got)) and len(got) > 0.3 * len(want)
