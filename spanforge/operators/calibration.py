"""Calibration and regression: folds, thresholds, confidence bands, feedback, attribution scores, drift between runs."""

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard, ratio, token_estimate, words
from ..plans.registry import query
from ..sources.adapters import PREDICTIONS, SPANS, order, predictions, read, spans, turns
from .evaluation import CONFUSION, _r, confusion, scores

#: Folds, and the grid of thresholds.
FOLDS, GRID = 3, [x / 100 for x in range(10, 91, 5)]


def fold(record: Column) -> Column:
    """A fold by the record's hash, which needs no order of the rows."""
    return F.pmod(F.conv(F.substring(F.md5(record.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(FOLDS)).cast("int")


_FOLD = f"CAST(CAST('0x' || substr(md5(CAST(record_id AS VARCHAR)), 1, 8) AS BIGINT) % {FOLDS} AS INTEGER)"


@query("q2_folds", f"WITH {PREDICTIONS} SELECT record_id, {_FOLD} AS fold FROM predictions")
def q2(spark, d) -> DataFrame:
    return predictions(spark, d).select("record_id", fold(F.col("record_id")).alias("fold"))


def threshold_counts(p: DataFrame, *by: str) -> DataFrame:
    """(by, step, threshold, tp, fp, fn) for every threshold of the grid; rows are counted once by the steps that they reach."""
    above = F.size(F.filter(F.array(*[F.lit(x) for x in GRID]), lambda t: F.col("confidence") >= t)).alias("above")
    steps = p.groupBy(*by, above).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    steps = steps.withColumn("grid", F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in range(1, len(GRID) + 1)]).alias("step"), F.array(*[F.lit(x) for x in GRID]).alias("threshold"))))
    reached = F.col("above") >= F.col("grid.step")
    n = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    return steps.groupBy(*by, F.col("grid.step").alias("step"), F.col("grid.threshold").alias("threshold")).agg(n("pos", reached).alias("tp"), n("neg", reached).alias("fp"), n("pos", ~reached).alias("fn"))


def calibrated(p: DataFrame) -> DataFrame:
    """(fold, threshold, f1): for each fold the threshold that is best on the other folds, by F1, then precision, then the lower, and its F1 here."""
    each = threshold_counts(p.withColumn("fold", fold(F.col("record_id"))), "fold")
    whole = each.groupBy("step", "threshold").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")])
    rest = each.join(whole, ["step", "threshold"]).withColumns({f"r_{c}": F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "fn")})
    f1 = lambda a: F.round(ratio(2 * F.col(f"{a}tp"), 2 * F.col(f"{a}tp") + F.col(f"{a}fp") + F.col(f"{a}fn")), 6)
    rank = F.struct(f1("r_"), F.round(ratio(F.col("r_tp"), F.col("r_tp") + F.col("r_fp")), 6), -F.col("threshold"))
    best = rest.withColumn("f1", f1("")).groupBy("fold").agg(F.max_by(F.struct("threshold", "f1"), rank).alias("x"))
    return best.select("fold", "x.threshold", "x.f1")


_STEPS = f"""WITH {PREDICTIONS}, p AS (SELECT *, {_FOLD} AS fold FROM predictions), g AS (SELECT CAST(x AS DOUBLE) / 100 AS threshold FROM generate_series(10, 90, 5) t(x)),
c AS (SELECT f.fold, threshold, count(*) FILTER (WHERE p.fold = f.fold AND confidence >= threshold AND truth) AS tp, count(*) FILTER (WHERE p.fold = f.fold AND confidence >= threshold AND NOT truth) AS fp, count(*) FILTER (WHERE p.fold = f.fold AND confidence < threshold AND truth) AS fn,
 count(*) FILTER (WHERE p.fold <> f.fold AND confidence >= threshold AND truth) AS rtp, count(*) FILTER (WHERE p.fold <> f.fold AND confidence >= threshold AND NOT truth) AS rfp, count(*) FILTER (WHERE p.fold <> f.fold AND confidence < threshold AND truth) AS rfn FROM g, p, (SELECT DISTINCT fold FROM p) f GROUP BY 1, 2),
b AS (SELECT fold, threshold, {_r('2 * tp', '2 * tp + fp + fn')} AS f1, row_number() OVER (PARTITION BY fold ORDER BY {_r('2 * rtp', '2 * rtp + rfp + rfn')} DESC, {_r('rtp', 'rtp + rfp')} DESC, threshold) AS nth FROM c), k AS (SELECT fold, threshold, f1 FROM b WHERE nth = 1)"""


@query("q1_calibrated_folds", f"{_STEPS} SELECT * FROM k")
def q1(spark, d) -> DataFrame:
    return calibrated(predictions(spark, d))


@query("q6_fold_variance", f"{_STEPS} SELECT count(*) AS folds, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS sd_f1 FROM k")
def q6(spark, d) -> DataFrame:
    return calibrated(predictions(spark, d)).agg(F.count("*").alias("folds"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.stddev_samp("f1"), 6).alias("sd_f1"))


@query("q7_holdout", f"{_STEPS} SELECT threshold, f1 FROM k WHERE fold = 0")
def q7(spark, d) -> DataFrame:
    """The first fold held out: the threshold of the others, and what it reaches."""
    return calibrated(predictions(spark, d)).filter("fold = 0").select("threshold", "f1")


@query("q8_by_difficulty", f"WITH {PREDICTIONS}, c AS (SELECT CASE WHEN confidence < 0.2 THEN 'easy' WHEN confidence < 0.6 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) FILTER (WHERE detected AND truth) AS tp, count(*) FILTER (WHERE detected AND NOT truth) AS fp, count(*) FILTER (WHERE NOT detected AND truth) AS fn, count(*) FILTER (WHERE NOT detected AND NOT truth) AS tn FROM predictions GROUP BY 1) SELECT *, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall, {_r('2 * tp', '2 * tp + fp + fn')} AS f1, {_r('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_r('tn', 'tn + fp')} AS specificity FROM c")
def q8(spark, d) -> DataFrame:
    level = F.when(F.col("confidence") < 0.2, "easy").when(F.col("confidence") < 0.6, "medium").otherwise("hard")
    return scores(confusion(predictions(spark, d).withColumn("difficulty", level), "difficulty"))


def isotonic(p: DataFrame) -> DataFrame:
    """(mode, confidence, probability): the non-decreasing fit of right verdicts to confidence, for modes of 20 records or more.

    Records of one confidence are pooled first, so that a mode's group holds a row for each level of
    confidence, to four places, and never its records.
    """
    level = F.round("confidence", 4).alias("level")
    levels = p.groupBy("mode", level).agg(F.sum((F.col("detected") == F.col("truth")).cast("double")).alias("right"), F.count("*").alias("n"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        if pdf["n"].sum() >= 20:
            for at, right, n in pdf.sort_values("level")[["level", "right", "n"]].itertuples(index=False):
                blocks.append([at, right, n])
                while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
                    b, a = blocks.pop(), blocks.pop()
                    blocks.append([(a[0] + b[0]) / 2, a[1] + b[1], a[2] + b[2]])
        return pd.DataFrame({"mode": [pdf["mode"].iloc[0]] * len(blocks), "confidence": [b[0] for b in blocks], "probability": [b[1] / b[2] for b in blocks]}).astype({"mode": object})

    return levels.groupBy("mode").applyInPandas(pool, "mode string, confidence double, probability double")


@query("q3_isotonic")
def q3(spark, d) -> DataFrame:
    return isotonic(predictions(spark, d))


#: Resamples, and the seed of their indexes.
RESAMPLES, SEED = 1000, 42
#: Resamples of a task; records of a run that travel as one array; records that a task holds.
DRAWS, RUN, HELD = 25, 4096, 1 << 20


@query("q4_bootstrap", f"""WITH {PREDICTIONS}, r AS (SELECT mode, record_id, detected, truth, row_number() OVER (PARTITION BY mode ORDER BY record_id) - 1 AS i, count(*) OVER (PARTITION BY mode) AS n FROM predictions),
s AS (SELECT mode, n, b, CAST('0x' || substr(md5('{SEED}_' || b || '_' || i), 1, 8) AS BIGINT) % n AS pick FROM r, generate_series(0, {RESAMPLES - 1}) t(b) WHERE n >= 4),
f AS (SELECT s.mode, b, {_r('2 * count(*) FILTER (WHERE detected AND truth)', 'count(*) FILTER (WHERE detected) + count(*) FILTER (WHERE truth)')} AS f1 FROM s JOIN r ON r.mode = s.mode AND r.i = s.pick GROUP BY 1, 2),
o AS (SELECT mode, f1, row_number() OVER (PARTITION BY mode ORDER BY f1) - 1 AS place FROM f) SELECT mode, max(f1) FILTER (WHERE place = {int(0.025 * RESAMPLES)}) AS lower, max(f1) FILTER (WHERE place = {int(0.975 * RESAMPLES) - 1}) AS upper FROM o GROUP BY 1""")
def q4(spark, d) -> DataFrame:
    return bootstrap(predictions(spark, d))


def bootstrap(p: DataFrame, held: int = HELD) -> DataFrame:
    """(mode, lower, upper): the 95 % band of each mode's F1 over resamples whose indexes come from a hash. Modes of under four records have no band.

    A task draws some resamples of a mode and counts the picks among the records that it holds, a byte each; a mode of
    more records is held in several tasks. Only counts of a resample leave a task.
    """
    w = W.partitionBy("mode")
    code = (F.coalesce(F.col("detected"), F.lit(False)).cast("int") + 2 * F.coalesce(F.col("truth"), F.lit(False)).cast("int")).cast("tinyint")
    r = p.filter("mode is not null").select("mode", code.alias("code"), (F.row_number().over(w.orderBy("record_id")) - 1).alias("i"), F.count("*").over(w).alias("n")).filter("n >= 4")
    runs = r.groupBy("mode", "n", F.floor(F.col("i") / min(RUN, held)).alias("run")).agg(F.array_sort(F.collect_list(F.struct("i", "code"))).alias("x")).select("mode", "n", F.expr("x[0].i").alias("start"), F.expr("transform(x, y -> y.code)").alias("codes"))
    dealt = runs.withColumn("piece", F.floor(F.col("start") / held)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit((RESAMPLES - 1) // DRAWS))))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        codes, start, n = np.concatenate(pdf["codes"].tolist()), int(pdf["start"].iloc[0]), int(pdf["n"].iloc[0])
        first = int(pdf["draw"].iloc[0]) * DRAWS
        sums = {b: np.zeros(4, np.int64) for b in range(first, min(first + DRAWS, RESAMPLES))}
        for lo in range(0, n, 65536):
            suffixes = [b"%d" % i for i in range(lo, min(n, lo + 65536))]
            for b, total in sums.items():
                prefix = b"%d_%d_" % (SEED, b)
                drawn = np.frombuffer(b"".join([md5(prefix + i).digest()[:4] for i in suffixes]), ">u4").astype(np.int64) % n - start
                total += np.bincount(codes[drawn[(drawn >= 0) & (drawn < len(codes))]], minlength=4)
        return pd.DataFrame([(pdf["mode"].iloc[0], b, t[3], t[1] + t[3], t[2] + t[3]) for b, t in sums.items()], columns=["mode", "b", "both", "detected", "truth"])

    tasks = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = dealt.repartition(tasks, "mode", "draw", "piece").groupBy("mode", "draw", "piece").applyInPandas(count, "mode string, b int, both long, detected long, truth long")
    f = counts.groupBy("mode", "b").agg(F.round(ratio(2 * F.sum("both"), F.sum("detected") + F.sum("truth")), 6).alias("f1"))
    ordered = f.groupBy("mode").agg(F.array_sort(F.collect_list("f1")).alias("x"))
    return ordered.select("mode", F.col("x")[int(0.025 * RESAMPLES)].alias("lower"), F.col("x")[int(0.975 * RESAMPLES) - 1].alias("upper"))


_FLAGS = """f AS (SELECT d.doc_id, unnest(['toxic', 'low_quality', 'long', 'digits']) AS name, unnest([toxic = 1, quality = 0, length(text) > 1500, regexp_matches(text, '[0-9]')]) AS flag FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL)"""


def flags(spark, d) -> DataFrame:
    """(doc_id, name, flag): four detectors' verdicts on the labelled documents."""
    j = read(spark, d, "documents").filter("text is not null").select("doc_id", (F.length("text") > 1500).alias("long"), F.col("text").rlike("[0-9]").alias("digits"))
    j = j.join(read(spark, d, "labels").filter("toxic is not null and quality is not null").select("doc_id", (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 0).alias("low_quality")), "doc_id")
    return j.unpivot("doc_id", ["toxic", "low_quality", "long", "digits"], "name", "flag")


_PHI = "(CAST(n AS DOUBLE) * n11 - CAST(x AS DOUBLE) * y) / sqrt(CAST(x AS DOUBLE) * y * (n - x) * (n - y))"


@query("q5_phi_matrix", f"WITH {_FLAGS}, p AS (SELECT a.name AS first, b.name AS second, count(*) AS n, count(*) FILTER (WHERE a.flag AND b.flag) AS n11, count(*) FILTER (WHERE a.flag) AS x, count(*) FILTER (WHERE b.flag) AS y FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY 1, 2) SELECT first, second, n, round(CASE WHEN x * y * (n - x) * (n - y) = 0 THEN 0 ELSE {_PHI} END, 6) AS phi FROM p")
def q5_matrix(spark, d) -> DataFrame:
    """Phi of every pair of detectors over the records that both judged. A record's few verdicts meet in its own row, so that nothing is joined."""
    per = flags(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "flag"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["name"] > a["name"]), lambda b: F.struct(a["name"].alias("first"), b["name"].alias("second"), a["flag"].alias("a"), b["flag"].alias("b")))))
    c = per.select(F.explode(pairs).alias("p")).select("p.*").groupBy("first", "second").agg(F.count("*").alias("n"), F.count_if(F.col("a") & F.col("b")).alias("n11"), F.count_if("a").alias("x"), F.count_if("b").alias("y"))
    n, n11, x, y = (F.col(k).cast("double") for k in ("n", "n11", "x", "y"))
    return c.select("first", "second", "n", F.round(ratio(n * n11 - x * y, F.sqrt(x * y * (n - x) * (n - y))), 6).alias("phi"))


def adjusted(base: Column, precision: Column, recall: Column, n: Column, most: float = 0.15) -> Column:
    """A threshold moved by feedback: up for false positives, down for misses, a tenth of the difference if both are fair; damped under 50 records, unmoved under 5."""
    damping = F.least(F.lit(1.0), n / 50)
    move = F.when(precision < 0.5, (0.5 - precision) * damping).when(recall < 0.5, -(0.5 - recall) * damping).otherwise((precision - recall) * 0.1 * damping)
    moved = F.greatest(F.lit(0.1), F.least(F.lit(0.9), base + F.greatest(F.lit(-most), F.least(F.lit(most), move))))
    return F.when(n < 5, base).otherwise(moved)


_FB = f"{CONFUSION}, f AS (SELECT mode, tp + fp + fn + tn AS n, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall FROM c)"
_MOVE = "CASE WHEN precision < 0.5 THEN (0.5 - precision) * least(1.0, n / 50) WHEN recall < 0.5 THEN -(0.5 - recall) * least(1.0, n / 50) ELSE (precision - recall) * 0.1 * least(1.0, n / 50) END"


def feedback(spark, d) -> DataFrame:
    return scores(confusion(predictions(spark, d), "mode")).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


@query("q10_adjusted_thresholds", f"{_FB} SELECT mode, round(CASE WHEN n < 5 THEN 0.5 ELSE greatest(0.1, least(0.9, 0.5 + greatest(-0.15, least(0.15, {_MOVE})))) END, 5) AS threshold FROM f")
def q10(spark, d, base: float = 0.5) -> DataFrame:
    return feedback(spark, d).select("mode", F.round(adjusted(F.lit(base), F.col("precision"), F.col("recall"), F.col("n")), 5).alias("threshold"))


@query("q11_confidence_multipliers", f"{_FB} SELECT mode, CASE WHEN n < 5 THEN 1.0 ELSE greatest(0.5, least(1.5, 0.5 + precision)) END AS multiplier FROM f")
def q11(spark, d) -> DataFrame:
    return feedback(spark, d).select("mode", F.when(F.col("n") < 5, 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.5), 0.5 + F.col("precision")))).alias("multiplier"))


@query("q12_suppressed", f"WITH {PREDICTIONS}, h AS (SELECT p.*, md5(coalesce(text, '')) AS h FROM predictions p JOIN documents d ON d.doc_id = p.record_id) SELECT record_id FROM h WHERE detected AND NOT EXISTS (SELECT 1 FROM h x WHERE x.h = h.h AND x.detected AND NOT x.truth)")
def q12(spark, d) -> DataFrame:
    """Detections left when those of inputs once called false positives are suppressed."""
    hashed = predictions(spark, d).filter("detected").join(read(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.md5(F.coalesce("text", F.lit(""))).alias("h")), "record_id")
    return hashed.join(hashed.filter(~F.col("truth")).select("h").distinct(), "h", "left_anti").select("record_id")


@query("q15_agent_spikes", f"WITH {SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time DESC, span_id DESC) AS back FROM spans), a AS (SELECT trace_id, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) FILTER (WHERE back > 20) AS base, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) FILTER (WHERE back <= 20) AS recent FROM r GROUP BY 1) SELECT trace_id, round(base, 6) AS base, round(recent, 6) AS recent, coalesce(recent > 3 * base, FALSE) AS spike FROM a")
def q15(spark, d, last: int = 20, times: float = 3.0) -> DataFrame:
    """Failure rate of each agent's last twenty runs against all before; a spike is over three times it."""
    bad = F.when(F.col("status") == "error", 1.0).otherwise(0.0)
    r = spans(spark, d).withColumn("back", F.row_number().over(W.partitionBy("trace_id").orderBy(F.desc("start_time"), F.desc("span_id"))))
    a = r.groupBy("trace_id").agg(F.avg(F.when(F.col("back") > last, bad)).alias("base"), F.avg(F.when(F.col("back") <= last, bad)).alias("recent"))
    return a.select("trace_id", F.round("base", 6).alias("base"), F.round("recent", 6).alias("recent"), F.coalesce(F.col("recent") > times * F.col("base"), F.lit(False)).alias("spike"))


@query("q16_failures_together", f"WITH {SPANS}, f AS (SELECT DISTINCT trace_id, CAST(start_time AS DATE) AS day, 'F' || (k % 7) AS mode FROM spans WHERE status = 'error' AND k IS NOT NULL) SELECT a.mode AS first, b.mode AS second, count(*) AS n FROM f a JOIN f b ON a.trace_id = b.trace_id AND a.day = b.day AND a.mode < b.mode GROUP BY 1, 2")
def q16(spark, d) -> DataFrame:
    """Pairs of failure modes of one trace on one day; a window's few modes are paired in its own row."""
    f = spans(spark, d).filter("status = 'error' and k is not null").select("trace_id", F.to_date("start_time").alias("day"), F.concat(F.lit("F"), (F.col("k") % 7).cast("string")).alias("mode"))
    per = f.groupBy("trace_id", "day").agg(F.array_sort(F.collect_set("mode")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


# Annotations: a span's category in truth and as predicted.
_ANN = f"WITH {SPANS}, truth AS (SELECT span_id, 'c' || (k % 5) AS category, CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM spans WHERE status = 'error' AND k IS NOT NULL), found AS (SELECT span_id, 'c' || (CASE WHEN value < 50 THEN k % 5 ELSE 4 END) AS category FROM spans WHERE k IS NOT NULL AND (status = 'error' OR value > 90))"


def annotations(spark, d) -> tuple[DataFrame, DataFrame]:
    s = spans(spark, d).filter("k is not null")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    impact = F.when(F.col("k") % 3 == 0, "HIGH").when(F.col("k") % 3 == 1, "MEDIUM").otherwise("LOW")
    truth = s.filter("status = 'error'").select("span_id", name(F.col("k") % 5).alias("category"), impact.alias("impact"))
    found = s.filter("status = 'error' or value > 90").select("span_id", name(F.when(F.col("value") < 50, F.col("k") % 5).otherwise(4)).alias("category"))
    return truth, found


@query("p7_joint_accuracy", f"{_ANN} SELECT round(CAST((SELECT count(*) FROM found f WHERE EXISTS (SELECT 1 FROM truth t WHERE t.span_id = f.span_id AND t.category = f.category)) AS DOUBLE) / (SELECT count(*) FROM (SELECT DISTINCT span_id, category FROM truth)), 6) AS accuracy")
def p7(spark, d) -> DataFrame:
    """Predictions with the right place and category over the distinct true ones; repeated predictions count each. Both numbers come from one aggregate of the two tables' union."""
    truth, found = annotations(spark, d)
    both = truth.select("span_id", "category").distinct().withColumns({"t": F.lit(1), "f": F.lit(0)}).unionByName(found.withColumns({"t": F.lit(0), "f": F.lit(1)}))
    per = both.groupBy("span_id", "category").agg(F.max("t").alias("t"), F.sum("f").alias("f"))
    return per.agg(F.round(ratio(F.sum(F.col("t") * F.col("f")), F.sum("t")), 6).alias("accuracy"))


@query("p8_category_f1", f"{_ANN}, c AS (SELECT coalesce(t.category, f.category) AS category, count(*) FILTER (WHERE t.span_id IS NOT NULL AND f.span_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.span_id IS NULL) AS fp, count(*) FILTER (WHERE f.span_id IS NULL) AS fn FROM (SELECT DISTINCT span_id, category FROM truth) t FULL JOIN (SELECT DISTINCT span_id, category FROM found) f ON t.span_id = f.span_id AND t.category = f.category GROUP BY 1) SELECT *, {_r('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c")
def p8(spark, d) -> DataFrame:
    truth, found = annotations(spark, d)
    t, f = truth.select("span_id", "category").distinct().withColumn("t", F.lit(True)), found.distinct().withColumn("f", F.lit(True))
    c = t.join(f, ["span_id", "category"], "full").groupBy("category").agg(F.count_if(F.col("t") & F.col("f")).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return c.withColumn("f1", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


@query("p9_impact_breakdown", f"{_ANN}, h AS (SELECT t.*, EXISTS (SELECT 1 FROM found f WHERE t.span_id = f.span_id AND t.category = f.category) AS hit FROM truth t) SELECT impact, count(*) AS total, count(*) FILTER (WHERE hit) AS detected, count(*) FILTER (WHERE NOT hit) AS missed, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM h GROUP BY 1")
def p9(spark, d) -> DataFrame:
    truth, found = annotations(spark, d)
    h = truth.join(found.distinct().withColumn("hit", F.lit(True)), ["span_id", "category"], "left").fillna(False, ["hit"])
    return h.groupBy("impact").agg(F.count("*").alias("total"), F.count_if("hit").alias("detected"), F.count_if(~F.col("hit")).alias("missed"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("accuracy"))


def agent_name(name: Column) -> Column:
    """A name without a remark in brackets, in lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", "")))


_ATT = f"WITH {SPANS}, a AS (SELECT trace_id, name || CASE WHEN k % 2 = 0 THEN ' (thought)' ELSE '' END AS predicted, CASE WHEN value < 60 THEN upper(name) ELSE 'other' END AS actual, k AS step, CAST(k + floor(value) % 3 AS INTEGER) AS true_step FROM spans WHERE k IS NOT NULL)"


@query("p10_attribution", f"{_ATT} SELECT trace_id, round(avg(CASE WHEN lower(trim(regexp_replace(predicted, '\\s*\\([^)]*\\)', '', 'g'))) = lower(trim(regexp_replace(actual, '\\s*\\([^)]*\\)', '', 'g'))) THEN 1.0 ELSE 0.0 END), 6) AS agent_accuracy, round(avg(CASE WHEN abs(step - true_step) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS step_accuracy FROM a GROUP BY 1")
def p10(spark, d, tolerance: int = 1) -> DataFrame:
    """How often the agent, by its plain name, and the step, within the tolerance, are right."""
    s = spans(spark, d).filter("k is not null")
    predicted = F.concat("name", F.when(F.col("k") % 2 == 0, " (thought)").otherwise(""))
    actual = F.when(F.col("value") < 60, F.upper("name")).otherwise("other")
    step = F.abs(F.col("k") - (F.col("k") + F.floor("value") % 3).cast("int")) <= tolerance
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return s.groupBy("trace_id").agg(rate(agent_name(predicted) == agent_name(actual)).alias("agent_accuracy"), rate(step).alias("step_accuracy"))


#: Weights of an evaluation's scores by name, and the score from which it passes.
WEIGHTS, PASS = {"click": 1.0, "view": 1.0, "purchase": 2.0, "signup": 0.5, "error": 3.0}, 0.7


@query("p12_eval_aggregate", f"WITH {SPANS}, w(name, weight) AS (VALUES {', '.join(f'({k!r}, CAST({v} AS DOUBLE))' for k, v in WEIGHTS.items())}) SELECT trace_id, round(sum(value / 100 * weight) / sum(weight), 4) AS overall, sum(value / 100 * weight) / sum(weight) >= {PASS} AND count(*) FILTER (WHERE spans.name = 'error' AND value < 5) = 0 AS passed FROM spans JOIN w ON w.name = spans.name GROUP BY 1")
def p12(spark, d) -> DataFrame:
    """Weighted mean of a trace's scores; it passes from 0.7 on if every required score (of errors, 0.05) is met."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("name")]
    s = spans(spark, d).withColumn("w", weight)
    overall = F.sum(F.col("value") / 100 * F.col("w")) / F.sum("w")
    return s.groupBy("trace_id").agg(F.round(overall, 4).alias("overall"), ((overall >= PASS) & (F.count_if((F.col("name") == "error") & (F.col("value") < 5)) == 0)).alias("passed"))


@query("p20_feedback_stats", f"{CONFUSION} SELECT mode, tp, fp, fn, tn, tp + fp + fn + tn AS total, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall FROM c")
def p20(spark, d) -> DataFrame:
    return feedback(spark, d).select("mode", "tp", "fp", "fn", "tn", F.col("n").alias("total"), "precision", "recall")


@query("p21_group_threshold_advice", f"{CONFUSION} SELECT mode, {_r('fp', 'tp + fp')} AS fp_rate, CAST(CASE WHEN tp + fp = 0 THEN 0.0 WHEN CAST(fp AS DOUBLE) / (tp + fp) > 0.3 THEN 0.03 WHEN CAST(fp AS DOUBLE) / (tp + fp) > 0.15 THEN 0.01 WHEN CAST(fp AS DOUBLE) / (tp + fp) < 0.05 THEN -0.02 ELSE 0.0 END AS DOUBLE) AS change FROM c WHERE tp + fp + fn + tn >= 10")
def p21(spark, d, least: int = 10) -> DataFrame:
    """Advice for groups with enough feedback only."""
    rate = ratio(F.col("fp"), F.col("tp") + F.col("fp"))
    change = F.when(F.col("tp") + F.col("fp") == 0, 0.0).when(rate > 0.3, 0.03).when(rate > 0.15, 0.01).when(rate < 0.05, -0.02).otherwise(0.0)
    return feedback(spark, d).filter(F.col("n") >= least).select("mode", F.round(rate, 6).alias("fp_rate"), change.alias("change"))


@query("p22_review_stats", "SELECT lang, count(*) AS total, count(*) FILTER (WHERE quality IS NOT NULL) AS reviewed, count(*) FILTER (WHERE quality = 1) AS approved, count(*) FILTER (WHERE quality = 0) AS rejected, round(CASE WHEN count(quality) = 0 THEN 0 ELSE avg(CASE WHEN quality IS NULL THEN NULL WHEN (quality = 1) = (toxic = 0) THEN 1.0 ELSE 0.0 END) END, 6) AS agreement FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def p22(spark, d) -> DataFrame:
    """Review items by type and status, and how often the two reviewers agree."""
    j = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id", "left")
    same = F.when(F.col("quality").isNotNull(), F.when((F.col("quality") == 1) == (F.col("toxic") == 0), 1.0).otherwise(0.0))
    return j.groupBy("lang").agg(F.count("*").alias("total"), F.count("quality").alias("reviewed"), F.count_if(F.col("quality") == 1).alias("approved"), F.count_if(F.col("quality") == 0).alias("rejected"), F.round(F.coalesce(F.avg(same), F.lit(0.0)), 6).alias("agreement"))


_WS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
_DRIFT = f"""w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS base FROM conversations), s AS (SELECT *, {_WS.format(c='text')} AS a, {_WS.format(c='base')} AS b, length(text) AS ms, length(base) AS ms0, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS t, CASE WHEN length(base) = 0 THEN 0 ELSE greatest(1, length(base) // 4) END AS t0 FROM w WHERE base IS NOT NULL),
m AS (SELECT *, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END AS sim, ms0 > 0 AND abs(ms - ms0) / ms0 > 0.5 AS slow, t0 > 0 AND abs(t - t0) / t0 > 0.3 AS dear FROM s),
r AS (SELECT conv_id, turn, CASE WHEN sim < 0.7 THEN 'semantic' WHEN slow OR dear THEN 'performance' END AS kind, greatest(CASE WHEN sim < 0.3 THEN 4 WHEN sim < 0.5 THEN 3 WHEN sim < 0.6 THEN 2 WHEN sim < 0.7 THEN 1 ELSE 0 END, CASE WHEN slow AND ms > ms0 THEN 2 ELSE 0 END) AS severity FROM m)"""


def drift(t: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, severity) of each answer against the one before of its role: wording, then time (its length) or tokens. Severity is 0 none to 4 critical."""
    before = F.lag("text").over(W.partitionBy("conv_id", "role").orderBy("turn"))
    s = t.withColumn("base", before).filter("base is not null").withColumns({"sim": jaccard(words(F.col("text")), words(F.col("base"))), "ms": F.length("text"), "ms0": F.length("base"), "t": token_estimate(F.col("text")), "t0": token_estimate(F.col("base"))})
    changed = lambda a, b, most: (F.col(b) > 0) & (F.abs(F.col(a) - F.col(b)) / F.greatest(F.col(b), F.lit(1)) > most)
    slow, dear, sim = changed("ms", "ms0", 0.5), changed("t", "t0", 0.3), F.col("sim")
    worded = F.when(sim < 0.3, 4).when(sim < 0.5, 3).when(sim < 0.6, 2).when(sim < 0.7, 1).otherwise(0)
    return s.select("conv_id", "turn", F.when(sim < 0.7, "semantic").when(slow | dear, "performance").alias("kind"), F.greatest(worded, F.when(slow & (F.col("ms") > F.col("ms0")), 2).otherwise(0)).alias("severity"))


@query("r1_drift", f"WITH {_DRIFT} SELECT * FROM r")
def r1(spark, d) -> DataFrame:
    return drift(turns(spark, d))


@query("r2_drift_rate", f"WITH {_DRIFT} SELECT coalesce(kind, 'none') AS kind, severity, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY 1, 2")
def r2(spark, d) -> DataFrame:
    c = drift(turns(spark, d)).groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "severity").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 6))  # a row for each kind and severity


@query("r4_version_changes", f"WITH {SPANS}, v AS (SELECT span_id, k // 50 AS version, lag(k // 50) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS before FROM spans WHERE k IS NOT NULL) SELECT span_id, before, version FROM v WHERE before <> version")
def r4(spark, d) -> DataFrame:
    v = spans(spark, d).filter("k is not null").withColumn("version", F.floor(F.col("k") / 50).cast("int"))
    return v.withColumn("before", F.lag("version").over(order())).filter("before <> version").select("span_id", "before", "version")


@query("r7_before_and_after", f"""WITH {SPANS}, a AS (SELECT trace_id, name, max(k) AS k FROM spans WHERE start_time < TIMESTAMP '2024-01-15' AND k IS NOT NULL GROUP BY 1, 2), b AS (SELECT trace_id, name, max(k) AS k FROM spans WHERE start_time >= TIMESTAMP '2024-01-15' AND k IS NOT NULL GROUP BY 1, 2), j AS (SELECT coalesce(a.trace_id, b.trace_id) AS trace_id, coalesce(a.k, 0) AS x, coalesce(b.k, 0) AS y FROM a FULL JOIN b ON a.trace_id = b.trace_id AND a.name = b.name)
SELECT trace_id, count(*) FILTER (WHERE x > 0 AND y = 0) AS fixed, count(*) FILTER (WHERE y > 0 AND y < x) AS improved, count(*) FILTER (WHERE y > x) AS regressed, count(*) FILTER (WHERE x = y) AS unchanged FROM j GROUP BY 1""")
def r7(spark, d) -> DataFrame:
    """Detectors of each trace that are fixed, better, worse or the same in the second half; both halves come from one aggregate."""
    first = F.col("start_time") < F.lit("2024-01-15").cast("timestamp")
    j = spans(spark, d).filter("k is not null").groupBy("trace_id", "name").agg(F.coalesce(F.max(F.when(first, F.col("k"))), F.lit(0)).alias("x"), F.coalesce(F.max(F.when(~first, F.col("k"))), F.lit(0)).alias("y"))
    x, y = F.col("x"), F.col("y")
    return j.groupBy("trace_id").agg(F.count_if((x > 0) & (y == 0)).alias("fixed"), F.count_if((y > 0) & (y < x)).alias("improved"), F.count_if(y > x).alias("regressed"), F.count_if(x == y).alias("unchanged"))


@query("r11_scenario_coverage", f"WITH {PREDICTIONS} SELECT mode, count(*) FILTER (WHERE truth) AS scenarios, count(*) FILTER (WHERE truth AND detected) AS caught, count(*) FILTER (WHERE truth) > 0 AND count(*) FILTER (WHERE truth AND detected) >= 0.7 * count(*) FILTER (WHERE truth) AS passed FROM predictions GROUP BY 1")
def r11(spark, d, least: float = 0.7) -> DataFrame:
    n, hit = F.count_if("truth"), F.count_if(F.col("truth") & F.col("detected"))
    return predictions(spark, d).groupBy("mode").agg(n.alias("scenarios"), hit.alias("caught"), ((n > 0) & (hit >= least * n)).alias("passed"))


def tier(confidence: Column, gray: tuple[float, float] = (0.35, 0.65)) -> Column:
    """Which judge a finding goes to: rules alone outside the gray zone, a cheap model near its edges, a dear one inside, a person at its middle."""
    low, high = gray
    middle = (low + high) / 2
    off = F.abs(confidence - middle)
    return F.when((confidence < low) | (confidence > high), "rules").when(off > 0.1, "cheap").when(off > 0.02, "expensive").otherwise("human")


@query("s1_tiers", f"WITH {PREDICTIONS} SELECT record_id, CASE WHEN confidence < 0.35 OR confidence > 0.65 THEN 'rules' WHEN abs(confidence - 0.5) > 0.1 THEN 'cheap' WHEN abs(confidence - 0.5) > 0.02 THEN 'expensive' ELSE 'human' END AS tier FROM predictions")
def s1(spark, d) -> DataFrame:
    return predictions(spark, d).select("record_id", tier(F.col("confidence")).alias("tier"))
