"""Evaluation of predictions against labels: confusion, aggregates, calibration, thresholds, agreement, splits."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..plans.registry import query
from ..sources.adapters import PREDICTIONS, predictions, read


def confusion(p: DataFrame, *by: str) -> DataFrame:
    n = lambda a, b: F.count_if((F.col("detected") == a) & (F.col("truth") == b))
    return p.groupBy(*by).agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))


def scores(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    r = lambda a, b: F.round(ratio(a, b), 6)
    return c.withColumns({"precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "f1": r(2 * tp, 2 * tp + fp + fn), "accuracy": r(tp + tn, tp + fp + fn + tn), "specificity": r(tn, tn + fp)})


CONFUSION = f"""WITH {PREDICTIONS}, c AS (SELECT mode, count(*) FILTER (WHERE detected AND truth) AS tp, count(*) FILTER (WHERE detected AND NOT truth) AS fp, count(*) FILTER (WHERE NOT detected AND truth) AS fn, count(*) FILTER (WHERE NOT detected AND NOT truth) AS tn FROM predictions GROUP BY 1)"""
_R = "round(CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 6)"


def _r(a: str, b: str) -> str:
    return _R.format(a=f"({a})", b=f"({b})")


@query("d10_confusion", f"{CONFUSION} SELECT * FROM c")
def d10(spark, d) -> DataFrame:
    return confusion(predictions(spark, d), "mode")


@query("p1_mode_scores", f"{CONFUSION} SELECT *, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall, {_r('2 * tp', '2 * tp + fp + fn')} AS f1, {_r('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_r('tn', 'tn + fp')} AS specificity FROM c")
def p1(spark, d) -> DataFrame:
    return scores(confusion(predictions(spark, d), "mode"))


@query("p2_aggregate_f1", f"""{CONFUSION}, f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1, tp + fn AS support FROM c)
SELECT round(avg(f1), 6) AS macro_f1, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""")
def p2(spark, d) -> DataFrame:
    f = confusion(predictions(spark, d), "mode").withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("support", F.col("tp") + F.col("fn"))
    total = F.sum("tp")
    return f.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(ratio(2 * total, 2 * total + F.sum("fp") + F.sum("fn")), 6).alias("micro_f1"), F.round(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 6).alias("weighted_f1"))


def calibration(p: DataFrame, bins: int, drop_one: bool = False, midpoint: bool = False) -> DataFrame:
    """Expected calibration error: gaps between confidence and the rate of right verdicts, weighted by bin size."""
    right = F.when(F.col("detected") == F.col("truth"), 1.0).otherwise(0.0)
    if drop_one:
        p = p.filter("confidence < 1")
    b = p.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(right).alias("a"))
    level = (F.col("bin") + 0.5) / bins if midpoint else F.col("c")
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - level)) / F.sum("n"), 6).alias("ece"))


def _ece(bins: int, where: str, level: str) -> str:
    return f"""WITH {PREDICTIONS}, b AS (SELECT least(floor(confidence * {bins}), {bins - 1}) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN detected = truth THEN 1.0 ELSE 0.0 END) AS a FROM predictions {where} GROUP BY 1) SELECT round(sum(n * abs(a - {level})) / sum(n), 6) AS ece FROM b"""


@query("p3_ece_mean", _ece(10, "", "c"))
def p3(spark, d) -> DataFrame:
    return calibration(predictions(spark, d), 10)


@query("p4_ece_midpoint", _ece(10, "", "(bin + 0.5) / 10"))
def p4(spark, d) -> DataFrame:
    return calibration(predictions(spark, d), 10, midpoint=True)


@query("p5_ece_five_bins", _ece(5, "WHERE confidence < 1", "c"))
def p5(spark, d) -> DataFrame:
    return calibration(predictions(spark, d), 5, drop_one=True)


GRID = [x / 100 for x in range(5, 100, 5)]


def best_threshold(p: DataFrame) -> DataFrame:
    """The threshold with the largest F1, the lowest of equals. Counts are summed per step of the grid, then cumulated."""
    above = F.size(F.filter(F.array(*[F.lit(x) for x in GRID]), lambda t: F.col("confidence") > t))
    steps = p.groupBy(above.alias("above")).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    grid = p.sparkSession.createDataFrame(list(enumerate(GRID, 1)), "i int, threshold double")
    c = grid.join(F.broadcast(steps)).groupBy("i", "threshold").agg(F.sum(F.when(F.col("above") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("above") >= F.col("i"), F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("all"))
    f1 = F.round(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all")), 6)
    return c.withColumn("f1", f1).orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


@query("p6_best_threshold", f"""WITH {PREDICTIONS}, g AS (SELECT CAST(x AS DOUBLE) / 100 AS threshold FROM generate_series(5, 95, 5) t(x)), c AS (SELECT threshold, count(*) FILTER (WHERE confidence > threshold AND truth) AS tp, count(*) FILTER (WHERE confidence > threshold AND NOT truth) AS fp, count(*) FILTER (WHERE truth) AS pos FROM g, predictions GROUP BY 1)
SELECT threshold, {_r('2 * tp', 'tp + fp + pos')} AS f1 FROM c ORDER BY f1 DESC, threshold LIMIT 1""")
def p6(spark, d) -> DataFrame:
    return best_threshold(predictions(spark, d))


@query("p22_agreement", f"""WITH {PREDICTIONS}, m AS (SELECT mode, count(*) AS n, avg(CASE WHEN detected = truth THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN truth THEN 1.0 ELSE 0.0 END) AS b FROM predictions GROUP BY 1)
SELECT mode, n, round(po, 6) AS agreement, round(CASE WHEN a * b + (1 - a) * (1 - b) = 1 THEN 0 ELSE (po - a * b - (1 - a) * (1 - b)) / (1 - a * b - (1 - a) * (1 - b)) END, 6) AS kappa FROM m""")
def p22(spark, d) -> DataFrame:
    yes = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    m = predictions(spark, d).groupBy("mode").agg(F.count("*").alias("n"), yes(F.col("detected") == F.col("truth")).alias("po"), yes(F.col("detected")).alias("a"), yes(F.col("truth")).alias("b"))
    chance = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return m.select("mode", "n", F.round("po", 6).alias("agreement"), F.round(ratio(F.col("po") - chance, 1 - chance), 6).alias("kappa"))


@query("p21_threshold_advice", f"{CONFUSION} SELECT mode, {_r('fp', 'tp + fp')} AS fp_rate, CAST(CASE WHEN tp + fp = 0 THEN 0.0 WHEN CAST(fp AS DOUBLE) / (tp + fp) > 0.3 THEN 0.03 WHEN CAST(fp AS DOUBLE) / (tp + fp) > 0.15 THEN 0.01 WHEN CAST(fp AS DOUBLE) / (tp + fp) < 0.05 THEN -0.02 ELSE 0.0 END AS DOUBLE) AS change FROM c")
def p21(spark, d) -> DataFrame:
    rate = ratio(F.col("fp"), F.col("tp") + F.col("fp"))
    change = F.when(F.col("tp") + F.col("fp") == 0, 0.0).when(rate > 0.3, 0.03).when(rate > 0.15, 0.01).when(rate < 0.05, -0.02).otherwise(0.0)
    return confusion(predictions(spark, d), "mode").select("mode", F.round(rate, 6).alias("fp_rate"), change.alias("change"))


@query("q5_phi", """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS n11, count(*) FILTER (WHERE toxic = 1) AS a, count(*) FILTER (WHERE quality = 1) AS b FROM labels)
SELECT round((CAST(n AS DOUBLE) * n11 - CAST(a AS DOUBLE) * b) / sqrt(CAST(a AS DOUBLE) * b * (n - a) * (n - b)), 6) AS phi FROM c""")
def q5(spark, d) -> DataFrame:
    a, b = F.col("toxic") == 1, F.col("quality") == 1
    c = read(spark, d, "labels").agg(F.count("*").cast("double").alias("n"), F.count_if(a & b).cast("double").alias("n11"), F.count_if(a).cast("double").alias("a"), F.count_if(b).cast("double").alias("b"))
    return c.select(F.round((F.col("n") * F.col("n11") - F.col("a") * F.col("b")) / F.sqrt(F.col("a") * F.col("b") * (F.col("n") - F.col("a")) * (F.col("n") - F.col("b"))), 6).alias("phi"))


@query("q9_assign_splits", """WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, CASE WHEN i <= greatest(1, round_even(n * 0.7, 0)) THEN 'train' WHEN i <= greatest(1, round_even(n * 0.7, 0)) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM r""")
def q9(spark, d) -> DataFrame:
    """Of each label the first 70 % by hash train, the next 15 % validate, the rest test.

    Labels are counted by the hash's first digits; whole buckets fall on one side of both cuts but for the two that the
    cuts lie in, and only rows of these are put in order.
    """
    r = read(spark, d, "labels").select("doc_id", "toxic", F.md5(F.col("doc_id").cast("string")).alias("h")).withColumn("digits", F.substring("h", 1, 3))
    label = W.partitionBy("toxic")
    b = r.groupBy("toxic", "digits").agg(F.count("*").alias("c")).withColumns({"upto": F.sum("c").over(label.orderBy("digits")), "n": F.sum("c").over(label)})
    train, val = F.greatest(F.lit(1.0), F.bround(F.col("n") * 0.7, 0)), F.bround(F.col("n") * 0.15, 0)
    b = b.select(F.col("toxic").alias("of"), F.col("digits").alias("at"), (F.col("upto") - F.col("c")).alias("before"), "upto", train.alias("train"), (train + val).alias("val"))
    j = r.join(F.broadcast(b), F.col("toxic").eqNullSafe(F.col("of")) & (F.col("digits") == F.col("at")))  # at most 4096 rows a label
    split = lambda first, last: F.when(last <= F.col("train"), "train").when((first > F.col("train")) & (last <= F.col("val")), "val").when(first > F.col("val"), "test")
    whole = j.withColumn("split", split(F.col("before") + 1, F.col("upto")))
    i = F.col("before") + F.row_number().over(W.partitionBy("toxic", "digits").orderBy("h", "doc_id"))
    cut = whole.filter("split is null").withColumn("i", i).select("doc_id", split(F.col("i"), F.col("i")).alias("split"))
    return whole.filter("split is not null").select("doc_id", "split").unionByName(cut)


@query("q19_drift_report", f"""WITH {PREDICTIONS} SELECT mode, count(*) AS n, round(avg(CASE WHEN detected = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy, avg(CASE WHEN detected = truth THEN 1.0 ELSE 0.0 END) < 0.7 AS drifted FROM predictions GROUP BY 1 HAVING count(*) >= 5""")
def q19(spark, d) -> DataFrame:
    a = F.avg(F.when(F.col("detected") == F.col("truth"), 1.0).otherwise(0.0))
    return predictions(spark, d).groupBy("mode").agg(F.count("*").alias("n"), F.round(a, 6).alias("accuracy"), (a < 0.7).alias("drifted")).filter("n >= 5")
