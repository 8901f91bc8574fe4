"""Mixing sources to target weights (9): hash-threshold histograms, by DataFrame functions only.

A document's hash places it on a line; a source takes the documents up to a threshold. Sizes are
summed by source and leading hash bits, the bucket that the budget ends in is found for all sources
at once, and only rows of those buckets are summed by their next bits. No row is sorted.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import Scratch, columns_once, numbered, position, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Hash bits that a round of refinement resolves, and rounds before the full hash is taken.
BITS, ROUNDS = 10, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text) with the hash that places the row; equal rows share a place."""
    slim = columns_once(docs, "doc_id", "source", "text")
    return slim.withColumn("at", F.xxhash64(F.lit("mix"), "doc_id", "text"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from one row a source, with capped shares filled in closed form.

    In order of the cap for each unit of weight, the level that the uncapped sources would share is the
    rest of the budget over the rest of the weight; the first source whose cap reaches it ends the capped ones.
    """
    by_code = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / weight_left)
    ends = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)
    level = F.coalesce(ends["level"], F.lit(float("inf")))
    return levels.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def thresholds(placed: DataFrame, scratch: Scratch, **params) -> DataFrame:
    """(source, source_size, target, copies, last): rows at or below ``last`` are taken once more than ``copies``.

    ``placed`` has (source, size, at). A group of equal rows at the boundary goes in whole if that is
    nearer the target. No rows give no thresholds.
    """
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, **params).withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = scratch.keep(goal.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))), "goal")
    edge, rows = goal.select("source", "budget", F.lit(None).cast("long").alias("prefix")), placed
    upto = W.partitionBy("source").orderBy("cell")
    for k in range(1, ROUNDS + 2):
        cell = F.shiftright("at", max(0, 64 - BITS * k)) if k <= ROUNDS else F.col("at")
        sums = rows.withColumn("cell", cell).groupBy("source", "cell").agg(F.sum("size").alias("held"))
        cum = sums.withColumn("cum", F.sum("held").over(upto)).join(edge.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        over = cum.filter(F.col("cum") > F.col("budget")).groupBy("source").agg(F.min_by(F.struct("cell", "cum", "held", "budget"), "cell").alias("x"))
        found = over.select("source", (F.col("x.budget") - F.col("x.cum") + F.col("x.held")).alias("budget"), F.col("x.cell").alias("prefix"), F.col("x.held").alias("held"))
        edge = scratch.keep(found, "edge")
        if k <= ROUNDS:
            ends = edge.select(F.col("source").alias("of"), "prefix")
            inside = rows.join(ends, F.col("source").eqNullSafe(F.col("of")) & (cell == F.col("prefix"))).select("source", "size", "at")
            rows = scratch.keep(inside, "inside")
            edge = edge.select("source", "budget", "prefix")
    last = edge.select(F.col("source").alias("of"), F.when(F.col("held") - F.col("budget") < F.col("budget"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("last"))
    # A source that no cell takes over its budget (budget met by all its rows, or no rows) takes every row or none.
    rest = F.when(F.col("budget") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63)))
    return scratch.keep(goal.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "copies", F.coalesce("last", rest).alias("last")), "thresholds")


def taken_copies(most: float) -> Column:
    return F.least(F.col("copies") + (F.col("at") <= F.col("last")).cast("int"), F.lit(int(most))).cast("long")


def mix_sizes(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of ``docs``.

    Sizes count words; a null text has none. A null source is a source of its own, the last. Repeated
    rows are taken alike. Only doc_id, source and text are read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    placed = scratch.keep(place(docs).select("doc_id", "source", word_count(F.col("text")).alias("size"), "at"), "placed")
    ends = thresholds(placed.select("source", "size", "at"), scratch, **params).withColumnRenamed("source", "of")
    joined = placed.join(ends, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * taken_copies(params.get("most", MOST_COPIES))).alias("taken"))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, with the columns of ``docs``, whatever their names.

    A null text has no words and a null source is a source of its own, as in ``mix_sizes``; equal rows are
    taken alike. A source without words takes none of its rows. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    placed = scratch.keep(place(docs).select("source", word_count(F.col("text")).alias("size"), "at"), "placed")
    ends = thresholds(placed, scratch, **params).select(F.col("source").alias("of"), "copies", "last")
    doc_id, text, source = (F.col(f"c{position(docs, n)}") for n in ("doc_id", "text", "source"))
    joined = numbered(docs).withColumn("at", F.xxhash64(F.lit("mix"), doc_id, text)).join(ends, source.eqNullSafe(F.col("of")))
    taken = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), taken_copies(params.get("most", MOST_COPIES)).cast("int"))))
    return taken.drop("of", "copies", "last", "at", "copy").toDF(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))
