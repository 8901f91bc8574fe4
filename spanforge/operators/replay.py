"""Replayed outputs against original ones: likeness by matching blocks, what changed, and near-equal turns."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import compared_texts, counted_texts, sequence_ratio
from ..plans.registry import query
from ..sources.adapters import states, turns

#: Likeness of identical, minor, moderate and major differences; of contents that count as the same.
GRADES = ((0.99, "identical"), (0.90, "minor"), (0.70, "moderate"), (0.3, "major"))
SAME_CONTENT = 0.9


def compare_texts(df: DataFrame, original: str = "original", replay: str = "replay", *, counts: bool = False) -> DataFrame:
    """``df`` with similarity, difference (a grade), segments, inserted, deleted, changed_lines.

    Segments are the edits that turn the original into the replay: replace, delete, insert, with their position in the
    original. ``inserted`` and ``deleted`` count characters of pure insertions and deletions. Lines are compared place by place.
    Null texts count as empty; two empty texts are identical, an empty and another are completely different. With ``counts``, n_segments
    comes in place of segments and of what follows from them, and they are not built.
    """
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in (original, replay))
    grade = F.when(a == b, "identical")
    out = df.withColumn("compared_", (counted_texts if counts else compared_texts)(F.col(original), F.col(replay)))
    for least, name in GRADES:
        grade = grade.when(F.col("compared_.likeness") >= least, name)
    if counts:
        return out.select(*df.columns, F.col("compared_.likeness").alias("similarity"), grade.otherwise("completely_different").alias("difference"), F.col("compared_.n_segments").alias("n_segments"))
    lines = F.arrays_zip(F.split(a, "\n", -1).alias("a"), F.split(b, "\n", -1).alias("b"))
    chars = lambda kind, side: F.aggregate(F.filter("compared_.segments", lambda s: s["kind"] == kind), F.lit(0), lambda n, s: n + F.length(s[side])).cast("long")
    return out.select(
        *df.columns, F.col("compared_.likeness").alias("similarity"), grade.otherwise("completely_different").alias("difference"), F.col("compared_.segments").alias("segments"),
        chars("insert", "replay").alias("inserted"), chars("delete", "original").alias("deleted"), F.size(F.filter(lines, lambda x: ~x["a"].eqNullSafe(x["b"]))).cast("long").alias("changed_lines"),
    )


def _met(path: str, a: str, b: str, depth: int, level: int = 1) -> str:
    """(path, a, b) of the members of two objects, of which one may be null; those that are objects on both sides are opened."""
    m, e = f"m{level}", f"e{level}"
    members = "try_variant_get({0}, '$', 'map<string,variant>')".format
    key, x, y = f"concat_ws('.', {path}, {e}.key)", f"{e}.value.a", f"{e}.value.b"
    leaf = f"array(struct({key} as path, {x} as a, {y} as b))"
    each = leaf if level == depth else f"if({members(x)} is not null and {members(y)} is not null, {_met(key, x, y, depth, level + 1)}, {leaf})"
    none = "cast(map() as map<string,variant>)"
    both = f"map_zip_with(coalesce({members(a)}, {none}), coalesce({members(b)}, {none}), (k{level}, {m}a, {m}b) -> struct({m}a as a, {m}b as b))"
    return f"flatten(transform(map_entries({both}), {e} -> {each}))"


def compare_objects(df: DataFrame, *keys: str, original: str = "original", replay: str = "replay", depth: int = 8, counts: bool = False) -> DataFrame:
    """(keys, path) and the columns of ``compare_texts`` for each member of two JSON objects, members of objects by path; a member that one side lacks, null, false, 0 and [] are empty texts.

    Members that are objects on both sides are opened, ``depth`` levels deep; others are compared as text: strings as they are, the rest
    as JSON. An object that is none on the other side is compared whole. Texts that are no JSON objects have no members.
    """
    # All levels within a row: members meet by name where both sides are objects (at first, where one is), and only what is left becomes rows.
    s = df.select(*keys, F.try_parse_json(original).alias("a"), F.try_parse_json(replay).alias("b"))
    done = s.select(*keys, F.explode(F.expr(_met("cast(null as string)", "a", "b", depth))).alias("x")).select(*keys, "x.path", "x.a", "x.b")
    empty = ("null", "false", "0", "0.0", "[]", "{}")
    text = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.expr(f"try_variant_get({c}, '$', 'string')")).when(F.coalesce(F.to_json(c).isin(*empty), F.lit(True)), "").otherwise(F.to_json(c))
    return compare_texts(done.select(*keys, "path", text("a").alias("original"), text("b").alias("replay")), counts=counts)


def repeated_contents(t: DataFrame, least: float = SAME_CONTENT) -> DataFrame:
    """(conv_id, turn, similarity): turns whose text is like that of the same role's turn before."""
    w = W.partitionBy("conv_id", "role").orderBy("turn")
    p = t.withColumn("before", F.lag("text").over(w)).filter("before is not null and text is not null")
    # The quick bound by lengths: blocks match the shorter text at most.
    n, m = F.length("text"), F.length("before")
    p = p.filter((2 * F.least(n, m) > least * (n + m)) | (F.col("text") == F.col("before"))).withColumn("similarity", sequence_ratio(F.col("before"), F.col("text")))
    return p.filter(F.col("similarity") > least).select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@query("h25_repeated_contents")
def h25(spark, d) -> DataFrame:
    return repeated_contents(turns(spark, d))


@query("h25_turn_likeness")
def h25_likeness(spark, d) -> DataFrame:
    """The likeness of each turn to the one before it."""
    t = turns(spark, d).withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).filter("before is not null")
    return t.select("conv_id", "turn", F.round(sequence_ratio(F.col("before"), F.col("text")), 6).alias("similarity"))


@query("r5_text_diff")
def r5(spark, d) -> DataFrame:
    """Each turn of a role as a replay of that role's turn before."""
    w = W.partitionBy("conv_id", "role").orderBy("turn")
    t = turns(spark, d).withColumn("original", F.lag("text").over(w)).filter("original is not null").withColumnRenamed("text", "replay")
    c = compare_texts(t)
    return c.select("conv_id", "turn", F.round("similarity", 6).alias("similarity"), "difference", F.size("segments").cast("long").alias("n_segments"), "inserted", "deleted", "changed_lines")


@query("r5_object_diff")
def r5_objects(spark, d) -> DataFrame:
    """Each state of a trace as a replay of the state before it, member by member."""
    s = states(spark, d).withColumn("original", F.lag("state").over(W.partitionBy("trace_id").orderBy("step"))).filter("original is not null").withColumnRenamed("state", "replay")
    c = compare_objects(s, "trace_id", "step", counts=True)
    return c.select("trace_id", "step", "path", F.round("similarity", 6).alias("similarity"), "difference", "n_segments")
