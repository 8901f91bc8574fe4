"""Connected components of an edge table by contraction, with joins only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by pointer
    jumping, and replaces the ends of each edge by their roots; edges inside a root vanish. Local
    minima alone survive a round, so a chain takes a logarithmic number of rounds.
    Loops and repeated edges do no harm; edges with a null end are left out; no edges give no rows.
    """

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    edges = edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct()
    left = scratch.keep(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    roots = None
    while not left.isEmpty():
        up = scratch.keep(left.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("root")), "hooks")
        while True:
            # The ends of roots, a row each, so that the nodes of a large component need not meet in one task.
            end = up.select("root").distinct().join(up.select(F.col("node").alias("root"), F.col("root").alias("further")), "root")
            end = scratch.keep(end, "ends")
            jumped = scratch.keep(up.join(small(end), "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "jump")
            still = jumped.filter("moved").isEmpty()
            scratch.drop(up, end)
            up = jumped
            if still:
                break
        step = up.select("node", "root")
        if roots is None:
            found = step
        else:
            found = roots.withColumnRenamed("root", "via").join(step.select(F.col("node").alias("via"), "root"), "via", "left").select("node", F.coalesce("root", "via").alias("root"))
        kept = scratch.keep(found, "roots")
        names = step.select(F.col("node"), F.col("root"))
        moved = left.join(names.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(names.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        following = scratch.keep(moved.filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "edges")
        scratch.drop(left, up, *([roots] if roots is not None else []))
        roots, left = kept, following
    if roots is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
