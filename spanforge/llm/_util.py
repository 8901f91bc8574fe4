"""Helpers the operators share: written tables in the cluster's shared folder, and row-size checks."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few short columns may be broadcast (a few tens of MB).
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local session without one (tests) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "spanforge-checkpoints")


class Scratch:
    """Tables written once under the shared folder, so that lineage is cut and lost executors cost no recomputation.

    ``keep`` writes and rereads a table; ``drop`` deletes those that no later result reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        self.kept: list[tuple[DataFrame, str]] = []  # the frames themselves, so that no other can pass for them

    def keep(self, df: DataFrame, tag: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{tag}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone = [(df, path) for df, path in self.kept if any(df is f for f in frames)]
        self.kept = [(df, path) for df, path in self.kept if not any(df is f for f in frames)]
        for _, path in gone:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def pieces(batches, rows: int = 512):
    """Arrow batches in pieces, so that a task's Python side holds little at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(df: DataFrame, name: str) -> int:
    """The place of a column: that of exactly this name, else of one that differs by case only."""
    names = df.columns
    if name in names:
        return names.index(name)
    return [n.lower() for n in names].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ... in place of its own names, which may clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def columns_once(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by their places, also where others have names that differ by case only."""
    return numbered(df).select(*[F.col(f"c{position(df, n)}").alias(n) for n in names])
