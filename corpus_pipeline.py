"""The corpus pipeline: toxic documents go, shared lines go, near-copies go, sources are mixed, sequences are packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Only the columns of
documents are read, by their exact names where others differ by case; an empty table goes through as one.
Repeated rows are treated alike, and texts of any length whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import linededup, minhash, mixing, packing, toxicity
from spanforge.llm._util import Scratch, columns_once, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. Null and empty texts have the rate of toxic training texts for a score."""
    return toxicity.keep_clean(columns_once(docs, *COLUMNS), table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text. A null text becomes an empty one."""
    clean = linededup.dedup_lines(columns_once(docs, *COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-copies. Those without words stay, and so does a group without any id; rows that repeat the kept id and text stay with it."""
    return minhash.keep_one(columns_once(docs, *COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole; a null source is a source of its own, and documents without words are taken like the others of their source."""
    return mixing.mix(columns_once(docs, *COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences; an empty or null text is the single end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Toxicity and packing have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        kept = scratch.keep(out, name.replace(" ", "-"))
        scratch.drop(docs)
        docs = kept
