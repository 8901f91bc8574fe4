"""Secret scans (7): corpus-wide ownership frequency, by DataFrame functions only.

Every candidate's value is hashed and the distinct repositories and owners that hold it are counted over
the whole corpus. A value that many owners hold, or many repositories of more than one owner, is a copied
example; any other that looks random is an owner's own credential, in however many of its repositories it
stands. Base spans always stay; candidates of further formats are added if they are an owner's own. A private
key's value is its whole block, without line breaks.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, Scratch, columns_once, table
from .spans import joined, with_spans

KINDS = ("assign", "access", "hex", "token", "key")
#: From so many owners on, or repositories of several owners, a value counts as copied.
COPIED_OWNERS, COPIED_REPOS = 3, 10
#: Distinct characters that a live-looking value has at least.
LIVE_DISTINCT = 8

BASE = {
    "assign": r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]++",
}
#: Prefixes of public credential formats.
MORE = {
    "token": r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
    # The block up to its end; without an end the header and the lines of base64 that follow it. Line breaks may be written as \n.
    "key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[^-]++|-(?!----)){0,200}+-----END [A-Z ]{0,30}PRIVATE KEY-----|(?:(?:\s|\\[nr]){0,8}+[A-Za-z0-9+/=]{16,}+){0,400}+)",
}
_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"


def found(docs: DataFrame) -> DataFrame:
    """``docs`` (with text t) and spans: array of (s, kind, e, v), v the secret itself, in order of start and kind."""
    t = F.col("t")
    gate = {"assign": t.contains("=") | t.contains(":"), "access": t.contains("AKIA"), "hex": t.rlike("[0-9a-f]{32}"), "token": t.rlike("gh[pousr]_|xox[abprs]-|sk-|eyJ"), "key": t.contains("PRIVATE KEY-----")}
    # Shorter runs of hex digits fail in any case; asking for the length in the pattern keeps the run whole.
    patterns = BASE | MORE | {"hex": r"(?:\G|(?<![0-9a-f]))[0-9a-f]{32,}+"}
    each = with_spans(docs, "t", {k: (p, gate[k]) for k, p in patterns.items()})
    value = {k: (lambda v: v) for k in KINDS} | {"assign": lambda v: F.regexp_extract(v, _VALUE, 1), "key": lambda v: F.regexp_replace(v, r"\s|\\[nr]", "")}
    least = {"assign": 8, "access": 16, "hex": 32, "token": 1, "key": 1}

    def long_enough(i: int, k: str) -> Column:
        marked = F.transform(f"spans_{k}", lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("kind"), x["e"].alias("e"), value[k](x["v"]).alias("v")))
        return F.filter(marked, lambda x: F.length(x["v"]) >= least[k])

    rows = [long_enough(i, k) for i, k in enumerate(KINDS)]
    return each.withColumn("spans", F.array_sort(F.concat(*rows))).drop(*[f"spans_{k}" for k in KINDS])


def live_looking(v: Column) -> Column:
    return (F.size(F.array_distinct(F.split(v, ""))) >= LIVE_DISTINCT) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")


def ownership(candidates: DataFrame) -> DataFrame:
    """(h1, h2, owners, repos) from (h1, h2, owner, repo): distinct holders, counted in two steps so that no value's holders meet in one task."""
    by_repo = candidates.groupBy("h1", "h2", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("h1", "h2", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("h1", "h2").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def secret_spans(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied), a row for each row of ``docs``.

    n_copied counts spans whose value many owners hold, or many repositories of several; n_live the others
    that look random. A null text is an empty one; a null repository or owner counts as one of its own.
    Repeated rows give repeated results and count once; an empty table gives an empty result. Only
    doc_id, text and the two named columns are read.
    """
    scratch = Scratch(docs.sparkSession, "secretscan")
    slim = columns_once(docs, *dict.fromkeys(["doc_id", "text", repo, owner])).select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.col(repo).alias("repo"), F.col(owner).alias("owner"))
    hashed = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), F.xxhash64(x["v"]).alias("h1"), F.xxhash64(F.lit("two"), x["v"]).alias("h2"), live_looking(x["v"]).alias("live")))
    rows = scratch.keep(found(slim).select("doc_id", "repo", "owner", hashed.alias("spans"), F.monotonically_increasing_id().alias("row")), "rows")
    each = rows.filter(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("x")).select("row", "repo", "owner", "x.*")
    # Few values have more than one holder; the others need no row, and a value that is everywhere meets no single task.
    held = scratch.keep(ownership(each.select("h1", "h2", "owner", "repo")).filter("owners > 1"), "held")
    held = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    copied = (F.col("owners") >= COPIED_OWNERS) | ((F.col("owners") > 1) & (F.col("repos") >= COPIED_REPOS))
    judged = each.join(held, ["h1", "h2"], "left").withColumn("copied", F.coalesce(copied, F.lit(False))).withColumn("own", ~F.col("copied") & F.col("live"))
    base = len(BASE)
    kept = judged.filter((F.col("kind") < base) | F.col("own") | ((F.col("kind") == KINDS.index("key")) & ~F.col("copied")))
    per = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "kind", "e"))).alias("all"), F.sum(F.col("own").cast("long")).alias("n_live"), F.sum(F.col("copied").cast("long")).alias("n_copied")).withColumnRenamed("row", "of")
    out = rows.join(per, F.col("row") == F.col("of"), "left")
    own = F.filter("spans", lambda x: x["kind"] < base)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(joined(own, KINDS), 256).alias("base_sha256"), F.coalesce(joined(F.col("all"), KINDS), F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
