"""PII (6): candidate gradient boosting, by DataFrame functions and MLlib.

High-recall generators propose overlapping spans. Boosted trees judge a span by its format and its context.
They learn on the candidates of all texts: a base candidate is real if it passes its check (a check digit, a
number's range or length, an address's last part), a generated one if it overlaps such a span of its own kind,
and not if it overlaps one of another kind; the rest teach nothing. The trees never see what the checks look
at, so that they must tell real spans by shape and neighbourhood. For
each kind the threshold is set on candidates kept from training so that enough of those above it are real; a
kind without such a threshold gets no further spans. The trees are then plain CASE expressions in the scan
over whole texts. What they accept must pass its kind's check too. Base spans always stay.
"""

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, columns_once, table
from .spans import digits, joined, luhn, with_spans

KINDS = ("email", "ip", "card", "phone")
#: Trees, depth, and the precision a threshold aims at.
TREES, DEPTH, PRECISION = 8, 3, 0.98
CONTEXT = 24

_NO_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
#: Base patterns. Possessive repeats and the look-behind change no match; they keep long runs linear.
BASE = {
    "email": _NO_LOCAL + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"\x20?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\])\x20?"
#: Generators of further candidates: written-out addresses, and numbers of common formats whose neighbours spoil the base match.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}+(?:" + _DOT + r"[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{3})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
HINTS = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|account|pay|iban", "phone": "tel|phone|call|fax|mobil|contact"}
FEATURES = ("kind", "length", "letters", "breaks", "plus", "bracket", "groups", "even", "first", "last", "hint", "before_word", "after_word", "dots", "at")


def gates(text: str) -> dict[str, Column]:
    t = F.col(text)
    return {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": t.contains("+"), "more_email": t.contains("at)") | t.contains("at]"), "more_ip": t.rlike(r"[0-9]\x20?[\[(](?:\.|dot)[\])]"), "more_card": t.rlike("[0-9]{4}"), "more_phone": t.rlike(r"[0-9][\x20.-][0-9]{3}")}


def valid(kind: str, v: Column) -> Column:
    """The base rule's check of a match."""
    if kind == "ip":
        return F.regexp_replace(v, _DOT, ".").rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return luhn(v)
    if kind == "phone":
        return F.length(digits(v)).between(9, 15)
    return F.lit(True)


def found(docs: DataFrame, more: bool = True) -> DataFrame:
    """``docs`` with the matches of base patterns and generators: spans_<kind>, spans_more_<kind>."""
    gate = gates("t")
    patterns = {k: (p, gate[k]) for k, p in BASE.items()}
    if more:
        patterns |= {f"more_{k}": (p, gate[f"more_{k}"]) for k, p in MORE.items()}
    return with_spans(docs, "t", patterns)


def features(kind: int, x: Column, text: str) -> Column:
    """A struct of numbers from the span's format and its context."""
    v, t = x["v"], F.col(text)
    before = F.lower(F.substring(t, F.greatest(F.lit(1), x["s"] - CONTEXT + 1).cast("int"), F.least(x["s"], F.lit(CONTEXT)).cast("int")))
    after = F.substring(t, (x["e"] + 1).cast("int"), F.lit(8))
    size = lambda c: F.length(c).cast("double")
    yes = lambda c: c.cast("double")
    only = lambda keep: size(F.regexp_replace(v, f"[^{keep}]", ""))
    groups = F.transform(F.filter(F.split(v, r"[^0-9]+"), lambda p: p != ""), lambda p: F.length(p))
    end = lambda i: F.coalesce(F.try_element_at(groups, F.lit(i)), F.lit(0)).cast("double")
    values = {
        "kind": F.lit(float(kind)), "length": size(v), "letters": only("A-Za-z"), "breaks": only(r"\x20().-"), "plus": yes(v.startswith("+")), "bracket": yes(v.contains("(")),
        "groups": F.size(groups).cast("double"), "even": yes(F.size(F.array_distinct(groups)) <= 1), "first": end(1), "last": end(-1), "hint": yes(before.rlike(HINTS[KINDS[kind]])),
        "before_word": yes(before.rlike(r"\p{L}\x20?$")), "after_word": yes(after.rlike(r"^\x20?\p{L}")),
        "dots": only("."), "at": yes(v.contains("@") | v.contains("at")),
    }
    return F.struct(*[values[f].alias(f) for f in FEATURES])


def bucket(doc_id: str, seed: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.length("t")), F.lit(1 << 20)) / F.lit(float(1 << 20))


def candidates(docs: DataFrame) -> DataFrame:
    """(features, label, held): candidates that the base checks tell something about."""
    each = found(docs)
    short = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))
    # An address has no failing form in the base rule; it is real if its last part is a word.
    real = lambda k, v: F.regexp_extract(v, r"[^.]*$", 0).rlike("^[A-Za-z]{2,}$") if k == "email" else valid(k, v)

    def passing(k: str) -> Column:
        return F.filter(f"spans_{k}", lambda x: real(k, x["v"]))

    each = each.withColumns({f"real_{k}": passing(k) for k in KINDS})
    meets = lambda x, k: F.exists(f"real_{k}", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    def base(i: int, k: str) -> Column:
        return F.transform(f"spans_{k}", lambda x: F.struct(short(x).alias("x"), F.lit(i).alias("k"), real(k, x["v"]).alias("ok")))

    def generated(i: int, k: str) -> Column:
        others = lambda x: reduce(Column.__or__, [meets(x, j) for j in KINDS if j != k])
        told = F.transform(f"spans_more_{k}", lambda x: F.struct(short(x).alias("x"), F.lit(i).alias("k"), F.when(meets(x, k), True).when(others(x), False).alias("ok")))
        return F.filter(told, lambda c: c["ok"].isNotNull())

    rows = F.concat(*[make(i, k) for i, k in enumerate(KINDS) for make in (base, generated)])
    flat = each.select("doc_id", "t", F.explode(rows).alias("c")).filter((F.col("c.k") != 2) | (F.length(digits(F.col("c.x.v"))) >= 9))
    judged = F.coalesce(*[F.when(F.col("c.k") == i, features(i, F.col("c.x"), "t")) for i in range(len(KINDS))])
    return flat.select(judged.alias("f"), F.col("c.k").alias("k"), F.col("c.ok").cast("double").alias("label"), (bucket("doc_id", "held") < 0.3).alias("held")).select("f.*", "k", "label", "held")


def tree_case(node, x: Column) -> Column:
    """A fitted tree as nested conditions on the fields of ``x``."""
    if node.getClass().getSimpleName().startswith("Leaf"):
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[FEATURES[split.featureIndex()]] <= F.lit(float(split.threshold())), tree_case(node.leftChild(), x)).otherwise(tree_case(node.rightChild(), x))


class Judge:
    """Boosted trees as an expression and a threshold for each kind."""

    def __init__(self, trees: list, weights: list[float], limits: list[float]):
        self.trees, self.weights, self.limits = trees, weights, limits

    def margin(self, x: Column) -> Column:
        total = F.lit(0.0)
        for node, w in zip(self.trees, self.weights, strict=True):
            total = total + F.lit(w) * tree_case(node, x)
        return total

    def accepts(self, kind: int, x: Column) -> Column:
        return F.round(self.margin(x), 2) >= F.lit(self.limits[kind])


def fit(docs: DataFrame) -> Judge | None:
    """None if the texts have no good candidates; no spans are added then. Without bad ones all have the same margin."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.keep(candidates(docs), "candidates")
    labels = {r["label"] for r in rows.filter("not held").select("label").distinct().collect()}
    if 1.0 not in labels:
        return None
    judge = Judge([], [], [float("inf")] * len(KINDS))
    if 0.0 in labels:
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.filter("not held"))
        model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=5).fit(assembled)
        judge.trees, judge.weights = [t.rootNode() for t in model._java_obj.trees()], list(model.treeWeights)
    scored = rows.filter("held").select("k", "label", F.round(judge.margin(F.struct(*FEATURES)), 2).alias("m"))
    steps = scored.groupBy("k", "m").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    for k in range(len(KINDS)):
        good = n_above = 0
        for r in sorted((r for r in steps if r["k"] == k), key=lambda r: -r["m"]):
            good, n_above = good + r["good"], n_above + r["n"]
            if good >= PRECISION * n_above:
                judge.limits[k] = r["m"]
    return judge


def inside(x: Column, base: Column) -> Column:
    """Whether a span of ``base`` holds all of ``x``, which then adds nothing."""
    return F.exists(base, lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"]))


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added), a row for each row of ``docs``.

    A null text is an empty one, without spans. Repeated rows give repeated results; an empty table an
    empty one. Only doc_id and text are read. ``added`` holds the (kind, s, e) that the trees add; they
    lie inside no base span of their kind, but may overlap one. Text outside the basic plane counts by code points.
    """
    slim = columns_once(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    judge = fit(slim)
    each = found(slim, more=judge is not None)

    def passing(k: str) -> Column:
        return F.filter(f"spans_{k}", lambda x: valid(k, x["v"]))

    each = each.withColumns({f"base_{k}": passing(k) for k in KINDS})
    tagged = lambda c, i: F.transform(c, lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    each = each.withColumn("base", F.concat(*[tagged(F.col(f"base_{k}"), i) for i, k in enumerate(KINDS)]))
    none = F.array().cast("array<struct<kind:int,s:bigint,e:bigint>>")
    if judge is None:
        each = each.withColumn("added", none)
    else:

        def accepted(i: int, k: str) -> Column:
            # What passes the trees must pass its kind's check as well; an address has none.
            rest = F.filter(f"spans_more_{k}", lambda x: ~inside(x, F.col(f"base_{k}")) & valid(k, x["v"]))
            # The features of a span are worked out once, then read by all trees.
            judged = F.transform(rest, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), features(i, x, "t").alias("f")))
            return tagged(F.filter(judged, lambda x: judge.accepts(i, x["f"])), i)

        new = [accepted(i, k) for i, k in enumerate(KINDS) if k in MORE]
        each = each.withColumn("added", F.concat(*new))
    each = each.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], "base", "added")
    return each.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added")), KINDS).alias("spans"), "added",
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(table(spark, sf_dir, "documents")).drop("added")
