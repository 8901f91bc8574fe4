"""Text rules as Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Distinct lower-cased words between white space; none for a null text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(n, F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller set; 0 if one is empty."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(n, F.lit(1)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def token_estimate(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
