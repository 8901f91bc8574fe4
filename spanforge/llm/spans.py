"""Places of regular expressions in texts, by SQL functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "array<struct<s:bigint,e:bigint,v:string>>"


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]], out: str = "spans_") -> DataFrame:
    """A column of (s, e, v) for each named pattern: leftmost non-overlapping matches, code points, end exclusive.

    Each pattern comes with a cheap condition that every text with a match meets. The text between the
    matches and the matches themselves are laid end to end, which gives the places; many matches are laid in pieces. Patterns may have
    no capturing groups and may not match the empty string.
    """
    empty = F.array().cast("array<string>")
    df = df.withColumns({f"_hits_{k}": F.when(gate, F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))).otherwise(empty) for k, (p, gate) in patterns.items()})
    df = df.withColumns({f"_gaps_{k}": F.when(F.size(f"_hits_{k}") > 0, F.split(F.col(text), p, -1)).otherwise(empty) for k, (p, _) in patterns.items()})

    def lay(k: str) -> Column:
        hits, gaps = F.col(f"_hits_{k}"), F.col(f"_gaps_{k}")
        n, size = F.size(hits), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(hits))).cast("int"))
        parts = F.zip_with(F.slice(gaps, F.lit(1), n), hits, lambda g, h: F.struct(F.length(g).cast("long").alias("g"), F.length(h).cast("long").alias("n"), h.alias("v")))
        # A fold copies its array at each step; in pieces of about the root of their number, matches are copied that often at most.
        last = F.floor(F.greatest(n - 1, F.lit(0)) / size).cast("int")
        pieces = bound(parts, lambda p: F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(p, i * size + 1, size)))

        def step(acc, x):
            s = acc["at"] + x["g"]
            return F.struct((s + x["n"]).alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["v"].alias("v"))).alias("out"))

        def joined_up(placed):
            starts = F.aggregate(placed, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(placed, starts, lambda p, at: F.transform(p["out"], lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["v"].alias("v")))))

        placed = F.transform(pieces, lambda xs: F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(NONE).alias("out")), step))
        return F.when(n > 0, bound(placed, joined_up)).otherwise(F.array().cast(NONE))

    df = df.withColumns({f"{out}{k}": lay(k) for k in patterns})
    return df.drop(*[f"_hits_{k}" for k in patterns], *[f"_gaps_{k}" for k in patterns])


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v``, 13 to 19 of them, pass the Luhn check."""
    d = digits(v)
    one = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int"))
    twice = F.transform(one, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.when(F.length(d).between(13, 19), F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of (kind number, s, e) structs in the given order, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
