"""Substring dedup (12): repeated-phrase automata over word sequences.

A window is ``window`` consecutive words. Its anchor is the leftmost of its runs of GRAM words with the least
hash, so that equal windows have equal anchors at equal places, and neighbouring windows mostly share one: a
document has an anchor for some fourteen words. Anchors that stand in one place only rule their windows out. The
stretches of words around the others are compared, distinct ones once, and their windows that start in two places
or more make the confirmed passages. Passages are compiled to Aho-Corasick automata over word numbers, sharded by
anchor so that one holds a bounded number of them, and the stretches of all documents stream through the
automaton of their anchor, each distinct one once, which marks every occurrence. Stretches hold each window
whose anchor recurs, so that the text that is not streamed has no repeated window.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, Scratch, columns_once, numbered, pieces, position, table
from .minhash import permute

WINDOW, GRAM = 35, 8
#: Windows whose anchors are found at a time.
CHUNK = 1 << 15
#: Keys with more than one in so many of all rows are joined apart from the others, by broadcast; there are no more than that.
HOT = 1000
#: Distinct stretches of an anchor that one task compares; the windows of more are counted by a shuffle.
TOGETHER = 2048
#: Passages in an automaton on average, so that it fits a processor's cache while it is built; at most for one anchor; stretches that one task streams through it.
PASSAGES, CROWD, STREAMED = 500, 20_000, 200_000

_STEP, _PLACE = 0x9E3779B97F4A7C15, np.uint64((1 << 17) - 1)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space, tab to carriage return."""
    return (text or "").encode().split()


def anchored(words: list[bytes], window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): the runs of window starts that share an anchor."""
    import xxhash

    n, span = len(words) - window + 1, window - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = len(h) - gram + 1
    with np.errstate(over="ignore"):
        grams = np.zeros(size, np.uint64)
        for k in range(gram):
            grams = (grams + h[k : k + size]) * np.uint64(_STEP + 2 * k)
    grams = permute(grams)
    at = np.empty(n, np.int64)
    for a in range(0, n, CHUNK):
        # The place fills the low bits, so that of equal hashes the leftmost is least; doubled spans give the minimum.
        least = (grams[a : a + CHUNK + span - 1] & ~_PLACE) | np.arange(min(CHUNK + span - 1, size - a), dtype=np.uint64)
        held = 1
        while 2 * held <= span:
            least = np.minimum(least[:-held], least[held:])
            held *= 2
        if held < span:
            least = np.minimum(least[: len(least) - span + held], least[span - held :])
        at[a : a + CHUNK] = a + (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:] - 1, n - 1)
    return first, last, grams[at[first]].view(np.int64)


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def passages_at(stretch: str, starts, window: int) -> list[str]:
    """The stretches of words that the windows at ``starts`` cover, one for each run of neighbouring starts."""
    words, out, starts = stretch.split(" "), [], sorted(starts)
    for k, s in enumerate(starts):
        if k and s == starts[k - 1] + 1:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [" ".join(words[a:b]) for a, b in out]


def repeated_starts(stretches: list[tuple[str, int]], window: int) -> list[range | list[int]]:
    """For each (stretch, times it stands in the documents): the starts of its windows that stand in two places or more."""
    if len(stretches) == 1 and stretches[0][1] < 2:
        return [[]]
    counts: dict[str, int] = {}
    cut = []
    for s, n in stretches:
        ends = [i for i, c in enumerate(s) if c == " "]
        starts, ends = [0, *[i + 1 for i in ends]], [*ends, len(s)]
        cut.append([s[a:b] for a, b in zip(starts, ends[window - 1 :], strict=False)])
        if len(stretches) > 1:
            for w in cut[-1]:
                counts[w] = counts.get(w, 0) + n
    return [range(len(ws)) if n > 1 else [i for i, w in enumerate(ws) if counts[w] > 1] for ws, (_, n) in zip(cut, stretches, strict=True)]


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def recurring(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of ``rows`` whose key has a total ``n`` of two or more, and the frequent ones of those keys: they are joined apart, so that none gathers in one task."""
    counts = scratch.keep(rows.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("held")).filter("total > 1"), "counts")
    often = (counts.agg(F.sum("held")).first()[0] or 0) // HOT
    hot = scratch.keep(counts.filter(F.col("held") > max(often, 1)).select(*keys), "hot")
    return semi(rows, counts.select(*keys), hot), hot


def semi(rows: DataFrame, keys: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows whose key is among ``keys``; those of ``hot`` keys, HOT at most, by a broadcast of their own."""
    names, some = keys.columns, F.broadcast(hot)
    return rows.join(F.broadcast(hot.join(keys, names, "left_semi")), names, "left_semi").unionByName(rows.join(some, names, "left_anti").join(keys.hint("merge"), names, "left_semi"))


def repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(t1, t2, spans) for each distinct text with repeated windows: (s, e) of covered words, apart and in order.

    ``docs`` has the column text; t1 and t2 are its two hashes.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("two"), "text").alias("t2"))

    def anchors(batches):
        for batch in pieces(batches):
            out = []
            for k, text in enumerate(batch.column(0)):
                first, last, anchor = anchored(words_of(text.as_py()), window)
                if len(first):
                    out.append((np.full(len(first), k), first, last, anchor))
            if out:
                k, first, last, anchor = (np.concatenate(c) for c in zip(*out, strict=True))
                for a in range(0, len(k), CHUNK):
                    b = a + CHUNK
                    ids = batch.select(["t1", "t2"]).take(pa.array(k[a:b]))
                    yield pa.RecordBatch.from_arrays([*ids.columns, *(pa.array(c[a:b]) for c in (first, last, anchor))], ["t1", "t2", "first", "last", "anchor"])

    runs = named.mapInArrow(anchors, "t1 long, t2 long, first long, last long, anchor long")
    runs = scratch.keep(runs.groupBy("t1", "t2", "first", "last", "anchor").agg(F.count("*").alias("n")), "runs")
    again, hot = recurring(runs, ["anchor"], scratch)
    again = scratch.keep(again, "again")
    scratch.drop(runs)
    within = again.groupBy("t1", "t2").agg(F.max("n").alias("n"), F.collect_list(F.struct("first", "last", "anchor")).alias("runs"))
    asked = small(scratch.keep(again.select("t1", "t2").distinct(), "asked"))
    texts = named.join(asked, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                t1, t2, n, runs, text = (c[k].as_py() for c in batch.columns)
                words = words_of(text)
                for a in range(0, len(runs), 512):
                    some = runs[a : a + 512]
                    held = [b" ".join(words[r["first"] : r["last"] + window]).decode() for r in some]
                    cols = [pa.array([v] * len(some), pa.int64()) for v in (t1, t2, n)] + [pa.array([r[c] for r in some], pa.int64()) for c in ("first", "anchor")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(held, pa.string())], ["t1", "t2", "n", "first", "anchor", "stretch"])

    with_runs = within.join(texts, ["t1", "t2"]).select("t1", "t2", "n", "runs", "text")
    cuts = with_runs.mapInArrow(cut, "t1 long, t2 long, n long, first long, anchor long, stretch string")
    stretches = scratch.keep(cuts.withColumns({"c1": F.xxhash64("stretch"), "c2": F.xxhash64(F.lit("two"), "stretch")}), "stretches")
    distinct = scratch.keep(stretches.groupBy("anchor", "c1", "c2", "stretch").agg(F.sum("n").alias("n")), "distinct")
    confirmed = scratch.keep(passages(distinct, scratch, window, tasks), "passages")

    shards = confirmed.count() // PASSAGES + 1
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")
    # An anchor with more passages than an automaton may hold has several; its stretches go to each of them.
    crowded = scratch.keep(confirmed.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(CROWD)).cast("int").alias("subs")).filter("subs > 1"), "crowded")
    crowded = small(crowded)
    subs = F.coalesce("subs", F.lit(1))
    known = confirmed.join(crowded, "anchor", "left").select(shard, F.pmod(F.xxhash64("passage"), subs).cast("int").alias("sub"), "passage")
    asking = semi(distinct, scratch.keep(confirmed.select("anchor").distinct(), "anchors"), hot).join(crowded, "anchor", "left")
    asking = asking.select("c1", "c2", shard, F.explode(F.sequence(F.lit(0), subs - 1)).alias("sub"), "stretch")
    salts = scratch.keep(asking.groupBy("shard", "sub").agg(F.ceil(F.count("*") / F.lit(STREAMED)).cast("int").alias("salts")), "salts")
    none = [F.lit(None).cast("long").alias(c) for c in ("c1", "c2")]
    compiled = known.join(salts, ["shard", "sub"]).select("shard", "sub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *none, F.col("passage").alias("words"))
    streamed = asking.join(small(salts), ["shard", "sub"]).select("shard", "sub", F.pmod("c1", "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "c1", "c2", F.col("stretch").alias("words"))
    dealt = compiled.unionByName(streamed).repartition(tasks, "shard", "sub", "salt").sortWithinPartitions("shard", "sub", "salt", "kind")
    # An anchor's stretches go through one automaton each unless it is crowded: their hits come in as many rows as they have automata.
    hits = dealt.mapInArrow(located, "c1 long, c2 long, hits array<long>")
    placed = stretches.select("t1", "t2", "first", "c1", "c2").join(hits.hint("merge"), ["c1", "c2"])

    def join_up(batches):
        for batch in batches:
            spans = [[{"s": s, "e": e} for s, e in merged((x["first"] + s, x["first"] + e) for x in row for s, e in zip(x["hits"][::2], x["hits"][1::2], strict=True))] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], ["t1", "t2", "spans"])

    found = placed.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "hits")).alias("spans"))
    return scratch.keep(found.mapInArrow(join_up, "t1 long, t2 long, spans array<struct<s:long,e:long>>"), "spans")


def passages(distinct: DataFrame, scratch: Scratch, window: int, tasks: int) -> DataFrame:
    """(anchor, passage), distinct: the runs of windows that stand in two places or more, from (anchor, c1, c2, stretch, n).

    Windows with one anchor are compared in one task, unless an anchor has more than TOGETHER stretches:
    theirs are counted by their hashes.
    """
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("held"), F.sum("n").alias("n")).filter("n > 1")
    many = scratch.keep(sizes.filter(F.col("held") > TOGETHER).select("anchor"), "many")
    wide = small(many)

    def compare(batches):
        anchor, held = None, []

        def flush():
            out = {p for (s, _), starts in zip(held, repeated_starts(held, window), strict=True) for p in passages_at(s, starts, window)} if held else ()
            return pa.RecordBatch.from_arrays([pa.array([anchor] * len(out), pa.int64()), pa.array(list(out), pa.string())], ["anchor", "passage"])

        for batch in batches:
            for a, s, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if a != anchor:
                    yield flush()
                    anchor, held = a, []
                held.append((s, n))
        yield flush()

    few = distinct.join(wide, "anchor", "left_anti").select("anchor", "stretch", "n").repartition(tasks, "anchor").sortWithinPartitions("anchor")
    narrow = few.mapInArrow(compare, "anchor long, passage string")
    if many.isEmpty():
        return narrow
    crowded = scratch.keep(distinct.join(wide, "anchor", "left_semi"), "crowded")
    words = F.split("stretch", " ")
    starts = crowded.select("c1", "c2", "n", words.alias("words"), F.explode(F.sequence(F.lit(0), F.size(words) - window)).alias("start"))
    held = F.array_join(F.slice("words", F.col("start") + 1, window), " ")
    windows = starts.select("c1", "c2", "n", "start", F.xxhash64(held).alias("w1"), F.xxhash64(F.lit("two"), held).alias("w2"))
    again, _ = recurring(scratch.keep(windows, "windows"), ["w1", "w2"], scratch)
    places = again.groupBy("c1", "c2").agg(F.collect_list("start").alias("starts"))

    def cut(batches):
        for batch in batches:
            out = [(a, p) for a, s, starts in zip(*[c.to_pylist() for c in batch.columns], strict=True) for p in passages_at(s, starts, window)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([p for _, p in out], pa.string())], ["anchor", "passage"])

    more = crowded.join(places, ["c1", "c2"]).select("anchor", "stretch", "starts").mapInArrow(cut, "anchor long, passage string")
    return narrow.unionByName(more.distinct())


def located(batches):
    """(c1, c2, hits) of sorted rows (shard, sub, salt, kind, c1, c2, words), an automaton's passages before its stretches; hits are starts and ends in turn."""
    import ahocorasick

    at, numbers, automaton, ready = None, {}, None, False
    for batch in batches:
        out = []
        for shard, sub, salt, kind, c1, c2, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != (shard, sub, salt):
                at, numbers, ready = (shard, sub, salt), {}, False
                automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            words = text.split(" ")
            if kind == 0:
                automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words), len(words))
                continue
            if not len(automaton):  # none of the anchor's passages fell to this one
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            spans = merged((end + 1 - n, end + 1) for end, n in automaton.iter(tuple([numbers.get(w, 0) for w in words])))
            if spans:
                out.append((c1, c2, [x for span in spans for x in span]))
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], ["c1", "c2", "hits"])


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that repeated windows cover, with the columns substring_words, substring_removed and substring_spans.

    The text becomes its kept words, joined by one space; substring_spans has the (s, e) of removed words, and the other
    two count words before and those removed. A window is repeated if its word sequence starts anywhere else: in
    another row, rows that repeat an id or a whole text among them, or elsewhere in the same text. Null, empty and
    blank texts have no words and become empty; texts of fewer words than a window lose none. Texts of any
    length are taken whole, and other columns stay, whatever their names. An empty table gives an empty one.
    """
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words or more")
    scratch = Scratch(docs.sparkSession, "substrings")
    slim = columns_once(docs, "text").select(F.coalesce("text", F.lit("")).alias("text"))
    found = repeats(slim, scratch, window)
    held = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    found = F.broadcast(found) if held <= BROADCAST_ROWS else found
    names, at = docs.columns, position(docs, "text")
    plain = numbered(docs).withColumn(f"c{at}", F.coalesce(F.col(f"c{at}"), F.lit("")))
    text = F.col(f"c{at}")
    joined = plain.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("two"), text)}).join(found, ["t1", "t2"], "left").drop("t1", "t2")
    added = {"substring_words": "long", "substring_removed": "long"}

    def keep(batches):
        for batch in pieces(batches):
            kept, counts, gone = [], [], []
            for t, spans in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                words, upto, left = words_of(t.as_py()), 0, []
                for x in spans.as_py() or ():
                    left += words[upto : x["s"]]
                    upto = x["e"]
                left += words[upto:]
                kept.append(b" ".join(left).decode())
                counts.append(len(words))
                gone.append(len(words) - len(left))
            cols = [pa.array(kept, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            cols += [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, [*[f"c{i}" for i in range(len(names))], *added, "spans"])

    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema[: len(names)])] + [f"{k} {v}" for k, v in added.items()] + ["spans array<struct<s:bigint,e:bigint>>"])
    return joined.mapInArrow(keep, schema).toDF(*names, *added, "substring_spans")


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_once(table(spark, sf_dir, "documents"), "doc_id", "text")
    return drop_repeats(docs).select("doc_id", F.col("substring_words").alias("n_words"), F.col("substring_removed").alias("n_removed"), F.sha2(F.col("text"), 256).alias("kept_sha256"))
