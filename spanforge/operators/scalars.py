"""Scalar rules, one query each, over texts, spans and names made from the tables."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import cosine, jaccard, overlap, words
from ..plans.registry import query
from ..sources.adapters import DISPATCHES, ERRORS, MODELS, PARENTS, SPANS, dispatches, order, parents, read, spans, turns

_WS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
_TWO = f"w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), s AS (SELECT *, {_WS.format(c='text')} AS a, {_WS.format(c='before')} AS b FROM w WHERE before IS NOT NULL)"
_J = "CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN {e} ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END"


def with_before(spark, d) -> DataFrame:
    t = turns(spark, d).withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).filter("before is not null")
    return t.withColumns({"a": words(F.col("text")), "b": words(F.col("before"))})


@query("h1_word_jaccard", f"WITH {_TWO} SELECT conv_id, turn, round({_J.format(e=0)}, 6) AS similarity FROM s")
def h1(spark, d) -> DataFrame:
    return with_before(spark, d).select("conv_id", "turn", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("h2_word_difference", f"WITH {_TWO} SELECT conv_id, turn, round(1 - {_J.format(e=1)}, 6) AS difference FROM s")
def h2(spark, d) -> DataFrame:
    """One less the similarity; two empty texts do not differ."""
    both = (F.size("a") == 0) & (F.size("b") == 0)
    return with_before(spark, d).select("conv_id", "turn", F.round(F.when(both, 0.0).otherwise(1 - jaccard(F.col("a"), F.col("b"))), 6).alias("difference"))


@query("h3_smaller_set_overlap", f"WITH {_TWO} SELECT conv_id, turn, round(CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / least(len(a), len(b)) END, 6) AS overlap FROM s")
def h3(spark, d) -> DataFrame:
    return with_before(spark, d).select("conv_id", "turn", F.round(overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


_CW = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]{{3,}}'))"


@query("h4_claim_containment", f"WITH {_TWO}, c AS (SELECT *, {_CW.format(c='text')} AS x, {_CW.format(c='before')} AS y FROM s) SELECT conv_id, turn, round(CASE WHEN text = '' OR before = '' THEN 0 WHEN len(x) = 0 THEN 1 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(x) END, 6) AS supported FROM c")
def h4(spark, d) -> DataFrame:
    return with_before(spark, d).select("conv_id", "turn", F.round(R.containment(F.col("text"), F.col("before")), 6).alias("supported"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query("h5_facts", f"SELECT conv_id, turn, len(regexp_extract_all(text, {_quoted(R.NUMBER)})) AS numbers, len(regexp_extract_all(text, {_quoted(R.URL)})) AS urls, len(regexp_extract_all(text, {_quoted(R.MAIL)})) AS emails FROM conversations")
def h5(spark, d) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return turns(spark, d).select("conv_id", "turn", n(R.NUMBER).alias("numbers"), n(R.URL).alias("urls"), n(R.MAIL).alias("emails"))


@query("h6_normal_numbers", "SELECT o_orderkey, regexp_replace('$' || format('{:,.2f}', o_totalprice) || ' %', '[,$€£¥%\\s]', '', 'g') AS number FROM orders")
def h6(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", R.normal_number(F.concat(F.lit("$"), F.format_number("o_totalprice", 2), F.lit(" %"))).alias("number"))


@query("h7_same_magnitude", f"WITH {SPANS}, v AS (SELECT span_id, value - 50 AS a, lag(value - 50) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS b FROM spans) SELECT span_id, CASE WHEN a = 0 OR b = 0 THEN FALSE ELSE greatest(a, b) / least(a, b) < 10 END AS same FROM v WHERE b IS NOT NULL")
def h7(spark, d) -> DataFrame:
    v = spans(spark, d).select("span_id", (F.col("value") - 50).alias("a"), F.lag(F.col("value") - 50).over(order()).alias("b")).filter("b is not null")
    return v.select("span_id", R.same_magnitude(F.col("a"), F.col("b")).alias("same"))


_SQL_SPAN_MODEL = f"({list(MODELS)!r})[CAST(k % {len(MODELS)} + 1 AS INTEGER)]"


def with_model(spark, d) -> DataFrame:
    return spans(spark, d).filter("k is not null").withColumn("model", F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("k") % len(MODELS) + 1).cast("int")))


@query("h10_model_tier", f"""WITH {SPANS}, m AS (SELECT span_id, {_SQL_SPAN_MODEL} AS model FROM spans WHERE k IS NOT NULL) SELECT span_id, CASE WHEN regexp_matches(model, 'opus|o1|o3') OR regexp_matches(model, 'gpt-4(-turbo)?(-[0-9]+)?$') THEN 'expensive'
WHEN contains(model, 'sonnet') OR (contains(model, 'gpt-4o') AND NOT contains(model, 'gpt-4o-mini')) OR regexp_matches(model, 'gemini[- ]([0-9]+\\.?[0-9]*[- ])?pro') THEN 'mid' WHEN regexp_matches(model, 'haiku|gpt-4o-mini|gemini[- ]([0-9]+\\.?[0-9]*[- ])?flash|gpt-3\\.5') THEN 'cheap' END AS tier FROM m""")
def h10(spark, d) -> DataFrame:
    return with_model(spark, d).select("span_id", R.model_tier(F.col("model")).alias("tier"))


@query("h11_context_window", f"WITH {SPANS}, m AS (SELECT span_id, {_SQL_SPAN_MODEL} AS model FROM spans WHERE k IS NOT NULL) SELECT span_id, CAST(CASE {' '.join(f'WHEN model = {k!r} THEN {v}' for k, v in R.WINDOWS.items())} {' '.join(f'WHEN contains(model, {k!r}) THEN {v}' for k, v in R.WINDOWS.items())} ELSE 128000 END AS INTEGER) AS context_window FROM m")
def h11(spark, d) -> DataFrame:
    return with_model(spark, d).select("span_id", R.context_window(F.col("model")).alias("context_window"))


@query("h12_failure_categories", f"WITH {SPANS}, m AS (SELECT span_id, ({list(ERRORS)!r})[CAST(k % {len(ERRORS)} + 1 AS INTEGER)] AS message FROM spans WHERE k IS NOT NULL) SELECT span_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(message, {_quoted(p)}) THEN {k!r} END' for k, p in R.FAILURES.items())}], lambda x: x IS NOT NULL), ',') AS categories FROM m")
def h12(spark, d) -> DataFrame:
    message = F.element_at(F.array(*[F.lit(e) for e in ERRORS]), (F.col("k") % len(ERRORS) + 1).cast("int"))
    return spans(spark, d).filter("k is not null").select("span_id", F.array_join(R.failure_categories(message), ",").alias("categories"))


@query("h13_risky_actions", f"WITH {DISPATCHES} SELECT msg_id, coalesce({', '.join(f'nullif(regexp_extract(content, {_quoted('(?i)' + p)}), {chr(39) * 2})' for p in R.RISKS)}) AS risk FROM messages")
def h13(spark, d) -> DataFrame:
    return dispatches(spark, d).select("msg_id", R.risk(F.col("content")).alias("risk"))


@query("h17_personal_data", f"SELECT doc_id, {', '.join(f'len(regexp_extract_all(text, {_quoted(p)})) AS {k}' for k, p in R.PII.items())} FROM documents WHERE text IS NOT NULL")
def h17(spark, d) -> DataFrame:
    """Matches of each kind; a border of a word is one of ASCII letters, digits and _, whatever the engine's own rule."""
    border = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    t = read(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", *[F.size(F.regexp_extract_all("text", F.lit(p.replace(r"\b", border)), F.lit(0))).cast("long").alias(k) for k, p in R.PII.items()])


@query("h18_secrets", f"SELECT doc_id, {', '.join(f'len(regexp_extract_all(text, {_quoted(p)})) AS {k}' for k, p in R.SECRETS.items())} FROM documents WHERE text IS NOT NULL")
def h18(spark, d) -> DataFrame:
    return read(spark, d, "documents").filter("text is not null").select("doc_id", *[F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long").alias(k) for k, p in R.SECRETS.items()])


@query("h19_personal_tokens", f"WITH e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {_quoted(R.MAIL)})) AS value FROM documents) SELECT doc_id, 'EMAIL_' || substr(sha256(doc_id || ':email:' || value), 1, 12) AS token, value FROM e")
def h19(spark, d) -> DataFrame:
    """The vault of reversible tokens: a value's token depends on its session (the document) and kind."""
    e = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(R.MAIL), F.lit(0)))).alias("value"))
    token = F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("email"), F.col("value")), 256), 1, 12)
    return e.select("doc_id", F.concat(F.lit("EMAIL_"), token).alias("token"), "value")


@query("h20_redacted_json", "SELECT event_id, regexp_replace(props, '(\"k\": )[0-9]+', '\\1\"[REDACTED]\"', 'g') AS props FROM events")
def h20(spark, d) -> DataFrame:
    """Values of named keys are redacted at any depth of a JSON text."""
    return read(spark, d, "events").select("event_id", F.regexp_replace("props", r'("k": )[0-9]+', r'$1"[REDACTED]"').alias("props"))


@query("h21_flattened", 'SELECT event_id AS "id", event_type AS "who.kind", user_id AS "who.user.id", value AS "what.value" FROM events')
def h21(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    user = F.struct(F.col("user_id").alias("id")).alias("user")
    nested = e.select(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind"), user).alias("who"), F.struct("value").alias("what"))
    return R.flattened(nested)


@query("h22_json_types", """SELECT event_id, CASE WHEN regexp_matches(props, '"k": -?[0-9]+[,}]') THEN 'number' WHEN regexp_matches(props, '"k": "') THEN 'string' WHEN regexp_matches(props, '"k": (true|false)') THEN 'boolean' END AS kind FROM events""")
def h22(spark, d) -> DataFrame:
    """The kind of a JSON value; numbers are one kind, and null has none."""
    kind = F.expr("schema_of_variant(try_variant_get(try_parse_json(props), '$.k', 'variant'))")
    return read(spark, d, "events").select("event_id", R.first_of([(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "number"), (kind == "STRING", "string"), (kind == "BOOLEAN", "boolean")]).alias("kind"))


_HANDOFF = "CASE k % 5 WHEN 0 THEN 'Planner->' || event_type WHEN 1 THEN event_type || ' → Writer' WHEN 2 THEN 'Planner to ' || event_type WHEN 3 THEN event_type || ' => Writer' ELSE event_type END"


@query("h23_handoff_ends", f"""WITH s AS (SELECT event_id, {_HANDOFF} AS name FROM (SELECT event_id, event_type, TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events) WHERE k IS NOT NULL), p AS (SELECT *, CASE WHEN contains(lower(name), '->') THEN '->' WHEN contains(name, '→') THEN '→' WHEN contains(lower(name), ' to ') THEN ' to ' WHEN contains(name, '=>') THEN '=>' END AS sep FROM s)
SELECT event_id, CASE WHEN sep IS NULL THEN name ELSE trim(split_part(lower(name), sep, 1)) END AS source, CASE WHEN sep IS NULL THEN 'unknown' ELSE trim(split_part(lower(name), sep, 2)) END AS target FROM p""")
def h23(spark, d) -> DataFrame:
    s = spans(spark, d).filter("k is not null").select(F.col("span_id").alias("event_id"), F.col("name").alias("event_type"), "k")
    return s.select("event_id", R.handoff_ends(F.expr(_HANDOFF)).alias("x")).select("event_id", "x.source", "x.target")


_NODE = "CASE k % 6 WHEN 0 THEN 'Agent Answer ' || k WHEN 1 THEN 'L1 Support Round ' || k WHEN 2 THEN 'Seller Offer' WHEN 3 THEN ' Alex Proposes ' WHEN 4 THEN 'Judge_v' || k ELSE 'Editor Returns to Desk' END"


def _nested(name: str) -> str:
    for p in R.ENDINGS:
        name = f"regexp_replace({name}, {_quoted(p)}, '')"
    return f"trim({name})"


@query("h24_node_names", f"WITH {SPANS} SELECT span_id, {_nested(f'trim({_NODE})')} AS node FROM spans WHERE k IS NOT NULL")
def h24(spark, d) -> DataFrame:
    return spans(spark, d).filter("k is not null").select("span_id", R.node_name(F.expr(_NODE)).alias("node"))


_STEM = "CASE WHEN length(w) <= 3 THEN w " + " ".join(f"WHEN suffix(w, {s!r}) AND length(w) >= {len(s) + 3} THEN left(w, length(w) - {len(s)})" for s in R.SUFFIXES) + " ELSE w END"


@query("h26_stems", f"WITH w AS (SELECT DISTINCT unnest({_WS.format(c='text')}) AS w FROM conversations) SELECT w AS word, {_STEM} AS stem FROM w")
def h26(spark, d) -> DataFrame:
    return turns(spark, d).select(F.explode(words(F.col("text"))).alias("word")).distinct().withColumn("stem", R.stem(F.col("word")))


@query("h27_numeric_constraints", "WITH t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n, len(string_split(text, chr(10))) AS ls FROM conversations) SELECT conv_id, turn, abs(n - 50) <= 5 AS words_met, abs(ls - 3) <= 1 AS lines_met FROM t")
def h27(spark, d, words_wanted: int = 50, lines_wanted: int = 3) -> DataFrame:
    """Whether a text keeps to a number of words, or of lines, within a tenth; of lines at least one is let pass."""
    n = F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x != ""))
    near = lambda c, want, least: F.abs(c - want) <= max(least, int(want * R.TOLERANCE))
    return turns(spark, d).select("conv_id", "turn", near(n, words_wanted, 0).alias("words_met"), near(F.size(F.split("text", "\n")), lines_wanted, 1).alias("lines_met"))


@query("h28_cosine", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS similarity FROM e WHERE b IS NOT NULL")
def h28(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("b", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).filter("b is not null")
    return e.select("vec_id", F.round(cosine(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("h29_call_cost", f"WITH {SPANS}, m AS (SELECT span_id, k * 1000 AS i, CAST(floor(value) AS BIGINT) * 100 AS o, CASE k % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gemini-1.5-pro' ELSE 'unheard of' END AS model FROM spans WHERE k IS NOT NULL) SELECT span_id, round(CASE model WHEN 'gpt-4o' THEN i / 1e6 * 2.5 + o / 1e6 * 10.0 WHEN 'gemini-1.5-pro' THEN i / 1e6 * 1.25 + o / 1e6 * 5.0 ELSE 0.0 END, 6) AS cost FROM m")
def h29(spark, d) -> DataFrame:
    model = F.when(F.col("k") % 3 == 0, "gpt-4o").when(F.col("k") % 3 == 1, "gemini-1.5-pro").otherwise("unheard of")
    return spans(spark, d).filter("k is not null").select("span_id", R.cost(model, F.col("k") * 1000, F.floor("value") * 100).alias("cost"))


@query("h30_decay", "SELECT o_orderkey, round(exp(-date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-02-01') / 90.0), 6) AS recency FROM orders")
def h30(spark, d, days: float = 90.0) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.round(F.exp(-F.datediff(F.lit("2024-02-01"), F.col("o_orderdate")) / days), 6).alias("recency"))


@query("h32_common_subsequence")
def h32(spark, d) -> DataFrame:
    """How much of the order of each trace's first half its second half repeats."""
    s = spans(spark, d).withColumn("seq", F.row_number().over(order())).withColumn("n", F.count("*").over(W.partitionBy("trace_id")))
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("seq", "name")))), lambda x: x["name"])
    per = s.groupBy("trace_id").agg(names(F.col("seq") * 2 <= F.col("n")).alias("first"), names(F.col("seq") * 2 > F.col("n")).alias("last"))
    return per.select("trace_id", R.common_subsequence(F.col("first"), F.col("last")).alias("common"))


@query("h33_item_counts", "SELECT o_custkey, count(*) AS items FROM orders GROUP BY 1")
def h33(spark, d) -> DataFrame:
    """Items of a node's output, a JSON array."""
    outputs = read(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("output"))
    return outputs.select("o_custkey", F.json_array_length("output").cast("long").alias("items"))


@query("h35_sentences", "SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ' || chr(10) || chr(9)) <> '')) AS sentences FROM conversations")
def h35(spark, d) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", F.size(F.filter(F.split("text", "[.!?]+"), lambda x: F.trim(F.translate(x, "\n\t", "  ")) != "")).cast("long").alias("sentences"))


@query("h37_duration", f"WITH {PARENTS} SELECT span_id, CAST(epoch_us(end_time) - epoch_us(start_time) AS DOUBLE) / 1000 AS duration_ms FROM parents")
def h37(spark, d) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return parents(spark, d).select("span_id", ((us("end_time") - us("start_time")) / 1000).alias("duration_ms"))
