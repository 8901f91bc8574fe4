"""Checks of dialogues (trace_id, turn, participant, text), all traces at once: loops, withholding, awareness of the end."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import DIALOGUES, dialogues

#: Alike answers that make a loop; letters of an answer with substance; issues that make a finding; turns without an end, and without progress.
ALIKE, SUBSTANCE, ISSUES, NO_END, NO_PROGRESS = 3, 100, 3, 25, 10
#: Words of questions; phrases of requests, of withholding, of missing context.
ASKING = ("what", "how", "why", "where", "when", "which", "who", "can you", "could you", "would you", "please", "tell me")
REQUESTS = ("please provide", "please share", "send me", "give me", "need the", "what about")
WITHHELD = (
    "can't share", "cannot disclose", "not allowed to", "confidential", "restricted", "don't have that", "no information", "not sure", "i don't know", "unclear", "didn't provide", "didn't include", "didn't mention",
    "not provided", "incomplete information", "omitted", "left out", "didn't answer", "you didn't", "wasn't included", "withholding", "refuse to share",
)
PUZZLED = ("what do you mean", "more context", "be more specific", "unclear what", "don't understand", "confused about", "missing information", "need more details", "incomplete")
#: Phrases of an end, of which the first six are claims of completion, of going on after it, and of progress.
ENDS = (
    "terminate", "done", "complete", "finished", "task complete", "goal achieved", "mission accomplished", "all done", "nothing more", "that's all", "successfully completed", "work is done", "task finished", "end of task", "completed successfully", "job done",
)
GOES_ON = ("but wait", "actually", "one more thing", "let me also", "additionally", "furthermore", "however", "also need to", "i should also", "before we finish", "wait", "hold on")
PROGRESS = ("step", "progress", "moving on", "next", "continuing", "proceeding", "working on", "now i'll", "let me", "i will")



def by_turn() -> W:
    return W.partitionBy("trace_id").orderBy("turn")


def says(phrases: tuple[str, ...], text: Column | None = None) -> Column:
    text = F.lower("text") if text is None else text
    return reduce(Column.__or__, [text.contains(p) for p in phrases])


def _says(phrases: tuple[str, ...], text: str = "lower(text)") -> str:
    return "(" + " OR ".join("contains(" + text + ", '" + p.replace("'", "''") + "')" for p in phrases) + ")"


def loops(t: DataFrame) -> DataFrame:
    """(trace_id, repeats, cycle, alternates, issues) of the agents' turns: equal answers, a cycle of two or three of them, agents who take turns. Paraphrases need vectors and are not judged."""
    n = t.groupBy("trace_id").agg(F.count("*").alias("n_turns"))
    a = t.filter("participant <> 'user'").withColumn("h", F.xxhash64("text"))
    h, p = [F.lag("h", i).over(by_turn()) for i in range(6)], [F.lag("participant", i).over(by_turn()) for i in range(6)]
    cycle = ((h[0] == h[2]) & (h[1] == h[3])) | ((h[0] == h[3]) & (h[1] == h[4]) & (h[2] == h[5]))
    two = (p[0] == p[2]) & (p[1] == p[3]) & (p[0] != p[1])
    three = (p[0] == p[3]) & (p[1] == p[4]) & (p[2] == p[5]) & (p[0] != p[1]) & (p[1] != p[2]) & (p[0] != p[2])
    a = a.withColumns({"cycle": F.coalesce(cycle, F.lit(False)), "alternates": F.coalesce(two, F.lit(False)) | F.coalesce(three, F.lit(False))})
    per = a.groupBy("trace_id", "h").agg(F.count("*").alias("c"), F.bool_or("cycle").alias("cycle"), F.bool_or("alternates").alias("alternates"))
    per = per.groupBy("trace_id").agg(F.sum("c").alias("n"), F.count_if(F.col("c") >= ALIKE).alias("repeats"), F.bool_or("cycle").alias("cycle"), F.bool_or("alternates").alias("alternates"))
    per = per.join(n, "trace_id").filter("n_turns >= 4 and n >= 3")
    return per.select("trace_id", "repeats", "cycle", "alternates", (F.col("repeats") + F.col("cycle").cast("int") + F.col("alternates").cast("int")).alias("issues"))


_LAGS = ", ".join(f"lag(text, {i}) OVER w AS h{i}, lag(participant, {i}) OVER w AS p{i}" for i in range(6))


@query("n1_turn_loops", f"""WITH {DIALOGUES}, n AS (SELECT trace_id, count(*) AS n_turns FROM turns GROUP BY 1), a AS (SELECT *, {_LAGS} FROM turns WHERE participant <> 'user' WINDOW w AS (PARTITION BY trace_id ORDER BY turn)),
f AS (SELECT trace_id, count(*) AS n, bool_or(coalesce((h0 = h2 AND h1 = h3) OR (h0 = h3 AND h1 = h4 AND h2 = h5), FALSE)) AS cycle, bool_or(coalesce(p0 = p2 AND p1 = p3 AND p0 <> p1, FALSE) OR coalesce(p0 = p3 AND p1 = p4 AND p2 = p5 AND p0 <> p1 AND p1 <> p2 AND p0 <> p2, FALSE)) AS alternates FROM a GROUP BY 1), r AS (SELECT trace_id, count(*) FILTER (WHERE c >= {ALIKE}) AS repeats FROM (SELECT trace_id, text, count(*) AS c FROM a GROUP BY 1, 2) GROUP BY 1)
SELECT f.trace_id, repeats, cycle, alternates, repeats + CAST(cycle AS INTEGER) + CAST(alternates AS INTEGER) AS issues FROM f JOIN n ON n.trace_id = f.trace_id JOIN r ON r.trace_id = f.trace_id WHERE n_turns >= 4 AND n >= 3""")
def n1(spark, d) -> DataFrame:
    return loops(dialogues(spark, d))


def withholding(t: DataFrame) -> DataFrame:
    """(trace_id, issues, detected, severity, confidence): questions and requests without an answer of substance from another in the next two turns, words of withholding, complaints of missing context; at most three or two of a kind count."""
    other = lambda i: (F.lead("participant", i).over(by_turn()) != F.col("participant")) & (F.length(F.lead("text", i).over(by_turn())) > SUBSTANCE)
    # The first of the next two turns that another takes decides a question, any of them a request.
    answered = F.coalesce(other(1), F.lit(False)) | F.coalesce(other(2), F.lit(False))
    more = F.lead("turn").over(by_turn()).isNotNull()
    asks = F.col("text").contains("?") & ~F.col("text").contains("```") & says(ASKING)
    q = t.withColumns({"unanswered": more & asks & ~answered, "ignored": more & says(REQUESTS) & ~answered, "withheld": says(WITHHELD), "puzzled": says(PUZZLED)})
    most = lambda c, n: F.least(F.lit(n), F.count_if(c))
    i = q.groupBy("trace_id").agg(F.count("*").alias("n"), (most(F.col("unanswered"), 3) + most(F.col("withheld"), 3) + most(F.col("puzzled"), 3) + most(F.col("ignored"), 2)).alias("issues")).filter("n >= 2")
    found = F.col("issues") >= ISSUES
    return i.select("trace_id", "issues", found.alias("detected"), F.when(found, "severe").otherwise("none").alias("severity"), F.round(F.when(found, F.least(F.lit(0.85), 0.5 + F.col("issues") * 0.12)).otherwise(0.8), 4).alias("confidence"))


_OTHER = "(coalesce(lead(participant) OVER w <> participant AND length(lead(text) OVER w) > 100, FALSE) OR coalesce(lead(participant, 2) OVER w <> participant AND length(lead(text, 2) OVER w) > 100, FALSE))"


@query("n4_turn_withholding", f"""WITH {DIALOGUES}, q AS (SELECT *, {_OTHER} AS answered, lead(turn) OVER w IS NOT NULL AS more FROM turns WINDOW w AS (PARTITION BY trace_id ORDER BY turn)), i AS (SELECT trace_id, count(*) AS n, least(3, count(*) FILTER (WHERE more AND contains(text, '?') AND NOT contains(text, '```') AND {_says(ASKING)} AND NOT answered)) + least(3, count(*) FILTER (WHERE {_says(WITHHELD)})) + least(3, count(*) FILTER (WHERE {_says(PUZZLED)})) + least(2, count(*) FILTER (WHERE more AND {_says(REQUESTS)} AND NOT answered)) AS issues FROM q GROUP BY 1)
SELECT trace_id, issues, issues >= 3 AS detected, CASE WHEN issues >= 3 THEN 'severe' ELSE 'none' END AS severity, round(CAST(CASE WHEN issues >= 3 THEN least(0.85, 0.5 + issues * 0.12) ELSE 0.8 END AS DOUBLE), 4) AS confidence FROM i WHERE n >= 2""")
def n4(spark, d) -> DataFrame:
    return withholding(dialogues(spark, d))


def termination(t: DataFrame) -> DataFrame:
    """(trace_id, endless, ignored, stalled, claims, issues, severity, confidence): over 25 turns without an end in the last five, work that goes on after an end was called (two at most count), ten turns with hardly a word of progress, completion claimed three times or more."""
    after, who = F.lower(F.lead("text").over(by_turn())), F.lead("participant").over(by_turn())
    goes_on = says(GOES_ON, after) | ((who == F.col("participant")) & (F.length(F.lead("text").over(by_turn())) > SUBSTANCE))
    q = t.withColumns({"goes_on": F.coalesce(says(ENDS) & goes_on, F.lit(False)), "back": F.count("*").over(W.partitionBy("trace_id")) - F.row_number().over(by_turn())})
    i = q.groupBy("trace_id").agg(F.count("*").alias("n"), F.least(F.lit(2), F.count_if("goes_on")).alias("ignored"), F.count_if((F.col("back") < NO_PROGRESS) & says(PROGRESS)).alias("progress"), F.count_if(says(ENDS[:6])).alias("claimed"), F.count_if((F.col("back") < 5) & says(ENDS)).alias("ends")).filter("n >= 3")
    i = i.withColumns({"endless": (F.col("n") > NO_END) & (F.col("ends") == 0), "stalled": (F.col("n") >= NO_PROGRESS) & (F.col("progress") < 2), "claims": F.col("claimed") >= 3})
    i = i.withColumn("issues", F.col("endless").cast("int") + F.col("ignored") + F.col("stalled").cast("int") + F.col("claims").cast("int"))
    severity = F.when(F.col("issues") == 0, "none").when((F.col("ignored") > 0) | (F.col("issues") >= 3), "severe").when(F.col("issues") >= 2, "moderate").otherwise("minor")
    confidence = F.when(F.col("issues") == 0, 0.85).otherwise(F.least(F.lit(0.9), 0.55 + F.col("issues") * 0.12))
    return i.select("trace_id", "endless", "ignored", "stalled", "claims", "issues", severity.alias("severity"), F.round(confidence, 4).alias("confidence"))


@query("n14_termination", f"""WITH {DIALOGUES}, q AS (SELECT *, coalesce({_says(ENDS)} AND ({_says(GOES_ON, 'lower(lead(text) OVER w)')} OR (lead(participant) OVER w = participant AND length(lead(text) OVER w) > 100)), FALSE) AS goes_on, count(*) OVER (PARTITION BY trace_id) - row_number() OVER w AS back FROM turns WINDOW w AS (PARTITION BY trace_id ORDER BY turn)),
i AS (SELECT trace_id, count(*) AS n, least(2, count(*) FILTER (WHERE goes_on)) AS ignored, count(*) >= 10 AND count(*) FILTER (WHERE back < 10 AND {_says(PROGRESS)}) < 2 AS stalled, count(*) FILTER (WHERE {_says(ENDS[:6])}) >= 3 AS claims, count(*) > {NO_END} AND count(*) FILTER (WHERE back < 5 AND {_says(ENDS)}) = 0 AS endless FROM q GROUP BY 1), s AS (SELECT *, CAST(endless AS INTEGER) + ignored + CAST(stalled AS INTEGER) + CAST(claims AS INTEGER) AS issues FROM i WHERE n >= 3)
SELECT trace_id, endless, ignored, stalled, claims, issues, CASE WHEN issues = 0 THEN 'none' WHEN ignored > 0 OR issues >= 3 THEN 'severe' WHEN issues >= 2 THEN 'moderate' ELSE 'minor' END AS severity, round(CAST(CASE WHEN issues = 0 THEN 0.85 ELSE least(0.9, 0.55 + issues * 0.12) END AS DOUBLE), 4) AS confidence FROM s""")
def n14(spark, d) -> DataFrame:
    return termination(dialogues(spark, d))
