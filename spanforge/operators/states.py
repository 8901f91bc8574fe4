"""Faults between successive states of a trace (trace_id, step, ts, state): JSON texts compared by path with the state before.

A state is parsed once into a map of its paths, with kind, size, number and text; a window brings it the map of the
state before, and both meet by path within a row, so that no paths are sorted, joined or grouped. All of it rests on
one exchange by trace. A state that is no JSON object counts as an empty one. Objects inside objects are opened DEPTH
levels deep; deeper ones are compared whole.
"""

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.adapters import NODES, STATES, nodes, states

DEPTH = 4
#: States that a task sorts at a time.
ROWS = 50_000
#: Graph states. Names of identities and counters, prefixes of harmless new names, words of errors, factors.
GRAPH_IDENTITY = ("user_id", "session_id", "thread_id", "graph_id", "run_id", "conversation_id", "agent_id", "workflow_id", "trace_id")
GRAPH_COUNTERS = ("step_count", "iteration_count", "turn_count", "message_count", "retry_count", "attempt_count", "total_steps", "superstep")
HARMLESS = ("_", "debug_", "log_", "timestamp")
BROKEN = (
    "corrupt", "invalid state", "state mismatch", "inconsistent", "integrity", "schema violation", "type error", "key error",
    "missing key", "unexpected type", "deserialization", "serialization", "state_error", "checkpoint", "invalid value", "malformed",
)
GROWTH, JUMP = 10, 100
#: agents' states. Orders of a status, names that only grow, of identities, of security, of fields that may change fast.
PROGRESSIONS = {
    "status": ("pending", "processing", "shipped", "delivered", "completed"), "order_status": ("pending", "processing", "shipped", "delivered", "completed"), "state": ("created", "active", "suspended", "closed", "archived"),
    "workflow_status": ("draft", "review", "approved", "published"), "ticket_status": ("open", "in_progress", "resolved", "closed"),
}
GROWING = ("version", "revision", "build_number", "sequence", "last_login", "last_modified", "last_updated", "updated_at", "last_seen", "last_activity")
IDENTITY, STABLE = ("first_name", "last_name", "name", "username", "display_name"), ("email", "user_id", "account_id", "id")
SECURITY = (
    "authenticated", "enabled", "active", "verified", "locked", "authorized", "valid", "approved", "is_admin", "is_active", "is_verified", "is_enabled", "is_locked", "is_authorized",
    "has_access", "is_valid", "confirmed", "is_confirmed",
)
FAST = ("counter", "count", "iteration", "step", "progress", "timestamp", "updated_at", "last_seen", "version")
GRADES = {"A": (90, 100), "A+": (97, 100), "A-": (90, 93), "B": (80, 89), "B+": (87, 89), "B-": (80, 83), "C": (70, 79), "D": (60, 69), "F": (0, 59)}
IMMUNE = ("type_drift", "monotonic_regression", "sign_flip", "status_regression", "data_loss", "content_replacement", "identity_mutation", "regression_nullification")
#: Seconds and changes of a field that make it fast; changes a second, and fields, of a rapid change.
WINDOW_S, FAST_CHANGES, RATE, RAPID = 5.0, 10, 20, 5


def _in(column: str, names) -> str:
    return f"{column} IN ({', '.join(repr(n) for n in names)})"


def _holds(column: str, names) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in names) + ")"


# Rules are plain SQL over the columns of ``compared``, so that the checks run the same conditions in another engine.
_NUM = "('int', 'float')"
_ANY = "('int', 'float', 'bool')"
SAME = f"((kind IN {_ANY} AND p_kind IN {_ANY} AND num = p_num) OR (kind = p_kind AND kind NOT IN {_ANY} AND txt = p_txt))"
_N = f"kind IN {_NUM} AND p_kind IN {_NUM}"
_S, _L, _D = ("kind = '{0}' AND p_kind = '{0}'".format(k) for k in ("str", "list", "dict"))

#: Kinds of a fault of a graph state, the first that holds.
GRAPH_FAULT = f"""CASE WHEN kind IS NULL THEN 'field_deletion' WHEN p_kind IS NULL THEN NULL WHEN p_kind <> 'null' AND kind = 'null' THEN 'null_injection'
WHEN p_kind <> 'null' AND kind <> p_kind THEN 'type_change' WHEN p_size > 0 AND size > p_size * {GROWTH} THEN 'value_explosion'
WHEN {_L} AND size < p_size AND p_size >= 2 THEN 'list_shrinkage' WHEN {_holds("lower(path)", GRAPH_IDENTITY)} AND p_kind <> 'null' AND kind <> 'null' AND NOT same THEN 'identity_mutation'
WHEN {_holds("lower(path)", GRAPH_COUNTERS)} AND num < p_num THEN 'counter_decrease' WHEN p_num <> 0 AND abs(num) > abs(p_num) * {JUMP} THEN 'value_jump' END"""


def _status() -> str:
    def place(column: str, names) -> str:
        return f"CASE trim(lower({column})) " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END"

    return "CASE " + " ".join(f"WHEN contains(lower(path), '{k}') THEN {place('txt', v)} < {place('p_txt', v)}" for k, v in PROGRESSIONS.items()) + " ELSE FALSE END"


#: (issue, severity, condition) of a path that both states have; an issue may come from several conditions.
FIELD_ISSUES = (
    ("data_loss", "high", "p_kind <> 'null' AND kind = 'null'"),
    ("type_drift", "high", f"p_kind <> 'null' AND kind <> 'null' AND kind <> p_kind AND NOT (kind IN {_ANY} AND p_kind IN {_ANY})"),
    ("sign_flip", "high", f"{_N} AND p_num > 0 AND num < 0"),
    ("extreme_magnitude_change", "medium", f"{_N} AND NOT (p_num > 0 AND num < 0) AND p_num <> 0 AND (abs(num) > abs(p_num) * 5 OR abs(num) * 10 < abs(p_num))"),
    ("monotonic_regression", "high", f"{_N} AND {_holds('lower(path)', GROWING)} AND num < p_num"),
    ("security_boolean_flip", "high", f"kind = 'bool' AND p_kind = 'bool' AND {_holds('lower(path)', SECURITY)}"),
    ("string_cleared", "high", f"{_S} AND p_size > 5 AND size = 0"),
    ("string_truncated", "medium", f"{_S} AND p_size > 20 AND size > 0 AND size * 5 < p_size"),
    ("content_replacement", "medium", f"{_S} AND p_size > 5 AND size > 5 AND all_words > 3 AND shared_words * 10 < all_words"),
    ("status_regression", "high", f"{_S} AND {_status()}"),
    ("monotonic_regression", "high", f"{_S} AND {_holds('lower(path)', GROWING)} AND txt < p_txt"),
    ("data_loss", "high", f"{_L} AND p_size > 0 AND size = 0"),
    ("data_loss", "medium", f"{_L} AND size > 0 AND size * 2 < p_size"),
    ("duplicate_items", "high", f"{_L} AND repeats"),
    ("data_loss", "medium", f"{_D} AND lost_keys > 0 AND lost_keys * 2 > p_size"),
)
#: (issue, severity, condition) of a path of the later state, whatever the one before; of its top level only.
TOP_ISSUES = (
    ("type_drift", "high", f"p_kind <> 'null' AND kind <> 'null' AND kind <> p_kind AND NOT ({_N})"),
    ("domain_violation", "medium", f"path = 'age' AND NOT coalesce(kind IN {_ANY} AND num >= 0 AND num <= 150, FALSE)"),
    ("domain_violation", "medium", f"path = 'price' AND NOT coalesce(kind IN {_ANY} AND num >= 0, FALSE)"),
    ("domain_violation", "medium", f"path = 'percentage' AND NOT coalesce(kind IN {_ANY} AND num >= 0 AND num <= 100, FALSE)"),
    ("domain_violation", "medium", "path = 'email' AND NOT coalesce(kind = 'str' AND {matches}(txt, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}$'), FALSE)"),
    ("domain_violation", "medium", "path = 'url' AND NOT coalesce(kind = 'str' AND {matches}(txt, '^https?://[a-zA-Z0-9][-a-zA-Z0-9]*([.][a-zA-Z0-9][-a-zA-Z0-9]*)+(/.*)?$'), FALSE)"),
    ("domain_violation", "medium", "path = 'phone' AND NOT coalesce(kind = 'str' AND {matches}(txt, '([0-9][^0-9]*){{10}}'), FALSE)"),
    ("domain_violation", "medium", "path = 'uuid' AND NOT coalesce(kind = 'str' AND size = 36 AND length(replace(txt, '-', '')) = 32, FALSE)"),
    ("hallucinated_reference", "high", "right(path, 3) = '_id' AND kind = 'str' AND NOT coalesce(same, FALSE)"),
)


def _listed(issues, matches: str, extra: str) -> list[str]:
    return [f"CASE WHEN {extra} AND ({c.format(matches=matches) if '{matches}' in c else c}) THEN '{name}:{severity}' END" for name, severity, c in issues]


def both_rules(matches: str) -> str:
    """Issues of a path that both states have, as a list of texts (issue:severity), with nulls for those that don't hold."""
    return ", ".join(_listed(FIELD_ISSUES, matches, "kind IS NOT NULL AND p_kind IS NOT NULL AND NOT same"))


def top_rules(matches: str) -> str:
    """Issues of a top-level path of the later state, as such a list."""
    return ", ".join(_listed(TOP_ISSUES, matches, "lvl = 0 AND kind IS NOT NULL"))


def field_rules(matches: str) -> str:
    """All issues of a row as such a list."""
    return f"{both_rules(matches)}, {top_rules(matches)}"


#: Columns of a path in two successive states, which the rules speak of.
PATH = ("lvl", "path", "low", "kind", "p_kind", "size", "p_size", "num", "p_num", "txt", "p_txt", "leaf", "p_leaf", "repeats", "lost_keys", "same")
_FIELD = re.compile(rf"'[^']*'|\b({'|'.join((*PATH, 'shared_words', 'all_words', 'fast'))})\b(?!\()")


def _of(row: str, rule: str) -> str:
    """A rule on columns as one on the fields of a struct; words in quotes stay."""
    return _FIELD.sub(lambda m: f"{row}.{m[1]}" if m[1] else m[0], rule.replace("lower(path)", "low"))


def _struct(row: str, names, **more: str) -> str:
    """A struct of some fields of another, and of more."""
    return "struct(" + ", ".join([f"{row}.{n} AS {n}" for n in names] + [f"{e} AS {n}" for n, e in more.items()]) + ")"


def _found(issues) -> str:
    return f"concat_ws(';', {', '.join(_listed(issues, 'regexp_like', 'TRUE'))})"


def _both_found() -> str:
    """What ``both_rules`` finds, as one text; of rules on a kind only those of the row's kind are read."""
    kinds = (_N, _S, _L, _D, "kind = 'bool' AND p_kind = 'bool'")
    by_kind = " ".join(f"WHEN {k} THEN {_found([x for x in FIELD_ISSUES if x[2].startswith(k)])}" for k in kinds)
    return f"CASE WHEN kind IS NULL OR p_kind IS NULL OR coalesce(same, TRUE) THEN '' {by_kind} ELSE {_found([x for x in FIELD_ISSUES if not x[2].startswith(kinds)])} END"


def _top_found() -> str:
    """What ``top_rules`` finds, as one text; rules on one name are read where a path has such a name."""
    named = [x for x in TOP_ISSUES if x[2].startswith("path = ")]
    has_name = _in("path", [x[2].split("'")[1] for x in named])
    return f"CASE WHEN lvl <> 0 OR kind IS NULL THEN '' ELSE concat_ws(';', nullif({_found([x for x in TOP_ISSUES if x not in named])}, ''), CASE WHEN {has_name} THEN nullif({_found(named)}, '') END) END"


def _members(value: str) -> str:
    """The members of an object; null for another value."""
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def _leaves(path: str, at: str, value: str, depth: int, level: int = 1) -> str:
    """The leaves inside an object, by path: objects inside objects are opened ``depth`` levels deep. ``at`` tells paths apart whose names hold dots."""
    e = f"e{level}"
    key, place, inner = f"concat_ws('.', {path}, {e}.key)", f"concat({at}, length({e}.key), ':', {e}.key)", f"{e}.value"
    leaf = f"array(struct(1 as lvl, {place} as at, {key} as path, true as leaf, {inner} as val))"
    each = leaf if level == depth else f"if(coalesce(size({_members(inner)}) > 0, false), {_leaves(key, place, inner, depth, level + 1)}, {leaf})"
    return f"flatten(transform(map_entries({_members(value)}), {e} -> {each}))"


def _paths(depth: int) -> str:
    """The places of a state ``v``, each with what is compared of its value."""
    one = "struct({0} as lvl, {1} as at, e.key as path, {2} as leaf, e.value as val)".format
    top, inside = "concat('0', e.key)", "concat('1', length(e.key), ':', e.key)"
    closed = f"array({one(0, top, 'true')})"
    each = f"if(coalesce(size({_members('e.value')}) > 0, false), concat(array({one(0, top, 'false')}), {_leaves('e.key', inside, 'e.value', depth)}), if(contains(e.key, '.'), array({one(0, top, 'true')}, {one(1, inside, 'true')}), {closed}))" if depth else closed
    place = ("lvl", "at", "path", "leaf")
    kind = """case when x.t = 'STRING' then 'str' when x.t = 'BIGINT' then 'int' when x.t = 'BOOLEAN' then 'bool' when x.t = 'VOID' then 'null' when x.t = 'DOUBLE' then 'float' when startswith(x.t, 'ARRAY') then 'list'
        when startswith(x.t, 'DECIMAL') then if(x.t rlike '^DECIMAL[(](19|[23][0-9]),0[)]$', 'int', 'float') else 'dict' end"""
    rows = f"flatten(transform(map_entries({_members('v')}), e -> {each}))"
    rows = f"transform({rows}, x -> {_struct('x', (*place, 'val'), t='schema_of_variant(x.val)')})"
    rows = f"transform({rows}, x -> {_struct('x', (*place, 'val', 't'), kind=kind)})"
    txt = "case x.kind when 'str' then try_variant_get(x.val, '$', 'string') when 'null' then 'null' when 'list' then to_json(x.val) when 'dict' then to_json(x.val) end"
    num, keys, items = f"case when x.kind in {_ANY} then try_variant_get(x.val, '$', 'double') end", f"case when x.kind = 'dict' then map_keys({_members('x.val')}) end", "case when x.kind = 'list' then try_variant_get(x.val, '$', 'array<variant>') end"
    rows = f"transform({rows}, x -> {_struct('x', (*place, 't', 'kind'), txt=txt, num=num, keys=keys, items=items)})"
    # Items of a list that begins with an object: the first name that all its objects have tells them apart.
    ids = lambda c: f"transform(o, i -> to_json(try_variant_get(i, '$.{c}', 'variant')))"
    told = " ".join(f"when forall({ids(c)}, i -> i is not null) then size(array_distinct({ids(c)})) < size(o)" for c in ("id", "item_id", "key", "name"))
    repeats = f"coalesce(x.kind = 'list' and schema_of_variant(get(x.items, 0)) like 'OBJECT%' and exists(array(filter(x.items, i -> schema_of_variant(i) like 'OBJECT%')), o -> case {told} else false end), false)"
    size = "case x.kind when 'str' then length(x.txt) when 'list' then size(x.items) when 'dict' then size(x.keys) else 0 end"
    return f"transform({rows}, x -> struct(x.at, {_struct('x', ('lvl', 'path', 'leaf', 'kind', 'txt', 'num', 'keys'), low='lower(x.path)', size=size, repeats=repeats)} as x))"


def _mapped(s: DataFrame, depth: int) -> DataFrame:
    """States with ``f``, the map of their paths by place, and ``nested``: whether an object in them is opened."""
    f = F.map_from_entries(F.coalesce(F.expr(_paths(depth)), F.array()))
    return s.withColumn("v", F.try_parse_json("state")).withColumn("f", f).drop("state", "v").withColumn("nested", F.exists(F.map_values("f"), lambda x: ~x["leaf"]))


def fields(s: DataFrame, depth: int = DEPTH) -> DataFrame:
    """A row for each path of each state: lvl 0 has top-level names with their values, lvl 1 the leaves inside opened objects (none with a depth of 0).

    A top-level value that is no object to open is a ``leaf``, and stands for both levels in one row; one whose name
    holds a dot has two, since leaves inside an object may have the same path.
    """
    return _mapped(s, depth).select("trace_id", "step", "ts", "nested", F.explode(F.map_values("f")).alias("x")).select("trace_id", "step", "ts", "nested", "x.*")


def compared(s: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(trace_id, ord, step, ts, p_ts, n_before, either, rows) of each state that follows another: ``rows`` has a struct of PATH for each path of the two.

    Its kind is null where the path is gone, p_kind where it is new. ``either``: one of them has opened objects; without such there are no rows
    of lvl 1. States are dealt by trace to as many tasks as their number asks for, so that what a task sorts stays as it is.
    """
    seq = W.partitionBy("trace_id").orderBy("step")
    s = s.repartition(max(s.sparkSession.sparkContext.defaultParallelism, -(-s.count() // ROWS)), "trace_id")
    s = s.withColumns({"ord": F.row_number().over(seq), "p_ts": F.lag("ts").over(seq)})
    s = _mapped(s, depth).withColumn("p", F.lag(F.struct("f", "nested")).over(seq)).filter("ord > 1").withColumn("either", F.expr("nested or p.nested"))
    met = "filter(map_values(map_zip_with(p.f, f, (k, a, b) -> struct(a as a, b as b))), z -> coalesce(z.b.lvl, z.a.lvl) = 0 or either)"
    sides = {n: f"z.b.{n}" for n in ("kind", "size", "num", "txt", "leaf")}
    cols = {n: f"coalesce(z.b.{n}, z.a.{n})" for n in ("lvl", "path", "low")} | sides | {f"p_{n}": f"z.a.{n}" for n in sides} | {"repeats": "z.b.repeats", "lost_keys": "size(array_except(z.a.keys, z.b.keys))"}
    rows = f"transform(transform({met}, z -> {_struct('z', (), **cols)}), r -> {_struct('r', PATH[:-1], same=_of('r', SAME))})"
    return s.select("trace_id", "ord", "step", "ts", "p_ts", F.expr("size(filter(map_values(p.f), x -> x.lvl = 0))").alias("n_before"), "either", F.expr(rows).alias("rows"))


def graph_signals(s: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """(trace_id, step, key, kind) of graph states, and of failed nodes (trace_id, node_id, status, superstep, error, outputs) whose error speaks of a broken state."""
    rows = compared(s.drop("ts").withColumn("ts", F.lit(0.0)), 0)
    faults = f"filter(transform(rows, r -> struct(r.path as key, {_of('r', GRAPH_FAULT)} as kind)), x -> x.kind is not null)"
    harmless = " or ".join(f"startswith(r.path, '{p}')" for p in HARMLESS)
    rows = rows.withColumns({"faults": F.expr(faults), "new": F.expr(f"case when n_before >= 3 then array_sort(transform(filter(rows, r -> r.p_kind is null and not ({harmless})), r -> r.path)) end")})
    more = F.when(F.size("new") >= 2, F.array(F.struct(F.array_join("new", ",").alias("key"), F.lit("field_injection").alias("kind"))))
    out = rows.select("trace_id", "step", F.explode(F.concat("faults", F.coalesce(more, F.array().cast("array<struct<key:string,kind:string>>")))).alias("x")).select("trace_id", "step", "x.key", "x.kind")
    if n is None:
        return out
    told = F.lower(F.concat(F.coalesce("error", F.lit("")), F.lit(" "), F.coalesce("outputs", F.lit(""))))
    bad = n.filter((F.col("status") == "failed") & reduce(lambda a, b: a | b, [told.contains(w) for w in BROKEN]))
    return out.unionByName(bad.select("trace_id", F.col("superstep").alias("step"), F.col("node_id").cast("string").alias("key"), F.lit("node_error").alias("kind")))


def graph_corruption(signals: DataFrame, traces: DataFrame) -> DataFrame:
    """(trace_id, signals, kinds, severity, confidence) of every trace of ``traces``."""
    g = signals.groupBy("trace_id").agg(F.count("*").alias("signals"), F.array_sort(F.collect_set("kind")).alias("k"))
    g = traces.select("trace_id").distinct().join(g, "trace_id", "left").withColumn("signals", F.coalesce("signals", F.lit(0)))
    has = lambda *kinds: F.arrays_overlap("k", F.array(*[F.lit(x) for x in kinds]))
    severity = F.when(F.col("signals") == 0, "none").when(has("type_change", "field_deletion", "identity_mutation", "node_error"), "severe").when(has("null_injection", "counter_decrease", "list_shrinkage"), "moderate").otherwise("minor")
    confidence = F.round(F.when(F.col("signals") == 0, F.lit(0.85)).otherwise(F.least(F.lit(0.95), F.lit(0.6) + F.col("signals") * F.lit(0.1))), 4)
    return g.select("trace_id", "signals", F.coalesce(F.array_join("k", ","), F.lit("")).alias("kinds"), severity.alias("severity"), confidence.alias("confidence"))


def issues(s: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(trace_id, step, issue, severity, field) of agents' states, without those of fields that change fast.

    Issues of opened objects come beside those of the whole, so that a top-level value may have its issue twice. Names in
    ``field`` are in order. An issue that is not IMMUNE is left out if one of its fields is FAST by name, or was
    judged more than FAST_CHANGES times within WINDOW_S seconds; top-level truth values are never too fast.
    """
    s = compared(s, depth)
    # Paths that no rule below asks for are left out before the rules are read; issues are one text, empty if there are none.
    ends = ("start_date", "end_date", "min_value", "max_value")
    read_ = ("score", "grade", *ends, "age", "price", "percentage", "email", "url", "phone", "uuid")
    asked = _of("r", f"not coalesce(same, false) or not kind <=> p_kind or {_in('path', read_)} or {_in('lower(path)', STABLE)} or (lvl = 0 and kind = 'str' and size > 10)")
    words = "array_distinct(filter(split(lower({0}), '[ \\\\t-\\\\r]+'), x -> x <> ''))".format
    # What the rules on words ask for.
    both = _of("r", "kind = 'str' and p_kind = 'str' and not same and size > 5 and p_size > 5")
    worded = f"transform(filter(rows, r -> {asked}), r -> {_struct('r', PATH, w=f'case when {both} then {words("r.txt")} end', p_w=f'case when {both} then {words("r.p_txt")} end')})"
    counted = f"transform({worded}, r -> {_struct('r', PATH, shared_words='size(array_intersect(r.w, r.p_w))', all_words='size(array_union(r.w, r.p_w))')})"
    kept_ = ("lvl", "path", "low", "kind", "p_kind", "size", "num", "txt")
    told = {"leaf": "coalesce(r.leaf, false)", "p_leaf": "coalesce(r.p_leaf, false)", "same": "coalesce(r.same, false)", "fast": _of("r", _holds("lower(path)", FAST)), "found": _of("r", _both_found()), "of_top": _of("r", _top_found())}
    s = s.withColumn("rows", F.expr(f"transform({counted}, r -> {_struct('r', kept_, **told)})"))
    # A top-level row stands for the leaves too, with what of its two values is a leaf.
    top_ = f"transform(filter(rows, r -> r.lvl = 0), r -> {_struct('r', (*kept_, 'same', 'fast'), found="concat_ws(';', nullif(r.found, ''), nullif(r.of_top, ''))")})"
    inner = {"kind": "if(r.lvl = 1 or r.leaf, r.kind, null)", "p_kind": "if(r.lvl = 1 or r.p_leaf, r.p_kind, null)", "size": "r.size", "num": "r.num", "txt": "r.txt", "same": "r.same and (r.lvl = 1 or (r.leaf and r.p_leaf))", "fast": "r.fast", "found": "if(r.lvl = 1 or (r.leaf and r.p_leaf), r.found, '')"}
    below = f"transform(filter(rows, r -> r.lvl = 1 or ((r.leaf or r.p_leaf) and not contains(r.path, '.'))), r -> {_struct('r', ('lvl', 'path', 'low'), **inner)})"
    levels = f"if(either, array(struct(0 as lvl, {top_} as rows), struct(1 as lvl, {below} as rows)), array(struct(0 as lvl, {top_} as rows)))" if depth else f"array(struct(0 as lvl, {top_} as rows))"
    s = s.select("trace_id", "ord", "step", "ts", "p_ts", F.explode(F.expr(levels)).alias("x")).select("trace_id", "ord", "step", "ts", "p_ts", "x.lvl", "x.rows")
    names = lambda c: F.expr(f"array_sort(transform(filter(rows, r -> {_of('r', c)}), r -> r.path))")
    last = lambda c, v: F.expr(f"array_max(transform(filter(named, r -> {_of('r', c)}), r -> r.{v}))")
    common = "kind is not null and p_kind is not null"
    number = f"kind in {_ANY}"
    none = F.array().cast("array<string>")
    s = s.withColumns({
        "named": F.expr(f"filter(rows, r -> {_in('r.path', ('score', 'grade', *ends))})"), "regressed": F.expr("exists(rows, r -> contains(r.found, 'status_regression:high'))"),
        # Too few paths for a rapid change have no list of them.
        "rapid": (F.col("lvl") == 0) & (F.size("rows") > RAPID) & (F.size("rows") / F.greatest(F.col("ts") - F.col("p_ts"), F.lit(0.001)) > RATE),
    })
    pair = s.select(
        "trace_id", "ord", "step", "ts", "p_ts", "lvl", names("kind is null and not fast").alias("lost"), "regressed", F.when(F.col("regressed"), names(f"{common} and kind = 'null' and p_kind <> 'null'")).alias("nulled"),
        names(f"{common} and {_in('lower(path)', IDENTITY)} and not same").alias("renamed"), F.expr(f"exists(rows, r -> {_of('r', f'{common} and {_in("lower(path)", STABLE)} and same')})").alias("stable"),
        F.when(F.col("rapid"), names("not fast and not same and (coalesce(kind, 'null') <> 'null' or coalesce(p_kind, 'null') <> 'null')")).otherwise(none).alias("changed"),
        last(f"path = 'score' and {number}", "num").alias("score"), last("path = 'grade' and kind = 'str'", "txt").alias("grade"),
        *[last(f"path = '{p}' and {number}", "num").alias(f"n_{p}") for p in ends], *[last(f"path = '{p}' and kind = 'str'", "txt").alias(f"t_{p}") for p in ends],
        F.expr("array_sort(transform(filter(rows, r -> r.lvl = 0 and r.kind = 'str' and r.size > 10), r -> struct(r.path as path, r.txt as txt)))").alias("long"),
        F.expr("transform(filter(rows, r -> r.found <> ''), r -> struct(r.found as found, r.path as path, r.kind = 'bool' and not contains(r.path, '.') as truth))").alias("single"),
    )
    expected = F.expr("case upper(trim(grade)) " + " ".join(f"when '{g}' then not (score between {lo} and {hi})" for g, (lo, hi) in GRADES.items()) + " else false end")
    one = lambda name, severity, cond, list_: F.when(cond, F.array(F.struct(F.lit(f"{name}:{severity}").alias("x"), list_.alias("names")))).otherwise(F.array().cast("array<struct<x:string,names:array<string>>>"))
    fixed = lambda *n: F.array(*[F.lit(x) for x in n])
    after = lambda a, b: F.coalesce(F.col(f"n_{a}") > F.col(f"n_{b}"), F.lit(False)) | F.coalesce(F.col(f"t_{a}") > F.col(f"t_{b}"), F.lit(False))
    top = F.col("lvl") == 0
    rate = F.size("changed") / F.greatest(F.col("ts") - F.col("p_ts"), F.lit(0.001))
    copies = F.expr("flatten(transform(long, (a, i) -> transform(filter(slice(long, i + 2, size(long)), b -> b.txt = a.txt), b -> struct('suspicious_value_copy:low' as x, array(a.path, b.path) as names))))")
    more = F.concat(
        one("field_disappeared", "high", F.size("lost") >= 3, F.slice("lost", 1, 3)), one("cross_field_inconsistency", "high", F.coalesce(expected, F.lit(False)), fixed("score", "grade")),
        one("identity_mutation", "high", (F.size("renamed") >= 2) & F.col("stable"), F.col("renamed")),
        F.when(F.col("regressed"), F.expr("transform(nulled, n -> struct('regression_nullification:medium' as x, array(n) as names))")).otherwise(F.array().cast("array<struct<x:string,names:array<string>>>")),
        one("cross_field_inconsistency", "high", top & after("start_date", "end_date"), fixed("start_date", "end_date")), one("cross_field_inconsistency", "high", top & after("min_value", "max_value"), fixed("min_value", "max_value")),
        one("suspicious_rapid_changes", "medium", top & (rate > RATE) & (F.size("changed") > RAPID), F.slice("changed", 1, 5)), F.when(top, copies).otherwise(F.array().cast("array<struct<x:string,names:array<string>>>")),
    )
    all_ = F.concat(F.expr("flatten(transform(single, s -> transform(split(s.found, ';'), x -> struct(x as x, array(s.path) as names, s.truth as truth))))"), F.transform(more, lambda y: F.struct(y["x"].alias("x"), y["names"].alias("names"), F.lit(False).alias("truth"))))
    found = pair.select("trace_id", "ord", "step", "ts", "lvl", F.posexplode(all_).alias("pos", "y")).select("trace_id", "ord", "step", "ts", "lvl", "pos", "y.*")
    found = found.withColumns({"issue": F.split_part("x", F.lit(":"), F.lit(1)), "severity": F.split_part("x", F.lit(":"), F.lit(2)), "field": F.array_join("names", ",")}).withColumn("immune", F.expr(_in("issue", IMMUNE)))
    # How often a field was judged in the seconds before: those at one time count one after another.
    judged = found.withColumn("name", F.explode(F.when(F.col("immune"), F.array("field")).otherwise(F.col("names")))).withColumn("fast", F.expr(_holds("lower(name)", FAST)))
    judged = judged.withColumn("counted", F.expr("not immune and not fast and not truth"))
    # It was judged more often if the judgement so many before it lies within the time; those without a time are at one time.
    judged = judged.withColumn("us", F.coalesce(F.round(F.col("ts") * 1000000).cast("long"), F.lit(-(2**62))))
    before = F.lag("us", FAST_CHANGES).over(W.partitionBy("trace_id", "name", "counted").orderBy("us", "ord", "lvl", "issue", "field"))
    judged = judged.withColumn("quick", F.expr("not immune and fast") | (F.col("counted") & F.coalesce(before >= F.col("us") - int(WINDOW_S * 1000000), F.lit(False))))
    kept = judged.groupBy("trace_id", "ord", "step", "lvl", "pos", "issue", "severity", "field").agg(F.bool_or("quick").alias("quick"))
    return kept.filter("not quick").select("trace_id", "step", "issue", "severity", "field")


SEVERITIES = {"low": (0.1, 0.4, 20), "medium": (0.25, 0.6, 45), "high": (0.4, 0.8, 70)}
_WORST = "CASE WHEN high > 0 THEN {0} WHEN medium > 0 THEN {1} ELSE {2} END"
_CONFIDENCE = f"least(0.99e0, {_WORST.format('0.8e0', '0.6e0', '0.4e0')} * 0.4e0 + least(1e0, low * 0.1e0 + medium * 0.25e0 + high * 0.4e0) * 0.3e0 + least(1e0, kinds / 4e0) * 0.15e0 + least(0.3e0, issues * 0.05e0))"


def corruption(found: DataFrame) -> DataFrame:
    """(trace_id, issues, kinds, low, medium, high, score, confidence) of each trace with an issue."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    g = found.groupBy("trace_id").agg(F.count("*").alias("issues"), F.countDistinct("issue").alias("kinds"), n("low"), n("medium"), n("high"))
    return g.select("*", F.expr(_WORST.format(70, 45, 20)).cast("int").alias("score"), F.round(F.expr(_CONFIDENCE), 4).alias("confidence"))


_FIELDS = f"""{STATES}, s AS (SELECT trace_id, step, ts, CAST(state AS JSON) AS j, row_number() OVER (PARTITION BY trace_id ORDER BY step) AS ord FROM states),
z AS (SELECT *, len(list_filter(json_keys(j), lambda k: json_type(j, '$.' || k) = 'OBJECT' AND len(json_keys(j, '$.' || k)) > 0)) > 0 AS nested, len(json_keys(j)) AS n_keys FROM s),
e AS (SELECT trace_id, ord, 0 AS lvl, t.key AS path, t.value, t.type FROM z, json_each(z.j) t UNION ALL SELECT trace_id, ord, 1, fullkey[3:], t.value, t.type FROM z, json_tree(z.j) t WHERE t.parent IS NOT NULL AND NOT contains(fullkey, '[') AND NOT (t.type = 'OBJECT' AND len(json_keys(t.value)) > 0)),
k AS (SELECT *, CASE WHEN type = 'NULL' THEN 'null' WHEN type IN ('BIGINT', 'UBIGINT') THEN 'int' WHEN type = 'DOUBLE' THEN 'float' WHEN type = 'VARCHAR' THEN 'str' WHEN type = 'BOOLEAN' THEN 'bool' WHEN type = 'ARRAY' THEN 'list' ELSE 'dict' END AS kind FROM e),
f AS MATERIALIZED (SELECT trace_id, ord, lvl, path, kind, CASE WHEN kind = 'str' THEN value->>'$' ELSE CAST(value AS VARCHAR) END AS txt, CASE WHEN kind IN ('int', 'float') THEN CAST(CAST(value AS VARCHAR) AS DOUBLE) WHEN kind = 'bool' THEN CAST(CAST(CAST(value AS VARCHAR) AS BOOLEAN) AS DOUBLE) END AS num,
 CASE kind WHEN 'str' THEN length(value->>'$') WHEN 'list' THEN json_array_length(value) WHEN 'dict' THEN len(json_keys(value)) ELSE 0 END AS size, CASE WHEN kind = 'dict' THEN json_keys(value) END AS keys,
 kind = 'list' AND coalesce(len(list_distinct(json_extract(value, '$[*].id'))) < json_array_length(value), FALSE) AND json_type(value, '$[0]') = 'OBJECT' AS repeats FROM k),
q AS (SELECT trace_id, z.ord, step, ts, lag(ts) OVER w AS p_ts, nested OR lag(nested) OVER w AS either, lag(n_keys) OVER w AS n_before FROM z WINDOW w AS (PARTITION BY trace_id ORDER BY ord)),
m AS (SELECT coalesce(b.trace_id, a.trace_id) AS trace_id, coalesce(b.ord, a.ord + 1) AS ord, coalesce(b.lvl, a.lvl) AS lvl, coalesce(b.path, a.path) AS path, b.* EXCLUDE (trace_id, ord, lvl, path), a.kind AS p_kind, a.txt AS p_txt, a.num AS p_num, a.size AS p_size, a.keys AS p_keys FROM f a FULL JOIN f b ON a.trace_id = b.trace_id AND a.lvl = b.lvl AND a.path = b.path AND a.ord + 1 = b.ord),
c AS MATERIALIZED (SELECT m.*, step, ts, p_ts, n_before, len(list_intersect(u, v)) AS shared_words, len(list_distinct(list_concat(u, v))) AS all_words, len(list_filter(p_keys, lambda x: NOT list_contains(keys, x))) AS lost_keys, {SAME} AS same
 FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(txt), '[ \\t-\\r]+'), lambda x: x <> '')) AS u, list_distinct(list_filter(regexp_split_to_array(lower(p_txt), '[ \\t-\\r]+'), lambda x: x <> '')) AS v FROM m) m JOIN q ON m.trace_id = q.trace_id AND m.ord = q.ord WHERE m.ord > 1 AND (lvl = 0 OR either))"""
_SIGNALS = f"""WITH {_FIELDS}, {NODES}, g AS (SELECT trace_id, step, path AS key, {GRAPH_FAULT} AS kind FROM c WHERE lvl = 0),
i AS (SELECT trace_id, step, string_agg(path, ',' ORDER BY path) AS key, 'field_injection' AS kind FROM c WHERE lvl = 0 AND p_kind IS NULL AND n_before >= 3 AND NOT ({" OR ".join(f"starts_with(path, '{p}')" for p in HARMLESS)}) GROUP BY 1, 2 HAVING count(*) >= 2),
h AS (SELECT trace_id, superstep AS step, CAST(node_id AS VARCHAR) AS key, 'node_error' AS kind FROM nodes WHERE status = 'failed' AND {_holds("lower(concat(error, ' ', outputs))", BROKEN)}),
signals AS (SELECT * FROM g WHERE kind IS NOT NULL UNION ALL SELECT * FROM i UNION ALL SELECT * FROM h)"""


@query("m8_state_signals", f"{_SIGNALS} SELECT * FROM signals")
def m8_signals(spark, d) -> DataFrame:
    return graph_signals(states(spark, d), nodes(spark, d))


@query("m8_state_corruption", f"""{_SIGNALS}, n AS (SELECT trace_id, count(*) AS signals, list_sort(list(DISTINCT kind)) AS k FROM signals GROUP BY 1) SELECT t.trace_id, coalesce(signals, 0) AS signals, coalesce(array_to_string(k, ','), '') AS kinds,
CASE WHEN k IS NULL THEN 'none' WHEN len(list_intersect(k, ['type_change', 'field_deletion', 'identity_mutation', 'node_error'])) > 0 THEN 'severe' WHEN len(list_intersect(k, ['null_injection', 'counter_decrease', 'list_shrinkage'])) > 0 THEN 'moderate' ELSE 'minor' END AS severity,
round(CASE WHEN k IS NULL THEN 0.85e0 ELSE least(0.95e0, 0.6e0 + signals * 0.1e0) END, 4) AS confidence FROM (SELECT DISTINCT trace_id FROM states) t LEFT JOIN n ON t.trace_id = n.trace_id""")
def m8_corruption(spark, d) -> DataFrame:
    return graph_corruption(graph_signals(states(spark, d), nodes(spark, d)), states(spark, d))


_NAMES = "list(path ORDER BY path) FILTER (WHERE {})"
_COMMON = "kind IS NOT NULL AND p_kind IS NOT NULL"
_EXPECTED = "coalesce(CASE upper(trim(grade)) " + " ".join(f"WHEN '{g}' THEN NOT (score BETWEEN {lo} AND {hi})" for g, (lo, hi) in GRADES.items()) + " ELSE FALSE END, FALSE)"
_ENDS = ", ".join(f"max(num) FILTER (WHERE path = '{p}' AND kind IN {_ANY}) AS n_{p}, max(txt) FILTER (WHERE path = '{p}' AND kind = 'str') AS t_{p}" for p in ("start_date", "end_date", "min_value", "max_value"))
_ISSUES = f"""WITH {_FIELDS}, d AS MATERIALIZED (SELECT * REPLACE (coalesce(same, FALSE) AS same), list_filter([{field_rules("regexp_matches")}], lambda x: x IS NOT NULL) AS found, {_holds("lower(path)", FAST)} AS fast FROM c),
p AS (SELECT trace_id, ord, step, ts, any_value(p_ts) AS p_ts, lvl, {_NAMES.format("kind IS NULL AND NOT fast")} AS lost, bool_or(list_contains(found, 'status_regression:high')) AS regressed, {_NAMES.format(f"{_COMMON} AND kind = 'null' AND p_kind <> 'null'")} AS nulled,
 {_NAMES.format(f"{_COMMON} AND {_in('lower(path)', IDENTITY)} AND NOT same")} AS renamed, count(*) FILTER (WHERE {_COMMON} AND {_in("lower(path)", STABLE)} AND same) AS stable, {_NAMES.format("NOT fast AND NOT same AND (coalesce(kind, 'null') <> 'null' OR coalesce(p_kind, 'null') <> 'null')")} AS changed,
 max(num) FILTER (WHERE path = 'score' AND kind IN {_ANY}) AS score, max(txt) FILTER (WHERE path = 'grade' AND kind = 'str') AS grade, {_ENDS} FROM d GROUP BY trace_id, ord, step, ts, lvl),
y AS (SELECT trace_id, ord, step, ts, lvl, 'field_disappeared:high' AS x, lost[1:3] AS names FROM p WHERE len(lost) >= 3 UNION ALL SELECT trace_id, ord, step, ts, lvl, 'cross_field_inconsistency:high', ['score', 'grade'] FROM p WHERE {_EXPECTED}
 UNION ALL SELECT trace_id, ord, step, ts, lvl, 'identity_mutation:high', renamed FROM p WHERE len(renamed) >= 2 AND stable > 0 UNION ALL SELECT trace_id, ord, step, ts, lvl, 'regression_nullification:medium', [unnest(nulled)] FROM p WHERE regressed
 UNION ALL SELECT trace_id, ord, step, ts, lvl, 'cross_field_inconsistency:high', ['start_date', 'end_date'] FROM p WHERE lvl = 0 AND (n_start_date > n_end_date OR t_start_date > t_end_date) UNION ALL SELECT trace_id, ord, step, ts, lvl, 'cross_field_inconsistency:high', ['min_value', 'max_value'] FROM p WHERE lvl = 0 AND (n_min_value > n_max_value OR t_min_value > t_max_value)
 UNION ALL SELECT trace_id, ord, step, ts, lvl, 'suspicious_rapid_changes:medium', changed[1:5] FROM p WHERE lvl = 0 AND len(changed) / greatest(ts - p_ts, 0.001e0) > {RATE} AND len(changed) > {RAPID}
 UNION ALL SELECT a.trace_id, a.ord, a.step, a.ts, 0, 'suspicious_value_copy:low', [a.path, b.path] FROM d a JOIN d b ON a.trace_id = b.trace_id AND a.ord = b.ord AND a.lvl = 0 AND b.lvl = 0 AND a.path < b.path AND a.kind = 'str' AND b.kind = 'str' AND a.size > 10 AND a.txt = b.txt),
r AS (SELECT trace_id, ord, step, ts, lvl, unnest(found) AS x, [path] AS names, kind = 'bool' AND NOT contains(path, '.') AS truth FROM d UNION ALL SELECT *, FALSE FROM y),
t AS MATERIALIZED (SELECT *, split_part(x, ':', 1) AS issue, split_part(x, ':', 2) AS severity, array_to_string(names, ',') AS field FROM r),
j AS (SELECT *, {_holds("lower(name)", FAST)} AS fast, NOT {_holds("lower(name)", FAST)} AND NOT truth AS counted FROM (SELECT *, unnest(names) AS name FROM t WHERE NOT {_in("issue", IMMUNE)})),
o AS (SELECT *, fast OR (counted AND count(*) OVER (PARTITION BY trace_id, name, counted ORDER BY CAST(round(ts * 1000000) AS BIGINT) RANGE BETWEEN {int(WINDOW_S * 1000000)} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY trace_id, name, counted, ts) + row_number() OVER (PARTITION BY trace_id, name, counted, ts ORDER BY ord, lvl, issue, field) > {FAST_CHANGES}) AS quick FROM j),
issues AS (SELECT trace_id, step, issue, severity, field FROM t WHERE {_in("issue", IMMUNE)} UNION ALL SELECT trace_id, step, issue, severity, field FROM o GROUP BY trace_id, step, lvl, issue, severity, field HAVING NOT bool_or(quick))"""


@query("k7_state_issues", f"{_ISSUES} SELECT * FROM issues")
def k7_issues(spark, d) -> DataFrame:
    return issues(states(spark, d))


@query("k7_corruption", f"""{_ISSUES}, g AS (SELECT trace_id, count(*) AS issues, count(DISTINCT issue) AS kinds, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'high') AS high FROM issues GROUP BY 1)
SELECT *, {_WORST.format(70, 45, 20)} AS score, round({_CONFIDENCE}, 4) AS confidence FROM g""")
def k7(spark, d) -> DataFrame:
    return corruption(issues(states(spark, d)))
