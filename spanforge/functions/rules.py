"""Rules on names, numbers and texts as Column functions, with the values that they rest on."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars for a million input and output tokens, and the context window, of each model, in order of lookup.
PRICES = {
    "gpt-4o": (2.50, 10.00, 128000), "gpt-4o-mini": (0.15, 0.60, 128000), "gpt-4-turbo": (10.00, 30.00, 128000), "gpt-4": (30.00, 60.00, 8192), "gpt-3.5-turbo": (0.50, 1.50, 16385),
    "o1": (15.00, 60.00, 200000), "o1-mini": (3.00, 12.00, 128000), "o1-pro": (150.00, 600.00, 200000), "claude-3-5-sonnet-20241022": (3.00, 15.00, 200000), "claude-3-5-haiku-20241022": (0.80, 4.00, 200000),
    "claude-3-opus-20240229": (15.00, 75.00, 200000), "claude-sonnet-4-20250514": (3.00, 15.00, 200000), "claude-opus-4-20250514": (15.00, 75.00, 200000), "claude-opus-4-5-20251101": (15.00, 75.00, 200000),
    "claude-sonnet-4-5-20251101": (3.00, 15.00, 200000), "gemini-1.5-pro": (1.25, 5.00, 2000000), "gemini-1.5-flash": (0.075, 0.30, 1000000), "gemini-2.0-flash": (0.10, 0.40, 1000000), "gemini-2.5-pro": (1.25, 10.00, 1000000),
    "mistral-large": (2.00, 6.00, 128000), "mistral-small": (0.20, 0.60, 32000), "codestral": (0.30, 0.90, 32000), "llama-3.1-405b": (3.00, 3.00, 128000), "llama-3.1-70b": (0.70, 0.80, 128000),
    "llama-3.1-8b": (0.10, 0.10, 128000), "llama-3.3-70b": (0.60, 0.60, 128000), "deepseek-v3": (0.27, 1.10, 64000), "deepseek-r1": (0.55, 2.19, 64000), "qwen-2.5-72b": (0.40, 0.40, 128000),
    "command-r-plus": (2.50, 10.00, 128000), "command-r": (0.15, 0.60, 128000),
}
#: Other names of models.
ALIASES = {
    "gpt-4o-2024-11-20": "gpt-4o", "gpt-4o-2024-08-06": "gpt-4o", "gpt-4o-2024-05-13": "gpt-4o", "gpt-4-turbo-2024-04-09": "gpt-4-turbo", "gpt-4-0125-preview": "gpt-4-turbo", "gpt-4-1106-preview": "gpt-4-turbo",
    "gpt-3.5-turbo-0125": "gpt-3.5-turbo", "claude-3-5-sonnet-latest": "claude-3-5-sonnet-20241022", "claude-3-5-haiku-latest": "claude-3-5-haiku-20241022", "claude-3-opus-latest": "claude-3-opus-20240229",
    "claude-sonnet-4-latest": "claude-sonnet-4-20250514", "claude-opus-4-latest": "claude-opus-4-20250514", "claude-opus-4.5": "claude-opus-4-5-20251101", "claude-opus-4-5-latest": "claude-opus-4-5-20251101",
    "claude-sonnet-4.5": "claude-sonnet-4-5-20251101", "claude-sonnet-4-5-latest": "claude-sonnet-4-5-20251101", "gemini-pro": "gemini-1.5-pro", "gemini-flash": "gemini-1.5-flash",
}
#: Context windows that the overflow rule looks up, in order.
WINDOWS = {
    "claude-3-opus": 200_000, "claude-3-sonnet": 200_000, "claude-3-haiku": 200_000, "claude-3.5-sonnet": 200_000, "claude-3.5-haiku": 200_000, "claude-4-opus": 1_000_000, "claude-4-sonnet": 200_000,
    "gpt-4": 128_000, "gpt-4-turbo": 128_000, "gpt-4o": 128_000, "gpt-3.5-turbo": 16_385, "gemini-pro": 1_000_000, "gemini-1.5-pro": 2_000_000, "default": 128_000,
}
#: What names of expensive, middle and cheap models hold.
TIERS = {
    "expensive": r"(?i)opus|o1(?:-pro|-preview)?|o3(?:-mini)?|gpt-4(?!o)(?:-turbo)?(?:-\d+)?$",
    "mid": r"(?i)sonnet|gpt-4o(?!-mini)|gemini[- ](?:\d+\.?\d*[- ])?pro",
    "cheap": r"(?i)haiku|gpt-4o-mini|gemini[- ](?:\d+\.?\d*[- ])?flash|gpt-3\.5",
}
#: What errors of each category say.
FAILURES = {
    "discovery": r"(?i)tool\s+not\s+found|unknown\s+tool|no\s+such\s+tool|tool\s+(?:does\s+not|doesn'?t)\s+exist|unrecognized\s+tool|method\s+not\s+found",
    "schema": r"(?i)schema\s+validation|invalid\s+arguments?|type\s+mismatch|required\s+field|missing\s+required|validation\s+error|invalid\s+param|unexpected\s+(?:argument|field|property)|wrong\s+type",
    "auth": r"(?i)unauthori[sz]ed|authentication\s+failed|auth(?:entication)?\s+error|permission\s+denied|access\s+denied|forbidden|invalid\s+(?:token|credential|api[_\s]?key)|expired\s+token",
    "connection": r"(?i)connection\s+refused|timeout|timed?\s*out|connect(?:ion)?\s+(?:error|failed)|ECONNREFUSED|ETIMEDOUT|host\s+(?:not\s+found|unreachable)|network\s+(?:error|unreachable)|server\s+(?:not\s+responding|unavailable)",
}
#: Risky actions, in order.
RISKS = (
    r"\bdelete\b", r"\bdrop\b", r"\brm\b", r"\bremove\b", r"\btransfer\b", r"\bdeploy\b", r"push\s+--force", r"\bforce[\s-]push\b", r"\bsend\s+email\b",
    r"\bexecute\s+payment\b", r"\bshutdown\b", r"\bkill\b", r"\btruncate\b", r"\bformat\b", r"\bpurge\b", r"\brollback\b", r"\brevoke\b",
)
#: Suffixes that a stem drops, in order.
SUFFIXES = ("ation", "ting", "ing", "ies", "ment", "ness", "able", "ible", "ive", "ous", "ful", "ed", "er", "es", "ly", "al", "s")
#: Endings of node names that do not name the node, taken off one after another.
ENDINGS = (
    r"(?i)\s+Round\s+[0-9]+$", r"[\s_-]*\(?[0-9]+\)?$", r"(?i)[\s_-]*v[0-9]+$", r"(?i)\s+Returns\s+to\s+\w+$",
    *[rf"(?i)\s+{w}$" for w in ("Wavers", "Proposes", "Reconsiders", "Agrees", "Confirms", "Finalizes", "Decides", "Concludes", "Offer", "Counter", "Response", "Answer", "Reply", "Repeat", "Escalates", "Round", "Turn", "Step", "Phase", "Iteration", "Initial", "Contaminated", "Updated", "Modified")],
)
#: Facts in texts, personal data and secrets.
NUMBER = r"[$€£¥]\s?[\d,]+(?:\.\d+)?|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d+(?:\.\d+)?%|\b\d[\d,]*(?:\.\d+)?\b"
URL, MAIL = r"https?://[^\s<>\"']+|www\.[^\s<>\"']+", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
NAMES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
PII = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z|]{2,}\b", "phone": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
SECRETS = {
    "aws_key": r"AKIA[0-9A-Z]{16}", "aws_secret": r"[A-Za-z0-9/+=]{40}", "github_token": r"ghp_[A-Za-z0-9]{36}", "openai_key": r"sk-[A-Za-z0-9]{48}", "anthropic_key": r"sk-ant-[A-Za-z0-9-]{95}",
    "generic_api_key": r"(?i)(api[_-]?key|apikey|secret|password|token)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{16,}[\"']?",
}
#: Of a task's length, the share by which an output may miss it.
TOLERANCE = 0.1


def first_of(cases: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first case that holds."""
    held = reduce(lambda w, c: w.when(c[0], c[1]), cases[1:], F.when(*cases[0]))
    return held if otherwise is None else held.otherwise(otherwise)


def model_tier(name: Column) -> Column:
    return first_of([(name.rlike(p), tier) for tier, p in TIERS.items()])


def context_window(name: Column) -> Column:
    """Of the model of that name, else of the first whose name is held, else the default."""
    n = F.lower(name)
    return first_of([(n == k, v) for k, v in WINDOWS.items()] + [(n.contains(k), v) for k, v in WINDOWS.items()], WINDOWS["default"])


def resolved_model(name: Column) -> Column:
    """An alias's model, the model itself, or the first that holds the name or is held by it; else the name."""
    n = F.lower(name)
    return first_of([(n == k, F.lit(v)) for k, v in ALIASES.items()] + [(n == k, n) for k in PRICES] + [(n.contains(k) | F.lit(k).contains(n), F.lit(k)) for k in PRICES], n)


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of a call, rounded half to even to six places; 0 for an unknown model."""
    price = lambda i: first_of([(model == k, F.lit(v[i])) for k, v in PRICES.items()], F.lit(0.0))
    return F.bround(tokens_in / 1e6 * price(0) + tokens_out / 1e6 * price(1), 6)


def failure_categories(text: Column) -> Column:
    """All categories that an error's text falls into, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in FAILURES.items()]))


def risk(text: Column) -> Column:
    """The text of the first risky action in the list that occurs; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?i)" + p, 0), F.lit("")) for p in RISKS])


def stem(word: Column) -> Column:
    """A word without the first suffix that leaves three letters; words of three letters stay."""
    n = F.length(word)
    cut = lambda s: F.substring(word, F.lit(1), n - len(s))
    return first_of([(n <= 3, word)] + [(word.endswith(s) & (n - len(s) >= 3), cut(s)) for s in SUFFIXES], word)


def node_name(name: Column) -> Column:
    return F.trim(reduce(lambda n, p: F.regexp_replace(n, p, ""), ENDINGS, F.trim(name)))


def normal_number(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[,$€£¥%\s]", "")


def same_magnitude(a: Column, b: Column) -> Column:
    """Whether two numbers are less than ten times apart; 0 is like no other, and of a negative and a positive the ratio is negative."""
    return F.when((a == 0) | (b == 0), False).otherwise(F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0)) < 10)


def claim_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def containment(claim: Column, source: Column) -> Column:
    """Share of the claim's words that the source holds; 1 for a claim without words, 0 for an empty text."""
    n = F.size(claim_words(claim))
    some = F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(claim_words(claim), claim_words(source))) / F.greatest(n, F.lit(1)))
    return F.when((F.length(claim) == 0) | (F.length(source) == 0), 0.0).otherwise(some)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, row by row of the usual table."""
    places = F.sequence(F.lit(1), F.size(b))

    def row(before: Column, x: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            diagonal, up, left = F.element_at(before, j) + 1, F.element_at(before, j + 1), F.element_at(now, -1)
            return F.array_append(now, F.when(F.element_at(b, j) == x, diagonal).otherwise(F.greatest(up, left)))

        return F.aggregate(places, F.array(F.lit(0)), cell)

    table = F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(table, -1))


def handoff_ends(name: Column) -> Column:
    """(source, target) around the first of ->, →, " to " and => in a handoff's name; the name and "unknown" without any."""
    low = F.lower(name)
    cut = lambda sep: F.struct(F.trim(F.split_part(low, F.lit(sep), F.lit(1))).alias("source"), F.trim(F.substring(low, F.instr(low, sep) + len(sep), F.length(low))).alias("target"))
    return first_of([(low.contains(sep), cut(sep)) for sep in ("->", "→", " to ", "=>")], F.struct(name.alias("source"), F.lit("unknown").alias("target")))


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names, to any depth of the schema."""

    def leaves(kind, path: tuple[str, ...]):
        for f in kind.fields:
            yield from leaves(f.dataType, (*path, f.name)) if f.dataType.typeName() == "struct" else [(*path, f.name)]

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())])
