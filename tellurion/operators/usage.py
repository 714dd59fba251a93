"""Operators on requests to language models and on text columns: cost, sessions, rollouts, scans, chunks, vectors.

Requests have session, turn, role, text, model, variant, tokens, latency_ms, failed, user and ms.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .telemetry import percentile

# --- normalisation and cost ----------------------------------------------------------------------------------

#: Attribute keys that carry a field, the first present counts.
GENAI_KEYS = {
    "provider": ("gen_ai.provider.name", "gen_ai.system"),
    "model": ("gen_ai.response.model", "gen_ai.request.model", "llm.model"),
    "input_tokens": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.prompt_tokens"),
    "output_tokens": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.completion_tokens"),
    "cache_read_tokens": ("gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_read_tokens"),
    "cache_write_tokens": ("gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_write_tokens"),
    "session_key": ("session.id", "gen_ai.conversation.id"),
    "user_key": ("user.id", "gen_ai.user.id"),
    "error_type": ("error.type",),
    "request_messages": ("gen_ai.input.messages", "gen_ai.request.messages"),
}
STATED_COST = "gen_ai.usage.cost"
NUMBERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


#: Token counts and the price of each, of the catalogues that normalise_spans() takes.
TOKEN_PRICES = {"input_tokens": "input_price", "output_tokens": "output_price", "cache_read_tokens": "cache_read_price", "cache_write_tokens": "cache_write_price"}


def normalise_spans(spans: DataFrame, attributes: str = "attributes", prefix: str = "custom.", pricing: DataFrame | None = None) -> DataFrame:
    """With pricing (provider, model and prices of TOKEN_PRICES) also priced_as and cost: what the span says it cost, else
    its tokens by the prices found for its model, null without either. Spans with any known model key: their fields by the first key present, token counts as numbers with their total, the
    status, names and number of the tools called in the request's messages, and attributes under `prefix` as a map."""
    first = lambda keys: F.coalesce(*(F.nullif(F.element_at(attributes, F.lit(k)), F.lit("")) for k in keys))
    out = spans.withColumns({name: first(keys) for name, keys in GENAI_KEYS.items()}).where("model is not null")
    out = out.withColumns({c: F.expr(f"coalesce(try_cast({c} as bigint), 0)") for c in NUMBERS})
    out = out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("status", F.when(F.col("error_type").isNotNull(), "error").otherwise("ok"))
    calls = F.flatten(F.transform(F.from_json("request_messages", "array<struct<tool_calls:array<struct<function:struct<name:string>>>>>"), lambda m: F.coalesce(m["tool_calls"], F.expr("cast(array() as array<struct<function:struct<name:string>>>)"))))
    out = out.withColumn("_calls", calls).withColumn("tool_calls", F.coalesce(F.size("_calls"), F.lit(0)).cast("bigint")).withColumn("tool_calls", F.greatest("tool_calls", F.lit(0).cast("bigint")))
    out = out.withColumn("tools", F.array_sort(F.array_distinct(F.filter(F.transform("_calls", lambda c: c["function"]["name"]), lambda n: n.isNotNull())))).drop("_calls")
    own = F.map_filter(attributes, lambda k, _: k.startswith(prefix))
    if pricing is not None:
        known = {t: p for t, p in TOKEN_PRICES.items() if p in pricing.columns}
        stated = F.expr(f"try_cast(element_at({attributes}, '{STATED_COST}') as decimal(38,10))")
        out = priced(out, pricing)
        out = out.withColumn("cost", F.coalesce(stated, F.when(F.col("priced_as").isNotNull(), cost(**known)))).drop(*known.values())
    return out.withColumn("properties", F.transform_keys(own, lambda k, _: F.substring(k, len(prefix) + 1, 1000)))


#: Version suffixes of model names.
DATE_SUFFIX = r"-(\d{4}-\d{2}-\d{2}|\d{8})$"
NUMBER_SUFFIX = r"-\d{3,}$"


def base_model(model: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(model), DATE_SUFFIX, ""), NUMBER_SUFFIX, "")


def priced(requests: DataFrame, pricing: DataFrame) -> DataFrame:
    """requests: provider, model. pricing: provider, model and prices, a catalogue of at most some thousand rows.

    Each distinct (provider, model) is matched once: exact, then base model, then the longest prefix that leaves a
    version suffix, then any provider by name or base model. Only that small table is joined to the requests.
    """
    wanted = requests.select("provider", "model").distinct()
    p = pricing.select(F.lower("provider").alias("p_provider"), F.lower("model").alias("p_model"), *(c for c in pricing.columns if c not in ("provider", "model")))
    name, own = F.lower("model"), F.lower("provider") == F.col("p_provider")
    rest = F.expr("substring(lower(model), length(p_model) + 1)")
    version = rest.rlike(r"^:") | rest.rlike(f"^(?:{DATE_SUFFIX[:-1]})$") | rest.rlike(r"^-\d{3,}")
    rank = (
        F.when(own & (name == F.col("p_model")), 0).when(own & (base_model("model") == F.col("p_model")), 1).when(own & name.startswith(F.col("p_model")) & version, 2)
        .when(name == F.col("p_model"), 3).when(base_model("model") == F.col("p_model"), 4)
    )
    # candidates share the first letters, so this is an equi-join of two small tables
    start = lambda c: F.substring(F.lower(c), 1, 3)
    pairs = wanted.withColumn("_s", start("model")).join(p.withColumn("_s", start("p_model")), "_s").withColumn("_rank", rank).where("_rank is not null")
    w = Window.partitionBy("provider", "model").orderBy("_rank", F.desc(F.length("p_model")), "p_provider")
    best = pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_s", "_rank", "_r", "p_provider").withColumnsRenamed({"provider": "_provider", "model": "_model", "p_model": "priced_as"})
    keys = F.col("provider").eqNullSafe(F.col("_provider")) & F.col("model").eqNullSafe(F.col("_model"))
    return requests.join(best, keys, "left").drop("_provider", "_model")


def cost(**tokens: str) -> Column:
    """Sum of tokens times price: cost(input_tokens='input_price', ...). Decimals."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(t).cast("decimal(18,0)") * F.col(p).cast("decimal(20,10)"), F.lit(0)) for t, p in tokens.items())).cast("decimal(38,10)")


def cost_by_model(requests: DataFrame) -> DataFrame:
    c = requests.groupBy("model").agg(F.sum("cost").alias("cost"), F.count("*").alias("requests"))
    return c.withColumn("pct", F.round(F.try_divide(F.col("cost").cast("double") * 100, F.sum("cost").over(Window.partitionBy()).cast("double")), 6))  # a row a model


def daily_cost(requests: DataFrame, *by: str) -> DataFrame:
    return requests.groupBy(F.to_date(F.timestamp_millis("ms")).alias("day"), *by).agg(F.sum("cost").alias("cost"), F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def model_metrics(requests: DataFrame, *by: str, exact: bool = False) -> DataFrame:
    """Latency percentiles come from mergeable summaries unless exact."""
    p = lambda q: F.round(percentile("latency_ms", q, exact), 6)
    return requests.groupBy("model", *by).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"), F.round(F.count_if("failed") * 100.0 / F.count("*"), 6).alias("error_pct"))


def hourly_sketches(requests: DataFrame) -> DataFrame:
    """Mergeable latency quantiles per model and hour."""
    hour = F.date_trunc("hour", F.timestamp_millis("ms")).alias("hour")
    return requests.groupBy("model", hour).agg(F.count("*").alias("requests"), F.kll_sketch_agg_bigint("latency_ms").alias("sketch"))


def merged_quantiles(hourly: DataFrame, *quantiles: float) -> DataFrame:
    merged = hourly.groupBy("model").agg(F.sum("requests").alias("requests"), F.kll_merge_agg_bigint("sketch").alias("s"))
    return merged.select("model", "requests", *(F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias(f"p{round(q * 100)}") for q in quantiles))


def user_metrics(requests: DataFrame) -> DataFrame:
    named = requests.where("user is not null and cast(user as string) <> ''")
    return named.groupBy("user").agg(F.count("*").alias("requests"), F.countDistinct("session").alias("sessions"), F.sum("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


def overview(requests: DataFrame, n: int = 5, exact: bool = True) -> DataFrame:
    count = F.countDistinct if exact else F.approx_count_distinct
    totals = requests.agg(F.count("*").alias("requests"), count("session").alias("sessions"), count("user").alias("users"), F.round(F.count_if("failed") / F.count("*"), 6).alias("error_rate"))
    best = requests.groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "model"))), lambda x: x["model"]), ",").alias("top_models"))
    return totals.crossJoin(best)  # one row each


def provider_latency(requests: DataFrame, limit_ms: float, window_ms: int, every_ms: int, exact: bool = False) -> DataFrame:
    """Percentiles of each provider over the window_ms up to each multiple of every_ms, fastest p95 first, and whether p99
    is over the limit. The last end of each provider is what a router would look at now."""
    ends = F.explode(F.sequence(F.ceil(F.col("ms") / every_ms) * every_ms, F.floor((F.col("ms") + window_ms) / every_ms) * every_ms, F.lit(every_ms)))
    fits = F.ceil(F.col("ms") / every_ms) * every_ms <= F.floor((F.col("ms") + window_ms) / every_ms) * every_ms
    p = lambda q: F.round(percentile("latency_ms", q, exact), 6)
    out = requests.where(fits).withColumn("end_ms", ends).groupBy("provider", "end_ms").agg(F.count("*").alias("requests"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"))
    return out.withColumn("degraded", F.coalesce(F.col("p99_ms") > limit_ms, F.lit(False))).orderBy("end_ms", F.asc_nulls_last("p95_ms"), "provider")


def global_model_stats(requests: DataFrame, *by: str) -> DataFrame:
    """Shares of requests with violations of guardrails, of personal data and of prompt injection, per provider and model from
    hourly counts. requests: violations (array of names) beside the usual columns."""
    #: Names of violations.
    pii, injection = ("PiiBlocked", "PiiRedacted"), "PromptInjectionDetected"
    v = F.col("violations")
    hourly = requests.groupBy(*by, F.date_trunc("hour", F.timestamp_millis("ms")).alias("hour")).agg(
        F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.count_if(F.size(v) > 0).alias("blocked"), F.count_if(F.arrays_overlap(v, F.array(*map(F.lit, pii)))).alias("pii"), F.count_if(F.array_contains(v, injection)).alias("injected"),
    )
    rate = lambda c: F.round(F.sum(c) / F.sum("n"), 6)
    return hourly.groupBy(*by).agg(F.sum("n").alias("requests"), rate("failed").alias("error_rate"), rate("blocked").alias("guardrail_rate"), rate("pii").alias("pii_rate"), rate("injected").alias("injection_rate"))


# --- rollouts and sessions -----------------------------------------------------------------------------------


def compare_rollout(requests: DataFrame, scores: DataFrame, max_error_rise: float = 0.05, max_latency_pct: float = 20.0, min_score: float | None = None, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Target against baseline. scores: request columns session, turn, and score."""
    s = requests.join(scores.groupBy("session", "turn").agg(F.avg("score").alias("score")), ["session", "turn"], "left")
    side = lambda v, tail: s.where(F.col("variant") == v).groupBy(*by).agg(F.count("*").alias(f"n_{tail}"), F.avg(F.when(F.col("failed"), 1.0).otherwise(0.0)).alias(f"errors_{tail}"), F.avg("latency_ms").alias(f"latency_{tail}"), F.avg("score").alias(f"score_{tail}"))
    both = side("target", "t").join(side("baseline", "b"), list(by), "full_outer").fillna(0, ["n_t", "n_b"])
    rise = F.coalesce(F.try_divide((F.col("latency_t") - F.col("latency_b")) * 100, F.col("latency_b")), F.lit(0.0))
    verdict = F.when((F.col("n_t") < 10) | (F.col("n_b") < 10), "inconclusive").when(F.col("errors_t") - F.col("errors_b") > max_error_rise, "fail: errors").when(rise > max_latency_pct, "fail: latency")
    verdict = verdict.when(F.col("score_t") < min_score, "fail: quality") if min_score is not None else verdict
    return both.withColumn("latency_rise_pct", F.round(rise, 4)).withColumn("verdict", verdict.otherwise("pass"))


def quality_scores(requests: DataFrame, scores: DataFrame) -> DataFrame:
    return requests.select("session", "turn", "variant").join(scores, ["session", "turn"]).groupBy("variant", "score_name").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def session_list(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session").agg(
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.count_if("failed").alias("errors"), F.countDistinct("model").alias("models"),
    )


def session_requests(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "tokens"))).alias("requests"))


def idle_sessions(requests: DataFrame, now_ms: int, idle_ms: int = 1_800_000, look_back_ms: int = 86_400_000) -> DataFrame:
    """Sessions whose last event is idle_ms old but within the look-back, newest first."""
    s = requests.where(F.col("ms") >= now_ms - look_back_ms).groupBy("session").agg(F.max("ms").alias("last_ms"), F.count("*").alias("requests"))
    return s.where(F.col("last_ms") < now_ms - idle_ms).orderBy(F.desc("last_ms"), "session")


def search_requests(requests: DataFrame, text: str, preview: int = 40) -> DataFrame:
    hits = requests.where(F.lower("text").contains(text.lower()))
    return hits.withColumn("preview", F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text")))


def match_profiles(requests: DataFrame, profiles: list[dict]) -> DataFrame:
    """profiles: name, mode (all / any), rules (field, op, value) over session aggregates; a session may match several."""
    s = requests.groupBy("session").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.count_if("failed").alias("errors"), F.collect_set("model").alias("models"), F.collect_set("role").alias("roles"))
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "contains": lambda a, b: F.array_contains(a, b)}
    hit = lambda p: reduce((lambda a, b: a & b) if p["mode"] == "all" else (lambda a, b: a | b), (ops[r["op"]](F.col(r["field"]), r["value"]) for r in p["rules"]))
    names = F.array_compact(F.array(*(F.when(hit(p), F.lit(p["name"])) for p in profiles)))
    return s.select("session", F.explode(names).alias("profile"))


def metering(usage: DataFrame, budgets: DataFrame, least: float = 0.01) -> DataFrame:
    """usage: org, ms, amount (decimal). Monthly totals, the charge (nothing below `least`) and the budget share reached."""
    m = usage.groupBy("org", F.date_trunc("month", F.timestamp_millis("ms")).alias("month")).agg(F.sum("amount").alias("total"))
    m = m.join(budgets, "org", "left").withColumn("charge", F.when(F.col("total") >= least, F.col("total")).otherwise(F.lit(0)))
    share = F.try_divide(F.col("total").cast("double"), F.col("budget"))
    return m.withColumn("level", F.when(share >= 1, "exceeded").when(share >= 0.8, "warning").when(share.isNotNull(), "ok"))


def hourly_usage(usage: DataFrame) -> DataFrame:
    """usage: org, project, event_type, ms, amount (decimal). Events and amounts per organisation, project, type and hour."""
    return usage.groupBy("org", "project", "event_type", F.date_trunc("hour", F.timestamp_millis("ms")).alias("hour")).agg(F.count("*").alias("events"), F.sum("amount").alias("amount"))


def repeated_requests(requests: DataFrame, *by: str) -> DataFrame:
    """Requests that an exact cache would have answered: all but the first of equal content."""
    key = F.sha2(F.concat_ws("\0", "model", F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))), 256)
    k = requests.groupBy(*by, key.alias("k")).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("one"))
    return k.groupBy(*by).agg(F.sum("n").alias("requests"), F.sum(F.col("n") - 1).alias("hits"), F.sum(F.col("t") - F.col("one")).alias("saved_tokens"))


def label_counts(messages: DataFrame) -> DataFrame:
    """messages: session, labels (array)."""
    return messages.select("session", F.explode("labels").alias("label")).groupBy("session", "label").agg(F.count("*").alias("n"))


# --- text scans ----------------------------------------------------------------------------------------------

#: Patterns of personal data, in the order in which they claim characters.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
CARD = r"\b(?:(?:4\d{3}|5[1-5]\d{2}|6(?:011|5\d{2}))[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}|3[47]\d{2}[- ]?\d{6}[- ]?\d{5})\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\b(?:\+?1[\s.\-]?)?\(?[2-9]\d{2}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b"
INTERNATIONAL_PHONE = r"\+[1-9]\d{9,13}\b|\+[1-9]\d{0,3}[\s.\-]\d{2,9}(?:[\s.\-]\d{2,9}){0,4}\b"
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"
#: Areas that no social security number has.
NO_AREA = "000|666|9\\d\\d"

#: Kind, mark and pattern; a social security number is one whose area exists.
PII = (
    ("email", "[EMAIL]", EMAIL), ("card", "[CARD]", CARD), ("ssn", "[SSN]", rf"\b(?!{NO_AREA}){SSN.removeprefix(chr(92) + 'b')}"),
    ("phone", "[PHONE]", PHONE), ("phone", "[PHONE]", INTERNATIONAL_PHONE), ("ip", "[IP]", IP),
)
KINDS = tuple(dict.fromkeys((k, m) for k, m, _ in PII))
MIN_PII_CHARS = 8


def _valid_cards(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PII[1][2]), F.lit(0))
    return F.filter(F.array_distinct(found), lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", "")))


def _once(x: Column, f) -> Column:
    """f of x, which is computed once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


#: What a text must hold for a pattern to be worth a search; a pattern has no match in any other text.
NEEDS = {EMAIL: lambda t: t.contains("@"), PII[2][2]: lambda t: t.contains("-"), PHONE: lambda t: t.rlike(r"\d[\s.\-]\d{4}"), INTERNATIONAL_PHONE: lambda t: t.contains("+"), IP: lambda t: t.rlike(r"\d\.\d")}
#: Every pattern but the e-mail address has two digits side by side or about a point.
DIGITS_NEEDED = r"\d\d|\d\.\d"


def redact(text: Column | str) -> Column:
    """Personal data by kind in brackets, earlier kinds first; only cards that pass the Luhn check."""
    text = F.col(text) if isinstance(text, str) else text
    marked = lambda mark, pattern: lambda t: F.when(NEEDS[pattern](t), F.regexp_replace(t, pattern, mark)).otherwise(t)
    cards = lambda t: F.when(t.rlike(PII[1][2]), F.aggregate(_valid_cards(t), t, lambda acc, m: F.replace(acc, m, F.lit(PII[1][1])))).otherwise(t)

    def numbers(t: Column) -> Column:
        out = cards(t)
        for _, mark, pattern in PII[2:]:
            out = _once(out, marked(mark, pattern))
        return F.when(t.rlike(DIGITS_NEEDED), out).otherwise(t)

    whole = lambda t: F.when(F.length(t) >= MIN_PII_CHARS, _once(marked(PII[0][1], PII[0][2])(t), numbers)).otherwise(t)
    return _once(text, whole)


def pii_kinds(text: Column | str) -> Column:
    """Kinds of personal data in a text: the marks that redaction brings in."""
    text = F.col(text) if isinstance(text, str) else text
    count = lambda t, m: F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))
    kinds = lambda marked: F.array_compact(F.array(*(F.when(count(marked, m) > count(text, m), F.lit(k)) for k, m in KINDS)))
    return _once(redact(text), lambda marked: F.when(marked == text, F.array().cast("array<string>")).otherwise(kinds(marked)))


def pii_profile(df: DataFrame) -> DataFrame:
    """Per text column: rows, rows with personal data, and rows of each kind. One pass over the table."""
    columns = [c for c, kind in df.dtypes if kind == "string"]
    kinds = df.select(*(pii_kinds(c).alias(c) for c in columns))
    has = lambda c, k: F.count_if(F.array_contains(c, k))
    wide = kinds.agg(*(x for c in columns for x in (F.count_if(F.col(c).isNotNull()).alias(f"{c}|rows"), F.count_if(F.size(c) > 0).alias(f"{c}|hits"), *(has(c, k).alias(f"{c}|{k}") for k, _ in KINDS))))
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}|rows`").alias("rows"), F.col(f"`{c}|hits`").alias("with_pii"), *(F.col(f"`{c}|{k}`").alias(k) for k, _ in KINDS)) for c in columns))
    return wide.select(F.explode(each).alias("x")).select("x.*")


#: Rules of the prompt-injection scan, without regard to case.
INJECTION = (
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"disregard\s+(all\s+)?(prior|previous|above)\s+instructions?",
    r"you\s+are\s+now\s+(in\s+)?developer\s+mode",
    r"system\s+override",
    r"reveal\s+(your\s+)?(system\s+)?prompt",
    r"repeat\s+(the\s+)?(text|instructions?)\s+(above|before)",
    r"what\s+(were|are)\s+(your\s+)?(exact\s+)?instructions",
    r"act\s+as\s+if\s+you.{0,20}(not\s+bound|no\s+restrict)",
    r"new\s+instructions?\s*:",
    r"override\s+(all\s+)?(previous\s+)?instructions?",
)
#: Control tokens that a prompt must not hold.
SPECIAL_TOKENS = (r"<\|im_start\|>\s*system", r"<\|system\|>", r"\[INST\]", r"<\|endoftext\|>")
#: Words that are looked for with their inner letters in any order.
SCRAMBLED = ("ignore", "bypass", "override", "reveal", "disregard", "system", "instructions", "previous", "prompt", "jailbreak", "developer", "repeat")


def _unscrambled(word: Column) -> Column:
    """The known word with the same ends and the same letters between, else the word."""
    low = F.lower(word)
    middle = lambda w: F.array_join(F.array_sort(F.split(F.substring(w, 2, 100), "")), "")
    form = F.concat_ws("|", F.substring(low, 1, 1), F.right(low, F.lit(1)), middle(low))
    known = F.create_map(*(x for w in SCRAMBLED for x in (F.lit(f"{w[0]}|{w[-1]}|{''.join(sorted(w[1:]))}"), F.lit(w))))
    return F.when(F.length(low).between(6, 12), F.coalesce(F.element_at(known, form), word)).otherwise(word)


def normalised_prompt(text: Column) -> Column:
    """Spaced letters joined, runs of three and more of a letter cut to one, scrambled known words set right."""
    joined = F.regexp_replace(text, r"(?<=\b\p{L}) +(?=\p{L}\b)", "")
    short = F.regexp_replace(joined, r"(\p{L})\1{2,}", "$1")
    return F.array_join(F.transform(F.split(short, r"\s+"), _unscrambled), " ")


def injection_rule(text: Column | str) -> Column:
    """The first rule that a text, or a base64 segment in it, breaks; null for clean text."""
    text = F.col(text) if isinstance(text, str) else text
    segments = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0)), lambda s: F.try_to_binary(s, F.lit("base64")))
    plain = F.filter(F.transform(segments, lambda b: F.when(b.isNotNull(), F.try_validate_utf8(b.cast("string")))), lambda s: s.isNotNull())
    every = F.concat_ws("\n", text, plain)
    norm = normalised_prompt(every)
    out = None
    for k, p in enumerate(INJECTION):
        hit = norm.rlike("(?i)" + p)
        out = F.when(hit, f"rule {k + 1}") if out is None else out.when(hit, f"rule {k + 1}")
    for p in SPECIAL_TOKENS:
        out = out.when(every.rlike(p), "special tokens")
    return out


#: Links through which a response can carry data out.
EXFILTRATION = (r"(?i)!\[[^\]]*\]\(https?://[^)]+\)", r"""(?i)<img[^>]+src\s*=\s*["']?https?://[^"'\s>]+""")


def exfiltrates(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in EXFILTRATION))


def policy_rule(text: str, topics: list[str] = (), max_tokens: int | None = None, block_pii: bool = False) -> Column:
    """The first rule broken: personal data, token limit, blocked topic."""
    out = F.when(F.lit(False), "")
    if block_pii:
        out = out.when(F.size(pii_kinds(text)) > 0, "personal data")
    if max_tokens:
        out = out.when(F.ceil(F.length(text) / 4) > max_tokens, "token limit")
    for t in topics:
        out = out.when(F.lower(text).contains(t.lower()), f"topic {t}")
    return out


# --- chunks and vectors --------------------------------------------------------------------------------------


class Cuts:
    """Where a text may be cut: behind blank lines, and behind sentences where a piece holds no blank line."""

    def __init__(self, text: str):
        self.behind = [[m.start() + 2 for m in re.finditer(rf"(?={mark})", text)] for mark in ("\n\n", r"\. ")]

    def last(self, start: int, stop: int) -> int:
        """The last cut of the better kind that lies whole within the piece, or -1."""
        for places in self.behind:
            k = bisect_right(places, stop)
            if k and places[k - 1] >= start + 2:
                return places[k - 1]
        return -1


def spans(text: str, budget: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most `budget` characters that overlap; a cut in the first quarter of a piece is none."""
    cuts, start, stop = Cuts(text), 0, 0
    while stop < len(text):
        stop = min(start + budget, len(text))
        if stop < len(text) and (cut := cuts.last(start, stop)) > start + budget // 4:
            stop = cut
        yield start, stop
        start = max(stop - overlap, start + 1)


def chunks(docs: DataFrame, title: str, text: str, *keep: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """Overlapping pieces of at most `size` characters with the title in front, which takes half of them at most. Empty
    texts have none."""

    def pieces(name: str, body: str) -> list[str]:
        body, head = body.strip(), f"[{name}] "[: size // 2]
        return [head + body[a:b].strip() for a, b in spans(body, max(1, size - len(head)), overlap)]

    @F.pandas_udf("array<string>")
    def each(names: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([pieces(n or "", b or "") for n, b in zip(names, bodies)], dtype=object)

    return docs.select(*keep, F.posexplode(each(F.col(title), F.col(text))).alias("chunk", "chunk_text"))


#: Queries and corpus rows that meet in a task, about; corpus rows a pivot, and the most pivots.
QUERY_BLOCK, CORPUS_BLOCK, PIVOT_ROWS, MAX_PIVOTS = 4096, 16_384, 4096, 1024
#: Corpus rows whose k-th best cosine with a query is the least that its results have.
PROBES = 1024
#: Rings about a pivot, by angle.
RINGS = 16
#: Numbers of a matrix that a task holds at a time.
MATRIX = 1 << 21
#: Slack of angles and cosines against rounding; cosines count as equal from this many digits on.
SLACK, DIGITS = 1e-6, 12


def _units(v) -> np.ndarray:
    m = np.stack([np.asarray(x, dtype=np.float64) for x in v])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _parts(rows: int, columns: int):
    """Slices of the rows of a matrix, of at most MATRIX numbers each."""
    step = max(1, MATRIX // max(1, columns))
    return (slice(k, k + step) for k in range(0, rows, step))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


class Cells:
    """A corpus of vectors cut into rings about pivots. The angle between a query and a member of a ring is at least what the
    query's angle to the pivot exceeds the ring's by, or falls short of it, so rings too far for a query's k-th best are
    skipped. Pivots, probes and a row a ring are all that the driver holds; their numbers are bounded.

    Zero vectors have a cosine of 0 with everything and are a cell of their own."""

    def __init__(self, corpus: DataFrame, block: int = CORPUS_BLOCK):
        self.corpus = corpus.where("embedding is not null").select("vec_id", "embedding")
        rows = self.corpus.count()
        probes = self.corpus.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).collect()
        self.probe_ids = np.array([r[0] for r in probes])
        self.probes = _units([r[1] for r in probes]) if probes else np.zeros((0, 1))
        whole = self.probes[self.probes.any(axis=1)]
        self.pivots = whole[: min(MAX_PIVOTS, max(1, rows // PIVOT_ROWS))]
        pivots = self.pivots

        def place(batches):
            for pdf in (whole.iloc[part] for whole in batches for part in _parts(len(whole), len(pivots))):
                u = _units(pdf["embedding"])
                angles = _angles(u, pivots) if len(pivots) else np.full((len(u), 1), np.pi)
                nearest_ = angles.argmin(axis=1)
                angle = angles[np.arange(len(u)), nearest_]
                cell = nearest_ * RINGS + np.minimum(RINGS - 1, (angle / np.pi * RINGS).astype(int))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": pdf["embedding"], "cell": np.where(u.any(axis=1), cell, -1), "angle": angle})

        kind = dict(self.corpus.dtypes)
        self.placed = self.corpus.mapInPandas(place, f"vec_id {kind['vec_id']}, embedding {kind['embedding']}, cell bigint, angle double")
        rings = self.placed.groupBy("cell").agg(F.count("*"), F.min("angle"), F.max("angle")).collect()  # a row a ring
        self.rings = np.array([tuple(r) for r in rings], dtype=np.float64).reshape(-1, 4)
        self.pieces = {int(c): -(-int(n) // block) for c, n, _, _ in self.rings}

    def wanted(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, vector, cell): the cells that a query has to see."""
        rings, pivots, probes, probe_ids = self.rings, self.pivots, self.probes, self.probe_ids
        cell, low, high = rings[:, 0].astype(int), rings[:, 2], rings[:, 3]

        def choose(batches):
            if not len(rings):
                return
            for pdf in (whole.iloc[part] for whole in batches for part in _parts(len(whole), max(len(rings), len(probes)))):
                u, ids = _units(pdf["embedding"]), pdf["vec_id"].to_numpy()
                cos = np.where(ids[:, None] == probe_ids[None, :], -np.inf, u @ probes.T)
                least = np.partition(cos, -k, axis=1)[:, -k] if cos.shape[1] >= k else np.full(len(u), -np.inf)
                angle = _angles(u, pivots)[:, cell // RINGS] if len(pivots) else np.zeros((len(u), len(cell)))
                gap = np.maximum(np.maximum(angle - high, low - angle) - SLACK, 0)
                bound = np.where((cell >= 0)[None, :], np.cos(gap), 0.0)
                bound[~u.any(axis=1)] = 0.0
                q, c = np.nonzero(bound + SLACK >= least[:, None])
                for part in np.array_split(np.arange(len(q)), -(-len(q) // 50_000) or 1):  # vectors are copied: a batch at a time
                    yield pd.DataFrame({"query_id": ids[q[part]], "vector": pdf["embedding"].to_numpy()[q[part]], "cell": cell[c[part]]})

        kind = dict(queries.dtypes)
        return queries.where("embedding is not null").select("vec_id", "embedding").mapInPandas(choose, f"query_id {kind['vec_id']}, vector {kind['embedding']}, cell bigint")


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10, block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """Exact top k by cosine, equal ones by id. Both: vec_id, embedding. A query that is itself in the corpus does not find its
    own row.

    The corpus is cut into cells, and a query goes to those that can hold one of its k best. Crowded cells are dealt into
    pieces of about corpus_block rows and their queries into blocks of about `block`; each piece meets each block in a task
    of its own, which keeps a query's best k. The corpus is read for probes, for cells and for the join, however many
    queries there are.
    """
    cells = Cells(corpus, corpus_block)
    wanted = cells.wanted(queries, k)
    blocks = {r[0]: -(-r[1] // block) for r in wanted.groupBy("cell").count().collect()}  # a row a cell
    deal = corpus.sparkSession.createDataFrame([(c, cells.pieces[c], b) for c, b in blocks.items()], "cell bigint, pieces int, blocks int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    left = wanted.join(F.broadcast(deal), "cell").withColumn("block", part("query_id", "blocks")).withColumn("piece", each("pieces")).drop("pieces", "blocks")
    right = cells.placed.drop("angle").join(F.broadcast(deal), "cell").withColumn("piece", part("vec_id", "pieces")).withColumn("block", each("blocks")).drop("pieces", "blocks")

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            own = c["vec_id"].to_numpy()
            units = _units(c["embedding"]).T
            for part in _parts(len(q), len(own)):
                cos = _units(q["vector"].iloc[part]) @ units
                np.round(cos, DIGITS, out=cos)
                for row, i in zip(cos, q["query_id"].iloc[part]):
                    at = np.flatnonzero(own != i)
                    if len(at) > k:
                        at = at[row[at] >= np.partition(row[at], -k)[-k]]
                    at = at[np.lexsort((own[at], -row[at]))[:k]]
                    out.append(pd.DataFrame({"query_id": i, "corpus_id": own[at], "cosine": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "corpus_id": [], "cosine": []})

    keys = ["cell", "piece", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_id {dict(queries.dtypes)['vec_id']}, corpus_id {dict(corpus.dtypes)['vec_id']}, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "corpus_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def skipped_pairs(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """One row: pairs of query and corpus row, and how many of them nearest() computes."""
    cells = Cells(corpus)
    size = corpus.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in cells.rings], "cell bigint, rows bigint")
    total = int(cells.rings[:, 1].sum())
    computed = cells.wanted(queries, k).join(F.broadcast(size), "cell").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("computed"))
    return computed.crossJoin(queries.where("embedding is not null").agg((F.count("*") * total).alias("pairs")))  # a row and a row
