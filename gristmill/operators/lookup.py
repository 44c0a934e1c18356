"""Rule lookups: longest prefix, first matching rule, routing by several rules, context windows and tiers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import glob_to_regex

#: Rules of a table; they are broadcast, so more than this is an error.
MOST_RULES = 10_000

#: Provider, model prefix, USD per million tokens in, out, written to and read from the cache.
PRICES = [
    ("anthropic", "claude-opus-4", 15.00, 75.00, 18.75, 1.50),
    ("anthropic", "claude-sonnet-4", 3.00, 15.00, 3.75, 0.30),
    ("anthropic", "claude-haiku-4", 0.80, 4.00, 1.00, 0.08),
    ("anthropic", "claude-3-5-sonnet", 3.00, 15.00, 3.75, 0.30),
    ("anthropic", "claude-3-5-haiku", 0.80, 4.00, 1.00, 0.08),
    ("anthropic", "claude-3-opus", 15.00, 75.00, 18.75, 1.50),
    ("anthropic", "claude-3-haiku", 0.25, 1.25, 0.30, 0.03),
    ("openai", "gpt-4o-mini", 0.15, 0.60, None, None),
    ("openai", "gpt-4o", 2.50, 10.00, None, None),
    ("openai", "gpt-4-turbo", 10.00, 30.00, None, None),
    ("google", "gemini-1.5-flash", 0.075, 0.30, None, None),
    ("google", "gemini-1.5-pro", 1.25, 5.00, None, None),
    ("google", "gemini-2.0-flash", 0.10, 0.40, None, None),
    ("ollama", "", 0.0, 0.0, None, None),
    ("local", "", 0.0, 0.0, None, None),
]
PRICE_DDL = "provider string, prefix string, in_rate double, out_rate double, write_rate double, read_rate double"

#: Shares of the context window at which the next tier begins, and each tier's engine levels.
TIERS = [(0.40, "lenient"), (0.60, "standard"), (0.80, "aggressive"), (None, "max")]
TIER_LEVELS = {
    "lenient": {"middle_out": "off", "caveman": "lite", "rtk": "minimal", "json_aware": "safe", "lsh": "conservative", "jl_dedupe": "false"},
    "standard": {"middle_out": "safe", "caveman": "standard", "rtk": "standard", "json_aware": "standard", "lsh": "standard", "jl_dedupe": "true"},
    "aggressive": {"middle_out": "safe", "caveman": "aggressive", "rtk": "aggressive", "json_aware": "aggressive", "lsh": "aggressive", "jl_dedupe": "true"},
    "max": {"middle_out": "aggressive", "caveman": "ultra", "rtk": "aggressive", "json_aware": "aggressive", "lsh": "aggressive", "jl_dedupe": "true"},
}
LEAST_CHARS = 2048
CHARS_PER_TOKEN = 4
WINDOW = 200_000

#: The fields of a policy; model prefixes and their context windows in tokens.
POLICY_FIELDS = ("input_compression", "jl_dedupe", "caveman_enabled", "caveman_level", "rtk_enabled", "rtk_level", "output_compression", "max_text_chars")
WINDOWS = [
    ("claude-3-5-sonnet", 200_000),
    ("claude-3-7-sonnet", 200_000),
    ("claude-3-7", 200_000),
    ("claude-3-opus", 200_000),
    ("claude-3-haiku", 200_000),
    ("claude-opus-4", 200_000),
    ("claude-sonnet-4", 200_000),
    ("claude-haiku-4", 200_000),
    ("claude-3", 200_000),
]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, PRICE_DDL)


def _few(rules: DataFrame) -> DataFrame:
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return F.broadcast(rules)


def longest_prefix(rows: DataFrame, rules: DataFrame, provider: str = "provider", model: str = "model") -> DataFrame:
    """rows with a struct price: the rule of the provider with the longest prefix of the model, or null.

    The rules become one map from provider to its list, sorted by length, so each row is looked up in place and no row
    is multiplied.
    """
    rule = F.struct(F.length("prefix").alias("size"), *(c for c in rules.columns if c != "provider"))
    lists = _few(rules).groupBy(F.col("provider").alias("__provider")).agg(F.sort_array(F.collect_list(rule), asc=False).alias("__rules"))
    joined = rows.join(F.broadcast(lists), rows[provider] == F.col("__provider"), "left")
    found = F.get(F.filter("__rules", lambda r: F.startswith(F.coalesce(F.col(model), F.lit("")), r["prefix"])), F.lit(0))
    return joined.withColumn("price", found).drop("__provider", "__rules")


def first_rule(rows: DataFrame, rules: list[tuple[str, str, str]], model: str = "model", endpoint: str = "endpoint", name: str = "policy") -> DataFrame:
    """rows with the value of the first rule (model glob, endpoint or *, value) that matches; a null model matches * only."""
    chosen = [F.when(_matches(F.col(model), glob) & (F.lit(where == "*") | (F.col(endpoint) == where)), F.lit(value)) for glob, where, value in rules]
    return rows.withColumn(name, F.coalesce(*chosen) if chosen else F.lit(None).cast("string"))


def _matches(value: Column, glob: str) -> Column:
    return F.lit(True) if glob == "*" else F.coalesce(value.rlike(glob_to_regex(glob)), F.lit(False))


def route(model: Column, hint: Column, adapters: list[tuple[str, list[str]]], default: str) -> Column:
    """Adapter name: the hint if it is one, else the adapter whose globs match the hint, else the model, else default."""
    exact = [F.when(F.lower(hint) == name, F.lit(name)) for name, _ in adapters]
    globbed = lambda x: [F.when(_matches(x, g), F.lit(name)) for name, globs in adapters for g in globs]
    return F.coalesce(*exact, *globbed(hint), *globbed(model), F.lit(default))


def policies(text: str) -> list[tuple[str, str, str]]:
    """Rules (model glob, endpoint, policy as JSON) of a document {default, rules: [{model_glob, endpoint, policy}]}, the
    default last, for all models and endpoints. A list of rules alone has no default. Anything else, and unknown fields of
    a policy, are an error."""
    found = json.loads(text) if text.strip() else {}
    if isinstance(found, list):
        return [_rule(r, f"rule {i}") for i, r in enumerate(found)]
    if not isinstance(found, dict) or not isinstance(found.get("rules", []), list):
        raise ValueError("policies are an object with a list of rules")
    return [*(_rule(r, f"rule {i}") for i, r in enumerate(found.get("rules", []))), _rule({"policy": found.get("default")}, "default")]


def _rule(rule: dict, where: str) -> tuple[str, str, str]:
    if not isinstance(rule, dict) or not isinstance(policy := rule.get("policy") or {}, dict):
        raise ValueError(f"{where} is no object")
    if extra := set(rule) - {"model_glob", "endpoint", "policy"} | set(policy) - set(POLICY_FIELDS):
        raise ValueError(f"{where}: unknown fields {sorted(extra)}")
    most = policy.get("max_text_chars")
    if most is not None and int(most) < 0:
        raise ValueError(f"{where}: max_text_chars is below 0: {most}")
    return str(rule.get("model_glob", "*")), str(rule.get("endpoint", "*")), json.dumps(policy, sort_keys=True)


def context_window(model: Column, windows: list[tuple[str, int]] = WINDOWS, default: int = WINDOW) -> Column:
    """Tokens that the model can read: those of the longest prefix of its name, else default (also for null)."""
    longest = sorted(windows, key=lambda w: -len(w[0]))
    return F.coalesce(*(F.when(F.startswith(model, F.lit(prefix)), F.lit(size)) for prefix, size in longest), F.lit(default))


def tier(chars: Column, window: Column | int = WINDOW) -> Column:
    """Name of the tier of a request whose text has chars characters."""
    window = F.lit(window) if isinstance(window, int) else window
    pressure = F.when(window > 0, chars / CHARS_PER_TOKEN / window).otherwise(0.0)
    return F.coalesce(*(F.when(pressure < upto, F.lit(name)) if upto is not None else F.lit(name) for upto, name in TIERS))


def tier_level(name: Column, engine: str) -> Column:
    return F.create_map(*(F.lit(x) for t, levels in TIER_LEVELS.items() for x in (t, levels[engine])))[name]


def worth_compacting(chars: Column) -> Column:
    return chars >= LEAST_CHARS

