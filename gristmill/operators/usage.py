"""Token usage, cost and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.sequences import running_sums

from gristmill.operators.lookup import longest_prefix

AXES = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
RATES = ("in_rate", "out_rate", "write_rate", "read_rate")
#: The fields of a response's usage object, in the order of AXES.
FIELDS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def usage(body: Column) -> Column:
    """struct of AXES from a response's JSON; missing, wrong or negative numbers are 0."""
    known = F.from_json(body, "usage map<string,string>")["usage"]
    return F.struct(*(F.greatest(F.lit(0), F.coalesce(F.element_at(known, F.lit(f)).try_cast("bigint"), F.lit(0))).cast("long").alias(a) for f, a in zip(FIELDS, AXES, strict=True)))


def usd(price: Column) -> Column:
    """Cost of the row's AXES at the rates of price, 0 without one; axes without a rate are free. Rounded to 8 places
    half up (a decimal tie may differ in the last place from half-even rounding of the binary value)."""
    parts = [F.greatest(F.lit(0), F.col(a)) * F.coalesce(price[r], F.lit(0.0)) / 1_000_000 for a, r in zip(AXES, RATES, strict=True)]
    return F.coalesce(F.round(sum(parts[1:], parts[0]), 8), F.lit(0.0))


def priced(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (provider, model, AXES) with usd and matched."""
    rows = longest_prefix(requests, rules)
    return rows.withColumn("usd", usd(F.col("price"))).withColumn("matched", F.col("price").isNotNull()).drop("price")


def rollup(costs: DataFrame) -> DataFrame:
    """Sums per provider and model, and of all (both null, total true)."""
    sums = [F.sum(F.greatest(F.lit(0), F.col(a))).alias(a) for a in AXES]
    out = costs.groupingSets([["provider", "model"], []], "provider", "model").agg(
        F.count("*").alias("requests"), *sums, F.round(F.sum("usd"), 6).alias("usd"), F.count_if(~F.col("matched")).alias("unmatched"), (F.grouping_id() > 0).alias("total")
    )
    return out


def running_budget(calls: DataFrame, limit: int, order: str = "seq", amount: str = "chars", by: str | None = None) -> DataFrame:
    """calls with used (running sum), remaining and exceeded (used >= limit) in order, for each by (or all)."""
    return _within(running_sums(calls, {"used": amount}, [order], [by] if by else []), limit, "")


def running_budgets(calls: DataFrame, limits: dict[str, int], order: str = "seq", by: str | None = None) -> DataFrame:
    """The same for several axes at once: limits names the columns; used_x, remaining_x and exceeded_x for each."""
    out = running_sums(calls, {f"used_{a}": a for a in limits}, [order], [by] if by else [])
    for axis, limit in limits.items():
        out = _within(out, limit, f"_{axis}")
    return out


def _within(rows: DataFrame, limit: int, end: str) -> DataFrame:
    used = F.col(f"used{end}")
    return rows.withColumn(f"remaining{end}", F.greatest(F.lit(0), F.lit(limit) - used)).withColumn(f"exceeded{end}", used >= limit)


def merged(parts: DataFrame, key: str) -> DataFrame:
    """The largest number of each axis over the partial usages of a stream, 0 at least."""
    return parts.groupBy(key).agg(*(F.greatest(F.lit(0), F.max(a)).alias(a) for a in AXES))
