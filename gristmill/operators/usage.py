"""Usage and cost of model calls: daily roll-ups, price resolution, estimates that keep unknown apart from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens"]
PRICE_OF = {"input_tokens": "prompt", "cached_input_tokens": "cache_read", "cache_write_tokens": "cache_write", "output_tokens": "completion"}
#: Provider whose calls are covered by a subscription and have no price.
SUBSCRIPTION = "subscription"
# Short model names that stand for the latest of their line.
ALIASES = ["haiku", "sonnet", "opus"]


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def window_start(now: Column, days: int) -> Column:
    """UTC midnight ``days`` - 1 days before ``now``: today and the whole days before it."""
    return F.date_trunc("day", now) - F.make_dt_interval(F.lit(days - 1))


def by_day(usage: DataFrame) -> DataFrame:
    """Calls, tokens and cost by day, role, provider and model; tokens of calls without a cost are summed apart."""
    free = F.col("cost_usd").isNull()
    sums = [F.sum(t).alias(t) for t in TOKENS] + [F.sum(F.when(free, F.col(t)).otherwise(0)).alias(f"unpriced_{t}") for t in TOKENS]
    return usage.groupBy(day(F.col("ts")).alias("day"), "role", "provider", "model").agg(
        F.count(F.lit(1)).alias("calls"), *sums, F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("reported_cost_usd"), F.count_if(free).alias("unpriced_calls")
    )


def candidate_ids(provider: Column, model: Column) -> Column:
    """Ids under which a model may be priced, the best first; none for blank and ``default``."""
    dotted = F.regexp_replace(model, r"-(\d+)-(\d+)$", "-$1.$2")
    vendor = F.lit("anthropic/")
    ids = (
        F.when(provider == "openrouter", F.array(model, F.element_at(F.split(model, ":"), 1)))
        .when((provider == "claude-cli") & model.isin(ALIASES), F.array(F.concat(F.lit("~anthropic/claude-"), model, F.lit("-latest"))))
        .when(provider == "claude-cli", F.array(F.concat(vendor, dotted), F.concat(vendor, model)))
        .when(provider == "codex-cli", F.array(F.concat(F.lit("openai/"), model)))
        .when(provider == "embeddings", F.array(model, F.concat(F.lit("openai/"), model)))
        .otherwise(F.array(model))
    )
    return F.when(F.coalesce(model, F.lit("")).isin("", "default"), F.array().cast("array<string>")).otherwise(F.array_distinct(ids))


def resolve_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Distinct (provider, model) of ``models`` with the price of their first candidate that the list has, if any.

    Only the distinct pairs meet the price list, however many calls there are.
    """
    pairs = models.select("provider", "model").distinct().withColumn("ids", candidate_ids(F.col("provider"), F.col("model")))
    each = pairs.select("provider", "model", F.posexplode_outer("ids").alias("at", "model_id"))
    columns = ["model_id", *PRICE_OF.values()]
    met = each.join(prices.select(*columns).withColumn("known", F.lit(True)), "model_id", "left")
    best = met.groupBy("provider", "model").agg(F.min_by(F.struct(*columns), F.when(F.col("known"), F.col("at"))).alias("price"))
    return best.select("provider", "model", *[F.col(f"price.{c}").alias(c) for c in columns])


def estimated(tokens: str = "") -> Column:
    """Cost of a row's tokens (columns of prefix ``tokens``) at its prices."""
    return sum((F.col(tokens + t) * F.col(p) for t, p in PRICE_OF.items()), F.lit(0.0))


def report(days: DataFrame, prices: DataFrame) -> DataFrame:
    """Daily rows with ``estimated_cost_usd``, ``cost_usd`` and ``priced``.

    An estimate is 0 if every call has a cost, null if no price is known. A cost is null if nothing is known of it; with some
    calls reported it is what they report, a floor. Subscriptions have neither.
    """
    covered = F.col("provider") == SUBSCRIPTION
    priced = days.join(resolve_prices(days, prices), ["provider", "model"], "left")
    estimate = F.when(covered, None).when(F.col("unpriced_calls") == 0, F.lit(0.0)).otherwise(estimated("unpriced_"))
    out = priced.withColumn("estimated_cost_usd", estimate)
    known = F.col("estimated_cost_usd").isNotNull()
    floor = F.when(F.col("calls") > F.col("unpriced_calls"), F.col("reported_cost_usd"))
    cost = F.when(covered, None).when(known, F.col("reported_cost_usd") + F.col("estimated_cost_usd")).otherwise(floor)
    return out.withColumn("cost_usd", cost).withColumn("priced", ~covered & ((F.col("unpriced_calls") == 0) | known)).drop(*PRICE_OF.values(), "model_id")


def poisoned_total(usage: DataFrame, *keys: str) -> DataFrame:
    """Cost of each group, null as soon as one of its calls has none."""
    return usage.groupBy(*keys).agg(F.when(F.count_if(F.col("cost_usd").isNull()) == 0, F.sum("cost_usd")).alias("total_cost_usd"))


def retryable(status: Column) -> Column:
    """Whether a failed call with this status may be tried again: time-outs, too many requests, faults of the server."""
    return F.coalesce(status.isin(408, 429) | (status >= 500), F.lit(False))


def price_decision(fetched: Column, failed: Column, now: Column, *, ttl_hours: int = 24, retry_minutes: int = 5) -> Column:
    """What to do with a price list fetched at ``fetched`` whose last refresh failed at ``failed`` (either may be null): ``fresh``, ``stale`` (used, as the last failure is recent), or ``refresh``."""
    young = F.coalesce(now < fetched + F.make_dt_interval(hours=F.lit(ttl_hours)), F.lit(False))
    cooling = F.coalesce(now < failed + F.make_dt_interval(mins=F.lit(retry_minutes)), F.lit(False))
    return F.when(young, "fresh").when(cooling, "stale").otherwise("refresh")


def distinct_ids(ids: Column) -> Column:
    """``ids`` once each, in the order in which they are first met; empty ones and nulls go."""
    return F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (i != "")))


def cost_bounds(messages: DataFrame, *, base: int = 1_024, each: int = 32, output: int = 6_000, input_usd: float = 3.0, output_usd: float = 15.0) -> DataFrame:
    """conv_id, input_bound, upper_bound_usd: what a call with ``messages`` (conv_id, content) can cost at most.

    A token is a byte at least, so bytes bound tokens; ``base`` and ``each`` stand for what surrounds a call and a message. Prices are for a million tokens. Null contents are empty.
    """
    bound = F.coalesce(F.sum(F.octet_length("content")), F.lit(0)) + base + each * F.count(F.lit(1))
    cost = bound * F.lit(input_usd) / 1_000_000 + F.lit(output * output_usd / 1_000_000)
    return messages.groupBy("conv_id").agg(bound.alias("input_bound"), cost.alias("upper_bound_usd"))


def retry_position(attempt: Column, providers: int = 3) -> Column:
    """Which provider, from 0, a call's ``attempt`` (from 0) goes to: the next one each time, then the last."""
    return F.least(attempt, F.lit(providers - 1))


def retry_wait(attempt: Column, first_ms: int = 15_000, most_ms: int = 60_000) -> Column:
    """Milliseconds before ``attempt`` is made again: doubled each time, up to a bound."""
    return F.least(F.lit(float(most_ms)), first_ms * F.pow(F.lit(2.0), attempt)).cast("long")


def embedding_retryable(status: Column) -> Column:
    """Whether a request for embeddings may be sent again: rate limits and faults of the server alone, no timeouts of the request."""
    return F.coalesce((status == 429) | (status >= 500), F.lit(False))
