"""Queries of usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import usage as ops
from gristmill.plans.registry import query
from gristmill.sources.tables import MESSAGES, PRICES, USAGE, over, table

SUMS = ", ".join(f"cast(sum({t}) AS bigint) AS {t}, cast(sum(CASE WHEN cost_usd IS NULL THEN {t} ELSE 0 END) AS bigint) AS unpriced_{t}" for t in ops.TOKENS)
DAYS = f"SELECT strftime(ts, '%Y-%m-%d') AS day, role, provider, model, count(*) AS calls, {SUMS}, round(coalesce(sum(cost_usd), 0), 6) AS reported_cost_usd, cast(count(*) FILTER (WHERE cost_usd IS NULL) AS bigint) AS unpriced_calls FROM v_usage GROUP BY 1, 2, 3, 4"
EXACT = DAYS.replace("round(coalesce(sum(cost_usd), 0), 6)", "coalesce(sum(cost_usd), 0)")
IDS = (
    "CASE WHEN coalesce(model, '') IN ('', 'default') THEN [] WHEN provider = 'openrouter' THEN [model, split_part(model, ':', 1)] WHEN provider = 'claude-cli' AND model IN ('haiku', 'sonnet', 'opus') THEN ['~anthropic/claude-' || model || '-latest'] "
    "WHEN provider = 'claude-cli' THEN ['anthropic/' || regexp_replace(model, '-(\\d+)-(\\d+)$', '-\\1.\\2'), 'anthropic/' || model] WHEN provider = 'codex-cli' THEN ['openai/' || model] WHEN provider = 'embeddings' THEN [model, 'openai/' || model] ELSE [model] END"
)
PAIRS = (
    f"pairs AS (SELECT provider, model, {IDS} AS ids FROM (SELECT DISTINCT provider, model FROM v_usage)), cand AS (SELECT provider, model, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM pairs), "
    "best AS (SELECT c.provider, c.model, arg_min(p, pos) AS p FROM cand c JOIN v_prices p ON p.model_id = c.id GROUP BY 1, 2)"
)
ESTIMATE = "input_tokens * p.prompt + cached_input_tokens * p.cache_read + cache_write_tokens * p.cache_write + output_tokens * p.completion"
UNPRICED = "unpriced_input_tokens * p.prompt + unpriced_cached_input_tokens * p.cache_read + unpriced_cache_write_tokens * p.cache_write + unpriced_output_tokens * p.completion"
REPORT = f"{PAIRS}, days AS ({EXACT}), est AS (SELECT d.*, CASE WHEN d.provider = 'subscription' THEN NULL WHEN unpriced_calls = 0 THEN 0 ELSE {UNPRICED} END AS e FROM days d LEFT JOIN best b ON b.provider = d.provider AND b.model = d.model)"


@query("o090_usage_by_day", over("v_usage", DAYS))
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.by_day(USAGE.frame(spark, sf_dir)).withColumn("reported_cost_usd", F.round("reported_cost_usd", 6))


@query("o091_usage_totals", over("v_usage v_prices", f"WITH {REPORT}, r AS (SELECT *, CASE WHEN provider = 'subscription' THEN NULL WHEN e IS NULL THEN CASE WHEN calls > unpriced_calls THEN reported_cost_usd END ELSE reported_cost_usd + e END AS cost_usd, provider <> 'subscription' AND (unpriced_calls = 0 OR e IS NOT NULL) AS priced FROM est) SELECT round(sum(cost_usd), 4) AS cost_usd, bool_or(priced) AS any_priced, bool_or(coalesce(e, 0) > 0) AS any_estimated, bool_or(NOT priced) AS any_unpriced, cast(sum(input_tokens + cached_input_tokens + cache_write_tokens + output_tokens) AS bigint) AS tokens, cast(sum(calls) AS bigint) AS calls FROM r"))
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.report(ops.by_day(USAGE.frame(spark, sf_dir)), PRICES.frame(spark, sf_dir))
    return rows.agg(
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.bool_or("priced").alias("any_priced"), F.bool_or(F.coalesce("estimated_cost_usd", F.lit(0.0)) > 0).alias("any_estimated"),
        F.bool_or(~F.col("priced")).alias("any_unpriced"), F.sum(sum(F.col(t) for t in ops.TOKENS)).alias("tokens"), F.sum("calls").alias("calls"),
    )


@query("o092_day_subtotals", over("v_usage", "SELECT strftime(ts, '%Y-%m-%d') AS day, model, count(*) AS calls, cast(sum(input_tokens + output_tokens) AS bigint) AS tokens, cast(grouping(model) AS bigint) AS is_subtotal FROM v_usage GROUP BY GROUPING SETS ((1), (1, 2))"))
def day_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = USAGE.frame(spark, sf_dir).withColumn("day", ops.day(F.col("ts")))
    sets = rows.groupingSets([["day"], ["day", "model"]], "day", "model")
    return sets.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.grouping("model").cast("long").alias("is_subtotal"))


@query("o066_resolved_prices", over("v_usage v_prices", f"WITH {PAIRS} SELECT x.provider, x.model, b.p.model_id AS model_id FROM pairs x LEFT JOIN best b ON b.provider = x.provider AND b.model = x.model"))
def resolved_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolve_prices(USAGE.frame(spark, sf_dir), PRICES.frame(spark, sf_dir)).select("provider", "model", "model_id")


@query("o093_row_estimates", over("v_usage v_prices", f"WITH {PAIRS} SELECT u.id, round({ESTIMATE}, 12) AS estimate FROM v_usage u JOIN best b ON b.provider = u.provider AND b.model = u.model"))
def row_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = USAGE.frame(spark, sf_dir)
    known = ops.resolve_prices(calls, PRICES.frame(spark, sf_dir)).where("model_id IS NOT NULL")
    return calls.join(known, ["provider", "model"]).select("id", F.round(ops.estimated(), 12).alias("estimate"))


@query("o195_candidate_models", over("v_usage", f"SELECT DISTINCT provider, model, array_to_string(list_filter({IDS}, lambda x, i: list_position({IDS}, x) = i), ' ') AS ids FROM v_usage"))
@query("o165_distinct_candidates", over("v_usage", f"SELECT DISTINCT provider, model, array_to_string(list_filter({IDS}, lambda x, i: list_position({IDS}, x) = i), ' ') AS ids FROM v_usage"))
def candidate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = USAGE.frame(spark, sf_dir).select("provider", "model").distinct()
    return pairs.select("provider", "model", F.array_join(ops.candidate_ids(F.col("provider"), F.col("model")), " ").alias("ids"))


@query("o165_distinct_words", "WITH w AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type || ' ' || p_name, ' ')) AS w, generate_subscripts(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '), 1) AS i FROM part), f AS (SELECT p_partkey, w, min(i) AS i FROM w WHERE w <> '' GROUP BY 1, 2) SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS ids FROM f GROUP BY 1")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(ops.distinct_ids(given), " ").alias("ids"))


@query("o196_cost_report", over("v_usage v_prices", f"WITH {REPORT} SELECT day, role, provider, model, calls, round(e, 6) AS estimated_cost_usd, round(CASE WHEN provider = 'subscription' THEN NULL WHEN e IS NULL THEN CASE WHEN calls > unpriced_calls THEN reported_cost_usd END ELSE reported_cost_usd + e END, 6) AS cost_usd, provider <> 'subscription' AND (unpriced_calls = 0 OR e IS NOT NULL) AS priced FROM est"))
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.report(ops.by_day(USAGE.frame(spark, sf_dir)), PRICES.frame(spark, sf_dir))
    return rows.select("day", "role", "provider", "model", "calls", F.round("estimated_cost_usd", 6).alias("estimated_cost_usd"), F.round("cost_usd", 6).alias("cost_usd"), "priced")


@query("o103_poisoned_cost", over("v_usage", "SELECT id // 2 AS task, CASE WHEN count(*) FILTER (WHERE cost_usd IS NULL) = 0 THEN round(sum(cost_usd), 6) END AS total_cost_usd FROM v_usage GROUP BY 1"))
def poisoned_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = ops.poisoned_total(USAGE.frame(spark, sf_dir).withColumn("task", F.floor(F.col("id") / 2)), "task")
    return total.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


@query("o106_models_by_stage", over("v_usage", "SELECT role, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM v_usage GROUP BY role"))
def models_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return USAGE.frame(spark, sf_dir).groupBy("role").agg(F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))


@query("o192_utc_days", over("v_usage", "SELECT id, strftime(ts, '%Y-%m-%d') AS day, cast(epoch_ms(date_trunc('day', ts)) AS bigint) AS day_ms FROM v_usage"))
def utc_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return USAGE.frame(spark, sf_dir).select("id", ops.day(F.col("ts")).alias("day"), F.unix_millis(F.date_trunc("day", "ts")).alias("day_ms"))


@query("o193_report_window", over("v_usage", "SELECT id FROM v_usage WHERE ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 6 DAY FROM v_usage)"))
def report_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = USAGE.frame(spark, sf_dir)
    return calls.where(F.col("ts") >= calls.select(ops.window_start(F.max("ts"), 7)).scalar()).select("id")


@query("o194_fresh_tokens", over("v_usage", "SELECT id, greatest(input_tokens - cached_input_tokens, 0) AS fresh_tokens, cached_input_tokens FROM v_usage WHERE input_tokens IS NOT NULL"))
def fresh_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = F.greatest(F.col("input_tokens") - F.col("cached_input_tokens"), F.lit(0))
    return USAGE.frame(spark, sf_dir).where("input_tokens IS NOT NULL").select("id", fresh.alias("fresh_tokens"), "cached_input_tokens")


@query("o197_cost_bounds", over("v_messages", "SELECT conv_id, cast(sum(octet_length(encode(content))) + 1024 + 32 * count(*) AS bigint) AS input_bound, round((sum(octet_length(encode(content))) + 1024 + 32 * count(*)) * 3::double / 1000000 + 6000 * 15::double / 1000000, 6) AS upper_bound_usd FROM v_messages GROUP BY 1"))
def cost_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.cost_bounds(MESSAGES.frame(spark, sf_dir))
    return found.withColumn("upper_bound_usd", F.round("upper_bound_usd", 6))


@query("o134_retry_ladder", "SELECT event_id, cast(least(event_id % 6, 2) AS bigint) AS provider_at, cast(least(60000, 15000 * power(2, event_id % 6)) AS bigint) AS wait_ms FROM events")
def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    return table(spark, sf_dir, "events").select("event_id", ops.retry_position(n).alias("provider_at"), ops.retry_wait(n).alias("wait_ms"))


@query("o053_retryable_embeddings", "SELECT event_id, event_id % 700 = 429 OR event_id % 700 >= 500 AS retryable FROM events")
def retryable_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ops.embedding_retryable(F.col("event_id") % 700).alias("retryable"))


@query("o216_backoff", "SELECT event_id, cast(500 * power(2, event_id % 8) AS bigint) AS wait_ms FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (500 * F.pow(F.lit(2.0), F.col("event_id") % 8)).cast("long").alias("wait_ms"))


@query("o011_price_list", "SELECT p_partkey, p_retailprice / 1000000000 AS prompt, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice / 10000000000 END, p_retailprice / 1000000000) AS cache_read FROM part WHERE p_retailprice >= 0")
def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice")
    cached = F.when(F.col("p_size") % 3 == 0, None).otherwise(p / 10_000_000_000)
    return table(spark, sf_dir, "part").where(p >= 0).select("p_partkey", (p / 1_000_000_000).alias("prompt"), F.coalesce(cached, p / 1_000_000_000).alias("cache_read"))
