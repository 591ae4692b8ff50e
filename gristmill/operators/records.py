"""JSON records as they arrive: progress of reviews, price lists, usage of model calls. Types are told apart, a fault is a row.

Texts are parsed once, to VARIANT. A text that isn't JSON, or names a key of an object twice, parses to null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phases of a review and the fields of its progress by their kind.
PHASES = ["preparation", "discovery", "escalation", "rule_validation", "verification", "arbitration", "evidence", "reconciliation", "final"]
ARRAYS, WHOLE, FINITE = ["completedUnits", "warnings"], ["activeProviderIndex", "retryAttemptsUsed", "followupRetryAttemptsUsed"], ["followupReserve", "usedUsd", "reservedUsd"]
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def kind(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null`` (JSON's own); null where there is nothing."""
    of = F.schema_of_variant(value)
    return F.when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array").when(of == "STRING", "string").when(of.rlike(NUMBER), "number").when(of == "BOOLEAN", "boolean").when(of == "VOID", "null")


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def number(value: Column) -> Column:
    """A finite JSON number; null for anything else, numbers in quotes among them."""
    as_double = F.try_variant_get(value, "$", "double")
    return F.when((kind(value) == "number") & (F.abs(as_double) < float("inf")), as_double)


def string(value: Column) -> Column:
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string"))


def _is(value: Column, name: str) -> Column:
    return F.coalesce(kind(value) == name, F.lit(False))


def progress_fault(text: Column) -> Column:
    """Why a stored progress isn't valid: ``json`` (no JSON), ``payload`` (no object), or its first field of a wrong kind; null if it is valid."""
    v = parsed(text)
    whole = lambda name: F.coalesce(number(at(v, f"$.{name}")) == F.floor(number(at(v, f"$.{name}"))), F.lit(False))
    checks = [("version", F.coalesce(number(at(v, "$.version")) == 1, F.lit(False))), ("phase", F.coalesce(string(at(v, "$.phase")).isin(PHASES), F.lit(False))), ("completedUnits", _is(at(v, "$.completedUnits"), "array"))]
    checks += [(n, whole(n)) for n in WHOLE] + [(n, number(at(v, f"$.{n}")).isNotNull()) for n in FINITE] + [("warnings", _is(at(v, "$.warnings"), "array"))]
    return F.coalesce(F.when(v.isNull(), "json"), F.when(~_is(v, "object"), "payload"), *[F.when(~good, name) for name, good in checks])


def documents(rows: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """``rows`` with ``shape`` (the kind of the JSON in column ``text``, null if it is none) and each of ``fields`` as a number, null where it isn't one."""
    held = rows.withColumn("__v", parsed(F.col(text)))
    return held.select(*rows.columns, kind(F.col("__v")).alias("shape"), *[number(at(F.col("__v"), f"$.{n}")).alias(n) for n in fields])


def _price(value: Column) -> Column:
    """A price: a finite number, or decimal text of one, that isn't negative."""
    said = string(value)
    told = F.coalesce(number(value), F.when(said.rlike(DECIMAL_TEXT), F.trim(said).try_cast("double")))
    return F.when((told >= 0) & (told < float("inf")), told)


def price_lists(rows: DataFrame) -> DataFrame:
    """list_id, model_id, prompt, completion, cache_read, cache_write of every priced entry of ``rows`` (list_id, body).

    ``body`` holds the entries in ``data``. An entry without a text id, or without both base prices, drops out; cache prices fall back to the
    prompt's. Of entries with one id in a list the last stands.
    """
    entries = rows.select("list_id", F.posexplode(F.try_variant_get(parsed(F.col("body")), "$.data", "array<variant>")).alias("place", "e"))
    e = lambda name: at(F.col("e"), f"$.pricing.{name}")
    told = entries.select("list_id", "place", string(at(F.col("e"), "$.id")).alias("model_id"), _price(e("prompt")).alias("prompt"), _price(e("completion")).alias("completion"), _price(e("input_cache_read")).alias("r"), _price(e("input_cache_write")).alias("w"))
    valid = told.where("model_id IS NOT NULL AND prompt IS NOT NULL AND completion IS NOT NULL")
    price = F.struct("prompt", "completion", F.coalesce("r", "prompt").alias("cache_read"), F.coalesce("w", "prompt").alias("cache_write"))
    return valid.groupBy("list_id", "model_id").agg(F.max_by(price, "place").alias("p")).select("list_id", "model_id", "p.*")


def usage_records(rows: DataFrame) -> DataFrame:
    """call_id, model, input_tokens, cached_input_tokens, cache_write_tokens, output_tokens, cost_usd of ``rows`` (call_id, model, body).

    Entries for each model are preferred to the aggregate; those without both counts drop out. A lone entry that has no cache
    counts takes the aggregate's, and its cost if it has none. Without entries the aggregate is one record of the call's own model; without counts
    there is none.
    """
    c = F.col
    call = rows.select("call_id", c("model").alias("own"), parsed(c("body")).alias("v"))
    of = lambda name: number(at(c("v"), f"$.{name}"))
    call = call.select("call_id", "own", "v", of("usage.input_tokens").alias("input"), of("usage.output_tokens").alias("output"), of("usage.cache_read_input_tokens").alias("read"), of("usage.cache_creation_input_tokens").alias("write"), of("total_cost_usd").alias("cost"), _is(at(c("v"), "$.usage"), "object").alias("told"))
    each = F.map_entries(F.coalesce(F.try_variant_get("v", "$.modelUsage", "map<string, variant>"), F.create_map().cast("map<string, variant>")))
    m = lambda e, name: number(at(e["value"], f"$.{name}"))
    entry = lambda e: F.struct(
        F.coalesce(string(at(e["value"], "$.canonicalModel")), e["key"]).alias("model"), m(e, "inputTokens").alias("input"), m(e, "outputTokens").alias("output"),
        m(e, "cacheReadInputTokens").alias("read"), m(e, "cacheCreationInputTokens").alias("write"), m(e, "costUSD").alias("cost"),
    )
    held = call.withColumn("entries", F.filter(F.transform(each, entry), lambda e: e["input"].isNotNull() & e["output"].isNotNull()))
    bare = c("e.read").isNull() & c("e.write").isNull() & (F.size("entries") == 1) & c("told")
    per_model = held.select("*", F.explode("entries").alias("e")).select(
        "call_id", "e.model", "e.input", F.coalesce(F.when(bare, c("read")).otherwise(c("e.read")), F.lit(0.0)).alias("read"), F.coalesce(F.when(bare, c("write")).otherwise(c("e.write")), F.lit(0.0)).alias("write"),
        "e.output", F.coalesce(c("e.cost"), F.when(bare, c("cost"))).alias("cost"),
    )
    whole = held.where((F.size("entries") == 0) & c("told") & c("input").isNotNull() & c("output").isNotNull())
    whole = whole.select("call_id", c("own").alias("model"), "input", F.coalesce("read", F.lit(0.0)).alias("read"), F.coalesce("write", F.lit(0.0)).alias("write"), "output", "cost")
    return per_model.unionByName(whole).toDF("call_id", "model", "input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "cost_usd")
