import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.operators import activity, reviews, search, usage, writes
from gristmill.streaming import deliveries, triggers

PRICES = "model_id string, prompt double, completion double, cache_read double, cache_write double"


def test_list_price(spark):
    price = spark.createDataFrame([("anthropic/claude-x-4.5", 1e-6, 5e-6, 1e-7, 1.25e-6)], PRICES)
    calls = spark.createDataFrame([("claude-cli", "claude-x-4-5", 10, 0, 7508, 258)], "provider string, model string, input_tokens long, cached_input_tokens long, cache_write_tokens long, output_tokens long")
    got = calls.join(usage.resolve_prices(calls, price), ["provider", "model"]).select(usage.estimated().alias("e")).first()["e"]
    assert got == pytest.approx(0.010685)


@pytest.mark.parametrize("provider, model, ids", [("openrouter", "a/b:nitro", ["a/b:nitro", "a/b"]), ("claude-cli", "opus", ["~anthropic/claude-opus-latest"]), ("codex-cli", "g", ["openai/g"]), ("claude-cli", "default", []), ("x", "", []), ("x", None, [])])
def test_candidate_ids(spark, provider, model, ids):
    assert spark.range(1).select(usage.candidate_ids(F.lit(provider), F.lit(model).cast("string")).alias("v")).first()["v"] == ids


def test_unknown_cost_is_not_zero(spark):
    days = spark.createDataFrame(
        [("d", "r", "p", "m", 2, 1.0, 1), ("d", "r", "p", "n", 1, 0.0, 1), ("d", "r", "subscription", "m", 1, 0.0, 1)], "day string, role string, provider string, model string, calls long, reported_cost_usd double, unpriced_calls long"
    )
    for t in usage.TOKENS:
        days = days.withColumn(f"unpriced_{t}", F.lit(1).cast("long"))
    rows = {(r["provider"], r["model"]): (r["estimated_cost_usd"], r["cost_usd"], r["priced"]) for r in usage.report(days, spark.createDataFrame([], PRICES)).collect()}
    assert rows == {("p", "m"): (None, 1.0, False), ("p", "n"): (None, None, False), ("subscription", "m"): (None, None, False)}


def test_rank_fusion(spark):
    ranks = lambda ids: spark.createDataFrame([(1, c, k + 1) for k, c in enumerate(ids)], "query_id long, chunk_id long, rank long")
    got = {r["chunk_id"]: r["rrf"] for r in search.fused(ranks([1, 2, 3]), ranks([1, 4, 5])).collect()}
    assert got[1] == pytest.approx(2 / 61) and got[2] == got[4] == pytest.approx(1 / 62)


def test_exclusions_come_after_the_pools(spark):
    chunks = spark.createDataFrame([(k, "r", f"src/f{k}.ts", "needle hay") for k in range(5)], "chunk_id long, repo_id string, path string, content string")
    queries = spark.createDataFrame([(1, "needle")], "query_id long, query string")
    none = spark.createDataFrame([], "chunk_id long, repo_id string, embedding array<float>"), spark.createDataFrame([], "query_id long, repo_id string, probe array<float>")
    found = search.search(chunks, none[0], queries, none[1], excluded=["src/f0.ts", "src/f1.ts"], limit=1).collect()
    assert [r["chunk_id"] for r in found] == [2]
    assert search.search(chunks, none[0], queries, none[1], excluded=[f"src/f{k}.ts" for k in range(3)], limit=1).count() == 0


def test_context_keeps_the_first_block(spark):
    blocks = spark.createDataFrame([(1, 1, "x" * 50, 4), (1, 2, "y" * 10, 4), (2, 1, "a" * 10, 4), (2, 2, "b" * 5, 4), (2, 3, "c" * 90, 4), (2, 4, "d", 4)], "query_id long, rank int, block string, bare int")
    got = {r["query_id"]: r["context"] for r in search.context(blocks, 30).collect()}
    assert len(got[1]) == 30 and got[2] == "a" * 10 + "\n\n" + "b" * 5


def test_duplicate_roots(spark):
    links = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (8, 9), (9, 8)], "id long, target long")
    assert {r["id"]: r["root"] for r in reviews.roots(links).collect()} == {1: 0, 2: 0, 3: 0, 8: None, 9: None}


def test_upsert_keeps_and_fills(spark):
    now = spark.createDataFrame([(1, "a", "keep", "ready")], "id long, branch string, note string, status string")
    new = spark.createDataFrame([(1, "b", None, "queued"), (2, "c", "n", "queued")], "id long, branch string, note string, status string")
    got = writes.upsert(now, new, ["id"], keep=["status"], fill=["note"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "b", "keep", "ready"), (2, "c", "n", "queued")]


def test_null_keys_always_go_in(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 1)], "attempt string, seq long")
    assert writes.insert_new(rows.limit(0), rows, ["attempt", "seq"]).count() == 3


def test_widened_question(spark):
    talk = spark.createDataFrame(
        [(1, 0, "user", "how is login done"), (1, 1, "assistant", "See src/auth.ts:12-40 and checkToken, checkToken"), (1, 2, "user", "and expiry?")], "conv_id long, turn long, role string, content string"
    )
    got = {r["turn"]: r["query"] for r in activity.widened_questions(talk).collect()}
    assert got[0] == "how is login done"
    assert got[2].startswith("and expiry? src/auth.ts checkToken") and got[2].endswith("login")


def test_accepted_deliveries_hold_no_history(spark):
    """One key with most of the rows, over many batches: no array of its history is built."""
    rows = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN id % 7 ELSE -1 END AS key", "id AS at")
    found = activity.accepted_deliveries(rows, 10)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got, want = {tuple(r) for r in found.collect()}, set()
    last = {}
    for i in range(60_000):
        key = i % 7 if i % 3 == 0 else -1
        if key not in last or i - last[key] > 10:
            last[key] = i
            want.add((key, i))
    assert got == want


def test_accepted_deliveries_stream_as_in_batch(spark, tmp_path):
    for k, rows in enumerate([[("a", 0), ("a", 10), ("b", 5)], [("a", 3700), ("b", 3605), ("b", 3606)]]):
        spark.createDataFrame(rows, "key string, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    batch = spark.read.parquet(*[str(tmp_path / f"in{k}") for k in range(2)])
    want = {tuple(r) for r in activity.accepted_deliveries(batch, 3600).collect()}
    assert want == {("a", 0), ("a", 3700), ("b", 5), ("b", 3606)}
    source = spark.readStream.schema("key string, at long").parquet(str(tmp_path / "in*"))
    q = deliveries.dedupe(source).writeStream.format("memory").queryName("accepted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("accepted").collect()} == want


def test_settle_windows_stream_as_in_batch(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [("a", at(0)), ("a", at(3)), ("a", at(60)), ("b", at(5)), ("z", at(600))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "t"))
    source = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "t"))
    q = triggers.settle_windows(source, "10 minutes", "1 minute").writeStream.format("memory").queryName("settled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = activity.debounced(spark.read.parquet(str(tmp_path / "t")), "10 minutes").where("key <> 'z'")
    assert {tuple(r) for r in spark.table("settled").collect()} == {tuple(r) for r in batch.collect()}


def test_journal_takes_each_call_once(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "attempt long, seq long").write.parquet(str(tmp_path / "u"))
    for run in range(2):
        source = spark.readStream.schema("attempt long, seq long").parquet(str(tmp_path / "u"))
        triggers.journal(source, str(tmp_path / "out"), str(tmp_path / f"cp{run}")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
