"""JSON records, counters, import graphs, remotes, polls and stateful streams on small fixtures."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import activity, counters, imports, index, records, search, vectors
from gristmill.streaming import deliveries, polls, triggers

GOOD = {"version": 1, "phase": "final", "completedUnits": [], "activeProviderIndex": 0, "retryAttemptsUsed": 2, "followupRetryAttemptsUsed": 0, "followupReserve": 0.1, "usedUsd": 1, "reservedUsd": 0, "warnings": ["w"]}


def test_progress_faults(spark):
    odd = [("version", v) for v in (2, "1", None, True, [1])] + [("phase", v) for v in ("Final", 1, None)] + [("completedUnits", {}), ("activeProviderIndex", 0.5), ("retryAttemptsUsed", "1"), ("usedUsd", None), ("reservedUsd", "0"), ("warnings", "w")]
    rows = [(json.dumps(GOOD), None), (json.dumps(GOOD | {"version": 1.0, "more": 1}), None), (None, "json"), ("", "json"), ("{", "json"), ("[]", "payload"), ("null", "payload"), ("3", "payload")]
    rows += [(json.dumps(GOOD | {k: v}), k) for k, v in odd] + [(json.dumps({x: y for x, y in GOOD.items() if x != k}), k) for k in GOOD]
    got = spark.createDataFrame(rows, "body string, want string").select("body", "want", records.progress_fault(F.col("body")).alias("fault")).collect()
    assert all(r["fault"] == r["want"] for r in got), [r for r in got if r["fault"] != r["want"]]


def test_price_lists(spark):
    data = [{"id": "a", "pricing": {"prompt": "0.000001", "completion": 2e-6}}, {"id": "b", "pricing": {"prompt": "-1", "completion": "1"}}, {"id": "c", "pricing": {"prompt": " ", "completion": "1"}}, {"id": 5, "pricing": {"prompt": 1, "completion": 1}}, {"id": "d"}, None, {"id": "a", "pricing": {"prompt": " 3 ", "completion": "4e0", "input_cache_read": "x", "input_cache_write": 0}}, {"id": "e", "pricing": {"prompt": "1e999", "completion": 1}}]
    given = spark.createDataFrame([(1, json.dumps({"data": data})), (2, "{"), (3, None), (4, '{"data": {}}'), (5, "[]")], "list_id int, body string")
    assert [tuple(r) for r in records.price_lists(given).collect()] == [(1, "a", 3.0, 4.0, 3.0, 0.0)]


def test_usage_records(spark):
    whole = {"input_tokens": 10, "output_tokens": 3, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 2}
    lone = {"m": {"inputTokens": 7, "outputTokens": 1, "canonicalModel": "M"}}
    calls = [{"usage": whole, "total_cost_usd": 0.5}, {"usage": whole, "modelUsage": lone, "total_cost_usd": 0.5}, {"usage": whole, "modelUsage": lone | {"n": {"inputTokens": 1, "outputTokens": 1, "costUSD": 0}}}, {"usage": whole, "modelUsage": {"m": {"inputTokens": "7", "outputTokens": 1}}}, {"usage": {"input_tokens": 1}}, {}, {"modelUsage": {"m": {"inputTokens": 1, "outputTokens": 2, "cacheReadInputTokens": 0}}, "usage": whole}]
    given = spark.createDataFrame([(k, "own", json.dumps(c)) for k, c in enumerate(calls)] + [(9, "own", None)], "call_id int, model string, body string")
    got = sorted(tuple(r) for r in records.usage_records(given).collect())
    assert got == [(0, "own", 10, 4, 2, 3, 0.5), (1, "M", 7, 4, 2, 1, 0.5), (2, "M", 7, 0, 0, 1, None), (2, "n", 1, 0, 0, 1, 0.0), (3, "own", 10, 4, 2, 3, None), (6, "m", 1, 0, 0, 2, None)]


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


SAMPLES = [("a", at(1), 5.0), ("a", at(20), 9.0), ("a", at(70), 12.0), ("a", at(80), 2.0), ("a", at(200), 1.0), ("b", at(5), 4.0), ("b", at(130), 4.0), ("c", at(5), None), (None, at(5), 1.0), (None, at(6), 3.0)]


def test_counters_with_resets_and_gaps(spark):
    given = spark.createDataFrame(SAMPLES, "series string, ts timestamp, value double")
    got = {(r["series"], r["window_start"].hour): (r["increase"], r["n"]) for r in counters.increases(given, ["series"], "value", "1 hour", ["ts", "value"]).collect()}
    assert got == {("a", 0): (4, 2), ("a", 1): (5, 2), ("a", 3): (1, 1), ("b", 0): (0, 1), ("b", 2): (0, 1), (None, 0): (2, 2)}
    both = given.withColumn("sum", F.col("value") * 3)
    means = {(r["series"], r["window_start"].hour): r["mean"] for r in counters.means(both, ["series"], "sum", "value", "1 hour", ["ts", "value"]).collect()}
    assert means["a", 1] == 3 and means["b", 2] is None
    assert counters.increases(given.limit(0), ["series"], "value", "1 hour", ["ts"]).count() == 0


def test_import_edges_and_dependants(spark):
    files = [("src/a.ts", "import { b } from './b.js';\nimport x from \"react\"\nexport * from '../lib'\nimport('./nowhere')"), ("src/b.ts", "import './a'"), ("lib/index.ts", "const c = require('../src/./deep/../c')"), ("src/c.js", None), ("src/c.ts", "import type {\n T,\n} from './c.ts'"), ("top.ts", "import '../../src/a.ts'")]
    given = spark.createDataFrame(files + files[:1], "path string, content string")
    edges = imports.edges(given)
    assert {tuple(r) for r in edges.collect()} == {("src/a.ts", "./b.js", "src/b.ts"), ("src/a.ts", "../lib", "lib/index.ts"), ("src/b.ts", "./a", "src/a.ts"), ("lib/index.ts", "../src/./deep/../c", "src/c.ts"), ("src/c.ts", "./c.ts", "src/c.ts"), ("top.ts", "../../src/a.ts", "src/a.ts")}
    changed = spark.createDataFrame([("src/c.ts",), (None,)], "path string")
    assert {tuple(r) for r in imports.dependants(edges, changed).collect()} == {("lib/index.ts", 1), ("src/a.ts", 2), ("src/b.ts", 3), ("top.ts", 3)}
    assert {tuple(r) for r in imports.dependants(edges, changed, depth=1).collect()} == {("lib/index.ts", 1)}
    assert imports.dependants(edges, changed.limit(0)).count() == 0


@pytest.mark.parametrize(
    "spelled, reference",
    [("https://github.com/Acme/Widgets.git", "github:acme/widgets"), ("git@github.com:acme/widgets.git", "github:acme/widgets"), ("ssh://git@github.com/acme/widgets", "github:acme/widgets"), ("git://github.com/a/b/", "github:a/b"), ("http://user:pw@github.com/a/b.c.git//", "github:a/b.c"), ("Acme/Widgets", "github:acme/widgets"), ("github.com/a/b", "github:a/b"), ("https://gitlab.com/o/n", None), ("", None), (None, None), ("not a remote at all", None), ("a/.", None), ("./", None), ("/srv/R.git", "local:r"), ("~/x/Repo/", "local:repo"), ("https://github.com/a/b/c", None)],
)
def test_remotes(spark, spelled, reference):
    got = spark.createDataFrame([(spelled,)], "s string").select(activity.remote(F.col("s")).alias("r")).first()["r"]
    assert got["reference"] == reference and (got["fault"] is None) == (reference is not None)


def test_polls_as_a_stream_with_a_failing_repository(spark, tmp_path):
    shape = "repo_id string, head string, pulls string, fault string"
    pulls = '[{"number":1,"head_sha":"p"},{"number":2,"head_sha":"q"},{"number":3,"head_sha":"r","draft":true},{"number":4}]'
    rounds = [("a", "h1", pulls, None), ("b", "h1", "{", None), ("c", None, None, "timeout"), ("d", "h0", None, None), ("x", "h1", None, None)]
    spark.createDataFrame(rounds, shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    repos = spark.createDataFrame([(r, "h0", "ready") for r in "abcd"], "repo_id string, last_commit string, status string")
    posted = spark.createDataFrame([("a", 1, "p")], "repo_id string, pr_number long, head_sha string")
    source = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    polls.poll_rounds(source, lambda: repos, lambda: posted, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "index", None, "h1"), ("a", "review", 2, "q"), ("b", "fault", None, "pulls can't be read"), ("c", "fault", None, "timeout")}


def test_remembered_deliveries_evict_the_oldest(spark):
    rows = [("s", "a", 0), ("s", "b", 1), ("s", "a", 2), ("s", "c", 3), ("s", "a", 4), ("s", "b", 5), ("t", "a", 4), ("s", "b", 200), (None, "a", 1), ("s", None, 1), ("s", "z", None)]
    given = spark.createDataFrame(rows, "scope string, key string, at long")
    got = sorted(map(tuple, activity.remembered_deliveries(given, 100, 2).collect()), key=repr)
    assert got == sorted([("s", "a", 0), ("s", "b", 1), ("s", "c", 3), ("s", "a", 4), ("s", "b", 5), ("t", "a", 4), ("s", "b", 200), (None, "a", 1)], key=repr)


def run_stream(spark, tmp_path, batches, shape, stream, name):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = stream(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return q, [tuple(r) for r in spark.table(name).collect()]


def test_remembered_stream_as_in_batch(spark, tmp_path):
    batches = [[("s", "a", 0), ("s", "b", 1), ("t", "a", 2)], [("s", "c", 3), ("s", "a", 4), ("t", "a", 5)], [("s", "b", 200), ("t", "a", 300), (None, "q", 301)]]
    _, got = run_stream(spark, tmp_path, batches, "scope string, key string, at long", lambda s: deliveries.dedupe_remembered(s, 100, 2), "remembered")
    batch = activity.remembered_deliveries(spark.createDataFrame(sum(batches, []), "scope string, key string, at long"), 100, 2)
    assert sorted(got, key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_state_of_deliveries_goes_when_its_time_has_run_out(spark, tmp_path):
    batches = [[("a", 0), ("a", 10), ("b", 5)], [("a", 3700), ("b", 3605), ("b", 3606)], [("z", 20_000)], [("z", 20_001)], [("y", 40_000)], [("a", 10)]]
    q, got = run_stream(spark, tmp_path, batches, "key string, at long", deliveries.dedupe, "taken")
    # the last row comes later than the watermark, and is dropped
    assert set(got) == {("a", 0), ("a", 3700), ("b", 5), ("b", 3606), ("z", 20_000), ("y", 40_000)}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress) if p["stateOperators"]]
    assert states[-1] < max(states)


def test_counter_steps_stream_as_in_batch(spark, tmp_path):
    rows = [(s, t, v) for s, t, v in SAMPLES if s is not None]
    _, got = run_stream(spark, tmp_path, [rows[:3], rows[3:6], rows[6:]], "series string, ts timestamp, value double", lambda s: deliveries.counter_steps(s, "10 hours"), "steps")
    batch = counters.increases(spark.createDataFrame(rows, "series string, ts timestamp, value double"), ["series"], "value", "1 hour", ["ts"])
    sums = {}
    for series, ts, grown in got:
        sums[series, ts.replace(minute=0)] = sums.get((series, ts.replace(minute=0)), 0) + grown
    assert sums == {(r["series"], r["window_start"]): r["increase"] for r in batch.collect()}


CHUNK = "chunk_id long, repo_id string, path string, content string"


def test_index_over_generations(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(k, f"r{k % 3}", f"src/{words[k % 6]}{k}.ts", " ".join(words[(k * j) % 6] for j in range(1, 2 + k % 7)) if k % 11 else None) for k in range(300)]
    queries = spark.createDataFrame([(1, "alpha gamma"), (2, "zeta"), (3, "nothing here"), (4, "beta delta eps"), (5, None)], "query_id long, query string")
    top = lambda ix, **more: {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 9)) for r in ix.top(queries, 20, **more).collect()}
    brute = lambda rows: {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 9)) for r in search.lexical_top(spark.createDataFrame([(a, b, c, d or "") for a, b, c, d in rows], CHUNK), queries, 20).collect()}
    ix = index.SearchIndex(spark, f"file://{tmp_path}/ix").build(spark.createDataFrame(rows, CHUNK))
    assert top(ix) == top(ix, skip=True) == brute(rows)
    new = [(a, b, c, "alpha alpha zeta" if a % 50 == 7 else d) for a, b, c, d in rows if not 64 <= a < 96] + [(1_000, "r1", "src/new.ts", "gamma gamma")]
    changed = spark.createDataFrame([(a,) for a in [*range(64, 96), *range(7, 300, 50), 1_000]], "chunk_id long")
    ix.update(spark.createDataFrame(new, CHUNK), changed)
    assert ix.generations() == [0, 1] and top(ix) == top(ix, skip=True) == brute(new)
    # a generation that wasn't finished is not read
    ix.postings().drop("gen").limit(5).write.partitionBy("bucket").parquet(f"file://{tmp_path}/ix/postings/gen=7")
    assert top(ix) == brute(new)
    ix.compact()
    assert len(ix.generations()) == 1 and top(ix) == brute(new)
    scoped = top(ix, repos=["r1"])
    assert scoped and all(new_id % 3 == 1 for new_id, _ in scoped.values())


def test_index_reads_the_buckets_of_its_terms(spark, tmp_path):
    rows = spark.range(2_000).selectExpr("id AS chunk_id", "'r' AS repo_id", "concat('f', id) AS path", "concat('common w', id % 97) AS content")
    ix = index.SearchIndex(spark, f"file://{tmp_path}/ix").build(rows)
    found = ix.top(spark.createDataFrame([(1, "w13")], "query_id long, query string"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "PushedFilters: [In(term" in plan or "EqualTo(term,w13)" in plan
    assert found.count() == 5
    empty = index.SearchIndex(spark, f"file://{tmp_path}/none").build(rows.limit(0))
    assert empty.top(spark.createDataFrame([(1, "w13")], "query_id long, query string")).count() == 0


def test_vector_index_is_exact_and_leaves_out_far_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = 20 * rng.normal(size=(12, 8))
    points = centres[rng.integers(0, 12, 4_000)] + rng.normal(size=(4_000, 8))
    points[100:400] = points[100]  # a large group of copies
    rows = [(k, "hot" if k % 3 else f"r{k % 5}", p.tolist()) for k, p in enumerate(points)]
    odd = [(9_001, "hot", None), (9_002, "hot", [1.0]), (9_003, "hot", [float("nan")] * 8), (None, "hot", [0.0] * 8), (9_004, None, [0.0] * 8), (9_005, "lone", [0.0] * 8)]
    held = spark.createDataFrame(rows + odd, "chunk_id long, repo_id string, embedding array<double>")
    probes = spark.createDataFrame([(q, r, points[q].tolist()) for q in range(0, 300, 7) for r in ("hot", "r1")] + [(1_000, "lone", [1.0] * 8), (1_001, "none", [1.0] * 8), (1_002, "hot", None)], "query_id long, repo_id string, probe array<double>")
    ix = vectors.VectorIndex(spark, f"file://{tmp_path}/v", 8).build(held)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["repo_id"], round(r["distance"], 9)) for r in ix.nearest(probes, 20).collect()}
    valid = held.where(search.valid_vector(F.col("embedding"), 8) & F.col("chunk_id").isNotNull())
    want = {(r["query_id"], r["rank"]): (r["chunk_id"], r["repo_id"], round(r["distance"], 9)) for r in search.nearest(valid, probes.where("probe IS NOT NULL"), 20).collect()}
    assert got == want and (1_000, 1) in got
    share = ix.met(probes.where("probe IS NOT NULL"), 20).agg(F.sum("n")).first()[0] / probes.join(valid, "repo_id").count()
    assert share < 0.35
    empty = vectors.VectorIndex(spark, f"file://{tmp_path}/e", 8).build(held.limit(0))
    assert empty.exists() and empty.nearest(probes).count() == 0


def test_journal_keeps_null_keys_and_compacts(spark, tmp_path):
    rows = [(1, 1, "b"), (1, 1, "a"), (1, 2, "c"), (None, 1, "d"), (None, 1, "d"), (2, None, "e")]
    spark.createDataFrame(rows, "attempt long, seq long, note string").coalesce(1).write.parquet(str(tmp_path / "u"))
    out = str(tmp_path / "out")
    for run in range(2):
        source = spark.readStream.schema("attempt long, seq long, note string").parquet(str(tmp_path / "u"))
        triggers.journal(source, out, str(tmp_path / f"cp{run}"), order=["note"], buckets=8).trigger(availableNow=True).start().awaitTermination(120)
        got = sorted((tuple(r) for r in spark.read.parquet(out).select("attempt", "seq", "note").collect()), key=repr)
        assert got == sorted([(1, 1, "a"), (1, 2, "c"), (None, 1, "d"), (None, 1, "d"), (2, None, "e")], key=repr)
    triggers.compact_journal(spark, out)
    assert sorted((tuple(r) for r in spark.read.parquet(out).select("attempt", "seq", "note").collect()), key=repr) == got


def test_remembered_deliveries_of_the_whole_table(spark, sf_dir):
    from gristmill.plans import registry

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type", "cast(user_id AS string) AS k", "floor(unix_micros(cast(ts AS timestamp)) / 1000000) AS at").collect()
    want, held = [], {}
    for scope, key, at in sorted(map(tuple, rows), key=lambda r: (r[0], r[2], r[1])):
        seen = held.setdefault(scope, [])
        seen[:] = [(k, t) for k, t in seen if at - t <= 86_400]
        if key not in {k for k, _ in seen}:
            want.append((scope, key, at))
            seen[:] = [*seen, (key, at)][-50:]
    got = sorted(tuple(r) for r in registry.QUERIES["o252_remembered_deliveries"](spark, sf_dir).collect())
    assert got == sorted(want) and len(got) < len(rows)


def test_accepted_deliveries_by_bursts(spark):
    rng = np.random.default_rng(12)
    rows = [(str(k) if k else None, int(t)) for k in range(4) for t in np.cumsum(rng.choice([0, 1, 4, 11, 12, 40, 5_000], 900, p=[0.1, 0.4, 0.2, 0.1, 0.1, 0.09, 0.01]))]
    given = spark.createDataFrame([*rows, ("1", None)], "key string, at long").repartition(5)
    for ttl in (0, 11):
        last, want = {}, []
        for key, at in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            if key not in last or at - last[key] > ttl:
                last[key] = at
                want.append((key, at))
        got = [tuple(r) for r in activity.accepted_deliveries(given, ttl).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    bursts = activity._bursts(given.where("at IS NOT NULL"), 11).where("key = '1'").agg(F.countDistinct("burst")).first()[0]
    assert bursts > 50
