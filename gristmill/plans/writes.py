"""Queries of writes: each gives the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import writes as ops
from gristmill.plans.registry import query
from gristmill.sources.tables import NEW_FILES, OLD_FILES, over, table


@query("o003_keyed_lookup", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_nationkey")


@query("o004_ordered_listing", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F'")
def ordered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", place.cast("long").alias("place"))


@query("o056_api_shape", "SELECT c_custkey AS id, c_name AS name, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') AS segment, c_acctbal > 0 AS active FROM customer")
def api_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("none"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), segment.alias("segment"), (F.col("c_acctbal") > 0).alias("active"))


@query("o021_upsert_files", over("v_old v_new", "SELECT coalesce(n.path, o.path) AS path, coalesce(n.blob_hash, o.blob_hash) AS blob_hash FROM v_old o FULL JOIN v_new n ON n.path = o.path"))
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.upsert(OLD_FILES.frame(spark, sf_dir).select("path", "blob_hash"), NEW_FILES.frame(spark, sf_dir).select("path", "blob_hash"), ["path"])


REPOS = "cur AS (SELECT c_custkey AS id, c_name AS branch, c_mktsegment AS instructions, 'ready' AS status FROM customer WHERE c_nationkey < 15), inc AS (SELECT c_custkey AS id, c_name || '!' AS branch, CASE WHEN c_nationkey > 10 THEN 'new' END AS instructions, 'queued' AS status FROM customer WHERE c_nationkey > 5)"


def _repos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    now = c.where("c_nationkey < 15").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("branch"), F.col("c_mktsegment").alias("instructions"), F.lit("ready").alias("status"))
    new = c.where("c_nationkey > 5").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("!")).alias("branch"), F.when(F.col("c_nationkey") > 10, "new").alias("instructions"), F.lit("queued").alias("status"))
    return now, new


@query("o020_upsert_repos", f"WITH {REPOS} SELECT coalesce(i.id, c.id) AS id, coalesce(i.branch, c.branch) AS branch, coalesce(i.instructions, c.instructions) AS instructions, coalesce(c.status, i.status) AS status FROM cur c FULL JOIN inc i ON i.id = c.id")
def upsert_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, new = _repos(spark, sf_dir)
    return ops.upsert(now, new, ["id"], keep=["status"], fill=["instructions"])


# settings by name, written several times in an order; the last write of a name stands, names that aren't written keep their value
@query("o026_upsert_values", "WITH n AS (SELECT event_type || (user_id % 5) AS key, arg_max(props, event_id) AS value FROM events WHERE event_id % 3 = 0 GROUP BY 1), w AS (SELECT event_type || (user_id % 7) AS key, arg_max(props, event_id) AS value FROM events WHERE event_id % 3 > 0 GROUP BY 1) SELECT coalesce(w.key, n.key) AS key, CASE WHEN w.key IS NULL THEN n.value ELSE w.value END AS value FROM n FULL JOIN w ON w.key = n.key")
def upsert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    of = lambda rows, n: rows.select(F.concat("event_type", (F.col("user_id") % n).cast("string")).alias("key"), F.col("props").alias("value"), "event_id")
    now = ops.last_writes(of(events.where("event_id % 3 = 0"), 5), "key", "event_id").drop("event_id")
    return ops.upsert(now, ops.last_writes(of(events.where("event_id % 3 > 0"), 7), "key", "event_id").drop("event_id"), ["key"])


@query("o031_marked_posted", "SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE cast(o_orderkey % 2 AS integer) END AS posted, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 <> 2 THEN 'new/' || o_orderkey WHEN o_orderkey % 5 > 0 THEN 'old/' || o_orderkey END AS review_url FROM orders")
def marked_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    now = orders.select(k.alias("review_id"), (k % 2).cast("int").alias("posted"), F.when(k % 5 > 0, F.concat(F.lit("old/"), k.cast("string"))).alias("review_url"))
    marks = orders.where(k % 3 == 1).select(k.alias("review_id"), F.when(k % 4 != 2, F.concat(F.lit("new/"), k.cast("string"))).alias("review_url"))
    return ops.marked_posted(now, marks)


@query("o025_partial_update", f"WITH {REPOS} SELECT c.id, CASE WHEN i.id IS NULL THEN c.branch ELSE coalesce(i.branch, c.branch) END AS branch, CASE WHEN i.id IS NULL THEN c.instructions ELSE i.instructions END AS instructions, c.status FROM cur c LEFT JOIN inc i ON i.id = c.id")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, new = _repos(spark, sf_dir)
    return ops.patch(now, new, "id", ["branch"], always=["instructions"])


@query("o023_last_vectors", "SELECT vec_id % 100 AS key, max(vec_id) AS vec_id FROM embeddings WHERE len(embedding) = 64 GROUP BY 1")
def last_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.search import valid_vector

    rows = table(spark, sf_dir, "embeddings").where(valid_vector(F.col("embedding"), 64)).select((F.col("vec_id") % 100).alias("key"), "vec_id")
    return ops.last_write(rows, ["key"], "vec_id")


@query("o027_idempotent_insert", "WITH k AS (SELECT user_id AS attempt, event_type AS seq, bool_or(event_id % 3 = 0) AS held FROM events WHERE event_type <> 'view' GROUP BY 1, 2) SELECT attempt, seq, CASE WHEN held THEN 'held' ELSE 'new' END AS origin FROM k UNION ALL SELECT user_id, NULL, 'new' FROM events WHERE event_type = 'view'")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("attempt"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("seq"), "event_id")
    held = rows.where("event_id % 3 = 0 AND seq IS NOT NULL").select("attempt", "seq").distinct().withColumn("origin", F.lit("held"))
    return ops.insert_new(held, rows.select("attempt", "seq", F.lit("new").alias("origin")), ["attempt", "seq"])


STATE = "st AS (SELECT o_orderkey AS id, o_custkey % 3 AS owner, o_orderkey % 4 AS generation FROM orders), att AS (SELECT o_orderkey AS id, o_custkey % 2 AS owner, o_orderkey % 3 AS generation FROM orders)"


@query("o028_guarded_update", f"WITH {STATE} SELECT a.id, CASE WHEN a.owner = s.owner AND a.generation = s.generation THEN 'applied' ELSE 'conflict' END AS outcome, CASE WHEN a.owner = s.owner AND a.generation = s.generation THEN a.generation + 1 ELSE s.generation END AS generation FROM att a LEFT JOIN st s ON s.id = a.id")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("owner"), (F.col("o_orderkey") % 4).alias("generation"))
    attempts = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2).alias("owner"), (F.col("o_orderkey") % 3).alias("generation"))
    return ops.guarded_update(state, attempts)


@query("o029_claims", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'busy' WHEN o_orderkey % 5 = 0 THEN 'incompatible' WHEN o_orderstatus = 'P' THEN 'blocked' ELSE 'claimed' END AS claim FROM orders")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, F.lit("job")).alias("owner"), (F.col("o_orderkey") % 5 != 0).alias("compatible"),
        F.when(F.col("o_orderstatus") == "P", "blocked").otherwise("active").alias("state"),
    )
    return ops.claim(rows).select("id", "claim")


@query("o032_recovered_jobs", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'error' END AS status FROM orders")
def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    return ops.recovered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status")))


@query("o033_pruned_payloads", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1995-01-01' THEN 'invalidated' WHEN o_orderstatus = 'F' THEN 'blocked' ELSE 'active' END AS state, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1995-01-01' THEN NULL ELSE o_orderpriority END AS payload FROM orders")
def pruned_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 2 == 1, F.lit("job")).alias("owner"), F.when(F.col("o_orderstatus") == "F", "blocked").otherwise("active").alias("state"),
        F.col("o_orderpriority").alias("payload"), F.col("o_orderdate").alias("at"),
    )
    return ops.pruned(rows, F.lit("1995-01-01").cast("timestamp")).select("id", "state", "payload")
