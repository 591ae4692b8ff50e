"""Tables and the domain views over them.

Tables are Parquet files of a folder. A view is a plain projection of one table into the engine's own records (files,
chunks, usage events, reviews, findings, messages); its expressions mean the same to Spark and to other SQL engines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name``; timestamps without a zone are read as UTC instants, which streaming and windows need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else df


#: Rows that a task of a dealt view holds, about, and parts up to which Spark's own numbers do.
PART_ROWS, FEW_PARTS = 250_000, 8


@dataclass(frozen=True)
class View:
    """Columns of ``source`` by name; ``where`` keeps some rows. Large tables of a view ``dealt`` by a column are cut by it into parts whose number grows with the rows, so that what a task sorts stays the same."""

    source: str
    columns: dict[str, str]
    where: str | None = None
    dealt: str | None = None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source)
        if self.dealt and (parts := -(-rows.count() // PART_ROWS)) > FEW_PARTS:
            rows = rows.repartition(parts, self.dealt)
        return (rows.where(self.where) if self.where else rows).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    def sql(self) -> str:
        body = f"SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.source}"
        return f"{body} WHERE {self.where}" if self.where else body


FILES = View("documents", {
    "file_id": "doc_id", "repo_id": "source",
    "path": "concat(CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'tests/' WHEN 3 THEN 'node_modules/' WHEN 4 THEN 'src/generated/' ELSE '' END, "
            "CASE doc_id % 11 WHEN 0 THEN 'CHANGELOG' WHEN 1 THEN 'Dockerfile' ELSE concat('file', cast(doc_id AS string)) END, "
            "CASE doc_id % 8 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.md' WHEN 3 THEN '.min.js' WHEN 4 THEN '.lock' WHEN 5 THEN '.png' WHEN 6 THEN '.test.ts' ELSE '' END)",
    "size": "n_chars", "doc_lang": "lang", "content": "text",
})
CHUNKS = View("documents", {
    "chunk_id": "doc_id", "repo_id": "source",
    "path": "concat(CASE doc_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'tests/' ELSE 'lib/' END, 'file', cast(doc_id AS string), "
            "CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.md' ELSE '.py' END)",
    "start_line": "1", "content": "text",
})
VECTORS = View("embeddings", {"chunk_id": "vec_id", "repo_id": "concat('repo', cast(label AS string))", "embedding": "embedding"})
SEARCHES = View("benchmark", {"query_id": "item_id", "query": "text"})
USAGE = View("events", {
    "id": "event_id", "ts": "ts",
    "role": "CASE event_type WHEN 'click' THEN 'review' WHEN 'view' THEN 'chat' WHEN 'signup' THEN 'chat' WHEN 'purchase' THEN 'embed' ELSE 'review' END",
    "provider": "CASE user_id % 4 WHEN 0 THEN 'openrouter' WHEN 1 THEN 'claude-cli' WHEN 2 THEN 'embeddings' ELSE 'subscription' END",
    "model": "concat('m', cast(user_id % 7 AS string))",
    "input_tokens": "cast(regexp_extract(props, '[0-9]+', 0) AS bigint)",
    "cached_input_tokens": "event_id % 50", "cache_write_tokens": "event_id % 5", "output_tokens": "event_id % 20",
    "cost_usd": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / cast(1000 AS double) END",
})
PRICES = View("part", {
    "model_id": "concat('m', cast(p_partkey AS string))",
    "prompt": "p_retailprice / cast(1000000000 AS double)", "completion": "p_retailprice / cast(250000000 AS double)",
    "cache_read": "CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / cast(10000000000 AS double) ELSE p_retailprice / cast(1000000000 AS double) END",
    "cache_write": "p_retailprice / cast(800000000 AS double)",
})
REVIEWS = View("orders", {
    "review_id": "o_orderkey", "repo_id": "concat('repo', cast(o_custkey % 20 AS string))", "pr_number": "o_custkey % 50",
    "head_sha": "concat('sha', cast(o_orderkey % 7 AS string))",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'error' ELSE 'queued' END",
    "posted": "o_orderkey % 2",
    "cost_usd": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / cast(1000000 AS double) END", "created_at": "o_orderdate",
})
FINDINGS = View("lineitem", {
    "review_id": "l_orderkey",
    "ordinal": "cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
               "l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS bigint)",
    "path": "concat('src/p', cast(l_partkey % 50 AS string), '.ts')", "line": "cast(l_linenumber AS bigint)",
    "severity": "CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'nit' END",
    "category": "CASE WHEN l_partkey % 10 = 0 THEN 'test_gap' WHEN l_linestatus = 'F' THEN 'correctness' ELSE 'security' END",
    "title": "concat('title ', cast(l_suppkey % 10 AS string))",
    "root_cause": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('  Cause   ', cast(l_partkey % 20 AS string), ' ') END",
}, dealt="l_orderkey")
CODE = View("documents", {
    "file_id": "doc_id", "pull_id": "doc_id % 20",
    "path": "CASE WHEN doc_id % 5 = 0 THEN concat('tests/f', cast(doc_id AS string), '.test.ts') ELSE concat('src/f', cast(doc_id AS string), '.ts') END",
    "content": "concat('export function fn', cast(doc_id % 40 AS string), '(a) {', chr(10), '}', chr(10), 'export { x as y', cast(doc_id % 23 AS string), ', z', cast(doc_id % 7 AS string), ' };', chr(10), 'call(fn', cast((doc_id + 20) % 40 AS string), ')')",
})
CHANGES = View("documents", {
    "file_id": "doc_id", "pull_id": "doc_id % 20",
    "path": "CASE WHEN doc_id % 5 = 0 THEN concat('tests/f', cast(doc_id AS string), '.test.ts') ELSE concat('src/f', cast(doc_id AS string), '.ts') END",
    "text": "concat('export function fn', cast(doc_id % 40 AS string), '(a) {', chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('class K', cast(doc_id % 9 AS string), ' {', chr(10)) END, "
            "'const ar', cast(doc_id % 13 AS string), ' = (x) => y', cast(doc_id % 23 AS string), '.get(z', cast(doc_id % 5 AS string), ')')",
})
#: The texts themselves as code: clauses become declarations, sentences export lists; the names are whatever words stand there.
DRAFTS = View("documents", {
    "file_id": "doc_id", "path": "CASE WHEN doc_id % 3 = 0 THEN concat('tests/Draft', cast(doc_id AS string), '.test.ts') ELSE concat('src/draft_file', cast(doc_id AS string), '.py') END",
    "content": "replace(replace(replace(text, 's, ', concat(chr(10), 'export class ')), '. ', concat(' };', chr(10), 'export { ')), 'e, ', concat(chr(10), chr(9), 'export async function '))",
    "changed": "replace(replace(replace(replace(text, ', ', concat(chr(10), '  function ')), '. ', concat(chr(10), 'export default class ')), ' a', '(a'), ' s', ' = s => .')",
})
MESSAGES = View("conversations", {"conv_id": "conv_id", "turn": "turn", "role": "role", "content": "text"})
OLD_FILES = View("part", {"path": "p_name || cast(p_partkey AS string)", "key": "p_partkey", "blob_hash": "p_brand"}, where="p_partkey % 10 <> 0")
NEW_FILES = View("part", {"path": "p_name || cast(p_partkey AS string)", "key": "p_partkey", "blob_hash": "CASE WHEN p_partkey % 5 = 0 THEN concat(p_brand, 'x') ELSE p_brand END"}, where="p_partkey % 7 <> 0")

VIEWS = {"v_files": FILES, "v_chunks": CHUNKS, "v_vec": VECTORS, "v_queries": SEARCHES, "v_usage": USAGE, "v_prices": PRICES, "v_reviews": REVIEWS, "v_findings": FINDINGS, "v_messages": MESSAGES, "v_old": OLD_FILES, "v_new": NEW_FILES, "v_code": CODE, "v_changes": CHANGES, "v_drafts": DRAFTS}


def over(names: str, body: str) -> str:
    """SQL of ``body`` with the views ``names`` (blank-separated) and any tables it defines itself: ``WITH`` them all."""
    held = [f"{n} AS ({VIEWS[n].sql()})" for n in names.split()]
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*held, body[15:]])}"
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(held)}, {body[5:]}" if held else body
    return f"WITH {', '.join(held)} {body}" if held else body
