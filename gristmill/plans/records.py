"""Queries of JSON records, cumulative counters, import graphs, remotes and polls.

The texts that they read are made by one expression for Spark and for the oracle, with valid, faulty and missing forms by turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import activity, counters, evidence, imports, records
from gristmill.plans.registry import query
from gristmill.sources.tables import table

FIELD = "concat(',\"{name}\":', CASE WHEN event_id % {m} = {r} THEN {odd} ELSE {good} END)"
PROGRESS = (
    "CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN 'not json' WHEN event_id % 47 = 0 THEN concat('[', cast(event_id AS string), ']') ELSE concat('{\"version\":', "
    "CASE event_id % 17 WHEN 1 THEN '2' WHEN 2 THEN '\"1\"' WHEN 3 THEN '1.0' WHEN 4 THEN 'null' ELSE '1' END, "
    + ", ".join(
        FIELD.format(name=n, m=m, r=r, odd=odd, good=good)
        for n, m, r, odd, good in [
            ("phase", 5, 1, "concat('\"', event_type, '\"')", "'\"verification\"'"), ("completedUnits", 19, 2, "'{}'", "concat('[', cast(user_id AS string), ',\"a\"]')"), ("activeProviderIndex", 23, 3, "'1.5'", "cast(event_id % 4 AS string)"),
            ("retryAttemptsUsed", 29, 4, "'true'", "'2e0'"), ("followupRetryAttemptsUsed", 31, 5, "'null'", "'0'"), ("followupReserve", 37, 6, "'\"0.1\"'", "'0.25'"), ("usedUsd", 7, 3, "'[]'", "concat(cast(user_id AS string), '.5')"), ("reservedUsd", 53, 8, "'1e999'", "'-0'"),
        ]
    )
    + ", CASE WHEN event_id % 11 = 9 THEN '' ELSE ',\"warnings\":[]' END, '}') END"
)
# what JSON holds, as DuckDB tells it
KIND = "CASE json_type(b, '{p}') WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' END"
NUM = "CASE WHEN json_type(b, '{p}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND isfinite(TRY_CAST(json_extract_string(b, '{p}') AS DOUBLE)) THEN TRY_CAST(json_extract_string(b, '{p}') AS DOUBLE) END"


def _num(path: str) -> str:
    return NUM.format(p=path)


def _text(path: str) -> str:
    return f"CASE WHEN json_type(b, '{path}') = 'VARCHAR' THEN json_extract_string(b, '{path}') END"


def _unless(good: str, name: str) -> str:
    return f"WHEN NOT coalesce({good}, false) THEN '{name}'"


FAULT = "CASE WHEN b IS NULL THEN 'json' WHEN json_type(b) <> 'OBJECT' THEN 'payload' " + " ".join(
    [_unless(f"{_num('$.version')} = 1", "version"), _unless(f"{_text('$.phase')} IN ({', '.join(repr(p) for p in records.PHASES)})", "phase"), _unless("json_type(b, '$.completedUnits') = 'ARRAY'", "completedUnits")]
    + [_unless(f"{_num(f'$.{n}')} = floor({_num(f'$.{n}')})", n) for n in records.WHOLE] + [_unless(f"{_num(f'$.{n}')} IS NOT NULL", n) for n in records.FINITE] + [_unless("json_type(b, '$.warnings') = 'ARRAY'", "warnings")]
) + " END"
PARSED = "j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS b FROM v)"


@query("o236_progress_faults", f"WITH v AS (SELECT event_id, {PROGRESS} AS body FROM events), {PARSED} SELECT event_id, {FAULT} AS fault FROM j")
def progress_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{PROGRESS} AS body")
    return rows.select("event_id", records.progress_fault(F.col("body")).alias("fault"))


@query("o005_json_documents", f"WITH v AS (SELECT event_id, {PROGRESS} AS body FROM events), {PARSED} SELECT event_id, {KIND.format(p='$')} AS shape, {_num('$.version')} AS version, {_num('$.usedUsd')} AS \"usedUsd\" FROM j")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{PROGRESS} AS body")
    return records.documents(rows, "body", ["version", "usedUsd"]).drop("body")


PRICE = "CASE (p_partkey + {k}) % 9 WHEN 0 THEN '\"-1\"' WHEN 1 THEN '\" \"' WHEN 2 THEN '\"1e400\"' WHEN 3 THEN concat('0.0000', cast(p_size AS string)) WHEN 4 THEN '\"abc\"' WHEN 5 THEN 'null' ELSE concat('\"0.00000', cast(p_size + {k} AS string), '\"') END"
ENTRY = (
    "concat('{{\"id\":', CASE p_partkey % 8 WHEN {k} THEN '7' ELSE concat('\"m', cast((p_partkey + {k}) % 3 AS string), '\"') END, ',\"pricing\":', CASE WHEN p_partkey % 13 = {k} THEN '\"free\"' ELSE concat('{{\"prompt\":', "
    + PRICE.replace("{k}", "{k}") + ", ',\"completion\":\"2e-6\"', CASE WHEN p_partkey % 2 = 0 THEN concat(',\"input_cache_read\":', " + PRICE.replace("{k}", "{k1}") + ") ELSE '' END, '}}') END, '}}')"
)
LISTS = "CASE WHEN p_partkey % 29 = 0 THEN '{\"data\":' WHEN p_partkey % 31 = 0 THEN '{\"data\":7}' ELSE concat('{\"data\":[', " + ", ',', ".join(ENTRY.format(k=k, k1=k + 2) for k in range(3)) + ", ',5]}') END"


def _sql_price(path: str) -> str:
    told = f"CASE WHEN json_type(e, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(json_extract_string(e, '{path}') AS DOUBLE) WHEN json_type(e, '{path}') = 'VARCHAR' AND trim(json_extract_string(e, '{path}')) <> '' THEN TRY_CAST(json_extract_string(e, '{path}') AS DOUBLE) END"
    return f"(SELECT CASE WHEN x >= 0 AND isfinite(x) THEN x END FROM (SELECT {told} AS x))"


@query("o011_price_documents", f"WITH v AS (SELECT p_partkey AS list_id, {LISTS} AS body FROM part), {PARSED}, e AS (SELECT list_id, unnest(json_extract(b, '$.data[*]')) AS e, generate_subscripts(json_extract(b, '$.data[*]'), 1) AS place FROM j WHERE b IS NOT NULL), t AS (SELECT list_id, place, CASE WHEN json_type(e, '$.id') = 'VARCHAR' THEN json_extract_string(e, '$.id') END AS model_id, {_sql_price('$.pricing.prompt')} AS prompt, {_sql_price('$.pricing.completion')} AS completion, {_sql_price('$.pricing.input_cache_read')} AS r, {_sql_price('$.pricing.input_cache_write')} AS w FROM e) SELECT list_id, model_id, prompt, completion, coalesce(r, prompt) AS cache_read, coalesce(w, prompt) AS cache_write FROM t WHERE model_id IS NOT NULL AND prompt IS NOT NULL AND completion IS NOT NULL QUALIFY row_number() OVER (PARTITION BY list_id, model_id ORDER BY place DESC) = 1")
def price_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.price_lists(table(spark, sf_dir, "part").selectExpr("p_partkey AS list_id", f"{LISTS} AS body"))


MODEL = "concat('\"a{k}\":', CASE WHEN event_id % {n} = {k} THEN 'null' ELSE concat('{{\"inputTokens\":', CASE WHEN event_id % 7 = {k} THEN '\"9\"' ELSE cast(event_id % 100 AS string) END, ',\"outputTokens\":', cast(user_id AS string), CASE WHEN event_id % 4 = {k} THEN ',\"cacheReadInputTokens\":5' ELSE '' END, CASE WHEN event_id % 3 = {k} THEN ',\"canonicalModel\":\"c{k}\"' ELSE '' END, CASE WHEN event_id % 5 = {k} THEN ',\"costUSD\":0.5' ELSE '' END, '}}') END)"
CALLS = (
    "CASE WHEN event_id % 37 = 0 THEN 'x' ELSE concat('{\"total_cost_usd\":', CASE WHEN event_id % 6 = 0 THEN '\"1\"' ELSE '0.25' END, CASE WHEN event_id % 10 = 3 THEN '' ELSE concat(',\"usage\":', CASE WHEN event_id % 10 = 4 THEN 'null' ELSE concat('{\"input_tokens\":', cast(event_id % 50 AS string), CASE WHEN event_id % 10 = 5 THEN '' ELSE ',\"output_tokens\":3' END, ',\"cache_read_input_tokens\":11}') END) END, "
    "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat(',\"modelUsage\":{', " + MODEL.format(k=1, n=8) + ", '}') ELSE concat(',\"modelUsage\":{', " + MODEL.format(k=0, n=4) + ", ',', " + MODEL.format(k=2, n=5) + ", '}') END, '}') END"
)


def _entry(name: str) -> str:
    path = f"concat('$.modelUsage.', k, '.{name}')"
    return f"CASE WHEN json_type(b, {path}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(json_extract_string(b, {path}) AS DOUBLE) END"


USAGE_SQL = (
    f"WITH v AS (SELECT event_id, event_type, {CALLS} AS body FROM events), {PARSED}, k AS (SELECT *, unnest(json_keys(b, '$.modelUsage')) AS k FROM j WHERE b IS NOT NULL), "
    f"m AS (SELECT event_id, b, coalesce(CASE WHEN json_type(b, concat('$.modelUsage.', k, '.canonicalModel')) = 'VARCHAR' THEN json_extract_string(b, concat('$.modelUsage.', k, '.canonicalModel')) END, k) AS model, {_entry('inputTokens')} AS i, {_entry('outputTokens')} AS o, {_entry('cacheReadInputTokens')} AS r, {_entry('cacheCreationInputTokens')} AS w, {_entry('costUSD')} AS c FROM k), "
    "f AS (SELECT *, count(*) OVER (PARTITION BY event_id) = 1 AND r IS NULL AND w IS NULL AND json_type(b, '$.usage') = 'OBJECT' AS bare FROM m WHERE i IS NOT NULL AND o IS NOT NULL) "
    f"SELECT event_id AS call_id, model, i AS input_tokens, coalesce(CASE WHEN bare THEN {_num('$.usage.cache_read_input_tokens')} ELSE r END, 0) AS cached_input_tokens, coalesce(CASE WHEN bare THEN {_num('$.usage.cache_creation_input_tokens')} ELSE w END, 0) AS cache_write_tokens, o AS output_tokens, coalesce(c, CASE WHEN bare THEN {_num('$.total_cost_usd')} END) AS cost_usd FROM f "
    f"UNION ALL SELECT event_id, event_type, {_num('$.usage.input_tokens')}, coalesce({_num('$.usage.cache_read_input_tokens')}, 0), coalesce({_num('$.usage.cache_creation_input_tokens')}, 0), {_num('$.usage.output_tokens')}, {_num('$.total_cost_usd')} FROM j WHERE b IS NOT NULL AND json_type(b, '$.usage') = 'OBJECT' AND {_num('$.usage.input_tokens')} IS NOT NULL AND {_num('$.usage.output_tokens')} IS NOT NULL AND event_id NOT IN (SELECT event_id FROM f)"
)


@query("o194_usage_records", USAGE_SQL)
def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.usage_records(table(spark, sf_dir, "events").selectExpr("event_id AS call_id", "event_type AS model", f"{CALLS} AS body"))


# a counter of calls and one of seconds, for each kind of event; both begin again every 500 ids
SAMPLES = "SELECT event_type AS series, ts, event_id, cast(event_id % 500 AS double) AS calls, cast((event_id % 500) * 3 + event_id % 3 AS double) AS seconds FROM events"
STEP = "CASE WHEN {v} < lag({v}) OVER o THEN {v} ELSE {v} - lag({v}) OVER o END"
STEPS = f"WITH s AS ({SAMPLES}), d AS (SELECT series, ts, {STEP.format(v='calls')} AS calls, {STEP.format(v='seconds')} AS seconds FROM s WINDOW o AS (PARTITION BY series ORDER BY ts, event_id)), w AS (SELECT series AS name, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, coalesce(sum(calls), 0) AS calls, coalesce(sum(seconds), 0) AS seconds, count(*) AS n FROM d GROUP BY 1, 2)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "ts", i, (i % 500).cast("double").alias("calls"), ((i % 500) * 3 + i % 3).cast("double").alias("seconds"))


@query("o256_counter_increases", f"{STEPS} SELECT name, window_start, calls AS increase, n, round(calls / 3600, 9) AS per_second FROM w")
def counter_increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counters.rates(samples(spark, sf_dir), ["name"], "calls", "1 hour", 3600, ["ts", "event_id"])
    return found.select("name", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "increase", "n", F.round("per_second", 9).alias("per_second"))


@query("o257_average_durations", f"{STEPS} SELECT name, window_start, calls AS observations, CASE WHEN calls > 0 THEN round(seconds / calls, 9) END AS mean FROM w")
def average_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counters.means(samples(spark, sf_dir), ["name"], "seconds", "calls", "1 hour", ["ts", "event_id"])
    return found.select("name", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "observations", F.round("mean", 9).alias("mean"))


SOURCES = (
    "SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/lib/' ELSE 'tests/' END, 'm', cast(doc_id AS string), CASE doc_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' WHEN 3 THEN '/index.ts' ELSE '.mjs' END) AS path, "
    "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE concat('import { a, b } from ', chr(39), './m', cast(doc_id + 3 AS string), CASE doc_id % 2 WHEN 0 THEN '.js' ELSE '' END, chr(39), ';', chr(10), 'export * from \"../m', cast(doc_id * 7 % 400 AS string), '\"', chr(10), 'const r = require(', chr(39), 'react', chr(39), ');', chr(10), "
    "CASE doc_id % 4 WHEN 0 THEN concat('import ', chr(39), './x/../m', cast(doc_id - 3 AS string), chr(39)) WHEN 1 THEN concat('await import(\"./lib/m', cast(doc_id + 1 AS string), '.mjs\")') ELSE '// none' END, chr(10)) END AS content FROM documents"
)
EDGES = (
    f"f AS ({SOURCES}), s AS (SELECT path, list_distinct(list_concat(list_concat(regexp_extract_all(content, 'from [''\"]([^''\"]+)', 1), regexp_extract_all(content, 'import [''\"]([^''\"]+)', 1)), regexp_extract_all(content, 'import\\([''\"]([^''\"]+)', 1))) AS specs FROM f WHERE content IS NOT NULL), "
    "e AS (SELECT path, regexp_extract(path, '^(.*/)?', 0) AS folder, unnest(specs) AS spec FROM s), w AS (SELECT *, ltrim(regexp_replace(regexp_replace(regexp_replace(folder || spec, '/\\./', '/', 'g'), '[^/]+/\\.\\./', '', 'g'), '[^/]+/\\.\\./', '', 'g'), './') AS base FROM e WHERE starts_with(spec, '.')), "
    f"b AS (SELECT path, spec, base AS b, 0 AS k FROM w UNION ALL SELECT path, spec, regexp_replace(base, '\\.(js|jsx|mjs|cjs)$', ''), 1 FROM w), x AS (SELECT path, spec, k, unnest([{', '.join(repr(s) for s in imports.SUFFIXES)}]) AS suffix, unnest(range(12)) AS j, b FROM b), "
    "t AS (SELECT DISTINCT x.path AS from_path, x.spec AS specifier, p.path AS to_path, k * 12 + j AS place FROM x JOIN (SELECT DISTINCT path FROM f) p ON p.path = x.b || x.suffix), g AS (SELECT from_path, specifier, to_path FROM t QUALIFY row_number() OVER (PARTITION BY from_path, specifier ORDER BY place) = 1)"
)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, sf_dir, "documents").selectExpr(*_columns(SOURCES.removeprefix("SELECT ").removesuffix(" FROM documents")))
    return files, imports.edges(files)


@query("o070_import_edges", f"WITH {EDGES} SELECT * FROM g")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1]


@query("o070_import_dependants", f"WITH RECURSIVE {EDGES}, c AS (SELECT path FROM f WHERE regexp_matches(path, 'm[0-9]*7[./]')), d AS (SELECT path, 0 AS distance FROM c UNION SELECT g.from_path, d.distance + 1 FROM d JOIN g ON g.to_path = d.path AND g.from_path <> g.to_path WHERE d.distance < 6) SELECT path, min(distance) AS distance FROM d GROUP BY 1 HAVING min(distance) > 0")
def import_dependants(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, edges = graph(spark, sf_dir)
    return imports.dependants(edges, files.where(F.col("path").rlike("m[0-9]*7[./]")), depth=6)


SPELLED = (
    "CASE page_id % 13 WHEN 0 THEN concat('https://github.com/Acme/W', cast(page_id AS string), '.git') WHEN 1 THEN concat('git@github.com:Acme/w', cast(page_id AS string), '.git') WHEN 2 THEN concat(' ssh://git@github.com/a-b/X.y', cast(page_id AS string), '// ') WHEN 3 THEN concat('git://github.com/o/N', cast(page_id AS string)) WHEN 4 THEN concat('Own/Name', cast(page_id AS string)) "
    "WHEN 5 THEN concat('https://gitlab.com/o/', cast(page_id AS string)) WHEN 6 THEN './' WHEN 7 THEN concat('/srv/git/R', cast(page_id AS string), '.git') WHEN 8 THEN concat('./', cast(page_id AS string)) WHEN 9 THEN 'not a remote' WHEN 10 THEN NULL WHEN 11 THEN concat('github.com/', cast(page_id AS string), '/.') ELSE url END"
)
REMOTES = (
    f"WITH v AS (SELECT page_id, regexp_replace(regexp_replace(coalesce({SPELLED}, ''), '^\\s+|\\s+$', '', 'g'), '/+$', '') AS s FROM pages), "
    "p AS (SELECT *, regexp_matches(s, '^(/|[.][.]?/|~/)') AS own, regexp_replace(regexp_replace(s, '^((https?|ssh|git)://)?([^@/ ]+@)?github[.]com[/:]', ''), '[.]git$', '') AS rest, regexp_matches(s, '^((https?|ssh|git)://)?([^@/ ]+@)?github[.]com[/:][A-Za-z0-9._-]+/[A-Za-z0-9._-]+$') OR regexp_matches(s, '^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$') AS known FROM v) "
    "SELECT page_id, CASE WHEN own THEN 'local:' || lower(regexp_replace(string_split(s, '/')[-1], '[.]git$', '')) WHEN known AND split_part(rest, '/', 1) <> '.' AND split_part(rest, '/', 2) <> '.' THEN 'github:' || lower(rest) END AS reference, own OR coalesce(known AND split_part(rest, '/', 1) <> '.' AND split_part(rest, '/', 2) <> '.', false) AS supported FROM p"
)


@query("o204_remotes", REMOTES)
def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "pages").selectExpr("page_id", f"{SPELLED} AS spelled").select("page_id", activity.remote(F.col("spelled")).alias("r"))
    return told.select("page_id", "r.reference", F.col("r.fault").isNull().alias("supported"))


# one repository a supplier: what was polled, and what is known of it
POLLS = "concat('github:o/', cast(s_suppkey AS string)) AS repo_id, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'h0' ELSE 'h1' END AS head, CASE s_suppkey % 7 WHEN 0 THEN '{' WHEN 1 THEN '{\"number\":1}' WHEN 2 THEN NULL ELSE concat('[{\"number\":', cast(s_nationkey AS string), ',\"head_sha\":\"p', cast(s_nationkey % 3 AS string), '\",\"draft\":', CASE WHEN s_suppkey % 4 = 0 THEN 'true' ELSE 'false' END, '},{\"number\":99,\"head_sha\":null},{\"number\":100,\"head_sha\":\"q\"}]') END AS pulls, CASE WHEN s_suppkey % 11 = 0 THEN 'timeout' END AS fault"
KNOWN = "concat('github:o/', cast(s_suppkey AS string)) AS repo_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'h0' END AS last_commit, CASE WHEN s_suppkey % 6 = 0 THEN 'indexing' ELSE 'ready' END AS status"
POSTED = "concat('github:o/', cast(s_suppkey AS string)) AS repo_id, cast(s_nationkey AS bigint) AS pr_number, 'p1' AS head_sha"


@query("o255_change_poll", f"WITH o AS (SELECT {POLLS} FROM supplier), k AS (SELECT {KNOWN} FROM supplier), r AS (SELECT {POSTED} FROM supplier), w AS (SELECT o.*, k.last_commit, k.status, coalesce(fault, CASE WHEN pulls IS NOT NULL AND (NOT json_valid(pulls) OR json_type(CASE WHEN json_valid(pulls) THEN pulls END) <> 'ARRAY') THEN 'pulls can''t be read' END) AS wrong FROM o JOIN k ON k.repo_id = o.repo_id), "
    "p AS (SELECT repo_id, unnest(json_extract(pulls, '$[*]')) AS p FROM w WHERE wrong IS NULL) SELECT repo_id, 'fault' AS outcome, NULL::bigint AS pr_number, wrong AS detail FROM w WHERE wrong IS NOT NULL UNION ALL SELECT repo_id, 'index', NULL, head FROM w WHERE wrong IS NULL AND head IS NOT NULL AND head IS DISTINCT FROM last_commit AND status <> 'indexing' "
    "UNION ALL SELECT repo_id, 'review', cast(json_extract_string(p, '$.number') AS bigint), json_extract_string(p, '$.head_sha') FROM p WHERE coalesce(json_extract_string(p, '$.draft'), 'false') = 'false' AND json_extract_string(p, '$.head_sha') IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.repo_id = p.repo_id AND r.pr_number = cast(json_extract_string(p.p, '$.number') AS bigint) AND r.head_sha = json_extract_string(p.p, '$.head_sha'))")  # fmt: skip
def change_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    polls, known, posted = (rows.selectExpr(*_columns(e)) for e in (POLLS, KNOWN, POSTED))
    return activity.polled(polls, known, posted)


def _columns(expressions: str) -> list[str]:
    """The select list ``expressions``, cut at its commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in expressions:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [o.strip() for o in out]


@query("o252_remembered_deliveries")
def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros("ts") / 1_000_000)
    return activity.remembered_deliveries(table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("key"), at.alias("at")), 86_400, 50)


FILES = "CASE o_orderkey % 4 WHEN 0 THEN concat('src/r', cast(o_orderkey AS string), '.ts') WHEN 1 THEN concat('lib/', cast(o_orderkey AS string), '/Dockerfile') WHEN 2 THEN concat('lib/', cast(o_orderkey AS string), '.py') ELSE concat('x/', cast(o_orderkey AS string), '/.nvmrc') END"
CONTENT = "CASE o_orderkey % 4 WHEN 0 THEN concat('s = s.replace(/[', chr(39), '/]/g, x)', chr(10), 'f(body[', chr(34), 'name', chr(34), '], [1, [2, [3, [4, ', cast(o_orderkey AS string), ']]]])', chr(10), 'const f = (a) => a') WHEN 1 THEN concat('# base', chr(10), 'from node:', cast(o_orderkey AS string)) WHEN 2 THEN concat('function g(a, b)', chr(10), repeat(chr(34), 3), ' g(1) ', repeat(chr(34), 3), chr(10), 'g(', cast(o_orderkey AS string), ')') ELSE concat('v', cast(o_orderkey AS string), chr(10), 'x') END"
FACTS = {
    0: [("2", "response-property", "concat('body[', chr(34), '    ', chr(34), ']')"), ("2", "unawaited-call", "concat('f(body[', chr(34), '    ', chr(34), '], [1, [2, [3, [4, ', k, ']]]])')"), ("3", "declared-parameters", "'f declares 1 parameters'"), ("2", "local-api-arity", "'f expects 1 arguments but receives 2'")],
    1: [("2", "runtime-version", "concat('node ', k)")],
    2: [("1", "declared-parameters", "'g declares 2 parameters'"), ("3", "local-api-arity", "'g expects 2 arguments but receives 1'")],
    3: [("1", "runtime-version", "concat('node v', k)")],
}
#: Sources that a task scans, about.
TASK_SOURCES = 20_000


@query("o225_masked_facts", f"WITH o AS (SELECT {FILES} AS path, cast(o_orderkey AS string) AS k, o_orderkey % 4 AS r FROM orders) " + " UNION ALL ".join(f"SELECT path, cast({p} AS bigint) AS place, cast({line} AS bigint) AS line, '{kind}' AS kind, {detail} AS detail FROM o WHERE r = {r}" for r, facts in FACTS.items() for p, (line, kind, detail) in enumerate(facts, 1)))
def masked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    # sources are made of keys, so a block of a file holds many: they are dealt out by number, so that scanning them is shared by all tasks
    dealt = orders.repartition(max(1, -(-orders.count() // TASK_SOURCES)), "o_orderkey")
    return evidence.static_evidence(dealt.selectExpr(f"{FILES} AS path", f"{CONTENT} AS content"))
