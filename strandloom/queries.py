"""Queries of the core, with the SQL that states each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.functions import text, vec
from strandloom.operators import changes, graph, ledger, order, retrieval, rows, signals, threads
from strandloom.operators.changes import ChangeLog, capture_changes, changed_files
from strandloom.operators.products import products
from strandloom.plans import recall
from strandloom.session import fresh_dir, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


P7_SQL = """
WITH good AS (SELECT run_id, started_at FROM ingest_runs WHERE status = 'ok' AND finished_at IS NOT NULL),
stamp AS (
  SELECT source, source_id, source_config_id, mtime_micros, size_bytes, cfg_overlay_hash,
         row_number() OVER (PARTITION BY source, source_id, source_config_id ORDER BY started_at DESC, mtime_micros DESC, size_bytes DESC) AS rn
  FROM ingest_sources JOIN good ON last_run_id = run_id),
look AS (
  SELECT *, row_number() OVER (PARTITION BY source, source_id, source_config_id ORDER BY observed_at DESC, mtime_micros DESC, size_bytes DESC) AS rn
  FROM source_listing)
SELECT l.source, l.source_id, l.source_config_id
FROM look l LEFT JOIN stamp s ON s.rn = 1 AND l.source IS NOT DISTINCT FROM s.source
  AND l.source_id IS NOT DISTINCT FROM s.source_id AND l.source_config_id IS NOT DISTINCT FROM s.source_config_id
WHERE l.rn = 1 AND l.present AND (s.rn IS NULL OR l.mtime_micros IS DISTINCT FROM s.mtime_micros
  OR l.size_bytes IS DISTINCT FROM s.size_bytes OR l.cfg_overlay_hash IS DISTINCT FROM s.cfg_overlay_hash)
"""


@query(P7_SQL)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are new or changed since they were last processed with success."""
    log = ChangeLog(spark, fresh_dir(spark, "changes"))
    listing = table(spark, sf_dir, "source_listing")
    capture_changes(log, listing, table(spark, sf_dir, "ingest_sources"), table(spark, sf_dir, "ingest_runs"), segment=0)
    return changed_files(log)


@query("""
WITH good AS (SELECT run_id, started_at FROM ingest_runs WHERE status = 'ok' AND finished_at IS NOT NULL),
stamp AS (
  SELECT source, source_id, source_config_id, mtime_micros, size_bytes, cfg_overlay_hash,
         row_number() OVER (PARTITION BY source, source_id, source_config_id ORDER BY started_at DESC, mtime_micros DESC, size_bytes DESC) AS rn
  FROM ingest_sources JOIN good ON last_run_id = run_id),
look AS (
  SELECT *, row_number() OVER (PARTITION BY source, source_id, source_config_id ORDER BY observed_at DESC, mtime_micros DESC, size_bytes DESC) AS rn
  FROM source_listing),
cut AS (SELECT (min(epoch_us(observed_at)) + max(epoch_us(observed_at))) // 2 AS middle FROM source_listing)
SELECT l.source, l.source_id, l.source_config_id, (epoch_us(l.observed_at) >= middle)::INT AS listing,
  l.present AND (s.rn IS NULL OR l.mtime_micros IS DISTINCT FROM s.mtime_micros OR l.size_bytes IS DISTINCT FROM s.size_bytes OR l.cfg_overlay_hash IS DISTINCT FROM s.cfg_overlay_hash) AS changed
FROM cut, look l LEFT JOIN stamp s ON s.rn = 1 AND l.source IS NOT DISTINCT FROM s.source
  AND l.source_id IS NOT DISTINCT FROM s.source_id AND l.source_config_id IS NOT DISTINCT FROM s.source_config_id
WHERE l.rn = 1
""")
def p7_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's judgement after two listings and a run that failed between them."""
    log = ChangeLog(spark, fresh_dir(spark, "changes"))
    looks, stamps, runs = (table(spark, sf_dir, n) for n in ("source_listing", "ingest_sources", "ingest_runs"))
    middle = looks.agg(F.expr("(min(unix_micros(observed_at)) + max(unix_micros(observed_at))) div 2")).first()[0] or 0
    second = F.unix_micros("observed_at") >= middle

    def dies(batch: DataFrame) -> DataFrame:
        raise ConnectionError("lost between plan and commit")

    log.append(changes.looks_of(looks.filter(~second)), 0)
    try:
        log.run(dies)
    except ConnectionError:
        changes.judge_next(log, stamps, runs)  # replays the plan
    capture_changes(log, looks.filter(second), stamps, runs, 1)
    return log.state().select(*changes.KEY, second.cast("int").alias("listing"), "changed")


# ================================================================ text and ids ==


@query("""SELECT chunk_id, chunk_index, sha256(encode(source || ':' || source_id || ':') || unhex(
  right(lpad(hex(chunk_index), 8, '0'), 2) || substr(lpad(hex(chunk_index), 8, '0'), 5, 2) || substr(lpad(hex(chunk_index), 8, '0'), 3, 2) || left(lpad(hex(chunk_index), 8, '0'), 2))
  || encode(coalesce(source_config_id, ''))) AS address FROM ingest_chunks""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content addresses of manifest pieces."""
    rows = table(spark, sf_dir, "ingest_chunks")
    return rows.select("chunk_id", "chunk_index", text.chunk_id(F.col("source"), F.col("source_id"), F.col("chunk_index"), F.col("source_config_id")).alias("address"))


@query("""SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored more than once, by content hash."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("""WITH s AS (SELECT vec_id, snippet, regexp_replace(regexp_replace(lower(snippet), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g') AS g FROM candidate_vectors)
SELECT vec_id, CASE WHEN length(g) BETWEEN 3 AND 40 AND NOT regexp_matches(g, '^[0-9]+$') THEN g END AS slug,
  trim(regexp_replace(lower(snippet), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm, substr(snippet, 1, 12) AS head,
  CASE WHEN length(trim(regexp_replace(snippet, '\\s+', ' ', 'g'))) > 20 THEN substr(trim(regexp_replace(snippet, '\\s+', ' ', 'g')), 1, 20) || '…' ELSE trim(regexp_replace(snippet, '\\s+', ' ', 'g')) END AS short FROM s""".replace("\\\\", "\\"))
def slugify_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug, normal form, head and short form of each snippet."""
    rows, c = table(spark, sf_dir, "candidate_vectors"), F.col("snippet")
    return rows.select("vec_id", text.slugify(c).alias("slug"), text.normalize(c).alias("norm"), text.snippet(c, 12).alias("head"), text.collapsed(c, 20).alias("short"))


@query("""SELECT emit_id, regexp_replace(regexp_extract(source_id, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem, array_length(string_split(body, chr(10))) AS lines,
  CASE WHEN length(body) > 200 THEN substr(body, 1, 200) || '…[truncated ' || (length(body) - 200)::VARCHAR || ' chars]' ELSE body END AS cut,
  regexp_matches(replace(symbol_name, '_', '-'), '^[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?$') AND length(symbol_name) - length(replace(symbol_name, '_', '')) <= 4 AS valid FROM emits""".replace("\\\\", "\\"))
def symbol_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stems, line counts, truncated bodies and valid handles of symbols."""
    rows = table(spark, sf_dir, "emits")
    return rows.select("emit_id", text.path_stem(F.col("source_id")).alias("stem"), F.size(F.split("body", "\n")).cast("long").alias("lines"), text.truncated(F.col("body")).alias("cut"), text.valid_handle(F.regexp_replace("symbol_name", "_", "-")).alias("valid"))


@query("""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) > 8 THEN array_to_string(w[1:8], ' ') || '…' ELSE array_to_string(w, ' ') END AS excerpt FROM w""".replace("\\\\", "\\"))
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and excerpts of documents."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return rows.select("doc_id", F.size(words).cast("long").alias("n_words"), text.excerpt(F.col("text"), 8).alias("excerpt"))


# ================================================== rules, facets, filters, joins ==


@query("""WITH b AS (SELECT row_id, coalesce(message.role, '') AS role, ltrim(coalesce(array_to_string(list_transform(list_filter(message.content, lambda x: x.type = 'text' AND x.text IS NOT NULL), lambda x: x.text), chr(10)), ''), ' ') AS t FROM session_messages)
SELECT row_id, CASE WHEN t LIKE '<system-reminder>%' OR t LIKE '<command-name>%' OR contains(t, '<local-command-') OR (t LIKE '%expected,%' AND role = 'user') THEN 'drop'
  WHEN regexp_matches(t, '^Run [0-9]+') THEN 'run_report' WHEN contains(t, '```') THEN 'with_code' ELSE 'keep' END AS decision FROM b""")
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered drop and tag rules on session lines."""
    blocks = F.filter("message.content", lambda b: (b["type"] == "text") & b["text"].isNotNull())
    body = F.coalesce(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), F.lit(""))
    mine = (rows.Rule(prefix="<system-reminder>"), rows.Rule(prefix="<command-name>"), rows.Rule(contains="<local-command-"), rows.Rule(contains="expected,", roles=("user",)), rows.Rule(tag="run_report", regex="^Run [0-9]+"), rows.Rule(tag="with_code", contains="```"))
    out = table(spark, sf_dir, "session_messages").select("row_id", F.coalesce("message.role", F.lit("")).alias("role"), body.alias("t"))
    return out.select("row_id", rows.decide(mine, F.col("t"), F.lit("session"), F.col("role")).alias("decision"))


@query("""WITH f AS (SELECT doc_id, list_filter(['lang:' || lang, 'project:' || project, 'kind:' || doc_kind, 'status:draft', ':bad', 'project:' || lower(trim(source))], lambda x: x IS NOT NULL) AS f FROM documents),
o AS (SELECT doc_id, f, ['lang:xx', 'status:done', 'kind:'] AS v FROM f)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(f, lambda x: split_part(x, ':', 1) IN ('project', 'lang', 'agent', 'status', 'record_kind')))), '|') AS header,
  array_to_string(list_sort(list_distinct(list_concat(list_concat(list_filter(f, lambda x: split_part(x, ':', 1) IN ('project', 'tags', 'status') OR split_part(x, ':', 1) NOT IN ('lang', 'kind', 'status')), ['status:done']), ['lang:xx']))), '|') AS merged FROM o""")
def facet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header line and overlaid facets of documents."""
    c = F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("project:"), "project"), F.concat(F.lit("kind:"), "doc_kind"), F.lit("status:draft"), F.lit(":bad"), F.concat(F.lit("project:"), F.lower(F.trim("source")))))
    over = F.array(F.lit("lang:xx"), F.lit("status:done"), F.lit("kind:"))
    docs = table(spark, sf_dir, "documents").withColumn("f", c)
    return docs.select("doc_id", rows.facet_header(F.col("f")).alias("header"), F.array_join(rows.overlay_facets(F.col("f"), over), "|").alias("merged"))


@query("""SELECT vec_id, chunk_id FROM candidate_vectors WHERE project = 'orrery' AND source = 'code' AND ts >= TIMESTAMPTZ '2025-03-01 00:00:00+00' AND ts < TIMESTAMPTZ '2025-12-01 00:00:00+00'""")
def recall_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter pushed into the scan: project, source and a half-open time range."""
    when = lambda s: F.lit(s).cast("timestamp")
    cond = rows.recall_filter("orrery", "code", when("2025-03-01 00:00:00+00:00"), when("2025-12-01 00:00:00+00:00"))
    return table(spark, sf_dir, "candidate_vectors").filter(cond).select("vec_id", "chunk_id")


@query("""SELECT project, stale, count(*) AS n FROM candidate_vectors WHERE NOT stale OR source = 'code' GROUP BY 1, 2""")
def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows, and stale ones of one source."""
    return table(spark, sf_dir, "candidate_vectors").filter("not stale or source = 'code'").groupBy("project", "stale").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT row_id, session_id, row_number() OVER w - 1 AS block, lag(row_id) OVER w AS parent_id,
  epoch_us(coalesce(ts, first_value(ts IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) AS micros
FROM session_messages WHERE line_type IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY line_no, row_id)""")
def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk order and parent of each session line; a missing time takes the session's first."""
    w = Window.partitionBy("session_id").orderBy("line_no", "row_id")
    whole = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = table(spark, sf_dir, "session_messages").filter("line_type in ('user', 'assistant')")
    ts = F.coalesce("ts", F.first("ts", ignorenulls=True).over(whole))
    return lines.select("row_id", "session_id", (F.row_number().over(w).cast("long") - 1).alias("block"), F.lag("row_id").over(w).alias("parent_id"), F.unix_micros(ts).alias("micros"))


@query("""SELECT m.row_id, m.session_id, p.row_id AS linked FROM session_messages m JOIN (SELECT session_id, line_no + 1 AS line_no, row_id FROM session_messages WHERE line_type = 'user') p USING (session_id, line_no) WHERE m.line_type = 'assistant'""")
def recall_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that each assistant line answers."""
    lines = table(spark, sf_dir, "session_messages")
    asked = lines.filter("line_type = 'user'").select("session_id", (F.col("line_no") + 1).alias("line_no"), F.col("row_id").alias("linked"))
    return lines.filter("line_type = 'assistant'").join(asked, ["session_id", "line_no"]).select("row_id", "session_id", "linked")


@query("""SELECT source, count(*) AS chunks, count(DISTINCT source_id) AS files, epoch_us(max(upserted_at)) AS last_micros FROM ingest_chunks GROUP BY 1""")
def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the latest upsert of each source."""
    grouped = table(spark, sf_dir, "ingest_chunks").groupBy("source")
    return grouped.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_id").alias("files"), F.unix_micros(F.max("upserted_at")).alias("last_micros"))


@query("""SELECT project, epoch_us(max(ts)) AS newest_micros, count(*) AS n FROM session_messages WHERE project IS NOT NULL GROUP BY 1""")
def newest_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest line of each project."""
    return table(spark, sf_dir, "session_messages").filter("project is not null").groupBy("project").agg(F.unix_micros(F.max("ts")).alias("newest_micros"), F.count(F.lit(1)).alias("n"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", "event_type <> 'error' AS success")


@query("""SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 2""")
def audit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gated statement over the audit rows."""
    return rows.audit_sql(_audit(spark, sf_dir), "SELECT user_id, count(*) AS failures FROM audit_events WHERE success = FALSE GROUP BY 1 HAVING count(*) > 2")


@query("""SELECT event_type, user_id % 10 AS bucket, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type, user_id % 10), (event_type), ())""")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets and distinct aggregates over the audit rows."""
    sql = "SELECT event_type, bucket, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM (SELECT *, user_id % 10 AS bucket FROM audit_events) GROUP BY GROUPING SETS ((event_type, bucket), (event_type), ())"
    return rows.audit_sql(_audit(spark, sf_dir), sql)


@query("""SELECT event_id, user_id, row_number() OVER w AS nth, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window frames over the audit rows."""
    sql = "SELECT event_id, user_id, CAST(row_number() OVER w AS BIGINT) AS nth, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three, lag(event_type) OVER w AS before FROM audit_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
    return rows.audit_sql(_audit(spark, sf_dir), sql)


@query("""SELECT n_name, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2""")
def relational_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi joins and an aggregate over the relational tables; small sides go by AQE's measured size."""
    line = table(spark, sf_dir, "lineitem").filter("l_shipdate < timestamp_ntz '1998-01-01'")
    out = line.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name", "l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


@query("""SELECT c_mktsegment, count(*) AS idle FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') GROUP BY 1""")
def relational_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a finished order."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("idle"))


# ============================================================ ingest idempotency ==


@query("""SELECT count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (a > 1) AS doubled_corpus, count(*) FILTER (b > 1) AS doubled_manifest
FROM (SELECT chunk_id, count(*) AS a FROM candidate_vectors WHERE chunk_id IS NOT NULL GROUP BY 1) FULL JOIN (SELECT chunk_id, count(*) AS b FROM ingest_chunks WHERE chunk_id IS NOT NULL GROUP BY 1) USING (chunk_id)""")
def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus ids against manifest ids."""
    return rows.drift(table(spark, sf_dir, "candidate_vectors"), table(spark, sf_dir, "ingest_chunks"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC, content_sha256) AS n FROM ingest_chunks)
SELECT chunk_id, content_sha256, chunk_index FROM l WHERE n = 1""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows after upserting by chunk id: the latest of each."""
    manifest = table(spark, sf_dir, "ingest_chunks")
    first = Window.partitionBy("chunk_id").orderBy(F.desc("upserted_at"), "content_sha256")
    new = manifest.withColumn("n", F.row_number().over(first)).filter("n = 1").select("chunk_id", "content_sha256", "chunk_index")
    return rows.upsert(manifest.select("chunk_id", "content_sha256", "chunk_index"), new, "chunk_id")


@query("""WITH k AS (SELECT DISTINCT chunk_id, embedding_input_sha256 FROM ingest_chunks WHERE embedding_input_sha256 <> '' AND last_run_id IN (SELECT run_id FROM ingest_runs WHERE status = 'ok' AND finished_at IS NOT NULL))
SELECT c.chunk_id, c.chunk_index, c.content_sha256 FROM ingest_chunks c ANTI JOIN k ON c.chunk_id = k.chunk_id AND c.embedding_input_sha256 = k.embedding_input_sha256""")
def tier2_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that must be embedded again."""
    chunks = table(spark, sf_dir, "ingest_chunks")
    good = changes.successful_runs(table(spark, sf_dir, "ingest_runs")).select("last_run_id")
    return rows.tier_two(chunks, chunks.join(good, "last_run_id", "left_semi")).select("chunk_id", "chunk_index", "content_sha256")


@query("""WITH r AS (SELECT run_id FROM ingest_runs WHERE status = 'ok' AND finished_at IS NOT NULL ORDER BY started_at DESC LIMIT 1)
SELECT source, source_id, source_config_id, count(*) AS pieces, bool_or(source = 'code') AS deletes FROM ingest_chunks, r WHERE last_run_id IS NULL OR last_run_id <> run_id GROUP BY 1, 2, 3""")
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of coordinates that the latest successful run has not stamped."""
    latest = changes.successful_runs(table(spark, sf_dir, "ingest_runs")).agg(F.max_by("last_run_id", "started_at").alias("run_id"))
    old = rows.orphans(table(spark, sf_dir, "ingest_chunks").crossJoin(latest), F.col("run_id"))  # one row
    return old.groupBy("source", "source_id", "source_config_id").agg(F.count(F.lit(1)).alias("pieces"), F.bool_or(F.col("source") == "code").alias("deletes"))


@query("""SELECT source, source_id, chunk_index, row_number() OVER (PARTITION BY source ORDER BY chunk_id, source_id, chunk_index) // 64 AS batch FROM (SELECT DISTINCT source, source_id, chunk_index, chunk_id FROM ingest_chunks)""")
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ids per source."""
    ids = table(spark, sf_dir, "ingest_chunks").select("source", "source_id", "chunk_index", "chunk_id").distinct()
    ids = order.numbered(ids, ["source"], ["chunk_id", "source_id", "chunk_index"])
    return ids.select("source", "source_id", "chunk_index", F.floor(F.col("nth") / 64).cast("long").alias("batch"))


@query("""WITH i AS (SELECT DISTINCT source, source_id, source_config_id, chunk_index FROM ingest_chunks),
s AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY source, source_id, source_config_id ORDER BY chunk_index) AS island FROM i)
SELECT source, source_id, source_config_id, min(chunk_index) AS first_index, max(chunk_index) AS last_index, count(*) AS pieces FROM s GROUP BY source, source_id, source_config_id, island""")
def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive pieces; a second run of a file means a gap."""
    key = ["source", "source_id", "source_config_id"]
    at = table(spark, sf_dir, "ingest_chunks").select(*key, "chunk_index").distinct()
    at = at.withColumn("island", F.col("chunk_index") - F.row_number().over(Window.partitionBy(*key).orderBy("chunk_index")))
    return at.groupBy(*key, "island").agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.count(F.lit(1)).alias("pieces")).drop("island")


# ============================================================ retrieval and ranking ==

BM25_CTE = """
WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE text IS NOT NULL),
p AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT id, count(*) AS dl FROM t GROUP BY 1),
a AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM l), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS term FROM eval_items),
s AS (SELECT query_id, p.id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN d USING (term) JOIN p USING (term) JOIN l ON l.id = p.id, a GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS lane_rank FROM s) WHERE lane_rank < 60),
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
w AS (SELECT x.vec_id AS query_id, y.vec_id AS id, round(list_sum(list_transform(list_zip(x.e, y.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS score FROM v x JOIN eval_items ON x.vec_id = item_id, v y),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) - 1 AS lane_rank FROM w) WHERE lane_rank < 60),
u AS (SELECT query_id, id, 'bm25' AS lane, score, lane_rank FROM b UNION ALL SELECT query_id, id, 'dense', score, lane_rank FROM n),
f AS (SELECT query_id, id, round(sum(1 / (60.0 + lane_rank)), 9) AS rrf, max(score) FILTER (lane = 'bm25') AS bm25, max(score) FILTER (lane = 'dense') AS dense FROM u GROUP BY 1, 2),
g AS (SELECT *, round(least(1, rrf / (2.0 / 60)), 9) AS f_rrf, round(coalesce(bm25 / (bm25 + 10), 0), 9) AS f_bm25 FROM f),
r AS (SELECT g.*, round(f_rrf + 0.5 * f_bm25, 6) AS score, lower(trim(source)) AS source, coalesce(source_id, 'doc ' || doc_id) AS source_id FROM g JOIN documents ON doc_id = id),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, id) AS k FROM r) WHERE k <= 3),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM c) WHERE place <= 10)
"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return retrieval.bm25_lane(index, table(spark, sf_dir, "eval_items"), "item_id", "passage", 60)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings")
    asked = stored.join(table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return retrieval.dense_lane(stored, "vec_id", "embedding", asked, "vec_id", "embedding", 60)


def _recall(spark: SparkSession, sf_dir: str, limit: int = S.LIMIT) -> DataFrame:
    """Hits of hybrid recall, at most three of a file."""
    items, stored = table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    file = F.coalesce("source_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", file.alias("source_id"), F.lower(F.trim("source")).alias("source"))
    asked = stored.withColumnRenamed("id", "query_id").join(items.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    return recall.hybrid_recall(chunks, items.select(F.col("item_id").alias("query_id"), F.col("passage").alias("text")), stored, asked, {"rrf": 1.0, "bm25": 0.5}, limit)


@query(BM25_CTE + "SELECT query_id, id, score, lane_rank FROM b")
def bm25_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword lane of all evaluation passages over all documents."""
    return _bm25(spark, sf_dir)


@query(BM25_CTE + "SELECT query_id, id, score, lane_rank FROM n")
def dense_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhaustive dense lane of the passages' vectors over all vectors."""
    return _dense(spark, sf_dir)


@query(BM25_CTE + "SELECT query_id, id, rrf, bm25, dense FROM f")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane union with reciprocal rank fusion."""
    return retrieval.fuse({"bm25": _bm25(spark, sf_dir), "dense": _dense(spark, sf_dir)})


@query(BM25_CTE + "SELECT query_id, place, id, score, f_rrf, f_bm25 * 0.5 AS c_bm25 FROM h")
def recall_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes, fused, ranked with attribution, capped per source, best ten."""
    hits = _recall(spark, sf_dir)
    return hits.select("query_id", "place", "id", "score", "f_rrf", F.col("match_features")["bm25"].alias("c_bm25"))


@query(BM25_CTE + """, dw AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM documents WHERE text IS NOT NULL), iw AS (SELECT item_id AS query_id, regexp_extract_all(lower(passage), '[a-z0-9]+') AS x FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT DISTINCT id, array_to_string(x[i : i + 12], ' ') AS gram FROM (SELECT *, unnest(range(1, len(x) - 11)) AS i FROM dw)), ig AS (SELECT DISTINCT query_id, array_to_string(x[i : i + 12], ' ') AS gram FROM (SELECT *, unnest(range(1, len(x) - 11)) AS i FROM iw)),
o AS (SELECT DISTINCT query_id, id FROM ig JOIN dg USING (gram)),
m AS (SELECT o.query_id, min(place) AS first, count(place) AS found FROM o LEFT JOIN h USING (query_id, id) GROUP BY 1)
SELECT query_id, round(coalesce(1.0 / first, 0), 6) AS rr, (first IS NOT NULL)::INT AS success, found FROM m""")
def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank, success and hits of each passage of which documents quote thirteen words or more."""
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("passage").alias("t"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return retrieval.reciprocal_ranks(_recall(spark, sf_dir), retrieval.quoted(docs, items))


@query("""WITH c AS (SELECT v.vec_id, v.source, v.snippet, 'orrery' AS q, epoch_us(v.ts) AS m FROM candidate_vectors v), n AS (SELECT max(m) AS now FROM c)
SELECT vec_id, round(0.5::DOUBLE + CASE WHEN source = 'code' AND contains(lower(snippet), 'scope') THEN 3.0 ELSE 0.0 END, 6) AS boosted,
  round(0.5 - CASE WHEN source = 'thread' AND m IS NOT NULL THEN 2.0 * least(1, greatest(0, 1 - (now - m) / 3.6e9 / 24)) ELSE 0 END, 6) AS damped FROM c, n""")
def boost_and_damp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier boost on code and the penalty on the engine's own recent chunks."""
    base = table(spark, sf_dir, "candidate_vectors").withColumn("m", F.unix_micros("ts"))
    now = base.agg(F.max("m").alias("now"))
    c = base.crossJoin(now)  # one row
    boosted = retrieval.identifier_boost(F.lit(0.5), F.col("source"), F.col("snippet"), F.lit("scope"))
    damped = retrieval.self_reference(F.lit(0.5), F.col("source") == "thread", vec.age_hours(F.col("now"), F.col("m"), -1e12))
    return c.select("vec_id", F.round(boosted, 6).alias("boosted"), F.round(damped, 6).alias("damped"))


# ================================================================= signals ==

SIGNAL_CTE = """
WITH r AS (SELECT v.vec_id, v.chunk_id, coalesce(v.project, '') AS project, v.stale, epoch_us(v.ts) AS m, list_transform(v.dense_embedding, lambda x: x::DOUBLE) AS e FROM candidate_vectors v
  WHERE dense_embedding IS NOT NULL AND len(dense_embedding) = 64 AND len(list_filter(dense_embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dense_embedding, lambda x: x <> 0)) > 0),
n AS (SELECT max(m) AS now FROM r)
"""


def _signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "candidate_vectors").filter(vec.usable("dense_embedding", 64))
    return found.select("vec_id", "chunk_id", F.coalesce("project", F.lit("")).alias("project"), "stale", F.unix_micros("ts").alias("micros"), F.col("dense_embedding").alias("v"))


@query(SIGNAL_CTE + "SELECT project, count(*) AS members, min(m) AS first_micros, max(m) AS last_micros, round(count(*) * exp(-((any_value(now) - max(m)) / 3.6e9) / 24), 6) AS score FROM r, n WHERE NOT stale AND m >= now - 2592000000000 GROUP BY project")
def activity_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last 30 days per project, decayed by the age of the newest."""
    base = _signal_rows(spark, sf_dir)
    now = base.agg(F.max("micros").alias("now"))
    return signals.activity_bursts(base.crossJoin(now), F.col("now"), ["project", "now"], 720, 24).drop("now")  # one row of now


@query(SIGNAL_CTE + ", x AS (SELECT project, unnest(range(1, 65)) AS i, e FROM r WHERE NOT stale), k AS (SELECT project, i, avg(e[i]) AS a, count(*) AS rows FROM x GROUP BY 1, 2 HAVING count(*) >= 10) SELECT project, max(rows) AS rows, round(sqrt(sum(a * a)), 6) AS length, round(max(a), 6) AS highest, round(sum(i * a), 5) AS weighed FROM k GROUP BY 1")
def baseline_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's mean vector, where it has ten rows: its length and sums over its elements."""
    means = signals.baselines(_signal_rows(spark, sf_dir).filter("not stale"), "project", 64)
    weighed = F.aggregate(F.transform("mean", lambda a, i: a * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return means.select("project", "rows", F.round(vec.norm(F.col("mean")), 6).alias("length"), F.round(F.array_max("mean"), 6).alias("highest"), F.round(weighed, 5).alias("weighed"))


@query(SIGNAL_CTE + """, x AS (SELECT project, unnest(range(1, 65)) AS i, e FROM r WHERE NOT stale), k AS (SELECT project, i, avg(e[i]) AS a FROM x GROUP BY 1, 2 HAVING count(*) >= 10),
b AS (SELECT project, list(a ORDER BY i) AS mean FROM k GROUP BY 1), g AS (SELECT list(a ORDER BY i) AS mean FROM (SELECT i, avg(e[i]) AS a FROM x GROUP BY 1))
SELECT vec_id, round(greatest(0, 1 - list_cosine_similarity(e, coalesce(b.mean, g.mean))), 6) AS novelty FROM r LEFT JOIN b USING (project), g WHERE NOT stale""")
def novelty_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each live row to its project's baseline, else to the overall one."""
    live = _signal_rows(spark, sf_dir).filter("not stale")
    found = signals.novelty(live, signals.baselines(live, "project", 64), signals.baselines(live, None, 64), "project")
    return found.select("vec_id", "novelty")


@query(SIGNAL_CTE + ", c AS (SELECT project, chunk_id, count(*) AS k FROM r GROUP BY 1, 2), d AS (SELECT source, project, count(*) AS n FROM candidate_vectors WHERE project IS NOT NULL GROUP BY 1, 2) SELECT source, project, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, project) AS k FROM d) WHERE k = 1")
def dominant_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent project of each source, the smaller name on a tie."""
    return signals.dominant(table(spark, sf_dir, "candidate_vectors").filter("project is not null"), "source", "project")


@query("""WITH c AS (SELECT source, source_id, count(*) AS w FROM ingest_chunks GROUP BY 1, 2), p AS (SELECT *, w / sum(w) OVER (PARTITION BY source) AS p FROM c)
SELECT source, round(sum(-p * ln(p)), 6) AS entropy, count(*) AS bins, CASE WHEN count(*) > 1 THEN round(sum(-p * ln(p)) / ln(count(*)), 6) ELSE 0.0 END AS normalised FROM p GROUP BY 1""")
def evidence_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly each source's pieces are spread over its files."""
    bins = table(spark, sf_dir, "ingest_chunks").groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("w"))
    return signals.entropy(bins, ["source"], "w")


@query("""WITH h AS (SELECT DISTINCT lower(split_part(handle, '-', 1)) AS w, project FROM emergent_reports WHERE project IS NOT NULL), t AS (SELECT DISTINCT project AS p FROM h)
SELECT p AS project, count(*) AS lines, count(DISTINCT session_id) AS sessions FROM t JOIN session_messages m ON contains(lower(coalesce(array_to_string(list_transform(list_filter(message.content, lambda b: b.type = 'text' AND b.text IS NOT NULL), lambda b: b.text), ' '), '')), replace(p, '-', '_')) GROUP BY 1""")
def phrase_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session lines that mention a project's name as a phrase."""
    names = table(spark, sf_dir, "emergent_reports").select("project").filter("project is not null").distinct()
    blocks = F.filter("message.content", lambda b: (b["type"] == "text") & b["text"].isNotNull())
    body = F.lower(F.coalesce(F.array_join(F.transform(blocks, lambda b: b["text"]), " "), F.lit("")))
    lines = table(spark, sf_dir, "session_messages").select("session_id", body.alias("body"))
    found = graph.containing(lines, names.select("project", F.replace("project", F.lit("-"), F.lit("_")).alias("name")))
    return found.groupBy("project").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("session_id").alias("sessions"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(^|[^a-z0-9-])([a-z][a-z0-9]*(-[a-z0-9]+){1,3})($|[^a-z0-9-])', 2)) AS phrase FROM documents WHERE text IS NOT NULL)
SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1""")
def kebab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kebab phrases of all documents with their counts."""
    found = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(text.kebab_phrases(F.col("text"))).alias("phrase"))
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(r"""SELECT row_id, unnest(regexp_extract_all(text, '\]\(([^)\s]+)\)', 1)) AS target FROM chat_messages WHERE text IS NOT NULL""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets in chat messages."""
    return table(spark, sf_dir, "chat_messages").filter("text is not null").select("row_id", F.explode(text.link_targets(F.col("text"))).alias("target"))


# ===================================================== event log, freshness, use ==

LOG_CTE = """
WITH e AS (SELECT event_id, epoch_us(ts) AS m, 'u' || user_id AS handle, json_extract(props, '$.k')::BIGINT AS k, value,
  CASE event_type WHEN 'click' THEN 'explicit_recall' WHEN 'view' THEN 'lens_included' WHEN 'error' THEN 'recall_fault' WHEN 'purchase' THEN 'operator_selected' ELSE 'focus' END AS kind FROM events),
n AS (SELECT max(m) AS now FROM e),
wt AS (SELECT * FROM (VALUES ('explicit_recall', 1.0::DOUBLE), ('operator_selected', 1.0), ('recall_fault', 0.7), ('lens_included', 0.5)) t(kind, weight))
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"click": "explicit_recall", "view": "lens_included", "error": "recall_fault", "purchase": "operator_selected"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("event_type")], F.lit("focus"))
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("m"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("handle"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value", kind.alias("kind"))
    return e.crossJoin(e.agg(F.max("m").alias("now")))  # one row of now


def _weight() -> F.Column:
    from strandloom.schema import ACCESS_WEIGHTS

    return F.create_map(*[F.lit(x) for k, w in ACCESS_WEIGHTS.items() for x in (k, float(w))])[F.col("kind")]


@query(LOG_CTE + "SELECT event_id, kind, k FROM e, n WHERE kind <> 'focus' AND m >= now - 2592000000000 AND k IN (SELECT chunk_index FROM ingest_chunks)")
def access_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access events of the last 30 days on wanted keys."""
    wanted = table(spark, sf_dir, "ingest_chunks").select(F.col("chunk_index").cast("long").alias("k")).distinct()
    return _log(spark, sf_dir).filter((F.col("kind") != "focus") & (F.col("m") >= F.col("now") - F.lit(2592000000000))).join(wanted, "k", "left_semi").select("event_id", "kind", "k")


FRESH_CTE = LOG_CTE + """, b AS (SELECT k, ln(1 + sum(weight * power(greatest(1, (now - m) // 3600000000), -0.5))) AS base, count(*) AS n FROM e JOIN wt USING (kind), n WHERE m >= now - 2592000000000 GROUP BY 1),
p AS (SELECT min(round(base, 9)) AS lo, max(round(base, 9)) AS hi FROM b)
"""


@query(FRESH_CTE + "SELECT k, n, round(CASE WHEN hi > lo THEN (round(base, 9) - lo) / (hi - lo) ELSE 0.5 END, 6) AS freshness FROM b, p")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-level activation of each key from weighted accesses, scaled to the pool."""
    recent = _log(spark, sf_dir).filter((F.col("kind") != "focus") & (F.col("m") >= F.col("now") - F.lit(2592000000000)))
    base = recent.groupBy("k").agg(F.round(graph.base_level(F.floor((F.col("now") - F.col("m")) / 3600000000), _weight()), 9).alias("base"), F.count(F.lit(1)).alias("n"))
    pool = base.agg(F.min("base").alias("lo"), F.max("base").alias("hi"))  # one row
    return base.crossJoin(pool).select("k", "n", F.round(vec.min_max(F.col("base"), F.col("lo"), F.col("hi"), 0.5), 6).alias("freshness"))


USE_CTE = LOG_CTE + """, s AS (SELECT handle, count(*) AS surfaced FROM e WHERE kind = 'lens_included' GROUP BY 1),
d AS (SELECT DISTINCT handle, k, kind FROM e WHERE kind NOT IN ('lens_included', 'focus')),
w AS (SELECT handle, round(sum(weight), 6) AS used_weighted, count(DISTINCT k) AS used_queries FROM d JOIN wt USING (kind) GROUP BY 1),
l AS (SELECT handle, coalesce(surfaced, 0) AS surfaced, coalesce(used_weighted, 0) AS used_weighted, coalesce(used_queries, 0) AS used_queries FROM s FULL JOIN w USING (handle))
"""


def _use(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    used = log.filter("kind not in ('lens_included', 'focus')").select("handle", F.col("k").alias("query_key"), "kind")
    return ledger.use_ledger(log.filter("kind = 'lens_included'").select("handle"), used)


@query(USE_CTE + "SELECT * FROM l")
def use_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each handle surfaced and was used."""
    return _use(spark, sf_dir)


@query(USE_CTE + """, p AS (SELECT surfaced / sum(surfaced) OVER () AS p FROM l WHERE surfaced > 0)
SELECT (SELECT round(sum(-p * ln(p)) / ln(count(*)), 6) FROM p) AS entropy, count(*) FILTER (used_queries = 0 AND surfaced >= 10) AS never_used, count(*) AS handles FROM l""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of what surfaces and handles shown ten times but never used."""
    use = _use(spark, sf_dir)
    spread = signals.entropy(use, [], "surfaced").select(F.col("normalised").alias("entropy"))
    counts = use.agg(F.count(F.when((F.col("used_queries") == 0) & (F.col("surfaced") >= 10), 1)).alias("never_used"), F.count(F.lit(1)).alias("handles"))
    return spread.crossJoin(counts)  # one row each


@query(LOG_CTE + "SELECT k, round(0.5 * sum(exp(-((now - m) / 1e6) / 36000.0)), 6) AS penalty, count(*) AS shown FROM e, n WHERE kind = 'lens_included' AND m >= now - 5 * 36000000000 GROUP BY 1")
def refractory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalty on keys that were shown lately (tau of ten hours here)."""
    shown = _log(spark, sf_dir).filter((F.col("kind") == "lens_included") & (F.col("m") >= F.col("now") - F.lit(5 * 36000000000)))
    fade = F.exp(-((F.col("now") - F.col("m")) / 1e6) / 36000.0)
    return shown.groupBy("k").agg(F.round(0.5 * F.sum(fade), 6).alias("penalty"), F.count(F.lit(1)).alias("shown"))


@query(LOG_CTE + "SELECT handle AS key, arg_max(value, (m, event_id)) AS value, max(event_id) FILTER (last) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY m DESC, event_id DESC) = 1 AS last FROM e) GROUP BY 1")
def replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write of each handle."""
    log = _log(spark, sf_dir)
    last = ledger.replay_counters(log.select(F.col("handle").alias("key"), F.struct("value", "event_id").alias("value"), F.struct("m", "event_id").alias("seq")))
    return last.select("key", "value.value", F.col("value.event_id").alias("seq"))


@query(LOG_CTE + """, o AS (SELECT handle, value, row_number() OVER (PARTITION BY handle ORDER BY m DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY handle) AS n FROM e)
SELECT handle, round(sum(value * CASE WHEN back = n - 1 THEN power(0.7, back) ELSE 0.3 * power(0.7, back) END), 6) AS ema, max(n) AS n FROM o GROUP BY 1""")
def rolling_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling mean of each handle's values after its last event."""
    return ledger.ema(_log(spark, sf_dir), "handle", ["m", "event_id"], "value")


# ============================================================== concept graph ==

GRAPH_CTE = LOG_CTE + """, t AS (SELECT 'c' || lag(k) OVER (PARTITION BY handle ORDER BY m, event_id) AS a, 'c' || k AS b, least(1.0, value / 100) AS confidence, m, event_id FROM e),
g AS (SELECT a, b, max(confidence) AS confidence, count(*) AS touch_count, max(m) AS last_micros FROM t WHERE a IS NOT NULL AND a <> b GROUP BY 1, 2),
c AS (SELECT g.*, round(least(1, greatest(0, confidence * exp(-greatest(1.0 / 60, (now - last_micros) / 3.6e9) / 72))), 9) AS w FROM g, n),
ud AS (SELECT at_, to_, max(w) AS w FROM (SELECT a AS at_, b AS to_, w FROM c UNION ALL SELECT b, a, w FROM c) GROUP BY 1, 2),
s0 AS (SELECT 'c' || k AS seed, 'c' || k AS handle, 1.0::DOUBLE AS activation FROM (SELECT DISTINCT k FROM e)),
h1 AS (SELECT seed, to_ AS handle, max(round(activation * w * 0.5, 9)) AS activation FROM s0 JOIN ud ON handle = at_ WHERE round(activation * w * 0.5, 9) >= 0.05 GROUP BY 1, 2),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY activation DESC, handle) AS nth FROM h1) WHERE nth <= 16),
h2 AS (SELECT seed, to_ AS handle, max(round(activation * w * 0.5, 9)) AS activation FROM f1 JOIN ud ON handle = at_ WHERE round(activation * w * 0.5, 9) >= 0.05 GROUP BY 1, 2)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("k").over(Window.partitionBy("handle").orderBy("m", "event_id"))
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    log = _log(spark, sf_dir)
    touches = log.select(name(before).alias("a"), F.lit("pairs_with").alias("relation"), name(F.col("k")).alias("b"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), F.lit("observed").alias("source"), F.col("m").alias("micros"), F.col("event_id").alias("seq"), "now")
    now = log.select("now").limit(1)
    return graph.with_conductance(graph.upserted_edges(touches).crossJoin(now), F.col("now"))


@query(GRAPH_CTE + "SELECT a, b, round(confidence, 6) AS confidence, touch_count, w FROM c")
def edge_conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between keys that follow each other, with their conductance."""
    return _edges(spark, sf_dir).select("a", "b", F.round("confidence", 6).alias("confidence"), "touch_count", "w")


@query(GRAPH_CTE + "SELECT seed, handle, round(max(activation), 6) AS activation FROM (SELECT * FROM s0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2")
def diffusion_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreading activation over two hops from every key."""
    seeds = _log(spark, sf_dir).select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("seed")).distinct()
    seeds = seeds.select("seed", F.col("seed").alias("handle"), F.lit(1.0).alias("activation"))
    return graph.diffuse(seeds, graph.undirected(_edges(spark, sf_dir))).select("seed", "handle", F.round("activation", 6).alias("activation"))


@query(GRAPH_CTE + "SELECT handle, round(1 - exp(-sum(confidence)), 6) AS edge_lift, count(*) AS edges FROM (SELECT a AS handle, confidence FROM c UNION ALL SELECT b, confidence FROM c) GROUP BY 1")
def edge_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift of each handle from its edges."""
    return graph.edge_lift(_edges(spark, sf_dir))


ANCHOR_CTE = SIGNAL_CTE + """, x AS (SELECT project, unnest(range(1, 65)) AS i, e FROM r WHERE NOT stale AND project <> ''), k AS (SELECT project, i, avg(e[i]) AS a FROM x GROUP BY 1, 2 HAVING count(*) >= 10),
an AS (SELECT project, list(a ORDER BY i) AS mean FROM k GROUP BY 1)
"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.baselines(_signal_rows(spark, sf_dir).filter("not stale and project <> ''"), "project", 64).select("project", "mean")


@query(ANCHOR_CTE + ", p AS (SELECT a.project, b.project AS neighbour, round(list_cosine_similarity(a.mean, b.mean), 6) AS cosine FROM an a JOIN an b ON a.project <> b.project) SELECT project, neighbour, cosine, nth FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY cosine DESC, neighbour) AS nth FROM p WHERE cosine >= 0.2) WHERE nth <= 8")
def latent_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest other anchors of each project's anchor above a floor."""
    a = _anchors(spark, sf_dir)
    pairs = ledger.anchor_matches(a.selectExpr("project AS id", "mean AS v"), a.selectExpr("project AS anchor", "mean AS v"), 0.2).filter("anchor <> id")
    pairs = pairs.select(F.col("anchor").alias("project"), F.col("id").alias("neighbour"), "cosine")
    return signals.newest(pairs, ["project"], 8, [F.desc("cosine"), F.col("neighbour")]).select("project", "neighbour", "cosine", "nth")


@query(ANCHOR_CTE + "SELECT vec_id, an.project AS anchor, round(list_cosine_similarity(e, mean), 6) AS cosine FROM r JOIN an ON round(list_cosine_similarity(e, mean), 6) >= CASE WHEN r.stale THEN 0.45 ELSE 0.4 END AND r.project <> an.project")
def anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks close to another project's anchor; the threshold depends on the row."""
    rows_ = _signal_rows(spark, sf_dir)
    found = ledger.anchor_matches(rows_.selectExpr("vec_id AS id", "v"), _anchors(spark, sf_dir).selectExpr("project AS anchor", "mean AS v"), 0.4)
    found = found.withColumnRenamed("id", "vec_id").join(rows_.select("vec_id", "project", "stale"), "vec_id")
    return found.filter((F.col("cosine") >= F.when(F.col("stale"), 0.45).otherwise(0.4)) & (F.col("project") != F.col("anchor"))).select("vec_id", "anchor", "cosine")


# ================================================================ thread ledger ==

THREAD_CTE = """
WITH l AS (SELECT handle, coalesce(members, 0)::BIGINT AS members, CASE WHEN cohesion IS NULL OR isnan(cohesion) THEN 0.0 ELSE least(1.0, cohesion::DOUBLE) END AS cohesion, len(samples)::BIGINT AS resonance, epoch_us(surfaced_at) AS m, coalesce(project, '') AS project,
  row_number() OVER (PARTITION BY handle ORDER BY surfaced_at DESC, members DESC) AS nth FROM emergent_reports),
n AS (SELECT max(m) AS now FROM l),
t AS (SELECT *, (now - m) / 8.64e10 AS days, least(1.0, members / 20.0) AS ramp FROM l, n WHERE nth = 1),
sc AS (SELECT *, (0.1 + 0.9 * ramp) * exp(-(0.05 - 0.045 * ramp) * days) + cohesion + 0.5 * CASE WHEN resonance <= 5 AND cohesion >= 0.3 AND members < 5 THEN (cohesion - 0.3) / 0.7 ELSE 0 END AS score FROM t)
"""


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("handle").orderBy(F.desc("surfaced_at"), F.desc_nulls_last("members"))
    reports = table(spark, sf_dir, "emergent_reports").withColumn("nth", F.row_number().over(last)).filter("nth = 1")
    cohesion = F.when(F.col("cohesion").isNull() | F.isnan("cohesion"), 0.0).otherwise(F.least(F.lit(1.0), F.col("cohesion").cast("double")))
    rows_ = reports.select("handle", F.coalesce("members", F.lit(0)).cast("long").alias("members"), cohesion.alias("cohesion"), F.size("samples").cast("long").alias("resonance"), F.unix_micros("surfaced_at").alias("m"), F.coalesce("project", F.lit("")).alias("project"))
    rows_ = rows_.crossJoin(table(spark, sf_dir, "emergent_reports").agg(F.unix_micros(F.max("surfaced_at")).alias("now")))  # one row
    tension = F.when(F.col("members") < 5, 0.1).otherwise(0.9)
    days = (F.col("now") - F.col("m")) / 8.64e10
    score = ledger.thread_score(F.col("members"), F.col("resonance"), tension, days, F.col("cohesion"))
    return rows_.withColumn("days", days).withColumn("score", score)


@query(THREAD_CTE + "SELECT handle, round(score, 6) AS score, round(days, 6) AS days FROM sc WHERE NOT (members >= 50 AND resonance / members::DOUBLE < 0.05)")
def thread_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each reported thread that is no stop handle."""
    t = _threads(spark, sf_dir).filter(~ledger.stop_handle(F.col("members"), F.col("resonance")))
    return t.select("handle", F.round("score", 6).alias("score"), F.round("days", 6).alias("days"))


@query(THREAD_CTE + """SELECT handle, CASE WHEN round(score, 6) >= 1.0 - CASE WHEN st = 'active' THEN 0.05 ELSE 0 END THEN 'active' WHEN round(score, 6) >= 0.3 - CASE WHEN st = 'slack' THEN 0.05 ELSE 0 END THEN 'slack' WHEN round(score, 6) >= 0.1 - CASE WHEN st = 'dormant' THEN 0.05 ELSE 0 END THEN 'dormant' ELSE 'archived' END AS next_state,
  CASE WHEN days >= 60 * (1 + least(resonance, 20) / 20.0) THEN 'dormant' WHEN days >= 14 * (1 + least(resonance, 20) / 20.0) AND st = 'active' THEN 'slack' ELSE st END AS faded
FROM (SELECT *, CASE WHEN members >= 5 THEN 'active' ELSE 'slack' END AS st FROM sc) WHERE NOT (members >= 50 AND resonance / members::DOUBLE < 0.05)""")
def curator_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next state by score with hysteresis, and by idleness."""
    t = _threads(spark, sf_dir).filter(~ledger.stop_handle(F.col("members"), F.col("resonance"))).withColumn("st", F.when(F.col("members") >= 5, "active").otherwise("slack"))
    return t.select("handle", ledger.curator_state(F.col("st"), F.round("score", 6)).alias("next_state"), ledger.fade_state(F.col("st"), F.col("resonance"), F.col("days")).alias("faded"))


@query(THREAD_CTE + "SELECT handle, members, cohesion FROM t WHERE members >= 5 AND cohesion >= 0.9")
def promote_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals that are large and tight enough."""
    rows_ = _threads(spark, sf_dir).withColumnRenamed("m", "micros")
    return threads.proposals(rows_, F.lit(0)).filter("promoted").select("handle", "members", "cohesion")


@query("""SELECT source_id, count(*) AS pieces, 'proposed-' || left(sha256(string_agg(chunk_id || chr(10), '' ORDER BY chunk_id)), 8) AS handle FROM (SELECT DISTINCT source_id, chunk_id FROM ingest_chunks) GROUP BY 1""")
def proposed_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each file's group of pieces."""
    ids = table(spark, sf_dir, "ingest_chunks").groupBy("source_id").agg(F.collect_set("chunk_id").alias("ids"))
    return ids.select("source_id", F.size("ids").cast("long").alias("pieces"), text.proposed_handle(F.col("ids")).alias("handle"))


@query(THREAD_CTE + SIGNAL_CTE.replace("WITH r AS", ", r AS").replace("n AS (SELECT max(m) AS now FROM r)", "nv AS (SELECT max(m) AS now FROM r)") + """, vx AS (SELECT project, unnest(range(1, 65)) AS i, e FROM r WHERE NOT stale), vk AS (SELECT project, i, avg(e[i]) AS a FROM vx GROUP BY 1, 2 HAVING count(*) >= 10),
vb AS (SELECT project, list(a ORDER BY i) AS mean FROM vk GROUP BY 1), vg AS (SELECT list(a ORDER BY i) AS mean FROM (SELECT i, avg(e[i]) AS a FROM vx GROUP BY 1)),
w AS (SELECT r.project, avg(round(greatest(0, 1 - list_cosine_similarity(e, coalesce(vb.mean, vg.mean))), 6)) AS novelty FROM r LEFT JOIN vb USING (project), vg WHERE NOT stale GROUP BY 1),
d AS (SELECT project, max(cohesion) AS density, max(members) AS size FROM t GROUP BY 1),
a AS (SELECT coalesce(project, '') AS project, count(*) AS lines FROM session_messages GROUP BY 1), y AS (SELECT *, lines / (SELECT max(lines) FROM a)::DOUBLE AS activity FROM a)
SELECT project, round((coalesce(density, 0) + coalesce(activity, 0) + coalesce(novelty, 0)) / 3, 6) AS composite, (density IS NOT NULL) AS has_density FROM d FULL JOIN y USING (project) FULL JOIN w USING (project) WHERE coalesce(density, 1) >= 0.5 AND coalesce(novelty, 1) >= 0.3""")
def thread_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density, activity and novelty of each project in one composite; a missing axis passes its filter and counts 0."""
    d = _threads(spark, sf_dir).groupBy("project").agg(F.max("cohesion").alias("density"))
    a = table(spark, sf_dir, "session_messages").groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.count(F.lit(1)).alias("lines"))
    a = a.crossJoin(a.agg(F.max("lines").alias("most"))).select("project", (F.col("lines") / F.col("most")).alias("activity"))  # one row
    n = novelty_scores(spark, sf_dir).join(_signal_rows(spark, sf_dir).select("vec_id", "project"), "vec_id").groupBy("project").agg(F.avg("novelty").alias("novelty"))
    both = d.join(a, "project", "full").join(n, "project", "full").filter("coalesce(density, 1) >= 0.5 and coalesce(novelty, 1) >= 0.3")
    score = signals.composite({"density": F.col("density"), "activity": F.col("activity"), "novelty": F.col("novelty")}, {})
    return both.select("project", score.alias("composite"), F.col("density").isNotNull().alias("has_density"))


@query("""WITH c AS (SELECT source, source_id, chunk_id, chunk_index, row_number() OVER (PARTITION BY source, source_id ORDER BY chunk_index, chunk_id) AS first FROM (SELECT DISTINCT source, source_id, chunk_id, chunk_index FROM ingest_chunks)),
v AS (SELECT DISTINCT chunk_id, NOT stale AS live FROM candidate_vectors WHERE NOT stale)
SELECT c.chunk_id, CASE WHEN v.chunk_id IS NOT NULL THEN 'valid' WHEN o.chunk_id IS NOT NULL THEN 'moved' ELSE 'orphaned' END AS state FROM c LEFT JOIN v USING (chunk_id)
LEFT JOIN (SELECT c.source, c.source_id, min(c.chunk_id) AS chunk_id FROM c JOIN v USING (chunk_id) GROUP BY 1, 2) o ON c.source = o.source AND c.source_id = o.source_id""")
def evidence_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that still resolves, has moved within its file, or is orphaned."""
    at = table(spark, sf_dir, "ingest_chunks").select("source", "source_id", "chunk_id", "chunk_index").distinct()
    live = table(spark, sf_dir, "candidate_vectors").filter("not stale").select("chunk_id").distinct().withColumn("live", F.lit(True))
    found = at.join(live, "chunk_id", "left")
    any_live = F.max(F.coalesce("live", F.lit(False))).over(Window.partitionBy("source", "source_id"))
    state = F.when(F.col("live"), "valid").when(any_live, "moved").otherwise("orphaned")
    return found.select("chunk_id", state.alias("state"))


@query(BM25_CTE + "SELECT query_id, source, count(*) AS hits, arg_min(id, place) AS head, round(sum(score), 6) AS total FROM h GROUP BY 1, 2")
def page_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each query folded to a page a source: head, count and total."""
    hits = _recall(spark, sf_dir)
    return hits.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("hits"), F.min_by("id", "place").alias("head"), F.round(F.sum("score"), 6).alias("total"))


@query()
def lens_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats of each query's best hits under a token budget, no text twice."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), F.size(F.split("text", r"\s+")).alias("n_tokens"))
    hits = _recall(spark, sf_dir, S.LENS_K)
    return ledger.portfolio(hits.select("query_id", "id", "score").join(docs, "id"))


@query(BM25_CTE + """, qt AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS a FROM eval_items), dt AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(coalesce(text, ' ')), '[a-z0-9]+')) AS t FROM documents)
SELECT query_id, id, round(len(list_intersect(a, t)) / greatest(1, len(a))::DOUBLE, 6) AS score FROM h JOIN qt USING (query_id) JOIN dt USING (id)""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of hybrid recall scored again by shared tokens."""
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("passage").alias("q"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return retrieval.overlap_rerank(_recall(spark, sf_dir), items, docs)


@query(BM25_CTE + """, b10 AS (SELECT query_id, id, lane_rank + 1 AS before FROM b WHERE lane_rank < 10), a10 AS (SELECT query_id, id, place AS after FROM h)
SELECT query_id, id, before, after, before - after AS delta FROM b10 FULL JOIN a10 USING (query_id, id)""")
def rank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the keyword lane against those of hybrid recall."""
    words = _bm25(spark, sf_dir).filter("lane_rank < 10").withColumn("place", F.col("lane_rank") + 1)
    return retrieval.rank_delta(words, _recall(spark, sf_dir))


@query(LOG_CTE + ", x AS (SELECT handle, k, max((m, event_id)) AS at_ FROM e GROUP BY 1, 2) SELECT handle, k, place FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY at_ DESC, k) AS place FROM x) WHERE place <= 9")
def focus_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last nine different keys of each handle."""
    return graph.focus_ring(_log(spark, sf_dir), "handle", "k", ["m", "event_id"])


@query("""WITH s AS (SELECT snippet, count(DISTINCT project) AS span FROM candidate_vectors WHERE snippet IS NOT NULL AND project IS NOT NULL GROUP BY 1), n AS (SELECT count(DISTINCT project) AS n FROM candidate_vectors WHERE snippet IS NOT NULL AND project IS NOT NULL)
SELECT snippet, span, CASE WHEN greatest(n, span) > 1 THEN round(1 - (span - 1) / (greatest(n, span) - 1)::DOUBLE, 6) ELSE 1.0 END AS specificity FROM s, n""")
def span_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How specific each snippet is to a project."""
    return graph.span_specificity(table(spark, sf_dir, "candidate_vectors").filter("snippet is not null and project is not null"), "snippet", "project")


@query(ANCHOR_CTE + "SELECT a.project AS a, b.project AS b, round(list_cosine_similarity(a.mean, b.mean), 6) AS cosine FROM an a JOIN an b ON a.project < b.project WHERE round(list_cosine_similarity(a.mean, b.mean), 6) >= 0.3")
def anchor_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of anchors close enough to bridge."""
    a = _anchors(spark, sf_dir)
    pairs = ledger.anchor_matches(a.selectExpr("project AS id", "mean AS v"), a.selectExpr("project AS anchor", "mean AS v"), 0.3)
    return pairs.filter("anchor < id").select(F.col("anchor").alias("a"), F.col("id").alias("b"), "cosine")


@query(ANCHOR_CTE + """, p AS (SELECT a.project, round(list_cosine_similarity(a.mean, b.mean), 6) AS c, row_number() OVER (PARTITION BY a.project ORDER BY round(list_cosine_similarity(a.mean, b.mean), 6) DESC, b.project) AS nth FROM an a JOIN an b ON a.project <> b.project)
SELECT project, round(avg(c), 6) AS nearness FROM p WHERE nth <= 3 GROUP BY 1""")
def negative_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each anchor's three highest cosines to the others."""
    a = _anchors(spark, sf_dir)
    near = products(a.selectExpr("project AS id", "mean AS v"), a.selectExpr("project AS query_id", "mean AS v"), "similarity", limit=4)  # itself and three
    near = near.filter("query_id <> id").withColumnRenamed("query_id", "project")
    return signals.newest(near, ["project"], 3, [F.desc("score"), F.col("id")]).groupBy("project").agg(F.round(F.avg("score"), 6).alias("nearness"))


@query("""SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_micros, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling event-time windows; the streaming form is in ``streaming``."""
    e = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.unix_micros("w.start").alias("start_micros"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '12 hours' THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g) SELECT user_id, epoch_us(min(ts)) AS start_micros, count(*) AS n FROM s GROUP BY user_id, nth""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time sessions with a gap of twelve hours."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.unix_micros("w.start").alias("start_micros"), "n")


@query("""WITH f AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(symbol_name), '_[0-9]+$', ''), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS form FROM emits), t AS (SELECT row_id AS id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS norm FROM chat_messages WHERE text IS NOT NULL)
SELECT id, form FROM t JOIN f ON contains(norm, ' ' || form || ' ')""".replace("\\\\", "\\"))
def gazetteer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol names that chat messages mention as words."""
    texts = table(spark, sf_dir, "chat_messages").filter("text is not null").select(F.col("row_id").alias("id"), text.normalize(F.col("text")).alias("norm"))
    forms = table(spark, sf_dir, "emits").select(text.normalize(F.regexp_replace("symbol_name", "_[0-9]+$", "")).alias("form"))
    return graph.gazetteer(texts, forms)


@query("""WITH a AS (SELECT project, list_distinct(list(handle)) AS h FROM emergent_reports WHERE surfaced_at < TIMESTAMPTZ '2026-04-01 00:00:00+00' AND project IS NOT NULL GROUP BY 1), b AS (SELECT project, list_distinct(list(handle)) AS h FROM emergent_reports WHERE surfaced_at >= TIMESTAMPTZ '2026-04-01 00:00:00+00' AND project IS NOT NULL GROUP BY 1)
SELECT project, round(1 - len(list_intersect(coalesce(a.h, []), coalesce(b.h, []))) / len(list_distinct(list_concat(coalesce(a.h, []), coalesce(b.h, []))))::DOUBLE, 6) AS drift FROM a FULL JOIN b USING (project)""")
def jaccard_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each project's handles changed between two spans of time."""
    when = F.lit("2026-04-01 00:00:00+00:00").cast("timestamp")
    r = table(spark, sf_dir, "emergent_reports").filter("project is not null")
    sets = r.groupBy("project").agg(F.collect_set(F.when(F.col("surfaced_at") < when, F.col("handle"))).alias("a"), F.collect_set(F.when(F.col("surfaced_at") >= when, F.col("handle"))).alias("b"))
    return sets.select("project", F.round(1 - F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("drift"))


@query("""SELECT chunk_id, 'missing' AS side FROM (SELECT chunk_id FROM ingest_chunks WHERE source <> 'code' EXCEPT SELECT chunk_id FROM candidates) UNION ALL SELECT chunk_id, 'extra' FROM (SELECT chunk_id FROM candidates EXCEPT SELECT chunk_id FROM ingest_chunks WHERE source <> 'code')""")
def missing_extra_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids on one side only: pieces that no query retrieved, and retrieved ones of code."""
    a, b = table(spark, sf_dir, "ingest_chunks").filter("source <> 'code'").select("chunk_id"), table(spark, sf_dir, "candidates").select("chunk_id")
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


@query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z,;] ([A-Z][a-z]{2,})', 1)) AS word FROM documents WHERE text IS NOT NULL)
SELECT lower(word) AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def prose_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words inside sentences that three documents share."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z,;] ([A-Z][a-z]{2,})"), 1)).alias("w"))
    return found.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).filter("docs >= 3")
