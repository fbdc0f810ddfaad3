"""Queries of corpus sinks, marks, repair and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandloom.functions import text, vec
from strandloom.operators import changes, retrieval, rows, threads, upkeep
from strandloom.queries import query
from strandloom.session import fresh_dir, table

BODY = "coalesce(array_to_string(list_transform(list_filter(message.content, lambda b: b.type = 'text' AND b.text IS NOT NULL), lambda b: b.text), chr(10)), '')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.filter("message.content", lambda b: (b["type"] == "text") & b["text"].isNotNull())
    body = F.coalesce(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), F.lit(""))
    first = F.element_at(F.col("message.content"), 1)["type"]
    return table(spark, sf_dir, "session_messages").select("row_id", "session_id", "line_no", "line_type", body.alias("body"), F.when(F.size("message.content") > 0, first).alias("block"), F.col("arrived_at"))


@query("""SELECT vec_id, stale OR chunk_id IN (SELECT chunk_id FROM ingest_chunks WHERE content_sha256 = '' OR chunk_index % 7 = 0) OR coalesce(snippet LIKE '%commit time%', false) AS stale FROM candidate_vectors""")
def stale_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks after marking by id and by text."""
    ids = table(spark, sf_dir, "ingest_chunks").filter("content_sha256 = '' or chunk_index % 7 = 0").select("chunk_id")
    return upkeep.mark_stale(table(spark, sf_dir, "candidate_vectors"), ids, F.col("snippet").contains("commit time")).select("vec_id", "stale")


@query(f"""WITH l AS (SELECT row_id, {BODY} AS body, message.content[1].type AS block FROM session_messages)
SELECT row_id, coalesce(block IN ('tool_use', 'tool_result'), false) OR body LIKE '<task-notification>%' AS apparatus,
  body LIKE '<local-command-%' OR body LIKE '<command-name>%' OR body LIKE '</command-name>%' OR body LIKE '<command-message>%' OR body LIKE '<command-args>%' AS wrapper FROM l""")
def apparatus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session lines that are tool traffic or command wrappers."""
    return _lines(spark, sf_dir).select("row_id", upkeep.apparatus(F.col("block"), F.col("body")).alias("apparatus"), upkeep.wrapper(F.col("body")).alias("wrapper"))


@query("""SELECT doc_id FROM documents WHERE NOT coalesce('lang:' || lang IN ('lang:de', 'lang:fr'), false) AND NOT coalesce('kind:' || doc_kind IN ('kind:draft'), false)""")
def facet_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a denied facet."""
    facets = F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("kind:"), "doc_kind")))
    return table(spark, sf_dir, "documents").filter(~upkeep.denied(facets, ("lang:de", "lang:fr", "kind:draft"))).select("doc_id")


@query("""WITH p AS (SELECT DISTINCT source, source_id, CASE WHEN size_bytes % 11 = 0 THEN 'a/target/' WHEN size_bytes % 11 = 1 THEN '.state/' WHEN size_bytes % 11 = 2 THEN '.state/mirror/' ELSE '' END || source_id || CASE WHEN size_bytes % 3 = 0 THEN '/journal.jsonl' ELSE '' END AS path FROM ingest_sources),
f AS (SELECT *, string_split(path, '/') AS d FROM p)
SELECT source, source_id, path, contains('/' || path || '/', '/.state/mirror/') OR list_has_any(d, ['.git', 'target', 'node_modules', '.pnpm', '.worktrees', '.next', '.turbo', 'dist', 'build']) OR (list_contains(d, '.state') AND d[-1] NOT IN ('journal.jsonl', 'audit.jsonl', 'decisions.jsonl', 'issues.jsonl')) AS noise,
  path LIKE 'merge-ledger/%' AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('md', 'rs') AS under_root FROM f""".replace("\\\\", "\\"))
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths a watcher passes over, and those below a configured root."""
    kind = F.col("size_bytes") % 11
    head = F.when(kind == 0, "a/target/").when(kind == 1, ".state/").when(kind == 2, ".state/mirror/").otherwise("")
    path = F.concat(head, "source_id", F.when(F.col("size_bytes") % 3 == 0, "/journal.jsonl").otherwise(""))
    found = table(spark, sf_dir, "ingest_sources").select("source", "source_id", path.alias("path")).distinct()
    return found.select("source", "source_id", "path", upkeep.noisy_path(F.col("path")).alias("noise"), upkeep.under(F.col("path"), "merge-ledger", ("md", "rs")).alias("under_root"))


@query("""SELECT row_id AS id, CASE WHEN sender IN ('primary', 'evolution', 'usage') THEN sender END AS role, substr(text, 1, 400) AS snippet, conv_name AS named FROM chat_messages WHERE text IS NOT NULL""")
def hit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages as hits."""
    chats = table(spark, sf_dir, "chat_messages").filter("text is not null")
    extra = F.to_json(F.create_map(F.lit("name"), F.col("conv_name")))
    found = upkeep.hit_rows(chats.select(F.col("row_id").alias("id"), F.lit("zip_export").alias("source"), "text", F.col("sender").alias("role"), extra.alias("extra")))
    return found.select("id", "role", "snippet", F.col("extra")["name"].alias("named"))


@query("""SELECT source, chunk_id, chunk_index, row_number() OVER (PARTITION BY source, source_id ORDER BY chunk_index, chunk_id) AS nth FROM (SELECT DISTINCT source, source_id, chunk_id, chunk_index FROM ingest_chunks) WHERE source IN ('code', 'thread')""")
def ids_of_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids of each file of two sources, in order."""
    at = table(spark, sf_dir, "ingest_chunks").filter("source in ('code', 'thread')").select("source", "source_id", "chunk_id", "chunk_index").distinct()
    nth = F.row_number().over(Window.partitionBy("source", "source_id").orderBy("chunk_index", "chunk_id"))
    return at.select("source", "chunk_id", "chunk_index", nth.cast("long").alias("nth"))


@query("""SELECT vec_id, project, epoch_us(ts) AS micros, snippet FROM candidate_vectors WHERE chunk_id IN (SELECT chunk_id FROM candidates WHERE bm25_rank = 1) AND ts IS NOT NULL""")
def fetched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and times of wanted chunks; rows without a time are left out."""
    wanted = table(spark, sf_dir, "candidates").filter("bm25_rank = 1").select("chunk_id").distinct()
    found = table(spark, sf_dir, "candidate_vectors").filter("ts is not null").join(wanted, "chunk_id", "left_semi")
    return found.select("vec_id", "project", F.unix_micros("ts").alias("micros"), "snippet")


@query("""SELECT source, vec_id FROM (SELECT source, vec_id, row_number() OVER (PARTITION BY source ORDER BY ts DESC NULLS LAST, vec_id) AS nth FROM candidate_vectors WHERE NOT stale) WHERE nth <= 20""")
def recent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty live chunks of each source: a sample by its purpose."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("ts"), "vec_id"))
    return table(spark, sf_dir, "candidate_vectors").filter("not stale").withColumn("nth", nth).filter("nth <= 20").select("source", "vec_id")


@query("""SELECT DISTINCT chunk_id FROM candidate_vectors WHERE dense_embedding IS NOT NULL AND len(dense_embedding) = 64 AND chunk_id NOT IN (SELECT chunk_id FROM candidate_vectors WHERE NOT stale AND source <> 'code')""")
def backup_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backup rows to bring back: not live, with a vector of the right width."""
    backup = table(spark, sf_dir, "candidate_vectors")
    return upkeep.recovered(backup, backup.filter("not stale and source <> 'code'"), 64, vector="dense_embedding").select("chunk_id")


@query("""WITH c AS (SELECT chunk_id, max(CASE WHEN source IN ('gemini', 'codex') THEN NULL ELSE 'cfg-' || source END) AS config FROM candidate_vectors WHERE chunk_id IS NOT NULL GROUP BY 1), m AS (SELECT chunk_id, count(*) AS k FROM ingest_chunks WHERE chunk_index % 5 <> 0 AND chunk_id IS NOT NULL GROUP BY 1)
SELECT chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'delete' WHEN k IS NULL AND config IS NULL THEN 'unrepairable' WHEN k IS NULL THEN 'insert' ELSE 'collapse' END AS action FROM (SELECT chunk_id FROM c UNION SELECT chunk_id FROM m) LEFT JOIN c USING (chunk_id) LEFT JOIN m USING (chunk_id) WHERE c.chunk_id IS NULL OR k IS NULL OR k > 1""")
def manifest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What brings a manifest that lost a fifth of its rows in line with the corpus."""
    config = F.when(~F.col("source").isin("gemini", "codex"), F.concat(F.lit("cfg-"), "source"))
    corpus = table(spark, sf_dir, "candidate_vectors").select("chunk_id", config.alias("source_config_id"))
    return upkeep.repair(corpus, table(spark, sf_dir, "ingest_chunks").filter("chunk_index % 5 <> 0"))


SWEEP = """WITH run AS (SELECT arg_max(run_id, started_at) AS run_id FROM ingest_runs WHERE status = 'ok' AND finished_at IS NOT NULL),
un AS (SELECT DISTINCT source, source_id, source_config_id FROM source_listing WHERE present AND size_bytes % 2 = 0),
t AS (SELECT c.source, c.chunk_id, CASE WHEN un.source IS NOT NULL THEN run_id ELSE last_run_id END AS last_run_id, run_id FROM run, ingest_chunks c LEFT JOIN un ON un.source = c.source AND un.source_id = c.source_id AND un.source_config_id = c.source_config_id)
"""


@query(SWEEP + "SELECT chunk_id, CASE source WHEN 'code' THEN 'delete' WHEN 'markdown' THEN 'stale' WHEN 'file_glob' THEN 'stale' ELSE 'keep' END AS action, count(*) AS n FROM t WHERE last_run_id IS NULL OR last_run_id <> run_id GROUP BY 1, 2")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of files that the run has not stamped, with what happens to them."""
    run = changes.successful_runs(table(spark, sf_dir, "ingest_runs")).agg(F.max_by("last_run_id", "started_at")).first()[0]
    same = table(spark, sf_dir, "source_listing").filter("present and size_bytes % 2 = 0")
    manifest = upkeep.touched_run(table(spark, sf_dir, "ingest_chunks"), same, run, changes.KEY)
    return upkeep.swept(manifest, F.lit(run)).groupBy("chunk_id", "action").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH l AS (SELECT row_id, {BODY} AS body FROM session_messages), d AS (SELECT row_id FROM l WHERE ltrim(body, ' ') LIKE 'Run %' OR contains(body, '```'))
SELECT (SELECT count(*) FROM session_messages) AS before, count(*) AS corpus, count(*) FILTER (line_type IN ('user', 'assistant')) AS manifest, sum(row_id)::BIGINT AS ids FROM session_messages WHERE row_id NOT IN (SELECT row_id FROM d)""")
def rule_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of lines and their manifest once dropped ones are purged."""
    lines = _lines(spark, sf_dir)
    decision = rows.decide((rows.Rule(prefix="Run "), rows.Rule(contains="```")), F.col("body"), F.lit(""), F.lit(""))
    corpus, manifest = upkeep.purged(lines, lines.filter("line_type in ('user', 'assistant')").select("row_id"), decision, "row_id")
    left = corpus.agg(F.count(F.lit(1)).alias("corpus"), F.sum("row_id").alias("ids"))
    return lines.agg(F.count(F.lit(1)).alias("before")).crossJoin(left).crossJoin(manifest.agg(F.count(F.lit(1)).alias("manifest")))  # one row each


@query("""WITH n AS (SELECT chunk_id, content_sha256, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY upserted_at DESC, content_sha256, chunk_index) AS k FROM ingest_chunks WHERE chunk_id IS NOT NULL) WHERE k = 1)
SELECT chunk_id, CASE WHEN chunk_index % 3 = 0 THEN 'again' ELSE content_sha256 END AS content_sha256, chunk_index FROM n WHERE chunk_index % 5 <> 4""")
def corpus_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table after an append, an insert, an upsert, a delete and a compaction."""
    first = Window.partitionBy("chunk_id").orderBy(F.desc("upserted_at"), "content_sha256", "chunk_index")
    news = table(spark, sf_dir, "ingest_chunks").filter("chunk_id is not null").withColumn("k", F.row_number().over(first)).filter("k = 1").select("chunk_id", "content_sha256", "chunk_index")
    schema = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("content_sha256", T.StringType()), T.StructField("chunk_index", T.IntegerType())])
    held = upkeep.KeyedTable(spark, fresh_dir(spark, "corpus"), schema, buckets=8)
    held.append(news.filter("chunk_index % 2 = 0"))
    held.insert(news)  # only those that are not there
    held.upsert(news.filter("chunk_index % 3 = 0").withColumn("content_sha256", F.lit("again")))
    held.delete(F.col("chunk_index") % 5 == 4)
    held.optimize()
    return held.read()


@query("""SELECT DISTINCT source_config_id, left(sha256(source || chr(10) || '3'), 32) AS overlay, sha256('1|model-a|' || source_id) AS input FROM ingest_sources""")
def overlay_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of rules and parser, and of what is embedded."""
    found = table(spark, sf_dir, "ingest_sources")
    return found.select("source_config_id", upkeep.overlay_hash(F.col("source"), F.lit(3)).alias("overlay"), upkeep.embedding_input_hash(F.col("source_id"), "model-a").alias("input")).distinct()


@query("""SELECT DISTINCT source_id, regexp_extract(source_id, '([^/]+)/[^/]+$', 1) AS parent, regexp_replace(regexp_replace(lower(regexp_replace(source_id, '\\.[^./]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM ingest_sources WHERE length(source_id) <= 40""".replace("\\\\", "\\"))
def path_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project folders and handles of source paths."""
    found = table(spark, sf_dir, "ingest_sources").filter("length(source_id) <= 40")
    return found.select("source_id", text.project_of(F.col("source_id")).alias("parent"), text.doc_handle(F.col("source_id")).alias("slug")).distinct()


@query("""SELECT doc_id, nullif(regexp_extract(text, '(?m)^#[ \\t]+(\\S[^\\n]*?)[ \\t]*$', 1), '') AS title, count(*) AS lines, string_agg(regexp_replace(l, '^[ \\t]*(?:(?:[-*+>]|[0-9]{1,9}[.)])[ \\t]+)+', ''), '|' ORDER BY i) AS stripped
FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, text""".replace("\\\\", "\\"))
def line_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of documents and their lines without marks."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = F.split("text", "\n")
    return docs.select("doc_id", text.doc_title(F.col("text")).alias("title"), F.size(lines).cast("long").alias("lines"), F.array_join(F.transform(lines, text.strip_line_marker), "|").alias("stripped"))


@query("""WITH w AS (SELECT row_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w, text FROM chat_messages WHERE text IS NOT NULL)
SELECT row_id, CASE WHEN len(w) <= 7 THEN text ELSE array_to_string(w[greatest(0, len(w) // 2 - 3) + 1 : least(len(w), len(w) // 2 + 4)], ' ') END AS around, round(least(len(w), 6) / 6.0, 6) AS confidence FROM w""".replace("\\\\", "\\"))
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tokens around the middle of each chat message."""
    chats = table(spark, sf_dir, "chat_messages").filter("text is not null")
    n = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    return chats.select("row_id", text.token_window(F.col("text"), F.floor(n / 2).cast("int"), 7).alias("around"), F.round(text.stub_confidence(n), 6).alias("confidence"))


@query("""WITH v AS (SELECT vec_id, list_transform(dense_embedding, lambda x: x::DOUBLE) AS e, lag(list_transform(dense_embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY source ORDER BY vec_id) AS p FROM candidate_vectors WHERE dense_embedding IS NOT NULL AND len(dense_embedding) = 64
  AND len(list_filter(dense_embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT vec_id, round(CASE WHEN p IS NULL OR list_dot_product(e, e) = 0 OR list_dot_product(p, p) = 0 THEN 2.0 ELSE greatest(0, 1 - list_dot_product(e, p) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(p, p))) END, 6) AS distance FROM v""")
def cosine_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each vector to the one before it in its source; 2 where undefined."""
    finite = F.forall("dense_embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    found = table(spark, sf_dir, "candidate_vectors").filter((F.size("dense_embedding") == 64) & finite)
    before = F.lag("dense_embedding").over(Window.partitionBy("source").orderBy("vec_id"))
    return found.withColumn("before", before).select("vec_id", F.round(vec.cosine_distance(F.col("dense_embedding"), F.col("before")), 6).alias("distance"))


@query("""SELECT event_id, event_type AS kind, value, (props->>'$.k')::BIGINT AS k FROM events""")
def event_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events written as JSON payloads and read back."""
    from strandloom.streaming import observer

    e = table(spark, sf_dir, "events")
    packed = observer.encoded(e.select("event_id", F.col("event_type").alias("kind"), F.struct("value", F.get_json_object("props", "$.k").cast("long").alias("k")).alias("payload")))
    return observer.decoded(packed, "value double, k long").select("event_id", "kind", "payload.value", "payload.k")


@query("""SELECT count(*) AS distinct_vectors FROM (SELECT DISTINCT dense_embedding FROM candidate_vectors WHERE dense_embedding IS NOT NULL AND len(list_filter(dense_embedding, lambda x: x IS NULL OR isnan(x) OR x = 0)) = 0)""")
def distinct_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different vectors there are, by their bits."""
    fine = F.forall("dense_embedding", lambda x: F.coalesce(~F.isnan(x) & (x != 0), F.lit(False)))
    found = table(spark, sf_dir, "candidate_vectors").filter(F.col("dense_embedding").isNotNull() & fine)
    return found.select(F.xxhash64("dense_embedding").alias("h"), F.xxhash64("dense_embedding", F.lit(1)).alias("g")).distinct().agg(F.count(F.lit(1)).alias("distinct_vectors"))


@query("""WITH c AS (SELECT query_id, chunk_id AS id, max(round(bm25_score::DOUBLE, 6)) AS score FROM candidates WHERE bm25_score IS NOT NULL AND NOT isnan(bm25_score) GROUP BY 1, 2),
j AS (SELECT c.*, source_id, regexp_replace(lower(split_part(source_id, '/', 1)), '[^a-z0-9]+', '-', 'g') AS handle, regexp_replace(lower(regexp_replace(regexp_extract(source_id, '([^/]+)$', 1), '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g') AS stem,
  regexp_replace(lower(regexp_extract(CASE WHEN chunk_index % 4 = 0 THEN split_part(source_id, '/', 1) ELSE '' END, '([^.:]+)$', 1)), '[^a-z0-9]+', '-', 'g') AS tail FROM c JOIN (SELECT DISTINCT chunk_id AS id, source_id, chunk_index FROM ingest_chunks) USING (id))
SELECT query_id, handle, arg_min(id, (stem <> handle AND tail <> handle, -score, id)) AS id, bool_or(stem = handle OR tail = handle) AS named FROM j GROUP BY 1, 2""".replace("\\\\", "\\"))
def supporting_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit that speaks for each folder's handle."""
    score = table(spark, sf_dir, "candidates").filter("bm25_score is not null and not isnan(bm25_score)").groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.max(F.round(F.col("bm25_score").cast("double"), 6)).alias("score"))
    at = table(spark, sf_dir, "ingest_chunks").select(F.col("chunk_id").alias("id"), "source_id", "chunk_index").distinct()
    folder = F.substring_index("source_id", "/", 1)
    hits = score.join(at, "id").withColumn("handle", F.regexp_replace(F.lower(folder), "[^a-z0-9]+", "-")).withColumn("symbol", F.when(F.col("chunk_index") % 4 == 0, folder))
    return retrieval.supporting_hit(hits)


@query("""WITH c AS (SELECT query_id, chunk_id AS id, max(round(bm25_score::DOUBLE, 6)) AS score FROM candidates WHERE bm25_score IS NOT NULL AND NOT isnan(bm25_score) GROUP BY 1, 2),
v AS (SELECT chunk_id AS id, bool_or(stale) AS stale, bool_or(source IN ('claude_code', 'codex', 'gemini')) AS transcript, min(project) AS symbol FROM candidate_vectors GROUP BY 1),
r AS (SELECT c.*, coalesce(symbol, 'none') AS page, CASE WHEN stale THEN 'evolution' WHEN transcript THEN 'usage' ELSE 'primary' END AS role FROM c JOIN v USING (id))
SELECT query_id, page, arg_min(id, (role <> 'primary', -score, id)) AS head, count(*) AS total,
  array_to_string(coalesce(list(id ORDER BY score DESC, id) FILTER (role = 'evolution'), [])[1:3], ' ') AS lineage, array_to_string(coalesce(list(id ORDER BY score DESC, id) FILTER (role = 'usage'), [])[1:3], ' ') AS evidence FROM r GROUP BY 1, 2""")
def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each query with head, lineage and use."""
    score = table(spark, sf_dir, "candidates").filter("bm25_score is not null and not isnan(bm25_score)").groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.max(F.round(F.col("bm25_score").cast("double"), 6)).alias("score"))
    held = table(spark, sf_dir, "candidate_vectors").groupBy(F.col("chunk_id").alias("id")).agg(F.bool_or("stale").alias("stale"), F.bool_or(F.col("source").isin("claude_code", "codex", "gemini")).alias("transcript"), F.min("project").alias("symbol"))
    pages = retrieval.synthesised(score.join(held, "id").withColumn("source_id", F.lit("none")))
    return pages.select("query_id", "page", "head", "total", F.array_join("lineage", " ").alias("lineage"), F.array_join("evidence", " ").alias("evidence"))


@query("""WITH v AS (SELECT chunk_id AS id, arg_min(dense_embedding, vec_id) AS e FROM candidate_vectors WHERE dense_embedding IS NOT NULL AND len(dense_embedding) = 64 AND NOT stale GROUP BY 1),
t AS (SELECT DISTINCT source_id AS handle, min(chunk_id) AS anchor, count(*) % 3 = 0 AS cached FROM ingest_chunks GROUP BY source_id)
SELECT handle, CASE WHEN cached THEN 'cached' WHEN e IS NOT NULL THEN 'chunk' ELSE 'orphan' END AS origin, CASE WHEN cached THEN 1 WHEN e IS NOT NULL THEN 64 ELSE -1 END AS width FROM t LEFT JOIN v ON v.id = anchor""")
def reanchor_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file's anchor vector comes from."""
    vectors = table(spark, sf_dir, "candidate_vectors").filter((F.size("dense_embedding") == 64) & ~F.col("stale")).groupBy(F.col("chunk_id").alias("id")).agg(F.min_by("dense_embedding", "vec_id").alias("v"))
    files = table(spark, sf_dir, "ingest_chunks").groupBy(F.col("source_id").alias("handle")).agg(F.min("chunk_id").alias("anchor"), F.count(F.lit(1)).alias("n"))
    files = files.withColumn("cached", F.when(F.col("n") % 3 == 0, F.array(F.lit(1.0).cast("float"))))
    return threads.reanchored(files, vectors).select("handle", "origin", F.coalesce(F.size("v"), F.lit(-1)).alias("width"))


@query("""WITH v AS (SELECT project, snippet IS NULL AS scope, dense_embedding AS e, vec_id FROM candidate_vectors WHERE project IS NOT NULL AND dense_embedding IS NOT NULL AND len(list_filter(dense_embedding, lambda x: x IS NULL OR isnan(x))) = 0),
a AS (SELECT project AS handle, 's' || vec_id % 7 AS scope, CASE WHEN vec_id % 3 = 0 THEN len(arg_min(e, vec_id)) ELSE 0 END AS n, vec_id FROM v GROUP BY 1, 2, vec_id), s AS (SELECT handle, scope, max(n) AS n FROM a GROUP BY 1, 2), o AS (SELECT handle, arg_min(n, scope) AS other FROM s WHERE n > 0 GROUP BY 1)
SELECT handle, scope, CASE WHEN n > 0 THEN n ELSE other END AS width FROM s LEFT JOIN o USING (handle)""")
def anchor_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope's own anchor, else another scope's."""
    fine = F.forall("dense_embedding", lambda x: F.coalesce(~F.isnan(x), F.lit(False)))
    held = table(spark, sf_dir, "candidate_vectors").filter(F.col("project").isNotNull() & F.col("dense_embedding").isNotNull() & fine)
    scope = F.concat(F.lit("s"), (F.col("vec_id") % 7).cast("string"))
    mine = F.when(F.col("vec_id") % 3 == 0, F.col("dense_embedding")).otherwise(F.array().cast("array<float>"))
    rows_ = held.groupBy(F.col("project").alias("handle"), scope.alias("scope")).agg(F.max_by(mine, F.size(mine)).alias("v"))
    return threads.anchor_fallback(rows_).select("handle", "scope", F.when(F.col("v").isNotNull(), F.size("v")).alias("width"))


@query("""SELECT vec_id, len(dense_embedding) * 4 AS bytes, round(list_sum(list_transform(dense_embedding, lambda x: x::DOUBLE)), 4) AS total FROM candidate_vectors WHERE dense_embedding IS NOT NULL AND len(list_filter(dense_embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(dense_embedding) > 0""")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes and back."""
    finite = F.forall("dense_embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    held = table(spark, sf_dir, "candidate_vectors").filter((F.size("dense_embedding") > 0) & finite).select("vec_id", vec.packed("dense_embedding").alias("data"))
    back = held.select("vec_id", F.octet_length("data").cast("long").alias("bytes"), vec.unpacked("data").alias("v"))
    return back.select("vec_id", "bytes", F.round(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double")), 4).alias("total"))


@query("""WITH f AS (SELECT doc_id, list_filter(['lang:' || lang, 'project:' || project, 'kind:' || doc_kind, 'project:' || lower(trim(source))], lambda x: x IS NOT NULL AND NOT ends_with(x, ':')) AS f FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(f)), '|') AS facets FROM f""")
def facet_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets as a map of value lists and back as a list."""
    c = F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("project:"), "project"), F.concat(F.lit("kind:"), "doc_kind"), F.concat(F.lit("project:"), F.lower(F.trim("source")))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rows.facet_list(rows.facet_map(c)), "|").alias("facets"))


@query()
def near_duplicate_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks' anchors that are almost one, merged greedily."""
    finite = F.forall("dense_embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    held = table(spark, sf_dir, "candidate_vectors").filter((F.size("dense_embedding") == 64) & finite & F.exists("dense_embedding", lambda x: x != 0) & F.col("project").isNotNull())
    anchors = held.groupBy(F.concat_ws("/", "project", "source").alias("handle")).agg(F.min_by("dense_embedding", "vec_id").alias("v"), F.count(F.lit(1)).alias("resonance"), F.unix_micros(F.min("ts")).alias("micros"))
    return threads.near_duplicates(anchors, 0.9)
