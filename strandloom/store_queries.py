"""Queries of the concept store, the thread ledger and upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import text
from strandloom.operators import concepts, graph, ledger, threads
from strandloom.plans import memory
from strandloom.queries import ANCHOR_CTE, GRAPH_CTE, LOG_CTE, SIGNAL_CTE, THREAD_CTE, _anchors, _edges, _log, _signal_rows, _threads, query
from strandloom.ranking_queries import ACT_CTE, _activation, _lanes
from strandloom.session import cut, table

# ================================================================== the concept store ==

STORE_CTE = LOG_CTE + """,
ce AS (SELECT handle AS project, 'c' || k AS handle, CASE kind WHEN 'lens_included' THEN 0.1::DOUBLE ELSE 0.0 END AS confidence, CASE kind WHEN 'operator_selected' THEN 'decision' WHEN 'recall_fault' THEN 'need' END AS typ, event_id AS seq, kind, value FROM e),
al AS (SELECT handle, project AS alias, arg_min(kind, seq) AS source, count(*) AS touch_count FROM ce GROUP BY 1, 2),
ea AS (SELECT handle, kind AS source, project AS source_id, coalesce(arg_max(seq, seq) FILTER (value > 30), min(seq)) AS pointer, coalesce(arg_max(value, seq) FILTER (value > 30), CASE WHEN arg_min(value, seq) > 30 THEN arg_min(value, seq) END) AS anchor,
  round(max(value), 6) AS score, count(*) AS touch_count, CASE kind WHEN 'recall_fault' THEN 'orphaned' WHEN 'focus' THEN 'moved' ELSE 'active' END AS state FROM ce GROUP BY handle, kind, project)
"""


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    typ = F.when(F.col("kind") == "operator_selected", "decision").when(F.col("kind") == "recall_fault", "need")
    confidence = F.when(F.col("kind") == "lens_included", concepts.CANDIDATE_CONFIDENCE).otherwise(0.0)
    return _log(spark, sf_dir).select(F.col("handle").alias("project"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("handle"), confidence.alias("confidence"), typ.alias("typ"), F.col("event_id").alias("seq"), "kind", "value")


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.touched_aliases(_store(spark, sf_dir).select("handle", F.col("project").alias("alias"), F.col("kind").alias("source"), "seq"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir)
    anchor = F.when(F.col("value") > 30, F.col("value"))
    events = rows.select("handle", F.col("kind").alias("source"), F.col("project").alias("source_id"), F.col("seq").alias("pointer"), F.lit(None).cast("string").alias("sha"), anchor.alias("anchor"), F.round("value", 6).alias("score"), "seq")
    state = F.when(F.col("source") == "recall_fault", "orphaned").when(F.col("source") == "focus", "moved").otherwise("active")
    return concepts.attached_evidence(events).withColumn("state", state)


@query(STORE_CTE + "SELECT project, handle, arg_min(confidence, seq) AS confidence, arg_min(typ, seq) FILTER (typ IS NOT NULL) AS kind, min(seq) AS seq FROM ce GROUP BY 1, 2")
def concept_ensure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts made by their first event, with the first known kind."""
    return concepts.ensured(_store(spark, sf_dir).drop("kind").withColumnRenamed("typ", "kind"))


@query(STORE_CTE + "SELECT handle, alias, source, touch_count, row_number() OVER (PARTITION BY handle ORDER BY touch_count DESC, alias) AS place FROM al")
def concept_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases with their touches, the most touched first."""
    place = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("touch_count"), "alias"))
    return _aliases(spark, sf_dir).withColumn("place", place.cast("long"))


@query(STORE_CTE + "SELECT handle, source, source_id, pointer, anchor, score, touch_count FROM ea")
def concept_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows; pointer and anchor are replaced together, by rows that have an anchor."""
    return _held(spark, sf_dir).select("handle", "source", "source_id", "pointer", "anchor", "score", "touch_count")


@query(STORE_CTE + "SELECT handle, source, source_id, state, place FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY (state = 'active') DESC, score DESC NULLS LAST, touch_count DESC, source, source_id) AS place FROM ea) WHERE place <= 3")
def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pieces of evidence of each concept."""
    return concepts.ordered_evidence(_held(spark, sf_dir)).filter("place <= 3").select("handle", "source", "source_id", "state", "place")


@query(STORE_CTE + "SELECT handle, pointer, score FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY score DESC NULLS LAST, touch_count DESC, source, source_id) AS place FROM ea WHERE state = 'active') WHERE place = 1")
def concept_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first active evidence of each concept."""
    return concepts.anchors_of(_held(spark, sf_dir)).select("handle", "pointer", "score")


@query(STORE_CTE + """, h AS (SELECT handle, source, source_id, sum(touch_count) AS w FROM ea WHERE state = 'active' GROUP BY 1, 2, 3), s AS (SELECT handle, sum(w) AS total, count(*) AS n FROM h GROUP BY 1)
SELECT handle, round(CASE WHEN any_value(total) < 20 OR any_value(n) <= 1 THEN 1.0 ELSE least(1, greatest(0, 1 - sum(-(w / total) * ln(w / total)) / ln(any_value(n)))) END, 6) AS specificity FROM h JOIN s USING (handle) GROUP BY 1""")
def evidence_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How concentrated each concept's active evidence is."""
    bins = _held(spark, sf_dir).filter("state = 'active'").groupBy("handle", "source", "source_id").agg(F.sum("touch_count").alias("w"))
    return concepts.histogram_specificity(bins)


@query(STORE_CTE + """, st AS (SELECT handle, arg_max(CASE kind WHEN 'operator_selected' THEN 'active' WHEN 'recall_fault' THEN 'rejected' ELSE 'candidate' END, seq) AS status, max(seq) AS seq FROM ce GROUP BY 1),
p AS (SELECT handle, count(*) AS pieces FROM ea WHERE state = 'active' GROUP BY 1), t AS (SELECT handle, max(touch_count) AS touches FROM al GROUP BY 1)
SELECT handle, coalesce(pieces, 0) AS pieces, coalesce(touches, 0) AS touches FROM st LEFT JOIN p USING (handle) LEFT JOIN t USING (handle) WHERE status = 'candidate' AND (coalesce(pieces, 0) >= 2 OR coalesce(touches, 0) >= 3)""")
def reflect_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose evidence or aliases are enough."""
    status = F.when(F.col("kind") == "operator_selected", "active").when(F.col("kind") == "recall_fault", "rejected").otherwise("candidate")
    now = concepts.latest(_store(spark, sf_dir).withColumn("status", status), ["handle"], "status")
    return concepts.promotable(now, _held(spark, sf_dir), _aliases(spark, sf_dir)).select("handle", "pieces", "touches")


MERGE_CTE = GRAPH_CTE + """, mg AS (SELECT DISTINCT 'c' || k AS handle, 'c' || CASE WHEN k = 90 THEN 91 WHEN k = 91 THEN 90 ELSE k - 1 END AS up FROM e WHERE k % 10 IN (6, 7) OR k IN (90, 91)),
mi AS (SELECT m.handle, coalesce(n.up, m.up) AS fin FROM mg m LEFT JOIN mg n ON n.handle = m.up WHERE m.handle NOT IN ('c90', 'c91')),
mc AS (SELECT coalesce(x.fin, a) AS a, coalesce(y.fin, b) AS b, confidence, touch_count FROM c LEFT JOIN mi x ON x.handle = a LEFT JOIN mi y ON y.handle = b)
"""


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _log(spark, sf_dir).select("k").distinct()
    into = F.when(F.col("k") == 90, 91).when(F.col("k") == 91, 90).when((F.col("k") % 10).isin(6, 7), F.col("k") - 1)
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    return keys.select(name(F.col("k")).alias("handle"), name(into).alias("merged_into"))


@query(MERGE_CTE + "SELECT a, b, round(max(confidence), 6) AS confidence, sum(touch_count)::BIGINT AS touch_count FROM mc WHERE a <> b GROUP BY 1, 2")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after merges: doubles become one, loops go, a cycle of merges moves nothing."""
    out = concepts.repointed_edges(_edges(spark, sf_dir), concepts.merged_keys(_merges(spark, sf_dir)))
    return out.select("a", "b", F.round("confidence", 6).alias("confidence"), "touch_count")


@query(MERGE_CTE + """, al AS (SELECT 'c' || k AS handle, handle AS alias, count(*) AS n FROM e GROUP BY 1, 2), u AS (SELECT coalesce(fin, al.handle) AS handle, alias, n FROM al LEFT JOIN mi USING (handle) UNION ALL SELECT fin, handle, 0 FROM mi)
SELECT handle, alias, sum(n)::BIGINT AS touch_count FROM u GROUP BY 1, 2""")
def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases after merges, the merged names among them."""
    return concepts.repointed_aliases(_aliases(spark, sf_dir), concepts.merged_keys(_merges(spark, sf_dir)))


@query(MERGE_CTE + """, f AS (SELECT '' AS project, 'c' || k AS name, 'c' || k AS handle, 0 AS tier FROM (SELECT DISTINCT k FROM e) UNION ALL SELECT DISTINCT handle, 'a' || (k // 2), 'c' || k, 1 FROM e WHERE k % 2 = 1),
w AS (SELECT DISTINCT handle AS project, 'a' || (k // 2) AS name FROM e UNION SELECT DISTINCT handle, 'c' || k FROM e),
r AS (SELECT project, name, arg_min(handle, (tier, scope, handle)) AS handle FROM (SELECT w.*, f.handle, f.tier, 0 AS scope FROM w JOIN f USING (project, name) UNION ALL SELECT w.*, f.handle, f.tier, 1 FROM w JOIN f USING (name) WHERE f.project = '') GROUP BY 1, 2)
SELECT project, name, coalesce(fin, r.handle) AS handle FROM r LEFT JOIN mi ON mi.handle = r.handle WHERE coalesce(fin, r.handle) NOT IN ('c90', 'c91')""")
def concept_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to handles: handle before alias, merges followed, cycles without an end left out."""
    log = _log(spark, sf_dir)
    c = lambda k: F.concat(F.lit("c"), k.cast("string"))
    alias = F.concat(F.lit("a"), F.floor(F.col("k") / 2).cast("string"))
    held = _merges(spark, sf_dir).withColumn("project", F.lit(""))
    other = log.filter("k % 2 = 1").select(F.col("handle").alias("project"), alias.alias("alias"), c(F.col("k")).alias("handle")).distinct()
    names = log.select(F.col("handle").alias("project"), alias.alias("name")).union(log.select("handle", c(F.col("k")))).distinct()
    return graph.resolve(names, held, other)


@query(GRAPH_CTE + "SELECT a, b, w, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS place FROM c) WHERE place <= 5")
def directed_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest edges out of each handle."""
    return concepts.ranked_neighbours(_edges(spark, sf_dir)).filter("place <= 5").select("a", "b", "w", "place")


@query(GRAPH_CTE + "SELECT least(a, b) AS low, greatest(a, b) AS high, count(*) AS directions, sum(touch_count)::BIGINT AS touches, max(w) AS w FROM c GROUP BY 1, 2")
def edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of either orientation, by unordered pair."""
    rows = concepts.between(_edges(spark, sf_dir))
    return rows.groupBy("low", "high").agg(F.count(F.lit(1)).alias("directions"), F.sum("touch_count").alias("touches"), F.max("w").alias("w"))


@query(GRAPH_CTE + """, l AS (SELECT a, b, touch_count, last_micros, row_number() OVER (ORDER BY touch_count DESC, a, b) AS place FROM c)
SELECT a, b, touch_count, place FROM l WHERE place <= 50""")
def edge_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most touched edges, both ends by name."""
    top = _edges(spark, sf_dir).orderBy(F.desc("touch_count"), "a", "b").limit(50)
    return top.select("a", "b", "touch_count", F.row_number().over(Window.orderBy(F.desc("touch_count"), "a", "b")).cast("long").alias("place"))


NEAR_CTE = ANCHOR_CTE + """, pr AS (SELECT x.project AS handle, y.project AS other, round(list_cosine_similarity(x.mean, y.mean), 6) AS cosine FROM an x JOIN an y ON x.project <> y.project),
nk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY cosine DESC, other) AS nth FROM pr WHERE cosine >= 0.35)),
sd AS (SELECT project AS handle, round(count(*) / max(count(*)) OVER (), 9) AS activation FROM r WHERE project <> '' GROUP BY 1)
"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _anchors(spark, sf_dir)
    found = ledger.anchor_matches(a.selectExpr("project AS id", "mean AS v"), a.selectExpr("project AS anchor", "mean AS v"), 0.3)
    return found.filter("anchor <> id").select(F.col("anchor").alias("handle"), F.col("id").alias("other"), "cosine")


@query(NEAR_CTE + "SELECT other AS handle, max(round(activation * cosine * 0.5, 9)) AS activation FROM sd JOIN nk USING (handle) WHERE nth <= 8 GROUP BY 1")
def latent_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation passed to the nearest concepts by likeness alone."""
    counts = _signal_rows(spark, sf_dir).filter("project <> ''").groupBy(F.col("project").alias("handle")).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 1
    return concepts.latent_lift(counts.select("handle", F.round(F.col("n") / F.lit(most), 9).alias("activation")), _near(spark, sf_dir))


@query(NEAR_CTE + """, kn AS (SELECT DISTINCT least(x.project, y.project) AS a, greatest(x.project, y.project) AS b FROM (SELECT DISTINCT project, snippet FROM candidate_vectors WHERE project IS NOT NULL AND snippet LIKE '%commit%') x JOIN (SELECT DISTINCT project, snippet FROM candidate_vectors WHERE project IS NOT NULL AND snippet LIKE '%commit%') y ON x.snippet = y.snippet AND x.project <> y.project)
SELECT least(handle, other) AS a, greatest(handle, other) AS b, max(cosine) AS cosine FROM nk WHERE nth <= 4 AND (least(handle, other), greatest(handle, other)) NOT IN (SELECT (a, b) FROM kn) GROUP BY 1, 2""")
def latent_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close pairs of concepts that share no text about commits: new weak edges."""
    shared = table(spark, sf_dir, "candidate_vectors").filter("project is not null and snippet like '%commit%'").select("project", "snippet").distinct()
    known = concepts.pairs_with(shared.select(F.col("snippet").alias("group"), F.col("project").alias("handle"), F.lit(0).alias("place")), cap=10_000)
    return concepts.latent_edges(_near(spark, sf_dir), known.select("a", "b")).select("a", "b", "cosine")


@query("""WITH pc AS (SELECT query_id, chunk_id AS id, max(CASE WHEN bm25_score IS NULL OR isnan(bm25_score) OR bm25_score = 0 THEN NULL ELSE bm25_score::DOUBLE END) AS s FROM candidates WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS place FROM pc WHERE s IS NOT NULL),
f AS (SELECT query_id, regexp_replace(regexp_extract(source_id, '([^/]+)$', 1), '\\.[^.]*$', '') AS handle, min(place) AS place FROM h JOIN (SELECT DISTINCT chunk_id AS id, source_id FROM ingest_chunks) USING (id) WHERE place <= 60 GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, handle) AS nth FROM f) WHERE nth <= 8)
SELECT x.handle AS a, y.handle AS b, count(*) AS touch_count FROM t x JOIN t y ON x.query_id = y.query_id AND x.handle < y.handle GROUP BY 1, 2""".replace("\\\\", "\\"))
def recall_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the files that are hit together, the first eight of a query."""
    files = table(spark, sf_dir, "ingest_chunks").select(F.col("chunk_id").alias("id"), text.path_stem(F.col("source_id")).alias("handle")).distinct()
    hits = _lanes(spark, sf_dir)["bm25"].join(files, "id").select(F.col("query_id").alias("group"), "handle", F.col("lane_rank").alias("place"))
    return concepts.pairs_with(hits).select("a", "b", "touch_count")


GAZ_CTE = """WITH f AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(symbol_name), '_[0-9]+$', ''), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS form FROM emits), t AS (SELECT row_id, conv_uuid, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS norm FROM chat_messages WHERE text IS NOT NULL),
g AS (SELECT DISTINCT row_id, conv_uuid, form FROM t JOIN f ON contains(norm, ' ' || form || ' '))
""".replace("\\\\", "\\")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "chat_messages").filter("text is not null")
    forms = table(spark, sf_dir, "emits").select(text.normalize(F.regexp_replace("symbol_name", "_[0-9]+$", "")).alias("form"))
    found = graph.gazetteer(chats.select(F.col("row_id").alias("id"), text.normalize(F.col("text")).alias("norm")), forms)
    return found.join(chats.select(F.col("row_id").alias("id"), "conv_uuid"), "id")


@query(GAZ_CTE + "SELECT conv_uuid AS doc, form AS concept, count(*) AS touches FROM g GROUP BY 1, 2")
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a conversation to the concepts it mentions."""
    return _mentions(spark, sf_dir).groupBy(F.col("conv_uuid").alias("doc"), F.col("form").alias("concept")).agg(F.count(F.lit(1)).alias("touches"))


@query(GAZ_CTE + """, u AS (SELECT DISTINCT conv_uuid, form FROM g), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_uuid ORDER BY form) AS nth FROM u) WHERE nth <= 8)
SELECT x.form AS a, y.form AS b, count(*) AS turns, 'co_occurs' AS kind FROM k x JOIN k y ON x.conv_uuid = y.conv_uuid AND x.form < y.form GROUP BY 1, 2
UNION ALL SELECT form, NULL, count(DISTINCT conv_uuid), 'proposed' FROM u GROUP BY 1 HAVING count(DISTINCT conv_uuid) >= 3""")
def cooccurrence_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between concepts of one conversation, and those that keep coming back."""
    hits = _mentions(spark, sf_dir).select(F.col("conv_uuid").alias("group"), F.col("form").alias("handle"), F.lit(0).alias("place"))
    pairs = concepts.pairs_with(hits, "co_occurs").select("a", "b", F.col("touch_count").alias("turns"), F.lit("co_occurs").alias("kind"))
    again = concepts.recurring(hits).select(F.col("handle").alias("a"), F.lit(None).cast("string").alias("b"), "turns", F.lit("proposed").alias("kind"))
    return pairs.unionByName(again)


@query("""WITH x AS (SELECT emit_id, regexp_replace(regexp_extract(source_id, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem, regexp_extract(symbol_name, '([^.:]+)$', 1) AS tail, split_part(body, chr(10), 1) AS head FROM emits),
y AS (SELECT emit_id, list_concat(list_filter([CASE WHEN lower(stem) NOT IN ('index', 'init', 'lib', 'main', 'mod', 'readme') THEN lower(regexp_replace(stem, '[^A-Za-z0-9_]+', '-', 'g')) END, lower(regexp_replace(tail, '[^A-Za-z0-9_]+', '-', 'g'))], lambda t: t IS NOT NULL AND t <> ''),
  list_filter(regexp_extract_all(lower(head), '[a-z][a-z0-9_]{3,}'), lambda w: w NOT IN ('that', 'with', 'from'))) AS l FROM x)
SELECT emit_id, t AS term, min(i) AS first FROM (SELECT emit_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM y) GROUP BY 1, 2""".replace("\\\\", "\\"))
def term_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each symbol from its path, its name and its first line."""
    rows = table(spark, sf_dir, "emits")
    head = F.regexp_replace(F.split("body", "\n")[0], "[\"`]", " ")
    stop = ("that", "with", "from")
    found = rows.select("emit_id", concepts.terms(F.col("source_id"), F.col("symbol_name"), head, stop).alias("terms"), head.alias("head"), "source_id", "symbol_name")
    # Places are those in the list with repeats, as first occurrence wins.
    words = F.filter(F.regexp_extract_all(F.lower("head"), F.lit("[a-z][a-z0-9_]{3,}"), 0), lambda w: ~w.isin(*stop))
    stem, tail = text.path_stem(F.col("source_id")), F.regexp_extract("symbol_name", "([^.:]+)$", 1)
    both = F.filter(F.array(F.when(~F.lower(stem).isin(*concepts.STRUCTURAL), F.lower(F.regexp_replace(stem, "[^A-Za-z0-9_]+", "-"))), F.lower(F.regexp_replace(tail, "[^A-Za-z0-9_]+", "-"))), lambda t: t.isNotNull() & (t != ""))
    whole = F.concat(both, words)
    return found.withColumn("whole", whole).select("emit_id", "whole", F.explode("terms").alias("term")).select("emit_id", "term", F.array_position("whole", F.col("term")).alias("first"))


@query(ACT_CTE + """, al AS (SELECT 'c' || k AS handle, handle AS alias, count(*) AS n FROM e GROUP BY 1, 2), aa AS (SELECT handle, string_agg(alias, ' ' ORDER BY n DESC, alias) AS aliases FROM al GROUP BY 1),
oo AS (SELECT a AS handle, string_agg(b, ' ' ORDER BY w DESC, b) AS outs FROM c GROUP BY 1), ii AS (SELECT b AS handle, string_agg(a, ' ' ORDER BY w DESC, a) AS ins FROM c GROUP BY 1),
nn AS (SELECT 'c' || k AS handle, arg_max(value, event_id) AS note FROM e WHERE kind = 'operator_selected' GROUP BY 1), vv AS (SELECT handle, count(*) AS evidence FROM (SELECT DISTINCT 'c' || k AS handle, kind, handle AS u FROM e) GROUP BY 1)
SELECT handle, aliases, evidence, coalesce(outs, '') AS outs, coalesce(ins, '') AS ins, note, activation FROM aa LEFT JOIN oo USING (handle) LEFT JOIN ii USING (handle) LEFT JOIN nn USING (handle) LEFT JOIN vv USING (handle) LEFT JOIN act USING (handle)""")
def concept_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything known of each concept in one row."""
    rows = _store(spark, sf_dir)
    notes = rows.filter("kind = 'operator_selected'").select("handle", F.col("value").alias("note"), "seq")
    out = concepts.cards(rows.select("handle").distinct(), _aliases(spark, sf_dir), _held(spark, sf_dir), _edges(spark, sf_dir), notes, _activation(spark, sf_dir).select("handle", "activation"))
    joined = lambda c: F.array_join(c, " ")
    return out.select("handle", joined("aliases").alias("aliases"), "evidence", joined("out").alias("outs"), joined("into").alias("ins"), "note", "activation")


@query("""WITH ev AS (SELECT DISTINCT source, chunk_id AS pointer, nullif(content_sha256, '') AS sha, CASE WHEN chunk_index % 9 = 0 THEN 'orphaned' ELSE 'active' END AS state FROM ingest_chunks),
lv AS (SELECT chunk_id AS id, min(sha256(coalesce(snippet, ''))) AS sha FROM candidate_vectors WHERE NOT stale GROUP BY 1)
SELECT source, pointer, coalesce(ev.sha, lv.sha) AS sha, CASE WHEN lv.sha IS NULL THEN 'orphaned' WHEN ev.sha IS NOT NULL AND ev.sha <> lv.sha THEN 'moved' ELSE 'active' END AS state FROM ev LEFT JOIN lv ON id = pointer WHERE state <> 'orphaned'""".replace("WHERE state <>", "WHERE ev.state <>"))
def evidence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence after a look at the live chunks; orphans are not looked at again."""
    rows = table(spark, sf_dir, "ingest_chunks")
    state = F.when(F.col("chunk_index") % 9 == 0, "orphaned").otherwise("active")
    ev = rows.select("source", F.col("chunk_id").alias("pointer"), F.nullif(F.col("content_sha256"), F.lit("")).alias("sha"), state.alias("state")).distinct()
    live = table(spark, sf_dir, "candidate_vectors").filter("not stale").groupBy(F.col("chunk_id").alias("id")).agg(F.min(F.sha2(F.coalesce("snippet", F.lit("")), 256)).alias("sha"))
    return concepts.resolution(ev, live).select("source", "pointer", "sha", "state")


# ================================================================== the thread ledger ==


@query(LOG_CTE + """, x AS (SELECT handle AS thread, k AS path, kind AS category, kind = 'recall_fault' AS removes, event_id AS seq FROM e),
g AS (SELECT *, max(CASE WHEN removes THEN seq END) OVER (PARTITION BY thread, path) AS gone FROM x)
SELECT thread, path, category, count(*) AS touches, min(seq) AS first, max(seq) AS last FROM g WHERE NOT removes AND (gone IS NULL OR seq > gone) GROUP BY 1, 2, 3""")
def thread_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each thread after its removals."""
    return threads.live_evidence(_thread_events(spark, sf_dir))


def _thread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select(F.col("handle").alias("thread"), F.col("k").alias("path"), F.col("kind").alias("category"), (F.col("kind") == "recall_fault").alias("removes"), F.col("event_id").alias("seq"))


@query(LOG_CTE + """, rn AS (SELECT DISTINCT handle AS old, 'u' || (substr(handle, 2)::INT - 1) AS new FROM e WHERE substr(handle, 2)::INT % 10 = 3),
l AS (SELECT coalesce(x.new, handle) AS a, coalesce(y.new, 'u' || k) AS b, kind AS category FROM e LEFT JOIN rn x ON x.old = handle LEFT JOIN rn y ON y.old = 'u' || k)
SELECT a, b, category, count(*) AS touches FROM l WHERE a <> b GROUP BY 1, 2, 3""")
def thread_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between threads after renames."""
    log = _log(spark, sf_dir)
    number = F.substring("handle", 2, 9).cast("int")
    renamed = log.filter(number % 10 == 3).select(F.col("handle").alias("old"), F.concat(F.lit("u"), (number - 1).cast("string")).alias("new")).distinct()
    links = log.select(F.col("handle").alias("a"), F.concat(F.lit("u"), F.col("k").cast("string")).alias("b"), F.col("kind").alias("category"))
    return threads.linked(links, renamed)


@query("""WITH r AS (SELECT handle, members::BIGINT AS members, CASE WHEN isnan(cohesion) THEN NULL ELSE cohesion::DOUBLE END AS cohesion, epoch_us(surfaced_at) AS m FROM emergent_reports), n AS (SELECT max(m) AS now FROM r),
f AS (SELECT handle, arg_min((members, cohesion), (m, members)) AS x, min(m) AS m FROM r GROUP BY 1)
SELECT handle, x[1] AS members, round(x[2], 6) AS cohesion, coalesce(x[1], 0) >= 5 AND coalesce(x[2] >= 0.9, false) AS promoted FROM f, n WHERE (coalesce(x[1], 0) >= 5 AND coalesce(x[2] >= 0.9, false)) OR m >= now - 14 * 86400000000""")
def thread_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals that stand: promoted ones, and others while they are new."""
    r = table(spark, sf_dir, "emergent_reports").select("handle", F.col("members").cast("long").alias("members"), F.when(~F.isnan("cohesion"), F.col("cohesion").cast("double")).alias("cohesion"), F.unix_micros("surfaced_at").alias("micros"))
    now = r.agg(F.max("micros")).first()[0] or 0
    return threads.proposals(r, F.lit(now)).select("handle", "members", F.round("cohesion", 6).alias("cohesion"), "promoted")


@query(LOG_CTE + """, x AS (SELECT handle, k, kind, count(*) AS touches, max(value) / 50 AS sim, (any_value(now) - min(m)) / 8.64e10 AS age, (any_value(now) - max(m)) / 8.64e10 AS idle FROM e, n GROUP BY 1, 2, 3), y AS (SELECT *, least(1.0, (touches - 1) / 8.0) AS ramp, least(1.0, greatest(0.0, sim)) AS s FROM x)
SELECT handle, k, kind, round((0.1 + 0.9 * ramp) * exp(-(0.08 - 0.07 * ramp) * idle) * s * (1 + CASE WHEN s >= 0.7 THEN 0.5 * least(1.0, ln(1 + age) / ln(366.0)) ELSE 0 END), 6) AS activation FROM y""")
def edge_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation of evidence edges from likeness, age, idleness and touches."""
    days = lambda c: (F.max("now") - c) / 8.64e10
    rows = _log(spark, sf_dir).groupBy("handle", "k", "kind").agg(F.count(F.lit(1)).alias("touches"), (F.max("value") / 50).alias("sim"), days(F.min("m")).alias("age"), days(F.max("m")).alias("idle"))
    return rows.select("handle", "k", "kind", F.round(threads.edge_activation(F.col("sim"), F.col("age"), F.col("idle"), F.col("touches")), 6).alias("activation"))


@query(THREAD_CTE + """, b AS (SELECT handle, max(round(score, 6)) AS score, resonance <= 5 AND cohesion >= 0.3 AND members < 5 AS bridge FROM sc GROUP BY handle, resonance, cohesion, members),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, handle) AS place FROM b WHERE score >= 0.1), f AS (SELECT min(place) AS first FROM o WHERE bridge)
SELECT handle, score, bridge, least(place, 4) AS place FROM o, f WHERE CASE WHEN first > 4 THEN place < 4 OR place = first ELSE place <= 4 END""")
def thread_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four threads, the last place kept for the best bridge."""
    t = _threads(spark, sf_dir)
    bridge = (F.col("resonance") <= 5) & (F.col("cohesion") >= 0.3) & (F.col("members") < 5)
    return threads.surface(t.select("handle", F.round("score", 6).alias("score"), bridge.alias("bridge")), 4)


@query(THREAD_CTE + """, p AS (SELECT handle, row_number() OVER (ORDER BY round(score, 6) DESC, handle) AS place FROM sc WHERE project <> ''), a AS (SELECT handle, round(score, 6) AS score FROM sc),
f AS (SELECT * FROM p WHERE place <= 6), r AS (SELECT handle, row_number() OVER (ORDER BY score DESC, handle) + (SELECT count(*) FROM f) AS place FROM a WHERE handle NOT IN (SELECT handle FROM f))
SELECT handle, place, true AS pinned FROM f UNION ALL SELECT handle, place, false FROM r WHERE place <= 8""")
def pinned_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight pages under a pin, two of them ambient."""
    t = _threads(spark, sf_dir).select("handle", "project", F.round("score", 6).alias("score"))
    out = threads.pinned_pages(t.filter("project <> ''").drop("project"), t.drop("project"), 8)
    return out.select("handle", F.col("place").cast("long").alias("place"), "pinned")


@query(LOG_CTE + """, l AS (SELECT handle, k, kind, max(m) AS m FROM e WHERE kind NOT IN ('lens_included', 'focus') GROUP BY 1, 2, 3), u AS (SELECT handle, round(sum(weight * ln(1 + power(greatest(1.0, (now - m) / 3.6e9), -0.5))) / (1 + sum(weight * ln(1 + power(greatest(1.0, (now - m) / 3.6e9), -0.5)))), 9) AS value_use FROM l JOIN wt USING (kind), n GROUP BY 1),
j AS (SELECT handle, sum(value) / 1000 AS s FROM e WHERE kind = 'operator_selected' GROUP BY 1), h AS (SELECT DISTINCT handle FROM e)
SELECT handle, coalesce(value_use, 0) AS value_use, round(0.5 + 0.5 * least(1, greatest(0, 0.5 * coalesce(value_use, 0) + 0.5 * CASE WHEN s > 0 THEN 1 - exp(-s) ELSE 0 END)), 6) AS value FROM h LEFT JOIN u USING (handle) LEFT JOIN j USING (handle)""")
def value_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What use and judgment raise each handle's value to, from a neutral half."""
    log = _log(spark, sf_dir)
    used = log.filter("kind not in ('lens_included', 'focus')").select("handle", F.col("k").alias("query_key"), "kind", F.col("m").alias("micros"), "now")
    judged = log.filter("kind = 'operator_selected'").groupBy("handle").agg((F.sum("value") / 1000).alias("s"))
    rows = log.select("handle").distinct().join(threads.value_use(used, F.col("now")), "handle", "left").join(judged, "handle", "left")
    value = threads.value_factor(F.col("value_use"), F.coalesce("s", F.lit(0.0)), neutral=0.5)
    return rows.select("handle", F.coalesce("value_use", F.lit(0.0)).alias("value_use"), F.round(value, 6).alias("value"))


CENTRED_CTE = ANCHOR_CTE + """, un AS (SELECT project, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) AS u FROM an), gm AS (SELECT list(a ORDER BY i) AS g FROM (SELECT i, avg(u[i]) AS a FROM (SELECT unnest(range(1, 65)) AS i, u FROM un) GROUP BY i)),
ct AS (SELECT project, list_transform(list_zip(u, g), lambda z: z[1] - z[2]) AS v FROM un, gm), bad AS (SELECT * FROM ct WHERE project LIKE '%cursor')
"""


@query(CENTRED_CTE + """, p AS (SELECT ct.project, round(list_cosine_similarity(ct.v, bad.v), 6) AS c, row_number() OVER (PARTITION BY ct.project ORDER BY round(list_cosine_similarity(ct.v, bad.v), 6) DESC, bad.project) AS nth FROM ct JOIN bad ON ct.project <> bad.project)
SELECT project, round(least(1, greatest(0, (avg(c) - 0.1) / 0.9)), 6) AS penalty FROM p WHERE nth <= 3 GROUP BY 1""")
def negative_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How close each anchor is to rejected ones once the common direction is taken out."""
    anchors = _anchors(spark, sf_dir).select(F.col("project").alias("id"), F.col("mean").alias("v"))
    return threads.negative_penalty(anchors, anchors.filter("id like '%cursor'"), 64, tau=0.1).withColumnRenamed("id", "project")


@query(CENTRED_CTE + """, sx AS (SELECT r.project, count(DISTINCT r.chunk_id) AS w FROM r WHERE NOT stale AND project <> '' GROUP BY 1), p AS (SELECT ct.project, round(list_cosine_similarity(ct.v, bad.v), 6) AS c, row_number() OVER (PARTITION BY ct.project ORDER BY round(list_cosine_similarity(ct.v, bad.v), 6) DESC, bad.project) AS nth FROM ct JOIN bad ON ct.project <> bad.project),
q AS (SELECT project, round(least(1, greatest(0, (avg(c) - 0.1) / 0.9)), 6) AS penalty FROM p WHERE nth <= 3 GROUP BY 1)
SELECT project, round((1 - least(1, w / 100.0)) * (1 - 0.8 * coalesce(penalty, 0)), 6) AS salience FROM sx LEFT JOIN q USING (project)""")
def salience_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiplier of each project's handle, its spread standing for specificity."""
    live = _signal_rows(spark, sf_dir).filter("not stale and project <> ''").groupBy("project").agg(F.countDistinct("chunk_id").alias("w"))
    rows = live.join(negative_transfer(spark, sf_dir), "project", "left")
    return rows.select("project", F.round(threads.salience(1 - F.least(F.lit(1.0), F.col("w") / 100.0), F.lit(1.0), F.col("penalty")), 6).alias("salience"))


@query(ANCHOR_CTE + """, ma AS (SELECT vec_id AS id, an.project AS anchor, round(list_cosine_similarity(e, mean), 6) AS cosine FROM r JOIN an ON round(list_cosine_similarity(e, mean), 6) >= 0.3),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, anchor) AS nth FROM ma) WHERE nth <= 8)
SELECT x.anchor AS a, y.anchor AS b, count(*) AS chunks FROM t x JOIN t y ON x.id = y.id AND x.anchor < y.anchor GROUP BY 1, 2
UNION ALL SELECT anchor, NULL, count(*) FROM ma GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*) FROM r WHERE vec_id NOT IN (SELECT id FROM ma)""")
def weave_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors woven by common chunks, the links of each, and what no anchor matches."""
    rows = _signal_rows(spark, sf_dir).selectExpr("vec_id AS id", "v")
    found = cut(ledger.anchor_matches(rows, _anchors(spark, sf_dir).selectExpr("project AS anchor", "mean AS v"), 0.3))
    nothing = F.lit(None).cast("string")
    links = found.groupBy(F.col("anchor").alias("a")).agg(F.count(F.lit(1)).alias("chunks")).select("a", nothing.alias("b"), "chunks")
    alone = rows.join(found, "id", "left_anti").agg(F.count(F.lit(1)).alias("chunks")).select(nothing.alias("a"), nothing.alias("b"), "chunks")
    return threads.weaves(found).unionByName(links).unionByName(alone)


@query(LOG_CTE + """, x AS (SELECT handle AS key, event_id AS seq, CASE WHEN kind = 'operator_selected' THEN k END AS total FROM e), b AS (SELECT key, arg_max(total, seq) FILTER (total IS NOT NULL) AS base, max(seq) FILTER (total IS NOT NULL) AS at_ FROM x GROUP BY 1)
SELECT key, coalesce(max(base), 0) + count(*) FILTER (at_ IS NULL OR seq > at_) AS value FROM x JOIN b USING (key) GROUP BY 1""")
def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each thread, set anew by events that carry a total."""
    rows = _log(spark, sf_dir).select(F.col("handle").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("kind") == "operator_selected", F.col("k")).alias("total"))
    return threads.totals(rows)


@query(LOG_CTE + "SELECT handle AS key, round(exp(sum(ln(1 - value / 1000))), 6) AS fade FROM e WHERE value < 1000 GROUP BY 1")
def fade_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of each thread's fade factors."""
    return threads.faded(_log(spark, sf_dir).filter("value < 1000").select(F.col("handle").alias("key"), (1 - F.col("value") / 1000).alias("factor")))


@query(LOG_CTE + "SELECT handle AS scope, CASE WHEN arg_max(kind, event_id) = 'focus' THEN arg_max(k, event_id) END AS item, arg_max(kind, event_id) = 'focus' AS pinned FROM e WHERE kind IN ('focus', 'recall_fault') GROUP BY 1")
def focus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each scope has pinned, nothing after a clear."""
    rows = _log(spark, sf_dir).filter("kind in ('focus', 'recall_fault')")
    return threads.focus_state(rows.select(F.col("handle").alias("scope"), F.col("k").alias("item"), (F.col("kind") == "recall_fault").alias("clears"), F.col("event_id").alias("seq")))


@query(ANCHOR_CTE + "SELECT DISTINCT chunk_id, thread FROM (SELECT chunk_id, an.project AS thread FROM r JOIN an ON round(list_cosine_similarity(e, mean), 6) >= 0.5 UNION ALL SELECT chunk_id, project FROM candidate_vectors WHERE project IS NOT NULL)")
def threads_for_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of each chunk, by closeness to the anchor or by evidence."""
    rows = _signal_rows(spark, sf_dir)
    near = ledger.anchor_matches(rows.selectExpr("vec_id AS id", "v"), _anchors(spark, sf_dir).selectExpr("project AS anchor", "mean AS v"), 0.5)
    by_anchor = near.join(rows.selectExpr("vec_id AS id", "chunk_id"), "id").select("chunk_id", F.col("anchor").alias("thread"))
    by_hand = table(spark, sf_dir, "candidate_vectors").filter("project is not null").select("chunk_id", F.col("project").alias("thread"))
    return by_anchor.unionByName(by_hand).distinct()


@query("""SELECT doc_id, doc_kind FROM documents WHERE doc_kind <> 'minutes' OR project IS NOT DISTINCT FROM 'orrery'""")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents a scope may see: private kinds only its own."""
    docs = table(spark, sf_dir, "documents").withColumn("tier", F.when(F.col("doc_kind") == "minutes", "t0_private").otherwise("t1_shared")).withColumn("scope_key", F.col("project"))
    return threads.visible(docs.filter("doc_kind is not null"), "orrery").select("doc_id", "doc_kind")


@query(STORE_CTE + """, a AS (SELECT DISTINCT handle FROM ce WHERE kind = 'operator_selected' AND seq < 5000), b AS (SELECT handle, arg_max(kind, seq) AS kind FROM ce GROUP BY 1)
SELECT handle FROM a WHERE handle NOT IN (SELECT handle FROM b WHERE kind = 'operator_selected')""")
def forgotten_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles that were judged once and are no longer active."""
    rows = _store(spark, sf_dir)
    judged = rows.filter("kind = 'operator_selected' and seq < 5000").select("handle").distinct()
    active = concepts.latest(rows, ["handle"], "kind").filter("kind = 'operator_selected'")
    return judged.join(active, "handle", "left_anti")


@query(SIGNAL_CTE.replace("WITH r AS", "WITH RECURSIVE r AS") + """, sm AS (SELECT * FROM (SELECT vec_id AS id, e, row_number() OVER (ORDER BY m DESC NULLS LAST, vec_id) AS nth FROM r WHERE NOT stale) WHERE nth <= 500),
lk AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM sm x JOIN sm y ON x.id <> y.id AND round(list_cosine_similarity(x.e, y.e), 6) >= 0.82),
rc AS (SELECT id AS root, id AS node FROM sm UNION SELECT rc.root, lk.b FROM rc JOIN lk ON lk.a = rc.node), cp AS (SELECT node AS id, min(root) AS comp FROM rc GROUP BY 1),
mb AS (SELECT cp.id, comp FROM cp JOIN lk ON lk.a = cp.id GROUP BY 1, 2 HAVING count(*) >= 2), sz AS (SELECT comp FROM mb GROUP BY 1 HAVING count(*) >= 3),
pr AS (SELECT x.comp, x.id AS a, y.id AS b FROM mb x JOIN mb y ON x.comp = y.comp AND x.id <> y.id WHERE x.comp IN (SELECT comp FROM sz)),
ch AS (SELECT comp, avg(list_cosine_similarity(x.e, y.e)) AS cohesion FROM pr JOIN sm x ON x.id = a JOIN sm y ON y.id = b GROUP BY 1)
SELECT 'proposed-' || left(sha256(string_agg(mb.id || chr(10), '' ORDER BY mb.id::VARCHAR)), 8) AS handle, count(*) AS members, round(any_value(cohesion), 6) AS cohesion FROM mb JOIN ch USING (comp) GROUP BY mb.comp""")
def emergent_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of similar chunks in a sample of the newest, with a proposed name."""
    rows = threads.sample(_signal_rows(spark, sf_dir).withColumnRenamed("vec_id", "id"))
    return threads.components(rows.select("id", "v")).select("handle", "members", "cohesion")


# ===================================================================== the tool surface ==


@query("""SELECT 'source' AS what, source AS name, count(*) AS n, NULL::BIGINT AS micros FROM candidate_vectors GROUP BY 2 UNION ALL SELECT 'total', '', count(*), NULL FROM candidate_vectors
UNION ALL SELECT 'last_scan', '', NULL, epoch_us(max(upserted_at)) FROM ingest_chunks UNION ALL SELECT 'audit', project, NULL, epoch_us(max(ts)) FROM session_messages WHERE project IS NOT NULL GROUP BY project""")
def recall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the corpus, the last scan and the newest line of each project."""
    manifest = table(spark, sf_dir, "ingest_chunks").select(F.unix_micros("upserted_at").alias("micros"))
    audit = table(spark, sf_dir, "session_messages").select("project", F.unix_micros("ts").alias("micros"))
    return memory.stats(table(spark, sf_dir, "candidate_vectors").select("source"), manifest, audit)


@query(ACT_CTE + """, ss AS (SELECT 'c' || k AS handle, arg_max(CASE kind WHEN 'operator_selected' THEN 'active' WHEN 'recall_fault' THEN 'rejected' ELSE 'candidate' END, event_id) AS status FROM e GROUP BY 1),
vw AS (SELECT CASE status WHEN 'active' THEN 'concepts' ELSE 'open_loops' END AS view, handle, activation AS score FROM ss JOIN act USING (handle) WHERE status <> 'rejected'),
kk AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY score DESC, handle) AS place FROM vw), sv AS (SELECT handle, max(round(value / 100, 6)) AS score FROM e GROUP BY 1), so AS (SELECT handle, score, row_number() OVER (ORDER BY score DESC, handle) AS place FROM sv WHERE score >= 0.1)
SELECT view, handle, score, place FROM kk WHERE place <= 10 UNION ALL SELECT 'now', handle, score, place FROM so WHERE place <= 10""")
def memory_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the moment, active concepts and open loops."""
    scored = _log(spark, sf_dir).select("handle", F.round(F.col("value") / 100, 6).alias("score"), F.lit(False).alias("bridge"))
    status = F.when(F.col("kind") == "operator_selected", "active").when(F.col("kind") == "recall_fault", "rejected").otherwise("candidate")
    held = concepts.latest(_store(spark, sf_dir).withColumn("status", status), ["handle"], "status")
    return memory.surfaced(scored, held.select("handle", "status"), _activation(spark, sf_dir).select("handle", "activation"))


@query(THREAD_CTE + ANCHOR_CTE.replace("WITH r AS", ", r AS").replace("n AS (SELECT max(m) AS now FROM r)", "nn AS (SELECT max(m) AS now FROM r)") + """
SELECT 'bridge' AS stage, p.project AS a, q.project AS b FROM an p JOIN an q ON p.project < q.project WHERE round(list_cosine_similarity(p.mean, q.mean), 6) >= 0.5
UNION ALL SELECT 'promoted', handle, NULL FROM t WHERE members >= 5 AND cohesion >= 0.9
UNION ALL SELECT 'abstract', handle, NULL FROM t WHERE members >= 5 AND resonance >= 20
UNION ALL SELECT 'faded', handle, nx FROM (SELECT handle, CASE WHEN members >= 5 THEN 'active' ELSE 'slack' END AS st, CASE WHEN days >= 60 * (1 + least(resonance, 20) / 20.0) THEN 'dormant' WHEN days >= 14 * (1 + least(resonance, 20) / 20.0) AND members >= 5 THEN 'slack' ELSE CASE WHEN members >= 5 THEN 'active' ELSE 'slack' END END AS nx FROM t) WHERE nx <> st""")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of a consolidation that SQL states: all but the greedy merges."""
    anchors = _anchors(spark, sf_dir).select(F.col("project").alias("handle"), F.col("mean").alias("v"), F.lit(0).alias("resonance"), F.lit(0).cast("long").alias("micros"))
    t = _threads(spark, sf_dir).withColumn("state", F.when(F.col("members") >= 5, "active").otherwise("slack")).withColumnRenamed("days", "idle_days")
    stages = memory.consolidated(anchors, t.withColumnRenamed("m", "micros"), t, F.lit(0), bridge=0.5)
    none = F.lit(None).cast("string").alias("b")
    out = stages["bridges"].select(F.lit("bridge").alias("stage"), "a", "b")
    for name in ("promoted", "abstract"):
        out = out.unionByName(stages[name].select(F.lit(name).alias("stage"), F.col("handle").alias("a"), none))
    return out.unionByName(stages["faded"].select(F.lit("faded").alias("stage"), F.col("handle").alias("a"), F.col("next").alias("b")))
