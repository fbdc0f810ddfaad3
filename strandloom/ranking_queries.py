"""Queries of rank features, profiles, lenses and the whole recall chain, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import schema as S
from strandloom.functions import vec
from strandloom.operators import graph, ranking, retrieval
from strandloom.plans import recall
from strandloom.queries import ANCHOR_CTE, GRAPH_CTE, _anchors, _edges, _log, _signal_rows, _weight, query
from strandloom.session import table

# ============================================================ concepts and their activation ==

ACT_CTE = GRAPH_CTE + """,
acc AS (SELECT k, ln(1 + sum(weight * power(greatest(1, (now - m) // 3600000000), -0.5))) AS base FROM e JOIN wt USING (kind), n GROUP BY 1),
fo AS (SELECT k, min((now - m) / 3.6e9) AS h FROM e, n WHERE kind = 'focus' GROUP BY 1),
nt AS (SELECT k, min((now - m) / 3.6e9) AS h FROM e, n WHERE kind = 'operator_selected' GROUP BY 1),
li AS (SELECT handle, 1 - exp(-sum(confidence)) AS lift FROM (SELECT a AS handle, confidence FROM c UNION ALL SELECT b, confidence FROM c) GROUP BY 1),
act AS (SELECT 'c' || acc.k AS handle, acc.k, round(0.1 + 0.5 * base / (1 + base) + 0.3 * coalesce(exp(-fo.h / 24), 0) + 0.2 * coalesce(lift, 0) + 0.2 * coalesce(exp(-nt.h / 72), 0), 6) AS activation
  FROM acc LEFT JOIN fo ON fo.k = acc.k LEFT JOIN nt ON nt.k = acc.k LEFT JOIN li ON li.handle = 'c' || acc.k),
ev AS (SELECT DISTINCT chunk_index::BIGINT AS k, source, source_id, chunk_id FROM ingest_chunks),
sup AS (SELECT source, source_id, max(activation) AS value FROM act JOIN ev USING (k) GROUP BY 1, 2),
sd AS (SELECT 'all' AS seed, handle, least(1.0, activation) AS activation FROM (SELECT *, row_number() OVER (ORDER BY activation DESC, handle) AS nth FROM act) WHERE nth <= 16),
d1 AS (SELECT seed, to_ AS handle, max(round(activation * w * 0.5, 9)) AS activation FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY activation DESC, handle) AS nth FROM sd) WHERE nth <= 16) JOIN ud ON handle = at_ WHERE round(activation * w * 0.5, 9) >= 0.05 GROUP BY 1, 2),
d2 AS (SELECT seed, to_ AS handle, max(round(activation * w * 0.5, 9)) AS activation FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY activation DESC, handle) AS nth FROM d1) WHERE nth <= 16) JOIN ud ON handle = at_ WHERE round(activation * w * 0.5, 9) >= 0.05 GROUP BY 1, 2),
df AS (SELECT handle, max(activation) AS activation FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) WHERE handle NOT IN (SELECT handle FROM sd) GROUP BY 1),
lif AS (SELECT source, source_id, max(df.activation) AS value FROM df JOIN ev ON df.handle = 'c' || ev.k GROUP BY 1, 2)
"""


def _activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(handle, k, activation) of each key's concept, all parts from the log and the graph."""
    log = _log(spark, sf_dir)
    hours = vec.age_hours(F.col("now"), F.col("m"))
    fade = lambda kind, tau: F.coalesce(F.exp(-F.min(F.when(F.col("kind") == kind, hours)) / tau), F.lit(0.0))
    whole = F.floor((F.col("now") - F.col("m")) / 3_600_000_000)
    weight = F.when(F.col("kind") == "focus", F.lit(0.0)).otherwise(_weight())
    parts = log.groupBy("k").agg(graph.base_level(whole, weight).alias("base"), fade("focus", S.TAU_FOCUS_H).alias("focus"), fade("operator_selected", S.TAU_NOTE_H).alias("note"), F.max((F.col("kind") != "focus").cast("int")).alias("used"))
    parts = parts.filter("used = 1").withColumn("handle", F.concat(F.lit("c"), F.col("k").cast("string")))
    rows = parts.join(graph.edge_lift(_edges(spark, sf_dir), digits=12), "handle", "left")
    total = graph.activation(F.lit(0.1), F.col("base"), F.col("focus"), F.coalesce("edge_lift", F.lit(0.0)), F.col("note"))
    return rows.select("handle", "k", F.round(total, 6).alias("activation"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(handle, source, source_id, chunk_id): pieces whose index is a concept's key."""
    handle = F.concat(F.lit("c"), F.col("chunk_index").cast("string")).alias("handle")
    return table(spark, sf_dir, "ingest_chunks").select(handle, "source", "source_id", "chunk_id").distinct()


def _seeds(act: DataFrame) -> DataFrame:
    top = act.orderBy(F.desc("activation"), "handle").limit(S.FRONTIER)
    return top.select(F.lit("all").alias("seed"), "handle", F.least(F.lit(1.0), F.col("activation")).alias("activation"))


def _lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation that diffusion brings to handles that are no seeds."""
    seeds = _seeds(_activation(spark, sf_dir))
    reached = graph.diffuse(seeds, graph.undirected(_edges(spark, sf_dir)))
    return reached.join(seeds.select("handle"), "handle", "left_anti").groupBy("handle").agg(F.max("activation").alias("activation"))


@query(ACT_CTE + "SELECT handle, activation FROM act")
def concept_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, access, focus, edges and notes of each key's concept."""
    return _activation(spark, sf_dir).select("handle", "activation")


@query(ACT_CTE + "SELECT source, source_id, value, 'support' AS kind FROM sup UNION ALL SELECT source, source_id, value, 'lift' FROM lif")
def coordinate_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best concept activation and the best diffused one at each coordinate."""
    ev = _evidence(spark, sf_dir)
    here = graph.support_at(ev, _activation(spark, sf_dir)).withColumn("kind", F.lit("support"))
    return here.unionByName(graph.support_at(ev, _lifts(spark, sf_dir)).withColumn("kind", F.lit("lift")))


# ================================================================ the pool and its features ==

POOL_CTE = ACT_CTE + """,
pc AS (SELECT query_id, chunk_id AS id, max(CASE WHEN bm25_score IS NULL OR isnan(bm25_score) OR bm25_score = 0 THEN NULL ELSE bm25_score::DOUBLE END) AS bm25, min(CASE WHEN dense_distance IS NULL OR isnan(dense_distance) THEN NULL ELSE dense_distance::DOUBLE END) AS dense
  FROM candidates WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
bl AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) - 1 AS r FROM pc WHERE bm25 IS NOT NULL),
dl AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 6), id) - 1 AS r FROM pc WHERE dense IS NOT NULL),
po AS (SELECT * FROM (SELECT query_id, id FROM bl WHERE r < 60) UNION SELECT query_id, id FROM dl WHERE r < 60),
cv AS (SELECT chunk_id AS id, arg_min(list_transform(dense_embedding, lambda x: x::DOUBLE), vec_id) AS e FROM candidate_vectors
  WHERE dense_embedding IS NOT NULL AND len(dense_embedding) = 64 AND len(list_filter(dense_embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dense_embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
sc AS (SELECT po.query_id, arg_min(e, id) AS scope FROM po JOIN cv USING (id) GROUP BY 1),
ca AS (SELECT chunk_id AS id, epoch_us(fetched_at) AS m, CASE WHEN bm25_rank <= 1 THEN 'explicit_recall' WHEN bm25_rank <= 5 THEN 'recall_fault' ELSE 'lens_included' END AS kind FROM candidates WHERE chunk_id IS NOT NULL
  UNION ALL SELECT chunk_id, epoch_us(ts), 'creation' FROM candidate_vectors WHERE ts IS NOT NULL),
nw AS (SELECT max(m) FILTER (kind <> 'creation') AS t FROM ca),
cw AS (SELECT * FROM (VALUES ('creation', 1.0::DOUBLE), ('explicit_recall', 1.0), ('operator_selected', 1.0), ('recall_fault', 0.7), ('lens_included', 0.5)) v(kind, weight)),
fb AS (SELECT id, round(ln(1 + sum(weight * power(greatest(1, (t - m) // 3600000000), -0.5))), 9) AS base FROM ca JOIN cw USING (kind), nw WHERE m >= t - 2592000000000 AND m <= t GROUP BY 1),
co AS (SELECT DISTINCT chunk_id AS id, source, source_id FROM ingest_chunks),
cs AS (SELECT id, max(value) AS value FROM co JOIN sup USING (source, source_id) GROUP BY 1),
cl AS (SELECT id, max(value) AS value FROM co JOIN lif USING (source, source_id) GROUP BY 1),
raw AS (SELECT query_id, id, round(greatest(0, CASE WHEN e IS NULL THEN 0 ELSE list_cosine_similarity(e, scope) END), 9) AS attention,
    coalesce(base, 0) AS fresh, coalesce(round(cs.value, 9), 0) AS concept, coalesce(round(cl.value, 9), 0) AS relational
  FROM po LEFT JOIN cv USING (id) LEFT JOIN sc USING (query_id) LEFT JOIN fb USING (id) LEFT JOIN cs USING (id) LEFT JOIN cl USING (id)),
sca AS (SELECT query_id, id, attention,
    CASE WHEN max(fresh) OVER w > min(fresh) OVER w THEN round((fresh - min(fresh) OVER w) / (max(fresh) OVER w - min(fresh) OVER w), 9) ELSE 0.5 END AS fresh,
    CASE WHEN max(concept) OVER w > min(concept) OVER w THEN round((concept - min(concept) OVER w) / (max(concept) OVER w - min(concept) OVER w), 9) ELSE 0.0 END AS concept,
    CASE WHEN max(relational) OVER w > min(relational) OVER w THEN round((relational - min(relational) OVER w) / (max(relational) OVER w - min(relational) OVER w), 9) ELSE 0.0 END AS relational
  FROM raw WINDOW w AS (PARTITION BY query_id)),
tot AS (SELECT *, round(attention + round(0.5 * fresh, 9) + round(0.5 * concept, 9) + round(0.5 * relational, 9), 6) AS total FROM sca),
pen AS (SELECT id, round(0.5 * sum(exp(-((t - m) / 1e6) / 864000.0)), 6) AS penalty FROM ca, nw WHERE kind = 'lens_included' AND m >= t - 4320000000000 AND m <= t GROUP BY 1),
rk AS (SELECT tot.*, coalesce(penalty, 0) AS penalty, round(total - coalesce(penalty, 0), 6) AS rest FROM tot LEFT JOIN pen USING (id))
"""


def _lanes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = table(spark, sf_dir, "candidates").filter("query_id is not null and chunk_id is not null").withColumnRenamed("chunk_id", "id")
    clean = lambda x, zero: F.when(~(F.isnan(x) | ((F.col(x) == 0) if zero else F.lit(False))), F.col(x).cast("double"))
    one = c.groupBy("query_id", "id").agg(F.max(clean("bm25_score", True)).alias("bm25"), F.min(clean("dense_distance", False)).alias("dense"))
    lane = lambda name, up: retrieval.ranked(one.filter(F.col(name).isNotNull()).select("query_id", "id", F.round(name, 6).alias("score")), "score", 60, ascending=up)
    return {"bm25": lane("bm25", False), "dense": lane("dense", True)}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v): one usable vector of each chunk."""
    return _signal_rows(spark, sf_dir).groupBy(F.col("chunk_id").alias("id")).agg(F.min_by("v", "vec_id").alias("v"))


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").filter("chunk_id is not null")
    kind = F.when(F.col("bm25_rank") <= 1, "explicit_recall").when(F.col("bm25_rank") <= 5, "recall_fault").otherwise("lens_included")
    made = table(spark, sf_dir, "candidate_vectors").filter("ts is not null").select(F.col("chunk_id").alias("id"), F.unix_micros("ts").alias("micros"), F.lit("creation").alias("kind"))
    return c.select(F.col("chunk_id").alias("id"), F.unix_micros("fetched_at").alias("micros"), kind.alias("kind")).unionByName(made)


def _context(spark: SparkSession, sf_dir: str, pool: DataFrame) -> ranking.Context:
    vectors, accesses, ev = _vectors(spark, sf_dir), _accesses(spark, sf_dir), _evidence(spark, sf_dir)
    scopes = pool.join(vectors, "id").groupBy("query_id").agg(F.min_by("v", "id").alias("v"))
    at = table(spark, sf_dir, "ingest_chunks").select(F.col("chunk_id").alias("id"), "source", "source_id").distinct()
    by_id = lambda values: at.join(graph.support_at(ev, values), ["source", "source_id"]).groupBy("id").agg(F.max("value").alias("value"))
    now = accesses.filter("kind <> 'creation'").agg(F.max("micros")).first()[0] or 0
    return ranking.Context(now, scopes, vectors, accesses, by_id(_activation(spark, sf_dir)), by_id(_lifts(spark, sf_dir)))


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ranking.Context]:
    pool = retrieval.fuse(_lanes(spark, sf_dir)).select("query_id", "id")
    context = _context(spark, sf_dir, pool)
    ranked = ranking.rank_pool(pool, context, ranking.profile_weights("lens"))
    shown = context.accesses.filter("kind = 'lens_included'")
    return ranking.refractory(ranked, shown, context.now, tau_s=864_000.0), context


@query(POOL_CTE + "SELECT query_id, id, attention, fresh, concept, relational FROM sca")
def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four features of the lens over each query's candidates."""
    ranked, _ = _ranked(spark, sf_dir)
    names = {"attention": "attention_affinity", "fresh": "freshness", "concept": "concept_support", "relational": "relational_lift"}
    return ranked.select("query_id", "id", *[F.col(f"f_{n}").alias(k) for k, n in names.items()])


@query(POOL_CTE + "SELECT query_id, id, round(0.5 * fresh, 9) AS c_freshness, round(0.5 * concept, 9) AS c_concept, penalty, rest AS total, rest > 1.2e-7 AND attention / rest >= 0.3 AS attention_dominates FROM rk")
def lens_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the lens profile with contributions, what was shown lately counted off."""
    ranked, _ = _ranked(spark, sf_dir)
    rules = ranking.dominant(F.col("c_attention_affinity"), F.col("total")).alias("attention_dominates")
    return ranked.select("query_id", "id", F.col("c_freshness"), F.col("c_concept_support").alias("c_concept"), "penalty", "total", rules)


@query(POOL_CTE + "SELECT query_id, id, attention AS total, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(attention, 6) DESC, id) AS place FROM sca) WHERE place <= 10")
def ambient_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten candidates of each query closest to its scope."""
    pool = retrieval.fuse(_lanes(spark, sf_dir)).select("query_id", "id")
    ranked = ranking.rank_pool(pool, _context(spark, sf_dir, pool), ranking.profile_weights("ambient"))
    best = retrieval.diversify(ranked.withColumn("score", F.col("total")), "id", 0, 10)
    return best.select("query_id", "id", F.col("f_attention_affinity").alias("total"), "place")


@query()
def lens_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio slots over each query's ranked candidates; a text counts by its snippet."""
    ranked, context = _ranked(spark, sf_dir)
    texts = table(spark, sf_dir, "candidate_vectors").groupBy(F.col("chunk_id").alias("id")).agg(F.min(F.struct("vec_id", "snippet"))["snippet"].alias("snippet"))
    words = F.size(F.split(F.trim(F.coalesce("snippet", F.lit(""))), r"\s+"))
    rows = ranked.join(texts, "id", "left").join(context.vectors, "id", "left").withColumn("sha", F.sha2(F.coalesce("snippet", F.col("id")), 256)).withColumn("n_tokens", words)
    return ranking.allocate(rows, ranking.LensConfig(budget=24, least=3))


@query(POOL_CTE + """, mm AS (SELECT query_id, id, min(r) AS lane_rank FROM (SELECT * FROM bl WHERE r < 60 UNION ALL SELECT * FROM dl WHERE r < 12) GROUP BY 1, 2)
SELECT query_id, id, lane_rank, row_number() OVER (PARTITION BY query_id ORDER BY lane_rank, id) - 1 AS place FROM mm""")
def lane_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lane and a shorter extra one as one, each id by its smaller rank."""
    lanes = _lanes(spark, sf_dir)
    rows = ranking.merged_lane(lanes["bm25"], lanes["dense"].filter("lane_rank < 12"))
    place = F.row_number().over(ranking.Window.partitionBy("query_id").orderBy("lane_rank", "id")) - 1
    return rows.select("query_id", "id", "lane_rank", place.cast("long").alias("place"))


AMBIENT_CTE = ANCHOR_CTE + """, rv AS (SELECT chunk_id AS id, arg_min(e, vec_id) AS e FROM r GROUP BY 1),
am AS (SELECT an.project AS query_id, id, round(list_sum(list_transform(list_zip(e, mean), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS score FROM an, rv),
amb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) - 1 AS lane_rank FROM am) WHERE lane_rank < 32)
"""


def _ambient(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = _anchors(spark, sf_dir).selectExpr("project AS query_id", "mean AS v")
    return retrieval.dense_lane(_vectors(spark, sf_dir), "id", "v", scopes, "query_id", "v", S.LENS_K)


@query(AMBIENT_CTE + "SELECT query_id, id, score, lane_rank FROM amb")
def ambient_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks nearest to each scope's vector alone."""
    return _ambient(spark, sf_dir)


@query(AMBIENT_CTE + """, inj AS (SELECT DISTINCT project AS query_id, chunk_id AS id FROM r WHERE project IN (SELECT project FROM an) AND stale)
SELECT query_id, id, false AS injected FROM amb UNION ALL SELECT query_id, id, true FROM inj ANTI JOIN amb USING (query_id, id)""")
def relational_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambient candidates and, flagged, a scope's own stale chunks that they lack."""
    rows = _signal_rows(spark, sf_dir).filter("stale").select(F.col("project").alias("query_id"), F.col("chunk_id").alias("id"))
    more = rows.join(_anchors(spark, sf_dir).select(F.col("project").alias("query_id")), "query_id", "left_semi")
    return ranking.injected(_ambient(spark, sf_dir), more)


# ===================================================================== the whole recall chain ==

CHAIN_CTE = """
WITH ch AS (SELECT doc_id AS id, text, lower(trim(source)) AS source, coalesce(source_id, 'doc ' || doc_id) AS source_id, epoch_us(created_at) AS m, doc_kind = 'code' AS code, lower(trim(source)) = 'session-digests' AS membrane,
    coalesce(created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2026-03-01 00:00:00+00', false) AS fits FROM documents WHERE text IS NOT NULL),
nw AS (SELECT max(m) AS now FROM ch),
tx AS (SELECT 'e' || item_id AS query_id, passage AS text FROM eval_items UNION ALL SELECT DISTINCT 's' || regexp_replace(symbol_name, '_[0-9]+$', ''), regexp_replace(symbol_name, '_[0-9]+$', '') FROM emits),
t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ch),
p AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT id, count(*) AS dl FROM t GROUP BY 1),
a AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM l), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM tx),
s AS (SELECT query_id, p.id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN d USING (term) JOIN p USING (term) JOIN l ON l.id = p.id, a WHERE p.id IN (SELECT id FROM ch WHERE fits) GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS lane_rank FROM s) WHERE lane_rank < 60),
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
w AS (SELECT 'e' || x.vec_id AS query_id, y.vec_id AS id, code, round(list_sum(list_transform(list_zip(x.e, y.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS score
  FROM v x JOIN eval_items ON x.vec_id = item_id, v y JOIN ch ON ch.id = y.vec_id AND fits),
n1 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) - 1 AS lane_rank FROM w),
n2 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) - 1 AS lane_rank FROM w WHERE code),
n AS (SELECT query_id, id, arg_min(score, lane_rank) AS score, min(lane_rank) AS lane_rank FROM (SELECT * FROM n1 WHERE lane_rank < 60 UNION ALL SELECT * FROM n2 WHERE lane_rank < 12) GROUP BY 1, 2),
u AS (SELECT query_id, id, 'bm25' AS lane, score, lane_rank FROM b UNION ALL SELECT query_id, id, 'dense', score, lane_rank FROM n),
f AS (SELECT query_id, id, round(sum(1 / (60.0 + lane_rank)), 9) AS rrf, max(score) FILTER (lane = 'bm25') AS bm25 FROM u GROUP BY 1, 2),
g AS (SELECT query_id, id, round(round(least(1, rrf / (2.0 / 60)), 9) + 0.5 * round(coalesce(bm25 / (bm25 + 10), 0), 9), 6) AS score FROM f),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM g) WHERE nth <= 60),
"""
CHAIN_END = """
k AS (SELECT query_id, id, source, source_id, round(x.score
    + CASE WHEN code AND contains(lower(substr(ch.text, 1, 400)), lower(tx.text)) AND len(string_split_regex(trim(tx.text), '\\s+')) <= 3 AND (contains(tx.text, '_') OR regexp_matches(tx.text, '\\S*[^\\s][A-Z]') OR (len(string_split_regex(trim(tx.text), '\\s+')) = 1 AND regexp_matches(tx.text, '^[A-Za-z0-9]+$'))) THEN 3.0 ELSE 0.0 END
    - CASE WHEN membrane AND m IS NOT NULL THEN 2.0 * least(1, greatest(0, 1 - ((now - m) / 3.6e9) / 24)) ELSE 0.0 END, 6) AS score
  FROM x JOIN ch USING (id) JOIN tx USING (query_id), nw),
cc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, id) AS nth FROM k) WHERE nth <= 3)
SELECT query_id, place, id, score, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM cc) WHERE place <= 10
""".replace("\\\\", "\\")


def _chain(spark: SparkSession, sf_dir: str, rerank: bool, bias=None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    source = F.lower(F.trim("source"))
    chunks = docs.select(
        F.col("doc_id").alias("id"), "text", source.alias("source"), F.coalesce("source_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("source_id"),
        F.unix_micros("created_at").alias("micros"), (F.col("doc_kind") == "code").alias("code"), (source == "session-digests").alias("membrane"), F.col("created_at").alias("ts"),
    )
    stem = F.regexp_replace("symbol_name", "_[0-9]+$", "")
    symbols = table(spark, sf_dir, "emits").select(F.concat(F.lit("s"), stem).alias("query_id"), stem.alias("text")).distinct()
    items = table(spark, sf_dir, "eval_items").select(F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("query_id"), F.col("passage").alias("text"))
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("id")).join(stored, "id").select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("query_id"), "v")
    when = lambda s: F.lit(s).cast("timestamp")
    fits = F.coalesce((F.col("ts") >= when("2025-03-01 00:00:00+00:00")) & (F.col("ts") < when("2026-03-01 00:00:00+00:00")), F.lit(False))
    now = docs.agg(F.unix_micros(F.max("created_at"))).first()[0]
    return recall.full_recall(chunks, items.unionByName(symbols), stored, asked, {"rrf": 1.0, "bm25": 0.5}, fits, F.col("code"), now, rerank, bias)


@query(CHAIN_CTE + "x AS (SELECT query_id, id, score FROM h)," + CHAIN_END)
def recall_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: filter, lanes, code prefetch, fusion, boost, damping, cap per source file."""
    return _chain(spark, sf_dir, False).select("query_id", "place", "id", "score", "source")


@query(CHAIN_CTE + """qt AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM tx), dt AS (SELECT id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM ch),
x AS (SELECT query_id, id, round(len(list_intersect(a, t)) / greatest(1, len(a))::DOUBLE, 6) AS score FROM h JOIN qt USING (query_id) JOIN dt USING (id)),""" + CHAIN_END)
def recall_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with the reranker before boost and damping."""
    return _chain(spark, sf_dir, True).select("query_id", "place", "id", "score", "source")


@query(POOL_CTE + """, th AS (SELECT chunk_id AS id, max(value) AS thread FROM (SELECT chunk_id, chunk_index / 10.0 AS value FROM ingest_chunks) GROUP BY 1)
SELECT query_id, id, round(total + 0.4 * least(1, greatest(0, coalesce(thread, 0))) + 0.2 * greatest(0, attention), 6) AS biased FROM tot LEFT JOIN th USING (id)""")
def attention_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals plus the best thread score of a chunk and its closeness to the scope."""
    pool = retrieval.fuse(_lanes(spark, sf_dir)).select("query_id", "id")
    context = _context(spark, sf_dir, pool)
    hits = ranking.rank_pool(pool, context, ranking.profile_weights("lens")).select("query_id", "id", F.col("total").alias("score"))
    threads = table(spark, sf_dir, "ingest_chunks").select(F.col("chunk_id").alias("id"), (F.col("chunk_index") / 10.0).alias("score"))
    return ranking.attention_bias(hits, threads, context.scopes, context.vectors, 0.4, 0.2).select("query_id", "id", F.col("score").alias("biased"))
