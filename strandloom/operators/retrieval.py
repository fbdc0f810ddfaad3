"""Keyword lane, dense lane, fusion, ranking and caps for many queries at once.

Lanes return ids and scores only; rows are joined back at the end.  Scores are
rounded to 6 digits before they order anything, with the id as the tiebreak, so
that results do not depend on the order of partial sums.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.functions.text import tokens
from strandloom.operators.products import products

#: Most (query, term) rows that are broadcast.
QUERY_TERMS = 500_000


def postings(chunks: DataFrame, chunk_id: str, text: str) -> DataFrame:
    """(id, term, tf, dl): the inverted index, one row a term and chunk.

    The rows are partitioned by chunk, which grouping by chunk and term keeps,
    so that scoring needs no further shuffle.
    """
    rows = chunks.select(F.col(chunk_id).alias("id"), tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    rows = rows.repartition("id").select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def bm25_lane(index: DataFrame, queries: DataFrame, query_id: str, text: str, limit: int, k1: float = 1.2, b: float = 0.75, among: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, lane_rank): the best ``limit`` chunks of each query; rank from 0.

    ``among``: the ids that may be hits; statistics are those of the whole index.

    The terms of the queries are broadcast where their counted number allows,
    so that each chunk is scored where it lies; else both sides are shuffled.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    stats = index.groupBy("id").agg(F.max("dl").alias("dl")).agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    wanted = asked.select("term").distinct()
    df = index.join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.join(df, "term").crossJoin(stats)  # one row of statistics
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = terms.select("query_id", "term", idf.alias("idf"), "avgdl")
    if asked.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS:
        terms = F.broadcast(terms)
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    held = index if among is None else index.join(among, "id", "left_semi")
    scored = held.join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    return ranked(scored, "score", limit)


def ranked(scored: DataFrame, score: str, limit: int, ascending: bool = False) -> DataFrame:
    """Keep the best ``limit`` of each query and number them from 0."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return scored.withColumn("lane_rank", nth.cast("long") - 1).filter(F.col("lane_rank") < limit)


def dense_lane(chunks: DataFrame, chunk_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, limit: int, metric: str = "l2") -> DataFrame:
    """(query_id, id, score, lane_rank): exhaustive nearest chunks by squared
    distance (``l2``) or 1 - cosine (``cosine``), smallest first.

    A stated query set against all rows, in blocks (``products``); only the best
    of each batch of rows go on.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("v"))
    base = chunks.select(F.col(chunk_id).alias("id"), F.col(vector).alias("v"))
    return ranked(products(base, asked, metric, limit=limit), "score", limit, ascending=True)


def fuse(lanes: Mapping[str, DataFrame]) -> DataFrame:
    """Union of the lanes by id with each lane's score and the reciprocal rank sum."""
    rows = None
    for name, lane in lanes.items():
        one = lane.select("query_id", "id", F.lit(name).alias("lane"), "score", "lane_rank")
        rows = one if rows is None else rows.unionByName(one)
    of = lambda name: F.max(F.when(F.col("lane") == name, F.col("score"))).alias(name)
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(float(S.K_RRF)) + F.col("lane_rank"))), 9).alias("rrf"), *[of(n) for n in lanes])


def features(fused: DataFrame) -> DataFrame:
    """Features in [0, 1]: fused rank over its most, and the saturated keyword score."""
    rrf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rrf") / (2.0 / S.K_RRF)))
    bm25 = F.when(F.col("bm25").isNotNull(), F.col("bm25") / (F.col("bm25") + S.K_BM25)).otherwise(F.lit(0.0))
    return fused.withColumn("f_rrf", F.round(rrf, 9)).withColumn("f_bm25", F.round(bm25, 9))


def rank(rows: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``score``: the weighted sum of clamped features, with each contribution in a map."""
    parts = {n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(f"f_{n}"), F.lit(0.0)))) * F.lit(float(w)) for n, w in weights.items() if f"f_{n}" in rows.columns}
    total: Column = sum(parts.values(), F.lit(0.0))
    each = F.create_map(*[x for n, p in parts.items() for x in (F.lit(n), p)])
    return rows.withColumn("score", F.round(total, 6)).withColumn("match_features", each)


def identifier_query(text: Column) -> Column:
    """At most three tokens and one that looks like a name in code."""
    words = F.split(F.trim(text), r"\s+")
    return (F.size(words) <= 3) & (text.contains("_") | text.rlike(r"\S*[^\s][A-Z]") | ((F.size(words) == 1) & text.rlike("^[A-Za-z0-9]+$")))


def identifier_boost(score: Column, source: Column, text: Column, query: Column) -> Column:
    """Code chunks that hold an identifier query are lifted."""
    hit = identifier_query(query) & (source == "code") & F.contains(F.lower(text), F.lower(query))
    return score + F.when(hit, F.lit(S.IDENTIFIER_BOOST)).otherwise(F.lit(0.0))


def self_reference(score: Column, is_membrane: Column, age_h: Column) -> Column:
    """The penalty on the engine's own recent chunks fades over a day."""
    fade = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - age_h / S.SELF_WINDOW_H))
    return score - F.when(is_membrane & age_h.isNotNull(), S.SELF_PENALTY * fade).otherwise(F.lit(0.0))


def diversify(rows: DataFrame, group: str, per_group: int = S.PER_SOURCE, limit: int = S.LIMIT) -> DataFrame:
    """At most ``per_group`` of a group (0 = off), then the best ``limit``; ``place`` from 1."""
    order = [F.desc("score"), F.col("id")]
    if per_group:
        nth = F.row_number().over(Window.partitionBy("query_id", group).orderBy(*order))
        rows = rows.withColumn("in_group", nth).filter(F.col("in_group") <= per_group).drop("in_group")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("place", place.cast("long")).filter(F.col("place") <= limit)


def quoted(docs: DataFrame, items: DataFrame, words: int = 13) -> DataFrame:
    """(query_id, id): texts (id, t) that hold ``words`` consecutive words or more of an
    item (query_id, t); runs of words are matched by hash, then by themselves."""

    def runs(df: DataFrame, key: str) -> DataFrame:
        w = df.filter("t is not null").select(key, tokens(F.col("t")).alias("w")).filter(F.size("w") >= words)
        starts = F.sequence(F.lit(1), F.size("w") - words + 1)
        return w.select(key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i, words), " ")))).alias("run")).withColumn("h", F.xxhash64("run"))

    mine = runs(items, "query_id")
    return runs(docs, "id").join(mine.select("h", F.col("run").alias("its"), "query_id"), "h").filter("run = its").select("query_id", "id").distinct()


def reciprocal_ranks(hits: DataFrame, relevant: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, rr, success, found): over ``relevant`` (query_id, id) pairs."""
    good = hits.filter(F.col("place") <= depth).join(relevant.distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("found"))
    asked = relevant.select("query_id").distinct().join(good, "query_id", "left")
    return asked.select("query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.col("first").isNotNull().cast("int").alias("success"), F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def overlap_rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Scores replaced by the share of the query's tokens that a text holds.

    ``queries``: (query_id, q); ``texts``: (id, t).  It stands where a model
    would: a function of both texts; rows without a text keep score 0.
    """
    both = hits.select("query_id", "id").join(queries, "query_id").join(texts, "id", "left")
    asked, held = F.array_distinct(tokens(F.col("q"))), F.array_distinct(tokens(F.coalesce("t", F.lit(" "))))
    share = F.size(F.array_intersect(asked, held)) / F.greatest(F.lit(1), F.size(asked))
    return both.select("query_id", "id", F.round(share, 6).alias("score"))


def rank_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, id, before, after, delta): places under two weightings."""
    x = a.select("query_id", "id", F.col("place").alias("before"))
    y = b.select("query_id", "id", F.col("place").alias("after"))
    return x.join(y, ["query_id", "id"], "full").withColumn("delta", F.col("before") - F.col("after"))


def supporting_hit(hits: DataFrame) -> DataFrame:
    """(query_id, id): of the hits (query_id, handle, id, score, source_id, symbol) the best
    whose file stem or symbol is the handle, else the first."""
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    stem = F.regexp_replace(F.regexp_extract("source_id", "([^/]+)$", 1), r"\.[^.]*$", "")
    tail = F.regexp_extract(F.coalesce("symbol", F.lit("")), "([^.:]+)$", 1)
    same = F.coalesce((slug(stem) == F.col("handle")) | (slug(tail) == F.col("handle")), F.lit(False))
    best = F.min_by("id", F.struct(~same, -F.col("score"), F.col("id")))
    return hits.groupBy("query_id", "handle").agg(best.alias("id"), F.max(same).alias("named"))


def synthesised(hits: DataFrame, lineage: int = 3, evidence: int = 3) -> DataFrame:
    """(query_id, page, head, total, lineage, evidence): hits folded to pages by symbol,
    else by file.  A stale hit tells how the page evolved, one of a transcript how it is
    used, the others are primary; the best primary one, else the best, is the head.

    ``hits``: (query_id, id, score, stale, transcript, symbol, source_id).
    """
    role = F.when(F.col("stale"), "evolution").when(F.col("transcript"), "usage").otherwise("primary")
    rows = hits.withColumn("page", F.coalesce("symbol", "source_id")).withColumn("role", role)
    item = F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"))
    of = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, item)))
    head = F.min_by("id", F.struct(F.col("role") != "primary", -F.col("score"), F.col("id")))
    pages = rows.groupBy("query_id", "page").agg(head.alias("head"), F.count(F.lit(1)).alias("total"), of("evolution").alias("e"), of("usage").alias("u"))
    ids = lambda c, n: F.slice(F.transform(c, lambda x: x["id"]), 1, n)
    return pages.select("query_id", "page", "head", "total", ids("e", lineage).alias("lineage"), ids("u", evidence).alias("evidence"))


def pseudo_query(label: Column, entities: Column) -> Column:
    """A concept's label and its entities as one query text."""
    return F.concat_ws(" ", label, entities)
