"""Plans that put operators together."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.functions.vec import age_hours
from strandloom.operators import ranking, retrieval


def hybrid_recall(chunks: DataFrame, texts: DataFrame, vectors: DataFrame, asked_vectors: DataFrame, weights: Mapping[str, float], limit: int = S.LIMIT, per_source: int = S.PER_SOURCE, prefetch: int = S.PREFETCH) -> DataFrame:
    """Many queries at once: both lanes, fusion, ranking, cap per source, limit.

    ``chunks``: (id, text, source) and, if the cap is to be per file, source_id;
    ``texts``: (query_id, text); ``vectors``: (id, v); ``asked_vectors``: (query_id, v).
    Lanes carry ids only; the source is joined to the few fused rows.
    """
    deep = limit * prefetch
    words = retrieval.bm25_lane(retrieval.postings(chunks, "id", "text"), texts, "query_id", "text", deep)
    dense = retrieval.dense_lane(vectors, "id", "v", asked_vectors, "query_id", "v", deep)
    scored = retrieval.rank(retrieval.features(retrieval.fuse({"bm25": words, "dense": dense})), weights)
    names = [c for c in ("source_id", "source") if c in chunks.columns]
    return retrieval.diversify(scored.join(chunks.select("id", *names), "id"), names[0], per_source, limit)


def incremental_scan(chunks: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New chunks that must be embedded, and manifest rows that vanished from their files."""
    have = chunks.select("chunk_id").distinct()
    touched = chunks.select("source", "source_id").distinct()
    gone = manifest.join(touched, ["source", "source_id"], "left_semi").join(have, "chunk_id", "left_anti")
    known = manifest.filter("content_sha256 <> ''").select("chunk_id", F.col("content_sha256").alias("sha256")).distinct()
    return chunks.join(known, ["chunk_id", "sha256"], "left_anti"), gone


def full_recall(
    chunks: DataFrame, texts: DataFrame, vectors: DataFrame, asked_vectors: DataFrame, weights: Mapping[str, float],
    condition: Column | None = None, code_only: Column | None = None, now: int | None = None, rerank: bool = False,
    bias: Callable[[DataFrame], DataFrame] | None = None, limit: int = S.LIMIT, per_source: int = S.PER_SOURCE, prefetch: int = S.PREFETCH,
) -> DataFrame:
    """The whole chain for many queries: filter, both lanes, code prefetch, fusion,
    ranking, rerank, identifier boost, self-reference damping, bias, cap, limit.

    ``chunks``: (id, text, source, source_id, micros, code, membrane); ``texts``:
    (query_id, text); ``condition`` keeps the chunks that may be hits (word
    statistics stay those of all chunks).  ``code_only``: the chunks of the code
    prefetch, none where a source was asked for.  ``now`` in micros: damping is left out without it.
    """
    deep = limit * prefetch
    kept = chunks if condition is None else chunks.filter(condition)
    ids = None if condition is None else kept.select("id")
    words = retrieval.bm25_lane(retrieval.postings(chunks, "id", "text"), texts, "query_id", "text", deep, among=ids)
    pool = vectors if ids is None else vectors.join(ids, "id", "left_semi")
    dense = retrieval.dense_lane(pool, "id", "v", asked_vectors, "query_id", "v", deep)
    if code_only is not None:
        code = vectors.join(kept.filter(code_only).select("id"), "id", "left_semi")
        dense = ranking.merged_lane(dense, retrieval.dense_lane(code, "id", "v", asked_vectors, "query_id", "v", S.CODE_PREFETCH))
    scored = retrieval.rank(retrieval.features(retrieval.fuse({"bm25": words, "dense": dense})), weights)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    hits = scored.withColumn("nth", nth).filter(F.col("nth") <= deep).select("query_id", "id", "score")
    if rerank:
        hits = retrieval.overlap_rerank(hits, texts.select("query_id", F.col("text").alias("q")), chunks.select("id", F.col("text").alias("t")))
    rows = hits.join(chunks, "id").join(texts.select("query_id", F.col("text").alias("asked")), "query_id")
    score = retrieval.identifier_boost(F.col("score"), F.when(F.col("code"), "code").otherwise(F.lit("")), F.substring("text", 1, S.SNIPPET_CHARS), F.col("asked"))
    if now is not None:
        score = retrieval.self_reference(score, F.col("membrane"), age_hours(F.lit(now), F.col("micros"), -1e12))
    rows = rows.withColumn("score", F.round(score, 6)).select("query_id", "id", "score", "source", "source_id")
    rows = rows if bias is None else bias(rows)
    return retrieval.diversify(rows, "source_id", per_source, limit)
