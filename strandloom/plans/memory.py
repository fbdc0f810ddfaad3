"""The tool surface over stores: each function takes and gives DataFrames.

Reads compose operators; writes give event rows to append, so that calling one
twice appends the same key twice and the stores' aggregates stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.operators import concepts, ledger, retrieval, threads
from strandloom.operators.products import products

#: Relations that are written by hand, and the confidence they are given.
AUTHORED_CONFIDENCE = 1.0


def link(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, pos, parent, text): wanted chunks' parents in their stored order; unknown
    parents are missing.  ``chunks``: (id, text, parent_ids)."""
    wanted = chunks.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.posexplode("parent_ids").alias("pos", "parent"))
    return wanted.join(chunks.select(F.col("id").alias("parent"), "text"), "parent").select("id", "pos", "parent", "text")


def stats(corpus: DataFrame, manifest: DataFrame, audit: DataFrame) -> DataFrame:
    """(what, name, n, micros): chunks in all and by source, the last scan, the newest
    audit row of each project.

    ``corpus``: (source); ``manifest``: (micros); ``audit``: (project, micros).
    """
    none = F.lit(None)
    by = corpus.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("what"), F.col("source").alias("name"), "n", none.cast("long").alias("micros"))
    whole = corpus.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("what"), F.lit("").alias("name"), "n", none.cast("long").alias("micros"))
    scan = manifest.agg(F.max("micros").alias("micros")).select(F.lit("last_scan").alias("what"), F.lit("").alias("name"), none.cast("long").alias("n"), "micros")
    newest = audit.filter("project is not null").groupBy("project").agg(F.max("micros").alias("micros")).select(F.lit("audit").alias("what"), F.col("project").alias("name"), none.cast("long").alias("n"), "micros")
    return by.unionByName(whole).unionByName(scan).unionByName(newest)


def fault(hits: DataFrame, details: DataFrame, micros: int) -> tuple[DataFrame, DataFrame]:
    """Pages of the hits, and the access rows (id, micros, kind) to append.

    ``hits``: (query_id, id, score); ``details``: (id, stale, transcript, symbol, source_id).
    """
    log = hits.select("id", F.lit(micros).alias("micros"), F.lit("recall_fault").alias("kind")).distinct()
    return retrieval.synthesised(hits.select("query_id", "id", "score").join(details, "id")), log


def remember(handles: DataFrame, seq: int) -> DataFrame:
    """Events that seed concepts by hand; ``handles``: (project, handle, kind)."""
    return handles.select("project", "handle", F.lit(concepts.REMEMBERED_CONFIDENCE).alias("confidence"), "kind", F.lit("proposed").alias("status"), F.lit(seq).cast("long").alias("seq"))


def connect(pairs: DataFrame, relation: str, seq: int, micros: int) -> DataFrame:
    """Touches of authored edges; ``pairs``: (a, b); loops are left out by the store."""
    return pairs.select("a", F.lit(relation).alias("relation"), "b", F.lit(AUTHORED_CONFIDENCE).alias("confidence"), F.lit("authored").alias("source"), F.lit(micros).cast("long").alias("micros"), F.lit(seq).cast("long").alias("seq"))


def reflect(held: DataFrame, evidence: DataFrame, aliases: DataFrame, live: DataFrame, near: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What a reflection finds: ``promoted`` candidates, ``resolved`` evidence and weak
    ``edges`` between close concepts."""
    return {"promoted": concepts.promotable(held, evidence, aliases), "resolved": concepts.resolution(evidence, live), "edges": concepts.latent_edges(near, edges)}


def surfaced(scored: DataFrame, held: DataFrame, activation: DataFrame, limit: int = S.LIMIT) -> DataFrame:
    """(view, handle, score, place): threads of the moment, active concepts by activation,
    and open loops: candidates nobody has judged, the most active first."""
    now = threads.surface(scored, limit).select(F.lit("now").alias("view"), "handle", F.col("score").cast("double").alias("score"), "place")
    rows = held.join(activation, "handle").withColumn("view", F.when(F.col("status") == "active", "concepts").when(F.col("status") == "candidate", "open_loops")).filter("view is not null")
    nth = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("activation"), "handle"))
    ranked = rows.withColumn("place", nth.cast("long")).filter(F.col("place") <= limit)
    return now.unionByName(ranked.select("view", "handle", F.col("activation").alias("score"), "place"))


def consolidated(anchors: DataFrame, reports: DataFrame, states: DataFrame, now: Column, bridge: float = S.BRIDGE) -> dict[str, DataFrame]:
    """The stages of a consolidation in their order: ``bridges`` between close anchors,
    ``merges`` of those that are almost one, ``promoted`` proposals, ``abstract``
    threads that are stable, ``faded`` ones that are idle.

    ``anchors``: (handle, v, resonance, micros); ``reports`` as in
    ``threads.proposals``; ``states``: (handle, state, resonance, idle_days).
    """
    close = products(anchors.select(F.col("handle").alias("id"), "v"), anchors.select(F.col("handle").alias("query_id"), "v"), "similarity", least=bridge)
    faded = states.withColumn("next", ledger.fade_state(F.col("state"), F.col("resonance"), F.col("idle_days")))
    return {
        "bridges": close.filter("query_id < id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("cosine")),
        "merges": threads.near_duplicates(anchors),
        "promoted": threads.proposals(reports, now).filter("promoted").select("handle"),
        "abstract": states.filter((F.col("state") == "active") & (F.col("resonance") >= S.SATURATION)).select("handle"),
        "faded": faded.filter("next <> state").select("handle", "next"),
    }


def novel_first(rows: DataFrame, limit: int, least: int = S.CLUSTER_SIZE, by: int = 5) -> DataFrame:
    """The ``by`` times ``limit`` most novel rows (id, novelty), at least ``least``: what novelty groups are made of."""
    return rows.orderBy(F.desc("novelty"), "id").limit(max(by * limit, least))


def row_id(kind: str, project: Column, ids: Column) -> Column:
    """The name of a row of the thread query: ``kind`` and a digest of project, count and ids."""
    text = F.concat_ws("\n", F.coalesce(project, F.lit("")), F.size(ids).cast("string"), F.array_join(F.array_sort(ids), "\n"))
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(text, 256), 1, 8))


def register(spark: SparkSession) -> list[str]:
    """Functions of the engine under names of their own in SQL."""
    from strandloom.functions import vec

    spark.udf.register("sl_pack_vector", vec.packed)
    spark.udf.register("sl_unpack_vector", vec.unpacked)
    return ["sl_pack_vector", "sl_unpack_vector"]
