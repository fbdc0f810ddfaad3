"""Concept store: keyed writes derived from event rows, and reads of the graph.

Stores are tables of events with a sequence number ``seq``; a store's state is an
aggregate of its events, so a write that is repeated or late changes nothing else,
and no row is updated in place.

Defined results: rows with a null key fall away; ties in an order go to the
smaller key; empty events give empty stores; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.session import cut

CANDIDATE_CONFIDENCE, REMEMBERED_CONFIDENCE, PAIR_CONFIDENCE, RELATED_CONFIDENCE = 0.1, 0.5, 0.2, 0.1
#: Handles of one query or turn that are linked pairwise at most.
PAIR_CAP = 8
# File names that say nothing about their content.
STRUCTURAL = ("index", "init", "lib", "main", "mod", "readme")


def ensured(events: DataFrame) -> DataFrame:
    """(project, handle, confidence, kind, seq): the first event of a key makes its
    concept; its confidence stays, the first known kind is kept."""
    rows = events.filter("handle is not null").withColumn("project", F.coalesce("project", F.lit("")))
    first = F.min_by("confidence", "seq").alias("confidence")
    kind = F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("seq"))).alias("kind")
    return rows.groupBy("project", "handle").agg(first, kind, F.min("seq").alias("seq"))


def touched_aliases(touches: DataFrame) -> DataFrame:
    """(handle, alias, source, touch_count): the first source stays, touches add up."""
    return touches.filter("handle is not null and alias is not null").groupBy("handle", "alias").agg(F.min_by("source", "seq").alias("source"), F.count(F.lit(1)).alias("touch_count"))


def attached_evidence(events: DataFrame) -> DataFrame:
    """(handle, source, source_id, pointer, sha, anchor, score, touch_count).

    A later row takes the place of pointer, sha and anchor together, and only
    where it has an anchor itself.
    """
    triple = F.struct("pointer", "sha", "anchor")
    latest = F.max_by(triple, F.when(F.col("anchor").isNotNull(), F.col("seq")))
    one = events.groupBy("handle", "source", "source_id").agg(F.coalesce(latest, F.min_by(triple, "seq")).alias("t"), F.max("score").alias("score"), F.count(F.lit(1)).alias("touch_count"))
    return one.select("handle", "source", "source_id", "t.*", "score", "touch_count")


def ordered_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence with its ``place`` in its concept: active first, then by score, nulls
    last, then by touches."""
    order = [F.desc(F.col("state") == "active"), F.desc_nulls_last("score"), F.desc("touch_count"), F.col("source"), F.col("source_id")]
    return evidence.withColumn("place", F.row_number().over(Window.partitionBy("handle").orderBy(*order)).cast("long"))


def anchors_of(evidence: DataFrame) -> DataFrame:
    """Each concept's first active evidence that resolves to a chunk."""
    rows = ordered_evidence(evidence.filter("state = 'active' and pointer is not null"))
    return rows.filter("place = 1").drop("place")


def codebook(anchors: DataFrame, vectors: DataFrame) -> DataFrame:
    """(handle, id, v): anchors with their vectors; those without one fall away."""
    return anchors.select("handle", F.col("pointer").alias("id")).join(vectors, "id").select("handle", "id", "v")


def merged_keys(keys: DataFrame, hops: int = 8) -> DataFrame:
    """(handle, into): where each merged handle ends, pointers being doubled; a
    handle on a cycle ends nowhere."""
    up = cut(keys.filter("merged_into is not null").select("handle", F.col("merged_into").alias("into")))
    for _ in range(hops):
        above = up.select(F.col("handle").alias("into"), F.col("into").alias("further"))
        if up.join(above, "into", "left_semi").isEmpty():
            break
        up = cut(up.join(above, "into", "left").select("handle", F.coalesce("further", "into").alias("into")))
    return up.join(up.select(F.col("handle").alias("into")), "into", "left_anti").select("handle", "into")


def _renamed(rows: DataFrame, column: str, into: DataFrame) -> DataFrame:
    moved = into.select(F.col("handle").alias(column), F.col("into").alias("_into"))
    return rows.join(moved, column, "left").withColumn(column, F.coalesce("_into", column)).drop("_into")


def repointed_edges(edges: DataFrame, into: DataFrame) -> DataFrame:
    """Edges (a, relation, b, confidence, touch_count) after merges: doubles become
    one, loops go."""
    rows = _renamed(_renamed(edges, "a", into), "b", into).filter("a <> b")
    return rows.groupBy("a", "relation", "b").agg(F.max("confidence").alias("confidence"), F.sum("touch_count").alias("touch_count"))


def repointed_aliases(aliases: DataFrame, into: DataFrame) -> DataFrame:
    """Aliases after merges; a merged handle becomes an alias of where it went."""
    old = into.select(F.col("into").alias("handle"), F.col("handle").alias("alias"), F.lit(0).cast("long").alias("touch_count"))
    rows = _renamed(aliases.select("handle", "alias", "touch_count"), "handle", into).unionByName(old)
    return rows.groupBy("handle", "alias").agg(F.sum("touch_count").alias("touch_count"))


def latest(events: DataFrame, key: list[str], value: str) -> DataFrame:
    """The last value of each key: status, summary, tension."""
    return events.groupBy(*key).agg(F.max_by(value, "seq").alias(value), F.max("seq").alias("seq"))


def active_status(status: Column) -> Column:
    """Whether a concept takes part in activation and diffusion."""
    return ~F.coalesce(status, F.lit("candidate")).isin("merged", "rejected")


def ranked_neighbours(edges: DataFrame) -> DataFrame:
    """Directed neighbours with their ``place``: conductance first, then name."""
    order = Window.partitionBy("a").orderBy(F.desc("w"), "b", "relation")
    return edges.withColumn("place", F.row_number().over(order).cast("long"))


def between(edges: DataFrame) -> DataFrame:
    """Edges of either orientation under their unordered pair."""
    return edges.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))


def histogram(evidence: DataFrame) -> DataFrame:
    """(handle, project, source, source_id, w): active evidence of each document."""
    return evidence.filter("state = 'active'").groupBy("handle", "project", "source", "source_id").agg(F.count(F.lit(1)).alias("w"))


def histogram_specificity(bins: DataFrame, least: int = 20) -> DataFrame:
    """(handle, specificity): 1 - entropy over its most; 1 below ``least`` pieces or
    with one document."""
    positive = bins.filter("w > 0").withColumn("total", F.sum("w").over(Window.partitionBy("handle")))
    p = F.col("w") / F.col("total")
    one = positive.groupBy("handle").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n"), F.sum(-p * F.log(p)).alias("h"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("h") / F.log("n")))
    return one.select("handle", F.round(F.when((F.col("total") < least) | (F.col("n") <= 1), F.lit(1.0)).otherwise(value), 6).alias("specificity"))


def promotable(concepts: DataFrame, evidence: DataFrame, aliases: DataFrame, pieces: int = 2, touches: int = 3) -> DataFrame:
    """Candidates with enough active evidence or an alias touched often enough."""
    e = evidence.filter("state = 'active'").groupBy("handle").agg(F.count(F.lit(1)).alias("pieces"))
    a = aliases.groupBy("handle").agg(F.max("touch_count").alias("touches"))
    rows = concepts.join(e, "handle", "left").join(a, "handle", "left").na.fill(0, ["pieces", "touches"])
    return rows.filter((F.col("status") == "candidate") & ((F.col("pieces") >= pieces) | (F.col("touches") >= touches)))


def terms(path: Column, symbol: Column, text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Terms of a hit, first occurrence first: the path's stem unless structural, the
    symbol's last part, quoted spans, then words of four letters or more."""
    low = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9_]+", "-"))
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"\.[^.]*$", "")
    tail = F.regexp_extract(symbol, "([^.:]+)$", 1)
    quoted = F.transform(F.regexp_extract_all(text, F.lit("[\"`]([^\"`\n]{3,40})[\"`]"), 1), low)
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]{3,}"), 0), lambda w: ~w.isin(*stop) if stop else F.lit(True))
    head = F.filter(F.array(F.when(~F.lower(stem).isin(*STRUCTURAL), low(stem)), low(tail)), lambda t: t.isNotNull() & (F.length(t) > 0))
    return F.array_distinct(F.concat(head, F.coalesce(quoted, F.array().cast("array<string>")), F.coalesce(words, F.array().cast("array<string>"))))


def pairs_with(hits: DataFrame, relation: str = "pairs_with", confidence: float = PAIR_CONFIDENCE, cap: int = PAIR_CAP) -> DataFrame:
    """(a, relation, b, confidence, touch_count): handles that share a group, the
    first ``cap`` of it; ``hits``: (group, handle, place).

    The cap is the operator's rule: a group of any size gives at most 28 pairs.
    """
    first = hits.filter("handle is not null").groupBy("group", "handle").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("group").orderBy("place", "handle"))
    few = first.withColumn("nth", nth).filter(F.col("nth") <= cap).groupBy("group").agg(F.sort_array(F.collect_list("handle")).alias("h"))
    a = few.select("h", F.posexplode("h").alias("i", "a"))
    b = a.select("a", F.explode(F.slice("h", F.col("i") + 2, F.size("h"))).alias("b"))
    return b.groupBy("a", "b").agg(F.count(F.lit(1)).alias("touch_count")).select("a", F.lit(relation).alias("relation"), "b", F.lit(confidence).alias("confidence"), "touch_count")


def recurring(hits: DataFrame, least: int = 3) -> DataFrame:
    """(handle, turns): handles that come back in ``least`` groups or more."""
    return hits.groupBy("handle").agg(F.countDistinct("group").alias("turns")).filter(F.col("turns") >= least)


def latent_lift(seeds: DataFrame, near: DataFrame, floor: float = S.LATENT_FLOOR, k: int = S.LATENT_K) -> DataFrame:
    """(handle, activation): seeds' activation passed to the ``k`` nearest concepts
    above a floor, the largest counting; ``near``: (handle, other, cosine)."""
    nth = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("cosine"), "other"))
    close = near.filter(F.col("cosine") >= floor).withColumn("nth", nth).filter(F.col("nth") <= k)
    lift = F.round(F.col("activation") * F.col("cosine") * S.HOP_DECAY, 9)
    return seeds.join(close, "handle").select(F.col("other").alias("handle"), lift.alias("activation")).groupBy("handle").agg(F.max("activation").alias("activation"))


def latent_edges(near: DataFrame, known: DataFrame, floor: float = S.LATENT_FLOOR, k: int = S.PROMOTE_K) -> DataFrame:
    """Weak edges for close pairs that no edge (a, b) joins in either direction, each
    unordered pair once."""
    nth = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("cosine"), "other"))
    close = near.filter(F.col("cosine") >= floor).withColumn("nth", nth).filter(F.col("nth") <= k)
    pairs = close.select(F.least("handle", "other").alias("a"), F.greatest("handle", "other").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    have = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(have, ["a", "b"], "left_anti").withColumn("confidence", F.lit(RELATED_CONFIDENCE))


def resolution(evidence: DataFrame, live: DataFrame) -> DataFrame:
    """Evidence after a look at the live chunks (id, sha): a missing sha is filled
    in, what does not resolve is orphaned; orphans are not looked at again."""
    work = evidence.filter("state <> 'orphaned'").join(live.select(F.col("id").alias("pointer"), F.col("sha").alias("now_sha")).dropDuplicates(["pointer"]), "pointer", "left")
    state = F.when(F.col("now_sha").isNull(), "orphaned").when(F.col("sha").isNotNull() & (F.col("sha") != F.col("now_sha")), "moved").otherwise("active")
    return work.withColumn("state", state).withColumn("sha", F.coalesce("sha", "now_sha")).drop("now_sha")


def cards(concepts: DataFrame, aliases: DataFrame, evidence: DataFrame, edges: DataFrame, notes: DataFrame, activation: DataFrame) -> DataFrame:
    """One row a concept with its aliases (most touched first), number of evidence
    rows, edges out and in (strongest first), newest note and activation."""
    named = lambda df, key, name, by: df.groupBy(F.col(key).alias("handle")).agg(F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("n"), F.col(name).alias("x")))).alias("l")).select("handle", F.transform("l", lambda s: s["x"]).alias(f"{name}_{key}"))
    out = concepts.join(named(aliases, "handle", "alias", "touch_count"), "handle", "left")
    out = out.join(evidence.groupBy("handle").agg(F.count(F.lit(1)).alias("evidence")), "handle", "left")
    out = out.join(named(edges, "a", "b", "w"), "handle", "left").join(named(edges, "b", "a", "w"), "handle", "left")
    newest = notes.groupBy("handle").agg(F.max_by("note", "seq").alias("note"))
    out = out.join(newest, "handle", "left").join(activation, "handle", "left")
    empty = F.array().cast("array<string>")
    return out.select("handle", F.coalesce("alias_handle", empty).alias("aliases"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("b_a", empty).alias("out"), F.coalesce("a_b", empty).alias("into"), "note", "activation")
