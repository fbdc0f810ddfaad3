"""Thread ledger: evidence, links, proposals, counters and scores from event rows.

As in ``concepts`` a store is an aggregate of its events; deletes are events too.

Defined results: rows with a null key fall away; ties go to the smaller key;
empty events give empty stores; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.functions import vec
from strandloom.operators.products import products
from strandloom.session import cut

# Curves of evidence edges.
TOUCH_SATURATION, EDGE_DECAY_HIGH, EDGE_DECAY_LOW = 8, 0.08, 0.01
BRIDGE_LEAST, BRIDGE_GAIN, BRIDGE_DAYS = 0.7, 0.5, 365.0
# Value and negative transfer.
NEUTRAL, HALF, GAMMA, NEGATIVE_K, NEGATIVE_TAU = 1.0, 0.5, 0.8, 3, 0.45
#: Rows that a sample for clustering takes at most; it is a sample by its purpose.
SAMPLE = 500


def live_evidence(events: DataFrame) -> DataFrame:
    """(thread, path, category, touches, first, last): what is there after the last
    removal of its (thread, path); ``events``: (thread, path, category, removes, seq)."""
    gone = F.max(F.when(F.col("removes"), F.col("seq"))).over(Window.partitionBy("thread", "path"))
    kept = events.withColumn("gone", gone).filter(~F.col("removes") & (F.col("gone").isNull() | (F.col("seq") > F.col("gone"))))
    return kept.groupBy("thread", "path", "category").agg(F.count(F.lit(1)).alias("touches"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def linked(links: DataFrame, renamed: DataFrame) -> DataFrame:
    """(a, b, category, touches): links between threads after renames and merges
    (old, new): doubles are one, no thread is linked with itself."""
    to = lambda c: renamed.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new"))
    rows = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_new", "a").alias("a"), F.coalesce("b_new", "b").alias("b"), "category")
    return rows.filter("a <> b").groupBy("a", "b", "category").agg(F.count(F.lit(1)).alias("touches"))


def proposals(reports: DataFrame, now: Column, keep_days: float = S.PRUNE_DAYS, size: int = S.PROMOTE_SIZE, cohesion: float = S.PROMOTE_COHESION) -> DataFrame:
    """(handle, members, cohesion, micros, promoted): the first report of a handle
    stands; large and tight ones are promoted, others go when they are old."""
    first = reports.groupBy("handle").agg(F.min_by(F.struct("members", "cohesion"), F.struct("micros", "members")).alias("r"), F.min("micros").alias("micros"))
    rows = first.select("handle", "r.*", "micros").withColumn("promoted", (F.coalesce("members", F.lit(0)) >= size) & F.coalesce(F.col("cohesion") >= cohesion, F.lit(False)))
    return rows.filter(F.col("promoted") | (F.col("micros") >= now - F.lit(int(keep_days * 86_400_000_000))))


def edge_activation(similarity: Column, age_days: Column, idle_days: Column, touches: Column) -> Column:
    """Touch floor times idle decay times similarity, with a bonus for close pairs
    that span a long time."""
    ramp = F.least(F.lit(1.0), F.greatest(touches - 1, F.lit(0)) / float(TOUCH_SATURATION))
    floor, rate = 0.1 + 0.9 * ramp, EDGE_DECAY_HIGH + (EDGE_DECAY_LOW - EDGE_DECAY_HIGH) * ramp
    close = F.least(F.lit(1.0), F.greatest(F.lit(0.0), similarity))
    far = F.least(F.lit(1.0), F.log1p(F.greatest(age_days, F.lit(0.0))) / float(np.log1p(BRIDGE_DAYS)))
    bonus = F.when(close >= BRIDGE_LEAST, BRIDGE_GAIN * far).otherwise(F.lit(0.0))
    return floor * F.exp(-rate * F.greatest(idle_days, F.lit(0.0))) * close * (1 + bonus)


def surface(scored: DataFrame, limit: int, least: float = S.ARCHIVE) -> DataFrame:
    """(handle, score, bridge, place): the best score of each handle over its scopes,
    those of ``least`` or more, the first ``limit``; where the best bridge stands
    beyond the limit it takes the last place."""
    best = scored.groupBy("handle").agg(F.max(F.struct("score", "bridge")).alias("b")).select("handle", "b.*").filter(F.col("score") >= least)
    order = Window.orderBy(F.desc("score"), "handle")  # the ledger's handles, few by nature
    placed = best.withColumn("place", F.row_number().over(order).cast("long"))
    bridge = placed.filter("bridge").agg(F.min("place").alias("first")).first()["first"]
    if bridge is not None and bridge > limit:
        moved = placed.filter((F.col("place") < limit) | (F.col("place") == bridge))
        return moved.withColumn("place", F.least(F.col("place"), F.lit(limit)).cast("long"))
    return placed.filter(F.col("place") <= limit)


def pinned_pages(pinned: DataFrame, ambient: DataFrame, limit: int) -> DataFrame:
    """(handle, place, pinned): under a pin, a quarter of the places (one at least) is
    filled from the ambient ranking, without doubles; both have (handle, score)."""
    keep = limit - max(1, limit // 4)
    nth = F.row_number().over(Window.orderBy(F.desc("score"), "handle"))
    first = pinned.withColumn("place", nth).filter(F.col("place") <= keep).select("handle", "place", F.lit(True).alias("pinned"))
    room = limit - first.count()
    rest = ambient.join(first.select("handle"), "handle", "left_anti").withColumn("place", nth).filter(F.col("place") <= room)
    return first.unionByName(rest.select("handle", (F.col("place") + limit - room).alias("place"), F.lit(False).alias("pinned")))


def value_use(used: DataFrame, now: Column) -> DataFrame:
    """(handle, value_use): squashed sum over distinct (query, kind), each by weight and
    the base level of its last use; ``used``: (handle, query_key, kind, micros)."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for k, w in S.ACCESS_WEIGHTS.items() for x in (k, float(w))])[F.col("kind")], F.lit(0.0))
    last = used.groupBy("handle", "query_key", "kind").agg(F.max("micros").alias("micros"), F.max(now).alias("now"))
    base = F.log1p(F.pow(vec.age_hours(F.col("now"), F.col("micros"), 1.0), F.lit(-0.5)))
    return last.groupBy("handle").agg(F.sum(weight * base).alias("raw")).select("handle", F.round(vec.squash(F.col("raw")), 9).alias("value_use"))


def value_factor(use: Column, judgment: Column, neutral: float = NEUTRAL, w_use: float = HALF, w_judgment: float = HALF) -> Column:
    """The neutral value raised by positive evidence; ``judgment``: the sum of it."""
    judged = F.when(judgment > 0, 1 - F.exp(-judgment)).otherwise(F.lit(0.0))
    positive = F.least(F.lit(1.0), F.greatest(F.lit(0.0), w_use * F.coalesce(use, F.lit(0.0)) + w_judgment * judged))
    return neutral + (1 - neutral) * positive


def centred(rows: DataFrame, width: int) -> DataFrame:
    """(id, v): unit vectors less the mean of all unit vectors, of length 1 again;
    zero vectors stay zero."""
    unit = rows.select("id", F.when(vec.norm(F.col("v")) > 0, F.transform("v", lambda x: x / vec.norm(F.col("v")))).otherwise(F.transform("v", lambda x: x.cast("double"))).alias("v"))
    mean = normalised_mean(unit, width)
    moved = unit.crossJoin(F.broadcast(mean)).select("id", F.zip_with("v", "mean", lambda x, m: x - m).alias("v"))  # one row of the mean
    return moved.select("id", F.when(vec.norm(F.col("v")) > 0, F.transform("v", lambda x: x / vec.norm(F.col("v")))).otherwise(F.col("v")).alias("v"))


def normalised_mean(rows: DataFrame, width: int) -> DataFrame:
    """(mean): the mean of the unit vectors of ``v``, zero ones left out; one row."""
    length = vec.norm(F.col("v"))
    unit = rows.filter(length > 0).select(F.transform("v", lambda x: x / length).alias("u"))
    return unit.agg(F.array(*[F.avg(F.col("u")[i]) for i in range(width)]).alias("mean"))


def negative_penalty(anchors: DataFrame, exemplars: DataFrame, width: int, k: int = NEGATIVE_K, tau: float = NEGATIVE_TAU) -> DataFrame:
    """(id, penalty): the mean of the ``k`` highest centred cosines to the rejected
    exemplars (id), counted from ``tau`` to 1; an anchor is no exemplar of itself."""
    rows = centred(anchors, width)
    bad = rows.join(exemplars.select("id"), "id", "left_semi").select(F.col("id").alias("other"), "v")
    near = products(rows, bad.select(F.col("other").alias("query_id"), "v"), "similarity", least=-1.0).filter("query_id <> id")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "query_id"))
    mean = near.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy("id").agg(F.avg("score").alias("mean"))
    return mean.select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("mean") - tau) / (1 - tau))), 6).alias("penalty"))


def salience(specificity: Column, value: Column, penalty: Column, gamma: float = GAMMA) -> Column:
    """The floor multiplier of a handle; a missing part is neutral."""
    return F.coalesce(specificity, F.lit(1.0)) * F.coalesce(value, F.lit(1.0)) * (1 - gamma * F.coalesce(penalty, F.lit(0.0)))


def weaves(matches: DataFrame) -> DataFrame:
    """(a, b, chunks): anchors that match one chunk; ``matches``: (id, anchor, cosine).
    A chunk gives the pairs of its eight closest anchors at most, the operator's rule."""
    from strandloom.operators.concepts import pairs_with

    rows = matches.select(F.col("id").alias("group"), F.col("anchor").alias("handle"), (-F.col("cosine")).alias("place"))
    return pairs_with(rows, "weave").select("a", "b", F.col("touch_count").alias("chunks"))


def totals(events: DataFrame) -> DataFrame:
    """(key, value): a count of events, set anew by those that carry a ``total``."""
    base = events.groupBy("key").agg(F.max_by("total", F.when(F.col("total").isNotNull(), F.col("seq"))).alias("base"), F.max(F.when(F.col("total").isNotNull(), F.col("seq"))).alias("at"))
    more = events.join(base, "key").groupBy("key").agg(F.max("base").alias("base"), F.count(F.when(F.col("at").isNull() | (F.col("seq") > F.col("at")), 1)).alias("n"))
    return more.select("key", (F.coalesce("base", F.lit(0)) + F.col("n")).alias("value"))


def faded(factors: DataFrame) -> DataFrame:
    """(key, fade): the product of non-negative finite factors; others are left out."""
    good = factors.filter((F.col("factor") >= 0) & (F.col("factor") < float("inf")) & ~F.isnan("factor"))
    product = F.when(F.min("factor") == 0, F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.when(F.col("factor") > 0, F.col("factor"))))))
    return good.groupBy("key").agg(F.round(product, 6).alias("fade"))


def effective_vector(pinned: Column, rolling: Column, transient: Column) -> Column:
    """The pinned vector, else a rolling one that is not empty, else the transient."""
    return F.coalesce(pinned, F.when(F.size(rolling) > 0, rolling), transient)


def focus_state(events: DataFrame) -> DataFrame:
    """(scope, item, pinned): the last pin of each scope, none after a clear;
    ``events``: (scope, item, clears, seq)."""
    last = events.groupBy("scope").agg(F.max_by(F.struct("item", "clears"), "seq").alias("x"))
    return last.select("scope", F.when(~F.col("x.clears"), F.col("x.item")).alias("item"), (~F.col("x.clears")).alias("pinned"))


def visible(rows: DataFrame, scope: str) -> DataFrame:
    """Rows a scope may see: private ones only at home; ``tier`` and ``scope_key``."""
    return rows.filter((F.col("tier") != "t0_private") | F.col("scope_key").eqNullSafe(F.lit(scope)))


def survivors(rows: DataFrame, floor: float, k: int) -> DataFrame:
    """The ``k`` highest cosines of each group from a floor on."""
    nth = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("cosine"), "id"))
    return rows.filter(F.col("cosine") >= floor).withColumn("place", nth.cast("long")).filter(F.col("place") <= k)


def sample(rows: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The newest ``n`` live rows (id, micros, stale, ...), a sample by its purpose."""
    return rows.filter("not stale").orderBy(F.desc_nulls_last("micros"), "id").limit(n)


def components(rows: DataFrame, cosine: float = S.CLUSTER_COSINE, size: int = S.CLUSTER_SIZE, neighbours: int = S.CLUSTER_NEIGHBOURS, distinct: int = 1) -> DataFrame:
    """(handle, members, cohesion, ids): linked groups of a bounded sample (id, v).

    Members have ``neighbours`` links in their group or more, groups ``size`` members
    and ``distinct`` different vectors; ids stand in order of their cosine to the
    group's mean.  The sample is one group by definition and is folded in one task.
    """

    def fold(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("id", kind="stable").reset_index(drop=True)
        v = np.stack(pool["v"].map(np.asarray).to_list()).astype(float)
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        link = (np.round(unit @ unit.T, 6) >= cosine) & ~np.eye(len(v), dtype=bool)
        left, out = np.ones(len(v), dtype=bool), []
        for i in range(len(v)):
            if not left[i]:
                continue
            group = np.zeros(len(v), dtype=bool)
            group[i] = True
            while (wider := group | link[group].any(axis=0)).sum() > group.sum():
                group = wider
            left &= ~group
            at = np.flatnonzero(group)
            at = at[link[np.ix_(at, at)].sum(axis=1) >= neighbours]
            if len(at) < size or len({unit[j].tobytes() for j in at}) < distinct:
                continue
            mean = unit[at].mean(axis=0)
            near = np.round(unit[at] @ (mean / max(np.linalg.norm(mean), 1e-300)), 6)
            order = sorted(range(len(at)), key=lambda j: (-near[j], pool["id"][at[j]]))
            ids = [str(pool["id"][at[j]]) for j in order]
            n = len(at)
            inner = (float((unit[at].sum(axis=0) ** 2).sum()) - n) / (n * (n - 1))
            name = "proposed-" + hashlib.sha256("".join(f"{x}\n" for x in sorted(ids)).encode()).hexdigest()[:8]
            out.append((name, n, round(inner, 6), ids))
        return pd.DataFrame(out, columns=["handle", "members", "cohesion", "ids"])

    return rows.select("id", "v", F.lit(0).alias("g")).groupBy("g").applyInPandas(fold, "handle string, members long, cohesion double, ids array<string>")


def anchor_snapshot(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Threads (handle, anchor, ...) with their anchor's vector, null where it is gone."""
    return rows.join(vectors.select(F.col("id").alias("anchor"), "v"), "anchor", "left")


def anchor_fallback(rows: DataFrame) -> DataFrame:
    """(handle, scope, v): a scope's own anchor, else that of the first other scope by
    name that has one that is not empty; ``rows``: (handle, scope, v)."""
    full = F.when(F.size("v") > 0, F.col("v"))
    other = rows.select("handle", full.alias("v"), "scope").filter("v is not null").groupBy("handle").agg(F.min_by("v", "scope").alias("any"))
    return rows.withColumn("v", full).join(other, "handle", "left").select("handle", "scope", F.coalesce("v", "any").alias("v"))


def reanchored(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(handle, v, origin): the cached vector, else the anchor chunk's, else an orphan;
    ``rows``: (handle, anchor, cached)."""
    both = rows.join(vectors.select(F.col("id").alias("anchor"), F.col("v").alias("held")), "anchor", "left")
    cached = F.when(F.size("cached") > 0, F.col("cached"))
    origin = F.when(cached.isNotNull(), "cached").when(F.col("held").isNotNull(), "chunk").otherwise("orphan")
    return both.select("handle", F.coalesce(cached, F.col("held")).alias("v"), origin.alias("origin"))


def near_duplicates(anchors: DataFrame, cosine: float = S.MERGE_COSINE) -> DataFrame:
    """(handle, into): threads whose anchors are almost one, merged greedily.

    Pairs are looked at in order of their names; of a pair the one with more
    resonance stays, the older on a tie; a merged thread is out of play.  The fold is
    over linked groups, each a task of its own.  ``anchors``: (handle, v, resonance, micros).
    """
    near = products(anchors.select(F.col("handle").alias("id"), "v"), anchors.select(F.col("handle").alias("query_id"), "v"), "similarity", least=cosine).filter("query_id < id")
    pairs = cut(near.select(F.col("query_id").alias("a"), F.col("id").alias("b")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(both.select(F.col("a").alias("handle")).distinct().withColumn("root", F.col("handle")))
    while True:
        low = both.join(label.withColumnRenamed("handle", "b"), "b").groupBy(F.col("a").alias("handle")).agg(F.min("root").alias("low"))
        step = cut(label.join(low, "handle", "left").select("handle", "root", F.least("root", "low").alias("new")))
        if step.filter("new < root").isEmpty():
            break
        label = step.select("handle", F.col("new").alias("root"))
    info = anchors.select("handle", "resonance", "micros")
    side = lambda c: info.select(F.col("handle").alias(c), F.col("resonance").alias(f"{c}_r"), F.col("micros").alias(f"{c}_m"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").join(label.withColumnRenamed("handle", "a"), "a")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        gone, out = set(), []
        for r in group.sort_values(["a", "b"]).itertuples():
            if r.a in gone or r.b in gone:
                continue
            stays = r.a_r > r.b_r or (r.a_r == r.b_r and r.a_m <= r.b_m)
            keep, drop = (r.a, r.b) if stays else (r.b, r.a)
            gone.add(drop)
            out.append((drop, keep))
        return pd.DataFrame(out, columns=["handle", "into"])

    return rows.groupBy("root").applyInPandas(fold, "handle string, into string")
