"""Rank features, profiles, refractory penalty and portfolio slots.

A feature is a function of the pool (query_id, id, ...) and a ``Context``; it
gives (query_id, id, raw), which may depend on the whole pool.  ``rank_pool`` clamps
raw values to [0, 1], weighs them and keeps each contribution.  Names without a
registered function are passed over, as are features whose context is missing.

Defined results: a null raw value counts 0; a pool that is flat in a feature
gets the feature's stated neutral value; ties in the total go to the smaller id;
an empty pool gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.functions import vec
from strandloom.operators.graph import base_level

# The weights of each profile.
PROFILES: dict[str, dict[str, float]] = {
    "explicit": {"rrf": 1.0},
    "ambient": {"attention_affinity": 1.0},
    "lens": {"attention_affinity": 1.0, "freshness": 0.5, "concept_support": 0.5, "relational_lift": 0.5},
}
# Slots of a portfolio in their order, the feature that must dominate (none: the most different), seats.
SLOTS = (
    ("attention", "attention_affinity", 2), ("freshness", "freshness", 1), ("entity", "entity_salience", 1),
    ("concept", "concept_support", 1), ("relational", "relational_lift", 1), ("diversity_jump", None, 1),
)


@dataclass(frozen=True)
class Context:
    """What features read: ``now`` in micros; ``scopes`` (query_id, v); ``vectors``
    (id, v); ``accesses`` (id, micros, kind); ``support`` and ``lift`` (id, value)."""

    now: int = 0
    scopes: DataFrame | None = None
    vectors: DataFrame | None = None
    accesses: DataFrame | None = None
    support: DataFrame | None = None
    lift: DataFrame | None = None


Feature = Callable[[DataFrame, Context], DataFrame | None]
FEATURES: dict[str, Feature] = {}


def feature(name: str) -> Callable[[Feature], Feature]:
    """Register a rank feature under its name."""

    def put(f: Feature) -> Feature:
        FEATURES[name] = f
        return f

    return put


def profile_weights(profile: str, overlays: Mapping[str, Mapping[str, float]] | None = None) -> dict[str, float]:
    """A profile's weights under the overlay ``default``, then the profile's own."""
    overlays = overlays or {}
    return PROFILES.get(profile, {}) | dict(overlays.get("default", {})) | dict(overlays.get(profile, {}))


def pool_scaled(rows: DataFrame, flat: float) -> DataFrame:
    """(query_id, id, raw): ``value`` scaled to its query's pool."""
    pool = Window.partitionBy("query_id")
    value = F.round("value", 9)
    return rows.select("query_id", "id", F.round(vec.min_max(value, F.min(value).over(pool), F.max(value).over(pool), flat), 9).alias("raw"))


@feature("attention_affinity")
def attention_affinity(pool: DataFrame, context: Context) -> DataFrame | None:
    """Cosine of the scope and the chunk, at least 0."""
    if context.scopes is None or context.vectors is None:
        return None
    both = pool.select("query_id", "id").join(context.vectors, "id").join(context.scopes.select("query_id", F.col("v").alias("scope")), "query_id")
    return both.select("query_id", "id", F.round(F.greatest(F.lit(0.0), vec.cosine(F.col("v"), F.col("scope"))), 9).alias("raw"))


@feature("freshness")
def freshness(pool: DataFrame, context: Context, days: int = S.FRESHNESS_DAYS) -> DataFrame | None:
    """Base level of the accesses of the last days, scaled to the pool; 0.5 where flat."""
    if context.accesses is None:
        return None
    weight = F.coalesce(F.create_map(*[F.lit(x) for k, w in S.ACCESS_WEIGHTS.items() for x in (k, float(w))])[F.col("kind")], F.lit(0.0))
    recent = context.accesses.filter((F.col("micros") >= context.now - days * 86_400_000_000) & (F.col("micros") <= context.now))
    base = recent.groupBy("id").agg(F.round(base_level(F.floor((F.lit(context.now) - F.col("micros")) / 3_600_000_000), weight), 9).alias("base"))
    rows = pool.select("query_id", "id").join(base, "id", "left").select("query_id", "id", F.coalesce("base", F.lit(0.0)).alias("value"))
    return pool_scaled(rows, 0.5)


def _coordinate(pool: DataFrame, values: DataFrame | None) -> DataFrame | None:
    if values is None:
        return None
    rows = pool.select("query_id", "id").join(values.select("id", "value"), "id", "left")
    return pool_scaled(rows.select("query_id", "id", F.coalesce("value", F.lit(0.0)).alias("value")), 0.0)


@feature("concept_support")
def concept_support(pool: DataFrame, context: Context) -> DataFrame | None:
    """Best activation of a concept with evidence at the chunk's coordinate."""
    return _coordinate(pool, context.support)


@feature("relational_lift")
def relational_lift(pool: DataFrame, context: Context) -> DataFrame | None:
    """What diffusion over the concept graph brings to the chunk's coordinate."""
    return _coordinate(pool, context.lift)


def rank_pool(pool: DataFrame, context: Context, weights: Mapping[str, float]) -> DataFrame:
    """``pool`` with ``f_name`` and ``c_name`` (contribution) of each weighted
    feature and their ``total``; columns ``f_name`` that are there are used."""
    total: Column = F.lit(0.0)
    for name, weight in weights.items():
        if f"f_{name}" not in pool.columns:
            raw = FEATURES[name](pool, context) if name in FEATURES else None
            if raw is None:
                continue
            pool = pool.join(raw.withColumnRenamed("raw", f"f_{name}"), ["query_id", "id"], "left")
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(f"f_{name}"), F.lit(0.0))))
        pool = pool.withColumn(f"f_{name}", value).withColumn(f"c_{name}", F.round(value * F.lit(float(weight)), 9))
        total = total + F.col(f"c_{name}")
    return pool.withColumn("total", F.round(total, 6))


def refractory(ranked: DataFrame, shown: DataFrame, now: int, tau_s: float = S.REFRACTORY_TAU_S, weight: float = S.REFRACTORY_WEIGHT) -> DataFrame:
    """``total`` less what was shown lately, with the ``penalty``; ``shown``: (id, micros)."""
    recent = shown.filter((F.col("micros") >= now - int(5e6 * tau_s)) & (F.col("micros") <= now))
    fade = recent.groupBy("id").agg(F.round(weight * F.sum(F.exp(-((F.lit(now) - F.col("micros")) / 1e6) / tau_s)), 6).alias("penalty"))
    out = ranked.join(fade, "id", "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    return out.withColumn("total", F.round(F.col("total") - F.col("penalty"), 6))


def dominant(contribution: Column, total: Column, share: float = S.DOMINANCE) -> Column:
    """Whether a feature gives at least ``share`` of a positive total."""
    return (total > 1.2e-7) & (F.coalesce(contribution, F.lit(0.0)) / total >= share)


@dataclass(frozen=True)
class LensConfig:
    """Budget of a portfolio and what may stand in it."""

    budget: int = S.LENS_BUDGET
    least: int = S.LENS_MIN
    k: int = S.LENS_K
    share: float = S.DOMINANCE
    excluded: tuple[str, ...] = field(default=())


def allocate(ranked: DataFrame, config: LensConfig = LensConfig(), slots=SLOTS) -> DataFrame:
    """(query_id, id, seat, slot, left): seats of each query's portfolio.

    Slots are filled in their order: a seat takes the best total among the rows
    its feature dominates, the last slot the row most unlike those seated.  No id
    and no text (``sha``) is seated twice; a row takes as many tokens as it has, or
    as are left; below ``least`` tokens nothing more is seated.  ``ranked`` has
    (query_id, id, sha, n_tokens, v, total, c_*) and, as pools are ``k`` rows a lane,
    a bounded number of rows a query: beyond twice ``k`` the lowest totals go.
    """
    names = [f for _, f, _ in slots if f and f"c_{f}" in ranked.columns]
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total"), "id"))
    rows = ranked.withColumn("nth", top).filter(F.col("nth") <= 2 * config.k).select("query_id", "id", "sha", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("v").cast("array<double>").alias("v"), "total", *[f"c_{n}" for n in names])

    def fold(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["total", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        unit = [None if v is None or not np.linalg.norm(v) else np.asarray(v) / np.linalg.norm(v) for v in pool["v"]]
        free, seen, chosen, out, left = np.ones(len(pool), dtype=bool), set(), [], [], config.budget
        for slot, name, seats in slots:
            for _ in range(seats):
                if left < config.least:
                    break
                if name is None:
                    unlike = [1.0 - max((max(0.0, float(u @ c)) for c in chosen), default=0.0) if free[i] and (u := unit[i]) is not None else -1.0 for i in range(len(pool))]
                    best = max((round(x, 9) for x in unlike), default=-1.0)
                    picks = [i for i, x in enumerate(unlike) if round(x, 9) == best and x >= 0]
                    at = min(picks, key=lambda i: pool["id"][i]) if picks else None
                elif name not in names:
                    at = None
                else:
                    good = free & (pool["total"].to_numpy() > 1.2e-7)
                    share = pool[f"c_{name}"].fillna(0).to_numpy() / np.where(good, pool["total"].to_numpy(), 1.0)
                    hits = np.flatnonzero(good & (share >= config.share))
                    at = int(hits[0]) if len(hits) else None
                if at is None:
                    break
                left -= min(int(pool["n_tokens"][at]), left)
                out.append((pool["query_id"][at], pool["id"][at], len(out), slot, left))
                seen.add(pool["sha"][at])
                free &= ~pool["sha"].isin(seen).to_numpy() & (pool["id"] != pool["id"][at]).to_numpy()
                if unit[at] is not None:
                    chosen.append(unit[at])
        return pd.DataFrame(out, columns=["query_id", "id", "seat", "slot", "left"])

    kind = dict(rows.dtypes)
    return rows.groupBy("query_id").applyInPandas(fold, f"query_id {kind['query_id']}, id {kind['id']}, seat int, slot string, left long")


def injected(pool: DataFrame, more: DataFrame) -> DataFrame:
    """The pool (query_id, id) and those of ``more`` that it lacks, flagged."""
    new = more.select("query_id", "id").distinct().join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return pool.select("query_id", "id", F.lit(False).alias("injected")).distinct().unionByName(new.withColumn("injected", F.lit(True)))


def merged_lane(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """One lane of two: each id with its smaller rank (and that one's score)."""
    both = primary.select("query_id", "id", "score", "lane_rank").unionByName(extra.select("query_id", "id", "score", "lane_rank"))
    best = both.groupBy("query_id", "id").agg(F.min(F.struct("lane_rank", "score")).alias("m"))
    return best.select("query_id", "id", "m.score", "m.lane_rank")


def attention_bias(hits: DataFrame, threads: DataFrame, scopes: DataFrame, vectors: DataFrame, thread_weight: float, vector_weight: float) -> DataFrame:
    """Hits with ``score`` plus the clamped best thread score of the chunk and the
    clamped cosine to the scope, each weighted; bad weights count 0.

    ``threads``: (id, score); several of a chunk count by the largest.
    """
    tw, vw = (w if w == w and 0 < w < float("inf") else 0.0 for w in (thread_weight, vector_weight))
    best = threads.groupBy("id").agg(F.max("score").alias("thread"))
    rows = hits.join(best, "id", "left").join(vectors, "id", "left").join(scopes.select("query_id", F.col("v").alias("scope")), "query_id", "left")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    close = F.when(F.col("v").isNotNull() & F.col("scope").isNotNull(), vec.cosine(F.col("v"), F.col("scope")))
    return rows.withColumn("score", F.round(F.col("score") + tw * unit(F.col("thread")) + vw * unit(close), 6)).drop("thread", "v", "scope")
