"""Thread ledger: scores, decay, states, use and health, from event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.operators.products import products


def _ramp(familiarity: Column) -> Column:
    return F.least(F.lit(1.0), familiarity / float(S.SATURATION))


def decay_rate(familiarity: Column) -> Column:
    """From the high to the low rate as familiarity saturates."""
    return S.DECAY_HIGH + (S.DECAY_LOW - S.DECAY_HIGH) * _ramp(familiarity)


def floor_of(familiarity: Column) -> Column:
    """From the low to the high floor as familiarity saturates."""
    return S.FLOOR_LOW + (S.FLOOR_HIGH - S.FLOOR_LOW) * _ramp(familiarity)


def off_diagonal(tension: Column, resonance: Column, cosine: Column, stop: Column) -> Column:
    """A lift for quiet threads that are close in meaning."""
    may = (tension < S.OFF_TENSION) & ~stop & (resonance <= S.OFF_COUNT) & (cosine >= S.OFF_FLOOR)
    return F.when(may, (cosine - S.OFF_FLOOR) / (1 - S.OFF_FLOOR)).otherwise(F.lit(0.0))


def stop_handle(mentions: Column, resonance: Column) -> Column:
    """Often mentioned, hardly ever resonant."""
    return (mentions >= 50) & (resonance / F.greatest(mentions, F.lit(1)) < 0.05)


def thread_score(mentions: Column, resonance: Column, tension: Column, days: Column, cosine: Column, fade: Column | float = 1.0, damp: Column | float = 1.0) -> Column:
    """Floor times fade times decay, plus cosine, plus half the off-diagonal lift."""
    stop = stop_handle(mentions, resonance)
    known = F.when(stop, F.lit(0)).otherwise(mentions)
    fade, damp = (F.lit(x) if isinstance(x, float) else x for x in (fade, damp))
    return S.SCORE_ALPHA * floor_of(known) * fade * F.exp(-decay_rate(known) * days) + cosine * damp + S.SCORE_BETA * off_diagonal(tension, resonance, cosine, stop)


def curator_state(state: Column, score: Column) -> Column:
    """The next state: thresholds with hysteresis against leaving the state."""
    up = lambda s: F.lit(S.CURATOR[s]) - F.when(state == s, S.HYSTERESIS).otherwise(0.0)
    return F.when(score >= up("active"), "active").when(score >= up("slack"), "slack").when(score >= up("dormant"), "dormant").otherwise("archived")


def fade_state(state: Column, resonance: Column, idle_days: Column) -> Column:
    """Idle threads sink, the slower the more they resonated, and never rise."""
    m = 1 + F.least(resonance, F.lit(S.SATURATION)) / float(S.SATURATION)
    return F.when(idle_days >= S.FADE_DORMANT_DAYS * m, "dormant").when((idle_days >= S.FADE_SLACK_DAYS * m) & (state == "active"), "slack").otherwise(state)


def use_ledger(surfaced: DataFrame, used: DataFrame) -> DataFrame:
    """Per handle: times surfaced, weighted distinct uses, distinct queries.

    ``surfaced``: (handle); ``used``: (handle, query_key, kind).
    """
    shown = surfaced.groupBy("handle").agg(F.count(F.lit(1)).alias("surfaced"))
    weight = F.create_map(*[x for k, w in S.ACCESS_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    uses = used.select("handle", "query_key", "kind").distinct().withColumn("weight", F.coalesce(weight[F.col("kind")], F.lit(0.0)))
    sums = uses.groupBy("handle").agg(F.round(F.sum("weight"), 6).alias("used_weighted"), F.countDistinct("query_key").alias("used_queries"))
    return shown.join(sums, "handle", "full").na.fill({"surfaced": 0, "used_weighted": 0.0, "used_queries": 0})


def replay_counters(events: DataFrame) -> DataFrame:
    """Last write wins: (key, value) of the highest sequence of each key."""
    return events.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def latest_rows(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last event row of each key."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("_n", last).filter("_n = 1").drop("_n")


def anchor_matches(chunks: DataFrame, anchors: DataFrame, least: float) -> DataFrame:
    """(anchor, id, cosine): chunks (id, v) at cosine ``least`` or more to an anchor
    (anchor, v), compared in blocks."""
    asked = anchors.select(F.col("anchor").alias("query_id"), "v")
    return products(chunks, asked, "similarity", least=least).select(F.col("query_id").alias("anchor"), "id", F.col("score").alias("cosine"))


def portfolio(hits: DataFrame, budget: int = S.LENS_BUDGET, least: int = S.LENS_MIN, seats: int = S.LENS_K) -> DataFrame:
    """Seats under a token budget: in order of score a hit is taken while its
    tokens fit, no text twice; ``hits``: (query_id, id, score, sha, n_tokens).

    At most ``seats`` of the best hits of a query are looked at, so a group of
    the fold is bounded.
    """
    import pandas as pd

    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    few = hits.withColumn("nth", order).filter(F.col("nth") <= seats).select("query_id", "id", "sha", "n_tokens", F.col("nth").cast("long").alias("nth"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        left, seen, out = budget, set(), []
        for r in rows.sort_values("nth").itertuples():
            if left < least:
                break
            if r.sha not in seen and r.n_tokens <= left:
                seen.add(r.sha)
                left -= r.n_tokens
                out.append((r.query_id, r.id, len(out), left))
        return pd.DataFrame(out, columns=["query_id", "id", "seat", "left"])

    kind = dict(few.dtypes)
    return few.groupBy("query_id").applyInPandas(fold, f"query_id {kind['query_id']}, id {kind['id']}, seat int, left long")


def ema(rows: DataFrame, key: str, order: list[str], value: str, weight: float = S.EMA_LAMBDA) -> DataFrame:
    """The exponential mean after the last row of each key, in closed form: the
    first row weighs (1 - w)^(n - 1), the i-th from the end w (1 - w)^i."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    w = F.when(F.col("_back") == F.col("_n") - 1, F.pow(F.lit(1 - weight), F.col("_back"))).otherwise(weight * F.pow(F.lit(1 - weight), F.col("_back")))
    return rows.withColumn("_back", back).withColumn("_n", n).groupBy(key).agg(F.round(F.sum(F.col(value) * w), 6).alias("ema"), F.max("_n").cast("long").alias("n"))
