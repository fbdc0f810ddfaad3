"""Signals over embeddings and times: bursts, baselines, novelty, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.functions import vec


def activity_bursts(rows: DataFrame, now: Column, group: list[str], since_h: float = S.ACTIVITY_SINCE_H, decay_h: float = S.ACTIVITY_DECAY_H) -> DataFrame:
    """Counts in the window per group, decayed by the age of the newest row.

    ``rows`` has ``micros`` (null: skipped), ``stale`` and the group columns.
    """
    live = rows.filter(~F.col("stale") & F.col("micros").isNotNull() & (F.col("micros") >= now - F.lit(int(since_h * 3.6e9))))
    agg = live.groupBy(*group).agg(F.count(F.lit(1)).alias("members"), F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"))
    score = F.col("members") * F.exp(-vec.age_hours(now, F.col("last_micros")) / max(decay_h, 0.01))
    return agg.withColumn("score", F.round(score, 6))


def newest(rows: DataFrame, group: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group in an order."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= n)


def baselines(rows: DataFrame, group: str | None, width: int, least_rows: int = S.BASELINE_ROWS) -> DataFrame:
    """Mean vector per group (or over all); groups below ``least_rows`` have none."""
    grouped = rows.groupBy(group) if group else rows.groupBy()
    return grouped.agg(vec.mean_vector("v", width).alias("mean"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least_rows)


def novelty(recent: DataFrame, by_group: DataFrame, overall: DataFrame, group: str) -> DataFrame:
    """1 - cosine to the group's baseline, else to the overall one; rows without either fall away."""
    both = recent.join(by_group.select(group, F.col("mean").alias("own")), group, "left").crossJoin(overall.select(F.col("mean").alias("all")))
    base = F.coalesce("own", "all")
    return both.withColumn("novelty", F.round(F.greatest(F.lit(0.0), 1 - vec.cosine(F.col("v"), base)), 6)).drop("own", "all")


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; a tie goes to the smaller."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("m"), value)).alias(value), F.max("n").alias("n"))


def entropy(rows: DataFrame, key: list[str], weight: str) -> DataFrame:
    """Shannon entropy in nats, normalised by its most, over positive weights."""
    positive = rows.filter(F.col(weight) > 0)
    totals = positive.groupBy(*key).agg(F.sum(weight).alias("_total"))
    p = (positive.join(totals, key) if key else positive.crossJoin(totals)).withColumn("p", F.col(weight) / F.col("_total"))  # one row without a key
    grouped = p.groupBy(*key).agg(F.sum(-F.col("p") * F.log("p")).alias("h"), F.count(F.lit(1)).alias("n"))
    return grouped.select(*key, F.round("h", 6).alias("entropy"), F.col("n").alias("bins"), F.when(F.col("n") > 1, F.round(F.col("h") / F.log("n"), 6)).otherwise(F.lit(0.0)).alias("normalised"))


def composite(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum; bad weights count 0, thirds where none is left, null parts count 0."""
    clean = {k: (w if w == w and w > 0 else 0.0) for k, w in weights.items()}
    if sum(clean.get(k, 0.0) for k in ("density", "activity", "novelty")) <= 0:
        clean |= {k: 1 / 3 for k in ("density", "activity", "novelty")}
    return F.round(sum((F.coalesce(c, F.lit(0.0)) * clean.get(k, 0.0) for k, c in parts.items()), F.lit(0.0)), 6)
