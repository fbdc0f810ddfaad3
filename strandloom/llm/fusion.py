"""One ranking from several differently scaled scores: outranking net flow.

Within a query every score becomes a percentile (mid-rank over all candidates
of the query).  Of two candidates the better is preferred to the degree
``P(d)`` of the difference ``d`` of their percentiles: 0 up to the indifference
``q``, 1 from the strict preference ``s`` on, linear between.  A candidate's
net flow is the mean preference over all others minus the mean preference of
all others over it, weighted over the scores.  Sums over all others come
exactly from prefix sums over the sorted percentiles, so no pairs are formed.

Defined results for odd input:

* a missing score (null, NaN, or zero where ``zero_is_missing``) ranks below
  every present value and ties with the other missing ones;
* repeated rows of one query and item count once, with the best present value;
* infinite scores are extreme values, nothing more; ties share the mid-rank;
* rows with a null query or item fall away; a query of one candidate has flow 0;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.blocks import BLOCK_ROWS, block_offsets, hot_groups, with_blocks


@dataclass(frozen=True)
class Score:
    """One score: its column, whether high is good, its weight, what is missing."""

    column: str
    high_is_good: bool = True
    weight: float = 1.0
    zero_is_missing: bool = False


LOWEST = float("-inf")


def _percentiles(classes: DataFrame, block_rows: int, hot: DataFrame | None) -> DataFrame:
    """Add ``p`` (mid-rank percentile) and ``n`` to classes (query, score, v, c)."""
    group = ["query", "score"]
    rows = with_blocks(classes, group, "v", block_rows, hot=hot)  # a class is one value: ties are one row
    inside = Window.partitionBy(*group, "block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("less", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    sizes = rows.groupBy(*group, "block").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds"))
    offsets = block_offsets(sizes, group, {"before": "size"})
    whole = Window.partitionBy(*group)
    totals = sizes.select(*group, "block", F.sum("size").over(whole).alias("n"), F.sum("kinds").over(whole).alias("kinds"))
    rows = rows.join(offsets.join(totals, [*group, "block"]), [*group, "block"])
    return rows.select(*group, "v", "c", "n", "kinds", ((F.col("before") + F.col("less") + F.col("c") / 2) / F.col("n")).alias("p"))


def _flows(ranked: DataFrame, q: float, s: float, block_rows: int, hot: DataFrame | None) -> DataFrame:
    """The net flow of each class (query, score, v) from prefix sums over ``p``."""
    group = ["query", "score"]
    probe = lambda at, x: F.struct(F.lit(at).alias("at"), x.alias("x"), F.lit(0).cast("long").alias("w"))
    p = F.col("p")
    points = F.array(F.struct(F.lit(0).alias("at"), p.alias("x"), F.col("c").alias("w")), probe(1, p - s), probe(2, p - q), probe(3, p + q), probe(4, p + s))
    rows = ranked.select(*group, "v", "c", "n", "kinds", "p", F.explode(points).alias("t")).select("*", "t.*").drop("t")
    # Cut at quantiles of the points, as ties can crowd them at one end of [0, 1].
    rows = with_blocks(rows, group, "x", block_rows, hot=hot)
    upto = Window.partitionBy(*group, "block").orderBy("x", F.when(F.col("at") == 0, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("w_in", F.sum("w").over(upto)).withColumn("s_in", F.sum(F.col("w") * F.col("x")).over(upto))
    sizes = rows.groupBy(*group, "block").agg(F.sum("w").alias("w_all"), F.sum(F.col("w") * F.col("x")).alias("s_all"))
    rows = rows.join(block_offsets(sizes, group, {"w_before": "w_all", "s_before": "s_all"}), [*group, "block"])
    total = lambda at, c: F.max(F.when(F.col("at") == at, F.col(f"{c}_before") + F.col(f"{c}_in")))
    one = rows.groupBy(*group, "v", "n", "p").agg(*[total(at, c).alias(f"{c}{at}") for at in (1, 2, 3, 4) for c in ("w", "s")])
    gap = F.lit(s - q)
    over = F.col("w1") + ((p - q) * (F.col("w2") - F.col("w1")) - (F.col("s2") - F.col("s1"))) / gap
    under = (F.col("n") - F.col("w4")) + ((F.col("s4") - F.col("s3")) - (p + q) * (F.col("w4") - F.col("w3"))) / gap
    flow = F.when(F.col("n") > 1, (over - under) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return one.select(*group, "v", "p", flow.alias("flow"))


def outranking(df: DataFrame, query: str, item: str, scores: Sequence[Score], q: float = 0.0, s: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Net flow of every candidate: (query, item, net_flow, missing, place).

    ``missing`` counts the scores a candidate lacks; ``place`` is its place in
    the query from 1, by net flow rounded to 9 digits, then by item.
    """
    if not 0 <= q < s:
        raise ValueError("0 <= q < s must hold")
    if not scores:
        raise ValueError("no score given")

    def clean(x: Score):
        c = F.col(x.column).cast("double")
        gone = c.isNull() | F.isnan(c) | ((c == 0) if x.zero_is_missing else F.lit(False))
        return F.when(~gone, (c if x.high_is_good else -c) + F.lit(0.0))

    rows = df.select(F.col(query).alias("query"), F.col(item).alias("item"), *[clean(x).alias(f"v{i}") for i, x in enumerate(scores)])
    rows = rows.filter(F.col("query").isNotNull() & F.col("item").isNotNull())
    rows = rows.groupBy("query", "item").agg(*[F.max(f"v{i}").alias(f"v{i}") for i in range(len(scores))])
    each = F.array(*[F.struct(F.lit(i).alias("score"), F.coalesce(F.col(f"v{i}"), F.lit(LOWEST)).alias("v"), F.col(f"v{i}").isNull().cast("int").alias("gone")) for i in range(len(scores))])
    long = rows.select("query", "item", F.explode(each).alias("t")).select("query", "item", "t.*")
    classes = long.groupBy("query", "score", "v").agg(F.count(F.lit(1)).alias("c"))
    hot = hot_groups(classes, ["query", "score"], block_rows)
    flows = _flows(_percentiles(classes, block_rows, hot), q, s, block_rows, hot)
    weight = F.create_map(*[F.lit(y) for i, x in enumerate(scores) for y in (i, float(x.weight))])
    total = sum(x.weight for x in scores)
    out = long.join(flows, ["query", "score", "v"]).groupBy("query", "item").agg((F.sum(weight[F.col("score")] * F.col("flow")) / total).alias("net_flow"), F.sum("gone").alias("missing"))
    out = out.withColumn("net_flow", F.round("net_flow", 9))
    return out.select(F.col("query").alias(query), F.col("item").alias(item), "net_flow", "missing")


def best(ranked: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The ``k`` candidates of each query that no score lacks and that stand highest.

    The filter on the place lets Spark keep only k rows of a query before the
    shuffle.
    """
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("net_flow"), item))
    return ranked.filter("missing = 0").withColumn("place", place).filter(F.col("place") <= k)
