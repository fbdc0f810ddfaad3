"""Mixing sources to target weights of the total size in tokens.

A source's weight is its token share moved to its target by an exponent: share
times (target over share) to the exponent, so that 1 gives the target and 0 the
natural share.  Where a source cannot give that much even if each record is
used as often as it may be, its exponent is bisected until the weight meets the
repetition limit; such a source falls short.  The weights of all sources are the
budgets (times the total) and, normalised, the shares of the mix.  Targets may
first be tempered as a whole: raised to one exponent, bisected until they have a
wanted entropy.  Budgets are realised as block permutations: a source gives
whole passes over its records while its budget lasts, and the last pass takes a
pseudo-random permutation of blocks and, in the one block where the budget ends,
of records.

Defined results for odd input:

* null, blank and empty texts have no tokens and are no part of a mix;
* sources are compared trimmed and in lower case; a null source is no source;
* targets whose source has no records get nothing and are reported as short;
* records of sources without a target are left out but count for the total;
* targets that are repeated rows count once; null shares count as 0; shares are
  normalised by their sum; a null ``max_repeats`` is 1;
* repeated records are records like any other; empty tables give an empty mix;
* extra columns are ignored.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Blocks of a source's permutation; a block of the largest source stays below a task's size.
BLOCK_TOKENS = 20_000_000
#: Halvings of an interval of exponents, and how far from 1 an exponent may go.
STEPS, FAR = 60, 64.0


def source_name(c: Column) -> Column:
    """Trimmed, lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _counter(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            sizes = [len(e.ids) for e in tokenizer.encode_batch_fast(batch["text"].tolist(), add_special_tokens=False)] if len(batch) else []
            yield batch[["id", "source"]].assign(tokens=pd.Series(sizes, dtype="int64", index=batch.index))

    return run


def token_sizes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) of records that have tokens, whole texts."""
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    return rows.mapInPandas(_counter(tokenizer), "id long, source string, tokens long").filter("tokens > 0")


def temperature(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent, normalised; a share of 0 stays 0."""
    up = {k: v**exponent if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(up.values())
    return {k: v / total if total else 0.0 for k, v in up.items()}


def entropy(shares: dict[str, float]) -> float:
    """In nats."""
    return -sum(v * math.log(v) for v in shares.values() if v > 0)


def exponent_for_entropy(shares: dict[str, float], target: float, steps: int = 60) -> float:
    """The exponent at which the weights have the target entropy.

    Entropy falls as the exponent grows; the target is clamped to what exponents
    from 0 (uniform) to 64 reach.
    """
    low, high = 0.0, 64.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(temperature(shares, mid)) > target else (low, mid)
    return (low + high) / 2


def fitting_exponent(have: Column, target: Column, most: Column, steps: int = STEPS) -> Column:
    """The exponent nearest to 1 at which the weight is at most ``most``.

    The weight grows with the exponent where the target is above the natural
    share ``have`` and falls where it is below, so one of the two ways from 1 leads
    to smaller weights.  Null where the source has no records.
    """
    ratio = target / have
    way = F.when(ratio > 1, -1.0).otherwise(1.0) * FAR
    fits = lambda far: have * F.pow(ratio, 1 + way * far) <= most
    start = F.struct(F.lit(0.0).alias("over"), F.lit(1.0).alias("fits"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["over"] + s["fits"]) / 2
        return F.struct(F.when(fits(mid), s["over"]).otherwise(mid).alias("over"), F.when(fits(mid), mid).otherwise(s["fits"]).alias("fits"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: 1 + way * s["fits"])
    return F.when(have > 0, F.when(target <= most, F.lit(1.0)).otherwise(found))


def mix_plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, target_entropy: float | None = None) -> DataFrame:
    """The budget of each target source.

    (source, target_share, max_repeats, tokens, wanted, exponent, weight, budget,
    short, mix_share): ``wanted`` is the target share of ``total`` (all records, if
    not given), ``exponent`` the one nearest to 1 that keeps the repetition limit,
    ``weight`` the tempered share at it, ``budget`` that weight's tokens, ``short``
    whether the exponent had to leave 1 (or there are no records) and ``mix_share``
    the weight normalised over all sources.  ``target_entropy`` (in nats): the
    targets, being configuration, are first tempered to it.
    """
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    asked = targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("max_repeats"))
    asked = asked.filter("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    if target_entropy is not None:
        shares = {r["source"]: r["share"] for r in asked.collect()}
        norm = sum(shares.values()) or 1.0
        x = exponent_for_entropy({k: v / norm for k, v in shares.items()}, target_entropy)
        asked = asked.withColumn("share", F.when(F.col("share") > 0, F.pow(F.col("share"), F.lit(x))).otherwise(F.lit(0.0)))
    joined = asked.join(by_source, "source", "full").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    joined = cut(joined)  # a row a source; the texts are tokenised once
    sums = joined.agg(F.sum("share").alias("share"), F.sum("tokens").alias("all"), F.sum(F.when(F.col("share").isNotNull(), F.col("tokens"))).alias("mine")).first()
    everything = float((sums["all"] or 0) if total is None else total)
    target = F.col("share") / F.lit(sums["share"] or 1.0)
    have, most = F.col("tokens") / F.lit(float(sums["mine"] or 1)), F.col("max_repeats") * F.col("tokens") / F.lit(everything or 1.0)
    rows = joined.filter("share is not null").withColumn("target_share", target).withColumn("have", have).withColumn("most", most)
    rows = rows.withColumn("exponent", fitting_exponent(F.col("have"), F.col("target_share"), F.col("most")))
    rows = rows.withColumn("weight", F.when(F.col("have") > 0, F.col("have") * F.pow(F.col("target_share") / F.col("have"), F.col("exponent"))).otherwise(F.lit(0.0)))
    # What no exponent brings below the limit (the target is the natural share) is cut at it.
    rows = rows.withColumn("weight", F.least("weight", "most"))
    weights = rows.agg(F.sum("weight")).first()[0] or 1.0
    short = (F.col("target_share") > 0) & (F.col("exponent").isNull() | (F.col("exponent") != 1))
    return rows.select(
        "source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats"), F.col("tokens").cast("long").alias("tokens"), F.round(F.col("target_share") * everything).cast("long").alias("wanted"),
        "exponent", "weight", F.round(F.col("weight") * everything).cast("long").alias("budget"), short.alias("short"), (F.col("weight") / weights).alias("mix_share"),
    )


def realise(sizes: DataFrame, plan: DataFrame, seed: int = 7, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Records of the mix with their number of copies: (id, source, tokens, copies).

    Whole passes give every record of a source ``budget div tokens`` copies.
    The rest of the budget is filled block by block, the blocks in hash order,
    and in the block where it ends record by record; records that do not fit
    are passed over, so a source never exceeds its budget.
    """
    rows = sizes.join(F.broadcast(plan.select("source", F.col("tokens").alias("all"), "budget", "max_repeats")), "source")
    rows = rows.withColumn("whole", F.least(F.floor(F.col("budget") / F.greatest(F.lit(1), F.col("all"))), F.col("max_repeats").cast("long")))
    rows = rows.withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), F.col("budget") - F.col("whole") * F.col("all")).otherwise(F.lit(0)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("all") / block_tokens))
    rows = rows.withColumn("key", F.xxhash64("id", "source", F.lit(seed))).withColumn("block", F.pmod("key", blocks))
    size = rows.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rows = rows.join(size, ["source", "block"])
    left = F.col("rest") - F.col("before")
    ends_here = rows.filter((left > 0) & (left < F.col("size")))
    order = Window.partitionBy("source", "block").orderBy("key", "id")
    ends_here = ends_here.withColumn("upto", F.sum("tokens").over(order)).withColumn("extra", (F.col("upto") <= left).cast("long"))
    others = rows.filter(~((left > 0) & (left < F.col("size")))).withColumn("extra", (left >= F.col("size")).cast("long"))
    cols = ["id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")]
    return ends_here.select(*cols).unionByName(others.select(*cols)).filter("copies > 0")


def mix_report(plan: DataFrame, mix: DataFrame) -> DataFrame:
    """Target, planned and actual shares of each target source."""
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    rows = plan.join(used, "source", "left").na.fill(0, ["used", "most_copies"])
    rows = cut(rows)  # a row a source
    return rows.withColumn("actual_share", F.col("used") / F.lit(max(1, rows.agg(F.sum("used")).first()[0] or 0)))
