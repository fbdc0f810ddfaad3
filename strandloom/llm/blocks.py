"""Ordered groups of any size: cutting a group into blocks along its order.

A window over a group puts the whole group into one task.  Where a group may
hold a third of all rows it is cut into blocks at approximate quantiles of its
order column; a running value is then the value inside the block plus what the
blocks before it add up to, and those per-block totals are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import cut

#: Rows that one block of an ordered group is meant to hold.
BLOCK_ROWS = 200_000
#: Most blocks of one group: one of three billion rows still has blocks of that size.
MAX_BLOCKS = 16_384


def hot_groups(df: DataFrame, group: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """The groups of more than ``block_rows`` rows with their number ``_n``, written
    out; None for none.

    Knowing them beforehand keeps the plans of ordinary groups free of the
    joins that cutting takes.
    """
    hot = cut(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows))
    return None if hot.isEmpty() else hot


def with_blocks(df: DataFrame, group: Sequence[str], order: str, block_rows: int = BLOCK_ROWS, name: str = "block", hot: DataFrame | None | str = "find") -> DataFrame:
    """Add ``name``: the number of the row's block, ascending with ``order``.

    ``order`` is numeric.  Rows equal in it share a block.  A null in it is
    below all values.  Groups up to ``block_rows`` are block 0 throughout.
    ``hot``: what ``hot_groups`` gave for the same groups, where it is known.
    """
    if isinstance(hot, str):
        hot = hot_groups(df, group, block_rows)
    if hot is None:
        return df.withColumn(name, F.lit(0))
    value = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    keys = [F.col(c) for c in group]
    most = hot.agg(F.max("_n")).first()[0]
    blocks = max(2, min(MAX_BLOCKS, 4 * -(-most // block_rows)))
    fractions = [i / blocks for i in range(1, blocks)]
    quantiles = df.join(hot, list(group), "left_semi").groupBy(*keys).agg(F.percentile_approx(value, fractions, max(20_000, 2 * blocks)).alias("_q"), F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(block_rows)))
    step = F.greatest(F.lit(1), F.floor(F.lit(blocks) / (step + 1))).cast("int")
    cuts = quantiles.select(*keys, F.array_distinct(F.filter("_q", lambda q, i: i % step == step - 1)).alias("_cuts"))
    found = df.join(cut(cuts), list(group), "left")
    block = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c < value)))
    return found.withColumn(name, block.cast("int")).drop("_cuts")


def block_offsets(blocks: DataFrame, group: Sequence[str], sums: dict[str, str], name: str = "block") -> DataFrame:
    """For each block, what the blocks before it in its group add up to.

    ``blocks`` has one row for each group and block; ``sums`` maps an output
    column to the column that is added up.
    """
    before = Window.partitionBy(*group).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*group, name, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for o, c in sums.items()])
